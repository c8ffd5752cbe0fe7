"""Language identification by rank-order profiles.

A profile lists the most frequent letter n-grams (one to three characters; a word's edges count as a character) in order
of frequency. A text's own profile is compared with each language's: for every n-gram of the text, how many places is it
out of place? An n-gram that the language's profile lacks counts as far out as the profile is long. The language with
the smallest sum is the prediction; ties go to the first in code point order.

Profiles are learnt from all labelled texts that are not held out: each task sums n-gram counts over its texts, Spark adds
them up, and the top of each language (languages x profile length rows, checked against MOST_LANGUAGES) goes to the tasks.
n-grams are packed into one 64-bit number, 21 bits a character, so equal numbers are equal n-grams.

Defined results: a null text, or one without letters, is ``und`` with score 0, as is any text if nothing was learnt.
Repeated rows get the same result. Columns other than the text are not looked at in a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarterhour.llm.common import fields, structs

PROFILE, UNKNOWN, MOST_LANGUAGES = 400, "und", 1000
CHUNK, EDGE, BITS = 1 << 18, 1, 21


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> itself plus 2 if it is a letter, else the edge mark."""
    return np.array([c + 2 if not 0xD800 <= c < 0xE000 and chr(c).isalpha() else EDGE for c in range(0x110000)], np.uint32)


def grams(text: str) -> np.ndarray:
    """All n-grams of a text, packed."""
    codes = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    codes = np.concatenate([[EDGE], codes, [EDGE]]).astype(np.uint64)
    edge = codes == EDGE
    codes = codes[~(edge & np.concatenate([[False], edge[:-1]]))]  # a run of other characters is one edge
    if len(codes) < 3:
        return np.zeros(0, np.uint64)
    edge, shift = codes == EDGE, np.uint64(BITS)
    two = codes[:-1] << shift | codes[1:]
    three = two[:-1] << shift | codes[2:]
    return np.concatenate([codes[~edge], two, three[~edge[1:-1]]])


def chunks(text: str) -> Iterator[str]:
    """Parts of bounded length, cut where a word ends, so that all of them together have the n-grams of the text."""
    at = 0
    while at < len(text):
        end = min(at + CHUNK, len(text))
        while end < len(text) and text[end - 1].isalpha() and text[end].isalpha():
            end += 1
        yield text[at:end]
        at = end


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    keys, inverse = np.unique(np.concatenate([np.zeros(0, np.uint64), *[k for k, _ in parts]]), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate([np.zeros(0, np.int64), *[n for _, n in parts]]), len(keys)).astype(np.int64)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    return added([np.unique(grams(part), return_counts=True) for part in chunks(text)])


def _count_by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        for lang, text in zip(*batch.columns, strict=True):
            own = sums.setdefault(lang.as_py(), [])
            own.append(counted(text.as_py()))
            if sum(len(k) for k, _ in own[1:]) > max(1 << 19, len(own[0][0])):
                own[:] = [added(own)]
    for lang, own in sums.items():
        keys, n = added(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", length: int = PROFILE) -> list[tuple[str, list[int]]]:
    """(language, its n-grams in order) from every row with text and language, languages in code point order."""
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    sums = rows.mapInArrow(_count_by_language, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = sums.withColumn("place", place).where(F.col("place") <= length).limit(MOST_LANGUAGES * length + 1).collect()
    if len(top) > MOST_LANGUAGES * length:
        raise ValueError(f"more than {MOST_LANGUAGES} languages; their profiles are sent to every task")
    profiles: dict[str, list[int]] = {}
    for row in sorted(top, key=lambda r: (r.lang, r.place)):
        profiles.setdefault(row.lang, []).append(row.gram)
    return list(profiles.items())


class Judge:
    """Out-of-place distances of a text to all profiles at once."""

    def __init__(self, profiles: list[tuple[str, list[int]]], length: int):
        self.names, self.length = [name for name, _ in profiles], length
        self.keys = np.unique(np.array([g for _, own in profiles for g in own], np.int64).view(np.uint64))
        self.places = np.full((len(profiles), len(self.keys)), length, np.int64)
        for i, (_, own) in enumerate(profiles):
            self.places[i, np.searchsorted(self.keys, np.array(own, np.int64).view(np.uint64))] = np.arange(len(own))

    def __call__(self, text: str | None) -> tuple[str, float]:
        keys, n = counted(text or "")
        if not len(keys) or not self.names:
            return UNKNOWN, 0.0
        own = keys[np.argsort(-n, kind="stable")[:self.length]]  # equally frequent ones by code points
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        places = np.where(self.keys[at] == own, self.places[:, at], self.length)
        out = np.where(places < self.length, np.abs(places - np.arange(len(own))), self.length).sum(axis=1)
        best = int(out.argmin())
        return self.names[best], 1 - float(out[best]) / (self.length * len(own))


def predicted(text: Column | str, profiles: list[tuple[str, list[int]]], length: int = PROFILE) -> Column:
    """Struct of lang_pred and score (1: the very profile, 0: no n-gram in common)."""

    @F.arrow_udf(fields(lang_pred=T.StringType(), score=T.DoubleType()))
    def judged(column: pa.Array) -> pa.Array:
        judge = Judge(profiles, length)
        found = [judge(x.as_py()) for x in column]
        return structs({"lang_pred": ([f[0] for f in found], pa.string()), "score": ([f[1] for f in found], pa.float64())})

    return judged(text)
