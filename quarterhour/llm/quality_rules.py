"""Quality rules as a bitmask ledger.

Every rule is evaluated once per text. The ledger keeps the measurements and one long whose bit i is set when rule i fails.
A policy is a mask over these bits, so a new policy version, or the question what each rule contributes, needs no second
look at the texts: ``failed = bits & mask != 0``, and ablations are counts over the few distinct values of ``bits & mask``.

Defined results: a null or empty text has no words and fails ``few_words``; repeated rows are judged alike; columns other
than the text are never looked at, so further columns and clashing names do no harm (the caller names the ledger column).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarterhour.llm.common import fields, structs, texts

#: Bit i belongs to the i-th rule. New rules are appended, never inserted, so that stored ledgers stay readable.
RULES = {
    "few_words": lambda m: m["n_words"] < 50,
    "repeated_words": lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"],
    "word_length": lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 15 * m["n_words"]),
    "symbols": lambda m: 10 * m["n_symbols"] > m["n_words"],
    "repeated_lines": lambda m: 2 * m["n_dup_lines"] > m["n_lines"],
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]
#: Versions of the policy: the rules that count.
POLICIES = {"v1": BASE, "v2": sum(BIT.values())}
CURRENT = "v2"

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
LEDGER = fields(**{m: T.LongType() for m in [*MEASURES, "bits"]})
SYMBOLS, SPACES, WINDOW = "#*$%&|<>", " \t\n\x0b\x0c\r", 3


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words covered by windows of ``window`` words that occur at least twice, first occurrences included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    windows = codes[:n].copy()
    for i in range(1, window):  # pairs of dense numbers stay dense, so nothing overflows
        windows = np.unique(windows, return_inverse=True)[1] * len(ids) + codes[i:n + i]
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    covered = np.zeros(len(words), bool)
    for i in range(window):
        covered[i:n + i] |= twice
    return int(covered.sum())


def measure_text(text: str) -> list[int]:
    """The measurements of one text, in the order of ``MEASURES``. Splitting bytes cuts at ASCII white space only."""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return [len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated_words(words)]


@F.arrow_udf(LEDGER)
def _ledger(column: pa.Array) -> pa.Array:
    rows = np.array([measure_text(t) for t in texts(column)], np.int64).reshape(-1, len(MEASURES))
    m = {name: rows[:, i] for i, name in enumerate(MEASURES)}
    bits = sum((np.asarray(fails(m)).astype(np.int64) * BIT[name] for name, fails in RULES.items()), np.zeros(len(rows), np.int64))
    return structs({k: (v, pa.int64()) for k, v in (m | {"bits": bits}).items()})


def ledger(text: Column | str) -> Column:
    """The ledger entry of a text: measurements and failure bits."""
    return _ledger(text)


def fails(bits: Column, mask: int) -> Column:
    return bits.bitwiseAND(F.lit(mask)) != 0


def ablations(bits: DataFrame, policy: str = CURRENT, column: str = "bits") -> DataFrame:
    """What each rule of a policy contributes: texts it rejects, texts only it rejects, texts kept with and without it.

    The texts are first counted by ``bits & mask`` (at most 2^rules rows), then each rule reads those counts.
    """
    mask = POLICIES[policy]
    counts = bits.groupBy(F.col(column).bitwiseAND(F.lit(mask)).alias("failed")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(BIT[name]).cast("long").alias("bit")) for name in RULES if BIT[name] & mask]))
    each = counts.select("failed", "n", rules.alias("r")).select("failed", "n", "r.*")
    total = lambda keep: F.coalesce(F.sum(F.when(keep, F.col("n"))), F.lit(0))
    kept, only = F.col("failed") == 0, F.col("failed") == F.col("bit")
    return each.groupBy("rule", "bit").agg(total(F.col("failed").bitwiseAND(F.col("bit")) != 0).alias("n_failed"), total(only).alias("n_only"), total(kept).alias("n_kept"), total(kept | only).alias("n_kept_without"))
