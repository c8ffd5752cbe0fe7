"""Token counts without keeping tokens.

The text is cut at safe boundaries: before a run of spaces that follows another character. The vocabulary has no piece
with a space mark behind another character (checked when the model is loaded), so no merge can cross such a boundary and
the counts of the parts add up to the count of the whole. Parts repeat far more often than texts do, so each worker keeps
a bounded table of part -> count and encodes only parts that are not in it, in batches of bounded bytes.

Defined results: a null text counts as empty and has 0 bytes and 0 tokens; whole texts are counted, nothing is truncated;
repeated rows get the same counts; columns other than the text are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarterhour.llm.common import structs, texts

MODEL, LIMIT = "piece_bpe_32k.model", 4096
#: Bytes of text that are split at a time, parts kept per worker, and the longest part that is kept.
BATCH_BYTES, KEPT_PARTS, KEPT_CHARS = 1 << 21, 400_000, 64
#: The library takes the mark for a space, too, so a boundary is only safe where neither stands before it.
MARK = "▁"
PART = re.compile(f"[ {MARK}]+[^ {MARK}]*").findall


@lru_cache(maxsize=2)
def _model(path: str) -> tuple[sentencepiece.SentencePieceProcessor, dict[str, int]]:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    if any(MARK in p.lstrip(MARK) for p in pieces):
        raise ValueError(f"{path} has pieces with a space inside, so texts can't be cut before spaces")
    return model, {}


def batches(rows: Iterator[str], most: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Consecutive texts whose bytes reach ``most``, so that batches are even whatever the lengths; one long text is a batch."""
    batch, held = [], 0
    for text in rows:
        batch.append(text)
        held += len(text.encode("utf-8", "surrogatepass"))
        if held >= most:
            yield batch
            batch, held = [], 0
    if batch:
        yield batch


def count_tokens(rows: list[str], path: str) -> list[int]:
    """Tokens of each text as the library counts them for whole texts."""
    model, known = _model(path)
    # The library puts one space before a text that isn't empty; a part stands for itself with its first space left out.
    parts = [PART(" " + text) if text else [] for text in rows]
    missing = list(set().union(*parts).difference(known))
    known.update(zip(missing, map(len, model.encode([p[1:] for p in missing], num_threads=1)), strict=True))
    known.update((p, 1) for p in missing if len(p) == 1)  # a last single space, of which nothing is left to encode
    counts = [sum(map(known.__getitem__, p)) for p in parts]
    if len(known) > KEPT_PARTS:
        known.clear()
    for p in missing:
        if len(p) > KEPT_CHARS:
            known.pop(p, None)
    return counts


def token_counts(text: Column | str, model: str = MODEL, limit: int = LIMIT) -> Column:
    """UTF-8 bytes, tokens, and whether the tokens exceed ``limit``. ``model`` names a file of the tokenizer package."""

    @F.arrow_udf("struct<n_bytes: bigint, n_tokens: bigint, over_limit: boolean>")
    def counted(column: pa.Array) -> pa.Array:
        path, n_bytes, n_tokens = public_tokenizers.path(model), [], []
        for batch in batches(texts(column)):
            n_bytes += [len(t.encode("utf-8", "surrogatepass")) for t in batch]
            n_tokens += count_tokens(batch, path)
        return structs({"n_bytes": (n_bytes, pa.int64()), "n_tokens": (n_tokens, pa.int64()), "over_limit": ([n > limit for n in n_tokens], pa.bool_())})

    return counted(text)
