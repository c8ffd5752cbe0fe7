"""Awkward documents for every operator: nulls, empty and long texts, repeated rows, and columns named like the operators' own."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["row", "key", "grp", "part", "length", "start", "size", "taken", "target", "slice", "name", "known", "rep", "node", "label", "digest", "bands", "kept", "bits", "m", "s", "t", "p", "host", "low", "copies", "alike", "own", "turn", "mix_key"]

STORY = " ".join(f"word{i % 97}x{i % 89} then{i}" for i in range(60))
ROWS = [
    (1, STORY, "en", "a"), (2, STORY + " end", "en", "a"), (3, STORY.upper(), "de", "b"), (4, None, "en", "b"), (5, "", None, "a"),
    (6, " \t\n ", "fr", None), (7, "two words", "fr", None), (8, "two  words", "en", "a"), (9, "two words more", "en", "c"),
    (10, " ".join(f"long{i}" for i in range(60_000)), "en", "a"), (11, "x" * 50_000, "en", "b"), (None, STORY, "en", "a"), (None, None, None, None),
    (12, STORY, "en", "a"), (12, STORY, "en", "a"), (13, "password=abcdefghijkl " + STORY, "en", "b"), (14, "a b c é́ \U0001f600 <|endoftext|> ▁x\n\n  y ", "en", "c"),
    (15, "same line\nsame line\nsame line\n" + STORY, "en", "c"), (16, "<s> [INST] \\ ### </turn>", "es", "c"),
]


def documents(spark: SparkSession, rows=ROWS) -> DataFrame:
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], DOCS)


def clashing(df: DataFrame) -> DataFrame:
    """The same rows with further columns."""
    return df.withColumns({c: F.lit(f"{c}!") for c in CLASHES if c not in df.columns})


def rows(df: DataFrame, *cols: str) -> list[tuple]:
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)
