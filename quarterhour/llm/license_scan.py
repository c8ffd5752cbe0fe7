"""License scans over a positional index of rare words, with DataFrame functions only.

Templates are short license texts: key phrases alone, or notices with a key phrase inside. A template stands at a place of a
text if its key phrase stands there word by word, and its other words are there up to a stated share of their weight.

1. Words of the templates get their inverse document frequency over all texts of the table as weight (one count per template
   word, whatever the size of the table).
2. Index: the heaviest words of each template, with their positions in it. There are so many of them that whatever reaches the
   template's share has at least two in their places: without one of two, too much weight would be missing.
3. Look-up: each indexed word of a text names the templates it belongs to and where these would begin. Beginnings that two
   words agree on are candidates; the intersection is that of numbers (template, beginning) within one row.
4. Candidates are verified word by word: key phrase first, then the weight of all words in their places.

Nothing is shuffled but the counts of template words, so a row is judged by itself and no group of rows can be hot.

Defined results: a null text counts as empty and has no words and no places. Texts are read whole, and rows alike get the same
result. An empty table gives an empty result. Equal weights are ordered by position, which changes the index but no result.
Columns other than the text are not looked at. Places are positions of words, from 0.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Digits, small letters and all beyond ASCII: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``, which the same engine matches ten times slower.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"


@dataclass(frozen=True)
class Template:
    """A license text; ``key`` is the phrase in it that must stand whole, ``percent`` the share of weight that must stand."""

    label: str
    text: str
    key: str
    percent: int

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_at(self) -> tuple[int, int]:
        own, key = self.words, self.key.split()
        return next((i, i + len(key)) for i in range(len(own)) if own[i:i + len(key)] == key)


def phrase(label: str, text: str) -> Template:
    return Template(label, text, text, 100)


def notice(label: str, text: str, key: str) -> Template:
    return Template(label, text, key, 60)


# The phrases that every scan reports, and the wording of well-known licenses.
BASE = [
    phrase("gpl", "gnu general public license"),
    phrase("apache", "apache license"),
    phrase("cc-by", "cc by"),
    phrase("mit", "mit license"),
]
OWN = [
    phrase("gpl-2.0", "gnu general public license version 2"),
    phrase("gpl-3.0", "gnu general public license version 3"),
    phrase("lgpl", "gnu lesser general public license"),
    phrase("agpl", "gnu affero general public license"),
    phrase("apache-2.0", "apache license version 2 0"),
    phrase("mpl-2.0", "mozilla public license version 2 0"),
    phrase("cc-by-4.0", "cc by 4 0"),
    phrase("cc-by-sa-4.0", "cc by sa 4 0"),
    phrase("cc-by-nc-4.0", "cc by nc 4 0"),
    phrase("cc-by-nd-4.0", "cc by nd 4 0"),
    phrase("cc-by", "creative commons attribution"),
    phrase("all-rights-reserved", "all rights reserved"),
    notice("mit-terms", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "hereby granted free of charge"),
    notice("isc-terms", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    notice("bsd-terms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "in source and binary forms"),
    notice("gpl-terms", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "under the terms of the gnu general public license"),
    notice("apache-terms", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "except in compliance with the license"),
    notice("mpl-terms", "this source code form is subject to the terms of the mozilla public license v 2 0", "subject to the terms of the mozilla public license"),
    notice("public-domain", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
]
TEMPLATES = BASE + OWN

#: A candidate is one number: its template times SPAN, plus where it would begin, plus half of SPAN.
SPAN = 1 << 34


def words(text: Column | str) -> Column:
    column = F.col(text) if isinstance(text, str) else text
    lowered = F.translate(F.coalesce(column, F.lit("")), ascii_uppercase, ascii_lowercase)
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def constant(values: list) -> Column:
    return F.array(*[F.lit(v) for v in values])


def weights(tokenised: DataFrame, templates: list[Template] = TEMPLATES, words_col: str = "words") -> dict[str, int]:
    """Word -> 1000 times its inverse document frequency, 1 at least, for the words of the templates."""
    wanted = sorted({w for t in templates for w in t.words})
    # The empty string is no word, so its count is that of the rows. At most one row per template word comes back.
    own = F.array_union(F.array(F.lit("")), F.array_intersect(F.col(words_col), constant(wanted)))
    counts = tokenised.select(F.explode(own).alias("word")).groupBy("word").agg(F.count("*").alias("rows")).collect()
    rows = {r.word: r.rows for r in counts}
    return {w: max(1, round(1000 * math.log((rows.get("", 0) + 1) / (rows.get(w, 0) + 1)))) for w in wanted}


def rare(template: Template, weight: dict[str, int]) -> tuple[list[int], int]:
    """Positions of the template's indexed words, and how many of them whatever reaches its share has in place."""
    own = [weight[w] for w in template.words]
    order = sorted(range(len(own)), key=lambda i: (-own[i], i))
    may_miss = (100 - template.percent) * sum(own)
    for votes in (2, 1):
        for n in range(votes, len(own) + 1):
            if 100 * sum(own[i] for i in order[votes - 1:n]) > may_miss:
                return order[:n], votes
    raise ValueError("a template needs a share above 0")


def postings(templates: list[Template], weight: dict[str, int]) -> dict[str, list[int]]:
    """Indexed word -> what to add to its position in a text to get the numbers of its candidates.

    Where one word must do, it is entered twice, so that a candidate always is a number found twice.
    """
    index: dict[str, list[int]] = {}
    for k, t in enumerate(templates):
        chosen, votes = rare(t, weight)
        for i in chosen:
            index.setdefault(t.words[i], []).extend([k * SPAN + SPAN // 2 - i] * (3 - votes))
    return index


def places(words_col: str, templates: list[Template], weight: dict[str, int]) -> Column:
    """Array of (template, at, matched): where templates stand, with the weight of their words that are in place."""
    index = postings(templates, weight)
    own, anchors = F.col(words_col), constant(sorted(index))
    lists = F.create_map(*[x for w, adds in sorted(index.items()) for x in (F.lit(w), F.array(*[F.lit(a).cast("long") for a in adds]))])
    known = F.array(*[F.struct(constant(t.words).alias("words"), F.array(*[F.lit(weight[w]).cast("long") for w in t.words]).alias("weights"),
                               F.lit(t.key_at[0]).alias("key_from"), F.lit(t.key_at[1] - 1).alias("key_to"), F.lit(t.percent * sum(weight[w] for w in t.words)).cast("long").alias("need")) for t in templates])
    # The positions of indexed words; a text with none of them is not gone through.
    at = F.array_compact(F.transform(own, lambda w, i: F.when(w.isin(*sorted(index)), i)))
    hits = F.when(F.arrays_overlap(own, anchors), at).otherwise(F.array().cast("array<int>"))
    numbers = F.flatten(F.transform(hits, lambda i: F.transform(F.element_at(lists, F.get(own, i)), lambda add: add + i)))

    def agreed(column: Column) -> Column:
        """What occurs twice or more in a sorted array; the lambda's own argument keeps it from being computed anew."""
        pairs = F.transform(F.array(F.sort_array(column)), lambda s: F.filter(s, lambda c, i: c == F.get(s, i + 1)))
        return F.array_distinct(F.flatten(pairs))

    def verified(number: Column) -> Column:
        k, start = F.floor(number / SPAN).cast("int"), (number % SPAN - SPAN // 2).cast("int")
        t = F.get(known, k)
        in_place = lambda j: F.coalesce(F.get(own, start + j) == F.get(t["words"], j), F.lit(False))
        whole_key = F.forall(F.sequence(t["key_from"], t["key_to"]), in_place)
        matched = F.aggregate(F.sequence(F.lit(0), F.size(t["words"]) - 1), F.lit(0).cast("long"), lambda total, j: total + F.when(in_place(j), F.get(t["weights"], j)).otherwise(0))
        return F.struct(k.alias("template"), start.alias("at"), F.when(whole_key, matched).otherwise(0).alias("matched"), t["need"].alias("need"))

    judged = F.transform(agreed(numbers), verified)
    return F.filter(judged, lambda p: (p["matched"] > 0) & (100 * p["matched"] >= p["need"]))


def joined_labels(found: Column, templates: list[Template]) -> Column:
    names = constant([t.label for t in templates])
    return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda p: F.get(names, p["template"])))), ",")


def scanned(docs: DataFrame, text_col: str = "text", base: list[Template] = BASE, own: list[Template] = OWN) -> DataFrame:
    """Per row: ``row`` (the row itself), n_words, places, base_places, base_labels, labels and score.

    score is the largest share of a template's weight that stands in its place, 0 where no template stands.
    """
    templates = base + own
    tokenised = docs.select(F.struct(*docs.columns).alias("row"), words(docs[text_col]).alias("words"))
    weight = weights(tokenised, templates)
    totals = F.array(*[F.lit(sum(weight[w] for w in t.words)).cast("double") for t in templates])
    found = tokenised.select("row", F.size("words").cast("long").alias("n_words"), places("words", templates, weight).alias("places"))
    found = found.withColumn("base_places", F.filter("places", lambda p: p["template"] < len(base)))
    shares = F.transform("places", lambda p: p["matched"] / F.get(totals, p["template"]))
    return found.select("row", "n_words", "places", "base_places", joined_labels(F.col("base_places"), templates).alias("base_labels"), joined_labels(F.col("places"), templates).alias("labels"),
                        F.round(F.coalesce(F.array_max(shares), F.lit(0.0)), 6).alias("score"))
