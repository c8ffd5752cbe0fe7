"""License scans against a plain scan of every place."""

import math
import random
import re

import cases
from pyspark.sql import functions as F

from quarterhour.llm import license_scan as ls
from quarterhour.llm import queries

SMALL = "/root/testdata/sf0.001"


def split(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain(texts):
    """Per text: words, (template, place) in order, score; every template at every place, before the text's start too."""
    split_texts = [split(t) for t in texts]
    weight = {w: max(1, round(1000 * math.log((len(texts) + 1) / (sum(w in set(ws) for ws in split_texts) + 1)))) for t in ls.TEMPLATES for w in t.words}
    out = []
    for ws in split_texts:
        found, score = [], 0.0
        for k, t in enumerate(ls.TEMPLATES):
            total, (lo, hi) = sum(weight[w] for w in t.words), t.key_at
            for at in range(-lo, len(ws)):
                fits = [0 <= at + j < len(ws) and ws[at + j] == w for j, w in enumerate(t.words)]
                matched = sum(weight[w] for w, ok in zip(t.words, fits, strict=True) if ok)
                if all(fits[lo:hi]) and 100 * matched >= t.percent * total:
                    found.append((k, at))
                    score = max(score, matched / total)
        out.append((len(ws), sorted(found), round(score, 6)))
    return out


def scanned(df, text_col="text"):
    got = ls.scanned(df, text_col).collect()
    return [(r.n_words, sorted((p.template, p.at) for p in r.places), r.score) for r in got], [r.row[text_col] for r in got]


def agree(df):
    got, texts = scanned(df)
    assert got == plain(texts)
    return got


def test_awkward_rows(spark):
    df = cases.documents(spark)
    agree(df)
    agree(cases.clashing(df).withColumn("words", F.lit(1)).withColumn("places", F.lit(2)))
    assert ls.scanned(df.limit(0)).count() == 0
    assert queries.op12_license_scan  # registered under this name


def test_templates_broken_and_whole(spark):
    rnd, texts = random.Random(4), []
    for t in ls.TEMPLATES:
        own = t.words
        texts += [t.text, t.text.upper().replace(" ", "-"), "x " + t.text + " " + t.text, " ".join(own[1:]), " ".join(own[:-1]), t.key]
        for _ in range(6):
            texts.append(" ".join(w if rnd.random() < 0.75 else "zz" for w in own) + " tail of the license")
            texts.append(" ".join([*rnd.choices(own, k=30), t.key, *own[-3:]]))
    texts += ["gnu " * 50, "the license " * 3000, " ".join(rnd.choices(sorted({w for t in ls.TEMPLATES for w in t.words}), k=20_000)), "GNUKGeneral Public License", "cc by cc by", None, ""] * 2
    got = agree(spark.createDataFrame([(t,) for t in texts], "text string").repartition(4))
    assert {k for _, found, _ in got for k, _ in found} == set(range(len(ls.TEMPLATES)))
    assert any(0 < score < 1 for _, _, score in got)


def test_query_and_its_sql(spark, duck):
    got = queries.op12_license_scan(spark, SMALL)
    want = duck.execute(queries.SQL["op12_license_scan"]).fetchall()
    assert cases.rows(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score") == sorted(want, key=repr)
    agree(spark.read.parquet(f"{SMALL}/documents.parquet"))


def test_index_holds_two_words_of_whatever_stands():
    weight = {w: 1 + i % 7 for i, w in enumerate(sorted({w for t in ls.TEMPLATES for w in t.words}))}
    for t in ls.TEMPLATES:
        chosen, votes = ls.rare(t, weight)
        own = [weight[w] for w in t.words]
        heaviest = sorted((own[i] for i in chosen), reverse=True)[:votes - 1]
        assert 100 * (sum(own[i] for i in chosen) - sum(heaviest)) > (100 - t.percent) * sum(own)


def test_native_plan(spark):
    plan = queries.op12_license_scan(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
