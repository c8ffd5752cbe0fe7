"""The pipeline against a brute-force version of its stages, and the registered queries against their SQL."""

import collections

import cases
import pytest
from compare import check
from test_near_dedup import plain_components
from test_packing_mixing import check_packed, plain_targets
from test_texts import plain_measures

import __spark_entry__ as entry
import corpus_pipeline
from quarterhour.llm import mixing, queries, secret_scan

SF = "/root/testdata/sf0.001"
SQL_NAMES = sorted(queries.SQL)


def plain_quality(rows):
    def kept(text):
        n_words, chars, symbols, lines, dup, repeated = plain_measures(text or "")
        return not (n_words < 50 or 100 * repeated > 50 * n_words or chars < 2 * n_words or chars > 15 * n_words or 10 * symbols > n_words or 2 * dup > lines)
    return [r for r in rows if kept(r[1])]


def staged(spark, docs):
    """The stages by hand, each on what the one before kept."""
    out, frames = docs, []
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, SF).cache()
        frames.append(out)
    return frames


def check_stages(spark, docs):
    columns, rows = docs.columns, [tuple(r)[:5] for r in docs.collect()]
    good, unique, masked, mix, packed = staged(spark, docs)
    for df in (good, unique, masked, mix):
        assert df.columns == columns
    same = lambda df, want: sorted((tuple(r)[:2] for r in df.collect()), key=repr) == sorted((tuple(r)[:2] for r in want), key=repr)
    want = plain_quality(rows)
    assert same(good, want)
    want = sorted(want, key=lambda r: (r[0] is None, r[0] or 0))  # rows without an id come last
    components = plain_components([(i, r[1]) for i, r in enumerate(want)])
    want = [r for i, r in enumerate(want) if components[i] == i]
    assert same(unique, want)
    want = [(r[0], secret_scan.redact_text(r[1], secret_scan.scan(r[1])[0]), *r[2:]) for r in want]
    assert same(masked, want) and all(r.n_chars == len(r.text) for r in masked.collect())
    sizes = collections.Counter()
    for r in want:
        sizes[r[3]] += len(r[1].split())
    taken = collections.Counter()
    for r in mix.collect():
        taken[r.source] += len(r.text.split())
    longest = max((len(r[1].split()) for r in want), default=0)
    for source, target in plain_targets(sizes, mixing.WEIGHTS, mixing.CAP).items() if want else ():
        assert abs(taken[source] - target) <= longest / 2 + 1  # whole documents
    texts = {(r[0], r[1]) for r in want}
    assert {tuple(r)[:2] for r in mix.collect()} <= texts
    if mix.count() == mix.select("doc_id").distinct().count():
        check_packed(packed.collect(), [tuple(r)[:2] for r in mix.collect()], 2048)
    else:  # a document of several epochs is packed as often
        assert sum(r.length for r in packed.collect()) == sum(r.doc_tokens for r in packed.collect() if r.start == 0)
    return packed


def test_stages_over_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    packed = check_stages(spark, docs)
    got = corpus_pipeline.run(spark, SF)
    pieces = lambda df: collections.Counter(tuple(r) for r in df.select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect())
    assert got.columns == packed.columns and pieces(got) == pieces(packed)


def test_stages_over_awkward_rows(spark):
    check_stages(spark, cases.documents(spark))
    docs = cases.clashing(cases.documents(spark))
    for df in staged(spark, docs)[:-1]:
        assert df.columns == docs.columns
    assert [df.count() for df in staged(spark, docs.limit(0))] == [0] * 5


def test_repeated_ids_are_rows_of_their_own(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(3, a), (5, a), (5, b), (4, b), (6, a + " more"), (6, ""), (7, b), (None, a)]
    docs = cases.clashing(cases.documents(spark, [(*r, "en", "a") for r in rows]))
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(3, a), (4, b), (6, "")], key=repr)  # the row without an id is a copy of 3
    lone = corpus_pipeline.near_duplicates(spark, cases.documents(spark, [(None, a, "en", "a"), (None, a, "en", "a"), (None, b, "en", "a"), (None, "", "en", "a"), (None, None, "en", "a")]), SF)
    assert sorted(((r.doc_id, r.text) for r in lone.collect()), key=repr) == sorted([(None, a), (None, b), (None, ""), (None, None)], key=repr)
    alone = cases.documents(spark, [(*r, "en", "a") for r in rows[:3]])
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, alone, SF).collect()) == [(3, a), (5, b)]


def test_every_operator_is_registered():
    names = set(entry.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names
    assert set(queries.SQL) <= set(queries.QUERIES) and set(queries.SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", SQL_NAMES)
def test_query_matches_sql(spark, duck, name):
    message, _, ok = check(name, spark, duck, SF, queries.QUERIES, queries.SQL)
    assert ok and message.startswith("ok"), message


@pytest.mark.parametrize("name", ["op2_chat_tree", "op8_site_tree"])
def test_query_columns(spark, name):
    want = {"op2_chat_tree": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"], "op8_site_tree": ["page_id", "url", "text", "n_chars"]}[name]
    df = queries.QUERIES[name](spark, SF)
    assert df.columns[:len(want)] == want and df.count() > 0
