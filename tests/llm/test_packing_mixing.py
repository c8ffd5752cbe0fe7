"""Packing and mixing against plain versions."""

import collections
import random
import zlib

import cases
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarterhour.llm import mixing, packing

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
TEXT = st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t.,'adstABé　  ß1239<|>")), st.characters(max_codepoint=0x2FFF, exclude_categories=["Cn", "Cs"])), max_size=50)


def ids(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1]


@given(st.one_of(TEXT, st.lists(st.sampled_from([" ", "\n", "a", "b'll", "<|endoftext|>", "<|", "99", "\t", "é"]), max_size=20).map("".join)))
@settings(max_examples=400, deadline=None)
def test_ids_equal_the_tokenizer(text):
    parts = packing._parts(public_tokenizers.path(packing.RANKS))
    assert np.frombuffer(packing.token_bytes(text, parts), np.uint32).tolist() == ids(text)[:-1]


@given(st.lists(st.integers(1, 50), max_size=80))
@settings(max_examples=200, deadline=None)
def test_first_fit_decreasing(lengths):
    number, offset = packing.first_fit_decreasing(lengths, 50)
    rooms, want = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        j = next((j for j, room in enumerate(rooms) if room >= lengths[i]), len(rooms))
        if j == len(rooms):
            rooms.append(50)
        want[i] = (j, 50 - rooms[j])
        rooms[j] -= lengths[i]
    assert {i: (n, o) for i, (n, o) in enumerate(zip(number, offset, strict=True))} == want


def check_packed(got, docs, length):
    """Every id in one piece, sequences gapless and not too long, padding as said."""
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    want = collections.Counter()
    for doc, text in docs:
        own = ids(text)
        for at in range(0, len(own), length):
            cut = own[at:at + length]
            want[doc, at, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes()), len(own)] += 1
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]]
        total = sum(r.length for r in own)
        assert total <= length and {r.padding for r in own} == {0 if total & (total - 1) == 0 else length - total}
    return sum(own[0].padding for own in sequences.values()) / max(1, sum(r.length for r in got))


def test_packed_awkward_rows(spark):
    docs = cases.clashing(cases.documents(spark))
    check_packed(packing.packed(docs, length=256).collect(), [(r[0], r[1]) for r in cases.ROWS], 256)
    assert packing.packed(docs.limit(0)).count() == 0


def test_packed_groups_and_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = packing.packed(docs, per_group=50).collect()
    check_packed(got, rows, 2048)
    assert len({r.sequence_id >> 32 for r in got}) > 2
    assert check_packed(packing.packed(docs).collect(), rows, 2048) < 0.05
    alike = spark.createDataFrame([(1, "same")] * 300, "doc_id long, text string").repartition(4)
    assert len({r.sequence_id >> 32 for r in packing.packed(alike, per_group=20).collect()}) > 5  # a repeated row is no hot group


def plain_targets(sizes, weights, cap):
    """Share by weight; what is above a cap is shared again, until nothing is."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        weights_left = sum(weight[s] for s in names if s not in full)
        share = {s: cap * sizes[s] if s in full else rest * weight[s] / weights_left for s in names}
        above = {s for s in names if s not in full and share[s] >= cap * sizes[s]}
        if not above:
            return share
        full |= above
        if len(full) == len(names):
            return {s: cap * sizes[s] for s in names}


@pytest.mark.parametrize("seed", range(6))
def test_targets(spark, seed):
    rnd = random.Random(seed)
    sizes = {s: rnd.choice([0, 1, 10, 500, 10_000]) * rnd.randint(1, 9) for s in [None, *(f"s{i}" for i in range(rnd.randint(1, 9)))]}
    got = {r.mix_source: r for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "mix_source string, source_size long")).collect()}
    for source, want in plain_targets(sizes, mixing.WEIGHTS, mixing.CAP).items():
        assert got[source].target == pytest.approx(want, abs=1e-6), (source, sizes)


def check_mix(got):
    by_source = collections.defaultdict(list)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.full_epochs * r.size + r.last_words
        by_source[r.source].append(r)
    want = plain_targets({s: sum(r.size for r in own) for s, own in by_source.items()}, mixing.WEIGHTS, mixing.CAP)
    for source, own in by_source.items():
        assert {r.source_size for r in own} == {sum(r.size for r in own)}
        assert own[0].target == pytest.approx(want[source]) and abs(sum(r.taken for r in own) - want[source]) <= 1


def mix_with_source(docs):
    return mixing.mix(docs).join(docs.select("doc_id", "source").distinct(), "doc_id")


def test_mix(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check_mix(mix_with_source(docs).collect())
    once, again = (cases.rows(mixing.mix(d), "doc_id", "taken") for d in (docs, docs.repartition(7)))
    assert once == again


def test_mix_awkward_rows(spark):
    docs = cases.clashing(cases.documents(spark))
    got = mixing.mix(docs)
    assert got.count() == len(cases.ROWS)
    sizes = {r.doc_id: r.size for r in got.collect()}
    assert (sizes[4], sizes[5], sizes[6], sizes[7], sizes[10]) == (0, 0, 0, 2, 60_000)
    check_mix(mix_with_source(docs.where("doc_id is not null")).collect())
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0
    assert {r.target for r in mixing.mix(docs.where("doc_id in (4, 5)")).collect()} == {0.0}


def test_mixed_repeats_whole_rows(spark):
    docs = cases.clashing(cases.documents(spark))
    got = mixing.mixed(docs)
    assert got.columns == docs.columns
    plan = collections.Counter()
    for r in mixing.mix(docs).collect():
        plan[r.doc_id] += r.full_epochs + (r.last_words > 0 and 2 * r.last_words >= r.size)
    assert collections.Counter(r.doc_id for r in got.collect()) == +plan
    texts = {r[0]: r[1] for r in cases.ROWS if r[0] is not None}
    assert all(r.text == texts[r.doc_id] for r in got.where("doc_id is not null").collect())
