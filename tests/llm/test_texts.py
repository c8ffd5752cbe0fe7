"""Quality ledger, secret scan, token counts and language identification against plain versions."""

import collections
import hashlib
import math
import random
import re
import string

import cases
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarterhour.llm import language_id, packing, quality_rules, secret_scan, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXT = st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t.,'abcdeABé▁　 ß1239<|>\\#*")), st.characters(exclude_categories=["Cs"])), max_size=60)


def plain_measures(text):
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = collections.Counter(windows)
    covered = {i + d for i, w in enumerate(windows) if often[w] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered)]


@given(st.one_of(TEXT, st.lists(st.sampled_from(["a", "b", "\n", "c d"]), max_size=40).map(" ".join)))
@settings(max_examples=200, deadline=None)
def test_measures(text):
    assert quality_rules.measure_text(text) == plain_measures(text)


def test_ledger_and_policies(spark):
    docs = cases.clashing(cases.documents(spark))
    got = docs.select("doc_id", "text", quality_rules.ledger("text").alias("entry")).select("doc_id", "text", "entry.*").collect()
    assert len(got) == len(cases.ROWS)
    for r in got:
        m = plain_measures(r.text or "")
        assert [r[c] for c in quality_rules.MEASURES] == m
        assert bool(r.bits & quality_rules.BASE) == (m[0] < 50 or 100 * m[5] > 50 * m[0])
    assert docs.limit(0).select(quality_rules.ledger("text")).count() == 0


def test_ablations(spark):
    bits = [0, 1, 1, 3, 2, 8, 9, 16]
    got = {r.rule: r for r in quality_rules.ablations(spark.createDataFrame([(b,) for b in bits], "bits long"), "v2").collect()}
    for name, bit in quality_rules.BIT.items():
        assert got[name].n_failed == sum(bool(b & bit) for b in bits)
        assert got[name].n_only == sum(b == bit for b in bits)
        assert (got[name].n_kept, got[name].n_kept_without) == (bits.count(0), sum(b & ~bit == 0 for b in bits))


def plain_secrets(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return found + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]


@given(st.lists(st.sampled_from(["password", "Token", "api_key", "APIKEY", "=", ": ", '"', "abc", "deadbeef", "AKIA", "Z9" * 8, "0123456789abcdef", " ", "ſecret", "Kelvin", "é", "\n"]), max_size=25).map("".join))
@settings(max_examples=300, deadline=None)
def test_base_secrets(text):
    found, base, _ = secret_scan.scan(text)
    assert [x for x in found if x[1] < 3] == sorted(plain_secrets(text)) and base == len(plain_secrets(text))
    assert not any(a < e and s < b for s, k, e in found if k == 3 for a, _, b in plain_secrets(text))


@given(st.text(alphabet="abcXYZ019+/", min_size=20, max_size=60))
@settings(max_examples=100, deadline=None)
def test_window_entropy(text):
    def entropy(w):
        return -sum(c / len(w) * math.log2(c / len(w)) for c in collections.Counter(w).values())
    assert secret_scan.window_entropy(text) == pytest.approx(max(entropy(text[i:i + 20]) for i in range(len(text) - 19)))


def test_entropy_spans_and_allow_list():
    key = "ghp_x7Kq2LmZ9vTb4RwY8nPc3HsD6fGj1"
    assert secret_scan.joined(secret_scan.scan(f"use {key} now")[0]) == f"entropy:4:{4 + len(key)}"
    for harmless in ("123e4567-E89B-12d3-a456-426614174000", "internationalisation", "2024-01-31/2024-02-29", "aBc1" * 9, "docs/guide/chapter-12/section-3"):
        assert not [x for x in secret_scan.scan(harmless)[0] if x[1] == 3], harmless
    text = f"a {key} b"
    assert secret_scan.redact_text(text, secret_scan.scan(text)[0]) == "a [secret] b"


def _planted(rnd):
    """Strings drawn as key generators draw them."""
    alphabets = {"base62": string.ascii_letters + string.digits, "base64": string.ascii_letters + string.digits + "+/", "url": string.ascii_letters + string.digits + "-_", "base36": string.ascii_lowercase + string.digits, "capitals": string.ascii_uppercase + string.digits}
    return [(name, "".join(rnd.choices(chars, k=rnd.choice([24, 32, 40, 64])))) for name, chars in alphabets.items() for _ in range(200)]


def _clean(rnd):
    """Paths, addresses, slugs, names and versions made of words and small numbers."""
    words = "alpha home user data project story index report value season market river window handler request string update config module number title image server branch filter table string".split()
    w = lambda: rnd.choice(words)
    n = lambda: str(rnd.randint(0, 2030)) if rnd.random() < 0.4 else ""
    forms = [lambda: "/" + "/".join(w() + n() for _ in range(5)), lambda: "https://example.com/a/" + "-".join(w() for _ in range(5)) + f"-{rnd.randint(1990, 2030)}-here", lambda: "".join(w().title() for _ in range(5)),
             lambda: w() + "".join(w().title() for _ in range(4)) + n(), lambda: "_".join(w().upper() + n() for _ in range(4)), lambda: "-".join(w() + n() for _ in range(6)), lambda: f"2024-05-{rnd.randint(1, 28)}/img_00{rnd.randint(1, 99)}_{w()}_{w()}",
             lambda: f"{w()}{rnd.randint(1, 9)}{w()}{rnd.randint(1, 9)}{w()}{w()}{w()}"]
    return [form() for form in forms for _ in range(120)]


def test_entropy_recall_and_precision():
    rnd = random.Random(12)
    found = collections.Counter(name for name, key in _planted(rnd) if any(k == 3 and e - s >= 20 for s, k, e in secret_scan.scan(f"use {key} now")[0]) or secret_scan.scan(key)[1])
    assert all(found[name] >= 0.95 * 200 for name in ("base62", "base64", "url", "capitals")) and found["base36"] >= 0.9 * 200, found
    alarms = [c for c in _clean(rnd) if any(k == 3 for _, k, _ in secret_scan.scan(f"see {c} there")[0])]
    assert len(alarms) <= 2, alarms
    for harmless in ("/home/user1/data2/projectx9/alpha7betagammadelta", "https://example.com/a/b2c3d4-some-long-slug-title-2024-here", "getHttpConnectionStringFromHandler", "README-for-version-10-2-and-11-4"):
        assert not secret_scan.scan(harmless)[0], harmless
    assert secret_scan.joined(secret_scan.scan("x QmXrTzLpWvKsJhGfDbNc y")[0]) == "entropy:2:22"


def test_what_base_spans_leave_is_scanned():
    key, secret = "AKIA" + "ABCDEFGH23456789", "kQ7fZ2pXw9LmT4/vRb8YcN3sHd6JgU1aEoViWx5B"
    text = f"{key}/{secret} and more"
    assert secret_scan.joined(secret_scan.scan(text)[0]) == f"access:0:20,entropy:20:{21 + len(secret)}"
    assert secret_scan.redact_text(text, secret_scan.scan(text)[0]) == "[secret][secret] and more"
    both = f"{secret}/{key}/home/user/data"
    assert [k for _, k, _ in secret_scan.scan(both)[0]] == [3, 1]
    assert secret_scan.scan("a long word list without anything")[2] is None and secret_scan.scan(key)[2] > 3


def test_secret_query_columns(spark):
    docs = cases.clashing(cases.documents(spark))
    for r in docs.select("text", secret_scan.secrets("text").alias("found"), secret_scan.redacted("text").alias("clean")).collect():
        base = sorted(plain_secrets(r.text or ""))
        assert (r.found.n_assign, r.found.n_access, r.found.n_hex) == tuple(sum(k == i for _, k, _ in base) for i in range(3))
        assert r.found.base_sha256 == hashlib.sha256(secret_scan.joined(base).encode()).hexdigest()
        assert "password=" not in r.clean


def test_batches_are_even_in_bytes():
    cut = list(token_counts.batches(iter(["a" * 300, "\u6f22" * 100, "b", "\u6f22" * 400, "", "c"]), 600))
    assert [len(b) for b in cut] == [2, 2, 2] and [t for b in cut for t in b][1] == "\u6f22" * 100


MODEL = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.MODEL))


@given(st.lists(TEXT, max_size=4))
@settings(max_examples=300, deadline=None)
def test_piece_counts_equal_whole_texts(texts):
    assert token_counts.count_tokens(texts, public_tokenizers.path(token_counts.MODEL)) == [len(MODEL.encode(t)) for t in texts]


def test_token_counts(spark):
    docs = cases.clashing(cases.documents(spark))
    for r in docs.select("text", token_counts.token_counts("text").alias("c")).collect():
        n = len(MODEL.encode(r.text or ""))
        assert tuple(r.c) == (len((r.text or "").encode()), n, n > 4096)


def test_small_tables_of_parts(monkeypatch):
    monkeypatch.setattr(token_counts, "KEPT_PARTS", 3)
    monkeypatch.setattr(packing, "KEPT_PARTS", 3)
    texts = ["one two three four five six", "six five four " * 50, "y" * 200 + " z"]
    assert token_counts.count_tokens(texts, public_tokenizers.path(token_counts.MODEL)) == [len(MODEL.encode(t)) for t in texts]
    assert [b for b in token_counts.batches(iter(texts), 30)] == [texts[:2], texts[2:]]


@given(TEXT)
@settings(max_examples=200, deadline=None)
def test_chunks_keep_all_grams(text):
    import numpy as np
    whole = collections.Counter(language_id.grams(text).tolist())
    old, language_id.CHUNK = language_id.CHUNK, 5
    try:
        keys, n = language_id.counted(text)
    finally:
        language_id.CHUNK = old
    assert dict(zip(keys.tolist(), n.tolist(), strict=True)) == dict(whole) and isinstance(keys, np.ndarray)


def plain_profile(texts, length):
    n = collections.Counter()
    for text in texts:
        for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
            padded = f" {word} "
            n.update(word)
            n.update(padded[i:i + 2] for i in range(len(padded) - 1))
            n.update(padded[i:i + 3] for i in range(len(padded) - 2))
    pack = lambda g: sum((1 if c == " " else ord(c) + 2) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    return [g for g, _ in sorted(((pack(g), k) for g, k in n.items()), key=lambda x: (-x[1], x[0]))[:length]]


def test_language_profiles_and_distances(spark):
    texts = {"aa": ["banana apple", "Apple pie and bananas"], "bb": ["zug und der Weg", "über den Zug"]}
    rows = [(i, t, lang) for lang, own in texts.items() for i, t in enumerate(own)] + [(9, None, "aa"), (10, "no label", None)]
    profiles = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), length=30)
    assert profiles == [(lang, plain_profile(own, 30)) for lang, own in texts.items()]
    probes = ["banana", "der zug", "", None, "123 !", "ZUG", "pie " * 1000]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(probes)], "i int, text string").select("i", language_id.predicted("text", profiles, 30).alias("r")).collect()
    for r in got:
        own = plain_profile([probes[r.i] or ""], 30)
        if not own:
            assert tuple(r.r) == ("und", 0.0)
            continue
        out = [sum(abs(p.index(g) - i) if g in p else 30 for i, g in enumerate(own)) for _, p in profiles]
        assert r.r.lang_pred == profiles[out.index(min(out))][0] and r.r.score == pytest.approx(1 - min(out) / (30 * len(own)))
    assert language_id.learn(spark.createDataFrame([], "text string, lang string")) == []
    assert language_id.Judge([], 30)("text") == ("und", 0.0)


def test_held_out_accuracy(spark):
    from quarterhour.llm import queries
    sf = "/root/testdata/sf0.01"
    got = queries.op3_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    right, n = got.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right / n > 0.98
