"""Near-duplicate groups against all pairs of full sets."""

import collections
import random

import cases
import numpy as np
import pytest

from quarterhour.llm import near_dedup as nd


def plain_set(text):
    words = (text or "").encode().lower().split()
    return frozenset([tuple(words)]) if 0 < len(words) < 5 else frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def plain_components(rows):
    """Smallest reachable id of each id, from every pair of ids that have a shingle in common."""
    sets = collections.defaultdict(set)
    for doc, text in rows:
        if doc is not None:
            sets[doc].add(plain_set(text))
    nodes = [(d, s) for d, own in sets.items() for s in own]
    holders = collections.defaultdict(list)
    for i, (_, s) in enumerate(nodes):
        for g in s:
            holders[g].append(i)
    common = collections.Counter((i, j) for own in holders.values() for j in own for i in own if i < j)
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for (i, j), n in common.items():
        (a, s), (b, t) = nodes[i], nodes[j]
        if 100 * n >= 85 * (len(s) + len(t) - n):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


def compare(spark, rows, df=None):
    df = spark.createDataFrame(rows, "doc_id long, text string") if df is None else df
    want = plain_components(rows)
    got = nd.components(df).collect()
    assert len(got) == len(rows)
    expected = sorted(((d, len(plain_set(t)), want.get(d), d is None or want[d] == d) for d, t in rows), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == expected
    return want


def test_awkward_rows(spark):
    want = compare(spark, [(r[0], r[1]) for r in cases.ROWS], cases.clashing(cases.documents(spark)))
    assert want[12] == want[3] == want[2] == 1 and want[8] == 7 and want[9] == 9
    assert nd.components(cases.documents(spark).limit(0)).count() == 0


def test_families_and_chains(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    rows, n = [], 0
    for family in range(6):
        base = [rnd.choice(words) for _ in range(150 + 40 * family)]
        rows.append((n := n + 1, " ".join(base)))
        for _ in range(25):  # spokes: near the original, farther from one another
            own = base[:]
            for _ in range(rnd.choice([1, 2, 3, 4])):
                own[rnd.randrange(len(own))] = rnd.choice(words)
            rows.append((n := n + 1, " ".join(own)))
    chain = [rnd.choice(words) for _ in range(200)]
    for _ in range(12):  # each near the one before only
        rows.append((n := n + 1, " ".join(chain)))
        chain = chain[4:] + [rnd.choice(words) for _ in range(4)]
    passage = [rnd.choice(words) for _ in range(60)]
    rows += [(n := n + 1, " ".join([rnd.choice(words) for _ in range(100)] + passage)) for _ in range(30)]  # a common passage is no link
    rnd.shuffle(rows)
    want = compare(spark, rows)
    assert max(collections.Counter(want.values()).values()) > 10


def test_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    compare(spark, rows)


def test_same_id_different_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in nd.components(spark.createDataFrame([(3, a), (3, b), (5, b), (4, a + " more")], "doc_id long, text string")).collect()}
    assert got == {(3, 36, 3), (5, 36, 3), (4, 37, 3)}


def test_an_id_connects_its_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    want = compare(spark, [(3, a), (5, a), (5, b), (4, b), (8, c), (7, c), (8, ""), (9, c + " more"), (9, None)])
    assert want == {3: 3, 4: 3, 5: 3, 7: 7, 8: 7, 9: 7}


def test_blocks_and_hashes(monkeypatch):
    text = " ".join(f"w{i}" for i in range(500)) + " " + "y" * 3000 + " tail end"
    whole = nd.shingles(text)
    monkeypatch.setattr(nd, "BLOCK", 64)
    assert (nd.shingles(text) == whole).all() and len(whole) == len(plain_set(text))


@pytest.mark.parametrize("similarity", [0.85, 0.9, 0.95])
def test_samples_and_sketches_estimate(similarity):
    rng = np.random.default_rng(3)
    agree, odd = [], []
    for _ in range(60):
        n = 2000
        both = round(n * similarity)
        pool = rng.integers(0, 2**63, 2 * n, np.uint64)
        a, b = np.concatenate([pool[:both], pool[both:n - (n - both) // 2]]), np.concatenate([pool[:both], pool[n:n + (n - both) // 2]])
        x, y = nd.samples(a), nd.samples(b)
        agree.append((x == y).mean())
        odd.append(int(np.bitwise_count((nd.odd_sketch(x) ^ nd.odd_sketch(y)).view(np.uint64)).sum()))
    assert abs(np.mean(agree) - similarity) < 0.02
    assert max(odd) <= nd.MOST_ODD
    estimate = 1 + nd.SKETCH_BITS / (4 * nd.SAMPLES) * np.log(1 - 2 * np.array(odd) / nd.SKETCH_BITS)
    assert abs(estimate.mean() - similarity) < 0.02
