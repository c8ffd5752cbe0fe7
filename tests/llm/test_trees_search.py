"""Chat prefix tree, site style tree and Hamming search against plain versions."""

import collections
import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarterhour.llm import chat_tree, hamming_search, site_tree

PIECES = ["###", "####", "</turn>", "\\", "\\\\", ":", "\n", "### user:\n", "\n</turn>\n", "ok", " ", "<", "é\U0001f600"]
HOSTILE = st.lists(st.sampled_from(PIECES), max_size=12).map("".join)


@given(st.lists(st.tuples(HOSTILE, HOSTILE), max_size=5))
@settings(max_examples=400, deadline=None)
def test_format_reads_back(turns):
    written = [chat_tree.format_turn(role, text) for role, text in turns]
    assert chat_tree.read_turns("".join(w[0] for w in written)) == turns
    assert [chat_tree.unescape(w[a:b]) for w, a, b in written] == [text for _, text in turns]


def test_format_rejects_other_text():
    with pytest.raises(ValueError):
        chat_tree.read_turns("### user:\nhi </turn> there")


TURNS = "conv_id long, turn long, role string, text string"


def chats():
    rnd, rows = random.Random(2), []
    first = [("system", "be kind"), ("user", "hello\\ ###")]
    for conv in range(40):
        turns = first[:rnd.randint(1, 2)] + [(rnd.choice(["user", "assistant"]), rnd.choice(PIECES) * rnd.randint(0, 2)) for _ in range(rnd.randint(0, 5))]
        rows += [(conv, i, role, text) for i, (role, text) in enumerate(turns)]
    rows += [(90, 0, None, None), (90, 1, "assistant", None), (None, 0, "user", "a"), (91, None, "assistant", "first"), (91, 0, "assistant", "second"), (92, 0, "user", "x"), (92, 0, "user", "x"), (93, 0, "assistant", "y" * 100_000)]
    rows += [(94, i, "user", f"t{i}") for i in range(300)]
    return rows


def test_tree_and_conversations(spark):
    rows = chats()
    df = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("!") for c in ("node", "leaf", "path", "place", "depth", "t", "own")})
    steps = chat_tree.steps(df)
    nodes = chat_tree.nodes(steps)
    tree = sorted(nodes.collect(), key=lambda n: n.emit_start)
    by_name = {bytes(n.node): n for n in tree}
    stream, at = "".join(n.text for n in tree), 0
    convs = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        convs[r[0]].append((r[2] or "", r[3] or ""))
    assert len(tree) == len({tuple(c[:i + 1]) for c in convs.values() for i in range(len(c))})  # shared turns once
    open_nodes = []
    for n in tree:
        assert n.emit_start == at
        at += n.n_tokens
        parent = bytes(n.parent) if n.parent else None
        while open_nodes and open_nodes[-1] != parent:  # depth first: the parent is among the open ones
            open_nodes.pop()
        assert (parent is None and n.depth == 0) or open_nodes
        open_nodes.append(bytes(n.node))
        chain, m = "", n
        while m is not None:
            chain, m = m.text + chain, by_name.get(bytes(m.parent)) if m.parent else None
        assert "".join(stream[i["from"]:i["to"]] for i in n.attend) == chain and n.position == len(chain) - n.n_tokens
    got = {r.conv_id: r for r in chat_tree.conversations(steps, nodes).collect()}
    assert set(got) == set(convs)
    for conv, turns in convs.items():
        loss = "".join(text for role, text in turns if role == "assistant")
        want = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(chat_tree.format_turn(*t)[0]) for t in turns))
        assert tuple(got[conv])[1:] == want
    empty = chat_tree.steps(df.limit(0))
    assert chat_tree.nodes(empty).count() == 0 and chat_tree.conversations(empty, chat_tree.nodes(empty)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>no";</script></head><body><header>Site</header>
<nav><ul><li><a href=x>Menu</a><li>More</ul></nav><div class="cookie-notice">We use cookies</div><aside>Side</aside><!-- note -->
{body}<section id="comments"><article class="comment"><p>First!</p></article></section><form><label>Mail</label><button>Go</button></form><footer>&copy; host</footer></body></html>"""


@pytest.mark.parametrize("body, want", [
    ("<article><header><h1>Head &amp; line</h1></header><p>One <b>bo</b>ld&nbsp;&lt;x&gt;\n two<br>three<p>four<ul><li>five<li>six</ul><div class='ad-slot'>Buy</div><div class='share-bar'>Share</div><p>seven</article>", "Head & line One bold <x> two three four five six seven"),
    ("<main><p>in main</p><div hidden>not</div></main><p>outside</p>", "in main"),
    ("<div role='main'><p>by role</p></div>", "by role"),
    ("<main><p>teaser</p><article><p>kept</p></article></main>", "kept"),
    ("<div class='content'><p>plain <i>page</i></p><table><tr><td>a<td>b</table></div>", "plain page a b"),
    ("<article><p><b>unclosed<br><p>next", "unclosed next"),
    ("<article></article>", ""),
    ("<article><p>one<span class=hl>wo</span>rd <a href=x class=ref>l</a>ink<span class='ad'>buy</span></article>", "oneword link"),
    ("<div class='layout has-sidebar'><article class=post><p>in layout</p><div class=commentList>no</div><p style='display: none'>no</p></article></div>", "in layout"),
])
def test_declared_parts(body, want):
    page = PAGE.replace("{{}}", "{}").replace("{body}", body) if "unclosed" not in body else body
    assert site_tree.Page(page).main_text(set()) == want


def test_recurring_blocks_of_a_host(spark):
    bar = "<div class=top><p>Call us now</p><p>All rights</p></div>"
    rows = [(i, "http://h.example/x", f"{bar}<div class=body><p>story {i} of its own</p><p>another {i * 7}</p></div><div class=end>Read on</div>") for i in range(40)]
    rows += [(100, "http://h.example/y", "<article><p>Call us now</p></article>" + bar), (101, "https://other.example/", bar), (102, None, "<p>alone</p>"), (103, "no url", ""), (104, "http://h.example/z", None)]
    rows += [(105, "http://H.example:80/q", bar + "<div class=body><p>story 1 of its own</p></div>")] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("!") for c in ("host", "low", "chain", "value", "text", "n")})
    got = collections.defaultdict(list)
    for r in site_tree.main_texts(df).collect():
        got[r.page_id].append(r.text)
    for i in range(40):
        assert got[i] == [f"story {i} of its own another {i * 7}"]
    assert got[100] == ["Call us now"] and got[101] == ["Call us now All rights"] and got[102] == ["alone"]
    assert got[103] == [""] and got[104] == [""] and got[105] == ["story 1 of its own"] * 2
    assert site_tree.main_texts(df.limit(0)).count() == 0


def host_texts(spark, pages):
    rows = [(i, "http://h.example/", page) for i, page in enumerate(pages)]
    return dict(site_tree.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).select("page_id", "text").collect())


def test_important_contents_stay_in_a_page_of_boilerplate(spark):
    menu = "<div class=links><ul>" + "".join(f"<li><a href=x>Link {i}</a></li>" for i in range(20)) + "</ul></div>"
    pages = [f"<html><head><title>T</title></head><body>{menu}<div class=body><p>story {i} of its own</p><p>another {i * 7}</p></div></body></html>" for i in range(40)]
    assert host_texts(spark, pages) == {i: f"story {i} of its own another {i * 7}" for i in range(40)}
    bodies = [f"<div class=body><p>story {i} of its own</p></div><div><p>and {i * 7}</p></div>" for i in range(40)]
    assert host_texts(spark, [PAGE.replace("{{}}", "{}").replace("{body}", b) for b in bodies]) == {i: f"story {i} of its own and {i * 7}" for i in range(40)}


def test_recurring_blocks_of_marked_articles(spark):
    bar = "<div class=teaser><p>Call us now for more of the same</p><p>All rights reserved</p></div>"
    story = [f"<p>story {i}</p><p>and its end {i * 7}</p>" for i in range(40)]
    assert host_texts(spark, [f"<article>{p}{bar}</article>" for p in story]) == {i: f"story {i} and its end {i * 7}" for i in range(40)}
    assert host_texts(spark, [f"<main>{p}<p>Read on</p></main>" for p in story]) == {i: f"story {i} and its end {i * 7}" for i in range(40)}


def test_copies_of_marked_articles_stay(spark):
    parts = [f"part {i} of a story that many pages have" for i in range(6)]
    whole = "".join(f"<p>{p}</p>" for p in parts)
    pages = [f"<div>menu {i}</div><article><h1>Head</h1>{whole}</article>" for i in range(20)]  # exact copies, other surroundings
    pages += [f"<article><h1>Head</h1>{whole}<p>edited {i}</p></article>" for i in range(20)]  # near copies
    pages += [f"<article><h1>Head {i}</h1><p>of its own {i}</p></article>" for i in range(5)]
    got = host_texts(spark, pages)
    assert all(got[i] == " ".join(["Head", *parts]) for i in range(20))
    assert all(got[20 + i] == " ".join(["Head", *parts, f"edited {i}"]) for i in range(20))
    assert all(got[40 + i] == f"Head {i} of its own {i}" for i in range(5))


def test_deep_elements_are_their_own(spark):
    deep = "<div>" * 30
    pages = [f"{deep}<article><div class=links><p>Link one</p><p>Link two</p></div><div class=body><p>story {i}</p></div></article>" for i in range(40)]
    assert host_texts(spark, pages) == {i: f"story {i}" for i in range(40)}  # the links outweigh the story, but have elements of their own
    one, other = (site_tree.Page(f"{deep}<p class={c}>text").blocks[0][0] for c in "ab")
    assert one != other


@pytest.mark.parametrize("n", [2, 3])
def test_hosts_of_few_pages(spark, n):
    pages = [f"<div>Read on</div><div><p>story {i}</p></div>" for i in range(n)]
    assert host_texts(spark, pages) == {i: f"story {i}" for i in range(n)}
    assert host_texts(spark, pages[:1] * n) == {i: "Read on story 0" for i in range(n)}  # copies are one body


def test_importance_is_entropy(spark):
    pages = [("h", f"<div><p>same</p><p>own {i}</p>{'<p>half</p>' if i % 2 else ''}</div>") for i in range(16)]
    contents, _ = site_tree.style_tree(spark.createDataFrame(pages, "host string, html string"))
    found = sorted((r.n, r.k, r.value is None, round(r.importance, 6)) for r in contents.collect())
    assert found == [(1, 16, True, 1.0), (8, 1, False, 0.25), (16, 1, False, 0.0)]


def test_declared_names_and_teasers():
    """A barred word inside another name bars nothing in an article, and a teaser is not the article of its page."""
    text = lambda html: site_tree.Page(html).main_text(set())
    article = '<article><p>Lead</p><section id="related-work"><p>Earlier studies.</p></section><p class="share-price">Up 3 percent.</p>{}</article>'
    assert text(article.format('<div class="share-buttons">Tweet</div><div class="related-articles">More</div><div class="ad slot-2">Buy</div><div class="newsletterSignup">Join</div>')) == "Lead Earlier studies. Up 3 percent."
    assert text('<main><div class="story"><p>The real body text of this page, of some length.</p></div><article class="teaser"><p>Teaser</p></article></main>') == "The real body text of this page, of some length. Teaser"
    assert text("<main><p>Start</p><article><p>A long article that the main part is about.</p></article></main>") == "A long article that the main part is about."
    assert text('<div class="share-price-menu">Menu</div><p>Body</p>') == "Body"


def test_long_page():
    page = "<article>" + "".join(f"<p>para {i}</p>" for i in range(20_000)) + "</article>"
    assert site_tree.Page(page).main_text(set()) == " ".join(f"para {i}" for i in range(20_000))
    assert site_tree.Page("<div>" * 3000 + "deep").main_text(set()) == "deep"


@pytest.mark.parametrize("n, bits, k", [(300, 64, 10), (40, 10, 7), (6, 64, 10), (1, 64, 3)])
def test_nearest(spark, n, bits, k):
    rnd = random.Random(n)
    codes = [rnd.getrandbits(bits) - (1 << 63 if bits == 64 else 0) for _ in range(n)]
    rows = [(i, rnd.choice(codes[: n // 2 + 1])) for i in range(n)] + [(0, codes[0])] * 2 + [(None, 5), (7000, None)]
    df = spark.createDataFrame(rows, "vec_id long, code long")
    got = collections.defaultdict(list)
    for r in hamming_search.nearest(df, df.where("vec_id % 5 = 0"), k).collect():
        got[r.query_id].append((r.rank, r.distance, r.vec_id))
    known = {(i, c) for i, c in rows if i is not None and c is not None}
    for q, code in known:
        if q % 5 == 0 and sum(i == q for i, _ in known) == 1:
            want = sorted(((code ^ c) & (2**64 - 1)).bit_count() * 10**6 + i for i, c in known)[:k]
            assert [d * 10**6 + i for _, d, i in sorted(got[q])] == want
    assert hamming_search.nearest(df.limit(0), df.limit(0), k).count() == 0


def test_hot_segment_value(spark):
    """Most codes agree in the low bits, more than one array holds; ties at the k-th distance go to the smaller ids."""
    rnd = random.Random(8)
    rows = [(i, (rnd.getrandbits(40) << 24) - (1 << 63) if i % 10 else rnd.getrandbits(63)) for i in range(1500)] + [(5000 + i, 7) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, code long")
    arrays = hamming_search.index(df, hamming_search.cuts(1500)).where("seg = 0 and value = 0").select(F.size("codes").alias("n")).collect()
    assert len(arrays) > 2 and max(a.n for a in arrays) < 2 * hamming_search.CHUNK
    got = collections.defaultdict(list)
    for r in hamming_search.nearest(df, df.where("vec_id % 50 = 0"), 10).collect():
        got[r.query_id].append((r.rank, r.distance, r.vec_id))
    codes = dict(rows)
    for q in (i for i, _ in rows if i % 50 == 0):
        want = sorted((((codes[q] ^ c) & (2**64 - 1)).bit_count(), i) for i, c in rows)[:10]
        assert [(d, i) for _, d, i in sorted(got[q])] == want


def test_sign_code(spark):
    rows = [(1, [1.0] * 64), (2, [-1.0] * 63 + [0.5]), (3, [float("nan"), None, 2.0] + [0.0] * 61), (4, [1.0]), (5, None), (6, [1.0] * 65)]
    got = dict(spark.createDataFrame(rows, "i int, v array<float>").select("i", hamming_search.sign_code("v")).collect())
    assert got == {1: -1, 2: -(2**63), 3: 4, 4: None, 5: None, 6: None}
