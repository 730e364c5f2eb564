"""The training-data operators against SQL, brute force, the tokenizers library and held-out labels, and on odd rows."""

import hashlib
import math
import random
import re
import sys
import unicodedata
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from territory.llm import bpe, html, language, minhash, mtree, quality, substrings, suffixlm, tiling, toxicity
from territory.llm.base import Words
from territory.llm.components import connected_components
from territory.llm.base import Scratch
from territory.llm.queries import oracle_sql, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `from` string, score string, id string, key string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", None, "f", "s", "i", "k") for i, t in rows], SCHEMA)


def invented(seed=1, n=40):
    """Documents with copies, near copies, shared passages, long and odd texts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6))) for _ in range(200)]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage, texts = text(70), [text(rng.randint(1, 150)) for _ in range(n)]
    for i in range(0, n, 4):
        texts.append(texts[i])
        words = texts[i].split()
        words[len(words) // 2] = "CHANGED"
        texts.append(" ".join(words))
        texts.append(text(20) + "\n" + passage + " " + text(9))
    texts += ["", " \t\n", "one", "One two", "one two", "x " * 3000, text(4000)]
    return list(enumerate(texts))


ODD = [(None, "a null id with some words in it"), (7, None), (8, ""), (9, " \n"), (10, "one two three four five six"), (10, "one two three four five six"), (11, "w " * 50_000), (12, "ONE two three four five six")]


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows_as_sql(spark, duck, tables, same, name):
    same(queries()[name](spark, tables).toPandas(), duck.execute(oracle_sql()[name]).df())


# 1


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def test_minhash_is_brute_force(spark):
    rows = invented()
    rng = random.Random(8)
    words = " ".join(f"v{rng.randint(0, 10**6)}" for _ in range(400)).split()
    for k in range(25):  # texts at 0.75 to 0.8 of another, each changed in other places
        changed = words.copy()
        for at in rng.sample(range(5, 395), rng.randint(9, 12)):
            changed[at] = f"new{k}-{at}"
        rows.append((1000 + k, " ".join(changed)))
    rows.append((2000, " ".join(words)))
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert sum(len(sets[a] & sets[b]) / len(sets[a] | sets[b]) < 0.8 for a, b in links) > 10
    up, changed = {i: i for i, _ in rows}, True
    while changed:
        changed = False
        for a, b in links:
            least = min(up[a], up[b])
            changed |= up[a] != least or up[b] != least
            up[a] = up[b] = least
    for hubs in (5, 0):  # with hubs, and with blocks alone
        minhash.HUBS = hubs
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, rows)).collect()}
        minhash.HUBS = 5
        assert got == {i: (len(sets[i]), up[i], up[i] == i) for i, _ in rows}


def test_minhash_keeps_texts_of_a_repeated_id_apart(spark):
    one, other = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(1, one), (2, one + " end"), (2, other), (3, other), (3, other), (4, other.replace("b20", "x"))]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, rows)).collect())
    assert got == [(1, 1, True), (2, 1, False), (2, 2, True), (3, 2, False), (3, 2, False), (4, 2, False)]


def test_minhash_on_odd_rows(spark):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, ODD)).collect())
    assert got == [(-1, 4, None, True), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True), (10, 2, 10, True), (10, 2, 10, True), (11, 1, 11, True), (12, 2, 10, False)]
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


def test_blocks_find_what_hubs_miss():
    sets = [np.arange(i * 10, i * 10 + 100, dtype=np.uint64) for i in range(3)]
    assert minhash.linked(sets[0], sets[1]) and not minhash.linked(sets[0], sets[2])
    minima = np.stack([minhash.minima(s) for s in sets])
    keys = minhash.band_keys(minima)
    shared = next(k for k in keys[0] if k in keys[1])
    run = pa.table({"key": [shared] * 2, "x": [0, 0], "y": [0, 0], "block": [0, 0], "id": [1, 2], "component": [1, 2], "keys": [k.tobytes() for k in keys[:2]], "minima": [m.astype(np.uint16).tobytes() for m in minima[:2]]})
    first = shared == keys[0][(keys[0] == keys[1]).argmax()]
    assert bool(list(minhash._near_in_bucket(run))) == first


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 101), (102, None)]
    got = {(r.node, r.component) for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    assert got == {(i, 0) for i in range(31)} | {(100, 100), (101, 100)}


# 2

PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{{}}</style></head><body class="has-sidebar"><nav><a>menu</a></nav><div class="ad">buy</div>
<div class="promo-line">Always here</div><div class="body-text"><p>Our motto is the same everywhere.<p>{0} &amp; more<br>of <b>t</b>his &eacute;<p>Second {0}</div>
<div id="comments"><p>first!</p></div><aside>side</aside><script>var x="</p>";</script><form>q</form><footer>&copy; me</footer></body></html>"""

SHAPES = [
    ("", ""),
    ("plain &lt; text", "plain < text"),
    ("<p>cut off <b", "cut off"),
    ("<p>cut off <a title='never ends>x", "cut off"),
    ("<article><script>never ends", ""),
    ("<div>" * 5000 + "deep" + "</div>" * 5000, "deep"),
    ("<article><p class=x'>Don't stop</p><p>can't</p></article>", "Don't stop can't"),
    ("<a title=it's href=x>Link</a>", "Link"),
    ("<p title='a > b'>x</p><p data-x=\"<b>\">y</p>", "x y"),
    ("<p>a<br/>b</p><p>c < d & e</p>", "a b c < d & e"),
    ("<div/>x<p/>y", "x y"),
    ("<!-- a > b --><p>k</p><!doctype html>", "k"),
    ("<!--><p>short comment</p>", "short comment"),
    ("<p>x</p></ foo><p>y", "x y"),
    ("<p a=1 a=2 =x>z", "z"),
    ("<p>&#72;&#x69; &nbsp;&hellip;&amp;lt;</p>", "Hi …&lt;"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a b c d"),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "1 2 3"),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t d u e"),
    ("<p>one<p>two<div>three</div>four", "one two three four"),
    ("<b>bo<i>th</b>x</i>", "bothx"),
    ("<article><p>a</p><article class='comment'><p>c</p></article></article>", "a"),
    ("<article><div class=c-responses><p>x</p></div><p>t</p></article>", "t"),
    ("<article><div class=side-by-side><p>s</p></div><div class='alert-free post-meta-content'><p>u</p></div></article>", "s u"),
    ("<article><div class=notice>n</div><p>t<div class='post-tags'>x</div></article>", "t"),
    ("<body class='no-sidebar has-comments'><div class=with-nav><p>t</p></div></body>", "t"),
    ("<main><p>t</p><form><p>f</p></form><button>b</button></main><p>out</p>", "t"),
    ("<div role=navigation>m</div><div role=Banner>h</div><div hidden>x</div><div style='display: none'>y</div><div aria-hidden=true>z</div><p>t", "t"),
    ("<svg><text>s</text></svg><noscript>n</noscript><template><p>t</p></template><iframe>f</iframe><textarea>a</textarea><p>k", "k"),
    ("<blockquote>q<cite>c</cite></blockquote><pre>a\n  b</pre><h2>h</h2>", "qc a b h"),
    ("<body><nav>x</nav><article><header><p>by me</p><h1>T&amp;t</h1></header><p>a <i>b</i>c\n d</p><ul><li>e<li>f</ul><p>g<aside>no</aside><section class=comments>no</section></article><p>out", "T&t a bc d e f g"),
    ("<ARTICLE><P>Up</P></ARTICLE><FOOTER>f</FOOTER>", "Up"),
    ("<article>one</article><div>between</div><article>two</article>", "one two"),
    ("a<![CDATA[b]]>c<?php x ?>d", "acd"),
]


@pytest.mark.parametrize("page,text", SHAPES)
def test_main_text(page, text):
    assert html.extract(page) == text


def test_wrapper_drops_what_a_host_repeats(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.format(f"story {i}"), "x", "y") for i in range(8)] + [(8, None, None, "x", "y"), (9, "odd", PAGE.format("alone"), "x", "y"), (9, "odd", PAGE.format("alone"), "x", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in html.main_text(df).collect()}
    assert got[3] == ("story 3 & more of this é Second story 3", 39)
    assert got[8] == ("", 0) and got[9][0].startswith("Our motto is the same everywhere. alone")
    assert html.main_text(df).count() == 11 and html.main_text(df.limit(0)).count() == 0


def test_wrapper_needs_no_names(spark):
    """Pages whose elements are all div: where the article is follows from what the host's pages have in their slots."""
    rng = random.Random(7)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))
    rows, want = [], {}
    for i in range(60):
        title, paragraphs = text(5), [text(rng.randint(20, 60)) for _ in range(rng.randint(2, 6))]
        links = "".join(f"<div><a href='/{k}'>{text(2)}</a></div>" for k in range(6))
        body = f"<div><div>{links}</div></div><div>{text(6)}</div><div><h1>{title}</h1>{''.join(f'<p>{p}</p>' for p in paragraphs)}<div>Read this aloud.</div></div><div>&copy; {text(5)}</div>"
        if i % 3 == 0:  # another layout of the same host
            body = f"<div><div>{links}</div></div><div><div><h1>{title}</h1>{''.join(f'<p>{p}</p>' for p in paragraphs)}</div><table><tr><td>{text(4)}</table></div>"
        rows.append((i, f"https://h.example/{i}", f"<html><body>{body}</body></html>"))
        want[i] = " ".join([title, *paragraphs])
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


@pytest.mark.parametrize("name,is_text", [
    ("related-work", True), ("market-share", True), ("immune-response", True), ("social-policy", True), ("notice-period", True), ("consent_forms-history", True), ("navy-blue", True), ("recommended-dose", True),
    ("related", False), ("related-posts", False), ("share-buttons", False), ("social_links-2", False), ("c-responses", False), ("cookie-notice", False), ("site-nav", False), ("ad-slot", False), ("main related-box", False), ("share-menu", False),
])
def test_doubtful_class_words_count_beside_parts_of_a_page(spark, name, is_text):
    body = f"<article><h1>T</h1><p>start</p><section class='{name}'><p>inner</p></section></article>"
    assert html.extract(body) == ("T start inner" if is_text else "T start")


def test_articles_of_a_host_with_misleading_classes(spark):
    """Most of the article lies in sections whose classes sound like something else."""
    names = ["related-work", "market-share", "immune-response", "social-policy"]
    rng = random.Random(9)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))
    rows, want = [], {}
    for i in range(160):
        title, first, rest = text(4), text(12), [text(40) for _ in range(3)]
        links = "".join(f"<li><a href='/{k}'>{text(2)}</a>" for k in range(5))
        body = f"<nav><ul>{links}</ul></nav><article><h1>{title}</h1><p>{first}</p><section class='{names[i % 4]}'>{''.join(f'<p>{p}</p>' for p in rest)}</section><div class='related-posts'><ul>{links}</ul></div></article>"
        rows.append((i, f"https://h{i % 4}.example/{i}", f"<html><body>{body}</body></html>"))
        want[i] = " ".join([title, first, *rest])
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def slow_matching(a, b):
    """Simple tree matching by its recurrence, over runs."""

    def children(run):
        own = [r for node in run for r in html._elements(node)]
        return html._merged(own) if len(a) > 1 or len(b) > 1 else own

    x, y = children(a), children(b)

    def best(i, j):
        if not i or not j:
            return 0
        found = max(best(i - 1, j), best(i, j - 1))
        return max(found, best(i - 1, j - 1) + slow_matching(x[i - 1][1], y[j - 1][1])) if x[i - 1][0] == y[j - 1][0] else found

    return 1 + best(len(x), len(y))


TREES = st.recursive(st.sampled_from(["<p>x</p>", "<h1>y</h1>", "<table><tr><td>z</table>"]), lambda t: st.lists(t, max_size=4).map(lambda c: f"<div>{''.join(c)}</div>"), max_leaves=12)


@settings(max_examples=80, deadline=None)
@given(TREES, TREES)
def test_tree_matching(a, b):
    x, y = html.parse(a), html.parse(b)
    pairs = []
    assert html.match([x], [y], pairs) == slow_matching([x], [y]) == 1 + len(pairs)
    assert html.match([x], [y], left_pairs=[0]) <= 1 + len(pairs)  # the first that fits
    assert [(n.tag, t) for _, n, t in html.slots(x, x)] == [(n.tag, t) for _, n, t in html.slots(html.parse(a), x)]


# 3 and 7


def auc(score, y):
    pairs = [(s, v) for s, v in zip(score, y, strict=True)]
    good, bad = [s for s, v in pairs if v], [s for s, v in pairs if not v]
    return sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))


@pytest.mark.parametrize("name,label,least", [("op3_toxicity", "toxic", 0.9), ("op7_quality", "quality", 0.9)])
def test_held_out_labels(spark, duck, name, label, least):
    tables = "/root/testdata/sf0.01"
    got = queries()[name](spark, tables).toPandas()
    assert len(got) == 1000 and got["score"].between(0, 1).all()
    assert (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    y = spark.read.parquet(f"{tables}/labels.parquet").toPandas()
    held = got[got["held_out"]].merge(y, on="doc_id")
    assert auc(held["score"], held[label]) >= least


def test_nearest_examples_are_brute_force():
    rng = np.random.default_rng(2)
    vectors = rng.random((500, 30)) * (rng.random((500, 30)) < 0.2)
    vectors[:, 0] += 0.01
    vectors[::7] = vectors[1]  # ties
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    row, term = np.nonzero(vectors)
    index = toxicity.Examples(np.arange(500), np.zeros(500), row, term, vectors[row, term], 30)
    for q in vectors[:60]:
        terms = np.flatnonzero(q)
        rows, cosines = index.nearest(terms, q[terms])
        want = np.lexsort((np.arange(500), -np.round(vectors @ q, 12)))[: toxicity.NEAREST]
        assert np.allclose((vectors @ q)[want], cosines) and np.allclose(vectors[rows] @ q, cosines)


def slow_toxicity(rows, labels, early):
    """Scores by the definition; rows of (id, text), labels by id, and which labelled rows don't fit the curve."""

    def terms(text):
        words = [w for w in re.split("[^a-z0-9\x80-\uffff]+", "".join(c.lower() if c.isascii() else c for c in text)) if w]
        return Counter([(0, w.encode()) for w in words] + [(k, w.encode()[:k]) for w in words for k in toxicity.STEMS if len(w.encode()) > k])

    bags = {i: terms(t) for i, t in rows}
    known = {i: y for i, y in labels.items() if zlib.crc32(str(i).encode()) % 4 != 2}
    everywhere = Counter(t for b in bags.values() for t in b)

    def fitted(ids):
        n, positive = len(ids), sum(known[i] for i in ids)
        d, a = Counter(t for i in ids for t in bags[i]), Counter(t for i in ids for t in bags[i] if known[i])
        part = lambda x, m, share: x * math.log(x / (m * share)) if x else 0.0
        w = {t: max(2 * (part(a[t], m, positive / n) + part(m - a[t], m, 1 - positive / n)), 0) for t, m in d.items() if m >= 2}
        w = {t: x * math.log(1 + len(rows) / everywhere[t]) for t, x in w.items() if x >= toxicity.LEAST_INFORMATION}

        def vector(bag):
            v = {t: (1 + math.log(c)) * w[t] for t, c in bag.items() if w.get(t, 0) > 0}
            norm = math.sqrt(sum(x * x for x in v.values()))
            return {t: x / norm for t, x in v.items()}

        examples = [(i, vector(bags[i])) for i in ids]

        def votes(bag):
            v = vector(bag)
            near = sorted(((sum(x * e.get(t, 0) for t, x in v.items()), i) for i, e in examples), key=lambda c: -c[0])[: toxicity.NEAREST]
            total = sum(c * c for c, _ in near)
            return (sum(c * c * known[i] for c, i in near) + toxicity.PRIOR * positive / n) / (total + toxicity.PRIOR) if total else positive / n, total

        return votes

    before, after = fitted([i for i in known if early[i]]), fitted(list(known))
    late = np.array([(*before(bags[i]), known[i]) for i in known if not early[i]])
    curve = toxicity.logistic(toxicity.curve_inputs(late[:, 0], late[:, 1]), late[:, 2])
    share, total = np.array([after(bags[i]) for i, _ in rows]).T
    return dict(zip([i for i, _ in rows], 1 / (1 + np.exp(-toxicity.curve_inputs(share, total) @ curve)), strict=True))


def test_toxicity_is_brute_force(spark):
    from pyspark.sql import functions as F

    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows, labels = [], {}
    for i in range(240):
        bad = i % 5 == 0
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 40))] + ([rng.choice(["Vile", "horrid", "nasty", "horridly"]) for _ in range(4)] if bad else [])
        rows.append((i, " ".join(words) + rng.choice(["", "!", " - x1"])))
        if i % 7:
            labels[i] = int(bad ^ (rng.random() < 0.05))
    df = frame(spark, rows)
    early = {r.doc_id: r.e for r in df.select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit("curve")), F.lit(toxicity.CURVE_PARTS)) > 0).alias("e")).collect()}
    got = {r.doc_id: r.score for r in toxicity.classify(df, spark.createDataFrame([(i, 0, y) for i, y in labels.items()], "doc_id long, quality int, toxic int")).collect()}
    want = slow_toxicity(rows, labels, early)
    assert all(abs(got[i] - want[i]) < 1e-6 for i in want), [(i, got[i], want[i]) for i in want if abs(got[i] - want[i]) >= 1e-6][:5]


def test_trees_learn_a_rule():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = quality.Trees.fit(x[:2000], y[:2000])
    assert ((model.scores(x[2000:]) > 0.5) == y[2000:]).mean() > 0.97
    assert np.allclose(quality.Trees.fit(x[:0], y[:0]).scores(x[:2]), 1e-6)


@pytest.mark.parametrize("classify,label", [(toxicity.classify, "toxic"), (quality.classify, "quality")])
def test_classifiers_on_odd_rows(spark, classify, label):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int, text string")
    got = classify(frame(spark, ODD), none)
    assert got.count() == len(ODD) and got.where("score < 0 or score > 1 or score is null").count() == 0
    some = spark.createDataFrame([(8, 1, 1, "x"), (10, 0, 0, "x"), (10, 1, 1, "x"), (None, 1, 1, "x"), (11, None, None, "x")], none.schema)
    assert classify(frame(spark, ODD), some).count() == len(ODD)
    assert classify(frame(spark, []), some).count() == 0


# 4


def test_mtree_is_brute_force(spark):
    rng = np.random.default_rng(4)
    vectors = [list(map(float, v)) for v in np.round(rng.normal(size=(300, 5)), 1)]
    rows = [(i, v, "x") for i, v in enumerate(vectors)] + [(300, None, "x"), (350, [1.0, None], "x"), (400, [float("nan")] * 5, "x"), (450, [0.5], "x"), (500, [], "x"), (50, vectors[50], "x"), (None, vectors[0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    whole = [(i, np.floor(256 * np.float32(v + [0.0] * (5 - len(v))).astype(float)).astype(int)) for i, v, _ in rows if i is not None and v is not None and not any(x is None or x != x for x in v)]
    want = set()
    for q, v in whole:
        if q % 50 == 0:
            best = sorted((-int(v @ u), i) for i, u in whole if i != q)[:5]
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    from pyspark.sql import functions as F

    assert {tuple(r) for r in mtree.topk(df, F.col("vec_id") % 50 == 0).collect()} == want
    assert mtree.topk(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_rings_are_copied_only_where_queries_are(spark, monkeypatch):
    """100,000 vectors in clusters: exact, and what is dealt to tasks is below two copies of each."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 8)) * 3
    vectors = centres[rng.integers(0, 40, 100_000)] + rng.normal(size=(100_000, 8)) * 0.05
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 800_001, 8, dtype=np.int32)), pa.array(vectors.astype(np.float32).ravel()))
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(100_000), "embedding": lists}))
    written, write = [], Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, frame, name: written.append((name, write(self, frame, name))) or written[-1][1])
    got = mtree.topk(df, F.col("vec_id") % 1000 == 0).toPandas()
    rings = next(f for name, f in written if name == "ringed").groupBy("route", "ring").count()
    copies = sum(f.join(rings, ["route", "ring"]).agg(F.sum(F.col("chunks") * F.col("count"))).first()[0] for name, f in written if name == "chunks")
    assert copies < 200_000 and rings.count() > 40
    whole = np.floor(256 * vectors.astype(np.float32).astype(np.float64)).astype(np.int64)
    for q in range(0, 100_000, 10_000):
        scores = whole @ whole[q]
        scores[q] = -(10**15)
        want = np.lexsort((np.arange(100_000), -scores))[:5]
        own = got[got["query_id"] == q].sort_values("rank")
        assert own["vec_id"].tolist() == want.tolist() and own["score"].tolist() == scores[want].tolist()


def test_tree_prunes_and_stays_exact():
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.normal(c, 0.1, (2000, 8)) for c in range(5)])
    tree, looked = mtree.MTree(points), []
    query, best = points[3], []

    def offer(page, near):
        looked.extend(page["rows"][near].tolist())
        best[:] = sorted([*best, *mtree.distances(points[page["rows"][near]], query).tolist()])[:5]

    tree.search(query, lambda: best[-1] if len(best) == 5 else math.inf, offer)
    assert np.allclose(best, np.sort(mtree.distances(points, query))[:5]) and len(looked) < 2500
    assert len(looked) <= tree.computed and tree.avoided > 0


# 5

PIECES = ["a", "aa", "th", "ing", "'s", " ", "\n", "é", "é", "Σ", "1", "½", "!", "🙂", " ", "ß", "İ", "中", "<|endoftext|>", "_"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25).map("".join))
def test_bpe_is_the_library(text):
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path()
    library, own = Tokenizer.from_file(path), bpe.loaded(path)
    ids = own.encode([text.encode()])[0]
    want = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<u4").tolist() == want and own.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_bpe_is_the_library_on_all_characters():
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path()
    library, own = Tokenizer.from_file(path), bpe.Bpe(path)
    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    marks = [c for c in points if unicodedata.category(chr(c))[0] == "M" or c < 0x20000 and unicodedata.category(chr(c)) == "Cn"]
    texts = [" ".join(f"a{chr(c)}b1{chr(c)}{chr(c)}!" for c in points[at : at + 2000]) for at in range(0, len(points), 2000)]
    texts += [" ".join(x for c in marks[at : at + 5000] for x in (f"a{chr(c)}\u0323", f"a\u0345{chr(c)}", f"a\u0315{chr(c)}\u0323\u0301")) for at in range(0, len(marks), 5000)]
    composed = [chr(c) for c in points if unicodedata.decomposition(chr(c))]
    texts.append(" ".join(unicodedata.normalize("NFD", c) for c in composed))
    for text, ids in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(own.encode([text.encode()])[0], "<u4").tolist() == ids.ids
    long = "".join(f"word{i} <|endoftext|>é\n" for i in range(90_000))
    assert len(long.encode()) > 1 << 20 and np.frombuffer(own.encode([b"", long.encode()])[1], "<u4").tolist() == library.encode(long, add_special_tokens=False).ids


def test_bpe_on_odd_rows(spark):
    rows = bpe.decode(bpe.encode(frame(spark, ODD), bpe.vocabulary_path()), bpe.vocabulary_path()).collect()
    assert [r.n_tokens for r in rows if r.doc_id in (7, 8, 9)] == [0, 0, 0] and rows[0]["from"] == "f" and len(rows) == len(ODD)
    assert bpe.digest(frame(spark, []), bpe.vocabulary_path()).count() == 0


# 6


def test_tiling_finds_reordered_passages(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    words = item.split()
    rows = [(1, "before " + item.upper() + " after"), (2, " ".join(words[6:]) + " between " + " ".join(words[:6])), (3, " ".join(words[:7])), (4, None), (5, ""), (None, item), (6, item), (6, item), (7, "x " * 9000 + item)]
    bench = spark.createDataFrame([(1, item, "x"), (2, None, "x"), (3, "", "x"), (None, item, "x"), (4, "two words", "x")], "item_id long, text string, doc_id string")
    got = sorted((r.doc_id or 0, r.item_id, r.coverage, len(r.tiles)) for r in tiling.contaminated(frame(spark, rows), bench).collect())
    assert got == [(0, 1, 1.0, 1), (1, 1, 1.0, 1), (2, 1, 1.0, 2), (6, 1, 1.0, 1), (6, 1, 1.0, 1), (7, 1, 1.0, 1)]
    assert tiling.contaminated(frame(spark, []), bench).count() == 0 and tiling.contaminated(frame(spark, rows), bench.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40), st.lists(st.sampled_from("abc"), min_size=1, max_size=20))
def test_tiles_are_greedy(text, item):
    def brute(a, b, least):
        seen_a, seen_b, out = set(), set(), []
        while True:
            best = (0, 0, 0)
            for i in range(len(a)):
                for j in range(len(b)):
                    n = 0
                    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in seen_a and j + n not in seen_b:
                        n += 1
                    best = max(best, (n, -i, -j))
            if best[0] < least:
                return out
            n, i, j = best[0], -best[1], -best[2]
            out.append(n)
            seen_a.update(range(i, i + n))
            seen_b.update(range(j, j + n))

    items = tiling.Items([1], [" ".join(item).encode()])
    found = list(tiling.covered(items, [" ".join(text).encode()], 0.0))
    got = [n for _, _, n in found[0][3]] if found else []
    assert sorted(got) == sorted(brute(text, item, min(5, len(item))))


# 8


def test_language_held_out(spark):
    tables = "/root/testdata/sf0.01"
    got = queries()["op8_language"](spark, tables).toPandas().merge(spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.95 and got["score"].between(0, 1).all() and len(got) == 1000


def test_language_on_odd_rows(spark):
    rows = [*ODD, (13, "123 ...")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(frame(spark, rows)).collect()}
    assert got[7] == got[8] == got[13] == ("und", 0.0) and got[10][0] == "en"
    assert language.identify(frame(spark, [])).count() == 0


# 9


def test_substrings_are_brute_force(spark):
    rows = invented(9, 60)
    words = {i: WORD.findall(t) for i, t in rows}
    first = {}
    for i, w in words.items():
        for a in range(len(w) - 49):
            first.setdefault(tuple(w[a : a + 50]), i)
    want = {}
    for i, w in words.items():
        gone = {a + k for a in range(len(w) - 49) if first[tuple(w[a : a + 50])] < i for k in range(50)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        want[i] = (len(w), len(gone), " ".join(kept))
    assert sum(x[1] for x in want.values()) > 0
    for group in (4_000, 2, 0):  # with prefixes of 25 words, with longer ones where several contexts meet, with the longest
        substrings.GROUP = group
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substrings.drop_repeats(frame(spark, rows)).collect()} == want
    substrings.GROUP = 4_000


def test_substrings_on_odd_rows(spark):
    long = "a b c d e f g h i j " * 6
    rows = [*ODD, (20, long), (20, long), (21, long + "tail"), (None, long)]
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed, r["from"]) for r in substrings.drop_repeats(frame(spark, rows)).collect())
    assert (20, 60, 0, "f") in got and (21, 61, 60, "f") in got and (0, 60, 0, "f") in got and (11, 50_000, 0, "f") in got and len(got) == len(rows)
    assert substrings.drop_repeats(frame(spark, [])).count() == 0


SEQUENCES = st.lists(st.lists(st.integers(0, 2), min_size=3, max_size=14), min_size=1, max_size=6)


@settings(max_examples=150, deadline=None)
@given(SEQUENCES, st.integers(2, 3))
def test_tree_nodes_are_the_branching_repeats(rows, least):
    places = defaultdict(set)
    for q, x in enumerate(rows):
        for i in range(len(x)):
            for d in range(least, len(x) - i + 1):
                places[tuple(x[i : i + d])].add((q, i))
    want = set()
    for text, found in places.items():
        after = {rows[q][i + len(text)] if i + len(text) < len(rows[q]) else ("end", q) for q, i in found}
        if len(after) > 1:
            want.add((len(text), frozenset(found)))
    tree = substrings.SuffixTree([np.array(x, np.uint64) for x in rows], least)
    spans = list(zip(tree.depth.tolist(), tree.left.tolist(), tree.right.tolist(), strict=True))
    assert {(d, frozenset((int(tree.sequence[i]), int(tree.place[i])) for i in tree.order[a : b + 1])) for d, a, b in spans} == want
    for (d, a, b), parent in zip(spans, tree.parent.tolist(), strict=True):
        above = [i for i, (d2, a2, b2) in enumerate(spans) if d2 < d and a2 <= a and b2 >= b]
        assert parent == max(above, key=lambda i: spans[i][0], default=-1)


@settings(max_examples=150, deadline=None)
@given(SEQUENCES, st.randoms())
def test_repeats_cover_what_earlier_documents_have(rows, rng):
    first = np.array([rng.randint(0, 9) for _ in rows])
    substrings.WINDOW = 3
    found = list(zip(*(x.tolist() for x in substrings.SuffixTree([np.array(x, np.uint64) for x in rows], 3).repeats(first)), strict=True))
    substrings.WINDOW = 50
    runs = [(q, i, tuple(x[i : i + 3])) for q, x in enumerate(rows) for i in range(len(x) - 2)]
    for doc in range(11):
        want = {(q, i + k) for q, i, run in runs if min(first[p] for p, _, other in runs if other == run) < doc for k in range(3)}
        assert {(q, place + k) for q, place, length, least in found if least < doc for k in range(length)} == want


# 10


def slow_tree(rows, held):
    """Scores by the definition: counts of all contexts, each tested against its suffix, and how many are states."""
    tokens = [(i, ["<begin>", *WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "<end>"]) for i, t in rows]
    train = [ws for i, ws in tokens if not held(i)]
    counts = Counter(w for ws in train for w in ws[1:])
    n, v = sum(counts.values()), len(counts)
    base = lambda w: (counts[w] + 1) / (n + v + 1)
    states = {}

    def p(context, w):
        found = base(w)
        for k in range(1, len(context) + 1):
            if after := states.get(tuple(context[-k:])):
                total = sum(after.values())
                found = max(after[w] - suffixlm.DISCOUNT, 0) / total + suffixlm.DISCOUNT * len(after) / total * found
        return found

    for k in range(1, suffixlm.DEPTH + 1):
        level = defaultdict(Counter)
        for ws in train:
            for i in range(k, len(ws)):
                level[tuple(ws[i - k : i])][ws[i]] += 1
        new = {}
        for context, after in level.items():
            total, often, share, gain = sum(after.values()), 0, 0.0, 0.0
            for w, m in after.items():
                if m >= 2:
                    low = -min(round(-suffixlm.STEPS * math.log(p(context[1:], w))), 255) / suffixlm.STEPS
                    gain, often, share = gain + m * (math.log(m / total) - low), often + m, share + math.exp(low)
            if total > often:
                gain += (total - often) * (math.log((total - often) / total) - math.log(max(1 - share, 1e-9)))
            if total >= suffixlm.LEAST_COUNT and often and gain >= suffixlm.LEAST_GAIN:
                new[context] = after
        states |= new
    out = []
    for i, ws in tokens:
        words = ws[1:]
        scores = sum(math.log10(base(w)) for w in words), sum(math.log10(p(ws[max(0, j - suffixlm.DEPTH) : j], ws[j])) for j in range(1, len(ws)))
        out.append((i if i is not None else -1, held(i), len(words), sum(counts[w] > 0 for w in words), n, *scores))
    return sorted(out), Counter(len(c) for c in states)


def test_tree_scores_are_brute_force(spark):
    rng, held = random.Random(5), lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    line = "the quick brown Fox jumps over the lazy dog again"
    vocabulary = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts += [*texts[:20], *(f"{line} {rng.choice(vocabulary)} {line}" for _ in range(15))]
    rows = [*enumerate(texts, 100), *ODD]
    want, states = slow_tree(rows, held)
    assert len(states) == suffixlm.DEPTH and len({r[1] for r in want}) == 2
    for sizes in (suffixlm.Sizes(), suffixlm.Sizes(1500, 5_000, 20)):  # one block and group; several, with contexts that groups share
        got = sorted((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in suffixlm.score(frame(spark, rows), sizes=sizes).collect())
        assert [g[:5] for g in got] == [w[:5] for w in want]
        assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-5, atol=1e-3)
    assert suffixlm.score(frame(spark, [])).count() == 0


def test_tree_is_better_than_its_base_on_held_out_text(spark):
    got = queries()["op10_suffixlm"](spark, "/root/testdata/sf0.01").toPandas()
    held = got[got["held_out"]]
    assert len(got) == 1000 and len(held) > 100
    assert (held["score"].sum() - held["base_score"].sum()) / held["n_tokens"].sum() > 0.3
    assert held["score"].sum() / held["n_tokens"].sum() > -3.75


# words, and the pipeline


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té\x1c ", max_size=12), min_size=1, max_size=5))
def test_words(texts):
    words = Words([t.encode() for t in texts])
    want = [WORD.findall(t) for t in texts]
    got = [[words.raw[words.start[k] : words.end[k]].decode() for k in range(words.first[i], words.first[i + 1])] for i in range(len(texts))]
    assert got == want
    flat = [w for ws in want for w in ws]
    if flat:
        by = dict(zip(words.hashes().tolist(), flat, strict=True))
        assert len(by) == len(set(flat))


def test_pipeline_stages(spark):
    import corpus_pipeline

    tables = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, before = docs.columns, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, docs, tables).collect()
        ids = {r.doc_id for r in docs.collect()}
        assert rows and stage(spark, docs, tables).columns == columns and {r.doc_id for r in rows} <= ids, name
        docs = spark.createDataFrame(rows, docs.schema)
    last = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, tables).collect()}
    own = bpe.loaded(bpe.vocabulary_path())
    assert len(last) == docs.count() and before is None
    for r in docs.limit(20).collect():
        ids = own.encode([r.text.encode()])[0]
        assert last[r.doc_id].ids_sha256 == hashlib.sha256(ids).hexdigest() and last[r.doc_id].decoded_sha256 == hashlib.sha256(own.decode(ids).encode()).hexdigest()
    # near-duplicates and benchmark passages don't come through
    assert minhash.near_duplicates(docs).where("not kept").count() <= docs.count() // 50
    assert tiling.contaminated(docs, spark.read.parquet(f"{tables}/benchmark.parquet")).count() == 0


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    """Repeated ids and rows, nulls, empty texts: each row is judged by its own text, and clean ones stay."""
    import corpus_pipeline

    one, other, item = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, one), (1, one), (2, one + " end"), (2, other), (3, f"x {item} y"), (3, "clean words"), (4, None), (4, ""), (None, one), (None, f"{item} z"), (5, "five clean words are here")]
    docs = frame(spark, rows)
    stages = dict(corpus_pipeline.STAGES)
    kept = lambda df: sorted((r.doc_id or 0, r.text or "") for r in df.collect())
    deduped = stages["near_duplicates"](spark, docs, str(tmp_path))
    assert deduped.columns == docs.columns
    assert kept(deduped) == sorted([(1, one), (2, other), (3, f"x {item} y"), (3, "clean words"), (4, ""), (4, ""), (0, one), (0, f"{item} z"), (5, "five clean words are here")])
    clean = stages["decontamination"](spark, docs, str(tmp_path))
    assert clean.columns == docs.columns and kept(clean) == sorted((i or 0, t or "") for i, t in rows if not (t or "").count("c39"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name


def test_pipeline_keeps_columns_of_any_name(spark, tmp_path):
    """The whole run on odd rows, and each stage with columns that are named like its own."""
    import corpus_pipeline

    english = "the old house on the hill was sold to a family who came from the city in the spring of that year and stayed there for a long time"
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{english} number {i} " + " ".join(f"{chr(97 + i)}{k}" for k in range(60))) for i in range(12)]
    rows += [(20, f"{english} first {passage} tail"), (21, f"{english} second one {passage} other"), (22, None), (23, ""), (0, rows[0][1]), (None, f"{english} no id"), (24, rows[3][1] + " copy")]
    names = ["score", "lang_pred", "n_words", "n_removed", "kept_text", "__id", "__hash", "__n", "__number", "__rest", "__key", "__held_id", "text_hash", "kept", "id", "a.b"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *[f"{c} {n}" for c in names]) for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c.replace('`', '``')}` string" for c in names))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(f"b{k}" for k in range(40)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, str(tmp_path))
        assert found.columns == docs.columns, name
        for r in found.collect():
            n = r["score"].split()[1]
            assert r[5:] == tuple(f"{c} {n}" for c in names), name
    kept = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {0, 2, 4, 20} <= kept and not kept & {21, 22, 23, 24}  # 21 and 24 are near copies


def test_wrapper_aligns_once_and_deals_no_pages(spark, monkeypatch):
    calls, aligned = [], html._aligned
    monkeypatch.setattr(html, "_aligned", lambda *a: calls.append(1) or aligned(*a))
    deep = html.parse("<div>" * 40 + "<p>t</p>" + "</div>" * 40)
    pairs: list = []
    assert html.match([deep], [deep], pairs) == 1 + len(pairs) == 42
    assert len(calls) == 42  # an element is aligned once, not once more for each above it
    plans, write = [], html.Scratch.write
    monkeypatch.setattr(html.Scratch, "write", lambda self, df, *a, **b: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(self, df, *a, **b))
    rows = [(i, f"https://h.example/{i}", f"<body><div><p>own text {i // 2}</p></div><p>by us</p></body>") for i in range(12)]
    got = {r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {f"own text {i}" for i in range(6)}  # copies are one page for the wrapper
    assert plans and not any("first(html" in p for p in plans)  # what tells copies apart are marks


@pytest.mark.parametrize("size", [100, 1 << 29])
def test_queries_of_a_ring_search_together(monkeypatch, size):
    import pandas as pd

    rng = np.random.default_rng(8)
    points = rng.integers(-size, size, (3000, 6))
    points[100:400] = points[100]  # equal scores
    group = pd.DataFrame({"id": np.arange(3000), "vector": [p.tobytes() for p in points]})
    calls, distances = [], mtree.distances
    monkeypatch.setattr(mtree, "distances", lambda a, b: calls.append(1) or distances(a, b))
    seen = {}
    for n in (30, 300):
        calls.clear()
        queries = pd.DataFrame({"query_id": np.arange(n) * 10, "vector": [points[10 * i].tobytes() for i in range(n)], "least": None})
        got = mtree._searcher(5, 6, float((points.astype(float) ** 2).sum(axis=1).max()) * (1 + 1e-12))(queries, group)
        seen[n] = len(calls)
        scores = points[::10][:n] @ points.T
        for i in range(n):
            scores[i, 10 * i] = -(1 << 62)
            want = np.lexsort((np.arange(3000), -scores[i]))[:5]
            own = got[got["query_id"] == 10 * i]
            assert own["vec_id"].tolist() == want.tolist() and own["score"].tolist() == scores[i][want].tolist()
    assert seen[300] < 2 * seen[30]  # steps grow with the tree, not with the queries


def test_answers_reach_their_blocks_without_another_shuffle(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(60))) for i in range(40)]
    got = suffixlm.score(frame(spark, rows), sizes=suffixlm.Sizes(block_bytes=600, group_tokens=500))
    assert got.count() == 40
    assert "hashpartitioning(block" not in got._jdf.queryExecution().executedPlan().toString()


def test_texts_that_meet_nothing_are_not_shuffled(spark):
    from pyspark.sql import functions as F

    docs = spark.range(20_000).select(F.col("id"), (F.col("id") * 7).alias("text_hash"), F.lit("t").alias("text"))
    wanted = docs.where("id % 100 = 3").drop("text")
    likely = minhash._likely(docs, wanted, ["id", "text_hash"])
    assert likely.columns == docs.columns
    assert likely.join(wanted, ["id", "text_hash"]).count() == 200 and likely.count() < 2500
    assert minhash._likely(docs, wanted.limit(0), ["id", "text_hash"]).count() == 0
