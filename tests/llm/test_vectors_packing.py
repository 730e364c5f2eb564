"""Operators 11 to 13 against slow twins."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from territory.llm import elkan, heaplloyd, packing, vectors
from territory.llm.base import Words
from territory.llm.bpe import FlatEncoder, flat, loaded, vocabulary_path

SCHEMA = "vec_id long, embedding array<double>, label int, code string, x int, ids int, cluster string"


def vector_rows(rng, n, width, odd=True):
    """Vectors on a coarse grid, so that there are ties, with repeated rows and ids and what must be dropped."""
    rows = [(rng.randrange(n), [rng.randrange(-3, 4) / 4 for _ in range(width)], rng.choice([None, 1, 1, 1, 2])) for _ in range(n)]
    rows += [rows[0]] * (n // 3)
    if odd:
        rows += [(1, None, 1), (2, [None] * width, 1), (3, [math.nan] + [0.0] * (width - 1), 2), (4, [math.inf] * width, 2), (None, [0.5] * width, None), (None, [0.25] * width, None)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", 7, 8, "d") for r in rows], SCHEMA).repartition(3)


def kept(rows, scale, width=None):
    good = [(i, v, l) for i, v, l in rows if v is not None and all(c is not None and math.isfinite(c) for c in v) and (width is None or len(v) == width)]
    return [(i, [math.floor(c * scale) for c in v], l) for i, v, l in good]


def away(a, b):
    return sum((p - q) ** 2 for p, q in zip(a, b, strict=True))


def lloyd(points, centres, rounds):
    """Every distance, in whole numbers."""
    best = lambda p: min(range(len(centres)), key=lambda c: (away(p, centres[c]), c))
    for _ in range(rounds):
        own = [best(p) for p in points]
        groups = [[p for p, c in zip(points, own, strict=True) if c == e] for e in range(len(centres))]
        centres = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else centres[e] for e, g in enumerate(groups)]
    return [best(p) for p in points], centres


def slow_codes(rows, scale, parts, entries, rounds):
    rows = kept(rows, scale)
    width = -(-max(len(v) for _, v, _ in rows) // parts) * parts
    rows = [(i, v + [0] * (width - len(v)), l) for i, v, l in rows]
    seeds = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    cut = lambda v, p: v[p * width // parts : (p + 1) * width // parts]
    codes, books = zip(*(lloyd([cut(v, p) for _, v, _ in rows], [cut(v, p) for _, v, _ in seeds], rounds) for p in range(parts)), strict=True)
    out = [(i, l, "".join(f"{codes[p][n]:02x}" for p in range(parts)), sum(away(cut(v, p), books[p][codes[p][n]]) for p in range(parts))) for n, (i, v, l) in enumerate(rows)]
    return out, [list(map(list, b)) for b in books]


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize("entries,width,block", [(16, 8, 40), (256, 8, 1 << 14), (1, 4, 10), (7, 3, 25)])
def test_codes_are_brute_force(spark, monkeypatch, entries, width, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rows = vector_rows(random.Random(entries), 150, width)
    got, books, scans = heaplloyd.compress(frame(spark, rows), scale=8.0, entries=entries)
    want, slow_books = slow_codes(rows, 8.0, 4, entries, 4)
    assert books.tolist() == slow_books
    assert ordered(got.collect()) == ordered(want)
    assert scans[0] == 4 * len(want)


def test_vectors_of_other_lengths_are_padded(spark):
    rows = [(i, [float(i % 5)] * (i % 7), 1) for i in range(60)]
    got, books, _ = heaplloyd.compress(frame(spark, rows), scale=1.0, entries=5)
    want, slow_books = slow_codes(rows, 1.0, 4, 5, 4)
    assert ordered(got.collect()) == ordered(want) and books.tolist() == slow_books


def test_heaps_spare_parts_that_did_not_drift(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(16, 16)) * 10
    rows = [(i, (centres[i % 16] + rng.normal(size=16) / 50).tolist(), 0) for i in range(800)]
    _, _, scans = heaplloyd.compress(frame(spark, rows), entries=16)
    assert scans[0] == 3200 and scans[-1] < 400


def test_heap_pops_what_drift_has_reached():
    h = heaplloyd.Heaps(np.zeros(0, np.int32), np.zeros(0), np.zeros(3, np.int64))
    rng = random.Random(1)
    keys = [rng.randrange(20) for _ in range(60)]
    h.push(np.arange(60), np.arange(60) % 3, np.array(keys, float))
    h = heaplloyd.Heaps(*h.arrays())
    parts, entries = h.pop(np.array([5.0, -1.0, 19.0]))
    assert sorted(zip(parts.tolist(), entries.tolist(), strict=True)) == sorted((i, i % 3) for i in range(60) if keys[i] <= [5, -1, 19][i % 3])
    members, left, sizes = h.arrays()
    assert sizes.sum() == 60 - len(parts) and sizes[2] == 0 and sorted([*members.tolist(), *parts.tolist()]) == list(range(60))


def slow_clusters(rows, scale, width, k, rounds):
    rows = kept(rows, scale, width)
    hashed = lambda i: (i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "")
    seeds = [v for _, v, _ in sorted(rows, key=lambda r: (*hashed(r[0]), r[1]))[:k]]
    own, centres = lloyd([v for _, v, _ in rows], seeds, rounds)
    return [(i, own[n], away(v, centres[own[n]])) for n, (i, v, _) in enumerate(rows)], centres


@pytest.mark.parametrize("k,width,block", [(16, 8, 40), (5, 3, 1 << 14), (1, 4, 10), (400, 2, 60)])
def test_clusters_are_brute_force(spark, monkeypatch, k, width, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rows = [*vector_rows(random.Random(k), 150, width), (5, [1.0] * (width + 1), 1), (6, [], 1)]
    got, centroids, _ = elkan.cluster(frame(spark, rows), scale=8.0, width=width, k=k)
    want, centres = slow_clusters(rows, 8.0, width, k, 3)
    assert centroids.tolist() == centres
    assert ordered(got.collect()) == ordered(want)


def test_bounds_spare_distances(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(16, 64)) * 10
    rows = [(i, (centres[i % 16] + rng.normal(size=64) / 50).tolist(), 0) for i in range(800)]
    _, _, computed = elkan.cluster(frame(spark, rows))
    assert sum(computed) < 800 * 16 * 3 / 2


def test_vector_operators_on_empty_tables(spark, tmp_path):
    for rows in ([], [(1, None, 1)], [(None, [math.nan], None)]):
        table = frame(spark, rows)
        got, books, scans = heaplloyd.compress(table)
        assert got.collect() == [] and books.shape == (4, 0, 0) and scans == []
        got, centroids, _ = elkan.cluster(table)
        assert got.collect() == [] and centroids.shape == (0, 64)
        path = str(tmp_path / f"e{len(rows)}{rows[:1] == [(1, None, 1)]}")
        table.write.parquet(f"{path}/embeddings.parquet")
        assert heaplloyd.op11_heap_lloyd(spark, path).collect() == [] and elkan.op13_elkan(spark, path).collect() == []
    assert heaplloyd.compress(frame(spark, [(1, [], 1), (2, [], None)]))[0].count() == 2


def test_too_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="2\\^31"):
        elkan.cluster(frame(spark, [(1, [1e30] * 64, 1)]))


def test_totals_by_key_and_salt(spark, monkeypatch):
    rows = spark.createDataFrame([(i, i % 3 or None, i) for i in range(100)], "id long, label int, error long")
    want = ordered(vectors.with_totals(rows, "label", "error", "total", rows["id"]).collect())
    monkeypatch.setattr(vectors, "TOTALS", 1)
    assert ordered(vectors.with_totals(rows, "label", "error", "total", rows["id"]).collect()) == want
    assert {r[1]: r[3] for r in want} == {c: sum(i for i in range(100) if (i % 3 or None) == c) for c in (None, 1, 2)}


# packing


def price_of(at, price, found, size):
    index = {p: i for i, p in enumerate(at)}
    padding = lambda n: 0 if n & (n - 1) == 0 else size - n
    return sum(price[index[b]] + packing.WINDOW + padding(b - a) for a, b in zip(found, found[1:], strict=False))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 16), st.integers(0, 70)), min_size=1, max_size=60))
def test_cuts_are_the_cheapest(steps):
    at, price = [0], [0]
    for step, cost in steps:
        at.append(at[-1] + step)
        price.append(cost)
    found = packing.cuts(np.array(at), np.array(price), 16)
    best = [0] + [math.inf] * (len(at) - 1)
    for i in range(1, len(at)):
        for j in range(i):
            n = at[i] - at[j]
            if n <= 16:
                best[i] = min(best[i], best[j] + price[i] + packing.WINDOW + (0 if n & (n - 1) == 0 else 16 - n))
    assert found[0] == 0 and found[-1] == at[-1] and all(0 < b - a <= 16 for a, b in zip(found, found[1:], strict=False))
    assert price_of(at, price, found, 16) == best[-1]


def checked(rows, texts, size):
    """Every token of every document in one piece, sequences without gaps; the share of padding."""
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts}
    by_document, by_sequence = {}, {}
    for r in rows:
        by_document.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_document.keys() == ids.keys()
    for i, pieces in by_document.items():
        pieces.sort(key=lambda r: r.start)
        assert [x for r in pieces for x in np.frombuffer(r.ids, "<u4").tolist()] == ids[i]
        assert [r.start for r in pieces] == [sum(len(q.ids) // 4 for q in pieces[:n]) for n in range(len(pieces))]
        assert {r.doc_tokens for r in pieces} == {len(ids[i])}
    padding = 0
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == [sum(len(q.ids) // 4 for q in pieces[:n]) for n in range(len(pieces))]
        n = sum(len(r.ids) // 4 for r in pieces)
        assert 0 < n <= size
        padding += 0 if n & (n - 1) == 0 else size - n
    return padding / sum(map(len, ids.values()))


def invented(seed, n):
    rng = random.Random(seed)
    words = "the a of field seller doctor store region paid sold was is and large small".split()
    return [(i, " ".join(rng.choice(words) + ("." if rng.random() < 0.07 else "") for _ in range(int(rng.expovariate(1 / 200))))) for i in range(n)]


def test_packing_keeps_every_token_with_little_padding(spark, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 20_000)
    texts = invented(1, 300)
    table = spark.createDataFrame([(i, t, 3, "x") for i, t in texts], "doc_id long, text string, start int, ids string").repartition(3)
    rows = packing.pack(table, vocabulary_path()).collect()
    assert checked(rows, texts, 2048) < 0.02
    first = {i: n for n, i in enumerate(r.doc_id for r in rows)}
    assert all(r.sequence_id >= 0 for r in rows) and len(first) == 300


def test_packing_on_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK_BYTES", 5000)  # a longer text is encoded in parts
    texts = [(1, None), (2, ""), (3, "word " * 6000), (4, "x" * 3000), (5, "á b\x00 . " * 900), (6, "no end " * 40), (None, "of no id.")]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    assert checked(packing.pack(table.coalesce(1), vocabulary_path()).collect(), texts, 2048) < 0.02
    assert packing.pack(table.where("false"), vocabulary_path()).collect() == []
    twice = packing.pack(table.unionByName(table).coalesce(1), vocabulary_path()).collect()
    assert sum(len(r.ids) for r in twice) == 2 * sum(len(r.ids) for r in packing.pack(table, vocabulary_path()).collect())
    tiny = packing.pack(table.coalesce(1), vocabulary_path(), size=1).collect()
    assert {len(r.ids) for r in tiny} == {4} and len({r.sequence_id for r in tiny}) == len(tiny)


def test_packing_does_not_depend_on_chunks():
    """A stream cut chunk by chunk costs little more than one cut at once."""
    bpe = loaded(vocabulary_path())
    ends, ids = packing.sentence_ends(bpe), bpe.encode([t.encode() for _, t in invented(2, 200)])
    cost = []
    for chunk in (10_000, 1 << 30):
        stream, rows = packing.Stream(2048, ends, chunk), []
        for i, x in enumerate(ids):
            stream.begin(i)
            rows += stream.finish(np.append(np.frombuffer(x, "<u4"), np.uint32(1)))
        rows += stream.close()
        sizes = np.bincount([r[3] for r in rows], [len(r[2]) // 4 for r in rows]).astype(int).tolist()
        cost.append(sum((0 if n & (n - 1) == 0 else 2048 - n) + packing.WINDOW for n in sizes) + packing.SENTENCE * (len(rows) - 200))
    assert cost[0] < 1.2 * cost[1]


def test_digest_of_pieces(spark, tables):
    got = packing.op12_packing(spark, tables).collect()
    pieces = packing.pack(spark.read.parquet(f"{tables}/documents.parquet"), vocabulary_path()).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in got) == sorted((r.doc_id, r.start, len(r.ids) // 4, zlib.crc32(r.ids)) for r in pieces)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "Ab", "é", " ", "\n", "don't", "12", "<|endoftext|>", "\x00", "longer-than-eight", "longer-than-nine", "🙂"]), max_size=20).map("".join), min_size=1, max_size=6))
def test_flat_ids_are_the_same(texts):
    bpe, raw = loaded(vocabulary_path()), [t.encode() for t in texts]
    want = bpe.encode(raw)
    for encode in (flat(vocabulary_path()), FlatEncoder(bpe), FlatEncoder(bpe, 0)):
        for _ in range(2):  # new words, then known ones
            ids, counts = encode(raw)
            assert ids.tobytes() == b"".join(want) and counts.tolist() == [len(x) // 4 for x in want]


def test_words_of_one_hash_are_told_apart(monkeypatch):
    bpe, raw = loaded(vocabulary_path()), [b"one two three", b"four two"]
    monkeypatch.setattr(Words, "hashes", lambda self, end=None: np.full(len(self), 7, np.uint64))
    ids, _ = FlatEncoder(bpe)(raw)
    assert ids.tobytes() == b"".join(bpe.encode(raw))
