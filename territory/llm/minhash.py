"""MinHash near-duplicate classes (operator 1).

Documents with equal shingle sets are one class. Class representatives get universal hash minima, cut into
bands; who shares a band's bucket is compared, first by signature, then by full sets. A bucket first
compares its members with one hub only, the member that meets most others in all its buckets, as the text does that copies
were made from, and joins what is confirmed; then with a hub of another component, as long as that joins many.
After that it compares members of different components, in blocks of bounded size. Components come from
alternating stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from territory.llm.base import Scratch, Words, mix, raw_texts, read_table, slices, windows
from territory.llm.components import connected_components

SHINGLE, PERCENT = 5, 75
#: A pair with 75 % in common misses all 40 bands of 4 minima once in 4 million pairs.
BANDS, ROWS = 40, 4
#: Share of equal minima under which a pair isn't compared in full: 5 standard deviations below 0.75.
LEAST_EQUAL = 0.58
#: Members of a bucket, and shingles of theirs, that meet the same number of others in one task.
BLOCK, BLOCK_SHINGLES = 2048, 1_000_000
#: Hubs of a bucket, one after the other, and the share of their comparisons that must be links for another.
HUBS, LEAST_LINKS = 5, 0.05
#: Bits of a filter for each row that is wanted, and pieces of 32,768 bits that it has at most.
FILTER_BITS, FILTER_PIECES = 16, 2048

_rng = np.random.default_rng(75)
_FACTORS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles: lower-cased runs of five words, or all words if fewer."""
    words = Words(texts, lower=True)
    if not len(words):
        return [np.zeros(0, np.uint64)] * len(texts)
    hashes = words.hashes()
    runs = windows(hashes, SHINGLE)
    out = []
    for first, n in zip(words.first.tolist(), words.counts.tolist(), strict=False):
        if n >= SHINGLE:
            out.append(np.unique(runs[first : first + n - SHINGLE + 1]))
        else:
            out.append(windows(hashes[first : first + n], n) + np.uint64(n) if n else np.zeros(0, np.uint64))
    return out


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each universal hash h(x) = (a x + b mod 2^64) >> 32 over a set."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        part = shingles[at : at + 1024]
        np.minimum(least, (_FACTORS[:, None] * part + _OFFSETS[:, None]).min(axis=1), out=least)
    return least >> np.uint64(32)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One key for each band of each signature."""
    banded = signatures.reshape(-1, BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), banded.shape[:2])
    for row in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + banded[:, :, row])
    return key.view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        sets = shingle_sets(raw_texts(batch.column("text")))
        full = np.array([len(s) > 0 for s in sets])
        signatures = np.stack([minima(s) for s in sets])
        keys, rows = band_keys(signatures), signatures.astype(np.uint16)
        prints = [[np.bitwise_xor.reduce(mix(s)), (mix(s ^ np.uint64(0x5851F42D4C957F2D)) * (s | np.uint64(1))).sum()] if len(s) else [0, 0] for s in sets]
        prints = np.array(prints, np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"), batch.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1]),
                pa.array([k.tobytes() if f else None for k, f in zip(keys, full, strict=True)], pa.binary()), pa.array([r.tobytes() if f else None for r, f in zip(rows, full, strict=True)], pa.binary()),
            ],
            names=["id", "text_hash", "n", "print1", "print2", "keys", "minima"],
        )


def _explode_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keys = np.frombuffer(b"".join(batch.column("keys").to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column("id").take(pa.array(np.repeat(np.arange(batch.num_rows), BANDS)))], names=["key", "id"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures agree enough."""
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("minima_a", "minima_b"))
            yield batch.filter(pa.array((a == b).mean(axis=1) >= LEAST_EQUAL)).select(["a", "b"])


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether sorted sets have 75 % of their union in common."""
    if 100 * min(len(x), len(y)) < PERCENT * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def _set(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted set of each text, as bytes."""
    for batch in slices(batches, "text"):
        sets = shingle_sets(raw_texts(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x.tobytes() for x in sets], pa.binary())], names=["id", "shingles"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets are near."""
    for batch in batches:
        keep = [linked(_set(x), _set(y)) for x, y in zip(batch.column("shingles_a").to_pylist(), batch.column("shingles_b").to_pylist(), strict=True)]
        yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])


class _Found:
    """Union-find over the components that meet in one bucket."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (above := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(above, above)
        return x


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of each (key, x, y) of a partition that is sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.column_stack([batch.column(c).to_numpy() for c in ("key", "x", "y")])
        cuts = np.concatenate(([0], np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1, [len(marks)]))
        for at, to in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            mark = tuple(marks[at])
            if mark != last and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(at, to - at))
            last = mark
    if held:
        yield pa.Table.from_batches(held)


def _near_in_bucket(run: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Each member and the later ones of other components whose signatures agree and that first meet in this bucket."""
    component, block = run.column("component").to_numpy(), run.column("block").to_numpy()
    key, cross = run.column("key")[0].as_py(), run.column("x")[0].as_py() != run.column("y")[0].as_py()
    keys = np.frombuffer(b"".join(run.column("keys").to_pylist()), np.int64).reshape(len(component), BANDS)
    least = np.frombuffer(b"".join(run.column("minima").to_pylist()), np.uint16).reshape(len(component), -1)
    for i in range(len(component) - 1):
        others = i + 1 + np.flatnonzero((component[i + 1 :] != component[i]) & ((block[i + 1 :] != block[i]) == cross))
        if len(others):
            others = others[(least[others] == least[i]).mean(axis=1) >= LEAST_EQUAL]
            shared = keys[others] == keys[i]
            others = others[keys[i][shared.argmax(axis=1)] == key] if len(others) else others
        if len(others):
            yield i, others


def _suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of a bucket that have someone to be compared with."""
    for run in _runs(batches):
        marked = np.zeros(len(run), bool)
        if len(set(run.column("component").to_pylist())) > 1:
            for i, others in _near_in_bucket(run):
                marked[i] = True
                marked[others] = True
        if marked.any():
            yield from run.filter(pa.array(marked)).combine_chunks().to_batches()


def _links_in_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Confirmed links between components that nothing else in the bucket has joined yet."""
    for run in _runs(batches):
        ids, component = run.column("id").to_pylist(), run.column("component").to_pylist()
        sets = [_set(x) for x in run.column("shingles").to_pylist()]
        found, links = _Found(), []
        for i, others in _near_in_bucket(run):
            for j in others.tolist():
                one, other = found.root(component[i]), found.root(component[j])
                if one != other and linked(sets[i], sets[j]):
                    found.up[one] = other
                    links.append((ids[i], ids[j]))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], names=["a", "b"])


def _confirmed(pairs: DataFrame, reps: DataFrame, sets: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """Of the pairs (a, b) those that are near, by signature and then by full sets; and how many pairs there were.

    What is joined is written before, so that Spark can split a hub with very many members.
    """
    pairs = scratch.write(pairs, "pairs")
    sides = [reps.select(F.col("id").alias(c), F.col("minima").alias(f"minima_{c}")) for c in "ab"]
    alike = scratch.write(pairs.join(sides[0], "a").join(sides[1], "b").mapInArrow(_alike, "a long, b long"), "alike")
    sides = [sets.select(F.col("id").alias(c), F.col("shingles").alias(f"shingles_{c}")) for c in "ab"]
    links = scratch.write(alike.join(sides[0], "a").join(sides[1], "b").mapInArrow(_confirm, "a long, b long"), "links")
    n = pairs.count()
    scratch.drop("pairs", "alike")
    return links, n


def _hub_links(placed: DataFrame, whole: DataFrame, reps: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) after each bucket's members have met one hub after another."""
    hub = F.max(F.when(~F.col("spent"), F.struct("weight", F.xxhash64("id").alias("h"), "id", "component"))).alias("hub")
    # all members are components of their own, and none has been a hub's
    now = placed.select("key", "id", "weight", F.col("id").alias("component"), F.lit(False).alias("spent"))
    for turn in range(HUBS):
        hubs = now.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), hub).where("low < high and hub is not null").select("key", F.col("hub.id").alias("b"), F.col("hub.component").alias("of_b"))
        met = scratch.write(now.join(scratch.write(hubs, "hubs"), "key"), f"met{turn}")
        links, compared = _confirmed(met.where("component <> of_b").select(F.col("id").alias("a"), "b").distinct(), reps, sets, scratch)
        if compared:
            whole = _joined(whole, links, scratch, f"whole{turn}")
        if not compared or links.count() < LEAST_LINKS * compared:
            break
        spent = met.select("key", "id", "weight", (F.col("spent") | (F.col("component") == F.col("of_b"))).alias("spent"))
        now = scratch.write(spent.join(whole, "id"), f"now{turn}")
    return whole


def _bucket_links(placed: DataFrame, whole: DataFrame, reps: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame | None:
    """Confirmed links between components that share a bucket, whoever shows them; None if no bucket has several."""
    now = placed.join(whole, "id")
    mixed = now.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("members"), F.sum("n").alias("shingles")).where("low < high")
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    mixed = scratch.write(mixed.select("key", blocks.alias("blocks")), "mixed")
    if mixed.isEmpty():
        return None
    member = now.join(mixed, "key").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    member = scratch.write(member.select("key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "id", "component"), "member")
    order = ["key", "x", "y"]
    dealt = member.join(reps.select("id", "keys", "minima"), "id").select(*order, "block", "id", "component", "keys", "minima").repartition(*order).sortWithinPartitions(*order)
    suspects = scratch.write(dealt.mapInArrow(_suspects, dealt.schema), "suspects")
    met = suspects.join(sets, "id").select(*order, "block", "id", "component", "keys", "minima", "shingles").repartition(*order).sortWithinPartitions(*order)
    return scratch.write(met.mapInArrow(_links_in_bucket, "a long, b long"), "rest")


def _joined(whole: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, component) of each representative after more links."""
    a, b = (whole.select(F.col("id").alias(c), F.col("component").alias(f"of_{c}")) for c in "ab")
    edges = links.join(a, "a").join(b, "b").where("of_a <> of_b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    found = connected_components(edges, scratch).select(F.col("node").alias("component"), F.col("component").alias("least"))
    return scratch.write(whole.join(found, "component", "left").select("id", F.coalesce("least", "component").alias("component")), name)


def _likely(df: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """Rows whose `by` may be among the wanted: all that are and few others, so that a join that follows doesn't shuffle all texts.

    A hash of the wanted marks bits in pieces of 32,768 each; there are FILTER_PIECES at most, 8 MB of them, which then let more pass.
    """
    pieces = max(1, min(FILTER_PIECES, -(-FILTER_BITS * wanted.count() // 32_768)))
    place = F.pmod(F.xxhash64(*by), F.lit(pieces * 32_768)) + 1
    marks = wanted.select(place.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("__piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("__bits"))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.expr("substring(__bits, cast(__at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    found = df.withColumns({"__piece": F.bitmap_bucket_number(place), "__at": at}).join(F.broadcast(marks), "__piece")
    return found.where(F.getbit(byte, (F.col("__at") % 8).cast("int")) == 1).select(*df.columns)


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_shingles, component_id (least id reachable over links), kept and text_hash (xxhash64) of each row.

    Rows are linked when their sets of lower-cased five-word shingles have 75 % of their union in common.
    A null or empty text, or one without words, has no shingles and no links. Rows with a null id are
    returned and kept, with a null component_id, and link with nothing. Rows that repeat an id are documents of their
    own, and rows that repeat id and text are all kept or not. A very long text is one set like any other. Other columns
    are not read; an empty table gives an empty result.
    """
    docs = df.select(F.col(id).cast("long").alias("id"), F.xxhash64(F.col(text).cast("string")).alias("text_hash"), F.col(text).cast("string").alias("text"))
    scratch = Scratch(df.sparkSession)
    sketch = scratch.write(docs.mapInArrow(_sketch, "id long, text_hash long, n long, print1 long, print2 long, keys binary, minima binary"), "sketch")
    same = ["print1", "print2"]
    known = sketch.where("n > 0 and id is not null")
    # equal sets are one node, named by its least id; if another node has that id as well, by a hash
    group = known.groupBy(*same).agg(F.min(F.struct("id", "text_hash")).alias("rep"))
    named = F.when(F.count("*").over(Window.partitionBy("rep.id")) == 1, F.col("rep.id")).otherwise(F.xxhash64(*same))
    group = scratch.write(group.select(*same, "rep", named.alias("node")), "group")
    first = group.select(F.col("rep.id").alias("id"), F.col("rep.text_hash").alias("text_hash"), F.col("node"))
    reps = scratch.write(known.select("id", "text_hash", "n", "keys", "minima").join(first, ["id", "text_hash"]).drop("id", "text_hash").dropDuplicates(["node"]).withColumnRenamed("node", "id"), "reps")
    keys = scratch.write(reps.mapInArrow(_explode_keys, "key long, id long"), "keys")
    buckets = scratch.write(keys.groupBy("key").agg(F.count("*").alias("members"), F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("key", "members"), "buckets")
    shared = scratch.write(keys.join(buckets, "key"), "shared")
    scratch.drop("keys", "buckets")
    # what is compared from here on is the part of all documents that meets another; the weight is how many each meets
    met = scratch.write(shared.groupBy("id").agg(F.sum("members").alias("weight")), "met")
    near = scratch.write(reps.join(met, "id"), "near")
    wanted = scratch.write(first.join(met.select(F.col("id").alias("node")), "node"), "wanted")
    sets = scratch.write(_likely(docs, wanted, ["id", "text_hash"]).join(wanted, ["id", "text_hash"]).select(F.col("node").alias("id"), "text").mapInArrow(_shingles, "id long, shingles binary").dropDuplicates(["id"]), "sets")
    placed = scratch.write(shared.select("key", "id").join(near.select("id", "weight", "n"), "id"), "placed")
    scratch.drop("reps", "shared", "met", "wanted")
    whole = _hub_links(placed, near.select("id", F.col("id").alias("component")), near, sets, scratch)
    links = _bucket_links(placed, whole, near, sets, scratch)
    if links is not None:
        whole = _joined(whole, links, scratch, "joined")
    whole = scratch.write(group.join(whole.withColumnRenamed("id", "node"), "node").select("node", "component", F.col("rep.id").alias("id")), "whole")
    least = whole.groupBy("component").agg(F.min("id").alias("component_id"))
    joined = group.join(whole.select("node", "component").join(least, "component"), "node", "left").select(*same, F.coalesce("component_id", "rep.id").alias("component_id"))
    joined = scratch.write(joined, "components")
    scratch.drop(*[name for name in scratch.paths if name not in ("sketch", "components")])
    rows = sketch.select("id", "text_hash", "n", F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("print1")).alias("print1"), "print2").join(joined, same, "left")
    component = F.coalesce("component_id", "id")
    return rows.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"), "text_hash")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents")).drop("text_hash")


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
          JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
          GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id,
       w.doc_id = least(w.doc_id, coalesce(m, w.doc_id)) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)
"""
