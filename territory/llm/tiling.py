"""Benchmark decontamination by greedy string tiling (operator 6).

Documents and benchmark items are joined on shared five-word seeds, found by running Karp-Rabin hashes. For each
pair the longest match of words that aren't marked yet is marked, again and again, in both texts. The share of the
item's words under tiles is its coverage, whatever order the document has them in.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from territory.llm.base import Words, raw_texts, read_table, slices, small_batches, windows

SEED, LEAST_COVERAGE = 5, 0.75
#: Words of benchmark items that are sent to all tasks at once; a larger benchmark takes several passes.
BLOCK_WORDS = 2_000_000


class Items:
    """Benchmark items and the sorted hashes of their seeds, by width; an item of fewer words is one seed."""

    def __init__(self, ids: list[int], texts: list[bytes]) -> None:
        words = Words(texts, lower=True)
        self.ids, self.first, self.counts = ids, words.first, words.counts
        self.words = words.hashes() if len(words) else np.zeros(0, np.uint64)
        owner = words.text_of_word()
        width = np.minimum(self.counts, SEED)[owner]
        place = np.arange(len(self.words)) - self.first[owner]
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # sorted hashes, and the items that have them
        for w in np.unique(width).tolist():
            at = np.flatnonzero((width == w) & (place + w <= self.counts[owner]))
            hashes = windows(self.words, w)[at]
            order = np.argsort(hashes, kind="stable")
            self.seeds[w] = hashes[order], owner[at[order]]

    def of(self, item: int) -> np.ndarray:
        return self.words[self.first[item] : self.first[item] + self.counts[item]]


def tiles(matches: list[tuple[int, int, int]], least: int, text_words: int, item_words: int) -> list[tuple[int, int, int]]:
    """Greedy tiling: of the maximal matches (place in text, place in item, length) the longest unmarked part first.

    Ties go to the earlier place in the text, then in the item. Parts shorter than `least` make no tile.
    """
    heap = [(-n, a, b) for a, b, n in matches]
    heapq.heapify(heap)
    text, item, out = np.zeros(text_words, bool), np.zeros(item_words, bool), []
    while heap:
        n, a, b = heapq.heappop(heap)
        marked = text[a : a - n] | item[b : b - n]
        if not marked.any():
            out.append((a, b, -n))
            text[a : a - n] = item[b : b - n] = True
            continue
        edges = np.flatnonzero(np.diff(~marked, prepend=False, append=False))  # what is left of it, in runs
        for start, end in zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True):
            if end - start >= least:
                heapq.heappush(heap, (start - end, a + start, b + start))
    return out


def maximal_matches(text: np.ndarray, item: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """(place in text, place in item, length) of all runs of `width` words or more that can't be longer.

    A word after the other of the text's stretches that have seeds of the item extends, or ends, the matches on all diagonals at once.
    """
    out: list[tuple[int, int, int]] = []
    begin = np.flatnonzero(np.isin(windows(text, width), windows(item, width)))
    if not len(begin):
        return out
    cuts = np.flatnonzero(np.diff(begin) > width)
    starts, ends = begin[np.concatenate(([0], cuts + 1))], begin[np.concatenate((cuts, [len(begin) - 1]))] + width
    for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
        run = np.zeros(len(item) + 1, np.int64)  # run[j + 1]: length of the match that ends at the item's word j
        for i in range(start, end + 1):
            now = np.zeros_like(run)
            if i < end:
                same = item == text[i]
                now[1:][same] = run[:-1][same] + 1
            ended = np.flatnonzero(run >= width)
            ended = ended[(ended == len(item)) | (now[np.minimum(ended + 1, len(item))] == 0)]
            out += [(i - n, j - n, n) for j, n in zip(ended.tolist(), run[ended].tolist(), strict=True)]
            run = now
    return out


def covered(items: Items, texts: list[bytes], least: float) -> Iterator[tuple[int, int, float, list[tuple[int, int, int]]]]:
    """(text, item, coverage, tiles) for each text and item that share enough seeds."""
    words = Words(texts, lower=True)
    if not len(words) or not len(items.words):
        return
    hashes, owner = words.hashes(), words.text_of_word()
    hits = []
    for width, (seeds, of) in items.seeds.items():
        runs = windows(hashes, width)
        place = np.flatnonzero(seeds[np.minimum(np.searchsorted(seeds, runs), len(seeds) - 1)] == runs)
        place = place[place + width <= words.first[owner[place] + 1]]
        # each seed of a text counts once, however often it has it, and each of an item's seeds of that hash
        order = np.lexsort((runs[place], owner[place]))
        text, seed = owner[place[order]], runs[place[order]]
        new = np.ones(len(order), bool)
        new[1:] = (text[1:] != text[:-1]) | (seed[1:] != seed[:-1])
        text, seed = text[new], seed[new]
        low, high = np.searchsorted(seeds, seed, side="left"), np.searchsorted(seeds, seed, side="right")
        n = high - low
        rows = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        pairs, shared = np.unique(np.repeat(text, n) * np.int64(len(items.ids)) + of[rows], return_counts=True)
        enough = shared * width >= least * items.counts[pairs % len(items.ids)]  # else, even without overlaps, too few
        hits += [(int(p) // len(items.ids), int(p) % len(items.ids), width) for p in pairs[enough]]
    for text, item, width in sorted(hits):
        own, other = hashes[words.first[text] : words.first[text + 1]], items.of(item)
        marked = tiles(maximal_matches(own, other, width), width, len(own), len(other))
        yield text, item, sum(n for _, _, n in marked) / len(other), marked


def contaminated(df: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", least: float = LEAST_COVERAGE) -> DataFrame:
    """A row (id, item, coverage, tiles) for each document and item with at least `least` of the item's words under tiles.

    Words are lower-cased runs of bytes other than ASCII white space. An item without words, or with a null id,
    covers nothing; null and empty texts have no rows; rows that repeat are reported each. A very long text is compared
    only where it has an item's seeds. Of tiles as long, the one earlier in the text, then in the item, comes first. Empty
    tables give an empty result. Other columns aren't read.
    """
    spark = df.sparkSession
    small_batches(spark)
    docs = df.select(F.col(id).alias("__id"), F.col(text).cast("string").alias("__text")).where("__text is not null")
    pool = benchmark.select(F.col(item).alias("item"), F.col(text).cast("string").alias("text")).where("item is not null and text is not null")
    kind, item_kind = docs.schema["__id"].dataType.simpleString(), pool.schema["item"].dataType.simpleString()
    schema = f"`{id}` {kind}, `{item}` {item_kind}, coverage double, tiles array<struct<text_at: int, item_at: int, length: int>>"
    words = pool.agg(F.coalesce(F.sum(F.size(F.split("text", r"[\x20\x09-\x0D]+"))), F.lit(0))).first()[0]
    blocks = max(1, -(-words // BLOCK_WORDS))
    out = None
    for block in range(blocks):  # the bound on a block's size makes it fit to be sent
        own = pool.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).orderBy("item", "text").collect()
        items = spark.sparkContext.broadcast(Items([r.item for r in own], [r.text.encode() for r in own]))

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "__text"):
                rows = [r for r in covered(items.value, raw_texts(batch.column("__text")), least) if r[2] >= least]
                if rows:
                    places = [[{"text_at": a, "item_at": b, "length": n} for a, b, n in r[3]] for r in rows]
                    kinds = pa.list_(pa.struct([("text_at", pa.int32()), ("item_at", pa.int32()), ("length", pa.int32())]))
                    which = batch.column("__id").take(pa.array([r[0] for r in rows]))
                    yield pa.RecordBatch.from_arrays([which, pa.array([items.value.ids[r[1]] for r in rows]), pa.array([r[2] for r in rows]), pa.array(places, kinds)], names=[id, item, "coverage", "tiles"])

        found = docs.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "coverage", F.size("tiles").alias("n_tiles"))
