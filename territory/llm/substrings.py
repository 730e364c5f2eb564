"""Removal of passages that an earlier document holds (operator 9).

Suffix trees over prefixes. Of the 25-word runs in a 50-word window, the least by hash is its anchor; equal windows have
equal anchors at equal places, so that an anchor run is a prefix to deal by: only what lies around a prefix that several
documents share is kept (a context, of 75 words at most), and equal contexts are one. Where a prefix has more contexts than
a task may hold, its windows are dealt by longer prefixes of their own, of 30 words, then 35 and so on up to 50,
until a group fits; a prefix that only one document has is a leaf and goes. Each group, whatever its prefix, becomes a
suffix tree: its suffixes sorted, the longest common prefixes of neighbours, and from these the internal nodes. A node of
50 words or more is a repeat; its least document keeps the passage, and others lose it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from territory.llm.base import Scratch, Words, mix, raw_texts, read_table, slices, widened, windows

WINDOW, PREFIX = 50, 25
#: Lengths that a prefix with too many suffixes grows to.
LONGER = (30, 35, 40, 45, 50)
#: Contexts or windows under one prefix that a task takes; those of many prefixes that it sorts at once.
GROUP, AT_ONCE = 4_000, 4_000
#: A repeat within a context: its first word there, its words, and the least document that has it.
REPEATS = "repeats array<struct<place: int, length: int, least: long>>"


def _anchors(words: Words) -> tuple[np.ndarray, ...]:
    """Per anchor: its text, first and last start of the windows it stands for, its place, hashes of prefix and context."""
    none = np.zeros(0, np.int64)
    if len(words) < WINDOW:
        return none, none, none, none, none, none
    hashes = words.hashes()
    runs = windows(hashes, PREFIX)
    last = words.first[1:] - WINDOW
    starts = np.arange(len(words) - WINDOW + 1)
    text = np.searchsorted(words.first[1:], starts, side="right")
    view = np.lib.stride_tricks.sliding_window_view(runs, WINDOW - PREFIX + 1)
    anchor = starts + view.argmin(axis=1)
    inside = starts <= last[text]
    starts, text, anchor = starts[inside], text[inside], anchor[inside]
    if not len(starts):
        return none, none, none, none, none, none
    # an anchor's windows are neighbours within a text
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])))
    at = np.flatnonzero(new)
    first, final = starts[at], starts[np.concatenate((at[1:], [len(starts)])) - 1]
    text, anchor = text[at], anchor[at]
    context = np.zeros(len(at), np.uint64)
    whole = windows(hashes, WINDOW)
    # windows at both ends, at most 25 apart, cover the context
    context = mix(whole[first] + mix(whole[final]) + (final - first).astype(np.uint64) * np.uint64(64) + (anchor - first).astype(np.uint64))
    return text, first, final, anchor, runs[anchor].view(np.int64), context.view(np.int64)


def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        words = Words(raw_texts(batch.column("text")))
        text, first, final, _, prefix, context = _anchors(words)
        which = pa.array(text)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id").take(which), batch.column("print").take(which), pa.array((first - words.first[text]).astype(np.int32)), pa.array((final - first).astype(np.int32)), pa.array(prefix), pa.array(context)],
            names=["id", "print", "at", "span", "prefix", "context"],
        )


def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The word hashes of each wanted context of a document."""
    for batch in slices(batches, "text"):
        words = Words(raw_texts(batch.column("text")))
        hashes, wanted = words.hashes() if len(words) else np.zeros(0, np.uint64), batch.column("wanted")
        owner = np.repeat(words.first[:-1], wanted.value_lengths().to_numpy(zero_copy_only=False))
        rows = wanted.flatten()
        at, span = (rows.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("at", "span"))
        begin = owner + at
        out = [hashes[a:b].tobytes() for a, b in zip(begin.tolist(), (begin + span + WINDOW).tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(rows.field(c) for c in ("prefix", "context", "first", "last", "many")), pa.array(out, pa.binary())], names=["prefix", "context", "first", "last", "many", "tokens"])


class SuffixTree:
    """The deep part of the generalised suffix tree of some token sequences.

    Leaves are the suffixes that begin a whole window. `order` has them sorted, `common` the tokens that each has in common
    with the one before it. Internal nodes are those of `least_depth` tokens or more: `depth`, the first and last leaf below
    (`left`, `right`, places in the order), and `parent` (-1: a shallower node).
    """

    def __init__(self, sequences: list[np.ndarray], least_depth: int = WINDOW) -> None:
        length = np.array([len(x) for x in sequences], np.int64)
        ends = np.cumsum(length + 1)
        begin = ends - length - 1
        n = int(ends[-1]) if len(ends) else 0
        tokens = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends - 1] = False
        tokens[inside] = np.unique(np.concatenate([np.zeros(0, np.uint64), *sequences]), return_inverse=True)[1] + len(sequences)
        tokens[ends - 1] = np.arange(len(sequences))  # each ends in a symbol of its own, so that nothing in common goes on
        leaves = np.maximum(length - least_depth + 1, 0)
        self.sequence = np.repeat(np.arange(len(sequences)), leaves)
        self.place = np.arange(len(self.sequence)) - np.repeat(np.cumsum(leaves) - leaves, leaves)
        start = begin[self.sequence] + self.place
        # prefix doubling: ranks of all suffixes by 1, 2, 4 ... tokens
        ranks, width = [np.unique(tokens, return_inverse=True)[1].astype(np.int32)], 1
        while width < length.max(initial=0):
            later = np.zeros(n, np.int64)
            later[:-width] = ranks[-1][width:] + 1
            ranks.append(np.unique(ranks[-1] * np.int64(n + 2) + later, return_inverse=True)[1].astype(np.int32))
            width *= 2
        self.order = np.argsort(ranks[-1][start], kind="stable") if len(start) else np.zeros(0, np.int64)
        a, b = start[self.order[:-1]], start[self.order[1:]]
        common = np.zeros(max(len(start) - 1, 0), np.int64)
        for k in range(len(ranks) - 1, -1, -1):  # the longest common prefix, in powers of two
            step = 1 << k
            fits = np.maximum(a, b) + common + step <= n
            same = np.zeros(len(common), bool)
            same[fits] = ranks[k][a[fits] + common[fits]] == ranks[k][b[fits] + common[fits]]
            common += same * step
        self.common = np.concatenate(([0], common)) if len(start) else common
        self._nodes(least_depth)

    def _nodes(self, least_depth: int) -> None:
        depth, left, right, parent, open_ = [], [], [], [], []
        edges = np.flatnonzero(self.common >= least_depth)
        shared, at, last = self.common[edges].tolist(), edges.tolist(), -2
        for place, common in zip(at, shared, strict=True):
            if place != last + 1:  # a shallower edge parts it from what was before
                for node in open_:
                    right[node] = last
                open_ = []
            begin, child = place - 1, -1
            while open_ and depth[open_[-1]] > common:
                node = open_.pop()
                right[node] = place - 1
                begin, child = left[node], node
                if open_ and depth[open_[-1]] >= common:
                    parent[node], child = open_[-1], -1
            if not open_ or depth[open_[-1]] < common:
                if child >= 0:
                    parent[child] = len(depth)
                parent.append(open_[-1] if open_ else -1)
                open_.append(len(depth))
                depth.append(common)
                left.append(begin)
                right.append(-1)
            last = place
        for node in open_:
            right[node] = last
        self.depth, self.left, self.right, self.parent = (np.array(x, np.int64) for x in (depth, left, right, parent))

    def repeats(self, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(sequence, place, length, least): what each sequence has in common with documents, `first` being each sequence's own.

        The sequence's own suffixes, and the nodes above whose least document is smaller than all below; without those
        that go on to the left with a document as small.
        """
        n, own = len(self.order), first[self.sequence]
        sorted_own = own[self.order]
        least = np.array([sorted_own[a : b + 1].min() for a, b in zip(self.left.tolist(), self.right.tolist(), strict=True)], np.int64)
        above = np.full(n, -1, np.int64)  # the deepest node above each leaf: nodes are numbered before those below them
        for node, (a, b) in enumerate(zip(self.left.tolist(), self.right.tolist(), strict=True)):
            if self.parent[node] < 0:
                above[a : b + 1] = node
        for node in np.argsort(self.depth, kind="stable").tolist():
            above[self.left[node] : self.right[node] + 1] = node
        node = np.empty(n, np.int64)
        node[self.order] = above
        ends = np.bincount(self.sequence, minlength=len(first)) + WINDOW - 1
        leaf, now = np.arange(n), own.copy()
        found = [(leaf, ends[self.sequence] - self.place, own)]
        while len(leaf):
            leaf, node, now = leaf[node >= 0], node[node >= 0], now[node >= 0]
            lower = least[node] < now
            found.append((leaf[lower], self.depth[node[lower]], least[node[lower]]))
            node, now = self.parent[node], np.where(lower, least[node], now)
        leaf, length, who = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((who, -length, leaf))
        leaf, length, who = leaf[order], length[order], who[order]
        # goes on to the left: the leaf before has a repeat one token longer, at least, with a document as small
        reach = {}
        for i, d, m in zip(leaf.tolist(), length.tolist(), who.tolist(), strict=True):
            reach.setdefault(i, []).append((d, m))
        keep = np.array([not (self.place[i] and any(d2 >= d + 1 and m2 <= m for d2, m2 in reach.get(i - 1, ()))) for i, d, m in zip(leaf.tolist(), length.tolist(), who.tolist(), strict=True)], bool)
        leaf, length, who = leaf[keep], length[keep], who[keep]
        return self.sequence[leaf], self.place[leaf], length, who


def _whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows of a partition sorted by a key, in portions that hold all rows of their keys."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy()
        cuts = np.flatnonzero(np.concatenate(([not held or values[0] != held[-1].column(key)[-1].as_py()], values[1:] != values[:-1])))
        at = 0
        for cut in cuts.tolist():
            if n + cut - at >= AT_ONCE:
                if cut > at:
                    held.append(batch.slice(at, cut - at))
                if held:
                    yield pa.Table.from_batches(held)
                held, n, at = [], 0, cut
        held.append(batch.slice(at))
        n += batch.num_rows - at
    if held:
        yield pa.Table.from_batches(held)


def _tree_repeats(names: list[str], key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The repeats of each sequence that some document after the least one has."""
        for table in _whole_groups(batches, key):
            tree = SuffixTree([np.frombuffer(x, np.uint64) for x in table.column("tokens").to_pylist()])
            sequence, place, length, least = tree.repeats(table.column("first").to_numpy())
            later = least < table.column("last").to_numpy()[sequence]
            order = np.flatnonzero(later)[np.lexsort((place[later], sequence[later]))]
            sequence, place, length, least = sequence[order], place[order], length[order], least[order]
            which, begin = np.unique(sequence, return_index=True)
            if len(which):
                kinds = pa.struct([("place", pa.int32()), ("length", pa.int32()), ("least", pa.int64())])
                rows = pa.StructArray.from_arrays([pa.array(place.astype(np.int32)), pa.array(length.astype(np.int32)), pa.array(least)], fields=list(kinds))
                lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(sequence)).astype(np.int32)), rows)
                yield pa.RecordBatch.from_arrays([*(table.column(c).combine_chunks().take(pa.array(which)) for c in names), lists], names=[*names, "repeats"])

    return run


def _each_window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each window of each context, with the hashes of its prefixes of LONGER words."""
    for batch in batches:
        if not batch.num_rows:
            continue
        tokens = [np.frombuffer(x, np.uint64) for x in batch.column("tokens").to_pylist()]
        n = np.array([len(x) - WINDOW + 1 for x in tokens])
        length = n + WINDOW - 1
        owner = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        start, flat, which = np.repeat(np.cumsum(length) - length, n) + place, np.concatenate(tokens), pa.array(owner)
        hashes = [pa.array(windows(flat, k)[start].view(np.int64)) for k in LONGER]
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(which) for c in ("prefix", "context", "first", "last")), pa.array(place.astype(np.int32)), *hashes], names=["prefix", "context", "first", "last", "place", *(f"p{k}" for k in LONGER)])


def _cut_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = [x[8 * a : 8 * (a + WINDOW)] for x, a in zip(batch.column("tokens").to_pylist(), batch.column("place").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("prefix", "window", "group", "first", "last")), pa.array(tokens, pa.binary())], names=["prefix", "window", "group", "first", "last", "tokens"])


def _longer_prefixes(cut: DataFrame, scratch: Scratch) -> DataFrame:
    """(prefix, context, repeats) of the contexts under prefixes with too many of them."""
    window = f"p{WINDOW}"
    each = scratch.write(cut.where("many").mapInArrow(_each_window, "prefix long, context long, first long, last long, place int, " + ", ".join(f"p{k} long" for k in LONGER)), "each")
    known = [F.first(f"p{k}").alias(f"p{k}") for k in LONGER[:-1]]
    distinct = each.groupBy("prefix", window).agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min(F.struct("context", "place")).alias("at"), *known)
    rest, dealt = scratch.write(distinct, "distinct"), []
    for k in LONGER:
        keys = ["prefix", f"p{k}"]
        sizes = scratch.write(rest.groupBy(*keys).agg(F.count("*").alias("n"), F.min("first").alias("low"), F.max("last").alias("high")).where("low < high").drop("low", "high"), f"sizes{k}")
        sized = scratch.write(rest.join(sizes, keys), f"sized{k}")
        fits = (F.col("n") <= GROUP) | F.lit(k == WINDOW)
        dealt.append(sized.where(fits).select("prefix", F.col(window).alias("window"), F.xxhash64(*keys).alias("group"), "first", "last", "at"))
        rest = sized.where(~fits).drop("n")
        if rest.isEmpty():
            break
    chosen = dealt[0]
    for more in dealt[1:]:
        chosen = chosen.unionByName(more)
    at = chosen.select("prefix", F.col("at.context").alias("context"), F.col("at.place").alias("place"), "window", "group", "first", "last")
    tokens = at.join(cut.where("many").select("prefix", "context", "tokens"), ["prefix", "context"]).mapInArrow(_cut_windows, "prefix long, window long, `group` long, first long, last long, tokens binary")
    found = tokens.repartition("group").sortWithinPartitions("group").mapInArrow(_tree_repeats(["prefix", "window"], "group"), f"prefix long, window long, {REPEATS}")
    found = scratch.write(found.select("prefix", F.col("window").alias(window), F.col("repeats")[0]["least"].alias("least")), "found")  # a window has one repeat: itself
    met = each.select("prefix", "context", "place", window).join(found, ["prefix", window])
    return met.groupBy("prefix", "context").agg(F.sort_array(F.collect_set(F.struct("place", F.lit(WINDOW).alias("length"), "least"))).alias("repeats"))


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of words of each document under repeats that an earlier one has."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column("repeats")
        owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
        rows = lists.flatten()
        place, length, least = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("place", "length", "least"))
        hit = least < batch.column("id").to_numpy()[owner]
        owner, from_ = owner[hit], batch.column("at").to_numpy()[owner[hit]] + place[hit]
        which = pa.array(owner)
        yield pa.RecordBatch.from_arrays([batch.column("id").take(which), batch.column("print").take(which), pa.array(from_.astype(np.int32)), pa.array((from_ + length[hit]).astype(np.int32))], names=["id", "print", "from", "to"])


def _cut_out(batches: Iterator[pa.RecordBatch], id: str, text: str) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, text):
        words = Words(raw_texts(batch.column(text)))
        removed, kept = [], []
        for i, (from_, to) in enumerate(zip(batch.column("__from").to_pylist(), batch.column("__to").to_pylist(), strict=True)):
            base, n = int(words.first[i]), int(words.counts[i])
            gone = np.zeros(n + 1, np.int32)
            if from_:
                np.add.at(gone, from_, 1)
                np.add.at(gone, to, -1)
            stay = base + np.flatnonzero(np.cumsum(gone)[:n] == 0)
            removed.append(n - len(stay))
            kept.append(b" ".join([words.raw[a:b] for a, b in zip(words.start[stay].tolist(), words.end[stay].tolist(), strict=True)]))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c not in ("__from", "__to")), pa.array(words.counts.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=[*(c for c in batch.schema.names if c not in ("__from", "__to")), "n_words", "n_removed", "kept_text"])


def _places(found: DataFrame, scratch: Scratch) -> DataFrame:
    """The places (id, print, at, span, prefix, context) under prefixes that several documents have.

    Tables that are joined are written before: then Spark can split a prefix that very many places share.
    """
    shared = scratch.write(found.groupBy("prefix").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("prefix"), "shared")
    return scratch.write(found.join(shared, "prefix"), "seen")


def repeats(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, print, from, to): ranges of words of (id, print, text) under repeats that a document with a smaller id has."""
    found = scratch.write(docs.mapInArrow(_find_anchors, "id long, print long, at int, span int, prefix long, context long"), "anchors")
    seen = _places(found, scratch)
    scratch.drop("anchors", "shared")
    contexts = seen.groupBy("prefix", "context").agg(F.min(F.struct("id", "print", "at", "span")).alias("first"), F.max("id").alias("last"))
    contexts = scratch.write(contexts, "contexts")
    sizes = scratch.write(contexts.groupBy("prefix").agg((F.count("*") > GROUP).alias("many")), "sizes")
    sized = contexts.join(sizes, "prefix").select("first.*", "prefix", "context", "last", "many")
    wanted = sized.groupBy("id", "print").agg(F.collect_list(F.struct("at", "span", "prefix", "context", F.col("id").alias("first"), "last", "many")).alias("wanted"))
    cut = docs.join(wanted, ["id", "print"]).dropDuplicates(["id", "print"]).mapInArrow(_cut_contexts, "prefix long, context long, first long, last long, many boolean, tokens binary")
    cut = scratch.write(cut, "cut")
    known = cut.where("not many").repartition("prefix").sortWithinPartitions("prefix").mapInArrow(_tree_repeats(["prefix", "context"], "prefix"), f"prefix long, context long, {REPEATS}")
    if not sizes.where("many").isEmpty():
        known = known.unionByName(_longer_prefixes(cut, scratch))
    known = scratch.write(known, "known")
    return seen.join(known, ["prefix", "context"]).mapInArrow(_covered, "id long, print long, from int, to int")


def drop_repeats(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Add n_words, n_removed and kept_text (the kept words joined by a space) to each row.

    Words are runs of bytes other than ASCII white space, unchanged. A word goes if a window of 50 words over
    it also starts in a row with a smaller id; windows are judged on the input. A null or empty text has no words; a
    very long one is one document like any other. Rows with a null id lose nothing and take nothing from others; rows
    that repeat an id don't affect each other. Other columns pass through; columns with the names added here are
    replaced. An empty table gives an empty result.
    """
    scratch = Scratch(df.sparkSession)
    docs = df.select(F.col(id).cast("long").alias("id"), F.xxhash64(text).alias("print"), F.col(text).cast("string").alias("text")).where("id is not null and text is not null")
    ranges = repeats(docs, scratch).groupBy("id", "print").agg(F.collect_list("from").alias("__from"), F.collect_list("to").alias("__to"))
    ranges = scratch.write(ranges, "ranges")
    scratch.drop(*[name for name in scratch.paths if name != "ranges"])
    rest = df.drop("n_words", "n_removed", "kept_text")
    keyed = rest.withColumns({"__id": F.col(id).cast("long"), "__print": F.xxhash64(text)}).join(ranges.withColumnsRenamed({"id": "__id", "print": "__print"}), ["__id", "__print"], "left").select(*rest.columns, "__from", "__to")
    return keyed.mapInArrow(lambda batches: _cut_out(batches, id, text), widened(rest, n_words="long", n_removed="long", kept_text="string"))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
f AS (SELECT h, min(doc_id) AS first FROM p GROUP BY h),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM p JOIN f USING (h) WHERE first < doc_id),
r AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id),
k AS (SELECT w.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
             CASE WHEN gone IS NULL THEN w ELSE list_select(w, list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i))) END AS kept
      FROM w LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
