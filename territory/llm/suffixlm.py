"""A probabilistic suffix tree over words that scores texts, above a smoothed unigram base (operator 10).

Symbols are the lower-cased words of a text and its end; contexts are the words before, back to the text's begin. The
root has the base's unigram probabilities. A context is a state if it occurs twice at least and its next symbols
diverge from what its suffix predicts; its distribution is smoothed by its suffix's. A symbol is scored by the
longest suffix of what is before it that is a state.

Texts are packed in blocks of word numbers. The tree grows a level at a time: each block asks for the runs of words that
can matter (context and next symbol), dealt by a hash of the context, so that a group has all that follows a context,
counts it, tests it and answers. Only contexts that occur twice go a word further back, and none whose next symbol is
certain, as no longer context can then diverge. What is counted grows with the corpus, and nothing of it is broadcast.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from territory.llm.base import Scratch, Words, crc_remainder, give_back, mix, raw_texts, read_table, slices

#: Words of the longest context, and how often a context must occur, however large the corpus is.
DEPTH, LEAST_COUNT = 3, 2
#: Nats that a state's distribution gains over its suffix's in training, at least; and what each symbol after a state gives up to symbols that weren't seen there.
LEAST_GAIN, DISCOUNT = 6.0, 0.75
#: Of a key, the context has the upper bits and the next symbol the lower ones. A context's group adds to its bits: as groups
#: don't grow, about one context in 4000 shares a key with another, at any size of corpus.
CONTEXT_BITS, NEXT_BITS = 32, 24
#: Steps of a probability's logarithm that a block tells a group.
STEPS = 8
BEGIN, END = np.uint64(0x0B0E61D5), np.uint64(0x0E0DE0D5)

_LOW = np.uint64((1 << (64 - CONTEXT_BITS)) - 1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
ASKS = "block long, `group` int, keys binary, counts binary, lower binary"
ANSWERS = "block long, `group` int, n binary, kinds binary, distinct long"
BLOCKS = "block long, words binary, tokens binary, lengths binary, ids binary, nulls binary, train binary, train_words long, train_texts long, all_tokens long"
SCORES = "id long, train boolean, n_tokens long, n_known long, base double, score double"


class Sizes(NamedTuple):
    """How the work is dealt; scores don't depend on it."""

    block_bytes: int = 6 << 20  #: text in a block
    group_tokens: int = 1_500_000  #: tokens for each group of contexts
    split: int = 1_000_000  #: occurrences of a context from which on several groups share it


def _pack(values: np.ndarray) -> bytes:
    """Bytes of the same place in all numbers together, which compress well; the first number's width comes first."""
    planes = values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes() if len(values) else b""
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True) if planes else b""


def _unpack(data: bytes, kind: type) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    planes = pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _pack_keys(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, np.uint64), dtype=np.uint64)


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [(name.strip("`"), kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.table([pa.array(list(c), kind) for c, (_, kind) in zip(columns, fields, strict=True)], names=[name for name, _ in fields])


def _packed_block(block: int, parts: list[tuple]) -> pa.Table:
    """Texts together: their distinct words, commonest first, and each word's number; by text its words, id and fold."""
    hashes, lengths, ids, nulls, train = (np.concatenate(x) for x in zip(*parts, strict=True))
    words, which, n = np.unique(hashes, return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")
    number = np.empty(len(words), np.uint32)
    number[order] = np.arange(len(words), dtype=np.uint32)
    packed = (_pack(x) for x in (words[order], number[which], lengths, ids, nulls, train))
    return _table(BLOCKS, [(block, *packed, int(lengths[train > 0].sum()), int(train.sum()), int(lengths.sum()) + len(lengths))])


def _cut_blocks(block_bytes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, parts = TaskContext.get().partitionId() << 32, 0, []
        for batch in slices(batches, "text"):
            words = Words(raw_texts(batch.column("text")), lower=True)
            ids = batch.column("id")
            parts.append((
                words.hashes() if len(words) else np.zeros(0, np.uint64), words.counts.astype(np.int64), ids.fill_null(0).to_numpy().astype(np.int64),
                ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8), batch.column("train").to_numpy(zero_copy_only=False).astype(np.uint8),
            ))
            held += len(words.raw)
            if held >= block_bytes:
                yield from _packed_block(block, parts).to_batches()
                block, held, parts = block + 1, 0, []
        if parts:
            yield from _packed_block(block, parts).to_batches()
        give_back()

    return run


def dealt(keys: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys by group, their groups, and the place of each key among them."""
    small = len(group) and int(group.max()) < 1 << 16
    order = np.lexsort((keys, group.astype(np.uint16) if small else group))  # small numbers sort faster
    k, g = keys[order], group[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (g[1:] != g[:-1])
    which = np.empty(len(k), np.int64)
    which[order] = np.cumsum(new) - 1
    return k[new], g[new], which


def _ask_rows(block: int, keys: np.ndarray, group: np.ndarray, counts: np.ndarray, lower: np.ndarray) -> list[tuple]:
    cut = np.flatnonzero(np.diff(group, prepend=-1, append=-1))
    return [(block, int(group[a]), _pack_keys(keys[a:b]), _pack(counts[a:b].astype(np.uint32)), _pack(lower[a:b])) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def _split_group(context: np.ndarray, salt: np.ndarray, groups: int) -> np.ndarray:
    """The group of a part of a context that several groups share; such groups are numbered after the others."""
    return groups + (mix(context * _STEP + salt.astype(np.uint64)) % np.uint64(groups)).astype(np.int64)


class Block:
    """The texts of a block, scored with the levels that have been answered."""

    def __init__(self, row: dict, groups: int, split: int) -> None:
        self.block, self.groups, self.split = row["block"], groups, split
        self.words, self.ids = _unpack(row["words"], np.uint64), _unpack(row["ids"], np.int64)
        self.numbers, self.lengths = _unpack(row["tokens"], np.uint32).astype(np.int64), _unpack(row["lengths"], np.int64)
        self.nulls, self.train = _unpack(row["nulls"], np.uint8).astype(bool), _unpack(row["train"], np.uint8).astype(bool)

    def word_keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return dealt(self.words, (mix(self.words + _STEP) % np.uint64(self.groups)).astype(np.int64))

    def ask_words(self) -> list[tuple]:
        keys, group, which = self.word_keys()
        counts = np.zeros(len(keys), np.int64)
        counts[which] = np.bincount(self.numbers, np.repeat(self.train, self.lengths), len(self.words)).astype(np.int64)
        return _ask_rows(self.block, keys, group, counts, np.zeros(len(keys), np.uint8))

    def begin(self, word_counts: np.ndarray, texts: int, size: float) -> None:
        """Lay the texts out, each after its begin and before its end, with the root's probabilities."""
        width = self.lengths + 2
        ends = np.cumsum(width)
        n = int(ends[-1])
        self.first = ends - width
        inside = np.ones(n, bool)
        inside[self.first] = inside[ends - 1] = False
        counts = np.zeros(len(self.words), np.int64)
        counts[:] = word_counts[self.word_keys()[2]]
        self.symbol, self.n = np.full(n, END), np.full(n, texts, np.int64)
        self.symbol[self.first] = BEGIN
        self.symbol[inside], self.n[inside] = self.words[self.numbers], counts[self.numbers]
        self.room = np.arange(n) - np.repeat(self.first, width)  # symbols of the text before each, with its begin
        self.p = (self.n + 1) / size
        self.p[self.first] = 1.0
        self.base = np.add.reduceat(np.log10(self.p), self.first)
        known = self.n > 0
        known[self.first] = False
        self.n_known = np.add.reduceat(known.astype(np.int64), self.first)
        self.trained = np.repeat(self.train, width)
        self.context = np.zeros(n, np.uint64)
        self.open, self.certain = self.room > 0, np.zeros(n, bool)

    def runs(self, level: int) -> tuple[np.ndarray, ...]:
        """Places whose context of `level` symbols may be a state, how often it occurs, and their keys as they are dealt."""
        self.before = np.zeros(len(self.n), np.int64)
        self.before[1:] = self.n[:-1]
        self.before[self.room < level] = 0
        at = np.flatnonzero(self.room >= level)
        self.context[at] = mix(self.context[at] * _STEP + self.symbol[at - level])
        at = np.flatnonzero(self.open & (self.before >= LEAST_COUNT))
        total, context, after = self.before[at], self.context[at], mix(self.symbol[at]) >> np.uint64(64 - NEXT_BITS)
        group = ((context & _LOW) % np.uint64(self.groups)).astype(np.int64)
        shared = total > self.split
        if shared.any():
            salt = after[shared] % (-(-total[shared] // self.split)).astype(np.uint64)
            group[shared] = _split_group(context[shared] >> np.uint64(64 - CONTEXT_BITS), salt, self.groups)
        return at, total, *dealt(context >> np.uint64(64 - CONTEXT_BITS) << np.uint64(NEXT_BITS) | after, group)

    def ask(self, level: int) -> list[tuple]:
        at, _, keys, group, which = self.runs(level)
        lower = np.zeros(len(keys), np.uint8)
        lower[which] = np.where(self.n[at] >= 2, quantised(self.p[at]), 0)  # what a symbol needs that may occur twice here
        return _ask_rows(self.block, keys, group, np.bincount(which, self.trained[at], len(keys)), lower)

    def take(self, level: int, n: np.ndarray, kinds: np.ndarray) -> None:
        """Go on to the next level with the answers: counts of runs, and different symbols after each context, negative if it is no state."""
        at, total, _, _, which = self.runs(level)
        now = np.where(self.certain, self.before, 0)  # after a context with one next symbol, longer ones have it as well
        now[at] = n[which]
        own, after = now[at], np.abs(kinds[which])
        state = kinds[which] > 0
        self.p[at[state]] = (np.maximum(own - DISCOUNT, 0) / total + DISCOUNT * after / total * self.p[at])[state]
        self.certain[at[(after == 1) & (own > 0)]] = True
        self.open[:] = False
        self.open[at[after > 1]] = True
        self.n = now

    def scores(self) -> list[tuple]:
        each = np.add.reduceat(np.log10(self.p), self.first)
        ids = [None if null else i for i, null in zip(self.ids.tolist(), self.nulls.tolist(), strict=True)]
        return list(zip(ids, self.train.tolist(), (self.lengths + 1).tolist(), self.n_known.tolist(), self.base.tolist(), each.tolist(), strict=True))


def quantised(p: np.ndarray) -> np.ndarray:
    """-ln p in steps of 1/8."""
    return np.minimum(np.rint(-STEPS * np.log(p)), 255).astype(np.uint8)


class Tally:
    """Counts of one group's runs, and what they tell of each context."""

    def __init__(self, asks: pa.Table) -> None:
        keys = [_unpack_keys(x) for x in asks.column("keys").to_pylist()]
        self.ends = np.cumsum([len(k) for k in keys])
        self.keys, self.which = np.unique(np.concatenate([np.zeros(0, np.uint64), *keys]), return_inverse=True)
        counts = np.concatenate([np.zeros(0, np.uint32), *(_unpack(x, np.uint32) for x in asks.column("counts").to_pylist())])
        self.n = np.bincount(self.which, counts, len(self.keys)).astype(np.int64)
        lower = np.zeros(len(self.keys))
        lower[self.which] = np.concatenate([np.zeros(0, np.uint8), *(_unpack(x, np.uint8) for x in asks.column("lower").to_pylist())]) / -float(STEPS)
        context = self.keys >> np.uint64(NEXT_BITS)
        begin = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(context) else np.zeros(0, np.int64)
        self.context, self.of = context[begin], np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(context))))
        often = self.n >= 2
        sums = lambda x: np.add.reduceat(x, begin) if len(begin) else np.zeros(0)
        self.kinds, self.total, self.often, self.share = sums((self.n > 0).astype(np.int64)), sums(self.n), sums(self.n * often), sums(np.exp(lower) * often)
        self.surprise = sums(np.where(often, self.n * (np.log(np.maximum(self.n, 1)) - lower), 0.0))

    def answers(self, asks: pa.Table, kinds: np.ndarray) -> pa.Table:
        """One row for each asking block; the number of distinct words goes with the first."""
        kinds, rows = kinds[self.of] if len(kinds) else np.zeros(len(self.keys), np.int64), []
        for i, (block, group, end) in enumerate(zip(asks.column("block").to_pylist(), asks.column("group").to_pylist(), self.ends.tolist(), strict=True)):
            which = self.which[self.ends[i - 1] if i else 0 : end]
            rows.append((block, group, _pack(self.n[which].astype(np.uint32)), _pack(np.diff(kinds[which].astype(np.int32), prepend=np.int32(0))), 0 if i else int((self.n > 0).sum())))
        return _table(ANSWERS, rows)


def diverges(total, often, share, surprise) -> np.ndarray:
    """Whether contexts gain enough over their suffixes: symbols seen twice or more each, and all others together."""
    rest = total - often
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = surprise - often * np.log(total) + np.where(rest > 0, rest * (np.log(rest / total) - np.log(np.maximum(1 - share, 1e-9))), 0.0)
    return (often > 0) & (gain >= LEAST_GAIN)


def _count_words(asks: pa.Table) -> pa.Table:
    return (tally := Tally(asks)).answers(asks, np.zeros(0, np.int64))


def _count_runs(asks: pa.Table) -> pa.Table:
    tally = Tally(asks)
    state = diverges(tally.total, tally.often, tally.share, tally.surprise)
    return tally.answers(asks, np.where(state, tally.kinds, -tally.kinds))


def _count_parts(asks: pa.Table) -> pa.Table:
    """What one group knows of contexts that several groups share."""
    tally = Tally(asks)
    return pa.table({"context": tally.context.astype(np.int64), "kinds": tally.kinds, "total": tally.total, "often": tally.often, "share": tally.share, "surprise": tally.surprise})


def _spread(groups: int, split: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each shared context's answer for all groups that have a part of it."""
        for batch in batches:
            context, total = (batch.column(c).to_numpy() for c in ("context", "total"))
            state = diverges(*(batch.column(c).to_numpy() for c in ("total", "often", "share", "surprise")))
            kinds = np.where(state, 1, -1) * batch.column("kinds").to_numpy()
            parts = -(-total // split)
            owner = np.repeat(np.arange(len(parts)), parts)
            salt = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
            group = _split_group(context[owner].astype(np.uint64), salt, groups).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(context[owner]), pa.array(kinds[owner])], names=["group", "context", "kinds"])

    return run


def _answer_parts(asks: pa.Table, shared: pa.Table) -> pa.Table:
    tally = Tally(asks)
    known = dict(zip(shared.column("context").to_pylist(), shared.column("kinds").to_pylist(), strict=True))
    return tally.answers(asks, np.array([known[c] for c in tally.context.tolist()], np.int64))


def _replayed(texts: int, size: float, groups: int, split: int, level: int | None) -> Callable:
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        """A block's questions about a level, or its scores, after the answers about the levels before."""
        rows: list[tuple] = []
        by: dict[int, list] = {}
        for depth, group, n, kinds in sorted(zip(*(answers.column(c).to_pylist() for c in ("level", "group", "n", "kinds")), strict=True), key=lambda r: r[:2]):
            by.setdefault(depth, []).append((_unpack(n, np.uint32).astype(np.int64), np.cumsum(_unpack(kinds, np.int32).astype(np.int64))))
        none = [(np.zeros(0, np.int64),) * 2]
        for row in blocks.to_pylist():
            block = Block(row, groups, split)
            block.begin(np.concatenate([n for n, _ in by.get(0, none)]), texts, size)
            for depth in range(1, max(by, default=0) + 1):
                block.take(depth, *(np.concatenate(x) for x in zip(*by.get(depth, none), strict=True)))
            rows += block.scores() if level is None else block.ask(level)
        out = _table(SCORES if level is None else ASKS, rows)
        del rows, by
        give_back()
        return out

    return run


def _ask_words(groups: int, split: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _table(ASKS, Block(row, groups, split).ask_words()).to_batches()

    return run


class _Bucketed:
    """A table of the shared folder whose buckets later cogroups read as they are, without a shuffle."""

    def __init__(self, spark: SparkSession, kind: str, by: str, scratch: Scratch) -> None:
        self.spark, self.by, self.name, self.buckets = spark, by, f"{kind}_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.path = scratch.paths[kind] = f"{scratch.root}/{self.name}"
        scratch.tables.append(self.name)

    def add(self, df: DataFrame) -> DataFrame:
        """The whole table after some more rows, which are shuffled once, or not if they come by their buckets."""
        df.write.option("compression", "zstd").option("path", self.path).bucketBy(self.buckets, self.by).mode("append").saveAsTable(self.name)
        return self.spark.table(self.name)

    def deal(self, df: DataFrame) -> DataFrame:
        return self.add(df.repartition(self.buckets, self.by))


def score(documents: DataFrame, modulus: int = 7, held: int = 2, sizes: Sizes = Sizes()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row.

    Learnt from rows outside the held-out fold; a null doc_id is in no fold. A null text counts as empty: one end.
    Repeated rows count, and are scored, each. Words that are as common count alike. A very long text is a block of its
    own. Without training rows N is 0, V is 0 and no token is known; an empty table gives an empty result. Other columns
    aren't read.
    """
    scratch = Scratch(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("train", crc_remainder(F.col("id"), modulus) != held)
    blocks = _Bucketed(documents.sparkSession, "blocks", "block", scratch).add(docs.mapInArrow(_cut_blocks(sizes.block_bytes), BLOCKS))
    words, texts, tokens = blocks.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("train_words", "train_texts", "all_tokens"))).first()
    groups = 1 + tokens // sizes.group_tokens
    asks = scratch.write(blocks.mapInArrow(_ask_words(groups, sizes.split), ASKS), "asks")
    # answers go to their blocks once, and wait there for the levels after
    answered = _Bucketed(documents.sparkSession, "answers", "block", scratch)
    answers = answered.deal(asks.groupBy("group").applyInArrow(_count_words, ANSWERS).withColumn("level", F.lit(0)))
    scratch.drop("asks")
    distinct = answers.agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0]
    total = words + texts
    size = float(total + distinct + (texts > 0) + 1)
    replayed = lambda level: blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_replayed(texts, size, groups, sizes.split, level), SCORES if level is None else ASKS)
    for level in range(1, DEPTH + 1):
        asks = scratch.write(replayed(level), "asks")
        if asks.isEmpty():
            break
        found = asks.where(F.col("group") < groups).groupBy("group").applyInArrow(_count_runs, ANSWERS)
        parts = asks.where(F.col("group") >= groups)
        if not parts.isEmpty():
            shared = parts.groupBy("group").applyInArrow(_count_parts, "context long, kinds long, total long, often long, share double, surprise double")
            shared = shared.groupBy("context").agg(*(F.sum(c).alias(c) for c in ("kinds", "total", "often", "share", "surprise")))
            shared = scratch.write(shared.mapInArrow(_spread(groups, sizes.split), "`group` int, context long, kinds long"), "shared")
            found = found.unionByName(parts.groupBy("group").cogroup(shared.groupBy("group")).applyInArrow(_answer_parts, ANSWERS))
        answers = answered.deal(found.withColumn("level", F.lit(level)))
        scratch.drop("asks")
    rows = replayed(None)
    return rows.select(
        F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score",
    )


def op10_suffixlm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read_table(spark, sf_dir, "documents"))
