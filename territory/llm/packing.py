"""Packing of documents into sequences of bounded length (operator 12).

The tokens of all documents of a partition lie one after the other, and windows are cut from them in that order. Where to cut is
a shortest path over document ends, sentence ends and, in long runs without either, positions at a fixed distance: a window costs its padding,
what its end tears apart, and a little for being one. Padding falls linearly with length, so the best start of a window comes
from a monotone queue; a window whose length is a power of two needs no padding and is a transition of its own.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from territory.llm.base import CHUNK_BYTES, give_back, parts, raw_texts, read_table, slices, small_batches
from territory.llm.bpe import Bpe, flat, vocabulary_path

#: What a cut costs after a sentence and inside one, and a window besides its padding, in tokens of padding.
SENTENCE, INSIDE, WINDOW = 8, 64, 16
#: Tokens without a sentence end after which a cut is considered anyway.
RUN = 128
#: Tokens whose windows are chosen at once; the last two windows are chosen again with what follows.
CHUNK = 1 << 19
#: Bits of a sequence's number within its partition.
NUMBER_BITS = 40


def sentence_ends(bpe: Bpe) -> np.ndarray:
    """Which tokens of the vocabulary end a sentence."""
    table = np.zeros(len(bpe.tokens), bool)
    for i, token in enumerate(bpe.tokens):
        word = token.removesuffix("</w>")
        table[i] = word != token and word.rstrip("\"')]}»”’").endswith((".", "!", "?", "…", "。", "！", "？"))
    return table


def places(ends: np.ndarray, documents: np.ndarray, n: int, size: int, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where a window may be cut, 0 and n included, and what each cut costs.

    `ends` are the positions after sentences, `documents` those after documents. In the last stretch of a partition every
    position counts, so that the rest of the stream can be cut into powers of two.
    """
    cost = {SENTENCE: ends, 0: documents}
    known = np.unique(np.concatenate((np.array([0, n], np.int64), ends, documents)))
    gap, run = np.diff(known), min(RUN, size)
    wide = np.flatnonzero(gap > run)
    steps = (gap[wide] - 1) // run
    inside = np.repeat(known[wide], steps) + run * (np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps) + 1)
    if last:
        inside = np.concatenate((inside, np.arange(max(0, n - 2 * size), n)))
    at = np.unique(np.concatenate((known, inside)))
    price = np.full(len(at), INSIDE, np.int64)
    for c, where in cost.items():
        price[np.searchsorted(at, where)] = c
    return at, price


def cuts(at: np.ndarray, price: np.ndarray, size: int, whole: bool = True) -> list[int]:
    """The cheapest ends of windows from the first to the last of some places, of which neighbours are `size` apart at most.

    Unless `whole`, more is to come, and the last window ends where the cost is least for what it covers.
    """
    n = int(at[-1])
    index = np.full(n + 1, -1, np.int64)
    index[at] = np.arange(len(at))
    pairs = []
    power = 1
    while power <= size:  # windows that need no padding
        to = np.flatnonzero(at >= power)
        from_ = index[at[to] - power]
        pairs.append(np.stack((to[from_ >= 0], from_[from_ >= 0])))
        power *= 2
    to, from_ = np.concatenate(pairs, axis=1)
    order = np.lexsort((from_, to))
    starts = np.searchsorted(to[order], np.arange(len(at) + 1)).tolist()
    exact, position, price = from_[order].tolist(), at.tolist(), price.tolist()
    best, back = [0] * len(position), [0] * len(position)
    queue: deque[int] = deque([0])
    keys = [0] * len(position)  # cost so far and position: what a padded window from there costs, but for a term of its end
    for i in range(1, len(position)):
        here = position[i]
        while position[queue[0]] < here - size:
            queue.popleft()
        source = queue[0]
        cost = keys[source] + size - here
        for j in exact[starts[i] : starts[i + 1]]:
            if best[j] < cost:
                cost, source = best[j], j
        best[i], back[i] = cost + price[i] + WINDOW, source
        keys[i] = best[i] + here
        while queue and keys[queue[-1]] >= keys[i]:
            queue.pop()
        queue.append(i)
    found = [len(position) - 1]
    if not whole:
        rate = best[-1] / n
        found = [min((i for i in range(1, len(position)) if position[i] > n - size), key=lambda i: best[i] - rate * position[i])]
    while found[-1]:
        found.append(back[found[-1]])
    return [position[i] for i in reversed(found)]


class Stream:
    """The tokens of a partition's documents in order, cut into windows as they come."""

    def __init__(self, size: int, ends: np.ndarray, chunk: int = CHUNK) -> None:
        self.size, self.ends, self.chunk = size, ends, chunk
        self.held: list[np.ndarray] = []  # tokens that no window has yet
        self.length = self.base = self.number = 0  # how many, the first one's place in the partition, windows so far
        self.documents: deque[list] = deque()  # [id, first place, end or None while more is to come] of those that may get pieces
        self.waiting: list[tuple] = []  # pieces of a document whose end isn't known

    def begin(self, id: int | None) -> None:
        self.documents.append([id, self.base + self.length, None])

    def add(self, ids: np.ndarray) -> Iterator[tuple]:
        self.held.append(ids)
        self.length += len(ids)
        if self.length >= self.chunk:
            yield from self._cut(False)

    def finish(self, ids: np.ndarray) -> Iterator[tuple]:
        """The last tokens of a document."""
        self.documents[-1][2] = self.base + self.length + len(ids)
        yield from self.add(ids)

    def close(self) -> Iterator[tuple]:
        if self.length:
            yield from self._cut(True)

    def _cut(self, last: bool) -> Iterator[tuple]:
        tokens = np.concatenate(self.held)
        done = np.array([d[2] for d in self.documents if d[2] is not None and d[2] > self.base], np.int64) - self.base
        at, price = places(np.flatnonzero(self.ends[tokens]) + 1, done, len(tokens), self.size, last)
        found = cuts(at, price, self.size, last)
        found = found if last or len(found) < 4 else found[:-2]  # the last windows are chosen when more is known
        for a, b in zip(found, found[1:], strict=False):
            place = a
            while place < b:
                id, first, end = self.documents[0]
                to = b if end is None else min(b, end - self.base)
                piece = (id, self.base + place - first, tokens[place:to].tobytes(), self.number, place - a)
                self.waiting.append(piece)
                place = to
                if end is not None and place == end - self.base:
                    for p in self.waiting:
                        yield (*p, end - first)
                    self.waiting.clear()
                    self.documents.popleft()
            self.number += 1
        self.held, self.length = [tokens[found[-1] :]], len(tokens) - found[-1]
        self.base += found[-1]


def pack(df: DataFrame, vocabulary: str, id: str = "doc_id", text: str = "text", size: int = 2048, end: int = 1) -> DataFrame:
    """(id, start, ids, sequence_id, offset, doc_tokens): the pieces of each row's tokens in sequences of at most `size` tokens.

    A text's tokens are its ids in the vocabulary and then `end`. Each partition packs its own rows in their order, so nothing is
    shuffled; a sequence's number holds the partition's. Texts are whole: a very long one is encoded and cut in parts. Pieces follow
    one another in a document (`start`) and, without gaps, in a sequence (`offset`); ids are little-endian unsigned 32-bit integers.

    A null or empty text is the end token alone. Rows that repeat, or that share an id or have none, are packed each. An empty
    table gives an empty result. Equally cheap cuts: the window that starts earlier, a padded one before one of a power of two.
    Other columns aren't read.
    """
    if size < 1:
        raise ValueError("a sequence has one token at least")
    small_batches(df.sparkSession)
    columns = ("id", "start", "ids", "sequence", "offset", "doc_tokens")
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        encode = flat(vocabulary)
        stream, last = Stream(size, sentence_ends(encode.bpe)), np.array([end], "<u4")
        for batch in slices(batches, "text"):
            texts, keys = raw_texts(batch.column("text")), batch.column("id").to_pylist()
            if len(texts) > 1 or len(texts[0]) <= CHUNK_BYTES:
                ids, counts = encode(texts)
                for key, own in zip(keys, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
                    stream.begin(key)
                    yield from stream.finish(np.concatenate((own, last)))
            else:
                stream.begin(keys[0])
                for part in parts(texts[0]):
                    yield from stream.add(encode([part])[0])
                yield from stream.finish(last)
        yield from stream.close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, weight = TaskContext.get().partitionId() << NUMBER_BITS, [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=columns)

        for i, start, ids, number, offset, total in pieces(batches):
            held.append((i, start, ids, first + number, offset, total))
            weight += len(ids) + 64
            if weight > CHUNK_BYTES:
                yield batch()
                held, weight = [], 0
                give_back()
        if held:
            yield batch()

    rows = df.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    packed = rows.mapInArrow(run, "id long, start long, ids binary, sequence long, offset long, doc_tokens long")
    return packed.select(F.col("id").alias(id), "start", "ids", F.col("sequence").alias("sequence_id"), "offset", "doc_tokens")


def op12_packing(spark, sf_dir: str) -> DataFrame:
    packed = pack(read_table(spark, sf_dir, "documents"), vocabulary_path())
    return packed.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
