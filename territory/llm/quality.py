"""Document quality by boosted trees over document statistics (operator 7).

Trees grow on histograms of binned statistics; they are complete binary trees in flat arrays, so that
all documents of a batch walk down a tree together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from territory.llm.base import PIECE, Scratch, Words, crc_remainder, mix, raw_texts, read_table, slices, widened, windows
from territory.llm.labelled import FIT_ROWS, labelled_sample

TREES, DEPTH, RATE, BINS, RIDGE, LEAST = 80, 4, 0.15, 32, 1.0, 1e-3
KINDS = ("lower", "upper", "digit", "space", "newline", "stop", "exclaim", "bar", "symbol", "other", "beyond")
STATISTICS = (
    *(f"share_{k}" for k in KINDS), "log_bytes", "log_words", "mean_word", "long_words", "short_words", "distinct_words", "distinct_pairs",
    "commonest_word", "repeats_before", "capital_share", "bytes_per_line",
)


def _kind_table() -> np.ndarray:
    groups = {"digit": "0123456789", "space": " \t", "newline": "\n\r", "stop": ".,;:?", "exclaim": "!", "bar": "|", "symbol": "#$%&*@+=<>^~_{}[]\\/"}
    table = np.full(256, KINDS.index("other"), np.int64)
    table[128:] = KINDS.index("beyond")
    table[97:123], table[65:91] = KINDS.index("lower"), KINDS.index("upper")
    for kind, chars in groups.items():
        table[[ord(c) for c in chars]] = KINDS.index(kind)
    return table


_KIND = _kind_table()


def _per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values)))
    return total[first[1:]] - total[first[:-1]]


def _distinct(keys: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many distinct keys each owner has, and how often its commonest."""
    salted = mix(keys + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, at, count = np.unique(salted, return_index=True, return_counts=True)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, owner[at], count)
    return np.bincount(owner[at], minlength=n), most


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of STATISTICS for each text; all zero for an empty one."""
    n = len(texts)
    size = np.array([len(t) for t in texts], np.int64)
    words = Words(texts)
    ends, kinds = np.cumsum(size + 1), np.zeros((n, len(KINDS)), np.int64)
    for at in range(0, len(words.bytes), PIECE):  # a long text in pieces
        part = words.bytes[at : at + PIECE]
        first, last = np.searchsorted(ends, [at, at + len(part) - 1], side="right")
        owner = np.searchsorted(ends[first : last + 1], np.arange(at, at + len(part)), side="right")
        kinds[first : last + 1] += np.bincount(owner * len(KINDS) + _KIND[part], minlength=(last - first + 1) * len(KINDS)).reshape(-1, len(KINDS))
    kinds[:, KINDS.index("newline")] -= 1  # the line feed that ends each text in the buffer
    hashes, of, count = words.hashes(), words.text_of_word(), np.maximum(words.counts, 1)
    length = words.end - words.start
    distinct, most = _distinct(hashes, of, n)
    pairs = windows(hashes, 2)
    inside = of[1:] == of[:-1]
    distinct_pairs, _ = _distinct(pairs[inside], of[:-1][inside], n)
    repeats = np.bincount(of[1:][inside & (hashes[1:] == hashes[:-1])], minlength=n)
    bytes_ = np.maximum(size, 1)
    letters = kinds[:, 0] + kinds[:, 1]
    return np.column_stack(
        (
            kinds / bytes_[:, None], np.log1p(size), np.log1p(words.counts), _per_text(length, words.first) / count, _per_text(length > 12, words.first) / count,
            _per_text(length <= 3, words.first) / count, distinct / count, distinct_pairs / np.maximum(words.counts - 1, 1), most / count, repeats / count,
            kinds[:, 1] / np.maximum(letters, 1), size / (kinds[:, KINDS.index("newline")] + 1),
        )
    )


class Trees:
    """Boosted trees as flat arrays: node i of a tree has the children 2 i + 1 and 2 i + 2."""

    def __init__(self, prior: float) -> None:
        self.prior = prior
        self.feature = np.zeros((0, 2**DEPTH - 1), np.int64)
        self.threshold = np.zeros((0, 2**DEPTH - 1))
        self.value = np.zeros((0, 2**DEPTH))

    def scores(self, x: np.ndarray) -> np.ndarray:
        margin, rows = np.full(len(x), self.prior), np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            margin += value[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-margin))

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray) -> Trees:
        """Newton steps on the logistic loss; each level of a tree is grown from one histogram of all its nodes."""
        share = float(np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6))
        model = Trees(float(np.log(share / (1 - share))))
        if len(np.unique(y)) < 2:
            return model
        wide = x.shape[1]
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(wide)]
        binned = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])  # bin b: x <= edges[b]
        flat = binned + np.arange(wide) * BINS
        margin = np.full(len(x), model.prior)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            slope, bend = y - p, p * (1 - p)
            feature, threshold, node = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf), np.zeros(len(x), np.int64)
            for level in range(DEPTH):
                base, nodes = 2**level - 1, 2**level
                cell = ((node - base)[:, None] * (wide * BINS) + flat).ravel()
                g, h = (np.bincount(cell, np.repeat(v, wide), nodes * wide * BINS).reshape(nodes, wide, BINS).cumsum(axis=2) for v in (slope, bend))
                total_g, total_h = g[:, :, -1:], h[:, :, -1:]
                gain = g**2 / (h + RIDGE) + (total_g - g) ** 2 / (total_h - h + RIDGE) - total_g**2 / (total_h + RIDGE)
                gain[(h < LEAST) | (total_h - h < LEAST)] = 0
                for f, e in enumerate(edges):
                    gain[:, f, len(e) :] = 0
                best = gain.reshape(nodes, -1).argmax(axis=1)
                for i, b in enumerate(best.tolist()):
                    if gain[i].flat[b] > 1e-9:
                        feature[base + i], threshold[base + i] = b // BINS, edges[b // BINS][b % BINS]
                node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > threshold[node])
            leaf = node - (2**DEPTH - 1)
            value = RATE * np.bincount(leaf, slope, 2**DEPTH) / (np.bincount(leaf, bend, 2**DEPTH) + RIDGE)
            margin += value[leaf]
            model.feature, model.threshold, model.value = (np.vstack((a, b)) for a, b in ((model.feature, feature), (model.threshold, threshold), (model.value, value)))
        return model


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        yield pa.RecordBatch.from_arrays([pa.array(list(statistics(raw_texts(batch.column("text")))), pa.list_(pa.float64())), batch.column("y")], names=["x", "y"])


def fit(sample: DataFrame) -> Trees:
    """Trees from (text, y); the sample's statistics, not its texts, come to the driver."""
    rows = sample.select("text", "y").mapInArrow(_measure, "x array<double>, y int").toArrow().to_pandas()
    return Trees.fit(np.array(rows["x"].tolist(), np.float64).reshape(len(rows), len(STATISTICS)), rows["y"].to_numpy(np.float64))


def score(df: DataFrame, model: Trees, text: str = "text") -> DataFrame:
    """Add `score` to each row; a null text counts as empty. A column of that name is replaced."""
    kept = df.drop("score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(statistics(raw_texts(batch.column(text)))))], names=[*batch.schema.names, "score"])

    return kept.mapInArrow(run, widened(kept, score="double"))


def classify(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of `documents`, learnt from labels.quality outside the held-out fold.

    Every row is scored, null and empty texts too; a null doc_id is in no fold. Without labels, or with labels of
    one kind only, each score is the share of label 1 (nearly 0 or 1). Repeated rows are scored each, a very long text as
    one document; an empty table gives an empty result.
    """
    scratch = Scratch(documents.sparkSession)
    docs = documents.select(F.col("doc_id").alias("id"), "text")
    model = fit(scratch.write(labelled_sample(docs, labels, "quality", rows=rows), "sample"))
    scratch.drop("sample")
    scored = score(documents.select("doc_id", "text"), model)
    return scored.select("doc_id", (crc_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
