"""Toxicity from the nearest labelled examples (operator 3).

Texts are TF-IDF vectors over words and word stems: all that two labelled documents have and that tell anything of the
labels. Document frequencies are those of all documents; a term's weight also has how much it tells the labels apart, as
otherwise a text's language and topic would choose its neighbours. Examples lie in a block-max inverted index: for each term the blocks of examples that have it, with
the largest weight there, which bounds a block's cosines from above, and the postings in each. Blocks that can't hold one
of the k nearest are never scored, so that the cosines found are exactly the largest. Votes weighted by the squared
cosine, and their sum, go through a logistic curve fitted on labelled rows that neither weights nor examples had seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from territory.llm.base import TERMS as SEPARATE
from territory.llm.base import Scratch, Words, crc_remainder, give_back, raw_texts, read_table, slices, widened
from territory.llm.labelled import FIT_ROWS, labelled_sample

#: Examples of each label, their bytes at most, neighbours, examples in a block of the index, blocks that are scored first.
EXAMPLES, EXAMPLE_BYTES, NEAREST, BLOCK, BLOCKS = 1000, 16_000, 15, 64, 4
#: Labelled documents that a term must be in, and what it must tell of the labels: twice the log likelihood that they gain.
LEAST_DOCUMENTS, LEAST_INFORMATION = 2, 1.0
#: Terms are words, and the first so many bytes of longer words.
STEMS = (4, 5)
#: Of CURVE_PARTS parts of the labelled rows, one fits the curve.
CURVE_PARTS = 3
#: Votes that the share of label 1 counts for, beside a text's neighbours.
PRIOR = 0.05


def term_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, count) of all terms of each text, in order; terms are hashes."""
    words = Words(texts, table=SEPARATE)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    terms, text = words.hashes_and_stems(STEMS)
    order = np.lexsort((terms, text))
    terms, text = terms[order], text[order]
    begin = np.flatnonzero(np.concatenate(([True], (terms[1:] != terms[:-1]) | (text[1:] != text[:-1]))))
    return text[begin], terms[begin], np.diff(np.append(begin, len(terms)))


def _find(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of some hashes are among sorted ones, and where."""
    if not len(known):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    hit = np.flatnonzero(known[at] == wanted)
    return hit, at[hit]


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many documents of each label, and of each part of the sample, a term is."""
    for batch in slices(batches, "text"):
        text, term, _ = term_counts(raw_texts(batch.column("text")))
        y, early = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)[text] for c in ("y", "early"))
        terms, at = np.unique(term, return_inverse=True)
        sums = [pa.array(np.bincount(at, w, len(terms)).astype(np.int64)) for w in (y, np.ones(len(at)), y * early, early)]
        yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), *sums], names=["term", "a", "d", "early_a", "early_d"])


def _example_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        text, term, count = term_counts(raw_texts(batch.column("text")))
        which = pa.array(text)
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(which) for c in ("id", "y", "early")), pa.array(term.view(np.int64)), pa.array(count.astype(np.int32))], names=["id", "y", "early", "term", "n"])


def _corpus_frequencies(terms: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In how many documents of a partition each known term is; the last row has all documents."""
        total, n = np.zeros(len(terms), np.int64), 0
        for batch in slices(batches, "text"):
            total += np.bincount(_find(terms, term_counts(raw_texts(batch.column("text")))[1])[1], minlength=len(terms))
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.flatnonzero(total), -1)), pa.array(np.append(total[total > 0], n))], names=["at", "n"])

    return run


def information(a: Column, d: Column, positive: int, n: int) -> Column:
    """Twice the log likelihood that the labels gain when told apart by a term in d documents, a of label 1."""
    part = lambda x, share: F.when(x > 0, x * F.log(x / (d * share))).otherwise(0.0)
    return F.greatest(2 * (part(a, positive / n) + part(d - a, 1 - positive / n)), F.lit(0.0))


class Examples:
    """A block-max inverted index of vectors: entries (row, term, weight) of rows 0 to n - 1."""

    def __init__(self, ids: np.ndarray, y: np.ndarray, row: np.ndarray, term: np.ndarray, weight: np.ndarray, terms: int) -> None:
        self.ids, self.y, self.blocks = ids, y, -(-len(ids) // BLOCK)
        order = np.lexsort((row, term))
        row, term, weight = row[order], term[order], weight[order]
        begin = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (row[1:] // BLOCK != row[:-1] // BLOCK)))) if len(row) else np.zeros(0, np.int64)
        #: postings: rows and weights, by term and block; pairs: where those of a term in a block begin, the block, the largest weight
        self.row, self.weight = row.astype(np.int32), weight.astype(np.float64)
        self.begin, self.block = np.append(begin, len(row)), (row[begin] // BLOCK).astype(np.int32)
        self.most = np.maximum.reduceat(self.weight, begin) if len(row) else np.zeros(0)
        self.of_term = np.searchsorted(term[begin], np.arange(terms + 1))  # pairs of term t: of_term[t] .. of_term[t + 1]

    @staticmethod
    def _ranges(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        return np.repeat(begin - np.cumsum(length) + length, length) + np.arange(length.sum())

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int = NEAREST) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the nearest examples that share a term, exact; ties go to the earlier row.

        The blocks with the highest bounds are scored first; then, together, those whose bound the k-th cosine doesn't exceed.
        """
        length = self.of_term[terms + 1] - self.of_term[terms]
        pairs, own = self._ranges(self.of_term[terms], length), np.repeat(weights, length)
        block = self.block[pairs]
        bound = np.bincount(block, own * self.most[pairs], self.blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        rows, cosines = np.zeros(0, np.int64), np.zeros(0)
        for chosen in (order[:BLOCKS], order[BLOCKS:]):
            if len(cosines) == k:
                chosen = chosen[bound[chosen] >= cosines[-1] - 1e-12]
            if not len(chosen):
                continue
            wanted = np.zeros(self.blocks, bool)
            wanted[chosen] = True
            some = wanted[block]
            begin = self.begin[pairs[some]]
            length = self.begin[pairs[some] + 1] - begin
            entry = self._ranges(begin, length)
            sums = np.bincount(self.row[entry], self.weight[entry] * np.repeat(own[some], length), len(self.ids))
            found = np.flatnonzero(sums > 0)
            if len(found) > k:
                found = found[sums[found] >= np.partition(sums[found], -k)[-k]]
            rows, cosines = np.concatenate((rows, found)), np.concatenate((cosines, sums[found]))
            best = np.lexsort((rows, -cosines))[:k]
            rows, cosines = rows[best], cosines[best]
        return rows, cosines


class Model:
    """Terms with their weights, the examples, the share of label 1, and the curve."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray, share: float) -> None:
        self.terms, self.weights, self.share = terms, weights, share
        self.examples: Examples | None = None
        self.curve = np.zeros(0)

    def vectors(self, text: np.ndarray, term: np.ndarray, count: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place of the term, weight) of unit vectors, from all terms of the texts."""
        hit, at = _find(self.terms, term)
        text, weight = text[hit], (1 + np.log(count[hit])) * self.weights[at]
        norm = np.sqrt(np.bincount(text, weight * weight, n))
        kept = weight > 0
        return text[kept], at[kept], weight[kept] / norm[text[kept]]

    def hold(self, ids: np.ndarray, y: np.ndarray, text: np.ndarray, term: np.ndarray, count: np.ndarray) -> None:
        """Make texts 0 to n - 1 the examples; those with the same heaviest term share blocks."""
        text, at, weight = self.vectors(text, term, count, len(ids))
        heaviest = np.full(len(ids), -1)
        order = np.argsort(weight, kind="stable")
        heaviest[text[order]] = at[order]
        row = np.empty(len(ids), np.int64)
        order = np.lexsort((ids, heaviest))
        row[order] = np.arange(len(ids))
        self.examples = Examples(ids[order], y[order], row[text], at, weight, len(self.terms))

    def votes(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """The share of label 1 among the votes for each text, the sum of the votes, and the neighbours."""
        share, total, found = np.full(len(texts), self.share), np.zeros(len(texts)), [(np.zeros(0, np.int64), np.zeros(0))] * len(texts)
        if self.examples is not None:
            text, at, weight = self.vectors(*term_counts(texts), len(texts))
            cut = np.searchsorted(text, np.arange(len(texts) + 1))
            for i, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
                if b > a:
                    rows, cosines = found[i] = self.examples.nearest(at[a:b], weight[a:b])
                    votes = cosines**2
                    total[i] = votes.sum()
                    share[i] = (votes @ self.examples.y[rows] + PRIOR * self.share) / (total[i] + PRIOR)
        return share, total, found

    def scores(self, share: np.ndarray, total: np.ndarray) -> np.ndarray:
        return share if not len(self.curve) else 1 / (1 + np.exp(-np.clip(curve_inputs(share, total) @ self.curve, -30, 30)))


def curve_inputs(share: np.ndarray, total: np.ndarray) -> np.ndarray:
    strength = np.log1p(total)
    return np.column_stack((np.ones(len(share)), share, share * share, strength, share * strength))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 25) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
    return w


def _model(counts: DataFrame, examples: dict, early: bool) -> Model:
    """Weights from the term counts, and the examples, of all labelled rows or of those that don't fit the curve."""
    a, d = ("early_a", "early_d") if early else ("a", "d")
    (n, positive), wanted = examples["totals"][early], examples["terms"]
    share = positive / n if n else 0.0
    if not positive or positive == n:
        return Model(np.zeros(0, np.uint64), np.zeros(0), share)
    informed = counts.where(F.col(d) >= LEAST_DOCUMENTS).join(wanted, "term").select("term", information(F.col(a), F.col(d), positive, n).alias("w")).where(F.col("w") >= LEAST_INFORMATION).toArrow().sort_by("term")
    terms, weights = informed["term"].to_numpy().view(np.uint64), informed["w"].to_numpy()
    order = np.argsort(terms)
    known, at = _find(examples["known"], terms[order])
    weights = weights[order][known] * np.log(1 + examples["documents"] / np.maximum(examples["frequency"][at], 1))
    model, rows = Model(terms[order][known], weights, share), examples["rows"]
    own = rows if not early else rows.filter(rows["early"])
    ids, place = np.unique(own["id"].to_numpy(), return_inverse=True)
    y = np.zeros(len(ids))
    y[place] = own["y"].to_numpy()
    order = np.lexsort((own["term"].to_numpy().view(np.uint64), place))
    if len(ids):
        model.hold(ids, y, place[order], own["term"].to_numpy().view(np.uint64)[order], own["n"].to_numpy()[order])
    return model


def fit(sample: DataFrame, documents: DataFrame, scratch: Scratch) -> Model:
    """A model from (id, text, y) and the texts of all documents.

    To the driver come the terms of the examples, at most EXAMPLES of each label with EXAMPLE_BYTES each, with their
    counts; and two numbers for each row that fits the curve.
    """
    sample = scratch.write(sample.withColumn("early", F.pmod(F.xxhash64("id", F.lit("curve")), F.lit(CURVE_PARTS)) > 0), "sample")
    early = F.col("early").cast("long")
    n, positive, n_early, positive_early = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0)), F.coalesce(F.sum(early), F.lit(0)), F.coalesce(F.sum(early * F.col("y")), F.lit(0))).first()
    if not positive or positive == n:
        return Model(np.zeros(0, np.uint64), np.zeros(0), positive / n if n else 0.0)
    counts = sample.select("text", "y", "early").mapInArrow(_document_frequencies, "term long, a long, d long, early_a long, early_d long")
    counts = scratch.write(counts.groupBy("term").agg(*(F.sum(c).alias(c) for c in ("a", "d", "early_a", "early_d"))).where(F.col("d") >= LEAST_DOCUMENTS), "counts")
    short = sample.where(F.octet_length("text") <= EXAMPLE_BYTES)
    chosen = [short.where(F.col("y") == label).orderBy(F.xxhash64("id"), "id").limit(EXAMPLES) for label in (0, 1)]
    terms = scratch.write(chosen[0].unionByName(chosen[1]).mapInArrow(_example_terms, "id long, y int, early boolean, term long, n int"), "examples")
    rows = terms.join(counts.select("term"), "term", "left_semi").toArrow()
    known = np.unique(rows["term"].to_numpy().view(np.uint64))
    found = documents.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_corpus_frequencies(known), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    frequency, total = np.zeros(len(known)), 0
    for at, m in zip(found["at"], found["n"], strict=True):
        if at < 0:
            total = m
        else:
            frequency[at] = m
    examples = {"totals": {False: (n, positive), True: (n_early, positive_early)}, "terms": terms.select("term").distinct(), "rows": rows, "known": known, "frequency": frequency, "documents": total}
    unfitted, model = _model(counts, examples, True), _model(counts, examples, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            share, votes, _ = unfitted.votes(raw_texts(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(share), pa.array(votes)], names=["y", "share", "votes"])

    if unfitted.examples is not None:
        late = sample.where(~F.col("early")).select("text", "y").mapInArrow(run, "y int, share double, votes double").toArrow().sort_by([("y", "ascending"), ("share", "ascending"), ("votes", "ascending")])
        model.curve = logistic(curve_inputs(late["share"].to_numpy(), late["votes"].to_numpy()), late["y"].to_numpy().astype(np.float64))
    del examples, rows, unfitted
    give_back()
    return model


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add `score` and `evidence` (the nearest examples: id, cosine, label) to each row.

    A null or empty text, or one without a term of the model, has no evidence and the score of such texts. A very long
    text is one vector like any other. Columns of these names are replaced; an empty table gives an empty result.
    """
    kept = df.drop("score", "evidence")
    kind = pa.list_(pa.struct([("id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.examples
        for batch in slices(batches, text):
            share, votes, found = model.votes(raw_texts(batch.column(text)))
            evidence = [[{"id": i, "cosine": c, "label": int(v)} for i, c, v in zip(known.ids[r].tolist(), s.tolist(), known.y[r].tolist(), strict=True)] if len(r) else [] for r, s in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(share, votes)), pa.array(evidence, kind)], names=[*batch.schema.names, "score", "evidence"])

    return kept.mapInArrow(run, widened(kept, score="double", evidence="array<struct<id: long, cosine: double, label: int>>"))


def classify(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence of each row, learnt from labels.toxic outside the held-out fold.

    Every row is scored; a null doc_id is in no fold. Without labels of both kinds each score is the share of label 1
    (0 without any). Rows that repeat are scored each, and are one labelled row each; of neighbours with equal cosines the
    one earlier in the index counts. An empty table gives an empty result. Other columns aren't read.
    """
    scratch = Scratch(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    model = fit(labelled_sample(docs, labels, "toxic", rows=rows), docs, scratch)
    scratch.drop(*list(scratch.paths))
    scored = score(documents.select("doc_id", "text"), model).drop("text")
    return scored.select("doc_id", (crc_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "evidence")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")).drop("evidence")
