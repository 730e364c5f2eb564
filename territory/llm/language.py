"""Language identification, words first (operator 8).

A word that the table knows adds its log frequency in each language. An unseen word falls back to its character
4-grams, then 3-, 2- and 1-grams: the longest length of which the table knows any. The tables are
counted on a bounded sample of each language and hold its commonest words and n-grams, by their hashes.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from territory.llm.base import Scratch, crc_remainder, mix, parts, power_tables, raw_texts, read_table, slices, small_batches, widened

#: Documents that a language is fitted on, about; entries of each length in its table (words count as length 0).
DOCUMENTS, ENTRIES, LONGEST = 2000, 5000, 4
#: Languages of a model, the commonest ones: what it holds is at most LANGUAGES x ENTRIES x 5 counts.
LANGUAGES = 64
#: Evidence of more words than this many doesn't make the score any surer.
SURE = 50
#: Bytes of text that are looked at together.
TOGETHER = 1 << 19


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


class LetterWords:
    """Lower-cased runs of letters of many texts, and hashes of them and of the n-grams in them."""

    def __init__(self, texts: list[bytes]) -> None:
        lowered = [t.decode("utf-8", "replace").lower() for t in texts]
        codes = np.frombuffer(("\n" + "\n".join(lowered) + "\n").encode("utf-32-le", "replace"), np.uint32)
        letter = _letters()[codes]
        edges = np.flatnonzero(letter[1:] != letter[:-1]) + 1
        self.start, self.end = edges[0::2], edges[1::2]
        begin = np.cumsum([1, *(len(t) + 1 for t in lowered)])
        self.first = np.searchsorted(self.start, begin)
        self.counts = np.diff(self.first)
        self.of = np.repeat(np.arange(len(texts)), self.counts)
        self.up, self.down = power_tables(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        # what isn't a letter is the same everywhere: a word's end
        np.cumsum((np.where(letter, codes, 0).astype(np.uint64) + np.uint64(1)) * self.up[: len(codes)], out=self.sums[1:])

    def words(self) -> np.ndarray:
        return self._hash(self.start, self.end)

    def _hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def grams(self, words: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-grams of some words, and which of these has each; those of two or more see the word's ends."""
        edge = int(length > 1)
        begin, n = self.start[words] - edge, np.maximum(self.end[words] - self.start[words] + 2 * edge - length + 1, 0)
        owner = np.repeat(np.arange(len(words)), n)
        at = begin[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        return self._hash(at, at + length), owner


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", TOGETHER):
        langs = np.array(batch.column("lang").to_pylist(), object)
        texts = raw_texts(batch.column("text"))
        for lang in sorted(set(langs)):
            found = LetterWords([p for t, x in zip(texts, langs, strict=True) if x == lang for p in parts(t, TOGETHER)])
            words, at, n = np.unique(found.words(), return_index=True, return_counts=True)
            for length in range(LONGEST + 1):
                keys, counts = words, n
                if length:
                    grams, owner = found.grams(at, length)
                    keys, where = np.unique(grams, return_inverse=True)
                    counts = np.bincount(where, n[owner], len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(np.full(len(keys), length, np.int32)), pa.array(keys.view(np.int64)), pa.array(counts)], names=["lang", "length", "entry", "n"])


class Model:
    """Log frequencies of words and n-grams for each language: sorted hashes, and a row for each."""

    def __init__(self, rows: pa.Table) -> None:
        """rows: lang, length, entry (a hash), n and the total of that language and length."""
        lang, length, entry, n, total = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("lang", "length", "entry", "n", "total"))
        self.languages, place = np.unique(lang.astype(str), return_inverse=True)
        self.languages, self.tables = self.languages.tolist(), []
        for k in range(LONGEST + 1):
            own = np.flatnonzero(length == k)
            keys, at = np.unique(entry[own].astype(np.int64).view(np.uint64), return_inverse=True)
            counts, totals = np.zeros((len(keys), len(self.languages)), np.float32), np.zeros(len(self.languages))
            counts[at, place[own]] = n[own]
            totals[place[own]] = total[own]
            self.tables.append((keys, np.log((counts + 0.5) / (totals + 1))))

    def _look(self, length: int, hashes: np.ndarray) -> np.ndarray:
        """Row of each hash in the table of a length, or -1."""
        keys = self.tables[length][0]
        if not len(keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return np.where(keys[at] == hashes, at, -1)

    def evidence(self, found: LetterWords) -> np.ndarray:
        """The sum over each text's words: a row for each text, a column for each language."""
        hashes, n = found.words(), len(found.counts)
        rows = self._look(0, hashes)
        seen = rows >= 0
        _, at, which = np.unique(hashes[~seen], return_index=True, return_inverse=True)
        unseen = np.zeros((len(at), len(self.languages)))
        words, left = np.flatnonzero(~seen)[at], np.arange(len(at))
        for length in range(LONGEST, 0, -1):
            grams, owner = found.grams(words[left], length)
            row = self._look(length, grams)
            owner, row = owner[row >= 0], row[row >= 0]
            known = np.bincount(owner, minlength=len(left))
            for i in range(len(self.languages)):
                unseen[left, i] = np.bincount(owner, self.tables[length][1][row, i], len(left)) / np.maximum(known, 1)
            left = left[known == 0]
        columns = []
        for i in range(len(self.languages)):
            each = np.empty(len(hashes))
            each[seen], each[~seen] = self.tables[0][1][rows[seen], i], unseen[which, i]
            columns.append(np.bincount(found.of, each, n))
        return np.column_stack(columns)

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text, the first by name of equals, and its share; a long text goes in parts."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        log, words, of, held = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64), [], []

        def look() -> None:
            if of:
                found = LetterWords(held)
                np.add.at(log, of, self.evidence(found))
                np.add.at(words, of, found.counts)
                of.clear()
                held.clear()

        for i, text in enumerate(texts):
            for part in parts(text, TOGETHER):
                if sum(map(len, held)) + len(part) > 2 * TOGETHER:
                    look()
                of.append(i)
                held.append(part)
        look()
        log *= np.minimum(1.0, SURE / np.maximum(words, 1))[:, None]
        share = np.exp(log - log.max(axis=1, keepdims=True))
        best, empty = log.argmax(axis=1), words == 0
        labels = ["und" if e else self.languages[b] for b, e in zip(best.tolist(), empty.tolist(), strict=True)]
        return labels, np.where(empty, 0.0, share.max(axis=1) / share.sum(axis=1))


def fit(documents: DataFrame, modulus: int = 5, held: int = 0) -> Model:
    """Learn from text and lang of documents outside the held-out fold; null ids, texts and langs are left out.

    Of more than LANGUAGES values of lang the commonest are learnt. Rows that repeat count each; of entries as common as
    the last that a table holds, those of smaller hash are in it. Without rows the model has no language.
    """
    scratch = Scratch(documents.sparkSession)
    rows = documents.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), "text").where("doc_id is not null and lang is not null and text is not null").where(crc_remainder(F.col("doc_id"), modulus) != held)
    shares = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).select("lang", (DOCUMENTS / F.col("n")).alias("share"))
    unit = (F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) / (1 << 30))
    sample = rows.join(F.broadcast(shares), "lang").where(unit < F.col("share")).select("lang", "text")  # LANGUAGES rows at most
    counts = sample.mapInArrow(_count, "lang string, length int, entry long, n long").groupBy("lang", "length", "entry").agg(F.sum("n").alias("n"))
    counts = scratch.write(counts, "counts")
    best = Window.partitionBy("lang", "length").orderBy(F.desc("n"), "entry")
    table = counts.withColumn("place", F.row_number().over(best)).where(F.col("place") <= ENTRIES).drop("place")
    total = counts.groupBy("lang", "length").agg(F.sum("n").alias("total"))
    model = Model(table.join(total, ["lang", "length"]).select("lang", "length", "entry", "n", "total").toArrow())
    scratch.drop("counts")
    return model


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add `lang_pred` and `score` to each row; columns of these names are replaced.

    `und` with score 0 stands for a null text, one without letters, and for a model without languages. Rows that repeat
    are predicted each; a very long text in parts; of equally likely languages the first by name. An empty table
    gives an empty result.
    """
    small_batches(df.sparkSession)
    kept = df.drop("lang_pred", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, TOGETHER):
            labels, scores = model.predict(raw_texts(batch.column(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return kept.mapInArrow(run, widened(kept, lang_pred="string", score="double"))


def identify(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row of `documents`, as fit and predict say; a null doc_id is in no fold."""
    found = predict(documents.select("doc_id", "text"), fit(documents))
    return found.select("doc_id", (crc_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "documents"))
