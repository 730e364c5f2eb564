"""Corpus cleaning: the stages, each a function of (spark, docs, sf_dir), and their run over `documents`.

Each stage works on all that the one before it kept. All but the last return the columns of documents, and whatever other
columns came, whatever their names: while a stage works, all but doc_id and text are put away in one column. A null in another
column than doc_id and text doesn't matter; of rows that repeat an id, each is judged by its own text. An empty table gives an empty one.
A very long text is held whole by one task, with arrays of some ten times its bytes. What a stage does with null and empty texts,
null ids and ties is said there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from territory.llm import bpe, language, minhash, substrings, tiling
from territory.llm.base import Scratch, read_table, scratch_scope

#: Under this share of the evidence, a document's language counts as unknown.
LEAST_LANGUAGE_SCORE = 0.5


REST = "__rest"


def put_away(docs: DataFrame) -> DataFrame:
    """(doc_id, text, __rest): all other columns in one, where no name of a stage meets theirs."""
    rest = [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", (F.struct(*rest) if rest else F.lit(None).cast("int")).alias(REST))


def brought_back(found: DataFrame, docs: DataFrame, **values: Column) -> DataFrame:
    """The columns of docs again, with new values for some."""
    of = lambda c: values[c] if c in values else F.col(c) if c in ("doc_id", "text") else F.col(REST).getField(c)
    return found.select(*[of(c).alias(c) for c in docs.columns])


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID (8): documents whose language is `und` or uncertain go.

    So do null and empty texts, as they have no letters; rows with a null id are judged like others. Of two languages that are
    as likely neither has more than half of the evidence, but the score may reach 0.5, and the document stays.
    """
    found = language.predict(put_away(docs), language.fit(docs.select("doc_id", "text", "lang")))
    return brought_back(found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)), docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup (1): of each component the document with the least id stays.

    Rows that repeat id and text are one document, of which one row stays: the least by its other columns as JSON. Texts without words and rows with a null id
    are near nothing and stay.
    """
    found = minhash.near_duplicates(docs.select("doc_id", "text"))
    gone = found.where("not kept").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    marked = put_away(docs).withColumns({"__id": F.col("doc_id").cast("long"), "__hash": F.xxhash64("text")})
    kept = marked.join(gone, ["__id", "__hash"], "left_anti")
    repeated = found.where("doc_id is not null and n_shingles > 0").groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.count("*").alias("__n")).where("__n > 1")
    kept = kept.join(repeated, ["__id", "__hash"], "left")
    # only repeated rows are told apart by a number
    order = F.to_json(F.struct(REST)) if len(docs.columns) > 2 else F.lit(0)
    number = F.row_number().over(Window.partitionBy("__id", "__hash").orderBy(order))
    once = brought_back(kept.where("__n is null"), docs)
    return once.unionByName(brought_back(kept.where("__n is not null").withColumn("__number", number).where("__number = 1"), docs))


def no_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup (9): words under passages that an earlier document holds go; untouched texts stay as they are.

    All rows stay, with an empty text if nothing is left. Null texts and rows with a null id stay as they are.
    """
    kept, cut = substrings.drop_repeats(put_away(docs)), F.col("n_removed") > 0
    values = {"text": F.when(cut, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.when(cut, F.char_length("kept_text").cast("long")).otherwise(F.col(REST)["n_chars"])
    return brought_back(kept, docs, **values)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination (6): documents that hold a benchmark item go.

    Null and empty texts, and texts in a table without items, stay; rows with a null id are judged like others.
    """
    key = F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    held = tiling.contaminated(docs.select(key.alias("__key"), "text"), read_table(spark, sf_dir, "benchmark"), id="__key")
    held = held.select(F.col("__key.id").alias("__held_id"), F.col("__key.hash").alias("__held_hash")).distinct()
    marked = put_away(docs).withColumns({"__id": F.col("doc_id"), "__hash": F.xxhash64("text")})
    return brought_back(marked.join(held, F.expr("__id <=> __held_id and __hash = __held_hash"), "left_anti"), docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE (5): the number of tokens and the digests of ids and decoded text of each row; a null text counts as empty."""
    return bpe.digest(docs, bpe.vocabulary_path())


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each),
    ("substrings", no_repeats),
    ("decontamination", no_benchmark),
    ("bpe", encoded),
]

#: Language ID learns a model and BPE follows a vocabulary, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = read_table(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        with scratch_scope():  # a stage's own tables go when its result is written
            docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
