"""A corpus in five stages; each is one of the operators in barloom.llm.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents, further columns of
docs included. Nulls, empty texts and repeated rows go through as the operators
define them; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import jaccard, langid, mixing, quality
from barloom.llm import queries as q
from barloom.llm.shared import relieve, written

#: Least share of a text's letters in its language.
LEAST_SHARE = 0.5
#: A table of documents to leave out above so many rows is joined by a shuffle.
BROADCAST_ROWS = 100_000


def _judged(docs: DataFrame, judge, keep: Column) -> DataFrame:
    """Rows of docs that the judged text lets stay; columns can't clash."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    kept = judge(docs.select(F.struct(*others).alias("_row"), "text")).filter(keep)
    return kept.select(*[F.col("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])


def _row(docs: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")


def _hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages stay: those go that have no
    letter, or no language for at least LEAST_SHARE of their letters."""
    relieve()
    model = q.language_model(docs)
    return _judged(docs, lambda rows: langid.identify(rows, model), (F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay that the quality model finds more likely good than not."""
    relieve()
    model = q.quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _judged(docs, lambda rows: quality.score(rows, model), F.col("predicted") == 1)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates stays: the one with the
    smallest doc_id. Documents without words stay all. Columns of any name are
    carried along."""
    relieve()
    found = written(jaccard.near_duplicates(docs).filter("n_shingles > 0").select("doc_id", "th", "stays"), "near-duplicates")
    rows = docs.select(_row(docs), "doc_id", _hash().alias("th"))

    def without(rows: DataFrame, which: DataFrame, how: str) -> DataFrame:
        which = which.select(F.col("doc_id").alias("d"), F.col("th").alias("h")).distinct()
        which = F.broadcast(which) if which.count() <= BROADCAST_ROWS else which
        return rows.join(which, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")), how)

    rows = without(rows, found.filter("not stays"), "left_anti")
    again = written(found.filter("stays").groupBy("doc_id", "th").agg(F.count("*").alias("n")).filter("n > 1"), "repeated")
    if not again.isEmpty():
        rows = without(rows, again, "left_anti").unionByName(without(rows, again, "left_semi").dropDuplicates(["doc_id", "th"]))
    return rows.select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a row for each epoch that takes
    words of it, cut to these words (joined by blanks) if they aren't all.
    Documents without words aren't taken. Columns of any name are carried along."""
    relieve()
    # The row travels whole beside columns of our own names, which can't clash.
    rows = docs.select(_row(docs), F.struct("doc_id", _hash().alias("th")).alias("doc_id"), "source", "text")
    made = mixing.mix(q.sized(rows), q.WEIGHTS, q.EPOCHS, q.MIX_SEED)
    taken = made.pieces.groupBy("sid", "start", "epoch").agg(
        F.first("doc_id").alias("of"), F.min("from_word").alias("first"), F.max("to_word").alias("last"), F.first("size").alias("size")
    )
    taken = taken.select(F.col("of.doc_id").alias("d"), F.col("of.th").alias("h"), "first", "last", "size")
    rows = rows.select("_row", "text", "doc_id.doc_id", "doc_id.th")
    if not made.documents.filter("size > 0").groupBy("doc_id").count().filter("count > 1").isEmpty():
        # Repeated rows share their key; each epoch of each of them is in taken.
        rows = rows.dropDuplicates(["doc_id", "th"])
    rows = rows.join(taken, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")))
    words = F.split(F.btrim("text", F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+")
    part = F.concat_ws(" ", F.slice(words, F.col("first").cast("int") + 1, (F.col("last") - F.col("first")).cast("int")))
    cut = (F.col("first") > 0) | (F.col("last") < F.col("size"))
    rows = rows.withColumn("text", F.when(cut, part).otherwise(F.col("text")))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
    return rows.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mix."""
    relieve()
    return q.bpe_round_trip(docs)


STAGES = [
    ("language ID", language),
    ("quality classifier", good),
    ("n-gram Jaccard join", distinct),
    ("mixing sources to target weights", mixed),
    ("byte-level BPE", encoded),
]

#: Learned models decide the first stages, which SQL can't state; tests check
#: each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
