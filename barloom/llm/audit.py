"""Audit of filters applied in every order: what each step removes and loses.

A document fails a set of the filters, its mask. An order of the filters is a
permutation; permutations with the same first k letters hold one interval of the
lexicographic (Lehmer) ranks, of length (f - k)!. So whatever holds for a mask at
step k because of the first k letters holds on a few intervals of ranks. Each mask
adds its documents where such an interval starts and takes them away where it
ends; prefix sums over the ranks then give every order's totals.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The filters: letter and, for a text, its failure. `copy` depends on the table.
LETTERS = "ABCDE"
#: Words of a text are what lies between blanks.
_BLANKS = r"[\x20\x09-\x0D]+"
#: What is counted at a step, and for which documents.
_MEASURES = {
    "kept": ("n", "kept"),
    "removed": ("n", "removed"),
    "redundant": ("n", "redundant"),
    "unique_fails": ("n", "only"),
    "good_lost": ("good", "removed"),
    "toxic_lost": ("toxic", "removed"),
}


def lehmer_rank(prefix: tuple[int, ...], of: int) -> int:
    """The lowest rank of the permutations of range(of) that start so."""
    free, rank = list(range(of)), 0
    for i, x in enumerate(prefix):
        rank += free.index(x) * factorial(of - 1 - i)
        free.remove(x)
    return rank


def differences(filters: int) -> list[tuple[int, int, int, int, int, int, int]]:
    """mask, step, rank, and what is to be added there to the numbers of kept,
    removed, redundant and only failures for each document of the mask. At most
    2^f * f * f! rows, a constant (f is 5 or so)."""
    out: dict[tuple[int, int, int], list[int]] = {}
    for step in range(1, filters + 1):
        width = factorial(filters - step)
        for prefix in permutations(range(filters), step):
            start = lehmer_rank(prefix, filters)
            before, bit = sum(1 << x for x in prefix[:-1]), 1 << prefix[-1]
            for mask in range(1 << filters):
                fails, gone = bool(mask & bit), bool(mask & before)
                holds = (not fails and not gone, fails and not gone, fails and gone, mask == bit)
                if any(holds):
                    for at, sign in ((start, 1), (start + width, -1)):
                        row = out.setdefault((mask, step, at), [0, 0, 0, 0])
                        for i, h in enumerate(holds):
                            row[i] += sign * h
    # Intervals side by side cancel where they meet.
    return [(*key, *row) for key, row in out.items() if any(row) and key[2] < factorial(filters)]


def failures(docs: DataFrame, doc_id: str = "doc_id", part: str = "lang", text: str = "text") -> DataFrame:
    """doc_id, part, mask of the filters A to D (bits 0 to 3), digest of the text.

    A: under 100 words; B: distinct words below 80%; C: capitals A-Z above 10% of
    the code points; D: a sign of `#$%&*|`. Null texts are empty, null parts too."""
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), t.alias("t"))
    rows = rows.withColumn("w", F.array_remove(F.split("t", _BLANKS), ""))
    words, distinct = F.size("w"), F.size(F.array_distinct("w"))
    fails = [
        words < 100,
        F.lit(100).cast("long") * distinct < F.lit(80).cast("long") * words,
        F.lit(100).cast("long") * F.length(F.regexp_replace("t", "[^A-Z]+", "")) > F.lit(10).cast("long") * F.length("t"),
        F.col("t").rlike("[#$%&*|]"),
    ]
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    return rows.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("digest"))


def mask_counts(failed: DataFrame, labels: DataFrame, copy_bit: int = 4) -> DataFrame:
    """part, mask, n, good, toxic: documents by what they fail.

    A row fails the filter `copy_bit` if a smaller doc_id has the same digest.
    Every row counts as a document; rows that repeat an id and a text aren't copies
    of each other, a null id is neither a copy nor has any. A document is good or
    toxic if any row of labels (doc_id, quality, toxic) says 1 for its id.

    Rows are counted before each shuffle, so a text's copies meet as one row for
    each part and label, however many they are."""
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(*[F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(a) for c, a in (("quality", "good"), ("toxic", "bad"))])
    rows = failed.groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n")).join(marks, "doc_id", "left")
    known = F.col("doc_id").isNotNull()
    same = rows.groupBy("digest", "mask", "part", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("bad", F.lit(0)).alias("bad")).agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("known"), F.min(F.when(known, F.struct("doc_id", "n"))).alias("first")
    )
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    copies = F.col("known") - F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(0)
    both = same.withColumn("copies", copies).withColumn("as", F.explode(F.array(F.struct(F.lit(0).alias("bit"), (F.col("n") - F.col("copies")).alias("m")), F.struct(F.lit(1 << copy_bit).alias("bit"), F.col("copies").alias("m")))))
    m = F.col("as.m")
    return both.filter(m > 0).groupBy("part", F.col("mask").bitwiseOR(F.col("as.bit")).alias("mask")).agg(F.sum(m).alias("n"), F.sum(m * F.col("good")).alias("good"), F.sum(m * F.col("bad")).alias("toxic"))


def totals(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """A row per part, filter_order and step from counts (part, mask, n, good, toxic).

    kept: documents that stay after the step; removed: that go here; redundant:
    that fail its filter and went earlier; unique_fails: that fail its filter only;
    good_lost, toxic_lost: labelled ones among removed; shapley: removed by its
    filter, summed over all orders. Parts are those in counts; steps without
    documents have zeros."""
    spark: SparkSession = counts.sparkSession
    size, orders = len(letters), factorial(len(letters))
    steps = spark.createDataFrame(differences(size), "mask int, step int, rank int, kept int, removed int, redundant int, only int")
    sums = [F.sum(F.col(f"c.{n}") * F.col(f"s.{h}")).alias(m) for m, (n, h) in _MEASURES.items()]
    # At most 2^f masks a part: counts are few, the steps are a constant table.
    added = counts.alias("c").join(F.broadcast(steps).alias("s"), F.col("c.mask") == F.col("s.mask")).groupBy("c.part", "s.step", "s.rank").agg(*sums)
    grid = counts.select("part").distinct().select("part", F.explode(F.sequence(F.lit(1), F.lit(size))).alias("step")).select("part", "step", F.explode(F.sequence(F.lit(0), F.lit(orders - 1))).alias("rank"))
    along = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = grid.join(added, ["part", "step", "rank"], "left").select("part", "step", "rank", *[F.sum(F.coalesce(m, F.lit(0))).over(along).cast("long").alias(m) for m in _MEASURES])
    rows = rows.withColumn("filter_order", _order(F.col("rank"), letters)).withColumn("letter", F.expr("substring(filter_order, step, 1)"))
    shapley = F.sum("removed").over(Window.partitionBy("part", "letter"))
    return rows.select("part", "filter_order", "step", *_MEASURES, shapley.alias("shapley"))


def _order(rank: Column, letters: str) -> Column:
    names = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    return F.element_at(names, rank + 1)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the filters A to E over docs (doc_id, text, lang), by lang.

    Nulls, repeated rows and missing labels as in `failures` and `mask_counts`;
    texts of any length are read whole; further columns are left; an empty table
    gives no rows."""
    return totals(mask_counts(failures(docs), labels))
