"""Uniform shuffle into shards of exact size.

Rows lie in chunks of the input. A matrix with a count for every chunk and shard
is drawn with the law that a perfect shuffle would give it (multivariate
hypergeometric), so shard sizes are met exactly. Each chunk then orders its rows
at random and deals them out by its row of the matrix; each shard orders what it
received at random again. The driver only draws for groups of chunks; the rows
of a group's chunks are drawn in a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Rows of a chunk, at most: what one task orders.
CHUNK_ROWS = 1 << 13
#: Chunks of a group, about: what one task draws for.
GROUP_CHUNKS = 512
#: Rows of a shard that one task orders, about.
BLOCK_ROWS = 1 << 15


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Good ones among so many draws without putting back, for any sizes."""
    if draws == 0 or good == 0:
        return 0
    if bad == 0 or draws == good + bad:
        return good if draws == good + bad else draws
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, draws))
    # By inversion over twelve deviations around the mode; ratios of neighbouring
    # probabilities are exact enough where their values are not.
    total = good + bad
    low, high = max(0, draws - bad), min(good, draws)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    wide = int(12 * (draws * (good / total) * (bad / total) * ((total - draws) / (total - 1))) ** 0.5) + 12
    k = np.arange(max(low, mode - wide), min(high, mode + wide) + 1, dtype=np.float64)
    step = np.log(good - k[:-1]) + np.log(draws - k[:-1]) - np.log(k[1:]) - np.log(bad - draws + k[1:])
    log = np.concatenate([[0.0], np.cumsum(step)])
    mass = np.cumsum(np.exp(log - log.max()))
    return int(k[min(int(np.searchsorted(mass, rng.random() * mass[-1])), len(k) - 1)])


def draw_matrix(rng: np.random.Generator, sizes: list[int], room: list[int]) -> list[list[int]]:
    """For each size, how many go to each column; columns sum to room."""
    left, matrix = list(room), []
    for size in sizes:
        behind, row = sum(left), []
        for shard, free in enumerate(left):
            behind -= free
            row.append(hypergeometric(rng, free, behind, size))
            size -= row[-1]
            left[shard] -= row[-1]
        matrix.append(row)
    return matrix


def shard_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def shuffle_into_shards(df: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """df plus shard (0 to shards - 1) and slot (0, 1, ... within the shard).

    Every arrangement of the rows is as likely as any other; shard sizes differ
    by one at most. No column decides, so nulls, empty or long values, ties and
    repeated rows are rows like any others; columns named shard or slot are
    replaced; an empty table gives an empty one. The rows are written once, as
    what the draw refers to; later losses re-read them."""
    rest = [c for c in dict.fromkeys(df.columns) if c not in ("shard", "slot")]
    rows = written(df.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.monotonically_increasing_id().alias("at")), "shard-rows")
    rows = rows.withColumn("chunk", F.expr(f"at div {CHUNK_ROWS}"))
    chunks = rows.groupBy("chunk").agg(F.count("*").alias("n"))
    spark, n_chunks = df.sparkSession, chunks.count()
    groups = max(1, n_chunks // GROUP_CHUNKS)
    chunks = chunks.withColumn("g", F.pmod(F.xxhash64(F.lit(seed), "chunk"), F.lit(groups)))
    sums = sorted(map(tuple, chunks.groupBy("g").agg(F.sum("n")).collect()))
    total = sum(n for _, n in sums)
    drawn = draw_matrix(np.random.default_rng([seed, 0]), [n for _, n in sums], shard_sizes(total, shards))
    rooms = spark.createDataFrame([(g, row) for (g, _), row in zip(sums, drawn, strict=True)], "g long, room array<long>")

    def draw_group(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("chunk")
        rng = np.random.default_rng([seed, 1, int(key[0])])
        matrix = draw_matrix(rng, part.n.tolist(), [int(x) for x in part.room.iloc[0]])
        return pd.DataFrame({"chunk": part.chunk, "ends": [np.cumsum(row) for row in matrix]})

    ends = chunks.join(rooms, "g").groupBy("g").applyInPandas(draw_group, "chunk long, ends array<long>")
    # Permute locally, deal out.
    local = Window.partitionBy("chunk").orderBy(F.xxhash64(F.lit(seed), F.lit("local"), "at"), "at")
    dealt = (
        rows.withColumn("rank", F.row_number().over(local) - 1)
        .join(ends, "chunk")
        .withColumn("shard", F.expr("size(filter(ends, e -> e <= rank))"))
        .withColumn("draw", F.xxhash64(F.lit(seed), F.lit("shard"), "at"))
    )
    # Permute again: blocks of random keys, one after the other.
    blocks = max(1, -(-total // (shards * BLOCK_ROWS)))
    dealt = dealt.withColumn("block", F.pmod(F.shiftrightunsigned("draw", 20), F.lit(blocks)))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy("shard", "block").agg(F.count("*").alias("n"))
        .select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    inside = Window.partitionBy("shard", "block").orderBy("draw", "at")
    return (
        dealt.select("row", "at", "shard", "block", "draw")
        .withColumn("slot", F.row_number().over(inside) - 1)
        .join(starts, ["shard", "block"])
        .select("row.*", F.col("shard").cast("int").alias("shard"), (F.col("slot") + F.col("start")).alias("slot"))
    )
