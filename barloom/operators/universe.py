"""Building a universe from correlations: duplicates, clusters, low correlation."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import c, div
from ..sources.session import cut_lineage
from .crosssection import position, quantiles
from .pairs import both_ways
from .panel import small


def connected_components(pairs: DataFrame) -> DataFrame:
    """(symbol, component): smallest symbol reachable over the pairs.

    Alternating star contraction: every round links nodes to the smallest
    neighbour, so long chains shrink in a logarithmic number of rounds. Minima
    are partial aggregates; no neighbour list is ever collected. Each round is
    written to the checkpoint folder.
    """
    edges = pairs.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    ).distinct()
    edges = cut_lineage(edges)
    before = None
    while True:
        back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        whole = edges.unionByName(back)
        low = whole.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select("u", F.least("u", "m").alias("m"))
        large = whole.join(low, "u").filter((F.col("v") > F.col("u")) & (F.col("v") != F.col("m")))
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v"))
        # A node that is its own smallest keeps its larger neighbours pointed at it.
        large = cut_lineage(large.distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter(F.col("v") != F.col("m"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))
        )
        edges = cut_lineage(small.distinct())
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if before == tuple(state):
            break
        before = tuple(state)
    members = edges.select(F.col("u").alias("symbol"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("symbol"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots)


def merged_clusters(
    pairs: DataFrame, first_dates: DataFrame, index_names: DataFrame | None = None
) -> DataFrame:
    """One row per duplicate cluster: representative (earliest first date),
    members, merged index names and the highest correlation inside."""
    parts = connected_components(pairs)
    dated = parts.join(first_dates, "symbol", "left")
    age = F.struct(F.coalesce(c("first_date").cast("string"), F.lit("9999-12-31")), F.col("symbol"))
    if index_names is not None:
        dated = dated.join(index_names, "symbol", "left")
    else:
        dated = dated.withColumn("index_name", F.lit(None).cast("string"))
    names = F.sort_array(F.collect_set(F.when(F.col("index_name") != "", F.col("index_name"))))
    clusters = dated.groupBy("component").agg(
        F.min_by("symbol", age).alias("representative"),
        F.sort_array(F.collect_list("symbol")).alias("members"),
        names.alias("merged_indices"),
    )
    edges = pairs.join(parts.select(F.col("symbol").alias("a"), "component"), "a")
    top = edges.groupBy("component").agg(F.max("corr").alias("max_corr"))
    return clusters.join(top, "component", "left")


def matrix_report(entries: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """Checks of a full matrix (a, b, corr): square, symmetric, unit diagonal,
    no gaps; values are clipped to [-1, 1] before the range is reported."""
    x = F.least(F.greatest("corr", F.lit(-1.0)), F.lit(1.0))
    e = entries.withColumn("corr", x)
    t = e.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("corr").alias("t"))
    both = e.join(t, ["a", "b"], "full_outer")
    n = entries.groupBy("a").agg(F.lit(1).alias("o")).agg(F.count("o").alias("asset_count"))
    checks = both.agg(
        F.count(F.lit(1)).alias("cells"),
        F.sum((F.col("corr").isNull() | F.col("t").isNull()).cast("long")).alias("gaps"),
        F.max(F.abs(F.col("corr") - F.col("t"))).alias("symmetry_error"),
        F.max(F.when(F.col("a") == F.col("b"), F.abs(F.col("corr") - 1))).alias("diagonal_error"),
        F.min("corr").alias("min_correlation"),
        F.max("corr").alias("max_correlation"),
    )
    out = checks.join(F.broadcast(n), F.lit(True))
    ok = (
        (F.col("cells") == F.col("asset_count") * F.col("asset_count"))
        & (F.col("gaps") == 0)
        & (F.col("symmetry_error") <= tolerance)
        & (F.col("diagonal_error") <= tolerance)
    )
    return out.select(
        "asset_count", "symmetry_error", "diagonal_error", "min_correlation", "max_correlation",
        F.coalesce(ok, F.lit(False)).alias("is_valid"),
    )


def concentration(pairs: DataFrame, n_symbols: int) -> DataFrame:
    """Mean, largest and smallest pair correlation and the effective number of
    independent symbols, N^2 / sum of squared entries."""
    n = float(n_symbols)
    return pairs.agg(
        F.avg("corr").alias("average_pairwise_correlation"),
        F.max("corr").alias("max_pairwise_correlation"),
        F.min("corr").alias("min_pairwise_correlation"),
        (F.lit(n * n) / (F.lit(n) + 2.0 * F.sum(F.col("corr") * F.col("corr")))).alias(
            "effective_diversification_number"
        ),
    )


def dominant_share(pairs: DataFrame, n_symbols: int, tolerance: float = 1e-10) -> DataFrame:
    """Largest eigenvalue over the trace, by the Lanczos method.

    Each step multiplies the matrix with one vector (a join and a sum), removes
    what lies along the vectors before, and stops when the largest value is known
    to the tolerance, at the latest after as many steps as there are symbols. The
    driver sees a few numbers per step. A symbol in no pair is uncorrelated: it
    counts in the trace, and the largest value is never below its 1.
    """
    full = cut_lineage(both_ways(pairs.select("a", "b", "corr")))
    # An irregular start meets every direction.
    start = full.select(F.col("a").alias("s")).distinct().withColumn("x", F.xxhash64("s") / F.lit(float(2**63)) + 0.1)
    norm = start.agg(F.sum(F.col("x") * F.col("x"))).first()[0]
    if not norm:
        return pairs.sparkSession.range(1).select(F.lit(1.0 / max(1, n_symbols)).alias("dominant_eigenvalue_ratio"))
    basis = cut_lineage(start.select("s", F.array(F.col("x") / math.sqrt(norm)).alias("q")))
    matrix, top, steps = np.zeros((1, 1)), 1.0, basis.count()
    for k in range(1, steps + 1):
        last = basis.select(F.col("s").alias("b"), F.element_at("q", -1).alias("x"))
        moved = full.join(last, "b").groupBy(F.col("a").alias("s")).agg(F.sum(F.col("corr") * F.col("x")).alias("y"))
        moved = basis.join(moved, "s").select("s", "q", (F.col("y") + F.element_at("q", -1)).alias("y"))
        along = [0.0] * k
        for _ in range(2):  # the second time removes what rounding left
            moved = cut_lineage(moved)
            parts = moved.agg(*[F.sum(F.col("y") * F.get("q", j)) for j in range(k)]).first()
            along = [a + p for a, p in zip(along, parts)]
            moved = moved.withColumn("y", F.col("y") - sum((F.get("q", j) * p for j, p in enumerate(parts)), F.lit(0.0)))
        moved = cut_lineage(moved)
        rest = math.sqrt(moved.agg(F.sum(F.col("y") * F.col("y"))).first()[0])
        matrix[k - 1, k - 1] = along[-1]
        values, vectors = np.linalg.eigh(matrix)
        top = max(1.0, float(values[-1]))
        if rest * abs(vectors[-1, -1]) <= tolerance * top or rest < 1e-13:
            break
        matrix = np.pad(matrix, (0, 1))
        matrix[k, k - 1] = matrix[k - 1, k] = rest
        basis = moved.select("s", F.concat("q", F.array(F.col("y") / rest)).alias("q"))
    return pairs.sparkSession.range(1).select(F.lit(top / n_symbols).alias("dominant_eigenvalue_ratio"))


def concentration_score(pairs: DataFrame, n_symbols: int) -> DataFrame:
    """The dominant share and its product with the mean correlation."""
    mean = pairs.agg(F.avg("corr").alias("__m"))
    share = dominant_share(pairs, n_symbols).join(F.broadcast(mean), F.lit(True))
    return share.withColumn("portfolio_concentration_score", F.col("dominant_eigenvalue_ratio") * F.col("__m")).drop("__m")


def distance(corr: str | Column = "corr") -> Column:
    x = F.least(F.greatest(c(corr), F.lit(-1.0)), F.lit(1.0))
    return F.sqrt(F.greatest(1.0 - x, F.lit(0.0)))


def threshold_clusters(pairs: DataFrame, symbols: DataFrame, max_distance: float) -> DataFrame:
    """(symbol, cluster): symbols joined by pairs closer than max_distance;
    a symbol without a close partner is its own cluster."""
    near = pairs.filter(distance() < max_distance)
    parts = connected_components(near)
    return symbols.select("symbol").join(parts, "symbol", "left").select(
        "symbol", F.coalesce("component", "symbol").alias("cluster")
    )


def hybrid_distance(pairs: DataFrame, names: DataFrame, weight: float, similarity: Column) -> DataFrame:
    """(1 - w) x return distance + w x name distance.

    names: (symbol, name); similarity is a column of name_a and name_b.
    """
    na = names.select(F.col("symbol").alias("a"), F.col("name").alias("name_a"))
    nb = names.select(F.col("symbol").alias("b"), F.col("name").alias("name_b"))
    rows = pairs.join(na, "a").join(nb, "b")
    mixed = (1.0 - weight) * distance() + weight * (1.0 - similarity)
    return rows.withColumn("dist", mixed).drop("name_a", "name_b")


def neighbour_distances(dists: DataFrame, k: int = 5) -> DataFrame:
    """Distance to the k-th nearest point, each point counting itself first."""
    order = W.partitionBy("a").orderBy("dist", "b")
    near = both_ways(dists).withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= k - 1)
    return near.filter(F.col("__r") == k - 1).select(F.col("a").alias("symbol"), F.col("dist").alias("k_dist"))


def estimate_eps(kdist: DataFrame, *, fits: bool) -> DataFrame:
    """Distance at the sharpest bend of the sorted neighbour distances; their
    median when there are fewer than three."""
    rows = position(kdist.withColumn("__g", F.lit(1)), ["__g"], [F.col("k_dist"), F.col("symbol")], "p", fits)
    now = rows.select("p", F.col("k_dist").alias("d0"))
    nxt = rows.select((F.col("p") - 1).alias("p"), F.col("k_dist").alias("d1"))
    after = rows.select((F.col("p") - 2).alias("p"), F.col("k_dist").alias("d2"))
    bends = now.join(nxt, "p").join(after, "p").select(
        "p", "d1", (F.col("d2") - 2.0 * F.col("d1") + F.col("d0")).alias("bend")
    )
    sharpest = bends.agg(F.max_by("d1", F.struct(F.col("bend"), -F.col("p"))).alias("eps"))
    middle = quantiles(kdist, [], "k_dist", [0.5], "q", fits)
    return sharpest.join(F.broadcast(middle), F.lit(True)).select(F.coalesce("eps", F.col("q")[0]).alias("eps"))


def least_correlation(most: float) -> float:
    """Pairs of at most this distance have at least this correlation (a little
    less, for rounding): the bound that `correlation_pairs` takes."""
    return 1.0 - most * most - 1e-9


def density_clusters(dists: DataFrame, symbols: DataFrame, eps: float, min_samples: int = 5) -> DataFrame:
    """(symbol, cluster, is_core): components of core points, border points at
    their smallest cluster, noise NULL."""
    near = both_ways(dists.filter(F.col("dist") <= eps).select("a", "b", "dist"))
    # A point counts itself.
    counts = near.groupBy("a").agg((F.count(F.lit(1)) + 1).alias("n"))
    core = counts.filter(F.col("n") >= min_samples).select(F.col("a").alias("symbol"))
    if min_samples <= 1:
        core = symbols.select("symbol")
    ca, cb = core.withColumnRenamed("symbol", "a"), core.withColumnRenamed("symbol", "b")
    core_edges = near.join(ca, "a", "left_semi").join(cb, "b", "left_semi").filter("a < b")
    parts = connected_components(core_edges)
    labelled = core.join(parts, "symbol", "left").select(
        "symbol", F.coalesce("component", "symbol").alias("cluster")
    )
    border = (
        near.join(ca, "a", "left_anti")
        .join(labelled.withColumnRenamed("symbol", "b"), "b")
        .groupBy(F.col("a").alias("symbol"))
        .agg(F.min("cluster").alias("cluster"))
    )
    flagged = labelled.withColumn("is_core", F.lit(True)).unionByName(border.withColumn("is_core", F.lit(False)))
    return symbols.select("symbol").join(flagged, "symbol", "left").select(
        "symbol", "cluster", F.coalesce("is_core", F.lit(False)).alias("is_core")
    )


def feature_clusters(
    features: DataFrame, columns: Sequence[str], k: int, components: int | None = None,
    scaler: str = "standard", seed: int = 42,
) -> tuple[DataFrame, float]:
    """Scale, reduce, k-means; returns labels and the silhouette score."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import PCA, MinMaxScaler, StandardScaler, VectorAssembler

    scale = (
        StandardScaler(inputCol="raw", outputCol="scaled", withMean=True)
        if scaler == "standard"
        else MinMaxScaler(inputCol="raw", outputCol="scaled")
    )
    stages = [VectorAssembler(inputCols=list(columns), outputCol="raw"), scale]
    used = "scaled"
    if components:
        stages.append(PCA(k=components, inputCol="scaled", outputCol="reduced"))
        used = "reduced"
    stages.append(KMeans(k=k, seed=seed, featuresCol=used, predictionCol="cluster"))
    done = Pipeline(stages=stages).fit(features).transform(features)
    score = ClusteringEvaluator(featuresCol=used, predictionCol="cluster").evaluate(done)
    return done.select("symbol", "cluster"), float(score)


def cluster_correlations(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(ga, gb, mean, median-free count) of the pair correlation between and
    within groups, both directions."""
    la = labels.select(F.col("symbol").alias("a"), F.col("cluster").alias("ga"))
    lb = labels.select(F.col("symbol").alias("b"), F.col("cluster").alias("gb"))
    rows = both_ways(pairs.select("a", "b", "corr")).join(la, "a").join(lb, "b")
    return rows.groupBy("ga", "gb").agg(F.avg("corr").alias("corr_mean"), F.count(F.lit(1)).alias("n_pairs"))


def cluster_correlation_medians(pairs: DataFrame, labels: DataFrame, *, fits: bool) -> DataFrame:
    la = labels.select(F.col("symbol").alias("a"), F.col("cluster").alias("ga"))
    lb = labels.select(F.col("symbol").alias("b"), F.col("cluster").alias("gb"))
    rows = both_ways(pairs.select("a", "b", "corr")).join(la, "a").join(lb, "b")
    marks = quantiles(rows, ["ga", "gb"], "corr", [0.5], "q", fits)
    return marks.select("ga", "gb", F.col("q")[0].alias("corr_median"))


def cluster_stats(table: DataFrame, labels: DataFrame, index_names: DataFrame | None = None) -> DataFrame:
    """Size, within and between correlation, and how one tracked index dominates.

    table: (ga, gb, corr_mean), from cluster_correlations or, without pairs, from
    pairs.group_correlations."""
    within = table.filter(F.col("ga") == F.col("gb")).select(F.col("ga").alias("cluster"), F.col("corr_mean").alias("intra"))
    between = (
        table.filter(F.col("ga") != F.col("gb"))
        .groupBy(F.col("ga").alias("cluster"))
        .agg(F.avg("corr_mean").alias("inter"))
    )
    out = labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_symbols"))
    out = out.join(within, "cluster", "left").join(between, "cluster", "left")
    out = out.withColumns({"intra": F.coalesce("intra", F.lit(1.0)), "inter": F.coalesce("inter", F.lit(0.0))})
    out = out.select(
        "cluster", "n_symbols", F.col("intra").alias("intra_corr_mean"), F.col("inter").alias("inter_corr_mean"),
        (F.col("intra") - F.col("inter")).alias("corr_diff"),
    )
    if index_names is None:
        return out
    named = labels.join(index_names.filter(F.col("index_name") != ""), "symbol")
    counts = named.groupBy("cluster", "index_name").agg(F.count(F.lit(1)).alias("n"))
    # Same-index pairs from counts: n(n-1)/2 per name, never the pairs themselves.
    choose2 = F.col("n") * (F.col("n") - 1) / 2.0
    per = counts.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("unique_index_count"),
        F.max_by(F.struct("index_name", "n"), F.struct(F.col("n"), F.col("index_name"))).alias("top"),
        F.sum(choose2).alias("same"),
        F.sum("n").alias("named"),
    )
    total = F.col("named") * (F.col("named") - 1) / 2.0
    out = out.join(per, "cluster", "left")
    ratio = F.when(F.col("n_symbols") < 2, 1.0).otherwise(F.coalesce(div("same", total), F.lit(0.0)))
    return out.select(
        "cluster", "n_symbols", "intra_corr_mean", "inter_corr_mean", "corr_diff",
        F.coalesce("unique_index_count", F.lit(0)).alias("unique_index_count"),
        F.coalesce("top.index_name", F.lit("")).alias("dominant_index"),
        F.coalesce(div(F.col("top.n"), "n_symbols"), F.lit(0.0)).alias("dominant_index_ratio"),
        ratio.alias("same_index_pair_ratio"),
    )


def cluster_summary(pairs: DataFrame, labels: DataFrame, families: DataFrame | None = None) -> DataFrame:
    """The summary of a table of pairs, for clusters that fit a task."""
    la = labels.select(F.col("symbol").alias("a"), F.col("cluster").alias("ca"))
    lb = labels.select(F.col("symbol").alias("b"), F.col("cluster").alias("cb"))
    rows = both_ways(pairs.select("a", "b", "corr")).join(la, "a").join(lb, "b")
    per = rows.groupBy(F.col("a").alias("symbol")).agg(
        F.sum("corr").alias("corr_sum"), F.count(F.lit(1)).alias("n"),
        F.avg(F.when(F.col("ca") == F.col("cb"), F.col("corr"))).alias("corr_in_group"),
    )
    return summary_of_clusters(per, labels, families, fits=True)


def summary_of_clusters(per: DataFrame, labels: DataFrame, families: DataFrame | None = None, *, fits: bool) -> DataFrame:
    """Mean correlation in the cluster and to the universe (self included there),
    the 0.65 / 0.35 score, and the rank inside the cluster (lowest first).

    per: (symbol, corr_sum, n, corr_in_group), see pairs.symbol_correlations; a
    symbol without a row there has no pair."""
    per = per.select(
        "symbol",
        ((F.col("corr_sum") + 1.0) / (F.col("n") + 1)).alias("avg_corr_to_universe"),
        F.col("corr_in_group").alias("avg_corr_in_cluster"),
    )
    sizes = labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("cluster_size"))
    out = labels.select("symbol", "cluster").join(per, "symbol", "left").join(sizes, "cluster")
    out = out.fillna({"avg_corr_in_cluster": 0.0, "avg_corr_to_universe": 1.0})
    out = out.withColumn(
        "selection_score", 0.65 * F.col("avg_corr_in_cluster") + 0.35 * F.col("avg_corr_to_universe")
    )
    order = [F.col("selection_score"), F.col("avg_corr_to_universe"), F.col("symbol")]
    out = position(out, ["cluster"], order, "cluster_rank", fits)
    if families is not None:
        return out.join(families, "symbol", "left").fillna("diversified", ["family"])
    return out.withColumn("family", F.lit("diversified"))


def greedy_low_correlation(
    pairs: DataFrame, summary: DataFrame, target_size: int, max_per_cluster: int = 1,
    max_per_family: int | None = None,
) -> list[str]:
    """Seed with the best cluster leader, then add the symbol with the lowest
    mean correlation to those chosen, within the caps.

    At most target_size rounds; each is one aggregation whose result is one row.
    """
    if target_size <= 0:
        return []
    summary = cut_lineage(summary)
    full = cut_lineage(both_ways(pairs.select("a", "b", "corr")))
    n_clusters = summary.select("cluster").distinct().count()
    tie = ["selection_score", "avg_corr_to_universe"]
    seed = summary.filter("cluster_rank = 1").orderBy(*tie, "avg_corr_in_cluster", "symbol").first()
    chosen = [seed["symbol"]]
    clusters, families = {seed["cluster"]: 1}, {seed["family"]: 1}
    while len(chosen) < target_size:
        free = summary.filter(~F.col("symbol").isin(chosen))
        closed = [k for k, n in clusters.items() if n >= max_per_cluster]
        if closed:
            free = free.filter(~F.col("cluster").isin(closed))
        if max_per_family is not None:
            used = [k for k, n in families.items() if n >= max_per_family]
            if used:
                free = free.filter(~F.col("family").isin(used))
        mean = full.filter(F.col("b").isin(chosen)).groupBy(F.col("a").alias("symbol")).agg(
            F.avg("corr").alias("mean_corr")
        )
        # A symbol without a known correlation to those chosen comes last.
        ranked = free.join(mean, "symbol", "left").orderBy(F.col("mean_corr").asc_nulls_last(), *tie, "symbol")
        row = None
        if len(clusters) < n_clusters:
            # A cluster not yet covered may only enter with its leader.
            lead = F.col("cluster").isin(list(clusters)) | (F.col("cluster_rank") == 1)
            row = ranked.filter(lead).first()
        row = row or ranked.first()
        if row is None:
            break
        chosen.append(row["symbol"])
        clusters[row["cluster"]] = clusters.get(row["cluster"], 0) + 1
        families[row["family"]] = families.get(row["family"], 0) + 1
    return chosen


def compatible(corr: str | Column, threshold: float, lower: float | None = None) -> Column:
    ok = c(corr) < threshold
    if lower is not None:
        ok = ok & (c(corr) > lower)
    return F.coalesce(ok, F.lit(False))


def pair_table(pairs: DataFrame, symbols: DataFrame, threshold: float | None = None, lower: float | None = None) -> DataFrame:
    """Pairs among the given symbols, strongest first, with a pass flag."""
    left = symbols.select(F.col("symbol").alias("a"))
    right = symbols.select(F.col("symbol").alias("b"))
    out = pairs.join(left, "a", "left_semi").join(right, "b", "left_semi").select(
        F.col("a").alias("left_symbol"), F.col("b").alias("right_symbol"), F.col("corr").alias("correlation")
    )
    if threshold is not None:
        out = out.withColumn("passes_threshold", compatible("correlation", threshold, lower))
    return out.orderBy(F.col("correlation").desc_nulls_last(), "left_symbol", "right_symbol")


def base_conflicts(
    pairs: DataFrame, base: DataFrame, extensions: DataFrame, threshold: float, lower: float | None = None,
    metrics: DataFrame | None = None,
) -> DataFrame:
    """For every extension the base symbols it is too close to, and how close it is
    to the base at most and at least; the compatible ones first, then by rising
    correlation. metrics: (symbol, ...), columns to add. The base is a portfolio:
    its symbols fit a cell, the extensions may be a universe."""
    full = both_ways(pairs.select("a", "b", "corr"))
    rows = (
        full.join(extensions.select(F.col("symbol").alias("a")), "a", "left_semi")
        .join(base.select(F.col("symbol").alias("b")), "b", "left_semi")
    )
    clash = F.when(~compatible("corr", threshold, lower), F.col("b"))
    per = rows.groupBy(F.col("a").alias("symbol")).agg(
        F.sort_array(F.collect_list(clash)).alias("conflicts"), F.max("corr").alias("max_base_corr"), F.min("corr").alias("min_base_corr")
    )
    out = extensions.select("symbol").join(per, "symbol", "left")
    empty = F.array().cast("array<string>")
    out = out.select(
        "symbol",
        F.coalesce("conflicts", empty).alias("conflicts"),
        "max_base_corr",
        "min_base_corr",
        (F.size(F.coalesce("conflicts", empty)) == 0).alias("compatible_with_base"),
    )
    if metrics is not None:
        out = out.join(metrics, "symbol", "left")
    return out.orderBy(F.col("compatible_with_base").desc(), "max_base_corr", "symbol")


def largest_compatible_sets(
    pairs: DataFrame, symbols: DataFrame, threshold: float, lower: float | None = None
) -> DataFrame:
    """The largest sets in which every pair is compatible, as sorted arrays.

    Symbols are numbered by rising degree, so that few follow those with many
    neighbours. Each has a bitmap of the later ones it is compatible with. A set
    carries the bitmap of what may extend it: its own and the new member's, and-ed.
    So a set meets one row per candidate, and no neighbour list travels along edges.
    """
    edges = (
        pairs.filter(compatible("corr", threshold, lower))
        .join(symbols.select(F.col("symbol").alias("a")), "a", "left_semi")
        .join(symbols.select(F.col("symbol").alias("b")), "b", "left_semi")
        .select("a", "b")
    )
    edges = cut_lineage(edges)
    degree = edges.select(F.col("a").alias("symbol")).unionByName(edges.select(F.col("b").alias("symbol"))).groupBy("symbol").count()
    names = symbols.select("symbol").distinct().join(degree, "symbol", "left")
    order = W.orderBy(F.coalesce("count", F.lit(0)), "symbol")
    names = cut_lineage(names.select("symbol", (F.row_number().over(order) - 1).alias("v")))
    n = names.count()
    words = max(1, -(-n // 64))
    side = lambda x: names.select(F.col("symbol").alias(x), F.col("v").alias(f"v{x}"))
    ends = edges.join(side("a"), "a").join(side("b"), "b").select(F.least("va", "vb").alias("v"), F.greatest("va", "vb").alias("u"))
    bit = F.expr("shiftleft(1L, cast(u % 64 as int))")
    maps = ends.groupBy("v", F.expr("cast(u div 64 as int)").alias("w")).agg(F.bit_or(bit).alias("bits"))
    maps = maps.groupBy("v").agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("__m"))
    word = F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda i: F.coalesce(F.try_element_at("__m", i), F.lit(0).cast("long")))
    empty = F.array_repeat(F.lit(0).cast("long"), words)
    vertices = names.join(maps, "v", "left").select("v", "symbol", F.when(F.col("__m").isNull(), empty).otherwise(word).alias("later"))
    vertices = cut_lineage(vertices)
    # The bitmaps take n * n / 8 bytes.
    known = small(vertices, n * words // 8)
    level = vertices.select(F.array("symbol").alias("members"), F.col("later").alias("open"))
    while True:
        filled = level.select("members", "open", F.posexplode("open").alias("w", "bits")).filter("bits <> 0")
        filled = filled.withColumn("i", F.explode(F.expr("filter(sequence(0, 63), i -> getbit(bits, i) = 1)")))
        filled = filled.select("members", "open", (F.col("w") * 64 + F.col("i")).alias("v"))
        both = F.zip_with("open", "later", lambda x, y: x.bitwiseAND(y))
        grown = filled.join(known, "v").select(F.concat("members", F.array("symbol")).alias("members"), both.alias("open"))
        grown = cut_lineage(grown)
        if grown.isEmpty():
            return level.select(F.array_sort("members").alias("members"))
        level = grown


def combo_summary(
    sets: DataFrame, pairs: DataFrame, base: Sequence[str], metrics: DataFrame | None = None,
    max_results: int | None = 5,
) -> DataFrame:
    """Base plus extension sets with correlation and traded-value figures,
    largest and least correlated first. metrics: (symbol, avg_value)."""
    fixed = F.array(*[F.lit(s) for s in base]) if base else F.array().cast("array<string>")
    rows = sets.withColumns({"symbols": F.concat(fixed, F.col("members")), "combo": F.array_join("members", ", ")})
    size = rows.select("combo", "symbols", F.size("symbols").alias("symbol_count"), "members")
    member = size.select("combo", F.explode("symbols").alias("a"))
    # Pairs inside one set; sets are small and results of the search itself.
    inside = member.join(both_ways(pairs.select("a", "b", "corr")), "a").join(
        member.withColumnRenamed("a", "b"), ["combo", "b"]
    ).filter("a < b")
    stats = inside.groupBy("combo").agg(
        F.avg("corr").alias("avg_pairwise_correlation"),
        F.max("corr").alias("max_pairwise_correlation"),
        F.min("corr").alias("min_pairwise_correlation"),
    )
    out = size.join(stats, "combo", "left").fillna(
        0.0, ["avg_pairwise_correlation", "max_pairwise_correlation", "min_pairwise_correlation"]
    )
    if metrics is not None:
        ext = size.select("combo", F.explode("members").alias("symbol")).join(metrics.select("symbol", "avg_value"), "symbol")
        value = ext.groupBy("combo").agg(
            F.avg("avg_value").alias("extension_avg_value"), F.sum("avg_value").alias("extension_total_avg_value")
        )
        out = out.join(value, "combo", "left")
    else:
        out = out.withColumns({"extension_avg_value": F.lit(0.0), "extension_total_avg_value": F.lit(0.0)})
    out = out.fillna(0.0, ["extension_avg_value", "extension_total_avg_value"]).drop("combo", "members")
    out = out.withColumn("symbols_text", F.array_join("symbols", ", ")).orderBy(
        F.col("symbol_count").desc(), "avg_pairwise_correlation", F.col("extension_avg_value").desc(), "symbols_text"
    )
    return out if max_results is None else out.limit(max_results)
