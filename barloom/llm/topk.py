"""Exact top-k by inner product with pivot-table elimination.

Every vector keeps its distances to many pivots. By the triangle inequality the
largest difference between two vectors' distances to the same pivot bounds their
own distance from below, and with their lengths their inner product from above.
A query evaluates candidates in order of that bound, in steps, until the bound of
the next one is under its k-th best score: nothing left can enter.

Candidates lie in blocks of vectors with the same nearest pivot; a block is one
row and knows the least and the greatest distance of its vectors to each pivot.
Each query first searches the blocks of greatest bound, which gives it a floor for
its k-th score, and is then sent to just those other blocks whose bound reaches
its floor. Queries travel, as the narrowest integers; a block of candidates moves
once. So a task holds one block of either side at a time, however many there are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Pivots, the vectors they are picked from, and rows of a block, about.
PIVOTS, PIVOT_SAMPLE = 32, 2_048
CANDIDATE_BLOCK, QUERY_BLOCK = 8_192, 4_096
#: Candidate blocks whose bounds lie in one row.
PAGE = 4_096
#: The least score; as a floor it rules nothing out.
_LEAST = -(2**63)
#: Candidates evaluated at a time for one query.
STEP = 256


def quantised(df: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """vec_id and v, the components as floor(scale * x), x as double.

    Vectors that are null, or hold a null or a non-finite component, take no
    part. Products outside the range of a long take the nearest long."""
    x = lambda c: c.cast("double")
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(x(c)) & (F.abs(x(c)) < float("inf")))
    whole = F.transform(vector, lambda c: F.floor(F.greatest(F.least(x(c) * scale, F.lit(9.2e18)), F.lit(-9.2e18))))
    return df.filter(F.col(vector).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(vec_id).cast("long").alias("vec_id"), whole.alias("v"))


def spread_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first: each pivot is the vector farthest from those before."""
    if not len(sample):
        return sample
    picked, nearest = [0], ((sample - sample[0]) ** 2).sum(1)
    while len(picked) < min(count, len(sample)) and nearest.max() > 0:
        picked.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((sample - sample[picked[-1]]) ** 2).sum(1))
    return sample[picked]


def _padded(vectors: list, dims: int, kind: type = np.int64) -> np.ndarray:
    out = np.zeros((len(vectors), dims), kind)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _narrowest(least: int, most: int) -> type:
    return next(kind for kind in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(kind).min <= least and most <= np.iinfo(kind).max)


def _to_pivots(data: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    data = data.astype(np.float64)
    return np.stack([np.sqrt(((data - p) ** 2).sum(1)) for p in pivots], 1) if len(pivots) else np.zeros((len(data), 0))


def _products(block: np.ndarray, vector: np.ndarray, small: bool) -> np.ndarray:
    """Exact inner products; outside the range of a long, the nearest long."""
    if small:
        return (block @ vector).astype(np.int64)
    exact = block.astype(object) @ vector.astype(object)
    return np.array([min(max(x, -(2**63)), 2**63 - 1) for x in exact], np.int64)


def search_block(queries: dict, candidates: dict, k: int) -> list[tuple[np.ndarray, ...]]:
    """Per query: its number, and the k best candidates' rows and scores, ties to
    the smaller id, never itself, none under the query's floor if it has one; plus
    how many were evaluated."""
    cand, ask = candidates["data"], queries["data"]
    floors = queries.get("floors", np.full(len(ask), _LEAST))
    values, wanted = cand.astype(np.float64), ask.astype(np.float64)
    most = float(np.abs(values).max(initial=0)) * float(np.abs(wanted).max(initial=0)) * cand.shape[1]
    # Floating-point numbers hold such sums exactly.
    small = most < 2**52
    if small:
        kind = np.float32 if most < 2**23 else np.float64
        cand, ask = values.astype(kind), wanted.astype(kind)
    square = (values**2).sum(1)
    far = np.ascontiguousarray(candidates["pivots"].T.astype(np.float32))
    slack = np.float32(4e-7) * max(float(np.abs(far).max(initial=0)), float(np.abs(queries["pivots"]).max(initial=0))) + np.float32(1e-5)
    by_id = np.empty(len(cand), np.int64)
    by_id[np.lexsort((candidates["uids"], candidates["ids"]))] = np.arange(len(cand))
    apart, out = np.empty_like(far), []
    for q in range(len(ask)):
        vector, limit = ask[q], int(floors[q])
        under = np.zeros(len(cand), np.float32)
        if len(far):
            np.subtract(far, queries["pivots"][q].astype(np.float32)[:, None], out=apart)
            np.abs(apart, out=apart)
            apart.max(0, out=under)
        bound = _bound(square + float((wanted[q] ** 2).sum()), np.maximum(under - slack, 0).astype(np.float64))
        bound[candidates["uids"] == queries["uids"][q]] = -np.inf
        # In order of the bounds: the first ones, and then, in order, those that
        # the scores of the first ones don't rule out yet.
        order = np.argpartition(-bound, STEP)[:STEP] if STEP < len(bound) else np.arange(len(bound))
        order = order_first = order[bound[order] >= limit]
        best, score, done, step = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, STEP
        rest, at = None, 0
        while len(order):
            done += len(order)
            found = _products(cand[order], vector, small)
            good = found >= limit
            best, score = np.concatenate([best, order[good]]), np.concatenate([score, found[good]])
            top = np.lexsort((by_id[best], -score))[:k]
            best, score = best[top], score[top]
            if len(best) == k:
                limit = max(limit, int(score[-1]))
            if rest is None:
                bound[order_first] = -np.inf
                rest = np.flatnonzero(bound >= limit)
                rest = rest[np.argsort(-bound[rest], kind="stable")]
            order = rest[at : at + step]
            order = order[bound[order] >= limit]
            # Ever larger steps: few rounds if bounds rule out little.
            at, step = at + step, 2 * step
        out.append((q, best, score, done))
    return out


def _bound(squares: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """What no inner product of vectors with these sums of squared lengths, at least
    so far apart, exceeds; rounding is allowed for. Scores are never under _LEAST."""
    return np.maximum((squares - apart * apart) / 2 + squares * 1e-9 + 1e-6, float(_LEAST))


def routes(queries: dict, page: list, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which queries (rows) go to which blocks of a page (columns): first, those of
    greatest bound that hold k others together, and then, without these, all whose
    bound reaches the query's floor."""
    low, high = (np.array([b[name] for b in page], np.float64).reshape(len(page), -1) for name in ("low", "high"))
    longest, sizes = np.array([b["longest"] for b in page]), np.array([b["n"] for b in page])
    first, then = (np.zeros((len(queries["uids"]), len(page)), bool) for _ in range(2))
    squares = (queries["data"].astype(np.float64) ** 2).sum(1)
    for q in range(len(first)):
        own = queries["pivots"][q]
        apart = np.maximum(low - own, own - high).max(1, initial=0)
        bound = _bound(longest + squares[q], np.maximum(apart * (1 - 1e-9) - own.max(initial=0) * 1e-9, 0))
        order = np.argsort(-bound, kind="stable")
        first[q, order[: 1 + np.searchsorted(np.cumsum(sizes[order]), k + 1)]] = True
        then[q] = (bound >= queries["floors"][q]) & ~first[q]
    return first, then


def _hits(found: list, queries: dict, candidates: dict, block: int) -> pa.RecordBatch:
    each = [len(best) for _, best, _, _ in found]
    rows = np.concatenate([best for _, best, _, _ in found]) if found else np.zeros(0, np.int64)
    scores = np.concatenate([score for _, _, score, _ in found]) if found else np.zeros(0, np.int64)
    qs = np.repeat(np.arange(len(found)), each)
    columns = (np.full(len(rows), block), queries["ids"][qs], queries["uids"][qs], candidates["ids"][rows], candidates["uids"][rows], scores)
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["qb", "query_id", "query", "vec_id", "uid", "score"])


def top_k(vectors: DataFrame, is_query, k: int, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for the rows of vectors (vec_id,
    v: array of long) that is_query holds for, against every other row.

    All candidates if there are fewer than k; ties go to the smaller vec_id.
    Rows with the same vec_id are rows of their own; a null vec_id is never a
    query, and as a candidate loses ties to every other. Shorter vectors count as
    filled up with zeros. An empty table has an empty result."""
    spark = vectors.sparkSession
    base = vectors.select(F.col("vec_id"), F.col("v"), F.coalesce(is_query, F.lit(False)).alias("is_query")).withColumn("uid", F.monotonically_increasing_id())
    base = written(base, "vectors")
    shape = base.agg(
        F.count("*").alias("n"), F.sum(F.col("is_query").cast("long")).alias("q"), F.max(F.size("v")).alias("d"),
        F.min(F.array_min("v")).alias("least"), F.max(F.array_max("v")).alias("most"),
    ).first()
    dims, kind = int(shape.d or 0), _narrowest(shape.least or 0, shape.most or 0)
    if not shape.q:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # A bounded sample, the same in every run: the rows of smallest hash.
    sample = [r.v for r in base.select("v", F.xxhash64("v").alias("h")).orderBy("h").limit(PIVOT_SAMPLE).collect()]
    table = spread_pivots(_padded(sample, dims).astype(np.float64), pivots)
    nulls_last = (1 << 63) - 1

    def nearest(batches):
        for pdf in batches:
            pdf["cell"] = _to_pivots(_padded(pdf.v.tolist(), dims), table).argmin(1)
            yield pdf

    placed = base.withColumn("vec_id", F.coalesce("vec_id", F.lit(nulls_last)))
    placed = written(placed.mapInPandas(nearest, "vec_id long, v array<long>, is_query boolean, uid long, cell int"), "vectors-placed")
    # A row per pivot. Blocks are numbered pivot by pivot; large cells have several.
    cells = {r.cell: -(-r["count"] // CANDIDATE_BLOCK) for r in placed.groupBy("cell").count().collect()}
    counts = [cells.get(i, 0) for i in range(len(table))]
    starts = [sum(counts[:i]) for i in range(len(table))]
    cb = F.get(F.lit(starts), F.col("cell")) + F.pmod(F.xxhash64("uid"), F.get(F.lit([max(c, 1) for c in counts]), F.col("cell")))
    qb = F.pmod(F.xxhash64("uid"), F.lit(-(-shape.q // QUERY_BLOCK)))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid")
        data = _padded(pdf.v.tolist(), dims, kind)
        far = _to_pivots(data, table)
        row = {
            "block": key[0], "n": len(pdf), "ids": pdf.vec_id.to_numpy(np.int64).tobytes(), "uids": pdf.uid.to_numpy(np.int64).tobytes(), "data": data.tobytes(),
            "low": far.min(0).tolist(), "high": far.max(0).tolist(), "longest": float((data.astype(np.float64) ** 2).sum(1).max()),
        }
        return pd.DataFrame([row])

    packed = "block long, n long, ids binary, uids binary, data binary, low array<double>, high array<double>, longest double"
    rows = placed.select("vec_id", "v", "uid", cb.cast("long").alias("block"))
    cand = written(rows.groupBy("block").applyInPandas(pack, packed), "vector-blocks")
    rows = placed.filter("is_query").select("vec_id", "v", "uid", qb.cast("long").alias("block"))
    ask = written(rows.groupBy("block").applyInPandas(pack, packed).select(F.col("block").alias("qb"), "ids", "uids", "data"), "query-blocks")
    # Bounds of at most PAGE blocks in a row; every block of queries meets every
    # page by equal keys.
    blocks = sum(counts)
    pages = cand.groupBy(F.floor(F.col("block") / PAGE).alias("page")).agg(F.collect_list(F.struct("block", "n", "low", "high", "longest")).alias("bounds"))
    parts = max(2 * spark.sparkContext.defaultParallelism, blocks // 8)

    def unpacked(row: dict) -> dict:
        data = np.frombuffer(row["data"], kind).reshape(-1, dims)
        out = {"ids": np.frombuffer(row["ids"], np.int64), "uids": np.frombuffer(row["uids"], np.int64), "data": data, "pivots": _to_pivots(data, table)}
        known = {x["query"]: x["floor"] for x in row.get("floors") or ()}
        return out | {"floors": np.array([known.get(u, _LEAST) for u in out["uids"].tolist()], np.int64)}

    def found(queries: DataFrame, again: bool) -> DataFrame:
        """The hits of the queries in the blocks that they go to first, or then."""

        def send(batches):
            for row in (r for batch in batches for r in batch.to_pylist()):
                asked, page = unpacked(row), sorted(row["bounds"], key=lambda b: b["block"])
                for b, goes in zip(page, routes(asked, page, k)[again].T, strict=True):
                    if goes.any():
                        sent = [asked[name][goes].tobytes() for name in ("ids", "uids", "data", "floors")]
                        yield pa.RecordBatch.from_pylist([dict(zip(("cb", "qb", "q_ids", "q_uids", "q_data", "q_floors"), (b["block"], row["qb"], *sent), strict=True))])

        def search(batches):
            for row in (batch.slice(i, 1).to_pylist()[0] for batch in batches for i in range(batch.num_rows)):
                c = unpacked({name: row[name] for name in ("ids", "uids", "data")})
                q = unpacked({name: row[f"q_{name}"] for name in ("ids", "uids", "data")}) | {"floors": np.frombuffer(row["q_floors"], np.int64)}
                yield _hits(search_block(q, c, k), q, c, row["qb"])

        spread = queries.withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((blocks - 1) // PAGE).cast("long"))))
        met = spread.join(pages.hint("shuffle_hash"), "page")
        packets = met.mapInArrow(send, "cb long, qb long, q_ids binary, q_uids binary, q_data binary, q_floors binary").repartition(parts, "cb")
        held = cand.select(F.col("block").alias("cb"), "ids", "uids", "data").repartition(parts, "cb").hint("shuffle_hash")
        return packets.join(held, "cb").mapInArrow(search, "qb long, query_id long, query long, vec_id long, uid long, score long")

    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "uid")
    hits = written(found(ask, False).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).drop("rank"), "first-hits")
    floors = hits.groupBy("qb", "query").agg(F.min("score").alias("floor"), F.count("*").alias("n")).filter(F.col("n") == k)
    floors = floors.groupBy("qb").agg(F.collect_list(F.struct("query", "floor")).alias("floors"))
    hits = hits.union(found(ask.join(floors, "qb", "left"), True))
    return (
        hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        .select("query_id", "rank", F.nullif("vec_id", F.lit(nulls_last)).alias("vec_id"), "score")
    )
