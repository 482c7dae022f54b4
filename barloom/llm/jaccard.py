"""Exact Jaccard join on word shingles by partitions of the universe.

Similar sets differ in few elements, so if a hash deals elements out to more
segments than that, similar sets agree on some segment. Sets are grouped in bands
of sizes whose neighbours alone can be similar; the number of segments follows
the band. A plain segment counts 1: sets that agree on it are candidates. A wide
segment counts 2: sets that differ in one element there meet too, over keys that
leave one element out. If the counts of the segments that a set looks into exceed
the elements it may differ in, it misses no similar set.

Every set has more segments than it needs, and so may leave some out. It leaves
out those whose keys many others hold (the allocation by cost): keys of few sets
give candidates at once; keys of many are looked into only where a set couldn't
do without, first against one of their holders. Sets that share such keys and are
still not connected are dealt out once more, with a segment for each element, of
which a set needs only the rarest, and compared in blocks. Candidates are verified
on their texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import arrow_rows, on_workers, release, slices, tidy, written
from .shingles import batches_of, mix, set_id, shingle_sets

#: Similar: 100 * intersection >= 75 * union.
PERCENT = 75
#: Keys that one reducer sorts, about, and holders of a key all paired at once.
REDUCER_KEYS, FEW = 3_000_000, 12
#: Entries of a reducer that are ordered at once, about; elements whose entries are
#: made at once.
ORDERED, BUNDLE = 750_000, 1 << 19
#: Buckets of the filter that finds the texts of candidates; a fixed size.
FILTER = 1 << 22
#: Sets of a block, elements counted as frequent, matrix columns at a time.
BLOCK_SETS, OFTEN, COLUMNS = 2_048, 8, 2_048
#: Counters of the table that tells rare elements from frequent ones.
COUNTERS = 1 << 18
#: A table of wanted documents above so many rows is joined by a shuffle.
BROADCAST_ROWS = 50_000
#: Pairs of texts that a Python worker holds at once.
PAIR_ROWS = 500
#: A key that holds more than this part of all rows is heavy; there are fewer
#: heavy keys than parts.
HEAVY = 1_000


def _bands() -> np.ndarray:
    """First sizes of the bands: a similar set lies in the same or next band."""
    firsts = [1]
    while firsts[-1] < 1 << 40:
        firsts.append(firsts[-1] * 100 // PERCENT + 1)
    return np.array(firsts, np.int64)


BANDS = _bands()


def most_apart(a, b):
    """Elements in which similar sets of these sizes can differ at most."""
    return (100 - PERCENT) * (a + b) // (100 + PERCENT)


@dataclass
class Layout:
    """Segments of each band: how many are plain, how many are wide."""

    plain: np.ndarray
    wide: np.ndarray


def _layout() -> Layout:
    top = BANDS[1:] - 1
    need = most_apart(top, top) + 1
    # Few segments are wide, but where there are few at all; always as many
    # segments as are needed, so that empty ones can make up for filled ones; and
    # so many more that sets of the band hardly ever need empty ones.
    count = need + 4 + need // 5 + 2 * np.sqrt(need).astype(np.int64)
    wide = np.where(need <= 8, need + 4, 1 + need // 20)
    plain = np.where(need <= 8, 0, count - 2 * wide)
    whole = need <= 2
    return Layout(np.where(whole, 0, plain), np.where(whole, 1, wide))


LAYOUT = _layout()
OWN, LEFT_OUT, TWICE = 1, 2, 4  # flags of an entry


def keys_of(sets: list[np.ndarray], ahead: bool, only_empty: set[tuple[int, int]] | None = None):
    """Entries (set number, key, flags) of the sets in their own band or, looking
    ahead, in the next one; and per set what it can spare: the counts of its
    segments beyond those it needs. Sets that can't differ from any similar one
    have none. With only_empty, the keys of the empty segments named there."""
    sizes = np.array([len(s) for s in sets], np.int64)
    band = np.searchsorted(BANDS, np.maximum(sizes, 1), "right") - 1
    home = band + ahead
    largest = np.minimum(BANDS[home + 1] - 1, sizes * 100 // PERCENT)
    apart = most_apart(sizes, largest)
    # Looking ahead, a set needs a partner size that the next band has.
    takes = (sizes > 0) & (LAYOUT.plain[home] + 2 * LAYOUT.wide[home] > 0) & (largest >= BANDS[home]) & ((most_apart(BANDS[home + 1] - 1, BANDS[home + 1] - 1) > 0) | ahead)
    spare = np.zeros(len(sets), np.int64)
    rows = np.flatnonzero(takes)
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint8), spare
    plain, segments = LAYOUT.plain[home[rows]], (LAYOUT.plain + LAYOUT.wide)[home[rows]]
    elements = np.concatenate([sets[i] for i in rows])
    row = np.repeat(np.arange(len(rows)), sizes[rows])
    value = mix(elements ^ np.uint64(0x5851F42D4C957F2D))
    segment = ((mix(elements + np.uint64(0x14057B7EF767814F)) >> np.uint64(32)) * segments[row].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    base = np.cumsum(segments) - segments
    slot = base[row] + segment
    total = int(segments.sum())
    content = np.zeros(total, np.uint64)
    np.add.at(content, slot, value)
    count = np.bincount(slot, minlength=total)
    of = np.repeat(np.arange(len(rows)), segments)
    number = np.arange(total) - base[of]
    is_wide = number >= plain[of]
    salt = mix((home[rows][of].astype(np.uint64) << np.uint64(40)) + number.astype(np.uint64) + np.uint64(1))
    flag = np.uint8(0 if ahead else OWN)
    if only_empty is not None:
        asked = np.zeros(total, bool)
        for b, s in only_empty:
            asked |= (home[rows][of] == b) & (number == s)
        at = np.flatnonzero((count == 0) & asked)
        return rows[of[at]], mix(salt[at]), np.full(len(at), flag), spare
    counts_for = np.where(count == 0, 0, np.where(is_wide & (count > 1), 2, 1))
    before = np.cumsum(counts_for) - counts_for
    before -= before[base][of]
    need = apart[rows] + 1
    held = np.bincount(of, counts_for, len(rows)).astype(np.int64)
    # Looking ahead a set shows no more segments than it may want to look into.
    shown = held if not ahead else np.minimum(held, need + 2 + need // 5)
    used = (count > 0) & (before < shown[of])
    spare[rows] = np.bincount(of, counts_for * used, len(rows)).astype(np.int64) - need
    at = np.flatnonzero(used)
    two = counts_for == 2
    keys, owner = [mix(content[at] + salt[at])], [rows[of[at]]]
    flags = [np.where(two[at], flag | np.uint8(TWICE), flag).astype(np.uint8)]
    less = np.flatnonzero(used[slot] & two[slot])
    keys.append(mix(content[slot[less]] - value[less] + salt[slot[less]]))
    owner.append(rows[row[less]])
    flags.append(np.full(len(less), flag | np.uint8(TWICE | LEFT_OUT), np.uint8))
    return np.concatenate(owner), np.concatenate(keys), np.concatenate(flags), spare


def signature(shingles: np.ndarray) -> bytes:
    """Parities of the elements' hashes, a bit for about each element: the bits in
    which two signatures differ are no more than the elements in which sets do."""
    bits = 1 << max(9, (len(shingles) - 1).bit_length())
    return np.packbits(np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def surely_apart(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) > len(y):
        x, y = y, x
    folded = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ folded).sum())


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if not len(a) or not len(b):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def _set_rows(batches):
    """doc_id, text hash -> size, set number, signature."""
    for batch in slices(batches):
        column = batch.column(2)
        nodes, sizes, signs = [], [], []
        for _, data, offsets in batches_of(column):
            for s in shingle_sets(data, offsets):
                sizes.append(len(s))
                nodes.append(set_id(s) if len(s) else None)
                signs.append(signature(s) if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(signs, pa.binary())],
            names=["doc_id", "th", "node", "n_shingles", "sign"],
        )


def _key_blobs(parts: int, only_empty: set[tuple[int, int]] | None = None):
    """Texts -> per reducer one row for each bundle of sets: the set numbers, what
    they can spare in their own band and ahead, and their entries in columns."""

    def run(batches):
        seen: set[int] = set()
        for batch in slices(batches):
            for _, data, offsets in batches_of(batch.column(0)):
                sets, nodes, elements = [], [], 0
                for s in shingle_sets(data, offsets):
                    node = set_id(s) if len(s) else None
                    # Copies within a task have the same entries.
                    if node is not None and node not in seen:
                        seen.add(node)
                        sets.append(s)
                        nodes.append(node)
                        elements += len(s)
                    if elements > BUNDLE:
                        yield from _bundle(sets, np.array(nodes, np.int64), parts, only_empty)
                        sets, nodes, elements = [], [], 0
                if len(seen) > 1 << 18:
                    seen.clear()
                if sets:
                    yield from _bundle(sets, np.array(nodes, np.int64), parts, only_empty)

    return tidy(run)


def _bundle(sets: list[np.ndarray], nodes: np.ndarray, parts: int, only_empty):
    own = keys_of(sets, False, only_empty)
    ahead = keys_of(sets, True, only_empty)
    owner = np.concatenate([own[0], ahead[0]])
    key = np.concatenate([own[1], ahead[1]])
    flags = np.concatenate([own[2], ahead[2]])
    short = np.flatnonzero((own[3] < 0) | (ahead[3] < 0))
    part = ((key >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((owner, part))
    part, owner, key, flags = part[order], owner[order], key[order], flags[order]
    out: dict[str, list] = {"part": [], "nodes": [], "spare": [], "entries": []}
    edges = np.searchsorted(part, np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(edges)).tolist():
        lo, hi = edges[p], edges[p + 1]
        here, index = np.unique(owner[lo:hi], return_inverse=True)
        spare = np.stack([own[3][here], ahead[3][here]]).clip(-1, 32767).astype("<i2")
        out["part"].append(p)
        out["nodes"].append(nodes[here].tobytes())
        out["spare"].append(spare.tobytes())
        k = key[lo:hi]
        out["entries"].append(index.astype("<u2").tobytes() + flags[lo:hi].tobytes() + (k & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + ((k >> np.uint64(32)) & np.uint64(0xFF)).astype(np.uint8).tobytes())
    if len(short) and only_empty is None:
        # Sets with too few filled segments also need some of the empty ones.
        out["part"].append(-1)
        out["nodes"].append(nodes[short].tobytes())
        out["spare"].append(b"")
        out["entries"].append(np.array([len(sets[i]) for i in short], np.int64).tobytes())
    yield pa.RecordBatch.from_arrays([pa.array(out["part"], pa.int32()), *(pa.array(out[c], pa.binary()) for c in ("nodes", "spare", "entries"))], names=list(out))


_FOUND = "kind int, a long, b long, key long, cost long, weight int, spare int, flags int"


def _rows(kind: int, a, b, key, cost, weight, spare, flags) -> pa.RecordBatch:
    n = len(a)
    full = lambda x, t: pa.array(np.broadcast_to(np.asarray(x), n).astype(t))
    return pa.RecordBatch.from_arrays(
        [full(kind, np.int32), full(a, np.int64), full(b, np.int64), full(key, np.int64), full(cost, np.int64), full(weight, np.int32), full(spare, np.int32), full(flags, np.int32)],
        names=["kind", "a", "b", "key", "cost", "weight", "spare", "flags"],
    )


def _meet(few: int):
    """Entries of a reducer -> candidate pairs (kind 0) of keys with up to `few`
    holders, all entries (kind 1) of other keys, with the number of their
    partners; sets that were short of segments (kind 2)."""

    def part_rows(part: int, rows: list[tuple[bytes, bytes, bytes]]):
        # The entries stay packed; a share of the keys is unpacked and ordered at a
        # time, however many a reducer has got.
        shares = 1 + sum(len(e) // 8 for *_, e in rows) // ORDERED
        for share in range(shares):
            yield from share_rows(part, rows, share, shares)

    def share_rows(part: int, rows: list[tuple[bytes, bytes, bytes]], share: int, shares: int):
        nodes, spares, keys, flags = [], [], [], []
        for n, s, e in rows:
            own = np.frombuffer(n, np.int64)
            spare = np.frombuffer(s, "<i2").reshape(2, -1)
            count = len(e) // 8
            low = np.frombuffer(e, "<u4", count, 3 * count)
            at = np.flatnonzero(low % np.uint32(shares) == share) if shares > 1 else slice(None)
            index = np.frombuffer(e, "<u2", count)[at]
            f = np.frombuffer(e, np.uint8, count, 2 * count)[at]
            high = np.frombuffer(e, np.uint8, count, 7 * count)[at].astype(np.int64)
            nodes.append(own[index])
            flags.append(f)
            keys.append((high << 32) | low[at].astype(np.int64))
            spares.append(np.where(f & OWN, spare[0][index], spare[1][index]).astype(np.int16))
        if not sum(map(len, keys)):
            return
        node, flag, key, spare = map(np.concatenate, (nodes, flags, keys, spares))
        del nodes, flags, keys, spares
        order = np.lexsort((flag, node, key))
        node, flag, key, spare = node[order], flag[order], key[order], spare[order]
        del order
        same = (key[1:] == key[:-1]) & (node[1:] == node[:-1]) & (flag[1:] == flag[:-1])
        keep = np.concatenate([[True], ~same])
        node, flag, key, spare = node[keep], flag[keep], key[keep], spare[keep]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        size = np.diff(np.append(first, len(key)))
        sums = lambda x: np.add.reduceat(x.astype(np.int64), first)
        is_own, whole = (flag & OWN) > 0, (flag & LEFT_OUT) == 0
        own_whole, own_less = sums(is_own & whole), sums(is_own & ~whole)
        all_whole, all_less = sums(whole), sums(~whole)
        # Partners of an entry: own ones meet all, others only own ones; two keys
        # that each leave an element out don't count as meeting.
        partners = np.where(is_own, np.where(whole, (all_whole + all_less)[group] - 1, all_whole[group]), np.where(whole, (own_whole + own_less)[group], own_whole[group]))
        busy = size[group] > few
        out = np.flatnonzero(busy & (partners > 0))
        if len(out):
            number = (np.int64(part) << 40) | key[out]
            yield _rows(1, node[out], 0, number, partners[out], np.where(flag[out] & TWICE, 2, 1), spare[out], flag[out])
        # Entries of small groups meet at every distance up to the group's size.
        small = np.flatnonzero(~busy & (partners > 0))
        found = []
        for step in range(1, few):
            x = small[small + step < len(key)]
            y = x + step
            ok = (group[x] == group[y]) & (is_own[x] | is_own[y]) & (whole[x] | whole[y]) & (node[x] != node[y])
            if not ok.any():
                continue
            found.append(np.stack([np.minimum(node[x[ok]], node[y[ok]]), np.maximum(node[x[ok]], node[y[ok]])], 1))
        if found:
            pairs = np.unique(np.concatenate(found), axis=0)
            yield _rows(0, pairs[:, 0], pairs[:, 1], 0, 0, 0, 0, 0)

    def run(batches):
        # Rows come sorted by reducer number; a reducer's rows are its share of
        # all keys, as many as REDUCER_KEYS says.
        part, held = None, []
        for batch in batches:
            for p, n, s, e in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if p < 0:
                    short, sizes = np.frombuffer(n, np.int64), np.frombuffer(e, np.int64)
                    yield _rows(2, short, sizes, 0, 0, 0, 0, 0)
                    continue
                if p != part and held:
                    yield from part_rows(part, held)
                    held = []
                part = p
                held.append((n, s, e))
        if held:
            yield from part_rows(part, held)

    return tidy(run)


def _filtered(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, th, text of the documents wanted (doc_id, th), one row for each.

    A filter of fixed size, read into every task, lets few other texts through to
    the join; if it fills up, the join alone decides."""
    place = F.pmod(F.xxhash64("doc_id", "th"), F.lit(FILTER)).cast("int")
    hit = np.zeros(FILTER, bool)
    hit[[r.p for r in wanted.select(place.alias("p")).distinct().collect()]] = True
    shared = on_workers(texts.sparkSession, np.packbits(hit))

    def run(batches):
        bits = np.unpackbits(shared()).view(bool)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(3)], names=["doc_id", "th", "text"]).filter(pa.array(bits[batch.column(3).to_numpy()]))

    kind = dict(texts.dtypes)["doc_id"]
    passed = texts.select("doc_id", "th", "text", place.alias("p")).mapInArrow(run, f"doc_id {kind}, th long, text string")
    keyed = wanted.select(F.col("doc_id").alias("d"), F.col("th").alias("h"), "node")
    keyed = F.broadcast(keyed) if wanted.count() <= BROADCAST_ROWS else keyed
    found = passed.join(keyed, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h"))).select("node", "text")
    return written(found.groupBy("node").agg(F.first("text").alias("text")), "candidate-texts")


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b of set numbers) whose sets are similar."""
    sides = {s: nodes.select(F.col("node").alias(s), F.col("n_shingles").alias(f"n{s}"), F.col("sign").alias(f"s{s}")) for s in "ab"}
    pairs = pairs.select("a", "b").distinct()
    signed = pairs.join(sides["a"], "a").join(sides["b"], "b").filter(f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)")

    def prune(batches):
        for batch in batches:
            c = {n: batch.column(n) for n in batch.schema.names}
            na, nb = c["na"].to_numpy(), c["nb"].to_numpy()
            least = np.array([surely_apart(x.as_py(), y.as_py()) for x, y in zip(c["sa"], c["sb"], strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays([c["a"], c["b"]], names=["a", "b"]).filter(pa.array(least <= most_apart(na, nb)))

    likely = written(signed.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(prune, "a long, b long"), "likely-pairs")
    ends = likely.select(F.col("a").alias("node")).union(likely.select(F.col("b").alias("node"))).distinct()
    wanted = written(nodes.join(ends, "node", "left_semi").select("node", "doc_id", "th"), "candidates")
    found = _filtered(texts, wanted)
    ta, tb = (found.select(F.col("node").alias(s), F.col("text").alias(f"t{s}")) for s in "ab")

    def check(batches):
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            made: dict[int, np.ndarray] = {}
            for column, names in ((2, a), (3, b)):
                for at, data, offsets in batches_of(batch.column(column)):
                    made.update(zip(names[at : at + len(offsets) - 1], shingle_sets(data, offsets), strict=True))
            ok = [similar(made[x], made[y]) for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    joined = likely.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb")
    with arrow_rows(texts.sparkSession, PAIR_ROWS):
        return written(joined.mapInArrow(tidy(check), "a long, b long"), "links")


def _entries(found: DataFrame) -> DataFrame:
    rows = found.filter("kind = 1").select(F.col("a").alias("node"), "key", "cost", "weight", "spare", "flags")
    flag = lambda f: F.col("flags").bitwiseAND(F.lit(f)) > 0
    return rows.withColumn("own", flag(OWN)).withColumn("less", flag(LEFT_OUT))


def _met_on(ask: DataFrame, holders: DataFrame) -> DataFrame:
    """Pairs of sets that ask for a key with sets that hold it."""
    other = holders.select("key", *[F.col(c).alias(f"{c}2") for c in holders.columns if c != "key"])
    ok = (F.col("node") != F.col("node2")) & (F.col("own") | F.col("own2")) & ~(F.col("less") & F.col("less2"))
    met = ask.join(other, "key").filter(ok)
    return met.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b"))


def _links(texts: DataFrame, nodes: DataFrame, total: int) -> DataFrame:
    """Links (a, b) that connect just the sets which similar pairs connect."""
    spark = texts.sparkSession
    # A set costs its number in every part, so no more parts than memory asks for.
    parts = max(1, -(-total // REDUCER_KEYS))
    schema = "part int, nodes binary, spare binary, entries binary"

    def met(few, only_empty=None) -> DataFrame:
        blobs = texts.select("text").mapInArrow(_key_blobs(parts, only_empty), schema)
        dealt = blobs.repartition(parts, "part").sortWithinPartitions("part")
        out = written(dealt.mapInArrow(_meet(few), _FOUND), "met")
        del blobs, dealt
        release(spark)
        return out

    found = met(FEW)
    pairs = found.filter("kind = 0").select("a", "b")
    short = found.filter("kind = 2").select("a", F.col("b").alias("n")).distinct()
    sizes = [r.n for r in short.select("n").distinct().collect()]
    if sizes:
        # Sets almost all of whose segments are empty also look into the empty
        # ones: the number of segments of their bands is small.
        asked = {(int(b), s) for n in sizes for b in (np.searchsorted(BANDS, n, "right") - 1, np.searchsorted(BANDS, n, "right")) for s in range(int(LAYOUT.plain[b] + LAYOUT.wide[b]))}
        empty = _entries(met(1, asked))
        lone = empty.join(short.select(F.col("a").alias("node")).distinct(), "node", "left_semi")
        pairs = pairs.union(_met_on(lone, empty))
    # The allocation: a set leaves out its most expensive keys while it can spare
    # what they count. A segment's keys count each for the whole of it.
    entries = _entries(found)
    dearest = Window.partitionBy("node", "own").orderBy(F.desc("cost"), "key", "less")
    spent = F.sum("weight").over(dearest.rowsBetween(Window.unboundedPreceding, 0))
    kept = written(entries.withColumn("spent", spent).filter("spent > spare").select("node", "key", "own", "less"), "kept-keys")
    # Written tables on both sides let Spark split the rows of a frequent key.
    wanted = written(kept.select("key").distinct(), "wanted-keys")
    holders = entries.select("key", "node", "own", "less").join(wanted, "key", "left_semi")
    holders = written(holders, "holders")
    pivots = written(holders.filter("own and not less").groupBy("key").agg(F.min("node").alias("b")), "pivots")
    stars = kept.join(pivots, "key").filter("node <> b").select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b"))
    links = _verified(pairs.union(stars), nodes, texts)
    if kept.isEmpty():
        return links
    # What is left: keys whose holders are not all connected.
    roots = written(components(links), "roots")
    rooted = lambda df: df.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    holders = written(rooted(holders), "rooted-holders")
    torn = holders.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
    torn = written(torn, "torn-keys")
    fine = written(holders.join(torn, "key", "left_semi").select("node", "root").distinct(), "fine-sets")
    return links.union(_finer_links(fine, nodes, texts))


def _finer_links(fine: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links among sets (node, root) that share frequent keys and aren't connected:
    each element is now a segment of its own, and a set looks into its rarest ones,
    as many as no similar set can lack all of. What is rare is counted among these
    sets, in a table of fixed size; any order would find all similar pairs, this
    one compares few others. Sets that share an element are compared in blocks
    within tasks, which return no more links than connect them."""
    wanted = nodes.join(fine, "node", "left_semi").select("node", "doc_id", "th")
    found = _filtered(texts, written(wanted, "fine-documents"))
    shift = np.uint64(64 - COUNTERS.bit_length() + 1)

    def count(batches):
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for _, data, offsets in batches_of(batch.column(0)):
                for s in shingle_sets(data, offsets):
                    np.add.at(total, (mix(s) >> shift).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["place", "n"])

    counts = found.select("text").mapInArrow(count, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(COUNTERS, np.int64)
    table[counts.place.to_numpy()] = counts.n.to_numpy()
    shared = on_workers(texts.sparkSession, table)

    def rarest(batches):
        for batch in batches:
            names, owner, elements = batch.column(0).to_numpy(), [], []
            for at, data, offsets in batches_of(batch.column(1)):
                for i, s in enumerate(shingle_sets(data, offsets)):
                    looked = len(s) - -(-PERCENT * len(s) // 100) + 1
                    order = np.lexsort((s, shared()[(mix(s) >> shift).astype(np.int64)]))[:looked]
                    elements.append(s[order].astype(np.int64))
                    owner.append(np.full(len(order), names[at + i]))
            if owner:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(owner)), pa.array(np.concatenate(elements))], names=["node", "element"])

    rows = found.select("node", "text").mapInArrow(rarest, "node long, element long").join(fine, "node")
    torn = rows.groupBy("element").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("element")
    rows = written(rows.join(written(torn, "torn-elements"), "element", "left_semi"), "fine-elements")
    # No longer than a document's share of rare elements.
    listed = rows.groupBy("node").agg(F.collect_list("element").alias("elements"))
    # A block, or two, of the sets that share an element meet in a task.
    blocks = rows.groupBy("element").agg(F.ceil(F.count("*") / BLOCK_SETS).cast("int").alias("blocks"))
    rows = rows.join(written(blocks, "element-blocks"), "element")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("element", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "root")
    # Signatures go first: two sets are compared at the first element they share,
    # unless their bits rule it out. Only sets with a partner bring their texts.
    about = nodes.select("node", "n_shingles", "sign").join(listed, "node")
    signed = rows.join(about, "node").select("element", "i", "j", "node", "root", F.struct("n_shingles", "sign", F.expr("filter(elements, e -> e < element)").alias("smaller")).alias("what"))
    signed = signed.repartition("element", "i", "j").sortWithinPartitions("element", "i", "j")
    group = "element long, i int, j int, node long, root long"
    rows = written(signed.mapInArrow(_by_group(_hopeful, group), group), "hopeful")
    met = rows.join(found, "node").repartition("element", "i", "j").sortWithinPartitions("element", "i", "j")
    met = met.select("element", "i", "j", "node", "root", F.col("text").alias("what"))
    with arrow_rows(texts.sparkSession, PAIR_ROWS):
        return written(met.mapInArrow(_by_group(_connecting, "a long, b long"), "a long, b long"), "fine-links")


def common(sets: list[np.ndarray]) -> np.ndarray:
    """Elements that each two of the sets share. Frequent elements are counted by
    products of matrices, a bounded number of columns at a time, others pair by
    pair."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, which, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = np.zeros((len(sets), len(sets)), np.float32)
    often = np.flatnonzero(counts >= OFTEN)
    column = np.full(len(counts), -1, np.int64)
    column[often] = np.arange(len(often))
    for first in range(0, len(often), COLUMNS):
        at = np.flatnonzero((column[which] >= first) & (column[which] < first + COLUMNS))
        part = np.zeros((len(sets), min(COLUMNS, len(often) - first)), np.float32)
        part[owner[at], column[which[at]] - first] = 1
        out += part @ part.T
    rest = np.flatnonzero((counts[which] > 1) & (counts[which] < OFTEN))
    rest = rest[np.argsort(which[rest], kind="stable")]
    for step in range(1, OFTEN - 1):
        x, y = rest[:-step], rest[step:]
        same = which[x] == which[y]
        a, b = owner[x[same]], owner[y[same]]
        np.add.at(out, (a, b), 1)
        np.add.at(out, (b, a), 1)
    return out


def _by_group(make, schema: str):
    """Rows sorted by (element, i, j) -> what make gives for each group of them:
    its key and its rows of set, root, and text or signature. Two blocks of sets
    at most are held."""
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32()}
    types = [kinds[part.split()[1]] for part in schema.split(", ")]

    def run(batches):
        def done(key, held):
            rows = make(key, held) if len({root for _, root, _ in held}) > 1 else []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        key, held = None, []
        for batch in batches:
            for *group, node, root, what in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if group != key and held:
                    yield from done(key, held)
                    held = []
                key = group
                held.append((node, root, what))
        if held:
            yield from done(key, held)

    return run


def _hopeful(key: list, rows: list) -> list[tuple]:
    """The rows that signatures leave a partner of another root with which they
    share no smaller element."""
    root = np.array([r for _, r, _ in rows])
    size = np.array([w["n_shingles"] for *_, w in rows])
    signs = [np.frombuffer(w["sign"], np.uint8) for *_, w in rows]
    length = np.array([len(x) for x in signs])
    hope = np.zeros(len(rows), bool)
    smaller = [np.array(w["smaller"], np.int64) for *_, w in rows]
    first_here = (common(smaller) == 0) & (root[:, None] != root[None, :])
    for short in np.unique(length):
        # Signatures are as long, or those of similar sets twice as long.
        at = np.flatnonzero((length == short) | (length == 2 * short))
        folded = np.stack([np.bitwise_xor.reduce(signs[i].reshape(-1, short), axis=0) for i in at])
        ones = np.bitwise_count(folded).sum(1, dtype=np.float32)
        shared = np.zeros((len(at), len(at)), np.float32)
        for first in range(0, int(short), COLUMNS // 8):
            bits = np.unpackbits(folded[:, first : first + COLUMNS // 8], axis=1).astype(np.float32)
            shared += bits @ bits.T
        apart = ones[:, None] + ones[None, :] - 2 * shared
        n = size[at]
        likely = (apart <= most_apart(n[:, None], n[None, :])) & (100 * np.minimum(n[:, None], n[None, :]) >= PERCENT * np.maximum(n[:, None], n[None, :]))
        hope[at] |= (likely & first_here[np.ix_(at, at)]).any(1)
    return [(*key, rows[i][0], rows[i][1]) for i in np.flatnonzero(hope)]


def _connecting(key: list, rows: list) -> list[tuple[int, int]]:
    """Links that connect the roots of a block's similar sets, no more."""
    roots, root = np.unique([r for _, r, _ in rows], return_inverse=True)
    sets: list[np.ndarray] = []
    for _, data, offsets in batches_of(pa.array([t for *_, t in rows], pa.string())):
        sets += shingle_sets(data, offsets)
    size = np.array([len(s) for s in sets])
    both = common(sets)
    near = (100 * both >= PERCENT * (size[:, None] + size[None, :] - both)) & (root[:, None] < root[None, :])
    i, j = np.nonzero(near)
    _, first = np.unique(root[i] * len(roots) + root[j], return_index=True)
    parent = list(range(len(roots)))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for at in first.tolist():
        x, y = top(int(root[i[at]])), top(int(root[j[at]]))
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((rows[i[at]][0], rows[j[at]][0]))
    return out


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of
    0.75 or more: doc_id, th (hash of the text), n_shingles, component_id (the
    smallest doc_id of the component), and stays: whether the document stands for
    its component, as its repetitions then do too.

    Documents without words, null texts too, have an empty set and are their own
    component. Documents with equal sets, repeated rows too, are linked. A null
    doc_id is nobody's smallest; a component of such rows alone has a null
    component_id. Further columns are left out; an empty table stays empty. Texts
    of any length are read whole."""
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    kind = dict(texts.dtypes)["doc_id"]
    sets = texts.select("doc_id", "th", "text").mapInArrow(tidy(_set_rows), f"doc_id {kind}, th long, node long, n_shingles long, sign binary")
    sets = written(sets, "sets")
    # One document stands for each set: the smallest doc_id, then text hash.
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("rep")
    nodes = sets.filter("node is not null").groupBy("node").agg(smallest, F.max("n_shingles").alias("n_shingles"), F.max("sign").alias("sign"), F.count("*").alias("copies"))
    nodes = written(nodes.select("node", "rep", F.col("rep.doc_id").alias("doc_id"), F.col("rep.th").alias("th"), "n_shingles", "sign", "copies"), "set-numbers")
    total, rows = nodes.agg(F.sum("n_shingles"), F.sum("copies")).first()
    links = _links(texts, nodes, int(total or 0))
    roots = written(components(links), "components")
    members = nodes.select("node", "rep", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    reps = members.groupBy("root").agg(F.min("rep").alias("rep"))
    member = written(members.drop("rep").join(reps, "root").select("node", "copies", "rep"), "members")
    # Fewer than HEAVY sets can have more than that part of all documents; they
    # reach the documents by broadcast, the others by a shuffle.
    limit = (rows or 0) // HEAVY + 1
    heavy = F.broadcast(member.filter(F.col("copies") > limit).select("node", F.col("rep").alias("heavy")))
    near = sets.select("doc_id", "th", "node", "n_shingles").join(heavy, "node", "left")
    light = member.filter(F.col("copies") <= limit).select("node", "rep")
    alone = near.filter("node is null").withColumn("rep", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th"))
    many = near.filter("heavy is not null").withColumn("rep", F.col("heavy"))
    few = near.filter("node is not null and heavy is null").join(light, "node")
    out = [F.col("doc_id"), F.col("th"), F.col("n_shingles"), F.col("rep.doc_id").alias("component_id")]
    out.append((F.col("doc_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("th") == F.col("rep.th"))).alias("stays"))
    return alone.select(*out).union(many.select(*out)).union(few.select(*out))
