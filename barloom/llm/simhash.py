"""SimHash fingerprints and their neighbours, in DataFrame operations only.

A text's terms are its five-word shingles; each occurrence votes with the 128
bits of the term's hash, and the sign of the vote at each bit is the fingerprint's
bit. Votes are added as lanes: a long holds four counters of 16 bits, so a term
costs 32 additions instead of 128.

Neighbours within a Hamming radius share all but `radius` of some blocks of bits.
One table per choice of blocks that might be equal holds the fingerprints keyed
by those blocks (as a permutation that moves them to the front would). Farther
neighbours often share as many blocks by chance.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import acos, pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import release, written

WORDS, BITS = 5, 128
#: Votes that a 16-bit lane can hold without touching the sign of a long.
CHUNK = 1 << 14
_LANES = 0x0001000100010001
_HALVES = 0x0000FFFF0000FFFF
#: Documents of a range, about; ranges at most (their limits are a literal).
RANGE_ROWS, RANGES = 2_048, 1 << 16
#: Fingerprints of an array; those of a key that has more are dealt into several.
ARRAY = 512
#: Rows of a key up to which it is joined, at least; rows in an array of others.
COMMON, CELL = 64, 2_048
#: A table of counts above so many rows is joined by a shuffle.
BROADCAST_ROWS = 10_000
_BLANKS = "[\\x20\\x09-\\x0D]+"


def terms(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, pos, term: the hashes of a text's shingles of WORDS words, one per
    occurrence; of the whole text if it has fewer words. A text without words has
    one empty term, so every text has a row."""
    # Words are a column of their own, or each shingle would split the text anew;
    # the outer explode keeps Spark from filtering on the terms beforehand.
    words = texts.select(*keys, F.split(F.regexp_replace(F.col(text), f"^{_BLANKS}|{_BLANKS}$", ""), _BLANKS).alias("_words"))
    first = F.slice("_words", F.lit(1), F.greatest(F.size("_words") - (WORDS - 1), F.lit(1)))
    hashed = F.transform(first, lambda w, i: F.xxhash64(w, *[F.get("_words", i + k) for k in range(1, WORDS)]))
    return words.select(*keys, F.posexplode_outer(hashed).alias("pos", "term"))


def _votes(hashed: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the fingerprint's two halves, from rows of key, pos and term."""
    mixed = hashed.withColumn("chunk", F.shiftright("pos", 14)).select(*keys, "chunk", F.col("term").alias("t0"), F.xxhash64("term", F.lit(1)).alias("t1"))
    lane = lambda c, j: F.sum(F.shiftrightunsigned(c, j).bitwiseAND(F.lit(_LANES)))
    narrow = mixed.groupBy(*keys, "chunk").agg(F.count("*").alias("n"), *[lane(f"t{w}", j).alias(f"s{w}_{j}") for w in (0, 1) for j in range(16)])
    # A chunk's lanes widen to 32 bits before chunks are added up.
    wide = [
        F.sum(F.shiftrightunsigned(f"s{w}_{j}", 16 * odd).bitwiseAND(F.lit(_HALVES))).alias(f"v{w}_{j}_{odd}")
        for w in (0, 1) for j in range(16) for odd in (0, 1)
    ]
    summed = narrow.groupBy(*keys).agg(F.sum("n").alias("n"), *wide)

    def half(w: int) -> Column:
        # Bit j + 16 * odd + 32 * high is counted in lane `high` of sum (j, odd).
        bits = []
        for j in range(16):
            for odd in (0, 1):
                for high in (0, 1):
                    count = F.shiftrightunsigned(f"v{w}_{j}_{odd}", 32 * high).bitwiseAND(F.lit(0xFFFFFFFF))
                    bit = j + 16 * odd + 32 * high
                    one = -(1 << 63) if bit == 63 else 1 << bit
                    bits.append(F.when(count * 2 > F.col("n"), F.lit(one)).otherwise(F.lit(0).cast("long")))
        while len(bits) > 1:
            bits = [reduce(lambda a, b: a.bitwiseOR(b), bits[i : i + 2]) for i in range(0, len(bits), 2)]
        return bits[0]

    return summed.select(*keys, half(0).alias("f0"), half(1).alias("f1"))


def as_text(f0: Column, f1: Column) -> Column:
    """Both halves in 32 lower-case hexadecimal digits."""
    return F.lower(F.concat(F.lpad(F.hex(f0), 16, "0"), F.lpad(F.hex(f1), 16, "0")))


def likeness(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Share of equal bits."""
    return 1 - (F.bit_count(a0.bitwiseXOR(b0)) + F.bit_count(a1.bitwiseXOR(b1))) / F.lit(float(BITS))


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, f0, f1: the fingerprint of each text. Rows with the same keys vote
    together; a null text counts as an empty one."""
    return _votes(terms(texts.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("_t")), keys, "_t"), keys)


def near_pairs(prints: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """a0, a1, b0, b1, distance: every pair of different fingerprints at most
    radius bits apart, once. prints: f0, f1, repeated or not."""
    if not 0 <= radius < blocks:
        raise ValueError("there must be more blocks than differing bits")
    known = prints.select("f0", "f1").distinct()
    edges = [BITS * i // blocks for i in range(blocks + 1)]

    def block(i: int, f0: str = "f0", f1: str = "f1") -> Column:
        parts = []
        for word, base in ((f0, 0), (f1, 64)):
            low, high = max(edges[i] - base, 0), min(edges[i + 1] - base, 64)
            if low < high:
                mask = (1 << (high - low)) - 1
                moved = F.shiftrightunsigned(word, low)
                parts.append(moved if high - low == 64 else moved.bitwiseAND(F.lit(mask)))
        return F.xxhash64(*parts)

    # Exactly those blocks may be equal that the differing bits leave alone.
    tables = list(combinations(range(blocks), blocks - radius))
    keyed = known.select(
        "f0", "f1", F.posexplode(F.array(*[F.xxhash64(*[block(i) for i in chosen]) for chosen in tables])).alias("table", "key")
    )
    a = keyed.select("table", "key", F.col("f0").alias("a0"), F.col("f1").alias("a1"))
    b = keyed.select("table", "key", F.col("f0").alias("b0"), F.col("f1").alias("b1"))
    apart = F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))) + F.bit_count(F.col("a1").bitwiseXOR(F.col("b1")))
    ordered = F.struct("a0", "a1") < F.struct("b0", "b1")
    met = a.join(b, ["table", "key"]).filter(ordered).withColumn("distance", apart).filter(F.col("distance") <= radius)
    # A pair may meet in several tables; the first one reports it.
    same = [block(i, "a0", "a1") == block(i, "b0", "b1") for i in range(blocks)]
    first = F.coalesce(*[F.when(reduce(lambda x, y: x & y, [same[i] for i in chosen]), F.lit(t)) for t, chosen in enumerate(tables)])
    return met.filter(F.col("table") == first).select("a0", "a1", "b0", "b1", "distance")


def expected_distance(jaccard: float) -> int:
    """Bits in which the fingerprints of two equally long texts differ, about: the
    angle between their term vectors, whose cosine is 2 j / (1 + j)."""
    return round(BITS * acos(2 * jaccard / (1 + jaccard)) / pi)


def with_links(prints: DataFrame, radius: int = 3, blocks: int = 5, equal: int | None = None) -> DataFrame:
    """prints (with f0 and f1, read twice: a written table) plus links: how many
    other fingerprints within radius have `equal` of the blocks in common. Equal
    fingerprints are one. All that differ in at most blocks - equal bits have; by
    default these are all within radius. With a wider radius the tables stay as
    they are and find most of the farther ones too, but not all.

    Fingerprints with the same blocks lie in one array and are counted there, so a
    group of near copies makes no rows of pairs. A key of more than ARRAY ones is
    dealt into parts, and each pair of parts is a row of its own, so no key has to
    fit a task. Comparisons still grow with the square of a key's size."""
    equal = blocks - radius if equal is None else equal
    if not 0 < equal <= blocks:
        raise ValueError("there must be more blocks than differing bits")
    tables = list(combinations(range(blocks), equal))
    if len(tables) > 256:
        raise ValueError("more tables than a key can number")
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    masks = [(1 << hi) - (1 << lo) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
    halves = [(signed(m & ((1 << 64) - 1)), signed(m >> 64)) for m in masks]

    # A key has the table's number in its first 8 bits.
    block = lambda i: [F.col(f).bitwiseAND(F.lit(m)) for f, m in zip(("f0", "f1"), halves[i], strict=True) if m]
    numbered = [
        F.shiftleft(F.lit(t).cast("long"), 56).bitwiseOR(F.xxhash64(*[c for i in chosen for c in block(i)]).bitwiseAND(F.lit((1 << 56) - 1)))
        for t, chosen in enumerate(tables)
    ]
    keyed = prints.select("f0", "f1").distinct().select("f0", "f1", F.explode(F.array(*numbered)).alias("key"))
    # Most fingerprints meet no other one in most tables.
    shared = keyed.withColumn("n", F.count("*").over(Window.partitionBy("key"))).filter("n > 1")
    one = F.struct("f0", "f1")
    few = shared.filter(F.col("n") <= ARRAY).groupBy("key").agg(F.collect_list(one).alias("met")).select("key", F.col("met").alias("x"), F.col("met").alias("y"), F.lit(True).alias("same"))
    many = shared.filter(F.col("n") > ARRAY).withColumn("parts", F.ceil(F.col("n") / ARRAY).cast("long"))
    many = many.withColumn("part", F.pmod(F.xxhash64("f1", "f0"), F.col("parts")))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    many = many.select("key", "f0", "f1", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), (F.col("part") <= F.col("other")).alias("left"))
    # Said expressly: rows lie by key already, which would keep a hot one together.
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    side = lambda left: F.collect_list(F.when(F.col("left") == left, one))
    many = many.repartition(parts, "key", "low", "high").groupBy("key", "low", "high").agg(side(True).alias("x"), side(False).alias("y"))
    within = F.col("low") == F.col("high")
    many = many.select("key", "x", F.when(within, F.col("x")).otherwise(F.col("y")).alias("y"), within.alias("same"))
    # A pair may meet in several tables; it counts in the first: of the blocks up
    # to the table's last one, exactly the table's are equal.
    number = F.shiftrightunsigned("key", 56).cast("int")
    half = lambda chosen, w: sum(masks[i] >> 64 * w & ((1 << 64) - 1) for i in chosen)
    pair = lambda chosen: [signed(half(chosen, 0)), signed(half(chosen, 1))]
    own = [pair(chosen) for chosen in tables]
    # All bits stand in for no block at all: in them no two fingerprints are equal.
    before = [[pair([i]) for i in range(chosen[-1]) if i not in chosen] or [[-1, -1]] for chosen in tables]

    def against(name: str, other: str) -> Column:
        """Each fingerprint of an array with how many of the other one are near."""

        def near(x: Column, y: Column) -> Column:
            d0, d1 = x["f0"].bitwiseXOR(y["f0"]), x["f1"].bitwiseXOR(y["f1"])
            equal = lambda m: d0.bitwiseAND(F.get(m, F.lit(0))).bitwiseOR(d1.bitwiseAND(F.get(m, F.lit(1)))) == 0
            apart = F.bit_count(d0) + F.bit_count(d1)
            # Near copies share most blocks: the first one of `before` often decides.
            return (apart <= radius) & F.forall("before", lambda m: ~equal(m)) & (apart > 0) & equal(F.col("own"))

        each = F.transform(name, lambda x: F.struct(x["f0"].alias("f0"), x["f1"].alias("f1"), F.size(F.filter(other, lambda y: near(x, y))).alias("n")))
        return F.filter(each, lambda x: x["n"] > 0)

    met = few.unionByName(many).withColumn("own", F.get(F.lit(own).cast("array<array<long>>"), number))
    met = met.withColumn("before", F.get(F.lit(before).cast("array<array<array<long>>>"), number))
    both = F.when(F.col("same"), against("x", "y")).otherwise(F.concat(against("x", "y"), against("y", "x")))
    ends = met.select(F.explode(both).alias("e")).select("e.f0", "e.f1", "e.n")
    counts = written(ends.groupBy("f0", "f1").agg(F.sum("n").alias("links")), "near-fingerprints")
    # Copies of a text share a key; a small table of counts meets them in place.
    counts = F.broadcast(counts) if counts.count() <= BROADCAST_ROWS else counts
    return prints.join(counts, ["f0", "f1"], "left").fillna(0, ["links"])


def _thresholds(radius: int) -> list[int]:
    """Differing bits that a block may have, -1 for none to look at: of two
    fingerprints within the radius at least one block keeps to its number, as
    otherwise they were radius + 1 bits apart. Two bits are the most."""
    count = max(4, -(-(radius + 1) // 3))
    return [(radius + 1) // count + (i < (radius + 1) % count) - 1 for i in range(count)]


def with_all_links(prints: DataFrame, radius: int) -> DataFrame:
    """prints (with f0 and f1, read twice: a written table) plus links: how many
    other fingerprints are within radius, all of them. Equal fingerprints are one.

    Each block's value is written with at most one bit turned, so two values at
    most two bits apart meet in a common key. The blocks are joined one after the
    other, which bounds the shuffle to one block's rows. Keys with far more rows than
    chance gives them (groups of near copies) are dealt into a grid of parts and
    counted in arrays, so they make no rows of pairs and need not fit a task; the
    fingerprints of a value move there as lists, a row for each of the value's keys
    and not for each of the fingerprints'. Comparisons grow with the square of the
    fingerprints: within 22 bits about 3 per cent of the ordered pairs are compared."""
    if radius < 0 or radius >= BITS // 2:
        raise ValueError("the radius must be below half of the bits")
    spark = prints.sparkSession
    allowed = _thresholds(radius)
    edges = [BITS * i // len(allowed) for i in range(len(allowed) + 1)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    masks = [(1 << hi) - (1 << lo) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
    halves = [(signed(m & ((1 << 64) - 1)), signed(m >> 64)) for m in masks]
    known = written(prints.select("f0", "f1").distinct(), "distinct-fingerprints")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def valued(b: int) -> DataFrame:
        """f0, f1, value: a block's bits."""
        value = F.lit(0).cast("long")
        for word, base in (("f0", 0), ("f1", 64)):
            low, high = max(edges[b] - base, 0), min(edges[b + 1] - base, 64)
            if low < high:
                piece = F.shiftrightunsigned(word, low).bitwiseAND(F.lit((1 << (high - low)) - 1))
                value = value.bitwiseOR(F.shiftleft(piece, base + low - edges[b]))
        return known.select("f0", "f1", value.alias("value"))

    def turned(rows: DataFrame, b: int, name: str) -> DataFrame:
        """rows (with value) and what their value becomes: turn 0 leaves it alone,
        turn i turns its bit i - 1."""
        width = edges[b + 1] - edges[b] if allowed[b] else 0
        rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(width))).alias("turn"))
        turn = F.when(F.col("turn") == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("turn") - 1))
        return rows.withColumn(name, F.col("value").bitwiseXOR(turn)).withColumn("turn", F.col("turn").cast("short"))

    def keyed(b: int) -> DataFrame:
        """key, turn, f0, f1: a block's value, and with each bit turned."""
        return turned(valued(b), b, "key").select("key", "turn", "f0", "f1")

    def linked(b: int, t: Column, f0: Column, f1: Column, u: Column, g0: Column, g1: Column) -> Column:
        """Whether a pair that meets in a key of the block counts there. Of its keys
        one counts, of the blocks the first."""
        d0, d1 = f0.bitwiseXOR(g0), f1.bitwiseXOR(g1)
        apart = F.bit_count(d0) + F.bit_count(d1)
        within = lambda i: F.bit_count(d0.bitwiseAND(F.lit(halves[i][0]))) + F.bit_count(d1.bitwiseAND(F.lit(halves[i][1]))) <= allowed[i]
        once = (t < u) | ((t == 0) & (u == 0))
        return reduce(lambda x, y: x & y, [~within(i) for i in range(b)], once & (apart <= radius) & (apart > 0))

    used = [b for b, bits in enumerate(allowed) if bits >= 0]
    sizes = reduce(DataFrame.unionByName, [keyed(b).select(F.lit(b).alias("block"), "key") for b in used]).groupBy("block", "key").agg(F.count("*").alias("n"))
    width = BITS // len(allowed)
    common = max(COMMON, 4 * known.count() * (width + 1) >> width)
    hot_keys = written(sizes.filter(F.col("n") > common), "hot-keys")
    hot_count, most = hot_keys.agg(F.count("*"), F.max("n")).first()
    # Powers of two, so that the parts of every key are made of whole lists.
    dealt = lambda n: F.pow(F.lit(2), F.greatest(F.ceil(F.log2(n / CELL)), F.lit(0))).cast("int")
    c, found = F.col, []
    for b in used:
        hot = hot_keys.filter(c("block") == b).select("key", "n")
        rows = keyed(b).join(F.broadcast(hot) if hot_count <= BROADCAST_ROWS else hot, "key", "left")
        # With at most one bit apart, one of the two values is not turned.
        mine = rows if allowed[b] == 2 else rows.filter("turn = 0")
        left = mine.filter("n is null").select("key", "turn", "f0", "f1").repartition(parts, "key")
        right = rows.filter("n is null").select("key", c("turn").alias("u"), c("f0").alias("g0"), c("f1").alias("g1")).repartition(parts, "key")
        met = left.join(right.hint("merge"), "key").filter(linked(b, *[c(x) for x in ("turn", "f0", "f1", "u", "g0", "g1")]))
        counts = met.groupBy("f0", "f1").agg(F.count("*").alias("n"))
        if hot_count:
            small = F.broadcast if hot_count <= BROADCAST_ROWS else lambda x: x
            around = turned(hot.select("key", dealt(c("n")).alias("parts"), c("key").alias("value")), b, "near")
            around = around.select("key", "parts", "turn", c("near").alias("value"))
            own = valued(b).join(small(around.select("value").distinct()), "value", "left_semi")
            # Lists as long as a cell at most, about: the longest key has so many parts.
            lists = own.groupBy("value", F.pmod(F.xxhash64("f1", "f0"), dealt(F.lit(most))).cast("int").alias("place")).agg(F.collect_list(F.struct("f0", "f1")).alias("list"))
            lists = lists.join(small(around), "value").withColumn("part", c("place") % c("parts"))

            def cells(side: DataFrame, own: str, other: str, name: str) -> DataFrame:
                each = F.transform("list", lambda x: F.struct(c("turn"), x["f0"].alias("f0"), x["f1"].alias("f1")))
                made = side.groupBy("key", "parts", c("part").alias(own)).agg(F.flatten(F.collect_list(each)).alias(name))
                return made.select("key", own, F.explode(F.sequence(F.lit(0), c("parts") - 1)).alias(other), name).repartition(parts, "key", "i", "j")

            left = lists if allowed[b] == 2 else lists.filter("turn = 0")
            pairs = cells(left, "i", "j", "x").join(cells(lists, "j", "i", "y"), ["key", "i", "j"])
            near = lambda x: F.size(F.filter("y", lambda y: linked(b, x["turn"], x["f0"], x["f1"], y["turn"], y["f0"], y["f1"])))  # noqa: E731, B023
            ends = pairs.select(F.explode(F.transform("x", lambda x: F.struct(x["f0"].alias("f0"), x["f1"].alias("f1"), near(x).alias("n")))).alias("e"))
            counts = counts.unionByName(ends.select("e.f0", "e.f1", c("e.n").cast("long").alias("n")).filter("n > 0"))
        found.append(written(counts, "block-links"))
        release(spark)
    counts = written(reduce(DataFrame.unionByName, found).groupBy("f0", "f1").agg(F.sum("n").alias("links")), "near-fingerprints")
    counts = F.broadcast(counts) if counts.count() <= BROADCAST_ROWS else counts
    return prints.join(counts, ["f0", "f1"], "left").fillna(0, ["links"])


def _ranges(docs: DataFrame, key: str):
    """The number of a document's range: consecutive keys, about equally many in
    each, found by bisection in the limits. A null key lies in the first."""
    rows = docs.count()
    count = max(1, min(RANGES, rows // RANGE_ROWS))
    shares = [i / count for i in range(1, count)]
    limits = sorted(set(docs.select(F.col(key).cast("double").alias("k")).approxQuantile("k", shares, 0.25 / count))) if shares else []
    if not limits:
        return F.lit(0)
    sizes = [1 << i for i in reversed(range(len(limits).bit_length()))]
    found = F.aggregate(
        F.array(*[F.lit(s) for s in sizes]),
        F.lit(0),
        lambda at, step: F.when((at + step <= len(limits)) & (F.get(F.lit(limits), at + step - 1) <= F.col(key).cast("double")), at + step).otherwise(at),
    )
    return F.coalesce(found, F.lit(0))


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text: the last half of its
    code points (rounded down) replaced by as many first ones, or all, of the next
    document in ascending order; the first document comes after the last.

    key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, and f0, f1. A null text is an empty one. A null key comes first;
    rows with the same key follow in the order of their texts' hashes, repeated
    rows in any order, and a single document is its own next one. Texts move in
    one shuffle, by ranges of the key; the first document of each range also goes
    to the range before. An empty table has an empty result."""
    base = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ids = base.select("key")
    base = base.withColumn("range", _ranges(ids, "key"))
    # One row per range: what follows the last document of the range before.
    cyclic = Window.partitionBy(F.lit(0)).orderBy("range")
    firsts = base.groupBy("range").agg(F.min(F.struct(F.col("key").isNotNull().alias("some"), "key")).alias("first"))
    before = F.coalesce(F.lag("range").over(cyclic), F.max("range").over(Window.partitionBy(F.lit(0))))
    firsts = firsts.select(F.col("range").alias("r"), F.col("first.key").alias("k"), before.alias("before"))
    # At most RANGES rows.
    rows = base.join(F.broadcast(firsts), (F.col("range") == F.col("r")) & F.col("key").eqNullSafe(F.col("k")), "left")
    guest = F.when(F.col("r").isNotNull(), F.array(F.struct(F.col("range").alias("at"), F.lit(False).alias("guest")), F.struct(F.col("before").alias("at"), F.lit(True).alias("guest"))))
    rows = rows.select("key", "text", F.explode(F.coalesce(guest, F.array(F.struct(F.col("range").alias("at"), F.lit(False).alias("guest"))))).alias("place"))
    rows = rows.select("key", "text", "place.at", "place.guest")
    order = Window.partitionBy("at").orderBy("guest", F.col("key").asc_nulls_first(), F.xxhash64("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    rows = (
        rows.withColumn("place", F.row_number().over(order)).withColumn("next", F.lead("text").over(order))
        .withColumn("n_chars", F.length("text"))
        .withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars") - half), F.substring(F.coalesce("next", F.lit("")), F.lit(1), half)))
        .withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    )
    both = F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("t")))
    keys = ["at", "place", "guest", "key", "n_chars", "edited_sha256"]
    texts = rows.select(*keys, F.explode(F.when(F.col("guest"), F.slice(both, 1, 1)).otherwise(both)).alias("x")).select(*keys, "x.which", "x.t")
    prints = fingerprints(texts, [*keys, "which"], "t")
    one = lambda c, which: F.max(F.when(F.col("which") == which, F.col(c)))
    prints = prints.groupBy(*keys).agg(one("f0", 0).alias("f0"), one("f1", 0).alias("f1"), one("f0", 1).alias("e0"), one("f1", 1).alias("e1"))
    along = Window.partitionBy("at").orderBy("place")
    prints = prints.withColumn("n0", F.lead("f0").over(along)).withColumn("n1", F.lead("f1").over(along)).filter(~F.col("guest"))
    col = F.col
    return prints.select(
        col("key").alias(key),
        col("n_chars").cast("long").alias("n_chars"),
        "edited_sha256",
        as_text(col("f0"), col("f1")).alias("fingerprint"),
        as_text(col("e0"), col("e1")).alias("edited_fingerprint"),
        likeness(col("f0"), col("f1"), col("e0"), col("e1")).alias("near_edited"),
        likeness(col("f0"), col("f1"), col("n0"), col("n1")).alias("near_next"),
        "f0",
        "f1",
    )
