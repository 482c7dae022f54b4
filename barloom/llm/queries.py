"""The registered queries of the training-data operators: each applies its
operator with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, jaccard, langid, mixing, packing, quality, runs, sharding, simhash, topk, urlfilter, warc
from .shared import chosen, held_out, release, written

#: Vocabulary of op9.
RANKS = "byte_bpe_multi_50k.tiktoken"
#: Ranks of op12: the vocabulary of byte_bpe_50k.json.
PACKING_RANKS = "byte_bpe_50k.tiktoken"
#: Shards of op4; weights and epochs of op8; queries and results of op10.
SHARDS, WEIGHTS, EPOCHS, MIX_SEED = 40, (5, 2, 1), 3, 11
QUERY_EVERY, TOP, SCALE = 20, 20, 64
#: Jaccard similarity that op3's neighbours should have, their Hamming radius (22
#: of 128 bits); op3 counts all of them. The blocks and those in common are for
#: simhash.with_links, which is quicker: all neighbours within 12 bits meet, of the
#: others most.
SIMILARITY = 0.75
RADIUS = simhash.expected_distance(SIMILARITY)
BLOCKS, EQUAL_BLOCKS = 14, 2
# The rules of op6.
RULES = (
    urlfilter.Rule("org/", "allow"),
    urlfilter.Rule("example.org/es/", "block"),
    urlfilter.Rule("example.org/en/1", "block"),
    urlfilter.Rule("com/fr/", "allow"),
    urlfilter.Rule("com/de/", "block"),
)
#: A word: anything between blanks.
_WORD = r"[^\x20\x09-\x0D]+"


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return chosen(spark.read.parquet(f"{sf_dir}/{name}.parquet"), *columns)


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.Model:
    """Learns from labelled documents that are not held out."""
    return quality.fit(chosen(docs, "doc_id", "text"), chosen(labels, "doc_id", "quality").filter(~held_out()))


def op1_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    model = quality_model(docs, _table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def language_model(docs: DataFrame) -> langid.Model:
    """Learns from documents of known language that are not held out."""
    return langid.fit(chosen(docs, "doc_id", "text", "lang").filter(~held_out()))


def op2_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = langid.identify(docs.select("doc_id", "text"), language_model(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "n_spans")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = written(simhash.edited_fingerprints(_table(spark, sf_dir, "documents", "doc_id", "text")), "fingerprints")
    release(spark)
    return simhash.with_all_links(prints, RADIUS).drop("f0", "f1")


def op4_uniform_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law `rows`: the shuffle is uniform over rows; equal texts are rows like
    any others and may lie in several shards."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = _table(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    out = sharding.shuffle_into_shards(docs, SHARDS, seed=7)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(_table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The small labelled table is made; rules and pages have no part in it."""
    pages = _table(spark, sf_dir, "pages", "page_id", "url")
    model = urlfilter.train(urlfilter.labelled_table())
    return urlfilter.judge(pages, RULES, model)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.near_duplicates(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id")


def sized(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, source, size in words."""
    words = F.size(F.split(F.btrim(F.coalesce(F.col("text"), F.lit("")), F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+"))
    empty = ~F.coalesce(F.col("text"), F.lit("")).rlike(_WORD)
    return docs.select("doc_id", "source", F.when(empty, 0).otherwise(words).cast("long").alias("size"), *more)


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sized(_table(spark, sf_dir, "documents", "doc_id", "source", "text"))
    made = mixing.mix(docs, WEIGHTS, EPOCHS, MIX_SEED)
    return mixing.taken_words(made).select("doc_id", "size", "source_size", "target", "taken")


def bpe_round_trip(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded bytes."""
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path(RANKS))
    return bpe.round_trip(chosen(docs, "doc_id", "text"), ranks, public_tokenizers.PATTERN).drop("text")


def op9_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(_table(spark, sf_dir, "embeddings", "vec_id", "embedding"), "vec_id", "embedding", SCALE)
    return topk.top_k(vectors, F.col("vec_id") % QUERY_EVERY == 0, TOP)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return audit.audit(docs, _table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


def op12_mixed_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source is due its share of all tokens."""
    import public_tokenizers

    tokens = packing.Tokens(bpe.read_ranks(public_tokenizers.path(PACKING_RANKS)), public_tokenizers.PATTERN)
    pieces = packing.pack(_table(spark, sf_dir, "documents", "doc_id", "source", "text"), tokens)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")


def tail_repeated(docs: DataFrame) -> DataFrame:
    """doc_id and text, of which every tenth (by the crc32 of its id) repeats a
    stretch of its words up to the end. A null id has no checksum and no repeats."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", (h % 10 == 0).alias("_edit"), F.floor(h / 10).cast("long").alias("_g"))
    rows = rows.withColumn("_w", F.when(F.col("_edit"), F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")))
    rows = rows.withColumn("_n", F.size("_w").cast("long"))
    rows = rows.withColumn("_a", F.when(F.col("_n") > 0, F.try_mod("_g", "_n")).cast("int"))
    rows = rows.withColumn("_p", (F.floor((F.col("_n") - F.col("_a")) / (F.col("_g") % 8 + 3)) + 1).cast("int"))
    often = F.ceil((F.col("_n") - F.col("_a")) / F.col("_p")).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice("_w", F.col("_a") + 1, F.col("_p")), often)), F.lit(1), (F.col("_n") - F.col("_a")).cast("int"))
    edited = F.array_join(F.concat(F.slice("_w", F.lit(1), F.col("_a")), again), " ")
    return rows.select("doc_id", F.when(F.col("_edit") & F.col("_a").isNotNull(), edited).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(tail_repeated(_table(spark, sf_dir, "documents", "doc_id", "text")))
    # The greatest length, then the smallest start and period.
    first = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))), 1)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    n_runs = F.size("runs").cast("long")
    rows = found.select("doc_id", n_runs.alias("n_runs"), F.when(n_runs > 0, first).alias("r"), F.when(n_runs > 0, F.concat(lines, F.lit("\n"))).otherwise("").alias("lines"), "collapsed")
    return rows.select(
        "doc_id", "n_runs", F.col("r.s").alias("start"), (-F.col("r.l")).alias("length"), F.col("r.p").alias("period"),
        F.expr("(-1000 * r.l) div r.p").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_additive_quality, op2_language_spans, op3_simhash, op4_uniform_shards, op5_warc,
            op6_url_filter, op7_jaccard_join, op8_source_mix, op9_byte_level_bpe, op10_pivot_top_k,
            op11_filter_audit, op12_mixed_packing, op13_periodic_runs,
        )
    }


_BASE32 = (
    "array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',"
    " 1 + ((CAST('0x' || substr(sha, 5 * (i // 4) + 1, 5) AS INTEGER) >> (15 - 5 * (i % 4))) & 31), 1)), '')"
)

OP5_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
w AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS won FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = won THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> won THEN won END AS refers_to
FROM w
"""

OP7_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
t AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS sh FROM s),
l AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.sh = b.sh AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM s UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id
FROM s JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) USING (doc_id)
"""

OP8_SQL = f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size
  FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS ss, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM d GROUP BY source),
w AS (SELECT *, [{", ".join(map(str, WEIGHTS))}][sid % {len(WEIGHTS)} + 1] AS w, CAST(sum(ss) OVER () AS BIGINT) AS total FROM src),
o AS (SELECT *, coalesce(sum({EPOCHS} * ss) OVER (ORDER BY CAST(ss AS DOUBLE) / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cut,
             sum(w) OVER (ORDER BY CAST(ss AS DOUBLE) / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w FROM w),
f AS (SELECT *, CAST(total - cut AS DOUBLE) / CAST(open_w AS DOUBLE) * w > {EPOCHS} * ss AS is_full FROM o),
c AS (SELECT *, coalesce(sum({EPOCHS} * ss) FILTER (is_full) OVER (), 0) AS cuts, sum(w) FILTER (NOT is_full) OVER () AS ws FROM f),
tg AS MATERIALIZED (
  SELECT sid, source, ss, CASE WHEN is_full THEN CAST({EPOCHS} * ss AS DOUBLE) ELSE CAST(total - cuts AS DOUBLE) / CAST(ws AS DOUBLE) * w END AS target FROM c),
placed AS MATERIALIZED (
  SELECT d.doc_id, d.size, tg.*, row_number() OVER () AS row,
         coalesce(sum(size) OVER (PARTITION BY sid ORDER BY md5(concat_ws(':', {MIX_SEED}, doc_id, size)), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN tg ON d.source IS NOT DISTINCT FROM tg.source),
epochs AS (SELECT *, unnest(range({EPOCHS})) * ss + start AS first FROM placed),
taken AS (SELECT row, sum(greatest(0, least(first + size, CAST(ceil(target) AS BIGINT)) - first)) AS taken FROM epochs GROUP BY row)
SELECT doc_id, size, ss AS source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM placed LEFT JOIN taken USING (row)
"""

OP10_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {QUERY_EVERY} = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= {TOP}
"""

OP11_SQL = """
WITH l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
          regexp_matches(t, '[#$%&*|]'), coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)] AS fails
  FROM d LEFT JOIN l USING (doc_id)),
m AS MATERIALIZED (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
x AS (SELECT unnest(range(1, 6)) AS i),
o AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM x a JOIN x b ON b.i <> a.i JOIN x c ON c.i NOT IN (a.i, b.i)
  JOIN x d ON d.i NOT IN (a.i, b.i, c.i) JOIN x e ON e.i NOT IN (a.i, b.i, c.i, d.i)),
r AS (
  SELECT part, array_to_string(list_transform(o, lambda i: substr('ABCDE', i, 1)), '') AS filter_order, x.i AS step, o[x.i] AS f, fails, n, good, toxic,
         coalesce(list_position(list_transform(o, lambda i: fails[i]), true), 6) AS gone
  FROM m, o, x),
t AS (
  SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (gone > step), 0) AS kept, coalesce(sum(n) FILTER (gone = step), 0) AS removed,
         coalesce(sum(n) FILTER (fails[f] AND gone < step), 0) AS redundant,
         coalesce(sum(n) FILTER (fails[f] AND len(list_filter(fails, lambda b: b)) = 1), 0) AS unique_fails,
         coalesce(sum(good) FILTER (gone = step), 0) AS good_lost, coalesce(sum(toxic) FILTER (gone = step), 0) AS toxic_lost
  FROM r GROUP BY part, filter_order, step, f)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM t
"""

_CRC32 = (
    "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),"
    " lambda x, y: list_reduce(list_prepend(xor(x, y), range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)))"
)

OP13_SQL = f"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w, {_CRC32} AS h FROM documents),
a AS (SELECT *, row_number() OVER () AS row, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
e AS MATERIALIZED (
  SELECT row, doc_id, CASE WHEN a IS NULL THEN w ELSE list_transform(range(0, n), lambda i:
         w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) END AS w FROM a),
x AS MATERIALIZED (SELECT row, unnest(range(0, len(w))) AS i, unnest(w) AS word FROM e),
m AS (SELECT a.row, b.i - a.i AS p, a.i FROM x a JOIN x b ON a.row = b.row AND a.word = b.word AND b.i > a.i),
s AS (SELECT row, p, min(i) AS s, count(*) AS c FROM (SELECT *, i - row_number() OVER (PARTITION BY row, p ORDER BY i) AS island FROM m) GROUP BY row, p, island),
r AS MATERIALIZED (SELECT row, s, c + p AS l, min(p) AS p FROM s WHERE c + p >= greatest(12, 2 * p) GROUP BY row, s, c + p),
t AS (
  SELECT row, count(*) AS n_runs, min(struct_pack(l := -l, s := s, p := p)) AS b,
         string_agg(concat(s, ',', l, ',', p, chr(10)), '' ORDER BY s, p) AS lines,
         list(struct_pack(a := s + p, b := s + l)) AS gone FROM r GROUP BY row),
k AS (
  SELECT row, string_agg(word, ' ' ORDER BY i) AS kept FROM x LEFT JOIN t USING (row)
  WHERE gone IS NULL OR len(list_filter(gone, lambda z: z.a <= i AND i < z.b)) = 0 GROUP BY row)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, -b.l AS length, b.p AS period, CAST((-1000 * b.l) // b.p AS BIGINT) AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM e LEFT JOIN t USING (row) LEFT JOIN k USING (row)
"""


def oracle_sql() -> dict[str, str]:
    """Where SQL can state the result; tests hold the others against brute force."""
    return {"op5_warc": OP5_SQL, "op7_jaccard_join": OP7_SQL, "op8_source_mix": OP8_SQL, "op10_pivot_top_k": OP10_SQL, "op11_filter_audit": OP11_SQL, "op13_periodic_runs": OP13_SQL}
