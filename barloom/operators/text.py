"""Names of funds and indices: cleaning, tokens, similarity, keyword choice."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.scalar import c, div

# Fund issuers whose names are stripped from a fund's name.
FUND_ISSUERS = (
    "华夏", "易方达", "华泰柏瑞", "景顺", "景顺长城", "大成", "工银", "工银瑞信", "广发", "华宝",
    "南方", "富国", "天弘", "鹏华", "招商", "国泰", "银华", "万家", "博时", "嘉实",
    "汇添富", "华安", "平安", "建信", "国联安", "前海开源", "东财", "永赢", "摩根", "海富通",
    "兴业", "申万菱信", "中银", "中银证券", "交银", "国联", "融通", "泰康", "浦银", "民生加银",
    "方正富邦", "西部利得", "国寿", "鹏扬", "国投瑞银", "南华", "创金合信", "鑫元", "兴全",
    "弘毅远方", "银河", "汇安", "国寿安保",
)

# Family of a symbol by the words in its name, first match wins.
FAMILY_WORDS = (
    ("bond", ("国债", "债ETF", "地方债", "国开债", "短融", "公司债", "可转债")),
    ("commodity", ("黄金", "石油", "油气", "豆粕", "粮食", "养殖", "矿业", "钢铁", "化工", "有色")),
    ("healthcare", ("医药", "医疗", "生物")),
    ("technology", ("半导体", "通信", "电信", "消费电子", "信息技术", "创新", "金融科技", "软件", "卫星")),
    ("finance", ("银行", "证券", "非银", "金融", "保险")),
    ("consumption", ("消费", "酒", "旅游", "汽车", "家电", "教育")),
    ("industry", ("基建", "建材", "电力", "电网", "工程机械", "交通运输", "长江保护", "房地产")),
    (
        "overseas",
        (
            "纳指", "标普", "道琼斯", "德国", "法国", "日本", "东证", "日经", "亚太", "东南亚", "沙特",
            "中概", "恒生", "港股通", "香港", "中韩",
        ),
    ),
)

# First digit of Shanghai codes, and of codes that are not A shares.
SHANGHAI_DIGIT = "6"
NOT_A_SHARE_DIGITS = ("2", "4", "8", "9")


def _plain_brackets(x: Column) -> Column:
    return F.translate(x, "（）", "()")


def normalize_name(name: str | Column) -> Column:
    """ASCII brackets, then brackets, dashes, slashes, dots and spaces removed."""
    return F.regexp_replace(_plain_brackets(F.trim(c(name))), r"[()\-_/·\s]+", "")


def tracked_index_name(
    name: str | Column, issuers: Sequence[str] = FUND_ISSUERS, marker: str = "ETF"
) -> Column:
    """The part before the marker with an issuer cut off each end; a name
    without the marker is returned as it is."""
    full = _plain_brackets(F.trim(c(name)))
    left = F.trim(F.substring_index(full, marker, 1))
    longest = "|".join(re.escape(x) for x in sorted({i.strip() for i in issuers if i.strip()}, key=len, reverse=True))
    core = left
    if longest:
        core = F.trim(F.regexp_replace(core, f"^(?:{longest})", ""))
        # Of the issuers a name ends with, the longest one starts earliest.
        core = F.trim(F.regexp_replace(core, f"(?:{longest})$", ""))
    cut = F.when(core != "", core).otherwise(left)
    return F.when(F.contains(full, F.lit(marker)), cut).otherwise(full)


def _once(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x) with x computed once per row, however often it is used; Spark finds
    no common expressions inside lambdas."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def _normal_text(keyword: str) -> str:
    """normalize_name of a given text."""
    return re.sub(r"[()\-_/·\s]+", "", keyword.strip(" ").replace("（", "(").replace("）", ")"), flags=re.ASCII)


def _strings(items: Sequence[Column]) -> Column:
    return F.array(*items).cast("array<string>")


def _tokens(norm: Column, keywords: Sequence[str]) -> Column:
    known = F.array_compact(_strings([F.when(F.contains(norm, F.lit(k)), F.lit(k)) for k in keywords]))
    runs = F.regexp_extract_all(F.upper(norm), F.lit(r"([A-Za-z]+\d*|\d+[A-Za-z]*)"), F.lit(1))
    digits = F.regexp_extract_all(norm, F.lit(r"(\d+)"), F.lit(1))
    tokens = F.array_union(F.array_union(known, runs), digits)
    whole = F.when(norm == "", _strings([])).otherwise(F.array(norm))
    return _once(tokens, lambda t: F.when(F.size(t) > 0, t).otherwise(whole))


def name_tokens(name: str | Column, keywords: Sequence[str] = ()) -> Column:
    """Known keywords, alphanumeric runs in upper case and digit runs; the whole
    name when there are none."""
    return _once(normalize_name(name), lambda norm: _tokens(norm, keywords))


#: Pairs that a task remembers at a time.
KNOWN_PAIRS = 100_000


@F.pandas_udf(DoubleType())
def _sequence_ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Share of characters in matching blocks, over distinct pairs of a task."""
    seen: dict[tuple, float] = {}

    def ratio(x, y):
        if x is None or y is None:
            return None
        if (x, y) not in seen:
            if len(seen) >= KNOWN_PAIRS:
                seen.clear()
            seen[x, y] = SequenceMatcher(None, x, y).ratio()
        return seen[x, y]

    for a, b in batches:
        yield pd.Series([ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def name_similarity(a: str | Column, b: str | Column, keywords: Sequence[str] = ()) -> Column:
    """Highest of token overlap, 0.9 x containment and 0.6 x sequence ratio."""
    na, nb = normalize_name(a), normalize_name(b)
    ta, tb = name_tokens(a, keywords), name_tokens(b, keywords)
    overlap = F.coalesce(div(F.size(F.array_intersect(ta, tb)), F.size(F.array_union(ta, tb))), F.lit(0.0))
    la, lb = F.length(na), F.length(nb)
    inside = F.contains(nb, na) | F.contains(na, nb)
    containment = F.when(inside, div(F.least(la, lb), F.greatest(la, lb))).otherwise(0.0)
    best = F.greatest(overlap, containment * 0.9, _sequence_ratio(na, nb) * 0.6)
    return F.when((na == "") | (nb == ""), 0.0).when(na == nb, 1.0).otherwise(best)


def name_distance(a: str | Column, b: str | Column, keywords: Sequence[str] = ()) -> Column:
    return 1.0 - name_similarity(a, b, keywords)


def match_keywords(name: str | Column, keywords: Sequence[str]) -> Column:
    """Keywords found in the normalised name or among its tokens, in list order."""
    items = [(k, _normal_text(k)) for k in dict.fromkeys(keywords)]

    def found(norm: Column) -> Column:
        # A token's text without brackets, dashes and spaces: keywords may have them.
        tokens = F.transform(_tokens(norm, keywords), lambda t: normalize_name(t))
        hits = lambda t: [F.when(F.contains(norm, F.lit(n)) | F.array_contains(t, F.lit(n)), F.lit(k)) for k, n in items if n]
        none = _strings([])
        return F.when(norm == "", none).otherwise(_once(tokens, lambda t: F.array_compact(_strings(hits(t)))))

    return _once(normalize_name(name), found)


def family(name: str | Column, words=FAMILY_WORDS, default: str = "diversified") -> Column:
    """Label of the first family with a word in the name."""
    out = F.lit(default)
    for label, terms in reversed(words):
        out = F.when(c(name).rlike("|".join(re.escape(t) for t in terms)), label).otherwise(out)
    return out


def market_of(code: str | Column) -> Column:
    return F.when(F.startswith(pad_code(code), F.lit(SHANGHAI_DIGIT)), "SH").otherwise("SZ")


def is_a_share(code: str | Column) -> Column:
    return ~F.substring(pad_code(code), 1, 1).isin(list(NOT_A_SHARE_DIGITS))


def pad_code(code: str | Column, width: int = 6) -> Column:
    """Trimmed code with leading zeros; longer codes stay whole."""
    x = F.regexp_replace(F.trim(c(code).cast("string")), "^﻿", "")
    return F.when(F.length(x) < width, F.lpad(x, width, "0")).otherwise(x)


def dedupe_names(df: DataFrame, marker: str = "ETF") -> DataFrame:
    """One row per symbol: names with the marker first, then the longer name."""
    rank = F.struct(F.contains("name", F.lit(marker)).cast("int").alias("m"), F.length("name").alias("l"), F.col("name").alias("n"))
    return df.groupBy("symbol").agg(F.max_by(F.struct(*df.columns), rank).alias("x")).select("x.*")


def merge_listings(current: DataFrame, delisted: DataFrame) -> DataFrame:
    """Current and delisted names in one table (symbol, name, list_date,
    delist_date); the delisted entry wins, missing values are filled."""
    a = current.select("symbol", *[F.col(x).alias(f"c_{x}") for x in ("name", "list_date", "delist_date")])
    b = delisted.select("symbol", *[F.col(x).alias(f"d_{x}") for x in ("name", "list_date", "delist_date")])
    out = a.join(b, "symbol", "full_outer")
    return out.select(
        "symbol", *[F.coalesce(f"d_{x}", f"c_{x}").alias(x) for x in ("name", "list_date", "delist_date")]
    )


def symbol_profile(bars: DataFrame, names: DataFrame | None = None, keywords: Sequence[str] = ()) -> DataFrame:
    """Bars, mean traded value, first and last date, matched keywords."""
    out = bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("bar_count"),
        F.avg("value").alias("avg_value"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )
    if names is None:
        return out
    out = out.join(names, "symbol", "left")
    return out.withColumn("matched_keywords", match_keywords("name", keywords)) if keywords else out


def keyword_representatives(profile: DataFrame, min_bars: int = 600) -> DataFrame:
    """Per keyword the symbol with the largest traded value among those with
    more than min_bars bars, and how many candidates there were."""
    rows = profile.filter((F.col("bar_count") > min_bars) & F.col("avg_value").isNotNull())
    rows = rows.withColumn("keyword", F.explode("matched_keywords"))
    # min_by on (-value, -bars, symbol) is a partial aggregate: hot keywords shrink early.
    order = F.struct(-F.col("avg_value"), -F.col("bar_count"), F.col("symbol"))
    best = F.min_by(F.struct("symbol", "bar_count", "avg_value"), order)
    return (
        rows.groupBy("keyword")
        .agg(F.count(F.lit(1)).alias("candidate_count"), best.alias("x"))
        .select("keyword", "candidate_count", F.col("x.symbol").alias("selected_symbol"), "x.bar_count", "x.avg_value")
    )


def representative_symbols(chosen: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Chosen symbols with the keywords they stand for."""
    rows = chosen.filter(F.col("selected_symbol").isNotNull())
    if exclude:
        rows = rows.filter(~F.col("selected_symbol").isin(list(exclude)))
    return rows.groupBy(F.col("selected_symbol").alias("symbol")).agg(
        F.max("avg_value").alias("avg_value"),
        F.max("bar_count").alias("bar_count"),
        F.sort_array(F.collect_list("keyword")).alias("source_keywords"),
        F.count(F.lit(1)).alias("source_keyword_count"),
    )


def best_per_index(bars: DataFrame, index_map: DataFrame, recent_bars: int = 20) -> DataFrame:
    """One symbol per tracked index: earliest first date, then the larger mean
    value of the last bars, with all candidates listed."""
    back = W.partitionBy("symbol").orderBy(F.col("date").desc())
    recent = bars.withColumn("__r", F.row_number().over(back)).filter(F.col("__r") <= recent_bars)
    value = recent.groupBy("symbol").agg(F.avg("value").alias("recent_value"))
    first = bars.groupBy("symbol").agg(F.min("date").alias("first_date"))
    rows = index_map.join(first, "symbol").join(value, "symbol")
    order = F.struct("first_date", -F.col("recent_value"), "symbol")
    return rows.groupBy("index_name").agg(
        F.min_by("symbol", order).alias("symbol"),
        F.min("first_date").alias("first_date"),
        F.array_join(F.sort_array(F.collect_list("symbol")), ",").alias("candidates"),
        F.count(F.lit(1)).alias("candidate_count"),
    )


def tracked_indices(index_map: DataFrame) -> DataFrame:
    """One row per symbol with its index names, sorted and comma-joined."""
    return index_map.groupBy("symbol").agg(
        F.concat_ws(",", F.sort_array(F.collect_list("index_name"))).alias("tracked_indices")
    )
