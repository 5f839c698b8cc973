"""URL filters: domain rules, then a blocked Bloom filter in front of an exact list.

Everything here is DataFrame expressions.  Each listed canonical URL sets one bit in each of the eight
64-bit words of its block; a block is one row of the filter.  The filter has at most ``MAX_BLOCKS``
rows of eight longs, which bounds what is broadcast however long the list is: a longer list lets more
false positives through, and the exact hash join that follows removes them all.  Only possible hits go
through that join; a page's URL is parsed once, and what is kept of it written.  Both sides of the join are plain shuffles, so adaptive execution splits a hot URL.

Defined cases: a null URL, or one without ``://``, has an empty host and path, fits no rule and is
never listed; repeated rows and list entries are allowed; an empty list blocks nothing; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

MAX_BLOCKS = 1 << 17
BITS_PER_URL = 16
WORDS = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
#: Query parameters that do not change what a URL shows.
TRACKING = r"^(utm_[^=]*|ref|gclid|fbclid)(=|$)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def canonical_of(url: Column) -> Column:
    """Host without www. or m., path without closing slashes, and the sorted parameters that matter."""
    params = F.array_sort(F.filter(F.split(F.coalesce(F.regexp_extract(url, _URL, 3), F.lit("")), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    query = F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise("")
    return F.concat(F.regexp_replace(host_of(url), r"^(www|m)\.", ""), F.regexp_replace(path_of(url), r"/+$", ""), query)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule (verdict, host, path) that fits, as struct<rule, verdict>, else null."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        best = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def _block(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _bit(key: str, word: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit("bits"), F.col(key)), 6 * word).bitwiseAND(63).cast("int")


def build_filter(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """One row for each block that has entries: block and its words w0 .. w7."""
    bits = listed.select(_block(key, blocks).alias("block"), *(_bit(key, i).alias(f"b{i}") for i in range(WORDS)))
    return bits.groupBy("block").agg(*(F.expr(f"bit_or(shiftleft(1L, b{i}))").alias(f"w{i}") for i in range(WORDS)))


def probe(rows: DataFrame, bloom: DataFrame, key: str, blocks: int) -> DataFrame:
    """Adds possible_hit; the filter has at most ``blocks`` <= MAX_BLOCKS rows, and so may be broadcast."""
    bits = rows.select("*", _block(key, blocks).alias("block"), *(_bit(key, i).alias(f"b{i}") for i in range(WORDS)))
    joined = bits.join(F.broadcast(bloom), "block", "left")
    hit = F.expr(" AND ".join(f"coalesce((shiftrightunsigned(w{i}, b{i}) & 1L) = 1L, false)" for i in range(WORDS)))
    return joined.select(*rows.columns, hit.alias("possible_hit"))


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict, canonical_url and possible_hit; ``listed`` has column canonical_url."""
    exact = materialize(listed.select("canonical_url").where("canonical_url is not null").distinct(), "listed-urls")
    size = max(1, exact.count() * BITS_PER_URL // (64 * WORDS))
    blocks = min(MAX_BLOCKS, 1 << size.bit_length())
    url = F.col(url_col).cast("string")
    parsed = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"), canonical_of(url).alias("canonical_url"))
    ruled = parsed.withColumn("__fits", matching_rule(F.col("host"), F.col("path"), rules))
    probed = probe(ruled, build_filter(exact, "canonical_url", blocks), "canonical_url", blocks).withColumn("possible_hit", F.col("possible_hit") & F.col("__fits").isNull())
    probed = materialize(probed, "probed-urls")  # URLs are read and parsed once
    possible = probed.where("possible_hit").join(exact.withColumn("__listed", F.lit(True)), "canonical_url", "left")
    rest = probed.where(~F.col("possible_hit")).withColumn("__listed", F.lit(None).cast("boolean"))
    verdict = F.when(F.col("__fits").isNotNull(), F.col("__fits.verdict")).when(F.col("__listed"), "block").otherwise("allow")
    return possible.unionByName(rest).select(id_col, "host", "path", F.col("__fits.rule").alias("rule"), verdict.alias("verdict"), "canonical_url", "possible_hit")
