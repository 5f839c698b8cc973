"""Text column functions: tokens, SimHash, URL and title keys, cursors, symbols."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Query parameters that only track visitors.
TRACKING_PARAMS = "from src ref referer referrer spm share shareid share_token scene clicktime enterid gclid fbclid yclid msclkid mc_cid mc_eid cmpid ncid smid _hsenc _hsmi f".split()
TRACKING_PREFIXES = "utm_ share_ spm_ mtm_ pk_".split()
# Host prefixes of mirrors of one site.
MIRROR_PREFIXES = "www. m. amp. mobile.".split()
# The space separators of Unicode, which SQL's trim takes away.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
# Words left out of title comparisons.
TITLE_STOP_WORDS = "the and for with from after near over into".split()


def trimmed(text: Column) -> Column:
    """The text without space separators at its ends, also no-break and ideographic ones, which ``F.trim`` leaves."""
    return F.btrim(text, F.lit(SPACES))


def title_tokens(title: Column) -> Column:
    """Latin words, then pairs of neighbouring CJK characters (one alone is itself)."""
    low = F.lower(title)
    latin, cjk = F.regexp_extract_all(low, F.lit("([a-z0-9]+)"), 1), F.regexp_extract_all(low, F.lit("([一-鿿])"), 1)
    pairs = F.when(F.size(cjk) < 2, cjk).otherwise(F.zip_with(F.slice(cjk, 1, F.greatest(F.size(cjk) - 1, F.lit(0))), F.slice(cjk, 2, F.greatest(F.size(cjk) - 1, F.lit(0))), lambda a, b: F.concat(a, b)))
    return F.concat(latin, pairs)


@F.pandas_udf(T.LongType())
def _majority_bits(hashes: pd.Series) -> pd.Series:
    """For each array of longs the bits that more than half of them have; 0 for an empty array."""
    out = np.zeros(len(hashes), np.int64)
    for first in range(0, len(hashes), 512):
        some = hashes.iloc[first : first + 512]
        sizes = np.array([len(h) for h in some])
        full = np.flatnonzero(sizes)
        if len(full):
            flat = np.concatenate([np.asarray(some.iloc[i], "<i8") for i in full])
            bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts = np.add.reduceat(bits, np.cumsum(sizes[full]) - sizes[full], axis=0, dtype=np.int64)
            out[first + full] = np.packbits(2 * counts > sizes[full, None], axis=1, bitorder="little").view("<i8").ravel()
    return pd.Series(out)


def simhash64(title: Column) -> Column:
    """SimHash of the title's tokens by the first eight bytes of their SHA-256, as a signed long; 0 without tokens, null for null."""
    hashes = F.transform(title_tokens(title), lambda t: F.conv(F.substring(F.sha2(t, 256), 1, 16), 16, -10).cast("long"))
    # The bits are counted by arrays: as a lambda over 64 counters this is some fifty times slower.
    return F.when(title.isNotNull(), _majority_bits(F.coalesce(hashes, F.array().cast("array<long>"))))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def numeric_fingerprint(title: Column) -> Column:
    """The sorted set of numbers (without thousands commas) and of months in a title."""
    numbers = F.transform(F.regexp_extract_all(title, F.lit(r"(\d+(?:[.,]\d+)*)"), 1), lambda x: F.replace(x, F.lit(","), F.lit("")))
    months = F.transform(F.regexp_extract_all(title, F.lit("(\\d{1,2})\\s*月"), 1), lambda x: F.concat(F.lit("m"), x))
    return F.array_sort(F.array_distinct(F.concat(numbers, months)))


def numbers_contradict(a: Column, b: Column) -> Column:
    return numeric_fingerprint(a) != numeric_fingerprint(b)


def titles_alike(a: Column, b: Column, duplicate: int = 3, gray: int = 6, least_tokens: int = 4, judge: Column | None = None) -> Column:
    """Near-duplicate headlines: by Hamming distance, with a veto by numbers and a judge in the gray zone."""
    distance = hamming(simhash64(a), simhash64(b))
    enough = (F.size(title_tokens(a)) >= least_tokens) & (F.size(title_tokens(b)) >= least_tokens)
    second = F.coalesce(judge, F.lit(False)) if judge is not None else F.lit(False)
    return F.when(~enough, False).when(distance <= duplicate, True).when(distance > gray, False).when(numbers_contradict(a, b), False).otherwise(second)


def url_key(url: Column) -> Column:
    """URL without fragment, default port, tracking parameters and closing slashes; parameters sorted."""
    raw = F.trim(F.coalesce(url, F.lit("")))
    scheme, host = F.lower(F.regexp_extract(raw, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)", 1)), F.lower(F.regexp_extract(raw, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1))
    path, query = F.regexp_extract(raw, r"^[^?#]*?://[^/?#]+([^?#]*)", 1), F.regexp_extract(raw, r"^[^?#]*\?([^#]*)", 1)
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    name = lambda p: F.lower(F.substring_index(p, "=", 1))
    tracking = lambda p: name(p).isin(TRACKING_PARAMS) | name(p).rlike("^(" + "|".join(TRACKING_PREFIXES) + ")")
    params = F.array_sort(F.transform(F.filter(F.split(query, "&"), lambda p: (p != "") & ~tracking(p)), lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("=")))))
    path = F.when(F.length(path) > 1, F.when(F.regexp_replace(path, "/+$", "") == "", "/").otherwise(F.regexp_replace(path, "/+$", ""))).otherwise(path)
    joined = F.concat(scheme, F.lit("://"), host, path, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(""))
    return F.when((scheme == "") | (host == ""), raw).otherwise(joined)


def signature_host(url: Column) -> Column:
    """Host without user, port and one mirror prefix."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1))
    host = F.substring_index(F.substring_index(host, "@", -1), ":", 1)
    return F.regexp_replace(host, "^(" + "|".join(p.replace(".", r"\.") for p in MIRROR_PREFIXES) + ")", "")


def signature_title(title: Column) -> Column:
    """Lower-cased words of the first 500 characters, with single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.substring(F.coalesce(title, F.lit("")), 1, 500)), r"(?U)[^\w]+", " "))


def title_signature(title: Column, url: Column) -> Column:
    """Host and title as one key; null if either is empty."""
    host, words = signature_host(url), signature_title(title)
    return F.when((host != "") & (words != ""), F.concat_ws("|", host, words))


def comparison_tokens(title: Column) -> Column:
    """The distinct words of a title that tell it apart."""
    return F.array_except(F.regexp_extract_all(F.lower(title), F.lit("([a-z0-9一-鿿]+)"), 1), F.array(*map(F.lit, TITLE_STOP_WORDS)))


def overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays; 0 if either is empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.nullif(F.size(F.array_union(a, b)), F.lit(0))), F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays; 0 for empty, zero or unequal lengths."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    value = F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), F.coalesce(value, F.lit(0.0))).otherwise(0.0)


def encode_cursor(at: Column, item_id: Column) -> Column:
    """Page cursor: URL-safe base64 of time and id, without padding."""
    return F.rtrim(F.translate(F.base64(F.encode(F.concat_ws("|", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), item_id), "UTF-8")), "+/\r\n", "-_"), F.lit("="))


def decode_cursor(cursor: Column) -> Column:
    """struct<at, id> of a cursor; null if it is malformed."""
    padded = F.rpad(F.translate(cursor, "-_", "+/"), (F.ceil(F.length(cursor) / 4) * 4).cast("int"), F.lit("="))
    parts = F.split(F.decode(F.unbase64(padded), "UTF-8"), r"\|")
    return F.when(F.size(parts) == 2, F.struct(F.try_to_timestamp(parts[0], F.lit("yyyy-MM-dd'T'HH:mm:ss")).alias("at"), parts[1].try_cast("long").alias("id")))


def normal_symbol(symbol: Column, market: Column) -> Column:
    """struct<symbol, market, provider_symbol> of a security code; null if it is no code."""
    s, where = F.upper(F.trim(symbol)), F.lower(market)
    six, digits, bare = F.regexp_extract(s, r"(\d{6})", 1), F.regexp_extract(s, r"(\d+)", 1), s.rlike(r"^\d{6}$")
    shanghai = s.rlike(r"^SH\d{6}$|^\d{6}\.(SH|SS)$|^6\d{5}$")
    shenzhen = s.rlike(r"^SZ\d{6}$|^\d{6}\.SZ$|^[03]\d{5}$")
    hong_kong = s.rlike(r"^\d+\.HK$|^HK\d+$") | ((where == "hk") & s.rlike(r"^\d+$"))
    made = lambda name, where, provider: F.struct(name.alias("symbol"), F.lit(where).alias("market"), provider.alias("provider_symbol"))
    return (
        F.when(shanghai, made(F.concat(six, F.lit(".SH")), "cn", F.concat(six, F.lit(".SS"))))
        .when(shenzhen, made(F.concat(six, F.lit(".SZ")), "cn", F.concat(six, F.lit(".SZ"))))
        .when((where == "cn") & bare, None)
        .when(hong_kong, made(s, "hk", F.concat(zero_filled(digits, 4), F.lit(".HK"))))
        .when(s.rlike(r"^[.-]*[\p{L}\p{N}][\p{L}\p{N}.-]*$"), made(s, "us", s))
    )


def zero_filled(digits: Column, width: int) -> Column:
    """Zeros in front up to ``width``; longer text stays."""
    return F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)


def symbol_spellings(symbol: Column, market: Column) -> Column:
    """The ways in which a security may be written, as given first."""
    raw, known = F.upper(F.trim(symbol)), normal_symbol(symbol, market)
    code, exchange = F.substring_index(known["symbol"], ".", 1), F.substring_index(known["symbol"], ".", -1)
    local = F.when(known["market"] == "cn", F.array(code, F.concat(exchange, code))).otherwise(F.array().cast("array<string>"))
    return F.when(known.isNull(), F.array(raw)).otherwise(F.array_distinct(F.concat(F.array(raw, known["symbol"]), local)))


def chart_symbol(provider_symbol: Column) -> Column:
    """Exchange in lower case before the digits; null for other markets."""
    s = F.upper(F.trim(provider_symbol))
    digits = F.substring_index(s, ".", 1)
    return (
        F.when(s.rlike(r"^\d{6}\.S[SH]$"), F.concat(F.lit("sh"), digits))
        .when(s.rlike(r"^\d{6}\.SZ$"), F.concat(F.lit("sz"), digits))
        .when(s.rlike(r"^\d+\.HK$"), F.concat(F.lit("hk"), zero_filled(digits, 5)))
    )


def exchange_prefixed(symbol: Column) -> Column:
    """The code behind 1. for Shanghai, else behind 0."""
    s = F.upper(symbol)
    return F.concat(F.when(s.rlike(r"^[^.]*\.SH$"), "1.").otherwise("0."), F.substring_index(s, ".", 1))


def cashtags(text: Column) -> Column:
    """Distinct $SYMBOLs of a text, upper-cased, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\$([A-Za-z][A-Za-z0-9._-]{0,9})"), 1), F.upper))


def market_of_symbols(symbols: Column, default: Column) -> Column:
    """The default if it is a market, else Hong Kong if a symbol says so, else the US."""
    hong_kong = F.exists(symbols, lambda s: s.endswith(".HK") | s.startswith("HK"))
    return F.when(default.isin("us", "hk", "cn"), default).when(hong_kong, "hk").otherwise("us")


def post_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"/status/(\d+)", 1), F.lit(""))


def plain_lower(text: Column) -> Column:
    """Lower case with single spaces."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def search_queries(symbol: Column, name: Column, market: Column) -> Column:
    """Search texts for a security, also in Chinese where its market or name calls for it."""
    english = F.concat(name, F.lit(" "), symbol, F.lit(" stock news"))
    chinese = F.when(is_cjk(name), F.concat(name, F.lit(" 最新消息"))).when(market.isin("cn", "hk"), F.concat(name, F.lit(" "), symbol, F.lit(" 股票 新闻")))
    return F.array_compact(F.array(english, chinese))


def board_of(symbol: Column) -> Column:
    """Board by code prefix."""
    return F.when(symbol.rlike("^(688|689)"), "star").when(symbol.rlike("^(300|301)"), "chinext").when(symbol.rlike("^[48]"), "bse").otherwise("main")


def content_hash(*fields: Column) -> Column:
    """SHA-256 of the fields joined by the unit separator; null fields are empty."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(f, F.lit("")) for f in fields)), 256)


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4)).cast("long")


def keyword_list(csv: Column) -> Column:
    """Comma-separated words as an array without blanks."""
    return F.filter(F.transform(F.split(F.coalesce(csv, F.lit("")), ","), lambda w: F.trim(w)), lambda w: w != "")


def optional_bool(value: Column) -> Column:
    v = F.lower(F.trim(value))
    return F.when(v.isin("true", "1", "yes", "y"), True).when(v.isin("false", "0", "no", "n"), False)


def safe_double(value: Column) -> Column:
    """A number, or null for text that is none and for NaN."""
    x = value.cast("string").try_cast("double")
    return F.when(~F.isnan(x), x)


def is_cjk(text: Column) -> Column:
    return text.rlike("[一-鿿]")


def strip_markup(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"(?s)<[^>]*>", " "), r"\s+", " "))


def clean_xml(content: Column) -> Column:
    """XML without control characters that XML forbids."""
    return F.regexp_replace(content, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
