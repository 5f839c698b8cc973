"""Queries over the markup and the bytes of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import markup
from ..sources import payloads
from ..sources import tables as t
from .common import query

_LIST = markup.ListRule("nav > ul > li", "a", "a[href]", content="a[href^='/']")


@query(r"""WITH e AS (SELECT page_id, unnest(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<li><a href="([^"]*)">([^<]*)</a></li>', 1)) AS href, unnest(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<li><a href="([^"]*)">([^<]*)</a></li>', 2)) AS title,
  unnest(range(len(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<li><a href="([^"]*)">([^<]*)</a></li>', 1)))) AS i FROM pages),
f AS (SELECT * FROM e WHERE title <> '' AND href <> '' QUALIFY row_number() OVER (PARTITION BY page_id, href ORDER BY i) = 1)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) AS INT) AS pos, replace(title, '&amp;', '&') AS title, replace(href, '&amp;', '&') AS href, CASE WHEN starts_with(href, '/') THEN replace(title, '&amp;', '&') END AS content_text FROM f""")
def page_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Menu entries of pages by selectors (SRC09)."""
    return markup.list_items(t.read(spark, sf_dir, "pages"), _LIST).drop("time_text")


_CONTAINERS = ["#content", "div.ad, .advert", "article", "body"]


@query(r"""WITH x AS (SELECT page_id, html, trim(regexp_replace(regexp_extract(html, '(?s)<div class="ad">(.*?)</div>', 1), '(<[^>]*>)+', chr(10), 'g'), chr(10) || chr(9) || chr(13) || ' ') AS ad, trim(regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '(<[^>]*>)+', chr(10), 'g'), chr(10) || chr(9) || chr(13) || ' ') AS article FROM pages),
y AS (SELECT page_id, replace(replace(replace(ad, '&quot;', '"'), '&lt;', '<'), '&amp;', '&') AS ad, replace(replace(replace(article, '&quot;', '"'), '&lt;', '<'), '&amp;', '&') AS article FROM x)
SELECT page_id, CASE WHEN length(ad) > 120 THEN 'div.ad, .advert' WHEN length(article) > 120 THEN 'article' END AS selector, CASE WHEN length(ad) > 120 THEN CAST(length(ad) AS INT) WHEN length(article) > 120 THEN CAST(length(article) AS INT) END AS n_chars
FROM y WHERE length(ad) > 120 OR length(article) > 120""")
def page_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first container with enough text, by selectors in order (SRC21)."""
    found = markup.containers(t.read(spark, sf_dir, "pages"), _CONTAINERS)
    return found.where("selector <> 'body'").select("page_id", "selector", F.length("text").alias("n_chars"))


@query("SELECT doc_id, sha256(text) AS digest, CAST(length(text) AS INT) AS n_chars FROM documents WHERE text IS NOT NULL")
def decoded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts encoded in several charsets and decoded by header, meta element or what their bytes are valid as (SRC20)."""
    d = t.read(spark, sf_dir, "documents").where("text is not null")
    kind = F.col("doc_id") % 4
    raw = F.when(kind == 0, F.encode("text", "UTF-8")).when(kind == 1, F.encode("text", "UTF-16LE")).otherwise(F.encode("text", "UTF-8"))
    header = F.when(kind == 0, "text/html; charset=utf-8").when(kind == 1, "text/html; charset=utf-16-le").when(kind == 2, "text/html; charset=ascii").otherwise("text/html")
    text = payloads.decode_page(raw, header)
    return d.select("doc_id", text.alias("x")).select("doc_id", F.sha2("x", 256).alias("digest"), F.length("x").alias("n_chars"))
