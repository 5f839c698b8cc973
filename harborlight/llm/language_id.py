"""Language identification by fusing Bayesian evidence.

The text likelihood is a multinomial model of hashed byte trigrams, fitted on all labelled texts by
grouped counts; it is tempered, as neighbouring trigrams are not independent.  Each page then has

    P(lang | page) ~ P(text | lang)^temper * P(declared | lang) * P(lang | host)

P(declared | lang) comes from counts of the declared markup language against the text's posterior.
P(lang | host) is smoothed up a chain: host, registered domain, address suffix, all pages; each level
adds ``strength`` pseudo-pages of its parent, and all levels are grouped sums of text posteriors.  A
page's own posterior is taken out of all these sums before they are used for it, so its text counts once.

Defined cases: null or empty html has no text evidence and no declared language; a null or malformed URL
has the empty host; repeated rows each count; an empty page table gives no rows, and labelled texts
are required for a model; unlabelled texts are ignored, as are other columns.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FOLDED, map_arrow, materialize, row_slices, text_bytes
from .html_extraction import main_text
from .url_filters import host_of

BUCKETS = 1 << 16
_DECLARED = re.compile(r"""<html\b[^>]*?\blang\s*=\s*["']?\s*([A-Za-z]{2,3})\b""", re.I)
_META = re.compile(r"""<meta\b[^>]*?content-language[^>]*?content\s*=\s*["']?\s*([A-Za-z]{2,3})\b""", re.I)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of each byte trigram of the folded texts; runs of separators are one space."""
    mapped = FOLDED[data]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    keep = np.ones(len(mapped), bool)
    keep[1:] = (mapped[1:] != 32) | (mapped[:-1] != 32)
    mapped, row = mapped[keep].astype(np.uint32), row[keep]
    if len(mapped) < 3:
        return row[:0], mapped[:0]
    code = mapped[:-2] << np.uint32(16) | mapped[1:-1] << np.uint32(8) | mapped[2:]
    same = row[:-2] == row[2:]
    return row[:-2][same], ((code * np.uint32(2654435761)) >> np.uint32(16))[same]


def trigram_counts(texts: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, bucket, n over all labelled texts; each batch is counted before anything is shuffled."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs = batch.column(0).dictionary_encode()
        names, code = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
        every, bounds = text_bytes(batch.column(1))
        total: dict[int, np.ndarray] = {}
        for first, last in row_slices(bounds):
            row, bucket = trigrams(every[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first])
            of = code[first:last][row]
            for k in np.unique(of):
                total[k] = total.get(k, 0) + np.bincount(bucket[of == k], minlength=BUCKETS)
        found = [(names[k], np.flatnonzero(n), n) for k, n in total.items()]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([x for x, at, _ in found for _ in at], pa.string()),
                pa.array(np.concatenate([at for _, at, _ in found] or [[]]).astype(np.int32)),
                pa.array(np.concatenate([n[at] for _, at, n in found] or [[]]).astype(np.int64)),
            ],
            ["lang", "bucket", "n"],
        )

    rows = texts.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    return map_arrow(rows, count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(texts: DataFrame, text_col: str = "text", lang_col: str = "lang", smoothing: float = 0.5, max_langs: int = 256) -> tuple[list[str], np.ndarray]:
    """The languages, and their log probabilities of each bucket: at most BUCKETS numbers for each of ``max_langs`` languages.

    More labels than that are an error, since the model is sent to all tasks.
    """
    grouped = materialize(trigram_counts(texts, text_col, lang_col), "trigram-counts")
    langs = sorted(r.lang for r in grouped.select("lang").distinct().limit(max_langs + 1).collect())
    if not langs:
        raise ValueError("no labelled texts to fit the text model on")
    if len(langs) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    counts = grouped.toPandas()
    n = np.zeros((len(langs), BUCKETS))
    n[counts["lang"].map({x: i for i, x in enumerate(langs)}), counts["bucket"]] = counts["n"]
    return langs, np.log((n + smoothing) / (n.sum(1, keepdims=True) + smoothing * BUCKETS)).astype(np.float32)


def text_evidence(pages: DataFrame, langs: list[str], model: np.ndarray, temper: float, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """id, url, declared language, number of trigrams, and the text's posterior as array of double."""
    rows = pages.select(id_col, F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    shared = pages.sparkSession.sparkContext.broadcast(model)
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        declared, texts = [], []
        for x in batch.column(2):
            html = x.as_py() or ""
            found = _DECLARED.search(html) or _META.search(html)
            declared.append(found and found.group(1).lower())
            texts.append(main_text(html))
        every, bounds = text_bytes(pa.array(texts, pa.string()))
        n, post = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(langs)))
        for first, last in row_slices(bounds):
            row, bucket = trigrams(every[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first])
            n[first:last] = np.bincount(row, minlength=last - first)
            for k in range(len(langs)):
                post[first:last, k] = np.bincount(row, shared.value[k][bucket], last - first)
        post *= temper
        post = np.exp(post - post.max(1, keepdims=True))
        post /= post.sum(1, keepdims=True)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * len(langs), pa.int32()), pa.array(post.ravel()))
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(declared, pa.string()), pa.array(n), lists], [id_col, "url", "declared", "n_trigrams", "text_posterior"])

    return map_arrow(rows, run, f"{id_col} {kind}, url string, declared string, n_trigrams long, text_posterior array<double>")


def _own(size: int) -> Column:
    """A page's own share of the sums: its text posterior, nothing without text."""
    return F.when(F.col("n_trigrams") > 0, F.col("text_posterior")).otherwise(F.array(*[F.lit(0.0)] * size))


def _sums(rows: DataFrame, by: list[str], column: str, size: int, out: str) -> DataFrame:
    """The array ``column`` summed element by element."""
    parts = rows.groupBy(*by).agg(*(F.sum(F.col(column)[k]).alias(f"__{k}") for k in range(size)))
    return parts.select(*by, F.array(*(f"__{k}" for k in range(size))).alias(out))


def host_sums(evidence: DataFrame, size: int) -> DataFrame:
    """host and the sums of the text posteriors of all pages of the host (h), its domain (d), its suffix (s) and all (g)."""
    hosts = _sums(evidence.withColumn("own", _own(size)), ["host", "domain", "suffix"], "own", size, "h")
    domains = _sums(hosts, ["domain", "suffix"], "h", size, "d")
    suffixes = _sums(domains, ["suffix"], "d", size, "s").withColumn("__all", F.lit(0))
    # One row for all pages, and few suffixes: Spark broadcasts them only if their measured size allows it.
    suffixes = suffixes.join(_sums(suffixes, ["__all"], "s", size, "g"), "__all").drop("__all")
    return hosts.join(domains.join(suffixes, "suffix"), ["domain", "suffix"]).select("host", "h", "d", "s", "g")


def without(sums: Column, own: Column) -> Column:
    return F.zip_with(sums, own, lambda x, y: F.greatest(x - y, F.lit(0.0)))


def smoothed(sums: Column, own: Column, parent: Column, strength: float) -> Column:
    """The distribution of the sums less ``own``, with ``strength`` pseudo-pages of the parent."""
    total = F.aggregate(without(sums, own), F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(without(sums, own), parent, lambda x, p: (x + F.lit(strength) * p) / (total + F.lit(strength)))


def identify(
    pages: DataFrame, labelled: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", text_col: str = "text", lang_col: str = "lang", temper: float = 0.2, strength: float = 5.0
) -> DataFrame:
    """id, url, lang, confidence, text_lang, declared, host and the posterior of each language."""
    langs, model = fit(labelled, text_col, lang_col)
    size = len(langs)
    found = text_evidence(pages, langs, model, temper, id_col, url_col, html_col)
    host = F.regexp_replace(host_of(F.col("url")), r":\d*$", "")
    found = materialize(
        found.withColumn("host", host).withColumn("suffix", F.substring_index("host", ".", -1)).withColumn("domain", F.substring_index("host", ".", -2)), "language-evidence"
    )
    sums = materialize(host_sums(found, size), "host-sums")
    declared = materialize(_sums(found.where("declared is not null").withColumn("own", _own(size)), ["declared"], "own", size, "c"), "declared-counts")
    # P(declared | lang): counts of each declared code, smoothed by one page spread over the codes.
    totals = declared.agg(F.count("*").alias("codes"), *(F.sum(F.col("c")[k]).alias(f"t{k}") for k in range(size))).first()
    every = F.array(*(F.lit(totals[f"t{k}"] or 0.0) for k in range(size)))
    even, own = F.array(*[F.lit(1.0 / size)] * size), F.col("own")
    prior = even
    for level in ("g", "s", "d", "h"):
        prior = smoothed(F.col(level), own, prior, strength)
    likelihood = F.zip_with(without(F.col("c"), own), without(every, own), lambda c, t: (c + F.lit(1.0 / max(1, totals["codes"]))) / (t + 1.0))
    weights = F.transform(
        F.arrays_zip("text_posterior", prior.alias("p"), F.coalesce(likelihood, even).alias("d")),
        lambda x: F.greatest(x["text_posterior"], F.lit(1e-300)) * x["p"] * x["d"],
    )
    fused = found.join(sums, "host", "left").join(declared, "declared", "left").withColumn("own", _own(size)).withColumn("__w", weights)
    total = F.aggregate("__w", F.lit(0.0), lambda a, x: a + x)
    names = F.array(*map(F.lit, langs))
    fused = fused.withColumn("posterior", F.transform("__w", lambda x: F.try_divide(x, total)))
    best = lambda column: F.element_at(names, F.array_position(column, F.array_max(column)).cast("int"))
    return fused.select(
        id_col, "url", best(F.col("posterior")).alias("lang"), F.array_max("posterior").alias("confidence"),
        F.when(F.col("n_trigrams") > 0, best(F.col("text_posterior"))).alias("text_lang"), "declared", "host", F.map_from_arrays(names, "posterior").alias("posterior"),
    )
