"""An inverted index of words as a table: postings in folders by a hash of the word, sorted by word and id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
_SCHEMA = "word string, id long, batch long, bucket long"


def words_of(*texts: Column) -> Column:
    """The distinct lower-cased words of the texts."""
    return F.array_remove(F.array_distinct(F.split(F.lower(F.concat_ws(" ", *texts)), r"[^\p{L}\p{N}]+")), "")


def add_batch(rows: DataFrame, path: str, batch: int, columns: list[str], id_col: str = "id", buckets: int = BUCKETS, files: int = 4) -> None:
    """Add the rows' words as a batch; the same batch again replaces what it wrote.

    A bucket is dealt to ``files`` tasks by id, so that a word that most rows have is no single task's.
    """
    postings = rows.select(F.col(id_col).cast("long").alias("id"), F.explode(words_of(*map(F.col, columns))).alias("word"))
    postings = postings.select("word", "id", F.pmod(F.xxhash64("word"), F.lit(buckets)).alias("bucket"))
    dealt = postings.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(files))).sortWithinPartitions("bucket", "word", "id")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={batch}")


def postings(spark: SparkSession, path: str, words: list[str], buckets: int = BUCKETS) -> DataFrame:
    """word and id of the ``words``: only their folders are listed, and only the row groups that may hold them are read."""
    numbers = sorted({r.b for r in spark.createDataFrame([(w,) for w in words], "w string").select(F.pmod(F.xxhash64("w"), F.lit(buckets)).alias("b")).collect()})
    return spark.read.schema(_SCHEMA).option("basePath", path).parquet(path).where(F.col("bucket").isin(numbers) & F.col("word").isin(words)).select("word", "id")


def search(spark: SparkSession, path: str, words: list[str], buckets: int = BUCKETS) -> DataFrame:
    """id of the rows that have all ``words``, from the rarest word's postings on; no words find nothing."""
    words = list(dict.fromkeys(w.lower() for w in words))
    found = postings(spark, path, words, buckets).distinct() if words else spark.createDataFrame([], "word string, id long")
    counts = {r.word: r["count"] for r in found.groupBy("word").count().collect()}  # a row for each word of the query
    if not words or len(counts) < len(words):
        return found.select("id").limit(0)
    order = sorted(words, key=lambda w: (counts[w], w))
    ids = found.where(F.col("word") == order[0]).select("id")
    for word in order[1:]:
        ids = ids.join(found.where(F.col("word") == word).select("id"), "id", "left_semi")
    return ids


def search_or_phrase(rows: DataFrame, path: str, words: list[str], columns: list[str], id_col: str = "id", buckets: int = BUCKETS) -> DataFrame:
    """``rows`` that have all words, by the index; only if there is none, those with the words as a phrase in one of the columns."""
    ids = search(rows.sparkSession, path, words, buckets)
    if not ids.isEmpty():
        return rows.join(ids.withColumnRenamed("id", id_col), id_col, "left_semi")
    phrase, hit = " ".join(words).lower(), F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(phrase))
    return rows.where(hit)
