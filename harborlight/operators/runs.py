"""Late fields, pending rows, batch quotes, cool-downs, and files of samples and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def filled_times(stored: DataFrame, updates: DataFrame) -> DataFrame:
    """Stored items (news_id, published_at, fetched_at) with missing publication times filled from late updates.

    Gives news_id, published_at, effective_at and whether the latter moved.  The earliest update of an
    item counts; a stored time is never replaced.
    """
    late = updates.groupBy("news_id").agg(F.min("published_at").alias("late_at"))
    published = F.coalesce("published_at", "late_at")
    before, after = F.coalesce("published_at", "fetched_at"), F.coalesce("published_at", "late_at", "fetched_at")
    return stored.join(late, "news_id", "left").select("news_id", published.alias("published_at"), after.alias("effective_at"), (~before.eqNullSafe(after)).alias("moved"))


def pending(rows: DataFrame, status: str, time: str, id_col: str, limit: int | None = None) -> DataFrame:
    """Rows without a status, newest first, rows without a time last; ``limit`` takes the first of them."""
    found = rows.where(F.col(status).isNull()).orderBy(F.desc_nulls_last(time), F.desc(id_col))
    return found if limit is None else found.limit(limit)


def batch_quotes(frames: DataFrame) -> DataFrame:
    """Last and previous close of each symbol in landed frames (payload: ``{"day": ..., "close": {symbol: price}}``).

    A frame has one row a day with the closes of a batch of symbols; a symbol without a price on a day
    is left out there, and repeats of a day in several frames count once, with the highest price.
    """
    long = frames.select(F.from_json("payload", "day date, close map<string,double>").alias("f")).select("f.day", F.explode("f.close").alias("symbol", "close")).where("close IS NOT NULL AND day IS NOT NULL")
    days = long.groupBy("symbol", "day").agg(F.max("close").alias("close"))
    w = Window.partitionBy("symbol").orderBy(F.desc("day"))
    ranked = days.withColumn("pos", F.row_number().over(w)).withColumn("previous_close", F.lead("close").over(w)).where("pos = 1")
    change = (F.col("close") - F.col("previous_close")) / F.when(F.col("previous_close") != 0, F.col("previous_close")) * 100
    return ranked.select("symbol", "day", F.col("close").alias("price"), "previous_close", change.alias("change_percent"))


def due_urls(urls: DataFrame, failures: DataFrame, now: Column, cooldown_minutes: int = 60) -> DataFrame:
    """The urls (url) whose last failure (url, failed_at) is not within the cool-down before ``now``."""
    cooling = failures.groupBy("url").agg(F.max("failed_at").alias("last")).where(F.col("last") > now - F.make_dt_interval(mins=F.lit(cooldown_minutes)))
    return urls.join(cooling, "url", "left_anti")


def truncated(content: Column, most: int) -> Column:
    """Struct of the content cut to ``most`` characters, as the setting of a source says, and whether it was longer."""
    return F.struct(F.substring(content, 1, most).alias("content"), F.coalesce(F.length(content) > most, F.lit(False)).alias("oversize"))


def parsed_samples(lines: DataFrame, schema: str, required: list[str]) -> DataFrame:
    """Samples of JSON lines (line): the fields of ``schema`` and ``problem``, which names the first required field that is missing."""
    rows = lines.where(F.trim("line") != "").select(F.from_json("line", schema).alias("s"), F.try_parse_json("line").isNull().alias("broken"))
    missing = F.coalesce(*(F.when(F.col(f"s.{c}").isNull(), c) for c in required))
    return rows.select("s.*", F.when(F.col("broken"), "malformed").otherwise(missing).alias("problem"))


def read_samples(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    return parsed_samples(spark.read.text(path).withColumnRenamed("value", "line"), schema, required)


def write_samples(rows: DataFrame, path: str) -> None:
    """JSON lines, nulls included, so that every line has every field."""
    rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_review_queue(rows: DataFrame, path: str) -> None:
    """The review queue as CSV with a header; quotes and line ends within fields are kept."""
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def markdown_review(row: Column, title: str, fields: list[str]) -> Column:
    """A sample (struct) as a section of a Markdown review list."""
    lines = [F.concat(F.lit(f"- {f}: "), F.coalesce(row[f].cast("string"), F.lit("-"))) for f in fields]
    return F.concat_ws("\n", F.concat(F.lit("### "), F.coalesce(row[title].cast("string"), F.lit("-"))), F.lit(""), *lines)


def append_rows(rows: DataFrame, path: str, key: str) -> None:
    """Append rows below a folder for each value of ``key``; writing a key again replaces its rows, so a retry is harmless."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def persist_run(run: DataFrame, items: DataFrame, stages: DataFrame, path: str) -> None:
    """A run, its items and its stages, three tables keyed by run_id; the run last, so that a run that is there is whole."""
    for name, rows in (("items", items), ("stages", stages), ("runs", run)):
        append_rows(rows, f"{path}/{name}", "run_id")


def positions(rows: DataFrame, by: str, time: str, key: str) -> DataFrame:
    """Adds pos: the place of a row within ``by``, latest ``time`` first and nulls last, then by falling ``key``.

    Places are counted within a day; the rows of the days after it are a prefix sum over one row for each day, so that
    no task has more than a day of one ``by``.
    """
    day = F.to_date(time)
    w = Window.partitionBy(by, "__day").orderBy(F.desc_nulls_last(time), F.desc(key))
    later = Window.partitionBy(by).orderBy(F.desc_nulls_last("__day")).rowsBetween(Window.unboundedPreceding, -1)
    days = rows.groupBy(by, day.alias("__day")).agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(later), F.lit(0))).drop("__n")
    days = days.withColumnsRenamed({by: "__by", "__day": "__of"})
    placed = rows.withColumn("__day", day).withColumn("__pos", F.row_number().over(w))
    joined = placed.join(days, placed[by].eqNullSafe(days["__by"]) & placed["__day"].eqNullSafe(days["__of"]))
    return joined.withColumn("pos", (F.col("__before") + F.col("__pos")).cast("int")).drop("__day", "__pos", "__before", "__by", "__of")
