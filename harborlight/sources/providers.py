"""Parsers of data providers' JSON payloads: industry boards and financial facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import safe_double

# Field names of the board list.
_BOARD = "struct<f12:string,f14:string,f2:string,f3:string,f104:string,f105:string,f106:string,f62:string>"


def parse_boards(payloads: DataFrame, limit: int = 100) -> DataFrame:
    """Boards of payloads (payload_id, content), whose list may also be a map by number.

    At most ``limit`` boards of a payload, as a source's setting says; boards without a code are left
    out, values that are no numbers are null, and a payload without a list gives no rows.
    """
    inner = F.get_json_object("content", "$.data.diff")
    boards = F.when(inner.startswith("["), F.from_json(inner, f"array<{_BOARD}>")).when(inner.startswith("{"), F.map_values(F.from_json(inner, f"map<string,{_BOARD}>")))
    coded = F.slice(F.filter(boards, lambda b: F.coalesce(b["f12"], F.lit("")) != ""), 1, limit)
    number = lambda f: safe_double(F.col(f"b.{f}"))
    whole = lambda f: F.col(f"b.{f}").try_cast("long")
    return payloads.select("payload_id", F.explode(coded).alias("b")).select(
        "payload_id", F.col("b.f12").alias("code"), F.col("b.f14").alias("name"), number("f2").alias("price"), number("f3").alias("change_percent"),
        whole("f104").alias("advance_count"), whole("f105").alias("decline_count"), whole("f106").alias("flat_count"), number("f62").alias("net_inflow"),
    )


def _day(text: Column) -> Column:
    return F.to_date(F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")))


def parse_facts(payloads: DataFrame, fields: dict[str, str], percents: tuple[str, ...] = ()) -> DataFrame:
    """Long facts of payloads (symbol, content): symbol, period_end, metric_key, value, available_at, document_id.

    ``fields`` maps metrics to the provider's field names; those in ``percents`` become ratios.  A metric
    without a number gives no row, nor does a report without a period; facts are known from their notice day.
    """
    record = F.from_json("content", "result struct<data:array<map<string,string>>>")["result"]["data"]
    rows = payloads.select(F.upper("symbol").alias("symbol"), F.explode(record).alias("r"))
    scale = lambda metric: 100.0 if metric in percents else 1.0
    metrics = F.array(*(F.struct(F.lit(m).alias("metric_key"), (safe_double(F.try_element_at("r", F.lit(f))) / F.lit(scale(m))).alias("value")) for m, f in fields.items()))
    found = rows.select(
        "symbol", _day(F.try_element_at("r", F.lit("REPORT_DATE"))).alias("period_end"), _day(F.try_element_at("r", F.lit("NOTICE_DATE"))).alias("available_at"),
        F.coalesce(F.try_element_at("r", F.lit("SECURITY_CODE")), F.lit("")).alias("document_id"), F.inline(metrics),
    )
    return found.where("period_end is not null and value is not null").select("symbol", "period_end", "metric_key", "value", "available_at", "document_id")
