"""Quant desk: universe, point-in-time facts, sleeve scores, rule compiler, allocation, walk-forward tests, fills."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import clamp, half_up, limit_up_price

# The factors that rules may name.
FACTORS = ("main_inflow_1d", "news_novelty", "gap_unfilled", "net_profit_yoy", "revenue_yoy", "roe")
# Quality of an evidence grade.
GRADES = {"A": 1.0, "B": 0.8, "C": 0.5, "D": 0.15}
# The state machine of a candidate.
TRANSITIONS = (("discovered", "validating"), ("discovered", "rejected"), ("validating", "qualified"), ("validating", "watch"), ("validating", "rejected"), ("watch", "validating"), ("watch", "rejected"), ("qualified", "expired"), ("watch", "expired"))


def effective_on(master: DataFrame, day: Column) -> DataFrame:
    """Rows in force on a day; an open end is in force for good."""
    return master.where((F.col("effective_from") <= day) & (F.col("effective_to").isNull() | (F.col("effective_to") >= day)))


def tradable(master: DataFrame, day: Column, list_days: int = 120, median_amount: float = 1e8) -> DataFrame:
    """Listed long enough, neither halted nor delisted, and liquid."""
    ok = ~F.col("status").isin("halted", "delisted") & (F.date_diff(day, F.col("list_date")) >= list_days) & (F.col("median_amount_20d") >= median_amount)
    return effective_on(master, day).where(ok)


def bar_universe(bars: DataFrame, least_bars: int = 120, median_amount: float = 1e8, stale_days: int = 5) -> DataFrame:
    """Bar count, last date, 20-bar median amount of each symbol; in_universe and stale against the market's last date."""
    last = bars.agg(F.max("trade_date").alias("market_date"))
    ranked = bars.withColumn("rn", F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("trade_date").desc())))
    a = ranked.groupBy("symbol").agg(F.count("*").alias("n_bars"), F.max("trade_date").alias("last_date"), F.median(F.when(F.col("rn") <= 20, F.col("amount"))).alias("median_amount"))
    a = a.join(F.broadcast(last), F.lit(True))  # one row
    days = F.date_diff("market_date", "last_date")
    return a.select("symbol", "n_bars", "last_date", half_up(F.col("median_amount"), 2).alias("median_amount"), ((F.col("n_bars") >= least_bars) & (days == 0) & (F.col("median_amount") >= median_amount)).alias("in_universe"), (days > stale_days).alias("stale"))


def score_event(novelty: Column, materiality: Column, grade: Column) -> Column:
    quality = F.try_element_at(F.create_map(*(F.lit(x) for p in GRADES.items() for x in p)), grade)
    value = novelty * materiality * quality
    return F.struct(value.alias("score"), ((value >= 0.4) & grade.isin("A", "B")).alias("qualify"))


def score_trend(inflow: Column, adv: Column, scale: float = 5e7, liquid: float = 1e8) -> Column:
    liquidity = F.coalesce(clamp(adv / liquid, 0, 1), F.lit(0.0))
    value = 0.6 * F.abs(F.coalesce(clamp(inflow / scale, -1, 1), F.lit(0.0))) + 0.4 * liquidity
    return F.struct(value.alias("score"), (F.coalesce(inflow > scale, F.lit(False)) & (liquidity >= 0.3)).alias("qualify"))


def score_fundamental(profit: Column, revenue: Column, roe: Column) -> Column:
    """Never qualifies; watched from .25 on."""
    part = lambda x, low, high: F.coalesce(clamp(x, low, high), F.lit(0.0))
    value = 0.4 * part(profit / 0.5, -1, 1) + 0.3 * part(revenue / 0.5, -1, 1) + 0.3 * part(roe / 20, 0, 1)
    return F.struct(value.alias("score"), (value >= 0.25).alias("watch"), F.lit(False).alias("qualify"))


def known_fact(facts: DataFrame, cutoff: Column | None = None) -> DataFrame:
    """The fact of each symbol and metric by (period, revision, availability); with a cutoff only what was available then."""
    if cutoff is not None:
        facts = facts.where(F.col("available_at") <= cutoff)
    return facts.groupBy("symbol", "metric_key").agg(F.max_by(F.struct("period_end", "value", "revision_no", "available_at"), F.struct("period_end", "revision_no", "available_at")).alias("f")).select("symbol", "metric_key", "f.*")


def latest_financials(facts: DataFrame, metrics: list[str], cutoff: Column) -> DataFrame:
    """The latest period of each symbol, a column for each metric; facts of unknown availability pass."""
    seen = facts.where(F.col("available_at").isNull() | (F.col("available_at") <= cutoff))
    wide = seen.groupBy("symbol", "period_end").agg(*(F.max_by(F.when(F.col("metric_key") == m, F.col("value")), F.when(F.col("metric_key") == m, F.col("revision_no"))).alias(m) for m in metrics))
    return wide.groupBy("symbol").agg(F.max_by(F.struct("period_end", *metrics), "period_end").alias("r")).select("symbol", "r.*")


def compile_rule(rule: dict, known: tuple[str, ...] = FACTORS, depth: int = 3) -> Column:
    """A rule tree (factor, op, value; or logic and conditions) as a boolean column; a missing factor is false."""
    if depth < 0:
        raise ValueError("rule is nested too deeply")
    if "factor" in rule:
        if rule["factor"] not in known:
            raise ValueError(f"unknown factor {rule['factor']}")
        left, right = F.col(rule["factor"]), F.lit(float(rule["value"]))
        try:
            test = {">": left > right, "<": left < right, ">=": left >= right, "<=": left <= right}[rule["op"]]
        except KeyError:
            raise ValueError(f"unknown operator {rule['op']}") from None
        return F.coalesce(test, F.lit(False))
    parts = [compile_rule(c, known, depth - 1) for c in rule.get("conditions") or []]
    if not parts:
        return F.lit(False)
    out = parts[0]
    for p in parts[1:]:
        out = out | p if rule.get("logic") == "or" else out & p
    return out


def fill(next_open: Column, next_high: Column, next_low: Column, next_volume: Column, close: Column, board: Column, halted: Column) -> Column:
    """struct<filled, price, reason> of a buy at the next open; a locked limit-up board does not fill."""
    at_limit = (close > 0) & (half_up(next_open, 2) >= limit_up_price(close, board))
    locked = at_limit & (((next_high == next_low) & (next_low == next_open)) | (next_volume == 0))
    reason = F.when(halted, "halted").when(next_open.isNull(), "no_next_bar").when(locked, "limit_up_unfilled").otherwise("filled_t1_open")
    done = reason == "filled_t1_open"
    return F.struct(done.alias("filled"), F.when(done, next_open).alias("price"), reason.alias("reason"))


def rank_candidates(scored: DataFrame) -> DataFrame:
    """Rank of the qualified candidates of each sleeve."""
    return scored.where("qualify").withColumn("rank", F.row_number().over(Window.partitionBy("sleeve").orderBy(F.col("score").desc(), "symbol")))


def allocate(items: DataFrame, max_symbol: float = 0.08, max_sleeve: float = 0.5, min_cash: float = 0.1, max_positions: int = 12) -> DataFrame:
    """Weights by inverse volatility of the calmest ``max_positions`` items, in order, under symbol, sleeve and cash caps.

    The fold runs over one array of at most ``max_positions`` entries for each portfolio.
    """
    raw = items.withColumn("rn", F.row_number().over(Window.partitionBy("portfolio").orderBy("vol", "symbol"))).where(F.col("rn") <= max_positions)
    packed = raw.groupBy("portfolio").agg(F.array_sort(F.collect_list(F.struct("rn", "symbol", "sleeve", (1 / F.greatest("vol", F.lit(1e-6))).alias("raw")))).alias("items"), F.sum(1 / F.greatest("vol", F.lit(1e-6))).alias("total"))
    zero = F.struct(F.array().cast("array<struct<symbol:string,sleeve:string,weight:double,reason:string>>").alias("out"), F.lit(0.0).alias("invested"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")).alias("used"))

    def step(acc: Column, x: Column) -> Column:
        cash, used = F.lit(1 - min_cash) - acc["invested"], F.coalesce(F.try_element_at(acc["used"], x["sleeve"]), F.lit(0.0))
        w = F.least(F.lit(max_symbol), cash, F.lit(max_sleeve) - used, x["raw"] / F.col("total"))
        reason = F.when(cash <= 0, "cash_floor").when(w <= 0, "sleeve_or_cash_cap")
        given = F.when(reason.isNull(), w).otherwise(0.0)
        entry = F.struct(x["symbol"].alias("symbol"), x["sleeve"].alias("sleeve"), given.alias("weight"), reason.alias("reason"))
        sleeves = F.map_concat(F.map_filter(acc["used"], lambda k, v: k != x["sleeve"]), F.create_map(x["sleeve"], used + given))
        return F.struct(F.concat(acc["out"], F.array(entry)).alias("out"), (acc["invested"] + given).alias("invested"), sleeves.alias("used"))

    done = packed.withColumn("a", F.aggregate("items", zero, step))
    return done.select("portfolio", half_up(F.greatest(F.lit(min_cash), 1 - F.col("a.invested")), 6).alias("cash"), F.inline("a.out")).withColumn("weight", half_up(F.col("weight"), 6))


def walk_forward(bars: DataFrame, signal: Column, board: str = "main", least_bars: int = 60) -> DataFrame:
    """Return, drawdown, trades and unfilled orders of a rule on each symbol's bars.

    Buy at the next open on a signal, sell at the next open without one; what is left closes at the last
    close.  Drawdown is taken before that close, and equity moves on exits only.  The position depends on
    every bar before, so a symbol's bars are one ordered group; symbols are independent.
    """
    limit = {"main": 0.1, "chinext": 0.2, "star": 0.2, "bse": 0.3}[board]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("trade_date", ignore_index=True)
        if len(pdf) < least_bars:
            return pd.DataFrame({"symbol": [], "net_return": [], "max_drawdown": [], "trades": [], "unfilled": []})
        equity = peak = 1.0
        drawdown, entry, trades, unfilled = 0.0, None, 0, 0
        rows = list(zip(pdf["open"], pdf["high"], pdf["low"], pdf["close"], pdf["volume"], pdf["go"], strict=True))
        for (_, _, _, close, _, go), (o, h, low, _, vol, _) in zip(rows, rows[1:], strict=False):
            if go and entry is None:
                at_limit = close > 0 and int(o * 100 + 0.500001) >= int(close * (1 + limit) * 100 + 0.500001)
                if at_limit and (h == low == o or vol == 0) or not o:
                    unfilled += 1
                else:
                    entry, trades = o, trades + 1
            elif entry is not None and not go:
                equity *= o / entry
                entry = None
            peak = max(peak, equity)
            drawdown = max(drawdown, (peak - equity) / peak if peak else 0.0)
        if entry is not None:
            equity *= rows[-1][3] / entry
        return pd.DataFrame({"symbol": [pdf["symbol"][0]], "net_return": [equity - 1], "max_drawdown": [drawdown], "trades": [trades], "unfilled": [unfilled]})

    return bars.withColumn("go", signal).groupBy("symbol").applyInPandas(run, "symbol string, net_return double, max_drawdown double, trades long, unfilled long")


def total_return(bars: DataFrame, actions: DataFrame, start: Column, end: Column, cutoff: Column) -> DataFrame:
    """Return of each symbol from start to end with the share and cash distributions known at the cutoff, in order of ex_date."""
    known = actions.where((F.col("available_at") <= cutoff) & (F.col("ex_date") > start) & (F.col("ex_date") <= end))
    folded = known.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("ex_date", "share_ratio", "cash_ratio"))).alias("a")).select(
        "symbol", F.aggregate("a", F.struct(F.lit(1.0).alias("m"), F.lit(0.0).alias("c")), lambda acc, x: F.struct((acc["m"] * (1 + x["share_ratio"])).alias("m"), (acc["c"] + x["cash_ratio"] * acc["m"] * (1 + x["share_ratio"])).alias("c"))).alias("f")
    )
    edges = bars.groupBy("symbol").agg(F.max(F.when(F.col("trade_date") == start, F.col("close"))).alias("s"), F.max(F.when(F.col("trade_date") == end, F.col("close"))).alias("e"))
    return edges.join(folded, "symbol", "left").select("symbol", half_up(F.try_divide(F.col("e") * F.coalesce("f.m", F.lit(1.0)) + F.coalesce("f.c", F.lit(0.0)), F.nullif("s", F.lit(0.0))) - 1, 6).alias("total_return"))


def check_transitions(moves: DataFrame) -> DataFrame:
    """Moves (state, target) with allowed."""
    pairs = [f"{a}>{b}" for a, b in TRANSITIONS]
    return moves.withColumn("allowed", F.concat_ws(">", "state", "target").isin(pairs))


def lots(cash: Column, weight: Column, price: Column, lot: int = 100) -> Column:
    """Shares in whole lots for a part of the cash."""
    return (F.floor(F.try_divide(cash * weight, price) / lot) * lot).cast("long")


