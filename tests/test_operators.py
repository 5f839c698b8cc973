"""Edge cases of the operators, held against small independent computations."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from harborlight.functions import numbers, rules, text, times, topics
from harborlight.operators import asof, backtest, desk, news, quant, records, runs, sentiment, timeseries, upsert
from harborlight.sources import payloads


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def ts(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("bucket", [1_000_000, 60_000_000, asof.DAY])
def test_asof_against_loop(spark, forward, bucket):
    rng = random.Random(7)
    left = [(i, rng.choice("abc"), ts(rng.randrange(300))) for i in range(120)] + [(900, None, ts(5)), (901, "a", None), (902, "z", ts(5))]
    right = [(i, rng.choice("ab"), ts(rng.randrange(300)), rng.random()) for i in range(60)] + [(990, None, ts(1), 1.0), (991, "a", None, 1.0)]
    l_df, r_df = spark.createDataFrame(left, "i long, k string, t timestamp"), spark.createDataFrame(right, "id long, k string, at timestamp, v double")
    got = {r.i: r.hit and r.hit.id for r in asof.asof(l_df, r_df, "k", asof.micros("t"), asof.micros("at"), F.col("id"), ["id", "v"], "hit", forward, bucket).collect()}
    for i, k, t in left:
        found = [(a, j) for j, kk, a, _ in right if k is not None and t is not None and kk == k and a is not None and (a >= t if forward else a <= t)]
        assert got[i] == ((min(found) if forward else max(found))[1] if found else None)


def test_asof_empty(spark):
    empty = spark.createDataFrame([], "id long, k string, at timestamp, v double")
    some = spark.createDataFrame([(1, "a", ts(1))], "i long, k string, t timestamp")
    assert asof.asof(some, empty, "k", asof.micros("t"), asof.micros("at"), F.col("id"), ["v"], "hit").first().hit is None
    assert asof.asof(some.limit(0), empty, "k", asof.micros("t"), asof.micros("at"), F.col("id"), ["v"], "hit").count() == 0


def test_backtest_reasons(spark):
    day = 86_400
    signals = spark.createDataFrame(
        [(1, "A", ts(10), "positive", 0.9, 1.0), (2, "B", ts(10), "positive", None, None), (3, "A", ts(-10), "negative", 0.5, 0.5), (4, "C", ts(3 * day), "negative", 0.1, -0.3), (5, "A", ts(2 * day), "negative", 0.1, 0.0), (6, "D", ts(0), "positive", 0.2, 0.2)],
        "news_id long, symbol string, published_at timestamp, label string, importance double, score double",
    )
    quotes = spark.createDataFrame([(1, "A", 10.0, ts(10)), (2, "A", 12.0, ts(day + 10)), (3, "C", 5.0, ts(0)), (4, "D", 0.0, ts(0)), (5, "D", 1.0, ts(day))], "id long, symbol string, price double, fetched_at timestamp")
    rows = {r.news_id: r for r in backtest.outcomes(signals, quotes).collect()}
    assert (rows[1].skip_reason, round(rows[1].ret, 6), rows[1].hit) == (None, 0.2, True)
    assert [rows[i].skip_reason for i in (2, 3, 4, 5, 6)] == ["no_prices", "no_baseline", "stale", "no_forward", "no_forward"]
    table = backtest.calibration(backtest.score_buckets(backtest.outcomes(signals, quotes))).collect()
    assert len(table) == 5 and all(r.low_sample for r in table) and {r.suggested_threshold for r in table} == {None}


def test_simhash_matches_definition(spark):
    import hashlib
    import re

    def reference(title):
        low = title.lower()
        tokens, cjk = re.findall("[a-z0-9]+", low), re.findall("[一-鿿]", low)
        tokens += cjk if len(cjk) == 1 else [a + b for a, b in zip(cjk, cjk[1:], strict=False)]
        hashes = [int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "big") for t in tokens]
        value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes) and hashes)
        return value - (1 << 64) if value >> 63 else value

    titles = ["Fed raises rates by 25bp", "央行降息 0.25 个百分点", "利", "", "CPI 11月 同比上涨 0.2%"]
    rows = spark.createDataFrame([(t,) for t in titles], "t string").select("t", text.simhash64(F.col("t")).alias("h")).collect()
    assert {r.t: r.h for r in rows} == {t: reference(t) for t in titles}


def test_near_titles_lose_no_pair(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    base = [" ".join(rng.choices(words, k=12)) for _ in range(8)]
    rows = []
    for i in range(80):
        w = rng.choice(base).split()
        if rng.random() < 0.7:
            w[rng.randrange(12)] = rng.choice(words)
        rows.append((i, " ".join(w), ts(rng.randrange(4 * 3600))))
    df = spark.createDataFrame(rows, "news_id long, title string, effective_at timestamp")
    hashes = {r.news_id: r.h & (1 << 64) - 1 for r in df.select("news_id", text.simhash64(F.col("title")).alias("h")).collect()}
    want = {(a, b) for a, _, s in rows for b, _, t in rows if a < b and abs((s - t).total_seconds()) <= 3600 and (hashes[a] ^ hashes[b]).bit_count() <= 6}
    assert {(r.a, r.b) for r in news.near_titles(df).collect()} == want and want


def test_fusable_loses_no_pair(spark):
    rng, rows = random.Random(11), []
    for i in range(150):
        # Some words and symbols are in most cards.
        title = ["market", "stocks"] * rng.randrange(2) + rng.sample([f"word{k}" for k in range(12)], rng.randrange(5))
        rows.append((i, rng.choice(["macro", "mna", "general"]), rng.sample(["HOT", *(f"S{k}" for k in range(15))], rng.randrange(4)) + ["HOT"] * rng.randrange(2), " ".join(title)))
    df = spark.createDataFrame(rows, "topic_id long, event_type string, symbols array<string>, event_title string")
    words = {r.topic_id: set(r.w) for r in df.select("topic_id", text.comparison_tokens(F.col("event_title")).alias("w")).collect()}
    want = set()
    for a, kind, left, _ in rows:
        for b, other, right, _ in rows:
            if a < b and kind == other != "general":
                x, y = words[a], words[b]
                if left and right and left[0] == right[0] or len({*left} & {*right}) >= 2 or x and y and len(x & y) / len(x | y) >= 0.5:
                    want.add((a, b, kind))
    assert [tuple(r) for r in news.fusable(df).orderBy("a", "b").collect()] == sorted(want) and len(want) > 50


def test_url_keys(spark):
    cases = {
        "HTTP://Example.com:80/a/?utm_source=x&b=2&a=1#top": "http://example.com/a?a=1&b=2", "https://example.com/": "https://example.com/", "https://m.example.com:443/x//?ref=1": "https://m.example.com/x",
        "https://example.com/x?id=7&flag": "https://example.com/x?flag=&id=7", "not a url": "not a url", None: "",
    }
    rows = spark.createDataFrame([(u,) for u in cases], "u string").select("u", text.url_key(F.col("u")).alias("k"), text.signature_host(F.col("u")).alias("h")).collect()
    assert {r.u: r.k for r in rows} == cases
    assert {r.u: r.h for r in rows}["https://m.example.com:443/x//?ref=1"] == "example.com"


def test_symbols(spark):
    cases = [("600000", None, ("600000.SH", "cn", "600000.SS")), ("sz000001", None, ("000001.SZ", "cn", "000001.SZ")), ("000001.SZ", "cn", ("000001.SZ", "cn", "000001.SZ")), ("700.HK", None, ("700.HK", "hk", "0700.HK")), ("aapl", "us", ("AAPL", "us", "AAPL")), ("900001", "cn", None), ("123456", None, ("123456", "us", "123456")), ("", None, None), ("hk00700", None, ("HK00700", "hk", "00700.HK")), ("5", "hk", ("5", "hk", "0005.HK")), ("brk.b", "cn", ("BRK.B", "us", "BRK.B")), ("^x", None, None)]
    rows = spark.createDataFrame([(i, s, m) for i, (s, m, _) in enumerate(cases)], "i int, s string, m string").select("i", text.normal_symbol(F.col("s"), F.col("m")).alias("n")).collect()
    assert {r.i: r.n and tuple(r.n) for r in rows} == {i: want for i, (_, _, want) in enumerate(cases)}


def test_cursors_round_trip(spark):
    df = spark.createDataFrame([(ts(5), 17)], "t timestamp, id long").select(text.decode_cursor(text.encode_cursor(F.col("t"), F.col("id").cast("string"))).alias("d"))
    assert tuple(df.first().d) == (ts(5), 17)
    assert one(spark, text.decode_cursor(F.lit("!!!!").substr(1, 0))) is None


def test_piecewise_scores(spark):
    for x, want in ((-3, -1.0), (-2, -1.0), (-1.25, -0.75), (-0.5, -0.5), (0.0, 0.0), (0.5, 0.5), (2, 1.0)):
        assert one(spark, numbers.momentum_score(F.lit(float(x)))) == pytest.approx(want)
    for x, want in ((10, 0.5), (20, 0.0), (25, -0.25), (30, -1.0)):
        assert one(spark, numbers.volatility_score(F.lit(float(x)))) == pytest.approx(want)
    null = F.lit(None).cast("double")
    assert one(spark, numbers.composite([(F.lit(1.0), 0.6), (null, 0.25), (F.lit(-0.5), 0.15)])) == pytest.approx((0.6 - 0.075) / 0.75)
    assert one(spark, numbers.composite([(null, 0.6)])) is None
    assert one(spark, numbers.token_cost(F.lit(1000), F.lit(10), null, null)) is None


def test_lexicon(spark):
    rows = spark.createDataFrame([(1, "Strong growth boost as demand expands"), (2, "Weak orders, warning: risk risk"), (3, "公司业绩超预期，股价大涨"), (4, ""), (5, None)], "i int, t string")
    got = {r.i: r for r in sentiment.classify(rows, F.coalesce("t", F.lit(""))).collect()}
    assert (got[1].label, got[1].score, got[1].topic_key) == ("positive", 1.0, "demand")
    assert (got[2].label, got[2].score, got[2].confidence) == ("negative", -1.0, 0.85)
    assert (got[3].label, got[3].score) == ("positive", 1.0) and got[4].topic_key == got[5].topic_key == "general-market-update"


def test_allocation_against_loop(spark):
    rng = random.Random(5)
    items = [(p, f"S{i:02d}", rng.choice(["trend", "event"]), rng.choice([0.0, 0.1, 0.2, 0.5, 1.0])) for p in ("one", "two") for i in range(20)]
    got = {(r.portfolio, r.symbol): (r.weight, r.reason, r.cash) for r in quant.allocate(spark.createDataFrame(items, "portfolio string, symbol string, sleeve string, vol double"), max_symbol=0.3).collect()}
    for p in ("one", "two"):
        ranked = sorted(((v, s, sl) for q, s, sl, v in items if q == p))[:12]
        total, used, invested, want = sum(1 / max(v, 1e-6) for v, _, _ in ranked), {}, 0.0, {}
        for v, s, sl in ranked:
            cash = 0.9 - invested
            w = min(0.3, cash, 0.5 - used.get(sl, 0.0), 1 / max(v, 1e-6) / total)
            reason = "cash_floor" if cash <= 0 else "sleeve_or_cash_cap" if w <= 0 else None
            w = 0.0 if reason else w
            used[sl], invested = used.get(sl, 0.0) + w, invested + w
            want[s] = (w, reason)
        assert {s for q, s in got if q == p} == set(want)
        for s, (w, reason) in want.items():
            assert got[p, s][0] == pytest.approx(w, abs=1e-6) and got[p, s][1] == reason and got[p, s][2] == pytest.approx(max(0.1, 1 - invested), abs=1e-6)


def test_rules_compile(spark):
    row = spark.createDataFrame([(1.0, None)], "roe double, revenue_yoy double")
    assert row.select(quant.compile_rule({"logic": "or", "conditions": [{"factor": "revenue_yoy", "op": ">", "value": 0}, {"factor": "roe", "op": ">=", "value": 1}]}).alias("x")).first().x is True
    assert row.select(quant.compile_rule({"conditions": []}).alias("x")).first().x is False
    for bad in ({"factor": "nope", "op": ">", "value": 1}, {"factor": "roe", "op": "!", "value": 1}, {"conditions": [{"conditions": [{"conditions": [{"conditions": [{"factor": "roe", "op": ">", "value": 1}]}]}]}]}):
        with pytest.raises(ValueError):
            quant.compile_rule(bad)


def test_fill_reasons(spark):
    cases = [((11.0, 11.0, 11.0, 5.0, 10.0, "main", False), (False, "limit_up_unfilled")), ((11.0, 11.5, 10.0, 5.0, 10.0, "main", False), (True, "filled_t1_open")), ((11.0, 11.0, 11.0, 5.0, 10.0, "star", False), (True, "filled_t1_open")), ((None, None, None, None, 10.0, "main", False), (False, "no_next_bar")), ((9.0, 9.0, 9.0, 1.0, 10.0, "main", True), (False, "halted"))]
    df = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], "i int, o double, h double, l double, v double, c double, b string, x boolean")
    got = {r.i: (r.f.filled, r.f.reason) for r in df.select("i", quant.fill(*map(F.col, "ohlvcbx")).alias("f")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_portfolio_edges(spark):
    holdings = spark.createDataFrame([("A", 2.0, 5.0), ("B", 1.0, None), ("C", None, 1.0), ("D", 3.0, 2.0)], "symbol string, position_size double, average_cost double")
    quotes = spark.createDataFrame([("A", 10.0), ("B", 4.0), ("D", 0.0)], "symbol string, price double")
    rows = desk.positions(holdings, quotes)
    assert {r.symbol: (r.market_value, r.profit) for r in rows.collect()} == {"A": (20.0, 10.0), "B": (4.0, None), "D": (None, None)}
    s = desk.portfolio_summary(rows).first()
    assert (s.market_value, s.cost_basis, s.profit, s.profit_percent) == (24.0, 16.0, 10.0, 100.0)
    assert sum(r.weight for r in desk.weights(rows).collect()) == pytest.approx(1.0)


def test_oscillators_over_batches_and_bars_without_sorting(spark):
    from harborlight.sources import tables

    assert "SortAggregate" not in tables.bars(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    bars = tables.bars(spark, "/root/testdata/sf0.001").select("symbol", "trade_date", "high", "low", "close")
    plan = timeseries.oscillators(bars)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan
    want = {}
    for symbol, pdf in bars.toPandas().groupby("symbol"):
        pdf = pdf.sort_values("trade_date", ignore_index=True)
        for day, *values in zip(pdf["trade_date"], *timeseries._recurrences_with_gaps(pdf["high"], pdf["low"], pdf["close"]), strict=True):
            want[symbol, day] = values
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {(r.symbol, r.trade_date): r[2:] for r in timeseries.oscillators(bars).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.keys() == want.keys()
    assert all(x is None and y != y or abs(x - y) < 1e-4 for k in want for x, y in zip(got[k], want[k], strict=True))


def test_oscillators_short_and_flat(spark):
    bars = spark.createDataFrame([("A", dt.date(2024, 1, i + 1), 1.0, 1.0, 1.0) for i in range(20)] + [("B", dt.date(2024, 1, 1), 2.0, 1.0, 1.5)], "symbol string, trade_date date, high double, low double, close double")
    rows = timeseries.oscillators(bars).collect()
    flat = [r for r in rows if r.symbol == "A"]
    assert {r.k for r in flat} == {0.0} and {r.hist for r in flat} == {0.0} and sorted(r.rsi is None for r in flat) == [False] * 6 + [True] * 14
    assert [r.rsi for r in rows if r.symbol == "B"] == [None]


def test_upserts(spark, tmp_path):
    old, new = spark.createDataFrame([(1, "a", None), (2, "b", 2.0)], "k int, s string, x double"), spark.createDataFrame([(2, None, 9.0), (3, "c", None), (3, "c", None), (1, "z", 1.0)], "k int, s string, x double")
    assert {tuple(r) for r in upsert.latest_wins(old, new.dropDuplicates(), ["k"]).collect()} == {(1, "z", 1.0), (2, None, 9.0), (3, "c", None)}
    assert {tuple(r) for r in upsert.fill_only(old, new.dropDuplicates(), ["k"]).collect()} == {(1, "a", 1.0), (2, "b", 2.0), (3, "c", None)}
    assert [tuple(r) for r in upsert.insert_ignore(old, new, ["k"]).collect()] == [(3, "c", None)]
    for v, df in enumerate((old, new)):
        upsert.write_snapshot(df, str(tmp_path / "s"), v)
    assert upsert.read_snapshot(spark, str(tmp_path / "s")).count() == 4
    rows = spark.createDataFrame([(1, ts(0)), (2, ts(99)), (3, None)], "i int, t timestamp")
    gone, kept = upsert.split_expired(rows, "t", F.lit(ts(50)))
    assert [r.i for r in gone.collect()] == [1] and sorted(r.i for r in kept.collect()) == [2, 3]
    upsert.archive(gone, str(tmp_path / "a"), "t")
    assert spark.read.json(str(tmp_path / "a")).count() == 1


def test_feeds(spark):
    rss = "<rss><channel><item><title>One & two</title><link>u1</link><pubDate>Mon, 01 Jan 2024 10:00:00 +0800</pubDate></item><item><title>Again</title><link>u1</link></item><item><link>u2</link></item><item><title>Two</title><link>u3</link></item></channel></rss>"
    atom = '<feed><entry><title>A</title><link rel="self" href="self"/><link rel="alternate" href="alt"/><updated>2024-03-10T09:30:00Z</updated></entry></feed>'
    rows = payloads.parse_feeds(spark.createDataFrame([(1, rss), (2, atom), (3, "junk"), (4, None)], "payload_id long, content string")).orderBy("payload_id", "pos").collect()
    assert [(r.payload_id, r.title, r.url) for r in rows] == [(1, "One & two", "u1"), (1, "Two", "u3"), (2, "A", "alt")]
    limited = payloads.parse_feeds(spark.createDataFrame([(1, rss)], "payload_id long, content string"), item_limit=1)
    assert limited.count() == 1


@pytest.mark.parametrize(
    ("raw", "market", "want"),
    [
        ("Mon, 1 Jan 2024 10:00:00 +0800", "us", dt.datetime(2024, 1, 1, 2)), ("2024-03-10 09:30:00", "us", dt.datetime(2024, 3, 10, 13, 30)), ("2024-01-10T09:30:00", "hk", dt.datetime(2024, 1, 10, 1, 30)), ("5分钟前", "cn", dt.datetime(2024, 1, 1, 11, 55)),
        ("昨天 09:00", "cn", dt.datetime(2023, 12, 31, 1)), ("21:30", "cn", dt.datetime(2024, 1, 1, 13, 30)), ("23:30", "cn", dt.datetime(2023, 12, 31, 15, 30)), ("刚刚", "cn", dt.datetime(2024, 1, 1, 12)), ("junk", "cn", None),
    ],
)
def test_feed_times(spark, raw, market, want):
    now = F.lit(dt.datetime(2024, 1, 1, 12)).cast("timestamp")
    assert one(spark, payloads.feed_time(F.lit(raw), F.lit(market), now)) == want


def test_json_payloads(spark):
    telegraph = '{"data":{"roll_data":[{"id":1,"title":"","brief":"b","content":"【Head】body","ctime":1704067200,"shareurl":"u","stock_list":[{"StockID":"x","name":"n"}]},{"id":2,"title":"T","content":"","brief":"short","ctime":0,"stock_list":[]}]}}'
    rows = payloads.parse_telegraph(spark.createDataFrame([(1, telegraph), (2, "{"), (3, None)], "payload_id long, content string")).orderBy("id").collect()
    assert [(r.title, r.body, r.has_stock_refs) for r in rows] == [("Head", "【Head】body", True), ("T", "short", False)]
    flows = payloads.parse_flow_lines(spark.createDataFrame([("a", '{"data":{"klines":["2024-01-02,1,2,-,4,5,6","bad","2024-13-01,1,2,3,4,5"]}}')], "symbol string, content string")).collect()
    assert len(flows) == 1 and flows[0].large_net is None and flows[0].main_net_pct == 6.0
    bars = payloads.parse_bar_lines(spark.createDataFrame([("a", '{"data":{"klines":["2024-01-02,1,2,3,x,5,6","2024-01-03,1,2,3,0.5,5,6"]}}')], "symbol string, content string")).collect()
    assert [(r.symbol, r.low) for r in bars] == [("A", 0.5)]


def test_relevance_order(spark):
    cases = {"台风 暴雨 原油 上涨": "chinese_market_phrase", "召回大使": None, "产品召回": "chinese_market_phrase", "演唱会 概念 涨停": "chinese_noise", "芯片概念 涨停": "concept_mover", "new camera update": "generic_tech", "CPI data": "macro_acronym", "8点1氪：新品": None}
    for title, want in cases.items():
        v = one(spark, rules.relevance(F.lit(title), F.lit(None).cast("string"), F.lit("美股 上涨" if title.startswith("8点") else None).cast("string")))
        assert v.reason == want, title
    gate = one(spark, rules.ingest_gate(F.lit(False), F.lit(False), rules.relevance(F.lit("芯片概念 涨停"), F.lit(None).cast("string"), F.lit(None).cast("string"))))
    assert tuple(gate) == (False, "weak_signal:concept_mover")


def test_sessions_and_quiet_hours(spark):
    at = lambda *a: F.lit(dt.datetime(*a)).cast("timestamp")
    assert one(spark, desk.market_open(F.lit("cn"), at(2024, 1, 2, 1, 20))) is True
    assert one(spark, desk.market_open(F.lit("cn"), at(2024, 1, 6, 2, 0))) is False
    assert one(spark, desk.market_open(F.lit("xx"), at(2024, 1, 2, 2, 0))) is True
    assert one(spark, desk.quiet(at(2024, 1, 1, 15, 0), 1320, 420)) is True and one(spark, desk.quiet(at(2024, 1, 1, 2, 0), 1320, 420)) is False


def test_transitions_and_states(spark):
    rows = quant.check_transitions(spark.createDataFrame([("discovered", "validating"), ("qualified", "discovered")], "state string, target string")).collect()
    assert [r.allowed for r in rows] == [True, False]
    assert one(spark, rules.propose_state(F.lit("A"), F.lit(1.0), F.lit(0.9), F.lit(0.9), F.lit(0.9))) == "validating"
    assert one(spark, quant.lots(F.lit(100000.0), F.lit(0.08), F.lit(13.0))) == 600


def test_page_parsers(spark):
    html = """<A class=x HREF='/a'><b>One</b> two</A><a href="/a">again</a><a href=/b>B</a><a href="/c"> </a>"""
    assert [tuple(x) for x in one(spark, payloads.anchors(F.lit(html)))] == [("/a", "One two"), ("/b", "B")]
    page = 'x = {"list": [{"id": 1, "t": [1, [2]]}, {"id": 2}], "y": []}'
    assert [x.id for x in one(spark, payloads.embedded_array(F.lit(page), '"list":', "struct<id:int>"))] == [1, 2]
    assert one(spark, payloads.embedded_array(F.lit("none"), '"list":', "struct<id:int>")) is None
    rows = spark.createDataFrame([(1, "中文".encode("gbk"), "text/html; charset=gbk"), (2, b'<meta charset="big5">' + "中".encode("big5"), None), (3, "é".encode(), "charset=nonsense"), (4, None, None)], "i int, b binary, h string")
    assert {r.i: r.t for r in rows.select("i", payloads.decode_page("b", "h").alias("t")).collect()} == {1: "中文", 2: '<meta charset="big5">中', 3: "é", 4: None}


@pytest.mark.parametrize(
    ("raw", "market", "want"),
    [
        ("1.5小时前", "cn", dt.datetime(2024, 1, 1, 10, 30)), ("2 个星期之前", None, dt.datetime(2023, 12, 18, 12)), ("发布于 前天 9时5分7秒", "hk", dt.datetime(2023, 12, 30, 1, 5, 7)), ("今天", "cn", dt.datetime(2023, 12, 31, 16)), ("昨天 25:00", "cn", None),
        ("2023年7月5日 10:00", "us", dt.datetime(2023, 7, 5, 14)), ("12-31 08:00", "cn", dt.datetime(2023, 12, 31)), ("1月2日", "cn", dt.datetime(2024, 1, 1, 16)), ("02-30", "cn", None), ("Just Now", "us", dt.datetime(2024, 1, 1, 12)), ("", "cn", None), (None, "cn", None),
    ],
)
def test_spoken_times(spark, raw, market, want):
    now = F.lit(dt.datetime(2024, 1, 1, 12)).cast("timestamp")
    assert one(spark, times.spoken_time(F.lit(raw).cast("string"), F.lit(market).cast("string"), now)) == want


def test_quiet_hours_end_and_bounds(spark):
    end = lambda s: one(spark, times.next_time_of_day(F.lit(s).cast("timestamp"), 7, 0, "Asia/Shanghai"))
    assert end("2024-01-01 22:00:00") == dt.datetime(2024, 1, 1, 23) and end("2024-01-01 23:00:00") == dt.datetime(2024, 1, 2, 23)
    assert [one(spark, times.clamp_days(F.lit(x).cast("int"))) for x in (None, 0, 5, 100)] == [30, 1, 5, 90]
    assert one(spark, times.hour_bucket(F.lit(None).cast("timestamp"))) == "unknown"


def test_symbol_spellings(spark):
    of = lambda s, m=None: one(spark, text.symbol_spellings(F.lit(s), F.lit(m).cast("string")))
    assert of(" sh600000") == ["SH600000", "600000.SH", "600000"] and of("000001.sz") == ["000001.SZ", "000001", "SZ000001"] and of("brk.b") == ["BRK.B"] and of("^x") == ["^X"]
    assert [one(spark, text.chart_symbol(F.lit(s))) for s in ("600000.SS", "000001.sz", "700.HK", "AAPL", None)] == ["sh600000", "sz000001", "hk00700", None, None]


def test_stored_keys_and_reviews(spark):
    from harborlight.operators import reviews

    rows = spark.createDataFrame([(1, "a", None), (2, None, None), (3, "b", "y"), (3, "b", "y"), (4, "x", None)], "id long, k string, v string")
    stored = spark.createDataFrame([("q", "y"), (None, "x"), ("a", None), ("a", None)], "k string, v string")
    assert {r.id: r.known for r in reviews.stored_already(rows, stored, "id", ["k", "v"]).collect()} == {1: True, 2: False, 3: True, 4: False}
    moves = [("discovered", "watch", "r"), ("watch", "qualified", "r"), ("watch", "qualified", " "), ("expired", "watch", "r"), ("validating", "expired", None)]
    df = spark.createDataFrame(moves, "a string, b string, r string")
    assert [r.x for r in df.select(reviews.may_follow(F.col("a"), F.col("b"), F.col("r")).alias("x")).collect()] == [False, True, False, False, False]
    assert [one(spark, reviews.retry_seconds(F.lit(n))) for n in (0, 1, 2, 9)] == [30, 30, 120, 1800]


def test_story_parts_fold_only_long_tails(spark):
    from harborlight.operators import reviews

    for n in (0, 3, 16, 17, 40):
        rows = spark.range(n).select("id", F.lit("p").alias("page"))
        got = [r.part for r in reviews.story_parts(rows, ["page"], [F.col("id")]).orderBy("id").collect()]
        stream = max(0, n - 4)
        cut = max(10, -(-stream * 7 // 10))
        folded = stream - cut if stream - cut >= 3 else 0
        assert got == (["lead"] + ["supporting"] * 3)[:n] + ["stream"] * (stream - folded) + ["folded"] * folded


def test_provider_payloads(spark):
    from harborlight.sources import providers

    board = '{"f12":"BK1","f14":"Steel","f2":"12.5","f3":"-","f104":"7","f105":3,"f106":null,"f62":1e6}'
    content = [f'{{"data":{{"diff":[{board},{{"f14":"no code"}}]}}}}', f'{{"data":{{"diff":{{"0":{board}}}}}}}', '{"data":null}', "junk", None]
    rows = providers.parse_boards(spark.createDataFrame(list(enumerate(content)), "payload_id long, content string")).collect()
    assert sorted(map(tuple, rows)) == [(i, "BK1", "Steel", 12.5, None, 7, 3, None, 1e6) for i in (0, 1)]
    facts = '{"result":{"data":[{"REPORT_DATE":"2023-12-31 00:00:00","NOTICE_DATE":"2024-03-01 00:00:00","SECURITY_CODE":"600000","EPS":1.5,"YOY":"25"},{"REPORT_DATE":"2023-09-30","EPS":null},{"EPS":3}]}}'
    found = providers.parse_facts(spark.createDataFrame([("a", facts), ("b", "{}"), ("c", None)], "symbol string, content string"), {"eps": "EPS", "net_profit_yoy": "YOY"}, ("net_profit_yoy",)).collect()
    assert sorted(map(tuple, found)) == [("A", dt.date(2023, 12, 31), k, v, dt.date(2024, 3, 1), "600000") for k, v in (("eps", 1.5), ("net_profit_yoy", 0.25))]


def test_embedded_arrays_at_any_depth(spark):
    page = 'x "list": [{"id": 1, "s": "a]b", "deep": [[[[[1]]]]]}, 5, {"id": 2}] y'
    assert [x and x.id for x in one(spark, payloads.embedded_array(F.lit(page), '"list":', "struct<id:int>"))] == [1, None, 2]
    assert one(spark, payloads.embedded_array(F.lit('"list": [1, '), '"list":', "struct<id:int>")) is None


def test_titles_and_links_of_payloads(spark):
    for body, want in [(None, None), ("", None), ("  ", None), ("【A b】 rest", "A b"), ("[x] rest", "[x] rest"), ("y" * 90, "y" * 60)]:
        assert one(spark, payloads.title_from_body(F.lit(body).cast("string"))) == want
    assert one(spark, payloads.absolute_url(F.lit("../a"), F.lit("https://h.example/b/c/d"))) == "https://h.example/b/a"
    assert one(spark, payloads.absolute_url(F.lit(None).cast("string"), F.lit("https://h.example/"))) is None
    assert one(spark, payloads.absolute_url(F.lit("http://[x"), F.lit("https://h.example/"))) == "http://[x"


def test_topic_functions(spark):
    words = lambda *w: F.array(*map(F.lit, w)).cast("array<string>")
    assert one(spark, topics.topic_name(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("array<string>"))) == topics.NO_TOPIC
    assert one(spark, topics.topic_name(F.lit("x-oil"), F.lit("t"), words(" AI ", "rate", "rates", "x"))) == "人工智能利率原油"
    assert one(spark, topics.first_alias(F.lit("x-oil"), words("zzz"))) == "原油"
    assert one(spark, topics.takeaway(F.lit("the quiet day"), F.lit(None).cast("string"), words())) == "quiet：出现市场相关进展，影响相关板块"
    assert one(spark, topics.takeaway(F.lit(""), F.lit(""), words("oil"))) == "原油：出现市场相关进展，影响原油相关标的"
    assert [one(spark, topics.horizon_seconds(F.lit(h))) for h in ("30m", "0d", "1w", " 2H")] == [1800, None, None, 7200]


def test_result_hash_is_canonical(spark):
    import hashlib

    text = '{"b":[1.5,2],"a":"\\u00e9"}'
    assert one(spark, records.result_hash(F.lit('{ "a": "é", "b": [1.50, 2] }'))) == hashlib.sha256(b'{"a":"\\u00e9","b":[1.5,2]}').hexdigest()
    assert one(spark, records.result_hash(F.lit(text))) != one(spark, records.result_hash(F.lit("{}")))
    assert one(spark, records.result_hash(F.lit(None).cast("string"))) is None


def test_fills_against_loop(spark):
    rng = random.Random(3)
    rows = []
    for account in range(60):
        items = [(f"P{i}", rng.choice([0.1, 0.3, 0.9]), rng.choice([None, 0.0, 3.3, 17.0, 999.0]), rng.choice([None, None, None, "limit_up_unfilled"])) for i in range(rng.randrange(6))]
        rows.append((account, float(rng.randrange(100000)), items))
    df = spark.createDataFrame(rows, "account long, cash double, items array<struct<symbol:string,weight:double,price:double,reject_reason:string>>")
    got = {x.account: [tuple(o) for o in x.orders] for x in df.select("account", records.proposal_fills(F.col("items"), F.col("cash")).alias("orders")).collect()}
    for account, cash, items in rows:
        want = []
        for symbol, weight, price, reason in items:
            shares = 0
            if reason is None and not price:
                reason = "no_market_data"
            if reason is None:
                shares = int(cash * weight / price // 100) * 100
                reason, shares = ("below_min_lot", 0) if shares < 100 else (None, shares)
            cash -= shares * price if reason is None else 0
            want.append((symbol, shares, price if reason is None else None, reason))
        assert got[account] == want


def test_backfill_resumes(spark, tmp_path):
    done, bars = str(tmp_path / "done"), str(tmp_path / "bars")
    wanted = spark.createDataFrame([("007",), ("B",), ("C",), ("B",)], "symbol string")
    fetched = lambda *rows: spark.createDataFrame(rows, "day int, close double, symbol string")
    records.backfill(wanted, done, fetched((1, 1.0, "007"), (2, 2.0, "007"), (1, 5.0, "X")), bars)
    assert [x.symbol for x in spark.read.parquet(done).collect()] == ["007"]
    records.backfill(wanted, done, fetched((1, 9.0, "007"), (1, 3.0, "B")), bars)
    read = spark.read.schema("day int, close double, symbol string").parquet(bars)
    assert sorted(map(tuple, read.collect())) == [(1, 1.0, "007"), (1, 3.0, "B"), (2, 2.0, "007")]
    assert sorted(x.symbol for x in spark.read.parquet(done).collect()) == ["007", "B"]
    records.backfill(wanted, done, fetched(), bars)
    assert read.count() == 3


def test_sample_files(spark, tmp_path):
    path, csv = str(tmp_path / "s"), str(tmp_path / "c")
    rows = spark.createDataFrame([(1, 'a "q",\nb', None), (2, None, "x")], "sample_id long, title string, label string")
    runs.write_samples(rows, path)
    got = runs.read_samples(spark, path, "sample_id long, title string, label string", ["title", "label"]).orderBy("sample_id").collect()
    assert [tuple(r) for r in got] == [(1, 'a "q",\nb', None, "label"), (2, None, "x", "title")]
    lines = spark.createDataFrame([("{oops",), ("",), ("{}",)], "line string")
    assert sorted(r.problem for r in runs.parsed_samples(lines, "sample_id long", ["sample_id"]).collect()) == ["malformed", "sample_id"]
    runs.write_review_queue(rows, csv)
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(csv).orderBy("sample_id").collect()
    assert [tuple(r) for r in back] == [("1", 'a "q",\nb', None), ("2", None, "x")]


def test_runs_are_whole_after_a_retry(spark, tmp_path):
    path = str(tmp_path / "runs")
    df = lambda run, *values: spark.createDataFrame([(run, v) for v in values], "run_id long, v string")
    for run, items in ((1, "ab"), (2, "c"), (1, "abd")):
        runs.persist_run(df(run, "r"), df(run, *items), df(run, "s", "t"), path)
    read = lambda name: sorted((r.run_id, r.v) for r in spark.read.parquet(f"{path}/{name}").collect())
    assert read("runs") == [(1, "r"), (2, "r")] and read("items") == [(1, "a"), (1, "b"), (1, "d"), (2, "c")] and len(read("stages")) == 4


def test_batch_quotes_and_pending(spark):
    frames = spark.createDataFrame([('{"day":"2024-01-02","close":{"A":2.0,"B":null}}',), ('{"day":"2024-01-01","close":{"A":1.0,"B":0.0}}',), ('{"day":"2024-01-02","close":{"A":2.0}}',), ("oops",), (None,)], "payload string")
    assert sorted((r.symbol, str(r.day), r.price, r.previous_close, r.change_percent) for r in runs.batch_quotes(frames).collect()) == [("A", "2024-01-02", 2.0, 1.0, 100.0), ("B", "2024-01-01", 0.0, None, None)]
    rows = spark.createDataFrame([(1, None, ts(5)), (2, None, None), (3, "done", ts(9)), (4, None, ts(7))], "id long, status string, at timestamp")
    assert [r.id for r in runs.pending(rows, "status", "at", "id").collect()] == [4, 1, 2]
    assert [r.id for r in runs.pending(rows, "status", "at", "id", 1).collect()] == [4]
