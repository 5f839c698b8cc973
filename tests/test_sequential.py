"""Choices in order of rows, held against loops; the gate over a stream."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from harborlight.functions import text
from harborlight.operators import news, sequential
from harborlight.streaming import queries

START = dt.datetime(2024, 1, 1)


def alike_rows(spark, titles):
    """Title pairs that look alike by the column function."""
    df = spark.createDataFrame([(t,) for t in sorted(set(titles))], "t string")
    both = df.select(F.col("t").alias("a")).crossJoin(df.select(F.col("t").alias("b")))
    return {(r.a, r.b) for r in both.where(text.titles_alike(F.col("a"), F.col("b"))).collect()}


def signature(title, host):
    import re

    words = re.sub(r"[^\w]+", " ", (title or "").lower()).strip()
    return f"{host}|{words}" if words else None


def headlines(seed, n):
    rng = random.Random(seed)
    base = [" ".join(rng.choices("alpha beta gamma delta rise fall profit chip".split(), k=rng.choice([2, 5, 30]))) for _ in range(8)]
    rows = []
    for i in range(n):
        t = rng.choice(base)
        if rng.random() < 0.3 and len(t.split()) > 20:  # one word of many changed: near, not equal
            w = t.split()
            w[rng.randrange(len(w))] = rng.choice("sun moon".split())
            t = " ".join(w)
        t = rng.choice([t, t.upper(), t + "!", t]) if rng.random() < 0.9 else rng.choice([None, "", "..."])
        rows.append((i * 3 % n if seed % 2 else i, t, f"http://{rng.choice('xy')}.org", START + dt.timedelta(minutes=rng.randrange(400))))
    return rows


def gate_loop(rows, alike, stored=()):
    kept, out = list(stored), {}
    for i, title, url, at in sorted(rows):
        host = url.split("//")[1]
        sig = signature(title, host)
        near = [k for k in kept if sig and abs(k[3] - at) <= dt.timedelta(minutes=60)]
        match = next((k[0] for k in near if signature(k[1], k[2].split("//")[1]) == sig), None)
        if match is None:
            match = next((k[0] for k in near if k[1] and (k[1], title) in alike), None)
        out[i] = match
        if match is None:
            kept.append((i, title, url, at))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_gate_against_loop(spark, seed):
    rows = headlines(seed, 150)
    assert len({r[0] for r in rows}) in (50, 150)
    rows = list({r[0]: r for r in rows}.values())
    schema = "id long, title string, url string, at timestamp"
    alike = alike_rows(spark, [r[1] for r in rows if r[1]])
    got = {r.id: r.matched_id for r in sequential.duplicate_gate(spark.createDataFrame(rows, schema)).collect()}
    want = gate_loop(rows, alike)
    assert got == want and any(want.values())
    # What was stored before comes first, whatever its ids are.
    stored = sorted((10_000 + r[0], *r[1:]) for r in headlines(seed + 7, 30) if r[1])
    got = {r.id: r.matched_id for r in sequential.duplicate_gate(spark.createDataFrame(rows, schema), spark.createDataFrame(stored, schema)).collect()}
    assert got == gate_loop(rows, alike_rows(spark, [r[1] for r in rows + stored if r[1]]), stored)


def test_gate_later_items_match_only_kept_ones(spark):
    a = "one two three four five six"
    rows = [(i, a, "http://x.org", START + dt.timedelta(minutes=40 * i)) for i in range(7)]
    df = spark.createDataFrame(rows, "id long, title string, url string, at timestamp")
    got = {r.id: r.matched_id for r in sequential.duplicate_gate(df).collect()}
    assert got == {0: None, 1: 0, 2: None, 3: 2, 4: None, 5: 4, 6: None}  # 2 is within an hour of 1, which was dropped
    assert sequential.duplicate_gate(df.limit(0)).count() == 0
    many = spark.range(3000).select("id", F.lit(a).alias("title"), F.lit("http://x.org").alias("url"), F.lit(START).alias("at"))
    assert sequential.duplicate_gate(many).where("matched_id = 0").count() == 2999


def test_gate_over_a_stream(spark, tmp_path):
    a, b = "alpha beta gamma delta epsilon", "quite another headline about things"
    rows = [(1, a, 0), (2, b, 0), (3, a, 50), (4, a, 70), (5, b, 59), (6, a, 115), (7, a, 131), (8, b, 61)]
    rows = [(i, t, START + dt.timedelta(minutes=m)) for i, t, m in rows]
    schema, path, out = "news_id long, title string, effective_at timestamp", str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(0, 8, 2):
        spark.createDataFrame(rows[i : i + 2], schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)

    def run():
        q = stream.writeStream.foreachBatch(queries.near_title_sink(out, out)).option("checkpointLocation", str(tmp_path / "ck")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return sorted(r.news_id for r in spark.read.parquet(out).collect())

    assert run() == [1, 2, 4, 7, 8]  # 3 and 5 repeat items of earlier batches; 4 is near 3 alone, which was dropped
    queries.near_title_sink(out, out)(spark.createDataFrame(rows[4:6], schema), 2)  # a batch comes again
    assert sorted(r.news_id for r in spark.read.parquet(out).collect()) == [1, 2, 4, 7, 8]


def topics_loop(items, topics=()):
    known, out = sorted(topics), {}
    for i, key, words in sorted(items):
        match = next((t for t, k, _ in known if k is not None and k == key), None)
        if match is None and words:
            match = next((t for t, _, w in known if len(set(w) & set(words)) >= min(2, len(words))), None)
        if match is None:
            known.append((i, key, words))
        out[i] = (i if match is None else match, match is None)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_topics_against_loop(spark, seed):
    rng = random.Random(seed)
    make = lambda i: (i, rng.choice([None, "k1", "k2", *(f"r{rng.randrange(40)}" for _ in range(5))]), rng.sample("abcdefghijklmnop"[: rng.choice([6, 16])], rng.randrange(5)))
    items, topics = [make(100 + i) for i in range(120)], [make(i) for i in range(5)]
    schema = "id long, topic_key string, keywords array<string>"
    got = {r.id: (r.topic_id, r.created) for r in sequential.create_topics(spark.createDataFrame(items, schema)).collect()}
    assert got == topics_loop(items)
    known = spark.createDataFrame(topics, schema.replace("id", "topic_id", 1))
    got = {r.id: (r.topic_id, r.created) for r in sequential.create_topics(spark.createDataFrame(items, schema), known).collect()}
    assert got == topics_loop(items, topics)
    assert sequential.create_topics(spark.createDataFrame([], schema)).count() == 0


def fusion_loop(cards):
    cards, out, done = sorted(cards), {}, set()
    for i, (own, kind, first, symbols, words) in enumerate(cards):
        if i in done:
            continue
        out[own] = (own, 0)
        place = 0
        for j in range(i + 1, len(cards)) if kind != "general" else ():
            c = cards[j]
            if j in done or c[1] != kind:
                continue
            union = set(words) | set(c[4])
            if first and first == c[2] or len(set(symbols) & set(c[3])) >= 2 or words and c[4] and len(set(words) & set(c[4])) / len(union) >= 0.5:
                done.add(j)
                place += 1
                out[c[0]] = (own, place)
                symbols, first = list(dict.fromkeys(symbols + c[3]))[:5], first or c[2]
    return out


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_fusion_against_loop(spark, seed):
    rng = random.Random(seed)
    cards = [(i, rng.choice(["macro", "earnings", "general"]), rng.choice([None, "", *(f"S{rng.randrange(9)}" for _ in range(2))]), [f"S{x}" for x in rng.sample(range(12), rng.randrange(5))], rng.sample("abcdefghijkl", rng.randrange(5))) for i in range(90)]
    df = spark.createDataFrame(cards, "id long, event_type string, primary_symbol string, symbols array<string>, words array<string>")
    got = {r.id: (r.leader, r.place) for r in sequential.fusion_leaders(df).collect()}
    want = fusion_loop(cards)
    assert got == want and any(p for _, p in want.values())
    assert sequential.fusion_leaders(df.limit(0)).count() == 0


def test_the_gate_takes_no_round_for_each_hour(spark, monkeypatch):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, "alpha beta gamma delta", "http://a", start + dt.timedelta(minutes=40 * i)) for i in range(200)]
    steps, staged = [], sequential.staged
    monkeypatch.setattr(sequential, "staged", lambda df, name: steps.append(name) or staged(df, name))
    got = {r.id: r.matched_id for r in sequential.duplicate_gate(spark.createDataFrame(rows, "id long, title string, url string, at timestamp")).collect()}
    assert got == {i: i - 1 if i % 2 else None for i in range(200)} and len(steps) < 15


def test_near_titles_against_pairs(spark):
    rows = headlines(2, 120)
    alike = alike_rows(spark, [r[1] for r in rows if r[1]])
    df = spark.createDataFrame([(i, t, at) for i, t, _, at in rows], "news_id long, title string, effective_at timestamp")
    got = [(r.a, r.b) for r in news.near_titles(df).where("duplicate").collect()]
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and abs(a[3] - b[3]) <= dt.timedelta(minutes=60) and (a[1], b[1]) in alike}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_near_title_links_count_the_pairs_without_forming_them(spark):
    rows = headlines(2, 120)
    start = rows[0][3]
    copies = [(1000 + i, f"one same headline with number {7 + i % 2}", None, start + dt.timedelta(seconds=11 * i)) for i in range(900)]
    df = spark.createDataFrame([(i, t, at) for i, t, _, at in rows + copies], "news_id long, title string, effective_at timestamp")
    got = news.near_title_links(df).collect()
    want = {}
    kinds = {r.news_id: r.class_id for r in got}
    assert set(kinds) == {r.news_id for r in got if r.class_id == r.with_class} and len(got) < 5 * len(kinds)
    for r in news.near_titles(df).collect():
        for a, b in ((r.a, r.b), (r.b, r.a)):
            key = (a, kinds[b], r.distance, r.contradict, r.duplicate)
            want[key] = want.get(key, 0) + 1
    assert {(r.news_id, r.with_class, r.distance, r.contradict, r.duplicate): r.n_links for r in got if r.n_links} == want
    assert sum(want.values()) > 100_000 and news.near_title_links(df.limit(0)).count() == 0


def test_near_title_links_broadcast_no_side(spark, monkeypatch):
    plans, staged = [], news.staged
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(news, "staged", lambda df, name: plan(df) or staged(df, name))
    df = spark.createDataFrame([(i, t, at) for i, t, _, at in headlines(2, 20)], "news_id long, title string, effective_at timestamp")
    plan(news.near_title_links(df))
    plan(news.near_titles(df))
    assert len(plans) == 7 and sum(p.count("SortMergeJoin") for p in plans) > 8 and not any("Broadcast" in p for p in plans)
