"""Terms in texts and the inverted index, held against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from harborlight.operators import desk, mentions, runs, text_index


@pytest.mark.parametrize("most_bytes", [1 << 20, 60])
def test_contained_terms_against_loop(spark, most_bytes):
    rng = random.Random(3)
    alphabet = "ab茅台é 0"
    texts = [(i, *(rng.choice([None, "", "".join(rng.choices(alphabet, k=rng.randrange(40)))]) for _ in range(3))) for i in range(200)]
    terms = [(k, "".join(rng.choices(alphabet, k=rng.choice([1, 2, 3, 3, 4, 6])))) for k in range(60)] + [(60, ""), (61, "aab"), (62, "aab")]
    if most_bytes == 60:
        terms = [x for x in terms if len(x[1]) != 2 or x[0] < 10]
    got = mentions.contained_terms(spark.createDataFrame(texts, "id long, a string, b string, c string"), ["a", "b", "c"], spark.createDataFrame(terms, "term_id long, term string"), most_bytes)
    want = {(i, k, next(p for p, t in enumerate(row) if t and term in t)) for i, *row in texts for k, term in terms if term and any(t and term in t for t in row)}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_too_many_short_terms(spark):
    with pytest.raises(ValueError):
        mentions.contained_terms(spark.createDataFrame([(1, "a")], "id long, a string"), ["a"], spark.createDataFrame([(1, "ab"), (2, "cd")], "term_id long, term string"), 3)


def test_mentions_prefer_confidence_then_longer_names(spark):
    stocks = [(0, "600519.SH", "cn", "贵州茅台"), (1, "600519.sh", "", "茅台酒业"), (2, "000001.sz", "cn", "平安银行"), (3, "300750.SZ", "cn", "东方"), (4, "X.US", "us", "ab"), (5, None, None, None)]
    texts = [(1, "贵州茅台和茅台酒业", None, "600519"), (2, "", "平安银行", "000001"), (3, "东方 ab", "300750", ""), (4, None, None, None), (5, "600519 000001", "", "贵州茅台")]
    got = mentions.security_mentions(spark.createDataFrame(texts, "id long, title string, summary string, body string"), spark.createDataFrame(stocks, "position long, symbol string, market string, display_name string"))
    assert sorted((r.id, r.symbol, r.market, r.display_name, r.confidence, r.place) for r in got.collect()) == [
        (1, "600519.SH", "cn", "贵州茅台", 0.9, "title"), (2, "000001.SZ", "cn", "平安银行", 0.7, "summary"), (3, "300750.SZ", "cn", "300750", 0.75, "summary"),
        (5, "000001.SZ", "cn", "000001", 0.95, "title"), (5, "600519.SH", "cn", "600519", 0.95, "title"),
    ]


def test_index_reads_only_the_folders_of_its_words(spark, tmp_path):
    rng, path = random.Random(5), str(tmp_path / "index")
    words = [f"w{k}" for k in range(200)]
    rows = [(i, " ".join(["The", *rng.choices(words, k=6)]), None if i % 5 else "Extra, word-" + str(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, title string, summary string")
    for batch in range(3):
        text_index.add_batch(df.where(F.col("id") % 3 == batch), path, batch, ["title", "summary"], files=2)
    text_index.add_batch(df.where("id % 3 = 2"), path, 2, ["title", "summary"], files=2)  # a batch comes again
    sets = {i: set((t + " " + (s or "")).lower().replace(",", " ").replace("-", " ").split()) for i, t, s in rows}
    for query in (["the"], ["w7", "the"], ["W7", "w9"], ["extra", "the", "w3"], ["none", "the"], ["word"], []):
        got = sorted(r.id for r in text_index.search(spark, path, query).collect())
        assert got == sorted(i for i, w in sets.items() if query and {q.lower() for q in query} <= w), query
    plan = text_index.postings(spark, path, ["w7", "w9"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(word" in plan
    files = text_index.postings(spark, path, ["w7"]).select(F.input_file_name().alias("f")).distinct().collect()
    assert len({r.f.split("/bucket=")[1].split("/")[0] for r in files}) == 1
    assert sorted(r.id for r in text_index.search_or_phrase(df, path, ["xtra,", "word-1"], ["title", "summary"]).collect()) == [i for i, _, s in rows if s and "xtra, word-1" in s.lower()]


def test_search_has_nine_tiers(spark):
    names = [("600519.SH", "red", "gzmt"), ("C1.SZ", "x", None), ("Z9.SZ", "c1", ""), ("A0.SZ", "y", "c1"), ("C12.SZ", "", ""), ("A2.SZ", "C1 b", ""), ("A3.SZ", "z", "c1x"), ("AC1.SZ", "", ""), ("A4.SZ", "ac1", ""), ("A5.SZ", "", "ac1")]
    df = spark.createDataFrame(names, "symbol string, name string, pinyin string")
    assert [(r.symbol, r.score) for r in desk.search_tiers(df, " C1 ").collect()] == [("C1.SZ", 100), ("Z9.SZ", 95), ("A0.SZ", 90), ("C12.SZ", 85), ("A2.SZ", 80), ("A3.SZ", 75), ("AC1.SZ", 65), ("A4.SZ", 60), ("A5.SZ", 55)]
    assert [r.symbol for r in desk.search_tiers(df, "0519").collect()] == ["600519.SH"] and desk.search_tiers(df, " ").count() == 0
    assert [r.score for r in desk.search_tiers(df.drop("pinyin"), "c1", 2).collect()] == [100, 95]


def test_positions_against_sort(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([None, "a", "a", "b"]), None if rng.random() < 0.1 else f"2024-01-0{rng.randrange(1, 5)} 0{rng.randrange(3)}:00:00") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, source string, at string").withColumn("at", F.col("at").cast("timestamp"))
    got = {r.id: r.pos for r in runs.positions(df, "source", "at", "id").collect()}
    for source in (None, "a", "b"):
        own = sorted((r for r in rows if r[1] == source), key=lambda r: (r[2] is not None, r[2] or "", r[0]), reverse=True)
        assert [got[r[0]] for r in own] == list(range(1, len(own) + 1))
