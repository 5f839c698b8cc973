"""Operators 11 to 13 against loops, SQL and defined edge cases."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from harborlight.llm import queries, source_divergence, source_mixing, whitening

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["op11_source_mixing", "op13_source_divergence"])
def test_against_sql(spark, db, name):
    df = queries.QUERIES[name](spark, SF)
    rel = db.sql(queries.ORACLE_SQL[name])
    assert sorted(rel.columns) == sorted(df.columns)
    assert sorted(map(tuple, df.collect())) == sorted(rel.select(", ".join(df.columns)).fetchall())


# 11 source mixing


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """Targets by source, reshared one round after the other in exact fractions."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left, units = total - sum(most * sizes[s] for s in capped), sum(weight[s] for s in free)
        share = {s: Fraction(left * weight[s], units) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return {s: float(share.get(s, most * sizes[s])) for s in order}
        capped |= over


def mixed_rows(seed, n=600):
    rng = random.Random(seed)
    names = [None, "", "a", "b", "é", "z", "hot", "日", "tiny"]
    rows = []
    for i in range(n):
        source = "hot" if rng.random() < 0.4 else rng.choice(names)
        size = 3 if source == "tiny" else int(rng.paretovariate(0.9) * 4) % 3000
        text = None if rng.random() < 0.02 else " \n".join(["é"] * size)
        rows.append((i, text, "en", source, 0))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix_against_loop(spark, seed):
    rows = mixed_rows(seed)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows}
    source = {i: s for i, _, _, s, _ in rows}
    totals = Counter()
    for i in size:
        totals[source[i]] += size[i]
    got = source_mixing.mix(spark.createDataFrame(rows, DOC)).collect()
    wanted = brute_targets(totals)
    assert sorted(r.doc_id for r in got) == sorted(size)
    taken, inside = Counter(), defaultdict(list)
    for r in got:
        s, target = source[r.doc_id], wanted[source[r.doc_id]]
        assert r.size == size[r.doc_id] and r.source_size == totals[s] and r.target == pytest.approx(target, rel=1e-12)
        certain = int(target / totals[s] + 1e-12) if totals[s] else 0
        assert r.taken == r.copies * r.size and (r.copies in (certain, certain + 1) or not r.size) and r.copies <= 3
        taken[s] += r.taken
        if r.size and r.odds_rank is not None:
            inside[s, r.size.bit_length()].append((r.odds_rank, r.copies > certain))
    for s, target in wanted.items():
        sizes = sorted(size[i] for i in size if source[i] == s and size[i])
        # Whole documents cannot come nearer where one is longer than all others together can make good.
        near = max(3, 2 * sum(sizes[:10]) / len(sizes[:10])) if sizes and totals[s] - sizes[-1] >= target % totals[s] else max(sizes, default=0) / 2
        assert abs(taken[s] - target) <= near, s
    for ranks in inside.values():  # the first ranks of a stratum are taken, but for ranks of one cell
        chosen, left = [r for r, c in ranks if c], [r for r, c in ranks if not c]
        assert not chosen or not left or max(chosen) <= min(left) * 1.01
    assert sorted(map(tuple, got)) == sorted(map(tuple, source_mixing.mix(spark.createDataFrame(rows[::-1], DOC).repartition(7)).collect()))


def test_mix_keeps_inclusion_odds(spark):
    """Over many seeds, a document's mean copies are its source's target / size, for long and short ones alike."""
    rng = random.Random(5)
    rows = [(i, " ".join("w" * rng.choice([2, 3, 40, 400])), "en", "ab"[i % 2], 0) for i in range(120)]
    docs = spark.createDataFrame(rows, DOC).cache()
    mean, n = defaultdict(float), 12
    for seed in range(n):
        for r in source_mixing.mix(docs, weights=(5, 3), seed=seed).select("doc_id", "size", "copies", (F.col("target") / F.col("source_size")).alias("ratio")).collect():
            mean[r.size, round(r.ratio, 9)] += r.copies / n
    count = Counter((len(t.split()), i % 2) for i, t, *_ in rows)
    for (size, ratio), copies in mean.items():
        # The shortest documents make good what longer ones miss, so that theirs vary from seed to seed.
        assert copies / count[size, 0 if ratio > 1 else 1] == pytest.approx(ratio, abs=0.1 if size >= 40 else 0.25)


def test_mix_edges(spark):
    assert source_mixing.mix(spark.createDataFrame([], DOC)).count() == 0
    empty = source_mixing.mix(spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, " \t", "en", "s", 0)], DOC)).collect()
    assert [(r.size, r.target, r.taken) for r in empty] == [(0, 0.0, 0)] * 3
    one = source_mixing.mix(spark.createDataFrame([(1, "a b", "en", "s", 0), (1, "a b", "en", "s", 0), (None, "c", "en", None, 0)], DOC).withColumns({"size": F.lit("x"), "Target": F.lit(1), "copies": F.lit(1)})).collect()
    assert Counter((r.doc_id, r.size, r.source_size) for r in one) == Counter({(1, 2, 4): 2, (None, 1, 1): 1})
    long = source_mixing.mix(spark.createDataFrame([(1, "w " * 400_000, "en", "a", 0), (2, "v " * 3, "en", "b", 0)], DOC)).collect()
    assert {(r.doc_id, r.size, r.taken) for r in long} == {(1, 400_000, 400_000), (2, 3, 9)}


# 12 embedding whitening


def brute_whitening(vectors, most=32):
    x = np.floor(64 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(0)
    centred = x - sums / n
    values, vecs = np.linalg.eigh(centred.T @ centred / n)
    values, vecs = values[::-1], vecs[:, ::-1]
    deviation = [sum((n * v - s) ** 2 for v, s in zip(row, sums.tolist(), strict=True)) for row in x.tolist()]
    return deviation, centred @ vecs[:, :most] / np.sqrt(values[:most]), values[:most] / values.sum()


@pytest.mark.parametrize("make", ["table", "small"])
def test_whitening_against_numpy(spark, make):
    if make == "table":
        df = spark.read.parquet(f"{SF}/embeddings.parquet")
        rows = [(r.vec_id, r.embedding) for r in df.orderBy("vec_id").collect()]
    else:
        rng = np.random.default_rng(3)
        rows = [(i, (rng.normal(size=5) @ np.diag([9, 4, 2, 1, 0.5]) + [100, -3, 0, 0, 7]).astype(np.float32).tolist()) for i in range(300)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    white = whitening.whiten(df)
    deviation, expect, explained = brute_whitening([v for _, v in rows])
    got = {r.vec_id: r for r in white.collect()}
    z = np.array([got[i].whitened for i, _ in rows])
    assert [got[i].deviation for i, _ in rows] == deviation and {r.n for r in got.values()} == {len(rows)}
    signs = np.sign((z * expect).sum(0))
    assert np.allclose(z * signs, expect, atol=1e-7) and np.allclose(got[rows[0][0]].explained, explained, rtol=1e-9)
    assert np.abs(z.T @ z / len(z) - np.eye(z.shape[1])).max() < 1e-9 and 0 <= got[rows[0][0]].identity_error < 1e-9
    long = whitening.by_component(white)
    assert long.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert long.count() == len(rows) * z.shape[1] and long.where("component = 1 and vec_id = 0").first().whitened == z[[i for i, _ in rows].index(0), 0]


def test_whitening_edges(spark):
    schema = "vec_id long, embedding array<float>, deviation string, n int"
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, []), (6, [1.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (None, [3.0, 2.5]), (9, [0.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], schema)
    got = whitening.whiten(df).collect()
    assert sorted((r.vec_id or 0) for r in got) == [0, 7, 7, 9] and all(r.n == 4 and len(r.whitened) == 2 for r in got)
    assert whitening.by_component(whitening.whiten(df.limit(0))).count() == 0
    flat = whitening.whiten(spark.createDataFrame([(1, [2.0, 2.0]), (2, [2.0, 2.0])], "vec_id long, embedding array<float>"))
    assert [(r.deviation, r.whitened, r.identity_error) for r in flat.collect()] == [(0, [], 0.0)] * 2 and whitening.by_component(flat).count() == 0
    huge = whitening.whiten(spark.createDataFrame([(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 5.0])], "vec_id long, embedding array<float>")).collect()
    assert len(huge) == 3 and all(len(r.whitened) >= 1 for r in huge) and any(r.deviation is None for r in huge)


# 13 source divergence


def brute_divergence(rows, least_docs, top=50):
    words = [(lang or "", source or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")))) for _, t, lang, source, _ in rows]
    docs, uses, out = Counter(), Counter(), []
    for lang, source, c in words:
        for t, k in c.items():
            docs[lang, t] += 1
            uses[lang, source, t] += k
    groups = {(lang, source) for lang, source, _ in words}
    for lang in {g[0] for g in groups}:
        kept = [t for (x, t), k in docs.items() if x == lang and k >= least_docs]
        own = sorted(s for x, s in groups if x == lang)
        p = {}
        for s in own:
            n = sum(uses[lang, s, t] for t in kept)
            p[s] = {t: 1 + 10**9 * (uses[lang, s, t] + 5) // (n + 5 * len(kept)) for t in kept}
        n = sum(uses[lang, s, t] for s in own for t in kept)
        q = {t: 1 + 10**9 * (sum(uses[lang, s, t] for s in own) + 5) // (n + 5 * len(kept)) for t in kept}
        for s in own:
            pairs = sorted(((sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in own if o != s), key=lambda x: (-x[0], x[1].encode()))
            terms = sorted(((p[s][t] - q[t], t) for t in kept if uses[lang, s, t] and p[s][t] > q[t]), key=lambda x: (-x[0], x[1].encode()))[:top]
            out += [(lang, s, part, item, value, k) for part, found in (("pair", pairs), ("term", terms)) for k, (value, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("tiles", [(256, 4096), (3, 7), (1, 1000)])
def test_divergence_against_loop(spark, monkeypatch, tiles):
    monkeypatch.setattr(source_divergence, "TILE_GROUPS", tiles[0])
    monkeypatch.setattr(source_divergence, "TILE_TERMS", tiles[1])
    rng = random.Random(8)
    vocabulary = [rng.choice(["a", "Bé", "日本", "x_y", "naïve", "Q"]) + "".join(rng.choices("abcD", k=3)) for _ in range(60)]
    rows = [(i, None if rng.random() < 0.03 else " ".join(rng.choices(vocabulary, k=rng.randrange(30))), rng.choice(["en", "de", None]), rng.choice([None, "", "s1", "s2", "é", "z", "hot", "hot", "hot"]), 0) for i in range(260)]
    rows += [(900, "alone in its language", "xx", "only", 0), (901, "", "yy", "e1", 0), (902, None, "yy", "e2", 0), rows[0], rows[0]]
    got = source_divergence.divergence(spark.createDataFrame(rows, DOC), least_docs=9)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute_divergence(rows, 9)


def test_divergence_edges(spark):
    assert source_divergence.divergence(spark.createDataFrame([], DOC)).count() == 0
    nothing = spark.createDataFrame([(1, "a b", "en", "s", 0), (2, None, "en", "t", 0)], DOC).withColumns({"term": F.lit(1), "value": F.lit("x")})
    assert sorted(map(tuple, source_divergence.divergence(nothing).collect())) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]
    assert source_divergence.shares(np.array([0, 10**14]), 10**15, 10**6).tolist() == [1 + 10**9 * 5 // (10**15 + 5 * 10**6), 1 + 10**9 * (10**14 + 5) // (10**15 + 5 * 10**6)]
    ties = [(i, "b a é " + "c " * 300_000 * (i == 0), "en", "st"[i % 2], 0) for i in range(40)]
    assert sorted(map(tuple, source_divergence.divergence(spark.createDataFrame(ties, DOC)).collect())) == brute_divergence(ties, 30)
