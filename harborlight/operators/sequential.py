"""Choices that depend on the order of rows: the near-duplicate gate, creation of topics, fusion of event cards.

In a loop over the rows, a row is kept unless an earlier *kept* row rules it out.  The gate decides each component
of alike titles in one pass.  Topics are settled in
rounds: a row that no open earlier row could rule out is kept, and what it rules out is dropped.  The first open
row is always settled, so the rounds end, and the result is that of the loop; there are as many rounds as the
longest chain of rows that each depend on the one before, a few where order and likeness have little to
do with each other.  Each round is a few joins on keys over the rows that are still open.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import hamming, simhash64, title_signature, title_tokens
from .records import merged_card
from .staging import staged

_BLOCKS, _WIDTH, _LONG = 5, 13, (1 << 64) - 1


def _near_hashes(hashes: DataFrame, duplicate: int) -> DataFrame:
    """Pairs (a, b) with a < b of distinct hashes at most ``duplicate`` < 4 bits apart.

    Such hashes agree in two of five blocks, so the join is on equal keys of 26 bits.
    """
    block = lambda i: F.shiftrightunsigned("hash", i * _WIDTH).bitwiseAND((1 << _WIDTH) - 1)
    keys = F.array(*(F.struct(F.lit(n).alias("n"), F.shiftleft(block(i), _WIDTH).bitwiseOR(block(j)).alias("v")) for n, (i, j) in enumerate(combinations(range(_BLOCKS), 2))))
    keyed = hashes.select("hash", F.explode(keys).alias("key"))
    pairs = keyed.alias("a").join(keyed.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.hash") < F.col("b.hash")))
    return pairs.where(hamming(F.col("a.hash"), F.col("b.hash")) <= duplicate).select(F.col("a.hash").alias("a"), F.col("b.hash").alias("b")).distinct()


def duplicate_gate(items: DataFrame, stored: DataFrame | None = None, minutes: int = 60, duplicate: int = 3) -> DataFrame:
    """id, kept and matched_id of each item, as if the items came one by one in order of id.

    An item is dropped if a stored row or an earlier kept item within ``minutes`` of it has its host and title, or
    a title of at least four tokens whose SimHash differs in at most ``duplicate`` bits.  ``matched_id`` is the first
    such row by id, one with the same host and title before others.  Items without a host or title are kept.
    ``items`` and ``stored`` have id, title, url and at, and no id in common; stored rows come before all items.

    Titles that look alike at whatever time, directly or through others, are one component.  Components are decided
    independently, each in one pass over its rows in order, with its kept rows by time bucket in memory: a title that
    comes back every hour for years is one pass too, not a round for each hour.
    """
    span = minutes * 60_000_000
    rows = items.select("id", "title", "url", "at", F.lit(False).alias("settled"))
    if stored is not None:
        rows = rows.unionByName(stored.select("id", "title", "url", "at", F.lit(True).alias("settled")))
    title = F.coalesce("title", F.lit(""))
    hash_ = F.when(F.size(title_tokens(title)) >= 4, simhash64(title))
    rows = rows.select("id", title_signature(F.col("title"), F.col("url")).alias("signature"), hash_.alias("hash"), F.unix_micros(F.col("at").cast("timestamp")).alias("t"), "settled")
    node = F.md5(F.concat_ws("\x1f", F.coalesce(F.concat(F.lit("s"), "signature"), F.lit("")), F.coalesce(F.col("hash").cast("string"), F.lit(""))))
    rows = staged(rows.withColumn("node", node), "gate-rows")
    near = _near_hashes(rows.select("hash").where("hash is not null").distinct(), duplicate)
    # A title has the keys of its own signature and hash, and those of the hashes near to it.
    nodes = rows.select("node", "signature", "hash").distinct()
    by_hash = nodes.where("hash is not null").select("node", F.col("hash").alias("key"), F.lit(False).alias("exact"))
    by_near = near.join(nodes.select("node", "hash"), F.col("a") == F.col("hash")).select("node", F.col("b").alias("key"), F.lit(False).alias("exact"))
    by_signature = nodes.where("signature is not null").select("node", F.xxhash64("signature").alias("key"), F.lit(True).alias("exact"))
    keys = staged(by_hash.union(by_near).union(by_signature).select(F.col("node").alias("id"), F.struct("exact", "key").alias("key")), "gate-keys")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    label = _components(keys.join(shared, "key"))
    rows = rows.join(label.withColumnRenamed("id", "node"), "node", "left").select("id", "signature", "hash", "t", "settled", F.coalesce("label", "node").alias("label"))
    ordered = rows.repartition("label").sortWithinPartitions("label", F.col("settled").desc(), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gate = _Gate(span, duplicate)
        for batch in batches:
            ids, matched = [], []
            for own, signature, hash_, t, settled, label in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                found = gate.take(label, own, signature, hash_, t, settled)
                if not settled:
                    ids.append(own)
                    matched.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(matched, batch.column(0).type)], ["id", "matched_id"])

    kind = dict(rows.dtypes)["id"]
    return ordered.mapInArrow(run, f"id {kind}, matched_id {kind}").select("id", F.col("matched_id").isNull().alias("kept"), "matched_id")


class _Gate:
    """The gate over rows in order, one component after the other: the kept rows of the present one by time bucket."""

    def __init__(self, span: int, duplicate: int) -> None:
        self.span, self.duplicate, self.label = span, duplicate, None
        self.kept: dict[int, list[tuple]] = {}

    def take(self, label: str, own: int, signature: str | None, hash_: int | None, t: int | None, settled: bool) -> int | None:
        """The row that rules this one out; if there is none, the row is kept."""
        if label != self.label:
            self.label, self.kept = label, {}
        if t is None:
            return None
        bucket, best = t // self.span, None
        if not settled and signature is not None:
            for near in (bucket - 1, bucket, bucket + 1):
                for by, by_signature, by_hash, by_t, before in self.kept.get(near, ()):
                    same = by_signature == signature
                    alike = same or hash_ is not None and by_hash is not None and ((hash_ ^ by_hash) & _LONG).bit_count() <= self.duplicate
                    if alike and abs(by_t - t) <= self.span:
                        best = min(x for x in (best, (not same, not before, by)) if x)
        if best is None:
            self.kept.setdefault(bucket, []).append((own, signature, hash_, t, settled))
        return best and best[2]


def create_topics(items: DataFrame, topics: DataFrame | None = None) -> DataFrame:
    """id, topic_id and created of each item, as if the items came one by one in order of id.

    An item joins the topic that has its key, else the lowest topic that shares at least min(2, its number of keywords)
    of its keywords, and creates one of its own id if there is none.  ``items`` have id, topic_key and keywords (distinct);
    ``topics`` have topic_id (lower than any item's id), topic_key and keywords.

    Two words of an item are one key, so that a topic rules out the later items of each of its pairs of words: no
    pair of items is formed, however common a word is.
    """
    words = F.array_sort(F.array_distinct(F.coalesce("keywords", F.array().cast("array<string>"))))
    rows = items.select("id", F.col("topic_key").alias("key"), words.alias("words"), F.lit(False).alias("known"))
    if topics is not None:
        rows = rows.union(topics.select("topic_id", "topic_key", words, F.lit(True)))
    pair = F.flatten(F.transform("words", lambda a, i: F.transform(F.slice("words", i + 2, F.size("words")), lambda b: F.concat(F.lit("p:"), a, F.lit("\x1f"), b))))
    single = F.transform("words", lambda a: F.concat(F.lit("w:"), a))
    exact = F.when(F.col("key").isNotNull(), F.array(F.concat(F.lit("k:"), "key"))).otherwise(F.array().cast("array<string>"))
    rows = rows.select("id", "known", exact.alias("exact"), F.concat(single, pair).alias("owns"), F.when(F.size("words") == 1, single).otherwise(pair).alias("asks"))
    # Items alike in all keys go the way of the first of them.
    first = F.md5(F.to_json(F.struct("exact", "owns")))
    rows = staged(rows.withColumn("alike", first), "topic-rows")
    heads = rows.where(~F.col("known")).groupBy("alike").agg(F.min("id").alias("id"))
    known = rows.where("known")
    open_ = staged(rows.where(~F.col("known")).join(heads, ["id", "alike"]).select("id", "exact", "owns", "asks"), "topic-open")
    keys = lambda df, column: df.select("id", F.explode(column).alias("key"))
    owned = lambda df: keys(df, F.concat("exact", "owns")).groupBy("key").agg(F.min("id").alias("owner"))

    def earlier(df: DataFrame, owners: DataFrame) -> DataFrame:
        """ids of ``df`` that ask for a key which an earlier row owns."""
        return keys(df, F.concat("exact", "asks")).join(owners, "key").where(F.col("owner") < F.col("id")).select("id").distinct()

    created = [known.select("id", "exact", "owns", "asks")]
    open_ = staged(open_.join(earlier(open_, owned(known)), "id", "left_anti"), "topic-open") if topics is not None else open_
    while not open_.isEmpty():
        safe = staged(open_.join(earlier(open_, owned(open_)), "id", "left_anti"), "topic-created")
        created.append(safe)
        open_ = open_.join(safe.select("id"), "id", "left_anti")
        open_ = staged(open_.join(earlier(open_, owned(safe)), "id", "left_anti"), "topic-open")
    all_ = created[0]
    for part in created[1:]:
        all_ = all_.union(part)
    owners = staged(keys(all_, F.concat("exact", "owns")).groupBy("key").agg(F.min("id").alias("owner")), "topic-owners")
    own = rows.where(~F.col("known"))
    asked = lambda column: keys(own, column).join(owners, "key").where(F.col("owner") <= F.col("id")).groupBy("id").agg(F.min("owner").alias(column))
    joined = own.select("id").join(asked("exact"), "id", "left").join(asked("asks"), "id", "left")
    # A row's own keys are owned by itself at most where it created the topic.
    topic = F.coalesce(F.when(F.col("exact") < F.col("id"), F.col("exact")), F.when(F.col("asks") < F.col("id"), F.col("asks")), F.col("id"))
    return joined.select("id", topic.alias("topic_id"), (topic == F.col("id")).alias("created"))


def _components(links: DataFrame) -> DataFrame:
    """id and the least id that it is linked to through shared keys (id, key), by rounds of least labels."""
    links = staged(links, "component-links")
    label = staged(links.groupBy("id").agg(F.min("id").alias("label")), "component-labels")
    while True:
        low = links.join(label, "id").groupBy("key").agg(F.min("label").alias("low"))
        new = staged(links.join(low, "key").groupBy("id").agg(F.min("low").alias("new")).join(label, "id"), "component-labels")
        if new.where("new < label").isEmpty():
            return label
        label = new.select("id", F.col("new").alias("label"))


def fusion_leaders(cards: DataFrame) -> DataFrame:
    """id, leader and place of each card: which card it is fused into, and as which one in turn (0: the leader itself).

    Cards are taken in order of ``id``: each one that is not fused yet takes in, one after the other, the later cards of
    its type that share its first symbol, two of its symbols or half of its title words; with each card its symbols grow
    (up to five), and it gets a first symbol if it has none.  ``cards`` have id, event_type, primary_symbol, symbols and
    words.  Cards of type general stay alone.  Cards without a common symbol or title word, directly or through others, are
    fused independently; such a component is one task's, with a row of some hundred bytes a card.
    """
    none = F.array().cast("array<string>")
    c = cards.select("id", "event_type", F.nullif("primary_symbol", F.lit("")).alias("first"), F.coalesce("symbols", none).alias("symbols"), F.coalesce("words", none).alias("words"))
    alone = c.where("event_type = 'general'").select("id", F.col("id").alias("leader"), F.lit(0).alias("place"))
    c = staged(c.where("event_type <> 'general'"), "fusion-cards")
    marks = F.concat(F.transform(F.array_compact(F.array_append("symbols", F.col("first"))), lambda s: F.concat(F.lit("s:"), s)), F.transform("words", lambda w: F.concat(F.lit("w:"), w)), F.array(F.concat(F.lit("i:"), F.col("id").cast("string"))))
    grouped = c.join(_components(c.select("id", F.explode(F.transform(marks, lambda m: F.concat(F.col("event_type"), F.lit("|"), m))).alias("key"))), "id")

    fused = grouped.groupBy("event_type", "label").applyInPandas(_fused, "id long, leader long, place int")
    return fused.union(alone)


def _fused(frame: pd.DataFrame) -> pd.DataFrame:
    """The fold over one component; candidates of a leader come from an index of symbols and words."""
    rows = sorted(zip(frame["id"].tolist(), frame["first"].tolist(), map(list, frame["symbols"]), map(set, frame["words"]), strict=True))
    index: dict[tuple[str, str], list[int]] = {}
    for k, (_, first, symbols, words) in enumerate(rows):
        for key in {*(("s", s) for s in symbols), *((("f", first),) if first else ()), *(("w", w) for w in words)}:
            index.setdefault(key, []).append(k)
    done, out = [False] * len(rows), []
    for i, (own, first, symbols, words) in enumerate(rows):
        if done[i]:
            continue
        symbols, place, at = list(symbols), 0, i
        out.append((own, own, 0))
        while True:
            # The next later card that fits; what was passed over stays passed over.
            keys = {*(("s", s) for s in symbols), *((("f", first),) if first else ()), *(("w", w) for w in words)}
            later = sorted({k for key in keys for k in index.get(key, ()) if k > at and not done[k]})
            fit = next((k for k in later if first and rows[k][1] == first or len(set(symbols) & set(rows[k][2])) >= 2 or 2 * len(words & rows[k][3]) >= len(words | rows[k][3]) > 0), None)
            if fit is None:
                break
            place, at, done[fit] = place + 1, fit, True
            out.append((rows[fit][0], own, place))
            symbols, first = list(dict.fromkeys(symbols + rows[fit][2]))[:5], first or rows[fit][1]
    return pd.DataFrame(out, columns=["id", "leader", "place"])


def fused_cards(cards: DataFrame, leaders: DataFrame, card: Column) -> DataFrame:
    """leader and card: each leader's card with the cards fused into it, one after the other; ``card`` is a struct as of merged_card."""
    members = cards.select("id", card.alias("card")).join(leaders, "id").groupBy("leader").agg(F.array_sort(F.collect_list(F.struct("place", "card"))).alias("m"))
    rest = F.transform(F.slice("m", 2, F.size("m")), lambda m: m["card"])
    return members.select("leader", F.aggregate(rest, F.col("m")[0]["card"], lambda card, more: merged_card(card, more)).alias("card"))
