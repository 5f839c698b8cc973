"""Names and codes of a dictionary inside texts, as substrings: an automaton over all terms, or rare trigrams where there are too many."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of terms up to which their automaton goes to the tasks; it takes some fifty times as much memory there.
MOST_TERM_BYTES = 4 << 20
# Names too ambiguous to be looked for.
STOP_NAMES = "国安 华夏 东方 中国 科技 控股 集团 股份".split()
# Confidence of a name and of a code by where it stands.
NAME_CONFIDENCE = {"title": 0.9, "summary": 0.7, "body": 0.55}
CODE_CONFIDENCE = {"title": 0.95, "summary": 0.75, "body": 0.6}
_built: dict[str, object] = {}


def _automaton(key: str, terms: list[tuple[int, str]]) -> object:
    """The automaton of the terms; a worker keeps the last one."""
    import ahocorasick

    if key not in _built:
        _built.clear()
        found = ahocorasick.Automaton()
        owners: dict[str, list[int]] = {}
        for number, term in terms:
            owners.setdefault(term, []).append(number)
        for term, numbers in owners.items():
            found.add_word(term, numbers)
        found.make_automaton()
        _built[key] = found
    return _built[key]


def contained_terms(texts: DataFrame, columns: list[str], terms: DataFrame, most_bytes: int = MOST_TERM_BYTES) -> DataFrame:
    """id, term_id and place: each term that is a substring of one of the text ``columns``, with the first such column's number.

    ``texts`` has id (long); ``terms`` has term_id (long) and term.  Up to ``most_bytes`` of terms, one pass of an
    automaton over each text finds them all.  A larger dictionary is joined: each term of three characters or more by its
    trigram that the fewest texts have, and what these texts are is then compared.  Empty terms and texts have no matches;
    shorter terms of a larger dictionary are looked for by the automaton, if they fit.
    """
    spark = texts.sparkSession
    texts = texts.select(F.col("id").cast("long").alias("id"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"t{i}") for i, c in enumerate(columns)))
    terms = terms.select(F.col("term_id").cast("long").alias("term_id"), "term").where("term <> ''")
    size = terms.agg(F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()[0]
    if size <= most_bytes:
        return _by_automaton(texts, len(columns), terms)
    short = terms.where(F.length("term") < 3)
    if short.agg(F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()[0] > most_bytes:
        raise ValueError("too many terms of one or two characters")
    long = _by_trigrams(spark, texts, len(columns), terms.where(F.length("term") >= 3))
    return long.union(_by_automaton(texts, len(columns), short))


def _by_automaton(texts: DataFrame, n: int, terms: DataFrame) -> DataFrame:
    known, key = texts.sparkSession.sparkContext.broadcast([(r.term_id, r.term) for r in terms.collect()]), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(key, known.value) if known.value else None
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            ids = batch.column(0).to_pylist()
            seen: list[set] = [set() for _ in ids]
            for place in range(n if automaton else 0):
                for own, had, text in zip(ids, seen, batch.column(place + 1), strict=True):
                    fresh = {number for _, numbers in automaton.iter(text.as_py()) for number in numbers} - had
                    had |= fresh
                    out[0].extend([own] * len(fresh))
                    out[1].extend(fresh)
                    out[2].extend([place] * len(fresh))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32())], ["id", "term_id", "place"])

    return texts.mapInArrow(run, "id long, term_id long, place int")


def _by_trigrams(spark, texts: DataFrame, n: int, terms: DataFrame) -> DataFrame:
    def grams(text: Column) -> Column:
        starts = F.when(F.length(text) >= 3, F.sequence(F.lit(1), F.length(text) - 2)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(3))))

    mine = terms.select("term_id", "term", F.explode(grams(F.col("term"))).alias("gram"))
    wanted = mine.select("gram").distinct()
    held = texts.select("id", F.explode(F.array_distinct(F.flatten(F.array(*(grams(F.col(f"t{i}")) for i in range(n)))))).alias("gram")).join(wanted, "gram")
    counts = held.groupBy("gram").agg(F.count("*").alias("k"))
    key = mine.join(counts, "gram", "left").groupBy("term_id", "term").agg(F.min_by("gram", F.struct(F.coalesce("k", F.lit(0)), "gram")).alias("gram"))
    pairs = held.join(key, "gram").join(texts, "id")
    first = F.coalesce(*(F.when(F.contains(F.col(f"t{i}"), F.col("term")), F.lit(i)) for i in range(n)))
    return pairs.withColumn("place", first).where("place is not null").select("id", "term_id", F.col("place").cast("int").alias("place"))


def security_mentions(texts: DataFrame, stocks: DataFrame, **limits) -> DataFrame:
    """id, symbol, market, display_name, confidence and place of each security that a text names or gives the code of.

    ``texts`` has id, title, summary and body; ``stocks`` has position, symbol, market and display_name.  A name of three
    characters or more counts by the first of title, summary and body that holds it, a code of six digits likewise with
    more confidence.  Of several hits for a symbol the one of most confidence is given; of equal ones the longer
    name, the earlier position, a name before a code.
    """
    name, digits = F.trim(F.coalesce("display_name", F.lit(""))), F.substring_index(F.upper("symbol"), ".", 1)
    stock = stocks.select("position", F.upper("symbol").alias("symbol"), F.coalesce(F.nullif("market", F.lit("")), F.lit("cn")).alias("market"), name.alias("name"), digits.alias("digits"))
    names = stock.where((F.length("name") >= 3) & ~F.col("name").isin(STOP_NAMES)).select("symbol", "market", F.col("name").alias("term"), F.lit(0).alias("kind"), (-F.length("name")).alias("size"), "position")
    codes = stock.where(F.col("digits").rlike(r"^\d{6}$")).groupBy("digits").agg(F.max_by(F.struct("symbol", "market", "position"), "position").alias("s"))  # the last one has the code
    codes = codes.select("s.symbol", "s.market", F.col("digits").alias("term"), F.lit(1).alias("kind"), F.lit(0).alias("size"), "s.position")
    rules = names.union(codes).withColumn("term_id", F.col("position") * 2 + F.col("kind"))
    hits = contained_terms(texts, ["title", "summary", "body"], rules, **limits).join(rules, "term_id")
    pick = lambda table: F.element_at(F.array(*map(F.lit, table.values())), F.col("place") + 1)
    hits = hits.withColumn("confidence", F.when(F.col("kind") == 0, pick(NAME_CONFIDENCE)).otherwise(pick(CODE_CONFIDENCE)))
    best = hits.groupBy("id", "symbol").agg(F.min_by(F.struct("market", F.col("term").alias("display_name"), "confidence", "place"), F.struct(-F.col("confidence"), "kind", "size", "position")).alias("b"))
    return best.select("id", "symbol", "b.market", "b.display_name", "b.confidence", F.element_at(F.array(*map(F.lit, NAME_CONFIDENCE)), F.col("b.place") + 1).alias("place"))


def watchlist_hits(news: DataFrame, items: DataFrame, **limits) -> DataFrame:
    """id, symbol and display_name of the first watched security, in list order, whose code or name the title and summary hold.

    ``news`` has id, title and summary; ``items`` has position, symbol and display_name.
    """
    text = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("summary", F.lit(""))))
    root, name = F.lower(F.substring_index("symbol", ".", 1)), F.lower(F.coalesce("display_name", F.lit("")))
    terms = items.select(F.col("position").alias("term_id"), F.explode(F.array(root, name)).alias("term"))
    first = contained_terms(news.select("id", text.alias("text")), ["text"], terms, **limits).groupBy("id").agg(F.min("term_id").alias("position"))
    return first.join(items, "position").select("id", "symbol", "display_name")


def keyword_links(news: DataFrame, symbol: str, name: str, limit: int = 20) -> DataFrame:
    """The latest news that hold a new symbol or its name in title or summary, whatever the case of ASCII letters; the limit is the feature."""
    fold = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.lit(False)
    for word in dict.fromkeys([symbol.upper(), *([name] if name and name.upper() != symbol.upper() else [])]):
        for column in ("title", "summary"):
            hit = hit | F.coalesce(F.contains(fold(F.col(column)), fold(F.lit(word))), F.lit(False))
    return news.where(hit).orderBy(F.desc_nulls_last("published_at"), F.desc("fetched_at"), "news_id").limit(limit).select("news_id", F.lit(symbol.upper()).alias("symbol"), F.lit(0.6).alias("confidence"))
