"""Queries give the rows of their SQL on texts that the supplied tables do not have."""

import duckdb
import pytest

from harborlight import plans
from harborlight.sources import payloads

SPACES = " \u00a0\u1680\u2000\u200a\u202f\u205f\u3000"
TEXTS = [None, "", "  ", "\n\n", '"<>', *[f"{a}one{a} two{a}" for a in (*SPACES, "\t", "\x0b", "\x1c", "\u200b")], "【head】one", "【】one", "\U0001f600" * 70, "\ufeffone\x00two"]


@pytest.mark.parametrize("name", ["detail_pages", "telegraph_items"])
def test_odd_texts(spark, tmp_path, name):
    rows = [(12 * i + n, text) for i, text in enumerate(TEXTS) for n in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = plans.QUERIES[name](spark, str(tmp_path))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    rel = db.sql(plans.ORACLE_SQL[name])
    at = [rel.columns.index(c) for c in df.columns]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())


def test_long_telegraph(spark):
    content = '{"data":{"roll_data":[{"id":1,"content":"%s"},null,{"id":2,"title":" T "}]}}' % ("x" * 20_000_001)
    rows = payloads.parse_telegraph(spark.createDataFrame([(1, content)], "payload_id long, content string")).selectExpr("id", "title", "length(body) n").collect()
    assert sorted(map(tuple, rows)) == [(1, "x" * 60, 20_000_001), (2, "T", None)]
