"""All queries over the supplied tables, each with SQL that gives the same rows."""

from . import desk, details, ingest, market, lookup, markup, news, ordered, records, roundup, runs, landed  # noqa: F401
from .common import ORACLE_SQL, QUERIES  # noqa: F401
