"""Lists and containers of pages by CSS selectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.selectors import Page, compiled, select


@dataclass(frozen=True)
class ListRule:
    """Selectors of the entries of a list, and within an entry of its title, link, time and content; entries taken at most."""

    entry: str
    title: str
    link: str
    time: str | None = None
    content: str | None = None
    limit: int | None = None


def list_items(pages: DataFrame, rule: ListRule, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, pos, title, href, time_text and content_text of each list entry with a title and a link; a page's repeated links count once.

    ``pos`` numbers a page's items from 1.  Null and empty pages have no items; a selector that is not understood is an error.
    """
    for selector in (rule.entry, rule.title, rule.link, rule.time, rule.content):
        compiled(selector) if selector else None
    rows = pages.select(F.col(id_col), F.col(html_col).cast("string").alias("html"))

    def of_page(html: str | None) -> list[tuple]:
        page, out, seen = Page(html), [], set()
        text = lambda element: page.text(element, " ", True)
        one = lambda selector, entry: next(iter(select(page, selector, entry, True)), None)
        for entry in select(page, rule.entry)[: rule.limit]:
            title, link = one(rule.title, entry), one(rule.link, entry)
            href = page.attributes[link].get("href") if link is not None else None
            if title is None or not href or not text(title) or href in seen:
                continue
            seen.add(href)
            time = one(rule.time, entry) if rule.time else None
            content = one(rule.content, entry) if rule.content else title
            out.append((len(out) + 1, text(title), href, None if time is None else text(time), None if content is None else text(content)))
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(key, *item) for key, html in zip(frame[id_col], frame["html"], strict=True) for item in of_page(html)]
            yield pd.DataFrame(found, columns=[id_col, "pos", "title", "href", "time_text", "content_text"])

    return rows.mapInPandas(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, pos int, title string, href string, time_text string, content_text string")


def containers(pages: DataFrame, selectors: list[str], least: int = 120, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, selector and text: the first of the selectors whose first element has more than ``least`` characters of text; nulls if none has."""
    for selector in selectors:
        compiled(selector)
    rows = pages.select(F.col(id_col), F.col(html_col).cast("string").alias("html"))

    def of_page(html: str | None) -> tuple[str | None, str | None]:
        page = Page(html)
        for selector in selectors:
            for element in select(page, selector, first=True):
                text = page.text(element, "\n", False).strip()
                if len(text) > least:
                    return selector, text
        return None, None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(key, *of_page(html)) for key, html in zip(frame[id_col], frame["html"], strict=True)]
            yield pd.DataFrame(found, columns=[id_col, "selector", "text"])

    return rows.mapInPandas(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, selector string, text string")
