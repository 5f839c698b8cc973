"""Selectors, containers and charsets."""

import pytest

from harborlight.functions import selectors
from harborlight.operators import markup
from harborlight.sources import payloads

PAGE = """<html><body id=top><div class="list main"><ul><li class="item a" data-k="x1"><a href="/1">One <b>bold</b></a> <time>10:00</time></li>
<li class=item><p>text<a href="/2" rel="nofollow next">Two</a></li><li class="item"><a>no link</a></li><li class="item"><a href="/1">again</a></li></ul></div>
<ol><li><a href="https://x.org/3" lang="en-us">Three</a><br><img src=i></li></ol><script>var a = "<li>";</script></body></html>"""


@pytest.mark.parametrize(
    ("selector", "tags"),
    [
        ("li", 5), ("li.item", 4), (".item.a", 1), ("#top", 1), ("ul > li > a", 3), ("ul li a", 4), ("div.main li > p a", 1), ("ol a, ul p", 2), ("[data-k]", 1), ("a[href='/1']", 2), ("a[href^=\"/\"]", 3), ("a[href$='3']", 1), ("a[href*=x.org]", 1), ("a[rel~=next]", 1), ("a[lang|=en]", 1),
        ("*", 24), ("body > div , body > ol", 2), ("span", 0), ("div>ul>li.item.a>a>b", 1), ("a[href^='']", 0),
    ],
)
def test_selectors(selector, tags):
    page = selectors.Page(PAGE)
    found = selectors.select(page, selector)
    assert len(found) == (len(page.tags) - 1 if selector == "*" else tags) and found == sorted(found)
    assert selectors.select(page, selector, first=True) == found[:1]


@pytest.mark.parametrize("selector", ["", "a >", "> a", "a,, b", "a:hover", "a[", "a + b"])
def test_selectors_that_are_not_understood(selector):
    with pytest.raises(ValueError):
        selectors.compiled(selector)


def test_page_text_and_structure():
    page = selectors.Page("<div>a<p>b<p>c &amp; d<ul><li>e<li>f</ul>g</div><p>h")
    div = selectors.select(page, "div")[0]
    assert page.text(div, "|", True) == "a|b|c & d|e|f|g" and [page.text(p, "", False) for p in selectors.select(page, "p")] == ["b", "c & d", "h"]
    assert page.text(0, "", False) == "abc & defgh"
    deep = selectors.Page("<div>x" * 3000 + "<b>y</b>")
    assert deep.text(selectors.select(deep, "b")[0], "", False) == "y"


def test_references_without_a_semicolon_are_text():
    page = selectors.Page('<p>a &amp;&amp<b>b &quo</b> &quot &#38; &#38 &notit; &amp;lt; R&D<a href="?x=1&copy=2&amp;y&amp">c</a><script>a && b</script>')
    assert page.text(0, "", False) == 'a &&ampb &quo &quot & &#38 &notit; &lt; R&Dc'
    assert page.attributes[selectors.select(page, "a")[0]]["href"] == "?x=1&copy=2&y&amp"


def test_list_items_and_containers(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "<article>short</article><div class=body>" + "long " * 40 + "</div>")], "page_id long, html string")
    rule = markup.ListRule("li", "a", "a[href]", "time", "p")
    got = [tuple(r) for r in markup.list_items(pages, rule).orderBy("page_id", "pos").collect()]
    assert got == [(1, 1, "One bold", "/1", "10:00", None), (1, 2, "Two", "/2", None, "text Two"), (1, 3, "Three", "https://x.org/3", None, None)]
    assert [r.pos for r in markup.list_items(pages, markup.ListRule("li", "a", "a", limit=1)).collect()] == [1]
    found = {r.page_id: (r.selector, r.text) for r in markup.containers(pages, ["article", ".body", "body"]).collect()}
    assert found == {1: (None, None), 2: (None, None), 3: (None, None), 4: (".body", ("long " * 40).strip())}
    assert markup.list_items(pages.limit(0), rule).count() == 0
    with pytest.raises(ValueError):
        markup.containers(pages, ["a:b"])


CHINESE = "贵州茅台发布年度报告，公司业绩增长，市场份额上升，投资者关注股份公司的分红方案。"
TAIWAN = "台灣的公司發布年度報告，業績成長，股份市場中有不少投資人關注。"
JAPANESE = "トヨタは本日の決算で増益を発表しました。株価は上がりました。"
KOREAN = "삼성전자가 오늘 실적을 발표했다. 시장의 기대를 넘는 이익이다."


@pytest.mark.parametrize(("text", "charset"), [(CHINESE, "gb18030"), (CHINESE, "utf-8"), (TAIWAN, "big5"), (JAPANESE, "shift_jis"), (KOREAN, "euc_kr"), ("plain ascii", "ascii"), ("é à ü", "utf-8"), ("", "utf-8")])
def test_charsets(text, charset):
    raw = text.encode(charset)
    assert payloads.decoded(raw, f"text/html; charset={charset}") == text
    assert payloads.decoded(f'<meta charset="{charset}">'.encode() + raw, None).endswith(text)
    assert payloads.decoded(raw, None) == text  # by what the bytes are valid as
    assert payloads.decoded(raw, "text/html; charset=no-such") == text
    if charset == "gb18030":
        assert payloads.decoded(raw, "text/html; charset=gb2312") == text and payloads.decoded(raw, 'text/html; charset="utf-8"') == text


def test_bytes_that_are_valid_as_nothing():
    assert payloads.decoded(None, None) is None and "�" in payloads.decoded(b"abc\xff\xfe\xff", "text/html; charset=utf-8")
