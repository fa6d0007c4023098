"""Visibility, deep nesting, spans and time of the HTML renderer, and an independent text extractor over whole pages."""

import re
import time
from html.parser import HTMLParser

import pytest

from tessera.llm import htmltext

DEEP = "<div>" * 205


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (DEEP + "<style>css{}</style><script>js()</script><p hidden>HID</p>x", "x"),
        (DEEP + "<ul><li>a<li>b</ul>", "- a\n- b"),
        ("<div\nhidden>SECRET</div>t", "t"),
        ("<div\thidden>SECRET</div>t", "t"),
        ("<div/hidden>SECRET</div>t", "t"),
        ("<p style='visibility:hidden'>no <b style='visibility: visible'>yes</b> no</p>", "yes"),
        ("<p hidden style='display:block'>shown</p>", "shown"),
        ("<details><summary>Sum</summary>closed</details><details open><summary>S2</summary>open</details>", "Sum\nS2\nopen"),
        ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"),
        ("<style>.off{color:red;display:none} #id2 , p.x{display:none}</style><p class='a off'>1</p><p id=id2>2</p><p class=x>3</p><div class=x>4</div>", "4"),
        ("<style>.off{display:none}.off.on{display:block}</style><p class='off on'>yes</p><p class=off>no</p>", "yes"),
        ("<style>.off{display:none}</style><p class=off style='display:block'>yes</p>", "yes"),
        ("<style>.off{display:none!important}</style><p class=off style='display:block'>no</p>z", "z"),
        ("<style>@media print{p{display:none}} @import 'x'; /* p{display:none} */</style><p>yes</p>", "yes"),
        ("<table><tr><td rowspan=2>A<td>B<tr><td>C</table>", "A | B\n  | C"),
        ("<table><tr><td>a<td rowspan=3>b<td>c<tr><td>d<td>e<tr><td>f<td>g</table>", "a | b | c\nd |   | e\nf |   | g"),
        ("<table><tr><td colspan=2 rowspan=2>X<td>1<tr><td>2<tr><td>p<td>q<td>3</table>", "X     | 1\n      | 2\np | q | 3"),
        ("<table><tr><td colspan=x rowspan=0>a<td>b</table>", "a | b"),
        ("<p>text <a href='cut off", "text"),
        ("<p>text</p><b", "text"),
        ("a </ b> c </p", "a c"),
        ("<a title=x>y>z</a>", "y>z"),
        ("1 <2 and <3", "1 <2 and <3"),
        ("<style>div .z{display:none}</style><div><b><p class=z>no</p></b></div><p class=z>yes</p>", "yes"),
        ("<style>ul > li.x{display:none}</style><ul><li class=x>no<li><div class=x>a</div></ul>", "- a"),
        ("<style>h2+p{display:none} h2 ~ b{visibility:hidden}</style><p>0</p><h2>H</h2><p>no</p><p>yes</p><b>no</b>", "0\n\nH\n\nyes"),
        ("<style>.a .b,.x{display:none} div.a > .b{display:block}</style><div class=a><p class=b>yes</p><div><p class=b>no</p></div></div>", "yes"),
        ("<style>p:hover, a[b] i, .n{display:none}</style><p>yes</p><a b><i>too</i></a><p class=n>no</p>", "yes\n\ntoo"),
        ("<ol reversed><li>a<li value=5>b<li>c</ol>", "3. a\n5. b\n4. c"),
        ("<ol start=3><li>x<li value=9>y<li value=z>z</ol>", "3. x\n9. y\n10. z"),
        ("<table><tr><td><pre>a\n  b</pre><td>x<tr><td>c<td>d</table>", "a   | x\n  b |\nc   | d"),
        ("<table><tr><td colspan=0000002>a<td>b<tr><td>1<td>2<td>3</table>", "a     | b\n1 | 2 | 3"),
    ],
)
def test_render(html, text):
    assert htmltext.render(html) == text


SIZE = 300_000
PATHOLOGICAL = ["<", "<a ", "<a b=\"", "<!--", "</", "<div>", "<b>", "<p>", "<ul><li>", "<table><tr><td>", "<tr><td rowspan=9999 colspan=999>", "<svg>", "<style>", "</style ", "<dl><dd>", "&", "<x y='", "<td>", "<select><option>"]


@pytest.mark.parametrize("unit", PATHOLOGICAL)
def test_time_grows_with_the_page(unit):
    """Eight times the page takes about eight times as long, not sixty-four."""

    def took(n):
        began = time.process_time()
        htmltext.render(unit * (n // len(unit)) + "x")
        return time.process_time() - began

    took(SIZE // 8)
    small, large = took(SIZE // 8), took(SIZE)
    assert large < 30 * small + 0.5


class _Plain(HTMLParser):
    """Words outside of hidden elements, as the standard library's parser reports them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.off, self.words = [], []

    def handle_starttag(self, tag, attrs):
        if tag in ("head", "script", "style", "title", "noscript", "template", "iframe"):
            self.off.append(tag)

    def handle_endtag(self, tag):
        if tag in self.off:
            del self.off[self.off.index(tag) :]

    def handle_data(self, data):
        if not self.off:
            self.words.append(data)


def test_words_of_whole_pages_equal_an_independent_parser(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html").collect()
    got = {r.page_id: r.text for r in htmltext.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()}
    assert len(got) == len(pages) > 0
    letters = lambda s: re.sub(r"[\s|]+", "", re.sub(r"(?m)^ *(?:- |\d+\. )", "", s))
    for p in pages:
        plain = _Plain()
        plain.feed(p.html or "")
        plain.close()
        want = re.sub(r"[\s|]+", "", "".join(plain.words))
        have = letters(got[p.page_id])
        assert have == want or sorted(have.replace("-", "")) == sorted(want.replace("-", "")), p.page_id


def test_extra_columns_and_repeats(spark):
    df = spark.createDataFrame([(1, "<p>a", "x", 5), (1, "<p>a", "x", 5), (None, "b", "y", 6)], "page_id long, html string, text string, n_lines int")
    assert sorted((r.page_id or 0, r.text, r.n_lines) for r in htmltext.extract(df).collect()) == [(0, "b", 1), (1, "a", 1), (1, "a", 1)]


STYLED = {
    "one rule again and again": lambda n: "<style>" + ".a{display:none}" * n + "</style>" + "<p class=a>x" * n,
    "below one class": lambda n: "<style>" + "".join(f".a .b{k}{{display:none}}" for k in range(n)) + "</style>" + "".join(f"<p class='a b{k}'>x" for k in range(n)),
    "two classes": lambda n: "<style>" + "".join(f".a.c{k}{{display:none}}" for k in range(n)) + "</style>" + "<p class=a>x" * n,
    "many above": lambda n: "<style>" + "".join(f".a{k} .b{{display:none}}" for k in range(n)) + "</style>" + "<p class=b>x" * n,
}


@pytest.mark.parametrize("kind", sorted(STYLED))
def test_time_of_style_rules(kind):
    page = STYLED[kind](20_000)
    began = time.process_time()
    htmltext.render(page)
    assert time.process_time() - began < 8


def test_layout_is_a_parameter():
    nested = "<table><tr><td>a<td><table><tr><td>b<td>c</table></table>"
    assert htmltext.render(nested) == "a | b | c"
    assert htmltext.render("<ul><li>a<ul><li>b</ul></ul>", htmltext.Layout(indent=0)) != htmltext.render("<ul><li>a<ul><li>b</ul></ul>")
    wide = "<table><tr><td>" + "x" * 200 + "<td>1<tr><td>a<td>2</table>"
    assert htmltext.render(wide, htmltext.Layout(padding=0, spare=0)).split("\n")[1] == "a | 2" != htmltext.render(wide).split("\n")[1]
