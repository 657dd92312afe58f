"""Layout rules that keep output and time in proportion to the page, and what a browser hides."""

import time

import pytest

from tastemill.llm.html_layout import rendered

WORDS = "one long paragraph of many words " * 60
GROWING = {
    "a long cell above many rows": f"<table><tr><td>{WORDS}<td>b" + "<tr><td>a<td>b" * 4000 + "</table>",
    "one tall cell and many narrow ones": "<table><tr><td>" + "x<br>" * 2000 + "<td>y" * 2000 + "</table>",
    "wide spans": "<table>" + "<tr><td colspan=1000>a<td colspan=1000>b" * 2000 + "</table>",
    "spans down": "<table>" + ("<tr>" + "<td rowspan=999>a" * 300) * 100 + "</table>",
    "nested lists": "<ul><li>x" * 20_000,
    "nested empty lists": "<ul><li>" * 20_000 + "x",
    "nested tables": "<table><tr><td>a<td>b<td>" * 5000 + "x",
    "nested quotes of lists": "<dl><dd>y<ol><li>z" * 10_000,
}


@pytest.mark.parametrize("name", GROWING)
def test_output_stays_in_proportion_and_keeps_all_words(name):
    page, began = GROWING[name], time.monotonic()
    text = rendered(page)
    assert time.monotonic() - began < 5
    assert len(text) <= 12 * len(page)
    import re

    words = re.sub("<[^>]*>", " ", page).split()
    assert [w for w in text.split() if not re.fullmatch(r"-|\d+\.", w)] == words or sorted(w for w in text.split() if not re.fullmatch(r"-|\d+\.", w)) == sorted(words)


@pytest.mark.parametrize("shape", ["<p><button>" + "<i>" * 16_000 + "<div>x</div>" * 16_000, "<table>" + "<b>" * 16_000 + "</i>" * 16_000, "<ul><li>" + "<b>" * 16_000 + "<p>a</u>" * 16_000])
def test_open_elements_are_found_in_little_time(shape):
    began = time.monotonic()
    rendered(shape)
    assert time.monotonic() - began < 5


@pytest.mark.parametrize("html, text", [
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
    ("<table><tr><td>a<td rowspan=2>bb<td>c<tr><td>d<td>e<tr><td>f<td>g<td>h</table>", "a  bb  c\nd      e\nf  g   h"),
    ("<details><summary>more</summary><p>inside</details>after", "more\nafter"),
    ("<details open><summary>more</summary><p>inside</details>after", "more\n\ninside\n\nafter"),
    ("<div style='visibility:hidden'>no <b style='visibility: visible'>yes</b> no</div>", "yes"),
    ("<div style='display:none'>no <b style='visibility:visible'>no</b></div>a", "a"),
    ("<style>.x, #y{display:none} p.z{visibility:hidden} /* .k{display:none} */ span{color:red}</style><p class='a x'>1<p id=y>2<p class=z>3<div class=z>4</div><p class=k>5", "4\n\n5"),
    ("<style>@media print{.x{display:none}} .y{display:none}</style><i class=x>seen</i> <i class=y>not</i>", "seen"),
    ("<style>.x{display:none}</style><p class=x style='display:block'>own style wins", "own style wins"),
    ("<style>.x{display:none", ""),
])
def test_what_is_shown(html, text):
    assert rendered(html) == text
