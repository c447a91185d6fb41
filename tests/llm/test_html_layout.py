"""Layout of tables, lists and hidden parts, and how the text grows with the page."""

import random
import re

import pytest

from chainscope.llm import html_text
from chainscope.llm.html_text import render


@pytest.mark.parametrize("html,text", [
    ("<table><tr><td rowspan=2>A<td>b<tr><td>c</table>", "A | b\n  | c"),
    ("<table><tr><td colspan=2>wide title<td>x<tr><td>1<td>2<td>3</table>", "wide title | x\n1 | 2      | 3"),
    ("<table><tbody><tr><td rowspan=9>A<td>1<tbody><tr><td>2<td>3</table>", "A | 1\n2 | 3"),  # a rowspan ends with its group
    ("<table><tr><td rowspan=2 colspan=2>A<td>b<tr><td>c<tr><td>d<td>e<td>f</table>", "A     | b\n      | c\nd | e | f"),
    ("<table><tr><td colspan=1000>a<td>b</table>", "a | b"), ("<table><tr><td rowspan=x>a<td colspan=-3>b</table>", "a | b"),
    ("<table><tr><td><td>x<tr><td>y<td></table>", "  | x\ny |"),
    ("<div style='visibility:hidden'>a<b style='visibility: visible'>d</b>e</div>f", "d\nf"),
    ("<p style='display:none'>a<b style='visibility:visible'>d</b></p>f", "f"), ("<body style='visibility:hidden'>q<i style='visibility:visible'>r", "r"),
    ("<table><tr style='visibility:collapse'><td>a<td style='visibility:visible'>b<tr><td>c<td>d</table>", "  | b\nc | d"),
    ("<ul style='visibility:hidden'><li>a<li style='visibility:visible'>b</ul>", "- b"),
    ("<details><summary>s</summary>hidden</details><details open><summary>t</summary>shown</details>", "s\nt\nshown"), ("<details>never</details>x", "x"),
    ("<ol start=3><li>a<li value=9>b<li>c</ol>", "3. a\n9. b\n10. c"), ("<ol reversed><li>x<li>y<li>z</ol>", "3. x\n2. y\n1. z"),
    ("<ol reversed start=10><li>x<li value=4>y<li>z</ol>", "10. x\n4. y\n3. z"), ("<ul><li value=7>a</ul>", "- a"), ("<ol><li value=q>a<li value=''>b</ol>", "1. a\n2. b"),
])
def test_layout(html, text):
    assert render(html) == text


def _grid(rows):
    """Where each cell stands: rows of (rowspan, colspan), the plain way."""
    taken, out = set(), []
    for y, row in enumerate(rows):
        x = 0
        for down, across in row:
            while (y, x) in taken:
                x += 1
            out.append((y, x))
            taken |= {(y + i, x + j) for i in range(down) for j in range(across)}
            x += across
    return out


def test_cells_stand_where_a_plain_grid_puts_them():
    rng = random.Random(6)
    for _ in range(200):
        rows = [[(rng.choice([1, 1, 1, 2, 3]), rng.choice([1, 1, 1, 2])) for _ in range(rng.randrange(1, 5))] for _ in range(rng.randrange(1, 6))]
        n, html, names = 0, "<table>", []
        for row in rows:
            html += "<tr>"
            for down, across in row:
                html += f"<td rowspan={down} colspan={across}>c{n:03}</td>"
                names.append(f"c{n:03}")
                n += 1
        lines = render(html + "</table>").split("\n")
        place = _grid(rows)
        starts = sorted({x for _, x in place})
        left = {}
        for (y, x), name in zip(place, names):
            at = lines[y].index(name)
            left.setdefault(x, set()).add(at)
        # cells of a column begin at one place, and columns follow in order
        assert all(len(v) == 1 for v in left.values()), (html, lines)
        assert [min(left[x]) for x in starts] == sorted(min(left[x]) for x in starts)


@pytest.mark.parametrize("page", [
    lambda n: "<table><tr><td>" + "x" * 20 * n + "</td><td>y</td></tr>" + "<tr><td>a<td>b" * n + "</table>",
    lambda n: "<table><tr>" + "<td rowspan=9999>a" * n + "<tr><td>b" * n + "</table>",
    lambda n: "<table>" + ("<tr>" + "<td>" + "w" * 50 + "<td>v") * n + "</table>",
    lambda n: "<table><tr>" + "<td colspan=1000>a" * n + "<tr>" + "<td>b" * n + "</table>",
])
def test_text_grows_with_the_page(page):
    small, large = len(render(page(200))), len(render(page(800)))
    assert large < 6 * small and large < 40 * len(page(800))


def test_all_visible_text_of_tables_with_spans_stays():
    rng = random.Random(8)
    for _ in range(300):
        parts, words = [], []
        for k in range(rng.randrange(2, 30)):
            tag = rng.choice(["<tr>", "<td>", "<td rowspan=3>", "<td colspan=4>", "<th rowspan=0>", "</td>", "<tbody>", "<table>", "</table>", "<p>", "<caption>", "<li value=3>", "<details open>"])
            words.append(f"w{k}x")
            parts.append(tag + words[-1])
        assert sorted(re.findall(r"w\d+x", render("<table>" + "".join(parts)))) == sorted(words)


def test_deep_tables_end():
    assert "deep" in render("<table><tr><td>" * (html_text._DEEP + 20) + "deep")
