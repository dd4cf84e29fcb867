"""Collapsed details and the layout of tables."""

import pytest

from sparkloom.llm import html


@pytest.mark.parametrize(
    "page, want",
    [
        ("<details><summary>Why?</summary>Because.</details>x", "Why?\nx"),
        ("<details class=faq>a<p>b</p><summary>Why <b>so</b>?</summary>c<summary>d</summary></details>x", "Why so?\nx"),
        ("<details open><summary>Why?</summary>Because.</details>x", "Why?\nBecause.\nx"),
        ("<details hidden><summary>Why?</summary>Because.</details>x", "x"), ("<details>a</details>x", "x"),
        ("<details><summary>q</summary><details open><summary>r</summary>s</details></details>x", "q\nx"),
    ],
)
def test_details(page, want):
    assert html.page_text(page) == want


@pytest.mark.parametrize(
    "page, want",
    [
        ("<table><tr><td>aa<br>b<td>c<tr><td>d<td>eeee<td>f</table>", "aa  c\nb\nd   eeee  f"),
        ("<table><tr><td>x<td><ul><li>a<li>bb</ul><td>y<tr><td>longer<td>z<td>w</table>", "x       - a   y\n        - bb\nlonger  z     w"),
        ("<table><tr><td colspan=2>ab<td>c<tr><td>dd<td>ee<td>ff</table>", "ab      c\ndd  ee  ff"),
        ("<table><tr><td colspan=2>a wide heading<td>c<tr><td>dd<td>ee<td>ff</table>", "a wide heading  c\ndd  ee          ff"),
        ("<table><tr><td colspan=1000>a<td>b<tr><td colspan=0>c<td colspan=x>d</table>", "a     b\nc  d"),
        ("<table><tr><td>a<td><table><tr><td>p<td>q<tr><td>rr<td>s</table><td>z</table>", "a  p   q  z\n   rr  s"),
    ],
)
def test_table_layout(page, want):
    assert html.page_text(page) == want
