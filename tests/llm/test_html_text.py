from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantaint.llm import html_text, oracle, registered
from quantaint.llm.html_text import main_text

LONG = "This sentence is the text of a page, with enough words in it to stand out among its menus."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<article><h1>T &lt; U</h1><p>a <b>bold</b>\n\n word<br>next<p>second</article>", "T < U\n\na bold word next\n\nsecond"),
        ("<nav>n</nav><article>a<aside>s</aside><footer>f</footer></article><p>tail", "a"),
        ("<script>var t='<p>no</p>'", ""),
        ("<style>p{}</style><!-- <p>no</p> --><form>no<p>no</form><main><p>yes</main>", "yes"),
        ("<header>no</header><article><header><h1>yes</h1></header>and</article>", "yes\n\nand"),
        ("<article><header class='article-header'>yes</header><div id=comments><p>no</p></div>b</article>", "yes\n\nb"),
        (f"<div class='page with-sidebar'><p>{LONG}</p></div><div class=sideBar>no</div>", LONG),
        (f"<div><p>{LONG}</p><p>Short.</p></div><div><a href=x>{LONG}</a></div><div class=cookieNotice>{LONG}</div>", f"{LONG}\n\nShort."),
        ("<article><p>a <span class=ad>no <span>no</span> no</span> b<i hidden>no<p>c</article>", "a b\n\nc"),
        ("<article>x</div></p></article></article>", "x"),
        ("<article>&#233;&#x1F600;&nbsp;&copy &bogus;</article>", "é😀\xa0© &bogus;"),
        ("<article><table><tr><td>1<td>2</table></article>", "1\n\n2"),
        ("<div class=ad><article>no</article></div><p>yes", "yes"),
        ("<div class=banner><main>yes</main></div>", "yes"),
    ],
)
def test_pages(html, text):
    assert main_text(html) == text


def test_deep_and_very_long_pages():
    assert main_text("<p>" * 100_000 + "x") == "x"
    assert main_text("<div>" * 50_000 + "y" + "</b>" * 50_000) == "y"
    assert main_text("<article>" + "word " * 1_000_000) == ("word " * 1_000_000).strip()
    assert main_text("<i>" * 20_000 + "<div>" * 20_000 + "z" + "</i>" * 20_000) == "z"


def test_smoothing_and_threshold():
    ratios = np.array([1.0, 1, 1, 80, 90, 85, 1, 1])
    flat = html_text.smoothed(np.full(9, 3.0))
    assert np.allclose(flat, 3.0)
    # Weights fall with the square of the distance and sum to one.
    one = html_text.smoothed(np.eye(9)[4])
    assert np.isclose(one[2:7].sum(), 1) and one[4] > one[3] > one[2] > 0 and one[1] == 0
    assert list(ratios >= html_text.threshold(ratios)) == [False] * 3 + [True] * 3 + [False] * 2
    assert html_text.threshold(np.array([5.0])) == 5.0


def test_rows_of_odd_tables(spark):
    rows = [(1, "u", "<article>a</article>"), (1, "u", "<article>a</article>"), (None, None, None), (2, "v", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(
        {"text": F.lit("other"), "n_chars": F.lit("x")}
    )
    found = sorted(map(tuple, html_text.extract_text(df).collect()), key=repr)
    assert found == sorted([(1, "u", "a", 1)] * 2 + [(None, None, "", 0), (2, "v", "", 0)], key=repr)
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_query_equals_statement(spark, small, duck):
    found = sorted(map(tuple, registered.op11_html_text(spark, small).collect()))
    assert found == sorted(duck.execute(oracle.statements()["op11_html_text"]).fetchall())
