"""Main texts of pages of several shapes, the vote of a host, and nulls, empty and long pages, ties, repeated rows, empty tables, clashing columns."""

import re
from html import unescape
from pathlib import Path

import duckdb
import pytest

from glimmer.llm import html_extraction as he

SCHEMA = "page_id long, url string, html string, host string, path string, text string, wanted string, count long"
LONG = "Seven sailors sold silver shells, and sixteen more stood by the shore to see them go under in the evening."
CHROME = '<nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="cookie-notice">We use cookies, please agree to all of them now.</div>'
END = '<section id="comments"><article class="comment"><p>Great read, thanks a lot for the many words of it!</p></article></section><aside>More</aside><footer>&copy; us</footer>'
PAGES = {
    "article": (f"<html><body>{CHROME}<article><header><h1>A  title</h1></header><p>{LONG}</p><p>Tom &amp; Ann&#8217;s&nbsp;x &lt;b&gt;</p></article>{END}</body></html>", f"A title\n{LONG}\nTom & Ann’s x <b>"),
    "soup": (f'<body class="has-sidebar">{CHROME}<div id=wrap><div class="post-body"><h2>T</h2><div>{LONG}</div><ul><li>one<li>two</ul></div><div class="sidebar"><p>{LONG}</p></div></div>{END}', f"T\n{LONG}\none\ntwo"),
    "inside": (f'<article><p>{LONG}</p><div class="ad">Buy</div><form><input name=q>Search</form><script>if (a<b) "</p>"</script><p>End<style>p{{}}</style> of it</p><div class="share">Tweet</div></article>', f"{LONG}\nEnd of it"),
    "open": (f"<body><p>{LONG}<p><b>Bold <i>and<br>more<p>Last &am", f"{LONG}\nBold and more\nLast &am"),
    "cut tag": (f"<article><p>{LONG}</p><p>Cut &amp<", f"{LONG}\nCut &<"),
    "cut end": (f"<article><p>{LONG}</p><p>Cut</p", f"{LONG}\nCut"),
    "form": (f'<body><form id="aspnet"><div class="menu">Home</div><div><p>{LONG}</p><p>{LONG}</p></div></form></body>', f"{LONG}\n{LONG}"),
    "table": (f"<table><tr><td class=nav><a href=x>Here</a><td><p>{LONG}</p>More text stands here as well</table>", f"{LONG}\nMore text stands here as well"),
    "comment": (f"<article><!-- > <p>no</p> --><p>{LONG}</p><!-- open", LONG),
    "header": (f'<div class="header"><p>{LONG}</p></div><main><p>Short one.</p></main>', "Short one."),
    "hidden": (f'<article><p>{LONG}</p><p hidden>no</p><div style="display: none">no</div><span class="ad">no</span></article>', LONG),
    "list": ('<article><ul><li><a href="1">One thing</a></li><li><a href="2">Other thing</a></li></ul></article>', "One thing\nOther thing"),
    "quotes": (f'<article title="a > b"><p data-x=\'<p>\'>{LONG}</p>3 < 4 and 5 > 2</article>', f"{LONG}\n3 < 4 and 5 > 2"),
    "empty": ("", ""),
    "none": ("<html><body><nav>Menu</nav></body></html>", ""),
    "raw": ("<script>never closed <p>text</p>", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_shapes(name):
    html, want = PAGES[name]
    page = he.read(html)
    assert he.text_of(page, he.best(page, he.scores(page))) == want


def test_deep_and_long():
    page = he.read("<div>" * 30_000 + "x" + "</div>" * 30_000 + "<article>" + "<p>word " * 30_000)
    assert he.text_of(page, he.best(page, he.scores(page))) == "\n".join(["word"] * 30_000)
    he.read("<a " + "x='" * 20_000)
    he.read('<p title="' * 3_000)


def test_vote_of_the_host(spark):
    """A short article next to a long guest text is found by what the host's other pages have in its place."""
    usual = f'<body><div class="col a1"><p>{LONG}</p><p>{LONG}</p></div><div class="guest"><p>Hm.</p><div class="ad">{LONG}</div></div></body>'
    odd = f'<body><div class="col a7"><p>Short, and yet the article.</p><div class="ad">{LONG}</div></div><div class="guest"><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div></body>'
    rows = [(i, f"http://u@News.example:80/{i}", usual, "x", "y", "z", "w", 1) for i in range(5)] + [(9, "https://news.example/x", odd, "x", "y", "z", "w", 1), (9, "https://other.example/x", odd, "x", "y", "z", "w", 1)]
    rows += [(10, "news.example/no-scheme", odd, "x", "y", "z", "w", 1), (11, None, usual, None, None, None, None, None), (12, "http://news.example", None, "x", "y", "z", "w", 1), (None, "http://news.example", "", "x", "y", "z", "w", 1)]
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in he.extract(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()), key=str)
    twice, guest, short = f"{LONG}\n{LONG}", f"{LONG}\n{LONG}\n{LONG}", "Short, and yet the article."
    want = [(r[0], r[1], twice) for r in rows[:5]] + [(9, rows[5][1], short), (9, rows[6][1], guest), (10, rows[7][1], guest), (11, None, twice), (12, "http://news.example", ""), (None, "http://news.example", "")]
    assert got == sorted(((*w, len(w[2])) for w in want), key=str)
    assert he.winning_paths(spark.createDataFrame(rows, SCHEMA)).where("host = 'news.example'").first().path == "body>div.a#.col"


def test_ties_and_empty(spark):
    pages = [(1, "http://h/1", f"<body><div class=b>{LONG}</div>"), (2, "http://h/2", f"<body><div class=a>{LONG}</div>")]
    assert he.winning_paths(spark.createDataFrame(pages, "page_id long, url string, html string")).first().path == "body>div.a"
    assert he.extract(spark.createDataFrame([], SCHEMA)).collect() == []


def test_whole_table(spark):
    """The driver's pages have one shape, for which a few expressions do."""
    path = "/root/testdata/sf0.001/pages.parquet"
    want = {}
    for page_id, html in duckdb.sql(f"select page_id, html from '{path}'").fetchall():
        found = re.search(r"<article>(.*?)(?:</article>|\Z)", html, re.S)
        blocks = [" ".join(unescape(re.sub(r"<[^>]*(>|\Z)", " " if "<br>" in b else "", b)).split()) for b in re.split(r"</?(?:p|h1)>", found[1] if found else "")]
        want[page_id] = "\n".join(b for b in blocks if b)
    got = {r.page_id: r.text for r in he.op13_html_extraction(spark, str(Path(path).parent)).collect()}
    assert got == want
