"""Pages of many templates, some of which only their host's vote can tell; select on its own."""

import numpy as np
import pytest

from volspark.llm import elias_fano, html_extract

LONG = "The harbour was quiet that morning and the boats lay still under a grey sky. " * 6
OTHER = "Members may read the archive of past issues in the reading room on weekdays. " * 4


def text_of(*parts):
    return " ".join(" ".join(parts).split())


def plain(n, body):
    return f"<html><body><div class='top menu'><a href='/'>Home</a></div>{body}<div class='footer'>All rights reserved {n}</div></body></html>"


#: name -> (page of number n, its text)
TEMPLATES = {
    "article": lambda n: (plain(n, f"<article><h1>Title {n}</h1><p>{LONG}</p><p>No. {n}</p></article>"), text_of(f"Title {n}", LONG, f"No. {n}")),
    "main with aside": lambda n: (plain(n, f"<main><h2>Head {n}</h2><p>{LONG}</p><aside>{OTHER}</aside></main>"), text_of(f"Head {n}", LONG)),
    "post": lambda n: (plain(n, f"<div id='wrap'><div class='post post-{n}'><p>{LONG}</p><p>Part {n}</p></div><div class='sidebar'>{OTHER}</div></div>"), text_of(LONG, f"Part {n}")),
    "whole page in a form": lambda n: (f"<body><form action='/x'><input name='v'><div class='nav'>Start Help</div><article><p>{LONG}</p><p>Issue {n}</p></article></form></body>", text_of(LONG, f"Issue {n}")),
    "search form beside it": lambda n: (plain(n, f"<form class='q'><label>Search the site for words</label></form><article><p>{LONG}</p></article>"), text_of(LONG)),
    "telling words inside": lambda n: (plain(n, f"<article><p class='notice-period'>The notice period is {n} days.</p><p>He did a <span class='search'>search</span> of the <em class='ad'>hall</em>. {LONG}</p><p class='notice'>We use cookies.</p></article>"), text_of(f"The notice period is {n} days. He did a search of the hall.", LONG)),
    "two articles of links": lambda n: (plain(n, f"<div><article><p>{LONG}</p></article><article><p><a href='/a'>See the list of {n} ships</a></p></article></div>"), text_of(LONG, f"See the list of {n} ships")),
    "comments of readers": lambda n: (plain(n, f"<article><p>{LONG}</p></article><section class='comments'><div class='comment'><p>{OTHER}{OTHER}</p></div></section>"), text_of(LONG)),
}


@pytest.mark.parametrize("name", TEMPLATES)
def test_template_alone(name):
    for n in (1, 22):
        page, want = TEMPLATES[name](n)
        assert html_extract.page_text(page, None) == want


def voted(n):
    """Bare containers: on every fourth page the box beside the text is the longer one."""
    box = OTHER * (6 if n % 4 == 0 else 1)
    return f"<body><div class='alpha'><p>{LONG}</p><p>Story {n}</p></div><div class='beta'><p>{box}</p></div></body>", text_of(LONG, f"Story {n}")


def table(n):
    """The same in table cells, told apart by their tables' classes; the box comes first."""
    box = OTHER * 5 if n % 3 == 0 else OTHER[:60]
    return f"<body><table class='x'><tr><td><p>{box}</p></td></tr></table><table class='y'><tr><td><p>{LONG}</p>Page {n}</td></tr></table></body>", text_of(LONG, f"Page {n}")


def test_votes_decide_where_pages_cannot(spark):
    rows, want = [], {}
    for host, made in [("votes.example", voted), ("tables.example", table), *[(f"t{i}.example", t) for i, t in enumerate(TEMPLATES.values())]]:
        for n in range(8):
            page, text = made(n)
            rows.append((len(rows), f"http://{host}/a/{n}", page))
            want[rows[-1][0]] = text
    alone = {i: html_extract.page_text(page, None) for i, _, page in rows}
    assert {i for i in want if alone[i] != want[i]} == {0, 4, 8, 11, 14}  # told by the votes of their hosts alone
    rows += [(900, "http://votes.example/e", None), (901, None, ""), (902, "http://t0.example/z", "<nav>only a menu</nav>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("page_id", "url", "html", "1 AS path", "2 AS host", "3 AS text")
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert got == want | {900: "", 901: "", 902: ""}
    assert html_extract.extract(df.limit(0)).count() == 0


def test_select_of_many_places():
    rng = np.random.default_rng(9)
    for n, most in ((1, 5), (700, 3), (5000, 10**7)):
        v = np.sort(rng.integers(0, most, n))
        e = elias_fano.encode(v, int(v[-1]))
        assert len(e["samples"]) == 4 * -(-n // elias_fano.STEP)
        at = np.unique(rng.integers(0, n, 40))
        assert elias_fano.select_many(e, at).tolist() == v[at].tolist() and elias_fano.select_many(e, np.arange(n)).tolist() == v.tolist()
        assert len(elias_fano.select_many(e, np.zeros(0, np.int64))) == 0
        for bad in ([-1], [0, n]):
            with pytest.raises(IndexError):
                elias_fano.select_many(e, np.array(bad))
