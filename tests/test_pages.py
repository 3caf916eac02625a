"""Page rules on hand-written boards."""

import time
import tracemalloc

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from rolescope.functions import html as parsing
from rolescope.functions.html import BOXES, _Flattener, _marked
from rolescope.operators import pages as pg
from rolescope.operators.intake import import_careers
from rolescope.rules import Rules
from rolescope.session import ARROW_BATCH

URL = "https://boards.example/co/list"


def links(spark, html, rule):
    frame = pg.parsed_pages(spark.createDataFrame([(URL, html)], "url string, html string"))
    found = frame.select(rule(F.col("page"), F.col("base")).alias("links")).first().links
    return [(link.title, link.url, link.location) for link in found]


def test_board_layout(spark):
    html = """<div><p><a href="/jobs/1">Backend <b>Engineer</b></a><span class="x Location">Oslo</span></p>
      <p><a href="/jobs/2">Data Engineer</a></p><em>Rome</em><p><a href="/jobs/3">SRE</a></p></div>"""
    assert links(spark, html, pg.board_links) == [
        ("BackendEngineer", "https://boards.example/jobs/1", "Oslo"), ("Data Engineer", "https://boards.example/jobs/2", "Rome")]


def test_block_layout(spark):
    html = """<div class="posting"><a class="posting-title" href="p/1"><h5>Dev One</h5></a>
      <div class="posting-categories"><span class="location">Oslo</span></div></div>
      <div class="big posting"><a href="p/2">no title</a></div>
      <div class="posting"><div class="posting-title"><h5>Dev Two</h5></div><a href="/jobs/9">go</a><i class="workplaceTypes">Remote</i></div>"""
    assert links(spark, html, pg.block_links) == [
        ("Dev One", "https://boards.example/co/p/1", "Oslo"), ("Dev Two", "https://boards.example/jobs/9", "Remote")]


def test_workplace_layout(spark):
    html = """<div><a href="/posting/1">Dev One</a> <i>Hybrid, Oslo</i></div><div><a href="/jobs/2">Dev Two</a></div><a href="/x">Other</a>"""
    assert links(spark, html, pg.workplace_links) == [
        ("Dev One", "https://boards.example/posting/1", "Hybrid, Oslo"), ("Dev Two", "https://boards.example/jobs/2", "")]


def test_listed_needs_three_and_falls_back_to_paths(spark):
    two = '<ul><li><a href="/a">Dev Alpha</a><i>New York</i></li><li><a href="/b">Dev Beta</a></li></ul><a href="/careers/9">Dev Gamma</a>'
    assert links(spark, two, pg.generic_links) == [("Dev Gamma", "https://boards.example/careers/9", "")]
    three = two.replace("</ul>", '<li><a href="/a">Dev Again</a></li><li><a href="/c">About us</a></li></ul>')
    assert links(spark, three, pg.generic_links) == [
        ("Dev Alpha", "https://boards.example/a", "New York"), ("Dev Beta", "https://boards.example/b", ""),
        ("Dev Gamma", "https://boards.example/careers/9", "")]


def test_card_layout(spark):
    html = """<div class="job-list"><div><h3>Dev <b>One</b></h3><a href="?pid=1">open</a><span class="JobLocation">Oslo</span></div>
      <div><h3>Dev Two</h3><a href="/careers/2">open</a></div></div>
      <a href="/jobs/3"><div class="position-card"><h4>Dev Three</h4></div></a>"""
    assert links(spark, html, pg.card_links) == [
        ("Dev One", URL + "?pid=1", "Oslo"), ("Dev Two", "https://boards.example/careers/2", ""),
        ("Dev Three", "https://boards.example/jobs/3", "")]
    plain = '<li><a href="/jobs/1">Developer</a><b class="location">Oslo</b></li><li><a href="/jobs/2">Dev</a></li>'
    assert links(spark, plain, pg.card_links) == [("Developer", "https://boards.example/jobs/1", "Oslo")]


def test_texts(spark):
    html = """<html><head><title>t &amp; u</title><style>p{}</style></head><body><nav>menu</nav><!-- no --><p> One
two </p><script>var a = "<b>";</script><p>caf&eacute;</p><footer>end</footer></body></html>"""
    frame = pg.parsed_pages(spark.createDataFrame([(URL, html)], "url string, html string"))
    row = frame.select(pg.visible_text(F.col("page")).alias("t"), pg.page_description(F.col("page")).alias("d")).first()
    assert row.t == "t & u\nOne\ntwo\ncafé"
    assert row.d == "menu One\ntwo café end"
    long = "word " * 40
    places = f'<main>short</main><div class="job-description">tiny</div><article>{long}</article>'
    frame = pg.parsed_pages(spark.createDataFrame([(URL, places), (URL, places.replace(long, "x"))], "url string, html string"))
    got = [row[0] for row in frame.select(pg.page_description(F.col("page"))).collect()]
    assert got == [long.strip(), "short"]


def test_platform_and_company(spark):
    rows = [("https://boards.greenhouse.io/x", "<title>Jobs at Acme Co - home</title>"),
            ("https://jobs.lever.co/x", "<title>Acme Careers</title>"),
            ("https://acme.wd5.myworkdayjobs.com", '<meta property="og:site_name" content=" Acme "><title>x</title>'),
            ("https://www.x.org", "<p>powered by Clever</p>"), ("https://acme.org/jobs", "<p></p>"),
            ("https://a.org", """<meta property="og:site_name" content="Lowe's">"""),
            ("https://a.org", "<title>AT&amp;T &ndash; M&#252;ller&rsquo;s Jobs</title>"),
            ("https://acme-corp.com", ""), ("https://3m.com", "<p></p>")]
    frame = spark.createDataFrame(rows, "url string, html string")
    got = frame.select(pg.platform(F.col("url"), F.col("html")), pg.company_name(F.col("url"), F.col("html"))).collect()
    assert [tuple(row) for row in got] == [("greenhouse", "Acme Co"), ("lever", "Acme"), ("workday", "Acme"),
                                           ("lever", "Www"), ("generic", "Acme"),
                                           ("generic", "Lowe's"), ("generic", "AT&T – Müller’s"),
                                           ("generic", "Acme-Corp"), ("generic", "3M")]


def test_careers_import(spark):
    board = """<title>Jobs at Acme</title><ul><li><a href="/p/1">Software Dev</a></li><li><a href="/p/2">Cook here</a></li>
      <li><a href="/p/1">Software Dev twin</a></li><li><a href="/p/3">Software Lead</a></li></ul>"""
    boards = spark.createDataFrame([(1, URL, board)], "page_id long, url string, html string")
    details = spark.createDataFrame([(5, "https://boards.example/p/1", f"<article>{'go ' * 50}</article>"),
                                     (6, "https://boards.example/p/1", "<article>copy</article>"),
                                     (7, "https://boards.example/p/3", f"<article>{'agency ' * 30}</article>")],
                                    "page_id long, url string, html string")
    stored = spark.createDataFrame([], "id string, job_link string")
    rules = Rules(keywords=(("go", 8),), exclude_descriptions=("agency",))
    rows = import_careers(boards, details, stored, rules, F.lit("2026-01-02").cast("date")).collect()
    assert [(row.title, row.company, row.score, row.tier, row.job_link) for row in rows] == [
        ("Software Dev", "Acme", 8, "Match", "https://boards.example/p/1")]


def test_parsed_pages_hold_no_ancestor_lists(spark):
    pairs = 4000
    start = time.perf_counter()
    page = _Flattener(pg.MARKS).flat("<tr><td>" * pairs + '<a href="/careers/1">Dev One</a>')
    assert time.perf_counter() - start < 1
    assert len(page["elements"]) == 2 * pairs + 1
    assert not any(isinstance(value, list) and len(value) > 1 for element in page["elements"] for value in element.values())
    link = page["elements"][-1]
    assert (link["in_link"], link["in_box"]) == (-1, 2 * pairs - 2)
    assert link["inside"] == 1 << pg.MARKS.index(("tag", "tr"))
    # End tags without a start, on a deep page.
    start = time.perf_counter()
    _Flattener(pg.MARKS).flat("<div>" * pairs + "</p>" * pairs)
    assert time.perf_counter() - start < 1


def test_marks_of_ancestors_equal_a_walk_up(spark):
    html = """<ul class="job-board"><li class="x job"><div class="card"><a class="job" href="1">t</a></div></li></ul>
      <section class="careerlist posting-title"><h5>u<img><b class="location">v</b></h5><a href="2"><li>w</li></a></section><i>z</i>"""
    elements = _Flattener(pg.MARKS).flat(html)["elements"]

    def above(element):
        while element["parent"] >= 0:
            element = elements[element["parent"]]
            yield element
    for element in elements:
        up = list(above(element))
        bits = sum(1 << bit for bit, mark in enumerate(pg.MARKS) if any(_marked(other, *mark) for other in up))
        assert element["inside"] == bits
        assert element["in_link"] == next((other["no"] for other in up if other["tag"] == "a"), -1)
        assert element["in_box"] == next((other["no"] for other in up if other["tag"] in BOXES), -1)


def test_only_wanted_pages_are_parsed(spark, capsys):
    board = '<title>Jobs at Acme</title><ul>' + "".join(f'<li><a href="/p/{n}">Software Dev</a></li>' for n in range(4)) + "</ul>"
    boards = spark.createDataFrame([(1, URL, board)], "page_id long, url string, html string")
    details = spark.createDataFrame([(n, f"https://boards.example/p/{n}", f"<article>{'go ' * 50}{n}</article>") for n in range(9)],
                                    "page_id long, url string, html string")
    stored = spark.createDataFrame([("x", "https://boards.example/p/0")], "id string, job_link string")
    rows = pg.careers_postings(boards, details, stored, Rules())
    rows.explain()
    plan = capsys.readouterr().out
    # The plan is printed from the result downwards.
    assert 0 < plan.index("ArrowEvalPython") < plan.index("LeftSemi")
    assert "ArrowEvalPython" not in plan[plan.index("LeftSemi"):]
    assert sorted((row.job_link[-1], row.description[-1]) for row in rows.collect()) == [(n, n) for n in "123"]


def test_a_batch_of_pages_is_parsed_in_runs(spark):
    page = "<ul>" + '<li><a class="x" href="/jobs/1">Developer</a></li>' * 100 + "</ul>"

    def peak(count):
        pages = pd.Series([page] * count)
        tracemalloc.start()
        parsed = sum(len(run) for run in parsing.parsed_runs(iter([pages]), pg.MARKS))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert parsed == count
        return most
    assert peak(600) < 1.5 * peak(150)
    # The runs of a batch come back as the rows they belong to, null and empty pages and one longer than a run included.
    long = "<p>many</p>" * (parsing.RUN_CHARS // 10)
    texts = [None if at % 7 == 3 else "" if at % 7 == 4 else long if at == 50 else f"<p>page {at}</p>{page}" for at in range(120)]
    frame = spark.createDataFrame(list(enumerate(texts)), "page_id long, html string").coalesce(1)
    got = dict(pg.parsed_pages(frame).select("page_id", F.coalesce(F.get("page.texts", F.lit(0)), F.lit(""))).collect())
    assert got == {at: "" if not text else "many" if at == 50 else f"page {at}" for at, text in enumerate(texts)}


def test_pages_of_a_batch_become_strings_run_by_run(spark):
    # One sign beyond 16 bits makes a string take four bytes a character.
    page = '<p id="a" class="x y">' + "word " * 800 + "\U0001F600</p>"

    def peak(count):
        pages = pa.array([page, None, ""] * count)
        tracemalloc.start()
        parsed = sum(len(run) for run in parsing.parsed_arrays(iter([pages]), pg.MARKS))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert parsed == 3 * count
        return most
    assert peak(2000) < 1.5 * peak(300) < len(page) * 2000
    taken = []
    first = next(parsing.runs((taken.append(at) or "x" * 10 for at in range(100)), 50))
    assert (len(first), len(taken)) == (5, 5)
    # What Spark gets is the parser's own form, with every field.
    rows = pg.parsed_pages(spark.createDataFrame([(page,), (None,)], "html string").coalesce(1)).collect()
    wanted = [_Flattener(pg.MARKS).flat(html) for html in (page, None)]
    assert [row.page.asDict(recursive=True) for row in rows] == wanted
    assert wanted[0]["elements"][0]["attrs"] == {"id": "a", "class": "x y"}


def test_pages_reach_a_worker_in_small_batches(spark):
    @F.arrow_udf("long")
    def batch_bytes(texts: pa.Array) -> pa.Array:
        return pa.array([texts.nbytes] * len(texts), pa.int64())

    def largest(session):
        pages = session.range(0, 3000, numPartitions=1).select(F.repeat(F.lit("<p>word</p>"), 400).alias("html"))
        assert pg.parsed_pages(pages).select(F.size("page.texts").alias("texts")).distinct().collect() == [(400,)]
        return pages.select(F.max(batch_bytes("html"))).first()[0]
    # 13 MB of pages in one task; Spark would send them as one batch.
    assert largest(spark.newSession()) < 4 << 20
    # A session that has a bound keeps it.
    own = spark.newSession()
    own.conf.set(ARROW_BATCH, "8m")
    assert 7 << 20 < largest(own) < 10 << 20
    assert own.conf.get(ARROW_BATCH) == "8m"
