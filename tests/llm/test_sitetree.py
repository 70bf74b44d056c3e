from pyspark.sql import functions as F

from tessera.llm import sitetree as S

KEEP = lambda path: 1.0


def text(html):
    return S.extract_text(html, KEEP)


def test_article():
    page = """<html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body><header>head</header><nav><ul><li><a href=/>m</a></ul></nav>
    <div class="ad">buy</div><article><header><h1>Title &amp; more</h1></header><p>One <b>two</b>
    three<br>four<p>Five &#233;<div class="notice">note</div><form>f</form><section class="comments"><p>reader</p></section></article><aside>s</aside><footer>foot</footer>"""
    assert text(page) == "Title & more\nOne two three four\nFive é"


def test_edges():
    assert text(None) == "" and text("") == "" and text("<p>") == ""
    assert text("plain") == "plain"
    assert text("<article><p>a < b and <3</p></article>") == "a < b and <3"
    assert text("<article><p>open") == "open"
    assert text("<!-- c --><article>x<script>never") == "x"
    assert text("<div>" * 3000 + "deep") == "deep"


def test_unmarked_noise_is_learned(spark):
    page = "<body><div class='x1'><ul><li>Home</li><li>About</li></ul></div><div class='x2'><p>Story {0} of many {1}</p>{2}</div></body>"
    rows = [(i, f"http://h.org/{i}", page.format(i, i * 7, "".join(f"<p>more {i} {j}</p>" for j in range(i % 5)))) for i in range(40)]
    rows += [(100, None, None), (101, "http://h.org/1", rows[1][2]), (102, "::bad", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "page_id AS host", "page_id AS path")
    got = {r.page_id: r.main_text for r in S.extract(pages).collect()}
    joined = {r.page_id: r.main_text for r in S.extract(pages, most_paths=0).collect()}
    assert got == joined and len(got) == 43
    assert got[3].startswith("Story 3 of many 21") and "Home" not in got[3]
    assert got[100] == "" and got[102] == "" and got[101] == got[1]


def test_copies_count_once(spark):
    rows = [(i, "http://h.org/", "<body><div class='c'><p>the same story in every copy</p></div></body>") for i in range(50)]
    out = S.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).select("main_text").distinct().collect()
    assert [r.main_text for r in out] == ["the same story in every copy"]


def test_trees_judge_pages_without_marks(spark):
    """Pages as the driver makes them, with every tag and class that tells what a branch is taken away."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", F.lit("http://one.org/").alias("url"), "html")
    want = {r.page_id: r.main_text for r in S.extract(pages).collect()}
    # Footers go, for of one host their lines would vary with the hosts' names.
    plain = F.regexp_replace(F.regexp_replace("html", "<footer>.*</footer>", ""), "<(/?)nav>", "<$1section>")
    for tag, own in (("article", "k1"), ("div class=\"ad\"", "k2")):
        plain = F.regexp_replace(plain, f"<{tag}>", f'<div class="{own}">')
    plain = F.regexp_replace(plain, "</article>", "</div>")
    bare = pages.withColumn("html", plain)
    got = {r.page_id: r.main_text for r in S.extract(bare).collect()}
    without = {r.page_id: text(r.html) for r in bare.collect()}
    same = [i for i in want if got[i] == want[i]]
    assert len(same) > 0.97 * len(want) and sum(without[i] != got[i] for i in want) > 0.97 * len(want)


def test_repeated_notices_of_an_article_go(spark):
    page = "<body><article><h1>Story {0}</h1><p>All about {0}, and {1} more</p><div class='z9'>The same line on every page</div>{2}</article></body>"
    rows = [(i, "http://h.org/", page.format(i, i * 3, "<p>more</p>" * (i % 3))) for i in range(60)]
    got = {r.page_id: r.main_text for r in S.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[7] == "Story 7\nAll about 7, and 21 more\nmore"


def test_no_pages(spark):
    assert S.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
