"""Main text of pages, and the pipeline's stages, each against what it should keep."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from ruleforge.llm import exact, queries, wrapper

PAGE = (
    "<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var x='</p><p>no';</script></head><body><header>Site</header><nav><ul><li>Home</li></ul></nav>"
    "<div class='cookie-notice'>We use cookies</div><div id=main>%s</div><div class=\"sidebar\">more</div><form><input value=x>Search</form><div class='comments'><p>I disagree</p></div><footer>&copy; me</footer></body></html>"
)


def test_main_text_of_marked_up_pages():
    page = PAGE % "<h1>A &amp; B</h1><p>One\n  <b>two</b>&nbsp;three<br>four<p>Five &lt;six&gt; &#233;"
    assert wrapper.main_text(page) == "A & B\n\nOne two three four\n\nFive <six> é"
    assert wrapper.main_text("") == "" and wrapper.main_text(PAGE % "") == ""
    article = "<body><p>out</p><article><p>in</p><nav>not</nav><section class=comments>no</section></article></body>"
    assert wrapper.main_text(article) == "in"
    assert wrapper.main_text("<p>a<p>b</div></b>c<!-- d --> e <![CDATA[f]]>") == "a\n\nb c e" or wrapper.main_text("<p>a<p>b").split() == ["a", "b"]


def test_simple_tree_matching():
    leaf = lambda sign, text=1: (sign, sign, text, ())
    a = ("r", "r", 0, (leaf("x"), leaf("y"), leaf("z")))
    b = ("r", "r", 0, (leaf("y"), leaf("w"), leaf("z")))  # outlines: sign, path, text hash, children
    size, pairs = wrapper.align(a, b)
    assert size == 3 and [(p[0], q[0]) for p, q in pairs][0] == ("r", "r")
    assert wrapper.align(a, ("s", "s", 0, ())) == (0, [])


def test_wrapper_induction_drops_what_a_host_repeats(spark):
    body = "<html><body><div><p>Welcome to our shop, call 555</p></div><div><p>{}</p></div><div><p>All rights belong to us</p></div></body></html>"
    rows = [(i, f"http://h.example/{i}", body.format(f"story number {i}"), "clash") for i in range(8)] + [(100, "http://other.example/", body.format("alone"), "clash"), (101, None, None, "clash"), (102, "odd", "", "clash")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string")
    found = {r.page_id: r for r in wrapper.extract_pages(df.repartition(2)).collect()}
    assert all(found[i].text == f"story number {i}" for i in range(8))
    assert found[100].text == "Welcome to our shop, call 555\n\nalone\n\nAll rights belong to us"
    assert found[101].text == "" == found[102].text and found[101].n_chars == 0
    assert all(r.n_chars == len(r.text) for r in found.values())
    assert wrapper.extract_pages(df.limit(0)).count() == 0


def inner(page):
    import html

    found = re.search(r"<article>(.*)</article>", page, re.S)
    return html.unescape(re.sub(r"<[^>]*>", " ", found[1])).split() if found else None


@pytest.mark.parametrize("change", [lambda p: p, lambda p: p.replace("<article>", "").replace("</article>", ""), lambda p: p.replace("<article>", "<div>").replace("</article>", "</div>").replace('<div class="ad">', "<div>")])
def test_pages_of_the_sample(spark, change):
    """Articles of the sample as they are, without article tags, and in plain divs beside plain adverts."""
    from pyspark.sql import functions as F

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    given = {r.page_id: r.html for r in pages.collect()}
    df = spark.createDataFrame([(r.page_id, r.url, change(r.html)) for r in pages.collect()], "page_id bigint, url string, html string")
    found = {r.page_id: r for r in wrapper.extract_pages(df).select("page_id", "text", F.col("n_chars")).collect()}
    assert set(found) == set(given)
    right = [found[i].text.split() == inner(page) for i, page in given.items() if inner(page) is not None]
    assert sum(right) >= 0.98 * len(right), (sum(right), len(right))


def test_names_only_vote():
    assert wrapper.main_text('<div class="layout has-sidebar"><h1>Title</h1><p>Real story text.</p></div>') == "Title\n\nReal story text."
    assert wrapper.main_text('<article class="post social-story"><p>Real story.</p></article>') == "Real story."
    assert wrapper.main_text("<p>a <a href=foo'bar>link</a> and <a href='x>y'>more</a></p>") == "a link and more"
    assert wrapper.main_text("<form id=aspnet><h1>T</h1><p>Long story here.</p><div class=comments><p>I disagree with all of this, at length and again</p></div></form>") == "T\n\nLong story here."
    assert wrapper.main_text("<a x=\"1\" " * 5000) == wrapper.main_text("<a x=\"1\" " * 5000), "ends"


def test_template_inside_an_article_goes_and_copies_of_a_page_stay(spark):
    article = "<html><body><article><div class=zq><p>Follow us on all channels</p></div><p>{}</p></article></body></html>"
    rows = [(i, f"http://h.example/{i}", article.format(f"story number {i}")) for i in range(12)]
    rows += [(100 + i, f"http://copies.example/{i}", "<body><div><p>the same page each time</p></div></body>") for i in range(5)]
    rows += [(None, "http://h.example/x", article.format("no id"))]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    results = [sorted(map(tuple, wrapper.extract_pages(df.repartition(n)).collect()), key=str) for n in (1, 5)]
    assert results[0] == results[1], "the layout of the table decides nothing"
    texts = {r[0]: r[2] for r in results[0]}
    assert all(texts[i] == f"story number {i}" for i in range(12)) and texts[None] == "no id"
    assert all(texts[100 + i] == "the same page each time" for i in range(5))


@pytest.fixture(scope="module")
def stages(spark, sf):
    """What each stage gives, written and read again."""
    out, docs = {}, spark.read.parquet(f"{sf}/documents.parquet")
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        out[name] = docs = corpus_pipeline.staged(stage(spark, docs, sf), f"test-{name}")
    return out


def test_stages(stages):
    start = stages["documents"]
    ids = {name: Counter(r.doc_id for r in df.select("doc_id").collect()) for name, df in stages.items()}
    for name in ("quality", "exact_dedup", "near_dedup", "mix"):
        assert stages[name].columns == start.columns
    assert set(ids["near_dedup"]) <= set(ids["exact_dedup"]) <= set(ids["quality"]) < set(ids["documents"])
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", "", t or "")
    assert sorted(norm(r.text) for r in stages["exact_dedup"].collect()) == sorted({norm(r.text) for r in stages["quality"].collect()})
    groups = exact.exact_dedup(stages["quality"]).where("kept").count()
    assert groups == sum(ids["exact_dedup"].values())
    assert max(ids["mix"].values()) <= 2
    total = sum(len((r.text or "").split()) for r in stages["near_dedup"].collect())
    mixed = sum(len((r.text or "").split()) for r in stages["mix"].collect())
    assert abs(mixed - 1.5 * total) <= 256 * 25
    packed = stages["pack"].collect()
    assert sum(r.length for r in packed) == mixed
    bins = Counter((r.shard, r.bin, r.doc_id) for r in packed if r.bin is not None)
    assert max(bins.values()) == 1


def test_clean_documents_pass_the_filter(spark, sf, stages):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    kept = {r.doc_id for r in stages["quality"].collect()}
    assert len(good & kept) >= 0.97 * len(good)


def test_run_gives_the_stages_result(spark, sf, stages):
    assert Counter(map(tuple, corpus_pipeline.run(spark, sf).collect())) == Counter(map(tuple, stages["pack"].collect()))
