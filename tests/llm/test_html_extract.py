"""Main text against the planted articles, a plain Viterbi and pages in plans the sample lacks."""

import html as entities
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import types as T

from quotelake.llm.html_extract import _labelled, extract, main_text, planned_page, train, training_pages
from quotelake.llm.htmlblocks import read_page
from quotelake.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def article(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", re.sub("<br>", " ", re.sub("</?b>", "", inner)))
    return "\n\n".join(x for x in (" ".join(entities.unescape(p).split()) for p in parts) if x)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{SF}/pages.parquet").collect()


@pytest.fixture(scope="module")
def model(pages):
    return train(training_pages([p["html"] for p in pages[:25]]))


def test_held_out_pages(model, pages):
    assert all(main_text(model, p["html"]) == article(p["html"]) for p in pages[25:])


def test_query(spark, pages):
    got = {r["page_id"]: r for r in QUERIES["op5_html_extract"](spark, SF).collect()}
    assert len(got) == len(pages)
    for p in pages:
        assert got[p["page_id"]]["text"] == article(p["html"])
        assert (got[p["page_id"]]["url"], got[p["page_id"]]["n_chars"]) == (p["url"], len(article(p["html"])))


def test_unseen_plans(model):
    rng, right, total = random.Random(5), 0, 0
    short = ["Home", "Read more", "Über uns", "A short line"]
    long = ["A rather long paragraph of text with many words in it, which goes on for a while and ends.",
            "Noch ein langer Absatz mit vielen Wörtern, der ebenso gut ein Kommentar sein könnte."]
    for _ in range(200):
        page, mark = planned_page(rng, short, long)
        blocks, labels = _labelled(page, (mark,))
        right += sum(a == b for a, b in zip(model.decode(blocks), labels, strict=True))
        total += len(labels)
    assert right / total > 0.95


def test_viterbi_is_the_best_path(model, pages):
    for p in pages[:10]:
        blocks = read_page(p["html"]).blocks[:9]
        e = model.scores(blocks)
        score = lambda y: model.start[y[0]] + sum(e[i, k] for i, k in enumerate(y)) + sum(
            model.step[a, b] for a, b in itertools.pairwise(y))
        best = max(itertools.product((0, 1), repeat=len(blocks)), key=score)  # every path
        assert np.isclose(score(best), score(model.decode(blocks)))


def test_blocks_of_broken_markup():
    page = read_page("<p>a<b>b<p>c&amp;d &copy <li>x<li>y<div>z</p>w<script>var t='</p>'</script><td>q</html>tail <a href=u>l")
    assert [b.text for b in page.blocks] == ["ab", "c&d ©", "x", "y", "z", "w", "q", "tail l"]
    assert page.links == [("a", "u")]


def test_nulls_repeats_and_empty(spark, model):
    schema = T.StructType([T.StructField(c, t) for c, t in (
        ("page_id", T.LongType()), ("url", T.StringType()), ("html", T.StringType()), ("text", T.StringType()))])
    page = "<article><p>Alpha  beta\n gamma.</p></article><footer>no</footer>"
    rows = [(1, None, None, "x"), (2, "u", "", "x"), (None, "u", page, None), (3, "u", page, "y"), (3, "u", page, "y"),
            (4, "u", f"<article>{'<p>word two.</p>' * 20_000}</article>", None), (5, "u", "no markup", None)]
    got = extract(spark.createDataFrame(rows, schema), model).collect()
    want = ["", "", "Alpha beta gamma.", "Alpha beta gamma.", "Alpha beta gamma.", "\n\n".join(["word two."] * 20_000)]
    assert [r["text"] for r in sorted(got, key=lambda r: rows.index(next(x for x in rows if x[0] == r["id"])))][:6] == want
    assert extract(spark.createDataFrame([], schema)).collect() == []
    assert len(extract(spark.createDataFrame([(1, None, None, None)], schema)).collect()) == 1


ICONS = [
    '<svg class="icon"/>', "<svg/>", "<SVG a='>' hidden />", "<math/>", "<svg><svg/><svg><path d='x'/></svg>no</svg>",
    "<svg class=icon/>no</svg>", "<object>no<object>no</object>no</object>", "<svg><!-- <svg> -->no</svg>",
    "<object><script>'<object>'</script>no</object>", "<object>no<object>no</object>", "<template><template>no</template>no</template>",
]


@pytest.mark.parametrize("icon", ICONS)
def test_silent_elements_end_where_they_end(icon):
    page = read_page(f"<p>one {icon}two</p><p>three <a href=u>l</a></p>")
    assert [b.text for b in page.blocks] == ["one two", "three l"] and page.links == [("a", "u")]


def test_article_after_icons(model, pages):
    for page in pages[25:40]:
        with_icons = page["html"].replace("<article>", '<article><svg class="icon"/><object><object></object>x</object>').replace("</p>", "<math/></p>")
        assert main_text(model, with_icons) == article(page["html"])


@pytest.mark.parametrize("html", [
    "<p class=don't>Hello</p>", '<p><img alt="5" wide">Hello</p>', "<p title='a > b' x>Hello</p>", '<p title = "a > b">Hello</p>',
    '<p "odd">Hello</p>', "<p a='1'b=\"2\">Hello</p>", "<p onclick=\"f('<b>')\">Hello</p>", "<p =>Hello</p>", "<p data-x='it\"s'>Hello</p>"])
def test_stray_quotes_are_no_text(html):
    assert [b.text for b in read_page(html).blocks] == ["Hello"]


def test_the_driver_gets_chosen_pages_only(spark, pages):
    from quotelake.llm.html_extract import fit

    some = [p for p in pages if p["html"]][:30]
    df = spark.createDataFrame([(p["page_id"], p["html"]) for p in some] * 3, "page_id long, html string")
    once = fit(df.limit(0).union(spark.createDataFrame([(p["page_id"], p["html"]) for p in some], df.schema)), limit=10)
    assert all(np.allclose(a, b) for a, b in zip(vars(fit(df, limit=10)).values(), vars(once).values()) if isinstance(a, np.ndarray))
