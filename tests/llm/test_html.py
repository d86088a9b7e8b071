"""Page parsing, the labeller on held-out pages, and extraction."""

from __future__ import annotations

import html
import itertools
import re

import numpy as np
import pytest

from innsight.llm import html_text
from innsight.llm.html_blocks import leaf_blocks
from innsight.llm.html_training import labelled_pages
from innsight.llm.tables import read_table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def field():
    return html_text.train_field(labelled_pages(html_text.TRAINING_PAGES))


def test_blocks():
    page = (
        "<!DOCTYPE html><head><title>no</title><style>p{}</style><script>var t='</p>';</script></head><body>"
        "<!-- no <p>no</p> --><nav class='topMenu'><ul><li><a href=x>one<li><a>two</a></ul></nav>"
        '<article id="main"><p title="a>b">Foo<br>bar &nbsp; &amp;amp; baz<p>a < b <b>bold<p>next</article>tail &copy'
    )
    blocks = leaf_blocks(page)
    assert [b.text for b in blocks] == ["one", "two", "Foo bar &amp; baz", "a < b bold", "next", "tail ©"]
    assert [b.leaf for b in blocks] == ["li", "li", "p", "p", "p", "body"]
    assert {"nav", "#menu", "a"} <= blocks[0].marks and blocks[0].linked == 3
    assert {"article", "#main"} <= blocks[3].marks and "article" not in blocks[5].marks


def test_foreign_and_verbatim_elements_keep_their_text():
    texts = lambda page: [b.text for b in leaf_blocks(page)]
    # closed in the start tag: nothing after it is lost
    assert texts("<article><p>a <svg class='i'/> b<p>c <math/> d</article><p>e") == ["a b", "c d", "e"]
    assert texts("<p>a <svg><title/><path d='M0'/><script href='x'/></svg> b<p>c") == ["a b", "c"]
    # nested, and never closed
    assert texts("<p>a <svg><svg><text>b</text></svg> <text>c</text></svg> d<p>e") == ["a b c d", "e"]
    assert texts("<p>a <svg><path d='M0'><p>b") == texts("<p>a <noscript><p>b") == texts("<p>a <template><p>b") == ["a", "b"]
    assert texts("<p>let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be") == ["let x=1 be"]
    # the content of xmp is text, tags and references too
    assert texts("<p>a<xmp>if x < 1 &amp; <b>y</b></xmp>b") == ["a", "if x < 1 &amp; <b>y</b>", "b"]
    assert texts("<xmp>never closed") == ["never closed"] and texts("<xmp></xmp><xmp> </xmp>a") == ["a"]
    # these stay out
    assert texts("<p>a<script>x</script><style>x</style><textarea>x</textarea><iframe>x</iframe><title>x</title><script/>x</script>b") == ["ab"]


def test_article_with_pictures_and_formulas_is_whole(field):
    words = "The committee met again on Tuesday and discussed the plans for the new bridge over the river."
    page = f"<html><body><article><h1>Bridge plans</h1><p>{words}</p><p>{words} <svg width='1'/></p><p>{words} <math><mi>x</mi></math></p><p>{words}</p></article></body></html>"
    assert html_text.main_text(page, field) == "\n\n".join(["Bridge plans", words, words, words + " x", words])


def test_every_cut_of_a_page_is_read():
    page, _ = labelled_pages(1, seed=5)[0]
    for cut in range(len(page)):
        leaf_blocks(page[:cut])
    assert leaf_blocks("") == [] and leaf_blocks("<p") == [] and leaf_blocks("</p></x>") == []
    assert [b.text for b in leaf_blocks("<" * 50 + " text")] == ["<" * 50 + " text"]
    assert len(leaf_blocks("<div>" * 20_000 + "x" + "</div>" * 20_000)) == 1


def test_viterbi_is_the_best_labelling(field):
    page, _ = next(p for p in labelled_pages(50, seed=6) if 5 <= len(p[1]) <= 10)
    blocks = leaf_blocks(page)
    score = [
        sum(field.weights[field.number[f]] for f in html_text.block_features(b, t, len(blocks)) if f in field.number)
        for t, b in enumerate(blocks)
    ]

    def total(labels):
        return field.first[labels[0]] + sum(s * y for s, y in zip(score, labels, strict=True)) + sum(
            field.pairs[a, b] for a, b in itertools.pairwise(labels)
        )

    best = max(itertools.product((0, 1), repeat=len(blocks)), key=total)
    assert np.isclose(total([int(x) for x in field.decode(blocks)]), total(best))


def test_held_out_pages(field):
    wrong = blocks = 0
    for page, labels in labelled_pages(200, seed=77):
        got = field.decode(leaf_blocks(page))
        wrong += sum(a != b for a, b in zip(got, labels, strict=True))
        blocks += len(labels)
    assert wrong / blocks < 0.01


def test_pages_table(spark):
    """On the pages table the main text is exactly what stands in the article element."""
    found = {r.page_id: r for r in html_text.op9_html_text(spark, SF).collect()}
    pages = read_table(spark, SF, "pages").collect()
    assert len(found) == len(pages)
    for p in pages:
        article = re.search(r"<article>(.*?)(</article>|\Z)", p.html, re.DOTALL)[1]
        texts = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        expected = "\n\n".join(t for t in texts if t)
        r = found[p.page_id]
        assert (r.text, r.n_chars, r.url) == (expected, len(expected), p.url)


def test_cases(spark, field):
    pages = [
        (1, None), (2, ""), (3, "<nav><a href=x>menu</a></nav>"), (None, "<article><p>Some words here.</p></article>"),
        (4, "<article><p>" + "long text " * 30_000 + "</p></article>"), (4, "<article><p>Twice.</p></article>"), (4, "<article><p>Twice.</p></article>"),
    ]
    df = spark.createDataFrame([(i, p, "u") for i, p in pages], "page_id long, html string, Text2 string")
    out = html_text.with_main_text(df, into="text", field=field)
    assert out.columns == ["page_id", "html", "Text2", "text"]
    texts = [r.text for r in out.collect()]
    assert texts[:4] == ["", "", "", "Some words here."] and len(texts[4]) == 299_999 and texts[5:] == ["Twice.", "Twice."]
    assert html_text.with_main_text(df.filter("1 = 0"), field=field).count() == 0


@pytest.mark.parametrize(
    ("html", "texts"),
    [
        ("<article><p>a<!-->b<p>c</article>", ["ab", "c"]),
        ("<p>a<!--->b<p>c", ["ab", "c"]),
        ("<p>a<!-- x --!>b<p>c", ["ab", "c"]),
        ("<p>a<!-- > -> x -->b", ["ab"]),
        ("<p>a<!---->b", ["ab"]),
        ("<p>a<!-- never closed <p>c", ["a"]),
    ],
)
def test_comments_end_as_in_the_standard(html, texts):
    assert [b.text for b in leaf_blocks(html)] == texts
