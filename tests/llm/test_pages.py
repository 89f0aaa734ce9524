"""Main text of pages: landmarks, names, made-up sites against what they were made of, and long pages in linear time."""

import random
import time

import pytest

from tessella.llm.html_text import Page, main_text

CASES = [
    ("<main><h1>Title</h1><p>Intro</p><article><p>Inset</p></article><p>Outro</p></main>", "Title\nIntro\nInset\nOutro"),
    ("<div><h1>T</h1><p>A body of some length</p></div><article class='teaser'><p>Teaser</p></article>", "T\nA body of some length"),
    ("<article><h1>T</h1><p>A body of some length</p></article><div>Other</div>", "T\nA body of some length"),
    ("<article><p>One of two</p></article><article><p>Two of two</p></article>", "One of two\nTwo of two"),
    ("<article><div class='share-price'>Up</div><div class='recipe-menu'>Soup</div><p class='dialog'>Hi</p><div class='share-buttons'>Tell all</div></article>", "Up\nSoup\nHi"),
    ("<main><header><h1>Head</h1></header><p>Text</p></main><header>Site</header>", "Head\nText"),
    ("<body><header>Site</header><p><a href='x'>A paragraph that is a link</a></p><p>Text</p><ul><li><a href='y'>Menu</a></ul>", "A paragraph that is a link\nText"),
    ("<div role='dialog'>Join</div><div role='main'><p>Text</p></div>", "Text"),
    ("<article>A<div class='has-sidebar'>B</div><div class='cookie-notice'>C</div><div id='sidebar_left'>D</div></article>", "A\nB"),
    ("<table><tr><td>a<td>b<tr><td>c</table><ul><li>d<li>e</ul></b></x>f", "a\nb\nc\nd\ne\nf"),
    ("<p>one<div>two<p>three</div>four", "one\ntwo\nthree\nfour"),
    ("<p>a<button><p>no</button>b", "a\nb"),
    ("", ""), ("<", "<"), ("<!-- x", ""), ("<p", ""), ("a &lt; b &amp;amp; &#x41;&nbsp;c", "a < b &amp; A c"),
]


@pytest.mark.parametrize("source, text", CASES)
def test_page(source, text):
    assert Page(source).text() == text


@pytest.mark.parametrize("source", ["<div><p>x" * 110_000, "<div>" * 100_000 + "</no>" * 100_000, "<span>" * 160_000, "<p><button>" + "<div>y" * 150_000, "<li><b>" * 140_000, "<td>" * 250_000, "<a href='" * 100_000, "</p>" * 250_000, "<x" * 400_000, "<!--" * 250_000])
def test_long_pages(source):
    began = time.process_time()
    Page(source).text()
    assert time.process_time() - began < 8  # 2 s at most on a machine that has nothing else to do


def test_made_up_sites(spark):
    """Sites of plain tags: a frame of their own that repeats, and articles that do not. The frame goes, the articles stay."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(3, 8)))
    line = lambda n: " ".join(word() for _ in range(n))
    rows, expected = [], {}
    for site in range(4):
        entries = [line(2) for _ in range(12)]
        frame = {side: [line(4) for _ in range(3)] for side in "ab"}
        for page in range(25):
            body = [line(rng.randint(4, 30)) for _ in range(rng.randint(2, 7))]
            block = "".join(f"<p>{t}</p>" for t in body)
            wrap = [f"<section>{block}</section>", f"<div><div>{block}</div></div>", f"<main><h2>{body[0]}</h2>" + "".join(f"<p>{t}</p>" for t in body[1:]) + "</main>"][site % 3]
            menu = "".join(f"<p>{t}</p>" for t in rng.sample(entries, 6))
            source = f"<body><div class='k{site}'>{menu}</div>{wrap}<div class='z'>" + "".join(f"<p>{t}</p>" for t in frame["ab"[page % 2]]) + "</div></body>"
            key = site * 100 + page
            rows.append((key, f"https://site{site}.example/{page}", source, "extra"))
            expected[key] = "\n".join(body)
    df = spark.createDataFrame(rows, "page_id long, url string, html string, cut string").repartition(5)
    got = {r["page_id"]: r["text"] for r in main_text(df).collect()}
    plain = {k: Page(h).text() for k, _, h, _ in rows}
    taken = sum(plain[k] != got[k] for k in got)
    print(f"the tree took blocks from {taken} of {len(got)} pages")
    assert got == expected and taken >= 75
