"""HTML extraction: depth, template inside the article, labels, copies, and a slow version of the counting."""

import random

from corpus_guard.llm.dom import Slot, fold, match, parse
from corpus_guard.llm.html_extract import extract_text


def texts(spark, rows):
    return {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_deep_pages(spark):
    inner = "<script>alert('leak')</script><nav>Menu</nav><p>text</p>"
    rows = [(1, "http://a.example", "<div>" * 160 + inner + "</div>" * 160), (2, "http://b.example", "<div>" * 20_000 + inner), (3, "http://b.example", "<b>" * 20_000 + "<p>x</p></i></p></b>" * 50)]
    assert texts(spark, rows) == {1: "text", 2: "text", 3: "\n\n".join("x" * 50)}


def test_template_inside_the_article_is_induced(spark):
    def html(i):
        return f"<body><article><h1>Title {i}</h1><p>Story {i} one.</p><p>Story {i} two &amp; <a href='/x'>link</a>.</p><div class='end'>Follow our channel for more</div><p>Read it daily</p></article></body>"

    rows = [(i, f"http://h.example/{i}", html(i)) for i in range(8)]
    assert texts(spark, rows) == {i: f"Title {i}\n\nStory {i} one.\n\nStory {i} two & link." for i in range(8)}
    assert texts(spark, rows[:3]) == {i: f"Title {i}\n\nStory {i} one.\n\nStory {i} two & link.\n\nFollow our channel for more\n\nRead it daily" for i in range(3)}


def test_near_copies_are_not_template(spark):
    paragraphs = "".join(f"<p>The paragraph number {j} of the one story.</p>" for j in range(9))
    rows = [(i, "http://h.example/", f"<article><h1>Copy {i}</h1>{paragraphs}</article>") for i in range(9)]
    got = texts(spark, rows)
    assert all(got[i].startswith(f"Copy {i}\n\n") and got[i].count("paragraph") == 9 for i in range(9))


def test_labels(spark):
    keep = ["side-effects", "alert-level", "social-history", "form-of-government", "related-work", "research", "header-image-story", "commentary"]
    drop = ["ad", "top-ad", "sidebar", "comments", "comment-list", "cookie-notice", "site-footer", "ads-box", "newsletter", "main-menu"]
    html = "".join(f"<div class='x {c}'>{c} text</div>" for c in keep + drop)
    rows = [(1, "u", f"<body>{html}</body>"), (2, "http://z.example", "<article><p>a</p><article class='comment'>b</article><section id='comments'>c</section><p style='display: none'>d</p></article>")]
    assert texts(spark, rows) == {1: "\n\n".join(f"{c} text" for c in keep), 2: "a"}


def test_wide_pages(spark):
    html = "<article>" + "".join(f"<h2>h{i}</h2><p>p{i} <!-- x --><i>it</i></p>" for i in range(5_000)) + "</article>"
    got = texts(spark, [(i, "http://w.example", html.replace("p7 ", f"p7 {i} ")) for i in range(2)])
    assert got[1].count("\n\n") == 9_999


def test_matching_is_the_largest(spark):
    def brute(x: Slot, y: Slot) -> int:
        def best(i, j):
            if i == len(x.kids) or j == len(y.kids):
                return 0
            both = brute(x.kids[i], y.kids[j]) + best(i + 1, j + 1) if x.kids[i].key == y.kids[j].key else 0
            return max(both, best(i + 1, j), best(i, j + 1))

        return 1 + best(0, 0)

    r = random.Random(4)

    def tree(depth):
        tags = r.sample(["div", "ul", "section", "p", "table"], r.randrange(5)) if depth else []
        return "".join(f"<{t}>{tree(depth - 1)}</{t}>" for t in tags)

    for _ in range(200):
        a, b = fold(parse(tree(3))), fold(parse(tree(3)))
        got = match(a[0], b[0])
        assert len(got) == brute(a[0], b[0])
        parent = {k.id: s.id for s in b for k in s.kids}
        theirs = {k.id: s.id for s in a for k in s.kids}
        assert all(y == 0 or got[parent[y]] == theirs[x] for y, x in got.items()) and len(set(got.values())) == len(got)


def test_headings_of_the_article_stay(spark):
    page = lambda i: f"<body><nav>menu</nav><article><h1>Dish {i}</h1><h2>Ingredients</h2><p>{i} eggs and {i} cups</p><h2>Method</h2><p>Stir for {i} minutes</p><h3>Follow our channel</h3></article></body>"
    rows = [(i, "http://cook.example/x", page(i)) for i in range(8)]
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Dish {i}\n\nIngredients\n\n{i} eggs and {i} cups\n\nMethod\n\nStir for {i} minutes" for i in range(8)}
