"""Every page is differenced with its nearest URL; landmarks check what that leaves."""

from strandlab.llm import htmltext


def test_marked_pages_are_differenced_and_checked(spark):
    page = lambda *lines, out="": f"<body><nav>Menu</nav>{out}<article>{''.join(f'<p>{t}</p>' for t in lines)}</article></body>"
    rows = [
        (1, "https://h.com/a/1", page("first", "only one")),
        (2, "https://h.com/a/2", page("second", "only two")),  # differencing is right as it is
        (3, "https://h.com/b/1", page("third", "a sentence of both", "own")),
        (4, "https://h.com/b/2", page("fourth", "a sentence of both", out="<div>not of the article</div>")),  # a line is restored, one dropped
        (5, "https://c.com/1", page("copy")),
        (6, "https://c.com/2", page("copy")),  # copies lose nothing
        (7, "https://alone.com/", page("alone")),  # no neighbour
        (8, "https://d.com/1", "<main><p>own text</p><article><p>a card of the whole site</p></article><article><p>another</p></article></main>"),
        (9, "https://d.com/2", "<main><p>other text</p><article><p>a card of the whole site</p></article><article><p>another</p></article></main>"),  # cards are longer, but shared
    ]
    got = {r.page_id: r for r in htmltext.extracted(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)).collect()}
    assert {i: r.text for i, r in got.items()} == {1: "first\nonly one", 2: "second\nonly two", 3: "third\na sentence of both\nown", 4: "fourth\na sentence of both", 5: "copy", 6: "copy", 7: "alone", 8: "own text", 9: "other text"}
    assert {i: r.how for i, r in got.items()} == {1: "difference", 2: "difference", 3: "landmark", 4: "landmark", 5: "difference", 6: "difference", 7: "landmark", 8: "difference", 9: "difference"}


def test_repeated_rows_and_odd_text(spark):
    html = "<article><p>one &#x1F600; &#xD800;   x</p><p>two</p></article>"
    rows = [(1, "https://h.com/a", html)] * 5 + [(None, None, None), (2, "https://h.com/b", "")]
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in htmltext.extracted(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect())
    text = "one \U0001f600 � x\ntwo"
    assert got == [(0, "", 0)] + [(1, text, len(text))] * 5 + [(2, "", 0)]
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert htmltext.extracted(empty).collect() == []
