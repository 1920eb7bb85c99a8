"""Main text of hand-made pages."""

from ledgerlens.llm.html_extract import extract, main_text

LONG = "A sentence of some length that stands for the body of the article, with commas and all. " * 3


def test_article_without_what_surrounds_it():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
    <header><h2>Site name</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies {LONG}</div>
    <article><header><h1>Head &amp; line</h1></header><p>{LONG}</p><div class="ad">Buy {LONG}</div><p>Short.</p>
    <ul><li>one<li>two</ul><p>a<br>b&nbsp;&eacute; <b>bold</b>er</p><form><input>Send</form></article>
    <section id="comments"><p>{LONG}</p></section><aside>{LONG}</aside><footer>&copy; {LONG}</footer></body></html>"""
    assert main_text(page) == "\n".join(["Head & line", LONG.strip(), "Short.", "one", "two", "a b é bolder"])


def test_unclosed_elements_and_an_unfinished_end():
    assert main_text(f"<article><h1>T</h1><p><b>x<br><p>{LONG}</p><p>rest &amp; mo") == f"T\nx\n{LONG.strip()}\nrest & mo"
    assert main_text(f"<article><p>{LONG}</p><p>more<a hre") == f"{LONG.strip()}\nmore"


def test_page_without_an_article_element():
    links = "".join(f"<div><a href='/{i}'>Link {i}</a></div>" for i in range(30))
    page = f"<body><div class='top'>{links}</div><div><h1>Title</h1><p>{LONG}</p><p>Hm.</p><p>{LONG}</p></div><div>{links}</div></body>"
    assert main_text(page) == f"Title\n{LONG.strip()}\nHm.\n{LONG.strip()}"


def test_teaser_articles_beside_the_main_text():
    cards = "".join(f"<article><a href='/{i}'><h3>Card {i}</h3></a></article>" for i in range(6))
    page = f"<body><main><div><h1>Title</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div></main><div>{cards}</div></body>"
    assert main_text(page) == f"Title\n{LONG.strip()}\nShort.\n{LONG.strip()}"


def test_short_blocks_between_and_beside_content_stay():
    links = "".join(f"<div><a href='/{i}'>Link {i}</a></div>" for i in range(9))
    page = f"""<body><div>{links}</div><div><div><p>{LONG}</p></div><div><p>Short.</p></div><div><p>{LONG}</p></div>
    <div><p>The end.</p></div>{links}</div></body>"""
    assert main_text(page) == f"{LONG.strip()}\nShort.\n{LONG.strip()}\nThe end."


def test_wrappers_that_only_mention_clutter():
    for name in ("content has-sidebar", "no-comments", "page-with-nav", "sidebar-layout"):
        assert main_text(f"<div class='{name}'><p>{LONG}</p></div><div class='sidebar-left'>{LONG}x</div>") == LONG.strip()


def test_rows_without_text(spark):
    rows = [(1, "u", None, 1), (2, None, "", 1), (None, "u", "<p>x", 1), (3, "u", "<script>x</script>", 1), (3, "u", "plain", 1), (3, "u", "plain", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    found = sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in extract(df).collect())
    assert found == [("1", "", 0), ("2", "", 0), ("3", "", 0), ("3", "plain", 5), ("3", "plain", 5), ("None", "x", 1)]
    assert extract(df.limit(0)).count() == 0


def test_very_long_and_deep_pages():
    assert main_text("<div>" * 3000 + LONG) == LONG.strip()
    text = "word " * 200_000
    assert main_text(f"<article><p>{text}</p></article>") == text.strip()
