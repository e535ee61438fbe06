import pytest

from gridmap.llm import html_main as H

CASES = [
    (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"),
    ("<html><head><title>t</title></head><body><nav>menu</nav><p>one<p>two <b>x<br>y</b></body>", "one\ntwo x y"),
    ("<body><header>site</header><article><header><h1>H</h1></header><p>a\n b&nbsp;c</p><aside>no</aside></article><p>out</p></body>", "H\na b c"),
    ("<article><p>a<script>if (1 < 2) '</p>'</script>b</p><style>p{}</style><!-- <p>x</p> --></article>", "ab"),
    ("<main><div>x<div>y</div>z</div></main><div>w</div>", "x\ny\nz"),
    ('<article><p>a</p><div class="user-comments"><p>nice</p></div><div id="newsletterBox">n</div><form>f</form></article>', "a"),
    ('<article class="comment">c</article><article><p>a</article>', "a"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a\nb\nc\nd"),
    ("<p>1 < 2 &lt; 3 &#233; &eacute; &bogus;</p>", "1 < 2 < 3 é é &bogus;"),
    ("<article><p>open <b>bold<br><p>next", "open bold\nnext"),
    ('<div style="display:none">h</div><div hidden>h</div><p>v</p>', "v"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
    ("<article>a<article>b</article>c</article>", "a\nb\nc"),
    ("<p>t</p><textarea>x</textarea><noscript>n</noscript><img alt='>'/>", "t"),
]


@pytest.mark.parametrize("page,want", CASES)
def test_main_text(page, want):
    assert H.main_text(H.parse(page)) == want


def test_deep_and_long_pages():
    assert H.main_text(H.parse("<div>" * 5000 + "x")) == "x"
    assert len(H.main_text(H.parse("<p>" + "y " * 500_000))) == 999_999


def test_templates_are_removed_per_host(spark):
    def page(i, site):
        return f"<body><div><p>Welcome to {site}</p></div><div><p>text {i}</p></div><div>Rights of {site}</div></body>"

    rows = [(i, f"https://{'AB'[i % 2]}.example/{i}", page(i, "AB"[i % 2])) for i in range(40)]
    rows += [(100, "https://c.example/", page(100, "A")), (101, None, page(101, "A")), (102, "nonsense", None), (None, "http://a.EXAMPLE:80/x", "<p>q</p>")]
    rows += [(200 + i, f"http://news.example/{i}", "<body><article><p>copied story</p></article></body>") for i in range(10)]
    pages = spark.createDataFrame([(*r, 7) for r in rows], "page_id long, url string, html string, n_chars int").repartition(3)
    out = {r["page_id"]: r for r in H.extract(pages).collect()}
    assert len(out) == len(rows) and "html" not in out[0]
    assert all(out[i]["text"] == f"text {i}" and out[i]["n_chars"] == len(f"text {i}") for i in range(40))
    assert out[100]["text"] == "Welcome to A\ntext 100\nRights of A" and out[101]["text"].startswith("Welcome")
    assert (out[102]["text"], out[102]["n_chars"], out[None]["text"]) == ("", 0, "q")
    assert all(out[200 + i]["text"] == "copied story" for i in range(10))
    assert H.extract(pages.limit(0)).count() == 0


def test_template_counts_equal_brute_force(spark):
    rows = [(f"http://h{i % 3}.example/", "<body>" + "".join(f"<div>{k}</div>" for k in range(8) if i % (k + 1) == 0) + "</body>") for i in range(90)]
    want, pages = {}, {}
    for url, page in rows:
        host = url[7:-1]
        pages[host] = pages.get(host, 0) + 1
        for key in set(H.subtrees(H.parse(page))):
            want[host, key] = want.get((host, key), 0) + 1
    want = {k for k, n in want.items() if n >= H.TEMPLATE_PAGES and n >= pages[k[0]] * H.TEMPLATE_SHARE}
    got = H.site_templates(spark.createDataFrame(rows, "url string, html string").repartition(4)).collect()
    assert {(r["host"], k) for r in got for k in r["template"]} == want


def test_recurring_boxes_inside_articles_and_main_go(spark):
    box = "<div><b>Jane Roe</b> writes here</div>"
    rows = [(i, f"http://a.example/{i}", f"<body><article><p>story {i}</p><p>See below.</p>{box}</article></body>") for i in range(8)]
    rows += [(100 + i, f"http://a.example/x{i}", "<body><article><div><p>copied</p></div></article></body>") for i in range(9)]
    rows += [(200 + i, f"http://b.example/{i}", f"<body><main><p>body {i} of the page</p><section>more from us</section></main></body>") for i in range(6)]
    rows += [(300 + i, f"http://a.example/y{i}", f"<body><p>plain {i}</p></body>") for i in range(200)]  # the boxes are on few pages
    rows += [(600, "http://c.example/1", f"<body><article><p>other host</p>{box}</article></body>"),
             (601, "http://a.example/z", f"<body><article><!-- 1 -->{box}</article></body>"), (602, "http://a.example/n", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    out = {r["page_id"]: r["text"] for r in H.extract(pages).collect()}
    assert len(out) == len(rows)
    assert all(out[i] == f"story {i}\nSee below." for i in range(8)) and all(out[100 + i] == "copied" for i in range(9))
    assert all(out[200 + i] == f"body {i} of the page" for i in range(6)) and out[300] == "plain 0"
    assert (out[600], out[601], out[602]) == ("other host\nJane Roe writes here", "Jane Roe writes here", "")


def test_teaser_articles_do_not_replace_the_body():
    page = "<main><p>the real body of this page, at some length</p><article>teaser one</article><article>teaser two</article></main>"
    assert H.main_text(H.parse(page)) == "the real body of this page, at some length"


def test_pages_that_recur_as_a_whole_keep_their_text(spark):
    rows = [(i, f"http://m.example/{i}", "<body><div><h1>Title</h1><p>the same story on a mirror</p></div></body>") for i in range(6)]
    rows += [(10 + i, f"http://m.example/x{i}", f"<body><div>print view {i}<p>the body</p></div><p>a line on each page</p><ul><li>menu</ul></body>") for i in range(6)]
    rows += [(30 + i, f"http://p.example/{i}", f"<body><p>intro of all</p><div><p>own {i}</p></div></body>") for i in range(8)]
    out = {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert all(out[i] == "Title\nthe same story on a mirror" for i in range(6))
    assert all(out[10 + i] == f"print view {i}\nthe body\na line on each page" for i in range(6))
    assert all(out[30 + i] == f"intro of all\nown {i}" for i in range(8))


@pytest.mark.parametrize("name", ["side-by-side", "social-science", "search-results", "notices-of-law", "discussion", "user-comments big"])
def test_class_words_do_not_delete_the_body(name):
    body = "a sentence of the body. " * 20
    assert H.main_text(H.parse(f'<article><h1>t</h1><div class="{name}"><p>{body}</p></div></article>')) == f"t\n{body.strip()}"


@pytest.mark.parametrize("name", ["comments", "user-comments", "newsletterBox", "ad", "ad-slot left", "related-posts", "cookie_notice", "share-buttons", "sideBar", "main-nav"])
def test_class_words_mark_what_is_not_the_article(name):
    assert H.main_text(H.parse(f'<article><p>{"the body " * 30}</p><div class="{name}"><p>other</p></div></article>')) == ("the body " * 30).strip()


def test_malformed_pages_take_linear_time():
    import time

    for page in ("<i>" * 100_000 + "</b>" * 100_000, "<a '" * 250_000, "<a x=\"" * 150_000, "<p><i>" * 100_000 + "</u>" * 50_000, "<" * 500_000, "<!-- " * 200_000):
        start = time.process_time()
        H.main_text(H.parse(page))
        assert time.process_time() - start < 12, page[:8]
