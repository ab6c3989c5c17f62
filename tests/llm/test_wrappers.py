from candlewick.llm import wrappers
from candlewick.llm.wrappers import Node, align, induce, parse, read


def tree(text):
    return parse(text)


def test_optional_repeated_and_slots():
    one = "<div class=box><h1>Site</h1><ul><li>a</li><li>b</li></ul></div>"
    two = "<div class=box><h1>Site</h1><p>note</p><ul><li>c</li></ul></div>"
    wrapper = induce(iter([tree(one), tree(two)]))
    assert wrapper.expression() == "<page><div box><h1>'Site'</> <p>'note'</>? <ul>(<li>#TEXT</>)+</></></>"


def test_repeated_group_of_two():
    pages = [f"<dl>{''.join(f'<dt>k{i}</dt><dd>v{i}</dd>' for i in range(n))}</dl>" for n in (1, 3)]
    wrapper = induce(iter(map(tree, pages)))
    assert "(<dt>#TEXT</> <dd>#TEXT</>)+" in wrapper.expression()


def test_wrappers_merge_like_pages():
    pages = [f"<div class=box><p>x{i}</p>{'<pre>y</pre>' if i % 2 else ''}</div>" for i in range(6)]
    whole = induce(iter(map(tree, pages)))
    left, right = induce(iter(map(tree, pages[:3]))), induce(iter(map(tree, pages[3:])))
    right = Node.load(right.dump())
    align(left, right)
    assert left.expression() == whole.expression() and left.kids[0].pages == whole.kids[0].pages


ARTICLE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<nav><ul><li><a href=x>Menu</a></li></ul></nav><!-- <p>no</p> --><div class="ad top">Buy</div>
<article><header>By me</header><h1>Head &amp; line</h1><p>First <b>bold</b><br>line<p>Second&nbsp;one &lt;x&gt; <a
href="q>r">link</a></p><script>var t="</p>";</script><aside>side</aside><form>Mail <input></form>
<ul><li>one<li>two</ul><section id="comments"><p>Nice!</p></section></article>
<div class="cookie-notice">We use</div><footer>&copy; me</footer></body>"""


def test_article_text():
    page = tree(ARTICLE)
    text = read(induce(iter([page])), page)
    assert text == "Head & line\n\nFirst bold line\n\nSecond one <x> link\n\none\n\ntwo"


def test_end_tags_may_be_missing():
    text = read(None, tree("<html><head><title>T</title><meta x><body><article><p>One<p>Two<ul><li>a<li>b"))
    assert text == "One\n\nTwo\n\na\n\nb"


def test_hidden_elements_hide_no_more_than_themselves():
    for hidden in (
        '<svg-icon name="x"></svg-icon>', "<video-player></video-player>", "<button-group></button-group>",
        "<title-bar></title-bar>", "<datalist><option value=a><option value=b></datalist>",
        "<select><option>a<optgroup><option>b</select>", "<svg><svg><path/></svg><text>no</text></svg>",
        "<button>Go", "<option>a", "<svg/>", "<noscript><p>no</p></noscript>", "<script>x('<p>')</script >",
    ):
        for page in (f"{hidden}<article><p>all</p></article>", f"<article>{hidden}<p>all</p></article>"):
            assert read(None, tree(page)) == "all", page
    assert read(None, tree("<p>one <svg><title>no</title></svg> two</p>")) == "one two"
    assert read(None, tree("<p>all</p><script>x <p>no</p>")) == "all"


def test_template_text_outside_articles():
    pages = [f"<div>Our site</div><div><p>Story {i} is long</p></div><div id=footer>x</div>" for i in range(8)]
    trees = [tree(p) for p in pages]
    assert read(induce(iter(trees)), trees[3]) == "Story 3 is long"


def test_copies_count_as_one_page(spark):
    page = "<div>Our site</div><div><p>Story one</p><p>is long</p></div><div id=footer>x {}</div>"
    for n in (4, 5, 1000):
        trees = [tree(page.format(i)) for i in range(n)]
        assert read(induce(iter(trees)), trees[0]) == "Our site\n\nStory one\n\nis long"
    rows = [(i, None, page) for i in range(40)]
    rows += [(100 + i, "http://a.example/", f"<div>Our site</div><div><p>Story {i}</p></div>") for i in range(8)]
    rows += [(200 + i, "http://a.example/", "<div>Our site</div><div><p>Same</p></div><pre>block</pre>") for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8)
    out = {r["page_id"]: r["text"] for r in wrappers.extract(pages).collect()}
    assert {out[i] for i in range(40)} == {"Our site\n\nStory one\n\nis long"}
    assert [out[100 + i] for i in range(8)] == [f"Story {i}" for i in range(8)]
    assert {out[200 + i] for i in range(40)} == {"Same\n\nblock"}


def test_headings_and_sections_keep_their_ids():
    blocks = (
        '<h2 id="discussion">T</h2>', '<section id="related-work">T</section>', '<p class="share-price">T</p>',
        '<div id="legal-history">T</div>', '<section id="search-results">T</section>', '<section id="discussion">T</section>',
        '<p id="comments">T</p>', '<div class="notice-period">T</div>',
    )
    for block in blocks:
        assert read(None, tree(f"<article><p>a</p>{block}<p>b</p></article>")) == "a\n\nT\n\nb", block
    for block in (
        '<div class="share-buttons">T</div>', '<div class="x ad">T</div>', '<section id="comments">T</section>',
        '<div role="navigation">T</div>', '<span class="advert">T</span>', '<aside>T</aside>', '<div id="disqus_thread">T</div>',
    ):
        assert read(None, tree(f"<article><p>a</p>{block}<p>b</p></article>")) == "a\n\nb", block
    text = "<p>The body of the page is long.</p><p>It goes on.</p>"
    assert read(None, tree(f'<div class="post">Other</div>{text}')).endswith("It goes on.")
    assert read(None, tree(f'<div>Site</div><div class="content">{text}</div>')).startswith("The body")


def test_template_text_inside_articles(spark):
    body = "<article><h1>Head {0}</h1><div class=box><p>All our stories are free</p></div><p>Story {0}</p><p>Same end</p></article>"
    rows = [(i, "http://a.example/", body.format(i)) for i in range(12)]
    rows += [(100 + i, "http://b.example/", body.format(i)) for i in range(4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    out = {r["page_id"]: r["text"] for r in wrappers.extract(pages).collect()}
    assert [out[i] for i in range(12)] == [f"Head {i}\n\nStory {i}\n\nSame end" for i in range(12)]
    assert "All our stories are free" in out[100]  # four pages are too few to tell


def test_broken_markup_ends():
    for page in ["<", "<a", "<!-- x", "<p", "<script>x", "<div class='x", "</p></div>", "&#xZZ; &bogus; <p>a < b", "<p>" * 3000]:
        read(None, tree(page))


def test_table(spark):
    rows = [
        (1, "http://a.example/x", ARTICLE), (2, None, None), (3, "not a url", ""), (4, "http://[bad", "<p>x</p>"),
        (1, "http://a.example/x", ARTICLE), (None, "http://a.example/y", "<article>" + "<p>w</p>" * 5000),
    ]
    schema = "page_id long, url string, html string"
    out = wrappers.extract(spark.createDataFrame(rows, schema).selectExpr("*", "'z' AS text", "'h' AS host"))
    got = sorted(((r["page_id"], r["text"]) for r in out.collect()), key=repr)
    assert len(got) == 6 and [t for i, t in got if i == 2] == [""] and [t for i, t in got if i == 4] == ["x"]
    assert [t for i, t in got if i is None] == ["\n\n".join("w" * 5000)]
    assert wrappers.extract(spark.createDataFrame([], schema)).collect() == []


def test_split_hosts_give_the_same(spark):
    rows = [(i, "http://a.example/", f"<div>Our site</div><div><p>Story {i}</p></div>") for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8)
    out = {r["page_id"]: r["text"] for r in wrappers.extract(pages, broadcast_bytes=0).collect()}
    assert out == {i: f"Story {i}" for i in range(40)}


def test_deeply_nested_pages(spark):
    """Blocks below any depth keep their text, order and roles; other pages of the host are not touched."""
    deep = "<div>" * 5000
    page = f"<body><article><p>top</p>{deep}<p>a</p><nav>menu</nav><div><p>b</p></div>c{'</div>' * 5000}<p>end</p></article></body>"
    open_ended = f"<article><p>x</p>{'<section><ul><li>' * 3000}low"
    outside = f"{'<div>' * 1500}<main><p>in</p><aside>no</aside></main><p>out</p>"
    rows = [(1, "http://h/1", page), (2, "http://h/2", open_ended), (3, "http://h/3", outside), (4, "http://h/4", "<article><p>plain</p></article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in wrappers.extract(pages).collect()}
    assert got == {1: "top\n\na\n\nb\n\nc\n\nend", 2: "x\n\nlow", 3: "in", 4: "plain"}
