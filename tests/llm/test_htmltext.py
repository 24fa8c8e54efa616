import html
import random
import re

from basketry.llm.htmltext import OWN, _nearest, blocks, common_lines, extract, main_text


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_common_lines_are_a_longest_common_subsequence():
    draw = random.Random(9)
    for _ in range(300):
        a, b = ([draw.choice("abcdef") for _ in range(draw.randrange(12))] for _ in "ab")
        found = sorted(common_lines(a, b))
        assert len(found) == lcs(a, b)
        at = 0
        for i in found:
            at = b.index(a[i], at) + 1


def test_documents_pages(spark):
    """The given pages have one article each, and what is in it is their text."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in extract(pages).collect()}
    for r in pages.collect():
        inner = r.html.split("<article>")[1].split("</article>")[0].split("<footer>")[0]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner))
        want = "\n\n".join(x for x in parts if x)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url


def test_markup():
    page = """<!DOCTYPE html><head><title>no</title></head><body class="has-sidebar"><header>no<p>no</header><!-- no <p>no -->
    <div class='cookie-notice'>no<div>no</div></div><main><h1>A &amp;  B&nbsp;&#233;</h1><p>one<br>two <b>th</b>ree<p>four</p>5 < 6
    <script>var a = "</p>no";</script><form>no<input>no</form><ul><li>x<li>y</ul><div id="comments">no<p>no</div><aside>no</aside></main>
    <div class="sidebar">no</div><footer>no</footer>"""
    assert [t for t, r in blocks(page) if r == OWN] == ["A & B é", "one two three", "four", "5 < 6", "x", "y"]
    assert main_text(blocks("<div>a<nav>no</nav><p>b"), None) == "a\n\nb"
    assert blocks(None) == [] and blocks("<p") == [] and blocks("a &am") == [("a &am", 2)]
    assert blocks("<" * 1000)[0][0] == "<" * 1000


def test_template_of_pages_without_landmarks_is_deleted(spark):
    shell = "<div>Site name</div><div>Home Shop About</div>{}<div>All rights kept</div>"
    rows = [(i, f"http://h/a/{i}", shell.format(f"<p>story {i}</p><p>shared words</p>" if i < 3 else "<p>other</p>")) for i in range(4)]
    rows += [(10, "http://solo/x", shell.format("<p>z</p>")), (11, None, None), (12, "http://h2/a", "<p>same"), (12, "http://h2/a", "<p>same")]
    pages = spark.createDataFrame([(*r, "q") for r in rows], "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.text) for r in extract(pages).collect()))
    assert got == [
        (0, "story 0"), (1, "story 1"), (2, "story 2"), (3, "other"), (10, "Site name\n\nHome Shop About\n\nz\n\nAll rights kept"), (11, ""), (12, "same"), (12, "same"),
    ]
    assert extract(pages.limit(0)).count() == 0
    assert sorted((r.page_id, r.text) for r in extract(pages.repartition(7)).collect()) == got


def test_copies_show_no_template_and_the_nearest_page_that_differs_does(spark):
    shell = "<div>Site name</div><div>Home Shop About</div><p>{}</p><div>All rights kept</div>"
    rows = [(i, f"http://h/a/{i:03}", shell.format("copied story")) for i in range(40)] + [(99, "http://h/b", shell.format("other"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.text for r in extract(pages.where("page_id < 99")).collect()} == {"Site name\n\nHome Shop About\n\ncopied story\n\nAll rights kept"}
    for ranges in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", ranges)
        try:
            got = {r.page_id: r.text for r in extract(pages).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert got == {**{i: "copied story" for i in range(40)}, 99: "other"}


def test_large_hosts_are_paired_like_small_ones(spark):
    """A host of 6,000 pages in sections of 1 to 5, some of copies, at several numbers of ranges, against brute force."""
    draw, rows = random.Random(4), []
    for section in range(2000):
        for i in range(draw.choice((1, 2, 5))):
            line = draw.choice(("same", f"story {section} {i}"))
            rows.append((len(rows), f"http://h/s{section:04}/{i}", f"<div>Menu</div><div>Section {section}</div><p>{line}</p><div>End</div>"))
    rows.append((len(rows), "http://g/x", "<p>x"))
    assert len(rows) > 4096 + 1
    keyed = sorted((u.split("/", 3)[2], "/" + u.split("/", 3)[3], i, blocks(h)) for i, u, h in rows)
    want = {}
    for at, (host, path, i, own) in enumerate(keyed):
        before, after = (next((k for k in way if k[0] == host and k[3] != own), None) for way in (keyed[:at][::-1][:99], keyed[at + 1 :][:99]))
        near = (before, after)[_nearest(path, before and before[1], after and after[1]) > 0]
        want[i] = main_text(own, near and near[3])
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for ranges in ("1", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", ranges)
        try:
            got = {r.page_id: r.text for r in extract(pages).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert got == want


def test_quotes_and_partial_names_lose_no_text():
    text = lambda page: main_text(blocks(page), None)
    assert text("<article><p don't>text one</p><p>more text</p></article>") == "text one\n\nmore text"
    assert text("<article><p class='share-price'>up 3</p><p class=\"share\">no</p><p>end</p></article>") == "up 3\n\nend"
    assert text("<p title='a > b' alt=x\"y>one</p><p title = \"it's\">two<p a='>three") == "one\n\ntwo"
    assert text("<p " + "a='" * 50_000) == "" and text("<p>" + "<p =" * 50_000) == ""


def test_articles_come_out_of_pages_without_landmarks(spark):
    """The given pages' articles in a template that no element or class names: differencing alone takes the template away."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    inner = {r.page_id: r.html.split("<article>")[1].split("</article>")[0].split("<footer>")[0] for r in pages}
    shell = "<div>Site name</div><div><b>Home</b> Shop</div><div>{}</div><div>Read also</div><div>All rights kept</div>"
    bare = spark.createDataFrame([(r.page_id, f"http://one.host/{r.page_id:05}", shell.format(inner[r.page_id])) for r in pages], "page_id long, url string, html string")
    whole = {r.page_id: r.text for r in extract(spark.createDataFrame([(i, f"http://{i}/", f"<article>{x}</article>") for i, x in inner.items()], bare.schema)).collect()}
    got = {r.page_id: r.text for r in extract(bare).collect()}
    alone = {r.page_id: main_text(blocks(r.html), None) for r in bare.collect()}
    assert sum(got[i] == whole[i] for i in inner) >= 0.95 * len(inner) and all(alone[i] != got[i] for i in inner)


def test_differencing_decides_beside_an_article(spark):
    page = "<div>Site name</div><div>By {}</div><main><p>story {}</p><p>shared words</p></main><div>All rights kept</div>"
    rows = [(i, f"http://h/{i}", page.format(f"writer {i}", i)) for i in range(3)] + [(9, "http://solo/", page.format("no one", 9))]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{i: f"By writer {i}\n\nstory {i}\n\nshared words" for i in range(3)}, 9: "story 9\n\nshared words"}


def test_an_article_is_kept_in_any_wrapper():
    """Pages with wrappers, forms and furniture by class alone, against what a reader would copy."""
    text = lambda page: main_text(blocks(page), None)
    assert text('<div class="page with-sidebar"><article><p>The text.</article></div>') == "The text."
    assert text('<div class="layout two-col no-header"><div class="site-header">no</div><main><p>The text.</main><div class="site-footer">no</div></div>') == "The text."
    assert text('<form id="aspnetForm"><div class="menu">no</div><article><h1>Head</h1><p>The text.</article><button>no</button></form>') == "Head\n\nThe text."
    assert text('<form id="f"><h1>Head</h1><p>The text.</p><select><option>no</select></form>') == "Head\n\nThe text."
    assert text("<p>The text.</p><form>Name <input> <p>no</p></form>") == "The text."
    assert text('<div class="content-sidebar"><div class="sidebar"><article>no</article></div><article>yes</article></div>') == "yes"
    assert text('<header><main><p>yes</main></header>') == "yes" and text("<aside><article>no</article></aside><p>yes") == "yes"


def test_furniture_in_an_article_goes_and_content_stays():
    text = lambda page: main_text(blocks(f"<article><p>one</p>{page}<p>two</p></article>"), None)
    for name in ("user-comments", "comment-list", "cookie-notice", "ad-slot", "comments", "share-buttons", "related-posts", "newsletter-signup", "ads", "ad_unit", "comment-17"):
        assert text(f'<div class="{name}">no<p>no</div>') == "one\n\ntwo", name
    assert text('<div id="comments"><article class="comment">no</article></div>') == "one\n\ntwo"
    assert text('<article id="comment-9" class="comment-body">no</article>') == "one\n\ntwo"
    for kept in ('<p data-class="ad">yes', '<p class="share-price">yes', '<section id="search">yes</section>', '<p class="with-ads">yes', '<p aria-role="menu">yes', "<svg><text>yes</text></svg>", "<object>yes</object>", "<canvas>yes</canvas>", "<p class=no-comments>yes"):
        assert text(kept) == "one\n\nyes\n\ntwo", kept
    assert text("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds") == "one\n\nso x=2 holds\n\ntwo"
    assert text("<xmp>a</xmp>") == "one\n\na\n\ntwo" and text("<nav>no</nav><form>no</form><footer>no</footer>") == "one\n\ntwo"
