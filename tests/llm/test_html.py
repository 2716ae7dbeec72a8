import html as entities
import json
import random
import re

from llm_util import empty
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from gavel.llm import html as H
from gavel.llm.common import table

PAGE = ('<html><body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies</div>'
        '<div id="content"><h2>Title &amp; more</h2><p>One   two<br>three <a href=x>link</a>&nbsp;four</p><ul><li>a<li>b</ul>'
        '<div class="share">Share</div><div class="comments"><p>nice</p></div></div><div class="sidebar">x</div>'
        '<form><p>f</p></form><script>var a="</p>"</script><style>p{}</style><footer>&copy;</footer></body>')


def article(html):
    """The article of a generated page, by its known shape."""
    body = re.search("<article>(.*?)</article>", html, re.S)[1]
    parts = re.split("</?(?:p|h1)>", re.sub("</?b>", "", body).replace("<br>", " "))
    return "\n\n".join(" ".join(entities.unescape(x).split()) for x in parts if x.strip())


def test_main_text_without_the_rest():
    assert H.extract(PAGE, None) == "Title & more\n\nOne two three link four\n\na\n\nb"


def test_query_on_the_table(spark):
    want = {p.page_id: (p.url, article(p.html)) for p in table(spark, SF_MID, "pages").collect()}
    rows = H.op1_html(spark, SF_MID).collect()
    assert len(rows) == len(want) and {r.page_id: (r.url, r.text) for r in rows} == want
    assert all(r.n_chars == len(r.text) for r in rows)


def signs(items):
    return [(x[0], x[1], x[2], signs(x[3]) if x[3] else None) for x in items]


def wrapper(*pages):
    out = None
    for p in pages:
        own = H.bare(H.fold(H.parse(p)[0]))
        out = own if out is None else H.merge(out, own)
    return out


def test_repeated_and_optional_groups():
    one = "<div><h2>a</h2><p>b</p><h2>c</h2><p>d</p><h2>e</h2><p>f</p></div>"
    two = "<div><table><tr><td>x</table><h2>a</h2><p>b</p><h2>c</h2><p>d</p></div>"
    (div,) = signs(wrapper(one, two))
    assert [(s[0], s[1], s[2]) for s in div[3]] == [("table.", True, False), ("(h2. p.)", False, True)]
    (slot,) = [x for x in wrapper("<p>same</p>", "<p>same</p>")[0][3]]
    assert slot[4][:2] == [2, 8] and slot[4][3]  # constant text
    (slot,) = [x for x in wrapper("<p>same</p>", "<p>other</p>")[0][3]]
    assert slot[4][3] == 0  # a slot


def fits(items, pattern):
    """Whether a sequence of signatures fits a union-free pattern (plain recursion)."""
    if not pattern:
        return not items
    (sign, optional, repeated, children), rest = pattern[0], pattern[1:]
    if optional and fits(items, rest):
        return True
    inner = children if sign.startswith("(") else None
    if inner:
        return any(fits(items[:n], inner) and (fits(items[n:], rest) or repeated and fits(items[n:], [(sign, False, True, children), *rest]))
                   for n in range(1, len(items) + 1))
    if not items or items[0][0] != sign or children and not fits(items[0][3] or [], children):
        return False
    return fits(items[1:], rest) or repeated and fits(items[1:], pattern[:1] + rest and [(sign, False, True, children), *rest])


def test_a_wrapper_fits_its_pages():
    rnd = random.Random(4)
    for _ in range(60):
        pages = ["".join(f"<{t}>x</{t}>" for t in rnd.choices(["div", "p", "h2", "ul"], k=rnd.randint(1, 5))) for _ in range(3)]
        pattern = signs(wrapper(*pages))
        for p in pages:
            assert fits(signs(H.parse(p)[0]), pattern), (pages, pattern)


def test_constant_text_inside_the_article_stays():
    """At any number of pages: only the named kinds of elements go."""
    for n in (9, 10, 40):
        pages = [f"<article><h1>Same</h1><blockquote>Read this on our site</blockquote><p>text {i}</p></article>" for i in range(n)]
        known = H.label(json.loads(json.dumps(wrapper(*pages))))
        assert H.extract(pages[3], known) == "Same\n\nRead this on our site\n\ntext 3"


def test_the_wrapper_tells_template_text_where_there_is_no_article():
    """Pages of divs alone: what never changes over a host's pages isn't the page's text, which one page can't tell."""
    pages = [f"<div class=top>Our daily paper for everyone</div><div class=story><h2>Head {i}</h2><p>Story number {i} goes on here</p></div>"
             f"<div class=end>All rights reserved by the paper</div>" for i in range(12)]
    known = H.label(json.loads(json.dumps(wrapper(*pages))))
    assert H.extract(pages[5], known) == "Head 5\n\nStory number 5 goes on here"
    assert H.extract(pages[5], None) != H.extract(pages[5], known)


def test_class_names_that_say_something_else():
    text = "<h1>Title</h1><p>the whole story at its full length</p>"
    for name in ("post has-sidebar", "post comments-open", "single-post no-sidebar", "sidebar"):
        assert H.extract(f'<body><article class="{name}">{text}</article></body>', None) == "Title\n\nthe whole story at its full length"
    page = ('<article><h2 id="share-prices">Share prices</h2><p>They rose again today.</p><section id="related-work"><p>Related work here.</p></section>'
            '<div class="table-header">Year and price</div><div class="comments"><p>nice!</p></div><div class="share-buttons">Share</div>'
            '<div id="cookie-notice">We use cookies</div><article class="comment">first!</article></article>')
    assert H.extract(page, None) == "Share prices\n\nThey rose again today.\n\nRelated work here.\n\nYear and price"
    # An element with most of the page's text is no sidebar.
    assert H.extract('<body><div class="sidebar">' + text + '</div><div>by us</div></body>', None).startswith("Title\n\nthe whole story")


def test_formulas_and_unclosed_quotes():
    assert H.extract("<article><p>where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p></article>", None) == "where x=2 holds"
    assert H.extract("<article><p class='x>one</p><p>two</p></article>", None) == "one\n\ntwo"


def test_repeated_text_inside_the_article_stays():
    copy = "<article><h1>A</h1><blockquote>quoted</blockquote><p>the story</p></article>"
    others = [f"<article><h1>B {i}</h1><p>text {i}</p></article>" for i in range(30)]
    for pages in ([copy] * 12 + others, others + [copy] * 40):
        known = H.label(json.loads(json.dumps(wrapper(*pages))))
        assert H.extract(copy, known) == "A\n\nquoted\n\nthe story" and H.extract(others[3], known) == "B 3\n\ntext 3"
    copies = H.label(wrapper(*[copy + f"<div>{i}</div>" for i in range(12)]))
    assert H.extract(copy, copies) == "A\n\nquoted\n\nthe story"
    items = "<article><p>one</p><p>two</p><ul>" + "<li>same</li>" * 12 + "</ul></article>"
    want = "\n\n".join(["one", "two"] + ["same"] * 12)
    assert H.extract(items, None) == want == H.extract(items, H.label(wrapper(items)))


def test_links_inside_the_article_stay():
    pages = [f'<article><h1><a href=/{i}>Title {i}</a></h1><p>text of page {i}</p><ul><li><a href=x>source {i}</a></li></ul></article>' for i in range(12)]
    known = H.label(wrapper(*pages))
    assert [H.extract(p, known) for p in pages] == [f"Title {i}\n\ntext of page {i}\n\nsource {i}" for i in range(12)]
    assert H.extract(pages[0], None) == "Title 0\n\ntext of page 0\n\nsource 0"


def test_without_an_article_the_densest_region_counts():
    long = "<div><div>" + "<p>prose of the page, at some length</p>" * 5 + "</div><div><a href=x>one</a><a href=y>two links</a></div></div>"
    assert H.extract(long, None) == "\n\n".join(["prose of the page, at some length"] * 5)


def test_broken_markup():
    for bad in ("", "<", "<p", "<p class='x>y", "</p></div>", "<!-- open", "<script>never closed", "a < b > c &amp; &bogus; &#x41;", "<div>" * 5000 + "deep"):
        assert isinstance(H.extract(bad, None), str)
    assert H.extract("a < b &amp; &#x41;", None) == "a < b & A"
    assert H.extract("<div>" * 5000 + "deep", None) == "deep"


def test_deep_elements_end_by_their_own_tags():
    deep = "<div>" * 150 + "<p>inner</p><nav>menu</nav>" + "</div>" * 150
    page = f"<body><article><h1>Title</h1><div><p>one</p>{deep}<p>two</p></div><p>three</p></article><div>after</div></body>"
    assert H.extract(page, None) == "Title\n\none\n\ninner\n\ntwo\n\nthree"


def test_long_levels_align():
    rnd = random.Random(1)
    a, b = ([[f"t{rnd.randrange(80)}", False, False, [], 1] for _ in range(400)] for _ in range(2))
    pairs = list(H.align(a, b))
    assert [i for i, _ in pairs if i is not None] == list(range(400)) and [j for _, j in pairs if j is not None] == list(range(400))
    assert all(a[i][0] == b[j][0] for i, j in pairs if i is not None and j is not None)
    assert len(H.merge(a, b)) <= H.LEVEL_ITEMS


def test_levels_of_many_layouts_keep_whole_articles():
    rnd = random.Random(7)
    names = [a + b for a in "bcdfghjklmnpqrstvwxyz" for b in "bcdfghjklmnpqrstvwxyz"][:400]
    pages, want = [], []
    for k, name in enumerate(names):
        blocks = [f"<h2>head {k}</h2><p>lead {k}</p>", f'<div class="{name}">body {k}</div>', f'<p class="{rnd.choice(names)}">more {k}</p>',
                  f'<div class="{rnd.choice(names)}"><p>quote {k}</p><ul><li>item {k}</li></ul></div>']
        rnd.shuffle(blocks)
        pages.append("<article><h1>Title</h1>" + "".join(blocks) + "</article>")
        want.append(re.sub("(?:<[^>]*>)+", "\n\n", pages[-1]).strip())
    for order in (pages, pages[::-1], rnd.sample(pages, len(pages))):
        known = H.label(json.loads(json.dumps(wrapper(*order))))
        assert [H.extract(p, known) for p in pages] == want


def test_awkward_rows(spark):
    rows = [(1, None, None), (2, "http://a/b", ""), (3, "http://a/c", "plain text"), (4, "http://a/c", PAGE), (4, "http://a/c", PAGE),
            (None, "no url", "<p>un<b>closed"), (5, "http://long/", "<article>" + "<p>word word</p>" * 20_000 + "</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("mine"), "host": F.lit("h")})
    got = H.main_text(pages).collect()
    want = {1: 0, 2: 0, 3: 10, 4: 44, None: 8, 5: 20_000 * 11 - 2}
    assert len(got) == 7 and {r.page_id: r.n_chars for r in got} == want | {4: len(H.extract(PAGE, None))}
    assert H.main_text(empty(pages)).count() == 0


def test_result_does_not_depend_on_partitions(spark):
    pages = table(spark, SF_SMALL, "pages")
    a = sorted(map(tuple, H.main_text(pages.repartition(1)).collect()))
    assert a == sorted(map(tuple, H.main_text(pages.repartition(7)).collect()))
