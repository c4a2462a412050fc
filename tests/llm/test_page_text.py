"""HTML extraction: hand-made pages, and repeated branches found by the site style tree."""

import time

from eventlens.llm import page_text
from tests.llm.helpers import by_id

ARTICLE = ('<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>'
           '<nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy &amp; go</div><div id="cookie-notice">We use cookies</div>'
           '<article class="post"><h1>A  &lt;b&gt; title</h1><p>One\n two&nbsp;three<p><b>Bold<br>line<p>caf&eacute; &#8211; <a href="#">link</a>s</p>'
           '<aside>See also</aside><ul><li>first<li>second</ul><table><tr><td>a<td>b</table><form><input value="x"><p>Send</p></form>'
           '<script>track("<p>no</p>")</script><div class="comments"><p>First!</p></div></article><div class="sidebar"><p>Side</p></div><footer>&copy; x</footer></body></html>')
TEXT = "A <b> title\nOne two three\nBold line\ncafé – links\nfirst\nsecond\na\nb"


def one(page, low=frozenset()):
    return page_text.main_text(page, page_text.new_root(), low)


def test_article_without_the_rest():
    assert one(ARTICLE) == TEXT
    assert one(ARTICLE.split("</article>")[0]) == TEXT  # cut off
    assert one(ARTICLE.upper().replace("NBSP", "nbsp").replace("EACUTE", "eacute").replace("&AMP", "&amp").replace("&LT", "&lt").replace("&GT", "&gt")).startswith("A <B> TITLE\nONE TWO THREE")


def test_odd_pages():
    assert one("") == "" and one("plain  text\nhere") == "plain text here"
    assert one("<p>a<p>b</div><p>c") == "a\nb\nc"
    assert one("<div>a <span class=advert>no</span> b</div>") == "a b"
    assert one("a < b and c > d <p>e") == "a < b and c > d\ne"
    assert one("<nav>only a menu</nav>") == ""
    assert one("<body class='has-sidebar'><main><p>x</p></main><p>y</p></body>") == "x"
    assert one("<article><header><h1>t</h1></header><p>x</p><article class=comment><p>no</p></article></article>") == "t\nx"
    assert one("<p>" + "word " * 200_000 + "</p>") == ("word " * 200_000).strip()
    assert one("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def plain_observed(page, root):
    """Every text counted for every ancestor, one by one."""
    out, kids = set(), {}
    for runs in page_text.parse(page, root, kids):
        for node, text in runs:
            while text.strip() and node is not None:
                out.add((node.value, True, page_text._hash(text.strip()) >> 32))
                kids.setdefault(node, set())
                node = node.parent
    return out | {(n.value, False, page_text._hash(repr(sorted(k))) >> 32) for n, k in kids.items()}


def test_texts_add_up_to_the_root():
    for page in (ARTICLE, "", "x", "<p>a<p>b</div><p>c", "<div>" * 300 + "a<b>c</b>" + "<div>d" * 300):
        root = page_text.new_root()
        got = [(n, c, v) for n, c, vs in page_text.observed(page, root) for v in vs.tolist()]
        assert len(got) == len(set(got)) and set(got) == plain_observed(page, root)


def test_broken_markup_costs_no_more_than_its_length():
    begin = time.time()
    for tags in ("<b>", "<b><i class=x>", "<span>", "<div>", "<p><font><u>"):
        page = "".join(f"{tags}t{i}" for i in range(100_000 // tags.count("<"))) + "</em></x>" * 1000
        assert one(page).replace("\n", "") == "".join(f"t{i}" for i in range(100_000 // tags.count("<")))
        rows = sum(len(v) for _, _, v in page_text.observed(page, page_text.new_root()))
        assert rows <= (page_text.DEPTH + 2) * 100_000 and (tags not in ("<b>", "<b><i class=x>") or rows < 500_000)
    assert time.time() - begin < 40
    deep = "<div>" * 500
    assert one(f"{deep}<nav><div>no</div></nav><article><p>yes</p><aside>no</aside></article>") == "yes"
    assert one("<b>a<b>b</b>c</b><p><i>d<b>e</i>f") == "abc\ndef"


def test_article_text_is_not_judged_by_single_words():
    inside = ('<section id="discussion"><h2 id="related-work">Related work</h2><p id="search-results">Found.</p><div class="share-capital">Capital</div>'
              '<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math>.</p><noscript><p>Plain</p></noscript><object data="a.svg">A chart</object></section>')
    noise = '<div class="comments">no</div><div class="social-share">no</div><ul class="x related">no</ul><span role="banner">no</span>'
    assert one(f"<article>{inside}{noise}</article>") == "Related work\nFound.\nCapital\nLet x=1.\nPlain\nA chart"
    assert one('<div id="discussion">no</div><noscript>no</noscript><p>yes') == "yes"


def pages(spark, rows, extra=True):
    schema = "page_id long, url string, html string" + (", _id string, host string, text string, n_chars string" if extra else "")
    return spark.createDataFrame([(*r, *(["x"] * 4 if extra else [])) for r in rows], schema)


def site(n):
    """Pages without an article element: a repeated strip and changing content, told apart by the tree only."""
    return [(i, f"https://h.example/{i}", f"<body><div class=strip>Call us today</div><div class=story><p>Story {i} tells of {i * i}.</p><p>Same end.</p></div></body>") for i in range(n)]


def test_style_tree_removes_what_a_host_repeats(spark):
    rows = site(40) + [(100, "https://one.example/1", "<body><div class=strip>Call us today</div><div class=story><p>x</p></div></body>")]
    got = {r.page_id: r.text for r in page_text.extract(pages(spark, rows)).collect()}
    assert got[3].startswith("Story 3 tells of 9.") and "Call us" not in got[3]
    assert got[100] == "Call us today\nx"
    imp = page_text.importances(spark.createDataFrame([("h", r[2]) for r in site(40)], "_host string, _html string")).collect()
    assert len(imp) == 5 and all(r.pages == 40 for r in imp) and min(r.importance for r in imp) < 0.05 < 0.8 < max(r.importance for r in imp)


def test_style_tree_acts_inside_articles(spark):
    """A named branch that a host repeats goes from its articles; headings, plain paragraphs and what few pages share stay."""
    tail = '<div class="strip">Call us today</div>'
    rows = [(i, f"https://h.example/{i}", f'<body><article><h2 class="in">Introduction</h2><p>Story {i} of {i * i}.</p>{tail if i % 4 else ""}'
             f'{"<div class=rare>Shared by few</div>" if i < 5 else ""}</article></body>') for i in range(40)]
    got = {r.page_id: r.text for r in page_text.extract(pages(spark, rows)).collect()}
    assert got[3] == "Introduction\nStory 3 of 9.\nShared by few" and got[30] == "Introduction\nStory 30 of 900."


def test_text_outside_a_teaser_stays():
    long = "<div class=story><p>" + "The whole story is told here. " * 20 + "</p></div>"
    assert one(f"<article><p>Short.</p></article>{long}").startswith("Short.\nThe whole story")
    assert one("<article><p>As long as the rest.</p></article><p>As long as the rest.</p>") == "As long as the rest."


def test_repeated_articles_stay(spark):
    rows = [(i, "https://h.example/x", ARTICLE) for i in range(30)]
    assert {r.text for r in page_text.extract(pages(spark, rows)).collect()} == {TEXT}


def test_defined_cases(spark):
    rows = [(1, "https://a.example/", None), (2, None, ARTICLE), (2, None, ARTICLE), (None, "not a url", ""), (5, "HTTP://User@A.example:80/x?y", ARTICLE)]
    got = by_id(page_text.extract(pages(spark, rows)), "page_id", "url", "text", "n_chars")
    assert got == sorted([(1, rows[0][1], "", 0), (2, None, TEXT, len(TEXT)), (2, None, TEXT, len(TEXT)), (None, "not a url", "", 0), (5, rows[4][1], TEXT, len(TEXT))], key=repr)
    assert page_text.extract(pages(spark, rows).where("false")).count() == 0
