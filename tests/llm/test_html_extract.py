import time

import pytest

from usagelake.llm.html_extract import extract, extract_pages

PROSE = "The river was wide and it ran to the sea in the light of a long day, and all of the boats were still at the quay."
MORE = "It is said that those who lived by the water were happy with what they had and that they did not want for more."

CASES = {
    "article element": (f"<nav><a href=/>Home</a></nav><article><h1>Title</h1><p>{PROSE}</p><p>Short.</p></article><footer>x</footer>", f"Title\n{PROSE}\nShort."),
    "no semantic tags": (f"<div class=menu><a href=a>One</a> <a href=b>Two</a></div><div><h2>Head</h2><p>{PROSE}<p>Yes.<p>{MORE}</div><div class='cookie-notice'>We use cookies and it is good for all of you.</div>",
                         f"Head\n{PROSE}\nYes.\n{MORE}"),
    "links without classes": (f"<ul><li><a href=a>One page of the site</a><li><a href=b>Two pages of the site that are long</a></ul><p>{PROSE}</p><p>{MORE}</p>", f"{PROSE}\n{MORE}"),
    "comments, sidebar, form": (f"<main><p>{PROSE}</p><section id=comments><p>{MORE}</p></section><aside>{MORE}</aside><form><p>{MORE}</p></form></main>", PROSE),
    "hidden": (f"<article><p>{PROSE}</p><script>if (a<b) {{'</p>'}}</script><style>p{{}}</style><div hidden>{MORE}</div><noscript>{MORE}</noscript><!-- {MORE} --></article>", PROSE),
    "references and white space": ("<article><p>a &amp; b&nbsp;c\n\t d&lt;p&gt; &#233;&#x1F600; <b>bo</b>ld &copy</p></article>", "a & b c d<p> é😀 bold ©"),
    "line breaks end blocks": ("<article>one<br>two<hr/>three<div>four</div>five</article>", "one\ntwo\nthree\nfour\nfive"),
    "header of the page, header of the article": (f"<header><p>{MORE}</p></header><article><header><h1>T</h1></header><p>{PROSE}</p></article>", f"T\n{PROSE}"),
    "roles": (f"<div role=banner>{MORE}</div><div role=main><p>{PROSE}</p></div><div role='contentinfo'>{MORE}</div>", PROSE),
    "class that tells a state": (f"<div class='has-comments post'><p>{PROSE}</p><p>{MORE}</p></div>", f"{PROSE}\n{MORE}"),
    "share button on the article": (f"<div class='share-enabled content'><p>{PROSE}</p></div><div class=share><p>{MORE}</p></div>", PROSE),
    "page in a form": (f"<form id=f><div class=menu>{MORE}</div><p>{PROSE}</p><p>{MORE}</p><p>{PROSE}</p><div class=comments><p>{MORE}</p></div></form>", f"{PROSE}\n{MORE}\n{PROSE}"),
    "apostrophe in a bare value": (f"<article><img alt=it's src=x><p>{PROSE}</p></article><footer>it's {MORE}</footer>", PROSE),
    "links and adverts in the article": (f"<article><p>{PROSE}</p><ul><li><a href=a>One page</a><li><a href=b>Two pages</a></ul><p>Advertisement</p><p>So.</p><p>{MORE}</p></article>", f"{PROSE}\nSo.\n{MORE}"),
    "heading of links": (f"<article><p>{PROSE}</p><h3>See more</h3><ul><li><a href=a>One page of it</a></ul></article>", PROSE),
    "nearest neighbour decides": (f"<div><a href=a>Some long link text</a></div><div>Near.</div><div>Nearer.</div><div>Yes.</div><p>{PROSE}</p>", f"Nearer.\nYes.\n{PROSE}"),
    "no article": ("<nav><a href=a>Home</a></nav><footer>All rights</footer>", ""),
    "broken": (f"<article><p>{PROSE}<p class='x>{MORE}", PROSE),
    "script without spaces": ("<div class=menu><a href=a>ホーム</a></div><div><p>昨日は雨が降っていたので、川の水がとても高くなり、船は港から出ることができませんでした。</p><p>はい。</p></div><footer>著作権</footer>",
                              "昨日は雨が降っていたので、川の水がとても高くなり、船は港から出ることができませんでした。\nはい。"),
    "two paragraphs in a form": (f"<form><input name=q><p>{PROSE}</p><p>{MORE}</p></form>", f"{PROSE}\n{MORE}"),
    "class of the article and one that is bad in part": (f"<div class='post-content share-buttons-below'><p>{PROSE}</p></div><div class='share-buttons'><p>{MORE}</p></div>", PROSE),
    "class of the article and one that is bad": (f"<p>{PROSE}</p><div class='content sidebar'><p>{MORE}</p></div>", PROSE),
    "no stop words": ("<div>Zorblat kimpet vandru solpek mirtan gelbor huskin talver porzen dwimmel kastrop felnir bruzzle quontar yeldin wexpat</div><div><a href=a>Home</a></div>",
                      "Zorblat kimpet vandru solpek mirtan gelbor huskin talver porzen dwimmel kastrop felnir bruzzle quontar yeldin wexpat"),
    "only short labels": ("<div>Log in</div><div>Your name</div><div><a href=a>Home page of the site</a></div>", ""),
    "comments by another name": (f"<p>{PROSE}</p><section id='reader-feedback'><p>{MORE}</p></section>", PROSE),
    "rights in a plain part": (f"<div><p>{PROSE}</p></div><div>Copyright 2024 The Company of the River. All rights reserved.</div><div>We use cookies so that all of you have a good time on the site.</div>", PROSE),
    "article on rights": (f"<article><p>{PROSE}</p><p>© 2024 by us.</p><p>All rights reserved.</p></article>", f"{PROSE}\n© 2024 by us.\nAll rights reserved."),
    "rights at the end of a plain text": (f"<div><p>{PROSE}</p><p>All rights reserved.</p></div>", f"{PROSE}\nAll rights reserved."),
    "empty": ("", ""), "none": (None, ""), "plain text": (PROSE, PROSE),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(name):
    page, want = CASES[name]
    assert extract(page) == want


def test_long_page_keeps_everything():
    page = "<article>" + f"<p>{PROSE}</p>" * 5000 + "</article>"
    assert extract(page) == "\n".join([PROSE] * 5000)


def test_broken_pages_take_linear_time():
    for page in ("<div>" * 40_000, "<b>" * 20_000 + "</i>" * 20_000, "<td>x" * 20_000, "<p>Hm.</p>" * 30_000, "<a href='" * 20_000, "<i =" * 20_000):
        began = time.perf_counter()
        extract(page + PROSE)
        assert time.perf_counter() - began < 5, page[:20]


def test_deep_nesting_and_many_tags():
    assert extract("<div>" * 3000 + PROSE + "</div>" * 3000) == PROSE


def test_rows(spark):
    rows = [(1, "u", CASES["hidden"][0], "x"), (1, "u", CASES["hidden"][0], "x"), (2, None, None, None), (None, "v", "", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((tuple(r) for r in extract_pages(df).collect()), key=str)
    assert got == sorted([(1, "u", PROSE, len(PROSE))] * 2 + [(2, None, "", 0), (None, "v", "", 0)], key=str)
    assert extract_pages(df.limit(0)).count() == 0
