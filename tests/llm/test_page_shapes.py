"""Main text of pages of many shapes: every paragraph of the article stays, the parts around it go."""

import pytest

from tickledger.llm import main_text

A = " ".join(f"first{i}" for i in range(68)) + "."
B = " ".join(f"second{i}" for i in range(40)) + "."
C = "A short closing line."
H = "Title of the story"
P = f"<p>{A}</p><p>{B}</p>"
AB = f"{A}\n\n{B}"
MENU = "<ul><li><a href=a>Home</a></li><li><a href=b>News</a></li><li><a href=c>About</a></li></ul>"
LINKS = "<p><a href=x>Next story</a></p>"

SHAPES = {
    "nav after main": (f"<main>{P}</main><nav>{LINKS}</nav>", AB),
    "footer after article": (f"<article>{P}</article><footer><a href=x>Contact</a> us</footer>", AB),
    "nav before": (f"<nav>{MENU}</nav><article>{P}</article>", AB),
    "plain divs": (f"<div>{MENU}</div><div>{P}</div><div>{MENU}</div>", AB),
    "plain body": (f"<body>{P}</body>", AB),
    "heading": (f"<article><h1>{H}</h1>{P}</article>", f"{H}\n\n{AB}"),
    "linked heading": (f"<article><h1><a href=x>{H}</a></h1>{P}</article>", f"{H}\n\n{AB}"),
    "link paragraph inside": (f"<article><p>{A}</p>{LINKS}<p>{B}</p></article>", f"{A}\n\nNext story\n\n{B}"),
    "paragraph full of links": (f"<article><p>{A}</p><p><a>{B}</a></p></article>", AB),
    "short last line": (f"<article>{P}<p>{C}</p></article><footer>x y</footer>", f"{AB}\n\n{C}"),
    "sources": (f"<article>{P}<h2>Sources</h2><ul><li><a>The first source of this long story</a></li><li><a>Another source of the same story</a></li></ul></article>",
                f"{AB}\n\nSources\n\nThe first source of this long story\n\nAnother source of the same story"),
    "menu inside": (f"<article>{MENU}{P}</article>", AB),
    "page-wide form": (f"<form id=aspnet><main>{P}</main></form>", AB),
    "form beside": (f"<main>{P}<form><p>Write your name here</p></form></main>", AB),
    "wrapper with widget": (f"<div class='article-with-widget'>{P}</div>", AB),
    "wrapper with sidebar": (f"<div class='layout has-sidebar'><article>{P}</article><div class='sidebar'><p>{B}</p></div></div>", AB),
    "related work": (f"<article><p>{A}</p><section class='related-work'><h2>Related work</h2><p>{B}</p></section></article>", f"{A}\n\nRelated work\n\n{B}"),
    "related posts": (f"<article><p>{A}</p><div class='related-posts'><h3>More</h3><p>{B}</p></div></article>", A),
    "advert": (f"<div class=ad>{B}</div><article><p>{A}</p></article>", A),
    "advert inside": (f"<article><p>{A}</p><div class='ad-slot'>{B}</div><p>{C}</p></article>", f"{A}\n\n{C}"),
    "cookie notice": (f"<div id='cookie-notice'>{B}</div><div>{P}</div>", AB),
    "cookie text without a name": (f"<div>We use cookies to improve this site.</div><div>{P}</div>", AB),
    "rights without a name": (f"<div>{P}</div><div>© 2024 Some House. All rights reserved.</div>", AB),
    "rights as a topic": (f"<article><p>{A}</p><p>The word copyright {B}</p></article>", f"{A}\n\nThe word copyright {B}"),
    "comments": (f"<article><p>{A}</p></article><section class='comments'><p>{B}</p></section>", A),
    "comment list in the article": (f"<article><p>{A}</p><div id='comment-list'><div class='comment-body'>{B}</div></div></article>", A),
    "aside": (f"<main><p>{A}</p><aside><p>{B}</p></aside></main>", A),
    "teasers in an aside": (f"<main><p>{A}</p></main><aside><article><p>{B}</p></article></aside>", A),
    "page header": (f"<header><h1>Site</h1><p>{B}</p></header><main><p>{A}</p></main>", A),
    "article header": (f"<article><header><h1>{H}</h1></header><p>{A}</p></article>", f"{H}\n\n{A}"),
    "roles": (f"<div role=navigation><p>{B}</p></div><div role=main><p>{A}</p></div><div role=contentinfo><p>{B}</p></div>", A),
    "share bar": (f"<article><div class='share-buttons'><a>Tweet</a> <a>Like</a></div><p>{A}</p></article>", A),
    "short blocks of a table": (f"<article><table><tr><td>one</td><td>two</td></tr></table><p>{A}</p></article>", f"one\n\ntwo\n\n{A}"),
    "list": (f"<article><p>{A}</p><ul><li>milk</li><li>two eggs</li></ul></article>", f"{A}\n\nmilk\n\ntwo eggs"),
    "quote": (f"<article><blockquote>{C}</blockquote><p>{A}</p></article>", f"{C}\n\n{A}"),
    "unclosed": (f"<nav>{MENU}</nav><article><p>{A}<p>{B}", AB),
    "script and style": (f"<style>p{{}}</style><script>var x='<p>{C}</p>'</script><main>{P}</main>", AB),
    "only a menu": (f"<nav>{MENU}</nav>", ""),
    "only links": (f"<div>{MENU}</div>", ""),
    "newsletter": (f"<main><p>{A}</p><div class='newsletter-signup'><p>{B}</p></div></main>", A),
    "breadcrumbs": (f"<div class='breadcrumbs'><a>Home</a> &gt; <a>News</a></div><div>{P}</div>", AB),
}


@pytest.mark.parametrize("name", SHAPES)
def test_shape(name):
    page, expected = SHAPES[name]
    assert main_text.main_text(page) == expected
    assert main_text.main_text(f"<!DOCTYPE html><html><head><title>t</title></head><body class='with-sidebar'>{page}</body></html>") == expected


def columns(node):
    return {node[0]} | columns(node[2]) | columns(node[3]) if isinstance(node, tuple) else set()


def test_the_tree_reads_counts_and_densities_of_blocks_and_neighbours():
    assert columns(main_text.tree()) >= {0, 1, 2, 3, 4, 5}
    wrong = [row for row in main_text.LABELLED if main_text.is_content(main_text.tree(), tuple(row[:-1])) != row[-1]]
    assert len(wrong) <= 0.02 * len(main_text.LABELLED)
