"""Main text of pages labelled by hand, of many layouts."""

import pytest

from quarry.llm import html_text

LONG = "The river rose for three days before anyone in the valley thought of leaving, and by then the lower road was gone under brown water."
MORE = "On the fourth morning a boat came down from the upper farms, and the two men in it had seen the bridge go with their own eyes."
SHORT = "Nobody spoke."
NAV = "<nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/c>Contact us</a></li></ul></nav>"
FOOT = "<footer><p>&copy; 2024 The Valley Post. All rights reserved.</p><p><a href=/p>Privacy</a> <a href=/t>Terms</a></p></footer>"

PAGES = {
    "plain article": (f"{NAV}<article><h1>Flood</h1><p>{LONG}</p><p>{SHORT}</p><p>{MORE}</p></article>{FOOT}", f"Flood {LONG} {SHORT} {MORE}"),
    "an article's own search section": (f'<article><p>{LONG}</p><section id="search"><p>{MORE}</p></section></article>', f"{LONG} {MORE}"),
    "an article's own form section": (f'<article><h1>Flood</h1><p>{LONG}</p><section class="form"><p>{MORE}</p></section></article>{FOOT}', f"Flood {LONG} {MORE}"),
    "a hidden-like attribute": (f'<article data-hidden="false"><p>{LONG}</p></article>', LONG),
    "a hidden-like title": (f'<article><div title="no longer hidden"><p>{LONG}</p></div></article>', LONG),
    "hidden parts": (f'<article><p>{LONG}</p><div hidden><p>{MORE}</p></div><p style="display: none">{MORE}</p><div aria-hidden="true">{MORE}</div></article>', LONG),
    "advert paragraphs": (f'<article><p>{LONG}</p><p class="advert">Get two boats for the price of one at Miller and Sons, this week only.</p><p>{MORE}</p><p class="newsletter-signup">Have our best stories sent to you every morning before breakfast.</p></article>', f"{LONG} {MORE}"),
    "a list of contents": (f'<article><h1>Flood</h1><ul class="toc"><li><a href=#a>The first day</a></li><li><a href=#b>The second day</a></li><li><a href=#c>After the bridge fell</a></li></ul><p>{LONG}</p><p>{MORE}</p></article>', f"Flood {LONG} {MORE}"),
    "reader comments": (f'{NAV}<article><h1>Flood</h1><p>{LONG}</p></article><section id="comments"><h2>2 comments</h2><p>{MORE}</p><p>I was there and I never saw a boat, whatever people now say about it.</p></section>{FOOT}', f"Flood {LONG}"),
    "comments inside": (f'<article><p>{LONG}</p><div class="comment-list"><p>{MORE}</p></div></article>', LONG),
    "no container": (f"{NAV}<div class=wrap><h1>The flood of that year</h1><p>{LONG}</p><p>{MORE}</p></div>{FOOT}", f"The flood of that year {LONG} {MORE}"),
    "sidebar and notice": (f'<header><h1>The Valley Post</h1></header><div class="cookie-notice">We use cookies to make this site work for you.</div><main><p>{LONG}</p><p>{MORE}</p></main><aside><p>{MORE}</p></aside>{FOOT}', f"{LONG} {MORE}"),
    "forms and scripts": (f'<article><p>{LONG}</p><form><label>Your name</label><input><button>Send</button></form><script>var a = "<p>no</p>";</script><style>p {{}}</style></article>', LONG),
    "markup inside": ("<article><h1>A &amp; B</h1><p>One <b>bo</b>ld,\n\n two <i>sl</i>anted&nbsp;words<br>and a break, &lt;tag&gt; &eacute;t&#233; <a href=x>linked</a> in a line of text.</p></article>", "A & B One bold, two slanted words and a break, <tag> \u00e9t\u00e9 linked in a line of text."),
    "a paragraph before related links": (f'<article><p>{LONG}</p><p>{SHORT}</p><ul><li><a href=/1>More about the valley</a></li><li><a href=/2>All about boats</a></li></ul></article>{FOOT}', f"{LONG} {SHORT}"),
    "a list and a table in an article": (f"<article><p>{LONG}</p><ul><li>two boats and their oars</li><li>forty sheep from the lower farms</li></ul><table><tr><th>Farm</th><td>lost</td></tr></table><p>{MORE}</p></article>", f"{LONG} two boats and their oars forty sheep from the lower farms Farm lost {MORE}"),
    "a heading inside the article's header": (f"<article><header><h1>Flood</h1></header><p>{LONG}</p></article>", f"Flood {LONG}"),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages_labelled_by_hand(name):
    page, want = PAGES[name]
    assert html_text.main_text(f"<!DOCTYPE html><html><head><title>t</title></head><body>{page}</body></html>") == want


def test_every_decision_starts_with_words_or_links():
    tree = html_text.tree()
    assert html_text.FEATURES[tree.feature] in ("words", "links", "words_before", "links_before", "words_after", "links_after")
    used, todo = set(), [tree]
    while todo:
        node = todo.pop()
        if node.feature >= 0:
            used.add(html_text.FEATURES[node.feature])
            todo += [node.low, node.high]
    assert {"words", "links", "links_after", "in_article", "outside", "hint"} <= used


def test_very_long_page():
    page = "<article>" + f"<p>{LONG}</p>" * 5000 + "</article>"
    assert html_text.main_text(page) == " ".join([LONG] * 5000)
