"""Main text of pages that the training pages' generator did not make, what the messages add, and hostile pages."""

from __future__ import annotations

import html
import re
import time

import pytest

from evidora.llm import html_pages, html_text
from evidora.llm.common import table

A = "The council met on Tuesday to decide how the old harbour should be rebuilt, and the vote was close."
B = "Several members said that the cost would be too high, but the mayor promised that the money was there."
C = "Work is to begin in spring, when the water is low enough for the divers to reach the wall."
PAGES = [
    (f'<body><nav><a href=a>Home</a> <a href=b>News</a></nav><article class="post tag-advert category-newsletter"><h1>Harbour</h1><p>{A}</p><p>{B}</p></article><footer>(c) Town</footer></body>', f"Harbour\n{A}\n{B}"),
    (f'<body><div class="post-comments-guidelines article-body"><h1>Harbour</h1><p>{A}</p><p>{B}</p><p>{C}</p></div></body>', f"Harbour\n{A}\n{B}\n{C}"),
    (f'<body><ul class="menu"><li><a href=1>One</a><li><a href=2>Two</a></ul><article><h1>Harbour</h1><p>{A}</p><p>{B}</p><div class="feedback"><div><b>Ann</b>: I do not agree.</div><div><b>Bob</b>: Well said.</div><div><b>Cy</b>: Too dear.</div></div></article></body>', f"Harbour\n{A}\n{B}"),
    (f'<body><div id="x1"><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></div><div id="x2"><h1>Harbour</h1><p>{A}</p><p>{B}</p><p>{C}</p></div><div id="x3"><a href=9>Imprint</a> <a href=8>Privacy</a></div></body>', f"Harbour\n{A}\n{B}\n{C}"),
    (f'<body><header><h2>The Daily</h2><a href=/>Home</a></header><main><article><header><h1>Harbour</h1></header><p>{A}</p><aside><p>Read also: <a href=q>the bridge</a></p></aside><p>{B}</p></article>'
     f'<section class="comments"><h3>3 comments</h3><p>Nice.</p><p>No.</p></section></main><aside><h3>Popular</h3><ul><li><a href=z>Storm</a></li><li><a href=y>Fair</a></li></ul></aside><footer>&copy; 2024</footer></body>', f"Harbour\n{A}\n{B}"),
    (f'<body><div class="cookie-banner"><p>We use cookies. <a href=c>More</a></p></div><div class="content"><p>{A}</p><ul><li>cost</li><li>time</li></ul><p>{B}</p><form><label>Mail</label><input><p>Sign up</p></form></div><div class="footer">Contact us</div></body>', f"{A}\ncost\ntime\n{B}"),
    (f'<body><nav><ul><li><a href="/a">a</a></li><li><a href="/b">b</a></li></ul></nav><div class="ad">Buy the best boats of the whole coast here.</div><article><h1>T.</h1><p>Short.</p></article><footer>&copy; x.org &middot; {A}</footer></body>', "T.\nShort."),
    (f'<body><article><h1>Harbour</h1><p>{A}</p><div class="ad">Buy boats.</div><p>{B}</p><div class="newsletter"><p>Get our letter.</p></div><p>{C}</p></article></body>', f"Harbour\n{A}\n{B}\n{C}"),
]

NAV = "<nav><ul><li><a href=a>Home</a></li><li><a href=b>News</a></li><li><a href=c>About us</a></li></ul></nav>"
FOOT = "<footer><p>&copy; 2024 The Harbour Post</p></footer>"
LISTS = [
    (f"<main><h1>Recipe</h1><p>{A}</p><ul><li>2 eggs</li><li>100 g flour</li><li>salt</li></ul><h2>Steps</h2><ol><li>Mix all.</li><li>Bake it.</li></ol></main>", f"Recipe\n{A}\n2 eggs\n100 g flour\nsalt\nSteps\nMix all.\nBake it."),
    ("<article><h1>Recipe</h1><ul><li>2 eggs</li><li>flour</li></ul><ol><li>Mix all.</li><li>Bake it.</li></ol></article>", "Recipe\n2 eggs\nflour\nMix all.\nBake it."),
    (f"<article><h1>Books</h1><p>{A}</p><ul><li><a href=1>The old wall</a></li><li><a href=2>Stone and sea</a></li></ul><p>{B}</p></article>", f"Books\n{A}\nThe old wall\nStone and sea\n{B}"),
    (f"{NAV}<article><h1>Terms</h1><dl><dt>Quay</dt><dd>where boats land</dd><dt>Mole</dt><dd>a wall in the sea</dd></dl><p>{A}</p></article>{FOOT}", f"Terms\nQuay\nwhere boats land\nMole\na wall in the sea\n{A}"),
    (f"{NAV}<main><h1>Results</h1><p>{A}</p><table><tr><th>Team</th><th>Points</th></tr><tr><td>North</td><td>12</td></tr><tr><td>South</td><td>9</td></tr></table></main>{FOOT}", f"Results\n{A}\nTeam\nPoints\nNorth\n12\nSouth\n9"),
    (f"{NAV}<main><article><h1>Plan</h1><p>{A}</p><h2>We need</h2><ul><li>time<li>money<li>stone</ul><p>{B}</p></article></main><aside><h3>Popular</h3><ul><li><a href=z>Storm</a></li><li><a href=y>Fair</a></li></ul></aside>{FOOT}", f"Plan\n{A}\nWe need\ntime\nmoney\nstone\n{B}"),
    (f"{NAV}<article><h1>Works</h1><p>{B}</p><ol><li><a href=1>First</a>, 1990</li><li><a href=2>Second</a>, 1994</li><li><a href=3>Third</a>, 2001</li></ol></article>{FOOT}", f"Works\n{B}\nFirst, 1990\nSecond, 1994\nThird, 2001"),
    (f'{NAV}<div class="content"><h1>Rules</h1><p>{A}</p><ol><li>Do not run.</li><li>Do not dive.</li></ol><p>{C}</p></div><div class="footer">Contact</div>', f"Rules\n{A}\nDo not run.\nDo not dive.\n{C}"),
    (f"{NAV}<article><h1>Walk</h1><ul><li><b>Start</b>: the mill</li><li><b>End</b>: the quay</li></ul><p>{A}</p><p>{C}</p></article>{FOOT}", f"Walk\nStart: the mill\nEnd: the quay\n{A}\n{C}"),
    (f'{NAV}<article><h1>Boats</h1><p>{A}</p><ul><li><p>Red</p></li><li><p>Blue</p></li></ul><div class="share"><a href=1>Mail</a> <a href=2>Post</a></div><p>{B}</p></article>{FOOT}', f"Boats\n{A}\nRed\nBlue\n{B}"),
    (f"{NAV}<main><h1>Shops</h1><p>{A}</p><h3>Open</h3><ul><li>Monday</li><li>Friday</li></ul><h3>Shut</h3><ul><li>Sunday</li></ul><p>{C}</p></main>{FOOT}", f"Shops\n{A}\nOpen\nMonday\nFriday\nShut\nSunday\n{C}"),
    (f"<header><a href=/>Post</a></header><article><h1>Steps</h1><p>{C}</p><ol><li>{A}</li><li>{B}</li></ol></article>{FOOT}", f"Steps\n{C}\n{A}\n{B}"),
    (f'{NAV}<article><h1>Links</h1><p>{A}</p><p>See also:</p><ul><li><a href=1>The mayor</a></li><li><a href=2>The council</a></li><li><a href=3>The harbour</a></li></ul><p>{B}</p></article><section class="comments"><ul><li>Nice.</li><li>No.</li></ul></section>', f"Links\n{A}\nSee also:\nThe mayor\nThe council\nThe harbour\n{B}"),
    (f'<ul class="menu"><li><a href=1>One</a><li><a href=2>Two</a></ul><div class="post"><h1>Tools</h1><p>{A}</p><ul><li>spade</li><li>rope</li></ul></div><ul class="menu"><li><a href=8>Imprint</a><li><a href=9>Privacy</a></ul>', f"Tools\n{A}\nspade\nrope"),
]


def test_lists_of_articles_are_kept_and_menus_are_not(model):
    """Of the blocks of these pages none of an article is lost, and none of a menu comes in."""
    for page, want in LISTS:
        assert model.extract(page) == want, page


@pytest.fixture(scope="module")
def model():
    return html_text.TreeModel()


@pytest.mark.parametrize("number", range(len(PAGES)))
def test_pages_written_by_hand(model, number):
    page, want = PAGES[number]
    assert model.extract(page) == want


def test_custom_elements_and_unended_ones_lose_no_text(model):
    text = model.extract(f"<article><h1>T</h1><svg-icon></svg-icon><p>{A}</p><button-group><p>{B}</p></button-group><svg><p>{C}</p></article>")
    assert all(x in text for x in (A, B, C))


def test_the_tables_pages_give_their_articles(spark, model):
    """These pages mark their article, so what should come out can be read off by a pattern."""
    pages = table(spark, "/root/testdata/sf0.1", "pages").select("html").collect()
    for r, text in zip(pages, model.extract_all([r.html for r in pages]), strict=True):
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert text == "\n".join(b for b in blocks if b)


def _errors(model, messages):
    wrong = total = 0
    for page in map(html_pages.labelled_page, range(2000, 2120)):
        nodes = html_text.parse(page)
        for n, s, p in zip(nodes, model.states(nodes), model.marginals([nodes], messages), strict=True):
            if n.text:
                total += 1
                wrong += (p > 0.5) != (s == html_text.MAIN)
    assert total > 1500
    return wrong / total


def test_messages_decide(model):
    """On fresh pages, a sixth of which have names that say nothing, each block alone is wrong more than twice as often."""
    assert _errors(model, True) < 0.07 and _errors(model, False) > 2 * _errors(model, True)


@pytest.mark.parametrize("piece", ["<div>", "<p>", "</p>", '<a b="', "<a '\"", "<svg>", "<ul><li>", "<b>", "<table><td>", "<b></i>", "<!-", "<", "<dl><dt>", "&amp;", "<a  =", "<script>"])
def test_time_grows_with_the_page_only(piece):
    def seconds(size):
        began = time.process_time()
        html_text.parse(piece * (size // len(piece)) + "<p>x")
        return time.process_time() - began

    seconds(1000)
    assert seconds(1_000_000) < max(25 * seconds(100_000), 1.0)  # ten times the page, some noise


def test_a_megabyte_of_text_and_of_nesting(model):
    assert model.extract(f"<article><p>{'word ' * 300_000}</p></article>") == ("word " * 300_000).strip()
    model.extract("<div>" * 50_000 + f"<p>{A}")
