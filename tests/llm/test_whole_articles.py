"""Articles whose parts lie in children of their own."""

import pytest

from lexquarry.llm import html

ASIDES = "<html><body><nav><a href='/'>Home page</a></nav>%s<div class='promo'>Buy this now</div><footer>me</footer></body></html>"


@pytest.mark.parametrize(
    "article",
    [
        "<article><h1>T</h1><section class=lead><p>Lead text.</p></section><section class=rest><p>%s</p></section></article>",
        "<article><h1>T</h1><section><p>Lead text.</p></section><section><p>%s</p></section></article>",
        "<article><h1>T</h1><p>Lead text.</p><div class='entry-content'><p>%s</p></div></article>",
        "<main><h1>T</h1><div class=lead><p>Lead text.</p></div><div class=rest><p>%s</p></div></main>",
        "<div class='post'><h1>T</h1><div class=lead>Lead text.</div><div class=rest><p>%s</p></div></div>",
    ],
)
def test_sectioned_articles_are_whole(article):
    page = ASIDES % article % ("rest " * 30)
    assert html.extract(page, html.vote(page)[0])[0] == "T\nLead text.\n" + ("rest " * 30).strip()


def test_articles_of_a_list_stay_apart_from_what_is_around():
    page = "<main><p>Welcome.</p>%s<section><ul>%s</ul></section></main>" % ("<article><h2>H</h2><div class=a><p>text %s</p></div></article>" % ("word " * 20) * 2, "<li><a href='/'>another page</a></li>" * 20)
    assert html.vote(page)[0] == "/main/article"
    assert "another" not in html.extract(page, None)[0]
