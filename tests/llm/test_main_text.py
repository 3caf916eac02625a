"""What stands in an article stays, whatever element holds it, and an element without an end tag does not cut it."""

import itertools
import math

import pytest

from rolescope.llm.dom import Page
from rolescope.llm.html_content import ContentModel, observed
from rolescope.llm.labelled_pages import LINE, LONG, MENU, PAGES

MODEL = ContentModel(PAGES)


def extracted(inside):
    return MODEL.extract(f"<html><body><nav>{MENU}</nav><article><h1>A headline</h1><p>{LONG}</p>{inside}<p>{LINE} Last.</p></article>"
                         f"<form><label>Your mail</label><select><option>One</option></select></form><footer><p>{LINE} Foot.</p></footer></body></html>")


@pytest.mark.parametrize("inside", [
    "<figure><img src='x'><figcaption>The held words.</figcaption></figure>",
    "<figure><table><tr><td>The held words.</td></tr></table></figure>", "<figure><pre>The held words.</pre></figure>",
    "<details><summary>More</summary><p>The held words.</p></details>", "<details><summary>The held words.</summary></details>",
    "<address>The held words.</address>", "<p>So <math><mi>The</mi> <mo>held</mo> <mi>words.</mi></math> it is.</p>",
    "<object data='x'><p>The held words.</p></object>", "<p><label>The held words.</label></p>",
    "<p><svg><path d='x'/></svg>The held words.</p>"])
def test_all_that_an_article_holds_stays(inside):
    text = extracted(inside)
    assert "The held words." in text and "Last." in text
    assert not any(out in text for out in ("Foot.", "Your mail", "One\n", "Home"))


@pytest.mark.parametrize("tag", ["svg", "math", "object", "select", "template"])
def test_an_element_without_an_end_tag_cuts_nothing(tag):
    text = extracted(f"<{tag}><p>The held words.</p>").replace("</select>", "")
    assert "The held words." in text and "Last." in text


def test_raw_text_and_hidden_parts_stay_out():
    text = extracted("<script>one()</script><template><p>two</p></template><select><option>three</option></select>")
    assert text == extracted("")


NAMES = ["has-sidebar", "widget-area", "search-results", "no-ads", "comment-open", "social-policy", "social-feed", "with-banner", "privacy"]


@pytest.mark.parametrize("name", NAMES)
def test_a_name_does_not_drop_an_article(name):
    story = f"<h1>A headline</h1><p>{LONG}</p><p>{LINE} Held.</p><p>{LONG}</p>"
    for wrapped in (f'<div class="{name}">{story}</div>', f'<article class="{name}">{story}</article>',
                    f'<div class="{name}"><article>{story}</article></div>', f'<div class="{name}"><nav>{MENU}</nav>{story}</div>'):
        text = MODEL.extract(f"<html><body><nav>{MENU}</nav>{wrapped}<footer><p>{LINE} Foot.</p></footer></body></html>")
        assert "A headline" in text and "Held." in text and text.count(LONG.strip()) == 2
        assert "Foot." not in text and "Home" not in text


@pytest.mark.parametrize("inside", [
    '<h2 id="privacy">The held words.</h2>', f'<section id="search-engines"><p>The held words.</p><p>{LINE}</p></section>',
    '<p class="notice-period">The held words.</p>', '<ul class="links"><li>The held words.</li><li>some more</li></ul>'])
def test_names_inside_an_article(inside):
    assert "The held words." in extracted(inside)


def test_comments_without_a_class():
    for title in ("Reader comments", "3 Comments", "Comments (12)", "Leave a reply"):
        page = (f"<html><body><article><h1>A headline</h1><p>{LONG}</p><p>{LINE} Last.</p></article>"
                f"<section><h2>{title}</h2><p>{LONG} Reader.</p><p>{LINE} Reader.</p></section></body></html>")
        text = MODEL.extract(page)
        assert "Last." in text and "Reader." not in text


@pytest.mark.parametrize("html", ["<div><p>one</p><nav><a>two</a></nav></div>", f"<article><h1>t</h1><p>{LINE}</p></article><div class='ad'>x</div>"])
def test_marginals_are_those_of_all_labellings(html):
    """On small trees every labelling is weighed; the message passing gives the same shares."""
    page = Page(html)
    tables = [MODEL.potential(kind, features) for kind, features in observed(page)]
    shares, whole = [0.0] * len(tables), 0.0
    for labels in itertools.product((0, 1), repeat=len(tables) - 1):
        labels = (0, *labels)  # the page itself is not content
        weight = math.prod(tables[at][2 * labels[page.parents[at]] + labels[at]] for at in range(1, len(tables)))
        whole += weight
        shares = [share + weight * label for share, label in zip(shares, labels, strict=True)]
    for found, share in zip(MODEL.marginals(page)[1:], shares[1:], strict=True):
        assert math.isclose(found, share / whole, rel_tol=1e-6)
