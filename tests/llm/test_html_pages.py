"""Pages whose markup misleads: the article is known by how each page is made."""

import random

import pytest

from factloom.llm.html_extraction import main_text

TEXT = ["The first paragraph of the article tells what it is about, at some length.", "A second one goes on with the story, and it has a few more words than the first had.", "It ends here, as all things do."]
BODY = "".join(f"<p>{p}</p>" for p in TEXT)
AROUND = "<nav><ul><li><a href=/>Home</a></li><li><a href=/b>About us</a></li></ul></nav>{}<footer><p>All rights reserved by the people who made this.</p></footer>"


@pytest.mark.parametrize(
    "part",
    [
        '<article class="post type-post comments-open">{}</article>',
        '<article class="post category-legal tag-search">{}</article>',
        '<div class="article-body legal">{}</div>',
        '<div class="layout sidebar-right"><article>{}</article></div>',
        '<form id="aspnetForm"><div class="content"><article>{}</article></div></form>',
        '<article data-id="login">{}</article>',
        '<div class="has-sidebar page-wrapper menu-closed"><main>{}</main></div>',
        '<div id="modal-root"><div class="social"><h1>Title of the page</h1>{}</div></div>',
        '<article title="class=ad" data-class="ad banner">{}</article>',
    ],
)
def test_articles_in_misleading_markup(part):
    for page in (part.format(BODY), "<html><body>" + AROUND.format(part.format(BODY)) + "</body></html>"):
        assert main_text(page).split("\n")[-3:] == TEXT


def test_labels_in_sentences_stay():
    assert main_text("<article><p>As <label>Figure 3</label> shows, the curve goes up and then down again.</p></article>") == "As Figure 3 shows, the curve goes up and then down again."


@pytest.mark.parametrize(
    "part",
    [
        '<div id="comments">{}</div>', '<section class="comments-area"><article class="comment"><div class="comment-content">{}</div></article></section>', '<aside class="widget">{}</aside>', '<div class="cookie-notice">{}</div>', '<form action="/s"><label>Mail</label><p>{}</p><input></form>',
        '<div class="related"><article class="teaser">{}</article></div>', '<div class="newsletter-signup open">{}</div>', '<div role="dialog" class="modal">{}</div>',
    ],
)
def test_parts_called_boilerplate_go(part):
    noise = "<p>I really liked reading all of this, thanks a lot to whoever wrote it down.</p>"
    assert main_text(f"<html><body><article>{BODY}</article>{part.format(noise)}</body></html>") == "\n".join(TEXT)


def test_more_comments_than_article():
    comments = "".join(f'<article class="comment" id="comment-{k}"><div class="content"><p>Comment number {k} of a reader who had a good deal to say about it all.</p></div></article>' for k in range(12))
    assert main_text(f'<html><body><article>{BODY}</article><section id="comments">{comments}</section></body></html>') == "\n".join(TEXT)


def test_wrappers_of_any_name():
    """However the wrappers around a page's article are called, and whatever stands beside it, the article is what stays."""
    r = random.Random(8)
    names = ["layout sidebar-left", "wrapper menu-open", "page has-banner", "site no-sidebar", "category-ads", "content", "grid", "social", "main", "inner overlay", "widget", "x tag-login"]
    beside = ['<div class="ad">Buy this now, it is the best of all things you can buy.</div>', '<aside><p>About the author, who has written many books and lives by the sea.</p></aside>', '<div class="share"><a href=#>Share</a> <a href=#>Mail</a></div>', '<div class="comments"><p>Nice one, I have thought so myself for many years now.</p></div>']
    for _ in range(200):
        page = f"<article>{BODY}</article>"
        for _ in range(r.randrange(1, 4)):
            page = f'<div class="{r.choice(names)}">{r.choice(beside) if r.random() < 0.5 else ""}{page}{r.choice(beside) if r.random() < 0.5 else ""}</div>'
        assert main_text(f"<html><body>{AROUND.format(page)}</body></html>") == "\n".join(TEXT), page
