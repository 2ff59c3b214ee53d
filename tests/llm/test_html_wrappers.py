"""Articles inside elements whose kind or name looks like boilerplate."""

import pytest

from choicefield.llm import html

ARTICLE = "<h1>Title</h1><p>Long text here, quite a bit of it indeed, enough to be an article.</p><p>More of it and so on, in a second paragraph.</p>"
TEXT = "Title\nLong text here, quite a bit of it indeed, enough to be an article.\nMore of it and so on, in a second paragraph."
REST = "<nav><a href=1>one</a> <a href=2>two</a></nav>", "<div class=sidebar>side words</div><div class=comments><p>Nice post!</p></div><footer>end</footer>"


@pytest.mark.parametrize("start, end", [
    ("<form id=aspnetForm action=x><input name=v>", "<button>Send it</button><select><option>One</select></form>"), ("<div class='content-sidebar-wrap'>", "</div>"),
    ("<div class='has-sidebar'>", "</div>"), ("<div class='no-sidebar'>", "</div>"), ("<div class='main with-comments'>", "</div>"),
    ("<form><div class='content-sidebar-wrap'><main class='site search-page'>", "</main></div></form>"), ("<aside><div role=dialog>", "</div></aside>")])
@pytest.mark.parametrize("inside", [True, False])
def test_wrapped_article_stays(start, end, inside):
    before, after = REST
    body = before + ARTICLE + after if inside else ARTICLE
    page = f"<body>{start}{body}{end}</body>" if inside else f"<body>{before}{start}{body}{end}{after}</body>"
    assert html.main_text(page) == TEXT


def test_long_boilerplate_does_not_come_back():
    comments = "<div class=comments>" + "<p>I read all of it and I have a lot to say about it.</p>" * 30 + "</div>"
    assert html.main_text(f"<body><div id=content>{ARTICLE}</div>{comments}</body>") == TEXT
    side = "<div class=sidebar>" + "<p>Some side words without any link in them.</p>" * 30 + "</div>"
    assert html.main_text(f"<body><article>{ARTICLE}</article>{side}{comments}</body>") == TEXT
    assert html.main_text("<body><div class=comments><p>only this</p></div></body>") == "only this"
