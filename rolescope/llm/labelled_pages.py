"""Hand-labelled pages to train the content model on: ``data-content`` labels an element and, until the next mark, its inside.

They show common layouts, with the texts shortened to their length class: menus, headers, side bars, notices, adverts, forms, comments.
"""

from __future__ import annotations

LONG = "A paragraph of the story that runs on for a while, as paragraphs of stories do, with a few clauses and no link. " * 3
LINE = "One sentence of the story, of middle length, that says a little more."
MENU = '<ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">About us</a></li></ul>'
BODY = f"<h1>A headline</h1><p>{LONG}</p><p>{LINE}</p><h2>A part</h2><p>{LONG} <a href='/x'>source</a> <b>strong</b></p><ul><li>{LINE}</li><li>short point</li></ul><blockquote><p>{LINE}</p></blockquote>"
HEAD = "<head><meta charset='utf-8'><title>A headline</title><style>p{}</style><script>x</script></head>"
NOTICE = f'<div class="cookie-notice"><p>{LINE}</p><button>Accept</button></div>'
COMMENTS = f'<div class="comments" data-content="0"><h3>Comments</h3><div class="comment"><p>{LONG}</p></div><div class="comment"><p>{LINE}</p></div></div>'
ADVERT = f'<div class="ad" data-content="0">{LINE}</div>'
FORM = '<form action="/s" data-content="0"><label>Your mail</label><input name="q"><button>Send</button></form>'
PARTS = f'<figure><pre>code of some length here</pre><figcaption>{LINE}</figcaption></figure><details><summary>short point</summary><p>{LINE}</p></details><address>{LINE}</address>'

PAGES = [
    f'<html>{HEAD}<body><nav>{MENU}</nav>{ADVERT}<article data-content="1">{BODY}</article><footer>&copy; the site, some words of it.</footer></body></html>',
    f'<html>{HEAD}<body><header><h1>The site</h1><p>{LINE}</p></header><main data-content="1">{BODY}{ADVERT}<p>{LINE}</p></main><aside><h3>Related</h3>{MENU}</aside><footer><p>{LINE}</p></footer></body></html>',
    f'<html>{HEAD}<body>{NOTICE}<div id="wrapper"><div id="menu">{MENU}</div><div id="content" data-content="1">{BODY}{COMMENTS}</div><div id="sidebar"><p>{LONG}</p>{MENU}</div></div><div id="footer"><p>{LINE}</p></div></body></html>',
    f'<html>{HEAD}<body><main><article data-content="1"><header><h1>A headline</h1></header><p>{LONG}</p><p>{LONG}</p><aside data-content="0"><p>{LONG}</p></aside><p>{LINE}</p><footer data-content="0"><p>Tags</p>{MENU}</footer></article><section class="comments"><p>{LONG}</p><p>{LINE}</p>{FORM}</section></main></body></html>',
    f'<html>{HEAD}<body><div class="topbar">{MENU}</div><div class="post-body" data-content="1"><h2>A headline</h2><p>{LONG}</p><p>{LINE}</p><div class="share" data-content="0">{MENU}</div>{FORM}<p>{LONG}</p></div><div class="related"><h3>More</h3>{MENU}<p>{LINE}</p></div></body></html>',
    f'<html>{HEAD}<body><div data-content="1"><h1>A headline</h1><p>{LONG}</p><p>{LONG}</p><p>{LINE}</p></div><div>{MENU}</div></body></html>',
    f'<html>{HEAD}<body><section class="banner"><p>{LINE}</p></section><section data-content="1">{BODY}<table><tr><td>one</td><td>two</td></tr></table></section><section class="newsletter"><p>{LINE}</p>{FORM}</section></body></html>',
    f'<html>{HEAD}<body><h1 data-content="1">A headline</h1><p data-content="1">{LONG}</p><p data-content="1">{LINE}</p><p data-content="1">{LONG}</p><footer>{LINE}</footer></body></html>',
    f'<html>{HEAD}<body><div class="page"><header class="masthead"><p>{LINE}</p>{MENU}</header><article data-content="1" class="post">{BODY}{PARTS}<div class="notice" data-content="0"><p>{LONG}</p></div></article>{COMMENTS}<aside class="sidebar"><p>{LONG}</p></aside></div></body></html>',
    f'<html>{HEAD}<body><div class="alert" role="dialog"><p>{LONG}</p></div><nav class="breadcrumb">{MENU}</nav><main><div class="entry-content" data-content="1"><p>{LONG}</p><div><p>{LINE}</p></div><pre>code of some length here</pre></div><section id="comments"><h2>Replies</h2><article data-content="0"><p>{LONG}</p></article></section></main></body></html>',
    f'<html>{HEAD}<body><div class="page" data-content="1"><nav data-content="0">{MENU}</nav><h1>A headline</h1><p>{LONG}</p><p>{LINE}</p><p>{LONG}</p></div><footer><p>{LINE}</p></footer></body></html>',
    f'<html>{HEAD}<body><nav>{MENU}</nav><div data-content="1"><h1>A headline</h1><p>{LONG}</p><ul data-content="0"><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul><h2>A part</h2><p>{LINE}</p></div></body></html>',
]
