"""Pages whose main text is known because they are put together from blocks, and pages with misleading names."""

import random

import pytest

from priorline.llm import htmltext

LONG = " ".join(["word"] * 40)
MENU = "<ul><li><a href=/>Home</a><li><a href=/i>Imprint</a></ul>"


@pytest.mark.parametrize("body, want", [
    (f"<article><h1>T</h1><p>{LONG}</p></article><section id=comments><article class=comment><p>{LONG} nice</p></article></section>", f"T\n{LONG}"),
    (f"<h1>T</h1><div class=content><p>{LONG}</p></div><section id=comments><article class=comment><p>{LONG} nice</p></article></section>", f"T\n{LONG}"),
    (f"<article><h1>T</h1><p>{LONG}</p></article><aside class=related><article><h2>Card</h2><p>{LONG} card</p></article></aside>", f"T\n{LONG}"),
    (f"<aside class=related><article><p>{LONG} card</p></article></aside><article><h1>T</h1><p>{LONG}</p></article>", f"T\n{LONG}"),
    (f"<div id=text><h1>T</h1><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><div class=ad>Buy now</div><p>Short.</p><p>End.</p></div>", f"T\n{LONG}\n{LONG}\n{LONG}\nShort.\nEnd."),
    (f'<div class="content no-sidebar"><h1>T</h1><p>{LONG}</p></div>', f"T\n{LONG}"),
    (f'<div class="social-science"><h1>T</h1><p>{LONG}</p></div>', f"T\n{LONG}"),
    (f'<article><header class="post-header"><h1>T</h1></header><p>{LONG}</p></article>', f"T\n{LONG}"),
    (f'<div class="site-header">Site</div><div><div class="entry-header"><h1>T</h1></div><p>{LONG}</p></div><div class="cookie-banner-wrap">{LONG}</div>', f"T\n{LONG}"),
    (f"{MENU}<div><h1>T</h1><p>{LONG}</p></div><div><a href=1>Home</a> | <a href=2>Imprint</a></div>", f"T\n{LONG}"),
    (f"{MENU}<h1>T</h1><p>{LONG}</p><ul><li><a href=1>One</a><li><a href=2>Two</a></ul><p>After.</p>{MENU}", f"T\n{LONG}\nOne\nTwo\nAfter."),
    (f"<main>{MENU}<h1>T</h1><p>{LONG}</p><ul><li><a href=1>One</a></ul></main>", f"T\n{LONG}\nOne"),
    (f"<nav><ul><li><a href=/>Home</a></ul><article><h1>T</h1><p>{LONG}</p></article>", f"T\n{LONG}"),
    (f"<div class=sidebar><ul><li><a href=/>Home</a></li></ul><article><h1>T</h1><p>{LONG}</p></article><footer>F</footer>", f"T\n{LONG}"),
    (f"<nav><a href=/>Home</a><main><h1>T</h1><p>{LONG}</p></main><section class=comments><article><p>{LONG} nice</p></article>", f"T\n{LONG}"),
    (f"<main><h1>T</h1><article><p>{LONG}</p><div><p>Short.</p></div></article></main>", f"T\n{LONG}\nShort."),
    ("<p><a href=1>only</a></p>", "only"), (MENU, ""), ("<div class=''></div>", ""), ("<article></article>", ""),
])
def test_misleading_names(body, want):
    for page in (body, f"<!DOCTYPE html><html><head><title>x</title></head><body class=home>{body}</body></html>"):
        assert htmltext.main_text(page) == want


def test_pages_of_known_blocks():
    """Any order of named parts, menus and adverts around and inside the text gives just the blocks of the text."""
    rng = random.Random(5)
    around = ["<nav><a href=/>Home</a> <a href=/b>About us</a></nav>", MENU, "<div class=ad>Buy this now</div>", "<aside><p>Read more of this elsewhere</p></aside>",
              "<form><label>Mail</label><button>Go</button></form>", "<div id=cookie-notice><p>We use cookies and would like you to agree to all of them</p></div>",
              "<script>var a = '<p>no</p>';</script>", "<style>p{}</style>", "<div role=banner>Site name</div>", "<!-- <p>no</p> -->", "<footer>Imprint &copy;</footer>"]
    for _ in range(300):
        blocks, html = [], []
        for k in range(rng.randint(2, 9)):
            text = " ".join(rng.choice(["alpha", "beta", "gamma,", "delta.", "café", "&"]) for _ in range(rng.choice([2, 12, 40, 80]) if k else 60))
            blocks.append(text)
            raw = text.replace("&", "&amp;").replace("é", "&eacute;").replace(" beta ", "\n  <b>beta</b>\t")
            html.append(rng.choice(["<p>{}</p>", "<p>{}", "<h2>{}</h2>", "<blockquote>{}</blockquote>", "<ul><li>{}</ul>", "<table><tr><td>{}</table>"]).format(raw))
            if rng.random() < 0.2:
                html.append(rng.choice(around[2:8]))
        box = rng.choice(["<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", "<div id=text>{}</div>", "<div class='content no-sidebar'>{}</div>"])
        comments = f"<section class=comments><article class=comment><p>{LONG}</p></article></section>" if rng.random() < 0.5 else ""
        page = "<body>" + "".join(rng.sample(around, 4)) + box.format("".join(html)) + comments + "".join(rng.sample(around, 3)) + "</body>"
        assert htmltext.main_text(page) == "\n".join(blocks), page
