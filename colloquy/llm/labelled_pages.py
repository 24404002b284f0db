"""Labelled pages for training: common page layouts with content and boilerplate marked.

Pages are built from layouts and filler by a fixed rule. data-content="1" marks main text and "0"
boilerplate; a mark holds for everything below it until another mark.
"""

from __future__ import annotations

_WORDS = (
    "river stone market winter letter garden window music paper bridge morning village silver harbour "
    "answer question engine forest teacher summer kitchen mountain history island captain doctor"
).split()


def _sentences(seed: int, count: int) -> str:
    out, x = [], seed * 7919 + 13
    for _ in range(count):
        x = (x * 1103515245 + 12345) % (1 << 31)
        size = 6 + (x >> 8) % 12
        words = []
        for k in range(size):
            x = (x * 1103515245 + 12345) % (1 << 31)
            words.append(_WORDS[(x >> 10) % len(_WORDS)] + ("," if k % 5 == 4 and k < size - 1 else ""))
        out.append(" ".join(words).capitalize() + ".")
    return " ".join(out)


def _links(seed: int, count: int, item: str = "li") -> str:
    return "".join(f'<{item}><a href="/x{i}">{_WORDS[(seed + 3 * i) % len(_WORDS)]}</a></{item}>' for i in range(count))


def _body(seed: int, size: int) -> str:
    """Main text of `size` blocks: headings, paragraphs of all lengths, lists, quotes, tables, figures."""
    parts = [f"<h1>{_sentences(seed, 1)}</h1>"]
    for i in range(size):
        kind = (seed + i) % 9
        text = _sentences(seed * 31 + i, 1 + (seed + 5 * i) % 5)
        if kind == 1:
            parts.append(f"<h2>{_sentences(seed + i, 1)[:40]}</h2><p>{text}</p>")
        elif kind == 2:
            parts.append(f'<p>{text} Then <a href="/u">{_WORDS[i % 20]}</a>, <a href="/v">{_WORDS[(i + 7) % 20]} {_WORDS[i % 9]}</a>.</p>')
        elif kind == 4:
            parts.append(
                f'<ul><li>{_sentences(i, 1)}</li><li><a href="/z">{_WORDS[i % 20]} {_WORDS[(i + 3) % 20]}</a></li>'
                f'<li><a href="/w">{_WORDS[(i + 5) % 20]}</a>, {text}</li></ul>'
            )
        elif kind == 0 and seed % 2:
            parts.append(f'<p><a href="/s">{_sentences(i, 1)}</a></p>')
        elif kind == 3:
            parts.append(f"<ul><li>{text}</li><li>{_sentences(i, 1)}</li></ul>")
        elif kind == 5:
            parts.append(f"<blockquote><p>{text}</p></blockquote>")
        elif kind == 6:
            parts.append(f'<p><b>{text}</b> See <a href="/y">{_WORDS[i % 20]} {_WORDS[(i + 4) % 20]}</a> and <em>more</em>.<br>{text}</p>')
        elif kind == 7 and seed % 2:
            parts.append(f"<table><tr><th>{_WORDS[i % 20]}</th><td>{text}</td></tr></table><pre><code>{_WORDS[1]} = {i}</code></pre>")
        elif kind == 8 and seed % 2:
            parts.append(f'<figure><img src="i.png"><figcaption>{_sentences(i, 1)}</figcaption></figure><ol><li>{text}</li></ol>')
        else:
            parts.append(f"<p>{text}</p>")
    return "".join(parts)


#: Boilerplate by (opening tag with its marks, what is inside): `{l}` links, `{t}` text, `{f}` form.
_BEFORE = [
    ("nav", "", "<ul>{l}</ul>"), ("div", 'class="nav menu"', "<ul>{l}</ul>"), ("header", 'class="site-header"', '<h1>{w}</h1><p>{s}</p><nav><ul>{l}</ul></nav>'),
    ("div", 'id="header"', '<a href="/">{w}</a><ul>{l}</ul>'), ("div", 'class="ad"', "{t}"), ("div", 'class="advert banner sponsored"', "<p>{t}</p>"),
    ("div", 'class="cookie-notice consent"', "<p>{t}</p><button>OK</button>"), ("div", 'role="alert" class="notice"', "{t}"),
    ("div", 'class="breadcrumb"', "{l}"), ("form", 'class="search"', '<label>{w}</label><input name="q"><button>Go</button>'),
    ("div", 'role="banner" class="topbar"', "<p>{s}</p>"), ("ul", 'id="menu" class="navigation"', "{l}"), ("aside", 'class="promo"', "<p>{t}</p>"),
]
_AFTER = [
    ("footer", "", "&copy; {w} &middot; {t}"), ("div", 'id="footer" class="footer copyright"', "<p>{t}</p><ul>{l}</ul>"),
    ("aside", 'class="sidebar"', "<h3>{w}</h3><ul>{l}</ul><p>{t}</p>"), ("div", 'class="sidebar widget"', "<h2>{w}</h2><p>{t}</p>"),
    ("section", 'class="comments" id="comments"', "<h2>{w}</h2><div class=\"comment\"><p>{t}</p></div><article class=\"comment\"><p>{t}</p><p>{s}</p></article>"),
    ("div", 'id="disqus" class="comment-list reader-comments"', "<ol><li class=\"comment\"><b>{w}</b><p>{t}</p></li><li><p>{t}</p></li></ol>"),
    ("div", 'class="related recommended"', "<h3>{w}</h3><ul>{l}</ul>"), ("form", 'class="newsletter subscribe"', "<p>{t}</p><input><button>{w}</button>"),
    ("div", 'class="share social"', "{l}"), ("div", 'class="newsletter signup"', "<p>{t}</p>"), ("div", 'class="popup modal overlay"', "<p>{t}</p>"),
    ("div", 'class="ads"', "{t}"), ("div", 'class="pager pagination"', "{l}"), ("div", 'role="contentinfo" class="legal disclaimer"', "<p>{t}</p>"),
    ("aside", "", "<p>{t}</p>"), ("div", 'class="tags meta"', "{l}"), ("section", 'class="promo ad"', "<p>{t}</p>"),
]
_HOLDERS = [
    ("article", ""), ("article", 'class="post"'), ("main", ""), ("div", 'class="content"'), ("div", 'id="main" role="main"'), ("div", 'class="entry-content article-body"'),
    ("section", 'class="story text"'), ("div", 'class="post-body"'), ("article", 'itemprop="articleBody"'), ("div", 'id="article"'),
    ("div", ""), ("td", 'class="content"'),
]


def _piece(kind: tuple[str, str, str], seed: int) -> str:
    tag, marks, inside = kind
    filled = (
        inside.replace("{l}", _links(seed, 3 + seed % 6)).replace("{t}", _sentences(seed + 91, 1 + seed % 3))
        .replace("{s}", _sentences(seed + 17, 1)).replace("{w}", _WORDS[seed % len(_WORDS)].capitalize())
    )
    return f'<{tag} {marks} data-content="0">{filled}</{tag}>'


#: What authors name elements in other languages; the first is main text, the others are not.
_FOREIGN = [
    ("inhalt artikel beitrag haupttext", "kopfzeile navigation fusszeile seitenleiste werbung kommentare impressum"),
    ("contenu texte corps billet", "entete barre pied publicite commentaires liens"),
    ("contenido texto cuerpo articulo", "cabecera barra pie publicidad comentarios enlaces"),
    ("contenuto testo articolo corpo", "intestazione barra piede pubblicita commenti"),
    ("статья текст запись", "шапка меню подвал реклама комментарии"),
]
#: Headings of what is no main text, without any mark on the element.
_ASIDES = ["Comments", "Leave a reply", "Related articles", "Newsletter", "Share this", "Most read", "Kommentare", "Commentaires", "Comentarios"]
#: Words that mark boilerplate elsewhere, in names of parts of main text.
_MISLEADING = ["notice-boards", "menu-planning", "header-files", "footer-notes", "share-holders", "ad-hoc", "banner-history", "comment-culture"]


def _bare(seed: int, place: int) -> str:
    """Boilerplate that only its tags, links and words tell."""
    w, links = _WORDS[seed % len(_WORDS)].capitalize(), _links(seed, 4 + seed % 5, "span")
    before = [f"<div>{links}</div>", f"<ul>{_links(seed, 4 + seed % 4)}</ul>", f"<p>{links}</p>", f"<div><a href='/'>{w}</a></div><div><ul>{_links(seed, 5)}</ul></div>",
              f"<table><tr><td>{links}</td></tr></table>"]
    after = [f"<p>&copy; 20{10 + seed % 15} {w}. All rights reserved.</p>", f"<div><small>Copyright {w} | <a href='/i'>Imprint</a> | <a href='/p'>Privacy</a></small></div>",
             f"<address>{w} {seed % 90}, <a href='/m'>Contact</a></address>", f"<div>{links}</div>", f"<hr><font size=1>&copy; {w}</font>",
             f"<div><h3>{_ASIDES[seed % len(_ASIDES)]}</h3><ul>{_links(seed, 4)}</ul></div>"]
    kinds = after if place else before
    marked = kinds[seed % len(kinds)]
    cut = 3 if marked.startswith("<hr") else 0
    end = marked.index(">", cut + (1 if cut else 0)) if not cut else marked.index(">", 4)
    return marked[:end] + ' data-content="0"' + marked[end:]


def _hashed(seed: int) -> str:
    return "".join(chr(97 + (seed * 7919 >> k) % 26) for k in range(6)) + "-" + "".join(chr(97 + (seed * 104729 >> k) % 26) for k in range(5))


def _strip(inner: str) -> str:
    """Main text without a first heading, for layouts that have none."""
    return inner[inner.find("</h1>") + 5:]


def layout_families(each: int = 40) -> dict[str, list[str]]:
    """Pages of layouts that class names and article elements do not tell, by family."""
    pages: dict[str, list[str]] = {}

    def add(family: str, body: str, content: int = 0) -> None:
        pages.setdefault(family, []).append(f'<html><head><title>t</title></head><body data-content="{content}">{body}</body></html>')

    for n in range(each):
        inner, other = _body(n + 500, 2 + (5 * n) % 11), _body(n + 900, 2 + (3 * n) % 7)
        top, end = _bare(n, 0) if n % 4 else "", _bare(n + 3, 1) if n % 3 else ""
        plain = _strip(inner) if n % 2 else inner
        # Nested elements without any name.
        depth = n % 4
        add("bare", top + (f'<div data-content="1">{"<div>" * depth}{plain}{"</div>" * depth}</div>' if n % 5 else plain) + end, 0 if n % 5 else 1)
        # Several sections, all of them main text, and sometimes one that is not.
        aside = f'<section data-content="0"><h2>{_ASIDES[n % len(_ASIDES)]}</h2><p>{_sentences(n, 2)}</p><p>{_sentences(n + 1, 1)}</p></section>'
        parts = "".join(f'<section data-content="1"><h2>{_sentences(n + k, 1)[:30]}</h2>{_strip(_body(n + 40 * k, 2 + k))}</section>' for k in range(1 + n % 4))
        add("sections", (top if n % 2 else f'<header data-content="0"><p>{_sentences(n, 1)[:30]}</p>{_links(n, 4, "span")}</header>') + parts + (aside if n % 2 else "") + end)
        # Pages of long ago.
        text = "<br><br>".join(_sentences(n * 13 + k, 2 + k % 3) for k in range(2 + n % 5))
        add("old", top + f'<center data-content="1"><font face="Arial" size="2">{f"<b>{_WORDS[n % 20]}</b><p>" if n % 2 else ""}{text if n % 3 else plain}</font></center>' + end)
        side = _links(n, 6, "p") if n % 2 else "<br>".join(f'<a href="/c{k}">{_WORDS[(n + k) % 20].capitalize()}</a>' for k in range(2 + n % 6))
        add("old", f'<table width="100%"><tr><td width="150" data-content="0">{side}</td><td data-content="1">{"<font>" + text + "</font>" if n % 2 else plain}</td></tr></table>' + end)
        # Names that no lexicon holds: hashed ones, and those of other languages.
        add("hashed", f'<div class="{_hashed(n)}" data-content="0"><ul>{_links(n, 5)}</ul></div><div class="{_hashed(n + 50)}"><div class="{_hashed(n + 99)}" data-content="1">{plain}</div></div>'
            f'<div class="{_hashed(n + 150)}" data-content="0"><p>&copy; {_WORDS[n % 20]}</p>{_links(n, 3, "span")}</div>')
        mine, others = (x.split() for x in _FOREIGN[n % len(_FOREIGN)])
        add("foreign", f'<div id="{others[0]}" data-content="0"><p>{_sentences(n, 1)}</p>{_links(n, 4, "span")}</div><div class="{mine[n % len(mine)]}" data-content="1">{plain}</div>'
            f'<div class="{others[n % len(others)]}" data-content="0"><p>{_sentences(n + 5, 1 + n % 2)}</p></div>')
        # Forms: one around the whole page, and small ones within main text.
        small = f'<form data-content="0"><label>{_WORDS[n % 20]}</label><select><option>a</option></select><input><button>Send</button></form>'
        cut = plain.find("</p>") + 4
        held = plain[:cut] + small + plain[cut:]
        tag = ["article", "div", "main"][n % 3]
        add("forms", f'<form id="f" action="/a">{top}<div><{tag} data-content="1">{plain}</{tag}></div><input type="hidden">{end}</form>' if n % 2
            else f'{top}<{tag} data-content="1">{held}</{tag}>{end}')
        # Parts of an article whose names mislead.
        name = _MISLEADING[n % len(_MISLEADING)]
        add("misleading", f'<article data-content="1">{plain}<div class="section {name}"><p>{_sentences(n + 7, 3)}</p></div>{_strip(other)}</article>'
            f'<div class="{name.split("-")[0]}" data-content="0"><p>{_sentences(n + 2, 1)}</p></div>')
    return pages


def labelled_pages(count: int = 240, families: bool = True) -> list[str]:
    """`count` pages, and those of `layout_families`; each boilerplate kind stands before, within or after main text in turn."""
    pages = []
    for n in range(count):
        tag, marks = _HOLDERS[n % len(_HOLDERS)]
        inner = _body(n, 1 + (7 * n) % 12)
        if n % 3 == 1:
            inner += _piece(_AFTER[(n // 3) % len(_AFTER)], n)
        if n % 5 == 2:
            cut = inner.find("</p>") + 4
            inner = inner[:cut] + _piece(_BEFORE[(n // 5) % len(_BEFORE)], n + 1) + inner[cut:]
        if tag == "article" and n % 4 == 1:
            inner = f"<header>{inner[:inner.find('</h1>') + 5]}</header>{inner[inner.find('</h1>') + 5:]}"
        main = f'<{tag} {marks} data-content="1">{inner}</{tag}>'
        if n % 7 == 3:
            main = f'<div class="wrapper container"><div class="row">{main}{_piece(_AFTER[(n * 5) % len(_AFTER)], n)}</div></div>'
        if tag == "td":
            main = f'<table><tr><td class="left" data-content="0"><ul>{_links(n, 5)}</ul></td>{main}</tr></table>'
        before = "".join(_piece(_BEFORE[(n + 5 * k) % len(_BEFORE)], n + k) for k in range(1 + n % 3))
        after = "".join(_piece(_AFTER[(n + 7 * k) % len(_AFTER)], n + k) for k in range(1 + n % 4))
        pages.append(
            f"<html><head><title>{_WORDS[n % 20]}</title><style>p{{}}</style><script>var x;</script></head>"
            # Now and then the text stands in the body itself.
            + (f'<body data-content="1">{before}{inner}{after}</body></html>' if n % 13 == 6 else f'<body data-content="0">{before}{main}{after}</body></html>')
        )
    if families:
        pages += [page for family in layout_families().values() for page in family]
    return pages
