"""Labelled training pages, laid out by rule around given words.

There are no labelled pages to learn from, so pages are built whose blocks are known: the
article, and around or inside it menus, headers, footers, sidebars, notices, adverts, forms and
reader comments, under many of the names that such parts go by.
"""

from __future__ import annotations

import numpy as np

#: A block's first character says what it is; the parser's text keeps it, training strips it.
ARTICLE, OTHER = "", ""

#: Names that parts of pages go by, as class or id.
NAMES = {
    "menu": "nav navbar menu navigation topnav main-menu site-nav breadcrumb breadcrumbs pagination tabs toc links".split(),
    "header": "header masthead site-header top banner branding logo page-header topbar".split(),
    "footer": "footer site-footer bottom page-footer colophon legal credits footer-links copyright".split(),
    "sidebar": "sidebar aside side rail widget widgets related recommended popular trending more-stories right-column".split(),
    "notice": "notice cookie cookies cookie-banner consent gdpr alert popup modal overlay toast subscribe newsletter paywall announcement message warning".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion banner-ad adsbox commercial google-ad partner".split(),
    "form": "form search search-form login signup contact-form subscribe-form feedback register".split(),
    "comments": "comments comment comment-list replies reply discussion responses reader-comments user-comments thread disqus".split(),
    "share": "share social sharing social-links meta byline tags post-meta author-box".split(),
    "article": "article content post entry main story body post-body entry-content article-body main-content text single story-body page-content".split(),
}
PLAIN = "container wrapper row col inner box block wrap section page layout grid item".split()
TYPICAL = {
    "menu": "home about contact news archive products services help login blog shop".split(),
    "header": "welcome official site home your daily".split(),
    "footer": "copyright all rights reserved privacy policy terms imprint contact sitemap".split(),
    "sidebar": "related popular recent posts more read also recommended archive".split(),
    "notice": "we use cookies accept by continuing you agree consent subscribe newsletter".split(),
    "advert": "buy now offer sale sponsored advertisement save free order today".split(),
    "form": "name email password search submit send subscribe message".split(),
    "comments": "says reply comment posted great thanks agree ago report".split(),
    "share": "share tweet by published updated tags author".split(),
}


class Layout:
    def __init__(self, words: list[str], seed: int):
        self.words = words or ["word"]
        self.rng = np.random.default_rng(seed)

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def pick(self, options):
        return options[int(self.rng.integers(len(options)))]

    def text(self, mark: str, low: int, high: int, kind: str | None = None) -> str:
        n = int(self.rng.integers(low, high + 1))
        words = [self.words[int(i)] for i in self.rng.integers(len(self.words), size=n)]
        if self.chance(0.5):
            words[-1] = words[-1].rstrip(".,;:!?|") + self.pick(".?!:") if words[-1] else "end."
        if kind and self.chance(0.4):
            words[:min(n, 3)] = [self.pick(TYPICAL[kind]) for _ in range(min(n, 3))]
        return mark + " ".join(words)

    def names(self, kind: str, p: float = 0.85) -> str:
        if not self.chance(p):
            return f' class="{self.pick(PLAIN)}"' if self.chance(0.3) else ""
        name = self.pick(NAMES[kind])
        if self.chance(0.3):
            name += " " + self.pick(PLAIN)
        return f' {self.pick(["class", "class", "id"])}="{name}"'

    def wrap(self, kind: str, tags: list[str], body: str) -> str:
        tag = self.pick(tags)
        telling = tag not in ("div", "section", "ul", "span")
        return f"<{tag}{self.names(kind, 0.4 if telling else 1.0)}>{body}</{tag}>"

    def items(self, kind: str, low: int, high: int, words: int, linked: float = 0.9) -> str:
        rows = []
        for _ in range(int(self.rng.integers(low, high + 1))):
            text = self.text(OTHER, 1, words, kind)
            rows.append(f'<li><a href="#">{text}</a></li>' if self.chance(linked) else f"<li>{text}</li>")
        return f"<ul>{''.join(rows)}</ul>"

    def paragraph(self, mark: str, kind: str | None = None, low: int = 3, high: int = 60) -> str:
        text = self.text(mark, low, high, kind)
        if self.chance(0.15):
            return f"<p>{text[0]}<b>{text[1:]}</b></p>"
        if self.chance(0.1):
            return f"<p>{text[0]}<b>{text[1:]}<br>"
        if self.chance(0.1):
            return f"<p>{text} <a href='#'>{self.pick(self.words)}</a> {self.pick(self.words)}</p>"
        return f"<p>{text}</p>"

    def other(self, kind: str) -> str:
        if kind == "menu":
            return self.wrap("menu", ["nav", "nav", "div", "ul"], self.items("menu", 2, 9, 2))
        if kind == "header":
            body = f"<{self.pick(['h1', 'div', 'p', 'h2'])}>{self.text(OTHER, 1, 5, 'header')}"
            return self.wrap("header", ["header", "header", "div"], body + (self.items("menu", 2, 6, 2) if self.chance(0.4) else ""))
        if kind == "footer":
            body = self.text(OTHER, 2, 20, "footer") if self.chance(0.5) else self.paragraph(OTHER, "footer", 2, 20)
            return self.wrap("footer", ["footer", "footer", "div"], body + (self.items("footer", 2, 6, 2) if self.chance(0.3) else ""))
        if kind == "sidebar":
            body = f"<h3>{self.text(OTHER, 1, 4, 'sidebar')}</h3>" if self.chance(0.6) else ""
            body += self.items("sidebar", 2, 6, 8) if self.chance(0.6) else self.paragraph(OTHER, "sidebar", 3, 30)
            return self.wrap("sidebar", ["aside", "aside", "div"], body)
        if kind in ("notice", "advert"):
            body = self.text(OTHER, 2, 30, kind) if self.chance(0.6) else "".join(self.paragraph(OTHER, kind, 2, 30) for _ in range(int(self.rng.integers(1, 3))))
            return self.wrap(kind, ["div", "div", "section", "aside"], body)
        if kind == "form":
            fields = "".join(f"<label>{self.text(OTHER, 1, 3, 'form')}</label><input name=x>" for _ in range(int(self.rng.integers(1, 5))))
            return f"<form{self.names('form', 0.5)}>{self.paragraph(OTHER, 'form', 1, 12) if self.chance(0.5) else ''}{fields}<button>Send</button></form>"
        if kind == "share":
            return self.wrap("share", ["div", "ul"], self.items("share", 2, 4, 2) if self.chance(0.5) else self.text(OTHER, 2, 6, "share"))
        rows = []
        for _ in range(int(self.rng.integers(1, 6))):
            body = (f"<h4>{self.text(OTHER, 1, 3, 'comments')}</h4>" if self.chance(0.5) else "") + self.paragraph(OTHER, "comments", 2, 50)
            rows.append(f"<{'li' if self.chance(0.3) else 'div'}{self.names('comments', 0.7)}>{body}")
        head = f"<h3>{self.text(OTHER, 1, 3, 'comments')}</h3>" if self.chance(0.6) else ""
        return self.wrap("comments", ["section", "div", "div"], head + "".join(r + ("</div>" if r.startswith("<div") else "</li>") for r in rows))

    def article(self) -> str:
        parts = [f"<h1>{self.text(ARTICLE, 2, 12)}</h1>"] if self.chance(0.8) else []
        for _ in range(int(self.rng.integers(1, 12))):
            dice = self.rng.random()
            if dice < 0.72:
                parts.append(self.paragraph(ARTICLE, None, 1, 4 if self.chance(0.25) else 60))
            elif dice < 0.80:
                parts.append(f"<{self.pick(['h2', 'h3'])}>{self.text(ARTICLE, 1, 8)}")
            elif dice < 0.86:
                parts.append("<ul>" + "".join(f"<li>{self.text(ARTICLE, 2, 25)}</li>" for _ in range(int(self.rng.integers(2, 5)))) + "</ul>")
            elif dice < 0.90:
                parts.append(f"<blockquote>{self.text(ARTICLE, 4, 40)}</blockquote>")
            elif dice < 0.93:
                parts.append(f"<table><tr><td>{self.text(ARTICLE, 1, 6)}</td><td>{self.text(ARTICLE, 1, 6)}</td></tr></table>")
            elif dice < 0.95:
                parts.append(f"<figure><img src=x><figcaption>{self.text(ARTICLE, 2, 12)}</figcaption></figure>")
            else:
                parts.append(self.other(self.pick(["advert", "notice", "share", "sidebar", "form"])))
        body = "".join(parts)
        dice = self.rng.random()
        if dice < 0.6:
            return f"<article{self.names('article', 0.3)}>{body}</article>"
        if dice < 0.75:
            return f"<main{self.names('article', 0.3)}>{body}</main>"
        return f'<div class="{self.pick(NAMES["article"])}">{body}</div>'

    def page(self) -> str:
        before = [k for k, p in (("notice", 0.3), ("header", 0.5), ("menu", 0.8), ("form", 0.2), ("advert", 0.5), ("sidebar", 0.2)) if self.chance(p)]
        after = [k for k, p in (("share", 0.2), ("comments", 0.45), ("advert", 0.3), ("sidebar", 0.4), ("form", 0.2), ("notice", 0.2)) if self.chance(p)]
        self.rng.shuffle(before)
        self.rng.shuffle(after)
        head = "<!DOCTYPE html><html><head><meta charset=utf-8><title>t</title><style>p{}</style><script>var a='</p>';</script></head><body>"
        body = "".join(map(self.other, before)) + self.article() + "".join(map(self.other, after)) + (self.other("footer") if self.chance(0.85) else "")
        if self.chance(0.3):
            body = f'<div class="{self.pick(PLAIN)}">{body}</div>'
        return head + body + ("</body></html>" if self.chance(0.8) else "")
