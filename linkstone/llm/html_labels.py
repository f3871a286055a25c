"""Labelled pages that the extraction weights are fitted on.

Own layouts of counted filler words, put together from blocks: what a reader would call the page's
main text lies between marks ``<!--+-->`` and ``<!--- -->`` (any number of them in a page), all else
is not.  Blocks differ in elements, class names and length, and every class name stands on blocks
of several kinds, so that no name decides by itself.
"""

from __future__ import annotations

import random

#: Class names of what surrounds a main text, by kind.
_AROUND = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination toolbar topbar sitemap".split(),
    "head": "header banner masthead".split(),
    "foot": "footer copyright legal disclaimer".split(),
    "side": "sidebar related recommended widget widgets promo teaser".split(),
    "advert": "ad ads advert adverts advertisement sponsor sponsored".split(),
    "notice": "cookie cookies consent gdpr notice alert popup modal newsletter subscribe".split(),
    "form": "login signup search register".split(),
    "social": "share sharing social follow".split(),
    "readers": "comment comments commentlist reply replies respond discussion".split(),
}
#: Class names of what holds a main text.
_HOLDING = "content article post entry story text body main-content article-body post-content entry-content page-content blog-post single richtext prose".split()
_INLINE = ("<b>{w}</b>", "<i>{w}</i>", "<a href=x>{w}</a>", "<span>{w}</span>", "<label>{w}</label>", "<code>{w}</code>", "<em class=term>{w}</em>")


class _Page:
    def __init__(self, seed: int):
        self.pick = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        return " ".join(f"word{self.pick.randrange(99)}" for _ in range(self.pick.randint(low, high)))

    def sentence(self, low: int, high: int) -> str:
        return self.words(low, high) + self.pick.choice(("." * 8 + "!?")) if self.pick.random() < 0.9 else self.words(low, high)

    def running(self) -> str:
        """A paragraph's text, at times with markup inside."""
        parts = [self.sentence(6, 30) for _ in range(self.pick.randint(1, 4))]
        if self.pick.random() < 0.4:
            parts.insert(1, self.pick.choice(_INLINE).format(w=self.words(1, 4)))
        return " ".join(parts)

    def links(self) -> str:
        item = self.pick.choice(("<li><a href=x>{}</a></li>", "<a href=x>{}</a> ", "<a href=x>{}</a> | ", "<div><a href=x>{}</a></div>", "<p><a href=x>{}</a></p>"))
        inner = "".join(item.format(self.words(1, 4)) for _ in range(self.pick.randint(2, 7)))
        return f"<ul>{inner}</ul>" if "<li>" in item else inner

    def around(self, inside: bool = False) -> str:
        """A block that is no main text; ``inside`` one that stands in its midst."""
        kind = self.pick.choice([k for k in _AROUND if not (inside and k in ("head", "foot", "readers"))])
        name = self.pick.choice(_AROUND[kind])
        text = {
            "menu": self.links,
            "head": lambda: f"<h1>{self.words(1, 4)}</h1>" + self.pick.choice(("", f"<p>{self.words(2, 6)}</p>", self.links())),
            "foot": lambda: self.pick.choice((f"<p>{self.words(3, 10)}</p>", self.words(3, 12), f"<p>{self.sentence(8, 30)}</p>" + self.links())),
            "side": lambda: f"<h3>{self.words(1, 4)}</h3>" + self.pick.choice((self.links(), f"<p>{self.sentence(5, 20)}</p>")),
            "advert": lambda: self.pick.choice((self.sentence(3, 14), f"<p>{self.sentence(5, 25)}</p>", f"<a href=x>{self.words(2, 8)}</a>")),
            "notice": lambda: self.pick.choice((f"<p>{self.sentence(6, 30)}</p><button>{self.words(1, 2)}</button>", self.sentence(4, 16))),
            "form": lambda: self.pick.choice((f"<form><label>{self.words(1, 2)}</label><input><button>{self.words(1, 2)}</button></form>", f"<form><p>{self.sentence(3, 20)}</p><input></form>", f"<form>{self.words(1, 5)}</form>")),
            "social": lambda: self.pick.choice((self.links(), f"<span>{self.words(1, 3)}</span>", f"<p>{self.words(1, 4)}</p>")),
            "readers": lambda: "".join(self.pick.choice(("<div class=comment><p>{}</p></div>", "<p>{}</p>", "<div>{}</div>", "<li>{}</li>")).format(self.running()) for _ in range(self.pick.randint(1, 4))),
        }[kind]()
        if not inside and kind in ("menu", "side", "social") and self.pick.random() < 0.3:  # no name at all
            return self.pick.choice(("<div>{}</div>", "{}", "<div><div>{}</div></div>")).format(self.links())
        plain = {"menu": "nav", "head": "header", "foot": "footer", "side": "aside", "notice": "dialog", "form": "form"}
        way = self.pick.random()
        if way < 0.3 and kind in plain:
            return f"<{plain[kind]}>{text}</{plain[kind]}>"
        if way < 0.36:
            role = {"menu": "navigation", "head": "banner", "foot": "contentinfo", "side": "complementary", "notice": "alertdialog", "form": "search"}.get(kind)
            if role:
                return f'<div role="{role}">{text}</div>'
        if way < 0.5:
            name = self.pick.choice((f"{self.pick.choice(_AROUND[kind])}-{name}", f"site-{name}", f"{name}-box", f"{name}-wrapper", f"block {name}", f"{name} x1"))
        if kind == "readers" and way > 0.8:
            return f'<section id="{name}"><h2>{self.words(1, 3)}</h2><article class=comment><p>{self.running()}</p></article></section>'
        element = self.pick.choice(("div", "div", "div", "section", "aside" if kind in ("side", "advert") else "div"))
        return f'<{element} {self.pick.choice(("class", "class", "id"))}="{name}">{text}</{element}>'

    def inside(self) -> str:
        """A block of main text."""
        way = self.pick.random()
        if way < 0.55:
            return f"<p>{self.running()}</p>"
        if way < 0.6:  # a name that is boilerplate elsewhere, on a paragraph or as a part of a longer name
            name = self.pick.choice(self.pick.choice(list(_AROUND.values())))
            return self.pick.choice((f'<p class="{name}">{self.running()}</p>', f'<div class="{name}-guide"><p>{self.running()}</p><p>{self.running()}</p></div>'))
        if way < 0.7:
            return self.pick.choice(("<h2>{}</h2>", "<h3>{}</h3>", "<div>{}</div>")).format(self.words(1, 8))
        if way < 0.78:
            item = lambda: self.pick.choice((self.words(2, 9), self.sentence(4, 15)))
            return "<ul>" + "".join(f"<li>{item()}</li>" for _ in range(self.pick.randint(2, 5))) + "</ul>"
        if way < 0.83:
            return "<table>" + "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 3)}</td></tr>" for _ in range(self.pick.randint(2, 4))) + "</table>"
        if way < 0.88:
            return f"<blockquote>{self.sentence(8, 30)}</blockquote>"
        if way < 0.91:
            return f"<pre>{self.words(5, 20)}</pre>"
        if way < 0.94:
            return f"<figure><img><figcaption>{self.words(3, 10)}</figcaption></figure>"
        if way < 0.97:
            return f"<div>{self.running()}</div>"
        return f"{self.running()}<br>{self.running()}"

    def main(self) -> str:
        blocks = [f"<h1>{self.words(1, 9)}</h1>"] if self.pick.random() < 0.8 else []
        if blocks and self.pick.random() < 0.2:
            blocks = [f"<header>{blocks[0]}<p>{self.words(2, 6)}</p></header>"]
        for _ in range(self.pick.randint(2, 9)):
            blocks.append(self.inside())
            if self.pick.random() < 0.2:
                blocks.append(f"<!--- -->{self.around(True)}<!--+-->")
        if self.pick.random() < 0.1:  # readers answer at the end
            blocks.append(f'<!--- --><div class="{self.pick.choice(_AROUND["readers"])}"><p>{self.running()}</p><p>{self.running()}</p></div><!--+-->')
        return "<!--+-->" + "".join(blocks) + "<!--- -->"

    def page(self) -> str:
        if self.pick.random() < 0.08:  # nothing but a short text
            text = self.pick.choice(("{}", "<p>{}</p>", "<div>{}</div>", "<h1>{}</h1>", "<h1>{}</h1><p>{}</p>", "<article>{}</article>")).replace("{}", self.words(1, 12))
            return f"<!--+-->{text}<!--- -->"
        text, way = self.main(), self.pick.random()
        if way < 0.35:
            text = f"<article>{text}</article>"
        elif way < 0.45:
            text = f"<main>{text}</main>"
        elif way < 0.5:
            text = f"<article>{text}</article><article>{self.main()}</article>"
        elif way < 0.55:
            text = f"<main><article>{text}</article></main>"
        elif way < 0.85:
            text = f'<div {self.pick.choice(("class", "id"))}="{self.pick.choice(_HOLDING)}">{text}</div>'
        elif way < 0.93:
            text = f"<div>{text}</div>"
        before = "".join(self.around() for _ in range(self.pick.randint(0, 4)))
        after = "".join(self.around() for _ in range(self.pick.randint(0, 4)))
        body = before + text + after
        if self.pick.random() < 0.15:
            body = f"<div class=wrapper>{body}</div>"
        return f"<html><head><title>{self.words(2, 6)}</title></head><body>{body}</body></html>"


def labelled_pages(count: int = 1600) -> list[str]:
    return [_Page(k).page() for k in range(count)]
