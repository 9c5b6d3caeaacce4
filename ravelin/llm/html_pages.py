"""Invented web pages with known main text: what the block labeller is trained on.

Pages are lists of (html, is main text) pieces in a random layout: with or
without semantic elements, with class names from the usual vocabulary of page
furniture, with sloppy mark-up.  Words are invented, so that the labeller learns
structure and the few words that furniture really uses.
"""

from __future__ import annotations

import random

#: Class and id words that pages give to each kind of block.
NAMES = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs pagination pager tabs topnav links sitemap skip toc".split(),
    "header": "header masthead banner topbar branding logo site-header hero tagline".split(),
    "footer": "footer copyright colophon legal bottom site-footer credits imprint".split(),
    "side": "sidebar aside widget related recommended popular trending secondary rail more-stories teaser tags share social".split(),
    "notice": "notice cookie consent alert gdpr newsletter subscribe popup modal overlay paywall signup warning message".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo banner-ad adsense commercial".split(),
    "form": "form search login contact signin input subscribe-form field poll".split(),
    "comments": "comments comment reply replies discussion respond disqus responses comment-list feedback thread".split(),
    "main": "content article post entry story main body text page-content post-body entry-content article-body prose single".split(),
    "plain": "wrapper container row col inner outer section block box page grid left right wrap layout".split(),
}
#: Words that furniture uses.
WORDS = {
    "nav": "Home About Contact Products News Archive Next Previous Back Top Sitemap Login".split(),
    "header": "Welcome Site Daily Your Official Portal".split(),
    "footer": "© · Copyright All rights reserved Privacy Terms Imprint".split(),
    "side": "Related Read more Popular Tags Share Follow Latest See also".split(),
    "notice": "We use cookies Accept Subscribe newsletter Please enable JavaScript Notice".split(),
    "ad": "Advertisement Sponsored Buy now Offer Sale Ad".split(),
    "form": "Search Email Password Send Submit Name Sign in Choose".split(),
    "comments": "Reply says Comments Posted by ago Like Report wrote".split(),
}


class Pages:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.syllables = ["".join(self.r.choice("bcdfghklmnprstvwz") * (self.r.random() < 0.8) + self.r.choice("aeiouéäöñ") + self.r.choice(["", "n", "r", "s", "t"]) for _ in range(1)) for _ in range(90)]

    def word(self) -> str:
        return "".join(self.r.choice(self.syllables) for _ in range(self.r.choice([1, 1, 2, 2, 3])))

    def words(self, low: int, high: int, kind: str | None = None) -> str:
        w = [self.r.choice(WORDS[kind]) if kind in WORDS and self.r.random() < 0.3 else self.word() for _ in range(self.r.randint(low, high))]
        if self.r.random() < 0.8:
            w[0] = w[0].capitalize()
        if self.r.random() < 0.12:
            w.insert(self.r.choice([0, len(w)]), str(self.r.randint(1, 2100)))
        return " ".join(w)

    def sentence(self) -> str:
        junk = self.r.choice(["", "", "", "", "", "***", "!!", "&amp;"])
        text = self.words(1, self.r.choice([4, 14, 30]))
        return (text.replace(" ", junk + " ") if junk else text) + self.r.choice(".....!?")

    def para(self, most: int = 8) -> str:
        if self.r.random() < 0.06:  # spun or broken text
            return " ".join((self.word() + " ") * self.r.choice([3, 10, 40]) for _ in range(self.r.randint(1, 5)))
        text = " ".join(self.sentence() for _ in range(self.r.randint(1, self.r.choice([1, 3, most]))))
        if self.r.random() < 0.2:
            a, _, b = text.partition(" ")
            text = f"{a} <{(t := self.r.choice(['a', 'b', 'em', 'span', 'code']))}>{b}</{t}>"
        return text

    def named(self, tag: str, kind: str, chance: float = 0.8) -> str:
        if self.r.random() > chance:
            return f"<{tag}>"
        names = [self.r.choice(NAMES[kind])]
        if self.r.random() < 0.3:
            names.append(self.r.choice(NAMES["plain"]))
        elif kind not in ("main", "plain") and self.r.random() < 0.3:
            names[0] += self.r.choice(["-", "_"]) + self.r.choice(NAMES[self.r.choice(["main", "plain"])])
        return f'<{tag} {self.r.choice(["class", "class", "id"])}="{" ".join(names)}">'

    def furniture(self, kind: str) -> list[tuple[str, int]]:
        r, out = self.r, []
        tag = {"nav": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form"}.get(kind)
        semantic = tag is not None and r.random() < 0.6
        tag = tag if semantic else r.choice(["div", "div", "section", "ul" if kind == "nav" else "div"])
        out.append((self.named(tag, kind, 0.4 if semantic else 1.0), 0))
        if kind in ("nav", "side"):
            if r.random() < 0.4:
                out.append((f"<h3>{self.words(1, 3, kind)}</h3>", 0))
            rows = [f"<li><a href='/{self.word()}'>{self.words(1, r.choice([1, 3, 8]), kind)}</a></li>" for _ in range(r.randint(1, 8))]
            rows = rows if r.random() < 0.7 else [x.replace("<li>", "").replace("</li>", " ") for x in rows]
            out += [("<ul>", 0), *[(x, 0) for x in rows], ("</ul>", 0)]
            if kind == "side" and r.random() < 0.5:
                out.append((f"<p>{self.para(2)}</p>", 0))
        elif kind == "comments":
            if r.random() < 0.8:
                out.append((f"<h{(n := r.choice([2, 3, 3, 4]))}>{self.words(1, 3, kind)}</h{n}>", 0))
            inner, chance = r.choice(["div", "li", "article", "section"]), r.choice([0.0, 0.8])
            for _ in range(r.choice([1, 1, 2, 3, 6])):
                out += [(self.named(inner, kind, chance), 0), (f"<span>{self.words(1, 3, kind)}</span>" if r.random() < 0.6 else "", 0), (f"<p>{self.para(5)}</p>" if r.random() < 0.8 else self.para(5), 0), (f"</{inner}>", 0)]
        elif kind == "form":
            out.append((f"<label>{self.words(1, 3, kind)}</label><input type=text>" + (f"<select><option>{self.word()}<option>{self.word()}</select>" if r.random() < 0.3 else "") + f"<button>{self.words(1, 2, kind)}</button>", 0))
        else:
            inner = self.words(2, r.choice([4, 12, 25]), kind) if kind != "ad" or r.random() < 0.5 else self.para(3)
            if kind in ("footer", "header") and r.random() < 0.5:
                inner = "&copy; " * (kind == "footer") + self.word() + ".example.com &middot; " + self.sentence()
            if kind == "header" and r.random() < 0.4:
                inner = f"<h1>{self.words(1, 3)}</h1>" + inner
            bare = r.random() < 0.5
            out.append((inner if bare else f"<p>{inner}</p>", 0))
        return [*out, (f"</{tag}>", 0)]

    def article(self) -> list[tuple[str, int]]:
        r, out = self.r, []
        semantic = r.random() < 0.65
        tag = r.choice(["article", "article", "article", "main"]) if semantic else r.choice(["div", "div", "section", "td"])
        out.append((self.named(tag, "main", 0.3 if semantic else 0.85), 0))
        if r.random() < 0.85:
            out.append((f"<h{(n := r.choice([1, 1, 1, 2]))}>{self.words(2, 9) if r.random() < 0.7 else self.sentence()}</h{n}>", 1))
        if r.random() < 0.25:
            out.append((f"<p><b>{self.sentence()}<br>", 1))
        for _ in range(r.choice([0, 1, 2, 4, 8, 14])):
            x = r.random()
            if x < 0.68:
                out.append((f"<p>{self.para()}</p>" if r.random() < 0.9 else f"<p>{self.para()}", 1))
            elif x < 0.74:
                out.append((f"<h{(n := r.choice([2, 3]))}>{self.words(1, 6)}</h{n}>", 1))
            elif x < 0.80:
                out += [("<ul>", 0), *[(f"<li>{self.para(1)}</li>", 1) for _ in range(r.randint(2, 4))], ("</ul>", 0)]
            elif x < 0.84:
                out.append((f"<blockquote>{self.para(3)}</blockquote>", 1))
            elif x < 0.88:
                out += [("<table><tr>", 0), *[(f"<td>{self.words(1, 3)}</td>", 1) for _ in range(r.randint(2, 4))], ("</tr></table>", 0)]
            elif x < 0.92:
                out.append((f"<div>{self.para(3)}</div>", 1))
            else:
                out += self.furniture(r.choice(["ad", "side", "notice", "form", "nav"]))
        for kind in ("header", "ad", "notice", "side", "form", "nav", "comments", "footer"):
            if r.random() < 0.06:
                at = len(out) if r.random() < 0.6 or kind in ("comments", "footer") else 1
                out[at:at] = self.furniture(kind)
        return [*out, (f"</{tag}>", 0)]

    def page(self) -> list[tuple[str, int]]:
        """Pieces of html and whether their text is main text."""
        r = self.r
        if r.random() < 0.03:
            return [(self.para(), 1)]
        out: list[tuple[str, int]] = [("<!DOCTYPE html><html><head>", 0), (f"<title>{self.words(2, 9)}</title>", 0), ("<style>p{margin:0}</style><script>var t='</p>';</script></head><body>", 0)]
        for kind in ("notice", "header", "nav", "ad", "form", "side"):
            if r.random() < (0.7 if kind == "nav" else 0.35):
                out += self.furniture(kind)
        if r.random() < 0.4:
            out.append((self.named("div", "plain"), 0))
        out += self.article()
        for kind in ("ad", "comments", "side", "form", "notice", "nav", "footer"):
            if r.random() < (0.75 if kind == "footer" else 0.3):
                out += self.furniture(kind)
        return [*out, ("</body></html>", 0)]
