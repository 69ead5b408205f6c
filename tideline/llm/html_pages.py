"""Labelled pages to learn from, built of page layouts of many kinds; no page of an input is among them.

The text of each article block starts with a private-use mark.
"""

from __future__ import annotations

import random

#: The character, for private use, that starts the text of each article block in labelled pages.
MARK = "\ue000"
#: Names of other parts of pages that articles about these things have in their classes, too.
TOPICS = "comment comments cookie social share privacy menu search newsletter sponsor banner form footer header related subscribe login contact".split()


def made_pages(n: int, seed: int = 5) -> list[str]:
    """Labelled pages: a private-use mark starts the text of each article block."""
    rng = random.Random(seed)
    syllables = "an ber ca do el fi gra hu is jo ka lem mo ni ou pra qui ré sta tion un ver wa xi yo zu ß é ing ed".split()
    pick, chance = rng.choice, lambda p: rng.random() < p

    def word():
        return "".join(pick(syllables) for _ in range(rng.randint(1, 4)))

    def phrase(a, b):
        return " ".join(word() for _ in range(rng.randint(a, b))).capitalize()

    def prose():
        out = []
        for _ in range(pick([1, 1, 1, 2, 3, 5])):
            s = phrase(1, 25)
            if chance(0.06):
                s += " " + pick(TOPICS) + " " + phrase(0, 4).lower()
            if chance(0.4):
                s = s.replace(" ", ", ", 1)
            if chance(0.15):
                s = s.replace(" ", f' <a href="/{word()}">{word()}</a> ', 1)
            if chance(0.05):
                s = s.replace(" ", pick([f" <button>{word()}</button> ", f" <label>{word()}</label> ", f" <math><mi>{word()}</mi></math> "]), 1)
            if chance(0.15):
                s = f"<{(t := pick(['b', 'em', 'i', 'span', 'strong', 'code']))}>{s}</{t}>"
            out.append(s + pick(["."] * 8 + ["!", "?", ":", "", "$$$", "&amp;"]))
        return " ".join(out)

    def attr(*names):
        if chance(0.15):
            return ""
        name = pick(names)
        form = pick(["{}", "{}", "{}-%s" % word(), "%s-{}" % word(), "{} %s" % word(), "{}-%d" % rng.randint(1, 9), "site-{}", "{}-box", "{}-wrap", "{}-container", "js-{}"])
        return f' {pick(["class", "class", "id"])}="{form.format(name)}"'

    def links(k):
        items = [f'<a href="/{word()}">{phrase(1, 3)}</a>' for _ in range(k)]
        return pick([lambda: "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", lambda: "<ul>" + "<li>".join(["", *items]) + "</ul>", lambda: " ".join(items), lambda: "".join(f"<p>{x}</p>" for x in items)])()

    def ad():
        return pick([
            lambda: f'<div{attr("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "banner", "promo", "adsbygoogle", "dfp")}>{pick([prose, lambda: links(2), lambda: "Advertisement " + phrase(2, 8)])()}</div>'
        ])()

    def notice():
        text = pick([f"We use cookies {phrase(2, 8)}.", f"{phrase(3, 12)} privacy {phrase(1, 4)}.", prose()])
        return f'<{(t := pick(["div", "section", "aside"]))}{attr("cookie", "consent", "notice", "gdpr", "banner", "alert", "popup", "modal", "overlay", "toast")}><p>{text}</p>{pick(["", "<button>OK</button>"])}</{t}>'

    def form():
        inner = pick([f"<label>{phrase(1, 2)}</label><input name=x>", f"<p>Subscribe {phrase(1, 6)}</p><input>", f"<p>{phrase(2, 8)}.</p><form><input name=e><button>{word()}</button></form>", f"<label>Email</label><input><button>{phrase(1, 2)}</button>", f"<select><option>{word()}<option>{word()}</select>", f"<p>{prose()}</p><textarea>{word()}</textarea>"])
        return f'<form{attr("search", "newsletter", "subscribe", "login", "signup", "contact", "form")}>{inner}</form>'

    def comments():
        one = lambda: pick(["<li{a}><b>{w}</b><p>{t}</p></li>", "<div{a}><p>{t}</p></div>", "<p>{t}</p>", "<article{a}><p>{t}</p></article>", "<div{a}>{w}: {t}</div>"]).format(a=attr("comment", "reply", "response"), w=word(), t=prose())
        head = pick(["", "<h2>Comments</h2>", f"<h3>{phrase(1, 3)}</h3>", f"<h3>{rng.randint(1, 99)} {pick(['comments', 'replies', 'thoughts', word()])} {phrase(0, 6).lower()}</h3>"])
        name = attr("comments", "comment", "disqus", "responses", "replies", "discussion", "respond", "feedback") or ' class="comments"'
        return f'<{(t := pick(["section", "div", "ol", "ul", "aside"]))}{name}>{head}{"".join(one() for _ in range(rng.randint(1, 6)))}{form() if chance(0.3) else ""}</{t}>'

    def aside():
        t, name = pick([("aside", ""), ("aside", attr("sidebar", "widget", "related")), ("div", attr("sidebar", "widget", "related", "rail", "recommended", "trending", "popular", "more") or ' id="sidebar"')])
        return f'<{t}{name}>{pick(["", f"<h3>{phrase(1, 4)}</h3>"])}{pick([lambda: links(rng.randint(1, 6)), lambda: f"<p>{prose()}</p>", lambda: "".join(f"<p>{prose()}</p>" for _ in range(3))])()}</{t}>'

    def nav():
        t, name = pick([("nav", ""), ("nav", attr("nav", "menu", "navbar", "breadcrumb")), ("div", attr("nav", "menu", "navbar", "navigation", "breadcrumbs", "toolbar", "topbar", "pagination", "toc") or ' class="menu"'), ("ul", attr("menu", "nav", "links", "tags") or ' id="nav"'), ("menu", "")])
        return f"<{t}{name}>{links(rng.randint(2, 8))}</{t}>"

    def share():
        return f'<div{attr("share", "social", "sharing", "follow") or " class=share"}>{links(3)}</div>'

    def header():
        t, name = pick([("header", ""), ("header", attr("header", "masthead")), ("div", attr("header", "masthead", "logo", "branding") or ' id="header"')])
        return f'<{t}{name}>{pick([f"<h1>{phrase(1, 3)}</h1>", f"<div>{phrase(1, 4)}</div>", f"<p>{prose()}</p>", ""])}{nav() if chance(0.5) else ""}{form() if chance(0.2) else ""}</{t}>'

    def footer():
        t, name = pick([("footer", ""), ("footer", attr("footer", "colophon")), ("div", attr("footer", "bottom", "copyright", "legal") or ' id="footer"')])
        return f'<{t}{name}>{pick([f"&copy; {word()}.example &middot; {prose()}", f"<p>{prose()}</p>", links(4), f"<p>Copyright {phrase(1, 4)}. All rights reserved.</p>"])}</{t}>'

    def junk():
        return pick([ad, ad, notice, form, aside, share, nav, comments])()

    def main():
        mark, parts = MARK, []
        if chance(0.8):
            topic = f" {pick(TOPICS)} {word()}" if chance(0.15) else ""
            h = f"<h1{attr('title', 'headline', 'entry') if chance(0.3) else ''}>{mark}{phrase(1, 12)}{topic}{pick(['', '.', '&amp;'])}</h1>"
            parts.append(f"<header>{h}</header>" if chance(0.1) else h)
        for _ in range(pick([0, 1, 1, 2, 3, 5, 8, 12])):
            kind = rng.random()
            if kind < 0.75:
                parts.append(f"<p>{mark}{prose()}" + pick(["</p>", "</p>", "</p>", "<br>", ""]))
            elif kind < 0.82:
                parts.append(f"<h{(k := rng.randint(2, 4))}>{mark}{phrase(1, 6)}</h{k}>")
            elif kind < 0.88:
                # also lists of linked titles, which are the article where nothing around them says otherwise
                t, item = pick(["ul", "ul", "ol"]), pick([prose, prose, prose, lambda: f'<a href="/{word()}">{phrase(1, 8)}</a>', lambda: f'<a href="/{word()}">{phrase(1, 6)}</a> {phrase(0, 6).lower()}'])
                parts.append(f"<{t}>" + "".join(f"<li>{mark}{item()}</li>" for _ in range(rng.randint(1, 6))) + f"</{t}>")
            elif kind < 0.92:
                parts.append(f"<blockquote>{mark}{prose()}</blockquote>")
            elif kind < 0.95:
                parts.append("<table>" + "".join(f"<tr><td>{mark}{phrase(1, 3)}</td><td>{mark}{phrase(1, 5)}</td></tr>" for _ in range(2)) + "</table>")
            elif kind < 0.97:
                parts.append(f"<figure><img src=x><figcaption>{mark}{prose()}</figcaption></figure>")
            else:
                parts.append(f"<div>{mark}{prose()}</div>")
            if chance(0.25):
                parts.append(junk())
        if chance(0.15):
            parts.append(comments())
        inner = "".join(parts)
        t, name = pick([("article", ""), ("article", ""), ("article", attr("post", "article", "entry", "story")), ("main", ""), ("div", attr("content", "article", "post", "entry", "story", "main", "text", "body")), ("section", attr("content", "article", "story")), ("div", "")])
        if t in ("article", "main") and chance(0.3):
            name = f' class="{pick(TOPICS)}-{word()}"'
        out = f"<{t}{name}>{inner}</{t}>"
        if chance(0.2):
            out = f'<{(o := pick(["main", "div", "section"]))}{attr("main", "content", "page", "container", "layout")}>{out}{aside() if chance(0.3) else ""}</{o}>'
        return out

    pages = []
    for _ in range(n):
        before = [f() for f, p in ((notice, 0.2), (header, 0.4), (nav, 0.6), (ad, 0.4), (form, 0.1), (aside, 0.15)) if chance(p)]
        after = [f() for f, p in ((share, 0.15), (ad, 0.2), (comments, 0.3), (aside, 0.3), (nav, 0.15), (form, 0.15), (notice, 0.1), (footer, 0.7)) if chance(p)]
        rng.shuffle(before)
        body = "".join([*before, main(), *after])
        page = f"<!DOCTYPE html><html><head><title>{phrase(1, 8)}</title><style>p{{}}</style></head><body>{body}</body></html>"
        if chance(0.1):
            page = f"<html><body{attr('home', 'page', 'single')}><div{attr('wrapper', 'page', 'container')}>{body}</div>"
        pages.append(page)
    return pages
