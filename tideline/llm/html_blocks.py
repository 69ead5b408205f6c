"""Leaf blocks of web pages: the runs of text between tags that break a line, with the elements around them.

Tags are read by the states of the HTML standard, so a quote inside an unquoted value is part of it, and in one pass:
no position is scanned more than a few times, whatever the page. Two things differ from the standard, to keep text: a
``<`` outside a quoted value ends the tag before it, and if such a tag, or one that the page's end cuts off, has only
bare words (``a <b and c``) or isn't an element's, it is text; and an unclosed quote without another one up to the
page's end doesn't count as one.

What counts as text is what a reader of the page gets: formulas are text within their line (but not their annotations,
which say the same in another notation), as are labels and the words of buttons; drawings (``svg``, ``canvas``) aren't,
nor is what stands in for media, frames and scripts where these fail (``object``, ``audio``, ``video``, ``iframe``,
``noscript``), as it repeats or replaces what is shown. A button's characters count as linked ones.
"""

from __future__ import annotations

import html as htmllib
import re

#: Tags that break a line, tags whose content isn't text, tags without content, and those within lines.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary "
    "table tbody td tfoot th thead tr ul textarea".split()
)
RAW = frozenset("script style noscript template svg annotation annotation-xml iframe object canvas audio video textarea title head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big button cite code data del dfn em font i ins kbd label mark math mfrac mi mn mo mrow msub msup msqrt mtext q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Of RAW, those that hide all that follows if they aren't closed.
HIDING = frozenset("script style iframe textarea title".split())
#: Elements that say what part of a page they are.
SECTIONS = frozenset("article aside body footer form header main menu nav section".split())
#: Tags that an open paragraph ends at, and elements that keep it open from without.
ENDS_P = BLOCKS - {"body", "html", "select", "option", "optgroup", "textarea"}
KEEPS_P = ("table", "td", "th")
#: An opening tag ends the nearest open one of these, if none of the second set is between.
SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
NAMED = BLOCKS | RAW | VOID | INLINE
#: Elements and places that a memo holds.
MEMO = 20_000
_W = r"\t\n\f\r "
_value = rf"[{_W}]*+=[{_W}]*+(?:\"([^\"]*+)\"|'([^']*+)'|"
_tag = re.compile(rf"<(/?+)([a-zA-Z][^{_W}/><]*+)((?:[{_W}/]*+[^{_W}/>=<]++(?:{_value}([^{_W}\"'><][^{_W}><]*+)))?+)*+[{_W}/]*+)>")
_attribute = re.compile(rf"[{_W}/]*+(=?[^{_W}/>=<]*+)(?:{_value}([^{_W}\"'><][^{_W}><]*+|)))?+")
_name = re.compile(rf"</?([a-zA-Z][^{_W}/><]*+)")
_comment_end = re.compile(r"--!?>")
_ends = {t: re.compile(rf"</{t}(?=[{_W}/>])", re.IGNORECASE | re.ASCII) for t in RAW} | {"body": re.compile(rf"<body(?=[{_W}/>])", re.IGNORECASE | re.ASCII)}
_words = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_hidden = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_long_reference = re.compile(r"&#(?:0*+[0-9]{8,}|[xX]0*+[0-9a-fA-F]{8,});?")


def unescaped(text: str) -> str:
    """text with its character references decoded; numbers beyond Unicode are replacement characters."""
    return htmllib.unescape(_long_reference.sub("�", text)) if "&" in text else text


def marks_of(attributes: str) -> list[str]:
    """Words of class, id and role, and whether the element is hidden, in order."""
    out = set()
    for m in _attribute.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role", "aria-label", "itemprop"):
            out.update(w.lower() for w in _words.findall(value))
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _hidden.search(value):
            out.add("hidden!")
    return sorted(out)


class Outline:
    """The open block elements of a page. With weights, score is the sum of those of the features of a block there;
    it is kept for each level, so an element costs what it adds, however deep it is."""

    def __init__(self, weights: dict[str, float] | None = None, memo: dict | None = None):
        self.weight = (lambda f: weights.get(f, 0.0)) if weights is not None else lambda f: 0.0
        #: What elements and places add, by tag and attributes; may be kept for all pages under the same weights.
        self.memo = {} if memo is None else memo
        self.tags: list[str] = []
        self.at: dict[str, list[int]] = {}
        self.own: list[list[tuple[str, float]]] = []
        self.open: dict[str, int] = {}
        self.levels = [(0.0, (), "", False)]
        self.scores = [self._score("")]

    def _score(self, tag: str) -> float:
        total, nearest, section, inside = self.levels[-1]
        key = tag, nearest, section, inside
        found = self.memo.get(key)
        if found is None:
            found = self.memo[key] = sum(map(self.weight, (f"t={tag}", f"s={section}", f"in={inside}", *nearest)))
        return total + found

    @property
    def score(self) -> float:
        return self.scores[-1]

    def features(self) -> list[str]:
        _, nearest, section, inside = self.levels[-1]
        return sorted({f"t={self.tags[-1] if self.tags else ''}", f"s={section}", f"in={inside}", *nearest, *self.open})

    def push(self, tag: str, attributes: str) -> None:
        known = self.memo.get((tag, attributes))
        if known is None:
            marks = marks_of(attributes) if attributes else []
            names = [f"a={tag}", *(f"c={m}" for m in marks), *(f"b={tag}.{m}" for m in marks)]
            known = [(f, self.weight(f)) for f in names], tuple(f"d={m}" for m in marks)
            if len(self.memo) < MEMO:
                self.memo[tag, attributes] = known
        own, marked = known
        total, nearest, section, inside = self.levels[-1]
        open_ = self.open
        for f, w in own:
            n = open_.get(f, 0)
            if not n:
                total += w
            open_[f] = n + 1
        self.levels.append((total, marked or nearest, tag if tag in SECTIONS else section, inside or tag in ("article", "main")))
        self.at.setdefault(tag, []).append(len(self.tags))
        self.tags.append(tag)
        self.own.append(own)
        self.scores.append(self._score(tag))

    def last(self, *tags: str) -> int:
        """The level of the innermost open element of some tags, -1 without one."""
        found = -1
        for t in tags:
            levels = self.at.get(t)
            if levels and levels[-1] > found:
                found = levels[-1]
        return found

    def close(self, level: int) -> None:
        """Close the elements from a level on."""
        while len(self.tags) > level:
            self.at[self.tags.pop()].pop()
            for f, _ in self.own.pop():
                if self.open[f] == 1:
                    del self.open[f]
                else:
                    self.open[f] -= 1
            self.levels.pop()
            self.scores.pop()


def _broken(page: str, begin: int) -> tuple[int, str, str, bool]:
    """Of a tag that isn't well-formed: its end, name and attributes, and whether it is text."""
    m = _name.match(page, begin)
    first = at = m.end()
    words = values = False
    while (a := _attribute.match(page, at)).end() > at:
        at = a.end()
        if a.lastindex and a.lastindex > 1:
            values = True
        elif a[1]:
            words = True
    if page.startswith(">", at):
        return at + 1, m[1], page[first:at], False
    return at, m[1], page[first:at], not values and (words or m[1].lower() not in NAMED)


def leaf_blocks(page: str, weights: dict[str, float] | None = None, memo: dict | None = None) -> list[tuple]:
    """What is known of the place (the outline's features or, with weights, its score), text and linked characters of
    each leaf block. A memo speeds up further pages under the same weights."""
    out: list[tuple] = []
    if memo is not None and len(memo) > 2 * MEMO:
        memo.clear()
    outline = Outline(weights, memo)
    parts: list[str] = []
    ends: dict[str, int] = {}
    linked = in_link = begin = at = 0
    n = len(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescaped("".join(parts)).split())
            if text:
                out.append((outline.features() if weights is None else outline.score, text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def close(level: int) -> None:
        flush()
        outline.close(level)

    def end_of(what: str, here: int) -> int:
        if ends.get(what, -1) < here:
            m = _ends[what].search(page, here)
            ends[what] = m.start() if m else n
        return ends[what]

    while True:
        lt = page.find("<", at)
        m = _tag.match(page, lt) if lt >= 0 else None
        closing = tag = attributes = ""
        if lt < 0:
            lt = at = n
        elif m:
            closing, tag, attributes, at = m[1], m[2], m[3], m.end()
        elif _name.match(page, lt):
            at, tag, attributes, plain = _broken(page, lt)
            if plain:
                if at < n:
                    continue
                lt = n
            closing = page.startswith("/", lt + 1)
        elif page.startswith("<!--", lt):
            end = _comment_end.search(page, lt + 2)
            at = end.end() if end else n
        elif page.startswith(("<!", "<?", "</"), lt) and lt + 2 < n:
            end = page.find(">", lt)
            at = end + 1 if end >= 0 else n
        else:
            at = lt + 1
            continue
        if lt > begin:
            text = page[begin:lt]
            parts.append(text)
            if in_link:
                linked += len(text.strip())
        begin = at
        if lt == n:
            break
        tag = tag.lower()
        if not tag:
            continue
        if closing:
            if tag in ("a", "button"):
                in_link = 0
            elif tag in BLOCKS:
                level = outline.last(tag)
                if level >= 0:
                    close(level)
                else:
                    flush()
            continue
        if tag in RAW:
            # a head ends at its body at the latest
            end = min(end_of(tag, at), end_of("body", at)) if tag == "head" else end_of(tag, at)
            if end < n or tag in HIDING:
                begin = at = end
            if tag == "textarea":
                flush()
            continue
        if tag in ("a", "button"):
            in_link = 1
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCKS:
            flush()
            if tag in ENDS_P and outline.at.get("p") and outline.last("p") > outline.last(*KEEPS_P):
                close(outline.last("p"))
            if tag in SIBLINGS:
                ended, stops = SIBLINGS[tag]
                if outline.last(*ended) > outline.last(*stops):
                    close(outline.last(*ended))
            if tag not in VOID and not attributes.endswith("/"):
                outline.push(tag, attributes)
    flush()
    return out
