"""A small tree of the block elements of an HTML page, and numeric features of its nodes."""
from __future__ import annotations

import html
import re
from bisect import bisect_right

import numpy as np

# Element names of the HTML standard.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
RAW = {"script", "style", "textarea", "title", "template", "noscript", "iframe", "svg", "select", "object", "video", "audio", "canvas"}
#: Those of them whose text ends only at their end tag, or at the page's end.
RAW_TEXT = {"script", "style", "textarea", "title"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label",
          "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
            "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
              "option": {"option"}}
TAG_GROUPS = [{"p"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"li", "ul", "ol", "dl", "dt", "dd"}, {"div", "section"}, {"article", "main"},
              {"nav", "menu"}, {"header"}, {"footer"}, {"aside"}, {"form", "fieldset", "button"}, {"blockquote", "pre", "figure", "figcaption"},
              {"table", "tbody", "thead", "tr", "td", "th"}]
# Common words of class, id and role attributes.
ATTRIBUTE_GROUPS = [
    "article content entry story main text post body prose",
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs topbar",
    "ad ads adv advert advertisement banner sponsor sponsored promo promoted promotion doubleclick adsense outbrain taboola",
    "footer foot copyright colophon legal bottom",
    "header head masthead logo site branding top",
    "sidebar side aside widget rail related recommended recommendations more popular trending",
    "comment comments reply replies discussion respond disqus responses reader",
    "cookie cookies consent gdpr notice notification alert popup modal overlay banner message",
    "form login signup subscribe newsletter search register input button contact",
    "share social tags tag meta byline author date follow",
]
_GROUP_OF: dict[str, list[int]] = {}
for _g, _words in enumerate(ATTRIBUTE_GROUPS):
    for _w in _words.split():
        _GROUP_OF.setdefault(_w, []).append(_g)

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|[^<]+|<""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|data-kept)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_ATTRIBUTE_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_PUNCTUATION = re.compile(r"[.,;:!?]")

N_ATTRIBUTES = len(ATTRIBUTE_GROUPS)


class Page:
    """Nodes in page order, parents first, and the runs of text with the node that they stand in."""

    def __init__(self, source: str):
        self.tags, self.parents, self.depths, self.attributes, self.marks = ["#page"], [-1], [0], [()], [""]
        self.inline = [0]
        self.runs: list[tuple[int, str]] = []
        self.links: list[int] = []
        stack: list[tuple[str, int]] = [("#page", 0)]  # open elements; inline ones have their block's node
        parts: list[str] = []
        linked: list[int] = [0]
        in_link = 0
        # Where in the stack each name is open, and each block; and names whose end tag does not come any more.
        open_at: dict[str, list[int]] = {}
        blocks: list[int] = [0]
        endless: set[str] = set()

        def push(name: str, node: int) -> None:
            open_at.setdefault(name, []).append(len(stack))
            if name not in INLINE:
                blocks.append(len(stack))
            stack.append((name, node))

        def flush() -> None:
            if parts:
                text = " ".join(html.unescape("".join(parts)).split())
                if text:
                    self.runs.append((stack[-1][1], text))
                    self.links.append(min(linked[0], len(text)))
                parts.clear()
                linked[0] = 0

        def pop(n: int) -> None:
            nonlocal in_link
            if any(name not in INLINE for name, _ in stack[n:]):
                flush()
            in_link -= sum(name == "a" for name, _ in stack[n:])
            while len(stack) > n:
                name, _ = stack.pop()
                open_at[name].pop()
                if name not in INLINE:
                    blocks.pop()

        def last(names: set[str]) -> int:
            """Where the innermost open element of these names is, or 0."""
            return max((open_at[x][-1] for x in names if open_at.get(x)), default=0)

        at, size = 0, len(source)
        while at < size:
            found = _TOKEN.match(source, at)
            at = found.end()
            name = found[2] or found[5]
            if name is None:
                piece = found[0]
                if piece[0] != "<" or piece == "<":
                    parts.append(piece)
                    if in_link:
                        linked[0] += len(piece.strip())
                continue
            name, closing = name.lower(), found[1] or found[4]
            attributes = found[3] or found[6] or ""
            if closing:
                where = last({name})
                if not where or name in INLINE and blocks[-1] > where:
                    continue
                pop(where)
            elif name in VOID:
                if name in ("br", "hr", "img"):
                    parts.append(" ")
            elif name in RAW:
                parts.append(" ")
                if not attributes.endswith("/") and name not in endless:
                    close = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(source, at)
                    if close:
                        at = close.start()
                    elif name in RAW_TEXT:
                        at = size
                    else:  # never closed: what follows is not its content alone
                        endless.add(name)
            elif name in INLINE:
                self.inline[stack[-1][1]] += 1
                if not attributes.endswith("/"):
                    push(name, stack[-1][1])
                    in_link += name == "a"
            else:
                flush()
                if name in CLOSES_P:
                    where = last(CLOSES_P | {"td", "th", "li", "body"})
                    if where and stack[where][0] == "p":
                        pop(where)
                if name in SAME_LEVEL:
                    stop = last({"ul", "ol", "dl", "table", "select"})
                    above = [places[bisect_right(places, stop)] for x in SAME_LEVEL[name]
                             if (places := open_at.get(x)) and places[-1] > stop]
                    if above:
                        pop(min(above))
                flush()
                groups, mark = [], ""
                for attribute in _ATTRIBUTE.finditer(attributes):
                    value = attribute[2] or attribute[3] or attribute[4] or ""
                    if attribute[1].lower() == "data-kept":
                        mark = value
                    else:
                        groups += [g for w in _ATTRIBUTE_WORD.findall(value) for g in _GROUP_OF.get(w.lower(), ())]
                self.tags.append(name)
                self.parents.append(stack[-1][1])
                self.depths.append(self.depths[stack[-1][1]] + 1)
                self.attributes.append(tuple(set(groups)))
                self.marks.append(mark)
                self.inline.append(0)
                if not attributes.endswith("/"):
                    push(name, len(self.tags) - 1)
        flush()

    def features(self) -> np.ndarray:
        """One row per node: its own text, its subtree, its place, its siblings, its names and its ancestors' names."""
        n = len(self.tags)
        own = np.zeros((n, 5))  # characters, linked characters, words, punctuation, runs
        for (node, text), linked in zip(self.runs, self.links):
            own[node] += (len(text), linked, text.count(" ") + 1, len(_PUNCTUATION.findall(text)), 1)
        parents = self.parents
        below = np.concatenate((own, np.ones((n, 1)), np.array(self.inline)[:, None]), axis=1)
        names = np.zeros((n, len(TAG_GROUPS) + N_ATTRIBUTES))
        for i, (tag, groups) in enumerate(zip(self.tags, self.attributes)):
            for g, group in enumerate(TAG_GROUPS):
                names[i, g] = tag in group
            for g in groups:
                names[i, len(TAG_GROUPS) + g] = 1
        above = np.zeros_like(names)
        first = np.zeros(n)
        before = 0.0
        for i in range(n):
            first[i] = before
            before += own[i, 0]
            if i:
                above[i] = np.maximum(above[parents[i]], names[parents[i]])
        for i in range(n - 1, 0, -1):
            below[parents[i]] += below[i]
        children = np.bincount(parents[1:], minlength=n) if n > 1 else np.zeros(n)
        rank, same = np.zeros(n), {}
        for i in range(1, n):
            key = (parents[i], self.tags[i])
            rank[i] = same[key] = same.get(key, -1) + 1
        twins = np.array([same.get((p, t), 0) + 1 for p, t in zip(parents, self.tags)])
        total = max(1.0, below[0, 0])
        parent = np.maximum(parents, 0)
        numbers = np.stack([
            np.log1p(own[:, 0]), own[:, 1] / np.maximum(1, own[:, 0]), np.log1p(own[:, 2]), own[:, 3] / np.maximum(1, own[:, 2]),
            np.log1p(below[:, 0]), below[:, 1] / np.maximum(1, below[:, 0]), below[:, 0] / (below[:, 5] + below[:, 6]),
            below[:, 3] / np.maximum(1, below[:, 2]), below[:, 0] / total, first / total,
            np.array(self.depths, dtype=float), children, rank, twins, below[parent, 0] / total,
            below[parent, 1] / np.maximum(1, below[parent, 0]), below[:, 0] / np.maximum(1, below[parent, 0]),
        ], axis=1)
        return np.concatenate((numbers, names, above), axis=1)
