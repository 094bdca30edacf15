"""A small reader of HTML pages: block elements with their place in the tree, and the text blocks in page order."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import xxhash

# Groups: unclosed comment, slash, name, attributes, attributes up to the first ">". Quotes open a value after "=" only.
# Nothing is tried twice, so a tag costs its length.
VALUES = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+"
TAG = r"<(?:!--(?:.*?-->|(.*))|(/?)([a-zA-Z][a-zA-Z0-9:-]*+)(?:(%s)>|([^>]*+)>)|[!?][^>]*+>)"
WHOLE_TAG, BROKEN_TAG = re.compile(TAG % VALUES, re.S), re.compile(TAG % "(?!)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
DEPTH = 512  # elements below are read into the one at this depth

# Element names by their part in a page.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
RAW_END = {name: re.compile(f"</{name}", re.I | re.A) for name in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = set("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol optgroup option p pre search section select summary table tbody td
template tfoot th thead tr ul noscript object svg button audio video canvas""".split())
CLOSE_P = BLOCKS - {"head", "html", "body", "button", "option", "optgroup", "noscript", "object", "svg", "audio", "video", "canvas", "template", "select"}
SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
           "option": {"option"}, "thead": {"tbody", "tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"},
         "option": {"select"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
NOISE = {"head", "nav", "footer", "aside", "form", "button", "select", "noscript", "template", "dialog", "menu", "svg", "object", "audio",
         "video", "canvas", "search", "fieldset"} | RAW
FRAMES = {"nav", "footer", "aside", "dialog", "menu", "search", "fieldset"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
MAIN = {"article", "main"}
PLAIN, HINTED, DECLARED, HARD = 0, 1, 2, 3  # what a node's own tag says: nothing, a word of its class or id, an element or role, hidden
LOW, SLOPE, MOST = 0.15, 0.5, 0.5  # weight of what is hinted by its share of the page's text; from MOST on it is whole
HINT = re.compile(r"(?:^|[-_\s])(?:ads?|adverts?|advertis\w*|banner|cookies?|consent|gdpr|notices?|alert|promos?|promot\w*|sponsor\w*|sidebar|menus?|nav|navbar|"
                  r"navigation|breadcrumbs?|footer|header|masthead|comments?|commentlist|repl(?:y|ies)|respond|disqus|shar(?:e|ing)|social|related|recommend\w*|"
                  r"newsletter|subscri\w*|signup|login|popup|modal|overlay|widget|toolbar|pagination|pager|skip)(?:$|[-_\s])", re.I)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "form", "menu", "menubar"}


@dataclass
class Node:
    name: str
    key: str
    parent: int
    path: int
    kind: int
    main: bool
    children: list[str] = field(default_factory=list)


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(raw)} if raw.strip(" /\n\t") else {}


def _kind(name: str, a: dict[str, str], inside_main: bool) -> int:
    if name in NOISE and name not in FRAMES and name != "form" or "hidden" in a or a.get("aria-hidden") == "true":
        return HARD
    if "display:none" in a.get("style", "").replace(" ", "").lower() and name not in ("html", "body", "main", "article", "header"):
        return HARD
    if name in FRAMES or a.get("role", "").lower() in ROLES - {"form"}:
        return DECLARED
    if name == "form" or a.get("role", "").lower() == "form":
        return HINTED
    if name in ("html", "body", "main"):
        return PLAIN
    if name == "header":
        return PLAIN if inside_main else DECLARED
    hint = f"{a.get('class', '')} {a.get('id', '')}"
    if name == "article":
        return HINTED if re.search(r"(?:^|[-_\s])(?:comments?|repl(?:y|ies)|teaser|related|promo|ad)(?:$|[-_\s])", hint, re.I) else PLAIN
    return HINTED if hint.strip() and HINT.search(hint) else PLAIN


class Page:
    """``nodes`` (the first is the page itself) and ``blocks``: (node, text) in page order, texts decoded and trimmed.

    Reading takes time linear in the page. Where the page ends inside a quoted value, that tag and all after it end at
    their first ">".
    """

    def __init__(self, source: str, salt: str = ""):
        self.nodes = [Node("", "", -1, xxhash.xxh3_64_intdigest(salt.encode()), PLAIN, False)]
        self.blocks: list[tuple[int, str]] = []
        self._text: list[str] = []
        stack, at, below = [0], 0, 0
        tag, last = WHOLE_TAG, source.rfind(">") + 1
        while m := tag.search(source, at, last):
            self._text.append(source[at:m.start()])
            at = m.end() if m[1] is None else len(source)
            if not m[3]:
                continue
            name, raw = m[3].lower(), m[4]
            if raw is None:
                tag, raw = BROKEN_TAG, m[5]
            if m[2]:
                if name in BLOCKS:
                    self._flush(stack[-1])
                    if below:
                        below -= 1
                        continue
                    for i in range(len(stack) - 1, 0, -1):
                        if self.nodes[stack[i]].name == name:
                            del stack[i:]
                            break
                continue
            if name in RAW:
                end = RAW_END[name].search(source, at)
                at = end.start() if end else len(source)
                continue
            if name == "br":
                self._text.append(" ")
            if name in VOID or name not in BLOCKS:
                continue
            self._flush(stack[-1])
            if below:
                below += 1
                continue
            self._implied_ends(stack, name)
            if len(stack) > DEPTH:
                below = 1
                continue
            self._open(stack, name, _attributes(raw))
            if raw.endswith("/") and name == "svg":
                stack.pop()
        self._text.append(source[at:].partition("<!--")[0])
        self._flush(stack[-1])

    def _implied_ends(self, stack: list[int], name: str) -> None:
        if name in CLOSE_P:
            for i in range(len(stack) - 1, 0, -1):
                if self.nodes[stack[i]].name == "p":
                    del stack[i:]
                    break
                if self.nodes[stack[i]].name in ("td", "th", "button", "object", "table", "article", "section", "div"):
                    break
        if name in SIBLING:
            for i in range(len(stack) - 1, 0, -1):
                own = self.nodes[stack[i]].name
                if own in FENCE[name]:
                    break
                if own in SIBLING[name]:
                    del stack[i:]

    def _open(self, stack: list[int], name: str, a: dict[str, str]) -> None:
        up = self.nodes[stack[-1]]
        key = f"{name}.{a.get('class', '')}#{re.sub(r'[0-9]+', '0', a.get('id', ''))}"
        kind = HARD if up.kind == HARD else _kind(name, a, up.main)
        path = xxhash.xxh3_64_intdigest(key.encode("utf-8", "surrogatepass"), seed=up.path)
        if not up.children or up.children[-1] != key:
            up.children.append(key)
        main = kind != HARD and (up.main or (name in MAIN or a.get("role", "").lower() == "main") and kind == PLAIN)
        self.nodes.append(Node(name, key, stack[-1], path, kind, main))
        stack.append(len(self.nodes) - 1)

    def _flush(self, node: int) -> None:
        text = "".join(self._text)
        self._text = []
        if text and not text.isspace():
            text = " ".join(html.unescape(text).split())
            if text:
                self.blocks.append((node, text))

    def lineage(self, node: int) -> list[int]:
        out = []
        while node > 0:
            out.append(node)
            node = self.nodes[node].parent
        return out

    def weights(self) -> list[float]:
        """How far the tags of each node and of those around it let it count: 1 where nothing speaks against it, 0 where it is hidden or framing.

        A hinted container that holds the main element or most of the text (outside frames) is not lowered, others by their share;
        text that stands in the node itself, in no block of it, does not count for the share.
        """
        size, shown, core = [0] * len(self.nodes), [True] * len(self.nodes), [False] * len(self.nodes)
        for i, n in enumerate(self.nodes[1:], 1):
            shown[i] = shown[n.parent] and n.kind not in (DECLARED, HARD)
            core[i] = n.name == "main" and n.kind != HARD
        for node, text in self.blocks:
            size[node] += len(text) * shown[node]
        direct = size[:]
        for i in range(len(self.nodes) - 1, 0, -1):
            up = self.nodes[i].parent
            size[up] += size[i]
            core[up] = core[up] or core[i]
        out = [1.0]
        for i, n in enumerate(self.nodes[1:], 1):
            own = 1.0 if n.kind == PLAIN else 0.0
            if n.kind == HINTED:
                share = (size[i] - direct[i]) / max(1, size[0])
                own = 1.0 if core[i] or share >= MOST else LOW + SLOPE * share
            out.append(out[n.parent] * own)
        return out
