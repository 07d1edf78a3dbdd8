"""Markup to trees, and the text under their nodes."""

from __future__ import annotations

import re
from html import unescape

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
UNSEEN = frozenset("head script style noscript template svg canvas iframe object math datalist".split())
#: Start tags that end an open element, up to the elements that bound the search.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "option", "title", "body", "html"}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|</?[a-zA-Z][^\s/>]*(?:\"[^\"]*\"|'[^']*'|[^'\">])*>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def build_tree(html: str) -> Node:
    """The element tree; end tags may be missing, wrongly nested or too many."""
    root = Node("html", {})
    stack = [root]
    at = 0

    def text(upto: int) -> None:
        if upto > at:
            stack[-1].children.append(html[at:upto])

    while True:
        m = TOKEN.search(html, at)
        if not m:
            text(len(html))
            return root
        text(m.start())
        tag, at = m.group(), m.end()
        if tag[1] in "!?":
            continue
        if tag[1] == "/":
            name = tag[2:-1].strip().lower()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == name:
                    del stack[i:]
                    break
            continue
        name = re.match(r"<([^\s/>]+)", tag).group(1).lower()
        attrs = {k.lower(): (v or "").strip("\"'") for k, v in ATTRIBUTE.findall(tag[1 + len(name) : -1])}
        ends, bound = IMPLIED.get(name, (set(), set()))
        outermost = 0
        for i in range(len(stack) - 1, 0, -1):
            if not ends or stack[i].tag in bound:
                break
            if stack[i].tag in ends:
                outermost = i
        if outermost:
            del stack[outermost:]
        if name in CLOSES_P and any(n.tag == "p" for n in stack):
            i = max(i for i, n in enumerate(stack) if n.tag == "p")
            if not any(n.tag in ("table", "button", "td") for n in stack[i + 1 :]):
                del stack[i:]
        node = Node(name, attrs)
        stack[-1].children.append(node)
        if name in ("script", "style"):
            end = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            node.children.append(html[at : end.start() if end else len(html)])
            at = end.end() if end else len(html)
        elif name not in VOID and not tag.endswith("/>"):
            stack.append(node)


def hidden(node: Node) -> bool:
    style = re.sub(r"\s", "", node.attrs.get("style", "").lower())
    return node.tag in UNSEEN or "hidden" in node.attrs or node.attrs.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style or (node.tag == "input" and node.attrs.get("type", "").lower() == "hidden")


def text_of(node: Node, without: frozenset[str] = frozenset(), breaks: bool = False) -> str:
    """Visible text under a node, blocks apart by a blank; with ``breaks`` a br is a line end."""
    out, todo = [], list(reversed(node.children))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(unescape(x).replace("\n", " ") if breaks else unescape(x))
        elif not hidden(x) and x.tag not in without:
            if x.tag == "br" and breaks:
                out.append("\n")
            elif x.tag in BLOCK or x.tag == "br":
                out.append(" ")
            todo.extend(reversed(x.children))
    return "".join(out)
