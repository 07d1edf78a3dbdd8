"""Visible text of markup, one block a line."""

from __future__ import annotations

import re
from html import unescape

from tessera.functions.markup import BLOCK, Node, build_tree, hidden


def render(html: str) -> str:
    """All visible text: blocks on lines of their own, paragraphs apart, list marks, table cells aligned."""
    lines: list[str] = [""]

    def fresh(blank: bool = False) -> None:
        if lines[-1].strip():
            lines.append("")
        if blank and len(lines) > 1 and lines[-2].strip():
            lines.insert(-1, "")

    def table(node: Node) -> None:
        rows: list[list[str]] = []
        todo = list(reversed(node.children))
        while todo:
            x = todo.pop()
            if isinstance(x, str) or hidden(x):
                continue
            if x.tag == "tr":
                cells = [re.sub(r"\s+", " ", render_nodes([c])).strip() for c in x.children if isinstance(c, Node) and c.tag in ("td", "th") and not hidden(c)]
                if any(cells):
                    rows.append(cells)
            elif x.tag in ("tbody", "thead", "tfoot"):
                todo.extend(reversed(x.children))
            elif x.tag == "caption":
                fresh()
                lines[-1] = re.sub(r"\s+", " ", render_nodes([x])).strip()
        widths = [max((len(r[i]) for r in rows if i < len(r)), default=0) for i in range(max(map(len, rows), default=0))]
        for r in rows:
            fresh()
            lines[-1] = "  ".join(c.ljust(w) for c, w in zip(r, widths)).rstrip()
        fresh()

    # an explicit stack: pages may nest thousands of elements
    todo: list = [(c, False) for c in reversed(build_tree(html).children)]
    lists: list[list] = []
    while todo:
        x, leaving = todo.pop()
        if leaving:
            if x.tag in ("ul", "ol", "menu") and lists:
                lists.pop()
            fresh(x.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "section", "article"))
            continue
        if isinstance(x, str):
            shown = re.sub(r"\s+", " ", unescape(x))
            lines[-1] += shown.lstrip() if not lines[-1].strip() and not lines[-1] else shown
            continue
        if hidden(x):
            continue
        if x.tag == "br":
            lines.append("")
        elif x.tag == "table":
            fresh(True)
            table(x)
        elif x.tag in BLOCK:
            fresh(x.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6"))
            if x.tag in ("ul", "ol", "menu"):
                lists.append([x.tag, 0])
            elif x.tag == "li":
                mark = "- "
                if lists and lists[-1][0] == "ol":
                    lists[-1][1] += 1
                    mark = f"{lists[-1][1]}. "
                lines[-1] = "  " * max(0, len(lists) - 1) + mark
            todo.append((x, True))
            todo.extend((c, False) for c in reversed(x.children))
        else:
            todo.extend((c, False) for c in reversed(x.children))
    return "\n".join(s.rstrip() for s in lines).strip("\n")


def render_nodes(nodes: list) -> str:
    """Visible text of a few nodes on one line."""
    out, todo = [], list(reversed(nodes))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(unescape(x))
        elif not hidden(x):
            out.append(" " if x.tag in BLOCK or x.tag == "br" else "")
            todo.extend(reversed(x.children))
    return "".join(out)
