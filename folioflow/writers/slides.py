"""Slides from one document: LaTeX frames, or nested HTML sections."""

from __future__ import annotations

from typing import Any

from folioflow.sources.ast import Node, node
from folioflow.writers import text


def level(blocks: list[Node]) -> int:
    """The shallowest heading that something else than a heading follows; 6 if none."""
    found = [b["c"][0] for b, nxt in zip(blocks, blocks[1:], strict=False) if b["t"] == "Header" and nxt["t"] != "Header"]
    return min(found, default=6)


def segment(blocks: list[Node], at: int) -> list[tuple[str, Node | None, list[Node]]]:
    """('section' | 'frame', heading, blocks): a shallower heading stands alone, a rule ends a frame and goes."""
    out: list[tuple[str, Node | None, list[Node]]] = []
    open_ = False
    for b in blocks:
        if b["t"] == "Header" and b["c"][0] < at:
            out.append(("section", b, []))
            open_ = False
        elif b["t"] == "Header" and b["c"][0] == at:
            out.append(("frame", b, []))
            open_ = True
        elif b["t"] == "HorizontalRule":
            open_ = False
        else:
            if not open_:
                out.append(("frame", None, []))
                open_ = True
            out[-1][2].append(b)
    return out


def beamer(doc: dict[str, Any]) -> str:
    w = text.Latex()
    at = level(doc["blocks"])
    out = []
    for kind, head, body in segment(doc["blocks"], at):
        if kind == "section":
            out.append(w.block(node("Header", [max(1, head["c"][0]), *head["c"][1:]]), 72))
            continue
        title = f"{{{w.para(head['c'][2], 72)}}}" if head else ""
        fragile = "[fragile]" if any(b["t"] == "CodeBlock" for b in body) else ""
        out.append(f"\\begin{{frame}}{fragile}{title}\n{w.blocks(body, 72)}\n\\end{{frame}}")
    return "\n\n".join(out)


def revealjs(doc: dict[str, Any]) -> str:
    w = text.Html()
    at = level(doc["blocks"])
    out, nested = [], False
    for kind, head, body in segment(doc["blocks"], at):
        inner = "\n".join(x for x in ([w.block(head, 72)] if head else []) + [w.blocks(body, 72)] if x)
        if kind == "section":
            if nested:
                out.append("</section>")
            out.append(f'<section>\n<section class="title-slide slide level{head["c"][0]}">\n{inner}\n</section>')
            nested = True
        else:
            out.append(f'<section class="slide level{at}">\n{inner}\n</section>')
    return "\n".join([*out, *(["</section>"] if nested else []), *([w.note_section()] if w.notes else [])])
