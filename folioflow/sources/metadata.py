"""Metadata files: a subset of YAML (mappings, lists, quoted and block scalars), or JSON; texts are inline Markdown."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Any

from folioflow.sources.ast import Node, node

KEY = re.compile(r"(\"(?:[^\"\\]|\\.)*\"|'[^']*'|[^\s:#\[\]{},&*!|>'\"%@`-][^:#]*?|-[^\s:][^:#]*?)\s*:(?:\s+(.*)|$)")


def scalar(s: str) -> Any:
    """A plain or quoted scalar, or a flow list or mapping."""
    s = re.sub(r"^(\"(?:[^\"\\]|\\.)*\"|'[^']*')\s+#.*$", r"\1", s.strip())
    if s[:1] == '"' and s[-1:] == '"' and len(s) > 1:
        return json.loads(s)
    if s[:1] == "'" and s[-1:] == "'" and len(s) > 1:
        return s[1:-1].replace("''", "'")
    if s[:1] == "[" and s[-1:] == "]":
        return [scalar(x) for x in split(s[1:-1])]
    if s[:1] == "{" and s[-1:] == "}":
        pairs = [x.partition(":") for x in split(s[1:-1])]
        return {str(scalar(k)): scalar(v) for k, _, v in pairs}
    s = re.sub(r"\s+#.*$", "", s)
    if s in ("true", "True", "TRUE"):
        return True
    if s in ("false", "False", "FALSE"):
        return False
    if s in ("", "~", "null"):
        return None
    return s


def split(s: str) -> list[str]:
    out, depth, quote, cur = [], 0, "", ""
    for c in s:
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
        elif c == "," and not depth:
            out.append(cur)
            cur = ""
            continue
        cur += c
    return [x for x in [*out, cur] if x.strip()]


def parse_yaml(text: str) -> Any:
    """A block of YAML as dicts, lists and texts; what it cannot be raises ValueError."""
    lines = [x.rstrip() for x in text.expandtabs(8).split("\n")]
    pos = 0
    depth = lambda x: len(x) - len(x.lstrip(" "))

    def skip() -> None:
        nonlocal pos
        while pos < len(lines) and (not lines[pos].strip() or lines[pos].lstrip().startswith("#")):
            pos += 1

    def block_scalar(head: str, indent: int) -> str:
        nonlocal pos
        body = []
        while pos < len(lines) and (not lines[pos].strip() or depth(lines[pos]) > indent):
            body.append(lines[pos])
            pos += 1
        n = min((depth(x) for x in body if x.strip()), default=0)
        rows = [x[n:] for x in body]
        while rows and not rows[-1]:
            rows.pop()
        out = "\n".join(rows) if head[0] == "|" else re.sub(r"(?<!\n)\n(?!\n)", " ", "\n".join(rows)).replace("\n\n", "\n")
        return out if "-" in head else out + "\n"

    def rest(value: str, indent: int) -> Any:
        nonlocal pos
        if re.fullmatch(r"[|>][+-]?\d?", value):
            return block_scalar(value, indent)
        if value:
            while pos < len(lines) and lines[pos].strip() and depth(lines[pos]) > indent and not KEY.match(lines[pos].strip()) and not lines[pos].lstrip().startswith("- "):
                value += " " + lines[pos].strip()
                pos += 1
            return scalar(value)
        skip()
        if pos < len(lines) and (depth(lines[pos]) > indent or (depth(lines[pos]) == indent and lines[pos].lstrip().startswith("- "))):
            return block(depth(lines[pos]))
        return None

    def block(indent: int) -> Any:
        nonlocal pos
        skip()
        out: Any = None
        while pos < len(lines):
            skip()
            if pos >= len(lines) or depth(lines[pos]) < indent:
                break
            line = lines[pos]
            if depth(line) > indent:
                raise ValueError(f"unexpected indentation in line {pos + 1}")
            body = line.strip()
            if body == "-" or body.startswith("- "):
                if isinstance(out, dict):
                    break
                out = out if out is not None else []
                item = body[2:].strip()
                inner = indent + len(body) - len(body[1:].lstrip())
                if item and KEY.match(item) and item[0] not in "[{\"'":
                    lines[pos] = " " * inner + item
                    out.append(block(inner))
                else:
                    pos += 1
                    out.append(rest(item, indent))
                continue
            m = KEY.match(body)
            if not m or isinstance(out, list):
                if out is None:
                    pos += 1
                    return rest(body, indent)
                raise ValueError(f"no key in line {pos + 1}")
            out = out if out is not None else {}
            pos += 1
            out[str(scalar(m[1]))] = rest((m[2] or "").strip(), indent)
        return out

    skip()
    return block(depth(lines[pos])) if pos < len(lines) else {}


def to_meta(v: Any, inlines: Callable[[str], list[Node]]) -> Node:
    if isinstance(v, bool):
        return node("MetaBool", v)
    if isinstance(v, dict):
        return node("MetaMap", {k: to_meta(x, inlines) for k, x in sorted(v.items())})
    if isinstance(v, list):
        return node("MetaList", [to_meta(x, inlines) for x in v])
    s = "" if v is None else str(v)
    if "\n" in s.strip("\n"):
        return node("MetaBlocks", [node("Para", inlines(p)) for p in re.split(r"\n\s*\n", s.strip("\n"))])
    return node("MetaInlines", inlines(s.strip("\n")))


def read(text: str, inlines: Callable[[str], list[Node]]) -> dict[str, Node]:
    """The metadata of a YAML or JSON mapping; anything else raises ValueError."""
    data = json.loads(text) if text.lstrip().startswith("{") else parse_yaml(text)
    if not isinstance(data, dict):
        raise ValueError("metadata is no mapping")
    return {k: to_meta(v, inlines) for k, v in sorted(data.items())}
