"""Templates: ``$name$``, ``$if()$``, ``$for()$``, partials and pipes; rendered from dicts, or compiled to one Column.

Syntax: ``$a.b$`` or ``${a.b}`` is a variable; ``$a/pipe$`` applies a pipe; ``$if(x)$ .. $elseif(y)$ .. $else$ .. $endif$``;
``$for(x)$ .. $it$ .. $sep$ .. $endfor$``; ``$name()$`` includes a partial; ``$--`` begins a comment; ``$$`` is a dollar sign.
A directive that stands alone on a line takes the line with it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions import text as T

TOKEN = re.compile(r"\$--[^\n]*\n?|\$\$|\$\{\s*([^}]*?)\s*\}|\$([^$\n]+)\$")
ALONE = re.compile(r"(?m)^[ \t]*(\$(?:if|elseif|for)\([^)\n]*\)\$|\$(?:else|endif|endfor|sep)\$|\$\{\s*(?:(?:if|elseif|for)\([^)\n]*\)|else|endif|endfor|sep)\s*\})[ \t]*(?:\n|\Z)")
DEPTH = 64


class TemplateError(ValueError):
    pass


@dataclass
class Node:
    kind: str  # text, var, if, for, partial
    text: str = ""
    path: tuple[str, ...] = ()
    pipes: tuple[tuple[str, tuple[str, ...]], ...] = ()
    arms: list[tuple[Node | None, list[Node]]] = field(default_factory=list)
    body: list[Node] = field(default_factory=list)
    sep: list[Node] = field(default_factory=list)


def _variable(s: str) -> Node:
    head, *pipes = re.split(r"/(?=[a-z])", s.strip())
    if not re.fullmatch(r"[\w-]+(\.[\w-]+)*", head):
        raise TemplateError(f"not a variable: {s!r}")
    made = []
    for p in pipes:
        m = re.fullmatch(r'([a-z]+)((?:\s+(?:\d+|"[^"]*"))*)\s*', p)
        if not m:
            raise TemplateError(f"not a pipe: {p!r}")
        made.append((m[1], tuple(x.strip('"') for x in re.findall(r'\d+|"[^"]*"', m[2]))))
    return Node("var", path=tuple(head.split(".")), pipes=tuple(made))


def _roman(n: int) -> str:
    out = ""
    for v, s in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        out += s * (n // v)
        n %= v
    return out


def stringify(v: Any) -> str:
    if isinstance(v, bool):
        return "true" if v else ""
    if v is None:
        return ""
    if isinstance(v, list):
        return "".join(map(stringify, v))
    return "true" if isinstance(v, dict) else str(v)


def truthy(v: Any) -> bool:
    return v is True or isinstance(v, dict) or (v not in (False, None) and bool(v if isinstance(v, (str, list)) else str(v)))


def _each(f: Callable[[str], str]) -> Callable[[Any], Any]:
    return lambda v: [(_each(f))(x) for x in v] if isinstance(v, list) else v if isinstance(v, (bool, dict)) else f(stringify(v))


def _number(v: Any, f: Callable[[int], str]) -> Any:
    s = stringify(v)
    return f(int(s)) if re.fullmatch(r"\d+", s) else v


def _block(v: Any, align: str, args: tuple[str, ...]) -> str:
    width, left, right = int(args[0]), *(args[1:] + ("", ""))[:2]
    lines = []
    for line in stringify(v).split("\n"):
        gap = max(0, width - len(line))
        a = 0 if align == "left" else gap if align == "right" else gap // 2
        padded = left + " " * a + line + " " * (gap - a) + right
        lines.append(padded if right else padded.rstrip(" "))
    return "\n".join(lines)


PIPES: dict[str, Callable[[Any, tuple[str, ...]], Any]] = {
    "uppercase": lambda v, a: _each(str.upper)(v),
    "lowercase": lambda v, a: _each(lambda s: "".join(c.lower() for c in s))(v),
    "length": lambda v, a: str(0 if isinstance(v, bool) else len(v) if isinstance(v, (list, dict)) else len(stringify(v))),
    "reverse": lambda v, a: v[::-1] if isinstance(v, list) else stringify(v)[::-1],
    "first": lambda v, a: (v[0] if v else "") if isinstance(v, list) else v,
    "last": lambda v, a: (v[-1] if v else "") if isinstance(v, list) else v,
    "rest": lambda v, a: v[1:] if isinstance(v, list) else v,
    "allbutlast": lambda v, a: v[:-1] if isinstance(v, list) else v,
    "pairs": lambda v, a: [{"key": k, "value": v[k]} for k in sorted(v)] if isinstance(v, dict) else [{"key": str(i), "value": x} for i, x in enumerate(v, 1)] if isinstance(v, list) else v,
    "alpha": lambda v, a: _number(v, lambda n: chr(96 + n % 26)),
    "roman": lambda v, a: _number(v, lambda n: _roman(n) if n < 4000 else str(n)),
    "chomp": lambda v, a: _each(lambda s: s.rstrip("\r\n"))(v),
    "nowrap": lambda v, a: v,
    "left": lambda v, a: _block(v, "left", a),
    "right": lambda v, a: _block(v, "right", a),
    "center": lambda v, a: _block(v, "center", a),
}
#: The pipes that have a Column form.
COLUMN_PIPES: dict[str, Callable[[Column], Column]] = {
    "uppercase": F.upper,
    "lowercase": T.lower_chars,
    "length": lambda c: F.length(c).cast("string"),
    "reverse": F.reverse,
    "chomp": lambda c: F.regexp_replace(c, "[\r\n]+$", ""),
    "nowrap": lambda c: c,
    "alpha": lambda c: F.when(c.rlike("^[0-9]+$"), T.alpha_pipe(c.try_cast("long"))).otherwise(c),
    "roman": lambda c: F.when(c.rlike("^[0-9]+$"), T.roman(c.try_cast("long"), zero="empty")).otherwise(c),
}


class Template:
    def __init__(self, nodes: list[Node]):
        self.nodes = nodes

    def render(self, context: dict[str, Any], partials: Callable[[str], str | None] = lambda _: None) -> str:
        return "".join(self._render(self.nodes, [context], partials, 0))

    def _value(self, n: Node, scopes: list[Any]) -> Any:
        v: Any = None
        for scope in reversed(scopes):
            v = scope
            for p in n.path:
                v = v.get(p) if isinstance(v, dict) else None
            if v is not None:
                break
        for name, args in n.pipes:
            if name not in PIPES:
                raise TemplateError(f"no pipe {name!r}")
            v = PIPES[name](v, args)
        return v

    def _render(self, nodes: list[Node], scopes: list[Any], partials, depth: int):
        if depth > DEPTH:
            raise TemplateError("partials nest too deeply")
        for n in nodes:
            if n.kind == "text":
                yield n.text
            elif n.kind == "var":
                yield stringify(self._value(n, scopes))
            elif n.kind == "if":
                for test, body in n.arms:
                    if test is None or truthy(self._value(test, scopes)):
                        yield from self._render(body, scopes, partials, depth)
                        break
            elif n.kind == "for":
                v = self._value(n, scopes)
                items = v if isinstance(v, list) else [v] if truthy(v) else []
                for i, x in enumerate(items):
                    if i:
                        yield from self._render(n.sep, scopes, partials, depth)
                    own: dict[str, Any] = {"it": x}
                    if n.path != ("it",):
                        own[n.path[-1]] = x
                    if isinstance(x, dict):
                        own = {**own, **{k: w for k, w in x.items() if k not in own}}
                    yield from self._render(n.body, [*scopes, own], partials, depth)
            else:
                source = partials(n.text)
                if source is None:
                    raise TemplateError(f"no partial {n.text!r}")
                yield from self._render(parse(source.rstrip("\n")).nodes, scopes, partials, depth + 1)

    def column(self, context: dict[str, Column], partials: Callable[[str], str | None] = lambda _: None) -> Column:
        """The template as an expression over columns: strings, booleans and arrays of strings (for loops)."""
        return self._column(self.nodes, context, partials, 0)

    def _item(self, n: Node, name: str, context: dict[str, Column], partials, depth: int) -> Callable[[Column], Column]:
        return lambda x: self._column(n.body, {**context, "it": x, name: x}, partials, depth)

    def _column(self, nodes: list[Node], context: dict[str, Column], partials, depth: int) -> Column:
        if depth > DEPTH:
            raise TemplateError("partials nest too deeply")
        parts: list[Column] = [F.lit("")]
        for n in nodes:
            get = lambda v: context.get(".".join(v.path))
            if n.kind == "text":
                parts.append(F.lit(n.text))
            elif n.kind == "var":
                c = get(n)
                c = F.lit("") if c is None else F.coalesce(c.cast("string"), F.lit(""))
                for name, _ in n.pipes:
                    c = COLUMN_PIPES[name](c)
                parts.append(c)
            elif n.kind == "if":
                out = F.lit("")
                for test, body in reversed(n.arms):
                    made = self._column(body, context, partials, depth)
                    c = get(test) if test else None
                    # a boolean by itself, a text by not being empty
                    yes = F.lit(True) if test is None else F.lit(False) if c is None else ~F.coalesce(c.cast("string"), F.lit("")).isin("", "false")
                    out = F.when(yes, made).otherwise(out)
                parts.append(out)
            elif n.kind == "for":
                c = get(n)
                if c is None:
                    continue
                name = n.path[-1]
                body = F.transform(c, self._item(n, name, context, partials, depth))
                sep = "".join(s.text for s in n.sep)
                parts.append(F.coalesce(F.array_join(body, sep), F.lit("")))
            else:
                source = partials(n.text)
                if source is None:
                    raise TemplateError(f"no partial {n.text!r}")
                parts.append(self._column(parse(source.rstrip("\n")).nodes, context, partials, depth + 1))
        return F.concat(*parts)


def parse(source: str) -> Template:
    source = ALONE.sub(lambda m: m[1], source)
    tokens: list[tuple[str, str]] = []
    at = 0
    for m in TOKEN.finditer(source):
        if m.start() > at:
            tokens.append(("text", source[at : m.start()]))
        at = m.end()
        if m[0] == "$$":
            tokens.append(("text", "$"))
        elif not m[0].startswith("$--"):
            tokens.append(("code", (m[1] if m[1] is not None else m[2]).strip()))
    tokens.append(("text", source[at:]))
    pos = 0

    def until(*ends: str) -> tuple[list[Node], str]:
        nonlocal pos
        out: list[Node] = []
        while pos < len(tokens):
            kind, t = tokens[pos]
            pos += 1
            if kind == "text":
                if t:
                    out.append(Node("text", text=t))
                continue
            word = re.match(r"(if|elseif|for|else|endif|endfor|sep)\b(?:\((.*)\))?$", t)
            if word and (word[1] in ends or word[1].split("(")[0] in ends):
                return out, t
            if word and word[1] == "if":
                arms: list[tuple[Node | None, list[Node]]] = []
                test: Node | None = _variable(word[2])
                while True:
                    body, end = until("elseif", "else", "endif")
                    arms.append((test, body))
                    if end.startswith("elseif"):
                        test = _variable(end[7:-1])
                    elif end == "else":
                        test = None
                    else:
                        break
                out.append(Node("if", arms=arms))
            elif word and word[1] == "for":
                v = _variable(word[2])
                body, end = until("sep", "endfor")
                sep: list[Node] = []
                if end == "sep":
                    sep, _ = until("endfor")
                out.append(Node("for", path=v.path, pipes=v.pipes, body=body, sep=sep))
            elif word:
                raise TemplateError(f"{t} without its beginning")
            elif m := re.fullmatch(r"([\w./-]+)\(\)", t):
                out.append(Node("partial", text=m[1]))
            else:
                out.append(_variable(t))
        if ends:
            raise TemplateError(f"no {' or '.join(ends)}")
        return out, ""

    return Template(until()[0])
