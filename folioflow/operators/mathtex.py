"""TeX formulas: a small grammar (symbols, scripts, fractions, roots, matrices) to MathML, Typst, or text inlines."""

from __future__ import annotations

import html
import re
from typing import Any

# TeX commands and their characters.
GREEK = dict(zip("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau upsilon phi chi psi omega".split(), "αβγδϵζηθικλμνξπρστυϕχψω", strict=True)) | dict(zip("Gamma Delta Theta Lambda Xi Pi Sigma Upsilon Phi Psi Omega".split(), "ΓΔΘΛΞΠΣΥΦΨΩ", strict=True))
OPERATORS = {"times": "×", "cdot": "⋅", "pm": "±", "le": "≤", "leq": "≤", "ge": "≥", "geq": "≥", "ne": "≠", "neq": "≠", "approx": "≈", "equiv": "≡", "in": "∈", "notin": "∉", "subset": "⊂", "subseteq": "⊆", "cup": "∪", "cap": "∩", "to": "→", "rightarrow": "→", "leftarrow": "←", "Rightarrow": "⇒", "infty": "∞", "partial": "∂", "nabla": "∇", "forall": "∀", "exists": "∃", "sum": "∑", "prod": "∏", "int": "∫", "ldots": "…", "cdots": "⋯", "dots": "…", "sim": "∼", "circ": "∘", "ast": "∗", "star": "⋆", "oplus": "⊕", "otimes": "⊗", "land": "∧", "lor": "∨", "neg": "¬", "emptyset": "∅", "mid": "∣", "langle": "⟨", "rangle": "⟩", "{": "{", "}": "}", "%": "%", "$": "$", "&": "&", "_": "_", "#": "#"}
FUNCTIONS = frozenset("sin cos tan log ln exp lim max min sup inf det dim ker gcd arg deg".split())
SPACES = {",": 0.167, ":": 0.222, ";": 0.278, " ": 0.333, "quad": 1.0, "qquad": 2.0, "!": -0.167}
FONTS = {"mathbf": "bold", "mathrm": "normal", "mathit": "italic", "mathbb": "double-struck", "mathcal": "script", "mathfrak": "fraktur", "mathsf": "sans-serif", "mathtt": "monospace", "text": "text", "mathop": "normal", "operatorname": "normal"}
MATRICES = {"matrix": ("", ""), "pmatrix": ("(", ")"), "bmatrix": ("[", "]"), "vmatrix": ("|", "|"), "Bmatrix": ("{", "}"), "cases": ("{", ""), "aligned": ("", ""), "align": ("", ""), "array": ("", "")}
DEPTH = 64
Atom = tuple[Any, ...]


class Outside(ValueError):
    """The formula is not of this grammar."""


def parse(tex: str) -> list[Atom]:
    tokens = re.findall(r"\\[a-zA-Z]+|\\.|[{}^_&]|\d+(?:\.\d+)?|\s+|.", tex, re.S)
    pos = 0

    def peek() -> str | None:
        nonlocal pos
        while pos < len(tokens) and tokens[pos].isspace():
            pos += 1
        return tokens[pos] if pos < len(tokens) else None

    def arg(depth: int) -> list[Atom]:
        nonlocal pos
        if peek() == "{":
            pos += 1
            return seq(depth + 1, "}")
        a = atom(depth + 1)
        if a is None:
            raise Outside("argument missing")
        return [a]

    def raw() -> str:
        nonlocal pos
        if peek() != "{":
            raise Outside("group missing")
        pos += 1
        out = ""
        level = 1
        while pos < len(tokens):
            t = tokens[pos]
            pos += 1
            level += (t == "{") - (t == "}")
            if not level:
                return out
            out += t
        raise Outside("group open")

    def atom(depth: int) -> Atom | None:
        nonlocal pos
        if depth > DEPTH:
            raise Outside("too deep")
        t = peek()
        if t is None:
            return None
        pos += 1
        if t == "{":
            return ("row", seq(depth + 1, "}"))
        if t[0] == "\\":
            name = t[1:]
            if name in GREEK:
                return ("id", GREEK[name])
            if name in OPERATORS:
                return ("op", OPERATORS[name])
            if name in FUNCTIONS:
                return ("fn", name)
            if name in SPACES:
                return ("space", SPACES[name])
            if name in ("frac", "dfrac", "tfrac"):
                return ("frac", arg(depth), arg(depth))
            if name == "binom":
                return ("fence", "(", [("stack", arg(depth), arg(depth))], ")")
            if name == "sqrt":
                index: list[Atom] = []
                if peek() == "[":
                    pos += 1
                    index = seq(depth + 1, "]")
                return ("root", arg(depth), index)
            if name in FONTS:
                return ("text", raw()) if name == "text" else ("font", FONTS[name], arg(depth))
            if name in ("overline", "bar", "hat", "vec", "tilde", "dot"):
                return ("accent", {"overline": "¯", "bar": "¯", "hat": "^", "vec": "→", "tilde": "~", "dot": "˙"}[name], arg(depth))
            if name == "left":
                a = tokens[pos] if pos < len(tokens) else "."
                pos += 1
                inner = seq(depth + 1, "\\right")
                b = tokens[pos] if pos < len(tokens) else "."
                pos += 1
                fix = lambda s: "" if s == "." else OPERATORS.get(s[1:], s[1:]) if s[0] == "\\" else s
                return ("fence", fix(a), inner, fix(b))
            if name == "begin":
                env = raw()
                if env.rstrip("*") not in MATRICES:
                    raise Outside(env)
                if env == "array":
                    raw()
                rows: list[list[list[Atom]]] = [[]]
                while True:
                    rows[-1].append(seq(depth + 1, "&", "\\\\", "\\end"))
                    end = tokens[pos - 1]
                    if end == "\\\\":
                        rows.append([])
                    elif end == "\\end":
                        raw()
                        break
                return ("matrix", *MATRICES[env.rstrip("*")], [r for r in rows if any(r)])
            raise Outside(t)
        if t[0].isdigit():
            return ("num", t)
        if t.isalpha():
            return ("id", t)
        if t in "^_}&":
            raise Outside(t)
        return ("op", {"-": "−", "*": "∗", "'": "′"}.get(t, t))

    def seq(depth: int, *ends: str) -> list[Atom]:
        nonlocal pos
        out: list[Atom] = []
        while True:
            t = peek()
            if t is None:
                if ends:
                    raise Outside("group open")
                return out
            if t in ends:
                pos += 1
                return out
            if t in ("^", "_"):
                pos += 1
                base = out.pop() if out else ("row", [])
                sub, sup = (base[2], base[3]) if base[0] == "script" else (None, None)
                if (sup if t == "^" else sub) is not None:
                    raise Outside("double script")
                inner = base[1] if base[0] == "script" else base
                a = arg(depth)
                out.append(("script", inner, a if t == "_" else sub, a if t == "^" else sup))
                continue
            out.append(atom(depth))

    return seq(0)


def to_mathml(tex: str, display: bool = False) -> str | None:
    """Presentation MathML, or None for a formula outside the grammar."""

    def row(xs: list[Atom], font: str = "") -> str:
        made = [one(x, font) for x in xs]
        return made[0] if len(made) == 1 else f"<mrow>{''.join(made)}</mrow>"

    def one(a: Atom, font: str = "") -> str:
        k = a[0]
        style = f' mathvariant="{font}"' if font else ""
        e = html.escape
        if k in ("id", "fn"):
            return f"<mi{style}>{e(a[1])}</mi>"
        if k == "num":
            return f"<mn{style}>{a[1]}</mn>"
        if k == "op":
            return f"<mo>{e(a[1])}</mo>"
        if k == "space":
            return f'<mspace width="{a[1]}em"/>'
        if k == "text":
            return f"<mtext>{e(a[1])}</mtext>"
        if k == "row":
            return f"<mrow>{''.join(one(x, font) for x in a[1])}</mrow>"
        if k == "font":
            return row(a[2], a[1])
        if k == "frac":
            return f"<mfrac>{row(a[1], font)}{row(a[2], font)}</mfrac>"
        if k == "stack":
            return f'<mfrac linethickness="0">{row(a[1])}{row(a[2])}</mfrac>'
        if k == "root":
            return f"<mroot>{row(a[1])}{row(a[2])}</mroot>" if a[2] else f"<msqrt>{row(a[1])}</msqrt>"
        if k == "accent":
            return f'<mover accent="true">{row(a[2])}<mo>{a[1]}</mo></mover>'
        if k == "fence":
            return f"<mrow><mo>{e(a[1])}</mo>{row(a[2])}<mo>{e(a[3])}</mo></mrow>"
        if k == "matrix":
            body = "".join("<mtr>" + "".join(f"<mtd>{row(c)}</mtd>" for c in r) + "</mtr>" for r in a[3])
            return f"<mrow><mo>{a[1]}</mo><mtable>{body}</mtable><mo>{a[2]}</mo></mrow>" if a[1] or a[2] else f"<mtable>{body}</mtable>"
        base, sub, sup = one(a[1], font), a[2], a[3]
        big = display and a[1] in [("op", c) for c in "∑∏"] + [("fn", "lim")]
        names = ("munder", "mover", "munderover") if big else ("msub", "msup", "msubsup")
        if sub is not None and sup is not None:
            return f"<{names[2]}>{base}{row(sub)}{row(sup)}</{names[2]}>"
        return f"<{names[0]}>{base}{row(sub)}</{names[0]}>" if sub is not None else f"<{names[1]}>{base}{row(sup)}</{names[1]}>"

    try:
        body = "".join(map(one, parse(tex)))
    except Outside:
        return None
    return f'<math display="{"block" if display else "inline"}" xmlns="http://www.w3.org/1998/Math/MathML"><mrow>{body}</mrow></math>'


def to_inlines(tex: str) -> list[dict[str, Any]] | None:
    """Simple formulas (letters, numbers, operators, scripts) as text inlines, or None."""
    from folioflow.sources.ast import merge, node

    def walk(xs: list[Atom]) -> list[dict[str, Any]]:
        out: list[dict[str, Any]] = []
        for a in xs:
            if a[0] == "id":
                out.append(node("Emph", [node("Str", a[1])]))
            elif a[0] in ("num", "fn", "text"):
                out.append(node("Str", a[1]))
            elif a[0] == "op":
                out.append(node("Str", f" {a[1]} " if a[1] in "=<>≤≥≠≈→∈×±" else a[1]))
            elif a[0] == "space":
                out.append(node("Str", " "))
            elif a[0] == "row":
                out += walk(a[1])
            elif a[0] == "script":
                out += walk([a[1]])
                out += [node("Subscript", walk(a[2]))] if a[2] is not None else []
                out += [node("Superscript", walk(a[3]))] if a[3] is not None else []
            else:
                raise Outside(a[0])
        return out

    try:
        return merge(walk(parse(tex)))
    except Outside:
        return None
