"""Syntax highlighting: grammars are ordered rules in contexts; text becomes lines of (kind, text) tokens."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

# The kinds that tokens can have, with the short classes that HTML output uses.
KINDS = {"Normal": "", "Keyword": "kw", "DataType": "dt", "DecVal": "dv", "BaseN": "bn", "Float": "fl", "Char": "ch", "String": "st", "Comment": "co", "Other": "ot", "Alert": "al", "Function": "fu", "RegionMarker": "re", "Error": "er", "Constant": "cn", "SpecialChar": "sc", "VerbatimString": "vs", "SpecialString": "ss", "Import": "im", "Documentation": "do", "Annotation": "an", "CommentVar": "cv", "Variable": "va", "ControlFlow": "cf", "Operator": "op", "BuiltIn": "bu", "Extension": "ex", "Preprocessor": "pp", "Attribute": "at", "Information": "in", "Warning": "wa"}


@dataclass
class Rule:
    """Pattern and kind; `to` names the context that follows ('#pop' leaves the current one, '' stays)."""

    pattern: re.Pattern
    kind: str
    to: str = ""


def words(*names: str) -> re.Pattern:
    return re.compile(r"(?:" + "|".join(map(re.escape, names)) + r")\b(?!\w)")


R = re.compile
NUMBERS = [Rule(R(r"0[xX][0-9a-fA-F_]+"), "BaseN"), Rule(R(r"0[oObB][0-7_]+"), "BaseN"), Rule(R(r"\d[\d_]*\.\d*(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+"), "Float"), Rule(R(r"\d[\d_]*"), "DecVal")]
NAME = [Rule(R(r"[A-Za-z_]\w*(?=\s*\()"), "Function"), Rule(R(r"[A-Za-z_]\w*"), "Normal")]
OPERATORS = [Rule(R(r"[-+*/%=<>!&|^~?:]+"), "Operator")]
STRING = [Rule(R(r'"'), "String", "dq"), Rule(R(r"'"), "String", "sq")]
QUOTED = {"dq": ("String", [Rule(R(r"\\."), "SpecialChar"), Rule(R(r'"'), "String", "#pop"), Rule(R(r'[^"\\]+'), "String")]), "sq": ("String", [Rule(R(r"\\."), "SpecialChar"), Rule(R(r"'"), "String", "#pop"), Rule(R(r"[^'\\]+"), "String")])}
BLOCK_COMMENT = {"block": ("Comment", [Rule(R(r"\*/"), "Comment", "#pop"), Rule(R(r"[^*]+|\*"), "Comment")])}

#: Language: contexts by name; a context has a default kind, rules, and ends with its line unless it spans lines.
GRAMMARS: dict[str, dict[str, tuple[str, list[Rule]]]] = {
    "python": {
        "start": ("Normal", [Rule(R(r"#.*"), "Comment"), Rule(R(r"@[\w.]+"), "Attribute"), Rule(R(r'"""'), "VerbatimString", "doc"), *STRING, Rule(words("import", "from", "as"), "Import"), Rule(words("if", "elif", "else", "for", "while", "return", "break", "continue", "try", "except", "finally", "raise", "with", "yield", "pass", "match", "case"), "ControlFlow"), Rule(words("def", "class", "lambda", "global", "nonlocal", "del", "assert", "and", "or", "not", "in", "is", "async", "await"), "Keyword"), Rule(words("None", "True", "False"), "Constant"), Rule(words("print", "len", "range", "int", "str", "list", "dict", "set", "tuple", "open", "map", "zip", "sum", "min", "max"), "BuiltIn"), Rule(words("self", "cls"), "Variable"), *NUMBERS, *NAME, *OPERATORS]),
        "doc": ("VerbatimString", [Rule(R(r'"""'), "VerbatimString", "#pop"), Rule(R(r'[^"]+|"'), "VerbatimString")]),
        **QUOTED,
    },
    "sql": {"start": ("Normal", [Rule(R(r"--.*"), "Comment"), Rule(R(r"/\*"), "Comment", "block"), *STRING, Rule(R(r"(?i:select|from|where|group|by|order|join|left|right|inner|outer|full|on|as|and|or|not|in|is|null|with|union|all|insert|into|values|update|set|delete|create|table|case|when|then|else|end|having|limit|distinct|over|partition)\b"), "Keyword"), Rule(R(r"(?i:int|bigint|varchar|text|date|double|boolean|timestamp)\b"), "DataType"), *NUMBERS, *NAME, *OPERATORS]), **QUOTED, **BLOCK_COMMENT},
    "c": {"start": ("Normal", [Rule(R(r"//.*"), "Comment"), Rule(R(r"/\*"), "Comment", "block"), Rule(R(r"#\s*\w+"), "Preprocessor"), *STRING, Rule(words("if", "else", "for", "while", "do", "switch", "case", "default", "return", "break", "continue", "goto"), "ControlFlow"), Rule(words("struct", "union", "enum", "typedef", "static", "const", "extern", "sizeof", "volatile", "inline"), "Keyword"), Rule(words("int", "char", "long", "short", "unsigned", "signed", "float", "double", "void", "bool", "size_t"), "DataType"), *NUMBERS, *NAME, *OPERATORS]), **QUOTED, **BLOCK_COMMENT},
    "javascript": {"start": ("Normal", [Rule(R(r"//.*"), "Comment"), Rule(R(r"/\*"), "Comment", "block"), *STRING, Rule(R(r"`[^`]*`"), "VerbatimString"), Rule(words("if", "else", "for", "while", "do", "switch", "case", "default", "return", "break", "continue", "throw", "try", "catch", "finally"), "ControlFlow"), Rule(words("import", "export", "from"), "Import"), Rule(words("var", "let", "const", "function", "class", "extends", "new", "typeof", "in", "of", "async", "await", "this"), "Keyword"), Rule(words("null", "undefined", "true", "false"), "Constant"), *NUMBERS, *NAME, *OPERATORS]), **QUOTED, **BLOCK_COMMENT},
    "json": {"start": ("Normal", [Rule(R(r'"(?:[^"\\]|\\.)*"(?=\s*:)'), "DataType"), Rule(R(r'"'), "String", "dq"), Rule(words("true", "false", "null"), "Constant"), *NUMBERS]), **QUOTED},
    "bash": {"start": ("Normal", [Rule(R(r"#.*"), "Comment"), *STRING, Rule(R(r"\$\{?\w+\}?"), "Variable"), Rule(words("if", "then", "else", "elif", "fi", "for", "in", "do", "done", "while", "case", "esac", "return"), "ControlFlow"), Rule(words("echo", "cd", "export", "local", "source", "exit", "set", "read"), "BuiltIn"), *NUMBERS, *NAME, *OPERATORS]), **QUOTED},
}
ALIASES = {"py": "python", "python3": "python", "js": "javascript", "ts": "javascript", "h": "c", "cpp": "c", "sh": "bash", "shell": "bash", "pgsql": "sql"}
#: Contexts that go on in the next line.
SPANS = frozenset(("doc", "block"))
#: Rule tries a line may take, as a guard.
STEPS = 100_000


def highlight(language: str, code: str) -> list[list[tuple[str, str]]] | None:
    """Lines of tokens, or None for a language without grammar. The texts of all tokens make up the code again."""
    grammar = GRAMMARS.get(ALIASES.get(language.lower(), language.lower()))
    if grammar is None:
        return None
    stack, out = ["start"], []
    for line in code.split("\n"):
        tokens: list[tuple[str, str]] = []
        i = steps = 0
        while i < len(line) and steps < STEPS:
            default, rules = grammar[stack[-1]]
            steps += 1
            for r in rules:
                m = r.pattern.match(line, i)
                if m and m.end() > i:
                    kind, text = r.kind, m[0]
                    if r.to == "#pop":
                        stack.pop()
                    elif r.to:
                        stack.append(r.to)
                    break
            else:
                kind, text = default, line[i]
            if tokens and tokens[-1][0] == kind:
                tokens[-1] = (kind, tokens[-1][1] + text)
            else:
                tokens.append((kind, text))
            i += len(text)
        if i < len(line):
            tokens.append(("Normal", line[i:]))
        while len(stack) > 1 and stack[-1] not in SPANS:
            stack.pop()
        out.append(tokens)
    return out


def to_html(language: str, code: str) -> str:
    lines = highlight(language, code) or [[("Normal", x)] for x in code.split("\n")]
    say = lambda k, t: html.escape(t) if not KINDS[k] else f'<span class="{KINDS[k]}">{html.escape(t)}</span>'
    return f'<div class="sourceCode"><pre class="sourceCode {html.escape(language)}"><code class="sourceCode {html.escape(language)}">' + "\n".join("".join(say(k, t) for k, t in line) for line in lines) + "</code></pre></div>"


#: A theme: kind to (colour, bold, italic).
THEME = {"Keyword": ("#007020", True, False), "ControlFlow": ("#007020", True, False), "DataType": ("#902000", False, False), "DecVal": ("#40a070", False, False), "Float": ("#40a070", False, False), "BaseN": ("#40a070", False, False), "String": ("#4070a0", False, False), "Comment": ("#60a0b0", False, True), "Function": ("#06287e", False, False), "Constant": ("#880000", False, False), "Import": ("#008000", True, False), "Operator": ("#666666", False, False)}


def theme_css(theme: dict[str, tuple[str, bool, bool]] = THEME) -> str:
    return "\n".join(f"code span.{KINDS[k]} {{ color: {c};{' font-weight: bold;' if b else ''}{' font-style: italic;' if i else ''} }} /* {k} */" for k, (c, b, i) in theme.items())


def tokens(blocks: DataFrame, language: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line, ord, kind, text of every token of a column of code."""
    kind = blocks.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, n, o, kd, t) for k, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for n, line in enumerate(highlight(language, s or "") or []) for o, (kd, t) in enumerate(line)]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [b.schema.field(0).type, pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [key, "line", "ord", "kind", "text"])

    return blocks.select(key, text).mapInArrow(run, f"{key} {kind}, line int, ord int, kind string, text string")
