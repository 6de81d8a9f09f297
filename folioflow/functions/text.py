"""Column functions of the document engine: escapes, slugs, numerals, widths, encodings. All are Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Pairs = list[tuple[str, str]]

# Characters that a target format escapes, in the order of replacement.
XML: Pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")]
XML_QUOTE: Pairs = [*XML, ('"', "&quot;")]
XML_ATTR: Pairs = [*XML_QUOTE, ("'", "&#39;")]
URI: Pairs = [(" ", "%20"), ("\t", "%09"), ("\n", "%0A"), ("\r", "%0D"), ("<", "%3C"), (">", "%3E"), ("|", "%7C"), ('"', "%22"), ("{", "%7B"), ("}", "%7D"), ("[", "%5B"), ("]", "%5D"), ("^", "%5E"), ("`", "%60")]
LATEX: Pairs = [("\\", "\x01"), ("{", "\\{"), ("}", "\\}"), ("$", "\\$"), ("&", "\\&"), ("%", "\\%"), ("#", "\\#"), ("_", "\\_"), ("~", "\\textasciitilde{}"), ("^", "\\^{}"), ("\x01", "\\textbackslash{}")]
RST: Pairs = [("\\", "\\\\"), ("*", "\\*"), ("`", "\\`"), ("|", "\\|")]
MAN: Pairs = [("\\", "\\[rs]"), ("-", "\\-"), ("'", "\\[aq]"), ("`", "\\[ga]"), ("^", "\\[ha]"), ("~", "\\[ti]")]
SMART_TO_ASCII: Pairs = [("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"'), ("—", "---"), ("–", "--"), ("…", "...")]
ENTITIES: Pairs = [("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")]
IMAGE_MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "webp": "image/webp", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff"}
#: Code point ranges that take two columns and none, for terminals (fixed values).
WIDE = [(0x1100, 0x115F), (0x2E80, 0x303E), (0x3041, 0x33FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA000, 0xA4CF), (0xAC00, 0xD7A3), (0xF900, 0xFAFF), (0xFE30, 0xFE6F), (0xFF00, 0xFF60), (0xFFE0, 0xFFE6), (0x1F300, 0x1F64F), (0x1F900, 0x1F9FF), (0x20000, 0x3FFFD)]
ZERO = [(0x0300, 0x036F), (0x200B, 0x200F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF)]


def replace_all(col: Column, pairs: Pairs) -> Column:
    for a, b in pairs:
        col = F.replace(col, F.lit(a), F.lit(b))
    return col


def lower_chars(col: Column) -> Column:
    """Lower case, letter by letter: no final-sigma rule."""
    return F.array_join(F.transform(F.split(col, ""), lambda c: F.lower(c)), "")


def escape_xml(col: Column, quotes: bool = False) -> Column:
    return replace_all(col, XML_QUOTE if quotes else XML)


def escape_attr(col: Column) -> Column:
    return replace_all(col, XML_ATTR)


def escape_uri(col: Column) -> Column:
    """White space and delimiters only; what is percent-escaped already stays."""
    return replace_all(col, URI)


def percent_decode(col: Column) -> Column:
    """Null where malformed; a plus sign stays one."""
    return F.when(~col.rlike("%(?![0-9A-Fa-f]{2})"), F.try_url_decode(F.replace(col, F.lit("+"), F.lit("%2B"))))


def slug(col: Column) -> Column:
    """Identifier of a heading: lower case, letters, digits, _ - and . kept, blanks to hyphens, begins with a letter."""
    kept = F.regexp_replace(lower_chars(col), r"[^\p{L}\p{N}\s_.-]", "")
    return F.regexp_replace(F.regexp_replace(F.trim(kept), r"\s+", "-"), r"^[^\p{L}]+", "")


def slug_gfm(col: Column) -> Column:
    """The other dialect: every blank is a hyphen of its own, full stops go, digits may lead."""
    return F.regexp_replace(F.regexp_replace(lower_chars(F.trim(col)), r"[^\p{L}\p{N}\p{M}\s_-]", ""), r"\s", "-")


def _ranges(c: Column, ranges: list[tuple[int, int]]) -> Column:
    out = F.lit(False)
    for a, b in ranges:
        out = out | c.between(a, b)
    return out


def char_width(c: Column) -> Column:
    """Columns of one character given as its code point."""
    return F.when(_ranges(c, ZERO), 0).when(_ranges(c, WIDE), 2).otherwise(1)


def display_width(col: Column) -> Column:
    """Columns of a text; plain ASCII needs no walk over its characters."""
    walk = F.aggregate(F.filter(F.split(col, ""), lambda c: c != ""), F.lit(0), lambda a, c: a + char_width(F.ascii(c)))
    return F.when(F.octet_length(col) == F.length(col), F.length(col)).otherwise(walk)


def pad(col: Column, width: Column, align: str) -> Column:
    """Left, right or centre padding by display width; a text that is wider stays."""
    gap = F.greatest(width - display_width(col), F.lit(0))
    if align == "right":
        return F.concat(F.repeat(F.lit(" "), gap), col)
    if align == "center":
        left = F.floor(gap / 2).cast("int")
        return F.concat(F.repeat(F.lit(" "), left), col, F.repeat(F.lit(" "), gap - left))
    return F.concat(col, F.repeat(F.lit(" "), gap))


def roman(n: Column, upper: bool = False, zero: str = "decimal") -> Column:
    """1 to 3999; outside it the decimal number. zero='empty': 0 is an empty text (the template pipe)."""
    digits = [["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"], ["", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"], ["", "c", "cc", "ccc", "cd", "d", "dc", "dcc", "dccc", "cm"], ["", "m", "mm", "mmm"]]
    parts = [F.element_at(F.array(*map(F.lit, ds)), (F.floor(n / 10**k) % 10 + 1).cast("int")) for k, ds in enumerate(digits)]
    text = F.concat(*reversed(parts))
    out = F.when(n.between(1, 3999), F.upper(text) if upper else text).otherwise(n.cast("string"))
    return F.when(n == 0, "").otherwise(out) if zero == "empty" else out


def alpha(n: Column, upper: bool = False) -> Column:
    """Bijective base 26 (a to z, aa, ...; fourteen letters hold every long); below 1 the decimal number."""
    a = 65 if upper else 97
    step = lambda s, _: F.struct(F.when(s["n"] > 0, F.call_function("div", s["n"] - 1, F.lit(26))).otherwise(0).cast("long").alias("n"), F.when(s["n"] > 0, F.concat(F.char((F.lit(a) + (s["n"] - 1) % 26).cast("int")), s["t"])).otherwise(s["t"]).alias("t"))
    made = F.aggregate(F.sequence(F.lit(1), F.lit(14)), F.struct(n.cast("long").alias("n"), F.lit("").alias("t")), step)["t"]
    return F.when(n < 1, n.cast("string")).when(n.isNotNull(), made)


def alpha_pipe(n: Column) -> Column:
    """One letter at n modulo 26; multiples of 26 give the character before a (the template pipe)."""
    return F.char((F.lit(96) + n % 26).cast("int"))


def ordered_marker(number: Column, delim: str) -> Column:
    return F.concat(F.lit("(") if delim == "both" else F.lit(""), number, F.lit("." if delim == "period" else ")"))


def fence_length(col: Column) -> Column:
    """Backticks that a fence around the text needs: one more than its longest run, three at least."""
    runs = F.transform(F.regexp_extract_all(col, F.lit("`+"), F.lit(0)), lambda r: F.length(r))
    return F.greatest(F.coalesce(F.array_max(runs), F.lit(0)) + 1, F.lit(3))


def code_span(col: Column) -> Column:
    """A code span whose ticks the text does not hold; padded where it begins or ends with one."""
    runs = F.transform(F.regexp_extract_all(col, F.lit("`+"), F.lit(0)), lambda r: F.length(r))
    n = F.coalesce(F.array_max(runs), F.lit(0)) + 1
    space = F.when(F.startswith(col, F.lit("`")) | F.endswith(col, F.lit("`")), " ").otherwise("")
    return F.concat(F.repeat(F.lit("`"), n), space, col, space, F.repeat(F.lit("`"), n))


def indent_block(col: Column, first: str, rest: str) -> Column:
    """First and further lines prefixed; blank ones stay bare."""
    line = lambda x, i: F.when(x == "", "").otherwise(F.concat(F.when(i == 0, first).otherwise(rest), x))
    return F.array_join(F.transform(F.split(col, "\n"), line), "\n")


def quote_block(col: Column) -> Column:
    return F.array_join(F.transform(F.split(col, "\n"), lambda x: F.when(x == "", ">").otherwise(F.concat(F.lit("> "), x))), "\n")


def base64_line(col: Column) -> Column:
    return F.regexp_replace(F.base64(col), r"\s", "")


def base64_mime(col: Column) -> Column:
    """Lines of 76 columns, each with a line end."""
    return F.regexp_replace(base64_line(col), "(.{1,76})", "$1\n")


def data_uri(mime: Column, col: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), base64_line(col))


def extension_of_mime(mime: Column) -> Column:
    known = {v: k for k, v in reversed(IMAGE_MIME.items())}
    out = F.when(F.lit(False), "")
    for m, e in known.items():
        out = out.when(mime == m, e)
    return out.otherwise(F.split_part(mime, F.lit("/"), F.lit(2)))


def mime_of_path(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = F.when(F.lit(False), "")
    for e, m in IMAGE_MIME.items():
        out = out.when(ext == e, m)
    return out


def content_name(mime: Column, col: Column) -> Column:
    return F.concat(F.sha1(col), F.lit("."), extension_of_mime(mime))


def dash_runs(col: Column) -> Column:
    """Three hyphens are an em dash, two an en dash; longest first."""
    return F.replace(F.replace(col, F.lit("---"), F.lit("—")), F.lit("--"), F.lit("–"))


def ellipsis(col: Column) -> Column:
    return F.replace(col, F.lit("..."), F.lit("…"))


def collapse(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"[ \t\r\n]+", " "))


def fill(words: Column, width: int) -> Column:
    """Greedy line filling of an array of words: a word goes on a new line when it would end beyond the width."""
    step = lambda a, w: F.when(a["col"] == 0, F.struct(w.alias("out"), F.length(w).alias("col"))).when(a["col"] + 1 + F.length(w) > width, F.struct(F.concat(a["out"], F.lit("\n"), w).alias("out"), F.length(w).alias("col"))).otherwise(F.struct(F.concat(a["out"], F.lit(" "), w).alias("out"), (a["col"] + 1 + F.length(w)).alias("col")))
    return F.aggregate(F.filter(words, lambda w: w != ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("col")), step)["out"]


# Letters with marks and the letters below them; digits as raised and lowered glyphs.
MARKED, BARE = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
DIGITS, RAISED, LOWERED = "0123456789+-=()", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾", "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎"
#: Inches of a unit.
UNITS = {"in": 1.0, "cm": 1 / 2.54, "mm": 1 / 25.4, "px": 1 / 96, "pt": 1 / 72, "pc": 1 / 6}
SCHEMES = ("http", "https", "ftp", "mailto", "file", "data", "news", "tel", "urn", "ws", "wss")


def fold_ascii(col: Column) -> Column:
    """Latin letters without their marks; other characters stay."""
    return F.translate(col, MARKED, BARE)


def raised(col: Column) -> Column:
    """Superscript glyphs if every character has one, else null."""
    return F.when(F.translate(col, DIGITS, "") == "", F.translate(col, DIGITS, RAISED))


def lowered(col: Column) -> Column:
    return F.when(F.translate(col, DIGITS, "") == "", F.translate(col, DIGITS, LOWERED))


def roman_value(col: Column) -> Column:
    """The value of a canonical numeral, null for any other text."""
    lower = F.lower(col)
    worth = lambda c: F.when(c == "i", 1).when(c == "v", 5).when(c == "x", 10).when(c == "l", 50).when(c == "c", 100).when(c == "d", 500).when(c == "m", 1000).otherwise(0)
    # from the right: a smaller digit than the one before it counts down
    step = lambda a, c: F.struct((a["sum"] + F.when(worth(c) < a["last"], -worth(c)).otherwise(worth(c))).alias("sum"), F.greatest(a["last"], worth(c)).alias("last"))
    total = F.aggregate(F.split(F.reverse(lower), ""), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")), step)["sum"]
    return F.when(lower.rlike("^m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$") & (lower != ""), total)


def dimension(col: Column) -> tuple[Column, Column]:
    """Number and unit of a length such as 2.5cm or 50%; nulls for anything else. No unit means pixels."""
    pattern = r"^\s*([0-9]+(?:\.[0-9]+)?)\s*(in|inch|cm|mm|px|pt|pc|%|)\s*$"
    ok = col.rlike(pattern)
    unit = F.regexp_extract(col, pattern, 2)
    named = F.when(unit == "", "px").when(unit == "inch", "in").otherwise(unit)
    return F.when(ok, F.regexp_extract(col, pattern, 1).try_cast("double")), F.when(ok, named)


def inches(number: Column, unit: Column) -> Column:
    out = F.when(F.lit(False), 0.0)
    for name, size in UNITS.items():
        out = out.when(unit == name, number * size)
    return out


def is_uri(col: Column) -> Column:
    """A known scheme and no blank or delimiter."""
    return F.lower(F.regexp_extract(col, r"^([A-Za-z][A-Za-z0-9+.-]*):[^\s<>\"{}|\\^`]*$", 1)).isin(*SCHEMES)


def join_url(base: Column, url: Column) -> Column:
    """A relative address on its base: its root, or its folder."""
    root = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    folder = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^?#]*/", 0)
    return F.when(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), url).when(F.startswith(url, F.lit("/")), F.concat(root, url)).otherwise(F.concat(F.when(folder == "", F.concat(root, F.lit("/"))).otherwise(folder), url))


def xml_chars(col: Column) -> Column:
    """Without the control characters that XML forbids."""
    return F.regexp_replace(col, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]", "")


def dash_thirds(n: Column) -> Column:
    """A run of n hyphens as em dashes, with an en dash or a hyphen for what is left."""
    return F.concat(F.repeat(F.lit("—"), F.floor(n / 3).cast("int")), F.when(n % 3 == 2, "–").when(n % 3 == 1, "-").otherwise(""))


def block_pipe(col: Column, width: int, align: str, left: str, right: str) -> Column:
    """A text padded to a width by characters, between borders; trailing blanks go where the right border is empty."""
    gap = F.greatest(F.lit(width) - F.length(col), F.lit(0))
    a = F.lit(0) if align == "left" else gap if align == "right" else F.floor(gap / 2).cast("int")
    made = F.concat(F.lit(left), F.repeat(F.lit(" "), a), col, F.repeat(F.lit(" "), gap - a), F.lit(right))
    return made if right else F.rtrim(made)
