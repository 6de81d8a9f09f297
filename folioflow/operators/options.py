"""Dialect options: names, defaults of each dialect for reading and writing, and `base+ext-ext` specifications."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

# Option name, dialects that write with it, dialects that read with it.
# md markdown, cmx commonmark_x, gfm, md_gh markdown_github, md_php markdown_phpextra, md_mmd markdown_mmd, md_strict markdown_strict
TABLE = """
smart | cmx md | md cmx
strikeout | gfm cmx md md_gh | md md_gh gfm cmx
superscript | cmx md md_mmd | md md_mmd cmx
subscript | cmx md md_mmd | md md_mmd cmx
pipe_tables | gfm cmx md md_gh md_php md_mmd | md md_gh md_php md_mmd gfm cmx
footnotes | gfm cmx md md_gh md_php md_mmd | md md_gh md_php md_mmd gfm cmx
task_lists | gfm cmx md md_gh | md md_gh gfm cmx
autolink_bare_uris | gfm md_gh | md_gh gfm
tex_math_dollars | gfm cmx md md_mmd | md md_mmd gfm cmx
fenced_divs | cmx md | md cmx
bracketed_spans | cmx md | md cmx
hard_line_breaks | |
raw_html | gfm cmx md md_gh md_php md_mmd md_strict | md md_strict md_gh md_php md_mmd gfm cmx
header_attributes | cmx md md_php | md md_php cmx
fenced_code_attributes | cmx md | md cmx
inline_code_attributes | cmx md | md cmx
link_attributes | cmx md md_php | md md_php cmx
attributes | cmx | cmx
definition_lists | cmx md md_php md_mmd | md md_php md_mmd cmx
grid_tables | md | md
multiline_tables | md | md
simple_tables | md | md
table_captions | md | md
line_blocks | md | md
fancy_lists | cmx md | md cmx
example_lists | md | md
startnum | md | md
yaml_metadata_block | md | md gfm cmx
pandoc_title_block | md | md
auto_identifiers | md md_gh md_mmd | md md_gh md_mmd
gfm_auto_identifiers | gfm cmx md_gh | md_gh gfm cmx
ascii_identifiers | |
mmd_header_identifiers | md_mmd | md_mmd
implicit_header_references | cmx md md_mmd | md md_mmd cmx
implicit_figures | md md_mmd | md md_mmd
raw_attribute | cmx md md_mmd | md md_mmd cmx
inline_notes | md | md
native_divs | md | md
native_spans | md | md
markdown_in_html_blocks | md | md
markdown_attribute | md_php md_mmd | md_php md_mmd
raw_tex | md | md
citations | md | md
table_attributes | md | md
blank_before_blockquote | md | md
blank_before_header | md | md
mark | |
emoji | gfm cmx md_gh | md_gh gfm cmx
alerts | gfm cmx md_gh | md_gh gfm cmx
tex_math_single_backslash | |
tex_math_double_backslash | | md_mmd
fenced_code_blocks | md md_gh md_php | md md_gh md_php
backtick_code_blocks | gfm cmx md md_gh md_mmd | md md_gh md_mmd gfm cmx
tex_math_gfm | gfm | gfm
escaped_line_breaks | md | md
intraword_underscores | md md_gh md_php md_mmd | md md_gh md_php md_mmd
lists_without_preceding_blankline | | md_gh
abbreviations | | md_php
all_symbols_escapable | md | md md_gh md_mmd
angle_brackets_escapable | |
east_asian_line_breaks | |
four_space_rule | |
gutenberg | |
ignore_line_breaks | |
latex_macros | | md
literate_haskell | |
mmd_link_attributes | | md_mmd
mmd_title_block | | md_mmd
old_dashes | |
raw_markdown | |
rebase_relative_paths | |
short_subsuperscripts | | md_mmd
shortcut_reference_links | | md md_strict md_gh md_php md_mmd
space_in_atx_header | md | md md_gh
spaced_reference_links | | md_strict md_php md_mmd
wikilinks_title_after_pipe | |
wikilinks_title_before_pipe | |
styles | |
native_numbering | |
empty_paragraphs | |
"""
SHORT = {"md": "markdown", "cmx": "commonmark_x", "gfm": "gfm", "md_gh": "markdown_github", "md_php": "markdown_phpextra", "md_mmd": "markdown_mmd", "md_strict": "markdown_strict"}
WRITE: dict[str, frozenset[str]] = {}
READ: dict[str, frozenset[str]] = {"commonmark": frozenset({"raw_html"})}
NAMES: list[str] = []
for _line in TABLE.strip().split("\n"):
    _name, _w, _r = (x.strip() for x in _line.split("|"))
    NAMES.append(_name)
    for _to, _which in ((WRITE, _w), (READ, _r)):
        for _d in _which.split():
            _to[SHORT[_d]] = _to.get(SHORT[_d], frozenset()) | {_name}
NAMES.sort()


class UnknownOption(ValueError):
    pass


def parse_spec(spec: str, writing: bool = False) -> tuple[str, frozenset[str]]:
    """`markdown-smart+emoji` as its base and option set; later toggles win; an unknown option raises."""
    base, *toggles = re.split(r"(?=[+-])", spec)
    on = set((WRITE if writing else READ).get(base, ()))
    for t in toggles:
        if t[1:] not in NAMES:
            raise UnknownOption(t[1:])
        (on.add if t[0] == "+" else on.discard)(t[1:])
    return base, frozenset(on)


def greedy_paragraphs(base: str) -> bool:
    """In dialects of this name a paragraph is ended by a blank line only."""
    return base.startswith("markdown")


def matrix(spark: SparkSession) -> DataFrame:
    """dialect, extension, reads, writes for every pair."""
    rows = [(d, n, n in READ.get(d, ()), n in WRITE.get(d, ())) for d in sorted({*READ, *WRITE}) for n in NAMES]
    return spark.createDataFrame(rows, "dialect string, extension string, reads boolean, writes boolean")


def merged(names: Iterable[Iterable[str]]) -> frozenset[str]:
    return frozenset().union(*map(frozenset, names))
