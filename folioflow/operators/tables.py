"""Text tables from relational rows: widths by aggregate, rows joined in order. For tables small enough to be a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import text as T


def _gather(df: DataFrame, columns: list[str], order: Column, by: list[str] | None = None) -> DataFrame:
    """One row (of each group of `by`): `rows` (structs in order) and the width of each column, headings included."""
    cells = df.select(*(by or ()), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns), order.alias("_o"))
    widths = [F.greatest(F.max(T.display_width(F.col(c))), F.lit(len(c))).alias(f"_w{i}") for i, c in enumerate(columns)]
    return cells.groupBy(*(by or ())).agg(F.array_sort(F.collect_list(F.struct("_o", *columns))).alias("rows"), *widths)


def pipe_table(df: DataFrame, columns: list[str], aligns: list[str], order: Column) -> DataFrame:
    g = _gather(df, columns, order)
    w = [F.col(f"_w{i}") for i in range(len(columns))]

    def row(cells: list[Column]) -> Column:
        return F.concat(F.lit("| "), F.concat_ws(" | ", *(T.pad(c, x, a) for c, x, a in zip(cells, w, aligns, strict=True))), F.lit(" |"))

    rule = lambda x, a: F.concat(F.lit(":" if a == "center" else "-"), F.repeat(F.lit("-"), x), F.lit(":" if a in ("right", "center") else "-"))
    lines = F.transform("rows", lambda r: row([r[c] for c in columns]))
    head = [row([F.lit(c) for c in columns]), F.concat(F.lit("|"), F.concat_ws("|", *(rule(x, a) for x, a in zip(w, aligns, strict=True))), F.lit("|"))]
    return g.select(F.array_join(F.concat(F.array(*head), lines), "\n").alias("tbl"))


def simple_table(df: DataFrame, columns: list[str], order: Column, by: list[str] | None = None) -> DataFrame:
    """One text, or the columns `by` and a text for each of their groups."""
    g = _gather(df, columns, order, by)
    row = lambda cells: F.concat_ws("  ", *(T.pad(c, F.col(f"_w{i}"), "left") for i, c in enumerate(cells)))
    rule = F.concat_ws("  ", *(F.repeat(F.lit("-"), F.col(f"_w{i}")) for i in range(len(columns))))
    lines = F.transform("rows", lambda r: row([r[c] for c in columns]))
    return g.select(*(by or ()), F.array_join(F.concat(F.array(row([F.lit(c) for c in columns]), rule), lines), "\n").alias("tbl"))


def html_table(df: DataFrame, columns: list[str], order: Column) -> DataFrame:
    g = _gather(df, columns, order)
    cells = lambda tag, xs: F.concat(F.lit("<tr>"), *(F.concat(F.lit(f"<{tag}>"), T.escape_xml(x), F.lit(f"</{tag}>")) for x in xs), F.lit("</tr>"))
    lines = F.transform("rows", lambda r: cells("td", [r[c] for c in columns]))
    head = F.array(F.lit("<table>"), F.lit("<thead>"), cells("th", [F.lit(c) for c in columns]), F.lit("</thead>"), F.lit("<tbody>"))
    return g.select(F.array_join(F.concat(head, lines, F.array(F.lit("</tbody>"), F.lit("</table>"))), "\n").alias("tbl"))
