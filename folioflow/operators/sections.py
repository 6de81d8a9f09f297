"""Section numbers, tables of contents, identifiers and slides over heading rows; windows within a document only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def number_sections(headings: DataFrame, doc: str = "doc_id", nid: str = "nid", level: str = "level") -> DataFrame:
    """headings with `number`: dotted counters from the document's shallowest level (its base) on.

    Counter k counts headings of level k since the last shallower one; levels are clamped to 1..6; a skipped level reads 0.
    """
    lv = F.least(F.greatest(F.col(level), F.lit(1)), F.lit(6))
    h = headings.withColumn("_l", lv).withColumn("_base", F.min("_l").over(Window.partitionBy(doc)))
    run = Window.partitionBy(doc).orderBy(nid).rowsBetween(Window.unboundedPreceding, 0)
    for k in range(2, 7):
        h = h.withColumn(f"_g{k}", F.sum(F.when(F.col("_l") < k, 1).otherwise(0)).over(run))
    for k in range(1, 7):
        group = [doc] if k == 1 else [doc, f"_g{k}"]
        w = Window.partitionBy(*group).orderBy(nid).rowsBetween(Window.unboundedPreceding, 0)
        h = h.withColumn(f"_c{k}", F.sum(F.when(F.col("_l") == k, 1).otherwise(0)).over(w))
    parts = F.slice(F.array(*(F.col(f"_c{k}").cast("string") for k in range(1, 7))), F.col("_base"), F.col("_l") - F.col("_base") + 1)
    return h.withColumn("number", F.array_join(parts, ".")).select(*headings.columns, "number")


def toc(headings: DataFrame, depth: int = 3, doc: str = "doc_id", nid: str = "nid", level: str = "level") -> DataFrame:
    """Entries to `depth` with the `parent` entry that owns them: the nearest one before with a smaller level (or null)."""
    h = headings.filter(F.col(level).between(1, depth))
    run = Window.partitionBy(doc).orderBy(nid).rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col(level) == k, F.col(nid))).over(run) for k in range(1, depth)]
    named = h.select("*", *(c.alias(f"_p{k}") for k, c in enumerate(last, 1)))
    parent = F.lit(None).cast("long")
    for k in range(2, depth + 1):
        near = F.greatest(F.lit(None).cast("long"), *(F.col(f"_p{j}").cast("long") for j in range(1, k))) if k > 2 else F.col("_p1").cast("long")
        parent = F.when(F.col(level) == k, near).otherwise(parent)
    return named.withColumn("parent", parent).select(*headings.columns, "parent")


def dedup_ids(headings: DataFrame, base: str, doc: str = "doc_id", nid: str = "nid") -> DataFrame:
    """`id`: the base itself, then base-1, base-2 in document order."""
    n = F.row_number().over(Window.partitionBy(doc, base).orderBy(nid)) - 1
    return headings.withColumn("id", F.when(n == 0, F.col(base)).otherwise(F.concat(F.col(base), F.lit("-"), n.cast("string"))))


def slides(blocks: DataFrame, slide_level: int, doc: str = "doc_id", nid: str = "nid") -> DataFrame:
    """`slide`: rules and headings of at most slide_level begin one; a shallower heading stands alone; rules are dropped."""
    w = Window.partitionBy(doc).orderBy(nid)
    heading = F.col("tag") == "Header"
    alone = heading & (F.col("level") < slide_level)
    cut = (F.col("tag") == "HorizontalRule") | (heading & (F.col("level") <= slide_level)) | F.coalesce(F.lag(alone).over(w), F.lit(False))
    marked = blocks.withColumn("_cut", cut.cast("int"))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("slide", F.sum("_cut").over(run)).filter(F.col("tag") != "HorizontalRule").drop("_cut")
