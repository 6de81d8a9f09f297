"""Queries over pages, headings, tables, templates and other document structures, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioflow.functions import text as T
from folioflow.operators import sections
from folioflow.plans.scalars import read, sql_chain, titles, TITLES

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


STRIP = r"(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"
HEAD = r"(?s)<head>.*?</head>"
BOUNDARY = r"</?(?:p|h1|h2|h3|li|ul|ol|nav|div|article|footer|header|body|html|table|tr|blockquote|pre)(?: [^>]*)?>"
TOKEN = r"<[^>]+>|[^<]+"
_BODY = f"regexp_replace(regexp_replace(html, '{STRIP}', '', 'g'), '{HEAD}', '', 'g')"


def body(html):
    return F.regexp_replace(F.regexp_replace(html, STRIP, ""), HEAD, "")


def clean(col):
    return T.collapse(T.replace_all(F.regexp_replace(col, "<[^>]+>", " "), T.ENTITIES))


_CLEAN = "trim(regexp_replace(" + sql_chain("regexp_replace(b, '<[^>]+>', ' ', 'g')", T.ENTITIES) + ", '[ \\t\\r\\n]+', ' ', 'g'))"
_BLOCKS = f"""WITH s AS (SELECT page_id, string_split_regex({_BODY}, '{BOUNDARY}') AS bs FROM pages),
x AS (SELECT page_id, unnest(range(len(bs))) AS i, unnest(bs) AS b FROM s),
t AS (SELECT page_id, i, {_CLEAN} AS txt FROM x)"""


def text_blocks(spark, sf_dir):
    x = read(spark, sf_dir, "pages").select("page_id", F.posexplode(F.split(body(F.col("html")), BOUNDARY, -1)).alias("i", "b"))
    return x.select("page_id", "i", clean(F.col("b")).alias("txt")).filter(F.col("txt") != "")


@query(f"""{_BLOCKS}
SELECT page_id, CAST(count(*) AS BIGINT) AS n_blocks, CAST(sum(length(txt)) AS BIGINT) AS n_chars, CAST(max(length(txt)) AS BIGINT) AS longest FROM t WHERE txt <> '' GROUP BY page_id""")
def html_text_blocks(spark, sf_dir):
    """Blocks are split at block tags, which recovers from unclosed inline tags; the faithful reader is sources.html."""
    n = F.length("txt").cast("long")
    return text_blocks(spark, sf_dir).groupBy("page_id").agg(F.count("*").alias("n_blocks"), F.sum(n).alias("n_chars"), F.max(n).alias("longest"))


@query(f"""{_BLOCKS}
SELECT page_id, string_agg(txt, chr(10) || chr(10) ORDER BY i) AS plain FROM t WHERE txt <> '' GROUP BY page_id""")
def plain_text_projection(spark, sf_dir):
    parts = F.array_sort(F.collect_list(F.struct("i", "txt")))
    return text_blocks(spark, sf_dir).groupBy("page_id").agg(F.array_join(F.transform(parts, lambda p: p["txt"]), "\n\n").alias("plain"))


@query(f"""WITH s AS (SELECT page_id, regexp_extract_all(regexp_replace(html, '{STRIP}', '', 'g'), '{TOKEN}') AS ts FROM pages),
x AS (SELECT page_id, unnest(range(len(ts))) AS pos, unnest(ts) AS token FROM s)
SELECT page_id, CAST(pos AS BIGINT) AS pos, CASE WHEN token LIKE '</%' THEN 'end' WHEN token LIKE '<!%' THEN 'doctype' WHEN token LIKE '<%' THEN 'start' ELSE 'text' END AS kind,
       lower(regexp_extract(token, '^</?([a-zA-Z0-9]+)', 1)) AS name, token FROM x""")
def html_token_stream(spark, sf_dir):
    return tokens(spark, sf_dir).select("page_id", F.col("pos").cast("long").alias("pos"), "kind", "name", "token")


def tokens(spark, sf_dir):
    x = read(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all(F.regexp_replace("html", STRIP, ""), F.lit(TOKEN), F.lit(0))).alias("pos", "token"))
    kind = F.when(F.startswith("token", F.lit("</")), "end").when(F.startswith("token", F.lit("<!")), "doctype").when(F.startswith("token", F.lit("<")), "start").otherwise("text")
    return x.withColumn("kind", kind).withColumn("name", F.lower(F.regexp_extract("token", "^</?([a-zA-Z0-9]+)", 1)))


_TOKENS = f"""WITH s AS (SELECT page_id, regexp_extract_all(regexp_replace(html, '{STRIP}', '', 'g'), '{TOKEN}') AS ts FROM pages),
x AS (SELECT page_id, unnest(range(len(ts))) AS pos, unnest(ts) AS token FROM s),
k AS (SELECT *, CASE WHEN token LIKE '</%' THEN 'end' WHEN token LIKE '<!%' THEN 'doctype' WHEN token LIKE '<%' THEN 'start' ELSE 'text' END AS kind, lower(regexp_extract(token, '^</?([a-zA-Z0-9]+)', 1)) AS name FROM x)"""


@query(f"""{_TOKENS} SELECT name, kind, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT page_id) AS BIGINT) AS pages FROM k WHERE kind IN ('start', 'end') GROUP BY ROLLUP (name, kind)""")
def html_tag_histogram(spark, sf_dir):
    t = tokens(spark, sf_dir).filter(F.col("kind").isin("start", "end"))
    return t.rollup("name", "kind").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("pages"))


@query(f"""{_TOKENS}, d AS (SELECT page_id, sum(CASE WHEN kind = 'start' AND name NOT IN ('meta', 'br', 'b', 'p', 'img', 'link', 'hr', 'input') THEN 1 WHEN kind = 'end' AND name NOT IN ('p', 'b') THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) AS depth FROM k)
SELECT page_id, CAST(max(depth) AS BIGINT) AS deepest, CAST(count(*) AS BIGINT) AS tokens FROM d GROUP BY page_id""")
def html_nesting_depth(spark, sf_dir):
    step = F.when((F.col("kind") == "start") & ~F.col("name").isin("meta", "br", "b", "p", "img", "link", "hr", "input"), 1).when((F.col("kind") == "end") & ~F.col("name").isin("p", "b"), -1).otherwise(0)
    w = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return tokens(spark, sf_dir).select("page_id", F.sum(step).over(w).alias("depth")).groupBy("page_id").agg(F.max("depth").alias("deepest"), F.count("*").alias("tokens"))


LINK = r'(?s)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'


@query(f"""WITH s AS (SELECT page_id, regexp_extract_all({_BODY}, '{LINK}', 1) AS u, regexp_extract_all({_BODY}, '{LINK}', 2) AS t FROM pages)
SELECT page_id, CAST(unnest(range(len(u))) AS BIGINT) AS ord, unnest(u) AS target, unnest(t) AS label FROM s""")
def html_links(spark, sf_dir):
    b = body(F.col("html"))
    pairs = F.arrays_zip(F.regexp_extract_all(b, F.lit(LINK), F.lit(1)).alias("u"), F.regexp_extract_all(b, F.lit(LINK), F.lit(2)).alias("t"))
    x = read(spark, sf_dir, "pages").filter(F.contains("html", F.lit("<a "))).select("page_id", F.posexplode(pairs).alias("ord", "l"))
    return x.select("page_id", F.col("ord").cast("long").alias("ord"), F.col("l.u").alias("target"), F.col("l.t").alias("label"))


@query("""SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, CAST(count(*) AS BIGINT) AS n FROM pages GROUP BY 1 ORDER BY n DESC, host LIMIT 10""")
def html_link_host_topk(spark, sf_dir):
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    return read(spark, sf_dir, "pages").groupBy(host.alias("host")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "host").limit(10)


@query("""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang="([a-z]*)"', 1) AS lang,
       regexp_extract(html, '<meta charset="([^"]*)"', 1) AS charset, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS heading FROM pages""")
def html_title_meta(spark, sf_dir):
    get = lambda p: F.regexp_extract("html", p, 1)
    return read(spark, sf_dir, "pages").select("page_id", get("<title>([^<]*)</title>").alias("title"), get('<html lang="([a-z]*)"').alias("lang"), get('<meta charset="([^"]*)"').alias("charset"), get("(?s)<h1>(.*?)</h1>").alias("heading"))


@query(f"""WITH t AS ({TITLES}), b AS (SELECT page_id, regexp_extract(lower(title), '^([a-z]+)', 1) AS base FROM t),
n AS (SELECT *, row_number() OVER (PARTITION BY page_id % 10, base ORDER BY page_id) - 1 AS k FROM b)
SELECT page_id, CASE WHEN k = 0 THEN base ELSE base || '-' || k END AS id FROM n""")
def heading_id_dedup(spark, sf_dir):
    """Titles of every tenth page count as the headings of one document."""
    t = titles(spark, sf_dir).select("page_id", F.regexp_extract(F.lower("title"), "^([a-z]+)", 1).alias("base"), (F.col("page_id") % 10).alias("doc_id"))
    return sections.dedup_ids(t, "base", nid="page_id").select("page_id", "id")


def headings(spark, sf_dir):
    """An order is a document, its lines are headings in a fixed order; the level comes from the part."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.row_number().over(w).cast("long").alias("nid"), (F.col("l_partkey") % 6 + 1).cast("int").alias("level"))


_H = "h AS (SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS nid, CAST(l_partkey % 6 + 1 AS INTEGER) AS level FROM lineitem)"
_G = ", ".join(f"sum(CASE WHEN level < {k} THEN 1 ELSE 0 END) OVER w AS g{k}" for k in range(1, 7))
_C = ", ".join(f"sum(CASE WHEN level = {k} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, g{k} ORDER BY nid) AS c{k}" for k in range(1, 7))


@query(f"""WITH {_H}, a AS (SELECT *, min(level) OVER (PARTITION BY doc_id) AS base, {_G} FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY nid)), b AS (SELECT *, {_C} FROM a)
SELECT doc_id, nid, level, array_to_string(list_slice([{', '.join(f'CAST(c{k} AS BIGINT)' for k in range(1, 7))}], base, level), '.') AS number FROM b""")
def section_numbers(spark, sf_dir):
    return sections.number_sections(headings(spark, sf_dir))


@query(f"""WITH {_H}, f AS (SELECT * FROM h WHERE level <= 3)
SELECT doc_id, nid, level, (SELECT max(g.nid) FROM f g WHERE g.doc_id = f.doc_id AND g.nid < f.nid AND g.level < f.level) AS parent FROM f""")
def toc_entries(spark, sf_dir):
    return sections.toc(headings(spark, sf_dir))


@query(f"""WITH {_H}, b AS (SELECT doc_id, nid, CASE WHEN level = 6 THEN 'HorizontalRule' WHEN level <= 3 THEN 'Header' ELSE 'Para' END AS tag, level FROM h),
c AS (SELECT *, CASE WHEN tag = 'HorizontalRule' OR (tag = 'Header' AND level <= 2) OR coalesce(lag(tag = 'Header' AND level < 2) OVER (PARTITION BY doc_id ORDER BY nid), false) THEN 1 ELSE 0 END AS cut FROM b),
s AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY nid) AS slide FROM c)
SELECT doc_id, nid, tag, CAST(slide AS BIGINT) AS slide FROM s WHERE tag <> 'HorizontalRule'""")
def slide_segmentation(spark, sf_dir):
    tag = F.when(F.col("level") == 6, "HorizontalRule").when(F.col("level") <= 3, "Header").otherwise("Para")
    return sections.slides(headings(spark, sf_dir).withColumn("tag", tag), 2).select("doc_id", "nid", "tag", F.col("slide").cast("long").alias("slide"))


@query("""WITH w AS (SELECT CAST(greatest(max(length(n_name)), 4) AS INTEGER) AS a, CAST(greatest(max(length(CAST(n_nationkey AS VARCHAR))), 3) AS INTEGER) AS b FROM nation)
SELECT '| ' || rpad('name', a, ' ') || ' | ' || lpad('key', b, ' ') || ' |' || chr(10) || '|' || repeat('-', a + 2) || '|' || repeat('-', b + 1) || ':|' || chr(10) ||
  (SELECT string_agg('| ' || rpad(n_name, a, ' ') || ' | ' || lpad(CAST(n_nationkey AS VARCHAR), b, ' ') || ' |', chr(10) ORDER BY n_nationkey) FROM nation, w) AS tbl FROM w""")
def pipe_table_nation(spark, sf_dir):
    from folioflow.operators import tables

    return tables.pipe_table(read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("string").alias("key")), ["name", "key"], ["left", "right"], F.col("key").cast("int"))


@query("""SELECT '<table>' || chr(10) || '<thead>' || chr(10) || '<tr><th>r_regionkey</th><th>r_name</th></tr>' || chr(10) || '</thead>' || chr(10) || '<tbody>' || chr(10) ||
 string_agg('<tr><td>' || r_regionkey || '</td><td>' || r_name || '</td></tr>', chr(10) ORDER BY r_regionkey) || chr(10) || '</tbody>' || chr(10) || '</table>' AS tbl FROM region""")
def html_table_region(spark, sf_dir):
    from folioflow.operators import tables

    return tables.html_table(read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string"), "r_name"), ["r_regionkey", "r_name"], F.col("r_regionkey").cast("int"))


@query("""WITH w AS (SELECT p_brand, p_size, CAST(greatest(max(length(p_name)), 4) AS INTEGER) AS a, CAST(greatest(max(length(p_type)), 4) AS INTEGER) AS b FROM part GROUP BY ALL)
SELECT p_brand, p_size, rpad('name', any_value(a), ' ') || '  ' || rpad('type', any_value(b), ' ') || chr(10) || repeat('-', any_value(a)) || '  ' || repeat('-', any_value(b)) || chr(10) ||
 string_agg(rpad(p_name, a, ' ') || '  ' || rpad(p_type, b, ' '), chr(10) ORDER BY p_partkey) AS tbl FROM part JOIN w USING (p_brand, p_size) GROUP BY p_brand, p_size""")
def simple_tables_part(spark, sf_dir):
    """The whole table: a text table for each brand and size."""
    from folioflow.operators import tables

    p = read(spark, sf_dir, "part").select("p_brand", "p_size", F.col("p_name").alias("name"), F.col("p_type").alias("type"), "p_partkey")
    return tables.simple_table(p, ["name", "type"], F.col("p_partkey"), ["p_brand", "p_size"])


@query("""SELECT s_suppkey AS id, s_name AS name, CAST(s_nationkey AS VARCHAR) AS nation FROM supplier""")
def csv_parse_roundtrip(spark, sf_dir):
    """Rows are written as CSV texts (one a nation) and read back by the CSV reader."""
    from folioflow.sources import delimited

    s = read(spark, sf_dir, "supplier")
    line = F.concat(F.lit('"'), F.replace(F.col("s_suppkey").cast("string"), F.lit('"'), F.lit('""')), F.lit('","'), F.replace("s_name", F.lit('"'), F.lit('""')), F.lit('",'), F.col("s_nationkey").cast("string"))
    texts = s.groupBy(F.col("s_nationkey").alias("doc_id")).agg(F.concat(F.lit("id,name,nation\n"), F.array_join(F.collect_list(line), "\n")).alias("text"))
    rows = delimited.read_cells(texts, ",", True).filter("row > 0").groupBy("doc_id", "row").agg(*(F.max(F.when(F.col("col") == k, F.col("cell"))).alias(c) for k, c in enumerate(("id", "name", "nation"))))
    return rows.select(F.col("id").cast("long").alias("id"), "name", "nation")


@query("""SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer""")
def tsv_parse_roundtrip(spark, sf_dir):
    from folioflow.sources import delimited

    c = read(spark, sf_dir, "customer")
    line = F.concat_ws("\t", F.col("c_custkey").cast("string"), "c_name", "c_mktsegment")
    texts = c.groupBy(F.col("c_nationkey").alias("doc_id")).agg(F.concat(F.lit("id\tname\tsegment\n"), F.array_join(F.collect_list(line), "\n")).alias("text"))
    rows = delimited.read_cells(texts, "\t", False).filter("row > 0").groupBy("doc_id", "row").agg(*(F.max(F.when(F.col("col") == k, F.col("cell"))).alias(x) for k, x in enumerate(("id", "name", "segment"))))
    return rows.select(F.col("id").cast("long").alias("id"), "name", "segment")


@query("""SELECT c_custkey, 'Dear ' || c_name || CASE WHEN c_acctbal < 0 THEN ' (overdrawn)' ELSE '' END || ', greetings to ' || upper(n_name) || '.' AS letter FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def template_render_letter(spark, sf_dir):
    from folioflow.operators import template

    t = template.parse("Dear $name$$if(overdrawn)$ (overdrawn)$endif$, greetings to $nation/uppercase$.")
    c = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select("c_custkey", t.column({"name": F.col("c_name"), "overdrawn": F.col("c_acctbal") < 0, "nation": F.col("n_name")}).alias("letter"))


@query("""SELECT conv_id, string_agg('**' || role || ':** ' || replace(text, chr(10), '  ' || chr(10)), chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id""")
def conversation_to_markdown(spark, sf_dir):
    line = F.concat(F.lit("**"), "role", F.lit(":** "), F.replace("text", F.lit("\n"), F.lit("  \n")))
    parts = F.array_sort(F.collect_list(F.struct("turn", line.alias("t"))))
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n\n").alias("markdown"))


@query("""WITH d AS (SELECT conv_id, role AS k, 'default' AS v FROM conversations WHERE turn = 0), x AS (SELECT conv_id, role AS k, max(text) AS v FROM conversations GROUP BY 1, 2), o AS (SELECT conv_id, 'assistant' AS k, 'override' AS v FROM conversations WHERE turn = 1)
SELECT conv_id, k, coalesce(max(o.v), max(x.v), max(d.v)) AS v FROM d FULL JOIN x USING (conv_id, k) FULL JOIN o USING (conv_id, k) GROUP BY conv_id, k""")
def metadata_merge(spark, sf_dir):
    """Layers of metadata: defaults, then the document's, then overrides; a later layer replaces a whole key."""
    c = read(spark, sf_dir, "conversations")
    layers = [c.filter("turn = 0").select("conv_id", F.col("role").alias("k"), F.lit("default").alias("v"), F.lit(0).alias("layer")), c.groupBy("conv_id", F.col("role").alias("k")).agg(F.max("text").alias("v")).withColumn("layer", F.lit(1)), c.filter("turn = 1").select("conv_id", F.lit("assistant").alias("k"), F.lit("override").alias("v"), F.lit(2).alias("layer"))]
    every = layers[0].unionByName(layers[1]).unionByName(layers[2])
    return every.groupBy("conv_id", "k").agg(F.max_by("v", "layer").alias("v"))


@query("""WITH m AS (SELECT DISTINCT sha1(text) || '.plain' AS name, length(text) AS n FROM documents)
SELECT name, CAST(n AS BIGINT) AS n FROM m WHERE name NOT IN (SELECT sha1(text) || '.plain' FROM conversations)""")
def media_dedup_content_address(spark, sf_dir):
    """Items named by content, each once, without those that the bag already holds."""
    d = read(spark, sf_dir, "documents")
    name = T.content_name(F.lit("text/plain"), F.col("text").cast("binary"))
    held = read(spark, sf_dir, "conversations").select(name.alias("name")).distinct()
    return d.select(name.alias("name"), F.length("text").cast("long").alias("n")).dropDuplicates(["name"]).join(held, "name", "left_anti")


@query("""WITH refs AS (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS label FROM orders), defs AS (SELECT CAST(s_suppkey AS VARCHAR) AS label, s_name AS url, 0 AS prio FROM supplier UNION ALL SELECT CAST(n_nationkey AS VARCHAR), n_name, 1 FROM nation),
d AS (SELECT label, url FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY prio, url) AS r FROM defs) WHERE r = 1)
SELECT o_orderkey, coalesce(url, '[' || refs.label || ']') AS target FROM refs LEFT JOIN d ON refs.label = d.label""")
def reference_resolution(spark, sf_dir):
    """Explicit definitions win over implicit ones; unresolved references stay literal."""
    refs = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("label"))
    a = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("label"), F.struct(F.lit(0).alias("prio"), F.col("s_name").alias("url")).alias("d"))
    b = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("label"), F.struct(F.lit(1).alias("prio"), F.col("n_name").alias("url")).alias("d"))
    defs = a.unionByName(b).groupBy("label").agg(F.min("d").alias("d"))
    return refs.join(defs, "label", "left").select("o_orderkey", F.coalesce("d.url", F.concat(F.lit("["), "label", F.lit("]"))).alias("target"))


@query("""WITH f AS (SELECT l_orderkey, l_partkey, min(l_linenumber) AS first FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, l_partkey, CAST(dense_rank() OVER (PARTITION BY l_orderkey ORDER BY first, l_partkey) AS BIGINT) AS example FROM f""")
def example_numbering(spark, sf_dir):
    f = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("first"))
    return f.select("l_orderkey", "l_partkey", F.dense_rank().over(Window.partitionBy("l_orderkey").orderBy("first", "l_partkey")).cast("long").alias("example"))


@query("""SELECT doc_id, json_object('t', 'Para', 'c', [json_object('t', 'Str', 'c', text)]) ->> '$.c[0].c' AS text, CAST(1 + len(string_split(text, chr(10))) AS BIGINT) AS nodes FROM documents""")
def json_ast_flatten(spark, sf_dir):
    """Documents become interchange JSON (a Para for each, a Str for each line) and nodes again."""
    from folioflow.sources import interchange

    d = read(spark, sf_dir, "documents")
    inlines = F.transform(F.split("text", "\n"), lambda x: F.struct(F.lit("Str").alias("t"), x.alias("c")))
    ast = d.select("doc_id", F.to_json(F.struct(F.array(F.struct(F.lit("Para").alias("t"), inlines.alias("c"))).alias("blocks"))).alias("text"))
    nodes = interchange.flatten_json(ast)
    parts = F.array_sort(F.collect_list(F.when(F.col("tag") == "Str", F.struct("nid", "text"))))
    return nodes.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"), F.count("*").alias("nodes"))


@query(f"""WITH s AS (SELECT page_id, {_BODY} AS b FROM pages)
SELECT page_id, CAST(len(regexp_extract_all(b, '<a\\s[^>]*href=')) AS BIGINT) AS links, CAST(len(regexp_extract_all(b, '<h1>')) AS BIGINT) AS headings, CAST(len(regexp_extract_all(b, '<li>')) AS BIGINT) AS items, CAST(len(regexp_extract_all(b, '<br>')) AS BIGINT) AS breaks FROM s""")
def html_reader_counts(spark, sf_dir):
    """The full HTML reader to interchange JSON and node rows; node counts by tag."""
    from folioflow import engine
    from folioflow.sources import interchange

    pages = read(spark, sf_dir, "pages")
    p = engine.convert(pages.filter(F.col("html").isNotNull()), "html", "json", key="page_id", text="html")
    nodes = interchange.flatten_json(p.select(F.col("page_id").alias("doc_id"), F.coalesce("output", "error").alias("text")), ("doc_id", "tag", "items"))
    # a row for every page: one may have no node
    marks = pages.select("page_id", F.when(F.col("html").isNull(), "Error").otherwise("Page").alias("tag"), F.lit(0).alias("items"))
    every = nodes.select(F.col("doc_id").alias("page_id"), "tag", "items").unionByName(marks).groupBy("page_id")
    n = lambda t: F.count_if(F.col("tag") == t)
    counts = every.agg(n("Error").alias("failed"), n("Link").alias("links"), n("Header").alias("headings"), F.sum("items").alias("items"), n("LineBreak").alias("breaks"))
    # pages without html or beyond the reader have no counts
    return counts.select("page_id", *[F.when(F.col("failed") == 0, F.col(c)).alias(c) for c in ("links", "headings", "items", "breaks")])


@query("""SELECT conv_id, turn, 1 AS ok FROM conversations""")
def markdown_round_trip(spark, sf_dir):
    """Texts written as Markdown and read back give the same plain text."""
    from folioflow import engine

    c = read(spark, sf_dir, "conversations").withColumn("key", F.concat_ws(":", "conv_id", "turn"))
    a = engine.convert(c, "plain", "markdown", key="key", wrap="none")
    b = engine.convert(a, "markdown", "plain", key="key", text="output", wrap="none")
    d = engine.convert(c, "plain", "plain", key="key", wrap="none")
    same = b.select("key", F.col("output").alias("x")).join(d.select("key", F.col("output").alias("y")), "key")
    parts = F.split("key", ":")
    return same.select(parts[0].cast("long").alias("conv_id"), parts[1].cast("long").alias("turn"), F.when(F.col("x") == F.col("y"), 1).otherwise(0).alias("ok"))


def _written(target):
    def f(spark, sf_dir):
        from folioflow import engine

        return engine.convert(read(spark, sf_dir, "pages"), "html", target, key="page_id", text="html").select("page_id", "output", "error")

    f.__name__ = f"html_to_{target}"
    f.__doc__ = f"Every page through the HTML reader and the {target} writer (checked by tests; SQL cannot express it)."
    return f


for _t in ("html", "html4", "plain", "commonmark", "commonmark_x", "gfm", "markdown", "markdown_github", "markdown_phpextra", "markdown_mmd", "markdown_strict", "latex", "rst", "mediawiki", "dokuwiki", "jira", "org", "asciidoc", "man", "typst", "json", "native", "opml", "ipynb", "beamer", "revealjs"):
    QUERIES[f"html_to_{_t}"] = _written(_t)


def _packed(kind):
    def f(spark, sf_dir):
        from folioflow import engine
        from folioflow.sources import packages

        pages = read(spark, sf_dir, "pages")
        docs = engine.convert(pages, "html", "json", key="page_id", text="html").select("page_id", F.col("output").alias("text"))
        back = packages.unpack(packages.pack(docs, kind, key="page_id"), kind, key="page_id").select("page_id", "text")
        words = lambda d: engine.convert(d, "json", "plain", key="page_id", wrap="none").select("page_id", F.regexp_replace(F.lower("output"), r"[^\p{L}]+", " ").alias("w"))
        both = words(docs).withColumnRenamed("w", "a").join(words(back).withColumnRenamed("w", "b"), "page_id")
        return both.select("page_id", F.when(F.trim("a") == F.trim("b"), 1).otherwise(0).alias("ok"))

    f.__name__ = f"{kind}_round_trip"
    f.__doc__ = f"Every page packed as {kind} and unpacked: the words stay."
    return f


for _k in ("epub", "docx", "odt", "rtf"):
    QUERIES[f"{_k}_round_trip"] = _packed(_k)
    ORACLE_SQL[f"{_k}_round_trip"] = "SELECT page_id, 1 AS ok FROM pages"


@query("""SELECT turn, CAST(count(*) AS BIGINT) AS texts, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY turn""")
def highlight_keywords(spark, sf_dir):
    """Texts as toy code through the highlighter: its tokens make up the text again."""
    from folioflow.operators import highlight

    c = read(spark, sf_dir, "conversations").withColumn("key", F.concat_ws(":", "conv_id", "turn"))
    t = highlight.tokens(c, "python", key="key")
    chars = t.groupBy("key").agg(F.sum(F.length("text")).alias("n"), F.max("line").alias("ends"))
    lines = c.select("key", "turn", (F.size(F.split("text", "\n")) - 1).alias("breaks"))
    return lines.join(chars, "key", "left").groupBy("turn").agg(F.count("*").alias("texts"), F.sum(F.coalesce("n", F.lit(0)) + F.col("breaks")).cast("long").alias("chars"))


@query("""SELECT page_id, url LIKE 'http%' AS remote, sha1(url) || '.png' AS path FROM pages""")
def media_paths(spark, sf_dir):
    from folioflow.operators import media

    m = read(spark, sf_dir, "pages").select("page_id", F.col("url").alias("name"), F.lit("image/png").alias("mime"), F.col("url").cast("binary").alias("bytes"))
    return media.content_addressed(m).select("page_id", F.startswith("name", F.lit("http")).alias("remote"), "path")


@query("""SELECT doc_id, text AS payload FROM documents""")
def data_uri_decode(spark, sf_dir):
    """Every document as a data address and back."""
    from folioflow.operators import media

    u = read(spark, sf_dir, "documents").select("doc_id", T.data_uri(F.lit("text/plain"), F.col("text").cast("binary")).alias("url"))
    return media.from_data_uris(u).select("doc_id", F.col("bytes").cast("string").alias("payload"))
