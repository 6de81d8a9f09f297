"""Queries over scalar operators: escapes, identifiers, numerals, encodings, layout of lines. With their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioflow.functions import text as T

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_char(s: str) -> str:
    return " || ".join(f"chr({ord(c)})" if ord(c) < 32 else sql_text(c) for c in s) if any(ord(c) < 32 for c in s) else sql_text(s)


def sql_chain(expr: str, pairs: T.Pairs) -> str:
    for a, b in pairs:
        expr = f"replace({expr}, {sql_char(a)}, {sql_char(b)})"
    return expr


TITLES = "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages"


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query(f"SELECT doc_id, {sql_chain('text', T.XML)} AS xml, {sql_chain('text', T.XML_ATTR)} AS attr FROM documents")
def escape_xml(spark, sf_dir):
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", T.escape_xml(t).alias("xml"), T.escape_attr(t).alias("attr"))


@query(f"SELECT page_id, {sql_chain('url', T.URI)} AS uri, {sql_chain('html', T.URI)} AS body FROM pages")
def escape_uri(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.escape_uri(F.col("url")).alias("uri"), T.escape_uri(F.col("html")).alias("body"))


@query(f"SELECT doc_id, {sql_chain('text', T.LATEX)} AS latex FROM documents")
def latex_escape(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.replace_all(F.col("text"), T.LATEX).alias("latex"))


@query(f"SELECT doc_id, {sql_chain('text', T.RST)} AS rst FROM documents")
def rst_escape(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.replace_all(F.col("text"), T.RST).alias("rst"))


@query(f"SELECT doc_id, {sql_chain('text', T.MAN)} AS man FROM documents")
def man_escape(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.replace_all(F.col("text"), T.MAN).alias("man"))


@query(f"SELECT doc_id, {sql_chain('text', T.SMART_TO_ASCII)} AS plain, replace(replace(replace(text, '---', chr(8212)), '--', chr(8211)), '...', chr(8230)) AS smart FROM documents")
def smart_punctuation(spark, sf_dir):
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", T.replace_all(t, T.SMART_TO_ASCII).alias("plain"), T.ellipsis(T.dash_runs(t)).alias("smart"))


@query(f"""WITH t AS ({TITLES})
SELECT page_id, regexp_replace(regexp_replace(trim(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}\\s_.-]', '', 'g')), '\\s+', '-', 'g'), '^[^\\p{{L}}]+', '') AS slug FROM t""")
def heading_slugs(spark, sf_dir):
    return titles(spark, sf_dir).select("page_id", T.slug(F.col("title")).alias("slug"))


@query(f"""WITH t AS ({TITLES})
SELECT page_id, regexp_replace(regexp_replace(lower(trim(title)), '[^\\p{{L}}\\p{{N}}\\p{{M}}\\s_-]', '', 'g'), '\\s', '-', 'g') AS slug FROM t""")
def heading_slugs_gfm(spark, sf_dir):
    return titles(spark, sf_dir).select("page_id", T.slug_gfm(F.col("title")).alias("slug"))


_WIDTH = "list_sum(list_transform(string_split(text, ''), lambda c: CASE WHEN c = '' THEN 0 " + " ".join(f"WHEN unicode(c) BETWEEN {a} AND {b} THEN 0" for a, b in T.ZERO) + " " + " ".join(f"WHEN unicode(c) BETWEEN {a} AND {b} THEN 2" for a, b in T.WIDE) + " ELSE 1 END))"


@query(f"SELECT doc_id, CAST({_WIDTH} AS BIGINT) AS columns FROM documents")
def display_width(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.display_width(F.col("text")).cast("long").alias("columns"))


_ROMAN = " || ".join(f"list_extract([{', '.join(sql_text(d) for d in ds)}], CAST(floor(n / {10**k}) % 10 + 1 AS BIGINT))" for k, ds in ((3, ["", "m", "mm", "mmm"]), (2, ["", "c", "cc", "ccc", "cd", "d", "dc", "dcc", "dccc", "cm"]), (1, ["", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"]), (0, ["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"])))
_ALPHA = "CASE WHEN n < 1 THEN CAST(n AS VARCHAR) WHEN n <= 26 THEN chr(CAST(96 + n AS INTEGER)) WHEN n <= 702 THEN chr(CAST(96 + (n - 1) // 26 AS INTEGER)) || chr(CAST(97 + (n - 1) % 26 AS INTEGER)) WHEN n <= 18278 THEN chr(CAST(97 + ((n - 1) // 26 - 1) // 26 - 1 AS INTEGER)) || chr(CAST(97 + ((n - 1) // 26 - 1) % 26 AS INTEGER)) || chr(CAST(97 + (n - 1) % 26 AS INTEGER)) ELSE chr(CAST(97 + (((n - 1) // 26 - 1) // 26 - 1) // 26 - 1 AS INTEGER)) || chr(CAST(97 + (((n - 1) // 26 - 1) // 26 - 1) % 26 AS INTEGER)) || chr(CAST(97 + ((n - 1) // 26 - 1) % 26 AS INTEGER)) || chr(CAST(97 + (n - 1) % 26 AS INTEGER)) END"  # up to four letters: 475,254


@query(f"""WITH k AS (SELECT DISTINCT CAST(o_orderkey AS BIGINT) AS n FROM orders)
SELECT n, CASE WHEN n BETWEEN 1 AND 3999 THEN {_ROMAN} ELSE CAST(n AS VARCHAR) END AS roman,
       CASE WHEN n = 0 THEN '' WHEN n BETWEEN 1 AND 3999 THEN {_ROMAN} ELSE CAST(n AS VARCHAR) END AS roman_pipe,
       {_ALPHA} AS alpha, chr(CAST(96 + n % 26 AS INTEGER)) AS alpha_pipe, '(' || n || ')' AS marker FROM k""")
def numerals(spark, sf_dir):
    k = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("n")).distinct()
    n = F.col("n")
    return k.select("n", T.roman(n).alias("roman"), T.roman(n, zero="empty").alias("roman_pipe"), T.alpha(n).alias("alpha"), T.alpha_pipe(n).alias("alpha_pipe"), T.ordered_marker(n.cast("string"), "both").alias("marker"))


@query("""SELECT doc_id, to_base64(encode(text)) AS b64, sha1(text) AS digest, 'data:text/plain;base64,' || to_base64(encode(text)) AS uri,
       regexp_replace(to_base64(encode(text)), '(.{1,76})', '\\1' || chr(10), 'g') AS mime_lines, decode(from_base64(to_base64(encode(text)))) AS round_trip FROM documents""")
def encodings(spark, sf_dir):
    b = F.col("text").cast("binary")
    return read(spark, sf_dir, "documents").select("doc_id", T.base64_line(b).alias("b64"), F.sha1(b).alias("digest"), T.data_uri(F.lit("text/plain"), b).alias("uri"), T.base64_mime(b).alias("mime_lines"), F.try_to_binary(T.base64_line(b), F.lit("base64")).cast("string").alias("round_trip"))


@query("""SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN x = '' THEN '' WHEN i = 1 THEN '- ' || x ELSE '  ' || x END), chr(10)) AS item,
       array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN x = '' THEN '>' ELSE '> ' || x END), chr(10)) AS quoted FROM documents""")
def indent_and_quote(spark, sf_dir):
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", T.indent_block(t, "- ", "  ").alias("item"), T.quote_block(t).alias("quoted"))


@query("""WITH x AS (SELECT doc_id, text, coalesce(list_max(list_transform(regexp_extract_all(text, '`+'), lambda r: length(r))), 0) AS m FROM documents)
SELECT doc_id, CAST(greatest(m + 1, 3) AS BIGINT) AS fence, repeat('`', m + 1) || CASE WHEN text LIKE '`%' OR text LIKE '%`' THEN ' ' ELSE '' END || text || CASE WHEN text LIKE '`%' OR text LIKE '%`' THEN ' ' ELSE '' END || repeat('`', m + 1) AS span FROM x""")
def code_fences(spark, sf_dir):
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", T.fence_length(t).cast("long").alias("fence"), T.code_span(t).alias("span"))


@query("""WITH e AS (SELECT page_id, list_distinct(regexp_extract_all(html, '&[a-z]+;')) AS names FROM pages)
SELECT p.page_id, """ + sql_chain("html", T.ENTITIES) + """ AS decoded, CAST(len(names) AS BIGINT) AS kinds FROM pages p JOIN e USING (page_id)""")
def html_entity_decode(spark, sf_dir):
    kinds = F.size(F.array_distinct(F.regexp_extract_all("html", F.lit("&[a-z]+;"), F.lit(0)))).cast("long")
    return read(spark, sf_dir, "pages").select("page_id", T.replace_all(F.col("html"), T.ENTITIES).alias("decoded"), kinds.alias("kinds"))


@query(None)
def word_wrap(spark, sf_dir):
    """Greedy filling at 72 columns, a fold over the words (checked against a loop in the tests)."""
    return read(spark, sf_dir, "documents").select("doc_id", T.fill(F.split(T.collapse(F.col("text")), " "), 72).alias("filled"))


@query("""SELECT doc_id, CAST(unnest(range(1, len(string_split(text, chr(10))) + 1)) AS BIGINT) AS line, unnest(string_split(text, chr(10))) AS content FROM documents""")
def doc_lines(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "content")).select("doc_id", (F.col("p") + 1).cast("long").alias("line"), "content")


@query("""WITH l AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, unnest(string_split(text, chr(10))) AS content FROM documents),
p AS (SELECT *, sum(CASE WHEN trim(content) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS para FROM l)
SELECT doc_id, CAST(para AS BIGINT) AS para, CAST(count(*) AS BIGINT) AS lines, CAST(sum(length(content)) AS BIGINT) AS chars FROM p WHERE trim(content) <> '' GROUP BY doc_id, para""")
def doc_paragraphs(spark, sf_dir):
    """A paragraph is a run of lines between blank ones; the blank lines before a line are a running sum over its document."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "content"))
    blank = F.trim("content") == ""
    before = F.sum(F.when(blank, 1).otherwise(0)).over(Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    kept = d.withColumn("para", before.cast("long")).filter(~blank)
    return kept.groupBy("doc_id", "para").agg(F.count("*").alias("lines"), F.sum(F.length("content")).cast("long").alias("chars"))


@query("""SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+'))) AS target FROM documents""")
def autolink_extract(spark, sf_dir):
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), F.lit(0)))
    return read(spark, sf_dir, "documents").filter(F.contains("text", F.lit("@"))).select("doc_id", F.explode(found).alias("target"))


@query("SELECT doc_id, strip_accents(text) AS folded FROM documents")
def ascii_identifiers(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.fold_ascii(F.col("text")).alias("folded"))


@query(f"""SELECT n, translate(CAST(n AS VARCHAR), '{T.DIGITS}', '{T.RAISED}') AS raised, translate(CAST(n AS VARCHAR), '{T.DIGITS}', '{T.LOWERED}') AS lowered, repeat(chr(8212), CAST(n % 20 // 3 AS BIGINT)) || CASE n % 20 % 3 WHEN 2 THEN chr(8211) WHEN 1 THEN '-' ELSE '' END AS dashes
FROM (SELECT DISTINCT CAST(o_custkey AS BIGINT) AS n FROM orders)""")
def script_glyphs(spark, sf_dir):
    k = read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long").alias("n")).distinct()
    s = F.col("n").cast("string")
    return k.select("n", T.raised(s).alias("raised"), T.lowered(s).alias("lowered"), T.dash_thirds(F.col("n") % 20).alias("dashes"))


@query("""SELECT n, CASE WHEN n BETWEEN 1 AND 3999 THEN n END AS value FROM (SELECT DISTINCT CAST(o_orderkey AS BIGINT) AS n FROM orders)""")
def roman_parse(spark, sf_dir):
    """Numerals written and read again; what is no numeral has no value."""
    k = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("n")).distinct()
    return k.select("n", T.roman_value(T.roman(F.col("n"))).cast("long").alias("value"))


@query("""WITH d AS (SELECT p_partkey, p_size, CAST(p_size AS DOUBLE) + 0.5 AS x, list_extract(['in', 'cm', 'mm', 'px', 'pt', 'pc', '%', ''], CAST(p_partkey % 8 + 1 AS BIGINT)) AS u FROM part)
SELECT p_partkey, x AS number, CASE WHEN u = '' THEN 'px' ELSE u END AS unit,
       round(CASE u WHEN 'in' THEN x WHEN 'cm' THEN x / 2.54 WHEN 'mm' THEN x / 25.4 WHEN 'px' THEN x / 96 WHEN '' THEN x / 96 WHEN 'pt' THEN x / 72 WHEN 'pc' THEN x / 6 END, 6) AS inches FROM d""")
def dimensions(spark, sf_dir):
    units = F.array(*map(F.lit, ["in", "cm", "mm", "px", "pt", "pc", "%", ""]))
    p = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), F.lit(".5"), F.element_at(units, (F.col("p_partkey") % 8 + 1).cast("int"))).alias("t"))
    number, unit = T.dimension(F.col("t"))
    return p.select("p_partkey", number.alias("number"), unit.alias("unit")).withColumn("inches", F.round(T.inches(F.col("number"), F.col("unit")), 6))


@query("""SELECT page_id, true AS uri, regexp_extract(url, '^[a-z]+://[^/?#]*', 0) || '/x.png' AS rooted, regexp_extract(url, '^[a-z]+://[^?#]*/', 0) || 'x.png' AS beside FROM pages""")
def url_join(spark, sf_dir):
    u = F.col("url")
    return read(spark, sf_dir, "pages").select("page_id", T.is_uri(u).alias("uri"), T.join_url(u, F.lit("/x.png")).alias("rooted"), T.join_url(u, F.lit("x.png")).alias("beside"))


@query("""SELECT n_nationkey, '[' || rpad(n_name, 20, ' ') || ']' AS l, '[' || lpad(n_name, 20, ' ') || ']' AS r, n_name AS bare FROM nation""")
def block_pipes(spark, sf_dir):
    n = F.col("n_name")
    return read(spark, sf_dir, "nation").select("n_nationkey", T.block_pipe(n, 20, "left", "[", "]").alias("l"), T.block_pipe(n, 20, "right", "[", "]").alias("r"), T.block_pipe(n, 20, "left", "", "").alias("bare"))


@query("""SELECT page_id, url AS decoded FROM pages""")
def percent_round_trip(spark, sf_dir):
    """Every byte of an address percent-encoded and decoded again."""
    u = F.col("url")
    hexed = F.regexp_replace(F.hex(u.cast("binary")), "(..)", "%$1")
    return read(spark, sf_dir, "pages").select("page_id", T.percent_decode(hexed).alias("decoded"))


@query("""SELECT doc_id, regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g') AS clean FROM documents""")
def xml_character_filter(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.xml_chars(F.col("text")).alias("clean"))
