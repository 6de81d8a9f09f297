"""Readers, writers, templates, options and the registered queries of the document engine."""

import json
import random
import re

import duckdb
import pytest

import __spark_entry__ as entry
from folioflow import engine
from folioflow.operators import options, template
from folioflow.plans import catalogue
from folioflow.sources import ast, delimited, html, interchange, markdown
from folioflow.writers import layout
from folioflow.writers import text as writers

SF = "/root/testdata/sf0.001"

CASES = [
    ("# A *b*\n", "<h1>A <em>b</em></h1>"),
    ("a\n===\n", "<h1>a</h1>"),
    ("**bold** and __bold__ `x`", "<p><strong>bold</strong> and <strong>bold</strong> <code>x</code></p>"),
    ("*a **b** c*", "<p><em>a <strong>b</strong> c</em></p>"),
    ("***x***", "<p><em><strong>x</strong></em></p>"),
    ("a_b_c", "<p>a_b_c</p>"),
    ("- a\n- b\n", "<ul>\n<li>a</li>\n<li>b</li>\n</ul>"),
    ("- a\n\n- b\n", "<ul>\n<li><p>a</p></li>\n<li><p>b</p></li>\n</ul>"),
    ("3. a\n4. b\n", '<ol start="3" type="1">\n<li>a</li>\n<li>b</li>\n</ol>'),
    ("> q\n> r\n", "<blockquote>\n<p>q r</p>\n</blockquote>"),
    ("```py\nx < 1\n```\n", '<pre class="py"><code>x &lt; 1</code></pre>'),
    ("    code\n\n    more\n", "<pre><code>code\n\nmore</code></pre>"),
    ("***\n", "<hr />"),
    ('[t](/u "x")', '<p><a href="/u" title="x">t</a></p>'),
    ("[t][r] [r]\n\n[R]: /u\n", '<p><a href="/u">t</a> <a href="/u">r</a></p>'),
    ("![a](i.png)", '<p><img src="i.png" alt="a" /></p>'),
    ("a  \nb\\\nc", "<p>a<br />\nb<br />\nc</p>"),
    ("&copy; \\* &lt;", "<p>© * &lt;</p>"),
    ("<b>x</b>", "<p><b>x</b></p>"),
    ("<div>\nx\n</div>\n", "<div>\nx\n</div>"),
    ("[not a link]", "<p>[not a link]</p>"),
    ("", ""),
]


@pytest.mark.parametrize("source,target", CASES)
def test_commonmark_to_html(source, target):
    assert engine.convert_text(source, "commonmark", "html") == target


def test_markdown_extensions():
    h = lambda s, d="markdown": engine.convert_text(s, d, "html", wrap="none")
    assert h("H~2~O x^2^ ~~s~~") == "<p>H<sub>2</sub>O x<sup>2</sup> <del>s</del></p>"
    assert h("# T {#i .c}") == '<h1 id="i" class="c">T</h1>'
    assert h("# Two words") == '<h1 id="two-words">Two words</h1>'
    assert h("# A\n\n# A", "gfm").count('id="a-1"') == 1
    assert "<table>" in h("| a | b |\n|--|:-:|\n| 1 | 2 |") and "text-align: center" in h("| a | b |\n|--|:-:|\n| 1 | 2 |")
    assert h("x[^1]\n\n[^1]: note\n").count("fn1") == 2
    assert h("T\n:   D\n") == "<dl>\n<dt>T</dt>\n<dd>\nD\n</dd>\n</dl>"
    assert h("::: warn\nx\n:::\n") == '<div class="warn">\n<p>x</p>\n</div>'
    assert h("- [x] done\n- [ ] open\n", "gfm").count("checkbox") == 2
    assert "“a” – b…" in h('"a" -- b...')
    assert 'class="uri"' in h("see https://a.b/c.", "gfm")
    assert h("$a+b$").startswith('<p><span class="math inline">')
    assert engine.convert_text("---\ntitle: X y\n---\n\nz", "markdown", "json").count('"title"') == 1


def test_html_reader():
    back = lambda s: engine.convert_text(s, "html", "markdown", wrap="none")
    assert back("<h2>A</h2><p>x <em>y</em><br>z<p>w") == "## A\n\nx *y*\\\nz\n\nw"
    assert back("<ul><li>a<li>b</ul><ol start=3><li>c</ol>") == "- a\n- b\n\n3.  c"
    assert back("<table><tr><th>a<th>b<tr><td>1<td>2</table>") == "| a   | b   |\n|-----|-----|\n| 1   | 2   |"
    assert back('<a href="/x" title="t">l</a> <img src=i.png alt=k>') == '[l](/x "t") ![k](i.png)'
    assert back("<pre><code class=language-py>x\n</code></pre>") == "``` py\nx\n```"
    # an open inline element takes the paragraphs that follow into itself
    doc = html.read("<article><p><b>a<p>b</article>")
    assert len(doc["blocks"]) == 1 and doc["blocks"][0]["c"][0]["t"] == "Strong"
    assert html.read("<title>T</title>x")["meta"]["title"]["c"][0]["c"] == "T"


def random_blocks(rng, depth=0):
    word = lambda: ast.node("Str", rng.choice(["alpha", "beta", "x*y", "1.", "a_b", "<t>", "é", "#"]))

    def inlines(d=0):
        out = []
        for k in range(rng.randrange(1, 5)):
            if k:
                out.append(ast.node("Space"))
            t = rng.choice(["Str", "Str", "Emph", "Strong", "Code", "Link"]) if d < 2 else "Str"
            out.append(word() if t == "Str" else ast.node("Code", [ast.attr(), "c`d"]) if t == "Code" else ast.node("Link", [ast.attr(), inlines(2), ["http://u/v", ""]]) if t == "Link" else ast.node(t, inlines(d + 1)))
        return out

    out = []
    for _ in range(rng.randrange(1, 4)):
        t = rng.choice(["Para", "Header", "CodeBlock", "BlockQuote", "BulletList", "OrderedList", "HorizontalRule"]) if depth < 2 else "Para"
        made = {
            "Para": lambda: ast.node("Para", inlines()),
            "Header": lambda: ast.node("Header", [rng.randrange(1, 6), ast.attr("h"), inlines()]),
            "CodeBlock": lambda: ast.node("CodeBlock", [ast.attr(classes=["py"]), "x\n  y"]),
            "BlockQuote": lambda: ast.node("BlockQuote", random_blocks(rng, depth + 1)),
            "BulletList": lambda: ast.node("BulletList", [random_blocks(rng, depth + 1) for _ in range(2)]),
            "OrderedList": lambda: ast.node("OrderedList", [[2, ast.node("Decimal"), ast.node("Period")], [random_blocks(rng, 2) for _ in range(2)]]),
            "HorizontalRule": lambda: ast.node("HorizontalRule"),
        }[t]()
        out.append(made)
    return out


def test_every_writer_takes_random_trees():
    rng = random.Random(1)
    for _ in range(60):
        doc = ast.document(random_blocks(rng))
        for f in writers.FORMATS:
            assert isinstance(writers.write(doc, f), str)
        assert json.loads(writers.write(doc, "json")) == doc


def test_html_write_then_read_keeps_the_words():
    rng = random.Random(2)
    for _ in range(60):
        doc = ast.document(random_blocks(rng))
        again = html.read(writers.write(doc, "html", wrap="none"))
        texts = lambda d: [n["c"] for n in ast.walk(d["blocks"]) if n["t"] == "Str"]
        assert "".join(texts(doc)) == "".join(texts(again))


def test_commonmark_write_then_read_keeps_simple_documents():
    rng = random.Random(3)
    for _ in range(40):
        words = ["w%d" % rng.randrange(50) for _ in range(rng.randrange(1, 40))]
        doc = ast.document([ast.node("Header", [2, ast.attr(), ast.text_inlines("some head")]), ast.node("Para", ast.text_inlines(" ".join(words))), ast.node("BulletList", [[ast.node("Plain", ast.text_inlines(w))] for w in words[:3]])])
        assert markdown.read(writers.write(doc, "commonmark", wrap="none"), "commonmark") == doc


def test_delimited_records():
    r = delimited.records
    assert r('a,"b ""q"", c",d\r\n1, 2,\n', ",", True) == [["a", 'b "q", c', "d"], ["1", "2", ""]]
    assert r('x"y,z', ",", True) == [['x"y', "z"]]
    assert r('a\t"b\nc', "\t", False) == [["a", '"b'], ["c"]]
    assert r("", ",", True) == [] and r('"a\nb",c', ",", True) == [["a\nb", "c"]]


def test_node_rows_cover_the_tree():
    doc = markdown.read("# A\n\n- b *c*\n\n  d\n")
    rows = interchange.rows_of(1, doc["blocks"])
    assert [r[1] for r in rows] == list(range(len(rows)))
    for r in rows:
        inside = [x for x in rows if r[1] < x[1] <= r[2]]
        assert all(x[4] > r[4] for x in inside)
    with pytest.raises(ValueError):
        interchange.rows_of(1, [{"t": "lower"}])


def test_errors_stay_in_their_row(spark):
    docs = spark.createDataFrame([(1, '{"blocks":[{"t":"Para","c":[{"t":"Str","c":"x"}]}]}'), (2, "{"), (3, None), (4, '{"blocks":[{"t":"Nope"}]}')], "doc_id long, text string")
    got = {r.doc_id: r for r in engine.convert(docs, "json", "plain").collect()}
    assert got[1].output == "x" and got[1].error is None
    assert all(got[k].output is None and got[k].error for k in (2, 3, 4))


def test_templates(spark):
    t = template.parse
    ctx = {"a": "x", "n": 4, "l": ["p", "q"], "m": {"k": "v"}, "yes": True, "no": False, "e": ""}
    cases = {"$a$-$$": "x-$", "${ a }": "x", "$m.k$": "v", "$no$|$yes$": "|true", "$if(e)$1$elseif(a)$2$else$3$endif$": "2", "$for(l)$<$it$>$sep$,$endfor$": "<p>,<q>", "$for(l)$$l$$endfor$": "pq", "$n/roman$ $n/alpha$ $l/length$": "iv d 2", "$a/uppercase$": "X", "$l/reverse$": "qp", "$l/first$$l/last$": "pq", "$for(m/pairs)$$it.key$=$it.value$$endfor$": "k=v", '$a/right 4 "|" "|"$': "|   x|", "$-- c\nz": "z", "$if(a)$\nline\n$endif$\nrest": "line\nrest", "$p()$": "<x>"}
    for source, want in cases.items():
        assert t(source).render(ctx, {"p": "<$a$>\n"}.get) == want, source
    for bad in ("$if(a)$", "$endif$", "$a/nopipe$x", "$ a b $"):
        with pytest.raises(template.TemplateError):
            t(bad).render(ctx)
    from pyspark.sql import functions as F

    made = spark.range(1).select(t("$a/uppercase$$if(no)$n$else$y$endif$$for(l)$[$it$]$sep$;$endfor$").column({"a": F.lit("q"), "no": F.lit(False), "l": F.array(F.lit("1"), F.lit("2"))}).alias("t"))
    assert made.first().t == "Qy[1];[2]"


def test_options():
    assert len(options.NAMES) == 80
    assert "smart" not in options.parse_spec("markdown-smart")[1] and "mark" in options.parse_spec("gfm+mark")[1]
    with pytest.raises(options.UnknownOption):
        options.parse_spec("gfm+nothing")


def test_fill_and_numerals():
    words = "aa bbb cccc dd e " * 5
    out = layout.fill(words.replace(" ", layout.BLANK), 12)
    assert all(len(x) <= 12 for x in out.split("\n")) and " ".join(out.split()) == words.strip()
    assert [layout.numeral(n, "LowerAlpha") for n in (1, 26, 27, 703)] == ["a", "z", "aa", "aaa"]
    assert layout.numeral(1994, "UpperRoman") == "MCMXCIV" and layout.width("日本é") == 5


def test_word_wrap_equals_a_loop(spark):
    for r in spark.read.parquet(f"{SF}/documents.parquet").join(catalogue.QUERIES["word_wrap"](spark, SF), "doc_id").collect():
        lines, col = [], 0
        for w in re.split(r"[ \t\r\n]+", r.text.strip(" \t\r\n")):
            if not w:
                continue
            if lines and col + 1 + len(w) <= 72:
                lines[-1] += " " + w
                col += 1 + len(w)
            else:
                lines.append(w)
                col = len(w)
        assert r.filled == "\n".join(lines)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rounded(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(rounded(r[c]) for c in cols) for r in df.collect()), key=str)
    rel = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = sorted((tuple(rounded(row[names.index(c)]) for c in cols) for row in rel.fetchall()), key=str)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() == 50
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_streaming(spark, tmp_path):
    from folioflow.streaming import stream

    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "*a*"), (2, "# b")], "doc_id long, text string").write.parquet(src)
    q = stream.convert_stream(spark, src, "doc_id long, text string", "commonmark", "html").writeStream.format("memory").queryName("conv").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.output for r in spark.table("conv").collect()) == ["<h1>b</h1>", "<p><em>a</em></p>"]


WIKI = {
    "mediawiki": "== H ==\n'''b''' ''i'' [http://a l] <code>c</code>\n\n* a\n** b\n* c\n",
    "dokuwiki": "===== H =====\n**b** //i// [[http://a|l]] ''c''\n\n  * a\n    * b\n  * c\n",
    "jira": "h2. H\n*b* _i_ [l|http://a] {{c}}\n\n* a\n** b\n* c\n",
    "org": "** H\n*b* /i/ [[http://a][l]] =c=\n\n- a\n  - b\n- c\n",
    "latex": "\\subsection{H}\\textbf{b} \\emph{i} \\href{http://a}{l} \\texttt{c}\n\\begin{itemize}\\item a \\begin{itemize}\\item b\\end{itemize}\\item c\\end{itemize}",
}


@pytest.mark.parametrize("name", sorted(WIKI))
def test_wiki_readers_agree(name):
    assert engine.convert_text(WIKI[name], name, "commonmark") == "## H\n\n**b** *i* [l](http://a) `c`\n\n- a\n  - b\n- c"


@pytest.mark.parametrize("name", ["mediawiki", "dokuwiki", "jira", "org", "latex", "rst", "html", "commonmark", "markdown"])
def test_write_then_read_keeps_the_words(name):
    rng = random.Random(7)
    for _ in range(25):
        words = ["w%d" % rng.randrange(99) for _ in range(rng.randrange(2, 30))]
        doc = ast.document([ast.node("Header", [2, ast.attr(), ast.text_inlines("some head")]), ast.node("Para", [ast.node("Strong", ast.text_inlines(words[0])), ast.node("Space"), *ast.text_inlines(" ".join(words[1:]))]), ast.node("BulletList", [[ast.node("Plain", ast.text_inlines(w))] for w in words[:3]])])
        again = engine.reader(name)(writers.write(doc, name, wrap="none"))
        texts = lambda d: "".join(n["c"] for n in ast.walk(d["blocks"]) if n["t"] == "Str")
        assert texts(again) == texts(doc)


def test_packages_are_deterministic_and_round_trip():
    from folioflow.sources import packages

    doc = markdown.read("# H\n\nA **b** *i* `c` [l](http://u/ü) é😀 {x} \\\\\n\n- a\n\n1. x\n\n| a | b |\n|--|--|\n| 1 | 2 |\n")
    texts = lambda d: "".join(ast.plain([n]) for n in ast.walk(d["blocks"]) if n["t"] in ("Str", "Code"))
    for kind, write in packages.WRITERS.items():
        made = write(doc)
        assert made == write(doc)
        assert texts(packages.READERS[kind](made)).replace("•", "").replace("1.x", "x") == texts(doc), kind
    assert packages.zip_read(packages.zip_write([("a", b"x" * 1000), ("b", b"")])) == {"a": b"x" * 1000, "b": b""}


def test_highlighter_keeps_the_code():
    from folioflow.operators import highlight

    code = 'def f(x):  # c\n    """doc\n    more"""\n    return "s\\n" + 0x1f + 1.5e3\n'
    lines = highlight.highlight("py", code)
    assert "\n".join("".join(t for _, t in line) for line in lines) == code
    assert ("Keyword", "def") in lines[0] and lines[2][0][0] == "VerbatimString"
    assert highlight.highlight("nope", code) is None
    for name in highlight.GRAMMARS:
        assert "\n".join("".join(t for _, t in line) for line in highlight.highlight(name, code)) == code
    assert len(highlight.KINDS) == 31 and "span.kw" in highlight.theme_css()


def test_formulas():
    from folioflow.operators import mathtex

    m = mathtex.to_mathml
    assert "<mfrac><mi>a</mi><mi>b</mi></mfrac>" in m(r"\frac{a}{b}")
    assert "<munderover><mo>∑</mo>" in m(r"\sum_{i=1}^n", True) and "<msubsup>" in m(r"\sum_{i=1}^n")
    assert m(r"\left(\begin{matrix}1&2\\3&4\end{matrix}\right)").count("<mtd>") == 4
    assert "<mroot>" in m(r"\sqrt[3]{x}") and m(r"\nope") is None and m("a^b^c") is None and m("{") is None
    assert [n["t"] for n in mathtex.to_inlines("x^2")] == ["Emph", "Superscript"] and mathtex.to_inlines(r"\frac12") is None


def test_media(spark):
    from folioflow.operators import media

    items = spark.createDataFrame([("a.png", "image/png", b"1"), ("../x", "image/gif", b"2"), ("http://u", "text/plain", b"3")], "name string, mime string, bytes binary")
    by = {r["name"]: r.path for r in media.content_addressed(items).collect()}
    assert by["a.png"] == "a.png" and by["../x"].endswith(".gif") and len(by["http://u"]) == 46
    links = spark.createDataFrame([("a.png",), ("b.png",), ("http://z",)], "url string")
    assert {r.url for r in media.rewrite(links, media.content_addressed(items), "m/").collect()} == {"m/a.png", "b.png", "http://z"}
    assert [r.url for r in media.missing(links, items).collect()] == ["b.png"]
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR\0\0\x01\x02\0\0\0\x07"
    assert tuple(media.image_size(spark.createDataFrame([(png,)], "bytes binary")).select("width", "height").first()) == (258, 7)


def test_constructor_syntax_round_trip():
    from folioflow.writers import native

    rng = random.Random(9)
    for _ in range(60):
        doc = ast.document(random_blocks(rng))
        assert native.read(native.write(doc)) == doc
    rich = markdown.read("| a | b |\n|--|:-:|\n| 1 | *2* |\n\nT\n:   D\n\nx[^1] \"q\" $m$ ![i](u)\n\n[^1]: n\n\n3. a\n4. b\n")
    assert native.read(native.write(rich))["blocks"] == rich["blocks"]
    for bad in ("Para", "[ Para", "[ Para ) ]", "[ ^ ]"):
        with pytest.raises(ValueError):
            native.read(bad)


def test_slides_and_whole_files():
    from folioflow.operators import standalone
    from folioflow.writers import slides

    doc = markdown.read("---\ntitle: T *x*\n---\n\n# S\n\n## A\n\ntext\n\n---\n\nmore\n\n## B\n\n```\nc\n```\n", "markdown")
    assert [k for k, _, _ in slides.segment(doc["blocks"], 2)] == ["section", "frame", "frame", "frame"]
    assert slides.beamer(doc).count("\\begin{frame}") == 3 and "[fragile]" in slides.beamer(doc)
    assert slides.revealjs(doc).count("<section") == 5
    whole = standalone.wrap(doc, "html", with_toc=True, numbered=True, variables={"lang": "en"})
    assert "<title>T x</title>" in whole and 'number="1.1"' in whole and '<a href="#a">A</a>' in whole and whole.startswith("<!DOCTYPE html>\n<html lang=\"en\">")
    assert "\\maketitle" in standalone.wrap(doc, "latex") and standalone.wrap(doc, "plain").startswith("T _x_\n")
    count = standalone.Counter([ast.node("Header", [2, ast.attr(), []])])
    assert [count.next(n, []) for n in (2, 4, 3, 2)] == ["1", "1.0.1", "1.1", "2"] and count.next(2, ["unnumbered"]) is None


def test_drawn_tables_and_citations():
    grid = "+-----+-------+\n| a   | b     |\n+=====+:=====:+\n| 1   | - x   |\n|     | - y   |\n+-----+-------+\n\nTable: cap *c*\n"
    h = engine.convert_text(grid, "markdown", "html", wrap="none")
    assert "<caption>cap <em>c</em></caption>" in h and "<li>y</li>" in h and "text-align: center" in h and h.count("<th") == 3
    simple = "  Right Left     Center\n------- ------ ----------\n     12 12        12\n    123 123       123\n\nNext\n"
    h = engine.convert_text(simple, "markdown", "html", wrap="none")
    assert "text-align: right" in h and "text-align: left" in h and "text-align: center" in h and h.endswith("<p>Next</p>")
    assert engine.convert_text("------- ---\n a      b\n------- ---\n", "markdown", "html").count("<td") == 2
    doc = markdown.read("See [see @a1, p. 3; -@b:c] and @d.")
    cites = [n["c"][0] for n in ast.walk(doc["blocks"]) if n["t"] == "Cite"]
    assert [[x["citationId"] for x in c] for c in cites] == [["a1", "b:c"], ["d"]]
    assert [x["citationMode"]["t"] for c in cites for x in c] == ["NormalCitation", "SuppressAuthor", "AuthorInText"]
    assert writers.write(doc, "markdown") == "See [see @a1, p. 3; -@b:c] and @d."
    assert engine.convert_text("a@b.c [@x](u)", "markdown", "plain") == "a@b.c @x"


def test_metadata():
    from folioflow.sources import metadata

    y = metadata.parse_yaml
    assert y("a: 1\nb:\n  - x\n  - 'y: z'\nc: {k: v, l: [1, 2]}\n") == {"a": "1", "b": ["x", "y: z"], "c": {"k": "v", "l": ["1", "2"]}}
    assert y("t: |\n  one\n  two\n\n  three\nn: >\n  a\n  b\nq: \"x\\n\" # c\nyes: true\n") == {"t": "one\ntwo\n\nthree\n", "n": "a b\n", "q": "x\n", "yes": True}
    assert y("- k: v\n  l: w\n- m\n") == [{"k": "v", "l": "w"}, "m"] and y("# only\n") == {}
    with pytest.raises(ValueError):
        y("a: 1\n  b: 2\n c\n")
    meta = markdown.read("---\ntitle: A *b*\nauthor:\n- X\n- Y\n...\n\nz")["meta"]
    assert meta["title"]["c"][2]["t"] == "Emph" and len(meta["author"]["c"]) == 2
    meta = markdown.read("% T t\n% A; B\n% D\n\nx")["meta"]
    assert [meta[k]["t"] for k in ("title", "author", "date")] == ["MetaInlines", "MetaList", "MetaInlines"]
    assert "basename" in markdown.read("Base Name: x\nKey: y\n\nz", "markdown_mmd")["meta"]
    assert metadata.read('{"a": {"b": [true, "*x*"]}}', markdown.Reader(frozenset(), True).inlines)["a"]["t"] == "MetaMap"
    assert engine.convert_text("[[u|l]]", "markdown+wikilinks_title_after_pipe", "html") == '<p><a href="u" class="wikilink">l</a></p>'


def test_self_contained_pages():
    from folioflow.operators import embed

    files = {"i.png": (b"P", "image/png"), "c/s.css": (b"@import 't.css'; b{background:url(../i.png)} u{background:url(x.png)}", "text/css"), "c/t.css": (b"i{}", "text/css"), "c/x.png": (b"X", "image/png"), "a.js": (b"1", "text/javascript")}
    page = '<link rel=stylesheet href="c/s.css"><img alt="a>b" src=i.png><a href="i.png">l</a><script src=\'a.js\'></script><img src="none.png"><style>p{background:url("i.png")}</style>'
    made = embed.inline_resources(page, files.get)
    assert made.count("data:image/png;base64,UA==") == 2 and 'href="data:text/css;base64,' in made and '<a href="i.png">' in made
    assert 'src="data:text/javascript;base64,MQ=="' in made and 'src="none.png"' in made
    css = embed.inline_css(files["c/s.css"][0].decode(), "c/s.css", files.get)
    assert "url(data:image/png;base64,WA==)" in css and "@import url(data:text/css" in css and "../i.png" in css


def test_simple_tables_hold_every_row_of_part(spark):
    import duckdb

    import __spark_entry__ as entry

    at, name = entry.SMOKE, "simple_tables_part"
    got = sorted(map(tuple, entry.queries()[name](spark, at).collect()))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{at}/part.parquet')")
    assert got == sorted(db.execute(entry.oracle_sql()[name]).fetchall())
    assert sum(r[2].count("\n") - 1 for r in got) == spark.read.parquet(f"{at}/part.parquet").count()


# ---------------------------------------------------------------- bounded work of Python workers


def test_workers_hold_a_bounded_slice_of_a_batch(spark, monkeypatch):
    import gc

    import pyarrow as pa

    from folioflow import batches

    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: f)
    page = "<p>" + "some words <a href='/u'>and a link</a><br>" * 400 + "</p>"
    n = 3 * batches.TEXT_BYTES // len(page)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([page] * n)], ["doc_id", "text"])
    out = list(engine.convert(docs, "html", "json")(iter([batch])))
    assert gc.isenabled()
    assert len(out) >= 3 and [k for b in out for k in b.column(0).to_pylist()] == list(range(n))
    texts = [t for b in out[:1] for t in b.column(1).to_pylist()]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    nodes = list(interchange.flatten_json(docs)(iter([batch])))
    assert max(b.num_rows for b in nodes) <= interchange.NODE_ROWS
    one = len(interchange.rows_of(0, json.loads(texts[0])["blocks"]))
    assert sum(b.num_rows for b in nodes) == one * len(texts) > interchange.NODE_ROWS
    assert [b.num_rows for b in batches.slices(batch, limit=1)] == [1] * len(texts)


def test_node_rows_leave_nothing_for_the_collector():
    import gc

    doc = markdown.read("# A\n\n- b *c*\n\n  d\n")
    gc.collect()
    gc.disable()
    try:
        interchange.rows_of(1, doc["blocks"])
        assert gc.collect() == 0
    finally:
        gc.enable()


def test_html_reader_counts_has_a_row_for_every_page(spark, tmp_path):
    rows = [(1, "<p>a <a href='/u'>b</a><br>c</p><h1>x</h1><ul><li>i</li><li>j</li></ul>".replace("'", '"')), (2, None), (3, ""), (4, "<p></p>"), (5, "<script>var x;</script>")]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = catalogue.QUERIES["html_reader_counts"](spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = db.execute(f"select {', '.join(got.columns)} from ({catalogue.ORACLE_SQL['html_reader_counts']}) order by page_id").fetchall()
    assert sorted(map(tuple, got.collect())) == want


def test_html_reader_counts_at_any_depth(spark, tmp_path):
    unclosed = lambda n: "<p><b>x <a href=\"/u\">y</a><br>z" * n
    rows = [(1, unclosed(129)), (2, unclosed(600)), (3, "<ul><li>a" * 700 + "<h1>t</h1>"), (4, "<div>" * 20000 + unclosed(1)), (5, "<pre>" + "<i>" * 12000 + "c</pre>" + unclosed(2)), (6, "<ul><li>a</li><li>b<ol><li>c</li></ol></li></ul>")]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = catalogue.QUERIES["html_reader_counts"](spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = db.execute(f"select {', '.join(got.columns)} from ({catalogue.ORACLE_SQL['html_reader_counts']}) order by page_id").fetchall()
    assert sorted(map(tuple, got.collect())) == want


def test_json_of_any_depth():
    from folioflow import deep

    x = {"a": [1, None, "é\"\n", {}, [], (True, 2.5)], "b": {"c": "d"}}
    for _ in range(30000):
        x = {"t": "Emph", "c": [x, "y"], "e": {}}
    s = deep.dumps(x)
    assert deep.dumps(deep.loads(s)) == s and s.count("Emph") == 30000
    inner = s[s.index('{"a"') : s.index('"d"}}') + 5]
    assert json.loads(inner) == {"a": [1, None, "é\"\n", {}, [], [True, 2.5]], "b": {"c": "d"}}
    with pytest.raises(ValueError):
        deep.loads("[" * 30000)


def test_alpha_numerals_of_any_key(spark, tmp_path):
    keys = [0, 1, 26, 27, 702, 703, 18278, 18279, 475254, 475255, 1000000, 8999999, 217180147158, 217180147159, 2**53 + 1, 2**63 - 1, None]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.n: r for r in catalogue.QUERIES["numerals"](spark, str(tmp_path)).collect()}
    assert {k: got[k].alpha for k in keys} == {k: None if k is None else layout.alpha(k) or "0" for k in keys}
    db = duckdb.connect()
    db.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    rows = db.execute(f"select n, roman, roman_pipe, alpha, alpha_pipe, marker from ({catalogue.ORACLE_SQL['numerals']}) where n is null or n <= 475254").fetchall()
    assert len(rows) == 10 and all(tuple(got[r[0]]) == r for r in rows)  # the SQL spells four letters at most
