"""Main text of web pages by site style trees.

The pages of a host are merged into one style tree: a node is a path of block elements with their classes, and the text that
stands directly in an element is a node of its own. Importance is an entropy:
* content (text nodes): 1 less the mean entropy of the texts found there over the pages that have them; a text on every page
  has entropy 1, a text on one page 0;
* presentation (elements): the entropy of the sequences of children that an element has;
* composite, bottom-up: (1 - DAMPING^l) presentation + DAMPING^l (mean composite of the children), l sequences of children.
A node's score is its composite importance, pulled towards a weight that the page's author declares: the more pages speak, the
less the declaration counts (see WEIGHTS). A branch goes when it and all below it score less than LEAST; whole DOMs enter the
tree, menus and footers too. Elements that HTML itself defines as no main text (nav, footer, form ...) score DECLARED at
most, whatever their entropy.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm import common

#: A branch goes when nothing in it scores LEAST; DAMPING as above; what HTML declares as no main text scores DECLARED at most.
LEAST, DAMPING, DECLARED = 0.6, 0.9, 0.1
#: Of a path: (weight, pages that it counts for). Nothing said; a class or id that names boilerplate, or text outside the
#: article of a page that marks one; inside the marked article, where scores count double.
WEIGHTS = {"plain": (1.0, 4), "doubt": (0.1, 256), "article": (1.0, 64)}
#: Nested blocks below this depth count as their ancestor at this depth.
DEPTH = 48

# HTML elements by what they do here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body caption dd dt head html li optgroup option tbody td tfoot th thead tr".split()) | frozenset(("li", "dd", "dt"))
NO_TEXT = frozenset("head script style noscript template iframe svg canvas object embed title".split())
NO_ARTICLE = frozenset("select textarea button nav footer aside form dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CUES = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup sidebar widget widgets menu nav navbar navigation breadcrumb breadcrumbs masthead header footer comment comments commentlist respond replies disqus share sharing social related recommended recommendations login search pager pagination toolbar skip".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr",), "tbody": ("thead", "tbody", "tr"), "tfoot": ("tbody", "tr")}
FENCE = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",)}

TOKEN = re.compile(r"""<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][^\s/>]*+)([^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>?""", re.S)
ATTR = re.compile(r"""([^\s=/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"']+))?""")
SPLIT = re.compile(r"[^a-z0-9]+")
TELLING = re.compile(r"class|id|role|hidden|itemprop", re.I)

#: Endings of a style name: what the element is declared as.
NEVER, OUT, DOUBT, ARTICLE, PLAIN = "!", "-", "~", "+", ""


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for k, v in ATTR.findall(raw):
        out.setdefault(k.lower(), entities.unescape(v[1:-1] if v[:1] in "\"'" and v else v))
    return out


_styles: dict[tuple[str, str], tuple[str, str]] = {}


def style(tag: str, raw: str) -> tuple[str, str]:
    """Name and declaration of an element (an article or header is judged by where it stands, too)."""
    if not TELLING.search(raw):
        raw = ""
    known = _styles.get((tag, raw))
    if known:
        return known
    a = attributes(raw) if raw else {}
    role = a.get("role", "").lower()
    classes = a.get("class", "").lower().split()
    cues = {*classes, *SPLIT.split(" ".join((*classes, a.get("id", "").lower())))}
    if tag in NO_TEXT:
        kind = NEVER
    elif tag in NO_ARTICLE or role in ROLES or "hidden" in a:
        kind = OUT
    elif tag not in ("html", "body", "main") and not CUES.isdisjoint(cues):
        kind = DOUBT
    elif tag == "article" or role == "article" or a.get("itemprop", "").lower() == "articlebody":
        kind = ARTICLE
    else:
        kind = PLAIN
    if len(_styles) > 50_000:
        _styles.clear()
    _styles[tag, raw] = out = (".".join((tag, *sorted(classes))).replace("/", "_"), kind)
    return out


class Node:
    """An open element: tag, path in the style tree, whether its text never counts, whether declared out, inside an article."""

    __slots__ = ("tag", "path", "depth", "never", "out", "inside", "children")

    def __init__(self, tag: str, path: str, depth: int, never: bool, out: bool, inside: bool):
        self.tag, self.path, self.depth, self.never, self.out, self.inside = tag, path, depth, never, out, inside
        self.children: list[str] = []


class Page:
    """What a page adds to its site's tree: texts (path, text) in order; of each path its share of children and its sequences."""

    def __init__(self, page: str):
        self.texts: list[tuple[str, str]] = []
        self.edges: dict[str, float] = {}
        self.shapes: dict[tuple[str, str], int] = {}
        self.article = False
        self.read(page)

    def close(self, n: Node) -> None:
        key = (n.path, ",".join(n.children))
        self.shapes[key] = self.shapes.get(key, 0) + 1
        for c in n.children:
            at = f"{n.path}/{c}"
            self.edges[at] = self.edges.get(at, 0.0) + 1 / len(n.children)

    def read(self, page: str) -> None:
        root = Node("", "", 0, False, False, False)
        stack = [root]
        shown = [root]  # the open elements that are nodes of the tree
        text: list[str] = []

        def flush() -> None:
            if text:
                whole = "".join(text)
                text.clear()
                t = " ".join((entities.unescape(whole) if "&" in whole else whole).split())
                if t:
                    n = shown[-1]
                    if not n.never:
                        n.children.append("#")
                        self.texts.append((n.path, t))

        def pop(i: int) -> None:
            while len(stack) > i:
                n = stack.pop()
                if n is shown[-1]:
                    flush()
                    shown.pop()
                    if not n.never:
                        self.close(n)

        at, size = 0, len(page)
        while at < size:
            last = at
            for m in TOKEN.finditer(page, at):
                if m.start() > last:
                    text.append(page[last : m.start()])
                last = m.end()
                tag = m[2] or m[5]
                if not tag:
                    continue
                tag = tag.lower()
                if m[1] or m[4]:
                    if tag in BLOCK:
                        flush()
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i].tag == tag:
                            pop(i)
                            break
                    continue
                raw = m[3] if m[2] else m[6]
                if tag == "br":
                    text.append(" ")
                    continue
                if tag in BLOCK:
                    flush()
                    if tag in CLOSES_P:
                        for i in range(len(stack) - 1, 0, -1):
                            if stack[i].tag == "p":
                                pop(i)
                                break
                            if stack[i].tag in ("table", "td", "th", "button", "caption"):
                                break
                    if tag in SIBLINGS:
                        for i in range(len(stack) - 1, 0, -1):
                            if stack[i].tag in SIBLINGS[tag]:
                                pop(i)
                                if tag not in ("tr", "thead", "tbody", "tfoot"):
                                    break
                            elif stack[i].tag in FENCE[tag]:
                                break
                if tag in VOID or raw.endswith("/") and tag in ("path", "circle", "rect", "use"):
                    continue
                top = shown[-1]
                name, kind = style(tag, raw)
                if kind == ARTICLE and (top.inside or top.out or top.never):
                    kind = PLAIN
                elif kind == PLAIN and tag == "header" and not top.inside:
                    kind = OUT
                if tag in BLOCK and tag not in ("html", "body") or kind:
                    flush()
                    name += kind
                    self.article |= kind == ARTICLE
                    deep = top.depth >= DEPTH
                    if kind != NEVER and not top.never and not deep:
                        top.children.append(name)
                    n = Node(tag, top.path if deep else f"{top.path}/{name}", top.depth + 1, top.never or kind == NEVER, top.out or kind == OUT, top.inside or kind == ARTICLE)
                    shown.append(n)
                else:
                    n = Node(tag, "", 0, False, False, False)
                stack.append(n)
                if tag in RAW:
                    end = re.compile(rf"</{tag}\s*/?>", re.I).search(page, last)
                    at = end.start() if end else size
                    break
            else:
                if last < size:
                    text.append(page[last:])
                break
        flush()
        pop(1)
        flush()
        self.close(root)


def declared(path: str, article: bool) -> str:
    """What the author declares about a path (of a page that marks an article, or not): a key of WEIGHTS, or "out"."""
    inside = False
    doubt = False
    for name in path.split("/"):
        end = name[-1:]
        if end == OUT:
            return "out"
        doubt |= end == DOUBT
        inside |= end == ARTICLE
    return "doubt" if doubt or article and not inside else "article" if inside else "plain"


def host_of(url: str | None) -> str:
    m = re.match(r"\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


#: Rows that a page adds to its site's tree: a text of a path, a sequence of children of it, its share among its siblings.
TEXT, SHAPE, EDGE = 0, 1, 2
PARSED = "uid long, page_id long, url string, host string, sig long, paths array<string>, said array<string>, of array<int>, texts array<string>, f_path array<int>, f_kind array<int>, f_feature array<long>, f_n array<double>"


def parse(pages: DataFrame) -> DataFrame:
    """See PARSED: pages with their paths (a page that marks an article has paths of its own kind: they begin with 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        h = lambda s: xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63)
        uid = TaskContext.get().partitionId() << 40
        names = [x.strip().split()[0] for x in PARSED.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.float64())]
        for b in batches:
            for part, texts in common.text_chunks(b, "html"):
                rows: list[list] = [[] for _ in names]
                for page_id, url, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts, strict=True):
                    p = Page(html or "")
                    first = "1" if p.article else ""
                    number: dict[str, int] = {}
                    said: list[str] = []

                    def at(path: str, number=number, said=said, p=p) -> int:
                        i = number.setdefault(path, len(number))
                        if i == len(said):
                            said.append(declared(path, p.article))
                        return i

                    f = {(at(f"{path}/#"), TEXT, h(t)): 1.0 for path, t in p.texts}
                    f |= {(at(path), SHAPE, h(s)): float(n) for (path, s), n in p.shapes.items()}
                    f |= {(at(path), EDGE, 0): w for path, w in p.edges.items()}
                    kept = [(at(path), t) for path, t in p.texts]
                    kept = [(i, t) for i, t in kept if said[i] != "out"]  # no entropy could raise these
                    keys = list(zip(*f, strict=True)) or [(), (), ()]
                    values = (uid, page_id, url, host_of(url), h(html or ""), [first + x for x in number], said, [i for i, _ in kept], [t for _, t in kept], *keys, list(f.values()))
                    for c, v in zip(rows, values, strict=True):
                        c.append(v)
                    uid += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names)

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, PARSED)


def nodes(parsed: DataFrame) -> DataFrame:
    """host, path, depth, said, m (pages), w (share among siblings), n (elements), l, presentation, content of each path.

    Identical pages of a host count once. On a single page presentation and content are 1.
    """
    f = F.explode(F.arrays_zip("f_path", "f_kind", "f_feature", "f_n")).alias("f")
    at = lambda c: F.element_at(c, F.col("f.f_path") + 1)
    rows = parsed.select("host", "sig", "paths", "said", f).select("host", "sig", at("paths").alias("path"), at("said").alias("said"), F.col("f.f_kind").alias("kind"), F.col("f.f_feature").alias("feature"), F.col("f.f_n").alias("n"))
    rows = rows.groupBy("host", "path", "kind", "feature", "sig").agg(F.max("n").alias("n"), F.max("said").alias("said"))
    each = rows.groupBy("host", "path", "kind", "feature").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.max("said").alias("said"))
    of = lambda kind, c: F.sum(F.when(F.col("kind") == kind, c))
    n = F.col("n")
    t = each.groupBy("host", "path").agg(
        F.max("said").alias("said"),
        of(EDGE, F.col("k")).alias("m"),
        of(EDGE, n).alias("w"),
        of(SHAPE, n).alias("n"),
        of(SHAPE, F.lit(1)).alias("l"),
        of(SHAPE, n * F.log(n)).alias("nlogn"),
        of(TEXT, F.lit(1)).alias("texts"),
        of(TEXT, F.log(F.col("k"))).alias("logs"),
    )
    t = t.withColumn("m", F.coalesce("m", F.lit(1)))
    span = F.log(F.greatest("m", F.lit(2)))
    one = F.col("m") == 1
    presentation = F.when(one, 1.0).otherwise(F.least((F.log("n") - F.col("nlogn") / F.col("n")) / span, F.lit(1.0)))
    content = F.when(F.col("texts").isNotNull(), F.when(one, 1.0).otherwise(1 - F.col("logs") / F.col("texts") / span))
    depth = (F.length("path") - F.length(F.replace("path", F.lit("/")))).alias("depth")
    return t.select("host", "path", depth, "said", "m", F.coalesce("w", F.lit(1.0)).alias("w"), "n", "l", presentation.alias("presentation"), content.alias("content"))


def score_of(said: Column, comp: Column, m: Column) -> Column:
    """Composite importance and declared weight, each by the pages that stand behind it."""
    out = F.least(comp, F.lit(DECLARED))
    for key, (weight, pages) in WEIGHTS.items():
        value = (m * comp + pages * weight) / (m + pages)
        out = F.when(said == key, value * 2 if key == "article" else value).otherwise(out)
    return out


def tree(parsed: DataFrame) -> DataFrame:
    """host, path, m, comp, score, best (largest score of an element in the branch) of every node, bottom-up: one round for each depth."""
    every = common.materialise(nodes(parsed), "style-nodes", clean=False)
    deepest = every.agg(F.max("depth")).first()[0] or 0
    below, levels = None, []
    for d in range(deepest, 0, -1):
        own = every.filter(F.col("depth") == d)
        if below is None:
            own = own.withColumns({"sum": F.lit(None).cast("double"), "most": F.lit(None).cast("double")})
        else:
            own = own.join(below, ["host", "path"], "left")
        damp = F.pow(F.lit(DAMPING), F.coalesce("l", F.lit(1)))
        comp = F.when(F.col("content").isNotNull(), F.col("content")).otherwise((1 - damp) * F.coalesce("presentation", F.lit(1.0)) + damp * F.coalesce(F.col("sum") / F.col("n"), F.lit(0.0)))
        own = own.withColumn("comp", comp)
        own = own.withColumn("score", score_of(F.col("said"), F.col("comp"), F.col("m")))
        own = own.withColumn("best", F.greatest(F.when(F.col("path").endswith("/#"), 0.0).otherwise(F.col("score")), F.coalesce("most", F.lit(0.0))))
        done = common.materialise(own.select("host", "path", "m", "w", "comp", "score", "best"), "style-level", clean=False)
        levels.append(done)
        parent = F.regexp_replace("path", "/[^/]*$", "")
        below = done.groupBy("host", parent.alias("path")).agg(F.sum(F.col("w") * F.col("comp")).alias("sum"), F.max("best").alias("most"))
    if not levels:
        return every.select("host", "path", "m", F.lit(1.0).alias("comp"), F.lit(1.0).alias("score"), F.lit(1.0).alias("best")).limit(0)
    out = common.materialise(reduce(DataFrame.unionByName, levels).drop("w"), "style-tree")
    for x in (every, *levels):
        common.forget(x)
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html).

    Null html gives an empty text; pages without a host (null or odd url) form one site; identical pages of a site count
    once for importance; every row has its result, repeated ones too; columns besides the three are ignored; an empty
    table gives no rows. Every page is parsed once; a page of any length is one row. What goes is joined by (host, path):
    paths that at least one in HOT_SHARE pages has are broadcast, HOT_SHARE times the paths of a page at most.
    """
    parsed = common.materialise(parse(pages), "style-pages")
    low = tree(parsed).filter(F.col("best") < LEAST).select("host", "path")
    mine = parsed.select("uid", "host", F.explode(F.array_distinct(F.transform("of", lambda i: F.element_at("paths", i + 1)))).alias("path"))
    counted = mine.groupBy("host", "path").agg(F.count("*").alias("_n")).join(low, ["host", "path"], "left_semi")
    counted = common.materialise(counted, "style-low")
    limit = max(64, parsed.count() // common.HOT_SHARE)
    # of paths that many pages share there are few: they go to all pages; the others come back to their pages by number
    hot = F.broadcast(counted.filter(F.col("_n") >= limit).groupBy("host").agg(F.collect_list("path").alias("hot")))
    cold = mine.join(counted.filter(F.col("_n") < limit).hint("merge"), ["host", "path"]).groupBy("uid").agg(F.collect_list("path").alias("cold"))
    cold = common.materialise(cold, "style-cold")
    sides = common.marked(parsed.select("uid", "page_id", "url", "host", "paths", "of", "texts"), cold, "uid")
    left = sides.filter("_may").join(cold, "uid", "left").unionByName(sides.filter("NOT _may").withColumn("cold", F.lit(None).cast("array<string>")))
    left = left.join(hot, "host", "left")
    gone = F.transform("paths", lambda p: F.coalesce(F.array_contains("hot", p), F.lit(False)) | F.coalesce(F.array_contains("cold", p), F.lit(False)))
    kept = F.filter("texts", lambda t, i: ~F.element_at("gone", F.element_at("of", i + 1) + 1))
    some = F.col("hot").isNotNull() | F.col("cold").isNotNull()
    text = F.array_join(F.when(some, kept).otherwise(F.col("texts")), "\n")
    return left.withColumn("gone", gone).select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
