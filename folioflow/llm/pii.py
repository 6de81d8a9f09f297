"""Personal data in texts, with DataFrame functions only.

Regular expressions propose spans; checks confirm them (Luhn sum, mod-97, octets, digit counts); words near a span move its
score. The patterns are written so that Java's matcher does linear work: a match may begin only where the run of its first
class begins or where the last match ended (any later start inside a run would have been found at the run's begin), and
repeats are possessive where the next character cannot belong to the repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: kind, pattern, hint (a text without it has no match), base score, context words (fixed values).
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
_CARD = r"[0-9](?:[ -]?[0-9])++"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_IBAN = r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"
_NATIONAL = r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"

BASE = ("email", "ip", "card", "phone")
KINDS: tuple[tuple[str, str, str, float, str], ...] = (
    ("email", _EMAIL, "@", 0.8, r"mail|contact|write|address|reply|schreib|correo|courriel"),
    ("ip", _IP, ".", 0.5, r"\bip\b|server|host|address|login|adresse|direcci"),
    ("card", _CARD, "", 0.6, r"card|visa|credit|payment|account|karte|tarjeta|carte"),
    ("phone", _PHONE, "+", 0.6, r"phone|call|tel|fax|mobile|ruf|llam|appel"),
    ("iban", _IBAN, "", 0.7, r"iban|account|bank|konto|cuenta|compte"),
    ("national_id", _NATIONAL, "-", 0.2, r"ssn|social|security|tax|\bid\b|number"),
)
#: Characters on either side of a span in which context words count, what they add, and the score that an added kind needs.
NEAR, LIFT, LEAST = 48, 0.3, 0.5
#: Matches that are folded into one array at a time.
RUN = 128


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of at most 20 digits has a Luhn sum divisible by ten."""
    full = F.lpad(d, 20, "0")
    doubled = F.translate(full, "0123456789", "0246813579")
    at = F.sequence(F.lit(1), F.lit(20))
    total = F.aggregate(at, F.lit(0), lambda a, i: a + F.when(i % 2 == 1, F.substr(doubled, i, F.lit(1))).otherwise(F.substr(full, i, F.lit(1))).cast("int"))
    return total % 10 == 0


def mod97(s: Column) -> Column:
    """Whether an account number, blanks removed, leaves 1 when divided by 97 (first four characters moved to the end)."""
    bare = F.replace(s, F.lit(" "))
    turned = F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4)))
    step = lambda a, c: F.when(c.between("0", "9"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c))) == 1


def valid(kind: str, m: Column) -> Column:
    """What the kind's checksum or counts say of a match."""
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.length(F.ltrim(F.lit("0"), p)).between(0, 3) & (F.coalesce(p.try_cast("int"), F.when(F.ltrim(F.lit("0"), p) == "", 0).otherwise(256)) <= 255))
    if kind == "card":
        d = digits(m)
        return F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(digits(m)).between(9, 15)
    if kind == "iban":
        return F.when(F.length(F.replace(m, F.lit(" "))).between(15, 34), mod97(m)).otherwise(False)
    return F.lit(True)


def spans_of(text: Column, kind: str, pattern: str, hint: str, score: float, words: str) -> Column:
    """The valid spans of one kind: array<struct<kind, start, end, score>>, code points, end exclusive.

    Matches are worked through in runs of RUN: a run's spans count from its own begin and are moved to their places when
    the lengths of the runs before are known, so the work grows with the matches, not with their square. Context is what
    stands between this match and its neighbours of the same kind, NEAR characters on either side at most.
    """
    none = F.expr("CAST(array() AS array<struct<kind:string,start:int,end:int,score:double>>)")
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["piece"])
        match = F.coalesce(p["match"], F.lit(""))
        end = start + F.length(match)
        context = F.concat(F.right(p["piece"], F.lit(NEAR)), F.lit(" "), F.left(F.coalesce(p["after"], F.lit("")), F.lit(NEAR)))
        near = F.when(F.lower(context).rlike(words), LIFT).otherwise(0.0)
        value = F.round(F.least(F.lit(score) + near, F.lit(1.0)), 2)
        found = F.array(F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), value.alias("score")))
        ok = (match != "") & valid(kind, match)
        if kind not in BASE:
            ok = ok & (value >= LEAST)
        return F.struct(end.alias("at"), F.when(ok, F.concat(acc["found"], found)).otherwise(acc["found"]).alias("found"))

    zero = F.struct(F.lit(0).alias("at"), none.alias("found"))
    bind = lambda value, f: F.transform(F.array(value), f)[0]  # noqa: E731  evaluates value once

    def placed(runs: Column) -> Column:
        offsets = F.aggregate(runs, F.array(F.lit(0)), lambda acc, r: F.concat(acc, F.array(F.element_at(acc, -1) + r["at"])))
        move = lambda r, by: F.transform(r["found"], lambda x: F.struct(x["kind"].alias("kind"), (x["start"] + by).alias("start"), (x["end"] + by).alias("end"), x["score"].alias("score")))
        return bind(offsets, lambda o: F.flatten(F.transform(runs, lambda r, i: move(r, F.element_at(o, i + 1)))))

    def of(pieces: Column) -> Column:
        # between matches lie the pieces of a split by the same pattern, so running lengths give the places
        pairs = F.arrays_zip(pieces.alias("piece"), matches.alias("match"), F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))).alias("after"))
        starts = lambda p: F.sequence(F.lit(0), F.floor((F.size(p) - 1) / RUN).cast("int"))
        runs = bind(pairs, lambda p: F.transform(starts(p), lambda k: F.aggregate(F.slice(p, k * RUN + 1, F.lit(RUN)), zero, step)))
        return bind(runs, placed)

    spans = bind(F.split(text, pattern, -1), of)
    # most texts have no valid match: a plain search first
    has = text.rlike(pattern)
    if hint:
        has = F.contains(text, F.lit(hint)) & has
    return F.when(has, spans).otherwise(none)


def find(docs: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """docs with `into`: the spans of every kind, base kinds in their order first, then the added ones, each by start.

    A null text has no spans. Base kinds keep every span that passes its check, whatever its score; added kinds (account
    numbers, national ids) need their check and a score of LEAST. Spans of different kinds may overlap. Whole texts of any
    length are searched, and repeated rows each; an empty table gives no rows. No shuffle; all
    other columns pass through, but for `into` and names that begin with _pii_, which are replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    own = [c for c in docs.columns if c != into and not c.startswith("_pii_")]
    kinds = [spans_of(t, *k).alias(f"_pii_{k[0]}") for k in KINDS]
    staged = docs.select(*own, *kinds)
    return staged.select(*own, F.concat(*(F.col(f"_pii_{k[0]}") for k in KINDS)).alias(into))


def render(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by the upper-case kind of its first span, in brackets."""
    ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substr(text, acc["at"] + 1, s["start"] - acc["at"])
        fresh = F.struct(F.greatest(s["end"], acc["at"]).alias("at"), F.concat(acc["out"], F.array(gap, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))).alias("out"))
        return F.when(s["start"] >= acc["at"], fresh).otherwise(F.struct(F.greatest(s["end"], acc["at"]).alias("at"), acc["out"].alias("out")))

    done = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<string>)").alias("out")), step)
    whole = F.struct(done["at"].alias("at"), done["out"].alias("out"))
    return F.when(F.size(spans) == 0, text).otherwise(F.transform(F.array(whole), lambda w: F.concat(F.array_join(w["out"], ""), F.substr(text, w["at"] + 1)))[0])


def digest(found: DataFrame, into: str = "pii") -> DataFrame:
    """Counts, the hash of the base spans, and all spans as text."""
    n = lambda k: F.size(F.filter(F.col(into), lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter(F.col(into), lambda s: s["kind"].isin(*BASE))
    scores = F.array_join(F.transform(F.col(into), lambda s: F.format_number(s["score"], 2)), ",")
    return found.select("doc_id", *(n(k[0]) for k in KINDS), F.sha2(render(base), 256).alias("base_sha256"), render(F.col(into)).alias("spans"), scores.alias("scores"))
