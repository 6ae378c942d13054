"""Personal data in texts (operator 11); DataFrame functions only.

Regular expressions propose spans, checks confirm them, nearby context words adjust the score.
Every kind is found in its own pass over the whole text, leftmost and non-overlapping: the
matches and the gaps between them (the text split at the same pattern) give every position by
prefix sums of their lengths, so no row leaves its task and nothing is shuffled.

=========  =====================================  ==========================================
kind       proposed by                            confirmed by
=========  =====================================  ==========================================
email      local part, @, dotted domain           -
ip         four dotted numbers                    every part at most 255
card       digits, single spaces or hyphens       16 to 19 digits that pass Luhn
phone      + and digits, spaces, ( ) . -          8 to 15 digits
iban       country, check digits, 11 to 30 more   mod 97 is 1; stands alone
card       as above                               13 to 15 digits that pass Luhn; context
phone      3-3-4 digits without +                 stands alone; context
ssn        3-2-4 digits with hyphens              stands alone; context
=========  =====================================  ==========================================

The first four are the *base*: a confirmed match is always returned.  The other four rules are
*added*: they start lower and are returned if their score reaches ``LEAST`` and no base span
overlaps them.  A context word of the kind in the ``BEFORE`` characters before or the ``AFTER``
characters after a span (up to the next match of the rule) adds ``NEAR`` points, a word that tells
of other numbers (order, version, ...) takes as many away.

Defined results: null and empty texts have no spans; repeated rows and null ids are rows like any
others; an empty table gives no rows; other columns are ignored unless carried, and carried
columns named like a result give way to it.  Positions are code points, the end is exclusive.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEFORE, AFTER = 40, 20
NEAR = 30
LEAST = 50
CHUNK = 512                 # entries of one inner prefix sum

# The kinds in the order of the contract, then those that are only added.
KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
BASE = KINDS[:4]

# A run that a match may only start at the first character of, or where the last match ended:
# the same matches, without a new scan from every character of a long run.
_FRESH = r"(?:\G|(?<![{0}]))"
EMAIL = _FRESH.format(r"A-Za-z0-9._%+-") + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = _FRESH.format("0-9") + r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)"
LOCAL = r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"

_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
IP_PARTS = r"^" + r"\.".join([_PART] * 4) + r"$"
NOT_ALONE = r"[0-9A-Za-z+]"

CONTEXT = {
    "email": "email|e-mail|mail|contact|write",
    "ip": "ip|address|host|server|client|login",
    "card": "card|cards|visa|mastercard|amex|credit|debit|payment|paid|cvv",
    "phone": "phone|telephone|tel|call|mobile|cell|fax|whatsapp|sms",
    "iban": "iban|account|bank|transfer|bic|swift",
    "ssn": "ssn|social|security|taxpayer",
}
AGAINST = "version|order|invoice|isbn|issn|serial|sku|section|chapter|id"


class Rule(NamedTuple):
    kind: str
    pattern: str
    score: int              # points of a confirmed match
    base: bool
    valid: object           # of (match, last character before, first character after)


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def luhn(digits: Column) -> Column:
    """Whether the check sum of the digits is a multiple of ten."""
    step = lambda s, c: F.struct(
        (s["total"] + F.when(s["odd"], F.when(F.ascii(c) > 52, (F.ascii(c) - 48) * 2 - 9).otherwise((F.ascii(c) - 48) * 2))
         .otherwise(F.ascii(c) - 48)).alias("total"), (~s["odd"]).alias("odd"))
    start = F.struct(F.lit(0).alias("total"), F.lit(False).alias("odd"))
    return F.aggregate(F.reverse(_characters(digits)), start, step, lambda s: s["total"] % 10 == 0)


def mod97(match: Column) -> Column:
    """Whether the account number, its first four characters last and letters as 10 to 35, is 1 modulo 97."""
    plain = F.replace(match, F.lit(" "))
    moved = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    step = lambda m, c: F.when(F.ascii(c) < 58, (m * 10 + F.ascii(c) - 48) % 97).otherwise((m * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(_characters(moved), F.lit(0), step) == 1


def _card(low: int, high: int):
    def valid(match, left, right):
        digits = digits_of(match)
        return F.when(F.length(digits).between(low, high), luhn(digits)).otherwise(F.lit(False))
    return valid


def _alone(left: Column, right: Column) -> Column:
    return ~left.rlike(NOT_ALONE) & ~right.rlike(NOT_ALONE)


RULES = {
    "email": Rule("email", EMAIL, 90, True, lambda m, a, b: F.lit(True)),
    "ip": Rule("ip", IP, 60, True, lambda m, a, b: m.rlike(IP_PARTS)),
    "card": Rule("card", CARD, 80, True, _card(16, 19)),
    "phone": Rule("phone", PHONE, 60, True, lambda m, a, b: F.length(digits_of(m)).between(8, 15)),
    "iban": Rule("iban", IBAN, 70, False, lambda m, a, b: F.when(_alone(a, b), mod97(m)).otherwise(F.lit(False))),
    "short_card": Rule("card", CARD, 40, False, _card(13, 15)),
    "local_phone": Rule("phone", LOCAL, 30, False, lambda m, a, b: _alone(a, b)),
    "ssn": Rule("ssn", SSN, 30, False, lambda m, a, b: _alone(a, b)),
}


def _sums_before(sizes: Column) -> Column:
    """The sum of the entries before each one.  In pieces of ``CHUNK`` entries, as an array that
    grows entry by entry is copied each time."""
    zero = F.lit(0).cast("long")
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / CHUNK).cast("int")),
                         lambda b: F.slice(sizes, b * CHUNK + 1, F.lit(CHUNK)))
    running = lambda piece, at: F.slice(
        F.aggregate(piece, F.array(at), lambda out, x: F.concat(out, F.array(F.element_at(out, -1) + x))), F.lit(1), F.size(piece))
    total = lambda piece: F.aggregate(piece, zero, lambda s, x: s + x)
    start = F.struct(zero.alias("at"), F.array().cast("array<array<bigint>>").alias("out"))
    return F.aggregate(pieces, start, lambda s, piece: F.struct((s["at"] + total(piece)).alias("at"),
                                                               F.concat(s["out"], F.array(running(piece, s["at"]))).alias("out")),
                       lambda s: F.flatten(s["out"]))


def _folded(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _says(words: str, *texts: Column) -> Column:
    pattern = f"(?:^|[^a-z])(?:{words})(?:$|[^a-z])"
    out = texts[0].rlike(pattern)
    for t in texts[1:]:
        out = out | t.rlike(pattern)
    return out


def _long(text: Column) -> Column:
    return F.coalesce(F.length(text), F.lit(0)).cast("long")


def _proposed(matches: str, gaps: str, before: str) -> Column:
    """Per match: its text and start, and the gap on each side of it.  The arrays are zipped, not
    indexed: the optimizer moves an array's expression into a lambda that names it."""
    zipped = F.arrays_zip(matches, gaps, before, F.slice(gaps, 2, F.size(gaps)))
    return F.filter(F.transform(zipped, lambda z: F.struct(
        z[matches].alias("value"), (z[before] + _long(z[gaps])).alias("start"),
        F.substring(z[gaps], -BEFORE, BEFORE).alias("left"), F.substring(z["3"], 1, AFTER).alias("right"))), lambda p: p["value"].isNotNull())


def _spans(rule: Rule, proposed: Column) -> Column:
    """Confirmed and scored spans; added ones from ``LEAST`` points on."""
    good = F.filter(proposed, lambda p: rule.valid(p["value"], F.substring(p["left"], -1, 1), F.substring(p["right"], 1, 1)))

    def scored(p):
        left, right = _folded(p["left"]), _folded(p["right"])
        score = (F.lit(rule.score) + F.when(_says(CONTEXT[rule.kind], left, right), NEAR).otherwise(0)
                 - F.when(_says(AGAINST, left, right), NEAR).otherwise(0))
        return F.struct(F.lit(KINDS.index(rule.kind)).alias("no"), p["start"].alias("start"),
                        (p["start"] + F.length(p["value"])).alias("end"), F.lit(rule.kind).alias("kind"),
                        p["value"].alias("value"), F.least(score, F.lit(100)).cast("int").alias("score"), F.lit(rule.base).alias("base"))
    out = F.transform(good, scored)
    return out if rule.base else F.filter(out, lambda s: s["score"] >= LEAST)


SPAN = "struct<no:int,start:bigint,end:bigint,kind:string,value:string,score:int,base:boolean>"


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per row of ``df``: id, carried columns and ``spans``, an array of (kind, start, end, value,
    score, base) by kind in the order of ``KINDS``, then start."""
    keep = [c for c in df.columns if c in (carry or []) and c not in (id_col, "spans")]
    rows = df.select(F.col(id_col).alias("id"), F.struct(F.lit(0).alias("_"), *keep).alias("carried"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    patterns = list(dict.fromkeys(r.pattern for r in RULES.values()))
    no = {p: i for i, p in enumerate(patterns)}
    empty = F.array().cast(f"array<{SPAN}>")
    # Each step reads the one before it, so a text is matched once and split only where something matched.
    matched = rows.select("*", *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"m{i}") for p, i in no.items()])
    split = matched.select("id", "carried", *[f"m{i}" for i in no.values()],
                           *[F.when(F.size(f"m{i}") > 0, F.split("text", p, -1)).alias(f"g{i}") for p, i in no.items()])
    sized = split.select("*", *[F.when(F.size(f"m{i}") > 0, F.zip_with(f"g{i}", f"m{i}", lambda g, m: _long(g) + _long(m))).alias(f"s{i}") for i in no.values()])
    summed = sized.select("*", *[F.when(F.size(f"m{i}") > 0, _sums_before(F.col(f"s{i}"))).alias(f"b{i}") for i in no.values()])
    placed = summed.select("id", "carried", *[F.when(F.size(f"m{i}") > 0, _proposed(f"m{i}", f"g{i}", f"b{i}")).alias(f"p{i}") for i in no.values()])
    one = lambda name: F.coalesce(_spans(RULES[name], F.col(f"p{no[RULES[name].pattern]}")).cast(f"array<{SPAN}>"), empty)
    found = placed.select("id", "carried", F.concat(*[one(n) for n, r in RULES.items() if r.base]).alias("base"),
                          F.concat(*[one(n) for n, r in RULES.items() if not r.base]).alias("more"))
    free = F.filter("more", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    spans = F.transform(F.array_sort(F.concat("base", free)), lambda s: s.dropFields("no"))
    return found.select(F.col("id").alias(id_col), *[F.col(f"carried.{c}").alias(c) for c in keep], spans.alias("spans"))


def listed(spans: Column) -> Column:
    """The spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base spans per kind, the digest of the base spans and the list of all spans."""
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(id_col, *[count(k) for k in BASE], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
