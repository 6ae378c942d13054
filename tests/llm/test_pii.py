"""Personal data: the base against plain Python, the whole result against its SQL, and what the checks and context decide."""

import hashlib
import random
import re

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from guestlens.llm import pii
from guestlens.llm.oracle import ORACLE

ROWS = [
    (1, "mail a@b.c@d.e or x_y@c.d-e.f_q@z.w. ip 1.2.3.4.5.6.7.8 300.1.1.1 0255.001.2.3 é1.2.3.4"),
    (2, "card 4539 1488 0343 6467 and 4111111111111111; +1 (743) 555-3824 call (743) 555-3824, tel 743-555-3824 or 743-555-3825"),
    (3, None), (4, ""), (None, "a@b.cd"), (None, None), (2, "a@b.cd"), (2, "a@b.cd"),
    (5, "IBAN DE89 3704 0044 0532 0130 00, GB82WEST12345698765432 ÄÖ😀 é+49 30 1234567 ssn 123-45-6789 amex card 378282246310005"),
    (6, "order 743-555-3824, version 1.2.3.4, 378282246310005, 123-45-6789, DE88 3704 0044 0532 0130 00 XDE89370400440532013000"),
    (7, "4111111111111112 4111 1111 1111 1111 4111 1111 1111 1111 +1234567 +12345678 +1(((((( +123456789012345 +1234567890123456"),
    (8, "\n\t" + "x" * 30 + "@y" + ".z" * 400 + " @a.b .@.b a@b..c a@-.-"), (9, "000000255.0.0.0 256.1.1.1 1.1.1.0256 1.2.3 1..2.3.4"),
]


def base_of(text):
    """The contract's base, by the contract's own patterns."""
    text, out = text or "", []
    digits = lambda m: [int(c) for c in m if c in "0123456789"]
    luhn = lambda d: sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0
    for kind, pattern, good in (
            ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
            ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
            ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
            ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15)):
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if good(m.group())]
    return out


def digest_of(doc, text):
    spans = base_of(text)
    listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    return (doc, *(sum(s[0] == k for s in spans) for k in pii.BASE), hashlib.sha256(listed.encode()).hexdigest())


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def noise(seed, n):
    rng = random.Random(seed)
    parts = ["a", "B7", "@", ".", "-", "+", " ", "1", "42", "255", "(", ")", "4111111111111111", "+1 (555) 010-1234", "1.2.3.4", "x@y.z", "é", "😀",
             "call ", "card ", "DE89370400440532013000", "378282246310005", "555-010-1234", "\n", "order "]
    return [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(60)))) for i in range(n)]


def test_base_and_sql(spark):
    rows = ROWS + noise(7, 300)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"spans": F.lit("s"), "base": F.lit(1), "m0": F.lit(2), "id": F.lit(3)})
    out = pii.digest(pii.find(df))
    got = rows_of(out)
    assert sorted((r[:6] for r in got), key=repr) == sorted((digest_of(*r) for r in rows), key=repr)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    assert got == sorted(con.execute(f"SELECT {', '.join(out.columns)} FROM ({ORACLE['op11_pii']})").fetchall(), key=repr)


def test_checks_and_context(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    out = {r.doc_id: r for r in pii.find(df.where("doc_id > 4 or doc_id = 2 and length(text) > 9"), carry=["text"]).collect()}
    more = {i: [(s.kind, s.value) for s in r.spans if not s.base] for i, r in out.items()}
    assert more[2] == [("phone", "(743) 555-3824"), ("phone", "743-555-3824")]
    assert more[5] == [("card", "378282246310005"), ("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82WEST12345698765432"), ("ssn", "123-45-6789")]
    assert more[6] == [] and [s.value for s in out[6].spans] == ["1.2.3.4"]
    assert all(r.text[s.start:s.end] == s.value for r in out.values() for s in r.spans)
    scores = {s.value: s.score for s in out[6].spans + out[2].spans}
    assert scores["1.2.3.4"] == 30 and scores["4539 1488 0343 6467"] == 100


def test_long_text(spark):
    text = lambda n: "9" * n + " " + "a" * n + " " + "1.2.3.4 " * 3000 + "x@y.zz " * 3000 + "5 " * 40_000
    df = spark.createDataFrame([(1, text(1000)), (2, text(300_000))], "doc_id long, text string")
    got = rows_of(pii.digest(pii.find(df)))
    assert got[0][:6] == digest_of(1, text(1000)) and got[1][1:5] == got[0][1:5]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pii.digest(pii.find(df, carry=["text"])).collect() == []
