"""Mined word pairs against plain Python counts."""

import math
import random
import re
from collections import Counter

from guestlens.operators.collocations import collocations, mined_themes

SCHEMA = "data_id long, review_id long, review_text string"


def pairs(text):
    out = []
    for clause in re.split(r"[.!?;,\n]+|\s+but\s+", (text or "").lower()):
        w = [x for x in re.split(r"[^\w']+|_", clause) if x]
        out += list(zip(w, w[1:]))
    return out


def brute(texts, min_count, min_llr):
    n = Counter(p for t in texts for p in pairs(t))
    total, first, second = sum(n.values()), Counter(), Counter()
    for (a, b), k in n.items():
        first[a] += k
        second[b] += k
    out = {}
    for (a, b), k in n.items():
        fa, sb = first[a], second[b]
        cells = [(k, fa, sb), (fa - k, fa, total - sb), (sb - k, total - fa, sb), (total - fa - sb + k, total - fa, total - sb)]
        llr = 2 * sum(x * math.log(x * total / (r * c)) for x, r, c in cells if x)
        if k >= min_count and k * total > fa * sb and round(llr, 3) >= min_llr:
            out[a, b] = (k, fa, sb, round(llr, 3))
    return out


def some(n, seed=2):
    rng = random.Random(seed)
    filler = ["the", "room", "was", "a", "lift", "we", "it's", "bed"]
    fixed = ["front desk", "wasn't working", "Spa Area", "hot tub"]
    return [(i % 5, i, None if i % 17 == 0 else " ".join(rng.choice(fixed if rng.random() < 0.3 else filler) + rng.choice(["", "", ",", ".", " but"]) for _ in range(12)))
            for i in range(n)] + [(9, 900, ""), (9, 901, "front"), (None, 902, "front desk. front desk")]


def test_collocations(spark):
    rows = some(200)
    got = {(r["first"], r["second"]): (r.n, r.n_first, r.n_second, r.llr) for r in collocations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute([t for _, _, t in rows], 5, 10.83)
    assert {("front", "desk"), ("wasn't", "working"), ("spa", "area"), ("hot", "tub")} <= set(got)


def test_themes_per_place(spark):
    rows = some(200)
    got = {(r.data_id, r.theme): r.n_reviews for r in mined_themes(spark.createDataFrame(rows, SCHEMA), known=["tub"]).collect()}
    found = {p for p in brute([t for _, _, t in rows], 5, 10.83) if "tub" not in p}
    want = Counter((place, " ".join(p)) for place, _, t in rows for p in set(pairs(t)) & found)
    assert got == {k: n for k, n in want.items() if n >= 2} and (0, "front desk") in got


def test_no_texts(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert mined_themes(spark.createDataFrame([(1, 1, None)], SCHEMA)).collect() == []


def test_texts_are_gone_through_once(spark):
    """The pairs of places and of all texts come from one count: what mined_themes returns reads no text."""
    from guestlens.operators import collocations as co
    rows = [(1, "big bed big bed. big bed"), (1, "big bed"), (2, "big bed, red sky"), (None, "big bed"), (2, None), (2, "")]
    r = spark.createDataFrame(rows, "data_id long, review_text string")
    counts = {(x["data_id"], x["pair"]): (x["n"], x["n_texts"]) for x in co.pair_counts(r, ["data_id"]).collect()}
    assert counts == {(1, "big bed"): (4, 2), (1, "bed big"): (1, 1), (2, "big bed"): (1, 1), (2, "red sky"): (1, 1), (None, "big bed"): (1, 1)}
    out = co.mined_themes(r, min_count=1, min_llr=0.0)
    assert "regexp_extract_all" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [(x["data_id"], x["theme"], x["n_reviews"]) for x in out.collect()] == [(1, "big bed", 2)]
