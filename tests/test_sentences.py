"""Representative sentences against plain Python, one group at a time."""

import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from guestlens.operators import sentences as sn

LEX = [("bed", "accommodation"), ("desk", "service")]
POL = [("good", 1), ("bad", -1)]
SCHEMA = "data_id long, review_id long, rating double, review_text string"


def grouped(rows):
    """(place, aspect, polarity) -> key -> (sentences, reviews); one clause a sentence in these texts."""
    out = defaultdict(lambda: defaultdict(lambda: (set(), set())))
    for place, review, _, text in rows:
        for s in re.split(r"[.!?\n]+", text or ""):
            w = re.findall(r"[\w']+", s.lower())
            total = sum(dict(POL).get(x, 0) for x in w)
            for aspect in {dict(LEX)[x] for x in w if x in dict(LEX)}:
                own = out[place, aspect, "praise" if total > 0 else "criticism" if total < 0 else "neutral"][" ".join(w)]
                own[0].add(s.strip(" "))
                own[1].add(review)
    return out


def brute(rows, k):
    result = []
    for group, keys in grouped(rows).items():
        tf = {key: Counter(key.split()) for key in keys}
        df = Counter(w for c in tf.values() for w in c)
        idf = {w: math.log(1 + len(keys) / n) for w, n in df.items()}
        vec = {key: {w: n * idf[w] for w, n in c.items()} for key, c in tf.items()}
        centre = {w: idf[w] * sum(len(keys[key][1]) * tf[key][w] for key in keys) for w in idf}
        cos = lambda a, b: round(sum(x * b.get(w, 0) for w, x in a.items()) / (math.hypot(*a.values()) * math.hypot(*b.values())), 6)
        order = sorted(keys, key=lambda key: (-cos(vec[key], centre), -len(keys[key][1]), key))[:sn.CANDIDATES]
        taken = order[:1]
        while len(taken) < min(k, len(order)):
            taken.append(min((c for c in order if c not in taken), key=lambda c: (
                -round(sn.RELEVANCE * cos(vec[c], centre) - (1 - sn.RELEVANCE) * max(cos(vec[c], vec[t]) for t in taken), 6), order.index(c))))
        result += [(*group, i, min(keys[key][0]), len(keys[key][1]), cos(vec[key], centre)) for i, key in enumerate(taken, 1)]
    return sorted(result)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.lit(None).cast("timestamp_ntz"))


def test_against_plain_python(spark):
    rng = random.Random(6)
    part = lambda: " ".join(rng.choice(["the", "bed", "desk", "good", "bad", "was", "soft", "old", "Clerk", "slow"]) for _ in range(rng.randrange(1, 7)))
    rows = [(i % 3, i, 3.0, rng.choice([". ", "! ", "\n"]).join(part() for _ in range(3))) for i in range(150)]
    for k in (1, 4):
        got = sorted(tuple(r) for r in sn.representative_sentences(frame(spark, rows), LEX, POL, k).collect())
        assert got == brute(rows, k)


def test_few_and_no_sentences(spark):
    rows = [(1, 1, 5.0, "Good bed. good  bed!"), (1, 2, 5.0, "GOOD bed"), (2, 3, 1.0, None), (2, 4, 1.0, ""), (2, 5, 1.0, "nothing here")]
    assert [tuple(r) for r in sn.representative_sentences(frame(spark, rows), LEX, POL).collect()] == [(1, "accommodation", "praise", 1, "GOOD bed", 2, 1.0)]


def test_words_travel_without_their_text(spark, monkeypatch):
    """The sentences and their words' weights are written once: no shuffle carries a sentence for each of its words."""
    written = []
    monkeypatch.setattr(sn, "materialize", lambda df, name, keep=sn.materialize: written.append(name) or keep(df, name))
    rows = [(1, i, 3.0, f"good bed good {w}. bad desk") for i, w in enumerate(["old old", "new", "new big"])]
    s = sn.group_sentences(spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.lit(None).cast("timestamp_ntz")), LEX, POL)
    v = sn.sentence_vectors(s)
    assert sorted(written) == ["group-words", "sentences"]
    w = {r["key"]: r for r in v.where(F.col("polarity") == "praise").collect()}
    idf = {x: math.log(1 + 3 / n) for x, n in (("good", 3), ("bed", 3), ("old", 1), ("new", 2), ("big", 1))}
    assert {k: round(x, 9) for k, x in w["good bed good old old"]["weights"].items()} == {x: round(n * idf[x], 9) for x, n in (("good", 2), ("bed", 1), ("old", 2))}
