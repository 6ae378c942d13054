"""Leftmost-longest phrase matching on hand fixtures and against plain Python with a large vocabulary."""

import random
import re
from collections import Counter, defaultdict

from guestlens.operators import phrases as ph
from guestlens.operators.aspects import NEGATORS

REVIEWS = "data_id long, review_id long, review_text string"
VOCAB = "phrase string, aspect string, sign int"


def clauses(text):
    for c in re.split(r"[.!?;,\n]+|\s+but\s+", (text or "").lower()):
        yield [w for w in re.split(r"[^\w']+|_", c) if w]


def brute(rows, vocab):
    """vocab: phrase -> (aspect, sign)"""
    most = max(len(p.split()) for p in vocab)
    n, reviews = Counter(), defaultdict(set)
    for place, review, text in rows:
        for w in clauses(text):
            at, found = 0, []
            while at < len(w):
                for size in range(min(most, len(w) - at), 0, -1):
                    if (own := vocab.get(" ".join(w[at:at + size]))):
                        found.append((" ".join(w[at:at + size]), own[0], -own[1] if at and w[at - 1] in NEGATORS else own[1]))
                        at += size
                        break
                else:
                    at += 1
            total = sum(s for _, _, s in found)
            label = "praise" if total > 0 else "criticism" if total < 0 else "neutral"
            for phrase, aspect, _ in found:
                if aspect is not None:
                    n[place, aspect, label, phrase] += 1
                    reviews[place, aspect, label, phrase].add(review)
    return {k: (len(reviews[k]), v) for k, v in n.items()}


def feedback(spark, rows, vocab):
    v = ph.vocabulary(spark.createDataFrame(vocab, VOCAB))
    out = ph.phrase_feedback(ph.phrase_matches(spark.createDataFrame(rows, REVIEWS), v))
    return {(r.data_id, r.aspect, r.polarity, r.phrase): (r.n_reviews, r.n_mentions) for r in out.collect()}


def test_leftmost_then_longest(spark):
    vocab = [("front desk", "service", 0), ("Front  Desk clerk", "service", 0), ("desk", "accommodation", 0), ("clerk was rude", "service", -1), ("rude", None, -1),
             ("very clean", None, 1), ("clean", None, 1), ("hot tub", "amenities", 0), ("", "service", 1), (None, "service", 1), ("!!", None, 1)]
    rows = [(1, 1, "The front desk clerk was rude"), (1, 2, "front desk, clerk was rude. front desk front desk"), (1, 3, "hot tub not very clean"),
            (1, 4, "HOT TUB clean but desk rude"), (2, 1, None), (2, 2, ""), (None, 9, "hot tub")]
    assert feedback(spark, rows, vocab) == {
        (1, "service", "criticism", "front desk clerk"): (1, 1),              # the longest from the left; "clerk was rude" overlaps it
        (1, "service", "neutral", "front desk"): (1, 3), (1, "service", "criticism", "clerk was rude"): (1, 1),
        (1, "amenities", "criticism", "hot tub"): (1, 1), (1, "amenities", "praise", "hot tub"): (1, 1),
        (1, "accommodation", "criticism", "desk"): (1, 1), (None, "amenities", "neutral", "hot tub"): (1, 1)}


def test_many_phrases(spark, monkeypatch):
    """50,000 phrases, clauses with more matches than a chunk; the plan does not grow with the vocabulary."""
    monkeypatch.setattr(ph, "CHUNK", 4)
    rng = random.Random(1)
    word = lambda: f"w{min(rng.randrange(400), rng.randrange(400))}"
    vocab = {}
    while len(vocab) < 50_000:
        vocab[" ".join(word() for _ in range(rng.choice([1, 2, 2, 3, 5])))] = (rng.choice(["service", "amenities", None]), rng.choice([-1, 0, 1]))
    rows = [(i % 3, i, " ".join(word() + rng.choice([""] * 12 + [",", " not"]) for _ in range(rng.choice([3, 60, 300])))) for i in range(60)]
    got = feedback(spark, rows, [(p, a, s) for p, (a, s) in vocab.items()])
    assert got == brute(rows, vocab) and len(got) > 1000


def test_plan_is_one_join(spark):
    v = ph.vocabulary(spark.createDataFrame([(f"a{i} b{i}", "service", 1) for i in range(3000)], VOCAB))
    plan = ph.phrase_matches(spark.createDataFrame([(1, 1, "a1 b1")], REVIEWS), v)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "a17" not in plan.replace("LocalRelation", "")[:2000] and "Cartesian" not in plan


def test_no_vocabulary(spark):
    assert feedback(spark, [(1, 1, "front desk")], []) == {}


def test_matches_stay_with_their_review(spark, tmp_path):
    """Texts are dealt once; a clause's matches and a review's mentions need no shuffle of their own."""
    ph.vocabulary(spark.createDataFrame([("a1 b1", "service", 1), ("b1", None, -1)], "phrase string, aspect string, sign int")).write.parquet(str(tmp_path / "v"))
    m = ph.phrase_matches(spark.createDataFrame([(1, 1, "a1 b1 b1. b1 x"), (1, 2, "not a1 b1")], REVIEWS), spark.read.parquet(str(tmp_path / "v")))
    out = ph.phrase_feedback(m)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "REPARTITION_BY_COL" in plan
    assert sorted(tuple(r) for r in out.collect()) == [(1, "service", "criticism", "a1 b1", 1, 1), (1, "service", "neutral", "a1 b1", 1, 1)]
    assert {(r["review_id"], r["clause"], r["clause_sign"]) for r in m.collect()} == {(1, 0, 0.0), (1, 1, -1.0), (2, 0, -1.0)}
