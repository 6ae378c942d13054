"""Finding F2 of round 4: a match does not take all matches of its clause along."""

import re

from guestlens.operators import phrases as ph
from tests.test_phrases import REVIEWS, VOCAB, brute, feedback

VOCABULARY = {"desk": ("service", 1), "front desk": ("amenities", -1), "desk desk": (None, 1), "rude": (None, -1)}


def test_exploded_matches_carry_no_list(spark):
    """rows of a clause with n matches took n^2 matches of memory."""
    v = ph.vocabulary(spark.createDataFrame([(p, a, s) for p, (a, s) in VOCABULARY.items()], VOCAB))
    out = ph.phrase_feedback(ph.phrase_matches(spark.createDataFrame([(1, 1, "front desk")], REVIEWS), v))
    plan = out._jdf.queryExecution().sparkPlan().toString()
    matches = re.search(r"Generate explode(?:_outer)?\((_m#\d+)\), \[([^\]]*)\]", plan)
    assert matches and matches[1] not in matches[2], matches


def test_clauses_of_twenty_thousand_words(spark):
    rows = [(1, 1, "desk " * 20_001), (1, 2, "rude front " * 10_000), (2, 3, "front desk " * 10_000 + "not rude"), (2, 4, "rude, desk. rude desk")]
    assert feedback(spark, rows, [(p, a, s) for p, (a, s) in VOCABULARY.items()]) == brute(rows, VOCABULARY)
