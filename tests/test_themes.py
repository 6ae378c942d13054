"""Issue spells and theme trends on hand fixtures and against plain Python."""

import itertools
import math
import random

import pytest

from guestlens.operators import themes

SCHEMA = "data_id long, aspect string, term string, polarity string, pol int, batch_id long, first_term long, n_place_batches long"


def mentions(spark, rows):
    """rows: (place, term, polarity, batch, reviews, batches of the place); a second row per review adds nothing."""
    out = []
    for place, term, polarity, batch, n, nb in rows:
        pol = {"praise": 1, "criticism": -1, "neutral": 0}[polarity]
        out += [(place, "service", term, polarity, pol, batch, first, nb) for _ in range(n) for first in (1, 0)]
    return spark.createDataFrame(out, SCHEMA)


@pytest.mark.parametrize("per_range", [1, 4096])
def test_issue_spells(spark, monkeypatch, per_range):
    monkeypatch.setattr(themes, "BATCHES_PER_RANGE", per_range)
    m = mentions(spark, [(1, "desk", "criticism", b, 1 + b % 2, 12) for b in (0, 1, 4, 5, 6, 9, 11)] +
                 [(1, "desk", "praise", 2, 1, 12), (2, "desk", "criticism", 3, 1, 12), (3, "lift", "criticism", 0, 2, 1)])
    cols = ("data_id", "term", "spell", "event", "first_batch", "last_batch", "n_batches", "n_saying", "n_reviews", "state", "resolved_batch")

    def rows(quiet):
        return sorted(tuple(r) for r in themes.issue_history(m, quiet).select(*cols).collect())
    assert rows(1) == [
        (1, "desk", 1, "opened", 0, 1, 2, 2, 3, "resolved", 2), (1, "desk", 2, "reopened", 4, 6, 3, 3, 4, "resolved", 7),
        (1, "desk", 3, "reopened", 9, 9, 1, 1, 2, "resolved", 10), (1, "desk", 4, "reopened", 11, 11, 1, 1, 2, "open", None),
        (2, "desk", 1, "opened", 3, 3, 1, 1, 1, "resolved", 4), (3, "lift", 1, "opened", 0, 0, 1, 1, 2, "open", None)]
    assert rows(2) == [
        (1, "desk", 1, "opened", 0, 1, 2, 2, 3, "resolved", 2), (1, "desk", 2, "reopened", 4, 6, 3, 3, 4, "resolved", 7),
        (1, "desk", 3, "reopened", 9, 11, 3, 2, 4, "open", None), (2, "desk", 1, "opened", 3, 3, 1, 1, 1, "resolved", 4),
        (3, "lift", 1, "opened", 0, 0, 1, 1, 2, "open", None)]
    assert [r[4:6] for r in rows(20) if r[0] == 1] == [(0, 11)]


def test_quiet_must_be_positive(spark):
    with pytest.raises(ValueError):
        themes.issue_history(mentions(spark, [(1, "a", "criticism", 0, 1, 1)]), quiet=0)


def mann_kendall(xs):
    n = len(xs)
    s = sum((b > a) - (b < a) for a, b in itertools.combinations(xs, 2))
    var = (n * (n - 1) * (2 * n + 5) - sum(t * (t - 1) * (2 * t + 5) for t in (xs.count(v) for v in set(xs)))) / 18
    z = None if var <= 0 else (s - ((s > 0) - (s < 0))) / math.sqrt(var)
    return s, None if z is None else round(z, 3)


@pytest.mark.parametrize("per_range", [2, 4096])
def test_trend_against_all_pairs(spark, monkeypatch, per_range):
    monkeypatch.setattr(themes, "BATCHES_PER_RANGE", per_range)
    rng = random.Random(4)
    rows, sizes, want = [], [], {}
    for place, (nb, size) in enumerate([(1, 7), (2, 7), (9, 7), (25, 7), (40, 7)]):
        n = [size] * (nb - 1) + [rng.randrange(1, size + 1)]
        sizes += [(place, b, x) for b, x in enumerate(n)]
        for term, chance in (("rare", 0.15), ("often", 0.9), ("rising", None), ("falling", None), ("always", None)):
            k = [{"rising": min(n[b], b * 8 // nb), "falling": max(0, min(n[b], 7 - b * 8 // nb)), "always": n[b]}.get(term, rng.randrange(n[b] + 1) if rng.random() < (chance or 0) else 0)
                 for b in range(nb)]
            rows += [(place, term, "neutral", b, x, nb) for b, x in enumerate(k) if x]
            if any(k):
                want[place, term] = (sum(x > 0 for x in k), nb, *mann_kendall([x / y for x, y in zip(k, n)]))
    sizes = spark.createDataFrame(sizes, "data_id long, batch_id long, n long")
    got = {(r.data_id, r.term): (r.n_saying, r.n_place_batches, r.s, r.z, r.sign, r.label) for r in themes.theme_trend(mentions(spark, rows), sizes, 7).collect()}
    assert {k: v[:4] for k, v in got.items()} == want
    assert got[4, "rising"][4:] == (1, "rising") and got[4, "falling"][4:] == (-1, "falling") and got[4, "always"][3:] == (None, 0, "steady")


def test_shares_keep_their_order_for_every_batch_size():
    for size in (1, 2, 3, 5, 15, 30, 50):
        bits = max(1, math.ceil(math.log2(max(2, size * (size - 1)))) + 1)
        shares = sorted({(k / n, math.floor(k * (1 << bits) / n)) for n in range(1, size + 1) for k in range(1, n + 1)})
        assert len({s for _, s in shares}) == len(shares) and [s for _, s in shares] == sorted(s for _, s in shares)
