"""Findings F1, F5 of round 3: the themes of batches are found once."""

from guestlens.operators import themes


def test_theme_batches_are_written_once(spark):
    """the branches read what ``reuse`` wrote, not the mentions again."""
    m = spark.createDataFrame([(1, "service", "desk", "criticism", -1, b, 1, 4) for b in (0, 1, 3)],
                              "data_id long, aspect string, term string, polarity string, pol int, batch_id long, first_term long, n_place_batches long")
    written = []

    def reuse(df, name):
        written.append(name)
        return spark.createDataFrame(df.collect(), df.schema)
    out = themes.issue_history(m, 1, reuse)
    assert written == ["theme-batches", "starts"]
    assert sorted(tuple(r)[3:7] for r in out.collect()) == [(1, "opened", 0, 1), (2, "reopened", 3, 3)]
    sizes = spark.createDataFrame([(1, b, 5) for b in range(4)], "data_id long, batch_id long, n long")
    written.clear()
    one = themes.theme_trend(m, sizes, 5, reuse=reuse).collect()
    assert written[:2] == ["theme-batches", "theme-places"]
    assert one == themes.theme_trend(m, sizes, 5).collect()
