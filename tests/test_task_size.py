"""Findings F1, F2, F3 of round 3: tasks of bounded size."""

import pytest

from guestlens import session


@pytest.mark.parametrize("given, kept", [("64m", 4 << 20), ("64MB", 4 << 20), ("67108864b", 4 << 20), ("1g", 4 << 20), ("2m", 2 << 20)])
def test_tasks_are_bounded_whatever_the_session_says(spark, given, kept):
    """F1, F2, F3."""
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, given)
        session.configure(spark)
        assert session.size_bytes(spark.conf.get(key)) == kept
        assert session.size_bytes(spark.conf.get("spark.sql.files.maxPartitionBytes")) <= 16 << 20
    finally:
        spark.conf.set(key, before)
