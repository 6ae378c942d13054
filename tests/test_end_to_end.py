"""The public API end to end, as in the README example."""

import os

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


def test_readme_flow(spark):
    from guestlens.operators.cache import cache_decisions
    from guestlens.operators.ingest import normalize_reviews, place_header, quarantine
    from guestlens.operators.report import flatten_report
    from guestlens.plans.full import full_analysis
    from guestlens.plans.instant import instant_analysis
    from guestlens.session import work_path
    from guestlens.sources import pages as pg
    from guestlens.sources import standins as st
    from guestlens.sources import store as so

    # 1. land review pages (here built from the stand-in tables) and scan them
    landing = pg.land_pages(pg.build_pages(st.reviews(spark, SF), st.places(spark, SF)),
                            work_path(spark, "e2e-landing"))
    pages = pg.scan_pages(spark, landing)
    reviews, held = quarantine(normalize_reviews(pages))
    header = place_header(pages)

    # 2. skip places already stored, analyse the rest (instant: first 20 reviews)
    root = work_path(spark, "e2e-store")
    requests = header.select("data_id", F.lit("instant").alias("type"))
    todo = cache_decisions(requests, so.read_latest(spark, root) or
                           spark.createDataFrame([], "data_id long, type string")).filter("decision = 'miss'")
    results = instant_analysis(reviews.join(todo.select("data_id"), "data_id", "left_semi"), header,
                               st.TEST_LEXICON, st.TEST_POLARITY)
    assert results.count() == header.count() == 15 and held.count() == 0

    # 3. store the reports as JSON by data_id, then look them up
    writes = results.select("data_id", F.lit("instant").alias("type"),
                            F.to_json(F.struct(*results.columns)).alias("analysis"),
                            F.current_timestamp().cast("timestamp_ntz").alias("written_at"),
                            F.lit(1).cast("long").alias("seq"))
    so.write_version(so.upsert(so.read_latest(spark, root), writes), root)
    found = so.lookup(so.read_latest(spark, root), requests.withColumn("type", F.lit(None).cast("string")))
    assert found.count() == 15

    # 4. full analysis (page cap 150, batches of 15, combine tree) and the report rows
    full, tree = full_analysis(reviews, header, st.TEST_LEXICON, st.TEST_POLARITY)
    assert full.count() == 15 and tree.filter("is_root").count() == 15
    assert flatten_report(results).filter("section = 'Summary'").count() == 15
