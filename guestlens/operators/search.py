"""Match search queries to places.

Rules: queries of at most 2 characters are not run; missing coordinates
default to the reference's fixed location; only places that have a data_id
are suggestions; an optional exact type filter; at most ``k`` suggestions per
query.  Ranking (ours): title starts with the query, then contains it, then
distance in km (haversine, 3 decimals), then data_id.

Candidates come from a 3-gram inverted index: each query probes only the
places that contain its *rarest* 3-gram (document frequency from a groupBy),
then ``contains`` verifies.  That is an equi-join on the gram - never all
query x place pairs - and each query's top-k is a WindowGroupLimit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Default search location and suggestion count.
DEFAULT_LATITUDE = 9.9185
DEFAULT_LONGITUDE = 76.2558
DEFAULT_K = 5
EARTH_RADIUS_KM = 6371.0


def grams(s: Column, n: int = 3) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - n + 1, F.lit(1))),
                                        lambda i: F.substring(s, i, n)))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dp, dl = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dp / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(a))


def place_search(queries: DataFrame, places: DataFrame, k: int = DEFAULT_K,
                 type_filter: str | None = None) -> DataFrame:
    q = (queries.filter(F.length("q") > 2)
         .select("query_id", F.lower("q").alias("_q"),
                 F.coalesce("latitude", F.lit(DEFAULT_LATITUDE)).alias("_qlat"),
                 F.coalesce("longitude", F.lit(DEFAULT_LONGITUDE)).alias("_qlon")))
    p = places.filter(F.col("data_id").isNotNull())
    if type_filter is not None:
        p = p.filter(F.coalesce(F.col("type"), F.lit("")) == type_filter)
    p = p.withColumn("_t", F.lower(F.coalesce("title", F.lit(""))))
    # Equal texts are searched once.  The index has (gram, place) only, and the places join
    # after the grams have met; sizes are left to the planner and AQE.
    texts = q.select("_q").distinct()
    index = p.select(F.col("data_id").alias("_pd"), F.explode(grams(F.col("_t"))).alias("gram"))
    df = index.groupBy("gram").agg(F.count(F.lit(1)).alias("_df"))
    rare = (texts.select("_q", F.explode(grams(F.col("_q"))).alias("gram")).join(df, "gram").groupBy("_q")
            .agg(F.min_by("gram", F.struct("_df", "gram")).alias("gram")))
    met = rare.join(index, "gram").select("_q", "_pd")
    hits = (met.join(p, F.col("_pd") == F.col("data_id")).filter(F.col("_t").contains(F.col("_q"))).drop("_pd"))
    cand = q.join(hits, "_q")
    cand = cand.select(
        "query_id", "data_id", "title", "type", "address", "latitude", "longitude",
        F.when(F.col("_t").startswith(F.col("_q")), "prefix").otherwise("contains").alias("match"),
        F.round(haversine_km(F.col("_qlat"), F.col("_qlon"), F.col("latitude"), F.col("longitude")), 3)
         .alias("distance_km"))
    w = Window.partitionBy("query_id").orderBy(
        F.when(F.col("match") == "prefix", 0).otherwise(1), "distance_km", "data_id")
    return (cand.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)
            .select("query_id", "rank", "data_id", F.col("title").alias("value"), "type",
                    F.col("address").alias("subtext"), "latitude", "longitude", "match", "distance_km"))
