"""L1-L4: optional batch model calls through a user-supplied function.

L1 builds one request per batch, L2 one per combine node, L4 runs the user's
analyzer over the requests with ``mapInPandas`` (Arrow batches, the callable
is built once per partition), L3 validates replies against the report schema.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guestlens.schemas import HOTEL_ANALYSIS, REQUIRED_REPORT_FIELDS

# Our own request wording (the reference's prompt text is not reused).
SYSTEM_TEMPLATE = ("You analyse guest reviews of one place and answer with a single JSON object "
                   "in the report schema. Place: %s. Address: %s. Listed rating: %s. "
                   "Listed review count: %d. Date of analysis: %s.")
COMBINE_TEMPLATE = ("You merge period reports of one place into one JSON report in the same schema, "
                    "weighting recent periods more. Place: %s. Address: %s. Listed rating: %s. "
                    "Listed review count: %d. Date of analysis: %s.")
BLOCK_SEPARATOR = "\n---\n\n"    # fixed value: separator between period blocks


def review_line() -> Column:
    """One review line (our wording): ``* {rating} of 5 | {date} | {user}: {text}``."""
    return F.concat(F.lit("* "), F.col("rating").cast("string"), F.lit(" of 5 | "), F.col("date"),
                    F.lit(" | "), F.col("user"), F.lit(": "), F.col("review_text"))


def _system(template: str, header: DataFrame, as_of: str) -> Column:
    return F.format_string(template, F.col("title"), F.col("address"), F.col("rating").cast("string"),
                           F.col("total_reviews"), F.lit(as_of))


def analysis_requests(batched: DataFrame, header: DataFrame, as_of: str) -> DataFrame:
    """L1: one request per (place, batch).  ``header`` has data_id, title,
    address, rating, total_reviews.  Lines are in batch (date) order; the
    collected list is bounded by the batch size."""
    lines = (batched.groupBy("data_id", "batch_id").agg(
        F.count(F.lit(1)).cast("long").alias("n_reviews"),
        F.array_sort(F.collect_list(F.struct(F.col("date_pos"), review_line().alias("line")))).alias("_l")))
    j = lines.join(header, "data_id", "left")
    return j.select("data_id", "batch_id", "n_reviews",
                    _system(SYSTEM_TEMPLATE, header, as_of).alias("system_prompt"),
                    F.concat(F.lit("Reviews:\n"), F.array_join(F.transform("_l", lambda x: x["line"]), "\n"))
                     .alias("user_prompt"))


def combine_requests(nodes: DataFrame, header: DataFrame, fan_in_first: int, as_of: str) -> DataFrame:
    """L2: one request per combine node that has more than one child.  ``nodes``
    holds every node with its whole ``report`` (level 0 = batches, node = batch_id, and the
    A3 output for levels >= 1).  Each child becomes ``[first to last]\\n<report as JSON>``; blocks
    are oldest first and separated by a blank-line rule.  At most 10 children
    per node, so the collected list is bounded."""
    fan = F.when(F.col("level") == 0, F.lit(fan_in_first)).otherwise(F.lit(10))
    child = nodes.select(
        "data_id", (F.col("level") + 1).alias("p_level"), F.floor(F.col("node") / fan).cast("long").alias("p_node"),
        F.col("node").alias("c_node"),
        F.concat(F.lit("["), F.col("first_date"), F.lit(" to "), F.col("last_date"), F.lit("]\n"),
                 F.coalesce(F.to_json("report"), F.lit("null"))).alias("block"))
    parents = (nodes.filter((F.col("level") >= 1) & (F.col("n_children") > 1))
               .select("data_id", F.col("level").alias("p_level"), F.col("node").alias("p_node"), "n_children"))
    g = (child.join(parents, ["data_id", "p_level", "p_node"])
         .groupBy("data_id", "p_level", "p_node", "n_children")
         .agg(F.array_sort(F.collect_list(F.struct("c_node", "block"))).alias("_b")))
    j = g.join(header, "data_id", "left")
    return j.select("data_id", F.col("p_level").alias("level"), F.col("p_node").alias("node"), "n_children",
                    _system(COMBINE_TEMPLATE, header, as_of).alias("system_prompt"),
                    F.array_join(F.transform("_b", lambda x: x["block"]), BLOCK_SEPARATOR).alias("user_prompt"))


def _one_by_one(fn, pdf: pd.DataFrame) -> tuple[list, list]:
    replies, errors = [], []
    for i in range(len(pdf)):
        try:
            replies.append(list(fn(pdf.iloc[i:i + 1]))[0])
            errors.append(None)
        except Exception as e:  # noqa: BLE001 - surfaced per request
            replies.append(None)
            errors.append(f"{type(e).__name__}: {e}")
    return replies, errors


RESPONSE_SCHEMA = "data_id long, batch_id long, response string, error string"


def run_analyzer(requests: DataFrame, make_fn: Callable[[], Callable[[pd.DataFrame], pd.Series]],
                 partitions: int | None = None) -> DataFrame:
    """L4: apply the user's analyzer to every request.

    ``make_fn()`` is called once per partition (so clients / models are built
    on the executor); the returned function maps a pandas frame of requests
    (data_id, batch_id, system_prompt, user_prompt) to a Series of reply
    strings.  Exceptions become an ``error`` per request instead of failing
    the job; ``partitions`` bounds the concurrency of calls."""
    def per_partition(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = make_fn()
        for pdf in frames:
            try:
                replies, errors = list(fn(pdf)), [None] * len(pdf)
            except Exception:  # noqa: BLE001 - one bad request must not fail the others
                replies, errors = _one_by_one(fn, pdf)
            yield pd.DataFrame({"data_id": pdf["data_id"].astype("int64"),
                                "batch_id": pdf["batch_id"].astype("int64"),
                                "response": replies, "error": errors})
    r = requests.select("data_id", "batch_id", "system_prompt", "user_prompt")
    if partitions:
        r = r.repartition(partitions, "data_id", "batch_id")
    return r.mapInPandas(per_partition, RESPONSE_SCHEMA)


def _field(path: str) -> Column:
    c = F.col("report")
    for p in path.split("."):
        c = c[p]
    return c


def validate_responses(responses: DataFrame, tolerance: float = 0.2) -> DataFrame:
    """L3: parse replies with the report schema and check them: required
    fields present, 1 <= average_score <= 5, percentages summing to
    100 +- tolerance.  Adds ``report`` (struct), ``valid`` and ``reason``."""
    parsed = responses.withColumn("report", F.from_json(F.col("response"), HOTEL_ANALYSIS,
                                                        {"mode": "PERMISSIVE"}))
    s = F.col("report.overall_sentiment")
    total = s["positive_percentage"] + s["neutral_percentage"] + s["negative_percentage"]
    missing = F.array_compact(F.array(*[F.when(_field(p).isNull(), F.lit(p)) for p in REQUIRED_REPORT_FIELDS]))
    reason = (F.when(F.col("error").isNotNull(), F.concat(F.lit("call failed: "), F.col("error")))
              .when(F.col("response").isNull(), F.lit("no reply"))
              .when(F.try_parse_json(F.col("response")).isNull(), F.lit("not JSON"))
              .when(~F.schema_of_variant(F.try_parse_json(F.col("response"))).startswith("OBJECT"),
                    F.lit("not a JSON object"))
              .when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", ")))
              .when((s["average_score"] < 1) | (s["average_score"] > 5), F.lit("average_score out of range"))
              .when(F.abs(total - 100) > tolerance, F.lit("percentages do not sum to 100")))
    return parsed.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())
