"""A3 tree combine and W4 period trend over batch state.

The reference combines batch reports level by level: level 1 groups
``fan_in_first`` consecutive batches (batch_size // 2), later levels group 10
consecutive nodes, until one node is left; a group of one passes through
unchanged.  Because grouping is always by consecutive ranges, the node of a
batch at level k is ``floor(batch_id / span_k)`` with ``span_1 = fan_in_first``
and ``span_k = fan_in_first * 10^(k-1)``, so every level is one groupBy over
the batch rows - no driver loop, no per-level job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guestlens.functions.dates import display_date
from guestlens.operators import aspects as asp
from guestlens.operators import sentiment as sen
from guestlens.sources.scratch import identity

LATER_FAN_IN = 10


def fan_in_for(batch_size: int) -> int:
    """Half the batch size; with 1 (sizes 2 and 3) the first level passes batches through."""
    f = batch_size // 2
    if f < 1:
        raise ValueError("batch_size must be >= 2")
    return f


def _spans(fan_in_first: int) -> list[int]:
    """Batches under one node of level 1, 2, ..: all that a long batch number can need."""
    out = [fan_in_first]
    while out[-1] * LATER_FAN_IN < 2**63:
        out.append(out[-1] * LATER_FAN_IN)
    return out


def level_count(n_batches: F.Column, fan_in_first: int) -> F.Column:
    """Number of combine levels for a place with n batches (0 when n <= 1):
    level k >= 2 exists iff n > fan_in_first * 10^(k-2)."""
    spans = F.array(*[F.lit(x).cast("long") for x in _spans(fan_in_first)])
    more = F.size(F.filter(spans, lambda s: n_batches > s))
    return F.when(n_batches > 1, 1 + more).otherwise(0)


def tree_nodes(batch_state: DataFrame, fan_in_first: int) -> DataFrame:
    """(data_id, batch_id, level, node, _child, _levels): the node of every batch at every level."""
    n = batch_state.groupBy("data_id").agg((F.max("batch_id") + 1).alias("_nb"))
    b = batch_state.select("data_id", "batch_id").join(n, "data_id").withColumn("_levels", level_count(F.col("_nb"), fan_in_first))
    b = b.filter(F.col("_levels") > 0).withColumn("level", F.explode(F.sequence(F.lit(1), F.col("_levels"))))
    # The last span ends every tree; one more entry keeps the lookup of the top level in range.
    spans = F.array(*[F.lit(x).cast("long") for x in [*_spans(fan_in_first), 2**63 - 1]])
    span = F.element_at(spans, F.col("level").cast("int"))
    child_span = F.when(F.col("level") == 1, F.lit(1)).otherwise(F.element_at(spans, (F.col("level") - 1).cast("int")))
    return b.select("data_id", "batch_id", F.col("level").cast("long").alias("level"), F.floor(F.col("batch_id") / span).cast("long").alias("node"),
                    F.floor(F.col("batch_id") / child_span).cast("long").alias("_child"), "_levels")


def tree_combine(batch_state: DataFrame, fan_in_first: int, counts: DataFrame | None = None, reuse=identity) -> DataFrame:
    """A3: every combine node of every level with its merged state.

    Output: data_id, level, node, n_children, n_batches, n_reviews, scores,
    first_date, last_date, is_root, combined (False for a pass-through).  ``counts``
    (phrase counts per batch) adds the node's merged themes: n_themes, n_mentions and
    top_issue, the issue of its first improvement priority (NULL without criticism).  The merged
    counts are read by two branches: ``reuse`` writes them once."""
    nodes = tree_nodes(batch_state, fan_in_first)
    g = nodes.join(batch_state, ["data_id", "batch_id"]).groupBy("data_id", "level", "node").agg(
        (F.max("_child") - F.min("_child") + 1).alias("n_children"),       # children are consecutive
        F.count(F.lit(1)).cast("long").alias("n_batches"),
        *sen.merge_aggs(), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
        F.max("_levels").alias("_levels"))
    out = sen.scores(g).select(
        "data_id", "level", "node", "n_children", "n_batches",
        "n_reviews", *sen.SCORE_COLUMNS,
        display_date("first_ts").alias("first_date"), display_date("last_ts").alias("last_date"),
        (F.col("level") == F.col("_levels")).alias("is_root"),
        (F.col("n_children") > 1).alias("combined"))
    if counts is None:
        return out
    merged = reuse(tree_counts(nodes, counts), "node-counts")
    themes = (merged.groupBy("data_id").agg(F.count_distinct("term", "pol").cast("long").alias("n_themes"), F.sum("n_mentions").alias("n_mentions"))
              .join(asp.improvement_priorities(merged, 1).select("data_id", F.col("issue").alias("top_issue")), "data_id", "left")
              .select("data_id.*", "n_themes", "n_mentions", "top_issue"))
    zero = F.lit(0).cast("long")
    return (out.join(themes, ["data_id", "level", "node"], "left")
            .withColumn("n_themes", F.coalesce("n_themes", zero)).withColumn("n_mentions", F.coalesce("n_mentions", zero)))


def tree_counts(nodes: DataFrame, counts: DataFrame) -> DataFrame:
    """Phrase counts per combine node: those of its batches, summed.  ``data_id`` of the
    result is the struct (data_id, level, node), so the aspect operators work on nodes."""
    at = nodes.select("data_id", "batch_id", "level", "node").join(counts, ["data_id", "batch_id"])
    return (at.groupBy(F.struct("data_id", "level", "node").alias("data_id"), *asp.PHRASE)
            .agg(*[F.sum(c).alias(c) for c in asp.COUNTS]))


def merged_counts(counts: DataFrame, recent: bool = False) -> DataFrame:
    """Phrase counts of whole places from those of their batches; with ``recent`` the k-th
    oldest batch weighs k."""
    w = F.col("batch_id") + 1 if recent else F.lit(1)
    return counts.groupBy("data_id", *asp.PHRASE).agg(*[F.sum(F.col(c) * w).alias(c) for c in asp.COUNTS])


def node_reports(batch_state: DataFrame, counts: DataFrame, breakfast: DataFrame, header: DataFrame, fan_in_first: int, reuse=identity) -> DataFrame:
    """(data_id, level, node, report): the whole report of every batch (level 0) and combine
    node, from merged sums only.  Nodes and merged counts are read by several branches: ``reuse`` writes
    each once."""
    from guestlens.operators.report import assemble_counts
    leaves = batch_state.select("data_id", "batch_id", F.lit(0).cast("long").alias("level"), F.col("batch_id").alias("node"))
    nodes = reuse(leaves.unionByName(tree_nodes(batch_state, fan_in_first).select(*leaves.columns)), "nodes")
    key = F.struct("data_id", "level", "node")
    state = sen.scores(nodes.join(batch_state, ["data_id", "batch_id"]).groupBy(key.alias("data_id")).agg(*sen.merge_aggs()))
    bf = (nodes.join(breakfast, ["data_id", "batch_id"]).groupBy(key.alias("data_id")).agg(F.sum("_breakfast").alias("_breakfast")))
    titles = (nodes.select("data_id", "level", "node").distinct().join(header.select("data_id", "title"), "data_id")
              .select(key.alias("data_id"), "title"))
    out = assemble_counts(reuse(tree_counts(nodes, counts), "node-counts"), state, titles, bf)
    return out.select("data_id.*", F.col("hotel_analysis").alias("report"))


def period_trend(batch_state: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per batch the average score, the previous batch's, the change and a
    label (improving >= +threshold, declining <= -threshold, else stable;
    ``first`` for the oldest batch).  The previous batch is found with an
    equi-join on (data_id, batch_id - 1), not a window over the whole place,
    so a place with many batches is spread over all tasks."""
    avg = F.when(F.col("n_rated") > 0, F.col("sum_rating") / F.col("n_rated"))
    cur = batch_state.select("data_id", "batch_id", avg.alias("_avg"))
    prev = cur.select(F.col("data_id").alias("_pd"), (F.col("batch_id") + 1).alias("_pb"),
                      F.col("_avg").alias("_prev"))
    j = cur.join(prev, (cur.data_id == prev._pd) & (cur.batch_id == prev._pb), "left")
    delta = F.col("_avg") - F.col("_prev")
    return j.select(
        "data_id", "batch_id", F.round("_avg", 2).alias("average_score"),
        F.round("_prev", 2).alias("previous_score"), F.round(delta, 2).alias("delta"),
        F.when(F.col("_pd").isNull(), "first").when(delta >= threshold, "improving")
         .when(delta <= -threshold, "declining").otherwise("stable").alias("trend"))


def aspect_trend(m_batched: DataFrame, threshold: int = 1, reuse=identity) -> DataFrame:
    """W4 per aspect: net support (praising minus criticising reviews) of each
    aspect per batch against the previous batch.  Both sides of that join read the net support:
    ``reuse`` writes it once."""
    per = reuse(m_batched.filter(F.col("pol") != 0).groupBy("data_id", "aspect", "batch_id")
                .agg(F.sum(F.col("pol") * F.col("first_aspect")).cast("long").alias("net")), "net-support")
    prev = per.select(F.col("data_id").alias("_pd"), F.col("aspect").alias("_pa"),
                      (F.col("batch_id") + 1).alias("_pb"), F.col("net").alias("previous_net"))
    j = per.join(prev, (per.data_id == prev._pd) & (per.aspect == prev._pa) & (per.batch_id == prev._pb), "left")
    d = F.col("net") - F.col("previous_net")
    return j.select("data_id", "aspect", "batch_id", "net", "previous_net",
                    F.when(F.col("previous_net").isNull(), "first").when(d >= threshold, "improving")
                     .when(d <= -threshold, "declining").otherwise("stable").alias("trend"))
