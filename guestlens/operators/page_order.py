"""The order of landed pages from their ``next`` tokens, without page numbers.

A page knows the token it was fetched with (none: a first page) and the token of its next page.  The
number of a page is its distance from the first one.  Following the links one by one takes as many
joins as the longest chain has pages; here the links double: after k rounds every page knows the page
2^k links on, and every page less than 2^k links from its first page knows its number.  A round is
two equi-joins on (place, token); all of its rows are written, so lineage stays short and a lost
executor costs one round.  The smallest distance counts, so cycles and several pages with one
``next`` end like any chain, after log2(longest chain) + 1 rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guestlens.sources.scratch import materialize

MAX_ROUNDS = 62


def page_links(pages: DataFrame) -> DataFrame:
    """(data_id, token, next_token) of readable landed pages with the column ``page_token``; the first page's token is ''."""
    good = pages.filter(F.col("_corrupt").isNull() & F.col("data_id").isNotNull())
    return good.select("data_id", F.coalesce("page_token", F.lit("")).alias("token"), F.col("serpapi_pagination.next_page_token").alias("next_token"))


def page_order(links: DataFrame) -> DataFrame:
    """Per place and token: next_token, page_no (0 for the first page; NULL if no chain from it leads here) and state:

    * ``ok``: the next page is landed and comes later;
    * ``last``: there is no next page;
    * ``next missing``: the chain breaks off, its next page is not landed;
    * ``cycle``: the next page is this one or an earlier one;
    * ``unreached``: an earlier page is missing, or only a cycle leads here.

    A token that landed with several next tokens keeps the greatest; a place without a first page has unreached
    pages only; an empty table gives no rows."""
    nodes = materialize(links.groupBy("data_id", "token").agg(F.max("next_token").alias("next_token")), "pages")
    at = lambda df, name: df.select(F.col("data_id").alias("_d"), F.col("token").alias("_t"), F.col(name))
    here = lambda c: (F.col("data_id") == F.col("_d")) & (F.col(c) == F.col("_t"))
    known = nodes.select(F.col("data_id").alias("_d"), F.col("token").alias("_t"))
    jump = materialize(nodes.where("next_token is not null").join(known, here("next_token")).select("data_id", "token", F.col("next_token").alias("to")), "jump")
    found = materialize(nodes.where("token = ''").select("data_id", "token", F.lit(0).cast("long").alias("page_no")), "found")
    n = found.count()
    for k in range(MAX_ROUNDS):
        onward = found.join(at(jump, "to"), here("token")).select("data_id", F.col("to").alias("token"), (F.col("page_no") + (1 << k)).alias("page_no"))
        found = materialize(found.unionByName(onward).groupBy("data_id", "token").agg(F.min("page_no").alias("page_no")), "found")
        before, n = n, found.count()
        if n == before:
            break
        jump = materialize(jump.join(at(jump, "to").withColumnRenamed("to", "_to"), here("to")).select("data_id", "token", F.col("_to").alias("to")), "jump")
    number = found.select(F.col("data_id").alias("_fd"), F.col("token").alias("_ft"), "page_no")
    out = nodes.join(number, (F.col("data_id") == F.col("_fd")) & (F.col("token") == F.col("_ft")), "left").drop("_fd", "_ft")
    after = out.select(F.col("data_id").alias("_d"), F.col("token").alias("_t"), F.col("page_no").alias("_next_no"))
    out = out.join(after, here("next_token"), "left")
    state = (F.when(F.col("page_no").isNull(), "unreached").when(F.col("next_token").isNull(), "last").when(F.col("_t").isNull(), "next missing")
             .when(F.col("_next_no") <= F.col("page_no"), "cycle").otherwise("ok"))
    return out.select("data_id", "token", "next_token", "page_no", state.alias("state"))


def chain_report(ordered: DataFrame) -> DataFrame:
    """Per place: pages in order, unreached pages, and how its chain ends (``last``, ``next missing``, ``cycle``, or ``no first page``)."""
    end = F.max_by("state", F.when(F.col("page_no").isNotNull(), F.col("page_no")))
    return ordered.groupBy("data_id").agg(
        F.count("page_no").alias("n_pages"), F.count(F.when(F.col("state") == "unreached", 1)).alias("n_unreached"),
        F.coalesce(end, F.lit("no first page")).alias("ends"))
