"""Mixing sources to target weights by hierarchical token budgets.

The tree is domain - language - source. A budget flows from the root in
proportion to weights; a node that holds fewer tokens than its share gives the
rest to its siblings, and only what all of a node's subtree can't use goes back
to the node's own siblings. Each level is one water-filling over the nodes of a
parent: sorted by capacity per weight, the saturated ones are a prefix, so
running sums give the exact level.

Each leaf then runs through seeded epochs: whole epochs while its budget lasts,
and of the next epoch the prefix of tokens, in that epoch's own order, that is
left. The document in which the prefix ends counts with its first tokens, so a leaf
spends its budget to the token, and all leaves together that of the root but
for the fractions of a token. Prefix sums are taken in two steps, over buckets of
the order and then inside the bucket. A leaf of n rows has about sqrt(n) buckets,
so one with a third of all rows is never in one task.

Defined results: null texts have no tokens; null languages and sources are the
node ``''``. Nodes without a weight have weight 1, those of weight 0 get
nothing. A leaf without tokens selects nothing. Ties in the order fall to the
id, then the size; repeated rows are told apart by neither and count one by one.
Other columns are ignored. An empty table gives no rows. ``budget`` beyond all
that ``max_epochs`` can give selects everything ``max_epochs`` times.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

LEVELS = ("domain", "lang", "source")
WORD = r"[^\x20\x09-\x0D]+"
#: Production parameters.
DOMAINS = 4
WEIGHTS = {("d0",): 4, ("d1",): 3, ("d2",): 2, ("d3",): 1, ("d0", "en"): 2, ("d1", "en"): 2}
SEED = 17


def domain_of(source: Column, domains: int = DOMAINS) -> Column:
    """The tables have no domain: sources are dealt into ``domains`` by checksum."""
    return F.concat(F.lit("d"), F.pmod(F.crc32(source), F.lit(domains)))


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, domain, lang, source, tokens``; tokens are whitespace-separated words."""
    source = F.coalesce("source", F.lit(""))
    return docs.select(
        "doc_id", domain_of(source).alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"), source.alias("source"),
        F.regexp_count(common.text_or_empty(), F.lit(WORD)).cast("long").alias("tokens"),
    )


def weight_of(levels: tuple[str, ...], weights: Mapping[tuple[str, ...], float]) -> Column:
    found = F.lit(1.0)
    for path, w in sorted(weights.items()):
        if len(path) == len(levels):
            test = F.lit(True)
            for c, v in zip(levels, path, strict=True):
                test = test & (F.col(c) == v)
            found = F.when(test, F.lit(float(w))).otherwise(found)
    return found


def budgets(leaves: DataFrame, budget: Column, weights: Mapping[tuple[str, ...], float], max_epochs: int) -> DataFrame:
    """``leaves(domain, lang, source, tokens)`` with the ``budget`` of each leaf."""
    out = leaves.withColumn("parent_budget", budget.cast("double"))
    for depth in range(1, len(LEVELS) + 1):
        node, parent = LEVELS[:depth], LEVELS[: depth - 1]
        nodes = out.groupBy(*node).agg(F.max("parent_budget").alias("given"), (F.sum("tokens") * max_epochs).cast("double").alias("capacity"))
        nodes = nodes.withColumn("w", weight_of(node, weights)).withColumn("ratio", F.when(F.col("w") > 0, F.col("capacity") / F.col("w")))
        near = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
        line = near.orderBy("ratio", node[-1])
        # before this node all are saturated if this one is
        full_before = F.coalesce(F.sum("capacity").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        weight_from = F.sum("w").over(line.rowsBetween(0, Window.unboundedFollowing))
        live = nodes.filter("w > 0").withColumn("full", F.col("capacity") * weight_from <= F.col("w") * (F.col("given") - full_before))
        level = (F.col("given") - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(near), F.lit(0.0))) / F.sum(F.when(~F.col("full"), F.col("w"))).over(near)
        live = live.withColumn("share", F.when(F.col("full"), F.col("capacity")).otherwise(level * F.col("w"))).select(*node, "share")
        out = out.join(live, list(node), "left").withColumn("parent_budget", F.coalesce("share", F.lit(0.0))).drop("share")
    return out.withColumn("budget", F.floor("parent_budget").cast("long")).drop("parent_budget")


def epoch_key(seed: int, epoch: Column) -> Column:
    """A 60-bit order of its own for each seed and epoch."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), epoch, F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, share: float = 0.5, max_epochs: int = 2, weights: Mapping[tuple[str, ...], float] | None = None, seed: int = SEED) -> DataFrame:
    """``doc_id, domain, lang, source, tokens, copies, part_tokens`` for every row of ``docs``.

    The root's budget is ``share`` of all tokens. ``copies`` is in how many
    epochs of its leaf the whole row is selected, ``part_tokens`` how many of its
    first tokens the end of the last prefix takes besides.
    """
    ws = common.Workspace(docs.sparkSession, "mixing")
    rows = ws.save(measured(docs), "rows")
    total = rows.agg(F.sum("tokens")).first()[0] or 0
    leaves = rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    funded = budgets(leaves, F.lit(math.floor(total * float(share))), WEIGHTS if weights is None else weights, max_epochs)
    funded = ws.save(
        funded.select(
            *LEVELS,
            F.when(F.col("tokens") > 0, F.least(F.floor(F.col("budget") / F.col("tokens")), F.lit(max_epochs))).otherwise(F.lit(max_epochs)).cast("long").alias("epochs"),
            "budget", F.col("tokens").alias("leaf_tokens"), (F.floor(F.sqrt("n")) + 1).alias("buckets"),
        ), "leaves",
    )
    # one row per leaf: the join moves no document when Spark finds the leaves small
    keyed = rows.join(funded, list(LEVELS)).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("leaf_tokens")).withColumn("key", epoch_key(seed, F.col("epochs")))
    # of the key's 60 bits the upper 30 count, so the product stays a long; buckets still follow the key
    keyed = keyed.withColumn("bucket", F.shiftright(F.shiftright("key", 30) * F.col("buckets"), 30))
    sums = keyed.groupBy(*LEVELS, "bucket").agg(F.sum("tokens").alias("in_bucket"))
    before = sums.select(*LEVELS, "bucket", (F.sum("in_bucket").over(Window.partitionBy(*LEVELS).orderBy("bucket")) - F.col("in_bucket")).alias("before"))
    running = Window.partitionBy(*LEVELS, "bucket").orderBy("key", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, 0)
    placed = keyed.withColumn("inside", F.sum("tokens").over(running)).join(before, [*LEVELS, "bucket"])
    ends = F.col("before") + F.col("inside")
    open_ = (F.col("leaf_tokens") > 0) & (F.col("epochs") < max_epochs) & (F.col("rest") > 0)
    part = F.when(open_ & (ends > F.col("rest")), F.greatest(F.lit(0), F.col("rest") - ends + F.col("tokens"))).otherwise(0)
    copies = F.when(F.col("leaf_tokens") > 0, F.col("epochs")).otherwise(0) + (open_ & (ends <= F.col("rest"))).cast("long")
    return placed.select("doc_id", *LEVELS, "tokens", copies.alias("copies"), part.cast("long").alias("part_tokens"))


def selected(mixed: DataFrame) -> DataFrame:
    """``domain, lang, source, tokens, selected`` of each leaf of what ``mix`` returned: what it holds and what it gives."""
    given = F.col("tokens") * F.col("copies") + F.col("part_tokens")
    return mixed.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"), F.sum(given).alias("selected"))


def kept_ids(mixed: DataFrame) -> DataFrame:
    """Ids whose row is selected whole, or by half or more where a leaf's prefix ends."""
    return mixed.filter((F.col("copies") > 0) | ((F.col("part_tokens") > 0) & (F.col("part_tokens") * 2 >= F.col("tokens")))).select("doc_id").distinct()
