"""Groups from links, without pairs of all members of a bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id that each linked id reaches, from links (a, b).

    Least labels spread along links; from the third round on every label also jumps to its own
    label, so that chains shrink by half a round. Stars around their least id settle in one round.
    Each round is checkpointed. Ids without links are not in the result.
    """
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("component")))
    for k in range(rounds):
        near = both.join(labels.withColumnRenamed("id", "b"), "b").select(F.col("a").alias("id"), "component", F.lit(None).cast("long").alias("old"))
        own = labels.select("id", "component", F.col("component").alias("old"))
        step = near.union(own).groupBy("id").agg(F.min("component").alias("component"), F.max("old").alias("old"))
        if k >= 2:
            far = labels.select(F.col("id").alias("component"), F.col("component").alias("far"))
            step = step.join(far, "component").select("id", F.col("far").alias("component"), "old")
        labels = cut(step)
        changed = labels.where(F.col("component") != F.col("old")).limit(1).count()
        labels = labels.select("id", "component")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")


class Judge:
    """Decides which candidate pairs are links; what linked_groups asks of an operator."""

    def gather(self, ids: DataFrame) -> None:
        """Told once which ids have any candidate, (id), before the first verify."""

    def near(self, a: str, b: str) -> Column:
        """Whether two item rows, their columns ending in _a and _b, may be a link; never false for a link."""
        raise NotImplementedError

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are links."""
        raise NotImplementedError

    def refined(self, items: DataFrame) -> DataFrame:
        """Items that the first round left beside others, (id, crowded, ...), with a column `order`: the least
        are tried as centers next. May add columns that `near` reads when they are there. `crowded` items
        are in a bucket of CROWD or more of them."""
        return items.withColumn("order", -F.col("id"))


CROWD = 32


def _sided(rows: DataFrame, side: str, other: str = "") -> DataFrame:
    return rows.select([F.col(c).alias(side if c == "id" else c if c == other else f"{c}_{side}") for c in rows.columns])


def linked_groups(postings: DataFrame, items: DataFrame, judge: Judge, known: DataFrame | None = None) -> DataFrame:
    """(id, component) of all items that a verified link joins; `known` are links (a, b) found before.

    `postings` is (key, id), an id once a key; `items` is (id, ...) with what judge.near compares. Ids that
    share a key are candidates where judge.near holds; the result's groups are those of all links
    among candidates, found without pairs of all members:

    1. Each bucket's members meet its least id only.
    2. In buckets whose members are still in different groups, members meet the member that
       judge.refined orders first.
    3. What is still in different groups of one bucket meets each other, where judge.near allows, once
       for a pair whatever the number of its buckets.
    """
    buckets = postings.groupBy("key").agg(F.min("id").alias("center"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = cut(postings.join(buckets, "key").select("key", "id", "center"))
    judge.gather(shared.select("id").distinct())
    tested, links, groups = None, known, None

    def judged(pairs: DataFrame, rows: DataFrame) -> DataFrame:
        nonlocal tested, links, groups
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        found = cut(pairs.join(_sided(rows, "a"), "a").join(_sided(rows, "b"), "b").where(judge.near("a", "b")).select("a", "b"))
        if groups is not None and not found.limit(1).count():
            return groups
        linked = cut(judge.verify(found).select("a", "b"))
        tested = found if tested is None else tested.union(found)
        links = linked if links is None else links.union(linked)
        return components(links)

    def mixed(groups: DataFrame) -> DataFrame:
        """(key, id, component) of buckets with members in different groups."""
        member = shared.select("key", "id").join(groups, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
        torn = member.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
        return cut(member.join(torn, "key", "left_semi"))

    apart = lambda a, b: [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]
    groups = judged(shared.where("id != center").select(*apart("center", "id")).distinct(), items)
    member = mixed(groups)
    size = member.groupBy("key").agg(F.count("*").alias("size"))
    left_over = member.join(size, "key").groupBy("id").agg((F.max("size") >= CROWD).alias("crowded"))
    rows = cut(judge.refined(items.join(left_over, "id")))
    first = F.min(F.struct("order", "id", "component"))
    centers = member.join(rows.select("id", "order"), "id").groupBy("key").agg(first.alias("c")).select("key", F.col("c.id").alias("center"), F.col("c.component").alias("of"))
    stars = member.join(centers, "key").where("component != of").select(*apart("center", "id")).distinct()
    groups = judged(stars, rows)
    member = mixed(groups)
    keys = member.groupBy("id").agg(F.collect_set("key").alias("keys"))
    member = member.join(rows.join(keys, "id"), "id")
    left, right = _sided(member, "a", "key"), _sided(member, "b", "key").withColumnRenamed("key", "key_b")
    once = F.col("key") == F.array_min(F.array_intersect("keys_a", "keys_b"))
    cross = left.join(right, (F.col("key") == F.col("key_b")) & (F.col("component_a") != F.col("component_b")) & (F.col("a") < F.col("b")) & judge.near("a", "b") & once)
    return judged(cross.select("a", "b"), rows)
