"""Mixing sources to target weights by hierarchical budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, word_count

LEVELS = ("domain", "lang", "source")
WIDE = "decimal(38,0)"
DRAW_BITS = 60
#: Weights of the test corpus' domains; any other domain, and every language and source, weighs 1.
DOMAIN_WEIGHTS = {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}


def domain_of(source: Column) -> Column:
    """A source's domain: its number by 4; sources without one share a domain of their own."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]+)$", 1)
    return F.when(number == "", F.lit("other")).otherwise(F.concat(F.lit("domain"), F.pmod(F.substring(number, -2, 2).cast("int"), F.lit(4)).cast("string")))


def _share(nodes: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Give every parent's budget to its children in proportion to weight, none beyond its capacity.

    Children are saturated in order of capacity / weight; what they cannot take is shared by their
    siblings again. All in whole tokens, rounded down.
    """
    # cross-multiplied in the tie-break of equal ratios, so that the order is exact
    order = [F.col("capacity").cast("double") / F.col("weight"), F.col(child)]
    w = Window.partitionBy(*parent).orderBy(*order) if parent else Window.partitionBy(F.lit(0)).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n = nodes.withColumns({
        "_before": F.coalesce(F.sum("capacity").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_left": F.sum("weight").over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    })
    d = lambda c: F.col(c).cast(WIDE)
    n = n.withColumn("_full", d("capacity") * d("_left") <= (d("budget") - d("_before")) * d("weight"))
    n = n.withColumns({
        "_taken": F.sum(F.when(F.col("_full"), F.col("capacity")).otherwise(0)).over(whole),
        "_open": F.sum(F.when(~F.col("_full"), F.col("weight")).otherwise(0)).over(whole),
    })
    open_share = F.when(F.col("_open") > 0, F.expr(f"CAST((CAST(budget AS {WIDE}) - CAST(_taken AS {WIDE})) * CAST(weight AS {WIDE}) DIV CAST(_open AS {WIDE}) AS BIGINT)"))
    return n.withColumn("given", F.when(F.col("_full"), F.col("capacity")).otherwise(F.least(F.col("capacity"), open_share)).cast("long")).drop(
        "_before", "_left", "_full", "_taken", "_open")


def budgets(leaves: DataFrame, total: Column, weights: dict[str, dict[str, int]], epochs: int) -> DataFrame:
    """(domain, lang, source, tokens, budget): tokens each leaf must give.

    `leaves` is (domain, lang, source, tokens); `weights` names the whole-number weights of values of
    each level, 1 where it is silent. A leaf can give its tokens `epochs` times. The total goes down
    the tree level by level; since a node's capacity is that of its leaves, what a leaf lacks goes to
    its siblings first and only what the whole branch lacks to the ancestors' other branches. A
    total beyond the capacity of the tree gives the capacity. The tree has one row per leaf and is
    small beside the documents.
    """
    def weight(level: str) -> Column:
        given = weights.get(level, {})
        out = F.lit(1)
        for value, w in given.items():
            out = F.when(F.col(level) == value, F.lit(int(w))).otherwise(out)
        return out.cast("long")

    leaves = cut(leaves.select(*LEVELS, "tokens", (F.col("tokens") * epochs).alias("capacity")))
    whole = leaves.agg(F.sum("tokens").alias("corpus"), F.sum("capacity").alias("capacity")).select(
        F.least(total.cast("long"), F.col("capacity")).alias("budget"))
    level = whole
    for k, name in enumerate(LEVELS):
        up = list(LEVELS[:k])
        nodes = leaves.groupBy(*LEVELS[: k + 1]).agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens")).withColumn("weight", weight(name))
        if up:
            level = nodes.join(level.select(*up, F.col("given").alias("budget")), up)
        else:
            top = whole.first()
            level = nodes.withColumn("budget", F.lit(top["budget"] or 0).cast("long"))
        level = cut(_share(level, up, name))
    return level.select(*LEVELS, "tokens", F.col("given").alias("budget"))


def _draw(seed: int, epoch: Column, doc_id: Column) -> Column:
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, DRAW_BITS // 4), 16, 10).cast("long")


def mix(
    df: DataFrame, share: tuple[int, int] = (1, 2), weights: dict[str, dict[str, int]] | None = None, epochs: int = 2, seed: int = 29,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", bin_rows: int = 4_000,
) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, copies): how often each row is taken, 0 included.

    The corpus keeps share[0] / share[1] of its tokens (words between white space), spread over the
    tree of domain, language and source by `budgets`. A leaf's budget is filled from epochs, each a
    seeded order of its documents: whole epochs first, then a prefix of the next, up to the document
    whose preceding tokens reach what is left. So a leaf exceeds its budget by less than one
    document. Documents without tokens are taken as often as whole epochs, and in the last one
    while something is left. Null languages and sources are the leaf 'null'; a null id is drawn as
    the word null; rows equal in id are one place in the order, ties broken by tokens. An empty
    table gives no rows.

    A leaf with very many documents is summed in bins of its seeded order; only the bin in which
    the prefix ends is ordered row by row.
    """
    weights = weights or {"domain": DOMAIN_WEIGHTS}
    named = lambda c: F.coalesce(F.col(c), F.lit("null"))
    rows = cut(df.select(
        F.col(id_col).cast("long").alias("doc_id"), domain_of(F.col(source_col)).alias("domain"), named(lang_col).alias("lang"),
        named(source_col).alias("source"), word_count(F.col(text_col)).alias("n_tokens"),
    ))
    leaves = cut(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents")))
    all_tokens = leaves.agg(F.sum("tokens")).first()[0] or 0
    wanted = budgets(leaves, F.lit(all_tokens * share[0] // share[1]), weights, epochs)
    plan = leaves.select(*LEVELS, "documents").join(wanted, list(LEVELS)).select(
        *LEVELS,
        F.when(F.col("tokens") > 0, F.expr("budget DIV tokens")).otherwise(0).cast("int").alias("full"),
        F.when(F.col("tokens") > 0, F.expr("budget % tokens")).otherwise(0).alias("rest"),
        F.greatest(F.lit(1), F.expr(f"documents DIV {int(bin_rows)}")).alias("bins"),
    )
    plan = cut(plan)
    # the tree has one row per source, language and domain: Spark measures it before it broadcasts
    drawn = rows.join(plan, list(LEVELS)).withColumn("draw", _draw(seed, F.col("full"), F.col("doc_id")))
    width = F.lit(1 << DRAW_BITS).cast(WIDE)
    drawn = cut(drawn.withColumn("bin", F.floor(F.col("draw").cast(WIDE) * F.col("bins").cast(WIDE) / width).cast("long")))
    by_bin = drawn.groupBy(*LEVELS, "bin").agg(F.sum("n_tokens").alias("bin_tokens"))
    over = Window.partitionBy(*LEVELS).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    by_bin = cut(by_bin.withColumn("bin_before", F.coalesce(F.sum("bin_tokens").over(over), F.lit(0))))
    placed = drawn.join(by_bin, [*LEVELS, "bin"])
    edge = (F.col("bin_before") < F.col("rest")) & (F.col("bin_before") + F.col("bin_tokens") >= F.col("rest"))
    fixed = placed.where(~edge).withColumn("more", (F.col("bin_before") < F.col("rest")).cast("int"))
    inner = Window.partitionBy(*LEVELS, "bin").orderBy("draw", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    cutoff = placed.where(edge).withColumn("_at", F.col("bin_before") + F.coalesce(F.sum("n_tokens").over(inner), F.lit(0))).withColumn(
        "more", (F.col("_at") < F.col("rest")).cast("int")).drop("_at")
    return fixed.unionByName(cutoff).select("doc_id", *LEVELS, "n_tokens", (F.col("full") + F.col("more")).cast("int").alias("copies"))


def mixed_rows(df: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Rows of `df`, each as often as `mix` takes it, with all their columns."""
    taken = mix(df, id_col=id_col, **options).groupBy(F.col("doc_id").alias("__id")).agg(F.max("copies").alias("__copies")).where("__copies > 0")
    out = df.join(taken, F.col(id_col).cast("long").eqNullSafe(F.col("__id"))).withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return out.select(*[F.col(f"`{c}`") for c in df.columns])
