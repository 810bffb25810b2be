"""Mix sources to target weights by hierarchical budgets.

The token budget flows down a tree domain, language, source. Every node splits what it
got among its children by weight. A child that cannot use its share (all its epochs
together hold fewer tokens) is filled up and the rest goes to its siblings by weight;
only what a whole subtree cannot use reaches the siblings one level up. Each leaf then
takes whole epochs, and of the last one a prefix in seeded order.

Shares are found without loops: children sorted by capacity over weight fill up in that
order, so running sums tell which are full. The tree has one row per source, texts never
move: the cut of each leaf is joined back to the rows on the leaf's names.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paroxys.llm.common import WORD, fresh, written
from paroxys.operators.ordered import running

SEED = 42
MAX_EPOCHS = 4
BUDGET_SHARE = 0.5
LEVELS = ("domain", "lang", "source")
#: Documents of a hash range, about; ranges are counted before any of them is sorted.
CHUNK_DOCS = 4096


def token_count(text: Column) -> Column:
    """Words between white space; null counts as empty."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("bigint")


def _weight(name: Column, weights: Mapping[str, int]) -> Column:
    out = F.lit(1)
    for key, value in sorted(weights.items()):
        out = F.when(name == key, value).otherwise(out)
    return out.cast("bigint")


def split_budget(nodes: DataFrame, parent: list[str], budget: Column, name: str) -> DataFrame:
    """Add ``budget``, the share of each child of ``parent``, under its capacity ``cap``.

    Shares are rounded down to whole tokens; what rounding leaves, less than one token
    per child, is not given out.
    """
    order = [F.col("cap").cast("double") / F.col("weight"), F.col("cap"), F.col(name)]
    family = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    up = family.orderBy(*order)
    before = F.sum("cap").over(up.rowsBetween(W.unboundedPreceding, -1))
    ranked = nodes.select(
        "*",
        F.row_number().over(up).alias("_rank"),
        F.greatest(budget - F.coalesce(before, F.lit(0)), F.lit(0)).alias("_left"),
        F.sum("weight").over(up.rowsBetween(0, W.unboundedFollowing)).alias("_weights"),
    )
    share = F.floor(F.col("_left").cast("double") * F.col("weight") / F.col("_weights"))
    level = F.min(F.when(share < F.col("cap"), F.struct("_rank", "_left", "_weights"))).over(family)
    part = F.floor(F.col("_level._left").cast("double") * F.col("weight") / F.col("_level._weights"))
    full = F.col("_level").isNull() | (F.col("_rank") < F.col("_level._rank"))
    return (
        ranked.withColumn("_level", level)
        .withColumn("budget", F.when(full, F.col("cap")).otherwise(part).cast("bigint"))
        .drop("_rank", "_left", "_weights", "_level")
    )


def leaf_budgets(
    leaves: DataFrame,
    total: Column,
    weights: Mapping[str, Mapping[str, int]],
    max_epochs: int = MAX_EPOCHS,
) -> DataFrame:
    """Budget of each leaf of ``leaves`` (the three level names and ``tokens``)."""
    if any(w <= 0 for level in weights.values() for w in level.values()):
        raise ValueError("weights are positive whole numbers")
    caps = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    above, budget = None, total
    for depth, name in enumerate(LEVELS):
        path = list(LEVELS[: depth + 1])
        nodes = caps.groupBy(*path).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
        nodes = nodes.withColumn("weight", _weight(F.col(name), weights.get(name, {})))
        if above is not None:
            upper = above.select(*path[:-1], F.col("budget").alias("_given"))
            nodes = nodes.join(upper, path[:-1])
            budget = F.col("_given")
        above = split_budget(nodes, path[:-1], budget, name).drop("_given", "weight")
    return above


def seeded_order(uid: Column, epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), uid).cast("binary"))


def mix(
    docs: DataFrame,
    domain: Column,
    weights: Mapping[str, Mapping[str, int]],
    budget_share: float = BUDGET_SHARE,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
) -> tuple[DataFrame, dict[str, str]]:
    """The chosen rows, once for each epoch, plus ``domain``, ``tokens`` and ``epoch``.

    The three come under fresh names, given in the mapping. The budget is
    ``floor(budget_share * all tokens)``. Null names of a level read as ``unknown``; a
    null or empty text has no tokens. The last epoch of a leaf ends before the document
    that would exceed the budget. Rows that share a document id within a leaf are chosen
    together, null ids too. An empty table gives an empty mix.
    """
    dom, lan, src, uid, tokens, epochs, epoch = fresh(
        docs, "domain", "lang", "source", "uid", "tokens", "epochs", "epoch"
    )
    named = docs.withColumns(
        {
            dom: F.coalesce(domain, F.lit("unknown")),
            lan: F.coalesce(F.col(lang).cast("string"), F.lit("unknown")),
            src: F.coalesce(F.col(source).cast("string"), F.lit("unknown")),
            uid: F.coalesce(F.col(doc_id).cast("string"), F.lit("")),
        }
    )
    own = dict(zip((dom, lan, src, uid), (*LEVELS, "uid")))
    slim = written(
        named.select(*[F.col(a).alias(b) for a, b in own.items()], token_count(F.col(text)).alias("n")),
        "tokens",
    )
    chunks = max(1, slim.count() // CHUNK_DOCS)
    leaves = slim.groupBy(*LEVELS).agg(F.sum("n").alias("tokens"))
    total = slim.agg(F.floor(F.coalesce(F.sum("n"), F.lit(0)) * F.lit(budget_share)).alias("total")).scalar()
    given = leaf_budgets(leaves, total, weights, max_epochs)
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0)
    plan = written(
        given.withColumn("whole", whole.cast("bigint")).withColumn(
            "rest", F.col("budget") - F.col("whole") * F.col("tokens")
        ),
        "budgets",
    )
    # One row per document of a leaf, placed by its hash in the leaf's last epoch.
    units = (
        slim.join(plan.where("rest > 0").select(*LEVELS, "whole", "rest"), list(LEVELS))
        .groupBy(*LEVELS, "uid", "whole", "rest")
        .agg(F.sum("n").alias("n"))
        .withColumn("h", seeded_order(F.col("uid"), F.col("whole"), seed))
        .withColumn("chunk", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / 2.0**32 * chunks))
    )
    summed = running(units, list(LEVELS), "chunk", ["h", "uid"], sums={"upto": F.col("n")})
    cuts = (
        summed.where("upto <= rest").groupBy(*LEVELS).agg(F.max(F.struct("h", "uid")).alias("cut"))
    )
    leaf = written(plan.join(cuts, list(LEVELS), "left"), "cuts").select(
        F.col("domain").alias(dom),
        F.col("lang").alias(lan),
        F.col("source").alias(src),
        F.col("whole").alias(epochs),
        F.col("cut").alias(epoch),
    )
    key = F.struct(seeded_order(F.col(uid), F.col(epochs), seed).alias("h"), F.col(uid).alias("uid"))
    times = F.col(epochs) + F.when(key <= F.col(epoch), 1).otherwise(0)
    chosen = (
        named.join(leaf, [dom, lan, src])
        .withColumn(epochs, times)
        .where(F.col(epochs) > 0)
        .withColumn(epoch, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(epochs) - 1)))
        .withColumn(tokens, token_count(F.col(text)))
        .select(*docs.columns, dom, tokens, epoch)
    )
    return chosen, {"domain": dom, "tokens": tokens, "epoch": epoch}
