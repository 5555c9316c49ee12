"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source gets a target in words (water-filling of the weights under a cap of `most` times its size). Its documents
are permuted by a hash and drawn in that order, again from the start while the target lasts; a draw is a block, and
the last block of a source is cut so that its words meet the target exactly. The block quotas of the sources are then
split among the output shards: at each node of a binary tree the left half gets a multivariate-hypergeometric draw of
the node's quotas, so each shard holds a random but exact share, and the shares of all shards are disjoint ranges of
the permuted draws. Rows are shuffled within their shard by another hash.

Defined results: null text has size 0 and is never drawn; null is a source of its own, last in code-point order;
repeated rows are documents of their own; an empty table gives an empty mix. Extra columns are carried by `mixed`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from streamloom.llm.common import ranked, shuffled_order, stored, word_count


@dataclass(frozen=True)
class Mix:
    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    most: int = 2
    shard_words: int = 4_000_000


def targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """source, source_size, target from (source, size) rows. One row per source; the windows run over those rows only.

    With caps c and weights w, sources fill up in the order of c / w: the first k are at their caps, the others share
    what is left by weight. That level rises with k while sources are capped rightly and falls after, so the answer is its maximum.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, mix.weights)), (F.row_number().over(order) - 1) % len(mix.weights) + 1)
    filling = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, onward = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    return (
        per.withColumn("w", weight)
        .withColumn("cap", F.col("source_size") * mix.most)
        .withColumn("all", F.sum("source_size").over(everything) * mix.share)
        .withColumn("level", (F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(onward))
        .withColumn("open", F.max("level").over(everything))
        .select(
            "source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("open") * F.col("w"), F.col("cap"))).cast("double").alias("target")
        )
    )


def _split(quotas: list[int], left: int, node: int, seed: int) -> list[int]:
    """A multivariate-hypergeometric draw of `left` blocks from the quotas; the generator depends on the node only."""
    rng = np.random.default_rng([seed, node])
    total, out = sum(quotas), []
    for q in quotas:
        take = min(left, q) if total == q else _hypergeometric(rng, q, total - q, left)
        out.append(take)
        total, left = total - q, left - take
    return out


def _hypergeometric(rng, good: int, bad: int, n: int) -> int:
    """numpy draws below 10^9; larger counts are drawn in units and the remainder is rounded within the bounds."""
    unit = max(1, -(-max(good, bad) // 900_000_000))
    if unit == 1:
        return int(rng.hypergeometric(good, bad, n))
    g, b = good // unit, bad // unit
    x = int(rng.hypergeometric(g, b, min(n // unit, g + b))) * unit
    return max(n - bad, 0, min(x, good, n))


#: Levels of the tree that one task walks below a node before the nodes are dealt out again.
LEVELS = 8


def leaves(nodes: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """The nodes of one shard below the root. Nodes are dealt out every `LEVELS` levels and one Python step walks the levels
    between, so a task has one Python worker, however deep the tree is."""

    def descend(levels: int):
        def halve(frames):
            for frame in frames:
                out = [(int(node), int(first), int(n), [int(x) for x in q]) for node, first, n, q in frame.itertuples(index=False)]
                for _ in range(levels):
                    out = [half for node in out for half in _halves(*node, seed)]
                yield pd.DataFrame(out, columns=["node", "first", "n", "quotas"])

        return halve

    depth = max(0, (shards - 1).bit_length())
    for top in range(0, depth, LEVELS):
        nodes = nodes.repartition("node") if top else nodes
        nodes = nodes.mapInPandas(descend(min(LEVELS, depth - top)), "node long, first long, n long, quotas array<long>")
    return nodes


def _halves(node: int, first: int, n: int, q: list[int], seed: int) -> list[tuple[int, int, int, list[int]]]:
    if n == 1 or not q:
        return [(node, first, n, q)]
    half, total = n // 2, sum(q)
    # Shards differ by at most one block in all: the first total % shards of them hold one more.
    left = _split(q, (total // n) * half + min(half, total % n), node, seed)
    return [(2 * node, first, half, left), (2 * node + 1, first + half, n - half, [a - b for a, b in zip(q, left)])]


def shares(quotas: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """(source, shard, lo, hi): the range of a source's draws that go to a shard, from (source, quota) rows.

    The tree is walked level by level. A node is one row with the list of its quotas (one number per source, in a
    fixed order), and a task works on the nodes below one of them, at most 2^LEVELS.
    """
    named = quotas.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("place", "quota"))), lambda s: s["quota"])
    root = named.agg(listed.alias("quotas")).select(
        F.lit(1).cast("long").alias("node"), F.lit(0).cast("long").alias("first"), F.lit(shards).cast("long").alias("n"), "quotas"
    )
    tree = stored(leaves(root, shards, seed).select("first", "quotas"), "mix-tree")
    rows = tree.select(F.col("first").alias("shard"), F.posexplode("quotas").alias("place", "blocks"))
    past = Window.partitionBy("place").orderBy("shard")
    placed = rows.withColumn("hi", F.sum("blocks").over(past)).withColumn("lo", F.col("hi") - F.col("blocks")).where("blocks > 0")
    return placed.join(named.select("place", "source"), "place").select("source", "shard", "lo", "hi")


def planned(docs: DataFrame, mix: Mix, source: str = "source", text: str = "text") -> DataFrame:
    """Per document: size, source_size, target, its rank in the permuted order of its source, the words before it, the
    number of its draws and the words taken in each full round and in the last."""
    sized = docs.withColumn("__size", word_count(F.col(text))).withColumn("__order", shuffled_order(F.col("doc_id")))
    goals = targets(sized.select(F.col(source).alias("source"), F.col("__size").alias("size")), mix)
    goals = goals.withColumnsRenamed({"source": "__source", "source_size": "__source_size", "target": "__target"})
    # Documents without words come last in their source, so that draws are numbered without gaps.
    sized = sized.withColumn("__order", F.when(F.col("__size") > 0, F.col("__order")).otherwise(F.lit((1 << 60) - 1)))
    # The tie is a column before the texts are ranked, so that who drops the text does not shuffle it.
    sized = sized.withColumn("__tie", F.xxhash64(text))
    ties = ["doc_id", "__size", "__tie"]
    out = ranked(sized, [source], "__order", ties, rank="__rank", size="__size", before="__before").drop("__tie")
    out = out.join(goals, F.col(source).eqNullSafe(F.col("__source"))).drop("__source")
    goal, all_words = F.floor("__target"), F.col("__source_size")
    full = F.when(all_words > 0, F.floor(goal / all_words)).otherwise(0).cast("long")
    rest = F.greatest(F.least(goal - full * all_words - F.col("__before"), F.col("__size")), F.lit(0))
    return out.withColumn("__full", full).withColumn("__rest", rest.cast("long"))


def draws(plan: DataFrame, mix: Mix, source: str = "source", seed: int = 0) -> DataFrame:
    """One row per draw: `__shard`, `__place` (order in the shard) and `__words` (less than the size: the first words only)."""
    kept = plan.where("__size > 0 AND (__full > 0 OR __rest > 0)")
    per = kept.groupBy(source).agg(
        F.sum(F.col("__full") + (F.col("__rest") > 0).cast("long")).alias("quota"),
        F.count(F.lit(1)).alias("__docs"),
        F.sum(F.col("__full") * F.col("__size") + F.col("__rest")).alias("words"),
    )
    per = stored(per.withColumnRenamed(source, "source"), "mix-quotas")
    total = per.agg(F.sum("words")).first()[0] or 0
    shards = max(1, -(-int(total) // mix.shard_words))
    ranges = shares(per.select("source", "quota"), shards, seed)
    cells = ranges.select(
        F.struct("source").alias("__s"),
        F.col("shard").alias("__shard"),
        F.col("lo").alias("__lo"),
        F.col("hi").alias("__hi"),
        F.explode(F.sequence(F.expr(f"lo div {1 << 14}"), F.expr(f"(hi - 1) div {1 << 14}"))).alias("__cell"),
    )
    counts = per.select(F.struct("source").alias("__s"), "__docs")
    turns = F.sequence(F.lit(0).cast("long"), F.col("__full") + (F.col("__rest") > 0).cast("long") - 1)
    drawn = (
        kept.withColumn("__turn", F.explode(turns))
        .withColumn("__s", F.struct(F.col(source).alias("source")))
        .join(counts, "__s")
        # Draws of a source are numbered round after round; full rounds have all its documents with words.
        .withColumn("__draw", F.col("__rank") + F.col("__turn") * F.col("__docs"))
        .withColumn("__cell", F.expr(f"__draw div {1 << 14}"))
    )
    return (
        drawn.join(cells, ["__s", "__cell"])
        .where("__lo <= __draw AND __draw < __hi")
        .withColumn("__words", F.when(F.col("__turn") < F.col("__full"), F.col("__size")).otherwise(F.col("__rest")))
        .withColumn("__place", shuffled_order(F.lit(seed), F.col("doc_id"), F.col("__turn"), F.col("__rank")))
        .drop("__s", "__cell", "__lo", "__hi", "__docs", "__draw")
    )


def mixed(docs: DataFrame, mix: Mix = Mix(), source: str = "source", text: str = "text") -> DataFrame:
    """The mix itself: the input's columns, one row per draw, dealt to the shards' order. The last draw of a source may
    hold only the first words of its document."""
    plan = planned(docs, mix, source, text)
    parts = F.regexp_extract_all(F.col(text), F.lit(r"[ \t-\r]*[^ \t-\r]+"), F.lit(0))
    head = F.array_join(F.slice(parts, F.lit(1), F.col("__words").cast("int")), "")
    rows = draws(plan, mix, source).withColumn(text, F.when(F.col("__words") < F.col("__size"), head).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length(text).cast("long"))
    return rows.repartition("__shard").sortWithinPartitions("__shard", "__place").select(*docs.columns)


def report(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """One row per document; `taken` sums up its draws."""
    slim = docs.select("doc_id", "source", F.col("text"))
    plan = stored(planned(slim, mix).drop("text"), "mix-plan")
    taken = (
        draws(plan, mix)
        .groupBy(F.struct("source").alias("__s"), "__rank")
        .agg(F.sum("__words").alias("taken"), F.count(F.lit(1)).alias("n_draws"))
        .withColumnRenamed("__rank", "__r")
    )
    own = plan.withColumn("__s", F.struct("source")).withColumnRenamed("__rank", "__r")
    return own.join(taken, ["__s", "__r"], "left").select(
        "doc_id",
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        F.coalesce("n_draws", F.lit(0)).cast("long").alias("n_draws"),
    )
