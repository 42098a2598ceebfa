"""Links within buckets of rows, and the components that they make.

Rows that can be linked share a bucket. In each bucket all members are compared with one hub, the member that shares most
buckets with others: a linear number of pairs. Then members outside a bucket's main component are compared with another
member of that component, some times more. In buckets that still hold several components, all members outside the main
one are compared with all others, in blocks of bounded size; a block gives one link for each pair of components that it
joins. Nothing is capped, and no bucket is gathered whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrust.llm.common import saved

#: Members of a block in which all pairs of a bucket are compared.
BLOCK = 256
#: Rows that go to Python in one piece, about; a block adds at most 2 * BLOCK of one bucket.
DEALT_ROWS = 1000
#: Edges up to which the star steps broadcast the minima and run in as many tasks as the session has cores: a step over
#: so few rows costs what its tasks cost. More edges go through shuffle joins in all partitions.
FEW_EDGES = 100_000


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (the smallest node reachable) of an undirected graph with edges a, b.

    Alternating large-star and small-star steps until nothing changes; the table of each step is written out. In all of
    them a > b, and no step adds edges.
    """
    cores = edges.sparkSession.sparkContext.defaultParallelism

    def gathered(table: DataFrame) -> DataFrame:
        return table.coalesce(cores) if few else table

    def beside(table: DataFrame) -> DataFrame:
        return F.broadcast(table) if few else table

    def large_star(e: DataFrame) -> DataFrame:
        up = e.select(F.col("b").alias("u"), F.col("a").alias("v"))
        both = up.union(e.select(F.col("a").alias("u"), F.col("b").alias("v")))
        least = gathered(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        out = up.join(beside(least), "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return out if few else out.distinct()  # few repeated edges cost less than a shuffle

    def small_star(e: DataFrame) -> DataFrame:
        down = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = gathered(down.groupBy("u").agg(F.min("v").alias("m")))
        over = down.join(beside(least), "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return gathered(over.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    current = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = mark(current)
    few = before[0] <= FEW_EDGES
    for _ in range(rounds):
        if not before[0]:
            break
        current = saved(small_star(large_star(current)), "stars")
        now = mark(current)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("a").alias("node"), F.col("b").alias("component"))


def pairs_with(rows: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs a > b of node and hub whose sizes (size, hub_size) allow a link."""
    fit = rows.where(f"node <> hub and 100 * least(size, hub_size) >= {percent} * greatest(size, hub_size)")
    return fit.select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")).distinct()


def with_main(members: DataFrame, found: DataFrame) -> DataFrame:
    """members of the buckets that hold several components, with component and the bucket's main one and counts."""
    placed = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    each = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    split = each.groupBy("key").agg(F.max(F.struct("n", (-F.col("component")).alias("no"))).alias("most"), F.sum("n").alias("m")).where("m > most.n")
    return saved(placed.join(split.select("key", (-F.col("most.no")).alias("main"), F.col("most.n").alias("n_main"), (F.col("m") - F.col("most.n")).alias("n_minor")), "key"), "split")


def block_rows(split: DataFrame) -> DataFrame:
    """The rows of with_main dealt to blocks (key, i, j, alone): members outside the main component are side 0 and meet
    each other and, on side 1, the main component's members."""
    minor, main = split.where("component <> main"), split.where("component = main")
    count = lambda c: F.greatest(F.lit(1).cast("long"), F.ceil(F.col(c) / BLOCK))
    block = lambda c: F.pmod(F.xxhash64("node"), count(c))
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), count(c) - 1))
    columns = ["key", "i", "j", "alone", "side", "node", "component", "size"]
    among = minor.withColumn("own", block("n_minor")).withColumn("other", upto("n_minor")).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    among = among.withColumns({"alone": F.col("i") == F.col("j"), "side": F.when(F.col("own") == F.col("i"), 0).otherwise(1)}).where("n_minor > 1").select(columns)
    asked = minor.withColumn("i", block("n_minor")).withColumn("j", upto("n_main")).withColumns({"j": -1 - F.col("j"), "alone": F.lit(False), "side": F.lit(0)}).select(columns)
    asked_of = main.withColumn("j", -1 - block("n_main")).withColumn("i", upto("n_minor")).withColumns({"alone": F.lit(False), "side": F.lit(1)}).select(columns)
    return among.unionByName(asked).unionByName(asked_of)


def dealt(blocks: DataFrame) -> DataFrame:
    """block_rows with `dealt`: most buckets are small, and many are handed to Python together."""
    blocks = saved(blocks, "blocks")
    return blocks.withColumn("dealt", F.pmod(F.xxhash64("key", "i", "j"), F.lit(max(1, blocks.count() // DEALT_ROWS))))


def joined(keys: DataFrame, percent: int, verified: Callable[[DataFrame], DataFrame], in_blocks: Callable[[DataFrame], DataFrame], more_hubs: int = 2) -> DataFrame:
    """node, component of the rows that are linked with any other.

    keys: node, size, key (a bucket), saved. Rows whose sizes differ by more than percent are never linked. verified
    gives those of some pairs a, b that are links, saved; in_blocks gives the links within the rows of block_rows, of which
    one for each pair of components is enough. Where a step finds no link, the components stay as they are.
    """
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key", "n")
    members = saved(keys.join(shared, "key"), "members")
    weight = members.groupBy("node").agg(F.sum("n").alias("weight"))
    hubs = members.join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", (-F.col("node")).alias("no"), "size")).alias("hub"))
    first = members.join(hubs, "key").select("node", (-F.col("hub.no")).alias("hub"), "size", F.col("hub.size").alias("hub_size"))
    found = components(verified(pairs_with(first, percent)))
    split = with_main(members, found)
    for turn in range(more_hubs):
        # a hub that is the same in many buckets keeps the number of different pairs small
        other = split.where("component = main").groupBy("key").agg(F.max(F.struct(F.xxhash64("node", F.lit(turn)).alias("order"), "node", "size")).alias("hub"))
        asked = split.where("component <> main").join(other, "key").select("node", F.col("hub.node").alias("hub"), "size", F.col("hub.size").alias("hub_size"))
        links = verified(pairs_with(asked, percent))
        if links.isEmpty():
            continue
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links))
        split = with_main(members, found)
    more = saved(in_blocks(split), "links")
    return found if more.isEmpty() else components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
