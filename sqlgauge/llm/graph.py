"""Connected components of link tables, in rounds of joins, nothing on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sqlgauge.session import delete_path, work_path


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have (in any letter case)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage and survives lost executors."""
    path = path or work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_key(df: DataFrame) -> DataFrame:
    """``df`` for a join that must not send it, or the other side, to all tasks.

    Spark sizes a table by its compressed files and an exploded column as one element, so a table of
    hundreds of MB may look smaller than the broadcast limit and fill the driver's memory.
    """
    return df.hint("merge")


FEW = 100_000  # edges; tables of their ends may be sent to all tasks


class Scratch:
    """Written tables and folders of an operator's steps, removed when its result is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(work_path(self.spark, name))
        return written(df, name, self.paths[-1])

    def clear(self) -> None:
        while self.paths:
            delete_path(self.spark, self.paths.pop())


def components(links: DataFrame, a: str = "a", b: str = "b", into: Scratch | None = None) -> DataFrame:
    """(node, component) for every node of ``links``, written (``into`` a caller's scratch, if
    given); component is its smallest node.

    ``links`` is read twice, so it should be a written table. In each round every
    node moves to the neighbour (or itself) of the smallest hash, aggregated before
    the shuffle, and edges are rewritten to where their ends have moved; loops and
    repeated edges go. A group of any size that hangs on a few nodes so shrinks to
    these at once, and later rounds read only what is left. At the end the moves are
    joined in reverse order, smallest tables first.
    """
    edges = links.select(F.col(a).alias("a"), F.col(b).alias("b"))
    moves: list[DataFrame] = []
    own = Scratch(links.sparkSession)
    side = by_key
    while True:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(
            edges.select(F.col("b").alias("node"), F.col("a").alias("near")))
        ranked = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("to"))
        move = own.written(both.groupBy("node").agg(F.min(ranked("near")).alias("m"))
                       .select("node", F.least("m", ranked("node"))["to"].alias("to")), "moves")
        moves.append(move)
        ends = [move.select(F.col("node").alias(e), F.col("to").alias("to_" + e)) for e in "ab"]
        left = Observation()
        edges = own.written(edges.where("a <> b").join(side(ends[0]), "a").join(side(ends[1]), "b").where("to_a <> to_b")
                        .select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
                        .distinct().observe(left, F.count(F.lit(1)).alias("n")), "edges")
        if left.get["n"] <= FEW:
            side = lambda df: df
        if not left.get["n"]:
            break
    label = moves.pop()
    while moves:
        further = label.select(F.col("node").alias("to"), F.col("to").alias("root"))
        label = (moves.pop().join(by_key(further), "to", "left")
                 .select("node", F.coalesce("root", "to").alias("to")))
    label = own.written(label, "roots")
    least = label.groupBy("to").agg(F.min("node").alias("component"))
    out = (into.written if into else written)(label.join(by_key(least), "to").select("node", "component"), "labels")
    own.clear()
    return out


def merge_components(labels: DataFrame | None, links: DataFrame, into: Scratch | None = None) -> DataFrame:
    """``labels`` (node, component; None: nothing linked so far) after more ``links`` (a, b).

    Links are first mapped to the components they join, so only these are walked.
    """
    if labels is None:
        return components(links, into=into)
    own = Scratch(links.sparkSession)
    of_a = labels.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    of_b = labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    joined = (links.join(by_key(of_a), "a", "left").join(by_key(of_b), "b", "left")
              .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
              .where("a <> b").distinct())
    roots = components(own.written(joined, "joined"), into=own)
    moved = labels.join(by_key(roots.select(F.col("node").alias("component"), F.col("component").alias("root"))),
                        "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    out = (into.written if into else written)(moved.unionByName(roots.join(by_key(labels), "node", "left_anti")), "labels")
    own.clear()
    return out
