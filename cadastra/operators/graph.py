"""Graph fixpoints on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.operators.staging import stage, unstage


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, comp): the smallest id of each component of an undirected edge table.

    Each round takes the smallest of the neighbours' labels and of the label's own label, which halves the longest
    chain: the number of rounds grows with its logarithm. Every round is staged, once, and takes the place of the
    one before. A hot label is the key of a join of two plain exchanges, which adaptive execution splits.
    """
    one = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    both = stage(one.union(one.select("b", "a")).distinct(), "edges")
    labels = stage(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("comp")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("comp").alias("near")).withColumnRenamed("a", "id")
        far = labels.select(F.col("id").alias("comp"), F.col("comp").alias("far"))
        new = stage(labels.join(near, "id").join(far, "comp").select("id", F.least("comp", "near", "far").alias("comp"), F.col("comp").alias("old")), "labels")
        unstage(labels)
        labels = new.select("id", "comp")
        labels._staged_path = new._staged_path
        if new.where("comp <> old").isEmpty():
            unstage(both)
            return labels


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Ids of starts and all that is connected to them, in an undirected graph."""
    comps = connected_components(edges)
    hit = starts.join(comps, "id").select("comp").distinct()
    return comps.join(hit, "comp", "left_semi").select("id").union(starts.select("id")).distinct()


def mutual_nearest(candidates: DataFrame) -> DataFrame:
    """Of candidates (a, b, d) the pairs that are each other's nearest; ties by the other id."""
    first_b = candidates.groupBy("a").agg(F.min(F.struct("d", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    first_a = candidates.groupBy("b").agg(F.min(F.struct("d", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")
    return first_b.join(first_a, ["a", "b"])


def match_rounds(candidates: DataFrame, rounds: int = 3) -> DataFrame:
    """Mutual nearest pairs, then those of what is left, for so many rounds."""
    left, found = stage(candidates, "candidates"), None
    for _ in range(rounds):
        best = stage(mutual_nearest(left), "matched")
        found = best if found is None else found.unionByName(best)
        if best.isEmpty():
            break
        left = stage(left.join(best.select("a"), "a", "left_anti").join(best.select("b"), "b", "left_anti"), "candidates")
    return found


def assign_ids(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Serial dictatorship: rows (key) in key order each take the first free id they want.

    wanted: (key, pref, id). In each round every row without an id asks for its best id not yet refused, and
    each id stays with the smallest key that asked; a refused row asks for its next one. With one priority for
    all ids this ends in the same result as one row after another. Returns (key, id); rows left without are absent.
    """
    open_, taken = stage(wanted.join(rows, "key", "left_semi"), "wanted"), None
    while not open_.isEmpty():
        ask = open_.groupBy("key").agg(F.min(F.struct("pref", "id")).alias("w")).select("key", F.col("w.id").alias("id"), F.col("w.pref").alias("pref"))
        holders = ask.groupBy("id").agg(F.min("key").alias("holder"))
        refused = stage(ask.join(holders, "id").where(F.col("key") > F.col("holder")).select("key", "id"), "refused")
        taken = ask.join(holders, "id").where(F.col("key") == F.col("holder")).select("key", "id")
        if refused.isEmpty():
            return stage(taken, "assigned")
        open_ = stage(open_.join(refused, ["key", "id"], "left_anti"), "wanted")
    return rows.join(wanted.select("key", "id"), "key").limit(0) if taken is None else stage(taken, "assigned")
