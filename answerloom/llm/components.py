"""Connected components of an edge table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.llm.common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that some edge (a, b) of longs touches; all nodes of a component share a root.

    Each round hooks every node to the least node next to it, and contracts the edges to the hooks. Node numbers that
    are hashes make the expected number of rounds logarithmic in the length of the longest path. A node with very many
    edges costs nothing special: least neighbours are pre-aggregated, and renaming an edge's ends is a join that
    adaptive execution splits. Each round is written to the shared folder; the node tables are then composed backwards.
    """
    edges = materialize(edges.select("a", "b").where("a != b"))
    hooks: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.least("a", F.min("b")).alias("root")).select(F.col("a").alias("node"), "root")
        hooks.append(materialize(hook))
        of_a = hooks[-1].select(F.col("node").alias("a"), F.col("root").alias("ra"))
        of_b = hooks[-1].select(F.col("node").alias("b"), F.col("root").alias("rb"))
        renamed = edges.join(of_a, "a").join(of_b, "b").where("ra != rb")
        edges = materialize(renamed.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if not hooks:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = hooks.pop()
    while hooks:
        later = out.select(F.col("node").alias("root"), F.col("root").alias("_later"))
        out = materialize(hooks.pop().join(later, "root", "left").select("node", F.coalesce("_later", "root").alias("root")))
    return out
