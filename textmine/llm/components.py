"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmine.llm.common import staged


def _through(df: DataFrame, col: str, mapping: DataFrame) -> DataFrame:
    """``df`` with ``col`` replaced by its value in ``mapping`` (node, root), where it has one."""
    m = mapping.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    return df.join(m, df[col] == m["_node"], "left").withColumn(col, F.coalesce("_root", col)).drop("_node", "_root")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the smallest node of its component.

    Each round hooks every node to its smallest neighbour, shortens the hooks
    twice, and contracts the graph; only edges between different roots go on,
    so the table shrinks by a factor each round.  Nodes, edges and roots stay
    distributed; each round is written to the shared folder.
    """
    edges = staged(edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    roots = None
    while True:
        both = edges.select(F.col("u").alias("node"), F.col("v").alias("to")).unionByName(
            edges.select(F.col("v").alias("node"), F.col("u").alias("to")))
        hook = both.groupBy("node").agg(F.min("to").alias("root")).select("node", F.least("node", "root").alias("root"))
        hook = staged(hook, "hooks")
        for _ in range(2):
            hook = staged(_through(hook, "root", hook), "hooks")
        roots = hook if roots is None else staged(_through(roots, "root", hook), "roots")
        edges = _through(_through(edges, "u", hook), "v", hook).filter("u <> v")
        edges = staged(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
        if edges.isEmpty():
            return roots
