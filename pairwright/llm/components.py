"""Connected components of a distributed edge list.

Alternates the large-star and the small-star step (Kiveris et al., 2014): every step links
the neighbours of a node to the smallest of them, until each component is one star.  Minima
are aggregated before the shuffle and joined back, so a hub is never gathered in one task
(AQE may split its partition); every round is landed.
"""

import numpy as np
from pyspark.sql import DataFrame, functions as F

from pairwright.llm.shared import landed


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of one task as stars: (node, smallest node of its component), the smallest itself left out."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("root", "node")).toDF("node", "near")
    low = both.groupBy("node").agg(F.least(F.min("near"), F.col("node")).alias("low"))
    return both.where("near > node").join(low, "node").select(F.col("near").alias("node"), F.col("low").alias("root"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("node", "root").alias("node"), F.least("node", "root").alias("near"))
    low = down.groupBy("node").agg(F.min("near").alias("low"))
    moved = down.join(low, "node").where("near <> low").select(F.col("near").alias("node"), F.col("low").alias("root"))
    return moved.union(low.select("node", F.col("low").alias("root")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(``node``, ``root``) of every node with a link, from (``node``, ``root``) links in any direction.

    ``root`` is the smallest node of the component; loops are ignored, an empty edge list
    gives an empty table.
    """
    edges = landed(edges.where("node <> root").select("node", "root").distinct(), name)
    before, now = None, _state(edges)
    while now != before and now[0]:
        edges = landed(_small_star(_large_star(edges).distinct()).distinct(), name)
        before, now = now, _state(edges)
    return edges.union(edges.select("root", "root").distinct())
