"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.session import keep


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (``a, b``); ``root`` is the least node of its component.

    Each round gives a node the least root among its neighbours and then that
    root's own root, so that chains shorten quickly.  Rounds are stored tables;
    only the number of changes reaches the driver.
    """
    edges = keep(links.where("a is not null and b is not null").select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    roots = keep(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("root")), "roots")
    while True:  # roots only sink, so this ends
        near = edges.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lower = roots.join(near, "node").select("node", "root", F.least("root", "near").alias("low"))
        jump = lower.select(F.col("low").alias("of")).distinct().join(roots.select(F.col("node").alias("of"), F.col("root").alias("up")), "of")
        new = keep(lower.join(jump, F.col("low") == F.col("of"), "left").select("node", F.least("low", F.coalesce("up", "low")).alias("root"), F.col("root").alias("old")), "roots")
        changed = new.where("root <> old").limit(1).count()
        roots = new.select("node", "root")
        if not changed:
            return roots


def stars(nodes: list[int] | np.ndarray, component: list[int] | np.ndarray) -> list[tuple[int, int]]:
    """Links from the least node of each component (one label per node) to its other nodes, so that no path is longer than two."""
    nodes, component = np.asarray(nodes, np.int64), np.asarray(component)
    order = np.lexsort((nodes, component))
    nodes, component = nodes[order], component[order]
    head = np.append(True, component[1:] != component[:-1])
    heads = nodes[np.flatnonzero(head)][np.cumsum(head) - 1]
    rest = nodes != heads
    return [*zip(heads[rest].tolist(), nodes[rest].tolist())]


def spanning_links(nodes: np.ndarray, alike_to: Callable[[int], np.ndarray]) -> list[tuple[int, int]]:
    """Links that span the components of a group: fewer than it has members, however many pairs are alike.

    ``alike_to(i)`` tells which members are alike to the ``i``-th.  The first meets all others; whatever isn't alike
    to it meets every member too, and joins all components that it touches.
    """
    component = np.arange(len(nodes))
    component[alike_to(0)] = 0
    for i in np.flatnonzero(component != 0).tolist():
        for c in np.unique(component[alike_to(i)]).tolist():
            if c != component[i]:
                component[component == c] = component[i]
    return stars(nodes, component)
