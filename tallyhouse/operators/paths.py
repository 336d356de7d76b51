"""Path patterns over node and edge tables, expressed as equi-joins."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    """Node table under a name used in the output: columns come out as ``name_column``."""

    name: str
    table: DataFrame
    key: str
    columns: Sequence[str] = ()
    where: Column | None = None


@dataclass(frozen=True)
class Edge:
    """Directed edge table from ``source`` to ``target`` key columns."""

    table: DataFrame
    source: str
    target: str


def match_path(nodes: Sequence[Node], edges: Sequence[Edge]) -> DataFrame:
    """One row per path ``nodes[0] -edges[0]-> nodes[1] -edges[1]-> ...`` (a bag: parallel edges give several rows).

    Node filters apply before any join. The joins start at the filtered end of the path, so each edge table is cut
    down to edges that can still be part of a result before it meets the next one; only the key and the asked-for
    columns of a table take part.
    """
    if len(nodes) != len(edges) + 1:
        raise ValueError("a path has one node more than edges")

    def node_rows(node: Node) -> DataFrame:
        rows = node.table if node.where is None else node.table.filter(node.where)
        picked = [F.col(c).alias(f"{node.name}_{c}") for c in node.columns]
        return rows.select(F.col(node.key).alias(f"_{node.name}"), *picked)

    backwards = nodes[-1].where is not None or nodes[0].where is None
    order = list(range(len(edges)))
    if backwards:
        order.reverse()
    found = node_rows(nodes[order[0] + 1 if backwards else order[0]])
    for i in order:
        left, right = nodes[i], nodes[i + 1]
        links = edges[i].table.select(
            F.col(edges[i].source).alias(f"_{left.name}"), F.col(edges[i].target).alias(f"_{right.name}")
        )
        known, new = (right, left) if backwards else (left, right)
        found = found.join(links, f"_{known.name}").join(node_rows(new), f"_{new.name}")
    return found.select(*[f"{n.name}_{c}" for n in nodes for c in n.columns])
