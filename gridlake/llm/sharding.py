"""Sharding by a hierarchical weighted hash tree, with DataFrame functions only.

A key descends region, rack and shard. At each node every child draws ln(u) / weight, u a hash of key and
child in (0, 1), and the largest draw wins, so a child gets its weight's share. A draw depends on the key,
the child's own path and its weight: when weights change below one subtree, a key moves only into or out
of subtrees whose weight changed, or within them.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.llm.common import rank_within


@dataclass(frozen=True)
class Node:
    """name is unique among siblings. A leaf has a shard and a weight; other weights are sums."""

    name: str
    weight: float = 0.0
    children: tuple["Node", ...] = ()
    shard: int | None = None

    def total(self) -> float:
        return sum(c.total() for c in self.children) if self.children else self.weight


def tree(shards: int, base: int = 40, per_rack: int = 5, racks: int = 2, weights: dict[int, float] | None = None) -> Node:
    """The layout for a number of shards: base shards in full regions, each later shard a region of its own.

    No subtree of tree(n) changes in tree(n + 1) from base on, so the new shard takes rows and no other
    gets any. The layout follows from the number alone.
    """
    weight = weights or {}
    regions: dict[str, dict[str, list[Node]]] = {}
    for s in range(shards):
        region, rack = (f"region-{s // (per_rack * racks)}", f"rack-{s // per_rack}") if s < base else (f"added-{s}", f"rack-added-{s}")
        regions.setdefault(region, {}).setdefault(rack, []).append(Node(f"shard-{s}", weight.get(s, 1.0), (), s))
    return Node("root", 0.0, tuple(Node(r, 0.0, tuple(Node(k, 0.0, tuple(leaves)) for k, leaves in found.items())) for r, found in regions.items()))


def _key(path: str) -> int:
    return int.from_bytes(hashlib.sha256(path.encode()).digest()[:8], "big", signed=True)


def choose(root: Node, key: Column) -> Column:
    """The shard a key gets. A null key draws by the children's hashes alone, always the same shard."""
    tables: list[list[tuple[int, float, int]]] = []
    depth = 0

    def visit(node: Node, path: str, level: int) -> int:
        nonlocal depth
        depth = max(depth, level + 1)
        here = len(tables)
        tables.append([])
        for child in sorted(node.children, key=lambda c: c.name):
            if child.total() > 0:
                below = f"{path}/{child.name}"
                target = visit(child, below, level + 1) if child.children else -1 - int(child.shard)
                tables[here].append((_key(below), child.total(), target))
        return here

    visit(root, root.name, 0)
    rows = ", ".join("array(" + ", ".join(f"named_struct('k', {k}L, 'w', {w!r}D, 't', {t})" for k, w, t in kids) + ")" for kids in tables)
    nodes = F.expr(f"array({rows})".replace("-9223372036854775808L", "(-9223372036854775807L - 1L)"))
    at = F.lit(0)
    for _ in range(depth):

        def draw(kid: Column) -> Column:
            u = (F.shiftrightunsigned(F.xxhash64(key, kid["k"]), 11).cast("double") + 0.5) * F.lit(2.0**-53)
            return F.struct((F.log(u) / kid["w"]).alias("d"), kid["k"].alias("k"), kid["t"].alias("t"))

        down = F.array_max(F.transform(nodes[F.greatest(at, F.lit(0))], draw))["t"]
        at = F.when(at < 0, at).otherwise(down)
    return (-1 - at).cast("int")


def shard_documents(docs: DataFrame, shards: int = 40, base: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard of every document: id, size, text_crc32, law, shard, slot, grown_shard.

    size: UTF-8 bytes plus 16 (null text: 16, its crc that of the empty text). slot: gapless from 0 in a
    shard. grown_shard: with one shard more. Equal ids, also null ones, share a shard; repeated rows get a
    slot each. Texts don't travel: sizes and sums are made where the rows are read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.col(id_col)
    rows = docs.select(
        key,
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        choose(tree(shards, base), key).alias("shard"),
        choose(tree(shards + 1, base), key).alias("grown_shard"),
    )
    return rank_within(rows, ["shard"], [id_col, "text_crc32", "size"], "slot").select(id_col, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
