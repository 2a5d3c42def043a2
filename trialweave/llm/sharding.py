"""Sharding by a hierarchical weighted hash tree."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.llm.common import hex_bucket, ranked


@dataclass(frozen=True)
class Node:
    """A region, rack or shard.  ``shard`` is set on leaves only."""

    name: str
    weight: float = 1.0
    children: tuple[Node, ...] = field(default=())
    shard: int | None = None

    def total(self) -> float:
        return sum(c.total() for c in self.children) if self.children else self.weight


def even_tree(regions: int, racks: int, shards: int) -> Node:
    """``regions x racks x shards`` leaves of weight 1, numbered in order."""
    n = iter(range(regions * racks * shards))
    return Node("root", children=tuple(
        Node(f"g{g}", children=tuple(
            Node(f"g{g}r{r}", children=tuple(Node(f"g{g}r{r}s{s}", shard=next(n)) for s in range(shards)))
            for r in range(racks))) for g in range(regions)))


def leaves(tree: Node) -> list[Node]:
    return [x for c in tree.children for x in leaves(c)] if tree.children else [tree]


def with_shard(tree: Node, weight: float = 1.0) -> Node:
    """``tree`` and one more shard, in a region of its own.

    No weight of an old subtree changes, so no draw between old nodes changes: rows move
    only into the new shard.
    """
    k = len(tree.children)
    leaf = Node(f"g{k}r0s0", weight, shard=max(x.shard for x in leaves(tree)) + 1)
    rack = Node(f"g{k}r0", children=(leaf,))
    return Node(tree.name, children=(*tree.children, Node(f"g{k}", children=(rack,))))


def draw(key: Column, name: Column, weight: Column) -> Column:
    """A node's weighted draw, ``-ln(u) / weight``; the least among siblings wins.

    ``u`` is 52 bits of md5(node name | key), shifted off 0.
    """
    bits = F.conv(F.substring(F.md5(F.concat(name, F.lit("|"), key)), 1, 13), 16, 10).cast("double")
    return -F.log((bits + F.lit(1.0)) / F.lit(2.0**52 + 1)) / weight


def inner(tree: Node) -> list[Node]:
    return [tree, *(x for c in tree.children for x in inner(c))] if tree.children else []


def depth(tree: Node) -> int:
    return 1 + max(map(depth, tree.children)) if tree.children else 0


def descend(rows: DataFrame, key: str, tree: Node, out: str) -> DataFrame:
    """Add ``out``: the shard that ``key`` reaches.  Only the subtrees on its way are drawn for."""
    below = F.create_map(*[x for n in inner(tree) for x in (F.lit(n.name), F.array(*[
        F.struct(F.lit(c.name).alias("name"), F.lit(float(c.total())).alias("weight")) for c in n.children]))])
    at = rows.withColumn("__at", F.lit(tree.name))
    for _ in range(depth(tree)):
        drawn = F.transform(F.try_element_at(below, F.col("__at")), lambda c: F.struct(
            draw(F.col(key), c["name"], c["weight"]).alias("s"), c["name"].alias("name")))
        at = at.withColumn("__at", F.coalesce(F.array_min(drawn)["name"], "__at"))
    number = F.create_map(*[x for n in leaves(tree) for x in (F.lit(n.name), F.lit(n.shard))])
    return at.withColumn(out, F.element_at(number, F.col("__at"))).drop("__at")


def shard(docs: DataFrame, tree: Node | None = None, id_col: str = "doc_id", text_col: str = "text", digits: int = 2) -> DataFrame:
    """Put every row into a shard of ``tree`` (24 shards: 2 regions x 3 racks x 4).

    The law is ``key``: the id and the tree decide, nothing else.  At each level the row
    goes to the child with the least weighted draw, so a change of weights moves rows only
    into or out of the subtrees whose weights changed.  ``grown_shard`` is the shard in
    ``with_shard(tree)``.

    ``slot`` is gapless from 0 in each shard.  Rows of a shard are numbered in
    ``16**digits`` parts by id, size and checksum (see
    :func:`~trialweave.llm.common.ranked`), so no task holds a whole shard, nor all rows of
    one id or without one; raise ``digits`` with the table.

    Returns ``id_col``, ``size`` (UTF-8 bytes plus 8), ``text_crc32``, ``law``, ``shard``,
    ``slot``, ``grown_shard``.  A null text has no bytes and the checksum of the empty text.
    A null id is one key of its own; equal ids share a shard and have slots of their own.
    Other columns are not read.  An empty table gives an empty result.
    """
    tree = tree or even_tree(2, 3, 4)
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    rows = docs.select(
        F.col(id_col).alias("id"), key.alias("key"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = descend(descend(rows, "key", tree, "shard"), "key", with_shard(tree), "grown_shard")
    out = ranked(rows, "shard", ["key", "size", "text_crc32"], hex_bucket(F.concat_ws("|", "key", "size", "text_crc32"), digits), "slot")
    return out.select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.col("grown_shard").cast("int").alias("grown_shard"))


def expected_share(tree: Node) -> dict[int, float]:
    """Each shard's expected share of the keys."""
    total = tree.total()
    return {x.shard: x.weight / total for x in leaves(tree)} if total and math.isfinite(total) else {}


def _node_sql(node: Node) -> str:
    """The shard below ``node`` as SQL: the least draw among its children, all the way down."""
    if not node.children:
        return str(node.shard)
    draws = ", ".join(
        f"{{'s': -ln((('0x' || substr(md5('{c.name}|' || key), 1, 13))::BIGINT + 1) / 4503599627370497.0) / {float(c.total())}, 'i': {_node_sql(c)}}}" for c in node.children)
    return f"list_min([{draws}]).i"


def oracle(tree: Node) -> str:
    """The query as SQL; the checksum goes bit by bit, from each byte's lowest, over the reflected polynomial."""
    return f"""
WITH k AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS key, encode(coalesce(text, '')) AS raw FROM documents),
b AS (SELECT *, string_split(CAST(CAST(raw AS BIT) AS VARCHAR), '') AS bits FROM k WHERE octet_length(raw) > 0),
c AS (SELECT doc_id, key, octet_length(raw) + 8 AS size,
      xor(list_reduce(list_transform(range(8 * octet_length(raw)), lambda i: bits[i - 2 * (i % 8) + 8]::BIGINT),
          lambda crc, bit: xor(crc >> 1, 3988292384 * (xor(crc, bit) & 1)), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32 FROM b
      UNION ALL SELECT doc_id, key, 8, 0 FROM k WHERE octet_length(raw) = 0),
s AS (SELECT *, {_node_sql(tree)} AS shard, {_node_sql(with_shard(tree))} AS grown_shard FROM c)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY substr(md5(key || '|' || size || '|' || text_crc32), 1, 2), key, size, text_crc32) - 1 AS slot, grown_shard FROM s
"""
