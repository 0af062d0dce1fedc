"""A Merkle tree over a dataset's rows: every row's authentication path by fractal traversal of aligned blocks, and a check of any row.

Leaves are digests of whole rows, made by built-in functions; only digests move from there on. They are sorted by group and key over
ranges, so that no group needs to fit one task, and numbered by adding up what earlier ranges hold. ARITY ** LEVELS neighbouring leaves
are an aligned block. Going up, each block becomes its root, and blocks of roots become theirs, until one node of a group is left; the
groups' roots are then leaves of one more tree. Going down, each block gets the path of its root first and appends it to its leaves' own.

Inside a block, subtrees of HEIGHT levels are stacked. Of the lowest, the existing one gives the siblings of successive leaves while the
desired one, next to it, is completed by one leaf a step; it takes over when the existing one is used up. The subtrees above do the same
over the roots of those below, at their own pace. So a task keeps two subtrees a level of the stack, and the leaves of one block.

A null column is written `-`, any other value with its length in bytes. Rows of equal group and key are ordered by digest; repeated rows
are leaves of their own. Null keys and a null group come first. Texts may be empty or of any length. An empty table gives no rows. Other
columns are not read and may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from cellweave.llm.shared import cut

#: Children of a node, levels of a block, and levels of a subtree in it.
ARITY, LEVELS, HEIGHT = 8, 4, 2


def digest_of(columns: dict[str, Column]) -> Column:
    """SHA-256 of a row's values: each `-` if null, else its UTF-8 byte count, a colon and the value."""
    text = [c.cast("string") for c in columns.values()]
    parts = [F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in text]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def joined(nodes: list[bytes]) -> bytes:
    """The parent of nodes; all in lower-case hex."""
    return hashlib.sha256(b"".join(nodes)).hexdigest().encode()


class Subtree:
    """Nodes of some levels above a run of nodes that come one by one; parents are made as soon as their children are there."""

    def __init__(self, height: int, arity: int):
        self.arity, self.rows = arity, [[] for _ in range(height + 1)]

    def add(self, node: bytes, level: int = 0) -> None:
        self.rows[level].append(node)
        if level + 1 < len(self.rows) and len(self.rows[level]) % self.arity == 0:
            self.add(joined(self.rows[level][-self.arity :]), level + 1)

    def close(self) -> None:
        """No more nodes come: a last run of fewer becomes a parent too."""
        for level in range(len(self.rows) - 1):
            if rest := len(self.rows[level]) % self.arity:
                self.add(joined(self.rows[level][-rest:]), level + 1)

    def siblings(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        """What stands left and right of the i-th node in its run, level by level."""
        for row in self.rows[:-1]:
            first = i - i % self.arity
            yield b"".join(row[first:i]), b"".join(row[i + 1 : first + self.arity])
            i //= self.arity


def block_root(leaves: list[bytes], levels: int, arity: int) -> bytes:
    tree = Subtree(levels, arity)
    for x in leaves:
        tree.add(x)
    tree.close()
    return tree.rows[-1][0]


def traverse(leaves: list[bytes], levels: int, arity: int, height: int) -> Iterator[list[tuple[bytes, bytes]]]:
    """Successive paths (left, right by level) of a block's leaves up to its root."""
    if not levels:
        yield from ([] for _ in leaves)
        return
    low = min(height, levels)
    span = arity**low

    def grown(start: int) -> Iterator[Subtree]:
        """The subtree from this leaf on, after each leaf that it takes in, and complete."""
        tree = Subtree(low, arity)
        for x in leaves[start : start + span]:
            tree.add(x)
            yield tree
        tree.close()
        yield tree

    roots = [block_root(leaves[k : k + span], low, arity) for k in range(0, len(leaves), span)]
    above = traverse(roots, levels - low, arity, height)
    for existing in grown(0):
        pass
    for start in range(0, len(leaves), span):
        growing, desired, upper = grown(start + span), existing, next(above)
        for i in range(min(span, len(leaves) - start)):
            desired = next(growing, desired)
            yield [*existing.siblings(i), *upper]
        for desired in growing:
            pass
        existing = desired


def fold(node: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    for left, right in path:
        node = joined([left, node, right])
    return node


def levels_of(n: int, arity: int, most: int) -> int:
    """Levels that a block of a tree over n nodes has: as many as leave one node, at most so many."""
    k = 0
    while n > 1 and k < most:
        n, k = -(-n // arity), k + 1
    return k


def pack(path: list[tuple[bytes, bytes]]) -> bytes:
    """A path in bytes: of each level the numbers of siblings left and right, two bytes each, then their digests."""
    return b"".join((len(a) // 64).to_bytes(2, "big") + (len(z) // 64).to_bytes(2, "big") + bytes.fromhex((a + z).decode()) for a, z in path)


def unpack(blob: bytes) -> list[tuple[bytes, bytes]]:
    path, i = [], 0
    while i < len(blob):
        a, z = int.from_bytes(blob[i : i + 2], "big"), int.from_bytes(blob[i + 2 : i + 4], "big")
        i += 4
        end = i + 32 * (a + z)
        path.append((blob[i : i + 32 * a].hex().encode(), blob[i + 32 * a : end].hex().encode()))
        i = end
    return path


class Tree:
    """The steps over node tables (grp, rank, n, node, ...): n nodes of a group, numbered by rank."""

    def __init__(self, arity: int = ARITY, levels: int = LEVELS, height: int = HEIGHT):
        self.arity, self.levels, self.height, self.block = arity, levels, height, arity**levels

    def ranked(self, nodes: DataFrame, order: list[str]) -> DataFrame:
        """Nodes (grp, node, order columns, ...) with rank in their group by these columns, and n, the group's size."""
        placed = nodes.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order).withColumn("at", F.monotonically_increasing_id())
        placed = cut(placed.withColumn("part", F.shiftright("at", 33)), "placed")
        runs = placed.groupBy("grp", "part").agg(F.min("at").alias("first"), F.count("*").alias("own"))
        of = W.Window.partitionBy("grp")
        before = F.sum("own").over(of.orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1))
        runs = runs.select("grp", "part", "first", F.coalesce(before, F.lit(0)).alias("before"), F.sum("own").over(of).alias("n"))
        return placed.join(runs, ["grp", "part"]).withColumn("rank", F.col("at") - F.col("first") + F.col("before")).drop("at", "first", "before", "part")

    def blocks(self, nodes: DataFrame):
        return nodes.withColumn("blk", F.expr(f"rank div {self.block}")).groupBy("grp", "blk")

    def up(self, nodes: DataFrame) -> list[DataFrame]:
        """Node tables from nodes to one node a group."""
        tree = self

        def root(key: tuple, t: pa.Table) -> pa.Table:
            n = t["n"][0].as_py()
            leaves = [x.hex().encode() for x in t.sort_by("rank")["node"].to_pylist()]
            out = block_root(leaves, levels_of(n, tree.arity, tree.levels), tree.arity)
            return pa.table({"grp": [key[0].as_py()], "rank": pa.array([key[1].as_py()], pa.int64()), "n": pa.array([-(-n // tree.block)], pa.int64()), "node": [bytes.fromhex(out.decode())]})

        tables = [nodes]
        most = nodes.agg(F.max("n")).first()[0] or 0
        while most > 1:
            tables.append(cut(self.blocks(tables[-1]).applyInArrow(root, "grp string, rank long, n long, node binary"), "nodes"))
            most = -(-most // self.block)
        return tables

    def walk(self, t: pa.Table) -> Iterator[tuple[int, list[tuple[bytes, bytes]]]]:
        """Row and path of each node of a block's table, in order of rank."""
        rank = t["rank"].to_pylist()
        order = sorted(range(len(rank)), key=rank.__getitem__)
        nodes, n = t["node"].to_pylist(), t["n"][0].as_py()
        leaves = [nodes[i].hex().encode() for i in order]
        yield from zip(order, traverse(leaves, levels_of(n, self.arity, self.levels), self.arity, self.height), strict=True)

    def down(self, tables: list[DataFrame], top: DataFrame) -> DataFrame:
        """Paths (grp, rank, subroot, root, path) of the nodes of the last but one table and on to the second; top has those of the last."""
        tree = self

        def paths(key: tuple, t: pa.Table, above: pa.Table) -> pa.Table:
            upper, subroot, root = (above[c][0].as_py() for c in ("path", "subroot", "root"))
            rows = [(t["rank"][i].as_py(), pack(path) + upper) for i, path in tree.walk(t)]
            return pa.table({"grp": [key[0].as_py()] * len(rows), "rank": pa.array([r for r, _ in rows], pa.int64()), "subroot": [subroot] * len(rows), "root": [root] * len(rows), "path": [p for _, p in rows]})

        for table in reversed(tables[1:-1]):
            top = cut(self.blocks(table).cogroup(top.groupBy("grp", "rank")).applyInArrow(paths, PATHS), "paths")
        return top


PATHS = "grp string, rank long, subroot binary, root binary, path binary"


def merkle_manifest(docs: DataFrame, columns: list[str], key: str, group: str, probe: dict[str, Column] | None = None, proofs: bool = False, tree: Tree | None = None) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of each row, digests in lower-case hex; with proofs, also proof: the
    siblings' hex digests in one string. probe: columns to be checked in place of the row's own (null: as they are), folded over the
    row's original siblings."""
    tree = tree or Tree()
    own = {c: F.col(c) for c in columns}
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit("")).alias("grp"), F.col(key).alias("key"), digest_of(own).alias("node"),
        digest_of(own | (probe or {})).alias("probe"), F.monotonically_increasing_id().alias("tie"),
    )
    leaves = leaves.withColumn("probe", F.when(F.col("probe") != F.col("node"), F.col("probe")))
    leaves = cut(tree.ranked(cut(leaves, "leaves"), ["key", "node", "tie"]), "ranked")
    tables = tree.up(leaves)
    subroots = tree.ranked(tables[-1].select(F.lit("").alias("grp"), F.col("grp").alias("name"), "node"), ["name"])
    tops = tree.up(cut(subroots, "subroots"))
    path = F.lit(b"").cast("binary").alias("path")
    top = tops[-1].select("grp", "rank", F.col("node").alias("subroot"), F.col("node").alias("root"), path)
    first = [tops[0], *tops] if len(tops) > 1 else tops  # one more step, to the subroots themselves
    top = tree.down(first, top).select("rank", "root", "path")
    top = tops[0].select("name", "rank", "node").join(top, "rank").select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("rank"), F.col("node").alias("subroot"), "root", "path")
    top = tree.down(tables, cut(top, "tops"))
    kind = docs.schema[key].dataType.simpleString()

    def check(t: pa.Table, above: pa.Table, single: bool) -> pa.Table:
        upper = unpack(above["path"][0].as_py())
        tail = b"".join(a + z for a, z in upper)
        subroot, root = (above[c][0].as_py().hex() for c in ("subroot", "root"))
        keys, nodes, probes = t["key"], t["node"].to_pylist(), t["probe"].to_pylist()
        order, out = [], []
        for i, path in [(k, []) for k in range(len(nodes))] if single else tree.walk(t):
            proof = b"".join(a + z for a, z in path) + tail
            folded = fold((probes[i] or nodes[i]).hex().encode(), path + upper).decode()
            order.append(i)
            out.append((nodes[i].hex(), subroot, root, hashlib.sha256(proof).hexdigest(), folded, folded == root, proof.decode() if proofs else None))
        names = ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "proof")
        return pa.table({"key": keys.combine_chunks().take(pa.array(order, pa.int64()))} | dict(zip(names, map(list, zip(*out, strict=True)), strict=True))).select(["key", *names[: 6 + proofs]])

    schema = f"key {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + ", proof string" * proofs
    if len(tables) == 1:  # groups of one leaf each, which is its subroot
        done = leaves.groupBy("grp").cogroup(top.groupBy("grp")).applyInArrow(lambda _key, t, above: check(t, above, True), schema)
    else:
        done = tree.blocks(leaves).cogroup(top.groupBy("grp", "rank")).applyInArrow(lambda _key, t, above: check(t, above, False), schema)
    return done.withColumnRenamed("key", key)
