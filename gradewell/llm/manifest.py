"""Merkle manifest of a table: digests of all rows under one root, with proofs.

Rows are the leaves of a tree per group; every eight consecutive nodes become
one, until one is left, and the groups' roots become the dataset's root in the
same way. Leaves are numbered by a range sort. Aligned builders each take a
block of 8^4 consecutive leaves and append its nodes to the block's log in the
order in which they are completed (postorder). A node's place in the log
follows from the sizes of the subtrees before it, so proofs read siblings by
position. The blocks' roots are the leaves of the next round, and so on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradewell.llm.common import stored

FAN = 8
LEVELS = 4  # of a block
BLOCK = FAN**LEVELS  # leaves
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ONE = "*"  # the only tree of the groups' roots


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 of the fields one after the other, each as its count of UTF-8
    bytes, a colon and its value, or a hyphen if null."""
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_place(i: int) -> int:
    """Place of leaf i in the log: the leaves before it and every node that is
    complete by then."""
    place, size = i, FAN
    while size <= i:
        place += i // size
        size *= FAN
    return place


def node_place(level: int, j: int, n: int) -> int:
    """Place of node j of a level in the log of n leaves: a node is complete,
    and appended, after its last leaf and the lower nodes that end there."""
    return leaf_place(min((j + 1) * FAN**level, n) - 1) + level


def height(n: int) -> int:
    """Levels above n leaves, until one node is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def node(parts: list[bytes]) -> bytes:
    """Digest of a node over the hexadecimal digests of its children."""
    return hashlib.sha256(b"".join(parts).hex().encode()).digest()


def block_levels(whole: int) -> int:
    """Levels that a block of a tree of ``whole`` leaves closes."""
    return min(LEVELS, height(whole))


def append_log(leaves: list[bytes], levels: int) -> bytes:
    """The block's nodes in the order of their completion."""
    log: list[bytes] = []
    open_nodes: list[list[bytes]] = [[] for _ in range(levels + 1)]

    def add(digest: bytes) -> None:
        log.append(digest)
        open_nodes[0].append(digest)

    def close(level: int) -> None:
        digest = node(open_nodes[level])
        open_nodes[level].clear()
        log.append(digest)
        open_nodes[level + 1].append(digest)

    for i, digest in enumerate(leaves):
        add(digest)
        level, size = 0, FAN
        while level < levels and ((i + 1) % size == 0 or i + 1 == len(leaves)):
            close(level)
            level, size = level + 1, size * FAN
    return b"".join(log)


def siblings(log: bytes, i: int, n: int, levels: int) -> bytes:
    """Digests of the other children of each ancestor of leaf i of a block of n
    leaves, level by level, read from the log by position."""
    out = []
    for level in range(levels):
        j, count = i // FAN**level, -(-n // FAN**level)
        first = j - j % FAN
        for s in range(first, min(first + FAN, count)):
            if s != j:
                at = 32 * node_place(level, s, n)
                out.append(log[at : at + 32])
    return b"".join(out)


def steps(index: int, size: int) -> list[tuple[int, int]]:
    """(place in its run, nodes of the run) on the way from a leaf to its root."""
    out = []
    while size > 1:
        out.append((index % FAN, min(FAN, size - (index - index % FAN))))
        index, size = index // FAN, -(-size // FAN)
    return out


def fold(leaf: bytes, proof: bytes, way: list[tuple[int, int]]) -> bytes:
    """The root that a leaf and its siblings give."""
    at = 0
    for place, count in way:
        left, right = at + 32 * place, at + 32 * (count - 1)
        leaf = node([proof[at:left], leaf, proof[left:right]])
        at = right
    return leaf


def ranked(rows: DataFrame, tree: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with their number (``index``, from 0) within their tree in the
    given order, and the ``size`` of the tree.

    Rows are sorted by range, so that a tree may span many tasks; only one
    count per tree and range goes through a window.
    """
    sort = [tree, *order]
    lined = rows.repartitionByRange(*sort).sortWithinPartitions(*sort)
    lined = stored(lined.withColumn("place", F.monotonically_increasing_id()), name)
    lined = lined.withColumn("range", F.shiftright("place", 33))
    counts = lined.groupBy(tree, "range").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy(tree).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(
        tree,
        "range",
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("n").over(Window.partitionBy(tree)).alias("size"),
    )
    found = lined.join(bases, [tree, "range"]).withColumn("index", F.col("place") + F.col("shift"))
    return found.drop("range", "place", "shift")


@dataclass
class Forest:
    """Logs of trees, one frame per round (tree, block, whole, leaves, log):
    ``whole`` and ``leaves`` count the round's leaves of the tree and of the
    block. ``roots`` has a row per tree: tree, root, size."""

    rounds: list[DataFrame]
    roots: DataFrame


def grow(leaves: DataFrame, name: str) -> Forest:
    """The logs over ``leaves`` (tree, index, size, digest)."""

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("index")
        log = append_log(group["digest"].tolist(), block_levels(int(group["whole"].iat[0])))
        row = group.iloc[:1][["tree", "block", "whole", "size"]].copy()
        row["leaves"], row["log"] = len(group), [log]
        return row

    kind = "tree string, block long, whole long, size long, leaves long, log binary"
    rounds, roots = [], []
    rows = leaves.select("tree", "index", "digest", "size", F.col("size").alias("whole"))
    while True:
        blocks = rows.withColumn("block", F.expr(f"index div {BLOCK}"))
        done = stored(blocks.groupBy("tree", "block").applyInPandas(build, kind), f"{name}-log-{len(rounds)}")
        rounds.append(done)
        last = done.select("tree", "block", "whole", "size", F.expr("substring(log, length(log) - 31, 32)").alias("digest"))
        roots.append(last.where(F.col("whole") <= BLOCK).select("tree", F.col("digest").alias("root"), "size"))
        if not done.where(F.col("whole") > BLOCK).limit(1).count():
            break
        more = last.where(F.col("whole") > BLOCK)
        rows = more.select("tree", F.col("block").alias("index"), "digest", "size", F.expr(f"(whole + {BLOCK - 1}) div {BLOCK}").alias("whole"))
    whole = roots[0]
    for each in roots[1:]:
        whole = whole.unionByName(each)
    return Forest(rounds, whole)


def prover(own: list[str], others: list[str]):
    """Adds the proofs of a block's leaves and the given other columns."""

    def prove(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = left[own].copy()
        if left.empty or right.empty:
            return out.iloc[:0].reindex(columns=[*own, "proof", *others])
        given = right.iloc[0]
        levels = block_levels(int(given["whole"]))
        log, n, beyond = given["log"], int(given["leaves"]), given["beyond"]
        out["proof"] = [siblings(log, i, n, levels) + beyond for i in (left["index"] % BLOCK).tolist()]
        for name in others:
            out[name] = given[name]
        return out

    return prove


def proofs(forest: Forest, leaves: DataFrame, above: DataFrame) -> DataFrame:
    """``leaves`` (tree, index and others) with ``proof``, their siblings from
    the first level up, and the columns of ``above`` (tree, beyond and others),
    of which ``beyond`` is added to the proof."""
    others = [c for c in above.columns if c not in ("tree", "beyond")]
    upper = None
    for at in range(len(forest.rounds) - 1, -1, -1):
        logs = forest.rounds[at].drop("size")
        final = logs.where(F.col("whole") <= BLOCK).join(above, "tree")
        if upper is not None:
            higher = upper.select("tree", F.col("index").alias("block"), F.col("proof").alias("beyond"), *others)
            final = final.unionByName(logs.where(F.col("whole") > BLOCK).join(higher, ["tree", "block"]))
        if at:
            rows = forest.rounds[at - 1].where(F.col("whole") > BLOCK).select("tree", F.col("block").alias("index"))
        else:
            rows = leaves
        rows = rows.withColumn("block", F.expr(f"index div {BLOCK}"))
        own = [f for f in rows.schema if f.name != "block"]
        kept = [f for f in above.schema if f.name in others]

        names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own)
        kind = ", ".join([names, "proof binary", *(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)])
        pairs = rows.groupBy("tree", "block").cogroup(final.groupBy("tree", "block"))
        upper = pairs.applyInPandas(prover([f.name for f in own], others), kind)
    return upper


def manifest(docs: DataFrame, carry: dict[str, Column] | None = None, fields=FIELDS, group="lang", order="doc_id") -> DataFrame:
    """One row per row of ``docs``: the ``order`` and ``group`` columns, leaf,
    subroot and root (hexadecimal), index and size (the leaf's number in its
    group and the group's leaves), group_index and groups (likewise of the
    group), proof (the siblings' digests, 32 bytes each, in the order of a
    proof) and what ``carry`` names.

    Leaves are ordered by ``order``, nulls first, and by their digest where it
    is the same; rows that repeat altogether are leaves of their own. Groups
    are ordered by their UTF-8 bytes, a null group first. A null field is not an
    empty one. An empty table gives no rows. Other columns are not digested,
    whatever their names.
    """
    carry = carry or {}
    extra = [F.struct(*[c.alias(n) for n, c in carry.items()]).alias("carried")] if carry else []
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    rows = docs.select(
        tree.alias("tree"),
        F.struct(F.col(order).alias("order"), F.col(group).alias("group")).alias("named"),
        F.unhex(leaf_digest(*[F.col(f) for f in fields])).alias("digest"),
        *extra,
    )
    rows = stored(rows, "manifest-leaves").withColumn("order", F.col("named.order"))
    leaves = ranked(rows, "tree", ["order", "digest"], "manifest-order").drop("order")
    forest = grow(leaves.select("tree", "index", "size", "digest"), "manifest")
    groups = forest.roots.select(F.lit(ONE).alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest"))
    numbered = ranked(groups, "tree", ["name"], "manifest-groups")
    top = grow(numbered.select("tree", "index", "size", "digest"), "manifest-top")
    start = top.roots.select("tree", F.lit(b"").alias("beyond"), F.col("root").alias("root"), F.col("size").alias("groups"))
    upper = proofs(top, numbered.select("tree", "index", "name", F.col("digest").alias("subroot")), start)
    above = upper.select(
        F.col("name").alias("tree"),
        F.col("proof").alias("beyond"),
        "subroot",
        "root",
        F.col("index").alias("group_index"),
        "groups",
    )
    found = proofs(forest, leaves, stored(above, "manifest-groups-proofs"))
    hexed = [F.lower(F.hex(c)).alias(c) for c in ("subroot", "root")]
    return found.select(
        F.col("named.order").alias(order),
        F.col("named.group").alias(group),
        F.lower(F.hex("digest")).alias("leaf"),
        *hexed,
        "index",
        "size",
        "group_index",
        "groups",
        "proof",
        *[F.col(f"carried.{n}").alias(n) for n in carry],
    )


def folded_root(leaf: str = "leaf") -> Column:
    """The root that a leaf (hexadecimal) and the proof of a row of
    ``manifest`` give; that of the manifest if the leaf is the row's own."""

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for own, proof, index, size, group_index, groups in batches:
            numbers = np.stack([index, size, group_index, groups], axis=1).tolist()
            yield pd.Series(
                [
                    fold(bytes.fromhex(h), p, steps(i, n) + steps(g, of)).hex()
                    for h, p, (i, n, g, of) in zip(own, proof, numbers)
                ],
                dtype=object,
            )

    return F.pandas_udf(run, "string")(leaf, "proof", "index", "size", "group_index", "groups")
