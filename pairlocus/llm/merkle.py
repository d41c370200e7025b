"""Merkle manifest of a dataset by superblocks.

Every row is a leaf: the SHA-256 of its fields, each written with its length. The leaves of a
source, in order of their identifier, are the leaves of a tree in which ``fanout`` neighbours at a
time have their digest as parent; the roots of the sources are the leaves of one more tree, whose
root is the manifest's.

Places in a tree are running numbers: leaves are sorted by range, a task's own numbers are added
to those of the ranges before. A superblock is the ``fanout^levels`` leaves that share a place
divided by that number. One grouped function call collapses the levels of a superblock at once; its
root is a leaf of the next, so a source with n rows takes log n / log(fanout^levels) rounds, and no
task holds more than a superblock (small trees share one). Proofs go the other way: the upper part
of a superblock's root, made round by round from the top, is put behind the lower part of each of
its leaves within the superblock. Only digests move, and each twice.

Nulls: a null field is written ``-``; null sources are a source, before the others; null
identifiers come before the others. Rows with the same identifier are ordered by their digests, and
equal rows, which can't be told apart, by their place in a file. Empty tables give no rows.
"""

import hashlib
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 16
#: Levels that are collapsed at a time: 4,096 leaves.
LEVELS = 3


def digest_of(values: Sequence[Column]) -> Column:
    """The digest, as binary, of some fields, each as its length in bytes, a colon and itself."""
    texts = [v.cast("string") for v in values]
    written_out = [F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.unhex(F.sha2(F.concat(*written_out).cast("binary"), 256))


def numbered(rows: DataFrame, tree: str, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` sorted, with ``m``; and ``tree, part, first, before, n`` of what each range has of a tree.

    The place of a row in its tree is ``m - first + before``; ``n`` is the size of the tree.
    """
    stored = written(rows, "merkle-rows")
    place = stored.metadataColumn("_metadata")
    keys = [F.col(c).asc_nulls_first() for c in (tree, *order)]
    placed = stored.select("*", F.xxhash64(place["file_path"]).alias("_file"), place["row_index"].alias("_row"))
    dealt = placed.repartitionByRange(*keys, F.col("_file"), F.col("_row")).sortWithinPartitions(*keys, "_file", "_row")
    # The number of a task's range in the upper bits, that of the row within it in the lower 33.
    sorted_rows = written(dealt.drop("_file", "_row").withColumn("m", F.monotonically_increasing_id()), "merkle-sorted")
    parts = sorted_rows.groupBy(tree, F.shiftright("m", 33).alias("part")).agg(F.min("m").alias("first"), F.count("*").alias("rows"))
    own = Window.partitionBy(tree)
    earlier = own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sorted_rows, parts.select(
        tree, "part", "first", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"), F.sum("rows").over(own).alias("n")
    )


def placed(sorted_rows: DataFrame, parts: DataFrame, tree: str, columns: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """``index, n``, other ``columns`` of the rows and ``extra`` ones of the parts."""
    side = parts.withColumnRenamed(tree, "_tree")
    same = F.col(tree).eqNullSafe(F.col("_tree")) & (F.shiftright("m", 33) == F.col("part"))
    joined = sorted_rows.join(side, same)
    return joined.select(*extra, (F.col("m") - F.col("first") + F.col("before")).alias("index"), "n", *columns)


def height(n: int, fanout: int) -> int:
    """Levels above ``n`` leaves until one node is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def hashed(digests: Sequence[bytes]) -> bytes:
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def collapsed(digests: list[bytes], levels: int, fanout: int) -> list[list[bytes]]:
    """The nodes of each level over some neighbours, from themselves upwards."""
    nodes = [digests]
    for _ in range(levels):
        below = nodes[-1]
        nodes.append([hashed(below[i : i + fanout]) for i in range(0, len(below), fanout)])
    return nodes


class Shape:
    """Fanout and levels of superblocks, and how rows are grouped by them."""

    def __init__(self, fanout: int = FANOUT, levels: int = LEVELS):
        self.fanout, self.levels, self.span = fanout, levels, fanout**levels

    def block(self, several: Column, bucket: Column, groups: int) -> Column:
        """A number for each superblock; trees of one superblock share ``groups`` of them."""
        return F.when(several, F.xxhash64("tree", bucket)).otherwise(F.pmod(F.xxhash64("tree"), F.lit(groups)))

    def dealt(self, nodes: DataFrame, groups: int) -> DataFrame:
        return nodes.withColumn("block", self.block(F.col("n") > self.span, F.floor(F.col("index") / self.span), groups))

    def pieces(self, table: pa.Table):
        """``tree, bucket, n, rows`` of each superblock in a group, its rows in order."""
        tree, index = table["tree"].to_numpy(), table["index"].to_numpy()
        order = np.lexsort((index, tree))
        bucket = index[order] // self.span
        starts = np.flatnonzero(np.concatenate(([True], (tree[order][1:] != tree[order][:-1]) | (bucket[1:] != bucket[:-1])))) if len(order) else []
        n = table["n"].to_numpy()
        for start, stop in zip(starts, [*starts[1:], len(order)], strict=True):
            rows = order[start:stop]
            yield int(tree[rows[0]]), int(bucket[start]), int(n[rows[0]]), rows

    def height(self, n: int) -> int:
        """Levels that a superblock of a tree of n nodes has."""
        return self.levels if n > self.span else height(n, self.fanout)


def roots(nodes: DataFrame, shape: Shape, groups: int) -> DataFrame:
    """``tree, index, n, digest``: the root of each superblock, as a leaf of the next round."""

    def one(table: pa.Table) -> pa.Table:
        digests = table["digest"].to_pylist()
        out = []
        for tree, bucket, n, rows in shape.pieces(table):
            top = collapsed([digests[i] for i in rows], shape.height(n), shape.fanout)[-1]
            out.append((tree, bucket, -(-n // shape.span), top[0]))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["tree", "index", "n", "digest"])

    dealt = shape.dealt(nodes.select("tree", "index", "n", "digest"), groups)
    return dealt.groupBy("block").applyInArrow(one, "tree long, index long, n long, digest binary")


#: A step of a proof: the node's place in its run, how many others that has, and their digests.
Step = tuple[int, list[bytes]]


def packed(step: Step) -> bytes:
    place, others = step
    return place.to_bytes(2, "big") + len(others).to_bytes(2, "big") + b"".join(others)


def unpacked(proof: bytes) -> list[Step]:
    steps, at = [], 0
    while at < len(proof):
        place, n = int.from_bytes(proof[at : at + 2], "big"), int.from_bytes(proof[at + 2 : at + 4], "big")
        steps.append((place, [proof[at + 4 + 32 * i : at + 36 + 32 * i] for i in range(n)]))
        at += 4 + 32 * n
    return steps


def folded(digest: bytes, proof: bytes) -> bytes:
    """The root that a leaf and its proof lead to."""
    for place, others in unpacked(proof):
        digest = hashed([*others[:place], digest, *others[place:]])
    return digest


def step_of(nodes: list[bytes], i: int, fanout: int) -> Step:
    start, place = i - i % fanout, i % fanout
    run = nodes[start : start + fanout]
    return place, run[:place] + run[place + 1 :]


def lower_proofs(nodes: list[list[bytes]], upper: bytes, fanout: int) -> list[bytes]:
    """The whole proof of each node of the lowest level, ``upper`` being that of the highest one."""
    tails = [upper]
    for level in reversed(nodes[:-1]):
        tails = [packed(step_of(level, i, fanout)) + tails[i // fanout] for i in range(len(level))]
    return tails


def joined_proofs(nodes: DataFrame, uppers: DataFrame, shape: Shape, groups: int, row: Callable, columns: Sequence[str], schema: str) -> DataFrame:
    """``row``'s output for each superblock of ``nodes`` with its root's row of ``uppers(tree, index, n, proof, subroot)``.

    ``row(nodes by level, proof of the root)`` gives lists of columns for the lowest nodes.
    """

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        above = {(t, i): (p, s) for t, i, p, s in zip(*(right[c].to_pylist() for c in ("tree", "index", "proof", "subroot")), strict=True)}
        digests, parts = left["digest"].to_pylist(), []
        for tree, bucket, n, rows in shape.pieces(left):
            proof, subroot = above[tree, bucket]
            kept = left.take(pa.array(rows))
            found = row(collapsed([digests[i] for i in rows], shape.height(n), shape.fanout), proof, kept)
            kept = kept.select(list(columns)).append_column("subroot", pa.array([subroot] * len(rows), pa.binary()))
            for name, values in found.items():
                kept = kept.append_column(name, values)
            parts.append(kept)
        return pa.concat_tables(parts)

    left = shape.dealt(nodes, groups)
    right = uppers.withColumn("block", shape.block(F.col("n") > 1, F.col("index"), groups)).select("block", "tree", "index", "proof", "subroot")
    return left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(one, schema)


def with_proofs(fanout: int) -> Callable:
    def row(nodes, proof, kept):
        return {"proof": pa.array(lower_proofs(nodes, proof, fanout), pa.binary())}

    return row


class Tree:
    """Rounds of superblocks over the leaves ``tree, index, n, digest`` of some trees."""

    def __init__(self, leaves: DataFrame, shape: Shape):
        self.shape, self.rounds, self.groups = shape, [leaves], []
        most = 2
        while most > 1:  # one round at least, so that the last one has a row a tree
            below = self.rounds[-1]
            size = below.agg(F.count("*").alias("rows"), F.max("n").alias("n")).first()
            self.groups.append(max(1, size["rows"] // shape.span))
            self.rounds.append(written(roots(below, shape, self.groups[-1]), "merkle-roots"))
            most = -(-(size["n"] or 0) // shape.span)

    def roots(self) -> DataFrame:
        return self.rounds[-1]

    def uppers(self, tops: DataFrame, down_to: int) -> DataFrame:
        """Proofs of the nodes of a round from those of the roots, ``tops(tree, index, n, proof, subroot)``."""

        for k in range(len(self.rounds) - 2, down_to - 1, -1):
            schema = "tree long, index long, n long, subroot binary, proof binary"
            tops = written(joined_proofs(self.rounds[k], tops, self.shape, self.groups[k], with_proofs(self.shape.fanout), ("tree", "index", "n"), schema), "merkle-proofs")
        return tops


class Manifest:
    """The trees over some documents.

    ``presented`` is a column with the text that is to be verified, where it isn't the stored one.
    """

    def __init__(self, docs: DataFrame, presented: Column | None = None, shape: Shape | None = None):
        self.shape = shape or Shape()
        shown = presented if presented is not None else F.col("text")
        fields = [F.col(c) for c in FIELDS]
        other = F.when(~shown.cast("string").eqNullSafe(F.col("text").cast("string")), digest_of([*fields[:-1], shown]))
        leaves = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), digest_of(fields).alias("digest"), other.alias("other"))
        rows, parts = numbered(leaves, "source", ["doc_id", "digest"])
        parts = written(parts, "merkle-parts")
        sources, above = numbered(parts.select("source").distinct().withColumn("all", F.lit(0)), "all", ["source"])
        # Trees are numbered in the order of their sources.
        number = placed(sources, above, "all", ["source"]).select(F.col("source").alias("_source"), F.col("index").alias("tree"))
        parts = parts.join(number, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        self.tree = Tree(written(placed(rows, parts, "source", ["doc_id", "digest", "other"], ["tree"]), "merkle-leaves"), self.shape)
        count = F.lit(number.count()).cast("long")
        tops = self.tree.roots().select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("index"), count.alias("n"), "digest")
        self.over = Tree(tops, self.shape)

    def root(self) -> bytes | None:
        """The digest of the whole dataset; none of an empty one."""
        row = self.over.roots().first()
        return bytes(row["digest"]) if row else None

    def uppers(self) -> DataFrame:
        """Proofs of the superblocks that hold leaves."""
        none = F.lit(b"")
        tops = self.over.uppers(self.over.roots().select("tree", "index", "n", none.alias("proof"), none.alias("subroot")), 0)
        subroots = self.tree.roots().select(F.col("tree").alias("_tree"), F.col("digest").alias("_subroot"))
        own = tops.join(subroots, F.col("index") == F.col("_tree"))
        own = own.select(F.col("index").alias("tree"), F.lit(0).cast("long").alias("index"), F.lit(1).cast("long").alias("n"), "proof", F.col("_subroot").alias("subroot"))
        return self.tree.uppers(written(own, "merkle-subroots"), 1)

    def proofs(self) -> DataFrame:
        """``doc_id, digest, subroot, proof``: the packed proof of each row; ``folded`` takes it to the root."""

        return joined_proofs(self.tree.rounds[0], self.uppers(), self.shape, self.tree.groups[0], with_proofs(self.shape.fanout), ("doc_id", "digest"), "doc_id long, digest binary, subroot binary, proof binary")

    def verified(self) -> DataFrame:
        """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``: each row as presented, led to the root."""
        fanout = self.shape.fanout

        def row(nodes, proof, kept):
            above = unpacked(proof)
            #: By level, the siblings of each node as text, from its own level to the root.
            tails = ["".join(d.hex() for _, others in above for d in others)]
            for level in reversed(nodes[1:-1]):
                tails = ["".join(d.hex() for d in step_of(level, i, fanout)[1]) + tails[i // fanout] for i in range(len(level))]
            known: dict[tuple[int, int, bytes], bytes] = {}

            def up(level: int, i: int, digest: bytes) -> bytes:
                """The root from a node, climbed once for all leaves that lead to the same one."""
                key = level, i, digest
                if key not in known:
                    if level == len(nodes) - 1:
                        for place, others in above:
                            digest = hashed([*others[:place], digest, *others[place:]])
                        known[key] = digest
                    else:
                        place, others = step_of(nodes[level], i, fanout)
                        known[key] = up(level + 1, i // fanout, hashed([*others[:place], digest, *others[place:]]))
                return known[key]

            shas, ends = [], []
            for i, (own, other) in enumerate(zip(kept["digest"].to_pylist(), kept["other"].to_pylist(), strict=True)):
                if len(nodes) > 1:
                    text = "".join(d.hex() for d in step_of(nodes[0], i, fanout)[1]) + tails[i // fanout]
                else:
                    text = tails[0]
                shas.append(hashlib.sha256(text.encode()).digest())
                ends.append(up(0, i, other if other is not None else own))
            return {"sha": pa.array(shas, pa.binary()), "end": pa.array(ends, pa.binary())}

        root = self.root()
        found = joined_proofs(self.tree.rounds[0], self.uppers(), self.shape, self.tree.groups[0], row, ("doc_id", "digest"), "doc_id long, digest binary, subroot binary, sha binary, end binary")

        def text(c: Column) -> Column:
            return F.lower(F.hex(c))

        whole = F.lit(root.hex() if root else None).cast("string")
        return found.select(
            "doc_id", text(F.col("digest")).alias("leaf"), text(F.col("subroot")).alias("subroot"), whole.alias("root"), text(F.col("sha")).alias("proof_sha256"),
            text(F.col("end")).alias("folded_root"), (text(F.col("end")) == whole).alias("verified"),
        )
