"""Merkle manifest of a dataset: a postorder append log of hash trees, written by aligned builders.

Every source is a tree over its documents, and the roots of the sources are
the leaves of one more tree. A tree has runs of ``FAN`` nodes; the last run of
a level may be shorter, even one node. A node is written when its last leaf
has been, so a tree is a log in postorder to which leaves are only appended.
Where a node stands follows from the sizes of complete subtrees alone
(``position``), so siblings are addressed without pointers or an index.

A builder writes the log of ``FAN ** HEIGHT`` leaves at an aligned place, a
whole subtree; the roots of these are the leaves of the next round, until a
tree has one node. Proofs go the other way: a round adds its siblings to those
above it, and the last round meets the documents. No task holds more than one
builder's leaves at a time, whatever the size of a source.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from stay_analytics.session import cut_lineage

from .common import column, partitions_for

FAN = 16
#: A builder's subtree has FAN ** HEIGHT leaves.
HEIGHT = 2
BLOCK = FAN ** HEIGHT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def height_of(n: int, fan: int = FAN) -> int:
    """Levels above the leaves of a tree of ``n`` leaves."""
    height = 0
    while n > 1:
        n, height = -(-n // fan), height + 1
    return height


def position(level: int, index: int, n: int, height: int, fan: int = FAN) -> int:
    """Place in the log, from 0, of node ``index`` of ``level`` in a tree of ``n`` leaves and ``height`` levels above them.

    The node ends with leaf ``end``. Before it come all nodes up to its level
    that end there or earlier, and the nodes of higher levels that end earlier.
    """
    end = min((index + 1) * fan ** level, n)
    return sum(-(-end // fan ** k) for k in range(level + 1)) + sum((end - 1) // fan ** k for k in range(level + 1, height + 1)) - 1


def parent_hash(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def write_log(leaves: list[str], height: int, fan: int = FAN) -> list[str]:
    """The log of one tree: each leaf, and each node as soon as its last child is written."""
    log: list[str] = []
    open_runs: list[list[str]] = [[] for _ in range(height + 1)]

    def append(level: int, h: str) -> None:
        log.append(h)
        if level < height:
            open_runs[level].append(h)
            if len(open_runs[level]) == fan:
                close(level)

    def close(level: int) -> None:
        run, open_runs[level] = open_runs[level], []
        append(level + 1, parent_hash(run))

    for leaf in leaves:
        append(0, leaf)
    for level in range(height):
        if open_runs[level]:
            close(level)
    return log


def siblings(log: list[str], index: int, n: int, height: int, seen: dict | None = None, fan: int = FAN) -> list[tuple[str, str]]:
    """For each level from a leaf's up: the hashes before and after its node in its run, joined; read by position.

    ``seen`` keeps runs that several leaves of one log share.
    """
    out, width, seen = [], n, {} if seen is None else seen
    for level in range(height):
        first = index // fan * fan
        if (level, first) not in seen:
            seen[level, first] = [log[position(level, k, n, height, fan)] for k in range(first, min(first + fan, width))]
        hashes, at = seen[level, first], index - first
        out.append(("".join(hashes[:at]), "".join(hashes[at + 1:])))
        index, width = index // fan, -(-width // fan)
    return out


def fold(h: str, path: list[tuple[str, str]]) -> str:
    """The root that a hash and the siblings on its way up give."""
    for before, after in path:
        h = hashlib.sha256((before + h + after).encode()).hexdigest()
    return h


def proof_digest(path: list[tuple[str, str]]) -> str:
    return hashlib.sha256("".join(before + after for before, after in path).encode()).hexdigest()


def runs_of(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[tuple[int, int], list[tuple]]]:
    """((tree, block), rows) of batches sorted by tree and block; rows hold the columns ``names``."""
    key, rows = None, []
    for batch in batches:
        keys = zip(*[column(batch, c).to_pylist() for c in ("tree", "block")], strict=True)
        for k, row in zip(keys, zip(*[column(batch, c).to_pylist() for c in names], strict=True), strict=True):
            if k != key:
                if rows:
                    yield key, rows
                key, rows = k, []
            rows.append(row)
    if rows:
        yield key, rows


def numbered(rows: DataFrame, tree: str | None, order: list[str], at: str = "at", size: str = "size") -> DataFrame:
    """``rows`` with the place, from 0, of each in its tree by ascending ``order``, nulls first, and the tree's size.

    Rows are dealt by ranges of (tree, order), ranges number their own rows,
    and the counts of the ranges before are added; no tree is in one task. The
    dealt rows are written once, so all uses see the same ranges.
    """
    by = ([tree] if tree else []) + order
    dealt = cut_lineage(rows.repartitionByRange(partitions_for(rows), *[F.col(c).asc_nulls_first() for c in by])
                        .withColumn("part_", F.spark_partition_id()).withColumn("tree_", F.col(tree) if tree else F.lit(0)))
    counts = dealt.groupBy("tree_", "part_").agg(F.count("*").alias("rows_"))
    parts = Window.partitionBy("tree_").orderBy("part_")
    offsets = counts.withColumn("before_", F.sum("rows_").over(parts) - F.col("rows_")) \
        .withColumn(size, F.sum("rows_").over(Window.partitionBy("tree_"))) \
        .select(F.col("tree_").alias("of_tree"), F.col("part_").alias("of_part"), "before_", size)
    inside = Window.partitionBy("part_", "tree_").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    placed = dealt.withColumn("in_part_", F.row_number().over(inside) - 1)
    joined = placed.join(offsets, F.col("part_").eqNullSafe(F.col("of_part")) & F.col("tree_").eqNullSafe(F.col("of_tree")))
    return joined.withColumn(at, F.col("before_") + F.col("in_part_")).drop("part_", "tree_", "in_part_", "of_tree", "of_part", "before_", "rows_")


def in_blocks(rows: DataFrame) -> DataFrame:
    """Rows (tree, block, at, ...) in the tasks of their builders, in order."""
    return rows.repartition(partitions_for(rows), "tree", "block").sortWithinPartitions("tree", "block", "at")


def block_of(at="at"):
    return F.floor(F.col(at) / BLOCK).cast("long").alias("block")


def builder_height(n: int, size: int) -> int:
    """Levels that a builder of ``n`` leaves writes in a tree of ``size``: a lone builder ends at the tree's root."""
    return height_of(n) if size <= BLOCK else HEIGHT


def builder_logs(nodes: DataFrame) -> DataFrame:
    """(tree, block, size, n, log): the append log of every builder over leaves (tree, at, size, hash).

    ``size`` counts the leaves of the whole tree, n those of the builder; the last hash of a log is its root.
    """
    def run(batches):
        for (tree, block), rows in runs_of(batches, ("size", "hash")):
            size, n = rows[0][0], len(rows)
            log = write_log([h for _, h in rows], builder_height(n, size))
            yield pa.RecordBatch.from_arrays([*[pa.array([x], pa.int64()) for x in (tree, block, size, n)], pa.array([log], pa.list_(pa.string()))],
                                             names=["tree", "block", "size", "n", "log"])

    return in_blocks(nodes.select("tree", block_of(), "at", "size", "hash")).mapInArrow(
        run, "tree bigint, block bigint, size bigint, n bigint, log array<string>")


def rounds_of(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The leaves (tree, at, size, hash) of every round from the first one up, and (tree, root).

    A tree that is done stays a lone node, so that all trees have the same rounds.
    """
    rounds = [leaves]
    while True:
        ends = cut_lineage(builder_logs(rounds[-1]).select("tree", "block", "size", F.element_at("log", -1).alias("hash")))
        if ends.where(F.col("size") > BLOCK).isEmpty():
            return rounds, ends.select("tree", F.col("hash").alias("root"))
        rounds.append(ends.select("tree", F.col("block").alias("at"), F.ceil(F.col("size") / BLOCK).cast("long").alias("size"), "hash"))


def append_log(rounds: list[DataFrame]) -> DataFrame:
    """(tree, position, level, hash): the whole log of every tree, of all rounds of ``rounds_of``.

    The nodes of a round but its leaves follow from its builders' logs; their
    places in the tree's log follow from the tree's size.
    """
    whole = rounds[0].groupBy("tree").agg(F.max("size").alias("leaves"))

    def nodes(number):
        def run(batches):
            for batch in batches:
                names = ("tree", "block", "size", "n", "log", "leaves")
                for tree, block, size, n, log, leaves in zip(*[column(batch, c).to_pylist() for c in names], strict=True):
                    height, top, out = builder_height(n, size), height_of(leaves), []
                    for level in range(1 if number else 0, height + 1):
                        above, first = number * HEIGHT + level, block * FAN ** (HEIGHT - level)
                        out += [(position(above, first + k, leaves, top), above, log[position(level, k, n, height)]) for k in range(-(-n // FAN ** level))]
                    at, levels, hashes = zip(*out, strict=True) if out else ((), (), ())
                    yield pa.RecordBatch.from_arrays([pa.array([tree] * len(out), pa.int64()), pa.array(at, pa.int64()), pa.array(levels, pa.int32()),
                                                      pa.array(hashes, pa.string())], names=["tree", "position", "level", "hash"])

        return run

    out = None
    for number, leaves in enumerate(rounds):
        part = builder_logs(leaves).join(whole, "tree").mapInArrow(nodes(number), "tree bigint, position bigint, level int, hash string")
        out = part if out is None else out.union(part)
    return out


PATH = "array<struct<before: string, after: string>>"


def with_heads(nodes: DataFrame, heads: DataFrame) -> DataFrame:
    """Nodes in their builders' tasks, before them the builder's row of ``heads`` (tree, block, path, ...), whose ``at`` is -1."""
    leaves = nodes.withColumn("block", block_of())
    return in_blocks(leaves.unionByName(heads.withColumn("at", F.lit(-1).cast("long")), allowMissingColumns=True))


def pairs_of(path: list[dict]) -> list[tuple[str, str]]:
    return [(p["before"], p["after"]) for p in path]


def builder_paths(hashes: list[str], size: int, above: list[tuple[str, str]]) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root of a builder's leaves, whose log it writes anew, and the siblings of each leaf up to the top."""
    n, seen = len(hashes), {}
    height = builder_height(n, size)
    log = write_log(hashes, height)
    return log[-1], [siblings(log, k, n, height, seen) + above for k in range(n)]


def extend_paths(nodes: DataFrame, heads: DataFrame) -> DataFrame:
    """(tree, at, path) of nodes (tree, at, size, hash): their siblings up to the top, given those of their builders' roots."""
    def run(batches):
        for (tree, _), rows in runs_of(batches, ("at", "size", "hash", "path")):
            head, *own = rows
            _, paths = builder_paths([r[2] for r in own], own[0][1], pairs_of(head[3]))
            told = [[{"before": b, "after": a} for b, a in path] for path in paths]
            yield pa.RecordBatch.from_arrays([pa.array([tree] * len(own), pa.int64()), pa.array([r[0] for r in own], pa.int64()), pa.array(
                told, pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])))], names=["tree", "at", "path"])

    return with_heads(nodes.select("tree", "at", "size", "hash"), heads).mapInArrow(run, f"tree bigint, at bigint, path {PATH}")


def builder_heads(rounds: list[DataFrame], roots: DataFrame) -> DataFrame:
    """(tree, block, path) for the builders of the first round; ``roots`` has (tree, path) of the trees' roots."""
    heads = roots.select("tree", F.lit(0).cast("long").alias("block"), "path")
    for nodes in reversed(rounds[1:]):
        heads = extend_paths(nodes, heads).select("tree", F.col("at").alias("block"), "path")
    return heads


def leaf_hash(fields: list) -> Column:
    """sha256 over the fields: `-` for a null, else UTF-8 byte count, colon, value."""
    told = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (f.cast("string") for f in fields)]
    return F.sha2(F.concat(*told), 256)


def manifest_leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, tampered): the hash of every row, and that of the row with A-Z of its text lowered where its id says so.

    tampered is null where the row is not tampered with. A null id has no
    decimal form and is never tampered with.
    """
    fields = [F.col(c) for c in FIELDS]
    lowered = [*fields[:-1], F.translate(F.col("text"), UPPER, LOWER)]
    return docs.select("doc_id", "source", leaf_hash(fields).alias("leaf"),
                       F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, leaf_hash(lowered)).alias("tampered"))


def manifest_nodes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves (tree, at, size, hash, doc_id, tampered) of all sources' trees, written once, and their places (source, tree, n_sources)."""
    placed = numbered(manifest_leaves(docs), "source", ["doc_id", "leaf"])
    sources = cut_lineage(numbered(placed.select("source").distinct(), None, ["source"], at="tree", size="n_sources"))
    named = sources.select(F.col("source").alias("of_source"), "tree")
    return cut_lineage(placed.join(named, F.col("source").eqNullSafe(F.col("of_source")))
                       .select("tree", "at", "size", F.col("leaf").alias("hash"), "doc_id", "tampered")), sources


def verified_manifest(docs: DataFrame) -> DataFrame:
    """Leaf, roots, proof digest and check of every row of ``docs`` (doc_id, source, lang, n_chars, text; other columns are ignored).

    Returns doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.
    A null field is hashed as ``-``; null sources are a source of their own
    and come first; rows of a source are in order of id, nulls first, and rows
    of equal id in order of their leaves, so equal rows may change places
    without any hash of the trees changing. Texts of any length are hashed
    whole. An empty table gives no rows.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    nodes, sources = manifest_nodes(docs)
    rounds, subroots = rounds_of(nodes.select("tree", "at", "size", "hash"))
    top, root = rounds_of(subroots.join(sources, "tree").select(
        F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), F.col("n_sources").alias("size"), F.col("root").alias("hash")))
    outside = extend_paths(top[0], builder_heads(top, root.select("tree", F.array().cast(PATH).alias("path")))).select(F.col("at").alias("tree"), "path")
    levels = outside.select("tree", F.size("path").alias("outside"))
    heads = builder_heads(rounds, outside).join(levels, "tree")

    def run(batches):
        for _, rows in runs_of(batches, ("size", "hash", "doc_id", "tampered", "path", "outside")):
            head, *own = rows
            above = pairs_of(head[4])
            inside = len(above) - head[5]
            end, paths = builder_paths([r[1] for r in own], own[0][0], above)
            subroot = fold(end, above[:inside])
            root = fold(subroot, above[inside:])
            folded = [fold(r[3] or r[1], path) for r, path in zip(own, paths, strict=True)]
            yield pa.RecordBatch.from_arrays([
                pa.array([r[2] for r in own], id_arrow), pa.array([r[1] for r in own]), pa.array([subroot] * len(own)), pa.array([root] * len(own)),
                pa.array([proof_digest(path) for path in paths]), pa.array(folded), pa.array([f == root for f in folded])],
                names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    id_arrow = to_arrow_type(docs.schema["doc_id"].dataType)
    return with_heads(nodes, heads).mapInArrow(run, f"doc_id {id_type}, leaf string, subroot string, root string, proof_sha256 string, "
                                                    "folded_root string, verified boolean")
