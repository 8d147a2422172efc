"""Merkle manifest of a dataset as an append log in postorder (operator 13).

Rows are leaves; the leaves of a tree (one for each language) are cut into aligned runs of ``RUN``, and each run is a builder that appends its
nodes in the order in which they are completed. That is the postorder of its part of the tree, so the place of any node follows from
the sizes of the subtrees before it: before leaf s lie 2 s - popcount(s) nodes. Proofs are taken out of the log by these places, without
any search or index. The roots of the builders are the leaves of the next stage, until each tree has one root; the roots of the trees, in
order, are the leaves of the tree above them.

A node is the lower-case hexadecimal SHA-256 of its children's hexadecimal digests, concatenated. A node without a sibling is hashed alone; a
tree of one leaf is that leaf.

Scale: leaves are hashed in the JVM, and only digests move: once sorted by range over (tree, id), once gathered by builder. A tree that holds
most rows is many ranges and many builders, and copies of one row are told apart by their place in a written table, so they spread too. The
numbers of the leaves come from the counts of the ranges, not from a window over a tree. A log row is a builder's segment of under
2 * ``RUN`` digests. Paths above the builders are handed down stage by stage, one row for each builder. Every step is a written table.

Defined cases: NULL fields are hashed as ``-``; a NULL tree comes first, NULL ids before others; rows with one id are ordered by their digest, and
equal rows are interchangeable, each with a leaf and a proof of its own. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from rooftally.workspace import write_and_read

#: Leaves of a builder are two to this power.
BITS = 9
RUN = 1 << BITS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Bytes of a step of a path: where the sibling stands, and its digest.
STEP = 33
ALONE, LEFT, RIGHT = 0, 1, 2
_NOTHING = bytes(STEP)
_SEGMENT = "tree string, block long, size long, log array<binary>, ids array<long>, forged array<binary>"
#: Bits of a row number within a partition, as ``monotonically_increasing_id`` has them.
_ROW_BITS = 33


def parent(*children: bytes) -> bytes:
    return sha256("".join(c.hex() for c in children).encode()).digest()


def subtree_size(level: int, leaves: int) -> int:
    """Nodes of a subtree up to ``level`` over so many leaves."""
    return sum(-(-leaves >> t) for t in range(level + 1))


def position(level: int, index: int, leaves: int) -> int:
    """Place in the log of node ``index`` of a level, in a tree of so many leaves."""
    start = index << level
    return 2 * start - start.bit_count() + subtree_size(level, min(1 << level, leaves - start)) - 1


def height(leaves: int) -> int:
    return (leaves - 1).bit_length()


def append_log(leaves: list[bytes], levels: int) -> list[bytes]:
    """The nodes over the leaves in the order of completion, up to the given level."""
    log: list[bytes] = []
    waiting: list[bytes | None] = [None] * (levels + 1)

    def add(level: int, digest: bytes) -> None:
        log.append(digest)
        while level < levels and waiting[level] is not None:
            digest, waiting[level] = parent(waiting[level], digest), None
            level += 1
            log.append(digest)
        waiting[level] = digest

    for leaf in leaves:
        add(0, leaf)
    for level in range(levels):
        if waiting[level] is not None:
            last, waiting[level] = waiting[level], None
            add(level + 1, parent(last))
    return log


def path_of(log: list[bytes], leaf: int, leaves: int, levels: int) -> bytes:
    """The steps from a leaf to the top of its log, addressed by place."""
    steps = []
    for level in range(levels):
        other = (leaf >> level) ^ 1
        if other << level >= leaves:
            steps.append(_NOTHING)
        else:
            steps.append(bytes([RIGHT if other & 1 else LEFT]) + log[position(level, other, leaves)])
    return b"".join(steps)


def fold(digest: bytes, path: bytes) -> bytes:
    """The root that a digest leads to along a path."""
    for at in range(0, len(path), STEP):
        kind, other = path[at], path[at + 1:at + STEP]
        digest = parent(digest) if kind == ALONE else parent(other, digest) if kind == LEFT else parent(digest, other)
    return digest


def siblings(path: bytes) -> str:
    """The siblings of a path as hexadecimal text."""
    return "".join(path[at + 1:at + STEP].hex() for at in range(0, len(path), STEP) if path[at] != ALONE)


# --- leaves -----------------------------------------------------------------------------------------------------
def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(docs: DataFrame, **replaced: Column) -> Column:
    """Digest of a row's fields, each given by its length in bytes and its value."""
    return F.unhex(F.sha2(F.concat(*[_field(replaced.get(c, docs[c])) for c in FIELDS]).cast("binary"), 256))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows with ``no``, their number from 0 within their tree, and ``size``, that of the tree."""
    fixed = write_and_read(rows.withColumn("_tie", F.monotonically_increasing_id()), "leaves")
    keys = ["tree", *order, "_tie"]
    placed = write_and_read(fixed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
                            .withColumn("_at", F.monotonically_increasing_id()), "ordered-leaves")
    part = F.shiftright("_at", _ROW_BITS).alias("_part")
    runs = write_and_read(placed.groupBy("tree", part).agg(F.min("_at").alias("_first"), F.count("*").alias("_n")), "runs")
    # at most a row for each range and tree
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("_n").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = runs.select("tree", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(tree).alias("size"))
    return placed.withColumn("_part", part).join(starts, ["tree", "_part"]).withColumn("no", F.col("_at") + F.col("_shift")).drop(
        "_part", "_at", "_shift")


# --- builders ---------------------------------------------------------------------------------------------------
def _build(group: pa.Table) -> pa.Table:
    """One row for a builder: its segment of the log, and of the lowest stage the ids and what takes the leaves' places in a check."""
    group = group.sort_by("no")
    size, block = group.column("size")[0].as_py(), group.column("no")[0].as_py() >> BITS
    log = append_log(group.column("digest").to_pylist(), min(BITS, height(size)))
    return pa.table({"tree": group.column("tree").slice(0, 1), "block": [block], "size": [size], "log": pa.array([log], pa.list_(pa.binary())),
                     "ids": pa.array([group.column("id").to_pylist()], pa.list_(pa.int64())),
                     "forged": pa.array([group.column("forged").to_pylist()], pa.list_(pa.binary()))})


@dataclass(frozen=True)
class Trees:
    """Per stage the segments of the log; ``tops`` are the trees' roots with the stage that ended them."""

    stages: list[DataFrame]
    tops: DataFrame


def build_trees(rows: DataFrame) -> Trees:
    """The logs of all trees from rows (tree, no, size, digest, id, forged)."""
    stages, tops = [], None
    while True:
        segments = write_and_read(rows.groupBy("tree", F.shiftright("no", BITS)).applyInArrow(_build, _SEGMENT), "segments")
        roots = segments.select("tree", F.col("block").alias("no"), F.ceil(F.col("size") / RUN).cast("long").alias("size"),
                                F.element_at("log", -1).alias("digest"))
        ended = roots.filter("size = 1").select("tree", "digest", F.lit(len(stages)).alias("stage"))
        stages.append(segments)
        tops = ended if tops is None else tops.unionAll(ended)
        rows = roots.filter("size > 1").withColumn("id", F.lit(None).cast("long")).withColumn("forged", F.lit(None).cast("binary"))
        if not rows.head(1):
            return Trees(stages, tops)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each leaf of a segment its path to the very root, handed down to the builder below it."""
    for batch in batches:
        for row in batch.to_pylist():
            leaves, first = min(RUN, row["size"] - (row["block"] << BITS)), row["block"] << BITS
            levels = min(BITS, height(row["size"]))
            paths = [path_of(row["log"], k, leaves, levels) + row["up"] for k in range(leaves)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["tree"]] * leaves), pa.array(range(first, first + leaves), pa.int64()),
                 pa.array([row["top"]] * leaves, pa.binary()), pa.array(paths, pa.binary())], ["tree", "block", "top", "up"])


def reached(trees: Trees, tops: DataFrame) -> DataFrame:
    """The segments of the lowest stage with ``top`` and ``up``, the path above them; ``tops`` has tree, stage, top and up."""
    below = None
    for stage in range(len(trees.stages) - 1, -1, -1):
        here = tops.filter(F.col("stage") == stage).select("tree", F.lit(0).cast("long").alias("block"), "top", "up")
        here = here if below is None else here.unionAll(below)
        joined = trees.stages[stage].join(here, ["tree", "block"])
        if stage == 0:
            return joined
        below = write_and_read(joined.select("tree", "block", "size", "log", "top", "up").mapInArrow(
            _entries, "tree string, block long, top binary, up binary"), "paths")


def _proofs(root: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                leaves = min(RUN, row["size"] - (row["block"] << BITS))
                levels = min(BITS, height(row["size"]))
                log, above = row["log"], siblings(row["up"])
                known: dict[bytes, bytes] = {}
                out = {c: [] for c in ("leaf", "proof_sha256", "folded_root", "verified")}
                for k, forged in enumerate(row["forged"]):
                    leaf, path = log[position(0, k, leaves)], path_of(log, k, leaves, levels)
                    local = fold(leaf if forged is None else forged, path)
                    if local not in known:
                        known[local] = fold(local, row["up"])
                    out["leaf"].append(leaf.hex())
                    out["proof_sha256"].append(sha256((siblings(path) + above).encode()).hexdigest())
                    out["folded_root"].append(known[local].hex())
                    out["verified"].append(known[local] == root)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(row["ids"], pa.int64()), "leaf": out["leaf"],
                                                  "subroot": [row["top"].hex()] * leaves, "root": [root.hex()] * leaves,
                                                  "proof_sha256": out["proof_sha256"], "folded_root": out["folded_root"],
                                                  "verified": pa.array(out["verified"], pa.bool_())})
    return run


@dataclass(frozen=True)
class Manifest:
    """Root of the dataset, the logs of its trees, and the segments with the paths above them (``top``: subroot, ``up``: steps)."""

    root: bytes | None
    trees: Trees
    segments: DataFrame


def build_manifest(docs: DataFrame, forged: Column | None = None) -> Manifest:
    """The manifest over rows with ``FIELDS``. ``forged`` is a digest that a check takes in place of a row's own, where not NULL."""
    none = F.lit(None).cast("binary")
    # '-' comes before '=': the order of the trees is that of the values, NULL first
    tree = F.coalesce(F.concat(F.lit("="), docs["lang"].cast("string")), F.lit("-"))
    leaves = docs.select(tree.alias("tree"), docs["doc_id"].cast("long").alias("id"), leaf_digest(docs).alias("digest"),
                         (none if forged is None else forged).alias("forged"))
    trees = build_trees(numbered(leaves, ["id", "digest"]))
    roots = trees.tops.select(F.lit("").alias("tree"), F.col("tree").alias("own"), "digest", "stage")
    roots = write_and_read(numbered(roots, ["own"]), "subroots")
    above = build_trees(roots.select("tree", "no", "size", "digest", F.col("no").alias("id"), none.alias("forged")))
    top = above.tops.first()
    if top is None:
        return Manifest(None, trees, trees.stages[0].select("*", none.alias("top"), none.alias("up")))
    start = above.tops.select("tree", "stage", F.lit(b"").alias("up"), "digest").withColumnRenamed("digest", "top")
    paths = reached(above, start).select("tree", "block", "size", "log", "top", "up").mapInArrow(
        _entries, "tree string, block long, top binary, up binary")
    ends = roots.join(paths.select(F.col("block").alias("no"), "up"), "no").select(F.col("own").alias("tree"), "stage", F.col("digest").alias("top"), "up")
    return Manifest(bytes(top.digest), trees, reached(trees, write_and_read(ends, "tops")))


def proofs(manifest: Manifest) -> DataFrame:
    """A row for each leaf: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    shape = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return manifest.segments.select("block", "size", "log", "ids", "forged", "top", "up").mapInArrow(_proofs(manifest.root or b""), shape)


def tampered_digest(docs: DataFrame, modulus: int = 7) -> Column:
    """Digest of a row whose n_chars is one too high, for the rows whose id's CRC-32 the modulus divides; else NULL."""
    chosen = F.pmod(F.crc32(docs["doc_id"].cast("long").cast("string").cast("binary")), F.lit(modulus)) == 0
    more = docs["n_chars"].cast("decimal(38,0)") + F.lit(1)
    return F.when(chosen, leaf_digest(docs, n_chars=more))
