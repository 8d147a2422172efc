"""SimHash near-duplicates by tiled exact comparison (operator 1).

Fingerprints of 64 bits are cut into three blocks, and the population counts of the blocks name a cell. Two fingerprints that
differ in at most r bits lie in cells whose counts differ by at most r in sum, so only such cells are compared: the cells
are cut into tiles of about ``TILE`` fingerprints, and each remaining pair of tiles is compared bit by bit with numpy's exclusive-or
and bit count. No pair within the radius is missed, whatever the data.

Scale: fingerprints are computed in a narrow map, and copies collapse to one before anything is compared. A tile goes to the 65
cells at or before it within a radius of 4 (129 cells in all), so the shuffle is linear in the fingerprints; the comparisons
remain quadratic by the nature of the method, at about one pair in twelve of random fingerprints. A pair of tiles gives at most one
edge per fingerprint, a spanning forest of what it links, so no group of near copies is ever listed by pairs. Any hot cell is many
tiles, and the joins are plain equalities that adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from rooftally.llm.common import LOWER, UPPER
from rooftally.llm.components import connected_components
from rooftally.workspace import write_and_read

SHINGLE = 4
RADIUS = 4
SEED = 42
TILE = 2048
#: Widths of the blocks, from the lowest bit.
BLOCKS = (21, 21, 22)
#: Shingles whose bits are unpacked at a time.
AT_ONCE = 1 << 15

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The unsigned XXH64 hashes of a text's shingles, in order and with repeats.

    A-Z are lower-cased; words are runs without ASCII white space. With fewer words than a shingle has, the whole
    sequence is one; NULL and texts without words have none.
    """
    from xxhash import xxh64_intdigest

    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.empty(0, "<u8")
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(joined, SEED)], "<u8")
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    first, last = (ends - sizes)[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist()
    return np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(first, last)], "<u8")


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are set in over half the hashes, 0 for none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), AT_ONCE):
        octets = hashes[at:at + AT_ONCE].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of a text: a bit is set if it is in over half the hashes of its shingles; 0 without words."""
    return majority(shingle_hashes(text, shingle))


@pandas_udf(T.LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    """Fingerprints as signed longs."""
    return pd.Series(np.fromiter(map(fingerprint, texts), np.uint64, len(texts)).view(np.int64))


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest reachable number for each of n nodes under the links a-b."""
    root = np.arange(n)
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low < high
        if not open_.any():
            return root
        a, b = a[open_], b[open_]
        np.minimum.at(root, high[open_], low[open_])
        while (further := root[root]) is not None and (further != root).any():
            root = further


def linked(left: np.ndarray, right: np.ndarray, radius: int, rows: int = 256) -> np.ndarray:
    """Edges (k, 2) of a spanning forest over all pairs within the radius of two unsigned arrays."""
    n, held, stars = len(left), 0, []
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def closed() -> np.ndarray:
        a, b = (np.concatenate([p[k] for p in found] + [s[k] for s in stars]) for k in (0, 1))
        root = local_roots(a, b, n + len(right))
        away = np.flatnonzero(root != np.arange(len(root)))
        return np.stack([away, root[away]])

    for at in range(0, n, rows):
        i, j = np.nonzero(np.bitwise_count(left[at:at + rows, None] ^ right[None, :]) <= radius)
        if len(i):
            found.append((i + at, j + n))
            held += len(i)
        if held > 1_000_000:  # keep memory flat among many near copies
            stars, found, held = [closed()], [], 0
    if not found and not stars:
        return np.empty((0, 2), np.uint64)
    both = np.concatenate([left, right])
    return both[closed()].T


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [batch.column(c) for c in ("left", "right")]
            parts = []
            for k in range(batch.num_rows):
                x, y = (s[k].values.to_numpy(zero_copy_only=False).view(np.uint64) for s in sides)
                edges = linked(x, y, radius)
                if len(edges):
                    parts.append(edges[edges[:, 0] != edges[:, 1]])
            if parts:
                edges = np.concatenate(parts).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["src", "dst"])
    return run


def _cell(code: Column) -> list[Column]:
    at, out = 0, []
    for width in BLOCKS:
        out.append(F.bit_count(F.shiftrightunsigned(code, at).bitwiseAND(F.lit((1 << width) - 1))))
        at += width
    return out


def _offsets(radius: int) -> list[tuple[int, int, int]]:
    """Differences of block counts within the radius, one of each opposite pair."""
    span = range(-radius, radius + 1)
    return [d for d in ((x, y, z) for x in span for y in span for z in span)
            if sum(map(abs, d)) <= radius and d >= (0, 0, 0)]


def near_links(codes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges (src, dst) that connect the different fingerprints in column ``code`` exactly as all pairs within the radius do."""
    cells = codes.select("code", F.array(*_cell(F.col("code"))).alias("cell"))
    sizes = cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile).cast("long").alias("tiles"))
    # at most 22 * 22 * 23 cells exist, so the table of their sizes has a fixed bound
    dealt = cells.join(F.broadcast(sizes), "cell").withColumn("tile", F.pmod(F.xxhash64("code"), F.col("tiles")))
    tiles = write_and_read(dealt.groupBy("cell", "tile").agg(F.collect_list("code").alias("codes")), "tiles")
    steps = F.array(*[F.array(*map(F.lit, d)) for d in _offsets(radius)])
    moved = tiles.select(F.explode(F.transform(steps, lambda d: F.zip_with("cell", d, lambda c, x: c + x))).alias("cell"),
                         F.col("cell").alias("own"), F.col("tile").alias("other"), F.col("codes").alias("right"))
    pairs = tiles.withColumnRenamed("codes", "left").join(moved, "cell").filter(
        (F.col("own") != F.col("cell")) | (F.col("other") >= F.col("tile")))
    return pairs.select("left", "right").mapInArrow(_compare(radius), "src long, dst long")


def near_components(digests: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(code, component_id) for rows (doc_id, code): the smallest doc_id of all fingerprints connected to a code."""
    codes = write_and_read(digests.groupBy("code").agg(F.min("doc_id").alias("first")), "codes")
    edges = write_and_read(near_links(codes, radius), "near")
    roots = connected_components(edges)
    known = write_and_read(codes.join(roots, codes["code"] == roots["node"], "left").select(
        "code", "first", F.coalesce("root", "code").alias("root")), "roots")
    least = known.groupBy("root").agg(F.min("first").alias("component_id"))
    return known.join(least, "root").select("code", "component_id", "root")


def simhash_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """A row for each document: doc_id, fingerprint (16 hex digits), component_id.

    The component is the smallest doc_id reachable over links, NULL if none of its documents has an id. Texts without words
    have fingerprint zero and link like any other. Repeated rows stay; other columns are ignored.
    """
    digests = write_and_read(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprints("text").alias("code")), "simhash")
    known = near_components(digests, radius).select("code", "component_id")
    return digests.join(known, "code").select(
        "doc_id", F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The documents with one left of each component: the smallest doc_id, and of its rows one.

    All columns are kept, whatever their names. Only survivors are found by short rows; texts are shuffled once.
    """
    def keys(df: DataFrame) -> list[Column]:
        return [F.xxhash64(F.lit(k), df["doc_id"], df["text"]) for k in (1, 2)]

    k1, k2 = keys(docs)
    digests = write_and_read(docs.select(F.col("doc_id").cast("long").alias("doc_id"), k1.alias("k1"), k2.alias("k2"),
                                         fingerprints("text").alias("code")), "simhash")
    groups = digests.join(near_components(digests, radius), "code")
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "k1", "k2")
    winners = groups.groupBy("root").agg(F.min(order).alias("w")).select("w.k1", "w.k2")
    whole = docs.select(F.struct("*").alias("_row"), k1.alias("k1"), k2.alias("k2"))
    kept = whole.join(winners, ["k1", "k2"], "left_semi")
    first = Window.partitionBy("k1", "k2").orderBy(F.xxhash64(F.col("_row").cast("string")))
    return kept.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("_row.*")
