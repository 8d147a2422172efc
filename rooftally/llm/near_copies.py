"""Near copies by Jaccard similarity of five-word shingles, found by SimHash (the pipeline's stage).

Two texts are linked if their sets of five-word shingles reach a similarity of 4 / 5. Candidates are all pairs of different texts whose
fingerprints of ``64 * WORDS`` bits, taken over the sets, differ in at most ``RADIUS`` bits and whose sizes allow the similarity; each link is
then decided by the sets themselves.

The radius: at a similarity of 0.8 a bit differs with a probability of about 0.15 (0.19 for texts of five shingles), so 39 (49) of 256 bits on
average with a deviation of 6, and over 80 in fewer than one of a million pairs; nothing else can leave a pair out. Texts that share
nothing differ in 128 bits with a deviation of 8, so hardly any other pair becomes a candidate.

Scale: the first round moves numbers only, a fingerprint, a size and a number for each text. Texts of like size (cells by the logarithm of
the size) are dealt into tiles of ``TILE``, and pairs of tiles are compared by exclusive-or and bit counts, leaving out blocks whose population counts differ
beyond the radius. That stays quadratic, as the method is. A pair of tiles gives a spanning forest of what it links, never its pairs. The second round
takes the sets of those texts only that have a candidate: small groups share tasks of about ``SHINGLES`` shingles, a large group is cut into
tiles of that size which meet pairwise. Links are decided inside the task, nearest groups being left out as soon as they are connected, so no list
of pairs exists anywhere. Every step is a written table.

Defined cases: NULL texts and texts without words are copies of each other; shorter texts than a shingle are one shingle. Repeated rows and copies are one
text until the end, where one row of a group stays: the smallest doc_id (NULL last), then by hash. Empty tables stay empty; extra columns are kept.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from rooftally.llm.common import text_key
from rooftally.llm.components import connected_components
from rooftally.llm.simhash import local_roots, shingle_hashes
from rooftally.workspace import write_and_read

SHINGLE = 5
WORDS, RADIUS = 4, 80
TILE = 32768
#: Shingles of a tile of the second round, eight bytes each.
SHINGLES = 1 << 19
#: Slots of the histograms that bound the shared shingles.
SLOTS = 256
#: Ratio of sizes in a cell; a little over 5 / 4, so that rounding moves no pair past the neighbouring cell.
STEP = 1.26
#: Rows of a tile compared at a time.
ROWS = 128
_CODE = [f"w{k}" for k in range(WORDS)]


def shingle_set(text: str | None) -> np.ndarray:
    """The different hashes of a text's shingles, rising."""
    return np.unique(shingle_hashes(text, SHINGLE))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """``WORDS`` numbers whose bits are set in over half the hashes, each word over a mix of its own of the hashes."""
    out = np.zeros(WORDS, "<u8")
    for k in range(WORDS):
        counts = np.zeros(64, np.int64)
        mixed = hashes + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) % 2 ** 64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
        bits = np.unpackbits(mixed.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for at in range(0, len(bits), 255):  # sums of 255 rows fit a byte
            counts += bits[at:at + 255].sum(axis=0, dtype=np.uint8)
        out[k] = np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0]
    return out


_SKETCH = T.StructType([T.StructField(c, T.LongType()) for c in [*_CODE, "size"]])


@F.pandas_udf(_SKETCH)
def sketches(texts: pd.Series) -> pd.DataFrame:
    sets = [shingle_set(t) for t in texts]
    codes = np.array([wide_fingerprint(s) for s in sets], np.uint64).reshape(-1, WORDS).view(np.int64)
    return pd.DataFrame({**dict(zip(_CODE, codes.T)), "size": [len(s) for s in sets]})


@F.pandas_udf(T.ArrayType(T.LongType()))
def shingle_sets(texts: pd.Series) -> pd.Series:
    return pd.Series([shingle_set(t).view(np.int64) for t in texts], dtype=object)


# --- first round: candidates by fingerprints ------------------------------------------------------------------------
def candidate_blocks(x: np.ndarray, y: np.ndarray, radius: int, rows: int = ROWS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i, j) of rows of two code arrays (n, words) within the radius, a block of x at a time."""
    if not len(x) or not len(y):
        return
    in_x, in_y = (np.bitwise_count(c).sum(axis=1, dtype=np.int64) for c in (x, y))
    by_x, by_y = np.argsort(in_x, kind="stable"), np.argsort(in_y, kind="stable")
    sorted_y, columns = in_y[by_y], np.ascontiguousarray(y[by_y].T)
    for at in range(0, len(x), rows):
        some = by_x[at:at + rows]
        low = np.searchsorted(sorted_y, in_x[some[0]] - radius)
        high = np.searchsorted(sorted_y, in_x[some[-1]] + radius, side="right")
        apart = np.zeros((len(some), high - low), np.uint16)
        for k, column in enumerate(columns):
            apart += np.bitwise_count(x[some, k][:, None] ^ column[None, low:high])
        i, j = np.nonzero(apart <= radius)
        if len(i):
            yield some[i], by_y[low + j]


def candidate_forest(x: np.ndarray, y: np.ndarray, size_x: np.ndarray, size_y: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the rows of x and y (numbered behind those of x, or the same rows) exactly as all candidates do."""
    n = len(x)
    shift = 0 if same else n
    root = np.arange(n if same else n + len(y))
    for i, j in candidate_blocks(x, y, radius):
        fits = (5 * np.minimum(size_x[i], size_y[j]) >= 4 * np.maximum(size_x[i], size_y[j])) & (root[i] != root[j + shift])
        i, j = i[fits], j[fits] + shift
        if len(i):
            away = np.flatnonzero(root != np.arange(len(root)))
            root = local_roots(np.concatenate([away, i]), np.concatenate([root[away], j]), len(root))
    away = np.flatnonzero(root != np.arange(len(root)))
    return away, root[away]


def _codes(group: pa.Table) -> np.ndarray:
    return np.stack([group.column(c).to_numpy() for c in _CODE], axis=1).view(np.uint64)


def _compare(radius: int) -> Callable[[pa.Table], pa.Table]:
    """Candidates of a pair of tiles; ``side`` tells the tiles apart, and a tile by itself is paired with itself."""
    def run(group: pa.Table) -> pa.Table:
        side = group.column("side").to_numpy()
        ids, sizes, codes = group.column("id").to_numpy(), group.column("size").to_numpy(), _codes(group)
        one, other = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = not len(other) and group.column("b")[0] == group.column("a")[0]
        right = one if same else other
        i, j = candidate_forest(codes[one], codes[right], sizes[one], sizes[right], same, radius)
        names = ids[one] if same else np.concatenate([ids[one], ids[other]])
        return pa.table({"src": names[i], "dst": names[j]})
    return run


def candidate_links(texts: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """A spanning forest (src, dst) of the candidates among rows (id, w0, …, size)."""
    cell = F.when(F.col("size") > 0, F.floor(F.log(F.col("size").cast("double")) / math.log(STEP)) + 1).otherwise(0).cast("long")
    celled = texts.withColumn("cell", cell)
    tiles = celled.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    after = tiles.select((F.col("cell") - 1).alias("cell"), F.col("tiles").alias("next"))
    # the logarithms of sizes are few, so the table of the cells has a fixed bound
    frame = F.broadcast(tiles.join(F.broadcast(after), "cell", "left").withColumn("next", F.coalesce("next", F.lit(0))))
    before = F.broadcast(tiles.select((F.col("cell") + 1).alias("cell"), F.col("tiles").alias("last")))
    dealt = celled.join(frame, "cell").join(before, "cell", "left").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    # a tile meets itself and the later ones of its cell, and all of the next cell: a pair is named (cell, tile, next?, tile)
    def pair(a, b, step, side):
        return f"named_struct('cell', {'cell - 1' if side and step else 'cell'}, 'a', {a}, 'step', {step}, 'b', {b}, 'side', {side})"

    own = f"transform(sequence(0, tiles - 1), t -> if(t >= tile, {pair('tile', 't', 0, 0)}, {pair('t', 'tile', 0, 1)}))"
    ahead = f"transform(if(next > 0, sequence(0, next - 1), array()), t -> {pair('tile', 't', 1, 0)})"
    behind = f"transform(if(last > 0, sequence(0, last - 1), array()), t -> {pair('t', 'tile', 1, 1)})"
    spread = dealt.selectExpr("id", *_CODE, "size", f"inline(concat({own}, {ahead}, {behind}))")
    return spread.groupBy("cell", "a", "step", "b").applyInArrow(_compare(radius), "src long, dst long")


# --- second round: links by the sets -----------------------------------------------------------------------------------
class Sets:
    """Shingle sets of some texts one behind the other."""

    def __init__(self, group: pa.Table, rows: np.ndarray):
        some = group.take(pa.array(rows))
        lists = some.column("s").combine_chunks()
        self.ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        self.values = lists.flatten().to_numpy().view(np.uint64)
        self.codes, self.ids, self.sizes = _codes(some), some.column("id").to_numpy(), some.column("size").to_numpy()
        place = np.repeat(np.arange(len(rows)), np.diff(self.ends)) * SLOTS + (self.values & np.uint64(SLOTS - 1)).astype(np.int64)
        self.slots = np.minimum(np.bincount(place, minlength=len(rows) * SLOTS), 32767).astype(np.int16).reshape(-1, SLOTS)

    def of(self, k: int) -> np.ndarray:
        return self.values[self.ends[k]:self.ends[k + 1]]


def alike(x: Sets, y: Sets, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs reach the similarity: a bound by the histograms, then the shared shingles themselves."""
    out = np.zeros(len(i), bool)
    for at in range(0, len(i), 4096):
        a, b = i[at:at + 4096], j[at:at + 4096]
        apart = np.abs(x.slots[a] - y.slots[b]).sum(axis=1, dtype=np.int64)
        for k in np.flatnonzero(9 * apart <= x.sizes[a] + y.sizes[b]):
            one, other = x.of(a[k]), y.of(b[k])
            if len(one) > len(other):
                one, other = other, one
            place = np.minimum(np.searchsorted(other, one), max(len(other) - 1, 0))
            shared = int((other[place] == one).sum()) if len(other) else 0
            out[at + k] = 9 * shared >= 4 * (len(one) + len(other))
    return out


def true_forest(x: Sets, y: Sets, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the texts exactly as all candidates that reach the similarity do."""
    n = len(x.ids)
    shift = 0 if same else n
    root = np.arange(n if same else n + len(y.ids))
    for i, j in candidate_blocks(x.codes, y.codes, radius):
        fits = 5 * np.minimum(x.sizes[i], y.sizes[j]) >= 4 * np.maximum(x.sizes[i], y.sizes[j])
        i, j = i[fits], j[fits]
        some = 1
        while len(i):
            open_ = root[i] != root[j + shift]  # most are connected once the first of their group are
            i, j = i[open_], j[open_]
            starts = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, np.int64)
            place = np.arange(len(i)) - np.repeat(starts, np.diff(np.append(starts, len(i))))
            take = np.flatnonzero(place < some)  # of each row one candidate, then two, four, ...
            some *= 2
            good = take[alike(x, y, i[take], j[take])]
            away = np.flatnonzero(root != np.arange(len(root)))
            root = local_roots(np.concatenate([away, i[good]]), np.concatenate([root[away], j[good] + shift]), len(root))
            rest = np.ones(len(i), bool)
            rest[take] = False
            i, j = i[rest], j[rest]
    away = np.flatnonzero(root != np.arange(len(root)))
    return away, root[away]


def _decide(radius: int) -> Callable[[pa.Table], pa.Table]:
    """Links of a task's groups: whole small ones, or two tiles of a large one."""
    def run(table: pa.Table) -> pa.Table:
        root, side = table.column("root").to_numpy(), table.column("side").to_numpy()
        lone = table.column("a")[0] == table.column("b")[0]
        order = np.argsort(root, kind="stable")
        cuts = np.flatnonzero(np.diff(root[order])) + 1
        src, dst = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for rows in np.split(order, cuts):
            x = Sets(table, rows[side[rows] == 0])
            y = x if lone else Sets(table, rows[side[rows] == 1])
            i, j = true_forest(x, y, lone, radius)
            names = x.ids if lone else np.concatenate([x.ids, y.ids])
            src.append(names[i])
            dst.append(names[j])
        return pa.table({"src": np.concatenate(src), "dst": np.concatenate(dst)})
    return run


def true_links(members: DataFrame, radius: int = RADIUS, shingles: int = SHINGLES) -> DataFrame:
    """A spanning forest (src, dst) of the links within each group, from rows (root, id, w0, …, size, s)."""
    whole = members.groupBy("root").agg(F.sum(F.col("size") + 8).alias("held"))
    frame = write_and_read(whole.withColumn("tiles", F.ceil(F.col("held") / shingles).cast("int")), "groups")
    small = frame.filter("tiles = 1").agg(F.sum("held").alias("held")).first().held or 0
    dealt = members.join(frame.select("root", "tiles"), "root").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    # small groups share a bucket; its number can't be that of a large group, which has two keys more
    bucket = F.pmod(F.xxhash64("root"), F.lit(max(1, -(-small // shingles)))).cast("long")
    keyed = dealt.withColumn("key", F.when(F.col("tiles") == 1, bucket).otherwise(F.col("root")))
    meet = """transform(sequence(0, tiles - 1), t -> if(t >= tile, named_struct('a', tile, 'b', t, 'side', 0),
                                                                  named_struct('a', t, 'b', tile, 'side', 1)))"""
    spread = keyed.selectExpr("root", "id", *_CODE, "size", "s", "key", "tiles > 1 AS large", f"inline({meet})")
    return spread.groupBy("key", "large", "a", "b").applyInArrow(_decide(radius), "src long, dst long")


def near_roots(texts: DataFrame, docs: DataFrame, radius: int = RADIUS, tile: int = TILE, shingles: int = SHINGLES) -> DataFrame:
    """(id, root) for the texts with a link. ``texts`` has id, k1, k2, w0, …, size; ``docs`` has k1, k2 and the text of each of them."""
    groups = connected_components(write_and_read(candidate_links(texts, radius, tile), "candidates"))
    members = write_and_read(texts.join(groups.withColumnRenamed("node", "id"), "id"), "members")
    rows = docs.join(members.select("k1", "k2", "root", "id", *_CODE, "size"), ["k1", "k2"])
    sets = write_and_read(rows.select("root", "id", *_CODE, "size", shingle_sets("text").alias("s")).dropDuplicates(["id"]), "shingles")
    return connected_components(write_and_read(true_links(sets, radius, shingles), "links")).withColumnRenamed("node", "id")


def drop_near_copies(docs: DataFrame, radius: int = RADIUS, tile: int = TILE, shingles: int = SHINGLES) -> DataFrame:
    """The documents with one left of each group of linked texts: the smallest doc_id, and of its rows one.

    All columns are kept, whatever their names; only rows that may stay are shuffled with their texts.
    """
    def keys(df: DataFrame) -> list[Column]:
        return [F.xxhash64(F.lit(k), df["doc_id"], df["text"]).alias(f"k{k}") for k in (1, 2)]

    t1, t2 = text_key(docs["text"])
    digests = write_and_read(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keys(docs), t1.alias("t1"), t2.alias("t2"),
                                         sketches(docs["text"]).alias("s")).select("doc_id", "k1", "k2", "t1", "t2", "s.*"), "sketches")
    first = digests.groupBy("t1", "t2").agg(F.min(F.struct("k1", "k2")).alias("k"), *[F.first(c).alias(c) for c in (*_CODE, "size")])
    texts = write_and_read(first.select("t1", "t2", "k.*", *_CODE, "size").withColumn("id", F.monotonically_increasing_id()), "texts")
    roots = write_and_read(near_roots(texts.drop("t1", "t2"), docs.select(*keys(docs), docs["text"].alias("text")), radius, tile, shingles), "near")
    named = write_and_read(texts.select("t1", "t2", "id").join(roots, "id", "left").select("t1", "t2", F.coalesce("root", "id").alias("root")), "named")
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "k1", "k2")
    # copies of a text are settled before the join, so that it has a row for each text
    least = digests.groupBy("t1", "t2").agg(F.min(order).alias("w"))
    winners = least.join(named, ["t1", "t2"]).groupBy("root").agg(F.min("w").alias("w")).select("w.k1", "w.k2")
    winners = write_and_read(winners, "winners")
    k1, k2 = keys(docs)
    whole = docs.select(F.struct("*").alias("_row"), k1, k2)
    kept = whole.join(winners, ["k1", "k2"], "left_semi")
    one = Window.partitionBy("k1", "k2").orderBy(F.xxhash64(F.col("_row").cast("string")))
    return kept.withColumn("_n", F.row_number().over(one)).filter("_n = 1").select("_row.*")
