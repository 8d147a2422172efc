"""Approximate nearest neighbours with a hash-prefix forest (operator 7).

Each tree of the forest gives every vector a long string of hash bits (signs of random projections) and keeps the strings in a
sorted array. A query descends in each tree to its longest prefix match and then ascends in all trees at once, one bit at a
time, until the vectors under its prefixes are enough; these candidates are scored exactly. Rows not seen whose length times the
query's can still reach the k-th score are scored too, so that no neighbour is lost to unlike lengths.

Nearness is the inner product. Vectors are hashed after adding one component that gives all of a block the same length, so
that large inner products become small angles; queries have zero there.

Scale: equal vectors are one entry with their smallest ids, so copies cost nothing. Entries are dealt by length, and by hash
within one length, to blocks of about ``BLOCK`` rows; a block's forest is built in the task that searches it. The stated query set goes to all blocks in chunks, and
each (chunk, block) gives at most ``k`` rows per query, merged by a ranked window with a map-side limit. The candidates are a
share of the block and what the lengths leave open: with nearly isotropic vectors of like lengths, as here, that is nearly
the whole block, so the work is queries times entries; memory per task is one block and one chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf

from rooftally.llm.common import chunks
from rooftally.workspace import write_and_read

NEAREST = 20
TREES = 48
BITS = 32
#: The part of a block that a query looks at, at least, and its least number of candidates.
SHARE = 0.6
LEAST_CANDIDATES = 400
BLOCK = 8192
CHUNK = 512
SEED = 7


class Forest:
    """Sorted arrays of hash strings over the rows of one block."""

    def __init__(self, vectors: np.ndarray, longest: float, trees: int = TREES, bits: int = BITS, seed: int = SEED):
        self.vectors, self.trees, self.bits = vectors, trees, bits
        self.planes = np.random.default_rng(seed).standard_normal((vectors.shape[1] + 1, trees * bits))
        self.lengths = np.sqrt((vectors ** 2).sum(axis=1))
        rest = np.sqrt(np.maximum(longest ** 2 - self.lengths ** 2, 0.0))
        codes = self.codes(np.concatenate([vectors, rest[:, None]], axis=1))
        self.rows = np.argsort(codes, axis=1, kind="stable")
        self.sorted = np.take_along_axis(codes, self.rows, axis=1)

    def codes(self, lifted: np.ndarray) -> np.ndarray:
        """(tree, row) hash strings, first bit highest."""
        signs = (lifted @ self.planes > 0).reshape(len(lifted), self.trees, self.bits)
        return (signs @ (1 << np.arange(self.bits - 1, -1, -1, dtype=np.int64))).T

    def candidates(self, queries: np.ndarray, least: int, k: int | None = None) -> Iterator[np.ndarray]:
        """For each query the rows under its prefixes, ascending in all trees until they are at least ``least``.

        With ``k`` also the rows whose length lets them reach the k-th score of those.
        """
        codes = self.codes(np.concatenate([queries, np.zeros((len(queries), 1))], axis=1))
        n = self.sorted.shape[1]
        shift = np.arange(self.bits + 1)
        starts, ends = (np.empty((self.trees, len(queries), self.bits + 1), np.int64) for _ in range(2))
        for t in range(self.trees):
            low = (codes[t][:, None] >> shift) << shift  # the prefix without its last bits, and the end of its range
            starts[t] = np.searchsorted(self.sorted[t], low)
            ends[t] = np.searchsorted(self.sorted[t], low + (np.int64(1) << shift))
        # the longest match: the lowest level at which some tree has anything; from there all trees ascend together
        sizes = (ends - starts).sum(axis=0)
        for q in range(len(queries)):
            level = int(np.argmax(sizes[q] >= min(least, n)))
            seen, found = np.zeros(n, bool), 0
            while found < min(least, n):  # the whole block at the latest: every prefix is empty then
                for t in range(self.trees):
                    seen[self.rows[t, starts[t, q, level]:ends[t, q, level]]] = True
                found = np.count_nonzero(seen)
                level += 1
            if k is not None and found < n:
                if found < k:
                    seen[:] = True
                else:
                    edge = np.partition(self.scores(np.flatnonzero(seen), queries[q]), found - k)[found - k]
                    seen |= self.lengths * np.linalg.norm(queries[q]) >= edge - 1e-9 * max(1.0, abs(edge))
            yield np.flatnonzero(seen)

    def scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Inner products of the rows with a query; many rows are cheaper to score all than to copy out."""
        return (self.vectors @ query)[rows] if 4 * len(rows) > len(self.vectors) else self.vectors[rows] @ query


def _search(width: int, share: float, least: int, k: int, trees: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, forest, ids = None, None, None
        for batch in batches:
            for r in range(batch.num_rows):
                block = batch.column("block")[r].as_py()
                if block != at:
                    ids = batch.column("entries")[r].values.to_numpy(zero_copy_only=False)
                    vectors = batch.column("vectors")[r].values.to_numpy(zero_copy_only=False).reshape(-1, width)
                    longest = float(np.sqrt((vectors ** 2).sum(axis=1).max()))
                    forest, at = Forest(vectors, longest, trees, bits), block
                names = batch.column("queries")[r].values.to_numpy(zero_copy_only=False)
                asked = batch.column("asked")[r].values.to_numpy(zero_copy_only=False).reshape(-1, width)
                out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                wanted = max(least, int(np.ceil(share * len(ids))))
                for name, query, found in zip(names, asked, forest.candidates(asked, wanted, k)):
                    scores = forest.scores(found, query)
                    if len(found) > k:  # with all ties of the last place: the smaller ids win later
                        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
                        near = scores >= edge - 1e-12 * max(1.0, abs(edge))
                        found, scores = found[near], scores[near]
                    out.append((np.full(len(found), name), ids[found], scores))
                q, e, s = (np.concatenate([o[c] for o in out]) for c in range(3))
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(e), pa.array(s)], ["query", "entry", "near"])
    return run


def _by_length(squares: DataFrame, blocks: int):
    """The block of a squared length and a hash: quantiles of the lengths; a length that spans several blocks is dealt by the hash."""
    at = [k / blocks for k in range(1, blocks)]
    bounds = np.array(squares.agg(F.percentile_approx("square", at, 100 * blocks).alias("q")).head()["q"] if at else [], float)

    @pandas_udf("long")
    def block(square: pd.Series, code: pd.Series) -> pd.Series:
        first, last = (np.searchsorted(bounds, square.to_numpy(), side) for side in ("left", "right"))
        return pd.Series(first + code.to_numpy() % (last - first + 1))

    return block


def _clean(vectors: DataFrame, name: str) -> DataFrame:
    """(vec_id, v): vectors in double precision that are not NULL, zero, or with a NULL or non-finite component."""
    v = F.transform(F.col(name), lambda x: x.cast("double"))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return kept.filter("v is not null and vec_id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and "
                       "abs(x) < double('infinity')) and exists(v, x -> x <> 0)")


def nearest(vectors: DataFrame, is_query, embedding: str = "embedding", *, k: int = NEAREST, share: float = SHARE,
            least: int = LEAST_CANDIDATES, trees: int = TREES, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row for which the column ``is_query`` holds.

    Candidates are all rows but the query's own; equal scores rank by vec_id. Vectors that are NULL, zero or not finite, and
    rows without a vec_id, take no part; all others must have one length. Repeated rows of one vec_id are one row for a
    query with that id, and candidates each for others.
    """
    known = write_and_read(_clean(vectors, embedding).withColumn("asked", is_query), "vectors")
    shape = known.agg(F.min(F.size("v")).alias("a"), F.max(F.size("v")).alias("b"), F.count(F.lit(1)).alias("n")).head()
    empty = "query_id long, rank int, vec_id long, score double"
    if not shape["n"]:
        return vectors.sparkSession.createDataFrame([], empty)
    if shape["a"] != shape["b"]:
        raise ValueError(f"vectors of {shape['a']} and {shape['b']} components")
    width = shape["a"]
    # one entry for equal vectors; an entry's number is the smallest id
    entries = write_and_read(known.groupBy("v").agg(F.min("vec_id").alias("entry"), F.max("asked").alias("asked")), "entries")
    blocks = chunks(entries.count(), block)
    squares = entries.withColumn("square", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    dealt = squares.withColumn("block", _by_length(squares, blocks)("square", F.xxhash64("entry"))).drop("square")
    inner = F.collect_list(F.struct("entry", "v"))
    index = dealt.groupBy("block").agg(inner.alias("x")).select("block", F.col("x.entry").alias("entries"),
                                                               F.flatten("x.v").alias("vectors"))
    asked = entries.filter("asked")
    sets = chunks(asked.count(), CHUNK)
    chunked = (asked.groupBy(F.pmod(F.xxhash64("entry", F.lit(1)), F.lit(sets)).alias("chunk")).agg(inner.alias("x"))
               .select("chunk", F.col("x.entry").alias("queries"), F.flatten("x.v").alias("asked"),
                       F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("at")))
    pairs = index.join(chunked, F.col("block") == F.col("at").cast("long"))
    spread = pairs.repartition(min(blocks * sets, 4096), "block", "chunk").select("block", "entries", "vectors", "queries", "asked")
    found = spread.mapInArrow(_search(width, share, least, k + 1, trees, bits),
                              "query long, entry long, near double")
    best = Window.partitionBy("query").orderBy(F.desc("near"), "entry")
    # k + 1 entries hold the k nearest rows other than the query's own, ties included: an entry's number is its smallest id
    kept = write_and_read(found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1), "found")
    # back to rows: of an entry only its smallest k + 1 ids can be among the nearest
    ids = Window.partitionBy("entry").orderBy("vec_id")
    named = known.join(entries.select(F.col("v").alias("w"), "entry"), F.col("v") == F.col("w")).select("entry", "vec_id", "asked")
    members = named.withColumn("m", F.row_number().over(ids)).filter(F.col("m") <= k + 1).select("entry", "vec_id")
    queries = named.filter("asked").select(F.col("entry").alias("query"), F.col("vec_id").alias("query_id")).distinct()
    # the ranking of an entry's members is common to all queries with that vector, cut to k + 1 rows before it is joined to them
    merged = Window.partitionBy("query").orderBy(F.desc("near"), "vec_id")
    common = kept.join(members, "entry").withColumn("n", F.row_number().over(merged)).filter(F.col("n") <= k + 1)
    own = queries.join(common.select("query", "vec_id", "near"), "query").filter("vec_id <> query_id")
    rank = Window.partitionBy("query_id").orderBy(F.desc("near"), "vec_id")
    return own.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("near").alias("score"))
