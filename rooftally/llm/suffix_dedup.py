"""Removal of repeated byte strings by blockwise suffix sorting (operator 8).

A byte goes if it is covered by a string of ``LENGTH`` bytes that also starts earlier. Suffixes are dealt to buckets by
content: every window of LENGTH bytes belongs to its anchor, the leftmost of its ``GRAM``-byte pieces with the least hash, so equal windows
have equal anchors. Suffixes whose anchor occurs once have no partner and are never sorted. Each bucket of the others is sorted by itself with
a difference cover (see suffix_sort.py), whose precomputed sample ranks settle long ties in bounded memory.

Scale: equal texts are one before anything else; the others are written once, bucketed by their hash, so that later joins shuffle only
short rows. Anchors stand about forty bytes apart and travel packed. Of the text only the surroundings of repeated anchors are
shuffled, with equal ones collapsed before the shuffle. An anchor that repeats over ``HOT`` times is split further: its windows are dealt
by their own hash, so a passage that a third of the documents share doesn't meet in one task. Matches end at documents, so no state
crosses them.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rooftally.llm.common import chunks, text_key
from rooftally.llm.suffix_sort import PERIOD, earliest_equal
from rooftally.workspace import fresh_path, write_and_read

LENGTH = 100
GRAM = 24
#: Anchors of an exchange part, and contexts of a sorting bucket.
PART_ANCHORS = 500_000
BUCKET_CONTEXTS = 20_000
#: Occurrences from which an anchor's windows are dealt one by one.
HOT = 2_000
#: Bytes of text hashed at a time.
AT_ONCE = 1 << 21
_PLACE_BITS = 22  # of a place among AT_ONCE bytes and one text's overlap

_MIX = np.uint64(0xFF51AFD7ED558CCD)
_MUL = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of the ``size`` bytes from each position, put together from powers of two."""
    power, width, out, done = data.astype(np.uint64) * _MIX, 1, None, 0
    power ^= power >> np.uint64(32)
    left = size
    while left:
        if left & 1:
            if out is None:
                out = power.copy()
            else:
                n = len(data) - done - width + 1
                out = (out[:n] * _MUL) ^ power[done:done + n]
                out *= _MIX
                out ^= out >> np.uint64(29)
            done += width
        left >>= 1
        if left:
            n = len(power) - width
            power = (power[:n] * _MUL) ^ power[width:width + n]
            power *= _MIX
            power ^= power >> np.uint64(31)
            width *= 2
    return out


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    span, n = 1, len(values) - width + 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[:n], values[width - span:width - span + n])


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first window, number of windows) of the anchors of one text, in order of place."""
    out: list[tuple[np.ndarray, ...]] = []
    total = len(data) - length + 1
    for at in range(0, max(total, 0), AT_ONCE):
        part = data[at:min(at + AT_ONCE, total) + length - 1]
        hashes = gram_hashes(part, gram)
        # the high bits choose, then the place: the leftmost of equals
        keys = (hashes >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | np.arange(len(hashes), dtype=np.uint64)
        place = (_sliding_least(keys, length - gram + 1) & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        out.append((hashes[place[first]], place[first] + at, first + at, np.diff(np.append(first, len(place)))))
    if not out:
        empty = np.empty(0, np.int64)
        return empty.astype(np.uint64), empty, empty, empty
    return tuple(np.concatenate(x) for x in zip(*out))


def _emit_anchors(parts: int):
    names = ["part", "keys", "counts", "hashes", "places"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed(held: list[tuple]) -> pa.RecordBatch:
            keys = np.array([h[0] for h in held], np.int64)
            sizes = np.array([len(h[1]) for h in held])
            hashes, places = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            doc = np.repeat(np.arange(len(held)), sizes)
            part = (hashes % np.uint64(parts)).astype(np.int64)
            by = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[by], np.arange(parts + 1))
            rows = []
            for p in range(parts):
                own = by[edges[p]:edges[p + 1]]
                if len(own):
                    docs, counts = np.unique(doc[own], return_counts=True)
                    rows.append((p, keys[docs].tobytes(), counts.astype(np.uint32).tobytes(), hashes[own].tobytes(), places[own].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] + [pa.binary()] * 4)], names)

        held, size = [], 0
        for batch in batches:
            for t1, t2, text in zip(batch.column("t1"), batch.column("t2"), batch.column("text")):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                hashes, place, first, n = anchors(data)
                if len(hashes):
                    packed = (place << 16) | ((place - first) << 8) | n
                    held.append(((t1.as_py(), t2.as_py()), hashes, packed))
                    size += len(hashes)
                if size > 400_000:
                    yield closed(held)
                    held, size = [], 0
        if held:
            yield closed(held)
    return run


def _repeated(part: pa.Table, hot: int) -> pa.Table:
    """Of one part of the anchors those that occur twice or more, by text; the places of those over ``hot`` times are negative."""
    keys = np.concatenate([np.frombuffer(x.as_buffer(), np.int64).reshape(-1, 2) for x in part["keys"]])
    counts = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in part["counts"]])
    hashes = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in part["hashes"]])
    places = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in part["places"]])
    by = np.argsort(hashes)
    starts = np.flatnonzero(np.concatenate([[True], hashes[by][1:] != hashes[by][:-1]])) if len(by) else by
    sizes = np.diff(np.append(starts, len(by)))
    times = np.empty(len(by), np.int64)
    times[by] = np.repeat(sizes, sizes)
    doc = np.repeat(np.arange(len(counts)), counts)[times > 1]
    kept = np.where(times > hot, -places, places)[times > 1]
    docs, n = np.unique(doc, return_counts=True)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(kept))
    return pa.table({"t1": pa.array(keys[docs, 0]), "t2": pa.array(keys[docs, 1]), "places": lists})


def _contexts(buckets: int):
    """Rows (bucket, meta, data): the surroundings of repeated anchors. Meta has (doc_id, no id, t1, t2, first window, windows)."""
    from xxhash import xxh64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [(d is None, d or 0, a, b) for d, a, b in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "t1", "t2")])]
            # texts in order, so that the first of equal contexts is the earliest
            seen: set[bytes] = set()
            found: dict[int, tuple[list, list]] = {}

            def add(bucket: int, meta: tuple, data: bytes) -> None:
                own = found.setdefault(bucket, ([], []))
                own[0].append(meta)
                own[1].append(data)

            for r in sorted(range(batch.num_rows), key=ids.__getitem__):
                text = batch.column("text")[r].as_buffer().to_pybytes()
                none, doc, a, b = ids[r]
                for place in sorted(batch.column("places")[r].values.to_pylist(), key=abs):
                    hot, place = place < 0, abs(place)
                    at, n = place >> 16, place & 255
                    first = at - ((place >> 8) & 255)
                    key = None if hot else xxh64_intdigest(text[at:at + GRAM])
                    for start, many in [(first, n)] if not hot else [(first + k, 1) for k in range(n)]:
                        data = text[start:start + many - 1 + LENGTH]
                        meta = (doc, none, a, b, start, many)
                        if data in seen:  # repeats an earlier one of this batch: settled, and sent on by its text
                            add(buckets + a % buckets, meta, b"")
                        else:
                            seen.add(data)
                            add((xxh64_intdigest(data) if key is None else key) % buckets, meta, data)
            rows = [(k, np.array(m, np.int64).tobytes(), b"".join(d)) for k, (m, d) in found.items()]
            cols = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.binary()))],
                                             ["bucket", "meta", "data"])
    return run


def _settled(meta: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of meta, first, last) of the runs of repeated windows among the contexts of one bucket."""
    size = meta[:, 5] + (LENGTH - 1)
    at = np.cumsum(size) - size
    by = np.lexsort([meta[:, 4], meta[:, 3], meta[:, 2], meta[:, 0], meta[:, 1]])
    raw, known, once, again = data.tobytes(), {}, [], []
    for r in by.tolist():
        (again if known.setdefault(raw[at[r]:at[r] + size[r]], r) != r else once).append(r)
    again, once = np.array(again, np.int64), np.array(once, np.int64)
    n = meta[once, 5]
    owner = np.repeat(np.arange(len(once)), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    order = owner * 256 + offset  # texts in order, and a text's contexts don't overlap in their windows
    least = earliest_equal(data, at[once][owner] + offset, order, LENGTH)
    bad = np.flatnonzero(least < order)
    breaks = np.flatnonzero(np.diff(order[bad]) != 1) + 1
    first, last = (bad[np.append(0, breaks)], bad[np.append(breaks, len(bad)) - 1]) if len(bad) else (bad, bad)
    rows = np.concatenate([again, once[owner[first]]])
    starts = np.concatenate([meta[again, 4], meta[once[owner[first]], 4] + offset[first]])
    ends = np.concatenate([meta[again, 4] + meta[again, 5] - 1, meta[once[owner[first]], 4] + offset[last]])
    return rows, starts, ends


def _sort_bucket(bucket: pa.Table) -> pa.Table:
    metas, datas = ([x for x in bucket[c]] for c in ("meta", "data"))
    meta = np.concatenate([np.frombuffer(x.as_buffer(), np.int64).reshape(-1, 6) for x in metas])
    data = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in datas])
    if len(data):
        rows, first, last = _settled(meta, data)
    else:  # contexts that were settled before the shuffle
        rows, first, last = np.arange(len(meta)), meta[:, 4], meta[:, 4] + meta[:, 5] - 1
    by = np.lexsort([first, meta[rows, 3], meta[rows, 2]])
    rows, first, last = rows[by], first[by], last[by]
    keys = meta[rows][:, 2:4]
    new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])) if len(rows) else np.empty(0, np.int64)
    offsets = pa.array(np.append(new, len(rows)).astype(np.int32))
    return pa.table({"t1": pa.array(keys[new, 0]), "t2": pa.array(keys[new, 1]),
                     "first": pa.ListArray.from_arrays(offsets, pa.array(first)),
                     "last": pa.ListArray.from_arrays(offsets, pa.array(last))})


def spans(first: np.ndarray, last: np.ndarray) -> list[tuple[int, int]]:
    """The maximal [start, end) runs of bytes covered by windows first..last."""
    out: list[tuple[int, int]] = []
    for a, b in zip(*[x[np.argsort(first, kind="stable")].tolist() for x in (first, last)]):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b + LENGTH))
        else:
            out.append((a, b + LENGTH))
    return out


def _digest(with_text: bool):
    names = ["t1", "t2", "n_bytes", "n_removed", "starts", "ends", "kept_sha256"] + ["kept"] * with_text
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 2 + [pa.string()] + [pa.binary()] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in range(batch.num_rows):
                text = batch.column("text")[r].as_buffer().to_pybytes()
                runs = []
                if batch.column("first")[r].is_valid:
                    runs = spans(*[batch.column(c)[r].values.to_numpy() for c in ("first", "last")])
                kept, at = [], 0
                for a, b in runs:
                    kept.append(text[at:a])
                    at = b
                left = b"".join([*kept, text[at:]])
                rows.append((batch.column("t1")[r].as_py(), batch.column("t2")[r].as_py(), len(text), len(text) - len(left),
                             [a for a, _ in runs], [b for _, b in runs], hashlib.sha256(left).hexdigest(), *[left] * with_text))
            cols = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)
    return run


def remove_repeats(docs: DataFrame, with_text: bool = False, hot: int = HOT) -> DataFrame:
    """A row for each document: doc_id, n_bytes, n_removed, starts and ends of the removed runs, kept_sha256 (and kept, bytes).

    Texts count as UTF-8; a NULL text is empty. Order is by doc_id, NULL ids last, then by content; rows alike in id and text are
    one document and share its result. Texts under LENGTH bytes lose nothing.
    """
    spark = docs.sparkSession
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    t1, t2 = text_key(F.col("text"))
    body = body.select("doc_id", t1.alias("t1"), t2.alias("t2"), "text")
    # different texts, written in buckets of their key: the joins below leave them where they are
    buckets, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"texts_{uuid.uuid4().hex}"
    (body.groupBy("t1", "t2").agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text"))
     .withColumn("text", F.encode("text", "UTF-8"))
     .write.format("parquet").option("path", fresh_path(spark, "texts")).bucketBy(min(buckets, 100_000), "t1", "t2").saveAsTable(name))
    texts = spark.table(name)
    total = texts.agg(F.sum(F.length("text"))).head()[0] or 0
    parts = chunks(total, 40 * PART_ANCHORS)
    packed = texts.filter(F.length("text") >= LENGTH).select("t1", "t2", "text").mapInArrow(
        _emit_anchors(parts), "part long, keys binary, counts binary, hashes binary, places binary")
    repeated = write_and_read(packed.groupBy("part").applyInArrow(lambda part: _repeated(part, hot), "t1 long, t2 long, places array<long>"), "anchors")
    sorting = chunks(repeated.agg(F.sum(F.size("places"))).head()[0] or 0, BUCKET_CONTEXTS)
    of_text = repeated.groupBy("t1", "t2").agg(F.flatten(F.collect_list("places")).alias("places"))
    contexts = texts.join(of_text.hint("shuffle_hash"), ["t1", "t2"]).select("doc_id", "t1", "t2", "text", "places").mapInArrow(
        _contexts(sorting), "bucket long, meta binary, data binary")
    runs = contexts.groupBy("bucket").applyInArrow(_sort_bucket, "t1 long, t2 long, first array<long>, last array<long>")
    runs = write_and_read(runs, "runs").groupBy("t1", "t2").agg(
        F.flatten(F.collect_list("first")).alias("first"), F.flatten(F.collect_list("last")).alias("last"))
    shape = "t1 long, t2 long, n_bytes long, n_removed long, starts array<long>, ends array<long>, kept_sha256 string"
    digests = texts.join(runs.hint("shuffle_hash"), ["t1", "t2"], "left").select("t1", "t2", "text", "first", "last").mapInArrow(
        _digest(with_text), shape + ", kept binary" * with_text)
    firsts = texts.select("t1", "t2", F.col("doc_id").alias("first_id"))
    # read from a table, so that the join can split a text of very many copies
    known = write_and_read(firsts.join(digests, ["t1", "t2"]), "digests")
    each = body.select("doc_id", "t1", "t2").join(known, ["t1", "t2"])
    copy = ~F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("n_bytes") >= LENGTH)
    return each.select("doc_id", "n_bytes", *[
        F.when(copy, value).otherwise(F.col(c)).alias(c) for c, value in (
            ("n_removed", F.col("n_bytes")), ("starts", F.array(F.lit(0).cast("long"))), ("ends", F.array("n_bytes")),
            ("kept_sha256", F.lit(hashlib.sha256(b"").hexdigest())), *([("kept", F.lit(b""))] if with_text else []))])


assert LENGTH > 2 * PERIOD and LENGTH - GRAM < 255
