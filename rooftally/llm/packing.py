"""Vector bin packing of token sequences (operator 9).

Every document is tokenised and cut at multiples of the sequence length. Full pieces are sequences of their own; the
remaining pieces are vectors (tokens, segments, loss-bearing tokens) that a dot-product heuristic places under all three
limits at once: an open sequence takes the piece whose demand points most in the direction of what it has left.

Scale: tokenising is a narrow map, and only short rows about pieces are shuffled, never texts or ids. Pieces are dealt to
groups of about ``group_rows`` by a content hash; each group is packed on its own in one small task, so no group grows
with the input, and a source or a set of copies of any size is spread over all groups. A task that runs again makes the same
sequences.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from rooftally.llm.common import chunks, distinct_words, text_key
from rooftally.workspace import write_and_read

SEQUENCE = 1024
MOST_SEGMENTS = 64
GROUP_ROWS = 8192
#: Words whose ids a worker remembers, and their characters, for speed alone; when they are too many, only those at hand are kept.
REMEMBERED_WORDS, REMEMBERED_LETTERS = 1_000_000, 1 << 24
#: Bytes of texts that are encoded together, so that a word that repeats among them is looked up once.
PORTION = 1 << 23

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, loss long, mix long"
PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, group long, bin long, offset long"


#: Latin letters, which are letters for the tokenizer too, and what may follow them in a word after a certain boundary.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_HEAD = re.compile(f"([{_LETTERS}]+)(?:([,.;:!?].*))?", re.DOTALL)


def _octet_names() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte: its own, or one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + k) for k, b in enumerate(others)}}


class WordEncoder:
    """Byte-level BPE ids of texts as little-endian unsigned 32-bit bytes, with remembered words.

    The tokenizer's pieces never reach from a character that isn't white space to one that is. A text is therefore cut before
    each such space, and the ids of `` word`` don't depend on what stands around it. Texts with runs of white space before
    a space are given to the tokenizer whole. A word of Latin letters is one piece, and so are the letters of a word that goes
    on with a punctuation mark: they go to the tokenizer's model directly.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.names = _octet_names()
        self.space = self.names[32]
        self.remembered = remembered
        self.letters = 0
        self.words: dict[str, bytes | None] = {}
        self.tails: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, missing: set[str]) -> None:
        """Remember words that follow a space."""
        self.letters += sum(map(len, missing))
        tokenize, space, names, words, tails = self.model.tokenize, self.space, self.names, self.words, self.tails
        others, tailed = [], []
        for word in missing:
            if word.isascii() and word.isalpha():
                if word not in words:
                    words[word] = array("I", [t.id for t in tokenize(space + word)]).tobytes()
                continue
            parts = _HEAD.fullmatch(word)
            # an empty word, or one that ends in white space, stands before a run of white space
            if not word or word[-1].isspace():
                words[word] = None
            elif parts is None:
                others.append(word)
            else:
                head, tail = parts.groups()
                if (ids := words.get(head)) is None:
                    piece = head if head.isascii() else head.encode().decode("latin-1").translate(names)
                    ids = words[head] = array("I", [t.id for t in tokenize(space + piece)]).tobytes()
                if tail:
                    tailed.append((word, ids, tail))
        words.update(zip(others, self._ids([" " + w for w in others])))
        new = list({t for _, _, t in tailed if t not in tails})
        tails.update(zip(new, self._ids(new)))
        words.update((word, ids + tails[tail]) for word, ids, tail in tailed)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; empty for an empty text."""
        parts = [t.partition(" ") for t in texts]
        # the words behind the first space of each text that has one
        sizes, which, distinct = distinct_words([rest for _, space, rest in parts if space])
        words = self.words
        missing = {w for w in distinct if w not in words}
        if missing:
            if len(words) + len(missing) > self.remembered or self.letters > REMEMBERED_LETTERS:
                # the words at hand stay, as the frequent ones are among them
                self.words = words = {w: words[w] for w in distinct if w in words}
                self.tails.clear()
                self.letters = sum(map(len, words))
            self._learn(missing)
        found = [words[w] for w in distinct]
        blank = np.fromiter((f is None for f in found), bool, len(found))[which]
        counts = np.fromiter((len(f or b"") // 4 for f in found), np.int64, len(found))
        at = (np.cumsum(counts) - counts)[which]
        counts = counts[which]
        ends = np.append(0, np.cumsum(counts))
        ids = np.frombuffer(b"".join(f for f in found if f), "<u4")[np.arange(ends[-1]) + np.repeat(at - ends[:-1], counts)]
        stops = np.append(0, np.cumsum(sizes))
        blanks = np.append(0, np.cumsum(blank))[stops]
        stops = ends[stops]
        out = self._ids([head for head, _, _ in parts])
        whole = []
        k = 0
        for i, (head, space, _) in enumerate(parts):
            if space:
                if not head or head[-1].isspace() or blanks[k + 1] > blanks[k]:
                    whole.append(i)
                else:
                    out[i] += ids[stops[k]:stops[k + 1]].tobytes()
                k += 1
        for i, all_ids in zip(whole, self._ids([texts[i] for i in whole])):
            out[i] = all_ids
        return out


@lru_cache(1)
def _encoder(path: str) -> WordEncoder:
    """The encoder that a worker keeps for all its tasks."""
    return WordEncoder(path)


def _pieces(path: str, end_id: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _encoder(path), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            for at, to in pairwise([0, *(np.flatnonzero(np.diff(sizes // PORTION)) + 1).tolist(), batch.num_rows]):
                part = batch.slice(at, to - at)
                texts = [t or "" for t in part.column("text").to_pylist()]
                rows: list[tuple] = []
                for doc, mix, ids in zip(part.column("doc_id").to_pylist(), part.column("mix").to_pylist(),
                                         encoder.encode(texts)):
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n, length):
                        piece = ids[4 * start:4 * (start + length)]
                        here = len(piece) // 4
                        # the closing id is read, but nothing is predicted from it
                        rows.append((doc, start, here, zlib.crc32(piece), n, here - (start + here == n), mix))
                cols = list(zip(*rows)) or [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                                 ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "loss", "mix"])
    return run


def place(demand: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and order of placing of each item, by the dot-product heuristic.

    ``demand`` has a row for each item and a column for each limited quantity, no value over its limit. Items of the same demand are
    one kind, so a step costs the number of kinds that fit. Ties go to the smaller kind number.
    """
    kinds, kind_of, left = np.unique(demand, axis=0, return_inverse=True, return_counts=True)
    kind_of = kind_of.reshape(-1)
    waiting = np.argsort(kind_of, kind="stable")
    at = np.concatenate([[0], np.cumsum(left)[:-1]])
    share = kinds / limits
    bins, order = np.empty(len(demand), np.int64), np.empty(len(demand), np.int64)
    room, used, placed = limits.astype(np.float64), 0, 0
    live = np.arange(len(kinds))
    first, *others = np.ascontiguousarray(kinds.T)
    empty = True
    while placed < len(demand):
        # kinds ascend by their first demand
        fits = live[:np.searchsorted(first[live], room[0], side="right")]
        for other, most in zip(others, room[1:]):
            fits = fits[other[fits] <= most]
        if not len(fits):
            room, used, empty = limits.astype(np.float64), used + 1, True
            live = live[left[live] > 0]
            continue
        # kinds are unlike in size: the product favours what uses the room that is left
        best = fits[np.argmax(share[fits] @ (room / limits))] if not empty else fits[np.argmax(share[fits].sum(axis=1))]
        empty = False
        item = waiting[at[best]]
        bins[item], order[item] = used, placed
        at[best] += 1
        left[best] -= 1
        placed += 1
        room = room - kinds[best]
        if not left[best]:
            live = live[live != best]
    return bins, order


def _pack_group(limits: tuple[int, int, int]):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        full = np.array(limits, np.int64)
        group = group.sort_values(["mix", "doc_id", "start", "ids_crc32"], kind="stable").reset_index(drop=True)
        length = group["length"].to_numpy(np.int64)
        demand = np.stack([length, np.ones_like(length), np.minimum(group["loss"].to_numpy(np.int64), full[2])], axis=1)
        bins, order = place(demand, full)
        by = np.lexsort([order, bins])
        before = np.cumsum(length[by]) - length[by]
        opens = np.flatnonzero(np.concatenate([[True], bins[by][1:] != bins[by][:-1]]))
        offset = np.empty(len(by), np.int64)
        offset[by] = before - np.repeat(before[opens], np.diff(np.append(opens, len(by))))
        return group.assign(bin=bins, offset=offset)[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "group",
                                                      "bin", "offset"]]
    return run


def pack(docs: DataFrame, tokenizer_path: str, *, end_id: int = 0, length: int = SEQUENCE,
         most_segments: int = MOST_SEGMENTS, most_loss: int | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences; a row for each piece.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A NULL or empty text is its closing id alone.
    Repeated rows are documents of their own; a NULL doc_id stays NULL. Other columns are ignored; an empty table
    gives no rows. ``most_loss`` is the limit on loss-bearing tokens, by default all tokens of a sequence.
    """
    limits = (length, most_segments, most_loss or length)
    if limits[2] > length or min(limits) < 1:
        raise ValueError(f"limits {limits}")
    step = min(length, limits[2])  # no piece may exceed a limit by itself
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = keyed.withColumn("mix", F.xxhash64("doc_id", *text_key(F.col("text"))))
    pieces = write_and_read(keyed.mapInArrow(_pieces(tokenizer_path, end_id, step), PIECES), "pieces")
    n_groups = chunks(pieces.filter(F.col("length") < length).count(), group_rows)
    groups = (pieces.filter(F.col("length") < length)
              .withColumn("group", F.pmod(F.xxhash64("mix", "start"), F.lit(n_groups))))
    packed = write_and_read(groups.groupBy("group").applyInPandas(_pack_group(limits), PLACED), "packed")
    # a group has fewer than 2^32 sequences; those of full pieces are numbered after all groups by the rows of the written table
    together = packed.withColumn("sequence_id", F.col("group") * F.lit(1 << 32) + F.col("bin"))
    alone = (pieces.filter(F.col("length") == length)
             .withColumn("sequence_id", F.lit(n_groups << 32) + F.monotonically_increasing_id())
             .withColumn("offset", F.lit(0).cast("long")))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return together.select(columns).unionByName(alone.select(columns))
