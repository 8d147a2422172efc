import hashlib

import numpy as np
import pytest

from rooftally.llm import suffix_dedup, suffix_sort
from rooftally.llm.suffix_dedup import LENGTH, anchors, remove_repeats
from rooftally.llm.suffix_sort import COVER, PERIOD, earliest_equal


def brute(rows):
    """doc_id -> (n_bytes, n_removed, n_spans, sha) by looking every string up in order."""
    out, seen = {}, set()
    for doc, text in sorted(set(rows)):
        data = text.encode()
        gone = bytearray(len(data))
        for i in range(len(data) - LENGTH + 1):
            if data[i:i + LENGTH] in seen:
                gone[i:i + LENGTH] = b"\1" * LENGTH
            seen.add(data[i:i + LENGTH])
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[doc] = (len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def result(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, len(r.starts), r.kept_sha256) for r in df.collect()}


def test_the_cover_meets_every_pair():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


@pytest.mark.parametrize("rounds", [0, 1, 6])
def test_bucket_sort_against_a_dictionary(rounds, monkeypatch):
    monkeypatch.setattr(suffix_sort, "ROUNDS", rounds)
    rng = np.random.default_rng(rounds)
    base = rng.integers(97, 99, 400).astype(np.uint8)
    parts = []
    for _ in range(30):
        a = int(rng.integers(0, 200))
        part = base[a:a + int(rng.integers(100, 170))].copy()
        if rng.random() < 0.5:
            part[int(rng.integers(0, len(part)))] = 122
        parts.append(part)
    data, at = np.concatenate(parts), np.cumsum([0] + [len(p) for p in parts])
    windows = np.concatenate([np.arange(a, a + len(p) - 99) for a, p in zip(at, parts)])
    order = rng.permutation(len(windows)).astype(np.int64)
    first = {}
    for w, o in zip(windows, order):
        key = data[w:w + 100].tobytes()
        first[key] = min(first.get(key, 1 << 60), o)
    got = earliest_equal(data, windows, order, 100)
    assert got.tolist() == [first[data[w:w + 100].tobytes()] for w in windows]


@pytest.mark.parametrize("at_once", [300, 1 << 21])
def test_equal_windows_have_equal_anchors(at_once, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "AT_ONCE", at_once)
    rng = np.random.default_rng(1)
    data = np.concatenate([rng.integers(97, 123, 700), np.full(400, 97), np.tile([97, 98, 99], 150)]).astype(np.uint8)
    data = np.concatenate([data, data[150:1400]])
    hashes, place, first, n = anchors(data)
    assert n.sum() == len(data) - LENGTH + 1 and (np.append(first, len(data) - LENGTH + 1)[1:] - first == n).all()
    chosen = {}
    for h, p, f, k in zip(hashes.tolist(), place.tolist(), first.tolist(), n.tolist()):
        for w in range(f, f + k):
            chosen.setdefault(data[w:w + LENGTH].tobytes(), set()).add((h, p - w))
    assert all(len(c) == 1 for c in chosen.values())


@pytest.mark.parametrize("hot", [2, 2000])
def test_against_brute_force(table, hot):
    rng = np.random.default_rng(hot)
    words = ["".join(rng.choice(list("abcdeé"), 5)) for _ in range(60)]
    def prose(n):
        return " ".join(rng.choice(words, n))
    shared, long_ = prose(40), prose(150)
    rows = []
    for i in range(60):
        body = prose(int(rng.integers(0, 60)))
        kind = i % 6
        text = (body, shared + body, body[:50] + long_[:int(rng.integers(100, 900))] + body, "x" * (i * 9), long_,
                body + " " + shared[30:200])[kind]
        rows.append((i * 3, text))
    rows += [(500, ""), (501, rows[1][1]), (501, rows[1][1]), (502, "é" * 90), (503, "short")]
    got = result(remove_repeats(table([(d, t, "z") for d, t in rows], "doc_id long, text string, first string"), hot=hot))
    assert got == brute(rows)


def test_nulls_repeated_ids_and_empty_tables(table):
    schema = "doc_id long, text string, starts int"
    text = "abcdefghij" * 30
    out = remove_repeats(table([(1, None, 1), (None, text, 2), (2, text, 3), (2, text, 3), (None, "tail", None)], schema), True)
    rows = sorted(((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, bytes(r.kept)) for r in out.collect()))
    kept = text.encode()[:10 + 99]  # the text repeats itself with a period of ten
    assert [r[:4] for r in rows] == [(False, 1, 0, 0), (False, 2, 300, 290), (False, 2, 300, 290), (True, 0, 4, 0), (True, 0, 300, 300)]
    assert rows[1][4] == kept[:10] and rows[3][4] == b"tail"
    assert remove_repeats(table([], schema)).count() == 0
