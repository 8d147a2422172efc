import random
from collections import Counter

import numpy as np

from rooftally.llm.near_copies import candidate_blocks, drop_near_copies

SCHEMA = "doc_id long, text string, name string, root int"


def shingles(text):
    words = (text or "").split()
    return {" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """One row of each group of all pairs with a similarity of 0.8 or more."""
    sets = [shingles(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if 5 * shared >= 4 * (len(sets[i]) + len(sets[j]) - shared) and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return [r for k, r in enumerate(rows) if group[k] == k]


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10 ** 6)}"
    return " ".join(words)


def some_rows():
    rng = random.Random(5)
    texts = []
    for length in (8, 13, 30, 120, 900):
        for _ in range(12):
            words = [f"w{rng.randrange(3000)}" for _ in range(length)]
            texts.append(" ".join(words))
            texts += [edited(rng, words, edits) for edits in (1, 1 + length // 60, 1 + length // 40, 1 + length // 25)]
            texts += [" ".join(words[:-1]), " ".join(words[length // 10:]), " ".join(words + words)]
    chain = [f"c{k}" for k in range(100)]
    texts += [" ".join(chain[k:k + 60]) for k in range(0, 40, 3)]  # neighbours alike, ends not
    texts += [None, "", " ", "one", "one two", "one", texts[0]]
    rng.shuffle(texts)
    return [(k, t, "n", 0) for k, t in enumerate(texts)]


def test_against_brute_force_jaccard(table):
    rows = some_rows()
    want = brute(rows)
    for sizes in ({}, {"tile": 40, "shingles": 300}):
        assert Counter(map(tuple, drop_near_copies(table(rows, SCHEMA), **sizes).collect())) == Counter(want)
    assert 50 < len(want) < len(rows) - 50
    assert drop_near_copies(table([], SCHEMA)).count() == 0


def test_stage_of_the_pipeline(spark, table):
    import corpus_pipeline

    rows = some_rows()
    got = corpus_pipeline.dedup_documents(spark, table(rows, SCHEMA), "")
    assert Counter(map(tuple, got.collect())) == Counter(brute(rows))


def test_copies_repeated_rows_and_null_ids(table):
    text = " ".join(f"w{k}" for k in range(50))
    rows = [(3, text, "a", 0), (2, text + " more", "b", 1), (None, text, "c", 2), (2, text + " more", "b", 1), (None, "alone", "d", 3), (9, "other", None, None)]
    assert Counter(map(tuple, drop_near_copies(table(rows, SCHEMA)).collect())) == Counter([rows[1], rows[4], rows[5]])


def test_candidates_within_the_radius_and_populations():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2 ** 63, (700, 4), np.uint64)
    x[300:310] = 0
    y = np.concatenate([x[::2] ^ (np.uint64(1) << rng.integers(0, 63, (350, 4), np.uint64)), x[1:5] & x[5:9]])
    apart = np.bitwise_count(x[:, None] ^ y[None]).sum(axis=2)
    for radius in (0, 4, 80, 120):
        found = {(int(a), int(b)) for i, j in candidate_blocks(x, y, radius) for a, b in zip(i, j)}
        assert found == set(zip(*map(lambda v: v.tolist(), np.nonzero(apart <= radius))))


def test_a_group_of_unlike_ends_lists_no_pairs(table):
    """Many texts within the radius of which few reach the similarity: every link counts, none is taken on trust."""
    rng = random.Random(9)
    base = [f"b{k}" for k in range(200)]
    texts = []
    for _ in range(60):
        at, size = rng.randrange(170), rng.randrange(12, 30)
        texts.append(" ".join(base[:at] + [f"n{rng.randrange(10 ** 6)}" for _ in range(size)] + base[at + size:]))
    rows = [(k, t, "n", 0) for k, t in enumerate(texts)]
    for shingles in (1 << 19, 2000):
        assert Counter(map(tuple, drop_near_copies(table(rows, SCHEMA), shingles=shingles).collect())) == Counter(brute(rows))
