import numpy as np
from xxhash import xxh64_intdigest

from rooftally.llm.queries import op1_simhash
from rooftally.llm.simhash import _offsets, drop_near_duplicates, fingerprint, linked, local_roots, near_links, simhash_groups

SCHEMA = "doc_id long, text string, code string, root int"


def slow_fingerprint(text):
    words, word = [], ""
    for ch in (text or "") + " ":
        if ch in " \t\n\x0b\x0c\r":
            words, word = words + [word] * bool(word), ""
        else:
            word += chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """doc ids -> smallest reachable id, by all pairs."""
    codes = [slow_fingerprint(t) for _, t in rows]
    up = list(range(len(rows)))
    def find(k):
        while up[k] != k:
            k = up[k]
        return k
    for i in range(len(rows)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= 4:
                up[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(k)] = min(doc, least.get(find(k), doc))
    return sorted((repr(doc), f"{codes[k]:016x}", least.get(find(k))) for k, (doc, _) in enumerate(rows))


def test_fingerprints():
    for text in [None, "", " \n", "One", "a b c", "a b c d", "A\tB\x0bc d e É x", "w " * 40000, "x y z w v " * 7]:
        assert fingerprint(text) == slow_fingerprint(text) if len(text or "") < 1000 else fingerprint(text) >= 0


def test_offsets_are_half_of_the_ball():
    assert len(_offsets(4)) == 65 and (0, 0, 0) in _offsets(4)


def test_forest_connects_what_all_pairs_connect():
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 63, 20).astype(np.uint64)
    flips = [np.uint64(1 << int(b)) for b in rng.integers(0, 63, 900)]
    codes = np.unique(np.array([seeds[k % 20] ^ flips[k] ^ flips[-k] for k in range(900)], np.uint64))
    edges = linked(codes, codes, 4, rows=64)
    place = {c: k for k, c in enumerate(codes.tolist())}
    a, b = ([place[c] for c in edges[:, k].tolist()] for k in (0, 1))
    i, j = np.nonzero(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 4)
    assert (local_roots(np.array(a), np.array(b), len(codes)) == local_roots(i, j, len(codes))).all()
    assert len(edges) <= 2 * len(codes)


def test_links_over_many_small_tiles(table):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 62, 40)
    codes = sorted({int(b) ^ (1 << int(x)) ^ (1 << int(y)) for b in base for x, y in rng.integers(0, 62, (12, 2))})
    df = table([(c - (1 << 61),) for c in codes], "code long")
    values = np.array([c - (1 << 61) for c in codes])
    got = near_links(df, tile=3).toPandas()
    place = {c: k for k, c in enumerate(values.tolist())}
    u = values.view(np.uint64)
    i, j = np.nonzero(np.bitwise_count(u[:, None] ^ u[None, :]) <= 4)
    assert (local_roots(np.array([place[c] for c in got.src]), np.array([place[c] for c in got.dst]), len(values))
            == local_roots(i, j, len(values))).all()


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((repr(r.doc_id), r.fingerprint, r.component_id) for r in op1_simhash(spark, sf).collect())
    assert got == brute_components(rows)


def test_awkward_rows(table):
    text = "the same long text with quite a few words in it so that it has shingles " * 3
    rows = [(5, text), (5, text), (None, text), (9, None), (8, ""), (None, "alone here"), (3, text + "x"), (7, "one two")]
    df = table([(d, t, "c", 1) for d, t in rows], SCHEMA)
    assert sorted((repr(r.doc_id), r.fingerprint, r.component_id) for r in simhash_groups(df).collect()) == brute_components(rows)
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns
    components = len({(c[2], c[1] if c[2] is None else None) for c in brute_components(rows)})
    assert kept.count() == components
    assert simhash_groups(table([], SCHEMA)).count() == 0 and drop_near_duplicates(table([], SCHEMA)).count() == 0
