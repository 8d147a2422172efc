import hashlib
import zlib

import duckdb
import pytest
from hypothesis import given, strategies as st

from rooftally.llm import merkle as M
from rooftally.llm.oracles import OP13

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, no long, digest int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, more=0):
    return h(*map(field, (r[0], r[1], r[2], None if r[3] is None else r[3] + more, r[4])))


def levels(row):
    out = [row]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k:k + 2]) for k in range(0, len(out[-1]), 2)])
    return out


def climb(tree, k, digest):
    others = []
    for row in tree[:-1]:
        run = row[k // 2 * 2:k // 2 * 2 + 2]
        others += [v for j, v in enumerate(run) if j != k % 2]
        run[k % 2], k = digest, k // 2
        digest = h(*run)
    return others, digest


def brute(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))):
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda v: (v is not None, (v or "").encode()))
    trees = {v: levels([leaf(r) for r in groups[v]]) for v in order}
    top = levels([trees[v][-1][0] for v in order])
    out = []
    for n, v in enumerate(order):
        for k, r in enumerate(groups[v]):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            low, at = climb(trees[v], k, leaf(r, 1 if bad else 0))
            high, at = climb(top, n, at)
            out.append((r[0], leaf(r), trees[v][-1][0], top[-1][0], h(*low, *high), at, at == top[-1][0]))
    return sorted(out, key=repr)


def found(docs):
    return sorted((tuple(r) for r in M.proofs(M.build_manifest(docs, M.tampered_digest(docs))).collect()), key=repr)


def test_query_matches_brute_force(spark):
    from rooftally.llm.queries import op13_merkle

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    ours = sorted((tuple(r) for r in op13_merkle(spark, sf).collect()), key=repr)
    assert ours == brute(rows) and not all(r[-1] for r in ours)


def awkward():
    rows = [(k, "s", "en", k * 3, f"text {k}") for k in range(21)] + [(7, "s", "en", 1, "again")] * 3
    rows += [(None, None, None, None, None), (3, None, None, 2 ** 63 - 1, ""), (-5, "ü", "", 5, "ß" * 5000), (2 ** 62, "a:b", "de", None, "-"),
             (14, "", "en-", None, "1:a"), (21, "s", "EN", 0, "x\n\ty")]
    return rows


def test_nulls_ties_repeated_rows_long_texts_and_clashing_columns(spark):
    rows = awkward()
    docs = spark.createDataFrame([(*r, "t", 9, 1) for r in rows], SCHEMA).repartition(4)
    ours = found(docs)
    assert ours == brute(rows) and len(ours) == len(rows)


def test_sql_gives_the_same(spark):
    rows = [r for r in awkward() if r[3] != 2 ** 63 - 1]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, lang VARCHAR, n_chars BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    assert sorted(map(tuple, con.execute(OP13).fetchall()), key=repr) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_rows(spark, n):
    rows = [(k, "s", "en", k, "t") for k in range(n)]
    docs = spark.createDataFrame([(*r, "", 0, 0) for r in rows], SCHEMA)
    assert found(docs) == brute(rows)


def test_several_stages_of_builders(spark):
    """A tree of more than one builder, and many small trees with repeated ids."""

    rows = [(k // 3, "s", "en" if k % 4 else f"l{k % 11}", k // 3, "t") for k in range(150)]
    docs = spark.createDataFrame([(*r, "", 0, 0) for r in rows], SCHEMA).repartition(5)
    assert found(docs) == brute(rows)
    big = [(k, "s", "en", 1, "t") for k in range(3 * M.RUN + 5)]
    assert found(spark.createDataFrame([(*r, "", 0, 0) for r in big], SCHEMA)) == brute(big)


@given(st.integers(1, 70))
def test_places_in_the_log_follow_from_subtree_sizes(n):
    leaves = [bytes([k]) * 32 for k in range(n)]
    log = M.append_log(leaves, M.height(n))
    tree = levels([v.hex() for v in leaves])
    assert len(log) == sum(map(len, tree)) and log[-1].hex() == tree[-1][0]
    for level, row in enumerate(tree):
        for k, digest in enumerate(row):
            assert log[M.position(level, k, n)].hex() == digest
    for k in range(n):
        path = M.path_of(log, k, n, M.height(n))
        assert M.fold(leaves[k], path) == log[-1]
        assert M.siblings(path) == "".join(climb(tree, k, leaves[k].hex())[0])
