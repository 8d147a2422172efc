import math
from collections import Counter, defaultdict

import pytest

from rooftally.llm import mixing

SCHEMA = "doc_id long, source string, text string, _row int, k int"


def frame(table, spec):
    """spec: source -> list of numbers of words."""
    rows, n = [], 0
    for source, sizes in spec.items():
        for size in sizes:
            rows.append((n, source, " ".join(f"w{n}" for _ in range(size)), 0, 0))
            n += 1
    return table(rows, SCHEMA), rows


def totals(spark, tokens):
    return spark.createDataFrame([(f"s{k}", t, 1) for k, t in enumerate(tokens)], "source string, tokens long, n_units long")


@pytest.mark.parametrize("tokens,limit", [([100, 1000, 7], 2.0), ([5, 5], 2.0), ([1, 10 ** 9], 3.5), ([100, 150], 2.0)])
def test_exponent_for_repetitions(spark, tokens, limit):
    t = mixing.bisect_exponent(totals(spark, tokens), most_repeats=limit)
    ratio = max(tokens) / min(tokens)
    assert t == pytest.approx(max(0.0, 1 - math.log(limit) / math.log(ratio)) if ratio > 1 else 0.0, abs=1e-9)


def test_exponent_for_entropy(spark):
    tokens = [900, 90, 10]
    def entropy(t):
        p = [x ** t for x in tokens]
        return -sum(x / sum(p) * math.log(x / sum(p)) for x in p)
    t = mixing.bisect_exponent(totals(spark, tokens), target_entropy=0.8)
    assert entropy(t) == pytest.approx(0.8, abs=1e-6)
    assert mixing.bisect_exponent(totals(spark, tokens), target_entropy=5.0) == 0.0
    assert mixing.bisect_exponent(totals(spark, tokens), target_entropy=0.1) == 1.0
    assert mixing.bisect_exponent(totals(spark, []), target_entropy=0.1) in (0.0, 1.0)


def test_streams_are_whole_passes_and_a_rest(table):
    df, rows = frame(table, {"hot": [10] * 300, "b": [3, 5, 7] * 10, "c": [2] * 30, "zero": [0, 0]})
    out = mixing.mix(df, most_repeats=2.0, block_rows=16).collect()
    by = defaultdict(list)
    for r in out:
        by[r.source].append(r)
    plan = {r.source: r for r in mixing.budgets(mixing.source_totals(mixing.units(df)), mixing.bisect_exponent(
        mixing.source_totals(mixing.units(df)), most_repeats=2.0)).collect()}
    assert len(by["hot"]) == 300 and len(by["zero"]) == 2
    for source in ("hot", "b", "c"):
        total, placed = plan[source].tokens, sorted((r.start, r.n_tokens) for r in by[source])
        whole = [r for r in by[source] if r["pass"] == 0]
        assert Counter(r.doc_id for r in whole) == Counter(d for d, s, *_ in rows if s == source)
        assert all(a + n == b for (a, n), (b, _) in zip(sorted((r.start, r.n_tokens) for r in whole), sorted(
            (r.start, r.n_tokens) for r in whole)[1:]))
        assert placed[-1][0] + placed[-1][1] <= plan[source].quota <= 2.001 * total
        assert sum(n for _, n in placed) > plan[source].quota - 2 * 16 * 10
    orders = [[r.doc_id for r in sorted(by["c"], key=lambda r: r.start) if r["pass"] == p][:10] for p in (0, 1)]
    assert orders[0] != orders[1]


def test_budget_below_the_total(table):
    df, _ = frame(table, {"a": [10] * 100, "b": [10] * 10})
    out = mixing.mix(df, target_entropy=9.0, budget=400).groupBy("source").sum("n_tokens").collect()
    assert {r[0]: r[1] for r in out} == {"a": 200, "b": 200}


def test_documents_come_with_all_their_columns(table):
    df, rows = frame(table, {"a": [5] * 40, "b": [1] * 10})
    df = df.union(table([(0, "a", rows[0][2], 0, 0), (None, None, "x y", 1, 1), (None, "", "x y", 2, 2), (90, "a", None, 3, 3),
                         (91, "a", "", 4, 4), (90, "a", None, 3, 3)], SCHEMA))
    out = mixing.mix_documents(df, most_repeats=2.0)
    assert out.columns == df.columns
    times, want = Counter(tuple(r) for r in out.collect()), Counter(tuple(r) for r in df.collect())
    assert all(times[r] >= n for r, n in want.items()) and times.keys() == want.keys()
    placed = Counter((r.doc_id, r.source) for r in mixing.mix(df, most_repeats=2.0).collect())
    assert placed == Counter((r[0], r[1]) for r in times.elements())
    assert mixing.mix(df.limit(0), most_repeats=2.0).count() == 0 and mixing.mix_documents(df.limit(0), most_repeats=2.0).count() == 0
