import random
import re

from pyspark.sql import functions as F

from rooftally.llm.quality_rules import host_verdicts, quality_rules

SCHEMA = "doc_id long, text string, source string, host string, n_words string, failed int"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_counts_against_brute_force(table):
    rng = random.Random(1)
    texts = [None, "", " ", "\n\n", "a", "a b c d e", "a b c d e f a b c d e", "x " * 40, "é|ü\n\n é|ü\né|ü \té|ü\n", "#*$%&|<>", "l\nl\n l\nl",
             "a\x0bb\x0cc\rd", "a\u00a0b c"]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randrange(60))) for _ in range(60)]
    texts += ["\n".join(rng.choice(["one two", "three", "", "four five six"]) for _ in range(20)) for _ in range(20)]
    rows = [(i, t, f"h{i % 3}", "c", "c", 1) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in quality_rules(table(rows, SCHEMA)).collect()}
    for i, t in enumerate(texts):
        r, want = got[i], brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])


def test_rates_shrink_towards_all_hosts(spark):
    rows = [("big", k < 900) for k in range(1000)] + [(f"h{h}", k < 3) for h in range(20) for k in range(30)] + [("tiny", True), (None, False)]
    got = {r.host: r for r in host_verdicts(spark.createDataFrame(rows, "host string, base_failed boolean")).collect()}
    assert got["big"].host_failed and got["big"].shrunk_rate > 0.8
    assert got["tiny"].failed == 1 and got["tiny"].shrunk_rate < 1 and not got["h1"].host_failed
    alike = {r.host: r for r in host_verdicts(spark.range(2000).select(
        F.expr("string(id div 500)").alias("host"), (F.col("id") % 10 == 0).alias("base_failed"))).collect()}
    assert all(abs(r.shrunk_rate - 0.1) < 0.01 for r in alike.values())


def test_a_bad_host_takes_its_documents_along(table):
    good = "these words are all quite different from one another so nothing here repeats"
    rows = [(k, good if k % 10 else "bad", "fine", "", "", 0) for k in range(100)]
    rows += [(200 + k, "bad" if k % 10 else good, "foul", "", "", 0) for k in range(100)]
    rows += [(400, good, None, "", "", 0), (None, good, "fine", "", "", 0)]
    out = quality_rules(table(rows, SCHEMA)).collect()
    kept = {(r.host, r.base_failed): r.kept for r in out}
    assert kept == {("fine", False): True, ("fine", True): False, ("foul", False): False, ("foul", True): False, (None, False): True}
    assert len(out) == 202 and quality_rules(table([], SCHEMA)).count() == 0
