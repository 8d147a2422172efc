"""Rule failures per document and per host (operator 3), all in DataFrame functions.

Documents are measured in place: words, symbols, repeated lines, and words in five-word windows that occur twice or more
in the same text. The failures of the basic rules are added up by host; each host's rate is shrunk towards all hosts' rate with a beta
prior fitted by moments; hosts over the limit take all their documents with them.

Scale: measuring is a narrow map, linear in the text up to one sort of a text's repeated windows. Only short rows about documents
leave it, written once and used twice. Host counts are partial sums before the shuffle, so a host with a third of all rows
costs one row per task; the verdicts are joined back by an equality that adaptive execution may broadcast or split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rooftally.functions.plan import compute_once
from rooftally.llm.common import BLANK_RUN, BLANKS
from rooftally.workspace import write_and_read

SYMBOLS = "#*$%&|<>"
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
HOST_LIMIT = 0.5


def text_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words; a NULL text counts as empty.

    Windows are compared by 64-bit hashes within one text. The text column is dropped.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    split = compute_once(
        docs.withColumn("_t", body),
        _words=F.filter(F.split(F.btrim("_t", F.lit(BLANKS)), BLANK_RUN), lambda w: w != ""),
        word_chars=F.length(F.translate("_t", BLANKS, "")).cast("long"),
        n_symbols=(F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long"),
        # a line has a word when trimming leaves something
        _lines=F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")).drop("_t", text)
    hashed = compute_once(split, n_words=F.size("_words").cast("long"), _h=F.transform("_words", lambda w: F.xxhash64(w)),
                          n_dup_lines=(F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    windows = compute_once(hashed.drop("_words", "_lines"), _g=F.expr(
        f"if(n_words < {WINDOW}, cast(array() as array<bigint>), transform(sequence(0, cast(n_words as int) - {WINDOW}), i -> "
        f"xxhash64({', '.join(f'get(_h, i + {k})' for k in range(WINDOW))})))"))
    pairs = compute_once(windows.drop("_h"), _s=F.expr(
        "if(size(array_distinct(_g)) = size(_g), cast(array() as array<struct<h: bigint, i: int>>), "
        "sort_array(transform(_g, (h, i) -> struct(h as h, i as i))))"))
    places = compute_once(pairs.drop("_g"), _p=F.expr(
        "array_sort(transform(filter(_s, (x, k) -> coalesce(x.h = get(_s, k - 1).h, false) or "
        "coalesce(x.h = get(_s, k + 1).h, false)), x -> x.i))"))
    return places.drop("_s").withColumn("n_repeat_words", F.expr(
        f"aggregate(transform(_p, (p, k) -> coalesce(least({WINDOW}, get(_p, k + 1) - p), {WINDOW})), 0L, (a, x) -> a + x)")
    ).drop("_p")


def base_failed() -> Column:
    """The basic rules: too few words, or too large a part of them in repeated windows."""
    return ((F.col("n_words") < LEAST_WORDS)
            | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")))


def host_verdicts(digests: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """host, n, failed, shrunk_rate, host_failed from rows (host, base_failed).

    The prior's mean is the overall rate m; its strength k comes from the variance of the hosts' rates beyond what chance gives,
    k = m (1 - m) / between - 1, at least 1. Without such variance a host's own rate counts for nothing: k = 1e9.
    NULL hosts are one host. An empty table gives no rows.
    """
    hosts = write_and_read(digests.groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed")), "hosts")
    m = hosts.agg(F.sum("failed") / F.sum("n")).head()[0] or 0.0
    spread = hosts.agg(F.avg((F.col("failed") / F.col("n") - m) ** 2).alias("seen"), F.avg(F.lit(m * (1 - m)) / F.col("n")).alias("chance")).head()
    between = (spread["seen"] or 0.0) - (spread["chance"] or 0.0)
    k = max(1.0, m * (1 - m) / between - 1) if between > 1e-12 else 1e9
    rate = (F.col("failed") + F.lit(k * m)) / (F.col("n") + F.lit(k))
    return (hosts.withColumn("shrunk_rate", rate)
            .select("host", "n", "failed", "shrunk_rate", (F.col("shrunk_rate") > limit).alias("host_failed")))


def quality_rules(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """A row for each document: doc_id, host, the counts, base_failed, host_failed, kept.

    NULL and empty texts fail (no words). Repeated rows are judged and counted each. A NULL host is a host of its own.
    """
    chosen = docs.select(F.col("doc_id"), F.col(host).alias("host"), F.col("text"))
    digests = write_and_read(text_counts(chosen).withColumn("base_failed", base_failed()), "quality")
    verdicts = host_verdicts(digests, limit).select(F.col("host").alias("_host"), "host_failed")
    joined = digests.join(verdicts, F.col("host").eqNullSafe(F.col("_host")), "left").drop("_host")
    return joined.withColumn("host_failed", F.coalesce("host_failed", F.lit(False))).withColumn(
        "kept", ~F.col("base_failed") & ~F.col("host_failed"))
