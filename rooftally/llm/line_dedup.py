"""Cross-site boilerplate lines, found by distinct-site spread and removed (operator 2).

Every different line has a HyperLogLog sketch of the sites it stands on. The sketches merge by aggregation; lines clearly
over or under the threshold are settled by the estimate, those near it get an exact distinct count. Lines on at least
``least_sites`` sites are boilerplate and are removed wherever they stand. The sites of all copies of a text count. A page mirrored everywhere
is spared by a condition of its own: a line that stands in one different text only is no boilerplate.

Scale: lines travel as two 64-bit hashes, one row per different line of a text. Sketches are built before the shuffle, so a line that
stands in a third of all documents costs one small sketch per task. Exact counts read only the lines near the threshold, pre-aggregated by
(line, site). Removed lines return as positions; texts are shuffled once, by a hash of the text, and large groups
of copies are split by the join's skew handling.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from rooftally.llm.common import BLANKS, text_key
from rooftally.workspace import write_and_read

LEAST_SITES = 10
#: Sketches of 2^LOG_K slots; the relative error is about 1.04 / sqrt(2^LOG_K), at small counts far less.
LOG_K = 10
#: Estimates within so many standard errors of the threshold are counted exactly.
ERRORS = 4.0


def line_rows(docs: DataFrame, site: str = "source") -> DataFrame:
    """(t1, t2, l1, l2, site, line_no): the different lines of each different text on each of its sites, where each first stands.

    Lines are compared without the white space around them; lines without anything else are left out. NULL sites count as a site
    named by the empty string.
    """
    t1, t2 = text_key(F.col("text"))
    lines = docs.filter("text is not null").select(
        t1.alias("t1"), t2.alias("t2"), F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"),
        F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    bare = lines.withColumn("line", F.btrim("line", F.lit(BLANKS))).filter("line <> ''")
    l1, l2 = text_key(F.col("line"))
    return bare.groupBy("t1", "t2", l1.alias("l1"), l2.alias("l2"), "site").agg(F.min("line_no").alias("line_no"))


def boilerplate(lines: DataFrame, least_sites: int = LEAST_SITES, log_k: int = LOG_K) -> DataFrame:
    """(l1, l2) of the lines on at least ``least_sites`` different sites, exactly, and in two different texts at least."""
    text = F.struct("t1", "t2")
    # a line with fewer rows than sites asked for needs no sketch
    wide = write_and_read(lines.groupBy("l1", "l2").agg(
        F.count(F.lit(1)).alias("rows"), F.min(text).alias("a"), F.max(text).alias("z"), F.hll_sketch_agg("site", F.lit(log_k)).alias("sketch"))
        .filter((F.col("rows") >= least_sites) & (F.col("a") != F.col("z")))
        .select("l1", "l2", F.hll_sketch_estimate("sketch").alias("sites")), "spread")
    band = ERRORS * 1.04 / 2 ** (log_k / 2)
    low, high = least_sites * (1 - band), least_sites * (1 + band)
    sure = wide.filter(F.col("sites") > high).select("l1", "l2")
    near = wide.filter(F.col("sites").between(low, high)).select("l1", "l2")
    exact = (lines.join(near, ["l1", "l2"], "left_semi").groupBy("l1", "l2", "site").agg(F.count(F.lit(1)).alias("n"))
             .groupBy("l1", "l2").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_sites).select("l1", "l2"))
    return sure.union(exact)


@pandas_udf(T.StructType().add("text", "string").add("n_lines", "long").add("n_removed", "long"))
def without_lines(texts: pd.Series, removed: pd.Series) -> pd.DataFrame:
    """Texts without the lines that equal those at the given positions, apart from white space around them."""
    rows = []
    for text, places in zip(texts, removed):
        lines = text.split("\n") if text is not None else []
        if places is None or not len(places):
            rows.append((text, len(lines), 0))
            continue
        gone = {lines[p].strip(BLANKS) for p in places}
        kept = [x for x in lines if x.strip(BLANKS) not in gone]
        rows.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return pd.DataFrame(rows, columns=["text", "n_lines", "n_removed"])


def _cleaned(docs: DataFrame, site: str, least_sites: int, log_k: int) -> DataFrame:
    """The rows of ``docs`` as a struct, and the struct of ``without_lines``."""
    lines = write_and_read(line_rows(docs, site), "lines")
    common = write_and_read(boilerplate(lines, least_sites, log_k), "boilerplate")
    places = lines.join(common, ["l1", "l2"], "left_semi").groupBy("t1", "t2").agg(F.collect_set("line_no").alias("places"))
    places = write_and_read(places, "places")  # read from a table, the join below can split a text of very many copies
    t1, t2 = text_key(F.col("text"))
    whole = docs.select(F.struct("*").alias("_row"), F.col("text").alias("_text"), t1.alias("t1"), t2.alias("t2"))
    return whole.join(places, ["t1", "t2"], "left").select("_row", without_lines("_text", "places").alias("_new"))


def line_dedup(docs: DataFrame, site: str = "source", least_sites: int = LEAST_SITES, log_k: int = LOG_K) -> DataFrame:
    """A row for each document: doc_id, n_lines, n_removed, text (what is left).

    A NULL text stays NULL and has no lines; an empty one has one empty line, which stays. Repeated rows stay. A text of which
    every line is boilerplate becomes empty.
    """
    out = _cleaned(docs.select("doc_id", "text", F.col(site).alias("site")), "site", least_sites, log_k)
    return out.select("_row.doc_id", "_new.n_lines", "_new.n_removed", "_new.text")


def strip_boilerplate(docs: DataFrame, site: str = "source", least_sites: int = LEAST_SITES, log_k: int = LOG_K) -> DataFrame:
    """The documents, same columns and rows, with boilerplate lines taken out of ``text`` (and n_chars made to agree)."""
    out = _cleaned(docs, site, least_sites, log_k)
    new = {"text": F.col("_new.text"), "n_chars": F.length("_new.text").cast("long")}
    return out.select(*[new.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns])
