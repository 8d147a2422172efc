"""Temperature mixing of sources (operator 10), all in DataFrame functions.

The token shares of the sources are raised to an exponent between 0 (all alike) and 1 (as they are) and normalised. The exponent is
bisected: the largest that reaches a target entropy, or the smallest that keeps the repetitions of every source in a limit. The
weights are then realised as passes over each source's documents: each pass is a permutation of blocks and of the documents
in them, and the source's token budget ends the last pass.

Scale: shares are partial sums. The bisection looks at the table of sources only, five halvings per job. A source of any size is cut into
blocks of about ``block_rows`` documents by a content hash; offsets are sums within a block plus sums over the blocks
before it, so no window holds a source's documents, and only short rows are shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from rooftally.llm.common import WORD
from rooftally.workspace import write_and_read

MOST_REPEATS = 2.0
BLOCK_ROWS = 1000
HALVINGS, HALVINGS_A_JOB = 40, 5


def _key() -> Column:
    """A hash of id, source and text, in which NULL is like nothing else."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
                                    for c in ("doc_id", "source", "text")]))


def units(docs: DataFrame) -> DataFrame:
    """(source, doc_id, key, n_tokens, copies): rows alike in id, source and text are one unit placed together."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"),
                       _key().alias("key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_tokens"))
    return rows.groupBy("source", "doc_id", "key", "n_tokens").agg(F.count(F.lit(1)).alias("copies"))


def source_totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("n_units"))


def bisect_exponent(totals: DataFrame, *, target_entropy: float | None = None, most_repeats: float | None = None) -> float:
    """The exponent for (source, tokens) rows: the largest whose entropy is at least ``target_entropy`` (in nats), or the
    smallest at which no source is taken over ``most_repeats`` times as often as the least repeated one.

    If even mixing (0) doesn't reach the entropy it is the answer, as it is when it keeps the limit.
    """
    if (target_entropy is None) == (most_repeats is None):
        raise ValueError("give target_entropy or most_repeats")
    live = totals.filter("tokens > 0")
    ends = live.agg(F.max("tokens").alias("most"), F.min("tokens").alias("least")).head()
    most, least = ends["most"] or 1, ends["least"] or 1

    def too_even(exponents: list[float]) -> list[bool]:
        """Whether the repetitions are too many."""
        return [(most / least) ** (1 - t) > most_repeats for t in exponents]

    def even_enough(exponents: list[float]) -> list[bool]:
        """Whether the entropy is reached: ln Z - sum(x ln x) / Z for x = share ** t, one job for all exponents."""
        x = [F.pow(F.col("tokens") / most, F.lit(t)) for t in exponents]
        row = live.agg(*[F.sum(v).alias(f"z{i}") for i, v in enumerate(x)],
                       *[F.sum(v * F.log(v)).alias(f"w{i}") for i, v in enumerate(x)]).head()
        return [row["z0"] is not None and math.log(row[f"z{i}"]) - row[f"w{i}"] / row[f"z{i}"] >= target_entropy
                for i in range(len(x))]

    # both hold up to some exponent: the answer is the upper end of the last halving for repeats, the lower for entropy
    below = too_even if most_repeats is not None else even_enough
    at_ends = below([0.0, 1.0])
    if not at_ends[0]:
        return 0.0
    if at_ends[1]:
        return 1.0
    low, high = 0.0, 1.0
    steps = 2 ** HALVINGS_A_JOB
    for _ in range(HALVINGS // HALVINGS_A_JOB):
        held = below([low + (high - low) * k / steps for k in range(1, steps)])
        lo, hi = 0, steps
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if held[mid - 1] else (lo, mid)
        low, high = low + (high - low) * lo / steps, low + (high - low) * hi / steps
    return high if most_repeats is not None else low


def budgets(totals: DataFrame, exponent: float, budget: int | None = None) -> DataFrame:
    """Add repeats and quota (tokens to place) to the totals.

    Without ``budget`` it is the smallest one at which each source is taken whole at least once, so that no document is lost.
    """
    live = F.col("tokens") > 0
    relative = F.when(live, F.pow(F.col("tokens").cast("double"), F.lit(exponent - 1.0)))
    base = totals.agg(F.min(relative).alias("least"), F.sum(F.when(live, F.pow(F.col("tokens").cast("double"), F.lit(exponent)))).alias("z")).head()
    whole = relative / F.lit(base["least"] or 1.0) if budget is None else relative * F.lit(budget / (base["z"] or 1.0))
    return totals.withColumn("repeats", F.round(F.coalesce(whole, F.lit(0.0)), 6)).withColumn(
        "quota", F.floor(F.round(F.col("tokens") * F.col("repeats"), 3)).cast("long"))


def _order(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *parts))


def placements(rows: DataFrame, plan: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(source, doc_id, key, n_tokens, copies, pass, start): where each unit begins in its source's stream of tokens.

    A unit whose tokens would reach beyond the quota is left out of that last pass, and so are those that follow it only
    if they too reach beyond. Units without tokens are placed where they stand. NULL sources are a source.
    """
    plan = plan.select(F.col("source").alias("_s"), "tokens", "quota", F.greatest(
        F.lit(1), F.ceil(F.col("n_units") / block_rows)).cast("long").alias("blocks"))
    known = rows.join(plan, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    last = F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(0).cast("int")
    known = known.withColumn("block", F.pmod(F.conv(F.substring("key", 1, 12), 16, 10).cast("long"), F.col("blocks")))
    passes = known.withColumn("pass", F.explode(F.sequence(F.lit(0), last)))
    size = F.col("n_tokens") * F.col("copies")
    name = F.coalesce("source", F.lit(""))
    sums = passes.groupBy("source", "pass", "block").agg(F.sum(size).alias("block_tokens"))
    before = Window.partitionBy("source", "pass").orderBy(_order(F.col("pass"), name, F.col("block")), "block").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("_s"), F.col("pass").alias("_p"), F.col("block").alias("_b"),
                         F.coalesce(F.sum("block_tokens").over(before), F.lit(0)).alias("block_start"))
    within = Window.partitionBy("source", "pass", "block").orderBy(_order(F.col("pass"), F.col("key")), "key").rowsBetween(
        Window.unboundedPreceding, -1)
    inside = passes.withColumn("before", F.coalesce(F.sum(size).over(within), F.lit(0)))
    placed = inside.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("pass") == F.col("_p"))
                         & (F.col("block") == F.col("_b")))
    placed = placed.withColumn("start", F.col("pass") * F.col("tokens") + F.col("block_start") + F.col("before"))
    return placed.filter(F.col("start") + size <= F.col("quota")).select(
        "source", "doc_id", "key", "n_tokens", "copies", "pass", "start")


def mix(docs: DataFrame, *, target_entropy: float | None = None, most_repeats: float | None = None,
        budget: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A row for each placement of a document: source, doc_id, n_tokens, pass, start.

    Tokens are words between white space; a NULL or empty text has none. Repeated rows stand next to each other. A source
    without tokens is taken once. An empty table gives no rows.
    """
    rows, plan = _planned(docs, target_entropy, most_repeats, budget)
    placed = placements(rows, plan, block_rows)
    each = placed.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)))
    return each.select("source", "doc_id", "n_tokens", "pass", (F.col("start") + F.col("k") * F.col("n_tokens")).alias("start"))


def _planned(docs, target_entropy, most_repeats, budget) -> tuple[DataFrame, DataFrame]:
    rows = write_and_read(units(docs), "units")
    totals = write_and_read(source_totals(rows), "totals")
    exponent = bisect_exponent(totals, target_entropy=target_entropy, most_repeats=most_repeats)
    return rows, budgets(totals, exponent, budget)


def mix_documents(docs: DataFrame, *, target_entropy: float | None = None, most_repeats: float | None = None,
                  budget: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The documents themselves, with their columns, once for each placement."""
    rows, plan = _planned(docs, target_entropy, most_repeats, budget)
    times = placements(rows, plan, block_rows).groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("_times")).withColumnRenamed(
        "key", "_key")
    whole = docs.select(F.struct("*").alias("_row"), _key().alias("_key"))  # a struct: columns may have any names
    joined = whole.join(times, "_key").withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return joined.select("_row.*")
