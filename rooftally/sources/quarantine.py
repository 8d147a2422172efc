"""Setting bad geometries aside in one pass, in place of ending the job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, functions as F

from rooftally.functions.plan import compute_once
from rooftally.functions.wkb import wkb_problem, wkb_to_multipolygon
from rooftally.workspace import fresh_path

# What can be wrong with a ring.
OPEN_RING, SHORT_RING, NO_NUMBER = "ring is not closed", "ring has fewer than four points", "coordinate is not a number"


@dataclass(frozen=True)
class Sorted:
    """Readable rows, rows that were set aside with their ``problem``, and the counts of both."""

    sound: DataFrame
    bad: DataFrame
    n_sound: int
    n_bad: int


def ring_problem(mp: str) -> Column:
    """What is wrong with the rings of a MultiPolygon, NULL if nothing: the first of the rules that any ring breaks."""
    rings = F.flatten(mp)
    short = F.exists(rings, lambda r: F.size(r) < 4)
    open_ = F.exists(rings, lambda r: ~F.get(r, F.lit(0)).eqNullSafe(F.try_element_at(r, F.lit(-1))))
    odd = F.exists(F.flatten(rings), lambda p: F.exists(p, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    return F.when(short, SHORT_RING).when(open_, OPEN_RING).when(odd, NO_NUMBER)


def set_aside(df: DataFrame, geometry: str = "geometry", path: str | None = None) -> Sorted:
    """Check every geometry (WKB or nested arrays) once and write both kinds of rows in the same pass, to ``path`` or a place of its own.

    Reading either kind back skips the files of the other. A NULL geometry is sound. The counts come from the pass itself.
    """
    binary = dict(df.dtypes)[geometry] == "binary"
    torn = wkb_problem(F.col(geometry)) if binary else F.lit(None).cast("string")
    # only readable bytes are decoded
    first = compute_once(df, _torn=torn)
    shaped = first.withColumn("_mp", wkb_to_multipolygon(F.when(F.col("_torn").isNull(), F.col(geometry))) if binary else F.col(geometry))
    checked = compute_once(shaped, problem=F.coalesce(F.col("_torn"), ring_problem("_mp"))).drop("_torn", "_mp")
    seen = Observation()
    observed = checked.observe(seen, F.count_if(F.col("problem").isNull()).alias("sound"), F.count("problem").alias("bad"))
    path = path or fresh_path(df.sparkSession, "sorted")
    observed.withColumn("_bad", F.col("problem").isNotNull()).write.mode("overwrite").partitionBy("_bad").parquet(path)
    schema = df.schema.add("problem", "string").add("_bad", "boolean")
    both = df.sparkSession.read.schema(schema).parquet(path)
    return Sorted(both.where("NOT _bad").drop("_bad", "problem"), both.where("_bad").drop("_bad"), seen.get["sound"], seen.get["bad"])
