"""What several of the operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: ASCII white space, x20 and x09 to x0D, as characters and as a regular expression.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only, whatever the locale."""
    return F.translate(text, UPPER, LOWER)


def text_key(text: Column) -> list[Column]:
    """Two independent 64-bit hashes that together stand for a text (NULL has a key of its own)."""
    return [F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def chunks(total: int, size: int, least: int = 1) -> int:
    """How many parts of about ``size`` hold ``total``."""
    return max(least, -(-total // size))


def distinct_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Of texts cut at each space: how many words each has, the number of each word of all texts in turn, and the distinct words by number."""
    cut = pc.split_pattern(pa.array([t.encode("utf-8", "surrogatepass") for t in texts], pa.binary()), b" ")
    words = cut.flatten().dictionary_encode()
    # the words come back as one string, as no word has a space in it
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words.dictionary)], pa.int32()), words.dictionary), b" ")[0].as_py()
    distinct = joined.decode("utf-8", "surrogatepass").split(" ") if len(words.dictionary) else []
    return np.diff(cut.offsets.to_numpy()), words.indices.to_numpy(), distinct
