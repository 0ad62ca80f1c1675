"""What the text operators share: words, character classes, bounded Arrow batches."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Arrow batches sent to Python hold at most so many bytes, however long the texts are.
BATCH_BYTES = 32 << 20

SPACE, UPPER, LOWER, LETTER, DIGIT, SYMBOL, PUNCT = (1 << i for i in range(7))


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's limit on the bytes of an Arrow batch to :data:`BATCH_BYTES`."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def likely(rows: DataFrame, by: list[str], needed: DataFrame, at: list[str], bits: int = 24) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose columns ``by`` may be among the columns ``at`` of ``needed`` (all that are, and a few others), and the rest.

    A bitmap of fixed size (at most 2**bits bits, in rows of 64) is broadcast,
    so that a join of the first part leaves the others unshuffled.
    """
    word = lambda c: F.shiftright(F.pmod(F.xxhash64(*c), F.lit(1 << bits)), 6).cast("int")
    bit = lambda c: F.expr(f"shiftleft(1L, cast(pmod(xxhash64({', '.join(c)}), 64L) as int))")
    bitmap = needed.select(word(at).alias("_lk_word"), bit(at).alias("_lk_bit")).groupBy("_lk_word").agg(F.bit_or("_lk_bit").alias("_lk_bits"))
    seen = rows.withColumns({"_lk_w": word(by), "_lk_b": bit(by)}).join(F.broadcast(bitmap), F.col("_lk_w") == F.col("_lk_word"), "left")
    hit = F.coalesce(F.col("_lk_b").bitwiseAND(F.col("_lk_bits")) != 0, F.lit(False))
    return seen.where(hit).select(*rows.columns), seen.where(~hit).select(*rows.columns)


@functools.cache
def char_classes() -> np.ndarray:
    """Class bits of every code point."""
    out = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            out[i] = LETTER | (UPPER if c.isupper() else LOWER if c.islower() else 0)
        elif c.isdigit():
            out[i] = DIGIT
    for c in "\t\n\v\f\r ":
        out[ord(c)] |= SPACE
    for c in "#*$%&|<>":
        out[ord(c)] |= SYMBOL
    for c in ".,;:!?\"'()[]":
        out[ord(c)] |= PUNCT
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def fraction_of(count: int, bound: int) -> float:
    """Share of ``count`` rows to draw so that about ``bound`` are drawn; all if there are no more."""
    return 1.0 if count <= bound else bound / count


def drawn(share: Column, *of: Column, seed: int = 0) -> Column:
    """Whether a row falls in a seeded share of the rows, by a hash of ``of``."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *of), 11) / F.lit(float(1 << 53))) < share
