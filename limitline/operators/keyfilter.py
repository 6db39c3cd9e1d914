"""A Bloom filter of keys as a small table, to drop rows before they are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of 64 bits: the most rows the filter ever has, so it may be broadcast.
WORDS = 1 << 18
_SHIFTS = (20, 26, 32, 38)


def _word(key: str, words: int) -> Column:
    # Never NULL, also in Spark's eyes: a filter that Spark derives from the key would be
    # pushed below the exchange of the keys, which then could not serve other readers.
    return F.expr(f"xxhash64(`{key}`) & {words - 1}L")


def _mask(key: str) -> Column:
    """Four bits of the word, of other digits of the hash."""
    bits = (f"shiftleft(1L, cast(shiftright(xxhash64(`{key}`), {s}) & 63 as int))" for s in _SHIFTS)
    return F.expr(" | ".join(bits))


def key_filter(keys: DataFrame, key: str, words: int = WORDS) -> DataFrame:
    """word and bits: the filter of all ``key`` values, in one map-side aggregate.

    It has ``words`` rows at most (a power of two), whatever the number of keys. More than some 16 keys a
    word let other keys pass; none of the keys is ever dropped.
    """
    return keys.groupBy(_word(key, words).alias("word")).agg(F.bit_or(_mask(key)).alias("bits"))


def possibly_in(rows: DataFrame, key: str, found: DataFrame, words: int = WORDS) -> DataFrame:
    """The rows whose key may be in the filter: all that are, and few others."""
    marked = rows.withColumns({"_word": _word(key, words), "_mask": _mask(key)})
    hit = (F.col("_word") == F.col("word")) & (F.col("_mask").bitwiseAND(F.col("bits")) == F.col("_mask"))
    return marked.join(F.broadcast(found), hit, "left_semi").drop("_word", "_mask")
