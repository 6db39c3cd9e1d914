"""Exact duplicates by recipes of content-defined chunks.

A rolling hash over the last bytes cuts each text where the content says so, so equal texts
have equal chunks. Chunks are moved once, combined map-side, to verify that a chunk's
64-bit hash stands for one byte sequence; then the hash is the chunk's identifier. Where
two chunks share a hash, the identifier also has the chunk's rank among them. Texts are
compared by their recipes: the ordered identifiers, about eight bytes for 2 KB of text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limitline.llm.textblocks import blocks, flat, mixed, span_hashes

#: A cut where the lowest bits of the rolling hash of the last 32 bytes are zero.
WINDOW_DOUBLINGS = 5
CUT_BITS = 11
#: Chunks are no shorter (but a text's last) and no longer than this.
SHORTEST, LONGEST = 256, 16_384

_CHUNK = "doc_id long, pos int, h long, chunk binary"
_RECIPE = "doc_id long, ids array<long>, n_bytes long, text_sha256 string"


def cut_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each chunk; first chunk of each text. An empty text has none."""
    gear = mixed(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)
    rolling = gear[data]
    for i in range(WINDOW_DOUBLINGS):  # h[i] = sum of gear[byte i-j] << j, over the window
        back = 1 << i
        longer = rolling.copy()
        longer[back:] += rolling[:-back] << np.uint32(back)
        rolling = longer
    wanted = np.flatnonzero(rolling >> np.uint32(32 - CUT_BITS) == 0) + 1
    starts: list[int] = []
    bounds = np.searchsorted(wanted, offsets).tolist()
    wanted_list = wanted.tolist()
    firsts = [0]
    for (a, b), (i, j) in zip(
        zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True), zip(bounds, bounds[1:]), strict=True
    ):
        if a < b:
            starts.append(a)
            last = a
            # A window that reaches into the text before depends on it: no cut there.
            for cut in wanted_list[i:j] + [b]:
                while cut - last > LONGEST:
                    last += LONGEST
                    starts.append(last)
                if cut - last >= SHORTEST and cut < b:
                    last = cut
                    starts.append(cut)
        firsts.append(len(starts))
    s = np.asarray(starts, np.int64)
    ends = np.empty_like(s)
    f = np.asarray(firsts)
    if len(s):
        ends[:-1] = s[1:]
        ends[-1] = len(data)
    return s, ends, f


def _chunked(block: pa.RecordBatch, bits: int):
    data, offsets = flat(block.column("text"))
    starts, ends, firsts = cut_points(data, offsets)
    hashes = span_hashes(data, starts, ends) >> np.uint64(64 - bits)
    return data, offsets, starts, ends, firsts, hashes.view(np.int64)


def _chunks(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text"):
                data, _, starts, _, firsts, hashes = _chunked(block, bits)
                counts = np.diff(firsts)
                bounds = np.append(starts, len(data)).astype(np.int64)
                owner = np.repeat(np.arange(len(counts)), counts)
                cells = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data.tobytes())]
                )
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": block.column("doc_id").take(pa.array(owner)),
                        "pos": (np.arange(len(owner)) - firsts[owner]).astype(np.int32),
                        "h": hashes,
                        "chunk": cells.cast(pa.binary()),
                    }
                )

    return run


def _recipes(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text"):
                _, offsets, _, _, firsts, hashes = _chunked(block, bits)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": block.column("doc_id"),
                        "ids": pa.ListArray.from_arrays(firsts.astype(np.int32), hashes),
                        "n_bytes": np.diff(offsets),
                        "text_sha256": block.column("text_sha256"),
                    }
                )

    return run


def _clash_ranks(chunks: DataFrame, shared: DataFrame) -> DataFrame:
    """For documents with chunks whose hash several chunks share: the ranks that tell them apart."""
    mine = chunks.join(shared, "h", "left_semi")
    names = mine.select("h", "chunk").distinct()
    ranked = names.withColumn("rank", F.row_number().over(Window.partitionBy("h").orderBy("chunk")))
    ordered = F.sort_array(F.collect_list(F.struct("pos", "rank")))
    return (
        mine.join(ranked, ["h", "chunk"])
        .groupBy("doc_id")
        .agg(ordered.alias("ranks"))
        .select(F.col("doc_id").alias("clash_id"), F.col("ranks.rank").alias("ranks"))
    )


def exact_groups(docs: DataFrame, text: Column | None = None, hash_bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if their bytes are; null counts as empty, so null and empty texts are
    one group. Of each group the row with the largest doc_id stays; a null doc_id stays
    only where the whole group has none; rows that repeat a doc_id with the same text are
    marked alike. An empty table gives no rows; other columns are not read. ``text``
    normalises the texts first (not done by default).
    """
    text = F.col("text") if text is None else text
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))
    chunks = rows.mapInArrow(_chunks(hash_bits), _CHUNK)
    dictionary = chunks.groupBy("h").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high"))
    shared = dictionary.where("low <> high").select("h")
    recipes = rows.withColumn("text_sha256", F.sha2("text", 256)).mapInArrow(_recipes(hash_bits), _RECIPE)
    if shared.count():
        ranks = _clash_ranks(chunks, shared)
        recipes = recipes.join(ranks, F.col("doc_id").eqNullSafe(F.col("clash_id")), "left")
        told_apart = F.coalesce("ranks", F.array().cast("array<int>"))
    else:  # every hash is verified to stand for one chunk
        told_apart = F.array().cast("array<int>")
    recipes = recipes.select(
        "doc_id", F.struct("ids", told_apart.alias("ranks")).alias("recipe"), "n_bytes", "text_sha256"
    )
    # The length follows from the recipe; with it the grouping has another key than the
    # join, so both sides are exchanged for the join and Spark can split a group that
    # holds a large part of all rows.
    groups = (
        recipes.groupBy("recipe", "n_bytes")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .drop("n_bytes")
    )
    return recipes.join(groups, "recipe").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )
