"""Best-fit packing of tokenized documents into sequences, over all documents at once.

Pieces go longest first into the fullest sequence that holds them. Pieces of one length are
alike, so where they go follows from how many there are of each: those counts, no more than
the capacity, give runs of pieces that fill equal sequences in the same way. Each task
numbers its pieces of a length; with the numbers of the tasks before, a piece finds its run
and from that its sequence and place. No sequence is closed early and none is left out,
and no task holds more than a block of documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from limitline.llm.pieces import documents_ids
from limitline.llm.storage import stored
from limitline.llm.textblocks import blocks, flat

CAPACITY = 2048

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def bin_runs(counts: Sequence[int], capacity: int) -> np.ndarray:
    """Rows (length, first, bin, each, place) of best fit, for ``counts[length]`` pieces of each length.

    From the ``first``-th piece of that length on, ``each`` pieces go into each bin from
    ``bin`` on, from ``place`` on. Bins that are filled alike are kept together: a length
    splits off two groups more at most, and each time a group is taken up less than half of
    its room is left, so the rows are bounded by the capacity, whatever the counts.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    by_room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has r free
    opened = 0
    for size in range(capacity, 0, -1):
        first, left = 0, int(counts[size])
        while left:
            fitting = rooms >> size
            if fitting:
                room = size + (fitting & -fitting).bit_length() - 1
                target, alike = by_room[room].pop()
                if not by_room[room]:
                    rooms &= ~(1 << room)
            else:
                room, target, alike = capacity, opened, -(-left // (capacity // size))
                opened += alike
            each = room // size
            full = min(alike, left // each)
            rest = left - full * each if full < alike else 0
            runs.append((size, first, target, each, capacity - room))
            first, left = first + full * each + rest, left - full * each - rest
            last = int(rest > 0)
            groups = ((full, room - each * size), (last, room - rest * size), (alike - full - last, room))
            for number, free in groups:
                if number and free:
                    by_room[free].append((target, number))
                    rooms |= 1 << free
                target += number
    return np.asarray(runs, np.int64).reshape(-1, 5)


def _located(runs: np.ndarray, lengths: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place of the ``nth`` piece of each length."""
    size, first, target, each, place = runs.T
    order = np.lexsort((first, size))
    number = np.searchsorted(size[order], lengths)  # the first run of the length
    key = np.concatenate([first[order], [0]])
    # Runs of a length are few and in order: halve what is left of them.
    low, high = number, np.searchsorted(size[order], lengths, side="right")
    while (high - low > 1).any():
        middle = (low + high) // 2
        before = key[middle] <= nth
        low, high = np.where(before, middle, low), np.where(before, high, np.maximum(middle, low + 1))
    run = order[low]
    ahead = nth - first[run]
    return target[run] + ahead // each[run], place[run] + ahead % each[run] * lengths


def _numbered(lengths: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The number of each piece among those of its length; ``before`` is counted on."""
    order = np.argsort(lengths, kind="stable")
    run = lengths[order]
    starts = np.flatnonzero(np.diff(run, prepend=-1))
    counts = np.diff(np.append(starts, len(run)))
    nth = np.empty(len(lengths), np.int64)
    nth[order] = np.arange(len(run)) - np.repeat(starts, counts) + before[run]
    before[run[starts]] += counts
    return nth


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and place of each item, longest first into the fullest bin that holds it; the bins' fills."""
    counts = np.zeros(capacity + 1, np.int64)
    nth = _numbered(lengths, counts)
    bins, places = _located(bin_runs(counts, capacity), lengths, nth)
    return bins, places, np.bincount(bins, lengths).astype(np.int64)


def _pieces(path: str, split: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        before = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for block in blocks(batch, "text"):
                data, offsets = flat(block.column("text"))
                ids, bounds = documents_ids(data, offsets, path, split, end_id)
                raw = memoryview(ids.astype("<u4")).cast("B")
                sizes = np.diff(bounds)
                n_pieces = -(-sizes // capacity)
                owner = np.repeat(np.arange(len(sizes)), n_pieces)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
                start = piece * capacity
                length = np.minimum(capacity, sizes[owner] - start)
                at = bounds[owner] + start
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist())]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": block.column("doc_id").take(pa.array(owner)),
                        "piece": piece.astype(np.int32),
                        "start": start,
                        "length": length,
                        "ids_crc32": np.asarray(sums, np.int64),
                        "part": np.full(len(owner), part, np.int32),
                        "nth": _numbered(length, before),
                    }
                )

    return run


def _placed(runs: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, nth, ahead = (batch.column(c).to_numpy() for c in ("length", "nth", "ahead"))
            sequence, offset = _located(runs, length, nth + ahead)
            kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
            columns = [*map(batch.column, kept), pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "sequence_id", "offset"])

    return run


def pack_documents(
    docs: DataFrame, tokenizer: str, split: str = "words", end_id: int = 0, capacity: int = CAPACITY
) -> DataFrame:
    """Where each piece of each document lies in the packed sequences.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    Documents of more than ``capacity`` ids are cut into pieces of that many. Null or empty
    text gives one piece of ``end_id`` alone; repeated rows are packed each; doc_id may be
    null; an empty table gives no rows; other columns are not read. Ties in length go by
    the order of the rows. ``split`` says how the tokenizer treats white space
    (``pieces.SPLITS``).
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # Stored, as another reading could number the pieces otherwise.
    pieces = stored(rows.mapInArrow(_pieces(tokenizer, split, end_id, capacity), _PIECE), "pieces")
    # At most one row per task and length; the counts of all tasks are at most ``capacity`` rows.
    of_tasks = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for row in of_tasks.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[row["length"]] = row["n"]
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = of_tasks.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"))
    numbered = pieces.join(ahead, ["part", "length"])
    return numbered.mapInArrow(_placed(bin_runs(counts, capacity)), _PACKED)
