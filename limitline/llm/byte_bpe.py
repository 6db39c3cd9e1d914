"""Byte-level BPE: boundaries by a scan over transition functions, pairs merged per slice.

The pre-tokenizer's pattern is written as a small automaton. Each code point has a class
(letter, number, other, and white space or an apostrophe by what follows), and each class
is a function from the state before to the state after. Functions compose associatively,
so the states at all positions come from a blocked prefix scan over whole arrays, and the
boundaries from the states: no regular expression and no loop over characters.
"""

from __future__ import annotations

import base64
import functools
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limitline.llm.pieces import PieceEncoder
from limitline.llm.textblocks import blocks, flat, ragged

# Classes of a code point. Of a run of white space before something else, the last
# character stands apart: a space goes with what follows, any other is a slice of its own.
LETTER, NUMBER, OTHER, SPACE, JOINING, LAST, SHORT, LONG = range(8)
#: Added to the class of a text's first code point: whatever came before does not matter.
FIRST = 8
#: Padding that changes no state.
STAY = 16

# States: what the slice so far is. FRESH: the next code point begins a slice.
FRESH, LETTERS, NUMBERS, OTHERS, SPACES, JOINED, ONE_MORE, TWO_MORE = range(8)

#: Code points with the White_Space property, as ranges.
WHITE_SPACE = (
    (0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
    (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
)
#: What an apostrophe may be split off with, by length.
ENDINGS_1 = "stmd"
ENDINGS_2 = ("re", "ve", "ll")

_BLOCK = 512

#: Bytes of text worked on at once: the scan takes some forty times as much.
_TEXT_BYTES = 1 << 20


@functools.cache
def _kinds() -> np.ndarray:
    """Class of each code point, by itself."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    for i in range(0x110000):
        major = unicodedata.category(chr(i))[0]
        if major == "L":
            kinds[i] = LETTER
        elif major == "N":
            kinds[i] = NUMBER
    for a, b in WHITE_SPACE:
        kinds[a : b + 1] = SPACE
    return kinds


@functools.cache
def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """State after, and whether a slice begins, by class and state before."""
    after = np.zeros((STAY + 1, 8), np.uint8)
    begins = np.zeros((STAY + 1, 8), bool)
    run_of = {LETTER: LETTERS, NUMBER: NUMBERS, OTHER: OTHERS, SHORT: OTHERS, LONG: OTHERS, SPACE: SPACES}
    alone = {JOINING: JOINED, LAST: FRESH, SHORT: ONE_MORE, LONG: TWO_MORE}
    for kind in range(FIRST):
        for state in range(8):
            run = run_of.get(kind)
            if state == TWO_MORE:
                after[kind, state] = ONE_MORE
            elif state == ONE_MORE:
                after[kind, state] = FRESH
            elif run is not None and (state == run or state == JOINED and kind != SPACE):
                after[kind, state] = run
            else:
                begins[kind, state] = True
                after[kind, state] = alone.get(kind, run)
        after[FIRST + kind] = after[kind, FRESH]
        begins[FIRST + kind] = True
    after[STAY] = np.arange(8)
    return after, begins


def classes(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Class of each code point of several texts; ``firsts`` marks where a text begins."""
    kinds = _kinds()[points]
    end = np.ones(len(points), bool)  # the next code point is of another text
    end[:-1] = firsts[1:]
    space = kinds == SPACE
    before_solid = np.zeros(len(points), bool)
    before_solid[:-1] = ~space[1:] & ~end[:-1]
    split = space & before_solid
    kinds[split] = np.where(points[split] == 0x20, JOINING, LAST)
    at = np.flatnonzero(points == 0x27)
    at = at[~end[at]]
    one = points[at + 1]
    kinds[at[np.isin(one, [ord(c) for c in ENDINGS_1])]] = SHORT
    at = at[~end[at + 1]]
    one, two = points[at + 1], points[at + 2]
    for a, b in ENDINGS_2:
        kinds[at[(one == ord(a)) & (two == ord(b))]] = LONG
    kinds[firsts] += FIRST
    return kinds


def states_before(symbols: np.ndarray) -> np.ndarray:
    """State before each symbol, from FRESH, by a blocked scan of transition functions."""
    after, _ = _automaton()
    table = after.ravel()
    n = len(symbols)
    rows = -(-n // _BLOCK)
    padded = np.full(rows * _BLOCK, STAY, np.int32)
    padded[:n] = symbols
    columns = np.ascontiguousarray(padded.reshape(rows, _BLOCK).T) * 8
    whole = np.broadcast_to(np.arange(8, dtype=np.uint8), (rows, 8))
    for column in columns:  # each block as one function
        whole = table[column[:, None] + whole]
    step = 1
    while step < rows:  # prefixes of blocks: compose with what lies ``step`` back
        joined = whole.copy()
        joined[step:] = np.take_along_axis(whole[step:], whole[:-step], axis=1)
        whole, step = joined, 2 * step
    state = np.full(rows, FRESH, np.uint8)
    state[1:] = whole[:-1, FRESH]
    out = np.empty((_BLOCK, rows), np.uint8)
    for i, column in enumerate(columns):
        out[i] = state
        state = table[column + state]
    return out.T.reshape(-1)[:n]


def slices(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each slice that is merged separately; first slice of each text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4").astype(np.int64)
    width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    places = np.cumsum(width) - width
    firsts = np.zeros(len(points), bool)
    firsts[np.searchsorted(places, offsets[offsets < len(data)])] = True
    symbols = classes(points, firsts)
    _, begins = _automaton()
    starts = places[begins[symbols, states_before(symbols)]]
    return starts, np.append(starts[1:], len(data)), np.searchsorted(starts, offsets)


def merge_pairs(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a slice: of all adjacent pairs the lowest rank is merged, the first of equals."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    ends = list(range(1, n + 1))  # end of the part that starts here; 0: no part starts here
    back = list(range(-1, n - 1))  # start of the part before
    queue = [(r, i) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(queue)
    while queue:
        rank, i = heapq.heappop(queue)
        middle = ends[i]
        if not middle or middle == n or ranks.get(piece[i : ends[middle]]) != rank:
            continue  # one of the two has been merged since
        end = ends[i] = ends[middle]
        ends[middle] = 0
        if end < n:
            back[end] = i
            if (r := ranks.get(piece[i : ends[end]])) is not None:
                heapq.heappush(queue, (r, i))
        if (j := back[i]) >= 0 and (r := ranks.get(piece[j:end])) is not None:
            heapq.heappush(queue, (r, j))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return ids


class Vocabulary:
    """Ranks of a ``.tiktoken`` file, and the bytes of each id."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        size = max(self.ranks.values()) + 1
        by_id = [b""] * size
        for raw, rank in self.ranks.items():
            by_id[rank] = raw
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.lengths = np.fromiter(map(len, by_id), np.int64, size)
        self.firsts = np.cumsum(self.lengths) - self.lengths
        self.encoder = PieceEncoder(lambda pieces: [merge_pairs(x, self.ranks) for x in pieces])


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _cells(raw: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Bytes cut at ``bounds`` into one binary cell each."""
    raw = np.ascontiguousarray(raw).view(np.uint8).reshape(-1)
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype("<i8")), pa.py_buffer(raw)]
    ).cast(pa.binary())


def _with(block: pa.RecordBatch, dropped: str, **columns: pa.Array) -> pa.RecordBatch:
    kept = {n: block.column(n) for n in block.schema.names if n != dropped}
    return pa.RecordBatch.from_pydict(kept | columns)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and ends per document: ids as little-endian unsigned 32-bit integers, and
    the end of each id's bytes in the text, likewise.

    Null counts as empty and gives no ids. Every row gives one row; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            for block in blocks(batch, "text", _TEXT_BYTES):
                data, offsets = flat(block.column("text"))
                starts, ends, firsts = slices(data, offsets)
                ids, counts = vocab.encoder(data, starts, ends)
                bounds = np.concatenate(([0], np.cumsum(counts)))[firsts]
                done = np.cumsum(vocab.lengths[ids]) - np.repeat(offsets[:-1], np.diff(bounds))
                yield _with(
                    block, "text", ids=_cells(ids.astype("<u4"), 4 * bounds), ends=_cells(done.astype("<u4"), 4 * bounds)
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, ids binary, ends binary")


def _id_blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose ids take about as much as a block of text."""
    sizes = pc.binary_length(batch.column("ids")).to_numpy()
    ends = np.cumsum(sizes)
    row = 0
    while row < batch.num_rows:
        before = ends[row - 1] if row else 0
        end = max(row + 1, int(np.searchsorted(ends, before + _TEXT_BYTES, side="right")))
        yield batch.slice(row, end - row)
        row = end


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, ends and the decoded bytes; ids outside the vocabulary are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            for part in _id_blocks(batch):
                cells = part.column("ids").cast(pa.large_binary())
                bounds = np.frombuffer(cells.buffers()[1], np.int64)[cells.offset : cells.offset + len(cells) + 1] // 4
                raw = cells.buffers()[2]
                ids = np.frombuffer(raw, "<u4") if raw is not None else np.zeros(0, np.uint32)
                ids, bounds = ids[bounds[0] : bounds[-1]], bounds - bounds[0]
                lengths = vocab.lengths[ids]
                text = vocab.bytes[ragged(vocab.firsts[ids], lengths)]
                ends = np.concatenate(([0], np.cumsum(lengths)))[bounds]
                yield _with(part, "", decoded=_cells(text, ends))

    return encoded.select("doc_id", "ids", "ends").mapInArrow(
        run, "doc_id long, ids binary, ends binary, decoded binary"
    )
