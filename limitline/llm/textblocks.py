"""Texts of an Arrow batch as flat byte arrays: splitting and hashing without a Python loop."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer text forms a block of its own.
BLOCK_BYTES = 4 << 20

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

#: The ASCII characters with the White_Space property.
ASCII_SPACE = np.zeros(256, dtype=bool)
ASCII_SPACE[[9, 10, 11, 12, 13, 32]] = True


def blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about ``limit`` bytes."""
    _, offsets = flat(batch.column(column))
    if not batch.num_rows:
        return
    row = 0
    while row < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), batch.num_rows)
        yield batch.slice(row, end - row)
        row = end


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offset of each; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run without ASCII white space; first word of each text."""
    solid = ~ASCII_SPACE[data]
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    start[edges] = solid[edges]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    last[edges - 1] = solid[edges - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(keys: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit keys (the finalizer of splitmix64)."""
    keys = keys ^ (keys >> np.uint64(30))
    keys = keys * np.uint64(0xBF58476D1CE4E5B9)
    keys = keys ^ (keys >> np.uint64(27))
    keys = keys * np.uint64(0x94D049BB133111EB)
    return keys ^ (keys >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    powers = np.full(max(n, 1), base, dtype=np.uint64)
    powers[0] = 1
    return np.multiply.accumulate(powers)


#: Bytes whose running total is taken with one table of powers.
_ROW = 4096
_INVERSE = pow(int(_MULTIPLIER), -1, 1 << 64)
_UP, _DOWN = _powers(int(_MULTIPLIER), _ROW), _powers(_INVERSE, _ROW)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each non-empty span; spans are in order and do not overlap.

    The sum of (byte + 1) * multiplier^place over the places in the span: running totals at both
    ends, their difference divided by the multiplier's power at the start.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    rows = -(-len(data) // _ROW)
    padded = np.zeros(rows * _ROW, np.uint8)
    padded[: len(data)] = data
    total = np.zeros((rows, _ROW + 1), np.uint64)  # before each byte of a row, and after its last
    inner = total[:, 1:]
    inner[...] = padded.reshape(rows, _ROW)
    inner += np.uint64(1)
    inner *= _UP
    np.cumsum(inner, axis=1, out=inner)
    up, down = (_powers(pow(base, _ROW, 1 << 64), rows) for base in (int(_MULTIPLIER), _INVERSE))
    before = np.cumsum(total[:, -1] * up) - total[:, -1] * up
    total = total.reshape(-1)
    row, last = starts // _ROW, (ends - 1) // _ROW
    values = before[last] + up[last] * total[ends + last] - before[row] - up[row] * total[starts + row]
    values *= down[row] * _DOWN[starts - row * _ROW]
    return mixed(values ^ ((ends - starts).astype(np.uint64) << np.uint64(48)))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes of all spans, one after the other."""
    firsts = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum()), dtype=np.int64) + np.repeat(starts - firsts, lengths)


def shingle_hashes(
    word_hashes: np.ndarray, firsts: np.ndarray, size: int
) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``size`` words inside a text, and the first word of each run.

    ``firsts`` holds the first word of each text and the number of words at its end.
    """
    n = len(word_hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total, have, power = word_hashes, 1, int(_MULTIPLIER)
    for bit in f"{size:b}"[1:]:  # runs of twice as many words, and of one more where the bit is set
        total = total[:-have] * np.uint64(power) + total[have:]
        have, power = 2 * have, power * power % (1 << 64)
        if bit == "1":
            total = total[:-1] * _MULTIPLIER + word_hashes[have:]
            have, power = have + 1, power * int(_MULTIPLIER) % (1 << 64)
    inside = np.ones(n, dtype=bool)
    for back in range(1, size):  # runs that start so close before a text's end reach over it
        cut = firsts[1:-1] - back
        inside[cut[(cut >= 0) & (cut < n)]] = False
    at = np.flatnonzero(inside)
    return mixed(total[at]), at
