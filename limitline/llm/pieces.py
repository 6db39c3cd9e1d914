"""Exact tokenizing by pieces: each distinct piece of a text is encoded once and then looked up.

A tokenizer that splits a text before its merges gives the same ids for the whole text as
for the pieces between some of its splits, one after the other. ``space_pieces`` and
``words`` cut only where such a split is certain; where it is not, a piece just gets longer.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Callable, Sequence
from itertools import chain, repeat

import numpy as np

from limitline.llm.textblocks import ASCII_SPACE, ragged, span_hashes, words

#: Distinct pieces kept per Python worker, and the longest that is kept. A full store is
#: emptied; neither bound changes a result.
KEPT_PIECES = 300_000
KEPT_BYTES = 64

Spans = tuple[np.ndarray, np.ndarray, np.ndarray]


_APOSTROPHE = ord("'")
_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[[i for i in range(128) if chr(i).isalpha()]] = True
#: Bytes after C3 that make a letter: all but the signs for times and divided by.
_AFTER_C3 = np.zeros(256, dtype=bool)
_AFTER_C3[[i for i in range(0x80, 0xC0) if i not in (0x97, 0xB7)]] = True


def _letter_edges(data: np.ndarray) -> np.ndarray:
    """Places between a letter of ASCII or Latin-1 and an ASCII character of another kind.

    Runs of letters end there whatever else a pattern says, but for an apostrophe in front.
    """
    edge = np.zeros(len(data), dtype=bool)
    if len(data) < 2:
        return edge
    letter = _ASCII_LETTER[data]
    ends, begins = letter.copy(), letter
    latin = (data[:-1] == 0xC3) & _AFTER_C3[data[1:]]
    ends[1:] |= latin
    begins = letter.copy()
    begins[:-1] |= latin
    other = (data < 0x80) & ~letter & ~ASCII_SPACE[data]
    edge[1:] = ends[:-1] & other[1:]
    edge[1:] |= (other & (data != _APOSTROPHE))[:-1] & begins[1:]
    return edge


def space_pieces(data: np.ndarray, offsets: np.ndarray) -> Spans:
    """Pieces that begin with a text, with white space after something else, or at the edge of letters.

    For splits that never reach from other characters into white space. A space is left
    inside a piece if white space beyond ASCII may stand before it.
    """
    n = len(data)
    space = ASCII_SPACE[data]
    cut = space.copy()
    cut[1:] &= ~space[:-1]
    if n > 2:  # no White_Space character beyond ASCII ends otherwise: C2 xx, E1/E2/E3 xx xx
        cut[2:] &= data[:-2] != 0xC2
        cut[3:] &= ~np.isin(data[:-3], (0xE1, 0xE2, 0xE3))
    cut |= _letter_edges(data)
    cut[offsets[offsets < n]] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], n) if len(starts) else starts
    return starts, ends, np.searchsorted(starts, offsets)


def word_pieces(data: np.ndarray, offsets: np.ndarray) -> Spans:
    """Words, also cut at the edges of letters; for tokenizers that drop white space."""
    starts, ends, _ = words(data, offsets)
    inner = _letter_edges(data)
    inner[starts] = False
    inner = np.flatnonzero(inner)
    starts, ends = np.sort(np.append(starts, inner)), np.sort(np.append(ends, inner))
    return starts, ends, np.searchsorted(starts, offsets)


class PieceEncoder:
    """Ids of many pieces; ``encode`` gives the ids of distinct ones."""

    def __init__(self, encode: Callable[[list[bytes]], Sequence[Sequence[int]]]):
        self._encode = encode
        self._clear()

    def close(self) -> None:
        """Forget all pieces, at the end of a task."""
        self._clear()

    def _clear(self) -> None:
        self._entry: dict[bytes, int] = {}
        self._ids = np.zeros(1 << 16, np.uint32)
        self._first = [0]
        self._held = 0

    def _add(self, pieces: list[bytes]) -> None:
        found, at = self._encode(pieces), self._first[-1]
        self._first += (at + np.cumsum([len(x) for x in found], dtype=np.int64)).tolist()
        end = self._first[-1]
        if end > len(self._ids):
            grown = np.zeros(2 * end, np.uint32)
            grown[: len(self._ids)] = self._ids
            self._ids = grown
        self._ids[at:end] = np.fromiter(chain.from_iterable(found), np.uint32, end - at)
        self._held += sum(map(len, pieces))

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each piece has."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(self._first) > KEPT_PIECES or self._held > KEPT_PIECES * KEPT_BYTES:
            self._clear()
        raw = data.tobytes()
        hashes = span_hashes(data, starts, ends)
        _, sample, which = np.unique(hashes, return_index=True, return_inverse=True)
        pieces = [raw[s:e] for s, e in zip(starts[sample].tolist(), ends[sample].tolist(), strict=True)]
        entries = np.fromiter(map(self._entry.get, pieces, repeat(-1)), np.int64, len(pieces))
        known = len(self._first) - 1
        unseen = np.flatnonzero(entries < 0)
        entries[unseen] = known + np.arange(len(unseen))
        fresh = [pieces[i] for i in unseen.tolist()]
        # Two samples are never equal, as equal pieces have one hash.
        self._entry.update((piece, known + i) for i, piece in enumerate(fresh) if len(piece) <= KEPT_BYTES)
        entry = entries[which]
        wrong = self._unlike(data, starts, ends, starts[sample][which], ends[sample][which])
        for n, i in enumerate(wrong.tolist(), known + len(fresh)):  # shares the hash of its sample, not the bytes
            entry[i] = n
            fresh.append(raw[starts[i] : ends[i]])
        self._add(fresh)
        firsts = np.asarray(self._first, np.int64)
        counts = np.diff(firsts)[entry]
        ids = self._ids[ragged(firsts[entry], counts)]
        return ids, counts

    @staticmethod
    def _unlike(data, starts, ends, sample_starts, sample_ends) -> np.ndarray:
        """Pieces that differ from the sample of their hash."""
        lengths = ends - starts
        differ = lengths != sample_ends - sample_starts
        same = np.flatnonzero(~differ & (starts != sample_starts))
        if len(same):
            left = ragged(starts[same], lengths[same])
            right = ragged(sample_starts[same], lengths[same])
            off = data[left] != data[right]
            firsts = np.cumsum(lengths[same]) - lengths[same]
            differ[same] |= np.logical_or.reduceat(off, firsts)
        return np.flatnonzero(differ)


#: A run of letters of ASCII and Latin-1, after a space or not: one split of the tokenizers here.
_PLAIN = re.compile("( ?)([A-Za-zÀ-ÖØ-öø-ÿ]+)")


def _printable_bytes() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies.

    Printable bytes of Latin-1 stand for themselves, the others for characters from 256 on.
    """
    itself = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(i if i in itself else next(rest)) for i in range(256)]


@functools.lru_cache(maxsize=4)
def library_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=4)
def added_strings(path: str) -> tuple[bytes, ...]:
    """The strings of added tokens, in lower case: some are matched in normalized text."""
    with open(path, encoding="utf-8") as file:
        return tuple(t["content"].lower().encode() for t in json.load(file)["added_tokens"])


def _with_added(data: np.ndarray, offsets: np.ndarray, path: str) -> list[int]:
    """The texts that may hold an added token, which are encoded whole."""
    strings, raw = added_strings(path), data.tobytes()
    # What stands before the first letter is the same in any case, and quickly looked for.
    if not any(re.match(rb"[^a-z\x80-\xff]*", s)[0] in raw for s in strings):
        return []
    texts = (raw[a:b].decode().lower().encode() for a, b in zip(offsets.tolist(), offsets[1:].tolist()))
    return [i for i, text in enumerate(texts) if any(s in text for s in strings)]


@functools.lru_cache(maxsize=4)
def library_encoder(path: str) -> PieceEncoder:
    """Pieces by the ``tokenizers`` library, for texts without the string of an added token.

    A plain run of letters is one split, and goes to the library's model at once.
    """
    tokenizer = library_tokenizer(path)
    with open(path, encoding="utf-8") as file:
        normalizer = json.load(file)["normalizer"]
    lower = normalizer is not None  # the one here lowers; it drops spaces, too
    stand_in = _printable_bytes()
    split_of = {chr(i): "".join(stand_in[b] for b in chr(i).encode()) for i in range(256)}
    table = str.maketrans(split_of)
    merge, space = tokenizer.model.tokenize, split_of[" "]

    def encode(pieces: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = []
        rest, at = [], []
        for piece in pieces:
            letters = piece[1:] if piece[0] == 32 else piece
            if letters.isalpha():  # of ASCII: each stands for itself
                text = letters.decode().lower() if lower else (space if letters is not piece else "") + letters.decode()
                out.append([t.id for t in merge(text)])
                continue
            text = piece.decode()
            if plain := _PLAIN.fullmatch(text):
                text = plain[2].lower() if lower else text
                out.append([t.id for t in merge(text.translate(table))])
            else:
                at.append(len(out))
                rest.append(text)
                out.append([])
        for i, found in zip(at, tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            out[i] = found.ids
        return out

    return PieceEncoder(encode)


#: How a tokenizer file's texts may be cut: by its own treatment of white space.
SPLITS: dict[str, Callable[[np.ndarray, np.ndarray], Spans]] = {"space": space_pieces, "words": word_pieces}


def documents_ids(
    data: np.ndarray, offsets: np.ndarray, path: str, split: str, end_id: int
) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, ``end_id`` after each, and the first id of each text."""
    n = len(offsets) - 1
    whole = _with_added(data, offsets, path)
    if whole:
        cut = np.flatnonzero(np.isin(np.arange(n), whole, invert=True))
        kept = ragged(offsets[cut], np.diff(offsets)[cut])
        lengths = np.diff(offsets)[cut]
        parts, at = documents_ids(data[kept], np.concatenate(([0], np.cumsum(lengths))), path, split, end_id)
        of = dict(zip(cut.tolist(), np.split(parts, at[1:-1]), strict=True)) if len(cut) else {}
        raw, tokenizer = data.tobytes(), library_tokenizer(path)
        for i in whole:
            found = tokenizer.encode(raw[offsets[i] : offsets[i + 1]].decode(), add_special_tokens=False)
            of[i] = np.asarray([*found.ids, end_id], np.uint32)
        return np.concatenate([of[i] for i in range(n)]), np.cumsum([0, *(len(of[i]) for i in range(n))])
    starts, ends, firsts = SPLITS[split](data, offsets)
    ids, counts = library_encoder(path)(data, starts, ends)
    before = np.concatenate(([0], np.cumsum(counts)))[firsts]  # ids before each text
    out = np.empty(len(ids) + n, np.uint32)
    bounds = before + np.arange(n + 1)
    real = np.ones(len(out), dtype=bool)
    real[bounds[1:] - 1] = False
    out[real] = ids
    out[~real] = end_id
    return out, bounds
