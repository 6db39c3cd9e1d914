"""Near duplicates by SimHash fingerprints, linked through one-wildcard segment variants.

A fingerprint is cut into two halves. Of two that differ in at most three bits, one half
differs in at most one; so both have a common variant in which that bit is a wildcard,
while the other half stays free. Fingerprints are indexed under all 64 variants, an equality
grouping brings those of one variant together, and every link is verified on all bits.

A group is named by its free bits and the value of the fixed ones, and each group is
small: where a variant has more members than ``GROUP_ROWS``, its members are indexed again
by the variants of the free bits, half by half as before. That leaves 64, 33, 18, then 10
free bits, and ten bits have no more than 1024 values. Groups give the links of a
spanning forest, never all pairs; copies share a fingerprint and take part once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limitline.llm.components import components
from limitline.llm.storage import stored

WORDS = 3
SEED = 42
DISTANCE = 3
#: Members of a group that one task compares; at least 1024, so that the third cut ends.
GROUP_ROWS = 2048

#: Bytes of a text that are split into words at once, and shingles that are counted at once.
TEXT_BYTES = 1 << 20
COUNT_ROWS = 1 << 16

ALL_BITS = (1 << 64) - 1
_SPACE = re.compile(rb"[ \t-\r]")


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _shingle_hashes(text: bytes) -> Iterator[np.ndarray]:
    """XXH64 of each run of three words (the whole of fewer), some at a time."""
    words: list[bytes] = []
    done, hashed = 0, False
    while done < len(text):
        gap = _SPACE.search(text, done + TEXT_BYTES)
        end = gap.start() if gap else len(text)
        words = words[-(WORDS - 1) :] + text[done:end].split()
        done = end
        if len(words) >= WORDS:
            shingles = map(b" ".join, zip(*(words[i:] for i in range(WORDS))))
            yield np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
            hashed = True
    if words and not hashed:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)


def fingerprint(text: str | None) -> int:
    """The bits set in over half of the hashes; 0 for a text without words."""
    counts, n = np.zeros(64, np.int64), 0
    for hashes in _shingle_hashes((text or "").encode().lower()):
        for at in range(0, len(hashes), COUNT_ROWS):
            some = hashes[at : at + COUNT_ROWS].astype("<u8")
            bits = np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.int64)
        n += len(hashes)
    set_ = np.packbits(2 * counts > n, bitorder="little")
    return int(set_.view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [_signed(fingerprint(text.as_py())) for text in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(prints, pa.int64())], names=["doc_id", "print"]
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and print, the fingerprint as a signed long, of every row."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_fingerprints, "doc_id long, print long")


def variants(free: int) -> list[int]:
    """The free bits of each variant of a fingerprint of which ``free`` bits are free.

    One half of the bits is fixed but for one wildcard, the other half stays free.
    """
    places = [i for i in range(64) if free >> i & 1]
    halves = places[: len(places) // 2], places[len(places) // 2 :]
    found = []
    for half, other in (halves, halves[::-1]):
        found += [sum(1 << i for i in other) | 1 << wildcard for wildcard in half]
    return found


def _indexed(members: DataFrame, level: int) -> DataFrame:
    """print, free and fixed: every member under each of its variants.

    The table of variants depends on nothing but the level: 64 rows, 64 x 33, then
    64 x 33 x 18 at most.
    """
    free = [ALL_BITS]
    for _ in range(level):
        free = sorted({v for f in free for v in variants(f)})
    table = [(_signed(f), [_signed(v) for v in variants(f)]) for f in free]
    if level == 0:
        at = members.select("print", F.explode(F.lit(table[0][1])).alias("free"))
    else:
        masks = members.sparkSession.createDataFrame(table, "free long, finer array<long>")
        at = members.join(F.broadcast(masks), "free").select("print", F.explode("finer").alias("free"))
    return at.withColumn("fixed", F.expr("print & ~free"))


def _forest(prints: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect what links of at most ``distance`` bits connect."""
    left, links = prints, []
    while len(left) > 1:
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            a = reached.pop()
            near = np.bitwise_count(left ^ a) <= distance
            links += [(a, b) for b in left[near]]
            reached += list(left[near])
            left = left[~near]
    return links


def _links(distance: int):
    """Links inside the groups of a partition that is sorted by group."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def of(group: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]).any(axis=1)]) if len(group) else []
        sizes = np.diff(np.r_[starts, len(group)]).astype(np.int64)
        two = np.asarray(starts, np.int64)[sizes == 2]
        two = two[np.bitwise_count(prints[two] ^ prints[two + 1]) <= distance]
        found = [np.stack([prints[two], prints[two + 1]], axis=1).reshape(-1, 2)]
        for i in np.flatnonzero(sizes > 2):
            if links := _forest(prints[starts[i] : starts[i] + sizes[i]], distance):
                found.append(np.array(links, np.uint64).reshape(-1, 2))
        pairs = np.concatenate(found).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, prints = np.zeros((0, 2), np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("free", "fixed")], axis=1)
            group = np.concatenate([group, new])
            more = batch.column("print").to_numpy(zero_copy_only=False).view(np.uint64)
            prints = np.concatenate([prints, more])
            # The last group may go on in the next batch.
            last = np.flatnonzero((group != group[-1]).any(axis=1))
            whole = int(last[-1]) + 1 if len(last) else 0
            if whole:
                yield of(group[:whole], prints[:whole])
                group, prints = group[whole:], prints[whole:]
        yield of(group, prints)

    return run


def near_links(prints: DataFrame, distance: int = DISTANCE, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Links (a, b) that connect all distinct ``print`` values at most ``distance`` bits apart.

    ``distance`` is three at most. Groups beyond ``group_rows`` are cut further, until
    there are none; the last cut leaves 1024 members at most, which are always compared.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two halves leave one wildcard for up to three differing bits")
    members, level, found = prints, 0, []
    while members is not None:
        at = _indexed(members, level)
        members, last = None, level == 2
        if not last:
            sizes = at.groupBy("free", "fixed").count()
            large = stored(sizes.where(F.col("count") > group_rows).select("free", "fixed"), "groups")
            if not large.isEmpty():
                members = stored(at.join(large, ["free", "fixed"], "left_semi").select("print", "free").distinct(), "members")
            at = at.join(large, ["free", "fixed"], "left_anti")
        grouped = at.distinct() if level else at
        grouped = grouped.repartition("free", "fixed").sortWithinPartitions("free", "fixed")
        found.append(grouped.select("free", "fixed", "print").mapInArrow(_links(distance), "a long, b long"))
        level += 1
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links.distinct()


def simhash_groups(docs: DataFrame, distance: int = DISTANCE, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    component_id is the smallest doc_id that links of at most ``distance`` differing bits
    reach, the row's own included. Null and empty texts have fingerprint zero and are
    linked like any other; rows without doc_id link others and have a component_id only
    where another row of the component has an id. Repeated rows each give a row, extra
    columns play no part, an empty table gives none. Texts are taken whole, of any length.
    """
    prints = stored(fingerprints(docs), "prints")
    first = stored(prints.groupBy("print").agg(F.min("doc_id").alias("first")), "firsts")
    roots = components(near_links(first.select("print"), distance, group_rows))
    linked = first.join(roots, F.col("print") == F.col("node")).select("print", "first", "root")
    ids = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = linked.join(ids, "root").select("print", "component_id")
    every = first.join(linked, "print", "left").select(
        "print", F.coalesce("component_id", "first").alias("component_id")
    )
    return prints.join(every, "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )
