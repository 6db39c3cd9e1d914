"""Token ids in binary files: blocks of ids as compressed byte or bit planes, with a chunk index.

A file holds the documents of one range of doc_id, in order:

    magic | chunks | directory | chunk index | footer | magic

A chunk is a block of ``block_ids`` consecutive ids (the last is shorter), transposed into
planes: plane i holds byte i (or bit i) of every id. Each plane is compressed on its own;
high planes are almost constant and vanish. The directory has each document's id and
number of ids. The chunk index has each chunk's place, number of ids and plane sizes. The
footer has places and sizes of both. All numbers are little-endian.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from limitline.llm.pieces import documents_ids, library_encoder
from limitline.llm.storage import new_path, stored
from limitline.llm.textblocks import blocks, flat

#: Fixed values of the file format.
MAGIC = b"IDPLANE1"
FOOTER = struct.Struct("<QQQQII")  # directory place, size; index place, size; planes, bits in a plane
PLANES = {"byte": (4, 8), "bit": (32, 1)}

BLOCK_IDS = 1 << 16

_INDEX = "file string, part long, n_docs long, n_ids long"
_READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block, the lowest first."""
    as_bytes = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [as_bytes[:, i].tobytes() for i in range(4)]
    bits = np.unpackbits(as_bytes, axis=1, bitorder="little")
    return [np.packbits(bits[:, i], bitorder="little").tobytes() for i in range(32)]


def from_planes(planes: list[bytes], n: int, bits: int) -> np.ndarray:
    """The block again."""
    stacked = np.stack([np.frombuffer(x, np.uint8) for x in planes])
    if bits == 1:
        flags = np.unpackbits(stacked, axis=1, count=n, bitorder="little")
        stacked = np.packbits(flags, axis=0, bitorder="little")
    return np.ascontiguousarray(stacked.T).view("<u4").reshape(-1)


class PlaneWriter:
    """Writes one file, a block at a time."""

    def __init__(self, sink, kind: str = "byte", block_ids: int = BLOCK_IDS, level: int = 3):
        self._sink, self._kind, self._block = sink, kind, block_ids
        self._zip = zstandard.ZstdCompressor(level=level)
        self._rest: list[np.ndarray] = []
        self._held = self._at = 0
        self._chunks: list[list[int]] = []
        self._docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._put(MAGIC)

    def _put(self, raw: bytes) -> int:
        self._sink.write(raw)
        self._at += len(raw)
        return len(raw)

    def add(self, doc_ids: np.ndarray, known: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Documents, whether each has an id, how many ids it holds, and those."""
        self._docs.append((doc_ids, known, sizes))
        self._rest.append(ids)
        self._held += len(ids)
        if self._held >= self._block:
            self._flush(self._held - self._held % self._block)

    def _flush(self, upto: int) -> None:
        ids = np.concatenate(self._rest)
        for a in range(0, upto, self._block):
            part = ids[a : min(a + self._block, upto)]
            at = self._at
            sizes = [self._put(self._zip.compress(x)) for x in to_planes(part, self._kind)]
            self._chunks.append([at, len(part), *sizes])
        self._rest = [ids[upto:]]
        self._held -= upto

    def close(self) -> tuple[int, int]:
        """Ends the file; the documents and ids in it."""
        if self._held:
            self._flush(self._held)
        doc_ids, known, sizes = (np.concatenate(x) for x in zip(*self._docs, strict=True))
        directory = np.stack([doc_ids, known.astype("<i8"), sizes]).astype("<i8").tobytes()
        table = np.asarray(self._chunks, "<i8").tobytes()
        places = []
        for raw in (directory, table):
            places += [self._at, self._put(self._zip.compress(raw))]
        self._put(FOOTER.pack(*places, *PLANES[self._kind]) + MAGIC)
        return len(doc_ids), int(sizes.sum())


def read_file(source) -> Iterator[tuple[int | None, int, int]]:
    """Id, number of ids and CRC-32 of those, for each document of a file."""
    unzip = zstandard.ZstdDecompressor()
    tail = FOOTER.size + len(MAGIC)
    end = source.size()
    raw = source.read_at(tail, end - tail)
    if raw[FOOTER.size :] != MAGIC:
        raise ValueError("not a file of id planes, or not whole")
    d_at, d_size, c_at, c_size, planes, bits = FOOTER.unpack(raw[: FOOTER.size])
    directory = np.frombuffer(unzip.decompress(source.read_at(d_size, d_at)), "<i8").reshape(3, -1)
    chunks = np.frombuffer(unzip.decompress(source.read_at(c_size, c_at)), "<i8").reshape(-1, 2 + planes)

    def ids() -> Iterator[memoryview]:
        for at, n, *sizes in chunks.tolist():
            whole = source.read_at(sum(sizes), at)
            cuts = np.cumsum([0, *sizes]).tolist()
            parts = [unzip.decompress(whole[a:b]) for a, b in zip(cuts, cuts[1:])]
            yield memoryview(from_planes(parts, n, bits)).cast("B")

    blocks_left, now, at = ids(), memoryview(b""), 0
    for doc_id, known, size in directory.T.tolist():
        left, crc = 4 * size, 0
        while left:
            if at == len(now):
                now, at = next(blocks_left), 0
            take = min(left, len(now) - at)
            crc = zlib.crc32(now[at : at + take], crc)
            at, left = at + take, left - take
        yield (doc_id if known else None), size, crc


#: Bytes of text encoded at once.
ENCODED_BYTES = 1 << 20


def _open(uri: str):
    system, path = fs.FileSystem.from_uri(uri)
    return system, path


def _write_partition(folder: str, tokenizer: str, split: str, end_id: int, kind: str, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        writer = sink = None
        # Of several attempts each writes its own file; the index names that of the one that counts.
        name = f"{folder}/ids-{task.partitionId():06d}-{uuid.uuid4().hex}.planes"
        for batch in batches:
            for block in blocks(batch, "text", ENCODED_BYTES):
                data, offsets = flat(block.column("text"))
                ids, bounds = documents_ids(data, offsets, tokenizer, split, end_id)
                if writer is None:
                    system, path = _open(name)
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    sink = system.open_output_stream(path)
                    writer = PlaneWriter(sink, kind, block_ids)
                column = block.column("doc_id")
                known = np.asarray(column.is_valid())
                writer.add(column.fill_null(0).to_numpy(), known, np.diff(bounds), ids)
        library_encoder(tokenizer).close()
        if writer is not None:
            n_docs, n_ids = writer.close()
            sink.close()
            yield pa.RecordBatch.from_pylist(
                [{"file": name, "part": task.partitionId(), "n_docs": n_docs, "n_ids": n_ids}]
            )

    return run


def write_token_files(
    docs: DataFrame,
    tokenizer: str,
    split: str = "space",
    end_id: int = 0,
    kind: str = "byte",
    block_ids: int = BLOCK_IDS,
    folder: str | None = None,
) -> DataFrame:
    """Encodes all documents into files in ascending order of doc_id; one row per file.

    Null or empty text gives ``end_id`` alone. Rows of equal doc_id stand side by side, in an
    order that their texts' hashes give; those without one come first. An empty table gives no files. Other columns
    are not read. Files of attempts that failed stay in the folder and are in no index.
    """
    folder = folder or new_path(docs.sparkSession, "ids")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "tie").drop("tie")
    write = _write_partition(folder, tokenizer, split, end_id, kind, block_ids)
    return stored(ordered.mapInArrow(write, _INDEX), "ids-index")


def read_token_files(index: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32.

    The window runs over one row per file.
    """
    first = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    files = index.withColumn("first", F.coalesce(first, F.lit(0)).cast("long")).select("file", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, path = _open(row["file"])
                with system.open_input_file(path) as source:
                    yield from _counted(read_file(source), row["first"])

    return files.repartition(max(1, index.count()), "file").mapInArrow(run, _READ)


def _counted(found: Iterator[tuple], start: int, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(x, pa.int64()) for x in ("doc_id", "start", "n_tokens", "ids_crc32")])
    held: list[tuple] = []
    for doc_id, size, crc in found:
        held.append((doc_id, start, size, crc))
        start += size
        if len(held) == rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*held)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*held)], schema=schema)
