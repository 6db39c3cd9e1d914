"""Exact top-k by inner product through distributed histogram selection.

Vectors are packed into blocks, and every block of queries is scored against every block of
candidates; scores are never stored. The k-th best score of a query is found by
histograms: each pair of blocks counts its scores in equal bins over the interval known so
far, from the top down to the bin of its own k-th best (what lies lower cannot be the
global one); counts are summed over all blocks, and the bin that holds the k-th score is
the next interval, until it is a single score. Then every block gives its scores above that,
and of those equal to it the k with the smallest ids, and the k best of all remain.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from limitline.llm.storage import stored

#: Vectors in a block, and bins of a histogram.
BLOCK_ROWS = 1024
BINS = 1024
SCALE = 256

_BLOCK = "ids array<long>, vectors binary, dim int, top double"
#: What a block of queries is called beside one of candidates.
_QUERIES = ("q_ids", "q_vectors", "q_dim", "q_top")


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v, an array of floor(scale * x); only vectors whose components are all finite."""
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != math.inf))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double"))
    return (
        vectors.select(F.col("vec_id").cast("long"), "embedding")
        .where("vec_id is not null and embedding is not null")
        .where(usable)
        .select("vec_id", whole.alias("v"))
    )


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of vectors of one length."""
    schema = pa.schema(
        [("ids", pa.list_(pa.int64())), ("vectors", pa.binary()), ("dim", pa.int32()), ("top", pa.float64())]
    )

    def block(ids: np.ndarray, rows: np.ndarray) -> dict:
        top = float(np.abs(rows).max()) if rows.size else 0.0
        return {"ids": ids.tolist(), "vectors": rows.tobytes(), "dim": rows.shape[1], "top": top}

    for batch in batches:
        column = batch.column("v")
        sizes = column.value_lengths().to_numpy()
        values = column.flatten().to_numpy()
        firsts = np.cumsum(sizes) - sizes
        ids = batch.column("vec_id").to_numpy()
        for dim in np.unique(sizes).tolist():
            of_dim = np.flatnonzero(sizes == dim)
            for a in range(0, len(of_dim), BLOCK_ROWS):
                rows = of_dim[a : a + BLOCK_ROWS]
                packed = values[firsts[rows][:, None] + np.arange(dim)]
                yield pa.RecordBatch.from_pylist([block(ids[rows], packed)], schema=schema)


def _scores(q: dict, c: dict) -> np.ndarray:
    """Exact integer inner products of two blocks; a query's own row gets the lowest number."""
    a = np.frombuffer(q["q_vectors"]).reshape(len(q["q_ids"]), -1)
    b = np.frombuffer(c["vectors"]).reshape(len(c["ids"]), -1)
    bound = q["q_top"] * c["top"] * max(1, q["q_dim"])
    if bound < 2.0**53:  # every partial sum is exact in doubles
        out = (a @ b.T).astype(np.int64)
    elif bound < 2.0**62:
        out = a.astype(np.int64) @ b.astype(np.int64).T
    else:
        raise ValueError("inner products do not fit 64-bit integers")
    out[np.asarray(q["q_ids"])[:, None] == np.asarray(c["ids"])[None, :]] = np.iinfo(np.int64).min
    return out


def _histograms(k: int, bins: int):
    own = np.iinfo(np.int64).min

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if row["q_dim"] != row["dim"]:
                    continue
                scores = _scores(row, row)
                places, found, counts = [], [], []
                for i in range(len(scores)):
                    low, width = row["low"][i], row["width"][i]
                    # Scores above the interval are the last bin's: they come before what is looked for.
                    of = np.minimum((scores[i] - low) // width, bins)[(scores[i] >= low) & (scores[i] != own)]
                    if len(of):
                        cut = np.partition(of, len(of) - k)[len(of) - k] if len(of) > k else of.min()
                        bin_, n = np.unique(of[of >= cut], return_counts=True)
                        places.append(np.full(len(bin_), i))
                        found.append(bin_)
                        counts.append(n)
                if places:
                    place = np.concatenate(places)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "block": [row["block"]] * len(place),
                            "i": place.astype(np.int32),
                            "bin": np.concatenate(found).astype(np.int64),
                            "n": np.concatenate(counts).astype(np.int64),
                        }
                    )

    return run


def _selected(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.iinfo(np.int64).min
        for batch in batches:
            for row in batch.to_pylist():
                if row["q_dim"] != row["dim"]:
                    continue
                scores, ids = _scores(row, row), np.asarray(row["ids"], np.int64)
                places, vecs, values = [], [], []
                for i in range(len(scores)):
                    at = np.flatnonzero((scores[i] >= row["low"][i]) & (scores[i] != own))
                    if len(at) > k:  # of equal scores the smallest ids
                        at = at[np.lexsort((ids[at], -scores[i][at]))[:k]]
                    places.append(np.full(len(at), i, np.int32))
                    vecs.append(ids[at])
                    values.append(scores[i][at])
                place = np.concatenate(places)
                if not len(place):  # a block with none of any query's best
                    continue
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": [row["block"]] * len(place),
                        "i": place,
                        "query_id": np.asarray(row["q_ids"], np.int64)[place],
                        "vec_id": np.concatenate(vecs),
                        "score": np.concatenate(values),
                    }
                )

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, bins: int = BINS) -> DataFrame:
    """query_id, rank from 1, vec_id, score: each query's ``k`` best candidates.

    Both sides have vec_id and v as of ``integer_vectors``. Ties go to the smaller vec_id.
    A candidate with the query's vec_id is the query itself and left out; vectors of
    another length are no candidates. A query with fewer candidates gets all; an empty side
    gives no rows. vec_id tells rows apart; rows that repeat one with the same vector count
    once, of others each counts.
    """
    blocks_c = stored(candidates.select("vec_id", "v").distinct().mapInArrow(_pack, _BLOCK), "candidates")
    packed = queries.select("vec_id", "v").distinct().mapInArrow(_pack, _BLOCK).toDF(*_QUERIES)
    at = stored(packed.withColumn("block", F.uuid()), "queries")
    # Every score lies within the product of the largest components and the length.
    top_q, dim = at.agg(F.max("q_top"), F.max("q_dim")).first()
    top_c = blocks_c.agg(F.max("top")).first()[0]
    bound = int((top_q or 0) * (top_c or 0) * (dim or 0)) + 1
    width = -(-(2 * bound + 1) // bins)
    at = at.withColumn("low", _each(-bound))
    while True:
        at = stored(at.withColumn("width", _each(width)), "intervals")
        counted = _against(at, blocks_c).mapInArrow(_histograms(k, bins), "block string, i int, bin long, n long")
        counted = counted.groupBy("block", "i", "bin").agg(F.sum("n").alias("n"))
        at = _narrowed(at, counted, k, width)
        if width == 1:
            break
        width = -(-width // bins)
    found = _against(stored(at, "intervals"), blocks_c).mapInArrow(
        _selected(k), "block string, i int, query_id long, vec_id long, score long"
    )
    rank = F.row_number().over(Window.partitionBy("block", "i").orderBy(F.desc("score"), "vec_id"))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _each(value: int):
    """The same number for each query of a block."""
    return F.array_repeat(F.lit(value).cast("long"), F.size("q_ids"))


def _against(at: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each block of queries beside each block of candidates."""
    return at.crossJoin(blocks)


def _narrowed(at: DataFrame, counted: DataFrame, k: int, width: int) -> DataFrame:
    """The blocks of queries with the bin of each k-th best score as the new interval."""
    down = Window.partitionBy("block", "i").orderBy(F.desc("bin"))
    before = F.sum("n").over(down) - F.col("n")
    kth = counted.withColumn("before", before).where(F.col("before") < k)
    kth = kth.groupBy("block", "i").agg(F.min("bin").alias("bin"))
    lows = at.select("block", F.posexplode("low").alias("i", "low")).join(kth, ["block", "i"], "left")
    lows = lows.withColumn("low", F.col("low") + F.coalesce("bin", F.lit(0).cast("long")) * width)
    lows = lows.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("i", "low"))).alias("lows"))
    return at.drop("low").join(lows.select("block", F.col("lows.low").alias("low")), "block")
