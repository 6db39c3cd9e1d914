"""Hard negatives by inner product, read from Hilbert-ordered blocks that zone maps choose.

Vectors are laid along a Hilbert curve through their components of largest variance and
stored in Parquet as blocks of neighbours; each block carries its zone map, the smallest and
largest value per component, and its labels. For an anchor, interval arithmetic over a
zone map bounds every score in the block from above and below, so only blocks whose
interval meets one of the anchor's windows of scores, and which hold a label in question,
are read.

Positives and negatives are the best rows inside windows: any score of the anchor's own
label, then a window per positive of other labels. Each is found in two readings: the few
blocks of highest bound give the k-th best score so far as a floor, and then every block is
read that could still hold a better one. Scores are exact integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from limitline.llm.storage import new_path, stored

#: Rows of a block, and zone maps that are taken together.
BLOCK_ROWS = 256
#: Blocks of highest bound that the first reading takes for each anchor.
FIRST_BLOCKS = 4
#: Components and bits of each that the curve runs through: 60 bits, a long.
CURVE_DIMS = 12
CURVE_BITS = 5
SCALE = 256

#: Largest score that is told apart; a larger one ends in an error where it is returned.
LARGEST = 2**62

_BLOCK = "ids array<long>, labels array<long>, vectors binary, dim int, low binary, high binary, kinds array<long>"
_BLOCK_SCHEMA = pa.schema(
    [
        ("ids", pa.list_(pa.int64())),
        ("labels", pa.list_(pa.int64())),
        ("vectors", pa.binary()),
        ("dim", pa.int32()),
        ("low", pa.binary()),
        ("high", pa.binary()),
        ("kinds", pa.list_(pa.int64())),
    ]
)
_WINDOW = "i int, w int, high long, floor long, positive_id long"
_FOUND = "a_block long, i int, w int, anchor_id long, positive_id long, positive_score long, vec_id long, score long"


def labelled_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label and v, an array of floor(scale * x); rows that lack one of them,
    or have a component that is null or not finite, take no part."""
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != math.inf))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double"))
    return (
        vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding")
        .where("vec_id is not null and label is not null and embedding is not null")
        .where(usable)
        .select("vec_id", "label", whole.alias("v"))
    )


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of a batch with vectors of one length, and those vectors as a matrix."""
    column = batch.column("v")
    sizes = column.value_lengths().to_numpy()
    values = column.flatten().to_numpy()
    firsts = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dim)
        yield rows, values[firsts[rows][:, None] + np.arange(dim)]


def _spreads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, values in _by_length(batch):
            dim = values.shape[1]
            with np.errstate(over="ignore"):
                yield pa.RecordBatch.from_pydict(
                    {
                        "dim": np.full(dim, dim, np.int32),
                        "at": np.arange(dim, dtype=np.int32),
                        "n": np.full(dim, len(rows), np.int64),
                        "s": values.sum(axis=0),
                        "ss": (values**2).sum(axis=0),
                    }
                )


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of each row of cell numbers (``bits`` bits each).

    The transposed form of Skilling (2004): from the highest bit down, each axis is either
    reflected or exchanged with the first; a Gray code over the axes follows.
    """
    axes = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    for level in range(bits - 1, 0, -1):
        below = (1 << level) - 1
        for i, axis in enumerate(axes):
            upper = (axis >> level & 1) == 1
            exchanged = np.where(upper, 0, (axes[0] ^ axis) & below)
            axes[0] = axes[0] ^ np.where(upper, below, exchanged)
            if i:
                axes[i] = axis ^ exchanged
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    turned = np.zeros_like(axes[-1])
    for level in range(bits - 1, 0, -1):
        turned ^= np.where(axes[-1] >> level & 1 == 1, (1 << level) - 1, 0)
    key = np.zeros_like(turned)
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            key = key << 1 | (axis ^ turned) >> level & 1
    return key


def _keyed(spreads: dict[int, list[tuple[int, float, float]]]):
    """Adds each vector's position on the curve through the widest components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, dims = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int32)
            for rows, values in _by_length(batch):
                dims[rows] = values.shape[1]
                if axes := spreads.get(values.shape[1]):
                    at, low, width = (np.array(x) for x in zip(*axes, strict=True))
                    with np.errstate(all="ignore"):
                        cells = np.nan_to_num((values[:, at] - low) / width * 2**CURVE_BITS)
                    keys[rows] = hilbert_keys(np.clip(cells, 0, 2**CURVE_BITS - 1).astype(np.int64), CURVE_BITS)
            columns = [batch.column(c) for c in ("vec_id", "label", "v")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(dims), pa.array(keys)], names=["vec_id", "label", "v", "dim", "place"]
            )

    return run


def along_the_curve(rows: DataFrame) -> DataFrame:
    """The rows with dim and place, the position of the vector along the Hilbert curve.

    The curve runs through the components of largest variance, two deviations to each
    side of the mean; mean and variance are over all rows, one number per component.
    """
    spread = (
        rows.select("v")
        .mapInArrow(_spreads, "dim int, at int, n long, s double, ss double")
        .groupBy("dim", "at")
        .agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
        .selectExpr("dim", "at", "s / n as mean", "sqrt(greatest(0D, ss / n - (s / n) * (s / n))) as deviation")
    )
    widest = Window.partitionBy("dim").orderBy(F.desc("deviation"), "at")
    axes: dict[int, list] = {}
    for r in spread.withColumn("o", F.row_number().over(widest)).where(F.col("o") <= CURVE_DIMS).collect():
        if 0 < r.deviation < math.inf:  # else the component does not tell places apart
            axes.setdefault(r.dim, []).append((r.at, r.mean - 2 * r.deviation, 4 * r.deviation))
    return rows.mapInArrow(_keyed(axes), "vec_id long, label long, v array<double>, dim int, place long")


def _packed(block_rows: int):
    """Blocks of up to ``block_rows`` successive vectors of one length, rows in order of vec_id."""

    def block(ids: np.ndarray, labels: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(ids, kind="stable")
        row = {
            "ids": ids[order].tolist(),
            "labels": labels[order].tolist(),
            "vectors": values[order].tobytes(),
            "dim": values.shape[1],
            "low": values.min(axis=0).tobytes(),
            "high": values.max(axis=0).tobytes(),
            "kinds": np.unique(labels).tolist(),
        }
        return pa.RecordBatch.from_pylist([row], schema=_BLOCK_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            ids, labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
            for rows, values in _by_length(batch):
                dim, new = values.shape[1], [ids[rows], labels[rows], values]
                if dim in held:
                    new = [np.concatenate(pair) for pair in zip(held[dim], new, strict=True)]
                while len(new[0]) >= block_rows:
                    yield block(*(x[:block_rows] for x in new))
                    new = [x[block_rows:] for x in new]
                held[dim] = new
        for rest in held.values():
            if len(rest[0]):
                yield block(*rest)

    return run


def _in_blocks(placed: DataFrame, name: str, block_rows: int) -> DataFrame:
    """Blocks of neighbours, numbered and stored; ``run`` names the file a block lies in."""
    spark = placed.sparkSession
    ordered = placed.repartitionByRange("dim", "place", "vec_id").sortWithinPartitions("dim", "place", "vec_id")
    blocks = ordered.select("vec_id", "label", "v").mapInArrow(_packed(block_rows), _BLOCK)
    blocks = blocks.withColumn("block", F.monotonically_increasing_id()).withColumn("run", F.spark_partition_id())
    path = new_path(spark, name)
    blocks.write.partitionBy("run").parquet(path)
    return spark.read.schema(f"{_BLOCK}, block long, run int").parquet(path)


def _zone_packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Zone maps of one vector length, up to ``BLOCK_ROWS`` of them in a row."""
    schema = pa.schema(
        [
            ("zones", pa.list_(pa.int64())),
            ("runs", pa.list_(pa.int32())),
            ("zone_dim", pa.int32()),
            ("lows", pa.binary()),
            ("highs", pa.binary()),
            ("zone_kinds", pa.list_(pa.list_(pa.int64()))),
        ]
    )
    held: dict[int, list[dict]] = {}

    def pack(dim: int) -> pa.RecordBatch:
        rows = held.pop(dim)
        row = {
            "zones": [r["block"] for r in rows],
            "runs": [r["run"] for r in rows],
            "zone_dim": dim,
            "lows": b"".join(r["low"] for r in rows),
            "highs": b"".join(r["high"] for r in rows),
            "zone_kinds": [r["kinds"] for r in rows],
        }
        return pa.RecordBatch.from_pylist([row], schema=schema)

    for batch in batches:
        for row in batch.to_pylist():
            held.setdefault(row["dim"], []).append(row)
            if len(held[row["dim"]]) == BLOCK_ROWS:
                yield pack(row["dim"])
    for dim in list(held):
        yield pack(dim)


def _matrix(raw: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(raw).reshape(rows, -1)


def _bounds(vectors: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of each vector's inner products with what lies between ``lows`` and ``highs``."""
    with np.errstate(all="ignore"):
        up, down = np.maximum(vectors, 0), np.minimum(vectors, 0)
        upper = up @ highs.T + down @ lows.T
        lower = up @ lows.T + down @ highs.T
        largest = np.abs(vectors) @ np.maximum(np.abs(lows), np.abs(highs)).T
        # Sums below 2^53 are exact; beyond, allow for rounding.
        slack = np.where(largest < 2.0**53, 0.0, largest * (vectors.shape[1] + 2) * 2.0**-51)
        upper, lower = upper + slack, lower - slack
    return np.where(np.isnan(upper), np.inf, upper), np.where(np.isnan(lower), -np.inf, lower)


def _windows(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """high and floor per anchor and window; a missing window is empty."""
    n, width = len(row["a_ids"]), max((x["w"] for x in row["windows"]), default=0) + 1
    high, floor = np.full((n, width), -LARGEST - 1), np.full((n, width), LARGEST + 1)
    for x in row["windows"]:
        high[x["i"], x["w"]], floor[x["i"], x["w"]] = x["high"], x["floor"]
    return high, floor


def _wanted(row: dict, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which zones can hold rows of an anchor's windows, and the upper bounds."""
    labels = np.asarray(row["a_labels"])
    vectors = _matrix(row["a_vectors"], len(labels))
    upper, lower = _bounds(vectors, _matrix(row["lows"], len(row["zones"])), _matrix(row["highs"], len(row["zones"])))
    high, floor = _windows(row)
    meets = np.zeros(upper.shape, bool)
    for w in range(high.shape[1]):
        meets |= (upper >= floor[:, w, None]) & (lower <= high[:, w, None]) & (floor[:, w] <= high[:, w])[:, None]
    if same:
        holds = np.stack([np.isin(labels, kinds) for kinds in row["zone_kinds"]], axis=1)
    else:
        holds = np.stack([(len(kinds) > 1) | (labels != kinds[0]) for kinds in row["zone_kinds"]], axis=1)
    return meets & holds, upper


def _first_zones(same: bool, n: int):
    """Each anchor's zones of highest bound among those beside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if row["a_dim"] != row["zone_dim"]:
                    continue
                wanted, upper = _wanted(row, same)
                upper = np.where(wanted, upper, -np.inf)
                best = np.argsort(-upper, axis=1, kind="stable")[:, :n]
                kept = np.take_along_axis(wanted, best, axis=1)
                i, zone = np.nonzero(kept)[0], best[kept]
                yield pa.RecordBatch.from_pydict(
                    {
                        "a_block": np.full(len(i), row["a_block"], np.int64),
                        "i": i.astype(np.int32),
                        "block": np.asarray(row["zones"], np.int64)[zone],
                        "run": np.asarray(row["runs"], np.int32)[zone],
                        "upper": upper[i, zone],
                    }
                )

    return run


def _all_zones(same: bool):
    """Each zone that anchors want, and which."""
    schema = pa.schema(
        [("a_block", pa.int64()), ("block", pa.int64()), ("run", pa.int32()), ("picks", pa.list_(pa.int32()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if row["a_dim"] != row["zone_dim"]:
                    continue
                wanted, _ = _wanted(row, same)
                yield pa.RecordBatch.from_pylist(
                    [
                        {
                            "a_block": row["a_block"],
                            "block": row["zones"][z],
                            "run": row["runs"][z],
                            "picks": np.flatnonzero(wanted[:, z]).tolist(),
                        }
                        for z in np.flatnonzero(wanted.any(axis=0)).tolist()
                    ],
                    schema=schema,
                )

    return run


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows; what passes 2^62 is set to that bound."""
    with np.errstate(over="ignore"):
        bound = (np.abs(a).max(initial=0) * np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if bound < 2.0**53:  # every partial sum is exact in doubles
        return (a @ b.T).astype(np.int64)
    if bound < LARGEST and max(np.abs(a).max(), np.abs(b).max()) < LARGEST:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(whole(a) @ whole(b).T, -LARGEST, LARGEST).astype(np.int64)


def _rows_in_windows(same: bool, k: int):
    """The ``k`` best rows of a block in each window of the anchors that read it."""
    out = -LARGEST - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                picks = np.asarray(row["picks"])
                own, labels = np.asarray(row["a_ids"])[picks], np.asarray(row["a_labels"])[picks]
                ids = np.asarray(row["ids"])
                scores = exact_scores(_matrix(row["a_vectors"], len(row["a_ids"]))[picks], _matrix(row["vectors"], len(ids)))
                alike = labels[:, None] == np.asarray(row["labels"])[None, :]
                scores[(alike != same) | (own[:, None] == ids[None, :])] = out
                # Rows lie in order of vec_id, so a stable sort settles ties.
                order = np.argsort(-scores, axis=1, kind="stable")
                scores = np.take_along_axis(scores, order, axis=1)
                place = {int(i): p for p, i in enumerate(picks)}
                found = []
                for x in row["windows"]:
                    if (p := place.get(x["i"])) is None:
                        continue
                    start = int(np.searchsorted(-scores[p], -x["high"]))
                    for s, c in zip(scores[p, start : start + k].tolist(), order[p, start : start + k].tolist()):
                        if s < max(x["floor"], -LARGEST):
                            break
                        if abs(s) >= LARGEST:
                            raise ValueError("a score does not fit 64-bit integers")
                        found.append(
                            (row["a_block"], x["i"], x["w"], int(own[p]), x["positive_id"], x["high"], int(ids[c]), s)
                        )
                if found:
                    names = [c.split()[0] for c in _FOUND.split(", ")]
                    kinds = [pa.int32() if n in ("i", "w") else pa.int64() for n in names]
                    columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _read(anchors: DataFrame, picks: DataFrame, blocks: DataFrame, same: bool, k: int) -> DataFrame:
    """The ``k`` best rows per window in the blocks picked, of all files with such a block."""
    picks = stored(picks, "picks")
    runs = [r.run for r in picks.select("run").distinct().collect()]  # one per file at most
    held = blocks.where(F.col("run").isin(runs)).select("block", "ids", "labels", "vectors")
    found = anchors.join(picks.drop("run"), "a_block").join(held, "block").mapInArrow(_rows_in_windows(same, k), _FOUND)
    best = Window.partitionBy("a_block", "i", "w").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _with_windows(anchors: DataFrame, windows: DataFrame) -> DataFrame:
    """The blocks of anchors with their windows; blocks without any go."""
    names = [c.split()[0] for c in _WINDOW.split(", ")]
    gathered = windows.groupBy("a_block").agg(F.collect_list(F.struct(*names)).alias("windows"))
    return stored(anchors.join(gathered, "a_block"), "windows")


def _best(
    anchors: DataFrame, windows: DataFrame, zones: DataFrame, blocks: DataFrame, same: bool, k: int, first_blocks: int
) -> DataFrame:
    """The ``k`` best rows in every window, with ranks."""
    first = _with_windows(anchors, windows)
    near = first.crossJoin(zones).mapInArrow(
        _first_zones(same, first_blocks), "a_block long, i int, block long, run int, upper double"
    )
    nearest = Window.partitionBy("a_block", "i").orderBy(F.desc("upper"), "block")
    near = near.withColumn("o", F.row_number().over(nearest)).where(F.col("o") <= first_blocks)
    near = near.groupBy("a_block", "block", "run").agg(F.collect_list("i").alias("picks"))
    kth = _read(first, near, blocks, same, k).where(F.col("rank") == k).select("a_block", "i", "w", F.col("score").alias("kth"))
    raised = windows.join(kth, ["a_block", "i", "w"], "left").withColumn("floor", F.greatest("floor", "kth")).drop("kth")
    again = _with_windows(anchors, raised)
    every = again.crossJoin(zones).mapInArrow(_all_zones(same), "a_block long, block long, run int, picks array<int>")
    return _read(again, every, blocks, same, k)


def hard_negatives(
    rows: DataFrame,
    anchors: DataFrame,
    positives: int = 5,
    negatives: int = 5,
    block_rows: int = BLOCK_ROWS,
    first_blocks: int = FIRST_BLOCKS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Both sides have vec_id, label and v as of ``labelled_vectors``; anchors are among the
    rows. An anchor's positives are the rows of its label with the highest scores; a
    positive's negatives are those rows of other labels that score at least 80 % of the
    positive and at most as much, highest first (none, if the positive scores below zero).
    Ties go to the smaller vec_id. Rows with an anchor's vec_id are never its positives or
    negatives, rows with vectors of another length neither; rows that repeat vec_id, label
    and vector count once. Fewer rows than asked for are all returned, an empty table gives
    none. A score beyond 2^62 that would be returned is an error.
    """
    rows = stored(rows.select("vec_id", "label", "v").distinct(), "rows")
    blocks = _in_blocks(along_the_curve(rows), "blocks", block_rows)
    zones = stored(
        blocks.select("block", "run", "dim", "low", "high", "kinds").mapInArrow(
            _zone_packs,
            "zones array<long>, runs array<int>, zone_dim int, lows binary, highs binary, zone_kinds array<array<long>>",
        ),
        "zones",
    )
    chosen = along_the_curve(anchors.select("vec_id", "label", "v").distinct())
    packs = _in_blocks(chosen, "anchors", block_rows).selectExpr(
        "block as a_block", "ids as a_ids", "labels as a_labels", "vectors as a_vectors", "dim as a_dim"
    )
    whole = packs.select("a_block", F.posexplode("a_ids").alias("i", "id")).selectExpr(
        "a_block", "i", "0 as w", f"{LARGEST}L as high", f"-{LARGEST}L as floor", "cast(null as long) as positive_id"
    )
    best = stored(_best(packs, whole, zones, blocks, True, positives, first_blocks), "positives")
    # 80 p <= 100 n: n from p - floor(p / 5) up.
    windows = best.where("score >= 0").selectExpr(
        "a_block", "i", "rank as w", "score as high", "score - score div 5 as floor", "vec_id as positive_id"
    )
    found = _best(packs, windows, zones, blocks, False, negatives, first_blocks)
    return found.select(
        "anchor_id",
        "positive_id",
        F.col("rank").cast("int").alias("rank"),
        F.col("vec_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
