"""Hard negatives against brute force, the curve, the bounds, and how many blocks are read."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from limitline.llm import hard_negatives as hn
from limitline.llm import queries

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, anchors, positives=5, negatives=5):
    """rows and anchors: (vec_id, label, tuple of whole numbers)."""
    rows, found = set(rows), []
    for a, label, v in set(anchors):
        scored = sorted(
            (-sum(int(x) * int(y) for x, y in zip(v, w)), b, other)
            for b, other, w in rows
            if b != a and len(w) == len(v)
        )
        for p, positive, _ in [x for x in scored if x[2] == label][:positives]:
            window = [x for x in scored if x[2] != label and -80 * p <= -100 * x[0] <= -100 * p]
            found += [(a, positive, i, b, -p, -n) for i, (n, b, _) in enumerate(window[:negatives], 1)]
    return sorted(found)


def mined(spark, rows, anchor=lambda r: r[0] % 4 == 0, **kind):
    df = spark.createDataFrame([(a, b, [float(x) for x in v]) for a, b, v in rows], "vec_id long, label long, v array<double>")
    ids = [r[0] for r in rows if anchor(r)]
    found = hn.hard_negatives(df, df.where(F.col("vec_id").isin(ids)), **kind)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, found.collect()))


def test_the_curve_visits_every_cell_once_and_neighbours_in_turn():
    for dims, bits in ((2, 4), (3, 3), (5, 2), (1, 5)):
        cells = np.array(list(itertools.product(range(2**bits), repeat=dims)))
        keys = hn.hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(2 ** (bits * dims)))
        steps = np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1)
        assert (steps == 1).all()


def test_bounds_hold():
    rng = np.random.default_rng(5)
    for scale in (10.0, 1e9, 1e150):
        a, b = (np.floor(rng.normal(size=(n, 8)) * scale) for n in (20, 30))
        upper, lower = hn._bounds(a, b.min(axis=0)[None], b.max(axis=0)[None])
        exact = np.frompyfunc(int, 1, 1)(a) @ np.frompyfunc(int, 1, 1)(b).T
        for i, scores in enumerate(exact):
            assert float(max(scores)) <= upper[i, 0] and float(min(scores)) >= lower[i, 0]


@pytest.mark.parametrize("top", [5.0, 1e9, 1e12])
def test_scores_are_exact(top):
    rng = np.random.default_rng(9)
    a, b = (np.floor(rng.uniform(-top, top, (n, 6))) for n in (4, 7))
    want = np.frompyfunc(int, 1, 1)(a) @ np.frompyfunc(int, 1, 1)(b).T
    clipped = [[max(-hn.LARGEST, min(hn.LARGEST, x)) for x in r] for r in want]
    assert hn.exact_scores(a, b).tolist() == clipped


@pytest.mark.parametrize("block_rows,first", [(256, 4), (7, 1), (1, 2)])
def test_clusters_ties_and_copies(spark, block_rows, first):
    rng = np.random.default_rng(1)
    centres = rng.integers(-40, 40, (4, 6))
    rows = [(i, int(rng.integers(3)), tuple((centres[i % 4] + rng.integers(-6, 6, 6)).tolist())) for i in range(150)]
    rows += [(200 + i, i % 3, rows[0][2]) for i in range(40)]  # one vector very often
    rows += [(300 + i, i % 2, (0,) * 6) for i in range(10)]  # all scores zero
    rows += [rows[3], rows[3], (8, 1, (1, 2, 3, 4, 5, 6)), (8, 0, (9, 9, 9, 9, 9, 9))]  # repeated ids
    rows += [(400 + i, i % 2, (3, i)) for i in range(9)] + [(500, 0, ()), (501, 0, ()), (502, 1, ())]  # other lengths
    want = brute(rows, [r for r in rows if r[0] % 4 == 0])
    assert mined(spark, rows, block_rows=block_rows, first_blocks=first) == want and len(want) > 200


def test_fewer_rows_than_asked_for(spark):
    rows = [(0, 1, (2, 2)), (1, 1, (2, 1)), (2, 2, (2, 1)), (3, 3, (-9, -9)), (4, 4, (1, 1))]
    assert mined(spark, rows) == brute(rows, [rows[0], rows[4]]) == [(0, 1, 1, 2, 6, 6)]
    assert mined(spark, rows[:2]) == []
    assert mined(spark, rows, anchor=lambda r: False) == []
    assert mined(spark, []) == []


def test_large_components(spark):
    """One component of 1e13 takes part; only a returned score beyond 64 bits is an error."""
    rows = [(0, 1, (3, 4)), (1, 1, (10**13, 0)), (2, 2, (10**13 - 1, 0)), (3, 2, (9 * 10**12, 5)), (5, 2, (-(10**15), 1))]
    assert mined(spark, rows) == brute(rows, rows[:1])
    with pytest.raises(Exception, match="64-bit"):
        mined(spark, [(0, 1, (10**13, 0)), (1, 1, (10**13, 1)), (2, 2, (1, 1))])


def test_rows_that_take_no_part(spark):
    clash = "a_block long, block long, run int, i int, w int, rank int, score long, place long, dim int"
    good = [(i, [0.1 * (i % 7), 0.5, -0.01 * i], i % 3) for i in range(30)]
    bad = [
        (40, None, 1), (41, [0.1, None, 0.3], 1), (42, [0.1, math.nan, 0.3], 1), (43, [0.1, math.inf, 0.3], 2),
        (44, [9.0, 9.0, 9.0], None), (None, [9.0, 9.0, 9.0], 1),
    ]
    df = spark.createDataFrame([(*r, *range(9)) for r in good + bad], f"{SCHEMA}, {clash}")
    rows = hn.labelled_vectors(df)
    found = hn.hard_negatives(rows, rows.where("vec_id % 5 = 0"))
    plain = [(i, label, tuple(math.floor(256 * x) for x in v)) for i, v, label in good]
    assert sorted(map(tuple, found.collect())) == brute(plain, [r for r in plain if r[0] % 5 == 0])


def test_zone_maps_leave_blocks_out(spark, monkeypatch):
    """Far apart clusters: an anchor reads the blocks of its own cluster, not all."""
    rng = np.random.default_rng(2)
    centres = np.eye(8, dtype=int) * 1000
    rows = [(i, int(rng.integers(2)), tuple((centres[i % 8] + rng.integers(0, 20, 8)).tolist())) for i in range(1600)]
    asked = []
    original = hn._read

    def read(anchors, picks, blocks, same, k):
        n = picks.select(F.sum(F.size("picks"))).first()[0]
        asked.append((n, blocks.count() * sum(r[0] % 40 == 0 for r in rows)))
        return original(anchors, picks, blocks, same, k)

    monkeypatch.setattr(hn, "_read", read)
    found = mined(spark, rows, anchor=lambda r: r[0] % 40 == 0, block_rows=32)
    assert found == brute(rows, [r for r in rows if r[0] % 40 == 0])
    assert all(n < 0.35 * of for n, of in asked), asked


def test_query_equals_brute_force(spark, sf_dir):
    found = queries.queries()["op11_hard_negatives"](spark, sf_dir)
    rows = []
    for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect():
        label = (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label
        rows.append((r.vec_id, label, tuple(math.floor(256 * x) for x in r.embedding)))
    assert sorted(map(tuple, found.collect())) == brute(rows, [r for r in rows if r[0] % 100 == 0])
