"""Near duplicates that hubs leave: no pair is lost, and templates do not pair everything."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from limitline.llm import near_dedup


def pairs_of(spark, texts, similarity=0.8):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = docs.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("class"), F.array(F.lit(0).cast("long")).alias("sketch"))
    return {(r.a, r.b) for r in near_dedup._alike(left, docs, similarity, 1, 99).collect()}


def similar(texts, similarity=0.8):
    keys, weights, firsts = near_dedup.weighted_shingles(pa.array(texts))
    bags = [(keys[a:b], weights[a:b]) for a, b in zip(firsts, firsts[1:])]
    return {
        (i, j) for i, j in combinations(range(len(texts)), 2)
        if near_dedup.probability_jaccard(*bags[i], *bags[j]) >= similarity
    }


@pytest.mark.parametrize("similarity", [0.8, 0.6])
def test_no_pair_is_lost(spark, similarity):
    """Families of edited texts, some with repeated runs, some repeated as a whole."""
    rng = random.Random(6)
    texts = []
    for family in range(12):
        base = [f"f{family}w{rng.randrange(40) if family % 3 == 2 else i}" for i in range(rng.randrange(20, 120))]
        for k in range(9):
            words = list(base)
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(30)}"
            if family % 2 and k % 3 == 0:
                words += words[: rng.randrange(5, len(words))] * rng.randrange(1, 3)
            if k == 8:
                words = words * 2
            texts.append(" ".join(words))
    want = similar(texts, similarity)
    assert len(want) > 80 and want <= pairs_of(spark, texts, similarity)


@pytest.mark.parametrize("repeats", [1, 3])
def test_pairs_of_a_template_grow_with_its_texts(spark, repeats):
    """Texts on one template share 0.78; each says one run of words three times. Planted copies are found."""
    stock = "stock words said once more"
    parts = [" ".join(f"t{i}" for i in range(a, a + 51)) for a in (0, 51, 102)]
    template = " ".join(f"{part} {stock if i < repeats else f'other{i} words to say here'}" for i, part in enumerate(parts))

    def made(n):
        texts = [f"{template} " + " ".join(f"o{i}x{j}" for j in range(24)) for i in range(n)]
        return texts + [t + " end" for t in texts[: n // 20]]

    few, many = (pairs_of(spark, made(n)) for n in (400, 800))
    for n, found in ((400, few), (800, many)):
        assert {(i, n + i) for i in range(n // 20)} <= found
    assert len(few) <= 4 * 20 and len(many) <= 2.5 * len(few)


def test_a_text_meets_one_hub_in_the_first_round(spark):
    rows = [(b, size, node, 9, node) for node in range(30) for b, size in ((1, 30), (2 + node % 3, 10))]
    left = spark.createDataFrame(rows, "bucket long, size long, node long, degree long, class long")
    left = left.withColumn("sketch", F.array(F.lit(0).cast("long")))
    places = near_dedup._largest_places(left)
    assert {(r.bucket, r.node) for r in places.collect()} == {(1, n) for n in range(30)}
    pairs = near_dedup._beside(places, near_dedup._hubs(left, 1), 1, 5)
    assert pairs.count() == 29


def test_a_text_of_a_template_meets_few_hubs_a_round(spark, monkeypatch):
    """Texts just below the threshold share many buckets, each with hubs of its own."""
    template = [f"t{i}" for i in range(177)]
    texts = [" ".join(template + [f"own{i}x{j}" for j in range(23)]) for i in range(300)]
    met, beside = [], near_dedup._beside

    def counted(*args):
        pairs = beside(*args)
        met.append(pairs.count())
        return pairs

    monkeypatch.setattr(near_dedup, "_beside", counted)
    found = near_dedup.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert found.where("doc_id <> class_id").count() == 0
    assert len(met) > 1 and max(met) <= near_dedup.LATER_HUBS * len(texts)


def test_texts_read_grow_with_a_family(spark, monkeypatch):
    """Copies of one text with a few words changed, most pairs just below the threshold: classes settle what few pairs tell."""
    rng = random.Random(4)
    base, texts = [f"w{i}" for i in range(150)], []
    for i in range(300):
        words = list(base)
        for k in range(rng.randrange(1, 7)):
            words[rng.randrange(len(words))] = f"new{i}x{k}"
        texts.append(" ".join(words))
    read, links = [], near_dedup._links

    def counted(pairs, *args):
        read.append(pairs.count())
        return links(pairs, *args)

    monkeypatch.setattr(near_dedup, "_links", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in near_dedup.near_groups(docs).collect()}
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in similar(texts):
        low, high = sorted((top(a), top(b)))
        root[high] = low
    assert found == {i: top(i) for i in range(len(texts))}
    assert len(read) == 4 and sum(read[2:]) <= 2 * len(texts)  # after the rounds with hubs


def test_pairs_met_grow_with_a_large_family(spark, monkeypatch):
    """As above with more texts: those near to many settle most classes before all texts meet."""
    rng = random.Random(4)
    base, texts = [f"w{i}" for i in range(150)], []
    for i in range(1200):
        words = list(base)
        for k in range(rng.randrange(1, 7)):
            words[rng.randrange(len(words))] = f"new{i}x{k}"
        texts.append(" ".join(words))
    met, sharing = [], near_dedup._sharing

    def counted(*args):
        pairs = sharing(*args)
        met.append(pairs.count())
        return pairs

    monkeypatch.setattr(near_dedup, "_sharing", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in near_dedup.near_groups(docs).collect()}
    runs = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in map(str.split, texts)]
    ours = sorted({tuple(base[i : i + 5]) for i in range(len(base) - 4)})  # other runs are of one text alone
    held = np.array([[r in own for r in ours] for own in runs]).astype(int)
    both, size = held @ held.T, np.array([len(own) for own in runs])
    near = both >= near_dedup.SIMILARITY * (size[:, None] + size - both) - 1e-9
    np.fill_diagonal(near, True)
    want = np.arange(len(texts))
    while (least := np.where(near, want, len(texts)).min(1)).tolist() != want.tolist():
        want = least
    assert found == dict(enumerate(want.tolist()))
    assert sum(met) <= 5 * len(texts)


def test_crowded_buckets_and_others(spark):
    """Bucket 1 and 2 hold 30 classes, bucket 3 and 4 hold two; every text is in 1, 2 and one of the others."""
    rows = [(b, 30, node, 9, node) for node in range(30) for b in (1, 2)]
    rows += [(3 + (node > 1), 2, node, 9, node) for node in range(4)]
    left = spark.createDataFrame(rows, "bucket long, size long, node long, degree long, class long")
    left = left.withColumn("sketch", F.array(F.lit(0).cast("long")))
    crowded = near_dedup._crowded(left, 8)
    assert {r.bucket for r in crowded.collect()} == {1, 2}
    places = {(r.bucket, r.node) for r in near_dedup._later_places(left, crowded).collect()}
    assert places == {(2, n) for n in range(30)} | {(3, 0), (3, 1), (4, 2), (4, 3)}


def test_bound_on_random_weights():
    """The bound behind the asking rule: common weight against both totals."""
    rng = np.random.default_rng(3)
    for _ in range(400):
        n = int(rng.integers(3, 12))
        a, b = (rng.integers(0, 4, n) * (rng.random(n) < 0.8) for _ in range(2))
        if not (a.any() and b.any()):
            continue
        ka, kb = np.flatnonzero(a), np.flatnonzero(b)
        exact = near_dedup.probability_jaccard(ka.astype(np.uint64), a[ka], kb.astype(np.uint64), b[kb])
        both = (a > 0) & (b > 0)
        ca, cb = a[both].sum(), b[both].sum()
        again_a, again_b = ca - both.sum(), cb - both.sum()
        assert exact <= min(ca / a.sum(), cb / b.sum()) + 1e-9
        assert exact <= min(ca + again_b, cb + again_a) / (a.sum() + b.sum() - min(ca, cb)) + 1e-9
