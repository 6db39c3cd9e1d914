"""SimHash near-duplicates against brute force over all pairs of fingerprints."""

import re

import numpy as np
import pandas as pd
import pytest
import xxhash

from limitline.llm import queries, simhash_dedup


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    runs = [words[i : i + 3] for i in range(len(words) - 2)] or ([words] if words else [])
    hashes = [xxhash.xxh64_intdigest(b" ".join(run), seed=42) for run in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(prints, distance=3):
    """The smallest print each print is connected with, by all pairs."""
    prints = sorted(set(prints))
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    values = np.array(prints, np.uint64)
    for i, p in enumerate(prints):
        for j in np.flatnonzero(np.bitwise_count(values[:i] ^ values[i]) <= distance):
            a, b = sorted((find(p), find(prints[j])))
            root[b] = a
    return {p: find(p) for p in prints}


def brute_components(ids, prints, distance=3):
    root = brute_roots(prints, distance)
    least = {}
    for d, p in zip(ids, prints, strict=True):
        if d is not None:
            least[root[p]] = min(d, least.get(root[p], d))
    return [least.get(root[p]) for p in prints]


def test_query_equals_brute_force(spark, sf_dir):
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    found = queries.queries()["op12_simhash_near_dedup"](spark, sf_dir).toPandas().set_index("doc_id")
    prints = [brute_fingerprint(t) for t in docs["text"]]
    assert sorted(found.index) == sorted(docs["doc_id"])
    assert found.loc[docs["doc_id"], "fingerprint"].tolist() == [f"{p:016x}" for p in prints]
    want = brute_components(docs["doc_id"].tolist(), prints)
    assert found.loc[docs["doc_id"], "component_id"].tolist() == want
    assert len(set(want)) < len(want)


def test_edges(spark):
    long = " ".join(f"Word{i % 977} x{i % 131}" for i in range(120_000))
    rows = [
        (5, "Alpha beta gamma delta"), (3, "alpha BETA  gamma\tdelta"), (3, "alpha BETA  gamma\tdelta"),
        (9, None), (8, ""), (7, " \n\x0b "), (None, "no id here"), (None, "alpha beta gamma delta"),
        (4, "two Words"), (6, long), (2, "été ÀÉ x y z"), (1, "One"),
    ]
    clash = "print long, node long, root long, first long, component_id long, free long, fixed long"
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6, 7) for r in rows], f"doc_id long, text string, {clash}")
    found = simhash_dedup.simhash_groups(docs).collect()
    ids, prints = [r[0] for r in rows], [brute_fingerprint(r[1]) for r in rows]
    want = zip(ids, (f"{p:016x}" for p in prints), brute_components(ids, prints), strict=True)
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else x for x in r)
    assert sorted(map(tuple, found), key=key) == sorted(want, key=key)
    assert simhash_dedup.simhash_groups(docs.limit(0)).collect() == []


@pytest.mark.parametrize("chunk", [7, 64])
def test_long_texts_in_parts(monkeypatch, chunk):
    """Cuts between words change no fingerprint, wherever they fall."""
    monkeypatch.setattr(simhash_dedup, "TEXT_BYTES", chunk)
    monkeypatch.setattr(simhash_dedup, "COUNT_ROWS", 5)
    for text in ("a", "a b", "a b c", "one  two three " * 9, "averyveryverylongword and another", "x " * 40):
        assert simhash_dedup.fingerprint(text) == brute_fingerprint(text)


def test_variants():
    """Two prints at most three bits apart share a variant, at every level of cutting."""
    rng = np.random.default_rng(3)
    free = [simhash_dedup.ALL_BITS]
    for size in (64, 33, 18, 10):
        assert max(f.bit_count() for f in free) == size
        some = [free[i] for i in rng.integers(len(free), size=20)]
        for f in some:
            bits = [i for i in range(64) if f >> i & 1]
            differ = sum(1 << int(i) for i in rng.choice(bits, 3, replace=False))
            assert any(differ & ~v == 0 for v in simhash_dedup.variants(f))
        free = [v for f in some[:5] for v in simhash_dedup.variants(f)]


@pytest.mark.parametrize("group_rows", [2048, 6, 1])
def test_large_groups_are_cut_and_lose_nothing(spark, group_rows):
    """Balls of prints around a few centres: small limits force the second and third cut."""
    rng = np.random.default_rng(11)
    prints = set(int(x) for x in rng.integers(0, 2**63, 200))
    for centre in list(prints)[:3]:
        ball = [centre]
        for _ in range(80):
            flips = sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False))
            ball.append(ball[rng.integers(len(ball))] ^ flips)
        prints |= set(ball)
    signed = [(p - 2**64 if p >> 63 else p,) for p in prints]
    links = simhash_dedup.near_links(spark.createDataFrame(signed, "print long"), group_rows=group_rows).collect()
    pairs = [(r.a % 2**64, r.b % 2**64) for r in links]
    assert all((a ^ b).bit_count() <= 3 for a, b in pairs)
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert {p: find(p) for p in prints} == brute_roots(prints)


def test_links_grow_with_members_not_pairs(spark):
    """A dense ball: every two of these prints are three bits apart at most, links stay few."""
    base = [1 << i for i in range(40)] + [(1 << i) | (1 << 60) for i in range(40)]
    prints = spark.createDataFrame([(b,) for b in base], "print long")
    links = simhash_dedup.near_links(prints)
    assert links.count() <= 64 * len(base)
    assert "CartesianProduct" not in links._jdf.queryExecution().toString()
