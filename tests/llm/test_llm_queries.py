"""The registered queries on the smallest tables, against SQL, libraries and brute force."""

import hashlib
import math
import tracemalloc
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from limitline.llm import exact_dedup, language_id, near_dedup, queries, substring_dedup, textblocks

TABLES = ("documents", "embeddings", "conversations")


@pytest.fixture(scope="module")
def docs(sf_dir):
    return pd.read_parquet(f"{sf_dir}/documents.parquet")


def run(spark, sf_dir, name):
    return queries.queries()[name](spark, sf_dir).toPandas()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, sf_dir, name):
    found = run(spark, sf_dir, name)
    with duckdb.connect() as db:
        for table in TABLES:
            db.execute(f"create view {table} as select * from read_parquet('{sf_dir}/{table}.parquet')")
        want = db.execute(queries.oracle_sql()[name]).fetchdf()
    assert sorted(found.columns) == sorted(want.columns)
    columns = sorted(found.columns)
    as_rows = lambda df: sorted(map(tuple, df[columns].astype(str).to_numpy()))
    assert as_rows(found) == as_rows(want)


def library_ids(docs, name):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    found = tokenizer.encode_batch(docs["text"].fillna("").tolist(), add_special_tokens=False)
    return {d: np.asarray([*x.ids, 0], "<u4") for d, x in zip(docs["doc_id"], found, strict=True)}


def test_token_files(spark, sf_dir, docs):
    found = run(spark, sf_dir, "op3_token_output").sort_values("doc_id", ignore_index=True)
    ids = library_ids(docs, "byte_bpe_50k.json")
    assert found["doc_id"].tolist() == sorted(ids)
    start = 0
    for row in found.itertuples():
        assert (row.start, row.n_tokens) == (start, len(ids[row.doc_id]))
        assert row.ids_crc32 == zlib.crc32(ids[row.doc_id].tobytes())
        start += row.n_tokens


def packed_right(found, ids, capacity=2048):
    for doc, pieces in found.groupby("doc_id"):
        pieces = pieces.sort_values("piece")
        whole = ids[doc]
        assert pieces["piece"].tolist() == list(range(-(-len(whole) // capacity)))
        for p in pieces.itertuples():
            assert p.start == p.piece * capacity
            assert p.length == min(capacity, len(whole) - p.start)
            assert p.ids_crc32 == zlib.crc32(whole[p.start : p.start + p.length].tobytes())
    assert set(found["doc_id"]) == set(ids)
    for _, bin_ in found.groupby("sequence_id"):
        bin_ = bin_.sort_values("offset")
        assert bin_["offset"].tolist() == [0, *np.cumsum(bin_["length"]).tolist()[:-1]]
        assert bin_["length"].sum() <= capacity
    return found["sequence_id"].nunique()


def test_packing(spark, sf_dir, docs):
    found = run(spark, sf_dir, "op5_best_fit_packing")
    bins = packed_right(found, library_ids(docs, "word_bpe_49k.json"))
    assert bins <= math.ceil(found["length"].sum() / 2048) * 1.02 + 1


def test_byte_bpe(spark, sf_dir, docs):
    found = run(spark, sf_dir, "op10_byte_bpe").set_index("doc_id")
    import base64

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for d, text in zip(docs["doc_id"], docs["text"], strict=True):
        ids = np.asarray(encoding.encode_ordinary(text), "<u4")
        row = found.loc[d]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_language_id_on_held_out(spark, docs):
    found = run(spark, "/root/testdata/sf0.01", "op6_language_id").set_index("doc_id")
    truth = pd.read_parquet("/root/testdata/sf0.01/documents.parquet").set_index("doc_id")["lang"]
    held = [d for d in truth.index if zlib.crc32(str(d).encode()) % 3 == 1]
    assert found.index[found["held_out"]].sort_values().tolist() == sorted(held)
    assert found["score"].between(0, 1).all()
    assert (found.loc[held, "lang_pred"] == truth[held]).mean() > 0.95


def shingles(text, size=5):
    words = text.lower().split()
    if not words:
        return Counter()
    if len(words) < size:
        return Counter([tuple(words)])
    return Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def brute_similarity(a, b):
    total = 0.0
    for d in a.keys() & b.keys():
        total += 1 / sum(max(a[x] / a[d], b[x] / b[d]) for x in a.keys() | b.keys())
    return total


def brute_classes(texts, similarity=0.8):
    """Classes by all pairs that share a run of words."""
    bags = {d: shingles(t) for d, t in texts.items()}
    holders = defaultdict(set)
    for d, bag in bags.items():
        for s in bag:
            holders[s].add(d)
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for d, bag in bags.items():
        for other in set().union(*(holders[s] for s in bag)) if bag else ():
            if other < d and find(d) != find(other) and brute_similarity(bag, bags[other]) >= similarity:
                a, b = sorted((find(d), find(other)))
                root[b] = a
    return {d: find(d) for d in texts}


@pytest.fixture(scope="module")
def classes(docs):
    return brute_classes(dict(zip(docs["doc_id"], docs["text"], strict=True)))


def test_near_duplicates(spark, sf_dir, classes):
    found = run(spark, sf_dir, "op9_minhash_near_dedup")
    assert dict(zip(found["doc_id"], found["class_id"], strict=True)) == classes


def word_runs(text, n):
    words = text.lower().split()
    return {tuple(words[i : i + n]): i for i in range(len(words) - n, -1, -1)}


def test_repeated_passages(spark, sf_dir, docs):
    """Every run of 50 equal words that an earlier document has lies in a passage; passages are real."""
    found = run(spark, sf_dir, "op2_substring_dedup")
    texts = dict(zip(docs["doc_id"], docs["text"], strict=True))
    cut = defaultdict(set)
    for r in found.itertuples():
        assert r.first_id < r.doc_id
        cut[r.doc_id] |= set(range(r.start, r.start + r.n_words))
        a = texts[r.doc_id].lower().split()[r.start : r.start + r.n_words]
        b = texts[r.first_id].lower().split()[r.first_start : r.first_start + r.first_n_words]
        common = sum((Counter(a) & Counter(b)).values())
        assert min(len(a), len(b)) >= 40
        assert r.matches <= common
        assert r.matches >= 0.8 * max(len(a), len(b))
    first = {}
    inside = missed = 0
    for d in sorted(texts):
        for run_, at in word_runs(texts[d], 50).items():
            if first.setdefault(run_, d) != d:
                inside += 1
                missed += len(set(range(at, at + 50)) - cut[d]) > 5
    assert inside and missed <= 0.02 * inside


def test_pipeline(spark, sf_dir, docs):
    """Each stage against its own input."""
    frames = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], sf_dir))
        if name != "packing":
            assert frames[-1].columns == frames[0].columns
            frames[-1] = corpus_pipeline.stored(frames[-1], name)
    told, exact, near, cut, packed = (f.toPandas() for f in frames[1:])
    assert set(told["doc_id"]) == {d for d, t in zip(docs["doc_id"], docs["text"]) if any(map(str.isalpha, t))}
    best = told.groupby("text")["doc_id"].max()
    assert sorted(exact["doc_id"]) == sorted(best)
    want = brute_classes(dict(zip(exact["doc_id"], exact["text"], strict=True)))
    assert sorted(near["doc_id"]) == sorted(d for d, root in want.items() if d == root)
    after = dict(zip(cut["doc_id"], cut["text"], strict=True))
    runs = {}
    for d in sorted(after):
        for run_ in word_runs(after[d], 60):
            assert runs.setdefault(run_, d) == d
    assert (cut["n_chars"] == cut["text"].str.len()).all()
    assert packed_right(packed, library_ids(cut, "word_bpe_49k.json"))


def test_run_equals_its_stages(spark, sf_dir):
    first, second = (corpus_pipeline.run(spark, sf_dir).toPandas() for _ in range(2))
    key = ["doc_id", "piece", "length", "ids_crc32"]
    assert sorted(map(tuple, first[key].to_numpy())) == sorted(map(tuple, second[key].to_numpy()))


def test_hashes_of_spans_and_runs():
    """As defined, over borders of the rows that totals are taken in, and with little memory a byte."""
    multiplier, mask = 0x9E3779B97F4A7C15, (1 << 64) - 1
    text = " ".join("w" * n for n in (1, 5, 4090, 4096, 9000, 3)) + " é ü"
    data, offsets = textblocks.flat(pa.array([text, "", "a b " * 50]))
    starts, ends, firsts = textblocks.words(data, offsets)
    want = [
        sum((x + 1) * pow(multiplier, k, 1 << 64) for k, x in enumerate(data[s:e].tolist())) & mask ^ (e - s) << 48
        for s, e in zip(starts.tolist(), ends.tolist())
    ]
    hashes = textblocks.span_hashes(data, starts, ends)
    assert (hashes == textblocks.mixed(np.array(want, np.uint64))).all()
    for size in (1, 5, 40, 41):
        runs, at = textblocks.shingle_hashes(hashes, firsts, size)
        inside = [a for x, y in zip(firsts.tolist(), firsts[1:].tolist()) for a in range(x, y - size + 1)]
        assert at.tolist() == inside
        sums = [sum(h * pow(multiplier, size - 1 - k, 1 << 64) for k, h in enumerate(hashes[a : a + size].tolist())) & mask for a in inside]
        assert (runs == textblocks.mixed(np.array(sums, np.uint64))).all()
    data, offsets = textblocks.flat(pa.array(["some words of text " * 50_000]))
    starts, ends, _ = textblocks.words(data, offsets)
    tracemalloc.start()
    textblocks.span_hashes(data, starts, ends)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak <= 23 * len(data)  # 27 with an index for each byte
