"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing extra columns."""

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import pytest

import corpus_pipeline
from limitline.llm import (
    byte_bpe,
    chat_format,
    components,
    exact_dedup,
    html_text,
    language_id,
    near_dedup,
    packing,
    pieces,
    substring_dedup,
    textblocks,
    token_files,
    top_k,
)

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD = public_tokenizers.path("word_bpe_49k.json")

LONG = " ".join(f"word{i % 977}x{i % 131}" for i in range(120_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog.", "en", "a", 3),
    (2, None, "en", None, None),
    (3, "", None, "a", 0),
    (4, "The quick brown fox jumps over the lazy dog.", "en", "b", 44),
    (4, "The quick brown fox jumps over the lazy dog.", "en", "b", 44),
    (None, "No id here, only some words to read.", "en", "c", 1),
    (5, LONG, "en", "d", len(LONG)),
    (6, "   \n\t ", "de", "d", 6),
    (7, "été où ça 日本語   　 ' 's 'll 12 !!", "fr", "e", 1),
    (8, "1234 !!! 5678", None, "e", 1),
]
CLASHING = "ids array<int>, sha string, bucket long, node long, root int, bin int, lang_pred string, __cuts int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, [1], "x", 2, 3, 4, 5, "zz", 6) for r in ROWS]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def pandas(df):
    return df.toPandas()


def test_exact_groups(docs, none):
    found = pandas(exact_dedup.exact_groups(docs))
    assert len(found) == len(ROWS)
    by = {(None if pd.isna(r.doc_id) else int(r.doc_id)): r for r in found.itertuples()}
    assert (by[1].keep_id, by[1].group_size, by[1].kept) == (4, 3, False)
    assert by[4].kept and (by[2].keep_id, by[3].kept) == (3, True)
    assert by[5].text_sha256 == hashlib.sha256(LONG.encode()).hexdigest()
    assert by[None].kept and by[None].group_size == 1
    assert pandas(exact_dedup.exact_groups(none)).empty


def test_chunks_that_share_a_hash_are_told_apart(spark):
    """With hashes of four bits almost all chunks clash."""
    texts = [f"text number {i % 30} " * (40 + i % 30) for i in range(90)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pandas(exact_dedup.exact_groups(docs, hash_bits=4))
    for r in found.itertuples():
        same = [i for i, t in enumerate(texts) if t == texts[r.doc_id]]
        assert (r.keep_id, r.group_size) == (max(same), len(same))


def test_chunks_do_not_depend_on_what_stands_before():
    texts = [LONG[:50_000], "short", "", LONG[1000:60_000], LONG[:50_000]]
    data, offsets = textblocks.flat(pa.array(texts))
    starts, ends, firsts = exact_dedup.cut_points(data, offsets)
    cut = [[data[a:b].tobytes() for a, b in zip(starts[i:j], ends[i:j])] for i, j in zip(firsts, firsts[1:])]
    assert [b"".join(c).decode() for c in cut] == texts
    assert cut[0] == cut[4] and len(set(cut[0]) & set(cut[3])) > 10
    assert max(map(len, cut[0])) <= exact_dedup.LONGEST


def test_token_files(spark, docs, none):
    for kind in token_files.PLANES:
        index = token_files.write_token_files(docs, JSON, kind=kind, block_ids=1000)
        found = pandas(token_files.read_token_files(index)).sort_values("start", ignore_index=True)
        assert len(found) == len(ROWS)
        assert found["start"].tolist() == [0, *np.cumsum(found["n_tokens"])[:-1]]
        assert pd.isna(found["doc_id"][0]) and found["doc_id"][1:].is_monotonic_increasing
        assert found.set_index("doc_id").loc[3, "ids_crc32"] == zlib.crc32(b"\0\0\0\0")
    assert pandas(token_files.read_token_files(token_files.write_token_files(none, JSON))).empty


@pytest.mark.parametrize("kind", sorted(token_files.PLANES))
@pytest.mark.parametrize("n", [1, 7, 8, 1000])
def test_planes_round_trip(kind, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
    planes, bits = token_files.PLANES[kind]
    made = token_files.to_planes(ids, kind)
    assert len(made) == planes
    assert (token_files.from_planes(made, n, bits) == ids).all()


def test_packing(docs, none):
    found = pandas(packing.pack_documents(docs, WORD))
    assert found["length"].min() >= 1
    for _, pieces in found.groupby("sequence_id"):
        pieces = pieces.sort_values("offset")
        assert pieces["length"].sum() <= 2048
        assert pieces["offset"].tolist() == [0, *np.cumsum(pieces["length"])[:-1]]
    assert (found["doc_id"] == 4).sum() == 2 and found["doc_id"].isna().sum() == 1
    assert pandas(packing.pack_documents(none, WORD)).empty


def test_packing_goes_up_the_tree(spark):
    """Forty partitions with one short document each end in one sequence."""
    docs = spark.range(40).selectExpr("id as doc_id", "'some few words' as text").repartition(40)
    found = pandas(packing.pack_documents(docs, WORD))
    assert len(found) == 40 and found["sequence_id"].nunique() == 1
    assert sorted(found["offset"]) == [i * found["length"][0] for i in range(40)]


def test_best_fit_takes_the_fullest_bin():
    bins, places, fills = packing.best_fit(np.asarray([6, 5, 4, 3, 2]), 10)
    assert fills.tolist() == [10, 10] and bins.tolist() == [0, 1, 0, 1, 1] and places.tolist() == [0, 0, 6, 5, 8]


def one_by_one(lengths, capacity):
    """Fills of best fit, longest first, with a plain list of bins."""
    fills = []
    for size in sorted(lengths.tolist(), reverse=True):
        held = [i for i, fill in enumerate(fills) if fill + size <= capacity]
        if held:
            fills[max(held, key=lambda i: fills[i])] += size
        else:
            fills.append(size)
    return sorted(fills)


def test_runs_of_equal_pieces_are_best_fit():
    rng = np.random.default_rng(5)
    for case in range(60):
        capacity = int(rng.integers(1, 60))
        lengths = rng.integers(1, 1 + int(rng.integers(1, capacity + 1)), int(rng.integers(1, 400)))
        bins, places, fills = packing.best_fit(lengths, capacity)
        assert sorted(fills.tolist()) == one_by_one(lengths, capacity)
        for b in range(len(fills)):
            mine = np.flatnonzero(bins == b)
            mine = mine[np.argsort(places[mine])]
            assert places[mine].tolist() == [0, *np.cumsum(lengths[mine])[:-1]]
    counts = np.concatenate(([0], rng.integers(0, 10**9, 2048)))
    assert len(packing.bin_runs(counts, 2048)) < 30 * 2048


def test_packing_closes_no_sequence_early(spark):
    """In each of two partitions 200 sequences that only documents of the other one fill."""
    long, short = "a " * 12, "b " * 7
    docs = spark.range(0, 400, 1, 2).selectExpr(
        "id as doc_id", f"if(id < 200, '{long.strip()}', '{short.strip()}') as text"
    )
    found = pandas(packing.pack_documents(docs, WORD, capacity=21))
    assert set(found["length"]) == {13, 8}
    assert found["sequence_id"].nunique() == 200
    assert (found.groupby("sequence_id")["length"].sum() == 21).all()


def test_byte_bpe(docs, none):
    decoded = pandas(byte_bpe.decode(byte_bpe.encode(docs, RANKS), RANKS))
    assert sorted(bytes(x) for x in decoded["decoded"]) == sorted((r[1] or "").encode() for r in ROWS)
    for r in decoded.itertuples():
        ends = np.frombuffer(r.ends, "<u4")
        assert len(ends) * 4 == len(r.ids) and (not len(ends) or ends[-1] == len(r.decoded))
    assert pandas(byte_bpe.encode(none, RANKS)).empty


def test_language_id(docs, none):
    rows = language_id.training_rows(docs)
    model = language_id.train(language_id.sample(rows))
    found = pandas(language_id.predict(docs, model, keep=["doc_id", "lang"]))
    assert len(found) == len(ROWS)
    by = {r.doc_id: r for r in found.itertuples()}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (2, 3, 6, 8))
    assert by[5].lang_pred == "en" and by[5].score > 0.9
    nothing = language_id.train(language_id.sample(none))
    assert set(pandas(language_id.predict(docs, nothing))["lang_pred"]) == {"und"}
    assert pandas(language_id.predict(none, model)).empty


def test_code_lengths_are_a_distribution(spark):
    rows = spark.createDataFrame([("a", "abracadabra alakazam"), ("b", "banana bandana")], "lang string, text string")
    model = language_id.train(rows, order=3)
    for context in ("", "a", "ab", "zz", "ana", "na "):
        texts = [context.encode() + bytes([i]) for i in range(256)]
        data = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.arange(257) * len(texts[0])
        bits = language_id.code_lengths(model, data, offsets)
        head = np.frombuffer(context.encode(), np.uint8)
        if len(head):
            bits = bits - language_id.code_lengths(model, head, np.asarray([0, len(head)]))
        assert np.allclose((2.0**-bits).sum(0), 1, atol=1e-4)


def test_near_groups(docs, none):
    found = pandas(near_dedup.near_groups(docs))
    assert len(found) == len(ROWS)
    by = {(None if pd.isna(r.doc_id) else int(r.doc_id)): r.class_id for r in found.itertuples()}
    assert by[1] == by[4] == 1 and by[2] == by[3] == 2 and by[6] == 6 and by[5] == 5
    assert pd.isna(by[None])
    assert pandas(near_dedup.near_groups(none)).empty


def test_large_family_of_near_copies(spark):
    """Copies of one text with a word changed each are one class; others stay out."""
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*base[: i % 110], f"new{i}", *base[i % 110 + 1 :]])) for i in range(300)]
    rows += [(1000 + i, " ".join(f"z{i}q{j}" for j in range(60))) for i in range(20)]
    found = pandas(near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")))
    assert found.loc[found["doc_id"] < 1000, "class_id"].unique().tolist() == [0]
    assert (found.loc[found["doc_id"] >= 1000, "class_id"] == found.loc[found["doc_id"] >= 1000, "doc_id"]).all()


def test_pairs_inside_a_template(spark):
    """Texts on one template are just below the threshold, in shared buckets; a few have a real copy among them."""
    template = [f"t{i}" for i in range(177)]
    n, planted = 500, 10
    tails = [[f"own{i}x{j}" for j in range(23)] for i in range(n)]  # similarity 0.79
    for k in range(planted):  # and 0.806
        tails[n - 1 - k] = [*tails[100 + 3 * k][:2], *tails[n - 1 - k][2:]]
    texts = [" ".join(template + tail) for tail in tails]
    found = pandas(near_dedup.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    want = {n - 1 - k: 100 + 3 * k for k in range(planted)}
    assert dict(zip(found["doc_id"], found["class_id"])) == {i: want.get(i, i) for i in range(n)}


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(5)
    a = {int(k): int(w) for k, w in zip(rng.integers(0, 2**63, 300), rng.integers(1, 9, 300), strict=True)}
    b = dict(list(a.items())[60:]) | {int(k): 3 for k in rng.integers(0, 2**63, 40)}
    bags = []
    for bag in (a, b):
        keys = np.asarray(sorted(bag), np.uint64)
        bags.append((keys, np.asarray([bag[int(k)] for k in keys])))
    keys = np.concatenate([x for x, _ in bags])
    weights = np.concatenate([x for _, x in bags])
    holders = near_dedup.signatures(keys, weights, np.asarray([0, len(a), len(a) + len(b)]), 1500)
    exact = near_dedup.probability_jaccard(*bags[0], *bags[1])
    brute = sum(
        1 / sum(max(a.get(x, 0) / a[d], b.get(x, 0) / b[d]) for x in a.keys() | b.keys()) for d in a.keys() & b.keys()
    )
    assert exact == pytest.approx(brute)
    assert (holders[0] == holders[1]).mean() == pytest.approx(exact, abs=0.05)


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 105), (105, 103), (7, 7)]
    found = pandas(components.components(spark.createDataFrame(links, "a long, b long")))
    assert dict(zip(found["node"], found["root"])) == {i: 0 for i in range(41)} | {100: 100, 103: 100, 105: 100}


def test_repeated_passages(spark, docs, none):
    assert pandas(substring_dedup.repeated_passages(docs)).empty
    assert pandas(substring_dedup.repeated_passages(none)).empty
    shared = [f"s{i}" for i in range(60)]
    edited = [*shared[:20], "changed", *shared[21:40], "put", "in", *shared[40:]]
    texts = {
        1: [f"a{i}" for i in range(30)] + shared + [f"b{i}" for i in range(30)],
        2: [f"c{i}" for i in range(10)] + shared,
        3: edited + [f"d{i}" for i in range(50)],
        4: [f"e{i}" for i in range(80)] + shared[:15],
    }
    frame = spark.createDataFrame([(d, " ".join(t)) for d, t in texts.items()], "doc_id long, text string")
    found = {r.doc_id: r for r in pandas(substring_dedup.repeated_passages(frame)).itertuples()}
    assert sorted(found) == [2, 3]
    assert (found[2].first_id, found[2].start, found[2].n_words, found[2].first_start) == (1, 10, 60, 30)
    assert (found[3].start, found[3].n_words, found[3].first_n_words, found[3].matches) == (0, 62, 60, 59)
    cut = substring_dedup.without_passages(frame, substring_dedup.repeated_passages(frame))
    left = dict(pandas(cut).itertuples(index=False, name=None))
    assert left[1] == " ".join(texts[1]) and left[2] == " ".join(texts[2][:10])
    assert left[3] == " " + " ".join(texts[3][62:]) and left[4] == " ".join(texts[4])


def missed_runs(texts, found, n=50):
    """Runs of ``n`` words that an earlier document has and that lie in no passage."""
    cut = {(r.doc_id, i) for r in found.itertuples() for i in range(r.start, r.start + r.n_words)}
    first, missed, shared = {}, 0, 0
    for d in sorted(texts):
        for at in range(len(texts[d]) - n + 1):
            if first.setdefault(tuple(texts[d][at : at + n]), d) != d:
                shared += 1
                # What stays is too short to be shared again.
                missed += sum((d, i) not in cut for i in range(at, at + n)) > 10
    assert shared
    return missed


def test_passages_of_frequent_lines(spark):
    """Lines that earlier documents have one by one, in passages that only one earlier document has."""
    rng = np.random.default_rng(11)
    fresh = (f"f{i}" for i in range(10**6))
    some = lambda n: [next(fresh) for _ in range(n)]
    texts, pairs = {}, []
    for words_, of in ((20, 3), (10, 6), (30, 2), (30, 3)):
        lines = [some(words_) for _ in range(60)]
        for line in lines:
            texts[len(texts)] = [*some(30), *line, *some(30)]
        for _ in range(25):
            chosen = rng.choice(60, of, replace=False)
            pairs.append([w for i in chosen for w in lines[i]])
    for passage in pairs:
        texts[len(texts)] = [*some(30), *passage, *some(30)]
    for passage in pairs:
        texts[len(texts)] = [*some(45), *passage, *some(15)]
    frame = spark.createDataFrame([(d, " ".join(t)) for d, t in texts.items()], "doc_id long, text string")
    found = pandas(substring_dedup.repeated_passages(frame))
    assert missed_runs(texts, found) == 0
    assert len(found) <= 3 * len(pairs)


@pytest.mark.parametrize("every", [45, 30, 20])
def test_fuzzy_passages_of_frequent_lines(spark, every):
    """Each line has an earlier holder of its own; a word in ``every`` differs between the two documents."""
    rng = np.random.default_rng(every)
    fresh = (f"f{i}" for i in range(10**6))
    some = lambda n: [next(fresh) for _ in range(n)]
    lines = [some(20) for _ in range(80)]
    texts = {i: [*some(30), *line, *some(30)] for i, line in enumerate(lines)}
    for n in range(100):
        passage = [w for i in rng.choice(80, 5, replace=False) for w in lines[i]]
        texts[1000 + n] = [*some(30), *passage, *some(30)]
        at = int(rng.integers(every))
        other = [next(fresh) if i % every == at else w for i, w in enumerate(passage)]
        texts[2000 + n] = [*some(45), *other, *some(15)]
    frame = spark.createDataFrame([(d, " ".join(t)) for d, t in texts.items()], "doc_id long, text string")
    found = pandas(substring_dedup.repeated_passages(frame))
    pairs = {(r.first_id, r.doc_id) for r in found.itertuples()}
    assert sum((1000 + n, 2000 + n) in pairs for n in range(100)) >= {45: 90, 30: 90, 20: 85}[every]


def test_passages_read_no_seed_of_one_document_alone(spark):
    """The seeds of all documents are exchanged while they are counted, not for each kind of match."""
    same = " ".join(f"s{i}" for i in range(60))
    texts = [f"{same} " + " ".join(f"d{n}w{i}" for i in range(50)) for n in range(3)]
    found = substring_dedup.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {(r.doc_id, r.first_id, r.start, r.n_words) for r in found.collect()} == {(1, 0, 0, 60), (2, 0, 0, 60)}
    files = found.inputFiles()
    assert files and not any("limitline-seeds-" in f for f in files)


def test_passages_held_twice(spark):
    fresh = (f"f{i}" for i in range(10**6))
    some = lambda n: [next(fresh) for _ in range(n)]
    texts = {}
    for i in range(40):
        passage = some(60)
        texts[i] = [*some(20), *passage, *some(20)]
        stray = passage[i : i + 9] if i % 2 else []
        texts[100 + i] = [*stray, *some(20), *passage, *some(3 * i), *passage, *some(20)]
    texts[200] = texts[201] = ["again"] * 170
    frame = spark.createDataFrame([(d, " ".join(t)) for d, t in texts.items()], "doc_id long, text string")
    found = pandas(substring_dedup.repeated_passages(frame))
    assert missed_runs(texts, found) == 0


def test_chains_rise_in_both_and_take_the_best():
    pos = np.asarray([0, 10, 20, 30, 40, 50, 60])
    other = np.asarray([0, 10, 500, 30, 40, 3, 60])
    best = substring_dedup.chains(pos, other)[0]
    assert other[best].tolist() == [0, 10, 30, 40, 60]


def test_plain_chains_are_those_of_the_tree():
    rng = np.random.default_rng(3)
    at_once = 0
    for _ in range(400):
        n = int(rng.integers(1, 12))
        step = int(rng.choice([12, 40, 120]))
        pos, other = (np.cumsum(rng.integers(1, step, n)) for _ in range(2))
        if rng.random() < 0.2:
            rng.shuffle(other)
        one, two = (substring_dedup.chains(pos, other, plain=p) for p in (True, False))
        assert [c.tolist() for c in one] == [c.tolist() for c in two]
        at_once += len(one) == 1
    assert 50 < at_once < 350


def test_cut_words():
    assert substring_dedup.cut_words("  a b\nc d ", [(1, 3)]) == "  a d "
    assert substring_dedup.cut_words("é ü", [(0, 9)]) == ""
    assert substring_dedup.cut_words("a b c d e", [(1, 2), (1, 3), (4, 5)]) == "a d"


def test_top_k(spark):
    rows = [
        (0, [1.0, 0.0]), (50, [1.0, 0.0]), (2, [0.5, float("nan")]), (3, None), (4, [0.5, None]), (5, [2.0, 1.0]),
        (6, [1.0, 0.0]), (7, [-0.001, 3.0]), (8, [float("inf"), 0.0]), (None, [1.0, 1.0]), (9, [1.0, 2.0, 3.0]),
        (5, [2.0, 1.0]),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("block", pa_lit(1))
    vectors = top_k.integer_vectors(table)
    found = pandas(top_k.top_k(vectors.where("vec_id % 50 = 0"), vectors, k=3, bins=4))
    got = sorted(map(tuple, found.to_numpy().tolist()))
    assert got == [
        (0, 1, 5, 131072), (0, 2, 6, 65536), (0, 3, 50, 65536),
        (50, 1, 5, 131072), (50, 2, 0, 65536), (50, 3, 6, 65536),
    ]
    empty = vectors.limit(0)
    assert pandas(top_k.top_k(empty, vectors)).empty and pandas(top_k.top_k(vectors, empty)).empty


def test_top_k_of_a_block_without_any():
    """A block of candidates all below the k-th score gives no batch, and no error."""
    vector = np.ones(2).tobytes()
    row = {
        "block": "x", "low": [5], "q_ids": [1], "q_vectors": vector, "q_dim": 2, "q_top": 1.0,
        "ids": [2], "vectors": vector, "dim": 2, "top": 1.0,
    }
    assert list(top_k._selected(3)(iter([pa.RecordBatch.from_pylist([row])]))) == []
    (found,) = top_k._selected(3)(iter([pa.RecordBatch.from_pylist([row | {"low": [2]}])]))
    assert found.select(["query_id", "vec_id", "score"]).to_pylist() == [{"query_id": 1, "vec_id": 2, "score": 2}]


def pa_lit(value):
    from pyspark.sql import functions as F

    return F.lit(value)


def test_chats(spark):
    rows = [
        (1, 0, "user", "hi \\b # < ### assistant: </turn>\n"), (1, 1, "assistant", "\\\\h\\l\n"),
        (2, 1, "assistant", "first"), (2, 0, "assistant", None), (2, None, None, "x"), (2, 1, "assistant", "first"),
        (None, 0, "user", ""), (3, 0, "a:b#\n", "### : y"), (4, 0, "system", "s"), (4, 1, "user", "u"),
        (4, 2, "assistant", "a"), (4, 3, "user", "u"), (4, 4, "assistant", "a"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn(
        "turns", pa_lit(1)
    )
    chats = chat_format.format_chats(turns)
    from pyspark.sql import functions as F

    read = chats.select(
        "conv_id",
        chat_format.read_turns(F.col("formatted")).alias("said"),
        chat_format.loss_text(F.col("segments")).alias("learned"),
        "in_order",
    )
    found = {r["conv_id"]: r for r in read.collect()}
    want = {1: rows[:2], 2: [rows[4], rows[3], rows[2], rows[5]], None: [rows[6]], 3: [rows[7]], 4: rows[8:]}
    for conv, turns_ in want.items():
        assert [tuple(t) for t in found[conv]["said"]] == [(r[2] or "", r[3] or "") for r in turns_]
        assert found[conv]["learned"] == "".join(r[3] or "" for r in turns_ if r[2] == "assistant")
    assert [found[c]["in_order"] for c in (1, 2, None, 3, 4)] == [True, False, False, False, True]
    assert chat_format.format_chats(turns.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>one<p>two  \n three", "one\n\ntwo three"),
        ("<p>a<b> b</b>c<i>d</i></p><div>e</div>f", "a bcd\n\ne\nf"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
        ("<ol start=3><li>a<li>b<p>more</ol>", "3. a\n4. b\n\n   more"),
        ("x<script>if (a<b) '</p>'</script>y<style>p{}</style><!-- z -->", "xy"),
        ("<p hidden>a</p><p style='color:red; DISPLAY : none'>b</p><p>c", "c"),
        ("<pre>\n a\n  b &lt;</pre>", " a\n  b <"),
        ("a<br>b<hr>c", "a\nb\n\n---\n\nc"),
        ("<table><tr><th>A<th>Bcd<tr><td>longer<td>x</table>", "A       Bcd\nlonger  x"),
        ("<table><caption>T</caption><tr><td>a<br>b<td>c</table>", "T\na  c\nb"),
        ("a < b <unknown>c</unknown></div> d", "a < b c d"),
        ("<head><title>t</title><meta x></head><body>b", "b"),
        ("<dl><dt>t<dd>d<dt>u</dl>", "t\n  d\nu"),
        ("<blockquote>a<p>b</blockquote>", "> a\n>\n> b"),
        ("<p>日本</p><table><tr><td>日本<td>x<tr><td>abc<td>y</table>", "日本\n\n日本  x\nabc   y"),
        ("<a title='x>y' href=\"z\">link</a><a b='c>d", "linkd"),
        ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
    ],
)
def test_html(page, text):
    assert html_text.page_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<table><thead><th>A<th>B</thead><tr><td>1<td>2</table>", "A  B\n1  2"),
        ("<table><td>a<td>b<tr><td>c</table>d", "a  b\nc\n\nd"),
        ("<table><tr><form><td>x</td></form></tr></table>", "x"),
        ("<table><form><tr><td>x<td>y</form></table>", "x  y"),
        ("<table><tbody>one <tr>two<td>x</tr></tbody></table>", "one two\nx"),
        ("<table><tr><p>one</p><td>x<td>y</tr><tbody><p>two</table>", "one\n\ntwo\nx  y"),
        ("<table><tr><div>d<td>x</div><td>y</table>", "d\nx  y"),
        ("<table><tr><b><td>x</td></b><td>y</table>", "x  y"),
        ("<table><div><tr><td>x<tr><td>y</div></table>", "x\ny"),
        ("<table><caption>T<td>a</table>", "T\na"),
        ("<table><colgroup><col><td>a</table>", "a"),
        ("<table><tr><div hidden>d<td>x</div><td>y<tr hidden><td>z</table>", "y"),
        ("<table><tr><table><tr><td>in</table><td>out</table>", "in\nout"),
    ],
)
def test_html_of_ill_formed_tables(page, text):
    assert html_text.page_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<table><tr><td colspan=2>wide head<td>C<tr><td>a<td>b<td>c</table>", "wide head  C\na  b       c"),
        ("<table><tr><td rowspan=2>side<td>x<td>y<tr><td>longer<td>z</table>", "side  x       y\n      longer  z"),
        ("<table><tr><td colspan=1000>all<td>next<tr><td>a<td>b</table>", "all   next\na  b"),
        ("<table><tr><td rowspan=0>s<td>a<tr><td>b<tr><td>c</table>", "s  a\n   b\n   c"),
        ("<table><tr><td colspan=3>a very wide cell<tr><td>1<td>2<td>3</table>", "a very wide cell\n1  2  3"),
        ("<table><tr><td rowspan=9>a<td rowspan=9>b<tr><tr><td>c</table>", "a  b\n      c"),
        ("<table><tfoot><tr><td>sum</tfoot><tr><td>one<tr><td>two</table>", "one\ntwo\nsum"),
        ("<p style='visibility:hidden'>a<b style='visibility: visible'>b</b>c</p>", "b"),
        ("<table><tr style='visibility:hidden'><td>a<td style='visibility:visible'>b<tr><td>c<td>d</table>", "   b\nc  d"),
        ("<ul style='visibility:hidden'><li>a<li style='visibility:visible'>b</ul>", "- b"),
        ("<textarea>\na <b> &amp;\n c</textarea>", "a <b> &\n c"),
        ("x<select><option>a<option selected>b</select>y<select><option>c<option>d</select>", "x b y c"),
        ("<select multiple><option>a<option hidden>b<option>c</select>", "a c"),
        ("<svg><title>t</title><desc>d</desc><text>in <tspan>it</tspan></text></svg>", "in it"),
        ("<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math>", "x=1"),
        ("<div>" * 450 + "<p hidden>secret</p>seen", "seen"),
        ("<div>" * 450 + "<p hidden>secret<p>seen<div hidden><div>no</div>no</div>too", "seentoo"),
        ("<div>" * 450 + "<script>no</script><noscript>no<i>no</i></noscript>a<i style='display:none'>no<b>no</b>no</i>b", "ab"),
        ("<div hidden>" * 450 + "no" + "</div>" * 450 + "seen", "seen"),
        ("<div>" * 100_000 + "<b hidden>no</b>deep", "deep"),
    ],
)
def test_html_spans_visibility_forms_and_depth(page, text):
    assert html_text.page_text(page) == text


def brute_table(rows):
    """Cells (text, across, down) on a grid of characters, set one by one."""
    grid, taken = {}, set()
    for y, row in enumerate(rows):
        x = 0
        for text, across, down in row:
            while (x, y) in taken:
                x += 1
            taken |= {(x + i, y + j) for i in range(across) for j in range(down)}
            grid[x, y] = (text, across)
            x += across
    starts = sorted({x for x, _ in grid})
    ends = {}
    for (x, y), (text, across) in grid.items():
        a = starts.index(x)
        ends[a, y] = (a + sum(x <= s < x + across for s in starts), text)
    left = [0]
    for column in range(len(starts)):
        need = [left[a] + len(t) + 2 for (a, _), (b, t) in ends.items() if b == column + 1]
        left.append(max([left[-1] + 2, *need]))
    lines = []
    for y in range(len(rows)):
        line = ""
        for a in range(len(starts)):
            if (a, y) in ends:
                line = line.ljust(left[a]) + ends[a, y][1]
        lines.append(line.rstrip())
    return lines


def test_html_tables_against_a_grid():
    rng = np.random.default_rng(12)
    for _ in range(300):
        rows = [
            [("abcdefgh"[: rng.integers(1, 8)], int(rng.choice([1, 1, 2, 3])), int(rng.choice([1, 1, 1, 2]))) for _ in range(rng.integers(1, 5))]
            for _ in range(rng.integers(1, 5))
        ]
        cells = "".join("<tr>" + "".join(f"<td colspan={a} rowspan='{d}'>{t}" for t, a, d in row) for row in rows)
        assert html_text.page_text(f"<table>{cells}</table>").split("\n") == "\n".join(brute_table(rows)).strip("\n").split("\n")


def test_html_rows(spark):
    rows = [(1, "u", "<title>A &lt; b</title><p>x"), (1, "u", "<title>A &lt; b</title><p>x"), (2, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", pa_lit("old"))
    found = sorted(map(tuple, html_text.extract(pages).collect()), key=str)
    assert found == [(1, "u", "A < b", "x"), (1, "u", "A < b", "x"), (2, None, "", "")]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_pipeline_stages(spark, docs, none):
    for start in (docs, none):
        frame = start
        for name, stage in corpus_pipeline.STAGES:
            frame = corpus_pipeline.stored(stage(spark, frame, ""), name)
            assert name == "packing" or frame.columns == docs.columns
    assert frame.count() == 0


def test_pieces_are_encoded_once_each(monkeypatch):
    """Pieces are known by their bytes: those that share a hash do not drive each other out."""
    monkeypatch.setattr(pieces, "span_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    asked = []

    def encode(fresh):
        asked.extend(fresh)
        return [list(x) for x in fresh]

    encoder = pieces.PieceEncoder(encode)
    for text in (b"one", b"two", b"three") * 3:
        ids, counts = encoder(np.frombuffer(text, np.uint8), np.asarray([0]), np.asarray([len(text)]))
        assert bytes(ids.astype(np.uint8)) == text and counts.tolist() == [len(text)]
    assert asked == [b"one", b"two", b"three"]


@pytest.mark.parametrize("name,split", [("byte_bpe_50k.json", "space"), ("word_bpe_49k.json", "words")])
def test_added_tokens_are_the_librarys(name, split):
    """Strings of added tokens, in any case and place, beside texts without."""
    from tokenizers import Tokenizer

    from limitline.llm.pieces import documents_ids

    texts = [
        "see <|endoftext|> and <|startoftext|> here", "", "plain words, no token", "<|EndOfText|>", "<|endoftext|>",
        "a<|endoftext|>b<|startoftext|>", "< |endoftext|>", "é<|startoftext|>\u0130", "<|endoftext|>" * 3, "last",
    ]
    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    for some in (texts, texts[:1], texts[2:3], texts[:2], [""], []):
        ids, bounds = documents_ids(*textblocks.flat(pa.array(some, pa.string())), path, split, 7)
        want = [[*library.encode(t, add_special_tokens=False).ids, 7] for t in some]
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want


def test_pipeline_decides_by_row(spark):
    """A repeated id with another text stays; rows without id stay; without any language nothing lettered goes."""
    rows = [
        (1, "copied words here"), (2, "copied words here"), (1, "other words of the same id"), (None, "copied words here"),
        (5, None), (6, ""), (7, "123"), (8, "word"),
    ]
    docs = spark.createDataFrame([(*r, None) for r in rows], "doc_id long, text string, lang string")
    kept = corpus_pipeline.drop_copies(spark, docs, "").select("doc_id", "text").collect()
    assert sorted(map(str, kept)) == sorted(
        f"Row(doc_id={d}, text={t!r})" for d, t in rows if (d, t) not in ((1, "copied words here"), (5, None))
    )
    told = corpus_pipeline.identify_language(spark, docs, "").select("doc_id", "text").collect()
    assert sorted(map(str, told)) == sorted(f"Row(doc_id={d}, text={t!r})" for d, t in rows if t and any(map(str.isalpha, t)))
