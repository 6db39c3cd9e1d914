"""Language identification by prediction by partial matching over bytes.

For each language a tree of byte contexts of up to ``order`` bytes holds the counts of the
byte that follows. A byte costs -log2 of its probability in the longest context that the
language knows; one not seen there costs an escape and is coded in the next shorter
context, without the bytes already excluded, down to equal chances for all bytes left
(escape method C). The statistics are frozen after training, so the cost of every byte in
every context is computed once, and scoring a text is a walk down one table and a sum.
The language with the shortest code wins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limitline.llm.textblocks import blocks, flat

#: Bytes of context.
ORDER = 4
#: Labelled documents learned per language: those whose ids have the smallest hashes.
SAMPLE_DOCS = 1000
#: Contexts kept in the tree, over all languages: the most frequent.
MAX_CONTEXTS = 8_000

#: Bytes of text scored or counted at once: some hundred bytes of memory for each of them.
SCORED_BYTES = 1 << 20

UNDETERMINED = "und"


@dataclass(frozen=True)
class Model:
    """Frozen statistics of all languages in one tree of contexts.

    ``symbol`` maps a byte to its column; the last column stands for all bytes never seen.
    ``child[node, symbol]`` is the context one byte longer (further back), or the node's
    stop twin, from which every step stays. ``cost[node, symbol, language]`` is in bits.
    """

    languages: tuple[str, ...]
    order: int
    symbol: np.ndarray
    child: np.ndarray
    cost: np.ndarray


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows to learn from: crc32 of doc_id as text leaves no remainder 1 by 3, language known."""
    return docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3 == 1


def sample(docs: DataFrame, per_language: int = SAMPLE_DOCS) -> DataFrame:
    """lang and text of at most ``per_language`` documents of each language.

    Those with the smallest hashes of doc_id. Rows with clearly larger hashes are left out
    before the ranking, so that it sees a bounded number of rows whatever the input. The
    model has room for each language, so there must be few.
    """
    sizes = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    if not sizes:
        return docs.select("lang", "text").limit(0)
    share = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, 2 * per_language / n))))
    key = F.xxhash64("doc_id")
    low = key.cast("double") / 2.0**64 + 0.5 <= share[F.col("lang")]
    ids = docs.where(low).select("lang", "doc_id", key.alias("key")).distinct()
    picked = F.row_number().over(Window.partitionBy("lang").orderBy("key", "doc_id"))
    ids = ids.withColumn("n", picked).where(F.col("n") <= per_language).select("lang", "doc_id")
    return docs.where(low).select("doc_id", "lang", "text").join(ids, ["doc_id", "lang"], "left_semi")


def _grams(order: int):
    """Counts of each byte after each context of 0 to ``order`` bytes, as one number per gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, dict[int, list]] = {}
        for batch in batches:
            for block in blocks(batch, "text", SCORED_BYTES):
                data, offsets = flat(block.column("text"))
                langs = block.column("lang").to_pylist()
                wide = data.astype(np.int64)
                room = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
                owner = np.repeat(np.arange(len(langs)), np.diff(offsets))
                names = sorted(set(langs))
                lang_of = np.asarray([names.index(x) for x in langs], np.int64)[owner]
                gram = wide.copy()
                for size in range(order + 1):
                    if size:  # the byte ``size`` back in front
                        gram[size:] += wide[:-size] << np.int64(8 * size)
                    fits = room >= size
                    for i, name in enumerate(names):
                        mine = gram[fits & (lang_of == i)]
                        if len(mine):
                            keys, counts = np.unique(mine, return_counts=True)
                            totals.setdefault(name, {}).setdefault(size, []).append((keys, counts))
        for name, sizes in totals.items():
            for size, parts in sizes.items():
                keys, which = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                counts = np.bincount(which, weights=np.concatenate([c for _, c in parts])).astype(np.int64)
                yield pa.RecordBatch.from_pydict(
                    {"lang": [name] * len(keys), "size": np.full(len(keys), size, np.int32), "gram": keys, "n": counts}
                )

    return run


def train(rows: DataFrame, order: int = ORDER, max_contexts: int = MAX_CONTEXTS) -> Model:
    """The model of the labelled ``rows`` (lang, text), which must be a bounded sample.

    No labelled text gives a model without languages.
    """
    grams = (
        rows.select(F.col("lang").cast("string"), F.col("text").cast("string"))
        .where(F.length("text") > 0)
        .mapInArrow(_grams(order), "lang string, size int, gram long, n long")
        .groupBy("lang", "size", "gram")
        .agg(F.sum("n").alias("n"))
    )
    weights = grams.where("size > 0").groupBy("size", F.shiftright("gram", 8).alias("context"))
    kept = weights.agg(F.sum("n").alias("weight")).where("weight > 1")
    kept = kept.orderBy(F.desc("weight"), "size", "context").limit(max_contexts)
    counts = grams.withColumn("context", F.shiftright("gram", 8)).join(
        kept.select("size", "context").unionByName(
            rows.sparkSession.sql("select 0 as size, 0L as context")
        ),
        ["size", "context"],
        "left_semi",
    )
    return build_model(counts.select("lang", "size", "gram", "n").toPandas(), order)


def build_model(counts: pd.DataFrame, order: int) -> Model:
    """The tree of costs from counts (lang, size, gram, n)."""
    languages = tuple(sorted(counts["lang"].unique()))
    seen = np.unique(counts["gram"].to_numpy(np.int64) & 255)
    symbol = np.full(256, len(seen), np.int64)
    symbol[seen] = np.arange(len(seen))
    width = len(seen) + 1
    # Contexts by length; a context whose shorter part is missing is left out.
    size = counts["size"].to_numpy(np.int64)
    context = counts["gram"].to_numpy(np.int64) >> 8
    node_of: dict[tuple[int, int], int] = {(0, 0): 0}
    parent = [0]
    for s in range(1, order + 1):
        for c in np.unique(context[size == s]).tolist():
            up = node_of.get((s - 1, c & ((1 << 8 * (s - 1)) - 1)))
            if up is not None:
                node_of[s, c] = len(parent)
                parent.append(up)
    n_nodes = len(parent)
    child = np.tile(np.arange(n_nodes, 2 * n_nodes, dtype=np.int32)[:, None], (2, width))
    for (s, c), node in node_of.items():
        if s:
            first = symbol[c >> 8 * (s - 1)]
            if first < width - 1:
                child[parent[node], first] = node
    cost = np.empty((n_nodes, width, len(languages)), np.float32)
    parents = np.asarray(parent)
    nodes = np.asarray([node_of.get(k, -1) for k in zip(size.tolist(), context.tolist(), strict=True)], np.int64)
    for i, lang in enumerate(languages):
        mine = (counts["lang"].to_numpy() == lang) & (nodes >= 0)
        table = np.zeros((n_nodes, width))
        np.add.at(
            table,
            (nodes[mine], symbol[counts["gram"].to_numpy(np.int64)[mine] & 255]),
            counts["n"].to_numpy(np.float64)[mine],
        )
        cost[:, :, i] = _code_lengths(table, parents, 256 - len(seen))
    return Model(languages, order, symbol, child, cost)


def _code_lengths(counts: np.ndarray, parents: np.ndarray, unseen: int) -> np.ndarray:
    """Bits of each symbol in each context, with escapes (method C) and exclusion."""
    bits = np.zeros(counts.shape)
    left = np.ones(counts.shape, bool)  # not coded yet; what is coded is excluded further up
    at = np.arange(len(counts))
    rows = at
    while len(rows):
        here = np.where(left[rows], counts[at[rows]], 0.0)
        coded = here > 0
        total = here.sum(1, keepdims=True)
        kinds = coded.sum(1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            seen = np.where(coded, np.log2(total + kinds) - np.log2(here), 0.0)
            escape = np.where(kinds > 0, np.log2(total + kinds) - np.log2(kinds), 0.0)
        left[rows] &= ~coded
        bits[rows] += seen + np.where(left[rows], escape, 0.0)
        rows = rows[at[rows] != 0]
        at = parents[at]
    # After the empty context: equal chances for all bytes that are left.
    chances = left[:, :-1].sum(1, keepdims=True) + unseen
    return bits + np.where(left, np.log2(np.maximum(chances, 1)), 0.0)


def code_lengths(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of each text in each language."""
    symbols = model.symbol[data]
    n_nodes = len(model.cost)
    width = model.cost.shape[1]
    room = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    child = model.child.ravel()
    node = np.zeros(len(data), np.int64)
    for back in range(1, model.order + 1):
        step = np.full(len(data), n_nodes, np.int64)  # stops at texts' beginnings
        step[back:] = child[node[back:] * width + symbols[:-back]]
        stop = np.where(node < n_nodes, node + n_nodes, node)
        node = np.where(room >= back, step, stop)
    each = model.cost.reshape(-1, model.cost.shape[2])[(node % n_nodes) * width + symbols]
    total = np.zeros((len(offsets) - 1, each.shape[1]))
    filled = np.flatnonzero(np.diff(offsets))
    if len(filled):
        total[filled] = np.add.reduceat(each, offsets[filled], axis=0, dtype=np.float64)
    return total


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``docs``, or its columns ``keep``, and lang_pred string, score double.

    The score is the winner's share of the probability of the text over all languages.
    Texts that are null or have no letter, and all texts if there is no language, are
    ``und`` with score 0. Ties go to the language that sorts first. Columns of these two
    names in ``docs`` are replaced; all others are kept.
    """
    kept = [c for c in keep or docs.columns if c not in ("lang_pred", "score")]
    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for block in blocks(batch, "text", SCORED_BYTES):
                texts = block.column("text")
                lettered = np.fromiter(map(has_letter, texts.to_pylist()), bool, len(texts))
                names = np.full(len(texts), UNDETERMINED, object)
                scores = np.zeros(len(texts))
                if known.languages:
                    bits = code_lengths(known, *flat(texts))
                    best = bits.argmin(1)
                    behind = (bits - bits[np.arange(len(bits)), best][:, None]) * math.log(2)
                    share = 1.0 / np.exp(-np.minimum(behind, 700)).sum(1)
                    names[lettered] = np.asarray(known.languages, object)[best[lettered]]
                    scores[lettered] = share[lettered]
                columns = [block.column(c) for c in kept]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(names, pa.string()), pa.array(scores)], names=schema.names
                )

    return docs.select(*dict.fromkeys([*kept, "text"])).mapInArrow(run, schema)
