"""Near duplicates by ProbMinHash signatures, banding and exact verification.

A text is its runs of five words, weighted by how often they occur. Each run sends out a
Poisson process at the rate of its weight; every arrival hits a random register, and a
register belongs to the run that hits it first. Two texts agree in a register with the
probability Jaccard similarity of their weighted runs. All runs of many texts advance one
arrival at a time, and a run stops once its time exceeds the last register of its text.

Registers are banded. In a bucket of a band texts are compared with the bucket's hubs, the
texts that share buckets with most others, and not all with all; in the first round a text
meets only the hub of its largest bucket, which joins most of a large class. After each round
the links found join classes. Texts of one class need no further comparison, so a bucket stays
only while it holds several classes, without the hubs it has had; its next hubs come from
different classes. Texts are read only for pairs whose sketches, four bits of each register,
differ in few enough registers. Later a text meets several hubs of each of its buckets, but of
those with more classes than hubs, as a template makes them, it takes its largest alone: the
hubs cannot settle these, and the others bring it beside ever more texts of the template.

Hubs alone do not settle a bucket. What is left of buckets with several classes after a few
rounds, or after one that joins none, goes an exact way: the runs of each text are ordered
from rare to frequent, and two texts of different classes are compared if they share a run
beyond which either has still enough to be similar. Texts on one template are not brought
together by what all of them have in common. These texts have wide sketches, which tell pairs
just below the threshold from similar ones. Of large families each class first sends for each run
the texts that have least of their weight on rarer ones, which differ least from the others, one
and then a few of them, and of two classes the pair whose wide sketches differ least is read.
All texts, then all pairs follow only for classes that are still apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limitline.llm.components import components
from limitline.llm.storage import stored
from limitline.llm.textblocks import blocks, flat, mixed, shingle_hashes, span_hashes, words

WORDS = 5
SIMILARITY = 0.8
#: 20 bands of 5 registers: a pair at similarity 0.8 shares a bucket with probability
#: 1 - (1 - 0.8^5)^20 = 0.9996, one at 0.85 with 0.99998.
BANDS, ROWS = 20, 5
#: Hubs of a bucket from the second round on, each of another class; few texts are left by then.
LATER_HUBS = 8
#: Rounds with hubs at most; what is left then is compared by rare runs.
HUB_ROUNDS = 2
#: Texts of a class that meet others at a run in the first rounds of the exact way; all do in the last ones.
FOREMOST = (1, 8)
#: Texts with one run up to which the last rounds are enough.
FEW = 500
#: Deviations above the mean of differing registers at the threshold up to which a pair is
#: read: a pair at similarity 0.8 is left out with probability 0.00002.
DEVIATIONS = 4.4
#: Registers of the sketches of texts that hubs leave: at most 2048, as many as a draw can tell apart.
WIDE = 1024

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def weighted_shingles(texts: pa.Array, size: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct runs of words of each text, in order: hash, weight; first run of each text.

    Words are lower case and separated by ASCII white space. A text of fewer words than
    ``size`` is one run; one without words has none.
    """
    data, offsets = flat(pc.utf8_lower(texts.cast(pa.large_string())))
    starts, ends, firsts = words(data, offsets)
    hashes = span_hashes(data, starts, ends)
    runs, at = shingle_hashes(hashes, firsts, size)
    owner = np.searchsorted(firsts, at, side="right") - 1
    counts = np.diff(firsts)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = [_chain(hashes[firsts[i] : firsts[i + 1]]) for i in short.tolist()]
        runs = np.concatenate([runs, np.asarray(whole, np.uint64)])
        owner = np.concatenate([owner, short])
    order = np.lexsort((runs, owner))
    runs, owner = runs[order], owner[order]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:] != runs[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    weights = np.diff(np.append(at, len(runs)))
    return runs[at], weights, np.searchsorted(owner[at], np.arange(len(texts) + 1))


def _chain(hashes: np.ndarray) -> int:
    total = 0
    for h in hashes.tolist():
        total = (total * int(_GOLDEN) + h) % (1 << 64)
    return total


def signatures(keys: np.ndarray, weights: np.ndarray, firsts: np.ndarray, registers: int) -> np.ndarray:
    """The key that holds each register, per text; texts without keys have zeros."""
    n = len(firsts) - 1
    times = np.full(n * registers, np.inf)
    holders = np.zeros(n * registers, np.uint64)
    owner = np.repeat(np.arange(n), np.diff(firsts))
    at = np.zeros(len(keys))
    rate = weights.astype(np.float64)
    arrival = 0
    while len(keys):
        arrival += 1
        draw = mixed(keys + np.uint64(arrival * int(_GOLDEN) % 2**64))
        at = at - np.log(((draw >> np.uint64(11)) + np.uint64(1)).astype(np.float64) * 2.0**-53) / rate
        slot = owner * registers + ((draw & np.uint64(2047)) * np.uint64(registers) >> np.uint64(11)).astype(np.int64)
        np.minimum.at(times, slot, at)
        won = times[slot] == at
        holders[slot[won]] = keys[won]
        if arrival <= 8 or arrival % 8 == 0:  # early end: later arrivals cannot win any more
            live, which = np.unique(owner, return_inverse=True)
            last = times.reshape(n, registers)[live].max(1)
            on = at < last[which]
            keys, owner, at, rate = keys[on], owner[on], at[on], rate[on]
    return holders.reshape(n, registers)


def band_keys(holders: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per text and band."""
    rows = holders.reshape(len(holders), bands, -1)
    keys = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * _GOLDEN + np.zeros((len(holders), 1), np.uint64)
    for i in range(rows.shape[2]):
        keys = mixed(keys ^ rows[:, :, i]) + _GOLDEN
    return keys


def sketches(holders: np.ndarray) -> np.ndarray:
    """Four bits of each register, sixteen registers to a 64-bit number, per text."""
    n, registers = holders.shape
    places = -(-registers // 16) * 16
    bits = np.zeros((n, places), np.uint64)
    bits[:, :registers] = mixed(holders.reshape(-1)).reshape(n, registers) >> np.uint64(60)
    shifts = np.arange(16, dtype=np.uint64) * np.uint64(4)
    return np.bitwise_or.reduce(bits.reshape(n, -1, 16) << shifts, axis=2)


def most_differing(registers: int, similarity: float) -> int:
    """Differing sketch registers up to which two texts may be as similar as ``similarity``."""
    p = (1 - similarity) * 15 / 16
    return math.ceil(registers * p + DEVIATIONS * math.sqrt(registers * p * (1 - p)))


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Exact probability Jaccard similarity of two weighted sets, keys sorted."""
    if not len(a) or not len(b):
        return 0.0
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    same = a[at] == b
    ca, cb = wa[at[same]], wb[same]
    only_a, only_b = int(wa.sum() - ca.sum()), int(wb.sum() - cb.sum())
    if len(a) == wa.sum() and len(b) == wb.sum():  # all weights are one: plain Jaccard similarity
        return len(ca) / (len(ca) + only_a + only_b)
    width = int(wb.max()) + 1
    codes, times = np.unique(ca * width + cb, return_counts=True)
    pairs = np.stack([codes // width, codes % width], 1).astype(np.float64)
    total = 0.0
    for (x, y), n in zip(pairs.tolist(), times.tolist(), strict=True):
        total += n / (np.dot(times, np.maximum(pairs[:, 0] / x, pairs[:, 1] / y)) + only_a / x + only_b / y)
    return total


def _signed(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text"):
                keys, weights, firsts = weighted_shingles(block.column("text"))
                holders = signatures(keys, weights, firsts, bands * rows)
                found, drawn = band_keys(holders, bands), sketches(holders)
                sizes = np.diff(firsts)
                filled = sizes > 0
                bounds = np.concatenate(([0], np.cumsum(filled * bands))).astype(np.int32)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": block.column("doc_id"),
                        "sha": block.column("sha"),
                        "bands": pa.ListArray.from_arrays(bounds, found[filled].reshape(-1).view(np.int64)),
                        "sketch": pa.ListArray.from_arrays(
                            np.arange(len(drawn) + 1, dtype=np.int32) * drawn.shape[1],
                            drawn.reshape(-1).view(np.int64),
                        ),
                    }
                )

    return run


def _verified(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text_a", 1 << 20):
                ka, wa, fa = weighted_shingles(block.column("text_a"))
                kb, wb, fb = weighted_shingles(block.column("text_b"))
                near = [
                    probability_jaccard(ka[p:q], wa[p:q], kb[r:s], wb[r:s]) >= similarity
                    for p, q, r, s in zip(fa, fa[1:], fb, fb[1:], strict=False)
                ]
                yield block.select(["class_a", "class_b"]).filter(pa.array(near, pa.bool_()))

    return run


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The weighted runs of each text, with all its weight and the number of its distinct runs."""
    for batch in batches:
        for block in blocks(batch, "text"):
            keys, weights, firsts = weighted_shingles(block.column("text"))
            sizes = np.diff(firsts)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            total = np.bincount(owner, weights, len(sizes)).astype(np.int64)
            yield pa.RecordBatch.from_pydict(
                {
                    "node": block.column("doc_id").take(pa.array(owner)),
                    "sha": block.column("sha").take(pa.array(owner)),
                    "run": keys.view(np.int64),
                    "weight": weights.astype(np.int64),
                    "total": total[owner],
                    "kinds": sizes[owner].astype(np.int64),
                }
            )


def _wide_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sketch of ``WIDE`` registers of each text; few texts at a time, as registers take memory."""
    for batch in batches:
        for block in blocks(batch, "text"):
            for at in range(0, len(block), 256):
                part = block.slice(at, 256)
                drawn = sketches(signatures(*weighted_shingles(part.column("text")), WIDE))
                bounds = np.arange(len(drawn) + 1, dtype=np.int32) * drawn.shape[1]
                yield pa.RecordBatch.from_pydict(
                    {
                        "node": part.column("doc_id"),
                        "sha": part.column("sha"),
                        "wide": pa.ListArray.from_arrays(bounds, drawn.reshape(-1).view(np.int64)),
                    }
                )


#: Upper ends of the levels of repetition: the part of a text's weight that repeats a run.
REPEATED = (0.0, 0.01, 0.02, 0.05)


def _rare_runs(left: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The runs of the texts in ``left`` at which two of them can begin to be alike.

    One row per text and run: its ``rest``, ``again`` and level of repetition as told in
    ``_sharing``, with the text's class and sketches.
    """
    nodes = stored(left.select("node", "class", "sketch").distinct(), "nodes")
    read = texts.join(nodes.select(F.col("node").alias("doc_id")).hint("merge"), "doc_id", "left_semi")
    read = read.withColumn("sha", F.xxhash64("text"))
    schema = "node long, sha long, run long, weight long, total long, kinds long"
    wide = stored(read.mapInArrow(_wide_sketches, "node long, sha long, wide array<long>"), "wide-sketches")
    runs = stored(read.mapInArrow(_run_rows, schema), "runs")
    often = runs.groupBy("run").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    # Runs of one text alone come first in the order and meet no other.
    common = runs.join(stored(often, "common-runs"), "run")
    order = Window.partitionBy("node", "sha").orderBy(F.desc("often"), F.desc("run"))
    common = common.withColumns({"rest": F.sum("weight").over(order), "from_here": F.count("run").over(order)})
    common = common.where(F.col("rest") >= similarity * F.col("total") - 1e-6)
    repeated = (F.col("total") - F.col("kinds")) / F.col("total")
    level = sum((F.when(repeated > e, 1).otherwise(0) for e in REPEATED), F.lit(0))
    rare = common.select("node", "sha", "run", "rest", (F.col("rest") - F.col("from_here")).alias("again"), "total", level.alias("level"))
    return stored(rare.join(nodes, "node").join(wide, ["node", "sha"]).drop("sha"), "rare-runs")


def _alike(left: DataFrame, texts: DataFrame, similarity: float, words_of_sketch: int, differing: int) -> DataFrame:
    """Distinct pairs (a, b), a < b, of texts of different classes in ``left`` that can be similar enough."""
    return _sharing(_rare_runs(left, texts, similarity), similarity, words_of_sketch, differing)


def _sharing(rare: DataFrame, similarity: float, words_of_sketch: int, differing: int) -> DataFrame:
    """Distinct pairs (a, b), a < b, of texts of different classes in ``rare`` that can be similar enough.

    ``unlike`` tells in how many registers their wide sketches differ.

    Runs stand in one order for all texts, rare ones first. From a run on, let ``rest`` be a
    text's weight, and ``again`` the part of it beyond one for each run. All that two texts
    share stands from their first common run on. With totals A, B the similarity is at most

    * the lesser of rest_a / A and rest_b / B, and
    * the lesser of rest_a + again_b and rest_b + again_a, over A + B - the lesser rest: a
      common run of weights v, w adds at most max(v, w) over that denominator.

    Of two texts that repeat little the one with less weight asks. Beside a partner that
    repeats up to a part e of its weight, which then has no more than A / (similarity - e),
    only runs with rest (1 + similarity) + e A / (similarity - e) >= 2 similarity A can be
    the first common one. Texts on one template, which share too little, are not brought
    together by it, whether they repeat a run or not. No pair at ``similarity`` fails
    this; sketches leave one out as seldom as narrow ones do.
    """
    # The levels of partners beside which a run can be the first common one.
    many = len(REPEATED)
    slack = [e / (similarity - e) for e in REPEATED if e < similarity]
    enough = (1 + similarity) * F.col("rest") + 1e-6
    beside = [
        F.when((F.col("level") < many) & (enough >= (2 * similarity - x) * F.col("total")), F.lit(i))
        for i, x in enumerate(slack)
    ]
    beside += [F.lit(i) for i in range(len(slack), many)] + [F.lit(many)]
    one = rare.withColumn("level_2", F.explode(F.array_compact(F.array(*beside))))
    other = rare.select("run", *(F.col(c).alias(f"{c}_2") for c in ("node", "rest", "again", "total", "level", "class", "sketch", "wide")))
    little, little_2 = F.col("level") < many, F.col("level_2") < many
    smaller = F.struct("total", "node") < F.struct("total_2", "node_2")
    asks = F.when(little & little_2, smaller).when(little, True).when(little_2, False).otherwise(F.col("node") < F.col("node_2"))
    shared = F.least(F.col("rest") + F.col("again_2"), F.col("rest_2") + F.col("again"))
    close = shared >= similarity * (F.col("total") + F.col("total_2") - F.least("rest", "rest_2")) - 1e-6
    both = one.join(other, ["run", "level_2"]).where((F.col("class") != F.col("class_2")) & asks & close)
    # Wide sketches are compared only where narrow ones are alike.
    narrow = _unlike("sketch", "sketch_2", words_of_sketch) <= differing
    both = both.where(F.when(narrow, _unlike_wide("wide", "wide_2") <= most_differing(WIDE, similarity)).otherwise(False))
    both = both.withColumn("unlike", _unlike_wide("wide", "wide_2"))
    return _ordered(both, "node", "class", "node_2", "class_2", "unlike")


def _foremost(rare: DataFrame, n: int) -> DataFrame:
    """Of the texts of a class and level that have a run the ``n`` with the largest part of their weight from there on.

    What a text has by itself or with few others comes before, so these are near to many.
    """
    order = Window.partitionBy("run", "level", "class").orderBy(F.desc(F.col("rest") / F.col("total")), "node")
    return rare.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n).drop("nth")


def _most_alike(pairs: DataFrame) -> DataFrame:
    """Of the pairs of two classes the one whose wide sketches differ least."""
    least = F.min(F.struct("unlike", "a", "b")).alias("least")
    return pairs.groupBy("class_a", "class_b").agg(least).select("least.a", "least.b", "class_a", "class_b")


def _links(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The classes (a, b) of the pairs whose texts are similar enough."""
    left = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    # The joins bring all pairs of a hub to one task; the comparisons are dealt out evenly.
    both = both.repartition("a", "b").select("class_a", "class_b", "text_a", "text_b")
    return both.mapInArrow(_verified(similarity), "class_a long, class_b long").toDF("a", "b").distinct()


def near_groups(
    docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """One row per row of ``docs``: doc_id and class_id, the smallest doc_id of its class.

    Documents are linked if the probability Jaccard similarity of their weighted runs of
    five words is at least ``similarity``; a class is what links connect. Equal texts are
    one document for this; null counts as empty; texts without words are in a class only
    with equal ones. Rows without doc_id get no class; of rows that repeat a doc_id each is
    classed by its text. An empty table gives no rows; other columns are not read.
    """
    source = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    signed = stored(
        source.withColumn("sha", F.unhex(F.sha2("text", 256))).mapInArrow(
            _signed(bands, rows), "doc_id long, sha binary, bands array<long>, sketch array<long>"
        ),
        "signatures",
    )
    # Stored tables are exchanged anew on both sides of a join, so that Spark can split a
    # bucket or a group of copies that holds a large part of all rows.
    texts = signed.where("doc_id is not null").groupBy("sha")
    of_text = F.first("bands").alias("bands"), F.first("sketch").alias("sketch")
    texts = stored(texts.agg(F.min("doc_id").alias("node"), *of_text), "texts")
    bucketed = texts.select("node", "sketch", F.explode("bands").alias("bucket"))
    sizes = bucketed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = stored(bucketed.join(stored(sizes, "sizes"), "bucket"), "buckets")
    degrees = shared.groupBy("node").agg(F.sum("size").alias("degree"))
    left = shared.join(degrees, "node").select("bucket", "size", "node", "degree", "sketch", F.col("node").alias("class"))
    left = stored(left, "buckets")
    differing = most_differing(bands * rows, similarity)
    words_of_sketch = -(-bands * rows // 16)
    classes = left.select("node", "class").distinct()
    # Any one row of a repeated doc_id will do, and its equal texts are one.
    wanted = classes.select(F.col("node").alias("doc_id"))
    needed = stored(source.join(wanted.hint("merge"), "doc_id", "left_semi").distinct(), "bucket-texts")
    for n_hubs in [1, *[LATER_HUBS] * (HUB_ROUNDS - 1)]:
        first = n_hubs == 1
        hubs = stored(_hubs(left, n_hubs), "hubs")
        crowded = None if first else stored(_crowded(left, n_hubs), "crowded")
        places = _largest_places(left) if first else _later_places(left, crowded)
        beside = _beside(places, hubs, words_of_sketch, differing)
        found = stored(_links(beside, needed, similarity), "links")
        if not found.limit(1).count():
            if first:
                continue
            break
        roots = components(found).select(F.col("node").alias("class"), "root")
        classes = stored(_joined(classes, roots), "classes")
        rest = left
        if not first:  # a hub that met all of its bucket need not again
            met = hubs.join(crowded, "bucket", "left_anti").select("bucket", F.col("hub").alias("node"))
            rest = left.join(met, ["bucket", "node"], "left_anti")
        rest = stored(_joined(rest, roots), "places")
        several = rest.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high"))
        left = stored(rest.join(several.where("low < high").select("bucket"), "bucket", "left_semi"), "buckets")
    if left.limit(1).count():
        rare = _rare_runs(left, needed, similarity)
        crowded = rare.groupBy("run").count().where(F.col("count") > FEW).limit(1).count()
        for n, every in (*((n, False) for n in FOREMOST if crowded), (None, False), (None, True)):
            pairs = _sharing(_foremost(rare, n) if n else rare, similarity, words_of_sketch, differing)
            found = stored(_links(pairs.drop("unlike") if every else _most_alike(pairs), needed, similarity), "links")
            if not found.limit(1).count():
                continue
            roots = components(found).select(F.col("node").alias("class"), "root")
            classes = stored(_joined(classes, roots), "classes")
            if not every:
                rare = stored(_joined(rare, roots), "rare-runs")
    classed = texts.select("sha", "node").join(classes, "node", "left")
    classed = classed.select("sha", F.coalesce("class", "node").alias("class_id"))
    return signed.select("doc_id", "sha").join(classed.select("sha", "class_id"), "sha", "left").select(
        "doc_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id")
    )


def _hubs(left: DataFrame, n: int) -> DataFrame:
    """bucket, hub, hub_class and hub_sketch: the text with the largest degree, of equals the smallest, of each of ``n`` classes.

    These are the classes whose texts rank first.
    """
    best = F.max(F.struct("degree", (-F.col("node")).alias("least"), F.col("class").alias("of"), "sketch"))
    if n == 1:
        tops = left.groupBy("bucket").agg(best.alias("best"))
    else:
        tops = left.groupBy("bucket", "class").agg(best.alias("best"))
        rank = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("best")))
        tops = tops.withColumn("rank", rank).where(F.col("rank") <= n)
    return tops.select("bucket", (-F.col("best.least")).alias("hub"), F.col("best.of").alias("hub_class"), F.col("best.sketch").alias("hub_sketch"))


def _largest_places(left: DataFrame) -> DataFrame:
    """Each text in the largest of its buckets."""
    place = F.max(F.struct("size", "bucket", "class", "sketch")).alias("place")
    return left.groupBy("node").agg(place).select("place.bucket", "node", "place.class", "place.sketch")


def _crowded(left: DataFrame, n: int) -> DataFrame:
    """The buckets that hold more than ``n`` classes."""
    return left.groupBy("bucket").agg(F.count_distinct("class").alias("classes")).where(F.col("classes") > n).select("bucket")


def _later_places(left: DataFrame, crowded: DataFrame) -> DataFrame:
    """Each text in all of its buckets that are not crowded, and in the largest of those that are."""
    settled = left.join(crowded, "bucket", "left_anti").select("bucket", "node", "class", "sketch")
    return settled.unionByName(_largest_places(left.join(crowded, "bucket", "left_semi")))


def _beside(left: DataFrame, hubs: DataFrame, words_of_sketch: int, differing: int) -> DataFrame:
    """Distinct pairs (a, b), a < b, of a text and a hub of its bucket of another class, with their classes.

    Pairs whose sketches differ in more than ``differing`` registers are left out.
    """
    # One row per place, then the distinct hubs of a text: it shares most buckets with the same ones.
    lists = hubs.groupBy("bucket").agg(F.collect_list(F.struct("hub", "hub_class")).alias("hubs"))
    met = left.select("bucket", "node", "class", "sketch").join(lists, "bucket").groupBy("node", "class")
    met = met.agg(F.array_distinct(F.flatten(F.collect_set("hubs"))).alias("hubs"), F.first("sketch").alias("sketch"))
    others = F.filter("hubs", lambda h: h["hub_class"] != F.col("class"))
    pairs = met.select("node", "class", "sketch", F.explode(others).alias("h")).select("node", "class", "sketch", "h.*")
    both = pairs.join(hubs.select("hub", "hub_sketch").distinct(), "hub")
    both = both.where(_unlike("sketch", "hub_sketch", words_of_sketch) <= differing)
    return _ordered(both, "node", "class", "hub", "hub_class")


def _differing(x: Column, y: Column) -> Column:
    """Registers in which two numbers of sixteen registers differ."""
    bits = x.bitwiseXOR(y)
    bits = bits.bitwiseOR(F.shiftrightunsigned(bits, 1))
    bits = bits.bitwiseOR(F.shiftrightunsigned(bits, 2))
    return F.bit_count(bits.bitwiseAND(F.lit(0x1111111111111111)))


def _unlike(one: str, other: str, words_of_sketch: int) -> Column:
    """Registers in which two sketches differ."""
    unlike = F.lit(0)
    for i in range(words_of_sketch):
        unlike = unlike + _differing(F.col(one)[i], F.col(other)[i])
    return unlike


def _unlike_wide(one: str, other: str) -> Column:
    """Registers in which two wide sketches differ; a loop over their numbers, too many for one expression."""
    return F.aggregate(F.zip_with(one, other, _differing), F.lit(0), lambda total, n: total + n)


def _ordered(both: DataFrame, one: str, its_class: str, other: str, others_class: str, *more: str) -> DataFrame:
    """Distinct a, b, class_a, class_b of two texts and their classes, a < b, and the columns ``more``."""
    first = F.col(one) < F.col(other)
    return both.select(
        F.least(one, other).alias("a"),
        F.greatest(one, other).alias("b"),
        F.when(first, F.col(its_class)).otherwise(F.col(others_class)).alias("class_a"),
        F.when(first, F.col(others_class)).otherwise(F.col(its_class)).alias("class_b"),
        *more,
    ).distinct()


def _joined(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows with the root of their class as class."""
    kept = [c for c in rows.columns if c != "class"]
    return rows.join(roots, "class", "left").select(*kept, F.coalesce("root", "class").alias("class"))
