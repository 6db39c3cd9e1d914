"""Repeated passages by collinear chaining of shared word seeds.

Seeds are hashes of five words in a row, sampled so that of any 16 neighbouring ones at
least one is taken (minimizers). Each occurrence of a seed is joined with its first one in
the document with the smallest id that has it, so a passage in any number of documents
gives a number of matches in proportion. The seeds of a passage may have their first
holders in many documents, as those of frequent lines do; so runs of 40 words are taken in
the same way, of any 11 neighbouring ones at least one. Any 50 words that an earlier document
has hold such a run, and its first holder shares a whole passage. Where words of such a run
differ, two neighbouring seeds with their distance are a key, too: that over the border of
two frequent lines has its own first holder, which is one that has both. Matches between two documents are chained in order of both under linear gap
costs, with a Fenwick tree for the best predecessor. Chains are then aligned word by word:
along the diagonals between seeds, and beyond the ends as long as matches prevail. For that
the words of either document are joined in blocks, so that a document which is the first
of very many hands out no more than the stretches asked for, from many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limitline.llm.storage import stored
from limitline.llm.textblocks import blocks, flat, mixed, shingle_hashes, span_hashes, words

#: Words in a seed; neighbouring seeds of which one is taken at least. Any passage of
#: SEED_WORDS + WINDOW - 1 = 20 equal words has a seed, one of 36 has two.
SEED_WORDS, WINDOW = 5, 16
MIN_SEEDS = 2
#: Words in a long run, those of the shortest passage; neighbouring ones of which one is taken
#: at least: any 50 equal words have one.
RUN_WORDS, RUN_WINDOW = 40, 11
#: The last bits of a key tell its kind: 1 for a long run, twice the distance for a pair of seeds.
KIND_BITS = 6
#: A passage has this many words in either document, and this share of them match.
MIN_WORDS, MIN_MATCH = 40, 0.8
#: Cost of a word between two chained seeds, in either document, in units of a seed's word.
GAP_COST = 0.1
#: A chain is cut where more words than this differ between two seeds.
MAX_GAP = 16
#: Words beyond a chain that the alignment may reach, and how it counts them.
REACH, MISMATCH, DROP = 64, 3, 12
#: Words of a text that are moved together.
BLOCK_WORDS = 128


def _word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-case words, and the first word of each text."""
    data, offsets = flat(pc.utf8_lower(texts.cast(pa.large_string())))
    starts, ends, firsts = words(data, offsets)
    return span_hashes(data, starts, ends), firsts


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """Best of each ``width`` neighbours, from the left one on."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        longer = out.copy()
        longer[:-step] = best(out[:-step], out[step:])
        out, have = longer, have + step
    return out


def _sampled(
    hashes: np.ndarray, firsts: np.ndarray, size: int, window: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and word position of each run of ``size`` words taken."""
    found, at = shingle_hashes(hashes, firsts, size)
    owner = np.repeat(np.arange(len(firsts) - 1), np.maximum(np.diff(firsts) - size + 1, 0))
    top = np.uint64(2**64 - 1)
    # Texts apart by a window, so that no window sees two; windows at a text's end are shorter.
    place = np.arange(len(found)) + owner * window
    row = np.full(len(found) + (len(firsts) + 1) * window, top)
    row[place] = np.minimum(found, top - np.uint64(1))
    least = _sliding(row, window, np.minimum)
    # A value is taken if it is the least of some window: then the greatest such least is its own.
    of_windows = _sliding(np.where(least == top, 0, least)[::-1], window, np.maximum)[::-1]
    taken = np.flatnonzero(of_windows[place] == row[place])
    owner = owner[taken]
    return found[taken], owner, at[taken] - firsts[owner]


def seeds(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, text and word position of each seed, each pair of neighbouring seeds and each long run taken."""
    hashes, firsts = _word_hashes(texts)
    short = _sampled(hashes, firsts, SEED_WORDS, WINDOW)
    long = _sampled(hashes, firsts, RUN_WORDS, RUN_WINDOW)
    gap = np.diff(short[2])
    at = np.flatnonzero((np.diff(short[1]) == 0) & (gap <= WINDOW))
    both = mixed(mixed(short[0][at]) + short[0][at + 1])
    plain = ~np.uint64((1 << KIND_BITS) - 1)
    key = np.concatenate(
        [short[0] & plain, both & plain | gap[at].astype(np.uint64) << np.uint64(1), long[0] & plain | np.uint64(1)]
    )
    return key, np.concatenate([short[1], short[1][at], long[1]]), np.concatenate([short[2], short[2][at], long[2]])


def stretches(pos: np.ndarray, other: np.ndarray) -> list[tuple[int, int, int]]:
    """Start, end and start in the other document of equal stretches that cover all words of long runs.

    Runs that overlap on one diagonal are one stretch; of the others no more are kept than
    it takes to cover the words.
    """
    whole: list[tuple[int, int, int]] = []
    for i in np.lexsort((pos, other - pos)).tolist():
        s, o = int(pos[i]), int(other[i])
        if whole and o - s == whole[-1][2] - whole[-1][0] and s <= whole[-1][1]:
            whole[-1] = (whole[-1][0], s + RUN_WORDS, whole[-1][2])
        else:
            whole.append((s, s + RUN_WORDS, o))
    kept: list[tuple[int, int, int]] = []
    covered, best = -1, None
    for x in sorted(whole):
        if best and x[0] > covered:  # nothing that begins later reaches on from what is covered
            kept.append(best)
            covered, best = best[1], None
        if x[1] > covered and (best is None or x[1] > best[1]):
            best = x
    return kept + [best] if best else kept


def chains(
    pos: np.ndarray, other: np.ndarray, weight: int = SEED_WORDS, plain: bool = True
) -> list[np.ndarray]:
    """Matches (pos, other) as chains that rise in both, best first; each match is in one.

    ``plain``: take a list that is its own best chain as it is; the result is the same.
    """
    order = np.lexsort((other, pos))
    x, y = pos[order], other[order]
    gained = weight * np.arange(len(x)) - GAP_COST * (x + y - (x[:1] + y[:1]))
    rising = (np.diff(x) > 0).all() and (np.diff(y) > 0).all() and (gained[1:] > 0).all()
    if plain and len(x) and rising and (gained[:-1] < gained[-1]).all():
        return [order]  # none is worth a new start and the last scores best: nothing to choose between
    p, q = pos[order].tolist(), other[order].tolist()
    n = len(p)
    rank = np.unique(other[order], return_inverse=True)[1].tolist()
    size = max(rank) + 1 if n else 0
    tree: list[tuple[float, int]] = [(-np.inf, -1)] * (size + 1)
    score, back = [0.0] * n, [-1] * n
    i = 0
    while i < n:
        j = i
        while j < n and p[j] == p[i]:  # equal positions do not chain with each other
            best = (-np.inf, -1)
            at = rank[j]  # ranks below
            while at:
                if tree[at] > best:
                    best = tree[at]
                at &= at - 1
            gained = best[0] - GAP_COST * (p[j] + q[j])
            score[j] = weight + max(gained, 0.0)
            back[j] = best[1] if gained > 0 else -1
            j += 1
        for t in range(i, j):
            value = (score[t] + GAP_COST * (p[t] + q[t]), t)
            at = rank[t] + 1
            while at <= size:
                if value > tree[at]:
                    tree[at] = value
                at += at & -at
        i = j
    used = [False] * n
    found = []
    for i in sorted(range(n), key=lambda t: -score[t]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = back[i]
        if chain:
            found.append(order[np.asarray(chain[::-1])])
    return found


def _reached(same: np.ndarray) -> tuple[int, int]:
    """Words by which a passage extends along a diagonal, and how many of them match."""
    if not len(same):
        return 0, 0
    score = np.cumsum(np.where(same, 1, -MISMATCH))
    peak = np.maximum(np.maximum.accumulate(score), 0)
    stop = np.flatnonzero(peak - score > DROP)
    score = score[: stop[0]] if len(stop) else score
    if not len(score) or score.max() <= 0:
        return 0, 0
    n = int(score.argmax()) + 1
    return n, int(same[:n].sum())


def align(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray, seed: int = SEED_WORDS) -> list[tuple]:
    """Passages (start, end, start in b, end in b, matches) along a chain of matches (p, q)."""
    out = []

    def close(p0, q0, p1, q1, matches):
        room = min(p0, q0)
        n, m = _reached((a[p0 - room : p0] == b[q0 - room : q0])[::-1])
        p0, q0, matches = p0 - n, q0 - n, matches + m
        room = min(len(a) - p1, len(b) - q1)
        n, m = _reached(a[p1 : p1 + room] == b[q1 : q1 + room])
        out.append((p0, p1 + n, q0, q1 + n, matches + m))

    p0, q0 = p1, q1 = int(p[0]), int(q[0])
    p1, q1, matches = p1 + seed, q1 + seed, seed
    for x, y in zip(p[1:].tolist(), q[1:].tolist(), strict=True):
        x1, y1 = x + seed, y + seed
        da, db = x - p1, y - q1
        if da == db and da <= 0:  # overlapping seeds on one diagonal
            matches += x1 - p1
        elif da == db:
            equal = int((a[p1:x] == b[q1:y]).sum())
            if da - equal > MAX_GAP:
                close(p0, q0, p1, q1, matches)
                p0, q0, matches = x, y, 0
                equal = 0
            matches += equal + seed
        else:  # words were put in or left out: what is equal at both ends of the gap counts
            skip = max(0, -min(da, db))
            x, y, da, db = x + skip, y + skip, da + skip, db + skip
            room = min(da, db)
            head = np.flatnonzero(a[p1 : p1 + room] != b[q1 : q1 + room])
            equal = int(head[0]) if len(head) else room
            room -= equal
            tail = np.flatnonzero((a[x - room : x] != b[y - room : y])[::-1])
            equal += int(tail[0]) if len(tail) else room
            if max(da, db) - equal > MAX_GAP:
                close(p0, q0, p1, q1, matches)
                p0, q0, matches, equal, skip = x - skip, y - skip, 0, 0, 0
            matches += equal + seed - skip
        p1, q1 = x1, y1
    close(p0, q0, p1, q1, matches)
    return out


def _seed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch, "text"):
            key, owner, position = seeds(block.column("text"))
            yield pa.RecordBatch.from_pydict(
                {
                    "seed": key.view(np.int64),
                    "doc_id": block.column("doc_id").take(pa.array(owner)),
                    "pos": position.astype(np.int32),
                }
            )


def _seed_matches(row: np.ndarray, pos: np.ndarray, other: np.ndarray, kind: np.ndarray, n: int):
    """Matches of single seeds, each once, by row; a match of a pair stands for both its seeds."""
    short, pair = kind != 1, kind > 1
    gap = kind[pair] >> 1
    row, p, q = (
        np.concatenate([x[short], x[pair] + step]) for x, step in ((row, 0), (pos, gap), (other, gap))
    )
    order = np.lexsort((q, p, row))
    row, p, q = row[order], p[order], q[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (np.diff(row) != 0) | (np.diff(p) != 0) | (np.diff(q) != 0)
    return np.searchsorted(row[new], np.arange(n + 1)), p[new], q[new]


def _chain_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chains of each pair of documents, and the equal stretches that each of them has to show.

    A stretch goes with a chain that reaches it, or is a chain itself.
    """
    for batch in batches:
        met = batch.column("met")
        bounds = np.concatenate(([0], np.cumsum(met.value_lengths().to_numpy())))
        pos, other, kinds = (met.flatten().field(c).to_numpy().astype(np.int64) for c in ("pos", "other", "kind"))
        row = np.repeat(np.arange(len(met)), np.diff(bounds))
        firsts, ps, qs = _seed_matches(row, pos, other, kinds, len(met))
        rows = []
        for r, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist(), strict=False)):
            x, y, of_run = pos[a:b], other[a:b], kinds[a:b] == 1
            p, q = ps[firsts[r] : firsts[r + 1]], qs[firsts[r] : firsts[r + 1]]
            found = [(p[c], q[c], []) for c in chains(p, q) if len(c) >= MIN_SEEDS]
            own = []
            for s, e, o in stretches(x[of_run], y[of_run]) if of_run.any() else ():
                reach = REACH - SEED_WORDS
                for p, q, sure in found:
                    inside = p[0] - reach <= s and e <= p[-1] + reach and q[0] - reach <= o
                    if inside and o + e - s <= q[-1] + reach:
                        sure.append((s, e, o))
                        break
                else:
                    at = np.asarray([s, e - SEED_WORDS])
                    own.append((at, at + (o - s), [(s, e, o)]))
            rows += [(r, n, *chain) for n, chain in enumerate(found + own)]
        if rows:
            at, n, p, q, sure = zip(*rows, strict=True)
            kept = {c: batch.column(c).take(pa.array(at)) for c in ("doc_id", "first_id")}
            ints = pa.list_(pa.int32())
            flat_sure = [[v for x in of for v in x] for of in sure]
            yield pa.RecordBatch.from_pydict(
                kept
                | {"n": pa.array(n, pa.int32()), "p": pa.array(p, ints), "q": pa.array(q, ints)}
                | {"sure": pa.array(flat_sure, ints)}
            )


_CHAIN = "doc_id long, first_id long, n int, p array<int>, q array<int>, sure array<int>"
_BLOCK = "owner long, block int, words binary"
_PASSAGE = "doc_id long, first_id long, start long, n_words long, first_start long, first_n_words long, matches long"


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each text as 32-bit hashes, in blocks."""
    for batch in batches:
        for texts in blocks(batch, "text"):
            hashes, firsts = _word_hashes(texts.column("text"))
            short = (hashes >> np.uint64(32)).astype("<u4")
            counts = -(-np.diff(firsts) // BLOCK_WORDS)
            owner = np.repeat(np.arange(len(counts)), counts)
            number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            start = firsts[owner] + number * BLOCK_WORDS
            end = np.minimum(start + BLOCK_WORDS, firsts[owner + 1])
            cells = [short[a:b].tobytes() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict(
                {
                    "owner": texts.column("doc_id").take(pa.array(owner)),
                    "block": number.astype(np.int32),
                    "words": pa.array(cells, pa.binary()),
                }
            )


def _window(cells: list[dict], side: int, at: np.ndarray) -> tuple[int, np.ndarray]:
    """First word that the alignment may reach and the hashes from there on; of a block given twice the first counts."""
    found: dict[int, bytes] = {}
    for c in cells:
        if c["side"] == side:
            found.setdefault(c["block"], c["words"])
    words_ = np.frombuffer(b"".join(found[i] for i in sorted(found)), "<u4")
    begin = min(found, default=0) * BLOCK_WORDS
    low, high = max(0, int(at[0]) - REACH), int(at[-1]) + SEED_WORDS + REACH
    return low, words_[low - begin : high - begin]


def _long_enough(passages: list[tuple]) -> list[tuple]:
    return [
        x for x in passages
        if min(x[1] - x[0], x[3] - x[2]) >= MIN_WORDS and x[4] >= MIN_MATCH * max(x[1] - x[0], x[3] - x[2])
    ]


def _passage_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(c.split()[0], pa.int64()) for c in _PASSAGE.split(", ")])
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):  # one at a time: the cells of a chain may be many
            r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
            p, q = np.asarray(r["p"], np.int64), np.asarray(r["q"], np.int64)
            (la, a), (lb, b) = _window(r["cells"], 0, p), _window(r["cells"], 1, q)
            p, q = p - la, q - lb
            if p[-1] + SEED_WORDS > len(a) or q[-1] + SEED_WORDS > len(b):
                continue  # seeds of another text with the same doc_id
            passages = _long_enough(align(a, b, p, q))
            sure = iter(r["sure"])
            for s, e, o in zip(sure, sure, sure, strict=True):
                s, e, o = s - la, e - la, o - lb
                if not any(x[0] <= s and e <= x[1] for x in passages):
                    if e > len(a) or o + e - s > len(b):
                        continue  # as above
                    ends = np.asarray([s, e - SEED_WORDS])
                    passages += _long_enough(align(a, b, ends, ends + (o - s)))
            rows += [(r["doc_id"], r["first_id"], s + la, e - s, t + lb, f - t, m) for s, e, t, f, m in passages]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], schema=schema)


def _requests(chained: DataFrame, side: int) -> DataFrame:
    """The blocks of words that the alignment of a chain may need of either document."""
    at, owner = (("p", "doc_id"), ("q", "first_id"))[side]
    low = F.greatest(F.lit(0), F.element_at(at, 1) - REACH)
    high = F.element_at(at, -1) + SEED_WORDS + REACH
    blocks_ = F.sequence(F.floor(low / BLOCK_WORDS), F.floor(high / BLOCK_WORDS))
    asked = chained.select("*", F.col(owner).alias("owner"), F.posexplode(blocks_).alias("nth", "block"))
    chain = [F.when((F.col("nth") == 0) & F.lit(side == 0), F.col(c)).alias(c) for c in ("p", "q", "sure")]
    return asked.select(
        "owner", F.col("block").cast("int").alias("block"), "doc_id", "first_id", "n", F.lit(side).alias("side"), *chain
    )


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Passages that an earlier document has, too; one row per pair of stretches.

    doc_id, first_id (the smallest doc_id of those that share it), start and n_words in
    doc_id, first_start and first_n_words in first_id, matches: words, counted from 0,
    lower case and separated by ASCII white space. Null texts and those shorter than a
    passage give no rows, nor do repeats inside one document, nor rows without doc_id;
    rows that repeat a doc_id count as one document and pass on one of their texts. An
    empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    found = stored(rows.mapInArrow(_seed_rows, "seed long, doc_id long, pos int"), "seeds")
    first = F.min("doc_id").alias("first_id")
    shared = found.groupBy("seed").agg(first, F.max("doc_id").alias("last_id")).where("first_id < last_id")
    # Most seeds are of one document: all are exchanged for two numbers, then once to leave those
    # out, and their places go with the few that are left. What is joined is stored, so both
    # sides are exchanged and Spark can split a frequent seed.
    shared = found.join(stored(shared.select("seed", "first_id"), "first-holders"), "seed")
    shared = stored(shared, "shared-seeds")
    held = shared.where("doc_id = first_id").groupBy("seed").agg(F.min("pos").alias("other"))
    held = stored(held, "first-places")
    kind = F.col("seed").bitwiseAND(F.lit((1 << KIND_BITS) - 1))

    def passages(wanted, enough, spans: DataFrame | None = None) -> DataFrame:
        matches = shared.where(wanted).where("doc_id <> first_id").join(held.where(wanted), "seed")
        matches = matches.withColumn("kind", kind.cast("int"))
        if spans is not None:
            inside = F.exists("spans", lambda s: (s["start"] <= F.col("pos")) & (pair_end <= s["end"]))
            matches = matches.join(spans, "doc_id", "left").where(~F.coalesce(inside, F.lit(False)))
        pairs = matches.groupBy("doc_id", "first_id").agg(F.collect_list(F.struct("pos", "other", "kind")).alias("met"))
        chained = stored(pairs.where(enough).mapInArrow(_chain_rows, _CHAIN), "chains")
        asked = _requests(chained, 0).unionByName(_requests(chained, 1))
        given = asked.join(rows.mapInArrow(_block_rows, _BLOCK), ["owner", "block"])
        cells = F.collect_list(F.struct("side", "block", "words")).alias("cells")
        both = given.groupBy("doc_id", "first_id", "n").agg(*(F.max(c).alias(c) for c in ("p", "q", "sure")), cells)
        return both.where("p is not null").drop("n").mapInArrow(_passage_rows, _PASSAGE)

    met = (F.size("met") >= MIN_SEEDS) | F.exists("met", lambda m: m["kind"] == 1)
    whole = stored(passages(kind <= 1, met).distinct(), "whole-passages")
    # Pairs of seeds tell only of words that are in no passage yet.
    pair_end = F.col("pos") + F.shiftright("kind", 1) + SEED_WORDS
    span = F.struct("start", (F.col("start") + F.col("n_words")).alias("end"))
    spans = whole.groupBy("doc_id").agg(F.collect_set(span).alias("spans"))
    return whole.unionByName(passages(kind > 1, F.lit(True), spans)).distinct()


def without_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``docs`` without the words of ``passages`` in their texts; n_chars is counted anew.

    A document that loses all its words goes; one that loses none stays as it is, byte for
    byte. White space before a word goes with it.
    """
    taken = "_" * (1 + max(map(len, docs.columns)))  # in no column's name
    id_name, cuts_name = f"id{taken}", f"cuts{taken}"
    span = F.struct("start", (F.col("start") + F.col("n_words")).alias("end"))
    spans = passages.groupBy(F.col("doc_id").alias(id_name)).agg(F.sort_array(F.collect_set(span)).alias(cuts_name))
    kept = docs.columns
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = batch.column(cuts_name).to_pylist()
            touched = [i for i, c in enumerate(cuts) if c]
            texts = batch.column("text").to_pylist()
            lost = set()
            for i in touched:
                texts[i] = cut_words(texts[i] or "", [(c["start"], c["end"]) for c in cuts[i]])
                if not texts[i].strip():
                    lost.add(i)
            columns = {c: batch.column(c) for c in kept}
            columns["text"] = pa.array(texts, columns["text"].type)
            if "n_chars" in columns and touched:
                counts = columns["n_chars"].to_pylist()
                for i in touched:
                    counts[i] = len(texts[i])
                columns["n_chars"] = pa.array(counts, columns["n_chars"].type)
            out = pa.RecordBatch.from_arrays([columns[c] for c in kept], names=kept)
            if lost:
                out = out.filter(pa.array([i not in lost for i in range(len(texts))], pa.bool_()))
            yield out

    joined = docs.join(spans.hint("merge"), F.col("doc_id") == F.col(id_name), "left").drop(id_name)
    return joined.mapInArrow(run, schema)


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words in ``spans`` and the white space before each of them."""
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    if not len(data):
        return text
    starts, ends, _ = words(data, np.asarray([0, len(data)]))
    begin = np.concatenate(([0], ends))
    out, at = [], 0
    for s, e in sorted(spans):
        s, e = min(s, len(starts)), min(e, len(starts))
        if e <= s:
            continue
        out.append(raw[at : max(at, int(begin[s]))])
        at = max(at, int(begin[e]))
    out.append(raw[at:])
    return b"".join(out).decode()
