"""Near-duplicate classes by order MinHash, verified by banded alignment.

Every text becomes a sequence of 5-word shingles, each labelled with its occurrence number.  For each of ``SKETCHES``
orders the ``PICKED`` smallest labelled shingles are taken and kept *in text order*; that tuple is one key, so agreeing
keys need common shingles in the same order, as texts at a small edit distance have.  Candidates are verified by the
word edit similarity ``1 - distance / longer length``, at least 0.8, with an alignment inside a band.

Equal texts collapse into one node first.  Texts then meet in rounds, each of which only takes pairs that are not in one
component yet:

1. every text meets one leader: of the leaders of its buckets (equal key) the one it shares most buckets with.  A
   bucket's leader is its best connected member, so a group of copies has nearly one leader, and takes one alignment a
   member;
2. every text meets the other leaders of its buckets;
3. components that still share a bucket meet: first by their most agreeing pair, then by the agreeing ones, then by all.

Every pair that shares a key ends in one class, or in two classes after an alignment or a lossless count told it apart.
Groups of similar texts take linear work; texts of dissimilar components that share a bucket are compared by their word
counts (in buckets of more than ``LARGE`` only where both have one of the rare word pairs that similar texts have in common) and
aligned only where those leave room.

Share of the pairs of texts that share a key, by word edit similarity, the edits spread evenly over 40 to 1,000 words:
0.8 to 0.9 at 0.80, 0.9 to 0.95 at 0.82, 0.95 to 1.0 at 0.85, 1.0 from 0.9 on.  Null and blank texts are classes of their
own.  Node ids are 64-bit hashes of the word sequence.  A class is named by its smallest doc_id; repeated rows share
their class; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gridloom.llm.common import in_tasks, marked, saved, table
from gridloom.llm.components import components, joined_components
from gridloom.llm.tokens import mix64, word_hashes

WORDS, SKETCHES, PICKED, LEAST = 5, 64, 2, 0.8
AGREE = 12  # of the SKETCHES single minima: such pairs between components are verified first, the others after them
BAG, BLOCK, LARGE = 128, 512, 16
FOLD, HEAD, PAIRS = 512, 64, 1 << 18  # see _meetings
FACTORS = mix64(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of the occurrence-labelled shingles of ``WORDS`` words, in text order (shorter texts: one shingle)."""
    n = max(len(words) - WORDS + 1, 1)
    out = np.full(n, len(words) if len(words) < WORDS else WORDS, dtype=np.uint64)
    for j in range(min(WORDS, len(words))):
        out = out * np.uint64(0x2545F4914F6CDD1D) + words[j : j + n]
    out = mix64(out)
    order = np.argsort(out, kind="stable")
    ranked = out[order]
    fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    if not fresh.all():
        first = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        label = np.empty(n, dtype=np.uint64)
        label[order] = (np.arange(n) - first).astype(np.uint64)
        out = np.where(label > 0, mix64(out + label * np.uint64(0x9E3779B97F4A7C15)), out)
    return out


def sketch(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, minima): per order the key of the picked shingles, and 16 bits of the smallest one."""
    s = shingles(words)
    k = min(PICKED, len(s))
    keys, least = np.empty(SKETCHES, np.uint64), np.empty(SKETCHES, np.uint64)
    rows = max(1, 2_000_000 // len(s))  # bounds the memory for very long texts
    for at in range(0, SKETCHES, rows):
        factors = FACTORS[at : at + rows]
        values = s[None, :] * factors[:, None]
        values ^= values >> np.uint64(29)
        order, picked = np.arange(len(factors)), np.empty((len(factors), k), np.int64)
        for j in range(k):
            picked[:, j] = values.argmin(axis=1)
            values[order, picked[:, j]] = np.uint64(0xFFFFFFFFFFFFFFFF)
        least[at : at + rows] = s[picked[:, 0]] >> np.uint64(48)
        picked.sort(axis=1)
        key = factors.copy()
        for j in range(k):
            key = mix64(key + s[picked[:, j]])
        keys[at : at + rows] = key
    return keys, least


def node_id(words: np.ndarray) -> int:
    """Signed 64-bit hash of a word sequence."""
    spread = mix64(words + mix64(np.arange(1, len(words) + 1, dtype=np.uint64)))
    return int(mix64(np.array([np.add.reduce(spread)], np.uint64) + np.uint64(len(words))).view(np.int64)[0])


def _sketches(batches):
    for batch in batches:
        nodes, lengths, keys, minima, bags = [], [], [], [], []
        for text in batch["text"]:
            words = word_hashes(text) if isinstance(text, str) else ()
            if len(words) == 0:
                for out in (nodes, lengths, keys, minima, bags):
                    out.append(None)
                continue
            k, m = sketch(words)
            nodes.append(node_id(words))
            lengths.append(len(words))
            keys.append(k.view(np.int64))
            minima.append(m.astype(np.uint16).view(np.int16))
            bags.append(np.bincount((words >> np.uint64(40)).astype(np.int64) % BAG, minlength=BAG).astype(np.int32))
        yield pd.DataFrame({"doc_id": batch["doc_id"], "h": batch["h"], "node": pd.array(nodes, dtype="Int64"),
                            "n_words": pd.array(lengths, dtype="Int64"), "keys": keys, "minima": minima, "bag": bags})


def banded_distance(a: list[int], b: list[int], most: int) -> int:
    """Edit distance of two sequences if at most ``most``, else ``most + 1``.

    Only the ``2 * most + 1`` diagonals around the main one are kept, one bit each, in whole-number words; each step
    moves the band down one row of ``b`` (bit-vector form of the alignment recurrence along diagonals).
    """
    if len(a) > len(b):
        a, b = b, a
    lo = 0
    while lo < len(a) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < len(a) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    n, m = len(a), len(b)
    if m - n > most:
        return most + 1
    if not n:
        return m
    most_here = min(most, m)
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    if 2 * most_here + 1 >= n:  # the band covers the short side: plain columns
        full = (1 << n) - 1
        plus, minus, score, top = full, 0, n, 1 << (n - 1)
        for x in b:
            eq = where.get(x, 0)
            d0 = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
            hp, hn = minus | (full & ~(d0 | plus)), d0 & plus
            score += bool(hp & top) - bool(hn & top)
            hp, hn = (hp << 1 | 1) & full, (hn << 1) & full
            plus, minus = hn | (full & ~(d0 | hp)), d0 & hp
        return min(score, most + 1)
    return _band(where, n, b, most_here, most)


def _band(where: dict[int, int], n: int, b: list[int], k: int, most: int) -> int:
    """Cells (i, j) with |i - j| <= k, column by column of ``b``; bit r of a column is row ``j - k + r``."""
    width = 2 * k + 1
    full = (1 << width) - 1
    # Column 0: rows -k..k; rows from 1 on rise by one, the rows above the matrix are flat (never better).
    plus, minus = full & ~((1 << (k + 1)) - 1), 0
    score = k  # of the lowest cell of the band (row j + k)
    for j, x in enumerate(b, 1):
        # The band moves down by one row: rows j-k .. j+k; the new lowest row counts as one above its neighbour.
        plus, minus = (plus >> 1) | 1 << (width - 1), minus >> 1
        score += 1
        shift = j - k - 1  # bit r stands for a[j - k + r - 1]
        eq = where.get(x, 0)
        eq = (eq >> shift if shift >= 0 else eq << -shift) & full
        d0 = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
        hp, hn = minus | (full & ~(d0 | plus)), d0 & plus
        low = 1 << (width - 1)
        score += bool(hp & low) - bool(hn & low)
        if score - 2 * k > most:
            return most + 1
        hp, hn = (hp << 1 | (1 if j <= k else 0)) & full, (hn << 1) & full
        plus, minus = hn | (full & ~(d0 | hp)), d0 & hp
    # Walk up from the lowest row to row n.
    m = len(b)
    for r in range(width - 1, n - (m - k) - 0, -1):
        score -= bool(plus >> r & 1) - bool(minus >> r & 1)
    return min(score, most + 1)


def edit_similar(a: str, b: str, least: float = LEAST) -> bool:
    """Word edit similarity of two texts at least ``least``; the band widens until it decides."""
    x, y = word_hashes(a).tolist(), word_hashes(b).tolist()
    longer = max(len(x), len(y))
    most = int((1 - least) * longer + 1e-9)
    if abs(len(x) - len(y)) > most:
        return False
    shared = sum((Counter(x) & Counter(y)).values())  # each word without a partner costs an edit
    if longer - shared > most:
        return False
    band = min(most, 24)
    while True:
        if banded_distance(x, y, band) <= band:
            return True
        if band == most:
            return False
        band = min(most, band * 4)


def _verify(batches):
    for batch in batches:
        good = [edit_similar(a, b) for a, b in zip(batch["text_a"], batch["text_b"], strict=True)]
        yield batch.loc[good, ["a", "b"]]


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are similar; ``texts`` is (node, text)."""
    one = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return saved(in_tasks(pairs.join(one, "a").join(two, "b"), _verify, "a long, b long"))


def _stars(members: DataFrame) -> DataFrame:
    """(a, b, shared, degree, n_a, n_b): each node ``b`` with the leaders ``a`` of its buckets, and how many they share.

    A node's degree is the size of its buckets in all; a bucket's leader is its member of largest degree.  In a group
    around one original that is nearly always the same node, whatever the bucket.
    """
    degree = members.groupBy("node").agg(F.sum("n").alias("degree")).withColumnRenamed("node", "__node")
    placed = members.join(degree, F.col("node") == F.col("__node")).drop("__node")
    top = F.struct("degree", "node", "n_words")
    leaders = saved(placed.groupBy("key").agg(F.max(top).alias("top")).select(F.col("key").alias("__key"), "top.*").toDF(
        "__key", "degree", "a", "n_a"))
    met = members.join(leaders, F.col("key") == F.col("__key")).where("a != node")
    return saved(met.groupBy("a", F.col("node").alias("b")).agg(
        F.count(F.lit(1)).alias("shared"), F.max("degree").alias("degree"), F.max("n_a").alias("n_a"), F.max("n_words").alias("n_b")).where(
        F.least("n_a", "n_b") >= LEAST * F.greatest("n_a", "n_b")))


def _roomy(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose word counts leave room for the similarity (see :func:`_across`)."""
    one = nodes.select(F.col("node").alias("a"), F.col("n_words").alias("n_a"), F.col("bag").alias("bag_a"))
    two = nodes.select(F.col("node").alias("b"), F.col("n_words").alias("n_b"), F.col("bag").alias("bag_b"))
    shared = F.aggregate(F.zip_with("bag_a", "bag_b", lambda a, b: F.least(a, b)), F.lit(0), lambda s, x: s + x)
    return pairs.join(one, "a").join(two, "b").where(shared >= LEAST * F.greatest("n_a", "n_b") - 1e-6).select("a", "b")


def pairs_of_words(words: np.ndarray) -> np.ndarray:
    """32-bit numbers of the pairs of neighbouring words (of one word: of that word)."""
    both = words[:-1] * np.uint64(0x2545F4914F6CDD1D) + words[1:] if len(words) > 1 else words
    return (mix64(both) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _words_of(batches):
    """The distinct word pairs of a text, how often it has each, and its words folded into counters."""
    for batch in batches:
        ids, counts, fine, bins, held = [], [], [], [], []
        for text in batch["text"]:
            words = word_hashes(text)
            pair, n = np.unique(pairs_of_words(words), return_counts=True)
            ids.append(pair)
            counts.append(n.astype(np.int32))
            word, n = np.unique((words >> np.uint64(32)).astype(np.uint32), return_counts=True)
            # Texts with many words are told by fewer counters, so that a row is bounded; folding only hides differences.
            fine.append(len(word) <= FOLD)
            spots = (word & np.uint32(0xFFFF)).astype(np.int64)
            spots, inverse = np.unique(spots if fine[-1] else spots % FOLD, return_inverse=True)
            held.append(np.bincount(inverse, weights=n).astype(np.int32))
            bins.append(spots.astype(np.uint16).view(np.int16))
        yield batch.drop(columns="text").assign(ids=ids, counts=counts, fine=fine, bins=bins, held=held)


def _rare(batches, block: int):
    """One row for each rare word pair of each text (see :func:`_meetings`) and each cell it is in."""
    columns = ("word", "i", "j", "block", "rank", "node", "comp", "n_words", "fine", "shared", "bins", "held", "head")
    out: list[tuple] = []
    for batch in batches:
        names = ("node", "comp", "n_words", "shared", "fine", "bins", "held", "met")
        for node, comp, n_words, shared, fine, bins, held, met in zip(*(batch[c] for c in names), strict=True):
            met = sorted((m["n"], m["id"], m["often"]) for m in met)
            # The pairs of one component come first, and meet nobody.
            weight = max(n_words - 1, 1) - sum(m[2] for m in met)
            most, rare = 2 * (1 - LEAST) * n_words + 1e-6, []
            for seen, pair, often in met:
                if weight > most:
                    break
                rare.append((seen, pair))
                weight += often
            head = np.array([pair for _, pair in rare[:HEAD]], np.int32)
            for rank, (seen, pair) in enumerate(rare):
                blocks = -(-seen // block)
                own = int(mix64(np.array([node], np.int64).view(np.uint64))[0] % np.uint64(blocks)) if blocks > 1 else 0
                out += [(pair, min(own, x), max(own, x), own, rank, node, comp, n_words, fine, shared, bins, held, head) for x in range(blocks)]
                if len(out) >= 1024:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
    if out:
        yield pd.DataFrame(out, columns=columns)


def _meet(batches):
    """Pairs (a, b) of texts of a cell (its rows come together) that differ in component and may be similar."""
    held = None
    for batch in batches:
        held = batch if held is None else pd.concat([held, batch], ignore_index=True)
        cell = held[["word", "i", "j"]].to_numpy()
        last = int((cell == cell[-1]).all(axis=1).argmax()) if len(held) else 0  # the last cell may go on
        if last:
            yield from _cells(held.iloc[:last])
            held = held.iloc[last:].reset_index(drop=True)
    if held is not None and len(held):
        yield from _cells(held)


def _cells(rows: pd.DataFrame):
    """The pairs of :func:`_meet` in whole cells; ``PAIRS`` or one row's partners are compared at a time."""
    cell = rows[["word", "i", "j"]].to_numpy()
    new = np.concatenate([[True], (cell[1:] != cell[:-1]).any(axis=1)])
    ends = np.concatenate([np.flatnonzero(new)[1:], [len(rows)]])[np.cumsum(new) - 1]
    node, comp, n, block, rank, fine = (rows[c].to_numpy() for c in ("node", "comp", "n_words", "block", "rank", "fine"))
    split = rows["i"].to_numpy() != rows["j"].to_numpy()
    bins, held, heads = rows["bins"].to_list(), rows["held"].to_list(), rows["head"].to_list()
    shared = [frozenset(keys.tolist()) for keys in rows["shared"]]
    folded = np.zeros((len(rows), FOLD), np.int32)
    head = np.full((len(rows), HEAD), np.iinfo(np.int64).max)
    for k in range(len(rows)):
        np.add.at(folded[k], bins[k].view(np.uint16) % FOLD, held[k])
        head[k, : len(heads[k])] = heads[k]
    later = ends - np.arange(len(rows)) - 1  # partners of a row: those behind it in its cell
    upto = np.cumsum(later)
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, side="right")))
        x = np.repeat(np.arange(at, to), later[at:to])
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(later[at:to]) - later[at:to], later[at:to])
        at = to
        longer = np.maximum(n[x], n[y])
        good = (comp[x] != comp[y]) & (np.minimum(n[x], n[y]) >= LEAST * longer) & (~split[x] | (block[x] != block[y]))
        x, y, least = x[good], y[good], LEAST * longer[good] - 1e-6
        a, b = [], []
        for k in range(0, len(x), 4096):
            p, q, need = x[k : k + 4096], y[k : k + 4096], least[k : k + 4096]
            roomy = np.minimum(folded[p], folded[q]).sum(axis=1) >= need
            p, q, need = p[roomy], q[roomy], need[roomy]
            # Texts with an earlier rare word in common have met there.
            column = np.arange(HEAD)
            before = np.where(column < rank[p][:, None], head[p], -(1 << 40)), np.where(column < rank[q][:, None], head[q], 1 << 40)
            met = np.zeros(len(p), bool)
            for c in range(int(min(rank[p].max(initial=0), HEAD))):
                met |= (before[0][:, c : c + 1] == before[1]).any(axis=1)
            for u, v, m in zip(p[~met], q[~met], need[~met], strict=True):
                if shared[u].isdisjoint(shared[v]):
                    continue
                if fine[u] and fine[v]:
                    _, s, t = np.intersect1d(bins[u], bins[v], assume_unique=True, return_indices=True)
                    if np.minimum(held[u][s], held[v][t]).sum() < m:
                        continue
                a.append(min(node[u], node[v]))
                b.append(max(node[u], node[v]))
        if a:
            yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def _meetings(nodes: DataFrame, block: int) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (node, comp, n_words, shared, text) that share a key, of different components, with room.

    An edit costs a text at most two of its pairs of neighbouring words, so similar texts of n words each share all but 0.4 n
    of these.  Order all pairs, and take of each text the first ones that make up more than that.  Two texts without a common
    pair among these differ in the whole of the text whose pairs end first, which is more than the similarity allows.  So
    texts meet at their rare word pairs, and what very many texts have in common, as a passage, brings nobody together.  Any
    order is right; in this one the pairs of a single component, which need no row, are first, the others by their number of
    texts.  The texts of a pair that is frequent all the same meet block by block.
    """
    words = saved(in_tasks(nodes, _words_of, "node long, comp long, n_words long, shared array<long>, ids array<int>, "
                                             "counts array<int>, fine boolean, bins array<smallint>, held array<int>"))
    spots = words.select("node", "comp", F.explode(F.arrays_zip(F.col("ids").alias("id"), F.col("counts").alias("often"))).alias("x"))
    spots = spots.select("node", "comp", "x.id", "x.often")
    seen = spots.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    common = saved(seen.where("lo < hi").select(F.col("id").alias("__id"), "n"))
    met = spots.drop("comp").join(common, F.col("id") == F.col("__id")).groupBy("node").agg(
        F.collect_list(F.struct("n", "id", "often")).alias("met"))
    schema = ("word int, i int, j int, block int, rank int, node long, comp long, n_words long, fine boolean, "
              "shared array<long>, bins array<smallint>, held array<int>, head array<int>")
    rows = in_tasks(words.drop("ids", "counts").join(met, "node"), lambda batches: _rare(batches, block), schema)
    dealt = rows.repartition("word", "i", "j").sortWithinPartitions("word", "i", "j")
    return in_tasks(dealt, _meet, "a long, b long").distinct()


def _small_buckets(placed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b, agree, ca, cb) that share a bucket of ``placed`` (key, node, comp, n_words), all of bounded size."""
    # Similar texts are of one band of lengths or of neighbouring ones, so texts of very different lengths never meet.
    band = F.floor(F.log("n_words") / math.log(1.001 / LEAST))
    lower = F.explode(F.array(F.lit(False), F.lit(True))).alias("lower")
    placed = placed.select("key", "node", "comp", band.alias("band"), lower)
    placed = saved(placed.select(F.xxhash64("key", F.col("band") + F.col("lower").cast("int")).alias("key"), "node", "comp", "lower"))
    # Without a text of the upper band, the lower one has met in its own.
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("lower").alias("lower"))
    chosen = placed.join(saved(mixed.where("lo < hi and not lower").select("key")), "key").select("key", "comp", "node").distinct()
    cells = saved(chosen.join(nodes.select("node", "n_words", "minima", "bag"), "node"))
    left, right = cells.alias("l"), cells.alias("r")
    longer = F.greatest("l.n_words", "r.n_words")
    near = F.least("l.n_words", "r.n_words") >= LEAST * longer
    shared = F.aggregate(F.zip_with("l.bag", "r.bag", lambda a, b: F.least(a, b)), F.lit(0), lambda s, x: s + x)
    roomy = shared >= LEAST * longer - 1e-6
    met = left.join(right, (F.col("l.key") == F.col("r.key")) & (F.col("l.comp") != F.col("r.comp"))
                    & (F.col("l.node") < F.col("r.node")) & near & roomy)
    return met.select(F.col("l.node").alias("a"), F.col("r.node").alias("b"), _agree("l.minima", "r.minima").alias("agree"),
                      F.col("l.comp").alias("ca"), F.col("r.comp").alias("cb")).distinct()


def _agree(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)


def _across(members: DataFrame, nodes: DataFrame, comps: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b, agree, ca, cb) of nodes of different components that share a bucket and may be similar.

    ``members``: (key, node, n_words); ``agree`` counts the equal minima.  The word counts of a pair must leave room for
    the similarity: an edit moves at most one word of either text, and folding counts only hides differences, so this
    test loses nothing.  The members of a bucket of at most ``LARGE`` meet directly, those of larger ones by their rare
    words (see :func:`_meetings`).
    """
    own = F.coalesce("comp", "node").alias("comp")
    placed = saved(members.join(comps, "node", "left").select("key", "node", "n_words", own))
    mixed = saved(placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n")).where(
        "lo < hi").select(F.col("key").alias("__key"), (F.col("n") > LARGE).alias("large")))
    placed = saved(placed.join(mixed, F.col("key") == F.col("__key")).drop("__key"))
    direct = _small_buckets(placed.where("not large").drop("large"), nodes)
    large = placed.where("large").groupBy("node", "comp", "n_words").agg(F.collect_set("key").alias("shared"))
    chosen = saved(large.join(nodes.select("node", "minima"), "node"))
    if chosen.isEmpty():
        return direct
    pairs = saved(_meetings(chosen.select("node", "comp", "n_words", "shared").join(texts, "node"), BLOCK))
    one, two = (chosen.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}"), F.col("minima").alias(f"minima_{x}")) for x in "ab")
    rare = pairs.join(one, "a").join(two, "b").select("a", "b", _agree("minima_a", "minima_b").alias("agree"), "ca", "cb")
    return direct.union(rare).distinct()


def _apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs (a, b) whose nodes are still in different components."""
    side = comps.select(F.col("node").alias("n"), F.col("comp").alias("c"))
    out = pairs.select("a", "b").join(side.withColumnsRenamed({"n": "a", "c": "ca"}), "a", "left").join(
        side.withColumnsRenamed({"n": "b", "c": "cb"}), "b", "left")
    return out.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, h, node, comp, class_id): one row per row of ``docs``.

    ``h`` is a hash of the text, ``node`` one of its words, ``comp`` the class's smallest node.
    """
    light = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{text}`")).alias("h"))
    id_type = light.schema["doc_id"].dataType.simpleString()
    rows = saved(in_tasks(
        light, _sketches, f"doc_id {id_type}, h long, node long, n_words long, keys array<long>, minima array<smallint>, bag array<int>"))
    # One row per node speaks for it; equal nodes have equal sketches.
    first = F.min_by(F.struct("doc_id", "n_words", "keys", "minima", "bag"), F.struct(F.col("doc_id").isNull(), "doc_id"))
    nodes = saved(rows.where("node is not null").groupBy("node").agg(first.alias("first")).select("node", "first.*"))
    keyed = nodes.select("node", "n_words", F.explode("keys").alias("key"))
    full = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumnRenamed("key", "__key")
    members = saved(keyed.join(full, F.col("key") == F.col("__key")).select("key", "node", "n_words", "n"))
    shared = saved(members.select("node").distinct())
    wanted = saved(nodes.select("node", "doc_id").join(shared, "node").select("doc_id"))
    likely = marked(light.drop("h"), "doc_id", wanted, "doc_id").where("__marked")
    known = in_tasks(likely.where(F.col("text").isNotNull()).select("text"), _with_node, "node long, text string")
    texts = saved(known.join(shared, "node", "left_semi").dropDuplicates(["node"]))
    star = _stars(members)
    nearest = star.groupBy("b").agg(F.max_by("a", F.struct("shared", "degree", "a")).alias("a")).select("a", "b")
    comps = components(_verified(saved(nearest), texts))
    keys = members.select("key", "node", "n_words")

    def linked(pairs: DataFrame, comps: DataFrame) -> DataFrame:
        found = _verified(saved(pairs), texts)
        return comps if found.isEmpty() else joined_components(comps, found)

    comps = linked(_roomy(_apart(star, comps), nodes), comps)
    rest = saved(_across(keys, nodes, comps, texts))
    best = rest.groupBy(F.least("ca", "cb").alias("lo"), F.greatest("ca", "cb").alias("hi")).agg(
        F.max_by(F.struct("a", "b"), F.struct("agree", "a", "b")).alias("pair")).select("pair.a", "pair.b")
    comps = linked(best, comps)
    comps = linked(_apart(rest.where(F.col("agree") >= AGREE), comps), comps)
    comps = linked(_apart(rest.where(F.col("agree") < AGREE), comps), comps)
    named = saved(nodes.select("node", F.col("doc_id").alias("first_id")).join(comps, "node", "left").select("node", "first_id", F.coalesce("comp", "node").alias("comp")))
    classes = saved(named.groupBy("comp").agg(F.min("first_id").alias("class_id")))
    named = named.join(classes, "comp").select("node", "comp", "class_id")
    out = rows.select("doc_id", "h", "node").join(named, "node", "left")
    alone = F.col("node").isNull()
    return out.select("doc_id", "h", "node", "comp", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def _with_node(batches):
    """(node, text) of all texts with a word."""
    for batch in batches:
        hashed = [word_hashes(text) for text in batch["text"]]
        good = np.array([len(words) > 0 for words in hashed], bool)
        yield batch[good].assign(node=np.array([node_id(words) for words in hashed if len(words)], np.int64))[["node", "text"]]


def survivors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class (its smallest id), with the columns of ``docs``; null and blank texts all stay.

    An id with several texts counts as several documents.  Of repeated rows one stays.
    """
    classes = saved(near_duplicates(docs, doc_id, text).where("node is not null").select("doc_id", "h", "comp"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h"))
    chosen = saved(classes.groupBy("comp").agg(first.alias("first")))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("h") == F.col("first.h"))
    gone = saved(classes.join(chosen, "comp").where(~stays).select(
        F.col("doc_id").alias("__id"), F.col("h").alias("__h"), F.xxhash64("doc_id", "h").alias("__gone")).distinct())
    # Most rows are certainly kept and need no shuffle; the others are compared one by one.
    value = F.col(f"`{text}`")
    keyed = docs.withColumns({"__doc": F.col(f"`{doc_id}`"), "__text": F.xxhash64(value)})
    likely = marked(keyed.withColumn("__key", F.xxhash64("__doc", "__text")), "__key", gone, "__gone")
    sure = likely.where(~F.col("__marked"))
    tested = likely.where("__marked").join(
        gone, F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__h")), "left_anti")
    kept = sure.union(tested).select(*[F.col(f"`{c}`") for c in docs.columns])
    if classes.groupBy("doc_id", "h").count().where("count > 1").isEmpty():
        return kept
    blank = F.coalesce(F.trim(value), F.lit("")) == ""
    return kept.where(~blank).dropDuplicates([doc_id, text]).union(kept.where(blank))


def op9_order_minhash(spark, sf_dir: str) -> DataFrame:
    rows = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "class_id")
