"""Spelling variants: words one edit apart, by k-d trees over letter counts.

A word is placed by how often it has each letter (26 counters for a-z, 6 that the other letters share).  Inserting or
deleting a letter changes one counter by one, replacing a letter changes two, so words one edit apart lie at an L1
distance of at most two: at most one counter up and one down.  For each pair of lengths that differ by at most one, the
words of one length are searched for in a k-d tree of the other; a subtree whose bounding box needs more than that is
passed over, and what is left is verified letter by letter.

The top of the tree is fitted on a bounded sample of words (``SAMPLE``) and sent to the tasks; it only decides who
meets whom.  Every word is filed in one cell and asked in every cell its neighbours can be in.  Cells are counted first
and cut into blocks of at most about ``FILED`` filed and ``ASKED`` asked words, so a task's memory does not grow with
the vocabulary, not even where very many words have the same letters.  Each asked word comes back from a block with its
number of near words and the best of them; both merge by partial aggregation.

Null and empty texts have no words; repeated rows count their words again; an empty table gives no rows.  Words of any
length and alphabet are allowed; a word must not be repeated in the vocabulary.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gridloom.llm.common import in_tasks, saved, ship_package, table
from gridloom.llm.tokens import codepoints, mix64

PLAIN, SHARED = 26, 6  # counters of their own, counters of all other letters
DIMS = PLAIN + SHARED
MOST = 100  # counters stop here; that never makes a distance larger
SAMPLE = 20_000  # words that the top of the tree is fitted on
FILED, ASKED = 65_536, 65_536  # words of a block
LEAF, PAIRS = 256, 4_000_000  # words of a leaf; pairs looked at together


# ---- letters ---------------------------------------------------------------------------------------------------------


class Words:
    """Words of one length: their letters, counters, and a sum that tells other letters from the same ones."""

    def __init__(self, words: list[str], at: np.ndarray):
        length = len(words[0])
        self.at = at  # the words' places in the whole block
        self.codes = codepoints("".join(words)).reshape(len(words), length)
        self.counts = np.empty((len(words), DIMS), dtype=np.int8)
        self.sums = np.empty(len(words), dtype=np.uint64)
        step = max(1, 2_000_000 // length)
        for i in range(0, len(words), step):
            codes = self.codes[i : i + step].astype(np.int64)
            self.counts[i : i + step] = counters(codes)
            self.sums[i : i + step] = mix64(codes.astype(np.uint64) + np.uint64(1)).sum(axis=1, dtype=np.uint64)


def counters(codes: np.ndarray) -> np.ndarray:
    """Counts per counter of each row of letters."""
    plain = (codes >= 97) & (codes <= 122)
    dim = np.where(plain, codes - 97, PLAIN + codes % SHARED)
    dim += np.arange(len(codes))[:, None] * DIMS
    return np.minimum(np.bincount(dim.ravel(), minlength=len(codes) * DIMS), MOST).reshape(len(codes), DIMS).astype(np.int8)


def by_length(words: np.ndarray) -> dict[int, Words]:
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    return {int(n): Words(words[at].tolist(), at) for n in np.unique(lengths) for at in [np.flatnonzero(lengths == n)]}


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of letters ``a``, ``b`` differ by exactly one edit; ``b`` is as long as ``a`` or one longer."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    length = a.shape[1]
    ahead, behind = a != b[:, :-1], (a != b[:, 1:])[:, ::-1]
    same = [np.where(x.any(axis=1), x.argmax(axis=1), length) if length else np.zeros(len(a), int) for x in (ahead, behind)]
    return same[0] + same[1] >= length


# ---- the tree --------------------------------------------------------------------------------------------------------


def best_cut(points: np.ndarray):
    """(dimension, threshold): the most even cut of the points into at most / more; None where all are equal."""
    low, high = points.min(axis=0), points.max(axis=0)
    open_ = np.flatnonzero(high > low)
    if not len(open_):
        return None
    spread = points[:, open_].astype(np.float32).var(axis=0)
    best = None
    for d in open_[np.argsort(-spread, kind="stable")[:4]]:
        shares = np.cumsum(np.bincount(points[:, d].astype(np.int64) - int(low[d])))[:-1] / len(points)
        t = int(np.abs(shares - 0.5).argmin())
        if best is None or abs(shares[t] - 0.5) < best[0]:
            best = (abs(shares[t] - 0.5), int(d), t + int(low[d]))
    return best[1:]


def within(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Points from which one counter up and one down can lead into the box."""
    # A product with ones sums faster than sum() over short rows; counters are small, so it is exact.
    ones = np.ones(points.shape[1], dtype=np.float32)
    up = np.maximum(low - points, 0).astype(np.float32) @ ones
    ok = np.flatnonzero(up <= 1)
    down = np.maximum(points[ok] - high, 0).astype(np.float32) @ ones
    out = np.zeros(len(points), dtype=bool)
    out[ok] = down <= 1
    return out


class Tree:
    """k-d tree with the exact bounding box of each subtree."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.nodes = []  # (low, high, members or None, left, right)
        todo = [(np.arange(len(points)), None, 0)]
        while todo:
            some, parent, side = todo.pop()
            node, here = len(self.nodes), points[some]
            if parent is not None:
                self.nodes[parent][side] = node
            cut = best_cut(here) if len(some) > LEAF else None
            self.nodes.append([here.min(axis=0), here.max(axis=0), some if cut is None else None, 0, 0])
            if cut is not None:
                left = here[:, cut[0]] <= cut[1]
                todo += [(some[left], node, 3), (some[~left], node, 4)]

    def near(self, asked: np.ndarray):
        """Pairs (asked, point) of numbers at a squared distance of at most two, as arrays of bounded size."""
        mine, theirs = asked.astype(np.float32), self.points.astype(np.float32)
        my_size, their_size = (mine * mine).sum(axis=1), (theirs * theirs).sum(axis=1)
        todo = [(0, np.arange(len(asked)))]
        while todo:
            node, who = todo.pop()
            low, high, members, left, right = self.nodes[node]
            who = who[within(asked[who], low, high)]
            if not len(who):
                continue
            if members is None:
                todo += [(left, who), (right, who)]
                continue
            step = max(1, PAIRS // len(members))
            for i in range(0, len(who), step):
                some = who[i : i + step]
                for j in range(0, len(members), PAIRS):
                    part = members[j : j + PAIRS]
                    square = my_size[some][:, None] + their_size[part][None, :] - 2 * (mine[some] @ theirs[part].T)
                    a, b = np.nonzero(square < 2.5)
                    if len(a):
                        yield some[a], part[b]


# ---- a block ---------------------------------------------------------------------------------------------------------


def search_block(filed: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """(word, n, n_near, best_n, best): for each asked word, what the filed words (word, n) say."""
    order = np.argsort(filed["word"].to_numpy(dtype=object), kind="stable")
    filed = filed.iloc[order]  # a smaller number is a smaller word
    words, counts = filed["word"].to_numpy(dtype=object), filed["n"].to_numpy(dtype=np.int64)
    questions = asked["word"].to_numpy(dtype=object)
    n_near, best = np.zeros(len(asked), np.int64), np.full(len(asked), -1, np.int64)
    theirs, mine = by_length(words), by_length(questions)
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def settle() -> None:
        if not held:
            return
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        n_near[:] += np.bincount(a, minlength=len(n_near))
        # Largest n first, then the smallest word; the best one so far competes.
        was = np.flatnonzero(best >= 0)
        a, b = np.concatenate([a, was]), np.concatenate([b, best[was]])
        rank = np.lexsort((b, -counts[b], a))
        first = rank[np.concatenate([[True], a[rank][1:] != a[rank][:-1]])]
        best[a[first]] = b[first]

    for length, here in theirs.items():
        tree = Tree(here.counts)
        for other in (length - 1, length, length + 1):
            if other not in mine:
                continue
            who = mine[other]
            n_held = 0
            for a, b in tree.near(who.counts):
                if other == length:
                    differ = who.sums[a] != here.sums[b]  # the same letters are no replacement
                    a, b = a[differ], b[differ]
                step = max(1, 8_000_000 // max(length, 1))
                for i in range(0, len(a), step):
                    x, y = a[i : i + step], b[i : i + step]
                    left, right = (who.codes[x], here.codes[y]) if other <= length else (here.codes[y], who.codes[x])
                    good = one_edit(left, right)
                    if good.any():
                        held.append((who.at[x[good]], here.at[y[good]]))
                        n_held += int(good.sum())
                if n_held > 2_000_000:
                    settle()
                    n_held = 0
            settle()
    some = best >= 0
    best_n = np.where(some, counts[np.maximum(best, 0)] if len(counts) else 0, 0)
    named = np.where(some, words[np.maximum(best, 0)] if len(words) else None, None)
    return pd.DataFrame({"word": questions, "n": asked["n"].to_numpy(), "n_near": n_near,
                         "best_n": best_n, "best": named})


# ---- cells over all tasks --------------------------------------------------------------------------------------------


class Cells:
    """The top of the tree: cuts from a sample, over the length and the counters."""

    def __init__(self, sample: list[str], n_words: int):
        points = places(np.array(sample, dtype=object))
        self.cuts: list[tuple] = []  # (dimension, threshold, left, right) or (cell,)
        self.n = 0
        share = n_words / max(len(sample), 1)
        todo = [(np.arange(len(points)), None, 0)]
        while todo:
            some, parent, side = todo.pop()
            node = len(self.cuts)
            if parent is not None:
                self.cuts[parent][side] = node
            cut = best_cut(points[some]) if len(some) * share > FILED and len(some) >= 16 else None
            if cut is None:
                self.cuts.append([self.n])
                self.n += 1
                continue
            left = points[some][:, cut[0]] <= cut[1]
            self.cuts.append([*cut, 0, 0])
            todo += [(some[left], node, 2), (some[~left], node, 3)]

    def of(self, words: np.ndarray):
        """(number of the word, cell, is it filed there?) for all cells a word is filed or asked in."""
        points = places(words)
        everywhere = np.arange(len(words))
        wide = points.shape[1]
        todo = [(0, everywhere, np.ones(len(words), bool), np.zeros(wide, np.int16), np.full(wide, 1 << 14, np.int16))]
        out = []
        while todo:
            node, who, own, low, high = todo.pop()
            if not len(who):
                continue
            cut = self.cuts[node]
            if len(cut) == 1:
                out.append((who, np.full(len(who), cut[0]), own))
                continue
            dim, at, left, right = cut
            for child, is_left in ((left, True), (right, False)):
                lo, hi = low.copy(), high.copy()
                if is_left:
                    hi[dim] = min(hi[dim], at)
                else:
                    lo[dim] = max(lo[dim], at + 1)
                # The length counts on its own: an edit moves it by one at most, whatever the counters do.
                here = points[who]
                length = (here[:, 0] >= lo[0] - 1) & (here[:, 0] <= hi[0] + 1)
                inside = length & within(here[:, 1:], lo[1:], hi[1:])
                mine = own & ((here[:, dim] <= at) == is_left)
                todo.append((child, who[inside], mine[inside], lo, hi))
        if not out:
            return (np.empty(0, np.int64),) * 2 + (np.empty(0, bool),)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def places(words: np.ndarray) -> np.ndarray:
    """Length (up to a bound) and counters of each word."""
    out = np.zeros((len(words), 1 + DIMS), dtype=np.int16)
    for length, group in by_length(words).items():
        out[group.at, 0] = min(length, 1 << 13)
        out[group.at, 1:] = group.counts
    return out


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n, n_near, best_n, best) for each row of ``vocabulary`` (word, n).

    ``n_near`` counts the words one edit apart; ``best`` is that of largest n, the smallest in code-point order of
    several, ``best_n`` its n (both null without a near word).
    """
    vocabulary = vocabulary.select("word", "n").where("word is not null and word != ''")
    n_words = vocabulary.count()
    sample = [r.word for r in vocabulary.orderBy(F.xxhash64("word"), "word").limit(SAMPLE).collect()]
    cells = Cells(sample, n_words)

    def tally(batches):
        filed, asked = np.zeros(cells.n, np.int64), np.zeros(cells.n, np.int64)
        for batch in batches:
            _, cell, own = cells.of(batch["word"].to_numpy(dtype=object))
            asked += np.bincount(cell, minlength=cells.n)
            filed += np.bincount(cell[own], minlength=cells.n)
        yield pd.DataFrame({"cell": np.arange(cells.n), "filed": filed, "asked": asked})

    totals = in_tasks(vocabulary, tally, "cell long, filed long, asked long").groupBy("cell").agg(
        F.sum("filed").alias("filed"), F.sum("asked").alias("asked"))
    rows, columns = np.ones(cells.n, np.int64), np.ones(cells.n, np.int64)
    for r in totals.collect():  # at most one row per cell, and a cell has 16 words of the sample
        rows[r.cell], columns[r.cell] = max(1, -(-r.filed // FILED)), max(1, -(-r.asked // ASKED))

    def deal(batches):
        for batch in batches:
            words, n = batch["word"].to_numpy(dtype=object), batch["n"].to_numpy(np.int64)
            number, cell, own = cells.of(words)
            part = mix64(pd.util.hash_array(words, categorize=False))
            for filed, mine, other in ((True, rows, columns), (False, columns, rows)):
                who, where = (number[own], cell[own]) if filed else (number, cell)
                at = (part[who] % mine[where].astype(np.uint64)).astype(np.int64)
                copies = other[where]
                who, where, at = (np.repeat(x, copies) for x in (who, where, at))
                across = np.arange(len(who)) - np.repeat(np.cumsum(copies) - copies, copies)
                row, column = (at, across) if filed else (across, at)
                yield pd.DataFrame({"cell": where, "i": row, "j": column, "filed": filed, "word": words[who], "n": n[who]})

    def search(block: pd.DataFrame) -> pd.DataFrame:
        return search_block(block[block["filed"]], block[~block["filed"]])

    ship_package(vocabulary.sparkSession)
    dealt = in_tasks(vocabulary, deal, "cell long, i long, j long, filed boolean, word string, n long")
    found = dealt.groupBy("cell", "i", "j").applyInPandas(search, "word string, n long, n_near long, best_n long, best string")
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))))
    merged = found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    return merged.select("word", "n", "n_near", (-F.col("best.n")).alias("best_n"), F.col("best.word").alias("best"))


def variant_groups(vocabulary: DataFrame, times: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row of ``vocabulary`` (word, n).

    A word's form is its near word of largest n if that is at least ``times`` its own n.  Forms grow by that factor, so
    paths are short: each round doubles the steps taken, and a few rounds reach every root.
    """
    found = near_words(vocabulary)
    common = F.col("best_n") >= times * F.col("n")
    formed = saved(found.select("word", "n", "n_near", F.when(common, F.col("best")).alias("form"),
                                F.when(common, F.col("best_n")).alias("form_n")), "spelling")
    path = formed.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        onward = path.select(F.col("word").alias("__at"), F.col("root").alias("__on"))
        step = path.join(onward, F.col("root") == F.col("__at"), "left").select(
            "word", F.coalesce("__on", "root").alias("root"), F.col("__on").isNotNull().alias("__moved"))
        step = saved(step, "roots")
        moved = not step.where("__moved").isEmpty()
        path = step.drop("__moved")
        if not moved:
            break
    roots = path.withColumnRenamed("word", "__word")
    return formed.join(roots, F.col("word") == F.col("__word"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


# ---- words of documents ----------------------------------------------------------------------------------------------

LETTERS = r"[A-Za-zÀ-ÿ]"
LEAST_LENGTH, LEAST_COUNT, DROP = 7, 2, 31


def lowered(word: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(word, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def document_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", drop: int | None = DROP) -> DataFrame:
    """(word, n): the runs of letters of all texts, of ``LEAST_LENGTH`` letters and ``LEAST_COUNT`` uses at least.

    Where ``drop`` divides the CRC-32 of ``<doc_id>:<run>``, the run loses one letter, chosen by the CRC.
    """
    # A word can only come from a run at least as long.
    runs = F.explode(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"{LETTERS}{{{LEAST_LENGTH},}}"), F.lit(0)))
    words = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("id"), runs.alias("run"))
    words = words.withColumn("run", lowered(F.col("run")))
    if drop:
        words = words.withColumn("h", F.crc32(F.concat(F.col("id"), F.lit(":"), F.col("run")).cast("binary")))
        shorter = F.expr("concat(substring(run, 1, cast(h % length(run) as int)), substring(run, cast(h % length(run) as int) + 2))")
        words = words.withColumn("run", F.when(F.col("h") % drop == 0, shorter).otherwise(F.col("run")))
    counted = words.where(F.length("run") >= LEAST_LENGTH).groupBy(F.col("run").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return saved(counted.where(F.col("n") >= LEAST_COUNT), "words")


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variant_groups(document_words(table(spark, sf_dir, "documents")))
