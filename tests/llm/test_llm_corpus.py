"""Mixing, packing, WARC index, near-duplicates and the pipeline: small tables, odd rows, brute force."""

import base64
import collections
import gzip
import hashlib
import math
import random
import re

import pytest
from conftest import SF
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import best_fit, components, mixing, order_minhash, warc_index
from gridloom.llm.tokens import word_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(rng, n, vocabulary=500):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# ---- mixing --------------------------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped = set()
    while True:
        rest = sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        open_ = [s for s in names if s not in capped]
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s] * (1 + 1e-12)}
        if not over:
            return {s: share.get(s, most * sizes[s]) for s in names}
        capped |= over


def check_mix(rows, sources):
    """rows of the query; sources by doc_id."""
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for r in rows:
        s = sources[r.doc_id]
        sizes[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
        assert r.taken % r.size == 0 if r.size else r.taken == 0
        assert 0 <= r.taken <= 3 * r.size
    wanted = brute_targets(sizes)
    for s in sizes:
        assert math.isclose(target[s], wanted[s], rel_tol=1e-9, abs_tol=1e-6)
    return {s: (taken[s], wanted[s]) for s in sizes}


def test_mix_meets_its_targets(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = mixing.op6_entropy_mix(spark, SF).collect()
    assert len(rows) == len(docs) and all(r.size == len(WORD.findall(docs[r.doc_id].text or "")) for r in rows)
    for got, wanted in check_mix(rows, {i: d.source for i, d in docs.items()}).values():
        assert abs(got - wanted) <= 0.02 * wanted + 10
    again = mixing.op6_entropy_mix(spark, SF).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_mix_of_odd_rows(spark, frame, tmp_path):
    rng = random.Random(1)
    rows = [(i, words_of(rng, rng.randrange(1, 80)), None, ["b", "a", None, "Z", "é"][i % 5] if i % 3 else "a", 1) for i in range(300)]
    rows += [(400, None, None, "void", 1), (401, "", None, "void", 1), (402, "one " * 5000, None, "c", 1), (403, "x", None, "", 1)]
    rows += [(500, "same text here", None, "b", 1)] * 3
    frame(DOCS, rows).withColumns({"size": F.lit("x"), "copies": F.lit(9)}).write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.op6_entropy_mix(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and len({r.taken for r in got if r.doc_id == 500}) == 1
    near = check_mix(got, {r[0]: r[3] for r in rows})
    assert near["void"] == (0, 0)
    for source, (got_words, wanted) in near.items():  # one long document is taken as a whole or not at all
        assert abs(got_words - wanted) <= (2500 if source == "c" else 0.05 * wanted + 10)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    times = collections.Counter(r.doc_id for r in mixed.collect())
    for r in got:
        if r.size:
            assert times[r.doc_id] == r.taken // r.size * sum(x[0] == r.doc_id for x in rows)


def test_mix_of_repeated_rows(spark, frame, tmp_path):
    """Sources whose rows are all repeated, one by a hot row, still meet their targets."""
    rng = random.Random(3)
    rows = [(i, words_of(rng, rng.randrange(5, 60)), None, "abc"[i % 3], 1) for i in range(150) for _ in range(2)]
    rows += [(900, words_of(rng, 20), None, "b", 1)] * 1000
    frame(DOCS, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.op6_entropy_mix(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for words, wanted in check_mix(got, {r[0]: r[3] for r in rows}).values():
        assert abs(words - wanted) <= 0.02 * wanted + 10
    hot = {r.taken // r.size for r in got if r.doc_id == 900}
    assert max(hot) - min(hot) <= 1
    mixed = mixing.mix(spark.read.parquet(f"{tmp_path}/documents.parquet")).count()
    assert mixed == sum(r.taken // r.size for r in got)


def test_mix_of_nothing(spark, frame, tmp_path):
    frame(DOCS, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert mixing.op6_entropy_mix(spark, str(tmp_path)).count() == 0


def test_rates_solve_the_dual(spark, frame):
    """The rates are exponential in the size, boxed, and meet the word constraint."""
    sizes = [(i, "s" if i % 2 else "t", 10 + i % 37, i) for i in range(400)]
    rows = frame("id long, source string, size long, h long", sizes)
    duals = {r.source: r for r in mixing.balanced(rows, mixing.source_targets(rows)).collect()}
    for s, d in duals.items():
        words = sum(x[2] * min(3.0, math.exp(d.lam * x[2] / d.scale)) for x in sizes if x[1] == s)
        assert math.isclose(words, d.target, rel_tol=1e-5)


# ---- packing -------------------------------------------------------------------------------------------------------


def naive_pack(items, capacity):
    """Best fit by looking at every bin; earliest filed bin of the tightest room wins."""
    bins, clock = [], 0
    for size, source, cluster in items:
        fit = [b for b in bins if b["room"] >= size and source not in b["sources"] and cluster not in b["clusters"]]
        if fit:
            b = min(fit, key=lambda b: (b["room"], b["filed"]))
        else:
            b = {"room": capacity, "sources": set(), "clusters": set(), "id": len(bins)}
            bins.append(b)
        b["room"] -= size
        b["sources"].add(source)
        b["clusters"].add(cluster)
        clock += 1
        b["filed"] = clock
        yield b["id"]


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_matches_a_full_search(seed):
    rng = random.Random(seed)
    items = [(rng.randrange(1, 60), rng.choice("aaaabcdefgh"), rng.randrange(40)) for _ in range(500)]
    items.sort(key=lambda x: -x[0])
    bins = best_fit.Bins(64)
    got = [bins.put(s, 1 << ord(a) - 97, 1 << c) for s, a, c in items]
    assert got == list(naive_pack(items, 64))


def check_packing(rows, docs, capacity):
    """Every word of every document once; no bin over capacity, or with a source or text twice."""
    spans, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        spans[r.doc_id].append((r.start, r.n_words))
        bins[r.bin_id].append(r)
    copies = collections.Counter(d[0] for d in docs)
    by_id = {d[0]: d for d in docs}
    for i, d in by_id.items():
        n = len(WORD.findall(d[1] or ""))
        wanted = sorted((s, min(capacity, n - s)) for s in range(0, n, capacity) for _ in range(copies[i]))
        assert sorted(spans[i]) == wanted
    for b in bins.values():
        at = 0
        for r in sorted(b, key=lambda r: r.offset):
            assert r.offset == at
            at += r.n_words
        assert at <= capacity
        assert len({by_id[r.doc_id][3] for r in b}) == len(b) and len({by_id[r.doc_id][1] for r in b}) == len(b)


def test_packing_of_odd_rows(spark, frame):
    rng = random.Random(2)
    docs = [(i, words_of(rng, rng.randrange(1, 90)), None, rng.choice(["hot", "hot", "a", "b", None]), 1) for i in range(400)]
    docs += [(900, None, None, "a", 1), (901, " ", None, "a", 1), (902, "w " * 1000, None, "a", 1), (903, "x " * 64, None, "b", 1)]
    docs += [(910 + i, "one text in many copies", None, f"s{i}", 1) for i in range(50)] + [(990, "twice the row", None, "q", 1)] * 2
    df = frame(DOCS, docs).withColumns({"size": F.lit(1), "hash": F.lit("x"), "bin_id": F.lit(2)})
    for block in (4096, 32):
        check_packing(best_fit.pack(df, capacity=64, block=block).collect(), docs, 64)
    assert best_fit.pack(df.limit(0)).count() == 0


def test_packing_of_the_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = best_fit.op8_best_fit(spark, SF).collect()
    check_packing(rows, docs, best_fit.CAPACITY)
    words = sum(r.n_words for r in rows)
    assert words / best_fit.CAPACITY / len({r.bin_id for r in rows}) > 0.8


# ---- archives ------------------------------------------------------------------------------------------------------


def test_archives_round_trip(spark, frame, tmp_path):
    pages = [(1, "http://www.Ex.org:80/B?x", "same"), (2, "http://ex.org/a", "same"), (7, "http://ex.org/a", ""), (3, None, None),
             (4, "http://ex.org/a", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n\r\n"), (5, "a b\r\nX: y", "é😀\n" * 3), (2, "http://ex.org/a", "same"),
             (None, "http://ex.org/n", "same"), (None, "http://ex.org/n", "only null ids"), (9, "http://ex.org/l", "long " * 200_000)]
    df = frame("page_id long, url string, html string", pages).withColumns({"digest": F.lit(0), "first": F.lit("x")})
    df.write.parquet(f"{tmp_path}/pages.parquet")
    got = warc_index.op1_warc_index(spark, str(tmp_path)).collect()
    latest = {}
    for i, _, h in pages:
        latest[h or ""] = max(latest.get(h or "", -1), -1 if i is None else i)
    wanted = collections.Counter()
    for i, _, h in pages:
        body = (h or "").encode()
        first = None if latest[h or ""] < 0 else latest[h or ""]
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        revisit = first is not None and i != first
        wanted[i, len(body), digest, "revisit" if revisit else "response", first if revisit else None] += 1
    assert collections.Counter(tuple(r)[:5] for r in got) == wanted
    assert {r.url_key for r in got if r.page_id == 1} == {"org,ex)/b?x"} and {r.url_key for r in got if r.page_id == 3} == {""}
    history = sorted(r.capture_no for r in got if r.url_key == "org,ex)/a")
    assert history == [1, 2, 3, 4]


def test_archive_files_are_standard_gzip(spark, frame, tmp_path):
    df = frame("page_id long, url string, html string", [(i, f"http://h{i}.org/", f"<p>{i}</p>") for i in range(20)])
    warc_index.write_archives(df, f"{tmp_path}/w")
    data = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "w").glob("part-*")))
    assert data.count(b"WARC/1.1\r\n") == 20 and data.endswith(b"\r\n\r\n")
    index = warc_index.read_index(spark, f"{tmp_path}/w").collect()
    for r in index:
        raw = open(r.file.removeprefix("file:"), "rb").read()[r.offset : r.offset + r.length]
        assert f"<p>{r.page_id}</p>".encode() in gzip.decompress(raw)
    ordered = sorted(index, key=lambda r: (r.part, r.place))
    assert [r.url_key for r in ordered] == sorted(r.url_key for r in index)


def test_no_pages(spark, frame, tmp_path):
    frame("page_id long, url string, html string", []).write.parquet(f"{tmp_path}/pages.parquet")
    assert warc_index.op1_warc_index(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree_merges(k):
    rng = random.Random(k)
    runs = [sorted(rng.choices(range(30), k=rng.randrange(0, 20))) for _ in range(k)]
    assert list(warc_index.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_hot_payloads_are_looked_up(spark, frame):
    rows = [(i, "u", "hot" if i % 3 == 0 else f"p{i % 400}", "hot" if i % 3 == 0 else f"d{i % 400}") for i in range(1200)]
    got = warc_index.with_roles(frame("id long, url string, payload string, digest string", rows)).collect()
    last = {}
    for i, _, _, d in rows:
        last[d] = max(last.get(d, 0), i)
    assert len(got) == len(rows) and all(r.first == last[r.digest] for r in got)


# ---- near-duplicates -----------------------------------------------------------------------------------------------


def edit_distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        c = [i]
        for j, y in enumerate(b, 1):
            c.append(min(p[j] + 1, c[-1] + 1, p[j - 1] + (x != y)))
        p = c
    return p[-1]


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        at, kind = rng.randrange(len(words)), rng.randrange(3)
        if kind == 0:
            words[at] = f"n{rng.randrange(10 ** 6)}"
        elif kind == 1 and len(words) > 1:
            del words[at]
        else:
            words.insert(at, f"n{rng.randrange(10 ** 6)}")
    return words


@pytest.mark.parametrize("seed", range(3))
def test_banded_distance(seed):
    rng = random.Random(seed)
    for _ in range(150):
        a = [rng.randrange(rng.choice([3, 1000])) for _ in range(rng.randrange(0, 120))]
        b = edited(rng, a, rng.randrange(0, 20)) if a else [1] * rng.randrange(4)
        b = [x if isinstance(x, int) else -int(x[1:]) for x in b]
        most = rng.randrange(0, 30)
        assert order_minhash.banded_distance(a, b, most) == min(edit_distance(a, b), most + 1)


def test_word_hashes_follow_the_words():
    assert word_hashes("Über die Brücke, über!").tolist() == word_hashes("über DIE brücke ... ÜBER").tolist()
    h = word_hashes("a b ab ba a­b aa").tolist()
    assert h[0] == word_hashes("x a")[1] and len(set(h)) == 5
    assert len(word_hashes("")) == 0 and len(word_hashes(" \n")) == 0 and len(word_hashes("*** ???")) == 2


def brute_classes(texts):
    """Connected components of all pairs with a word edit similarity of at least 0.8."""
    keys = {i: word_hashes(t).tolist() for i, t in texts.items() if t and t.strip()}
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(keys)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            longer = max(len(keys[i]), len(keys[j]))
            if min(len(keys[i]), len(keys[j])) >= 0.8 * longer and edit_distance(keys[i], keys[j]) <= 0.2 * longer + 1e-9:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in texts}


def near_rows():
    rng = random.Random(4)
    base = [words_of(rng, 60, 3000).split() for _ in range(12)]
    texts, n = {}, 0
    for b in base:
        for edits in (0, 0, 1, 2, 3):
            texts[n] = " ".join(edited(rng, b, edits))
            n += 1
    passage = words_of(rng, 55, 3000)
    for _ in range(15):  # share a passage, nothing else
        texts[n] = f"{words_of(rng, 70, 3000)} {passage} {words_of(rng, 70, 3000)}"
        n += 1
    half = words_of(rng, 50, 3000), words_of(rng, 50, 3000)
    texts |= {n: " ".join(half), n + 1: " ".join(half[::-1])}  # same shingles in another order
    n += 2
    for t in (None, "", "  ", "one", "one", "One!", "two words", "*** ???", "*** ???", "### !!!"):
        texts[n] = t
        n += 1
    return texts


def test_near_duplicates_match_all_pairs(spark, frame):
    texts = near_rows()
    df = frame(DOCS, [(i, t, "en", "s", 1) for i, t in texts.items()]).withColumns({"node": F.lit("x"), "keys": F.lit(1)})
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(df).collect()}
    assert got == brute_classes(texts)
    kept = order_minhash.survivors(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(got.values())


def test_near_duplicates_of_a_skewed_group(spark, frame):
    """Variants of one template around the threshold: every similar pair that shares a key is in one class."""
    rng = random.Random(11)
    base = [f"t{i}" for i in range(60)]
    texts = [" ".join(edited(rng, base, rng.randrange(1, 13))) for _ in range(400)]
    docs = frame(DOCS, [(i, t, None, "s", 1) for i, t in enumerate(texts)])
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(docs).collect()}
    hashed = [word_hashes(t) for t in texts]
    keys = [set(order_minhash.sketch(h)[0].tolist()) for h in hashed]
    pairs = [(i, j) for i in range(400) for j in range(i) if keys[i] & keys[j] and order_minhash.edit_similar(texts[i], texts[j])]
    up = list(range(400))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in pairs:
        a, b = sorted((top(i), top(j)))
        up[b] = a
    assert got == {i: top(i) for i in range(400)}


def test_most_pairs_near_the_threshold_share_a_key():
    """Share of truly similar pairs (brute force) that are candidates, by bands of similarity, edits spread evenly."""
    rng = random.Random(12)
    found, total = collections.Counter(), collections.Counter()
    for _ in range(600):
        a = words_of(rng, rng.choice([60, 150, 400]), 5000).split()
        b = edited(rng, a, rng.randrange(1, len(a) // 5))
        x, y = (word_hashes(" ".join(t)) for t in (a, b))
        similarity = 1 - order_minhash.banded_distance(x.tolist(), y.tolist(), len(a)) / max(len(x), len(y))
        if similarity >= 0.8:
            band = min(int(similarity * 20), 19)
            total[band] += 1
            found[band] += bool(set(order_minhash.sketch(x)[0].tolist()) & set(order_minhash.sketch(y)[0].tolist()))
    assert min(total.values()) > 60 and set(total) == {16, 17, 18, 19}
    assert all(found[k] >= 0.9 * total[k] for k in total)


def test_alignments_grow_with_the_group(spark, frame, monkeypatch):
    """Copies of one original, each some words away: about one alignment a copy, and one class."""
    made = []
    verified = order_minhash._verified
    monkeypatch.setattr(order_minhash, "_verified", lambda pairs, texts: (made.append(pairs.count()), verified(pairs, texts))[1])
    per_copy = []
    for n in (200, 800):
        rng, made[:] = random.Random(n), []
        base = words_of(rng, 60, 3000).split()
        rows = [(i, " ".join(edited(rng, base, 7) if i else base)) for i in range(n)]
        got = {r.class_id for r in order_minhash.near_duplicates(frame("doc_id long, text string", rows)).collect()}
        assert got == {0}
        per_copy.append(sum(made) / n)
    assert max(per_copy) < 1.6 and per_copy[1] < 1.2 * per_copy[0] + 0.1


def test_rows_of_texts_with_a_common_passage_grow_with_the_texts(spark, frame, monkeypatch):
    """Texts that share a passage and no more: the same number of stored rows a text, however many share it."""
    most = []
    saved = order_minhash.saved

    def counted(df, *more):
        out = saved(df, *more)
        most.append(out.count())
        return out

    monkeypatch.setattr(order_minhash, "saved", counted)
    monkeypatch.setattr(order_minhash, "BLOCK", 16)
    monkeypatch.setattr(order_minhash, "LARGE", 16, raising=False)
    per_text = []
    for n in (60, 240):
        rng, most[:] = random.Random(n), []
        passage = words_of(rng, 60, 3000)
        rows = [(i, f"{words_of(rng, 30, 30000)} {passage} {words_of(rng, 30, 30000)}") for i in range(n)]
        got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(frame("doc_id long, text string", rows)).collect()}
        assert got == {i: i for i in range(n)}
        per_text.append(max(most) / n)
    assert per_text[1] < 1.3 * per_text[0]


def test_texts_of_one_vocabulary_meet_at_their_rare_word_pairs(spark, frame, monkeypatch):
    """Texts that share a passage and most words: hardly a row a text, as their other word pairs differ."""
    made = []
    in_tasks = order_minhash.in_tasks

    def counted(df, fn, schema):
        out = in_tasks(df, fn, schema)
        if schema.startswith("word int"):
            made.append(out.count())
        return out

    monkeypatch.setattr(order_minhash, "in_tasks", counted)
    rng = random.Random(21)
    passage = words_of(rng, 60, 1000)
    rows = [(i, f"{words_of(rng, 30, 1000)} {passage} {words_of(rng, 30, 1000)}") for i in range(300)]
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(frame("doc_id long, text string", rows)).collect()}
    assert got == {i: i for i in range(300)}
    assert len(made) == 1 and made[0] < 3 * 300


def test_near_duplicates_in_small_blocks(spark, frame, monkeypatch):
    """Texts of frequent words only, which meet block by block, and texts of more words than a row holds."""
    rng = random.Random(13)
    base, long = [f"t{i}" for i in range(60)], words_of(rng, 1500, 30000).split()
    texts = [" ".join(edited(rng, base, rng.randrange(1, 13))) for _ in range(120)]
    texts += [" ".join(long[:700] + edited(rng, long[700:], rng.randrange(150, 400))) for _ in range(20)]
    texts += [" ".join(rng.sample(base[:12], 1) * rng.randrange(40, 60)) for _ in range(30)]
    docs = frame(DOCS, [(i, t, None, "s", 1) for i, t in enumerate(texts)])
    keys = [set(order_minhash.sketch(word_hashes(t))[0].tolist()) for t in texts]
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if keys[i] & keys[j] and order_minhash.edit_similar(texts[i], texts[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    for block in (16, 1024):
        monkeypatch.setattr(order_minhash, "BLOCK", block)
        monkeypatch.setattr(order_minhash, "LARGE", 16, raising=False)
        got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(docs).collect()}
        assert got == {i: top(i) for i in range(len(texts))}


def test_near_duplicates_of_repeated_rows(spark, frame):
    df = frame("doc_id long, text string", [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (2, "x y z u v w"), (None, "x y z u v w"), (None, None)])
    rows = [tuple(r) for r in order_minhash.near_duplicates(df).select("doc_id", "class_id").collect()]
    assert sorted(rows, key=str) == sorted([(1, 1), (1, 1), (2, 1), (2, 2), (None, 2), (None, None)], key=str)
    assert order_minhash.near_duplicates(df.limit(0)).count() == 0
    kept = sorted((tuple(r) for r in order_minhash.survivors(df).collect()), key=str)
    assert kept == sorted([(1, "a b c d e f"), (2, "x y z u v w"), (None, None)], key=str)


def test_sketches_find_similar_and_tell_orders_apart():
    rng = random.Random(6)
    shared = crossed = 0
    for _ in range(60):
        a = words_of(rng, 200, 5000).split()
        b = edited(rng, a, 4)  # about 0.8 of the shingles
        turned = a[100:] + a[:100]
        keys = [set(order_minhash.sketch(word_hashes(" ".join(x)))[0].tolist()) for x in (a, b, turned)]
        shared += bool(keys[0] & keys[1])
        crossed += len(keys[0] & keys[2])
    # A turned text keeps a key only where all picked shingles are of one half.
    assert shared == 60 and crossed / 60 < order_minhash.SKETCHES * 1.2 * 2 * 0.5**order_minhash.PICKED


def test_components(spark, frame):
    rng = random.Random(8)
    edges = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(40)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.comp for r in components.components(frame("a long, b long", edges)).collect()}
    assert got == {x: root(x) for x in parent}
    assert components.components(frame("a long, b long", [])).count() == 0


# ---- pipeline ------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "secret_scan", "source_mix", "best_fit_packing"]
    before, counts = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns
        before = order_minhash.saved(after)
        counts.append(before.count())
    assert counts[1] >= 0.95 * counts[0] and counts[2] < counts[1] and counts[3] == counts[2]
    assert not before.where(F.col("text").rlike("AKIA[A-Z0-9]{12}")).count()
    packed = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    run = corpus_pipeline.run(spark, SF)
    assert run.columns == packed.columns and run.count() == packed.count()
    words = before.select(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0]
    assert packed.agg(F.sum("n_words")).first()[0] == words


def test_pipeline_of_no_documents(spark, frame, tmp_path):
    frame(DOCS, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
