"""Resampling, main text of pages, spelling variants: brute force, round trips and odd rows."""

import collections
import hashlib
import html
import html.parser
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from gridloom.llm import crc_spans, html_text, importance_resample, spelling

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PAGES = "page_id long, url string, html string"
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_in(text):
    return WORD.findall((text or "").translate(UPPER))


# ---- checksums -------------------------------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=400), st.lists(st.tuples(st.integers(0, 400), st.integers(0, 400)), min_size=1, max_size=20))
def test_crc_of_spans(data, spans):
    spans = [(min(a, b, len(data)), min(max(a, b), len(data))) for a, b in spans]
    got = crc_spans.crc32_spans(np.frombuffer(data, np.uint8), np.array([a for a, _ in spans]), np.array([b for _, b in spans]))
    assert got.tolist() == [zlib.crc32(data[a:b]) for a, b in spans]


def test_crc_of_long_spans_folds_in_slices(monkeypatch):
    monkeypatch.setattr(crc_spans, "SLICE", 256)
    data = np.random.default_rng(5).integers(0, 256, 100_000).astype(np.uint8)
    starts = np.array([0, 7, 99_000, 50_000, 3])
    ends = np.array([100_000, 99_999, 99_031, 50_033, 3])
    assert crc_spans.crc32_spans(data, starts, ends).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]


@pytest.mark.parametrize("least, most", [(1, 1), (1, 2), (2, 3)])
def test_features_are_runs_of_words(least, most):
    texts = ["The Quick-brown ÄÖ9 x", None, "", "...", "one", "a b c d e f", "naïve Ünder_score 日本 x2", "end"]
    got, of, n_words = importance_resample.buckets_of(pa.array(texts)[1:], 997, least, most)
    want = collections.Counter()
    for i, text in enumerate(texts[1:]):
        w = words_in(text)
        assert n_words[i] == len(w)
        want.update((i, zlib.crc32(" ".join(w[k : k + n]).encode()) % 997) for n in range(least, most + 1) for k in range(len(w) - n + 1))
    assert collections.Counter(zip(of.tolist(), got.tolist(), strict=True)) == want


# ---- resampling ------------------------------------------------------------------------------------------------------


def brute_resample(docs, target):
    words = [(i, words_in(t)) for i, t in docs]
    bucket = lambda w: zlib.crc32(w.encode()) % 10000
    s, t = collections.Counter(bucket(w) for _, ws in words for w in ws), collections.Counter(bucket(w) for x in target for w in words_in(x))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000))))
    rows = []
    for i, ws in words:
        weight = sum(gain(bucket(w)) for w in ws)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(ws), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for n, r in enumerate(able[: 10 * len(able) // 100], 1):
        r[4] = n
    return rows


def order(rows):
    return sorted(map(tuple, rows), key=repr)


def test_resampling_matches_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = importance_resample.op11_importance_resample(spark, SF)
    assert dict(got.dtypes) == dict.fromkeys(["doc_id", "n_features", "weight", "score", "rank"], "bigint")
    rows = got.collect()
    assert order(rows) == order(brute_resample(docs, target)) and any(r.rank for r in rows)


def test_resampling_of_odd_rows(spark, frame, tmp_path):
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice(["alpha", "Beta", "GAMMA", "délta", "x9"]) for _ in range(n))
    docs = [(i, text(rng.randrange(10, 40))) for i in range(300)] + [(400, None), (401, ""), (402, "-- !!"), (403, "w" * 200_000 + " Z" * 50_000)]
    docs += [(500, text(30))] * 40 + [(None, text(25))]
    frame(DOCS, [(i, t, None, None, 1) for i, t in docs]).withColumns({"n_features": F.lit("x"), "rank": F.lit(3), "h": F.lit(1)}).write.parquet(
        f"{tmp_path}/documents.parquet")
    target = ["alpha alpha beta", None, ""]
    frame("item_id long, text string", list(enumerate(target))).write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = importance_resample.op11_importance_resample(spark, str(tmp_path)).collect()
    want = brute_resample(docs, target)
    assert order([r[:4] for r in rows]) == order([r[:4] for r in want])
    assert sorted(r.rank for r in rows if r.rank) == list(range(1, 1 + sum(r[4] is not None for r in want)))
    by_rank = [r.score for r in sorted((r for r in rows if r.rank), key=lambda r: r.rank)]
    assert by_rank == sorted(by_rank, reverse=True)
    kept = importance_resample.resampled(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/benchmark.parquet"))
    assert kept.columns[-3:] == ["n_features", "rank", "h"] and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.rank}


def test_resampling_of_nothing(spark, frame, tmp_path):
    frame(DOCS, []).write.parquet(f"{tmp_path}/documents.parquet")
    frame("item_id long, text string", []).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert importance_resample.op11_importance_resample(spark, str(tmp_path)).count() == 0


def test_resampling_prefers_texts_like_the_target(spark, frame):
    rng = random.Random(4)
    docs = frame("doc_id long, text string", [(i, " ".join(rng.choice("abcdefghij" if i % 4 else "stuvwxyz") for _ in range(50))) for i in range(400)])
    target = frame("text string", [("s t u v w x y z " * 20,)])
    kept = [r.doc_id for r in importance_resample.resampled(docs, target).collect()]
    assert len(kept) == 40 and all(i % 4 == 0 for i in kept)


# ---- main text -------------------------------------------------------------------------------------------------------


class Article(html.parser.HTMLParser):
    """Plain reading of pages whose article is marked as such."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.parts.append(" " if tag in ("p", "h1", "br", "article") else "")

    def handle_endtag(self, tag):
        self.parts.append(" " if tag in ("p", "h1", "article") else "")
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth:
            self.parts.append(data)


def test_main_text_of_all_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {}
    for r in pages.collect():
        reader = Article()
        reader.feed(r.html or "")
        reader.close()
        want[r.page_id] = (r.url, " ".join("".join(reader.parts).split()))
    got = html_text.op12_html_text(spark, SF)
    assert got.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    assert {r.page_id: (r.url, r.text) for r in got.collect()} == want
    assert all(r.n_chars == len(r.text) for r in got.collect())


BOILERPLATE = {
    "top": '<div id="top-banner">Sale, sale, sale, only today and only here, dear reader, buy now.</div>',
    "header": "<header><h2>The Daily Paper</h2><p>News, views, and more, every day of the week, since 1901.</p></header>",
    "nav": '<ul class="main-menu"><li><a href="/">Home</a></li><li><a href="/x">World, sport, culture</a></li></ul>',
    "cookie": '<div class="cookieConsent" role="dialog"><p>We use cookies, pixels, and other things, to follow you. Agree, or go away.</p></div>',
    "form": '<form action="/s"><label>Search, please</label><input name="q"><button>Go</button></form>',
    "side": '<div class="sidebar-left"><h3>Popular</h3><p>Ten things, which nobody, ever, wanted to know, about celebrities.</p></div>',
    "ad": '<div class="ad">Lose weight, fast, with this trick, which doctors, of course, hate.</div>',
    "script": "<script>if (a < b && '</p>') { x = '<div class=content>no, no, no</div>' }</script><style>p > a { color: red }</style>",
    "foot": '<div id="page-footer"><p>All rights reserved, by us, since 1901, in all countries.</p></div>',
    "comments": '<section id="comments"><h2>Comments</h2>' + '<article class="comment"><p>I disagree, strongly, with every word, of this, '
                'and here is why, at length, dear all.</p></article>' * 12 + "</section>",
}
BODY = ("<h1>A title</h1><p>The first paragraph, with a <a href='x'>link</a>, some com&shy;mas &amp; a caf&eacute;.</p>", "<p>No.</p>",
        "<blockquote><p>A quoted line, as said.</p></blockquote>", "<p>Second one,<br>broken <b>in<i>side</i></b>, with 3 &lt; 4 and long enough to count.",
        "<ul><li>one<li>two</ul>", "<h2>More</h2>", "<p>The last paragraph, which ends the text, as it should.</p>")
BODY_TEXT = ("A title The first paragraph, with a link, some com­mas & a café. No. A quoted line, as said. Second one, broken inside, "
             "with 3 < 4 and long enough to count. one two More The last paragraph, which ends the text, as it should.")


@pytest.mark.parametrize("wrap", [
    "<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>', '<div id="x"><div>{}</div></div>', '<div role="main">{}</div>',
    '<div class="has-sidebar with-comments">{}</div>', "<table><tr><td>{}</td></tr></table>", "<section>{}</section>"])
def test_boilerplate_goes_and_the_article_stays(wrap):
    rng = random.Random(wrap)
    names = [k for k in BOILERPLATE if k not in ("foot", "comments")]
    for n in (0, 4, len(names)):
        before = "".join(BOILERPLATE[k] for k in rng.sample(names, n))
        page = f"<!DOCTYPE html><html><head><title>Not this</title></head><body>{before}{wrap.format(''.join(BODY))}{BOILERPLATE['foot']}{BOILERPLATE['comments']}</body></html>"
        assert html_text.main_text(page) == BODY_TEXT


def test_boilerplate_inside_the_article_goes():
    inside = ("<header><h1>Title</h1><p>By somebody, today</p></header><p>One, two, and three, are the words of this article.</p>"
              "<aside>Aside, from this</aside><div class='share-buttons'>Tweet</div><nav>Next</nav><p>End.</p><footer>Tags, tags</footer>")
    assert html_text.main_text(f"<body><article>{inside}</article></body>") == "Title One, two, and three, are the words of this article. End."


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), (" \n", ""), ("plain &lt; text,\n no tag", "plain < text, no tag"), ("<nav>menu</nav><footer>x</footer>", ""),
    ("<p>Is.</p>", "Is."), ("<body><p>a<p>b<div>c</div>d", "a b c d"), ("<article>x<!-- <p>y</p> -->z</article>", "xz"),
    ("<article><p title='a > b' x=\"<p>\">in</p></article>", "in"), ("<ARTICLE><P>Up</P></ARTICLE>", "Up"),
    ("<article>5 < 6 <and 7 </article>", "5 < 6 <and 7"), ("<article>&#65;&#x42;&unknown; &amp;lt;</article>", "AB&unknown; &lt;"),
    ("<article><script>var a = '<p>no</p>';</script><p>yes</p></article>", "yes"), ("<script>never closed <p>x</p>", ""),
    ("<form><p>The whole page is one form, as some systems make it, with its text in it.</p></form>",
     "The whole page is one form, as some systems make it, with its text in it."),
])
def test_odd_pages(page, want):
    assert html_text.main_text(page) == want


def test_pages_with_siblings_and_title_outside():
    page = ("<body><h1>Head</h1><div><p>The first part, of a text, in two containers, which score alike.</p><p>And more, of it, here.</p></div>"
            "<div><p>The second part, of the text, in its own container, of the same size.</p><p>And more, of this, too.</p></div>"
            "<div><a href='1'>One link, to here</a> <a href='2'>Another link, to there</a></div></body>")
    text = html_text.main_text(page)
    assert text.startswith("Head The first part") and text.endswith("And more, of this, too.")


def test_long_and_deep_pages_take_linear_time():
    began = time.time()
    assert html_text.main_text("<div>" * 50_000 + "deep, text") == "deep, text"
    assert html_text.main_text("<article>" + "<p>word, word" * 20_000 + "</article>").count("word,") == 20_000
    for page in ('<a "x>" ' * 20_000, "<a '" * 50_000, "<a b c " * 50_000, "<table><tr><td>" * 10_000, "<!--" * 50_000, "<b>" * 30_000 + "</p>" * 30_000):
        html_text.main_text(page)
    assert time.time() - began < 20


def test_pages_of_odd_rows(spark, frame, tmp_path):
    rows = [(1, "u", "<article>a</article>"), (1, "u", "<article>a</article>"), (None, None, None), (2, None, ""), (3, "v", "<p>x" + " y" * 300_000)]
    frame(PAGES, rows).withColumns({"text": F.lit("t"), "n_chars": F.lit(1)}).write.parquet(f"{tmp_path}/pages.parquet")
    got = html_text.op12_html_text(spark, str(tmp_path)).collect()
    assert order((r.page_id, r.url, r.text[:9], r.n_chars) for r in got) == order(
        [(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0), (2, None, "", 0), (3, "v", "x y y y y", 600_001)])
    frame(PAGES, []).write.parquet(f"{tmp_path}/none/pages.parquet")
    assert html_text.op12_html_text(spark, f"{tmp_path}/none").count() == 0


# ---- spelling variants -----------------------------------------------------------------------------------------------


def edited(word):
    """Every pattern that words one edit apart share: a letter left out with its place, and the word without it."""
    return [(word[:i], word[i + 1 :]) for i in range(len(word))]


def brute_groups(vocabulary, times=10):
    holes, shorter = collections.defaultdict(set), collections.defaultdict(set)
    for w in vocabulary:
        for head, tail in edited(w):
            holes[head, tail].add(w)
            shorter[head + tail].add(w)
    near = {w: {x for p in edited(w) for x in holes[p] if x != w} | shorter[w] | {a + b for a, b in edited(w) if a + b in vocabulary} for w in vocabulary}
    form = {}
    for w, n in vocabulary.items():
        best = min(near[w], key=lambda x: (-vocabulary[x], x), default=None)
        form[w] = best if best is not None and vocabulary[best] >= times * n else None
    out = []
    for w, n in vocabulary.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), vocabulary.get(form[w])))
    return order(out)


def brute_words(docs):
    count = collections.Counter()
    for i, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def variants(rng, n, alphabet="abcdefgh"):
    """Common words and their misspellings, several edits deep."""
    out = {}
    for _ in range(n):
        word = "".join(rng.choice(alphabet) for _ in range(rng.randrange(3, 11)))
        count = rng.choice([5000, 300, 20])
        while count >= 1:
            out[word] = max(out.get(word, 0), count)
            at, count = rng.randrange(len(word)), count // rng.choice([2, 11, 15])
            word = rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice(alphabet) + word[at:], word[:at] + rng.choice(alphabet) + word[at + 1 :]]) or "x"
    return out


@pytest.mark.parametrize("blocks", [(65_536, 65_536), (150, 100), (20, 1000)])
def test_variant_groups_match_brute_force(spark, frame, monkeypatch, blocks):
    monkeypatch.setattr(spelling, "FILED", blocks[0])
    monkeypatch.setattr(spelling, "ASKED", blocks[1])
    monkeypatch.setattr(spelling, "LEAF", 4 if blocks[0] < 1000 else 256)
    vocabulary = variants(random.Random(blocks[0]), 250) | variants(random.Random(9), 60, "aé日z")
    # Very many words of the same letters, some of them one edit from a word outside.
    rng = random.Random(1)
    for _ in range(300):
        letters = list("aabbccdd")
        rng.shuffle(letters)
        vocabulary["".join(letters)] = rng.randrange(1, 9)
        vocabulary["".join(letters) + "e"] = 90
    vocabulary |= {"q" * 400: 3, "q" * 401: 90, "q" * 150 + "r" + "q" * 249: 5}
    got = spelling.variant_groups(frame("word string, n long", list(vocabulary.items())))
    assert order(got.collect()) == brute_groups(vocabulary)


def test_cells_show_every_word_its_neighbours():
    vocabulary = variants(random.Random(3), 1500)
    words = np.array(sorted(vocabulary), dtype=object)
    old, spelling.FILED = spelling.FILED, 100
    try:
        cells = spelling.Cells(words.tolist()[::2], len(words))
    finally:
        spelling.FILED = old
    number, cell, own = cells.of(words)
    assert cells.n > 10 and sorted(number[own].tolist()) == list(range(len(words)))
    filed, asked = dict(zip(number[own].tolist(), cell[own].tolist(), strict=True)), collections.defaultdict(set)
    for i, c in zip(number.tolist(), cell.tolist(), strict=True):
        asked[i].add(c)
    assert np.mean([len(x) for x in asked.values()]) < cells.n / 2  # the boxes do prune
    at = {w: i for i, w in enumerate(words)}
    for w in words:
        for head, tail in edited(w):
            for x in (head + tail, *(head + c + tail for c in "abcdefgh")):
                if x in at:
                    assert filed[at[x]] in asked[at[w]] and filed[at[w]] in asked[at[x]]


def test_spelling_of_documents_matches_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = spelling.op13_spelling_variants(spark, SF)
    assert dict(got.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
    rows = got.collect()
    assert order(rows) == brute_groups(brute_words(docs)) and any(r.form for r in rows)


def test_spelling_of_odd_rows(spark, frame, tmp_path):
    rng = random.Random(6)
    base = ["Wonderful", "colourful", "Éléphants", "naïveté", "Straßenbahn"]
    docs = [(i, " ".join(rng.choice(base) + rng.choice([",", "", "1x", "_"]) for _ in range(rng.randrange(60)))) for i in range(120)]
    docs += [(None, "Wonderful wonderful"), (500, None), (501, ""), (502, "short x y"), (503, "y" * 50_000 + " " + "y" * 50_000), (504, "wonderfull " * 3)]
    docs += [(600, "colorful colorful")] * 5
    frame(DOCS, [(i, t, None, None, 1) for i, t in docs]).withColumns({"word": F.lit("x"), "n": F.lit(1)}).write.parquet(f"{tmp_path}/documents.parquet")
    rows = spelling.op13_spelling_variants(spark, str(tmp_path)).collect()
    assert order(rows) == brute_groups(brute_words(docs)) and any(r.form == "wonderful" for r in rows)
    frame(DOCS, [(1, "few words", None, None, 1)]).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert spelling.op13_spelling_variants(spark, f"{tmp_path}/none").count() == 0
