import collections
import itertools
import math
import os
import random
import struct
import subprocess
import sys

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seriesforge.llm import bpe, html_extract, mixing, ngram_join, quality, substring_dedup, token_counts
from tests.llm import brute

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size int"
TEXTS = [None, "", " ", "Hello  world", "it's <|endoftext|> 42 <|startoftext|>", "Σίσυφος ΟΔΟΣ É́ ß", "a" * 3000, "x y " * 900, "日本語 😀!!", "\t\n"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if i % 4 == 0 else "en", None if i % 3 == 0 else f"s{i % 2}", None, "mine", 1) for i, t in enumerate(TEXTS)]
    rows += [rows[3], (None, "no id at all", "en", "s1", 3, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_bpe_is_the_librarys(spark, odd):
    library = Tokenizer.from_file(WORDS)
    out = bpe.decode(bpe.encode(odd, WORDS), WORDS, decoded="again").collect()
    assert len(out) == odd.count()
    for r in out:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(r.ids) // 4}I", r.ids)) == want
        assert r.decoded == r.again == library.decode(want, skip_special_tokens=False)
    assert bpe.encode(odd.limit(0), WORDS).collect() == []


def test_bpe_merges_of_random_text():
    library, own = Tokenizer.from_file(WORDS), bpe.Codec(WORDS)
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("ab thein'sXé1 .,\n") for _ in range(rng.randrange(80)))
        ids, _ = own.encode(text)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == library.encode(text, add_special_tokens=False).ids


def test_bpe_of_every_code_point():
    library, own = Tokenizer.from_file(WORDS), bpe.Codec(WORDS)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for a in range(0, len(points), 20000):
        text = "".join(f"a{c}b {c}9 " for c in points[a : a + 20000])
        ids, _ = own.encode(text)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == library.encode(text, add_special_tokens=False).ids, hex(ord(points[a]))


def test_library_rules_are_read_without_the_vocabulary():
    """The driver's memory keeps what the library takes for a vocabulary, so it isn't loaded there (it grew by 53 MB)."""
    script = """if True:
        import re, tokenizers
        from seriesforge.llm import bpe

        def held():
            return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

        before = held()
        assert bpe.unlike(PATH)
        print(held() - before)
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", script.replace("PATH", repr(WORDS))], cwd=root, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=120, check=True)
    assert float(out.stdout) < 25


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_merges_side_by_side_are_those_of_single_words(path):
    own, rng = bpe.Codec(path), random.Random(11)
    words = {"".join(rng.choice(("a", "b", "th", "in", "é", "日", "😀", "'")) for _ in range(rng.randrange(1, 80))) for _ in range(3000)}
    words |= {"a" * n for n in range(1, 140)} | {"é" * n for n in range(1, 70)}
    words = sorted(words)
    assert own._entries(words) == [own._entry(w) for w in words]
    assert own._entries([]) == []
    own.first[:, ord("b")] = own.inner[ord("b")] = own.final[ord("b")] = -1  # a byte without a token is left out
    own.inner[ord("b")] = own.final[ord("b")] = None
    assert own._entries(words) == [own._entry(w) for w in words] and own._entries(["b", "bb"]) == [(b"", b"")] * 2


def test_new_words_take_their_merges_together(monkeypatch):
    """A tree for each new word cost most of op1's time: only words of over 65 bytes still have one."""
    library, own, calls, rng = Tokenizer.from_file(WORDS), bpe.codec(WORDS), [], random.Random(12)
    texts = [" ".join("".join(rng.choice("abcdeinorst") for _ in range(rng.randrange(1, 20))) for _ in range(40)) for _ in range(50)]
    texts += ["", "<|endoftext|> and <|startoftext|>", "z" * 66]
    single = bpe.Codec.merge
    monkeypatch.setattr(bpe.Codec, "merge", lambda self, symbols: calls.append(len(symbols)) or single(self, symbols))
    own.known.forget()
    got = own.encode_all(texts)
    for text, (ids, decoded) in zip(texts, got, strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == want and decoded == library.decode(want, skip_special_tokens=False)
    assert 66 in calls and len(calls) < 5 and "z" * 66 not in own.known


def test_byte_level_of_every_code_point():
    """Within a word, before a contraction, before a number and at a line's end. Planes 3 to 13, 15 and 16
    hold no assigned code points beyond those taken here."""
    library, own, counter = Tokenizer.from_file(BYTES), bpe.Codec(BYTES), token_counts.TokenCounter(BYTES, {})
    points = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x33500), *range(0xDFF00, 0xE1000), *range(0x10FF00, 0x110000))]
    for a in range(0, len(points), 5000):
        text = "".join(f"a{c}b {c}'s {c}1 {c}\n" for c in points[a : a + 5000])
        ids, want = own.encode(text)[0], library.encode(text, add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == want, hex(ord(points[a]))
        assert counter.count(text) == len(want)


def test_byte_level_round_trip():
    own = bpe.Codec(BYTES)
    for text in TEXTS:
        assert own.encode(text or "")[1] == (text or "")


def test_token_counts(spark, odd):
    library = Tokenizer.from_file(BYTES)
    for r in token_counts.count_tokens(odd, BYTES).collect():
        assert r.n_tokens == len(library.encode(r.text or "", add_special_tokens=False).ids)
    assert token_counts.count_tokens(odd.limit(0), BYTES).collect() == []


def test_mixing_targets_and_bounds(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(0, 400), "en", rng.choice(["a", "a", "a", "b", "c", None]), 0, "k", 7) for i in range(600)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mix(docs, (3, 1, 2), 1.5).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, mixing.mix(docs.repartition(7), (3, 1, 2), 1.5).collect()))
    assert len(out) == 600 and all(0 <= r.taken <= 2 * r["size"] for r in out)
    total = sum(r["size"] for r in out)
    assert abs(sum({r.source: r.target for r in out}.values()) - 1.5 * total) < 1e-6 * total
    # Water filling by hand: sources in order, null last, weights 3 1 2 3.
    size = {s: sum(r["size"] for r in out if r.source == s) for s in ("a", "b", "c", None)}
    weight, free, target, left = dict(zip(size, (3, 1, 2, 3))), set(size), {}, 1.5 * total
    while over := [s for s in free if weight[s] * left / sum(weight[x] for x in free) > 2 * size[s]]:
        for s in over:
            target[s] = 2 * size[s]
            free.discard(s)
        left = 1.5 * total - sum(target.values())
    for s in free:
        target[s] = weight[s] * left / sum(weight[x] for x in free)
    for s in size:
        assert {round(r.target, 6) for r in out if r.source == s} == {round(target[s], 6)}
        assert abs(sum(r.taken for r in out if r.source == s) - target[s]) <= 40


def test_mixing_odd_rows(spark, odd):
    out = mixing.mix(odd, (3, 1, 2), 1.5)
    assert out.count() == odd.count() and out.where("size = 0 AND taken > 0").count() == 0
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "kept", "size", "source_size", "target", "taken"]
    assert mixing.mix(odd.limit(0), (1,), 1.5).collect() == []
    assert {r.taken for r in mixing.mix(odd.where("doc_id < 3"), (1,), 1.5).collect()} == {0}


def test_seats_are_the_highest_quotients(spark):
    rng = np.random.default_rng(5)
    sizes = rng.integers(0, 1000, 17).tolist()
    parties = spark.createDataFrame([(0, i, s, 100, 60) for i, s in enumerate(sizes)], "g int, p int, w long, house long, most long")
    got = {r.p: r.seats for r in mixing.seats(parties, ["g"], "p", "w", "house", "most").collect()}
    bids = sorted(((s / (2 * k - 1), -i) for i, s in enumerate(sizes) for k in range(1, 61) if s), reverse=True)[:100]
    assert got == {i: sum(1 for _, j in bids if j == -i) for i in range(17)}


def near_copies(rng, n=120):
    """Copies with one to many changed words of a few bases, short texts, and passages."""
    word = lambda: rng.choice(["the", "of", "on"]) if rng.random() < 0.2 else "".join(rng.choice("abcdefgh") for _ in range(5))
    bases = [[word() for _ in range(rng.choice([5, 6, 8, 9, 10, 12, 60, 130]))] for _ in range(9)]
    passage = [word() for _ in range(55)]
    out = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            w[rng.randrange(len(w))] = word()
        if rng.random() < 0.3:
            w = w[: rng.randrange(len(w) + 1)] + passage + w[rng.randrange(len(w)) :]
        out.append((i, " ".join(w).upper() if rng.random() < 0.1 else "\n".join(w)))
    return out + [(n, None), (n + 1, ""), (n + 2, " "), (n + 3, "one two"), (n + 4, "One  two"), (n + 5, "one"), (n + 6, "w " * 200), (n + 7, "w " * 150)]


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components(spark, seed):
    docs = near_copies(random.Random(seed))
    frame = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, cluster string, n int").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(frame).collect()}
    assert got == brute.jaccard_components(docs)


def test_jaccard_of_lists_in_parts(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LIST_ROWS", 3)
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 2000)
    docs = near_copies(random.Random(4), 150)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute.jaccard_components(docs)


@pytest.mark.parametrize("rows", [8192, 5])
def test_jaccard_lists_subsets_where_they_cost_less(spark, monkeypatch, caplog, rows):
    monkeypatch.setattr(ngram_join, "LIST_ROWS", rows)
    rng = random.Random(9)
    bases = [[f"b{k}w{j}" for j in range(n)] for k, n in enumerate((9, 12, 13, 14, 15, 16, 18))]
    docs = []
    for i in range(400):
        w = list(rng.choice(bases))
        w = w[: len(w) - rng.randrange(3)] + [f"n{i}"] * rng.randrange(2)
        docs.append((i, " ".join(w[rng.randrange(2) :])))
    with caplog.at_level("INFO", ngram_join.log.name):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute.jaccard_components(docs)
    assert int(caplog.messages[-1].split()[4]) >= 5


def test_the_boundary_is_the_cheapest():
    assert ngram_join.boundary({}) == ngram_join.MOST_LIGHT
    assert ngram_join.boundary({s: (10, 0) for s in range(1, 21)}) == 3  # two subsets of four and more cost more than a prefix
    assert ngram_join.boundary({s: (10, 10_000_000) for s in range(1, 21)}) == ngram_join.MOST_LIGHT
    for a in range(1, 40):
        for b in range(a, 40):
            assert ngram_join.common(a, b) == min(c for c in range(a + b + 1) if 100 * c >= 80 * (a + b - c))


def test_jaccard_rows_of_one_id_are_one_node(spark):
    text = lambda k: " ".join(f"t{k}w{j}" for j in range(20))
    docs = [(5, text(1)), (9, text(2)), (7, text(1)), (7, text(2)), (8, ""), (5, ""), (6, text(3)), (6, text(3))]
    got = sorted(tuple(r) for r in ngram_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == sorted([(5, 16, 5), (9, 16, 5), (7, 16, 5), (7, 16, 5), (8, 0, 8), (5, 0, 5), (6, 16, 6), (6, 16, 6)])


def test_jaccard_odd_rows(spark, odd):
    out = ngram_join.jaccard_components(odd)
    assert out.count() == odd.count()
    assert [tuple(r) for r in out.where("doc_id is null").collect()] == [(None, 1, None)]
    assert ngram_join.jaccard_components(odd.limit(0)).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup(spark, seed):
    docs = near_copies(random.Random(seed))
    frame = spark.createDataFrame([(*r, "mine") for r in docs], "doc_id long, text string, kept string").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.dedup_substrings(frame).collect()}
    assert got == brute.substring_dedup(docs)
    assert sum(r[1] for r in got.values()) > 0


def test_substring_dedup_small_windows_and_odd_rows(spark, odd):
    docs = [(i, t) for i, t in near_copies(random.Random(8), 40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.dedup_substrings(frame, size=4).collect()}
    assert got == brute.substring_dedup(docs, 4)
    out = substring_dedup.dedup_substrings(odd)
    assert out.count() == odd.count() and out.where("n_removed > 0").count() == 0
    assert substring_dedup.dedup_substrings(odd.limit(0)).collect() == []


def test_a_null_id_ranks_last(spark):
    text = " ".join(map(str, range(60)))
    out = substring_dedup.dedup_substrings(spark.createDataFrame([(None, text), (9, text), (9, text)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in out) == [(-1, 60), (9, 0), (9, 0)]


def test_texts_that_repeat_themselves(spark):
    """Starts of one window in one text travel in one row, however many there are."""
    swing, line = "to fro " * 90, " ".join(f"l{k}" for k in range(60)) + " "
    docs = [(1, swing), (2, "a b c " + swing + "d"), (3, line * 5), (4, swing + "e " + line * 2), (5, line * 3 + swing), (6, "to " * 70), (6, "to " * 80), (7, "f to " * 30)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = brute.substring_dedup(docs)
    out = substring_dedup.dedup_substrings(frame)
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in out.collect()) == sorted((d, len(t.split()), *want[d][1:]) if d != 6 else (6, len(t.split()), 0, t.strip()) for d, t in docs)
    bits = spark.sparkContext.broadcast(b"\xff" * (substring_dedup.ROWS * substring_dedup.MIN_CELLS // 8))
    texts = spark.createDataFrame([(1, 1, swing), (2, 2, swing)], "id long, row long, text string").repartition(2, "id")
    gone = substring_dedup.removals(texts, "text", 50, substring_dedup.MIN_CELLS, bits).collect()
    starts = sorted(s for r in gone for s in (*range(r.lo, r.hi), *memoryview(bytes(r.more)).cast("i")))
    assert {r.id for r in gone} == {2} and starts == list(range(131)) and len(gone) <= 2


def test_thousands_of_copies_without_an_id_are_one_text(spark):
    """Copies of a long text, without an id or with one, cost no more than reading them."""
    rng = random.Random(5)
    text = " ".join(f"w{rng.randrange(400)}" for _ in range(1000))
    passage = " ".join(text.split()[100:200])
    rows = [(None, text)] * 5000 + [(9, text)] * 300 + [(4, passage)]
    out = substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert sorted(map(tuple, out), key=str) == sorted([(None, 1000, 1000, 5000), (9, 1000, 100, 300), (4, 100, 0, 1)], key=str)


def test_thousands_of_null_ids_are_told_apart(spark):
    fresh = itertools.count()
    words = lambda n: " ".join(f"w{next(fresh)}" for _ in range(n))
    passage = words(55)
    docs = [(7, passage)] + [(None, f"{words(30)} {passage} {words(30)}" if k % 3 == 0 else words(80)) for k in range(4000)]
    want = {docs[r][1]: v for r, v in brute.substring_dedup([(r, t) for r, (_, t) in enumerate(docs)]).items()}
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.text: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.dedup_substrings(frame).collect()}
    assert len(got) == len(docs) and got == want


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x}</style><script>var a="</p><p>no";</script></head><body>
<nav><ul><li><a href="/x">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div><header>Site</header>
<article><div class="entry-header"><h1>Head &amp; line</h1></div><p>One <b>two<br>three &lt;four&gt;<p>Five&nbsp;six</p><!-- c --><aside>Side</aside><form><p>Mail</p></form>
<div class="comments"><p>First!</p></div></article><div id="sidebar">More</div><footer>&copy; x</footer>"""


def test_html_main_text(spark):
    rows = [(1, "http://a.b/1", PAGE, "mine"), (2, None, None, None), (3, "x", "", ""), (4, "http://a.b/2", "plain <p>text", ""), (5, "http://c", "<article></article>", ""), (1, "http://a.b/1", PAGE, "mine")]
    out = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    got = [(r.page_id, r.text) for r in out.orderBy("page_id").collect()]
    whole = "Head & line\nOne two three <four>\nFive six"
    assert got == [(1, whole), (1, whole), (2, ""), (3, ""), (4, "plain\ntext"), (5, "")]
    assert html_extract.extract(out.limit(0)).collect() == []


@pytest.mark.parametrize("raw", ["<script>for(var i=0;i<n;i++){f(i);}</script>", "<SCRIPT>if(a<b && c){f('</p>')}</Script >", "<script>var s='<!--';</script>", "<style>p{content:'<!--<b'}</style>", "<textarea>a<b</textarea>"])
def test_html_raw_elements_end_at_their_own_tag(raw):
    page = f"<body>{raw}<article>Main {raw}<p>text</p></article>{raw}</body>"
    assert html_extract.main_text(html_extract.parsed(page), set()) == "Main\ntext"
    assert html_extract.main_text(html_extract.parsed("<p>a</p><script>b<c"), set()) == "a"


def test_html_style_tree_removes_what_a_site_repeats(spark):
    page = lambda k: f"<body><div class='top'><p>Always the same words</p></div><div class='mid'><h1>Story {k}</h1><p>Text {k * 7}</p></div><div class='end'><p>Imprint</p></div></body>"
    rows = [(k, f"https://site.org/{k}", page(k)) for k in range(12)] + [(99, "https://other.org/", page(99))]
    out = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[3] == "Story 3\nText 21"
    assert out[99] == "Always the same words\nStory 99\nText 693\nImprint"


def test_html_article_text_is_not_dropped_by_name():
    keep = """<h2 id='search'>Search</h2><section id='related-work'><p>Work</p></section><p class='side-note'>Note</p><div class='legal share'>Law</div><div id='notice-period'>Period</div>
<figure><img src='x'><table><tr><td>Cell</td></tr></table><figcaption>Caption</figcaption></figure><p>So <math><mi>x</mi></math> and <object><p>Object</p></object></p><h3 id='comments'>Comments</h3>"""
    drop = "<div class='comments'>no</div><div class='box cookie-notice'>no</div><ul id='menu'><li>no</li></ul><div id='sidebar'>no</div><div class='ad-slot-2'>no</div><ins class='adsbygoogle'>no</ins><div class='contact-form'>no</div><p class='advert'>no</p><figure><script>no</script><svg><text>no</text></svg></figure>"
    for tag in ("article", "main"):
        text = html_extract.main_text(html_extract.parsed(f"<body><{tag}>{keep}{drop}</{tag}></body>"), set())
        assert text.split() == "Search Work Note Law Period Cell Caption So x and Object Comments".split()


def test_html_deep_nesting_and_slashes(spark):
    deep = "<div>" * 5000 + "<p>inner</p>more<p>lines</p><nav>no<ul><li>no</li></ul></nav>" + "</div>" * 5000
    rows = [(1, "http://d/", f"<article><p>a</p>{deep}<p>z</p></article>"), (2, "http://d/", deep), (3, "http://d/", "<nav>" * 3000 + "no" + "</nav>" * 3000 + "<p>yes"), (4, "http://d/", "<b>" * 4000 + "bold")]
    rows += [(5, "http://d/", "<article><p>see <a href=http://x/>the link</a> and <math><mspace/><mi>x</mi></math><div/>end</article><p>no"), (6, "http://d/", "<article>" + "word " * 400_000 + "</article>")]
    out = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[1] == "a\ninner\nmore\nlines\nz" and out[2] == "inner\nmore\nlines" and out[3] == "yes" and out[4] == "bold"
    assert out[5] == "see the link and x\nend" and out[6] == " ".join(["word"] * 400_000)


def style_tree(pages):
    """{host: low paths} of (url, html), added up in plain Python."""
    sites = {}
    for url, page in pages:
        host = (url or "").lower().partition("//")[2].partition("/")[0]
        found, root = {}, html_extract.parsed(page)
        html_extract.style(root, found)
        html_extract.inner(root, found)
        text = html_extract.main_text(root, set())
        for key, (look, content, other) in found.items():
            sites.setdefault((host, key), {}).setdefault(text, []).append((look, content, other))

    def entropy(values):
        n = len(values)
        return 1.0 if n == 1 else -sum(c / n * math.log(c / n) for c in collections.Counter(values).values()) / math.log(n)

    low = {}
    for (host, key), by_text in sites.items():
        looks, contents, others = zip(*(rows[0] for rows in by_text.values()))
        known = [o for o in others if o is not None]
        apart = len(set(known)) / len(known) if known else 1.0
        importance = (1 - html_extract.DEPTH_SHARE) * entropy(looks) + html_extract.DEPTH_SHARE * entropy(contents)
        if len(looks) >= html_extract.MIN_PAGES and importance < html_extract.LOW and apart >= html_extract.APART:
            low.setdefault(host, set()).add(key)
    return low


def test_html_style_tree_is_the_plain_one(spark):
    rng = random.Random(21)
    words = [f"w{k}" for k in range(40)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    pages = []
    for host in range(5):
        fixed = [some(8) for _ in range(3)]
        for _ in range(rng.randrange(2, 12)):
            boxes = [f"<div class='x{k}'><p>{fixed[k] if rng.random() < (0.99, 0.9, 0.4)[k] else some(8)}</p></div>" for k in range(3)]
            inner_box = f"<section class='y'><ul><li>{fixed[0]}</li></ul></section>" if host % 2 else ""
            body = f"<article><p>{some(30)}</p>{inner_box}</article>" if host < 4 else f"<div class='c'><p>{some(30)}</p></div>"
            pages.append((f"http://h{host}.org/{len(pages)}", f"<html><body>{boxes[0]}{boxes[1]}{body}{boxes[2]}</body></html>"))
    want = style_tree(pages)
    rows = html_extract.low_branches(spark.createDataFrame(pages, "url string, html string").repartition(5), "url", "html").collect()
    assert {r.host: set(r["__low"]) for r in rows} == want and sum(map(len, want.values())) >= 4


def test_html_copies_of_an_article_stay(spark):
    page = lambda t: f"<body><div class='top'><p>Top</p></div><div class='wrap'><article><h1>{t}</h1><p>Text of {t}</p></article></div></body>"
    plain = lambda t: f"<body><div class='mid'><h1>{t}</h1><p>Text of {t}</p></div></body>"
    for made in (page, plain):
        rows = [(k, "https://copies.org/", made("other" if k == 9 else "copied")) for k in range(10)]
        out = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert out == {k: "other\nText of other" if k == 9 else "copied\nText of copied" for k in range(10)}


def test_html_boxes_that_articles_of_a_site_repeat_go(spark):
    body = lambda k: " ".join(f"word{k}x{j}" for j in range(40))
    page = lambda t, b: f"<body><article><h1>{t}</h1><div class='x0'><p>{b}</p></div><div class='x1'><p>Get our letter</p></div><p>End of {t}</p></article></body>"
    differing = [(k, "https://site.org/", page(f"T{k}", body(k))) for k in range(12)]
    copies = [(100 + k, "https://copies.org/", page("T", body(0))) for k in range(12)]
    near = [(200 + k, "https://near.org/", page("T", f"{body(0)} and {k}")) for k in range(12)]
    out = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(differing + copies + near, "page_id long, url string, html string")).collect()}
    for k in range(12):
        assert out[k] == f"T{k}\n{body(k)}\nEnd of T{k}"
        assert out[100 + k] == f"T\n{body(0)}\nGet our letter\nEnd of T"
        assert out[200 + k] == f"T\n{body(0)} and {k}\nGet our letter\nEnd of T"


def test_quality_is_fitted_in_a_task(spark, monkeypatch):
    """The sample stays on the executors: the driver collects a row a risk (before: the words of each labelled document)."""
    docs = spark.createDataFrame([(i, ("bad spam " if i % 2 else "good words ") * 20 + f"w{i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    collected, collect = [], type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda self: collected.append(rows := collect(self)) or rows)
    models = quality.fitted(docs, labels, "doc_id", "text")
    assert sum(map(len, collected)) == 2 and models["toxic"] == 0.0 and len(models["low"]) > quality.BUCKETS
    assert quality.fitted(docs.limit(0), labels, "doc_id", "text") == {"low": 0.0, "toxic": 0.0}


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang", "source")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    held = F.col("doc_id") % 3 == 0
    fitted = quality.fitted(docs.where(~held), labels.where(~held), "doc_id", "text")
    scored = quality.risks(docs.where(held), fitted, "text").join(labels, "doc_id")
    good = scored.select(((F.col("__p_low") >= 0.5) | (F.col("__p_toxic") >= 0.5)).alias("bad"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("is_bad")).collect()
    clean = [r for r in good if not r.is_bad]
    bad = [r for r in good if r.is_bad]
    assert sum(r.bad for r in clean) <= 0.005 * len(clean)
    assert sum(r.bad for r in bad) >= 0.85 * len(bad)  # a quarter of the toxic labels have no word for it


def test_quality_odd_rows(spark, odd):
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (None, 0, 1), (7, None, None), (3, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.classify(odd, labels)
    assert out.count() == odd.count() and out.where("kept is null").count() == 0
    none = quality.classify(odd, labels.limit(0))
    assert none.where("NOT kept").count() == 0 and quality.classify(odd.limit(0), labels).collect() == []


def test_hosts_are_shrunk_by_their_evidence(spark):
    rows = [("big", "x", 0.9)] * 200 + [("big", "y", 0.1)] * 200 + [("rare", "x", 0.9)] + [("other", "x", 0.1)] * 200
    frame = spark.createDataFrame([(h, p, v, v) for h, p, v in rows], "host string, path string, __p_low double, __p_toxic double")
    got = {(r.host, r.path): r for r in quality.posteriors(frame, "host", "path").collect()}
    assert got["big", "x"].path_low > 0.85 and got["big", "y"].path_low < 0.15
    assert abs(got["rare", "x"].path_low - got["rare", "x"].corpus_low) < 0.9 - got["rare", "x"].corpus_low


def test_a_document_is_no_evidence_for_itself(spark):
    """Alone on its path and host, a document's risk is its own and the corpus's, not its own twice."""
    frame = spark.createDataFrame([("big", "x", v) for v in (0.2, 0.4) * 50] + [("alone", "y", 0.9)], "host string, path string, __p_low double").withColumn("__p_toxic", F.lit(0.5))
    groups = quality.posteriors(frame, "host", "path")
    g = groups.select(F.col("host").alias("h"), F.struct(*groups.columns[2:]).alias("__g"))
    row = frame.join(g, F.col("host") == F.col("h")).where("host = 'alone'").select(quality.path_of_others("low").alias("p"), "__g.corpus_low").first()
    assert abs(row.p - row.corpus_low) < 1e-9


def test_quality_query_is_the_models_risk_moved_by_brute_force_posteriors(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang", "source")
    models = quality.fitted(docs, spark.read.parquet(f"{d}/labels.parquet"), "doc_id", "text")
    raw = quality.risks(docs, models, "text").collect()
    got = {r.doc_id: r for r in quality.op8_quality(spark, d).collect()}
    assert len(got) == len(raw)
    odds = lambda p: math.log(max(min(p, 1 - 1e-6), 1e-6) / (1 - max(min(p, 1 - 1e-6), 1e-6)))
    want = {}
    for risk in quality.RISKS:
        corpus, paths = brute.path_posteriors([(r.source, r.lang, r[f"__p_{risk}"]) for r in raw])
        for r, of_others in zip(raw, paths):
            want[r.doc_id, risk] = 1 / (1 + math.exp(-(odds(r[f"__p_{risk}"]) + odds(of_others) - odds(corpus))))
            assert abs(got[r.doc_id][f"risk_{risk}"] - want[r.doc_id, risk]) < 1e-9
    assert all(r.kept == (want[i, "low"] < 0.5 and want[i, "toxic"] < 0.5) for i, r in got.items())


def test_quality_long_texts_and_clashing_columns(spark):
    rows = [(k, "word " * 3 if k else "fine words here " * 200_000, "en", "s", "mine", 7.0, "x") for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept string, risk_low double, host string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    out = quality.classify(docs, labels)
    assert sorted(out.columns) == sorted([*docs.columns, "risk_toxic"]) and dict(out.dtypes)["kept"] == "boolean"
    assert {r.doc_id: len(r.text) for r in out.collect()} == {r[0]: len(r[1]) for r in rows}
    assert all(0 <= r.risk_low <= 1 and r.host == "x" for r in out.collect())
