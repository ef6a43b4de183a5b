"""Nulls, empty and long texts, repeated rows, ties, empty tables and clashing column names, and larger brute-force checks."""

import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarrymill.llm import bit_packing, bm25_packing, eb_classifier, html_mincut, icws_dedup, jpeg_thumbnails, llr_rules, piece_merge, two_pass_shuffle, url_trie

LONG = "word and another. " * 30_000
TEXTS = [None, "", " ", "a", "\n\n", "x" * 3000, LONG, "same text here", "same text here", "tab\tand nbsp  two", "日本語 😀 <|endoftext|> it's"]
COLUMNS = "doc_id long, text string, source string, lang string, shard string, slot int, k int, t int, row int, n int, bucket int, label int, kept boolean, host string, good int, bands int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "s" if i % 2 else None, None, "x", 1, 2, 3, 4, 5, 6, 7, True, "h", 1, 9) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[3], (None, *rows[7][1:])], COLUMNS)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3, 1, 0), (5, 0, 0), (None, 1, None), (6, None, 1)], "doc_id long, quality int, toxic int")


BYTE, WORD, PIECE = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def size(df):
    return F.octet_length(F.coalesce("text", F.lit(""))) + 16


OPERATORS = {
    "media": lambda d, y: jpeg_thumbnails.media_digests(d),
    "stored": lambda d, y: jpeg_thumbnails.thumbnails(jpeg_thumbnails.store_texts(d), "media", "doc_id"),
    "rules": lambda d, y: llr_rules.judge_documents(d, llr_rules.trusted_keys(y)),
    "pieces": lambda d, y: piece_merge.encode_texts(d, PIECE),
    "shuffle": lambda d, y: two_pass_shuffle.two_pass_shuffle(d, "doc_id", size(d), 3),
    "shards": lambda d, y: two_pass_shuffle.write_shards(d, "doc_id", size(d), 3),
    "urls": lambda d, y: url_trie.filter_urls(d, [("block", "com", "/")], "doc_id", "text"),
    "classifier": lambda d, y: eb_classifier.classify(d, y),
    "duplicates": lambda d, y: icws_dedup.near_duplicates(d),
    "bits": lambda d, y: bit_packing.packed_ids(d, WORD, 49_408, 2),
    "html": lambda d, y: html_mincut.extract(d, "text"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_a_result(docs, none, labels, name):
    assert OPERATORS[name](docs, labels).count() == docs.count()
    assert OPERATORS[name](none, labels.limit(0)).count() == 0


def test_filters_keep_the_columns(docs, none, labels):
    for made in (llr_rules.filter_quality(docs, labels), eb_classifier.filter_good(docs, labels), icws_dedup.without_near_duplicates(docs)):
        assert made.columns == docs.columns and made.count() <= docs.count()
    assert llr_rules.filter_quality(none, labels.limit(0)).count() == 0


def test_packing_of_odd_documents(docs, none):
    made = bm25_packing.pack(docs, BYTE, 1, public_tokenizers.path("byte_bpe_50k.tiktoken"), with_ids=True).toPandas()
    tokenizer = Tokenizer.from_file(BYTE)
    want = Counter(i for r in docs.collect() for i in [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1])
    assert Counter(i for ids in made["ids"] for i in ids) == want
    assert bm25_packing.pack(none, BYTE, 1).count() == 0


def test_look_ups_equal_exhaustive_bm25(spark):
    """All words of every document against all others of its shard: recall is 1, and frequencies are of all documents."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [r.text or "" for r in docs.orderBy("doc_id").collect()][:150]
    known = bm25_packing.statistics(docs, "text")
    bags = [Counter(w.strip("\x02\n.,;:!?") for w in ("\x02" + t.lower().replace("\n", " \n")).split(" ")) for t in texts]
    every = [set(re.split(" ", ("\x02" + (r.text or "").lower().replace("\n", " \n")))) for r in docs.collect()]
    assert known.n == len(every) and known.df.sum() > 0
    lengths = [b.total() for b in bags]
    import pandas as pd

    words = sorted(set().union(*bags))
    idf = dict(zip(words, known.idf(pd.util.hash_array(np.array(words, object), categorize=False)), strict=True))
    most_common = max(words, key=lambda w: sum(w in b for b in bags))
    assert idf[most_common] == min(idf.values())
    shard, encoder = bm25_packing.Shard(), bm25_packing.ByteLevel(BYTE, 1)
    for a in range(0, 150, 50):
        shard.add(pa.array(range(a, a + 50)), pa.array(texts[a : a + 50]), encoder)
    index = bm25_packing.Index(shard, known)
    used = np.zeros(150, bool)
    used[::3] = True
    for i in range(150):
        score = []
        for j in range(150):
            norm = 1.2 * (0.25 + 0.75 * lengths[j] / known.mean)
            score.append(0 if i == j else sum(idf[w] * bags[j][w] * 2.2 / (bags[j][w] + norm) for w in bags[i] if w in bags[j]))
        for free in (~used, *[np.ones(150, bool)] * (i <= 100)):
            found = index.neighbours(i, ~free | (np.arange(150) == i))
            want = sorted((j for j in range(150) if score[j] > 0 and free[j]), key=lambda j: -score[j])[: bm25_packing.NEIGHBOURS]
            assert len(found) == len(want) and np.allclose([score[j] for j in found], [score[j] for j in want], rtol=1e-4)
        if i == 100:
            index.forget(used)
            used[:] = used | (np.arange(150) % 5 == 0)
    assert len(index.live) == 100


def test_byte_level_words_equal_whole_texts():
    rng = random.Random(1)
    parts = [*"ab the, '日", "ing", "tion", " ", "\n", " the", "<|endoftext|>", "'s", "12", "\t", "\x02", "\u00a0"]
    texts = ["", " ", "\n", "a\n", " a", *("".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(1500))]
    tokenizer = Tokenizer.from_file(BYTE)
    for ranks in (None, public_tokenizers.path("byte_bpe_50k.tiktoken")):
        ids, counts, *_ = bm25_packing.ByteLevel(BYTE, 1, ranks).encode(pa.array(texts))
        ends = np.cumsum(counts)
        for t, a, b in zip(texts, ends - counts, ends, strict=True):
            assert ids[a:b].tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 1], t


def test_first_words_need_no_library():
    texts = ["", "Abc d", "'s x", "12 y", "é", "\nq", "a<b c", ",", "ab,\nab, ab"]
    encoder = bm25_packing.ByteLevel(BYTE, 1, public_tokenizers.path("byte_bpe_50k.tiktoken"), r"<\|endoftext\|>")
    ids, counts, *_ = encoder.encode(pa.array(texts))
    assert "tokenizer" not in vars(encoder)
    tokenizer = Tokenizer.from_file(BYTE)
    assert np.split(ids, np.cumsum(counts)[:-1])[2].tolist() == [*tokenizer.encode("'s x").ids, 1]
    assert ids.tolist() == [i for t in texts for i in [*tokenizer.encode(t, add_special_tokens=False).ids, 1]]
    assert encoder.encode(pa.array(["<|endoftext|>", "日 b"]))[0].tolist() == [i for t in ("<|endoftext|>", "日 b") for i in [*tokenizer.encode(t, add_special_tokens=False).ids, 1]]
    assert bm25_packing.ByteLevel(BYTE, 1).special() == r"<\|endoftext\|>"


def test_an_edit_elsewhere_keeps_the_sketch(spark):
    """An added word moves the last word of a text, but its last sentence only if it stands there."""
    text = "Some words. Where do they go? To a shard. Always. The same one."
    texts = [text, text.replace("they", "they zz"), text.replace("The same", "The very same"), "An edit. " + text, text.replace("Where", "Zz where"), "", "日本語"]
    made = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", bm25_packing.content_sketch(F.col("t")).alias("s"))
    found = [r.s for r in made.orderBy("k").collect()]
    assert found[0] == " Where do th" and set(found[:4]) == {found[0]} and found[4:] == [" Zz where do", " ", " 日本語"]


def test_words_lie_in_the_texts_bytes():
    texts = ["x", "", "a b\n\nc ", " é\tä  日", "", "\n"]
    for given in (pa.array(texts), pa.array(["skip me", *texts, "z"]).slice(1, 6), pa.array(texts, pa.large_string())):
        words, numbers, starts = bm25_packing.marked_words(given)
        found = words.take(pa.array(numbers)).to_pylist()
        assert [found[a:b] for a, b in zip(starts, starts[1:], strict=False)] == [re.split("(?=[ \n])", t) if t[:1] not in (" ", "\n") else ["", *re.split("(?=[ \n])", t)[1:]] for t in texts]


def test_word_level_parts_equal_whole_texts():
    rng = random.Random(2)
    parts = [*"abTHE, '.’é!12½²ªİßẞΣς\u0301\t\n日😀<|", "<|endoftext|>", "'S", "'ll", "ing", " ", " "]
    texts = ["", " ", *("".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(1500))]
    ids, at = bit_packing.WordLevel(WORD).encode(pa.array(texts))
    tokenizer = Tokenizer.from_file(WORD)
    for t, a, b in zip(texts, at, at[1:], strict=False):
        assert ids[a:b].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_common_words_are_cut_like_the_pattern():
    rng = random.Random(4)
    letters = [chr(c) for c in range(0x21, 0x180) if re.match("[\x21-\x7e\xa1-\u012f\u0131-\u017f]", chr(c))]
    words = ["", *letters, "'s", "it's", ".'s", "'special", *("".join(rng.choices(letters + [*"abc'12."] * 12, k=rng.randint(1, 9))) for _ in range(4000))]
    encoder = bit_packing.WordLevel(WORD)
    for given in (pa.array(words), pa.array(["skip", *words]).slice(1), pa.array([""]), pa.array([], pa.string()), pa.array(["'s"])):
        assert pc.all(encoder.common(given)).as_py() is not False
        low = pc.utf8_lower(given)
        assert encoder.cut(low).equals(pc.utf8_rtrim(pc.replace_substring_regex(low, encoder.PARTS, r"\1 "), " "))


def test_common_words_need_only_merges():
    """Neither the library's normalisation nor its pattern, which take most of its time; words are kept from call to call."""
    tokenizer = Tokenizer.from_file(WORD)
    texts = ["The End, isn't it? 12 ÄÖü½²", *(chr(c) for c in [*range(0x21, 0x7F), *range(0xA1, 0x130), *range(0x131, 0x180)]), "x" * 3000 + " The"]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    encoder = bit_packing.WordLevel(WORD)
    encoder.tokenizer, encoder.TOGETHER, encoder.KEPT = None, 7, 300
    for part in (texts, texts[:1], texts[1:], texts):
        ids, at = encoder.encode(pa.array(part))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == want[texts.index(part[0]) :][: len(part)]


def test_pieces_equal_whole_texts():
    rng = random.Random(3)
    parts = [*"ab the ing  ▁éñ\n\t日本😀ﬁ\u0301\x00xX.,", "the", "tion", " "]
    texts = ["", " ", "▁", "x" * 300, "ab" * 500, "thething" * 30, *("".join(rng.choice(parts) for _ in range(rng.randint(0, 90))) for _ in range(1500))]
    pieces = piece_merge.Pieces(PIECE)
    chunks, numbers, starts = piece_merge.chunks_of(pa.array(texts))
    ids, at = piece_merge.WordCodes(pieces.encode).ids_of(chunks, numbers, starts)
    want = sentencepiece.SentencePieceProcessor(model_file=PIECE).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == want


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 24])
def test_bit_packing_random_access(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 20_000).astype(np.uint32)
    lengths = np.array([0, 1, 4095, 4096, 11_808])
    file = bit_packing.PackedFile(bit_packing.file_bytes(np.arange(5), lengths, ids, 2**bits))
    assert file.bits == bits
    for k, (a, n) in enumerate(zip(np.cumsum(lengths) - lengths, lengths, strict=True)):
        assert np.array_equal(file.document(k), ids[a : a + n])
    with pytest.raises(ValueError):
        bit_packing.file_bytes(np.arange(1), np.array([1]), np.array([2**bits]), 2**bits)


def test_jpeg_of_any_bytes_and_broken_ones():
    rng = random.Random(4)
    payloads = [b"", b"a", bytes(range(256)), b"\xff\x00" * 200, bytes(rng.randrange(256) for _ in range(530_000))]
    media = jpeg_thumbnails.to_media(payloads)
    for p, images in zip(payloads, jpeg_thumbnails.read_media(media), strict=True):
        got = b"".join(i.thumbnail.tobytes() for i in images)
        assert got[: len(p)] == p and not any(got[len(p) :]) and len(got) % 64 == 0
    assert jpeg_thumbnails.read_media([None, b"", b"abc", media[2][:-30], media[3][:60], media[2].replace(b"\xff\xc0", b"\xff\xc2")]) == [None] * 6


def test_jpeg_cut_off_in_a_scan_whose_zeros_are_a_code():
    """The AC code of all zeros isn't the end of block, so zeros behind the data could be read for ever."""
    zeros = [0] * 16
    dc, ac = bytes([*zeros[:3], 9, *zeros[:12], *range(9)]), bytes([0, 3, *zeros[:14], 0x11, 0x12, 0x00])
    s = jpeg_thumbnails.segment
    head = b"\xff\xd8" + s(0xDB, b"\0" + bytes([8] + [1] * 63)) + s(0xC0, bytes([8, 0, 64, 0, 64, 1, 1, 0x11, 0])) + s(0xC4, b"\0" + dc) + s(0xC4, b"\x10" + ac) + s(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    bits = ("0000" + "000" * 4 + "10") * 64
    data = int(bits + "1" * (-len(bits) % 8), 2).to_bytes(-(-len(bits) // 8), "big")
    whole = head + data + b"\xff\xd9"
    assert jpeg_thumbnails.read_media([whole])[0][0].thumbnail.tolist() == [[128] * 8] * 8
    found = jpeg_thumbnails.read_media([whole[:n] for n in range(len(whole) + 1)])
    assert all(x is None or x[0].thumbnail.shape == (8, 8) for x in found) and sum(x is not None for x in found) <= 3


def test_jpeg_with_ac_coefficients_and_subsampling():
    """A colour image written here by hand: 4:2:0, AC codes, no restart markers."""
    rng, zeros = random.Random(5), [0] * 16
    dc, ac = bytes([*zeros[:3], 12, *zeros[:12], *range(12)]), bytes([0, 0, 0, 3, *zeros[:12], 0x00, 0x02, 0xF0])
    bits, luma, prediction = "", [], [0, 0, 0]
    for _ in range(2 * 3):
        for c in (0, 0, 0, 0, 1, 2):
            value = rng.randint(-500, 500)
            luma += [value] * (c == 0)
            d, prediction[c] = value - prediction[c], value
            n = abs(d).bit_length()
            bits += f"{n:04b}" + (f"{d if d > 0 else d + 2**n - 1:0{n}b}" if n else "")
            bits += "".join(rng.choice(["0001" + "01", "0001" + "10"]) for _ in range(rng.randint(0, 3))) + "0000"
    bits += "1" * (-len(bits) % 8)
    data = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")
    s = jpeg_thumbnails.segment
    media = b"\xff\xd8" + s(0xDB, b"\0" + bytes([2] + [1] * 63)) + s(0xC0, bytes([8, 0, 48, 0, 32, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])) + s(0xC4, b"\0" + dc) + s(0xC4, b"\x10" + ac) + s(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + data + b"\xff\xd9"
    prefixes = [media[:n] for n in range(len(media))]
    assert sum(x is not None for x in jpeg_thumbnails.read_media(prefixes)) <= 2  # the end marker may be missing
    huge = media.replace(bytes([8, 0, 48, 0, 32]), bytes([8, 255, 255, 255, 255]))
    assert jpeg_thumbnails.read_media([huge]) == [None]
    (image,) = jpeg_thumbnails.read_media([media])[0]
    grey = np.clip(np.rint(np.array(luma) * 2 / 8 + 128), 0, 255).astype(np.uint8).reshape(3, 2, 2, 2).transpose(0, 2, 1, 3).reshape(6, 4)
    assert (image.width, image.height) == (32, 48) and np.array_equal(image.thumbnail, grey)


def test_minimum_cut_against_all_cuts():
    rng = random.Random(6)
    for _ in range(300):
        n = rng.randint(1, 7)
        capacity = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(i, j, rng.uniform(0, 1.5)) for i in range(n) for j in range(i) if rng.random() < 0.6]
        cost = lambda side: sum(max(c, 0) if not s else max(-c, 0) for c, s in zip(capacity, side, strict=True)) + sum(w for i, j, w in edges if side[i] != side[j])  # noqa: B023, E731
        best = min(cost([m >> i & 1 == 1 for i in range(n)]) for m in range(2**n))
        assert abs(cost(html_mincut.minimum_cut(capacity, edges)) - best) < 1e-9


def test_main_text_of_a_page_without_article():
    page = """<html><body class="has-sidebar"><div id="page"><header class="site-header"><h1>Site</h1><p>Tagline of the site, a long sentence for the reader.</p></header>
    <div class="cookie-notice">We use cookies to make this site better for all.</div><div class="sidebar"><p>Popular: a long sentence that stands in the sidebar.</p></div>
    <div class="content"><h2>Title</h2><p>First paragraph with <a href=x>a link</a> and quite a few words in it, so it counts.</p><form><p>Sign up for our newsletter.</p></form><script>var a = "</p>";</script>
    <p>Second &eacute; paragraph, 1 &lt; 2.<p>Short.</div><section id="comments"><p>Great article, thanks for writing it, I have learned a lot.</p></section><footer>&copy; x</footer></div></body></html>"""
    assert html_mincut.main_text(page) == "Title First paragraph with a link and quite a few words in it, so it counts. Second é paragraph, 1 < 2. Short."
    page = """<main class="share-on"><article class="post social"><header><h1>Head</h1></header><p>A paragraph of the article, with a good many words in it.</p><aside>Aside, which is a longer sentence than it ought to be.</aside>
    <div class="notice">Notice that this sentence is not of the article.</div></article><article class="comment"><p>I am a reader, and this is what I think of it all.</p></article></main>"""
    assert html_mincut.main_text(page) == "Head A paragraph of the article, with a good many words in it."
    assert html_mincut.main_text(None) == html_mincut.main_text("<script>never closed") == ""


def test_the_cut_overrules_the_classifier():
    """Edges change the label of blocks, on the given pages too, and never for the worse there."""
    page = """<html><body><nav><a href=a>Home</a></nav><div class="content"><h2>Title</h2><p>First paragraph with quite a few words in it, so that it counts.</p><p>Short.</p><p>Last paragraph, with as many words in it as the first one.</p></div>
    <div class="social"><p>Share</p></div></body></html>"""
    blocks = html_mincut.parse(page)
    alone = [s > 0 for s in html_mincut.scores(blocks)]
    cut = html_mincut.minimum_cut(html_mincut.scores(blocks), html_mincut.edges_of(blocks))
    assert alone == html_mincut.minimum_cut(html_mincut.scores(blocks), [])
    changed = [b.text for b, x, y in zip(blocks, alone, cut, strict=True) if x != y]
    assert "Short." in changed and "Home" not in changed and "Share" not in changed
    assert html_mincut.main_text(page).startswith("Title First") and html_mincut.main_text(page).endswith("Short. Last paragraph, with as many words in it as the first one.")
    import duckdb

    flips = 0
    for (page,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.1/pages.parquet'").fetchall():
        blocks = html_mincut.parse(page)
        score = html_mincut.scores(blocks)
        flips += sum((s > 0) != k for s, k in zip(score, html_mincut.minimum_cut(score, html_mincut.edges_of(blocks)), strict=True))
    assert flips > 0


def test_names_that_only_hint_at_boilerplate():
    page = """<article><header class="entry-header"><h1>Title</h1></header><p>A paragraph of the article, with a good many words in it.</p>
    <div class="social-policy"><p>This long paragraph is about social policy and what it means for all of us.</p></div><div class="share-buttons">Share this article with all of your friends and with the others.</div></article>"""
    assert html_mincut.main_text(page) == "Title A paragraph of the article, with a good many words in it. This long paragraph is about social policy and what it means for all of us."


@pytest.mark.parametrize("page", ["<a " * 3_400_000, "<a '" * 200_000, "<a x='" * 200_000 + ">", "<option>x" * 100_000, "<div>" * 100_000 + "text" + "</p>" * 100_000 + "</div>" * 100_000, "<!--" * 200_000, "<script" * 200_000, "<script></script" * 100_000, "<" * 2_000_000, "<a x='>' y='" * 100_000, "<ul><li><a>x</a> two three. " * 30_000])
def test_pages_of_broken_tags_take_linear_time(page):
    import time

    began = time.perf_counter()
    html_mincut.main_text(page)
    assert time.perf_counter() - began < 30


def test_longest_url_rule():
    trie = url_trie.build([("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "example.com", "/en/7"), ("block", "net", ""), ("allow", "a.net", "/x/y")])
    find = lambda u: url_trie.longest(trie, *url_trie.split_url(u))
    assert find("http://EXAMPLE.com/en/78?q=/x") == ("example.com/en/7", "block")
    assert find("http://b.example.com/en/9") == ("com/en/", "block")
    assert find("http://notexample.org/en/7") is None and find(None) is None and find("example.com/en/7") is None
    assert find("x://b.a.net/x/yz#f") == ("a.net/x/y", "allow") and find("x://a.net?/x/y") == ("net", "block")


def brute_classes(texts, weights, threshold=0.8):
    """Components of all pairs by weighted Jaccard similarity, and whether plain Jaccard would have linked other pairs."""
    bags, whole = {}, {}
    for k, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        n = min(5, len(w))
        whole[k] = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else Counter()
        _, run, times = icws_dedup.shingles(pa.array([t]))
        assert sorted(times) == sorted(whole[k].values())
        bags[k] = dict(zip(run.tolist(), (times * weights.of(run)).tolist(), strict=True))
    parent, differs = {k: k for k in texts}, Counter()

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = bags[a], bags[b]
            common = sum(min(w, y[s]) for s, w in x.items() if s in y)
            if not common and texts[a] != texts[b]:
                continue
            every = sum(x.values()) + sum(y.values()) - common
            linked = texts[a] == texts[b] or common >= (threshold - 1e-9) * every
            plain = (whole[a] & whole[b]).total() >= threshold * (whole[a] | whole[b]).total()
            differs["more" if linked else "less"] += linked != plain
            if linked:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: find(k) for k in keys}, differs


def classes_of(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = icws_dedup.near_duplicates(docs).toPandas()
    want, differs = brute_classes(texts, icws_dedup.frequencies(docs))
    return dict(zip(got["doc_id"], got["class_id"], strict=True)), want, differs


def test_near_duplicates_equal_brute_force(spark):
    """A large group of near copies with few and many edits, exact copies, and unrelated texts; far from the threshold."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(5000)]
    base, texts = rng.choices(words, k=200), {}
    for i in range(150):
        own = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 12, 20])):
            own[rng.randrange(200)] = rng.choice(words)
        texts[i] = " ".join(own)
    for i in range(150, 300):
        texts[i] = " ".join(rng.choices(words, k=rng.choice([1, 3, 30, 120])))
    texts |= {300: "", 301: "", 302: texts[200]}
    ours, want, _ = classes_of(spark, texts)
    assert ours == want


def test_small_classes_of_a_crowd_equal_brute_force(spark):
    """Two hundred pairs barely at the threshold, in a crowd whose largest class is like neither of them."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(5000)]

    def edited(text, places):
        own = list(text)
        for p in places:
            own[p] = rng.choice(words)
        return own

    base = rng.choices(words, k=200)
    texts = [edited(base, rng.sample(range(200), 1)) for _ in range(300)]
    for _ in range(200):
        inner = edited(base, rng.sample(range(200), 6))
        texts += [edited(inner, rng.sample(range(200), 2)) for _ in range(2)]
    ours, want, _ = classes_of(spark, {i: " ".join(t) for i, t in enumerate(texts)})
    assert len(set(want.values())) > 50 and ours == want


def test_frequent_passages_weigh_less(spark):
    """IDF decides: texts alike but for passages that many have are linked, texts alike by such a passage are not."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(20_000)]
    new = lambda n: rng.choices(words, k=n)
    passages = [new(80), new(80)]
    texts = [new(400) + passages[i % 2] for i in range(240)]
    for _ in range(10):
        body = new(400)
        texts += [body + p for p in passages]
        small = new(60)
        texts += [small[:52] + new(8) + passages[0], small + passages[0]]
    ours, want, differs = classes_of(spark, {i: " ".join(t) for i, t in enumerate(texts)})
    assert differs["more"] >= 10 and differs["less"] >= 5
    assert ours == want


def test_given_documents_equal_weighted_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    ours, want, _ = classes_of(spark, docs)
    assert ours == want


def test_document_frequencies_are_exact(spark):
    """Each text once, and a passage in every third; copies of one text count as one."""
    rng = random.Random(10)
    words = [f"w{i}" for i in range(20_000)]
    passage, copied = rng.choices(words, k=30), " ".join(rng.choices(words, k=100))
    texts = [" ".join(rng.choices(words, k=300) + passage * (i % 3 == 0)) for i in range(600)] + [copied] * 300
    weights = icws_dedup.frequencies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    run = lambda t: icws_dedup.shingles(pa.array([t]))[1]
    assert set(weights.of(run(copied))) == {1.0}
    assert np.allclose(weights.of(run(" ".join(passage))), np.log1p(900 / 200) / np.log1p(900 / 16))
    assert len(weights.run) == 26


def test_one_key_on_several_texts(spark):
    """Rows keep their number; each class keeps one document, also where a row is repeated or has no key."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (2, a), (2, b + " end"), (1, a), (None, c), (None, c), (3, b), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = icws_dedup.near_duplicates(docs)
    assert got.count() == len(rows) and {tuple(r) for r in got.collect()} == {(1, 1, 1), (2, 1, 1), (2, 1, 2), (None, None, None), (3, 1, 1), (7, 7, 7), (8, 7, 7)}
    kept = icws_dedup.without_near_duplicates(docs).collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([(1, a), (1, b), (None, c), (7, None)], key=repr)


def test_shuffle_is_uniform_and_repeats(spark):
    docs = spark.range(4000).withColumnRenamed("id", "doc_id")
    first, again, other = (dict((r.doc_id, (r.shard, r.slot)) for r in two_pass_shuffle.two_pass_shuffle(docs, "doc_id", F.lit(1000), 4, seed, 300_000).collect()) for seed in (1, 1, 2))
    assert first == again != other
    for shard in range(4):
        own = sorted((slot, k) for k, (s, slot) in first.items() if s == shard)
        assert [x for x, _ in own] == list(range(len(own)))
        ranks = np.corrcoef([x for x, _ in own], [k for _, k in own])[0, 1]
        assert abs(ranks) < 0.15


def test_buckets_of_a_hot_key_fit_in_memory(spark):
    """Three quarters of the rows have one key, so one shard holds them: its buckets are no larger than others'."""
    docs = spark.range(20_000).select(F.when(F.col("id") % 4 < 3, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("x" * 84).alias("text"), F.lit("old").alias("shard"))
    scattered, total = two_pass_shuffle.scatter(docs, "doc_id", F.lit(100), 8, bucket_bytes=10_000)
    assert total == 2_000_000 and scattered.groupBy("shard", "bucket").count().agg(F.max("count")).first()[0] < 170
    files = two_pass_shuffle.write_shards(docs, "doc_id", F.lit(100), 8, bucket_bytes=10_000)
    got = files.toPandas()
    assert len(got) == 20_000 and set(got["text"]) == {"x" * 84} and set(got["shard"]) <= set(range(8))
    for _, own in got.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    weights = dict(spark.range(50).select("id", two_pass_shuffle.shard_of("id", 5)).collect())
    every = {(r["k"], r["s"]): r["w"] for r in spark.range(50).select(F.col("id").alias("k")).crossJoin(spark.range(5).select(F.col("id").cast("int").alias("s"))).select("k", "s", two_pass_shuffle.weight("k", F.col("s"), 0).alias("w")).collect()}
    assert all(s == max(range(5), key=lambda x: every[k, x]) for k, s in weights.items())  # noqa: B023


def test_held_out_toxic_and_junk(spark):
    from quarrymill.llm.queries import table

    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    judged = eb_classifier.classify(docs, labels.filter("doc_id % 2 = 0")).join(labels.filter("doc_id % 2 = 1"), "doc_id").toPandas()
    clean, junk, toxic = (judged["quality"] == 1) & (judged["toxic"] == 0), judged["quality"] == 0, judged["toxic"] == 1
    assert judged[clean]["kept"].mean() > 0.99 and judged[junk]["kept"].mean() < 0.05 and judged[toxic]["kept"].mean() < 0.25
