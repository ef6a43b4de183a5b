"""The contract queries on the smallest tables, against plain computation."""

import re
import zlib
from collections import Counter
from hashlib import sha256

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quarrymill.llm import queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


def rows(spark, name):
    return queries.queries()[name](spark, SF).toPandas()


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_media_give_the_payload_back(spark, docs):
    for r in rows(spark, "op2_jpeg_thumbnails").itertuples():
        raw = docs[r.doc_id].encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_packing_covers_every_id_once(spark, docs):
    got = rows(spark, "op3_bm25_packing")
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for k, own in got.groupby("doc_id"):
        ids, at = [*tokenizer.encode(docs[k], add_special_tokens=False).ids, 1], 0
        for p in own.sort_values("start").itertuples():
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), crc(ids[at : at + p.length]))
            at += p.length
        assert at == len(ids)
    assert set(got["doc_id"]) == set(docs)
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own["offset"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]] and own["length"].sum() <= 2048
    used = got.groupby("sequence_id")["length"].sum()
    assert used.sum() / (2048 * len(used)) > 0.98


def base(text):
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, docs):
    got = rows(spark, "op4_llr_rules")
    for r in got.itertuples():
        n, *_, repeats = want = base(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (n < 20 or 100 * repeats > 30 * n) and (not r.kept or not r.base_failed)
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet' WHERE toxic = 0").df()
    joined = got[~got["base_failed"]].merge(labels, on="doc_id")
    assert joined[joined["quality"] == 1]["kept"].mean() > 0.98
    assert joined[joined["quality"] == 0]["kept"].mean() < 0.1


def test_pieces_equal_the_library(spark, docs):
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in rows(spark, "op5_piece_merge").itertuples():
        ids = lib.encode(docs[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256(lib.decode(ids).encode()).hexdigest())


def test_shards_are_by_key(spark, docs):
    got = rows(spark, "op6_two_pass_shuffle")
    assert sorted(got["doc_id"]) == sorted(docs)
    for _, own in got.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    moved = got[got["grown_shard"] != got["shard"]]
    assert (moved["grown_shard"] == 40).all() and len(moved) < 0.1 * len(got)
    for r in got.itertuples():
        raw = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), "key")
    assert got.sort_values(["shard", "slot"])["doc_id"].tolist() != got.sort_values(["shard", "doc_id"])["doc_id"].tolist()


def test_url_rules_equal_sql(spark):
    got = rows(spark, "op7_url_trie").sort_values("page_id").reset_index(drop=True)
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
        want = c.execute(queries.OP7_SQL).df().sort_values("page_id").reset_index(drop=True)
    for column in ("page_id", "host", "path", "verdict"):
        assert got[column].tolist() == want[column].tolist()
    assert got["rule"].fillna("").tolist() == want["rule"].fillna("").tolist()


def test_classifier_keeps_clean_documents(spark):
    got = rows(spark, "op8_eb_classifier")
    labels = duckdb.sql(f"SELECT doc_id, quality = 1 AND toxic = 0 AS clean FROM '{SF}/labels.parquet'").df()
    joined = got.merge(labels, on="doc_id")
    assert joined[joined["clean"]]["kept"].mean() > 0.95
    assert len(got) == got["doc_id"].nunique()


def test_packed_ids_equal_the_tokenizer(spark, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got, start = rows(spark, "op10_bit_packing").set_index("doc_id"), 0
    for k in sorted(docs):
        ids = [*tokenizer.encode(docs[k], add_special_tokens=False).ids, 2]
        assert got.loc[k].tolist() == [start, len(ids), crc(ids)]
        start += len(ids)


def test_main_text_is_the_article(spark):
    pages = dict(duckdb.sql(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall())
    import html

    for r in rows(spark, "op1_html_mincut").itertuples():
        article = re.search("<article>(.*)</article>", pages[r.page_id], re.S).group(1)
        want = " ".join(html.unescape(re.sub("</?b>", "", re.sub("</?(p|h1|br)>", " ", article))).split())
        assert (r.text, r.n_chars) == (want, len(want))
