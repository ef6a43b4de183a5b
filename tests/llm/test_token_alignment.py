"""Alignment of two tokenizers against a plain walk over both, and pointer jumping against connected components."""

import hashlib
import random
from collections import Counter
from itertools import pairwise

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from quarrymill.llm.token_alignment import Ends, align, byte_characters

BYTE, RANKS, PIECE = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))
LONG = "word and another. " * 20_000
TEXTS = [None, "", " ", "a", "\n\n", "x" * 5000, LONG, "same text here", "same text here", "  tab\tand nbsp two ", "日本語 😀 <|endoftext|> it's <s> </s> <0x41> <unk>", "has ▁ in it", "naïve façade, œuvre\r\nnew", "1234567 3.14159", "same text here", " line　wide", "🏳️‍🌈 é ﻿"]


def expected(rows):
    a_lib = Tokenizer.from_file(BYTE)
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    value = {c: b for b, c in enumerate(byte_characters())}
    out, every = [], Counter()
    for key, text in rows:
        ids_a = a_lib.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b_lib.encode(text) if text else []
        bytes_a = [bytes(value[c] for c in a_lib.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b_lib.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b_lib.id_to_piece(i)]]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            ids_a, ids_b, bytes_a, bytes_b = [], [], [], []
        spans = [list(pairwise(np.cumsum([0, *map(len, x)]).tolist())) for x in (bytes_a, bytes_b)]
        common = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, links, ia, ib = [], [], 0, 0
        for hi in common:
            ga, gb = [], []
            while ia < len(ids_a) and spans[0][ia][1] <= hi:
                ga.append(ia)
                ia += 1
            while ib < len(ids_b) and spans[1][ib][1] <= hi:
                gb.append(ib)
                ib += 1
            links += [(ids_a[x], ids_b[y]) for x in ga for y in gb if spans[0][x][0] < spans[1][y][1] and spans[1][y][0] < spans[0][x][1]]
            groups.append((ga, gb))
        every.update(links)
        text_of = ";".join(",".join(str(ids_a[x]) for x in ga) + "|" + ",".join(str(ids_b[y]) for y in gb) for ga, gb in groups)
        out.append((key, len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(text_of.encode()).hexdigest() if groups else ""))
    best = {}
    for (_, b), n in every.items():
        best[b] = max(best.get(b, 0), n)
    return sorted((k, a, b, g, len(links), sum(every[x] == best[x[1]] for x in links), sum(every[x] for x in links), h) for k, a, b, g, links, h in out)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_equals_a_plain_walk(spark):
    rows = list(enumerate(TEXTS))
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, block int, pair string")
    got = align(docs, BYTE, PIECE, RANKS)
    assert got.columns == COLUMNS
    assert sorted(tuple(r) for r in got.collect()) == expected(rows)
    assert align(docs.limit(0), BYTE, PIECE).count() == 0


def test_query_equals_a_plain_walk(spark):
    from quarrymill.llm.queries import queries

    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = queries()["op12_token_alignment"](spark, folder).select(COLUMNS).collect()
    assert sorted(tuple(r) for r in got) == expected(rows)


def test_null_and_repeated_keys(spark):
    docs = spark.createDataFrame([(None, "some words"), (None, "some words"), (3, None), (3, "other words")], "doc_id long, text string")
    got = [tuple(r) for r in align(docs, BYTE, PIECE).collect()]
    assert Counter(r[0] for r in got) == {None: 2, 3: 2} and sum(r[1] == 0 for r in got) == 1


def test_successor_doubling_finds_components():
    rng = random.Random(5)
    for _ in range(200):
        size = rng.randint(1, 60)
        a, b = (np.array(sorted({*rng.sample(range(1, size + 1), rng.randint(0, size)), size})) for _ in range(2))
        common = np.intersect1d(a, b)
        got_a, got_b = Ends.of(a, b).labels()
        assert got_a.tolist() == [int(np.flatnonzero(a == common[np.searchsorted(common, e)])[0]) for e in a]
        assert got_b.tolist() == [int(np.flatnonzero(a == common[np.searchsorted(common, e)])[0]) for e in b]


def test_a_long_chain_of_overlaps_is_one_group():
    a, b = np.append(np.arange(2, 200_001, 2), 200_001), np.append(np.arange(1, 200_000, 2), [200_001])
    got_a, got_b = Ends.of(a, b).labels()
    assert len(set(got_a.tolist()) | set(got_b.tolist())) == 1
