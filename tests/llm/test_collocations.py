"""Collocations against their SQL and a plain count, with fingerprints that collide too."""

import random
import re
from collections import Counter

import duckdb
import pytest

from quarrymill.llm import collocations as c
from quarrymill.llm.queries import OP11_SQL, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, cover, most, longest=4):
    """rows: (lang, text)."""
    f, size = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            size[lang] += len(words)
            for n in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + n])) for i in range(len(words) - n + 1))
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    longer = Counter()
    for (lang, w), a in candidates.items():
        for n in range(2, len(w)):
            for i in range(len(w) - n + 1):
                longer[lang, w[i : i + n]] = max(longer[lang, w[i : i + n]], a)
    out = {}
    for (lang, w), a in candidates.items():
        if 100 * longer[lang, w] >= cover * a:
            continue
        score, _, l, r = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))  # noqa: E741
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, rank, p.decode(), -a, l, r, size[lang], -s) for lang, own in out.items() for rank, (s, a, p, l, r) in enumerate(sorted(own)[:most], 1))  # noqa: E741


def result(df):
    return sorted(tuple(r) for r in df.drop("at_key", "at_byte").collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = ["a", "B", "the", "of", "é", "日本", "x" * 300, "ab", "A", "#$", "Straße", "İ"]
    texts = ["".join(rng.choice(words) + rng.choice((" ", " ", " ", "  ", "\t", ". ", "\n", "!", ",", " \x0b")) for _ in range(rng.randrange(0, 60))) for _ in range(150)]
    return [(rng.choice(("en", "de", None)), t) for t in texts] + [("en", None), ("en", ""), ("fr", "..."), ("en", "the of the of the of " * 200)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, "x") for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, a int, phrase string")


def test_equals_a_plain_count(spark, rows):
    docs = frame(spark, rows)
    for least, cover, most in ((3, 80, 50), (5, 50, 2000), (2, 101, 10)):
        got = c.collocations(docs, least=least, cover=cover, most=most)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score", "at_key", "at_byte"]
        assert result(got) == plain(rows, least, cover, most)
    assert c.collocations(docs.limit(0)).count() == 0


def test_colliding_fingerprints_are_told_apart_by_text(spark, rows, monkeypatch):
    """With fingerprints of three bits nearly all collide; the counts stay those of the texts."""
    whole = c.mixed
    monkeypatch.setattr(c.Fingerprints, "of", lambda self, n, of=c.Fingerprints.of: (lambda at, v: (at, v & c.np.uint64(7)))(*of(self, n)))
    docs = frame(spark, rows)
    assert result(c.collocations(docs, least=4)) == plain(rows, 4, 80, 2000) and c.mixed is whole


def test_places_show_the_phrase(spark, rows):
    texts = {i: (t or "").encode().lower() for i, (_, t) in enumerate(rows)}
    for r in c.collocations(frame(spark, rows), least=3).collect():
        assert " ".join(texts[r.at_key][r.at_byte :].decode().split(maxsplit=len(r.phrase.split(" ")))).startswith(r.phrase.split(" ")[0])


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    with duckdb.connect() as d:
        d.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
        result_ = d.execute(OP11_SQL)
        names = [x[0] for x in result_.description]
        want = sorted(result_.fetchall())
    got = queries()["op11_collocations"](spark, folder)
    assert got.columns == names and sorted(tuple(r) for r in got.collect()) == want and want


def test_repeated_and_null_keys(spark):
    docs = spark.createDataFrame([(None, "good day to you", None)] * 3 + [(1, "good day", "en")], "doc_id long, text string, lang string")
    assert [(r.lang, r.phrase, r.a, r.n) for r in c.collocations(docs, least=3).collect()] == [("und", "good day to you", 3, 12)]
