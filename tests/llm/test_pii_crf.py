"""The patterns against plain regular expressions, the field against enumeration, and what it finds on held-out rows."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quarrymill.llm import pii_crf
from quarrymill.llm.pii_labelled import KINDS, labelled_rows
from quarrymill.llm.queries import queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        double = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
        return 13 <= len(digits) <= 19 and (sum(double) + sum(map(int, digits[::-2]))) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text):
    return [(kind, *m.span()) for kind, p in PATTERNS.items() for m in re.finditer(p, text) if good(kind, m.group())]


def written(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


@pytest.fixture(scope="module")
def field():
    return pii_crf.fit(labelled_rows())


def test_patterns_equal_plain_expressions():
    rng = random.Random(3)
    for letters, most in (("a.@-b", 30), ("1.2", 40), ("12 -", 60), ("+1 (2).-", 60), ("a1@.+ -é", 50), ("4111 -", 30)):
        for _ in range(3000):
            text = "".join(rng.choice(letters) for _ in range(rng.randrange(most)))
            assert pii_crf.base_spans(text) == plain(text), text


def test_patterns_take_linear_time_on_long_runs():
    for run in ("a" * 2_000_000, "1" * 2_000_000, "+1" + "(" * 2_000_000, "@" * 1_000_000, "a@" * 500_000, "1." * 1_000_000):
        assert all(k in KINDS for k, *_ in pii_crf.base_spans(run))


def random_model(rng):
    return rng.normal(size=(pii_crf.LABELS, pii_crf.LABELS)), pii_crf.LABELS


def best_by_enumeration(scores, steps):
    def value(path):
        held = [0, *path, 0]
        return sum(steps[a, b] for a, b in itertools.pairwise(held)) + sum(s[p] for s, p in zip(scores, path, strict=True))

    return max(itertools.product(range(scores.shape[1]), repeat=len(scores)), key=value)


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(1)
    steps, k = random_model(rng)
    steps = np.where(pii_crf.ALLOWED, steps, -np.inf)
    lengths = np.array([1, 3, 2, 4, 1])
    scores = rng.normal(size=(lengths.sum(), k)) * 2
    got, at = pii_crf.viterbi(scores, lengths, steps), 0
    for n in lengths:
        assert tuple(got[at : at + n]) == best_by_enumeration(scores[at : at + n], steps)
        at += n


def test_likelihood_sums_to_one_and_has_its_gradients():
    rng = np.random.default_rng(2)
    steps, k = random_model(rng)
    lengths = np.array([3, 1, 2])
    mask = np.arange(3)[None] < lengths[:, None]
    scores = rng.normal(size=(3, 3, k))
    allowed = [p for p in itertools.product(range(k), repeat=3) if all(pii_crf.ALLOWED[a, b] for a, b in itertools.pairwise([0, *p]))]
    one = scores[:1]
    total = sum(np.exp(pii_crf.likelihood(one, mask[:1], np.array([p]), steps)[0]) for p in allowed)
    assert abs(total - 1) < 1e-9
    labels = np.array([[1, 2, 0], [3, 0, 0], [0, 5, 0]])
    _, by_score, by_step = pii_crf.likelihood(scores, mask, labels, steps)
    for _ in range(30):
        i, t, y = rng.integers(3), rng.integers(3), rng.integers(k)
        up, down = scores.copy(), scores.copy()
        up[i, t, y] += 1e-5
        down[i, t, y] -= 1e-5
        slope = (pii_crf.likelihood(up, mask, labels, steps)[0] - pii_crf.likelihood(down, mask, labels, steps)[0]) / 2e-5
        assert abs(slope - by_score[i, t, y]) < 1e-5
        a, b = rng.integers(k), rng.integers(k)
        up, down = steps.copy(), steps.copy()
        up[a, b] += 1e-5
        down[a, b] -= 1e-5
        slope = (pii_crf.likelihood(scores, mask, labels, up)[0] - pii_crf.likelihood(scores, mask, labels, down)[0]) / 2e-5
        assert not pii_crf.ALLOWED[a, b] or abs(slope - by_step[a, b]) < 1e-5


def test_minimum_of_a_quadratic():
    a = np.diag([1.0, 10.0, 100.0])
    target = np.array([3.0, -2.0, 1.0])
    got = pii_crf.minimum(lambda x: (float((x - target) @ a @ (x - target)), 2 * a @ (x - target)), np.zeros(3), 100)
    assert np.allclose(got, target, atol=1e-2)


def test_stretches_give_the_path_of_whole_texts(field):
    """Without leaving out what can't be in a span, whole texts have the same path."""
    texts = pa.array([t for t, _ in labelled_rows(300, 5)] + ["", " ", "plain words only", "1 2 3 4 5 6 7 8 9"])
    tokens = pii_crf.Tokens(texts)
    whole = pii_crf.viterbi(field.scores(tokens), np.bincount(tokens.text, minlength=len(texts))[np.unique(tokens.text)], field.steps)
    assert field.decode(tokens).tolist() == whole.tolist()
    assert 0 < field.undecided(tokens, field.scores(tokens)).mean() < 0.9


def test_held_out_rows(field):
    rows = labelled_rows(600, 99)
    found = zip(*(x.tolist() for x in pii_crf.field_spans(field, pa.array([t for t, _ in rows]))), strict=True)
    got = {(i, KINDS[k], a, b) for i, k, a, b in found}
    want = {(i, *s) for i, (_, spans) in enumerate(rows) for s in spans}
    assert len(got & want) / len(got) > 0.95 and len(got & want) / len(want) > 0.93


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    got = queries()["op13_pii_crf"](spark, folder).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        text, want = texts[r.doc_id], plain(texts[r.doc_id])
        counts = Counter(k for k, *_ in want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(counts[k] for k in PATTERNS)
        assert r.base_sha256 == hashlib.sha256(written(want).encode()).hexdigest()
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        assert set(want) <= set(spans) and spans == sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1]))
        assert not spans or re.search("[0-9@]", text)
        for m in re.finditer(r"(?<!\w)[0-9]{16}(?!\w)", text):  # cards, also those that fail the check digit
            assert any(a <= m.start() and m.end() <= b for _, a, b in spans)


def test_defined_cases(spark):
    texts = [None, "", " ", "me@here.org and 4111 1111 1111 1111", "me@here.org and 4111 1111 1111 1111", "word " * 50_000 + "+1 (212) 555-0187", "é😀 a@b.c", "10.0.0.1 300.1.1.1"]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)] + [(None, "1.2.3.4", 1, "x")], "doc_id long, text string, spans int, kind string")
    labelled = pii_crf.labelled_table(spark)
    got = {r.doc_id: r for r in pii_crf.find_private(docs, labelled).collect()}
    assert len(got) == len(texts) + 1 and got[0].spans == got[1].spans == got[2].spans == ""
    assert got[3].spans == got[4].spans == "email:0:11,card:16:35"
    assert got[5].spans == "phone:250000:250017" and got[6].spans == "email:3:8"
    assert got[7].n_ip == 1 and got[7].spans.startswith("ip:0:8") and got[None].spans == "ip:0:7"
    assert pii_crf.find_private(docs.limit(0), labelled).count() == 0
    alone = {r.doc_id: r.spans for r in pii_crf.find_private(docs, labelled.limit(0)).collect()}
    assert alone[3] == "email:0:11,card:16:35" and alone[7] == "ip:0:8"


def test_added_spans_touch_no_other():
    own = [("ip", 5, 10), ("email", 20, 30), ("email", 2, 4)]
    added = [("card", 0, 2), ("card", 4, 5), ("card", 9, 12), ("phone", 10, 20), ("phone", 25, 26), ("phone", 29, 40), ("secret", 40, 41)]
    assert pii_crf.apart(own, added)[3:] == [("card", 0, 2), ("card", 4, 5), ("phone", 10, 20), ("secret", 40, 41)]
