"""What the quality operators' models add, against plain Python: ratios and verdicts, the optimum, moments and shrinkage."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from quarrymill.llm import eb_classifier, llr_rules

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_ratio_and_verdict(tables):
    docs, labels = tables
    trusted = {r.doc_id for r in labels.collect() if r.quality == 1 and not r.toxic}
    hashed = {}

    def run_hash(run):
        if run not in hashed:
            hashed[run] = int(pd.util.hash_array(np.array([run], object), categorize=False)[0])
        return hashed[run]

    def grams(text):
        runs = [run_hash(r) for w in WORD.findall(text) for r in re.findall(r"[^\W_]+|[\W_]+", w)]
        values = runs + [(a * int(llr_rules.PRIME)) % 2**64 ^ b for a, b in zip(runs, runs[1:], strict=False)]
        return [((v * int(llr_rules.OTHER)) % 2**64 >> 48) % llr_rules.BINS for v in values]

    of = {r.doc_id: grams(r.text or "") for r in docs.collect()}
    raw, target = Counter(), Counter()
    for key, found in of.items():
        raw.update(found)
        target.update(found if key in trusted else ())
    all_raw, all_target = raw.total() + llr_rules.BINS, target.total() + llr_rules.BINS
    judged = llr_rules.judge_documents(docs.select("doc_id", "text"), llr_rules.trusted_keys(labels)).collect()
    assert len(judged) == len(of)
    for r in judged:
        found = of[r.row.doc_id]
        want = sum(math.log((target[b] + 1) / all_target) - math.log((raw[b] + 1) / all_raw) for b in found) / max(len(found), 1)
        assert math.isclose(r.ratio, want, rel_tol=1e-9, abs_tol=1e-9)
        assert r.kept == (not r.base_failed and r.ratio >= llr_rules.THRESHOLD)
    assert {r.kept for r in judged} == {True, False}


def test_regression_reaches_its_optimum():
    """The penalised loss after the fixed number of steps, against that of plain proximal steps until nothing moves."""
    rng = np.random.default_rng(4)
    x = (rng.random((400, 30)) < 0.3).astype(float)
    good = rng.random(400) < 1 / (1 + np.exp(-(2.0 * x[:, 0] - 2.5 * x[:, 1] + 0.5)))
    weights, bias = eb_classifier.fit_sparse(*np.nonzero(x), good, 30)

    def loss(w, b):
        z = np.where(good, 1, -1) * (b + x @ w)
        return np.logaddexp(0, -z).mean() + eb_classifier.PENALTY * np.abs(w).sum()

    w, b, step = np.zeros(30), 0.0, 4 * 400 / (np.linalg.norm(np.c_[x, np.ones(400)], 2) ** 2)
    for _ in range(100_000):
        off = 1 / (1 + np.exp(-(b + x @ w))) - good
        moved = w - step * x.T @ off / 400
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * eb_classifier.PENALTY, 0)
        still = max(np.abs(new - w).max(), abs(off.mean())) < 1e-10
        w, b = new, b - step * off.mean()
        if still:
            break
    assert still and loss(w, b) <= loss(weights, bias) + 1e-12
    assert loss(weights, bias) - loss(w, b) < 1e-5
    assert np.abs(weights - w).max() < 0.05


def strength(sites):
    """sites: (n, good, parent)."""
    n = sum(s[0] for s in sites)
    spread = sum(s[0] * (s[1] / s[0] - s[2]) ** 2 for s in sites)
    noise = sum(s[2] * (1 - s[2]) for s in sites)
    base = sum(s[0] * s[2] * (1 - s[2]) for s in sites)
    return min(max(base / n / max((spread - noise) / n, 1e-6) - 1, 1.0), 1e6)


def test_shares_are_shrunk_to_their_parents(tables):
    docs, labels = tables
    rows = eb_classifier.classify(docs, labels).collect()
    assert len(rows) == docs.count()
    rated = [r for r in labels.collect() if r.quality is not None]
    start = min(max(sum(r.quality == 1 and not r.toxic for r in rated) / len(rated), 0.01), 0.99)
    chance = {r.doc_id: 1 / (1 + math.exp(-(math.log(start / (1 - start)) + r.evidence))) for r in rows}
    paths, hosts = defaultdict(list), defaultdict(list)
    for r in rows:
        paths[r.host, r.path].append(chance[r.doc_id])
        hosts[r.host].append(chance[r.doc_id])
    share = min(max(sum(chance.values()) / len(chance), 1e-3), 1 - 1e-3)
    k = strength([(len(v), sum(v), share) for v in hosts.values()])
    parent = {h: (sum(v) + k * share) / (len(v) + k) for h, v in hosts.items()}
    k = strength([(len(v), sum(v), parent[h]) for (h, _), v in paths.items()])
    for r in rows:
        own = paths[r.host, r.path]
        site = (max(sum(own) - chance[r.doc_id], 0.0) + k * parent[r.host]) / (len(own) - 1 + k)
        want = 1 / (1 + math.exp(-(math.log(site / (1 - site)) + r.evidence)))
        assert math.isclose(r.site_share, site, rel_tol=1e-6) and math.isclose(r.posterior, want, rel_tol=1e-5, abs_tol=1e-9)
        assert r.kept == (r.posterior >= 0.5)
