import re
from collections import Counter
from math import log10
from zlib import crc32

import numpy as np
import pytest

from surveyalign.llm import language_model as L

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def held_out(doc_id):
    return crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def check_base(docs, rows):
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    counts = Counter(t for i, text in texts if not held_out(i) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), held_out(i), len(tokens(t)), sum(counts[x] > 0 for x in tokens(t)), n,
                   round(sum(log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens(t)), 6)) for i, t in texts)
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows)
    assert got == want


def test_base_equals_brute_force_and_model_beats_it(sample_docs):
    rows = L.score_documents(sample_docs, rounds=5).collect()
    check_base(sample_docs, rows)
    held = [r for r in rows if r.held_out]
    per_token = lambda column: sum(r[column] for r in held) / sum(r.n_tokens for r in held)
    assert all(np.isfinite(r.score) and r.score < 0 for r in rows)
    assert per_token("score") > per_token("base_score") + 0.01


def test_defaults_beat_base_on_held_out_documents_whatever_the_layout(sample_docs):
    found = {}
    for parts in (1, 4, 16):
        rows = L.score_documents(sample_docs.repartition(parts)).collect()
        found[parts] = {r.doc_id: r.score for r in rows}
        held = [r for r in rows if r.held_out]
        assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert found[1] == found[4] == found[16] and len(found[1]) == sample_docs.count()


def test_words_of_every_step_share_one_probability():
    """Units, classes, cells and the words of a cell: over all words and one unseen word a lowest cell, shares add up to one."""
    rng = np.random.default_rng(3)
    hashes = np.unique(rng.integers(1, 1 << 63, 40_000).astype(np.uint64) * np.uint64(2))
    counts = np.maximum(1, (len(hashes) / (1 + rng.permutation(len(hashes)))).astype(np.int64))
    at = L.bands(counts)
    v = L.Vocabulary(np.bincount(at), np.bincount(at, counts).astype(np.int64), 0)
    own = at >= v.n_bands
    v.own(hashes[own], counts[own])
    assert 0 < own.sum() <= len(hashes) ** 0.5 / 2 and v.n_classes < 4 * len(hashes) ** 0.5
    classes, cells = v.places(hashes, counts)
    share = 10 ** v.cell_logs(counts, v.cell_totals(hashes, counts))
    key = classes * (1 << 20) + cells
    groups, place = np.unique(key, return_inverse=True)
    total = np.bincount(place, share)
    lowest = np.bincount(place, counts == 1) > 0
    assert total[~lowest] == pytest.approx(1)
    singles = np.bincount(place, counts)[lowest]
    assert total[lowest] == pytest.approx(1 - 0.1 / (singles + 0.1 * (singles + 1)))
    w, flat = L.Model.fresh(v.noise(), v.n_units)
    for rows in [v.unit_rows, *v.class_rows, *v.cell_rows]:
        logs = L.log_probabilities(L.children(w.parts(flat), rows), np.zeros(rows.stop - rows.start, int), np.ones(rows.stop - rows.start, int), np.arange(rows.stop - rows.start))
        assert np.exp(logs).sum() == pytest.approx(1, abs=1e-5)


def test_cells_wider_than_a_slab_have_their_totals(sample_docs, monkeypatch):
    whole = {r.doc_id: r.score for r in L.score_documents(sample_docs, rounds=0).collect()}
    monkeypatch.setattr(L, "slab_count", lambda items: 64)
    assert {r.doc_id: r.score for r in L.score_documents(sample_docs, rounds=0).collect()} == pytest.approx(whole)


def test_edge_documents(edge_docs, no_docs, spark):
    rows = L.score_documents(edge_docs).collect()
    check_base(edge_docs, rows)
    assert L.score_documents(no_docs).count() == 0
    only_held_out = spark.createDataFrame([(next(i for i in range(100) if held_out(i)), "new words")], "doc_id long, text string")
    check_base(only_held_out, L.score_documents(only_held_out).collect())


def test_probabilities_are_normalised():
    rng = np.random.default_rng(1)
    model, flat = L.Model.fresh(np.full(7, 1 / 7))
    w = model.parts(flat + rng.normal(0, 0.5, len(flat)))
    for one in range(8):
        logs = L.log_probabilities(w, np.full(7, one), np.full(7, 3), np.arange(7))
        assert np.exp(logs).sum() == pytest.approx(1, abs=1e-5)


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(2)
    noise = np.array([0.1, 0.2, 0.3, 0.4])
    model, flat = L.Model.fresh(noise)
    flat = flat + rng.normal(0, 0.3, len(flat))
    one, two, target, weight = rng.integers(5, size=9), rng.integers(5, size=9), rng.integers(4, size=9), rng.random(9)
    drawn = rng.integers(4, size=6)

    def loss(f):
        w = model.parts(f)
        r = w["context"][one] * w["near"] + w["context"][two] * w["far"]
        score = lambda c: r @ w["target"][c] + w["bias"][c] - np.log(6 * noise[c])
        total = np.array([np.log1p(np.exp(-score(t)[k])) for k, t in enumerate(target)])
        for d in drawn:
            total = total + np.log1p(np.exp(score(d)))
        return (total * weight).sum() / weight.sum()

    grad = L.nce_step(model.parts(flat), one, two, target, weight, drawn, noise)
    g = np.concatenate([grad[k].ravel() for k in L.Model.NAMES])
    for i in rng.integers(len(flat), size=25):
        step = np.zeros(len(flat))
        step[i] = 1e-5
        assert (loss(flat + step) - loss(flat - step)) / 2e-5 == pytest.approx(g[i], abs=1e-5)


def test_counts_survive_packing():
    for top in (1, 200, 70_000, 1 << 40):
        counts = np.random.default_rng(top).integers(0, top, 50)
        assert (L.unpack_counts(L.pack_counts(counts), 50) == counts).all()
