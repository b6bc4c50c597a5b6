import random
import re

import pytest

from surveyalign.llm import exchange
from surveyalign.llm import passages as P

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def covered_words(texts, size):
    """{id: set of word places that a window of an earlier id covers}."""
    first = {}
    windows = {}
    for doc_id in sorted(texts):
        words = WORD.findall(texts[doc_id] or "")
        windows[doc_id] = [tuple(words[i:i + size]) for i in range(len(words) - size + 1)]
        for w in windows[doc_id]:
            first.setdefault(w, doc_id)
    return {d: {i + k for i, w in enumerate(ws) if first[w] < d for k in range(size)} for d, ws in windows.items()}


def brute_kept(texts, size):
    gone = covered_words(texts, size)
    return {d: " ".join(w for i, w in enumerate(WORD.findall(t or "")) if i not in gone[d]) for d, t in texts.items()}


def corpus(seed):
    rng = random.Random(seed)
    passages = [" ".join(f"w{rng.randrange(40)}" for _ in range(rng.randint(5, 30))) for _ in range(6)]
    rows = {}
    for i in range(80):
        parts = [rng.choice(passages) if rng.random() < 0.4 else " ".join(f"x{rng.randrange(3000)}" for _ in range(rng.randint(1, 20))) for _ in range(rng.randint(0, 6))]
        rows[i] = rng.choice([" ", "\n", "\t  "]).join(parts)
    rows[80], rows[81], rows[82] = None, rows[3], "word " * 200
    return rows


@pytest.mark.parametrize("slab_items,cells", [(1_500_000, 64), (300, 1)])
def test_equals_brute_force(spark, monkeypatch, slab_items, cells):
    monkeypatch.setattr(P, "CELLS_PER_WINDOW", cells)
    monkeypatch.setattr(P, "slab_count", lambda n: exchange.slab_count(n, slab_items))
    texts = corpus(slab_items)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    rows = P.remove_repeated_passages(docs, 13).collect()
    want, gone = brute_kept(texts, 13), covered_words(texts, 13)
    assert {r.doc_id: r.kept_text for r in rows} == want
    assert {r.doc_id: r.n_removed for r in rows} == {d: len(g) for d, g in gone.items()}


def test_edge_documents(edge_docs, no_docs):
    found = P.remove_repeated_passages(edge_docs)
    assert found.columns == [*edge_docs.columns, "n_words_", "n_removed", "kept_text"]
    rows = found.collect()
    assert len(rows) == edge_docs.count()
    assert all(r.n_removed == 0 and r.kept_text == " ".join(WORD.findall(r.text or "")) for r in rows)
    assert P.remove_repeated_passages(no_docs).count() == 0


def test_null_ids_come_last(spark):
    text = " ".join(f"v{i}" for i in range(20))
    docs = spark.createDataFrame([(None, text, "a"), (5, text, None)], "doc_id long, text string, lang string").repartition(2)
    assert {r.doc_id: r.n_removed for r in P.remove_repeated_passages(docs).collect()} == {5: 0, None: 20}


def test_layout_of_untouched_texts_stays(spark):
    text = "  one\ttwo\n\n" + " ".join(f"v{i}" for i in range(13)) + " tail\n"
    docs = spark.createDataFrame([(1, text), (2, "other words\n" + text)], "doc_id long, text string")
    kept = {r.doc_id: r.kept_text for r in P.remove_repeated_passages(docs, keep_layout=True).collect()}
    assert kept == {1: text, 2: "other words\n  "}


def test_sorted_values_survive_packing():
    import numpy as np

    rng = np.random.default_rng(1)
    for top in (10, 1 << 20, 1 << 63):
        values = np.sort(rng.integers(0, top, 500, dtype=np.uint64))
        assert (exchange.unpack_sorted(exchange.pack_sorted(values)) == values).all()
    assert len(exchange.unpack_sorted(exchange.pack_sorted(values[:0]))) == 0


@pytest.mark.parametrize("bits", [4, 40])
def test_merged_sketch_never_falls_below_the_number_of_documents(bits):
    import numpy as np
    import pyarrow as pa

    rng = random.Random(bits)
    texts = [" ".join(f"w{rng.randrange(4)}" for _ in range(rng.randint(0, 40))) for _ in range(60)] + [None, "", "w1 w1 w1 w1 w1 w1"]
    true = {}
    for t in texts:
        words = (t or "").split()
        for w in {tuple(words[i:i + 3]) for i in range(len(words) - 2)}:
            true[w] = true.get(w, 0) + 1
    blocks = [P.Block(pa.chunked_array([pa.array(texts[i:i + 9], pa.string())]), pa.chunked_array([pa.array(range(len(texts[i:i + 9])))]), 3)
              for i in range(0, len(texts), 9)]
    sketches = [b.sketch(bits, 2) for b in blocks]
    replies = P._total_counts([P._count_question(s.cells, s.counts) for s in sketches])
    for i, (sketch, reply) in enumerate(zip(sketches, replies)):
        estimates = iter(sketch.estimates(np.frombuffer(reply, np.uint8)).tolist())
        for t in texts[9 * i:9 * i + 9]:
            words = (t or "").split()
            for k in range(len(words) - 2):
                n, estimate = true[tuple(words[k:k + 3])], next(estimates)
                assert estimate >= n and (bits == 4 or estimate == n)
        assert next(estimates, None) is None


def test_counts_stay_at_their_most():
    import numpy as np

    cells = np.array([3, 9], np.uint64)
    asked = [P._count_question(cells, np.array([1000, 1])), P._count_question(cells[1:], np.array([200])), P._count_question(cells, np.array([1, 54]))]
    assert [list(r) for r in P._total_counts(asked)] == [[255, 255], [255], [255, 255]]


def test_runs_of_slabs_share_the_space_and_skip_empty_ones():
    import numpy as np

    rng = np.random.default_rng(2)
    for bits, slabs in ((10, 7), (33, 1), (33, 5000), (64, 12345)):
        values = np.sort(rng.integers(0, 1 << bits, 300, dtype=np.uint64)) if bits < 64 else np.sort(rng.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2))
        runs = exchange.slab_runs(values, slabs, bits)
        assert [a for _, a, _ in runs] == [0, *(b for _, _, b in runs[:-1])] and runs[-1][2] == 300
        for s, a, b in runs:
            assert a < b and 0 <= s < slabs
            for v in values[a:b].tolist():
                assert abs(v * slabs / (1 << bits) - s) < 1.001
        assert len({s for s, _, _ in runs}) == len(runs)
    assert exchange.slab_runs(values[:0], 5, 64) == []
