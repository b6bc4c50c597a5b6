import random

import numpy as np
import pytest

from surveyalign.llm import lines as L


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def mutated(rng, text, edits, letters="abcdeß "):
    out = list(text)
    for _ in range(edits):
        k, what = rng.randrange(len(out) + 1), rng.random()
        if what < 0.33 or not out:
            out.insert(k, rng.choice(letters))
        elif what < 0.66:
            out.pop(min(k, len(out) - 1))
        else:
            out[min(k, len(out) - 1)] = rng.choice(letters)
    return "".join(out)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_distance_equals_the_full_table(edits):
    rng = random.Random(edits)
    pairs = []
    while len(pairs) < 2500:
        a = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
        b = mutated(rng, a, rng.randint(0, edits + 2), "abc")
        a, b = sorted((a, b), key=len)
        if a and len(b) - len(a) <= edits:
            pairs.append((a, b))
    width = max(len(b) for _, b in pairs)
    left, right = np.full((len(pairs), width), 0xFFFFFFFE, np.uint32), np.full((len(pairs), width), 0xFFFFFFFD, np.uint32)
    for r, (a, b) in enumerate(pairs):
        left[r, :len(a)], right[r, :len(b)] = [ord(c) for c in a], [ord(c) for c in b]
    got = L.within(left, np.array([len(a) for a, _ in pairs]), right, np.array([len(b) for _, b in pairs]), edits)
    assert got.tolist() == [edit_distance(a, b) <= edits for a, b in pairs]


def brute(rows, edits, exact_chars=L.MIN_CHARS):
    """rows: (id, text) -> {id: (n_exact, n_near, kept text)}; ids are unique."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    seen, result = [], {}
    known = set()
    for doc_id, text in order:
        kept, n_exact, n_near = [], 0, 0
        for line in (text or "").split("\n"):
            if len(line.strip()) < exact_chars:
                kept.append(line)
            elif line in known:
                n_exact += 1
            else:
                long = len(line.strip()) >= L.MIN_CHARS
                near = long and any(abs(len(line) - len(x)) <= edits and edit_distance(line, x) <= edits for x in seen)
                known.add(line)
                if long:
                    seen.append(line)
                n_near += near
                if not near:
                    kept.append(line)
        result[doc_id] = (n_exact, n_near, "\n".join(kept))
    return result


def corpus(seed, n_bases=12, n_docs=60):
    rng = random.Random(seed)
    bases = ["".join(rng.choice("abcdeß   ") for _ in range(rng.randint(28, 60))) for _ in range(n_bases)]
    rows = [(i, "\n".join(mutated(rng, rng.choice(bases), rng.choice([0, 0, 1, 2, 3, 4])) for _ in range(rng.randint(0, 5)))) for i in range(n_docs)]
    return rows + [(n_docs, None), (n_docs + 1, ""), (None, bases[0]), (n_docs + 2, "\n\n" + bases[1] + "\r\n")]


@pytest.mark.parametrize("tile", [4, 256])
def test_whole_join_equals_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(L, "TILE", tile)
    rows = corpus(tile)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r.doc_id: (r.n_exact, r.n_near, r.kept_text) for r in L.remove_repeated_lines(docs).collect()}
    assert found == brute(rows, L.EDITS)


def test_lines_sent_one_at_a_time_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(L, "SENT_BYTES", 1)
    rows = corpus(7)
    found = L.remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    assert {r.doc_id: (r.n_exact, r.n_near, r.kept_text) for r in found} == brute(rows, L.EDITS)


def test_edge_documents(edge_docs, no_docs, sample_docs):
    found = L.remove_repeated_lines(edge_docs)
    assert found.columns == [*edge_docs.columns, "n_lines", "n_exact", "n_near", "kept_text"]
    rows = found.collect()
    assert len(rows) == edge_docs.count()
    assert all(r.kept_text == "" for r in rows if r.text is None)
    assert L.remove_repeated_lines(no_docs).count() == 0
    for r in L.remove_repeated_lines(sample_docs).collect():
        assert len(r.text.split("\n")) == r.n_lines
        if r.n_exact + r.n_near == 0:
            assert r.kept_text == r.text


def test_short_lines_lose_exact_copies_only(spark):
    rows = [(i, f"All rights reserved.\n\n{i} own words\nshort a\n  \nAll rights reserved.") for i in range(3000)] + [(3000, "short b\nshort a\nshort a ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r.doc_id: (r.n_exact, r.n_near, r.kept_text) for r in L.remove_repeated_lines(docs, exact_chars=1).collect()}
    assert found[0] == (1, 0, "All rights reserved.\n\n0 own words\nshort a\n  ")
    assert all(found[i] == (3, 0, f"\n{i} own words\n  ") for i in range(1, 3000))
    assert found[3000] == (1, 0, "short b\nshort a ")


def test_registered_query_and_stage_take_short_lines(spark, tmp_path):
    import corpus_pipeline
    from surveyalign.llm.queries import QUERIES

    spark.createDataFrame([(1, "Share this\none"), (2, "Share this\ntwo")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: (r.n_exact, r.n_near) for r in QUERIES["op7_line_dedup"](spark, str(tmp_path)).collect()} == {1: (0, 0), 2: (1, 0)}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()} == {1: "Share this\none", 2: "two"}
