import re
import zlib
from collections import Counter

import numpy as np
import pytest

from surveyalign.llm import spelling as S


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_words(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(counts):
    near = {w: [v for v in counts if abs(len(v) - len(w)) <= 1 and one_edit(w, v)] for w in counts}
    form = {w: min(near[w], key=lambda v: (-counts[v], v), default=None) for w in counts}
    form = {w: f if f is not None and counts[f] >= 2 * counts[w] else None for w, f in form.items()}
    out = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None)
    return out


def rows(found):
    rows = found.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def words_of(spark, counts):
    return S.vocabulary(spark.createDataFrame([(w,) for w, n in counts.items() for _ in range(n)], "word string"), 1, 1)


def test_documents_equal_brute_force(spark, sample_docs, edge_docs):
    docs = sample_docs.where("doc_id < 60").select("doc_id", "text").union(edge_docs.select("doc_id", "text")).union(
        spark.createDataFrame([(None, "Straße straße STRASSE Strasse ×÷×÷À abcde abcde abcde")] * 4 + [(7, None)], "doc_id long, text string"))
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    source = docs.selectExpr("doc_id", "text", "1 AS n", "'x' AS word", "2 AS w").repartition(5)
    counts = brute_words(pairs)
    assert rows(S.spelling_forms(S.vocabulary(S.with_slips(source)))) == brute(counts) and len(counts) > 200


def test_slips_equal_brute_force_for_every_run(spark):
    docs = [(i, " ".join(f"w{chr(97 + i % 26)}rd{chr(97 + k % 26)}{'é' * (k % 3)}" for k in range(40))) for i in range(200)]
    found = Counter(r.word for r in S.with_slips(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    wanted = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text):
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            wanted[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    assert found == wanted


@pytest.mark.parametrize("hot", [1000, 3])
def test_random_words_equal_brute_force(spark, monkeypatch, hot):
    from surveyalign.llm import common

    monkeypatch.setattr(common, "HOT_KEYS", hot)
    monkeypatch.setattr(S, "STRIP_BYTES", 64)
    rng = np.random.default_rng(hot)
    counts = {"".join(rng.choice(list("abé🙂"), rng.integers(1, 7))): int(rng.integers(1, 40)) for _ in range(400)}
    assert rows(S.spelling_forms(words_of(spark, counts))) == brute(counts)


def test_chains_repeats_ties_and_long_words(spark):
    counts = {"a" * 4000: 1, "a" * 3999: 2, "a" * 3998 + "b": 2, "chain": 1, "chains": 2, "chasins": 4, "chaseins": 8, "hello": 2, "helo": 4, "hell": 4, "heello": 1, "x": 1}
    found = rows(S.spelling_forms(words_of(spark, counts)))
    assert found == brute(counts)
    assert found["chain"][1] == "chaseins" and found["hello"][0] == "hell" and found["a" * 4000][0] == "a" * 3999


def test_empty_tables(spark, no_docs):
    assert S.spelling_forms(S.vocabulary(S.with_slips(no_docs))).collect() == []
    with pytest.raises(ValueError):
        S.spelling_forms(S.vocabulary(S.with_slips(no_docs)), ratio=1)


def test_node_identities_are_those_of_the_trie():
    words = ["abc", "abd", "b", "", "xabc"]
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    lengths = np.array([len(w) for w in words])
    first = np.cumsum(lengths) - lengths
    for step, part in ((1, lambda w, i: w[:i]), (-1, lambda w, i: w[len(w) - i:])):
        nodes = S._chains(codes, first, lengths, step).T.tolist()
        names = [part(w, i) for w in words for i in range(len(w) + 1)]
        assert len({(n, tuple(x)) for n, x in zip(names, nodes)}) == len(set(names)) == len({tuple(x) for x in nodes})
