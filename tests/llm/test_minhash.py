import random
import re

import pytest

from surveyalign.llm import minhash as M
from surveyalign.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def brute_components(texts, size, percent):
    sets = {d: shingles(t, size) for d, t in texts.items()}
    ids = sorted(d for d in sets if sets[d])
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:]
             if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return components(list(texts), links)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    shared = [word() for _ in range(12)]
    texts = {}
    for _ in range(12):
        base = [word() for _ in range(rng.randint(4, 400))]
        for _ in range(rng.randint(1, 9)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, len(base) // 60, len(base) // 25])):
                own[rng.randrange(len(own))] = word()
            texts[len(texts)] = " ".join(own)
    for _ in range(40):
        texts[len(texts)] = " ".join(shared + [word() for _ in range(rng.randint(0, 40))])
    for _ in range(30):
        own = list(shared)
        own[rng.randrange(12)] = word()
        texts[len(texts)] = " ".join(own)
    return texts | {len(texts): None, len(texts) + 1: "", len(texts) + 2: "A b", len(texts) + 3: "a B", len(texts) + 4: "A b c"}


@pytest.mark.parametrize("size,percent,tile", [(3, 85, 512), (3, 85, 8), (5, 80, 8)])
def test_components_equal_brute_force(spark, monkeypatch, size, percent, tile):
    monkeypatch.setattr(M, "TILE", tile)
    monkeypatch.setattr(M, "COLUMNS", 64)
    texts = corpus(tile + size)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    rows = M.near_duplicates(docs, size, percent).collect()
    assert {r.doc_id: r.component_id for r in rows} == brute_components(texts, size, percent)
    assert {r.doc_id: r.n_shingles for r in rows} == {d: len(shingles(t, size)) for d, t in texts.items()}
    assert all(r.kept == (r.component_id == r.doc_id) for r in rows)


def test_edge_documents(edge_docs, no_docs):
    rows = M.near_duplicates(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    assert all(r.component_id == r.doc_id for r in rows if r.n_shingles == 0)
    assert M.near_duplicates(no_docs).count() == 0
    kept = M.keep_first(edge_docs)
    assert kept.columns == edge_docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.kept}


def test_null_ids_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (7, "q r s t u"), (None, "only here"), (3, None)], "doc_id long, text string")
    rows = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in M.near_duplicates(docs, 3, 85).collect())
    assert rows == [("3", "3", True), ("7", "7", True), ("7", "7", True), ("None", "7", False), ("None", "None", True)]


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(50)] + [(300, 300)] + [(rng.randrange(400, 450), rng.randrange(400, 450)) for _ in range(30)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(links + links[:5], "x long, y long")).collect()}
    nodes = {x for link in links for x in link}
    want = {n: r for n, r in components(nodes, links).items() if n != r}
    assert found == want


def test_null_ids_keep_their_links(spark):
    from surveyalign.llm.minhash import near_duplicates

    text = " ".join(f"w{i}" for i in range(200))
    rows = [(None, text), (5, text + " more"), (None, "alone here is a text of some words"), (9, "another text that is not like the rest"), (None, text + " other end")]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in found)
    assert got == [("5", 197, "5", True), ("9", 4, "9", True), ("None", 4, "None", True), ("None", 196, "5", False), ("None", 198, "5", False)]
