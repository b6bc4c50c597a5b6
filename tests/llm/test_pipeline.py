import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from test_lines import brute as brute_lines
from test_minhash import brute_components
from test_passages import covered_words
from test_quality import brute as measures



def good(text):
    m = measures(text)
    return not (m["n_words"] < 20 or 100 * m["n_repeat_words"] > 30 * m["n_words"] or 10 * m["n_symbols"] > m["n_words"]
                or not 3 * m["n_words"] <= m["word_chars"] <= 10 * m["n_words"] or 100 * m["n_dup_lines"] > 50 * m["n_lines"]
                or 100 * m["n_letter_words"] < 60 * m["n_words"] or 2 * m["n_upper"] > m["n_letters"] or 100 * m["n_stutters"] > 30 * m["n_words"])


def strip_words(text, gone):
    spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    out, at = [], 0
    for k, (a, _) in enumerate(spans):
        stop = spans[k + 1][0] if k + 1 < len(spans) else len(text)
        if k in gone:
            out.append(text[at:a])
            at = stop
    return "".join(out) + text[at:]


def test_stages_are_the_agreed_ones():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "substring_dedup", "packing"]


def test_each_stage_equals_brute_force(spark, sample_docs):
    from surveyalign.llm.common import materialize

    docs = sample_docs.where("length(text) < 2500").limit(120)
    docs = materialize(docs.union(docs.limit(25).selectExpr("doc_id + 1000000", "concat(text, ' and a little more')", "lang", "source", "n_chars")), "few")
    columns = docs.columns
    stage = dict(corpus_pipeline.STAGES)

    def texts(df):
        assert df.columns == columns
        rows = df.collect()
        assert len({r.doc_id for r in rows}) == len(rows)
        return {r.doc_id: r.text for r in rows}

    before = texts(docs)
    docs = materialize(stage["quality"](spark, docs, ""), "q")
    want = {k: t for k, t in before.items() if good(t)}
    assert texts(docs) == want and 0 < len(want) < len(before)

    docs = materialize(stage["line_dedup"](spark, docs, ""), "l")
    cleaned = brute_lines(sorted(want.items()), 2, exact_chars=1)
    want = {k: cleaned[k][2] for k in want if cleaned[k][0] + cleaned[k][1] == 0 or cleaned[k][2].split()}
    assert texts(docs) == want

    docs = materialize(stage["near_dedup"](spark, docs, ""), "n")
    component = brute_components(want, 5, 80)
    want = {k: t for k, t in want.items() if component[k] == k}
    assert texts(docs) == want

    docs = materialize(stage["substring_dedup"](spark, docs, ""), "s")
    gone = covered_words(want, 13)
    want = {k: strip_words(t, gone[k]) for k, t in want.items() if not gone[k] or len(gone[k]) < len(t.split())}
    assert texts(docs) == want

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = {}
    for r in stage["packing"](spark, docs, "").collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert pieces.keys() == want.keys()
    for k, rows in pieces.items():
        ids = np.concatenate([np.frombuffer(r.piece_ids, "<u4") for r in sorted(rows, key=lambda r: r.start)])
        assert ids.tolist() == tokenizer.encode(want[k], add_special_tokens=False).ids + [2]


def test_stages_take_edge_documents(spark, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        for _, function in corpus_pipeline.STAGES[:-1]:
            assert function(spark, docs, "").columns == docs.columns
            function(spark, docs, "").count()
        corpus_pipeline.STAGES[-1][1](spark, docs, "").count()
