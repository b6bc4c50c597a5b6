import re
from collections import Counter

from surveyalign.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    counts = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(8)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit), "n_lines": len(lines),
        "n_letter_words": sum(bool(re.search(r"[A-Za-z\x80-\U0010FFFF]", w)) for w in words),
        "n_upper": sum("A" <= c <= "Z" for c in text), "n_letters": sum(c.isascii() and c.isalpha() for c in text),
        "n_stutters": sum(a == b for a, b in zip(words, words[1:]))}


def test_measures_equal_brute_force(edge_docs, sample_docs):
    for docs in (edge_docs, sample_docs):
        texts = {r.doc_id: r.text for r in docs.collect()}
        rows = Q.ledger(docs).collect()
        assert len(rows) == docs.count()
        for row in rows:
            want = brute(texts[row.doc_id])
            assert {k: row[k] for k in want} == want


def test_bits_follow_rules_and_policies(spark):
    clean = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(1, clean), (2, "too short"), (3, clean.replace(" ", "### ")), (4, clean.upper()), (5, None)], "doc_id int, text string")
    rows = {r.doc_id: r for r in Q.apply_policy(Q.ledger(docs)).collect()}
    assert rows[1].fail_bits == 0 and rows[1].kept and not rows[1].base_failed
    assert rows[2].base_failed and not rows[2].kept
    assert not rows[3].base_failed and rows[3].fail_bits & Q.mask(["symbols"]) and not rows[3].kept
    assert rows[4].fail_bits == Q.mask(["upper_case"])
    assert rows[5].base_failed
    assert {r.doc_id for r in Q.apply_policy(Q.ledger(docs), "base").where("kept").collect()} == {1, 3, 4}
    assert {r.doc_id for r in Q.keep_good(docs).collect()} == {1}


def test_keep_good_keeps_columns(edge_docs, no_docs):
    assert Q.keep_good(edge_docs).columns == edge_docs.columns
    assert Q.keep_good(no_docs).count() == 0 and Q.ledger(no_docs).count() == 0


def test_ablations_count_sole_rejections(sample_docs):
    entries = Q.ledger(sample_docs)
    bits = [r.fail_bits for r in entries.collect()]
    for row in Q.ablations(entries).collect():
        whole, rule = Q.mask(Q.POLICIES[row.policy]), Q.mask([row.rule])
        assert row.n_failed == sum(bool(b & rule) for b in bits)
        assert row.n_only == sum((b & whole) == rule for b in bits)
        assert row.n_rejected == sum(bool(b & whole) for b in bits)
