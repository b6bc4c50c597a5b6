import base64
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from surveyalign.llm import bpe, packing

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal_and_exact():
    keys = [f"key{i}".encode() for i in range(1000)]
    table = bpe.PerfectHash(keys, list(range(1000)))
    assert len(table.keys) == 1000 and set(table.keys) == set(keys)
    assert [table.get(k) for k in keys] == list(range(1000))
    assert all(table.get(f"other{i}".encode()) is None for i in range(1000))
    assert bpe.PerfectHash([], []).get(b"x") is None


def test_heap_merge_equals_library(reference):
    own = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(3)
    for _ in range(2000):
        word = "".join(rng.choice("abcdeèüß日 the'ing012!#") for _ in range(rng.randint(1, 40)))
        assert own.encode(word).tolist() == reference.encode_ordinary(word)
    long = "ab" * 3000 + "é" * 2000
    assert own.encode(long).tolist() == reference.encode_ordinary(long)


def test_memory_may_run_full(reference, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    own = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    text = "several quite different words that overflow the very small memory of this coder, again and again"
    for _ in range(3):
        assert own.encode(text).tolist() == reference.encode_ordinary(text)


def test_encode_decode_frames(edge_docs, sample_docs, no_docs, reference):
    for docs in (edge_docs, sample_docs):
        texts = {r.doc_id: r.text or "" for r in docs.collect()}
        rows = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS).collect()
        assert len(rows) == docs.count()
        for row in rows:
            assert row.ids == reference.encode_ordinary(texts[row.doc_id])
            assert bytes(row.decoded) == texts[row.doc_id].encode()
    assert bpe.encode(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0


def whole_ids(text):
    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def test_pieces_hold_every_id_once(edge_docs, sample_docs, no_docs):
    for docs in (edge_docs.dropDuplicates(["doc_id"]), sample_docs):
        texts = {r.doc_id: r.text for r in docs.collect()}
        rows = packing.pack(docs.repartition(5), WORDS).collect()
        by_doc, by_sequence = {}, {}
        for row in rows:
            by_doc.setdefault(row.doc_id, []).append(row)
            by_sequence.setdefault(row.sequence_id, []).append(row)
        assert by_doc.keys() == texts.keys()
        for doc_id, pieces in by_doc.items():
            pieces.sort(key=lambda r: r.start)
            ids = np.concatenate([np.frombuffer(r.piece_ids, "<u4") for r in pieces])
            assert ids.tolist() == whole_ids(texts[doc_id])
            assert [r.start for r in pieces] == np.cumsum([0] + [r.length for r in pieces])[:-1].tolist()
            assert all(r.doc_tokens == len(ids) for r in pieces)
        assert sorted(by_sequence) == list(range(len(by_sequence)))
        for number, pieces in by_sequence.items():
            pieces.sort(key=lambda r: r.offset)
            ends = np.cumsum([0] + [r.length for r in pieces])
            assert [r.offset for r in pieces] == ends[:-1].tolist()
            assert ends[-1] == 4096 or number == len(by_sequence) - 1
    assert packing.pack(no_docs, WORDS).count() == 0


def test_repeated_rows_are_packed_each(edge_docs):
    total = sum(len(whole_ids(r.text)) for r in edge_docs.collect())
    pieces = packing.pack(edge_docs, WORDS, size=64)
    assert pieces.groupBy().sum("length").collect()[0][0] == total
    whole = packing.sequences(pieces, 64).collect()
    assert len(whole) == -(-total // 64) and all(len(r.ids) == 256 for r in whole)


def test_piece_checksum_is_that_of_its_ids(spark, sample_docs):
    from pyspark.sql import functions as F

    row = packing.pack(sample_docs.limit(3), WORDS).withColumn("crc", F.crc32("piece_ids")).first()
    assert row.crc == zlib.crc32(row.piece_ids)


def test_added_tokens_keep_their_ids(spark):
    untouched = Tokenizer.from_file(WORDS)
    rng = random.Random(4)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endoftext", "|>", "<|", " ", "\n", "\t", "word", "It's", "é", "e\u0301", "ß", "12", "!", "日本", "İ"]
    texts = ["first text<|endoftext|>second text", *("".join(rng.choices(parts, k=rng.randint(1, 15))) for _ in range(1500))]
    assert untouched.encode(texts[0], add_special_tokens=False).ids == [874, 4160, 49407, 2241, 4160]
    rows = packing.tokenize(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), WORDS).collect()
    assert len(rows) == len(texts)
    for row in rows:
        want = untouched.encode(texts[row.id], add_special_tokens=False).ids + [2]
        assert np.frombuffer(row.ids, "<u4").tolist() == want and row.n_tokens == len(want)


@pytest.mark.parametrize("content, normalized", [("two words", False), ("plain", False), ("<x>", True)])
def test_other_added_tokens(tmp_path, content, normalized):
    from tokenizers import AddedToken

    other = Tokenizer.from_file(WORDS)
    other.add_tokens([AddedToken(content, normalized=normalized)])
    other.save(f"{tmp_path}/other.json")
    texts = ["some two words here", "plain PLAIN explain", "a<X>b <x>"]
    own = packing.WordTokenizer(f"{tmp_path}/other.json")(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in own] == [other.encode(t, add_special_tokens=False).ids for t in texts]
