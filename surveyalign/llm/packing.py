"""Packing by concatenation and cutting.

Pass 1 tokenises and writes every document with its start inside its own partition. The totals
of the partitions, summed in order, turn those starts into offsets in one endless token stream,
and pass 2 cuts the stream into fixed windows: a document that crosses a window's end leaves a
boundary record on either side. Only the last sequence has padding.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from surveyalign.llm.common import Remembered, materialize, slices

SEQUENCE = 4096
END_ID = 2

#: Tokenised words in each of the two generations that a worker remembers.
REMEMBERED = 250_000

#: Words of letters that stay letters, one for one, under NFC and lower case.
PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-įªµº]+").fullmatch

#: The letters that byte-level tokenizers write for bytes that are not printable in Latin-1.
BYTE_LETTERS = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}

#: A letter before an ASCII mark: always the end of a pre-token.
BEFORE_MARK = re.compile(r"([A-Za-zÀ-ÖØ-öø-į])(?=[!-/:-@\[-`{-~])")


class WordTokenizer:
    """Ids of whole texts from a tokenizer file whose pre-tokens never cross a blank or line end.

    Texts are cut at blanks, line ends and between a letter and a following mark, where that
    tokenizer always cuts too; every distinct word is tokenised once, and the ids are put
    together again. A word of plain letters is a single pre-token and goes straight to the
    file's merge model in lower case; anything else passes the whole tokenizer. Texts that hold an
    added token such as <|endoftext|> are cut at blanks and line ends only, as its marks belong
    together. A file whose added tokens hold blanks, are plain words or are looked up after
    normalisation gets every text as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.model = self.inner.model
        added = self.inner.get_added_tokens_decoder().values()
        self.added = [t.content for t in added]
        self.only_whole = any(t.normalized or PLAIN(t.content) or t.content.split() != [t.content] for t in added)
        self.known = Remembered(self.word, REMEMBERED)

    def whole(self, text: str) -> bytes:
        return array("I", self.inner.encode(text, add_special_tokens=False).ids).tobytes()

    def words(self, text: str) -> list[str]:
        cut = text if any(t in text for t in self.added) else BEFORE_MARK.sub(r"\1 ", text)
        return cut.replace("\n", " ").split(" ")

    def word(self, word: str) -> bytes:
        if not word:
            return b""
        if not PLAIN(word):
            return self.whole(word)
        low = word.lower()
        if low != word:
            return self.known[low]
        piece = low if low.isascii() else low.encode().decode("latin-1").translate(BYTE_LETTERS)
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        if self.only_whole:
            return [self.whole(t) if t else b"" for t in texts]
        self.known.rest()
        get = self.known.__getitem__
        return [b"".join(map(get, self.words(t))) if t else b"" for t in texts]


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def tokenize(docs: DataFrame, tokenizer_file: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored table (id, part, part_start, n_tokens, ids): pass 1.

    ``ids`` holds little-endian unsigned 32-bit ids, the end id last. The table is written before
    it is used: a retried task then repeats neither the order of rows nor their starts.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokenizer(tokenizer_file)
        part, at = TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for rows in slices(batch, "text", 1 << 20):
                ids = [x + end for x in tokens(rows.column("text").to_pylist())]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.record_batch([rows.column("id"), pa.array(np.full(len(n), part), pa.int32()), pa.array(starts), pa.array(n),
                                       pa.array(ids, pa.binary())], ["id", "part", "part_start", "n_tokens", "ids"])

    schema = T.StructType([
        T.StructField("id", source.schema["id"].dataType), T.StructField("part", T.IntegerType()), T.StructField("part_start", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    return materialize(source.mapInArrow(run, schema), "tokens")


def global_offsets(tokens: DataFrame) -> DataFrame:
    """Adds ``at``, the start of every document in the stream, from the totals of the partitions.

    The totals are one row per partition of pass 1; their running sum is the only ordered step.
    They are written, so that Spark knows their size and leaves the tokens where they are.
    """
    totals = tokens.groupBy("part").agg(F.max(F.col("part_start") + F.col("n_tokens")).alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")).alias("base"))
    return tokens.join(materialize(before, "bases"), "part").withColumn("at", F.col("base") + F.col("part_start")).drop("base", "part", "part_start")


def cut(placed: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """Pieces (id, start, length, piece_ids, doc_tokens, sequence_id, offset): pass 2, no shuffle."""
    schema = T.StructType([
        T.StructField("id", placed.schema["id"].dataType), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("piece_ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType())])
    width = 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = batch.column("at").to_numpy(), batch.column("n_tokens").to_numpy()
            pieces = np.where(n > 0, (at + n - 1) // size - at // size + 1, 0)
            row = np.repeat(np.arange(len(n)), pieces)
            step = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = at[row] // size + step
            first, last = np.maximum(at[row], sequence * size), np.minimum(at[row] + n[row], (sequence + 1) * size)
            start = first - at[row]
            ids = batch.column("ids")
            for k in range(0, len(row), 2000):
                s = slice(k, k + 2000)
                views = [ids[int(r)].as_buffer() for r in row[s]]
                cuts = [v[width * a:width * b].to_pybytes() for v, a, b in zip(views, start[s].tolist(), (start + last - first)[s].tolist())]
                yield pa.record_batch([batch.column("id").take(pa.array(row[s])), pa.array(start[s]), pa.array((last - first)[s]), pa.array(cuts, pa.binary()),
                                       pa.array(n[row[s]]), pa.array(sequence[s]), pa.array((first - sequence * size)[s])], schema.names)

    return placed.select("id", "at", "n_tokens", "ids").mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer_file: str, size: int = SEQUENCE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents packed into sequences of ``size`` tokens; one row per piece.

    A null text counts as empty and leaves a piece with the end id alone. Rows that repeat, ids
    included, are packed as often as they occur; a null id is kept. Other columns are not
    carried. An empty table gives no pieces. The order of documents in the stream is that of
    the stored token table.
    """
    return cut(global_offsets(tokenize(docs, tokenizer_file, end_id, id_col, text_col)), size).withColumnRenamed("id", id_col)


def sequences(pieces: DataFrame, size: int = SEQUENCE, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids): whole sequences as little-endian 32-bit ids, the last one padded."""
    pad = np.full(size, pad_id, "<u4").tobytes()
    joined = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "piece_ids"))).alias("p"))
    whole = F.concat(F.aggregate("p", F.lit(b""), lambda all_ids, p: F.concat(all_ids, p["piece_ids"])), F.lit(pad))
    return joined.select("sequence_id", F.substring(whole, 1, 4 * size).alias("ids"))
