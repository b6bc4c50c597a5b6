"""Removal of passages that an earlier document already holds.

A count-min sketch says which word windows can occur in two documents. Every block of documents
is one partition with a sketch of its own: for every row of the sketch the sorted cells it
touches and the number of its documents behind each. Slabs of the cell space add the counts of
all blocks up and tell every block the totals of its cells; the least total over the rows is a
window's estimate, never too low, so no repeated window is missed. The width grows with the
corpus, and no task holds more than one slab of it. The second pass groups only the windows
estimated at two documents or more, by
96 bits of a 128-bit hash of their words and finds the smallest document id of each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyalign.llm.common import covered, fresh_name, materialize, mix, span_hashes, text_buffer, window_hashes, window_rows, word_spans
from surveyalign.llm.exchange import answered, in_order, pack_sorted, per_block, question_schema, slab_count, slab_runs, to_blocks, unpack_batch, unpack_sorted

WINDOW = 13

#: Cells of one sketch row per window of the corpus, and rows of the sketch.
CELLS_PER_WINDOW = 8
DEPTH = 2

#: Counts travel as bytes; this one means as many or more.
MOST = 255

LAST_ID = np.iinfo(np.int64).max


def first_of_run(values: np.ndarray) -> np.ndarray:
    """Which values differ from the one before them."""
    return np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.zeros(0, bool)


class Sketch(NamedTuple):
    """Sorted cells of all rows with their counts; per row the place of every distinct window's cell; the distinct window of every window."""

    cells: np.ndarray
    counts: np.ndarray
    places: list[np.ndarray]
    window: np.ndarray

    def estimates(self, totals: np.ndarray) -> np.ndarray:
        """At most how many documents hold each window, by the totals of the cells."""
        return np.minimum.reduce([totals[p] for p in self.places])[self.window]


class Block:
    """Words and windows of one block."""

    def __init__(self, text: pa.ChunkedArray, ids: pa.ChunkedArray, size: int):
        self.size = size
        self.data, self.rows = text_buffer(text)
        self.ids = ids.combine_chunks().cast(pa.int64()).fill_null(LAST_ID).to_numpy()
        self.starts, self.ends, self.first = word_spans(self.data, self.rows)
        self.at, self.row = window_rows(self.first, size)
        self.hashes = window_hashes(span_hashes(self.data, self.starts, self.ends), size)[self.at]

    def sketch(self, bits: int, depth: int) -> Sketch:
        """Count-min sketch of the windows; a document counts once for each of its distinct windows."""
        order = np.argsort(self.hashes, kind="stable")  # windows come row after row
        h, r = self.hashes[order], self.row[order]
        new = first_of_run(h)
        first = np.flatnonzero(new)
        documents = np.add.reduceat((new | first_of_run(r)).astype(np.int64), first) if len(h) else np.zeros(0, np.int64)
        window = np.empty(len(h), np.int64)
        window[order] = np.cumsum(new) - 1
        cells, counts, places, size = [], [], [], 0
        for d in range(depth):
            own = (mix(h[first] + np.uint64(d)) if d else h[first]) >> np.uint64(64 - bits)
            by_cell = np.argsort(own, kind="stable")
            new = first_of_run(own[by_cell])
            place = np.empty(len(own), np.int64)
            place[by_cell] = np.cumsum(new) - 1 + size
            cells.append(own[by_cell][new] + np.uint64(d << bits))
            counts.append(np.add.reduceat(documents[by_cell], np.flatnonzero(new)) if len(own) else documents)
            places.append(place)
            size += len(cells[-1])
        return Sketch(np.concatenate(cells), np.concatenate(counts), places, window)

    def keys(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64 + 32 bits of the hash of the words of each chosen window, joined by one space."""
        high, low = np.empty(len(chosen), np.uint64), np.empty(len(chosen), np.uint32)
        row = self.row[chosen]
        lengths = self.ends - self.starts
        digest = xxhash.xxh3_128_digest
        edges = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, int)
        for a, b in zip(edges, np.append(edges[1:], len(row))):
            r = row[a]
            words = self.data[self.rows[r]:self.rows[r + 1]].tobytes().split()
            joined = b" ".join(words)
            base = self.first[r]
            end = np.cumsum(lengths[base:self.first[r + 1]] + 1) - 1
            w = self.at[chosen[a:b]] - base
            begin = end[w] - lengths[base + w]
            raw = b"".join([digest(joined[s:e]) for s, e in zip(begin.tolist(), end[w + self.size - 1].tolist())])
            both = np.frombuffer(raw, ">u8").reshape(-1, 2)
            high[a:b], low[a:b] = both[:, 0], both[:, 1] >> np.uint64(32)
        return high, low


def _count_question(cells: np.ndarray, counts: np.ndarray) -> bytes:
    return b"".join([np.array([len(cells)], "<i8").tobytes(), np.minimum(counts, MOST).astype(np.uint8).tobytes(), pack_sorted(cells)])


def _total_counts(asked: list[bytes]) -> list[bytes]:
    """The count of every asked cell over all blocks, one byte each."""
    sizes = [int(np.frombuffer(a, "<i8", 1)[0]) for a in asked]
    cells = np.concatenate([unpack_sorted(a[8 + n:]) for a, n in zip(asked, sizes)])
    counts = np.concatenate([np.frombuffer(a, np.uint8, n, 8) for a, n in zip(asked, sizes)])
    order = np.argsort(cells, kind="stable")
    new = first_of_run(cells[order])
    total = np.minimum(np.add.reduceat(counts[order].astype(np.int64), np.flatnonzero(new)), MOST).astype(np.uint8)
    replies = np.empty(len(cells), np.uint8)
    replies[order] = total[np.cumsum(new) - 1]
    return [replies[e - n:e].tobytes() for n, e in zip(sizes, np.cumsum(sizes))]


def _earlier_elsewhere(asked: list[bytes]) -> list[bytes]:
    """One bit per asked window: some other block holds it in a document with a smaller id."""
    highs, lows, firsts = [], [], []
    for a in asked:
        n, used = np.frombuffer(a, "<i8", 2)
        highs.append(unpack_sorted(a[16:16 + used]))
        lows.append(np.frombuffer(a, "<u4", n, 16 + used))
        firsts.append(np.frombuffer(a, "<i8", n, 16 + used + 4 * n))
    sizes = [len(h) for h in highs]
    high, low, first = np.concatenate(highs), np.concatenate(lows), np.concatenate(firsts)
    order = np.lexsort((first, low, high))
    h, l = high[order], low[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (l[1:] != l[:-1])])
    least = np.empty(len(order), np.int64)
    least[order] = first[order][np.flatnonzero(new)[np.cumsum(new) - 1]]
    flags = least < first
    return [np.packbits(flags[e - n:e]).tobytes() for n, e in zip(sizes, np.cumsum(sizes))]


def _window_question(high: np.ndarray, low: np.ndarray, first: np.ndarray) -> bytes:
    packed = pack_sorted(high)
    return b"".join([np.array([len(high), len(packed)], "<i8").tobytes(), packed, low.astype("<u4").tobytes(), first.astype("<i8").tobytes()])


def _bits(reply: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(reply, np.uint8), count=n).astype(bool)


class Plan:
    """What every pass must agree on."""

    def __init__(self, text_at: int, id_at: int, size: int, windows: int):
        self.text_at, self.id_at, self.size = text_at, id_at, size
        self.bits = min(max((windows * CELLS_PER_WINDOW).bit_length(), 10), 60)
        self.depth = DEPTH
        self.slabs = slab_count(windows * DEPTH)

    def block(self, payload: bytes) -> Block:
        table = unpack_batch(payload)
        return Block(table.column(self.text_at), table.column(self.id_at), self.size)

    def cell_runs(self, cells: np.ndarray) -> list[tuple[int, int, int]]:
        return slab_runs(cells, self.slabs, self.bits + (self.depth - 1).bit_length())

    def maybe_repeated(self, block: Block, answers: dict[int, bytes]) -> np.ndarray:
        """Windows that two documents or more may hold."""
        sketch = block.sketch(self.bits, self.depth)
        totals = np.zeros(len(sketch.cells), np.uint8)
        for s, a, b in self.cell_runs(sketch.cells):
            totals[a:b] = np.frombuffer(answers[s], np.uint8)
        return np.flatnonzero(sketch.estimates(totals) > 1)

    def window_questions(self, block: Block, chosen: np.ndarray):
        """Distinct chosen windows in key order with their first document here; which window has which key."""
        high, low = block.keys(chosen)
        ids = block.ids[block.row[chosen]]
        order = np.lexsort((ids, low, high))
        h, l = high[order], low[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (l[1:] != l[:-1])]) if len(h) else np.zeros(0, bool)
        key_of = np.empty(len(order), np.int64)
        key_of[order] = np.cumsum(new) - 1
        return h[new], l[new], ids[order][new], key_of, slab_runs(h[new], self.slabs, 64)


def remove_repeated_passages(docs: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                             keep_layout: bool = False) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept_text`` added (names extended by _ where taken).

    A word goes if a window of ``size`` words over it also starts in a document with a smaller
    id; all windows are judged on the input. ``kept_text`` joins the kept words by one space, or
    with ``keep_layout`` is the text without the removed words and the blanks after them, so an
    untouched text stays as it is. A null text has no words and gives an empty ``kept_text``.
    Rows with equal ids do not count as earlier for each other; a null id is later than all.
    Ids must be integers. An empty table gives an empty result.
    """
    names = docs.columns
    text_at, id_at = names.index(text_col), names.index(id_col)

    def windows(part: pa.RecordBatch) -> int:
        data, rows = text_buffer(part.column(text_at))
        return int(np.maximum(np.diff(word_spans(data, rows)[2]) - size + 1, 0).sum())

    blocks = to_blocks(docs, text_at, windows)
    plan = Plan(text_at, id_at, size, blocks.agg(F.sum("items")).first()[0] or 0)
    first_answers = materialize(answered(blocks.select("block", "payload").mapInArrow(_ask_cells(plan), question_schema()), _total_counts), "cells")
    told = blocks.select("block", "payload").join(first_answers.withColumnRenamed("answers", "cells"), "block", "left")
    second_answers = answered(told.mapInArrow(_ask_windows(plan), question_schema()), _earlier_elsewhere)
    told = told.join(second_answers.withColumnRenamed("answers", "windows"), "block", "left")
    inner = [f"c{i}" for i in range(len(names))]
    schema = T.StructType([*docs.toDF(*inner).schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("kept_text", T.StringType())])
    result = told.select("block", "payload", "cells", "windows").mapInArrow(_remove(plan, inner, keep_layout), schema)
    return result.toDF(*names, *(fresh_name(docs, n) for n in ("n_words", "n_removed", "kept_text")))


def _question_rows(block: int, parts: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([s for s, _ in parts], pa.int32()), pa.array([block] * len(parts), pa.int64()),
                            pa.array([a for _, a in parts], pa.binary())], ["slab", "block", "asked"])


def _ask_cells(plan: Plan):
    def work(number, payload) -> Iterator[pa.RecordBatch]:
        cells, counts, _, _ = plan.block(payload.as_buffer()).sketch(plan.bits, plan.depth)
        yield _question_rows(number.as_py(), [(s, _count_question(cells[a:b], counts[a:b])) for s, a, b in plan.cell_runs(cells)])
    return per_block(work)


def _ask_windows(plan: Plan):
    def work(number, payload, answers) -> Iterator[pa.RecordBatch]:
        block = plan.block(payload.as_buffer())
        chosen = plan.maybe_repeated(block, in_order(answers.as_py()))
        high, low, first, _, runs = plan.window_questions(block, chosen)
        yield _question_rows(number.as_py(), [(s, _window_question(high[a:b], low[a:b], first[a:b])) for s, a, b in runs])
    return per_block(work)


def _remove(plan: Plan, inner: list[str], keep_layout: bool):
    def work(_, payload, cells, windows) -> Iterator[pa.RecordBatch]:
        table = unpack_batch(payload.as_buffer())
        block = plan.block(payload.as_buffer())
        chosen = plan.maybe_repeated(block, in_order(cells.as_py()))
        high, _, first, key_of, runs = plan.window_questions(block, chosen)
        answers = in_order(windows.as_py())
        elsewhere = np.zeros(len(high), bool)
        for s, a, b in runs:
            elsewhere[a:b] = _bits(answers[s], b - a)
        goes = elsewhere[key_of] | (first[key_of] < block.ids[block.row[chosen]]) if len(chosen) else np.zeros(0, bool)
        gone = covered(block.at[chosen[goes]], plan.size, len(block.starts))
        total = np.concatenate([[0], np.cumsum(gone)])
        n_removed = total[block.first[1:]] - total[block.first[:-1]]
        kept = [_layout(block, r, gone) if keep_layout else _joined(block, r, gone, n) for r, n in enumerate(n_removed.tolist())]
        out = table.combine_chunks().to_batches()[0]
        yield pa.record_batch([*out.columns, pa.array(np.diff(block.first)), pa.array(n_removed.astype(np.int64)), pa.array(kept, pa.string())],
                              [*inner, "n_words", "n_removed", "kept_text"])
    return per_block(work)


def _joined(block: Block, r: int, gone: np.ndarray, n_removed: int) -> str:
    words = block.data[block.rows[r]:block.rows[r + 1]].tobytes().split()
    if n_removed:
        words = compress(words, ~gone[block.first[r]:block.first[r + 1]])
    return b" ".join(words).decode()


def _layout(block: Block, r: int, gone: np.ndarray) -> str:
    a, b = block.first[r], block.first[r + 1]
    low, high = block.rows[r], block.rows[r + 1]
    if not gone[a:b].any():
        return block.data[low:high].tobytes().decode()
    edges = np.append(block.starts[a:b], high)
    lost = np.flatnonzero(gone[a:b])
    keep = np.zeros(high - low + 1, np.int64)
    np.add.at(keep, edges[lost] - low, 1)
    np.subtract.at(keep, edges[lost + 1] - low, 1)
    return block.data[low:high][np.cumsum(keep[:-1]) == 0].tobytes().decode()
