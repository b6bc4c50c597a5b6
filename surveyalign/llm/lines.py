"""Line de-duplication by a segment-partition edit join.

Two lines within ``edits`` edits: the shorter one, cut into ``edits + 1`` segments, has a segment
that the longer one holds unchanged near the same place. Exact copies are found first, so only
first occurrences go on. Each of them has a few length-aware keys; blocks ask the slabs of the
key space which keys another line has too, and only lines with such keys are grouped by key and
verified with a banded bit-parallel edit distance over many pairs at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyalign.llm.common import distinct, fresh_name, materialize, mix, text_buffer
from surveyalign.llm.exchange import answered, in_order, pack_sorted, per_block, question_schema, slab_count, slab_runs, to_blocks, unpack_batch, unpack_sorted
from surveyalign.llm.passages import LAST_ID, _bits, _earlier_elsewhere, _question_rows, _window_question

EDITS = 2

#: Lines with fewer code points, outer blanks not counted, have no near copies.
MIN_CHARS = 30

#: Slots of the key space per key; more only means fewer false alarms.
CELLS_PER_KEY = 64

TILE = 256

#: Pairs that one call of the edit distance takes, bytes of lines hashed at a time, and rows and
#: bytes of lines sent at a time.
PAIRS = 10_000
KEY_BYTES = 1 << 19
SENT_ROWS = 5000
SENT_BYTES = 32 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def segments(length: np.ndarray, edits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Start and size of the ``edits + 1`` even segments of lines of the given lengths; longer ones last."""
    k = edits + 1
    small, longer = length // k, length % k
    starts, sizes, at = [], [], np.zeros_like(length)
    for i in range(k):
        size = small + (i >= k - longer)
        starts.append(at)
        sizes.append(size)
        at = at + size
    return starts, sizes


def probe_shifts(edits: int) -> list[tuple[int, int, int]]:
    """(length difference, segment, shift of its start) of every probe that can be needed."""
    out = []
    for d in range(edits + 1):
        for i in range(edits + 1):
            for shift in range(max(-i, d - (edits - i)), min(i, d + (edits - i)) + 1):
                out.append((d, i, shift))
    return out


def within(left: np.ndarray, left_len: np.ndarray, right: np.ndarray, right_len: np.ndarray, edits: int) -> np.ndarray:
    """Which pairs of padded code-point rows are within ``edits`` edits; ``left`` is never the longer.

    The band of 2 * edits + 1 diagonals is one word per pair. Column by column its bits tell where
    the distance rises and falls down the column, and the score follows the lowest diagonal that
    can still reach the end.
    """
    n, width = len(left), 2 * edits + 1
    full = np.uint64((1 << width) - 1)
    one, top = np.uint64(1), np.uint64(1 << (width - 1))
    m = int(right_len.max(initial=0))
    padded = np.full((n, m + 2 * width), 0xFFFFFFFF, np.uint32)
    padded[:, edits:edits + left.shape[1]] = left[:, :m + width]
    # Row -edits .. -1 of the band stand above the first row: the distance falls towards it.
    vp, vn = np.full(n, (int(full) >> edits) << edits, np.uint64), np.full(n, (1 << edits) - 1, np.uint64)
    rows, last = left_len.astype(np.int64), right_len.astype(np.int64)
    score = np.minimum(rows, edits)
    for j in range(m):
        live = j < last
        match = np.zeros(n, np.uint64)
        for b in range(width):
            # Bit b is row j + 1 - edits + b of the band in column j + 1.
            match |= (padded[:, j + b] == right[:, j]).astype(np.uint64) << np.uint64(b)
        d0 = (((match & vp) + vp) ^ vp) | match | vn
        hp = vn | (~(d0 | vp) & full)
        hn = d0 & vp
        shifted = (d0 & full) >> one
        vp2 = hn | (~(shifted | hp) & full)
        vn2 = shifted & hp
        # Down the lowest diagonal while it lies inside the line, then along its last row upwards.
        inside = j + 1 + edits <= rows
        at = np.clip(rows - (j + 1) + edits, 0, width - 1).astype(np.uint64)
        diagonal = np.where((d0 & top) != 0, 0, 1)
        along = ((hp >> at) & one).astype(np.int64) - ((hn >> at) & one).astype(np.int64)
        score += np.where(live, np.where(inside, diagonal, along), 0)
        vp, vn = np.where(live, vp2, vp), np.where(live, vn2, vn)
    return score <= edits


class Lines:
    """Lines of one block, in code points."""

    def __init__(self, text: pa.ChunkedArray, ids: pa.ChunkedArray, edits: int, exact_chars: int):
        self.edits = edits
        data, rows = text_buffer(text)
        whole = data.tobytes()
        self.ids = ids.combine_chunks().cast(pa.int64()).fill_null(LAST_ID).to_numpy()
        self.pieces = [whole[a:b].split(b"\n") for a, b in zip(rows[:-1].tolist(), rows[1:].tolist())]
        self.row = np.repeat(np.arange(len(self.pieces)), [len(p) for p in self.pieces])
        self.number = np.concatenate([np.arange(len(p)) for p in self.pieces]) if self.pieces else np.zeros(0, np.int64)
        self.raw = [line for p in self.pieces for line in p]
        # Bytes settle most: a line of so many code points has as many bytes at least.
        chars = np.array([len(x.decode().strip()) if len(x) >= exact_chars else 0 for x in self.raw], np.int64)
        self.eligible, self.long = np.flatnonzero(chars >= exact_chars), chars >= MIN_CHARS
        digests = b"".join([xxhash.xxh3_128_digest(self.raw[i]) for i in self.eligible])
        both = np.frombuffer(digests, ">u8").reshape(-1, 2)
        high, low = both[:, 0].astype(np.uint64), (both[:, 1] >> np.uint64(32)).astype(np.uint32)
        # Distinct lines in key order with their first occurrence here, and the line of each key.
        order = np.lexsort((self.number[self.eligible], self.ids[self.row[self.eligible]], low, high))
        h, l = high[order], low[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (l[1:] != l[:-1])]) if len(h) else np.zeros(0, bool)
        self.high, self.low, self.first = h[new], l[new], self.eligible[order[new]]
        self.repeats = self.eligible[order[~new]]

    def question(self, slabs: int):
        return self.high, self.low, self.ids[self.row[self.first]], slab_runs(self.high, slabs, 64)

    def keys(self, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, index into ``lines``, is an index key) of every probe and segment of the lines; some lines at a time."""
        ends = np.cumsum([len(self.raw[i]) for i in lines])
        parts, at = [], 0
        while at < len(lines):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + KEY_BYTES)))
            keys, owner, index = self._keys(lines[at:stop])
            parts.append((keys, owner + at, index))
            at = stop
        return tuple(np.concatenate(p) for p in zip(*parts)) if parts else self._keys(lines)

    def _keys(self, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        texts = [np.frombuffer(self.raw[i].decode().encode("utf-32-le"), "<u4") for i in lines]
        length = np.array([len(t) for t in texts], np.int64)
        flat = np.concatenate(texts) if texts else np.zeros(0, np.uint32)
        base = np.cumsum(length) - length
        power = np.full(len(flat) + 1, _BASE, np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        total = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum(mix(flat.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
        inverse = np.full(len(flat) + 1, _INVERSE, np.uint64)
        inverse[0] = 1
        np.multiply.accumulate(inverse, out=inverse)
        keys, owner, index = [], [], []
        for d, i, shift in probe_shifts(self.edits):
            target = length - d
            starts, sizes = segments(target, self.edits)
            begin, size = starts[i] + shift, sizes[i]
            ok = np.flatnonzero((begin >= 0) & (begin + size <= length) & (size > 0))
            a, b = base[ok] + begin[ok], base[ok] + begin[ok] + size[ok]
            body = (total[b] - total[a]) * inverse[a]
            keys.append(mix(body + mix(target[ok].astype(np.uint64) * np.uint64(64) + np.uint64(i))))
            owner.append(ok)
            index.append(np.full(len(ok), d == 0 and shift == 0))
        return np.concatenate(keys), np.concatenate(owner), np.concatenate(index)


class Plan:
    def __init__(self, text_at: int, id_at: int, edits: int, exact_chars: int, n_lines: int):
        self.text_at, self.id_at, self.edits, self.exact_chars = text_at, id_at, edits, exact_chars
        self.line_slabs = slab_count(n_lines)
        n_keys = n_lines * len(probe_shifts(edits))
        self.key_slabs = slab_count(n_keys)
        self.bits = min(max((n_keys * CELLS_PER_KEY).bit_length(), 10), 60)

    def lines(self, payload) -> Lines:
        table = unpack_batch(payload)
        return Lines(table.column(self.text_at), table.column(self.id_at), self.edits, self.exact_chars)

    def firsts(self, block: Lines, answers: dict[int, bytes]) -> np.ndarray:
        """Lines of the block without an exact copy before them."""
        high, _, _, runs = block.question(self.line_slabs)
        later = np.zeros(len(high), bool)
        for s, a, b in runs:
            later[a:b] = _bits(answers[s], b - a)
        return np.sort(block.first[~later])

    def compared(self, block: Lines, answers: dict[int, bytes]) -> np.ndarray:
        """The first occurrences that are long enough for near copies."""
        lines = self.firsts(block, answers)
        return lines[block.long[lines]]

    def cells(self, keys: np.ndarray) -> np.ndarray:
        return keys >> np.uint64(64 - self.bits)

    def cell_question(self, cells: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        values = distinct(cells)
        return values, slab_runs(values, self.key_slabs, self.bits)


def _seen_twice(asked: list[bytes]) -> list[bytes]:
    """One bit per asked cell: another block asks for it too."""
    cells = [unpack_sorted(a) for a in asked]
    values = np.sort(np.concatenate(cells))
    hot = distinct(values[1:][values[1:] == values[:-1]])
    return [np.packbits(_member(hot, c)).tobytes() for c in cells]


def _member(sorted_values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    if len(sorted_values) == 0:
        return np.zeros(len(asked), bool)
    spot = np.minimum(np.searchsorted(sorted_values, asked), len(sorted_values) - 1)
    return sorted_values[spot] == asked


def _ask_lines(plan: Plan):
    def work(number, payload) -> Iterator[pa.RecordBatch]:
        high, low, ids, runs = plan.lines(payload.as_buffer()).question(plan.line_slabs)
        yield _question_rows(number.as_py(), [(s, _window_question(high[a:b], low[a:b], ids[a:b])) for s, a, b in runs])
    return per_block(work)


def _ask_keys(plan: Plan):
    def work(number, payload, copies) -> Iterator[pa.RecordBatch]:
        block = plan.lines(payload.as_buffer())
        keys, _, _ = block.keys(plan.compared(block, in_order(copies.as_py())))
        cells, runs = plan.cell_question(plan.cells(keys))
        yield _question_rows(number.as_py(), [(s, pack_sorted(cells[a:b])) for s, a, b in runs])
    return per_block(work)


def _shared_lines(plan: Plan):
    """(key, is_index, block, place, doc, line): the lines behind keys that more than one line has."""
    def work(number, payload, copies, asked) -> Iterator[pa.RecordBatch]:
        block = plan.lines(payload.as_buffer())
        lines = plan.compared(block, in_order(copies.as_py()))
        keys, owner, index = block.keys(lines)
        own = plan.cells(keys)
        cells, runs = plan.cell_question(own)
        hot = np.zeros(len(cells), bool)
        answers = in_order(asked.as_py())
        for s, a, b in runs:
            hot[a:b] = _bits(answers[s], b - a)
        # Two lines of this block may share a key that no other block has.
        order = np.lexsort((owner, own))
        cell, line = own[order], owner[order]
        several = distinct(cell[1:][(cell[1:] == cell[:-1]) & (line[1:] != line[:-1])])
        chosen = np.flatnonzero(_member(cells[hot], own) | _member(several, own))
        line = lines[owner[chosen]]
        ends, k = np.cumsum([len(block.raw[i]) for i in line]), 0
        while k < len(chosen):
            stop = int(np.searchsorted(ends, (ends[k - 1] if k else 0) + SENT_BYTES, side="right"))
            stop = max(k + 1, min(stop, k + SENT_ROWS))
            c, part, k = chosen[k:stop], line[k:stop], stop
            yield pa.record_batch([
                pa.array(keys[c].view(np.int64)), pa.array(index[c]), pa.array(np.full(len(c), number.as_py())), pa.array(part),
                pa.array(block.ids[block.row[part]]), pa.array([block.raw[i].decode() for i in part], pa.string())],
                ["key", "is_index", "block", "place", "doc", "line"])
    return per_block(work)


class TileRows:
    """Rows of whole tiles, tile after tile, each line once per tile and in the order of first occurrence."""

    def __init__(self, table: pa.Table):
        get = lambda name: table.column(name).to_numpy()
        key, i, j = get("key"), get("i"), get("j")
        tile = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
        index = table.column("is_index").to_numpy().astype(bool)
        block, place, doc = get("block"), get("place"), get("doc")
        order = np.lexsort((~index, place, block, tile))
        same = (tile[order][1:] == tile[order][:-1]) & (block[order][1:] == block[order][:-1]) & (place[order][1:] == place[order][:-1])
        order = order[np.concatenate([[True], ~same])]
        order = order[np.lexsort((place[order], block[order], doc[order], tile[order]))]
        self.tile, self.index, self.block, self.place = tile[order], index[order], block[order], place[order]
        self.chunk, self.mixed = get("c")[order], (i != j)[order]
        texts = [np.frombuffer(t.encode("utf-32-le"), "<u4") for t in table.column("line").take(pa.array(order)).to_pylist()]
        self.length = np.array([len(t) for t in texts], np.int64)
        self.base = np.cumsum(self.length) - self.length
        self.codes = np.concatenate(texts)
        counts = np.bincount(self.tile)
        self.count, self.first = counts[self.tile], (np.cumsum(counts) - counts)[self.tile]

    def pairs(self, edits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row that holds the key as its own segment, row that probes it) of lines that may be close, some at a time."""
        own = np.flatnonzero(self.index)
        ends = np.cumsum(self.count[own])
        at = 0
        while at < len(own):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 1_000_000)))
            rows = own[at:stop]
            at = stop
            a = np.repeat(rows, self.count[rows])
            b = np.arange(len(a)) - np.repeat(np.cumsum(self.count[rows]) - self.count[rows], self.count[rows]) + self.first[a]
            more = self.length[b] - self.length[a]
            keep = (a != b) & (more >= 0) & (more <= edits) & (~self.mixed[a] | (self.chunk[a] != self.chunk[b]))
            # Two lines of one length may probe each other; once is enough.
            keep &= (more > 0) | ~self.index[b] | (a < b)
            yield a[keep], b[keep]

    def padded(self, rows: np.ndarray, width: int, filler: int) -> np.ndarray:
        column = np.arange(width)
        inside = column[None, :] < self.length[rows, None]
        return np.where(inside, self.codes[np.minimum(self.base[rows, None] + column[None, :], len(self.codes) - 1)], np.uint32(filler))

    def later(self, edits: int) -> np.ndarray:
        """Rows within ``edits`` edits of an earlier row of their tile."""
        out = np.zeros(len(self.tile), bool)
        for a, b in self.pairs(edits):
            order = np.argsort(self.length[b], kind="stable")
            a, b = a[order], b[order]
            k = 0
            while k < len(a):
                # As many pairs as fit; long lines take fewer at a time.
                step = max(1, min(PAIRS, 2_000_000 // (int(self.length[b[min(k + PAIRS, len(a)) - 1]]) + 1)))
                x, y = a[k:k + step], b[k:k + step]
                k += step
                todo = ~out[np.maximum(x, y)]
                x, y = x[todo], y[todo]
                if len(x):
                    width = int(self.length[y].max())
                    close = within(self.padded(x, width, 0xFFFFFFFE), self.length[x], self.padded(y, width, 0xFFFFFFFD), self.length[y], edits)
                    out[np.maximum(x, y)[close]] = True
        return out


def _later_lines(edits: int):
    """(block, place) of lines that are within ``edits`` edits of an earlier line of their tile.

    Tiles arrive sorted; those that a batch completes are verified together, as most are pairs.
    """
    def verified(table: pa.Table) -> pa.RecordBatch:
        rows = TileRows(table)
        later = rows.later(edits)
        return pa.record_batch([pa.array(rows.block[later]), pa.array(rows.place[later])], ["block", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            last = [table.column(c)[-1] for c in ("key", "i", "j")]
            open_ = np.logical_and.reduce([table.column(c).to_numpy() == v.as_py() for c, v in zip(("key", "i", "j"), last)])
            cut = int(np.argmax(open_))
            if cut:
                yield verified(table.slice(0, cut).combine_chunks())
            rest = table.slice(cut)
        if rest is not None:
            yield verified(rest.combine_chunks())
    return run


def _near_copies(shared: DataFrame, edits: int) -> DataFrame:
    """(block, places) of first occurrences with a near copy before them.

    A key with many lines is cut into chunks, and every pair of chunks is one task's tile; only
    lines travel, never pairs.
    """
    counts = shared.groupBy("key").agg(F.count("*").alias("n"), F.max("is_index").alias("indexed")).where("n > 1 AND indexed")
    chunks = F.ceil(F.col("n") / TILE).cast("int")
    chunk = F.pmod(F.xxhash64("block", "place"), F.col("chunks")).cast("int").alias("c")
    spread = shared.join(counts.select("key", chunks.alias("chunks")), "key").withColumn("c", chunk)
    tiles = spread.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "key", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "c", "is_index", "block", "place", "doc", "line")
    sorted_tiles = tiles.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = sorted_tiles.mapInArrow(_later_lines(edits), "block long, place long")
    return found.groupBy("block").agg(F.collect_set("place").alias("places"))


def _rebuild(plan: Plan, inner: list[str]):
    def work(_, payload, copies, places) -> Iterator[pa.RecordBatch]:
        table = unpack_batch(payload.as_buffer())
        block = plan.lines(payload.as_buffer())
        gone = np.zeros(len(block.raw), bool)
        gone[block.eligible] = True
        gone[plan.firsts(block, in_order(copies.as_py()))] = False
        exact = gone.copy()
        gone[np.array(places.as_py() or [], np.int64)] = True
        out, at = [], 0
        for lines in block.pieces:
            kept = ~gone[at:at + len(lines)]
            out.append(b"\n".join([x for x, k in zip(lines, kept) if k]).decode())
            at += len(lines)
        n = len(block.pieces)
        count = lambda flags: pa.array(np.bincount(block.row[flags], minlength=n).astype(np.int64))
        yield pa.record_batch([*table.combine_chunks().to_batches()[0].columns, count(np.ones(len(gone), bool)), count(exact), count(gone & ~exact),
                               pa.array(out, pa.string())], [*inner, "n_lines", "n_exact", "n_near", "kept_text"])
    return per_block(work)


def remove_repeated_lines(docs: DataFrame, edits: int = EDITS, id_col: str = "doc_id", text_col: str = "text", exact_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_exact``, ``n_near`` and ``kept_text`` added (names extended by _ where taken).

    Lines are the pieces between \\n; their code points are counted without outer blanks. A line
    of ``exact_chars`` code points or more goes if an equal line comes before it, by id and then
    by place in the text (``n_exact``); ``exact_chars=1`` takes in all lines but blank ones. Or
    else it goes if it has ``MIN_CHARS`` or more and a line of as many within ``edits`` edits comes
    before it (``n_near``). All lines are judged on the input. Kept lines stay in order. A null
    text is empty: one line, nothing removed. Documents with equal ids are not before each other
    as far as exact copies go; a null id comes last. Ids must be integers.
    An empty table gives an empty result.
    """
    names = docs.columns
    text_at, id_at = names.index(text_col), names.index(id_col)

    def n_lines(part: pa.RecordBatch) -> int:
        data, rows = text_buffer(part.column(text_at))
        return int((data == 10).sum()) + len(rows) - 1

    blocks = to_blocks(docs, text_at, n_lines)
    plan = Plan(text_at, id_at, edits, exact_chars, blocks.agg(F.sum("items")).first()[0] or 0)
    packed = blocks.select("block", "payload")
    copies = materialize(answered(packed.mapInArrow(_ask_lines(plan), question_schema()), _earlier_elsewhere).withColumnRenamed("answers", "copies"), "copies")
    told = packed.join(copies, "block", "left")
    keys = answered(told.mapInArrow(_ask_keys(plan), question_schema()), _seen_twice).withColumnRenamed("answers", "keys")
    shared = materialize(told.join(keys, "block", "left").select("block", "payload", "copies", "keys").mapInArrow(
        _shared_lines(plan), "key long, is_index boolean, block long, place long, doc long, line string"), "shared")
    near = materialize(_near_copies(shared, edits), "near")
    inner = [f"c{i}" for i in range(len(names))]
    schema = T.StructType([*docs.toDF(*inner).schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_exact", T.LongType()),
                           T.StructField("n_near", T.LongType()), T.StructField("kept_text", T.StringType())])
    result = told.join(near, "block", "left").select("block", "payload", "copies", "places").mapInArrow(_rebuild(plan, inner), schema)
    return result.toDF(*names, *(fresh_name(docs, n) for n in ("n_lines", "n_exact", "n_near", "kept_text")))
