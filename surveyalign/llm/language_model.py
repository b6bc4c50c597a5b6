"""Document scores of a log-bilinear language model trained with noise-contrastive estimation.

Counts of all words come from all training documents by block and slab (see ``exchange``). Every
training word has a place of its own in the model, which a walk of three steps finds:

* its *unit*: the most frequent words are units of their own, about half the square root of the
  vocabulary at most; the others belong to the band of their count (1, 2-3, 4-7, ...);
* its *class* inside the band and its *cell* inside the class, both by bits of the word's hash.
  A cell has some 64 words of a band, and a band about as many classes as cells in a class, so
  classes and vectors grow with the square root of the vocabulary, while every word is told apart
  from all but the few of its cell, among which its count decides.

Each step is a softmax: a child scores the product of its vector with the context vector, plus a
bias. Units shape the context vectors; classes and cells learn theirs against them. The context vector is the sum of the vectors of the two preceding words' units, each scaled
component-wise. Documents are dealt to shards by a hash of their id and text; every shard trains a
copy, the copies are averaged in proportion to their tokens by whole-number sums, and that repeats
for a few rounds, so scores do not depend on how the table is laid out in files. They are
normalised exactly over all children of every step.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyalign.llm.common import lowered, materialize, span_hashes, text_buffer, word_spans
from surveyalign.llm.exchange import in_order, pack_batch, pack_sorted, question_schema, slab_count, slab_runs, to_blocks, unpack_batch, unpack_sorted
from surveyalign.llm.passages import _question_rows

SIZE = 24
ROUNDS = 2

#: Words of a band that share a cell, about.
CELL_WORDS = 64

#: A band whose cells are wider than a slab has at most 2 ** WIDE_BITS of them; the driver holds their totals.
WIDE_BITS = 12

#: Text bytes of one training shard.
SHARD_BYTES = 32 << 20

#: Noise drawn for each step of ``STEP`` trigrams among units, and among classes or cells; AdaGrad's rates.
NOISE = 96
INNER_NOISE = 32
STEP = 2048
RATE, INNER_RATE, BIAS_RATE = 0.2, 0.03, 0.005

#: Weights are averaged as whole multiples of ``GRAIN``, in runs of ``WEIGHTS``.
GRAIN = 2.0 ** -45
WEIGHTS = 4096

#: Hash of the end mark; no word has an empty text.
END = np.uint64(0)

CONTEXTS = 8192


class Tokens:
    """Token hashes of one block; every text ends with the end mark."""

    def __init__(self, table: pa.Table):
        data, rows = text_buffer(table.column(1))
        data = lowered(data)
        starts, ends, first = word_spans(data, rows)
        words = np.maximum(span_hashes(data, starts, ends), 1)
        n = np.diff(first) + 1
        self.first = np.concatenate([[0], np.cumsum(n)])
        self.hashes = np.full(self.first[-1], END, np.uint64)
        inner = np.ones(len(self.hashes), bool)
        inner[self.first[1:] - 1] = False
        self.hashes[inner] = words
        ids = table.column(0).to_pylist()
        self.held_out = np.array([crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i in ids], bool)
        self.train = np.repeat(~self.held_out, n)

    def counted(self):
        """Distinct hashes in order, their training counts here, and the place of every token among them."""
        values, place = np.unique(self.hashes, return_inverse=True)
        return values, np.bincount(place[self.train], minlength=len(values)), place


def pack_counts(counts: np.ndarray) -> bytes:
    """Unsigned integers, byte planes apart."""
    raw = np.ascontiguousarray(counts, "<u8").view(np.uint8).reshape(-1, 8)
    planes = max(1, (int(counts.max(initial=0)).bit_length() + 7) // 8)
    return bytes([planes]) + np.ascontiguousarray(raw[:, :planes].T).tobytes()


def unpack_counts(packed: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :packed[0]] = np.frombuffer(packed, np.uint8, n * packed[0], 1).reshape(packed[0], n).T
    return out.reshape(-1).view("<u8").astype(np.int64)


def _ask_counts(slabs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, payload in zip(batch.column("block").to_pylist(), batch.column("payload")):
                values, counts, _ = Tokens(unpack_batch(payload.as_buffer())).counted()
                parts = []
                for s, a, b in slab_runs(values, slabs, 64):
                    packed = pack_sorted(values[a:b])
                    parts.append((s, np.array([b - a, len(packed)], "<i8").tobytes() + packed + pack_counts(counts[a:b])))
                yield _question_rows(number, parts)
    return run


def _sums(asked: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A slab's distinct hashes, their totals, the place of every asked hash, and where each question begins."""
    hashes, counts = [], []
    for a in asked:
        n, used = np.frombuffer(a, "<i8", 2)
        hashes.append(unpack_sorted(a[16:16 + used]))
        counts.append(unpack_counts(a[16 + used:], n))
    values, place = np.unique(np.concatenate(hashes), return_inverse=True)
    totals = np.zeros(len(values), np.int64)
    np.add.at(totals, place, np.concatenate(counts))
    return values, totals, place, np.cumsum([0, *map(len, hashes)])


def bands(counts: np.ndarray) -> np.ndarray:
    """0 for counts up to 1, 1 for 2 and 3, 2 for 4 to 7, and so on."""
    return np.frexp(np.maximum(counts, 1).astype(np.float64))[1] - 1


def _tally_bands(pdf: pd.DataFrame) -> pd.DataFrame:
    values, totals, _, _ = _sums(pdf["asked"].tolist())
    at = bands(totals[totals > 0])
    words = np.bincount(at)
    tokens = np.zeros(len(words), np.int64)
    np.add.at(tokens, at, totals[totals > 0])
    return pd.DataFrame({"slab": int(pdf["slab"].iloc[0]), "band": np.arange(len(words)), "words": words, "tokens": tokens})


class Vocabulary:
    """How words are placed: bits of every band, totals of the training documents, the units of their own."""

    def __init__(self, words: np.ndarray, tokens: np.ndarray, slab_bits: int):
        self.distinct, self.tokens = int(words.sum()), int(tokens.sum())
        above = np.append(np.cumsum(words[::-1])[::-1], 0)  # words of this band and higher ones
        self.n_bands = next((b for b in range(1, len(above)) if above[b] <= self.distinct ** 0.5 / 2), 1)
        words, tokens = np.resize(words, self.n_bands) if len(words) else np.zeros(1, int), np.resize(tokens, self.n_bands) if len(tokens) else np.zeros(1, int)
        self.band_tokens = tokens
        self.bits = [max(int(w) // CELL_WORDS, 1).bit_length() - 1 for w in words]
        self.wide = {b: None for b, n in enumerate(self.bits) if n < slab_bits}
        self.bits = [min(n, WIDE_BITS) if b in self.wide else n for b, n in enumerate(self.bits)]
        self.class_bits = [(n + 1) // 2 for n in self.bits]
        self.cell_bits = [n // 2 for n in self.bits]
        self.own(np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def own(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        """Sets the words that are units of their own."""
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        n = len(hashes)
        self.n_units = n + self.n_bands
        sizes = [1 << c for c in self.class_bits]
        self.first_class = n + np.cumsum([0, *sizes])
        self.n_classes = int(self.first_class[-1])
        self.unit_of = np.concatenate([np.arange(n), np.repeat(n + np.arange(self.n_bands), sizes)]).astype(np.int64)
        edges = np.cumsum([self.n_units, *(1 << k for pair in zip(self.class_bits, self.cell_bits) for k in pair)])
        #: Rows of the target vectors: of units, and for each band of its classes and its cells.
        self.unit_rows = slice(0, self.n_units)
        self.class_rows = [slice(a, b) for a, b in zip(edges[0:-1:2], edges[1::2])]
        self.cell_rows = [slice(a, b) for a, b in zip(edges[1:-1:2], edges[2::2])]

    def cell_numbers(self, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Number of the cell of every word among the cells of its band."""
        bits = np.array(self.bits, np.uint64)[np.minimum(at, self.n_bands - 1)]
        return np.where(bits > 0, hashes >> np.minimum(np.uint64(64) - bits, np.uint64(63)), np.uint64(0)).astype(np.int64)

    def cell_totals(self, hashes: np.ndarray, totals: np.ndarray) -> np.ndarray:
        """Tokens in the cell of every distinct word of a slab; its own for a word that is a unit."""
        at = bands(totals)
        cells = self.cell_numbers(hashes, at)
        out = totals.copy()
        for b in range(self.n_bands):
            rows = np.flatnonzero(at == b)
            if b in self.wide:
                out[rows] = self.wide[b][cells[rows]]
            elif len(rows):
                _, place = np.unique(cells[rows], return_inverse=True)
                sums = np.zeros(place.max() + 1, np.int64)
                np.add.at(sums, place, totals[rows])
                out[rows] = sums[place]
        return out

    def places(self, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class of every word, and its cell inside the class."""
        at = bands(counts)
        cells = self.cell_numbers(hashes, at)
        band = np.minimum(at, self.n_bands - 1)
        inner = np.array(self.cell_bits)[band]
        classes = self.first_class[band] + (cells >> inner)
        own = at >= self.n_bands
        classes[own] = np.searchsorted(self.hashes, hashes[own])
        return classes, np.where(own, 0, cells & ((1 << inner) - 1))

    def noise(self) -> np.ndarray:
        """Share of every child in its step: by tokens among units, even among classes and cells."""
        share = np.concatenate([self.counts, self.band_tokens]).astype(np.float64) + 0.5
        sizes = [1 << k for pair in zip(self.class_bits, self.cell_bits) for k in pair]
        return np.concatenate([share / share.sum(), *(np.full(k, 1 / k) for k in sizes)])

    def base_logs(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.tokens + 0.1 * (self.distinct + 1)))

    def cell_logs(self, counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
        """log10 share of a word in its cell; in the lowest band unseen words take one place a cell together."""
        extra = np.where(counts < 2, 0.1, 0.0)
        return np.where(bands(counts) >= self.n_bands, 0.0, np.log10((counts + extra) / (totals + extra * (totals + 1))))


def _answer(vocabulary: Vocabulary):
    """Totals of a slab's words and of their cells for every block; a row of block -1 has the words that are units."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        values, totals, place, cuts = _sums(pdf["asked"].tolist())
        cells = vocabulary.cell_totals(values, totals)
        replies = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            counted = pack_counts(totals[place[a:b]])
            replies.append(np.array([len(counted)], "<i8").tobytes() + counted + pack_counts(cells[place[a:b]]))
        own = bands(totals) >= vocabulary.n_bands
        summary = values[own].tobytes() + totals[own].tobytes()
        slab = int(pdf["slab"].iloc[0])
        return pd.DataFrame({"block": [*pdf["block"], -1], "slab": [slab] * (len(replies) + 1), "reply": [*replies, summary]})
    return run


def _encode(vocabulary: Vocabulary, slabs: int):
    """Per block: class and cell of all tokens, and of every document all that the model is not needed for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, payload, answers in zip(batch.column("block").to_pylist(), batch.column("payload"), batch.column("answers")):
                table = unpack_batch(payload.as_buffer())
                tokens = Tokens(table)
                values, _, place = tokens.counted()
                totals, cell_totals = np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
                replies = in_order(answers.as_py())
                for s, a, b in slab_runs(values, slabs, 64):
                    reply = replies[s]
                    used = int(np.frombuffer(reply, "<i8", 1)[0])
                    totals[a:b] = unpack_counts(reply[8:8 + used], b - a)
                    cell_totals[a:b] = unpack_counts(reply[8 + used:], b - a)
                classes, cells = vocabulary.places(values, totals)
                per_token = [vocabulary.base_logs(totals), vocabulary.cell_logs(totals, cell_totals), totals > 0]
                base, cell_part, known = (np.add.reduceat(x[place], tokens.first[:-1], dtype=np.float64) for x in per_token)
                docs = pa.record_batch([
                    table.column(0).combine_chunks(), pa.array(tokens.held_out), pa.array(np.diff(tokens.first)), pa.array(known.astype(np.int64)),
                    pa.array(base), pa.array(cell_part)], ["id", "held_out", "n_tokens", "n_known", "base_score", "cell_part"])
                sequence = pa.record_batch([pa.array(classes[place].astype(np.int32)), pa.array(cells[place].astype(np.int32))], ["classes", "cells"])
                yield pa.record_batch([pa.array([number]), pa.array([pack_batch(docs)], pa.binary()), pa.array([pack_batch(sequence)], pa.binary())],
                                      ["block", "docs", "sequence"])
    return run


def _trigrams(docs: pa.Table, classes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The two classes before every token; class n stands before a text."""
    lengths = docs.column("n_tokens").to_numpy()
    first = np.cumsum(lengths) - lengths
    one, two = np.empty(len(classes), np.int64), np.empty(len(classes), np.int64)
    one[1:], two[2:] = classes[:-1], classes[:-2]
    one[first] = n
    two[first] = n
    second = first[lengths > 1] + 1
    two[second] = n
    return one, two


class Model:
    """Weights: vectors of the units as contexts (one more for the start), scales, vectors and biases of all children."""

    NAMES = ("context", "near", "far", "target", "bias")

    def __init__(self, children: int, contexts: int):
        self.contexts = contexts
        self.shapes = {"context": (contexts + 1, SIZE), "near": (SIZE,), "far": (SIZE,), "target": (children, SIZE), "bias": (children,)}

    @classmethod
    def fresh(cls, noise: np.ndarray, contexts: int | None = None, seed: int = 5) -> tuple[Model, np.ndarray]:
        model = cls(len(noise), len(noise) if contexts is None else contexts)
        rng = np.random.default_rng(seed)
        parts = {"context": rng.normal(0, 0.3, model.shapes["context"]), "near": np.ones(SIZE), "far": np.full(SIZE, 0.5),
                 "target": rng.normal(0, 0.05, model.shapes["target"]), "bias": np.log(noise)}
        return model, np.concatenate([parts[k].ravel() for k in cls.NAMES])

    def parts(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name in self.NAMES:
            size = int(np.prod(self.shapes[name]))
            out[name] = flat[at:at + size].reshape(self.shapes[name])
            at += size
        return out


def _scatter(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, values.shape[1]), values.dtype)
    order = np.argsort(rows, kind="stable")
    held = rows[order]
    first = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
    out[held[first]] = np.add.reduceat(values[order], first)
    return out


def children(w: dict, rows: slice) -> dict:
    """The model of one step: the children in ``rows``."""
    return {**w, "target": w["target"][rows], "bias": w["bias"][rows]}


def nce_step(w: dict, one, two, target, weight, drawn, noise, whole: bool = True) -> dict[str, np.ndarray]:
    """Gradient of the NCE loss of weighted trigrams against drawn noise children, per unit of weight.

    Without ``whole`` only that of the children themselves.
    """
    a, b = w["context"][one], w["context"][two]
    r = a * w["near"] + b * w["far"]
    log_noise = np.log(len(drawn) * noise).astype(w["bias"].dtype)
    true = (r * w["target"][target]).sum(axis=1) + w["bias"][target] - log_noise[target]
    fake = r @ w["target"][drawn].T + (w["bias"] - log_noise)[drawn]
    share = (weight / weight.sum()).astype(r.dtype)
    up = -share / (1 + np.exp(np.clip(true, -30, 30)))
    down = share[:, None] / (1 + np.exp(-np.clip(fake, -30, 30)))
    n = len(w["bias"])
    d_target = _scatter(target, up[:, None] * r, n)
    np.add.at(d_target, drawn, down.T @ r)
    d_bias = np.bincount(target, up, n)
    np.add.at(d_bias, drawn, down.sum(axis=0))
    if not whole:
        return {"target": d_target, "bias": d_bias}
    dr = up[:, None] * w["target"][target] + down @ w["target"][drawn]
    rows = len(w["context"])
    d_context = _scatter(one, dr * w["near"], rows) + _scatter(two, dr * w["far"], rows)
    return {"context": d_context, "near": (dr * a).sum(axis=0), "far": (dr * b).sum(axis=0), "target": d_target, "bias": d_bias}


def _steps(vocabulary: Vocabulary, one: np.ndarray, two: np.ndarray, classes: np.ndarray, cells: np.ndarray):
    """(rows of children, places of tokens, their child) for units, then for classes and cells band by band."""
    yield vocabulary.unit_rows, np.arange(len(classes)), vocabulary.unit_of[classes]
    for b, (low, high) in enumerate(zip(vocabulary.first_class[:-1], vocabulary.first_class[1:])):
        if vocabulary.class_bits[b]:
            at = np.flatnonzero((classes >= low) & (classes < high))
            yield vocabulary.class_rows[b], at, classes[at] - low
            if vocabulary.cell_bits[b]:
                yield vocabulary.cell_rows[b], at, cells[at]


def _train_round(vocabulary: Vocabulary, model: Model, start: np.ndarray, noise: np.ndarray, round_number: int, step: int):
    """(i, shard, part): runs of a shard's weights after its blocks, times its share of all training tokens, in grains."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        flat, seen = start.astype(np.float32), 0
        squares = np.full(len(flat), 1e-6, np.float32)
        w, sq = model.parts(flat), model.parts(squares)
        n = model.contexts + 1
        for number, docs, sequence in pdf.sort_values("block")[["block", "docs", "sequence"]].itertuples(index=False):
            docs, sequence = unpack_batch(docs), unpack_batch(sequence)
            classes, cells = (sequence.column(k).to_numpy().astype(np.int64) for k in range(2))
            one, two = _trigrams(docs, vocabulary.unit_of[classes], model.contexts)
            keep = np.repeat(~docs.column("held_out").to_numpy(zero_copy_only=False), docs.column("n_tokens").to_numpy())
            seen += int(keep.sum())
            one, two, classes, cells = one[keep], two[keep], classes[keep], cells[keep]
            rng = np.random.default_rng([round_number, number & 0xFFFFFFFF, number >> 32])
            for rows, at, child in _steps(vocabulary, one, two, classes, cells):
                size = rows.stop - rows.start
                keys, counts = np.unique((two[at] * n + one[at]) * size + child, return_counts=True)
                order = rng.permutation(len(keys))
                own, own_sq, prior = children(w, rows), children(sq, rows), noise[rows]
                outer, edges = rows is vocabulary.unit_rows, np.cumsum(prior)[:-1]
                for k in range(0, len(order), step):
                    key, weight = keys[order[k:k + step]], counts[order[k:k + step]].astype(np.float64)
                    context, target = key // size, key % size
                    drawn = np.searchsorted(edges, rng.random(NOISE if outer else INNER_NOISE), side="right")
                    for name, g in nce_step(own, context % n, context // n, target, weight, drawn, prior, outer).items():
                        g *= len(key)
                        own_sq[name] += g * g
                        own[name] -= (BIAS_RATE if name == "bias" else RATE if outer else INNER_RATE) * g / np.sqrt(own_sq[name])
        part = np.rint(flat.astype(np.float64) * (seen / max(vocabulary.tokens, 1)) / GRAIN).astype(np.int64)
        cuts = range(0, len(part), WEIGHTS)
        return pd.DataFrame({"i": [*cuts], "shard": int(pdf["block"].iloc[0]) >> 32, "part": [part[i:i + WEIGHTS].astype("<i8").tobytes() for i in cuts]})
    return run


def _add_weights(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sum of one run of weights over shards; whole numbers, so in any order."""
    total = sum(np.frombuffer(part, "<i8") for part in pdf["part"])
    return pd.DataFrame({"i": pdf["i"].iloc[:1], "shard": pdf["shard"].iloc[:1], "part": [total.tobytes()]})


def log_probabilities(w: dict, one: np.ndarray, two: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log of the normalised probability of every token's child."""
    n = len(w["context"])
    contexts, place = np.unique(two * n + one, return_inverse=True)
    r = (w["context"][contexts % n] * w["near"] + w["context"][contexts // n] * w["far"]).astype(np.float32)
    q, bias = w["target"].astype(np.float32).T, w["bias"].astype(np.float32)
    by_context = np.argsort(place, kind="stable")
    cuts = np.searchsorted(place[by_context], np.arange(0, len(contexts) + CONTEXTS, CONTEXTS))
    out = np.empty(len(target))
    for k in range(0, len(contexts), CONTEXTS):
        s = r[k:k + CONTEXTS] @ q + bias
        top = s.max(axis=1, keepdims=True)
        s -= top + np.log(np.exp(s - top).sum(axis=1, keepdims=True))
        rows = by_context[cuts[k // CONTEXTS]:cuts[k // CONTEXTS + 1]]
        out[rows] = s[place[rows] - k, target[rows]]
    return out


def _score(vocabulary: Vocabulary, model: Model, flat: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.parts(flat)
        for batch in batches:
            for docs, sequence in zip(batch.column("docs"), batch.column("sequence")):
                docs, sequence = unpack_batch(docs.as_buffer()), unpack_batch(sequence.as_buffer())
                classes, cells = (sequence.column(k).to_numpy().astype(np.int64) for k in range(2))
                one, two = _trigrams(docs, vocabulary.unit_of[classes], model.contexts)
                logs = np.zeros(len(classes))
                for rows, at, child in _steps(vocabulary, one, two, classes, cells):
                    logs[at] += log_probabilities(children(w, rows), one[at], two[at], child)
                n = docs.column("n_tokens").to_numpy()
                score = np.add.reduceat(logs / np.log(10), np.cumsum(n) - n) + docs.column("cell_part").to_numpy()
                own = docs.select(["id", "held_out", "n_tokens", "n_known"]).combine_chunks().to_batches()[0]
                yield pa.record_batch([*own.columns, pa.array(np.full(len(n), vocabulary.tokens)), docs.column("base_score").combine_chunks(), pa.array(score)],
                                      ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return run


def _vocabulary(asked: DataFrame, slabs: int) -> Vocabulary:
    """Bands of all words; the totals of cells wider than a slab are added up here."""
    slab_bits = slabs.bit_length() - 1
    tallies = materialize(asked.groupBy("slab").applyInPandas(_tally_bands, "slab int, band int, words long, tokens long"), "bands")
    sums = {r["band"]: r for r in tallies.groupBy("band").agg(F.sum("words").alias("words"), F.sum("tokens").alias("tokens")).collect()}
    each = range(max(sums, default=-1) + 1)
    words, tokens = (np.array([sums[b][k] if b in sums else 0 for b in each], np.int64) for k in ("words", "tokens"))
    vocabulary = Vocabulary(words, tokens, slab_bits)
    vocabulary.wide = {b: np.zeros(1 << vocabulary.bits[b], np.int64) for b in vocabulary.wide}
    if vocabulary.wide:
        cell = F.expr("CASE band " + " ".join(f"WHEN {b} THEN shiftright(slab, {slab_bits - vocabulary.bits[b]})" for b in vocabulary.wide) + " END")
        for r in tallies.withColumn("cell", cell).where("cell IS NOT NULL").groupBy("band", "cell").agg(F.sum("tokens").alias("tokens")).collect():
            vocabulary.wide[r["band"]][r["cell"]] = r["tokens"]
    return vocabulary


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of ``docs``.

    Documents whose id, as text, has a crc32 divisible by 10 are held out of all that is learned.
    A null text counts as empty and has the end mark alone; a null id counts as an empty text
    and so is held out; rows and ids that repeat are learned from as often as they occur, rows
    that agree in id and text in one shard. Other columns are not carried. An empty table gives an
    empty result; without training documents every word is new and the scores stay defined. The
    driver holds the band sums, at most ``2 ** WIDE_BITS`` cell totals a band, the words that are
    units and the weights, both about the square root of the vocabulary in number.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    n_bytes = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = F.xxhash64(F.col("id").cast("string"), "text")
    shards = 1 + n_bytes // SHARD_BYTES
    few = 1 + int(shards ** 0.5)  # sums of so many groups of shards, then of these, so that no task adds up all
    source = source.repartition(shards, dealt).sortWithinPartitions(dealt, "id")
    blocks = to_blocks(source, 1, lambda part: sum(len((t or "").split()) + 1 for t in part.column(1).to_pylist()))
    slabs = 1 << (slab_count(blocks.agg(F.sum("items")).first()[0] or 0) - 1).bit_length()
    asked = materialize(blocks.select("block", "payload").mapInArrow(_ask_counts(slabs), question_schema()), "asked")
    vocabulary = _vocabulary(asked, slabs)
    replies = materialize(asked.groupBy("slab").applyInPandas(_answer(vocabulary), "block long, slab int, reply binary"), "counts")
    own = [np.frombuffer(r["reply"], "<u8").reshape(2, -1) for r in replies.where("block = -1").select("reply").collect()]
    if own:
        hashes, counts = np.concatenate(own, axis=1)
        vocabulary.own(hashes, counts.astype(np.int64))
    told = blocks.select("block", "payload").join(
        replies.where("block >= 0").groupBy("block").agg(F.collect_list(F.struct("slab", "reply")).alias("answers")), "block")
    encoded = materialize(told.mapInArrow(_encode(vocabulary, slabs), "block long, docs binary, sequence binary"), "encoded")
    noise = vocabulary.noise()
    model, flat = Model.fresh(noise, vocabulary.n_units)
    for k in range(rounds):
        trained = encoded.groupBy(F.shiftright("block", 32).alias("shard")).applyInPandas(
            _train_round(vocabulary, model, flat, noise, k, STEP), "i int, shard long, part binary")
        some = trained.groupBy("i", F.col("shard") % few).applyInPandas(_add_weights, trained.schema)
        sums = some.groupBy("i").applyInPandas(_add_weights, trained.schema).collect()
        if sums and vocabulary.tokens:
            flat = np.concatenate([np.frombuffer(r["part"], "<i8") for r in sorted(sums, key=lambda r: r["i"])]) * GRAIN
    schema = T.StructType([
        T.StructField("id", source.schema["id"].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()),
        T.StructField("score", T.DoubleType())])
    return encoded.mapInArrow(_score(vocabulary, model, flat), schema).withColumnRenamed("id", id_col)
