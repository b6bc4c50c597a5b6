"""Main text of HTML pages by a recurrent block labeller.

A page is a sequence of leaf blocks. Each block becomes a vector of its tag path, its hashed
words and a few measures; a bidirectional LSTM in numpy reads the whole sequence, and so judges
every block in the context of the document. The model is trained here on labelled pages that
are laid out by rule around words of a bounded sample of the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyalign.llm.common import fresh_name, slices
from surveyalign.llm.html_blocks import PATH_SLOTS, Leaf, leaves
from surveyalign.llm.page_layouts import ARTICLE, OTHER, Layout

WORD_SLOTS = 4096
PATH_SIZE, WORD_SIZE, MEASURES, HIDDEN = 16, 8, 6, 14

#: Training: pages laid out, passes over them, pages a step; and the pages whose words they use.
PAGES, EPOCHS, STEP_PAGES = 900, 10, 30
SAMPLE_PAGES = 200

#: Shares of training pages whose words, or measures, are hidden from a step.
HIDE_WORDS, HIDE_MEASURES = 0.7, 0.6

_word_slots: dict[str, int] = {}


def _word_slot(word: str) -> int:
    found = _word_slots.get(word)
    if found is None:
        if len(_word_slots) > 200_000:
            _word_slots.clear()
        found = _word_slots[word] = crc32(word.encode()) % WORD_SLOTS
    return found


@dataclass
class Blocks:
    """Features of the blocks of some pages, page after page."""

    counts: np.ndarray
    path: np.ndarray
    path_at: np.ndarray
    words: np.ndarray
    words_at: np.ndarray
    measures: np.ndarray


def featurize(pages: list[list[Leaf]]) -> Blocks:
    path, path_n, words, words_n, measures = [], [], [], [], []
    for blocks in pages:
        n = len(blocks)
        for k, b in enumerate(blocks):
            path.extend(b.path)
            path_n.append(len(b.path))
            own = b.text.lower().split()
            words.extend(map(_word_slot, own))
            words_n.append(len(own))
            size = len(b.text)
            measures.append((np.log1p(size) / 8, b.link_chars / size, b.text[-1] in ".!?:;\"'", k / n, len(own) / (size + 1) * 3, n > 1))
    at = lambda counts: np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    return Blocks(np.array([len(p) for p in pages], np.int64), np.array(path, np.int64), at(path_n), np.array(words, np.int64), at(words_n),
                  np.array(measures, np.float32).reshape(-1, MEASURES))


def _means(table: np.ndarray, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Mean row of ``table`` per run of ids, without a row per id in memory at once."""
    out = np.zeros((len(at) - 1, table.shape[1]), np.float32)
    for low in range(0, len(at) - 1, 2000):
        high = min(low + 2000, len(at) - 1)
        cut = at[low:high + 1]
        n = np.diff(cut)
        some = np.flatnonzero(n)
        if len(some):
            out[low + some] = np.add.reduceat(table[ids[cut[0]:cut[-1]]], (cut[:-1] - cut[0])[some], axis=0) / n[some, None]
    return out


@dataclass
class Labeller:
    """Weights of the model; plain arrays, about 200 KB."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int) -> Labeller:
        rng = np.random.default_rng(seed)
        size = PATH_SIZE + WORD_SIZE + MEASURES
        w = {"path": rng.normal(0, 0.3, (PATH_SLOTS, PATH_SIZE)), "words": rng.normal(0, 0.1, (WORD_SLOTS, WORD_SIZE))}
        for way in ("forward", "backward"):
            w[way + "_x"] = rng.normal(0, size ** -0.5, (size, 4 * HIDDEN))
            w[way + "_h"] = rng.normal(0, HIDDEN ** -0.5, (HIDDEN, 4 * HIDDEN))
            w[way + "_b"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        w["out"], w["out_x"], w["out_b"] = rng.normal(0, 0.2, 2 * HIDDEN), np.zeros(size), np.zeros(1)
        return cls({k: v.astype(np.float32) for k, v in w.items()})

    def inputs(self, b: Blocks) -> np.ndarray:
        return np.concatenate([_means(self.weights["path"], b.path, b.path_at), _means(self.weights["words"], b.words, b.words_at), b.measures], axis=1)

    def _run(self, way: str, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """States of one direction over padded (step, page, size) inputs; the steps' parts too if they are kept."""
        steps, n, _ = x.shape
        wx, wh, bias = (self.weights[f"{way}_{k}"] for k in "xhb")
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        states, parts = np.zeros((steps, n, HIDDEN), np.float32), []
        fed = x.reshape(steps * n, -1) @ wx
        fed = fed.reshape(steps, n, -1) + bias
        for t in (range(steps) if way == "forward" else range(steps - 1, -1, -1)):
            gates = fed[t] + h @ wh
            i, f, o = (1 / (1 + np.exp(-gates[:, k * HIDDEN:(k + 1) * HIDDEN])) for k in range(3))
            g = np.tanh(gates[:, 3 * HIDDEN:])
            new_c = f * c + i * g
            tanh_c = np.tanh(new_c)
            m = mask[t][:, None]
            new_c, new_h = m * new_c, m * (o * tanh_c)
            if keep:
                parts.append((t, h, c, i, f, o, g, tanh_c))
            h, c = new_h, new_c
            states[t] = h
        return states, parts

    def _padded(self, x: np.ndarray, counts: np.ndarray):
        steps = int(counts.max(initial=0))
        page = np.repeat(np.arange(len(counts)), counts)
        step = np.arange(len(page)) - np.repeat(np.cumsum(counts) - counts, counts)
        out, mask = np.zeros((steps, len(counts), x.shape[1]), np.float32), np.zeros((steps, len(counts)), np.float32)
        out[step, page], mask[step, page] = x, 1
        return out, mask, step, page

    def scores(self, b: Blocks) -> np.ndarray:
        """Log odds of each block being main text; pages of like length share a batch."""
        out = np.zeros(len(b.measures), np.float32)
        x = self.inputs(b)
        first = np.cumsum(b.counts) - b.counts
        order = np.argsort(b.counts, kind="stable")
        at = 0
        while at < len(order):
            size = max(1, min(256, 100_000 // (int(b.counts[order[min(at + 255, len(order) - 1)]]) + 1)))
            pages = order[at:at + size]
            at += size
            counts = b.counts[pages]
            if not counts.any():
                continue
            rows = np.concatenate([np.arange(first[p], first[p] + b.counts[p]) for p in pages])
            padded, mask, step, page = self._padded(x[rows], counts)
            both = np.concatenate([self._run("forward", padded, mask)[0], self._run("backward", padded, mask)[0]], axis=2)[step, page]
            out[rows] = both @ self.weights["out"] + x[rows] @ self.weights["out_x"] + self.weights["out_b"][0]
        return out

    def gradients(self, b: Blocks, label: np.ndarray, kept: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the mean log loss, by backpropagation through the sequence.

        ``kept`` (blocks x inputs, 0 or 1) hides inputs, so that none is relied on alone.
        """
        w = self.weights
        x = self.inputs(b) * kept
        padded, mask, step, page = self._padded(x, b.counts)
        ways = {way: self._run(way, padded, mask, keep=True) for way in ("forward", "backward")}
        both = np.concatenate([ways["forward"][0], ways["backward"][0]], axis=2)[step, page]
        p = 1 / (1 + np.exp(-(both @ w["out"] + x @ w["out_x"] + w["out_b"][0])))
        d = (p - label) / len(label)
        grad = {"out": both.T @ d, "out_x": x.T @ d, "out_b": np.array([d.sum()])}
        dx = np.outer(d, w["out_x"])
        d_padded = np.zeros(padded.shape, np.float32)
        for k, way in enumerate(("forward", "backward")):
            dh_all = np.zeros(padded.shape[:2] + (HIDDEN,), np.float32)
            dh_all[step, page] = np.outer(d, w["out"][k * HIDDEN:(k + 1) * HIDDEN])
            dh = dc = np.zeros((padded.shape[1], HIDDEN), np.float32)
            gx, gh, gb = (np.zeros_like(w[f"{way}_{s}"]) for s in "xhb")
            for t, h, c, i, f, o, g, tanh_c in reversed(ways[way][1]):
                m = mask[t][:, None]
                dh = m * (dh + dh_all[t])
                dc = m * dc + dh * o * (1 - tanh_c ** 2)
                dg = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tanh_c * o * (1 - o), dc * i * (1 - g ** 2)], axis=1)
                gx += padded[t].T @ dg
                gh += h.T @ dg
                gb += dg.sum(axis=0)
                d_padded[t] += dg @ w[way + "_x"].T
                dh, dc = dg @ w[way + "_h"].T, dc * f
            grad[way + "_x"], grad[way + "_h"], grad[way + "_b"] = gx, gh, gb
        dx = (dx + d_padded[step, page]) * kept
        for name, ids, at, low in (("path", b.path, b.path_at, 0), ("words", b.words, b.words_at, PATH_SIZE)):
            n = np.diff(at)
            share = dx[:, low:low + w[name].shape[1]] / np.maximum(n, 1)[:, None]
            row = np.repeat(np.arange(len(n)), n)
            grad[name] = np.stack([np.bincount(ids, share[row, k], len(w[name])) for k in range(share.shape[1])], axis=1).astype(np.float32)
        return grad


def _labelled(layout: Layout) -> tuple[list[Leaf], list[int]]:
    """Blocks of one laid-out page without their marks, and which are article."""
    blocks, labels = [], []
    for b in leaves(layout.page()):
        marks = [c for c in b.text if c in (ARTICLE, OTHER)]
        text = " ".join(b.text.replace(ARTICLE, "").replace(OTHER, "").split())
        if text:
            blocks.append(Leaf(text, b.path, min(b.link_chars, len(text))))
            labels.append(int(bool(marks) and marks[0] == ARTICLE))
    return blocks, labels


def train(words: list[str], seed: int = 11, pages: int = PAGES, epochs: int = EPOCHS) -> Labeller:
    """A labeller trained on laid-out pages; the same words and seed give the same weights."""
    layout = Layout(words, seed)
    made = [m for m in (_labelled(layout) for _ in range(pages)) if m[0]]
    model = Labeller.fresh(seed)
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in model.weights.items()}
    second = {k: np.zeros_like(v) for k, v in model.weights.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(made))
        for k in range(0, len(order), STEP_PAGES):
            chosen = [made[i] for i in order[k:k + STEP_PAGES]]
            labels = np.array([x for _, own in chosen for x in own], np.float32)
            counts = [len(own) for _, own in chosen]
            kept = np.ones((len(labels), PATH_SIZE + WORD_SIZE + MEASURES), np.float32)
            kept[np.repeat(rng.random(len(counts)) < HIDE_WORDS, counts), PATH_SIZE:PATH_SIZE + WORD_SIZE] = 0
            kept[np.repeat(rng.random(len(counts)) < HIDE_MEASURES, counts), PATH_SIZE + WORD_SIZE:] = 0
            grad = model.gradients(featurize([b for b, _ in chosen]), labels, kept)
            step += 1
            rate = 0.02 * (1 - epoch / epochs) + 0.002
            for name, g in grad.items():
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                model.weights[name] = (model.weights[name] - rate * (first[name] / (1 - 0.9 ** step)) / (
                    np.sqrt(second[name] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return model


def sample_words(pages: DataFrame, id_col: str, html_col: str, limit: int = SAMPLE_PAGES) -> list[str]:
    """Words of a bounded sample: the pages with the least hashes.

    Tasks send the driver hashes first and then the chosen pages alone, so what it gets does not
    grow with the number of tasks. Rows with one hash are copies, of which any will do. The words
    are taken from the whole pages in the tasks, each once.
    """
    hashed = pages.where(F.col(html_col).isNotNull()).select(html_col, F.xxhash64(id_col, html_col).alias("h"))
    least = [r["h"] for r in hashed.select("h").orderBy("h").limit(limit).collect()]
    if not least:
        return []

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page in batch.column(0).to_pylist():
                found = {w for b in leaves(page) for w in b.text.split()}
                yield pa.record_batch([pa.array(sorted(found), pa.string())], ["word"])

    sample = hashed.where(F.col("h") <= max(least)).limit(limit).select(html_col)
    return sorted(r["word"] for r in sample.mapInArrow(words, "word string").distinct().collect())


def main_text(blocks: list[Leaf], scores: np.ndarray) -> str:
    return "\n\n".join(b.text for b, s in zip(blocks, scores) if s > 0)


def extract_main_text(pages: DataFrame, model: Labeller, id_col: str = "page_id", html_col: str = "html", carry: tuple[str, ...] = ("url",)) -> DataFrame:
    """(id, carried columns, text): the main text of every whole page; no shuffle.

    A null or empty page gives an empty text, as does one without main text. Blocks are joined
    in page order by an empty line. Rows and ids that repeat, and null ids, stay; other columns
    are not carried. ``text`` is extended by _ where the id or a carried column has that name.
    """
    inner = ["id", "html", *(f"c{i}" for i in range(len(carry)))]
    source = pages.select(F.col(id_col), F.col(html_col), *carry).toDF(*inner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html", 2 << 20):
                found = [leaves(p) for p in part.column("html").to_pylist()]
                scores = model.scores(featurize(found))
                ends = np.cumsum([len(b) for b in found])
                texts = [main_text(b, scores[e - len(b):e]) for b, e in zip(found, ends)]
                yield pa.record_batch([part.column("id"), *part.columns[2:], pa.array(texts, pa.string())], ["id", *inner[2:], "text"])

    fields = {f.name: f for f in source.schema.fields}
    schema = T.StructType([fields["id"], *(fields[c] for c in inner[2:]), T.StructField("text", T.StringType())])
    return source.mapInArrow(run, schema).toDF(id_col, *carry, fresh_name(pages.select(id_col, *carry), "text"))
