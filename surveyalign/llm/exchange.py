"""Questions from blocks of documents to slabs of a hash space, and the answers back.

Counting billions of hashes with one shuffled row each costs far more than the hashes. Here a
*block* is a run of whole documents of a few MB, stored compressed, and a *slab* is an equal
share of the hash space. Every block sends every slab one row: the sorted distinct hashes it
holds there, delta-coded. A slab sees each hash at most once per block, whatever a hash's
frequency, so no key is hot; it answers every block in the order of the question.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyalign.llm.common import give_back, materialize, slices

BLOCK_BYTES = 4 << 20

#: Hashes that one slab should get from all blocks together.
SLAB_ITEMS = 1_500_000

_PACK = pa.ipc.IpcWriteOptions(compression="zstd")


def pack_batch(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=_PACK) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack_batch(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


def to_blocks(df: DataFrame, text_at: int, size: Callable[[pa.RecordBatch], int], limit: int = BLOCK_BYTES) -> DataFrame:
    """Stored table (block, payload, items): whole rows of ``df`` in runs of about ``limit`` text bytes.

    ``items`` is what ``size`` says of the block. Written before use, so block numbers hold when
    a task is repeated. Columns are named by position inside the payload.
    """
    inner = [f"c{i}" for i in range(len(df.columns))]
    source = df.toDF(*inner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, inner[text_at], limit):
                yield pa.record_batch([pa.array([number], pa.int64()), pa.array([pack_batch(part)], pa.binary()), pa.array([size(part)], pa.int64())],
                                      ["block", "payload", "items"])
                number += 1
                del part
                give_back()

    return materialize(source.mapInArrow(run, "block long, payload binary, items long"), "blocks")


def per_block(work: Callable[..., Iterator[pa.RecordBatch]]):
    """For ``mapInArrow``: what ``work`` yields for the values of each row; a worker keeps nothing of a block that is done."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*batch.columns):
                yield from work(*row)
                give_back()
    return run


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted distinct unsigned 64-bit values as byte-wise variable-length gaps, byte planes apart."""
    if len(values) == 0:
        return b""
    gaps = values.copy()
    gaps[1:] = values[1:] - values[:-1]
    width = np.ones(len(gaps), np.uint8)
    for k in range(1, 8):
        width += gaps >= np.uint64(1 << (8 * k))
    out = [np.array([len(gaps)], "<i8").tobytes(), width.tobytes()]
    for k in range(int(width.max())):
        out.append(((gaps[width > k] >> np.uint64(8 * k)) & np.uint64(255)).astype(np.uint8).tobytes())
    return b"".join(out)


def unpack_sorted(packed: bytes) -> np.ndarray:
    if not packed:
        return np.zeros(0, np.uint64)
    n = int(np.frombuffer(packed, "<i8", 1)[0])
    width = np.frombuffer(packed, np.uint8, n, 8)
    gaps, at = np.zeros(n, np.uint64), 8 + n
    for k in range(int(width.max())):
        has = np.flatnonzero(width > k)
        gaps[has] |= np.frombuffer(packed, np.uint8, len(has), at).astype(np.uint64) << np.uint64(8 * k)
        at += len(has)
    return np.cumsum(gaps)


def slab_runs(values: np.ndarray, slabs: int, bits: int) -> list[tuple[int, int, int]]:
    """(slab, begin, end) of the runs of sorted ``values`` below 2 ** ``bits`` in equal shares of that space.

    Only slabs that hold a value are visited, however many there are.
    """
    slab = ((values >> np.uint64(max(bits - 32, 0))) * np.uint64(slabs)) >> np.uint64(min(bits, 32))
    begin = np.flatnonzero(np.concatenate([[True], slab[1:] != slab[:-1]])) if len(values) else np.zeros(0, np.int64)
    return list(zip(slab[begin].tolist(), begin.tolist(), np.append(begin[1:], len(values)).tolist()))


def slab_count(items: int, per_slab: int = SLAB_ITEMS) -> int:
    return max(1, -(-items // per_slab))


def answered(questions: DataFrame, answer: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """(block, answers): what each slab says to each block; ``answers`` lists (slab, reply).

    ``questions`` has one row (slab, block, asked) per pair; ``answer`` maps the questions of one
    slab to its replies, in order.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        give_back()
        return pd.DataFrame({"block": pdf["block"], "slab": pdf["slab"], "reply": answer(pdf["asked"].tolist())})

    replies = questions.groupBy("slab").applyInPandas(run, "block long, slab int, reply binary")
    return replies.groupBy("block").agg(F.collect_list(F.struct("slab", "reply")).alias("answers"))


def question_schema() -> T.StructType:
    return T.StructType([T.StructField("slab", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("asked", T.BinaryType())])


def in_order(answers) -> dict[int, bytes]:
    return {a["slab"]: a["reply"] for a in (answers or [])}
