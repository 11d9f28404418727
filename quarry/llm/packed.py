"""Texts packed into chunks, and exchanges of hashes between chunks.

``pack`` writes a table with one row a chunk of about ``CHUNK`` bytes of whole texts. Later steps read a chunk's
texts again, together with the answers to what it asked. A chunk asks about each distinct hash once, so however
often a passage occurs, it costs a few bytes for each chunk that has it. Questions about the hashes of one bucket
are one blob a chunk; answers are bits in the order of the questions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import freed, partitions, staged
from .textnum import U, column_bytes, slices

CHUNK = 2 << 20
#: About so many hashes meet in a bucket.
BUCKET = 2_000_000
NO_ID = -(1 << 63)
#: Texts are compressed well: each step moves the packed table once.
LEVEL = 3
SCHEMA = "chunk long, ids array<long>, ends binary, size long, data binary"
ANSWERS = "chunk long, step int, bucket int, bits binary"


def pack(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, off = column_bytes(batch.column(1))
            for i, j in slices(off, CHUNK):
                part = data[off[i] : off[j]].tobytes()
                ids = pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), batch.column(0).slice(i, j - i).combine_chunks() if isinstance(batch.column(0), pa.ChunkedArray) else batch.column(0).slice(i, j - i))
                blob = pa.Codec("zstd", compression_level=LEVEL).compress(part, asbytes=True) if part else b""
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), ids, pa.array([(off[i + 1 : j + 1] - off[i]).astype(np.int64).tobytes()]), pa.array([len(part)], pa.int64()), pa.array([blob])], ["chunk", "ids", "ends", "size", "data"])
                number += 1

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return staged(texts.mapInArrow(rows, SCHEMA), "packed")


class Chunk:
    """The texts of one row of the packed table."""

    def __init__(self, row: dict):
        self.number = row["chunk"]
        self.raw_ids = row["ids"]
        self.ids = np.array([NO_ID if x is None else x for x in row["ids"]], np.int64)
        self.offsets = np.concatenate(([0], np.frombuffer(row["ends"], np.int64)))
        self.data = np.frombuffer(pa.decompress(row["data"], row["size"], codec="zstd", asbytes=True) if row["size"] else b"", np.uint8)


def bucket_count(spark: SparkSession, hashes: int) -> int:
    return max(4 * partitions(spark), -(-hashes // BUCKET))


def questions(chunk: int, hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For distinct hashes in order: the order in which they are asked, the buckets that have any, and where each begins."""
    return dealt_to((hashes % U(buckets)).astype(np.int64))


def fingerprint(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The 32 bits of a hash that are asked about: with the bucket, as many more as there are buckets."""
    return (hashes // U(buckets)).astype(np.uint32)


def asked(chunk: int, hashes: np.ndarray, columns: dict[str, np.ndarray], buckets: int) -> pa.RecordBatch:
    """Rows (bucket, chunk, one blob a column) for distinct hashes."""
    order, which, ends = questions(chunk, hashes, buckets)
    arrays = [pa.array(which.astype(np.int32)), pa.array(np.full(len(which), chunk, np.int64))]
    for values in columns.values():
        v = values[order]
        arrays.append(pa.array([v[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, ["bucket", "chunk", *columns])


def answered(chunk: int, hashes: np.ndarray, answers: dict[tuple[int, int], bytes], step: int, buckets: int, kind: type = np.bool_) -> np.ndarray:
    """The answers for distinct hashes, in their order."""
    order, which, ends = questions(chunk, hashes, buckets)
    out = np.zeros(len(hashes), kind)
    for b, i, j in zip(which.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        blob = np.frombuffer(answers[step, b], np.uint8)
        out[order[i:j]] = np.unpackbits(blob, count=j - i).astype(bool) if kind is np.bool_ else blob.view(kind)
    return out


def asked_blobs(chunk: int, arrays: list[list], names: list[str]) -> pa.RecordBatch:
    """Rows (bucket, chunk, blobs) of lists that hold one entry a bucket."""
    n = len(arrays[0])
    return pa.RecordBatch.from_arrays([pa.array(arrays[0], pa.int32()), pa.array([chunk] * n, pa.int64()), *[pa.array(x, pa.binary()) for x in arrays[1:]]], ["bucket", "chunk", *names])


def dealt_to(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of things by their bucket, the buckets that have any, and where each begins."""
    few = bucket.max(initial=0) < 1 << 16
    order = np.argsort(bucket.astype(np.uint16) if few else bucket, kind="stable")  # numbers of 16 bits by radix
    s = bucket[order]
    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)
    return order, s[first], np.append(first, len(s))


def read_answers(dealt: tuple[np.ndarray, np.ndarray, np.ndarray], answers: dict, step: int, kind: type, base: int = 0) -> np.ndarray:
    """The answers to things dealt, in the order of the things; ``base`` is added to their buckets' numbers."""
    order, which, ends = dealt
    out = np.zeros(len(order), kind)
    for b, i, j in zip(which.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        out[order[i:j]] = np.frombuffer(answers[step, b + base], kind)
    return out


def squeezed(blob: np.ndarray) -> bytes:
    """Bytes of texts, compressed."""
    return len(blob).to_bytes(4, "little") + pa.compress(blob, codec="zstd", asbytes=True) if len(blob) else b""


def loose(blob: bytes | None) -> bytes:
    """What ``squeezed`` was given."""
    return pa.decompress(blob[4:], int.from_bytes(blob[:4], "little"), codec="zstd", asbytes=True) if blob else b""


def places(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The places that some runs cover, one run after another."""
    return np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))


def same_bytes(data: np.ndarray, i: np.ndarray, j: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Whether runs of ``lens`` bytes (one at least) that begin at ``i`` and at ``j`` are equal, byte by byte."""
    out = np.ones(len(lens), bool)
    for n in range(0, len(lens), 1 << 14):
        some = slice(n, n + (1 << 14))
        differs = data[places(i[some], lens[some])] != data[places(j[some], lens[some])]
        out[some] = ~np.logical_or.reduceat(differs, np.cumsum(lens[some]) - lens[some]) if len(differs) else True
    return out


def classes(keys: list[np.ndarray], data: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The class of each run of ``data``, which holds them one after another: equal keys, and equal bytes, as is verified."""
    begin = np.cumsum(lens) - lens
    order = np.lexsort((lens, *keys))
    opens = np.ones(len(order), bool)
    opens[1:] = lens[order][1:] != lens[order][:-1]
    for k in keys:
        opens[1:] |= k[order][1:] != k[order][:-1]
    near = np.flatnonzero(~opens)
    if not same_bytes(data, begin[order[near - 1]], begin[order[near]], lens[order[near]]).all():  # keys deceived
        raw, numbers = data.tobytes(), {}
        whole = zip(begin.tolist(), lens.tolist(), *[k.tolist() for k in keys], strict=True)
        return np.array([numbers.setdefault((raw[b : b + n], *k), len(numbers)) for b, n, *k in whole], np.int64)
    out = np.zeros(len(order), np.int64)
    out[order] = np.cumsum(opens) - 1
    return out


def answer_rows(step: int, bucket: int, chunks: list[int], lengths: list[int], values: np.ndarray) -> pa.RecordBatch:
    """Split ``values`` (bits or numbers for all questions of a bucket) by the chunks that asked."""
    ends = np.cumsum([0, *lengths])
    bits = [(np.packbits(values[a:b]) if values.dtype == np.bool_ else values[a:b]).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
    n = len(chunks)
    return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array([step] * n, pa.int32()), pa.array([bucket] * n, pa.int32()), pa.array(bits, pa.binary())], ["chunk", "step", "bucket", "bits"])


def ask(packed: DataFrame, answers: DataFrame | None, question: Callable[[Chunk, dict], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply ``question`` to every chunk, with the answers that it has got so far."""
    if answers is None:

        def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(len(batch)):
                    out = question(Chunk(batch.slice(i, 1).to_pylist()[0]), {})
                    if out is not None:
                        yield out

        return packed.mapInArrow(alone, schema)

    def both(texts: pa.Table, replies: pa.Table) -> pa.Table:
        got = dict(zip(zip(replies.column("step").to_pylist(), replies.column("bucket").to_pylist(), strict=True), replies.column("bits").to_pylist(), strict=True))
        outs = [x for i in range(len(texts)) if (x := question(Chunk(texts.slice(i, 1).to_pylist()[0]), got)) is not None]
        return pa.Table.from_batches(outs) if outs else empty

    empty = _empty(schema)
    return packed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(both, schema)


def _empty(schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    return pa.table({name: pa.array([], kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))})


def meet(asked_rows: DataFrame, step: int, decide: Callable[[list[dict]], tuple[list[int], np.ndarray]]) -> DataFrame:
    """Bring the questions of each bucket together; ``decide`` gives their lengths and the answers."""

    def bucket(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        lengths, values = decide(rows)
        return pa.Table.from_batches([answer_rows(step, rows[0]["bucket"], [r["chunk"] for r in rows], lengths, values)])

    with freed(asked_rows.sparkSession):
        return staged(asked_rows.groupBy("bucket").applyInArrow(bucket, ANSWERS), f"answers-{step}")
