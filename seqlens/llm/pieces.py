"""Pre-tokens of documents, exchanged once per chunk of documents.

A chunk is a run of documents of one task, packed into one row: the sequence of its
pre-tokens as numbers, and the distinct ones that the vocabulary does not hold as a
list, dealt into buckets by hash. Chunks are shuffled once. The buckets of all chunks
meet, so each distinct pre-token of the corpus is worked on once; the answers return
to the chunk as one short array per bucket. Texts are never shuffled, a frequent
pre-token appears once per chunk, and a chunk holds a bounded number of characters
(or one document).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters and documents after which a chunk is closed.
CHUNK_CHARS = 4_000_000
CHUNK_DOCUMENTS = 20_000

PACKED = ("chunk long, ids array<long>, counts array<long>, bytes array<long>, "
          "numbers binary, words binary, lengths binary, buckets array<int>")
ASKED = "bucket int, chunk long, words binary, lengths binary"
ANSWERED = "chunk long, bucket int, lengths binary, answers binary"


def pressed(b: bytes) -> bytes:
    """Compressed, with the full size in front."""
    return len(b).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(b, asbytes=True)


def unpressed(b: bytes) -> bytes:
    return pa.Codec("zstd").decompress(b[8:], int.from_bytes(b[:8], "little"), asbytes=True)


def squeezed(a: np.ndarray) -> bytes:
    """The bytes of an integer array, byte planes apart, compressed."""
    return pressed(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes())


def unsqueezed(b: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(unpressed(b), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def cut_words(words: bytes, lengths: np.ndarray) -> list[bytes]:
    ends = np.cumsum(lengths).tolist()
    return [words[e - n:e] for e, n in zip(ends, lengths.tolist(), strict=True)]


def _close(task: int, seq: int, ids, counts, sizes, numbers: list[np.ndarray], local: dict[str, int], n_buckets: int, step: int):
    """One packed row. Every ``step``-th number is a pre-token: below 2**16 the vocabulary's, else its place in ``local``."""
    coded = [w.encode() for w in local]
    bucket = np.fromiter((zlib.crc32(w) % n_buckets for w in coded), np.int32, len(coded))
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(coded), np.uint32)
    place[order] = np.arange(len(coded), dtype=np.uint32)
    flat = np.concatenate(numbers) if numbers else np.empty(0, np.uint32)
    named = flat[::step]
    high = named >= 65536
    named[high] = place[named[high] - 65536] + 65536
    words = b"".join(coded[i] for i in order.tolist())
    lengths = np.fromiter((len(coded[i]) for i in order.tolist()), np.uint32, len(coded))
    body = squeezed(flat)
    # an own number for what the chunk holds: a lost task that is run again over other rows cannot be taken for this one
    mark = zlib.crc32(body, zlib.crc32(words)) ^ zlib.crc32(repr(ids[:50]).encode())
    return {
        "chunk": (((task * 4096 + seq) & 0x7FFFFFFF) << 32) | mark, "ids": ids, "counts": counts, "bytes": sizes, "numbers": body,
        "words": pressed(words), "lengths": squeezed(lengths),
        "buckets": np.bincount(bucket, minlength=n_buckets).astype(np.int32).tolist(),
    }


_ROW = pa.schema([
    ("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("bytes", pa.list_(pa.int64())),
    ("numbers", pa.binary()), ("words", pa.binary()), ("lengths", pa.binary()), ("buckets", pa.list_(pa.int32())),
])


def pack(known: Callable[[], dict[str, int]], split: Callable[[], Callable[[str], list]], n_buckets: int, tally: bool):
    """A function for ``mapInArrow`` over (doc_id, text).

    known: the vocabulary's own number of a pre-token. split: the pre-tokens of a text.
    tally: keep (number, frequency) pairs per document instead of its sequence.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, cut, task, seq = known(), split(), TaskContext.get().partitionId(), 0
        ids, counts, sizes, numbers, local, chars = [], [], [], [], {}, 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py() or ""
                found = np.fromiter(
                    (n if (n := vocabulary.get(w)) is not None else 65536 + local.setdefault(w, len(local)) for w in cut(text)),
                    np.uint32)
                if tally:
                    found, times = np.unique(found, return_counts=True)
                    found = np.stack([found, times.astype(np.uint32)], axis=1).ravel()
                ids.append(doc_id.as_py())
                counts.append(len(found))
                sizes.append(len(text.encode()))
                numbers.append(found)
                chars += len(text)
                if chars >= CHUNK_CHARS or len(ids) >= CHUNK_DOCUMENTS:
                    yield pa.RecordBatch.from_pylist(
                        [_close(task, seq, ids, counts, sizes, numbers, local, n_buckets, 1 + tally)], schema=_ROW)
                    ids, counts, sizes, numbers, local, chars, seq = [], [], [], [], {}, 0, seq + 1
        if ids:
            yield pa.RecordBatch.from_pylist([_close(task, seq, ids, counts, sizes, numbers, local, n_buckets, 1 + tally)], schema=_ROW)

    return run


def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed rows to one row per bucket with words in it."""
    schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("words", pa.binary()), ("lengths", pa.binary())])
    for batch in batches:
        for row in range(batch.num_rows):
            chunk = batch.column(0)[row].as_py()
            words = unpressed(batch.column(5)[row].as_py())
            lengths = unsqueezed(batch.column(6)[row].as_py(), np.uint32)
            ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
            out, at = [], 0
            for bucket, n in enumerate(batch.column(7)[row].as_py()):
                if n:
                    out.append({"bucket": bucket, "chunk": chunk, "words": pressed(words[ends[at]:ends[at + n]]),
                                "lengths": squeezed(lengths[at:at + n])})
                at += n
            yield pa.RecordBatch.from_pylist(out, schema=schema)


def answer(work: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]):
    """A function for ``applyInArrow`` over one bucket: ``work`` sees each distinct word once.

    ``work`` gives the answer's length per word and all answers in a row.
    """
    schema = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("lengths", pa.binary()), ("answers", pa.binary())])

    def run(asked: pa.Table) -> pa.Table:
        asked = asked.combine_chunks()
        place: dict[bytes, int] = {}
        rows = []
        for row in asked.to_batches():
            for i in range(row.num_rows):
                words = cut_words(unpressed(row.column(2)[i].as_py()), unsqueezed(row.column(3)[i].as_py(), np.uint32))
                rows.append((row.column(1)[i].as_py(), row.column(0)[i].as_py(),
                             np.fromiter((place.setdefault(w, len(place)) for w in words), np.int64, len(words))))
        lengths, answers = work(list(place))
        starts = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])[:-1]
        out = []
        for chunk, bucket, found in rows:
            took = lengths[found]
            out.append({"chunk": chunk, "bucket": bucket, "lengths": squeezed(took.astype(np.uint32)),
                        "answers": squeezed(answers[gather(starts[found], took)].astype(np.uint32))})
        return pa.Table.from_pylist(out, schema=schema)

    return run


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of the slices [start, start + length) one after another."""
    ends = np.cumsum(lengths, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - (ends - lengths), lengths)


def answers_of(packed: dict, replies: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, answers) in the order of the chunk's own list of words."""
    wanted = [b for b, n in enumerate(packed["buckets"]) if n]
    got = {r["bucket"]: r for r in replies.to_pylist()}
    if sorted(got) != wanted:
        raise RuntimeError("the replies belong to another run of this chunk")
    lengths = [unsqueezed(got[b]["lengths"], np.uint32) for b in wanted]
    answers = [unsqueezed(got[b]["answers"], np.uint32) for b in wanted]
    none = [np.empty(0, np.uint32)]
    return np.concatenate(lengths or none).astype(np.int64), np.concatenate(answers or none)


def bucket_count(docs: DataFrame) -> int:
    """Buckets in proportion to the input: one for each 24 MB that Spark expects to read, or 10,000 rows where it cannot tell; 32 at least."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(32, size // 24_000_000 if size < 1 << 53 else docs.count() // 10_000)


def exchanged(docs: DataFrame, packer, work, finish, schema: str) -> DataFrame:
    """The whole exchange: pack, ask, answer, and ``finish(packed, replies)`` per chunk."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    # both uses read all columns, so Spark shuffles the chunks once and reuses the exchange
    packed = rows.mapInArrow(packer, PACKED).repartition("chunk")
    replies = packed.mapInArrow(ask, ASKED).groupBy("bucket").applyInArrow(answer(work), ANSWERED)
    return packed.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(finish, schema)
