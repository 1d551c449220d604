"""Removal of long repeated word runs by recompression.

Every document is a string of symbols, at first one per word. A round names maximal
runs of one symbol, then pairs of a left and a right symbol, where a symbol's side is a
bit of its name. A name is a 64-bit hash of what it stands for, so every task gives
equal content the same name and a round needs no exchange: equal substrings are cut
alike but for their rims. With each symbol goes its context, the words that settle how
it was cut.

Two exchanges follow, both over names packed per chunk of documents and dealt by value,
so a frequent name appears once per chunk. The first finds the symbols that occur
twice anywhere. A window that holds a symbol and its whole context cannot repeat
unless that symbol does, so only windows without such a lonely symbol remain. The second
exchange compares the names of those windows, built from pairs of pairs, and so
verifies each repeat. Chunks are shuffled once; texts never are.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlens.llm.pieces import CHUNK_CHARS, CHUNK_DOCUMENTS, bucket_count, cut_words, squeezed, unsqueezed

#: Rounds of recompression before names are compared: symbols of about three words, most of them with a context under 35.
ROUNDS = 4
RUN, PAIR, WINDOW = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))

PACKED = "chunk long, counts array<int>, numbers binary, words binary, lengths binary, rows binary"
ASKED = "bucket int, chunk long, names binary, twice binary"
REPLIED = "chunk long, stage int, bucket int, shared binary"


def mixed(a: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    a = (a ^ (a >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    a = (a ^ (a >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return a ^ (a >> np.uint64(31))


def named(kind: np.uint64, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mixed(mixed(left + kind) ^ (right * np.uint64(0xFF51AFD7ED558CCD) + kind))


class Symbols:
    """Symbols of a chunk: name, first word, end of the last word, and the context [low, high) in words."""

    def __init__(self, name, start, end, low, high, first):
        self.name, self.start, self.end, self.low, self.high, self.first = name, start, end, low, high, first

    @classmethod
    def of_words(cls, hashes: np.ndarray, first: np.ndarray) -> Symbols:
        at = np.arange(len(hashes), dtype=np.int32)
        return cls(hashes, at, at + 1, at, at + 1, first)

    def _neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """Contexts of the left and right neighbour; beyond the rim of a document no window reaches."""
        low = np.concatenate([[-1], self.low[:-1]]).astype(np.int32)
        low[self.first] = -(1 << 30)
        last = np.concatenate([self.first[1:], [True]])
        high = np.concatenate([self.high[1:], [0]]).astype(np.int32)
        high[last] = 1 << 30
        return low, high

    def runs(self) -> Symbols:
        if not len(self.name):
            return self
        begins = np.concatenate([[True], self.name[1:] != self.name[:-1]]) | self.first
        at = np.flatnonzero(begins)
        ends = np.concatenate([at[1:], [len(self.name)]]) - 1
        times = (ends - at + 1).astype(np.uint64)
        low, high = self._neighbours()
        name = self.name[at]
        name = np.where(times > 1, named(RUN, name, times), name)
        return Symbols(
            name, self.start[at], self.end[ends], np.minimum(self.low[at], low[at]), np.maximum(self.high[ends], high[ends]),
            self.first[at])

    def pairs(self, round_: int) -> Symbols:
        if not len(self.name):
            return self
        right = (mixed(self.name + np.uint64(int(PAIR) * (round_ + 1) % (1 << 64))) & np.uint64(1)).astype(bool)
        joins = np.zeros(len(right), bool)  # this symbol and the next become one
        joins[:-1] = ~right[:-1] & right[1:] & ~self.first[1:]
        taken = np.concatenate([[False], joins[:-1]])
        low, high = self._neighbours()
        # a left symbol is settled by the next one, a right symbol by the one before
        low = np.where(right, np.minimum(self.low, low), self.low)
        high = np.where(right, self.high, np.maximum(self.high, high))
        at = np.flatnonzero(~taken)
        two = joins[at]
        to = np.minimum(at + 1, len(right) - 1)
        return Symbols(
            np.where(two, named(PAIR, self.name[at], self.name[to]), self.name[at]),
            self.start[at], np.where(two, self.end[to], self.end[at]),
            low[at], np.where(two, self.high[to], high[at]), self.first[at])


def recompressed(hashes: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> Symbols:
    symbols = Symbols.of_words(hashes, first)
    for i in range(rounds):
        symbols = symbols.runs().pairs(i)
    return symbols


def window_names(hashes: np.ndarray, width: int) -> np.ndarray:
    """The name of the ``width`` words from each word on, by doubling; names that run over the end are cut off."""
    power, size, total, covered = hashes, 1, None, 0
    while True:
        if width & size:
            if total is None:
                total, covered = power, size
            else:
                n = len(power) - covered
                total = named(WINDOW, total[:max(n, 0)], power[covered:]) if n > 0 else hashes[:0]
                covered += size
        if 2 * size > width:
            return total
        n = len(power) - size
        power = named(WINDOW, power[:max(n, 0)], power[size:]) if n > 0 else hashes[:0]
        size *= 2


class Chunk:
    """One packed row, unpacked."""

    def __init__(self, row: dict):
        import xxhash

        self.row = row
        lengths = np.frombuffer(row["lengths"], np.uint32)
        self.words = cut_words(zlib.decompress(row["words"]), lengths)
        self.numbers = unsqueezed(row["numbers"], np.uint32)
        self.counts = np.array(row["counts"], np.int64)
        hashed = np.fromiter((xxhash.xxh64_intdigest(w) for w in self.words), np.uint64, len(self.words))
        self.hashes = hashed[self.numbers]
        self.ends = np.cumsum(self.counts)
        self.first = np.zeros(len(self.numbers), bool)
        self.first[(self.ends - self.counts)[self.counts > 0]] = True

    def symbols(self, width: int) -> Symbols:
        """The symbols that some window can hold with their context."""
        s = recompressed(self.hashes, self.first)
        fits = (s.low >= 0) & (s.high - s.low <= width) & (s.high <= len(self.hashes))
        return Symbols(s.name[fits], s.start[fits], s.end[fits], s.low[fits], s.high[fits], s.first[fits])

    def candidates(self, symbols: Symbols, shared: np.ndarray, width: int) -> np.ndarray:
        """Starts of windows in one document that hold no symbol of which there is only one."""
        n = len(self.hashes)
        out = np.zeros(n + 1, np.int32)
        lonely = ~shared
        np.add.at(out, np.maximum(symbols.high[lonely].astype(np.int64) - width, 0), 1)
        np.add.at(out, symbols.low[lonely].astype(np.int64) + 1, -1)
        free = np.cumsum(out[:n]) == 0
        for_doc = np.repeat(self.ends, self.counts)
        return np.flatnonzero(free & (np.arange(n) + width <= for_doc))


class Names:
    """Distinct names of a chunk, dealt to buckets by their leading bits."""

    def __init__(self, names: np.ndarray, n_buckets: int):
        self.distinct, self.place, times = np.unique(names, return_inverse=True, return_counts=True)
        self.twice = times > 1
        bounds = np.array([(b << 64) // n_buckets for b in range(1, n_buckets)], np.uint64)
        self.cuts = np.concatenate([[0], np.searchsorted(self.distinct, bounds), [len(self.distinct)]])

    def asked(self, chunk: int) -> list[dict]:
        return [
            {"bucket": b, "chunk": chunk, "names": self.distinct[i:j].tobytes(), "twice": np.packbits(self.twice[i:j]).tobytes()}
            for b, (i, j) in enumerate(zip(self.cuts[:-1].tolist(), self.cuts[1:].tolist(), strict=True)) if i < j
        ]

    def shared(self, replies: dict[int, bytes]) -> np.ndarray:
        """For every name handed in: does it occur twice anywhere?"""
        found = np.zeros(len(self.distinct), bool)
        wanted = [b for b in range(len(self.cuts) - 1) if self.cuts[b] < self.cuts[b + 1]]
        if sorted(replies) != wanted:
            raise RuntimeError("the replies belong to another run of this chunk")
        for b in wanted:
            i, j = self.cuts[b], self.cuts[b + 1]
            found[i:j] = np.unpackbits(np.frombuffer(replies[b], np.uint8))[:j - i].astype(bool)
        return found[self.place]


_ASKED = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("names", pa.binary()), ("twice", pa.binary())])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (text last) to chunks. The other columns travel along as they are."""
    schema = pa.schema([("chunk", pa.int64()), ("counts", pa.list_(pa.int32())), ("numbers", pa.binary()),
                        ("words", pa.binary()), ("lengths", pa.binary()), ("rows", pa.binary())])
    task, seq = TaskContext.get().partitionId(), 0

    def close(rows: list[pa.RecordBatch], counts: list[int], numbers: list[np.ndarray], local: dict[bytes, int]) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            for part in rows:
                writer.write_batch(part)
        words, kept = b"".join(local), sink.getvalue().to_pybytes()
        body = squeezed(np.concatenate(numbers))
        mark = zlib.crc32(body, zlib.crc32(kept))
        return pa.RecordBatch.from_pylist([{
            "chunk": (((task * 4096 + seq) & 0x7FFFFFFF) << 32) | mark, "counts": counts, "numbers": body,
            "words": zlib.compress(words, 1), "lengths": np.fromiter(map(len, local), np.uint32, len(local)).tobytes(),
            "rows": kept}], schema=schema)

    rows, counts, numbers, local, chars, n = [], [], [], {}, 0, 0
    for batch in batches:
        begin = 0
        for at, text in enumerate(batch.column(batch.num_columns - 1)):
            coded = (text.as_py() or "").encode()
            found = np.fromiter((local.setdefault(w, len(local)) for w in coded.split()), np.uint32)
            counts.append(len(found))
            numbers.append(found)
            chars, n = chars + len(coded), n + 1
            if chars >= CHUNK_CHARS or n >= CHUNK_DOCUMENTS:
                rows.append(batch.slice(begin, at + 1 - begin))
                begin = at + 1
                yield close(_travelling(rows), counts, numbers, local)
                rows, counts, numbers, local, chars, n, seq = [], [], [], {}, 0, 0, seq + 1
        if begin < batch.num_rows:
            rows.append(batch.slice(begin))
    if n:
        yield close(_travelling(rows), counts, numbers, local)


def _travelling(rows: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    """Without the copy of the text that was only there to be cut into words."""
    return [r.select(range(r.num_columns - 1)) for r in rows]


def _compare(stage: int):
    schema = pa.schema([("chunk", pa.int64()), ("stage", pa.int32()), ("bucket", pa.int32()), ("shared", pa.binary())])

    def run(asked: pa.Table) -> pa.Table:
        rows = asked.to_pylist()
        names = [np.frombuffer(r["names"], np.uint64) for r in rows]
        sizes = [len(x) for x in names]
        twice = np.concatenate([np.unpackbits(np.frombuffer(r["twice"], np.uint8))[:n] for r, n in zip(rows, sizes, strict=True)])
        _, place, times = np.unique(np.concatenate(names), return_inverse=True, return_counts=True)
        times[place[twice.astype(bool)]] = 2
        shared, out, at = times[place] > 1, [], 0
        for row, n in zip(rows, sizes, strict=True):
            out.append({"chunk": row["chunk"], "stage": stage, "bucket": row["bucket"],
                        "shared": np.packbits(shared[at:at + n]).tobytes()})
            at += n
        return pa.Table.from_pylist(out, schema=schema)

    return run


def _replies(table: pa.Table, stage: int) -> dict[int, bytes]:
    return {r["bucket"]: r["shared"] for r in table.to_pylist() if r["stage"] == stage}


def repeated_words(docs: DataFrame, finish, schema: str, columns: list[str], width: int = 35) -> DataFrame:
    """Per chunk ``finish(rows, chunk, removed)``: the travelling columns, the words, and a flag per word to be removed.

    A word is removed if a window of ``width`` words that covers it also starts anywhere else.
    """
    n_buckets = bucket_count(docs)
    packed = docs.select(*columns, F.col("text").alias("__cut")).mapInArrow(_pack, PACKED).repartition("chunk")

    def ask_symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                names = Names(Chunk(row).symbols(width).name, n_buckets)
                yield pa.RecordBatch.from_pylist(names.asked(row["chunk"]), schema=_ASKED)

    def windows_of(row: dict, replies: pa.Table) -> tuple[Chunk, np.ndarray, Names]:
        chunk = Chunk(row)
        symbols = chunk.symbols(width)
        shared = Names(symbols.name, n_buckets).shared(_replies(replies, 1))
        starts = chunk.candidates(symbols, shared, width)
        return chunk, starts, Names(window_names(chunk.hashes, width)[starts], n_buckets)

    def ask_windows(rows: pa.Table, replies: pa.Table) -> pa.Table:
        return pa.concat_tables([
            pa.Table.from_pylist(windows_of(row, replies)[2].asked(row["chunk"]), schema=_ASKED) for row in rows.to_pylist()])

    def end(rows: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        for row in rows.to_pylist():
            chunk, starts, names = windows_of(row, replies)
            hit = starts[names.shared(_replies(replies, 2))]
            cover = np.zeros(len(chunk.hashes) + 1, np.int32)
            cover[hit] += 1
            np.add.at(cover, hit + width, -1)
            removed = np.cumsum(cover[:-1]) > 0
            travelled = pa.ipc.open_stream(row["rows"]).read_all()
            out.append(finish(travelled, chunk, removed))
        return pa.concat_tables(out)

    first = packed.mapInArrow(ask_symbols, ASKED).groupBy("bucket").applyInArrow(_compare(1), REPLIED)
    second = (
        packed.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInArrow(ask_windows, ASKED)
        .groupBy("bucket").applyInArrow(_compare(2), REPLIED)
    )
    return packed.groupBy("chunk").cogroup(first.unionByName(second).groupBy("chunk")).applyInArrow(end, schema)


def _kept(chunk: Chunk, removed: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(words, removed words, kept words joined by one space) of each document."""
    at = 0
    for n in chunk.counts.tolist():
        numbers, gone = chunk.numbers[at:at + n], removed[at:at + n]
        at += n
        yield n, int(gone.sum()), b" ".join([chunk.words[i] for i in numbers[~gone].tolist()])


def kept_digests(docs: DataFrame, width: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document.

    A null text has no words; documents shorter than a window keep everything; all copies
    of a repeat go, the first too; rows with equal or null ids stay separate rows; other
    columns are ignored; an empty table gives no rows.
    """

    def finish(rows: pa.Table, chunk: Chunk, removed: np.ndarray) -> pa.Table:
        found = [(n, gone, hashlib.sha256(kept).hexdigest()) for n, gone, kept in _kept(chunk, removed)]
        return pa.table({
            "doc_id": rows.column("doc_id"), "n_words": pa.array([x[0] for x in found], pa.int64()),
            "n_removed": pa.array([x[1] for x in found], pa.int64()), "kept_sha256": pa.array([x[2] for x in found], pa.string())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return repeated_words(
        docs, finish, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string", ["doc_id"], width)


def without_repeats(docs: DataFrame, width: int = 35) -> DataFrame:
    """``docs`` with the repeated words cut out of ``text`` and ``n_chars`` counted anew; untouched texts stay as they are."""

    def finish(rows: pa.Table, chunk: Chunk, removed: np.ndarray) -> pa.Table:
        texts = [
            kept.decode() if gone else old
            for (_, gone, kept), old in zip(_kept(chunk, removed), rows.column("text").to_pylist(), strict=True)]
        rows = rows.set_column(rows.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
        if "n_chars" in rows.column_names:
            sizes = pa.array([None if t is None else len(t) for t in texts], rows.schema.field("n_chars").type)
            rows = rows.set_column(rows.schema.get_field_index("n_chars"), "n_chars", sizes)
        return rows

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return repeated_words(docs, finish, schema, docs.columns, width)
