"""Alignment of two tokenizers' tokens over the bytes of the same text.

Texts are cut into units, before spaces where both tokenizers surely cut too; a task encodes a unit once while it remembers it.
Runs of units are lanes of a bounded length. All lanes of a batch are merged in lockstep: one state vector holds every lane's place in both token sequences, a step
links the two tokens there, moves on whichever ends first, or both at a shared end, and finished lanes are taken out.

Counts of linked id pairs take two passes without the texts: a chunk of documents keeps which
pairs each document links; the distinct pairs of all chunks are counted, and the counts return to the chunks that
hold the pair.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlens.llm.common import cut_lineage
from seqlens.llm.pieces import gather, squeezed, unsqueezed
from seqlens.llm.token_counts import FIRST_DOUBTFUL, SPLIT, byte_of_char

#: Bytes of a lane, about, characters merged at a time, and characters and documents of a chunk.
LANE_BYTES, MERGE_CHARS, CHUNK_CHARS, CHUNK_DOCUMENTS = 1_000, 1_000_000, 4_000_000, 20_000
#: Units whose tokens a task keeps.
MOST_UNITS = 300_000
_PACKED = ("chunk long, ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, shas array<string>, "
           "held array<long>, pairs binary, documents binary, places binary, times binary")


class _Numbers(dict):
    """Numbers of units, given as they come."""

    def __missing__(self, unit: str) -> int:
        self[unit] = n = len(self)
        return n


#: Units that may stand in a row without changing each other's tokens, and hold only characters of which all tables of classes agree.
_PLAIN = re.compile(rf"[A-Za-z](?:[\0-{chr(ord(FIRST_DOUBTFUL) - 1)}]*[^\s{FIRST_DOUBTFUL}-\U0010ffff])?")


class Alignment:
    """Two tokenizers and their tokens' bytes."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        chars = byte_of_char()
        with open(path_a, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary = model["vocab"]
        size = max(self.a.get_vocab().values()) + 1
        self.bytes_a = [b""] * size
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(chars[c] for c in token) if all(c in chars for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.len_a, self.len_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        self.n_a = size
        #: A's tokens end with a comma or, as the last of a group, a bar; B's with a comma or a semicolon
        self.names = [f"{i}{end}" for n, ends in ((size, ",|"), (len(pieces), ",;")) for end in ends for i in range(n)]
        # pieces that go on over a space would make a cut before a space unsure
        sure = not any("▁" in p.lstrip("▁") for p in pieces)
        self.cut = re.compile(r"(?<=\S) (?=[A-Za-z])" if sure else r"(?!)")
        # where the merges' order is that of the ids, the faster library gives the same ids for characters that both know
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        self.fast = None
        if all(vocabulary[m] == 256 + i for i, m in enumerate(merged)):
            import tiktoken

            ranks = {t: i for i, t in enumerate(self.bytes_a[:256 + len(merged)])}
            self.fast = tiktoken.Encoding("units", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.clear()

    def clear(self) -> None:
        """Forget all units."""
        self.numbers = _Numbers()
        self.tokens = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.sizes = np.zeros((0, 4), np.int64)  # tokens of A and of B, bytes, and whether the tokens' bytes are the unit's

    def first_tokens(self, units: list[str]) -> list[list[int]]:
        """A's ids of a space and each unit."""
        plain = [self.fast is not None and _PLAIN.fullmatch(u) is not None for u in units]
        row = [u for u, p in zip(units, plain, strict=True) if p]
        ids = self.fast.encode_ordinary(" " + " ".join(row)) if row else []
        ends = np.cumsum(self.len_a[ids]) if ids else np.zeros(0, np.int64)
        stops = np.searchsorted(ends, np.cumsum([len(u.encode()) + 1 for u in row]), "right").tolist()
        others = iter([e.ids for e in self.a.encode_batch([" " + u for u, p in zip(units, plain, strict=True) if not p], add_special_tokens=False)])
        at = iter(zip([0, *stops], stops))
        return [ids[slice(*next(at))] if p else next(others) for p in plain]

    def numbered(self, texts: list[str]) -> list[np.ndarray]:
        """Numbers of each text's units, which are parts that both tokenizers surely encode by themselves: ``text`` with its leading space,
        cut before spaces between other than white space and an ASCII letter."""
        if len(self.numbers) > MOST_UNITS:
            self.clear()
        known = len(self.numbers)
        out = [np.array(list(map(self.numbers.__getitem__, self.cut.split(t))) if t else [], np.int64) for t in texts]
        new = list(islice(self.numbers, known, None))
        if new:
            first = self.first_tokens(new)
            second = self.b.encode(new, num_threads=1)
            sizes = []
            for unit, a, b in zip(new, first, second, strict=True):
                own = b" " + unit.encode()
                same = b"".join(map(self.bytes_a.__getitem__, a)) == own and b"".join(map(self.bytes_b.__getitem__, b)) == own
                sizes.append((len(a), len(b), len(own), same))
            flat = [np.fromiter(chain.from_iterable(x), np.int64) for x in (first, second)]
            self.tokens = tuple(np.concatenate(x) for x in zip(self.tokens, flat, strict=True))
            self.sizes = np.concatenate([self.sizes, np.array(sizes, np.int64)])
        return out


@lru_cache(maxsize=1)
def alignment(path_a: str, path_b: str) -> Alignment:
    return Alignment(path_a, path_b)


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray, stop_a: np.ndarray):
    """(places in A, places in B, shared end) of every link of all lanes, in order.

    ends_a, ends_b: where each token ends in its lane; a lane has A's tokens from first_a to stop_a and B's from first_b on.
    """
    left = np.flatnonzero(first_a < stop_a)
    a, b, stop = first_a[left], first_b[left], stop_a[left]
    links = []
    while len(a):
        x, y = ends_a[a], ends_b[b]
        links.append((a, b, x == y))
        a, b = a + (x <= y), b + (y <= x)
        if (a >= stop).any():
            on = a < stop
            a, b, stop = a[on], b[on], stop[on]
    if not links:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    a, b, cut = (np.concatenate(x) for x in zip(*links, strict=True))
    order = np.argsort(a + b)
    return a[order], b[order], cut[order]


def ends_of(lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Running sums of the lengths, beginning anew for every lane of ``counts`` tokens."""
    total = np.concatenate([[0], np.cumsum(lengths)])
    return total[1:] - np.repeat(total[np.cumsum(counts) - counts], counts)


def aligned(tool: Alignment, texts: list[str]) -> tuple[list[dict], np.ndarray, np.ndarray]:
    """Per text n_a, n_b, n_groups and ``groups``; and over all links the text's number and the id pair (A's times 2**32 plus B's)."""
    numbers = tool.numbered(texts)
    text_of = np.repeat(np.arange(len(texts)), [len(n) for n in numbers])
    units = np.concatenate([*numbers, np.zeros(0, np.int64)])
    (all_a, all_b), sizes = tool.tokens, tool.sizes
    whole = np.ones(len(texts), bool)
    whole[text_of[sizes[units, 3] == 0]] = False
    units, text_of = units[whole[text_of]], text_of[whole[text_of]]
    took_a, took_b, took = sizes[units, 0], sizes[units, 1], sizes[units, 2]
    starts = np.cumsum(sizes[:, :2], axis=0) - sizes[:, :2]
    ids_a, ids_b = all_a[gather(starts[units, 0], took_a)], all_b[gather(starts[units, 1], took_b)]
    # a lane is a run of units of one text
    before = np.cumsum(took) - took
    first = np.searchsorted(text_of, text_of)
    place = (before - before[first]) // LANE_BYTES if len(units) else before
    lane = np.flatnonzero(np.diff(text_of, prepend=-1) | np.diff(place, prepend=-1))
    count_a, count_b = (np.add.reduceat(t, lane) if len(lane) else t for t in (took_a, took_b))
    first_a, first_b = np.cumsum(count_a) - count_a, np.cumsum(count_b) - count_b
    a, b, cut = lockstep(ends_of(tool.len_a[ids_a], count_a), ends_of(tool.len_b[ids_b], count_b), first_a, first_b, first_a + count_a)
    # the groups' text: A's tokens of a group stand behind all earlier tokens, B's behind A's of the group
    last_a, last_b = a[cut], b[cut]
    ends_a, ends_b = np.zeros(len(ids_a), bool), np.zeros(len(ids_b), bool)
    ends_a[last_a], ends_b[last_b] = True, True
    group_a, group_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
    before_b = np.concatenate([[0], last_b + 1])
    codes = np.empty(len(ids_a) + len(ids_b), np.int64)
    codes[np.arange(len(ids_a)) + before_b[group_a]] = ids_a + tool.n_a * ends_a
    codes[np.arange(len(ids_b)) + last_a[group_b] + 1] = 2 * tool.n_a + ids_b + len(tool.bytes_b) * ends_b
    owner = text_of[lane]
    per_a, per_b = (np.bincount(owner, c, minlength=len(texts)).astype(np.int64) if len(owner) else np.zeros(len(texts), np.int64)
                    for c in (count_a, count_b))
    of_a = np.repeat(np.arange(len(texts)), per_a)
    n_groups = np.bincount(of_a[last_a], minlength=len(texts))
    stops = np.cumsum(per_a + per_b)
    name, rows = tool.names.__getitem__, []
    for i, stop in enumerate(stops.tolist()):
        n = int(per_a[i] + per_b[i])
        rows.append({"n_a": int(per_a[i]), "n_b": int(per_b[i]), "n_groups": int(n_groups[i]),
                     "groups": "".join(map(name, codes[stop - n:stop].tolist()))[:-1]})
    return rows, of_a[a], ids_a[a] << 32 | ids_b[b]


def packed(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Chunks of documents: what each one has, its linked id pairs with their times, and the chunk's distinct pairs with their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        tool, task, seq = alignment(path_a, path_b), TaskContext.get().partitionId(), 0
        ids, rows, places, times, chars = [], [], [], [], 0

        def close():
            # the documents' distinct pairs and how often each has them
            pairs, place = np.unique(np.concatenate([p for p, _ in places]), return_inverse=True)
            held = np.array([len(p) for p, _ in places], np.int64)
            n = np.concatenate([t for _, t in places])
            marks = squeezed(place.astype(np.uint32))
            return pa.RecordBatch.from_pylist([{
                "chunk": ((task * 4096 + seq) & 0x7FFFFFFF) << 32 | zlib.crc32(marks, zlib.crc32(repr(ids[:50]).encode())), "ids": ids,
                **{c: [r[c] for r in rows] for c in ("n_a", "n_b", "n_groups")}, "shas": [r["sha"] for r in rows],
                "held": held.tolist(), "pairs": squeezed(pairs), "documents": squeezed(np.bincount(place, minlength=len(pairs)).astype(np.uint32)),
                "places": marks, "times": squeezed(n.astype(np.uint32))}], schema=schema)

        def merge(texts: list[str]) -> None:
            found, of, pairs = aligned(tool, texts)
            for i, (row, own) in enumerate(zip(found, np.split(pairs, np.searchsorted(of, np.arange(1, len(texts)))), strict=True)):
                text = row.pop("groups")
                rows.append(row | {"sha": hashlib.sha256(text.encode()).hexdigest() if row["n_a"] else ""})
                places.append(np.unique(own, return_counts=True))

        schema = pa.schema([("chunk", pa.int64()), *[(c, pa.list_(pa.int64())) for c in ("ids", "n_a", "n_b", "n_groups")],
                            ("shas", pa.list_(pa.string())), ("held", pa.list_(pa.int64())),
                            *[(c, pa.binary()) for c in ("pairs", "documents", "places", "times")]])
        waiting, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py() or ""
                ids.append(doc_id.as_py())
                waiting.append(text)
                size, chars = size + len(text), chars + len(text)
                full = chars >= CHUNK_CHARS or len(ids) >= CHUNK_DOCUMENTS
                if size >= MERGE_CHARS or full:
                    merge(waiting)
                    waiting, size = [], 0
                if full:
                    yield close()
                    ids, rows, places, chars, seq = [], [], [], 0, seq + 1
        if ids:
            if waiting:
                merge(waiting)
            yield close()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, _PACKED)


def pair_counts(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pair, chunk), the distinct pairs of every chunk, and (pair, n, best): a pair's documents, and whether no pair of its A id has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                pairs, n = unsqueezed(batch.column(1)[r].as_py(), np.int64), unsqueezed(batch.column(2)[r].as_py(), np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pairs), pa.array(np.full(len(pairs), batch.column(0)[r].as_py(), np.int64)), pa.array(n.astype(np.int64))],
                    ["pair", "chunk", "n"])

    rows = chunks.select("chunk", "pairs", "documents").mapInArrow(run, "pair long, chunk long, n long")
    counted = rows.groupBy("pair").agg(F.sum("n").alias("n"))
    of_a = Window.partitionBy(F.shiftright("pair", 32))
    return rows.select("pair", "chunk"), counted.withColumn("best", F.col("n") == F.max("n").over(of_a))


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document.

    path_a: a byte-level BPE file, whose tokens are of a space and the text; path_b: a SentencePiece model, which adds that space.
    Tokens are cut into groups where both end at the same byte; tokens whose bytes overlap are linked. A pair of ids counts the documents that link
    it. n_best are the links whose count is the highest of their A id, count_sum the counts of all links. Texts
    that are null or empty, or whose tokens' bytes differ from the text's, have no tokens: zeros and an empty digest.

    Rows with equal or null ids are documents of their own; other columns are ignored; an empty table gives no rows. Both
    files must lie at their paths on every executor.
    """
    chunks = cut_lineage(packed(docs, path_a, path_b))
    rows, counts = pair_counts(chunks)
    replies = rows.join(counts, "pair").select("chunk", "pair", "n", "best")

    def finish(packed_: pa.Table, replies_: pa.Table) -> pa.Table:
        found = replies_.combine_chunks()
        order = np.argsort(found.column("pair").to_numpy())
        pairs = found.column("pair").to_numpy()[order]
        n, best = found.column("n").to_numpy()[order], found.column("best").to_numpy(zero_copy_only=False)[order]
        out = []
        for row in packed_.to_pylist():
            if not np.array_equal(pairs, unsqueezed(row["pairs"], np.int64)):
                raise RuntimeError("the counts belong to another run of this chunk")
            place, times = unsqueezed(row["places"], np.uint32), unsqueezed(row["times"], np.uint32).astype(np.int64)
            stops = np.concatenate([[0], np.cumsum(row["held"])])
            whole = lambda v: pa.array(np.diff(np.concatenate([[0], np.cumsum(v)])[stops]), pa.int64())
            out.append(pa.table({
                "doc_id": pa.array(row["ids"], pa.int64()), **{c: pa.array(row[c], pa.int64()) for c in ("n_a", "n_b", "n_groups")},
                "n_links": whole(times), "n_best": whole(times * best[place]), "count_sum": whole(times * n[place]),
                "groups_sha256": pa.array(row["shas"], pa.string())}))
        return pa.concat_tables(out)

    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(
        finish, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
