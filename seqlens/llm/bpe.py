"""Byte-level BPE: encoding by replaying the merges over the corpus's distinct pre-tokens, and decoding.

Each bucket holds distinct pre-tokens of the whole corpus. An inverted index names the
positions of every adjacent pair that has a rank; ranks are taken in order, all
positions of a rank are merged, and only the pairs with the touched neighbours are
looked up anew. Sequences of ids return to the chunks and are laid out per document.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlens.llm import pieces


@lru_cache(maxsize=1)
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=1)
def pairs_of(path: str) -> dict[int, int]:
    """Rank of every pair of tokens whose bytes together are a token; left * 2**20 + right to rank."""
    ranks, pairs = ranks_of(path), {}
    for token, rank in ranks.items():
        for at in range(1, len(token)):
            left = ranks.get(token[:at])
            if left is not None and (right := ranks.get(token[at:])) is not None:
                pairs[(left << 20) | right] = rank
    return pairs


@lru_cache(maxsize=1)
def _known(path: str) -> dict[str, int]:
    """Tokens that are whole pre-tokens, as text. Ids of 2**16 and more are left to the replay."""
    known = {}
    for token, rank in ranks_of(path).items():
        if rank < 65536:
            try:
                known[token.decode()] = rank
            except UnicodeDecodeError:
                continue
    return known


@lru_cache(maxsize=1)
def _token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, bytes) of each token, by id."""
    ranks = ranks_of(path)
    by_id = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        by_id[rank] = token
    lengths = np.fromiter(map(len, by_id), np.int64, len(by_id))
    return np.cumsum(lengths) - lengths, lengths, np.frombuffer(b"".join(by_id), np.uint8)


def replay(words: list[bytes], ranks: dict[bytes, int], pairs: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(number of ids per word, all ids): every merge in rank order over all words at once."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths)
    first = np.zeros(int(ends[-1]) if len(ends) else 0, bool)
    first[(ends - lengths)[lengths > 0]] = True
    base = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
    start = base[np.frombuffer(b"".join(words), np.uint8)]
    token, size = start.tolist(), len(start)
    after = list(range(1, size + 1))
    before = list(range(-1, size - 1))
    for at in np.flatnonzero(first).tolist():
        before[at] = -1
        if at:
            after[at - 1] = -1
    if size:
        after[size - 1] = -1
    at_pair: dict[int, list[int]] = {}
    get = pairs.get
    for at in range(size):
        if (to := after[at]) >= 0 and (rank := get((token[at] << 20) | token[to])) is not None:
            at_pair.setdefault(rank, []).append(at)
    waiting = list(at_pair)
    heapq.heapify(waiting)
    while waiting:
        rank = heapq.heappop(waiting)
        places = at_pair.pop(rank, None)
        if places is None:
            continue
        places.sort()
        for i, at in enumerate(places):
            # a place may have been merged away or changed since it was noted
            if token[at] < 0 or (to := after[at]) < 0 or get((token[at] << 20) | token[to]) != rank:
                continue
            token[at], token[to] = rank, -1
            next_ = after[at] = after[to]
            sooner = False
            if next_ >= 0:
                before[next_] = at
                if (r := get((rank << 20) | token[next_])) is not None:
                    if r not in at_pair:
                        heapq.heappush(waiting, r)
                    at_pair.setdefault(r, []).append(at)
                    sooner = r < rank
            if (prior := before[at]) >= 0 and (r := get((token[prior] << 20) | rank)) is not None:
                if r not in at_pair:
                    heapq.heappush(waiting, r)
                at_pair.setdefault(r, []).append(prior)
                sooner |= r < rank
            if sooner and i + 1 < len(places):  # a lower rank came up: it goes first
                if rank not in at_pair:
                    heapq.heappush(waiting, rank)
                at_pair.setdefault(rank, []).extend(places[i + 1:])
                break
    ids = np.array(token, np.int64)
    kept = ids >= 0
    per_word = np.add.reduceat(kept, (ends - lengths)[lengths > 0]) if size else np.empty(0, np.int64)
    counts = np.zeros(len(words), np.int64)
    counts[lengths > 0] = per_word
    return counts, ids[kept].astype(np.uint32)


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids_le: the ids' digest is taken of the ids as they come out."""
    return encoded.select("doc_id", "n_tokens", F.sha2("ids_le", 256).alias("ids_sha256"), "decoded_sha256", "ids_le")


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_le (little-endian unsigned 32-bit) of every text, and decoded_sha256 of what they decode to.

    Null texts count as empty (no ids). Rows with equal or null ids stay separate rows;
    other columns are ignored; an empty table gives no rows. No special tokens. The
    rank file must lie at ``path`` on every executor.
    """

    def split():
        import regex

        return regex.compile(pattern).findall

    def work(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        counts, ids = [], []
        for at in range(0, len(words), 50_000):
            n, got = replay(words[at:at + 50_000], ranks_of(path), pairs_of(path))
            counts.append(n)
            ids.append(got)
        return np.concatenate(counts), np.concatenate(ids)

    def finish(packed: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        start_of, length_of, all_bytes = _token_bytes(path)
        for row in packed.to_pylist():
            lengths, answers = pieces.answers_of(row, replies)
            starts = np.cumsum(lengths) - lengths
            numbers = pieces.unsqueezed(row["numbers"], np.uint32).astype(np.int64)
            at, tokens, decoded_sha, ids_le = 0, [], [], []
            for n in row["counts"]:
                part = numbers[at:at + n]
                at += n
                new = part >= 65536
                took = np.ones(n, np.int64)
                took[new] = lengths[part[new] - 65536]
                ids = np.empty(int(took.sum()), np.uint32)
                of = np.repeat(new, took)
                ids[~of] = part[~new]
                ids[of] = answers[pieces.gather(starts[part[new] - 65536], took[new])]
                coded = ids.astype("<u4").tobytes()
                tokens.append(len(ids))
                ids_le.append(coded)
                decoded_sha.append(hashlib.sha256(decode_ids(coded, start_of, length_of, all_bytes)).hexdigest())
            out.append(pa.table({
                "doc_id": pa.array(row["ids"], pa.int64()), "n_tokens": pa.array(tokens, pa.int64()),
                "decoded_sha256": pa.array(decoded_sha, pa.string()),
                "ids_le": pa.array(ids_le, pa.binary())}))
        return pa.concat_tables(out)

    packer = pieces.pack(lambda: _known(path), split, pieces.bucket_count(docs), tally=False)
    return pieces.exchanged(
        docs, packer, work, finish, "doc_id long, n_tokens long, decoded_sha256 string, ids_le binary")


def decode_ids(coded: bytes, start_of: np.ndarray, length_of: np.ndarray, all_bytes: np.ndarray) -> bytes:
    """The bytes that a text's ids stand for."""
    ids = np.frombuffer(coded, "<u4")
    return all_bytes[pieces.gather(start_of[ids], length_of[ids])].tobytes()
