"""Token counts and byte-level BPE against the libraries."""

import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from seqlens.llm import bpe, pieces, token_counts

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
TEXTS = [
    "", " ", "\n\n  \n", "Hello world, it's he'll I'd 12345 <|endoftext|> x<|endoftext|>y", "naïve café — Straße", "語" * 50,
    "a" * 700, "ab" * 400 + " " * 40, "՘࢏ letters of a newer table", "tab\tend\x1f\x1c", "zzxqj qqzv " * 20, "\U0001f600\U0001f468‍\U0001f469",
]


@pytest.fixture(scope="module")
def rank_table():
    with open(RANKS, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def test_counts_match_library(frame, odd, odd_rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(JSON)
    rows = [*enumerate(TEXTS, 100), *odd_rows]
    got = sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(odd(frame(rows)), JSON).collect())
    texts = [r[1] or "" for r in rows]
    counts = [len(library.encode(t, add_special_tokens=False)) for t in texts]
    assert got == sorted((len(t.encode()), n, n > 1024) for t, n in zip(texts, counts, strict=True))


def test_ids_match_library_and_decode(frame, odd, odd_rows, rank_table):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=rank_table, special_tokens={})
    rows = [*enumerate(TEXTS, 100), *odd_rows]
    got = bpe.digests(bpe.encode_decode(odd(frame(rows)), RANKS, P.PATTERN)).collect()
    want = []
    for r in rows:
        ids = np.array(library.encode_ordinary(r[1] or ""), "<u4").tobytes()
        want.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest(), ids))
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256, bytes(r.ids_le)) for r in got) == sorted(want)


def test_replay_is_serial_bpe(rank_table):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=rank_table, special_tokens={})
    rng = np.random.default_rng(7)
    words = [bytes(rng.choice(list(b"aehnorst \xc3\xa9z1"), rng.integers(0, 30)).tolist()) for _ in range(400)]
    counts, ids = bpe.replay(words, rank_table, bpe.pairs_of(RANKS))
    cuts = np.split(ids, np.cumsum(counts)[:-1])
    for w, got in zip(words, cuts, strict=True):
        assert got.tolist() == (library._encode_single_piece(w) if w else [])


def test_small_chunks_and_many_buckets(frame, monkeypatch):
    monkeypatch.setattr(pieces, "CHUNK_CHARS", 50)
    docs = frame([(i, f"zqx{i % 7} wvut{i % 5} common words 'tis {i}") for i in range(60)])
    one = token_counts.count_tokens(docs, JSON).groupBy().agg(F.sum("n_tokens"), F.count("doc_id")).first()
    monkeypatch.setattr(pieces, "CHUNK_CHARS", 10**9)
    assert one == token_counts.count_tokens(docs, JSON).groupBy().agg(F.sum("n_tokens"), F.count("doc_id")).first()


def test_empty_tables(frame):
    assert token_counts.count_tokens(frame([]), JSON).count() == 0
    assert bpe.encode_decode(frame([]), RANKS, P.PATTERN).count() == 0


def test_replies_of_another_run_are_refused():
    import pyarrow as pa

    with pytest.raises(RuntimeError, match="another run"):
        pieces.answers_of({"buckets": [1, 0]}, pa.Table.from_pylist([], schema=pa.schema([("bucket", pa.int32())])))
