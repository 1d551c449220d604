"""Token counts of whole texts without their ids.

A pre-token that the vocabulary holds counts one token. Every other distinct pre-token
of the corpus is counted once by the library, and the counts are joined to the
pre-token frequencies of each document and summed.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlens.llm import pieces

#: The split that the vocabulary's pre-tokenizer makes (a fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: From here on the classes of the two Unicode tables in use may differ; such texts go to the library's own splitter.
FIRST_DOUBTFUL = "՘"
#: Number of every pre-token that counts one token.
ONE = 0


@lru_cache(maxsize=1)
def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_of_char() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 as itself, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=1)
def _vocabulary(path: str) -> dict[str, int]:
    chars, known = byte_of_char(), {}
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    for token in model["model"]["vocab"]:
        if all(c in chars for c in token):
            try:
                known[bytes(chars[c] for c in token).decode()] = ONE
            except UnicodeDecodeError:
                continue
    return known


def splitter(path: str):
    """Pre-tokens of a text as the library cuts it; an added special token stands as itself and counts one."""
    import regex

    library = _library(path)
    pattern, doubtful = regex.compile(SPLIT), regex.compile(f"[{FIRST_DOUBTFUL}-\U0010ffff]")
    special = sorted((t.content for t in library.get_added_tokens_decoder().values()), key=len, reverse=True)
    cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None

    def plain(text: str) -> list[str]:
        if doubtful.search(text):
            return [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]
        return pattern.findall(text)

    def run(text: str) -> list[str]:
        if cut is None or not cut.search(text):
            return plain(text)
        parts = cut.split(text)
        return [w for i, part in enumerate(parts) for w in ([SPECIAL] if i % 2 else plain(part))]

    return run


#: Stands for an added special token; no pre-token begins with a space and ends with one unless it is all white space.
SPECIAL = " special "


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every text, by the tokenizer file ``path``.

    Null texts count as empty (0 tokens); rows with equal or null ids stay separate rows;
    other columns are ignored; an empty table gives no rows. The file must lie at
    ``path`` on every executor.
    """

    def known():
        return _vocabulary(path) | {SPECIAL: ONE}

    def work(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        library, counts = _library(path), np.empty(len(words), np.uint32)
        for at in range(0, len(words), 2000):
            part = [w.decode() for w in words[at:at + 2000]]
            counts[at:at + len(part)] = [len(e) for e in library.encode_batch(part, add_special_tokens=False)]
        return np.ones(len(words), np.int64), counts

    def finish(packed: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        for row in packed.to_pylist():
            _, counts = pieces.answers_of(row, replies)
            numbers = pieces.unsqueezed(row["numbers"], np.uint32).astype(np.int64)
            of, times = numbers[::2], numbers[1::2]
            tokens = np.ones(len(of), np.int64)
            tokens[of >= 65536] = counts[of[of >= 65536] - 65536]
            ends = np.concatenate([[0], np.cumsum(tokens * times)])
            stops = np.concatenate([[0], np.cumsum(np.array(row["counts"], np.int64) // 2)])
            n = np.diff(ends[stops])
            out.append(pa.table({
                "doc_id": pa.array(row["ids"], pa.int64()), "n_bytes": pa.array(row["bytes"], pa.int64()),
                "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array(n > limit)}))
        return pa.concat_tables(out)

    packer = pieces.pack(known, lambda: splitter(path), pieces.bucket_count(docs), tally=True)
    return pieces.exchanged(docs, packer, work, finish, "doc_id long, n_bytes long, n_tokens long, over_limit boolean").select(
        "doc_id", "n_bytes", "n_tokens", F.col("over_limit"))
