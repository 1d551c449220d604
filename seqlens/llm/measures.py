"""Plain measures of whole texts, one Arrow pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Characters that count as symbols, and the ASCII white space that parts words (fixed values).
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaim", "n_distinct")


def repeated_in_windows(ids: np.ndarray, distinct: int, width: int = 3) -> int:
    """Words covered by windows of ``width`` words that are found twice or more."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    key = ids[:n].astype(np.int64)
    size = distinct
    for k in range(1, width):
        key = key * distinct + ids[k:n + k]
        size *= distinct
        if size > 1 << 40 and k + 1 < width:
            _, key = np.unique(key, return_inverse=True)
            size = n
    _, place, times = np.unique(key, return_inverse=True, return_counts=True)
    again = times[place] > 1
    cover = np.zeros(len(ids) + 1, np.int32)
    cover[:n] += again
    cover[width:width + n] -= again
    return int((np.cumsum(cover[:-1]) > 0).sum())


def measures_of(text: str) -> tuple[int, ...]:
    words = text.encode().split()
    local: dict[bytes, int] = {}
    ids = np.fromiter((local.setdefault(w, len(local)) for w in words), np.int64, len(words))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (
        len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
        repeated_in_windows(ids, len(local)), len(lines), sum(map(str.isupper, text)) if not text.islower() else 0,
        text.count("!"), len(local),
    )


def measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of docs and the measures of ``text``; a null text has none of anything."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array(
                [measures_of(t.as_py() or "") for t in batch.column(batch.num_columns - 1)], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *[pa.array(found[:, i]) for i in range(len(MEASURES))]], [*columns, *MEASURES])

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), *(f"{m} long" for m in MEASURES)])
    return docs.select(*columns, docs["text"].alias("__text")).mapInArrow(run, schema)
