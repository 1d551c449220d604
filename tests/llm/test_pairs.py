"""SimHash, repeated passages and lookup sketches against plain models."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from seqlens.llm import iblt, simhash, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text, width=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(text)
    shingles = [" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(keys, linked):
    root = list(range(len(keys)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(keys)):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i in range(len(keys)):
        groups[find(i)].append(i)
    return groups, find


def test_fingerprints_and_components(frame, odd, odd_rows):
    rng = np.random.default_rng(1)
    base = [f"w{rng.integers(0, 500)}" for _ in range(400)]
    near = [" ".join(base[:i] + ["Changed"] + base[i + 1:]) for i in (3, 200, 399)]
    rows = [*odd_rows, (50, " ".join(base)), *[(60 + i, t) for i, t in enumerate(near)], (40, near[0].upper())]
    got = simhash.near_duplicates(odd(frame(rows))).collect()
    prints = [plain_fingerprint(r[1]) for r in rows]
    groups, _ = plain_components(rows, lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    want = []
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        want += [(rows[i][0], f"{prints[i]:016x}", min(ids, default=None)) for i in members]
    assert sorted(map(str, got_rows(got))) == sorted(map(str, want))


def got_rows(rows):
    return [tuple(r) for r in rows]


@pytest.mark.parametrize(("errors", "parts"), [(3, 2), (8, 8), (1, 1), (5, 4)])
def test_trie_finds_every_link(spark, errors, parts):
    rng = np.random.default_rng(errors)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    flips = lambda n: sum(1 << int(b) for b in rng.choice(64, n, replace=False))
    points = sorted({int(c) ^ flips(int(rng.integers(0, errors + 3))) for c in centres for _ in range(25)})
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    df = spark.createDataFrame([(p, 0, i) for i, p in enumerate(signed)], "fp long, other long, id long")
    edges = simhash.links(df, errors, parts, leaves=16).collect()
    groups, _ = plain_components(points, lambda i, j: (points[i] ^ points[j]).bit_count() <= errors)
    root = simhash.joined(np.arange(len(points)), np.array([e.a for e in edges], np.int64), np.array([e.b for e in edges], np.int64))
    found = defaultdict(set)
    for i, r in enumerate(root.tolist()):
        found[r].add(i)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, groups.values()))


def test_long_lists_of_node_pairs_are_followed_in_portions(monkeypatch):
    rng = np.random.default_rng(3)
    leaves = np.unique(rng.integers(0, 1 << 10, 300, dtype=np.uint64))
    monkeypatch.setattr(simhash, "PORTION", 20)
    pairs = {(int(a), int(b)) for x, y in simhash.follow(leaves, leaves, 0, 3, 1) for a, b in zip(x, y, strict=True)}
    want = {(i, j) for j in range(len(leaves)) for i in range(j) if int(leaves[i] ^ leaves[j]).bit_count() <= 3}
    assert pairs == want


def test_one_of_each_near_group_stays(frame, odd):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{rng.integers(0, 3000)}" for _ in range(300)) for _ in range(6)]
    near = texts[0].replace(" ", " new ", 1)
    rows = [(10, texts[0]), (3, near), (11, texts[1]), (12, texts[1]), (13, texts[2]), (13, texts[2]), (None, texts[3]),
            (14, texts[3]), (15, texts[4]), (None, texts[5]), (16, None), (17, "")]
    got = simhash.without_near_copies(odd(frame(rows)))
    assert sorted(map(str, [r.doc_id for r in got.collect()])) == sorted(map(str, [3, 11, 13, 14, 15, None, 16]))
    assert "payload" in got.columns and got.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_null_and_repeated_ids_do_not_join_unrelated_texts(frame, odd):
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{rng.integers(0, 3000)}" for _ in range(300)) for _ in range(7)]
    rows = [*[(None, t) for t in texts[:4]], (None, texts[0]), *[(7, t) for t in texts[4:]], (7, texts[4])]
    got = simhash.without_near_copies(odd(frame(rows)))
    assert sorted(map(str, [(r.doc_id, r.text) for r in got.collect()])) == sorted(map(str, {(r[0], r[1]) for r in rows}))


def five_words(text):
    words = text.split()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def similar(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_near_copies_are_those_of_similarity_08(frame):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(120):
        text = [f"w{rng.integers(0, 3000)}" for _ in range(250)]
        other = list(text)
        for at in rng.choice(250, int(rng.integers(3, 9)), replace=False):
            other[at] = "changed"
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(other))]
    like = [similar(five_words(rows[2 * i][1]), five_words(rows[2 * i + 1][1])) for i in range(120)]
    assert sum(x < 0.8 for x in like) > 20 and sum(0.8 <= x < 0.85 for x in like) > 20
    kept = {r.doc_id for r in simhash.without_near_copies(frame(rows)).collect()}
    assert {i for i in range(120) if 2 * i + 1 not in kept} == {i for i in range(120) if like[i] >= 0.8}


def test_linked_sets_are_those_of_plain_pairs():
    rng = np.random.default_rng(10)
    sets = [np.unique(rng.integers(0, 14, int(rng.integers(1, 30)))).astype(np.uint64) for _ in range(150)] + [np.zeros(0, np.uint64)]
    plain = [set(x.tolist()) for x in sets]
    groups, _ = plain_components(sets, lambda i, j: similar(plain[i], plain[j]) >= 0.8)
    found = defaultdict(list)
    for i, label in enumerate(simhash.linked_sets(sets, 0.8).tolist()):
        found[label].append(i)
    assert sorted(found.values()) == sorted(groups.values()) and len(groups) > 20


def test_leaf_pairs_come_in_portions(monkeypatch):
    leaves = np.sort(np.array([5] * 30 + [6] * 20 + [1 << 60] * 3, np.uint64))
    monkeypatch.setattr(simhash, "LEAF_PAIRS", 70)
    found = [list(zip(x.tolist(), y.tolist(), strict=True)) for x, y in simhash.follow(leaves, leaves, 0, 2, 1)]
    pairs = [p for part in found for p in part]
    want = {(i, j) for j in range(53) for i in range(j) if int(leaves[i] ^ leaves[j]).bit_count() <= 2}
    assert len(pairs) == len(want) and set(pairs) == want and max(map(len, found)) <= 70


def plain_repeats(rows, width):
    words = [(r[1] or "").encode().split() for r in rows]
    seen = Counter(tuple(w[i:i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for r, w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i:i + width])] > 1:
                gone[i:i + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((r[0], len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("chunk", [40, 10**9])
def test_repeated_passages(frame, odd, odd_rows, monkeypatch, chunk):
    monkeypatch.setattr(substrings, "CHUNK_CHARS", chunk)
    rng = np.random.default_rng(2)
    some = lambda n, k=400: " ".join(f"w{rng.integers(0, k)}" for _ in range(n))
    passage, periodic = some(36), "x y " * 60
    rows = [*odd_rows, (20, f"{some(9)} {passage} {some(40)}"), (21, f"{passage}\n{some(3)}"), (22, some(50) + " " + passage[:-3]),
            (23, periodic), (24, "q " + periodic[:150] + "z"), (25, f"{some(34)}"), (26, some(200, 3)), (27, some(200, 2)),
            (28, "a " * 35), (29, "a " * 34), (30, f"a {passage} {passage}")]
    got = substrings.kept_digests(odd(frame(rows))).collect()
    assert sorted(map(str, got_rows(got))) == sorted(map(str, plain_repeats(rows, 35)))


def test_untouched_texts_stay(frame, odd, odd_rows):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [*odd_rows, (30, f"left {passage}  right"), (31, f"{passage}\tother\nline")]
    got = substrings.without_repeats(odd(frame(rows)))
    assert got.columns == odd(frame(rows)).columns
    texts = {r.doc_id: (r.text, r.n_chars) for r in got.collect() if r.doc_id in (1, 2, 3, 5, 30, 31)}
    assert texts == {1: (None, None), 2: ("", 0), 3: (" \n\t ", 4), 5: (odd_rows[6][1], len(odd_rows[6][1])), 30: ("left right", 10), 31: ("other line", 10)}


def plain_paragraphs(text, s=iblt.Sketch()):
    space = r"[ \t\n\x0b\f\r]"
    out = set()
    for p in re.split(rf"\n+|(?<=[.!?]){space}+", text):
        out |= set(re.findall(rf"(?:[^ \t\n\x0b\f\r]+{space}*){{1,{s.run}}}", p)) if len(p) > s.long else {p}
    return out - {""}


def plain_edits(rows):
    ids = sorted({r[0] if r[0] is not None else iblt.LEAST_ID for r in rows}, reverse=True)
    one = {r[0] if r[0] is not None else iblt.LEAST_ID: r[1] or "" for r in rows}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    out = []
    for r in rows:
        k, text = r[0] if r[0] is not None else iblt.LEAST_ID, r[1] or ""
        other, n = one[ids[(ids.index(k) + 1) % len(ids)]], len(text) // 3
        edited = text[:len(text) - n] + other[:n]
        a, b, c = plain_paragraphs(text), plain_paragraphs(edited), plain_paragraphs(other)
        out.append((r[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), round(like(a, b), 9), round(like(a, c), 9)))
    return out


def edits_of(df):
    return [(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in df.collect()]


def test_lookup_sketches(frame, odd, odd_rows):
    rng = np.random.default_rng(4)
    line = lambda: " ".join(f"w{rng.integers(0, 90)}" for _ in range(6)) + rng.choice([".", "!\n", "?"])
    rows = [*odd_rows, *[(100 + i, " ".join(line() for _ in range(int(rng.integers(1, 80))))) for i in range(25)]]
    got = iblt.fingerprint_edits(odd(frame(rows))).cache()
    assert sorted(map(str, edits_of(got))) == sorted(map(str, plain_edits(rows)))
    same = [r.fingerprint for r in got.collect() if r.doc_id in (4, 8)]
    assert len(same) == 3 and len(set(same)) == 1


def test_sketches_that_are_too_small_are_tried_larger(frame):
    rows = [(i, ". ".join(f"{i} {j}" for j in range(40))) for i in range(6)]
    small = iblt.Sketch(cells=2, share=0.01, steps=9)
    assert sorted(edits_of(iblt.fingerprint_edits(frame(rows), small))) == sorted(plain_edits(rows))


def test_printed_fingerprints_are_subtracted_first(spark):
    rng = np.random.default_rng(8)
    sets = []
    for i in range(40):
        own = [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 12)]
        sets.append((i, own, own[i % 7:] + [int(x) for x in rng.integers(-(1 << 62), 1 << 62, i % 5)], len(range(i % 7)) + i % 5))
    df = spark.createDataFrame(sets, "i int, own array<long>, other array<long>, want int")
    cells = lambda c: iblt.base_cells(F.col(c), iblt.Sketch())
    got = df.select("want", iblt.settled(cells("own"), cells("other"), iblt.Sketch()).alias("got")).collect()
    assert all(r.got in (None, r.want) for r in got)
    assert all(r.got == r.want for r in got if r.want <= 2) and sum(r.got is not None for r in got) >= 30


def test_sketches_of_repeated_ids(frame, odd):
    rng = np.random.default_rng(9)
    text = lambda: ". ".join(f"w{rng.integers(0, 40)} w{rng.integers(0, 40)}" for _ in range(int(rng.integers(1, 30))))
    rows = [(7 if i % 2 else None if i % 5 == 0 else i, text()) for i in range(60)]
    rows += rows[:9]
    docs = frame(rows)
    least = {r.doc_id: r.t for r in docs.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("t")).collect()}
    # the last row of an id stands for it in the plain model
    want = plain_edits(rows + list(least.items()))[:len(rows)]
    assert sorted(map(str, edits_of(iblt.fingerprint_edits(odd(docs))))) == sorted(map(str, want))


def test_previous_ids_over_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    ids = sorted({int(x) for x in rng.integers(-(1 << 62), 1 << 62, 300)} | set(range(40_000, 70_000)))
    got = iblt.previous_ids(spark.createDataFrame([(i,) for i in ids], "k long"))
    assert sorted(got_rows(got.collect())) == [(k, p) for k, p in zip(ids, [None, *ids[:-1]], strict=True)]


def test_empty_tables(frame):
    assert simhash.near_duplicates(frame([])).count() == 0
    assert simhash.without_near_copies(frame([])).count() == 0
    assert substrings.kept_digests(frame([])).count() == 0
    assert iblt.fingerprint_edits(frame([])).count() == 0
