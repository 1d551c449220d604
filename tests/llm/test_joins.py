"""The Jaccard join, hard negatives and the alignment of tokens against plain models."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqlens.llm import alignment, negatives, partenum, shingles

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingle_set(text, width=5):
    words = [w.translate(shingles._LOWER) for w in WORD.findall((text or "").encode())]
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def near_model(rows, percent=80):
    sets = [shingle_set(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, row in enumerate(rows):
        if row[0] is not None:
            least[find(i)].append(row[0])
    return collections.Counter((r[0], len(s), min(least[find(i)], default=None)) for i, (r, s) in enumerate(zip(rows, sets, strict=True)))


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words))
        words[at:at + rng.randrange(2)] = [f"w{rng.randrange(3000)}"]
    return words


def near_rows(seed=3):
    rng = random.Random(seed)
    line = [f"c{i}" for i in range(14)]
    rows = []
    for base in range(12):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([5, 8, 9, 12, 40, 90, 300]))]
        rows += [edited(rng, words, rng.choice([0, 0, 1, 2, 3, 6])) for _ in range(6)]
    hot = [f"h{i}" for i in range(120)]
    rows += [edited(rng, hot, rng.choice([1, 2, 3, 4])) for _ in range(60)]  # one text's variants, some apart
    rows += [line + [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(1, 30))] for _ in range(40)]  # a common line
    rows += [line + [f"w{rng.randrange(3000)}"] for _ in range(30)]
    return [(i * 7 % 1009, " ".join(w)) for i, w in enumerate(rows)]


def got_near(df):
    return collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def test_near_documents_are_those_of_the_model(frame, odd, odd_rows, monkeypatch):
    rows = near_rows()
    assert got_near(partenum.near_documents(frame(rows))) == near_model(rows)
    strange = [*odd_rows, (None, "a b c d e f g"), (9, "A  B\tC d e\nf g"), (9, "one"), (12, "x y"), (11, "X Y")]
    assert got_near(partenum.near_documents(odd(frame(strange)))) == near_model(strange)
    assert partenum.near_documents(frame([])).count() == 0
    # nearly every signature common, blocks of a few sets, and portions of a few rows
    for name, value in (("MOST", 2), ("BLOCK", 4), ("PORTION", 300)):
        monkeypatch.setattr(partenum, name, value)
    assert got_near(partenum.near_documents(frame(rows, 7))) == near_model(rows)


def test_signatures_meet_for_all_similar_sets():
    rng = np.random.default_rng(5)
    for size in [*range(1, 40), 97, 350, 2000]:
        for _ in range(12):
            own = np.unique(rng.integers(0, 1 << 64, size, dtype=np.uint64))
            lost = int(rng.integers(0, size // 4 + 1))
            other = np.unique(np.concatenate([rng.permutation(own)[lost:], rng.integers(0, 1 << 64, int(rng.integers(0, size // 4 + 1)), dtype=np.uint64)]))
            both = len(np.intersect1d(own, other))
            if not len(other) or 100 * both < 80 * (len(own) + len(other) - both):
                continue
            mine, its = ({int(s[0]) & 1023: (set(s.tolist()), need) for s, need in partenum.signatures(x, 80)} for x in (own, other))
            assert any(len(mine[c][0] & its[c][0]) >= max(1, mine[c][1], its[c][1]) for c in mine.keys() & its.keys())


def test_shingle_hashes_do_not_depend_on_steps(monkeypatch):
    texts = ["", None, "one", "A b  C\td e f", "a b c d E f", "x" * 1500 + " y z q r s", " ".join(map(str, range(3000))), "é" * 40_000 + " a b c d e"]
    whole = list(shingles.shingle_sets(pa.array(texts), 5))
    assert [len(s) for s in whole] == [len(shingle_set(t)) for t in texts] and whole[3].tolist() == whole[4].tolist()
    monkeypatch.setattr(shingles, "STEP", 5000)
    for a, b in zip(whole, shingles.shingle_sets(pa.array(texts).slice(0), 5), strict=True):
        assert len(a) == len(b)
    assert [s.tolist() for s in shingles.shingle_sets(pa.array(["q", *texts]).slice(4, 2), 5)] == [whole[3].tolist(), whole[4].tolist()]


def test_a_text_of_fifty_megabytes_has_all_its_shingles():
    text = " ".join(f"{i:07d}" for i in range(6_250_000))
    assert [len(s) for s in shingles.shingle_sets(pa.array([text, "a b"]), 5)] == [6_250_000 - 4, 1]


# -- hard negatives -------------------------------------------------------------


def negative_model(rows):
    held = []
    for vec_id, v, label in rows:
        if vec_id is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        held.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    out = []
    for i, (anchor, label, v) in enumerate(held):
        if anchor % 100:
            continue
        score = {j: sum(a * b for a, b in zip(v, w, strict=True)) for j, (_, _, w) in enumerate(held) if j != i and len(w) == len(v)}
        order = sorted(score, key=lambda j: (-score[j], held[j][0]))
        for p in [j for j in order if held[j][1] == label][:5]:
            fits = [j for j in order if held[j][1] != label and 30 * score[p] <= 100 * score[j] <= 90 * score[p]][:10]
            out += [(anchor, held[p][0], r, held[j][0], score[p], score[j]) for r, j in enumerate(fits, 1)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)


def mined(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_hard_negatives_are_those_of_the_model(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 12))
    rows = [(i, [float(x) for x in centres[i % 6] + 0.5 * rng.normal(size=12)], int(rng.integers(0, 4))) for i in range(900)]
    rows += [(1000 + i, rows[3][1], i % 3) for i in range(40)]  # ties
    rows += [(2000, None, 1), (2001, [1.0] * 11 + [None], 1), (2002, [float("nan")] * 12, 1), (2003, [float("inf")] * 12, 2), (None, [1.0] * 12, 1),
             (2100, [1.0] * 12, None), (2200, [0.5, 1.0], 3), (2201, [0.5, -1.0], 3), (2202, [0.1, 0.2], 2), (2300, [], 1), (2301, [], 1), (2302, [], 2),
             (2400, [0.0] * 12, 1), (2500, [-3.0e6] * 12, 2), (2501, [3.0e6] * 12, 2)]
    want = negative_model(rows)
    frame = vectors(spark, rows).withColumns({"own": F.lit("x"), "chunk": F.lit(1), "block": F.lit(2), "score": F.lit(0.5), "rank": F.lit(3)})
    assert mined(negatives.hard_negatives(frame)) == want and len(want) > 300
    for name, value in (("CHUNK", 16), ("BLOCK", 3)):
        monkeypatch.setattr(negatives, name, value)
    assert mined(negatives.hard_negatives(vectors(spark, rows))) == want
    assert negatives.hard_negatives(vectors(spark, [])).count() == 0


def test_equal_ids_are_rows_of_their_own(spark):
    rows = [(100, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (100, [0.0, 1.0], 1), (3, [0.5, 0.5], 2), (3, [0.5, 0.5], 2), (4, [0.8, 0.1], 2)]
    assert mined(negatives.hard_negatives(vectors(spark, rows))) == negative_model(rows)


def test_bounds_hold_on_every_cut():
    rng = np.random.default_rng(2)
    a, b = (rng.integers(-300, 300, (30, 19)) for _ in range(2))
    score = a @ b.T
    for (ma, sa), (mb, sb) in zip(negatives.summaries(a), negatives.summaries(b), strict=True):
        assert (np.abs(score - ma @ mb.T) <= sa @ sb.T + 1e-6).all()
    clustered = np.repeat(rng.integers(-50, 50, (2, 1)), 16, axis=1)
    at_a, at_r, scores = negatives.matched(clustered[:1], np.concatenate([clustered[1:], clustered[:1]]), np.ones((1, 2), bool), np.array([1.0]), np.array([np.inf]))
    assert (scores >= 1).any()


# -- alignment ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def aligned_model(rows, paths):
    tool, count, held = alignment.Alignment(*paths), collections.Counter(), []
    for doc_id, text, *_ in rows:
        whole = (" " + (text or "")).encode()
        a = tool.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = tool.b.encode(text) if text else []
        if b"".join(tool.bytes_a[i] for i in a) != whole or b"".join(tool.bytes_b[i] for i in b) != whole:
            held.append((doc_id, None, []))
            continue
        ends_a, ends_b = np.cumsum([len(tool.bytes_a[i]) for i in a]).tolist(), np.cumsum([len(tool.bytes_b[i]) for i in b]).tolist()
        links = [(i, j) for i in range(len(a)) for j in range(len(b))
                 if max(ends_a[i - 1] if i else 0, ends_b[j - 1] if j else 0) < min(ends_a[i], ends_b[j])]
        groups = []
        for end in sorted(set(ends_a) & set(ends_b)):
            low = groups[-1][0] if groups else 0
            groups.append((end, ",".join(str(t) for t, e in zip(a, ends_a, strict=True) if low < e <= end) + "|"
                           + ",".join(str(t) for t, e in zip(b, ends_b, strict=True) if low < e <= end)))
        links = [(a[i], b[j]) for i, j in links]
        count.update(set(links))
        held.append((doc_id, (len(a), len(b), ";".join(g for _, g in groups), len(groups)), links))
    best = collections.Counter()
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    return collections.Counter(
        (doc_id, 0, 0, 0, 0, 0, 0, "") if made is None else (
            doc_id, made[0], made[1], made[3], len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links),
            hashlib.sha256(made[2].encode()).hexdigest())
        for doc_id, made, links in held)


def got_aligned(df):
    return collections.Counter(tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


def test_alignment_is_that_of_the_model(frame, odd, odd_rows, paths, monkeypatch):
    rng = random.Random(4)
    words = ["the", "a", "Straße", "naïve", "don't", "x1", "2024", "...", "\n", "\n\n", "  ", "<|endoftext|>", "<s>", "語彙", "\U0001f600", "á", "▁", "foo(bar)",
             " y", "Ωmega", "հայ", "<0x41>", "\t"]
    rows = [(i, " ".join(rng.choice(words[:-8] if i % 3 else words) for _ in range(rng.randrange(1, 60)))) for i in range(60)]
    rows += [*[r for r in odd_rows if len(r[1] or "") < 1000], (70, "word " * 400), (71, "x\n  y ok"), (72, " lead"), (73, "trail "), (74, "a  b")]
    want = aligned_model(rows, paths)
    assert got_aligned(alignment.align(odd(frame(rows)), *paths)) == want
    for name, value in (("LANE_BYTES", 40), ("MERGE_CHARS", 500), ("CHUNK_CHARS", 2000), ("MOST_UNITS", 20)):
        monkeypatch.setattr(alignment, name, value)
    assert got_aligned(alignment.align(frame(rows, 5), *paths)) == want
    assert alignment.align(frame([]), *paths).count() == 0


def test_lockstep_links_what_overlaps():
    ends_a, ends_b = np.array([1, 3, 6, 2]), np.array([2, 3, 5, 6, 1, 2])
    a, b, cut = alignment.lockstep(ends_a, ends_b, np.array([0, 3, 4]), np.array([0, 4, 6]), np.array([3, 4, 4]))
    assert list(zip(a.tolist(), b.tolist(), cut.tolist(), strict=True)) == [
        (0, 0, False), (1, 0, False), (1, 1, True), (2, 2, False), (2, 3, True), (3, 4, False), (3, 5, True)]
