import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from larkspan.llm import bktree, hashing, near_duplicates

SCHEMA = "id long, title string, content string, w string, n int"


def brute(texts, k, t, least):
    words = {i: ["".join(c for c in w) for w in "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in x).split()] for i, x in texts.items()}
    sets = {i: {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} for i, w in words.items() if len(w) >= max(least, k)}
    return sorted((a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-12)


def found(spark, data, k=3, t=0.6, least=20):
    df = spark.createDataFrame(data, SCHEMA)
    links, members = near_duplicates.near_duplicates(df, "id", ["title", "content"], k, t, least)
    return sorted(map(tuple, near_duplicates.expanded(links, members).collect())), links, members


@pytest.mark.parametrize(("k", "t"), [(3, 0.6), (5, 0.8), (2, 0.5)])
def test_against_all_pairs(spark, k, t):
    rng = random.Random(k)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = {}
    for i in range(0, 240, 4):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([19, 20, 25, 60, 300]))]
        for j in range(4):
            x = list(base)
            for _ in range(j * rng.choice([1, 2, 4])):
                x[rng.randrange(len(x))] = rng.choice(vocabulary)
            if j == 3:
                x = x[len(x) // 2 :] + x[: len(x) // 2]
            texts[i + j] = " ".join(x)
    got, _, _ = found(spark, [(i, None, x, "clash", 1) for i, x in texts.items()], k, t)
    assert got == brute(texts, k, t, 20)
    assert got


def test_odd_rows(spark):
    text = " ".join(f"Word{i}" for i in range(30))
    long = " ".join(f"x{i % 977}y{i % 13}" for i in range(200_000))
    data = [(1, None, text, None, 1), (1, None, text, None, 1), (2, "", text.upper().replace(" ", " ,\n"), None, 2), (None, None, text, None, 3), (3, None, None, None, 4), (4, "", "", None, 5), (5, "few", "words", None, 6), (6, long, None, None, 7), (7, long, "tail", None, 8), (8, "é" * 50, "ü ö", None, 9)]
    got, links, members = found(spark, data)
    assert got == [(1, 2), (6, 7)]
    groups = {r["id"]: (r["class_id"], r["n_copies"], r["n_links"], r["group_id"]) for r in near_duplicates.note_groups(links, members).collect()}
    assert groups == {1: (1, 2, 0, 1), 2: (1, 2, 0, 1), 6: (6, 1, 1, 6), 7: (7, 1, 1, 6)}


def test_empty(spark):
    got, links, members = found(spark, [])
    assert got == [] and links.count() == 0 and members.count() == 0


def test_many_copies_and_a_split_tree(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "HOT", 4)
    base = [f"a{i}" for i in range(40)]
    data = [(i, None, " ".join(base), None, 0) for i in range(300)]
    texts = {}
    for i in range(300, 330):
        x = list(base)
        x[i - 300] = f"z{i}"
        texts[i] = " ".join(x)
        data.append((i, None, texts[i], None, 0))
    got, links, _ = found(spark, data)
    texts |= {i: " ".join(base) for i in range(300)}
    assert got == brute(texts, 3, 0.6, 20)
    assert links.count() < 1000  # among classes, not copies


def test_word_form_and_shingles():
    column = pa.array(["", "  A-b  c!", "né 9", "x", " ", "a b c"])
    w, n = hashing.word_form(column)
    assert w.to_pylist() == ["", "a b c", "n 9", "x", "", "a b c"] and n.tolist() == [0, 3, 2, 1, 0, 3]
    row, h = hashing.shingles(w, 3)
    assert row.tolist() == [1, 5] and h[0] == h[1]
    row, h = hashing.shingles(pa.array(["a b a b", "b a b"]), 2)
    assert row.tolist() == [0, 0, 0, 1, 1] and h[0] == h[2] == h[4] and h[1] == h[3]


@pytest.mark.parametrize(("bucket", "whole"), [(0, 4096), (1, 4096), (7, 4096), (48, 4096), (1000, 1 << 30), (7, 1), (48, 100)])
def test_forest_finds_all_within_radius(bucket, whole, monkeypatch):
    monkeypatch.setattr(bktree, "WHOLE", whole)
    monkeypatch.setattr(bktree, "ROWS", 50)
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 1 << 8, (400, 2), dtype=np.uint64)
    prints[50:60] = prints[0]
    tree = np.sort(rng.integers(0, 5, 400))
    forest = bktree.Forest(tree, prints, bucket)
    radius = rng.integers(0, 6, 400)
    got = set()
    for q, i, d in forest.within(tree, prints, radius, np.arange(400), block=64):
        assert (bktree.hamming(prints[q], prints[i]) == d).all()
        got |= set(zip(q.tolist(), i.tolist(), strict=True))
    expected = {(q, i) for q in range(400) for i in range(q) if tree[q] == tree[i] and bktree.hamming(prints[q : q + 1], prints[i : i + 1])[0] <= radius[q]}
    assert got == expected


def test_a_small_radius_prunes():
    """Where the radius is small against the spread of the distances, most of a tree is never looked at; larger buckets look at more."""
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 1 << 63, (40, 4), dtype=np.uint64)
    prints = np.repeat(centres, 100, axis=0) ^ (np.uint64(1) << rng.integers(0, 64, (4000, 4), dtype=np.uint64))
    prints = prints[rng.permutation(4000)]
    part = []
    for bucket in (4, bktree.BUCKET):
        forest = bktree.Forest(np.zeros(4000, np.int64), prints, bucket)
        found = sum(len(q) for q, _, _ in forest.within(np.zeros(4000, np.int64), prints, np.full(4000, 8), np.arange(4000)))
        assert found == 40 * 100 * 99 // 2
        part.append(forest.compared / (4000 * 3999 // 2))
    assert part[0] < 0.3 and part[0] < part[1] < 0.6, part
    assert list(bktree.Forest(np.zeros(0, np.int64), prints[:0]).within(np.zeros(3, np.int64), prints[:3], np.full(3, 8), np.full(3, 3))) == []


def corpus(n, rng):
    """Word forms of which a tenth are edited copies; phrases recur."""
    phrases = [" ".join(f"w{rng.randrange(900)}" for _ in range(6)) for _ in range(400)]
    texts = []
    for i in range(n):
        x = " ".join(rng.choice(phrases) for _ in range(8)).split() if i % 10 or not texts else rng.choice(texts).split()
        for _ in range(3):
            x[rng.randrange(len(x))] = f"w{rng.randrange(900)}"
        texts.append(" ".join(x))
    return texts


def test_distances_and_routed_bytes(spark, monkeypatch):
    """Trees compare a small part of all pairs, parts change what is found in nothing, and a text costs no more than TOKEN_BYTES in each of its trees, however many parts there are."""
    texts = corpus(3000, random.Random(1))
    df = spark.createDataFrame(list(enumerate(texts)), "id long, w string").repartition(3)
    seen = {}
    pack, meet = near_duplicates._pack, near_duplicates._meet
    for parts in (2, 50, 1000):
        seen[parts] = sorted(map(tuple, near_duplicates.candidates(df, 3, 0.6, parts).collect()))
    assert seen[2] == seen[50] == seen[1000] and seen[2]
    row, h = hashing.distinct(*hashing.shingles(pa.array(texts), 3))
    n = np.bincount(row)
    flips, at = near_duplicates.fingerprints(row, h, n)
    rank = np.arange(len(row)) - (np.cumsum(n) - n)[row]
    keep = rank < (n - (n * 3 + 4) // 5 + 1)[row]
    row, key = row[keep], h[keep] >> np.uint64(32)
    early = rank[keep] < (n - (n * 6 + 7) // 8 + 1)[row]
    for parts in (1, 10, 100, 1000):
        out = pack((key % np.uint64(parts)).astype(np.int64), key.astype(np.uint32), row, early, (rank[keep] * 255 // n[row]).astype(np.uint8), np.arange(len(n)), n, flips, at)
        assert sum(len(x.as_py()) for x in out.column("blob")) <= near_duplicates.TOKEN_BYTES * len(row) + 16 * parts
    compared = []
    monkeypatch.setattr(near_duplicates, "Forest", lambda *a: compared.append(bktree.Forest(*a)) or compared[-1])
    meet([x.as_py() for x in out.column("blob")], 3, 5)
    assert 0 < sum(f.compared for f in compared) < 0.1 * 3000 * 2999 / 2


def test_components(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(1, 40)] + [(i, i + rng.randrange(1, 9)) for i in range(100, 160, 2)] + [(500, i) for i in range(501, 540)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    got = near_duplicates.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, top(x)) for x in list(root))
    assert near_duplicates.components(spark.createDataFrame([], "a long, b long")).count() == 0
