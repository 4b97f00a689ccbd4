import random
import unicodedata

import numpy as np
import pytest

from larkspan.llm import canonical, leakage, mixture
from larkspan.llm.canonical import consistent


@pytest.mark.parametrize(
    ("text", "form"),
    [
        ("Ｆｕｌｌ　ｗｉｄｔｈ", "Full width"),
        ("a​b﻿c­d⁠e‍f", "abcdef"),
        ("e​́", "é"),
        ("a b c\td", "a b c d"),
        ("ﬁ ﬂ", "fi fl"),
        ("СаР А Ο ѕіј", "CaP A O sij"),
        ("ё ї й", "ë ï й"),
        ("line\n\nbreak\r\n", "line\n\nbreak\r\n"),
        ("a  b", "a  b"),
        ("\x00\x07x", "x"),
        ("", ""),
        ("각", "각"),
        ("ｶﾞ", "ガ"),
        ("́x", "́x"),
    ],
)
def test_forms(text, form):
    assert consistent(text) == form == canonical.form(text)


def test_forms_are_their_own_forms():
    for p in range(0x3000):
        c = chr(p)
        if unicodedata.category(c) != "Cn":
            for text in (c, "a" + c, c + "́", "x" + c + "y"):
                assert consistent(consistent(text)) == consistent(text) == canonical.form(text)
    assert not set(canonical.LOOKALIKES.values()) & set(canonical.LOOKALIKES)


def test_clusters_against_normalisation():
    rng = random.Random(3)
    marks = [chr(p) for p in range(0x300, 0x370)] + ["\u200b", "\u05b0", "\u0f71", "\u0f72", "\u3099", "\uff9e", "\u1161", "\u11a8", "\u0653", "\u093c", "\u09be"]
    bases = list("aеЕoοÉửẅ가각ᄀかｶﾊ\u0915\u09c7 ﬁ㎏Ａ½Ω\n")
    for _ in range(60_000):
        text = "".join(rng.choice(bases if rng.random() < 0.5 else marks) for _ in range(rng.randrange(1, 7)))
        assert consistent(text) == canonical.form(text), [hex(ord(c)) for c in text]


DOCS = "doc_id long, text string, form string, id int"


def test_same_looking(spark, rows):
    data = [(1, "abc", "x", 0), (1, "abc", "x", 0), (2, "аbc", "x", 0), (3, "abc", "x", 0), (4, None, "x", 0), (5, "", "x", 0), (6, "​", "x", 0), (None, "аbc", "x", 0), (7, "q" * 300_000, None, 1), (8, "q" * 300_000 + "­", None, 1)]
    df = spark.createDataFrame(data, DOCS)
    assert rows(canonical.same_looking(df, "doc_id", "text")) == [(1, 2), (2, 3), (5, 6), (7, 8)]
    assert rows(canonical.same_looking(df.limit(0), "doc_id", "text")) == []
    assert rows(canonical.look_alike_classes(df, "doc_id", "text")) == [(1, 3, 2), (5, 2, 2), (7, 2, 2)]
    forms = {r["id"]: r["form"] for r in canonical.consistent_texts(df, "doc_id", "text").collect()}
    assert forms[2] == "abc" and forms[4] is None and forms[6] == "" and len(forms[8]) == 300_000


ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen"


def test_leaks(spark, rows):
    items = spark.createDataFrame([(1, ITEM, 5), (1, ITEM, 5), (2, "too few words", 5), (3, None, 5), (4, "", 5), (None, ITEM, 5)], "item_id long, passage string, doc_id int")
    words = ITEM.split()
    data = [
        (1, "x " + " ".join(words[:12]) + " y"),
        (2, "x " + " ".join(words[:11]) + " y " + words[11]),
        (3, ", ".join(words[1:]).upper().replace("O", "О")),
        (4, " ".join(words[:12]) + "x"),
        (5, None),
        (6, ""),
        (7, "filler " * 100_000 + ITEM + " filler" * 100_000),
        (7, "filler " * 100_000 + ITEM + " filler" * 100_000),
        (None, ITEM),
        (8, "x" + " ".join(words[:12])),
    ]
    docs = spark.createDataFrame([(i, t, 9) for i, t in data], "doc_id long, text string, item_id int")
    found = leakage.leaks(docs, "doc_id", "text", items, "item_id", "passage")
    assert rows(found) == [(1, 1), (3, 1), (7, 1)]
    assert rows(leakage.leaked_items(found, items, "item_id")) == [(1, 3), (2, 0), (3, 0), (4, 0)]
    assert rows(leakage.leaks(docs.limit(0), "doc_id", "text", items, "item_id", "passage")) == []
    assert rows(leakage.leaks(docs, "doc_id", "text", items.limit(0), "item_id", "passage")) == []


def test_leaks_across_pieces(spark, rows, monkeypatch):
    monkeypatch.setattr(leakage, "PIECE", 100)
    texts = {i: " ".join(f"w{i}x{j}" for j in range(14)) for i in range(9)}
    items = spark.createDataFrame(list(texts.items()), "item_id long, passage string")
    docs = spark.createDataFrame([(i, "z " * (13 * i) + texts[i] + " y " * 40 + texts[(i + 1) % 9]) for i in range(9)], "doc_id long, text string")
    for edits in (0, 1):
        assert rows(leakage.leaks(docs, "doc_id", "text", items, "item_id", "passage", edits=edits)) == sorted((i, j) for i in range(9) for j in (i, (i + 1) % 9))


def test_pieces_hold_every_stretch():
    words = " ".join("x" * (i % 17 + 1) for i in range(300)) + " " + "y" * 400 + " z"
    text = f" {words} "
    for size in (40, 150, 10_000):
        parts = leakage.pieces_of(words, 60, size)
        assert all(p[0] == p[-1] == " " for p in parts)
        blanks = [i for i, c in enumerate(text) if c == " "]
        for i, a in enumerate(blanks):
            for b in blanks[i + 1 :]:
                if b + 1 - a <= 60:
                    assert any(text[a : b + 1] in p for p in parts)


def edit_distance_inside(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@pytest.mark.parametrize("edits", [0, 1, 2, 5])
def test_leaks_against_brute_force(spark, rows, edits):
    rng = random.Random(edits)
    words = [f"w{i}" for i in range(40)]
    passages = {i: " ".join(rng.choice(words) for _ in range(rng.choice([5, 6, 9]))) for i in range(12)}
    passages[12] = passages[3]
    passages[13] = "a b c d e f"
    texts = {}
    for i in range(50):
        x = passages[rng.randrange(14)]
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(x))
            x = x[:at] + rng.choice(["", "q", x[at] + " "]) + x[at + 1 :]
        texts[i] = " ".join([rng.choice(words) for _ in range(rng.randrange(4))] + x.split() + [rng.choice(words) for _ in range(rng.randrange(4))])
    expected = []
    for i, x in texts.items():
        for j, p in passages.items():
            w = p.split()
            runs = [" " + " ".join(w[k : k + 6]) + " " for k in range(len(w) - 5)]
            if any(edit_distance_inside(r, f" {x} ") <= edits for r in runs):
                expected.append((i, j))
    docs, items = (spark.createDataFrame(list(x.items()), f"{c} long, text string") for c, x in (("doc_id", texts), ("item_id", passages)))
    got = rows(leakage.leaks(docs, "doc_id", "text", items, "item_id", "text", min_words=6, edits=edits))
    assert got == sorted(expected, key=repr) and got


def test_banded_distances():
    pattern, text = (leakage._points(x) for x in ("abcdefabc", "xxabdefyyabcxx"))
    got = leakage.banded_distances(pattern, np.array([0, 6, 0]), np.array([6, 3, 0]), text, np.array([0, 9, 0]), np.array([9, 14, 3]), np.array([-3, -1, 0]), 9)
    assert got.tolist() == [1, 0, 0]
    with pytest.raises(ValueError, match="edited away"):
        leakage.leaks(None, "a", "b", None, "c", "d", 2, 9)


TARGETS = "source string, target_share double, max_repeats int"


def test_mixture(spark):
    data = [(i, "word " * (1 + i % 50), [" Big", "small", "Mid\t", None, "other"][0 if i % 3 == 0 else 1 if i % 50 == 1 else 2], 7) for i in range(1, 3000)]
    data += [(1, "word " * 2, " Big", 7), (5000, None, "small", 1), (5001, "", "small", 1), (5002, "x y", None, 1), (None, "x", "small", 1), (5003, "x", "unlisted", 1), (5004, "<|endoftext|> " * 50, "big", 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, n_tokens int")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.2, 4), ("mid", 0.25, 2), ("none", 0.05, 3)], TARGETS)
    picked, shares = mixture.mixture(df, "doc_id", "text", "source", targets)
    p, s = picked.toPandas(), shares.toPandas().set_index("source")
    assert p.doc_id.is_unique and not set(p.doc_id) & {5000, 5001, 5002, 5003}
    for name, most in (("big", 1), ("small", 4), ("mid", 2)):
        own, row = p[p.source == name], s.loc[name]
        assert own.repeats.between(1, most).all() and (own.n_tokens * own.repeats).sum() == row.picked_tokens
        assert abs(row.picked_tokens - row.budget_tokens) <= 26
        assert abs(row.actual_share - row.target_share / 0.95) < 0.01
    assert s.loc["none"].picked_tokens == 0 and abs(s.actual_share.sum() - 1) < 1e-9
    again, _ = mixture.mixture(df.repartition(7), "doc_id", "text", "source", targets)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, picked.collect()))


def test_mixture_cap_total_and_nothing(spark):
    df = spark.createDataFrame([(i, "a b c d", "s", 0) for i in range(10)], "doc_id long, text string, source string, repeats int")
    targets = spark.createDataFrame([("s", 1.0, 3), ("S ", 1.0, 2), ("t", None, None)], TARGETS)
    _, shares = mixture.mixture(df, "doc_id", "text", "source", targets, total_tokens=1000)
    assert shares.filter("source = 's'").first()["picked_tokens"] == 120
    picked, shares = mixture.mixture(df.limit(0), "doc_id", "text", "source", targets)
    assert picked.count() == 0 and [r["actual_share"] for r in shares.collect()] == [0.0, 0.0]
    picked, shares = mixture.mixture(df, "doc_id", "text", "source", targets.limit(0))
    assert picked.count() == 0 and shares.count() == 0
