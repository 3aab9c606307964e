"""Tiles against brute force."""

import random

import pytest

from tidelog.llm.leakage import ItemIndex, leaked_items, leaked_tiles, window_hashes, word_finder, word_number

DOCS, ITEMS = "doc_id bigint, text string, item_id string", "item_id bigint, text string, doc_id string"


def brute_pairs(docs, items, w):
    words = word_finder()
    out = set()
    for d, text in docs:
        grams = {tuple(x[i : i + w]) for x in [words(text)] for i in range(len(x) - w + 1)}
        for i, t in items:
            x = words(t)
            if any(tuple(x[j : j + w]) in grams for j in range(len(x) - w + 1)):
                out.add((d, i))
    return out


def brute_tiles(doc, item, w):
    """Greedy string tiling as it is defined: mark the longest common unmarked stretch, again and again."""
    used_d, used_i, out = set(), set(), []
    while True:
        best = None
        for i in range(len(doc)):
            for j in range(len(item)):
                k = 0
                while i + k < len(doc) and j + k < len(item) and doc[i + k] == item[j + k] and i + k not in used_d and j + k not in used_i:
                    k += 1
                if k >= w and (best is None or (-k, i, j) < best):
                    best = (-k, i, j)
        if best is None:
            return out
        k, i, j = -best[0], best[1], best[2]
        used_d |= set(range(i, i + k))
        used_i |= set(range(j, j + k))
        out.append((i, j, k))


def make(seed):
    r = random.Random(seed)
    word = lambda: r.choice(["w%d" % i for i in range(300)] + ["été", "ÉTÉ", "x1"])
    items = [(i, " ".join(word() for _ in range(r.randrange(0, 40)))) for i in range(12)]
    items += [(50, None), (51, ""), (52, items[3][1] + " and more"), (53, " ".join(["la"] * 30))]
    docs = []
    for d in range(40):
        parts = [word() for _ in range(r.randrange(0, 60))]
        for _ in range(r.randrange(3)):
            source = (r.choice(items)[1] or "").split()
            a = r.randrange(len(source) + 1)
            at = r.randrange(len(parts) + 1)
            parts[at:at] = [x.upper() if r.random() < 0.2 else x for x in source[a : a + r.choice([8, 9, 10, 11, 25])]]
        docs.append((d, r.choice([" ", ", ", "\n", "_"]).join(parts)))
    docs += [(100, None), (101, ""), (102, "la " * 500), (103, "x" * 100_000 + " " + (items[5][1] or ""))]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_in_one_block_and_in_many(spark, seed):
    docs, items = make(seed)
    d = spark.createDataFrame([(*x, "clash") for x in docs], DOCS).repartition(3)
    i = spark.createDataFrame([(*x, "clash") for x in items], ITEMS)
    for windows in (10**6, 150):
        got = [(r.doc_id, r.item_id) for r in leaked_items(d, i, block_windows=windows).collect()]
        assert len(got) == len(set(got))
        assert set(got) == brute_pairs(docs, items, 10)
    here, there = (sorted(map(tuple, leaked_tiles(d, i, block_windows=n).collect())) for n in (10**6, 150))
    assert here == there


def test_tiles_are_greedy():
    r = random.Random(3)
    for _ in range(300):
        doc, item = ([r.choice("abcd"[: r.choice([1, 2, 4])]) for _ in range(r.randrange(1, 30))] for _ in range(2))
        doc = [x if r.random() < 0.95 else "other" for x in doc]
        w = r.choice([2, 3, 4])
        got = [t[2:5] for t in ItemIndex([(9, item)], w).tiles([(1, doc)])]
        assert got == brute_tiles(doc, item, w)


def test_repeated_words_take_bounded_time():
    import time

    began = time.time()
    item, page = ["la"] * 400, ["la"] * 200_000
    assert [t[2:] for t in ItemIndex([(1, item)], 10).tiles([(1, page)])] == [(0, 0, 400, 400)]
    song = "one two three four five six seven eight nine ten eleven twelve".split()
    item, page = song * 60, (song * 30 + ["other"]) * 500
    tiles = list(ItemIndex([(1, item)], 10).tiles([(1, page)]))
    assert sum(t[4] for t in tiles) == len(item)
    verses = [f"x{i}" for i in range(400)]
    item, page = [y for v in verses[:100] for y in (*song, v)], [y for v in verses[100:] * 20 for y in (*song, v)]
    tiles = list(ItemIndex([(1, item)], 10).tiles([(1, page)]))
    assert len(tiles) == 100 and {t[4] for t in tiles} == {12}
    assert time.time() - began < 30


def test_pages_are_taken_apart_when_they_hold_too_many_pairs(monkeypatch):
    from tidelog.llm import leakage

    r = random.Random(6)
    word = lambda: r.choice("abc")
    docs, item = [(d, [word() for _ in range(60)]) for d in range(9)], [word() for _ in range(40)]
    whole = list(ItemIndex([(1, item)], 3).tiles(docs))
    monkeypatch.setattr(leakage, "PAIRS", 50)
    assert list(ItemIndex([(1, item)], 3).tiles(docs)) == whole


def test_texts_of_documents_are_not_exchanged(spark):
    d = spark.createDataFrame([(1, "a " * 30, "")], DOCS)
    i = spark.createDataFrame([(k, f"w{k} " * 30, "") for k in range(40)], ITEMS)
    for windows in (10**6, 100):
        text = leaked_items(d, i, block_windows=windows)._jdf.queryExecution().executedPlan().toString()
        assert not [line for line in text.splitlines() if "Exchange" in line and "text" in line]


def test_reordered_passages_are_covered(spark):
    item = [f"w{i}" for i in range(40)]
    doc = " ".join(item[25:] + ["other"] + item[:25])
    out = leaked_items(spark.createDataFrame([(1, doc, "")], DOCS), spark.createDataFrame([(7, " ".join(item), "")], ITEMS), min_coverage=0.99).collect()
    assert [(r.doc_id, r.item_id, r.tiles, r.longest, r.coverage) for r in out] == [(1, 7, 2, 25, 1.0)]


def test_nine_words_are_not_enough_and_windows_do_not_cross_documents(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = [(1, " ".join(f"w{i}" for i in range(9)), ""), (2, " ".join(f"w{i}" for i in range(9, 18)), ""), (3, "W0. w1! w2_w3-w4\nw5;w6 w7 w8 w9", "")]
    d = spark.createDataFrame(docs, DOCS).coalesce(1)
    for windows in (10**6, 150):
        got = leaked_items(d, spark.createDataFrame([(7, item, "")], ITEMS), block_windows=windows).collect()
        assert [(r.doc_id, r.longest) for r in got] == [(3, 10)]


def test_null_ids_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(12))
    d = spark.createDataFrame([(1, text, ""), (1, text, ""), (None, text, ""), (2, None, "")], DOCS)
    i = spark.createDataFrame([(7, text, ""), (7, text, ""), (7, "other words", ""), (None, text, "")], ITEMS)
    for windows in (10**6, 150):
        got = leaked_items(d, i, block_windows=windows).collect()
        assert [(r.doc_id, r.item_id, r.tiles, r.coverage) for r in got] == [(1, 7, 1, 1.0)]


def test_empty_tables(spark):
    d, i = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    one = spark.createDataFrame([(1, "a " * 30, "")], ITEMS)
    for windows in (10**6, 5):
        assert leaked_items(d, one, block_windows=windows).count() == 0
        assert leaked_items(one.select("item_id", "text").withColumnRenamed("item_id", "doc_id"), i, block_windows=windows).count() == 0


def test_running_hash_equals_itself_anywhere():
    import numpy as np

    numbers = np.array([word_number(x) for x in "a b c d e a b c d e f".split()], np.uint64)
    h = window_hashes(numbers, 4)
    assert h[0] == h[5] and h[1] == h[6] and len(set(h.tolist())) == 6
    assert len(window_hashes(numbers[:3], 4)) == 0
