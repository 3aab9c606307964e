"""Subject rules on an invented corpus with known shares, and on held-out labels."""

import os
import random
from collections import defaultdict

import pytest

from tidelog.llm.subjects import Rules, body_reader, calibrate_cut, calibrate_evidence, consensus, document_subjects, mine_rules

DOCS, LABELS, SUBJECTS = "doc_id bigint, text string, subject string", "doc_id bigint, subject string, annotator string, extra int", "subject string, text string"
PARAGRAPHS = "classes array<string>, sentences array<array<string>>, held boolean"
NAMES = ["law", "sport", "cooking"]
PLAIN = [f"plain{chr(97 + i)}" for i in range(20)]
TOPIC = {s: [f"{s}{chr(97 + i)}" for i in range(12)] for s in NAMES}


def paragraph(r, subject, sentences=4):
    out = []
    for _ in range(sentences):
        words = r.choices(PLAIN, k=8) + (r.choices(TOPIC[subject], k=2) if subject else r.choices(PLAIN, k=2))
        r.shuffle(words)
        out.append(" ".join(words).capitalize() + r.choice(".?!"))
    return " ".join(out)


def corpus(seed, n):
    r = random.Random(seed)
    docs, labels, truth = [], [], set()
    for d in range(n):
        parts = [r.choice([*NAMES, None]) for _ in range(r.choice([1, 2, 4]))]
        text = "Home | Sport | Law\n" + "\n".join(paragraph(r, s) for s in parts) + f"\n• {r.choice(TOPIC['law'])} and more\n© 2030 All rights reserved"
        right = {s for s in parts if s and parts.count(s) / len(parts) >= 0.25}
        truth |= {(d, s) for s in right}
        for a in range(r.choice([0, 1, 2])):
            said = {s for s in right if r.random() < 0.9} | ({r.choice(NAMES)} if r.random() < 0.05 else set())
            labels += [(d, s, f"ann{a}", 0) for s in said or {None}] * r.choice([1, 2])
        docs.append((d, text, "clash"))
    return docs, labels, truth


def frames(spark, docs, labels):
    return (
        spark.createDataFrame(docs, DOCS).repartition(3),
        spark.createDataFrame(labels, LABELS),
        spark.createDataFrame([(s, "words about it") for s in [*NAMES, None]], SUBJECTS),
    )


def test_shares_of_unlabelled_documents(spark):
    docs, labels, truth = corpus(1, 400)
    odd = [(1000, None, ""), (1001, "", ""), (1002, "Sorry, the page you are looking for could not be found.", ""), (1003, " ".join(TOPIC["law"]) * 3, "")]
    got = {(r.doc_id, r.subject) for r in document_subjects(*frames(spark, docs + odd, labels + [(5000, "law", "a", 0), (None, "law", "a", 0), (3, "unknown", "z", 0)])).collect()}
    assert not {d for d, _ in got} & {1000, 1001, 1002, 1003}
    assert len(got & truth) / len(truth) > 0.97 and len(got & truth) / len(got) > 0.97


def test_without_usable_labels_or_documents(spark):
    docs, labels, _ = corpus(2, 20)
    assert document_subjects(*frames(spark, docs, [])).count() == 0
    assert document_subjects(*frames(spark, docs, [(1, None, "a", 0)])).count() == 0
    assert document_subjects(*frames(spark, [], labels)).count() == 0


def test_consensus(spark):
    rows = [(1, "law", "a", 0), (1, "law", "a", 0), (1, "sport", "a", 0), (1, "law", "b", 0), (1, "cooking", "c", 0), (2, None, "a", 0), (3, "law", None, 0)]
    got = {r.doc_id: r.classes for r in consensus(spark.createDataFrame(rows, LABELS)).collect()}
    assert got == {1: ["law"], 2: [], 3: ["law"]}


def test_redundant_rules_are_pruned_and_useful_pairs_stay(spark):
    # "court" alone is torn between two subjects, with "verdict" or "net" it is not; "judge" needs no company.
    rows = [("court verdict x", ["law"])] * 40 + [("court net x", ["sport"])] * 40 + [("court judge", ["law"])] * 20 + [("judge x", ["law"])] * 20
    rows += [("verdict", ["law"])] * 10 + [("verdict x", ["cooking"])] * 25 + [("net", ["cooking"])] * 25 + [("x y", ["cooking"])] * 200
    df = spark.createDataFrame([(c, [t.split()], False) for t, c in rows], PARAGRAPHS)
    rules, fit = mine_rules(df, NAMES)
    assert rules.by_word == fit.by_word
    found = {(tuple(sorted(words)), rules.subjects[s]) for v in rules.by_word.values() for words, s, _ in v}
    assert (("judge",), "law") in found and (("court", "judge"), "law") not in found
    assert (("court", "verdict"), "law") in found and (("court", "net"), "sport") in found
    assert rules.judge([["court", "verdict"], ["x"]])[0] == NAMES.index("law")
    assert rules.judge([["court", "net"]])[0] == NAMES.index("sport")
    assert rules.judge([["unknown"]]) == (-1, 0.0)


def brute_rules(transactions, subjects, max_body=3):
    """Every pattern counted one by one; (words, subject) of the rules no part of which is as confident within 0.05."""
    from itertools import combinations

    from tidelog.llm.subjects import MIN_COUNT, MIN_GAIN, MIN_ODDS, SMOOTHING

    transactions = [t for t in transactions if t[0]]
    total, n, k = len(transactions), defaultdict(int), defaultdict(int)
    base = {c: sum(c in cs for _, cs in transactions) / total for c in subjects}
    for words, cs in transactions:
        for m in range(1, max_body + 1):
            for x in combinations(sorted(set(words)), m):
                n[x] += 1
                for c in cs:
                    k[x, c] += 1
    sure = {(x, c): min((h + SMOOTHING * base[c]) / (n[x] + SMOOTHING), 0.98) for (x, c), h in k.items() if h >= MIN_COUNT}
    out = set()
    for (x, c), p in sure.items():
        parts = [sure.get((y, c), 0) for m in range(1, len(x)) for y in combinations(x, m)]
        if p * (1 - base[c]) >= MIN_ODDS * base[c] * (1 - p) and all(p >= q + MIN_GAIN for q in parts):
            out.add((x, c))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_growth_finds_what_counting_finds(spark, seed):
    r = random.Random(seed)
    rows = []
    for _ in range(700):
        c = r.choice(NAMES)
        lean = [w for w in "abcdefgh" if r.random() < (0.7 if ord(w) % 3 == NAMES.index(c) else 0.25)]
        rows.append((lean, [c] if r.random() < 0.8 else []))
    df = spark.createDataFrame([(c, [w], False) for w, c in rows], PARAGRAPHS)
    rules, _ = mine_rules(df, NAMES, word_odds=0.0, max_body=3)
    found = {(tuple(sorted(words)), rules.subjects[s]) for v in rules.by_word.values() for words, s, _ in v}
    assert found == brute_rules(rows, NAMES) and any(len(x) > 1 for x, _ in found)


def test_mirrored_sentence_of_forty_words_does_not_explode(spark):
    import time

    r = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    rows = [(r.sample(words, 2) + r.sample(PLAIN, 4), ["law"]) for _ in range(1500)] + [(r.sample(PLAIN, 6), ["sport"]) for _ in range(4000)]
    rows += [(words, ["law"])] * 3
    df = spark.createDataFrame([(c, [w], False) for w, c in rows], PARAGRAPHS)
    began = time.time()
    rules, _ = mine_rules(df, NAMES)
    assert time.time() - began < 60
    assert {w for v in rules.by_word.values() for x, _, _ in v for w in x} >= set(words)


def test_calibrated_evidence_and_cut():
    import numpy as np

    level = np.array([1.0, 2.0, 3.0, 4.0])
    rules = calibrate_evidence(Rules({}, NAMES), level, np.array([50.0, 50, 50, 50]), np.array([10.0, 30, 20, 50]))
    assert [rules.chance(e) for e in (-0.5, 0.5, 1.5, 2.5, 3.5, 4.5)] == [0, 0.2, 0.2, 0.5, 0.5, 1.0]
    assert calibrate_evidence(Rules({}, NAMES), level, np.array([1.0] * 4), np.array([1.0] * 4)) == Rules({}, NAMES)
    share = np.array([0.2, 0.5, 1.0])
    assert calibrate_cut(Rules({}, NAMES), share, np.array([30.0, 30, 60]), np.array([3.0, 25, 55])).cut == pytest.approx(0.35)
    assert calibrate_cut(Rules({}, NAMES), share, np.array([1.0, 1, 1]), np.array([0.0, 1, 1])).cut == Rules({}, NAMES).cut


def test_body():
    read = body_reader()
    menu = "Home | News | Science | Law | Sport | Software | Contact"
    one = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty twenty-one."
    two = "One two three four five six seven eight nine ten. “Eleven twelve 13 thirteen fourteen fifteen sixteen seventeen, eighteen nineteen twenty twenty-one!”"
    assert read(f"{menu}\n{one}\n\n{two}\n") == [[two.split(". ")[0].lower().split(), "eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty twenty one".split()]]
    assert read(None) == read("") == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test data")
def test_held_out_labels(spark):
    """Rules from half of the labelled documents must agree with the labels of the other half."""
    d = "/root/testdata/sf0.1"
    docs, labels, subjects = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "subject_labels", "subjects"))
    got = defaultdict(set)
    for r in document_subjects(docs, labels.where("doc_id % 2 = 0"), subjects).collect():
        got[r.doc_id].add(r.subject)
    votes = {r.doc_id: set(r.classes) for r in consensus(labels.where("doc_id % 2 = 1")).collect()}
    hit = sum(len(got[i] & v) for i, v in votes.items())
    # People miss about one in ten; mirrored pages were labelled apart.
    assert hit / sum(map(len, votes.values())) > 0.9
    assert hit / sum(len(got[i]) for i in votes) > 0.85
