"""Subject areas of documents by class-association rules."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators.sizing import broadcast_if_small
from tidelog.session import materialize

LABELLED_DOCUMENTS = 8_000
MIN_SENTENCES, MIN_WORDS = 2, 20
MIN_SUPPORT, MIN_COUNT = 0.0002, 3
MIN_ODDS, MIN_GAIN = 5.0, 0.05
WORD_ODDS = 2.0
MAX_BODY = 4
SMOOTHING = 2.0
SUREST = 0.98
QUARTER = 0.25
MAX_SUBJECTS = 1_000
EVIDENCE_STEP, SHARE_STEP = 0.05, 0.001
FEWEST = 20

PATTERNS = "body array<int>, subject int, k_all double, n_all double, k_fit double, n_fit double"


def body_reader():
    """text -> its body paragraphs, each a list of sentences, each a list of words in lower case.

    A body paragraph is a line of at least two sentences and twenty words; menus, teasers, titles, footers, code and
    stray sentences are not. A sentence ends with a full stop, question or exclamation mark or an ellipsis before white
    space or the line's end. A word is a run of letters.
    """
    # The last letters of a sentence and its mark; abbreviations do no harm, as sentences are only units of words.
    ends = re.compile(r"(?<=[.!?…])[\"'»”’)]*\s+").split
    closed = re.compile(r"[.!?…][\"'»”’)]*$").search
    words = re.compile(r"[^\W\d_]+").findall

    def read(text: str | None) -> list[list[list[str]]]:
        out = []
        for line in (text or "").splitlines():
            line = line.strip()
            if len(line) < 2 * MIN_WORDS:
                continue
            parts = ends(line)
            # Every part but the last was cut off behind its mark.
            if len(parts) < MIN_SENTENCES or len(parts) - 1 + bool(closed(parts[-1])) < MIN_SENTENCES:
                continue
            sentences = [words(p.lower()) for p in parts]
            if sum(map(len, sentences)) >= MIN_WORDS:
                out.append(sentences)
        return out

    return read


@dataclass
class Rules:
    """``words -> subject`` with a weight each, found by their first word.

    ``levels, chances``: what a sentence's evidence is worth: the chance that its subject is the document's, a step function
    of the summed weights, as calibrated. ``cut``: of a paragraph's sentences, the mean chance that its subject needs.
    """

    by_word: dict[str, list[tuple[frozenset[str], int, float]]]
    subjects: list[str]
    cut: float = 0.25
    levels: tuple[float, ...] = (0.0,)
    chances: tuple[float, ...] = (0.0, 1.0)

    def evidence(self, sentence: list[str]) -> dict[int, float]:
        """Subject -> summed weight of the rules that match within a sentence."""
        out: dict[int, float] = {}
        told = self.by_word.keys() & sentence
        if told:
            held = None
            for w in told:
                for words, subject, weight in self.by_word[w]:
                    if len(words) > 1:
                        held = held or set(sentence)
                        if not words <= held:
                            continue
                    out[subject] = out.get(subject, 0.0) + weight
        return out

    def chance(self, evidence: float) -> float:
        return self.chances[bisect_right(self.levels, evidence)]

    def judge(self, sentences: list[list[str]]) -> tuple[int, float]:
        """A paragraph's best subject (-1: none) and its mean chance over the sentences; of equals the first subject is taken."""
        score: dict[int, float] = {}
        for s in sentences:
            for subject, e in self.evidence(s).items():
                score[subject] = score.get(subject, 0.0) + self.chance(e)
        top = max(score.values(), default=0.0)
        if top <= 0:
            return -1, 0.0
        return min(s for s, v in score.items() if v == top), top / len(sentences)

    def shares(self, body: list[list[list[str]]]) -> dict[int, float]:
        """Share of the body's words in paragraphs on each subject; a paragraph has its best subject, or none."""
        words: dict[int, int] = defaultdict(int)
        total = 0
        for p in body:
            size = sum(map(len, p))
            total += size
            best, chance = self.judge(p)
            if best >= 0 and chance >= self.cut:
                words[best] += size
        return {s: n / total for s, n in words.items()}


def consensus(labels: DataFrame) -> DataFrame:
    """``(doc_id, classes)``: subjects that at least half of a document's annotators gave; repeated rows count once."""
    said = labels.where("doc_id IS NOT NULL").select("doc_id", F.coalesce("annotator", F.lit("")).alias("annotator"), "subject").distinct()
    people = said.groupBy("doc_id").agg(F.countDistinct("annotator").alias("people"))
    votes = said.where("subject IS NOT NULL").groupBy("doc_id", "subject").agg(F.count("*").alias("votes"))
    both = people.join(votes, "doc_id", "left")
    given = F.collect_set(F.when(F.col("votes") * 2 >= F.col("people"), F.col("subject")))
    return both.groupBy("doc_id").agg(F.sort_array(given).alias("classes"))


def _paragraphs(labelled: DataFrame) -> DataFrame:
    """``(doc_id, classes, sentences)``: a row for each paragraph of each labelled body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = body_reader()
        for b in batches:
            out: tuple[list, ...] = ([], [], [])
            for doc, text, classes in zip(*(c.to_pylist() for c in b.columns)):
                for p in read(text):
                    for column, v in zip(out, (doc, classes, p)):
                        column.append(v)
            kinds = (pa.int64(), pa.list_(pa.string()), pa.list_(pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "classes", "sentences"])

    return labelled.select("doc_id", "text", "classes").mapInArrow(run, "doc_id bigint, classes array<string>, sentences array<array<string>>")


class Measure:
    """What makes a pattern a rule, for the two ways of counting: all sentences, and those not held out."""

    def __init__(self, least: np.ndarray, base: np.ndarray):
        self.least, self.base = least, base  # (2,) and (2, subjects)

    def confidence(self, k: np.ndarray, n: np.ndarray) -> np.ndarray:
        """``k``: (2, ..., subjects), ``n``: (2, ...); smoothed towards the base rate."""
        base = self.base.reshape(2, *[1] * (k.ndim - 2), -1)
        return np.minimum((k + SMOOTHING * base) / (n[..., None] + SMOOTHING), SUREST)

    def frequent(self, k: np.ndarray) -> np.ndarray:
        return k >= self.least.reshape(2, *[1] * (k.ndim - 1))

    def telling(self, confidence: np.ndarray, odds: float = MIN_ODDS) -> np.ndarray:
        base = self.base.reshape(2, *[1] * (confidence.ndim - 2), -1)
        return confidence * (1 - base) >= odds * base * (1 - confidence)


def grow(items: list[np.ndarray], classes: np.ndarray, weights: np.ndarray, counts: np.ndarray, alone: np.ndarray, mine: set[int], measure: Measure, max_body: int = MAX_BODY) -> list[tuple]:
    """Patterns of two to ``max_body`` words that may become rules, by depth-first growth of conditional bases.

    ``items``: each transaction's word numbers, ascending, the most frequent word being 0; ``classes``: (transactions,
    subjects) 0/1; ``weights``: (2, transactions) copies; ``counts``: (2, words) copies of the sentences that hold each single
    word (transactions that hold but one may be left out), ``alone``: (2, words, subjects) its confidence.
    Only patterns whose greatest (rarest) number is in ``mine`` are grown, so that groups share the work.

    Three cuts keep this from growing with 2^words, none of which loses a rule: a pattern with too few sentences of
    every subject goes no further; neither does one that a word has joined without making it rarer (the word is implied, so
    every further pattern is as confident as one without it); nor one whose subjects could not get ``MIN_GAIN`` more
    confident than a part of it already is, even if all its remaining sentences were right.
    """
    sizes = np.array([len(x) for x in items], np.int64)
    flat = np.concatenate(items) if len(items) else np.zeros(0, np.int64)
    start = np.cumsum(sizes) - sizes
    out: list[tuple] = []

    def extend(body: tuple[int, ...], rows: np.ndarray, stop: np.ndarray, n: np.ndarray, best: np.ndarray) -> None:
        lengths = stop - start[rows]
        if not lengths.sum():
            return
        owner = np.repeat(np.arange(len(rows)), lengths)
        at = np.arange(len(owner)) + np.repeat(start[rows] - (np.cumsum(lengths) - lengths), lengths)
        words, local = np.unique(flat[at], return_inverse=True)
        w = weights[:, rows][:, owner]
        n_w = np.stack([np.bincount(local, x, len(words)) for x in w])
        k = np.zeros((2, len(words), classes.shape[1]))
        here = classes[rows]
        for c in np.flatnonzero((weights[:, rows] @ here >= measure.least[:, None]).any(axis=0)):
            held = here[owner, c]
            for v in (0, 1):
                k[v, :, c] = np.bincount(local, w[v] * held, len(words))
        known = np.maximum(best[:, None, :], alone[:, words, :])
        # What confidence could still become: all of the pattern's sentences gone but those of the subject.
        reach = np.minimum((k + SMOOTHING * measure.base[:, None, :]) / (k + SMOOTHING), SUREST)
        hope = measure.frequent(k) & (reach >= known + MIN_GAIN)
        alive = hope.any(axis=(0, 2)) & (n_w[0] < n[0])
        for x in np.flatnonzero(alive):
            confidence = measure.confidence(k[:, x], n_w[:, x])
            rule = measure.frequent(k[:, x]) & measure.telling(confidence) & (confidence >= known[:, x] + MIN_GAIN)
            grown = (int(words[x]), *body)
            for c in np.flatnonzero(rule.any(axis=0)):
                out.append((grown, int(c), k[0, x, c], n_w[0, x], k[1, x, c], n_w[1, x]))
            further = np.maximum(known[:, x], confidence)
            if len(grown) < max_body and (measure.frequent(k[:, x]) & (reach[:, x] >= further + MIN_GAIN)).any():
                met = local == x
                extend(grown, rows[owner[met]], at[met], n_w[:, x], further)

    order = np.argsort(flat, kind="stable")
    owners = np.repeat(np.arange(len(items)), sizes)
    edges = np.searchsorted(flat[order], np.arange(alone.shape[1] + 1))
    for i in sorted(mine):
        places = order[edges[i] : edges[i + 1]]
        if len(places):
            rows = owners[places]
            extend((i,), rows, places, counts[:, i], alone[:, i, :])
    return out


def mine_rules(paragraphs: DataFrame, subjects: list[str], word_odds: float = WORD_ODDS, max_body: int = MAX_BODY) -> tuple[Rules, Rules]:
    """Rules of labelled sentences by parallel frequent-pattern growth, the redundant ones pruned: from all sentences, and from those not ``held``.

    ``paragraphs``: ``(classes, sentences, held)``. A transaction is a distinct sentence (its words and its document's
    subjects) with the number of its copies, all and not held out, so that one pass of mining serves both. Words are numbered by frequency and dealt
    to groups; each group gets of every transaction the part up to its last word of that group, and grows the patterns that
    end with its words (``grow``). Words that raise no subject's odds by ``word_odds`` are not mined.

    Frequent patterns with a subject whose odds they raise fivefold become rules; confidence is smoothed towards the subject's base rate.
    A rule is redundant if one with fewer of its words and the same subject is as confident within 0.05; most are cut off while
    growing, the rest before the rules leave the executors. A rule's weight is the log odds its match adds to the base rate.
    """
    nothing = Rules({}, subjects), Rules({}, subjects)
    number = {s: i for i, s in enumerate(subjects)}
    spark = paragraphs.sparkSession
    known = F.filter("classes", lambda c: c.isin(*subjects)) if subjects else F.array().cast("array<string>")
    rows = paragraphs.select(F.sort_array(known).alias("classes"), "held", F.explode("sentences").alias("words"))
    rows = rows.select("classes", "held", F.sort_array(F.array_distinct("words")).alias("words")).where("size(words) > 0")
    fit = F.sum(F.when(F.col("held"), 0).otherwise(1))
    sentences = materialize(rows.groupBy("words", "classes").agg(F.count("*").alias("w_all"), fit.alias("w_fit")), "sentences")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("w_all", "w_fit")]
    total = np.array(sentences.agg(*sums).first(), float)
    if not total[0] or not subjects:
        return nothing
    base = np.zeros((2, len(subjects)))
    for r in sentences.select(F.explode("classes").alias("c"), "w_all", "w_fit").groupBy("c").agg(*sums).collect():
        base[:, number[r.c]] = np.array([r.w_all, r.w_fit]) / np.maximum(total, 1)
    measure = Measure(np.maximum(MIN_COUNT, np.ceil(MIN_SUPPORT * total)), base)

    # Words frequent with some subject, at most (words of a sentence) / MIN_SUPPORT of them, with their counts.
    counted = sentences.select(F.explode("words").alias("w"), "classes", "w_all", "w_fit")
    support = counted.groupBy("w").agg(*sums).where(F.col("w_all") >= float(measure.least[0]))
    joint = counted.select("w", F.explode("classes").alias("c"), "w_all", "w_fit").groupBy("w", "c").agg(F.sum("w_all").alias("k_all"), F.sum("w_fit").alias("k_fit"))
    pairs = joint.where(F.col("k_all") >= float(measure.least[0])).join(support, "w").collect()
    words = sorted({(-r.w_all, r.w) for r in pairs})
    rank = {w: i for i, (_, w) in enumerate(words)}
    n, k = np.zeros((2, len(words))), np.zeros((2, len(words), len(subjects)))
    for r in pairs:
        n[:, rank[r.w]] = r.w_all, r.w_fit
        k[:, rank[r.w], number[r.c]] = r.k_all, r.k_fit
    alone = measure.confidence(k, n)
    single = measure.frequent(k) & measure.telling(alone)
    kept = np.flatnonzero((measure.frequent(k) & measure.telling(alone, word_odds)).any(axis=(0, 2)))
    alone, single, n, k = alone[:, kept], single[:, kept], n[:, kept], k[:, kept]
    names = [words[i][1] for i in kept]
    rank = {w: i for i, w in enumerate(names)}
    if not names:
        return nothing

    groups = max(2, spark.sparkContext.defaultParallelism)
    shared = spark.sparkContext.broadcast((rank, number, n, alone, measure))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, number, *_ = shared.value
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for words, classes, w_all, w_fit in zip(*(c.to_pylist() for c in b.columns)):
                items = sorted(rank[w] for w in words if w in rank)
                seen = set()
                for end in range(len(items), 1, -1):
                    if (g := items[end - 1] % groups) not in seen:
                        seen.add(g)
                        for column, v in zip(out, (g, items[:end], [number[c] for c in classes], w_all, w_fit)):
                            column.append(v)
            kinds = (pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["g", "items", "classes", "w_all", "w_fit"])

    def grown(frame: pd.DataFrame) -> pd.DataFrame:
        _, number, counts, alone, measure = shared.value
        classes = np.zeros((len(frame), len(number)))
        for i, c in enumerate(frame["classes"]):
            classes[i, c] = 1
        g = int(frame["g"].iloc[0])
        weights = frame[["w_all", "w_fit"]].to_numpy(float).T
        found = grow([np.asarray(x, np.int64) for x in frame["items"]], classes, weights, counts, alone, set(range(g, alone.shape[1], groups)), measure, max_body)
        return pd.DataFrame(found, columns=["body", "subject", "k_all", "n_all", "k_fit", "n_fit"])

    dealt = sentences.select("words", "classes", "w_all", "w_fit").mapInArrow(deal, "g int, items array<int>, classes array<int>, w_all bigint, w_fit bigint")
    longer = materialize(dealt.groupBy("g").applyInPandas(grown, PATTERNS), "patterns")

    def pruned(v: int, part: str) -> Rules:
        rows = [((i,), int(c), alone[v, i, c]) for i, c in zip(*np.nonzero(single[v]))]
        surest = {(body[0], c): p for body, c, p in rows}
        known = longer.where(F.col(f"k_{part}") >= float(measure.least[v]))
        rates = F.array(*(F.lit(float(x)) for x in base[v]))
        rate = F.get(rates, F.col("subject"))
        confidence = F.least((F.col(f"k_{part}") + SMOOTHING * rate) / (F.col(f"n_{part}") + SMOOTHING), F.lit(SUREST))
        known = known.select("body", "subject", confidence.alias("p")).where(F.col("p") * (1 - rate) >= MIN_ODDS * rate * (1 - F.col("p")))
        # Parts of a rule may have been grown in other groups.
        picks = "transform(sequence(1, shiftleft(1, size(body)) - 2), m -> filter(body, (x, i) -> (shiftright(m, i) & 1) = 1))"
        wider = known.where("size(body) > 2").select("body", "subject", F.explode(F.expr(picks)).alias("part")).where("size(part) > 1")
        general = known.select(F.col("body").alias("part"), "subject", F.col("p").alias("general"))
        beaten = wider.join(general, ["part", "subject"]).groupBy("body", "subject").agg(F.max("general").alias("general"))
        left = known.join(beaten, ["body", "subject"], "left").where(F.col("general").isNull() | (F.col("p") >= F.col("general") + MIN_GAIN))
        for r in left.select("body", "subject", "p").collect():
            if r.p >= max((surest.get((i, r.subject), 0.0) for i in r.body)) + MIN_GAIN:
                rows.append((tuple(r.body), r.subject, r.p))
        by_word: dict[str, list] = defaultdict(list)
        for body, c, p in sorted(rows, key=lambda x: (len(x[0]), x[0], x[1])):
            b = base[v, c]
            held = frozenset(names[i] for i in body)
            by_word[names[max(body)]].append((held, int(c), math.log(p / (1 - p)) - math.log(b / (1 - b))))
        return Rules(dict(by_word), subjects)

    return pruned(0, "all"), pruned(1, "fit")


def isotonic(levels: np.ndarray, n: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing fit of k/n over ascending levels: where each step begins, and its value."""
    blocks: list[list[float]] = []
    for level, size, hit in zip(levels, n, k):
        blocks.append([float(level), float(size), float(hit)])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            _, size2, hit2 = blocks.pop()
            blocks[-1][1] += size2
            blocks[-1][2] += hit2
    return np.array([b[0] for b in blocks]), np.array([b[2] / b[1] for b in blocks])


def calibrate_evidence(rules: Rules, levels: np.ndarray, n: np.ndarray, k: np.ndarray) -> Rules:
    """Rules whose evidence in a sentence counts as the chance, seen on held-out sentences, that its subject is the document's.

    Too few sentences leave every sentence with evidence counting in full.
    """
    if n.sum() < FEWEST:
        return rules
    begins, chances = isotonic(levels, n, k)
    # Below what was seen, evidence is worth what the least seen was; without evidence a sentence is worth nothing.
    begins[0] = min(begins[0], 0.0)
    return replace(rules, levels=tuple(begins.tolist()), chances=(0.0, *chances.tolist()))


def calibrate_cut(rules: Rules, levels: np.ndarray, n: np.ndarray, k: np.ndarray) -> Rules:
    """Rules whose cut is where a held-out paragraph's best subject is right more often than not; too few leave it as it is."""
    if n.sum() < FEWEST:
        return rules
    begins, chances = isotonic(levels, n, k)
    good = np.flatnonzero(chances >= 0.5)
    if not len(good):
        return rules
    below = levels[levels < begins[good[0]]]
    return replace(rules, cut=float((begins[good[0]] + below[-1]) / 2) if len(below) else 0.0)


def _histogram(held: DataFrame, tell, step: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``tell(sentences, classes)`` gives (level, right) pairs; their counts on a grid of ``step``: levels, all, right."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list[int]] = defaultdict(lambda: [0, 0])
        for b in batches:
            for sentences, classes in zip(*(c.to_pylist() for c in b.columns)):
                for level, right in tell(sentences, classes):
                    at = seen[round(level / step)]
                    at[0] += 1
                    at[1] += right
        columns = [list(seen), [v[0] for v in seen.values()], [v[1] for v in seen.values()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["at", "n", "k"])

    rows = held.select("sentences", "classes").mapInArrow(run, "at bigint, n bigint, k bigint").groupBy("at").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).orderBy("at").collect()
    return np.array([r["at"] * step for r in rows]), np.array([r.n for r in rows], float), np.array([r.k for r in rows], float)


def fit_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame, labelled_documents: int = LABELLED_DOCUMENTS, word_odds: float = WORD_ODDS) -> Rules:
    """Rules mined and calibrated on at most ``labelled_documents`` labelled documents, chosen by hash of their id.

    For calibration, rules from four fifths of the sample (by another hash) are tried on the rest, so that they are not judged
    on the sentences they were mined from; the rules that are used come from the whole sample.
    """
    names = [r.subject for r in subjects.where("subject IS NOT NULL").select("subject").distinct().orderBy("subject").limit(MAX_SUBJECTS + 1).collect()]
    if len(names) > MAX_SUBJECTS:
        raise ValueError(f"more than {MAX_SUBJECTS} subjects")
    sample = consensus(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled_documents)
    sample = broadcast_if_small(materialize(sample, "labels"), labelled_documents)
    # The sample's texts are few; dealt anew, all cores share the mining however few files they lay in.
    tasks = documents.sparkSession.sparkContext.defaultParallelism
    texts = documents.select("doc_id", "text").join(sample, "doc_id").repartition(tasks, "doc_id")
    held = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(5)) == 0
    paragraphs = materialize(_paragraphs(texts).withColumn("held", held), "paragraphs")
    rules, trial = mine_rules(paragraphs, names, word_odds)
    apart = paragraphs.where("held")

    def of_sentences(sentences, classes):
        return [(e, names[s] in classes) for x in sentences for s, e in trial.evidence(x).items()]

    seen = _histogram(apart, of_sentences, EVIDENCE_STEP)
    trial, rules = calibrate_evidence(trial, *seen), calibrate_evidence(rules, *seen)

    def of_paragraphs(sentences, classes):
        best, chance = trial.judge(sentences)
        return [(chance, names[best] in classes)] if best >= 0 else []

    return calibrate_cut(rules, *_histogram(apart, of_paragraphs, SHARE_STEP))


def document_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame, share: float = QUARTER, labelled_documents: int = LABELLED_DOCUMENTS, word_odds: float = WORD_ODDS) -> DataFrame:
    """``(doc_id, subject, share)``: subjects to which at least ``share`` of a document's body is devoted.

    Rules are fitted on a bounded sample of labelled documents (``fit_subjects``); every document is then scored from
    its whole text where it lies, without a shuffle. The weights of the rules that match in a sentence sum to its evidence for
    a subject, which calibration turns into a chance; a paragraph belongs to the subject with the greatest mean chance over its sentences if a
    paragraph with such a chance is more often right than not; a subject's share is that of its paragraphs' words.

    Null and empty texts, error pages and pages without body paragraphs have no subject. Labels that are null, of
    unknown documents or repeated do no harm; without usable labels there are no rules and no results. Subjects that
    are not in ``subjects`` are never given. A null doc_id is kept. Extra columns are ignored.
    """
    rules = documents.sparkSession.sparkContext.broadcast(fit_subjects(documents, labels, subjects, labelled_documents, word_odds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, known = body_reader(), rules.value
        for b in batches:
            out: tuple[list, list, list] = ([], [], [])
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for s, part in known.shares(read(text)).items():
                    if part >= share:
                        for column, v in zip(out, (doc, known.subjects[s], part)):
                            column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.string(), pa.float64()))], names=["doc_id", "subject", "share"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, subject string, share double")
