"""Evaluation texts that stand in a corpus, by greedy string tiling."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.session import materialize

MIN_WORDS = 10
BLOCK_WINDOWS = 2_000_000
PAIRS = 4_000_000
WORD = r"[\p{L}\p{Nd}]+"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))

TILES = "doc_id bigint, item_id bigint, doc_at int, item_at int, words int, item_words int"


def word_finder():
    """text -> its words: maximal runs of Unicode letters and decimal digits, each in lower case."""
    import regex

    find = regex.compile(WORD).findall
    return lambda text: [w.lower() for w in find(text)] if text else []


def word_number(word: str) -> int:
    """A word as 64 bits, equal on every machine."""
    import xxhash

    return xxhash.xxh64_intdigest(word)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n - 1, 0), base), dtype=np.uint64)])[:n]


def window_hashes(numbers: np.ndarray, w: int) -> np.ndarray:
    """Running Karp-Rabin hash (mod 2^64, odd base) of every window of ``w`` numbers, in time independent of w."""
    n = len(numbers)
    if n < w:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        prefix = np.concatenate([[np.uint64(0)], np.cumsum(numbers * _powers(_BASE, n), dtype=np.uint64)])
        return (prefix[w:] - prefix[:-w]) * _powers(_INVERSE, n - w + 1)


def greedy_tiles(doc: np.ndarray, item: np.ndarray, runs: Sequence[tuple[int, int, int]], w: int) -> list[tuple[int, int, int]]:
    """Longest non-overlapping common stretches, given the maximal common stretches ``(doc_at, item_at, words)``.

    The longest is marked first (of equals the earliest); one that has lost words to a marked tile is cut, and what is
    left of it, if still ``w`` long, waits for its new length's turn. So every tile is maximal among unmarked words when
    it is marked. It ends when no ``w`` words of the item are unmarked in a row, however many stretches are left.
    """
    waiting = sorted((-size, i, j) for i, j, size in runs)
    cut: list[tuple[int, int, int]] = []
    in_doc, in_item = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    tiles, at = [], 0
    while at < len(waiting) or cut:
        if cut and (at >= len(waiting) or cut[0] < waiting[at]):
            size, i, j = heappop(cut)
        else:
            size, i, j = waiting[at]
            at += 1
        size = -size
        taken = in_doc[i : i + size] | in_item[j : j + size]
        if not taken.any():
            tiles.append((i, j, size))
            in_doc[i : i + size] = in_item[j : j + size] = True
            gone = np.concatenate([[0], np.cumsum(in_item)])
            if not (gone[w:] == gone[:-w]).any():
                break
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]])))
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if end - start >= w:
                heappush(cut, (start - end, i + start, j + start))
    return tiles


class ItemIndex:
    """The seeds of a set of evaluation items: window hash -> places, with the word before each place.

    A place matters only where a common stretch begins. Two equal windows with equal words before them lie inside a longer
    stretch, so of a document's window and an item's only pairs with different words before them are looked at; a page and an
    item that repeat one word have as many of those as they have words together, not as the product.
    """

    def __init__(self, items: Sequence[tuple[int, list[str]]], w: int):
        self.w, self.ids = w, [i for i, _ in items]
        vocabulary: dict[str, int] = {}
        for _, words in items:
            for x in words:
                vocabulary.setdefault(x, len(vocabulary) + 1)
        self.number = vocabulary
        self.mix = np.array([0, *map(word_number, vocabulary)], np.uint64)
        self.sizes = np.array([len(words) for _, words in items], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.flat = np.fromiter((vocabulary[x] for _, words in items for x in words), np.int32, int(self.sizes.sum()))
        places = [np.arange(e - n, e - w + 1) for e, n in zip(self.ends.tolist(), self.sizes.tolist()) if n >= w]
        place = np.concatenate(places) if places else np.zeros(0, np.int64)
        hashes = window_hashes(self.mix[self.flat], w)[place] if len(place) else np.zeros(0, np.uint64)
        first = np.isin(place, self.ends - self.sizes)
        before = np.where(first, -1, self.flat[np.maximum(place - 1, 0)]) if len(place) else np.zeros(0, np.int32)
        order = np.lexsort((place, before, hashes))
        self.place, self.before, hashes = place[order], before[order].astype(np.int64), hashes[order]
        self.seeds, self.start = np.unique(hashes, return_index=True)
        self.stop = np.append(self.start[1:], len(hashes))

    def _counts(self, seed: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each window of the documents, where its seed's places with the same word before them end, and how many lie on either side of those."""
        key = seed * (len(self.number) + 2) + before + 1
        known = np.repeat(np.arange(len(self.seeds)), self.stop - self.start) * (len(self.number) + 2) + self.before + 1
        low, high = np.searchsorted(known, key), np.searchsorted(known, key, side="right")
        return high, np.stack([low - self.start[seed], self.stop[seed] - high], axis=1).ravel()

    def _beginnings(self, seed: np.ndarray, high: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each window of the documents, the item places under its seed that have another word before them."""
        begin = np.stack([self.start[seed], high], axis=1).ravel()
        at = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        return np.repeat(np.arange(len(seed)), counts[::2] + counts[1::2]), self.place[at]

    def tiles(self, docs: Sequence[tuple[int, list[str]]]) -> Iterator[tuple[int, int, int, int, int, int]]:
        """Rows of ``TILES`` of a batch of documents; words that no item has separate the windows."""
        if not docs or not len(self.seeds):
            return
        get, w = self.number.get, self.w
        sizes = np.array([len(words) for _, words in docs], np.int64)
        words = np.fromiter((get(x, 0) for _, words in docs for x in words), np.int32, int(sizes.sum()))
        if len(words) < w:
            return
        ends = np.cumsum(sizes)
        starts = ends - sizes
        foreign = np.concatenate([[0], np.cumsum(words == 0)])
        whole = np.flatnonzero(foreign[w:] == foreign[:-w])
        hashes = window_hashes(self.mix[words], w)[whole]
        seed = np.minimum(np.searchsorted(self.seeds, hashes), len(self.seeds) - 1)
        hit = self.seeds[seed] == hashes
        whole, seed = whole[hit], seed[hit]
        owner = np.searchsorted(ends, whole, side="right")
        inside = whole + w <= ends[owner]
        whole, seed, owner = whole[inside], seed[inside], owner[inside]
        if not len(whole):
            return
        before = np.where(whole == starts[owner], 0, words[np.maximum(whole - 1, 0)]).astype(np.int64)
        high, counts = self._counts(seed, before)
        if counts.sum() > PAIRS and len(docs) > 1:
            # So that a few pages of repeated words do not fill the memory together.
            half = len(docs) // 2
            yield from self.tiles(docs[:half])
            yield from self.tiles(docs[half:])
            return
        which, place = self._beginnings(seed, high, counts)
        at, owner = whole[which], owner[which]
        item = np.searchsorted(self.ends, place, side="right")
        most = np.minimum(ends[owner] - at, self.ends[item] - place)
        step = 1 << 17
        length = np.concatenate([self._lengths(words, at[k : k + step], place[k : k + step], most[k : k + step]) for k in range(0, len(at), step)] or [np.zeros(0, np.int64)])
        good = length >= w
        at, owner, place, item, length = (x[good] for x in (at, owner, place, item, length))
        order = np.lexsort((item, owner))
        at, owner, place, item, length = (x[order] for x in (at, owner, place, item, length))
        new = np.flatnonzero(np.concatenate([[True], (np.diff(owner) != 0) | (np.diff(item) != 0)])) if len(at) else np.zeros(0, np.int64)
        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(at)]):
            d, i = int(owner[a]), int(item[a])
            from_doc, from_item = int(starts[d]), int(self.ends[i] - self.sizes[i])
            runs = list(zip((at[a:b] - from_doc).tolist(), (place[a:b] - from_item).tolist(), length[a:b].tolist()))
            mine, its = words[from_doc : ends[d]], self.flat[from_item : self.ends[i]]
            for x, y, size in greedy_tiles(mine, its, runs, w):
                yield docs[d][0], self.ids[i], x, y, size, len(its)

    def _lengths(self, words: np.ndarray, at: np.ndarray, place: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words agree from each pair of places on, ``most`` at most, word by word, all pairs at once."""
        length = np.zeros(len(at), np.int64)
        live = np.flatnonzero(most > 0)
        step = 16
        while len(live):
            # Blocks of growing width, so that long stretches take few rounds.
            width = int(min(step, (most[live] - length[live]).max()))
            reach = np.arange(width)
            left = most[live] - length[live]
            a = words[np.minimum(at[live, None] + length[live, None] + reach, len(words) - 1)]
            b = self.flat[np.minimum(place[live, None] + length[live, None] + reach, len(self.flat) - 1)]
            same = (a == b) & (a > 0) & (reach < left[:, None])
            run = np.where(same.all(axis=1), width, np.argmin(same, axis=1))
            length[live] += run
            live = live[(run == width) & (length[live] < most[live])]
            step = max(16, min(4096, (1 << 22) // max(1, len(live)), step * 4))
        return length


def _to_batches(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


_TILE_NAMES = ["doc_id", "item_id", "doc_at", "item_at", "words", "item_words"]
_TILE_KINDS = [pa.int64(), pa.int64(), *[pa.int32()] * 4]


def _tile(documents: DataFrame, items: list[tuple[int, str]], w: int) -> tuple[DataFrame, Broadcast]:
    """Tiles of every document with a block of items, and the block's index, which each worker loads once."""
    words = word_finder()
    index = documents.sparkSession.sparkContext.broadcast(ItemIndex([(i, words(t)) for i, t in items], w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = word_finder(), index.value
        for b in batches:
            for part in (b.slice(k, 2000) for k in range(0, b.num_rows, 2000)):
                docs = [(i, words(t)) for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
                yield from _to_batches(list(known.tiles(docs)), _TILE_NAMES, _TILE_KINDS)

    return documents.select("doc_id", "text").mapInArrow(run, TILES), index


def leaked_tiles(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Tiles of at least ``min_words`` words that an item shares with a document (``TILES``).

    Seeds are the windows of ``min_words`` words by running Karp-Rabin hash, joined and then compared word by word;
    tiles are laid greedily, longest first, so passages that were put in another order are found piece by piece.

    The items are taken in blocks of about ``block_windows`` windows (at most their characters / 2; an item that is larger is a
    block of its own), whose index goes to every worker; each block is one pass over the documents, which are tiled
    where they lie. Texts of documents are never shuffled, and no seed, however common, gathers rows in one task. A set of
    items that fits one block, as evaluation sets do, is one pass.

    Null and empty texts have no words. Items of fewer than ``min_words`` words have no windows and never leak. Rows with a
    null id are left out, repeated rows count once, different texts under one id are tiled each on its own. Extra columns
    are ignored; an empty side gives an empty result. Whole texts are read.
    """
    documents = documents.where("doc_id IS NOT NULL")
    kept = materialize(items.where("text IS NOT NULL AND item_id IS NOT NULL").select("item_id", "text").distinct(), "items")
    chars = kept.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(chars / (2 * block_windows)))
    if blocks == 1:
        return _tile(documents, sorted((r.item_id, r.text) for r in kept.collect()), min_words)[0].distinct()
    passes = []
    for block in range(blocks):
        mine = kept.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        if mine:
            # Written at once, so that no more than one index is held anywhere.
            tiles, index = _tile(documents, sorted((r.item_id, r.text) for r in mine), min_words)
            passes.append(materialize(tiles, "tiles"))
            index.destroy()
    return reduce(DataFrame.unionByName, passes).distinct()


def leaked_items(documents: DataFrame, items: DataFrame, min_coverage: float = 0.0, **options) -> DataFrame:
    """Per document and leaked item: ``(doc_id, item_id, tiles, longest, coverage)``.

    ``coverage`` is the share of the item's words that lie in tiles; pairs below ``min_coverage`` are left out. Tiles do
    not overlap in the item, so a share never exceeds 1 (unless one id has several texts, whose tiles add up), and the order
    of passages does not matter.
    """
    t = leaked_tiles(documents, items, **options).groupBy("doc_id", "item_id")
    t = t.agg(F.count("*").alias("tiles"), F.max("words").alias("longest"), (F.sum("words") / F.max("item_words")).alias("coverage"))
    return t.where(F.col("coverage") >= min_coverage)
