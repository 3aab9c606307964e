"""Encoding a corpus by byte-level BPE through merge replay."""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator, Sequence
from heapq import heapify, heappop, heappush
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

BLOCK_CHARS = 8_000_000
KNOWN_WORDS = 1_000_000

# The pre-tokeniser of byte_bpe_50k. White space is written out, as \s of the regex library is wider.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    r"| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = count(256)
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Merges:
    """Merge table of a vocabulary file: ``pair -> (rank, id of the result)``, and the id of each byte."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))["model"]
        vocab = model["vocab"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.of = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.bytes = [vocab[c] for c in byte_alphabet()]


def replay(words: Sequence[str], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words at once, flat, and how many each word has.

    The words lie end to end in one linked list of symbols. An inverted index holds, for every pair of adjacent
    symbols that can merge, the positions of its left symbols in all words. Merges are taken in rank order; each
    goes to its positions from left to right, replaces two symbols by one, and enters the two pairs that the new
    symbol forms with its neighbours. Nothing else is looked at again. A position whose pair an earlier merge has
    changed is passed over.
    """
    table, of = merges.bytes, merges.of
    symbol: list[int] = []
    border = [0]
    for w in words:
        symbol.extend(table[b] for b in w.encode())
        border.append(len(symbol))
    n = len(symbol)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    for end in border[1:]:
        after[end - 1] = -1
    for start in border[:-1]:
        if start < n:
            before[start] = -1
    index: dict[int, list[int]] = {}
    pair_of: dict[int, tuple[int, int, int]] = {}
    for i, j in enumerate(after):
        if j >= 0 and (m := of.get((symbol[i], symbol[j]))):
            if (at := index.get(m[0])) is None:
                index[m[0]] = [i]
                pair_of[m[0]] = (symbol[i], symbol[j], m[1])
            else:
                at.append(i)
    ranks = list(index)
    heapify(ranks)
    while ranks:
        rank = heappop(ranks)
        a, b, merged = pair_of[rank]
        for i in sorted(index.pop(rank)):
            j = after[i]
            if symbol[i] != a or j < 0 or symbol[j] != b:
                continue
            symbol[i], symbol[j] = merged, -1
            k = after[i] = after[j]
            h = before[i]
            if k >= 0:
                before[k] = i
                if m := of.get((merged, symbol[k])):
                    if m[0] in index:
                        index[m[0]].append(i)
                    else:
                        index[m[0]] = [i]
                        pair_of[m[0]] = (merged, symbol[k], m[1])
                        heappush(ranks, m[0])
            if h >= 0 and (m := of.get((symbol[h], merged))):
                if m[0] in index:
                    index[m[0]].append(h)
                else:
                    index[m[0]] = [h]
                    pair_of[m[0]] = (symbol[h], merged, m[1])
                    heappush(ranks, m[0])
    flat = np.array(symbol, np.int32)
    alive = flat >= 0
    ends = np.concatenate([[0], np.cumsum(alive)])[border]
    return flat[alive], np.diff(ends)


class Encoder:
    """Words met so far with their ids; a block of texts adds its new words in one replay."""

    def __init__(self, path: str, known_words: int = KNOWN_WORDS):
        import regex

        self.find, self.merges, self.limit = regex.compile(PATTERN).findall, Merges(path), known_words
        self._forget()

    def _forget(self):
        self.number = defaultdict(count().__next__)
        self.flat, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and the count of each text. Null and empty texts have none."""
        if len(self.number) > self.limit:
            self._forget()
        old, number = len(self.size), self.number.__getitem__
        words = [np.fromiter(map(number, self.find(t)), np.int64) if t else np.zeros(0, np.int64) for t in texts]
        if len(self.number) > old:
            flat, size = replay(list(self.number)[old:], self.merges)
            self.flat, self.size = np.concatenate([self.flat, flat]), np.concatenate([self.size, size])
        start = np.cumsum(self.size) - self.size
        every = np.concatenate(words) if words else np.zeros(0, np.int64)
        size = self.size[every]
        shift = np.repeat(start[every] - (np.cumsum(size) - size), size)
        ids = self.flat[shift + np.arange(len(shift))]
        ends = np.cumsum([0, *(len(w) for w in words)])
        return ids, np.diff(np.concatenate([[0], np.cumsum(size)])[ends])


_encoders: dict[str, Encoder] = {}


def _blocks(texts: list[str | None], limit: int) -> Iterator[tuple[int, int]]:
    """Stretches of texts with at most ``limit`` characters; a longer text stands alone, whole."""
    start = held = 0
    for i, t in enumerate(texts):
        size = len(t or "")
        if i > start and held + size > limit:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(texts):
        yield start, len(texts)


def encode_corpus(documents: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(id_col, ids)``: the token ids of each text, special tokens being plain text.

    The corpus is taken in blocks of about ``block_chars`` characters. Each block's distinct words, over all its
    documents, are replayed together (``replay``); how a word merges depends on the word alone, so the result does not
    depend on how the corpus is cut, and nothing is shuffled, broadcast or collected. Words known from earlier blocks of
    the same worker are not replayed again, up to a bound on memory.

    Null and empty texts give an empty list. Repeated rows stay repeated; a null id stays null; a text of any length is
    encoded whole. ``vocabulary`` is the path of the vocabulary file, the same on all executors.
    """
    schema = T.StructType([documents.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(vocabulary) or _encoders.setdefault(vocabulary, Encoder(vocabulary))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, end in _blocks(texts, block_chars):
                ids, sizes = encoder.encode(texts[start:end])
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), lists], names=[id_col, "ids"])

    return documents.select(id_col, text_col).mapInArrow(run, schema)
