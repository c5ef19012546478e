"""Evaluation passages inside training documents, by an FM-index per shard.

Texts are sequences of words (runs of ASCII letters and digits, lower case).
Each shard of documents becomes one word string over the alphabet of the test
items' words; words no item uses end a run, and runs shorter than the phrase
length can hold no match and are left out.  The shard's suffixes are sorted to
the depth of a phrase, its Burrows-Wheeler transform is kept in a wavelet tree
of bit planes with rank counts, and all phrases of all items are searched
backward at once, one word per step, through tree ranks; phrases whose range
becomes empty drop out.  Occurrences are located by walking back to the next
sampled suffix position, and overlapping ones are merged to removal spans.

Items are taken in blocks of bounded size, each against all documents, so
neither side need fit one task.

Defined results: items shorter than the phrase hold no case; null texts hold
no words; rows without an id are left out; a document delivered twice is reported once; equal items are each
reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = 15
SHARD_WORDS = 1_000_000
SAMPLE = 16
BLOCK_CHARS = 8_000_000
_WORD = re.compile(r"[A-Za-z0-9]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text and text.isascii() else [w.lower() for w in _WORD.findall(text or "")]


class WaveletTree:
    """Ranks of symbols in a sequence, by bit planes sorted stably from the top bit."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.bits = max(1, int(symbols - 1).bit_length())
        self.planes, self.zeros = [], []
        for b in range(self.bits - 1, -1, -1):
            ones = (seq >> b & 1).astype(bool)
            self.planes.append(np.concatenate(([0], np.cumsum(ones, dtype=np.int32))).astype(np.int32))
            self.zeros.append(len(seq) - int(self.planes[-1][-1]))
            seq = np.concatenate((seq[~ones], seq[ones]))

    def rank(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start of each symbol's block and its counts before ``lo`` and ``hi``."""
        start = np.zeros(len(symbol), dtype=np.int64)
        for plane, zeros, b in zip(self.planes, self.zeros, range(self.bits - 1, -1, -1)):
            one = (symbol >> b & 1).astype(bool)
            s1, l1, h1 = plane[start], plane[lo], plane[hi]
            start = np.where(one, zeros + s1, start - s1)
            lo = np.where(one, zeros + l1, lo - l1)
            hi = np.where(one, zeros + h1, hi - h1)
        return start, lo - start, hi - start

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols at positions, and the symbols' counts before them."""
        symbol = np.zeros(len(at), dtype=np.int64)
        start = np.zeros(len(at), dtype=np.int64)
        for plane, zeros in zip(self.planes, self.zeros):
            one = plane[at + 1] > plane[at]
            symbol = symbol << 1 | one
            start = np.where(one, zeros + plane[start], start - plane[start])
            at = np.where(one, zeros + plane[at], at - plane[at])
        return symbol, at - start


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of ``seq`` in order, by prefix doubling over unresolved groups only."""
    n = len(seq)
    order = np.argsort(seq, kind="stable")
    sorted_seq = seq[order]
    begin = np.concatenate(([True], sorted_seq[1:] != sorted_seq[:-1]))
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(begin, np.arange(n), 0))
    width = 1
    slots = np.arange(n)
    while True:
        r = rank[order[slots]]
        same = np.concatenate((r[1:] == r[:-1], [False]))
        tied = same | np.concatenate(([False], same[:-1]))
        slots = slots[tied]
        if not len(slots) or width >= n:
            return order
        at = order[slots]
        group, nxt = rank[at], rank[np.minimum(at + width, n)]
        by = np.argsort(group * (n + 2) + nxt + 1, kind="stable")
        at, group, nxt = at[by], group[by], nxt[by]
        order[slots] = at
        fresh = np.concatenate(([True], (group[1:] != group[:-1]) | (nxt[1:] != nxt[:-1])))
        rank[at] = np.maximum.accumulate(np.where(fresh, slots, 0))
        width *= 2


class FMIndex:
    """FM-index of a word string: first-column counts, wavelet tree of the last column, sampled positions."""

    def __init__(self, seq: np.ndarray, symbols: int):
        # A least symbol of its own ends the string, so that steps back agree with the order of suffixes.
        seq, symbols = np.append(seq + 1, 0), symbols + 1
        order = suffix_order(seq)
        self.n = len(seq)
        self.tree = WaveletTree(seq[order - 1].astype(np.int64), symbols)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=symbols))))
        # The first position is always sampled, so that no walk crosses the end of the string.
        sampled = order % SAMPLE == 0
        self.is_sampled = np.concatenate(([0], np.cumsum(sampled))).astype(np.int32)
        self.samples = order[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, lo, hi): the suffix ranges of the phrases that occur, each a row of word ids."""
        alive = np.arange(len(phrases))
        last = phrases[:, -1] + 1
        lo, hi = self.first[last], self.first[last + 1]
        for step in range(phrases.shape[1] - 2, -1, -1):
            keep = lo < hi
            alive, lo, hi = alive[keep], lo[keep], hi[keep]
            if not len(alive):
                break
            symbol = phrases[alive, step] + 1
            _, before, until = self.tree.rank(symbol, lo, hi)
            lo, hi = self.first[symbol] + before, self.first[symbol] + until
        keep = lo < hi
        return alive[keep], lo[keep], hi[keep]

    def locate(self, slots: np.ndarray) -> np.ndarray:
        """Text positions of suffix slots: steps back to a sampled position are counted and added."""
        out = np.empty(len(slots), dtype=np.int64)
        steps = np.zeros(len(slots), dtype=np.int64)
        todo, at = np.arange(len(slots)), slots.copy()
        while len(todo):
            hit = self.is_sampled[at + 1] > self.is_sampled[at]
            out[todo[hit]] = self.samples[self.is_sampled[at[hit]]] + steps[todo[hit]]
            todo, at = todo[~hit], at[~hit]
            steps[todo] += 1
            symbol, before = self.tree.access(at)
            at = self.first[symbol] + before
        return out


class Phrases:
    """Distinct phrases of ``length`` words of a block of items, as rows of word ids."""

    def __init__(self, items: list[tuple[int, str | None]], length: int):
        self.length = length
        self.vocabulary: dict[str, int] = {}
        rows, owners = [], []
        for item, text in items:
            words = words_of(text)
            if len(words) >= length:
                ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], dtype=np.int32)
                windows = np.lib.stride_tricks.sliding_window_view(ids, length)
                rows.append(windows)
                owners.append(np.full(len(windows), item, dtype=np.int64))
        every = np.ascontiguousarray(np.concatenate(rows)) if rows else np.zeros((0, length), dtype=np.int32)
        owner = np.concatenate(owners) if rows else np.zeros(0, dtype=np.int64)
        _, index, inverse = np.unique(every.view(f"V{4 * length}").ravel(), return_index=True, return_inverse=True)
        self.rows = every[index].astype(np.int64)
        by = np.argsort(inverse, kind="stable")
        self.items = owner[by]  # the items of phrase i stand at starts[i]:starts[i + 1]
        self.starts = np.searchsorted(inverse[by], np.arange(len(index) + 1))


def shard_hits(docs: list[int], ids: list[np.ndarray], phrases: Phrases) -> Iterator[tuple[np.ndarray, ...]]:
    """(item, doc, first word, last word) of the maximal runs of phrase hits in one shard."""
    lengths = np.array([len(x) + 1 for x in ids])
    whole = np.concatenate([y for x in ids for y in (x, _BREAK)])
    # Runs of known words, a zero before and after each.
    zero = np.flatnonzero(np.concatenate(([True], whole == 0)))
    long_enough = np.repeat(np.diff(np.append(zero, len(whole) + 1)) > phrases.length, np.diff(np.append(zero, len(whole) + 1)))[1:]
    keep = np.flatnonzero(long_enough)
    if not len(keep):
        return
    gap = np.concatenate(([False], np.diff(keep) > 1))
    seq = whole[keep]
    seq = np.where(gap, 0, seq) if not (seq[gap] != 0).any() else np.insert(seq, np.flatnonzero(gap), 0)
    where = keep if len(seq) == len(keep) else np.insert(keep, np.flatnonzero(gap), -1)
    index = FMIndex(seq, len(phrases.vocabulary) + 1)
    found, lo, hi = index.search(phrases.rows)
    count = hi - lo
    if not len(found):
        return
    slots = np.repeat(lo - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
    at = where[index.locate(slots)]
    phrase = np.repeat(found, count)
    owners = phrases.starts[phrase + 1] - phrases.starts[phrase]
    item = phrases.items[np.repeat(phrases.starts[phrase] - np.concatenate(([0], np.cumsum(owners)[:-1])), owners) + np.arange(owners.sum())]
    at = np.repeat(at, owners)
    by = np.lexsort((at, item))
    item, at = item[by], at[by]
    begin = np.concatenate(([True], (item[1:] != item[:-1]) | (at[1:] > at[:-1] + phrases.length)))
    head = np.flatnonzero(begin)
    tail = np.concatenate((head[1:], [len(at)])) - 1
    starts = np.concatenate(([0], np.cumsum(lengths)))
    doc = np.searchsorted(starts, at[head], side="right") - 1
    # Hits of two documents never touch: a break stands between them and hits hold no break.
    split = doc != np.searchsorted(starts, at[tail], side="right") - 1
    assert not split.any()
    yield item[head], np.array(docs)[doc], at[head] - starts[doc], at[tail] + phrases.length - 1 - starts[doc]


_BREAK = np.zeros(1, dtype=np.int32)
SCHEMA = "item_id bigint, doc_id bigint, first_word int, last_word int"


def _search_block(documents: DataFrame, items: list[tuple[int, str | None]], length: int, shard_words: int) -> DataFrame:
    session = documents.sparkSession.sparkContext
    shared = session.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(shared.value, length)
        get = phrases.vocabulary.get
        docs: list[int] = []
        ids: list[np.ndarray] = []
        words = 0

        def flush():
            for item, doc, first, last in shard_hits(docs, ids, phrases):
                yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(doc), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], names=["item_id", "doc_id", "first_word", "last_word"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = words_of(text)
                if len(own) < length or doc is None:
                    continue
                docs.append(doc)
                ids.append(np.array([get(w, 0) for w in own], dtype=np.int32))
                words += len(own)
                if words >= shard_words:
                    yield from flush()
                    docs, ids, words = [], [], 0
        if docs:
            yield from flush()

    return documents.select("doc_id", "text").mapInArrow(run, SCHEMA)


def leaks(documents: DataFrame, heldout: DataFrame, *, length: int = WORDS, shard_words: int = SHARD_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(item_id, doc_id, first_word, last_word): the runs of an item's phrases in each document."""
    chars = heldout.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    out = None
    for block in range(blocks):
        part = heldout.filter("item_id is not null").select("item_id", "text")
        if blocks > 1:
            part = part.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        found = _search_block(documents, [tuple(r) for r in part.distinct().collect()], length, shard_words)
        out = found if out is None else out.unionByName(found)
    return out


def removal_spans(found: DataFrame) -> DataFrame:
    """(doc_id, first_word, last_word, items): overlapping or touching runs of a document merged."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("first_word", "last_word", "item_id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    spans = found.distinct().withColumn("reach", F.max("last_word").over(before))
    spans = spans.withColumn("fresh", (F.col("reach").isNull() | (F.col("first_word") > F.col("reach") + 1)).cast("int"))
    spans = spans.withColumn("span", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return spans.groupBy("doc_id", "span").agg(F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"), F.count_distinct("item_id").alias("items")).drop("span")
