"""Problem 8: passages of held-out items inside a corpus.

The corpus is read once and written as a positional inverted index, split by document: for each term of
the items, the places where it stands in the text. How many texts hold each term comes from that table
and decides which terms of every stretch of an item are the rarest. Only their places are starting
points: the lists of the other terms, shifted by their place in the item, are intersected with them.
Runs of neighbouring places are exact matches. Where an item has none in a text, proximity counts:
WORDS words of WORDS + SPREAD neighbouring ones in order, within a few more words of the text.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import to_batch

#: Words in a row that make a match.
WORDS = 12
#: A proximity match may miss so many words of the item, and hold so many others more.
SPREAD = 3
#: Items that one pass over the corpus looks for; more of them take several passes.
ITEMS_A_PASS = 100_000

_WORD = re.compile("[^\\W_]+")


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits, without case (as in caseless matching: SS is the capital of an eszett)."""
    return _WORD.findall(text.casefold())


Item = tuple[int, list[int]]


def rarest_terms(items: list[Item], counts: dict[int, int], size: int, misses: int = 0) -> dict[int, list[tuple[int, int]]]:
    """For each term that a match must hold: the items (by number) and places it stands for there.

    A stretch of size + misses words, of which size must match, holds one of its misses + 1 rarest places. A place
    whose term no text holds is never matched, so it uses up a miss and is no starting point.
    """
    found: dict[int, set[tuple[int, int]]] = defaultdict(set)
    for k, (_, own) in enumerate(items):
        stretch = min(size + misses, len(own))
        if stretch < size:
            continue
        for s in range(len(own) - stretch + 1):
            places = sorted(range(s, s + stretch), key=lambda i: (counts.get(own[i], 0), own[i], i))[: stretch - size + 1]
            for at in places:
                if counts.get(own[at], 0):
                    found[own[at]].add((k, at))
    return {t: sorted(x) for t, x in found.items()}


def postings(text_words: list[str], terms: dict[str, int]) -> dict[int, list[int]]:
    """The index of one document: places of each of the terms."""
    out: dict[int, list[int]] = defaultdict(list)
    for i, w in enumerate(text_words):
        t = terms.get(w)
        if t is not None:
            out[t].append(i)
    return out


def runs(index: dict[int, list[int]], items: list[Item], rare: dict[int, list[tuple[int, int]]], size: int) -> Iterator[tuple[int, int, int, int]]:
    """(item number, place in the item, place in the text, words) of the longest runs through each rare term."""
    starts: set[tuple[int, int]] = set()
    for term in rare.keys() & index.keys():
        for k, at in rare[term]:
            starts.update((k, pos - at) for pos in index[term])
    sets: dict[int, frozenset[int]] = {}
    for k, shift in sorted(starts):
        run = 0
        own = items[k][1]
        for i in range(len(own) + 1):
            hit = False
            if i < len(own) and own[i] in index:
                places = sets.get(own[i])
                if places is None:
                    places = sets[own[i]] = frozenset(index[own[i]])
                hit = shift + i in places
            if hit:
                run += 1
            else:
                if run >= size:
                    yield k, i - run, shift + i - run, run
                run = 0


def common_words(a: list[int], b: list[int | None]) -> int:
    """The most words that two short lists have in common in order (bits of one number stand for the places of a)."""
    at: dict[int, int] = defaultdict(int)
    for i, t in enumerate(a):
        at[t] |= 1 << i
    full = (1 << len(a)) - 1
    row = full
    for t in b:
        m = at.get(t, 0)
        if m:
            both = row & m
            row = ((row + both) | (row - both)) & full
    return len(a) - row.bit_count()


def near(index: dict[int, list[int]], items: list[Item], rare: dict[int, list[tuple[int, int]]], size: int, spread: int, skip: set[int]) -> Iterator[tuple[int, int, int, int]]:
    """(item number, place in the item, place in the text, words) of the best proximity match of each item but those to skip; of equals the first."""
    seeds: dict[int, set[int]] = defaultdict(set)
    for term in rare.keys() & index.keys():
        for k, _ in rare[term]:
            if k not in skip:
                seeds[k].update(index[term])
    for k, points in seeds.items():
        own = items[k][1]
        stretch = min(size + spread, len(own))
        width = stretch + spread
        word_at = {p: t for t in set(own) if t in index for p in index[t]}
        if len(word_at) < size:
            continue
        places = sorted(word_at)
        best = None
        starts: set[int] = set()
        for p in sorted(points):
            lo, hi = bisect_left(places, p - width + 1), bisect_right(places, p + width - 1)
            if hi - lo >= size and common_words(own, [word_at[q] for q in places[lo:hi]]) >= size:
                starts.update(range(p - width + 1, p + 1))
        for q in sorted(starts):
            lo, hi = bisect_left(places, q), bisect_left(places, q + width)
            if hi - lo < size:
                continue
            region = [word_at[x] for x in places[lo:hi]]
            if common_words(own, region) < size:
                continue
            for s in range(len(own) - stretch + 1):
                n = common_words(own[s : s + stretch], region)
                if n >= size and (best is None or (-n, s, places[lo]) < best):
                    best = (-n, s, places[lo])
        if best is not None:
            yield k, best[1], best[2], -best[0]


_INDEX = pa.schema([("doc_id", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("places", pa.list_(pa.int32()))])
_INDEX_DDL = "doc_id bigint, terms array<int>, counts array<int>, places array<int>"
_MATCHES = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("kind", pa.string()), ("item_word", pa.int32()), ("doc_word", pa.int32()), ("words", pa.int32())])
_MATCHES_DDL = "doc_id bigint, item_id bigint, kind string, item_word int, doc_word int, words int"


def build_index(documents: DataFrame, terms: dict[str, int], size: int) -> DataFrame:
    """The postings of all texts that hold at least size places of the terms, written as a table: one row for each text."""
    sent = documents.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for b in batches:
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                index = postings(words(text), known)
                if sum(map(len, index.values())) >= size:
                    out.append((doc, list(index), [len(x) for x in index.values()], [p for x in index.values() for p in x]))
            if out:
                yield to_batch(out, _INDEX)

    texts = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    return common.staged(texts.mapInArrow(run, _INDEX_DDL), "postings")


def _one_pass(documents: DataFrame, rows: list[tuple[int, str]], size: int, spread: int | None) -> DataFrame:
    spark = documents.sparkSession
    texts = sorted((i, words(p)) for i, p in rows)
    texts = [(i, ws) for i, ws in texts if len(ws) >= size]
    terms = {w: n for n, w in enumerate(sorted({w for _, ws in texts for w in ws}))}
    if not terms:
        return spark.createDataFrame([], _MATCHES_DDL)
    items: list[Item] = [(i, [terms[w] for w in ws]) for i, ws in texts]
    index = build_index(documents, terms, size)
    counts = dict(index.select(F.explode("terms").alias("term")).groupBy("term").count().collect())  # at most a row for each term of the items
    rare = rarest_terms(items, counts, size)
    wide = rarest_terms(items, counts, size, spread) if spread is not None else None
    sent = spark.sparkContext.broadcast((items, rare, wide))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, rare, wide = sent.value
        for b in batches:
            out = []
            for doc, own, n, flat in zip(*(b.column(i).to_pylist() for i in range(4))):
                ends = list(accumulate(n))
                index = {t: flat[e - c : e] for t, c, e in zip(own, n, ends)}
                exact = list(runs(index, items, rare, size)) if not rare.keys().isdisjoint(index) else []
                out += [(doc, items[k][0], "exact", i, j, w) for k, i, j, w in exact]
                if wide is not None:
                    out += [(doc, items[k][0], "near", i, j, w) for k, i, j, w in near(index, items, wide, size, spread, {x[0] for x in exact})]
            if out:
                yield to_batch(out, _MATCHES)

    return index.mapInArrow(run, _MATCHES_DDL)


def find_matches(documents: DataFrame, items: DataFrame, size: int = WORDS, spread: int | None = SPREAD) -> DataFrame:
    """(doc_id, item_id, kind, item_word, doc_word, words): where a text holds an item's passage.

    kind exact: the longest runs of at least size words. kind near, for items without an exact match in the text and unless
    spread is None: the best stretch, size of size + spread neighbouring words of the item in order within size + 2 spread words
    of the text. Case, punctuation and white space between words don't matter. Null and shorter texts and passages match nothing.
    """
    own = items.where("item_id is not null and passage is not null").select("item_id", "passage").distinct()
    passes = max(1, -(-own.count() // ITEMS_A_PASS))
    found = None
    for k in range(passes):
        part = own if passes == 1 else own.where(F.pmod(F.xxhash64("item_id", "passage"), F.lit(passes)) == k)
        one = _one_pass(documents, [(r[0], r[1]) for r in part.collect()], size, spread)
        found = one if found is None else found.unionByName(one)
    return found.distinct()


def find_leaks(documents: DataFrame, items: DataFrame, size: int = WORDS) -> DataFrame:
    """(doc_id, item_id) of the documents that hold at least size words in a row of an item's passage."""
    return find_matches(documents, items, size, None).select("doc_id", "item_id").distinct()
