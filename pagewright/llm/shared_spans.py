"""Problem 9: long exact spans shared between records.

A de Bruijn graph in minimizer space. Of the K-character words of a text, those that are the least of
some WINDOW neighbouring ones (by hash) become nodes; a span of SPAN = K + WINDOW - 1 characters always
holds one, so nothing is lost. Edges are two neighbouring nodes of a text, labelled with the hash of all
characters from the one to the end of the other. A node of which every occurrence has the same edge in,
whose source has the same edge out at every occurrence, lies on a nonbranching path; such paths are
compacted into their first node through a join, so that copies meet once a path and not once a word.
The source coordinates of the first nodes then give the characters around them, and two occurrences
whose equal characters reach SPAN are a shared span - compared character by character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SPAN, K = 200, 64
WINDOW = SPAN - K + 1
#: Characters that a task works on at once, beyond the last text.
CHUNK = 1 << 20
#: Step of the reaches by which occurrences of a node are brought together.
REACH = 17

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 2 * CHUNK)
        _POWERS.clear()
        for base in (_BASE, _INVERSE):
            factors = np.full(size, base, dtype=np.uint64)
            factors[0] = 1
            _POWERS.append(np.cumprod(factors))
    return _POWERS[0], _POWERS[1]


def _sliding(x: np.ndarray, w: int, best) -> np.ndarray:
    """best of each w neighbours, by running bests of blocks from both sides."""
    n = len(x)
    pad = np.full((-n) % w, x[-1], dtype=x.dtype)
    blocks = np.concatenate([x, pad]).reshape(-1, w)
    left = best.accumulate(blocks, axis=1).ravel()
    right = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(right[: n - w + 1], left[w - 1 : n])


def minimizers(texts: list[str], k: int = K, window: int = WINDOW) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the text, places, hashes, labels of the edges between them) of each text of at least k + window - 1 characters."""
    raw = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
    sizes = np.array([len(r) for r in raw])
    n = int(sizes.sum())
    if n < k + window - 1:
        return
    starts = np.concatenate([[0], np.cumsum(sizes)])
    power, inverse = _powers(n + 1)
    chars = _mix(np.concatenate(raw).astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(chars * power[:n], out=prefix[1:])
    hashes = _mix((prefix[k:] - prefix[:-k]) * inverse[: n - k + 1]) >> np.uint64(1)
    low = _sliding(hashes, window, np.minimum)
    room = np.zeros(n, dtype=bool)  # windows that lie in one text
    for s, e in zip(starts[:-1], starts[1:]):
        room[s : max(s, e - (k + window - 1) + 1)] = True
    low = np.where(room[: len(low)], low, np.uint64(0))
    edge = np.zeros(window - 1, dtype=np.uint64)
    high = _sliding(np.concatenate([edge, low, edge]), window, np.maximum)
    chosen = np.flatnonzero(hashes == high)
    bounds = np.searchsorted(chosen, starts)
    for t in range(len(texts)):
        own = chosen[bounds[t] : bounds[t + 1]]
        if len(own):
            a, b = own[:-1], own[1:] + k
            labels = _mix((prefix[b] - prefix[a]) * inverse[a] + (b - a).astype(np.uint64))
            yield t, own - starts[t], hashes[own].astype(np.int64), labels.astype(np.int64)


_OCC = pa.schema([("fp", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32()), ("edge_in", pa.int64()), ("edge_out", pa.int64())])
_OCC_DDL = "fp bigint, doc_id bigint, pos int, edge_in bigint, edge_out bigint"


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def close() -> Iterator[pa.RecordBatch]:
        cols: list[list[np.ndarray]] = [[] for _ in range(4)]
        docs: list[np.ndarray] = []
        for t, places, fps, labels in minimizers(texts):
            gap = np.zeros(1, dtype=np.int64)  # 0: no edge
            for col, x in zip(cols, (fps, places.astype(np.int32), np.concatenate([gap, labels]), np.concatenate([labels, gap]))):
                col.append(x)
            docs.append(np.full(len(fps), ids[t], dtype=np.int64))
        if docs:
            fp, pos, ein, eout = map(np.concatenate, cols)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (fp, np.concatenate(docs), pos, ein, eout)], schema=_OCC)

    ids: list[int] = []
    texts: list[str] = []
    size = 0
    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            ids.append(doc)
            texts.append(text)
            size += len(text)
            if size >= CHUNK:
                yield from close()
                ids, texts, size = [], [], 0
    yield from close()


def occurrences(documents: DataFrame) -> DataFrame:
    """One row for each occurrence of a node, with the labels of its edges (0: none)."""
    return documents.mapInArrow(_nodes, _OCC_DDL)


def path_heads(occ: DataFrame) -> DataFrame:
    """(fp) of the nodes in two or more texts that open a nonbranching path."""
    one = lambda c: (F.min(c) == F.max(c)) & (F.min(c) != 0)
    nodes = occ.groupBy("fp").agg(
        F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.max("edge_in").alias("edge"), F.max("edge_out").alias("out"), one("edge_in").alias("one_in"), one("edge_out").alias("one_out")
    ).where("a != b")
    sources = nodes.where("one_out").select(F.col("out").alias("edge"))
    inner = nodes.where("one_in").join(sources, "edge", "left_semi").select("fp")
    return nodes.select("fp").join(inner, "fp", "left_anti")


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The characters around each place, and the keys of its reaches."""
    for b in batches:
        out = []
        for doc, text, at in zip(*(b.column(i).to_pylist() for i in range(3))):
            for x in at:
                p = x["pos"]
                out.append((x["fp"], doc, text[max(0, p - WINDOW + 1) : p], text[p : p + SPAN]))
        if out:
            yield common.to_batch(out, _AROUND)


_AROUND = pa.schema([("fp", pa.int64()), ("doc_id", pa.int64()), ("left", pa.string()), ("right", pa.string())])


def _common(a: str, b: str) -> int:
    """Length of the equal beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        c = [b.column(i).to_pylist() for i in range(6)]
        keep = [(r := _common(ra, rb)) >= K and _common(la[::-1], lb[::-1]) + r >= SPAN for la, lb, ra, rb in zip(*c[2:])]
        mask = pa.array(keep, type=pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], names=["a", "b"])


def _reaches():
    """(at, key) of which two surroundings of a node share one if they share SPAN characters: left at characters, right the rest but REACH."""
    rest = SPAN - (REACH - 1)
    return F.array_compact(F.array(*[
        F.when((F.length("left") >= a) & (F.length("right") >= rest - a), F.struct(F.lit(a).alias("at"), F.xxhash64("fp", F.lit(a), F.right("left", F.lit(a)) if a else F.lit(""), F.left("right", F.lit(rest - a))).alias("key")))
        for a in range(0, WINDOW, REACH)
    ]))


def _fine_reaches():
    """The same without REACH, for each place that a coarse key at "at" stands for: who shares one shares SPAN characters."""
    n = lambda i: F.col("at") + i
    fits = lambda i: (F.length("left") >= n(i)) & (F.length("right") >= SPAN - n(i))
    key = lambda i: F.struct(n(i).alias("at"), F.xxhash64("fp", n(i), F.right("left", n(i)), F.left("right", SPAN - n(i))).alias("key"))
    return F.transform(F.filter(F.sequence(F.lit(0), F.lit(REACH - 1)), fits), key)


#: Classes of one key from which on they are no longer compared in pairs but by the keys of all SPAN characters.
HOT = 64


def _keyed(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes with their coarse keys, those of hot keys with fine keys instead). A hot key, as of a letterhead almost as long as a span, gives no pairs but real ones."""
    keyed = classes.withColumn("x", F.explode(_reaches())).select("*", "x.at", "x.key").drop("x")
    hot = keyed.groupBy("key", "fp").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("key", "fp")
    cold = keyed.join(hot, ["key", "fp"], "left_anti")
    fine = keyed.join(hot, ["key", "fp"], "left_semi").withColumn("x", F.explode(_fine_reaches())).drop("at", "key").select("*", "x.at", "x.key").drop("x")
    return cold, fine.dropDuplicates(["class", "at", "key"])


def find_pairs(documents: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b, of the texts with a common stretch of at least SPAN characters.

    Null and shorter texts share nothing; a doc_id that is null is left out; rows of one doc_id are no pair.
    """
    texts = documents.where(f"doc_id is not null and length(text) >= {SPAN}").select("doc_id", "text")
    occ = common.staged(occurrences(texts), "shared_nodes")
    heads = path_heads(occ)
    places = occ.select("fp", "doc_id", "pos").join(heads, "fp").groupBy("doc_id").agg(F.collect_list(F.struct("fp", "pos")).alias("at"))
    around = texts.join(places, "doc_id").mapInArrow(_around, "fp bigint, doc_id bigint, left string, right string").dropDuplicates(["fp", "doc_id", "left", "right"])
    # occurrences with the same surroundings are one class, which is compared once
    around = common.staged(around.withColumn("class", F.xxhash64("fp", "left", "right")), "shared_places")
    # a class with all SPAN characters holds pairs of its own
    size = F.length("left") + F.length("right")
    classes = around.groupBy("class").agg(F.first("fp").alias("fp"), F.first("left").alias("left"), F.first("right").alias("right"))
    members = around.select("class", "doc_id", (size >= SPAN).alias("long"))
    # two classes whose equal characters reach SPAN agree on some reach: left a characters, right the rest but REACH
    near = None
    for keyed in _keyed(classes):
        x, y = keyed.alias("x"), keyed.alias("y")
        own = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") == F.col("y.fp")) & (F.col("x.class") < F.col("y.class")))
        own = own.select("x.class", F.col("y.class").alias("other"), "x.left", F.col("y.left").alias("left2"), "x.right", F.col("y.right").alias("right2"))
        near = own if near is None else near.unionByName(own)
    links = near.mapInArrow(_verify, "a bigint, b bigint").distinct()
    own = members.where("long").select(F.col("class").alias("a"), F.col("class").alias("b")).distinct()
    m = members.select("class", "doc_id")
    pairs = links.unionByName(own).join(m.select(F.col("class").alias("a"), F.col("doc_id").alias("p")), "a").join(m.select(F.col("class").alias("b"), F.col("doc_id").alias("q")), "b")
    return pairs.where("p != q").select(F.least("p", "q").alias("doc_id_a"), F.greatest("p", "q").alias("doc_id_b")).distinct()


_CONTEXT = pa.schema([*_AROUND, ("pos", pa.int32())])
_CONTEXT_DDL = "fp bigint, doc_id bigint, left string, right string, pos int"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The characters around each place where they can hold a span, and the place."""
    for b in batches:
        out = []
        for doc, text, at in zip(*(b.column(i).to_pylist() for i in range(3))):
            for x in at:
                p = x["pos"]
                left, right = text[max(0, p - WINDOW + 1) : p], text[p : p + SPAN]
                if len(left) + len(right) >= SPAN:
                    out.append((x["fp"], doc, left, right, p))
        if out:
            yield common.to_batch(out, _CONTEXT)


_AGREED = pa.schema([("class", pa.int64()), ("before", pa.int32()), ("after", pa.int32())])


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many characters before and after the place a class shares with another one, if they reach SPAN."""
    for b in batches:
        out = set()
        for one, la, lb, ra, rb in zip(*(b.column(i).to_pylist() for i in range(5))):
            after = _common(ra, rb)
            if after >= K and (before := _common(la[::-1], lb[::-1])) + after >= SPAN:
                out.add((one, before, after))
        if out:
            yield common.to_batch(list(out), _AGREED)


_SPANS = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("length", pa.int32())])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(start, end) of spans put together where they overlap or touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [(doc, a, e - a) for doc, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for a, e in merged([(x["a"], x["b"]) for x in at])]
        yield common.to_batch(out, _SPANS)


def find_spans(documents: DataFrame) -> DataFrame:
    """(doc_id, start, length): the characters of each text that lie in a stretch of at least SPAN that another text has too.

    start counts from 0; stretches that overlap or touch are one row. A shared stretch of SPAN characters holds a node,
    the same one at the same place in both texts, so the agreements around all shared nodes give all of them.
    """
    texts = documents.where(f"doc_id is not null and length(text) >= {SPAN}").select("doc_id", "text")
    occ = common.staged(occurrences(texts).select("fp", "doc_id", "pos"), "shared_nodes")
    nodes = occ.groupBy("fp").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a != b").select("fp")
    places = occ.join(nodes, "fp").groupBy("doc_id").agg(F.collect_list(F.struct("fp", "pos")).alias("at"))
    around = texts.join(places, "doc_id").mapInArrow(_contexts, _CONTEXT_DDL)
    around = common.staged(around.withColumn("class", F.xxhash64("fp", "left", "right")), "shared_contexts")
    members = around.select("class", "doc_id", "pos", F.length("left").alias("before"), F.length("right").alias("after"))
    classes = around.groupBy("class").agg(*(F.first(c).alias(c) for c in ("fp", "left", "right")), F.min("doc_id").alias("doc"), (F.min("doc_id") != F.max("doc_id")).alias("many"))
    classes = common.staged(classes, "shared_classes")
    # a class of several texts is shared as it stands; one of a single text as far as it agrees with another class
    whole = members.join(classes.where("many").select("class"), "class", "left_semi").select("doc_id", (F.col("pos") - F.col("before")).alias("a"), (F.col("pos") + F.col("after")).alias("b"))
    keyed, fine = _keyed(classes)
    x, y = keyed.where("not many").alias("x"), keyed.alias("y")
    near = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") == F.col("y.fp")) & (F.col("x.class") != F.col("y.class")) & (F.col("y.many") | (F.col("x.doc") != F.col("y.doc"))))
    near = near.select("x.class", "x.left", F.col("y.left").alias("left2"), "x.right", F.col("y.right").alias("right2"))
    agreed = near.mapInArrow(_agree, "class bigint, before int, after int")
    group = fine.groupBy("key", "fp").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.bool_or("many").alias("some")).where("lo != hi or some").select("key", "fp")
    exact = fine.where("not many").join(group, ["key", "fp"], "left_semi").select("class", F.col("at").cast("int").alias("before"), (SPAN - F.col("at")).cast("int").alias("after"))
    agreed = agreed.unionByName(exact).distinct()
    part = members.select("class", "doc_id", "pos").join(agreed, "class").select("doc_id", (F.col("pos") - F.col("before")).alias("a"), (F.col("pos") + F.col("after")).alias("b"))
    spans = whole.unionByName(part).groupBy("doc_id").agg(F.collect_set(F.struct("a", "b")).alias("at"))
    return spans.mapInArrow(_merge, "doc_id bigint, start int, length int")


def shared_share(documents: DataFrame) -> DataFrame:
    """(doc_id, n_chars, shared_chars, share) of every record; 0 where nothing, or no text, is shared."""
    shared = find_spans(documents).groupBy("doc_id").agg(F.sum("length").alias("shared_chars"))
    own = documents.where("doc_id is not null").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"))
    n = F.coalesce("shared_chars", F.lit(0))
    return own.join(shared, "doc_id", "left").select("doc_id", "n_chars", n.alias("shared_chars"), F.when(F.col("n_chars") > 0, n / F.col("n_chars")).otherwise(0.0).alias("share"))


def link_classes(documents: DataFrame) -> DataFrame:
    """(doc_id, class_id, links): texts that are equal are one class, named by its smallest doc_id; links counts the other classes with a common stretch of SPAN characters.

    Copies aren't expanded into pairs. A null or short text is in a class without links; rows without a doc_id are left out.
    """
    own = documents.where("doc_id is not null").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"), "text")
    heads = common.staged(own.groupBy("h").agg(F.min("doc_id").alias("class_id"), F.first("text").alias("text")), "shared_texts")
    pairs = find_pairs(heads.select(F.col("class_id").alias("doc_id"), "text"))
    ends = pairs.select(F.explode(F.array("doc_id_a", "doc_id_b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    members = own.select("doc_id", "h").distinct().join(heads.select("h", "class_id"), "h")
    return members.join(ends, "class_id", "left").select("doc_id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))
