"""Words of spaceless scripts: a dictionary counted from the corpus, best paths through its lattice, and how words stand at sentence ends.

Runs of spaceless characters are counted in their pieces of one to four characters, together with how often
a piece stands right before a sentence's terminator and right behind one. Pieces with a share of all of at
least LEAST_SHARE are the dictionary, so its size has a bound whatever the corpus. The best path through the
lattice of a text is its segmentation; a word's final and opening scores are the logarithms of how much more
often than any word it ends or opens a sentence, backed off to its shorter pieces.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CJK = "\u3005\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f"
#: Characters of a word, at most.
LONGEST = 4
#: Share of all characters from which a piece is a word; with it, at most LONGEST / LEAST_SHARE words exist.
LEAST_SHARE = 1e-5
#: Sightings that a word needs, and weight of the shorter piece's rate.
LEAST, BACK_OFF = 3, 5.0
#: Bound of both scores, up and down.
MOST_SCORE = 5.0
#: Different runs that a task counts before it hands their pieces on.
COUNTED = 100_000

_RUN = re.compile(f"(?P<before>(?<=[。！？])|(?<=[。！？]\n))?(?P<run>[{CJK}]+)(?P<after>(?=[。！？]))?")


def pieces(runs: dict[tuple[str, bool, bool], int]) -> dict[str, list[int]]:
    """Piece -> [times seen, before a terminator, behind one] from counted runs."""
    out: dict[str, list[int]] = {}
    for (run, opened, ended), n in runs.items():
        size = len(run)
        for i in range(size):
            for k in range(1, min(LONGEST, size - i) + 1):
                p = run[i : i + k]
                c = out.get(p)
                if c is None:
                    c = out[p] = [0, 0, 0]
                c[0] += n
                if ended and i + k == size:
                    c[1] += n
                if opened and i == 0:
                    c[2] += n
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs: Counter[tuple[str, bool, bool]] = Counter()
    names = ["piece", "n", "final", "opening"]

    def done() -> pa.RecordBatch:
        found = pieces(runs)
        runs.clear()
        cols = list(zip(*found.values())) if found else [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *(pa.array(c, pa.int64()) for c in cols)], names=names)

    for b in batches:
        for text in b.column(0).to_pylist():
            runs.update((m["run"], m["before"] is not None, m["after"] is not None) for m in _RUN.finditer(text))
        if len(runs) > COUNTED:
            yield done()
    yield done()


def fit(lines: DataFrame) -> dict[str, tuple[float, float, float]]:
    """word -> (cost, final score, opening score) over all lines; '' has the logarithms of the shares of characters that end and open a sentence."""
    texts = lines.where(F.col("text").rlike(f"[{CJK}]")).select("text")
    found = texts.mapInArrow(_count, "piece string, n bigint, final bigint, opening bigint").groupBy("piece").agg(*[F.sum(c).alias(c) for c in ("n", "final", "opening")])
    found = common.staged(found, "words")
    total = found.where("length(piece) = 1").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "final", "opening")]).collect()[0]
    if not total[0]:
        return {}
    kept = found.where((F.col("n") >= LEAST) & (F.col("n") >= LEAST_SHARE * total[0])).collect()  # at most LONGEST / LEAST_SHARE rows
    return scored({r[0]: (r[1], r[2], r[3]) for r in kept}, tuple(total))


def scored(counts: dict[str, tuple[int, int, int]], total: tuple[int, int, int]) -> dict[str, tuple[float, float, float]]:
    base = [max(1, t) / total[0] for t in total[1:]]
    rates: dict[tuple[str, int], float] = {}

    def rate(word: str, k: int) -> float:
        found = rates.get((word, k))
        if found is None:
            shorter = word[1:] if k == 0 else word[:-1]
            behind = rate(shorter, k) if shorter else base[k]
            n, own = (counts[word][0], counts[word][1 + k]) if word in counts else (0, 0)
            found = rates[(word, k)] = (own + BACK_OFF * behind) / (n + BACK_OFF)
        return found

    score = lambda w, k: max(-MOST_SCORE, min(MOST_SCORE, math.log(rate(w, k) / base[k])))
    return {"": (0.0, math.log(base[0]), math.log(base[1]))} | {w: (-math.log(n / total[0]), score(w, 0), score(w, 1)) for w, (n, _, _) in counts.items()}


class Lattice:
    def __init__(self, words: dict[str, tuple[float, float, float]]):
        self.words = words
        #: Logarithm of the odds that any gap between two words ends a sentence.
        self.odds = words[""][1] if "" in words else -MOST_SCORE
        self.unknown = max((c for c, _, _ in words.values()), default=10.0) + 2.0
        self.memo: dict[str, list[int]] = {}

    def __bool__(self) -> bool:
        return bool(self.words)

    def segment(self, run: str) -> list[int]:
        """Ends of the words on the cheapest path through a run of spaceless characters."""
        found = self.memo.get(run)
        if found is None:
            if len(self.memo) > 100_000:
                self.memo.clear()
            words, unknown, n = self.words, self.unknown, len(run)
            cost, back = [0.0] * (n + 1), [0] * (n + 1)
            for e in range(1, n + 1):
                best, at = cost[e - 1] + (words[run[e - 1]][0] if run[e - 1] in words else unknown), e - 1
                for s in range(max(0, e - LONGEST), e - 1):
                    w = words.get(run[s:e])
                    if w is not None and cost[s] + w[0] < best:
                        best, at = cost[s] + w[0], s
                cost[e], back[e] = best, at
            found, e = [], n
            while e:
                found.append(e)
                e = back[e]
            found.reverse()
            self.memo[run] = found
        return found

    def score(self, word: str, k: int) -> float:
        """Final (0) or opening (1) score of a word; of an unknown one that of its longest known end or start."""
        while word:
            w = self.words.get(word)
            if w is not None:
                return w[1 + k]
            word = word[1:] if k == 0 else word[:-1]
        return 0.0
