"""Periodic run detection (operator 13): suffix automaton with link-cut access.

A run is a longest stretch of consecutive words with smallest period q and at least
``max(MIN_WORDS, MIN_TIMES * q)`` words.  The words of a stretch are appended one by one to the
path of a suffix automaton's link tree: ``access`` walks from the appended prefix's state to the
root over the preferred paths of a link-cut tree, each of which holds states with one common
last occurrence.  For every path segment met, the distance d between that occurrence's end and
the new end is a period of the last ``length + d`` words, ``length`` being the longest string
of the segment; d <= length is a square.  The longest such string also gives the square's left
limit; the right limit is found by comparing words q apart, once for each run.  The walked
path is then recoloured with the new end.

Only stretches that can hold a run reach the automaton.  Each three-word window of a run occurs
at least three times in its document (four times for q = 1), so words outside of windows that
occur three times separate the stretches; the test is repeated inside a stretch while it
shrinks.  This drops no run: it compares 64-bit hashes, and equal windows have equal hashes.

The words of a text are its runs of characters other than space and U+0009 to U+000D.  Null
and blank texts have no words, no runs and an empty collapsed text.  Texts are read whole; the
working memory of a task grows with its longest repetitive stretch, not with its input.
Repeated rows give equal rows, null ids are passed on, an empty table gives an empty result.
Only the named columns are read, so further columns, whatever their names, do not matter."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Interner, map_arrow, raw_texts, slices, table

MIN_WORDS = 6
MIN_TIMES = 4
_GAP = r"[\x20\x09-\x0D]+"


def automaton(codes: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(length of the longest string, suffix link) of every state, 1 being the start, and the
    states of the prefixes."""
    length, link, after = [0, 0], [0, 0], [{}, {}]
    last, prefixes = 1, []
    for c in codes:
        new = len(length)
        length.append(length[last] + 1)
        link.append(1)
        after.append({})
        p = last
        while p and c not in after[p]:
            after[p][c] = new
            p = link[p]
        if p:
            q = after[p][c]
            if length[q] != length[p] + 1:
                copy = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                after.append(dict(after[q]))
                while p and after[p].get(c) == q:
                    after[p][c] = copy
                    p = link[p]
                link[q] = copy
                q = copy
            link[new] = q
        last = new
        prefixes.append(new)
    return length, link, prefixes


class PathForest:
    """Link-cut tree over the link tree: one splay tree per preferred path, ordered by depth.
    The root of a splay tree holds the path's colour, the end of its strings' last occurrence."""

    def __init__(self, link: list[int]) -> None:
        n = len(link)
        self.up, self.less, self.more, self.colour = list(link), [0] * n, [0] * n, [-1] * n

    def _splay(self, x: int) -> None:
        up, less, more = self.up, self.less, self.more
        y = up[x]
        while y and (less[y] == x or more[y] == x):
            z = up[y]
            inner = z and (less[z] == y or more[z] == y)
            if inner:
                # turn y over z first if x and y hang on the same side, else x over y
                a, b = (y, z) if (less[y] == x) == (less[z] == y) else (x, y)
                turns = ((a, b), (x, z if a == x else y))
            else:
                turns = ((x, y),)
            top = z if inner else y
            for a, b in turns:
                g = up[b]
                if less[b] == a:
                    m = more[a]
                    less[b], more[a] = m, b
                else:
                    m = less[a]
                    more[b], less[a] = m, b
                if m:
                    up[m] = b
                up[b], up[a] = a, g
                if g:
                    if less[g] == b:
                        less[g] = a
                    elif more[g] == b:
                        more[g] = a
            self.colour[x] = self.colour[top]
            y = up[x]

    def access(self, state: int, end: int) -> Iterator[tuple[int, int]]:
        """(deepest state, last end) of every path segment between ``state`` and the root, the
        deepest first; the whole way is one path of colour ``end`` afterwards."""
        up, more, colour = self.up, self.more, self.colour
        below, x = 0, state
        while x:
            self._splay(x)
            was = colour[x]
            if was >= 0:
                yield x, was
            cut = more[x]
            if cut:
                colour[cut] = was
            more[x] = below
            below, x = x, up[x]
        colour[below] = end


def find_runs(codes: list[int], min_words: int = MIN_WORDS, min_times: int = MIN_TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a word sequence, by start, then period."""
    n = len(codes)
    length, link, prefixes = automaton(codes)
    forest = PathForest(link)
    reached: dict[int, int] = {}  # period -> end of the last stretch looked at
    found = []
    for end, state in enumerate(prefixes):
        for deepest, was in forest.access(state, end):
            period = end - was
            if period > length[deepest] or end < reached.get(period, 0):
                continue
            stop = end + 1
            while stop < n and codes[stop] == codes[stop - period]:
                stop += 1
            reached[period] = stop
            start = was - length[deepest] + 1
            if stop - start >= max(min_words, min_times * period):
                found.append((start, stop - start, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(codes: np.ndarray, texts: np.ndarray, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int]]:
    """Index ranges that hold all runs of the texts (``texts``: text number of every word, in
    order).  Correct for runs of at least four periods and six words."""
    group, at = texts.astype(np.uint64), np.arange(len(codes))
    values = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    while len(at) >= 3:
        joined = (at[2:] - at[:-2] == 2) & (group[2:] == group[:-2])
        keys = (values[at[:-2]] ^ (group[:-2] * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0xBF58476D1CE4E5B9)
        keys = ((keys ^ (keys >> np.uint64(29))) + values[at[1:-1]]) * np.uint64(0x94D049BB133111EB)
        keys = ((keys ^ (keys >> np.uint64(31))) + values[at[2:]]) * np.uint64(0x9FB21C651E98DF25)
        ranked = np.sort(keys[joined])
        often = np.unique(ranked[2:][ranked[2:] == ranked[:-2]])
        if not len(often):
            return
        spot = np.minimum(np.searchsorted(often, keys), len(often) - 1)
        starts = np.flatnonzero((often[spot] == keys) & joined)
        covered = np.zeros(len(at), bool)
        for k in range(3):
            covered[starts + k] = True
        inside = np.flatnonzero(covered)  # overlapping windows make one stretch
        label = np.concatenate([[0], np.cumsum((np.diff(at[inside]) > 1) | (np.diff(group[inside].astype(np.int64)) != 0))])
        size = np.bincount(label)
        keep = size[label] >= min_words
        if keep.all() and len(inside) == len(at):
            break
        at, group = at[inside[keep]], label[keep].astype(np.uint64)
    if len(at) < 3:
        return
    cut = np.flatnonzero((np.diff(at) > 1) | (np.diff(group.astype(np.int64)) != 0)) + 1
    for a, b in zip(np.concatenate([[0], cut]).tolist(), np.concatenate([cut, [len(at)]]).tolist()):
        yield int(at[a]), int(at[b - 1]) + 1


def _collapse(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """True for the words that no run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, size, period in runs:
        change[start + period] += 1
        change[start + size] -= 1
    return np.cumsum(change[:n]) == 0


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_FOUND = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = raw_texts(batch.column(1))
        for first, last in slices(texts):
            words = [(t or b"").split() for t in texts[first:last]]  # bytes split at exactly the contract's characters
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            borders = np.concatenate([[0], np.cumsum(sizes)])
            codes = np.fromiter(map(Interner().__getitem__, chain.from_iterable(words)), np.int64, int(borders[-1]))
            runs: list[list[tuple[int, int, int]]] = [[] for _ in words]
            for a, b in stretches(codes, np.repeat(np.arange(len(words)), sizes)):
                k = int(np.searchsorted(borders, a, "right")) - 1
                runs[k] += [(a - int(borders[k]) + s, n, q) for s, n, q in find_runs(codes[a:b].tolist())]
            collapsed = []
            for k, w in enumerate(words):
                runs[k].sort(key=lambda r: (r[0], r[2]))
                if runs[k]:
                    keep = _collapse(len(w), runs[k]).tolist()
                    w = [x for x, stays in zip(w, keep) if stays]
                collapsed.append(b" ".join(w))
            yield pa.record_batch(
                [batch.column(0).slice(first, last - first), pa.array(sizes),
                 pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs], pa.list_(_RUN)),
                 pa.array(collapsed, pa.binary()).cast(pa.string())], schema=_FOUND)


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, runs, collapsed) of every row: the runs by start, then period, and the words
    that no run contains after its first period, joined by one space."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return map_arrow(rows, _find, "id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def with_planted_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): the texts of the contract.  Where 10 divides h, the id's checksum, every
    word i >= a becomes word a + (i - a) % p; other texts, and those without an id, stay."""
    h, words = F.crc32(F.col(id_col).cast("string").cast("binary")), F.col("words")
    g, n = F.floor(h / 10), F.size(words).cast("bigint")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), g.alias("g"),
                       F.when(h % 10 == 0, F.filter(F.split(F.col(text_col), _GAP), lambda w: w != "")).alias("words"))
    rows = rows.select("doc_id", "text", "words", "g", F.when(n > 0, F.col("g") % n).alias("a"), n.alias("n"))
    rows = rows.select("*", (F.floor((F.col("n") - F.col("a")) / (F.col("g") % 8 + 3)) + 1).alias("p"))
    a, p = F.col("a"), F.col("p")

    def moved(i: Column) -> Column:
        return F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))

    changed = F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1), moved), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs(with_planted_periods(table(spark, sf_dir, "documents")))
    best = F.aggregate("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"),
                       lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES = {"op13_periodic_runs": op13_periodic_runs}
ORACLE: dict[str, str] = {}
