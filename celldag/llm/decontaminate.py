"""Benchmark decontamination by greedy string tiling.

A test item and a document are candidates if they share a seed: a run of min_match words (an
item of fewer words: all of its words).  Between candidates, running Karp-Rabin looks for
the longest common runs of unmarked words, their length s found by halving, down to min_match; these
are marked as tiles, and no word of either side is in two tiles.  A document that holds its tiles in
another order than the item is caught like one that holds them in order.  An item leaks into a
document if tiles cover at least min_coverage of the item's words, or if one tile has min_run
words or more, whatever the item's length: a verbatim run of two sentences gives a long item's
answer away as well.  A few common words are no evidence, so an item of fewer than min_match
words leaks only where it is also min_coverage of the document's words.

Benchmarks are dealt into blocks of bounded size.  Each block is shipped whole to the tasks
that read the documents, so no document row is shuffled; a benchmark of any size takes more
blocks, not larger ones.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from celldag.llm.common import frugal, slices, texts_of

WORDS = re.compile(r"[^\W_]+")
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BLOCK_CHARS = 4 << 20
#: Documents are searched in slices of about this many bytes.
SLICE = 4 << 20


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def _prefix_hashes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each prefix, and the powers of BASE: a run's hash is the difference of two prefixes (modulo 2**64)."""
    powers = np.full(len(ids) + 1, BASE, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    return np.concatenate([[np.uint64(0)], np.cumsum(ids.astype(np.uint64) * powers[:-1], dtype=np.uint64)]), powers


def _runs(prefix: np.ndarray, powers: np.ndarray, marked: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the unmarked runs of s words and their Karp-Rabin hashes, brought to one power."""
    n = len(prefix) - 1 - s + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    blocked = np.concatenate([[0], np.cumsum(marked)])
    start = np.flatnonzero(blocked[s:] == blocked[:-s])
    return start, (prefix[start + s] - prefix[start]) * powers[len(powers) - 1 - start]


def tiles(item: np.ndarray, doc: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two sequences of word numbers; a number of 0 or less in doc matches nothing.

    Returns (place in item, place in doc, length), longest first; of equal ones the first in the item, then in the doc.
    """
    size = max(len(item), len(doc))
    pad = lambda x: np.concatenate([x, np.zeros(size - len(x), x.dtype)])  # noqa: E731  one power for both sides
    (hi, powers), (hd, _) = _prefix_hashes(pad(item)), _prefix_hashes(pad(doc))
    mi = np.concatenate([np.zeros(len(item), bool), np.ones(size - len(item), bool)])
    md = np.concatenate([doc <= 0, np.ones(size - len(doc), bool)])

    def common(s: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        (si, ki), (sd, kd) = _runs(hi, powers, mi, s), _runs(hd, powers, md, s)
        shared = np.intersect1d(ki, kd)
        i, d = np.isin(ki, shared), np.isin(kd, shared)
        return si[i], ki[i], sd[d], kd[d]

    found, top = [], min(len(item), len(doc))
    while top >= min_match and len((runs := common(min_match))[0]):
        low, s = min_match, top  # a common run of `low` words is there; try the longest first
        while low < top:
            if len((longer := common(s))[0]):
                low, runs = s, longer
            else:
                top = s - 1
            s = (low + top + 1) // 2
        si, ki, sd, kd = runs
        # No match is longer, so each place of the item takes the first free place of the document: equal runs are met in turn, not in pairs.
        order = np.lexsort((sd, kd))
        sd, kd = sd[order], kd[order]
        keys, first = np.unique(kd, return_index=True)
        last, at, free = np.append(first[1:], len(kd)), first.copy(), 0
        for i, g in zip(si.tolist(), np.searchsorted(keys, ki).tolist()):
            if i < free:
                continue
            while at[g] < last[g]:
                d = int(sd[at[g]])
                at[g] += 1
                if not md[d : d + low].any() and np.array_equal(item[i : i + low], doc[d : d + low]):
                    mi[i : i + low] = md[d : d + low] = True
                    found.append((i, d, low))
                    free = i + low
                    break
        top = low - 1
    return sorted(found, key=lambda t: (-t[2], t[0], t[1]))


class Block:
    """Some test items, made ready for search."""

    def __init__(self, items: list[tuple[int, str]], min_match: int, min_coverage: float, min_run: int):
        self.min_match, self.min_coverage, self.min_run = min_match, min_coverage, min_run
        listed = [(i, words_of(t or "")) for i, t in items]
        self.names = [i for i, ws in listed if ws]
        self.vocab: dict[str, int] = {}
        self.items = [np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in ws], np.int64) for _, ws in listed if ws]
        # Seeds by length: min_match for most, all words for shorter items.  Of each: hash, item, places from .. to in that item.
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        by_len: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for n, ids in enumerate(self.items):
            k = min(min_match, len(ids))
            key = self.grams(ids, k)
            by_len.setdefault(k, []).append((key, np.full(len(key), n), np.arange(len(key))))
        for k, parts in by_len.items():
            key, item, at = map(np.concatenate, zip(*parts))
            order = np.lexsort((at, item, key))
            key, item, at = key[order], item[order], at[order]
            begin = np.flatnonzero(np.concatenate([[True], (np.diff(key) != 0) | (np.diff(item) != 0)]))
            self.seeds[k] = key[begin], item[begin], begin, np.append(begin[1:], len(key)), at

    @staticmethod
    def grams(ids: np.ndarray, k: int) -> np.ndarray:
        """Rolling hash of k numbers from each place on."""
        if len(ids) < k:
            return np.empty(0, np.uint64)
        x, out = ids.astype(np.uint64), np.zeros(len(ids) - k + 1, np.uint64)
        for j in range(k):
            out = out * BASE + x[j : len(x) - k + 1 + j]
        return out

    def leaks(self, item_words: int, doc_words: int, covered: int, longest: int) -> bool:
        """Whether tiles that cover so many of the item's words, the longest of so many, are a leak."""
        if item_words < self.min_match:
            return covered >= self.min_coverage * max(item_words, doc_words)
        return covered >= self.min_coverage * item_words or longest >= self.min_run

    def search(self, texts: list[str]) -> list[tuple[int, int, int, list[tuple[int, int, int]]]]:
        """(row, item's place, words of the item covered, tiles) of each leak in whole texts."""
        get = self.vocab.get
        docs = [np.fromiter([get(w, 0) for w in words_of(t)] + [0], np.int64) for t in texts]
        ids = np.concatenate([*docs, np.empty(0, np.int64)])
        end = np.cumsum([len(d) for d in docs])
        zeros = np.concatenate([[0], np.cumsum(ids == 0)])
        cand: dict[tuple[int, int], np.ndarray] = {}
        held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k, (key, item, _, _, _) in self.seeds.items():
            if len(ids) < k:
                continue
            start = np.flatnonzero(zeros[k:] == zeros[:-k])
            seen = self.grams(ids, k)[start]
            known = np.isin(seen, key)
            start, seen = start[known], seen[known]
            row = np.searchsorted(end, start, "right")
            held[k] = start, seen, row
            # A seed counts once for a document and an item, however often they repeat it.
            order = np.lexsort((seen, row))
            once = order[np.concatenate([[True], (np.diff(row[order]) != 0) | (np.diff(seen[order]) != 0)])] if len(order) else order
            lo, hi = np.searchsorted(key, seen[once], "left"), np.searchsorted(key, seen[once], "right")
            n = hi - lo
            seed = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            row, which = np.repeat(row[once], n), item[seed]
            order = np.lexsort((which, row))
            which, row, seed = which[order], row[order], seed[order]
            cuts = np.flatnonzero((np.diff(row) != 0) | (np.diff(which) != 0)) + 1
            for p, q in zip([0, *cuts], [*cuts, len(row)]):
                if q > p:
                    cand[int(row[p]), int(which[p])] = seed[p:q]
        out = []
        for (row, which), seed in sorted(cand.items()):
            item, k = self.items[which], min(self.min_match, len(self.items[which]))
            key, _, lo, hi, at = self.seeds[k]
            where = np.concatenate([at[p:q] for p, q in zip(lo[seed], hi[seed])])
            span = np.zeros(len(item) + 1, np.int64)
            np.add.at(span, where, 1)
            np.add.at(span, where + k, -1)
            under = np.concatenate([[0], (np.cumsum(span)[:-1] > 0).astype(np.int8), [0]])
            edges = np.flatnonzero(np.diff(under))
            longest = (edges[1::2] - edges[::2]).max()
            if not self.leaks(len(item), len(docs[row]) - 1, int(under.sum()), int(longest)):
                continue  # seeds cover all that tiles can
            begin = int(end[row]) - len(docs[row])
            start, seen, of_row = held[k]
            p, q = np.searchsorted(of_row, [row, row + 1])
            place = start[p:q][np.isin(seen[p:q], key[seed])]
            near = np.unique((place[:, None] - begin + np.arange(k)).ravel())
            # The document's words that are in a shared seed; a 0 wherever others stood between.
            gap = np.concatenate([[0], np.cumsum(np.diff(near) > 1)])
            at = np.arange(len(near)) + gap
            doc = np.zeros(at[-1] + 1, np.int64)
            doc[at] = docs[row][near]
            back = dict(zip(at.tolist(), near.tolist()))
            got = [(i, back[d], n) for i, d, n in tiles(item, doc, k)]
            covered = sum(n for _, _, n in got)
            if self.leaks(len(item), len(docs[row]) - 1, covered, max((n for _, _, n in got), default=0)):
                out.append((row, which, covered, got))
        return out


def _blocks(benchmark: DataFrame, min_match: int, min_coverage: float, min_run: int):
    """The benchmark in shared blocks of about BLOCK_CHARS of text each."""
    items = benchmark.select("item_id", "text").where("item_id is not null and text is not null")
    size = items.agg(F.sum(F.length("text") + F.lit(16))).first()[0] or 0
    n = max(1, -(-size // BLOCK_CHARS))
    for i in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) if n > 1 else items
        rows = part.orderBy("item_id", "text").collect()
        yield benchmark.sparkSession.sparkContext.broadcast(Block([(r[0], r[1]) for r in rows], min_match, min_coverage, min_run))


def leaks(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, min_coverage: float = 0.6, min_run: int = 30) -> DataFrame:
    """Rows (doc_id, item_id, item_words, covered_words, coverage, tiles) of each leak of a test item into a document.

    tiles: array of (item_at, doc_at, n_words), longest first.  Words are runs of letters and
    digits, without regard to case.  Items or documents that are null or have no words match
    nothing, an item without id neither; repeated rows are searched each; further columns are
    ignored.
    """
    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}"
    out = f"{kinds}, item_words int, covered_words int, coverage double, tiles array<struct<item_at: int, doc_at: int, n_words: int>>"
    tile = pa.list_(pa.struct([(x, pa.int32()) for x in ("item_at", "doc_at", "n_words")]))

    def of_block(shared) -> DataFrame:
        def run(batches):
            b = shared.value
            for batch in slices(batches, SLICE):
                got = b.search(texts_of(batch, "text"))
                if got:
                    size = [len(b.items[g[1]]) for g in got]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": batch.column("doc_id").take(pa.array([g[0] for g in got], pa.int64())),
                            "item_id": pa.array([b.names[g[1]] for g in got]),
                            "item_words": pa.array(size, pa.int32()),
                            "covered_words": pa.array([g[2] for g in got], pa.int32()),
                            "coverage": pa.array([g[2] / n for g, n in zip(got, size)], pa.float64()),
                            "tiles": pa.array([[{"item_at": i, "doc_at": d, "n_words": n} for i, d, n in g[3]] for g in got], tile),
                        }
                    )

        return docs.select("doc_id", "text").mapInArrow(frugal(run), out)

    return reduce(DataFrame.unionByName, map(of_block, _blocks(benchmark, min_match, min_coverage, min_run)))


def clean(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, min_coverage: float = 0.6, min_run: int = 30) -> DataFrame:
    """The rows that hold no leak, all columns unchanged.  Rows pass through where they lie, once for each block.

    Documents that are null or have no words, items that are null and items without id take no part, so
    such documents stay; repeated rows are judged each.
    """

    def without(shared):
        def run(batches):
            b = shared.value
            for batch in slices(batches, SLICE):
                bad = {g[0] for g in b.search(texts_of(batch, "text"))}
                yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)])) if bad else batch

        return run

    for shared in _blocks(benchmark, min_match, min_coverage, min_run):
        docs = docs.mapInArrow(frugal(without(shared)), docs.schema)
    return docs
