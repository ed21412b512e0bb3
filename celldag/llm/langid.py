"""Language identification by prediction by partial matching (PPM).

Every language has a byte context tree of variable order; all languages share one set of
contexts, so that one automaton walks a text for all of them at once.  The statistics are
frozen after training.  In a context, a symbol that the language has shown there has
probability n / (N + d) (escape method C: d distinct symbols among N).  Any other symbol costs
an escape d / (N + d), and then its probability in the next shorter context, renormalised over
the symbols that were not seen in the longer one (exclusion).  Below order 0 all 256 bytes are
alike.  So each context holds a true distribution and the sum of -log2 p is the exact length
of an ideal code.  The language with the shortest code wins.

A frozen PPM model of order D looks at D bytes of history, so a text can be scored in chunks
that start D bytes early.  All chunks of an Arrow batch go through the automaton in step, and
code lengths add up as integers (2**-16 bit): the result doesn't depend on how texts are cut.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from celldag.llm.common import cut, fold, frugal, slices, texts_of

UNKNOWN = "und"
UNIT = 1 << 16
CHUNK = 256
#: Training texts are counted in slices of about this many bytes; a task holds at most HELD counts (16 bytes each) and those of a slice.
SLICE, HELD = 1 << 20, 2_000_000
#: Rates of letter runs are told apart to 1 / STEP bit a byte where their quantiles are taken.
STEP = 1024
#: Bits a byte by which a text may exceed what held-out texts showed: quantiles of few texts are inexact, and texts quote names and notices.
SLACK = 1.0
#: Words of letters alone, as tokens with digits are codes; LENGTHS: bytes of letter runs for which limits are learned, each a power of two.
LETTERS = re.compile(r"(?<!\w)[^\W\d_]+(?!\w)")
LENGTHS = tuple(1 << i for i in range(11))


@dataclass
class PpmModel:
    """langs: names; order: longest context; step: next state by (state, byte); cost: by (state, byte, language), in 1/UNIT bit."""

    langs: list[str]
    order: int
    step: np.ndarray
    cost: np.ndarray


def _grams(data: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Context and symbol as one number, for every position that has `order` bytes before it, and how often."""
    if len(data) <= order:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    code = np.zeros(len(data) - order, np.uint64)
    for k in range(order + 1):
        code = (code << np.uint64(8)) | data[k : len(data) - order + k]
    return np.unique(code, return_counts=True)


def _summed(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(code, return_inverse=True)
    return found, np.bincount(at, n, minlength=len(found)).astype(np.int64)


def _grams_of_all(texts: list[bytes], order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """What `_grams` finds in each text for each k, 0 to order, summed over the texts.

    The longest contexts are counted; what stands after shorter ones follows from them and from the first bytes of each text.
    """
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(size) - size
    code = data.copy()
    for k in range(1, order + 1):
        code[k:] |= data[:-k] << np.uint64(8 * k)
    low = lambda k: np.uint64((1 << 8 * (k + 1)) - 1)
    inside = np.ones(len(code), bool)
    for k in range(order):
        inside[begin[size > k] + k] = False
    found, n = np.unique(code[inside] & low(order), return_counts=True)
    out = [(found, n.astype(np.int64))]
    for k in range(order - 1, -1, -1):
        first = code[begin[size > k] + k]  # with k bytes before it in its text
        found, n = _summed(np.concatenate([found, first]) & low(k), np.concatenate([n, np.ones(len(first), np.int64)]))
        out.append((found, n))
    return out[::-1]


def context_counts(labelled: DataFrame, order: int) -> DataFrame:
    """Rows (lang, text) to counts (lang, k, ctx, sym, n) of each byte after each context of k bytes.

    A task sums what it finds, and hands it on whenever there is much of it.
    """

    def count(batches):
        held: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        waiting = 0

        def merged() -> int:
            for key, parts in held.items():
                held[key] = [_summed(np.concatenate([c for c, _ in parts]), np.concatenate([n for _, n in parts]))]
            return sum(len(parts[0][0]) for parts in held.values())

        def told():
            for (lang, k), [(code, n)] in held.items():
                yield pa.RecordBatch.from_pydict(
                    {
                        "lang": pa.array([lang], pa.string()).take(pa.array(np.zeros(len(code), np.int32))),
                        "k": pa.array(np.full(len(code), k, np.int32)),
                        "ctx": pa.array((code >> np.uint64(8)).astype(np.int64)),
                        "sym": pa.array((code & np.uint64(255)).astype(np.int32)),
                        "n": pa.array(n),
                    }
                )
            held.clear()

        for batch in slices(batches, SLICE):
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), texts_of(batch, "text")):
                by_lang.setdefault(lang, []).append(text.encode("utf-8", "replace"))
            for lang, parts in by_lang.items():
                for k, found in enumerate(_grams_of_all(parts, order)):
                    held.setdefault((lang, k), []).append(found)
                    waiting += len(found[0])
            if waiting > HELD:
                waiting = merged()
                if waiting > HELD // 2:
                    yield from told()
                    waiting = 0
        merged()
        yield from told()

    counted = labelled.select("lang", "text").mapInArrow(frugal(count), "lang string, k int, ctx long, sym int, n long")
    return counted.groupBy("lang", "k", "ctx", "sym").agg(F.sum("n").alias("n"))


def build_model(counts: pa.Table, order: int) -> PpmModel | None:
    """Frozen tables from the rows (lang, k, ctx, sym, n) of the kept contexts; None without rows."""
    langs = sorted(set(counts.column("lang").unique().to_pylist()))
    if not langs:
        return None
    k, ctx, sym = (counts.column(c).to_numpy().astype(np.int64) for c in ("k", "ctx", "sym"))
    coded = counts.column("lang").combine_chunks().dictionary_encode()
    lang = np.searchsorted(np.array(langs), np.array(coded.dictionary.to_pylist()))[coded.indices.to_numpy()]
    known, place = np.unique(np.append(k << 56 | ctx, 0), return_inverse=True)  # a context has at most 7 bytes
    nodes = [(x >> 56, x & ((1 << 56) - 1)) for x in known.tolist()]
    at = {x: i for i, x in enumerate(nodes)}
    n = np.zeros((len(nodes), 256, len(langs)))
    np.add.at(n, (place[:-1], sym, lang), counts.column("n").to_numpy())
    children: dict[int, dict[int, int]] = {}
    for i, (k, ctx) in enumerate(nodes):
        if k and (parent := at.get((k - 1, ctx >> 8))) is not None:
            children.setdefault(parent, {})[ctx & 255] = i
    p = np.empty_like(n)
    step = np.zeros((len(nodes), 256), np.int32)
    for i, (k, ctx) in enumerate(nodes):
        if k:
            shorter = at[k - 1, ctx & ((1 << 8 * (k - 1)) - 1)]
            below, step[i] = p[shorter], step[shorter]
        else:
            below = np.full((256, len(langs)), 1 / 256)
        for sym, child in children.get(i, {}).items():
            step[i, sym] = child
        total, distinct = n[i].sum(0), (n[i] > 0).sum(0)
        unseen = n[i] == 0
        rest = np.where(unseen, below, 0).sum(0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(distinct < 256, distinct / (total + distinct) / rest, 0)
            seen = np.where(distinct < 256, n[i] / (total + distinct), n[i] / total)
        p[i] = np.where(total > 0, np.where(unseen, escape * below, seen), below)
    return PpmModel(langs, order, step, np.rint(-np.log2(p) * UNIT).astype(np.int32))


def train(labelled: DataFrame, order: int = 4, min_count: int = 24, max_contexts: int = 6000, max_cells: int = 144_000, max_langs: int | None = None) -> PpmModel | None:
    """Fit on all whole texts of each language.

    labelled: doc_id, text, lang.  Rows with a null in any of the three, or without text, teach
    nothing.  Every language is learned.  max_contexts and min_count bound the trees; contexts
    stay by falling count.  More languages share fewer contexts (max_cells contexts times
    languages, but the empty context and 256 further ones always), so the model stays below
    max_cells KB up to 560 languages and grows by 0.3 MB a language beyond.  max_langs, not used by
    any query, asks for the languages with most labelled rows only.  None if there is nothing to learn from.
    """
    if max_langs is not None:
        most = labelled.where("lang is not null").groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs).select("lang")
        labelled = labelled.select("doc_id", "text", "lang").join(F.broadcast(most), "lang", "left_semi")
    counts = cut(context_counts(_usable(labelled), order))
    langs = counts.agg(F.count_distinct("lang")).first()[0]
    max_contexts = min(max_contexts, max(257, max_cells // max(1, langs)))
    kept = counts.groupBy("k", "ctx").agg(F.sum("n").alias("c")).where((F.col("c") >= min_count) | (F.col("k") == 0))
    kept = kept.orderBy(F.desc("c"), "k", "ctx").limit(max_contexts).select("k", "ctx")
    return build_model(counts.join(F.broadcast(kept), ["k", "ctx"]).toArrow(), order)


def _usable(labelled: DataFrame) -> DataFrame:
    return labelled.select("doc_id", "text", "lang").where("doc_id is not null and lang is not null and length(text) > 0")


def letter_runs(text: str) -> bytes:
    """The words of a text in small letters, as capitals alone make a language's text look foreign; other signs as one blank."""
    return " ".join(LETTERS.findall(text)).lower().encode("utf-8", "replace")


def first_letter_runs(text: str) -> bytes:
    """Those that hold the first bytes of `letter_runs`, as many as the longest of LENGTHS at least where there are so many."""
    words = (m[0] for m in LETTERS.finditer(text))
    out = letter_runs(" ".join(islice(words, LENGTHS[-1] // 4)))
    while len(out) < LENGTHS[-1] and (more := " ".join(islice(words, LENGTHS[-1] // 4))):
        out += b" " + letter_runs(more)
    return out


def letter_limits(held_out: DataFrame, model: PpmModel | None, quantile: float = 0.999, weight: int = 200) -> np.ndarray | None:
    """Bits a byte, by (LENGTHS, language), that letter runs of a language's own held-out texts stay within, and SLACK.

    held_out: doc_id, text, lang of rows that `model` has not learned from.  For each length the
    runs' first bytes are coded under their own language.  A language's limit is the mean of its own
    quantile, weighing as many texts as it has, and that of all languages, weighing `weight` texts; a
    length that no text has takes that of the next shorter one.  All of the rows count, their rates to 1 / STEP bit a byte, so
    quantiles are of counts of few different values.  What comes to the driver is one row for each length and language.
    """
    if model is None:
        return None
    shared = held_out.sparkSession.sparkContext.broadcast(model)

    def rates(batches):
        m = shared.value
        for batch in slices(batches, 4 << 20):
            rows = [(l, first_letter_runs(t)) for l, t in zip(batch.column("lang").to_pylist(), texts_of(batch, "text")) if l in m.langs]
            for i, n in enumerate(LENGTHS):
                part = [(l, r[:n]) for l, r in rows if len(r) >= n]
                bits = code_lengths(m, [r for _, r in part])
                own = [round(float(bits[j, m.langs.index(l)]) / UNIT / n * STEP) for j, (l, _) in enumerate(part)]
                yield pa.RecordBatch.from_pydict({"lang": pa.array([l for l, _ in part], pa.string()), "i": pa.array([i] * len(part), pa.int32()), "rate": pa.array(own, pa.int64())})

    rated = _usable(held_out).mapInArrow(frugal(rates), "lang string, i int, rate long").groupBy("lang", "i", "rate").agg(F.count("*").alias("c"))
    found = rated.cube("lang", "i").agg((F.percentile("rate", F.lit(quantile), F.col("c")) / STEP).alias("q"), F.sum("c").alias("n")).where("i is not null").collect()
    own = {(r["lang"], r["i"]): (r["q"], r["n"]) for r in found}
    limits = np.full((len(LENGTHS), len(model.langs)), np.inf)
    for i in range(len(LENGTHS)):
        for j, lang in enumerate(model.langs):
            if (None, i) in own:
                (q, n), pooled = own.get((lang, i), (0.0, 0)), own[None, i][0]
                limits[i, j] = (n * q + weight * pooled) / (n + weight)
            elif i:
                limits[i, j] = limits[i - 1, j]
    return limits + SLACK


def code_lengths(model: PpmModel, texts: list[bytes]) -> np.ndarray:
    """Exact code length of each text under each language, in 1/UNIT bit."""
    order = model.order
    size = np.array([len(t) for t in texts], np.int64)
    out = np.zeros((len(texts), len(model.langs)), np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if not len(data):
        return out
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    pieces = -(-size // CHUNK)
    doc = np.repeat(np.arange(len(texts)), pieces)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = begin[doc] + nth * CHUNK
    length = np.minimum(CHUNK, size[doc] - nth * CHUNK)
    by_length = np.argsort(-length, kind="stable")
    doc, nth, start, length = doc[by_length], nth[by_length], start[by_length], length[by_length]
    step, cost = model.step.ravel(), model.cost.reshape(-1, len(model.langs))
    state = np.zeros(len(doc), np.int64)
    inner = np.flatnonzero(nth)
    for k in range(order):  # the history of chunks inside a text; CHUNK >= order
        state[inner] = step[state[inner] * 256 + data[start[inner] - order + k]]
    total = np.zeros((len(doc), len(model.langs)), np.int64)
    active = np.searchsorted(-length, -np.arange(CHUNK), side="left")  # pieces longer than k
    for k in range(CHUNK):
        m = active[k]
        if not m:
            break
        at = state[:m] * 256 + data[start[:m] + k]
        total[:m] += cost[at]
        state[:m] = step[at]
    np.add.at(out, doc, total)
    return out


def predict(docs: DataFrame, model: PpmModel | None, keep: tuple[str, ...] = ("doc_id",), limits: np.ndarray | None = None, prefix: str = "") -> DataFrame:
    """Columns `keep`, then lang_pred, score and bits_per_byte of every row's whole text, their names after the prefix.

    lang_pred is `und` (score 0) where the text is null or has no letter, or nothing was
    learned.  score is the posterior of the winner among equal priors.  Ties go to the language
    that sorts first.  bits_per_byte is the winner's code length per byte, null where `und`.
    With letter_limits also `foreign`: the shortest code of the text's letter runs is longer than
    that language's limit for runs of this length.  Digits and signs have no part in that.
    """
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(model)  # bounded by train()'s parameters
    read = list(dict.fromkeys([*keep, "text"]))
    schema = docs.select(*read).schema

    def score(batches):
        m = shared.value
        for batch in slices(batches):
            texts = texts_of(batch, "text")
            known = np.array([m is not None and any(map(str.isalpha, t)) for t in texts], bool)
            lang, p, rate, foreign = [UNKNOWN] * len(texts), np.zeros(len(texts)), [None] * len(texts), np.zeros(len(texts), bool)
            rows = np.flatnonzero(known)
            if len(rows):
                raw = [texts[i].encode("utf-8", "replace") for i in rows]
                bits = code_lengths(m, raw)
                best = bits.argmin(1)
                gap = (bits - bits.min(1, keepdims=True)) / UNIT
                p[rows] = 1 / np.exp2(-np.minimum(gap, 1000)).sum(1)
                for i, b, n, x in zip(rows, best, map(len, raw), bits.min(1)):
                    lang[i], rate[i] = m.langs[b], x / UNIT / n
                if limits is not None:
                    runs = [letter_runs(texts[i]) for i in rows]
                    n = np.maximum(1, [len(r) for r in runs])
                    bits = code_lengths(m, runs)
                    foreign[rows] = bits.min(1) / UNIT / n > limits[np.searchsorted(LENGTHS, n, "right") - 1, bits.argmin(1)]
            cols = {c: batch.column(c) for c in keep}
            cols |= {f"{prefix}lang_pred": pa.array(lang, pa.string()), f"{prefix}score": pa.array(p), f"{prefix}bits_per_byte": pa.array(rate, pa.float64())}
            if limits is not None:
                cols[f"{prefix}foreign"] = pa.array(foreign)
            yield pa.RecordBatch.from_pydict(cols)

    kinds = ", ".join(f"`{c}` {schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*read).mapInArrow(frugal(score), f"{kinds}, {prefix}lang_pred string, {prefix}score double, {prefix}bits_per_byte double{f', {prefix}foreign boolean' if limits is not None else ''}")


def identify(docs: DataFrame, **params) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_byte of every row; learns only where crc32(doc_id) mod 3 is not 1.

    An empty table gives no rows.  Repeated rows are scored each; further columns are ignored.
    """
    model = train(docs.where(fold("doc_id", 3) != 1), **params)
    found = predict(docs, model)
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "bits_per_byte")
