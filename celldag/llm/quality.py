"""Quality by Bradley-Terry pairwise ranking.

A text has a score w.x, and that of two texts a is preferred to b has probability 1 / (1 + exp(w.(x_b - x_a))).  From
pairs of a good and a poor text, w is learned by the logistic loss on differences of features.  Only
differences count, so scores have no zero of their own: the threshold is the quantile of the scores of labelled
texts at the share of poor ones.

Features say how a text is written, not what it says: rates of three kinds of character in a row, drawn to the usual ones where a text is short, and rates
over words (shouted, repeated, tailed by signs, without a letter) both in the whole text and in its worst run of words, so that junk in a part of a long
text is seen.  They are computed in numpy over whole texts.
"""

from __future__ import annotations

import math
import operator
import uuid
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from celldag.llm.common import fold, frugal, frugal_group, shared_folder, slices, texts_of

LETTER, UPPER, DIGIT, SPACE, LINE, STOP, SIGN = range(7)
KINDS = 7
STOPS = ".,;:'\"-()?"
RUN = 32  # words
SHARED = 200.0  # characters
WORD_RATES = ("shouted", "repeated", "tailed", "bare", "long")
SIZE = KINDS**3 + 2 * len(WORD_RATES) + 4
THRESHOLD = 0.3  # of the final score
PAIRS_AT_ONCE = 2000
GROUP = 1000  # texts of the rarer side that meet others
BROADCAST_IDS = 500_000
BINS, AT_ONCE = 1024, 100_000  # scores are counted in so many bins until so few are left


@dataclass
class QualityModel:
    base: np.ndarray  # rates of three kinds in a row over all texts
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float  # of w.x
    prior: float | None  # the score of every text where labels have one side only


@lru_cache(1)
def kinds() -> np.ndarray:
    """The kind of each code point."""
    out = np.full(0x110000, SIGN, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            out[i] = UPPER if c.isupper() else LETTER
        elif c.isdigit():
            out[i] = DIGIT
        elif c.isspace():
            out[i] = SPACE
    out[ord("\n")] = LINE
    out[[ord(c) for c in STOPS]] = STOP
    return out


def features_of(text: str) -> np.ndarray:
    """SIZE numbers; all 0 for a text without words."""
    out = np.zeros(SIZE)
    words = text.split()
    if not words:
        return out
    kind = kinds()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    grams = kind[:-2].astype(np.int64) * KINDS * KINDS + kind[1:-1].astype(np.int64) * KINDS + kind[2:]
    out[: KINDS**3] = np.bincount(grams, minlength=KINDS**3)
    blank = np.concatenate([[True], (kind == SPACE) | (kind == LINE), [True]])
    starts, ends = np.flatnonzero(blank[:-1] & ~blank[1:]), np.flatnonzero(~blank[:-1] & blank[1:])
    total = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    upper, letters, alnum = (total(m) for m in (kind == UPPER, kind <= UPPER, kind <= DIGIT))
    n_letters = letters[ends] - letters[starts]
    rates = np.zeros((len(WORD_RATES), len(starts)))
    rates[0] = (n_letters > 1) & (upper[ends] - upper[starts] == n_letters)
    rates[1, 1 : len(words)] = np.fromiter(map(operator.eq, words, words[1:]), bool, len(words) - 1)[: len(starts) - 1]
    rates[2] = (ends - starts > 2) & (kind[ends - 1] == SIGN) & (kind[np.maximum(ends - 2, 0)] == SIGN)
    rates[3] = alnum[ends] == alnum[starts]
    rates[4] = np.minimum(ends - starts, 40) / 10
    runs = np.arange(0, max(1, len(starts) - RUN // 4), RUN)  # a short rest belongs to the run before
    sizes = np.diff(np.append(runs, len(starts)))
    at = KINDS**3
    out[at : at + 5] = rates.mean(1)
    out[at + 5 : at + 10] = (np.add.reduceat(rates, runs, axis=1) / sizes).max(1)
    lines = [x for x in text.split("\n") if x.strip()]
    out[at + 10 :] = np.log1p(len(words)), len(set(words)) / len(words), 1 - len(set(lines)) / len(lines), len(words) / len(lines) / 100
    return out


def rates_of(x: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Features with counts of three kinds in a row made into rates, which those of short texts share with the usual ones.

    Roots, as the step from none to few says more than that from few to more.
    """
    counts = x[:, : KINDS**3]
    return np.hstack([np.sqrt((counts + SHARED * base) / (counts.sum(1, keepdims=True) + SHARED)), x[:, KINDS**3 :]])


def pair_sums(x: np.ndarray, good: np.ndarray, poor: np.ndarray, w: np.ndarray) -> tuple[int, float, np.ndarray, np.ndarray]:
    """Number of pairs, and the sums over them of log(1 + exp(-w.d)), of its gradient and of its second derivatives, d = x[good] - x[poor]."""
    loss, g, h = 0.0, np.zeros(len(w)), np.zeros((len(w), len(w)))
    for i in range(0, len(good), PAIRS_AT_ONCE):
        d = x[good[i : i + PAIRS_AT_ONCE]] - x[poor[i : i + PAIRS_AT_ONCE]]
        f = d @ w
        pull = 1 / (1 + np.exp(np.clip(f, -40, 40)))
        loss += float(np.logaddexp(0, -f).sum())
        g -= pull @ d
        h += (d * (pull * (1 - pull))[:, None]).T @ d
    return len(good), loss, g, h


def newton(sums, size: int, l2: float, steps: int) -> np.ndarray:
    """Weights w of least mean loss + l2 / 2 |w|^2 by Newton's steps, halved where one leads up.  sums: w to what `pair_sums` gives over all pairs."""
    w = best = np.zeros(size)
    risk = np.inf
    for _ in range(steps):
        n, loss, g, h = sums(w)
        now = loss / n + l2 / 2 * (w @ w)
        if now > risk + 1e-12:
            w = (w + best) / 2
            continue
        best, risk, slope = w, now, g / n + l2 * w
        if np.abs(slope).max() < 1e-6:
            break
        w = w - np.linalg.solve(h / n + l2 * np.eye(size), slope)
    return best


def fit_pairs(x: np.ndarray, good: np.ndarray, poor: np.ndarray, steps: int = 50, l2: float = 1e-3) -> np.ndarray:
    """Weights w of least mean log(1 + exp(-w.(x[good] - x[poor]))) + l2 / 2 |w|^2 over the pairs."""
    return newton(lambda w: pair_sums(x, good, poor, w), x.shape[1], l2, steps)


def quantile_between(scores: np.ndarray, weights: np.ndarray, level: float) -> float:
    """A value with the share `level` of the weight below it: the middle between two neighbouring scores."""
    order = np.argsort(scores, kind="stable")
    scores, share = scores[order], np.cumsum(weights[order]) / weights.sum()
    i = min(int(np.searchsorted(share, level - 1e-9)), len(scores) - 2)
    return float((scores[i] + scores[i + 1]) / 2) if len(scores) > 1 else float(scores[0])


def quantile_of_all(scored: DataFrame, weight: tuple[float, float], level: float) -> float:
    """`quantile_between` of rows (s, good) that weigh weight[good] each: bins are counted and the one that matters is cut again until few rows are left."""
    below, above, rows = 0.0, None, scored
    n, lo, hi = scored.agg(F.count("*"), F.min("s"), F.max("s")).first()
    total = sum(weight[r["good"]] * r["count"] for r in scored.groupBy("good").count().collect())
    before = None
    while n > AT_ONCE and hi > lo:
        at = F.least(F.lit(BINS - 1), F.floor((F.col("s") - lo) / (hi - lo) * BINS))
        bins = sorted(rows.groupBy(at.alias("i"), "good").agg(F.count("*").alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi")).collect(), key=lambda r: r["i"])
        sums = {}
        for r in bins:
            w, m, x, y = sums.get(r["i"], (0.0, 0, np.inf, -np.inf))
            sums[r["i"]] = w + weight[r["good"]] * r["n"], m + r["n"], min(x, r["lo"]), max(y, r["hi"])
        listed = list(sums.items())
        for j, (i, (w, m, x, y)) in enumerate(listed):
            if (below + w) / total >= level - 1e-9 or j == len(listed) - 1:
                break
            below, before = below + w, y
        if j + 1 < len(listed):
            above = listed[j + 1][1][2]
        rows, n, lo, hi = rows.where(at == i), m, x, y
    if hi == lo:  # all alike, so one and its number say enough
        got = [(lo, below + sum(weight[r["good"]] * r["count"] for r in rows.groupBy("good").count().collect()))]
        if n > 1 and (above is None or got[0][1] / total - max(weight) / total >= level - 1e-9):
            return float(lo)
    else:
        got = sorted((r["s"], weight[r["good"]]) for r in rows.collect())
        got = list(zip([x for x, _ in got], (below + np.cumsum([w for _, w in got])).tolist()))
    edge = next((i for i, (_, w) in enumerate(got) if w / total >= level - 1e-9), len(got) - 1)
    if edge + 1 < len(got):
        return (got[edge][0] + got[edge + 1][0]) / 2
    if above is not None:
        return (got[edge][0] + above) / 2
    last = got[edge - 1][0] if edge else before if before is not None else got[edge][0]
    return (last + got[edge][0]) / 2


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, min_pairs: int = 40_000, seed: int = 1) -> QualityModel:
    """Learn from all labelled rows whose crc32(doc_id) mod folds is not 0.

    docs: doc_id, text.  labels: doc_id, quality (1 good, 0 poor); a null or absent label is none.  Of equal texts with one label
    only one teaches; an id on several rows teaches by one of them.  Each text of the commoner side meets one of the other, drawn by `seed`, or as many as make
    min_pairs; those of the rarer side meet several.  Texts meet in groups of bounded size, and groups send sums.  Where a side is missing, every text gets the
    share of good labels, or 0.5 without labels.
    """
    seen = labels.select("doc_id", "quality").where("quality in (0, 1)").where(fold("doc_id", folds) != 0)
    n = {r["quality"]: r["count"] for r in seen.groupBy("quality").count().collect()}
    share = n.get(0, 0) / max(1, sum(n.values()))
    ids = seen.where("doc_id is not null").select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("good")).distinct()
    if sum(n.values()) <= BROADCAST_IDS:  # some 20 bytes each; beyond, the texts are shuffled
        ids = F.broadcast(ids)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(fold("doc_id", folds) != 0)
    found = texts.join(ids, F.col("doc_id") == F.col("id")).select("doc_id", "good", F.xxhash64("text").alias("h"), "text")

    def run(batches):
        for batch in slices(batches):
            x = [features_of(t).astype(np.float32).tobytes() for t in texts_of(batch, "text")]
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("doc_id", "good", "h")} | {"x": pa.array(x, pa.binary())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    read = found.mapInArrow(frugal(run), f"doc_id {kind}, good int, h long, x binary")
    one = read.groupBy("doc_id", "good").agg(F.min_by(F.struct("h", "x"), "h").alias("t"))
    rows = _written(one.groupBy("good", "t.h").agg(F.first("t.x").alias("x")))  # SIZE numbers each

    def added(f, schema: str) -> list[np.ndarray]:
        """Sums over all rows of what f says of a batch: by task, then here."""

        def task(batches):
            out = None
            for batch in batches:
                if batch.num_rows:
                    got = [np.asarray(v, float) for v in f(_matrix(batch.column("x").to_pylist()))]
                    out = got if out is None else [a + b for a, b in zip(out, got)]
            if out is not None:
                yield pa.RecordBatch.from_pydict({c: pa.array([v.tolist()], pa.list_(pa.float64())) for c, v in zip(schema.split(), out)})

        got = rows.select("x").mapInArrow(frugal(task), ", ".join(f"{c} array<double>" for c in schema.split())).collect()
        return [np.sum([np.array(r[c]) for r in got], 0) for c in schema.split()]

    sides = {r["good"]: r["count"] for r in rows.groupBy("good").count().collect()}
    if len(sides) < 2:
        return QualityModel(np.zeros(KINDS**3), np.zeros(SIZE), np.ones(SIZE), np.zeros(SIZE), 0.0, 1 - share if n else 0.5)
    (counts,) = added(lambda x: [x[:, : KINDS**3].sum(0)], "counts")
    base = counts / max(1.0, counts.sum())
    (total,) = added(lambda x: [rates_of(x, base).sum(0)], "total")
    mean = total / sum(sides.values())
    (square,) = added(lambda x: [((rates_of(x, base) - mean) ** 2).sum(0)], "square")
    scale = np.maximum(np.sqrt(square / sum(sides.values())), 1e-3)
    standard = lambda x: np.clip((rates_of(x, base) - mean) / scale, -8, 8)

    # Groups of some GROUP texts of the rarer side, or all, and up to 4 GROUP of the other; each text of the rarer side is in all `parts` of its block.
    rarer = min(sides, key=lambda g: (sides[g], g))
    few, many = sides[rarer], sides[1 - rarer]
    blocks = max(1, few // GROUP)
    parts = max(1, -(-many // (4 * GROUP * blocks)))
    each = max(1, min_pairs // many)
    part = F.when(F.col("good") == rarer, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.pmod(F.xxhash64("h", F.lit(2)), F.lit(parts)).cast("int")))
    placed = rows.select("*", F.pmod(F.xxhash64("h", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), F.explode(part).alias("part"))

    def meet(t: pa.Table) -> pa.Table:
        t = t.sort_by([("good", "ascending"), ("h", "ascending")])
        return pa.table({"block": t.column("block")[:1], "part": t.column("part")[:1], "good": pa.array([sum(t.column("good").to_pylist())], pa.int32()), "x": pa.array([b"".join(t.column("x").to_pylist())], pa.binary())})

    groups = _written(placed.groupBy("block", "part").applyInArrow(frugal_group(meet), "block int, part int, good int, x binary"))
    heads = max(1, math.isqrt(blocks * parts))

    def sums(w: np.ndarray) -> tuple[int, float, np.ndarray, np.ndarray]:
        def packed(head, out):
            return {"head": pa.array([head], pa.int32()), "sums": pa.array([np.concatenate([np.ravel(v).astype(float) for v in out]).tobytes()], pa.binary())}

        def task(batches):
            out, head = None, 0
            for batch in batches:
                for r in batch.to_pylist():
                    z = standard(_matrix([r["x"]]))
                    rng, poor = np.random.default_rng([seed, r["block"], r["part"]]), len(z) - r["good"]
                    if not poor or poor == len(z):
                        continue
                    size = max(poor, r["good"]) * each
                    pairs = [rng.permutation(np.resize(side, size)) for side in (np.arange(poor, len(z)), np.arange(poor))]
                    got = pair_sums(z, *pairs, w)
                    out, head = got if out is None else tuple(a + b for a, b in zip(out, got)), (r["block"] * parts + r["part"]) % heads
            if out is not None:
                yield pa.RecordBatch.from_pydict(packed(head, out))

        def met(t: pa.Table) -> pa.Table:
            return pa.table(packed(0, [sum(np.frombuffer(x) for x in t.column("sums").to_pylist())]))

        of_tasks = groups.mapInArrow(frugal(task), "head int, sums binary")
        found = [np.frombuffer(r["sums"]) for r in of_tasks.groupBy("head").applyInArrow(frugal_group(met), "head int, sums binary").collect()]
        v = np.sum(found, 0)
        return int(v[0]), float(v[1]), v[2 : 2 + SIZE], v[2 + SIZE :].reshape(SIZE, SIZE)

    w = newton(sums, SIZE, 1e-3, 50)

    def scores(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"s": pa.array(standard(_matrix(batch.column("x").to_pylist())) @ w if batch.num_rows else np.empty(0)), "good": batch.column("good")})

    scored = _written(rows.mapInArrow(frugal(scores), "s double, good int"))
    # Equal texts teach once, so sides have other shares here than among the labels.
    return QualityModel(base, mean, scale, w, quantile_of_all(scored, (share / sides[0], (1 - share) / sides[1]), share), None)


def _matrix(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.float32).reshape(-1, SIZE).astype(float)


def _written(df: DataFrame) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/quality-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def score_texts(texts: list[str], m: QualityModel) -> np.ndarray:
    """1 / (1 + exp(-(w.x - threshold) - logit(0.3))): 0.3 at the quantile."""
    if m.prior is not None or not texts:
        return np.full(len(texts), m.prior if m.prior is not None else 0.0)
    z = np.clip((rates_of(np.array([features_of(t) for t in texts]), m.base) - m.mean) / m.scale, -8, 8)
    above = (z * m.weights).sum(1) - m.threshold + np.log(THRESHOLD / (1 - THRESHOLD))
    return 1 / (1 + np.exp(-np.clip(above, -40, 40)))


def score(docs: DataFrame, model: QualityModel, keep: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """Columns `keep`, then score and predicted (their names after the prefix) of every row's whole text; a null text counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SIZE numbers
    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    read = list(dict.fromkeys([*keep, "text"]))

    def run(batches):
        for batch in slices(batches):
            p = score_texts(texts_of(batch, "text"), shared.value)
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in keep} | {f"{prefix}score": pa.array(p), f"{prefix}predicted": pa.array((p >= THRESHOLD).astype(np.int32))})

    return docs.select(*read).mapInArrow(frugal(run), f"{types}, {prefix}score double, {prefix}predicted int")


def classify(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; held_out rows (crc32(doc_id) mod 5 is 0) teach nothing.

    Empty tables give no rows or, without labels, scores of 0.5.  Repeated rows are scored each, alike; equal texts get equal scores; further
    columns are ignored.
    """
    found = score(docs, train(docs, labels, **params))
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
