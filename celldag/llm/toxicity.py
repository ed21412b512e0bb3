"""Toxicity by non-negative positive-unlabelled (nnPU) learning.

Confirmed toxic texts are the positives; all other text is unlabelled.  With class prior q, the
risk of a scorer f is q R_P(+) + max(0, R_U(-) - q R_P(-)): the unlabelled texts' risk as
negatives, less the share that positives among them put there, never below zero (Kiryo et
al., 2017).  f is linear over the presence of words and their first letters, with logistic loss, fitted in numpy by
Adam; where the corrected term is negative the step goes up its gradient instead.

Everything learned is bounded by the parameters: how many texts of either kind, how many words.
The word statistics are counted in Spark over the sampled texts.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from celldag.llm.common import fold, frugal, lowest_by_hash, slices, texts_of

WORDS = re.compile(r"[^\W_]+")
_FACTORS = np.array([xxhash.xxh64_intdigest(b"factor", i) | 1 for i in range(16)], np.uint64)


@dataclass
class ToxicityModel:
    words: dict[str, int]
    weights: np.ndarray
    bias: float
    prior: float


def features_of(words: list[str]) -> set[str]:
    """The text's words; and of each 4 or 5 letters that longer ones begin with, whether one, two or three different words do.

    Endings vary more than stems, and a stem that clean text has too tells more the more of its words are there.
    """
    whole = set(words)
    stems = Counter(f"^{w[:n]}" for w in whole for n in (4, 5) if len(w) > n)
    return whole.union(stems, (f"{s}+" for s, n in stems.items() if n > 1), (f"{s}++" for s, n in stems.items() if n > 2))


def fit_nnpu(rows: list[np.ndarray], positive: np.ndarray, size: int, prior: float, steps: int = 600, rate: float = 0.05, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias from each text's sorted word numbers; positive marks the confirmed ones, all others are unlabelled.

    Steps shrink over time, and of all steps the one of least non-negative risk (with the penalty) counts.
    """
    lens = np.array([len(r) for r in rows])
    col = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
    row = np.repeat(np.arange(len(rows)), lens)
    w, b = np.zeros(size), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    best = (np.inf, w, b)
    in_p, in_u = positive / max(1, positive.sum()), ~positive / max(1, (~positive).sum())
    for t in range(1, steps + 1):
        f = np.bincount(row, w[col], minlength=len(rows)) + b
        s = 1 / (1 + np.exp(-np.clip(f, -40, 40)))
        as_negative = np.logaddexp(0, f)
        corrected = in_u @ as_negative - prior * (in_p @ as_negative)
        risk = prior * (in_p @ np.logaddexp(0, -f)) + max(0.0, corrected) + l2 / 2 * (w @ w)
        if risk < best[0]:
            best = (risk, w, b)
        g_negative = (in_u - prior * in_p) * s
        g = prior * in_p * (s - 1) + g_negative if corrected >= 0 else -g_negative
        grad = np.append(np.bincount(col, g[row], minlength=size) + l2 * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        change = rate / (1 + t / 150) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - change[:-1], b - change[-1]
    return best[1], float(best[2])


def _bands(words: list[str]) -> list[int]:
    """Eight MinHash bands, of two hashes each, over the text's 3-word shingles."""
    grams = {xxhash.xxh64_intdigest(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))}
    low = (np.fromiter(grams, np.uint64, len(grams))[:, None] * _FACTORS[None, :]).min(0)
    return (low[::2] ^ (low[1::2] >> np.uint64(7))).view(np.int64).tolist()


def _without_copies(listed: DataFrame) -> DataFrame:
    """One text of each group of copies, exact or near: words of a text that was copied often would look like words of its label.

    A row stays if it is the first, by hash, of its sample's rows in each of its bands.
    """
    rank = F.struct(F.xxhash64("id").alias("h"), "id")
    rows = listed.select("p", rank.alias("rank"), F.posexplode("bands").alias("i", "band"))
    first = rows.groupBy("p", "i", "band").agg(F.min("rank").alias("first"))
    copies = rows.join(first, ["p", "i", "band"]).where("rank <> first").select("p", F.col("rank.id").alias("id")).distinct()
    return listed.join(copies, ["p", "id"], "left_anti").select("p", "words")


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, max_positive: int = 3000, max_unlabelled: int = 6000, max_words: int = 4000, min_docs: int = 3, min_gain: float = 18.0) -> ToxicityModel:
    """Learn from rows whose crc32(doc_id) mod folds is not 0.

    docs: doc_id, text.  labels: doc_id, toxic; a null or absent label is none.  The class prior
    is the share of toxic rows among the labelled ones.  At most max_positive confirmed texts and
    max_unlabelled others (lowest id hash) teach, one of each group of copies; of their words, at most max_words whose
    document frequencies differ most (log-likelihood ratio of min_gain or more, in min_docs
    texts).  With no positives the model gives every text the prior's score.
    """
    seen = labels.select("doc_id", "toxic").where("toxic is not null").where(fold("doc_id", folds) != 0)
    prior = seen.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    prior = min(0.5, max(0.001, prior or 0.0))
    texts = docs.select("doc_id", "text").where(fold("doc_id", folds) != 0).where("length(text) > 0")
    chosen = lowest_by_hash(seen.where("toxic = 1"), "doc_id", max_positive, 1).select("id", F.lit(True).alias("p"))
    other = lowest_by_hash(texts, "doc_id", max_unlabelled, 2).select("id", F.lit(False).alias("p"))
    # A text may be in both samples: the unlabelled ones must keep their share of positives.  Bounded by the two parameters.
    ids = chosen.unionByName(other)
    found = texts.join(F.broadcast(ids), F.col("doc_id") == F.col("id")).select("id", "text", "p")
    # An id that is on several rows teaches by one of them.
    sample = found.groupBy("id", "p").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("id", "text", "p").persist()

    def words(batches):
        for batch in slices(batches):
            found = [WORDS.findall(t.lower()) for t in texts_of(batch, "text")]
            cols = {c: batch.column(c) for c in ("id", "p")}
            yield pa.RecordBatch.from_pydict(cols | {"words": pa.array([sorted(features_of(f)) for f in found], pa.list_(pa.string())), "bands": pa.array(list(map(_bands, found)), pa.list_(pa.int64()))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    listed = _without_copies(sample.mapInArrow(frugal(words), f"id {kind}, p boolean, words array<string>, bands array<long>")).persist()
    n_p, n_u = (x or 0 for x in listed.agg(F.sum(F.col("p").cast("int")), F.sum((~F.col("p")).cast("int"))).first())
    if not n_p or not n_u:
        sample.unpersist()
        listed.unpersist()
        return ToxicityModel({}, np.zeros(0), float(np.log(prior / (1 - prior))), prior)
    in_docs = listed.select("p", F.explode("words").alias("word")).groupBy("word").agg(F.sum(F.col("p").cast("int")).alias("a"), F.sum((~F.col("p")).cast("int")).alias("b"))
    a, b = F.col("a") + 0.0, F.col("b") + 0.0
    both = (a + b) / (n_p + n_u)
    part = lambda x, n: x * F.log(F.greatest(x, F.lit(1e-9)) / (n * both)) + (n - x) * F.log(F.greatest(n - x, F.lit(1e-9)) / (n * (1 - both) + 1e-9))
    gain = 2 * (part(a, n_p) + part(b, n_u))
    best = in_docs.where(a + b >= min_docs).withColumn("gain", gain).where(F.col("gain") >= min_gain)
    vocab = {r["word"]: i for i, r in enumerate(best.orderBy(F.desc("gain"), "word").limit(max_words).collect())}
    shared = listed.sparkSession.sparkContext.broadcast(vocab)

    def numbers(batches):
        for batch in batches:
            of = shared.value
            found = [[of[w] for w in ws if w in of] for ws in batch.column("words").to_pylist()]
            yield pa.RecordBatch.from_pydict({"p": batch.column("p"), "at": pa.array(found, pa.list_(pa.int32()))})

    rows = listed.mapInArrow(frugal(numbers), "p boolean, at array<int>").collect()
    sample.unpersist()
    listed.unpersist()
    w, b0 = fit_nnpu([np.array(sorted(r["at"]), np.int64) for r in rows], np.array([r["p"] for r in rows], bool), len(vocab), prior)
    return ToxicityModel(vocab, w, b0, prior)


def score(docs: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """Columns `keep`, then score and predicted (their names after the prefix) of every row's whole text; a null text counts as empty and gets the bias's score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most max_words words
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    read = list(dict.fromkeys([*keep, "text"]))

    def run(batches):
        m = shared.value
        known = m.words.keys()
        for batch in slices(batches):
            f = [m.bias + sum(m.weights[m.words[w]] for w in sorted(known & features_of(WORDS.findall(t.lower())))) for t in texts_of(batch, "text")]
            p = 1 / (1 + np.exp(-np.clip(np.array(f, float), -40, 40)))
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in keep} | {f"{prefix}score": pa.array(p), f"{prefix}predicted": pa.array((p >= 0.5).astype(np.int32))})

    return docs.select(*read).mapInArrow(frugal(run), f"{kinds}, {prefix}score double, {prefix}predicted int")


def classify(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; held_out rows (crc32(doc_id) mod 5 is 0) teach nothing.

    Empty tables give no rows or, without labels, the lowest prior.  Repeated rows are scored
    each; further columns are ignored.
    """
    found = score(docs, train(docs, labels, **params))
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
