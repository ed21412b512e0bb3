"""Exact n-gram Jaccard join of whole texts by vertical partitioning.

All n-grams are put in one global order, rarest first, and that order is cut into fragments.
Overlaps are counted fragment by fragment and summed: first per document, then per pair.

1. Per document.  A document can only have a partner if at least `percent` % of its n-grams
   occur in another document.  Each task cuts its documents' n-gram hashes into fragments; a
   fragment's reducer tells for each document how many of its n-grams there are shared; the sums
   rule out most documents.  A task sends an n-gram once, however many of its documents
   have it, so a passage that a third of all documents share is no hot key.
2. Equal n-gram sets, told by 128-bit signatures, become one representative with a number.
3. Stars.  Two sets that are alike enough share an n-gram in their prefixes, the first
   n - ceil(percent * n / 100) + 1 of the order.  For each prefix n-gram one of its sets, by hash,
   is compared with the others.  What the links connect is one component from then on; further
   rounds (ROUNDS), with another set for each n-gram, would compare only sets of different components.
4. Sets that share a prefix n-gram and are still in different components are compared, all of them.

Before a pair is counted, bounds must hold: on the sizes, on the difference that two bit maps show, and in
step 4 on the places at which the shared n-gram stands in both (what comes before it in the order can't be
shared if it is their first).  Then each fragment of the order gives the pair's partial
overlap, the partial overlaps are summed, and the sum decides.  Bounds only rule out pairs that
can't link, and a pair is left out only when its two sets are connected already, so
components are exact (up to collisions of n-gram hashes of 64 bits).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from celldag.llm.common import cut, frugal, frugal_group, slices, texts_of
from celldag.llm.components import connected

BITS = 8  # 64-bit words of the bit map
WIDTH = 5  # bytes of an n-gram's hash that go to a fragment's reducer, besides the fragment's number
FLUSH, LARGEST_FLUSH, RUN = 2_000_000, 16_000_000, 20  # n-grams that a task gathers before it sends them: RUN for each fragment, within these (8 bytes each, and as much again twice to sort them)
FRAGMENT, LARGEST = 1_500_000, 20_000_000  # n-grams that a fragment of step 1 is meant to hold: a thousandth of all, within these
SEGMENTS = 8  # fragments of steps 3 and 4
ROUNDS = 1  # of step 3
BROADCAST_IDS = 500_000

_SALT = np.array([int.from_bytes(hashlib.sha256(b"%d" % i).digest()[:8], "little") | 1 for i in range(64)], np.uint64)


class _WordHash(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:  # some 15 MB
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: list[str], k: int, word_hash: _WordHash) -> list[np.ndarray]:
    """The sorted distinct k-gram hashes of each text; with fewer words, that of the whole sequence; without, none.

    Words are runs of other bytes than ASCII white space, A-Z lower-cased.
    """
    words = [t.encode("utf-8", "replace").lower().split() for t in texts]
    get = word_hash.__getitem__
    h = np.fromiter((get(w) for ws in words for w in ws), np.uint64, sum(map(len, words)))
    grams = np.zeros(max(0, len(h) - k + 1), np.uint64)
    short = np.zeros(1, np.uint64)
    for j in range(k):
        grams += h[j : len(h) - k + 1 + j] * _SALT[j]
    grams = _mixed(grams)
    out, at = [], 0
    for ws in words:
        n = len(ws)
        if n >= k:
            out.append(np.unique(grams[at : at + n - k + 1]))
        elif n:
            out.append(_mixed(short + (h[at : at + n] * _SALT[:n]).sum(dtype=np.uint64) + _SALT[32 + n : 33 + n]))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


def _signature(s: np.ndarray) -> str:
    return hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest()


def _pack(x: np.ndarray) -> bytes:
    return x.view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // WIDTH, 8), np.uint8)
    out[:, :WIDTH] = np.frombuffer(raw, np.uint8).reshape(-1, WIDTH)
    return out.view(np.uint64).ravel()


def shared_counts(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, row, n, shared, sig) of every (doc_id, row, text): set size, how many of its n-grams another row has too, and the set's signature."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    fragments = max(8, -(-chars // (6 * min(LARGEST, max(FRAGMENT, chars // 6000)))))
    gathered = max(FLUSH, min(LARGEST_FLUSH, RUN * fragments))
    kind = docs.schema["doc_id"].dataType.simpleString()
    head = f"ids array<{kind}>, keys array<binary>, n array<int>, local array<int>, sigs array<string>"
    names = ("fragment", "task", "once", "owner", "many", "ids", "keys", "n", "local", "sigs")

    def send(batches):
        word_hash, sets, ids, keys, size, part = _WordHash(), [], [], [], 0, TaskContext.get().partitionId()
        sent = 0

        def flush():
            token = np.concatenate([*sets, np.empty(0, np.uint64)])
            owner = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in sets])
            order = np.argsort(token, kind="stable")
            token, owner = token[order], owner[order]
            first = np.concatenate([[True], token[1:] != token[:-1]]) if len(token) else np.zeros(0, bool)
            count = np.diff(np.append(np.flatnonzero(first), len(token)))
            single = np.repeat(count == 1, count)
            local = np.bincount(owner[~single], minlength=len(sets))
            once, whose, many = token[single], owner[single], token[first & ~single]
            of = lambda t: ((t >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)
            at_once, at_many = of(once), of(many)
            used = np.union1d(at_once, at_many)
            bounds = [np.searchsorted(x, used, side) for x in (at_once, at_many) for side in ("left", "right")]
            task = f"{part}-{sent}"
            rows = {x: [] for x in names}

            def add(*values):
                for x, v in zip(names, values):
                    rows[x].append(v)

            for f, a, b, c, d in zip(used.tolist(), *bounds):
                add(f, task, _pack(once[a:b]), whose[a:b].tobytes(), _pack(many[c:d]), None, None, None, None, None)
            # What the documents of this task are: sent along, to a reducer by its own key.
            add(-1 - (xxhash.xxh32_intdigest(task) & 0x7FFFFFFF), task, None, None, None, ids, keys, [len(s) for s in sets], local.tolist(), [_signature(s) for s in sets])
            types = (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.list_(id_kind), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()))
            return pa.RecordBatch.from_arrays([pa.array(rows[x], t) for x, t in zip(names, types)], names=list(names))

        id_kind = pa.int64()
        for batch in slices(batches, 4 << 20):
            id_kind = batch.schema.field("doc_id").type
            found = shingle_sets(texts_of(batch, "text"), k, word_hash)
            for i, row, s in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), found):
                ids.append(i)
                keys.append(row)
                sets.append(s)
                size += len(s)
                if size >= gathered or len(sets) >= 60_000:
                    yield flush()
                    sets, ids, keys, size, sent = [], [], [], 0, sent + 1
        if sets:
            yield flush()

    def meet(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        out = [{"task": r["task"], "ids": r["ids"], "keys": r["keys"], "n": r["n"], "local": r["local"], "sigs": r["sigs"]} for r in rows if r["fragment"] < 0]
        rows = [r for r in rows if r["fragment"] >= 0]
        if rows:
            once = [_unpack(r["once"]) for r in rows]
            token = np.concatenate(once)
            many = np.unique(np.concatenate([_unpack(r["many"]) for r in rows]))
            order = np.argsort(token, kind="stable")
            s = token[order]
            same = np.zeros(len(s), bool)
            same[1:] = s[1:] == s[:-1]
            same[:-1] |= same[1:]
            shared = np.zeros(len(s), bool)
            shared[order] = same
            shared |= np.isin(token, many, assume_unique=False)
            at = 0
            for r, x in zip(rows, once):
                owner = np.frombuffer(r["owner"], np.uint16)[shared[at : at + len(x)]]
                at += len(x)
                if len(owner):
                    who, n = np.unique(owner, return_counts=True)
                    out.append({"task": r["task"], "who": who.tobytes(), "count": n.astype(np.uint32).tobytes()})
        return pa.Table.from_pylist(out, schema=pa.schema([("task", pa.string()), ("ids", t.schema.field("ids").type), ("keys", pa.list_(pa.binary())), ("n", pa.list_(pa.int32())), ("local", pa.list_(pa.int32())), ("sigs", pa.list_(pa.string())), ("who", pa.binary()), ("count", pa.binary())]))

    def total(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        own = next(r for r in rows if r["n"] is not None)
        shared = np.array(own["local"], np.int64)
        for r in rows:
            if r["who"] is not None:
                shared[np.frombuffer(r["who"], np.uint16)] += np.frombuffer(r["count"], np.uint32)
        return pa.table({"doc_id": pa.array(own["ids"], t.schema.field("ids").type.value_type), "row": pa.array(own["keys"], pa.binary()), "n": pa.array(own["n"], pa.int32()), "shared": pa.array(shared, pa.int32()), "sig": pa.array(own["sigs"], pa.string())})

    sent = docs.select("doc_id", "row", "text").mapInArrow(frugal(send), f"fragment long, task string, once binary, owner binary, many binary, {head}")
    met = sent.groupBy("fragment").applyInArrow(frugal_group(meet), f"task string, {head}, who binary, count binary")
    return met.groupBy("task").applyInArrow(frugal_group(total), f"doc_id {kind}, row binary, n int, shared int, sig string")


def row_key() -> Column:
    """A 128-bit hash of id and text, not null; exact repeats have the same."""
    part = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    return F.unhex(F.md5(F.concat(part("doc_id"), part("text"))))


def sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(key, n, tokens, bits) of the wanted (row, sig, key): the n-gram hashes and their parities by position in a bit map."""

    def read(batches):
        word_hash, seen = _WordHash(), set()  # a repeated row gives its set once
        for batch in slices(batches, 4 << 20):
            batch = batch.filter(pa.array([x not in seen for x in batch.column("key").to_pylist()], pa.bool_()))
            sets = shingle_sets(texts_of(batch, "text"), k, word_hash)
            right = [i for i, (s, sig) in enumerate(zip(sets, batch.column("sig").to_pylist())) if _signature(s) == sig]
            sets = [sets[i] for i in right]
            keys = batch.column("key").take(pa.array(right, pa.int64()))
            seen.update(keys.to_pylist())
            bits = []
            for s in sets:
                parity = np.bincount((s % np.uint64(64 * BITS)).astype(np.int64), minlength=64 * BITS) & 1
                bits.append(np.packbits(parity.astype(np.uint8)).view(np.int64))
            yield pa.RecordBatch.from_pydict(
                {
                    "key": keys,
                    "n": pa.array([len(s) for s in sets], pa.int32()),
                    "tokens": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                    "bits": pa.array(bits, pa.list_(pa.int64())),
                }
            )

    found = docs.select(row_key().alias("row"), "text").join(wanted, "row").select("key", "sig", "text")
    return found.mapInArrow(frugal(read), "key long, n int, tokens array<long>, bits array<long>").dropDuplicates(["key"])


def ordered_sets(sets: DataFrame, percent: int) -> DataFrame:
    """(key, n, bits, prefix, segments): the prefix's shared n-grams t with their places p in the order, and all shared n-grams by fragment."""
    token = sets.select("key", F.explode("tokens").alias("t"))
    frequency = token.groupBy("t").agg(F.count("*").cast("int").alias("f")).where("f > 1")
    shared = token.join(frequency, "t").select("key", "f", "t")
    listed = shared.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("f", "t"))).alias("o"))
    n = F.col("n")
    alone = n - F.size("o")  # n-grams in no other set come first
    length = n - F.floor((n * percent + 99) / 100).cast("int") + 1 - alone
    rows = listed.join(sets.select("key", "n", "bits"), "key").where(length > 0)
    part = lambda i: F.transform(F.filter("o", lambda x: _segment_of(x) == i), lambda x: x["t"])
    prefix = F.transform(F.slice("o", F.lit(1), length), lambda x, i: F.struct((alone + i).alias("p"), x["t"].alias("t")))
    return rows.select("key", "n", "bits", prefix.alias("prefix"), F.array(*[part(i) for i in range(SEGMENTS)]).alias("segments"))


def _segment_of(x: Column) -> Column:
    """The fragment of the global order (frequency, then hash) that an n-gram is in: rising in that order."""
    f, t = x["f"], x["t"]
    quarter = F.when(t < -(1 << 62), 0).when(t < 0, 1).when(t < (1 << 62), 2).otherwise(3)
    return F.when(f <= 2, quarter).when(f == 3, 4).when(f == 4, 5).when(f <= 8, 6).otherwise(7)


def _may_link(percent: int, a: str, b: str, first: bool) -> Column:
    """Bounds for two sets (n, p, bits) that share an n-gram: on sizes and on the difference; with `first` also on its places.

    A link needs an overlap of percent / (100 + percent) of both sizes.  Sets that differ in d parities of their bit maps differ in d n-grams
    at least.  If the n-gram is the first that they share, no more than what follows in either is shared; so where all pairs meet, each
    need only be seen there, but where a set meets one other for each n-gram, any shared one will do.
    """
    n_a, n_b, p_a, p_b = (F.col(f"{c}_{x}") for c in ("n", "p") for x in (a, b))
    bits_a, bits_b = F.col(f"bits_{a}"), F.col(f"bits_{b}")
    apart = sum((F.bit_count(bits_a[i].bitwiseXOR(bits_b[i])) for i in range(1, BITS)), F.bit_count(bits_a[0].bitwiseXOR(bits_b[0])))
    both = (n_a + n_b) * percent
    sizes = F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent
    places = F.least(n_a - p_a, n_b - p_b) * (100 + percent) >= both
    alike = sizes & ((n_a + n_b - apart) * (100 + percent) >= 2 * both)
    return alike & places if first else alike


def links(pairs: DataFrame, ordered: DataFrame, percent: int) -> DataFrame:
    """Those pairs (u, v, and further columns) whose overlap reaches the threshold: partial overlaps of each fragment, summed per pair."""
    pairs = cut(pairs)
    used = pairs.select(F.explode(F.array("u", "v")).alias("key")).distinct()
    if used.count() <= BROADCAST_IDS:  # beyond, they are shuffled
        used = F.broadcast(used)
    ordered = ordered.join(used, "key", "left_semi")  # late pairs are of few sets
    part = ordered.select("key", "n", F.posexplode("segments").alias("fragment", "tokens")).where(F.size("tokens") > 0)
    one = part.select(F.col("key").alias("u"), "fragment", F.col("n").alias("n_u"), F.col("tokens").alias("t_u"))
    two = part.select(F.col("key").alias("v"), "fragment", F.col("n").alias("n_v"), F.col("tokens").alias("t_v"))
    partial = pairs.join(one, "u").join(two, ["v", "fragment"])
    shared = F.size(F.array_intersect("t_u", "t_v"))
    summed = partial.groupBy(*pairs.columns, (F.col("n_u") + F.col("n_v")).alias("n")).agg(F.sum(shared).alias("o"))
    return summed.where(F.col("o") * 100 >= percent * (F.col("n") - F.col("o"))).select(*pairs.columns)


def components(ordered: DataFrame, percent: int) -> DataFrame:
    """(key, root) of every set: root is a number that all sets of its component have, and no others."""
    place = ordered.select("key", "n", "bits", F.explode("prefix").alias("x"))
    held = cut(place.select("key", "n", "bits", F.col("x.p").alias("p"), F.col("x.t").alias("t")))
    named = held.withColumn("root", F.col("key"))
    label = None

    def side(rows: DataFrame, x: str) -> DataFrame:
        return rows.select("t", *[F.col(c).alias(f"{c}_{x}") for c in ("key", "n", "p", "bits", "root")])

    def joined(pairs: DataFrame) -> DataFrame:
        """The labels, once the links among the pairs (key_a, key_b, root_a, root_b) connect what they do.  Only roots are connected."""
        a_first = F.col("key_a") > F.col("key_b")
        chosen = pairs.select(F.greatest("key_a", "key_b").alias("u"), F.least("key_a", "key_b").alias("v"), F.when(a_first, F.col("root_a")).otherwise(F.col("root_b")).alias("root_u"), F.when(a_first, F.col("root_b")).otherwise(F.col("root_a")).alias("root_v"))
        found = links(chosen.distinct(), ordered, percent).select(F.col("root_u").alias("u"), F.col("root_v").alias("v"))
        merged = connected(found)
        if label is None:
            return merged.select(F.col("node").alias("key"), "root")
        moved = label.join(merged.withColumnRenamed("root", "to"), F.col("root") == F.col("node"), "left").select("key", F.coalesce("to", "root").alias("root"))
        # Roots without a label so far were sets of their own.
        fresh = merged.join(label, F.col("node") == F.col("key"), "left_anti").select(F.col("node").alias("key"), "root")
        return cut(moved.unionByName(fresh))

    for salt in range(ROUNDS):
        pick = F.min(F.struct(F.xxhash64("key", "t", F.lit(salt)).alias("h"), "key", "n", "p", "bits", "root"))
        leader = named.groupBy("t").agg(pick.alias("x"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("t", "x.*")
        met = side(named, "a").join(side(leader, "b"), "t").where(F.col("root_a") != F.col("root_b"))
        label = joined(met.where(_may_link(percent, "a", "b", first=False)))
        named = held.join(label, "key", "left").withColumn("root", F.coalesce("root", "key"))
    apart = named.groupBy("t").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("t")
    rest = cut(named.join(apart, "t"))
    a, b = side(rest, "a"), side(rest, "b").withColumnRenamed("t", "t_b")
    pairs = a.join(b, (F.col("t") == F.col("t_b")) & (F.col("key_a") > F.col("key_b")) & (F.col("root_a") != F.col("root_b")) & _may_link(percent, "a", "b", first=True))
    return joined(pairs)


def row_components(docs: DataFrame, percent: int = 80, k: int = 5) -> DataFrame:
    """(doc_id, row, n, root, component_id) of every row: its key, its set's size, and the number and smallest doc_id of its component; both null for a row without partner."""
    counted = cut(shared_counts(docs.select("doc_id", row_key().alias("row"), "text"), k))
    alive = counted.where((F.col("n") > 0) & (F.col("shared") * 100 >= F.col("n") * percent))
    grouped = alive.groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.min("row").alias("row"))
    sets = cut(grouped.withColumn("key", F.monotonically_increasing_id()))  # written once, so a number stays what it is
    wanted = sets.select("row", "sig", "key")
    if wanted.count() <= BROADCAST_IDS:  # some 100 bytes each; beyond, the texts are shuffled
        wanted = F.broadcast(wanted)
    ordered = cut(ordered_sets(cut(sets_of(docs, wanted, k)), percent))  # a plan reads the sets three times
    found = components(ordered, percent)
    named = sets.join(found, "key", "left").select("sig", "doc_id", F.coalesce("root", "key").alias("root"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_set = named.select("sig", "root").join(least, "root").select("sig", "root", "component_id")
    return counted.join(by_set, "sig", "left").select("doc_id", "row", "n", "root", "component_id")


def near_duplicates(docs: DataFrame, percent: int = 80, k: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: its set's size, and the smallest doc_id that links reach.

    Rows link where 100 * intersection >= percent * union of their k-gram sets.  Null texts and
    texts without words have size 0 and link with nothing.  A null doc_id keeps its row, links like any
    other and is never a component's id unless it is alone.  Repeated rows are rows like any
    others; further columns are ignored.
    """
    rows = row_components(docs, percent, k)
    return rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
