"""URL filter: explicit rules first, then gradient-boosted trees on lexical features.

The trees (logistic loss, Newton leaf values) are grown in numpy from labelled URLs.
They see lengths, path depth, digit ratios, entropy, parameter counts and how often the host's
suffixes and whole words were blocked in training.  Names run together are cut into words only where
learned words cover them completely, or where the latter half or more is one learned word of four letters
or more, as a compound's last word says what it is; so "winter" has no "win" in it and "hackney" no "hack".
Nothing but the URL is read.

The labelled URLs are put together by rule from the words and shapes below: hosts of either
kind come with and without hyphens, digits and subdomains, so that none of these decides alone.
"""

from __future__ import annotations

import functools
import math
import random
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path) of the rules that the registered query applies.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]

#: Words of hosts: of sites to block, and of sites to allow.
BAD_WORDS = """
casino poker slots jackpot roulette betting bet bets odds bonus lottery winner prize viagra cialis pills pharma meds replica rolex xxx porn sex adult cams escort hookup singles nude
loan loans payday credit debt cash money rich profit forex crypto coin spam clicks traffic backlinks followers keygen crack warez torrent hack cheat free cheap discount deals win lucky
ads adserver tracker tracking popunder banner farm seo phish verify
""".split()
GOOD_WORDS = """
news daily times post herald journal review library archive museum school college university institute academy research science nature garden river lake forest mountain city town
village council county weather travel guide maps recipes kitchen food soup bread coffee music radio film theatre photo art design craft wood paper book books story poem history language
math physics health clinic care family home house build tools code docs wiki forum help support team club sport run bike sail green blue red white old new north south east west
my the best top online web shop store site get go pro plus live world
""".split()
#: Words to block that ordinary hosts have too (banks, shops, charities, schools); their shares are learned from both.
SHARED_WORDS = "credit debt loan loans cash money free discount deals win winner lucky prize singles bonus bet coin seo hack traffic profit rich cheap".split()
SYLLABLES = "ba be bi bo da de di do fa fe ga ha he in ing ka ke la le li lo ma me mi mo na ne no on ou pa per ra re ri ro sa se sha so sta ta te th tha the ti to tion tra un va ve ver vi wa we th th nd st sh ng ble wh".split()
GOOD_SUFFIXES, BAD_SUFFIXES = ("com", "org", "net", "edu", "co.uk", "de", "fr", "example.com", "example.org", "example.net"), ("com", "net", "org", "info", "top", "xyz", "click", "biz", "example.com", "example.org", "example.net")
LANGS = ("en", "de", "fr", "es", "it")


def labelled_urls(n: int = 1800, seed: int = 7, bad_words=tuple(BAD_WORDS), good_words=tuple(GOOD_WORDS), shared_words=tuple(SHARED_WORDS)) -> tuple[list[str], list[int]]:
    """n URLs to block and n to allow, the same for the same seed."""
    rng = random.Random(seed)
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    text = lambda k, of: "".join(rng.choice(of) for _ in range(k))

    def named(words: list[str]) -> str:
        return rng.choice(("", "-", "-")).join(words)

    def spoken() -> str:  # consonants and vowels in turn, as invented names have
        return "".join(rng.choice(letters) + rng.choice("aeiou") + rng.choice(("", "", "n", "r", "s", "l", "t")) for _ in range(rng.randint(2, 4)))

    def good_host() -> str:
        kind = rng.random()
        if kind < 0.45:
            name = named(rng.sample(good_words, rng.randint(1, 3)))
        elif kind < 0.6:
            name = spoken()
        elif kind < 0.85:
            name = "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(2, 5)))
        elif kind < 0.89:
            name = named([rng.choice(good_words), "".join(rng.choice(SYLLABLES) for _ in range(2))])
        else:
            name = named(rng.sample([rng.choice(shared_words), rng.choice((rng.choice(good_words), spoken()))], 2))
        return rng.choice(("", "", "www.", "blog.", "m.", "docs.", "en.")) + name + (str(rng.randint(1, 99)) if rng.random() < 0.06 else "") + "." + rng.choice(GOOD_SUFFIXES)

    def bad_host() -> str:
        kind = rng.random()
        if kind < 0.6:
            name = named(rng.sample(bad_words, rng.randint(1, 3)))
        elif kind < 0.75:
            words = [rng.choice(bad_words), *rng.sample(good_words, rng.randint(1, 2))]
            name = named(rng.sample(words, len(words)))
        elif kind < 0.9:
            name = text(rng.randint(7, 16), letters + digits)
        else:
            name = rng.choice(bad_words) + text(rng.randint(1, 4), digits) + rng.choice(("", "-" + rng.choice(bad_words)))
        return rng.choice(("", "", "www.", "m.", "blog.", "go.", "track.")) + name + (text(3, digits) if rng.random() < 0.1 else "") + "." + rng.choice(BAD_SUFFIXES)

    def calm_path() -> str:
        kind = rng.random()
        if kind < 0.5:
            path = f"/{rng.choice(LANGS)}/{rng.randint(1, 60000)}" + rng.choice(("", "/", ".html"))
        elif kind < 0.75:
            path = f"/{rng.randint(1999, 2024)}/{rng.randint(1, 12):02d}/" + "-".join(rng.sample(good_words, rng.randint(1, 5)))
        else:
            dated = [str(rng.randint(1999, 2024)), f"{rng.randint(1, 12):02d}"] if rng.random() < 0.3 else []
            path = "/" + "/".join(rng.sample(good_words, rng.randint(0, 3)) + dated) + rng.choice(("", "/"))
        return path + rng.choice(("", "", "", "?page=2&ref=x", "?utm_source=feed", "#top", f"?page={rng.randint(1, 30)}"))

    def busy_path() -> str:
        parts = [text(rng.randint(2, 9), letters + digits) for _ in range(rng.choice((0, 1, 2, 3, 4, 5, 6, 7)))]
        query = "&".join(f"{text(rng.randint(1, 4), letters)}={text(rng.randint(1, 12), digits + 'abcdef')}" for _ in range(rng.randint(2, 8)))
        if rng.random() < 0.3:  # a door page, deep down
            return "/" + "/".join(text(rng.randint(1, 3), letters) for _ in range(rng.randint(5, 9)))
        return "/" + "/".join(parts) + "?" + query

    bad, good = [], []
    for _ in range(n):
        good.append(f"{rng.choice(('http', 'https'))}://{good_host()}{calm_path()}")
        kind = rng.random()
        bad.append(f"{rng.choice(('http', 'https'))}://{good_host() if kind < 0.2 else bad_host()}{busy_path() if kind < 0.4 else calm_path()}")
    return bad + good, [1] * n + [0] * n


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ://."""
    _, found, rest = (url or "").partition("://")
    m = re.match(r"([^/?#]*)([^?#]*)", rest if found else "")
    return re.sub("[A-Z]+", lambda x: x[0].lower(), m[1]), m[2]


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


NAMES = ("length", "host_length", "labels", "depth", "path_length", "digits", "host_digits", "entropy", "host_entropy", "parameters", "query_length", "suffix_rate", "word_rate", "word_mean", "odd_pairs")
SUPPORT = 3  # different hosts that a word must stand in, set off by other signs, before its share counts


def cover(name: str, words) -> list[str]:
    """The fewest learned words that make up a name completely, longer first ones before shorter; else its rest and the word that it ends in; else the name itself."""
    best: list[list[str] | None] = [None] * len(name) + [[]]
    for i in range(len(name) - 1, -1, -1):
        for j in range(len(name), i, -1):
            if best[j] is not None and name[i:j] in words and (best[i] is None or len(best[j]) + 1 < len(best[i])):
                best[i] = [name[i:j], *best[j]]
    if best[0]:
        return best[0]
    tail = next((name[i:] for i in range(2, len(name) // 2 + 1) if len(name) - i >= 4 and name[i:] in words), None)
    return [name[: -len(tail)], tail] if tail else [name]


@dataclass
class Suffixes:
    """Smoothed shares of blocked URLs by the host's suffixes and its words; unseen ones give the base rate."""

    rate: dict[str, float]
    base: float
    words: frozenset[str] = frozenset()
    pairs: frozenset[str] = frozenset()

    @staticmethod
    def pairs_of(host: str) -> list[str]:
        """Neighbouring letters and digits of the host's labels but the last."""
        return [x[i : i + 2] for x in host.split(".")[:-1] for i in range(len(x) - 1) if x[i : i + 2].isalnum()]

    def odd(self, host: str) -> float:
        """The share of pairs that allowed hosts don't have."""
        pairs = self.pairs_of(host)
        return sum(p not in self.pairs for p in pairs) / len(pairs) if pairs else 0.0

    @staticmethod
    def suffixes(host: str) -> list[str]:
        labels = [x for x in host.split(".") if x]
        return ["." + ".".join(labels[-k:]) for k in range(1, min(3, len(labels)) + 1)]

    @staticmethod
    def names(host: str) -> list[str]:
        return [w for x in host.split(".")[:-1] for w in re.split(r"[^a-z]+", x) if w not in ("", "www", "m", "blog", "example")]

    def parts(self, host: str) -> list[str]:
        return [w for name in self.names(host) for w in cover(name[:64], self.words)]

    @classmethod
    def count(cls, hosts: list[str], blocked: np.ndarray, weight: float = 3.0) -> tuple[Suffixes, list[Suffixes]]:
        """The table of all hosts, and for each the table that leaves that host's own URLs out."""
        base, n, b = float(blocked.mean()), Counter(), Counter()
        seen = Counter(w for host in set(hosts) for w in set(cls.names(host)) if len(w) > 2)
        whole = cls({}, base, frozenset(w for w, k in seen.items() if k >= SUPPORT))
        allowed = {host for host, y in zip(hosts, blocked) if not y}
        met = Counter(p for host in allowed for p in set(cls.pairs_of(host)))
        whole.pairs = frozenset(p for p, k in met.items() if k >= SUPPORT)
        rare = {p for p, k in met.items() if k == SUPPORT}
        without = {host: whole.pairs - (rare & set(cls.pairs_of(host))) if host in allowed else whole.pairs for host in set(hosts)}
        own: dict[str, tuple[Counter, Counter]] = {}
        keys = {host: set(cls.suffixes(host)) | (set(whole.parts(host)) & whole.words) for host in set(hosts)}
        for host, y in zip(hosts, blocked):
            on, ob = own.setdefault(host, (Counter(), Counter()))
            for key in keys[host]:
                n[key] += 1
                b[key] += y
                on[key] += 1
                ob[key] += y
        share = lambda b, n: (b + weight * base) / (n + weight)
        whole.rate = {k: share(b[k], n[k]) for k in n}
        rest = {host: cls({k: share(b[k] - own[host][1][k], n[k] - own[host][0][k]) for k in keys[host] if n[k] > own[host][0][k]}, base, whole.words, without[host]) for host in own}
        return whole, [rest[host] for host in hosts]

    def of(self, host: str) -> tuple[float, float, float]:
        """The longest known suffix's share, and of the words' shares the highest and the mean."""
        known = [self.rate[s] for s in self.suffixes(host) if s in self.rate]
        words = [self.rate.get(w, self.base) for w in self.parts(host)] or [self.base]
        return (known[-1] if known else self.base), max(words), sum(words) / len(words)


def features(url: str | None, suffixes: Suffixes) -> list[float]:
    host, path = split_url(url)
    url = url or ""
    query = url.partition("#")[0].partition("?")[2]
    share = lambda t: sum(c.isdigit() for c in t) / max(1, len(t))
    return [
        len(url), len(host), host.count(".") + 1 if host else 0, sum(map(bool, path.split("/"))), len(path), share(path + query), share(host), entropy(url), entropy(host),
        len([p for p in query.split("&") if p]), len(query), *suffixes.of(host), suffixes.odd(host),
    ]


@dataclass
class Boosted:
    """Trees as arrays of (feature, cut, low, high, value); a leaf's feature is -1."""

    suffixes: Suffixes
    start: float
    trees: list[list[tuple[int, float, int, int, float]]]
    rate: float

    def score(self, x: np.ndarray) -> np.ndarray:
        f = self.start + self.rate * sum((_leaf_values(t, x) for t in self.trees), np.zeros(len(x)))
        return 1 / (1 + np.exp(-f))


def _leaf_values(tree: list[tuple[int, float, int, int, float]], x: np.ndarray) -> np.ndarray:
    feature, cut, low, high, value = (np.array(c) for c in zip(*tree))
    at = np.zeros(len(x), int)
    while len(go := np.flatnonzero(feature[at] >= 0)):
        a = at[go]
        at[go] = np.where(x[go, feature[a]] <= cut[a], low[a], high[a])
    return value[at]


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, least: float, l2: float) -> list[tuple[int, float, int, int, float]]:
    """One tree on gradients and curvatures; ties go to the first feature, then the lowest cut."""
    nodes: list = []

    def node(rows: np.ndarray, left: int) -> int:
        own = len(nodes)
        nodes.append(None)
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-9, -1, 0.0)
        for j in range(x.shape[1]) if left else ():
            order = rows[np.argsort(x[rows, j], kind="stable")]
            v, gl, hl = x[order, j], np.cumsum(g[order])[:-1], np.cumsum(h[order])[:-1]
            gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
            gain[(v[1:] == v[:-1]) | (hl < least) | (hs - hl < least)] = -1
            if len(gain) and gain.max() > best[0] + 1e-12:
                i = int(gain.argmax())
                best = (float(gain[i]), j, float((v[i] + v[i + 1]) / 2))
        _, j, cut = best
        if j < 0:
            nodes[own] = (-1, 0.0, own, own, float(-gs / (hs + l2)))
        else:
            low = node(rows[x[rows, j] <= cut], left - 1)
            high = node(rows[x[rows, j] > cut], left - 1)
            nodes[own] = (j, cut, low, high, 0.0)
        return own

    node(np.arange(len(x)), depth)
    return nodes


def train(urls: list[str] | None = None, blocked: list[int] | None = None, rounds: int = 80, depth: int = 4, rate: float = 0.15, least: float = 4.0, l2: float = 1.0) -> Boosted:
    """Fit to labelled URLs, by default those of labelled_urls().  Suffix rates of a training URL leave that URL's host out."""
    if urls is None:
        urls, blocked = labelled_urls()
    y = np.array(blocked, float)
    suffixes, without = Suffixes.count([split_url(u)[0] for u in urls], y)
    x = np.array([features(u, s) for u, s in zip(urls, without)], float)
    start = float(np.log(y.mean() / (1 - y.mean())))
    f, trees = np.full(len(y), start), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        trees.append(_grow(x, p - y, p * (1 - p), depth, least, l2))
        f += rate * _leaf_values(trees[-1], x)
    return Boosted(suffixes, start, trees, rate)


@functools.cache
def default_model() -> Boosted:
    return train()


def _after_scheme(url: str) -> Column:
    """What follows the first ://; the empty text without one."""
    at = F.instr(F.col(url), "://")
    return F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))


def host_column(url: str) -> Column:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), letters, letters.lower())


def path_column(url: str) -> Column:
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def rule_column(host: Column, path: Column, rules, give: str) -> Column:
    """The longest fitting rule's text (host and path) or verdict; null if none fits.  Of equally long ones, the first by text."""
    out = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        value = F.lit(verdict if give == "verdict" else rule_host + rule_path)
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("string")


def judge(pages: DataFrame, rules=tuple(RULES), model: Boosted | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row.

    verdict: the rule's; without one, block where the trees' score is 0.5 or more.  A null url,
    or one without ://, has an empty host and path and is judged by the trees like any other.
    Repeated rows are judged each; further columns are ignored.
    """
    model = model or default_model()
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            urls = batch.column("url").to_pylist()
            at = {u: i for i, u in enumerate(dict.fromkeys(urls))}
            p = model.score(np.array([features(u, model.suffixes) for u in at], float).reshape(len(at), -1))
            yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "score": pa.array(p[[at[u] for u in urls]])})

    scored = pages.select("page_id", F.col("url").cast("string").alias("url")).mapInArrow(run, f"page_id {kind}, url string, score double")
    parts = scored.select("page_id", "score", host_column("url").alias("host"), path_column("url").alias("path"))
    host, path = F.col("host"), F.col("path")
    own = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return parts.select("page_id", "host", "path", rule_column(host, path, rules, "rule").alias("rule"), F.coalesce(rule_column(host, path, rules, "verdict"), own).alias("verdict"), "score")
