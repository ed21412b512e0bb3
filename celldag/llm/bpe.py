"""BPE encoding by speculation and verification, and decoding.

A word's tokens are first guessed: the longest vocabulary entry at each place, left to right.
The guess is the exact BPE result if each token is what its own string encodes to and each two
neighbours are compatible, that is, no merge would cross their border before both are whole.
Borders are checked together in numpy: both tokens are unrolled merge by merge, the later merge
first, and at each point in time the pieces that touch the border must have no merge of their
own that comes earlier than the next merge of either piece.  Only words whose guess fails go
through exact merging.

Words are the unit: those that a worker has seen stay in a bounded table, so each is encoded
once.  Texts are encoded whole.
"""

from __future__ import annotations

import json
import re
import unicodedata
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from celldag.llm.common import frugal, kept, slices, texts_of

NEVER = 1 << 40
#: Fixed value: how the vocabulary's word pattern splits a text after lower-casing.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: Words that a worker keeps, in each of two generations.
MAX_WORDS = 80_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def _ascii_words() -> re.Pattern:
    """WORD for lower-cased ASCII texts, where plain sets stand for its classes."""
    space = "".join(map(re.escape, filter(regex.compile(r"\s").match, map(chr, range(128)))))
    return re.compile(WORD.replace(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+", rf"[a-z]+|[0-9]|[^{space}a-z0-9]+"))


def read_spec(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        return json.load(file)


def token_names(spec: dict) -> list[str]:
    """Each id's string, by id."""
    by_id = {i: name for name, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    return [by_id.get(i, "") for i in range(max(by_id) + 1)]


class WordBpe:
    """Encoder and decoder for a vocabulary file of the tokenizers library: word ends marked by a suffix, byte symbols."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*self.vocab.values(), *self.added.values()])
        self.names = token_names(spec)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        ids = np.array([(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in pairs], np.int64)
        self.rank_of = {(int(a), int(b)): (r, int(c)) for r, (a, b, c) in reversed(list(enumerate(ids)))}
        keys = ids[:, 0] * size + ids[:, 1]
        order = np.argsort(keys, kind="stable")
        self.keys, self.key_rank, self.size = keys[order], order.astype(np.int64), size
        self.made = ids[:, 2]  # the token that each merge makes
        self.rank = np.full(size, -1, np.int64)  # of the merge that makes a token; -1: a single symbol
        self.left, self.right = np.arange(size), np.arange(size)
        for r in range(len(ids) - 1, -1, -1):
            a, b, c = ids[r]
            self.rank[c], self.left[c], self.right[c] = r, a, b
        merged = np.flatnonzero(self.rank >= 0)
        grows = (self.rank[self.left[merged]] < self.rank[merged]) & (self.rank[self.right[merged]] < self.rank[merged])
        self.in_order = bool(grows.all())  # no merge comes before those that make its parts
        whole = self.compatible(self.left[merged], self.right[merged], self.rank[merged])
        self.sound = np.ones(size, bool)  # what the token's own string encodes to is the token
        self.sound[merged] = grows & whole
        for c in merged[np.argsort(self.rank[merged])]:
            self.sound[c] &= self.sound[self.left[c]] & self.sound[self.right[c]]
        self.reach: dict[str, int] = {}  # longest entry that begins with these two characters
        lengths: dict[str, set[int]] = {}
        for name in self.vocab:
            self.reach[name[:2]] = max(len(name), self.reach.get(name[:2], 0))
            if len(name) >= 4 and not (self.suffix and name.endswith(self.suffix)):
                lengths.setdefault(name[:4], set()).add(len(name))
        # Lengths of entries that may stand before a word's end, by their first four characters.
        self.lengths = {first: tuple(sorted(n, reverse=True)) for first, n in lengths.items()}
        # The same entries for a run over many words at once; a zero byte, which is no symbol, stands for a word's end.
        self.longest, self.length = ahocorasick.Automaton(), np.zeros(size, np.int64)
        for name, i in self.vocab.items():
            name = name[: -len(self.suffix)] + "\0" if self.suffix and name.endswith(self.suffix) else name
            if name:
                self.longest.add_word(name, i)
                self.length[i] = len(name)
        self.longest.make_automaton()
        self.bytes = byte_symbols()
        self.find = regex.compile(WORD).findall
        self.find_ascii = _ascii_words().findall
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")").split if self.added else None
        self.forget()

    def forget(self) -> None:
        """Words seen so far; those of added tokens are always known."""
        self.known: dict[str, tuple[int, ...]] = {c: (i,) for c, i in self.added.items()}
        self.older: dict[str, tuple[int, ...]] = {}

    @classmethod
    def load(cls, path: str) -> WordBpe:
        return cls(read_spec(path))

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_rank[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """For each pair of tokens: does no merge cross their border?  Merges from rank `limit` on don't count."""
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), NEVER) if limit is None else limit.copy()
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        # A tie is one merge at two places; the left one comes first.  If that is inside the left
        # token it takes the border's piece away; if inside the right token, the border's own merge is first.
        inside_right = np.zeros(len(a), bool)
        while len(live):
            x, y = a[live], b[live]
            cross = self._ranks(x, y)
            bad = (cross < limit[live]) | ((cross == limit[live]) & inside_right[live] & (cross < NEVER))
            good[live[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            on = ~bad & ((rx >= 0) | (ry >= 0))
            live, x, y, rx, ry = live[on], x[on], y[on], rx[on], ry[on]
            undo_left = rx > ry
            # equal ranks: both pieces come from the same merge, the left one first, so the right is undone first
            a[live] = np.where(undo_left, self.right[x], x)
            b[live] = np.where(undo_left, y, self.left[y])
            limit[live] = np.where(undo_left, rx, ry)
            inside_right[live] = ~undo_left
        return good

    def _guess(self, word: str) -> list[int] | None:
        """Longest vocabulary entry at each place; None if some place has none."""
        word, get, reach, lengths = word + self.suffix, self.vocab.get, self.reach.get, self.lengths.get
        out, i, n = [], 0, len(word)
        inside = n - len(self.suffix)
        while i < inside:
            token = get(word[i:]) if n <= i + reach(word[i : i + 2], 1) else None
            if token is not None:
                out.append(token)
                return out
            room = inside - 1 - i  # the last symbol belongs to the entry with the suffix
            for k in lengths(word[i : i + 4], ()) if room >= 4 else ():
                if k <= room:
                    token = get(word[i : i + k])
                    if token is not None:
                        break
            else:
                for k in range(min(room, 3), 0, -1):
                    token = get(word[i : i + k])
                    if token is not None:
                        break
                else:
                    return None
            out.append(token)
            i += k
        return out

    def _guess_all(self, words: list[str]) -> list[list[int]]:
        """`_guess` of each word; an empty list where there is none.

        One run over all words takes the longest entry at each place.  Where that leaves a word's end
        alone, or anything else uncovered, the word is guessed by itself.
        """
        if not words:
            return []
        hits = np.fromiter(chain.from_iterable(self.longest.iter_long("\0".join(words) + "\0")), np.int64).reshape(-1, 2)
        last, ids = hits[:, 0], hits[:, 1]
        size = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(size + 1) - size - 1
        of = np.searchsorted(begin, last, "right") - 1
        n = self.length[ids]
        whole = np.bincount(of, n, len(words)) == size + bool(self.suffix)
        first = np.append(True, of[1:] != of[:-1])[: len(of)]
        before = np.where(first, begin[of] - 1, np.append(-1, last[:-1])[: len(of)])
        whole[of[last - n != before]] = False  # a gap or an overlap
        stop, flat = np.cumsum(np.bincount(of, minlength=len(words))).tolist(), ids.tolist()
        return [flat[a:b] if ok else self._guess(w) or [] for w, ok, a, b in zip(words, whole.tolist(), [0, *stop], stop)]

    def merge(self, word: str) -> list[int]:
        """Exact merging of a word of byte symbols: the lowest rank first, of equal ones the leftmost."""
        part = [self.vocab[c] for c in word[:-1]] + [self.vocab[word[-1] + self.suffix]]
        while len(part) > 1:
            found = [self.rank_of.get(p, (NEVER, 0)) for p in zip(part, part[1:])]
            rank, token = min(found)
            if rank == NEVER:
                break
            out, i = [], 0
            while i < len(part):
                if i + 1 < len(part) and found[i][0] == rank:
                    out.append(token)
                    i += 2
                else:
                    out.append(part[i])
                    i += 1
            part = out
        return part

    def merge_all(self, words: list[str]) -> list[list[int]]:
        """Exact merging of many words at once: in each round every word does all merges of its lowest rank."""
        if not self.in_order:
            return [self.merge(w) for w in words]
        vocab, suffix = self.vocab, self.suffix
        ids = np.fromiter((vocab[c] for w in words for c in (*w[:-1], w[-1] + suffix)), np.int64)
        word = np.repeat(np.arange(len(words)), list(map(len, words)))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            rank = np.full(len(ids), NEVER)  # of an element with its right neighbour
            inside = np.flatnonzero(word[1:] == word[:-1])
            rank[inside] = self._ranks(ids[inside], ids[inside + 1])
            begin = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            low = np.repeat(np.minimum.reduceat(rank, begin), np.diff(np.append(begin, len(ids))))
            over = low == NEVER
            done.append((word[over], ids[over]))
            at = np.flatnonzero((rank == low) & ~over)
            # In a row of equal tokens, pairs overlap: the leftmost is merged, then the next but one.
            run = np.flatnonzero(np.append(True, np.diff(at) != 1)) if len(at) else at
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
            ids[at] = self.made[rank[at]]
            keep = ~over
            keep[at + 1] = False
            ids, word = ids[keep], word[keep]
        word, ids = (np.concatenate([d[i] for d in done]) for i in (0, 1))
        order = np.argsort(word, kind="stable")
        ends = np.searchsorted(word[order], np.arange(1, len(words)))
        return [part.tolist() for part in np.split(ids[order], ends)]

    def learn(self, words: list[str]) -> None:
        """Encode words and put them into the table of known ones."""
        symbols = [w if w.isascii() and w.isprintable() else "".join(map(self.bytes.__getitem__, w.encode("utf-8", "replace"))) for w in words]
        guesses = self._guess_all(symbols)
        size = np.fromiter(map(len, guesses), np.int64, len(guesses))
        flat = np.fromiter(chain.from_iterable(guesses), np.int64, size.sum())
        of = np.repeat(np.arange(len(words)), size)
        failed = size == 0
        failed[of[~self.sound[flat]]] = True
        inside = np.flatnonzero(of[1:] == of[:-1])  # neighbours in one word
        pairs, at = np.unique(flat[inside] * self.size + flat[inside + 1], return_inverse=True)
        failed[of[inside[~self.compatible(pairs // self.size, pairs % self.size)[at]]]] = True
        wrong = np.flatnonzero(failed).tolist()
        for i, right in zip(wrong, self.merge_all([symbols[i] for i in wrong]) if wrong else ()):
            guesses[i] = right
        self.known.update(zip(words, map(tuple, guesses)))

    def words(self, text: str) -> list[str]:
        """Words in order; strings of added tokens stand for themselves, before any normalisation."""
        out: list[str] = []
        for i, part in enumerate(self.split_added(text) if self.split_added else [text]):
            if i % 2:
                out.append(part)
            elif part:
                if part.isascii():
                    out += self.find_ascii(part.lower())
                    continue
                if not unicodedata.is_normalized("NFC", part):
                    part = unicodedata.normalize("NFC", part)
                # One character at a time: a capital sigma has no special form at a word's end.
                out += self.find(part.replace("Σ", "σ").lower())
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, and where each text's ids begin (one more entry at the end)."""
        listed = [self.words(t) for t in texts]
        if len(self.known) > MAX_WORDS:  # two generations: words still in use move on to the new one
            self.known, self.older = {c: (i,) for c, i in self.added.items()}, self.known
        seen = set(chain.from_iterable(listed))
        new = seen - self.known.keys()
        again = new & self.older.keys()
        self.known.update((w, self.older[w]) for w in again)
        self.learn(list(new - again))
        place = {w: i for i, w in enumerate(seen)}
        tokens = list(map(self.known.__getitem__, place))
        size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        flat = np.fromiter(chain.from_iterable(tokens), np.int32, size.sum())
        word = np.fromiter(map(place.__getitem__, chain.from_iterable(listed)), np.int64, sum(map(len, listed)))
        n = size[word]
        stop = np.append(0, np.cumsum(n))
        ids = flat[np.repeat((np.cumsum(size) - size)[word] - stop[:-1], n) + np.arange(stop[-1])]
        return ids, stop[np.append(0, np.cumsum(list(map(len, listed)), dtype=np.int64))].astype(np.int32)


def _tokenizer(path: str) -> WordBpe:
    """One per worker and file, as long as it runs tasks of this operator; the path must be readable on every worker."""
    return kept(path, lambda: WordBpe.load(path))


def _joined(names: pa.Array, ids: pa.Array, begin: pa.Array) -> pa.Array:
    """Of each list of ids, the tokens' strings joined by one space."""
    return pc.binary_join(pa.ListArray.from_arrays(begin, names.take(ids)), " ")


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids", decoded: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` and `out` (array<int>): the token ids of each whole text, without added special tokens.

    decoded: a further column for what those ids decode to (see `decode`), made in the same pass.
    A null text counts as empty; empty texts have no ids.  Repeated rows are encoded each.
    """
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        bpe = _tokenizer(path)
        names = pa.array(bpe.names, pa.string())
        for batch in slices(batches, 2 << 20):
            flat, begin = map(pa.array, bpe.encode(texts_of(batch, text)))
            cols = {c: batch.column(c) for c in keep} | {out: pa.ListArray.from_arrays(begin, flat)}
            yield pa.RecordBatch.from_pydict(cols | ({decoded: _joined(names, flat, begin)} if decoded else {}))
        bpe.forget()

    return df.select(*keep, text).mapInArrow(frugal(run, keeps=path), f"{kinds}, `{out}` array<int>" + (f", `{decoded}` string" if decoded else ""))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep`, `ids` and `out`: the tokens' own strings, joined by one space, special tokens included.

    The vocabulary file names no decoder, so that is its decoding; null ids decode to the empty text.
    """
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (*keep, ids))

    def run(batches):
        names = pa.array(token_names(read_spec(path)), pa.string())
        for batch in slices(batches, 8 << 20):
            lists = batch.column(ids)
            n = pc.fill_null(pc.list_value_length(lists), 0)
            begin = pa.array(np.append(0, np.cumsum(n.to_numpy(zero_copy_only=False))).astype(np.int32))
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in (*keep, ids)} | {out: _joined(names, lists.flatten(), begin)})

    return df.select(*keep, ids).mapInArrow(frugal(run), f"{kinds}, `{out}` string")


def ids_text(ids: str = "ids") -> Column:
    """Decimal ids joined by one space."""
    return F.array_join(F.col(ids).cast("array<string>"), " ")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    both = encode(docs, path, decoded="decoded")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids_text(), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
