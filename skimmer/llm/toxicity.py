"""Toxicity (operator 9): noisy-channel restoration of disguised words, then a score of the restored text.

What is not plain words is a lattice: a sign or digit may stand for letters, a repeated letter may be one, a separator
or white space between letters or fragments may be nothing. Viterbi decoding under a character trigram model of all the texts picks
the paths. The model of toxic wording is learned from labelled rows: the words and word beginnings that mark
toxic texts, and a logistic curve over how many of them a text holds.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skimmer.llm.shared import Kept, done_with, slices, small_batches, written

#: Labelled rows that are learned from, at most: those with the smallest hash of their id.
SAMPLE_ROWS = 20_000
#: A mark is so many times likelier in toxic texts than in others, at least.
RATIO = 12
#: Readings of a lattice: the best so many, and of them those within so many nats of the best.
MARGIN, PATHS = 5.0, 8
#: One letter for a doubled one costs so many nats, a word end between letters that are written apart so many.
UNDOUBLED, APART = -3.0, -1.0
#: Neighbouring fragments of at most so many letters are one word if that is likelier by so many nats; beside a single letter a longer one may stand, for twice as many.
FRAGMENT, LONGER, JOINED = 4, 8, 1.0
#: Bytes that a worker keeps of what it has decoded.
CACHE_BYTES = 32 << 20
#: The same for beginnings of words.
HEAD_BYTES = 4 << 20
BEGINNINGS = (3, 4, 5, 6, 7)
CODES = 64
OTHER = CODES - 1

# What a sign or digit may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "*": "aeiou", "#": "aeiou", "€": "e"}

_TWICE, _THRICE = re.compile(r"(.)\1"), re.compile(r"(.)\1\1")
#: Lower-case letters of Latin-1.
_LOW = "a-zß-öø-ÿ"
_PAIRS = "|".join(chr(k) * 2 for k in (*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100)))
_NOISE = re.compile(r"([^\w\s])\1+$")
#: A letter alone, or letters with one separator between them, and what may follow.
_SPELLED = re.compile(r"((?:[^\W_]|[@$!])(?:[._*\-](?:[^\W_]|[@$!]))*)([.,;:!?]*)$")


def _letters() -> np.ndarray:
    """Codes of code points below U+0250: letters of Latin-1 have one each, other letters share one, the rest is 0."""
    codes, nxt = np.zeros(0x250, np.uint8), 1
    for point in range(0x250):
        c = chr(point)
        if c.isalpha() and c.lower() == c:
            codes[point] = nxt if point < 0x100 and nxt < OTHER else OTHER
            nxt += point < 0x100
    for point in range(0x250):
        low = chr(point).lower()
        if chr(point).isalpha() and low != chr(point):
            codes[point] = codes[ord(low)] if len(low) == 1 and ord(low) < 0x250 else OTHER
    return codes


LETTERS = _letters()


def codes_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(points < 0x250, LETTERS[np.minimum(points, 0x24F)], OTHER).astype(np.int32)


@lru_cache(maxsize=4096)
def _code(letter: str) -> int:
    return int(codes_of(letter)[0])


def character_counts(docs: DataFrame, text_column: str = "text") -> np.ndarray:
    """Trigrams of letter codes over all texts, runs of other characters being one boundary: a table of 64**3 counts.

    Tasks count whole texts and send one row for each different trigram; the sum, whose size the alphabet bounds, is returned.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CODES**3, np.int64)
        for batch in batches:
            for texts in slices(batch.column(0).drop_null()):
                c = codes_of("\n\n" + "\n\n".join(texts.to_pylist()) + "\n")
                keep = np.ones(len(c), bool)
                keep[2:] = (c[2:] != 0) | (c[1:-1] != 0)
                c = c[keep]
                total += np.bincount((c[:-2] * CODES + c[1:-1]) * CODES + c[2:], minlength=CODES**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["gram", "n"])

    rows = docs.select(F.col(text_column).cast("string")).mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    out = np.zeros(CODES**3)
    found = rows.toPandas()  # at most 64**3 rows
    out[found["gram"].to_numpy(np.int64)] = found["n"].to_numpy(float)
    return out


def language_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b), by a and b and c: trigram, bigram and single counts, each smoothed by the next."""
    three = counts.reshape(CODES, CODES, CODES)
    two, one = three.sum(0), three.sum((0, 1))
    p1 = (one + 0.5) / (one + 0.5).sum()
    p2 = (two + 20 * p1) / (two.sum(1, keepdims=True) + 20)
    p3 = (three + 10 * p2[None]) / (three.sum(2, keepdims=True) + 10)
    return np.log(p3).astype(np.float32)


def core_of(token: str) -> str:
    """A token without the signs around it; a bracket after the first pass stays, for it may be a letter."""
    core = _NOISE.sub("", token).strip(".,;:?\"'()[]{}<>&%=~`^/\\")
    return _NOISE.sub("", core).strip(".,;:?\"'[]{}<>&%=~`^/\\")


@dataclass
class Restorer:
    """Decodes tokens; remembers what it has decoded."""

    model: np.ndarray
    known: dict[str, list[list[str]]] = field(default_factory=lambda: Kept(CACHE_BYTES))

    def words(self, token: str) -> list[str]:
        """The words that a lower-case token most likely stands for."""
        return self.readings(token)[0]

    def readings(self, token: str) -> list[list[str]]:
        """The likely word lists of a lower-case token, best first: itself if it is plain letters, an empty one if nothing in it can be a letter.

        A token with spaces in it is a stretch of ``tokens_of``.
        """
        if " " in token:
            return self._kept(token, lambda: [t.split() for t in self.decode(token)])
        if token.isalpha() and not _THRICE.search(token):
            return self.undoubled(token)
        core = core_of(token)
        if core.isalpha() and not _THRICE.search(core):
            return self.undoubled(core)
        if not any(map(str.isalpha, core)) and sum(c in LEET for c in core) < 3:
            return [[]]
        return self._kept(core, lambda: [t.split() for t in self.decode(core)])

    def _kept(self, key: str, work) -> list[list[str]]:
        found = self.known.get(key)
        if found is None:
            found = work()
            self.known.keep(key, found, sum(64 + 56 * len(x) for x in found))
        return found

    def undoubled(self, word: str) -> list[list[str]]:
        """A plain word, and before it what it is with one letter for a doubled one, where that is likelier."""
        if not _TWICE.search(word):
            return [[word]]

        def work() -> list[list[str]]:
            found = self.decode(word, UNDOUBLED)
            return [[t] for t in found[: found.index(word) if word in found else None]] + [[word]]

        return self._kept(f"{word}\n", work)  # no token holds a line end

    def gains(self, tokens: list[str], left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """By how many nats each pair of tokens (numbers) is likelier as one word; minus infinity where it cannot be one."""
        size = np.array([len(t) if len(t) <= LONGER and t.isalpha() else 0 for t in tokens], np.int64)
        m, n = size[left], size[right]
        fit = (m > 0) & (n > 0) & (((m <= FRAGMENT) & (n <= FRAGMENT)) | (m == 1) | (n == 1)) & (m + n >= 3)
        out = np.full(len(left), -np.inf)
        at = np.flatnonzero(fit)
        if len(at):
            ends = np.zeros((len(tokens), 4), np.int64)  # the first two letters and the last two
            own = np.unique(np.concatenate([left[at], right[at]]))
            c = codes_of("".join([tokens[k] for k in own.tolist()]))
            last = np.cumsum(size[own]) - 1
            first, more = last - size[own] + 1, size[own] > 1
            ends[own] = np.stack([c[first], np.where(more, c[first + more], 0), np.where(more, c[last - more], 0), c[last]], 1)
            (y, z), (b, c), log = ends[left[at], 2:].T, ends[right[at], :2].T, self.model
            out[at] = log[y, z, b] + log[z, b, c] - log[y, z, 0] - log[z, 0, b] - log[0, b, c]
        return out

    @staticmethod
    def ways(token: str, k: int, once: float) -> list[tuple[str, float]]:
        """What the k-th character of a token or stretch may stand for: a letter, ' ' for a word end, or nothing; and its cost in nats."""
        ch = token[k]
        if ch == " ":
            alone = (k < 2 or token[k - 2] == " ") + (token[k + 2 : k + 3] in ("", " "))  # letters beside it that stand alone
            return [(" ", APART), ("", 0.0)] if alone == 2 else [(" ", 0.0), ("", -JOINED * (1 + alone))]
        if ch.isalpha():
            return [(ch, 0.0), ("", once)] if k and token[k - 1] == ch else [(ch, 0.0)]
        if ch.isdigit():
            return [*((c, -0.5) for c in LEET.get(ch, "")), (" ", -8.0)]
        return [*((c, -2.0 if ch in "*#" else -0.5) for c in LEET.get(ch, "")), ("", -5.0 if ch in LEET else -2.5), (" ", -2.0 if ch in LEET else -0.3)]

    def decode(self, token: str, once: float = -0.5) -> list[str]:
        """The PATHS best readings of a lattice, words apart by a space, best first, as far as they are within MARGIN of the best: list Viterbi, exact.

        A state is the last two letters of a reading; each keeps its PATHS best readings, and a reading is in one state only, so
        none of the best can be lost. Readings are told apart by a hash of 61 bits. ``once`` is what a letter costs that repeats the one before and is left out. Equally good ones go by text.
        """
        log = self.model
        # state: {hash of a reading: (score, what was settled of it, its end)}; ends are moved to what is settled from time to time, so that a step costs the same in tokens of any length
        beams: dict[tuple[int, int], dict[int, tuple[float, tuple | None, str]]] = {(0, 0): {0: (0.0, None, "")}}
        for k in range(len(token)):
            ways = self.ways(token, k, once)
            new: dict[tuple[int, int], dict[int, tuple[float, tuple | None, str]]] = {}
            for (a, b), readings in beams.items():
                for c, cost in ways:
                    if not c or (c == " " and not b):
                        key, add, tail, point = (a, b), cost, "", 0
                    else:
                        code = 0 if c == " " else _code(c)
                        key, add, tail, point = (b, code), cost + float(log[a, b, code]), c, ord(c)
                    own = new.setdefault(key, {})
                    for h, (score, settled, end) in readings.items():
                        h, score = (h * 1_000_003 + point) % _PRIME if tail else h, score + add
                        if h not in own or score > own[h][0]:
                            own[h] = (score, settled, end + tail)
            beams = {s: own if len(own) <= PATHS else dict(sorted(own.items(), key=lambda x: (-x[1][0], x[0]))[:PATHS]) for s, own in new.items()}
            if k % 64 == 63:
                beams = {s: {h: (score, (settled, end), "") for h, (score, settled, end) in own.items()} for s, own in beams.items()}
        ended = [(-score - (float(log[a, b, 0]) if b else 0.0), settled, end) for (a, b), own in beams.items() for score, settled, end in own.values()]
        ended = sorted(ended, key=lambda x: x[0])[: 2 * PATHS]
        said = sorted((score, _text(settled, end)) for score, settled, end in ended if score <= ended[0][0] + MARGIN)
        return [t for _, t in said[:PATHS]]


_PRIME = (1 << 61) - 1


def _text(settled: tuple | None, end: str) -> str:
    parts = [end]
    while settled is not None:
        settled, part = settled
        parts.append(part)
    return "".join(reversed(parts))


def tokens_of(texts: pa.Array, restorer: Restorer | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Different lower-case tokens, the index of each token of all texts, and the first token of each text.

    With a ``restorer``, letters that are written apart (three at least) and neighbouring fragments that may be one word make a
    stretch: one token with spaces in it, for the lattice to tell where words end. It stands in the place of the first,
    an empty token in those of the others. A null is an empty text.
    """
    texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    lists = pc.utf8_split_whitespace(texts)
    coded = pc.dictionary_encode(pc.list_flatten(lists))
    found, index, first = coded.dictionary, coded.indices.to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    # as one string, which is quicker: no token holds white space
    tokens = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), found), pa.scalar(" ", pa.large_string()))[0].as_py().split(" ") if len(found) else []
    if not restorer or not len(index):
        return tokens, index, first
    spelled = [_SPELLED.match(t) if len(t) < 3 or t[1] in "._*-" else None for t in tokens]
    letters = np.array([(len(m[1]) + 1) // 2 if m else 0 for m in spelled], np.int64)
    goes_on = np.array([bool(m) and not m[2] for m in spelled])
    follows = np.zeros(len(index), bool)  # whether a token belongs to the stretch of the one before it
    follows[1:] = (goes_on[index[:-1]] & (letters[index[1:]] > 0)) | (restorer.gains(tokens, index[:-1], index[1:]) > JOINED)
    follows[first[:-1][first[:-1] < len(index)]] = False  # no word goes from one text to the next
    begin = np.flatnonzero(~follows)
    size = np.diff(np.append(begin, len(index)))
    apart = np.add.reduceat(letters[index], begin)
    plain = np.add.reduceat((letters[index] == 0).astype(np.int64), begin)
    chosen = np.flatnonzero((apart >= 3) & ((size > 1) | (letters[index[begin]] >= 3)) | (plain > 0) & (size > 1))
    if len(chosen):
        index, own, empty = index.astype(np.int64), {}, len(tokens)
        tokens.append("")
        for k in chosen.tolist():
            a, b = int(begin[k]), int(begin[k] + size[k])
            parts = [tokens[t] for t in index[a:b].tolist()]
            word = " ".join(" ".join(re.sub(r"[._*\-]", "", m[1])) if (m := _SPELLED.match(p)) else p for p in parts)
            if word not in own:
                own[word] = len(tokens)
                tokens.append(word)
            index[a], index[a + 1 : b] = own[word], empty
    return tokens, index, first


def marks(word: str) -> list[str]:
    """What a word shows: itself, and its beginnings."""
    return [f"={word}", *(word[:k] + "*" for k in BEGINNINGS if len(word) >= k)]


_NO_MARKS: set[str] = set()


class Heads:
    """Tells tokens apart that no mark of a set can fit, however they are read; a plain word is read with or without each of its doubled letters."""

    def __init__(self, names: Iterable[str]):
        self.names = frozenset(names)
        self.first = {(m[1:] if m[0] == "=" else m[:-1])[:3] for m in self.names}
        self.known: dict[str, bool] = Kept(HEAD_BYTES)

    def among(self, tokens: list[str]) -> list[int]:
        """Which of the tokens may fit a mark: plain words that begin like none are ruled out together."""
        own = pc.utf8_trim(pa.array(tokens, pa.large_string()), characters=".,;:?\"'()")  # as ``core_of`` does
        plain = pc.and_not(pc.match_substring_regex(own, rf"^[{_LOW}]+\z"), pc.match_substring_regex(own, _PAIRS))
        begins = pc.is_in(pc.utf8_slice_codeunits(own, 0, 3), value_set=pa.array(sorted(self.first), pa.large_string()))
        rest = np.flatnonzero(pc.invert(pc.and_not(plain, begins)).to_numpy(zero_copy_only=False))
        return [k for k in rest.tolist() if self.fit(tokens[k])]

    def _begins(self, head: str) -> bool:
        """Whether ``head``, with or without each of its doubled letters, begins like a mark."""
        found = self.known.get(head)
        if found is None:
            words = {head}
            for m in reversed([*_TWICE.finditer(head)]):
                words |= {w[: m.start()] + w[m.start() + 1 :] for w in words}
            found = any(w[:3] in self.first for w in words)
            self.known.keep(head, found, 0)
        return found

    def fit(self, token: str) -> bool:
        parts = token.split(" ")
        if 1 < len(parts) <= 4 and all(map(str.isalpha, parts)):  # a short stretch is read as words that some of its parts make
            if not _TWICE.search("".join(parts)):  # then the beginnings tell
                return any("".join(parts[i:j])[:3] in self.first for i in range(len(parts)) for j in range(i + 1, min(i + 3, len(parts)) + 1))
            return any(self.fit("".join(parts[i:j])) for i in range(len(parts)) for j in range(i + 1, len(parts) + 1))
        if not token.isalpha():
            token = token and core_of(token)
            if not token.isalpha():
                return bool(token)
        if not _TWICE.search(token):
            return token[:3] in self.first
        doubled = [m.start() for m in _TWICE.finditer(token)]
        if len(doubled) > 4 or _THRICE.search(token):
            return True
        if not self._begins(token[:6]):  # where the first three letters of each of these words come from
            return False
        words = {token}
        for at in reversed(doubled):
            words |= {w[:at] + w[at + 1 :] for w in words}
        return any(w[:3] in self.first and not self.names.isdisjoint(marks(w)) for w in words)


@dataclass
class ToxicModel:
    """Marks with their log-likelihood ratios, and the curve; ``character`` is the language model."""

    character: np.ndarray
    worth: dict[str, float]
    intercept: float
    slope: float
    heads: Heads = field(init=False)

    def __post_init__(self):
        self.heads = Heads(self.worth)

    def hits(self, restorer: Restorer, token: str) -> float:
        """What a token tells: of its likely readings the strongest, each word by its strongest mark."""
        get = self.worth.get
        return max(sum(max(get(m, 0.0) for m in marks(w)) for w in words) for words in restorer.readings(token))

    def evidence(self, texts: pa.Array, restorer: Restorer) -> np.ndarray:
        """log(1 + what a text's tokens tell together)."""
        tokens, index, first = tokens_of(texts, restorer)
        worth = np.zeros(len(tokens))
        for k in self.heads.among(tokens):
            worth[k] = self.hits(restorer, tokens[k])
        total = np.zeros(len(texts))
        if len(index):
            sums = np.concatenate([[0], np.cumsum(worth[index])])
            total = sums[first[1:]] - sums[first[:-1]]
        return np.log1p(np.maximum(total, 0))

    def score(self, texts: pa.Array, restorer: Restorer) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.intercept + self.slope * self.evidence(texts, restorer), -50, 50)))


def curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of y on x, by Newton steps with a small ridge."""
    w = np.zeros(2)
    n = np.ones(len(x))
    a = np.stack([np.ones(len(x)), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (n * p * (1 - p))[:, None]).T @ a + 0.01 * np.eye(2), a.T @ (n * (y - p)) - 0.01 * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


def _sources(ends: list[tuple[int, int]]) -> np.ndarray:
    """A number for each text, equal for those that begin or end alike: near copies are one witness."""
    parent = list(range(len(ends)))

    def top(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    seen: dict[tuple[int, int], int] = {}
    for k, own in enumerate(ends):
        for key in enumerate(own):
            parent[top(k)] = top(seen.setdefault(key, k))
    return np.array([top(k) for k in range(len(ends))], np.int64)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ToxicModel:
    """Learns from ``labels`` (doc_id, toxic) over ``docs`` (doc_id, text).

    At most ``sample_rows`` labelled rows are used; rows with equal texts count once. Rows without text or label
    are no evidence. The language model counts every text. Without toxic or clean rows the score is a constant.
    """
    small_batches(docs.sparkSession)
    model = language_model(character_counts(docs))
    named = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    named = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    sample = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(named), "doc_id")  # at most sample_rows rows
    sample = sample.groupBy(F.sha2("text", 256).alias("_key")).agg(F.first("text").alias("text"), F.max("_toxic").alias("_toxic"))
    sample = sample.select("text", "_toxic").persist()

    def shown(batch: pa.RecordBatch, restorer: Restorer, wanted: dict[str, int] | None, heads: Heads | None = None) -> Iterator[tuple[int, set, tuple[int, int]]]:
        tokens, index, first = tokens_of(batch.column(0), restorer)
        own: list[set[str]] = [_NO_MARKS] * len(tokens)
        for k in heads.among(tokens) if heads else range(len(tokens)):
            own[k] = {m for w in restorer.words(tokens[k]) for m in marks(w) if wanted is None or m in wanted}
        for k, label in enumerate(batch.column(1).to_pylist()):
            row = index[first[k] : first[k + 1]].tolist()
            ends = tuple(zlib.crc32(" ".join(tokens[t] for t in part).encode()) for part in (row[:4], row[-4:]))
            yield label, set().union(*(own[t] for t in set(row) if own[t])), ends

    def toxic_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        for batch in batches:
            for part in slices(batch, batch.column(0)):
                for _, own, _ in shown(part, restorer, None):
                    yield pa.RecordBatch.from_arrays([pa.array(sorted(own), pa.string())], names=["mark"])

    least = 5
    found = sample.where("_toxic = 1").mapInArrow(toxic_marks, "mark string").groupBy("mark").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    often = {r["mark"]: r["n"] for r in found.collect()}  # of at most sample_rows rows
    n_rows = sample.groupBy("_toxic").agg(F.count("*").alias("n")).collect()
    n_toxic, n_other = (sum(r["n"] for r in n_rows if (r["_toxic"] == 1) == t) for t in (True, False))

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.column(0)):
                tokens, index, first = tokens_of(part.column(0))
                pairs = np.unique(np.repeat(np.arange(part.num_rows), np.diff(first)) * len(tokens) + index)
                n = np.bincount(pairs % max(1, len(tokens)), minlength=len(tokens))
                at = [k for k in np.flatnonzero(n).tolist() if tokens[k].isalpha() and not _TWICE.search(tokens[k])]
                yield pa.RecordBatch.from_arrays([pa.array([tokens[k] for k in at], pa.string()), pa.array(n[at])], names=["token", "n"])

    # A mark that plain words of the other rows show too often to be likely in toxic ones needs no decoding to be ruled out; half of
    # them are enough, for a word in a stretch may be read otherwise.
    enough = least * n_other / (RATIO * max(1, n_toxic))
    words = sample.where("_toxic <> 1").mapInArrow(plain, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") > enough)
    shown_by: dict[str, int] = {}
    for r in words.collect():  # of at most sample_rows rows
        for m in marks(r["token"]):
            if m in often:
                shown_by[m] = max(shown_by.get(m, 0), r["n"])
    likely = sorted(m for m, n in often.items() if (n + 0.5) / (n_toxic + 1) >= RATIO * (shown_by.get(m, 0) / 2) / (n_other + 1))
    wanted = {m: k for k, m in enumerate(likely)}

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, heads = Restorer(model), Heads(wanted)
        for batch in batches:
            for part in slices(batch, batch.column(0)):
                rows = list(shown(part, restorer, wanted, heads))
                clean = np.zeros(len(wanted), np.int64)
                for label, own, _ in rows:
                    if label != 1 and own:
                        clean[[wanted[m] for m in own]] += 1
                at = np.flatnonzero(clean)
                toxic = [([wanted[m] for m in own], ends) for label, own, ends in rows if label == 1]
                yield pa.RecordBatch.from_pydict(
                    {
                        "label": pa.array([1] * len(toxic) + [0], pa.int32()), "marks": pa.array([*(x for x, _ in toxic), at.tolist()], pa.list_(pa.int32())),
                        "n": pa.array([*(list(e) for _, e in toxic), clean[at].tolist()], pa.list_(pa.int64())), "rows": pa.array([1] * len(toxic) + [len(rows) - len(toxic)], pa.int64()),
                    }
                )

    seen = written(sample.mapInArrow(held, "label int, marks array<int>, n array<long>, rows long"), "marks")
    counts = seen.where("label = 0").select(F.explode(F.arrays_zip("marks", "n")).alias("x")).groupBy("x.marks").agg(F.sum("x.n").alias("n"))
    clean, n_clean = np.zeros(len(wanted)), seen.where("label = 0").agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    for r in counts.collect():  # a row for each mark
        clean[r["marks"]] = r["n"]
    rows = seen.where("label = 1").select("marks", "n").collect()  # at most sample_rows rows
    toxic, ends = [np.array(r["marks"], np.int64) for r in rows], [tuple(r["n"]) for r in rows]
    done_with(seen)
    names = sorted(wanted, key=wanted.get)
    worth: dict[str, float] = {}
    if toxic and n_clean:
        source = _sources(ends)
        pairs = np.unique(np.stack([np.concatenate(toxic), np.repeat(source, [*map(len, toxic)])], 1), axis=0)
        n, sources = np.bincount(pairs[:, 0], minlength=len(names)), len(np.unique(source))
        ratio = np.log((n + 0.5) / (sources + 1) / ((clean + 0.5) / (n_clean + 1)))
        worth = {m: float(r) for m, r, k in zip(names, ratio, n) if k >= max(least, sources // 250) and r >= math.log(RATIO)}
    model_ = ToxicModel(model, worth, 0.0, 0.0)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        for batch in batches:
            for part in slices(batch, batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(model_.evidence(part.column(0), restorer)), part.column(1).cast(pa.int32())], names=["x", "label"])

    rows = sample.mapInArrow(evidence, "x double, label int").toPandas()  # at most sample_rows pairs of numbers
    sample.unpersist()
    intercept, slope = curve(rows["x"].to_numpy(float), (rows["label"] == 1).to_numpy(float)) if len(rows) else (0.0, 0.0)
    return ToxicModel(model, worth, intercept, max(0.0, slope))


def scorer(model: ToxicModel):
    """A column function: the score of a text, 0 to 1. A null or empty text gets the score of one without any mark."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        restorer = Restorer(model.character)
        for texts in batches:
            parts = [model.score(part, restorer) for part in slices(texts)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return score


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: crc32 of its id as text leaves 0 when divided by 5. A null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def score_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with held_out, score and predicted; learned from the labelled rows that are not held out.

    Every row is scored, by its text alone. An empty table gives an empty result; other columns are kept, but for
    three of these names.
    """
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))), sample_rows)
    scored = docs.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("score", scorer(model)(F.col("text")))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_toxicity(docs.select("doc_id", "text"), labels.select("doc_id", "toxic")).select("doc_id", "held_out", "score", "predicted")
