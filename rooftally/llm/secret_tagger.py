"""A linear-chain conditional random field that tags tokens as begin, inside or outside of a secret."""

from __future__ import annotations

import itertools
import re
import string
from bisect import bisect_right
from dataclasses import dataclass, field
from functools import lru_cache
from zlib import crc32

import numpy as np

from rooftally.llm.common import distinct_words

#: Letters, digits and marks of a token; any other mark is a token by itself.
TOKEN = re.compile(r"[\w+/]+(?:[.\-]+[\w+/]+)*|[^\s\w+/]")
BEGIN, INSIDE, OUTSIDE = range(3)
#: Neighbouring words that are looked at, how far the farthest is, and the buckets that their features share.
OFFSETS = (-3, -2, -1, 1, 2)
GAP = 3
BUCKETS = 1 << 12
#: Own features are hashed to so many buckets of their own.
SHAPES = 1 << 13
FILES = 16
#: Words, as they stand between spaces, that a process keeps between texts with their tokens and scores; emptied when full, for speed alone.
KEPT_WORDS, KEPT_LETTERS = 1 << 19, 1 << 24
PENALTY = 1e-3
STEPS, RATE = 60, 0.15
_CLASSES = str.maketrans({**dict.fromkeys(string.ascii_lowercase, "a"), **dict.fromkeys(string.ascii_uppercase, "A"),
                          **dict.fromkeys(string.digits, "0")})
_HEX = re.compile(r"[0-9a-fA-F]+")
_RUNS = re.compile(r"(.)\1*", re.S)
#: Words that hint at a secret in the file.
HINTS = ("password", "passwd", "secret", "token", "api_key", "apikey", "private key", "bearer", "credential")


@lru_cache(1 << 16)
def _bucket(text: str, size: int) -> int:
    return crc32(text.encode("utf-8", "surrogatepass")) % size


def _level(n: float, limits: tuple[float, ...]) -> int:
    return bisect_right(limits, n)


def unusual(word: str) -> bool:
    """Whether a token can be part of a secret at all: any can. What speaks against plain words, numbers and marks is learned."""
    return True


def shape_features(word: str) -> list[int]:
    """Buckets of what a token looks like by itself."""
    n = len(word)
    classes = word.translate(_CLASSES)
    lower, upper, digit = classes.count("a"), classes.count("A"), classes.count("0")
    marks = "".join(c for c in "+/._-" if c in word)
    other = n - lower - upper - digit - sum(map(word.count, marks))
    runs = len(_RUNS.findall(classes)) if n <= 4096 else n
    kinds = f"{lower > 0:d}{upper > 0:d}{digit > 0:d}{other > 0:d}"
    length = _level(n, (2, 4, 6, 8, 10, 12, 16, 20, 24, 32, 40, 64))
    changes = _level(runs / n, (0.05, 0.15, 0.25, 0.35, 0.5))
    vowels = _level(sum(map(word.lower().count, "aeiou")) / max(1, lower + upper), (0.1, 0.2, 0.3, 0.45))
    different = _level(len(set(word)) / min(n, 40), (0.2, 0.35, 0.5, 0.7))
    digits = _level(digit / n, (0.01, 0.1, 0.25, 0.45, 0.7, 1.0))
    names = [f"l{length}", f"k{kinds}{marks}", f"kl{kinds}{length}", f"c{changes}{kinds}", f"v{vowels}{length}", f"d{digits}{length}{kinds}",
             f"u{different}{changes}", f"p{word[:4]}{kinds}{length >= 7:d}", f"m{marks}{digits}{changes}", f"x{bool(_HEX.fullmatch(word)):d}{length}"]
    return [_bucket(v, SHAPES) for v in names]


_LENGTHS, _CHANGES, _VOWELS = (2, 4, 6, 8, 10, 12, 16, 20, 24, 32, 40, 64), (0.05, 0.15, 0.25, 0.35, 0.5), (0.1, 0.2, 0.3, 0.45)
_DIFFERENT, _DIGITS = (0.2, 0.35, 0.5, 0.7), (0.01, 0.1, 0.25, 0.45, 0.7, 1.0)
_MARKS = "+/._-"


@lru_cache(1)
def _shape_tables() -> tuple[list[bytes], list[np.ndarray]]:
    """The names of 16 mixes of letter kinds, and of each trait but the first letters, the buckets by its levels."""
    kinds = [f"{k:04b}" for k in range(16)]
    marks = ["".join(c for i, c in enumerate(_MARKS) if m >> i & 1) for m in range(32)]
    l, c, v, d, u = (range(len(limits) + 1) for limits in (_LENGTHS, _CHANGES, _VOWELS, _DIGITS, _DIFFERENT))
    names = [(lambda i: f"l{i}", l), (lambda k, m: f"k{k}{m}", kinds, marks), (lambda k, i: f"kl{k}{i}", kinds, l), (lambda j, k: f"c{j}{k}", c, kinds),
             (lambda j, i: f"v{j}{i}", v, l), (lambda j, i, k: f"d{j}{i}{k}", d, l, kinds), (lambda i, j: f"u{i}{j}", u, c),
             (lambda m, i, j: f"m{m}{i}{j}", marks, d, c), (lambda h, i: f"x{h}{i}", range(2), l)]
    return [k.encode() for k in kinds], [np.array([_bucket(name(*at), SHAPES) for at in itertools.product(*axes)]).reshape([len(a) for a in axes])
                                         for name, *axes in names]


#: What a code point below 128 counts as: itself, or one letter for its class; and whether it is a vowel or a digit of hex.
_CLASS = np.array([ord(chr(c).translate(_CLASSES)) for c in range(128)], np.uint32)
_VOWEL, _HEXES = (np.array([chr(c) in letters for c in range(129)]) for letters in ("aeiouAEIOU", "0123456789abcdefABCDEF"))
_DOTTED_I = 0x130  # the one other letter whose lower case has a vowel in it


def shapes_of(words: list[str]) -> np.ndarray:
    """``shape_features`` of many tokens, a row for each."""
    if not words:
        return np.zeros((0, 10), np.int64)
    n = np.fromiter(map(len, words), np.int64, len(words))
    first = np.cumsum(n) - n
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.minimum(codes, 128)
    classes = np.where(low < 128, np.append(_CLASS, 0)[low], codes)

    def count(which: np.ndarray) -> np.ndarray:
        return np.add.reduceat(which, first, dtype=np.int64)

    def level(value: np.ndarray, limits: tuple[float, ...]) -> np.ndarray:
        return np.searchsorted(limits, value, side="right")

    lower, upper, digit = (count(classes == ord(c)) for c in "aA0")
    marks = [count(codes == ord(c)) for c in _MARKS]
    new = np.ones(len(codes), bool)
    new[1:] = classes[1:] != classes[:-1]
    new[first] = True
    runs = np.where(n <= 4096, count(new), n)
    k = (lower > 0) * 8 + (upper > 0) * 4 + (digit > 0) * 2 + (n - lower - upper - digit - sum(marks) > 0)
    m = sum((v > 0).astype(np.int64) << i for i, v in enumerate(marks))
    length, changes, digits = level(n, _LENGTHS), level(runs / n, _CHANGES), level(digit / n, _DIGITS)
    vowels = level(count(_VOWEL[low] | (codes == _DOTTED_I)) / np.maximum(1, lower + upper), _VOWELS)
    different = level(np.fromiter(map(len, map(set, words)), np.int64, len(words)) / np.minimum(n, 40), _DIFFERENT)
    hexes = (count(_HEXES[low]) == n).astype(np.int64)
    kinds, tables = _shape_tables()
    ends = [b"%b%d" % (kind, long) for kind in kinds for long in (0, 1)]
    starts = [crc32(b"p" + w[:4].encode("utf-8", "surrogatepass") + ends[e]) % SHAPES for w, e in zip(words, (2 * k + (length >= 7)).tolist())]
    levels = [(length,), (k, m), (k, length), (changes, k), (vowels, length), (digits, length, k), (different, changes), (m, digits, changes), (hexes, length)]
    columns = [t[at] for t, at in zip(tables, levels)]
    return np.stack([*columns[:7], np.array(starts), *columns[7:]], axis=1)


def neighbour(word: str) -> int:
    """Bucket of a word as a neighbour: itself if short, else its kind."""
    return crc32(word.lower().encode("utf-8", "surrogatepass")) % BUCKETS if len(word) <= 14 else _bucket("~long", BUCKETS)


def file_features(text: str) -> list[int]:
    """Levels of three traits of a whole text: marks of code, hints at secrets, size."""
    n = max(1, len(text))
    marks = _level(sum(map(text.count, "={};()<>")) / n, (0.002, 0.01, 0.03, 0.08))
    low = text.lower()
    hint = any(h in low for h in HINTS)
    return [marks, 5 + hint, 7 + _level(n, (300, 3_000, 30_000, 300_000))]


@dataclass
class Tagger:
    """Weights for (begin, inside, outside); transitions are [from, to]. Texts are bounded by outside on both ends."""

    shape: np.ndarray
    near: np.ndarray
    file: np.ndarray
    moves: np.ndarray
    _known: _Words | None = field(default=None, init=False, repr=False, compare=False)

    def scores(self, words: list[str], at: int, base: np.ndarray) -> np.ndarray:
        s = self.shape[shape_features(words[at])].sum(axis=0) + base
        for k, bucket in enumerate(near_features(words, at)):
            if bucket >= 0:
                s += self.near[k, bucket]
        return s

    def all_scores(self, words: list[str], base: np.ndarray) -> np.ndarray:
        """The scores of every token of a text."""
        out, near, n = self.shape[shapes_of(words)].sum(axis=1) + base, np.array([neighbour(w) for w in words]), len(words)
        for k, off in enumerate(OFFSETS):
            a, b = max(0, -off), max(0, n - max(0, off))
            if a < b:
                out[a:b] += self.near[k, near[a + off:b + off]]
        return out

    def undecided(self, scores: np.ndarray) -> np.ndarray:
        """Tokens whose tag depends on the path: at all others, outside beats any tag by more than all moves to and from it could make up for."""
        return (_lead(scores) <= self.gain() + 1e-9).any(axis=1)

    def gain(self) -> np.ndarray:
        """What the moves to and from begin and inside could make up for at most."""
        gain = (self.moves - self.moves[:, [OUTSIDE]]).max(axis=0) + (self.moves - self.moves[OUTSIDE]).max(axis=1)
        return gain[[BEGIN, INSIDE]]

    def best(self, scores: np.ndarray) -> list[int]:
        """The best tags of a run of tokens, with outside before and after it (Viterbi)."""
        total, back = self.moves[OUTSIDE] + scores[0], []
        for s in scores[1:]:
            paths = total[:, None] + self.moves
            back.append(paths.argmax(axis=0))
            total = paths.max(axis=0) + s
        tags = [int((total + self.moves[:, OUTSIDE]).argmax())]
        for step in reversed(back):
            tags.append(int(step[tags[-1]]))
        return tags[::-1]

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Secrets of a text as (start, end), by Viterbi over all its tokens."""
        return self.spans_of([text])[0]

    def spans_of(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """Secrets of each text as (start, end), by Viterbi over all its tokens.

        Every token gets a lower bound of the lead of outside, from its own part, its neighbours' and the text's; where the bound leaves it open, the
        scores are added up. Tokens that are outside on any best path cut the chain, so each run of others is decoded by itself.
        """
        if self._known is None:
            self._known = _Words(self)
        known = self._known
        token, starts = known.tokens(texts)
        base = np.array([self.file[file_features(t)].sum(axis=0) for t in texts]).reshape(-1, 3)
        near, last = known.bucket[token], len(token) - GAP
        low = known.low[token[GAP:last]] + np.repeat(_lead(base).min(axis=1), np.diff(starts))[:last - GAP]
        for k, off in enumerate(OFFSETS):
            low += known.near_low[k, near[GAP + off:last + off]]
        places = np.flatnonzero(low <= 1e-6) + GAP
        whose = np.searchsorted(starts, places, side="right") - 1
        scores = known.own[token[places]] + base[whose]
        for k, off in enumerate(OFFSETS):
            scores += known.near[k, near[places + off]]
        left = self.undecided(scores)
        places, whose, scores = places[left], whose[left], scores[left]
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        tags: dict[int, np.ndarray] = {}
        edges = [0, *(np.flatnonzero(np.diff(places) > 1) + 1), len(places)] if len(places) else [0]
        for first, end in itertools.pairwise(edges):
            best = self.best(scores[first:end])
            if any(tag != OUTSIDE for tag in best):
                k = int(whose[first])
                at = places[first] - starts[k]
                tags.setdefault(k, np.full(starts[k + 1] - starts[k], OUTSIDE))[at:at + len(best)] = best
        for k, tagged in tags.items():
            old = OUTSIDE
            for tag, m in zip(tagged.tolist(), TOKEN.finditer(texts[k])):
                if tag == INSIDE and old != OUTSIDE:
                    out[k][-1] = (out[k][-1][0], m.end())
                elif tag != OUTSIDE:
                    out[k].append(m.span())
                old = tag
        return out


def _lead(scores: np.ndarray) -> np.ndarray:
    """By how much outside leads begin and inside."""
    return scores[..., [OUTSIDE]] - scores[..., [BEGIN, INSIDE]]


class _Words:
    """The tokens of words, as they stand between spaces, and what each token adds to scores by itself and as a neighbour.

    No token reaches over a space. Number 0 is a gap between texts: tokens that are never in question and add nothing to their neighbours.
    """

    def __init__(self, tagger: Tagger):
        self.shape, self.gain = tagger.shape, tagger.gain()
        self.near = np.concatenate([tagger.near, np.zeros((len(OFFSETS), 1, 3))], axis=1)
        self.near_low = _lead(self.near).min(axis=2)
        self.clear()

    def clear(self) -> None:
        self.words, self.ids, self.letters = {None: 0}, {None: 0}, 0
        self.at, self.count, self.parts = np.zeros(1, np.int64), np.full(1, GAP), np.zeros(GAP, np.int64)
        self.own, self.low, self.bucket = np.zeros((1, 3)), np.full(1, np.inf), np.full(1, BUCKETS)

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the tokens of the texts in turn, with a gap before each and at the end, and where those of each text start (and one more would)."""
        sizes, which, words = distinct_words(texts)
        new = set(words).difference(self.words)
        if len(self.words) + len(new) > KEPT_WORDS or self.letters > KEPT_LETTERS:
            self.clear()
            new = set(words)
        if new:
            self._learn(list(new))
        # the words' own numbers, with a gap before each text and at the end
        gaps = np.cumsum([0, *sizes]) + np.arange(len(texts) + 1)
        known = np.zeros(len(which) + len(gaps), np.int64)
        held = np.ones(len(known), bool)
        held[gaps] = False
        known[held] = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))[which]
        counts = self.count[known]
        ends = np.cumsum(counts)
        return self.parts[np.arange(ends[-1]) + np.repeat(self.at[known] - ends + counts, counts)], ends[gaps]

    def _learn(self, words: list[str]) -> None:
        found = [TOKEN.findall(w) for w in words]
        tokens, ids = list(itertools.chain.from_iterable(found)), self.ids
        new = list(set(tokens).difference(ids))
        ids.update(zip(new, itertools.count(len(ids))))
        self.words.update(zip(words, itertools.count(len(self.words))))
        self.letters += sum(map(len, words))
        counts = np.fromiter(map(len, found), np.int64, len(found))
        self.at = np.concatenate([self.at, len(self.parts) + np.cumsum(counts) - counts])
        self.count = np.concatenate([self.count, counts])
        self.parts = np.concatenate([self.parts, np.fromiter(map(ids.__getitem__, tokens), np.int64, len(tokens))])
        own = [self.own, *(self.shape[shapes_of(new[k:k + 4096])].sum(axis=1) for k in range(0, len(new), 4096))]
        self.low = np.concatenate([self.low, *((_lead(v) - self.gain).min(axis=1) for v in own[1:])])
        self.own = np.concatenate(own)
        self.bucket = np.concatenate([self.bucket, np.fromiter(map(neighbour, new), np.int64, len(new))])


def near_features(words: list[str], at: int) -> list[int]:
    """Buckets of the neighbours, -1 beyond the text."""
    return [neighbour(words[at + off]) if 0 <= at + off < len(words) else -1 for off in OFFSETS]


def runs_of(words: list[str]) -> list[tuple[int, int]]:
    """Runs (first, end) of tokens that can be part of a secret: all of them."""
    return [(0, len(words))] if words else []


# --- training ----------------------------------------------------------------------------------------------------
def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _expected(scores: np.ndarray, moves: np.ndarray, held: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Of padded sequences (n, t, 3): sum of log partitions, tag probabilities, expected transitions."""
    n, t, _ = scores.shape
    ahead, behind = np.empty_like(scores), np.empty_like(scores)
    ahead[:, 0] = moves[2] + scores[:, 0]
    for k in range(1, t):
        step = _logsumexp(ahead[:, k - 1, :, None] + moves, 1) + scores[:, k]
        ahead[:, k] = np.where(held[:, k, None], step, ahead[:, k - 1])
    behind[:, -1] = moves[:, 2]
    for k in range(t - 2, -1, -1):
        step = _logsumexp(moves[None] + (scores[:, k + 1] + behind[:, k + 1])[:, None, :], 2)
        behind[:, k] = np.where(held[:, k + 1, None], step, moves[:, 2])
    whole = _logsumexp(ahead[:, -1] + moves[:, 2], 1)
    tags = np.exp(ahead + behind - whole[:, None, None]) * held[:, :, None]
    pairs = np.zeros((3, 3))
    pairs[2] += tags[:, 0].sum(axis=0)
    for k in range(1, t):
        joint = ahead[:, k - 1, :, None] + moves + (scores[:, k] + behind[:, k])[:, None, :] - whole[:, None, None]
        pairs += (np.exp(joint) * held[:, k, None, None]).sum(axis=0)
    last = held.sum(axis=1) - 1
    pairs[:, 2] += tags[np.arange(n), last].sum(axis=0)
    return float(whole.sum()), tags, pairs


def train(sequences: list[tuple[list[str], list[int], str]]) -> Tagger:
    """Maximum likelihood with a small quadratic penalty from (words, tags, text)."""
    runs = [(words, tags, file_features(text), first, last) for words, tags, text in sequences for first, last in runs_of(words)]
    width, n = 10, len(runs)
    t = max((last - first for *_, first, last in runs), default=1)
    ids: dict[str, int] = {}
    word = np.zeros((n, t), int)
    near = np.full((n, t, len(OFFSETS)), BUCKETS)
    file, gold, held = np.zeros((n, 3), int), np.full((n, t), OUTSIDE), np.zeros((n, t), bool)
    for i, (words, tags, traits, first, last) in enumerate(runs):
        for k in range(first, last):
            word[i, k - first] = ids.setdefault(words[k], len(ids))
            near[i, k - first] = [BUCKETS if v < 0 else v for v in near_features(words, k)]
        file[i], gold[i, :last - first], held[i, :last - first] = traits, tags[first:last], True
    weights = [np.zeros((SHAPES + 1, 3)), np.zeros((len(OFFSETS), BUCKETS + 1, 3)), np.zeros((FILES, 3)), np.zeros((3, 3))]
    if not n:
        weights[2][:, OUTSIDE] = 1e6  # nothing was seen, so nothing is found
        return Tagger(*_trimmed(weights))
    shape = np.array([shape_features(w) for w in ids])  # of distinct words
    weights[3][OUTSIDE, INSIDE] = -4.0
    one = np.eye(3)[gold] * held[:, :, None]
    seen = np.zeros((3, 3))
    before = np.concatenate([np.full((n, 1), OUTSIDE), gold], axis=1)[:, :t]
    np.add.at(seen, (before[held], gold[held]), 1)
    np.add.at(seen, (gold[np.arange(n), held.sum(axis=1) - 1], OUTSIDE), 1)
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, STEPS + 1):
        scores = weights[0][shape].sum(axis=1)[word] + sum(weights[1][k][near[:, :, k]] for k in range(len(OFFSETS))) + weights[2][file].sum(axis=1)[:, None, :]
        _, tags, pairs = _expected(scores, weights[3], held)
        off = tags - one
        each = [np.bincount(word.ravel(), off[:, :, y].ravel(), len(ids)) for y in range(3)]
        grades = [np.stack([np.bincount(shape.ravel(), np.repeat(v, width), SHAPES + 1) for v in each], axis=1),
                  np.stack([np.stack([np.bincount(near[:, :, k].ravel(), off[:, :, y].ravel(), BUCKETS + 1) for y in range(3)], axis=1)
                            for k in range(len(OFFSETS))]),
                  np.stack([np.bincount(file.ravel(), np.repeat(off[:, :, y].sum(axis=1), 3), FILES) for y in range(3)], axis=1), pairs - seen]
        for k, (w, g) in enumerate(zip(weights, grades)):
            g = g / n + PENALTY * w
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            w -= RATE * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)
        weights[0][SHAPES], weights[1][:, BUCKETS] = 0, 0
    return Tagger(*_trimmed(weights))


def _trimmed(weights: list[np.ndarray]) -> list[np.ndarray]:
    return [weights[0][:SHAPES], weights[1][:, :BUCKETS], weights[2], weights[3]]
