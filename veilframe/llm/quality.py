"""Quality classifier: weak labels by expectation-maximisation, then a hashed linear scorer."""

from __future__ import annotations

import re
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm._shared import slices

GOOD, BAD, NONE = 1, -1, 0
#: Buckets of the hashed features.
BUCKETS = 1 << 16
#: Texts of fewer words say too little for a vote against them.
SHORT = 8
#: Words, and characters of words, that a worker remembers the facts of; beyond either it starts anew with the next texts.
CACHED_WORDS, CACHED_CHARS = 100_000, 4_000_000

#: A labeller votes bad where its statistic is at least the second number, good where it is at most the
#: first, and has no opinion otherwise. Most only know one kind of junk, so they never vote good; kinds overlap in
#: ``odd``, ``capitals`` and ``top_word``, and ``unlike_prose`` sees them all.
LIMITS = {
    "symbols": (-1, 0.20),
    "odd": (-1, 0.40),
    "shouting": (-1, 0.40),
    "capitals": (-1, 0.50),
    "stutter": (-1, 0.25),
    "top_word": (-1, 0.35),
    "separators": (-1, 0.15),
    "same_lines": (-1, 0.60),
    "unlike_prose": (0.12, 0.45),
}
LABELLERS = tuple(LIMITS)
#: Characters and word shapes that prose has.
PUNCTUATION = ".,;:!?'\"()-"
PROSE = {"a", "A", "Aa", "9", "a-a", "Aa-Aa", "Aa-a", "a'a", "A'Aa", "Aa'a"}


#: The kind of each ASCII character.
_KINDS = {c: "A" if chr(c).isupper() else "a" if chr(c).isalpha() else "9" if chr(c).isdigit() else chr(c) for c in range(128)}
_AGAIN = re.compile(r"(.)\1+", re.DOTALL)
#: Bucket of each labeller's statistic in tenths.
_STAT_BUCKETS = np.array([[zlib.crc32(f"stat {k} {tenth}".encode()) % BUCKETS for tenth in range(11)] for k in LABELLERS])


def kinds(word: str) -> str:
    """A for an upper-case letter, a for any other, 9 for a digit, other characters as they are."""
    if word.isascii():
        return word.translate(_KINDS)
    return "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in word)


class Kinds(dict):
    """Numbers of what ``kinds`` gives for words, and the facts of each by its number: a column of integers a fact."""

    FACTS = ("bucket", "chars", "symbols", "capitals", "shouting", "odd", "unlike", "bars")

    def __init__(self) -> None:
        self.columns = {k: array("q") for k in self.FACTS}
        self.held = 0

    def __missing__(self, k: str) -> int:
        s = _AGAIN.sub(r"\1", k)
        symbols = sum(not (c.isalnum() or c in PUNCTUATION) for c in k)
        loud = len(k) > 2 and "a" not in s and "A" in s
        odd = s.strip(PUNCTUATION) not in PROSE
        bucket = zlib.crc32(s.encode("utf-8", "surrogatepass")) % BUCKETS
        facts = bucket, len(k), symbols, k.count("A"), loud, odd, loud or odd, len(s) == 1 and not s.isalnum()
        for column, fact in zip(self.columns.values(), facts, strict=True):
            column.append(fact)
        self[k] = number = len(self)
        self.held += len(k)
        return number

    def fact(self, name: str, numbers: np.ndarray) -> np.ndarray:
        return np.frombuffer(self.columns[name], np.int64)[numbers]

    @property
    def full(self) -> bool:
        return len(self) > CACHED_WORDS or self.held > CACHED_CHARS


class Words(dict):
    """Numbers of words; ``kind`` has the number of each one's kinds."""

    def __init__(self, known: Kinds) -> None:
        self.known, self.kind, self.held = known, array("q"), 0

    def __missing__(self, word: str) -> int:
        self.kind.append(self.known[kinds(word)])
        self[word] = number = len(self)
        self.held += len(word)
        return number

    @property
    def full(self) -> bool:
        return len(self) > CACHED_WORDS or self.held > CACHED_CHARS


@dataclass
class Read:
    """What is read off some texts: ``votes`` has a row for each; features are ``weight`` at ``at`` of ``text``, in order of the texts."""

    votes: np.ndarray
    text: np.ndarray
    at: np.ndarray
    weight: np.ndarray


class Reader:
    """Votes and hashed features of texts; remembers words and the facts of their kinds between batches."""

    def __init__(self) -> None:
        self.words = Words(Kinds())

    def read(self, texts: list[str], features: bool = True) -> Read:
        """Votes of the labellers and, if asked for, the hashed features with weights of unit length; none for a text without words."""
        if self.words.full or self.words.known.full:
            self.words = Words(Kinds() if self.words.known.full else self.words.known)
        votes = np.full((len(texts), len(LABELLERS)), BAD, np.int8)
        coded = [np.fromiter(map(self.words.__getitem__, w), np.int64, len(w)) for w in map(str.split, texts)]
        has = np.flatnonzero([len(c) for c in coded])
        none = Read(votes, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if not len(has):
            return none
        n = np.array([len(coded[i]) for i in has])
        starts = np.r_[0, np.cumsum(n)[:-1]]
        codes = np.concatenate([coded[i] for i in has])
        del coded
        same = np.r_[False, codes[1:] == codes[:-1]]
        same[starts] = False
        stutter = np.add.reduceat(same.astype(np.int64), starts)
        keys, times = np.unique(np.repeat(np.arange(len(has)) * len(self.words), n) + codes, return_counts=True)
        text, word = np.divmod(keys, len(self.words))
        known, kind = self.words.known, np.frombuffer(self.words.kind, np.int64)[word]
        most = np.maximum.reduceat(times, np.searchsorted(text, np.arange(len(has))))
        chars, symbols, capitals, shouting, odd, unlike, bars = (
            np.bincount(text, times * known.fact(k, kind), len(has)) for k in Kinds.FACTS[1:]
        )
        stats = {
            "symbols": symbols / chars,
            "odd": odd / n,
            "shouting": shouting / n,
            "capitals": capitals / chars,
            "stutter": stutter / n,
            "top_word": np.where(n >= 20, most / n, 0.2),
            "separators": bars / n,
            "same_lines": np.array([repeated_share(texts[i]) for i in has]),
            "unlike_prose": np.minimum(1.0, (unlike + stutter) / n),
        }
        for k, (name, (low, high)) in enumerate(LIMITS.items()):
            v = stats[name]
            stats[name] = v = np.where(n < SHORT, np.minimum(v, (high + max(0, low)) / 2), v)
            votes[has, k] = np.where(v <= low, GOOD, np.where(v >= high, BAD, NONE))
        if not features:
            return none
        tenths = (10 * np.array([stats[k] for k in LABELLERS])).astype(np.int64)
        rows = np.r_[text, np.tile(np.arange(len(has)), len(LABELLERS))]
        places = np.r_[known.fact("bucket", kind), np.take_along_axis(_STAT_BUCKETS, tenths, 1).ravel()]
        keys, back = np.unique(rows * BUCKETS + places, return_inverse=True)
        total = np.bincount(back, np.r_[times, np.tile(n, len(LABELLERS))])
        text, at = np.divmod(keys, BUCKETS)
        weight = np.sqrt(total / n[text])
        weight /= np.sqrt(np.bincount(text, weight**2))[text]
        return Read(votes, has[text], at, weight)


def repeated_share(text: str) -> float:
    """Share of a text's lines that repeat another; few lines say nothing."""
    lines = [x for x in text.split("\n") if x]
    return 1 - len(set(lines)) / len(lines) if len(lines) > 3 else 0.1


def weak_labels(patterns: dict[tuple[int, ...], int], rounds: int = 100) -> tuple[float, np.ndarray, dict[tuple[int, ...], float]]:
    """Expectation-maximisation over vote patterns and their counts.

    Returns the share of good documents, each labeller's distribution of votes given bad and given
    good (labellers x 2 x 3, votes in the order bad, none, good), and for each pattern the posterior
    of good. Begins with the belief that a pattern with a bad vote is bad.
    """
    if not patterns:
        return 0.5, np.full((len(LABELLERS), 2, 3), 1 / 3), {}
    keys = sorted(patterns)
    votes = np.array(keys) + 1
    counts = np.array([patterns[k] for k in keys], float)
    good = np.where((votes == 0).any(1), 0.2, 0.95)
    for _ in range(rounds):
        share = np.clip(counts @ good / counts.sum(), 1e-6, 1 - 1e-6)
        given = np.empty((votes.shape[1], 2, 3))
        for side, p in enumerate((1 - good, good)):
            for v in range(3):
                given[:, side, v] = (counts * p) @ (votes == v) + 0.5
        given /= given.sum(2, keepdims=True)
        log = np.log(given[np.arange(votes.shape[1]), :, votes]).sum(1) + np.log([1 - share, share])
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -700, 700)))
        done = np.abs(new - good).max() < 1e-9
        good = new
        if done:
            break
    return float(share), given, dict(zip(keys, good.tolist(), strict=True))


@dataclass
class Scorer:
    """A linear scorer over hashed features: the probability that a text is good."""

    weights: np.ndarray
    bias: float

    def score(self, read: Read) -> np.ndarray:
        """A number for each text; 0 for one without features."""
        texts = len(read.votes)
        sums = np.bincount(read.text, self.weights[read.at] * read.weight, texts)
        return np.where(np.bincount(read.text, minlength=texts) > 0, 1 / (1 + np.exp(-(sums + self.bias))), 0.0)


def fit_scorer(rows: list[tuple[list[int], list[float], float]], rounds: int = 300, ridge: float = 1e-4) -> Scorer:
    """Logistic regression on soft labels, both classes weighted alike; rows are features, weights, posterior of good."""
    rows = [r for r in rows if len(r[0])]
    w, bias = np.zeros(BUCKETS), 0.0
    if not rows:
        return Scorer(w, bias)
    at = np.concatenate([np.asarray(a, np.int64) for a, _, _ in rows])
    x = np.concatenate([np.asarray(v, float) for _, v, _ in rows])
    row = np.repeat(np.arange(len(rows)), [len(a) for a, _, _ in rows])
    y = np.array([p for *_, p in rows])
    weight = y / max(y.sum(), 1e-9) + (1 - y) / max((1 - y).sum(), 1e-9)
    weight /= weight.sum()
    speed_w, speed_b, step = np.zeros(BUCKETS), 0.0, 4.0
    for _ in range(rounds):
        z = np.bincount(row, x * w[at], len(rows)) + bias
        slope = weight * (1 / (1 + np.exp(-z)) - y)
        speed_w = 0.9 * speed_w - step * (np.bincount(at, x * slope[row], BUCKETS) + ridge * w)
        speed_b = 0.9 * speed_b - step * slope.sum()
        w, bias = w + speed_w, bias + speed_b
    return Scorer(w, float(bias))


def votes_and_features(docs: DataFrame, id_col: str, text_col: str, features: bool) -> DataFrame:
    """``doc_id, votes`` and, if asked, ``at, weight`` of whole texts."""

    def run(batches):
        reader = Reader()
        for batch in slices(batches):
            read = reader.read([t or "" for t in batch.column(1).to_pylist()], features)
            out = [batch.column(0), pa.array(read.votes.tolist(), pa.list_(pa.int8()))]
            if features:
                ends = np.searchsorted(read.text, np.arange(batch.num_rows + 1)).astype(np.int32)
                out += [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (read.at.astype(np.int32), read.weight)]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "votes", "at", "weight"][: len(out)])

    schema = "doc_id long, votes array<tinyint>" + ", at array<int>, weight array<double>" * features
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, schema)


@dataclass
class QualityModel:
    share_good: float
    vote_given_class: np.ndarray
    posterior: dict[tuple[int, ...], float]
    scorer: Scorer


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = 6000, seed: int = 7) -> QualityModel:
    """Fit both models. The labellers' accuracies come from the votes on all documents.

    The linear scorer is fitted on the driver to about ``fit_rows`` documents (the documented bound)
    that a hash of the id picks at the rate ``fit_rows / documents``; vote patterns number at most
    3 to the power of the labellers.
    """
    grouped = votes_and_features(docs, id_col, text_col, False).groupBy("votes").count().collect()
    patterns = {tuple(r["votes"]): r["count"] for r in grouped}
    share, given, posterior = weak_labels(patterns)
    total = sum(patterns.values())
    rate = int(min(1.0, fit_rows / max(1, total)) * 2**31)
    picked = docs.where(F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)), F.lit(2**31)) < rate)
    rows = votes_and_features(picked, id_col, text_col, True).select("votes", "at", "weight").collect()
    return QualityModel(share, given, posterior, fit_scorer(sorted((r["at"], r["weight"], posterior.get(tuple(r["votes"]), share)) for r in rows)))  # sums in one order


def classify(
    docs: DataFrame, model: QualityModel | None = None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = 6000
) -> DataFrame:
    """Score whole texts: ``doc_id, score, weak_posterior, bad_votes, good_votes, kept``.

    ``score`` is the linear scorer's probability of good, ``kept`` says that it is at least the
    threshold; ``weak_posterior`` is what the label model alone says. A null text counts as empty; a
    text without words has score 0 and is not kept. Null and repeated ids are scored like others;
    an empty table gives no rows; other columns are ignored.
    """
    model = model or fit(docs, id_col, text_col, fit_rows)
    scorer, posterior, share = model.scorer, model.posterior, model.share_good
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col))

    def run(batches):
        reader = Reader()
        for batch in slices(batches):
            read = reader.read([t or "" for t in batch.column(1).to_pylist()])
            score, votes = scorer.score(read), read.votes
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(score, pa.float64()),
                    pa.array([posterior.get(tuple(v), share) for v in votes.tolist()], pa.float64()),
                    pa.array((votes == BAD).sum(1).astype(np.int32)),
                    pa.array((votes == GOOD).sum(1).astype(np.int32)),
                    pa.array(score >= threshold),
                ],
                names=["doc_id", "score", "weak_posterior", "bad_votes", "good_votes", "kept"],
            )

    return rows.mapInArrow(run, "doc_id long, score double, weak_posterior double, bad_votes int, good_votes int, kept boolean")
