"""Plain versions of the operators for small inputs, and inputs with every odd case."""

import itertools
import random
import re

from veilframe.llm import quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(lower(text))


def components(nodes, links):
    """Smallest node that each node is joined to."""
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    return {n: root(n) for n in nodes}


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_groups(docs, percent=85):
    """{doc_id: (size of the set, component)}"""
    sets = {i: shingle_set(t) for i, t in docs}
    ids = sorted(i for i in sets if sets[i])
    links = [
        (a, b)
        for k, a in enumerate(ids)
        for b in ids[k + 1 :]
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    found = components(sets, links)
    return {i: (len(s), found[i]) for i, s in sets.items()}


def some_docs(seed=0, n=40):
    """Prose, exact copies with other white space, near copies in chains, copies with a different ending."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(400)]
    out = []
    for i in range(n):
        base = rng.choices(vocabulary, k=rng.randint(30, 160))
        out.append(" ".join(base) + ".")
        if i % 4 == 0:
            for _ in range(4):
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
                out.append(" ".join(base).capitalize() + ".")
        if i % 5 == 0:
            out.append("\n".join(out[-1].split(" ")))
    rng.shuffle(out)
    return [(i, t, rng.choice(["en", "de", "fr", "es"]), rng.choice("abc"), len(t)) for i, t in enumerate(out)]


def odd_docs():
    """Nulls in every column, empty and blank texts, a very long text, repeated rows, ties, few words, wide characters."""
    long = " ".join(f"word{i % 977} {i % 13}" for i in range(60_000))
    return [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \t\n ", "en", "a", 4),
        (4, long, "en", "a", len(long)),
        (5, "one two three", "en", None, 13),
        (6, "one two three", None, "a", 13),
        (6, "one two three", None, "a", 13),
        (None, "one two three", "de", "b", 13),
        (None, None, None, None, None),
        (7, "naïve 日本語 \U0001f600 </s> <s> ▁ \x00 text", "ja", "b", 30),
        (8, "ONE two\nthree", "xx", "c", 13),
        (-9, "x" * 5000, "en", "a", 5000),
    ]


#: Names that operators use inside; a table's own columns of these names must not matter.
CLASHES = ("id", "node", "key", "digest", "first", "component", "kept", "votes", "at", "word", "chunk", "tokens", "topic", "weight", "gone", "line")


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


def quality_votes(text: str) -> list[int]:
    """The quality labellers' votes, word by word."""
    words = text.split()
    if not words:
        return [quality.BAD] * len(quality.LABELLERS)

    def shape(word: str) -> str:
        kinds = ["A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in word]
        return "".join(k for k, _ in itertools.groupby(kinds))

    n, chars = len(words), sum(map(len, words))
    shapes = [shape(w) for w in words]
    loud = [len(w) > 2 and "a" not in s and "A" in s for w, s in zip(words, shapes, strict=True)]
    odd = [s.strip(quality.PUNCTUATION) not in quality.PROSE for s in shapes]
    stutter = sum(a == b for a, b in itertools.pairwise(words))
    lines = [x for x in text.split("\n") if x]
    stats = {
        "symbols": sum(not (c.isalnum() or c in quality.PUNCTUATION) for w in words for c in w) / chars,
        "odd": sum(odd) / n,
        "shouting": sum(loud) / n,
        "capitals": sum(c.isupper() for w in words for c in w) / chars,
        "stutter": stutter / n,
        "top_word": max(map(words.count, set(words))) / n if n >= 20 else 0.2,
        "separators": sum(len(s) == 1 and not s.isalnum() for s in shapes) / n,
        "same_lines": 1 - len(set(lines)) / len(lines) if len(lines) > 3 else 0.1,
        "unlike_prose": min(1.0, (sum(map(max, loud, odd)) + stutter) / n),
    }
    votes = []
    for k, (low, high) in quality.LIMITS.items():
        v = min(stats[k], (high + max(0, low)) / 2) if n < quality.SHORT else stats[k]
        votes.append(quality.GOOD if v <= low else quality.BAD if v >= high else quality.NONE)
    return votes
