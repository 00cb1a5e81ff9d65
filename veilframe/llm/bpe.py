"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches."""

from __future__ import annotations

import base64
import functools
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm._shared import slices

#: Bytes of text that one call of the library gets; bounds the memory of its results.
CALL_BYTES = 1 << 21
#: Words that a worker remembers between batches; beyond that it starts anew.
CACHED_WORDS = 300_000


@functools.cache
def byte_table() -> dict[int, str]:
    """The character that stands for each byte: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def rank_merges(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """Every pair of tokens whose concatenation is a token, in the order of that token's rank.

    The rank file allows any such pair to merge, not only the one that training chose, so all splits
    of a token are listed, the leftmost first.
    """
    by_rank = sorted((r, t) for t, r in ranks.items() if len(t) > 1)
    return [(t[:i], t[i:]) for _, t in by_rank for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]


def overlapping(ranks: dict[bytes, int]) -> list[bytes]:
    """The byte strings ``x+y+z`` with ``x+y == y+z`` a token and x, y, z tokens, x and z of other length than y.

    Where ``x, y, z`` stand side by side, either merge makes the same token. By ranks the leftmost goes
    first; the library's merge list may prefer the other. Words without such a string encode alike.
    """
    found = []
    for t in ranks:
        splits = {i for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        found += [t[:i] + t for i in splits if 2 * i != len(t) and len(t) - i in splits and t[i:] == t[: len(t) - i]]
    return sorted(set(found), key=len)


class ByteBPE:
    """Encoder and decoder for one rank file; built once per Python worker."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import ahocorasick
        import regex
        import tokenizers

        self.pattern, self.ranks = pattern, read_ranks(path)
        self.words = regex.compile(pattern).findall
        table = byte_table()
        chars = lambda b: "".join(map(table.__getitem__, b))
        merges = [(chars(a), chars(b)) for a, b in rank_merges(self.ranks)]
        self.library = tokenizers.Tokenizer(tokenizers.models.BPE(vocab={chars(t): r for t, r in self.ranks.items()}, merges=merges))
        self.library.pre_tokenizer = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        back = {c: b for b, c in table.items()}
        size = max(self.ranks.values()) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for i in self.ranks.values():
            self.bytes_of[i] = bytes(back[c] for c in self.library.id_to_token(i))
        self.overlap = ahocorasick.Automaton()
        for x in overlapping(self.ranks):
            self.overlap.add_word(x.decode("latin-1"), True)
        self.overlap.make_automaton()
        #: Of words seen lately: how many ids, these in decimal joined by commas, and the bytes that they decode to.
        self.known: dict[str, tuple[int, str, bytes]] = {}

    @functools.cached_property
    def exact(self):
        import tiktoken

        return tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})

    def learn(self, words: list[str]) -> None:
        """Encode words that are not in the cache, in one call of the library."""
        encoded = self.library.encode_batch([words], is_pretokenized=True, add_special_tokens=False)[0]
        ids = encoded.ids
        ends = np.cumsum(np.bincount(np.asarray(encoded.word_ids, np.int64), minlength=len(words))).tolist()
        first = 0
        for word, end in zip(words, ends, strict=True):
            self.keep(word, ids[first:end])
            first = end
        for word in self.ambiguous(words):
            self.keep(word, self.exact.encode_ordinary(word))

    def keep(self, word: str, ids: list[int]) -> None:
        self.known[word] = len(ids), ",".join(map(str, ids)), self.decode_bytes(ids)

    def ambiguous(self, words: list[str]) -> set[str]:
        """Words in which the order of merges could matter; they follow the ranks themselves."""
        raw = [w.encode("utf-8").decode("latin-1") for w in words]
        ends = np.cumsum([len(x) + 1 for x in raw])
        hits = [at for at, _ in self.overlap.iter(chr(0x100).join(raw))] if len(self.overlap) else []
        return {words[i] for i in np.searchsorted(ends, hits, side="right")}

    def look_up(self, texts: list[str]) -> list[list[tuple[int, str, bytes]]]:
        """For each text, what is known of each of its words."""
        split = [self.words(t) for t in texts]
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        if new := [w for w in set().union(*split) if w not in self.known]:
            self.learn(new)
        known = self.known.__getitem__
        return [list(map(known, words)) for words in split]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [[int(i) for _, ids, _ in words for i in ids.split(",")] for words in self.look_up(texts)]

    def offsets(self, ids: list[int], text: str) -> tuple[np.ndarray, np.ndarray]:
        """First character and the one after the last of each token; one that holds part of a character spans all of it."""
        raw = np.frombuffer(text.encode("utf-8"), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80, dtype=np.int32) - 1
        size = np.fromiter((len(self.bytes_of[i]) for i in ids), np.int64, len(ids))
        ends = np.cumsum(size)
        return char[ends - size], char[ends - 1] + 1

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """Text of the ids; a character whose bytes lie in several tokens is put together, a broken one becomes U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


@functools.cache
def byte_bpe(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(path, pattern)


def runs_of(texts: list[str], limit: int = CALL_BYTES) -> Iterator[slice]:
    first = size = 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > limit:
            yield slice(first, i)
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield slice(first, len(texts))


ENCODED = "doc_id long, ids array<int>, starts array<int>, ends array<int>"


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids and character offsets of whole texts: ``doc_id, ids, starts, ends``.

    A null text counts as empty and has no tokens; ids may be null or repeated; other columns are ignored.
    """

    def run(batches):
        bpe = byte_bpe(path, pattern)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for part in runs_of(texts):
                done = bpe.encode(texts[part])
                spans = [bpe.offsets(ids, t) for ids, t in zip(done, texts[part], strict=True)]
                ints = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[part.start : part.stop],
                        pa.array(done, ints),
                        pa.array([s for s, _ in spans], ints),
                        pa.array([e for _, e in spans], ints),
                    ],
                    names=["doc_id", "ids", "starts", "ends"],
                )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Bytes and text of token ids: ``doc_id, bytes, text``. Null ids give empty bytes and text."""

    def run(batches):
        bpe = byte_bpe(path, pattern)
        for batch in slices(batches):
            whole = [bpe.decode_bytes(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(whole, pa.binary()), pa.array([b.decode("utf-8", "replace") for b in whole], pa.string())],
                names=["doc_id", "bytes", "text"],
            )

    return encoded.select(F.col(id_col).cast("long"), F.col(ids_col)).mapInArrow(run, "doc_id long, bytes binary, text string")


SUMMARY = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass over the texts and return digests only: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    ``ids_sha256`` is the hex digest of the decimal ids joined by commas, ``decoded_sha256`` that of
    the decoded bytes. Nulls as in ``encode``.
    """

    def run(batches):
        bpe = byte_bpe(path, pattern)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for part in runs_of(texts):
                done = bpe.look_up(texts[part])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[part.start : part.stop],
                        pa.array([sum([n for n, _, _ in words]) for words in done], pa.int64()),
                        pa.array([sha(",".join([x for _, x, _ in words]).encode()) for words in done], pa.string()),
                        pa.array([sha(b"".join([x for _, _, x in words])) for words in done], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, SUMMARY)
