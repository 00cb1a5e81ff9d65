"""Token counts with a proven whole-token shortcut."""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The character that stands for a space inside pieces.
MARK = "▁"
#: Words that a worker remembers between batches; beyond that it starts anew.
CACHED_WORDS = 300_000


class PieceCounter:
    """Counts the tokens of a BPE piece model without encoding most of the words.

    ``prove`` checks offline, over the whole vocabulary, that no piece holds a space mark after another
    character. Merges therefore never cross the gap before a word's mark, and a text has as many tokens
    as its words have. It also encodes every vocabulary string by itself; those that come back as one
    token need no merging when they are met as a word.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.alone = self.prove()
        # A mark with nothing after it ends a text; by itself the library would take it for the one that it adds.
        last = len(self.model.encode("a ")) - len(self.model.encode("a"))
        self.proven = dict.fromkeys(self.alone, 1) | {MARK: last}
        self.known: dict[str, int] = dict(self.proven)

    def prove(self) -> set[str]:
        """Words (with their mark) that encode alone as one token; raises if words could merge with each other."""
        m = self.model
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))]
        if crossing := [p for p in pieces if MARK in p.lstrip(MARK)]:
            raise ValueError(f"pieces span words: {crossing[:3]}")
        if m.encode(" a  b\n", out_type=str)[:1] != [MARK] or m.encode("") != []:
            raise ValueError("the model trims white space or adds no mark before the first word")
        words = [p for p in pieces if p.startswith(MARK)]
        return {w for w, ids in zip(words, self.encode(words), strict=True) if len(ids) == 1}

    def encode(self, words: list[str]) -> list[list[int]]:
        """Ids of words that begin with their mark; the model adds the first mark itself."""
        return self.model.encode([w[1:].replace(MARK, " ") for w in words], num_threads=1)

    def learn(self, words: Iterable[str]) -> None:
        words = list(words)
        self.known.update(zip(words, map(len, self.encode(words)), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        split = [self.words(t) for t in texts]
        if len(self.known) > CACHED_WORDS:
            self.known = dict(self.proven)
        known = self.known
        if new := {w for words in split for w in words if w not in known}:
            self.learn(new)
        return [sum(map(known.__getitem__, words)) for words in split]

    @staticmethod
    def words(text: str) -> list[str]:
        """The text cut before each space; further spaces of a run stay with the word that follows them."""
        if not text:
            return []
        parts = (MARK + text.replace(" ", MARK)).split(MARK)[1:]
        out, run = [], ""
        for part in parts:
            run += MARK
            if part:
                out.append(run + part)
                run = ""
        return [*out, run] if run else out


@functools.cache
def piece_counter(path: str) -> PieceCounter:
    return PieceCounter(path)


@functools.cache
def library_counter(path: str):
    """Token counts of a tokenizer file whose vocabulary allows no shortcut."""
    import tokenizers

    own = tokenizers.Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    return lambda texts: [len(e.ids) for e in own.encode_batch_fast(texts, add_special_tokens=False)]


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts of a list of texts by the file's own library: sentencepiece for .model, tokenizers for .json."""
    return piece_counter(path).count if path.endswith(".model") else library_counter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of whole texts: ``doc_id, n_bytes, n_tokens, over_limit``.

    No begin, end or added special tokens, no truncation. A null text counts as empty and has no
    tokens; null and repeated ids pass through, an empty table gives no rows, other columns are ignored.
    """

    def run(batches):
        count = counter(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for k in range(0, len(texts), 500):
                n = count(texts[k : k + 500])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[k : k + 500],
                        pa.array([len(t.encode("utf-8")) for t in texts[k : k + 500]], pa.int64()),
                        pa.array(n, pa.int64()),
                        pa.array([x > limit for x in n], pa.bool_()),
                    ],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, schema)


def shortcut_share(counter: PieceCounter, texts: list[str]) -> float:
    """Share of the words that the proof answers without merging."""
    words = Counter(w for t in texts for w in counter.words(t))
    return sum(n for w, n in words.items() if w in counter.alone) / max(1, words.total())
