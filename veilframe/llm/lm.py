"""Language-model scores from a subword lattice."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm._shared import Scratch

MARK = "▁"
#: Bytes of text in a chunk; a chunk's distinct words and tokens are what a task holds.
CHUNK_BYTES = 8 << 20
#: Classes of documents with a model of their own; the rest share one more.
MAX_CLASSES = 8
#: Added to every piece's count.
PIECE_FLOOR = 0.05

#: Longest words, and smallest probabilities, that are taken as products of floats.
PRODUCT_CHARS, SMALLEST = 64, 1e-250
#: Rows of facts that a task holds before it packs them by chunk.
HOLD_ROWS = 1 << 19

CHUNKS = (
    "chunk long, words array<string>, train array<struct<at: int, class: string, n: long>>,"
    " classes array<struct<class: string, documents: long>>, ids array<long>, held array<boolean>, sizes array<int>,"
    " distinct int, tokens binary"
)
PACKED = "chunk long, size int, known binary, new_at array<int>, new array<string>"


def squeeze(rows: np.ndarray) -> bytes:
    """Compress an array with equal bytes of all rows side by side."""
    return pa.compress(rows.view(np.uint8).reshape(len(rows), -1).T.tobytes(), "zstd", asbytes=True) if len(rows) else b""


def expand(data: bytes, size: int, kind: np.dtype) -> np.ndarray:
    if not size:
        return np.zeros(0, kind)
    raw = np.frombuffer(pa.decompress(data, size * kind.itemsize, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, size).T).view(kind).reshape(size)


class Numbered(dict):
    """Numbers keys in the order in which they are first met."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def is_held_out(doc_id, modulus: int, remainder: int) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus == remainder


def chunked(docs: DataFrame, modulus: int, remainder: int, id_col: str, text_col: str, class_col: str | None) -> DataFrame:
    """Runs of documents with their words numbered within the run, and how often training documents of each class have them.

    Words are numbered by how often the run has them. The order of a document's tokens doesn't matter
    for its score, so ``tokens`` has their numbers sorted, as differences.
    """
    train_fields = [("at", pa.int32()), ("class", pa.string()), ("n", pa.int64())]
    train_type = pa.list_(pa.struct(train_fields))
    class_type = pa.list_(pa.struct([("class", pa.string()), ("documents", pa.int64())]))
    kinds = {
        "chunk": pa.int64(), "words": pa.list_(pa.string()), "train": train_type, "classes": class_type, "ids": pa.list_(pa.int64()),
        "held": pa.list_(pa.bool_()), "sizes": pa.list_(pa.int32()), "distinct": pa.int32(), "tokens": pa.binary(),
    }

    def pack(number, ids, texts, classes):
        index = Numbered()
        tokens = [np.fromiter(map(index.__getitem__, t.lower().split()), np.int32) for t in texts]
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        flat = np.concatenate(tokens)
        order = np.argsort(-np.bincount(flat, minlength=len(index)), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        held = [is_held_out(i, modulus, remainder) for i in ids]
        of_class: dict[str, list[np.ndarray]] = {}
        for t, h, c in zip(tokens, held, classes, strict=True):
            if not h:
                of_class.setdefault(c, []).append(t)
        at, n, names = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        for c, own in of_class.items():
            counts = np.bincount(rank[np.concatenate(own)], minlength=len(index))
            at.append(np.flatnonzero(counts))
            n.append(counts[at[-1]])
            names += [c] * len(at[-1])
        train = pa.StructArray.from_arrays(
            [pa.array(np.concatenate(at), pa.int32()), pa.array(names, pa.string()), pa.array(np.concatenate(n), pa.int64())], fields=[pa.field(*f) for f in train_fields]
        )
        groups = [{"class": c, "documents": len(own)} for c, own in of_class.items()]
        spelled = list(index)
        words = pa.array([spelled[i].decode("utf-8", "replace") for i in order.tolist()], pa.string())
        ranks = (np.sort((np.repeat(np.arange(len(sizes)), sizes) << 32) | rank[flat]) & 0xFFFFFFFF).astype(np.uint32)
        packed = squeeze(np.diff(ranks, prepend=np.uint32(0)))
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        rest = {"chunk": number, "classes": groups, "ids": ids, "held": held, "sizes": sizes, "distinct": len(order), "tokens": packed}
        columns = {k: pa.array([v], kinds[k]) for k, v in rest.items()} | {"words": one(words), "train": one(train)}
        return pa.RecordBatch.from_arrays([columns[k].cast(kinds[k]) for k in kinds], names=list(kinds))

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        ids, texts, classes, size = [], [], [], 0
        for batch in batches:
            for first in range(0, batch.num_rows, 100):
                for i, t, c in zip(*(x.to_pylist() for x in batch[first : first + 100].columns), strict=True):
                    ids.append(i)
                    texts.append((t or "").encode("utf-8", "surrogatepass"))
                    classes.append(c)
                    size += len(texts[-1])
                    if size >= CHUNK_BYTES:
                        yield pack(number, ids, texts, classes)
                        number, ids, texts, classes, size = number + 1, [], [], [], 0
        if ids:
            yield pack(number, ids, texts, classes)

    of = F.coalesce(F.col(class_col).cast("string"), F.lit("")) if class_col else F.lit("")
    return docs.select(F.col(id_col).cast("long"), F.col(text_col), of).mapInArrow(run, CHUNKS)


def piece_counts(words: DataFrame, path: str, classes: int) -> list[Counter]:
    """For each class, how often the pieces of the public vocabulary occur in its distinct training words."""

    def run(batches):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        total = [Counter() for _ in range(classes)]
        for batch in batches:
            for ids, ns in zip(model.encode(batch.column(0).to_pylist(), num_threads=1), batch.column(1).to_pylist(), strict=True):
                for k, n in enumerate(ns):
                    if n:
                        total[k].update(ids)
        rows = [(k, p, n) for k, c in enumerate(total) for p, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64()))], names=["k", "piece", "n"])

    found = words.select("word", "own").mapInArrow(run, "k int, piece int, n long").groupBy("k", "piece").agg(F.sum("n").alias("n"))
    out = [Counter() for _ in range(classes)]
    for r in found.collect():  # at most the vocabulary for each class
        out[r["k"]][r["piece"]] = r["n"]
    return out


@dataclass
class Lattice:
    """Scores, one for each class, of the pieces with which a word may begin or go on, and of ending it; natural logarithms."""

    first: dict[str, tuple[float, ...]]
    rest: dict[str, tuple[float, ...]]
    byte: list[tuple[float, ...]]
    stop: tuple[float, ...]
    prefixes: frozenset[str]

    @classmethod
    def of(cls, path: str, counts: list[Counter], types: list[int]) -> Lattice:
        """Shares of the pieces among the first and among the later ones of each class's distinct words, each with a floor."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i))]
        names = {i: model.id_to_piece(i) for i in plain}
        start = {i for i in plain if names[i].startswith(MARK)}
        later = [i for i in plain if i not in start]
        scores: dict[int, list[float]] = {i: [] for i in plain}
        stops = []
        for c, t in zip(counts, types, strict=True):
            weight = {i: c[i] + PIECE_FLOOR for i in plain}
            stop = (t + 1) / (t + 2 + sum(c[i] for i in later))
            stops.append(math.log(stop))
            for part, extra in ((start, 0.0), (later, math.log1p(-stop))):
                total = sum(weight[i] for i in part)
                for i in part:
                    scores[i].append(extra + math.log(weight[i] / total))
        first = {names[i]: tuple(scores[i]) for i in start}
        rest = {names[i]: tuple(scores[i]) for i in later if not model.is_byte(i)}
        byte = [()] * 256
        for i in later:
            if model.is_byte(i):
                byte[int(names[i][3:5], 16)] = tuple(scores[i])
        prefixes = frozenset(p[:k] for p in (*first, *rest) for k in range(1, len(p) + 1))
        return cls(first, rest, byte, tuple(stops), prefixes)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "ends"}

    def marginal(self, word: str) -> list[float]:
        return self.marginals([word])[0]

    def marginals(self, words: list[str]) -> list[list[float]]:
        """For each word and class the log-probability of the word, summed over all its segmentations by forward recursion.

        A character that is no piece goes by its bytes. Words are taken in order, so that what a word and the
        one before both begin with is summed once. Probabilities too small for a float are summed as logarithms.
        """
        if "ends" not in self.__dict__:
            self.ends = tree(self.rest), {p: [math.exp(x) for x in s] for p, s in self.first.items()}
        out: list[list[float]] = [[]] * len(words)
        before, sums = "", [[1.0] * len(self.stop)]
        for n in sorted(range(len(words)), key=words.__getitem__):
            text = MARK + words[n]
            if len(text) > PRODUCT_CHARS:
                out[n] = self.by_logarithms(words[n])
                continue
            same = 0
            for x, y in zip(before, text):  # noqa: B905
                if x != y:
                    break
                same += 1
            before = text
            del sums[same + 1 :]
            for j in range(same + 1, len(text) + 1):
                sums.append(self._sum(text, j, sums))
            total = sums[-1]
            if min(total) < SMALLEST:
                out[n] = self.by_logarithms(words[n])
            else:
                out[n] = [math.log(x) + y for x, y in zip(total, self.stop, strict=True)]
        return out

    def _sum(self, text: str, j: int, sums: list[list[float]]) -> list[float]:
        """Probabilities of the first ``j`` characters, given those of fewer."""
        branch, first = self.ends
        found = first.get(text[:j])
        for i in range(j - 1, 0, -1):
            if (step := branch.get(text[i])) is None:
                break
            branch, p = step
            if p is not None:
                found = [x * y for x, y in zip(sums[i], p)] if found is None else [o + x * y for o, x, y in zip(found, sums[i], p)]  # noqa: B905
        if j > 1 and text[j - 1] not in self.rest:
            spelled = [self.byte[b] for b in text[j - 1].encode("utf-8", "surrogatepass")]
            came = [x * math.exp(sum(s[k] for s in spelled)) for k, x in enumerate(sums[j - 1])]
            found = came if found is None else [x + y for x, y in zip(found, came, strict=True)]
        return [0.0] * len(self.stop) if found is None else found

    def by_logarithms(self, word: str) -> list[float]:
        """The same of one word, by sums of logarithms."""
        text = MARK + word
        n, prefixes, classes = len(text), self.prefixes, range(len(self.stop))
        arrive: list[list[list[float]]] = [[] for _ in range(n + 1)]
        arrive[0].append([0.0] * len(self.stop))
        table = self.first
        here: list[float] = []
        for i in range(n + 1):
            came = arrive[i]
            if not came:
                continue
            here = came[0] if len(came) == 1 else [sum_logs([c[k] for c in came]) for k in classes]
            if i == n:
                break
            for j in range(i + 1, n + 1):
                piece = text[i:j]
                if piece not in prefixes:
                    break
                if (score := table.get(piece)) is not None:
                    arrive[j].append([x + y for x, y in zip(here, score)])  # noqa: B905
            if i and text[i] not in table:
                spelled = [self.byte[b] for b in text[i].encode("utf-8", "surrogatepass")]
                arrive[i + 1].append([x + sum(s[k] for s in spelled) for k, x in enumerate(here)])
            arrive[i] = []
            table = self.rest
        return [x + y for x, y in zip(here, self.stop, strict=True)]


def tree(scores: dict[str, tuple[float, ...]]) -> dict:
    """Pieces by their characters, the last first: the branch before each and the piece's probabilities, if one begins there."""
    root: dict = {}
    for piece, logs in scores.items():
        branch = root
        for ch in piece[:0:-1]:
            branch = branch.setdefault(ch, [{}, None])[0]
        branch.setdefault(piece[0], [{}, None])[1] = [math.exp(x) for x in logs]
    return root


def sum_logs(terms: list[float]) -> float:
    top = max(terms)
    return top + math.log(sum([math.exp(t - top) for t in terms]))


@dataclass
class Totals:
    """Of a class's training tokens: all (ends included), documents, distinct words, words met once and twice."""

    tokens: int
    documents: int
    words: int
    once: int
    twice: int

    @property
    def discount(self) -> float:
        """What each distinct word gives up for words that were not met."""
        return self.once / (self.once + 2 * self.twice) if self.once else 0.5

    @property
    def spelled(self) -> float:
        """Probability that the next token is spelled by pieces."""
        return self.discount * self.words / self.tokens if self.words else 0.5

    @property
    def end(self) -> float:
        return self.documents / self.tokens if self.words else 0.5


def score_documents(
    scratch: Scratch, docs: DataFrame, vocabulary: str, modulus: int = 7, remainder: int = 2,
    id_col: str = "doc_id", text_col: str = "text", class_col: str | None = None,
) -> DataFrame:
    """Log10-probabilities of whole texts: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    A text is its words, lower-cased (A-Z), and an end. The model gives each token the sum over two
    kinds of paths of the lattice: the whole word, with its discounted share of the training tokens, and
    every segmentation into pieces of the public vocabulary, which share what the discount left. The
    vocabulary file holds merge ranks, not probabilities, so the pieces' scores are their shares in the
    distinct training words. With ``class_col`` (the language, say) each of the MAX_CLASSES classes with
    most training documents has such a model, the others share one, and a text's probability is the
    sum over the classes, whatever its own class is. Word counts come from all training documents.
    ``base_score`` is the add-one unigram score over all classes.

    Documents whose ``crc32(id as text) mod modulus`` is ``remainder`` are held out. Null text counts as
    empty (one token, the end); a null id counts as empty text for the split; a null class is a class;
    repeated rows are scored and counted each; with no training document or no words both models still
    give finite scores. Other columns are ignored; an empty table gives no rows.
    """
    chunks = scratch.table(chunked(docs, modulus, remainder, id_col, text_col, class_col), "chunks", "zstd")
    groups = chunks.select(F.explode("classes").alias("c")).groupBy("c.class").agg(F.sum("c.documents").alias("n"))
    everything = groups.agg(F.sum("n")).first()[0] or 0
    largest = groups.orderBy(F.desc("n"), "class").limit(MAX_CLASSES).collect()
    names, documents = [r["class"] for r in largest], [r["n"] for r in largest]
    if everything > sum(documents) or not names:
        documents.append(everything - sum(documents))
    classes = len(documents)
    number = F.coalesce(*(F.when(F.col("t.class") == c, k) for k, c in enumerate(names)), F.lit(classes - 1))
    each = chunks.select("words", F.explode("train").alias("t")).select(F.element_at("words", F.col("t.at") + 1).alias("word"), number.alias("k"), F.col("t.n").alias("n"))
    words = each.groupBy("word").agg(F.sum("n").alias("n"), F.array(*(F.coalesce(F.sum(F.when(F.col("k") == k, F.col("n"))), F.lit(0)) for k in range(classes))).alias("own"))
    words = scratch.table(words, "words", "zstd")

    def met(*times: int):
        return [F.sum((F.col("own")[k] == t).cast("long") if t else (F.col("own")[k] > 0).cast("long")) for k in range(classes) for t in times]

    sums = words.agg(F.sum("n"), F.count("n"), *(F.sum(F.col("own")[k]) for k in range(classes)), *met(0, 1, 2)).first()
    all_words, distinct = sums[0] or 0, (sums[1] or 0) + (everything > 0)
    total = []
    for k, d in enumerate(documents):
        kinds_met = [x or 0 for x in sums[2 + classes + 3 * k : 5 + classes + 3 * k]]
        total.append(Totals((sums[2 + k] or 0) + d, d, *kinds_met))
    tokens = all_words + everything
    lattice = Lattice.of(vocabulary, piece_counts(words, vocabulary, classes), [t.words for t in total])
    spelled = np.log([t.spelled for t in total])
    models = [f"m{k}" for k in range(classes)]

    def spell(batches):
        for batch in batches:
            own = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, classes)
            with np.errstate(divide="ignore"):
                whole = np.log(np.maximum(own - [t.discount for t in total], 0) / [max(t.tokens, 1) for t in total])
            score = np.array(lattice.marginals(batch.column(0).to_pylist())).reshape(-1, classes)
            score = np.logaddexp(whole, spelled + score).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, score.T.copy())], names=["word", "n", *models])

    known = scratch.table(words.mapInArrow(spell, "word string, n long, " + ", ".join(f"{m} float" for m in models)), "known", "zstd")
    scratch.drop("words")
    wanted = chunks.select("chunk", F.posexplode("words").alias("at", "word"))
    met_here = wanted.join(known, "word", "left").select("chunk", "at", "n", F.when(F.col("n").isNull(), F.col("word")).alias("new"), *models)
    fact = np.dtype([("at", "<u4"), ("n", "<i8"), ("m", "<f4", (classes,))])

    def pack_facts(batches):
        held, size = [], 0

        def pack():
            table = pa.Table.from_batches(held).combine_chunks().sort_by([("chunk", "ascending"), ("at", "ascending")]).combine_chunks()
            chunk, at = table["chunk"].to_numpy(), table["at"].to_numpy()
            seen = table["n"].is_valid().to_numpy()
            every = np.zeros(len(chunk), fact)
            every["n"] = table["n"].fill_null(0).to_numpy()
            for k, m in enumerate(models):
                every["m"][:, k] = table[m].fill_null(0).to_numpy()
            starts = np.flatnonzero(np.diff(chunk, prepend=chunk[0] - 1)).tolist()
            rows = []
            for a, b in zip(starts, [*starts[1:], len(chunk)], strict=True):
                old, new = a + np.flatnonzero(seen[a:b]), a + np.flatnonzero(~seen[a:b])
                known_here = every[old]
                known_here["at"] = np.diff(at[old].astype(np.uint32), prepend=np.uint32(0))
                rows.append((chunk[a], len(old), squeeze(known_here), at[new], table["new"].take(pa.array(new)).to_pylist()))
            types = (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.string()))
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["chunk", "size", "known", "new_at", "new"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= HOLD_ROWS:
                yield pack()
                held, size = [], 0
        if held:
            yield pack()

    facts = met_here.mapInArrow(pack_facts, PACKED).groupBy("chunk").agg(F.collect_list(F.struct("size", "known", "new_at", "new")).alias("facts"))

    kinds = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}

    def score(batches):
        base_of = lambda c: np.log10((c + 1) / (tokens + distinct + 1))
        for batch in batches:
            for r in range(batch.num_rows):
                row = {n: batch.column(i)[r] for i, n in enumerate(batch.schema.names)}
                count, model = np.zeros(row["distinct"].as_py(), np.int64), np.zeros((row["distinct"].as_py(), classes))
                for part in row["facts"].as_py() or ():
                    found = expand(part["known"], part["size"], fact)
                    at = np.cumsum(found["at"], dtype=np.uint32)
                    count[at], model[at] = found["n"], found["m"]
                    if part["new"]:
                        model[part["new_at"]] = spelled + lattice.marginals(part["new"])
                sizes = row["sizes"].values.to_numpy()
                at = np.cumsum(expand(row["tokens"].as_py(), int(sizes.sum()), np.dtype("<u4")), dtype=np.uint32)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                add = lambda x: np.bincount(doc, x[at], len(sizes))  # noqa: B023, E731
                score = np.full(len(sizes), -np.inf)
                for k, t in enumerate(total):
                    text = add(model[:, k]) + math.log(t.end)
                    score = np.logaddexp(score, text + math.log(t.documents / everything if everything else 1.0))
                columns = [
                    row["ids"].values, row["held"].values, sizes + 1, add((count > 0).astype(float)) + (everything > 0),
                    np.full(len(sizes), tokens), add(base_of(count)) + base_of(everything), score / math.log(10),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))

    both = chunks.select("chunk", "ids", "held", "sizes", "distinct", "tokens").join(facts, "chunk", "left").drop("chunk")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return both.mapInArrow(score, schema)
