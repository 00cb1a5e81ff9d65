"""Near-duplicate documents by b-bit MinHash."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm._shared import Scratch, block_pairs, components, forest, map_groups, pivot_links, slices
from veilframe.llm._words import hashed_words, mix, shingles

WIDTH = 5
#: 25 bands of 5 minima: a pair with similarity 0.85 meets in none of them once in two million pairs.
BANDS, ROWS = 25, 5
#: Minima of which low bits are kept, and how many bits; 128 nibbles make eight longs.
MINIMA, BITS = 128, 4
LONGS = MINIMA * BITS // 64
#: How far below the threshold the estimate may lie: five standard deviations of it.
MARGIN = 0.165
#: Members of a bucket or cluster in a block, shingles that a product takes at once, and how many
#: members have a shingle at most for which its pairs are counted one by one instead.
BLOCK_ROWS, PRODUCT_COLUMNS, FEW = 512, 4096, 64
#: The sketch multiplies each shingle by these.
_FACTORS = np.random.default_rng(5).integers(1, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CHUNK = 1 << 11


def minima(sets: np.ndarray) -> np.ndarray:
    """The smallest of each of the MINIMA hashes of a set of 64-bit shingles."""
    out = np.full(MINIMA, np.iinfo(np.uint64).max)
    for k in range(0, len(sets), _CHUNK):
        np.minimum(out, mix(np.multiply.outer(_FACTORS, sets[k : k + _CHUNK])).min(1), out=out)
    return out


def bands(least: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of minima."""
    rows = least[: BANDS * ROWS].reshape(BANDS, ROWS)
    key = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for k in range(ROWS):
        key = mix(key * np.uint64(0x2545F4914F6CDD1D) + rows[:, k])
    return key


def packed(least: np.ndarray) -> np.ndarray:
    """The low bits of the minima, sixteen to a long."""
    low = (least & np.uint64(2**BITS - 1)).reshape(LONGS, 64 // BITS)
    return (low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(1, dtype=np.uint64)


def estimate(a: list[Column], b: list[Column]) -> Column:
    """Similarity estimated from two packed signatures.

    A nibble differs if any bit of it does; equal nibbles also occur by chance, for which the share of
    equal ones is corrected.
    """
    differ = F.lit(0)
    for x, y in zip(a, b, strict=True):
        d = x.bitwiseXOR(y)
        for shift in range(1, BITS):
            d = d.bitwiseOR(F.shiftrightunsigned(x.bitwiseXOR(y), shift))
        differ = differ + F.bit_count(d.bitwiseAND(F.lit(0x1111111111111111)))
    chance = 2.0**-BITS
    return ((1 - differ / MINIMA) - chance) / (1 - chance)


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n_shingles, digest, node, bands, s0..s7`` of whole texts; the digest names the whole set of shingles."""
    names = [f"s{i}" for i in range(LONGS)]

    def run(batches):
        for batch in slices(batches):
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            size, digest, node, keys, signs = [], [], [], [], []
            for words in hashed_words(texts):
                found = shingles(words, WIDTH)
                size.append(len(found))
                digest.append(set_digest(found) if len(found) else None)
                node.append(node_of(digest[-1]) if len(found) else None)
                least = minima(found)
                keys.append(bands(least).view(np.int64) if len(found) else [])
                signs.append(packed(least).view(np.int64))
            signs = np.array(signs, np.int64).reshape(-1, LONGS)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(node, pa.int64()), pa.array(keys, pa.list_(pa.int64())), *map(pa.array, signs.T.copy())],
                names=["doc_id", "n_shingles", "digest", "node", "bands", *names],
            )

    schema = "doc_id long, n_shingles long, digest binary, node long, bands array<long>, " + ", ".join(f"{x} long" for x in names)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, schema)


def set_digest(found: np.ndarray) -> bytes:
    """The name of a set of shingles."""
    return xxhash.xxh3_128_digest(found.tobytes())


def node_of(digest: bytes) -> int:
    """The node that stands for a set in the graph of links."""
    return int.from_bytes(digest[:8], "big", signed=True)


def full_sets(texts: DataFrame) -> DataFrame:
    """``node, shingles``: the distinct shingles of whole ``text`` as 64-bit hashes."""

    def run(batches):
        for batch in slices(batches):
            found = [s for w in hashed_words(batch.column(0).to_pylist()) if len(s := shingles(w, WIDTH))]
            nodes = pa.array([node_of(set_digest(s)) for s in found], pa.int64())
            yield pa.RecordBatch.from_arrays([nodes, pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], names=["node", "shingles"])

    return texts.select("text").mapInArrow(run, "node long, shingles array<long>")


def nibbles(batch: pa.RecordBatch) -> np.ndarray:
    """The low bits of the minima of each row, one to a byte."""
    longs = np.stack([batch.column(f"s{k}").to_numpy() for k in range(LONGS)], 1)
    raw = np.ascontiguousarray(longs).view(np.uint8).reshape(batch.num_rows, -1)
    return np.concatenate([raw & 15, raw >> 4], 1)


def screen(batch: pa.RecordBatch, percent: int) -> pa.RecordBatch | None:
    """Members of a bucket in different components that could be linked by sizes and estimates, as edges of a forest."""
    node, root, size, low = (*(batch.column(x).to_numpy() for x in ("node", "root", "n_shingles")), nibbles(batch))
    least = (percent / 100 - MARGIN) * (1 - 2.0**-BITS) + 2.0**-BITS
    edges, parent = [], {}
    step = max(1, (1 << 22) // (len(root) * MINIMA))
    for k in range(0, len(root), step):
        part = slice(k, k + step)
        near = (low[part, None] == low[None]).sum(2) >= least * MINIMA
        near &= root[part, None] != root[None]
        near &= 100 * np.minimum(size[part, None], size[None]) >= percent * np.maximum(size[part, None], size[None])
        edges += forest(near, node[part], node, parent)
    return as_edges(edges)


def as_edges(edges: list[tuple[int, int]]) -> pa.RecordBatch | None:
    return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"]) if edges else None


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets.

    Shingles of few sets add one to each of their pairs; those of many sets go into matrix products.
    """
    n = len(sets)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    owner = np.repeat(np.arange(n), [len(x) for x in sets])[order]
    _, first, times = np.unique(flat[order], return_index=True, return_counts=True)
    total = np.zeros(n * n)
    for d in np.unique(times[(times > 1) & (times <= FEW)]).tolist():
        at = first[times == d]
        for k in range(0, len(at), step := max(1, (1 << 22) // (d * d))):
            own = owner[at[k : k + step, None] + np.arange(d)]
            total += np.bincount((own[:, :, None] * n + own[:, None, :]).ravel(), minlength=n * n)
    total = total.reshape(n, n)
    many = np.flatnonzero(times > FEW)
    for k in range(0, len(many), PRODUCT_COLUMNS):
        columns = many[k : k + PRODUCT_COLUMNS]
        part = np.zeros((n, len(columns)), np.float32)
        for c, i in enumerate(columns):
            part[owner[first[i] : first[i] + times[i]], c] = 1
        total += part @ part.T
    return total


def join_components(batch: pa.RecordBatch, percent: int) -> pa.RecordBatch | None:
    """Links between different components in a cluster, as edges of a forest; full sets decide."""
    sets = [x.values.to_numpy() for x in batch.column("shingles")]
    node, root, size = batch.column("node").to_numpy(), batch.column("root").to_numpy(), np.array([len(x) for x in sets])
    both = common_counts(sets)
    links = (100 * both >= percent * (size[:, None] + size[None] - both)) & (root[:, None] != root[None])
    return as_edges(forest(links, node, node))


def dedup_minhash(
    scratch: Scratch, docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Groups of documents that links of at least ``percent`` Jaccard similarity join.

    Lower-cased (A-Z) words; a text's set has its distinct runs of five words, or the whole of fewer
    words. Texts with one and the same set are put together before any comparing. Band keys over the
    minima propose pairs, sizes and packed low bits drop those that can't reach the threshold, the full
    sets decide. Returns one row per input row: ``doc_id, n_shingles, component_id, kept``.

    Null text counts as empty; a text without words has an empty set and links with nothing. A null id
    is never linked and is its own component (null). Rows that repeat an id are linked by what each of
    them says; two of them may lie in different components. Sets are told apart by a 128-bit digest, half
    of which names them among the links. Other columns are ignored; an empty table gives no rows.
    """
    signs = [f"s{i}" for i in range(LONGS)]
    sketch = scratch.table(sketches(docs, id_col, text_col), "sketches")
    # One representative for each set; the group of a set may be any share of all rows.
    sets = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("digest", "node")
    firsts = scratch.table(sets.agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")), "firsts")
    reps = sketch.join(firsts.select("digest", "first"), "digest").where("doc_id = first")
    reps = scratch.table(reps.dropDuplicates(["digest"]).select("doc_id", "node", "n_shingles", "bands", *signs), "reps")
    members = reps.select(F.explode("bands").alias("key"), "node")
    facts = reps.select("node", "n_shingles", *signs)
    side = lambda n: facts.select(F.col("node").alias(n), F.col("n_shingles").alias(f"n{n}"), *(F.col(x).alias(f"{n}{x}") for x in signs))

    def chosen(nodes: DataFrame, name: str) -> DataFrame:
        """The sets of these nodes, each read from the documents of its smallest id."""
        # Written, so that Spark knows its size before it decides how texts meet it.
        ids = scratch.table(reps.select("node", F.col("doc_id").alias("id")).join(nodes, "node", "left_semi").select("id").distinct(), f"{name}-ids")
        texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(ids, "id", "left_semi")
        return scratch.table(full_sets(texts).join(nodes, "node", "left_semi").dropDuplicates(["node"]), name)

    def confirm(pairs: DataFrame) -> DataFrame:
        near = pairs.join(side("a"), "a").join(side("b"), "b")
        near = near.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        guess = estimate([F.col(f"a{x}") for x in signs], [F.col(f"b{x}") for x in signs])
        near = scratch.table(near.where(guess >= percent / 100 - MARGIN).select("a", "b", "na", "nb"), "near")
        wanted = scratch.table(near.select(F.col("a").alias("node")).union(near.select(F.col("b").alias("node"))).distinct(), "wanted")
        full = chosen(wanted, "full")
        left, right = (full.select(F.col("node").alias(n), F.col("shingles").alias(f"set_{n}")) for n in "ab")
        common = F.size(F.array_intersect("set_a", "set_b"))
        both = near.join(left, "a").join(right, "b").withColumn("common", common)
        return both.where(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")

    found, rest = pivot_links(scratch, members, confirm, "links")
    # Buckets that hold several components still: what estimates can't tell apart there forms clusters,
    # and each cluster's members are compared by their full sets in blocks. No pairs leave a task.
    roots = scratch.table(rest.select("node", "root").distinct(), "roots")
    rest = scratch.table(rest.join(facts, "node"), "open")
    maybe = map_groups(block_pairs(scratch, rest, ["key"], "node", BLOCK_ROWS, "open"), ["key", "i", "j"], lambda x: screen(x, percent), "a long, b long")
    close = components(scratch, scratch.table(maybe, "maybe"), "maybe").withColumnRenamed("component", "cluster").join(roots, "node")
    close = block_pairs(scratch, scratch.table(close, "close"), ["cluster"], "node", BLOCK_ROWS, "close")
    sets = chosen(scratch.table(close.select("node").distinct(), "close-ids"), "close-sets")
    close = close.select("cluster", "i", "j", "node", "root").join(sets, "node").select("node", "cluster", "i", "j", "root", "shingles")
    more = map_groups(close, ["cluster", "i", "j"], lambda x: join_components(x, percent), "a long, b long")
    more = scratch.table(more, "more")
    scratch.drop("open", "maybe", "close", "close-ids", "close-sets", "near", "wanted", "full")
    groups = scratch.table(components(scratch, found.union(more), "all"), "components")
    # Sets first, then documents: a hot set is one row on one side and only its documents on the other.
    linked = firsts.join(groups.withColumnRenamed("component", "group"), "node")
    least = scratch.table(linked.groupBy("group").agg(F.min("first").alias("component")), "least")
    linked = groups.withColumnRenamed("component", "group").join(least, "group").select("node", "component")
    by_set = firsts.join(linked, "node", "left")
    by_set = scratch.table(by_set.select("digest", F.coalesce("component", "first").alias("component")), "by-set")
    out = sketch.select("doc_id", "n_shingles", "digest").join(by_set, "digest", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
