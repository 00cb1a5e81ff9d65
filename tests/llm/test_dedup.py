import hashlib
import random
import re

import numpy as np
from brute import DOCS, components, near_groups, odd_docs, some_docs, with_clashes

from veilframe.llm import embed, exact, lines, minhash
from veilframe.llm._shared import Scratch
from veilframe.llm._shared import components as spark_components


def exact_groups(docs):
    groups = {}
    for i, text, *_ in docs:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), i is None, i))
    out = []
    for i, text, *_ in docs:
        body = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        best = min(groups[body], key=lambda x: (x[0], x[1], x[2] or 0))
        out.append((i, best[2], len(groups[body]), i == best[2] and -len(text or "") == best[0], hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_matches_brute_force(spark):
    docs = some_docs(1) + [(1000 + k, f"pad {' ' * (k % 3)} ded", "en", "a", 1) for k in range(300)]
    found = exact.dedup_exact(spark.createDataFrame(docs, DOCS).repartition(7))
    assert sorted((tuple(r)[:5] for r in found.collect()), key=str) == exact_groups(docs)


def test_exact_odd_cases(spark):
    docs = odd_docs()
    found = exact.dedup_exact(with_clashes(spark.createDataFrame(docs, DOCS)))
    assert sorted((tuple(r)[:5] for r in found.collect()), key=str) == exact_groups(docs)
    assert exact.dedup_exact(spark.createDataFrame([], DOCS)).count() == 0


def minhash_rows(spark, docs, name):
    found = minhash.dedup_minhash(Scratch(spark, name), docs).collect()
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found}, found


def test_minhash_matches_brute_force(spark):
    docs = some_docs(2, 60)
    got, rows = minhash_rows(spark, spark.createDataFrame(docs, DOCS).repartition(5), "m1")
    assert got == near_groups([d[:2] for d in docs])
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_minhash_joins_what_a_bucket_pivot_leaves_open(spark):
    """Many texts share most of a passage, so buckets hold several components and blocks decide."""
    rng = random.Random(3)
    passage = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(120):
        own = list(passage)
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(120)] = f"u{rng.randrange(5000)}"
        docs.append((i, " ".join(own), "en", "a", 1))
    got, _ = minhash_rows(spark, spark.createDataFrame(docs, DOCS), "m2")
    assert got == near_groups([d[:2] for d in docs])


def test_minhash_odd_cases(spark):
    docs = odd_docs()
    got, rows = minhash_rows(spark, with_clashes(spark.createDataFrame(docs, DOCS)), "m3")
    assert len(rows) == len(docs)
    assert got.pop(None)[1] is None
    assert got == near_groups([d[:2] for d in docs if d[0] is not None])
    assert minhash_rows(spark, spark.createDataFrame([], DOCS), "m4")[1] == []


def test_minhash_of_one_id_with_different_texts(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six seven", "red green blue black white grey")
    docs = [(5, a, "en", "a", 1), (5, b, "en", "a", 1), (7, a, "en", "a", 1), (8, b, "en", "a", 1), (3, c, "en", "a", 1), (9, c + ".", "en", "a", 1)]
    found = minhash.dedup_minhash(Scratch(spark, "m5"), spark.createDataFrame(docs, DOCS)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in found) == [(3, 3), (5, 5), (5, 5), (7, 5), (8, 5), (9, 9)]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    b = np.concatenate([a[:3600], rng.integers(0, 2**63, 400, dtype=np.uint64)])
    low = [minhash.minima(np.unique(x)) & np.uint64(2**minhash.BITS - 1) for x in (a, b)]
    equal, chance = (low[0] == low[1]).mean(), 2.0**-minhash.BITS
    assert abs((equal - chance) / (1 - chance) - 3600 / 4400) < 0.15


def test_common_counts_are_exact():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200))) for _ in range(90)]
    want = [[len(np.intersect1d(x, y)) for y in sets] for x in sets]
    assert (minhash.common_counts(sets) == want).all()


def brute_vectors(rows, threshold=0.93):
    def usable(v, label):
        return label is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)

    good = [(i, label, np.array(v) / np.linalg.norm(v)) for i, label, v in rows if i is not None and usable(v, label)]
    links = [
        (a[0], b[0]) for k, a in enumerate(good) for b in good[k + 1 :]
        if a[1] == b[1] and len(a[2]) == len(b[2]) and a[2] @ b[2] >= threshold
    ]
    found = components([i for i, *_ in rows if i is not None], links)
    degree = {i: 0 for i in found}
    for pair in links:
        for x in pair:
            degree[x] += 1
    return {i: (degree[i], c, i == c) for i, c in found.items()}


VECTORS = "vec_id long, label int, embedding array<float>"


def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(500):
        v = rng.normal(size=64) if i % 3 or not rows else np.array(rows[rng.integers(len(rows))][2]) + rng.normal(size=64) * 0.3
        rows.append((i, int(rng.integers(3)) if i % 3 or not rows else rows[-1][1], np.float32(v).tolist()))
    rows += [(1000 + k, 1, rows[0][2]) for k in range(50)]
    found = embed.dedup_embeddings(Scratch(spark, "e1"), spark.createDataFrame(rows, VECTORS))
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in found.collect()} == brute_vectors(rows)


def test_several_cells_lose_no_link(spark, monkeypatch):
    """Vectors near a curved surface of two dimensions, whose links cross the borders of the cells."""
    monkeypatch.setattr(embed, "CELL_ROWS", 40)
    rng = np.random.default_rng(8)
    spread = rng.normal(size=(3, 16))
    rows = [(i, 0, np.float32(rng.normal(size=3) @ spread).tolist()) for i in range(600)]
    found = embed.dedup_embeddings(Scratch(spark, "e4"), spark.createDataFrame(rows, VECTORS), 0.985).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in found} == brute_vectors(rows, 0.985)
    found = embed.dedup_embeddings(Scratch(spark, "e5"), spark.createDataFrame(rows, VECTORS)).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in found} == brute_vectors(rows)


def test_cells_are_made_where_they_save_work(spark, monkeypatch):
    """Vectors without clusters would visit nearly all cells; those of clusters are told apart by them."""
    rng, slack = np.random.default_rng(9), np.sqrt(0.14)
    even = embed.unit(rng.normal(size=(4000, 64)))
    assert len(embed.fit(even, 500_000, 50_000, slack)) < 10
    spots = rng.normal(size=(40, 64))
    clusters = embed.unit(spots[rng.integers(40, size=4000)] + rng.normal(size=(4000, 64)) * 0.05)
    assert len(embed.fit(clusters, 500_000, 50_000, slack)) > 20
    monkeypatch.setattr(embed, "BLOCK_ROWS", 20)
    monkeypatch.setattr(embed, "CELL_ROWS", 30)
    monkeypatch.setattr(embed, "PRODUCTS", 50)
    monkeypatch.setattr(embed, "OUT_ROWS", 7)
    rows = [(i, i % 2, np.float32(v).tolist()) for i, v in enumerate(np.r_[clusters[:400], even[:100]])]
    found = embed.dedup_embeddings(Scratch(spark, "e6"), spark.createDataFrame(rows, VECTORS)).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in found} == brute_vectors(rows)


def test_embeddings_odd_cases(spark):
    rows = [
        (1, 0, [1.0, 0.0]), (2, 0, [2.0, 0.0]), (3, None, [1.0, 0.0]), (4, 0, None), (5, 0, [0.0, 0.0]), (6, 0, [1.0, None]),
        (7, 0, [float("nan"), 1.0]), (8, 0, [float("inf"), 1.0]), (9, 0, [1.0, 0.0, 0.0]), (10, 0, []), (11, 1, [1.0, 0.0]),
    ]
    docs = with_clashes(spark.createDataFrame([*rows, (None, 0, [1.0, 0.0])], VECTORS))
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embed.dedup_embeddings(Scratch(spark, "e2"), docs).collect()}
    assert found.pop(None)[:2] == (0, None)
    assert found == brute_vectors(rows)
    assert embed.dedup_embeddings(Scratch(spark, "e3"), spark.createDataFrame([], VECTORS)).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return row[-1]


def brute_lines(docs, similarity=0.8):
    """{(doc_id, line)} that go."""
    seen = [(i, n, normal) for i, t, *_ in docs for n, normal in enumerate(map(lines.normalise, (t or "").split("\n"))) if normal.count(" ") >= 4]
    normals = sorted({x for *_, x in seen})
    links = [
        (a, b) for k, a in enumerate(normals) for b in normals[k + 1 :]
        if edit_distance(a, b) <= (1 - similarity) * max(len(a), len(b)) + 1e-9
    ]
    group = components(normals, links)
    first = {}
    for i, n, x in sorted(seen, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        first.setdefault(group[x], (i, n))
    return {(i, n) for i, n, x in seen if first[group[x]] != (i, n)}


def test_lines_match_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "klmnp"]
    known = [" ".join(rng.choices(vocabulary, k=40)) for _ in range(15)]
    docs = []
    for i in range(50):
        own = []
        for _ in range(4):
            line = rng.choice(known)
            own.append(rng.choice([line, line.upper() + "!", line[:-1] + "z", " ".join(rng.choices(vocabulary, k=20)), "short line"]))
        docs.append((i, "\n".join(own), "en", "a", 1))
    gone = lines.repeated_lines(Scratch(spark, "l1"), spark.createDataFrame(docs, DOCS))
    assert {(r["doc_id"], r["line"]) for r in gone.collect()} == brute_lines(docs)


def test_lines_odd_cases(spark):
    docs = odd_docs() + [(20, "a line of six whole words\nown", "en", "a", 1), (21, "A line of SIX whole words\n\nother", "en", "a", 1)]
    rows = lines.dedup_lines(Scratch(spark, "l2"), with_clashes(spark.createDataFrame(docs, DOCS))).collect()
    assert len(rows) == len(docs)
    found = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in rows}
    assert found[20] == ("a line of six whole words\nown", 2, 0)
    assert found[21] == ("\nother", 3, 1)
    assert found[1] == ("", 1, 0)
    assert lines.dedup_lines(Scratch(spark, "l3"), spark.createDataFrame([], DOCS)).count() == 0


def test_edits_and_profiles():
    rng = random.Random(10)
    pairs = [["".join(rng.choices("abc", k=rng.randint(0, 30))) for _ in "ab"] for _ in range(200)]
    for a, b in pairs:
        want = edit_distance(a, b)
        assert lines.edits(a, b, 30) == want
        assert lines.edits("same " + a + " end", "same " + b + " end", 30) <= want
        assert (lines.edits(a, b, 9) == want) if want <= 9 else (lines.edits(a, b, 9) > 9)
        x, y = lines.profiles([a + "ab", b + "ab"])
        assert abs(x - y).sum() <= 4 * edit_distance(a, b)


def share_found(pairs):
    """Share of the pairs of lines that have a band in common and pass the SimHash screen."""
    flat = [x for p in pairs for x in p]
    keys, marks = lines.signatures(flat, 0.8)
    close = [bin((int(marks[k]) ^ int(marks[k + 1])) & (1 << 64) - 1).count("1") <= lines.DISTANCE
             or (len(flat[k]) >= lines.LONG_LINE) != (len(flat[k + 1]) >= lines.LONG_LINE) for k in range(0, len(keys), 2)]
    return sum(c and bool(set(keys[2 * k]) & set(keys[2 * k + 1])) for k, c in enumerate(close)) / len(pairs)


def test_recall_of_candidates():
    """README states these shares; the pairs have an edit similarity of 0.8 or more."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9)))

    def pairs(low, high, change):
        out = []
        while len(out) < 400:
            own = [word() for _ in range(rng.randint(low, high))]
            a, b = " ".join(own), change(own)
            if edit_distance(a, b) <= 0.2 * max(len(a), len(b)):
                out.append((a, b))
        return out

    def letters(share):
        def change(own):
            text = list(" ".join(own))
            for at in rng.sample(range(len(text)), max(1, int(share * len(text)))):
                text[at] = rng.choice("abcdefghijklmnopqrstuvwxyz")
            return "".join(text)

        return change

    def other_words(n):
        def change(own):
            new = list(own)
            at = rng.randrange(len(own) - n + 1)
            new[at : at + n] = [word() for _ in range(n)]
            return " ".join(new)

        return change

    found = {
        "one letter": share_found(pairs(2, 30, letters(0))), "one word": share_found(pairs(6, 30, other_words(1))),
        "three words together": share_found(pairs(15, 30, other_words(3))), "letters, 4 %": share_found(pairs(5, 30, letters(0.04))),
        "letters, 8 %": share_found(pairs(5, 30, letters(0.08))),
    }
    print(found)
    assert found["one letter"] >= 0.98 and found["one word"] >= 0.95 and found["three words together"] >= 0.9
    assert found["letters, 4 %"] >= 0.85


def test_changed_lines_are_found_by_edit_similarity_alone(spark):
    """Lines of 5 to 30 words with one changed letter, and of ten and more with one other word."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 8)))
    docs, want = [], 0
    for i in range(120):
        own = [word() for _ in range(rng.randint(5, 30))]
        new = list(own)
        at = rng.randrange(len(own))
        new[at] = word() if i % 2 and len(own) >= 10 else "z" + own[at][1:]
        docs += [(2 * i, " ".join(own), "en", "a", 1), (2 * i + 1, " ".join(new), "en", "a", 1)]
        a, b = docs[-2][1], docs[-1][1]
        want += edit_distance(a, b) <= 0.2 * max(len(a), len(b))
    found = lines.dedup_lines(Scratch(spark, "l4"), spark.createDataFrame(docs, DOCS)).collect()
    assert want > 110 and sum(r["n_removed"] for r in found) >= 0.97 * want
    assert not any(r["n_removed"] for r in found if r["doc_id"] % 2 == 0)


def test_short_lines_and_rows_of_one_id(spark):
    """Equal lines of any length and script go once; rows with a null or repeated id lose lines of their own only."""
    docs = [
        (1, "Home\nown one\n\n--", "en", "a", 1), (2, "home!\n\n--\n版权所有不得转载本站内容", "ja", "a", 1), (3, "版权所有不得转载本站内容。\nHome", "ja", "a", 1),
        (4, "zero here\nHome", "en", "a", 1), (4, "kept\nunique text", "en", "a", 1),
        (None, "Home\nfirst null", "en", "a", 1), (None, "second null\nfirst null", "en", "a", 1),
    ]
    docs = spark.createDataFrame(docs, DOCS).coalesce(1)
    found = sorted((r["doc_id"] or 9, r["text"]) for r in lines.dedup_lines(Scratch(spark, "l5"), docs).collect())
    assert found == [
        (1, "Home\nown one\n\n--"), (2, "\n--\n版权所有不得转载本站内容"), (3, ""), (4, "kept\nunique text"), (4, "zero here"),
        (9, "first null"), (9, "second null"),
    ]


def test_short_lines_lose_no_link(spark):
    """Lines of few characters against the plain distance of all pairs."""
    rng = random.Random(12)
    own = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 13))) for _ in range(150)} | {"subscribe", "subscribes", "subscrybez"}
    own = sorted(own)
    links = [(a, b) for k, a in enumerate(own) for b in own[k + 1 :] if max(len(a), len(b)) * 0.8 < lines.MIN_CHARS and edit_distance(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9]
    keys = {x: set(lines.short_keys(x, 0.8)) for x in own}
    assert links and all(keys[a] & keys[b] for a, b in links)
    docs = [(1, "subscribe\nshare", "en", "a", 1), (2, "Subscribes\nshared\nsharp\nab", "en", "a", 1), (3, "subscrybe\nac\n1 x", "en", "a", 1)]
    found = {r["doc_id"]: r["text"] for r in lines.dedup_lines(Scratch(spark, "l6"), spark.createDataFrame(docs, DOCS)).collect()}
    assert found == {1: "subscribe\nshare", 2: "ab", 3: "ac\n1 x"}


def test_quick_look_never_says_too_few(spark):
    rng = random.Random(13)
    for _ in range(300):
        a = "".join(rng.choice("abcde ") for _ in range(rng.randint(1, 200)))
        b = list(a)
        for _ in range(rng.randint(0, 30)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randint(0, 2)] = rng.choices("xyz", k=rng.randint(0, 2))
        b, n = "".join(b), rng.randint(0, 40)
        real = edit_distance(a, b)
        assert edit_distance(*lines.core(a, b)) == real
        assert lines.at_most(a, b, n) > n or real <= n
    assert lines.at_most("x" * 500 + "a" + "y" * 500, "x" * 500 + "b" + "y" * 500, 5) <= 5


def test_lines_of_many_texts_are_normalised_alike():
    rng = random.Random(14)
    texts = ["", "\n", "ΑΣ\nΣ x", "İstanbul 12a3_b", "  . \n\n..a  b..", "\x0b٣ 1٣\r\nÄ-2", "𝔘 𐐀 7", *(t or "" for _, t, *_ in odd_docs()[:3])]
    texts += ["".join(rng.choices("aB1 _.\nß٣", k=50)) for _ in range(50)]
    for some in (texts, texts[:6], [""]):
        assert lines.normal_lines(some) == [lines.normalise(x) for t in some for x in t.split("\n")]


def test_many_pairs_at_once_are_decided_by_their_distance(monkeypatch):
    rng = random.Random(15)
    pairs = [("", "", 0), ("", "abc", 3), ("a" * 70, "a" * 70 + "b", 0), ("𐐀b", "b", 1), ("x" * 3000, "y" * 3000, 600)]
    for _ in range(300):
        a = "".join(rng.choices("abcé", k=rng.randint(1, 90)))
        b = "".join(x for x in a if rng.random() > 0.15) + "".join(rng.choices("xy", k=rng.randint(0, 9)))
        pairs.append((a, b, rng.randint(0, 40)))
    want = [edit_distance(a, b) <= n if len(a) < 3000 else False for a, b, n in pairs]
    first, second, most = (list(x) for x in zip(*pairs, strict=True))
    assert 50 < sum(want) < 250 and lines.within(first, second, most).tolist() == want
    monkeypatch.setattr(lines, "CELLS", 1)
    assert lines.within(first, second, most).tolist() == want


def test_buckets_across_batches(spark):
    rows = [(k, n) for k in range(1, 40) for n in range(k % 5)] * 3
    members = spark.createDataFrame(rows, "key long, node long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        found = lines.buckets(members).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len({r["pivot"] for r in found if r["key"] == 4}) == 1
    assert sorted((r["key"], n) for r in found for n in {r["node"], r["pivot"]}) == sorted(
        (k, n) for k in range(1, 40) if k % 5 > 1 for n in range(k % 5) for _ in range(k % 5 - 1 if n == next(r["pivot"] for r in found if r["key"] == k) else 1)
    )


def test_components_of_a_long_chain(spark):
    edges = spark.range(1, 400).selectExpr("id AS a", "id + 1 AS b").union(spark.sql("SELECT 1000L AS a, 900L AS b"))
    found = {r["node"]: r["component"] for r in spark_components(Scratch(spark, "c1"), edges, "chain").collect()}
    assert found == {i: 1 for i in range(1, 401)} | {900: 900, 1000: 900}
