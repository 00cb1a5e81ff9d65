import hashlib
from collections import Counter

import corpus_pipeline
import public_tokenizers
import tiktoken
from brute import DOCS, near_groups, odd_docs, with_clashes
from test_dedup import exact_groups
from test_models import brute_mix

from veilframe.llm import bpe, mixing, quality
from veilframe.llm._shared import Scratch
from veilframe.llm.queries import BYTE_RANKS, LANGUAGES, QUALITY


def stages(spark, docs, sf_dir, folder):
    """What goes into each stage and what comes out, written and read again."""
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}")
        after = spark.read.parquet(f"{folder}/{k}")
        yield docs, after
        docs = after


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_match_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    (a, b), (_, c), (_, d), (_, e), (_, f) = stages(spark, docs, sf_dir, tmp_path)
    assert all(x.columns == docs.columns for x in (b, c, d, e))
    assert ids(b) == sorted(r["doc_id"] for r in quality.classify(a, threshold=QUALITY).collect() if r["kept"])
    texts = [(r["doc_id"], r["text"]) for r in b.collect()]
    assert ids(c) == sorted(r[0] for r in exact_groups(texts) if r[3])
    near = near_groups([(r["doc_id"], r["text"]) for r in c.collect()])
    assert ids(d) == sorted(i for i, (_, component) in near.items() if i == component)

    described = [((r["source"], r["lang"], r["topic"]), r["tokens"], r["doc_id"]) for r in mixing.describe(d).collect()]
    by = [Counter(), Counter(), Counter()]
    for cell, n, _ in described:
        for k in range(3):
            by[k][cell[k]] += n
    root = {k: n**0.5 for k, n in by[0].items() if n}
    shares = [{k: x / sum(root.values()) for k, x in root.items()}, LANGUAGES, {k: n / by[2].total() for k, n in by[2].items()}]
    probability = brute_mix([x[:2] for x in described], shares, corpus_pipeline.MIX_BUDGET)
    draw = lambda i: int(hashlib.sha256(f"mix:{i}".encode()).hexdigest()[:13], 16) / 2**52
    assert ids(e) == sorted(i for cell, n, i in described if n and draw(i) < probability[cell])

    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(BYTE_RANKS)), special_tokens={})
    want = {r["doc_id"]: len(encoding.encode_ordinary(r["text"] or "")) for r in e.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in f.collect()} == want


def test_stages_bear_odd_rows(spark, sf_dir):
    docs = with_clashes(spark.createDataFrame(odd_docs(), DOCS))
    kept = Scratch(spark, "odd").table(docs, "docs")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, sf_dir)
        assert out.columns == docs.columns or stage is corpus_pipeline.STAGES[-1][1]
        assert out.count() <= docs.count()


def test_stages_bear_an_empty_table(spark, sf_dir):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_decisions_hold_for_null_and_repeated_ids(spark, sf_dir):
    """Each row stays or goes by its own decision; one of identical rows stays."""
    texts = lambda df: sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in df.collect())
    prose = " ".join(f"word{i}" for i in range(60))
    rows = [
        (None, "same text", "en", "a", 1), (None, "same  text", "en", "a", 1), (1, "same\ntext", "en", "a", 1),
        (2, "twice under one", "en", "a", 1), (2, "twice under  one", "en", "a", 1),
        (3, "identical row", "en", "a", 1), (3, "identical row", "en", "a", 1),
        (4, prose, "en", "a", 1), (None, prose + " end", "en", "a", 1), (None, prose + " end", "en", "a", 1),
        (5, prose + " other", "en", "a", 1), (5, "a text of its own", "en", "a", 1), (None, "also of its own", "en", "a", 1),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    own = [(False, 5, "a text of its own"), (True, 0, "also of its own")]
    found = texts(corpus_pipeline.drop_exact_copies(spark, docs, sf_dir))
    assert [x for x in found if prose not in x[2]] == [(False, 2, "twice under  one"), (False, 3, "identical row"), own[0], own[1], (True, 0, "same  text")]
    assert [x for x in found if prose in x[2]] == [(False, 4, prose), (False, 5, prose + " other"), (True, 0, prose + " end")]

    found = texts(corpus_pipeline.drop_near_copies(spark, docs, sf_dir))
    assert [x for x in found if prose in x[2]] == [(False, 4, prose)]
    assert [x for x in found if "own" in x[2]] == own and found.count((False, 3, "identical row")) == 1

    poor = [(None, None, "en", "a", 0), (7, "", "en", "a", 0), (7, (prose + ". ") * 3, "en", "a", 1)]
    docs = spark.createDataFrame([*poor, *rows], DOCS)
    model = quality.fit(docs)
    want = [r["kept"] for r in quality.classify(docs.coalesce(1), model, QUALITY).collect()]
    left = texts(corpus_pipeline.reject_low_quality(spark, docs, sf_dir))
    assert left == sorted((i is None, i or 0, t) for (i, t, *_), k in zip([*poor, *rows], want, strict=True) if k)

    left = texts(corpus_pipeline.mix_sources(spark, docs, sf_dir))
    assert (True, 0, None) not in left and (False, 7, "") not in left
