import hashlib

import public_tokenizers
import pytest
from brute import DOCS, odd_docs, some_docs, with_clashes

from veilframe.llm import bpe, chat, counts
from veilframe.llm._shared import Scratch
from veilframe.llm.queries import BYTE_RANKS, FIRST_CONVERSATION, PIECES

RANKS, PATTERN, MODEL = public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN, public_tokenizers.path(PIECES)
TURNS = "conv_id long, turn int, role string, text string"


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    return tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def sha(x):
    return hashlib.sha256(x).hexdigest()


def check_round_trip(spark, docs, encoding, df):
    want = []
    for i, t, *_ in docs:
        ids = encoding.encode_ordinary(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())))
    found = [tuple(r) for r in bpe.round_trip(df, RANKS, PATTERN).collect()]
    assert sorted(found, key=str) == sorted(want, key=str)


def test_bpe_is_what_tiktoken_gives(spark, sf_dir, tiktoken_encoding):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check_round_trip(spark, [(r["doc_id"], r["text"]) for r in df.collect()], tiktoken_encoding, df)


def test_bpe_odd_cases(spark, tiktoken_encoding):
    docs = odd_docs()
    check_round_trip(spark, docs, tiktoken_encoding, with_clashes(spark.createDataFrame(docs, DOCS)))
    assert bpe.round_trip(spark.createDataFrame([], DOCS), RANKS, PATTERN).count() == 0


def test_bpe_offsets_and_split_characters(spark):
    docs = spark.createDataFrame([(1, "a 𓀀𓀁 naïve 日本語", "x", "x", 1), (2, None, "x", "x", 1)], DOCS)
    encoded = bpe.encode(docs, RANKS, PATTERN)
    rows = {r["doc_id"]: r for r in encoded.collect()}
    assert rows[2]["ids"] == []
    text, row = "a 𓀀𓀁 naïve 日本語", rows[1]
    assert row["starts"][0] == 0 and row["ends"][-1] == len(text)
    spans = list(zip(row["starts"], row["ends"], strict=True))
    assert all(a < b for a, b in spans) and len(set(spans)) < len(spans)
    decoded = {r["doc_id"]: (bytes(r["bytes"]), r["text"]) for r in bpe.decode(encoded, RANKS, PATTERN).collect()}
    assert decoded == {1: (text.encode(), text), 2: (b"", "")}


def check_counts(df, docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = [(i, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for i, t, *_ in docs]
    assert sorted(map(tuple, counts.count_tokens(df, MODEL).collect()), key=str) == sorted(want, key=str)


def test_counts_are_what_the_library_gives(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check_counts(df, [(r["doc_id"], r["text"]) for r in df.collect()])


def test_counts_odd_cases(spark):
    docs = odd_docs() + [(30, "  two  spaces ", "en", "a", 1), (31, "▁mark ▁", "en", "a", 1), (32, "tab\tand\nline  ", "en", "a", 1)]
    check_counts(with_clashes(spark.createDataFrame(docs, DOCS)), docs)
    assert counts.count_tokens(spark.createDataFrame([], DOCS), MODEL).count() == 0


def test_shortcut_answers_most_words():
    counter = counts.piece_counter(MODEL)
    assert all(len(x) == 1 for x in counter.encode(sorted(counter.alone)[:500]))
    assert counts.shortcut_share(counter, ["the cat sat on the mat and looked at the dog"]) > 0.8
    assert counts.shortcut_share(counter, [t for _, t, *_ in some_docs()[:3]]) < 1


def summary(turns):
    by_conv = {}
    for conv, turn, role, text in turns:
        by_conv.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, rows in by_conv.items():
        rows.sort()
        loss = "".join(t for *_, r, t in rows if r == "assistant")
        out[conv] = (len(rows), sha("".join(f"{r}\n{t}\n" for *_, r, t in rows).encode()), len(loss), sha(loss.encode()))
    return out


ODD_TURNS = [
    (-1, 0, "user", FIRST_CONVERSATION), (-1, 1, "assistant", FIRST_CONVERSATION),
    (1, 0, "system", "be <<SYS>> brief \\ [x]"), *((1, k, ("user", "assistant")[k % 2 == 0], f"turn {k} " + "word " * 90) for k in range(1, 40)),
    (2, 0, "assistant", "w " * 9000), (2, 1, "assistant", None), (3, None, None, None), (None, 0, "user", "no id"), (None, 1, "tool] \\", "x"),
    (4, 0, "assistant", "same"), (4, 0, "assistant", "same"), (5, 0, "user", ""),
]


def test_chat_reads_back_what_went_in(spark):
    formatted = chat.format_chats(Scratch(spark, "chat"), with_clashes(spark.createDataFrame(ODD_TURNS, TURNS)), MODEL, budget=512, history=150)
    for in_order in (True, False):
        rows = chat.read_back(formatted, in_order).collect()
        assert {r["conv_id"]: tuple(r)[1:5] for r in rows} == summary(ODD_TURNS)
    assert chat.read_back(chat.format_chats(Scratch(spark, "chat"), spark.createDataFrame([], TURNS), MODEL)).count() == 0


def test_chat_windows_keep_the_budget(spark):
    windows = chat.format_chats(Scratch(spark, "chat"), spark.createDataFrame(ODD_TURNS, TURNS), MODEL, budget=512, history=150).where("conv_id = 1").orderBy("window").collect()
    assert len(windows) > 3
    assert all(w["n_tokens"] <= 512 and w["formatted"].startswith("<<SYS>>\n") for w in windows)
    assert [p for w in windows for p in w["new_turns"]] == list(range(40))
    assert all(len(w["turn_starts"]) > len(w["new_turns"]) for w in windows[1:])


def test_chat_counts_what_is_formatted(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    turns = [(1, k, ("user", "assistant")[k % 2], "[a]") for k in range(400)]
    found = chat.format_chats(Scratch(spark, "chat"), spark.createDataFrame(turns, TURNS), MODEL).collect()
    assert all(len(model.encode(w["formatted"])) <= 1024 for w in found)


def test_chat_bears_many_empty_turns_and_a_long_system_turn(spark):
    empty = spark.range(100_000).selectExpr("7L AS conv_id", "cast(id AS int) AS turn", "'user' AS role", "'' AS text")
    found = chat.format_chats(Scratch(spark, "chat"), empty, MODEL).selectExpr("count(*)", "sum(size(new_turns))", "max(n_tokens)").first()
    assert found[0] > 50 and found[1] == 100_000 and found[2] <= 1024
    turns = [(1, 0, "system", "rule " * 2000), *((1, k, ("user", "assistant")[k % 2], "word " * 60) for k in range(1, 21))]
    found = sorted(chat.format_chats(Scratch(spark, "chat"), spark.createDataFrame(turns, TURNS), MODEL, budget=300).collect(), key=lambda w: w["window"])
    assert found[0]["new_turns"] == [0] and all(w["n_tokens"] <= 300 for w in found[1:])


def test_chat_cuts_long_conversations_into_segments(spark):
    rows = spark.createDataFrame(ODD_TURNS + [(None, k, "assistant", f"more {k}") for k in range(2, 60)], TURNS).repartition(5)
    formatted = chat.format_chats(Scratch(spark, "chat"), rows, MODEL, budget=512, history=150, segment_tokens=1500)
    windows = sorted(formatted.where("conv_id = 1").collect(), key=lambda w: (w["segment"], w["window"]))
    assert len({w["segment"] for w in windows}) > 2 and not any(w["whole"] for w in windows)
    assert [p for w in windows for p in w["new_turns"]] == list(range(40))
    assert all(w["n_tokens"] <= 512 and w["formatted"].startswith("<<SYS>>\n") and len(w["turn_starts"]) > len(w["new_turns"]) for w in windows[1:])
    for in_order in (True, False):
        found = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(formatted, in_order).collect()}
        assert found == summary([tuple(r) for r in rows.collect()])


def test_chat_over_the_whole_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = chat.read_back(chat.format_chats(Scratch(spark, "chat"), df, MODEL), in_order=True).collect()
    assert {r["conv_id"]: tuple(r)[1:5] for r in rows} == summary([tuple(r) for r in df.collect()])
