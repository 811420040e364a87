"""BPE against the tokenizers library, counts and rules against plain Python."""

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphveil.llm import op03_rules, op09_bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return op09_bpe.Codec(op09_bpe.vocabulary(PATH)), t


def same(both, text):
    ids = both[0].encode(text)
    assert ids == both[1].encode(text, add_special_tokens=False).ids, repr(text)
    assert both[0].decode(ids).decode("utf-8", "replace") == both[1].decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(both, text):
    same(both, text)


def test_hard_texts(both):
    r = random.Random(4)
    pieces = ["the", "ing", " ", "tion", "  ", "\n", "<|endoftext|>", "'ll", "====", "1234", "é", "ß", "日本", "　", "\x1c", "\x85", "😀", "aaaa", "Aa"]
    for _ in range(2000):
        same(both, "".join(r.choice(pieces) for _ in range(r.randint(0, 30))))
    for text in ("", "a" * 20_000, "Ü" * 5000, " " * 3000 + "x", "ab" * 7000, "." * 4000, "x1" * 3000):
        same(both, text)


def test_small_caches_change_nothing():
    c = op09_bpe.Codec(op09_bpe.vocabulary(PATH), keep=3)
    full = op09_bpe.Codec(op09_bpe.vocabulary(PATH))
    text = "the quick brown fox jumps over the lazy dog " * 3
    assert c.encode(text) == full.encode(text)


def test_frames(spark, both):
    rows = [(1, "hello world", "x"), (2, None, "y"), (3, "", None), (1, "hello world", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = op09_bpe.bpe_round_trip(df, PATH).orderBy("doc_id").collect()
    ids = both[1].encode("hello world").ids
    assert [r["n_tokens"] for r in got] == [len(ids), len(ids), 0, 0]
    assert got[0]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got[2]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    enc = op09_bpe.bpe_encode(df.drop("n_tokens"), PATH)
    assert [r["decoded"] for r in op09_bpe.bpe_decode(enc, PATH).orderBy("doc_id").collect()] == ["hello world", "hello world", "", ""]
    assert op09_bpe.bpe_encode(df, PATH, out="text").count() == 4
    assert op09_bpe.bpe_round_trip(df.where("false"), PATH).count() == 0


def test_frames_of_clashing_columns(spark, both):
    df = spark.createDataFrame([("hello", "x", 1, 2, 3)], "text string, text__in string, N_Tokens int, _text int, `a b.c` int")
    assert op09_bpe.bpe_encode(df, PATH, out="TEXT").columns == ["text__in", "N_Tokens", "_text", "a b.c", "TEXT"]
    assert op09_bpe.bpe_encode(df, PATH, out="text").first()["text"] == both[1].encode("hello").ids
    got = op09_bpe.bpe_round_trip(df, PATH)
    assert got.columns == ["text", "text__in", "_text", "a b.c", "n_tokens", "ids_sha256", "decoded_sha256"] and got.first()["n_tokens"] == 1
    counts = op03_rules.quality_counts(df.withColumn("N_words", op03_rules.F.lit("mine")))
    assert counts.columns == ["text__in", "N_Tokens", "_text", "a b.c", *op03_rules.COUNTS] and counts.first()["n_words"] == 1
    full = df.selectExpr("*", "'en' AS lang", "CAST(NULL AS string) AS source", "1 AS Kept", "2 AS Symbols_High")
    assert op03_rules.quality_rules(full).count() == 1


def slow_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_counts():
    r = random.Random(5)
    texts = ["", " \n\t", "a", "é\xa0b\x85c \x1c d", "x " * 40] + ["".join(r.choice(["a", "b", " ", "\n", "#", "é", "a b c d e f g h i ", "\x0b"]) for _ in range(r.randint(1, 120))) for _ in range(150)]
    for t in texts:
        n, chars, symbols, dup, _, rep = op03_rules.text_counts(t)
        assert (n, chars, symbols, dup, rep) == slow_counts(t), repr(t)


def test_rules(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8)))
    rows = [(i, " ".join(word() for _ in range(60)), "en", "s" if i % 3 else None, "mine") for i in range(90)]
    rows += [(100, None, "en", "s", ""), (101, "", None, None, ""), (102, "few words", "en", "s", ""), (103, " ".join(word() + "%%%%" for _ in range(60)), "en", "s", ""), (104, "same eight words come here again and again " * 20, "en", "s", ""), (0, rows[0][1], "en", None, "mine")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept string")
    got = {x["doc_id"]: x for x in op03_rules.quality_rules(df).collect()}
    assert op03_rules.quality_rules(df).count() == len(rows)
    assert all(got[i]["kept"] for i in range(90))
    assert [got[i]["base_failed"] for i in (100, 101, 102, 103, 104)] == [True, True, True, False, True] and not got[103]["kept"]
    assert op03_rules.quality_rules(df.where("false")).count() == 0


def test_small_groups_share_sketches(spark):
    r = random.Random(7)
    word = lambda mark="": "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) + mark
    text = lambda mark="": " ".join(word(mark) for _ in range(60))
    rows = [(i, text(), "en", f"s{i % 30}") for i in range(120)]  # no source has LEAST documents, the language has
    rows += [(i, text("%%%%"), "de", "t") for i in range(200, 320)]  # its own sketch, in which signs are usual
    rows += [(400, text("%%%%"), "en", "s0"), (401, text("%%%%"), "en", "alone"), (402, text(), None, None), (403, text("%%%%"), "xx", None)]
    got = {x["doc_id"]: x for x in op03_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert len(got) == len(rows) and all(got[i]["kept"] for i in (*range(120), *range(200, 320)))
    assert not got[400]["kept"] and not got[401]["kept"]
    limits = [(got[i]["symbols_high"], got[i]["word_length_low"]) for i in (0, 401, 200, 402, 403)]
    assert limits[0] == limits[1] != limits[2] and limits[3] == limits[4] and limits[3] not in (limits[0], limits[2])
