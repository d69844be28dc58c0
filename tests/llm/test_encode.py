import base64
import random

import pytest
import tiktoken

from attestor.llm.encode import PATTERN, VOCABULARY, Merges, encode_documents


@pytest.fixture(scope="module")
def reference():
    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [
    "Hello world, it's 2024!", "", None, "  \n\t  spaced\r\n", "naïve café — 東京 🙂 ​", "<|endoftext|> is text", "a" * 9001, "ab" * 2600, "x" * 3 + " " * 50, "é" * 2500,
    "1234567890 12½ ①", "the quick brown fox’s", "Ω≈ç√∫˜µ≤≥÷", "\x00\x1f\x85", "日本語の段落。" * 700,
]


def test_equal_to_the_public_encoder(spark, reference):
    rng = random.Random(4)
    noise = ["".join(rng.choice("ab é東\n '1,🙂") for _ in range(rng.randrange(400))) for _ in range(200)]
    rows = [(i, t, [i], "x") for i, t in enumerate(TEXTS + noise)]
    got = {r.doc_id: r.ids for r in encode_documents(spark.createDataFrame(rows, "doc_id long, text string, ids array<int>, n string")).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        assert got[i] == reference.encode_ordinary(t or ""), t


def test_round_trip_of_documents(spark, data, reference):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = encode_documents(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert reference.decode_bytes(r.ids).decode() == texts[r.doc_id]


def test_long_words_go_the_same_way(reference, monkeypatch):
    import time

    m = Merges(VOCABULARY)
    rng = random.Random(6)
    words = [b"aaaaa", b"abababab", "東京東京".encode(), b"internationalisation", bytes(range(256)), b"a" * 100_000, b"ab" * 50_000]
    words += ["".join(rng.choice(letters) for _ in range(60_000)).encode() for letters in ("ACGT", "abcdefghijklmnopqrstuvwxyz", "東京段落日本語")]
    words.append(base64.b64encode(rng.randbytes(60_000)).rstrip(b"="))
    want = [reference.encode_single_piece(w) if hasattr(reference, "encode_single_piece") else reference._core_bpe.encode_single_piece(w) for w in words]
    start = time.time()
    assert m.encode_words(words) == want
    assert time.time() - start < 60
    monkeypatch.setattr("attestor.llm.encode.BYTES", 7)
    assert m.encode_words(words[:5] + [b""] + words[:2]) == [*want[:5], [], *want[:2]] and m.encode_words([]) == []


def test_empty_table(spark):
    assert encode_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
