import hashlib
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gleaner.llm import byte_bpe, packing, token_counts

ODD = [
    None, "", " ", "a b", "a  b", "a   b\n c", "  x", "x  ", "a\n b", "a \n b", "it's 12345 's", "<|endoftext|> a<|startoftext|>b",
    "é ́", "ΑΣ ΣΑΣ. Σ", "日本語, テスト.", "Ünï, x.", "İstanbul, İ.", "🎉🎉 ok!!", "x\x1cy z", "a\x85b c", "a" * 700 + " b", "word, " * 3000,
]


def frame(spark, texts):
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, _words string, counts string")


def read(name):
    return Path(public_tokenizers.path(name)).read_text(encoding="utf-8")


@pytest.fixture(scope="module")
def corpus(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(60).collect()
    return [r["text"] for r in rows] + ODD


def test_token_counts_match_the_library(spark, corpus, monkeypatch):
    monkeypatch.setattr(token_counts, "FREQUENT", 50)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = token_counts.token_counts(frame(spark, corpus), read("word_bpe_49k.json"), out_col="n").collect()
    for r in got:
        text = r["text"] or ""
        n = len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert (r["n"]["n_bytes"], r["n"]["n_tokens"], r["n"]["over_limit"]) == (len(text.encode()), n, n > 2048), text[:40]
    assert got[0]["counts"] == "y"


def test_token_counts_of_no_rows(spark):
    assert token_counts.token_counts(frame(spark, []), read("word_bpe_49k.json"), out_col="n").collect() == []


@pytest.mark.parametrize("frequent", [3, 1 << 20])
def test_bpe_matches_the_library_and_comes_back(spark, corpus, frequent):
    name = "byte_bpe_multi_50k.tiktoken"
    ranks = byte_bpe.parse_ranks(read(name))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = byte_bpe.encode(frame(spark, corpus), read(name), public_tokenizers.PATTERN, frequent=frequent).collect()
    assert len(got) == len(corpus)
    for r in got:
        ids = library.encode_ordinary(r["text"] or "")
        assert np.frombuffer(bytes(r["encoded"]["ids"]), "<u4").tolist() == ids
        assert bytes(r["encoded"]["decoded"]) == (r["text"] or "").encode() and r["encoded"]["n_tokens"] == len(ids)


def test_bpe_replaces_a_column_of_its_name(spark):
    name = "byte_bpe_multi_50k.tiktoken"
    docs = frame(spark, ["a b", None, "zzqx zzqx\n zzqx"]).withColumnRenamed("counts", "encoded")
    got = byte_bpe.encode(docs, read(name), public_tokenizers.PATTERN, frequent=0).collect()
    assert got[0].asDict().keys() == {"doc_id", "text", "_words", "encoded"}
    assert [bytes(r["encoded"]["decoded"]).decode() for r in got] == ["a b", "", "zzqx zzqx\n zzqx"]


def test_bpe_of_no_rows(spark):
    assert byte_bpe.encode(frame(spark, []), read("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).collect() == []


def test_folds_of_pairs_match_the_merges(spark):
    """Bytes without a rank, words with a rank that no merge reaches, overlapping pairs of one rank."""
    ranks = byte_bpe.parse_ranks(read("byte_bpe_multi_50k.tiktoken"))
    lacking = {t: n for t, n in ranks.items() if t not in (b"a", b"th", b"in")}
    words = [b"this", b" then", b"banana", b" in", b"a", b"ab" * 128, bytes(range(256)), b"aaaaaaa", b""]
    for own in (ranks, lacking):
        table = byte_bpe.rank_literal(own)
        assert (table.whole is None) == (own is ranks)
        full = {bytes([b]): -1 for b in range(256)} | own
        rows = spark.createDataFrame([(w,) for w in words], "word binary").select("word", byte_bpe.merged_ranks(F.col("word"), table).alias("ids")).collect()
        for r in rows:
            word = bytes(r["word"])
            merged = byte_bpe.merge_long(word, full)
            assert r["ids"] == ([own[word]] if word in own else [None if n < 0 else n for n in merged]), word


def test_matches_of_many_texts_are_those_of_each():
    """Lines and marks are cut in bulk; runs of white space and control characters forbid it."""
    texts = [t for t in ODD if t != "x  "] + ["x\ny\n", "\nx", "\n", "a\n\nb", "\0a b", "x\r\ny z", "abc\nde. Fg,\nhi's"]
    words, numbers, bounds = byte_bpe.text_words(pa.array(texts, pa.string()), public_tokenizers.PATTERN)
    assert len(bounds) == len(texts) + 1 and len(words.unique()) == len(words)
    for text, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
        assert words.take(pa.array(numbers[a:b])).to_pylist() == regex.findall(public_tokenizers.PATTERN, text or "")


def test_long_words_merge_alike():
    ranks = byte_bpe.parse_ranks(read("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for word in ("a" * 999, "ab" * 300 + "c", "supercalifragilistic" * 30):
        assert byte_bpe.merge_long(word.encode(), ranks) == library.encode_ordinary(word)


def test_pieces_and_packing_hold_every_token_once(spark, corpus):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = frame(spark, corpus)
    got = packing.pack(packing.tokenised_pieces(docs, read("byte_bpe_50k.json"))).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert set(by_doc) == set(range(len(corpus)))
    for i, text in enumerate(corpus):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        start = 0
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        for k, r in enumerate(own):
            part = ids[start : start + r["length"]]
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, start, zlib.crc32(np.array(part, "<u4").tobytes()))
            assert k == 0 or r["length"] == 1024
            start += r["length"]
        assert start == len(ids)
    check_gapless(got)


def check_gapless(rows):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    return len(by_sequence)


def test_packing_ranks_in_slices_with_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "SLICE_ROWS", 40)
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 2, 3]), 0, 0, rng.choice([1024, 700, 324, 512, 100, 7]), 5) for _ in range(900)]
    got = packing.pack(spark.createDataFrame(rows, packing.PIECES)).collect()
    assert Counter(r["length"] for r in got) == Counter(r[3] for r in rows)
    assert check_gapless(got) <= 1.02 * sum(r[3] for r in rows) / 1024 + 1


def test_packing_of_no_rows(spark):
    assert packing.pack(spark.createDataFrame([], packing.PIECES)).collect() == []


@pytest.mark.parametrize("counts", [{342: 1000, 341: 900, 340: 30, 700: 50, 324: 60}, {600: 100, 424: 100}, {1024: 3}, {1: 5000}, dict(Counter(random.Random(3).choices(range(1, 1025), k=3000)))])
def test_plan_is_feasible_and_near_the_bound(counts):
    plan = packing.plan_sequences(counts)
    held = Counter()
    for pattern, times in plan:
        assert sum(pattern) <= 1024 and times > 0
        for x in pattern:
            held[x] += times
    assert held == Counter(counts)
    alone = packing._rounded(counts, {}, 0.0, 1024)
    assert sum(n for _, n in plan) <= sum(n for _, n in alone)


def test_digests_are_of_little_endian_numbers(spark):
    from gleaner.llm.queries import op6_byte_bpe

    row = op6_byte_bpe(spark, "/root/testdata/sf0.001").orderBy("doc_id").first()
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter(f"doc_id = {row['doc_id']}").first()["text"]
    assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
