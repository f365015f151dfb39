import hashlib
import itertools
import re

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from gleaner.llm import exact_dedup, simhash, substring_dedup
from gleaner.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _may int, _at int, key string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, 1, 2, "x") for i, t in rows], SCHEMA)


ODD = [
    (5, "a  b\tc"), (3, "a b c"), (9, "a b\n\nc"), (1, None), (2, ""), (4, "   "), (None, "a b c"),
    (None, "only null"), (7, "a b C"), (8, "x" * 50_000), (6, "x" * 50_000), (10, "x" * 49_999 + "y"), (10, "x" * 49_999 + "y"),
]


def test_exact_dedup_matches_grouping_by_text(spark):
    got = exact_dedup.exact_dedup(frame(spark, ODD), all_digests=True).collect()
    groups = {}
    for i, t in ODD:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    want = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        for i in ids:
            want.append((i, keep if len(ids) > 1 else i, len(ids), i == (keep if len(ids) > 1 else i), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_exact_dedup_hashes_only_rows_with_a_partner(spark):
    got = {r["doc_id"]: r["text_sha256"] for r in exact_dedup.exact_dedup(frame(spark, [(1, "abc"), (2, "abd"), (3, "abcd"), (4, "abcd")])).collect()}
    assert got[1] is None and got[2] is None and got[3] == got[4] is not None


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert exact_dedup.exact_dedup(empty).collect() == []
    assert simhash.near_duplicates(empty).collect() == []
    assert substring_dedup.substring_dedup(empty).collect() == []


def test_without_keeps_columns_and_null_ids(spark):
    docs = frame(spark, [(1, "a"), (2, "b"), (None, "c"), (2, "d")])
    gone = spark.createDataFrame([(2,), (77,)], "doc_id long")
    left = exact_dedup.without(docs, gone)
    assert left.columns == docs.columns
    assert sorted(r["text"] for r in left.collect()) == ["a", "c"]


def brute_print(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes) > 0)


@pytest.mark.parametrize("text", [None, "", " \n", "one", "One TWO", "a b c", "a b a b a b a b", "ÄÖ É x\x0by\x0cz w"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_print(text)


def brute_components(values, bits=3):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(values)), 2):
        if (values[i] ^ values[j]).bit_count() <= bits:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def clusters(n, size, seed):
    rng = np.random.default_rng(seed)
    out = set()
    for base in rng.integers(0, 2**64, n, dtype=np.uint64):
        for _ in range(size):
            value = int(base)
            for bit in rng.choice(64, rng.integers(0, 5), replace=False):
                value ^= 1 << int(bit)
            out.add(value)
    return sorted(out)


@pytest.mark.parametrize("chunk", [4096, 40])
def test_links_join_what_pairs_join(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    values = clusters(12, 60, 3)
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    nodes = spark.createDataFrame(list(enumerate(signed)), "node long, fp long")
    found = {r["node"]: r["component"] for r in components(simhash.near_links(nodes)).collect()}
    assert [found.get(i, i) for i in range(len(values))] == brute_components(values)


def test_near_duplicates_match_brute_force(spark):
    base = [f"w{i * 7 % 101}" for i in range(120)]
    texts = [(i, " ".join(base[: 119 - i] + ["new"] * (i % 3))) for i in range(12)]
    texts += [(50, None), (51, ""), (52, "lonely words here"), (53, "Lonely WORDS  here"), (3, "same id other text")]
    got = simhash.near_duplicates(frame(spark, texts)).collect()
    prints = [brute_print(t) for _, t in texts]
    assert sorted(r["fingerprint"] for r in got) == sorted(f"{p:016x}" for p in prints)
    by_id = {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] != 3}
    roots = brute_components(prints)
    for (i, _), root in zip(texts, roots, strict=True):
        if i != 3:
            assert by_id[i] == min(texts[k][0] for k in range(len(texts)) if roots[k] == root)


def test_components_of_chains_and_loops(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 100), (200, 201), (201, 200), (201, 202)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(41)) and {found[i] for i in (200, 201, 202)} == {200}


def words(prefix, n):
    return [f"{prefix}{i}" for i in range(n)]


PASSAGE = " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(words("pass", 56))) + "."


def test_passage_stays_in_the_first_document_only(spark):
    docs = [
        (4, "Intro of four here. " + PASSAGE + "\nTail of four."),
        (2, "Quite another start.\n" + PASSAGE + " End of two."),
        (6, " ".join(words("clean", 80)) + "."),
        (8, None),
        (9, ""),
        (10, "short. Des. Les."),
        (11, "short. Des. Les."),
        (None, PASSAGE),
    ]
    got = {r["doc_id"]: r["cleaned"] for r in substring_dedup.substring_dedup(frame(spark, docs)).collect()}
    assert got[2]["text"] == docs[1][1]
    assert got[4]["text"] == "Intro of four here. Tail of four."
    assert got[None]["text"] == ""
    for i, text in docs[2:7]:
        assert got[i]["text"] == text and got[i]["removed"] == 0
    span = got[4]["spans"][0]
    assert docs[0][1][span["start"] : span["stop"]].strip() == PASSAGE


def test_repeat_within_a_text_and_very_long_text(spark):
    docs = [(1, PASSAGE + "\n" + PASSAGE), (2, " ".join(words("u", 30_000)))]
    got = {r["doc_id"]: r["cleaned"]["text"] for r in substring_dedup.substring_dedup(frame(spark, docs)).collect()}
    assert got[1].strip() == PASSAGE and got[2] == docs[1][1]


def test_one_long_sentence_as_passage(spark):
    long = " ".join(words("longword", 60))
    docs = [(1, "A first line\n" + long + "\nbye"), (2, "Other words\n" + long + "\nciao")]
    got = {r["doc_id"]: r["cleaned"]["text"] for r in substring_dedup.substring_dedup(frame(spark, docs)).collect()}
    assert got[1] == docs[0][1] and got[2] == "Other words\nciao"


def test_run_hashes_stand_for_their_text():
    text = (PASSAGE + " ") * 3 + " ".join(words("v", 400))
    starts, sizes, hashes = substring_dedup.sentences(text)
    first, stop, h = substring_dedup.runs(sizes, hashes)
    content = {}
    for i, j, value in zip(first, stop, h, strict=True):
        own = " ".join(text[starts[i] : starts[j]].split())
        assert content.setdefault(int(value), own) == own
    assert len(set(content.values())) == len(content) and sum(sizes) == len(text.split())


def test_short_passages_at_random_word_positions_are_found():
    rng = np.random.default_rng(5)
    lexicon = ["".join(rng.choice(list("abcdehinorst"), rng.integers(2, 9))) for _ in range(3000)]

    def prose(n, stops):
        return [w + "." * int(stops and rng.random() < 0.08) for w in rng.choice(lexicon, n)]

    for trial in range(400):
        stops, size = trial % 2, 51 + trial % 10
        passage = prose(size, stops)
        shared, kept = [], []
        for _ in range(2):
            head = prose(rng.integers(0, 80), stops)
            text = " ".join([*head, *passage, *prose(rng.integers(0, 80), stops)])
            starts, sizes, hashes = substring_dedup.sentences(text)
            first, stop, h = substring_dedup.runs(sizes, hashes)
            shared.append(dict(zip(h.tolist(), zip(first, stop))))
            kept.append((len(head), np.concatenate([[0], np.cumsum(sizes)])))
        both = shared[0].keys() & shared[1].keys()
        assert both, (trial, " ".join(passage))
        for (head, total), own in zip(kept, shared):
            covered = {k for x in both for k in range(total[own[x][0]], total[own[x][1]])}
            assert covered >= set(range(head + substring_dedup.WINDOW, head + size - substring_dedup.WINDOW))


def test_sentences_cover_odd_white_space():
    for text in ["", " \n", "a", "\n a.\u00a0b! c\x1cd\u3000e \n\n f", "x\ud800y z. " * 9, "\u2003" + "the " * 40]:
        starts, sizes, hashes = substring_dedup.sentences(text)
        assert sizes.sum() == len(text.split()) and starts[-1] == len(text) and len(starts) == len(sizes) + 1 == len(hashes) + 1
        for a, b, n in zip(starts, starts[1:], sizes):
            assert len(text[a:b].split()) == n
