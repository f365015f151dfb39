import hashlib
import random
import re
import zlib

import numpy as np

from gleaner.llm import periodic_runs, queries

SCHEMA = "doc_id long, text string, runs string, n_words string"


def brute_runs(words):
    """(start, length, period) of all runs, by trying every period at every place."""
    n, out = len(words), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(6, 4 * q):
                own = words[i : i + length]
                if not any(all(own[t] == own[t + p] for t in range(length - p)) for p in range(1, q)):
                    out.add((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_random_runs_match_brute_force():
    rng = random.Random(5)
    for _ in range(600):
        docs = []
        for _ in range(rng.randint(1, 4)):
            alphabet, words = rng.choice([1, 2, 3, 5, 50]), []
            while len(words) < rng.randint(0, 150):
                period = [rng.randrange(alphabet) for _ in range(rng.randint(1, 14))]
                words += (period * rng.randint(1, 9))[: rng.randint(1, 70)]
            docs.append(words)
        flat = np.array([w for d in docs for w in d], np.int64)
        got = periodic_runs.runs_of(flat, np.array([len(d) for d in docs])).tolist()
        assert got == [[i, *run] for i, d in enumerate(docs) for run in brute_runs(d)]


def test_a_period_that_holds_repeated_grams_itself():
    # Every gram of the period comes twice in it, so neighbouring short grams miss the period.
    period = list("abcdefgabcdefgxabcdefgabcdefgy")
    words = period * 5
    numbers = {w: i for i, w in enumerate(sorted(set(words)))}
    got = periodic_runs.runs_of(np.array([numbers[w] for w in words]), np.array([len(words)])).tolist()
    assert [0, 0, len(words), len(period)] in got
    assert [r[1:] for r in got] == [list(r) for r in brute_runs(words)]


def test_odd_texts_rows_and_columns(spark):
    long = " ".join(f"w{i}" for i in range(60_000)) + " a b" * 9_000
    texts = [None, "", " \t\n", "x", "a a a a a", "a\ta\x0ba\na\x0ca\ra", "é " * 6, long, "a a a a a a b", "a a a a a a b", "a\x85a a\xa0a"]
    rows = [(i // 2 if i > 5 else None, t, "r", "n") for i, t in enumerate(texts)]
    got = periodic_runs.periodic_runs(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()
    assert len(got) == len(texts)
    for r, (_, text, _, _) in zip(got, rows, strict=True):
        words, found = split(text), [tuple(run) for run in r["periodic"]["runs"]]
        want = [(60_000, 18_000, 2)] if text is long else brute_runs(words)
        assert (r["text"], r["runs"], r["n_words"], found) == (text, "r", "n", want)
        assert r["periodic"]["n_words"] == len(words) and r["periodic"]["collapsed"] == brute_collapse(words, want)


def test_no_rows(spark):
    assert periodic_runs.periodic_runs(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_matches_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        words, h = split(r["text"]), zlib.crc32(str(r["doc_id"]).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
        runs = brute_runs(words)
        top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        want[r["doc_id"]] = (
            len(runs), *top, 1000 * top[1] // top[2] if runs else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(brute_collapse(words, runs).encode()).hexdigest(),
        )
    got = {r[0]: tuple(r[1:]) for r in queries.op11_periodic_runs(spark, folder).collect()}
    assert got == want and any(v[0] for v in want.values())


def test_planting_takes_null_ids_and_texts(spark):
    rows = [(None, "a b c"), (None, None), (1, None), (3, "")] + [(i, "a b c d e f g h i j k") for i in range(100)]
    got = queries.with_planted_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["text"]) for r in got[:2]] == [(None, "a b c"), (None, None)] and len(got) == len(rows)
    assert 0 < sum(r["text"] != t for r, (_, t) in zip(got[4:], rows[4:], strict=True)) < 30
