import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import brown_lm, language_id, license_scan, rp_forest
from gleaner.llm.common import held_out, learnable
from gleaner.llm.queries import op4_language_id, op9_brown_lm

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def test_held_out_rows(spark):
    rows = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long")
    got = rows.select("doc_id", held_out(F.col("doc_id"), 7).alias("h"), learnable(F.col("doc_id"), 7).alias("l")).collect()
    for r in got:
        want = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2
        assert r["h"] == want and r["l"] == (r["doc_id"] is not None and not want)


def test_languages_are_told_apart_on_held_out_documents(spark, docs):
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = [r for r in op4_language_id(spark, SMALL).collect() if r["held_out"]]
    assert len(got) > 20 and all(0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in got]) > 0.95


def test_odd_texts_of_language_identification(spark, docs):
    model = language_id.train(docs)
    own = docs.orderBy("doc_id").first()["text"]
    rows = [(1, None), (2, ""), (3, "12 34 !!"), (4, own), (4, own), (None, own * 200), (5, "Яблоко и груша растут в саду рядом с домом. " * 20)]
    odd = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string")
    got = language_id.identify(odd, model, out_col="found").collect()
    by_text = {r["text"]: r["found"] for r in got}
    for text in (None, "", "12 34 !!"):
        assert by_text[text]["lang_pred"] == "und" and by_text[text]["score"] == 0 and by_text[text]["rejected"]
    assert not by_text[own]["rejected"] and by_text[own * 200]["lang_pred"] == by_text[own]["lang_pred"]
    assert by_text[rows[-1][1]]["rejected"]
    assert len(got) == len(rows) and got[0]["score"] == "x"
    assert language_id.identify(odd.limit(0), model).collect() == []


def test_no_labels_give_no_language(spark):
    rows = spark.createDataFrame([(1, "abc", None), (2, None, "en")], "doc_id long, text string, lang string")
    got = language_id.identify(rows, language_id.train(rows)).collect()
    assert all(r["language"]["lang_pred"] == "und" and r["language"]["rejected"] for r in got)


def test_kneser_ney_probabilities_sum_to_one():
    model = language_id.fit({"a": {"abab": 3, "abc": 1, "ca": 2}, "b": {"bbb": 4, "cab": 1}})

    def chance(c):
        """Of the character behind "ab"; the empty string ends the word."""
        grams, contexts, _ = language_id._hashes(["ab" + c])
        p = np.full((1, 2), model.floor)
        for k in range(language_id.ORDER):
            p = language_id._rows(model.grams[k], model.shares[k], grams[k][2:3], 0.0) + p * language_id._rows(
                model.contexts[k], model.backoffs[k], contexts[k][2:3], 1.0
            )
        return p[0]

    unseen = round(1 / model.floor) - 4
    assert sum(chance(c) for c in ["a", "b", "c", ""]) + unseen * chance("z") == pytest.approx(1.0)


def tokens(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w] + ["\n"]


@pytest.mark.parametrize("frequent", [50, 1 << 18])
def test_base_scores_match_brute_force_and_the_model_beats_them(spark, docs, monkeypatch, frequent):
    monkeypatch.setattr(brown_lm, "FREQUENT", frequent)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    counts = Counter()
    for i, text in texts.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(tokens(text))
    n, v = sum(counts.values()), len(counts)
    got = op9_brown_lm(spark, SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        own = tokens(texts[r["doc_id"]])
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(counts[w] > 0 for w in own), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def plain_scores(texts, learned, model, tail):
    """The class model written out: sums over the words of each text."""
    cls = {w: int(model.classes[i]) for i, w in enumerate(model.words)} | {brown_lm.END: 0}
    behind = dict(cls)
    cls |= {bytes(r["word"]): r["cls"] for r in tail.collect() if r["cls"] is not None}
    cut = {i: [w.encode() for w in tokens(t)] for i, t in texts.items()}
    counts = Counter(w for i in learned for w in cut[i])
    of_ending = {e: int(model.classes[len(model.words) + 1 + i]) for e, i in model.endings.items()}
    other = int(model.classes[-1])
    last = lambda w: e if (e := w.decode()[-2:].encode()) in model.endings else None
    history = lambda w: behind.get(w, of_ending.get(last(w), other))
    own = lambda w: cls.get(w, of_ending.get(last(w), other))
    n = len(model.step)
    table = np.zeros((n, n))
    for i in learned:
        for a, b in zip([brown_lm.END, *cut[i]], cut[i]):
            table[history(a), own(b)] += 1
    rare = [w for w in counts if w not in cls]
    among = {e: sum(counts[w] for w in rare if last(w) == e) for e in [None, *model.endings]}
    kinds = {e: sum(last(w) == e for w in rare) for e in among}
    mass = np.zeros(n)
    for w, c in cls.items():
        mass[c] += counts[w] + 1
    for e, m in among.items():
        mass[of_ending.get(e, other)] += m + 1
    if len(model.endings) < brown_lm.ENDINGS:  # endings that no word has are units as well
        mass[other] += brown_lm.ENDINGS - len(model.endings)
    share = (table.sum(axis=0) + 1) / (table.sum() + n)

    def chance(a, b):
        g, h = history(a), own(b)
        kinds_behind = max((table[g] > 0).sum(), 1)
        p = (table[g, h] + kinds_behind * share[h]) / (table[g].sum() + kinds_behind)
        if b in cls:
            return p * (counts[b] + 1) / mass[h]
        e = last(b)
        return p * (among[e] + 1) / mass[h] * (counts[b] + 1) / (among[e] + kinds[e] + 1)

    return {i: sum(math.log10(chance(a, b)) for a, b in zip([brown_lm.END, *own_words], own_words)) for i, own_words in cut.items()}


@pytest.mark.parametrize("frequent, block", [(1 << 18, 256), (1200, 7), (40, 256)])
def test_class_scores_match_brute_force(spark, docs, monkeypatch, frequent, block):
    monkeypatch.setattr(brown_lm, "FREQUENT", frequent)
    monkeypatch.setattr(brown_lm, "BLOCK", block)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    texts |= {-1: None, -2: "", -3: "unseen wörd the THE the xq'zz", -4: "Wörd " * 3000}
    learned = [i for i in texts if i % 3]
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    model, tail = brown_lm.train(rows.filter("doc_id % 3 <> 0"))
    words = Counter(w.encode() for i in learned for w in tokens(texts[i]))
    placed = {bytes(r["word"]): (r["n"], r["cls"]) for r in tail.collect()}
    # Every word is in the table or beside it, and every word that is not rare has a class of its own.
    assert set(placed) | set(model.words) | {brown_lm.END} == set(words) and not set(placed) & set(model.words)
    assert all(n == words[w] and (c is not None) == (n >= brown_lm.LEAST) for w, (n, c) in placed.items())
    assert len(model.words) <= frequent and (frequent > 1200 or any(c for _, c in placed.values()))
    assert (model.classes[: len(model.words)] > 0).all()
    want = plain_scores(texts, learned, model, tail)
    # A repeated id, and columns with the names of results.
    table = rows.union(rows.filter("doc_id = -3")).withColumn("score", F.lit("x")).withColumn("word", F.lit("y"))
    got = brown_lm.score(table, model, tail).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert r["score"] == pytest.approx(want[r["doc_id"]], rel=1e-9)


def test_words_move_to_the_class_of_their_neighbours(spark, monkeypatch):
    monkeypatch.setattr(brown_lm, "WORDS", 40)
    rng = np.random.default_rng(3)
    # Two kinds of words alternate; spelling says nothing, since all end alike.
    first, second = ([f"{k}{i}zz" for i in range(60)] for k in "ab")
    weights = 1 / np.arange(1, 61)
    weights /= weights.sum()
    lines = [" ".join(w for _ in range(40) for w in (rng.choice(first, p=weights), rng.choice(second, p=weights))) for _ in range(120)]
    rows = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    for frequent in (1 << 18, 60):
        monkeypatch.setattr(brown_lm, "FREQUENT", frequent)
        model, tail = brown_lm.train(rows)
        cls = {w: int(model.classes[i]) for i, w in enumerate(model.words)} | {bytes(r["word"]): r["cls"] for r in tail.collect()}
        kinds = {k: Counter(c for w, c in cls.items() if w.startswith(k) and c is not None) for k in (b"a", b"b")}
        both = sum(min(kinds[b"a"][c], kinds[b"b"][c]) for c in kinds[b"a"])
        assert len(cls) == 120 and both <= 6


def test_nothing_learned(spark):
    rows = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model, tail = brown_lm.train(rows.limit(0))
    (r,) = brown_lm.score(rows, model, tail).collect()
    assert r["base_score"] == 0.0 and r["n_known"] == 0 and r["train_tokens"] == 0 and r["score"] <= 0
    assert brown_lm.score(rows.limit(0), model, tail).collect() == []


def test_model_probabilities_sum_to_one(spark, docs, monkeypatch):
    monkeypatch.setattr(brown_lm, "FREQUENT", 2000)
    model, tail = brown_lm.train(docs)
    size = len(model.words)
    last = lambda w: model.endings.get(w.decode()[-2:].encode(), brown_lm.ENDINGS)
    inside = 10 ** model.emit
    for before in range(0, len(model.step), 7):
        p = 10 ** model.step[before]
        total = (p[model.classes[: size + 1]] * inside[: size + 1]).sum()
        left = np.full(brown_lm.ENDINGS + 1, 1.0)  # one unseen word per ending
        for r in tail.collect():
            if r["cls"] is None:
                left[last(bytes(r["word"]))] += r["n"] + 1
            else:
                total += p[r["cls"]] * (r["n"] + 1) / 10 ** model.mass[r["cls"]]
        total += (p[model.classes[size + 1 :]] * inside[size + 1 :] * left / 10**model.among).sum()
        assert total == pytest.approx(1.0, abs=1e-6)


def test_exchange_finds_alternating_classes():
    counts = np.zeros((9, 9))
    for i in range(4):
        for j in range(4, 8):
            counts[i, j] = counts[j, i] = 10 + i + j
    counts[8, 0] = counts[4, 8] = 1
    own = brown_lm.exchange(counts, classes=3)
    assert len(set(own[:4])) == 1 and len(set(own[4:8])) == 1 and own[0] != own[4] and own[8] == 0


def test_licence_notices(spark):
    plain = "Und die erle wachst. The erin of thend, with in ofthe."
    rows = [
        (1, plain + "\nReleased under the MIT License."), (2, plain), (3, None), (4, ""),
        (5, "RELEASED under the mit license"), (6, plain + "\n" + plain * 400 + " Licensed under the Apache License, Version 2.0. " + plain * 50),
        (7, "This work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0."),
        (8, "The license of this house is under the table."), (None, "Released under the MIT License."), (2, plain),
    ]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, key string")
    got = license_scan.scan(docs, license_scan.train(docs)).collect()
    assert len(got) == len(rows)
    found = {r["doc_id"]: r["license"] for r in got}
    assert found == {1: "mit", 2: None, 3: None, 4: None, 5: "mit", 6: "apache-2.0", 7: found[7], 8: None, None: "mit"}
    seven = next(r for r in got if r["doc_id"] == 7)["notices"]
    assert {(n["paragraph"], n["family"]) for n in seven} == {(0, "gpl-3.0"), (1, "cc-by-nc")}
    assert license_scan.scan(docs.limit(0), license_scan.train(docs.limit(0))).collect() == []


def test_wrapped_licence_notices(spark):
    plain = "Und die erle wachst. The erin of thend, with in ofthe."
    gpl = """ * This program is free software; you can redistribute it and/or
 * modify it under the terms of the GNU General Public License
 * as published by the Free Software Foundation; either version 2
 * of the License, or (at your option) any later version."""
    lgpl = """# This library is free software; you can redistribute
# it and/or modify it under the terms of the GNU
# Lesser General Public License as published"""
    bsd = """// Redistribution and use in source and binary forms, with
// or without modification, are permitted provided
// that the following conditions are met:"""
    rows = [
        (1, plain + "\n\n" + gpl + "\n" + plain), (2, lgpl), (3, "\n".join([plain] * 30 + [bsd, plain])),
        (4, "Released under\nthe MIT License."), (5, "\n".join([plain] * 9)), (6, "Released under the MIT License.\n" + bsd),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scan(docs, license_scan.train(docs)).collect()}
    assert {i: r["license"] for i, r in got.items() if i != 6} == {1: "gpl-2.0", 2: "lgpl", 3: "bsd", 4: "mit", 5: None}
    at = {i: [(n["paragraph"], n["family"]) for n in r["notices"] if n["confirmed"]] for i, r in got.items()}
    assert at == {1: [(2, "gpl-2.0")], 2: [(0, "lgpl")], 3: [(30, "bsd")], 4: [(0, "mit")], 5: [], 6: [(0, "mit"), (1, "bsd")]}


def brute_nearest(rows, query, k):
    own = next(v for i, v in rows if i == query)
    score = lambda v: float(np.dot(own, v) / (np.linalg.norm(own) * np.linalg.norm(v)))
    return sorted(((i, score(v)) for i, v in rows if i != query), key=lambda x: (-round(x[1], 12), x[0]))[:k]


@pytest.mark.parametrize("part_rows, block", [(1 << 16, 1 << 12), (200, 9)])
def test_forest_recall_ties_and_odd_vectors(spark, monkeypatch, part_rows, block):
    monkeypatch.setattr(rp_forest, "PART_ROWS", part_rows)
    monkeypatch.setattr(rp_forest, "BLOCK_QUERIES", block)
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(16).astype(np.float32).tolist()) for i in range(1500)]
    rows += [(i, rows[7][1]) for i in range(1500, 1900)]
    odd = [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] + [1.0] * 15), (2004, [1.0] * 3), (2050, []), (None, [1.0] * 16), (3, rows[3][1]), (2005, [float("inf")] * 16)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = {}
    for r in rp_forest.search(table, table.filter("vec_id % 50 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 1900, 50))
    arrays = [(i, np.array(v)) for i, v in rows]
    hits = 0
    for query, own in got.items():
        assert [r for r, _, _ in sorted(own)] == [1, 2, 3, 4, 5]
        want = brute_nearest(arrays, query, 5)
        hits += len({i for i, _ in want} & {i for _, i, _ in own})
        scores = dict(arrays)
        for _, i, s in own:
            assert s == pytest.approx(float(np.dot(scores[query], scores[i]) / np.linalg.norm(scores[query]) / np.linalg.norm(scores[i])), abs=1e-12)
    assert hits / (5 * len(got)) >= 0.9
    assert [i for _, i, _ in sorted(got[1500])] == [7, 1501, 1502, 1503, 1504]


def test_forest_of_few_or_no_rows(spark):
    table = spark.createDataFrame([(0, [1.0, 2.0]), (50, [2.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = rp_forest.search(table, table.filter("vec_id % 50 = 0")).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [(0, 1, 3), (0, 2, 50), (50, 1, 3), (50, 2, 0)]
    assert rp_forest.search(table.limit(0), table.limit(0)).collect() == []


def test_forest_scales_tiny_and_huge_vectors(spark):
    own = [1.0, 2.0, 3.0]
    rows = [(50, [x * 1e-200 for x in own])]
    # Copies scaled by powers of two have equal scores, so the smaller ids win.
    rows += [(i, [x * 2.0 ** (40 * i - 400) for x in own]) for i in range(1, 20)]
    rows += [(100, [x * 1e200 for x in own]), (30, [1.0, 2.0, 2.0]), (31, [-1.0, 0.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in rp_forest.search(table, table.filter("vec_id % 50 = 0"), k=30).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for query in (50, 100):
        own_rows = sorted(got[query])
        assert len(own_rows) == len(rows) - 1 and all(math.isfinite(s) and -1 <= s <= 1 + 1e-12 for _, _, s in own_rows)
        assert [i for _, i, _ in own_rows[-2:]] == [30, 31]
    few = rp_forest.search(table.filter("vec_id < 20 or vec_id = 50"), table.filter("vec_id = 50")).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2, 3, 4, 5]


def test_calibration_predicts_once(spark):
    """Two predictions in one task would need two workers, which stay for all later stages."""
    model = language_id.fit({"de": {"und": 3, "der": 2}, "en": {"and": 3, "the": 2}})
    held = spark.createDataFrame([("de", "der und der"), ("en", "the and"), ("en", "der"), ("de", "")], "lang string, text string")
    found = language_id._calibration(model, held)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert {r["lang"] for r in found.collect()} == {"de", "en"}
