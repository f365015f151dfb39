import sys
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from gleaner.llm import language_id, substring_dedup  # noqa: E402
from tests.llm.test_dedup import brute_components, brute_print  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def brute_substrings(rows):
    """Texts by id after the same rule, over plain dictionaries."""
    first, found = {}, {}
    for i, text in sorted(rows.items()):
        starts, sizes, hashes = substring_dedup.sentences(text)
        found[i] = [(int(h), a, b) for a, b, h in zip(*substring_dedup.runs(sizes, hashes), strict=True)], starts
        for k, (h, a, _) in enumerate(found[i][0]):
            first.setdefault(h, (i, a))
    out = {}
    for i, (own, starts) in found.items():
        lost = {s for h, a, b in own if first[h] != (i, a) for s in range(a, b)}
        out[i] = "".join(rows[i][starts[s] : starts[s + 1]] for s in range(len(starts) - 1) if s not in lost) if lost else rows[i]
    return out


def test_pipeline_matches_stage_by_stage_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language_id.train(docs)
    kept = {r["doc_id"]: r["text"] for r in language_id.identify(docs, model).filter("not language.rejected").collect()}
    assert len(kept) >= 0.95 * docs.count()
    by_text = {}
    for i in sorted(kept):
        by_text.setdefault(" ".join(kept[i].split(" ")) if "\t" not in kept[i] else kept[i], i)
    import re

    firsts = {}
    for i in sorted(kept):
        firsts.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", kept[i]), i)
    ids = sorted(firsts.values())
    roots = brute_components([brute_print(kept[i]) for i in ids])
    ids = [i for k, i in enumerate(ids) if roots[k] == k]
    texts = brute_substrings({i: kept[i] for i in ids})
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter({i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()})
    got = Counter()
    rows = corpus_pipeline.run(spark, SMALL).collect()
    for r in rows:
        got[r["doc_id"]] += r["length"]
    assert got == want
    filled = Counter()
    for r in rows:
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= 1024 and np.mean(list(filled.values())) > 900


def test_stages_keep_the_columns_and_take_odd_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (10**6, "", "en", "s", 0), (10**6 + 1, None, None, None, None)], docs.schema
    )
    mixed = docs.unionByName(odd).unionByName(docs.limit(5))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        mixed = stage(spark, mixed, SMALL)
        assert mixed.columns == docs.columns
    assert mixed.count() > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SMALL).count() == 0
