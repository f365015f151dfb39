import json

import pytest
from pyspark.sql import functions as F

from gleaner.operators import splits
from gleaner.sources import corpus, files


def test_folder_ingest(spark, tmp_path):
    folder = tmp_path / "notes"
    (folder / "b").mkdir(parents=True)
    (folder / "b.md").write_text("# One\nbody\n# Two\n| a |\n| b |\n")
    (folder / "b" / "z.TXT").write_bytes(b"para one\n\npara \xfftwo")
    (folder / "skip.pdf").write_text("x")
    got = {r.chunk_id: r for r in files.chunk_local_folder(spark, str(folder)).collect()}
    assert sorted(got) == ["adhoc-000-z::c0", "adhoc-000-z::c1", "adhoc-001-b::c0", "adhoc-001-b::c1"]
    assert got["adhoc-000-z::c1"].text == "para two" and got["adhoc-001-b::c1"].source_type == "table"
    assert got["adhoc-001-b::c0"].heading == "One" and got["adhoc-001-b::c0"].doc_chunk_count == 2
    with pytest.raises(ValueError):
        files.chunk_local_folder(spark, str(tmp_path / "missing"))
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "x.pdf").write_text("x")
    with pytest.raises(ValueError):
        files.chunk_local_folder(spark, str(tmp_path / "empty"))


def test_documents_labels_and_pricing(spark, tmp_path):
    docs = tmp_path / "documents"
    docs.mkdir()
    chunk = {"chunk_id": "a::x", "position": 0, "doc_chunk_count": 1, "heading": "H", "source_type": "prose", "text": "t"}
    for name, title in (("1", "first"), ("2", "last")):
        (docs / f"{name}.json").write_text(json.dumps({"doc_id": "a", "title": title, "doc_type": "faq", "chunks": [chunk]}, indent=2))
    rows = files.load_all_chunks(spark, str(docs)).collect()
    assert [(r.chunk_id, r.doc_title) for r in rows] == [("a::x", "last")]

    label = lambda q, t, c, rel: json.dumps({"question_id": q, "question_text": t, "doc_id": "a", "chunk_id": c, "relevant": rel})
    (tmp_path / "labels.jsonl").write_text("\n".join([label("q1", "T", "a::x", True), "", label("q1", "other", "a::y", True), label("q2", "U", "a::x", False)]))
    got = files.load_question_labels(spark, str(tmp_path / "labels.jsonl")).collect()
    assert [(r.question_id, r.question_text, r.relevant_chunk_ids, r.relevant_doc_ids) for r in got] == [("q1", "T", ["a::x", "a::y"], ["a"])]

    price = {"pricing_version": "v", "providers": {"p": {"source": "s", "models": {"m": {"input_per_million": 1.5, "output_per_million": 2}}}}}
    (tmp_path / "prices.json").write_text(json.dumps(price, indent=1))
    assert tuple(files.load_pricing(spark, str(tmp_path / "prices.json")).first()) == ("p", "m", 1.5, 2.0, "v")


def test_corpus_round_trip(spark, tmp_path):
    root, models = str(tmp_path / "corpora"), str(tmp_path / "models")
    entries = spark.createDataFrame(
        [("d1", "Title", "faq", [("a", "H", "text a", None), ("b", None, "text b", "code")])],
        "doc_id string, title string, doc_type string, chunks array<struct<suffix:string,heading:string,text:string,source_type:string>>",
    )
    asked = spark.createDataFrame([("q1", "why?")], "query_id string, query_text string")
    proof = spark.createDataFrame([("q1", "d1", "b")], "query_id string, doc_id string, suffix string")
    corpus.write_corpus(spark, root, "demo", "Demo", "About", entries, asked, proof)
    spec = corpus.resolve_corpus(spark, root, models, "demo")
    assert spec.display_name == "Demo" and spec.labeled and [c.corpus_id for c in corpus.list_corpora(spark, root, models)] == ["demo"]
    chunks = {r.chunk_id: r for r in files.load_all_chunks(spark, spec.documents, multi_line=False).collect()}
    assert chunks["d1::a"].source_type == "faq" and chunks["d1::b"].source_type == "code" and chunks["d1::b"].position == 1
    assert files.load_question_labels(spark, spec.labels).first().relevant_chunk_ids == ["d1::b"]
    with pytest.raises(corpus.UnknownCorpusError):
        corpus.resolve_corpus(spark, root, models, "nope")
    own = corpus.ad_hoc_corpus(spark, root, models, "/data/my notes", "demo")
    assert not own.labeled and own.artifacts == spec.artifacts and own.display_name == "my notes"
    for bad in (entries.union(entries), entries.limit(0)):
        with pytest.raises(ValueError):
            corpus.write_corpus(spark, root, "bad", "B", "", bad, asked, proof)


def test_persisted_splits(spark, tmp_path):
    docs = splits.split_by_document(spark.createDataFrame([(f"d{i}", "en") for i in range(10)], "doc_id string, doc_type string"))
    asked = spark.createDataFrame([(1, "train"), (2, None)], "query_id long, split string")
    corpus.persist_splits(str(tmp_path / "s"), docs, asked)
    d, q = files.load_splits(spark, str(tmp_path / "s"))
    assert d.select(*docs.columns).exceptAll(docs).isEmpty()
    assert {r.query_id: r.split for r in q.collect()} == {1: "train", 2: None}
    members = splits.membership(d, q).groupBy("split").agg(F.count("*").alias("n")).collect()
    assert {r.split: r.n for r in members} == {"train": 7, "val": 2, "test": 2, "excluded": 1}


def test_malformed_input_raises(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.json").write_text('{"doc_id": "a", "chunks": []}')
    (tmp_path / "docs" / "b.json").write_text('{"doc_id": "b", "chunks": [')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.load_documents(spark, str(tmp_path / "docs")).collect()
    (tmp_path / "labels.jsonl").write_text('{"question_id": "q", "question_text": "t", "relevant": true}\n{"question_id":\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.load_label_rows(spark, str(tmp_path / "labels.jsonl")).collect()


def test_evidence_of_unknown_questions_is_a_violation(spark):
    docs = spark.createDataFrame([("d",)], "doc_id string")
    asked = spark.createDataFrame([("q",)], "query_id string")
    proof = spark.createDataFrame([("q", "d"), ("other", "d")], "query_id string, doc_id string")
    assert [tuple(r) for r in corpus.corpus_violations(docs, asked, proof).collect()] == [("unknown question", "other")]
