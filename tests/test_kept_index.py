import pytest

from gleaner.operators import kept_index, retrieval
from gleaner.sources import versions
from tests.test_retrieval import QUERIES, brute, corpus, ranked


def test_growing_index_ranks_like_one_built_at_once(spark, tmp_path):
    rows, folder = corpus(), str(tmp_path / "index")
    queries = spark.createDataFrame(QUERIES, "query_id long, query_text string")
    kept_index.create(spark, folder, "me")
    with pytest.raises(ValueError, match="nothing is indexed"):
        kept_index.load(spark, folder)
    for part in (rows[:25], rows[25:26], rows[26:]):
        kept_index.add(spark.createDataFrame(part, "chunk_id string, text string"), folder)
        so_far = rows[: rows.index(part[-1]) + 1]
        assert ranked(kept_index.retrieve(spark, queries, folder)) == brute(so_far, QUERIES, 12)
    versions.allocate_next_version(spark, f"{folder}/versions")  # a writer that died
    versions.allocate_next_version(spark, f"{folder}/segments")
    found = kept_index.load(spark, folder)
    assert found.about["chunks"] == len(rows) and len(found.about["segments"]) == 3
    assert ranked(retrieval.retrieve(queries, found)) == brute(rows, QUERIES, 12)
    with pytest.raises(PermissionError):
        kept_index.drop(spark, folder, "you")
    kept_index.drop(spark, folder, "me")
    assert not (tmp_path / "index").exists()


def test_a_query_reads_the_buckets_of_its_terms(spark, tmp_path):
    folder = str(tmp_path / "index")
    kept_index.create(spark, folder, "me")
    kept_index.add(spark.createDataFrame(corpus(), "chunk_id string, text string"), folder)
    asked = spark.createDataFrame([("alpha",)], "term string")
    plan = kept_index.load(spark, folder).rows_for(asked)._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "(bucket#" in filters and "ReadSchema: struct<term:string,chunk_no:bigint,tf:int>" in plan


def test_an_index_has_a_lifetime(spark, tmp_path):
    folder = str(tmp_path / "index")
    kept_index.create(spark, folder, "me", days=-1)
    kept_index.add(spark.createDataFrame([("a", "alpha"), ("b", None), ("c", "the of")], "chunk_id string, text string"), folder)
    with pytest.raises(ValueError, match="expired"):
        kept_index.load(spark, folder)


def test_no_pair_of_query_and_chunk_leaves_a_task(spark, tmp_path, monkeypatch):
    rows = corpus() + [(f"same{i:03d}", "alpha beta alpha") for i in range(60)]  # more equal chunks than places
    folder = str(tmp_path / "index")
    kept_index.create(spark, folder, "me")
    for part in (rows[::2], rows[1::2]):
        kept_index.add(spark.createDataFrame(part, "chunk_id string, text string"), folder)
    asked = [*QUERIES, (900, "alpha beta alpha"), (901, "beta")]
    queries = spark.createDataFrame(asked, "query_id long, query_text string")
    joined = ranked(retrieval.retrieve(queries, kept_index.load(spark, folder), query_block=0))

    def pairs(*args, **options):
        raise AssertionError("a row per pair")

    monkeypatch.setattr(retrieval, "scores", pairs)
    monkeypatch.setattr(retrieval, "POSTING_BLOCK", 7)  # chunks cross the batches
    found = ranked(kept_index.retrieve(spark, queries, folder))
    assert found == joined == brute(rows, asked, 12)
