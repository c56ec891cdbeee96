"""Tables may be folders of part files, as a cluster writes them, or hold no row at all."""

import pytest

from tidemark import plans
from tidemark.session import work_path
from tidemark.sources import testmodel as m
from tidemark.sources.readers import parquet_stream
from tidemark.streaming import jobs


@pytest.fixture(scope="module")
def folders(spark, sf, tmp_path_factory):
    """The same tables, each in three part files."""
    to = tmp_path_factory.mktemp("folders")
    for name in ("documents", "events", "orders", "lineitem"):
        spark.read.parquet(f"{sf}/{name}.parquet").repartition(3).write.parquet(f"{to}/{name}.parquet")
    return str(to)


@pytest.mark.parametrize("name", ["s4_stream_entities", "s4_stream_neighbors", "s2_stream_minutes", "s6_cdc_loop"])
def test_a_stream_reads_a_folder_of_files(spark, sf, folders, name):
    of_files, of_folders = (sorted(map(tuple, plans.all_queries()[name](spark, at).collect())) for at in (sf, folders))
    assert of_files == of_folders and of_files


def test_an_index_of_nothing_is_empty(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    source, folder = str(tmp_path / "documents.parquet"), work_path(spark, "none")
    documents = parquet_stream(spark, source, m.table(spark, sf, "documents").schema)
    jobs.refresh_indexes(m.chunks_from_documents(documents), folder).awaitTermination()
    views = jobs.index_views(spark, folder)
    assert {name: view.count() for name, view in views.items()} == {"entities": 0, "triples": 0, "neighbors": 0}
    assert views["neighbors"].columns == ["tenant_id", "corpus_id", "src_chunk", "neighbor_chunks"]
