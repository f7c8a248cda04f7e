"""Queries leave no table in the shared folder but those that their lazy result still reads."""

from pathlib import Path
from urllib.parse import unquote

import pytest

from reviewloom.plans import registry
from reviewloom.sources import scratch

from conftest import DATA

WRITING = ["path_tfidf", "text_tfidf_stemmed", "pca_path_features", "sparse_path_features", "review_text_tfidf", "graph_nodes", "remove_node", "pareto_front", "latent_factors", "communities", "louvain_score", "corpus_files", "tagged_test_file", "json_array_file", "report_sheets", "settings_files"]


@pytest.mark.parametrize("name", WRITING)
def test_only_what_is_read_stays(name, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "shared_dir", lambda _: f"file://{tmp_path}")
    got = registry.QUERIES[name](spark, DATA)
    read = ["/" + unquote(f).removeprefix("file:").lstrip("/") for f in got.inputFiles()]
    stay = sorted(p for p in Path(tmp_path).iterdir() if not p.name.startswith("."))
    assert [p.name for p in stay if not any(f.startswith(str(p)) for f in read)] == []
    assert got.count() > 0


def test_results_know_their_tables(spark):
    made = scratch.written(spark.range(3).toDF("x"), "made")
    result = scratch.reads(made.where("x > 1"), made)
    assert result.count() == 1
    scratch.drop_written(result, None)
    with pytest.raises(Exception, match="FILE_NOT_EXIST|PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(made._reviewloom_paths[0]).count()
