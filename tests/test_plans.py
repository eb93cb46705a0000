"""What the plans look like: no Python in native operators, few shuffles, pruned scans."""

import pytest

from conftest import SMALL
from workload.queries import QUERIES

PYTHON = ("BatchEvalPython", "ArrowEvalPython", "MapInArrow", "MapInPandas", "FlatMapGroupsInPandas", "PythonUDF")
PYTHON_QUERIES = {"chunk_exact", "hash_embed", "npy_export", "base64_export"}


def plan(spark, name: str) -> str:
    return QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["normalize_text", "sentences", "chunk_pack", "chunk_for_model", "row_text", "truncate_text", "decode_text"])
def test_row_local_operators_do_not_shuffle(spark, name):
    text = plan(spark, name)
    # The only exchange spreads the few rows of a single input file.
    assert text.count("Exchange hashpartitioning") == text.count("REPARTITION_BY_NUM")
    assert "CartesianProduct" not in text and not any(p in text for p in PYTHON)


def test_row_chunks_shuffle_once(spark):
    text = plan(spark, "row_split")
    assert text.count("Exchange hashpartitioning") - text.count("REPARTITION_BY_NUM") == 1
    assert "BroadcastHashJoin" in text


def test_scan_reads_only_what_is_needed(spark):
    text = plan(spark, "token_counts")
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


@pytest.mark.parametrize("name", sorted(set(QUERIES) - PYTHON_QUERIES - {"incremental_ingest", "delimited_round_trip"}))
def test_native_queries_stay_in_the_jvm(spark, name):
    text = plan(spark, name)
    assert not any(p in text for p in PYTHON)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
