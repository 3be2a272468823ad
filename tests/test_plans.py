"""Scale properties visible in the physical plans."""

import contextlib
import glob
import io
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from lexigen import session
from lexigen.plans import catalog as C


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_scans_are_pruned_and_filtered(spark):
    plan = _plan(C.q_training_rollup(spark, SF_SMALL))
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,value:double>" in plan
    plan = _plan(C.q_pairs(spark, SF_SMALL))
    assert "EqualTo(role,user)" in plan and "EqualTo(role,assistant)" in plan


def test_top_k_vocabulary_keeps_k_rows_per_partition(spark):
    plan = _plan(C.q_vocab(spark, SF_SMALL))
    assert "TakeOrderedAndProject" in plan
    assert "ReadSchema: struct<text:string>" in plan
    assert "partial_count" in plan  # map-side combine before the shuffle


def test_summary_is_one_partial_and_final_aggregate(spark):
    plan = _plan(C.q_eval_summary(spark, SF_SMALL))
    assert plan.count("HashAggregate") >= 2 and "partial_avg" in plan
    assert "MapInPandas" not in plan  # generation ships only the prompt column


def test_generation_and_parsing_add_no_shuffle(spark):
    plan = _plan(C.q_judge_scores(spark, SF_SMALL))
    physical = plan.split("\n\n")[0]
    tail = physical.split("BroadcastHashJoin")[0]
    assert "Exchange" not in tail


def test_split_shuffles_no_row(spark):
    """The labelled rows come straight from the scan: rows are compared with the cut, not moved."""
    from lexigen.operators import split as SP

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    plan = _plan(SP.exact_split(docs.select("doc_id", "text"), "doc_id"))
    assert "Exchange" not in plan and "Window" not in plan
    assert "text:string" in plan


def test_rank_moves_whole_rows_once(spark):
    from lexigen.operators import split as SP

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    plan = _plan(SP.global_rank(docs, "doc_id"))
    moved = [part for part in plan.split("\n\n") if ") Exchange" in part.split("\n")[0] and "__row" in part]
    assert 1 <= len(moved) <= 2  # the collapse, and the copies dealt out
    assert not any("SinglePartition" in part for part in moved)  # only the ranges' sizes meet in one task


def test_vocabulary_ids_do_not_shuffle(spark):
    from lexigen.operators import sft as S

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    vocab = spark.createDataFrame([("the", 4), ("of", 5)], "token string, token_id int")
    assert "Exchange" not in _plan(S.vocab_ids(docs, "doc_id", "text", vocab))
    assert "Exchange" not in _plan(S.sft_examples(docs.selectExpr("doc_id AS case_id", "text AS prompt", "lang AS response")))


def test_epochs_add_no_shuffle(spark):
    """Rows are ranked once; each epoch's order is reckoned in place."""
    from lexigen.operators import split as SP

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    plans = [_plan(SP.assign_batches(docs, "doc_id", 6, epochs)) for epochs in (1, 9)]
    headers = [[part.split("\n")[0].split(") ")[-1] for part in plan.split("\n\n") if ") Exchange" in part.split("\n")[0]] for plan in plans]
    assert headers[0] == headers[1]
    moved = [part for part in plans[1].split("\n\n") if ") Exchange" in part.split("\n")[0] and "__row#" in part]
    assert 1 <= len(moved) <= 2


@pytest.fixture()
def one_group(spark, tmp_dir, monkeypatch):
    """Conversations of 3,000 turns in one row group, read as more splits than cores: all but one of them are empty."""
    rows = [(i // 6, i % 6, "user" if i % 2 == 0 else "assistant", f"Word {i} of w{i % 7}. Then w{i % 5} and {i}.") for i in range(3000)]
    t = pa.table({k: [r[j] for r in rows] for j, k in enumerate(("conv_id", "turn", "role", "text"))})
    pq.write_table(t, f"{tmp_dir}/conversations.parquet", row_group_size=10_000, compression="none")
    monkeypatch.setattr(session, "TASK_ROWS", 100, raising=False)
    for k, v in (("maxPartitionBytes", "4k"), ("openCostInBytes", "1")):
        spark.conf.set(f"spark.sql.files.{k}", v)
    yield tmp_dir
    for k in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.unset(f"spark.sql.files.{k}")


def _most(df) -> int:
    return max(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())


def test_predictions_are_dealt_over_tasks(spark, one_group):
    """F2: what is scored does not stand in the task that read the file."""
    preds = C.predictions(spark, one_group)
    assert preds.count() == 3000 and preds.select("model", "case_id").distinct().count() == 3000
    assert _most(preds) <= 100
    summary = C.q_eval_summary(spark, one_group)
    assert {r.n_samples for r in summary.collect()} == {1500}


def test_scored_rows_are_dealt_over_tasks(spark, one_group):
    """each row is scored in the task that its case was dealt to."""
    detail = C.q_eval_detail(spark, one_group)
    assert detail.count() == 3000 and _most(detail) <= 100


def test_judged_rows_are_dealt_over_tasks(spark, one_group):
    """a Python worker gets no more rows at once than a task has."""
    scores = C.q_judge_scores(spark, one_group)
    assert scores.count() == 1500 and _most(scores) <= 100


def test_report_is_scored_by_many_tasks(spark, one_group, tmp_dir, monkeypatch):
    """the stored detail holds every row, in files of one task each."""
    monkeypatch.setattr(C, "scratch_path", lambda spark, name: f"{tmp_dir}/{name}")
    assert {r.n_samples for r in C.q_report(spark, one_group).collect()} == {1500}
    detail = spark.read.parquet(f"{tmp_dir}/report/detail")
    assert detail.count() == 3000
    stored = glob.glob(f"{session.checkpoint_dir(spark).removeprefix('file:')}/lexigen/report-*")
    rows = [r["count"] for r in spark.read.parquet(max(stored, key=os.path.getmtime)).groupBy(F.input_file_name()).count().collect()]
    assert sum(rows) == 3000 and max(rows) <= 100
