"""Registered queries: JSON-lines sources and sinks (A4–A7) over the review
tables and the request log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import review as rv
from ..session import scratch_path
from ..sources import fixtures
from ..sources import io as fio, table_log
from ..sources.fixtures import with_views
from .registry import query

_Q = ["review_queue", "validated"]
QUEUE_SCHEMA = "sample_id string, seq long, batch_id long, ts timestamp, model_version string, prediction string, duration double, review_status string"


@query("read_jsonl", group="A", oracle=with_views("select sample_id, seq from review_queue order by seq desc limit 100", *_Q))
def q_read_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue written as JSON lines, read back with its declared schema; the
    newest 100 records (the reader's optional last-N)."""
    path = scratch_path(spark, "queue-jsonl")
    fixtures.review_queue(spark, sf_dir).write.json(path)
    back = fio.read_jsonl(spark, path, QUEUE_SCHEMA, last=100, order_col="seq")
    return back.select("sample_id", "seq")


@query("append_jsonl", group="A", oracle=with_views("select sample_id, seq, review_status from review_queue", *_Q))
def q_append_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends (even and odd batches) to one table of commits; a reader
    sees the union."""
    path = scratch_path(spark, "queue-append")
    q = fixtures.review_queue(spark, sf_dir)
    table_log.append(q.filter((F.col("batch_id") / 4) % 2 == 0), path)
    table_log.append(q.filter((F.col("batch_id") / 4) % 2 == 1), path)
    return table_log.read(spark, path, QUEUE_SCHEMA).select("sample_id", "seq", "review_status")


@query(
    "rewrite_jsonl",
    group="A",
    oracle=with_views(
        """select sample_id, seq from validated v where not exists (select 1 from validated p where p.review_status = 'approved' and p.validated_label <> ''
  and p.duration is not null and p.sample_id is not distinct from v.sample_id)""",
        *_Q,
    ),
)
def q_rewrite_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The validated table minus processed records replaces it as the next
    commit; the rows being read stay where they are."""
    base = scratch_path(spark, "validated")
    v = fixtures.validated(spark, sf_dir)
    at = table_log.append(v, base)
    current = table_log.read(spark, base, v.schema)
    table_log.replace(rv.archive(current, rv.approved(current, input_col="duration")), base, expected=at)
    return table_log.read(spark, base, v.schema).select("sample_id", "seq")


@query(
    "read_requests_stream",
    group="A",
    oracle=with_views("select seq, endpoint, http_status, duration from requests", "requests"),
)
def q_read_requests_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request batches (arrays of records, 4 per batch) as JSON files read by
    a file stream; the batch array is exploded to rows (availableNow run)."""
    from ..streaming import sources as ss

    return ss.request_batches_roundtrip(spark, fixtures.requests(spark, sf_dir)).select("seq", "endpoint", "http_status", "duration")
