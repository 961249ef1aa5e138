"""Input views over the driver tables (see FIXTURES.md).

Each view exists twice: as a Spark plan over the parquet tables and as DuckDB
SQL text that the oracles put in a ``WITH`` clause. The Spark side is the one
that runs at scale; the SQL side is the independent check.

``flows`` is the labelled wide table. Its split cuts each stratum (``class3``)
in hash order (``operators.sampling``: no row is shuffled or ranked), and the
result is written once as a table partitioned by ``split`` (the
``write_splits`` sink), which later reads prune by partition.
"""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sampling import stratified_split
from ..session import prepare, scratch_path

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

SPLIT_SEED = "42"
TEST_SHARE = 0.15
VAL_SHARE = 0.15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------------------
# flows
# ---------------------------------------------------------------------------


_LINES = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def _flows_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with what they take from parts, orders and customers, in the
    columns of the tables. Customers meet the orders, of which there are fewer;
    lines are shuffled twice and end sorted by order, where the columns of an
    order repeat and cost little when written. The plan is the same at any
    size, so its cost per row is too."""
    l = table(spark, sf_dir, "lineitem").select(*_LINES).where("l_orderkey is not null and l_partkey is not null")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority").where("o_orderkey is not null and o_custkey is not null")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice").where("p_partkey is not null")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment").where("c_custkey is not null")
    bought = o.join(c.hint("merge"), o.o_custkey == c.c_custkey).drop("o_custkey", "c_custkey")
    lines = l.join(p.hint("merge"), l.l_partkey == p.p_partkey).drop("p_partkey")
    return lines.join(bought.hint("merge"), lines.l_orderkey == bought.o_orderkey).drop("o_orderkey")


def _flows_unsplit(base: DataFrame) -> DataFrame:
    """Labels and features of the joined lines, from expressions alone."""
    sample_id = F.concat_ws(
        "-",
        F.col("l_orderkey").cast("string"),
        F.col("l_partkey").cast("string"),
        F.col("l_suppkey").cast("string"),
        F.col("l_linenumber").cast("string"),
        F.round(F.col("l_extendedprice") * 100).cast("long").cast("string"),
    )
    rf, ls = F.col("l_returnflag"), F.col("l_linestatus")
    normal = rf == "N"
    class1 = F.when(normal, "normal").otherwise(F.concat(F.lower(rf), F.lit("_"), F.lower(ls)))
    class2 = F.when(normal, "normal").when(rf == "A", "cat_a").otherwise("cat_r")
    class3 = F.when(normal, "normal").otherwise("attack")
    attack = class3 == "attack"
    load_avg = F.col("l_quantity") + F.when(attack, 15.0).otherwise(0.0)
    ln = F.col("l_linenumber")
    return base.select(
        sample_id.alias("sample_id"),
        class1.alias("class1"),
        class2.alias("class2"),
        class3.alias("class3"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("extendedprice"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.col("p_size").cast("double").alias("part_size"),
        F.col("p_retailprice").alias("retailprice"),
        F.col("o_totalprice").alias("order_total"),
        F.col("c_acctbal").alias("acctbal"),
        load_avg.alias("load_avg"),
        (F.col("l_extendedprice") * F.when(attack, 1.25).otherwise(1.0)).alias("byte_volume"),
        (load_avg * 2.0 + F.col("l_tax")).alias("load_avg_dup"),
        (F.col("l_discount") + F.when(class2 == "cat_r", 0.02).otherwise(0.0)).alias("miss_rate"),
        (rf == "R").cast("int").alias("is_reverse"),
        F.lit(1.0).alias("const_col"),
        F.when(ln == 1, F.col("l_quantity"))
        .when((class2 == "cat_a") & (ln == 2), F.col("l_quantity") * 3)
        .otherwise(0.0)
        .alias("sparse_count"),
        F.when(ln == 7, "-")
        .when((ln == 6) & (F.col("l_tax") > 0.05), "?")
        .when((ln == 5) & (F.col("l_tax") > 0.07), "NaN")
        .otherwise(F.col("l_quantity").cast("string"))
        .alias("raw_metric"),
        F.when(ls == "F", "True").otherwise("False").alias("raw_flag"),
        F.when((ln == 4) & (F.col("l_discount") > 0.08), "?").otherwise(F.upper("c_mktsegment")).alias("raw_proto"),
        F.col("o_orderpriority").alias("service"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
    )


def build_flows(spark: SparkSession, sf_dir: str, base: DataFrame | None = None) -> DataFrame:
    """Flows plan (with ``split``); ``base`` holds the joined lines."""
    df = _flows_unsplit(base if base is not None else _flows_joined(spark, sf_dir))
    out = stratified_split(df, "sample_id", "class3", TEST_SHARE, VAL_SHARE, SPLIT_SEED)
    first = ["sample_id", "class1", "class2", "class3", "split"]
    return out.select(*first, *[c for c in df.columns if c not in first])


_memo: dict[tuple, DataFrame] = {}
_lock = threading.Lock()


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``flows`` written once per application as a table partitioned by
    ``split`` under the shared checkpoint folder, then read back (pruning,
    pushdown and a cut lineage for every query that uses it)."""
    prepare(spark)
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), "flows")
    with _lock:
        if key not in _memo:
            path = scratch_path(spark, "flows")
            # the split reads the joined rows several times (histograms of the
            # hash, then the cut): they are written once to the shared folder,
            # in the columns of the tables, which take less than what is made of them
            joined = scratch_path(spark, "flows-joined")
            _flows_joined(spark, sf_dir).write.option("compression", "zstd").parquet(joined)
            build_flows(spark, sf_dir, spark.read.parquet(joined)).write.mode("overwrite").option("compression", "zstd").partitionBy("split").parquet(path)
            df = spark.read.parquet(path)
            cols = [c for c in df.columns if c != "split"]
            order = cols[:4] + ["split"] + cols[4:]
            _memo[key] = df.select(*order)
        return _memo[key]


def flow_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """class1, class2 and class3 of every row of ``flows``. They come from the
    lines alone, so where the table isn't written yet the joined lines are
    read in the few columns needed, and neither split nor written."""
    prepare(spark)
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), "flows")
    df = _memo[key] if key in _memo else _flows_unsplit(_flows_joined(spark, sf_dir))
    return df.select("class1", "class2", "class3")


# ---------------------------------------------------------------------------
# request log and derived review tables
# ---------------------------------------------------------------------------


def requests(spark: SparkSession, sf_dir: str, failed_only: bool = False) -> DataFrame:
    """Request log view; ``failed_only`` keeps status >= 400, stated on the
    raw column so the filter reaches the parquet scan (pushed filter)."""
    prepare(spark)
    e = table(spark, sf_dir, "events")
    if failed_only:
        e = e.filter(F.col("event_type") == "error")
    et = F.col("event_type")
    endpoint = F.when(et == "view", "/metrics").when(et == "signup", "/health").otherwise(F.concat(F.lit("/"), et))
    return e.select(
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("source_id"),
        F.lit("POST").alias("method"),
        endpoint.alias("endpoint"),
        F.when(et == "error", 500).otherwise(200).alias("http_status"),
        (F.col("value") / 50.0).alias("duration"),
        F.col("props"),
    )


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = requests(spark, sf_dir, failed_only=True)
    return r.select(
        F.concat(F.lit("s"), F.col("seq").cast("string")).alias("sample_id"),
        "seq",
        (F.col("seq") - F.col("seq") % 4).alias("batch_id"),
        "ts",
        F.lit("RF_v1").alias("model_version"),
        F.substring("endpoint", 2, 1 << 20).alias("prediction"),
        "duration",
        F.lit("pending").alias("review_status"),
    )


def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = review_queue(spark, sf_dir).filter(F.col("seq") % 3 == 0)
    return q.select(
        "sample_id",
        "seq",
        "duration",
        F.when(F.col("seq") % 5 == 0, "rejected").otherwise("approved").alias("review_status"),
        F.when(F.col("seq") % 7 == 0, "").otherwise("normal").alias("validated_label"),
    )


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = review_queue(spark, sf_dir)
    return q.select(
        F.col("seq").alias("submit_seq"),
        F.when(F.col("seq") % 11 == 0, F.concat(F.lit("x"), F.col("seq").cast("string"))).otherwise(F.col("sample_id")).alias("sample_id"),
        F.when(F.col("seq") % 13 == 0, "unknown").otherwise("  Normal ").alias("validated_label"),
    )


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rule-based pseudo-models per flow row (``explode`` of the model
    names: a generator, not a join)."""
    f = flows(spark, sf_dir)
    k = (F.round(F.col("extendedprice") * 100).cast("long") % 100).alias("k")
    x = f.select("sample_id", "split", "class1", "class2", "class3", k).withColumn(
        "model", F.explode(F.array(F.lit("rule_a"), F.lit("rule_b")))
    )
    kk, m = F.col("k"), F.col("model")
    pred = (
        F.when((m == "rule_a") & (kk < 70), F.col("class1"))
        .when((m == "rule_b") & (kk < 55), F.col("class1"))
        .when(kk < 85, "normal")
        .when(kk < 95, "r_f")
        .otherwise("a_o")
    )
    bonus = F.when((F.col("class3") == "attack") & (m == "rule_a"), 0.4).when(F.col("class3") == "attack", 0.2).otherwise(0.0)
    return x.select(
        "sample_id",
        "split",
        F.col("class1").alias("true_type"),
        F.col("class2").alias("true_cat"),
        F.col("class3").alias("true_bin"),
        "model",
        pred.alias("pred_type"),
        (((kk * 7) % 41).cast("double") / 41.0 + bonus).alias("score"),
    )


def labelled_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    lab = table(spark, sf_dir, "labels")
    return lab.join(d, "doc_id")


# ---------------------------------------------------------------------------
# DuckDB text of the same views (for oracle_sql)
# ---------------------------------------------------------------------------

FLOWS_SQL = """
with base as (
  select concat_ws('-', cast(l_orderkey as varchar), cast(l_partkey as varchar), cast(l_suppkey as varchar), cast(l_linenumber as varchar), cast(cast(round(l_extendedprice*100) as bigint) as varchar)) as sample_id,
    l.*, o.o_totalprice, o.o_orderpriority, p.p_size, p.p_retailprice, p.p_brand, c.c_acctbal, c.c_mktsegment
  from lineitem l join orders o on l.l_orderkey=o.o_orderkey join part p on l.l_partkey=p.p_partkey join customer c on o.o_custkey=c.c_custkey),
 lab as (select *, case when l_returnflag='N' then 'normal' else lower(l_returnflag)||'_'||lower(l_linestatus) end as class1,
  case when l_returnflag='N' then 'normal' when l_returnflag='A' then 'cat_a' else 'cat_r' end as class2,
  case when l_returnflag='N' then 'normal' else 'attack' end as class3,
  row_number() over (partition by case when l_returnflag='N' then 'normal' else 'attack' end order by md5(sample_id||'42'), sample_id) as rn,
  count(*) over (partition by case when l_returnflag='N' then 'normal' else 'attack' end) as n from base)
select sample_id, class1, class2, class3,
  case when rn <= round_even(n*0.15,0) then 'test' when rn <= round_even(n*0.30,0) then 'val' else 'train' end as split,
  l_quantity as quantity, l_extendedprice as extendedprice, l_discount as discount, l_tax as tax, cast(p_size as double) as part_size,
  p_retailprice as retailprice, o_totalprice as order_total, c_acctbal as acctbal,
  l_quantity + case when class3='attack' then 15.0 else 0.0 end as load_avg,
  l_extendedprice * case when class3='attack' then 1.25 else 1.0 end as byte_volume,
  (l_quantity + case when class3='attack' then 15.0 else 0.0 end)*2.0 + l_tax as load_avg_dup,
  l_discount + case when class2='cat_r' then 0.02 else 0.0 end as miss_rate, cast(l_returnflag='R' as integer) as is_reverse, cast(1.0 as double) as const_col,
  case when l_linenumber = 1 then l_quantity when class2='cat_a' and l_linenumber=2 then l_quantity*3 else 0.0 end as sparse_count,
  case when l_linenumber=7 then '-' when l_linenumber=6 and l_tax>0.05 then '?' when l_linenumber=5 and l_tax>0.07 then 'NaN' else cast(l_quantity as varchar) end as raw_metric,
  case when l_linestatus='F' then 'True' else 'False' end as raw_flag,
  case when l_linenumber=4 and l_discount>0.08 then '?' else upper(c_mktsegment) end as raw_proto,
  o_orderpriority as service, l_shipdate as ts from lab
"""

REQUESTS_SQL = """
select event_id as seq, cast(ts as timestamp) as ts, user_id as source_id, 'POST' as method,
  case event_type when 'view' then '/metrics' when 'signup' then '/health' else '/' || event_type end as endpoint,
  case when event_type = 'error' then 500 else 200 end as http_status,
  value / 50.0 as duration, props
from events
"""

PREDS_SQL = """
select sample_id, split, class1 as true_type, class2 as true_cat, class3 as true_bin, m.model,
  case when m.model = 'rule_a' and k < 70 then class1 when m.model = 'rule_b' and k < 55 then class1
       when k < 85 then 'normal' when k < 95 then 'r_f' else 'a_o' end as pred_type,
  cast((k * 7) % 41 as double) / 41.0 + case when class3 = 'attack' and m.model = 'rule_a' then 0.4 when class3 = 'attack' then 0.2 else 0.0 end as score
from (select f.*, cast(round(f.extendedprice * 100) as bigint) % 100 as k from flows f) x
cross join (select 'rule_a' as model union all select 'rule_b' as model) m
"""

REVIEW_QUEUE_SQL = """
select concat('s', cast(seq as varchar)) as sample_id, seq, seq - seq % 4 as batch_id, ts, 'RF_v1' as model_version,
  substr(endpoint, 2) as prediction, duration, 'pending' as review_status
from requests where http_status >= 400
"""

VALIDATED_SQL = """
select sample_id, seq, duration, case when seq % 5 = 0 then 'rejected' else 'approved' end as review_status,
  case when seq % 7 = 0 then '' else 'normal' end as validated_label
from review_queue where seq % 3 = 0
"""

SUBMISSIONS_SQL = """
select seq as submit_seq, case when seq % 11 = 0 then concat('x', cast(seq as varchar)) else sample_id end as sample_id,
  case when seq % 13 = 0 then 'unknown' else '  Normal ' end as validated_label
from review_queue
"""

LABELLED_DOCS_SQL = """
select l.*, d.lang, d.source, d.n_chars from labels l join (select doc_id, lang, source, n_chars from documents) d using (doc_id)
"""

VIEW_SQL = {
    "flows": FLOWS_SQL,
    "requests": REQUESTS_SQL,
    "preds": PREDS_SQL,
    "review_queue": REVIEW_QUEUE_SQL,
    "validated": VALIDATED_SQL,
    "submissions": SUBMISSIONS_SQL,
    "labelled_docs": LABELLED_DOCS_SQL,
}

_DEPS = {
    "preds": ["flows"],
    "review_queue": ["requests"],
    "validated": ["requests", "review_queue"],
    "submissions": ["requests", "review_queue"],
}


def with_views(sql: str, *views: str) -> str:
    """Prefix ``sql`` with the named views (and what they depend on) as CTEs.
    If ``sql`` starts with its own WITH, its CTEs are appended."""
    order: list[str] = []
    for v in views:
        for d in _DEPS.get(v, []) + [v]:
            if d not in order:
                order.append(d)
    ctes = ",\n".join(f"{v} as (\n{VIEW_SQL[v].strip()}\n)" for v in order)
    body = sql.strip()
    if body[:15].lower() == "with recursive ":
        return f"with recursive {ctes},\n{body[15:]}"
    if body[:5].lower() == "with ":
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"
