"""Registered queries: sources, cleaning, splits, feature selection and
fitted transforms over ``flows`` (A1–A3, T1–T17, P1–P4, F1–F6, F11–F13, X1–X6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import parse_number, r6, sig
from ..operators import clean, features, sampling, transforms
from ..session import prepare
from ..sources import fixtures
from ..sources.fixtures import with_views
from .registry import query
from .sqlkit import CATEGORICAL, NUMERIC_CANDIDATES, flows_sql, is_num, parse_num, tok
from .sqlkit import sig as ssig
from .sqlkit import r6 as s6

_PREP_CACHE: dict[tuple, tuple] = {}


def prepared(spark: SparkSession, sf_dir: str):
    """Fitted preparation over flows, once per application and input."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _PREP_CACHE:
        f = fixtures.flows(spark, sf_dir)
        _PREP_CACHE[key] = transforms.fit_preparation(f)
    return _PREP_CACHE[key]


def typed_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark, sf_dir)[1]


# ---------------------------------------------------------------------------
# A: sources and sinks
# ---------------------------------------------------------------------------


_FLOW_STRINGS = ["sample_id", "class1", "class2", "class3", "split", "raw_metric", "raw_flag", "raw_proto", "service"]
_FLOW_NUMBERS = NUMERIC_CANDIDATES[:-2]  # the raw columns are text


@query("write_splits", group="A", oracle=with_views("select sample_id, split, class1, class2, class3 from flows", "flows"))
def q_write_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    # flows() writes the labelled table partitioned by split and reads it back
    return fixtures.flows(spark, sf_dir).select("sample_id", "split", "class1", "class2", "class3")


@query(
    "export_summary",
    group="A",
    oracle=with_views(
        "select split, count(*)::bigint as n_rows, cast(19 as bigint) as n_columns from flows group by split", "flows"
    ),
)
def q_export_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixtures.flows(spark, sf_dir)
    width = len([c for c in f.columns if c not in ("sample_id", "ts", "split", "class1", "class2", "class3")])
    return f.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.lit(width).cast("long").alias("n_columns"))


@query(
    "read_flows_csv",
    group="A",
    oracle=with_views(
        "select " + ", ".join(_FLOW_STRINGS) + ", " + ", ".join(f"round(cast({c} as double), 6) as {c}" for c in _FLOW_NUMBERS)
        + ", epoch(ts)::bigint as ts from flows",
        "flows",
    ),
)
def q_read_flows_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every column as CSV (header) and read them back as all-string
    columns with an explicit schema; a corrupt-record column catches bad lines."""
    from ..sources import io as fio

    back = fio.roundtrip_csv(spark, fixtures.flows(spark, sf_dir), "raw_flows")
    return back.select(*_FLOW_STRINGS, *[r6(parse_number(c)).alias(c) for c in _FLOW_NUMBERS],
                       F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"))


# ---------------------------------------------------------------------------
# T: cleaning and typing
# ---------------------------------------------------------------------------

_STR = ["sample_id", "raw_metric", "raw_flag", "raw_proto", "service"]
_LABELS = ["class1", "class2", "class3", "split"]


@query(
    "null_tokens",
    group="T",
    oracle=with_views(
        "select " + ", ".join([f"{tok(c)} as {c}" for c in _STR] + _LABELS + [f"round(cast({c} as double), 6) as {c}" for c in _FLOW_NUMBERS]) + " from flows",
        "flows",
    ),
)
def q_null_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = clean.null_tokens(fixtures.flows(spark, sf_dir), exclude=_LABELS)
    return t.select(*_STR, *_LABELS, *[r6(c).alias(c) for c in _FLOW_NUMBERS])


def _type_table(spark, sf_dir):
    f = fixtures.flows(spark, sf_dir).filter(F.col("split") == "train")
    t = clean.null_tokens(f.select(*_STR))
    return clean.type_decisions(t)


_TYPE_SQL_ROWS = " union all ".join(
    f"""select '{c}' as column_name, coalesce(max({tok(c)} = 'true'), false) as has_true, coalesce(max({tok(c)} = 'false'), false) as has_false,
      avg(case when {is_num(tok(c))} and {parse_num(tok(c))} is not null then 1.0 else 0.0 end) as numeric_share from train"""
    for c in _STR
)
_TYPE_SQL = with_views(
    f"""with train as (select * from flows where split = 'train'), t as ({_TYPE_SQL_ROWS})
select column_name as "column", has_true, has_false, round(numeric_share, 6) as numeric_share,
  case when has_true and has_false then 'bool' when numeric_share > 0.7 then 'double' else 'string' end as decision from t""",
    "flows",
)


@query("infer_numeric_cols", group="T", oracle=_TYPE_SQL)
def q_infer_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _type_table(spark, sf_dir)
    return t.select("column", "has_true", "has_false", r6("numeric_share").alias("numeric_share"), "decision")


@query(
    "infer_bool_cols",
    group="T",
    oracle=with_views(
        f"""with train as (select * from flows where split = 'train'), t as ({_TYPE_SQL_ROWS})
select column_name as "column", has_true, has_false, 'bool' as decision from t where has_true and has_false""",
        "flows",
    ),
)
def q_infer_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _type_table(spark, sf_dir)
    return t.filter(F.col("decision") == "bool").select("column", "has_true", "has_false", "decision")


_T4_COLS = NUMERIC_CANDIDATES


@query(
    "cast_int_bool",
    group="T",
    oracle=flows_sql("select sample_id, " + ", ".join(f"{s6(c)} as {c}" for c in _T4_COLS) + " from typed"),
)
def q_cast_int_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = typed_flows(spark, sf_dir)
    return t.select("sample_id", *[r6(c).alias(c) for c in _T4_COLS])


@query(
    "drop_identifiers",
    group="T",
    oracle=with_views(
        "select class1, class2, class3, split, raw_metric, raw_flag, raw_proto, service, "
        + ", ".join(f"round(cast({c} as double), 6) as {c}" for c in _FLOW_NUMBERS) + " from flows",
        "flows",
    ),
)
def q_drop_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixtures.flows(spark, sf_dir)
    d = clean.drop_identifiers(f, list(clean.IDENTIFIER_COLUMNS) + ["sample_id", "ts"])
    return d.select(*[r6(c).alias(c) if c in _FLOW_NUMBERS else F.col(c) for c in d.columns])


_KEPT = ["load_avg", "byte_volume", "miss_rate", "is_reverse", "sparse_count", "raw_proto", "service"]


@query(
    "select_like_train",
    group="T",
    oracle=flows_sql(
        "select sample_id, split, " + ", ".join(s6(c) + f" as {c}" if c not in CATEGORICAL else c for c in _KEPT)
        + " from typed where split <> 'train'"
    ),
)
def q_select_like_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    prep, typed = prepared(spark, sf_dir)
    cols = prep.numeric + prep.categorical
    vt = clean.select_like(typed.filter(F.col("split") != "train"), ["sample_id", "split", *cols])
    return vt.select("sample_id", "split", *[r6(c).alias(c) if c in prep.numeric else F.col(c) for c in cols])


@query(
    "reindex_fill",
    group="T",
    oracle=flows_sql(
        "select sample_id, round(miss_rate, 6) as miss_rate, cast(0.0 as double) as not_in_frame, round(load_avg, 6) as load_avg from typed"
    ),
)
def q_reindex_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = typed_flows(spark, sf_dir)
    c = clean.conform(t, ["miss_rate", "not_in_frame", "load_avg"], keep=["sample_id"])
    return c.select("sample_id", r6("miss_rate").alias("miss_rate"), F.col("not_in_frame"), r6("load_avg").alias("load_avg"))


_RAW_NAMES = list(clean.API_RENAMES)
_RAW_SRC = ["is_reverse", "load_avg", "byte_volume", "miss_rate", "sparse_count", "quantity"]


@query(
    "rename_api",
    group="T",
    oracle=with_views(
        "select sample_id, " + ", ".join(f"round(cast({s} as double), 6) as {clean.API_RENAMES[r]}" for r, s in zip(_RAW_NAMES, _RAW_SRC)) + " from flows",
        "flows",
    ),
)
def q_rename_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixtures.flows(spark, sf_dir)
    raw = f.select("sample_id", *[r6(s).alias(r) for r, s in zip(_RAW_NAMES, _RAW_SRC)])
    return clean.rename_api(raw)


@query(
    "rename_back",
    group="T",
    oracle=with_views(
        "select sample_id, " + ", ".join(f'round(cast({s} as double), 6) as "{r}"' for r, s in zip(_RAW_NAMES, _RAW_SRC)) + " from flows",
        "flows",
    ),
)
def q_rename_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixtures.flows(spark, sf_dir)
    api = f.select("sample_id", *[r6(s).alias(clean.API_RENAMES[r]) for r, s in zip(_RAW_NAMES, _RAW_SRC)])
    return clean.rename_back(api)


@query(
    "coerce_numeric",
    group="T",
    oracle=with_views(
        "select sample_id, " + ", ".join(f"{parse_num(c)} as {c}" for c in ["raw_metric", "raw_flag", "raw_proto", "service"])
        + ", " + ", ".join(f"round(cast({c} as double), 6) as {c}" for c in _FLOW_NUMBERS) + " from flows",
        "flows",
    ),
)
def q_coerce_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixtures.flows(spark, sf_dir).select(*_STR, *_FLOW_NUMBERS)
    c = clean.coerce_numeric(f, keep=["sample_id"])
    return c.withColumns({n: r6(n) for n in _FLOW_NUMBERS})


@query(
    "finite_or_default",
    group="T",
    oracle=with_views(
        f"""select sample_id, coalesce(case when isfinite(v) then v end, -1.0) as metric_or_default,
  coalesce(case when isfinite(r) then round(r, 6) end, 0.0) as ratio_or_default
from (select sample_id, {parse_num(tok('raw_metric'))} as v,
  case when discount = 0 then null else extendedprice / discount end as r from flows) x""",
        "flows",
    ),
)
def q_finite_or_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.expressions import finite_or_default, null_token, safe_div

    f = fixtures.flows(spark, sf_dir)
    v = parse_number(null_token("raw_metric"))
    ratio = safe_div(F.col("extendedprice"), F.col("discount"))
    return f.select(
        "sample_id",
        finite_or_default(v, -1.0).alias("metric_or_default"),
        r6(finite_or_default(ratio, 0.0)).alias("ratio_or_default"),
    )


def _kind_sql(c: str) -> str:
    s = f"trim({c})"
    num = f"(case when {is_num(s)} or lower({s}) in ('nan', '+nan', '-nan') then try_cast({s} as double) end)"
    integral = f"({num} is not null and not isnan({num}) and isfinite({num}) and {num} = floor({num}))"
    return f"""case when {c} is null or {s} = '' then 'null' when lower({s}) in ('true', 'false') then 'bool'
      when {integral} then 'int' when {num} is not null then 'float' else 'string' end"""


@query(
    "typed_parse",
    group="T",
    oracle=with_views(
        "select sample_id, "
        + ", ".join(
            f"""{_kind_sql(c)} as {c}_kind,
  case when lower(trim({c})) = 'true' then true when lower(trim({c})) = 'false' then false end as {c}_bool"""
            for c in _STR[1:]
        )
        + " from flows",
        "flows",
    ),
)
def q_typed_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixtures.flows(spark, sf_dir)
    cols = []
    for c in _STR[1:]:
        parts = clean.typed_parse(c)
        cols += [parts[0], parts[1]]
    return f.select("sample_id", *cols)


_CONTRACT = {"raw_metric": "number", "raw_flag": "bool", "raw_proto": "string", "service": "string"}


def _contract_sql() -> str:
    checks = []
    for fld, want in _CONTRACT.items():
        k = _kind_sql(fld)
        cond = f"({k}) in ('int', 'float')" if want == "number" else f"({k}) = '{want}'"
        checks.append((fld, cond))
    ok = " and ".join(c for _, c in checks)
    fails = ", ".join(f"count_if(not ({c}))::bigint as fail_{f}" for f, c in checks)
    return with_views(
        f"select count_if({ok})::bigint as accepted, count_if(not ({ok}))::bigint as rejected, {fails} from flows", "flows"
    )


@query("contract_filter", group="T", oracle=_contract_sql())
def q_contract_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixtures.flows(spark, sf_dir)
    parsed = f.select(*[p for c in _CONTRACT for p in clean.typed_parse(c)])
    chk = clean.contract_check(parsed, _CONTRACT)
    return chk.agg(
        F.count_if(F.col("ok")).cast("long").alias("accepted"),
        F.count_if(~F.col("ok")).cast("long").alias("rejected"),
        *[F.count_if(F.array_contains("failing", fld)).cast("long").alias(f"fail_{fld}") for fld in _CONTRACT],
    )


@query(
    "perturb_rows",
    group="T",
    oracle=with_views(
        """select sample_id, round(load_avg * 8.0, 6) as load_avg, round(byte_volume * 8.0, 6) as byte_volume,
  cast(round_even(part_size * 8.0, 0) as bigint) as part_size, true as anomaly_alert, cast(1 as bigint) as alert_flag,
  greatest(coalesce(cast(round_even(sparse_count * 8.0, 0) as bigint), 0), 8) as alert_level
from flows where split = 'test'""",
        "flows",
    ),
)
def q_perturb_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixtures.flows(spark, sf_dir).filter(F.col("split") == "test")
    x = f.select("sample_id", "load_avg", "byte_volume", "part_size", F.col("sparse_count").alias("alert_level"),
                 F.lit(False).alias("anomaly_alert"), F.lit(0).alias("alert_flag"))
    p = clean.perturb(x, ["load_avg", "byte_volume", "part_size", "alert_level"], 8.0, int_fields=["part_size", "alert_level"],
                      force_true=["anomaly_alert"], force_one=["alert_flag"], level_field="alert_level", level_floor=8)
    return p.select("sample_id", r6("load_avg").alias("load_avg"), r6("byte_volume").alias("byte_volume"), "part_size",
                    "anomaly_alert", "alert_flag", "alert_level")


@query(
    "binary_target",
    group="T",
    oracle=with_views("select sample_id, cast(class3 <> 'normal' as integer) as y from flows", "flows"),
)
def q_binary_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.flows(spark, sf_dir).select("sample_id", clean.binary_target().alias("y"))


@query(
    "attacks_only",
    group="T",
    oracle=with_views("select sample_id, class1, class2 from flows where class3 <> 'normal'", "flows"),
)
def q_attacks_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.attacks_only(fixtures.flows(spark, sf_dir)).select("sample_id", "class1", "class2")


@query(
    "json_rows",
    group="T",
    oracle=with_views(
        "select sample_id, " + ", ".join(f"round(cast({c} as double), 6) as {c}" for c in _FLOW_NUMBERS) + " from flows",
        "flows",
    ),
)
def q_json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixtures.flows(spark, sf_dir)
    cols = _FLOW_NUMBERS
    j = clean.json_rows(f, cols, "sample_id")
    back = j.select("sample_id", F.from_json("input_json", "map<string,double>").alias("m"))
    return back.select("sample_id", *[r6(F.col("m")[c]).alias(c) for c in cols])


# ---------------------------------------------------------------------------
# P: splits and samples
# ---------------------------------------------------------------------------


@query(
    "stratified_split",
    group="P",
    oracle="""
select o_orderkey, o_orderpriority,
  case when rn <= round_even(n*0.15,0) then 'test' when rn <= round_even(n*0.30,0) then 'val' else 'train' end as split
from (select o_orderkey, o_orderpriority,
  row_number() over (partition by o_orderpriority order by md5(cast(o_orderkey as varchar)||'42'), o_orderkey) as rn,
  count(*) over (partition by o_orderpriority) as n from orders) x""",
)
def q_stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    o = fixtures.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return sampling.stratified_split(o, "o_orderkey", "o_orderpriority", 0.15, 0.15, seed=42)


_QUOTA_SQL = """
sizes as (select class3, count(*) as size from train group by class3),
alloc as (select class3, size, size * 25000.0 / sum(size) over () as ex, sum(size) over () as tot from sizes),
base as (select class3, size, case when tot <= 25000 then size else floor(ex) end as b,
  case when tot <= 25000 then 0.0 else ex - floor(ex) end as fr, tot from alloc),
ranked as (select *, row_number() over (order by fr desc, class3) as rk,
  case when tot <= 25000 then 0 else 25000 - sum(b) over () end as lft from base),
quota as (select class3, b + case when rk <= lft then 1 else 0 end as quota from ranked)
"""


@query(
    "stratified_sample_n",
    group="P",
    oracle=with_views(
        f"""with train as (select * from flows where split = 'train'), {_QUOTA_SQL.strip()},
pos as (select sample_id, class3, row_number() over (partition by class3 order by md5(sample_id||'42'), sample_id) - 1 as p from train)
select pos.sample_id, pos.class3 from pos join quota using (class3) where p < quota""",
        "flows",
    ),
)
def q_stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = fixtures.flows(spark, sf_dir).filter(F.col("split") == "train").select("sample_id", "class3")
    return sampling.stratified_sample(train, "sample_id", "class3", 25000, seed=42)


@query(
    "uniform_sample_n",
    group="P",
    oracle=with_views(
        """select sample_id, class1 from (select sample_id, class1, row_number() over (order by md5(sample_id||'42'), sample_id) as rn from flows) x
where rn <= 20000""",
        "flows",
    ),
)
def q_uniform_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.uniform_sample(fixtures.flows(spark, sf_dir).select("sample_id", "class1"), "sample_id", 20_000, seed=42)


@query(
    "split_distribution",
    group="P",
    oracle=with_views(
        """select split, class3, count(*)::bigint as n, round(count(*) * 100.0 / sum(count(*)) over (partition by split), 6) as pct
from flows group by split, class3""",
        "flows",
    ),
)
def q_split_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sampling.split_distribution(fixtures.flows(spark, sf_dir), "split", "class3")
    return d.withColumn("pct", r6("pct"))


# ---------------------------------------------------------------------------
# F: statistics and selection (train split)
# ---------------------------------------------------------------------------


def _union_rows(cols, row_sql):
    return " union all ".join(row_sql(c) for c in cols)


@query(
    "column_variance",
    group="F",
    oracle=flows_sql(
        "select * from ("
        + _union_rows(
            NUMERIC_CANDIDATES,
            lambda c: f"select '{c}' as feature, {ssig(f'var_samp({c})')} as variance, count({c})::bigint as n from typed where split = 'train'",
        )
        + ") v"
    ),
)
def q_column_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = typed_flows(spark, sf_dir).filter(F.col("split") == "train")
    v = features.variance_table(t, NUMERIC_CANDIDATES)
    return v.select("feature", sig("variance").alias("variance"), F.col("n").cast("long").alias("n"))


@query(
    "drop_zero_variance",
    group="F",
    oracle=flows_sql(
        "select feature, case when n >= 2 and mn = mx then 'drop' else 'keep' end as decision from ("
        + _union_rows(
            NUMERIC_CANDIDATES,
            lambda c: f"select '{c}' as feature, count({c}) as n, min({c}) as mn, max({c}) as mx from typed where split = 'train'",
        )
        + ") v"
    ),
)
def q_drop_zero_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = typed_flows(spark, sf_dir).filter(F.col("split") == "train")
    return features.zero_variance(t, NUMERIC_CANDIDATES).select("feature", "decision")


_AFTER_ZERO = [c for c in NUMERIC_CANDIDATES if c != "const_col"]


def _corr_sql(a: str, b: str) -> str:
    both = f"{a} is not null and {b} is not null"
    aa, bb = f"case when {both} then {a} end", f"case when {both} then {b} end"
    return f"abs(covar_samp({aa}, {bb}) / nullif(stddev_samp({aa}) * stddev_samp({bb}), 0))"


_TARGET_SQL = flows_sql(
    "select * from ("
    + _union_rows(
        _AFTER_ZERO,
        lambda c: f"select '{c}' as feature, {_corr_sql(c, 'y')} as abs_corr from (select *, case when class3 = 'normal' then 0.0 else 1.0 end as y from typed where split = 'train') t",
    )
    + ") v"
)


@query("target_correlation", group="F", oracle=_TARGET_SQL.replace("select * from (", "select feature, round(abs_corr, 6) as abs_corr from (", 1))
def q_target_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    prep, typed = prepared(spark, sf_dir)
    t = typed.filter(F.col("split") == "train")
    tc = features.target_correlation(t, _AFTER_ZERO, clean.binary_target())
    return tc.select("feature", r6("abs_corr").alias("abs_corr"))


@query(
    "drop_low_relevance",
    group="F",
    oracle=_TARGET_SQL.replace(
        "select * from (", "select feature, case when abs_corr < 0.025 then 'drop' else 'keep' end as decision from (", 1
    ),
)
def q_drop_low_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    prep, typed = prepared(spark, sf_dir)
    return prep.decisions["relevance"].select("feature", "decision")


_AFTER_LOW = ["load_avg", "byte_volume", "load_avg_dup", "miss_rate", "is_reverse", "sparse_count"]
_PAIRS = [(i, j) for i in range(len(_AFTER_LOW)) for j in range(i + 1, len(_AFTER_LOW))]
_PAIR_CTE = "p as (select * from (" + " union all ".join(
    f"select {i} as i, {j} as j, '{_AFTER_LOW[i]}' as feature_i, '{_AFTER_LOW[j]}' as feature_j, {_corr_sql(_AFTER_LOW[i], _AFTER_LOW[j])} as abs_corr from typed where split = 'train'"
    for i, j in _PAIRS
) + ") v)"
_PAIR_SQL = flows_sql("select * from p", _PAIR_CTE)


@query(
    "pairwise_correlation",
    group="F",
    oracle=flows_sql("select i, j, feature_i, feature_j, round(abs_corr, 6) as abs_corr, round(1 - abs_corr, 6) as distance from p", _PAIR_CTE),
)
def q_pairwise_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    prep, typed = prepared(spark, sf_dir)
    pc = prep.decisions["pairs"]
    return pc.select("i", "j", "feature_i", "feature_j", r6("abs_corr").alias("abs_corr"), r6("distance").alias("distance"))


@query(
    "drop_redundant",
    group="F",
    oracle=flows_sql(
        "select feature, case when exists (select 1 from p where p.j = f.j and p.abs_corr > 0.97) then 'drop' else 'keep' end as decision from (values "
        + ", ".join(f"({j}, '{c}')" for j, c in enumerate(_AFTER_LOW))
        + ") f(j, feature)",
        _PAIR_CTE,
    ),
)
def q_drop_redundant(spark: SparkSession, sf_dir: str) -> DataFrame:
    prep, typed = prepared(spark, sf_dir)
    return prep.decisions["redundancy"].select("feature", "decision")


@query(
    "class_counts_topk",
    group="F",
    oracle=with_views(
        """select class1, n, round(share, 6) as share, rank from (
  select class1, count(*)::bigint as n, count(*) * 1.0 / sum(count(*)) over () as share,
    row_number() over (order by count(*) desc, class1) as rank
  from flows where split = 'train' and class3 <> 'normal' group by class1) x where rank <= 15""",
        "flows",
    ),
)
def q_class_counts_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixtures.flows(spark, sf_dir).filter((F.col("split") == "train") & (F.col("class3") != "normal"))
    t = features.class_counts_topk(f, "class1", 15)
    return t.select("class1", "n", r6("share").alias("share"), F.col("rank").cast("int").alias("rank"))


@query(
    "class_inventory",
    group="F",
    oracle=with_views(
        """with m as (select class1, min(class2) as class2, min(class3) as class3 from flows group by class1),
s as (select class1, count(*) as n from flows where split = 'train' group by class1)
select m.class1, m.class2, m.class3, coalesce(s.n, 0)::bigint as support_train from m left join s using (class1)""",
        "flows",
    ),
)
def q_class_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import evaluation

    f = fixtures.flows(spark, sf_dir)
    return evaluation.class_inventory(f, f.filter(F.col("split") == "train"))


@query(
    "balanced_weights",
    group="F",
    oracle=with_views(
        """select class1, count(*)::bigint as n_c, round(sum(count(*)) over () / (count(*) over () * count(*)), 6) as weight
from flows where split = 'train' group by class1""",
        "flows",
    ),
)
def q_balanced_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixtures.flows(spark, sf_dir).filter(F.col("split") == "train")
    return features.class_weights(f, "class1").withColumn("weight", r6("weight"))


# ---------------------------------------------------------------------------
# X: fitted transforms
# ---------------------------------------------------------------------------

_NUM = ["load_avg", "byte_volume", "miss_rate", "is_reverse", "sparse_count"]
_PARAM_CTES = [
    "means as (select " + ", ".join(f"avg({c}) as m_{c}" for c in _NUM) + " from typed where split = 'train')",
    "imp as (select typed.*, " + ", ".join(f"coalesce({c}, m_{c}) as i_{c}" for c in _NUM) + " from typed, means)",
    "qs as (select " + ", ".join(
        f"quantile_cont(i_{c}, 0.5) as med_{c}, case when quantile_cont(i_{c}, 0.75) - quantile_cont(i_{c}, 0.25) = 0 then 1.0 else quantile_cont(i_{c}, 0.75) - quantile_cont(i_{c}, 0.25) end as sc_{c}"
        for c in _NUM
    ) + " from imp where split = 'train')",
]


def _cat_values_sql(c: str) -> str:
    return f"(select distinct coalesce({c}, 'missing') as v from typed where split = 'train')"


@query(
    "impute_mean",
    group="X",
    oracle=flows_sql("select sample_id, " + ", ".join(f"round(i_{c}, 6) as {c}" for c in _NUM) + " from imp", *_PARAM_CTES[:2]),
)
def q_impute_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    prep, typed = prepared(spark, sf_dir)
    m = prep.params.mean
    return typed.select("sample_id", *[r6(F.coalesce(F.col(c), F.lit(m[c]))).alias(c) for c in prep.numeric])


@query(
    "impute_missing",
    group="X",
    oracle=flows_sql("select sample_id, " + ", ".join(f"coalesce({c}, 'missing') as {c}" for c in CATEGORICAL) + " from typed"),
)
def q_impute_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prep, typed = prepared(spark, sf_dir)
    return typed.select("sample_id", *prep.categorical).na.fill(transforms.MISSING, subset=prep.categorical)


@query(
    "robust_scale",
    group="X",
    oracle=flows_sql(
        "select * from (" + " union all ".join(f"select '{c}' as feature, round(med_{c}, 6) as median, round(sc_{c}, 6) as scale from qs" for c in _NUM) + ") v",
        *_PARAM_CTES,
    ),
)
def q_robust_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    prep, _ = prepared(spark, sf_dir)
    t = prep.params.table(spark).filter(F.col("kind") == "numeric")
    return t.select("feature", r6("median").alias("median"), r6("scale").alias("scale"))


def _onehot_sql(c: str, values: list[str]) -> str:
    return ", ".join(f"cast(coalesce({c}, 'missing') = '{v}' as double) as \"{c}_{v}\"" for v in values)


# category lists seen in the train split at every scale of the test tables
_CATS = {
    "raw_proto": ["automobile", "building", "furniture", "household", "machinery", "missing"],
    "service": ["1-urgent", "2-high", "3-medium", "4-not specified", "5-low"],
}


@query(
    "one_hot",
    group="X",
    oracle=flows_sql("select sample_id, " + ", ".join(_onehot_sql(c, _CATS[c]) for c in CATEGORICAL) + " from typed"),
)
def q_one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    prep, typed = prepared(spark, sf_dir)
    p = transforms.Params([], prep.categorical, categories=prep.params.categories)
    return transforms.transform(typed, p, keep=["sample_id"])


def _final_sql(where: str) -> str:
    num = ", ".join(f"round((i_{c} - med_{c}) / sc_{c}, 6) as {c}" for c in _NUM)
    return flows_sql(
        f"select sample_id, split, {num}, " + ", ".join(_onehot_sql(c, _CATS[c]) for c in CATEGORICAL) + f" from imp, qs {where}",
        *_PARAM_CTES,
    )


def final_features(spark: SparkSession, sf_dir: str) -> tuple[transforms.Preparation, DataFrame]:
    prep, typed = prepared(spark, sf_dir)
    out = transforms.transform(typed, prep.params, keep=["sample_id", "split", "class1", "class2", "class3", "ts", "service"])
    return prep, out


@query("fit_transform_pipeline", group="X", oracle=_final_sql(""))
def q_fit_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    prep, out = final_features(spark, sf_dir)
    return out.select("sample_id", "split", *[r6(c).alias(c) if c in prep.numeric else F.col(c) for c in prep.features])


@query("transform_inference", group="X", oracle=_final_sql("where split = 'test'"))
def q_transform_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inference path: raw test rows → the same typing (stored plan) → one
    compiled select; the rows never touch the fit."""
    prep, _ = prepared(spark, sf_dir)
    raw = fixtures.flows(spark, sf_dir).filter(F.col("split") == "test")
    t, _ = transforms.typed(raw, ["class1", "class2", "class3"], ["split"], plan=prep.type_plan)
    out = transforms.transform(t, prep.params, keep=["sample_id", "split"])
    return out.select("sample_id", "split", *[r6(c).alias(c) if c in prep.numeric else F.col(c) for c in prep.features])
