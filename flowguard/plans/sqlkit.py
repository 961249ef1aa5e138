"""Pieces of DuckDB SQL shared by the oracles (the independent side of the
check). Written in DuckDB dialect; the Spark side never runs these."""

from __future__ import annotations

from ..functions.expressions import INF_PATTERN, NUMERIC_PATTERN
from ..sources.fixtures import with_views

NUMERIC_CANDIDATES = [
    "quantity", "extendedprice", "discount", "tax", "part_size", "retailprice", "order_total", "acctbal",
    "load_avg", "byte_volume", "load_avg_dup", "miss_rate", "is_reverse", "const_col", "sparse_count",
    "raw_metric", "raw_flag",
]
CATEGORICAL = ["raw_proto", "service"]


def tok(c: str) -> str:
    return f"(case when lower({c}) in ('-', '?', 'nan') then null else lower({c}) end)"


def is_num(c: str) -> str:
    return f"(regexp_matches({c}, '{NUMERIC_PATTERN}') or regexp_matches(lower({c}), '{INF_PATTERN}'))"


def parse_num(c: str) -> str:
    return f"(case when {is_num(c)} then try_cast(trim({c}) as double) end)"


# flows after null tokens + typing (raw_metric → number, raw_flag → 1/0)
TYPED_CTE = f"""
typed as (
  select sample_id, class1, class2, class3, split,
    quantity, extendedprice, discount, tax, part_size, retailprice, order_total, acctbal, load_avg, byte_volume,
    load_avg_dup, miss_rate, cast(is_reverse as double) as is_reverse, cast(const_col as double) as const_col, sparse_count,
    {parse_num('m')} as raw_metric,
    case when f = 'true' then 1.0 when f = 'false' then 0.0 end as raw_flag,
    p as raw_proto, s as service, ts
  from (select *, {tok('raw_metric')} as m, {tok('raw_flag')} as f, {tok('raw_proto')} as p, {tok('service')} as s from flows) x
)
"""


def flows_sql(body: str, *extra_ctes: str) -> str:
    """``body`` may reference ``flows`` and ``typed``."""
    ctes = [TYPED_CTE.strip()] + [c.strip() for c in extra_ctes]
    return with_views("with " + ",\n".join(ctes) + "\n" + body, "flows")


def r6(x: str) -> str:
    return f"round(cast({x} as double), 6)"


def sig(x: str, digits: int = 10) -> str:
    return f"cast(printf('%.{digits - 1}e', cast({x} as double)) as double)"
