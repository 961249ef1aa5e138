"""Cleaning, typing and projection (T1–T17).

Type decisions are made once, from one aggregate pass over the training
rows, and then applied everywhere as a single ``select``; the decision table
(one row per column) is the only thing that reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import NULL_TOKENS, is_number_text, null_token, parse_number

# Identifier / time columns dropped before modelling
# (compared case-insensitively with the frame's column names).
IDENTIFIER_COLUMNS = (
    "scr_ip", "scr_port", "des_ip", "des_port", "scr_bytes", "des_bytes",
    "scr_pkts", "des_pkts", "scr_packts_ratio", "des_pkts_ratio",
    "scr_bytes_ratio", "des_bytes_ratio", "scr_ip_bytes", "des_ip_bytes",
    "timestamp", "date",
)

# Raw names with illegal characters → request-contract names.
API_RENAMES = {
    "FIN or RST": "FIN_or_RST",
    "Avg_num_Proc/s": "Avg_num_Proc_s",
    "Std_num_proc/s": "Std_num_proc_s",
    "Avg_num_cswch/s": "Avg_num_cswch_s",
    "std_num_cswch/s": "std_num_cswch_s",
    "read_write_physical.process": "read_write_physical_process",
}

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def string_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in ex]


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, NUMERIC_TYPES + (T.BooleanType,)) and f.name not in ex
    ]


# T1 ------------------------------------------------------------------------
def null_tokens(df: DataFrame, tokens: Sequence[str] = NULL_TOKENS, exclude: Iterable[str] = ()) -> DataFrame:
    """Lower-case every string column and turn the tokens into NULL, in one select."""
    targets = set(string_columns(df, exclude))
    return df.select(*[null_token(c, tokens).alias(c) if c in targets else F.col(c) for c in df.columns])


# T2–T4 ---------------------------------------------------------------------
@dataclass
class TypePlan:
    """Per string column: 'bool', 'double' or 'string'; other columns are
    cast to double when numeric or boolean."""

    kinds: dict[str, str] = field(default_factory=dict)
    table: DataFrame | None = None

    def as_rows(self) -> list[tuple[str, str]]:
        return sorted(self.kinds.items())


def type_decisions(df: DataFrame, share: float = 0.7, exclude: Iterable[str] = ()) -> DataFrame:
    """Decision table, one row per string column, from ONE aggregate pass:
    has_true / has_false, numeric share over ALL rows (nulls in the
    denominator), decision."""
    cols = string_columns(df, exclude)
    if not cols:
        schema = "column string, has_true boolean, has_false boolean, numeric_share double, decision string"
        return df.sparkSession.createDataFrame([], schema)
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c)
        aggs += [
            F.max(F.coalesce(x == "true", F.lit(False))).alias(f"t{i}"),
            F.max(F.coalesce(x == "false", F.lit(False))).alias(f"f{i}"),
            F.avg(F.when(is_number_text(x) & parse_number(x).isNotNull(), 1.0).otherwise(0.0)).alias(f"s{i}"),
        ]
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{c}', t{i}, f{i}, s{i}" for i, c in enumerate(cols))
    long = wide.selectExpr(f"stack({len(cols)}, {stack}) as (column, has_true, has_false, numeric_share)")
    decision = (
        F.when(F.col("has_true") & F.col("has_false"), "bool")
        .when(F.col("numeric_share") > F.lit(float(share)), "double")
        .otherwise("string")
    )
    return long.select(
        "column",
        F.coalesce("has_true", F.lit(False)).alias("has_true"),
        F.coalesce("has_false", F.lit(False)).alias("has_false"),
        F.col("numeric_share").cast("double").alias("numeric_share"),
        decision.alias("decision"),
    )


def infer_types(df: DataFrame, share: float = 0.7, exclude: Iterable[str] = ()) -> TypePlan:
    table = type_decisions(df, share, exclude)
    rows = table.collect()  # one row per column
    kinds = {r["column"]: r["decision"] for r in rows}
    return TypePlan(kinds, df.sparkSession.createDataFrame(rows, table.schema))


def apply_types(df: DataFrame, plan: TypePlan, keep: Iterable[str] = ()) -> DataFrame:
    """bool → 1.0/0.0 (other values NULL), numeric text → double, numeric
    and boolean columns → double; ``keep`` columns untouched."""
    kept = set(keep)
    out: list[Column] = []
    for f in df.schema.fields:
        c = f.name
        x = F.col(c)
        if c in kept:
            out.append(x)
        elif c in plan.kinds:
            k = plan.kinds[c]
            if k == "bool":
                out.append(F.when(x == "true", 1.0).when(x == "false", 0.0).otherwise(F.lit(None).cast("double")).alias(c))
            elif k == "double":
                out.append(parse_number(x).alias(c))
            else:
                out.append(x)
        elif isinstance(f.dataType, NUMERIC_TYPES + (T.BooleanType,)):
            out.append(x.cast("double").alias(c))
        else:
            out.append(x)
    return df.select(*out)


# T5–T11 --------------------------------------------------------------------
def identifier_matches(df: DataFrame, names: Iterable[str] = IDENTIFIER_COLUMNS) -> list[str]:
    low = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() in low]


def drop_identifiers(df: DataFrame, names: Iterable[str] = IDENTIFIER_COLUMNS) -> DataFrame:
    return df.drop(*identifier_matches(df, names))


def select_like(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)


def conform(df: DataFrame, columns: Sequence[str], fill: float = 0.0, keep: Sequence[str] = ()) -> DataFrame:
    """Reorder to ``columns``, drop extras, missing columns → ``fill``."""
    have = set(df.columns)
    cols = [F.col(c) for c in keep]
    cols += [F.col(c) if c in have else F.lit(float(fill)).alias(c) for c in columns]
    return df.select(*cols)


def rename_api(df: DataFrame, renames: Mapping[str, str] = API_RENAMES) -> DataFrame:
    present = {k: v for k, v in renames.items() if k in df.columns}
    return df.withColumnsRenamed(present) if present else df


def rename_back(df: DataFrame, renames: Mapping[str, str] = API_RENAMES) -> DataFrame:
    """Full inverse of ``rename_api`` (all six names)."""
    inverse = {v: k for k, v in renames.items() if v in df.columns}
    return df.withColumnsRenamed(inverse) if inverse else df


def coerce_numeric(df: DataFrame, columns: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Every column → double; text that is not a number → NULL; NaN → NULL."""
    cols = columns if columns is not None else [c for c in df.columns if c not in keep]
    types = dict(df.dtypes)
    out = [F.col(k) for k in keep]
    for c in cols:
        if types[c] == "string":
            v = parse_number(c)
        elif types[c] == "boolean":
            v = F.col(c).cast("double")
        else:
            v = F.col(c).try_cast("double")
        out.append(F.when(F.isnan(v), F.lit(None).cast("double")).otherwise(v).alias(c))
    return df.select(*out)


# T12–T14 -------------------------------------------------------------------
def typed_parse(c: str) -> list[Column]:
    """CSV cell → (kind, bool, long, double, string) columns:
    blank/NULL → 'null'; true/false (any case) → 'bool'; a number that is
    integral → 'int', other numbers → 'float'; anything else → 'string'."""
    s = F.trim(F.col(c))
    low = F.lower(s)
    num = F.when(is_number_text(s) | low.isin("nan", "+nan", "-nan"), s.try_cast("double"))
    integral = num.isNotNull() & ~F.isnan(num) & (F.abs(num) != F.lit(float("inf"))) & (num == F.floor(num))
    kind = (
        F.when(s.isNull() | (s == ""), "null")
        .when(low.isin("true", "false"), "bool")
        .when(integral, "int")
        .when(num.isNotNull(), "float")
        .otherwise("string")
    )
    return [
        kind.alias(f"{c}_kind"),
        F.when(low == "true", True).when(low == "false", False).alias(f"{c}_bool"),
        F.when(integral, num.cast("long")).alias(f"{c}_long"),
        F.when(num.isNotNull() & ~low.isin("true", "false"), num).alias(f"{c}_double"),
        F.when(kind == "string", s).alias(f"{c}_string"),
    ]


def contract_check(parsed: DataFrame, contract: Mapping[str, str]) -> DataFrame:
    """``contract``: field → 'bool' | 'int' | 'string' | 'number'. Adds
    ``ok`` and ``failing`` (array of fields that are missing or mistyped)."""
    checks = []
    for fld, want in contract.items():
        kind = F.col(f"{fld}_kind")
        if want == "number":
            good = kind.isin("int", "float")
        elif want == "string":
            good = kind == "string"
        else:
            good = kind == want
        checks.append(F.when(~F.coalesce(good, F.lit(False)), F.lit(fld)))
    failing = F.array_compact(F.array(*checks))
    return parsed.withColumn("failing", failing).withColumn("ok", F.size("failing") == 0)


def perturb(df: DataFrame, fields: Sequence[str], factor: float, int_fields: Iterable[str] = (),
            force_true: Iterable[str] = (), force_one: Iterable[str] = (), level_field: str | None = None,
            level_floor: int = 8) -> DataFrame:
    """Fault injection: numeric fields × factor (integer fields rounded half
    even), flags forced on, alert level floored."""
    ints = set(int_fields)
    repl: dict[str, Column] = {}
    for c in fields:
        v = F.col(c) * F.lit(float(factor))
        repl[c] = F.bround(v, 0).cast("long") if c in ints else v.cast("double")
    for c in force_true:
        repl[c] = F.lit(True)
    for c in force_one:
        repl[c] = F.lit(1).cast("long")
    if level_field:
        base = repl.get(level_field, F.col(level_field))
        repl[level_field] = F.greatest(F.coalesce(base.cast("long"), F.lit(0).cast("long")), F.lit(level_floor).cast("long"))
    return df.withColumns(repl)


# T15–T17 -------------------------------------------------------------------
def binary_target(label: str = "class3", normal: str = "normal") -> Column:
    return (F.col(label) != F.lit(normal)).cast("int")


def attacks_only(df: DataFrame, label: str = "class3", normal: str = "normal") -> DataFrame:
    return df.filter(F.col(label) != F.lit(normal))


def json_rows(df: DataFrame, columns: Sequence[str], key: str, out: str = "input_json") -> DataFrame:
    """Row → JSON text of a map(field → value); read back with from_json."""
    m = F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("double"))])
    return df.select(key, F.to_json(m).alias(out))
