"""Fitted preprocessing (X1–X6) compiled into ONE projection.

``fit`` computes every parameter with a few aggregate jobs over the training
rows (means, exact quantiles, category lists) and returns a small parameter
table; ``compile`` turns the parameters into literal Column expressions, so
``transform`` is a single ``select`` with no UDF, usable unchanged on a
stream. Parameters are also kept as a DataFrame (one row per feature) that
can be written next to the model.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clean, features
from .stats import quantiles

MISSING = "missing"  # fixed value: fill for categorical NULLs
MAX_CATEGORIES = 2_000  # one-hot columns of one categorical column; more is an error, nothing is cut
_TINY_SCALE = 10 * 2.220446049250313e-16


@dataclass
class Params:
    numeric: list[str]
    categorical: list[str]
    mean: dict[str, float | None] = field(default_factory=dict)
    median: dict[str, float | None] = field(default_factory=dict)
    scale: dict[str, float] = field(default_factory=dict)
    categories: dict[str, list[str]] = field(default_factory=dict)

    @property
    def output_columns(self) -> list[str]:
        out = list(self.numeric)
        for c in self.categorical:
            out += [f"{c}_{v}" for v in self.categories.get(c, [])]
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(c, "numeric", self.mean.get(c), self.median.get(c), self.scale.get(c), None) for c in self.numeric]
        rows += [(c, "categorical", None, None, None, self.categories.get(c, [])) for c in self.categorical]
        return spark.createDataFrame(
            rows, "feature string, kind string, mean double, median double, scale double, categories array<string>"
        )

    def to_json(self) -> str:
        return json.dumps(self.__dict__)


def fit(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
        means: dict[str, float | None] | None = None) -> Params:
    """``means`` (non-null means of the numeric columns) skips their pass
    when the caller already has them."""
    p = Params(list(numeric), list(categorical))
    if p.numeric:
        if means is not None and all(c in means for c in p.numeric):
            p.mean = {c: means[c] for c in p.numeric}
        else:
            row = train.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(p.numeric)]).first()
            p.mean = {c: row[f"m{i}"] for i, c in enumerate(p.numeric)}
        # quantiles of the imputed values (the scaler is fitted after imputation)
        imputed = train.select(*[F.coalesce(F.col(c).cast("double"), F.lit(p.mean[c])).alias(c) for c in p.numeric])
        q = {r["feature"]: r for r in quantiles(imputed, p.numeric, [0.25, 0.5, 0.75]).collect()}
        for c in p.numeric:
            r = q[c]
            med = r["q_1"]
            iqr = None if r["q_0"] is None else r["q_2"] - r["q_0"]
            p.median[c] = med
            p.scale[c] = 1.0 if iqr is None or abs(iqr) < _TINY_SCALE else iqr
    if p.categorical:
        long = train.select(*[F.coalesce(F.col(c), F.lit(MISSING)).alias(c) for c in p.categorical]).unpivot(
            [], p.categorical, "feature", "value"
        )
        cats: dict[str, list[str]] = {c: [] for c in p.categorical}
        # distinct categories: as many rows as one-hot output columns, which is
        # checked before they reach the driver
        found = long.distinct()
        for r in found.groupBy("feature").count().filter(F.col("count") > MAX_CATEGORIES).collect():
            raise ValueError(f"{r['feature']} has {r['count']} categories; one-hot encoding takes at most {MAX_CATEGORIES}: drop or bin it")
        for r in found.collect():
            cats[r["feature"]].append(r["value"])
        p.categories = {c: sorted(v) for c, v in cats.items()}
    return p


def compile_columns(p: Params) -> list[Column]:
    """impute (mean) → robust scale → fill 'missing' → one-hot, as literals."""
    out: list[Column] = []
    for c in p.numeric:
        mean = p.mean.get(c)
        x = F.col(c).cast("double")
        if mean is not None:
            x = F.coalesce(x, F.lit(float(mean)))
        med = p.median.get(c)
        if med is not None:
            x = (x - F.lit(float(med))) / F.lit(float(p.scale[c]))
        out.append(x.alias(c))
    for c in p.categorical:
        v = F.coalesce(F.col(c), F.lit(MISSING))
        for cat in p.categories.get(c, []):
            out.append((v == F.lit(cat)).cast("double").alias(f"{c}_{cat}"))
    return out


def transform(df: DataFrame, p: Params, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*[F.col(k) for k in keep], *compile_columns(p))


# X6 -------------------------------------------------------------------------
@dataclass
class Preparation:
    """Every decision of the training-side preparation, reproducible."""

    type_plan: clean.TypePlan
    identifiers: list[str]
    candidates: list[str]
    zero_variance: list[str]
    low_relevance: list[str]
    redundant: list[str]
    numeric: list[str]
    categorical: list[str]
    params: Params
    decisions: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def features(self) -> list[str]:
        return self.params.output_columns


def typed(df: DataFrame, label_cols: Sequence[str], meta: Sequence[str], plan: clean.TypePlan | None = None,
          share: float = 0.7, train_filter: Column | None = None) -> tuple[DataFrame, clean.TypePlan]:
    """T1 → T2–T4. Types are decided on the training rows only."""
    tok = clean.null_tokens(df, exclude=list(meta))
    if plan is None:
        src = tok.filter(train_filter) if train_filter is not None else tok
        plan = clean.infer_types(src, share, exclude=list(label_cols) + list(meta))
    return clean.apply_types(tok, plan, keep=list(label_cols) + list(meta)), plan


def _small(df: DataFrame) -> DataFrame:
    """Decision tables have one row per column or pair: compute them once and
    keep them as local tables, so readers do not re-run the aggregates."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def fit_preparation(df: DataFrame, label: str = "class3", normal: str = "normal",
                    label_cols: Sequence[str] = ("class1", "class2", "class3"), split_col: str = "split",
                    key: str = "sample_id", extra_identifiers: Sequence[str] = ("sample_id", "ts"),
                    relevance: float = features.RELEVANCE_MIN, redundancy: float = features.REDUNDANCY_MAX,
                    carry: Sequence[str] = ("ts",),
                    materialize: bool = True) -> tuple[Preparation, DataFrame]:
    """Returns the decisions and the typed frame (all splits, key + labels +
    split + carried identifiers such as the event time + candidate features)."""
    meta = [split_col]
    t, plan = typed(df, label_cols, meta, train_filter=F.col(split_col) == "train")
    ids = clean.identifier_matches(t, list(clean.IDENTIFIER_COLUMNS) + list(extra_identifiers))
    cand = [c for c in t.columns if c not in set(ids) | set(label_cols) | set(meta)]
    carried = [c for c in carry if c in ids and c != key]
    typed_df = t.select(*([key] if key in ids else []), *label_cols, split_col, *carried, *cand)
    if materialize:
        # every statistic below scans the typed rows; write them once (parsing
        # and token rules run once per row, later scans are columnar, and the
        # lineage is cut for executor loss)
        from ..session import scratch_path

        path = scratch_path(df.sparkSession, "typed")
        typed_df.write.mode("overwrite").option("compression", "zstd").partitionBy(split_col).parquet(path)
        back = df.sparkSession.read.parquet(path)
        typed_df = back.select(*typed_df.columns)
    train = typed_df.filter(F.col(split_col) == "train")
    dtypes = dict(typed_df.dtypes)
    num = [c for c in cand if dtypes[c] == "double"]

    # one pass: variance, count, min, max and mean of every numeric column
    profile = features.variance_table(train, num).collect()
    prof_df = train.sparkSession.createDataFrame(
        [(r["feature"], r["variance"], r["n"], r["min_value"], r["max_value"], r["mean"]) for r in profile],
        "feature string, variance double, n long, min_value double, max_value double, mean double")
    means = {r["feature"]: r["mean"] for r in profile}
    zv = _small(features.zero_variance(train, num, table=prof_df))
    dropped_zero = [r["feature"] for r in zv.collect() if r["decision"] == "drop"]
    num1 = [c for c in num if c not in dropped_zero]

    tc = _small(features.target_correlation(train, num1, clean.binary_target(label, normal), relevance))
    dropped_low = [r["feature"] for r in tc.collect() if r["decision"] == "drop"]
    num2 = [c for c in num1 if c not in dropped_low]

    pc = _small(features.pairwise_correlation(train, num2, centres=means))
    rd = _small(features.redundant(pc, num2, redundancy))
    dropped_red = [r["feature"] for r in rd.collect() if r["decision"] == "drop"]
    num3 = [c for c in num2 if c not in dropped_red]
    kept = [c for c in cand if c not in set(dropped_zero) | set(dropped_low) | set(dropped_red)]
    cat = [c for c in kept if dtypes[c] == "string"]
    num_final = [c for c in kept if c in num3]
    params = fit(train, num_final, cat, means=means)
    prep = Preparation(plan, ids, cand, dropped_zero, dropped_low, dropped_red, num_final, cat, params,
                       {"types": plan.table, "variance": zv, "relevance": tc, "pairs": pc, "redundancy": rd})
    return prep, typed_df
