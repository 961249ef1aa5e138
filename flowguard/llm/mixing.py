"""Mixing sources to target weights by hash order and distributed prefix sums.

Every row gets a hash-random key from its id, and a source is read in the order of its keys: as many whole epochs as
its budget holds, then one more up to the point where the budget ends. That point is found by prefix sums on two levels.
Keys are uniform, so equal ranges of them hold about equal numbers of rows of a source, however large it is. Sums by
(source, range) are accumulated first; only in the one range of each source where its budget ends are rows sorted and
accumulated one by one. What decides about a row is then the comparison of its own key with its source's cut. Budgets
are met to the word: of the document at the cut the mix takes only as many words as are left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowguard.llm.common import materialize

WEIGHTS = (5, 2, 1)
#: Rows of all sources to a range of keys.
RANGE_ROWS = 20_000
#: Sources whose cuts are broadcast (some 100 bytes each); with more the join shuffles.
BROADCAST_SOURCES = 50_000


def n_words(text: Column) -> Column:
    """Runs without space, tab, newline, vertical tab, form feed and carriage return; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hash_key(id_: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed), F.coalesce(id_.cast("string"), F.lit(""))))


def _range_of(key: Column, n: int) -> Column:
    return F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * n / 2**32).cast("int")


def targets(by_source: DataFrame, weights: Sequence[int], most_epochs: int) -> DataFrame:
    """Adds target to (no_source, src, source_size): weights go round the sources by name, unknown ones last; together
    the targets make up all sizes; one stops at `most_epochs` times its source's size and the rest is shared anew by
    weight. Sources are filled in the order of size to weight: the first that its share doesn't exceed, and all after
    it, have room. One task sees one row of each source."""
    w = Window.orderBy("no_source", "src")
    rank = F.row_number().over(w) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    filled = Window.orderBy("room", "no_source", "src")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = by_source.withColumn("weight", weight).withColumn("cap", F.lit(most_epochs) * F.col("source_size")).withColumn("room", F.col("cap") / F.col("weight"))
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    out = out.withColumn("level", left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    open_level = F.min(F.when(F.col("level") <= F.col("room"), F.struct("room", "no_source", "src", "level"))).over(everything)["level"]
    return out.withColumn("target", F.when(F.col("level") > F.col("room"), F.col("cap").cast("double")).otherwise(open_level * F.col("weight")))


def cuts(sized: DataFrame, weights: Sequence[int], most_epochs: int) -> tuple[DataFrame, bool]:
    """From rows (no_source, src, key, size): by source its size, target, whole epochs and cut (key, size) with `part`, the
    words taken of a row at the cut itself; and whether the sources are few enough to broadcast."""
    by_source = materialize(sized.groupBy("no_source", "src").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), "mix-sources")
    n_rows, n_sources = by_source.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.count("*")).first()
    n = max(16, -(-n_rows // RANGE_ROWS))
    small = n_sources <= BROADCAST_SOURCES
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goal = targets(by_source, weights, most_epochs).select("no_source", "src", "source_size", "target", epochs.cast("long").alias("epochs"))
    goal = materialize(goal.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-targets")
    ranged = sized.withColumn("range", _range_of(F.col("key"), n))
    by_range = ranged.groupBy("no_source", "src", "range").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("no_source", "src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    start = by_range.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0)))
    holds = start.join(goal, ["no_source", "src"]).where((F.col("start") <= F.col("rest")) & (F.col("rest") < F.col("start") + F.col("words")))
    holds = holds.select("no_source", "src", "range", "start", "rest")
    at_cut = ranged.join(F.broadcast(holds) if small else holds, ["no_source", "src", "range"])
    alike = at_cut.groupBy("no_source", "src", "key", "size", "start", "rest").agg(F.sum("size").alias("words"))
    within = Window.partitionBy("no_source", "src").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    alike = alike.withColumn("before", F.col("start") + F.coalesce(F.sum("words").over(within), F.lit(0)))
    cut = alike.where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))
    cut = cut.select("no_source", "src", F.col("key").alias("cut_key"), F.col("size").alias("cut_size"), F.floor((F.col("rest") - F.col("before")) * F.col("size") / F.col("words")).alias("part"))
    return materialize(goal.join(cut, ["no_source", "src"], "left"), "mix-cuts"), small


def _with_cut(rows: DataFrame, cut: DataFrame, small: bool) -> DataFrame:
    """Adds source_size, target, epochs and part: the words that the last, unfinished epoch takes of the row."""
    here, there = F.struct("key", "size"), F.struct(F.col("cut_key").alias("key"), F.col("cut_size").alias("size"))
    part = F.when(here < there, F.col("size")).when(here == there, F.col("part")).otherwise(0)
    return rows.join(F.broadcast(cut) if small else cut, ["no_source", "src"]).withColumn("part", part.cast("long"))


def _rows(source: Column, id_: Column, size: Column, seed: str) -> dict[str, Column]:
    return {"no_source": source.isNull(), "src": F.coalesce(source.cast("string"), F.lit("")), "key": hash_key(id_, seed), "size": size}


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, most_epochs: int = 3, seed: str = "mix:") -> DataFrame:
    """One row per input row: id_col, source, size, source_size, target, and taken: the words that the mix takes of it.

    Each source's taken words are its target, rounded down. Defined cases: a null or empty text has size 0 and adds
    nothing; a null source is one source, after all others; a null id has a key of its own; rows alike in source, id and
    size share evenly what is taken of them; an empty table gives an empty table; other columns are ignored. The result
    depends on ids, sizes and `seed` alone, so reruns agree.
    """
    id_, source = F.col(id_col), F.col(source_col)
    cols = _rows(source, id_, n_words(F.col(text_col)), seed)
    sized = materialize(docs.select(id_.alias("__id"), source.alias("source"), *[c.alias(n) for n, c in cols.items()]), "mix-sizes")
    placed = _with_cut(sized, *cuts(sized, weights, most_epochs))
    taken = F.col("epochs") * F.col("size") + F.col("part")
    return placed.select(F.col("__id").alias(id_col), "source", "size", "source_size", "target", taken.alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, most_epochs: int = 3, seed: str = "mix:") -> DataFrame:
    """The mix itself: the rows of `docs` with their columns, once for each epoch that takes them, with mix_epoch and
    mix_words, the words it takes of the text (all, or fewer at the cut). Cases are those of `mix`; documents of which
    no word is taken go. Columns of `docs` named like the two new ones give way to them."""
    names = [c for c in docs.columns if c.lower() not in ("mix_epoch", "mix_words")]
    plain = docs.select(*[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(names)])
    at = {c: F.col(f"__{names.index(c)}") for c in (id_col, text_col, source_col)}
    rows = plain.withColumns(_rows(at[source_col], at[id_col], n_words(at[text_col]), seed))
    sized = materialize(rows.select("no_source", "src", "key", "size"), "mix-sizes")
    placed = _with_cut(rows, *cuts(sized, weights, most_epochs)).where("size > 0")
    words = F.concat(F.array_repeat("size", F.col("epochs").cast("int")), F.when(F.col("part") > 0, F.array("part")).otherwise(F.array().cast("array<bigint>")))
    return placed.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(names)], F.posexplode(words).alias("mix_epoch", "mix_words")).withColumn("mix_epoch", F.col("mix_epoch") + 1)
