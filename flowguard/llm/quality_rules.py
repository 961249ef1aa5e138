"""Quality by weak supervision: rules vote or abstain, expectation-maximisation learns how far to trust each.

Every rule looks at counts of one whole text and votes good (1), bad (0) or abstains (null). Nothing says which votes
are right, so a latent class model is fitted: each rule has an accuracy on good and on bad texts, votes are independent
given the class, abstaining says nothing. The corpus enters the fit only as counts of vote patterns, of which there are
at most 3 to the number of rules, whatever the number of documents; so the iterations run on the driver over that
bounded table, and the posterior is an expression over the votes.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowguard.llm.common import WORD, map_text, materialize

# Frequent function words of English, French, German and Spanish.
FUNCTION_WORDS = frozenset(
    "the of and to in is that for it was on are with as be this by from at or an not "
    "le la les de des du et en un une que qui dans est pour sur par pas au avec "
    "der die das und ist nicht von zu mit den dem ein eine auf als für sich "
    "el los las y es con su para como del se por al una".split()
)

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_plain", "n_function"]
_SYMBOLS = "#*$%&|<>"


def counts(text: str) -> tuple[int, ...]:
    """The values of `COUNTS` for a whole text."""
    words = WORD.findall(text)
    n = len(words)
    lines = Counter(line for line in text.split("\n") if WORD.search(line))
    n_lines = sum(lines.values())
    windows = list(zip(words, words[1:], words[2:], strict=False))
    seen, repeated = Counter(windows), 0
    if len(seen) < len(windows):
        end = 0  # words before this position are counted
        for i, w in enumerate(windows):
            if seen[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return (
        n,
        sum(map(len, words)),
        sum(map(text.count, _SYMBOLS)),
        n_lines - len(lines),
        repeated,
        n_lines,
        sum(map(str.isupper, words)),
        sum(w.strip(".,;:!?'\"()-").isalpha() for w in words),
        sum(map(FUNCTION_WORDS.__contains__, WORD.findall(text.lower()))),
    )


@dataclass(frozen=True)
class Rule:
    """Votes by `value`: bad from `bad` on, good up to `good`, both inclusive, else abstains. For rules where more is
    better, the value is negated. Null values abstain."""

    name: str
    value: Column
    good: float
    bad: float


def rules() -> list[Rule]:
    n, some = F.col("n_words"), F.when(F.col("n_words") > 0, F.col("n_words"))
    return [
        Rule("too_short", -n, -120, -50),
        Rule("repeats", F.col("n_repeat_words") / some, 0.10, 0.30),
        Rule("same_lines", F.col("n_dup_lines") / F.when(F.col("n_lines") > 1, F.col("n_lines")), 0.05, 0.25),
        Rule("symbols", F.col("n_symbols") / some, 0.05, 0.25),
        Rule("shouting", F.col("n_upper") / some, 0.10, 0.40),
        Rule("odd_words", -(F.col("n_plain") / some), -0.85, -0.60),
        Rule("word_length", F.abs(F.col("word_chars") / some - 5.5), 2.5, 4.5),
        Rule("no_function_words", -(F.col("n_function") / some), -0.12, -0.04),
    ]


def votes(counted: DataFrame) -> DataFrame:
    """`counted` with a column vote_<rule> (1 good, 0 bad, null abstains) for each rule."""
    return counted.withColumns({f"vote_{r.name}": F.when(r.value >= r.bad, 0).when(r.value <= r.good, 1) for r in rules()})


@dataclass(frozen=True)
class Model:
    """Share of good texts; by rule the chances of a good vote on good and on bad texts."""

    good: float
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]


def expectation_maximisation(patterns: list[tuple[tuple[int | None, ...], int]], n_rules: int, rounds: int = 200) -> Model:
    """Fits the model to (votes, number of texts). Accuracies start at 0.8 and keep a prior of 8 right votes to 2 wrong
    (a thousandth of the texts at least), which tells the classes apart; with no texts the prior remains."""
    total = sum(n for _, n in patterns)
    weight = max(10.0, total / 1000)
    model = Model(0.7, (0.8,) * n_rules, (0.2,) * n_rules)
    for _ in range(rounds):
        sums = [[0.8 * weight, weight, 0.2 * weight, weight] for _ in range(n_rules)]
        good = 0.7 * weight
        for seen, n in patterns:
            p = posterior(model, seen) * n
            good += p
            for s, v in zip(sums, seen, strict=True):
                if v is not None:
                    s[0] += p * v
                    s[1] += p
                    s[2] += (n - p) * v
                    s[3] += n - p
        new = Model(good / (total + weight), tuple(s[0] / s[1] for s in sums), tuple(s[2] / s[3] for s in sums))
        moved = max(abs(a - b) for a, b in zip((model.good, *model.on_good, *model.on_bad), (new.good, *new.on_good, *new.on_bad), strict=True))
        model = new
        if moved < 1e-9:
            break
    return model


def _evidence(model: Model) -> tuple[float, list[tuple[float, float]]]:
    """Log odds of good: those before any vote, and by rule what a bad and a good vote add."""
    p = min(max(model.good, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p)), [(math.log((1 - a) / (1 - b)), math.log(a / b)) for a, b in zip(model.on_good, model.on_bad, strict=True)]


def posterior(model: Model, seen: tuple[int | None, ...]) -> float:
    start, by_rule = _evidence(model)
    odds = start + sum(w[v] for w, v in zip(by_rule, seen, strict=True) if v is not None)
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


def posterior_column(model: Model) -> Column:
    start, by_rule = _evidence(model)
    odds = F.lit(start)
    for r, (bad, good) in zip(rules(), by_rule, strict=True):
        vote = F.col(f"vote_{r.name}")
        odds = odds + F.when(vote == 1, good).when(vote == 0, bad).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def count(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    return map_text(docs, keep, text_col, lambda texts: [list(c) for c in zip(*map(counts, texts), strict=True)] or [[] for _ in COUNTS], [(c, pa.int64(), "long") for c in COUNTS])


def fit(voted: DataFrame) -> Model:
    names = [f"vote_{r.name}" for r in rules()]
    rows = voted.groupBy(*names).count().collect()  # at most 3 ** len(names) rows
    return expectation_maximisation([(tuple(r[c] for c in names), r["count"]) for r in sorted(rows, key=str)], len(names))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """One row per input row: id_col, the base counts, base_failed, the votes, p_good and kept.

    kept is false where base_failed, else p_good >= `least`. Defined cases: a null or empty text has no words, so it
    fails the base rules; null ids stay null; repeated rows each keep their row and are judged alike; an empty table
    gives an empty table; columns besides the two are ignored, whatever their names. Counts cover whole texts, the fit
    covers all rows.
    """
    docs = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    voted = votes(materialize(count(docs, ["__id"], "__text"), "quality-counts"))
    p = posterior_column(fit(voted))
    return voted.withColumn("p_good", p).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= least)).withColumnRenamed("__id", id_col)


def keep_good(docs: DataFrame, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of `docs` that `judge` keeps, with their columns as they are."""
    model = fit(votes(count(docs, [], text_col)))
    names = docs.columns
    numbered = docs.select(*[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(names)])
    counted = votes(count(numbered, numbered.columns, f"__{names.index(text_col)}"))
    kept = counted.where(~base_failed() & (posterior_column(model) >= least))
    return kept.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(names)])
