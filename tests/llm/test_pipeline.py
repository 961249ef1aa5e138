"""The stages of the corpus pipeline, each against brute force on its own input."""

import re
from collections import defaultdict

import pandas as pd
import pytest

import corpus_pipeline
from flowguard.llm import quality_rules, secret_scan
from flowguard.llm.common import materialize

from .conftest import SF
from .test_operators import plain_components, plain_leaks, water_level

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark):
    """The documents and what each stage made of them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.toPandas()]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), f"test-{name}")
        out.append(docs.toPandas())
    return out


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_join", "decontamination", "secret_scan", "mixing"]


def test_columns_stay(steps):
    for x in steps[:-1]:
        assert list(x.columns) == COLUMNS
    assert list(steps[-1].columns) == [*COLUMNS, "mix_epoch", "mix_words"]


def test_quality_stage(steps):
    before, after = steps[0], steps[1]
    merged = after.merge(before, on=COLUMNS)
    assert len(merged) == len(after) < len(before)
    gone = before[~before.doc_id.isin(after.doc_id)]
    counts = before.set_index("doc_id").text.map(quality_rules.counts)
    failed = {i for i, c in counts.items() if c[0] < 50 or 100 * c[4] > 50 * c[0]}
    assert failed <= set(gone.doc_id)
    labels = pd.read_parquet(f"{SF}/labels.parquet")
    good = set(labels[labels.quality == 1].doc_id) - failed
    assert not good & set(gone.doc_id)
    assert not set(labels[labels.quality == 0].doc_id) & set(after.doc_id)


def test_near_duplicate_stage(steps):
    before, after = steps[1], steps[2]
    groups = defaultdict(list)
    for i, _, c in plain_components(list(before.doc_id), list(before.text), 5, 80):
        groups[c].append(i)
    assert sorted(after.doc_id) == sorted(min(x) for x in groups.values())
    assert len(after.merge(before, on=COLUMNS)) == len(after)


def test_decontamination_stage(steps):
    before, after = steps[2], steps[3]
    items = pd.read_parquet(f"{SF}/benchmark.parquet")
    leaked = {i for i, _ in plain_leaks(list(before.doc_id), list(before.text), list(zip(items.item_id, items.text, strict=True)))}
    assert set(after.doc_id) == set(before.doc_id) - leaked
    assert not any(x in t for t in after.text for x in items.text)


def test_secret_stage(steps):
    before, after = steps[3].set_index("doc_id"), steps[4].set_index("doc_id")
    assert set(before.index) == set(after.index)
    for i, row in after.iterrows():
        text = before.text[i]
        covered = [False] * (len(text) + 1)
        for rule in secret_scan.RULES:
            for m in re.finditer(rule.pattern, text):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    covered[m.start() : m.end()] = [True] * (m.end() - m.start())
        assert ("[SECRET]" in row.text) == any(covered)
        parts = "".join("\0" if covered[j] else c for j, c in enumerate(text))
        assert row.text.replace("[SECRET]", "\0") == re.sub("\0+", "\0", parts) or parts.count("\0\0") > 0
        assert row.n_chars == len(row.text)


def test_mixing_stage(steps):
    before, after = steps[4], steps[5]
    words = before.set_index("doc_id").text.map(lambda t: len(re.findall("[^\x20\x09-\x0d]+", t)))
    sizes = {s: int(words[g.doc_id].sum()) for s, g in before.groupby("source")}
    want = water_level(sizes)
    taken = after.groupby("source").mix_words.sum()
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1
    assert (after.mix_epoch <= 3).all() and (after.mix_words <= after.doc_id.map(words)).all()
    assert not after.duplicated(["doc_id", "mix_epoch"]).any()


def test_run_is_the_stages(spark, steps):
    got = corpus_pipeline.run(spark, SF).toPandas()
    key = ["doc_id", "mix_epoch"]
    assert got.sort_values(key).reset_index(drop=True).equals(steps[-1].sort_values(key).reset_index(drop=True))


def test_stages_take_empty_and_odd_documents(spark, odd, nothing):
    for docs in (nothing.select(*COLUMNS), odd):
        for name, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, SF), f"test-{name}")
        assert docs.count() >= 0
