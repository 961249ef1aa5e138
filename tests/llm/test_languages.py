"""Mixtures of languages against plain expectation-maximisation, and many languages."""

import resource
import time

import numpy as np
import pytest

from flowguard.llm import language_id


def _model(n, seed=1):
    rng = np.random.default_rng(seed)
    log_p = np.log(rng.dirichlet(np.full(64, 0.3), n).T + 1e-4).repeat(language_id.BUCKETS // 64, axis=0).astype(np.float32)
    return language_id.Model(tuple(f"l{i:03d}" for i in range(n)), log_p)


def _text(rng, words):
    return " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(1, 9))) for _ in range(words))


def _plain(text, model, penalty):
    """Word by word, set by set."""
    scores = []
    for word in text.split():
        grams = language_id.trigrams([word])[0]
        scores.append(sum(model.log_p[g].astype(float) for g in grams))
    scores = np.array(scores)

    def em(langs, rounds):
        share = np.full(len(langs), 1 / len(langs))
        lik = np.exp(scores[:, langs] - scores.max(axis=1)[:, None])
        for _ in range(rounds):
            joint = np.maximum(lik * share, 0)
            share = (joint / np.maximum(joint.sum(axis=1), 1e-30)[:, None]).mean(axis=0)
        return share, (np.log(np.maximum(lik @ share, 1e-30)) + scores.max(axis=1)).sum()

    n = len(model.languages)
    chosen = [int(scores.sum(axis=0).argmax())]
    share, likely = np.ones(1), scores[:, chosen[0]].sum()
    full, most = em(list(range(n)), 12)
    price = penalty + 0.5 * np.log(max(len(scores), 2))
    while len(chosen) < n and most - likely > price:
        nxt = max((i for i in range(n) if i not in chosen), key=lambda i: full[i])
        new, gained = em([*chosen, nxt], 24)
        if gained - likely <= price:
            break
        chosen, share, likely = [*chosen, nxt], new, gained
    return {model.languages[i]: s for i, s in zip(chosen, share)}


@pytest.mark.parametrize("langs,cells", [(1, 1 << 22), (5, 1 << 22), (12, 1 << 22), (12, 50)])
def test_inference_equals_plain_em(langs, cells, monkeypatch):
    monkeypatch.setattr(language_id, "_CELLS", cells)
    model, rng = _model(langs), np.random.default_rng(2)
    texts = [_text(rng, k) for k in (1, 2, 9, 40, 150, 400)] + ["", "12 !"]
    texts.append((_text(rng, 5) + " ") * 60)  # few distinct words
    got = language_id.infer(texts, model, 3.0)
    assert any(len(g) > 1 for g in got) or langs == 1
    for text, g in zip(texts, got):
        want = _plain(text, model, 3.0) if any(c.isalpha() for c in text) else {}
        assert set(g) == set(want)
        for lang, share in want.items():
            assert g[lang] == pytest.approx(share, abs=2e-3)


def test_two_hundred_languages_in_time_and_memory():
    model, rng = _model(200), np.random.default_rng(3)
    texts = [_text(rng, 20) for _ in range(400)] + [_text(rng, 30_000)]
    assert all(b - a == 1 or sum(map(len, texts[a:b])) * 200 <= language_id._CELLS for a, b in language_id.blocks(texts, 200))
    before, start = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    for a, b in language_id.blocks(texts, 200):
        assert all(language_id.infer(texts[a:b], model, 6.0))
    assert time.time() - start < 120
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 700


def test_learning_two_hundred_languages(spark):
    rows = [(f"x{i:03d}", chr(97 + i % 26) * 3 + " " + chr(97 + i // 26) * 4) for i in range(200)]
    model = language_id.learn(spark.createDataFrame(rows, "lang string, text string"))
    assert len(model.languages) == 200 and model.log_p.shape == (language_id.BUCKETS, 200)
    assert np.allclose(np.exp(model.log_p.astype(float)).sum(axis=0), 1, atol=1e-3)
    best = [max(language_id.infer([t], model, 6.0)[0].items(), key=lambda kv: kv[1])[0] for _, t in rows[:20]]
    assert best == [lang for lang, _ in rows[:20]]
