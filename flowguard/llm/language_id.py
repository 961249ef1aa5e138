"""Language identification as inference of a mixture.

Languages are learned as distributions of hashed character trigrams of words. A document is a mixture: each word comes
from one of its languages. For any set of languages, expectation-maximisation finds the proportions; the set is grown
from the best single language by the language with the largest share in the full mixture, as long as the likelihood
gains more than a penalty that grows with the number of words (half its logarithm, plus a constant). Blocks of
documents are handled together as arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowguard.llm.common import bounded

#: Buckets of trigrams: with the number of languages the bound of the model's size (4 bytes each).
BUCKETS = 1 << 17
_ROUNDS = 12
#: Documents, and code points times languages, to a block of arrays at most (a longer text is a block of its own).
_DOCS, _CELLS = 256, 1 << 22
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def blocks(texts: list[str], languages: int = 4) -> Iterator[tuple[int, int]]:
    """Ranges of texts that are handled together."""
    start = points = 0
    for i, t in enumerate(texts):
        if i > start and (i - start >= _DOCS or (points + len(t)) * languages > _CELLS):
            yield start, i
            start, points = i, 0
        points += len(t)
    if start < len(texts):
        yield start, len(texts)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over all texts: the bucket of each trigram, the first trigram of each word, the text of each word.

    A word is a run of letters, in lower case; its trigrams end at each of its letters and just behind it, with a mark
    in front, so a word of n letters has n + 1."""
    points = np.frombuffer(("\0\0\n" + "\n".join(x.lower().replace("\n", " ") for x in texts) + "\n\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    c = points * letter
    c, b, a = c[2:], c[1:-1], c[:-2] * letter[1:-1]  # nothing of the word before stands before a word's mark
    ends = letter[2:] | letter[1:-1]
    starts = (letter[2:] & ~letter[1:-1])[ends]
    first = np.flatnonzero(starts)
    line = np.cumsum(points[2:] == 10, dtype=np.int32)[ends]
    return _hash(a, b, c)[ends].astype(np.int64), first, line[first] - 1


def _hash(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    h = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77) + c * np.uint32(0xC2B2AE3D))
    return (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - 17)


def buckets(a: int, b: int, c: np.ndarray) -> np.ndarray:
    """The buckets of trigrams of code points that end in each of `c` (0: the mark in front of a word, or behind it)."""
    return _hash(np.full(len(c), a, np.uint32), np.full(len(c), b, np.uint32), c)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    log_p: np.ndarray  # BUCKETS x languages


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", smooth: float = 0.5) -> Model:
    """From all rows with a language and a text. Counts are added up by task before they are shuffled; the model has
    BUCKETS times the number of languages, whatever the rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}

        def flush():
            for lang, n in seen.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "bucket", "n"])
            seen.clear()

        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in blocks(texts):
                grams, first, text = trigrams(texts[a:b])
                if not first.size:
                    continue
                of = np.repeat(text, np.diff(np.append(first, grams.size)))
                codes = {x: i for i, x in enumerate(sorted(set(langs[a:b])))}
                lang_of = np.array([codes[x] for x in langs[a:b]])[of]
                for lang, i in codes.items():
                    n = np.bincount(grams[lang_of == i], minlength=BUCKETS)
                    seen[lang] = seen[lang] + n if lang in seen else n
                if len(seen) > 64:
                    yield from flush()
        yield from flush()

    def weigh(group: pa.Table) -> pa.Table:
        n = np.full(BUCKETS, smooth)
        n[group["bucket"].to_numpy()] += group["n"].to_numpy()
        return pa.table({"lang": group["lang"].slice(0, 1), "log_p": pa.array([np.log(n / n.sum()).astype(np.float32).tobytes()], pa.binary())})

    rows = bounded(docs).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")
    counts = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = sorted(counts.groupBy("lang").applyInArrow(weigh, "lang string, log_p binary").collect(), key=lambda r: r["lang"])
    log_p = np.empty((BUCKETS, len(found)), np.float32)
    for i, r in enumerate(found):
        log_p[:, i] = np.frombuffer(r["log_p"], np.float32)
    return Model(tuple(r["lang"] for r in found), log_p)


def _words(grams: np.ndarray, first: np.ndarray, text: np.ndarray, log_p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of each text, by text: the text, how often the word stands in it, and its log likelihoods by
    language. Words of one text with the same trigrams (a 64-bit sum of their hashes) are one."""
    h = (grams.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    key = np.add.reduceat(h ^ (h >> np.uint64(32)), first)
    order = np.lexsort((key, text))
    new = np.append(True, (np.diff(key[order]) != 0) | (np.diff(text[order]) != 0))
    at = np.flatnonzero(new)
    pick, times = order[at], np.diff(np.append(at, order.size))
    length = np.diff(np.append(first, grams.size))[pick]
    likely = np.empty((pick.size, log_p.shape[1]), np.float32)
    ends = np.append(0, np.cumsum(length))
    step = max(1, _CELLS // log_p.shape[1])
    lo = 0
    while lo < pick.size:  # so many words at once that the gathered trigrams stay bounded
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + step, "right")) - 1)
        n = length[lo:hi]
        start = np.append(0, np.cumsum(n)[:-1])
        where = np.repeat(first[pick[lo:hi]] - start, n) + np.arange(n.sum())
        likely[lo:hi] = np.add.reduceat(log_p[grams[where]], start, axis=0)
        lo = hi
    return text[pick], times, likely


def _em(p: np.ndarray, top: np.ndarray, times: np.ndarray, of: np.ndarray, docs: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares by document and language, from equal ones, and the log likelihoods. By distinct word: p, the likelihoods
    divided by the word's largest, whose logarithms are `top`; how often it stands in its document `of` (ascending,
    from 0). Words are taken in parts of bounded size."""
    step = max(1, _CELLS // p.shape[1])
    parts = [slice(lo, min(lo + step, len(p))) for lo in range(0, len(p), step)]
    starts = [np.flatnonzero(np.append(True, np.diff(of[x]) != 0)) for x in parts]
    total = np.bincount(of, times, docs)[:, None]
    share = np.full((docs, p.shape[1]), 1.0 / p.shape[1])
    for _ in range(rounds):
        sums = np.zeros_like(share)
        for x, at in zip(parts, starts):
            joint = p[x] * share[of[x]]
            joint *= (times[x] / np.maximum(joint.sum(axis=1), 1e-30))[:, None]
            sums[of[x][at]] += np.add.reduceat(joint, at, axis=0)
        share = sums / total
    mixed = np.zeros(docs)
    for x, at in zip(parts, starts):
        each = (np.log(np.maximum((p[x] * share[of[x]]).sum(axis=1), 1e-30)) + top[x]) * times[x]
        mixed[of[x][at]] += np.add.reduceat(each, at)
    return share, mixed


def infer(texts: list[str], model: Model, penalty: float) -> list[dict[str, float]]:
    """For each text its languages with their shares, most first; empty without letters (or languages to choose).

    A set of k languages is tried over k columns, however many languages the model has."""
    found: list[dict[str, float]] = [{} for _ in texts]
    grams, first, text = trigrams(texts)
    n_langs = len(model.languages)
    if not first.size or not n_langs:
        return found
    text, times, log_p = _words(grams, first, text, model.log_p)
    top = log_p.max(axis=1)
    docs, of = np.unique(text, return_inverse=True)
    alone = np.zeros((docs.size, n_langs))
    starts = np.flatnonzero(np.append(True, np.diff(of) != 0))
    for lang in range(n_langs):
        alone[:, lang] = np.add.reduceat(log_p[:, lang] * times, starts)
    p = np.exp(np.subtract(log_p, top[:, None], out=log_p), out=log_p)
    sets = alone.argmax(axis=1)[:, None]  # languages of each document, in the order in which they came
    size = np.ones(docs.size, np.int64)
    likely = alone.max(axis=1)
    shares: list[np.ndarray] = [np.ones(1)] * docs.size
    full, most = _em(p, top, times, of, docs.size, _ROUNDS)
    price = penalty + 0.5 * np.log(np.maximum(np.bincount(of, times, docs.size), 2))
    left = np.flatnonzero(most - likely > price)  # no set can gain more than the full mixture
    for k in range(1, n_langs):
        if not left.size:
            break
        open_ = full[left].copy()
        np.put_along_axis(open_, sets[left, :k], -1, axis=1)
        trial = np.concatenate([sets[left, :k], open_.argmax(axis=1)[:, None]], axis=1)
        pick = np.isin(of, left)
        local = np.searchsorted(left, of[pick])
        part = p[np.flatnonzero(pick)[:, None], trial[local]]
        new, gained = _em(part, top[pick], times[pick], local, left.size, 2 * _ROUNDS)
        better = gained - likely[left] > price[left]
        if sets.shape[1] <= k:
            sets = np.concatenate([sets, np.zeros_like(sets[:, :1])], axis=1)
        left, trial, new, gained = left[better], trial[better], new[better], gained[better]
        sets[left, : k + 1], size[left], likely[left] = trial, k + 1, gained
        for d, share in zip(left, new):
            shares[d] = share
        left = left[most[left] - likely[left] > price[left]]
    for i, d in enumerate(docs):
        chosen = sorted(zip(-shares[i], sets[i, : size[i]]))
        found[d] = {model.languages[j]: float(-v) for v, j in chosen}
    return found


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = 6.0) -> DataFrame:
    """One row per input row: id_col, lang_pred, score (share of that language), languages array<struct<lang, share>>.

    Defined cases: a null, empty or letterless text, or a model of no languages, gives `und`, score 0 and no languages;
    equal shares go to the first language by name; null ids stay null; repeated rows each keep their row and agree; an
    empty table gives an empty table; other columns are ignored. Whole texts are read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    struct = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in blocks(texts, max(len(sent.value.languages), 4)):
                rows = [[{"lang": k, "share": min(max(v, 0.0), 1.0)} for k, v in x.items()] for x in infer(texts[a:b], sent.value, penalty)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(rows, struct)], names=[id_col, "languages"])

    typed = docs.schema[id_col].dataType.simpleString()
    found = bounded(docs).select(id_col, F.col(text_col).alias("__text")).mapInArrow(run, f"`{id_col}` {typed}, languages array<struct<lang: string, share: double>>")
    best = F.try_element_at("languages", F.lit(1))
    return found.select(id_col, F.coalesce(best["lang"], F.lit(UNKNOWN)).alias("lang_pred"), F.coalesce(best["share"], F.lit(0.0)).alias("score"), "languages")


def fold(id_: Column, n: int) -> Column:
    """Fold of a row: crc32 of its id as text (null: empty), modulo n."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit(""))) % n
