"""Toxicity of restored text: a noisy-channel decoder undoes disguises before a linear model scores.

* Channel: a suspicious stretch (letters mixed with look-alike signs, a letter three or more times in a row, single
  letters set apart) becomes a lattice. A sign may stand for each letter it resembles, a run for one or two letters, a
  separator for nothing or for a word's end.
* Source: a character trigram model of the words of all documents (hashed counts, `language_id.BUCKETS` numbers).
* Viterbi finds the likeliest letters; restored words join the plain words of the text.
* Score: logistic regression over the presence of words and word beginnings that labelled toxic texts favour, fitted by
  MLlib on labelled rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowguard.llm import language_id
from flowguard.llm.common import bounded, materialize

# Signs and the letters they stand for.
LOOKS_LIKE = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "€": "e", "£": "l",
}
_SIGNS = re.escape("".join(LOOKS_LIKE))
_LETTER = r"[^\W\d_]"
_ANY = rf"(?:{_LETTER}|[{_SIGNS}])"
WORDS = re.compile(rf"{_LETTER}+")
#: Marks that set letters apart.
_MARKS = r"[.*_,;:/\\~=^#·-]"
#: A sign before or behind a letter. Signs that end a word may be punctuation: the decoder weighs both.
_SIGN = re.compile(rf"[{_SIGNS}](?={_LETTER})|(?<={_LETTER})[{_SIGNS}]")
#: Three or more single letters or signs, each set apart by white space, or pieces of up to three set apart by other
#: marks; each with a quicker test that comes first. A stretch ends where no letter or digit follows.
_SPACED = re.compile(rf"(?<![\w'’{_SIGNS}]){_ANY}(?:\s+{_ANY}){{2,}}(?!\w)")
_SPACED_HERE = re.compile(r"\s\S\s+\S(?!\w)")
_MARKED = re.compile(rf"(?<![\w{_SIGNS}.*_-]){_ANY}{{1,3}}(?:{_MARKS}{_ANY}{{1,2}}){{2,}}[{_SIGNS}]*(?!\w)")
_MARKED_HERE = re.compile(rf"{_MARKS}{_ANY}{{1,2}}{_MARKS}")
_SPACE = re.compile(r"\s+")
_LONGEST = 256
_LETTERS_OF_MODEL = "abcdefghijklmnopqrstuvwxyzàáâäçèéêëíîïñóôöùúûüß"

#: Labelled rows and features of the fit at most.
MOST_LABELS = 200_000
MOST_FEATURES = 20_000
#: Decoded stretches that a task keeps at most, and half the features.
_KEPT = 100_000


# --- the source model -----------------------------------------------------------------------------------------------


def character_counts(docs: DataFrame, text_col: str) -> np.ndarray:
    """Counts of hashed trigrams over the words of all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(language_id.BUCKETS, np.int64)
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for a, b in language_id.blocks(texts):
                n += np.bincount(language_id.trigrams(texts[a:b])[0], minlength=language_id.BUCKETS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["bucket", "n"])

    rows = bounded(docs).select(F.col(text_col)).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(language_id.BUCKETS, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


class CharacterModel:
    """log P(letter or word end | two before it), from hashed counts."""

    _NEXT = np.array([0, *map(ord, _LETTERS_OF_MODEL)], np.uint32)

    def __init__(self, counts: np.ndarray, smooth: float = 0.2):
        self.counts, self.smooth, self.known = counts, smooth, {}

    def log_p(self, a: str, b: str, c: str) -> float:
        """`""` is the mark in front of a word, and its end."""
        if (a, b) not in self.known:
            n = self.counts[language_id.buckets(ord(a) if a else 0, ord(b) if b else 0, self._NEXT)] + self.smooth
            table = dict(zip(["", *_LETTERS_OF_MODEL], np.log(n / n.sum()).tolist(), strict=True))
            self.known[a, b] = table, math.log(self.smooth / n.sum())
        table, unknown = self.known[a, b]
        return table.get(c, unknown)


# --- the channel and its decoder ------------------------------------------------------------------------------------

_END = " "  # an option that ends the word
_SUBSTITUTED, _DROPPED, _JOINED, _SPLIT = -1.0, -0.5, -0.5, -2.0
#: A sign at the end that is no letter: `!` ends many words, the others few.
_PUNCTUATION, _STRAY = -0.5, -4.0


def lattice(stretch: str) -> list[list[tuple[str, float]]]:
    """For each character its options: what it stands for (a letter, nothing, a word's end) and the channel's log cost."""
    out, at, tail = [], 0, len(stretch.rstrip("".join(LOOKS_LIKE)))
    for c, run in groupby(stretch):
        n = len(list(run))
        at += n
        if not (c.isalpha() or c in LOOKS_LIKE):
            out += [[("", _JOINED), (_END, _SPLIT)]] * n
            continue
        keep = [(c, 0.0)] if c.isalpha() else [(x, _SUBSTITUTED) for x in LOOKS_LIKE[c]]
        if at > tail:  # signs that end the stretch
            keep.append(("", _PUNCTUATION if c == "!" else _STRAY))
        out += [keep] * min(n, 2) if n < 3 else [keep, [*keep, ("", _DROPPED)]]  # what is left of a run adds nothing
    return out


def decode(stretch: str, model: CharacterModel) -> list[str]:
    """The likeliest words of a stretch (Viterbi over the last two letters)."""
    best: dict[tuple[str, str], tuple[float, tuple]] = {("", ""): (0.0, ())}
    for options in [*lattice(stretch), [(_END, 0.0)]]:
        new: dict[tuple[str, str], tuple[float, tuple]] = {}
        for (a, b), (score, path) in best.items():
            for c, cost in options:
                if c == "":
                    key, value = (a, b), (score + cost, path)
                elif c == _END:
                    key, value = ("", ""), (score + cost + (model.log_p(a, b, "") if b else 0.0), (path, _END))
                else:
                    key, value = (b, c), (score + cost + model.log_p(a, b, c), (path, c))
                if key not in new or value[0] > new[key][0]:
                    new[key] = value
        best = new
    path, letters = max(best.values(), key=lambda x: x[0])[1], []
    while path:
        path, c = path
        letters.append(c)
    return "".join(reversed(letters)).split()


def _runs(text: str) -> list[int]:
    """Where a letter stands for the first time of three or more in a row."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) < 3:
        return []
    same = points[1:] == points[:-1]
    at = np.flatnonzero(same[1:] & same[:-1])
    return [i for i in at.tolist() if text[i].isalpha() and not (i and text[i - 1] == text[i])] if at.size else []


class Restorer:
    """Words of whole texts, disguised ones restored. Decoded stretches are kept between texts."""

    def __init__(self, model: CharacterModel):
        self.model, self.known = model, {}

    def decode(self, stretch: str) -> list[str]:
        if len(stretch) > _LONGEST:  # no word is that long: piece by piece, all of it
            return [w for at in range(0, len(stretch), _LONGEST) for w in self.decode(stretch[at : at + _LONGEST])]
        if stretch not in self.known:
            if len(self.known) > _KEPT:
                self.known.clear()
            self.known[stretch] = decode(stretch, self.model)
        return self.known[stretch]

    def words(self, text: str) -> set[str]:
        """Plain words in lower case, and those that the suspicious stretches hide."""
        low = text.lower()
        words = set(WORDS.findall(low))
        for at in _runs(low):
            start, end = at, at + 3
            while start and low[start - 1].isalpha():
                start -= 1
            while end < len(low) and low[end].isalpha():
                end += 1
            words.update(self.decode(low[start:end]))
        end = 0
        for m in _SIGN.finditer(low):
            if m.start() >= end:
                start, end = m.start(), m.end()
                while start and (low[start - 1].isalpha() or low[start - 1] in LOOKS_LIKE):
                    start -= 1
                while end < len(low) and (low[end].isalpha() or low[end] in LOOKS_LIKE):
                    end += 1
                words.update(self.decode(low[start:end]))
        for here, pattern in ((_SPACED_HERE, _SPACED), (_MARKED_HERE, _MARKED)):
            if here.search(" " + low):
                for m in pattern.finditer(low):
                    words.update(self.decode(_SPACE.sub(" ", m[0])))
        return words


def features(words: set[str]) -> set[str]:
    """Words of three letters or more, and the first four, five and six letters of longer ones."""
    out = {"=" + w for w in words if len(w) > 2}
    for n in (4, 5, 6):
        out |= {"^" + w[:n] for w in words if len(w) > n}
    return out


class Picker:
    """The features of a text that are wanted. Only words that begin like one of these are looked at closely."""

    def __init__(self, wanted):
        self.wanted, self.starts = wanted, {f[1:5] for f in wanted}

    def __call__(self, words: set[str]) -> list[str]:
        likely = {w[:4] for w in words} & self.starts
        return sorted(features({w for w in words if w[:4] in likely}).intersection(self.wanted)) if likely else []


# --- learning and scoring -------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    counts: np.ndarray
    weights: dict[str, float]
    intercept: float

    def score(self, found: list[str]) -> float:
        z = self.intercept + math.fsum(self.weights[f] for f in found)
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def _labelled(labels: DataFrame, id_col: str, label_col: str) -> dict[int, int]:
    """At most about MOST_LABELS labelled ids, by a hash of the id where there are more; an id's largest label counts."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
    n = labels.count()
    if n > MOST_LABELS:
        rows = rows.where(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < int(1_000_000 * MOST_LABELS / n))
    return {r[id_col]: r["y"] for r in rows.collect()}


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", all_docs: DataFrame | None = None) -> Model:
    """The character model from `all_docs` (else `docs`), weights from the labelled rows of `docs`."""
    sc = docs.sparkSession.sparkContext
    counts = character_counts(all_docs if all_docs is not None else docs, text_col)
    given = sc.broadcast((_labelled(labels, id_col, label_col), counts))
    share = sum(given.value[0].values()) / max(1, len(given.value[0]))
    start = math.log(max(share, 1e-4) / max(1 - share, 1e-4))
    if not 0 < share < 1:
        return Model(counts, {}, start)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, set[str]]]:
        """Label and words of each labelled row."""
        ys, restorer = given.value[0], Restorer(CharacterModel(given.value[1]))
        for batch in batches:
            for i, id_ in enumerate(batch.column(0).to_pylist()):
                if id_ in ys:
                    yield ys[id_], restorer.words(batch.column(1)[i].as_py() or "")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on, off = Counter(), Counter()

        def flush():
            keys = list(on.keys() | off.keys())
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([on[k] for k in keys], pa.int64()), pa.array([off[k] for k in keys], pa.int64())], names=["feature", "n1", "n0"])
            on.clear()
            off.clear()
            return out

        for y, words in rows_of(batches):
            (on if y else off).update(features(words))
            if len(on) + len(off) > 2 * _KEPT:
                yield flush()
        yield flush()

    texts = docs.select(id_col, F.col(text_col).alias("__text"))
    tallied = texts.mapInArrow(tally, "feature string, n1 long, n0 long").groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    rate = (F.col("n1") + share) / (F.col("n1") + F.col("n0") + 1)
    useful = tallied.where((F.col("n1") >= 3) & (rate >= 0.5)).withColumn("worth", F.col("n1") * (rate - share))
    vocabulary = [r["feature"] for r in useful.orderBy(F.desc("worth"), "feature").limit(MOST_FEATURES).collect()]
    if not vocabulary:
        return Model(counts, {}, start)
    chosen = sc.broadcast(frozenset(vocabulary))

    def chosen_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pick = Picker(chosen.value)
        rows = ((float(y), pick(words)) for y, words in rows_of(batches))
        while some := list(islice(rows, 1000)):
            yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in some], pa.float64()), pa.array([x for _, x in some], pa.list_(pa.string()))], names=["label", "found"])

    rows = materialize(texts.mapInArrow(chosen_rows, "label double, found array<string>"), "toxicity-rows")
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="found", outputCol="features", binary=True).transform(rows)
    fitted = LogisticRegression(maxIter=60, regParam=1e-4, elasticNetParam=0.5, standardization=False).fit(vectors.select("label", "features"))
    weights = {f: float(w) for f, w in zip(vocabulary, fitted.coefficients.toArray(), strict=True) if w}
    return Model(counts, weights, float(fitted.intercept))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, score (0 to 1) and predicted (1 from 0.5 on).

    Defined cases: a null or empty text has no words, so its score is that of the intercept; null ids stay null;
    repeated rows each keep their row and agree; an empty table gives an empty table; other columns are ignored. Whole
    texts are read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        restorer, pick = Restorer(CharacterModel(m.counts)), Picker(m.weights.keys())
        for batch in batches:
            scores = [m.score(pick(restorer.words(t.as_py() or ""))) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=[id_col, "score"])

    typed = docs.schema[id_col].dataType.simpleString()
    scored = bounded(docs).select(id_col, F.col(text_col).alias("__text")).mapInArrow(run, f"`{id_col}` {typed}, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
