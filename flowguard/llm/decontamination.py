"""Benchmark decontamination: every training passage queries a BM25 index of the test items.

* Index: an inverted index of item words. A posting's impact is its BM25 weight divided by the sum of the item's own
  weights, so a score is the share of an item's weight that a passage covers, 1 for a verbatim copy. Posting lists are
  cut into blocks of items that keep their largest impact.
* Passages: windows of at least twice the longest item, each starting in the middle of the one before, so an item's copy
  lies whole in some passage.
* Retrieval: all items that score at least the threshold. Words that few items have are added up first, for all passages
  of a block of documents at once; an item can only reach the threshold if these and the most that its other words could
  add do (an upper bound per item). Passages with such an item are then searched by block-max WAND, exactly.
* Verification: word trigrams of the item's question and of its answer must be found in the passage; of an item that is
  one text, else those of the whole item.
* Items of fewer than `LEAST_WORDS` words have too few trigrams: they are looked up as whole sequences of words.

The index holds at most `MOST_ITEMS` items, the bound of its broadcast; more items are taken in several rounds.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowguard.llm.common import bounded, map_text, materialize

#: Scripts written without spaces (Thai, Lao, Myanmar, Khmer, kana, Han): each character is a word.
_UNSPACED = r"\u0e01-\u0e4e\u0e81-\u0ecd\u1000-\u103f\u1050-\u108f\u1780-\u17d3\u3041-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
WORDS = re.compile(rf"[^\W_{_UNSPACED}]+|[{_UNSPACED}]")
MOST_ITEMS = 50_000
#: Items with fewer words are matched as whole sequences.
LEAST_WORDS = 5
THRESHOLD = 0.5
OVERLAP = 0.6
_K1, _B = 1.2, 0.75
_BLOCK = 32
#: A word is rare if at most this many items, and this share of them, have it.
_RARE, _RARE_SHARE = 64, 0.05


def words(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def ngrams(w: list[str], n: int = 3) -> set[tuple[str, ...]]:
    """Runs of n words; of fewer words the whole."""
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def split_item(w: list[str]) -> tuple[list[str], list[str]]:
    """Question and answer of an item that is one text: the last quarter, 3 words at least, is taken as the answer."""
    n = max(3, len(w) // 4)
    return w[:-n], w[-n:]


@dataclass(frozen=True)
class Item:
    id: object
    question: frozenset
    answer: frozenset
    whole: frozenset
    #: Words to a run of the question and of the answer: three, or all of a shorter part.
    runs: tuple[int, int]


class Index:
    """Items as (id, words of the question, words of the answer), with the number of all items, their mean length and
    how many of all have each word; `short` are those that are looked up as whole sequences."""

    def __init__(self, items: list[tuple[object, list[str], list[str]]], n_all: int, mean_words: float, having: dict[str, int], short: list[tuple[object, list[str]]] = ()):
        self.items = [Item(i, frozenset(ngrams(q)), frozenset(ngrams(a)), frozenset(ngrams(q + a)), (min(3, len(q)), min(3, len(a)))) for i, q, a in items]
        self.short: dict[int, dict[tuple[str, ...], list[object]]] = {}
        for i, w in short:
            self.short.setdefault(len(w), {}).setdefault(tuple(w), []).append(i)
        self.longest = max((len(q) + len(a) for _, q, a in items), default=0)
        idf = {t: float(np.log(1 + (n_all - n + 0.5) / (n + 0.5))) for t, n in having.items()}
        lists: dict[str, list[tuple[int, float]]] = {}
        for k, (_, q, a) in enumerate(items):
            norm = _K1 * (1 - _B + _B * (len(q) + len(a)) / mean_words)
            weight = {t: idf[t] * n * (_K1 + 1) / (n + norm) for t, n in Counter(q + a).items()}
            whole = sum(weight.values())
            for t, x in weight.items():
                lists.setdefault(t, []).append((k, x / whole))
        self.vocabulary = {t: i for i, t in enumerate(sorted(lists))}
        ordered = [lists[t] for t in self.vocabulary]
        self.posts = [([k for k, _ in p], [x for _, x in p]) for p in ordered]
        #: By list: the last item and the largest impact of each block, and the largest impact of all.
        self.ends = [[p[min(i + _BLOCK, len(p)) - 1][0] for i in range(0, len(p), _BLOCK)] for p in ordered]
        self.block_max = [[max(x for _, x in p[i : i + _BLOCK]) for i in range(0, len(p), _BLOCK)] for p in ordered]
        self.list_max = [max(b) for b in self.block_max]
        most = max(1, min(_RARE, int(_RARE_SHARE * len(items))))
        rare = np.array([len(p) <= most for p in ordered], bool)
        self.rare = rare
        sizes = np.array([len(p) if r else 0 for p, r in zip(ordered, rare, strict=True)], np.int64)
        self.start, self.size = np.cumsum(sizes) - sizes, sizes
        self.item = np.array([k for p, r in zip(ordered, rare, strict=True) if r for k, _ in p], np.int64)
        self.impact = np.array([x for p, r in zip(ordered, rare, strict=True) if r for _, x in p])
        self.other = np.zeros(len(items))  # the most that common words can add to an item
        for p, r in zip(ordered, rare, strict=True):
            if not r:
                for k, x in p:
                    self.other[k] += x

    def hopeful(self, passage: np.ndarray, term: np.ndarray, n_passages: int, threshold: float) -> np.ndarray:
        """Which of the passages may hold an item that reaches the threshold, from their (passage, term) pairs."""
        keep = self.rare[term]
        pairs = np.unique(passage[keep] * len(self.rare) + term[keep])
        at, t = pairs // max(1, len(self.rare)), pairs % max(1, len(self.rare))
        size = self.size[t]
        post = np.repeat(self.start[t] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        cell, back = np.unique(np.repeat(at, size) * len(self.items) + self.item[post], return_inverse=True)
        score = np.bincount(back, weights=self.impact[post], minlength=len(cell))
        out = np.zeros(n_passages, bool)
        out[cell[score + self.other[cell % len(self.items)] >= threshold - 1e-9] // len(self.items)] = True
        if (self.other >= threshold - 1e-9).any():  # items of common words only
            out[:] = True
        return out

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items whose score with the distinct terms is at least the threshold (block-max WAND)."""
        threshold -= 1e-9
        cursors = [[self.posts[t][0][0], 0, t] for t in terms]  # item at the cursor, its place, the list
        found = []

        def forward(c: list, item: int) -> bool:
            """Moves a cursor to the first posting from `item` on; False at the end of the list."""
            c[1] = bisect_left(self.posts[c[2]][0], item, c[1])
            if c[1] == len(self.posts[c[2]][0]):
                return False
            c[0] = self.posts[c[2]][0][c[1]]
            return True

        while cursors:
            cursors.sort()
            bound, p = 0.0, -1
            for p, c in enumerate(cursors):
                bound += self.list_max[c[2]]
                if bound >= threshold:
                    break
            else:
                break
            pivot = cursors[p][0]
            while p + 1 < len(cursors) and cursors[p + 1][0] == pivot:
                p += 1
            blocks = [bisect_left(self.ends[c[2]], pivot, c[1] // _BLOCK) for c in cursors[: p + 1]]
            bound = sum(self.block_max[c[2]][b] for c, b in zip(cursors, blocks, strict=False) if b < len(self.ends[c[2]]))
            if bound < threshold:  # on to where a block ends, or to the next list's item
                here = [self.ends[c[2]][b] + 1 for c, b in zip(cursors, blocks, strict=False) if b < len(self.ends[c[2]])]
                to = min(here + ([cursors[p + 1][0]] if p + 1 < len(cursors) else []), default=pivot + 1)
                cursors[: p + 1] = [c for c in cursors[: p + 1] if forward(c, max(to, pivot + 1))]
            elif cursors[0][0] == pivot:
                score = sum(self.posts[c[2]][1][c[1]] for c in cursors[: p + 1])
                if score >= threshold:
                    found.append((pivot, score))
                cursors[: p + 1] = [c for c in cursors[: p + 1] if forward(c, pivot + 1)]
            else:
                cursors[: p + 1] = [c for c in cursors[: p + 1] if c[0] >= pivot or forward(c, pivot)]
        return found

    def sequences(self, w: list[str]) -> list[tuple[object, float, float, float]]:
        """The short items whose words stand in a row in a text."""
        return [(i, 1.0, 1.0, 1.0) for n, known in self.short.items() for g in ngrams(w, n) & known.keys() for i in known[g]]

    def leaks(self, texts: list[str], threshold: float, overlap: float, one_text: bool = False) -> list[list[tuple[object, float, float, float]]]:
        """For each text of a block the items found: id, score, overlap of the question and of the answer, each from the
        passage where the lesser overlap is best. Of items that are `one_text`, the overlap of the whole is enough."""
        step = max(64, self.longest)
        split = [words(t) for t in texts]
        get = self.vocabulary.get
        terms = [np.array([get(w, -1) for w in ws], np.int64) for ws in split]
        n = np.array([max(1, -(-len(ws) // step)) for ws in split])  # passages start each `step` words
        first = np.cumsum(n) - n
        chunk = np.concatenate([f + np.arange(len(ws)) // step for f, ws in zip(first, split, strict=True)]) if split else np.zeros(0, np.int64)
        term = np.concatenate(terms) if terms else np.zeros(0, np.int64)
        known = term >= 0
        chunk, term = chunk[known], term[known]
        earlier = np.isin(chunk, first, invert=True)  # words in the second half of the passage before
        hopeful = np.zeros(0, bool) if not self.items else self.hopeful(np.concatenate([chunk, chunk[earlier] - 1]), np.concatenate([term, term[earlier]]), int(n.sum()), threshold)
        out: list[list[tuple[object, float, float, float]]] = [self.sequences(ws) for ws in split]
        for p in np.flatnonzero(hopeful):
            d = int(np.searchsorted(first, p, "right") - 1)
            at = int(p - first[d]) * step
            own = {int(t) for t in terms[d][at : at + 2 * step] if t >= 0}
            got = self.search(sorted(own), threshold)
            if got:
                grams = {n: ngrams(split[d][at : at + 2 * step], n) for n in {3}.union(*(self.items[k].runs for k, _ in got)) if n}
                for k, score in got:
                    item = self.items[k]
                    q, a = (len(part & grams[n]) / len(part) if part else 1.0 for part, n in zip((item.question, item.answer), item.runs, strict=True))
                    if q >= overlap and a >= overlap or one_text and len(item.whole & grams[3]) >= overlap * len(item.whole):
                        out[d].append((item.id, score, q, a))
        best = []
        for found in out:
            by_item: dict[object, tuple[object, float, float, float]] = {}
            for x in found:
                if x[0] not in by_item or (min(x[2:]), x[1]) > (min(by_item[x[0]][2:]), by_item[x[0]][1]):
                    by_item[x[0]] = x
            best.append(sorted(by_item.values(), key=lambda x: str(x[0])))
        return best


def indexes(items: DataFrame, id_col: str = "item_id", text_col: str = "text", most: int = MOST_ITEMS) -> list[Index]:
    """Indexes of at most `most` items each, with common statistics over all of them."""
    plain = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = map_text(plain, ["id"], "text", lambda texts: [[words(t) for t in texts]], [("words", pa.list_(pa.string()), "array<string>")])
    rows = materialize(rows.where(F.size("words") > 0).withColumn("key", F.xxhash64("id", "words")), "benchmark-items")
    long = rows.where(F.size("words") >= LEAST_WORDS)
    n_all, mean = long.agg(F.count("*"), F.avg(F.size("words"))).first()
    having = materialize(long.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").count(), "benchmark-words")
    out, rounds = [], -(-rows.count() // most)
    for i in range(rounds):
        part = rows.where(F.pmod("key", F.lit(rounds)) == i)
        own = part.select(F.explode(F.array_distinct("words")).alias("word")).distinct().join(having, "word")
        found = sorted(((r["id"], r["words"]) for r in part.collect()), key=lambda x: (str(x[0]), x[1]))
        if found:
            items, short = [x for x in found if len(x[1]) >= LEAST_WORDS], [x for x in found if len(x[1]) < LEAST_WORDS]
            out.append(Index([(k, *split_item(w)) for k, w in items], n_all, mean, {r["word"]: r["count"] for r in own.collect()}, short))
    return out


def _blocks(batch: pa.RecordBatch, at: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for i in range(0, batch.num_rows, 128):
        part = batch.slice(i, 128)
        yield part, [t or "" for t in part.column(at).to_pylist()]


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP, one_text: bool = False) -> DataFrame:
    """A row for each row of `docs` and item that leaked into it: id_col, item_col, score, question_overlap and
    answer_overlap.

    An item leaked if some passage scores at least `threshold` with it and holds at least `overlap` of the word trigrams
    of its question and of its answer. `one_text` says that items are one text, with no answer of their own: then that
    share of the trigrams of the whole item is enough as well. Defined cases: null or empty texts hold no item; items with a null id or text,
    or without a word, match nothing; items of fewer than LEAST_WORDS words leaked where their words stand in a row (score
    and overlaps 1); of items alike each is reported; null ids of documents stay
    null; repeated rows are each reported; empty tables give an empty table; other columns are ignored. Whole texts are
    searched.
    """
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    arrow_type = pa.list_(pa.struct([("item", pa.string()), ("score", pa.float64()), ("q", pa.float64()), ("a", pa.float64())]))
    plain = bounded(docs).select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    out = None
    for index in indexes(items, item_col, item_text_col):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, texts in _blocks(batch, 1):
                    found = [[{"item": str(i), "score": s, "q": q, "a": a} for i, s, q, a in x] for x in sent.value.leaks(texts, threshold, overlap, one_text)]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, arrow_type)], names=["__id", "found"])

        leaks = plain.mapInArrow(run, f"__id {id_type}, found array<struct<item: string, score: double, q: double, a: double>>")
        leaks = leaks.select("__id", F.explode("found").alias("x"))
        out = leaks if out is None else out.unionAll(leaks)
    if out is None:
        return docs.limit(0).select(id_col, F.lit(None).cast(item_type).alias(item_col), *[F.lit(0.0).alias(c) for c in ("score", "question_overlap", "answer_overlap")])
    return out.select(F.col("__id").alias(id_col), F.col("x.item").cast(item_type).alias(item_col), "x.score", F.col("x.q").alias("question_overlap"), F.col("x.a").alias("answer_overlap"))


def keep_clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP, one_text: bool = False) -> DataFrame:
    """The rows of `docs` into which no item leaked, with their columns as they are; cases are those of find_leaks."""
    names = bounded(docs).columns
    at = names.index(text_col)
    for index in indexes(items, item_col, item_text_col):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, texts in _blocks(batch, at):
                    yield part.filter(pa.array([not x for x in sent.value.leaks(texts, threshold, overlap, one_text)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
