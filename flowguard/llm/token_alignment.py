"""Alignment of two tokenizers' tokens by an associative monoid of text fragments.

Both vocabularies end a token before a single space or newline that stands between two characters that aren't white space:
no piece of either crosses it (`Encoders` proves this for the pieces; the byte-level pre-tokenizer starts a token there by
its rule). Such places cut a text into units, which are encoded and aligned once per worker, whatever text they come from.

* Fragments. Any range of a text yields an open prefix up to its first cut, closed groups (of the units between cuts) and
  an open suffix. Two neighbours compose: what the suffix of one and the prefix of the other close together goes between
  their closed groups. This is associative, so fragments of a very long text are made in tasks of their own and reduced as
  a tree; a text of usual length is one fragment.
* Counts of linked id pairs over the corpus are sums over units, combined in each task before the shuffle. The most
  frequent pairs (at most `HEAD_MAX`) are sent to the tasks, and what a row has of any other pair joins by a shuffle.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowguard.llm.common import bounded, materialize

#: Characters of a fragment; longer texts are cut into several.
CHUNK = 32_768
#: Pairs that are sent to the tasks (17 bytes each).
HEAD_MAX = 200_000
#: Fragments that one step of the tree reduction composes.
FAN = 16
_KNOWN = 400_000
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
_LATIN = re.compile("[\n -~\u00a1-\u024f]*")
#: How byte-level vocabularies split texts (a fixed value).
_BYTE_LEVEL_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_UNIT = re.compile(r"\s*\S+(?:(?:\s{2,}|[^\S\n ])\S+)*(?:\s+\Z)?")


def units(text: str) -> list[str]:
    """The units of a text that starts at a cut, or of a whole one."""
    return _UNIT.findall(text) or [text]


# --- units: encoded, aligned -----------------------------------------------------------------------------------------


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoders:
    """Vocabulary A (byte-level, a tokenizers file) and B (a sentencepiece model)."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.quick = None
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = _byte_letters()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 2)
        for t, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in t)
        spec = json.loads(self.a.to_str())
        merged = [vocabulary.get("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in spec["model"]["merges"]]
        splits = spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        if splits and spec["normalizer"] is None and merged == list(range(256, 256 + len(merged))):
            import tiktoken

            ranks = {self.a_bytes[i]: i for i in vocabulary.values() if i < 256 + len(merged)}
            self.quick = tiktoken.Encoding("a", pat_str=_BYTE_LEVEL_SPLIT, mergeable_ranks=ranks, special_tokens={})
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in v], np.int64) for v in (self.a_bytes, self.b_bytes))
        # ids as text with what follows them: for A , or | and for B , or ;
        self.words = [b"%d%s" % (i, end) for v, ends in ((self.a_bytes, (b",", b"|")), (self.b_bytes, (b",", b";"))) for end in ends for i in range(len(v))]
        texts = [p for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        if any(re.search("[^▁]▁", p) or "\n" in p for p in texts) or self.b.encode("\nx", out_type=str)[0] != "▁":
            raise ValueError(f"pieces of {b_path} cross the cuts between units")

    def encode(self, found: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and of B of units; those of B without the space mark that the model puts before a newline. A vocabulary
        whose ids are the ranks of its merges encodes Latin text several times as fast as ranks."""
        a: list = [None] * len(found)
        if self.quick:
            a = [self.quick.encode_ordinary(u) if _LATIN.fullmatch(u) else None for u in found]
        left = [i for i, x in enumerate(a) if x is None]
        for i, e in zip(left, self.a.encode_batch_fast([found[i] for i in left], add_special_tokens=False), strict=True):
            a[i] = e.ids
        b = self.b.encode([u[1:] if u[0] == " " else u for u in found], num_threads=1)
        return a, [y if u[0] == " " else y[1:] for u, y in zip(found, b, strict=True)]

    def _whole(self, unit: str, a: list[int], b: list[int]) -> bool:
        raw = unit.encode()
        return b"".join(map(self.a_bytes.__getitem__, a)) == raw == b"".join(map(self.b_bytes.__getitem__, b))

    def align(self, found: list[str], texts: bool = True) -> Aligned:
        """The units' tokens, aligned all at once: one after the other they are one text, in which units end groups. Without
        `texts` the groups aren't written out."""
        a, b = self.encode(found)
        one = "".join(found).encode()
        size = np.array([len(u.encode()) for u in found], np.int64)
        fits = np.ones(len(found), bool)
        flat_a, flat_b = (np.fromiter(chain.from_iterable(v), np.int64) for v in (a, b))
        of_a, of_b = (np.repeat(np.arange(len(found)), [len(x) for x in v]) for v in (a, b))
        equal = b"".join(map(self.a_bytes.__getitem__, flat_a.tolist())) == one == b"".join(map(self.b_bytes.__getitem__, flat_b.tolist()))
        for flat, of, sizes in ((flat_a, of_a, self.a_size), (flat_b, of_b, self.b_size)):
            equal = equal and (np.bincount(of, sizes[flat], len(found)) == size).all()
        if not equal:  # some unit's tokens aren't its bytes: it is left out
            fits = np.array([self._whole(*x) for x in zip(found, a, b, strict=True)])
            flat_a, flat_b, of_a, of_b = flat_a[fits[of_a]], flat_b[fits[of_b]], of_a[fits[of_a]], of_b[fits[of_b]]
        end_a, end_b = np.cumsum(self.a_size[flat_a]), np.cumsum(self.b_size[flat_b])
        last_a, last_b = _among(end_a, end_b), _among(end_b, end_a)
        ends = np.sort(np.concatenate([end_a, end_b[~last_b]]), kind="stable")  # merges two sorted runs
        to_a, to_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        n = len(found)
        count_a, count_b = np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n)
        groups = [b""] * n
        if texts:
            group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
            order = np.empty(len(flat_a) + len(flat_b), np.int64)
            n_a, n_b = len(self.a_bytes), len(self.b_bytes)
            order[np.arange(len(flat_a)) + np.searchsorted(group_b, group_a)] = flat_a + n_a * last_a
            order[np.arange(len(flat_b)) + np.searchsorted(group_a, group_b, "right")] = 2 * n_a + flat_b + n_b * last_b
            words, stops = list(map(self.words.__getitem__, order.tolist())), np.cumsum(count_a + count_b).tolist()
            groups = [b"".join(words[i:j])[:-1] for i, j in zip([0, *stops], stops)]
        link_of = of_a[to_a] if len(ends) else np.zeros(0, np.int64)
        counts = np.stack([count_a, count_b, np.bincount(of_a[last_a], minlength=n), np.bincount(link_of, minlength=n)], axis=1)
        return Aligned(groups, counts, flat_a[to_a] << 20 | flat_b[to_b], link_of, fits)


def _among(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which of the sorted numbers x are among the sorted numbers `of`."""
    return of[np.minimum(np.searchsorted(of, x), len(of) - 1)] == x if len(of) else np.zeros(len(x), bool)


@dataclass
class Aligned:
    """Of some units: groups as text; n_a, n_b, n_groups, n_links; the pair code of each link and its unit; and which
    units' tokens are their bytes (the others have nothing)."""

    groups: list[bytes]
    counts: np.ndarray
    pairs: np.ndarray
    link_of: np.ndarray
    fits: np.ndarray


@lru_cache(maxsize=2)
def encoders(a_path: str, b_path: str) -> Encoders:
    return Encoders(a_path, b_path)


class Units:
    """Units met by a task, by number: text of groups, counts, pairs that the head doesn't have. Without a head their
    pairs are kept instead. Forgotten when there are too many of them."""

    def __init__(self, encode: Encoders, head: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
        self.by, self.head = encode, head
        self.clear()

    def clear(self) -> None:
        self.index, self.groups, self.links, self.rest, self.bad = {}, [], [], {}, set()
        self.counts = np.zeros((1 << 16, 6), np.int64)  # n_a, n_b, n_groups, n_links, n_best, count_sum

    def full(self) -> bool:
        return len(self.index) > _KNOWN

    def learn(self, found: Iterable[str]) -> None:
        if self.full():
            self.clear()
        fresh = [u for u in set(found) if u not in self.index]
        if not fresh:
            return
        start, made = len(self.groups), self.by.align(fresh, texts=self.head is not None)
        self.index.update(zip(fresh, range(start, start + len(fresh)), strict=True))
        self.groups += made.groups
        while start + len(fresh) > len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
        rows = self.counts[start : start + len(fresh)]
        rows[:, :4] = made.counts
        self.bad.update((start + np.flatnonzero(~made.fits)).tolist())
        if self.head is None:
            self.links.append((made.pairs, made.link_of + start))
            return
        key, count, is_best = self.head
        known = np.zeros(len(made.pairs), bool)
        if len(key):
            to = np.minimum(np.searchsorted(key, made.pairs), len(key) - 1)
            known = key[to] == made.pairs
            for column, values in ((4, is_best), (5, count)):
                rows[:, column] = np.bincount(made.link_of[known], values[to[known]], len(fresh)).astype(np.int64)
        for at, pair in zip((made.link_of[~known] + start).tolist(), made.pairs[~known].tolist(), strict=True):
            self.rest.setdefault(at, []).append(pair)

    def pair_sums(self, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs and how many links hold them, if units were seen so often."""
        pairs, of = (np.concatenate([x[i] for x in self.links]) if self.links else np.zeros(0, np.int64) for i in (0, 1))
        code, at = np.unique(pairs, return_inverse=True)
        return code, np.bincount(at, seen[of], len(code)).astype(np.int64)


# --- the monoid ------------------------------------------------------------------------------------------------------


@dataclass
class Closed:
    """Closed groups: their text in order, the six counts, pairs that the head doesn't have, and whether a unit's tokens
    differ from its bytes."""

    groups: bytes = b""
    counts: np.ndarray = field(default_factory=lambda: np.zeros(6, np.int64))
    rest: Counter = field(default_factory=Counter)
    bad: bool = False

    def __add__(self, other: Closed) -> Closed:
        groups = self.groups + b";" + other.groups if self.groups and other.groups else self.groups or other.groups
        return Closed(groups, self.counts + other.counts, self.rest + other.rest, self.bad or other.bad)


def close(text: str, known: Units) -> Closed:
    """The closed groups of a text that starts and ends at cuts (or with the whole text)."""
    if not text:
        return Closed()
    found = units(text)
    known.learn(found)
    return _closed(found, known)


def _closed(found: list[str], known: Units) -> Closed:
    at = list(map(known.index.__getitem__, found))
    rest = Counter()
    if known.rest and not known.rest.keys().isdisjoint(at):
        for i in at:
            rest.update(known.rest.get(i, ()))
    groups = b";".join([g for i in at if (g := known.groups[i])]) if known.bad else b";".join(map(known.groups.__getitem__, at))
    return Closed(groups, known.counts[at].sum(axis=0), rest, not known.bad.isdisjoint(at))


@dataclass
class Fragment:
    """An open prefix; with a cut also closed groups and an open suffix, which starts at a cut."""

    prefix: str
    closed: Closed | None = None
    suffix: str = ""


def fragment(text: str, known: Units) -> Fragment:
    """The fragment of any range of a text."""
    first = _CUT.search(text)
    if first is None:
        return Fragment(text)
    last = len(text)
    while True:  # the last cut, from the end
        last = max(text.rfind(" ", 0, last), text.rfind("\n", 0, last))
        if _CUT.match(text, last):
            break
    return Fragment(text[: first.start()], close(text[first.start() : last], known), text[last:])


def compose(f: Fragment, g: Fragment, known: Units) -> Fragment:
    """The fragment of two neighbouring ranges."""
    if f.closed is not None and g.closed is not None:
        return Fragment(f.prefix, f.closed + close(f.suffix + g.prefix, known) + g.closed, g.suffix)
    if f.closed is not None:
        m = fragment(f.suffix + g.prefix, known)
        if m.closed is None:
            return Fragment(f.prefix, f.closed, m.prefix)
        return Fragment(f.prefix, f.closed + close(m.prefix, known) + m.closed, m.suffix)
    m = fragment(f.prefix + g.prefix, known)
    if g.closed is None:
        return m
    if m.closed is None:
        return Fragment(m.prefix, g.closed, g.suffix)
    return Fragment(m.prefix, m.closed + close(m.suffix, known) + g.closed, g.suffix)


def whole(f: Fragment, known: Units) -> Closed:
    """The groups of a whole text, from its fragment."""
    return close(f.prefix, known) if f.closed is None else close(f.prefix, known) + f.closed + close(f.suffix, known)


# --- Spark -----------------------------------------------------------------------------------------------------------

_COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
_REST = pa.list_(pa.struct([("pair", pa.int64()), ("n", pa.int64())]))
_CLOSED = ["groups", *_COUNTS, "rest", "bad"]
_CLOSED_SQL = "groups binary, " + ", ".join(f"{c} long" for c in _COUNTS) + ", rest array<struct<pair: bigint, n: bigint>>, bad boolean"
_RESULTS = [*_COUNTS, "rest", "groups_sha256", "groups"]
_RESULT_SQL = ", ".join(f"{c} long" for c in _COUNTS) + ", rest array<struct<pair: bigint, n: bigint>>, groups_sha256 string, groups string"


def _columns(closed: list[Closed | None]) -> list[pa.Array]:
    c = [x or Closed() for x in closed]
    counts = np.array([x.counts for x in c], np.int64).reshape(-1, 6)
    rest = [[{"pair": p, "n": n} for p, n in x.rest.items()] for x in c]
    return [pa.array([x.groups for x in c], pa.binary()), *(pa.array(counts[:, i].copy()) for i in range(6)), pa.array(rest, _REST), pa.array([x.bad for x in c])]


def _results(closed: list[Closed], keep: bool) -> list[pa.Array]:
    """Columns of whole texts; those with a unit whose tokens differ from its bytes have no tokens."""
    c = [Closed() if x.bad else x for x in closed]
    digest = [hashlib.sha256(x.groups).hexdigest() if x.groups else "" for x in c]
    return [*_columns(c)[1:8], pa.array(digest), pa.array([x.groups.decode() if keep else None for x in c], pa.string())]


def _read(row: dict) -> Fragment:
    if not row["cut"]:
        return Fragment(row["prefix"])
    rest = Counter({r["pair"]: r["n"] for r in row["rest"]})
    return Fragment(row["prefix"], Closed(row["groups"], np.array([row[c] for c in _COUNTS], np.int64), rest, row["bad"]), row["suffix"])


def pair_counts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(pair, count, best) for every linked id pair of all texts: links that hold it, and whether no pair of its B id has
    more. The pair code is a << 20 | b. Texts whose tokens differ from their bytes hold none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = Units(encoders(a_path, b_path)), np.zeros(1 << 16)

        def flush() -> pa.RecordBatch:
            code, n = known.pair_sums(seen)
            known.clear()
            seen[:] = 0
            return pa.RecordBatch.from_arrays([pa.array(code[n > 0]), pa.array(n[n > 0])], names=["pair", "n"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                texts = [" " + t for t in batch.column(0).slice(at, 256).to_pylist() if t]
                # a long text as its distinct units and how often it has them
                many = [units(t) if len(t) <= CHUNK else Counter(m.group() for m in _UNIT.finditer(t)) or [t] for t in texts]
                if known.full():
                    yield flush()
                known.learn(chain.from_iterable(many))
                if len(known.groups) > len(seen):
                    seen = np.concatenate([seen, np.zeros(len(known.groups))])
                for found in many:
                    of = np.fromiter(map(known.index.__getitem__, found), np.int64, len(found))
                    if known.bad and not known.bad.isdisjoint(of.tolist()):
                        continue
                    n = np.fromiter(found.values(), np.int64, len(found)) if isinstance(found, Counter) else 1
                    np.add.at(seen, of, n)
        yield flush()

    counted = docs.select("__text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("count"))
    counted = materialize(counted, "align-pairs").withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 20) - 1)))
    most = counted.groupBy("b").agg(F.max("count").alias("most"))
    return materialize(counted.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "align-counts")


def head(counts: DataFrame, head_max: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At most `head_max` of the most frequent pairs, sorted: all whose count reaches the lowest power of two that leaves no
    more than that. Only a histogram of at most 64 rows decides."""
    levels = counts.groupBy(F.floor(F.log2("count")).cast("int").alias("k")).agg(F.count("*").alias("n")).collect()
    left, least = head_max, 64
    for k, n in sorted(((r["k"], r["n"]) for r in levels), reverse=True):
        if n > left:
            break
        left, least = left - n, k
    found = counts.where(F.col("count") >= F.lit(2.0**least)).toArrow()
    order = np.argsort(found["pair"].to_numpy())
    return tuple(found[c].to_numpy()[order] for c in ("pair", "count", "best"))


def _reduced(rows: DataFrame, a_path: str, b_path: str, sent, chunk: int, keep: bool, ids: str) -> DataFrame:
    """The results of long texts, by tree reduction of their fragments."""
    names = ["__row", "__id", "k", "parts", "prefix", "suffix", "cut", *_CLOSED]
    schema = f"__row long, __id {ids}, k long, parts long, prefix string, suffix string, cut boolean, {_CLOSED_SQL}"

    def one(batch: pa.RecordBatch, i: int, k: int, parts: int, f: Fragment) -> pa.RecordBatch:
        cols = [batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([k], pa.int64()), pa.array([parts], pa.int64())]
        return pa.RecordBatch.from_arrays([*cols, pa.array([f.prefix]), pa.array([f.suffix]), pa.array([f.closed is not None]), *_columns([f.closed])], names=names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = " " + batch.column(2)[i].as_py()
                n = -(-len(text) // chunk)
                for k in range(n):
                    cols = [batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([k], pa.int64()), pa.array([n], pa.int64()), pa.array([text[k * chunk : (k + 1) * chunk]])]
                    yield pa.RecordBatch.from_arrays(cols, names=["__row", "__id", "k", "parts", "__text"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Units(encoders(a_path, b_path), sent.value)
        for batch in batches:
            for i in range(batch.num_rows):
                yield one(batch, i, batch.column(2)[i].as_py(), batch.column(3)[i].as_py(), fragment(batch.column(4)[i].as_py(), known))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = Units(encoders(a_path, b_path), sent.value), None
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                key = r["__row"], r["k"] // FAN, -(-r["parts"] // FAN)
                if held and held[0] == key:
                    held = (key, held[1], compose(held[2], _read(r), known))
                    continue
                if held:
                    yield one(held[1], 0, *held[0][1:], held[2])
                held = (key, batch.slice(i, 1).select(["__row", "__id"]), _read(r))
        if held:
            yield one(held[1], 0, *held[0][1:], held[2])

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Units(encoders(a_path, b_path), sent.value)
        for batch in batches:
            for i in range(batch.num_rows):
                made = whole(_read(batch.slice(i, 1).to_pylist()[0]), known)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), *_results([made], keep)], names=["__row", "__id", *_RESULTS])

    parts = rows.mapInArrow(cut, f"__row long, __id {ids}, k long, parts long, __text string")
    now = materialize(parts.repartition("__row", "k").mapInArrow(make, schema), "align-fragments")
    most = now.agg(F.max("parts")).first()[0] or 1
    while most > 1:
        dealt = now.withColumn("g", F.floor(F.col("k") / FAN)).repartition("__row", "g").sortWithinPartitions("__row", "k").drop("g")
        now = materialize(dealt.mapInArrow(reduce, schema), "align-fragments")
        most = -(-most // FAN)
    return now.mapInArrow(end, f"__row long, __id {ids}, {_RESULT_SQL}")


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = True, chunk: int = CHUNK, head_max: int = HEAD_MAX) -> DataFrame:
    """One row per input row: id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, with `keep_groups`,
    groups, the groups themselves as `a1,a2|b1;a3|b2,b3`. A encodes a space and the text, B the text, to which it adds a
    space. Groups end where tokens of both end; a link is a pair of an A and a B token that overlap in bytes, its count is
    that of its id pair in all texts, and it is best if no pair with its B id has a higher one.

    Defined cases: a null or empty text, or one whose tokens' bytes differ from its own (it has the space mark U+2581, say),
    has no tokens: zeros and an empty digest, and counts nowhere. Repeated rows each count and keep their row; a null id
    stays null; an empty table gives an empty table; other columns are ignored, whatever their names. Whole texts are
    encoded; a stretch without a cut (no space or newline in it) is one unit, however long.
    """
    docs = bounded(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")))
    spark, ids = docs.sparkSession, docs.schema[0].dataType.simpleString()
    counts = pair_counts(docs, a_path, b_path)
    sent = spark.sparkContext.broadcast(head(counts, head_max))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Units(encoders(a_path, b_path), sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [units(" " + t) if t else [] for t in part.column(2).to_pylist()]
                known.learn(chain.from_iterable(found))
                made = [_closed(f, known) if f else Closed() for f in found]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *_results(made, keep_groups)], names=["__row", "__id", *_RESULTS])

    rows = docs.select(F.monotonically_increasing_id().alias("__row"), "__id", "__text")
    is_long = F.coalesce(F.char_length("__text") >= chunk, F.lit(False))
    one = rows.where(~is_long).mapInArrow(short, f"__row long, __id {ids}, {_RESULT_SQL}")
    made = materialize(one.unionAll(_reduced(rows.where(is_long), a_path, b_path, sent, chunk, keep_groups, ids)), "align-rows")
    rest = made.select("__row", F.explode("rest").alias("r")).select("__row", "r.pair", "r.n").join(counts, "pair")
    sums = rest.groupBy("__row").agg(F.sum(F.col("n") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("n") * F.col("count")).alias("more_sum"))
    out = made.join(sums, "__row", "left").withColumns({
        "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)),
        "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0)),
    })
    return out.select(F.col("__id").alias(id_col), *_COUNTS, "groups_sha256", *(["groups"] if keep_groups else []))
