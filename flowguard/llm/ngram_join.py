"""Exact n-gram Jaccard join by parity sketches, and the groups of documents that it links.

A document's set is its distinct word shingles, hashed to 64 bits. Documents with equal sets are one node. Two sets of
sizes a and b that reach the similarity differ in at most d(a, b) shingles, so:

* Segments. Within a size band every set is cut into m segments by a hash, and each segment is the XOR of its shingles'
  hashes. A shingle in only one of two sets changes one segment, so linked sets agree in m - d segments at least. A set
  of size a may therefore leave out all but d(a) + 1 of its segments, if all sets leave out by one common order: those
  that agree come in the same order on both sides, and one of them stays on both. Left out first are empty segments and
  those found often in a sample of sets; the order decides how many candidates there are, never whether a pair is found.
  Bands span a factor of 4; sets next to a bound are also cut by the segments of a band across it.
* Candidates. For each segment value the set with the fewest rare segments is the pivot, and only pairs with the pivot
  are made: as many as there are rows.
* Bit sketches. A bit string gets one flip for each shingle; the Hamming distance of two sketches never exceeds the
  difference of the sets, so pairs beyond d(a, b) are dropped. What is left is verified on the texts.
* Components of these links are found. Sets that share a segment value with others, but did not come into the component
  of its pivot, are then compared with the sets around that pivot which are in other components: sketches of both in
  blocks of bounded size, block against block, of which only pairs that may link come out and are verified likewise. So
  every linked pair was verified or lies within one component before.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowguard.llm.common import bounded, materialize
from flowguard.llm.components import connected_components

#: Sets in the sample that finds frequent segments, and how many of these are kept at most (16 bytes each are broadcast).
SAMPLE = 10_000
MOST_FREQUENT = 500_000
#: Rows of up to this number (24 bytes each) are broadcast to pick texts; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Sets to a block when those around a pivot are compared.
BLOCK = 2048
_SPAN = 4

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of whole texts: A-Z in lower case, words between ASCII white space, hashes of words kept between texts."""

    def __init__(self, size: int):
        self.size, self.known = size, {}

    def words(self, text: str) -> np.ndarray:
        known, out = self.known, []
        if len(known) > 200_000:
            known.clear()
        for w in text.encode("utf-8", "surrogatepass").lower().split():
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            out.append(h)
        return np.array(out, np.uint64)

    def __call__(self, text: str) -> np.ndarray:
        """Sorted distinct hashes of the shingles; of fewer words than a shingle has, one for the whole; none of none."""
        w = self.words(text)
        k = min(self.size, len(w))
        if not k:
            return w
        h = np.full(len(w) - k + 1, k, np.uint64)
        for i in range(k):
            h = _mix(h + w[i : len(w) - k + 1 + i])
        return np.unique(h)


def farthest(a: int, b: int, percent: int) -> int:
    """The most shingles in which sets of these sizes differ if percent * |union| <= 100 * |intersection|."""
    return (100 - percent) * (a + b) // (100 + percent)


@lru_cache(maxsize=1 << 16)
def cuts(n: int, percent: int) -> list[tuple[int, int, int]]:
    """For a set of n shingles the bands that it is cut in: (number of the band, segments, segments to keep)."""
    low, j = 1, 0
    while low * _SPAN <= n:
        low, j = low * _SPAN, j + 1
    out = []
    for number, least, most in (
        (2 * j - 1, -(-percent * low // 100), 100 * (low - 1) // percent),
        (2 * j, low, low * _SPAN - 1),
        (2 * j + 1, -(-percent * low * _SPAN // 100), 100 * (low * _SPAN - 1) // percent),
    ):
        if least <= n <= most:
            d = farthest(n, min(most, 100 * n // percent), percent)
            if d:  # else only equal sets reach the similarity
                out.append((number, 3 * (farthest(most, most, percent) + 1), d + 1))
    return out


def segments(h: np.ndarray, number: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the segments of a set and how many shingles each has; a key tells band, segment and XOR."""
    at = ((h ^ np.uint64(number * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * _M2 >> np.uint64(32)) % np.uint64(m)
    value = np.zeros(m, np.uint64)
    np.bitwise_xor.at(value, at, h)
    place = np.arange(m, dtype=np.uint64) + np.uint64(number + 1 << 40)
    return _mix(value ^ _mix(place)), np.bincount(at.astype(np.int64), minlength=m)


def sketch(h: np.ndarray) -> bytes:
    """Parity of the shingles by bit; 2 to 4 bits a shingle, a power of two, so that sketches fold onto shorter ones."""
    bits = max(64, 1 << (2 * len(h) - 1).bit_length())
    return np.packbits(np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    if len(a) > len(b):
        a, b = b, a
    x, y, bits = int.from_bytes(a, "little"), int.from_bytes(b, "little"), 8 * len(b)
    while bits > 8 * len(a):
        bits //= 2
        y = (y >> bits) ^ (y & ((1 << bits) - 1))
    return (x ^ y).bit_count()


# --- the passes over all texts --------------------------------------------------------------------------------------


def frequent_segments(docs: DataFrame, size: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys, sorted, that several sets of a sample have, with their counts."""
    n = docs.count()

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(size)
        for batch in batches:
            for text in batch.column(0):
                h = shingle(text.as_py() or "")
                for number, m, _ in cuts(len(h), percent):
                    key, count = segments(h, number, m)
                    yield pa.RecordBatch.from_arrays([pa.array(key[count > 0].view(np.int64))], names=["key"])

    some = docs.select("__text").where(F.pmod(F.xxhash64("__text"), F.lit(1_000_000)) < -(-1_000_000 * SAMPLE // max(n, 1)))
    counted = materialize(some.distinct().mapInArrow(keys, "key long").groupBy("key").count().where("count > 2"), "ngram-frequent")
    levels = sorted(((r["count"], r["n"]) for r in counted.groupBy(F.least("count", F.lit(1000)).alias("count")).agg(F.count("*").alias("n")).collect()), reverse=True)
    left, least = MOST_FREQUENT, 1001
    for count, rows in levels:
        if rows > left:
            break
        left, least = left - rows, count
    found = counted.where(F.col("count") >= least).toArrow()
    key, count = found["key"].to_numpy().view(np.uint64), found["count"].to_numpy()
    order = np.argsort(key)
    return key[order], count[order]


def sets(docs: DataFrame, size: int, percent: int, sent: Broadcast) -> DataFrame:
    """By row: __id, text_hash, node (null for an empty set), n, rank, bits, keys, and of_first, how many of these are
    those of the first band. Keys are in the common order. The rank has the segments that no one in the sample shares
    above 48 bits of the node. A task gives rank, bits and keys of a node once. ``sent`` has `frequent_segments`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, seen = Shingler(size), set()
        known, often = sent.value

        def row(text: str) -> tuple:
            h = shingle(text)
            if not len(h):
                return None, 0, None, None, None, None
            node = xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63)
            if len(seen) > 200_000:
                seen.clear()
            if node in seen:
                return node, len(h), None, None, None, None
            seen.add(node)
            kept, rare = [], 0
            for i, (number, m, keep) in enumerate(cuts(len(h), percent)):
                key, count = segments(h, number, m)
                hot = np.zeros(m, np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                    hot = np.where(known[at] == key, often[at], 0)
                hot[count == 0] = 1 << 60
                kept.append(key[np.lexsort((key, hot))[:keep]])
                rare = int((hot == 0).sum()) if i == 0 else rare
            rank = min(rare, 32767) << 48 | node & (1 << 48) - 1
            return node, len(h), rank, sketch(h), np.concatenate(kept).view(np.int64) if kept else [], len(kept[0]) if kept else 0

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                node, n, rank, bits, keys, of_first = zip(*(row(t.as_py() or "") for t in part.column(2)), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(rank, pa.int64()), pa.array(bits, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(of_first, pa.int32())],
                    names=["__id", "text_hash", "node", "n", "rank", "bits", "keys", "of_first"],
                )

    typed = docs.schema["__id"].dataType.simpleString()
    return docs.select("__id", F.xxhash64("__text").alias("text_hash"), "__text").mapInArrow(run, f"__id {typed}, text_hash long, node long, n long, rank long, bits binary, keys array<bigint>, of_first int")


# --- candidates, sketches, verification -----------------------------------------------------------------------------


def around_pivots(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct (pivot, node, place): the pivot of a segment value, another set that has the value, and the first place
    in that set's order where it has a value of this pivot."""
    keys = rows.select("rank", "of_first", F.posexplode("keys").alias("place", "key"))
    keys = keys.withColumn("place", F.when(F.col("place") < F.col("of_first"), F.col("place")).otherwise(F.col("place") - F.col("of_first")))
    pivots = keys.groupBy("key").agg(F.min("rank").alias("first"), F.max("rank").alias("last")).where("first < last").drop("last")
    pivots = materialize(pivots, "ngram-values")  # only values that several sets have: few beside all values
    found = keys.select("key", "rank", "place").join(pivots, "key").where("rank <> first").groupBy("first", "rank").agg(F.min("place").alias("place"))
    found = found.join(nodes.select("rank", "node"), "rank").join(nodes.select(F.col("rank").alias("first"), F.col("node").alias("pivot")), "first")
    return found.select("pivot", "node", "place")


def near(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) those whose sizes and sketches don't rule out a link, with the distance of the sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, x, y = (c.to_pylist() for c in batch.columns)
            d = [sketch_distance(s, t) for s, t in zip(x, y, strict=True)]
            keep = [i for i in range(len(a)) if d[i] <= farthest(na[i], nb[i], percent)]
            yield pa.RecordBatch.from_arrays([pa.array([v[i] for i in keep], pa.int64()) for v in (a, b, d)], names=["a", "b", "distance"])

    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("x"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("y"))
    joined = pairs.join(left, "a").join(right, "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    return joined.select("a", "b", "na", "nb", "x", "y").mapInArrow(run, "a long, b long, distance long")


#: Bytes of sketches in a block, if that is less than `BLOCK` sets.
BLOCK_BYTES = 16 << 20


def _blocks(members: DataFrame, name: str) -> DataFrame:
    """Rows around each pivot dealt into blocks of about BLOCK or BLOCK_BYTES: (pivot, block, blocks, name)."""
    size = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.length("bits")) / BLOCK_BYTES))
    dealt = members.join(members.groupBy("pivot").agg(size.alias("blocks")), "pivot")
    one = F.struct("node", "part", "home", "place", "n", "bits")
    return dealt.groupBy("pivot", "blocks", F.pmod(F.xxhash64("node"), "blocks").alias("block")).agg(F.collect_list(one).alias(name))


def near_around(around: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Of sets around the same pivot the pairs (a, b) in different components that sizes, places and sketches don't rule
    out. One of each pair is in another component than the pivot. Blocks meet by pivot and number of the block, so those
    around one pivot are compared in many tasks."""
    members = around.withColumn("home", F.col("part") == F.col("pivot_part")).join(nodes.select("node", "n", "bits"), "node")
    members = members.join(around.where("part <> pivot_part").select("pivot").distinct(), "pivot", "left_semi")
    ys = materialize(_blocks(members, "ys"), "ngram-blocks")
    xs = _blocks(members.where("not home"), "xs").select("pivot", "xs").join(ys.select("pivot", "blocks").distinct(), "pivot")
    xs = xs.select("pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "xs")
    pairs = xs.join(ys.select("pivot", "block", "ys"), ["pivot", "block"]).select("xs", "ys")

    def columns(block: pa.Array) -> tuple[dict[str, np.ndarray], dict[int, tuple[np.ndarray, np.ndarray]]]:
        """The columns of a block, and by length of the sketches: their rows, and the sketches as words."""
        of = {f.name: block.field(f.name).to_numpy(zero_copy_only=False) for f in block.type}
        lengths = np.array([len(x) for x in of["bits"]])
        return of, {int(k): (np.flatnonzero(lengths == k), np.frombuffer(b"".join(of["bits"][lengths == k]), np.uint64).reshape(-1, k // 8)) for k in np.unique(lengths)}

    def fold(words: np.ndarray, length: int) -> np.ndarray:
        while words.shape[1] * 8 > length:
            half = words.shape[1] // 2
            words = words[:, :half] ^ words[:, half:]
        return words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (x, x_bits), (y, y_bits) = (columns(batch.column(c)[i].values) for c in (0, 1))
                a, b = [], []
                for x_len, (x_at, x_words) in x_bits.items():
                    for y_len, (y_at, y_words) in y_bits.items():
                        if max(x_len, y_len) > 2 * min(x_len, y_len) and percent >= 50:
                            continue  # sizes too far apart
                        x_fold, y_fold = fold(x_words, min(x_len, y_len)), fold(y_words, min(x_len, y_len))
                        for k, words in zip(x_at, x_fold, strict=True):
                            sums = (100 - percent) * (x["n"][k] + y["n"][y_at])
                            able = (y["part"][y_at] != x["part"][k]) & (y["home"][y_at] | (y["node"][y_at] > x["node"][k]))
                            able &= np.maximum(x["place"][k], y["place"][y_at]) * (100 + percent) <= sums
                            able &= 100 * np.minimum(x["n"][k], y["n"][y_at]) >= percent * np.maximum(x["n"][k], y["n"][y_at])
                            rows = np.flatnonzero(able)
                            close = np.bitwise_count(y_fold[rows] ^ words).sum(axis=1, dtype=np.int64) * (100 + percent) <= sums[rows]
                            b.append(y["node"][y_at[rows[close]]])
                            a.append(np.full(len(b[-1]), x["node"][k]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *v])) for v in (a, b)], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long").select(*_ordered("a", "b")).distinct()


def verified(pairs: DataFrame, rows: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose texts' sets reach the similarity."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    whose = materialize(rows.join(wanted, "node").groupBy("node").agg(F.min(F.struct("text_hash", "__id")).alias("r")).select("node", "r.*"), "ngram-texts")
    picked = F.broadcast(whose) if whose.count() <= BROADCAST_ROWS else whose
    hashed = docs.select("__id", F.xxhash64("__text").alias("text_hash"), "__text").alias("d")
    texts = hashed.join(picked.alias("w"), (F.col("d.text_hash") == F.col("w.text_hash")) & F.col("d.__id").eqNullSafe(F.col("w.__id"))).select("node", "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, kept = Shingler(size), {}

        def of(node: int, text: str) -> np.ndarray:
            if node not in kept:
                if len(kept) > 64:
                    kept.clear()
                kept[node] = shingle(text)
            return kept[node]

        for batch in batches:
            linked = []
            for i in range(batch.num_rows):
                x, y = (of(batch.column(c)[i].as_py(), batch.column(c + 2)[i].as_py()) for c in (0, 1))
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    linked.append(i)
            yield batch.select(["a", "b"]).take(pa.array(linked, pa.int64()))

    pairs = pairs.select("a", "b").join(texts.select(F.col("node").alias("a"), F.col("__text").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("__text").alias("y")), "b")
    return pairs.select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()


def _with_part(pairs: DataFrame, parts: DataFrame, node: str, name: str) -> DataFrame:
    of = parts.select(F.col("node").alias(node), F.col("component").alias("__c"))
    return pairs.join(of, node, "left").withColumn(name, F.coalesce("__c", F.col(node))).drop("__c")


def _ordered(a: Column | str, b: Column | str) -> tuple[Column, Column]:
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def node_components(rows: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, component) for every node that is linked to another."""
    nodes = materialize(rows.where("size(keys) > 0").select("node", "rank", "n", "bits").dropDuplicates(["node"]), "ngram-nodes")
    groups = materialize(around_pivots(rows, nodes), "ngram-pivots")
    close = materialize(near(groups.select(F.col("pivot").alias("a"), F.col("node").alias("b")), nodes, percent), "ngram-close")
    # first the pivot that each set is closest to
    first = close.groupBy("b").agg(F.min(F.struct("distance", "a")).alias("m")).select(*_ordered("m.a", "b")).distinct()
    links = materialize(verified(first, rows, docs, size, percent), "ngram-links")
    parts = connected_components(links)
    # then what is still in another component: other pivots, and the sets around a pivot among themselves
    around = materialize(_with_part(_with_part(groups, parts, "pivot", "pivot_part"), parts, "node", "part"), "ngram-parts")
    again = _with_part(_with_part(close.select("a", "b"), parts, "a", "a_part"), parts, "b", "b_part").where("a_part <> b_part").select(*_ordered("a", "b"))
    second = near_around(around, nodes, percent).unionAll(again).distinct().join(first, ["a", "b"], "left_anti")
    second = materialize(second, "ngram-second")
    more = materialize(verified(second, rows, docs, size, percent), "ngram-links")
    return parts if more.isEmpty() else connected_components(links.unionAll(more))


def _placed(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """By row of (__id, __text): __id, text_hash, n and part, the component of its set (null for an empty set)."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent_segments(bounded(docs), size, percent))
    rows = materialize(sets(docs, size, percent, sent), "ngram-sets")
    sent.destroy()
    return _with_part(rows.select("__id", "text_hash", "node", "n"), node_components(rows, docs, size, percent), "node", "part").drop("node")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: id_col, n_shingles (size of its set) and component_id (the smallest id reachable by links,
    its own included). Sets link when 100 * |intersection| >= percent * |union|.

    Defined cases: a null or empty text, or one of white space, has an empty set and links with nothing; with fewer
    words than a shingle the whole sequence is one; repeated rows and equal texts share a component; a component whose
    ids are all null has a null component_id; an empty table gives an empty table; other columns are ignored. Whole
    texts are compared.
    """
    placed = _placed(docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text")), size, percent)
    # written, so that a component of many rows is split where it is joined
    least = materialize(placed.where("part is not null").groupBy("part").agg(F.min("__id").alias("__least")), "ngram-least")
    component = F.when(F.col("part").isNull(), F.col("__id")).otherwise(F.col("__least"))
    return placed.join(least, "part", "left").select(F.col("__id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` without near duplicates: of each component the row of the smallest id (null ids last), and of
    rows alike in id and text one. Rows without a word all stay. Columns are as they are."""
    names = docs.columns
    rows = docs.select(*[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(names)])
    rows = rows.withColumns({"__id": F.col(f"__{names.index(id_col)}"), "__text": F.coalesce(F.col(f"__{names.index(text_col)}"), F.lit(""))})
    alike = _placed(rows.select("__id", "__text"), size, percent).where("part is not null").groupBy("part", "__id", "text_hash").agg(F.count("*").alias("n"))
    first = alike.groupBy("part").agg(F.min(F.struct(F.col("__id").isNull().alias("no_id"), "__id", "text_hash", "n")).alias("r")).select("r.__id", "r.text_hash", "r.n")
    first = materialize(first, "ngram-first")
    picked = (F.broadcast(first) if first.count() <= BROADCAST_ROWS else first).alias("p")
    wordy = rows.where(F.col("__text").rlike(r"[^\x20\x09-\x0D]")).withColumn("text_hash", F.xxhash64("__text")).alias("d")
    kept = wordy.join(picked, (F.col("d.text_hash") == F.col("p.text_hash")) & F.col("d.__id").eqNullSafe(F.col("p.__id"))).select("d.*", "p.n")
    columns = [F.col(f"__{i}").alias(c) for i, c in enumerate(names)]
    out = rows.where(~F.col("__text").rlike(r"[^\x20\x09-\x0D]")).select(*columns).unionAll(kept.where("n = 1").select(*columns))
    return out.unionAll(kept.where("n > 1").dropDuplicates(["__id", "text_hash"]).select(*columns))
