"""SimHash near duplicates by Golay-code fuzzy hashing.

A text's fingerprint has a bit set where more than half of its shingles' hashes have it. Texts link when fingerprints
differ in at most three bits. Copies share a fingerprint, so everything after the text pass works on distinct ones.

* Pigeonhole. A fingerprint is cut into five segments. Three errors leave at least two segments exact and at most one with
  more than one error. For each of the ten pairs of segments that may be exact, the segment between them (the midpoint in
  the circle of five) is taken as well: two pairs have the same midpoint only if they are disjoint, so some pair of exact
  segments always has a midpoint with at most one error.
* Golay keys. The midpoint, padded to 23 bits, is decoded to the codeword of the binary Golay code that is nearest: the
  code is perfect, so there is one within three bits. A word that lies three bits off also gets the codewords four bits
  off (at most five). Of two words that differ in one bit, each has the other's nearest codeword among its keys.
* Join and verify. The exact segments with each codeword index make the keys, about fifty for a fingerprint. Fingerprints
  that share a key are compared if it is the nearest of either. What comes out of a key is a spanning forest of its links,
  not its pairs. Keys of more than `BLOCK` fingerprints are cut into blocks, and blocks are compared with blocks in tasks of
  their own.
* Connected components of the forests' edges are those of all links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowguard.llm.common import bounded, materialize
from flowguard.llm.components import connected_components

DISTANCE = 3
#: Lowest bit and width of the segments.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Two exact segments and the midpoint between them.
TABLES = [(p, q, (p + q) * 3 % 5) for p in range(5) for q in range(p + 1, 5)]
#: Fingerprints of one key that one task compares at once.
BLOCK = 2048
_GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
_SEED = 42


@lru_cache(maxsize=1)
def codewords() -> np.ndarray:
    """The 4,096 codewords of the binary Golay code of length 23: all multiples of its generator, by index."""
    out = np.zeros(1, np.uint32)
    for i in range(12):
        out = np.concatenate([out, out ^ np.uint32(_GENERATOR << i)])
    return out


@lru_cache(maxsize=1)
def nearby() -> np.ndarray:
    """For each word of a segment (13 bits, the other ten zero) the indices of nearby codewords: the nearest first, then
    those at distance four that a change of one bit of the segment makes the nearest; -1 fills up."""
    words, code = np.arange(1 << 13, dtype=np.uint32), codewords()
    out = np.full((len(words), 6), -1, np.int64)
    for at in range(0, len(words), 512):
        differ = words[at : at + 512, None] ^ code[None, :]
        distance = np.bitwise_count(differ)
        out[at : at + 512, 0] = nearest = distance.argmin(axis=1)
        edge = (np.take_along_axis(distance, nearest[:, None], 1) == 3) & (distance == 4) & (differ & 0x1FFF != 0)
        for i, row in enumerate(edge):
            found = np.flatnonzero(row)
            out[at + i, 1 : 1 + len(found)] = found
    return out


def fingerprint(text: str, size: int = 3) -> int:
    """A bit is set if more than half of the hashes (XXH64, seed 42) of the text's shingles have it; A-Z in lower case,
    words between ASCII white space, fewer words than a shingle has as one sequence; without words 0."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, k = b" ".join(words), min(size, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    count, n, digest = np.zeros(64, np.int64), len(words) - k + 1, xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 14):  # slices bound the memory of very long texts
        spans = zip(starts[at : min(n, at + (1 << 14))].tolist(), ends[at + k - 1 : at + k - 1 + (1 << 14)].tolist(), strict=True)
        h = np.array([digest(joined[s:e], _SEED) for s, e in spans], "<u8")
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > n, bitorder="little").tobytes(), "little")


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For fingerprints (unsigned): keys, the place of the fingerprint that has each, and whether the key is its nearest."""
    part = [(fps >> np.uint64(low)).astype(np.int64) & ((1 << width) - 1) for low, width in SEGMENTS]
    key, at, own = [], [], []
    for t, (p, q, j) in enumerate(TABLES):
        base = t << 38 | part[p] << 25 | part[q] << 12
        index = nearby()[part[j]]
        for c in range(index.shape[1]):
            rows = np.flatnonzero(index[:, c] >= 0)
            key.append(base[rows] | index[rows, c])
            at.append(rows)
            own.append(np.full(len(rows), c == 0))
    return np.concatenate(key), np.concatenate(at), np.concatenate(own)


def forest(fps: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links among fingerprints of one key: each to the first of its tree."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= DISTANCE
    near &= own[:, None] | own[None, :]
    label = np.arange(len(fps))
    while True:
        least = np.minimum(label, np.where(near, label[None, :], len(fps)).min(axis=1))
        least = least[least]
        if (least == label).all():
            break
        label = least
    rows = np.flatnonzero(label != np.arange(len(fps)))
    return fps[label[rows]], fps[rows]


def _links(fps: np.ndarray, key: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forest edges of all keys; rows of a key are next to each other."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(starts, len(key)))
    a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for shift in range(1, 4):  # keys of a few fingerprints: their at most six pairs at once
        x = np.repeat(starts[(sizes <= 4) & (sizes > shift)], sizes[(sizes <= 4) & (sizes > shift)] - shift)
        if len(x):
            x = x + np.concatenate([np.arange(n - shift) for n in sizes[(sizes <= 4) & (sizes > shift)]])
            y = x + shift
            ok = (np.bitwise_count(fps[x] ^ fps[y]) <= DISTANCE) & (own[x] | own[y])
            a.append(fps[x[ok]])
            b.append(fps[y[ok]])
    for s, n in zip(starts[sizes > 4], sizes[sizes > 4], strict=True):
        u, v = forest(fps[s : s + n], own[s : s + n])
        a.append(u)
        b.append(v)
    return np.concatenate(a), np.concatenate(b)


def _edges(rows: DataFrame, group: str, most: int | None) -> DataFrame:
    """(a, b, big) of rows (group, fp, own): forest edges of each group. A group of more than `most` rows is not compared
    but named in big."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool))
        named = None

        def out(a: np.ndarray, b: np.ndarray, big: list[int]) -> pa.RecordBatch:
            pad = [None] * len(big)
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays([pa.array(v.view(np.int64)), pa.array(pad, pa.int64())]) for v in (a, b)] + [pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(big, pa.int64())])],
                names=["a", "b", "big"],
            )

        for batch in batches:
            key = batch.column(0).to_numpy()
            fps, own = batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)
            if named is not None:  # the rest of a group that was named
                key, fps, own = key[key != named], fps[key != named], own[key != named]
            key, fps, own = (np.concatenate([x, y]) for x, y in zip(left, (key, fps, own), strict=True))
            if not len(key):
                continue
            open_at = np.searchsorted(key, key[-1])
            big = []
            if most is not None:  # groups that ended within this batch may be too big as well
                group_key, sizes = np.unique(key[:open_at], return_counts=True)
                big = group_key[sizes > most].tolist()
            whole = ~np.isin(key[:open_at], big)
            a, b = _links(fps[:open_at][whole], key[:open_at][whole], own[:open_at][whole])
            left = key[open_at:], fps[open_at:], own[open_at:]
            if most is not None and len(left[0]) > most:
                named = int(key[-1])
                big.append(named)
                left = tuple(x[:0] for x in left)
            yield out(a, b, big)
        if len(left[0]):
            yield out(*_links(left[1], left[0], left[2]), [])

    return rows.select(group, "fp", "own").mapInArrow(run, "a long, b long, big long")


def expanded(fps: DataFrame) -> DataFrame:
    """(key, fp, own) of distinct fingerprints (fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            key, at, own = golay_keys(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[at]), pa.array(own)], names=["key", "fp", "own"])

    return fps.select("fp").mapInArrow(run, "key long, fp long, own boolean")


def linked(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) whose components are those of all links between the distinct fingerprints in column fp."""
    keyed = expanded(fps)
    dealt = keyed.repartition("key").sortWithinPartitions("key")
    found = materialize(_edges(dealt, "key", block), "simhash-edges")
    edges = found.where("big is null").select("a", "b")
    big = materialize(found.where("big is not null").select(F.col("big").alias("key")).distinct(), "simhash-big")
    if big.isEmpty():
        return edges.distinct()
    # blocks of the fingerprints of a big key, each block next to each other one
    rows = materialize(keyed.join(big, "key"), "simhash-members")
    counts = rows.groupBy("key").agg(F.ceil(F.count("*") / (block // 2)).alias("blocks"))
    rows = rows.join(counts, "key").withColumn("mine", F.pmod(F.xxhash64("fp"), "blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("cell", F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")))
    cells = _edges(rows.repartition("cell").sortWithinPartitions("cell"), "cell", None)
    return edges.unionAll(cells.select("a", "b")).distinct()


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(__id, fp) by row of (__id, __text); fp as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py() or "", size) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["__id", "fp"])

    return docs.select("__id", "__text").mapInArrow(run, f"__id {docs.schema['__id'].dataType.simpleString()}, fp long")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """One row per input row: id_col, fingerprint (16 hex digits) and component_id, the smallest id reachable by links of at
    most three differing bits, its own included.

    Defined cases: a null or empty text, or one of white space, has fingerprint zero and links like any other; with fewer
    words than a shingle the whole sequence is one; repeated rows and equal texts share a component; a component whose ids
    are all null has a null component_id; an empty table gives an empty table; other columns are ignored, whatever their
    names. Whole texts count, their shingles with repeats.
    """
    docs = bounded(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")))
    rows = materialize(fingerprints(docs, size), "simhash-rows")
    fps = materialize(rows.groupBy("fp").agg(F.min("__id").alias("least")), "simhash-fps")
    parts = connected_components(linked(fps)).withColumnRenamed("node", "fp")
    placed = fps.join(parts, "fp", "left").withColumn("part", F.coalesce("component", "fp"))
    least = placed.groupBy("part").agg(F.min("least").alias("component_id"))
    # one row per fingerprint, written, so that a fingerprint of very many rows is split where it is joined
    of = materialize(placed.select("fp", "part").join(least, "part").select("fp", "component_id"), "simhash-least")
    return rows.join(of, "fp").select(F.col("__id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
