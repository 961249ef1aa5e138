"""Token counts without ids: pieces are counted once per distinct pre-token.

A byte-fallback BPE model whose pieces never span a boundary between character classes encodes each pre-token
independently of its neighbours. So a text's token count is the sum, over its distinct pre-tokens, of frequency times
pieces. The vocabulary of pre-tokens is built over all documents with partial counts, each entry is encoded once, and
per-document frequencies are joined to it:

* the most frequent entries (at most `head_max`, each at most `HEAD_CHARS` long: the bound of the broadcast) are joined
  by a broadcast table in the pass that makes the frequencies, so they are never shuffled;
* every other (row, pre-token, frequency) is joined by a shuffle on the pre-token. By the choice of the head no key
  there is frequent, except pre-tokens longer than `HEAD_CHARS`, which a skew join splits.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowguard.llm.common import bounded, materialize

HEAD_MAX = 100_000
HEAD_CHARS = 48
_FLUSH = 200_000
#: Spaces (as the model's space mark) glue to what follows; Latin letters and everything else are apart.
_FINE = "▁*[A-Za-zÀ-ɏ]+|▁*[^A-Za-zÀ-ɏ▁]+|▁+"
_COARSE = "▁*[^▁]+|▁+"


@lru_cache(maxsize=4)
def _model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=4)
def pretokenizer(path: str) -> re.Pattern:
    """The finest of the two splits that cuts no piece of the model (cuts depend on two neighbouring characters, so
    this check proves that no merge crosses a cut); an error if neither holds."""
    m = _model(path)
    pieces = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))]
    for pattern in (_FINE, _COARSE):
        p = re.compile(pattern)
        if all(len(p.findall(x)) == 1 for x in pieces) and m.encode("\n \n", out_type=str)[1:] == ["<0x0A>", "▁", "<0x0A>"]:
            return p
    raise ValueError(f"pieces of {path} span words; pre-tokens can't be counted apart")


def frequencies(text: str, pattern: re.Pattern) -> Counter:
    """Pre-tokens of a whole text. The model puts one space mark before any text that isn't empty."""
    return Counter(pattern.findall("▁" + text.replace(" ", "▁"))) if text else Counter()


def piece_counts(pretokens: list[str], path: str) -> list[int]:
    """Pieces of each pre-token. A newline is always a piece of its own, so it shields a pre-token from the space mark
    that the model puts first: the mark and the newline are 2 pieces."""
    return [len(x) - 2 for x in _model(path).encode(["\n" + p for p in pretokens], num_threads=1)]


def vocabulary(docs: DataFrame, path: str, text_col: str) -> DataFrame:
    """(piece_key, df, n_pieces) for every distinct pre-token of all texts; df counts the texts that have it."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, seen = pretokenizer(path), Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["pretoken", "df"])
            seen.clear()
            return out

        for batch in batches:
            for value in batch.column(0):
                if text := value.as_py():
                    seen.update(set(pattern.findall("▁" + text.replace(" ", "▁"))))
                    if len(seen) > _FLUSH:
                        yield flush()
        yield flush()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = piece_counts(batch.column(0).to_pylist(), path)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["pretoken", "df", "n_pieces"])

    counted = docs.select(F.col(text_col)).mapInArrow(partial, "pretoken string, df long").groupBy("pretoken").agg(F.sum("df").alias("df"))
    return counted.mapInArrow(encode, "pretoken string, df long, n_pieces long")


def head(vocab: DataFrame, head_max: int) -> dict[str, int]:
    """At most `head_max` of the most frequent entries: all whose document frequency reaches the lowest power of two
    that leaves no more than that. Only a histogram of at most 64 rows decides."""
    short = vocab.where(F.length("pretoken") <= HEAD_CHARS)
    levels = short.groupBy(F.floor(F.log2("df")).cast("int").alias("k")).count().collect()
    left, least = head_max, None
    for k, n in sorted(((r["k"], r["count"]) for r in levels), reverse=True):
        if n > left:
            break
        left, least = left - n, k
    if least is None:
        return {}
    return {r["pretoken"]: r["n_pieces"] for r in short.where(F.col("df") >= 2**least).select("pretoken", "n_pieces").collect()}


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, head_max: int = HEAD_MAX) -> DataFrame:
    """One row per input row: id_col, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > `limit`).

    The count is that of the sentencepiece model at `model_path` over the whole text, without begin or end marks.
    Defined cases: a null or empty text has 0 bytes and 0 tokens; a null id stays null; repeated rows and ids each
    keep their own row; an empty table gives an empty table; other columns are ignored, whatever their names.
    """
    docs = bounded(docs).select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    spark = docs.sparkSession
    vocab = materialize(vocabulary(docs, model_path, "__text"), "token-vocab")
    known = spark.sparkContext.broadcast(head(vocab, head_max))

    def per_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, table = pretokenizer(model_path), known.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n_bytes, n_head, rest = [], [], []
                for text in part.column(1).to_pylist():
                    text, total, tail = text or "", 0, []
                    for p, n in frequencies(text, pattern).items():
                        pieces = table.get(p)
                        if pieces is None:
                            tail.append((p, n))
                        else:
                            total += pieces * n
                    n_bytes.append(len(text.encode()))
                    n_head.append(total)
                    rest.append(tail)
                tails = pa.array([[{"pretoken": p, "n": n} for p, n in x] for x in rest], pa.list_(pa.struct([("pretoken", pa.string()), ("n", pa.int64())])))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_head, pa.int64()), tails], names=["__id", "n_bytes", "n_head", "tail"])

    id_type = docs.schema["__id"].dataType.simpleString()
    rows = docs.mapInArrow(per_row, f"__id {id_type}, n_bytes long, n_head long, tail array<struct<pretoken: string, n: bigint>>")
    rows = materialize(rows.withColumn("__row", F.monotonically_increasing_id()), "token-rows")
    tail = rows.select("__row", F.explode("tail").alias("t")).select("__row", "t.pretoken", "t.n")
    sums = tail.join(vocab.select("pretoken", "n_pieces"), "pretoken").groupBy("__row").agg(F.sum(F.col("n") * F.col("n_pieces")).alias("n_tail"))
    n_tokens = F.col("n_head") + F.coalesce("n_tail", F.lit(0))
    return rows.drop("tail").join(sums, "__row", "left").select(F.col("__id").alias(id_col), "n_bytes", n_tokens.cast("long").alias("n_tokens"), (n_tokens > limit).alias("over_limit"))
