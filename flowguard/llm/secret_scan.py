"""Secret scans by a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams that any match must contain. Texts are
taken in blocks; a block's index holds a posting (a bit set over its texts) for every trigram that some query names.
Intersecting and uniting postings leaves each rule's candidates, and only these are searched with the regular
expression. A rule without mandatory trigrams has the query `None` and searches every text. The index of a block lives
in the task that reads the block, so nothing is shuffled and a lost task is simply run again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as sre  # the parse tree of the standard library's own expressions
from re import _parser as sre_parser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowguard.llm.common import bounded

#: Texts to a block of the index.
BLOCK = 512
#: Literal alternatives followed before a query gives up on being exact.
_MOST = 32


@dataclass(frozen=True)
class Rule:
    """`pattern` finds leftmost non-overlapping matches; one whose `group` is shorter than `least` is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE = (
    Rule("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # Runs of 24 or more are the matches of [0-9a-f]+ that have 24 or more characters: both take whole runs.
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: What parts the lines of a key: white space, also written as an escape, and marks of quotes and lists around it. Taken
#: whole (atomic), as all repeats below are, so that a text is read in linear time whatever it repeats.
_BREAK = r"""(?>(?:\s|\\[nrt]|[>"',+])+)"""
#: The same with a line break in it: only behind one a header starts, as its value may hold anything else.
_LINE = r"""(?>(?:[^\S\r\n]|\\t|[>"',+])*(?:[\r\n]|\\[nr])(?:\s|\\[nrt]|[>"',+])*)"""
#: A key without its END line: header lines, then base64 lines, then what a last shorter line and a checksum hold.
_CUT_KEY = (
    rf"(?:(?>(?:{_LINE}(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset|MessageID): [^\r\n\\]*+)*+)(?:{_BREAK}[A-Za-z0-9+/]{{16,}}+={{0,2}}+)++"
    rf"(?:{_BREAK}=?[A-Za-z0-9+/]++={{0,2}}+(?=\s*(?:[\r\n\\\"']|\Z))){{0,2}})?"
)
MORE = (
    # From BEGIN to the END line of the same name, or to the end of the base64 lines if that is missing.
    Rule("private_key", r"-----BEGIN ([A-Z0-9 ]*)PRIVATE KEY((?: BLOCK)?)-----(?:(?:(?!-----BEGIN )[\s\S])*?-----END \1PRIVATE KEY\2-----|" + _CUT_KEY + ")"),
    Rule("forge_token", r"gh[opsru]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pay_key", r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("web_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]+"),
    Rule("url_login", r"://[^\s:/@]*:[^\s:/@]{3,}@"),
)
RULES = BASE + MORE


# --- from a regular expression to a Boolean query over lower-cased trigrams -------------------------------------
# A query is a trigram, ("and" | "or", parts) or None (anything may match).


def _all(parts: list) -> object:
    parts = list(dict.fromkeys(p for p in parts if p is not None))
    return None if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts: list) -> object:
    parts = list(dict.fromkeys(parts))
    flat = {p: trigrams(p) for p in parts if isinstance(p, str) or p is not None and all(isinstance(x, str) for x in p[1]) and p[0] == "and"}
    parts = [p for p in parts if p not in flat or not any(x < flat[p] for x in flat.values())]  # a and b, or a: a
    return None if None in parts or not parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings: set[str]) -> object:
    return _any([_all([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _node(op, arg) -> tuple[set[str] | None, object]:
    """The strings that the node matches, if they are few, and its query."""
    if op is sre.LITERAL:
        return ({chr(arg).lower()}, None) if arg < 128 else (None, None)
    if op is sre.IN:
        chars = {chr(a).lower() for o, a in arg if o is sre.LITERAL and a < 128}
        return (chars, None) if len(arg) <= 8 and all(o is sre.LITERAL and a < 128 for o, a in arg) else (None, None)
    if op is sre.SUBPATTERN:
        return _sequence(arg[-1])
    if op is sre.BRANCH:
        found = [_sequence(x) for x in arg[1]]
        if all(e is not None for e, _ in found) and sum(len(e) for e, _ in found) <= _MOST:
            return set().union(*(e for e, _ in found)), None
        return None, _any([_of_strings(e) if e is not None else q for e, q in found])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        least, most, inner = arg
        exact, q = _sequence(inner)
        if exact is not None and (least, most) == (0, 1):
            return exact | {""}, None
        if exact is not None and least == most and len(exact) == 1 and least <= _MOST:
            return {next(iter(exact)) * least}, None
        return None, (None if least == 0 else _of_strings(exact) if exact is not None else q)
    if op is sre.AT:
        return {""}, None
    return None, None


def _sequence(items) -> tuple[set[str] | None, object]:
    run, parts, exact = {""}, [], True
    for op, arg in items:
        e, q = _node(op, arg)
        if e is not None and len(run) * len(e) <= _MOST:
            run = {a + b for a in run for b in e}
            continue
        parts += [_of_strings(run), q]
        run, exact = (e if e is not None else {""}), False
    return (run, None) if exact else (None, _all([*parts, _of_strings(run)]))


def trigram_query(pattern: str) -> object:
    exact, q = _sequence(sre_parser.parse(pattern))
    return _of_strings(exact) if exact is not None else q


def trigrams(q: object) -> set[str]:
    return set() if q is None else {q} if isinstance(q, str) else set().union(*(trigrams(p) for p in q[1]))


# --- the index of a block ----------------------------------------------------------------------------------------


class BlockIndex:
    """Postings of the given trigrams over a block of texts; a posting has bit i for text i."""

    def __init__(self, texts: Sequence[str], wanted: set[str]):
        self.all, self.postings = (1 << len(texts)) - 1, dict.fromkeys(wanted, 0)
        for i, text in enumerate(texts):
            low, bit = text.lower(), 1 << i
            for t in wanted:
                if t in low:
                    self.postings[t] |= bit

    def candidates(self, q: object) -> int:
        if q is None:
            return self.all
        if isinstance(q, str):
            return self.postings[q]
        parts = [self.candidates(p) for p in q[1]]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if q[0] == "and" else out | p
        return out


@lru_cache(maxsize=8)
def _compiled(rules: tuple[Rule, ...]) -> tuple[list, set[str]]:
    queries = [trigram_query(r.pattern) for r in rules]
    return [(r, re.compile(r.pattern), q) for r, q in zip(rules, queries, strict=True)], set().union(*map(trigrams, queries))


def find_spans(texts: Sequence[str], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, int]]]:
    """For each text of a block its spans (start, number of the rule, end), in order. Code points, end exclusive."""
    compiled, wanted = _compiled(rules)
    index = BlockIndex(texts, wanted)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, (rule, pattern, q) in enumerate(compiled):
        left = index.candidates(q)
        while left:
            i = (left & -left).bit_length() - 1
            left &= left - 1
            for m in pattern.finditer(texts[i]):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    found[i].append((m.start(), k, m.end()))
    for spans in found:
        spans.sort()
    return found


def mask(text: str, spans: list[tuple[int, int, int]], by: str = "[SECRET]") -> str:
    """`text` with each stretch that spans cover, overlapping ones as one, replaced by `by`."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], by]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part, [t or "" for t in part.column(part.num_columns - 1).to_pylist()]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: id_col and found array<struct<kind, start, end, value>>, by start, then order of rules.

    Defined cases: a null or empty text has no spans; null ids stay null; repeated rows each keep their row; an empty
    table gives an empty table; columns besides the two are ignored, whatever their names. Whole texts are searched.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _blocks(batches):
            rows = [[{"kind": rules[k].kind, "start": a, "end": b, "value": t[a:b]} for a, k, b in spans] for t, spans in zip(texts, find_spans(texts, rules), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, kind)], names=[id_col, "found"])

    typed = docs.schema[id_col].dataType.simpleString()
    return bounded(docs).select(id_col, F.col(text_col).alias("__text")).mapInArrow(run, f"`{id_col}` {typed}, found array<struct<kind: string, start: bigint, `end`: bigint, value: string>>")


def redact(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, by: str = "[SECRET]") -> DataFrame:
    """`docs` with every found span of `text_col` replaced by `by`; all rows and columns stay, null texts stay null."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _blocks(batches):
            at, given = names.index(text_col), part.column(part.num_columns - 1)
            new = [mask(t, spans, by) if was.is_valid else None for t, spans, was in zip(texts, find_spans(texts, rules), given, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if i == at else part.column(i) for i in range(len(names))], names=names)

    return bounded(docs).select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text_col}`").alias("__text")).mapInArrow(run, docs.schema)


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the digest of their spans and all spans as text, from the rows of `scan`."""
    shown = F.transform("found", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))
    base = [r.kind for r in BASE]
    of_base = F.filter(F.col("shown"), lambda x: F.split(x, ":")[0].isin(base))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.withColumn("shown", shown).select(id_col, *map(count, base), F.sha2(F.concat_ws(",", of_base), 256).alias("base_sha256"), F.concat_ws(",", "shown").alias("spans"))
