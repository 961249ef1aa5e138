"""Operators 11 to 13 against brute force and on odd rows."""

import hashlib
import heapq
import itertools
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from flowguard.llm import conversations, queries, simhash, token_alignment

from .conftest import SF, prose

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# --- 11 token alignment -----------------------------------------------------------------------------------------------


def plain_alignment(texts):
    """Whole texts through the libraries, all links listed."""
    enc, out, links = token_alignment.encoders(A, B), [], Counter()
    for t in texts:
        a, b = (enc.a.encode(" " + t, add_special_tokens=False).ids, enc.b.encode(t)) if t else ([], [])
        x, y = [enc.a_bytes[i] for i in a], [enc.b_bytes[i] for i in b]
        if not t or b"".join(x) != (" " + t).encode() or b"".join(y) != (" " + t).encode():
            out.append(None)
            continue
        ends_a, ends_b = np.cumsum([len(v) for v in x]), np.cumsum([len(v) for v in y])
        linked = [(i, j) for i in range(len(a)) for j in range(max(0, np.searchsorted(ends_b, ends_a[i] - len(x[i]), "right")), len(b)) if ends_b[j] - len(y[j]) < ends_a[i]] if len(a) < 3000 else None
        if linked is None:
            ends = np.union1d(ends_a, ends_b)
            linked = list(zip(np.searchsorted(ends_a, ends).tolist(), np.searchsorted(ends_b, ends).tolist()))
        groups, at_a, at_b = [], 0, 0
        for end in np.intersect1d(ends_a, ends_b):
            i, j = np.searchsorted(ends_a, end) + 1, np.searchsorted(ends_b, end) + 1
            groups.append(",".join(map(str, a[at_a:i])) + "|" + ",".join(map(str, b[at_b:j])))
            at_a, at_b = i, j
        pairs = [(a[i], b[j]) for i, j in linked]
        links.update(pairs)
        out.append((len(a), len(b), groups, pairs))
    most = Counter()
    for (_, b), n in links.items():
        most[b] = max(most[b], n)
    return [
        (0,) * 6 + ("",) if o is None
        else (o[0], o[1], len(o[2]), len(o[3]), sum(links[p] == most[p[1]] for p in o[3]), sum(links[p] for p in o[3]), hashlib.sha256(";".join(o[2]).encode()).hexdigest())
        for o in out
    ]


ODD_TEXTS = [
    None, "", " ", "\n", "a", " a", "a ", "a  b", "a\nb", "a\n\nb", "a \n b", "\ta b c", "日本語 テキスト x", "don't we'll 's", "a b c", "é́ x\x1cy z",
    "bad ▁ mark", "<s> </s> <unk> <|endoftext|> <0x0A>", "x" * 500, "emoji \U0001f600\U0001f469‍\U0001f4bb end", "tab\tin\rside line\r\nnext", "one two three", "one two three",
]


@pytest.mark.parametrize("chunk,head_max", [(32_768, 200_000), (40, 5)])
def test_alignment_equals_whole_texts_in_the_libraries(spark, chunk, head_max):
    texts = ODD_TEXTS + [prose(3000, 5), "a" + " b" * 200 + "  \n" * 30 + "c"]
    df = spark.createDataFrame([(i if i % 5 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_a string").withColumn("n_links", F.lit("y"))
    out = token_alignment.align(df, A, B, chunk=chunk, head_max=head_max)
    got = Counter(tuple(r) for r in out.drop("groups").collect())
    want = Counter((i if i % 5 else None, *w) for i, w in enumerate(plain_alignment(texts)))
    assert got == want
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in out.where("groups <> ''").collect())


def test_quick_ids_equal_the_tokenizer_file():
    enc = token_alignment.encoders(A, B)
    r = random.Random(3)
    letters = [chr(c) for c in (10, *range(32, 127), *range(0xA1, 0x250))] + [" "] * 60 + ["'s", "'ll", "12", "\n\n", "the"]
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(1, 40))) for _ in range(3000)]
    assert enc.quick and all(token_alignment._LATIN.fullmatch(t) for t in texts)
    assert [enc.quick.encode_ordinary(t) for t in texts] == [e.ids for e in enc.a.encode_batch(texts, add_special_tokens=False)]


def test_fragments_compose_associatively():
    r, known = random.Random(4), token_alignment.Units(token_alignment.encoders(A, B), (np.zeros(0, np.int64),) * 3)
    for text in [" " + t for t in ODD_TEXTS if t] + [" " + prose(60, 6)]:
        want = token_alignment.whole(token_alignment.fragment(text, known), known)
        for _ in range(15):
            cuts = sorted(r.sample(range(1, len(text)), min(len(text) - 1, r.randrange(6)))) if len(text) > 1 else []
            parts = [token_alignment.fragment(text[i:j], known) for i, j in zip([0, *cuts], [*cuts, len(text)])]
            while len(parts) > 1:  # in any order
                i = r.randrange(len(parts) - 1)
                parts[i : i + 2] = [token_alignment.compose(parts[i], parts[i + 1], known)]
            got = token_alignment.whole(parts[0], known)
            assert (got.groups, got.counts.tolist(), got.bad) == (want.groups, want.counts.tolist(), want.bad), (text, cuts)


def test_alignment_query_and_empty_table(spark, nothing):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op11_token_alignment"](spark, SF).collect()}
    assert [got[d.doc_id] for d in docs] == plain_alignment([d.text for d in docs])
    assert token_alignment.align(nothing, A, B).count() == 0


# --- 12 simhash -------------------------------------------------------------------------------------------------------


def plain_fingerprint(text, size=3):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall("[^\x20\x09-\x0d]+", text or "")]
    k = min(size, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps):
    f, label = np.array(fps, np.uint64), np.array(ids, np.int64)
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= 3
    while True:
        least = np.where(near, label[None, :], 1 << 60).min(axis=1)
        if (least == label).all():
            return label.tolist()
        label = least


def test_golay_keys_meet_for_all_patterns_of_three_errors():
    near = simhash.nearby()
    assert len(np.unique(simhash.codewords())) == 4096 and min(int(c).bit_count() for c in simhash.codewords()[1:]) == 7
    for bit in range(13):
        other = near[np.arange(8192) ^ (1 << bit), 0]
        assert (near == other[:, None]).any(axis=1).all()
    for errors in itertools.product(range(4), repeat=5):
        assert sum(errors) > 3 or any(errors[p] == errors[q] == 0 and errors[j] <= 1 for p, q, j in simhash.TABLES)


@pytest.mark.parametrize("block", [2048, 8])
def test_links_of_fingerprints_equal_all_pairs(spark, block):
    r = random.Random(8)
    fps = {r.getrandbits(64) for _ in range(150)} | {0, (1 << 64) - 1}
    for base in list(fps)[:60]:
        for _ in range(r.choice([1, 3, 12])):
            fps.add(base ^ sum(1 << b for b in r.sample(range(64), r.randrange(1, 5))))
    hub = r.getrandbits(64)
    fps |= {hub ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(i)}  # one key with many fingerprints
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    parts = {x.node % (1 << 64): x.component for x in simhash.connected_components(simhash.linked(df, block)).collect()}
    label = plain_components(range(len(fps)), fps)
    assert {f for f in fps if f in parts} == {f for f, n in zip(fps, label) if label.count(n) > 1}
    groups = Counter(zip([parts.get(f, f) for f in fps], label))
    assert len(groups) == len(set(label)) == len({a for a, _ in groups})


def test_simhash_groups(spark, odd, nothing):
    rows = odd.select("doc_id", "text").collect()
    got = simhash.groups(odd).collect()
    fps = [plain_fingerprint(r.text) if len(r.text or "") < 10_000 else simhash.fingerprint(r.text) for r in rows]
    assert Counter((r.doc_id, int(r.fingerprint, 16)) for r in got) == Counter(zip([r.doc_id for r in rows], fps))
    blank = {r.component_id for r in got if int(r.fingerprint, 16) == 0}
    assert blank == {2} and len({r.component_id for r in got if r.doc_id in (5, 6)}) == 1
    assert simhash.groups(nothing).count() == 0
    got = {r.doc_id: r for r in queries.QUERIES["op12_simhash"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    fps = [plain_fingerprint(d.text) for d in docs]
    assert [int(got[d.doc_id].fingerprint, 16) for d in docs] == fps
    assert [got[d.doc_id].component_id for d in docs] == plain_components([d.doc_id for d in docs], fps)
    start = time.time()
    simhash.fingerprint(prose(300_000, 2))
    assert time.time() - start < 10


# --- 13 conversation repair -------------------------------------------------------------------------------------------


def plain_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain_repair(rows):
    """Dijkstra over (row, state), the least cost and then audit first."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    turns, faults, seen = [r[0] for r in rows if r[0] is not None], [], set()
    for _, role, text in rows:
        solid = re.sub("[\x20\x09-\x0d]", "", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    first = [r[1][:1] for r in rows]
    heap, done, best = [(0, "", 0, 0, [])], set(), None
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    while heap:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in (0, 3) and (best is None or (cost, audit) < best[:2]):
            best = cost, audit, lines
        more = [(cost + 5, audit + "I", i, q, "") for q in ("user", "assistant")]
        if i < len(rows):
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, lines))
            if faults[i] not in ("blank", "duplicate"):
                extra = cost + 5 * (faults[i] == "truncated")
                more += [(extra, audit + "K", i + 1, rows[i][1], rows[i][2])] + [(extra + 1, audit + "R", i + 1, q, rows[i][2]) for q in ("user", "assistant")]
        for c, a, at, role, text in more:
            if (to := step.get((state, role[:1]))) is not None:
                heapq.heappush(heap, (c, a, at, to, [*lines, f"{role}:{text}"]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, *best[:2], hashlib.sha256("\n".join(best[2]).encode()).hexdigest())


def conversation_rows():
    r, rows = random.Random(9), []
    for conv in [None, *range(60)]:
        n = r.choice([0, 1, 2, 3, 5, 8, 40]) if conv is not None else 9
        for turn in range(n):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "unknown"])
            text = r.choice(["Yes.", "No!", "cut off", "", " \n", None, f"number {r.randrange(3)}.", "ends. \t", "x?" + str(turn) + "."])
            rows.append((conv, None if r.random() < 0.04 else turn * r.choice([1, 1, 1, 2]) + 50 * (turn > 20), role, text))
    seen, out = set(), []
    for row in rows:  # rows of one turn have no order of their own: only repeated ones share a turn here
        if (row[0], row[1]) not in seen or row in out:
            out.append(row)
        seen.add((row[0], row[1]))
    return out


@pytest.mark.parametrize("stretch", [4096, 4])
def test_repair_equals_all_paths(spark, stretch):
    rows = conversation_rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, symbol string, cost int").repartition(3)
    out = conversations.repair(conversations.damaged(df), all_ids=df, stretch=stretch)
    got = {r.conv_id: (*tuple(r)[1:9], "\n".join(r.repaired)) for r in out.collect()}
    want = {conv: plain_repair(of) for conv, of in plain_damage(rows).items()}
    assert {k: v[:8] for k, v in got.items()} == want
    assert all(hashlib.sha256(v[8].encode()).hexdigest() == v[7] for v in got.values())


def test_grammar_gives_the_matrix_of_its_symbols():
    r = random.Random(10)
    for _ in range(30):
        s = "".join(r.choice("sssuuuaaaoUAxy") for _ in range(r.randrange(60)))
        grammar = conversations.Grammar([[(ord("u"), ord("a"))], [(256, 256), (ord("x"), ord("y"))], [(257, ord("s"))]])
        plain = conversations.Grammar([]).of(s)
        found = grammar.of(s)
        assert {k: (c, str(a)) for k, (c, a) in found.items()} == {k: (c, str(a)) for k, (c, a) in plain.items()}
    start = time.time()
    cost, audit = conversations.cheapest(conversations.Grammar([[(ord("u"), ord("a"))], [(256, 256)]]).of("ua" * 20_000))
    assert cost == 0 and audit == "K" * 40_000 and time.time() - start < 20


def test_ropes_compare_like_texts():
    r = random.Random(11)
    for _ in range(300):
        x, y = ("".join(r.choice("DK") for _ in range(r.randrange(1, 12))) for _ in "ab")
        ropes = []
        for text in (x, y):
            parts = [conversations.Rope(c) for c in text]
            while len(parts) > 1:
                i = r.randrange(len(parts) - 1)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            ropes.append(parts[0])
        assert (ropes[0] < ropes[1]) == (x < y) and str(ropes[0]) == x


def test_repair_query_and_empty_table(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in queries.QUERIES["op13_conversation_repair"](spark, SF).collect()}
    assert got == {conv: plain_repair(of) for conv, of in plain_damage(rows).items()}
    assert conversations.repair(df.limit(0)).count() == 0
