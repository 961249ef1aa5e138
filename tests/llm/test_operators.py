"""Each operator against a brute-force version, and on odd rows, repeated rows and empty tables."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowguard.llm import components, decontamination, html_text, language_id, mixing, ngram_join, quality_rules, queries, secret_scan, token_counts, toxicity, url_filter

from .conftest import SF, prose

WORD = re.compile("[^\x20\x09-\x0d]+")


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def documents():
    return pd.read_parquet(f"{SF}/documents.parquet")


# --- 1 token counts -------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def piece_model():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("head_max", [0, 50, 100_000])
def test_token_counts_are_the_models_own(spark, odd, piece_model, head_max):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=piece_model)
    given = odd.select("doc_id", "text").collect()
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()), n := len(m.encode(r["text"] or "")), n > 4096) for r in given), key=repr)
    assert rows_of(token_counts.count_tokens(odd, piece_model, head_max=head_max), "doc_id", "n_bytes", "n_tokens", "over_limit") == want


def test_token_counts_of_special_strings_and_noise(spark, piece_model):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=piece_model)
    r = random.Random(5)
    texts = ["<s>", "</s> <unk>", "<0x0A>", "  a  b ", "\n", " ", "▁", "a▁b", "², ². x²", "\r\n\t", "don't", "ﬁ １２", "\x00a", "naïve 漢字かな交じり"]
    texts += ["".join(r.choice("ab é\n▁ .,1²漢\U0001f600\u200d") for _ in range(r.randrange(40))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(df, piece_model, head_max=20).collect()}
    assert got == {i: len(m.encode(t)) for i, t in enumerate(texts)}


def test_token_counts_query_and_empty_table(spark, nothing, piece_model):
    assert token_counts.count_tokens(nothing, piece_model).count() == 0
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=piece_model)
    got = {r["doc_id"]: r["n_tokens"] for r in queries.QUERIES["op1_token_counts"](spark, SF).collect()}
    d = documents()
    assert got == {i: len(m.encode(t)) for i, t in zip(d.doc_id, d.text, strict=True)}


# --- 2 secret scan --------------------------------------------------------------------------------------------------

ASSIGN = re.compile("(" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_key", "apikey")) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(t):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(found)


def check_secrets(rows):
    for r in rows:
        spans = base_spans(r["text"] or "")
        shown = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        assert r["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest(), r["text"]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[1] == i for s in spans) for i in range(3)]
        assert set(filter(None, shown.split(","))) <= set(r["spans"].split(","))


def secret_texts():
    r = random.Random(7)
    parts = ["secret", "Token", "pass", "word", "passwd", "API", "_", "key", "=", ":", " ", "'", '"', "abc", "abcdef12", "AKIA", "IOSF0DNN7EXAMPLE", "0123456789abcdef", "deadbeef", "\n", "é", "\u017f", "ſecret", "ghp_" + "a" * 36, "xoxb-1234567890", "\u212aey"]
    return ["".join(r.choice(parts) for _ in range(r.randrange(30))) for _ in range(1500)]


def test_secret_spans_equal_the_plain_search(spark, odd):
    df = spark.createDataFrame(list(enumerate(secret_texts())), "doc_id long, text string")
    check_secrets(secret_scan.digest(secret_scan.scan(df)).join(df, "doc_id").collect())
    got = secret_scan.digest(secret_scan.scan(odd))
    assert rows_of(got, "doc_id") == rows_of(odd, "doc_id")
    assert got.where("base_sha256 <> sha2('', 256)").count() == 0


def test_secret_index_loses_no_match():
    texts = secret_texts()
    fast = secret_scan.find_spans(texts)
    for t, spans in zip(texts, fast, strict=True):
        plain = sorted((m.start(), k, m.end()) for k, rule in enumerate(secret_scan.RULES) for m in re.finditer(rule.pattern, t) if m.end(rule.group) - m.start(rule.group) >= rule.least)
        assert spans == plain
    kinds = {secret_scan.RULES[k].kind for spans in fast for _, k, _ in spans}
    assert {"assign", "access", "hex", "forge_token", "chat_token"} <= kinds


def test_trigram_queries():
    assert secret_scan.trigram_query("AKIA[A-Z0-9]+") == ("and", ("aki", "kia"))
    assert secret_scan.trigram_query("[0-9a-f]{24,}") is None
    assert secret_scan.trigram_query("(?:abc|xyz)+") == ("or", ("abc", "xyz"))
    assert secret_scan.trigram_query("ab?cd") == ("or", (("and", ("abc", "bcd")), "acd"))
    assert secret_scan.trigram_query("abc*") is None
    assert secret_scan.trigram_query("foo.*bar") == ("and", ("foo", "bar"))


def test_secret_masks(spark, odd, nothing):
    got = secret_scan.redact(spark.createDataFrame([(1, "a token=abcdef12 b", 5), (2, None, 6)], "doc_id long, text string, spans long")).collect()
    assert [tuple(r) for r in got] == [(1, "a [SECRET] b", 5), (2, None, 6)]
    assert secret_scan.mask("0123456789", [(1, 0, 4), (2, 1, 3), (3, 2, 6)], "x") == "0x6789"
    assert secret_scan.redact(odd).columns == odd.columns and rows_of(secret_scan.redact(odd), *odd.columns) == rows_of(odd, *odd.columns)
    assert secret_scan.scan(nothing).count() == 0 and secret_scan.redact(nothing).count() == 0


def test_whole_keys_and_long_logins_are_masked(spark):
    body = "\n".join("MIIEow" + c * 58 for c in "abcdef") + "\nQmFz=="
    masked = {}
    for name in ("RSA PRIVATE KEY", "PRIVATE KEY", "OPENSSH PRIVATE KEY", "ENCRYPTED PRIVATE KEY", "PGP PRIVATE KEY BLOCK"):
        for b in (body, body.replace("\n", "\r\n"), body.replace("\n", "\\n"), "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00FF\n\n" + body, "Version: X 2\n\n" + body + "\n=aB3d"):
            line = "\\n" if "\\n" in b else "\n"
            masked["a " + f"-----BEGIN {name}-----{line}{b}{line}-----END {name}-----" + " b"] = "a [SECRET] b"
            masked["a " + f"-----BEGIN {name}-----{line}{b}\nthe text goes on"] = "a [SECRET]\nthe text goes on"
    cut = "-----BEGIN RSA PRIVATE KEY-----\n" + body[:200]
    masked[cut + "\n-----BEGIN PRIVATE KEY-----\n" + body + "\n-----END PRIVATE KEY-----"] = "[SECRET]\n[SECRET]"
    masked["the line -----BEGIN RSA PRIVATE KEY----- begins a key"] = "the line [SECRET] begins a key"
    masked["-----BEGIN RSA PRIVATE KEY-----\nNote: plain\nwords\n"] = "[SECRET]\nNote: plain\nwords\n"
    masked["redis" + "://:password@host"] = "redis[SECRET]host"
    masked["x://" + "u" * 90 + ":" + "p" * 200 + "@host"] = "x[SECRET]host"
    df = spark.createDataFrame(list(enumerate(masked)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in secret_scan.redact(df).collect()}
    assert [got[i] for i in range(len(masked))] == list(masked.values())
    assert secret_scan.find_spans(["-----BEGIN RSA PRIVATE KEY----- " * 20_000])[0]  # no END: still in linear time


def test_every_rule_reads_repeats_in_linear_time():
    begin = "-----BEGIN PRIVATE KEY-----"
    repeats = [begin + x * 10_000 + "!" for x in (" Comment: x", "\nComment: x", "\\nComment: x", "+>", "\n", "\nABCDEFGHIJKLMNOPQRST", "PRIVATE KEY", "=")]
    repeats += [x * 20_000 for x in (begin, "-----BEGIN ", "eyJ", "eyJ.", "eyJaaaaaaaa.", "://", "://a:", "token ", "password\"", "ghp_", "xoxa-", "AKIA", "sk_live_", "AIza")] + ["password" + " " * 100_000]
    for rule in secret_scan.RULES:
        for text in repeats:
            start = time.time()
            for _ in re.finditer(rule.pattern, text):
                pass
            assert time.time() - start < 1, (rule.kind, text[:40])


def test_secret_query(spark):
    check_secrets(queries.QUERIES["op2_secret_scan"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").collect())


# --- 3 quality rules ------------------------------------------------------------------------------------------------


def plain_counts(t):
    words = WORD.findall(t)
    wins = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(wins) if wins.count(w) > 1 for j in range(i, i + 3)} if len(wins) < 3000 else None
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), sum(x in lines[:i] for i, x in enumerate(lines)), None if covered is None else len(covered)


def test_quality_counts():
    r = random.Random(3)
    for _ in range(400):
        t = "".join(r.choice(["a", "b", " ", "\n", "a b", "#", "a b c ", "\u00a0", "É ", "\x1f"]) for _ in range(r.randrange(60)))
        assert quality_rules.counts(t)[:5] == plain_counts(t), repr(t)


def test_quality_verdicts(spark, odd, nothing):
    got = quality_rules.judge(odd)
    assert rows_of(got, "doc_id") == rows_of(odd, "doc_id")
    for r in got.collect():
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"]) and 0 <= r["p_good"] <= 1
    assert quality_rules.judge(nothing).count() == 0 and quality_rules.keep_good(nothing).count() == 0
    kept = quality_rules.keep_good(odd)
    assert kept.columns == odd.columns and rows_of(kept, "doc_id") == rows_of(got.where("kept"), "doc_id")


def test_quality_query_finds_the_labelled_junk(spark):
    got = queries.QUERIES["op3_quality_rules"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("not base_failed").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.99 and got[got.quality == 0].kept.mean() < 0.05


def test_expectation_maximisation_finds_planted_accuracies():
    r = np.random.default_rng(0)
    right, seen = [0.95, 0.9, 0.8, 0.7], Counter()
    for _ in range(40_000):
        y = int(r.random() < 0.6)
        seen[tuple(None if r.random() < 0.2 else int(y if r.random() < p else 1 - y) for p in right)] += 1
    m = quality_rules.expectation_maximisation(sorted(seen.items(), key=str), 4, rounds=2000)
    assert abs(m.good - 0.6) < 0.03
    assert all(abs(a - p) < 0.03 and abs(1 - b - p) < 0.03 for a, b, p in zip(m.on_good, m.on_bad, right, strict=True))


# --- 4 n-gram join --------------------------------------------------------------------------------------------------


def plain_sets(texts, k):
    out = []
    for t in texts:
        w = [x.decode() for x in (t or "").encode().lower().split()]
        assert len(w) == len(WORD.findall(t or ""))
        n = min(k, len(w))
        out.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset())
    return out


def plain_components(ids, texts, k, percent):
    found = plain_sets(texts, k)
    by_set = defaultdict(list)
    for i, s in enumerate(found):
        by_set[s].append(i)
    nodes = [s for s in by_set if s]
    parent = {s: s for s in nodes}

    def root(s):
        while parent[s] is not s:
            s = parent[s]
        return s

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            both = len(a & b)
            if 100 * both >= percent * (len(a) + len(b) - both):
                parent[root(a)] = root(b)
    least = {}
    for s in nodes:
        known = [ids[i] for i in by_set[s] if ids[i] is not None]
        least[root(s)] = min([x for x in [least.get(root(s)), *known] if x is not None], default=None)
    return sorted(((ids[i], len(s), least[root(s)] if s else ids[i]) for i, s in enumerate(found)), key=repr)


def near_copies(seed, n_bases, copies):
    r, out = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(400)]
    common = [r.choice(vocabulary) for _ in range(30)]
    for b in range(n_bases):
        base = [r.choice(vocabulary) for _ in range(r.choice([3, 8, 15, 16, 40, 63, 64, 70, 250, 260]))]
        if b % 3 == 0:
            base += common
        for _ in range(copies):
            w = list(base)
            for _ in range(r.randrange(1 + max(1, len(base) // 20))):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            if r.random() < 0.2:
                w = w[r.randrange(3) :] + [r.choice(vocabulary)]
            out.append(" ".join(w) if r.random() < 0.8 else " ".join(w).upper())
    return out


@pytest.mark.parametrize(("k", "percent", "sample", "block"), [(4, 85, 10_000, 2048), (5, 80, 10_000, 2), (2, 60, 10_000, 2048), (4, 85, 1, 2)])
def test_ngram_groups_equal_all_pairs(spark, monkeypatch, k, percent, sample, block):
    monkeypatch.setattr(ngram_join, "SAMPLE", sample)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    texts = near_copies(k, 30, 14) + [None, "", " ", "a", "A", "a b", "b a"]
    ids = [None if i % 97 == 5 else (i * 7919) % 1000 for i in range(len(texts))]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(5)
    assert rows_of(ngram_join.groups(df, size=k, percent=percent), "doc_id", "n_shingles", "component_id") == plain_components(ids, texts, k, percent)


def test_ngram_one_large_group_of_near_copies(spark):
    r = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(400):
        w = list(base)
        for _ in range(r.randrange(6)):
            w[r.randrange(len(w))] = f"x{r.randrange(10_000)}"
        texts.append(" ".join(w))
    ids = list(range(len(texts)))
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    assert rows_of(ngram_join.groups(df, size=4, percent=85), "doc_id", "n_shingles", "component_id") == plain_components(ids, texts, 4, 85)


def test_ngram_odd_rows_and_keep_one(spark, odd, nothing):
    given = odd.select("doc_id", "text").collect()
    want = plain_components([r["doc_id"] for r in given], [r["text"] for r in given], 5, 80)
    got = ngram_join.groups(odd)
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == want
    assert ngram_join.groups(nothing).count() == 0 and ngram_join.keep_one(nothing).count() == 0
    kept = ngram_join.keep_one(odd)
    assert kept.columns == odd.columns
    wordy = [r for r in kept.collect() if WORD.search(r["text"] or "")]
    assert kept.count() - len(wordy) == sum(not WORD.search(r["text"] or "") for r in given)
    # the two long texts are one group, so are the two of two words, and the repeated row
    assert sorted((r["doc_id"], len(r["text"])) for r in wordy if r["doc_id"] in (1, 5, 6, 7, 8)) == sorted([(1, len(prose(80, 2))), (1, len(prose(90, 4))), (5, len(prose(120_000, 1))), (7, 7)])


def test_sketches_bound_the_difference():
    r = np.random.default_rng(1)
    for n in (5, 60, 1000):
        for other in (0, n // 10, n):
            both, x, y = (np.unique(r.integers(0, 1 << 63, k).astype(np.uint64)) for k in (n, other, other * 2))
            a, b = np.union1d(both, x), np.union1d(both, y)
            assert ngram_join.sketch_distance(ngram_join.sketch(a), ngram_join.sketch(b)) <= len(np.setxor1d(a, b))


def test_cuts_cover_all_linked_sizes():
    for percent in (80, 85):
        for a in range(1, 400):
            for b in range(a, 100 * a // percent + 1):
                shared = {x[:2] for x in ngram_join.cuts(a, percent)} & {x[:2] for x in ngram_join.cuts(b, percent)}
                if ngram_join.farthest(a, b, percent):
                    assert shared
                for number, m in shared:
                    keep = [x[2] for n in (a, b) for x in ngram_join.cuts(n, percent) if x[0] == number]
                    assert min(keep) > ngram_join.farthest(a, b, percent) and max(keep) <= m


def test_components_of_paths_stars_and_loops(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1400)] + [(5, 5), (None, 3), (7000, None), (3, 4)]
    edges += [(r.randrange(2000, 2600), r.randrange(2000, 2600)) for _ in range(350)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = rows_of(components.connected_components(spark.createDataFrame(edges, "a long, b long")), "node", "component")
    assert got == sorted(((x, root(x)) for x in parent), key=repr)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 5 decontamination ----------------------------------------------------------------------------------------------


def plain_leaks(ids, texts, items):
    """Every passage against every item, with no index."""
    known = [(i, decontamination.words(t or "")) for i, t in items if i is not None]
    known = [(i, w) for i, w in known if len(w) >= decontamination.LEAST_WORDS]
    having = Counter(x for _, w in known for x in set(w))
    n, mean, longest = len(known), np.mean([len(w) for _, w in known]), max(len(w) for _, w in known)
    step, out = max(64, longest), []
    for i, t in zip(ids, texts, strict=True):
        w = decontamination.words(t or "")
        for j, item in known:
            weight = {x: np.log(1 + (n - having[x] + 0.5) / (having[x] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(item) / mean)) for x, c in Counter(item).items()}
            q, a = (decontamination.ngrams(x) for x in decontamination.split_item(item))
            for at in range(0, max(1, len(w)), step):
                passage = w[at : at + 2 * step]
                grams = decontamination.ngrams(passage)
                if sum(x for y, x in weight.items() if y in set(passage)) / sum(weight.values()) >= 0.5 - 1e-9 and len(q & grams) >= 0.6 * len(q) and len(a & grams) >= 0.6 * len(a):
                    out.append((i, j))
                    break
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def leaky(spark):
    r = random.Random(4)
    items = [(i, prose(r.randrange(6, 90), 100 + i) + "." + (f" answer{i} number{i}" if i % 2 else "")) for i in range(60)] + [(60, None), (61, "too short"), (None, prose(30, 7)), (62, prose(20, 100)), (63, prose(20, 100))]
    texts = []
    for i in range(150):
        t = prose(r.randrange(0, 700), 500 + i).split(" ")
        if i % 3 == 0:
            item = items[r.randrange(60)][1].split(" ")
            for _ in range(r.randrange(0, 1 + len(item) // 8)):
                item[r.randrange(len(item))] = "changed"
            at = r.randrange(len(t) + 1)
            t[at:at] = item[: len(item) if i % 2 else len(item) // 2]
        texts.append(" ".join(t).upper() if i % 5 == 0 else " ".join(t))
    ids = [i // 2 for i in range(len(texts))]
    return ids, texts, items, spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("most", [50_000, 20])
def test_leaks_equal_all_pairs(spark, monkeypatch, leaky, most):
    ids, texts, items, docs, bench = leaky
    monkeypatch.setattr(decontamination.indexes, "__defaults__", ("item_id", "text", most))
    got = rows_of(decontamination.find_leaks(docs, bench), "doc_id", "item_id")
    assert got == plain_leaks(ids, texts, items) and len(got) >= 15


def test_block_max_wand_finds_all_above_any_threshold(leaky):
    _, texts, items, _, _ = leaky
    known = [(i, *decontamination.split_item(decontamination.words(t))) for i, t in items if t and len(t) > 20 and i is not None]
    having = Counter(x for _, q, a in known for x in set(q + a))
    index = decontamination.Index(known, len(known), 40.0, having)
    for t in texts:
        terms = sorted({index.vocabulary[x] for x in decontamination.words(t)[:128] if x in index.vocabulary})
        score = Counter()
        for x in terms:
            for k, v in zip(*index.posts[x], strict=True):
                score[k] += v
        for threshold in (0.05, 0.2, 0.5):
            assert sorted(k for k, _ in index.search(terms, threshold)) == sorted(k for k, v in score.items() if v >= threshold - 1e-9)


def test_leaks_of_odd_rows(spark, odd, nothing, leaky):
    bench = leaky[4]
    assert decontamination.find_leaks(odd, bench).count() == 0
    assert rows_of(decontamination.keep_clean(odd, bench), "doc_id", "text") == rows_of(odd, "doc_id", "text")
    assert decontamination.find_leaks(nothing, bench).count() == 0
    none = bench.limit(0)
    assert decontamination.find_leaks(odd, none).columns == ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]
    assert decontamination.find_leaks(odd, none).count() == 0 and decontamination.keep_clean(odd, none).count() == odd.count()


def test_truncated_and_edited_copies_of_one_text_leak(spark):
    item = " ".join(f"word{i}" for i in range(40))
    short = " ".join(f"term{i}" for i in range(15))
    bench = spark.createDataFrame([(1, item), (2, short)], "item_id long, text string")
    texts = [prose(50, 1) + " " + " ".join(item.split()[:28]) + " " + prose(50, 2), prose(20, 3) + " " + short.replace("term13", "changed"), prose(20, 4) + " " + " ".join(item.split()[:15])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert rows_of(decontamination.find_leaks(docs, bench, one_text=True), "doc_id", "item_id") == [(0, 1), (1, 2)]
    assert rows_of(decontamination.keep_clean(docs, bench, one_text=True), "doc_id") == [(2,)]
    assert decontamination.find_leaks(docs, bench).count() == 0  # items with an answer of their own


@pytest.mark.parametrize("most", [50_000, 1])
def test_short_items_and_unspaced_scripts_leak(spark, monkeypatch, most):
    monkeypatch.setattr(decontamination.indexes, "__defaults__", ("item_id", "text", most))
    items = [(1, "Quokka zebu, ibex!"), (2, "five odd words quite alone"), (3, "日本語の文章を漏らした"), (4, "—"), (5, None)]
    texts = ["see quokka ZEBU ibex here", "quokka ibex zebu", prose(90, 1) + " five odd words quite alone " + prose(9, 2), "ここに日本語の文章を漏らしたものがある", "日本", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for some in (items, items[:1]):
        bench = spark.createDataFrame(some, "item_id long, text string")
        want = [x for x in [(0, 1), (2, 2), (3, 3)] if x[1] <= len(some)]
        assert rows_of(decontamination.find_leaks(docs, bench), "doc_id", "item_id") == want
        assert rows_of(decontamination.keep_clean(docs, bench), "doc_id") == [(i,) for i in range(7) if i not in {d for d, _ in want}]


def test_leak_query_finds_verbatim_items(spark):
    sf = "/root/testdata/sf0.01"
    d, b = pd.read_parquet(f"{sf}/documents.parquet"), pd.read_parquet(f"{sf}/benchmark.parquet")
    want = {(i, j) for i, t in zip(d.doc_id, d.text, strict=True) for j, x in zip(b.item_id, b.text, strict=True) if x in t}
    got = {(r["doc_id"], r["item_id"]) for r in queries.QUERIES["op5_decontamination"](spark, sf).collect()}
    assert want <= got and len(got - want) <= 2


# --- 6 html ---------------------------------------------------------------------------------------------------------


def test_html_query_gives_the_articles(spark):
    import html

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.QUERIES["op6_html_text"](spark, SF).collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", pages[r["page_id"]], re.S)[1]
        lines = (" ".join(html.unescape(x).split()) for x in re.sub(r"<[^>]*>", "\n", re.sub(r"</?b>", "", inner)).split("\n"))
        assert r["text"] == "\n".join(x for x in lines if x) and r["n_chars"] == len(r["text"])


@pytest.fixture(scope="module")
def tree(spark):
    return html_text.fit(spark)


@pytest.mark.parametrize(("page", "text"), [
    ("", ""),
    ("no markup but a sentence that goes on for a while, as sentences do.", "no markup but a sentence that goes on for a while, as sentences do."),
    ("<article><p>a &lt; b &amp; c&nbsp;d &copy &#233;</p>\n<p>x\n  y\tz</p></article>", "a < b & c d © é\nx y z"),
    ("<article><p>one<!-- <p>two</p> --> three</p><script>if (a < b) '<p>four</p>'</script><style>p{}</style><p>five</article>", "one three\nfive"),
    ("<nav><a href=1>menu</a></nav><article><h1>T</h1><p>short</p><aside>beside</aside><div class='ad'>buy</div><form>mail</form><p>end</p></article><div class=comments><p>Reader says so.</p></div><footer>foot</footer>", "T\nshort\nend"),
    ("<article><p title='a > b'>in</p><p>2 < 3 and 4 > 1</p><p>cut <a href=\"", "in\n2 < 3 and 4 > 1\ncut"),
    ("<ARTICLE><P>Upper<BR>case</P></ARTICLE><!-- never ended <p>x", "Upper\ncase"),
])
def test_html_cases(tree, page, text):
    assert html_text.main_text(page, tree) == text


def test_html_labelled_pages_and_odd_rows(spark, tree, odd, nothing):
    for page, labels in html_text.LABELLED:
        blocks = html_text.read_blocks(page)
        assert sum(html_text.is_main(tree, x) == (y == "+") for x, y in zip(html_text.describe(blocks), labels, strict=True)) >= len(labels) - 2
    df = spark.createDataFrame([(1, "u", None, "x"), (None, None, "", "y"), (2, "u", "<article><p>" + "w " * 100_000 + "</p></article>", None), (2, "u", "<article><p>b</p></article>", None), (2, "u", "<article><p>b</p></article>", None)], "page_id long, url string, html string, text string")
    assert rows_of(html_text.extract(df, tree), "page_id", "url", "n_chars") == sorted([(1, "u", 0), (None, None, 0), (2, "u", 199_999), (2, "u", 1), (2, "u", 1)], key=repr)
    assert html_text.extract(df.limit(0), tree).count() == 0


# --- 7 url filter ---------------------------------------------------------------------------------------------------


def test_url_rules(spark):
    cases = [
        (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("example.com/en/", "", "", None, "allow"),
        ("http://A.Example.COM/en/x?y#z", "a.example.com", "/en/x", "example.com/en/", "block"), ("http://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("http://x.www.example.com/en/1", "x.www.example.com", "/en/1", "www.example.com/en/", "allow"), ("http://badexample.com/en/", "badexample.com", "/en/", "com/", "allow"),
        ("https://com", "com", "", None, "allow"), ("https://a.net/es/", "a.net", "/es/", "net/es/", "block"), ("https://a.net/ES/", "a.net", "/ES/", None, "allow"),
        ("x://É.net/fr/?q", "É.net", "/fr/", "net/fr/", "block"), ("a://b://c/d", "b:", "//c/d", None, "allow"), ("http://h.org#f/x", "h.org", "", None, "allow"),
    ]
    df = spark.createDataFrame([(i, c[0], None, "x") for i, c in enumerate(cases)], "page_id long, url string, html string, host string")
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge(df).collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases)}


def test_url_aliases(spark):
    canon = '<html><link rel="canonical" href="{}"></html>'
    pages = [
        (1, "http://a.org/1", canon.format("http://b.org/1")),  # aliases of a blocked page, by two steps
        (2, "http://b.org/1", '<meta http-equiv=refresh content="0; url=http://c.net/es/1">'),
        (3, "https://b.org/1#top", None),
        (4, "http://d.com/1", canon.format("http://c.net/es/1")),  # an explicit allow stays
        (5, "http://e.org/1", canon.format("/2")),
        (6, "http://e.org/2", "<link href=http://e.org/2 rel=canonical>"),
        (7, "http://f.org/dir/1", canon.format("2")),
        (8, "http://f.org/dir/2", canon.format("//c.net/fr/")),
        (8, "http://f.org/dir/2", canon.format("//c.net/fr/")),
        (9, "http://g.org/", None),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(df).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "block", 8: "block", 9: "allow"}
    more = spark.createDataFrame([("http://g.org", "http://a.org/1")], "url string, target string")
    assert url_filter.judge(df, edges=more).where("page_id = 9").first()["verdict"] == "block"
    assert url_filter.judge(df.limit(0)).count() == 0


def test_url_targets_with_written_out_ampersands(spark):
    blocked = "http://c.net/es/p?a=1&b=2"
    pages = [(9, blocked, None)] + [(i, f"http://h{i}.org/", f'<link rel=canonical href="{blocked.replace("&", amp)}">') for i, amp in enumerate(("&", "&amp;", "&AMP;", "&#38;", "&#x26;", "&#038;"))]
    pages += [(10, "http://i.org/p?a=1&b=2", '<meta http-equiv=refresh content="0; url=http://h1.org/">'), (11, "http://j.org/", "<link rel=canonical href='http://i.org/p?a=1&amp;b=2'>"), (12, "http://k.org/", "<link rel=canonical href='/p?x&amp;amp;y'>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(df).collect()}
    assert got == {**dict.fromkeys([*range(6), 9, 10, 11], "block"), 12: "allow"}
    targets = {r["url"]: r["target"] for r in url_filter.link_edges(df).collect()}
    assert targets["http://h1.org/"] == blocked and targets["http://k.org/"] == "http://k.org/p?x&amp;y"


# --- 8 toxicity -----------------------------------------------------------------------------------------------------


def test_disguises_are_undone():
    counts = np.zeros(language_id.BUCKETS, np.int64)
    words = ["idiot", "moron", "pathetic", "worthless", "clown", "trash", "stupid", "the", "and", "house", "river"] * 50
    for g in language_id.trigrams([" ".join(words)])[0]:
        counts[g] += 1
    restorer = toxicity.Restorer(toxicity.CharacterModel(counts))
    for hidden, word in {"1d10t": "idiot", "i d i o t": "idiot", "m.o.r.o.n": "moron", "p@th3t1c": "pathetic", "w0rthl3ss": "worthless", "clooooown": "clown", "tr@sh!!": "trash", "st*u*p*i*d": "stupid", "IDIOOOT": "idiot", "c|own": "clown"}.items():
        assert word in restorer.words(f"the {hidden} and"), hidden
    assert restorer.words("The house, and the river. 12 a1") >= {"the", "house", "and", "river"}
    assert restorer.words("") == set()
    assert "idiot" in restorer.words("a " * 300_000 + "1d10t " + "0a" * 300_000)


def test_disguises_at_the_end_of_words_and_sentences():
    counts = np.zeros(language_id.BUCKETS, np.int64)
    words = ["idiot", "moron", "scum", "ass", "trash", "stupid", "clown", "the", "and", "you", "are", "house", "river"] * 50
    for g in language_id.trigrams([" ".join(words)])[0]:
        counts[g] += 1
    restorer = toxicity.Restorer(toxicity.CharacterModel(counts))
    hidden = {"s c u m": "scum", "i d i o t": "idiot", "t r a s h": "trash", "s  c  u  m": "scum", "i\td\ti\to\tt": "idiot", "t\nr\na\ns\nh": "trash", "m.o.r.o.n": "moron", "m/o/r/o/n": "moron",
              "st*u*p*i*d": "stupid", "1d10t": "idiot", "idio7": "idiot", "idio+": "idiot", "a$$": "ass", "tr@sh": "trash", "clooooown": "clown", "i d i o 7": "idiot"}
    for text, word in hidden.items():
        for end in ("", ".", "!", "!!!", "?", ",", ")", '"', "...", " and", "\n"):
            for start in ("", "you are ", '"', "("):
                assert word in restorer.words(start + text + end), (start, text, end)
    assert restorer.words("the house! and the river!!") == {"the", "house", "and", "river"}


def test_toxicity_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.QUERIES["op8_toxicity"](spark, sf).toPandas()
    labels, docs = pd.read_parquet(f"{sf}/labels.parquet"), pd.read_parquet(f"{sf}/documents.parquet")
    m = got[got.held_out].merge(labels, on="doc_id")
    assert len(got) == len(docs) and got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    assert m[m.toxic == 0].predicted.mean() < 0.01 and m[m.toxic == 1].predicted.mean() > 0.8


def test_toxicity_odd_rows(spark, odd, nothing):
    texts = [(i, prose(30, i) + (" idiot" if i % 4 == 0 else "")) for i in range(200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(150)] + [(None, 1), (3, None), (999, 1)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    held = toxicity.score(docs.where("doc_id >= 150"), model).toPandas()
    assert (held.predicted == (held.doc_id % 4 == 0)).all()
    hidden = spark.createDataFrame([(1, "the 1d1ot and i d i o t"), (2, "the house")], "doc_id long, text string")
    assert rows_of(toxicity.score(hidden, model), "doc_id", "predicted") == [(1, 1), (2, 0)]
    got = toxicity.score(odd, model)
    assert rows_of(got, "doc_id") == rows_of(odd, "doc_id") and got.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score(nothing, model).count() == 0
    empty = toxicity.learn(nothing, labels.limit(0))
    assert toxicity.score(odd, empty).where("score between 0 and 1").count() == odd.count()


# --- 9 language -----------------------------------------------------------------------------------------------------


def test_language_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op9_language_id"](spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/documents.parquet"), on="doc_id")
    assert len(got) == 1000 and (got[got.held_out].lang == got[got.held_out].lang_pred).mean() > 0.98


def test_mixtures_are_found(spark):
    d = documents()
    model = language_id.learn(spark.createDataFrame(d[["doc_id", "text", "lang"]]))
    pure = {x: max((t for t, y in zip(d.text, d.lang, strict=True) if y == x), key=len) for x in ("en", "de", "fr")}
    half = " ".join(pure["en"].split()[:300]) + "\n" + " ".join(pure["de"].split()[:300])
    found = language_id.infer([pure["en"], half, "", "123 !", " ".join(pure["fr"].split()[:200])], model, 6.0)
    assert list(found[0]) == ["en"] or found[0]["en"] > 0.95
    assert set(found[1]) >= {"en", "de"} and abs(found[1]["en"] - 0.5) < 0.15
    assert found[2] == found[3] == {} and next(iter(found[4])) == "fr"


def test_language_odd_rows(spark, odd, nothing):
    model = language_id.learn(odd)
    assert model.languages == ("de", "en", "ja")
    got = language_id.predict(odd, model)
    assert rows_of(got, "doc_id") == rows_of(odd, "doc_id")
    assert {r["lang_pred"] for r in got.where("doc_id in (2, 3, 4)").collect()} == {"und"}
    assert got.where("score is null or score < 0 or score > 1").count() == 0
    none = language_id.learn(nothing)
    assert {r["lang_pred"] for r in language_id.predict(odd, none).collect()} == {"und"} and language_id.predict(nothing, model).count() == 0


def test_blocks_give_the_same_as_single_texts(spark):
    d = documents()
    model = language_id.learn(spark.createDataFrame(d[["doc_id", "text", "lang"]]))
    texts = [*d.text[:40], "", "a\nb"]
    together = language_id.infer(texts, model, 6.0)
    for t, x in zip(texts, together, strict=True):
        one = language_id.infer([t], model, 6.0)[0]
        assert list(one) == list(x) and all(abs(one[k] - x[k]) < 1e-4 for k in x)


# --- 10 mixing ------------------------------------------------------------------------------------------------------


def water_level(sizes, weights=(5, 2, 1)):
    """Targets by resharing what is above the caps until nothing is."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = sum(sizes.values()), set(names), {}
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not full:
            return out | share
        out |= {s: 3.0 * sizes[s] for s in full}
        left -= sum(3 * sizes[s] for s in full)
        open_ -= full
    return out


def check_mix(rows):
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] is not None
    want = water_level(sizes)
    for r in rows:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
    for s, t in want.items():
        alike = max(Counter((r["doc_id"], r["size"]) for r in rows if r["source"] == s).values())
        assert abs(taken[s] - t) <= alike + 1e-6, s


def test_mix_meets_targets(spark, odd, nothing):
    r = random.Random(8)
    rows = [(i, "w " * int(r.paretovariate(1.1) * 3), r.choice(["a", "a", "a", "a", "b", "é", "Z", None, "tiny" if i % 50 == 0 else "a"])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check_mix(mixing.mix(df).collect())
    check_mix(mixing.mix(odd).collect())
    assert rows_of(mixing.mix(odd), "doc_id", "taken") == rows_of(mixing.mix(odd.repartition(7)), "doc_id", "taken")
    assert mixing.mix(nothing).count() == 0 and mixing.mixed(nothing).count() == 0
    assert mixing.mix(odd.where("text is null")).agg(F.sum("taken")).first()[0] == 0


@pytest.mark.parametrize("range_rows", [20_000, 10])
def test_mix_takes_in_hash_order(spark, monkeypatch, range_rows):
    monkeypatch.setattr(mixing, "RANGE_ROWS", range_rows)
    rows = [(i, "w " * (1 + i % 17), f"s{i % 4}" if i % 9 else "big") for i in range(2000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    got["key"] = got.doc_id.map(lambda i: hashlib.md5(f"mix:{i}".encode()).hexdigest())
    for _, g in got.groupby("source"):
        g = g.sort_values("key")
        full = int(g.target.iloc[0] // g.source_size.iloc[0])
        left = g.target.iloc[0] - full * g.source_size.iloc[0]
        before = g["size"].cumsum() - g["size"]
        part = np.clip(np.floor(left - before), 0, g["size"])
        assert (g.taken == full * g["size"] + part).all()


def test_mixed_rows_agree_with_the_plan(spark, odd):
    plan = mixing.mix(odd).groupBy("source").agg(F.sum("taken").alias("taken")).where("taken > 0")
    out = mixing.mixed(odd)
    assert out.columns == [c for c in odd.columns if c != "mix_epoch"] + ["mix_epoch", "mix_words"]
    assert rows_of(out.groupBy("source").agg(F.sum("mix_words").alias("taken")), "source", "taken") == rows_of(plan, "source", "taken")
