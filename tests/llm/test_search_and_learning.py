"""Secrets, ranked search and whitening: against brute force, and on nulls, empty, long and repeated rows."""

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from straitline.llm import lexical, secret_scan, whitening

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD_ROWS = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "word", None, "s", 4), (3, "x" * 200_000, "en", "s", 200_000)]


def documents(spark, rows=ODD_ROWS):
    """Documents with more columns, some named like what operators add."""
    return spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as score", "'a' as spans", "2 as rank", "3 as id")


# --- whitening ----------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, n long, component string, id int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 7, "x", 8) for i, v in rows], VECTORS)


def whitened_by_eigh(rows, wanted=32):
    """Rows of one length by exact centring and a library's eigenvectors."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, sums)] for v in x])
    values, own = np.linalg.eigh(centred.T @ centred / n)
    values, own = values[::-1][:wanted], own[:, ::-1][:, :wanted]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    return deviation, centred @ own / np.sqrt(np.maximum(values, 1e-300)), values / np.trace(centred.T @ centred / n)


def test_whitening_against_eigenvectors(spark):
    rng = np.random.default_rng(5)
    mix = rng.standard_normal((40, 40))
    rows = [(i, (mix @ rng.standard_normal(40)).tolist()) for i in range(300)]
    bad = [(1000, None), (1001, [None] * 40), (1002, [math.nan] * 40), (1003, [math.inf] + [0.0] * 39), (1004, []), (1005, [1e300] * 40)]
    got = whitening.whiten(vectors(spark, rows + bad)).collect()
    deviation, white, explained = whitened_by_eigh(rows)
    assert {r.vec_id for r in got} == set(range(300)) and len(got) == 300 * 32
    signs = {r.component: math.copysign(1, r.whitened * white[r.vec_id, r.component - 1]) for r in got if r.vec_id == 0}
    for r in got:
        assert r.n == 300 and int(r.deviation) == deviation[r.vec_id]
        assert r.whitened == pytest.approx(signs[r.component] * white[r.vec_id, r.component - 1], abs=1e-8)
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
        assert r.identity_error < 1e-9


def test_whitening_of_equal_eigenvalues_and_low_rank(spark):
    # Every direction alike: one interval holds all eigenvalues.
    axes = [(2 * i + s, [float(8 * (1 - 2 * s)) if j == i else 0.0 for j in range(20)]) for i in range(20) for s in (0, 1)]
    got = whitening.whiten(vectors(spark, axes)).collect()
    assert len(got) == 40 * 20 and all(r.identity_error < 1e-9 and r.explained == pytest.approx(0.05) for r in got)
    # Three rows span two dimensions; a null id and repeated rows count; another length is fitted apart; one row has no variance.
    few = [(None, [1.0, 2.0, 3.0, 0.0]), (1, [2.0, 0.0, 1.0, 5.0]), (1, [2.0, 0.0, 1.0, 5.0]), (4, [9.0, 1.0, 1.0, 1.0]), (5, [1.0]), (6, [2.0]), (7, [3.0, 4.0])]
    got = whitening.whiten(vectors(spark, few)).collect()
    assert Counter(r.vec_id for r in got) == {None: 2, 1: 4, 4: 2, 5: 1, 6: 1}
    assert sorted(abs(r.whitened) for r in got if r.vec_id in (5, 6)) == pytest.approx([1, 1])
    assert {int(r.deviation) for r in got if r.vec_id == 5} == {64 * 64} and all(r.identity_error < 1e-9 for r in got)
    assert whitening.whiten(vectors(spark, few).filter("false")).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0])] * 3)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 90), st.integers(0, 10_000), st.sampled_from(["spread", "close", "steps"]))
def test_feast_and_inertia(d, seed, kind):
    rng = np.random.default_rng(seed)
    values = {"spread": 10.0 ** rng.uniform(-4, 4, d), "close": 1 + 1e-3 * rng.random(d), "steps": rng.integers(1, 4, d).astype(float)}[kind]
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    v = (q * values) @ q.T
    v = (v + v.T) / 2
    true = np.sort(np.linalg.eigvalsh(v))[::-1]
    for shift in (true[0] * 1.01, true[d // 2] * 1.0001 + 1e-9, true[-1] * 0.9):
        assert whitening.count_above(v, shift) == (true > shift).sum() or np.abs(true - shift).min() < 1e-9 * true[0]
    found = whitening.intervals(v, 32)
    wanted = min(32, int((true > whitening.RANK_TOLERANCE * np.abs(v).sum(axis=1).max()).sum()))
    assert sum(k for _, _, k in found) >= wanted
    pairs = [whitening.feast(v, low, high, k, i) for i, (low, high, k) in enumerate(found)]
    got, own = np.concatenate([a for a, _ in pairs]), np.concatenate([b for _, b in pairs], axis=1)
    assert np.abs(got[:wanted] - true[:wanted]).max() <= 1e-12 * true[0] * d
    assert np.abs(v @ own - own * got).max() <= 1e-12 * true[0] * d


def test_exact_sums_of_large_components():
    x = np.array([[2 ** 61, 3], [-(2 ** 61) + 1, 4], [5, 2 ** 61]], np.int64)
    sums = whitening._total(np.concatenate([x] * 4))
    assert sums == [4 * sum(int(a) for a in c) for c in x.T]
    z = whitening._numerators(x, 12, sums)
    assert whitening._squares(z) == [sum((12 * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x]


# --- ranked search --------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, items, k=10):
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out, asked = set(), {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    for item, own in asked.items():
        scores = []
        for i, c in held:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if s > 0:
                scores.append((-s, i is None, i if i is not None else 0, i))
        out |= {(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)}
    return out


def corpus(size, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["İ", "straße", "CAFÉ", "x1"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    return [(i, rng.choice([" ", ", ", "\n"]).join(rng.choices(vocabulary, weights, k=rng.randint(0, 40)))) for i in range(size)]


def test_ranks_against_brute_force(spark, monkeypatch):
    docs = corpus(400) + [(None, "w1 w2 w3"), (7, "W1 w2 w3"), (900, None), (901, ""), (902, "w5 " * 30_000)]
    items = [(1, "w1 w2, w50 STRASSE straße"), (2, "w3 W3 w3"), (3, None), (4, ""), (5, "unknown"), (None, "w7 x1"), (6, "café İ w0"), (6, "w59"), (1, "w1")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], DOCS).selectExpr("*", "1 as score", "2 as item_id").repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "0 as rank", "1 as doc_id")
    want = ranked(docs, items)
    assert {tuple(r) for r in lexical.rank_documents(df, asked).collect()} == want
    # Small shards, few lists added up, and several passes give the same.
    monkeypatch.setattr(lexical, "TERMS_A_PASS", 5)
    assert {tuple(r) for r in lexical.rank_documents(df, asked).collect()} == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 30), st.integers(0, 6), min_size=1, max_size=30), max_size=7), st.integers(1, 6), st.integers(0, 31))
def test_hybrid_lists_against_sums(lists, k, short):
    total = Counter()
    for one in lists:
        total.update(one)
    want = sorted(((s, d) for d, s in total.items() if s > 0), key=lambda x: (-x[0], x[1]))[:k]
    given_ = [(np.array(sorted(one), np.int32), np.array([one[d] for d in sorted(one)], np.int64)) for one in lists]
    assert [x for x in lexical.best(given_, k, short) if x[0] > 0] == want


def test_shards_hold_all_terms(spark):
    docs = corpus(120)
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in docs], DOCS)
    for size in (200, 1 << 20):
        index = lexical.build_index(df.coalesce(2), shard_bytes=size).collect()
        held = Counter()
        for r in index:
            starts, ids = np.frombuffer(r.starts, np.int64), r.ids
            for i, term in enumerate(bytes(r.terms).split(b" ")):
                for d, c in zip(np.frombuffer(r.docs, np.int32)[starts[i]:starts[i + 1]], np.frombuffer(r.counts, np.int32)[starts[i]:starts[i + 1]]):
                    held[ids[d], term.decode()] += int(c)
        assert held == Counter((i, w) for i, t in docs for w in terms(t))
        assert (len(index) > 10) == (size == 200)


def test_search_of_odd_rows(spark):
    items = spark.createDataFrame([(1, "word"), (2, "x" * 200_000)], "item_id long, text string")
    rows = lexical.rank_documents(documents(spark), items).collect()
    assert {(r.item_id, r.rank, r.doc_id) for r in rows} == {(1, 1, None), (2, 1, 3)}
    assert lexical.rank_documents(documents(spark).filter("false"), items).count() == 0
    assert lexical.rank_documents(documents(spark), items.filter("false")).count() == 0
    assert lexical.rank_documents(documents(spark).filter("text = ''"), items).count() == 0


# --- secrets ----------------------------------------------------------------------------

PATTERNS = {
    "assign": r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"(AKIA)([A-Z0-9]+)", "hex": r"()([0-9a-f]+)"}


def base_by_patterns(text):
    found = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            size = len(m.group(2)) if kind == "assign" else m.end() - m.start()
            if size >= (6, 20, 24)[k]:
                found.append((m.start(), k, m.end(), kind))
    return [(a, b, kind) for a, _, b, kind in sorted(found)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["password", "Secret", "ſecret", "toKen", "api_key", "APIKEY", "=", ":", " ", '"', "'", "abc123", "AKIA", "ABCDEFGH12345678", "0123abcdef", "é", ".", "-"]), max_size=25))
def test_base_secrets(parts):
    text = "".join(parts)
    assert secret_scan.base_spans(text) == base_by_patterns(text)
    spans = secret_scan.base_spans(text)
    for start, end, label in secret_scan.labelled(text, spans):
        assert bool(label) == any(a < end and b > start for a, b, _ in spans)


def secrets_corpus(size, seed=1):
    """Documents with planted findings, look-alikes that are none, and the places of secrets that no pattern finds."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("aeioubdklmnprst", k=rng.randint(2, 9)))
    key = lambda chars, n: "".join(rng.choices(chars, k=n))
    hexes, upper = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    docs, hidden, clean = [], set(), set()
    for i in range(size):
        text = " ".join(word() for _ in range(30))
        plant = {
            0: f" password={key(hexes, 18)} ", 1: f' token = "{key(hexes, 40)}" ', 2: f" AKIA{key(upper, 16)} ", 3: f" mail{i}.{word()}.example.com ",
            4: f" see: {word()}{word()} ", 5: f" file_{i}-{word()}.txt ", 6: f" {key(hexes, 30)} "}.get(i % 8, " ")
        if i % 8 == 7 and i % 3 == 0:
            plant = f" passphrase={key(hexes, 18)} "
            hidden.add(i)
        elif i % 8 in (3, 4, 5, 7):
            clean.add(i)
        docs.append((i, text + plant + " ".join(word() for _ in range(10)), "en", "s", 0))
    return docs, hidden, clean


def test_network_finds_what_patterns_miss(spark):
    docs, hidden, clean = secrets_corpus(2400)
    rows = {r.doc_id: r for r in secret_scan.find_secrets(spark.createDataFrame(docs, DOCS)).collect()}
    for i, text, *_ in docs:
        base = base_by_patterns(text)
        own = [(s.start, s.end, s.kind) for s in rows[i].spans if s.kind != secret_scan.LEARNED]
        assert own == base and (rows[i].n_assign, rows[i].n_access, rows[i].n_hex) == tuple(sum(k == kind for *_, k in base) for kind in PATTERNS)
        for s in rows[i].spans:
            assert 0.5 <= s.probability <= 1 and 0 <= s.start < s.end <= len(text)
    found = {i for i, r in rows.items() if any(s.kind == secret_scan.LEARNED for s in r.spans)}
    assert len(found & hidden) >= 0.9 * len(hidden) and len(found & clean) <= 0.01 * len(clean)


def test_network_gradients_and_recall():
    rng = np.random.default_rng(0)
    windows = [("ab cd12ef gh", 3, 9), ("xy", 0, 2), ("x" * 40 + " é\n", 5, 30), ("token=abc123", 6, 12)]
    labels = np.array([1, 0, 2, 3])
    size = {"embed": (99, 8), "conv": (40, 24), "conv_b": (24,), "dense": (97, 16), "dense_b": (16,), "out": (16, 4), "out_b": (4,)}
    w = {k: rng.standard_normal(s) * 0.3 for k, s in size.items()}
    codes, part = secret_scan._padded(windows)
    cost = np.array([1.0, 2.0, 0.5, 1.5])

    def loss():
        z = secret_scan._forward(w, codes, part)[0]
        z = z - z.max(axis=1, keepdims=True)
        return -(cost[labels] * (z[np.arange(4), labels] - np.log(np.exp(z).sum(axis=1)))).mean()

    g = secret_scan._gradients(w, codes, part, labels, cost)
    for name, at in (("out", (3, 2)), ("dense", (5, 4)), ("dense", (96, 3)), ("conv", (7, 5)), ("conv_b", (2,)), ("embed", (66, 3))):
        old = w[name][at]
        w[name][at] = old + 1e-6
        high = loss()
        w[name][at] = old - 1e-6
        low = loss()
        w[name][at] = old
        assert g[name][at] == pytest.approx((high - low) / 2e-6, abs=1e-5)
    # Padding changes nothing: windows alone score as they do together.
    together = secret_scan.logits_of(w, windows)
    assert np.allclose(together, np.concatenate([secret_scan.logits_of(w, [x]) for x in windows]))
    # Thresholds keep the stated share of held-out findings.
    docs, _, _ = secrets_corpus(1600, seed=9)
    seen, kinds = [], []
    for _, text, *_ in docs:
        for a, b, k in secret_scan.labelled(text, secret_scan.base_spans(text)):
            seen.append(secret_scan.window(text, a, b))
            kinds.append(k)
    held = np.arange(len(seen)) % 4 == 0
    model = secret_scan.train(seen, np.array(kinds), held)
    assert model.kinds
    p = model.probabilities(seen)
    for column, (k, (_, _, threshold)) in enumerate(model.kinds.items()):
        own = held & (np.array(kinds) == k)
        assert threshold == 0.5 or (p[own, column] >= threshold).mean() >= secret_scan.RECALL


def test_secrets_of_odd_rows(spark):
    hard = "password" + " " * 200_000 + "x secret='" + "a1" * 300_000 + "' " + "a=" * 100_000 + "token" * 50_000
    rows = [*ODD_ROWS, (4, hard, None, None, 0)]
    out = secret_scan.find_secrets(documents(spark, rows)).collect()
    assert len(out) == 6 and {r.doc_id: r.n_assign for r in out}[4] == len([s for s in base_by_patterns(hard) if s[2] == "assign"])
    assert all(not r.spans for r in out if r.doc_id != 4)
    assert secret_scan.find_secrets(documents(spark).filter("false")).count() == 0


def test_sample_does_not_depend_on_partitions(spark):
    docs = spark.createDataFrame(secrets_corpus(400)[0] * 2, DOCS)
    one, many = (sorted(map(tuple, secret_scan.sample(docs.repartition(n)).collect())) for n in (1, 7))
    assert one == many and len(one) == len(set(one))
    assert hashlib.sha256(repr(one).encode()).hexdigest() == hashlib.sha256(repr(many).encode()).hexdigest()


def test_the_network_learns_from_every_window(spark):
    docs = [(i, f"see file_{i}-abc.txt and password=ab{i}cdef", "en", "s", 0) for i in range(6500)]
    rows = secret_scan.sample(spark.createDataFrame(docs, DOCS)).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in rows} == {0: 6500, 1: 6500}


def test_shards_learn_together(spark, monkeypatch):
    monkeypatch.setattr(secret_scan, "SHARD", 3000)
    docs, hidden, clean = secrets_corpus(9600)
    model = secret_scan.fit(spark.createDataFrame(docs, DOCS))
    assert len(model.kinds) == 3
    found = {i for (i, *_), (_, spans) in zip(docs, secret_scan.scan([text for _, text, *_ in docs], model)) if any(k == secret_scan.LEARNED for _, _, k, _ in spans)}
    assert len(found & hidden) >= 0.9 * len(hidden) and len(found & clean) <= 0.01 * len(clean)
    part = secret_scan.Training({"w": np.ones(2)}, {"w": np.zeros(2)}, {"w": np.zeros(2)}, 4)
    other = secret_scan.Training({"w": np.full(2, 4.0)}, {"w": np.ones(2)}, {"w": np.zeros(2)}, 8)
    mean = secret_scan._averaged(iter([(1, part), (3, other)]))
    assert mean.w["w"].tolist() == [3.25, 3.25] and mean.first["w"].tolist() == [0.75, 0.75] and mean.step == 7
