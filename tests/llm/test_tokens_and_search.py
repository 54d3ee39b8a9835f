"""Tokens, packing, token files, merge-dropout, vector searches, near duplicates and the pipeline."""

import uuid
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from straitline.llm import bit_sliced, merge_dropout, packing, rans, simhash, tokens, vptree
from straitline.llm.common import load_tokenizer, tokenizer_path
from straitline.llm.components import components
from straitline.llm.tokens import encoder
from straitline.session import scratch_folder

DOCS = "doc_id long, text string"
ROWS = [(1, None), (2, ""), (2, ""), (None, "a word"), (3, "long " * 3000), (4, "x y\n\n z"), (5, "copy of a text"), (6, "copy of a text")]


def documents(spark, rows=ROWS):
    return spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as id", "'a' as ids", "2 as start", "3 as key")


# --- encoders ---------------------------------------------------------------------

@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abÉzéß.,'s12 -\n\t\x1c  ́İΣ!<|>", max_size=25), max_size=6))
def test_encoders_equal_the_library(texts):
    for name, spaces, fold in (("byte_bpe_50k.json", True, False), ("word_bpe_49k.json", False, True)):
        path = tokenizer_path(name)
        want = [e.ids for e in load_tokenizer(path).encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder(path, spaces, fold).encode(texts)] == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aBé, .\n\r\x1c ", min_size=1, max_size=12), min_size=1, max_size=6))
def test_encoders_remember_few_stretches(texts):
    """What was forgotten is made again, and a stretch with a space before it is another than one without."""
    for name, spaces, fold in (("byte_bpe_50k.json", True, False), ("word_bpe_49k.json", False, True)):
        path = tokenizer_path(name)
        own, want = tokens.Encoder(path, spaces, fold), [e.ids for e in load_tokenizer(path).encode_batch(texts, add_special_tokens=False)]
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(tokens, "REMEMBERED", 1)
            assert [np.frombuffer(own.encode([t])[0], "<u4").tolist() for t in texts + texts] == want + want


# --- packing ----------------------------------------------------------------------

def test_packing_places_each_id_once(spark):
    docs = documents(spark).unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id + 100 as doc_id", "text", "1 id", "'a' ids", "2 start", "3 key"))
    pieces = packing.pack(docs.repartition(3), windows=4).toPandas()
    encode = encoder(tokenizer_path("byte_bpe_50k.json"), True, False).encode
    want = sorted(np.append(np.frombuffer(encode([t])[0], "<u4"), 0).astype("<u4").tobytes() for t in (r.text for r in docs.collect()))
    got = defaultdict(list)
    for p in pieces.itertuples():
        assert len(p.ids) == 4 * p.length and zlib.crc32(p.ids) == p.ids_crc32
        got[p.doc_id].append(p)
    whole = []
    for parts in got.values():
        if len({(p.start, p.length, p.sequence_id, p.offset) for p in parts}) and sum(p.length for p in parts) == parts[0].doc_tokens:
            parts.sort(key=lambda p: p.start)
            assert [p.start for p in parts] == np.cumsum([0] + [p.length for p in parts])[:-1].tolist()
            whole.append(b"".join(p.ids for p in parts))
        else:  # a repeated id
            assert all(p.doc_tokens == p.length for p in parts)
            whole += [p.ids for p in parts]
    assert sorted(whole) == want
    for _, s in pieces.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s["offset"].tolist() == np.cumsum([0, *s["length"]])[:-1].tolist()
        assert s["length"].sum() == 1024 or bin(s["length"].sum()).count("1") == 1
    assert packing.pack(docs.filter("false")).count() == 0


# --- token files ------------------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=3000), st.integers(1, 40))
def test_blocks_decode(tokens, times):
    own = np.array(tokens * times, np.uint32)
    freq = rans.quantised(np.bincount(own))
    start = rans._starts(freq)
    block = rans.encode_block(own, freq, start)
    assert (rans.decode_block(block, freq, start, rans.slot_table(freq)) == own).all()
    for at in (rans.HEADER.size + 2, len(block) - 1):
        with pytest.raises(ValueError):
            rans.decode_block(block[:at] + bytes([block[at] ^ 1]) + block[at + 1:], freq, start, rans.slot_table(freq))


def test_token_files_round_trip(spark):
    docs = documents(spark)
    encode = encoder(tokenizer_path("word_bpe_49k.json"), False, True).encode
    want = sorted(((-1 if r.doc_id is None else r.doc_id), np.append(np.frombuffer(encode([r.text])[0], "<u4"), 1).astype("<u4").tobytes()) for r in docs.collect())
    back = sorted(rans.round_trip(docs, f"{scratch_folder(spark)}/{uuid.uuid4().hex}").collect(), key=lambda r: r.start)
    assert sorted((-1 if r.id is None else r.id, bytes(r.ids)) for r in back) == want
    assert [-1 if r.id is None else r.id for r in back] == [d for d, _ in want]
    assert [r.start for r in back] == np.cumsum([0] + [len(r.ids) // 4 for r in back])[:-1].tolist()
    assert rans.round_trip(docs.filter("false"), f"{scratch_folder(spark)}/{uuid.uuid4().hex}").count() == 0


# --- merge-dropout ----------------------------------------------------------------

@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcthe .,\n é日▁😀1", max_size=80))
def test_merge_dropout_is_lossless(text):
    path = tokenizer_path(merge_dropout.VOCABULARY)
    for dropout in (0.0, 0.1, 0.9):
        own = merge_dropout.segmenter(path, dropout)
        assert own.decode(own.encode(text, 7)) == text and own.encode(text, 7).tolist() == own.encode(text, 7).tolist()


def test_merge_dropout_without_dropout_is_the_vocabularys_own(spark):
    import sentencepiece

    path = tokenizer_path(merge_dropout.VOCABULARY)
    model, own = sentencepiece.SentencePieceProcessor(model_file=path), merge_dropout.segmenter(path, 0.0)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()] + ["a" * 500 + "  " * 99, " x\n y "]
    assert all(own.encode(t, 1).tolist() == model.encode(t) for t in texts)
    varied = merge_dropout.segmenter(path)
    assert sum(varied.encode(t, 1).tolist() != own.encode(t, 1).tolist() for t in texts) > 50
    out = merge_dropout.decode(merge_dropout.encode(documents(spark)).drop("text")).collect()
    assert len(out) == len(ROWS) and all(r.lossless for r in out) and {(r.doc_id, r.text) for r in out} == {(d, t or "") for d, t in ROWS}
    assert merge_dropout.encode(documents(spark).filter("false")).count() == 0


def test_each_occurrence_is_segmented_by_its_own_key():
    path = tokenizer_path(merge_dropout.VOCABULARY)
    own = merge_dropout.segmenter(path, 0.1)
    seen = {tuple(own.encode("understanding", doc).tolist()) for doc in range(300)}
    assert len(seen) > 10


def plain_agenda(own, text, doc):
    """Whole texts between literal marks, one agenda each, candidate by candidate."""
    import xxhash

    key, out, place = xxhash.xxh64_intdigest(str(doc).encode(), own.seed), [], 0
    for k, part in enumerate(text.split("▁")):
        if k:
            out += [own.single[b] for b in "▁".encode()]
        symbols = list(("" if k else "▁") + part.replace(" ", "▁"))
        starts = list(range(place + bool(k), place + bool(k) + len(symbols)))
        place = starts[-1] + 1 if symbols else place + bool(k)
        skipped = set()
        while True:
            pairs = [(own.ranks[symbols[i] + symbols[i + 1]], starts[i], i) for i in range(len(symbols) - 1)
                     if symbols[i] + symbols[i + 1] in own.ranks and (starts[i], symbols[i] + symbols[i + 1]) not in skipped]
            if not pairs:
                break
            rank, at, i = min(pairs)
            if merge_dropout._dropped(key, at, rank, own.limit):
                skipped.add((at, symbols[i] + symbols[i + 1]))
                continue
            symbols[i:i + 2] = [symbols[i] + symbols[i + 1]]
            del starts[i + 1]
        out += [x for s in symbols for x in own._spelled(s)]
    return out


WORDS = ["understanding", "the", "international,", "a" * 47, "b." * 24, "communication" * 4, "internationalisation" * 3, "▁", "x▁the", "\n", "", "日本語", "end."]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(WORDS), max_size=12), st.text(alphabet="theinrs .,\n日▁1", max_size=60), st.sampled_from([0.1, 0.5, 0.9]))
def test_merge_dropout_is_the_plain_agenda(words, text, dropout):
    own = merge_dropout.segmenter(tokenizer_path(merge_dropout.VOCABULARY), dropout)
    for t in (" ".join(words), text, text + "▁".join(words)):
        for doc in (3, "x"):
            assert own.encode(t, doc).tolist() == (plain_agenda(own, t, doc) if t else [])
            assert own.decode(own.encode(t, doc)) == t


def test_merge_dropout_forgets_and_has_no_length_rule(monkeypatch):
    path = tokenizer_path(merge_dropout.VOCABULARY)
    text = ("understanding the international " * 40 + "x" * 60 + " end.").strip()
    want = merge_dropout.Segmenter(path, 0.1, 42).encode(text, 3).tolist()
    for short, strays in ((0, 8), (5, 0), (48, 0), (200, 2)):
        monkeypatch.setattr(merge_dropout, "SHORT", short)
        monkeypatch.setattr(merge_dropout, "STRAYS", strays)
        assert merge_dropout.Segmenter(path, 0.1, 42).encode(text, 3).tolist() == want
    monkeypatch.setattr(merge_dropout, "REMEMBERED", 2)
    own = merge_dropout.Segmenter(path, 0.1, 42)
    assert all(own.encode(text, 3).tolist() == want for _ in range(4))
    assert len(own.encode("▁" + "the international " * 60, 1)) < 500  # text behind a literal mark is merged too


def test_texts_are_segmented_side_by_side(monkeypatch):
    own = merge_dropout.segmenter(tokenizer_path(merge_dropout.VOCABULARY), 0.3)
    texts = ["understanding  the international, " * 9, None, "a" * 90 + " 日本\ud800語 ▁ x▁the", "", "   lead\n\nand  gap  ", "end."] * 3
    want = [plain_agenda(own, t, k) if t else [] for k, t in enumerate(texts)]
    for chunk in (1 << 19, 40, 1):
        monkeypatch.setattr(merge_dropout, "CHUNK", chunk)
        assert [x.tolist() for x in own.encode_all(texts, list(range(len(texts))))] == want


# --- vectors ----------------------------------------------------------------------

def vectors(spark, n=700, d=16):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(n, d)).round(1)
    v[50:90] = v[7]  # ties
    rows = [(i, x.tolist(), "a") for i, x in enumerate(v)]
    rows += [(None, v[0].tolist(), "b"), (9000, None, "c"), (9100, [0.0] * d, "d"), (9200, [float("nan")] * d, "e"), (9300, [None] * d, "f"), (9400, [float("inf")] + [1.0] * (d - 1), "g"),
             (9500, [1.0, 2.0], "h"), (9600, [1.0, 3.0], "h"), (100, v[100].tolist(), "repeated")]
    return v, spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")


def test_nearest_exact_with_factor_one(spark):
    v, table = vectors(spark)
    got = defaultdict(list)
    for r in vptree.nearest(table, relax=1.0, shard_rows=150).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    for q in range(0, 700, 100):
        d = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(700), d.round(9))) if i != q][:10]
        assert [i for _, i, _ in sorted(got[q])] == order
    assert sorted(got) == [*range(0, 700, 100), 9500, 9600] and [x[:2] for x in got[9500]] == [(1, 9600)]
    found = {(r.query_id, r.vec_id) for r in vptree.nearest(table, shard_rows=150).collect()}
    assert len(found & {(q, i) for q, rows in got.items() for _, i, _ in rows}) >= 0.9 * sum(map(len, got.values()))
    assert vptree.nearest(table.filter("false")).count() == 0


def test_best_products(spark):
    v, table = vectors(spark)
    got = defaultdict(list)
    for r in bit_sliced.best_products(table, shard_rows=150).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    q = np.floor(256 * np.vstack([v, np.zeros((1, v.shape[1]))])).astype(int)
    ids = np.array([*range(700), 9100])
    for at in [*range(0, 700, 50), 700]:
        s = q @ q[at]
        order = [i for i in np.lexsort((ids, -s)) if i != at][:5]
        assert sorted(got[ids[at]]) == [(k + 1, ids[i], s[i]) for k, i in enumerate(order)]
    assert bit_sliced.best_products(table.filter("false")).count() == 0


# --- near duplicates --------------------------------------------------------------

def test_components_against_union_find(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(k, k + 1) for k in range(500, 700)] + [(900, k) for k in range(901, 1200)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {x: root(x) for x in {y for a, b in links if a != b for y in (a, b)}}


def test_fingerprints_link_within_two_bits(spark):
    import xxhash

    rng = np.random.default_rng(4)
    base = rng.integers(-(1 << 62), 1 << 62, 60)
    prints = {int(x) for x in base}
    for x in base[:40]:
        for _ in range(3):
            y = np.int64(x)
            for b in rng.integers(0, 64, rng.integers(1, 4)):
                y ^= np.int64(1 << int(b)) if b < 63 else np.int64(-(1 << 63))
            prints.add(int(y))
    got = [(r.a, r.b) for r in simhash.near_fingerprints(spark.createDataFrame([(p,) for p in prints], "print long")).collect()]
    own = sorted(prints)
    want = {(a, b) for k, a in enumerate(own) for b in own[k + 1:] if bin((a ^ b) & (1 << 64) - 1).count("1") <= 2}
    assert set(got) == want and len(got) == len(want)
    for text in ("A b c d", "one", "x y", "É  été\tb\nc d e f"):
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).split()
        h = [xxhash.xxh64_intdigest(" ".join(words[k:k + 3]), 42) for k in range(max(1, len(words) - 2))]
        assert int(simhash.fingerprint(text, 3)[0]) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_duplicates_of_odd_rows(spark):
    rows = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(documents(spark)).collect()}
    assert {(1, 1), (2, 1), (5, 5), (6, 5), (None, None)} <= rows
    assert simhash.near_duplicates(documents(spark).filter("false")).count() == 0


def near_copies():
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    rows, originals = [], []
    for k in range(40):
        words = [word() for _ in range(300)]
        originals.append(1000 * k)
        rows.append((1000 * k, " ".join(words)))
        for c in range(1, 5):
            own = list(words)
            for at in rng.choice(300, c, replace=False):
                own[at] = word()
            rows.append((1000 * k + c, " ".join(own) if c > 1 else " ".join(words).upper()))
        rows.append((1000 * k + 9, " ".join(words[:150] + [word() for _ in range(150)])))  # shares half: no duplicate
    return rows, originals


def test_one_of_each_group_stays(spark):
    rows, originals = near_copies()
    rows += [(70_000, None), (70_001, ""), (70_002, "lone"), (70_002, "lone"), (None, "lone"), (None, "without id")]
    docs = documents(spark, rows)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect())
    want = {*originals, *(x + 9 for x in originals), 70_000, 70_002, -1}
    assert want <= set(ids) and len(ids) <= len(want) + 3 and len(ids) == len(set(ids))
    assert simhash.drop_near_duplicates(docs.filter("false")).count() == 0


def look_alikes():
    """Texts of one template, an own fifth to a third each, and variants of some: near copies, and pairs just below."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    template = [word() for _ in range(150)]
    rows = []
    for k in range(120):
        own = template[:] + [word() for _ in range(int(rng.integers(25, 60)))]
        rows.append((10 * k, " ".join(own)))
        for c in range(1, 3):
            edited = list(own)
            for at in rng.choice(len(own), int(rng.integers(1, 5)), replace=False):
                edited[at] = word()
            rows.append((10 * k + c, " ".join(edited)))
    return rows


def test_no_link_between_look_alikes_is_missed(spark):
    rows = look_alikes()
    sets = [set(zip(*(t.split()[k:] for k in range(5)))) for _, t in rows]
    least = list(range(len(rows)))

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if len(x & y) / len(x | y) >= 0.8:
                least[max(root(i), root(j))] = min(root(i), root(j))
    want = sorted(rows[i][0] for i in range(len(rows)) if root(i) == i)
    assert 100 < len(want) < len(rows)
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(documents(spark, rows)).collect()) == want


def test_pairs_are_verified_with_less_than_their_texts(spark, monkeypatch):
    """What is stored to verify pairs takes less room than the texts, and likeness is that of the whole shingle sets."""
    rng = np.random.default_rng(5)
    rows = [(k, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"], 800))) for k in range(60)]
    rows += [(100 + k, t + " end") for k, t in rows[:30]]
    texts = simhash.stored(spark.createDataFrame(rows, "key long, text string").repartition(2), "given")
    pairs = spark.createDataFrame([(k, 100 + k) for k in range(30)] + [(k, k + 1) for k in range(59)], "a long, b long")
    sizes, stored = [], simhash.stored

    def seen(df, name):
        out = stored(df, name)
        sizes.append(sum(p.stat().st_size for p in Path(out.stored_path.removeprefix("file:")).glob("*.parquet")))
        return out

    monkeypatch.setattr(simhash, "stored", seen)
    monkeypatch.setattr(simhash, "HELD", 100)
    found = {(r.a, r.b) for r in simhash.similar_links(texts, pairs).collect()}
    text = dict(rows)
    sets = {k: set(simhash.shingle_set(t, 5).tolist()) for k, t in text.items()}
    assert found == {(r.a, r.b) for r in pairs.collect() if len(sets[r.a] & sets[r.b]) >= 0.8 * len(sets[r.a] | sets[r.b])}
    assert sum(sizes) < sum(len(t) for t in text.values())


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline

    rows, originals = near_copies()
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 7}", len(t)) for i, t in rows] + [(90_000, "1234 !!", "en", "s1", 7), (90_001, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert {*originals, *(x + 9 for x in originals)} <= set(pieces["doc_id"]) and not {90_000, 90_001} & set(pieces["doc_id"])
    tokens = pieces.groupby("doc_id").agg(n=("length", "sum"), want=("doc_tokens", "first"))
    assert (tokens["n"] == tokens["want"]).all()
    docs.filter("false").write.parquet(str(tmp_path / "empty" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "personal_data", "packing"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=40), st.lists(st.integers(0, 40), max_size=5))
def test_lone_shingles_go_and_no_others(tokens, cuts):
    import pyarrow as pa

    tokens = sorted(tokens)
    cuts = sorted(min(c, len(tokens)) for c in cuts)
    batches = [pa.RecordBatch.from_arrays([pa.array(tokens[a:b], pa.int64()), pa.array(range(a, b), pa.int64())], names=["token", "key"])
               for a, b in zip([0, *cuts], [*cuts, len(tokens)])]
    got = [(t, k) for b in simhash._without_lone(iter(batches)) for t, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    want = [(t, k) for k, t in enumerate(tokens) if tokens.count(t) > 1 or k in (0, len(tokens) - 1)]
    assert got == want
