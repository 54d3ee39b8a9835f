"""Line dedup, licences, languages, personal data: against brute force, and on nulls, empty, long and repeated texts."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from straitline.llm import language_id, license_scan, line_dedup, pii

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD_ROWS = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "word", None, "s", 4), (3, "x" * 200_000, "en", "s", 200_000)]


def documents(spark, rows=ODD_ROWS):
    """Documents with more columns, some named like what operators add."""
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", "1 as score", "'a' as row", "2 as drop", "3 as host")


# --- line dedup -------------------------------------------------------------------

def test_lines_by_site_against_brute_force(spark):
    rows = [(i, "\n".join([f"own {i}", "menu" if i % 3 else "other", "", "rare" if i < 2 else f"b{i}", "menu"]), "en", "s" if i % 2 else None, 0)
            for i in range(60)]
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.drop_site_boilerplate(documents(spark, rows), counts=True).collect()}
    pages, total = defaultdict(Counter), Counter()
    for _, text, _, source, _ in rows:
        total[source] += 1
        pages[source].update({x for x in text.split("\n") if x.strip(" ")})
    for i, text, _, source, _ in rows:
        kept = [x for x in text.split("\n") if not (pages[source][x] >= 3 and pages[source][x] / total[source] > 0.05)]
        assert got[i] == ("\n".join(kept), 5, 5 - len(kept))


def test_lines_of_odd_rows(spark):
    docs = documents(spark)
    out = line_dedup.drop_site_boilerplate(docs)
    assert out.columns == docs.columns and sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
    assert line_dedup.drop_site_boilerplate(docs.filter("false"), counts=True).count() == 0


# --- licences ---------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base_by_words(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    places, labels = [], set()
    for phrase, label in license_scan.BASE:
        parts = phrase.split()
        for k in range(len(words) - len(parts) + 1):
            if words[k:k + len(parts)] == parts:
                places.append(k)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["under", "The", "MIT", "license", "é", "cc", "by-nc", " ", ".", "\n", "Apache", "version", "2", "İ", "x"]), max_size=30))
def test_base_phrases(parts):
    for text in ("".join(parts), " ".join(parts)):
        assert license_scan.scan(text)[:5] == base_by_words(text)


def test_fuzzy_notices():
    clean = "é Some words before. "
    for notice, label, edits in license_scan.NOTICES:
        assert label in license_scan.scan(clean + notice.upper() + ", and more")[5].split(",")
        broken = list(notice)
        for k in range(min(edits, 3)):
            broken[4 + 7 * k] = "#" if broken[4 + 7 * k] == " " else "q"
        _, _, _, _, _, labels, score, spans = license_scan.scan(clean + "".join(broken))
        assert label in labels.split(",") and 0 < score <= 1
        span = next(s for s in spans if s["label"] == label)
        assert len(clean) - edits <= span["start"] <= len(clean) + edits
    assert license_scan.scan("released under the bsd licence")[5] == "" and license_scan.scan("a licence to think about mit")[7] == []


def test_licences_of_odd_rows(spark):
    rows = {(r.doc_id, r.n_words, r.n_base, r.first_word, r.labels) for r in license_scan.scan_licenses(documents(spark)).collect()}
    assert rows == {(1, 0, 0, None, ""), (2, 0, 0, None, ""), (None, 1, 0, None, ""), (3, 1, 0, None, "")}
    assert license_scan.scan_licenses(documents(spark).filter("false")).count() == 0


# --- languages --------------------------------------------------------------------

def test_forward_sums_all_segmentations():
    import numpy as np

    pieces = {"▁": 0, "a": 1, "b": 2, "ab": 3, "▁a": 4, "": 5}
    table = np.array([[.1, .3], [.2, .1], [.15, .2], [.3, .1], [.2, .2], [.05, .1], [0, 0]])

    def brute(word, lang):
        if not word:
            return 1.0
        total = 0.0
        for n in range(1, len(word) + 1):
            k = pieces.get(word[:n], 5 if n == 1 else -1)
            total += table[k][lang] * brute(word[n:], lang)
        return total

    for word in ("a", "ab", "abba", "zab"):
        got = np.exp(language_id.log_likelihoods([word], table, pieces, 2)[0])
        assert got == pytest.approx([brute("▁" + word, 0), brute("▁" + word, 1)])
    counts = language_id.expected_counts(np.array([0]), ["ab"], np.array([2.0]), table, pieces, 2)
    ways = {(0, 1, 2): .1 * .2 * .15, (0, 3): .1 * .3, (4, 2): .2 * .15}
    for k in range(5):
        assert counts[k][0] == pytest.approx(2 * sum(p for w, p in ways.items() if k in w) / sum(ways.values()))


def test_words_of_any_length_are_summed_whole(monkeypatch):
    import time

    pieces, longest = language_id.load_pieces(language_id.tokenizer_path(language_id.VOCABULARY))
    rng = np.random.default_rng(5)
    table = np.vstack([rng.dirichlet(np.full(pieces[""] + 1, .3), 3).T + 1e-11, np.zeros((1, 3))])
    words = ["a", "haus", "xylophon", "donaudampfschifffahrt", "ßæ", "internationalisation"]
    langs, counts = np.array([0, 1, 2, 0, 1, 2]), np.arange(1.0, 7.0)
    want = language_id.log_likelihoods(words, table, pieces, longest)
    uses = language_id.expected_counts(langs, words, counts, table, pieces, longest)
    with monkeypatch.context() as m:
        m.setattr(language_id, "LEAST_EXPONENT", -1.0)  # all words the other way
        m.setattr(language_id, "SIDE_BY_SIDE", 24)
        assert language_id.log_likelihoods(words, table, pieces, longest) == pytest.approx(want)
        assert language_id.expected_counts(langs, words, counts, table, pieces, longest) == pytest.approx(uses)
    # A long word against plain sums in which the largest addend is taken out.
    word = "rindfleischetikettierungsueberwachungsaufgabe" * 40
    marked, logs = language_id.WORD_START + word, [0.0]
    for j in range(1, len(marked) + 1):
        found = [(i, pieces.get(marked[i:j], pieces[""] if j - i == 1 else -1)) for i in range(max(0, j - longest), j)]
        parts = [logs[i] + np.log(table[k, 1]) for i, k in found if k >= 0]
        logs.append(max(parts) + np.log(sum(np.exp(x - max(parts)) for x in parts)))
    assert language_id.log_likelihoods([word], table, pieces, longest)[0, 1] == pytest.approx(logs[-1])
    # Each segmentation covers the word once, so expected uses times lengths give its length.
    total = language_id.expected_counts(np.array([1]), [word], np.array([1.0]), table, pieces, longest)[:, 1]
    lengths = np.ones(len(total))
    for piece, k in pieces.items():
        lengths[k] = max(1, len(piece))
    assert total @ lengths == pytest.approx(len(marked))
    began = time.time()
    assert np.isfinite(language_id.log_likelihoods(["z" * 200_000], table, pieces, longest)).all()
    assert time.time() - began < 20


def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs.filter(~language_id.held_out()), per_language=60)
    told = language_id.predict(docs.select("doc_id", "text"), model).join(docs.select("doc_id", "lang"), "doc_id").filter(language_id.held_out()).collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in told)
    assert sum(r.lang == r.lang_pred for r in told) / len(told) > 0.98
    odd = language_id.predict(documents(spark), model)
    assert {(r.doc_id, r.lang_pred == "und") for r in odd.collect()} == {(1, True), (2, True), (None, False), (3, False)}
    assert language_id.predict(documents(spark), language_id.fit(documents(spark).filter("false"))).filter("lang_pred <> 'und' or score <> 0").count() == 0


# --- personal data ----------------------------------------------------------------

def base_by_patterns(text):
    digits = lambda m: re.sub(r"[^0-9]", "", m)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]
    return out


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="ab.@-+1240 (é", max_size=60))
def test_base_spans(text):
    assert pii.detect(text) == base_by_patterns(text)
    base, every = pii.find(text)
    assert set(base) <= set(every)


@pytest.mark.parametrize(("text", "span"), [
    ("Write to john [at] mail (dot) example [dot] com now", "john [at] mail (dot) example [dot] com"),
    ("see x at y dot com, or", "x at y dot com"), ("é jоhn@mаil.com", "jоhn@mаil.com"),
    ("call plus one five five five one two three four five six seven.", "plus one five five five one two three four five six seven"),
    ("card ４１１１ １１１１ １１１１ １１１１ ok", "４１１１ １１１１ １１１１ １１１１")])
def test_disguises_map_back(text, span):
    base, every = pii.find(text)
    assert base == [] and [text[a:b] for _, a, b in every] == [span]
    assert span not in pii.masked(text)


@pytest.mark.parametrize(("text", "span"), [
    ("card 4111\u00a01111\u00a01111\u00a01111 ok", "4111\u00a01111\u00a01111\u00a01111"), ("to john@mail\u2024com, or", "john@mail\u2024com"),
    ("john@m\u00aail.com is", "john@m\u00aail.com"), ("to john[at ]mail.com, or", "john[at ]mail.com"), ("to john(at\t)mail.com, or", "john(at\t)mail.com"),
    ("card 4111 1111 1111 one one one one ok", "4111 1111 1111 one one one one"), ("card four 111 1111 1111 1111 ok", "four 111 1111 1111 1111"),
    ("card 4111 1111 one one 11 1111 ok", "4111 1111 one one 11 1111"), ("room 12 four one one one 1111 1111 1111 ok", "four one one one 1111 1111 1111"),
    ("call plus 1 555 123 4567.", "plus 1 555 123 4567"), ("host 192.168.one.seven is", "192.168.one.seven")])
def test_disguises_without_other_odd_characters(text, span):
    base, every = pii.find(text)
    assert [text[a:b] for _, a, b in every] == [span]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["john", "@", " at ", "[at ]", "(dot\t)", ".", "com", "\u00a0", "\u2024", "\u017f", "\u00aa", " ", "one", "seven", "plus", "4111", "1111", "11", "-", "+", "é"]), max_size=14))
def test_gate_lets_all_disguises_through(parts):
    text = "".join(parts)
    base = pii.detect(text)
    assert pii.disguised_spans(text, base) == pii.disguised_spans(text, base, gate=False)


def test_clean_texts_stay():
    for text in ("Meet at noon, dot the i.", "one two three", "Version 1.2.3 of 2024-01-02", "Дом и сад", "x² + y²", "", "naïve café"):
        assert pii.find(text) == ([], []) and pii.masked(text) == text


def test_personal_data_of_odd_rows(spark):
    rows = pii.find_personal_data(documents(spark)).collect()
    assert len(rows) == 5 and {(r.n_email, r.base_sha256, r.spans) for r in rows} == {(0, hashlib.sha256(b"").hexdigest(), "")}
    docs = documents(spark)
    assert sorted(map(str, pii.mask_personal_data(docs).collect())) == sorted(map(str, docs.collect()))


# --- long texts that invite quadratic work ------------------------------------------

OLD_BARE_ADDRESS = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+(?:\s(?:dot)\s[A-Za-z0-9_%+-]+)*(\s(?:at)\s)[A-Za-z0-9-]+((?:\s(?:dot)\s[A-Za-z0-9-]+)+)(?![A-Za-z0-9-])", re.I)


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.c", "at", "AT", "dot", "Dot", " ", " ", " ", "\n", "-", "_", ".", "é", "x"]), max_size=24))
def test_bare_addresses_as_one_pattern_tells_them(parts):
    for text in ("".join(parts), " ".join(parts)):
        words = text.lower().split()
        if any(x in ("at", "dot") and y in ("at", "dot") for x, y in zip(words, words[1:])):
            continue  # signs that are names too: which is which is a matter of taste
        assert pii._bare_addresses(text) == [m.span() for m in OLD_BARE_ADDRESS.finditer(text)], text


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["(at)", "[dot]", "( at )", "{DOT", ")", " ", "\t", "a", "(", "at"]), max_size=16))
def test_signs_in_brackets_as_one_pattern_tells_them(parts):
    text = "".join(parts)
    assert [(a, b) for a, b, _ in pii._bracketed(text)] == [m.span() for m in re.finditer(rf"\s*{pii.IN_BRACKETS}\s*", text, re.I)]


@pytest.mark.parametrize("part", ["dot" + " " * 199_000, "x dot ", "a at b dot ", "( dot ", "one ", "one -. ", "x@", "+1 (", "(at)  ", "1.", "4 ", "a dot b at c dot d "])
def test_personal_data_of_long_texts(part):
    import time

    start = time.perf_counter()
    pii.find(part * (200_000 // len(part)))
    assert time.perf_counter() - start < 20


@pytest.mark.parametrize("part", ["under the mit license ", "licensed under the mit licence ", "released under the mit license ", " ", "x ", "under the mit "])
def test_licences_of_long_texts(part):
    import time

    start = time.perf_counter()
    license_scan.scan(part * (200_000 // len(part)))
    assert time.perf_counter() - start < 20


def test_an_earlier_notice_with_edits_stays():
    spans = license_scan.scan("licensed under the mit licence licensed under the mit license")[7]
    assert [(s["start"], s["end"], s["label"]) for s in spans] == [(0, 30, "mit"), (31, 61, "mit")]


def test_figures_are_no_letters(spark):
    docs = spark.createDataFrame([(i, t, lang, "s", 0) for i, (t, lang) in enumerate([("the cat sat", "en"), ("die katze", "de"), ("½ ² ① Ⅳ", None), ("½ a", None)])], DOCS)
    got = {r.doc_id: r.lang_pred for r in language_id.predict(docs, language_id.fit(docs)).collect()}
    assert got[2] == "und" and got[3] in ("en", "de") and got[0] == "en"


def test_variants_of_fingerprints_are_never_broadcast(spark, tmp_path):
    from straitline.llm import simhash

    spark.createDataFrame([(1,), (3,), (1 << 40,)], "print long").write.parquet(f"{tmp_path}/prints")
    prints = spark.read.parquet(f"{tmp_path}/prints")  # a stored table, whose size Spark knows
    pairs = simhash.near_fingerprints(prints, 2)
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert {(r.a, r.b) for r in pairs.collect()} == {(1, 3), (1, 1 << 40)}
