"""Language identification by unigram piece models whose probability of a word sums over all its segmentations.

The pieces are those of a public vocabulary and never change; each language only learns their probabilities, by expectation
maximisation over the words of a sample of labelled documents. A forward pass sums the segmentations of a word in every
language at once; a document's score is the product over its words.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from straitline.llm.common import ROWS, arrow_map, fresh, hold_alone, stored, tokenizer_path

VOCABULARY = "piece_bpe_32k.model"
#: Labelled documents of a language that the model is fitted on, in the mean; a hash of id and text decides.
SAMPLE_PER_LANGUAGE = 400
ROUNDS = 2
#: Languages up to which their sizes are broadcast.
MANY = 10_000
#: Added to each expected count.
SMOOTHING = 0.01
#: Products of probabilities stay above this power of e, so that doubles hold them; longer words are summed in logarithms.
LEAST_EXPONENT = -690.0
#: Letters of long words that are summed side by side.
SIDE_BY_SIDE = 1 << 16
UNDETERMINED = "und"
#: Distinct words, and ten times as many letters of theirs, whose likelihoods a worker keeps at a time; it starts anew beyond that.
REMEMBERED = 300_000

LETTERS = re.compile(r"[^\W\d_]+")
WORD_START = "▁"


@functools.lru_cache(maxsize=2)
def load_pieces(path: str) -> tuple[dict[str, int], int]:
    """Ids of the vocabulary's text pieces, and the length of the longest; the id after the last stands for an unknown character."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.vocab_size()
    ids = {model.id_to_piece(i): i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    ids[""] = n
    return ids, max(map(len, ids))


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters, of any length."""
    return LETTERS.findall((text or "").lower())


def lattice(words: list[str], pieces: dict[str, int], longest: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """All spans of words of one length, and the piece of each word at each span, -1 where the vocabulary has none."""
    marked, n = [WORD_START + w for w in words], len(words[0]) + 1
    spans = [(i, j) for j in range(1, n + 1) for i in range(max(0, j - longest), j)]
    unknown, get = pieces[""], pieces.get
    rows = [[get(w[i:j], -1) if j - i > 1 else get(w[i:j], unknown) for i, j in spans] for w in marked]
    return spans, np.array(rows, np.int32).reshape(len(words), len(spans))


def by_length(words: Iterable[str]) -> dict[int, list[str]]:
    groups: dict[int, list[str]] = {}
    for w in words:
        groups.setdefault(len(w), []).append(w)
    return groups


def forward(spans: list[tuple[int, int]], at: np.ndarray, prob) -> list[np.ndarray]:
    """The summed probability of each prefix; ``prob`` gives that of the pieces in a column of the lattice."""
    n = spans[-1][1]
    alpha: list = [1.0] + [0.0] * n
    for k, (i, j) in enumerate(spans):
        if (at[:, k] >= 0).any():
            alpha[j] = alpha[j] + alpha[i] * prob(at[:, k])
    return alpha


def longest_product(table: np.ndarray) -> int:
    """Letters up to which a word's segmentations are summed as products: even its least likely one stays within doubles."""
    least = table[:-1].min() if table.size else 1.0
    return int(LEAST_EXPONENT / np.log(least)) - 1 if least < 1 else 1 << 30


def _ids_at(marked: str, j: int, pieces: dict[str, int], longest: int) -> list[int]:
    """The pieces that end before place ``j``, longest first, -1 where the vocabulary has none or the word begins later."""
    get = pieces.get
    return [-1] * (longest - j) + [get(marked[i:j], -1) for i in range(max(0, j - longest), j - 1)] + [get(marked[j - 1], pieces[""])]


def log_forward(words: list[str], logs: np.ndarray, pieces: dict[str, int], longest: int) -> np.ndarray:
    """What ``forward`` sums, in logarithms: long words side by side, the last ``longest`` places of each held at a time."""
    order = sorted(range(len(words)), key=lambda k: -len(words[k]))
    marked = [WORD_START + words[k] for k in order]
    out, live = np.empty((len(words), logs.shape[1])), len(words)
    window = np.full((len(words), longest, logs.shape[1]), -np.inf)
    window[:, -1] = 0.0
    for j in range(1, len(marked[0]) + 1):
        ids = np.array([_ids_at(m, j, pieces, longest) for m in marked[:live]], np.int32)
        now = np.logaddexp.reduce(window[:live] + logs[ids], axis=1)
        window[:live, :-1] = window[:live, 1:]
        window[:live, -1] = now
        while live and len(marked[live - 1]) == j:
            live -= 1
            out[order[live]] = now[live]
    return out


def _blocks(words: list[str]) -> Iterable[list[str]]:
    """Words of similar length together, about ``SIDE_BY_SIDE`` letters at a time or one word of more."""
    block, letters = [], 0
    for w in sorted(words, key=len):
        if block and letters + len(w) > SIDE_BY_SIDE:
            yield block
            block, letters = [], 0
        block.append(w)
        letters += len(w)
    if block:
        yield block


def log_likelihoods(words: list[str], table: np.ndarray, pieces: dict[str, int], longest: int) -> np.ndarray:
    """Log probability of each word (rows) in each language (columns). The table's last row, zero, stands for no piece."""
    out = np.empty((len(words), table.shape[1]))
    order = {w: k for k, w in enumerate(words)}
    limit = longest_product(table)
    for group in by_length(w for w in words if len(w) <= limit).values():
        for a in range(0, len(group), 20_000):
            part = group[a:a + 20_000]
            spans, at = lattice(part, pieces, longest)
            out[[order[w] for w in part]] = np.log(forward(spans, at, table.__getitem__)[-1])
    long = [w for w in words if len(w) > limit]
    if long:
        with np.errstate(divide="ignore"):
            logs = np.log(table)
        for block in _blocks(long):
            out[[order[w] for w in block]] = log_forward(block, logs, pieces, longest)
    return out


def _long_counts(word: str, logs: np.ndarray, pieces: dict[str, int], longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of a long word and their expected uses in one language, whose logarithms are given."""
    marked = WORD_START + word
    n = len(marked)
    ids = np.array([_ids_at(marked, j, pieces, longest) for j in range(1, n + 1)], np.int32)
    # Places before the word are filled up with minus infinity: entry k of both stands for place k - longest.
    alpha, beta = np.full(n + longest + 1, -np.inf), np.full(n + longest + 1, -np.inf)
    alpha[longest] = beta[n + longest] = 0.0
    for j in range(1, n + 1):
        alpha[j + longest] = np.logaddexp.reduce(alpha[j:j + longest] + logs[ids[j - 1]])
    for j in range(n, 0, -1):
        beta[j:j + longest] = np.logaddexp(beta[j:j + longest], logs[ids[j - 1]] + beta[j + longest])
    starts = np.arange(n)[:, None] + np.arange(1, longest + 1)  # entries of the places at which the pieces begin
    uses = np.exp(alpha[starts] + logs[ids] + beta[longest + 1:, None] - alpha[-1])
    used = ids >= 0
    return ids[used], uses[used]


def expected_counts(langs: np.ndarray, words: list[str], counts: np.ndarray, table: np.ndarray, pieces, longest) -> np.ndarray:
    """Expected uses of each piece in each language, over all segmentations of the words, by a forward and a backward pass."""
    total = np.zeros_like(table)
    where: dict[int, list[int]] = {}
    limit = longest_product(table)
    with np.errstate(divide="ignore"):
        logs = np.log(table)
    for k, w in enumerate(words):
        if len(w) > limit:
            ids, uses = _long_counts(w, logs[:, langs[k]], pieces, longest)
            np.add.at(total, (ids, langs[k]), counts[k] * uses)
        else:
            where.setdefault(len(w), []).append(k)
    for rows in where.values():
        spans, at = lattice([words[k] for k in rows], pieces, longest)
        lang = langs[rows]
        prob = lambda ids: table[ids, lang]
        alpha, n = forward(spans, at, prob), spans[-1][1]
        beta: list = [0.0] * n + [1.0]
        for k in range(len(spans) - 1, -1, -1):
            i, j = spans[k]
            beta[i] = beta[i] + prob(at[:, k]) * beta[j]
        share = counts[rows] / alpha[n]
        for k, (i, j) in enumerate(spans):
            np.add.at(total, (at[:, k], lang), share * alpha[i] * prob(at[:, k]) * beta[j])
    return total


class LanguageModel:
    """Languages and, for each piece of the vocabulary, its probability in each of them."""

    def __init__(self, languages: list[str], table: np.ndarray, path: str):
        self.languages, self.table, self.path = languages, table, path


def _uniform(n: int, languages: int) -> np.ndarray:
    return np.vstack([np.full((n + 1, languages), 1 / (n + 1)), np.zeros((1, languages))])


def fit(labelled: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang",
        per_language: int = SAMPLE_PER_LANGUAGE, rounds: int = ROUNDS, vocabulary: str = VOCABULARY) -> LanguageModel:
    """Learn from about ``per_language`` documents of each language (all, if it has fewer); repeated rows count once.

    Rows without a text or a language teach nothing. The words are counted by Spark, the expected counts are taken over
    partitions of distinct words and summed; the driver only sees as many numbers as vocabulary times languages.
    """
    path = tokenizer_path(vocabulary)
    pieces, longest = load_pieces(path)
    n = pieces[""]
    rows = labelled.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")) \
        .filter("text is not null and lang is not null")
    # The share to take follows from a language's size: no language is ever gathered to be ranked.
    sizes = rows.groupBy("lang").agg(F.count("*").alias("of"))
    chance = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    if sizes.limit(MANY + 1).count() <= MANY:  # else the texts would be dealt by language
        sizes = F.broadcast(sizes)
    sample = rows.join(sizes, "lang").filter(chance < F.lit(float(per_language)) / F.col("of")).select("id", "text", "lang").distinct()
    explode = arrow_map(sample.select("lang", "text"),
                        lambda ls, ts: list(zip(*((l, w) for l, t in zip(ls, ts) for w in words_of(t)))) or [[], []], "lang string, word string")
    words = stored(explode.groupBy("lang", "word").agg(F.count("*").alias("n")), "language-words")
    languages = sorted(r.lang for r in words.select("lang").distinct().collect())
    table = _uniform(n, len(languages))
    if not languages:
        return LanguageModel([], table, path)
    for _ in range(rounds):
        shared = words.sparkSession.sparkContext.broadcast((languages, table))

        def expect(batches, shared=shared):
            own, longest = load_pieces(path)
            names, now = shared.value
            place = {x: k for k, x in enumerate(names)}
            total = np.zeros_like(now)
            for b in batches:
                total += expected_counts(np.array([place[x] for x in b["lang"]]), list(b["word"]), b["n"].to_numpy(float), now, own, longest)
            at = np.nonzero(total)
            yield pd.DataFrame({"piece": at[0], "lang": at[1], "expected": total[at]})

        counted = words.mapInPandas(expect, "piece long, lang long, expected double") \
            .groupBy("piece", "lang").agg(F.sum("expected").alias("expected")).toPandas()
        counts = np.full((n + 1, len(languages)), SMOOTHING)
        counts[counted["piece"], counted["lang"]] += counted["expected"]
        table = np.vstack([counts / counts.sum(axis=0), np.zeros((1, len(languages)))])
    return LanguageModel(languages, table, path)


_known: dict[str, int] = {}
_values = [np.empty((0, 0))]
_owner = [None]
_letters = [0]


def _forget() -> None:
    _known.clear()
    _owner[0], _values[0], _letters[0] = None, np.empty((0, 0)), 0


def _scores(texts: list, model_id: int, model: LanguageModel) -> tuple[list[str], list[float]]:
    """Language and posterior probability (equal priors) of each text."""
    pieces, longest = load_pieces(model.path)
    split = [words_of(t) for t in texts]
    if _owner[0] != model_id or len(_known) > REMEMBERED or _letters[0] > 10 * REMEMBERED:
        _forget()
        _owner[0], _values[0] = model_id, np.empty((0, len(model.languages)))
    new = list({w for ws in split for w in ws if w not in _known})
    if new:
        _values[0] = np.vstack([_values[0], log_likelihoods(new, model.table, pieces, longest)])
        _known.update(zip(new, range(len(_known), len(_known) + len(new))))
        _letters[0] += sum(map(len, new))
    langs, scores, place = [], [], _known.__getitem__
    for ws in split:
        if not model.languages or not any(c.isalpha() for w in ws for c in w):  # figures like "½" are no letters
            langs.append(UNDETERMINED)
            scores.append(0.0)
            continue
        total = _values[0][np.fromiter(map(place, ws), np.int64, len(ws))].sum(axis=0)
        best = int(total.argmax())
        langs.append(model.languages[best])
        scores.append(float(1 / np.exp(total - total[best]).sum()))
    return langs, scores


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its posterior probability; every row is kept, and only ``text`` is looked at.

    A null text, or one without letters, is ``und`` with score 0; so is every text if no language was learned. Ties go to
    the language that sorts first. All columns pass through; the two new ones replace columns of their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    model_id = shared._jbroadcast.id() if hasattr(shared, "_jbroadcast") and shared._jbroadcast else id(model)
    guess = fresh("guess", docs)

    @F.pandas_udf("lang string, score double")
    def tell(texts: pd.Series) -> pd.DataFrame:
        hold_alone("language_id", _forget)
        langs, scores = [], []
        for at in range(0, len(texts), ROWS):  # the words of a whole batch would be many times its size
            some, sure = _scores(texts.iloc[at:at + ROWS].tolist(), model_id, shared.value)
            langs += some
            scores += sure
        return pd.DataFrame({"lang": langs, "score": scores})

    keep = [c for c in docs.columns if c.lower() not in (lang_out.lower(), score_out.lower())]
    return docs.withColumn(guess, tell(F.col(f"`{text}`"))).select(
        *(f"`{c}`" for c in keep), F.col(f"{guess}.lang").alias(lang_out), F.col(f"{guess}.score").alias(score_out))


def held_out(id_col: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 1 when divided by 3; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 3 == 1, F.lit(False))
