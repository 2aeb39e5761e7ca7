"""Language identification with interpolated Kneser-Ney character models.

One model per language gives the probability of each letter of a word after the letters before it; a word
begins with a space and ends with one, and the context does not reach over words. Counts of the longest
n-grams are made by Spark over a bounded sample of labelled rows; the model itself (its size is that of
the distinct n-grams of the sample) is put into sorted arrays of 64-bit hashes with the log probability
of every language beside each hash, and broadcast; it grows with the number of languages times the sample of each. Documents are scored where they are read: the distinct
words of a slice once, each document as the sum over its words. There is no shuffle of texts.

A document goes to the language of the lowest cross-entropy per letter. It is rejected if that entropy
is above what the language's own calibration documents have, by more than ``reject_sigma`` standard
deviations for a text of that length and by at least ``least_excess`` nats a letter.

Null texts and texts without a letter give ``und`` with score 0 and are rejected. Ties go to the language
that is first in the alphabet.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.llm.common import map_texts, mix64, pick, sample_rows, slices, starts_of, sums_of

UNKNOWN = "und"
#: Longest n-gram, in characters.
ORDER = 4
#: Labelled documents of each language that the counts are made from, and the entropies calibrated on.
SAMPLE, CALIBRATION = 3000, 1000
#: A language with fewer documents to calibrate on is small: it is trained on all and calibrated by halves.
HELD = 20
#: How far above its language's usual entropy a document is rejected: in standard deviations, and in nats.
REJECT_SIGMA, LEAST_EXCESS = 8.0, 1.0
#: Words beyond which a worker forgets the word scores that it has.
CACHE_WORDS = 300_000


@dataclass
class LanguageModel:
    """Sorted n-gram hashes for each order with log probabilities, and back-off weights of contexts."""

    languages: list[str]
    hashes: list[np.ndarray]
    log_p: list[np.ndarray]
    contexts: list[np.ndarray]
    log_back: list[np.ndarray]
    log_unseen: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    noise: np.ndarray


def letter_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Lower-case words of letters: a code for each, the distinct ones, and how many each text has."""
    plain = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}]+", " ")
    parts = pc.split_pattern(plain, " ")
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = parts.flatten()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    counts = sums_of(full.astype(np.int64), counts)
    coded = flat.filter(pa.array(full)).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary, counts


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, each between two spaces, and the length of each."""
    text = " ".join(words.to_pylist())
    points = np.frombuffer(f" {text} ".encode("utf-32-le"), dtype=np.uint32)
    # One space between words is the end of one and the start of the next: double them.
    twice = np.ones(len(points), dtype=np.int64)
    twice[1:-1][points[1:-1] == 32] = 2
    return np.repeat(points, twice).astype(np.uint64), pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 2


def _grams(points: np.ndarray, order: int) -> np.ndarray:
    """Hash of the ``order`` characters that end at each position; the first ones reach too far back."""
    value = np.full(len(points), order, dtype=np.uint64)
    for back in range(order - 1, -1, -1):
        shifted = points if not back else np.concatenate([np.zeros(back, np.uint64), points[:-back]])[: len(points)]
        value = mix64(value * np.uint64(0x100000001B3) + shifted)
    return value


def _depth(lengths: np.ndarray) -> np.ndarray:
    """How many characters of the word stand before each position."""
    return np.arange(int(lengths.sum())) - np.repeat(starts_of(lengths), lengths)


def _count_grams(df: DataFrame, text: str, lang: str) -> pa.Table:
    """Counts of the longest n-grams in each language, as (lang, points of the n-gram, count)."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            codes, words, counts = letter_words(batch.column(0))
            langs = batch.column(1).dictionary_encode()
            names, of = langs.dictionary, langs.indices.to_numpy().astype(np.int64)
            # Occurrences of each word in each language, then of each n-gram.
            pair, times = np.unique(np.repeat(of, counts) * max(1, len(words)) + codes, return_counts=True)
            if not len(pair):
                return pa.RecordBatch.from_pydict({"lang": pa.array([], pa.string()), "gram": pa.array([], pa.string()), "n": pa.array([], pa.int64())})
            points, lengths = _letters(words)
            text_of = "".join(map(chr, points.tolist()))
            at, word = starts_of(lengths), pair % len(words)
            rows: dict[tuple[int, str], int] = {}
            for k, w, n in zip((pair // len(words)).tolist(), word.tolist(), times.tolist()):
                start, stop = int(at[w]), int(at[w] + lengths[w])
                for end in range(start + 2, stop + 1):
                    gram = k, text_of[max(start, end - ORDER) : end]
                    rows[gram] = rows.get(gram, 0) + n
            lang_index = pa.array([k for k, _ in rows], pa.int64())
            return pa.RecordBatch.from_pydict(
                {"lang": names.take(lang_index), "gram": pa.array([g for _, g in rows], pa.string()), "n": pa.array(list(rows.values()), pa.int64())}
            )

        return work

    counted = map_texts(pick(df, text, lang), text, make, "lang string, gram string, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()


def _kneser_ney(grams: dict[str, int], letters: int) -> tuple[list[dict[str, float]], list[dict[str, float]], float]:
    """Interpolated probabilities by order, back-off weights of contexts, probability of a new letter.

    ``grams`` holds n-grams of the longest order, and shorter ones that begin a word.
    """
    counts: list[dict[str, int]] = [{} for _ in range(ORDER + 1)]
    for gram, n in grams.items():
        # A gram that begins its word has its true count at its own order.
        if len(gram) == ORDER or gram[0] == " ":
            counts[len(gram)][gram] = counts[len(gram)].get(gram, 0) + n
    for order in range(ORDER, 1, -1):
        for gram in counts[order]:
            if gram[1:]:
                short = gram[1:]
                counts[order - 1][short] = counts[order - 1].get(short, 0) + 1
    p: list[dict[str, float]] = [{} for _ in range(ORDER + 1)]
    back: list[dict[str, float]] = [{} for _ in range(ORDER + 1)]
    lower_unseen = 1.0 / letters
    for order in range(1, ORDER + 1):
        ones = sum(c == 1 for c in counts[order].values())
        twos = sum(c == 2 for c in counts[order].values())
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        total: dict[str, int] = {}
        kinds: dict[str, int] = {}
        for gram, c in counts[order].items():
            total[gram[:-1]] = total.get(gram[:-1], 0) + c
            kinds[gram[:-1]] = kinds.get(gram[:-1], 0) + 1
        for context, t in total.items():
            back[order - 1][context] = discount * kinds[context] / t
        for gram, c in counts[order].items():
            context = gram[:-1]
            below = p[order - 1].get(gram[1:], lower_unseen) if order > 1 else 1.0 / letters
            p[order][gram] = max(c - discount, 0) / total[context] + back[order - 1][context] * below
        if order == 1:
            lower_unseen = back[0].get("", 1.0) / letters
    return p, back, lower_unseen


def fit(df: DataFrame, text: str, lang: str, key: str, sample: int = SAMPLE, calibration: int = CALIBRATION) -> LanguageModel:
    """Train on rows with a language: about ``sample`` documents of each, chosen by a hash of ``key``.

    The entropies of each language are calibrated on about ``calibration`` documents that the counts have not seen.
    A language that has fewer than HELD of them is counted on all its documents, and calibrated on either half of
    them by counts of the other half; one whose documents are all in one half, on what its counts have seen.
    """
    known = pick(df, key, text, lang).where(F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull())
    chosen = known.where(sample_rows(known, key, lang, sample + calibration))
    side = F.pmod(F.xxhash64(F.lit("side"), F.col(f"`{key}`")), F.lit(sample + calibration)) < calibration
    counted = chosen.groupBy(F.col(f"`{lang}`").alias("l")).agg(F.count_if(side).alias("n")).collect()
    little = F.col(f"`{lang}`").isin([r["l"] for r in counted if r["n"] < HELD])
    model = _train(chosen.where(~side | little), text, lang)
    found = _measured(model, chosen.where(side & ~little), text, lang)
    if any(r["n"] < HELD for r in counted):
        half = F.pmod(F.xxhash64(F.lit("half"), F.col(f"`{key}`")), F.lit(2))
        for fold in (0, 1):
            others = _train(chosen.where(little & (half != fold)), text, lang)
            for name, values in _measured(others, chosen.where(little & (half == fold)), text, lang).items():
                found.setdefault(name, []).extend(values)
    missing = [name for name in model.languages if name not in found]
    if missing:
        found |= _measured(model, chosen.where(F.col(f"`{lang}`").isin(missing)), text, lang)
    return _calibrate(model, found)


def _train(chosen: DataFrame, text: str, lang: str) -> LanguageModel:
    """Models of all languages in ``chosen``, not calibrated."""
    table = _count_grams(chosen, text, lang)
    grams: dict[str, dict[str, int]] = {}
    for name, gram, n in zip(*(table.column(i).to_pylist() for i in range(3))):
        grams.setdefault(name, {})[gram] = n
    languages = sorted(grams)
    letters = 1 + len({c for g in grams.values() for gram in g for c in gram})
    models = [_kneser_ney(grams[name], letters) for name in languages]
    hashes, log_p, contexts, log_back = [], [], [], []
    for order in range(1, ORDER + 1):
        hashed, value = _merge_tables([m[0][order] for m in models], order, 0.0)
        hashes.append(hashed)
        log_p.append(value)
        hashed, value = _merge_tables([m[1][order - 1] for m in models], order - 1, 1.0)
        contexts.append(hashed)
        log_back.append(value)
    unseen = np.log([m[2] for m in models]) if models else np.zeros(0)
    k = len(languages)
    model = LanguageModel(languages, hashes, log_p, contexts, log_back, np.asarray(unseen), np.zeros(k), np.zeros(k), np.ones(k))
    _resolve(model)
    return model


def _merge_tables(tables: list[dict[str, float]], order: int, missing: float) -> tuple[np.ndarray, np.ndarray]:
    """One sorted hash array for all languages; a language without the entry has ``missing``."""
    keys = sorted(set().union(*tables)) if tables else []
    if not keys:
        return np.zeros(0, np.uint64), np.zeros((0, len(tables)))
    if order:
        points = np.frombuffer("".join(keys).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        hashed = _grams(points, order)[order - 1 :: order]
    else:
        hashed = np.zeros(1, np.uint64)
    values = np.array([[t.get(key, missing) for t in tables] for key in keys])
    at = np.argsort(hashed)
    return hashed[at], values[at]


def _resolve(model: LanguageModel) -> None:
    """Probabilities to logarithms; nan marks what a language has to look up at the next lower order."""
    with np.errstate(divide="ignore"):
        model.log_p = [np.where(v > 0, np.log(np.maximum(v, 1e-300)), np.nan) for v in model.log_p]
        model.log_back = [np.log(v) for v in model.log_back]


def _look_up(hashes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(hashes):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    slot = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
    return slot, hashes[slot] == wanted


def letter_scores(model: LanguageModel, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of every letter in every language, and how many each word has (its end is one)."""
    points, lengths = _letters(words)
    depth = _depth(lengths)
    spot = np.flatnonzero(depth > 0)
    total = np.zeros((len(spot), len(model.languages)))
    open_ = np.ones(total.shape, dtype=bool)
    for order in range(ORDER, 0, -1):
        # A position with fewer characters before it starts at a lower order.
        fits = depth[spot] >= order - 1
        slot, known = _look_up(model.hashes[order - 1], _grams(points, order)[spot])
        value = np.full(total.shape, np.nan)
        hit = known & fits
        value[hit] = model.log_p[order - 1][slot[hit]]
        take = open_ & ~np.isnan(value)
        total[take] += value[take]
        open_ &= ~take
        if not open_.any():
            break
        context = _grams(points, order - 1)[spot - 1] if order > 1 else np.zeros(len(spot), np.uint64)
        slot, known = _look_up(model.contexts[order - 1], context)
        hit = known & fits
        weight = np.zeros(total.shape)
        weight[hit] = model.log_back[order - 1][slot[hit]]
        total[open_] += weight[open_] if order > 1 else 0.0
    total += np.where(open_, model.log_unseen, 0.0)
    return total, lengths - 1


class Scorer:
    """Sums of word scores for documents in one worker."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.place: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.languages)))
        self.sizes = np.zeros(0, np.int64)

    def _places(self, words: pa.Array) -> np.ndarray:
        if len(self.place) > CACHE_WORDS:
            self.place, self.scores, self.sizes = {}, self.scores[:0], self.sizes[:0]
        strings = words.to_pylist()
        new = [w for w in strings if w not in self.place]
        if new:
            letters, sizes = letter_scores(self.model, pa.array(new))
            scores = sums_of(letters, sizes)
            self.place.update(zip(new, range(len(self.sizes), len(self.sizes) + len(new))))
            self.scores, self.sizes = np.concatenate([self.scores, scores]), np.concatenate([self.sizes, sizes])
        return np.fromiter((self.place[w] for w in strings), np.int64, len(strings))

    def documents(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per letter in every language (nats), and the number of letters."""
        codes, words, counts = letter_words(texts)
        place = self._places(words)[codes] if len(words) else codes
        letters = sums_of(self.sizes[place], counts)
        return -sums_of(self.scores[place], counts) / np.maximum(letters, 1)[:, None], letters


def _measured(model: LanguageModel, df: DataFrame, text: str, lang: str) -> dict[str, list[tuple[float, int]]]:
    """Of the documents of each language: cross-entropy in it, and letters."""
    shared = df.sparkSession.sparkContext.broadcast(vars(model))

    def make():
        scorer = Scorer(LanguageModel(**shared.value))

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            entropy, letters = scorer.documents(batch.column(0))
            names = scorer.model.languages
            own = [names.index(x) if x in names else -1 for x in batch.column(1).to_pylist()]
            value = [float(entropy[i, k]) if k >= 0 else None for i, k in enumerate(own)]
            return pa.RecordBatch.from_arrays([batch.column(1), pa.array(value, pa.float64()), pa.array(letters, pa.int64())], names=["lang", "h", "n"])

        return work

    rows = map_texts(pick(df, text, lang), text, make, "lang string, h double, n long").where("n > 0 AND h IS NOT NULL").toArrow()
    out: dict[str, list[tuple[float, int]]] = {}
    for name, h, n in zip(*(rows.column(i).to_pylist() for i in range(3))):
        out.setdefault(name, []).append((h, n))
    return out


def _calibrate(model: LanguageModel, found: dict[str, list[tuple[float, int]]]) -> LanguageModel:
    """Mean entropy of each language's documents, its spread among long ones and its noise per letter.

    The three are robust (medians), so that a few wrong labels do not move them.
    """
    for k, name in enumerate(model.languages):
        h, n = (np.array(x, dtype=float) for x in zip(*found[name]))
        model.mean[k] = np.median(h)
        off = np.abs(h - model.mean[k])
        long = n >= np.median(n)
        model.spread[k] = max(1.4826 * np.median(off[long]), 0.01)
        model.noise[k] = max(1.4826 * np.median(off * np.sqrt(n)), 1.0)
    return model


def _judge(model: LanguageModel, reject_sigma: float, least_excess: float):
    """A function of texts that gives language, score, cross-entropy and rejection."""
    scorer, k = Scorer(model), len(model.languages)
    names = np.array([*model.languages, UNKNOWN], dtype=object)

    def judge(texts: pa.Array) -> list[pa.Array]:
        entropy, letters = scorer.documents(texts)
        if k:
            best = entropy.argmin(axis=1)
            low = entropy[np.arange(len(best)), best]
            score = 1 / np.exp(8 * (low[:, None] - entropy)).sum(axis=1)
            limit = np.sqrt(model.spread[best] ** 2 + model.noise[best] ** 2 / np.maximum(letters, 1))
            rejected = low - model.mean[best] > np.maximum(reject_sigma * limit, least_excess)
        else:
            best, low, score, rejected = (np.zeros(len(letters), t) for t in (np.int64, float, float, bool))
        none = (letters == 0) | (k == 0)
        best, score, rejected = np.where(none, k, best), np.where(none, 0.0, score), rejected | none
        return [pa.array(names[best], pa.string()), pa.array(score), pa.array(low, mask=none), pa.array(rejected)]

    return judge


def keep_identified(
    df: DataFrame, text: str, model: LanguageModel, reject_sigma: float = REJECT_SIGMA, least_excess: float = LEAST_EXCESS
) -> DataFrame:
    """The rows of ``df`` that are not rejected, with their columns as they are."""
    shared = df.sparkSession.sparkContext.broadcast(vars(model))

    @F.arrow_udf("boolean")
    def accepted(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        judge = _judge(LanguageModel(**shared.value), reject_sigma, least_excess)
        for part in parts:
            batch = pa.RecordBatch.from_arrays([part], names=["t"])
            found = [judge(piece.column(0))[3].to_numpy(zero_copy_only=False) for piece in slices(batch, "t")]
            yield pa.array(~np.concatenate(found) if found else np.zeros(0, bool))

    return df.where(accepted(F.col(f"`{text}`")))


def identify(
    df: DataFrame,
    doc_id: str,
    text: str,
    model: LanguageModel,
    reject_sigma: float = REJECT_SIGMA,
    least_excess: float = LEAST_EXCESS,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Language of every text: ``doc_id``, ``keep`` columns, lang_pred, score, cross_entropy, rejected.

    A kept column of one of the last four names gives way to it.

    ``score`` is the posterior of the language for an average word count of eight letters, so that it
    does not saturate with the length of the text.
    """
    shared = df.sparkSession.sparkContext.broadcast(vars(model))

    def make():
        judge = _judge(LanguageModel(**shared.value), reject_sigma, least_excess)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            results = judge(batch.column(batch.num_columns - 1))
            return pa.RecordBatch.from_arrays([*kept, *results], names=[*batch.schema.names[:-1], *made])

        return work

    made = ("lang_pred", "score", "cross_entropy", "rejected")
    columns = [doc_id, *(c for c in keep if c != doc_id and c not in made)]
    hidden = "text to identify"
    chosen = df.select(*(F.col(f"`{c}`") for c in columns), F.col(f"`{text}`").alias(hidden))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name != hidden)
    return map_texts(chosen, hidden, make, f"{fields}, lang_pred string, score double, cross_entropy double, rejected boolean")
