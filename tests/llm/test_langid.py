import random

import numpy as np
import pyarrow as pa

from batchloom.llm import langid

VOWELS = {"aa": "the of and in that is was".split(), "bb": "der die und von mit das ist".split(), "cc": "le la et de en un que".split()}


def rows(n=240):
    rng = random.Random(1)
    out = []
    for i in range(n):
        lang = rng.choice(list(VOWELS))
        stems = VOWELS[lang]
        words = [rng.choice(stems) + rng.choice(["", "", rng.choice(stems)]) for _ in range(rng.randrange(20, 80))]
        out.append((i, " ".join(words).capitalize() + ".", lang))
    return out


def model_of(spark, data):
    return langid.fit(spark.createDataFrame(data, "doc_id long, text string, lang string"), "text", "lang", "doc_id")


def test_probabilities_sum_to_one(spark):
    """Over all letters that training has seen, the end of the word and a new letter, after any context."""
    model = model_of(spark, rows())
    letters = sorted({c for _, t, _ in rows() for c in t.lower() if c.isalpha()})
    for prefix in ("", "t", "th", "the", "zz", "deri", "q"):
        words = [prefix + c for c in [*letters, "ж"]]
        scores, sizes = langid.letter_scores(model, pa.array(words))
        last = scores[np.cumsum(sizes) - 2]
        end = langid.letter_scores(model, pa.array([prefix or "x"]))[0][-1]
        total = np.exp(last).sum(axis=0) + (np.exp(end) if prefix else 0)
        # Nothing follows the start of a word but letters: its end has what smoothing leaves.
        assert np.all(np.abs(total - 1) < (1e-6 if prefix else 0.05)), (prefix, total)


def test_held_out_rows_and_odd_texts(spark):
    data = rows()
    model = model_of(spark, data[:160])
    odd = [(900, None, "x"), (901, "", "x"), (902, "12 !! 34", "x"), (903, "the", "x"), (None, "der die und", None), (904, "xq zzjw qqk vvx " * 40, "x")]
    test = spark.createDataFrame([*data[160:], *odd, data[170]], "doc_id long, text string, score2 string")
    out = langid.identify(test, "doc_id", "text", model, keep=("score2",)).collect()
    assert len(out) == len(data[160:]) + len(odd) + 1
    truth = {d: lang for d, _, lang in data}
    own = [r for r in out if r.doc_id is not None and r.doc_id < 900]
    assert all(r.lang_pred == truth[r.doc_id] and not r.rejected and 0.5 < r.score <= 1 for r in own)
    by = {r.doc_id: r for r in out}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 and by[i].rejected for i in (900, 901, 902))
    assert by[903].lang_pred == "aa" and by[None].lang_pred == "bb" and not by[903].rejected
    assert by[904].rejected and by[904].lang_pred in VOWELS


def test_nothing_to_learn_from(spark):
    model = model_of(spark, [(1, "abc", None), (2, None, "aa")])
    df = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    row = langid.identify(df, "doc_id", "text", model).collect()[0]
    assert row.lang_pred == "und" and row.rejected
    assert langid.identify(df.limit(0), "doc_id", "text", model).count() == 0


def plain_probability(counts, letters, gram):
    """Interpolated Kneser-Ney of the last letter of ``gram`` by definition, from counts of words' letters."""

    def times(g):
        # Grams of the longest order, and those that begin a word, count as often as they occur; others by what precedes them.
        if len(g) == langid.ORDER or (len(g) > 1 and g[0] == " "):
            return counts[len(g)].get(g, 0)
        return len({h for h in counts[len(g) + 1] if h[1:] == g})

    def grams_of(order):
        out = {g for g in counts[order] if order == langid.ORDER or (order > 1 and g[0] == " ")}
        return out | ({h[1:] for h in counts[order + 1]} if order < langid.ORDER else set())

    order = len(gram)
    if order == 0:
        return 1 / letters
    here = {g: times(g) for g in grams_of(order)}
    ones, twos = (sum(1 for c in here.values() if c == k) for k in (1, 2))
    discount = ones / (ones + 2 * twos) if ones and twos else 0.5
    after = {g: c for g, c in here.items() if g[:-1] == gram[:-1]}
    below = plain_probability(counts, letters, gram[1:])
    if not after:
        return below
    total = sum(after.values())
    return max(after.get(gram, 0) - discount, 0) / total + discount * len(after) / total * below


def test_against_kneser_ney_by_definition(spark):
    data = [(i, t, "aa") for i, t in enumerate(["the then that", "a that hat the", "an ant than the hen", "tea eat heat"])]
    model = langid._train(spark.createDataFrame(data, "doc_id long, text string, lang string"), "text", "lang")
    counts = [{} for _ in range(langid.ORDER + 2)]
    for _, text, _ in data:
        for word in text.split():
            word = f" {word} "
            for order in range(1, langid.ORDER + 1):
                for end in range(max(2, order), len(word) + 1):
                    gram = word[end - order : end]
                    counts[order][gram] = counts[order].get(gram, 0) + 1
    letters = 1 + len({c for c in " ".join(t for _, t, _ in data)})
    for word in ("the", "that", "hat", "eaten", "zebra", "x", "nnn", "heathen"):
        scores, _ = langid.letter_scores(model, pa.array([word]))
        padded = f" {word} "
        want = [np.log(plain_probability(counts, letters, padded[max(0, i - langid.ORDER + 1) : i + 1])) for i in range(1, len(padded))]
        assert np.allclose(scores[:, 0], want, atol=1e-9), word


def test_a_small_language_by_itself(spark):
    """It is learned from all its documents, and does not change what other languages are calibrated on."""
    data = rows(400)
    few = [(5000 + i, "xul zor quib xulzor quibxul zorzor", "zz") for i in range(4)]
    alone, with_few = model_of(spark, data), model_of(spark, data + few)
    assert with_few.languages == [*alone.languages, "zz"]
    assert np.allclose(alone.mean, with_few.mean[:-1], atol=0.02) and np.allclose(alone.spread, with_few.spread[:-1], atol=0.02)
    one = model_of(spark, data + few[:1])
    for model in (with_few, one):
        df = spark.createDataFrame([(1, "zor quib xulzor zorzor xul"), (2, "the of and that was inand")], "doc_id long, text string")
        assert [r.lang_pred for r in langid.identify(df, "doc_id", "text", model).orderBy("doc_id").collect()] == ["zz", "aa"]
