import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from batchloom.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TEXTS = [
    None, "", "nothing here", "mail me a.b@c.com.x or a@b c%d@e.f, a@b.c%d@e.f. a@@b.c é😀 ü@x.de", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 007.0.00.0255 1.2.3",
    "card 4111 1111 1111 1111 x 4111111111111112 4111-1111-1111-1111-1 12 34", "call +1 (017) 555-7713, +49-30-1234567 ( +12 ++441234567890 +1 2 3",
    "contact: john.doe (at) mail (dot) com or call (555) 123-4567 now", "My SSN: 123-45-6780. iban GB82 WEST 1234 5698 7654 32 ok",
    "Dear Mr. John Smith, Mary Jones wrote; version 12.34.56 on 2020-01-12", "we met at home. The end, look at that.",
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in value.split(".")),
        "card": lambda: 13 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 9 <= len(digits) <= 15,
    }[kind]()


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if holds(k, m[0])]


def texts_of(n, seed=5):
    rng = random.Random(seed)
    bits = ["a", "b.c", "@", "@x.de", ".", "-", "+", "+1", " ", "(", ")", "12", "4111", "1111", "192.168.", "0.1", "255", "é", "😀", "\n", "%", "5", "John Smith", " at ", "dot"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(n)]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, t int")


def test_base_spans_against_re(spark):
    texts = [*TEXTS, *texts_of(1500)]
    out = pii.find(frame(spark, [*texts, texts[3]]), "text", ("doc_id",))
    assert out.columns == ["doc_id", "spans"]
    rows = {r.doc_id: [(s.kind, s.start, s.stop) for s in r.spans if s.base] for r in out.collect()}
    assert rows == {i: brute(t) for i, t in enumerate([*texts, texts[3]])}


def test_long_runs_and_many_matches(spark):
    texts = ["x" * 300_000 + "@" + "a." * 100_000 + "b", "1" * 300_000, "+" + " 1" * 200_000, "a." * 200_000, "7 a@b.cd " * 4000, "-" * 200_000 + "A" * 200_000]
    rows = {r.doc_id: [s for s in r.spans if s.base] for r in pii.find(frame(spark, texts), "text", ("doc_id",)).collect()}
    assert [(s.kind, s.start, s.stop) for s in rows[0]] == [("email", 0, 500_002)]
    assert rows[1] == rows[2] == rows[3] == rows[5] == []
    assert [s.start for s in rows[4]] == [9 * i + 2 for i in range(4000)]


def added(spark, texts):
    rows = pii.find(frame(spark, texts), "text", ("doc_id",)).collect()
    return {r.doc_id: [(s.kind, (texts[r.doc_id] or "")[s.start : s.stop]) for s in r.spans if not s.base] for r in rows}


def test_added_spans(spark):
    found = added(spark, TEXTS)
    assert found[7] == [("mail", "john.doe (at) mail (dot) com"), ("line", "(555) 123-4567")]
    assert found[8] == [("national", "123-45-6780"), ("iban", "GB82 WEST 1234 5698 7654 32")]
    assert found[9] == [("person", "Mr. John Smith"), ("person", "Mary Jones")]
    assert all(not found[i] for i in (0, 1, 2, 3, 4, 5, 6, 10))


def test_phone_number_before_another_number(spark):
    texts = [f"so +1 (826) 555-{n} 190.137.2.{n % 200} end" for n in range(4000, 4020)]
    assert not any(k == "phone" for t in texts for k, _, _ in brute(t))
    assert added(spark, texts) == {i: [("plus", t[3:20])] for i, t in enumerate(texts)}


def test_failed_matches_need_other_evidence(spark):
    texts = [f"credit card: 4111 1111 1111 {n}" for n in range(1000, 1100)] + [f"serial {n}123 4567 8901 234" for n in range(1000, 1100)]
    rows = {r.doc_id: r.spans for r in pii.find(frame(spark, texts), "text", ("doc_id",)).collect()}
    luhn_ok = {i for i, t in enumerate(texts) if brute(t)}
    assert {i for i, s in rows.items() if any(x.base for x in s)} == luhn_ok
    assert all(len(rows[i]) == 1 for i in luhn_ok) and not any(rows[i] for i in range(100, 200) if i not in luhn_ok)
    assert min(rows[i][0].probability for i in luhn_ok if i < 100) > pii.THRESHOLD


def plain_em(rows, rounds):
    """Expectation maximisation candidate by candidate: probability of each."""
    prior = pii.BELIEF_PRIOR[0] / sum(pii.BELIEF_PRIOR)
    n = len(pii.LABELERS)
    says = [{y: {v: pii.believed(j)[y][v + 1] / sum(pii.believed(j)[y]) for v in (-1, 0, 1)} for y in (0, 1)} for j in range(n)]

    def chance(vote):
        a, b = prior, 1 - prior
        for j, v in enumerate(vote):
            a, b = a * says[j][1][v], b * says[j][0][v]
        return a / (a + b)

    for _ in range(rounds):
        p = [chance(v) for v in rows]
        says = [
            {
                y: {
                    v: (pii.believed(j)[y][v + 1] + sum(q if y else 1 - q for q, vote in zip(p, rows) if vote[j] == v))
                    / (sum(pii.believed(j)[y]) + sum(q if y else 1 - q for q in p))
                    for v in (-1, 0, 1)
                }
                for y in (0, 1)
            }
            for j in range(n)
        ]
        prior = (pii.BELIEF_PRIOR[0] + sum(p)) / (sum(pii.BELIEF_PRIOR) + len(p))
    return [chance(v) for v in rows]


def planted(n, seed=3):
    """Texts with true and false candidates of two kinds, cues right nine times in ten."""
    rng = random.Random(seed)
    texts, truth = [], []
    for _ in range(n):
        real = rng.random() < 0.5
        cue = real == (rng.random() < 0.9)
        number = f"{rng.randrange(200, 999)}-{rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}" if real else f"{rng.randrange(1, 60)}0.{rng.randrange(10, 99)}.{rng.randrange(10, 99)}"
        texts.append(f"filler {rng.choice(['please call', 'phone']) if cue else rng.choice(['see version', 'order'])} {number} more")
        truth.append(real)
    return texts, truth


def test_expectation_maximisation_and_classifier(spark):
    texts, truth = planted(400)
    found = pii.candidates(frame(spark, texts), "text", ("doc_id",)).withColumn("candidates", F.filter("candidates", lambda c: c["kind"] == "line")).cache()
    model = pii.fit(found)
    rows = sorted((r.doc_id, r.c) for r in found.select("doc_id", F.explode("candidates").alias("c")).collect())
    assert len(rows) == 400 and {c.kind for _, c in rows} == {"line"}
    chance = plain_em([tuple(c.votes) for _, c in rows], pii.ROUNDS)
    got = {r.doc_id: r.p for r in found.select("doc_id", pii._probability(model, F.col("candidates")[0]).alias("p")).collect()}
    assert all(got[d] == pytest.approx(p, abs=1e-9) for (d, _), p in zip(rows, chance))
    # The classifier from the probabilities alone, feature by feature.
    yes, no = Counter(), Counter()
    for (_, c), p in zip(rows, chance):
        for f in c.features:
            yes[f] += p
            no[f] += 1 - p
    a, b = pii.BELIEF_PRIOR[0] + sum(chance), pii.BELIEF_PRIOR[1] + 400 - sum(chance)
    odds = [math.log(a / b) + sum(math.log((yes[f] + 0.5) / (a + 1)) - math.log((no[f] + 0.5) / (b + 1)) for f in c.features) for _, c in rows]
    belief = {r.doc_id: r.p for r in found.select("doc_id", pii.belief(model, F.col("candidates")[0]).alias("p")).collect()}
    assert all(belief[d] == pytest.approx(1 / (1 + math.exp(-o)), abs=1e-6) for (d, _), o in zip(rows, odds))
    assert sum((belief[d] >= pii.THRESHOLD) == truth[d] for d, _ in rows) >= 390


def test_empty_table_null_ids_and_plan(spark):
    df = spark.createDataFrame([], "doc_id long, text string, spans string")
    assert pii.find(df, "text", ("doc_id",)).count() == 0
    df = spark.createDataFrame([(None, "a@b.cd", "x"), (None, None, "y"), (1, "a@b.cd", "z"), (1, "a@b.cd", "z")], df.schema)
    out = pii.find(df, "text", ("doc_id",))
    assert sorted((str(r.doc_id), len(r.spans)) for r in out.collect()) == [("1", 1), ("1", 1), ("None", 0), ("None", 1)]
    for plan in (out, pii.candidates(df, "text", ("doc_id",))):
        text = plan._jdf.queryExecution().toString()
        assert "Python" not in text and "Arrow" not in text and "Exchange" not in text
    with pytest.raises(ValueError, match="spans"):
        pii.find(df, "text", ("spans",))
