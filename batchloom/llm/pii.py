"""Personal data by weak supervision, in SQL functions only.

*Base* spans come from four strict patterns (email, ip, card, phone) with a test of the value, and always stay. They are
*candidates* as well, beside matches that fail the test, and beside matches of looser patterns outside the base spans:
written-out mail addresses, phone numbers without a country code, national ids, IBANs, names of persons. Labelers vote
on every candidate: for (1), against (-1), or not at all (0). Two are regular expressions (the shape, and a check of the
value), one is a gazetteer, two read the context. Expectation maximisation over the vote patterns estimates, for each
kind, how common true spans are and how reliable every labeler is; the probabilities it gives to the candidates train
the final span classifier, a naive Bayes model over votes and traits of the span. It gives every span a probability, and
candidates that it believes are added to the base spans.

The text is read once, row by row. What is collected is a count for each vote pattern (at most kinds x 3^labelers)
and for each feature value (bounded by the code); texts and spans never leave their rows. Positions count code
points, the end exclusive. Null and empty texts have no spans. Every row of a repeated id gets its own result. An
empty table gives an empty result, and a corpus without candidates the prior beliefs as its model. Patterns use possessive
repeats and start only where a run of characters starts, so time is linear in the text, however long a run is.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom.session import materialize

# The four kinds of the contract, in its order. A match begins where a run of its first class begins or
# where the last match ended: from any later place of the run it would fail alike.
EMAIL = r"(?=[A-Za-z0-9._%+-])(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?=[0-9])(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Texts in which a pattern can match hold one of these; looking for them is cheaper.
NEEDS = {"email": ("@",), "phone": ("+",), "ip": (".",), "mail": ("(at)", "[at]", " at "), "plus": ("+",)}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

#: Characters of context before and after a candidate, as far as the last and the next one of its kind.
BEFORE, AFTER = 48, 24
LABELERS = ("shape", "check", "gazetteer", "context", "against")
#: Beliefs before any data, as counts of votes -1, 0, 1 on true and on false spans: labelers are more often right than
#: wrong, and a span that none speaks for is more often false.
BELIEF = {1: (2.0, 8.0, 16.0), 0: (10.0, 16.0, 2.0)}
#: Of the check, which true spans seldom fail.
CHECK_BELIEF = {1: (0.1, 8.0, 16.0), 0: (10.0, 16.0, 2.0)}
#: True and false candidates of a kind before any data.
BELIEF_PRIOR = (2.0, 6.0)
ROUNDS, THRESHOLD = 40, 0.8
SPAN = "struct<start:bigint,stop:bigint,value:string,before:string,after:string>"

# Gazetteers.
MAIL_ENDS = "com|org|net|edu|gov|io|info|de|fr|es|it|uk|us|ca|eu|ch|at|nl|pl|br|mx|jp|in"
COUNTRIES = "AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IS|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SE|SI|SK|SM|TR"
FIRST_NAMES = (
    "Alice|Ana|Andreas|Anna|Antonio|Carlos|Charles|Claire|Claudia|Daniel|David|Elena|Elizabeth|Emma|Francois|Hans|Isabel|James|Jean|"
    "Jennifer|Joao|John|Jose|Juan|Julia|Karl|Klaus|Laura|Linda|Lucia|Luis|Luca|Marco|Maria|Marie|Mark|Martin|Mary|Michael|Nicolas|"
    "Olivia|Patricia|Paul|Peter|Pierre|Richard|Robert|Sarah|Sofia|Sophie|Stefan|Susan|Thomas|William"
)
TITLES = r"Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Madame|Monsieur|Mme|Señora|Señor|Sra|Sr"


@dataclass(frozen=True)
class Kind:
    """A pattern of candidates and what its labelers look for, as regular expressions; an empty one abstains."""

    kind: str
    pattern: str
    shape: str
    good: str
    bad: str
    listed: str
    unlisted: str
    context: str
    against: str


CALLS = r"(?i)\b(?:call|phone|tel|telephone|mobile|cell|fax|whatsapp|telefon|téléphone|teléfono|contact)\b"
NUMBERS = r"(?i)\b(?:isbn|issn|version|order|invoice|part|page|pages|figure|section|score|ratio|date|no|number of)\b"
MAILS = r"(?i)\b(?:e-?mail|mail|contact|write|reach|courriel|correo|kontakt)\b"
CODES = r"^\+(?:1|2[07]|3[0-469]|4[0-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])"
#: The base kinds; their check is the test of the value.
STRICT = (
    Kind(
        "email",
        EMAIL,
        shape=r"^[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9]",
        good="",
        bad=r"\.\.|\.@|^\.",
        listed=rf"(?i)\.(?:{MAIL_ENDS})$",
        unlisted=r"(?i)\.(?:html?|php|js|png|jpe?g)$",
        context=MAILS,
        against=r"(?i)\b(?:package|version|regex|pattern)\b",
    ),
    Kind(
        "ip",
        IP,
        shape=r"^[1-9][0-9]{0,2}(?:\.[0-9]{1,3}){3}$",
        good="",
        bad="",
        listed="",
        unlisted=r"^(?:0|10|127|192\.168|255|2[34][0-9])\.",
        context=r"(?i)\b(?:ip|address|client|host|login|visitor|user|from)\b",
        against=r"(?i)\b(?:version|release|build|section|chapter|v|firmware)\b",
    ),
    Kind(
        "card",
        CARD,
        shape=r"^[0-9]{4}(?:[\x20-]?[0-9]{4}){3}$|^3[0-9]{3}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5}$",
        good="",
        bad="",
        listed=r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
        unlisted=r"^(?:0{4}|1{4}|9{4})",
        context=r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta|payment)\b",
        against=r"(?i)\b(?:isbn|order|invoice|serial|tracking|id|build|barcode|ean)\b",
    ),
    Kind(
        "phone",
        PHONE,
        shape=r"^\+[1-9][0-9]{0,2}[\x20(.-]",
        good="",
        bad="",
        listed=CODES,
        unlisted=r"^\+0",
        context=CALLS,
        against=NUMBERS,
    ),
)
#: Looser kinds, sought outside the base spans.
LOOSE = (
    Kind(
        "mail",
        r"(?=[A-Za-z0-9._%+-])(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:[(\[]at[)\]]|(?<=\x20)at(?=\x20))\x20?[A-Za-z0-9-]{1,63}+"
        r"(?:(?:\.|\x20?[(\[]dot[)\]]\x20?|\x20dot\x20)[A-Za-z0-9-]{2,63}+){1,4}+",
        shape=r"[(\[](?:at|dot)[)\]]|\x20dot\x20",
        good=r"^[A-Za-z]+[._][A-Za-z]+",
        bad=r"\x20at\x20(?:www|the|https?|all|any)\b",
        listed=rf"(?i)(?:\.|dot[)\]]?)\x20?(?:{MAIL_ENDS})$",
        unlisted=r"(?i)\.(?:html?|php|pdf|jpe?g|png|txt)$",
        context=MAILS,
        against=r"(?i)\b(?:look|looking|meet|available|visit|hosted)\b",
    ),
    Kind(
        "line",
        r"(?=[(0-9])(?<![0-9A-Za-z+.,/(-])(?<!\+[0-9]{1,3}[\x20.-])\(?[0-9]{2,5}+\)?(?:[\x20./-]{1,2}[0-9]{2,4}+){2,4}+(?![0-9A-Za-z]|[.,-][0-9])",
        shape=r"^\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}$|^\(?0[0-9]",
        good=r"^(?:[^0-9]*[0-9]){9,12}[^0-9]*$",
        bad=r"\b(?:19|20)[0-9]{2}[./-][01]?[0-9][./-]|[./-](?:19|20)[0-9]{2}$|^(?:[^0-9]*[0-9]){1,7}[^0-9]*$",
        listed=r"\b555\b|^\(?0(?:1|2|3|4|5|6|7|8|9)[0-9]",
        unlisted=r"^\(?000|[.].*[/]|[/].*[.]",
        context=CALLS,
        against=NUMBERS,
    ),
    # A phone number that runs into the number after it: together they are too long for the strict kind.
    Kind(
        "plus",
        r"\+[0-9]{1,3}+[\x20.-]?\(?[0-9]{2,4}+\)?(?:[\x20.-][0-9]{3,4}+){2}+(?![0-9])",
        shape=r"^\+[1-9]",
        good=r"^(?:[^0-9]*[0-9]){9,15}[^0-9]*$",
        bad=r"^(?:[^0-9]*[0-9]){1,8}[^0-9]*$",
        listed=CODES,
        unlisted=r"^\+00",
        context=CALLS,
        against=NUMBERS,
    ),
    Kind(
        "national",
        r"(?=[0-9])(?<![0-9A-Za-z.,+-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|[.,-][0-9])",
        shape=r"^[0-8]",
        good=r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
        bad=r"^(?:000|666|9)|-00-|-0000$",
        listed="",
        unlisted=r"^(?:123-45-6789|987-65-4321|111-11-1111)$",
        context=r"(?i)\b(?:ssn|social|security|insurance|national|tax|id)\b",
        against=r"(?i)\b(?:isbn|order|invoice|part|model|serial|page)\b",
    ),
    Kind(
        "iban",
        r"(?=[A-Z]{2}[0-9]{2})(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
        shape=r"^[A-Z]{2}[0-9]{2}(?:\x20?[0-9A-Z]{4}){3,7}",
        good="",
        bad=r"^[A-Z]{2}[0-9]{2}(?:\x20?[A-Z]{4})+$",
        listed=rf"^(?:{COUNTRIES})",
        unlisted="",
        context=r"(?i)\b(?:iban|account|bank|konto|compte|cuenta|transfer)\b",
        against=r"(?i)\b(?:part|model|serial|key|token|hash|license)\b",
    ),
    Kind(
        "person",
        rf"(?=[A-Z])(?<![\p{{L}}])(?:(?:{TITLES})\.?\x20(?:\p{{Lu}}\p{{Ll}}{{1,30}}+|\p{{Lu}}\.)|(?:{FIRST_NAMES})\x20\p{{Lu}}(?:\p{{Ll}}{{1,30}}+|\.\x20\p{{Lu}}\p{{Ll}}{{1,30}}+))"
        r"(?:[\x20-]\p{Lu}\p{Ll}{1,30}+){0,2}+(?![\p{L}])",
        shape=rf"^(?:{TITLES})\b",
        good=r"\x20\p{Lu}\p{Ll}+\x20\p{Lu}\p{Ll}+$",
        bad=r"\x20(?:The|And|Of|In|Is|Was|Street|Avenue|Road|River|University|Church|Day|Monday|January|Prize|Island|County)$",
        listed=rf"(?:^|\x20)(?:{FIRST_NAMES})\b",
        unlisted=r"\b(?:Saint|San|Santa|King|Queen|Pope)\b",
        context=r"(?i)\b(?:name|signed|regards|dear|sincerely|contact|author|patient|customer|employee|born|nom|nombre|hallo)\b",
        against=r"(?i)\b(?:street|avenue|university|church|museum|award|prize|saint|chapter)\b",
    ),
)
KINDS = (*STRICT, *LOOSE)
BASE_KINDS = tuple(k.kind for k in STRICT)


def _spans(gaps: Column, found: Column) -> Column:
    """Spans of the matches ``found`` that stand between the pieces ``gaps`` of a text.

    Finished spans move to the result in blocks, so that a text of many matches isn't copied for each of them.
    """
    size = F.size(gaps)
    rows = F.arrays_zip(gaps.alias("gap"), found.alias("value"), F.slice(gaps, F.lit(2), size).alias("next"))
    none = F.array().cast(f"array<{SPAN}>")
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("part"), none.alias("done"))

    def step(state: Column, row: Column) -> Column:
        start = state["at"] + F.length(row["gap"])
        stop = start + F.length(row["value"])
        span = F.struct(
            start.alias("start"),
            stop.alias("stop"),
            row["value"].alias("value"),
            F.substring(row["gap"], -BEFORE, BEFORE).alias("before"),
            F.substring(F.coalesce(row["next"], F.lit("")), 1, AFTER).alias("after"),
        )
        full = F.size(state["part"]) >= 256
        part = F.concat(F.when(full, none).otherwise(state["part"]), F.array(span))
        done = F.when(full, F.concat(state["done"], state["part"])).otherwise(state["done"])
        more = F.struct(stop.alias("at"), part.alias("part"), done.alias("done"))
        return F.when(row["value"].isNull(), state).otherwise(more)

    return F.aggregate(rows, zero, step, lambda state: F.concat(state["done"], state["part"]))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """13 to 19 digits whose doubled sum ends in 0."""
    digits = _digits(value)
    ones = F.transform(F.split(F.reverse(digits), ""), lambda c: F.coalesce(c.cast("int"), F.lit(0)))
    parts = F.transform(ones, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    total = F.aggregate(parts, F.lit(0), lambda a, b: a + b)
    return F.when(F.length(digits).between(13, 19), total % 10 == 0).otherwise(False)


def valid(kind: str, value: Column) -> Column:
    """Does a match of a base pattern count?"""
    if kind == "ip":
        return value.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _iban_rest(value: Column) -> Column:
    """The number that an IBAN stands for, modulo 97."""
    plain = F.regexp_replace(value, " ", "")
    signs = F.split(F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4)), "")
    points = F.transform(F.filter(signs, lambda c: c != ""), lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    return F.aggregate(points, F.lit(0), lambda a, d: (a * F.when(d > 9, 100).otherwise(10) + d) % 97)


def _vote(value: Column, yes: str, no: str) -> Column:
    against = value.rlike(no) if no else F.lit(False)
    return F.when(against, -1).when(value.rlike(yes) if yes else F.lit(False), 1).otherwise(0)


def votes(kind: Kind, span: Column) -> dict[str, Column]:
    """What each labeler says of a candidate: -1, 0 or 1."""
    value = span["value"]
    check = _vote(value, kind.good, kind.bad)
    if kind.kind == "iban":
        check = F.when(_iban_rest(value) == 1, 1).otherwise(-1)
    elif kind.kind in BASE_KINDS:
        check = F.when(valid(kind.kind, value) & (~value.rlike(kind.bad) if kind.bad else F.lit(True)), 1).otherwise(-1)
    return {
        "shape": _vote(value, kind.shape, ""),
        "check": check,
        "gazetteer": _vote(value, kind.listed, kind.unlisted),
        "context": _vote(span["before"], kind.context, ""),
        "against": _vote(span["before"], "", kind.against),
    }


def traits(span: Column) -> dict[str, Column]:
    """Features of a candidate beside its votes, each with few values."""
    return {
        "length": F.least(F.length(span["value"]) / 4, F.lit(12)).cast("int"),
        "digits": F.least(F.length(_digits(span["value"])) / 2, F.lit(8)).cast("int"),
        "lead": F.when(span["before"].rlike(r"[:=]\s?$"), 2).when(span["before"].rlike(r"(?:^|\n)\s*$"), 1).otherwise(0),
        "tail": F.when(span["after"].rlike(r"^\s*(?:\n|$)"), 2).when(span["after"].rlike(r"^[,.;)]"), 1).otherwise(0),
    }


def _hidden(kind: str) -> Callable[[Column], Column]:
    return lambda value: F.when(valid(kind, value), F.repeat(F.lit("\x01"), F.length(value))).otherwise(value)


def _judged(kind: Kind) -> Callable[[Column], Column]:
    """A candidate with its votes in the order of LABELERS, and votes and traits as features."""

    def judge(span: Column) -> Column:
        said = votes(kind, span)
        features = F.array(*(F.concat(F.lit(f"{name}="), v.cast("string")) for name, v in (said | traits(span)).items()))
        place = F.lit(kind.kind).alias("kind"), span["start"].alias("start"), span["stop"].alias("stop")
        base = valid(kind.kind, span["value"]) if kind.kind in BASE_KINDS else F.lit(False)
        return F.struct(*place, base.alias("base"), F.array(*said.values()).alias("votes"), features.alias("features"))

    return judge


def _split_by(df: DataFrame, text: str, name: str, kind: str, pattern: str) -> DataFrame:
    """``df`` with the pieces between matches of the kind's ``pattern`` and the matches, empty where nothing matches.

    Columns of their own: each pattern runs once over a text, however often its matches are used.
    """
    has, empty = F.col(text).rlike(pattern), F.array().cast("array<string>")
    if kind in NEEDS:
        has = reduce(lambda a, b: a | b, (F.col(text).contains(x) for x in NEEDS[kind])) & has
    gaps = F.when(has, F.split(F.col(text), pattern, -1)).otherwise(empty)
    found = F.when(has, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).otherwise(empty)
    return df.withColumns({f"{name} gaps": gaps, f"{name} found": found})


def candidates(df: DataFrame, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns and ``candidates`` by kind, then start: place, ``base`` (it stays), votes and features."""
    out = df.select(*(F.col(f"`{c}`").alias(f"kept {i}") for i, c in enumerate(keep)), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    out = out.withColumn("masked", F.col("t"))
    parts = []
    for k in STRICT:
        out = _split_by(out, "t", k.kind, k.kind, k.pattern)
        out = out.withColumn(f"spans {k.kind}", _spans(F.col(f"{k.kind} gaps"), F.col(f"{k.kind} found")))
        parts.append(F.transform(f"spans {k.kind}", _judged(k)))
        out = out.drop(f"{k.kind} gaps", f"{k.kind} found")
    # Other candidates are sought in what the base spans leave: their characters become a sign that no pattern holds. Phone
    # numbers first: they are the ones that run into others.
    for k in sorted(STRICT, key=lambda k: k.kind != "phone"):
        out = _split_by(out, "masked", "mask", k.kind, k.pattern)
        hidden = F.array_join(F.zip_with("mask gaps", F.transform("mask found", _hidden(k.kind)), lambda gap, v: F.concat(gap, F.coalesce(v, F.lit("")))), "")
        out = out.withColumn("masked", F.when(F.size("mask found") > 0, hidden).otherwise(F.col("masked")))
        out = out.drop("mask gaps", "mask found")
    for k in LOOSE:
        out = _split_by(out, "masked", k.kind, k.kind, k.pattern)
        out = out.withColumn(f"spans {k.kind}", _spans(F.col(f"{k.kind} gaps"), F.col(f"{k.kind} found")))
        parts.append(F.transform(f"spans {k.kind}", _judged(k)))
    return out.select(*(F.col(f"kept {i}").alias(c) for i, c in enumerate(keep)), F.concat(*parts).alias("candidates"))


@dataclass
class SpanModel:
    """Of every kind: the prior, what labelers say of true and false spans, and weights of the classifier."""

    prior: dict[str, float] = field(default_factory=dict)
    says: dict[tuple[str, int, int, int], float] = field(default_factory=dict)
    bias: dict[str, float] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)


def believed(labeler: int) -> dict[int, tuple[float, float, float]]:
    return CHECK_BELIEF if LABELERS[labeler] == "check" else BELIEF


def learn_labelers(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = ROUNDS) -> SpanModel:
    """Priors and reliabilities by expectation maximisation over (kind, votes, number of candidates)."""
    model = SpanModel()
    n_labelers = len(LABELERS)
    beliefs = {(j, y, v): believed(j)[y][v + 1] for j in range(n_labelers) for y in (0, 1) for v in (-1, 0, 1)}
    for kind in (k.kind for k in KINDS):
        rows = sorted((v, n) for k, v, n in patterns if k == kind)
        prior = BELIEF_PRIOR[0] / sum(BELIEF_PRIOR)
        says = {(j, y, v): n / sum(believed(j)[y]) for (j, y, v), n in beliefs.items()}
        for _ in range(rounds):
            counts = dict(beliefs)
            classes = [BELIEF_PRIOR[1], BELIEF_PRIOR[0]]
            for vote, n in rows:
                p = _posterior(prior, says, vote)
                for y, share in ((1, n * p), (0, n * (1 - p))):
                    classes[y] += share
                    for j, v in enumerate(vote):
                        counts[j, y, v] += share
            prior = classes[1] / sum(classes)
            says = {(j, y, v): c / sum(counts[j, y, u] for u in (-1, 0, 1)) for (j, y, v), c in counts.items()}
        model.prior[kind] = prior
        model.says |= {(kind, *key): p for key, p in says.items()}
    return model


def _posterior(prior: float, says: dict, vote: tuple[int, ...]) -> float:
    odds = math.log(prior / (1 - prior)) + sum(math.log(says[j, 1, v] / says[j, 0, v]) for j, v in enumerate(vote))
    return 1 / (1 + math.exp(-odds))


def _probability(model: SpanModel, candidate: Column) -> Column:
    """What the labelers together say of a candidate, as a function of its votes."""
    odds = reduce(lambda rest, k: F.when(candidate["kind"] == k, math.log(model.prior[k] / (1 - model.prior[k]))).otherwise(rest), model.prior, F.lit(0.0))
    table = {f"{k}{j}{v}": math.log(p / model.says[k, j, 0, v]) for (k, j, y, v), p in model.says.items() if y}
    known = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    for j in range(len(LABELERS)):
        odds = odds + known[F.concat(candidate["kind"], F.lit(str(j)), candidate["votes"][j].cast("string"))]
    return 1 / (1 + F.exp(-odds))


def fit(found: DataFrame, rounds: int = ROUNDS) -> SpanModel:
    """Reliabilities of the labelers and the span classifier, from all ``candidates`` of ``found``."""
    rows = found.select(F.explode("candidates").alias("c"))
    patterns = rows.groupBy("c.kind", "c.votes").count().collect()
    model = learn_labelers([(r["kind"], tuple(r["votes"]), r["count"]) for r in patterns], rounds)
    marked = rows.select("c.kind", _probability(model, F.col("c")).alias("p"), F.explode("c.features").alias("feature"))
    # Ten decimals: sums then don't depend on the order of the rows.
    sums = marked.groupBy("kind", "feature").agg(F.sum(F.round("p", 10).cast("decimal(22,10)")).alias("p"), F.count("*").alias("n")).collect()
    for kind in model.prior:
        own = [(r["feature"], float(r["p"]), r["n"]) for r in sums if r["kind"] == kind]
        yes, no = (sum(x) + b for x, b in zip(zip(*((p, n - p) for f, p, n in own if f.startswith("shape="))), BELIEF_PRIOR)) if own else BELIEF_PRIOR
        model.bias[kind] = math.log(yes / no)
        for feature, p, n in own:
            model.weights[f"{kind} {feature}"] = math.log((p + 0.5) / (yes + 1)) - math.log((n - p + 0.5) / (no + 1))
    return model


def belief(model: SpanModel, candidate: Column) -> Column:
    """The classifier's probability that a candidate is personal data."""
    odds = reduce(lambda rest, k: F.when(candidate["kind"] == k, model.bias[k]).otherwise(rest), model.bias, F.lit(0.0))
    if model.weights:
        known = F.create_map(*(F.lit(x) for pair in sorted(model.weights.items()) for x in pair))
        one = lambda f: F.coalesce(known[F.concat(candidate["kind"], F.lit(" "), f)], F.lit(0.0))
        odds = odds + F.aggregate(F.transform(candidate["features"], one), F.lit(0.0), lambda a, b: a + b)
    return 1 / (1 + F.exp(-odds))


def find(df: DataFrame, text: str, keep: tuple[str, ...] = (), threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns and ``spans`` of every text, by kind, then start: kind, start, stop, base, probability.

    Base spans are always there, other candidates from a probability of ``threshold`` on; one that fails its check also
    needs a context that speaks for it. ``df`` may have any other columns.
    """
    taken = {"spans", "candidates"} & set(keep)
    if taken:
        raise ValueError(f"columns to keep need other names: {sorted(taken)}")
    found = materialize(candidates(df, text, keep), "personal")
    model = fit(found)
    place = ("kind", "start", "stop", "base")
    check, context = LABELERS.index("check"), LABELERS.index("context")
    backed = F.filter("candidates", lambda c: c["base"] | (c["votes"][check] >= 0) | (c["votes"][context] == 1))
    scored = F.transform(backed, lambda c: F.struct(*(c[x].alias(x) for x in place), belief(model, c).alias("probability")))
    spans = F.filter(scored, lambda s: s["base"] | (s["probability"] >= threshold))
    return found.select(*(F.col(f"`{c}`") for c in keep), spans.alias("spans"))


def span_text(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
