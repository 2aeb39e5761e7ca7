"""Filter interaction audit: what each filter of a chain removes, alone and in every order.

A document fails a set of filters, written as bits of a mask. Every figure of the audit is a sum over the counts of
masks, so the corpus is reduced to at most 2^filters counts for each part, and all orders are worked out from those.

One filter is *repeats*: a text equal to the text of a smaller id. Its prepass is a counting Bloom sketch: tasks count the
cells of their texts (up to 2 is enough), the partial sketches are merged by chunk, and a text one of whose cells was
counted once is unique for certain. Only the rest moves as text, is grouped by its full text, and gives the minimum id of
each; copies that meet in one task are combined before they move. The sketch has CELLS cells for every document, and
at most MAX_CHUNKS chunks (64 MB), so that it can be sent to all tasks. Beyond 33 million documents its cells fill
up and more texts move; the result is exact at any size.

Null texts count as empty, a null part as the empty string. A row without an id repeats nothing and is repeated by
nothing; rows of equal id don't repeat each other. Labels of an id that has several rows count if any says so. An empty
table has no parts, so no rows. Columns are read by name; ``documents`` and ``labels`` may have any others.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom.llm.sketch import sketch, with_maybe
from batchloom.session import materialize

SPACE = r"[\x20\x09-\x0D]+"


def text_filters(text: Column) -> dict[str, Column]:
    """The failure conditions of the audit that look at one text alone: short, repetitive, shouting, symbols."""
    words = F.array_remove(F.split(text, SPACE, -1), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n < 200,
        "B": 100 * distinct < 50 * n,
        "C": 100 * capitals.cast("long") > 3 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def masks(documents: DataFrame, doc_id: str, text: str, part: str, conditions: dict[str, Column] | None = None) -> DataFrame:
    """(id, part, mask) of every document: bit i of the mask for failure condition i, the last bit for repeats.

    ``conditions`` read the column ``text``, which is never null; without them they are ``text_filters``.
    """
    conditions = text_filters(F.col("text")) if conditions is None else conditions
    docs = documents.select(F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    hashes = F.xxhash64("text").alias("h"), F.xxhash64(F.lit("again"), "text").alias("g")
    own = F.lit(0)
    for bit, failed in enumerate(conditions.values()):
        own = own + F.when(failed, 1 << bit).otherwise(0)
    rows = materialize(docs.select("id", "part", own.alias("mask"), *hashes), "flags")
    merged, chunks = sketch(rows, "h", rows.count(), 2)
    texts = with_maybe(docs.where(F.col("id").isNotNull()).select("id", "text", hashes[0]), "h", merged, chunks)
    least = texts.where("maybe").groupBy("text").agg(F.min("id").alias("first"))
    least = least.select(F.col("first"), F.xxhash64("text").alias("first h"), F.xxhash64(F.lit("again"), "text").alias("first g"))
    marked = with_maybe(rows, "h", merged, chunks)
    same = (F.col("id") == F.col("first")) & (F.col("h") == F.col("first h")) & (F.col("g") == F.col("first g"))
    repeated = F.col("maybe") & F.col("id").isNotNull() & F.col("first").isNull()
    bit = 1 << len(conditions)
    return marked.join(least, same, "left").select("id", "part", (F.col("mask") + F.when(repeated, bit).otherwise(0)).alias("mask"))


def mask_counts(marked: DataFrame, labels: DataFrame, label_id: str, good: str, toxic: str) -> DataFrame:
    """(part, mask, n, good, toxic): documents, and those labelled good or toxic, of each part and mask."""
    known = labels.groupBy(F.col(f"`{label_id}`").alias("label id")).agg(
        F.max((F.col(f"`{good}`") == 1).cast("long")).alias("good"), F.max((F.col(f"`{toxic}`") == 1).cast("long")).alias("toxic")
    )
    known = known.where(F.col("label id").isNotNull() & ((F.col("good") == 1) | (F.col("toxic") == 1)))
    joined = marked.join(known, F.col("id") == F.col("label id"), "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c)
    return joined.groupBy("part", "mask").agg(F.count("*").alias("n"), total("good"), total("toxic"))


def audit(counts: DataFrame, names: str) -> DataFrame:
    """A row for every part, order of the filters ``names`` (letters, in the order of the bits) and step."""
    orders = []
    for order in permutations(names):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << names.index(name)
            orders.append(("".join(order), step, before, bit))
            before |= bit
    gathered = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    steps = F.array(*(F.struct(F.lit(o).alias("o"), F.lit(s).alias("s"), F.lit(b).alias("b"), F.lit(f).alias("f")) for o, s, b, f in orders))
    rows = gathered.select("part", "masks", F.explode(steps).alias("x"))
    before, bit = F.col("x.b"), F.col("x.f")
    zero = F.lit(0).cast("long")

    def total(field: str, wanted) -> Column:
        return F.aggregate("masks", zero, lambda sum_, m: sum_ + F.when(wanted(m["mask"]), m[field]).otherwise(zero))

    fails = lambda m: m.bitwiseAND(bit) != 0
    gone = lambda m: m.bitwiseAND(before) != 0
    here = lambda m: fails(m) & ~gone(m)
    every = len(list(permutations(names)))
    # Of the orders, a document is removed by each filter that it fails in an equal share.
    share = F.aggregate("masks", zero, lambda sum_, m: sum_ + F.when(fails(m["mask"]), (m["n"] * every / F.bit_count(m["mask"])).cast("long")).otherwise(zero))
    return rows.select(
        "part",
        F.col("x.o").alias("filter_order"),
        F.col("x.s").alias("step"),
        total("n", lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda m: fails(m) & gone(m)).alias("redundant"),
        total("n", lambda m: m == bit).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        share.alias("shapley"),
    )
