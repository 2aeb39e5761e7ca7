import hashlib
import random

import numpy as np
import pytest

from batchloom.llm import suffix


def brute(rows, length):
    """Every window in order of (id, start); what a later equal one covers goes."""
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            window = data[i : i + length]
            if window in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(window)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[doc] = (len(data), len(data) - len(kept), runs, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed):
    rng = random.Random(seed)
    letters = "abcdeé "
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = [text(rng.randrange(60, 400)) for _ in range(6)]
    rows = []
    for i in range(70):
        parts = [rng.choice([text(rng.randrange(150)), rng.choice(shared), rng.choice(shared)[rng.randrange(40) :]]) for _ in range(rng.randrange(5))]
        rows.append((i * 3, "".join(parts)))
    rows += [(1000 + i, rows[20][1]) for i in range(5)]  # copies
    rows += [(2000, "ab" * 400), (2001, "x" * 150), (2002, "x" * 99), (2003, None), (2004, ""), (2005, "x" * 100), (2006, "ba" * 120)]
    rows += [(2007 + i, text(30) + shared[0] + text(30)) for i in range(30)]  # one hot passage
    rng.shuffle(rows)
    return rows


def got(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_bytes string")
    out = suffix.remove_repeats(df, "doc_id", "text", **options)
    return {r[0]: tuple(r[1:5]) for r in out.collect()}


def test_suffix_array_against_sorting():
    rng = random.Random(1)
    for n in [*range(0, 40), 200, 1000]:
        for top in (1, 2, 5, 300):
            s = [rng.randrange(1, top + 1) for _ in range(n)]
            assert suffix.suffix_array(np.array(s, dtype=np.int64)).tolist() == sorted(range(n), key=lambda i: s[i:])


def test_triples_pack_in_order_for_large_names():
    rng = np.random.default_rng(2)
    a, b, c = (rng.integers(0, 5, 400) * (1 << 24) for _ in range(3))
    packed = suffix._packed(a, b, c, 30)
    assert np.array_equal(np.lexsort((c, b, a)), np.argsort(packed, kind="stable"))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_windows(spark, seed):
    rows = corpus(seed)
    assert got(spark, rows) == brute(rows, 100)


def test_small_bounds_change_nothing(spark, monkeypatch):
    """Held blocks, segments, sorted groups and hot pieces; other lengths."""
    rows = corpus(3)
    for name, value in (("HELD_BLOCKS", 20), ("SEGMENT", 300), ("SORTED_BYTES", 500), ("HOT_KINDS", 3)):
        monkeypatch.setattr(suffix, name, value)
    assert got(spark, rows) == brute(rows, 100)
    assert got(spark, rows, length=40, gram=9) == brute(rows, 40)


def test_small_batches_and_bytes(spark):
    rows = corpus(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert got(spark, rows) == brute(rows, 100)
        df = spark.createDataFrame(rows, "doc_id long, text string")
        for r in suffix.remove_repeats(df, "doc_id", "text", bytes_as="kept").collect():
            assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_table_null_and_repeated_ids(spark):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefgh") for _ in range(300))
    assert got(spark, []) == {}
    out = got(spark, [(5, long), (5, long), (None, long), (7, "q" + long)])
    assert out[None][1] == 0 and out[5][1] == 300 and out[7][1] == 300 and len(out) == 3


def letters(rng, n):
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))


@pytest.mark.parametrize("hottest", [1, 100])
def test_hot_pieces_travel_in_runs(spark, monkeypatch, hottest):
    """A passage in many contexts: its windows go in runs, one by one only if it is very hot, and none is lost."""
    rng = random.Random(11)
    passage, edge = letters(rng, 60), letters(rng, 30)
    rows = [(i, letters(rng, 150) + (edge if i % 3 else "") + passage + (edge if i % 2 else "") + letters(rng, 150)) for i in range(60)]
    monkeypatch.setattr(suffix, "HOT_KINDS", 10)
    monkeypatch.setattr(suffix, "HOTTEST", hottest)
    dealt, compare = [], suffix._compare

    def counted(pieces, length):
        dealt.extend((r["part"], r["windows"]) for r in pieces.collect())
        return compare(pieces, length)

    monkeypatch.setattr(suffix, "_compare", counted)
    assert got(spark, rows) == brute(rows, 100)
    runs = [n for part, n in dealt if part >= 0]
    assert sum(runs) > 1000
    if hottest > 1:
        assert max(runs) == suffix.RUN and len(runs) < sum(runs) / 4
    else:
        assert set(runs) == {1}


def test_only_windows_that_may_be_equal_are_sorted(monkeypatch):
    rng = random.Random(12)
    texts = [letters(rng, rng.randrange(100, 170)).encode() for _ in range(300)]
    twin = letters(rng, 105).encode()  # six windows in three blocks
    for i in (7, 130, 131):
        texts[i] = letters(rng, 5 * i % 40).encode() + twin + letters(rng, 20).encode()
    doc, first = np.arange(300)[::-1] // 2, np.array([rng.randrange(50) + 200 * (i % 2) for i in range(300)])
    windows = np.array([len(t) - 99 for t in texts])
    sizes, sort = [], suffix.suffix_array
    monkeypatch.setattr(suffix, "suffix_array", lambda s: sizes.append(len(s)) or sort(s))
    out = suffix.repeated_windows(texts, doc, first, windows, 100)
    places = [(doc[i], first[i] + k, i, k) for i in range(300) for k in range(windows[i])]
    seen, expected = set(), {}
    for _, _, i, k in sorted(places):
        window = texts[i][k : k + 100]
        expected[i, k] = window in seen
        seen.add(window)
    assert out.tolist() == [expected[i, k] for _, _, i, k in places] and out.sum() == 12
    assert sizes[0] == 3 * 106
    assert not suffix.repeated_windows(texts[:7], doc[:7], first[:7], windows[:7], 100).any()
