import re
from collections import Counter, defaultdict

from batchloom.llm import lines

SPACE = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, source string, kept string, row string"


def figures(text):
    words = re.findall(SPACE, text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(SPACE, line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def normal(line):
    return re.sub(r"[ \t-\r]+", " ", line.lower()).strip(" \t\n\v\f\r")


def brute(rows, floor, percent, share):
    holders, hosts = defaultdict(set), defaultdict(set)
    for doc, text, host, *_ in rows:
        hosts[host or ""].add(str(doc))
        for line in (text or "").split("\n"):
            holders[host or "", normal(line)].add(str(doc))

    def common(host, line):
        n = len(holders[host, normal(line)])
        return n > floor and 100 * n > percent * len(hosts[host])

    out = []
    for doc, text, host, *_ in rows:
        text = text or ""
        figure = figures(text)
        gone = sum(len(re.findall(SPACE, x)) for x in text.split("\n") if re.search(SPACE, x) and common(host or "", x))
        failed = figure[0] < 50 or 100 * figure[4] > 50 * figure[0]
        out.append((str(doc), *figure, gone, failed, not failed and figure[0] - gone >= share * figure[0]))
    return sorted(out)


def corpus():
    body = " ".join(f"w{i}é" for i in range(60))
    rows = [(i, f"Menu 12  HOME\n{body} own{i}\n#{i} <b> &", "a", "x", "y") for i in range(8)]
    rows += [(100 + i, "Menu 3 home\n" * 30 + f"\t\n one{i} two three", "a", "x", "y") for i in range(3)]
    rows += [(200, None, None, None, None), (201, "", "b", "x", "y"), (202, " \n\t \n", None, "x", "y"), (203, "a b c " * 40, "b", "x", "y")]
    rows += [(204, body + " q" * 5000, "b", "x", "y"), (204, body, "b", "x", "y"), (None, body, "b", "x", "y"), (205, "Menu 12  HOME\n" + body, "c", "x", "y")]
    return rows


def got(spark, rows, floor, percent, share):
    df = spark.createDataFrame(rows, SCHEMA)
    out = lines.apply_rules(df, "doc_id", "text", "source", floor, percent, share).drop("host")
    return sorted((str(r[0]), *r[1:]) for r in out.collect())


def test_rules_against_brute_force(spark):
    rows = corpus()
    for rule in ((5, 0, 0.5), (1, 0, 0.9), (1000, 0, 0.5), (1, 60, 0.9), (1, 80, 0.9), (0, 0, 0.5), (0, 100, 0.5)):
        assert got(spark, rows, *rule) == brute(rows, *rule)


def test_the_limit_follows_the_host(spark):
    """One line in 10 documents: boilerplate of a host of 100, not of one of 300; rows of numbers stay."""
    rows = [(i, "all rights reserved\n" * (i % n < 10) + f"own words {i}", f"host{n}", "", "") for n in (100, 300) for i in range(1000 * n, 1001 * n)]
    rows += [(10**6 + i, f"result of trial {i} was {i * i} units\n" * 2 + f"name{i}", "host100", "", "") for i in range(8)]
    found = {r.source: r for r in lines.remove_lines(spark.createDataFrame(rows, SCHEMA), "doc_id", "text", "source").where("cleaned <> text").groupBy("source").count().collect()}
    assert {k: v["count"] for k, v in found.items()} == {"host100": 10}


def test_empty_table(spark):
    assert got(spark, [], 5, 5, 0.5) == []


def test_many_distinct_words_take_the_other_key():
    import numpy as np

    codes = np.array([0, 1, 2, 3, 0, 1, 2, 9, 9, 9, 9], dtype=np.int64)
    counts = np.array([8, 3])
    assert lines.repeated_words(codes, counts, 10).tolist() == lines.repeated_words(codes, counts, 1 << 22).tolist() == [6, 0]


def test_cleaned_texts(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    out = lines.remove_lines(df, "doc_id", "text", "source", 5, 0)
    assert out.columns == [*df.columns, "cleaned"] and out.count() == df.count()
    texts = {r.doc_id: r.cleaned for r in out.collect()}
    assert texts[200] is None and texts[201] == ""
    assert "HOME" not in texts[0] and "own0" in texts[0] and texts[205].startswith("Menu 12")


def test_a_line_of_most_documents_is_split(spark):
    """The join with frequent lines has a unique side, and counting starts before the shuffle."""
    df = spark.createDataFrame(corpus(), SCHEMA)
    plan = lines.frequent_lines(lines.document_figures(df, "doc_id", "text", "source"))._jdf.queryExecution().toString()
    assert "partial_count(distinct" in plan or "partial_count" in plan
