"""The pipeline over a small corpus with planted cases, against plain versions of its decisions."""

import random
import re

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from batchloom.llm.queries import vocabulary_path
from test_langid import VOWELS
from test_secret_scan import brute as secrets_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, key string"


def prose(rng, lang, n):
    stems = VOWELS[lang]
    return " ".join(rng.choice(stems) + "".join(rng.choice(stems) for _ in range(rng.randrange(3))) for _ in range(n))


@pytest.fixture(scope="module")
def planted(tmp_path_factory):
    rng = random.Random(6)
    docs, langs = {}, {}
    for i in range(150):
        langs[i] = rng.choice(list(VOWELS))
        docs[i] = prose(rng, langs[i], rng.randrange(40, 120))
    items = [(k, prose(rng, rng.choice(list(VOWELS)), 30)) for k in range(6)]
    cases = {
        200: docs[3],  # exact copy
        201: docs[4] + " " + prose(rng, "aa", 1),  # near copy
        202: docs[5][:200] + " " + items[2][1].upper() + " " + docs[6][-100:],  # leak
        203: docs[7] + ' token = "abcdef123456" ' + prose(rng, "aa", 40),  # secret
        204: None,
        205: "12 !!",
        206: "xqzw vkkq zzxj qqwx " * 30,  # no language
    }
    rows = [(i, t, langs.get(i), f"s{i % 3}", len(t or ""), "x", "y") for i, t in (docs | cases).items()]
    folder = tmp_path_factory.mktemp("tables")
    return folder, rows, items


def test_stages(spark, planted):
    folder, rows, items = planted
    spark.createDataFrame(rows, SCHEMA).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, gone = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.collect()}
        docs = stage(spark, docs, str(folder))
        assert docs.columns == columns, name
        docs = corpus_pipeline.materialize(docs, "test")
        gone.append(before - {r.doc_id for r in docs.collect()})
    assert gone == [{204, 205, 206}, {200, 201}, {202}, set()]
    by = {r.doc_id: r for r in docs.collect()}
    original = {r[0]: r[1] for r in rows}
    for i, r in by.items():
        want, at = "", 0
        for _, a, b in secrets_of(original[i]):
            want, at = want + original[i][at:a] + "[secret]", b
        assert r.text == want + original[i][at:] and r.n_chars == len(r.text)
    assert "[secret]" in by[203].text
    out = corpus_pipeline.run(spark, str(folder))
    assert set(out.columns) == (set(columns) - {"text"}) | {"ids", "n_tokens", "same_text"}
    library = Tokenizer.from_file(vocabulary_path())
    result = out.collect()
    assert {r.doc_id for r in result} == set(by)
    for r in result:
        assert r.same_text and r.ids == library.encode(by[r.doc_id].text, add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_empty_documents(spark, planted, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_without_ids_and_repeated_rows(spark, planted):
    folder, rows, items = planted
    more = [(None, rows[0][1], "aa", "s", 5, "x", "y"), (None, rows[0][1], None, None, None, None, None), rows[1], rows[1]]
    docs = spark.createDataFrame(more, SCHEMA)
    assert corpus_pipeline.drop_near_duplicates(spark, docs, str(folder)).count() == 4
    assert corpus_pipeline.mask_secrets(spark, docs, str(folder)).count() == 4
    assert corpus_pipeline.encode_tokens(spark, docs, str(folder)).count() == 4


def test_stages_name_their_operators():
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    assert [bool(re.search(p, n, re.I)) for p, (n, _) in zip(("language", "minhash", "decontamination", "secret", "bpe"), corpus_pipeline.STAGES)] == [True] * 5
