"""Ties, repeated ids, columns with clashing names and empty side tables, where operators read more than documents."""

import random
import zlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import ids_of, item_words, plain_windows, same

from tidemark.llm import common, decontaminate, language, queries, tokens, toxicity, windows


def crowded(df, *names):
    """df with columns of the names that operators use themselves."""
    return df.withColumns({n: F.lit("clash") for n in names if n not in df.columns})


def told(df):
    return [tuple(r) for r in df.collect()]


def test_language_with_clashing_columns_and_ties(spark):
    train = spark.createDataFrame([("same words here", "bb"), ("same words here", "aa"), ("other text", "cc"), (None, None)], "text string, lang string")
    pages = [(1, "http://x.org/", "<p>same words"), (2, "http://y.org/", ""), (3, None, None), (4, "http://x.org/", "<p>other text"), (4, "http://x.org/", "<p>other text")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = told(language.identify(table, train))
    names = ["host", "suffix", "declared", "lang", "text_lang", "posterior", "_id", "_text", "_top", "_n", "_scores", "text", "doc_id", "page_id", "_lang", "_b"]
    same(told(language.identify(crowded(table, *names), crowded(train, *names, "url", "html"))), found)
    by_id = {x[0]: x for x in found}
    assert len(found) == 5 and by_id[1][4] == by_id[1][5] == "aa" and by_id[4][5] == "cc"


def test_toxicity_with_clashing_columns(spark):
    r = random.Random(8)
    rows = [(f"d{i}", " ".join([r.choice("abcdefgh") * 3 for _ in range(30)] + ["nasty"] * (i % 4 == 0))) for i in range(400)] + [(None, None), ("d1", ""), ("d1", "")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    marks = spark.createDataFrame([(f"d{i}", int(i % 4 == 0)) for i in range(0, 400, 2)] + [("d0", 0), ("d0", 0), (None, 1)], "doc_id string, toxic int")
    found = told(toxicity.score(docs, marks))
    names = ["score", "held_out", "predicted", "_id", "_text", "_label", "_p", "_u", "_f", "at", "p", "u"]
    same(told(toxicity.score(crowded(docs, *names, "toxic"), crowded(marks, *names, "text"))), found)
    assert len(found) == len(rows) and sum(x[3] for x in found) > 50
    assert len({x[2] for x in toxicity.score(docs.filter("doc_id is null or text = ''"), marks.limit(0)).collect()}) == 1
    assert {x[2] for x in toxicity.score(docs, marks.limit(0)).collect()} == {0.0}


def test_benchmark_with_clashing_columns(spark, docs, rows):
    table = spark.createDataFrame([(1, " ".join(item_words(rows[8][1])[20:60])), (1, None), (2, "two words"), (2, "two words")], "item_id long, text string")
    names = ["doc_id", "_window", "_text", "_id", "_k1", "_k2", "n_words", "items", "n_hit", "span_starts"]
    whole = told(decontaminate.digest(decontaminate.find_hits(docs, table)))
    same(told(decontaminate.digest(decontaminate.find_hits(docs, crowded(table, *names)))), whole)
    same(told(decontaminate.remove_contaminated(docs, crowded(table, *names))), told(decontaminate.remove_contaminated(docs, table)))
    assert any(x[5] for x in whole)


@pytest.mark.parametrize("size", [64 << 20, 400])
def test_token_files_deal_rows_of_one_id_over_ranges(spark, monkeypatch, size):
    monkeypatch.setattr(common, "RANGE_BYTES", size)
    r = random.Random(3)
    rows = [(5 if i % 3 else i, None if i % 50 == 0 else " ".join(r.choice(["tie", "of", "rows", "é"]) for _ in range(r.randint(0, 30)))) for i in range(300)] + [(None, "x")] * 3
    manifest = tokens.write_ids(spark.createDataFrame(rows, "doc_id long, text string"), queries.TOKENIZER, end_id=0)
    expected, start = [], 0
    for doc_id, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, (x[1] or "").encode())):
        ids = ids_of(text, 0)
        expected.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [tuple(x) for x in sorted(tokens.read_ids(manifest).collect(), key=lambda x: x.start)] == expected
    if size == 400:
        assert manifest.filter("n_ids > 0").count() > 10 and max(x.n_ids for x in manifest.collect()) < start / 4


def test_windows_of_repeated_rows(spark):
    r = random.Random(6)
    long = "".join(r.choice("abcdefgh") for _ in range(260))
    texts = [long] * 40 + [long[:199], long[60:], "q" * 500, None, ""] + ["".join(r.choice("xyz") for _ in range(230)) for _ in range(5)]
    table = spark.createDataFrame([(7, t) for t in texts], "doc_id long, text string").repartition(6)
    found = windows.remove_repeated_windows(table, size=200, with_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    same(told(found), [(7, *v) for v in plain_windows(texts, 200)])


def tables(spark, path, documents, labels, benchmark):
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long, _text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_pipeline_over_empty_tables(spark, tmp_path):
    r = random.Random(1)
    docs = [(i, " ".join(f"w{r.randint(0, 500)}" for _ in range(80)), "en", "s", 9, "clash") for i in range(6)] + [(None, None, None, None, None, None)]
    bare = tables(spark, f"file://{tmp_path}/a", docs, [], [])
    pieces = corpus_pipeline.run(spark, bare).collect()
    assert {x.doc_id for x in pieces} == set(range(6))  # without trusted texts the base rules alone judge
    for d, t, *_ in docs[:6]:
        own = sorted((x for x in pieces if x.doc_id == d), key=lambda x: x.start)
        assert (np.concatenate([np.frombuffer(bytes(x.ids), "<u4") for x in own]) == ids_of(t, 1)).all()
    none = tables(spark, f"file://{tmp_path}/b", [], [(1, 1, 1)], [(1, "a b c")])
    found = corpus_pipeline.run(spark, none)
    assert found.count() == 0 and "sequence_id" in found.columns
