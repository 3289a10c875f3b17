"""Encoding by distinct words against the tokenizers library on whole texts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import same, sha
from tokenizers import Tokenizer

from tidemark.llm import queries, wordtable

PATH = queries.WORD_TOKENIZER
ODD = [" ", "  ", "\n", "\t", "\x0b", "\x1c", "\u0085", " ", " ", "　", "é", "́", "İ", "ß", "Σ", "ΑΣ", "'s", "'S", "<|endoftext|>", "<|ENDOFTEXT|>", "̸", ">", "1", "٣", "½", "字", "😀", "a", "Bc", "\x00", "don't", "࢏", "꟎", "가", "ᄀ", "ᅡ"]


def plain(rows):
    library = Tokenizer.from_file(PATH)
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        yield doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False))


def found(df):
    apart, at_once = wordtable.decode(wordtable.encode(df, PATH), PATH), wordtable.encode(df, PATH, with_text=True)
    rows = [tuple(r) for r in wordtable.digest(at_once).collect()]
    same([tuple(r) for r in wordtable.digest(apart).collect()], rows)
    return rows


@pytest.mark.parametrize("size", [wordtable.CHUNK_BYTES, 300])
def test_ids_and_texts_are_the_librarys(spark, docs, rows, empty, monkeypatch, size):
    monkeypatch.setattr(wordtable, "CHUNK_BYTES", size)
    same(found(docs), list(plain(x[:2] for x in rows)))
    assert found(empty) == []


def test_every_character_beside_others(spark):
    r = random.Random(2)
    texts = ["".join(r.choice(ODD) for _ in range(r.randint(0, 20))) for _ in range(3000)]
    texts += ["'".join(chr(c) for c in range(i, i + 64) if not 0xD800 <= c < 0xE000) + " b" for i in range(0, 0x20000, 64)]
    same(found(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), list(plain(enumerate(texts))))


def test_very_long_words_and_texts(spark):
    r = random.Random(3)
    texts = ["x" * 300_000, "y " * 600_000, " ".join(f"w{r.randint(0, 99999)}" for _ in range(300_000)), "z" + "\n" * 1_000_000]
    same(found(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), list(plain(enumerate(texts))))


def test_one_word_in_all_rows_and_ids_of_text(spark):
    rows = [(None if i % 5 == 0 else f"d{i % 7}", "same same Same") for i in range(500)]
    df = spark.createDataFrame(rows, "key string, body string").repartition(5).withColumns({c: F.lit("clash") for c in ("id", "ids", "text", "path", "part", "bucket", "words", "decoded")})
    out = wordtable.decode(wordtable.encode(df, PATH, "key", "body"), PATH)
    same([(x.key, x.decoded) for x in out.collect()], [(k, " ".join(["same</w>"] * 3)) for k, _ in rows])


def test_unknown_ids_nulls_and_other_columns_in_decoding(spark):
    raw = lambda *x: bytearray(np.array(x, "<u4").tobytes())
    table = spark.createDataFrame([(1, raw(320, 99999, 4_000_000_000, 49407)), (2, None), (3, raw())], "n int, b binary").withColumn("decoded", F.lit(0))
    library = Tokenizer.from_file(PATH)
    same([tuple(x) for x in wordtable.decode(table, PATH, "b").select("n", "decoded").collect()], [(1, library.decode([320, 99999, 49407], skip_special_tokens=False)), (2, ""), (3, "")])


def test_tokenizers_that_keep_blanks_are_refused(spark, docs):
    with pytest.raises(ValueError, match="white space"):
        wordtable.encode(docs, queries.TOKENIZER)
    with pytest.raises(ValueError, match="decoder"):
        wordtable.decode(docs, queries.TOKENIZER, "text")
