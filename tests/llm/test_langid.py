import zlib

import numpy as np
from pyspark.sql import functions as F

from parapet.llm import langid


def brute(text, dimension=langid.DIMENSION):
    """The bundle of a text, letter by letter."""
    symbols = [None]
    for c in text.lower():
        if c.isalpha():
            symbols.append(c)
        elif symbols[-1] is not None:
            symbols.append(None)
    symbols += [None]
    vector = lambda s: langid.letter_vector(ord(s or " "), dimension).astype(int)
    out = np.zeros(dimension, int)
    for a, b, c in zip(symbols, symbols[1:], symbols[2:]):
        if b is not None:
            out += np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c)
    return out


TEXTS = ["Hello, World!", "", "  123 ", "Straße ÉTÉ", "日本語 text", "a", "a b", "x" * 50, "İstanbul ΟΔΟΣ\n"]


def test_profiles_equal_brute_force():
    found = langid.profiles(TEXTS)
    for text, row in zip(TEXTS, found):
        assert row.tolist() == brute(text).tolist(), text
    many = [chr(0x4E00 + i) + chr(0x5000 + i) for i in range(400)]  # more letters than the table of trigrams holds
    assert all((row == brute(t)).all() for t, row in zip(many, langid.profiles(many)))


def test_predicts_from_text_alone(spark, documents):
    rows = [(i, "the cat and the dog", "en", "s") for i in range(30)]
    rows += [(i, "le chat et le chien", "fr", "s") for i in range(30, 60)]
    rows += [(99, "the dog", "fr", None), (98, None, "en", "s"), (97, "1 2 3", "en", "s"), (None, "le chien", None, None)]
    found = {r["doc_id"]: r for r in langid.predict(documents(rows, "score lang_pred held_out")).collect()}
    assert len(found) == len(rows)
    for i in range(60):
        assert found[i]["lang_pred"] == ("en" if i < 30 else "fr") and 0 < found[i]["score"] <= 1
        assert found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
    assert found[99]["lang_pred"] == "en" and found[None]["lang_pred"] == "fr"
    assert [(found[i]["lang_pred"], found[i]["score"]) for i in (98, 97)] == [("und", 0.0)] * 2


def test_nothing_to_learn(spark, documents):
    (row,) = langid.predict(documents([(1, "words", None, "s")])).collect()
    assert (row["lang_pred"], row["score"]) == ("und", 0.0)
    assert langid.predict(documents([])).collect() == []


def test_ties_go_to_the_smaller_language(spark, documents):
    rows = documents([(1, "same", "b", "s"), (2, "same", "a", "s")])
    prototypes = langid.learn(rows)
    found = langid.identify(rows.select("doc_id", "text"), prototypes).collect()
    assert {r["lang_pred"] for r in found} == {"a"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.predict(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
