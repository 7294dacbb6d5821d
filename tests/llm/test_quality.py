import random
import re
from collections import Counter

from pyspark.sql import functions as F

from parapet.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(8)}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
    )


def clean(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_counts_equal_brute_force(spark, documents):
    rng = random.Random(2)
    texts = [None, "", " \n\t", "one", "a b c d e f g h " * 3, "x " * 7, "x " * 9, "#*$%&|<> é# \U0001F600|", "same\nsame\n \nsame \n\nother\r\nother",
             "\x0bv\x0cf\x1cg\x85h\xa0i", "<p>" * 5000, "loop " * 30_000]
    for _ in range(40):
        words = [rng.choice("abcdef") for _ in range(rng.randrange(60))]
        at = rng.randrange(60)
        texts.append(rng.choice((" ", "\n")).join(words + words[at : at + 12]))
    docs = documents([(i, t, "en", "s") for i, t in enumerate(texts)], "n_words key")
    rows = quality.counts(docs.drop("n_words")).collect()
    for r in rows:
        found = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        wanted = brute(texts[r["doc_id"]])
        assert found == wanted, texts[r["doc_id"]][:80]
        assert r["base_failed"] == (wanted[0] < 20 or 100 * wanted[4] > 30 * wanted[0])


def test_rejects_outliers_and_keeps_the_rest(spark, documents):
    rng = random.Random(9)
    rows = [(i, clean(rng, rng.choice((25, 80, 400))), "en", f"s{i % 2}") for i in range(400)]
    bars = [(1000 + i, clean(rng, 100).replace(" ", " | "), "en", "s0") for i in range(60)]
    long = [(2000, " ".join(["w" * 60] * 40 + [clean(rng, 30)]), "en", "s1")]
    few = [(3000, clean(rng, 40), None, None), (3001, clean(rng, 40), "fr", None), (3001, clean(rng, 40), "fr", None), (None, clean(rng, 50), "de", "s0")]
    bad = [(4000, None, "en", "s0"), (4001, "too short", "en", "s0")]
    docs = documents(rows + bars + long + few + bad, "distance kept x1 key _row m0")
    found = quality.judged(docs).collect()
    assert len(found) == docs.count()
    kept = sorted(r["doc_id"] or 0 for r in found if r["kept"])
    assert kept == sorted([i for i, *_ in rows] + [3000, 3001, 3001, 0])
    passed = quality.accepted(docs)
    assert passed.columns == docs.columns and sorted(r["doc_id"] or 0 for r in passed.collect()) == kept


def test_resists_near_half_of_outliers(spark, documents):
    rng = random.Random(3)
    rows = [(i, clean(rng, 60), "en", "s") for i in range(60)]
    rows += [(100 + i, clean(rng, 60).replace(" ", " ||| "), "en", "s") for i in range(45)]
    found = quality.judged(documents(rows)).filter("kept").select("doc_id").collect()
    assert sorted(r["doc_id"] for r in found) == list(range(60))


def test_steps_lower_the_determinant(spark, documents):
    rng = random.Random(8)
    rows = quality.statistics(quality.counts(documents([(i, clean(rng, rng.randint(20, 90)), "en", "s") for i in range(200)])))
    rows = rows.withColumn("key", F.lit("k")).select("key", *quality.STATISTICS)
    sizes = []
    for steps in range(1, 5):
        e = quality.minimum_covariance(rows, steps).first()
        sizes.append(e["l00"] * e["l11"] * e["l22"] * e["l33"])
    assert all(b <= a * 1.001 for a, b in zip(sizes, sizes[1:]))


def test_equal_rows_and_empty_table(spark, documents):
    text = "the quick brown fox jumps over a lazy dog while nine more words follow here so that twenty are reached easily"
    found = quality.judged(documents([(i, text, "en", "s") for i in range(5)])).collect()
    assert all(r["kept"] for r in found)
    assert quality.judged(documents([])).collect() == [] and quality.accepted(documents([])).collect() == []
