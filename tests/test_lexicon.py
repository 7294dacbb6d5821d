import ahocorasick
import pytest
from pyspark.sql import functions as F

from parapet.operators.audit import detect
from parapet.operators import lexicon_match
from parapet.operators.lexicon_match import GRAM, builtin_lexicon, candidate_grams, match_lexicon
from parapet.plans.corpus import prompted_turns
from tests.plans import metric_values, total_of


def matches(df):
    rows = df.select("i", "matches").collect()
    return {r["i"]: [(m["signal"], m["ord"], m["phrase"]) for m in r["matches"]] for r in rows}


@pytest.mark.parametrize("compiled", [1000, 0])
def test_first_phrase_per_signal(spark, compiled):
    lexicon = spark.createDataFrame(
        [("x", 2, "bad"), ("x", 1, "worse"), ("y", 0, "bad"), ("y", 1, "a b"), ("z", 0, ""), ("z", 1, "long phrase, verified"), ("z", 2, "long phrase")],
        "signal string, ord bigint, phrase string",
    )
    texts = [(0, "BAD and worse"), (1, "xa bx"), (2, "none"), (3, None), (4, "embadded"), (5, "A Long Phrase.")]
    df = spark.createDataFrame(texts, "i int, text string")
    got = matches(match_lexicon(df, lexicon, compiled=compiled))
    assert got == {
        0: [("x", 1, "worse"), ("y", 0, "bad")],
        1: [("y", 1, "a b")],
        2: [],
        3: [],
        4: [("x", 2, "bad"), ("y", 0, "bad")],
        5: [("z", 2, "long phrase")],
    }


def test_large_lexicon_equals_brute_force(spark):
    phrases = [f"p{i * 7919 % 100003}q" for i in range(5000)]
    lexicon = spark.createDataFrame(
        [("s", i, p) for i, p in enumerate(phrases)], "signal string, ord bigint, phrase string"
    )
    texts = ["".join(f"p{(i * 31 + j * 977) % 100003}q" for j in range(20)) for i in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    found = match_lexicon(df, lexicon)
    assert "ArrowEvalPython" not in found._jdf.queryExecution().executedPlan().toString()
    got = matches(found)
    for i, text in enumerate(texts):
        first = next(((j, p) for j, p in enumerate(phrases) if p in text), None)
        assert got[i] == ([("s", *first)] if first else [])


def test_table_equals_compiled_lists(spark, data):
    documents = spark.read.parquet(f"{data}/documents.parquet").withColumn("i", F.col("doc_id"))
    both = detect(match_lexicon(documents, builtin_lexicon(spark)), "text")
    for r in both.select("matches", "refusal_phrase", "jailbreak_phrase", "bias_match").collect():
        found = {m["signal"]: m["phrase"] for m in r["matches"]}
        assert found.get("refusal") == r["refusal_phrase"]
        assert found.get("jailbreak") == r["jailbreak_phrase"]
        pair = (found.get("bias_group"), found.get("bias_descriptor"))
        assert (" + ".join(pair) if all(pair) else None) == r["bias_match"]


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_every_reply_has_its_last_prompt(spark, block):
    said = [(0, "system"), (1, "assistant"), (2, "user"), (3, "assistant"), (4, "assistant"),
            (7, "user"), (8, "user"), (9, "assistant"), (1500, "assistant"), (1501, "user")]
    turns = [(c, t, role, f"{c}-{t}") for c in (1, 2) for t, role in said]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    rows = prompted_turns(df, block).collect()
    assert len(rows) == len(turns)
    for r in rows:
        before = [t for t, role in said if role == "user" and t < r["turn"]]
        assert r["prompt"] == (f"{r['conv_id']}-{before[-1]}" if before else None)


def large_lexicon(spark, many):
    """Distinct phrases of 3 to 14 letters, few of which occur anywhere."""
    number = F.md5(F.col("id").cast("string"))
    phrase = F.lower(F.left(number, (F.col("id") % 12 + 3).cast("int")))
    rows = spark.range(many).select(F.lit("s").alias("signal"), F.col("id").alias("ord"), phrase.alias("phrase"))
    return rows.groupBy("signal", "phrase").agg(F.min("ord").alias("ord")).filter(F.length("phrase") >= 5)


def test_only_candidates_leave_the_task(spark, data):
    documents = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    rows = documents.withColumn("_row", F.col("doc_id"))
    words = F.explode(F.split(F.lower("text"), "[^\\p{L}]+"))
    rare = documents.filter("doc_id < 40").select(words.alias("phrase")).filter("length(phrase) >= 9").distinct()
    lexicon = rare.withColumn("_gram", F.left("phrase", F.lit(GRAM)))
    found = candidate_grams(rows, lexicon, "text")
    kept = [tuple(r) for r in found.collect()]
    grams = {r["_gram"] for r in lexicon.collect()}
    true = [(i, g) for i, g in kept if g in grams]
    texts = {r["doc_id"]: (r["text"] or "").lower() for r in documents.collect()}
    wanted = {(i, t[j : j + GRAM]) for i, t in texts.items() for j in range(len(t)) if t[j : j + GRAM] in grams}
    assert set(true) == wanted and len(true) == len(wanted)
    letters = sum(len(t) for t in texts.values())
    assert max(metric_values(found, "Generate", "numOutputRows")) > 0.9 * letters  # all grams are made
    shuffled = total_of(found, "Exchange", "shuffleRecordsWritten")
    assert shuffled < 1.5 * len(wanted) + 0.002 * letters  # at most one bit in a thousand is set


def test_hundred_thousand_phrases(spark):
    lexicon = large_lexicon(spark, 140_000)
    phrases = {r["phrase"]: r["ord"] for r in lexicon.collect()}
    assert len(phrases) > 100_000
    some = sorted(phrases)[::900]
    texts = [f"... {p[:4]} {p} {p[1:]}x".upper() for p in some] + ["nothing here", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = matches(match_lexicon(df, lexicon))
    automaton = ahocorasick.Automaton()
    for phrase, place in phrases.items():
        automaton.add_word(phrase, (place, phrase))
    automaton.make_automaton()
    for i, text in enumerate(texts):
        best = min((hit for _, hit in automaton.iter((text or "").lower())), default=None)
        assert got[i] == ([("s", *best)] if best else [])


def test_long_text_is_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(lexicon_match, "PIECE", 16)
    lexicon = spark.createDataFrame([("s", i, p) for i, p in enumerate(["needle in hay", "ende", "ßtraß"])], "signal string, ord bigint, phrase string")
    texts = [("x" * i + p + "y" * (i % 7)) for i in range(40) for p in ("Needle in Hay", "needle inhay", "ßtraß")]
    got = matches(match_lexicon(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), lexicon, compiled=0))
    for i, text in enumerate(texts):
        assert [m[2] for m in got[i]] == [p for p in ("needle in hay", "ßtraß") if p in text.lower()]


def test_empty_lexicon(spark):
    lexicon = spark.createDataFrame([("s", 1, "")], "signal string, ord bigint, phrase string")
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, text string")
    assert matches(match_lexicon(df, lexicon, compiled=0)) == matches(match_lexicon(df, lexicon)) == {1: [], 2: []}


def test_searches_are_not_copied_into_filters(spark, data):
    """No search below the projection that lowers the text, and each only once."""
    documents = spark.read.parquet(f"{data}/documents.parquet")
    matched = match_lexicon(documents, builtin_lexicon(spark)).select("doc_id", F.inline("matches"))
    plan = matched._jdf.queryExecution().optimizedPlan().toString()
    before = plan.split("Generate explode(array(_matches")[-1]
    assert plan.count("Contains(") == before.count("Contains(") or "Contains(" not in plan
    searches = len(builtin_lexicon(spark).collect())
    assert plan.count("Contains") <= searches
    assert not any("Filter" in line and "Contains" in line for line in plan.splitlines())
