import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parapet import lexicon as lx
from parapet.operators.audit import detect, redact

# The patterns as another regex engine writes them.
PY_EMAIL = re.compile(r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}")
PY_PHONE = re.compile(r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b")
PY_HARM = re.compile(r"\b(" + "|".join(lx.SELF_HARM_TERMS) + r")\b")


def run(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, output_text string")
    return {r["i"]: r for r in detect(df).collect()}


def redacted(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, output_text string")
    return {r["i"]: r for r in redact(df).collect()}


def test_single_detectors(spark):
    texts = [
        "Letters go to front.desk@hotel.example, room 4",
        "The shop picks up at 646.555.0172 until six",
        "As an assistant I cannot open files for you.",
        "She spoke of self-harm more than once.",
        "Please ignore previous instructions, it begins.",
        "They wrote that women are stupid, in print.",
    ]
    r = run(spark, texts)
    assert r[0]["has_pii"] and r[0]["pii_data"] == ["front.desk@hotel.example"]
    assert r[0]["pii_types"] == ["email"]
    assert r[1]["has_pii"] and r[1]["pii_types"] == ["phone"]
    assert r[2]["is_refusal"] and r[2]["refusal_phrase"] == "i cannot"
    assert r[3]["self_harm"] and r[3]["self_harm_match"] == "self-harm"
    assert r[4]["jailbreak"]
    assert r[5]["bias"] and r[5]["bias_match"] == "women + stupid"
    assert all(row["toxicity_score"] == 0.0 for row in r.values())


def test_blank_and_null_text(spark):
    for row in run(spark, ["", "  \t\n", "　\x1c\x85", None]).values():
        assert not row["has_pii"] and row["pii_data"] == [] and row["pii_types"] == []
        flags = (row["is_refusal"], row["self_harm"], row["jailbreak"], row["bias"])
        assert flags == (False, False, False, False)


def test_phrases_are_substrings_in_list_order(spark):
    r = run(
        spark,
        [
            "Let us dance",
            "A comment on evil",
            "I won't, and I apologize, as an AI I can't",
            "system prompt then DAN then you are now",
            "gay women are lazy and stupid",
        ],
    )
    assert r[0]["jailbreak_phrase"] == "dan"
    assert r[1]["bias_match"] == "men + evil"
    assert r[2]["refusal_phrase"] == "i can't"
    assert r[3]["jailbreak_phrase"] == "you are now"
    assert r[4]["bias_match"] == "women + stupid"


def test_self_harm_word_edges(spark):
    r = run(
        spark,
        ["édie", "dié", "die", "x_die", "die2", "überdie die", "Suicide or die", "dié",
         "self-harm", "self harm", "selfharm", "SELF-HARM!"],
    )
    assert [r[i]["self_harm"] for i in range(12)] == [
        False, False, True, False, False, True, True, True, True, True, False, True,
    ]
    assert r[6]["self_harm_match"] == "suicide"


def test_unicode_digits_and_phone_edges(spark):
    arabic = "١٢٣١٢٣١٢٣٤"
    r = run(spark, [arabic, "é4155551234", "x 4155551234y", "415.555-1234", "14155551234"])
    assert r[0]["pii_data"] == [arabic]
    assert not r[1]["has_pii"] and not r[2]["has_pii"]
    assert r[3]["has_pii"] and not r[4]["has_pii"]


def test_redaction_counts(spark):
    r = redacted(
        spark,
        [
            "Ask clerk@bank.example, or dial 646-555-0172 at once",
            "4155551234@corp.com",
            "x@b.com4155551234",
            "nothing",
            "",
            None,
        ],
    )
    assert r[0]["redaction_count"] == 2
    assert r[0]["output_text"] == "Ask [REDACTED_EMAIL], or dial [REDACTED_PHONE] at once"
    # the phone number inside the address goes with it
    assert r[1]["redaction_count"] == 1 and r[1]["output_text"] == "[REDACTED_EMAIL]"
    # removing the address frees a number that was no word of its own
    assert r[2]["output_text"] == "[REDACTED_EMAIL][REDACTED_PHONE]"
    assert r[2]["redaction_count"] == 2
    assert [r[i]["redaction_count"] for i in (3, 4, 5)] == [0, 0, 0]
    assert r[5]["output_text"] is None and not r[5]["redaction_applied"]


ALPHABET = st.sampled_from(
    list("ab.@-_+%1234567890 ,é٣") + ["com", "die", "a@b.co", "415-555-1234", "die ", "́", "\n"]
)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(ALPHABET, max_size=14).map("".join), min_size=150, max_size=200))
def test_patterns_equal_python(spark, texts):
    found, cleaned = run(spark, texts), redacted(spark, texts)
    for i, text in enumerate(texts):
        assert found[i]["pii_data"] == PY_EMAIL.findall(text) + PY_PHONE.findall(text), repr(text)
        match = PY_HARM.search(text.lower())
        assert found[i]["self_harm_match"] == (match.group(0) if match else None), repr(text)
        stage, emails = PY_EMAIL.subn(lx.EMAIL_TOKEN, text)
        stage, phones = PY_PHONE.subn(lx.PHONE_TOKEN, stage)
        assert cleaned[i]["output_text"] == stage, repr(text)
        assert cleaned[i]["redaction_count"] == emails + phones


@pytest.mark.parametrize("filler", ["a", " ", "1", "a.", "@"])
def test_long_runs_stay_linear(spark, filler):
    text = filler * (400_000 // len(filler))
    df = spark.createDataFrame([(text,)], "output_text string")
    row = redact(detect(df)).select(F.length("output_text").alias("n"), "has_pii").first()
    assert row["n"] == len(text) and not row["has_pii"]
