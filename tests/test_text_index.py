"""Searches by signature against the plain predicates."""

import random
import re

import pytest
from pyspark.sql import functions as F

from parapet.operators import text_index as ti
from parapet.operators.filters import search_like, search_regex
from tests.plans import total_of

SCHEMA = "id long, timestamp string, audit_date date, input_text string, output_text string"
WORDS = "Refund invoice KELVIN straße Straẞe Kelvin İstanbul ıstanbul miſs miss Ärger 100% a_b a-b (x) Σς naïve overdose api key".split()


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("text"))
    pick = random.Random(4)
    rows = []
    for i in range(400):
        text = [" ".join(pick.choice(WORDS) for _ in range(pick.randrange(4))) for _ in range(2)]
        text = [t.upper() if pick.random() < 0.2 else None if pick.random() < 0.1 else t for t in text]
        if i == 77:
            text[1] = "x" * 70_000 + "needle in hay" + "y" * 70_000
        day = None if i % 29 == 0 else f"2024-01-0{i % 5 + 1}"
        rows.append((i, day and f"{day}T00:00:{i % 60:02d}", *text))
    df = spark.createDataFrame(rows, "id long, timestamp string, input_text string, output_text string")
    df = df.withColumn("audit_date", F.to_date("timestamp"))
    df.repartition(3).sortWithinPartitions("timestamp").write.partitionBy("audit_date").parquet(f"{folder}/t")
    stored = spark.read.schema(SCHEMA).parquet(f"{folder}/t")
    ti.write_signatures(stored, f"{folder}/s")
    return stored, ti.read_signatures(spark, f"{folder}/s")


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


TERMS = ["refund", "REFUND inv", "kelvin", "istanbul", "İstan", "miss", "100%", "a_b", "%", "", "ab", "ref%voice", "needle in", "straße", "σς", "ärger", "no such thing", "x\\y"]


@pytest.mark.parametrize("few", [2000, 3])
def test_like(table, few):
    df, index = table
    for term in TERMS:
        assert ids(ti.find_like(df, index, term, few)) == ids(df.filter(search_like(term))), term


PATTERNS = [
    "refund", "refund|overdose", "(api|pii) ?key", "kelvin", "istanbul", "miss", "mis{1,2} ", "(?:refund )+inv", "over.?dose",
    "^refund", "key$", r"\brefund\b", r"100%", r"a[_-]b", "[r]efund", "re(fund)?", "(refund|x)", "straße", "needle\\s+in", "ref.*voice", "(?i)refund", "refu+nd", "(x|y|z)(refund|invoice)?",
    r"\(x\)", "refund(?= inv)", "a|", "colou*r", "Ä.ger", "(over(dose|load) )+", "[^]]refund", r"\x41", "\\Qab\\E",
]


@pytest.mark.parametrize("few", [2000, 3])
def test_regex(table, few):
    df, index = table
    for pattern in PATTERNS:
        assert ids(ti.find_regex(df, index, pattern, few)) == ids(df.filter(search_regex(pattern))), pattern


def test_trigrams_of_patterns():
    assert ti.regex_trigrams("refund|overdose") == [ti._trigrams("refund"), ti._trigrams("overdose")]
    assert ti.regex_trigrams("(api|pii) key") == [ti._trigrams("api") | ti._trigrams(" key"), ti._trigrams("pii") | ti._trigrams(" key")]
    assert ti.regex_trigrams("refu+nd") == [{"ref"}]
    for pattern in ("ab", "abc|d", "a.b.c", "(abc)?", "(abc)*", "a{3}", "(?=abc)", "[abc]", "abc)", "(abc", "abc{", "\\p{L}abc"):
        assert ti.regex_trigrams(pattern) is None, pattern


def test_random_patterns_need_their_trigrams():
    """Whatever a pattern matches holds the trigrams asked for."""
    pick = random.Random(9)
    tried = 0
    for _ in range(20_000):
        pattern = "".join(pick.choice(["a", "b", "c", "ab", "abc", "(", ")", "|", "?", "*", "+", "{2}", ".", "[ab]", "(?:", "\\b"]) for _ in range(pick.randrange(1, 9)))
        needed = ti.regex_trigrams(pattern)
        if needed is None:
            continue
        try:
            found = re.compile(pattern)
        except re.error:
            continue
        for _ in range(20):
            text = "".join(pick.choice("abc ") for _ in range(12))
            if found.search(text):
                tried += 1
                assert any(all(t in text for t in trigrams) for trigrams in needed), (pattern, text)
    assert tried > 300


def test_fewer_bytes_are_read(spark, tmp_path):
    """One matching day of forty: its files alone are read, and signatures are narrow."""
    text = F.concat(F.repeat(F.md5(F.col("id").cast("string")), 40), F.when(F.col("id") == 4321, F.lit(" zanzibar ")).otherwise(F.lit("")))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 40).cast("int"))
    rows = spark.range(8000).select(
        "id", F.concat(day.cast("string"), F.lit("T00:00:00")).alias("timestamp"), day.alias("audit_date"),
        F.lit("").alias("input_text"), text.alias("output_text"),
    )
    rows.repartition(4, "audit_date").write.partitionBy("audit_date").parquet(str(tmp_path / "t"))
    df = spark.read.schema(SCHEMA).parquet(str(tmp_path / "t"))
    ti.write_signatures(df, str(tmp_path / "s"))
    index = ti.read_signatures(spark, str(tmp_path / "s"))
    found, plain = ti.find_like(df, index, "Zanzibar"), df.filter(search_like("Zanzibar"))
    assert ids(found) == ids(plain) == [4321]
    found, plain = found.select("id"), plain.select("id")
    assert found.collect() and plain.collect()
    assert total_of(found, "Scan parquet", "filesSize") < total_of(plain, "Scan parquet", "filesSize") / 20


def test_empty(spark, table):
    df, index = table
    assert ids(ti.find_like(df.limit(0), index, "refund")) == []
    assert ids(ti.find_like(df, index.limit(0), "refund")) == []
    nothing = ti.signatures(spark.createDataFrame([(1, None, None, None, None)], SCHEMA)).first()
    assert nothing["id"] == 1 and not any(nothing[f"s{i}"] for i in range(ti.WORDS))


def test_signatures_are_made_in_the_task(spark, table):
    """A row leaves its task as a signature, not as one row for each trigram; its bits are those of its texts."""
    df, index = table
    plan = ti.signatures(df)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan
    lower = F.lower(F.translate(F.concat_ws("é", "input_text", "output_text"), "İıſK", "iisk"))
    texts = {r[0]: r[1] for r in df.select("id", lower).collect()}
    assert index.count() == len(texts)
    for r in index.collect():
        bits = {64 * i + j for i in range(ti.WORDS) for j in range(64) if r[f"s{i}"] >> j & 1}
        text = texts[r["id"]]
        wanted = {text[i : i + 3] for i in range(len(text) - 2)}
        assert bits == {ti._place(t) for t in wanted if t.isascii()}, r["id"]
