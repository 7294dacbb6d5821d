"""Matching text against a lexicon given as a table ``(signal, ord, phrase)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parapet import lexicon as lx
from parapet.functions.text import first_phrase
from parapet.session import cut_lineage

MATCHES = "array<struct<signal:string,ord:bigint,phrase:string>>"


def builtin_lexicon(spark) -> DataFrame:
    """The built-in phrase lists as a table."""
    lists = {
        "refusal": lx.REFUSAL_PHRASES,
        "jailbreak": lx.JAILBREAK_PHRASES,
        "bias_group": lx.BIAS_GROUPS,
        "bias_descriptor": lx.BIAS_DESCRIPTORS,
    }
    rows = [(s, i, p) for s, phrases in lists.items() for i, p in enumerate(phrases)]
    return spark.createDataFrame(rows, "signal string, ord bigint, phrase string")


def compiled_matches(text: Column, lexicon: dict[str, list[str]]) -> dict[str, Column]:
    """A small lexicon as column expressions: first phrase per signal, JVM-side."""
    lowered = F.lower(text)
    return {signal: first_phrase(lowered, phrases) for signal, phrases in lexicon.items()}


# Phrases that are matched by expressions; beyond, by a join over grams of this length.
COMPILED_PHRASES = 200
GRAM = 8


def match_lexicon(
    df: DataFrame, lexicon: DataFrame, text: str = "text", compiled: int = COMPILED_PHRASES
) -> DataFrame:
    """Add ``matches``: per signal the first phrase (lowest ``ord``) found in the text.

    Phrases are substrings of the lower-cased text. A lexicon of at most ``compiled`` phrases
    becomes column expressions in one narrow plan; a larger one stays a table, see
    ``_joined``. Both give the same matches, and nothing runs outside the JVM.
    """
    usable = lexicon.select("signal", F.col("ord").cast("bigint").alias("ord"), "phrase").filter(
        "phrase != ''"
    )
    rows = usable.limit(compiled + 1).collect()
    return _compiled(df, rows, text) if len(rows) <= compiled else _joined(df, usable, text)


def _compiled(df: DataFrame, rows: list, text: str) -> DataFrame:
    lists: dict[str, list] = {}
    for row in sorted(rows, key=lambda r: (r["ord"], r["phrase"])):
        lists.setdefault(row["signal"], []).append(row)
    found = []
    for signal, own in sorted(lists.items()):
        entry = lambda r: F.struct(
            F.lit(r["signal"]).alias("signal"), F.lit(r["ord"]).cast("bigint").alias("ord"),
            F.lit(r["phrase"]).alias("phrase"),
        )
        lowered = F.col("_lowered")
        found.append(F.coalesce(*[F.when(lowered.contains(r["phrase"]), entry(r)) for r in own]))
    matches = F.array_compact(F.array(*found)) if found else F.array()
    lowered = df.withColumn("_lowered", F.lower(text)).withColumn("_matches", matches.cast(MATCHES))
    # the one-row generator keeps filters on the matches, also inferred ones, from copying the searches
    return lowered.withColumn("matches", F.explode(F.array("_matches"))).drop("_lowered", "_matches")


# Letters of a text that are cut into grams at a time.
PIECE = 1 << 18
# Bits of a bitmap for each of its grams, and the least and the most in all (eight megabytes).
BITS_EACH, LEAST_BITS, MOST_BITS = 1024, 1 << 15, 1 << 26
_BUCKET_BYTES = 4096


def _place(gram: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(bits))


def gram_bitmap(grams: DataFrame, bits: int) -> Column:
    """A scalar subquery: the bitmap of the hashes of ``_gram``, as an array of 32-bit words.

    Bits are gathered per task into buckets of 32,768 (``bitmap_construct_agg``), so one row for
    each bucket is all that moves, however many grams there are.
    """
    place = _place(F.col("_gram"), bits) + 1
    filled = grams.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")
    )
    every = grams.sparkSession.range(1, bits // (8 * _BUCKET_BYTES) + 1).toDF("bucket").join(filled, "bucket", "left")
    word = lambda i: F.conv(F.hex(F.substring(F.col("bits"), i * 4 + 1, F.lit(4))), 16, 10).cast("bigint")
    empty = F.array_repeat(F.lit(0).cast("bigint"), _BUCKET_BYTES // 4)
    numbered = F.transform(F.sequence(F.lit(0), F.lit(_BUCKET_BYTES // 4 - 1)), word)
    words = F.when(F.col("bits").isNull(), empty).otherwise(numbered)
    rows = F.array_sort(F.collect_list(F.struct("bucket", words.alias("words"))))
    return every.agg(F.flatten(F.transform(rows, lambda r: r["words"]))).scalar()


def in_bitmap(gram: Column, bitmap: Column, bits: int) -> Column:
    """Whether a gram's bit is set: always so for a gram of the bitmap, seldom for another."""
    place = _place(gram, bits)
    # bit 0 is the lowest of a byte, byte 0 the highest of a word
    low = (3 - F.shiftright(place, 3).bitwiseAND(F.lit(3))) * 8 + place.bitwiseAND(F.lit(7))
    word = F.get(bitmap, F.shiftright(place, 5).cast("int"))
    return F.call_function("bit_get", word, low.cast("int")) == 1


def _pieces(lowered: Column, overlap: int) -> Column:
    """A text in pieces that share ``overlap`` letters, so that no gram is lost at a border."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(lowered) - 1, F.lit(0)), F.lit(PIECE))
    cut = F.transform(starts, lambda at: F.substring(lowered, at + 1, F.lit(PIECE + overlap)))
    return F.when(F.length(lowered) <= PIECE, F.array(lowered)).otherwise(cut)


def candidate_grams(rows: DataFrame, lexicon: DataFrame, text: str) -> DataFrame:
    """Distinct ``(_row, _gram)``: substrings of the lower-cased text that may be a gram of the lexicon.

    A phrase's gram is its first ``GRAM`` letters, or all of it. Substrings are tested against the bitmap
    in the task that makes them; only those that pass it are shuffled.
    """
    counts = lexicon.groupBy(F.length("_gram").alias("n")).agg(F.count_distinct("_gram").alias("grams")).collect()
    lengths = sorted(r["n"] for r in counts)  # at most GRAM rows
    grams = sum(r["grams"] for r in counts)
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * grams).bit_length()))
    pieces = rows.select("_row", F.explode(_pieces(F.lower(text), GRAM - 1)).alias("_piece"))
    found = [F.regexp_extract_all("_piece", F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in lengths]
    every = pieces.select("_row", F.explode(F.concat(*found)).alias("_gram"))
    return every.filter(in_bitmap(F.col("_gram"), gram_bitmap(lexicon.select("_gram"), bits), bits)).distinct()


def _joined(df: DataFrame, lexicon: DataFrame, text: str) -> DataFrame:
    """Texts and phrases meet on grams, see ``candidate_grams``.

    Candidates number about as many as there are true ones. A row's candidate phrases then join
    its text once, where those longer than a gram are verified. Rows are stored with a
    number first, so that both joins see the same one.
    """
    keyed = lexicon.withColumn("_gram", F.left("phrase", F.lit(GRAM)))
    rows = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()), "lexicon")
    entry = F.struct("signal", "ord", "phrase")
    if keyed.isEmpty():
        return rows.withColumn("matches", F.array().cast(MATCHES)).drop("_row")
    grams = candidate_grams(rows, keyed, text)
    candidates = grams.join(keyed, "_gram").groupBy("_row").agg(F.collect_set(entry).alias("_found"))
    joined = rows.join(candidates, "_row", "left").withColumn("_lowered", F.lower(text))
    sure = F.filter(
        "_found", lambda m: (F.length(m["phrase"]) <= GRAM) | F.col("_lowered").contains(m["phrase"])
    )
    kept = F.coalesce(sure, F.array().cast(MATCHES)).cast(MATCHES)
    # a projection of its own, as the lambdas below read it several times
    joined = joined.withColumn("_all", F.explode(F.array(kept)))
    return joined.withColumn("matches", _first_per_signal(F.col("_all"))).drop(
        "_row", "_found", "_lowered", "_all"
    )


def _first_per_signal(matches: Column) -> Column:
    signals = F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["signal"])))

    def first(signal: Column) -> Column:
        return F.array_min(F.filter(matches, lambda m: m["signal"] == signal))

    return F.transform(signals, first)
