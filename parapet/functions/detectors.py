"""Detectors over one text column. No Python code runs per row here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parapet import lexicon as lx
from parapet.functions.text import first_phrase


def emails(text: Column) -> Column:
    # the byte search for "@" spares most texts the regex
    hits = F.when(
        text.contains("@"), F.regexp_extract_all(text, F.lit(lx.EMAIL_REGEX), F.lit(0))
    )
    return F.coalesce(hits, F.array().cast("array<string>"))


def phones(text: Column) -> Column:
    hits = F.regexp_extract_all(text, F.lit(lx.PHONE_REGEX), F.lit(0))
    return F.coalesce(hits, F.array().cast("array<string>"))


def pii_data(email_hits: Column, phone_hits: Column) -> Column:
    return F.concat(email_hits, phone_hits)


def pii_types(email_hits: Column, phone_hits: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(F.size(email_hits) > 0, F.lit("email")),
            F.when(F.size(phone_hits) > 0, F.lit("phone")),
        )
    )


def without_emails(text: Column, email_hits: Column) -> Column:
    return F.when(
        F.size(email_hits) > 0, F.regexp_replace(text, lx.EMAIL_REGEX, lx.EMAIL_TOKEN)
    ).otherwise(text)


def redacted_phone_count(no_emails: Column, email_hits: Column, phone_hits: Column) -> Column:
    # removing an email can free or swallow a phone number, so count again then
    return F.when(
        F.size(email_hits) > 0, F.regexp_count(no_emails, F.lit(lx.PHONE_REGEX))
    ).otherwise(F.size(phone_hits))


def without_phones(no_emails: Column, phone_count: Column) -> Column:
    return F.when(
        phone_count > 0, F.regexp_replace(no_emails, lx.PHONE_REGEX, lx.PHONE_TOKEN)
    ).otherwise(no_emails)


def refusal_phrase(lowered: Column) -> Column:
    return first_phrase(lowered, lx.REFUSAL_PHRASES)


def jailbreak_phrase(lowered: Column) -> Column:
    return first_phrase(lowered, lx.JAILBREAK_PHRASES)


def self_harm_match(lowered: Column) -> Column:
    """Leftmost self-harm term."""
    return F.nullif(F.regexp_extract(lowered, lx.SELF_HARM_REGEX, 0), F.lit(""))


def bias_descriptor(lowered: Column) -> Column:
    return first_phrase(lowered, lx.BIAS_DESCRIPTORS)


def bias_match(lowered: Column, descriptor: Column) -> Column:
    """``"group + descriptor"`` when the text holds one of each."""
    # descriptors are rare, so they decide whether the groups are looked for at all
    group = F.when(descriptor.isNotNull(), first_phrase(lowered, lx.BIAS_GROUPS))
    return F.concat(group, F.lit(" + "), descriptor)
