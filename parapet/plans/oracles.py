"""The same queries as plain SQL, written for another engine and its own regex dialect."""

from __future__ import annotations

from parapet import lexicon as lx
from parapet.plans.corpus import AS_OF, BATCH_TIME, SEED_PREFIXES, SEED_SIGNALS
from parapet.operators.metrics import recent_cutoff

ORACLES: dict[str, str] = {}


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _seed_text() -> str:
    cases = []
    for i, template in enumerate(SEED_PREFIXES):
        text = f"replace({_quote(template)}, '{{id}}', doc_id::VARCHAR)"
        text = f"replace({text}, '{{line}}', lpad((doc_id % 10000)::VARCHAR, 4, '0'))"
        cases.append(f"WHEN {i} THEN {text}")
    return f"CASE doc_id % 8 {' '.join(cases)} END || ' ' || text"


_DAY = "(CASE WHEN (doc_id * 7 % 45) % 9 = 4 THEN doc_id * 7 % 45 - 1 ELSE doc_id * 7 % 45 END)"
SEEDED = f"""seeded AS (
  SELECT doc_id AS id, 'Prompt ' || doc_id AS input_text, {_seed_text()} AS output_text,
    CASE WHEN doc_id % 17 = 0 THEN NULL WHEN doc_id % 19 = 0 THEN '' ELSE source END
      AS project_name,
    'model-' || lang AS model_name, 'user-' || (doc_id % 50) AS user_id,
    'req-' || doc_id AS request_id,
    ' ' || lang || ' ,' || source || CASE WHEN doc_id % 3 = 0 THEN ', demo ,' ELSE ',' END
      AS raw_tags,
    CASE WHEN doc_id % 3 = 0 THEN [lang, source, 'demo'] ELSE [lang, source] END AS tags,
    CASE WHEN doc_id % 101 <> 0 THEN strftime(TIMESTAMP '2024-01-01 00:00:00'
      + to_days({_DAY}::INTEGER) + to_minutes(doc_id % 1440), '%Y-%m-%dT%H:%M:%S') END
      AS raw_time,
    (doc_id % 101)::DOUBLE / 100 AS toxicity_score,
    ((doc_id % 201) - 100)::DOUBLE / 100 AS sentiment_score
  FROM documents)"""

_EMAIL = r"'[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}'"
_PHONE = r"'\b\d{3}[-.]?\d{3}[-.]?\d{4}\b'"
_HARM = (
    r"'(?:^|[^\pL\pN_])(suicide|kill myself|end my life|self[- ]harm|cut myself|overdose|die)"
    r"(?:$|[^\pL\pN_])'"
)


def _first(text: str, phrases: list[str]) -> str:
    cases = " ".join(f"WHEN contains({text}, {_quote(p)}) THEN {_quote(p)}" for p in phrases)
    return f"CASE {cases} END"


def signals(source: str, text: str, keep: str, scores: bool = False) -> str:
    """CTEs that end in ``found``: the evidence of each signal for ``text`` of ``source``."""
    extra = "" if scores else ", 0.0::DOUBLE AS toxicity_score, 0.0::DOUBLE AS sentiment_score"
    return rf"""lowered AS (SELECT {keep}{extra}, {text} AS body, lower({text}) AS lo FROM {source}),
matched AS (SELECT *,
    regexp_extract_all(body, {_EMAIL}) AS emails, regexp_extract_all(body, {_PHONE}) AS phones,
    {_first('lo', lx.REFUSAL_PHRASES)} AS refusal_phrase,
    nullif(regexp_extract(lo, {_HARM}, 1), '') AS self_harm_match,
    {_first('lo', lx.JAILBREAK_PHRASES)} AS jailbreak_phrase,
    {_first('lo', lx.BIAS_GROUPS)} || ' + ' || {_first('lo', lx.BIAS_DESCRIPTORS)} AS bias_match,
    regexp_replace(body, {_EMAIL}, '[REDACTED_EMAIL]', 'g') AS no_emails
  FROM lowered),
found AS (SELECT *, len(emails) + len(phones) > 0 AS has_pii,
    list_concat(emails, phones) AS pii_data,
    list_filter([CASE WHEN len(emails) > 0 THEN 'email' END,
      CASE WHEN len(phones) > 0 THEN 'phone' END], lambda x: x IS NOT NULL) AS pii_types,
    refusal_phrase IS NOT NULL AS is_refusal, self_harm_match IS NOT NULL AS self_harm,
    jailbreak_phrase IS NOT NULL AS jailbreak, bias_match IS NOT NULL AS bias,
    regexp_replace(no_emails, {_PHONE}, '[REDACTED_PHONE]', 'g') AS redacted,
    len(emails) + len(regexp_extract_all(no_emails, {_PHONE})) AS redaction_count
  FROM matched)"""


def labels(threshold: float = lx.TOXICITY_THRESHOLD) -> str:
    """CTE ``judged``: labels and explanations on top of ``found``."""
    return f"""judged AS (SELECT *, list_has_any(risk_labels, {lx.TRIGGER_LABELS}) AS flagged
  FROM (SELECT *,
    list_filter([CASE WHEN toxicity_score >= {threshold} THEN 'toxicity' END,
      CASE WHEN has_pii THEN 'pii' END, CASE WHEN self_harm THEN 'self_harm' END,
      CASE WHEN jailbreak THEN 'jailbreak' END, CASE WHEN bias THEN 'bias' END,
      CASE WHEN is_refusal THEN 'refusal' END], lambda x: x IS NOT NULL) AS risk_labels,
    list_filter([
      CASE WHEN toxicity_score >= {threshold}
        THEN printf('toxicity_score %.2f >= {threshold:.2f}', toxicity_score) END,
      CASE WHEN has_pii THEN 'PII detected (' || array_to_string(pii_types, ', ') || ')' END,
      'refusal phrase matched: ''' || refusal_phrase || '''',
      'self-harm keyword matched: ''' || self_harm_match || '''',
      'jailbreak phrase matched: ''' || jailbreak_phrase || '''',
      'bias match: ''' || bias_match || ''''], lambda x: x IS NOT NULL) AS risk_explanations
    FROM found))"""


FOUND = f"WITH {SEEDED}, {signals('seeded', 'output_text', '*', scores=True)}"
AUDITED = f"""{FOUND}, {labels()}, audited AS (
  SELECT * EXCLUDE (output_text, body, lo), redacted AS output_text,
    coalesce(raw_time, '{BATCH_TIME}') AS timestamp,
    coalesce(raw_time, '{BATCH_TIME}')::TIMESTAMP AS ts,
    CAST(coalesce(raw_time, '{BATCH_TIME}')::TIMESTAMP AS DATE) AS audit_date,
    redaction_count > 0 AS redaction_applied
  FROM judged)"""
RAW = f"WITH {SEEDED}"
PLAIN = f"WITH {signals('documents', 'text', 'doc_id, lang, text')}"
PAGES = f"WITH {signals('pages', 'html', 'page_id, html')}"

_LABELS = "array_to_string(risk_labels, '|') AS risk_labels"
_REASONS = "array_to_string(risk_explanations, '|') AS risk_explanations"
_TAGS = "array_to_string(tags, '|') AS tags"
_BODY = "md5(output_text) AS output_text_md5"
_SCORES = "round(toxicity_score, 6) AS toxicity_score, round(sentiment_score, 6) AS sentiment_score"
_FLAGS = "has_pii, is_refusal, self_harm, jailbreak, bias"
_STAMP = "'%Y-%m-%d %H:%M:%S.%f'"


def _add(**items: str) -> None:
    ORACLES.update(items)


# --- detectors and risk ----------------------------------------------------------

_add(
    detect_pii=f"""{FOUND} SELECT id, has_pii, array_to_string(pii_data, '|') AS pii_data,
      array_to_string(pii_types, '|') AS pii_types FROM found""",
    detect_pii_pages=f"""{PAGES} SELECT page_id, has_pii,
      array_to_string(pii_data, '|') AS pii_data FROM found""",
    redact_pii=f"""{FOUND} SELECT id, md5(redacted) AS output_text_md5,
      redaction_count::INTEGER AS redaction_count, redaction_count > 0 AS redaction_applied
      FROM found""",
    redact_pages=f"""{PAGES} SELECT page_id, md5(redacted) AS html_md5,
      redaction_count::INTEGER AS redaction_count FROM found""",
    detect_refusal=f"{FOUND} SELECT id, is_refusal, refusal_phrase FROM found",
    detect_self_harm=f"{FOUND} SELECT id, self_harm, self_harm_match FROM found",
    detect_jailbreak=f"{FOUND} SELECT id, jailbreak, jailbreak_phrase FROM found",
    detect_bias=f"{FOUND} SELECT id, bias, bias_match FROM found",
    detect_toxicity=f"{RAW} SELECT id, round(toxicity_score, 6) AS toxicity_score FROM seeded",
    detect_sentiment=f"{RAW} SELECT id, round(sentiment_score, 6) AS sentiment_score FROM seeded",
    model_scores="""SELECT doc_id, CASE WHEN length(text) % 7 = 3 THEN 0 ELSE
      round(((length(text) - length(replace(text, 'e', ''))) % 101)::DOUBLE / 100, 6) END
      AS toxicity_score, length(text) % 7 = 3 AS score_failed FROM documents""",
    lexicon_terms=r"""WITH terms AS (SELECT DISTINCT phrase FROM (
      SELECT unnest(regexp_split_to_array(lower(text), '[^\pL]+')) AS phrase FROM benchmark)
      WHERE length(phrase) >= 7),
    hits AS (SELECT doc_id, 'term ' || left(phrase, 1) AS signal, phrase
      FROM documents JOIN terms ON contains(lower(text), phrase))
    SELECT doc_id, signal, phrase FROM hits
      QUALIFY row_number() OVER (PARTITION BY doc_id, signal ORDER BY length(phrase), phrase) = 1""",
    analyze_output=f"{PLAIN} SELECT doc_id, {_FLAGS}, toxicity_score, sentiment_score FROM found",
    signal_totals=f"""{PLAIN} SELECT lang, count(*) AS texts,
      count(*) FILTER (has_pii) AS has_pii, count(*) FILTER (is_refusal) AS is_refusal,
      count(*) FILTER (self_harm) AS self_harm, count(*) FILTER (jailbreak) AS jailbreak,
      count(*) FILTER (bias) AS bias FROM found GROUP BY lang""",
    lexicon_join="WITH lo AS (SELECT doc_id, lower(text) AS t FROM documents), hits AS ("
    + " UNION ALL ".join(
        f"SELECT doc_id, '{name}' AS signal, {_first('t', phrases)} AS phrase FROM lo"
        for name, phrases in (
            ("refusal", lx.REFUSAL_PHRASES),
            ("jailbreak", lx.JAILBREAK_PHRASES),
            ("bias_group", lx.BIAS_GROUPS),
            ("bias_descriptor", lx.BIAS_DESCRIPTORS),
        )
    )
    + ") SELECT * FROM hits WHERE phrase IS NOT NULL",
    lexicon_compiled=f"""WITH lo AS (SELECT doc_id, lower(text) AS t FROM documents)
      SELECT doc_id, {_first('t', lx.JAILBREAK_PHRASES)} AS jailbreak,
      {_first('t', lx.BIAS_GROUPS)} AS bias_group FROM lo""",
    risk_labels=f"{AUDITED} SELECT id, {_LABELS}, flagged FROM audited",
    risk_explanations=f"{AUDITED} SELECT id, {_REASONS} FROM audited",
    audit_rows=f"""{AUDITED} SELECT id, timestamp, input_text, {_BODY}, {_SCORES}, {_FLAGS},
      {_LABELS}, {_REASONS}, array_to_string(pii_types, '|') AS pii_types, flagged,
      redaction_applied, redaction_count::INTEGER AS redaction_count, project_name, model_name,
      user_id, request_id, {_TAGS}, strftime(ts, {_STAMP}) AS ts,
      strftime(audit_date, '%Y-%m-%d') AS audit_date FROM audited""",
    audit_unredacted=f"""{RAW} SELECT id, {_BODY}, false AS redaction_applied,
      0::INTEGER AS redaction_count FROM seeded""",
    audit_threshold=f"{FOUND}, {labels(0.45)} SELECT id, flagged, {_REASONS} FROM judged",
    batch_summary=f"""{AUDITED} SELECT count(*) AS processed,
      count(*) FILTER (flagged) AS flagged FROM audited""",
)

_PAIRS = """turns AS (SELECT conv_id, turn, role, text,
    last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id
      ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS said FROM conversations),
  pairs AS (SELECT conv_id * 4294967296 + turn AS id, coalesce(said, '') AS input_text,
    text AS output_text, 'c' || conv_id || '-t' || turn AS request_id
    FROM turns WHERE role = 'assistant')"""
_add(
    audit_conversations=f"""WITH {_PAIRS}, {signals('pairs', 'output_text', '*')}, {labels()}
      SELECT id, md5(input_text) AS input_text_md5, md5(redacted) AS output_text_md5, request_id,
      flagged, {_LABELS}, {_REASONS} FROM judged""",
    audit_benchmark=f"""WITH {signals('benchmark', 'text', 'item_id')}, {labels()}
      SELECT item_id, flagged, {_LABELS} FROM judged""",
)

# --- normalising -----------------------------------------------------------------

_SPLIT = "list_filter(list_transform(string_split({0}, ','), lambda x: trim(x)), lambda x: x <> '')"
_BLANKED = f"""{SEEDED}, blanked AS (SELECT * EXCLUDE (input_text, output_text, project_name),
    CASE WHEN id % 5 = 0 THEN ' ' || chr(9) || ' ' || chr(10)
      ELSE ' ' || input_text || chr(12288) END AS input_text,
    CASE WHEN id % 7 = 0 THEN '' ELSE output_text END AS output_text,
    ' ' || project_name || ' ' AS project_name FROM seeded),
  trimmed AS (SELECT id, trim(input_text, ' ' || chr(9) || chr(10) || chr(12288)) AS input_text,
    regexp_replace(output_text, '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g') AS output_text,
    nullif(trim(project_name), '') AS project_name FROM blanked),
  checked AS (SELECT *, nullif(concat_ws('; ',
    CASE WHEN input_text = '' THEN 'input_text is required' END,
    CASE WHEN output_text = '' THEN 'output_text is required' END), '') AS reject_reason
    FROM trimmed)"""
_JSON_TAGS = (
    "'[' || array_to_string(list_transform(tags, lambda x: '\"' || x || '\"'), ', ') || ']'"
)
_IDENTITY = """CASE
    WHEN user_id % 5 = 0 THEN 'key:key-' || user_id
    WHEN user_id % 5 = 1 THEN 'key:tok-' || user_id
    WHEN user_id % 2 = 0 THEN 'ip:10.0.0.' || (user_id % 250)
    WHEN user_id % 7 <> 0 THEN 'ip:192.168.1.' || (user_id % 250)
    ELSE 'ip:unknown' END"""
_TITLES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lx.RISK_TITLES.items())
_PAGE_TITLES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lx.PAGE_TITLES.items())
_REASON = (
    "coalesce(nullif(array_to_string(list_transform(risk_labels, "
    f"lambda x: CASE x {_TITLES} ELSE x END), ', '), ''), 'None')"
)
_STATUS = "CASE WHEN flagged THEN 'Flagged' ELSE 'Safe' END"
_add(
    normalize_tags=f"""{RAW} SELECT id, array_to_string({_SPLIT.format('raw_tags')}, '|') AS tags
      FROM seeded""",
    shape_conversations=f"""{RAW} SELECT id, '' AS input_text, {_BODY}, user_id,
      NULL::VARCHAR AS project_name, '' AS tags FROM seeded""",
    fill_missing=f"""{RAW} SELECT id, coalesce(project_name, 'none') AS project_name, user_id,
      CASE WHEN id % 4 = 0 THEN 'batch|default' ELSE array_to_string(tags, '|') END AS tags
      FROM seeded""",
    fill_falsy=f"""{RAW} SELECT id, coalesce(nullif(project_name, ''), 'none') AS project_name,
      {_TAGS} FROM seeded""",
    fill_timestamp=f"{RAW} SELECT id, coalesce(raw_time, '{BATCH_TIME}') AS timestamp FROM seeded",
    quarantine_split=f"""WITH {_BLANKED} SELECT id, input_text, project_name, reject_reason
      FROM checked WHERE reject_reason IS NOT NULL""",
    accepted_rows=f"""WITH {_BLANKED} SELECT id, input_text, project_name, {_BODY}
      FROM checked WHERE reject_reason IS NULL""",
    decode_lists=f"""{RAW} SELECT id, CASE id % 5 WHEN 0 THEN '' WHEN 1 THEN ''
      WHEN 2 THEN '[' || model_name WHEN 3 THEN user_id ELSE array_to_string(tags, '|') END
      AS items FROM seeded""",
    encode_lists=f"{RAW} SELECT id, {_JSON_TAGS} AS tags_json FROM seeded",
    decode_flags="""SELECT doc_id, doc_id % 10 < 5 AS text_flag, n_chars % 2 <> 0 AS number_flag
      FROM documents""",
    result_view=f"""{AUDITED} SELECT id AS record_id, flagged, {_LABELS}, {_REASONS}, {_SCORES},
      {_FLAGS}, array_to_string(pii_types, '|') AS pii_types, redaction_applied,
      redaction_count::INTEGER AS redaction_count FROM audited""",
    parse_timestamps=f"""{RAW} SELECT id,
      CASE WHEN id % 9 <> 0 THEN strftime(raw_time::TIMESTAMP, {_STAMP}) END AS ts,
      CASE WHEN id % 9 <> 0 THEN strftime(raw_time::TIMESTAMP, '%Y-%m-%d') END AS audit_date
      FROM seeded""",
    status_labels=f"{AUDITED} SELECT id, {_STATUS} AS status FROM audited",
    risk_reasons=f"{AUDITED} SELECT id, {_REASON} AS risk_reason FROM audited",
    display_rows=f"""{AUDITED} SELECT timestamp, project_name, model_name, user_id, input_text,
      {_BODY}, {_SCORES}, {_FLAGS}, flagged, {_REASON} AS risk_reason FROM audited""",
    record_details=f"""{AUDITED} SELECT id, coalesce(nullif(project_name, ''), 'N/A')
      AS project_name, model_name, user_id, request_id, array_to_string(tags, ', ') AS tags,
      {_REASON} AS risk_reason, {_STATUS} AS status, {_REASONS},
      CASE WHEN redaction_applied THEN 'applied (' || redaction_count || ' match(es))' END
      AS redaction_note FROM audited""",
    client_identity=f"""SELECT event_id, substr(sha256({_IDENTITY}), 1, 16) AS identity
      FROM events""",
    ensure_columns=f"""{AUDITED} SELECT id, flagged, '' AS project_name, '' AS request_id,
      '' AS tags, '' AS risk_labels, false AS self_harm, false AS jailbreak, false AS bias,
      false AS redaction_applied, 0::INTEGER AS redaction_count FROM audited""",
    assign_ids="""SELECT count(*) AS rows, count(*) AS ids, 1::BIGINT AS low, count(*) AS high
      FROM documents""",
    union_sources=f"""WITH {SEEDED}, {_PAIRS}
      SELECT id, input_text, {_BODY}, request_id, {_TAGS} FROM seeded
      UNION ALL SELECT id, input_text, {_BODY}, request_id, '' FROM pairs""",
)

# --- filters ---------------------------------------------------------------------

_add(
    filter_flagged=f"{AUDITED} SELECT id, flagged FROM audited WHERE flagged",
    filter_equality=f"""{AUDITED} SELECT id, project_name, model_name FROM audited
      WHERE project_name = 'src3' AND model_name = 'model-en'""",
    filter_user=f"{AUDITED} SELECT id, user_id FROM audited WHERE user_id = 'user-7'",
    filter_search=f"""{RAW} SELECT id FROM seeded WHERE lower(input_text) LIKE
      '%user1_@corp%dial%' OR lower(output_text) LIKE '%user1_@corp%dial%'""",
    filter_all_tags=f"""{AUDITED} SELECT id, {_TAGS} FROM audited
      WHERE list_contains(tags, 'en') AND list_contains(tags, 'demo')""",
    filter_all_labels=f"""{AUDITED} SELECT id, {_LABELS} FROM audited a
      WHERE list_contains(a.risk_labels, 'pii') AND list_contains(a.risk_labels, 'jailbreak')""",
    filter_dates=f"""{AUDITED} SELECT id, timestamp FROM audited
      WHERE timestamp >= '2024-01-10T00:00:00' AND timestamp <= '2024-01-20T23:59:59.999999'""",
    filter_conjunction=f"""{AUDITED} SELECT id, timestamp, project_name FROM audited
      WHERE flagged AND model_name = 'model-en' AND list_contains(tags, 'demo')
      AND list_contains(risk_labels, 'jailbreak') AND timestamp >= '2024-01-05T00:00:00'
      AND timestamp <= '2024-02-10T23:59:59.999999'
      AND (lower(input_text) LIKE '%prompt 1%' OR lower(output_text) LIKE '%prompt 1%')""",
    board_status=f"{AUDITED} SELECT id FROM audited WHERE NOT flagged",
    board_regex=f"""{AUDITED} SELECT id FROM audited
      WHERE regexp_matches(output_text, '(?i)(REDACTED_PHONE|lazy and)')
      OR regexp_matches(input_text, '(?i)(REDACTED_PHONE|lazy and)')""",
    board_toxicity=f"""{RAW} SELECT id, round(toxicity_score, 6) AS toxicity_score FROM seeded
      WHERE toxicity_score >= 0.55""",
    board_choices=f"""{RAW} SELECT id, project_name, user_id FROM seeded
      WHERE project_name IN ('src1', 'src2', 'src3') AND model_name IN ('model-en', 'model-de')
      AND (id % 50) % 3 = 0""",
    board_any=f"""{AUDITED} SELECT id, {_LABELS} FROM audited a
      WHERE list_has_any(a.tags, ['de', 'demo'])
      AND list_has_any(a.risk_labels, ['bias', 'self_harm'])""",
    board_pii_refusal=f"""{AUDITED} SELECT id, 'pii' AS kind FROM audited WHERE has_pii
      UNION ALL SELECT id, 'refusal' FROM audited WHERE is_refusal""",
    board_calendar=f"""{AUDITED} SELECT id, timestamp FROM audited
      WHERE audit_date BETWEEN DATE '2024-01-31' AND DATE '2024-02-05'""",
    point_lookup=f"{AUDITED} SELECT id, timestamp, user_id FROM audited WHERE id = 42",
    non_empty=f"{RAW} SELECT id, project_name FROM seeded WHERE project_name <> ''",
    recent_24h=f"""{AUDITED} SELECT count(*) AS recent_24h FROM audited
      WHERE timestamp >= '{recent_cutoff(AS_OF)}'""",
)

# --- aggregates ------------------------------------------------------------------


def _rate(flag: str) -> str:
    return f"round(avg({flag}::INTEGER), 6)"


_ITEMS = "items AS (SELECT unnest(risk_labels) AS label FROM audited)"
_BINS = " UNION ALL ".join(
    f"SELECT '{name}' AS toxicity_bin, count(*) FILTER (toxicity_score "
    f"{'>=' if i == 0 else '>'} {low} AND toxicity_score <= {high}) AS count FROM seeded"
    for i, (name, low, high) in enumerate(lx.HISTOGRAM_BINS)
)
_add(
    metrics_overview=f"""{AUDITED} SELECT count(*) AS total, sum(flagged::INTEGER)::BIGINT
      AS flagged, round(avg(toxicity_score), 6) AS avg_toxicity,
      {_rate('is_refusal')} AS refusal_rate, {_rate('self_harm')} AS self_harm_rate,
      {_rate('jailbreak')} AS jailbreak_rate, {_rate('bias')} AS bias_rate,
      {_rate('has_pii')} AS pii_rate, max(timestamp) AS latest_timestamp,
      count(*) FILTER (timestamp >= '{recent_cutoff(AS_OF)}') AS recent_24h,
      round(sum(flagged::INTEGER)::DOUBLE / count(*), 6) AS flagged_rate FROM audited""",
    metrics_document=f"""{AUDITED}, {_ITEMS} SELECT (SELECT count(*) FROM audited) AS total,
      (SELECT count(*) FROM audited WHERE flagged) AS flagged, label, count(*) AS count
      FROM items GROUP BY label""",
    risk_counts=f"{AUDITED}, {_ITEMS} SELECT label, count(*) AS count FROM items GROUP BY label",
    label_profile=f"""{AUDITED} SELECT project_name, label, count(*) AS count FROM (
      SELECT coalesce(nullif(project_name, ''), '-') AS project_name,
      unnest(risk_labels) AS label FROM audited) GROUP BY ALL""",
    filtered_count=f"""{AUDITED} SELECT count(*) AS total FROM audited
      WHERE flagged AND list_contains(tags, 'demo')""",
    meta_values=f"""{AUDITED}, cells AS (
      SELECT 'projects' AS field, project_name AS value FROM audited WHERE project_name <> ''
      UNION SELECT 'models', model_name FROM audited UNION SELECT 'users', user_id FROM audited
      UNION SELECT 'tags', unnest(tags) FROM audited
      UNION SELECT 'risk_labels', unnest(risk_labels) FROM audited) SELECT * FROM cells""",
    meta_document=f"""{AUDITED} SELECT
      (SELECT string_agg(DISTINCT project_name, '|' ORDER BY project_name) FROM audited
        WHERE project_name <> '') AS projects,
      (SELECT string_agg(DISTINCT model_name, '|' ORDER BY model_name) FROM audited) AS models,
      (SELECT string_agg(DISTINCT user_id, '|' ORDER BY user_id) FROM audited) AS users,
      (SELECT string_agg(DISTINCT t, '|' ORDER BY t) FROM (SELECT unnest(tags) AS t
        FROM audited)) AS tags,
      (SELECT string_agg(DISTINCT t, '|' ORDER BY t) FROM (SELECT unnest(risk_labels) AS t
        FROM audited)) AS risk_labels""",
    option_values=f"{RAW} SELECT DISTINCT unnest(tags) AS value FROM seeded",
    kpis=f"""{AUDITED} SELECT count(*) AS total_audited, count(*) FILTER (flagged)
      AS flagged_risks, printf('%.1f%%', avg(is_refusal::INTEGER) * 100) AS refusal_rate,
      printf('%.1f%%', avg(self_harm::INTEGER) * 100) AS self_harm_rate,
      printf('%.3f', avg(toxicity_score)) AS avg_toxicity FROM audited""",
    shown_of_total=f"""{AUDITED} SELECT count(*) FILTER (toxicity_score >= 0.3
      AND list_contains(risk_labels, 'jailbreak')) AS shown, count(*) AS total FROM audited""",
    toxicity_histogram=f"{RAW} {_BINS}",
    status_counts=f"""{AUDITED} SELECT {_STATUS} AS status, count(*) AS count
      FROM audited GROUP BY 1""",
    label_counts=f"""{AUDITED}, items AS (SELECT unnest(risk_labels) AS label FROM audited
      WHERE model_name IN ('model-en', 'model-fr'))
      SELECT label, count(*) AS count FROM items GROUP BY label""",
    signal_breakdown=f"""{AUDITED}, {_ITEMS} SELECT label AS signal, count(*) AS count,
      round_even(count(*)::DOUBLE / sum(count(*)) OVER () * 100 * 10, 0)::DOUBLE / 10 AS percent
      FROM items GROUP BY label""",
    daily_volume=f"""{AUDITED}, days AS (SELECT unnest(generate_series(min(audit_date),
      max(audit_date), INTERVAL 1 DAY))::DATE AS d FROM audited)
      SELECT strftime(d, '%Y-%m-%d') AS day, count(id) AS count
      FROM days LEFT JOIN audited ON audit_date = d GROUP BY d""",
    incident_breakdown=f"""{AUDITED}, items AS (SELECT unnest(risk_labels) AS label FROM audited
      WHERE flagged) SELECT label, count(*) AS count FROM items GROUP BY label""",
    label_bars=f"""{AUDITED}, {_ITEMS} SELECT label, count(*) AS count,
      greatest(8, floor(count(*)::DOUBLE / max(count(*)) OVER () * 100 + 0.5))::INTEGER AS width
      FROM items GROUP BY label""",
)

# --- listings and reports --------------------------------------------------------

_NEWEST = "ORDER BY timestamp DESC, id DESC"
_LINE = """'- ' || timestamp || ' | #' || id || ' | ' || array_to_string(risk_labels, ', ')
  || ' | ' || coalesce(risk_explanations[1], '')"""


def _lines(section: int, texts: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT {section}, 0, {i}, {_quote(t)}" for i, t in enumerate(texts)
    )


_add(
    list_page=f"{AUDITED} SELECT id, timestamp, flagged FROM audited {_NEWEST} LIMIT 25 OFFSET 50",
    list_page_after=f"""{AUDITED} SELECT id, timestamp FROM audited
      WHERE timestamp < '2024-01-20T00:00:00' OR (timestamp = '2024-01-20T00:00:00' AND id < 0)
      {_NEWEST} LIMIT 40""",
    list_page_rows=f"""{AUDITED} SELECT id, timestamp, {_BODY}, {_LABELS} FROM audited
      {_NEWEST} LIMIT 50 OFFSET 50""",
    page_count=f"""{AUDITED} SELECT count(*) AS total,
      greatest(1, ceil(count(*) / 20.0))::BIGINT AS pages FROM audited WHERE flagged""",
    latest_logs=f"""{AUDITED} SELECT id, timestamp, {_TAGS} FROM audited WHERE NOT flagged
      {_NEWEST} LIMIT 1000""",
    top_flagged_of_page=f"""{AUDITED}, page AS (SELECT * FROM audited {_NEWEST} LIMIT 20)
      SELECT id, timestamp, coalesce(nullif(project_name, ''), '-') AS project,
      array_to_string(list_transform(risk_labels,
        lambda x: CASE x {_PAGE_TITLES} ELSE x END), '|') AS labels,
      coalesce(risk_explanations[1], 'No explanation provided') AS explanation
      FROM page WHERE flagged {_NEWEST} LIMIT 10""",
    incident_selection=f"""{AUDITED} SELECT id, timestamp, model_name FROM audited
      WHERE flagged AND model_name = 'model-en' AND timestamp >= '2024-01-08T00:00:00'
      {_NEWEST} LIMIT 150""",
    incident_timeline=f"{AUDITED} SELECT id, {_LINE} AS line FROM audited WHERE flagged",
    incident_report=f"""{AUDITED}, picked AS (SELECT *, row_number() OVER ({_NEWEST}) AS rank
      FROM audited WHERE flagged AND list_contains(risk_labels, 'bias') {_NEWEST} LIMIT 100),
      counts AS (SELECT label, count(*) AS n FROM (SELECT unnest(risk_labels) AS label
        FROM picked) GROUP BY label),
      blocks AS (SELECT rank, list_concat(list_concat([
        '### Incident #' || id, '- Timestamp: ' || timestamp,
        '- Project: ' || coalesce(nullif(project_name, ''), '-'), '- Model: ' || model_name,
        '- User: ' || user_id, '- Risk labels: ' || array_to_string(risk_labels, ', '),
        '- Explanations:'], list_transform(risk_explanations, lambda x: '  - ' || x)),
        ['- Input:', '  ```' || chr(10) || input_text || chr(10) || '  ```', '- Output:',
         '  ```' || chr(10) || output_text || chr(10) || '  ```', '']) AS block FROM picked),
      lines(section, rank, part, line) AS (
        {_lines(0, ['# Incident Report', f'_Generated (UTC): {AS_OF}_', '', '## Summary'])}
        UNION ALL SELECT 1, 0, 0, '- Records reviewed: ' || count(*) FROM picked
        UNION ALL SELECT 1, 0, 1, '- Flagged incidents: ' || count(*) FROM picked
        UNION ALL {_lines(2, ['', '## Filters', '- flagged_only: True', '- risk_label: bias',
                              '- limit: 100', '', '## Risk Breakdown'])}
        UNION ALL SELECT 3, row_number() OVER (ORDER BY n DESC, label), 0,
          '- ' || label || ': ' || n FROM counts
        UNION ALL {_lines(4, ['', '## Incident Timeline'])}
        UNION ALL SELECT 5, rank, 0, {_LINE} FROM picked
        UNION ALL {_lines(6, ['', '## Detailed Flagged Cases'])}
        UNION ALL SELECT 7, rank, i - 1, block[i] FROM
          (SELECT rank, block, unnest(range(1, len(block) + 1)) AS i FROM blocks))
      SELECT section::BIGINT AS section, rank::BIGINT AS rank, part::BIGINT AS part, line
      FROM lines""",
    incident_documents=f"""{AUDITED}, picked AS (SELECT * FROM audited WHERE flagged {_NEWEST}
      LIMIT 100) SELECT 'summary' AS kind, NULL::BIGINT AS id, count(*)::VARCHAR AS count,
      NULL::VARCHAR AS timestamp, NULL::VARCHAR AS first_label FROM picked
      UNION ALL SELECT 'record', id, NULL, timestamp, risk_labels[1] FROM picked""",
)

# --- evaluation ------------------------------------------------------------------

_GUESS = {
    "toxicity": f"toxicity_score >= {lx.TOXICITY_THRESHOLD}",
    "pii": "has_pii",
    "refusal": "is_refusal",
    "self_harm": "self_harm",
    "jailbreak": "jailbreak",
    "bias": "bias",
}


def _truth(signal: str) -> str:
    if signal == "toxicity":
        return "coalesce(toxic = 1, false)"
    return f"id % 8 IN ({', '.join(map(str, SEED_SIGNALS[signal]))})"


def _confusion(source: str, skip_toxicity: bool) -> str:
    parts = []
    for name in lx.EVAL_SIGNALS:
        if name == "toxicity" and skip_toxicity:
            parts.append(
                "SELECT 'toxicity' AS signal, true AS skipped, 0::BIGINT AS tp, 0::BIGINT AS fp,"
                " 0::BIGINT AS tn, 0::BIGINT AS fn"
            )
            continue
        guess, truth = f"({_GUESS[name]})", f"({_truth(name)})"
        parts.append(
            f"SELECT '{name}' AS signal, false AS skipped,"
            f" count(*) FILTER ({guess} AND {truth}) AS tp,"
            f" count(*) FILTER ({guess} AND NOT {truth}) AS fp,"
            f" count(*) FILTER (NOT {guess} AND NOT {truth}) AS tn,"
            f" count(*) FILTER (NOT {guess} AND {truth}) AS fn FROM {source}"
        )
    return " UNION ALL ".join(parts)


def _scored(source: str) -> str:
    p = "coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0)"
    r = "coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0)"
    return (
        f"SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1"
        f" FROM (SELECT *, {p} AS precision, {r} AS recall FROM ({source}))"
    )


_JUDGED = f"""{FOUND}, truth AS (SELECT found.*, toxic FROM found
  LEFT JOIN labels ON labels.doc_id = found.id)"""
_ROUNDED = """signal, skipped, tp, fp, tn, fn, round(precision, 6) AS precision,
  round(recall, 6) AS recall, round(f1, 6) AS f1"""
_SUMS = """SELECT 'combined' AS signal, false AS skipped, sum(tp)::BIGINT AS tp,
  sum(fp)::BIGINT AS fp, sum(tn)::BIGINT AS tn, sum(fn)::BIGINT AS fn"""
_EVAL = f"{_JUDGED} SELECT {_ROUNDED} FROM ({_scored(_confusion('truth', True))})"
_add(
    eval_confusion=f"{_JUDGED} {_confusion('truth', False)}",
    eval_metrics=_EVAL,
    metrics_roundtrip=_EVAL,
    eval_combined=f"""{_JUDGED}, counts AS ({_confusion('truth', True)})
      SELECT {_ROUNDED} FROM ({_scored(f'{_SUMS} FROM counts WHERE NOT skipped')})""",
    eval_gate=f"""{_JUDGED}, bare_text AS (SELECT seeded.* EXCLUDE (output_text),
        text AS output_text FROM seeded JOIN documents ON doc_id = id),
      {signals('bare_text', 'output_text', '*', scores=True)
       .replace('lowered AS', 'lowered2 AS').replace('FROM lowered)', 'FROM lowered2)')
       .replace('matched AS', 'matched2 AS').replace('FROM matched)', 'FROM matched2)')
       .replace('found AS', 'found2 AS')},
      truth2 AS (SELECT found2.*, toxic FROM found2 LEFT JOIN labels ON labels.doc_id = found2.id),
      old AS ({_scored(_confusion('truth', False))}),
      new AS ({_scored(_confusion('truth2', False))}),
      paired AS (SELECT old.signal, old.precision AS p0, old.recall AS r0, new.precision AS p1,
        new.recall AS r1 FROM old JOIN new USING (signal)
        WHERE signal NOT IN ('toxicity', 'bias')),
      drops AS (SELECT signal, 'precision' AS metric, p0 AS b, p1 AS c FROM paired
        UNION ALL SELECT signal, 'recall', r0, r1 FROM paired)
      SELECT signal, metric, round(b, 6) AS baseline, round(c, 6) AS current,
        round(b - c, 6) AS drop, 'regressed' AS reason, 0.05::DOUBLE AS allowed
      FROM drops WHERE b - c > 0.05
      UNION ALL SELECT 'toxicity', NULL, NULL, NULL, NULL, 'skipped', 0.05
      UNION ALL SELECT 'bias', NULL, NULL, NULL, NULL, 'missing', 0.05""",
)

# --- request log and jobs --------------------------------------------------------



def _quota(condition: str = "true", seconds: int = 86400) -> str:
    """CTE ``w``: every request that meets the condition with its window start and position."""
    return f"""WITH RECURSIVE r AS (SELECT user_id, event_id, ts,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events
    WHERE {condition}),
  w AS (SELECT user_id, event_id, ts, i, ts AS start, 1::BIGINT AS n FROM r WHERE i = 1
    UNION ALL SELECT r.user_id, r.event_id, r.ts, r.i,
      CASE WHEN r.ts - w.start >= INTERVAL {seconds} SECONDS THEN r.ts ELSE w.start END,
      CASE WHEN r.ts - w.start >= INTERVAL {seconds} SECONDS THEN 1 ELSE w.n + 1 END
    FROM w JOIN r ON r.user_id = w.user_id AND r.i = w.i + 1)"""


_QUOTA = f"""{_quota()}
  SELECT user_id::VARCHAR AS identity, event_id, n, n <= 5 AS allowed,
    greatest(0, 5 - n)::BIGINT AS remaining,
    greatest(0, (86400000000 - (epoch_us(ts) - epoch_us(start))) // 1000000)::BIGINT AS reset_s
  FROM w"""
_NEWEST_EVENTS = "(SELECT value FROM events ORDER BY ts DESC, event_id DESC LIMIT 2000)"


def _rank(ratio: float, source: str = _NEWEST_EVENTS) -> str:
    return f"""(SELECT printf('%.2f', v)::DOUBLE FROM (SELECT value AS v,
      row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM {source})
      WHERE i = round_even((n - 1)::DOUBLE * {ratio}, 0)::BIGINT)"""


_JOBS = """WITH updates AS (SELECT user_id::VARCHAR AS job_id, event_id AS seq, ts,
    CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'processing'
      WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS status,
    CASE WHEN event_type = 'error' THEN props END AS error
    FROM events WHERE event_type <> 'click'),
  ordered AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, seq) AS i
    FROM updates),
  born AS (SELECT job_id, max(i) AS b FROM ordered WHERE status = 'queued' GROUP BY job_id),
  life AS (SELECT o.* FROM ordered o JOIN born USING (job_id) WHERE i >= b),
  jobs AS (SELECT job_id, arg_max(status, i) AS status, min(ts) AS submitted_at,
    max(ts) FILTER (status = 'processing') AS started_at,
    max(ts) FILTER (status IN ('completed', 'failed')) AS finished_at,
    max(ts) AS updated_at, arg_max_null(error, i) AS error FROM life GROUP BY job_id)"""
_add(
    request_stats="""SELECT count(*) AS request_count,
      count(*) FILTER (event_type = 'error') AS error_count,
      round(count(*) FILTER (event_type = 'error')::DOUBLE / count(*), 6) AS error_rate
      FROM events""",
    request_status_codes="""SELECT CASE WHEN event_type = 'error' THEN '500' ELSE '200' END
      AS status_code, count(*) AS count FROM events GROUP BY 1""",
    latency_percentiles_all=f"""SELECT {_rank(0.50, 'events')} AS latency_ms_p50,
      {_rank(0.95, 'events')} AS latency_ms_p95""",
    latency_percentiles=f"""SELECT {_rank(0.50)} AS latency_ms_p50,
      {_rank(0.95)} AS latency_ms_p95""",
    quota_exempt="""SELECT event_id, CASE event_id % 5 WHEN 2 THEN '/audit' ELSE '/healthy' END
      AS path FROM events WHERE event_id % 5 IN (2, 4)""",
    quota_verdict=_QUOTA,
    quota_status_codes=f"""{_quota("event_type <> 'view'")} SELECT
      CASE WHEN w.n > 5 THEN '429' WHEN event_type = 'error' THEN '500' ELSE '200' END
      AS status_code, count(*) AS count
      FROM events LEFT JOIN w USING (event_id) GROUP BY 1""",
    quota_verdict_hot=_QUOTA,
    stream_quota=_QUOTA,
    job_latest=f"""{_JOBS} SELECT job_id, status, strftime(submitted_at, {_STAMP})
      AS submitted_at, strftime(started_at, {_STAMP}) AS started_at,
      strftime(finished_at, {_STAMP}) AS finished_at, strftime(updated_at, {_STAMP})
      AS updated_at, error FROM jobs""",
    job_status_counts=f"""{_JOBS} SELECT count(*) FILTER (status = 'queued') AS queued,
      count(*) FILTER (status = 'processing') AS processing,
      count(*) FILTER (status = 'completed') AS completed,
      count(*) FILTER (status = 'failed') AS failed FROM jobs""",
    runtime_snapshot=f"""{_JOBS} SELECT request_count, error_count,
      round(error_count::DOUBLE / request_count, 6) AS error_rate, latency_ms_p50, latency_ms_p95,
      status_codes, queued, processing, completed, failed
      FROM (SELECT count(*) AS request_count, count(*) FILTER (event_type = 'error') AS error_count
        FROM events),
      (SELECT {_rank(0.50)} AS latency_ms_p50, {_rank(0.95)} AS latency_ms_p95),
      (SELECT string_agg(code || '=' || n, '|' ORDER BY code) AS status_codes FROM (
        SELECT CASE WHEN event_type = 'error' THEN '500' ELSE '200' END AS code, count(*) AS n
        FROM events GROUP BY 1)),
      (SELECT count(*) FILTER (status = 'queued') AS queued,
        count(*) FILTER (status = 'processing') AS processing,
        count(*) FILTER (status = 'completed') AS completed,
        count(*) FILTER (status = 'failed') AS failed FROM jobs)""",
    job_ttl=f"""{_JOBS} SELECT job_id, status FROM jobs WHERE finished_at IS NULL
      OR finished_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 1 DAY""",
)

# --- sources, sinks and streams --------------------------------------------------

_TRIP = f"""{RAW} SELECT request_id, input_text, {_BODY}, project_name, model_name, user_id,
  {_TAGS}, raw_time AS timestamp FROM seeded"""
_ACCEPTED = f"""WITH {_BLANKED.rsplit('trimmed AS', 1)[0]}
  fine AS (SELECT * FROM blanked WHERE id % 11 <> 0 AND id % 5 <> 0 AND id % 7 <> 0),
  {signals('fine', 'output_text', '*', scores=False)
   .replace(', 0.0::DOUBLE AS toxicity_score, 0.0::DOUBLE AS sentiment_score', '')
   .replace('SELECT *, output_text', 'SELECT * REPLACE (0.0::DOUBLE AS toxicity_score), output_text')
  }, {labels()}"""
_add(
    csv_roundtrip=_TRIP.replace(
        "project_name, model_name", "nullif(project_name, '') AS project_name, model_name"
    ),
    jsonl_roundtrip=_TRIP,
    payload_batch=_TRIP,
    payload_quarantine=f"""{RAW} SELECT id AS number, outcome, output_text_md5 FROM (
      SELECT id, 'kept' AS outcome, {_BODY}, unnest([1, 2]) AS copy FROM seeded WHERE id % 9 <> 0
      UNION ALL SELECT id, 'malformed document', NULL, 1 FROM seeded WHERE id % 9 = 0)""",
    export_padded=f"""{AUDITED} SELECT id,
      md5(chr(32) || chr(32) || chr(9) || redacted || chr(32) || chr(10) || chr(32)) AS output_text_md5
      FROM audited""",
    append_twice="""SELECT count(*) AS stored, count(*) AS ids, count(*) AS requests,
      (1099511627776 + 1)::BIGINT AS first_id, count(*) FILTER (doc_id % 2 = 1) AS second_batch
      FROM documents""",
    batch_job=f"""{FOUND} SELECT count(*) AS processed,
      count(*) FILTER (has_pii OR self_harm OR jailbreak OR bias) AS flagged, count(*) AS stored,
      count(*) AS ids, 0::BIGINT AS no_project, count(*) AS exported FROM found""",
    labeled_reject="""SELECT outcome, count(*) AS count FROM (
      SELECT CASE WHEN doc_id % 13 = 0 THEN 'malformed record'
        WHEN doc_id % 8 IN (0, 1, 6) THEN 'true' ELSE 'false' END AS outcome FROM documents)
      GROUP BY outcome""",
    ingest_jobs=f"""{RAW} SELECT CASE WHEN reason IS NULL THEN 'completed' ELSE 'failed' END
      AS status, reason AS error, count(*) AS count FROM (
      SELECT CASE WHEN id % 11 = 0 THEN 'malformed record'
        WHEN id % 35 = 0 THEN 'input_text is required; output_text is required'
        WHEN id % 5 = 0 THEN 'input_text is required'
        WHEN id % 7 = 0 THEN 'output_text is required' END AS reason FROM seeded)
      GROUP BY reason""",
    upload_defaults=_TRIP.replace(
        "project_name, model_name",
        "coalesce(nullif(project_name, ''), 'uploads') AS project_name, model_name",
    ),
    audit_table_roundtrip=f"""{AUDITED} SELECT id, timestamp, {_BODY}, {_LABELS},
      strftime(audit_date, '%Y-%m-%d') AS audit_date FROM audited""",
    export_csv=f"""{AUDITED} SELECT id::VARCHAR AS id, timestamp,
      flagged::INTEGER::VARCHAR AS flagged,
      '[' || array_to_string(list_transform(risk_labels, lambda x: '"' || x || '"'), ', ') || ']'
      AS risk_labels, {_JSON_TAGS} AS tags, {_BODY} FROM audited""",
    export_import=f"""{AUDITED} SELECT id, timestamp, {_BODY}, flagged, has_pii,
      redaction_count::INTEGER AS redaction_count, round(toxicity_score, 6) AS toxicity_score,
      {_REASONS}, {_TAGS}, strftime(audit_date, '%Y-%m-%d') AS audit_date FROM audited""",
    export_filtered=f"""{AUDITED} SELECT id::VARCHAR AS id, flagged, is_refusal, {_LABELS}
      FROM audited WHERE NOT flagged AND model_name = 'model-en'""",
    labeled_roundtrip=f"""{RAW} SELECT input_text, coalesce(toxic = 1, false) AS label_toxicity,
      {', '.join(f'{_truth(s)} AS label_{s}' for s in lx.EVAL_SIGNALS if s != 'toxicity')}
      FROM seeded LEFT JOIN labels ON labels.doc_id = id""",
    stream_audit=f"""{AUDITED} SELECT id, timestamp, {_BODY}, flagged, {_LABELS}
      FROM audited""",
    stream_ingest=f"""{_ACCEPTED} SELECT request_id, input_text, md5(redacted)
      AS output_text_md5, {_LABELS} FROM judged""",
    stream_quarantine=f"""{RAW} SELECT reject_reason, count(*) AS count FROM (
      SELECT CASE WHEN id % 11 = 0 THEN 'malformed record'
        WHEN id % 35 = 0 THEN 'input_text is required; output_text is required'
        WHEN id % 5 = 0 THEN 'input_text is required'
        WHEN id % 7 = 0 THEN 'output_text is required' END AS reject_reason FROM seeded)
      WHERE reject_reason IS NOT NULL GROUP BY 1""",
    stream_daily=f"""{AUDITED} SELECT strftime(audit_date, '%Y-%m-%d') AS day,
      count(*) AS count, count(*) FILTER (flagged) AS flagged,
      round(avg(toxicity_score), 6) AS avg_toxicity FROM audited GROUP BY audit_date""",
)

_PATHS = """paths AS (SELECT '/' || event_type AS path, value AS v FROM events
  QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 2000),
ranks AS (SELECT path, v, row_number() OVER (PARTITION BY path ORDER BY v) - 1 AS i,
  count(*) OVER (PARTITION BY path) AS n FROM paths)"""


def _at(ratio: float) -> str:
    place = f"round_even((n - 1)::DOUBLE * {ratio}, 0)::BIGINT"
    return f"printf('%.2f', max(v) FILTER (i = {place}))::DOUBLE"


_BY_PATH = f"""WITH {_PATHS} SELECT path, {_at(0.50)} AS latency_ms_p50, {_at(0.95)} AS latency_ms_p95
  FROM ranks GROUP BY path"""
_add(
    latency_percentiles_by_path=_BY_PATH,
    stream_latency=_BY_PATH,
    stream_jobs=ORACLES["job_latest"],
    stream_job_counts=f"""{_JOBS}, left_ AS (SELECT status FROM jobs WHERE finished_at IS NULL
        OR epoch_ms(finished_at) + 1 + 86400000 > (SELECT epoch_ms(max(ts)) - 60000 FROM updates))
      SELECT count(*) FILTER (status = 'queued') AS queued,
      count(*) FILTER (status = 'processing') AS processing,
      count(*) FILTER (status = 'completed') AS completed,
      count(*) FILTER (status = 'failed') AS failed FROM left_""",
    stream_quota_live=f"""{_quota(seconds=3600)}, last AS (SELECT user_id, max(i) AS i FROM w GROUP BY user_id)
      SELECT user_id::VARCHAR AS identity, strftime(start, {_STAMP}) AS start, n AS seen
      FROM w JOIN last USING (user_id, i)
      WHERE start + INTERVAL 3 HOURS > (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 1 MINUTE""",
    stream_overview=ORACLES["metrics_overview"],
    stream_risk_counts=ORACLES["risk_counts"],
)


def _last_page(condition: str) -> str:
    return f"""{AUDITED}, chosen AS (SELECT id, timestamp FROM audited WHERE {condition})
      SELECT id, timestamp FROM chosen {_NEWEST}
      LIMIT 25 OFFSET (SELECT greatest(0, (count(*) // 25 - 1) * 25) FROM chosen)"""


_add(
    list_page_deep=_last_page("true"),
    list_page_deep_flagged=_last_page("flagged"),
    search_indexed=f"""{AUDITED} SELECT id FROM audited
      WHERE lower(input_text) LIKE '%or else [redacted_phone]%keys%'
      OR lower(output_text) LIKE '%or else [redacted_phone]%keys%'""",
    search_regex_indexed=ORACLES["board_regex"],
    model_scores_staged=ORACLES["model_scores"],
)
_add(
    incident_documents_written=f"""{AUDITED}, picked AS (SELECT * FROM audited WHERE flagged {_NEWEST}
      LIMIT 100) SELECT 'summary' AS kind, NULL::BIGINT AS id, count(*)::VARCHAR AS count,
      NULL::VARCHAR AS output_text_md5, '100' AS limit FROM picked
      UNION ALL SELECT 'record', id, NULL, md5(output_text), NULL FROM picked""",
    missing_fields="""SELECT CASE WHEN doc_id % 11 = 0 THEN 'input_text|output_text'
      ELSE concat_ws('|', CASE WHEN doc_id % 5 = 0 THEN 'input_text' END,
        CASE WHEN doc_id % 7 = 0 OR text IS NULL THEN 'output_text' END) END AS missing,
      count(*) AS count FROM documents GROUP BY 1""",
    rows_in_memory=f"""{AUDITED}, held AS (SELECT * FROM audited {_NEWEST} LIMIT 400)
      SELECT input_text, {_BODY}, CASE WHEN id % 2 = 1 THEN project_name END AS project_name,
      CASE WHEN id % 2 = 1 THEN request_id END AS request_id,
      CASE WHEN id % 2 = 1 THEN array_to_string(tags, '|') ELSE '' END AS tags,
      CASE WHEN id % 2 = 1 THEN timestamp END AS timestamp FROM held""",
)
