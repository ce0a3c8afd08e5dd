"""DuckDB statements of the queries that SQL can express over whole tables.

Formulas are written apart from the columns they check: checksums from tables
of weights, places of matches from lists of gaps.
"""

from __future__ import annotations

import re

from .. import vocab


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def spans(t: str, p: str) -> str:
    """List of ``{v, s, e}`` of matches, places from 0."""
    m, g = f"regexp_extract_all({t}, {_q(p)})", f"string_split_regex({t}, {_q(p)})"
    before = f"list_sum(list_transform(({g})[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(({m})[1:i-1], lambda x: length(x))), 0)"
    return f"CASE WHEN regexp_matches({t}, {_q(p)}) THEN list_transform(range(1, len({m}) + 1), lambda i: {{'v': ({m})[i], 's': ({before})::BIGINT, 'e': ({before})::BIGINT + length(({m})[i])}}) ELSE [] END"


def runs(t: str, n: int) -> str:
    """Runs of exactly ``n`` digits: all runs of digits, the others left out."""
    return f"list_filter({spans(t, r'[\p{Nd}]+')}, lambda x: length(x.v) = {n})"


def window(t: str, a: str, b: str) -> str:
    return f"substr({t}, greatest({a}, 0)::BIGINT + 1, greatest({b} - greatest({a}, 0), 0)::BIGINT)"


def any_of(t: str, words) -> str:
    return "(" + " OR ".join(f"contains({t}, {_q(w)})" for w in words) + ")"


def hits(t: str, words) -> str:
    return "(" + " + ".join(f"contains({t}, {_q(w)})::INT" for w in words) + ")"


def not_demo(low: str = "low") -> str:
    return f"NOT {any_of(window(low, 'x.s - 200', 'x.e + 200'), vocab.DEMO_WORDS)}"


def near(words, radius: int, low: str = "low") -> str:
    return any_of(window(low, f"x.s - {radius}", f"x.s + {radius}"), words)


def digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '', 'g')"


def control(d: str, weights, mod: str) -> str:
    w = "[" + ", ".join(map(str, weights)) + "]"
    return f"list_sum(list_transform(range(1, {len(tuple(weights)) + 1}), lambda i: CAST(substr({d}, i, 1) AS INT) * ({w})[i])) {mod}"


_TEN = (2, 4, 10, 3, 5, 9, 4, 6, 8)


def snils(d: str) -> str:
    return f"(length({d}) = 11 AND CAST(substr({d}, 10, 2) AS INT) = ({control(d, range(9, 0, -1), '% 101 % 100')}))"


def inn10(d: str) -> str:
    return f"(length({d}) = 10 AND CAST(substr({d}, 10, 1) AS INT) = {control(d, _TEN, '% 11 % 10')})"


def inn12(d: str) -> str:
    return f"(length({d}) = 12 AND CAST(substr({d}, 11, 1) AS INT) = {control(d, (7, *_TEN), '% 11 % 10')} AND CAST(substr({d}, 12, 1) AS INT) = {control(d, (3, 7, *_TEN), '% 11 % 10')})"


def luhn(d: str) -> str:
    one = f"CAST(substr(reverse({d}), i, 1) AS INT)"
    return f"(length({d}) >= 13 AND list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {one} WHEN {one} > 4 THEN 2 * {one} - 9 ELSE 2 * {one} END)) % 10 = 0)"


TEXTS = "(SELECT content_id, coalesce(text, '') AS t, lower(coalesce(text, '')) AS low FROM extracted_content)"


def entity(spans_sql: str, holds: str, key: str, demo: bool = True) -> str:
    test = f"({holds})" + (f" AND {not_demo()}" if demo else "")
    return (
        f"WITH c AS {TEXTS}, f AS (SELECT content_id, len(list_distinct(list_transform(list_filter(sp, lambda x: {test}), lambda x: {key}))) AS n "
        f"FROM (SELECT content_id, low, {spans_sql} AS sp FROM c)) SELECT content_id, n::INT AS n FROM f"
    )


_D = digits("x.v")
_CARD_PREFIX = f"({_D} LIKE '4%' OR CAST(substr({_D}, 1, 2) AS INT) BETWEEN 51 AND 55 OR CAST(substr({_D}, 1, 4) AS INT) BETWEEN 2221 AND 2720 OR CAST(substr({_D}, 1, 4) AS INT) BETWEEN 2200 AND 2204)"


def _group(p: str) -> str:
    return f"regexp_extract(x.v, {_q(p)}, 1)"


_ACCOUNT = r"(?i)(?:р/с|расчетн(?:ый)?\s+счет|расч[её]тный\s+сч[её]т)[^\d]*(\d{20})"
_BIK = r"(?i)бик[^\d]*(\d{9})"


def _level(common, state, pay, bio, special) -> str:
    return f"CASE WHEN {special} <> 0 OR {bio} <> 0 THEN 'УЗ-1' WHEN {pay} <> 0 OR {state} >= 5 THEN 'УЗ-2' WHEN {state} <> 0 OR {common} >= 5 THEN 'УЗ-3' WHEN {common} <> 0 THEN 'УЗ-4' ELSE 'нет признаков' END"


_MAIL = r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[A-Za-z]{2,}\b"
_LOCAL, _DOMAIN = "split_part(lower(x.v), '@', 1)", "substr(lower(x.v), strpos(x.v, '@') + 1)"
_ROLE_PARTS = f"list_filter(string_split_regex({_LOCAL}, '[._+-]+'), lambda y: y <> '')"
_ROLES = "[" + ", ".join(map(_q, vocab.ROLE_LOCAL_PARTS)) + "]"
_MAIL_HOLDS = f"{_LOCAL} <> '' AND contains({_DOMAIN}, '.') AND NOT {_DOMAIN} LIKE '.%' AND NOT {_DOMAIN} LIKE '%.' AND NOT (len({_ROLE_PARTS}) > 0 AND len(list_filter({_ROLE_PARTS}, lambda z: NOT list_contains({_ROLES}, z))) = 0)"
_MAILS = entity(spans("t", _MAIL), _MAIL_HOLDS, "lower(x.v)")
_PHONE = r"(?:(?:\+7|8)[\s\p{Z}]*\(?[\p{Nd}]{3}\)?[\s\p{Z}-]?[\p{Nd}]{3}[\s\p{Z}-]?[\p{Nd}]{2}[\s\p{Z}-]?[\p{Nd}]{2})"
_PHONE_OWN = f"CASE WHEN length({_D}) = 11 AND substr({_D}, 1, 1) IN ('7', '8') THEN substr({_D}, 2) WHEN length({_D}) = 10 THEN {_D} ELSE '' END"


def _word(p: str) -> str:
    """A heading's pattern with word bounds spelled out, as the engine's own know ASCII letters only."""
    p = p.replace("(?iuU)", "(?i)")
    return re.sub(r"\\b(?=[a-zа-я])", r"(?:^|[^\\p{L}\\p{Nd}_])", p).replace(r"\b", r"(?:[^\p{L}\p{Nd}_]|$)")


_EVIDENCE = tuple(w for words in vocab.LABEL_EVIDENCE.values() for w in words)
_TRIGGERS = _EVIDENCE + vocab.BIOMETRIC_WORDS + vocab.SPECIAL_WORDS
_SAMPLE = "CASE WHEN length(low) <= 4000 THEN low ELSE substr(low, 1, 2000) || substr(low, length(low) - 1999, 2000) END"
_GATE = f"length(low) > 0 AND NOT ({any_of('s', vocab.POLICY_NOISE)} AND NOT {any_of('s', _EVIDENCE)}) AND ({any_of('s', _TRIGGERS)} OR (length(low) >= 1500 AND {hits('s', vocab.PERSON_WORDS)} >= 2))"

_FIRST = "SELECT * FROM finding QUALIFY row_number() OVER (PARTITION BY path, category, hash ORDER BY finding_id, coalesce(source, '')) = 1"
_STRICT = ", ".join(map(_q, vocab.STRICT_IDS))


def _classified(source: str) -> str:
    g = lambda x: f"count(*) FILTER (pd_group = '{x}')"
    sensitive = f"({g('special')} > 0 OR {g('biometric')} > 0)"
    level = f"CASE WHEN {sensitive} AND bool_or(category IN ({_STRICT})) THEN 1 WHEN {g('payment')} > 0 OR {g('state_ids')} >= 100 THEN 2 WHEN {sensitive} OR {g('state_ids')} > 0 OR {g('regular')} >= 100 THEN 3 ELSE 4 END"
    return f"""f AS ({source}),
        pc AS (SELECT path, string_agg(category || ':' || n, ';' ORDER BY category) AS categories FROM (SELECT path, category, count(*) AS n FROM f GROUP BY ALL) GROUP BY path),
        pg AS (SELECT path, string_agg(pd_group || ':' || n, ';' ORDER BY pd_group) AS groups FROM (SELECT path, pd_group, count(*) AS n FROM f GROUP BY ALL) GROUP BY path),
        lv AS (SELECT path, count(*)::INT AS total_findings, ({level})::INT AS uz_level FROM f GROUP BY path),
        cls AS (SELECT path, total_findings, groups, categories, uz_level FROM lv JOIN pc USING (path) JOIN pg USING (path))"""


_ADVICE = " ".join(f"WHEN uz_level = {k} THEN {_q(' | '.join(v))}" for k, v in vocab.FINDING_ADVICE.items() if k) + f" ELSE {_q(' | '.join(vocab.FINDING_ADVICE[None]))}"
_REPORT = f"""WITH {_classified(_FIRST)}, r AS (SELECT s.path, list_extract(string_split(s.path, '/'), -1) AS filename, s.extension AS format, s.status, s.via_ocr, c.uz_level, coalesce(c.total_findings, 0) AS total_findings,
    coalesce(c.groups, '') AS groups, coalesce(c.categories, '') AS categories, coalesce(s.notes, []) AS n0, CASE WHEN c.path IS NULL AND coalesce(s.error, '') <> '' THEN [s.error] ELSE [] END AS n1
    FROM extract_status s LEFT JOIN cls c ON s.path = c.path)"""

_HINTS = " ".join(f"WHEN regexp_matches(coalesce(field_name, ''), {_q(_word(p))}) THEN {_q(h)}" for p, h in vocab.HEADING_HINTS)
_KIND = "CASE WHEN contains(lower(field_name), 'mail') OR contains(lower(field_name), 'почт') THEN 'EMAIL' WHEN contains(lower(field_name), 'телеф') OR contains(lower(field_name), 'phone') THEN 'PHONE' WHEN contains(lower(field_name), 'снилс') OR contains(lower(field_name), 'snils') THEN 'SNILS' WHEN contains(lower(field_name), 'адрес') OR contains(lower(field_name), 'address') THEN 'ADDRESS' WHEN contains(lower(field_name), 'рожд') OR contains(lower(field_name), 'birth') THEN 'BIRTH_DATE' END"
_SPACE = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}]"
_TRIM = rf"^{_SPACE}+|{_SPACE}+$"

_HELD = f"""SELECT path, category, text FROM (SELECT path, text, lower(field_name) AS f FROM text_chunk WHERE coalesce(text, '') <> ''), (SELECT unnest(['ADDRESS', 'BIRTH_PLACE']) AS category)
    WHERE (category = 'ADDRESS' AND {any_of('f', vocab.FIELD_WORDS['address'])}) OR (category = 'BIRTH_PLACE' AND {any_of('f', vocab.FIELD_WORDS['birth_place'])})"""

ORACLE = {
    "email_counts": _MAILS,
    "phone_counts": entity(spans("t", _PHONE), f"length({_PHONE_OWN}) = 10 AND replace({_PHONE_OWN}, substr({_PHONE_OWN}, 1, 1), '') <> ''", f"'7' || {_PHONE_OWN}"),
    "uz_level": f"""WITH m AS ({_MAILS.replace('extracted_content', 'documents').replace('content_id', 'doc_id').replace(TEXTS, TEXTS.replace('extracted_content', 'documents').replace('content_id', 'doc_id'))}),
        c AS (SELECT d.doc_id, coalesce(m.n, 0)::INT AS emails, lower(coalesce(d.text, '')) AS low FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id)
        SELECT doc_id, emails, {_level('emails', '0', '0', hits('low', vocab.BIOMETRIC_WORDS), hits('low', vocab.SPECIAL_WORDS))} AS uz FROM c""",
    "heading_hints": f"SELECT * FROM (SELECT chunk_id, CASE {_HINTS} ELSE '' END AS hint FROM text_chunk) WHERE hint <> ''",
    "finding_emails": f"""WITH v AS (SELECT path, unnest(regexp_extract_all(text, {_q(_MAIL)})) AS v FROM text_chunk WHERE text IS NOT NULL)
        SELECT DISTINCT path, substr(sha256(v), 1, 16) AS hash, substr(v, 1, 1) || '***@' || substr(v, strpos(v, '@') + 1) AS masked FROM v""",
    "finding_field_cells": f"""WITH v AS (SELECT path, category, regexp_replace(text, {_q(_TRIM)}, '', 'g') AS v FROM ({_HELD}))
        SELECT DISTINCT path, category, substr(sha256(v), 1, 16) AS hash, CASE WHEN length(v) > 6 THEN substr(v, 1, 6) || '...' ELSE '***' END AS masked FROM v WHERE v <> ''""",
    "snils_counts": entity(spans("t", r"\b[\p{Nd}]{3}-[\p{Nd}]{3}-[\p{Nd}]{3}\s?[\p{Nd}]{2}\b"), snils(_D), _D),
    "inn10_counts": entity(runs("t", 10), inn10(_D), "x.v"),
    "inn12_counts": entity(runs("t", 12), inn12(_D), "x.v"),
    "driver_counts": entity(runs("t", 10), near(vocab.DRIVER_WORDS, 50), "x.v"),
    "account_counts": entity(spans("t", _ACCOUNT), near(vocab.ACCOUNT_WORDS, 60), _group(_ACCOUNT)),
    "bik_counts": entity(spans("t", _BIK), f"{_group(_BIK)} LIKE '04%' AND {near(vocab.ACCOUNT_WORDS, 60)}", _group(_BIK)),
    "card_counts": entity(spans("t", r"(?:(?:\d[ -]*?){13,19})"), f"length({_D}) BETWEEN 13 AND 19 AND {luhn(_D)} AND {_CARD_PREFIX} AND {near(vocab.CARD_WORDS, 50)}", _D),
    "classifier_keywords": f"SELECT doc_id, {hits('low', vocab.BIOMETRIC_WORDS)}::INT AS biometric, {hits('low', vocab.SPECIAL_WORDS)}::INT AS special FROM (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents)",
    "classifier_gate": f"SELECT content_id FROM (SELECT content_id, low, {_SAMPLE} AS s FROM {TEXTS}) WHERE {_GATE}",
    "policy_noise": f"SELECT content_id, {any_of('low', _EVIDENCE)} AS evidence FROM {TEXTS} WHERE {any_of('low', vocab.POLICY_NOISE)}",
    "label_counts": f"""WITH c AS (SELECT content_id, low, {_SAMPLE} AS s FROM {TEXTS}), n AS (SELECT content_id, ({any_of('low', vocab.LABEL_EVIDENCE['other'])} AND {any_of('low', vocab.BIOMETRIC_WORDS)})::INT AS biometric,
        {any_of('low', vocab.LABEL_EVIDENCE['health'])}::INT + {any_of('low', vocab.LABEL_EVIDENCE['beliefs'])}::INT + {any_of('low', vocab.LABEL_EVIDENCE['race'])}::INT
        + ({any_of('low', vocab.LABEL_EVIDENCE['other'])} AND NOT {any_of('low', vocab.BIOMETRIC_WORDS)})::INT AS special
        FROM c WHERE {_GATE} AND NOT ({any_of('low', vocab.POLICY_NOISE)} AND NOT {any_of('low', _EVIDENCE)})) SELECT * FROM n WHERE biometric + special > 0""",
    "level_of_counts": f"""WITH c AS (SELECT path, coalesce(categories['обычные'], 0) AS a, coalesce(categories['государственные'], 0) AS b, coalesce(categories['платежные'], 0) AS p, coalesce(categories['биометрические'], 0) AS m,
        coalesce(categories['специальные'], 0) AS s FROM scan_result), l AS (SELECT *, {_level('a', 'b', 'p', 'm', 's')} AS uz FROM c)
        SELECT path, uz, (a + b + p + m + s)::INT AS findings_count, array_to_string(list_filter([CASE uz {' '.join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in vocab.DOC_ADVICE.items())} END,
        CASE WHEN p <> 0 THEN {_q(vocab.ADVICE_PAYMENT)} END, CASE WHEN b <> 0 THEN {_q(vocab.ADVICE_STATE)} END, CASE WHEN s <> 0 OR m <> 0 THEN {_q(vocab.ADVICE_SENSITIVE)} END], lambda x: x IS NOT NULL), ' ') AS advice,
        array_to_string(list_filter([CASE WHEN a > 0 THEN 'обычные' END, CASE WHEN b > 0 THEN 'государственные' END, CASE WHEN p > 0 THEN 'платежные' END, CASE WHEN m > 0 THEN 'биометрические' END,
        CASE WHEN s > 0 THEN 'специальные' END], lambda x: x IS NOT NULL), ',') AS detected FROM l""",
    "category_totals": "SELECT e.key AS category, sum(e.value)::BIGINT AS total FROM (SELECT unnest(map_entries(categories)) AS e FROM scan_result) GROUP BY 1",
    "uz_histogram": "SELECT uz, count(*) AS files FROM scan_result GROUP BY uz",
    "uz_rollup": "SELECT file_format, uz, count(*) AS files, sum(findings_count)::BIGINT AS findings FROM scan_result GROUP BY ROLLUP (file_format, uz)",
    "results_found": "SELECT size, time_text AS time, name FROM scan_result WHERE findings_count > 0",
    "finalize_text": rf"""WITH p AS (SELECT content_id, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), {_q(_TRIM)}, '', 'g') AS t FROM extracted_content)
        SELECT content_id, substr(sha256(substr(t, 1, 3000)), 1, 16) AS hash, length(substr(t, 1, 3000))::INT AS chars, length(t) > 3000 AS truncated FROM p""",
    "finalize_text_of_scan": rf"""WITH p AS (SELECT content_id, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), {_q(_TRIM)}, '', 'g') AS t FROM extracted_content)
        SELECT content_id, substr(sha256(substr(t, 1, 200000)), 1, 16) AS hash, length(substr(t, 1, 200000))::INT AS chars, length(t) > 200000 AS truncated FROM p""",
    "cyrillic_share": r"""WITH c AS (SELECT content_id, len(regexp_extract_all(coalesce(text, ''), '[А-Яа-яЁё]')) AS c, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]')) AS l, len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{M}\p{Nd}]')) AS w FROM extracted_content)
        SELECT content_id, round(CASE WHEN c + l = 0 THEN 0.0 ELSE c / (c + l) END, 6) AS share, w >= 50 AS meaningful FROM c""",
    "json_leaves": "SELECT event_id, array_to_string(list_transform(json_keys(props), lambda k: 'root.' || k || ': ' || json_extract_string(props, '$.' || k)), chr(10)) AS lines FROM events",
    "span_offsets": f"SELECT chunk_id, s.v AS value, s.s::INT AS start, s.e::INT AS \"end\" FROM (SELECT chunk_id, unnest({spans('text', '[0-9]{6,}')}) AS s FROM text_chunk WHERE text IS NOT NULL)",
    "dedup_first_wins": f"SELECT path, category, pd_group, hash, source, field_name FROM ({_FIRST})",
    "stored_levels": f"WITH {_classified(_FIRST)} SELECT path, total_findings, groups, categories, uz_level FROM cls",
    "report_rows": f"{_REPORT} SELECT path, filename, format, status, lower(via_ocr::VARCHAR) AS via_ocr, coalesce(uz_level::VARCHAR, '') AS uz_level, total_findings, groups, categories, CASE {_ADVICE} END AS recommendations, array_to_string(list_concat(n0, n1), ' | ') AS notes FROM r",
    "report_summary": f"""{_REPORT} SELECT count(*) AS total_files, count(*) FILTER (total_findings > 0) AS files_with_pii, {', '.join(f"count(*) FILTER (status = '{s}') AS status_{s}" for s in ('ok', 'skipped', 'error'))},
        {', '.join(f"count(*) FILTER (uz_level = {k}) AS uz_{k}" for k in (1, 2, 3, 4))}, count(*) FILTER (uz_level IS NULL) AS uz_none FROM r""",
    "report_group_totals": f"WITH f AS ({_FIRST}), n AS (SELECT f.pd_group AS name, count(*) AS total FROM f JOIN extract_status s ON f.path = s.path GROUP BY 1) SELECT d.name, coalesce(n.total, 0)::BIGINT AS total FROM (SELECT unnest(['regular', 'state_ids', 'payment', 'biometric', 'special']) AS name) d LEFT JOIN n ON d.name = n.name",
    "report_category_totals": f"WITH f AS ({_FIRST}) SELECT f.category AS name, count(*)::BIGINT AS total FROM f JOIN extract_status s ON f.path = s.path GROUP BY 1",
    "report_order": f"{_REPORT} SELECT path, uz_level, total_findings FROM (SELECT DISTINCT path, status, format, uz_level, total_findings, filename FROM r) ORDER BY coalesce(uz_level, 99), total_findings DESC, lower(filename), path LIMIT 20",
    "checksums": f"""WITH k AS (SELECT c_custkey, lpad(c_custkey::VARCHAR, 10, '7') AS k FROM customer), v AS (SELECT *, k || '07' AS k12, k || '1' AS k11, '411111' || k AS k16 FROM k)
        SELECT c_custkey, {inn10('k')} AS inn10, {inn12('k12')} AS inn12, {snils('k11')} AS snils, {luhn('k16')} AS luhn, NOT (length(replace(k, substr(k, 1, 1), '')) = 0) AS phone, substr(k, 1, 2) <> '00' AS passport,
        (k LIKE '4%' OR substr(k, 1, 2)::INT BETWEEN 51 AND 55 OR substr(k, 1, 4)::INT BETWEEN 2221 AND 2720 OR substr(k, 1, 4)::INT BETWEEN 2200 AND 2204) AS bin, substr(k, 2) LIKE '04%' AS bik FROM v""",
    "hourly_events": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "sessions": """WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
        SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, k""",
}


def oracle_sql() -> dict[str, str]:
    from .oracle_profiles import STATEMENTS

    return ORACLE | STATEMENTS
