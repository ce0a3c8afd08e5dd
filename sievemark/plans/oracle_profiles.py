"""DuckDB statements of both profiles as a whole, and of the values, names, dates and masks they are made of.

The engine's patterns know no look-around.  ``guarded`` spells it out: every
character that is none of a class is doubled, so that of two neighbours a match
may use one as its left and the other as its right guard; places are counted
back to the plain text afterwards.
"""

from __future__ import annotations

import re

from .. import vocab
from . import formats
from . import oracle as O

_DIGIT, _WORD = r"\p{Nd}", r"\p{L}\p{M}\p{Nd}\p{Pc}"
_BLANK = r"\s\p{Z}\x{85}\x{1c}-\x{1f}"
_B2 = f"[{_BLANK}][{_BLANK}]"
_N = r"\p{Nd}"
q, any_of, window = O._q, O.any_of, O.window


def _spans(source: str, pattern: str, keys: str, guard: str | None = None) -> str:
    """``source(keys, t, low)`` with ``sp``, the matches as ``{v, s, e}``; ``guard`` is a class that stands on neither side of a match."""
    if guard is None:
        text, whole, own, single = "t", pattern, "i", lambda x: x
    else:
        text, whole = f"regexp_replace(t, '([^{guard}])', '\\1\\1', 'g')", f"(?:^|[^{guard}])({pattern})(?:[^{guard}]|$)"
        single = lambda x: f"regexp_replace({x}, '([^{guard}])[^{guard}]', '\\1', 'g')"
    values = f"regexp_extract_all(t2, {q(whole)}" + (", 1)" if guard else ")")
    before = "list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i-1], lambda y: length(y))), 0)"
    start = f"length({single(f'substr(t2, 1, ({before})::BIGINT + strpos(m[i], w[i]) - 1)')})" if guard else f"({before})"
    value = single("w[i]")
    return f"""(SELECT {keys}, t, low, CASE WHEN len(m) = 0 THEN [] ELSE list_transform(range(1, len(m) + 1), lambda i: {{'v': {value}, 's': ({start})::BIGINT, 'e': ({start})::BIGINT + length({value})}}) END AS sp
        FROM (SELECT {keys}, t, low, t2, regexp_extract_all(t2, {q(whole)}) AS m, {values} AS w, string_split_regex(t2, {q(whole)}) AS g FROM (SELECT {keys}, t, low, {text} AS t2 FROM {source})))"""


def _count(spans: str, holds: str, key: str | None, demo: bool) -> str:
    kept = f"list_filter(sp, lambda x: ({holds})" + (f" AND {O.not_demo()}" if demo else "") + ")"
    return f"SELECT content_id, len({f'list_distinct(list_transform({kept}, lambda x: {key}))' if key else kept})::INT AS n FROM {spans}"


def _document(pattern: str, guard: str | None = None) -> str:
    return _spans(O.TEXTS, pattern, "content_id", guard)


def around(t: str, radius: int) -> str:
    return window(t, f"x.s - {radius}", f"x.e + {radius}")


def _whole_word(t: str, words) -> str:
    return f"regexp_matches({t}, {q(f'(?:^|[^{_WORD}])(?:' + '|'.join(map(re.escape, words)) + f')(?:[^{_WORD}]|$)')})"


_D = O.digits("x.v")
_PASSPORT = f"{_N}{{2}}(?:{_B2})?{_N}{{2}}(?:{_B2})?{_N}{{6}}"
_CVV = r"(?i)\b(?:cvv|cvc|cvv2)\b[^\p{Nd}]{0,5}([\p{Nd}]{3,4})"
_SQUEEZED = f"trim(regexp_replace(x.v, '[{_BLANK}]+', ' ', 'g'))"
_PARTS = f"string_split({_SQUEEZED}, ' ')"
_NOT_PERSON = "[" + ", ".join(map(q, vocab.NOT_PERSON)) + "]"
_PATRONYMIC = f"len(list_filter(({_PARTS})[2:3], lambda z: {' OR '.join(f'suffix(lower(z), {q(e)})' for e in vocab.PATRONYMIC_ENDS)})) > 0"
_SHAPED = f"len(list_filter({_PARTS}, lambda z: NOT regexp_full_match(z, '[А-ЯЁ][а-яё-]+') OR list_contains({_NOT_PERSON}, lower(z)))) = 0"
_PERSON = f"{_SHAPED} AND CASE WHEN len({_PARTS}) = 3 THEN {_PATRONYMIC} OR {_whole_word(around('low', 80), vocab.PERSON_WORDS)} ELSE {_whole_word(around('low', 60), vocab.PERSON_WORDS)} END"
_GEO = any_of(window("low", "x.s - 25", "x.s"), vocab.GEO_WORDS)
_FIO = _document(f"[А-ЯЁ][а-яё]+(?:(?:{_B2})+[А-ЯЁ][а-яё]+){{1,2}}", _WORD)
_FIO_LATIN = _document(f"[A-Z][a-z]+(?:(?:{_B2})+[A-Z][a-z]+){{1,2}}", _WORD)


def _names(spans: str, holds: str) -> str:
    return f"SELECT content_id, unnest(list_distinct(list_transform(list_filter(sp, lambda x: {holds} AND {O.not_demo()}), lambda x: lower({_SQUEEZED})))) AS k FROM {spans}"


_ALL_NAMES = f"({_names(_FIO, f'NOT {_GEO} AND {_PERSON}')} UNION {_names(_FIO_LATIN, any_of(around('low', 80), vocab.LATIN_PERSON_WORDS))})"
_LEFT, _RIGHT = window("low", "x.s - 40", "x.s"), window("low", "x.e", "x.e + 40")
_BIRTH = f"coalesce(year(try_strptime(replace(x.v, '/', '.'), '%d.%m.%Y')) BETWEEN 1900 AND 2026, false) AND ({any_of(_LEFT, vocab.BIRTH_WORDS)} OR {any_of(_RIGHT, vocab.BIRTH_WORDS)})"
_ISSUED = f"({any_of(_LEFT, vocab.NOT_BIRTH_WORDS)} OR {any_of(_RIGHT, vocab.NOT_BIRTH_WORDS)})"
_SAID = f"(contains({_LEFT}, 'дата рождения') OR contains({_RIGHT}, 'г. рождения'))"


def _plain(p: str) -> str:
    """A pattern of the library in the engine's form."""
    p = p.replace("(?iuU)", "(?i)").replace("(?U)", "").replace(r"\d", r"\p{Nd}")
    return re.sub(r"\\w", lambda m: f"[{_WORD}]", re.sub(r"(?<!\[)\\s", lambda m: f"[{_BLANK}]", p))


def _bounded(p: str) -> str:
    """The same, with word bounds spelled out (for a yes or no only)."""
    p = re.sub(r"\\b(?=[\w(])", lambda m: f"(?:^|[^{_WORD}])", re.sub(r"(?<=[\w*+)?])\\b", lambda m: f"(?:[^{_WORD}]|$)", p))
    return _plain(p.replace(r"[-\s]", f"[-{_BLANK}]"))


_FRAGMENT = around("t", 160)
_has = lambda p: f"regexp_matches({_FRAGMENT}, {q(_plain(p))})"
_POSTCODE = f"regexp_matches({_FRAGMENT}, '(?:^|[^{_N}]){_N}{{6}}(?:[^{_N}]|$)')"
_ADDRESS = f"""({_has(vocab.ADDRESS_CONTEXT)} AND (({_has(vocab.ADDRESS_STREET)} AND {_has(vocab.ADDRESS_HOUSE)}) OR ({_POSTCODE} AND {_has(vocab.ADDRESS_STREET)}))
    OR len(regexp_extract_all({_FRAGMENT}, {q(_plain(vocab.ADDRESS_PART))})) >= 3 AND ({_has(vocab.ADDRESS_HOUSE)} OR {_has(vocab.ADDRESS_FLAT)} OR {_POSTCODE}))"""

VALUES = {
    "passport_counts": _count(_document(_PASSPORT, _DIGIT), f"length({_D}) = 10 AND NOT starts_with({_D}, '00') AND {O.near(vocab.PASSPORT_WORDS, 50)}", _D, True),
    "mrz_counts": _count(_document("(?m)^[A-Z0-9<]{30,44}$"), f"length(x.v) IN (30, 36, 44) AND {O.near(vocab.MRZ_WORDS, 60)}", "x.v", False),
    "cvv_counts": _count(_document(_CVV), O.near(vocab.CARD_WORDS, 40), f"regexp_extract(x.v, {q(_CVV)}, 1) || '/' || (x.s // 200)::VARCHAR", True),
    "fio_counts": f"SELECT c.content_id, count(k)::INT AS n FROM extracted_content c LEFT JOIN {_ALL_NAMES} k ON c.content_id = k.content_id GROUP BY c.content_id",
    "birth_date_counts": _count(_document(f"{_N}{{2}}[./][./]{_N}{{2}}[./][./]{_N}{{4}}", _WORD), f"{_BIRTH} AND (NOT {_ISSUED} OR {_SAID})", None, False),
    "birth_place_counts": _count(_document(_plain(vocab.BIRTH_PLACE)), f"regexp_matches({around('t', 120)}, '[А-ЯЁ][а-яё]+')", None, False),
    "address_counts": _count(_document(_plain(vocab.ADDRESS_CONTEXT)), _ADDRESS, None, False),
}


def _profile(gated: bool) -> str:
    counts = O.ORACLE | VALUES
    parts = {
        "state": ("snils", "inn10", "inn12", "passport", "driver", "mrz"), "pay": ("card", "account", "bik", "cvv"), "common": ("email", "phone", "birth_date", "birth_place", "address"),
    }
    every = [n for names in parts.values() for n in names] + ["fio"]
    joins = " ".join(f"JOIN ({counts[f'{n}_counts']}) {n} ON d.content_id = {n}.content_id" for n in every)
    total = {k: " + ".join(f"{n}.n" for n in names) for k, names in parts.items()}
    gate = O._GATE if gated else "true"
    advice = f"""array_to_string(list_filter([CASE uz {' '.join(f"WHEN {q(k)} THEN {q(v)}" for k, v in vocab.DOC_ADVICE.items())} END, CASE WHEN pay <> 0 THEN {q(vocab.ADVICE_PAYMENT)} END,
        CASE WHEN state <> 0 THEN {q(vocab.ADVICE_STATE)} END, CASE WHEN special <> 0 OR bio <> 0 THEN {q(vocab.ADVICE_SENSITIVE)} END], lambda x: x IS NOT NULL), ' ')"""
    return f"""WITH d AS (SELECT content_id, low, {O._SAMPLE} AS s FROM {O.TEXTS}),
        n AS (SELECT d.content_id, ({total['common']} + least(10, fio.n))::INT AS common, ({total['state']})::INT AS state, ({total['pay']})::INT AS pay,
            (CASE WHEN {gate} THEN {O.hits('low', vocab.BIOMETRIC_WORDS)} ELSE 0 END)::INT AS bio, (CASE WHEN {gate} THEN {O.hits('low', vocab.SPECIAL_WORDS)} ELSE 0 END)::INT AS special FROM d {joins}),
        l AS (SELECT *, {O._level('common', 'state', 'pay', 'bio', 'special')} AS uz FROM n)
        SELECT content_id, common, state, pay, bio, special, uz, (common + state + pay + bio + special)::INT AS findings_count, {advice} AS advice FROM l"""


# --- masks and the finding profile -------------------------------------------


def _tail(d: str, visible: int) -> str:
    return f"CASE WHEN length({d}) <= {visible} THEN repeat('*', length({d})) ELSE repeat('*', length({d}) - {visible}) || right({d}, {visible}) END"


def mask(category: str, v: str) -> str:
    """The mask of a trimmed value."""
    d = O.digits(v)
    cores = f"list_filter(list_transform(string_split_regex({v}, '[{_BLANK}]+'), lambda z: regexp_replace(z, '\\.+$', '')), lambda z: z <> '')"
    names = f"array_to_string(list_transform({cores}, lambda z: z[1] || '.(' || length(z) || ')'), ' ')"
    year = f"regexp_extract({v}, '^\\d{{1,2}}[./]\\d{{1,2}}[./]((?:19|20)\\d{{2}})', 1)"
    return f"""CASE WHEN {category} = 'EMAIL' THEN CASE WHEN strpos({v}, '@') > 1 THEN substr({v}, 1, 1) || '***@' || substr({v}, strpos({v}, '@') + 1) WHEN strpos({v}, '@') = 1 THEN '***@' || substr({v}, 2) ELSE '***' END
        WHEN {category} = 'PHONE' THEN {_tail(d, 2)} WHEN {category} = 'CVV' THEN repeat('*', length({d}))
        WHEN {category} IN ('PASSPORT_RF', 'SNILS', 'INN_PERSONAL', 'INN_LEGAL', 'BANK_CARD', 'BANK_ACCOUNT', 'BIC', 'DRIVER_LICENSE') THEN {_tail(d, 4)}
        WHEN {category} = 'MRZ' THEN CASE WHEN length({v}) > 10 THEN substr({v}, 1, 5) || '...' || right({v}, 2) ELSE '***' END
        WHEN {category} = 'FIO' THEN CASE WHEN {names} = '' THEN '***' ELSE {names} END
        WHEN {category} IN ('ADDRESS', 'BIRTH_PLACE') THEN CASE WHEN length({v}) > 6 THEN substr({v}, 1, 6) || '...' ELSE '***' END
        WHEN {category} = 'BIRTH_DATE' THEN CASE WHEN {year} = '' THEN '**.**.****' ELSE '**.**.' || {year} END ELSE '[' || {category} || ']' END"""


_CHUNKS = "(SELECT path, chunk_seq, source, field_name, text AS t, lower(text) AS low, lower(coalesce(field_name, '')) AS f FROM text_chunk WHERE coalesce(text, '') <> '')"
_KEYS = "path, chunk_seq, source, field_name, f"


def _field(kind: str) -> str:
    return any_of("f", vocab.FIELD_WORDS[kind])


def _beside(kind: str, pad: int = 40) -> str:
    return any_of(window("low", f"x.s - {pad}", f"x.e + {pad}"), vocab.NEAR_WORDS[kind])


def _near(kind: str, pad: int = 40) -> str:
    return f"({_field(kind)} OR {_beside(kind, pad)})"


_PAIR = lambda c: f"(?:[{c}][{c}])"
_LOOSE, _TIGHT = _PAIR(f"{_BLANK}()\\-"), _PAIR(f"{_BLANK}\\-")
_F_PHONE = f"(?:\\+\\+7|8){_LOOSE}*{_N}{{3}}{_LOOSE}*{_N}{{3}}{_TIGHT}*{_N}{{2}}{_TIGHT}*{_N}{{2}}"
_LETTERS = "АВЕКМНОРСТУХABEKMHOPCTYX"
_DATE = "(?:0?[1-9]|[12][0-9]|3[01])[./][./](?:0?[1-9]|1[0-2])[./][./](?:19|20)[0-9]{2}"
_SAID_OF = lambda kind: any_of("low", vocab.NEAR_WORDS[kind])
#: ``(rule, category, pattern, guard, condition)`` of the rules that look for matches.
RULES = (
    (0, "'EMAIL'", O._MAIL, None, "true"),
    (1, "'PHONE'", _F_PHONE, _DIGIT, "true"),
    (2, "'PASSPORT_RF'", f"{_N}{{4}}(?:{_B2})?{_N}{{6}}", _DIGIT, _near("passport")),
    (3, "'SNILS'", f"{_N}{{3}}--{_N}{{3}}--{_N}{{3}}{_TIGHT}?{_N}{{2}}", _DIGIT, O.snils(_D)),
    (4, "CASE WHEN length(x.v) = 12 THEN 'INN_PERSONAL' ELSE 'INN_LEGAL' END", f"{_N}{{10}}(?:{_N}{{2}})?", _DIGIT, f"CASE WHEN length({_D}) = 10 THEN {O.inn10(_D)} ELSE {O.inn12(_D)} END AND {_near('inn')}"),
    (5, "'BANK_CARD'", f"(?:{_N}(?:  |--)?){{13,19}}", _DIGIT, f"length({_D}) BETWEEN 13 AND 19 AND {O.luhn(_D)} AND {_near('card', 60)}"),
    (6, "'BANK_ACCOUNT'", f"{_N}{{20}}", _DIGIT, _field("account")),
    (7, "'BIC'", f"04{_N}{{7}}", _DIGIT, "true"),
    (8, "'CVV'", f"{_N}{{3,4}}", _DIGIT, f"NOT {_field('cvv')} AND {_SAID_OF('cvv')} AND {_beside('cvv', 15)}"),
    (9, "'DRIVER_LICENSE'", f"{_N}{{2}}(?:{_B2})?[{_LETTERS}]{{4}}(?:{_B2})?{_N}{{6}}", _DIGIT, "true"),
    (10, "'MRZ'", f"P[<A-Z0-9]{{43}}[{_BLANK}]*[A-Z0-9<]{{44}}", None, "true"),
    (11, "'BIRTH_DATE'", _DATE, _DIGIT, f"({_field('birth_date')} OR ({_SAID_OF('birth_date')} AND {_beside('birth_date')}))"),
)
_NAME = f"string_split(regexp_replace(regexp_replace(t, {q(O._TRIM)}, '', 'g'), '[{_BLANK}]+', ' ', 'g'), ' ')"
_NAME_LIKE = f"""(length(array_to_string({_NAME}, ' ')) BETWEEN 3 AND 120 AND len({_NAME}) BETWEEN 2 AND 5 AND len(list_filter({_NAME}, lambda z: NOT regexp_matches(z, '^([А-ЯЁA-Z]\\.?|[А-ЯЁA-Z][а-яёa-z\\-]+)$'))) = 0
    AND len(list_filter({_NAME}, lambda z: length(regexp_replace(z, '\\.+$', '')) >= 2)) > 0)"""
_CODE = O.digits("t")
#: ``(rule, category, condition, value)`` of the rules that take a chunk as a whole.
WHOLE = (
    (8, "CVV", f"{_field('cvv')} AND length({_CODE}) BETWEEN 3 AND 4", _CODE), (12, "BIRTH_PLACE", _field("birth_place"), "t"), (13, "ADDRESS", _field("address"), "t"), (14, "FIO", f"{_field('fio')} AND {_NAME_LIKE}", "t"),
    *((15 + n, k, "(" + " OR ".join(f"regexp_matches(t, {q('(?i)' + _bounded(p))})" for p in patterns) + ")", f"substr(t, 1, {vocab.SNIPPET})") for n, (k, patterns) in enumerate(vocab.MENTIONS.items())),
)


def _findings() -> str:
    own = [
        f"SELECT {_KEYS}, {rule} AS rule, x.s AS start, {category} AS category, x.v AS value FROM (SELECT {_KEYS}, unnest(list_filter(sp, lambda x: {holds})) AS x FROM {_spans(_CHUNKS, pattern, _KEYS, guard)})"
        for rule, category, pattern, guard, holds in RULES
    ] + [f"SELECT {_KEYS}, {rule}, 0, '{category}', {value} FROM {_CHUNKS} WHERE {holds}" for rule, category, holds, value in WHOLE]
    groups = " ".join(f"WHEN '{k}' THEN '{g}'" for k, g in vocab.FINDING_GROUPS.items())
    return f"""SELECT path, category, CASE category {groups} END AS pd_group, {mask('category', 'v')} AS masked, hash, source, field_name FROM (
        SELECT *, substr(sha256(v), 1, 16) AS hash FROM (SELECT *, regexp_replace(value, {q(O._TRIM)}, '', 'g') AS v FROM ({' UNION ALL '.join(own)})) WHERE v <> '')
        QUALIFY row_number() OVER (PARTITION BY path, category, hash ORDER BY chunk_seq, rule, start, coalesce(source, '')) = 1"""


# --- texts -------------------------------------------------------------------

_TRIGGER_HITS = O.hits("lower(z)", dict.fromkeys(O._TRIGGERS))
_GATHERED = f"""list_reduce(parts, lambda a, z: CASE WHEN length(CASE WHEN a.now = '' THEN z ELSE a.now || ' ' || z END) <= {vocab.CHUNK_CHARS} THEN {{'done': a.done, 'now': CASE WHEN a.now = '' THEN z ELSE a.now || ' ' || z END}}
    ELSE {{'done': CASE WHEN a.now = '' THEN a.done ELSE list_append(a.done, a.now) END, 'now': substr(z, 1, {vocab.CHUNK_CHARS})}} END, {{'done': []::VARCHAR[], 'now': ''}})"""
_TOP = f"""WITH p AS (SELECT content_id, list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(t, '[{_BLANK}]+', ' ', 'g'), '^ | $', '', 'g'), '([.!?]) +', '\\1' || chr(30), 'g'), chr(30)), lambda z: z <> '') AS parts FROM {O.TEXTS}),
    g AS (SELECT content_id, {_GATHERED} AS a FROM p), c AS (SELECT content_id, CASE WHEN a.now = '' THEN a.done ELSE list_append(a.done, a.now) END AS chunks FROM g),
    e AS (SELECT content_id, unnest(chunks) AS z, unnest(range(len(chunks))) AS i FROM c),
    s AS (SELECT content_id, z, i, CASE WHEN {_TRIGGER_HITS} > 0 THEN {_TRIGGER_HITS} WHEN {any_of('lower(z)', vocab.PERSON_WORDS)} THEN 1 ELSE 0 END AS n FROM e),
    r AS (SELECT *, max(n) OVER (PARTITION BY content_id) AS most, row_number() OVER (PARTITION BY content_id ORDER BY n DESC, i) AS by_hits FROM s)
    SELECT content_id, (by_hits - 1)::INT AS rank, length(z)::INT AS chars, substr(sha256(z), 1, 16) AS hash FROM r WHERE by_hits <= {vocab.TOP_CHUNKS} AND (n > 0 OR most = 0)"""
_SCRIPTS = f"""SELECT content_id, substr(sha256(coalesce(array_to_string(list_transform(regexp_extract_all(t, '[^{_BLANK}]+|[{_BLANK}]+'), lambda z: CASE WHEN regexp_matches(z, '[А-Яа-яЁё]') AND regexp_matches(z, '[A-Za-z]')
    THEN translate(z, {q(vocab.GLYPHS_FROM)}, {q(vocab.GLYPHS_TO)}) ELSE z END), ''), '')), 1, 16) AS hash FROM {O.TEXTS}"""
_PAD = lambda c, n: f"CASE WHEN length({c}) >= {n} THEN {c} ELSE rpad({c}, {n}, ' ') END"
_GROUP_NAMES = "replace(regexp_replace(groups, ':[0-9]+', '', 'g'), ';', ',')"
_LINES = f"""{O._REPORT}, s AS (SELECT path, coalesce('UZ-' || uz_level, 'none') AS l, CASE WHEN groups = '' THEN '-' ELSE {_GROUP_NAMES} END AS g, CASE WHEN length(filename) <= 48 THEN filename ELSE substr(filename, 1, 45) || '...' END AS n FROM r)
    SELECT {_PAD('l', 6)} || ' ' || {_PAD('g', 32)} || ' ' || {_PAD('n', 50)} || ' ' || path AS value FROM s"""
_FOUND_PHONES = _spans("(SELECT chunk_id, text AS t, '' AS low FROM text_chunk WHERE text IS NOT NULL)", _F_PHONE, "chunk_id", _DIGIT)

_PLAIN = f"(SELECT content_id::VARCHAR AS id, regexp_replace(coalesce(text, ''), {q(formats.PLAIN)}, ' ', 'g') AS t FROM extracted_content)"
_FINAL = lambda x: f"trim(regexp_replace({x}, ' +', ' ', 'g'))"
_CELL = "trim(t)"
#: What each reader makes of a packed text, and the name of its method.
_READ = {
    "txt": ("t", "plain_text"), "html": ("'Титул ' || t", "html_regex"), "json": ("'root.a.b: ' || t || chr(10) || 'root.a.n: 1' || chr(10) || 'root.l[0]: True' || chr(10) || 'root.l[1]: None'", "json"),
    "csv": (f"'фио | сумма' || chr(10) || CASE WHEN {_CELL} = '' THEN '5' ELSE 'ФИО: ' || {_CELL} || ' | 5' END", "csv"), "rtf": ("t", "rtf_regex"), "docx": ("t", "docx_zip_xml"),
    "xlsx": ("'[sheet] Лист1' || chr(10) || 'ФИО | Итог' || chr(10) || t || ' | 5'", "xlsx_openpyxl"),
}
_CHUNKED = (
    ("txt", 0, "#body", "NULL", _CELL), ("html", 0, "#title", "'title'", "'Титул'"), ("html", 1, "#body", "NULL", _CELL), ("rtf", 0, "#body", "NULL", _FINAL("t")), ("docx", 0, "#para=1", "NULL", _CELL), ("xlsx", 0, "#sheet=Лист1!R2C1", "'ФИО'", _CELL),
)
_HASH = lambda x: f"substr(sha256({x}), 1, 16)"
_TEXT_CELL = "coalesce(text, '')"
_fragment = lambda p: f"regexp_matches({_TEXT_CELL}, {q(_plain(p))})"
_CODE6 = f"regexp_matches({_TEXT_CELL}, '(?:^|[^{_N}]){_N}{{6}}(?:[^{_N}]|$)')"

STATEMENTS = VALUES | {
    "texts_of_formats": " UNION ALL ".join(f"SELECT id || '.{k}' AS path, '{k}' AS file_format, '{method}' AS method, 'done' AS status, length({_FINAL(x)}) > 200000 AS truncated, {_HASH(f'substr({_FINAL(x)}, 1, 200000)')} AS hash FROM {_PLAIN}" for k, (x, method) in _READ.items()),
    "chunks_of_formats": " UNION ALL ".join(f"SELECT id || '.{k}' AS path, {n}::INT AS chunk_seq, id || '.{k}{place}' AS source, {name} AS field_name, {_HASH(x)} AS hash FROM {_PLAIN} WHERE {x} <> ''" for k, n, place, name, x in _CHUNKED)
    + f" UNION ALL SELECT id || '.xlsx', CASE WHEN {_CELL} = '' THEN 0 ELSE 1 END, id || '.xlsx#sheet=Лист1!R2C2', 'Итог', {_HASH("'5'")} FROM {_PLAIN}",
    "states_of_formats": "SELECT k AS extension, CASE WHEN k IN ('json', 'csv') THEN 'skipped' ELSE 'ok' END AS status, false AS via_ocr, count(*) AS files FROM extracted_content, (SELECT unnest(['txt', 'html', 'json', 'csv', 'rtf', 'docx', 'xlsx']) AS k) GROUP BY k",
    "decoded_bytes": f"SELECT content_id, {_HASH('text')} AS one, {_HASH('chr(65279) || text')} AS two FROM extracted_content WHERE text IS NOT NULL",
    "mentions_and_names": f"""SELECT chunk_id, {_NAME_LIKE.replace('(t,', f'({_TEXT_CELL},')} AS name,
        ({_fragment(vocab.ADDRESS_CONTEXT)} AND (({_fragment(vocab.ADDRESS_STREET)} AND {_fragment(vocab.ADDRESS_HOUSE)}) OR ({_CODE6} AND {_fragment(vocab.ADDRESS_STREET)}))
        OR len(regexp_extract_all({_TEXT_CELL}, {q(_plain(vocab.ADDRESS_PART))})) >= 3 AND ({_fragment(vocab.ADDRESS_HOUSE)} OR {_fragment(vocab.ADDRESS_FLAT)} OR {_CODE6})) AS address,
        coalesce(year(try_strptime(replace(regexp_extract({_TEXT_CELL}, '[0-9]{{2}}[./][0-9]{{2}}[./][0-9]{{4}}'), '/', '.'), '%d.%m.%Y')) BETWEEN 1900 AND 2026, false) AS birth,
        length({_TEXT_CELL}) IN (30, 36, 44) AND regexp_full_match({_TEXT_CELL}, '[A-Z0-9<]+') AS mrz, {_whole_word(f'lower({_TEXT_CELL})', vocab.PERSON_WORDS)} AS person FROM text_chunk""",
    "document_profile": _profile(True),
    "document_profile_ungated": _profile(False),
    "finding_rows": _findings(),
    "streamed_findings": f"SELECT path, category, pd_group, hash, masked FROM ({_findings()})",
    "streamed_levels": f"""WITH f AS ({_findings()}), g AS (SELECT path, {', '.join(f"count(*) FILTER (pd_group = '{k}') AS {k}" for k in ('regular', 'state_ids', 'payment', 'biometric', 'special'))}, bool_or(category IN ({O._STRICT})) AS strict FROM f GROUP BY path)
        SELECT path, regular, state_ids, payment, biometric, special, (CASE WHEN special + biometric > 0 AND strict THEN 1 WHEN payment > 0 OR state_ids >= 100 THEN 2 WHEN special + biometric > 0 OR state_ids > 0 OR regular >= 100 THEN 3 ELSE 4 END)::INT AS uz_level FROM g""",
    "streamed_events": O.ORACLE["hourly_events"],
    "streamed_sessions": O.ORACLE["sessions"],
    "file_levels": f"WITH {O._classified(_findings())} SELECT path, total_findings, groups, categories, uz_level FROM cls",
    "masked_cells": f"SELECT chunk_id, kind, {mask('kind', 'v')} AS masked FROM (SELECT chunk_id, {O._KIND} AS kind, regexp_replace(text, {q(O._TRIM)}, '', 'g') AS v FROM text_chunk WHERE text IS NOT NULL) WHERE kind IS NOT NULL",
    "topk_chunks": _TOP,
    "mixed_script_repair": _SCRIPTS,
    "binary_strings": "SELECT content_id, substr(sha256(coalesce(array_to_string(regexp_extract_all(text, '[\\x20-\\x7E]{4,}'), chr(10)), '')), 1, 16) AS hash FROM extracted_content WHERE text IS NOT NULL",
    "report_lines": _LINES,
    "phone_keys": f"""SELECT chunk_id, x.s::INT AS start, CASE WHEN length({_D}) = 11 AND substr({_D}, 1, 1) IN ('7', '8') THEN '7' || substr({_D}, 2) WHEN length({_D}) = 10 THEN '7' || {_D} ELSE {_D} END AS phone,
        length({O._PHONE_OWN}) = 10 AND replace({O._PHONE_OWN}, substr({O._PHONE_OWN}, 1, 1), '') <> '' AS valid FROM (SELECT chunk_id, unnest(sp) AS x FROM {_FOUND_PHONES})""",
}
