"""The library's functions under SQL names.

Bodies that are pure SQL are SQL functions, which the optimizer inlines.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .. import vocab


def _list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _weights(digits: str, weights) -> str:
    return " + ".join(f"int(substr({digits}, {i}, 1)) * {w}" for i, w in enumerate(weights, 1))


def register(spark: SparkSession) -> None:
    """Make ``digits_of, luhn_valid, snils_valid, inn_valid, phone_key, value_hash, uz_of_counts, uz_of_groups, pii_group, pii_find_spans`` known to the session."""
    d = "regexp_replace(v, r'(?U)\\D', '')"
    tail = (2, 4, 10, 3, 5, 9, 4, 6, 8)
    groups = ", ".join(f"'{k}', '{g}'" for k, g in vocab.FINDING_GROUPS.items())
    bodies = {
        "digits_of(v STRING) RETURNS STRING": d,
        "luhn_valid(v STRING) RETURNS BOOLEAN": f"CASE WHEN length({d}) BETWEEN 13 AND 19 THEN luhn_check({d}) ELSE false END",
        "snils_valid(v STRING) RETURNS BOOLEAN": f"CASE WHEN length({d}) = 11 THEN int(substr({d}, 10, 2)) = ({_weights(d, range(9, 0, -1))}) % 101 % 100 ELSE false END",
        "inn_valid(v STRING) RETURNS BOOLEAN": f"""CASE WHEN length({d}) = 10 THEN int(substr({d}, 10, 1)) = ({_weights(d, tail)}) % 11 % 10
            WHEN length({d}) = 12 THEN int(substr({d}, 11, 1)) = ({_weights(d, (7, *tail))}) % 11 % 10 AND int(substr({d}, 12, 1)) = ({_weights(d, (3, 7, *tail))}) % 11 % 10 ELSE false END""",
        "phone_key(v STRING) RETURNS STRING": f"CASE WHEN length({d}) = 11 AND {d} RLIKE '^[78]' THEN concat('7', substr({d}, 2)) WHEN length({d}) = 10 THEN concat('7', {d}) ELSE {d} END",
        "value_hash(v STRING) RETURNS STRING": "substr(sha2(v, 256), 1, 16)",
        "pii_group(c STRING) RETURNS STRING": f"map({groups})[c]",
        "uz_of_counts(common INT, state INT, pay INT, bio INT, special INT) RETURNS STRING": f"""CASE WHEN special <> 0 OR bio <> 0 THEN '{vocab.LEVEL_1}' WHEN pay <> 0 OR state >= 5 THEN '{vocab.LEVEL_2}'
            WHEN state <> 0 OR common >= 5 THEN '{vocab.LEVEL_3}' WHEN common <> 0 THEN '{vocab.LEVEL_4}' ELSE '{vocab.LEVEL_NONE}' END""",
        "uz_of_groups(regular INT, state INT, pay INT, bio INT, special INT, strict BOOLEAN) RETURNS INT": f"""CASE WHEN regular + state + pay + bio + special = 0 THEN NULL WHEN (special > 0 OR bio > 0) AND strict THEN 1
            WHEN pay > 0 OR state >= {vocab.BIG_VOLUME} THEN 2 WHEN special > 0 OR bio > 0 OR state > 0 OR regular >= {vocab.BIG_VOLUME} THEN 3 ELSE 4 END""",
        "pii_find_spans(t STRING, p STRING) RETURNS ARRAY<STRUCT<value: STRING, start: INT, end: INT>>": """transform(regexp_extract_all(t, p, 0), (m, i) -> struct(m AS value,
            int(aggregate(slice(split(t, p, -1), 1, i + 1), 0, (a, x) -> a + length(x)) + aggregate(slice(regexp_extract_all(t, p, 0), 1, i), 0, (a, x) -> a + length(x))) AS start,
            int(aggregate(slice(split(t, p, -1), 1, i + 1), 0, (a, x) -> a + length(x)) + aggregate(slice(regexp_extract_all(t, p, 0), 1, i + 1), 0, (a, x) -> a + length(x))) AS end))""",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
