"""The finding profile: rules by field and context, masks, first-wins, levels."""

import hashlib

from pyspark.sql import functions as F

from sievemark.functions import validators as V
from sievemark.functions.masking import mask, mask_tail
from sievemark.operators import finding as B

CHUNK = "path string, chunk_seq int, text string, source string, field_name string"


def found(spark, rows):
    return B.findings(spark.createDataFrame(rows, CHUNK))


RULES = [
    ("1234 567890", "Паспорт", [("PASSPORT_RF", "******7890")]),
    ("1234 567890", None, []),
    ("123", "cvv", [("CVV", "***")]),
    ("Смартфон Samsung Galaxy S20", "product_name", []),
    ("Иванов Иван", "ФИО", [("FIO", "И.(6) И.(4)")]),
    ("40817810099910004312", "р/с", [("BANK_ACCOUNT", "*" * 16 + "4312")]),
    ("04452522512", None, []),
    ("БИК 044525225", None, [("BIC", "*****5225")]),
    ("ИНН 123456789047", None, [("INN_PERSONAL", "********9047")]),
    ("код 123456789047", None, []),
    ("ИНН 1234567894", None, [("INN_LEGAL", "******7894")]),
    ("дата рождения 17.11.1988", None, [("BIRTH_DATE", "**.**.1988")]),
    ("выдан 17.11.1988", None, []),
    ("карта 4111 1111 1111 1111", None, [("BANK_CARD", "*" * 12 + "1111")]),
    ("г. Зареченск, ул. Речная", "адрес", [("ADDRESS", "г. Зар...")]),
    ("у него диагноз: грипп", None, [("HEALTH", "[HEALTH]")]),
    ("национальность: коми", None, [("RACE_NATIONALITY", "[RACE_NATIONALITY]")]),
    ("отпечатки пальцев", None, [("BIOMETRIC_MENTION", "[BIOMETRIC_MENTION]")]),
    ("политические убеждения не указаны", None, [("RELIGION_POLITICS", "[RELIGION_POLITICS]")]),
    ("", "адрес", []),
    ("   ", "адрес", []),
    (None, "адрес", []),
]


def test_rules(spark):
    rows = found(spark, [(str(n), 0, text, "s", field) for n, (text, field, _) in enumerate(RULES)]).collect()
    for n, (text, field, expected) in enumerate(RULES):
        assert sorted((r["category"], r["masked"]) for r in rows if r["path"] == str(n)) == expected, (text, field)


def test_first_wins_and_levels(spark):
    rows = [
        ("a", 2, "a@b.ru", "late", None), ("a", 1, "x a@b.ru", "first", "mail"), ("a", 1, "x a@b.ru", "first", "mail"),
        ("h", 0, "диагноз: грипп", "s", None), ("s", 0, "диагноз: грипп, СНИЛС 112-233-445 95", "s", None), ("p", 0, "карта 4111 1111 1111 1111", "s", None), ("e", 0, "ничего", "s", None),
    ]
    f = found(spark, rows)
    one = [r for r in f.collect() if r["category"] == "EMAIL"]
    assert len(one) == 1 and one[0]["source"] == "first" and one[0]["hash"] == hashlib.sha256(b"a@b.ru").hexdigest()[:16]
    levels = {r["path"]: r["uz_level"] for r in B.classify(f).collect()}
    assert levels == {"a": 4, "h": 3, "s": 1, "p": 2}
    many = spark.createDataFrame([("m", i, f"u{i}@b.ru", "s", None) for i in range(100)], CHUNK)
    assert B.classify(B.findings(many)).first()["uz_level"] == 3
    assert B.classify(B.findings(many), big=101).first()["uz_level"] == 4


def test_empty_table_and_extra_columns(spark):
    empty = spark.createDataFrame([], CHUNK + ", category string, f string, place int, hash string")
    assert B.classify(B.findings(empty)).collect() == []
    clash = spark.createDataFrame([("a", 0, "a@b.ru", "s", None, "X", "Y")], CHUNK + ", category string, hash string")
    assert [r["category"] for r in B.findings(clash).collect()] == ["EMAIL"]


def test_masks(spark):
    df = spark.createDataFrame([("EMAIL", "a@b"), ("EMAIL", "@b"), ("EMAIL", "ab"), ("PHONE", "8 (910) 245-63-18"), ("CVV", "123"), ("FIO", "Иванов И. П."), ("FIO", "..."), ("BIRTH_DATE", "1/2/1990"), ("BIRTH_DATE", "x"), ("MRZ", "P<RUS" + "A" * 20), ("HEALTH", "x"), ("ADDRESS", "ул. 5")], "c string, v string")
    got = [r[0] for r in df.select(mask(F.col("c"), F.col("v"))).collect()]
    assert got == ["a***@b", "***@b", "***", "*********18", "***", "И.(6) И.(1) П.(1)", "***", "**.**.1990", "**.**.****", "P<RUS...AA", "[HEALTH]", "***"]
    assert spark.range(1).select(mask_tail(F.lit("12345"), 0)).first()[0] == "*****"


def test_checksums_by_hand(spark):
    cases = [("snils", "112-233-445 95", True), ("snils", "112-233-445 96", False), ("inn", "123456789047", True), ("inn", "123456789048", False), ("inn", "1234567894", True), ("inn", "1234567895", False), ("luhn", "4111111111111111", True), ("luhn", "4111111111111112", False), ("luhn", "42", False), ("inn", "", False), ("snils", "abc", False)]
    fns = {"snils": V.snils_valid, "inn": V.inn_valid, "luhn": V.luhn}
    for name, value, expected in cases:
        assert spark.range(1).select(fns[name](F.lit(value))).first()[0] is expected, (name, value)


def test_sql_functions(spark):
    from sievemark.functions.sqlfuncs import register

    register(spark)
    r = spark.sql("SELECT snils_valid('112-233-445 95') AS s, inn_valid('1234567894') AS i, luhn_valid('4111111111111111') AS l, phone_key('8 910 245-63-18') AS p, uz_of_counts(0, 1, 0, 0, 0) AS u, uz_of_groups(0, 0, 0, 0, 1, true) AS g, pii_group('SNILS') AS c, pii_find_spans('a1bb22', '[0-9]+') AS f").first()
    assert (r["s"], r["i"], r["l"], r["p"], r["u"], r["g"], r["c"]) == (True, True, True, "79102456318", "УЗ-3", 1, "state_ids")
    assert [tuple(x) for x in r["f"]] == [("1", 1, 2), ("22", 4, 6)]
