"""The document profile on whole texts."""

import re

import pytest
from pyspark.sql import functions as F

from sievemark import vocab
from sievemark.functions.spans import find_spans
from sievemark.operators import classifier as C
from sievemark.operators import document as D

TEXTS = {
    "form": "Я, Воронцов Тимур Алексеевич, 17.11.1988 г. рождения\nпаспорт 52 17 118903, выдан отделом\nтелефон +7 910 245-63-18\ne-mail: t.vorontsov.synthetic@inbox.test\nИНН 123456789047\nСНИЛС 112-233-445 95",
    "special": "Состояние здоровья, биометрия, образец голоса",
    "birth": "Паспорт выдан 12.03.2020. Дата рождения: 17.11.1988. Зарегистрирован по адресу: 603104, г. Зареченск, ул. Речная, д. 5, кв. 88.",
    "card": "Банковская карта клиента: 4111 1111 1111 1111, CVV 123, срок действия 12/30.",
    "menu": "Главная Новые лица Сообщества Лаборатория ЖЖ",
    "patronymic": "customer_name | Филипп Елизарович Воробьев | Физическое лицо",
    "logistics": "Отправка со ст. Александров Гай, наб. Ставропольская, д. 98 стр. 57, 670633 на склад",
    "demo": "Пример заявления (образец, для тестирования). СНИЛС 112-233-445 95, телефон +7 910 245-63-18, email a.petrov@firma.ru",
    "twice": "тел. +7 910 245-63-18, ещё раз +7 910 245-63-18 и 8 910 245 63 18; a.petrov@firma.ru, A.Petrov@firma.ru",
    "roles": "livejournal@corp.ru, bloggers@corp.ru, pr@corp.ru",
    "wide": "ИНН １２３４５６７８９４, код 1234567894",
    "bank": "Реквизиты: р/с 40817810099910004312, БИК 044525225",
    "mrz": "passport\n" + "P<RUSVORONTSOV<<TIMUR".ljust(44, "<") + "\n",
    "blank": " \n\t ",
    "empty": "",
    "null": None,
}


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame(list(TEXTS.items()), "id string, text string")
    out = D.analyze(df, gated=True, this_year=2026).select("id", "categories", "uz", "findings_count", "recommendations").collect()
    return {r["id"]: r for r in out}


def test_reference_cases(rows):
    c = {k: r["categories"] for k, r in rows.items()}
    assert c["form"]["обычные"] >= 4 and c["form"]["государственные"] >= 3 and rows["form"]["uz"] == "УЗ-3"
    assert c["special"]["специальные"] >= 1 and c["special"]["биометрические"] >= 1 and rows["special"]["uz"] == "УЗ-1"
    assert c["birth"]["обычные"] >= 2
    assert c["card"]["платежные"] >= 2
    assert c["menu"]["обычные"] == 0
    assert c["patronymic"]["обычные"] >= 1
    assert c["logistics"]["обычные"] == 0 and c["logistics"]["биометрические"] == 0
    assert c["demo"]["государственные"] == 0 and c["demo"]["обычные"] == 0
    assert c["twice"]["обычные"] == 2
    assert c["roles"]["обычные"] == 0
    assert c["bank"]["платежные"] == 2 and rows["bank"]["uz"] == "УЗ-2"
    assert c["mrz"]["государственные"] == 1


def test_edges(rows):
    for k in ("blank", "empty", "null"):
        assert rows[k]["findings_count"] == 0 and rows[k]["uz"] == "нет признаков" and rows[k]["recommendations"] == []
    assert rows["wide"]["findings_count"] >= 1  # digits of another width do not break the checksums


def test_gate_differs(spark):
    noise = "privacy policy website " + "x" * 5000 + " расов " + "y" * 5000
    df = spark.createDataFrame([("a", noise)], "id string, text string")
    assert D.analyze(df, gated=False).first()["categories"]["специальные"] == 1
    assert D.analyze(df, gated=True).first()["categories"]["специальные"] == 0


def test_labels(spark):
    rows = [("Privacy policy of this website, all rights reserved", {"health": 1, "beliefs": 1, "other": 1}), ("По данным медосмотра, пациенту диагностирован синдром, назначено лечение", {"health": 1}), ("пациент", {})]
    df = spark.createDataFrame(rows, "text string, labels map<string,int>")
    got = [r["c"] for r in df.select(C.labels_to_counts(F.lower("text"), F.col("labels")).alias("c")).collect()]
    assert got[0]["специальные"] == 0 and got[0]["биометрические"] == 0
    assert got[1]["специальные"] == 1


def test_merge_and_levels(spark):
    one = lambda **k: C.counts(**{a: F.lit(b) for a, b in k.items()})
    c = C.add(one(обычные=1), one(обычные=1), one(специальные=1))
    r = spark.range(1).select(c.alias("c")).select("c", D.level(F.col("c")).alias("uz"), D.detected(F.col("c")).alias("d")).first()
    assert r["c"]["обычные"] == 2 and r["c"]["специальные"] == 1 and r["uz"] == "УЗ-1" and r["d"] == ["обычные", "специальные"]


PYTHON = {k: re.sub(r"\(\?[iumdU]+\)", "", getattr(vocab, k)) for k in ("EMAIL", "PHONE", "FIO", "FIO_LATIN", "DOB", "SNILS", "TEN_DIGITS", "PASSPORT", "CARD", "F_PHONE", "F_CARD", "F_DATE", "F_DRIVER")}


def test_spans_equal_finditer(spark, sf):
    """Values and places against another engine, over all file texts of the smallest set."""
    texts = [r[0] for r in spark.read.parquet(f"{sf}/extracted_content.parquet").select("text").where("text IS NOT NULL").collect()]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "😀 Иванов Иван 😀 a@b.ru\r\n17.11.1988"])], "i int, text string")
    for name, pattern in PYTHON.items():
        got = {r["i"]: [tuple(s) for s in r["s"]] for r in df.select("i", find_spans(F.col("text"), getattr(vocab, name)).alias("s")).collect()}
        for r in df.collect():
            assert got[r["i"]] == [(m.group(), m.start(), m.end()) for m in re.finditer(pattern, r["text"])], name


def test_recognised_spans(spark):
    """Spans of a recogniser confirm, exclude and add names."""
    t = "приехал Кряжев Олег и стоит Белый Яр. Жан Поль"
    df = spark.createDataFrame([(t, [("кряжев олег", 8, 19), ("жан поль", 38, 46)], [("Белый Яр", 28, 36)])], "t string, p array<struct<value:string,start:int,end:int>>, o array<struct<value:string,start:int,end:int>>")
    n = df.select(D.full_names(F.col("t"), F.lower("t"), F.col("p"), F.col("o")).alias("n")).first()["n"]
    assert sorted(n) == ["жан поль", "кряжев олег"]
