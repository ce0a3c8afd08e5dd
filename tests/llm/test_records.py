"""Headings, scanned pages, web pages and personal information on small fixtures."""

import random
import re

import numpy as np
import pytest

from sievemark.llm import mainbody, names, pii, pii_table, scans

# --- problem 4 ---------------------------------------------------------------

REF = [(1, "Фамилия", "FIO", ["surname", "last name"]), (2, "Имя", "FIO", ["first name"]), (5, "Дата рождения", "BIRTH_DATE", ["birthday"]), (6, "Место рождения", "BIRTH_PLACE", None), (9, "Номер телефона", "PHONE", ["phone"]), (10, "Рабочий телефон", "PHONE", []), (20, "Расчётный счёт", "BANK_ACCOUNT", ["р/с"]), (42, "Возраст", None, ["age"])]
HEADINGS = {
    "Фамилия": 1, "ФАМИЛИЯ ": 1, "Фаилия": 1, "Familiya": 1, "last_name": 1, "5. Фамилия": 1, "Фaмилия": 1, "Фамилия заявителя": 1, "Дата рожд.": 5, "рождения (дата)": 5, "Датарождения": 5, "Место хранения": 0, "Дата отгрузки": 0,
    "Раб. тел.": 10, "NomerTelefona": 9, "Р/С": 20, "age": 42, "page": 0, "???": 0, "-": 0, "Номер рейса": 0, "phone (обязательно)": 9, "birthday пациента": 5, "Имя 1": 2,
}


def test_headings(spark):
    ref = spark.createDataFrame(REF, "ref_id int, label string, category string, aliases array<string>")
    rows = [(i, h) for i, h in enumerate([*HEADINGS, None, "", "  ", "Фамилия"])]
    df = spark.createDataFrame(rows, "chunk_id long, field_name string")
    got = {r["chunk_id"]: r["ref_id"] for r in names.map_rows(df, ref).collect()}
    assert {h: got.get(i) for i, h in rows[: len(HEADINGS)]} == HEADINGS
    assert len(got) == len(HEADINGS) + 1 and got[rows[-1][0]] == 1
    assert {r["ref_id"] for r in names.map_rows(df, ref.limit(0)).collect()} == {0}
    assert names.map_rows(df.limit(0), ref).count() == 0


def test_headings_against_all_pairs(spark):
    """The filters lose nothing: the same result as comparing every form with every entry."""
    r = random.Random(1)
    entries = [(i, names.plain_words(n)[0]) for i, l, _, a in REF for n in [l, *(a or [])]]
    typed = []
    for _, e, _, _ in REF * 12:
        s = list(e)
        for _ in range(r.choice((1, 1, 2, 3))):
            k = r.randrange(len(s))
            s[k : k + 1] = r.choice(([], [r.choice("абвгд")], [s[k], s[k]]))
        typed.append("".join(s))
    ref = spark.createDataFrame(REF, "ref_id int, label string, category string, aliases array<string>")
    df = spark.createDataFrame([(t,) for t in typed], "field_name string")
    got = {r["field_name"]: r["ref_id"] for r in names.map_headings(df, ref).collect()}
    for t in got:
        best = (0.0, 0)
        for i, e in entries:
            a, b = set(names.grams(names.plain_words(t)[0])), set(names.grams(e))
            s = len(a & b) / len(a | b)
            if s >= names.JACCARD:
                best = min(best, (-s, i))
        assert got[t] == best[1], t


def test_many_abbreviations(spark):
    """Every completion of every shortened word is tried, in any order of words."""
    r = random.Random(2)
    tails = [a + b for a in "бвгд" for b in "аеиоу"]
    ref = spark.createDataFrame([(n + 1, f"сокращ{a} слов{b}", None, None) for n, (a, b) in enumerate((a, b) for a in tails for b in tails)], "ref_id int, label string, category string, aliases array<string>")
    df = spark.createDataFrame([("сокращбу слов.",), ("слов. сокращ.",), ("пято. друг. сокр. слов. отде. трет. клас. дива.",)], "field_name string")
    got = {r["field_name"]: r["ref_id"] for r in names.map_headings(df, ref).collect()}
    assert got["сокращбу слов."] in range(81, 101) and got["слов. сокращ."] == 1 and got["пято. друг. сокр. слов. отде. трет. клас. дива."] in (0, 1)


# --- problem 5 ---------------------------------------------------------------

WORDS = "специалисты архива проверили данные пропускной системы без участия подрядчика после сверки с интернет-портала терминалов согласно регламенту"


def test_scan():
    lex = scans.Lexicon({w: 1000 for w in WORDS.split()}, 100_000)
    text = "Дело № 77\nСпециалисты архuва прове-\nрили данные пропускной сис-\nДело № 77\n- 2 -\nтемы без участия интернет-\nпортала после сверки терми-\nпалов согласно регламенту.\n2026\nДело № 77\n- 3 -"
    d = scans.decode(text, lex, frozenset())
    lines = text.split("\n")
    assert d.headers == {0, 3, 9} and d.numbers == {4, 10} and d.hyphens == {1, 2, 6}
    assert {lines[k] for k in d.misread} == {"Специалисты архuва прове-", "палов согласно регламенту."}
    assert "архива проверили данные пропускной системы без участия интернет-портала после сверки терминалов" in d.text


@pytest.mark.parametrize("lines,expected", [(["текст", "1", "текст", "2"], {1, 3}), (["- 47 -", "897", "текст"], {0}), (["текст", "2018", "текст"], set()), (["I", "текст", "II"], {0, 2}), (["текст", "[l2]"], {1}), (["Стр. 1 из 5"], {0}), ([], set()), (["40,43"], set())])
def test_page_numbers(lines, expected):
    assert scans.page_numbers(lines) == expected


def test_scan_rows(spark):
    corpus = spark.createDataFrame([(i, WORDS) for i in range(50)], "content_id long, text string")
    rows = spark.createDataFrame([(1, "специалисты apхива прове-\nрили данные\n- 1 -"), (2, None), (3, ""), (4, " \n ")], "content_id long, text string")
    got = {(r["content_id"], r["line_no"], r["kind"]) for r in scans.scan_lines(rows, corpus.unionByName(rows)).collect()}
    assert got == {(1, 1, "hyphen"), (1, 1, "misread"), (1, 3, "page_no")}
    fixed = {r["content_id"]: r["text"] for r in scans.repaired(rows, corpus.unionByName(rows)).collect()}
    assert fixed[1] == "специалисты архива проверили данные" and fixed[2] is None and fixed[3] == ""
    assert scans.scan_lines(rows.limit(0), corpus.limit(0)).count() == 0


# --- problem 2 ---------------------------------------------------------------


def page(r, body):
    subjects = ["Операторы портала", "Аналитики банка", "Кадровики завода", "Ревизоры дирекции", "Методисты центра"]
    sentence = lambda: f"{r.choice(subjects)} {r.choice(['удалили', 'проверили', 'сверили'])} {r.choice(['личные дела', 'описи', 'талоны', 'анкеты'])} № {r.randint(1, 999)} по запросу филиала и закрыли отчёт."
    top = [f"Портал «Учёт-{r.randint(1, 20)}»", "Главная | Новости | Контакты | Поиск", "Опубликовано 12.07.2024"]
    main = [f"Порядок хранения: выпуск {r.randint(1, 99)}", sentence() + " " + sentence(), sentence() + " " + sentence(), "По теме: Разбор инцидента", sentence() + " " + sentence()]
    side = ["Популярное", "Личные дела без объяснения", "Разбор инцидента", "Погода", "Талоны по запросу филиала"]
    foot = ["Политика конфиденциальности", "© 2022 Портал «Учёт-5». Все права защищены."]
    lines = top + (main if body else []) + side + foot
    return "\n".join(lines), {len(top) + k + 1 for k in range(len(main)) if main[k] != "По теме: Разбор инцидента"} if body else set()


def test_pages(spark):
    r = random.Random(5)
    made = [page(r, n % 6 > 0) for n in range(160)]
    df = spark.createDataFrame([*[(i, t) for i, (t, _) in enumerate(made)], (900, None), (901, ""), (902, " \n")], "content_id long, text string")
    got: dict[int, set] = {}
    for row in mainbody.keep_lines(df, sample=80).collect():
        got.setdefault(row["content_id"], set()).add(row["line_no"])
    right = sum(got.get(i, set()) == kept for i, (_, kept) in enumerate(made[80:], 80))
    assert right >= 72 and not {900, 901, 902} & set(got)
    assert mainbody.keep_lines(df.limit(0)).count() == 0


def test_trees_and_region():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    m = mainbody.Trees(rounds=40).fit(x[:1500], y[:1500])
    assert ((m.odds(x[1500:]) > 0) == (y[1500:] > 0)).mean() > 0.95
    assert mainbody.decode(np.array([-3.0, 2, 2, -5, 2, -5, -5, -5, -5, 1])) == [1, 2, 4]
    assert mainbody.decode(np.array([])) == [] and mainbody.decode(np.array([-1.0])) == []


# --- problem 7 ---------------------------------------------------------------


def test_field_on_held_out_wordings():
    field = pii.train(without=1)
    rows = pii_table.labelled(seed=2024, each=6, only=1)
    found = pii.find_all([t for t, _ in rows], field)
    gold, got = ({(n, *x) for n, s in enumerate(side) for x in s} for side in ([s for _, s in rows], found))
    hit = len(gold & got)
    assert hit / len(gold) > 0.9 and hit / len(got) > 0.9


def test_table_is_not_taken_from_the_test_tables(spark, sf):
    """Neither wordings nor surnames, towns, streets and domains of the labelled table stand in the test tables."""
    text = "\n".join(r[0].lower() for n in ("extracted_content", "text_chunk", "documents") for r in spark.read.parquet(f"{sf.replace('0.001', '0.01')}/{n}.parquet").select("text").where("text is not null").collect())
    parts = {p.strip(" .,:;—").lower() for w in (*pii_table._WITH, *pii_table._WITHOUT) for p in re.split(r"\{\w\d*\}", w)}
    assert not [p for p in parts if len(p.split()) > 2 and p in text]
    words = [*pii_table.SURNAMES, *pii_table.TOWNS, *pii_table.VILLAGES, *pii_table.STREETS, *pii_table.LANES, *pii_table.NEUTER, *pii_table.AVENUES, *pii_table.ENGLISH, *pii_table.DOMAINS]
    assert not [w for w in words if re.search(rf"(?<!\w){re.escape(w.lower())}(?!\w)", text)]


CASES = {
    "Просим связаться с Камышовым В.Р. по телефону +7 (971) 555-06-78 до конца недели.": {("person_name", "Камышовым В.Р."), ("phone", "+7 (971) 555-06-78")},
    "Проживает по адресу: 285126, г. Лесной Бор, ул. Овражная, д. 61, кв. 145 (со слов соседей).": {("address", "285126, г. Лесной Бор, ул. Овражная, д. 61, кв. 145")},
    "В деле указан паспорт серии 73 12 № 620709, запись сделана карандашом.": {("id_number", "73 12 № 620709")},
    "Письмо пришло с ящика barkhatinmarat [at] uchet.invalid без подписи.": {("email", "barkhatinmarat [at] uchet.invalid")},
    "Накладная № 89129145085 закрыта без расхождений.": set(),
    "Поставщик — ООО «Гремячев и партнёры», договор бессрочный.": set(),
    "Отдел Кадров и Большой Зал закрыты 08.05.2026 с 8 до 12.": set(),
}


def test_personal_information(spark):
    df = spark.createDataFrame([*[("t", i, t) for i, t in enumerate(CASES)], ("t", 90, None), ("t", 91, ""), ("t", 92, " ")], "rec_table string, rec_id long, text string")
    got: dict[int, set] = {}
    for r in pii.personal_information(df).collect():
        got.setdefault(r["rec_id"], set()).add((r["kind"], r["value"]))
    assert {i: got.get(i, set()) for i in range(len(CASES))} == dict(enumerate(CASES.values())) and max(got) < 90
    out = {r["rec_id"]: r["text"] for r in pii.redacted(df).collect()}
    assert out[0] == "Просим связаться с [NAME] по телефону [PHONE] до конца недели." and out[90] is None and out[91] == "" and out[4] == list(CASES)[4]
    assert pii.personal_information(df.limit(0)).count() == 0


def test_viterbi_against_enumeration():
    from itertools import product

    rng = np.random.default_rng(1)
    n = len(pii.LABELS)
    t = rng.normal(size=(n, n)).astype(np.float32)
    e = rng.normal(size=(7, n)).astype(np.float32)
    ends = np.array([0, 3, 3, 7])
    best = pii.viterbi(e, t, ends)
    first = [k for k in range(n) if k % 2 or k == 0]
    for a, b in ((0, 3),):
        score = max((sum(e[a + i, y] for i, y in enumerate(p)) + sum(t[x, y] for x, y in zip(p, p[1:])), p) for p in product(first, range(n), range(n)))
        assert tuple(best[a:b]) == score[1]
