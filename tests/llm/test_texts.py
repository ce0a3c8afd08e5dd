"""Look-alikes, character sets, splitting, tokens, leaks and sentences on small fixtures."""

import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievemark.llm import charset, leaks, lookalike, sentences, split, tokenize

TEXT = "rec_table string, rec_id long, text string"


# --- problem 1 ---------------------------------------------------------------


def test_lookalikes(spark):
    rows = [
        (1, "Краски и ёлки"), (2, "Kpaски и ëлки"), (3, "Краски и ёлки"), (4, "Кра​ски и ёлки"), (5, "краски и ёлки"), (6, "Краски и елки"), (7, "１２-3"), (8, "12‑3"), (9, "12²"), (10, "122"),
        (11, None), (12, ""), (13, "​"), (14, "Краски и ёлки"), (15, "копии"), (16, "копий"), (17, "копий"),
    ]
    df = spark.createDataFrame([("t", i, t) for i, t in rows], TEXT)
    got = {(r["id_a"], r["id_b"]) for r in lookalike.pairs(lookalike.classes(df)).collect()}
    same = [1, 2, 3, 4, 14]
    text = dict(rows)
    expected = {(a, b) for a in same for b in same if a < b and text[a] != text[b]} | {(7, 8), (16, 17)}
    assert got == expected
    out = {r["rec_id"]: r["text"] for r in lookalike.consistent(df).collect()}
    assert len(out) == len(rows) and {out[i] for i in same} == {"Краски и ёлки"} and out[11] is None and out[12] == "" and out[5] == "краски и ёлки"
    assert lookalike.pairs(lookalike.classes(df.limit(0))).count() == 0


# --- problem 6 ---------------------------------------------------------------


CORPUS = ["Специалисты архива проверили данные пропускной системы без участия подрядчика.", "Аналитики банка удалили номенклатуру дел по запросу филиала, всего 120 листов.", "Die Prüfer übergaben das Verzeichnis der Verträge für die spätere Prüfung.", "The archive staff scanned the visitor register at the owner’s request."]


def test_garbled(spark):
    t = CORPUS[0]
    bad = {
        1: t.encode("utf-8").decode("cp1251", "replace").replace("�", "\x98"), 2: t.encode("cp1251").decode("latin-1"), 3: t.encode("koi8-r").decode("cp1251"), 4: t.encode("cp866").decode("cp1251"),
        5: CORPUS[2].encode("utf-8").decode("latin-1"), 6: "".join("?" if ord(c) > 127 else c for c in t), 7: "�" * 9 + " архив", 8: "Die Pr?fer z?hlten", 9: CORPUS[1] + " " + t.encode("cp1251").decode("cp1252"),
    }
    good = {20: t, 21: CORPUS[2], 22: "Как так??? Кто подписал?! Где лист???", 23: "", 24: None, 25: "  ", 26: "кОНТРОЛЁРЫ БАНКА", 27: "https://a.test/x?y=z", 28: t.upper()}
    filler = [(100 + i, CORPUS[i % 4]) for i in range(200)]
    df = spark.createDataFrame([("t", i, x) for i, x in [*bad.items(), *good.items(), *filler]], TEXT)
    got = {r["rec_id"]: r["restored"] for r in charset.garbled(df, with_text=True).collect()}
    assert set(got) == set(bad)
    assert all(got[i] == t for i in (2, 3, 4)) and got[1] == t and got[5] == CORPUS[2] and got[9] == f"{CORPUS[1]} {t}" and got[6] is None
    assert charset.garbled(df.limit(0)).count() == 0


def test_segments():
    import numpy as np

    assert charset.segments(np.array([-1, 2, 3, -1, 2, -9, 5.0])) == [(1, 4, 6.0), (6, 6, 5.0)]
    assert charset.segments(np.array([])) == []


# --- problem 3 ---------------------------------------------------------------


@settings(max_examples=120, deadline=None)
@given(st.text(alphabet="ab. \n", max_size=400), st.integers(3, 40), st.data())
def test_split_round_trip(text, limit, data):
    overlap = data.draw(st.integers(0, limit - 1))
    p = split.pieces(text, limit, overlap)
    if len(text) <= limit:
        assert p == ([(0, len(text))] if text else [])
        return
    assert all(0 < b - a <= limit for a, b in p) and p[0][0] == 0 and p[-1][1] == len(text)
    assert all(q[0] == o[1] - overlap for o, q in zip(p, p[1:]))
    assert text[: p[0][1]] + "".join(text[a + overlap : b] for a, b in p[1:]) == text


def test_split_prefers_natural(spark):
    text = "Первый абзац текста.\n\nВторой абзац. Ещё одна фраза и длинное окончание строки\nконец"
    ends = [b for _, b in split.pieces(text, 40, 5)]
    assert ends[0] == text.index("Второй") and text[ends[1] - 1].isspace()
    walk, at = [], 0  # the same cuts one by one
    cuts, succ = split.successors(*split.boundaries(text), len(text), 40, 5)
    k = 0
    while k != len(cuts) - 1:
        k = int(succ[k])
        walk.append(int(cuts[k]))
    assert walk == ends
    early = "а" * 11 + "\n\n" + "б " * 60  # an early paragraph end makes no short piece
    assert all(b - a > 20 for a, b in split.pieces(early, 40, 5)[:-1])
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 3000), (4, "x" * 3001)], "content_id long, text string")
    assert [(r["content_id"], r["piece_no"], r["start_pos"], r["end_pos"]) for r in split.split_oversized(df).collect()] == [(4, 1, 1, 3000), (4, 2, 2801, 3001)]
    with pytest.raises(ValueError):
        split.pieces("x", 5, 5)


# --- problem 8 ---------------------------------------------------------------


def test_tokens(spark, sf):
    from tokenizers import Tokenizer

    rank = tokenize.default_rank_file()
    other = Tokenizer.from_file(rank.replace(".tiktoken", ".json"))
    other.encode_special_tokens = True
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r["ids"] for r in tokenize.token_ids(docs).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    assert rows.keys() == texts.keys()
    for i, t in texts.items():
        assert rows[i] == (other.encode(t, add_special_tokens=False).ids if t else [])
        assert tokenize.decode(rows[i], rank) == (t or "").encode()
    edge = spark.createDataFrame([(1, None), (2, ""), (3, "  "), (4, "<|endoftext|>"), (4, "<|endoftext|>"), (None, "a")], "doc_id long, text string")
    got = [(r["doc_id"], r["ids"]) for r in tokenize.token_ids(edge).collect()]
    assert got[0] == (1, []) and got[1] == (2, []) and len(got[2][1]) > 0 and 50256 not in got[3][1] and got[3] == got[4] and got[5][0] is None
    long = ("Строка текста номер 5.\nдальше " * 4000) + "x"
    assert (tokenize.encode(long, rank, 1000) == tokenize.encode(long, rank, 10**9)).all()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aЖ中かก1２.,'s  \n\t\x1c\xa0\u3000。，é́", max_size=120), st.integers(1, 9))
def test_token_cuts_change_nothing(text, size):
    rank = tokenize.default_rank_file()
    parts = tokenize.safe_pieces(text, size)
    assert "".join(parts) == text
    assert tokenize.encode(text, rank, size).tolist() == tokenize.encode(text, rank, 10**9).tolist()


def test_one_line_texts_are_cut():
    assert max(map(len, tokenize.safe_pieces("слово и слово, " * 9000, 1000))) < 1100
    assert max(map(len, tokenize.safe_pieces('{"a":1,"b":[2,3]},' * 9000, 1000))) < 1100


# --- problem 9 ---------------------------------------------------------------


def slow_leak(doc, item, least=10, spacing=7):
    a, b = leaks.words(doc), leaks.words(item)
    for i in range(len(a)):
        for j in range(len(b)):
            same = []
            while i + len(same) < len(a) and j + len(same) < len(b):
                same.append(a[i + len(same)] == b[j + len(same)])
                wrong = [k for k, s in enumerate(same) if not s]
                if not same[0] or any(y - x < spacing for x, y in zip(wrong, wrong[1:])):
                    break
                if same[-1] and len(same) >= least:
                    return True
    return False


def test_leaks_against_brute_force(spark):
    r = random.Random(3)
    vocabulary = [f"слово{i}" for i in range(30)]
    items = [(k, " ".join(r.choices(vocabulary, k=r.randint(8, 25)))) for k in range(12)]
    docs = []
    for n in range(150):
        w = r.choices(vocabulary, k=20)
        part = items[r.randrange(12)][1].split()
        a = r.randrange(len(part))
        part = part[a : a + r.randint(5, 16)]
        for _ in range(r.choice((0, 1, 1, 2))):
            part[r.randrange(len(part))] = "иное"
        w[7:7] = part
        docs.append((n, " ".join(w).upper() if n % 3 else ", ".join(w)))
    expected = {(i, k) for i, d in docs for k, t in items if slow_leak(d, t)}
    ds = spark.createDataFrame([*docs, (900, None), (901, ""), (902, " ")], "doc_id long, text string")
    its = spark.createDataFrame([*items, (90, None), (91, "мало слов")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in leaks.leaked_items(ds, its).collect()} == expected and len(expected) > 10
    blocks = leaks.leaked_items(ds, its, block_chars=300)
    assert {(r["doc_id"], r["item_id"]) for r in blocks.collect()} == expected
    assert leaks.leaked_items(ds, its.limit(0)).count() == 0


def test_leak_forms():
    item = "один два три четыре пять шесть семь восемь девять десять"
    L = leaks.Leaks([(1, item)])
    assert L.of(item.upper()) == [1] and L.of("Один, два; три\nчетыре пя​ть шесть сeмь ВОСЕМЬ девять — десять!") == [1]
    assert L.of(item.replace("пять", "иное")) == [1] and L.of(item.replace("два", "x").replace("шесть", "y")) == [] and L.of(" ".join(item.split()[:9])) == []


# --- problem 10 --------------------------------------------------------------


@pytest.mark.parametrize(
    "parts",
    [
        ["Он пришёл. ", "«Аналитики ушли. Всё повторилось», — сказано в акте. ", "Конец."],
        ["“Is it ready?” asked the clerk. ", "Dr. Linden and Mrs. Harrow Jr. left at 9 a.m. on the dot. ", "“The crew left.” ", "See Sec. 2.6 and Fig. 5 (p. 34) for details."],
        ["„Wo sind die Bögen?“, fragten die Prüfer. ", "Am 20. März kam Prof. Quell, vgl. Abs. 5 Nr. 7. ", "Die 2. Fassung gilt d. h. bald usw. ", "Ende."],
        ["主管说:“在哪里?”然后外部顾问更正？", "“甲。”", "“乙，共19.1页。”", "丙。"],
        ["「早く。」と言って確認した。", "次に、49.2枚を戻した？", "終わり。"],
        ["पहला वाक्य। ", "डॉ. मेहराल के अनुसार दूसरा! ", "तीसरा?"],
        ["قال د. سلمون ذلك؟ ", "راجع الفرع 31.9 صفحة. ", "انتهى."],
        ["ก่อนสิ้นเดือน ", "พิมพ์ 11.7 หน้าของรายการ ", "ฝ่ายบุคคล 54 ฉบับตามแผน"],
        ["9. Разбор инцидента\n\n", "Сумма в 3 тыс. руб. и 7 млн. экз. учтена.", "Адрес: ул. Садовая, д. 5, тел. доб. 7. ", "Было в 2020 г. ", "Потом и т. д. ", "Отчёт подписали Г. П. Ракитин и Е.Р. Снегурин. ", "(См. приложение № 6, стр. 67.)\n", "Файл отчёт.v5.docx на www.a.test/b.c цел."],
        ["Проверили следующее:\n- письма;\n- справки. ", "Операторы портала… отклонили всё… ", "Почему так долго?! ", "Вопрос «Где листы?» задали врачи."],
        ["The answer is no. ", "He left."], ["Never mind. ", "We go on."], ["This is art. ", "We like it."], ["Call me Al. ", "I am here."], ["Please give max. ", "Then we stop."],
        ["It is in Fig. 5 and No. 7 of Moore et al. Harbour Studies. ", "The end."], ["Die Prüfer nahmen max. 5 Bögen nach Art. 7 zur Hand, vgl. Kap. 3 des Berichts. ", "Ende."],
        *([f"One{chr(c)} ", "Two."] for c in (0x964, 0x16A6E, 0x16AF5, 0x1DA88)),
        ["Строка одна\nи дальше.\r\n\r\n", "Заголовок\n \n", "Текст без точки"],
    ],
)
def test_sentences(parts):
    text = "".join(parts)
    own = sentences.starts(text)
    assert [text[a:b] for a, b in zip(own, [*own[1:], None])] == parts


def test_sentence_edges(spark):
    for t in (None, "", "  \n "):
        assert sentences.starts(t) == []
    df = spark.createDataFrame([(1, " А. Б"), (2, None), (1, " А. Б"), (3, "a b " * 20000)], "doc_id long, text string")
    got = [(r["doc_id"], r["start_pos"]) for r in sentences.sentences(df).collect()]
    assert got == [(1, 2), (1, 2), (3, 1)] and sentences.sentences(df.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="Аб.!? \n«»“”()1「」。", max_size=120))
def test_sentences_cover_the_text(text):
    own = sentences.starts(text)
    assert own == sorted(set(own)) and all(not text[a].isspace() for a in own)
    assert bool(own) == bool(text.strip()) and (not own or not text[: own[0]].strip())
    assert unicodedata.is_normalized("NFC", text) or True


def test_other_languages_are_not_garbled(spark):
    """Letters of another language that a mapping fits here and there by chance."""
    rows = [(1, "Њихове ђачке књиге стоје у ћошку, а џепни речник љубазно враћају."), (2, "Їхні аркуші зберігає архів, ґанок замкнено, є опис."), (3, "Coração, ação, informação: três palavras do cartaz."), *[(100 + i, CORPUS[i % 4]) for i in range(200)]]
    df = spark.createDataFrame([("t", i, x) for i, x in rows], TEXT)
    assert charset.garbled(df).count() == 0
