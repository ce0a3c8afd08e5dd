"""Results that must not depend on the size, the order or the rarity of the input."""

import unicodedata

import numpy as np

from sievemark.llm import lookalike, mainbody, pii, scans
from sievemark.llm.queries import _pages, _scanned

# --- problem 1 ---------------------------------------------------------------


def test_every_composed_letter_meets_its_parts(spark):
    words = ["čeština", "žluť", "ěšř", "ňć", "źő", "ąę", "ğş", "ÿì", "ѓоѓ", "ќаќ", "Ќош", "Ўлад", "ӯз", "Ӳз", "tiếng Việt", "한국어", "ガギ", "क़लम", "βό", "Ἀρχή", "কো"]
    rows = [(2 * i + k, unicodedata.normalize(form, w)) for i, w in enumerate(words) for k, form in enumerate(("NFC", "NFD"))]
    look = {i: t for i, t in rows}
    expected = {(i, i + 1) for i in range(0, len(rows), 2) if look[i] != look[i + 1]}
    rows += [(900, "cestina"), (901, "한국아"), (902, "カキ")]
    df = spark.createDataFrame([("t", i, t) for i, t in rows], "rec_table string, rec_id long, text string")
    assert len(expected) >= len(words) - 1
    assert {(r["id_a"], r["id_b"]) for r in lookalike.pairs(lookalike.classes(df)).collect()} == expected


# --- problem 7 ---------------------------------------------------------------


def test_field_keeps_its_rows_within_a_call():
    field = pii.train()
    own = pii.Field(field.vocabulary, field.w, field.f, field.t)
    text = "Договор подписал Иванов Пётр Сергеевич, телефон +7 (912) 345-67-89."
    filler = " ".join(f"Слово{chr(1072 + i // 32)}{chr(1072 + i % 32)} Иное," for i in range(300))
    expected = pii.find_all([text, filler], pii.Field(field.vocabulary, field.w, field.f, field.t))
    assert len(expected[0]) == 2
    pii.find_all([text], own)  # the text's tokens have the first places
    own.index |= {f"#{i}": i for i in range(len(own.index), 149_990)}
    own.rows = np.concatenate([own.rows, np.zeros((2**18, *own.rows.shape[1:]), np.float32)])
    assert pii.find_all([text, filler], own) == expected
    own.index |= {f"##{i}": i for i in range(200_000)}
    assert pii.find_all([text, filler], own) == expected and len(own.index) < 1000


def test_names_in_lower_case():
    field = pii.train()
    texts = {
        "подписано по доверенности от имени иванова петра сергеевича и передано в архив": "иванова петра сергеевича",
        "заявление подал илья ильич обломов вчера вечером": "илья ильич обломов",
        "справку выдали иванову ивану ивановичу": "иванову ивану ивановичу",
        "письмо передано анне никитичне павловой по почте": "анне никитичне павловой",
        "обратилась анна петрова по поводу справки": "анна петрова",
    }
    for text, found in zip(texts, pii.find_all(texts, field)):
        assert [text[a:b] for a, b, kind in found if kind == "person_name"] == [texts[text]]
    for text in ("в романе вера и надежда спорят о мире", "вера в победу и любовь к делу"):
        assert pii.find_all([text], field) == [[]]


# --- problems 2 and 5 --------------------------------------------------------


def test_rare_lines_count_as_listed_ones(spark, sf):
    """However few lines may be broadcast, the rest are joined: the same result."""
    pages = _pages(spark, sf).cache()
    kept = [sorted(map(tuple, mainbody.keep_lines(pages, 60, common).collect())) for common in (0.0, 0.2)]
    assert kept[0] and kept[0] == kept[1]
    scanned, corpus = _scanned(spark, sf), spark.read.parquet(f"{sf}/extracted_content.parquet")
    lines = [sorted(map(tuple, scans.scan_lines(scanned, corpus, share).collect())) for share in (0.0, 0.9)]
    assert any(kind == "header" for _, _, kind in lines[0]) and lines[0] == lines[1]


def test_trees_on_pages_of_other_sites():
    """Held-out accuracy: sites, their habits and texts are not those of the training pages."""
    from sievemark.llm import page_table

    made = page_table.pages(300, 977, 25)
    commons = mainbody.count_locally([t for t, _ in made])
    model, hit, found, true = mainbody.first_model(), 0, 0, 0
    for text, body in made:
        kept = set(model.decide([mainbody.features(text, commons)])[0])
        own = {j for j, y in enumerate(body) if y}
        hit, found, true = hit + len(kept & own), found + len(kept), true + len(own)
    assert hit / found > 0.97 and hit / true > 0.97


def test_page_table_is_not_taken_from_the_test_tables(spark, sf):
    """Lines of invented pages' surroundings do not stand on the test pages, but for single everyday words."""
    from sievemark.llm import page_table

    pages = {x.strip().lower() for r in _pages(spark, sf.replace("0.001", "0.01")).select("text").collect() for x in r["text"].split("\n")}
    own = {x.lower() for n in ("_SIDE", "_FOOT", "_COOKIE", "_META", "_SHARE", "_LINK", "_AD", "_SLOGAN", "_SUBJECTS") for x in getattr(page_table, n)}
    assert not own & pages


def test_decoding_against_all_choices():
    """Over the tree of page, blocks and lines: no other choice without contradiction is worth more."""
    from itertools import product

    rng = np.random.default_rng(3)
    for _ in range(60):
        blocks, n = [], 0
        for _ in range(rng.integers(1, 5)):
            size = int(rng.integers(1, 4))
            blocks.append((n, n + size))
            n += size
        odds, own = rng.normal(0, 2.5, n), rng.normal(0, 2, len(blocks))

        def worth(kept: set[int]) -> float:
            holds = [k for k, (a, b) in enumerate(blocks) if kept & set(range(a, b))]
            total = 0.0
            for k in range(min(holds), max(holds) + 1) if holds else ():
                for j in range(*blocks[k]):
                    o = float(np.clip(odds[j], -4, 4))
                    gone = 0.3 if o >= 0 else min(mainbody.BRIDGE, -o)
                    total += o if j in kept else -gone if k not in holds or o < 0 else -1e9
                total += mainbody.BLOCK_WEIGHT * float(np.clip(own[k], -4, 4)) if k in holds else 0.0
            return total

        best = max(worth({j for j, y in enumerate(pick) if y}) for pick in product((0, 1), repeat=n))
        got = set(mainbody.decode(odds, None, blocks, own))
        assert worth(got) >= best - 1e-6, (odds, own, blocks, got)


def test_odds_decide_on_lines_like_surroundings():
    lines = [
        "Отопление — работы идут по графику", "Реклама лекарств в аптеках разрешена, " + "если знак стоит на каждом листе, " * 4 + "как и прежде.", "Политика конфиденциальности обсуждалась на встрече жильцов.",
        "Файлы cookie хранит сам читатель.", "Читайте также: Сроки ответа на запрос", "Реклама. Разбор инцидента", "Конец рассказа о доме.",
    ]
    odds = np.array([2.0, 2.0, 2.0, 2.0, -0.3, -0.3, 2.0])
    assert mainbody.decode(odds, lines) == [0, 1, 2, 3, 6]


def test_words_are_decoded_by_cost():
    """Rare and short words, two wrong letters, a missing and a needless blank; a sound rare word stands."""
    counts = {"в": 30_000, "рассмотрении": 400, "дела": 9000, "например": 500, "лицензия": 12, "акт": 5000, "листы": 4000, "и": 30_000, "у": 5000}
    lexicon = scans.Lexicon(counts, 1_000_000)
    lines = ["лицепзия акт", "лнцепзия акт", "врассмотрении дела", "на пример листы", "анг и листы", "Обезвоживание и листы"]
    read = ["лицензия акт", "лицензия акт", "в рассмотрении дела", "например листы", "анг и листы", "Обезвоживание и листы"]
    got = [scans.decode(x, lexicon, frozenset()) for x in lines]
    assert [d.text for d in got] == read
    assert [bool(d.misread) for d in got] == [True, True, True, True, False, False]
    # one lattice over line ends: a hyphen goes, stays, or was lost
    text = "в рассмо-\nтрении дела, в интер-\nакт и листы, напри\nмер акт"
    d = scans.decode(text, scans.Lexicon(counts | {"интер-акт": 50}, 1_000_000), frozenset())
    assert d.text == "в рассмотрении дела, в интер-акт и листы, например акт" and d.hyphens == {0} and not d.misread


def test_coarse_hash_over_the_whole_range():
    """Every character and its decomposition, and all look-alikes, share their coarse form."""
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    assert not [c for c in chars if (d := unicodedata.normalize("NFD", c)) != c and lookalike.coarse(c) != lookalike.coarse(d)]
    assert all(lookalike.coarse(a) == lookalike.coarse(b) for a, b in lookalike.SHAPES.items())
    assert lookalike.coarse("ａ１") == "a1" and lookalike.coarse("ё") == lookalike.coarse("е") == "e"


def test_large_classes_are_joined_in_parts(spark):
    rows = [("t", i, "а" * (i % 3) + "Сор" + "​" * (i % 3), "Сор") for i in range(60)]
    df = spark.createDataFrame(rows, "rec_table string, rec_id long, text string, canonical string")
    expected = {(a, b) for a in range(60) for b in range(a + 1, 60) if a % 3 != b % 3}
    for part in (7, 1000):
        got = [(r["id_a"], r["id_b"]) for r in lookalike.pairs(df, part).collect()]
        assert len(got) == len(expected) and set(got) == expected
