"""The labelled table of problem 2: invented web pages whose lines are known to belong to the body or not.

Sites, their menus, side columns, notices and articles are set together at
random from short lists of everyday words about gardens, sport, cooking and
travel; every site has habits of its own (separators, order of the parts, empty
lines), so that the trees learn how pages are built and not one site's words.
"""

from __future__ import annotations

import random

from .pii_table import _DID, _HOW, _WHAT, _WHO, prose

_SITES = "Газета|Магазин|Клуб|Журнал|Форум|Студия|Музей|Школа|Радио".split("|")
_NAMES = "Домовой|Сельский вестник|Тёплый дом|Семь ветров|Дачник|Попутчик|Ласточка|Своя печка|Третий тайм|Круг чтения|Волна|Большая прогулка".split("|")
_MENU = (
    "Главная|Каталог|Доставка|Оплата|Блог|Фото|Видео|Афиша|Команда|Партнёры|Обратная связь|Форум|Корзина|Войти|Регистрация|Архив|Подкасты|Расписание|Цены|Гостевая книга|О клубе|Наши авторы|Мастер-классы|Для детей|"
    "Статьи|Акции|Справка|Помощь|Магазины на карте|Скидки|Рецепты|Мероприятия|Blog|Shop|About us|Login|FAQ|Deutsch"
).split("|")
_SIDE = "Топ недели|Сейчас читают|Новое на форуме|Гороскоп|Свежие записи|Облако меток|Фото дня|Кто на сайте|Лучшее за месяц|Вам понравится|Голосование|Наши друзья|Спорт коротко|Анонсы|Ближайшие матчи|Top stories|Latest posts|Сканворд|Расписание поездов|Читайте завтра".split("|")
_FOOT = (
    "Пользовательское соглашение|Правила сообщества|Вверх ↑|16+|Мнение авторов может не совпадать с мнением редакции.|Перепечатка — только с разрешения владельца.|Нашли опечатку? Сообщите нам|Сделано в мастерской «Веснушка»|"
    "Обратная связь: форма внизу|Мы в сети|Цены на витрине не являются предложением.|Счётчик посещений|Техническая поддержка работает по будням|Лучше смотреть на большом экране|Все материалы охраняются законом.|Обработка данных посетителей|"
    "Terms and conditions|Cookie settings|Оформить рассылку|Свидетельство о регистрации № 5512|Купить рекламу|Закрыть|Показать ещё"
).split("|")
_COOKIE = (
    "Этот ресурс хранит cookie-файлы. Хорошо|Нажимая «ОК», вы принимаете правила обработки данных.|We store cookies on your device. OK|Сервис помнит ваш выбор с помощью cookie.|Оставаясь здесь, вы разрешаете сбор статистики.|"
    "Согласен на файлы cookie | Нет, спасибо|Для удобства посетителей собираем статистику. Понятно"
).split("|")
_META = "{d} мая 20{d}|12.0{i}.20{d}, 1{i}:{d}|Автор: {n}|Комментариев: {d}|Читали {d} раз|{i} минут на чтение|Метки: сад, дача, {w}|Рейтинг: {i},5|Обновлено 0{i}.1{i}.20{d}|Текст: {n}, фото: {n}|Posted on May {d}|★★★☆☆ ({d})|Раздел: {w}|Источник: {w}|Дата: {d}.0{i}.20{d}".split("|")
_SHARE = "Печать|Рассказать друзьям|Копировать ссылку|Слушать статью|Отправить другу|Сохранить в закладки|Открыть в PDF|Крупный шрифт|Tweet|Email this|Пожаловаться|Нравится".split("|")
_LINK = "Читать далее: {t}|Ещё на тему: {t}|Рекомендуем — {t}|См. ещё: {t}|Похожее: {t}|Раньше мы писали: {t}|Read more: {t}|Об этом: {t}|К слову — {t}|Ссылка по теме: {t}".split("|")
_AD = "Партнёрский материал. {t}|Спонсор показа — {s}|Реклама: {t}|Объявление. {t}|Промо: {s}|Реклама. {s}".split("|")
_SLOGAN = "{h} — {w}|Просто о сложном|Читаем вместе каждый день|{w} — {h}|Всё для дома и сада|С вами с 1998 года|{w} и {w}".split("|")
_SUBJECTS = "Ремонт|Выбор|Уход за урожаем|Выставка|История|Праздник улицы|Как хранить|Осмотр|Поездка|Турнир двора|Хранение|Заметки|Вечер памяти|Опыт соседей|Правила игры|Советы новичкам|Дорога".split("|")


def _cap(text: str) -> str:
    return text[:1].upper() + text[1:]


def title(r: random.Random) -> str:
    """A headline, or a teaser of another page."""
    k = r.random()
    what, how, subject = r.choice(_WHAT), r.choice(_HOW), r.choice(_SUBJECTS)
    if k < 0.2:
        return f"{subject} {how}"
    if k < 0.4:
        return f"{subject}: {what}"
    if k < 0.5:
        return f"{subject} (20{r.randint(10, 26)})"
    if k < 0.65:
        return _cap(f"{what} {how}")
    if k < 0.8:
        return subject
    return _cap(f"{r.choice(_WHO)} {r.choice(_DID)} {what} {how}")


def _made(wording: str, r: random.Random, site: str) -> str:
    for mark, make in (
        ("{d}", lambda: str(r.randint(10, 27))), ("{i}", lambda: str(r.randint(1, 9))), ("{n}", lambda: f"{r.choice('АВЕИКМНОС')}. {r.choice(('Иванов', 'Петрова', 'Орлов', 'Белова', 'Титов'))}"),
        ("{t}", lambda: title(r)), ("{s}", lambda: site), ("{w}", lambda: r.choice(_WHAT)), ("{h}", lambda: _cap(r.choice(_HOW))),
    ):
        while mark in wording:
            wording = wording.replace(mark, make(), 1)
    return wording


def _article(r: random.Random) -> list[str]:
    """Paragraphs, subheadings, lists and table rows."""
    out: list[str] = []
    for _ in range(r.choice((1, 1, 2, 3, 4, 6))):
        k = r.random()
        if out and k < 0.35:
            out.append(r.choice((_cap(r.choice(_HOW)), _cap(r.choice(_HOW)), _cap(r.choice(_WHAT)), f"{r.randint(1, 9)}. {_cap(r.choice(_WHAT))}", _cap(r.choice(_HOW)) + ":")))
        for _ in range(r.choice((1, 1, 2, 3))):
            text = " ".join(prose(r) for _ in range(r.choice((1, 2, 2, 3, 4))))
            if r.random() < 0.04:  # prose that speaks of what surroundings speak of
                text = r.choice(("Реклама на улицах города снова обсуждается. ", "Меню кафе и файлы cookie тут ни при чём: ", "Автор книги рассказал о саде. ", "О правах читателей говорили долго. ")) + text
            out.append(text)
        k = r.random()
        if k < 0.3:
            mark = r.choice(("— ", "• ", "- ", "{n}) ", "{n}. ", "", "mixed"))
            end = r.choice((";", ";", "", ","))
            for n in range(1, r.randint(2, 7)):
                own = r.choice(("— ", "• ", "", "{n}) ")) if mark == "mixed" else mark
                out.append(own.replace("{n}", str(n)) + r.choice(_WHAT) + (f" {r.choice(_HOW)}" if r.random() < 0.3 else "") + end)
            if end and r.random() < 0.6:
                out[-1] = out[-1][:-1] + "."
        elif k < 0.4:
            for _ in range(r.randint(1, 5)):
                out.append(" | ".join((_cap(r.choice(_WHAT)), str(r.randint(1, 999)), r.choice(("да", "нет", "шт", str(r.randint(1, 50)))))))
    return out


class _Site:
    def __init__(self, r: random.Random):
        self.name = f"{r.choice(_SITES)} «{r.choice(_NAMES)}{r.choice(('', '', f'-{r.randint(1, 60)}'))}»"
        self.menu = r.sample(_MENU, r.randint(4, 10))
        if r.random() < 0.7 and "Главная" not in self.menu:
            self.menu[0] = "Главная"
        self.slogan = _made(r.choice(_SLOGAN), r, self.name)
        self.foot = r.sample(_FOOT, r.randint(2, 7))
        self.copyright = r.choice((f"© 20{r.randint(10, 26)} {self.name}. Перепечатка запрещена.", f"© {self.name}, 20{r.randint(10, 26)}", f"Copyright 20{r.randint(10, 26)}", ""))
        self.joint = r.choice((" | ", " · ", " ", " ", "\n", " / ", " • "))
        self.arrow = r.choice((" > ", " / ", " » ", " → ", " › "))
        self.here = r.choice(("", "", "Вы тут: ", "Путь: "))
        self.cookie = r.choice(_COOKIE)
        self.side = r.sample(_SIDE, r.randint(2, 6))
        self.gaps = r.choice((0.02, 0.1, 0.2, 0.35))
        self.series = title(r) if r.random() < 0.2 else None  # a headline that comes again with another number
        self.link, self.ad = r.sample(_LINK, 2), r.choice(_AD)


def page(r: random.Random, site: _Site) -> tuple[str, list[bool]]:
    """A page and, for each of its non-empty lines, whether it belongs to the body."""
    parts: list[tuple[str, bool]] = []
    bare, empty = r.random() < 0.06, r.random() < 0.12
    head = title(r)
    if site.series and r.random() < 0.7:
        head = f"{site.series}{r.choice((': часть', ', выпуск', ' №', ': день'))} {r.randint(1, 99)}"

    def off(*lines: str) -> None:
        parts.extend((line, False) for text in lines if text for line in text.split("\n"))

    def little() -> str:
        return _made(r.choice(_META if r.random() < 0.5 else _SHARE), r, site.name)

    def side(times: int) -> None:
        for name in r.sample(site.side, min(times, len(site.side))):
            off(name)
            for _ in range(r.choice((0, 1, 2, 2, 3, 4, 5))):
                k = r.random()
                off(title(r) if k < 0.75 else prose(r).rstrip(".") if k < 0.83 else prose(r) if k < 0.93 else f"{title(r)} ({r.randint(2, 90)})")

    if not bare:
        for _ in range(r.choice((0, 0, 1, 1, 2))):
            off(site.cookie if r.random() < 0.7 else r.choice(_COOKIE))
        if r.random() < 0.6:
            off(site.name)
        if r.random() < 0.9:
            entries = list(site.menu)
            if r.random() < 0.4:
                r.shuffle(entries)
            cut = r.choice((0, 0, len(entries) // 2))
            for own in (entries[:cut], entries[cut:]):
                off(site.joint.join(own))
        if r.random() < 0.4:
            off(site.slogan if r.random() < 0.5 else _made(r.choice(_SLOGAN), r, site.name))
        if r.random() < 0.6:
            section = r.choice(_MENU[1:])
            off(site.here + site.arrow.join(("Главная", section, head)[:: 1 if r.random() < 0.9 else 2]))
        if r.random() < 0.25:
            side(r.choice((1, 1, 2)))
    if not empty:
        if not bare and r.random() < 0.25:
            off(little())
        parts.append((head, True))
        if not bare:
            for _ in range(r.choice((0, 0, 1, 2))):
                off(little())
        body = _article(r)
        for n, line in enumerate(body):
            parts.append((line, True))
            if not bare and n + 1 < len(body) and r.random() < 0.07:
                off(_made(r.choice(site.link) if r.random() < 0.7 else site.ad, r, site.name))
    if not bare:
        for _ in range(r.choice((0, 1, 1, 2, 3))):
            off(little())
        if r.random() < 0.2:
            off(_made(r.choice(site.link), r, site.name))
        if r.random() < 0.75:
            side(r.choice((1, 1, 2, 2, 3, 4)))
        off(*r.sample(site.foot, r.randint(1, len(site.foot))), site.copyright if r.random() < 0.7 else "")
    lines, kept = [], []
    for line, body in parts:
        if lines and r.random() < site.gaps:
            lines.append(r.choice(("", "", " ")))
        lines.append(line)
        kept.append(body)
    return "\n".join(lines), kept


def pages(count: int, seed: int = 11, sites: int = 60) -> list[tuple[str, list[bool]]]:
    """``count`` pages of ``sites`` sites."""
    r = random.Random(seed)
    own = [_Site(r) for _ in range(sites)]
    return [page(r, r.choice(own)) for _ in range(count)]
