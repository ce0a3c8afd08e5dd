"""The labelled table of problem 7: sentences, cards and table rows with their spans.

Everything here is general knowledge: usual first names and surnames, large
towns, usual street names, and wordings of everyday letters, shops, clinics,
schools and sports clubs, set together at random.  Numbers are drawn, no person
or address is meant.
"""

from __future__ import annotations

import random
import re

# fixed values: usual first names
MALE = """Александр Алексей Альберт Анатолий Андрей Антон Аркадий Арсений Артём Артур Богдан Борис Вадим Валентин Валерий Василий Виктор Виталий Владимир Владислав
Всеволод Вячеслав Геннадий Георгий Герман Глеб Григорий Даниил Денис Дмитрий Евгений Егор Ефим Захар Иван Игорь Илья Иннокентий Кирилл Константин Лев Леонид Макар Максим Марат Марк
Матвей Михаил Мирон Назар Никита Николай Олег Павел Пётр Платон Прохор Родион Роман Руслан Савелий Семён Сергей Станислав Степан Тарас Тимофей Тимур Фёдор Филипп Эдуард Эмиль Юрий Яков Ярослав""".split()
FEMALE = """Агата Алевтина Александра Алина Алиса Алла Альбина Анастасия Ангелина Анна Антонина Валентина Валерия Варвара Василиса Вера Вероника Виктория Галина Дарина Дарья Диана Ева Евгения
Екатерина Елена Елизавета Жанна Зинаида Зоя Инна Ирина Карина Кира Клавдия Кристина Ксения Лариса Лидия Людмила Майя Маргарита Марина Мария Милена Надежда Наталья
Нелли Нина Оксана Олеся Ольга Полина Раиса Регина Рената Римма Руфина Светлана София Софья Таисия Тамара Татьяна Ульяна Фаина Эвелина Эльвира Эмма Юлия Яна""".split()
# fixed values: the most usual surnames, without the feminine ending
SURNAMES = """Иванов Смирнов Попов Васильев Петров Михайлов Новиков Фёдоров Алексеев Яковлев Андреев Сергеев Александров Дмитриев Семёнов Степанов Николаев Орлов
Макаров Захаров Соловьёв Борисов Романов Максимов Осипов Белов Комаров Киселёв Ильин Баранов Сорокин Казаков Ефимов Антонов Егоров Титов Кудрявцев Куликов Абрамов Рыбаков
Жуков Исаев Калашников Колесников Галкин Медведев Субботин Лапшин Тарасов Носков Родионов Шубин Блинов Горшков Пономарёв Ширяев Чернышёв Быков Лыткин Третьяков Пахомов Молчанов Савин Сухарев Щукин""".split()
# fixed values: large towns, and usual street names by the form in which they stand beside the word for street
TOWNS = "Тверь|Самара|Казань|Омск|Пермь|Тюмень|Рязань|Калуга|Псков|Тула|Саратов|Ярославль|Барнаул|Великий Новгород|Нижний Тагил|Набережные Челны|Старый Оскол|Вологда|Курск|Кострома|Архангельск|Ростов|Нижний Новгород|Старая Русса|Минеральные Воды|Сергиев Посад|Великие Луки|Горячий Ключ|Павловский Посад".split("|")
VILLAGES = "Михайловка|Берёзовка|Сосновка|Покровское|Дальний|Верхняя Тура|Ильинское|Малиновка|Рождествено".split("|")
STREETS = "Ленина|Гагарина|Пушкина|Кирова|Чапаева|Горького|Пролетарская|Октябрьская|Молодёжная|Комсомольская|Вокзальная|Дачная|Парковая|Центральная|Спортивная|Тенистая|1 Мая|Третья Линия|Большая Морская|Верхняя Набережная|Степана Разина|Карла Маркса|Юных Ленинцев".split("|")
LANES = "Почтовый Банный Глухой Больничный Столярный Кузнечный Весенний Колодезный".split()
NEUTER = "Московское Киевское Ярославское Дмитровское Солнечное Пушкинское Цветное".split()
AVENUES = "Ленина|Космонавтов|Металлургов|Энтузиастов|Ветеранов|Гагарина|Красных Партизан".split("|")
ENGLISH = "King|Queen|Baker|Victoria|Elm|Maple|Cedar|High|Bridge|Green|North Hill|South Bank|Lower Marsh".split("|")
DOMAINS = "mail.org ya.net inbox.biz pochta.net gmx.de uni-tver.edu my-shop.biz region.gov.net sport.club.org zavod-73.net list.com bk.net school5.edu".split()

_LATIN = dict(zip("абвгдеёзийклмнопрстуфыэ", "abvgdeeziyklmnoprstufye")) | {"ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ь": "", "ю": "yu", "я": "ya"}


def latin(word: str) -> str:
    out = "".join(_LATIN.get(c, c) for c in word.lower())
    return out[:1].upper() + out[1:]


def first_name_stems() -> set[str]:
    """Stems and full forms of first names, ё as е."""
    out = set()
    for n in [*MALE, *FEMALE]:
        low = n.lower().replace("ё", "е")
        out.add(low)
        out.add(low[:-1] if low[-1] in "аяйь" else low)
    return {x for x in out if len(x) > 2} | {"лев", "льв", "ев", "павл", "петр", "ян"}


def latin_first_names() -> set[str]:
    out = {latin(n).lower() for n in [*MALE, *FEMALE]}
    return out | {x.replace("fedor", "fyodor") for x in out} | {"john", "mary", "peter", "anna", "james", "maria", "alexander", "artyom", "pyotr", "semyon", "paul", "thomas", "susan", "helen"}


def decline(word: str, part: str, female: bool, case: int) -> str:
    """Cases 0 nominative, 1 genitive, 2 dative, 3 accusative, 4 instrumental, 5 prepositional."""
    if case == 0:
        return word
    if part == "surname":
        if female:
            return word[:-1] + ("у" if case == 3 else "ой")
        return word + ("", "а", "у", "а", "ым", "е")[case]
    if part == "patronymic":
        return word[:-1] + ("", "ы", "е", "у", "ой", "е")[case] if female else word + ("", "а", "у", "а", "ем", "е")[case]
    if word.endswith("а"):
        return word[:-1] + ("", "и" if word[-2] in "гкхжшчщ" else "ы", "е", "у", "ой", "е")[case]
    if word.endswith("я"):
        return word[:-1] + ("", "и", "и" if word[-2] == "и" else "е", "ю", "ей", "и" if word[-2] == "и" else "е")[case]
    if word.endswith(("й", "ь")):
        return word[:-1] + ("", "я", "ю", "я", "ем", "е")[case]
    return word + ("", "а", "у", "а", "ом", "е")[case]


def patronymic(father: str, female: bool) -> str:
    stem = father[:-1] if father[-1] in "йьая" else father
    if father.endswith(("ий", "ей", "ай")):
        return stem + ("евна" if female else "евич")
    return stem + ("овна" if female else "ович")


def name(r: random.Random, case: int | None = None) -> str:
    female = r.random() < 0.5
    case = r.choice((0, 0, 1, 2, 4, 5)) if case is None else case
    base = r.choice(SURNAMES)
    sur = decline(base + "а" if female else base, "surname", female, case)
    fst_n = r.choice(FEMALE if female else MALE)
    fst = decline(fst_n, "first", female, case)
    pat_n = patronymic(r.choice(MALE), female)
    pat = decline(pat_n, "patronymic", female, case)
    k = r.random()
    if k < 0.22:
        out = f"{sur} {fst} {pat}"
    elif k < 0.36:
        out = f"{fst} {pat} {sur}"
    elif k < 0.5:
        out = f"{fst} {sur}"
    elif k < 0.56:
        out = f"{sur} {fst}"
    elif k < 0.66:
        out = f"{sur} {fst_n[0]}.{r.choice(('', ' '))}{pat_n[0]}."
    elif k < 0.76:
        out = f"{fst_n[0]}.{r.choice(('', ' '))}{pat_n[0]}. {sur}"
    elif k < 0.8:
        out = r.choice((f"{sur} {fst_n[0]}.", f"{fst_n[0]}. {sur}"))
    else:
        a, b = latin(fst_n), latin(base + ("а" if female else ""))
        out = r.choice((f"{a} {b}", f"{a} {b}", f"{b} {a}"))
        return out.lower() if r.random() < 0.1 else out
    k = r.random()
    return out.upper() if k < 0.12 else out.lower() if k < 0.24 and "." not in out else out


def phone(r: random.Random) -> str:
    a, b, c, d = r.randint(301, 999), r.randint(100, 999), r.randint(0, 99), r.randint(0, 99)
    gap = r.choice((" ", " ", " ", "\u00a0"))
    mark = r.choice(("-", "-", "-", "\u2011", "\u2013"))
    lead = r.choice(("+7", "8", "7", "+7"))
    k = r.random()
    if k < 0.14:  # other countries, and numbers without a country code in brackets
        return r.choice(
            (
                f"+{r.choice((49, 44, 33, 48))} {r.randint(10, 99)} {r.randint(10000000, 99999999)}", f"+44 20 {r.randint(1000, 9999)} {r.randint(1000, 9999)}", f"+375 {r.randint(17, 44)} {b}{mark}{c:02}{mark}{d:02}",
                f"+380 ({r.randint(39, 99)}) {b}-{c:02}-{d:02}", f"+1 ({a}) {b}-{c:02}{d:02}", f"+998{r.randint(100000000, 999999999)}",
            )
        )
    if k < 0.26:
        return f"({a}) " + r.choice((f"{b}{mark}{c:02}{mark}{d:02}", f"{b}{mark}{c:02}{d:02}", f"{b}{gap}{c:02}{gap}{d:02}", f"{c:02}-{d:02}-{b % 90 + 10}-{r.randint(0, 9)}"))
    code = r.choice((f"{gap}({a}){gap}", f"({a})", f"{gap}{a}{gap}", f"{gap}({a}) ", f"-{a}-", f".{a}.", f"{a}"))
    if code == f".{a}.":
        return f"{lead}{code}{b}.{c:02}.{d:02}"
    if code == f"{a}":
        return f"{lead}{a}{b}{c:02}{d:02}"
    return lead + code + r.choice((f"{b}{mark}{c:02}{mark}{d:02}", f"{b}{gap}{c:02}{gap}{d:02}", f"{b}{mark}{c:02}{mark}{d:02}", f"{b}{gap}{c:02}{mark}{d:02}", f"{b}{c:02}{d:02}"))


def email(r: random.Random) -> str:
    a, b = latin(r.choice(SURNAMES)).lower(), latin(r.choice(MALE + FEMALE)).lower()
    local = r.choice((f"{a}{b}", f"{b[0]}.{a}", f"{b}{r.randint(1, 99)}", f"{a}.{b[:2]}+{r.choice(('shop', 'news', 'vk'))}", f"{a}_{b}", f"{a}-{b}", r.choice(("office", "sales", "zakaz", "support.team", "hr-group", "director"))))
    at = r.choice(("@", "@", "@", "@", " [at] ", " @ ", "(собака)", " (at) ", " собака ", "[собака]"))
    domain = r.choice(DOMAINS)
    if at == " собака " or r.random() < 0.04:
        domain = domain.replace(".", " точка ")
    out = local + at + domain
    return out.upper() if r.random() < 0.05 and at == "@" else out


def passport(r: random.Random) -> str:
    s, n = f"{r.randint(1, 99):02}", f"{r.randint(100000, 999999)}"
    y = f"{r.randint(0, 25):02}"
    return r.choice((f"{s}{y}", f"{s} {y}")) + r.choice((" № ", " ", " ", "-", " №", "", "", "")) + n


def snils(r: random.Random) -> str:
    n = [r.randint(0, 9) for _ in range(9)]
    c = sum(x * w for x, w in zip(n, range(9, 0, -1))) % 101 % 100
    d = "".join(map(str, n))
    return r.choice((f"{d[:3]}-{d[3:6]}-{d[6:]} {c:02}", f"{d[:3]}-{d[3:6]}-{d[6:]}-{c:02}", f"{d}{c:02}", f"{d[:3]} {d[3:6]} {d[6:]} {c:02}"))


def inn(r: random.Random) -> str:
    n = [r.randint(0, 9) for _ in range(10)]
    n.append(sum(x * y for x, y in zip((7, 2, 4, 10, 3, 5, 9, 4, 6, 8), n)) % 11 % 10)
    n.append(sum(x * y for x, y in zip((3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8), n)) % 11 % 10)
    return "".join(map(str, n))


def address(r: random.Random) -> str:
    """Some of postcode, region, town, way, house, building and flat, in the usual forms and orders."""
    h, f, z = r.randint(1, 190), r.choice((r.randint(1, 9), r.randint(1, 400), r.randint(1, 400))), r.randint(101000, 699999)
    if r.random() < 0.09:
        flat = r.choice(("", f", apt. {f}", f", flat {f}", f", apt {f}"))
        return f"{h} {r.choice(ENGLISH)} {r.choice(('Street', 'Lane', 'Road', 'Avenue', 'Drive'))}{flat}"
    town = r.choice((*(f"г. {r.choice(TOWNS)}",) * 4, *(f"г.{r.choice(TOWNS)}",) * 2, f"город {r.choice(TOWNS)}", *(r.choice(TOWNS),) * 3, f"пос. {r.choice(VILLAGES)}", f"с. {r.choice(VILLAGES)}", f"дер. {r.choice(VILLAGES)}", f"посёлок {r.choice(VILLAGES)}"))
    s = r.choice(STREETS)
    way = r.choice(
        (
            *(f"ул. {s}",) * 5, f"{s} ул.", f"{s} ул.", f"улица {s}", f"ул.{s}", f"{r.choice(('пер.', 'переулок'))} {r.choice(LANES)}", f"{r.choice(('шоссе', 'ш.', 'набережная', 'наб.'))} {r.choice(NEUTER)}", f"бульвар {r.choice(NEUTER)}",
            f"{r.choice(('просп.', 'проспект', 'пр-кт'))} {r.choice(AVENUES)}", f"пл. {s}",
        )
    )
    own = r.choice((f"{h}", f"{h}{r.choice('АБВГ')}", f"{h}/{r.randint(1, 30)}", f"{h}", f"{h}"))
    house = r.choice((f"д. {own}", f"д. {own}", f"д.{own}", f"дом {own}", own))
    k = r.random()
    if k < 0.12:
        house, flat = f"{h}-{f}", ""
    else:
        flat = r.choice((*(f", кв. {f}",) * 3, f", кв.{f}", f", квартира {f}", "", "", f", оф. {f}"))
    block = r.choice(("", "", "", "", f", корп. {r.randint(1, 9)}", f" стр. {r.randint(1, 9)}", f", корпус {r.randint(1, 9)}", f" корп. {r.randint(1, 9)}", f", стр. {r.randint(1, 9)}"))
    out = f"{way}, {house}{block}{flat}"
    if r.random() < 0.72:
        out = f"{town}, {out}"
        if r.random() < 0.4:
            out = f"{z}, {out}"
        elif r.random() < 0.15:
            out = f"{out}, {z}"
    return out

# wordings: {n} name in case 0 to 5, {p} phone, {m} mailbox, {i} identity number by its lead, {a} address, {d} figures, {s} surname in a firm's name, {t} town, {w} prose
_WITH = (
    "Сегодня на тренировку не пришла {n0}.", "Передайте {n2}, что анализы готовы.", "Тренером сборной назначили {n1}.", "После ужина мы с {n4} смотрели альбом.", "О {n5} вспомнили только под вечер.", "Концерт вёл {n0}, гости хлопали.",
    "Арендатор: {n0}; {i}.", "Пациент {n0}, {i}, осмотрен дважды.", "Врач: {n0}", "Мастер {n0} перезвонит с {p} после обеда.", "Наберите {p}, трубку возьмёт {n0}.", "Забронировали столик на {n1}, номер {p}.",
    "Собака потерялась, звоните {p}!", "Ремонт стиральных машин, {p}, без выходных.", "Связь: {p} (спросить {n1}).", "Моб. {p}, раб. {p}", "тел {p}", "Факс {p}; почта {m}", "{p}, {m}", "Звонок поступил с {p} ночью.", "С номера {p} пришло сообщение.",
    "Мой адрес {m}, пишите.", "Резюме шлите на {m}.", "Подписка оформлена: {m}", "От: {m}", "Кому: {m}, {m}", "Логин {m} уже занят.", "Чек ушёл на {m}, проверьте.", "Ящик {m} переполнен.", "Вопросы — {m} или {p}.", "E-mail — {m}.",
    "Курьер ждёт у дома: {a}.", "Мы переехали, теперь {a}.", "Пункт выдачи: {a}", "Живу тут: {a}, заходи.", "Квартира по адресу {a} сдаётся.", "Посылку везите сюда: {a}; получает {n0}.", "Авария случилась возле {a} утром.", "Прописка — {a}.", "Место жительства: {a}; {i}",
    "Прежде семья занимала {a}; потом уехала.", "Прибыли {n0}, {n0} и {n0}.", "Победителями стали {n0} и {n0}.", "Водитель {n0}, {i}, уехал.", "Наследник {n0} предъявил {i}.", "Проверьте {i}: опечатка в цифре.", "В анкете стоит {i}, а в карте {i}.", "{i}", "Ваш {i} внесён.",
    "Кассир {n0} выдала сдачу, свидетель — {n0}.", "Книгу сдал {n0} {d2}.{d2}.20{d2}.", "Роспись: {n0}", "Утверждаю: {n0}", "Ответственная — {n0}, тел. {p}.", "Классный руководитель {n1} просит родителей перезвонить.", "Спасибо {n2} за помощь!", "Билет куплен {n4}.",
    "Гостя зовут {n0}.", "Вчера {n0} продала гараж.", "Тренировку провела {n0}, опоздал {n0}.", "Судья {n0} остановил матч.", "Сообщите {n2} и {n2}, что урок отменён.", "{w} Справку взяла {n0}.", "{w} Звонить: {p}.", "{w} Писать: {m}.", "{w} Ехать надо на {a}.", "{w} Номер: {i}.",
    "Our guest {n0} lost a key.", "{n0} won the race.", "Ring {p} after lunch, ask for {n0}.", "Mail {m} for tickets.", "He lives at {a} now.", "Send it to {a}, attn. {n0}.", "Bitte rufen Sie {p} an.", "Frau {n0} wartet.",
)
_LEADS_PASSPORT = ("паспорт", "паспорт серии", "паспорт серия", "Паспорт:", "паспорт РФ", "документ:", "паспорт гражданина РФ", "паспорт №", "серия и номер паспорта", "удостоверение", "паспортные данные:", "удостоверяющий документ:")
_LEADS_SNILS = ("СНИЛС", "СНИЛС:", "СНИЛС №", "страховой номер", "номер страхового свидетельства", "снилс", "пенсионное страхование:", "страховое")
_LEADS_INN = ("ИНН", "ИНН:", "ИНН физического лица", "инн", "ИНН гражданина", "налоговый номер", "номер налогоплательщика", "ИНН заёмщика")
_WITHOUT = (
    "{w}", "{w} {w}", "Дом Учёных и Малый Театр открыты по средам.", "Парк Победы, Горный Институт и Морской Вокзал закрыты.", "Красная Площадь и Зимний Дворец — лучшие места.", "Новый Год встретили на даче.", "Летний Лагерь принял детей.",
    "Прошивка 4.{d2}.{d3}, релиз {d5}.", "Обновили драйвер до 17.{d3}.{d2}.", "Версия {d1}.{d2}.{d3} вышла ночью.", "Деталь {d2}-{d3}-{d2} снята с продажи.", "Модель ТК-{d3}-{d2}, цвет синий.", "Партия {d4}/{d3} забракована.", "Штрих-код {d12} затёрт.", "Код {d13} на коробке.",
    "Квитанция № {d11} оплачена.", "Заявка №{d11} закрыта.", "Талон № 8{d10} просрочен.", "Договор № 7{d10} расторгнут.", "Шкаф {d2} {d2}, полка {d3}.", "Итого {d3} {d3},{d2} руб., скидка {d2} %.", "Баланс {d1} {d3} {d3},00.", "Фирма «{s} и сыновья» продаёт окна.", "ООО «{s}» выиграло торги.",
    "ЗАО «{s} и Ко» переехало.", "ИП «{s}» печёт хлеб.", "Сеть «{s}» открыла зал.", "В городе {t} тепло.", "Поезд из города {t} опоздал.", "{t} ждёт туристов.", "Самолёт сел в {t}, погода ясная.", "Том {d1}-В7, лист {d2}-й.", "ГОСТ {d2}.{d1}, приложение В{d1}-М.", "Пункт {d1}-го раздела.",
    "Наш канал @vesti_dvora, подписывайтесь.", "Пишите @pekar{d2} в чат.", "Карта {d4} {d4} {d4} {d4} действует до 09/{d2}.", "Карта {d16} утеряна.", "Счёт {d20}, банк {d9}.", "к/с 301{d17}, БИК 04{d7}", "ОГРН {d13}, ИНН {d10}, КПП {d9}", "ИНН фирмы {d10}.", "ИНН поставщика {d10}, ОКПО {d8}.",
    "Родился {d2}.{d2}.19{d2}, женат.", "Действует с 0{d1}.1{d1}.20{d2} по 0{d1}.0{d1}.20{d2}.", "Трек {d14} в пути.", "Бандероль {d14} вручена.", "Посылка RA{d9}RU получена.", "The match ended {d1}-{d1}, {d4} fans came.", "Our club moved to a bigger hall, see rule {d1}.{d1}.", "Die Schüler lernten {d3} Wörter.",
    "Инв. {d2}- № М-{d5}", "Стр. {d1} из {d2}", "- {d2} -", "© 20{d2} Газета «Вестник-{d2}». Перепечатка запрещена.", "Рецепты | Статьи | Форум | Подписка", "код | товар | цена\nА-{d3} | чайник | {d3}\nВ-{d3} | плед | {d2}", "data[{d1}].price: {d3}\ndata[{d1}].stock: False",
    "Завод имени {t} встал.", "Кафе «{t}» на ремонте.", "Гости и Хозяева остались довольны.", "Южный Порт отгрузил рыбу.", "Телефон Службы Спасения прежний.", "Код {d5}-{d2}, вес {d2} г.", "Серия {d10}, прибор МХ{d3}.", "Опрос закрыт {d2}.{d2}.20{d2}\nГолосов: {d4}",
    "Совет Директоров и Союз Писателей спорят.", "Рынок Цветов переехал.", "Музей Самоваров ждёт гостей.", "Клуб Рыбаков и Дом Пионеров закрыты.", "Открылся Центр Занятости.", "Отдел Продаж и Служба Заказов закрыты с {d1} до {d2}.", "Фонд Ветеранов собрал {d3} рублей.", "Зал Приёмов пуст.", "Собор Святых Отцов виден с реки.", "Союз Архитекторов сдал отчёт.",
    "Пекари и Кондитеры спорят о рецепте.", "Вера в удачу помогла команде.", "Надежда умирает последней.", "Любовь к музыке живёт.", "Роман напечатали в журнале.", "Лев спит, Тигр ест.", "Площадь Ленина перекрыли.", "На улице Пушкина чинят свет.", "Улица Гагарина стала шире.", "Район Дальний ждёт газ.",
    "Проспект Металлургов украсили.", "Маршрут {d2}: улица Кирова — вокзал.", "Имя | Телефон | Адрес | Итог", "имя: телефон: почта:", "name | phone | email", "Фамилия, имя, отчество", "Звонок бесплатный.", "Ключ {d3} {d3} от подвала.", "Размер {d2}-{d2}-{d2}.", "Замок {d2} {d2} {d2} заело.", "Показания {d5} {d5}.",
    "Расписание: {d2}:{d2}, {d2}:{d2}.", "Телефон сломан, экран {d1}.{d1} дюйма.", "Кабинет {d3}, этаж {d1}.", "Дом {d2}, подъезд {d1}: лифт стоит.", "Адрес: уточняется", "Почта: нет", "Номер заказа {d4}-{d4}-{d2}", "Реестр {d2}/{d4}-{d2}", "Дело {d1}-{d4}/20{d2}", "Рейс {d4}, место {d2}А", "IP 10.{d2}.{d3}.{d1}", "Широта {d2}.{d5}, долгота {d2}.{d5}",
)

# prose of no person: who, did, what, how, set together at random
_WHO = "повара|школьники|пекари нашего цеха|туристы|тренеры клуба|садоводы|рыбаки|жители двора|актёры труппы|строители моста|молодые учёные|гости фестиваля|пилоты|музыканты оркестра|лесники заповедника|ветеринары".split("|")
_DID = "накрыли|посадили|перекрасили|разобрали|выиграли|отремонтировали|сняли на камеру|потеряли|купили|обсудили|вымыли|сложили|починили|упаковали|нашли|развесили".split("|")
_WHAT = "старые лодки|новые шторы|яблони|два десятка скамеек|сценические костюмы|походные палатки|школьные парты|велосипеды|спортивный инвентарь|ёлочные игрушки|ледовые фигуры|рецепты пирогов|ноты и афиши|кормушки|карту маршрута".split("|")
_HOW = "к празднику|перед дождём|за один вечер|без лишнего шума|в честь юбилея|с большим трудом|на берегу озера|после долгого спора|по совету соседей|ради шутки|в зимнем саду|под открытым небом|из-за мороза|вопреки прогнозу".split("|")
_TAIL = "|, хотя никто не просил|, пока светло|, и все остались довольны|, как обычно|, если верить газете|: клей, краску, гвозди|, всего {n} штук|; потом пили чай|, потому что стало тесно".split("|")
_ENGLISH_PROSE = "The bakers painted the old boat|Young skiers found a map under the bridge|Our band sold {n} tickets in one evening|Fishermen mended the nets with great care|The gardeners planted apple trees|Die Kinder malten {n} Bilder|Der Chor sang im Garten".split("|")


def prose(r: random.Random) -> str:
    """A sentence about no person."""
    if r.random() < 0.12:
        return r.choice(_ENGLISH_PROSE).replace("{n}", str(r.randint(2, 400))) + "."
    parts = [r.choice(_WHO), r.choice(_DID), r.choice(_WHAT), r.choice(_HOW)]
    if r.random() < 0.4:
        parts = [parts[3], *parts[:3]] if r.random() < 0.6 else [parts[3], parts[1], parts[2]]
    text = " ".join(parts) + r.choice(_TAIL).replace("{n}", str(r.randint(2, 500))) + "."
    return text[0].upper() + text[1:]


def _fill(wording: str, r: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    out, spans, at = [], [], 0
    size = 0

    def put(text: str, kind: str | None = None) -> None:
        nonlocal size
        if kind:
            spans.append((size, size + len(text), kind))
        out.append(text)
        size += len(text)

    for m in re.finditer(r"\{(\w)(\d*)\}", wording):
        put(wording[at : m.start()])
        at = m.end()
        k, n = m.groups()
        if k == "n":
            put(name(r, int(n)), "person_name")
        elif k == "p":
            put(phone(r), "phone")
        elif k == "m":
            put(email(r), "email")
        elif k == "a":
            put(address(r), "address")
        elif k == "i":
            lead, make = r.choice(((_LEADS_PASSPORT, passport), (_LEADS_SNILS, snils), (_LEADS_INN, inn)))
            put(r.choice(lead) + r.choice((" ", " ", " ", ": ", " — ")).replace(":", "" if lead[0].endswith(":") else ":"))
            put(make(r), "id_number")
        elif k == "d":
            put("".join(str(r.randint(0 if j else 1, 9)) for j in range(int(n))))
        elif k == "s":
            put(r.choice(SURNAMES))
        elif k == "t":
            put(r.choice(TOWNS))
        elif k == "w":
            put(prose(r))
    put(wording[at:])
    return "".join(out), spans


_KEYS = {
    "n": ("Имя", "фамилия и имя", "Кто", "name", "Клиент", "full_name", "Ф.И.О.", "пассажир"), "p": ("Тел.", "номер", "phone", "моб", "Контакты", "связь", "сотовый телефон", "рабочий номер"), "m": ("почта", "email", "e-mail", "Mail"), "a": ("Адрес", "адрес доставки", "address", "куда", "прописка", "адрес проживания", "место регистрации", "домашний адрес"),
    "d3": ("итог", "qty", "цена", "№", "баллы"), "w": ("заметка", "note"),
}


def row(r: random.Random) -> str:
    """A row of a table, of a card or of nested keys, as a wording."""
    cells = r.sample(["n0", "p", "m", "a", "a", "d3", "d2"], r.choice((1, 2, 2, 3, 3, 4)))
    k = r.random()
    if k < 0.4:
        return " | ".join("{%s}" % c for c in cells)
    if k < 0.6:
        return r.choice((" | ", " | ", "; ")).join("%s: {%s}" % (r.choice(_KEYS.get(c, ("шт",))), c) for c in cells)
    if k < 0.7:
        return r.choice(("; ", ", ", "\t", "; ")).join("{%s}" % c for c in cells if c != "a" or len(cells) == 1)
    if k < 0.85:
        n = r.randint(0, 60)
        return "\n".join("%s[%d].%s: {%s}" % (r.choice(("list", "data.rows", "people")), n, r.choice(_KEYS.get(c, ("count",))), c) for c in cells)
    return "\n".join("%s: {%s}" % (r.choice(_KEYS.get(c, ("шт",))), c) for c in cells)


def labelled(seed: int = 7, each: int = 28, without: int | None = None, only: int | None = None) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Texts with ``(start, end, kind)`` spans: wordings alone, joined, on lines of a table, and broken over lines.

    For held-out accuracy every fourth wording may be left out (``without`` 0
    to 3), or taken alone (``only``).
    """
    r = random.Random(seed)

    def taken(wordings: tuple[str, ...]) -> list[str]:
        return [w for n, w in enumerate(wordings) if n % 4 != without and only in (None, n % 4)]

    single = [_fill(w, r) for w in taken(_WITH) for _ in range(each)] + [_fill(w, r) for w in taken(_WITHOUT) for _ in range(each // 2)]
    if only is not None:
        return single
    single += [_fill(row(r), r) for _ in range(each * 34)] + [_fill("{w}", r) for _ in range(each * 16)]
    r.shuffle(single)
    out = []
    k = 0
    while k < len(single):
        n = r.choice((1, 1, 2, 2, 3))
        joint = r.choice((" ", " ", "\n"))
        text, spans = "", []
        for t, s in single[k : k + n]:
            if text:
                text += joint
            spans += [(a + len(text), b + len(text), kind) for a, b, kind in s]
            text += t
        k += n
        if r.random() < 0.15:  # a scanned page breaks lines anywhere
            blanks = [m.start() for m in re.finditer(" ", text)]
            for p in r.sample(blanks, min(2, len(blanks))):
                text = text[:p] + "\n" + text[p + 1 :]
        out.append((text, spans))
    return out
