"""What each detector finds, and the traps it must not step into."""

import pytest

from veilspan.functions.lexicon import Lexicon, known_persons, patronymics_of
from veilspan.operators import address
from veilspan.operators.masking import CONSUMER_DEFAULT, Policy
from veilspan.operators.restore import Masker

CASES = [
    ("Пишите на Test.User@mail.example.com!", "Пишите на __PII_EMAIL_1__!"),
    ("+7 (912) 345-67-89 и 89123456789", "__PII_PHONE_1__ и __PII_PHONE_2__"),
    ("горячая линия +7 912 345-67-89", None),
    ("8-800-555-35-35", None),
    ("номер телефона 9123456789", "номер телефона __PII_PHONE_1__"),
    ("заказ 9123456789", None),
    ("office phone +33 14 5550 1234", "office phone __PII_PHONE_1__"),
    ("+33 14 5550 1234", None),
    ("паспорт 45 09 № 123456", "паспорт __PII_PASSPORT_1__"),
    ("паспорт 0012 123456", None),
    ("паспорт 4509 000000", None),
    ("в бланке серии 4611 номер 654987", "в бланке серии __PII_PASSPORT_1__ номер __PII_PASSPORT_2__"),
    ("загранпаспорт 71 1234567", "загранпаспорт __PII_PASSPORT_1__"),
    ("Passport AB1234567", None),
    ("паспорт иностранного гражданина AB1234567", "паспорт иностранного гражданина __PII_PASSPORT_1__"),
    ("военный билет АБ 1234567", "военный билет __PII_PASSPORT_1__"),
    ("СНИЛС 087-654-303 00", "СНИЛС __PII_SNILS_1__"),
    ("СНИЛС 087-654-303 01", None),
    ("ИНН 7707083893", "ИНН __PII_INN_1__"),
    ("ИНН 7707083890", "ИНН __PII_INN_1__"),
    ("число 7707083890", None),
    ("КПП 770701001", "КПП __PII_KPP_1__"),
    ("770701001", None),
    ("ОГРН 1027700132195", "ОГРН __PII_OGRN_1__"),
    ("4111 1111 1111 1111", "__PII_CARD_1__"),
    ("карта 4111 1111 1111 1112", "карта __PII_CARD_1__"),
    ("карта 1234567890123456", None),
    ("счёт 40817810099910004312", None),
    ("дата рождения: 15.03.1990", "дата рождения: __PII_DATE_OF_BIRTH_1__"),
    ("дата рождения 31.02.1990", None),
    ("дата рождения 29.02.2023", None),
    ("срок действия 15.03.2030", None),
    ("родился пятнадцатого марта 1990 года", "родился __PII_DATE_OF_BIRTH_1__"),
    ("родился 15 марта 1990 г.", "родился __PII_DATE_OF_BIRTH_1__"),
    ("born on March 15, 1990", "born on __PII_DATE_OF_BIRTH_1__"),
    ("meeting on March 15, 1990", None),
    ("ее место рождения город Тверь", "ее место рождения город __PII_BIRTH_PLACE_1__"),
    ("гражданство: Российская Федерация. Дальше", "гражданство: __PII_CITIZENSHIP_1__. Дальше"),
    ("кем выдан ОВД Центр 15.03.2010", "кем выдан __PII_PASSPORT_AUTHORITY_1__ __PII_PASSPORT_ISSUE_DATE_1__"),
    ("код подразделения 770-001", "код подразделения __PII_PASSPORT_UNIT_CODE_1__"),
    ("770-001", None),
    ("ее водительские права: 31 07 640218", "ее водительские права: __PII_DRIVING_LICENSE_1__"),
    ("CVV 123", "CVV __PII_CVV_1__"),
    ("дом 123", None),
    ("пин 4321", None),
    ("пин 4321 от карты 4111 1111 1111 1111", "пин __PII_PIN_1__ от карты __PII_CARD_1__"),
    ("cardholder IVAN PETROV", "cardholder __PII_CARD_HOLDER_1__"),
    ("SOME WORDS", None),
    ("Ivanov Ivan Ivanovich", "__PII_PERSON_1__"),
    ("Ivanov Ivan", None),
    ("full name Ivanov Ivan", "full name __PII_PERSON_1__"),
    ("пришёл Иванов Иван Иванович", "пришёл __PII_PERSON_1__"),
    ("пришла Анна Смирнова вчера", "пришла __PII_PERSON_1__ вчера"),
    ("СМИРНОВА АННА ПАВЛОВНА", "__PII_PERSON_1__"),
    ("ФИО: Зюзькин Аполлон", "ФИО: __PII_PERSON_1__"),
    ("клиент тулаев ибрагим идрисович", "клиент __PII_PERSON_1__"),
    ("Александр Сергеевич Пушкин", None),
    ("Иван", None),
    ("Иванов  Иван\nИванович", "__PII_PERSON_1__"),
]


@pytest.mark.parametrize(("text", "masked"), CASES)
def test_case(text, masked):
    got = Masker(Policy(excluded=("ADDRESS",))).mask(text)
    assert got == (text if masked is None else masked)


def test_pin_without_card_by_policy():
    assert Masker(Policy(("PIN",), require_card_for_pin=False)).mask("пин 4321") == "пин __PII_PIN_1__"


def test_email_beats_what_it_overlaps():
    assert Masker().mask("89123456789@mail.example.com") == "__PII_EMAIL_1__"


def test_defaults_differ():
    text = "СНИЛС 087-654-303 00"
    assert Masker().mask(text) != text and Masker(CONSUMER_DEFAULT).mask(text) == text


def test_numbers_go_on_over_texts():
    m = Masker(Policy(("EMAIL",)))
    assert [m.mask("a@b.co"), m.mask("c@d.co")] == ["__PII_EMAIL_1__", "__PII_EMAIL_2__"]
    assert m.mapping == {"__PII_EMAIL_1__": "a@b.co", "__PII_EMAIL_2__": "c@d.co"} and m.pii_types == ["EMAIL"]


def test_custom_terms():
    p = Policy(("EMAIL",), custom_terms=("Вега+", "проект икс"))
    assert Masker(p).mask("ПРОЕКТ ИКС и проект иксы") == "__PII_CUSTOM_TERM_1__ и проект иксы"


ADDRESSES = [
    ("Проживает: 170100, город Тверь", ["170100", "Тверь"]),
    ("Регистрация: 644001, Омская область, Калачинск, п. Заречный, ул. Тихая, д. 17.", ["644001", "Омская", "Калачинск", "Заречный", "Тихая", "17"]),
    ("Зарегистрирован по адресу: 420012, г. Казань, ул. Полевая, д. 3, кв. 41", ["420012", "Казань", "Полевая", "3", "41"]),
    ("Проживает: 170100, г. Тверь, ул. Садовая, д. 9. Жду ответа.", ["170100", "Тверь", "Садовая", "9"]),
    ("Проживает по адресу: 199004, г. Санкт-Петербург, ул. 5-я линия В.О., д. 12, кв. 7.", ["199004", "Санкт-Петербург", "5-я линия В.О.", "12", "7"]),
    ("ее место рождения город Тверь", []),
    ("Отделение банка: г. Омск, ул. Лесная, д. 5", []),
    ("ул.", []),
    ("", []),
]


@pytest.mark.parametrize(("text", "names"), ADDRESSES)
def test_address(text, names):
    assert [text[a:b] for a, b in address.detect(text)] == names
    assert address.mask(text).count("[АДРЕС]") == len(names)


def test_granules():
    (found,) = address.parse("Регистрация: 644001, Омская область, п. Заречный, ул. Тихая, д. 17, корп 2, кв. 5")
    assert [(g["type"], g["value"]) for g in found["granules"]] == [("zip", "644001"), ("region", "Омская область"), ("city", "Заречный"), ("street", "Тихая"), ("house", "17"), ("corpus", "2"), ("flat", "5")]


def test_lexicon():
    assert patronymics_of("иван") == {"иванович", "ивановна"}
    assert {"сергеевич", "сергеевна"} <= patronymics_of("сергей") and {"васильевич", "васильевна"} <= patronymics_of("василий")
    assert {"ильич", "ильинична"} & patronymics_of("илья")
    assert {"лев толстой", "толстой", "юрий алексеевич гагарин"} <= known_persons()
    assert Lexicon().union("first", ["аполлон"]).is_full_name(["аполлон", "иванов"])
    assert not Lexicon().is_known("иван толстой") and Lexicon().is_known("Лев  Толстой")


def test_plugin(spark):
    from pyspark.sql import functions as F

    from veilspan.operators import detectors

    def colour(text):
        return [("COLOUR", 0, 3, 1.0)] if text.startswith("red") else []

    def broken(text):
        raise ValueError("down")

    df = spark.createDataFrame([("red car",), ("blue",), (None,)], "t string")
    got = [r[0] for r in df.select(detectors.detect(F.col("t"), (), plugins={"colour": colour})).collect()]
    assert [(m.pii_type, m.value) for m in got[0]] == [("COLOUR", "red")] and got[1:] == [[], None]
    both = {"broken": broken, "colour": colour}
    assert len(df.select(detectors.detect(F.col("t"), (), plugins=both, degradation="rule_only")).first()[0]) == 1
    with pytest.raises(Exception, match="down"):
        df.select(detectors.detect(F.col("t"), (), plugins=both)).collect()


def test_known_persons_by_lookup():
    """Names that begin or end with a known one of several words, as told by going through them all."""
    lex = Lexicon()
    words = [w for k in sorted(lex.known)[::3] for w in k.split()] + ["иван", "x"]
    names = [f"{a} {b} {c}".strip() for a in words[:12] for b in words[::4] for c in ("", "лев толстой", "циолковский")] + sorted(lex.known) + [k + "х" for k in sorted(lex.known)] + ["я" + k for k in sorted(lex.known)]
    for name in names:
        assert lex.is_known(name) == (name in lex.known or any(" " in k and (name.startswith(k) or name.endswith(k)) for k in lex.known))
