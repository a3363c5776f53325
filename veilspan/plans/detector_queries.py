"""Each detector over a whole table: texts with findings and with traps are made from the customers' keys.

A case is the text and what it becomes, both as SQL that Spark and other engines read alike; the SQL of a
query only puts the expected texts together and knows nothing of detectors.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import spans
from ..functions.checks import INN10
from ..functions.lexicon import Lexicon
from ..functions.native_context import NATIVE_CONTEXT
from ..functions.tables import spread
from ..operators import address, masking, names
from ..streaming import sessions
from .registry import digits, exploded, in_turn, pick, query, table

_DAY, _MONTH, _YEAR = "lpad(CAST(k % 28 + 1 AS STRING), 2, '0')", "lpad(CAST(k % 12 + 1 AS STRING), 2, '0')", "CAST(1940 + k % 60 AS STRING)"
_DATE = f"{_DAY} || '.' || {_MONTH} || '.' || {_YEAR}"
_SERIES, _NUMBER = f"'{'4'}' || {digits(3)}", "lpad(CAST(1 + k % 999998 AS STRING), 6, '0')"
_PHONE = f"'9' || {digits(2)} || ') ' || {digits(3, 104729)} || '-' || {digits(2, 31)} || '-' || {digits(2, 37)}"
_TEN = f"'9' || {digits(9)}"


def _weighted(d: str, weights) -> str:
    return " + ".join(f"{w} * CAST(substr({d}, {i + 1}, 1) AS INT)" for i, w in enumerate(weights))


_SNILS9 = f"lpad(CAST(100000000 + k * 7919 % 800000000 AS STRING), 9, '0')"
_SNILS_SUM = f"(({_weighted(_SNILS9, range(9, 0, -1))}) % 101 % 100)"
_SNILS = f"substr({_SNILS9}, 1, 3) || '-' || substr({_SNILS9}, 4, 3) || '-' || substr({_SNILS9}, 7, 3) || ' ' || lpad(CAST({{sum}} AS STRING), 2, '0')"
_INN9 = f"lpad(CAST(100000000 + k * 104729 % 800000000 AS STRING), 9, '0')"
_INN_SUM = f"(({_weighted(_INN9, INN10)}) % 11 % 10)"


def _mark(kind: str, n: int = 1) -> str:
    return f"'__PII_{kind}_{n}__'"


def _both(before: str, value: str, after: str, kind: str) -> tuple[str, str]:
    """A text with one finding, and the same masked."""
    return f"'{before}' || {value} || '{after}'", f"'{before}' || {_mark(kind)} || '{after}'"


def _trap(text: str) -> tuple[str, str]:
    return text, text


_NAME = pick("Кузнецов Андрей Петрович", "Морозова Елена Викторовна", "Соколов Павел Иванович")
_TWO = pick("Елена Морозова", "Павел Соколов", "Ольга Белова")
_LATIN = pick("Sokolov Pavel Ivanovich", "Morozova Elena Petrovna", "Belov Oleg Igorevich")
_CITY = pick("Тверь", "Казань", "Омск", "Пермь")
_STREET = pick("Садовая", "Лесная", "Полевая")
_HOUSE = "CAST(1 + k % 90 AS STRING)"

#: query -> (types, cases)
CASES: dict[str, tuple[tuple[str, ...], list[tuple[str, str]]]] = {
    "detect_phone_strong": (
        ("PHONE",),
        [
            _both("Перезвоните: ", f"'+7 (' || {_PHONE}", ", жду", "PHONE"),
            _both("можно на ", f"'8 (' || {_PHONE}", "!", "PHONE"),
            _trap(f"'наша горячая линия +7 (' || {_PHONE}"),
            _trap(f"'бесплатно 8-800-' || {digits(3)} || '-10-' || {digits(2)}"),
            _trap(f"'номер 18 (' || {_PHONE}"),
        ],
    ),
    "detect_phone_ambiguous": (("PHONE",), [_both("мобильный ", _TEN, "", "PHONE"), _trap(f"'артикул ' || {_TEN}"), _trap(f"'код ' || {_TEN}"), _trap(f"'мобильный ' || {_TEN} || '1'")]),
    "detect_phone_foreign": (("PHONE",), [_both("my phone ", f"'+49 30 ' || {digits(4)} || ' ' || {digits(4, 31)}", "", "PHONE"), _trap(f"'total +49 30 ' || {digits(4)} || ' ' || {digits(4, 31)}")]),
    "detect_passport_internal": (
        ("PASSPORT",),
        [_both("документ ", f"{_SERIES} || ' ' || {_NUMBER}", " у него", "PASSPORT"), _both("номер ", f"'41 ' || {digits(2)} || ' № ' || {_NUMBER}", "", "PASSPORT"), _trap(f"'документ 00' || {digits(2)} || ' ' || {_NUMBER}"), _trap(f"'документ ' || {_SERIES} || ' 000000'")],
    ),
    "detect_passport_words": (
        ("PASSPORT",),
        [
            (f"'серии ' || {_SERIES} || ' номер ' || {_NUMBER} || ' мой'", f"'серии ' || {_mark('PASSPORT')} || ' номер ' || {_mark('PASSPORT', 2)} || ' мой'"),
            _trap(f"'серии 00' || {digits(2)} || ' номер ' || {_NUMBER}"),
        ],
    ),
    "detect_passport_other": (
        ("PASSPORT",),
        [
            _both("новый загранпаспорт ", f"'7' || {digits(1)} || ' ' || {digits(7)}", "", "PASSPORT"),
            _both("его военный билет ", f"'ВГ ' || {digits(7)}", "", "PASSPORT"),
            _both("иностранный паспорт ", f"'KT' || {digits(7)}", "", "PASSPORT"),
            _trap(f"'заявка 7' || {digits(1)} || ' ' || {digits(7)}"),
            _trap(f"'деталь KT' || {digits(7)}"),
        ],
    ),
    "detect_snils": (("SNILS",), [_both("страховой номер ", _SNILS.format(sum=_SNILS_SUM), " у неё", "SNILS"), _trap("'страховой номер ' || " + _SNILS.format(sum=f"(({_SNILS_SUM} + 1) % 100)"))]),
    "detect_inn": (
        ("INN",),
        [
            _both("сумма ", f"{_INN9} || CAST({_INN_SUM} AS STRING)", "", "INN"),
            _trap(f"'сумма ' || {_INN9} || CAST(({_INN_SUM} + 1) % 10 AS STRING)"),
            _both("ИНН ", f"{_INN9} || CAST(({_INN_SUM} + 1) % 10 AS STRING)", "", "INN"),
        ],
    ),
    "detect_kpp": (("KPP",), [_both("КПП ", digits(9), " компании", "KPP"), _trap(f"'сумма ' || {digits(9)}")]),
    "detect_ogrn": (("OGRN",), [_both("ОГРН ", f"'1' || {digits(12)}", "", "OGRN"), _trap(f"'счёт 1' || {digits(12)}")]),
    "detect_card_context": (("CARD",), [_both("моя карта ", f"'5100 ' || {digits(4)} || ' 77' || {digits(2, 31)} || ' ' || {digits(4, 104729)}", "", "CARD"), _trap("'карта 1234567890123456'")]),
    "detect_birth_date": (
        ("DATE_OF_BIRTH",),
        [
            _both("её дата рождения ", _DATE, ", да", "DATE_OF_BIRTH"),
            _trap(f"'её дата рождения 31.02.' || {_YEAR}"),
            _trap(f"'срок действия ' || {_DATE}"),
            _trap(f"'отчёт за ' || {_DATE}"),
        ],
    ),
    "detect_birth_date_words": (("DATE_OF_BIRTH",), [_both("он родился ", pick("седьмого мая", "двадцать первого июня", "тридцатого августа") + f" || ' ' || {_YEAR} || ' года'", "", "DATE_OF_BIRTH"), _trap(f"'уехал седьмого мая ' || {_YEAR} || ' года'")]),
    "detect_birth_date_month": (("DATE_OF_BIRTH",), [_both("она родилась ", f"CAST(k % 28 + 1 AS STRING) || ' ' || {pick('мая', 'июня', 'октября')} || ' ' || {_YEAR}", "", "DATE_OF_BIRTH"), _trap(f"'уехала ' || CAST(k % 28 + 1 AS STRING) || ' мая ' || {_YEAR}")]),
    "detect_birth_date_english": (("DATE_OF_BIRTH",), [_both("she was born on ", f"{pick('May', 'June', 'October')} || ' ' || CAST(k % 28 + 1 AS STRING) || ', ' || {_YEAR}", "", "DATE_OF_BIRTH"), _trap(f"'we left on June ' || CAST(k % 28 + 1 AS STRING) || ', ' || {_YEAR}")]),
    "detect_birth_place": (("BIRTH_PLACE",), [(f"'место рождения г. ' || {_CITY} || ', далее'", f"'место рождения г. ' || {_mark('BIRTH_PLACE')} || ', далее'"), _trap(f"'поехал в ' || {_CITY}")]),
    "detect_citizenship": (("CITIZENSHIP",), [_both("гражданство: ", pick("Республика Беларусь", "Армения", "Грузия"), ", ниже", "CITIZENSHIP"), _trap("'негражданство: никакого'")]),
    "detect_passport_authority": (("PASSPORT_AUTHORITY",), [_both("кем выдан ", "'ОВД района ' || " + pick("Северный", "Южный", "Центр"), ", потом", "PASSPORT_AUTHORITY"), _trap("'товар невыдан складом ' || CAST(k AS STRING)")]),
    "detect_unit_code": (("PASSPORT_UNIT_CODE",), [_both("код подразделения ", f"{digits(3)} || '-' || {digits(3, 31)}", "", "PASSPORT_UNIT_CODE"), _trap(f"'артикул ' || {digits(3)} || '-' || {digits(3, 31)}")]),
    "detect_issue_date": (("PASSPORT_ISSUE_DATE",), [_both("дата выдачи ", _DATE, "", "PASSPORT_ISSUE_DATE"), _both("паспорт выдан ", f"CAST(k % 28 + 1 AS STRING) || ' мая ' || {_YEAR}", "", "PASSPORT_ISSUE_DATE"), _trap(f"'встреча ' || {_DATE}")]),
    "detect_driving_license": (("DRIVING_LICENSE",), [_both("водительские права ", f"'77 ' || {digits(2)} || ' ' || {_NUMBER}", "", "DRIVING_LICENSE"), _trap(f"'накладная 77 ' || {digits(2)} || ' ' || {_NUMBER}")]),
    "detect_cvv": (("CVV",), [_both("её cvc ", digits(3), ".", "CVV"), _trap(f"'этаж ' || {digits(3)}")]),
    "detect_pin": (
        ("PIN", "CARD"),
        [
            (f"'пин-код ' || {digits(4)} || ' от карты 4111 1111 1111 1111'", f"'пин-код ' || {_mark('PIN')} || ' от карты ' || {_mark('CARD')}"),
            _trap(f"'пин-код ' || {digits(4)}"),
            (f"'в году ' || {digits(4)} || '. вот карта 4111 1111 1111 1111'", f"'в году ' || {digits(4)} || '. вот карта ' || {_mark('CARD')}"),
        ],
    ),
    "detect_card_holder": (("CARD_HOLDER",), [_both("держатель карты ", pick("OLGA BELOVA", "PAVEL SOKOLOV", "ANNA MARIA LEE"), "", "CARD_HOLDER"), _trap("'внимание ' || " + pick("SALE TODAY", "NEW PRICE"))]),
    "detect_person_dictionary": (("PERSON",), [_both("вчера звонил ", _NAME, " снова", "PERSON"), _both("вчера была ", _TWO, "", "PERSON"), _trap("'вчера был ' || " + pick("Зелёный Забор", "Красный Дом"))]),
    "detect_person_latin": (("PERSON",), [_both("we met ", _LATIN, " there", "PERSON"), _both("full name ", pick("Belov Oleg", "Olga Belova"), "", "PERSON"), _trap("'we met ' || " + pick("Big Ben", "Red Square"))]),
    "detect_person_marked": (("PERSON",), [_both("ФИО: ", pick("Мухоедов Лаврентий", "Птицелова Ефросинья"), "", "PERSON"), _both("клиент ", pick("белова ольга павловна", "соколов павел ильич"), "", "PERSON"), _trap("'закон: Мухоедов Лаврентий'")]),
    "detect_person_known": (("PERSON",), [_trap("'читаем: ' || " + pick("Лев Толстой", "Юрий Алексеевич Гагарин", "Пётр Леонидович Капица")), _both("читаем: ", _NAME, "", "PERSON")]),
    "detect_address_machine": (
        ("ADDRESS",),
        [
            (f"'RUS • ' || {digits(6, 104729)} || ' • г ' || {_CITY} || ' • ' || {_STREET} || ' ' || {_HOUSE}", f"{_mark('ADDRESS')} || ' • ' || {_mark('ADDRESS', 2)} || ' • г ' || {_mark('ADDRESS', 3)} || ' • ' || {_mark('ADDRESS', 4)} || ' ' || {_mark('ADDRESS', 5)}"),
            (f"{digits(6, 104729)} || ';;' || {_CITY} || ';;' || {_STREET} || ' ' || {_HOUSE} || ';;кв ' || {_HOUSE}", f"{_mark('ADDRESS')} || ';;' || {_mark('ADDRESS', 2)} || ';;' || {_mark('ADDRESS', 3)} || ' ' || {_mark('ADDRESS', 4)} || ';;кв ' || {_mark('ADDRESS', 5)}"),
            (f"'ул. ' || {_STREET} || ', д. ' || {_HOUSE} || ' • кв. ' || {_HOUSE} || ' • ' || {digits(6, 104729)} || ' • потом'", f"'ул. ' || {_mark('ADDRESS')} || ', д. ' || {_mark('ADDRESS', 2)} || ' • кв. ' || {_mark('ADDRESS', 3)} || ' • ' || {_mark('ADDRESS', 4)} || ' • потом'"),
            (f"'г. ' || {_CITY} || ', ' || {_STREET} || ' ' || {_HOUSE} || ' к 2'", f"'г. ' || {_mark('ADDRESS')} || ', ' || {_mark('ADDRESS', 2)} || ' ' || {_mark('ADDRESS', 3)} || ' к ' || {_mark('ADDRESS', 4)}"),
            ("'Тверская область, Калининский район'", f"{_mark('ADDRESS')} || ' область, ' || {_mark('ADDRESS', 2)} || ' район'"),
            _trap(f"'Привет, ' || {_STREET} || ' ' || {_HOUSE} || ', пока'"),
            _trap(f"'• пункт ' || {_HOUSE} || ' • заявка • потом'"),
            _trap("'ТВЕРСКАЯ ОБЛАСТЬ'"),
            _trap(f"'код ' || {digits(6, 104729)} || ' • готово'"),
        ],
    ),
    "detect_address": (
        ("ADDRESS",),
        [
            (
                f"'Проживает по адресу: ' || {digits(6, 104729)} || ', г. ' || {_CITY} || ', ул. ' || {_STREET} || ', д. ' || {_HOUSE} || '. Звонить вечером'",
                "'Проживает по адресу: ' || " + " || ".join(f"'{b}' || {_mark('ADDRESS', i + 1)}" for i, b in enumerate(("", ", г. ", ", ул. ", ", д. "))) + " || '. Звонить вечером'",
            ),
            _trap(f"'Отделение банка: г. ' || {_CITY} || ', ул. ' || {_STREET} || ', д. ' || {_HOUSE}"),
            _trap(f"'Купил ' || {_HOUSE} || ' яблок'"),
        ],
    ),
    "detect_several_types": (
        None,
        [
            (
                f"'ФИО: ' || {_NAME} || ', почта u' || k || '@mail.example.com, телефон +7 (' || {_PHONE} || ', СНИЛС ' || {_SNILS.format(sum=_SNILS_SUM)}",
                f"'ФИО: ' || {_mark('PERSON')} || ', почта ' || {_mark('EMAIL')} || ', телефон ' || {_mark('PHONE')} || ', СНИЛС ' || {_mark('SNILS')}",
            )
        ],
    ),
}


def _texts(spark, sf_dir, cases):
    return spread(table(spark, sf_dir, "customer").selectExpr("c_custkey AS k"), "k").selectExpr("k", f"{in_turn([t for t, _ in cases], 'k')} AS text")


def _register(name: str, types, cases) -> None:
    @query(f"SELECT k, {in_turn([m for _, m in cases], 'k')} AS masked FROM (SELECT c_custkey AS k FROM customer)", name)
    def run(spark, sf_dir):
        return masking.mask(_texts(spark, sf_dir, cases), policy=masking.Policy(types)).select("k", "masked")


for _name, (_types, _cases) in CASES.items():
    _register(_name, _types, _cases)

@query(f"SELECT k, CASE k % 3 WHEN 0 THEN {_NAME} ELSE {_TWO} END AS value FROM (SELECT c_custkey AS k FROM customer) WHERE k % 3 < 2")
def names_by_table(spark, sf_dir):
    """Names by a dictionary that is joined, not shipped."""
    cases = [(f"'договор подписали: ' || {_NAME} || ', свидетель'", ""), (f"'пришла ' || {_TWO} || ' одна'", ""), ("'Большая Садовая Улица, Новый Арбат'", "")]
    return names.find(_texts(spark, sf_dir, cases), names.lexicon_table(spark, Lexicon()), "k").select(F.col("doc_id").alias("k"), "value")


_NATIVE = {name: case for name, case in CASES.items() if case[0] and set(case[0]) <= set(NATIVE_CONTEXT) | set(spans.NATIVE)}


@query(" UNION ALL ".join(f"SELECT '{name}' AS query, k, {in_turn([m for _, m in cases], 'k')} AS masked FROM (SELECT c_custkey AS k FROM customer)" for name, (_, cases) in _NATIVE.items()))
def native_context_masks(spark, sf_dir):
    """The texts of all detectors that context alone decides, masked without Python."""
    out = None
    for name, (types, cases) in _NATIVE.items():
        one = masking.mask(_texts(spark, sf_dir, cases), policy=masking.Policy(types), native="context").select(F.lit(name).alias("query"), "k", "masked")
        out = one if out is None else out.union(one)
    return out


_ADDRESS = CASES["detect_address"][1][0][0]


@query(
    f"""SELECT k, g.type, g.value FROM (SELECT k, unnest([{{'type': 'zip', 'value': {digits(6, 104729)}}}, {{'type': 'city', 'value': {_CITY}}}, {{'type': 'street', 'value': {_STREET}}},
    {{'type': 'house', 'value': {_HOUSE}}}]) AS g FROM (SELECT c_custkey AS k FROM customer))"""
)
def address_granules(spark, sf_dir):
    """The parts of each customer's address."""
    rows = _texts(spark, sf_dir, [(_ADDRESS, "")])
    return exploded(rows, address.granules(F.col("text")), "k").select("k", "m.type", "m.value")


@query(
    f"""SELECT k, types, CASE k % 2 WHEN 0 THEN 'kept' ELSE 'refused' END AS outcome FROM (SELECT c_custkey AS k, ['EMAIL', 'PHONE'] AS types FROM customer)"""
)
def types_present(spark, sf_dir):
    """The types found in a text, and a policy that forbids restoring."""
    text = f"'почта u' || k || '@mail.example.com, звонить +7 (' || {_PHONE}"
    masked = masking.mask(_texts(spark, sf_dir, [(text, "")]), policy=masking.Policy(("EMAIL", "PHONE")))
    back = masking.demask(masking.demask(masked, to="kept"), to="refused", policy=masking.Policy(allow_demasking=False))
    outcome = F.when((F.col("k") % 2 == 0) & (F.col("kept") == F.col("text")), "kept").when((F.col("k") % 2 == 1) & (F.col("refused") == F.col("masked")), "refused")
    return back.select("k", F.col("pii_types").alias("types"), outcome.alias("outcome"))


@query(
    """SELECT conv_id, turn, text AS restored FROM conversations""", "sse_demask"
)
def sse_demask(spark, sf_dir):
    """Each turn comes back masked as a stream of events cut in two; the restored deltas, joined again, are the turn."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    mark = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    mapping = F.array(F.struct(F.lit("__PII_PERSON_1__").alias("placeholder"), F.col("text").alias("value")))
    event = lambda part: F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(F.lit(part).alias("content")).alias("delta"))).alias("choices"))))
    lines = F.array(F.lit(": ping"), event("__PII_PER"), event("SON_1__"), F.lit("data: [DONE]"))
    rows = turns.select(mark.alias("request_id"), mapping.alias("mapping"), F.posexplode(lines).alias("seq", "line"))
    out = sessions.demask_sse_batch(rows.select("request_id", F.col("seq").cast("long").alias("seq"), "line", "mapping"))
    delta = F.get_json_object(F.substring("line", 7, 1 << 30), "$.choices[0].delta.content")
    whole = out.withColumn("delta", F.when(F.col("line").startswith("data: {"), delta)).groupBy("request_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "part", F.coalesce("delta", F.lit("")).alias("delta")))), lambda x: x["delta"]), "").alias("restored"))
    ids = F.split("request_id", "-")
    return whole.select(F.get(ids, F.lit(0)).cast(turns.schema["conv_id"].dataType).alias("conv_id"), F.get(ids, F.lit(1)).cast(turns.schema["turn"].dataType).alias("turn"), "restored")


@query(
    "SELECT k, x.t AS pii_type, x.v AS value FROM (SELECT c_custkey AS k, unnest([{'t': 'EMAIL', 'v': 'u' || c_custkey || '@mail.example.com'}, {'t': 'CARD', 'v': '4111 1111 1111 1111'}]) AS x FROM customer)"
)
def sql_table_function(spark, sf_dir):
    """The table function in SQL text, over all customers."""
    from . import sql

    sql.register(spark)
    _texts(spark, sf_dir, [("'mail u' || k || '@mail.example.com, paid by 4111 1111 1111 1111'", "")]).createOrReplaceTempView("veilspan_texts")
    return spark.sql("SELECT t.k, s.pii_type, s.value FROM veilspan_texts t, LATERAL detect_spans(t.text) s")
