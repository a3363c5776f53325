"""Dictionaries of names: small built-in ones, and loaders for tables that users supply."""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

# Common Russian given names, written for this package.
_MALE = """александр алексей анатолий андрей антон аркадий арсений артём артем борис вадим валентин валерий василий виктор виталий
владимир владислав вячеслав геннадий георгий глеб григорий даниил денис дмитрий евгений егор иван игорь илья кирилл константин лев
леонид максим марк матвей михаил никита николай олег павел пётр петр роман руслан семён семен сергей станислав степан тимофей тимур
фёдор федор эдуард юрий яков ярослав ибрагим ринат рустам марат"""
_FEMALE = """александра алина алла анастасия ангелина анна антонина валентина валерия варвара вера вероника виктория галина дарья диана
евгения екатерина елена елизавета жанна зинаида зоя инна ирина карина кира кристина ксения лариса лидия любовь людмила маргарита
марина мария надежда наталья наталия нина оксана олеся ольга полина раиса светлана софия софья таисия тамара татьяна ульяна юлия яна"""
_SURNAMES = """иванов смирнов кузнецов попов васильев петров соколов михайлов новиков федоров фёдоров морозов волков алексеев лебедев
семенов семёнов егоров павлов козлов степанов николаев орлов андреев макаров никитин захаров зайцев соловьев соловьёв борисов яковлев
григорьев романов воробьев сергеев кузьмин фролов александров дмитриев королев королёв гусев киселев киселёв ильин максимов поляков
сорокин виноградов ковалев ковалёв белов медведев антонов тарасов жуков баранов филиппов комаров давыдов беляев герасимов богданов
осипов сидоров матвеев титов марков миронов крылов куликов карпов власов мельников денисов гаврилов тихонов казаков афанасьев данилов
савельев тимофеев фомин чернов абрамов мартынов ефимов федотов щербаков назаров калинин исаев чернышев быков маслов родионов коновалов
лазарев воронин климов филатов пономарев голубев кудрявцев прохоров наумов потапов журавлев овчинников трофимов леонов соболев ермаков
колесников гончаров емельянов никифоров грачев котов гришин ефремов архипов громов кириллов малышев панов моисеев румянцев акимов
кондратьев бирюков горбунов анисимов еремин тулаев ковальский островский"""


def patronymics_of(first: str) -> set[str]:
    """The patronymics of a male given name by the usual rules of spelling."""
    special = {"илья": "ильи", "никита": "никити", "фома": "фоми", "лев": "львови", "павел": "павлови", "пётр": "петрови", "петр": "петрови", "яков": "яковлеви", "михаил": "михайлови"}
    if first in special:
        stem = special[first]
        short = stem[:-2] if stem.endswith(("ови", "еви")) else stem[:-1]
        return {stem + "ч", (short + "вна") if stem.endswith(("ови", "еви")) else short + "ична"} | ({stem[:-1] + "на"} if stem.endswith(("ови", "еви")) else set())
    if first.endswith("ий"):
        soft = first[:-2] + ("ь" if first[-3] not in "кгх" or first[-4:-2] not in ("жк",) else "и")
        return {soft + "евич", soft + "евна", first[:-1] + "евич", first[:-1] + "евна"}
    if first.endswith(("й", "ь")):
        return {first[:-1] + "евич", first[:-1] + "евна"}
    if first.endswith(("а", "я")):
        return {first[:-1] + "ич", first[:-1] + "ична"}
    return {first + "ович", first + "овна"}


#: Well-known people, who are no personal data: laureates of the Nobel prize and cosmonauts of the first flights, from public
#: lists of these, and a few writers. Shorter forms are derived; supply your own with ``Lexicon().union("known", names)``.
KNOWN = (
    "иван петрович павлов",
    "илья ильич мечников",
    "николай николаевич семёнов",
    "игорь евгеньевич тамм",
    "павел алексеевич черенков",
    "илья михайлович франк",
    "лев давидович ландау",
    "николай геннадиевич басов",
    "александр михайлович прохоров",
    "андрей дмитриевич сахаров",
    "леонид витальевич канторович",
    "пётр леонидович капица",
    "михаил сергеевич горбачёв",
    "жорес иванович алфёров",
    "виталий лазаревич гинзбург",
    "алексей алексеевич абрикосов",
    "юрий алексеевич гагарин",
    "герман степанович титов",
    "павел романович попович",
    "валерий фёдорович быковский",
    "валентина владимировна терешкова",
    "алексей архипович леонов",
    "светлана евгеньевна савицкая",
    "александр сергеевич пушкин",
    "лев николаевич толстой",
)


def known_persons() -> frozenset[str]:
    """Full names, given name with surname, and surnames alone."""
    out = set()
    for full in KNOWN:
        parts = full.split()
        out |= {" ".join(parts), f"{parts[0]} {parts[-1]}", parts[-1]}
    return frozenset(out)


@dataclass(frozen=True)
class Lexicon:
    """Lower-cased names by kind. The defaults are the built-in ones; ``union`` adds supplied ones."""

    first: frozenset[str] = field(default_factory=lambda: frozenset((_MALE + " " + _FEMALE).split()))
    surname: frozenset[str] = field(default_factory=lambda: frozenset(_SURNAMES.split()))
    patronymic: frozenset[str] = field(default_factory=lambda: frozenset(p for m in _MALE.split() for p in patronymics_of(m)))
    known: frozenset[str] = field(default_factory=known_persons)

    def union(self, kind: str, values) -> Lexicon:
        parts = {k: getattr(self, k) for k in ("first", "surname", "patronymic", "known")}
        parts[kind] = parts[kind] | frozenset(values)
        return Lexicon(**parts)

    def is_surname(self, word: str) -> bool:
        return word in self.surname or (word[-1:] in ("а", "я") and word[:-1] in self.surname)

    def is_full_name(self, words: list[str]) -> bool:
        """Surname first patronymic, first patronymic surname, or first and surname in any order."""
        if len(words) == 2:
            a, b = words
            return a in self.first and self.is_surname(b) or self.is_surname(a) and b in self.first
        if len(words) == 3:
            a, b, c = words
            return self.is_surname(a) and b in self.first and c in self.patronymic or a in self.first and b in self.patronymic and self.is_surname(c)
        return False

    def is_known(self, value: str) -> bool:
        """Exactly a known person, or begins or ends with a known name of several words."""
        name = " ".join(value.casefold().split())
        if " " not in name or name in self.known:
            return name in self.known
        several, lengths = self._several
        return any(name[:n] in several or name[-n:] in several for n in lengths)

    @functools.cached_property
    def _several(self) -> tuple[frozenset[str], tuple[int, ...]]:
        """The known names of several words, and their lengths."""
        several = frozenset(k for k in self.known if " " in k)
        return several, tuple({len(k) for k in several})


@functools.lru_cache(maxsize=1)
def default_lexicon() -> Lexicon:
    """The built-in one, made once a process."""
    return Lexicon()
