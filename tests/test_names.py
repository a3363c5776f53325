"""Names by joined dictionaries against the dictionaries that a worker holds."""

import random

from veilspan.functions import patterns
from veilspan.functions.lexicon import Lexicon
from veilspan.operators import names

LEX = Lexicon(frozenset(["иван", "анна", "пётр"]), frozenset(["иванов", "белов", "анна"]), frozenset(["иванович", "петровна"]), frozenset(["лев толстой", "иван белов", "пушкин"]))


def held(text):
    """The rules over one text, with the sets at hand."""
    out = []
    for m in patterns.compiled(patterns.NAME_RUN).finditer(text or ""):
        words = [(w[0].casefold(), m.start() + w.start(), m.start() + w.end()) for w in patterns.compiled(r"\S+").finditer(m[0])]
        for n, i in ((n, i) for n in (3, 2) for i in range(len(words) - n + 1)):
            part = words[i : i + n]
            if LEX.is_full_name([w[0] for w in part]) and not LEX.is_known(" ".join(w[0] for w in part)):
                out.append((text[part[0][1] : part[-1][2]], part[0][1], part[-1][2]))
                break
    return out


def test_like_the_held_dictionary(spark):
    r = random.Random(1)
    words = ["Иван", "ИВАН", "Анна", "Пётр", "Иванов", "Иванова", "Белов", "Белова", "Иванович", "Петровна", "Толстой", "Лев", "Дом", "и", ",", "\n", "  ", "Пушкин"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(1, 12))) for _ in range(400)]
    texts += [None, "", "plain ascii", "Иванова  Анна\nПетровна", "Иван Белова", "Лев Толстой Иванов", "Анна Анна"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {}
    for x in names.find(df, names.lexicon_table(spark, LEX)).collect():
        got.setdefault(x.doc_id, []).append((x.value, x.start, x.end))
        assert x.confidence == 0.95
    want = {i: held(t) for i, t in enumerate(texts) if held(t)}
    assert len(want) > 100 and {i: sorted(v) for i, v in got.items()} == {i: sorted(v) for i, v in want.items()}


def test_the_detector_agrees(spark):
    from veilspan.functions.context import Doc
    from veilspan.operators import detectors

    text = "Договор: Иванов Иван Иванович и Анна Белова; Иван Белов свободен"
    own = [(text[a:b], a, b) for k, a, b, c in detectors.person(LEX)(Doc(text)) if c == 0.95]
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert sorted((x.value, x.start, x.end) for x in names.find(df, names.lexicon_table(spark, LEX)).collect()) == sorted(own) == sorted(held(text))
