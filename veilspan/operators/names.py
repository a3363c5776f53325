"""Names by dictionaries that are too large to ship: the words of name runs are joined with the dictionaries' tables.

``detectors.person`` looks words up in sets that every worker holds. Here a dictionary is a table (kind, value) of any
size. Of each word of a run (up to four words, see ``patterns.NAME_RUN``) only the distinct ones meet the table; what they
are comes back as bits, and the rules for two and three words are column expressions over a run. Well-known people are
left out by a join on all beginnings and ends of a name.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.lexicon import Lexicon
from ..functions.tables import written

FIRST, SURNAME, PATRONYMIC = 1, 2, 4
_BITS = {"first": FIRST, "surname": SURNAME, "patronymic": PATRONYMIC}
CONFIDENCE = 0.95
_TOKENS = "array<struct<run:int,pos:int,word:string,start:int,end:int>>"
#: Feminine endings of a surname that its dictionary form doesn't have.
_FEMININE = ("а", "я")


def lexicon_table(spark, lexicon: Lexicon) -> DataFrame:
    """A lexicon as rows (kind, value); ``readers`` has others from files."""
    rows = [(kind, v) for kind, values in (("first", lexicon.first), ("surname", lexicon.surname), ("patronymic", lexicon.patronymic), ("known_person", lexicon.known)) for v in sorted(values)]
    return spark.createDataFrame(rows, "kind string, value string")


def tokens(text: Column) -> Column:
    """The words of all name runs of two words or more, case-folded, with their offsets."""
    run, word = P.compiled(P.NAME_RUN), P.compiled(r"\S+")

    @F.pandas_udf(_TOKENS)
    def split(texts: pd.Series) -> pd.Series:
        def one(t):
            if t is None or t.isascii():
                return []
            out = []
            for n, m in enumerate(run.finditer(t)):
                words = list(word.finditer(m[0]))
                if len(words) > 1:
                    out += [{"run": n, "pos": i, "word": w[0].casefold(), "start": m.start() + w.start(), "end": m.start() + w.end()} for i, w in enumerate(words)]
            return out

        return texts.map(one)

    return split(text)


def _known_words(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(word, bits) of the distinct words that the dictionary has in any way."""
    kinds = dictionary.where(F.col("kind").isin(list(_BITS))).select("value", F.create_map(*[F.lit(x) for kv in _BITS.items() for x in kv])[F.col("kind")].alias("bit"))
    kinds = kinds.groupBy("value").agg(F.bit_or("bit").alias("bits"))
    stem = F.when(F.substring("word", -1, 1).isin(*_FEMININE), F.expr("substring(word, 1, length(word) - 1)"))
    asked = words.select("word", F.explode(F.array(F.struct(F.col("word").alias("value"), F.lit(False).alias("stem")), F.struct(stem.alias("value"), F.lit(True).alias("stem")))).alias("a")).select("word", "a.*").where("value is not null")
    found = asked.join(kinds, "value").withColumn("bits", F.when(F.col("stem"), F.col("bits").bitwiseAND(SURNAME)).otherwise(F.col("bits")))
    return found.groupBy("word").agg(F.bit_or("bits").alias("bits")).where("bits > 0")


def _full_name(words: Column) -> Column:
    """Where in a run's words (word, bits, start, end, in order) the first full name is: three words before two, from the left."""

    def has(i: Column, bit: int) -> Column:
        return F.get(words, i)["bits"].bitwiseAND(bit) > 0

    def fits(at: Column) -> Column:
        n, i = at["n"], at["i"]
        three = (has(i, SURNAME) & has(i + 1, FIRST) & has(i + 2, PATRONYMIC)) | (has(i, FIRST) & has(i + 1, PATRONYMIC) & has(i + 2, SURNAME))
        two = (has(i, FIRST) & has(i + 1, SURNAME)) | (has(i, SURNAME) & has(i + 1, FIRST))
        return (i + n <= F.size(words)) & F.when(n == 3, three).otherwise(two)

    places = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(i).alias("i")) for n in (3, 2) for i in range(5 - n)])
    return F.filter(places, fits)


def find(docs: DataFrame, dictionary: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, value, start, end, confidence: a row for each name by the dictionary (kind, value) in rows of unique doc_id.

    Equals the dictionary part of ``detectors.person`` where a worker can hold the dictionary. Null texts have none.
    """
    spark_words = docs.select(F.col(doc_id).alias("doc_id"), F.explode(tokens(F.col(text))).alias("t")).select("doc_id", "t.*")
    words = written(spark_words)  # read twice
    bits = written(_known_words(words.select("word").distinct(), dictionary))
    # without a known word in it, no run can hold a name: these words go before anything is put together
    marked = words.join(bits, "word", "left").withColumn("bits", F.coalesce("bits", F.lit(0)))
    row = F.struct("pos", "word", "bits", "start", "end")
    runs = marked.groupBy("doc_id", "run").agg(F.array_sort(F.collect_list(row)).alias("words"))  # four words at most
    spots = runs.select("doc_id", "run", "words", F.posexplode(_full_name(F.col("words"))).alias("rank", "at"))
    part = F.slice("words", F.col("at.i") + 1, F.col("at.n"))
    named = spots.select("doc_id", "run", "rank", F.array_join(F.transform(part, lambda w: w["word"]), " ").alias("name"), F.get("words", F.col("at.i"))["start"].alias("start"), F.get("words", F.col("at.i") + F.col("at.n") - 1)["end"].alias("end"))
    named = written(named)
    open_ones = named.join(_known_people(named, dictionary), "name", "left_anti")
    first = F.row_number().over(Window.partitionBy("doc_id", "run").orderBy("rank"))
    chosen = open_ones.withColumn("_n", first).where("_n = 1").select("doc_id", "start", "end")
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    value = F.expr("substring(_text, start + 1, end - start)")
    return chosen.join(texts, "doc_id").select("doc_id", value.alias("value"), "start", "end", F.lit(CONFIDENCE).alias("confidence"))


def _known_people(named: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The names that are a known person's, or begin or end with a known name of several words."""
    names = named.select("name").distinct()
    n = F.length("name")
    cuts = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda k: F.array(F.substring("name", F.lit(1), k), F.substring("name", n - k + 1, k))))
    asked = names.select("name", F.explode(F.array_distinct(F.filter(cuts, lambda c: (c == F.col("name")) | F.contains(c, F.lit(" "))))).alias("value"))
    return asked.join(dictionary.where("kind = 'known_person'").select("value"), "value", "left_semi").select("name").distinct()
