import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from veilspan.llm import langid, queries, toxicity


def test_toxicity_finds_words_and_sentences(spark):
    r = np.random.default_rng(0)
    words = [f"word{i}" for i in range(60)]

    def text(bad):
        s = [" ".join(r.choice(words, 8)).capitalize() + "." for _ in range(6)]
        if bad:
            s[3] = "You absolute nitwit face."
        return " ".join(s)

    rows = [(i, text(i % 4 == 0), "x") for i in range(400)]
    docs = spark.createDataFrame(rows + [(1000, None, ""), (1001, "", ""), (None, "You nitwit.", ""), (3, rows[3][1], "")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(400)] + [(None, 1, 1), (1000, 1, 1), (5, None, 0)], "doc_id long, toxic int, quality int")
    model = toxicity.train(docs, labels, ~toxicity.is_held_out(F.col("doc_id")))
    got = toxicity.score(docs, model).collect()
    assert len(got) == 404 and all(0 <= x.score <= 1 for x in got)
    held = [x for x in got if x.doc_id is not None and x.doc_id < 400]
    assert np.mean([(x.score >= 0.5) == (x.doc_id % 4 == 0) for x in held]) > 0.97
    assert next(x.score for x in got if x.doc_id is None) >= 0.5
    assert next(x.score for x in got if x.doc_id == 1001) < 0.5
    found = toxicity.locate(docs.where("doc_id = 4"), model).collect()
    assert [f.sentence.strip() for f in found] == ["You absolute nitwit face."]
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.where("text like '%nitwit%'").count() == 0
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.train(docs, none, F.lit(True))).collect()
    assert all(abs(x.score - 0.5) < 1e-4 for x in out)
    one = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert all(x.score < 0.5 for x in toxicity.score(docs, toxicity.train(docs, one, F.lit(True))).collect())


def test_toxicity_with_clashing_columns(spark):
    """Columns named like those of the labels, of the scores or of the joins change nothing."""
    rows = [(i, "you nitwit" if i % 2 else f"nice day {i}", i % 2) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    plain = toxicity.score(docs, toxicity.train(docs, labels, F.col("doc_id") >= 0)).collect()
    clash = docs.withColumns({"toxic": F.lit(1), "score": F.lit("x"), "thash": F.lit(0), "label": F.lit(1), "count": F.lit(2)})
    model = toxicity.train(clash, labels.withColumns({"text": F.lit("t"), "doc": F.lit(1)}), F.col("doc_id") >= 0)
    assert sorted(map(tuple, toxicity.score(clash, model).collect())) == sorted(map(tuple, plain))
    assert toxicity.keep_clean(clash, model).columns == clash.columns


def test_long_texts_teach_by_a_stretch(spark):
    from veilspan.llm._shared import sliced

    long = [(i, f"das ist ein langer text von nummer {i} und er geht weiter ä " * 700, "de") for i in range(20)]
    short = [(100 + i, f"the short text number {i} of the other tongue", "en") for i in range(20)]
    df = spark.createDataFrame(long + short, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(df, langid.train(df, F.lit(True))).collect()}
    assert all(got[i] == ("de" if i < 100 else "en") for i in got)
    huge = spark.createDataFrame([("x" * 300_000,), (None,), ("",)], "t string").select(sliced(F.col("t"), 16384).alias("s")).collect()
    assert [r.s if r.s is None else len(r.s) for r in huge] == [16384, None, 0]
    part = df.select("text", sliced(F.col("text"), 1000).alias("s")).collect()
    assert all(r.s in r.text and len(r.s.encode()) <= 1100 and (r.s == r.text or len(r.s) > 900) for r in part)


def test_noisy_or_is_the_product():
    z, first = np.array([-2.0, 0.3, 1.0, -5.0]), np.array([0, 2, 3, 4])
    p = 1 / (1 + np.exp(-z))
    leak = 1 / (1 + np.exp(4.0))
    whole = [1 - (1 - leak) * np.prod(1 - p[a:b]) for a, b in zip(first, first[1:])]
    assert np.allclose(toxicity.noisy_or(z, first, -4.0), whole)


def test_toxicity_held_out_accuracy(spark):
    base = "/root/testdata/sf0.1"
    got = queries.op10_toxicity(spark, base).join(spark.read.parquet(f"{base}/labels.parquet"), "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in got}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.8 and n.get((0, 1), 0) / n[0, 0] < 0.02


def test_language_held_out_accuracy(spark):
    base = "/root/testdata/sf0.1"
    got = queries.op5_language_id(spark, base).join(spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() / got.count() > 0.98


def test_language_counts_are_the_filters(spark):
    texts = [b"the cat sat on the mat and the dog", b"der hund und die katze auf der matte"] * 3
    model = langid.fit(texts, ["en", "de"] * 3)
    data, offsets = np.frombuffer(b"the cat and the dog", np.uint8), np.array([0, 19])
    best, score = langid.predict(model, data, offsets)
    assert model.langs[best[0]] == "en" and 0.5 < score[0] <= 1
    h, _ = langid.grams(data, offsets)
    known = set()
    for t in texts[::2]:
        known |= set(langid.grams(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0].tolist())
    bit = 1 << model.langs.index("en")
    for x in h:
        slots = [int(langid._slots(np.array([x]), j)[0]) for j in range(langid.HASHES)]
        assert (int(x) in known) <= all(model.planes[0][s] & bit for s in slots)


def test_language_many_languages_and_odd_rows(spark):
    langs = [f"l{i:03d}" for i in range(70)]
    texts = [f"{'abcdefghij'[i % 10] * 3}{'klmnopqrst'[i // 10 % 10] * 4} word{i}word".encode() for i in range(70)]
    model = langid.fit(texts, langs)
    assert len(model.planes) == 2
    df = spark.createDataFrame([(i, t.decode(), "x", None) for i, t in enumerate(texts)] + [(100, None, "", ""), (101, "", "", ""), (102, "12 -- 3", "", ""), (103, "é", "", ""), (None, "漢", "", ""), (5, texts[5].decode(), "", "")], "doc_id long, text string, score string, lang string")
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(df, model).collect()}
    assert all((i, langs[i]) in got for i in range(70))
    assert {(100, "und"), (101, "und"), (102, "und")} <= got and all(p != "und" for i, p in got if i in (103, None))
    assert langid.identify(df, langid.fit([], [])).where("lang_pred <> 'und'").count() == 0
    assert langid.identify(df.limit(0), model).count() == 0


def test_toxicity_like_plain_python():
    """Sentences, words, weights and the noisy-or, worked out again one by one from the learned weights."""
    import math

    r = np.random.default_rng(3)
    ordinary, bad = [f"word{k}" for k in range(60)], ["vilest", "scumbag", "horridly"]
    texts, labels = [], []
    for i in range(400):
        toxic = i % 2
        lines = [" ".join(r.choice(ordinary, 6)) for _ in range(int(r.integers(1, 5)))]
        if toxic:
            lines[int(r.integers(0, len(lines)))] += " " + bad[i % 3]
        texts.append(". ".join(lines) + ".")
        labels.append(toxic)
    model = toxicity.fit(pa.array(texts, pa.string()), np.array(labels))
    weight = dict(zip(model.hashes.tolist(), model.weights.tolist()))
    assert weight
    ends, inside = ({b for b in range(256) if t[b]} for t in (toxicity._END, toxicity._WORD))

    def hashed(piece, seed):
        return int(toxicity.span_hash(toxicity.LOWER[np.frombuffer(piece, np.uint8)], np.array([0]), np.array([len(piece)]), seed=seed)[0])

    def plain(text):
        data, clean = text.encode(), 1 - 1 / (1 + math.exp(-model.leak))
        starts = [0] + [i for i in range(1, len(data)) if data[i - 1] in ends and data[i] not in ends]
        for a, b in zip(starts, [*starts[1:], len(data)]):
            words, word = [], b""
            for c in [*data[a:b], None]:
                if c is not None and c in inside:
                    word += bytes([c])
                elif word:
                    words.append(word)
                    word = b""
            found = {hashed(w, 3) for w in words} | {hashed(w[:n], 3 + n) for w in words for n in toxicity.PREFIXES if len(w) > n}
            z = toxicity.BIAS + sum(weight.get(h, 0.0) for h in found)
            clean *= 1 - 1 / (1 + math.exp(-z))
        return 1 - clean

    asked = [*texts[:40], "", "VILEST vilest scumbag!", "word1 word2\nvilest", "é vilestly? so!! word3", "...", "scumbag"]
    data = "".join(asked).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in asked)])
    got = toxicity.Trained(model).scores(np.frombuffer(data, np.uint8), offsets)
    assert np.allclose(got, [plain(t) for t in asked], atol=1e-9)
    assert got[asked.index("scumbag")] > 0.5 > got[asked.index("")]


def test_language_prediction_like_plain_python():
    """Counts by language, their correction, the prior, the choice and the score, gram by gram."""
    texts = [b"the cat sat on the mat and the dog ran", b"der hund und die katze auf der matte hier", "el niño está aquí con el gato".encode()] * 3
    names = ["en", "de", "es"] * 3
    model = langid.fit(texts, names)
    asked = [b"the dog and the cat", "der Hund está".encode(), b"", b"abcd", b"zzzzzzzzzz", "niño niño".encode(), b"THE MAT"]
    best, score = langid.predict(model, np.frombuffer(b"".join(asked), np.uint8), np.cumsum([0, *map(len, asked)]))
    for k, text in enumerate(asked):
        low = bytes(c + 32 if 65 <= c <= 90 else c for c in text)
        grams = [low[i : i + langid.N] for i in range(len(low) - langid.N + 1)]
        shares = []
        for i in range(len(model.langs)):
            count = 0
            for g in grams:
                h = langid.grams(np.frombuffer(g, np.uint8), np.array([0, len(g)]))[0]
                count += bool(len(h)) and all(int(model.planes[0][int(langid._slots(h, j)[0])]) >> i & 1 for j in range(langid.HASHES))
            rate = model.false_rate[i]
            shares.append(max(count - len(grams) * rate, 0) / (1 - rate) + 0.5 * model.prior[i])
        assert best[k] == int(np.argmax(shares)) and abs(score[k] - max(shares) / sum(shares)) < 1e-9
    assert [model.langs[b] for b in best[[0, 1, 5, 6]]] == ["en", "de", "es", "en"]


def test_toxicity_learns_from_all_labelled_rows(spark, monkeypatch):
    """A word of 25 toxic documents out of 2,500, those a sample by the hash of the id takes last, gets its weight; pieces flag the same texts as the whole."""
    base = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"), F.xxhash64("id").alias("h")).toPandas()
    late = set(base[base.toxic == 1].sort_values("h").doc_id.tail(25))
    texts = [(i, ("Brgl." if i in late else "Nitwit.") if y else f"Nice day {i}.", y) for i, y in zip(base.doc_id.tolist(), base.toxic.tolist())]
    texts = [(i, f"{t} Then number{i} came along, place{i} was quiet, time{i} went by." + " Ok." * (i % 83), y) for i, t, y in texts]
    docs = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    asked = spark.createDataFrame([(1, "A brgl."), (2, "A nitwit."), (3, "A nice day."), (4, None)], "doc_id long, text string")
    flags = []
    for piece in (toxicity.PIECE, 60):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        model = toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), F.lit(True))
        flags.append({x.doc_id: x.score >= 0.5 for x in toxicity.score(asked, model).collect()})
    assert flags == [{1: True, 2: True, 3: False, 4: False}] * 2


def test_near_copies_teach_once(spark):
    rows = [(1, 0, "one two three four five six seven eight nine ten"), (2, 0, "one two three four five six seven eight nine ten eleven"), (3, 1, "other words are in this one here"), (4, 0, ""), (5, 0, "")]
    assert [r.doc_id for r in toxicity._copies(spark.createDataFrame(rows, "doc_id long, toxic int, text string")).collect()] == [2]
