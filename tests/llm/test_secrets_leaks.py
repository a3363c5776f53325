import hashlib
import random
import re

import numpy as np
import pytest

from veilspan.llm import decontam, secrets


def brute(text):
    out = []
    for k, (name, p, ok) in enumerate(
        (
            ("assign", r"""(?:[pP][aA][sS][sS][wW](?:[oO][rR])?[dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 6),
            ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
            ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24),
        )
    ):
        out += [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for m in re.finditer(p, text or "") if ok(m)]
    return ",".join(x[2] for x in sorted(out))


def test_base_findings(spark):
    texts = ["password=abcdef", "PassWd : 'x1-2_3.z' secret:tok en", "é token: token:abcdefg", "apikey=short api_KEY=longer1", "ſecret=abcdefg", "AKIA" + "A" * 16 + " AKIA" + "B" * 15, "0" * 24 + "g" + "f" * 23, "", None, "a" * 100000 + " secret=aaaaaa", "tail password=", "=abcdefgh"]
    rows = [(i, t, "c") for i, t in enumerate(texts)] + [(0, texts[0], "c"), (None, texts[0], "c")]
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute(texts[r.doc_id or 0])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        own = [x for x in r.spans.split(",") if not x.startswith("model:")]  # what the network adds never takes a base span away
        assert ",".join(x for x in own if x) == want
        assert [r.n_assign, r.n_access, r.n_hex] == [want.count(k) for k in ("assign:", "access:", "hex:")]
    assert secrets.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_network_finds_what_the_patterns_miss(spark):
    r = random.Random(0)
    secret = lambda: "".join(r.choice("0123456789abcdef") for _ in range(18))
    number = lambda: "".join(r.choice("0123456789") for _ in range(16))
    words = ["some", "words", "here", "and", "there"]
    rows = []
    for i in range(400):
        value = [f"password={secret()}", number(), f"call {number()} now"][i % 3]
        rows.append((i, " ".join(r.choices(words, k=10)) + " " + value + " " + " ".join(r.choices(words, k=5))))
    rows += [(1000 + i, f"note {secret()} end") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x for x in secrets.scan(df).collect()}
    assert sum(got[1000 + i].n_model for i in range(20)) >= 15
    assert sum(got[i].n_model for i in range(400)) <= 4
    clean = {x.doc_id: x.text for x in secrets.redact(df).collect()}
    assert all("password=" not in clean[i] and "[SECRET]" in clean[i] for i in range(0, 400, 3))
    assert clean[1] == rows[1][1]


def test_formats_that_no_pattern_knows(spark):
    """A network trained without a format finds it all the same; ordinary tokens of other shapes stay."""
    words = "some words here and there about nothing in particular".split()
    r = random.Random(7)
    fill = lambda n: " ".join(r.choices(words, k=n))
    rows = [(i, f"{fill(10)} password={secrets._some(r, '0123456789abcdef', 20)} {fill(6)}") for i in range(60)]
    found = secrets.written(secrets._scan(spark.createDataFrame(rows, "doc_id long, text string"), "text", "doc_id"))
    recall = {}
    for name in ("prefixed", "web token", "chat token", "cloud key"):
        model = secrets.train(found, {k: f for k, f in secrets.FORMATS.items() if k != name})
        texts = [f"{fill(8)} {v} {fill(5)}" for v in secrets.made_up({name: secrets.FORMATS[name]}, 99, 60)]
        recall[name] = sum("[SECRET]" in t for t in secrets.clean(texts, model, "[SECRET]")) / 60

    assert min(recall.values()) >= 0.9
    model = secrets.train(found)
    texts = [f"{fill(8)} {v} {fill(5)}" for v in secrets.made_up(secrets.ORDINARY, 98, 30)]
    texts += ["see docs/reference/chapter12/section-4.html", "authentication responsibilities Donaudampfschifffahrt internationalization", "call +49-170-1234-5678 at 10.20.30", "Fig.12-Table.13-Appendix.A"]
    assert sum("[SECRET]" in t for t in secrets.clean(texts, model, "[SECRET]")) / len(texts) <= 0.05


def plain_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1))
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max() / (2 * len(a))


def test_alignment_like_the_table():
    r = np.random.default_rng(1)
    for _ in range(60):
        a, b = (r.integers(0, 4, r.integers(1, 15)).astype(np.uint64) for _ in range(2))
        assert abs(decontam.align(a, b) - plain_align(a, b)) < 1e-12


def test_contamination(spark):
    r = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    prose = lambda n: " ".join(r.choices(vocabulary, k=n))
    items = [(i, prose(r.randint(14, 50))) for i in range(30)]

    def edited(t):
        w = t.split()
        for k in range(4, len(w), 6):
            w[k] = "changed"
        del w[len(w) // 2]
        return " ".join(w)

    docs = [(i, prose(300), "x") for i in range(40)]
    docs += [(100 + i, prose(50) + " " + t + ". " + prose(50), "x") for i, t in items]
    docs += [(200 + i, prose(80) + " " + edited(t).upper() + " " + prose(20), "x") for i, t in items]
    docs += [(300, None, "x"), (301, "", "x"), (None, items[0][1], "x"), (100, docs[40][1], "x"), (302, " ".join(items[3][1].split()[:4]), "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, score string")
    bench = spark.createDataFrame(items + [(50, None), (51, ""), (52, "two words"), (None, "no id but eight words in this item")], "item_id long, text string")
    got = decontam.contamination(df, bench).collect()
    assert len(got) == len(docs)
    flagged = {x.doc_id for x in got if x.contaminated}
    assert flagged == {100 + i for i in range(30)} | {200 + i for i in range(30)} | {None}
    assert all(x.item_id == x.doc_id % 100 for x in got if x.contaminated and x.doc_id)
    kept = decontam.drop_contaminated(df, bench)
    assert kept.columns == df.columns and kept.count() == 43
    assert decontam.contamination(df, bench.limit(0)).where("contaminated = 1").count() == 0
    assert decontam.contamination(df.limit(0), bench).count() == 0


def test_joined_benchmark_is_the_same(spark, monkeypatch):
    r = random.Random(3)
    items = [(i, " ".join(f"t{r.randint(0, 300)}" for _ in range(r.choice([3, 6, 12, 20, 40])))) for i in range(40)] + [(None, "an item without id that is long enough"), (7, "a b c d"), (8, "two words")]
    docs = [(i, f"before {t} after" if i % 2 else f"{t[: len(t) // 2]} cut and then nothing", "x") for i, t in items if i is not None]
    docs += [(50, items[3][1] + " and " + items[4][1], "y"), (None, items[5][1], "n"), (None, items[-3][1], "n"), (60, None, "n"), (61, "", "n"), (62, "far " * 500 + items[6][1] + " far" * 500 + " " + items[6][1], "n")]
    docs += docs[:3]
    df = spark.createDataFrame(docs, "doc_id long, text string, item string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted((tuple(x) for x in decontam.contamination(df, bench).collect()), key=repr)
    assert sum(x[1] for x in whole) > 40
    kept = sorted((tuple(x) for x in decontam.drop_contaminated(df, bench).collect()), key=repr)
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 0)
    assert sorted((tuple(x) for x in decontam.contamination(df, bench).collect()), key=repr) == whole
    out = decontam.drop_contaminated(df, bench)
    assert out.columns == df.columns and sorted((tuple(x) for x in out.collect()), key=repr) == kept
    assert decontam.contamination(df.limit(0), bench).count() == 0


def split(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())


@pytest.mark.parametrize("size, changed", [(8, 0.15), (8, 0.25), (12, 0.25), (20, 0.25), (40, 0.15)])
def test_recall_against_full_alignment_of_all_pairs(spark, size, changed):
    """Every pair of a document and an item is aligned in full, word by word; nine in ten of those over the threshold are found, with that score."""
    r = random.Random(size * 100 + int(changed * 100))
    word = lambda: f"w{int(r.paretovariate(0.7)) % 3000}"
    items = [(i, " ".join(word() for _ in range(size))) for i in range(60)]
    docs = []
    for i, t in items:
        copy = [f"c{r.randint(0, 99999)}" if r.random() < changed else w for w in t.split()]
        docs.append((i, " ".join([word() for _ in range(25)] + copy + [word() for _ in range(25)])))
    docs += [(100 + i, " ".join(word() for _ in range(60))) for i in range(20)]
    got = {x.doc_id: x for x in decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    number = {}
    code = lambda t: np.array([number.setdefault(w, len(number)) for w in split(t)], np.uint64)
    coded = [code(t) for _, t in items]
    hit = total = 0
    for i, t in docs:
        best = max(decontam.align(w, code(t)) for w in coded)
        assert got[i].score in (0.0, best) or got[i].score < best
        total += best >= 0.5
        hit += best >= 0.5 and got[i].score == best
        assert bool(got[i].contaminated) <= (best >= 0.5)
    assert total >= 50 and hit / total >= 0.95


def test_copies_that_leaked_into_many_documents(spark, monkeypatch):
    """Edited, half and whole copies are found however many documents hold them, and beside rarer ones of the same item."""
    r = random.Random(4)
    prose = lambda n: " ".join(f"p{r.randint(0, 5000)}" for _ in range(n))
    items = [(i, " ".join(f"i{i}w{k}" for k in range(20))) for i in range(4)]

    def edited(t, places):
        return " ".join("changed" if k in places else w for k, w in enumerate(t.split()))

    copies = [edited(items[0][1], range(3, 20, 5)), " ".join(items[1][1].split()[:11]), edited(items[2][1], (3, 9, 15)), edited(items[3][1], range(10))]
    docs = [(300 * k + i, prose(30) + " " + c + " " + prose(30)) for k, c in enumerate(copies) for i in range(300)]
    docs += [(5000 + i, prose(10) + " " + " ".join(items[3][1].split()[:12])) for i in range(5)]
    docs += [(6000 + i, prose(60)) for i in range(200)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    got = {x.doc_id: x for x in decontam.contamination(df, bench).collect()}
    assert {i for i, x in got.items() if x.contaminated} == {i for i, _ in docs if i < 6000}
    assert all(got[i].item_id == i // 300 for i in range(1200))
    assert abs(got[0].score - 0.7) < 1e-9 and abs(got[300].score - 0.55) < 1e-9
    monkeypatch.setattr(decontam, "PAIRS", 5)
    assert {x.doc_id: x for x in decontam.contamination(df, bench).collect()} == got


def test_whole_candidates_are_judged(spark):
    r = random.Random(5)
    secret = lambda: "".join(r.choice("0123456789abcdef") for _ in range(22))
    words = ["some", "words", "here", "and", "there"]
    path = lambda n: "/".join(r.choice(["files", "archive", "images", "2019", "page12", "list"]) for _ in range(n))
    fill = lambda n: " ".join(r.choices(words, k=n))
    rows = [(i, f"{fill(10)} {[f'password={secret()}', f'www.example.com/{path(8)}/index.html'][i % 2]} {fill(5)}") for i in range(600)]
    inside = [f"www.example.com/{path(5)}/{secret()}/{path(5)}/index.html" for _ in range(30)]
    # beside a base finding in the same run
    beside = ["0123456789abcdef" * 2 + f"/{secret()}" for _ in range(30)]
    rows += [(1000 + i, f"{fill(10)} {t} {fill(5)}") for i, t in enumerate(inside + beside)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x for x in secrets.scan(df).collect()}
    assert sum(got[i].n_model for i in range(600)) <= 6
    assert sum(got[1000 + i].n_model for i in range(30)) >= 15
    assert sum(got[1030 + i].n_model for i in range(30)) >= 15 and all(got[1030 + i].n_hex == 1 for i in range(30))
    clean = {x.doc_id: x.text for x in secrets.redact(df).collect()}
    for i in range(1000, 1060):
        assert clean[i].count("[SECRET]") == len(got[i].spans.split(",")) * (got[i].spans != "")


def test_long_candidates_like_all_their_windows():
    r = np.random.default_rng(6)
    p = [r.normal(size=n) for n in ((secrets._SPAN, secrets._SYMBOLS, secrets._FILTERS), secrets._FILTERS, (3 * secrets._FILTERS, secrets._HIDDEN), secrets._HIDDEN, secrets._HIDDEN, 1)]
    model = secrets.Model(p)
    for n in (41, 67, 500):
        x = np.frombuffer(secrets.window("é" * 30 + "a0Zf" * 200, 30, 30 + n), np.uint8)
        assert len(x) == n + secrets.BEFORE + secrets.AFTER
        each = np.lib.stride_tricks.sliding_window_view(x, secrets.WIDTH)
        assert abs(model.highest(x) - model.logits(each).max()) < 1e-6
    text = "see www.example.com/files/a1b2c3d4e5f6a7b8/index.html now"
    a, b = text.index("www"), text.index(" now")
    part = text.index("a1b2")
    assert secrets._parts(np.frombuffer(secrets.window(text, a, b), np.uint8)).tobytes() == secrets.window(text[part : part + 16], 0, 16)
    known = text.index("/files")
    pieces = secrets.candidates(text, [{"start": a, "end": known, "kind": "hex"}])
    assert [(c["start"], c["end"], c["label"]) for c in pieces] == [(a, known, 1), (known + 1, b, 2)]


def stems(n):
    """Items that share the stem of a question."""
    return [(i, f"what is the w{i} of the q{i}") for i in range(n)]


def test_items_that_share_a_stem_cost_no_more(monkeypatch):
    """Of many items with a stem in common only those are aligned whose own words are there; the time stays flat."""
    import time

    import pyarrow as pa

    r = random.Random(11)
    texts = [" ".join(r.choice(["what is the", "of the", "w17", "blue", f"x{r.randint(0, 999)}", "q5"]) for _ in range(250)) for _ in range(20)]
    texts[3] += " so what is the w1234 of the q1234 then"
    column = pa.array(texts, pa.large_string())
    took = []
    for n in (2000, 20000):
        find = decontam.Finder(decontam.items_of(stems(n)))
        decontam._score(find, *decontam.string_bytes(column))
        best = []
        for _ in range(3):
            begun = time.perf_counter()
            score, item = decontam._score(find, *decontam.string_bytes(column))
            best.append(time.perf_counter() - begun)
        took.append(min(best))
        assert score[3] == 1.0 and find.items.ids[item[3]] == 1234
    assert took[1] < 1.5 * took[0] + 0.05, took


@pytest.mark.parametrize("joined", [False, True])
def test_shared_stems_and_copies_of_items(spark, monkeypatch, joined):
    """Both ways find the item that is there, the smaller id of equal items, and items that have common words only."""
    if joined:
        monkeypatch.setattr(decontam, "BLOCK_ITEMS", 0)
    monkeypatch.setattr(decontam, "COMMON", 4)
    items = stems(60) + [(1000 + i, "the very same words for many of the items here") for i in range(30)] + [(None, "the very same words for many of the items here")]
    # all n-grams of these are common: they are made of each other's
    items += [(2000 + i, " ".join(["alpha beta gamma"] * 3 + ["delta epsilon"] * (1 + i))) for i in range(12)]
    docs = [(1, "I ask what is the w17 of the q17 now"), (2, "what is the question of the day"), (3, "x the very same words for many of the items here y"), (4, " ".join(["alpha beta gamma"] * 3 + ["delta epsilon"] * 12)), (5, None), (6, "what is the w3 of those")]
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    got = {x.doc_id: (x.item_id, x.score) for x in decontam.contamination(d, b).collect()}
    assert got[1] == (17, 1.0) and got[3] == (1000, 1.0) and got[4] == (2000, 1.0) and got[5] == (None, 0.0)
    assert got[6][0] == 3 and got[6][1] >= 0.5
    assert got[2] == (None, 0.0)  # the stem alone tells no item


def test_rare_seeds_leave_no_room_for_an_alignment():
    r = random.Random(12)
    import numpy as np

    for _ in range(200):
        n = r.randint(3, 40)
        words = np.array([r.randint(1, 6) for _ in range(n)], np.uint64)
        size = decontam.SHORT_N if n <= decontam.SHORT else decontam.N
        grams = decontam.window_hash(words, size)
        common = {g: r.randint(40, 90) for g in grams.tolist() if r.random() < 0.8}
        seeds = set(decontam.rare_seeds(words, common, 0.5).tolist())
        assert {g for g in grams.tolist() if g not in common} <= seeds
        covered = np.zeros(n, bool)
        for k, g in enumerate(grams.tolist()):
            if g in seeds:
                covered[k : k + size] = True
        assert (~covered).sum() < 0.5 * n


def test_network_learns_from_all_candidates(spark, monkeypatch):
    """Every distinct window reaches a piece once, and every kept one the calibration, however few rows a class weighs or a piece has."""
    r = random.Random(3)
    texts = [f"see {secrets._name(r, 13, 16)} and {secrets._some(r, '-_', 70)} password={secrets._some(r, secrets._ALNUM, 14)}" for _ in range(60)]
    found = secrets.written(secrets._scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "text", "doc_id"))
    want = set()
    for row in found.collect():
        for c in row.cands:
            if c["label"] < 2:
                want |= {(c["label"], bytes(c["window"][k : k + secrets.WIDTH])) for k in range(len(c["window"]) - secrets.WIDTH + 1)}
    monkeypatch.setattr(secrets, "WEIGH", 10)
    monkeypatch.setattr(secrets, "PIECE", 500)
    monkeypatch.setattr(secrets, "MADE_UP", 5)
    assert sorted((x.label, bytes(x.window)) for x in secrets._rows(found).collect()) == sorted(want)
    seen = []
    calibrated = secrets._calibrated
    monkeypatch.setattr(secrets, "_calibrated", lambda net, corpus, own: (seen.append(corpus), calibrated(net, corpus, own))[1])
    model = secrets.train(found)
    kept = np.array([(y, *secrets._kept(np.frombuffer(w, np.uint8)[None], np.array([y]))[1].shape) for y, w in want])
    assert sum(n for k, n in seen[-1].items() if k[0] == 1) == kept[kept[:, 0] == 1, 1].sum() > 2 * 10 // 4
    assert sum(n for c in seen[:2] for k, n in c.items() if k[0] == 0) == kept[kept[:, 0] == 0, 1].sum()  # each half's judge sees its own
    again = secrets.train(found.repartition(7))
    assert all((a == b).all() for a, b in zip(model.params, again.params)) and (model.thresholds == again.thresholds).all()
