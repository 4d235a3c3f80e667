import math
import random
import unicodedata

from vectorloom.llm import language_id as L

WORDS = {"xx": "alo bero cando dulo eran fono gira".split(), "yy": "thrick stend wump kerth glish sprock".split(), "zz": "žeši čaňo řeky šály ďuby".split()}


def texts(n, seed=4):
    random.seed(seed)
    out = []
    for i in range(n):
        lang = random.choice(list(WORDS))
        out.append((i, " ".join(random.choices(WORDS[lang], k=random.randint(3, 60))), lang))
    return out


def test_accuracy_and_contract(spark):
    rows = texts(400)
    odd = [(1000, None, "xx"), (1001, "", "yy"), (1002, "123 !!", "zz"), (1003, "ž", "zz"), (None, "alo bero", "xx"), (1004, "alo " * 50_000, "xx"), (1005, "alo", None)]
    df = spark.createDataFrame([(i, t, g, "q") for i, t, g in rows + odd], "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in L.language_id(df).collect()}
    held = [(i, g) for i, _, g in rows if got[i].held_out]
    assert held and sum(got[i].lang_pred == g for i, g in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    for i in (1000, 1001, 1002):
        assert got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected
    assert got[1004].lang_pred == "xx" and got[None].held_out is None
    assert L.keep_identified(df).columns == df.columns
    import zlib

    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items() if i is not None)


def test_labels_of_held_out_rows_are_not_read(spark):
    rows = texts(200)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    import zlib

    used = [tuple(r) for r in L.training_sample(df).collect()]
    assert sorted(used) == sorted((t, g) for i, t, g in rows if zlib.crc32(str(i).encode()) % 4 != 2)
    assert L.training_sample(df, per_lang=10).count() == 30


def test_sample_is_bounded_whatever_the_number_of_languages(spark, monkeypatch):
    monkeypatch.setattr(L, "MOST_ROWS", 60)
    monkeypatch.setattr(L, "MOST_LANGS", 20)
    df = spark.createDataFrame([(i, f"text number {i}", f"g{i % 50}" if i % 3 else "main") for i in range(900)], "doc_id long, text string, lang string")
    used = [tuple(r) for r in L.training_sample(df).collect()]
    assert len({g for _, g in used}) == 20 and "main" in {g for _, g in used} and len(used) <= 60
    assert L.training_sample(df.limit(0)).count() == 0


def test_letters_are_unicode_letters(spark):
    """Numerals, superscripts, fractions and marks are no letters; modifier and other letters are."""
    odd = ["²", "½ ³", "①②", "Ⅷ", "٣", "\u0301", "_", "€5", "ª", "ʰ", "中", "a1"]
    for text in odd:
        assert L.has_letter(text) == any(unicodedata.category(c).startswith("L") for c in text)
    model = L.fit([(t, g) for _, t, g in texts(60)])
    assert [g == "und" for g, _ in model.predict(odd)] == [True] * 8 + [False] * 4


def test_prediction_against_brute_force():
    """The score of a text is the softmax of the mean of its subwords' rows, taken one at a time."""
    model = L.fit([(t, g) for _, t, g in texts(120)])
    sample = [t for _, t, _ in texts(40, seed=9)] + ["Alo, BERO!", "žeši", "x"]
    got = model.predict(sample)

    def bucket(piece, factor):
        value = 0
        for byte in piece:
            value = (value << 8 | byte) & 0xFFFFFFFF
        return (value * factor & 0xFFFFFFFF) >> (32 - L.BUCKET_BITS)

    for text, (lang, score) in zip(sample, got, strict=True):
        folded = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in text.encode())
        rows = []
        for word in folded.split(b" "):
            if word:
                edged = b" " + word + b" "
                rows += [bucket(edged[k : k + 3], 2654435761) for k in range(len(edged) - 2)]
                rows += [bucket(edged[k : k + 4], 2246822519) for k in range(len(edged) - 3)]
        logits = [(sum(float(model.table[r][k]) for r in rows) / len(rows) + model.bias[k]) / model.temperature for k in range(len(model.langs))]
        p = [math.exp(x - max(logits)) for x in logits]
        best = p.index(max(p))
        assert lang == model.langs[best] and abs(score - p[best] / sum(p)) < 1e-5


def test_without_labels(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert L.language_id(df).first().lang_pred == "und"
    assert L.language_id(df.limit(0)).count() == 0
    one = spark.createDataFrame([(i, "some text here", "en") for i in range(20)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in L.language_id(one).collect()} == {"en"}


def test_subwords_do_not_cross_texts():
    a, sa = L.subwords([b"Hello, World", b"", b"abc"])
    b, _ = L.subwords([b"hello world"])
    assert (a[: sa[1]] == b).all() and sa[1] == sa[2] and sa[3] - sa[2] > 0
