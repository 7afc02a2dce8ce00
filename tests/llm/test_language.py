import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.llm import language
from wordloom.llm.ppm import PPM, fold

SAMPLES = {
    "en": ["The cat sits on the mat and looks at the bird.", "A dog is running through the garden of the house.", "When the sun is shining, the children are playing outside."],
    "de": ["Die Katze sitzt auf der Matte und schaut den Vogel an.", "Ein Hund läuft durch den Garten des Hauses.", "Wenn die Sonne scheint, spielen die Kinder draußen."],
    "ru": ["Кошка сидит на коврике и смотрит на птицу.", "Собака бежит через сад этого дома."],
    "zh": ["猫坐在垫子上看着鸟儿飞走了。", "一只狗正在穿过房子的花园。"],
}


@pytest.fixture(scope="module")
def model():
    return PPM(SAMPLES)


def brute_bits(samples, order, context, byte):
    """Code length of one byte after a context, straight from the definition."""
    for k in range(order, -1, -1):
        c = context[len(context) - k :]
        after = {}
        for s in samples:
            data = b"\n" * (order + 1) + fold(s.encode()) + b"\n"
            for i in range(order + 1, len(data)):
                if data[i - k : i] == c:
                    after[data[i]] = after.get(data[i], 0) + 1
        total, kinds = sum(after.values()), len(after)
        if byte in after:
            return brute_bits.escaped - np.log2(after[byte] / (total + kinds))
        if total:
            brute_bits.escaped -= np.log2(kinds / (total + kinds))
    return brute_bits.escaped + 8


def test_code_lengths_against_definition(model):
    text = fold("The bird läuft 42 км 花园, xq!".encode())
    data = np.frombuffer(b"\n" * 8 + text, np.uint8)
    got = model.code_lengths(data, np.array([8]))[0]
    padded = b"\n" * 8 + text
    for l, lang in enumerate(model.langs):
        want = 0.0
        for i in range(8, len(padded)):
            brute_bits.escaped = 0.0
            want += brute_bits(SAMPLES[lang], model.order, padded[i - model.order : i], padded[i])
        assert got[l] == pytest.approx(want, rel=1e-9)


def test_memo_changes_nothing():
    small, large = PPM(SAMPLES, memo=10), PPM(SAMPLES)
    data = np.frombuffer(fold(b"\n" * 8 + ("The garden of the house. " * 200 + "Der Garten.").encode()), np.uint8)
    starts = np.array([8, 100, 4000])
    for m in (small, large):
        first, again = m.code_lengths(data, starts), m.code_lengths(data, starts)
        assert np.array_equal(first, again)
    assert np.allclose(small.code_lengths(data, starts), large.code_lengths(data, starts))


def test_spans(model):
    text = "Heading\nThe dog is sitting in the garden of the house. The children are looking at the bird.\nDer Hund sitzt in dem Garten und schaut die Katze an.\nC50H49O22\n猫坐在花园里看着一只狗。"
    (spans,) = list(language.score_texts(model, [text]))
    assert [(s["lang"], s["sentences"]) for s in spans] == [("en", 2), ("de", 1), ("zh", 1)]
    assert text[spans[1]["start"] : spans[1]["end"]].startswith("Der Hund") and text[spans[2]["start"] :].startswith("猫")
    assert all(0 < s["confidence"] <= 1 for s in spans)


def test_sentences_without_a_blank_between(model):
    text = "The dog is running through the garden.猫坐在花园里看着一只狗。The cat sits on the mat and looks at the bird."
    (spans,) = list(language.score_texts(model, [text]))
    assert [s["lang"] for s in spans] == ["en", "zh", "en"]


def test_edges(model):
    long = "The children are playing outside in the garden. " * 20_000
    got = list(language.score_texts(model, [None, "", "x", "\n\n", "x = (18 + y) / 29", "a" * 500_000, long, "İİİ The dog is running through the garden."]))
    assert [len(g) for g in got] == [0, 0, 0, 0, 0, 0, 1, 1]
    assert got[6][0]["sentences"] == 20_000
    assert list(language.score_texts(PPM({}), ["The dog is running through the garden."])) == [[]]


def test_frames(spark, model):
    rows = [(1, None, "The dog is running through the garden of the house.", 0), (2, "EN", "The cat sits on the mat and looks.", 0), (3, "de-AT", "The cat sits on the mat and looks at it.", 0), (4, "xx", None, 0), (4, "xx", None, 0), (None, "", "Die Katze sitzt auf der Matte und schaut.", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, text string, spans int")
    labelled = language.label_spans(df, model)
    assert labelled.columns == ["doc_id", "lang", "spans"] and labelled.count() == 6
    found = {tuple(r) for r in language.missing_languages(labelled).collect()}
    assert found == {(1, "en"), (3, "en"), (None, "de")}
    main = {r["doc_id"]: r["main_lang"] for r in language.document_language(labelled).collect()}
    assert main[1] == "en" and main[4] is None
    assert language.label_spans(df.limit(0), model).count() == 0
    codes = spark.createDataFrame([(x,) for x in ("EN", "en_US", "eng", " English ", "dut", "zh-Hans", "und", "", None, "Français", "it_IT", "x")], "l string")
    assert [r[0] for r in codes.select(language.language_code(F.col("l"))).collect()] == ["en", "en", "en", "en", "nl", "zh", None, None, None, "fr", "it", None]


def test_fitting(spark):
    samples = spark.createDataFrame([(k, s) for k, v in SAMPLES.items() for s in v] + [(None, "x"), ("en", None), ("en", "")], "lang string, sentence string")
    docs = spark.createDataFrame([(i, "en" if i % 5 else "de", "The children are playing in the garden. Tomorrow is another day for the dog and the bird. The sun is shining.") for i in range(20)] + [(99, "en", None)], "doc_id bigint, lang string, text string")
    m = language.fit_languages(samples)
    assert m.langs == ["de", "en", "ru", "zh"]
    more = language.refit_with_documents(m, samples, docs, per_language=5)
    probe = np.frombuffer(fold(b"\n" * 8 + b"Tomorrow is another day."), np.uint8)
    a, b = (x.code_lengths(probe, np.array([8]))[0] for x in (m, more))
    assert b[1] < a[1] and b[0] == pytest.approx(a[0])
    assert language.refit_with_documents(m, samples, docs.limit(0)).langs == m.langs


def test_quoted_short_and_bracketed_sentences(model):
    def langs(text):
        return [(s["lang"], s["sentences"]) for s in list(language.score_texts(model, [text]))[0]]

    assert langs("“The dog is sitting in the garden of the house.”") == [("en", 1)]
    assert langs("The dog is in the garden of the house. «Die Katze sitzt auf der Matte und schaut.» The cat looks at the bird.") == [("en", 1), ("de", 1), ("en", 1)]
    assert langs("Die Katze sitzt auf der Matte. The dog is running. Der Hund läuft durch den Garten.") == [("de", 1), ("en", 1), ("de", 1)]
    assert langs("The children (see Fig. 3) are playing in the garden.") == [("en", 1)]
    assert langs("(Die Katze sitzt auf der Matte und schaut.) The dog is running through the garden.") == [("de", 1), ("en", 1)]
    # what breaks off in a bracket, and headings, are no sentences
    assert langs("The dog of the house (Math.\nGarden of the house\n") == []


def test_texts_without_a_sentence_have_a_language(spark, model):
    rows = [(1, "The children are playing in the garden of the house with the dog and the bird"), (2, ""), (3, None), (4, "C50H49O22"), (5, "Die Katze sitzt auf der Matte. The")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in language.document_language(language.label_spans(df, model, overall=True)).collect()}
    assert got[1]["spans"] == [] and got[1]["main_lang"] == "en" and 0.5 < got[1]["main_confidence"] <= 1
    assert [got[i]["main_lang"] for i in (2, 3, 4, 5)] == [None, None, None, "de"]


def test_shipped_models_keep_their_memo(model):
    import pickle

    list(language.score_texts(model, ["The dog is running through the garden."]))
    a, b = pickle.loads(pickle.dumps(model)), pickle.loads(pickle.dumps(model))
    assert a is b and a is not model
