import unicodedata

import pytest

from wordloom.llm.lookalike import LookAlikes, UnionFind, count_forms, disguised_values, fit_lookalikes, plain_form, skeletons

DE = "".join(sorted("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZäöüÄÖÜß"))
KV = "".join(sorted("абвгдежзиклмнопрстухцчшыэюяіӧАБВГДЕЖЗИКЛМНОПРСТУХЦЧШЫЭЮЯІӦ"))
NUK = "".join(sorted("hklmnpqstwyƛaiuəHKLMNPQSTWYAIUƏ̱̣̄̓x"))


def test_union_find_is_transitive():
    u = UnionFind()
    for a, b in (("a", "b"), ("c", "d"), ("b", "c"), ("x", "y")):
        u.union(a, b)
    assert sorted(u.classes()) == [["a", "b", "c", "d"], ["x", "y"]]


@pytest.mark.parametrize("c, form", [("ｋ", "k"), ("​", ""), ("͏", ""), ("\xa0", " "), ("‑", "-"), ("ﬁ", "fi"), ("ⅿ", "m"), ("²", None), ("½", None), ("™", None), ("a", None), ("-", None)])
def test_plain_forms(c, form):
    assert plain_form(c) == form


@pytest.fixture(scope="module")
def model(spark):
    rows = [("grüße ｇｒｅｈ", "de", DE), ("ｋｍ", "de", DE), ("grе͏is ⅿɑul", "de", DE), ("об​ӧд оo ï", "kv", KV), ("Δ-x β-y", "de", DE), ("ǝ", "nuk", NUK), ("ＮＯｐｑ\xa0 ‑ԁһѕ", "de", DE), (None, "de", DE), ("x", None, None)]
    df = spark.createDataFrame(rows, "text string, locale string, alphabet string")
    return fit_lookalikes(df, df.where("alphabet is not null"))


@pytest.mark.parametrize(
    "locale, text, normal",
    [("de", "ｋｍ", "km"), ("de", unicodedata.normalize("NFD", "grüße"), "grüße"), ("de", "gr​üße", "grüße"), ("de", "ok ", "ok "), ("de", "hаus", "haus"), ("de", "a‑b", "a-b"), ("de", "ⅿɑuer", "mauer"), ("kv", "oбӧд", "обӧд"), ("kv", "обöд", "обӧд"), ("kv", "GIF-обӧд", "GIF-обӧд"), ("nuk", "ǝx̣", "əx̣"), ("de", "haus", "haus"), ("de", "№ haus", "№ haus")],
)
def test_normal_forms(model, locale, text, normal):
    assert model.normal_form(text, locale) == normal


@pytest.mark.parametrize("text", ["", "👩‍🔧", "½", "™", "Ærvik", "нет", "​", "Δ", "日本"])
def test_imitates_nothing(model, text):
    assert model.normal_form(text, "de") is None or text == "нет"
    assert model.normal_form(text, "unknown locale") is None


def test_idempotent(model):
    for text in ("ｇｒüßｅ​ ｈаus", "ä​ö"):
        once = model.normal_form(text, "de")
        assert model.normal_form(once, "de") == once


def test_long(model):
    assert model.normal_form("ｇｒüßｅ " * 50_000, "de") == "grüße " * 50_000


def test_counts(spark):
    df = spark.createDataFrame([("aä", "de"), ("aä", "de"), (None, "de"), ("a", None), ("", "fr"), ("🚀a", "fr"), ("e\u0301x\u0323\u0301", "nuk"), ("e\u0301", "nuk"), ("\u0301e", "nuk")], "text string, locale string")
    got = {(r[0], r[1]): r[2] for r in count_forms(df).collect()}
    assert got == {("de", "a"): 2, ("de", "ä"): 2, ("fr", "🚀"): 1, ("fr", "a"): 1, ("nuk", "e"): 3, ("nuk", "x"): 1, ("nuk", "\u0301"): 4, ("nuk", "\u0323"): 1, ("nuk", "e\u0301"): 2, ("nuk", "x\u0323\u0301"): 1}
    assert count_forms(df.limit(0)).count() == 0


def test_frames(spark, model):
    rows = [(1, "ｋｍ", "de", DE, "z"), (1, "ｋｍ", "de", DE, "z"), (2, "km", "de", DE, "z"), (3, None, "de", DE, "z"), (4, "", "de", DE, "z"), (5, "ｋｍ", None, None, None), (6, "grÃ\xadn", "de", DE + "Ã", "z")]
    df = spark.createDataFrame(rows, "id bigint, text string, locale string, alphabet string, normal string")
    got = disguised_values(df, model)
    assert got.columns == ["id", "text", "locale", "normal"]
    assert sorted((r["id"], r["normal"]) for r in got.collect()) == [(1, "km"), (1, "km")]
    assert disguised_values(df.limit(0), model).count() == 0


def test_skeletons_out_of_reach_are_an_error():
    class NoSession:
        @property
        def _jvm(self):
            raise AttributeError("no JVM")

    with pytest.raises(RuntimeError):
        skeletons(NoSession(), ["a"])


def test_frequent_strings_represent():
    """Of several strings of marks that look alike the more frequent one stands for all."""
    nuk = {"nuk": "ax\u0323\u0331"}
    for seen, want in (({"x\u0323": 9, "x\u0331": 2}, "x\u0323"), ({"x\u0323": 2, "x\u0331": 9}, "x\u0331")):
        m = LookAlikes({"nuk": {"x": 11, "a": 1, "ẋ": 1, **seen}}, nuk, lambda chars: {})
        m.classes = [["x\u0323", "x\u0331", "ẋ"]]
        assert m._choose(frozenset(nuk["nuk"]), {"x": 11, **seen})["ẋ"] == want


def test_many_rewritings_reach_a_fixed_point(model):
    text = "a" + "\u200b\u0308" * 9 + "ｇ"
    once = model.normal_form(text, "de")
    assert once is None or model.normal_form(once, "de") == once


def test_without_skeletons():
    m = LookAlikes({"de": {"a": 5}}, {"de": DE}, lambda chars: {})
    assert m.normal_form("ａ", "de") is None  # not in the counted text: no class
    m = LookAlikes({"de": {"a": 5, "ａ": 1}}, {"de": DE}, lambda chars: {})
    assert m.normal_form("ａ", "de") == "a"
