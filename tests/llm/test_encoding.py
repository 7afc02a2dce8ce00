import pytest

from wordloom.llm.encoding import LOST, find_garbled, garbles

DE = "".join(sorted("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZäöüÄÖÜß"))
PL = "".join(sorted("abcdefghijklmnopqrstuwxyzABCDEFGHIJKLMNOPQRSTUWXYZąćęłńóśźżĄĆĘŁŃÓŚŹŻ"))
EL = "".join(sorted("αάβγδεέζηήθιίκλμνξοόπρστυύφχωώςΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΩ"))
RU = "".join(sorted("абвгдежзийклмнопрстуфхцчшщыьэюяАБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЫЭЮЯ"))


def wrong(text, right, read):
    return "".join(bytes([b]).decode(read, "ignore") or chr(b) for b in text.encode(right))


@pytest.mark.parametrize("read", ["cp1252", "latin-1", "cp1250", "cp1251", "cp1257", "cp437", "cp850", "mac_roman", "iso8859-15"])
@pytest.mark.parametrize("alphabet, word", [(DE, "schönes Übel"), (PL, "źródło łąki"), (EL, "ώρα μηδέν"), (RU, "чистый лёд".replace("ё", "е"))])
def test_utf8_round_trip(alphabet, word, read):
    restored, pairs, weak = garbles(alphabet).label(wrong(word, "utf-8", read))
    assert restored == word and not weak and pairs[0].startswith("utf-8 as")


@pytest.mark.parametrize("alphabet, word, page, read", [(DE, "schöne grüße", "cp1252", "mac_roman"), (DE, "schöne grüße", "cp1252", "cp850"), (PL, "źródło łąki", "cp1250", "cp1252"), (PL, "gęś łąki", "iso8859-2", "cp1252"), (EL, "καλημέρα", "cp1253", "cp1252"), (RU, "привет", "koi8-r", "cp1252"), (RU, "привет", "cp1251", "cp1252")])
def test_code_page_round_trip(alphabet, word, page, read):
    restored, _, weak = garbles(alphabet).label(wrong(word, page, read))
    assert restored == word and weak


def test_partial_twice_folded_and_wide():
    g = garbles(DE)
    assert g.label("schÃ¶nes Übel")[0] == "schönes Übel"
    assert g.label(wrong(wrong("grün", "utf-8", "cp1252"), "utf-8", "cp1252"))[0] == "grün"
    assert g.label(wrong("schön", "utf-8", "cp1252").lower())[0] == "schön"
    assert g.label("größer x".encode().decode("utf-16-le"))[0] == "größer x"
    restored, pairs, _ = g.label(f"gr{LOST}n")
    assert LOST in restored and pairs == ["lost"]
    assert g.label("½ ".encode().decode("cp1252") + "süß")[0] == "½ süß"


@pytest.mark.parametrize("text", ["", "schön", "SÃO", "Ærvik", "n°", "20 °F", "€ 40", "№ 5", "½ süß", "naïf", "ｋｍ", "a​b", "Δ-x", "👩‍🔧", "schoen", "µ"])
def test_no_cases(text):
    assert garbles(DE).label(text) is None


def test_long_values():
    word = wrong("schöne grüße ", "utf-8", "cp1252")
    text = ("guter text " * 100 + word) * 20
    restored, _, _ = garbles(DE).label(text)
    assert restored == ("guter text " * 100 + "schöne grüße ") * 20
    assert garbles(DE).label("x" * 1_000_000) is None
    assert garbles(DE).label("x" * 5000 + "Ã¶" + "y" * 5000)[0] == "x" * 5000 + "ö" + "y" * 5000


def test_frames(spark):
    rows = [(1, "grÃ¼n", "de", DE, "x"), (1, "grÃ¼n", "de", DE, "x"), (2, "grün", "de", DE, "x"), (3, None, "de", DE, "x"), (4, "", None, None, None), (5, "grÃ¼n", None, None, None)]
    # a name that locales show which no code page explains it in, and a letter lost to a code page
    rows += [(10 + i, "Ñuble", f"l{i}", PL if i % 2 else RU, "x") for i in range(6)] + [(20, "¿aba", "pl", PL, "x")]
    df = spark.createDataFrame(rows, "id bigint, text string, locale string, alphabet string, restored string")
    got = find_garbled(df)
    assert got.columns == ["id", "text", "locale", "restored", "pairs", "lost"]
    assert sorted((r["id"], r["restored"]) for r in got.collect()) == [(1, "grün"), (1, "grün"), (5, "grün"), (20, "żaba")]
    assert find_garbled(df.limit(0)).count() == 0


@pytest.mark.parametrize("before", [0, 1, 26, 27, 505, 509, 511, 100_000])
def test_damage_at_any_place(before):
    for read in ("cp1252", "cp437"):
        got = garbles(DE).label("a" * before + wrong("smörgüs", "utf-8", read) + "b" * before)
        assert got[0] == "a" * before + "smörgüs" + "b" * before
    words = "ab " * before
    assert garbles(DE).label(words + wrong("schöne grüße", "cp1252", "mac_roman") + " " + words)[0] == words + "schöne grüße " + words


def test_whole_text_garbled_and_long():
    text = "schön größer Übel " * 3000
    assert garbles(DE).label(wrong(text, "utf-8", "cp1252"))[0] == text
    assert garbles(RU).label(wrong("привет мир " * 300, "cp1251", "cp1252"))[0] == "привет мир " * 300


def test_a_code_page_in_part_of_the_words():
    assert garbles(PL).label("¿aba łąki")[0] == "żaba łąki"
    assert garbles(PL).label("łąki ¿aba")[0] == "łąki żaba"
    # within a word it changes every letter that it can change
    assert garbles(PL).label("¿abą") is None


def test_text_beside_the_damage_is_left_alone():
    loose = "e\u0301 "
    assert garbles(DE).label(loose + wrong("grün", "utf-8", "cp1252") + " " + loose)[0] == loose + "grün " + loose
    assert garbles(DE).label("gru" + wrong("\u0308n", "utf-8", "cp1252"))[0] == "grün"


def test_a_widespread_fault_does_not_hide_itself(spark):
    word = wrong("zażółć", "cp1250", "cp1252")
    for locales in (1, 4, 10):
        rows = [(i, word if i < locales else "grób", f"l{i}", PL) for i in range(10)]
        df = spark.createDataFrame(rows, "id bigint, text string, locale string, alphabet string")
        assert {(r["id"], r["restored"]) for r in find_garbled(df).collect()} == {(i, "zażółć") for i in range(locales)}
    # as common where no code page explains it: a foreign name, at any size
    for times in (1, 20):
        rows = [(i, "Ñuble", "pl", PL) for i in range(times)] + [(i, "Ñuble", "ru", RU) for i in range(times)] + [(i, "grób", "pl", PL) for i in range(9 * times)] + [(i, "мир", "ru", RU) for i in range(9 * times)]
        df = spark.createDataFrame(rows, "id bigint, text string, locale string, alphabet string")
        assert find_garbled(df).count() == 0
