import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wordloom.functions import boundaries, case, text

# Examples and what must come out.
GOLDEN_CASE = [("IDENTITETE", "all_upper"), ("Identitete", "first_upper"), ("1heavvanit", "all_lower"), ("1Heavvanit", "first_upper"), ("1HEAVVANIT", "all_upper"), ("RÁðI", "mostly_upper"), ("SGPai", "mixed"), ("cAT", "mixed"), ("McDonald", "mixed"), ("DavveVássján", "mixed"), ("Ab", "first_upper"), ("AB", "all_upper"), ("A", "none"), ("MCDONALD", "all_upper"), ("123", "none"), ("", "none"), ("AaS", "mixed"), ("C", "none")]


def column(spark, rows, name="w"):
    return spark.createDataFrame([(r,) for r in rows], f"{name} string")


def test_case_classes(spark):
    df = column(spark, [w for w, _ in GOLDEN_CASE] + [None])
    got = [r[0] for r in df.select(case.case_class(F.col("w"))).collect()]
    assert got == [c for _, c in GOLDEN_CASE] + [None]
    assert [case.py_case_class(w) for w, _ in GOLDEN_CASE] == [c for _, c in GOLDEN_CASE]


@pytest.mark.parametrize("word, mutation, variants, first", [("IDENTITETE", "all_caps", ("Identitete", "identitete"), False), ("RÁðI", "all_caps", ("Ráði", "ráði"), False), ("1Heavvanit", "first_caps", ("1heavvanit",), False), ("ŦMuitalusat", "first_caps", ("ŦMuitalusat",), True), ("cAt", "none", ("CAt",), True), ("iPhone", "none", ("IPhone",), True), ("sOMETHING", "none", (), True), ("123", "none", ("123",), False)])
def test_casings(spark, word, mutation, variants, first):
    c = case.casing(word)
    assert (c.mutation, c.variants, c.first_results) == (mutation, variants, first)
    row = column(spark, [word]).select(case.case_mutation(F.col("w")), case.case_variants(F.col("w"))).first()
    assert row[0] == mutation and tuple(row[1]) == variants


def test_first_letters(spark):
    row = column(spark, ["1ábc"]).select(case.upper_first(F.col("w")), case.lower_first(F.upper("w")), case.lower_case(F.lit("ΑΣ")), case.upper_case(F.lit("ß"))).first()
    assert tuple(row) == ("1Ábc", "1áBC", "ας".replace("ς", "σ"), "SS")


def test_words(spark):
    sentence = 'The quick ("brown") fox can\'t jump 32.3 feet, right? ordinary-sentence trailing- a_b ½'
    want = ["The", "quick", "brown", "fox", "can't", "jump", "32.3", "feet", "right", "ordinary-sentence", "trailing", "a_b", "½"]
    df = column(spark, [sentence, "", None, "«é» été"])
    rows = df.select(text.words(F.col("w")), text.word_indices(F.col("w"))).collect()
    assert rows[0][0] == want and rows[1][0] == [] and rows[2][0] is None and rows[3][0] == ["é", "été"]
    for t, r in zip([sentence, "", None, "«é» été"], rows):
        if t is not None:
            assert [(t.encode()[i["idx"] :]).decode().startswith(i["word"]) for i in r[1]] == [True] * len(r[1])
    assert [i["idx"] for i in rows[3][1]] == [2, 7]
    assert [s for _, s in text.py_word_indices(sentence)] == want
    life = column(spark, ["this is life"]).select(text.reversed_words(F.col("w"))).first()[0]
    assert [(x["idx"], x["word"]) for x in life] == [(8, "life"), (5, "is"), (0, "this")]


def test_segments():
    assert text.segments("this is life") == [(0, "this"), (4, " "), (5, "is"), (7, " "), (8, "life")]
    assert [s for _, s in text.segments("a-b c- 猫狗")] == ["a-b", " ", "c", "-", " ", "猫", "狗"]
    assert text.segments("") == []
    assert "".join(s for _, s in text.segments("👩‍🔧 e̱ x\r\ny")) == "👩‍🔧 e̱ x\r\ny"
    assert [s for _, s in text.segments("a+b", "+")] == ["a+b"]


# Examples and what must come out.
CONTEXTS = [("hello ", "world foo", ("world", "hello", None, "foo", None)), ("one two three ", "four five six", ("four", "three", "two", "five", "six")), ("", "word", ("word", None, None, None, None)), ("hel", "lo there", ("hello", None, None, "there", None)), ("a ", " b", ("", "a", None, "b", None))]


def test_cursor_context(spark):
    df = spark.createDataFrame([(a, b) for a, b, _ in CONTEXTS], "a string, b string")
    for (a, b, want), r in zip(CONTEXTS, df.select(text.cursor_context(F.col("a"), F.col("b")).alias("c")).collect()):
        c = r["c"]
        got = (c["current"]["word"], *(c[k]["word"] if c[k] else None for k in ("first_before", "second_before", "first_after", "second_after")))
        assert got == want, (a, b)
    assert df.select(text.cursor_context(F.col("a"), F.col("b")).alias("c")).collect()[4]["c"]["current"]["idx"] == 2


def test_graphemes(spark):
    df = column(spark, ["é👩‍🔧x", "", None])
    assert [r[0] for r in df.select(text.graphemes(F.col("w"))).collect()] == [["é", "👩‍🔧", "x"], [], None]


def is_(name, c):
    if name == "AHL":
        return is_("ALetter", c) or is_("Hebrew_Letter", c)
    if name == "MidLetter":
        return c in "-\u2010\u2011\ufe63\uff0d" or bool(regex.match(r"\p{WB=MidLetter}", c))
    return bool(regex.match(rf"\p{{WB={name}}}", c))


def parted(t, i):
    """Whether a boundary lies before t[i], by the published rules one after another."""
    if not i or i == len(t):
        return True
    a, b = t[i - 1], t[i]
    line = lambda c: is_("CR", c) or is_("LF", c) or is_("Newline", c)
    if a == "\r" and b == "\n":
        return False
    if line(a) or line(b):
        return True
    if a == "\u200d" and regex.match(r"\p{ExtPict}", b):
        return False
    skip = lambda c: is_("Extend", c) or is_("Format", c) or is_("ZWJ", c)
    if skip(b):
        return False
    left = []
    for j in range(i - 1, -1, -1):
        if line(t[j]):
            break
        # what extends nothing stands for itself
        if not skip(t[j]) or j == 0 or line(t[j - 1]):
            left.append("\ufffd" if skip(t[j]) else t[j])
    right = [c for c in t[i:] if not skip(c)]
    p, q = left[0], left[1] if len(left) > 1 else "\ufffd"
    n = right[1] if len(right) > 1 else "\ufffd"
    mid_l = lambda c: is_("MidLetter", c) or is_("MidNumLet", c) or c == "'"
    mid_n = lambda c: is_("MidNum", c) or is_("MidNumLet", c) or c == "'"
    num, kata, link, heb = (lambda c, x=x: is_(x, c) for x in ("Numeric", "Katakana", "ExtendNumLet", "Hebrew_Letter"))
    ahl = lambda c: is_("AHL", c)
    together = [
        (ahl(p) or num(p)) and (ahl(b) or num(b)),
        ahl(p) and mid_l(b) and ahl(n), ahl(q) and mid_l(p) and ahl(b),
        heb(p) and b == "'", heb(p) and b == '"' and heb(n), heb(q) and p == '"' and heb(b),
        num(q) and mid_n(p) and num(b), num(p) and mid_n(b) and num(n), kata(p) and kata(b),
        link(b) and (ahl(p) or num(p) or kata(p) or link(p)), link(p) and (ahl(b) or num(b) or kata(b)),
    ]
    if is_("Regional_Indicator", b):
        run = 0
        while run < len(left) and is_("Regional_Indicator", left[run]):
            run += 1
        together.append(run % 2 == 1)
    return not any(together)


LETTERS = st.sampled_from(list("aZé1٣_'\".,:-‐ \r\n\u0301\u200d\u00adשא中ひカタ가ไ½²🇦👩🔧🏽’\u2028\u0e31ⓐß"))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(LETTERS, max_size=14), max_size=5), st.booleans())
def test_boundaries_against_the_rules(texts, sliced):
    array = pa.array([None, "zz", *texts, None, ""])
    array = array.slice(2) if sliced else array
    got = boundaries.list_indices(array, every=True).to_pylist()
    words, counts, starts = (f(array).to_pylist() for f in (boundaries.list_words, boundaries.count_words, boundaries.list_starts))
    for t, g, w, n, i in zip(array.to_pylist(), got, words, counts, starts):
        if t is None:
            assert g is w is n is i is None
            continue
        cuts = [j for j in range(len(t) + 1) if t and parted(t, j)]
        want = [(len(t[:a].encode()), t[a:b]) for a, b in zip(cuts, cuts[1:])]
        assert [(x["idx"], x["word"]) for x in g] == want
        wordy = [(a, x) for a, x in want if regex.search(r"[\p{Alphabetic}\p{N}]", x)]
        assert w == [x for _, x in wordy] and n == len(wordy) and i == [a for a, _ in wordy]


def test_scripts_and_alphabets(spark):
    df = column(spark, ["abc中文def 中文字典", "ひらカタカナ", "a+b c#", None, ""])
    rows = df.select(text.words(F.col("w")), text.word_count(F.col("w")), text.words(F.col("w"), "+#"), text.word_bounds(F.col("w")), text.word_starts(F.col("w"))).collect()
    assert rows[0][0] == ["abc", "中", "文", "def", "中", "文", "字", "典"] and rows[0][1] == 8
    assert rows[1][0] == ["ひ", "ら", "カタカナ"]
    assert rows[2][0] == ["a", "b", "c"] and rows[2][2] == ["a+b", "c#"] and [x["word"] for x in rows[2][3]] == ["a", "+", "b", " ", "c", "#"]
    assert rows[2][4] == [0, 2, 4] and list(rows[3]) == [None] * 5 and rows[4][0] == [] and rows[4][1] == 0


def test_very_long_words(spark):
    df = column(spark, ["x" * 1_000_000, "中" * 300_000, "1" * 1_000_000 + " y", "a-" * 400_000])
    got = df.select(text.word_count(F.col("w")), F.length(text.words(F.col("w"))[0])).collect()
    assert [tuple(r) for r in got] == [(1, 1_000_000), (300_000, 1), (2, 1_000_000), (1, 799_999)]
