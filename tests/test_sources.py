import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tests import automata
from wordloom.model import IDENTITY, Fst, Reweighting, SpellerConfig
from wordloom.operators.suggest import Speller
from wordloom.sources import corpora, transducers
from wordloom.sources.transducers import Archive, CorruptArchive, Metadata, Titled, UnsupportedArchive

INDEX = """<?xml version="1.0"?><hfstspeller dtdversion="1.0" hfstversion="3"><info><locale>se</locale><title>Test</title>
<title xml:lang="en">Test (en)</title><description>d</description><producer>p</producer></info>
<acceptor type="general" id="acceptor.default.hfst"><title>a</title><description>x</description><continuation>c</continuation></acceptor>
<errmodel id="errmodel.default.hfst"><title>e</title><description>y</description></errmodel></hfstspeller>"""


def language(fst, words):
    from wordloom.operators.accept import Lexicon

    lex = Lexicon(fst)
    return [lex.analyses(w) for w in words]


WORDS = ["cat", "car", "cart", "care", "cär", "rat", "ca", ""]


@pytest.mark.parametrize("fst", [automata.lexicon(), automata.mutator(), automata.flagged(), automata.tagged(), automata.wildcard(True)], ids=["lexicon", "mutator", "flags", "tags", "wild"])
def test_round_trips(tmp_path, fst):
    a = transducers.read_thfst(transducers.write_thfst(fst, tmp_path / "a"))
    b = transducers.read_hfst(transducers.write_hfst(fst))
    c = transducers.read_thfst_chunks(transducers.write_thfst(fst, tmp_path / "c", chunks=4))
    for other in (a, b, c):
        assert other.keys == fst.keys and len(other.arc_rows()) == len(fst.arc_rows()) and other.flags.keys() == fst.flags.keys()
        assert language(other, WORDS) == language(fst, WORDS)
        assert (other.identity, other.unknown) == (fst.identity, fst.unknown)


def test_broken_files(tmp_path):
    data = transducers.write_hfst(automata.lexicon())
    for cut in (3, 30, 70, len(data) - 5):
        with pytest.raises(CorruptArchive):
            transducers.read_hfst(data[:cut])
    folder = transducers.write_thfst(automata.lexicon(), tmp_path / "x")
    (folder / "index").write_bytes(b"abc")
    with pytest.raises(CorruptArchive):
        transducers.read_thfst(folder)
    with pytest.raises(CorruptArchive):
        transducers.parse_metadata("<a>")
    with pytest.raises(UnsupportedArchive):
        transducers.open_archive("x.txt")


def test_archives(tmp_path):
    path = tmp_path / "se.zhfst"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("index.xml", INDEX)
        z.writestr("acceptor.default.hfst", transducers.write_hfst(automata.lexicon()))
        z.writestr("errmodel.default.hfst", transducers.write_hfst(automata.mutator()))
    archive = transducers.open_archive(path)
    assert archive.locale == "se" and archive.metadata.titles == [(None, "Test"), ("en", "Test (en)")] and archive.metadata.acceptor.continuation == "c"
    raw = SpellerConfig(reweight=None, recase=False)
    want = [(s.value, s.weight) for s in Speller(automata.lexicon(), automata.mutator()).suggest("kat", raw)]
    assert [(s.value, s.weight) for s in archive.speller().suggest("kat", raw)] == want
    unpacked = transducers.open_archive(transducers.convert_archive(path, tmp_path / "se.bhfst"))
    assert unpacked.metadata.acceptor.id == "acceptor.default.thfst" and [(s.value, s.weight) for s in unpacked.speller().suggest("kat", raw)] == want
    assert transducers.find_speller("se", [tmp_path]).suffix == ".bhfst" and transducers.find_speller("fi", [tmp_path]) is None
    (tmp_path / "bad.zhfst").write_bytes(b"no zip")
    with pytest.raises(CorruptArchive):
        transducers.open_archive(tmp_path / "bad.zhfst")


def test_metadata_json():
    m = Metadata("fi", [("en", "T")], None, "P", Titled("a.thfst", "general"), Titled("e.thfst"))
    assert transducers.parse_metadata(json.dumps(m.to_dict()).encode()) == m


def test_settings():
    c = SpellerConfig.from_json('{"n-best": 5, "reweight": {"mid-penalty": 2.0}, "beam": null}')
    assert c.n_best == 5 and c.reweight == Reweighting(10, 10, 2) and c.max_weight == 10000
    assert SpellerConfig.from_json(json.dumps(c.to_dict())) == c and "verbose" not in c.to_dict()
    assert c.with_flags(n_best=0, max_weight=0, completion_marker=None).n_best is None
    assert SpellerConfig.from_foreign(0, -1, 0, (0, 0, 0)).reweight is None and SpellerConfig.from_foreign(3).n_best == 3
    with pytest.raises(ValueError, match=r"\^"):
        SpellerConfig.from_json('{"n-best": }')
    with pytest.raises(ValueError, match="unknown"):
        SpellerConfig.from_json('{"n": 1}')


def test_frames_round_trip(spark):
    fst = automata.flagged()
    back = Fst.from_frames(*fst.frames(spark, "f"), "f")
    assert back.keys == fst.keys and sorted(back.arc_rows()) == sorted(fst.arc_rows()) and back.finals == fst.finals and back.flags == fst.flags
    kinds = {r["key"]: r["kind"] for r in automata.wildcard(True).frames(spark, "w")[0].collect()}
    assert kinds[IDENTITY] == "identity" and kinds["c"] == "char" and kinds[""] == "eps"


def test_lists(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("# c\nkat\t cat \nfoo\nbar\t\na\tb\tc\n\n \tq\n", "utf-8")
    got = [tuple(r) for r in corpora.read_typos(spark, str(tmp_path / "t.tsv")).collect()]
    assert got == [("kat", "cat"), ("foo", None), ("bar", None), ("a", "b"), (" ", "q")]
    assert corpora.read_typos(spark, str(tmp_path / "t.tsv"), 2).count() == 2
    assert [tuple(r) for r in corpora.read_pairs(spark, str(tmp_path / "t.tsv")).collect()] == [("kat", " cat "), ("bar", ""), ("a", "b"), (" ", "q")]
    (tmp_path / "w.txt").write_text(" a \n\nb\n", "utf-8")
    assert [r[0] for r in corpora.read_words(spark, str(tmp_path / "w.txt")).collect()] == ["a", "b"]


def test_writers(spark, tmp_path):
    details = "struct<lexicon_weight: float, mutator_weight: float, reweight_start: float, reweight_mid: float, reweight_end: float>"
    rows = [("kat", False, [("cat", 15.0, (0.0, 5.0, 10.0, -1.0, 0.0))]), ("cat", True, [])]
    df = spark.createDataFrame(rows, f"word string, is_correct boolean, suggestions array<struct<value: string, weight: float, weight_details: {details}>>")
    plain = [r[0] for r in corpora.suggestion_lines(df).collect()]
    assert plain == ["Input: kat\t\t[INCORRECT]\ncat\t\t15.00000", "Input: cat\t\t[CORRECT]\n"]
    assert corpora.suggestion_lines(df, verbose=True).first()[0].endswith("cat\t\t15.00000 (lex: 0.00000, mut: 5.00000, rew: 10.00000/-/0.00000)")
    assert json.loads(corpora.to_json_lines(df).first()[0])["suggestions"][0]["value"] == "cat"
    s = spark.createDataFrame([("cat", 5.0, 10.0, -1.0, 0.0)], "value string, mutator_weight double, reweight_start double, reweight_mid double, reweight_end double")
    a = spark.createDataFrame([("cat", "cat+N", 1.0)], "word string, analysis string, weight double")
    assert corpora.analysis_lines(s, a).first()[0] == "cat\tcat+N\t1.00000\t16.00000"
    summary = spark.createDataFrame([(1, 3)], "report_id bigint, total_words bigint")
    results = spark.createDataFrame([(1, "b"), (1, "a")], "report_id bigint, input string")
    body = json.loads(corpora.report_json(results, summary, "report_id").first()["value"])
    assert body["summary"] == {"total_words": 3} and [r["input"] for r in body["results"]] == ["a", "b"]
    times = spark.createDataFrame([(1, (5, 6), (7, 8))], "report_id bigint, start_timestamp struct<secs: bigint, subsec_nanos: int>, total_time struct<secs: bigint, subsec_nanos: int>")
    body = json.loads(corpora.report_json(results, summary, "report_id", config='{"n-best": 10, "beam": null}', metadata='{"info": {"locale": "se"}}', times=times).first()["value"])
    assert body["config"] == {"n-best": 10, "beam": None} and body["metadata"]["info"]["locale"] == "se"
    assert body["start_timestamp"] == {"secs": 5, "subsec_nanos": 6} and body["total_time"]["secs"] == 7


def test_history(spark, tmp_path):
    summary = spark.createDataFrame([(3, 4, 5, 6, None)], "first_position bigint, top_five bigint, any_position bigint, no_suggestions bigint, only_wrong bigint")
    for i in range(3):
        corpora.append_history(corpora.history_lines(summary, git_id=f"g{i}", date="d", describe="v1"), str(tmp_path / "h"))
    lines = sorted(x.replace(chr(34) * 2, "") for f in (tmp_path / "h").glob("part-*") for x in f.read_text("utf-8").splitlines())
    assert lines == [*(f"g{i}\td\tv1\t3\t4\t5\t6\t" for i in range(3)), "\t".join(corpora.HISTORY)]


def test_first_lines_quotes_and_formats(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("".join(f"w{i}\te{i}\n" for i in range(3000)), "utf-8")
    assert [r["input"] for r in corpora.read_typos(spark, str(tmp_path / "t.tsv"), 40).collect()] == [f"w{i}" for i in range(40)]
    (tmp_path / "q.tsv").write_text('"a ""b"""\t"c"\n"x\ty\n', "utf-8")
    assert [tuple(r) for r in corpora.read_typos(spark, str(tmp_path / "q.tsv")).collect()] == [('a "b"', "c"), ('"x', "y")]
    row = spark.createDataFrame([(0.12345, 61_500_000_000, 1_250_000_000)], "s double, a bigint, b bigint").select(corpora.per_cent(F.col("s")), corpora.human_time(F.col("a")), corpora.human_time(F.col("b"))).first()
    assert tuple(row) == ("12.35", "1:1.500", "00:1.250")
    s = spark.createDataFrame([("kat", 1, "cat", 5.0), ("kat", 2, "at", 6.0)], "word string, rank int, value string, weight double")
    a = spark.createDataFrame([("cat", "cat+N", 1.0), ("cat", "cat+V", 0.5)], "word string, analysis string, weight double")
    doc = json.loads(corpora.suggestion_json(s, a).first()["value"])
    assert [x["value"] for x in doc["suggestions"]] == ["cat", "at"] and [x["analysis"] for x in doc["suggestions"][0]["combinedAnalysis"]] == ["cat+V", "cat+N"]


def test_stored_archives(spark, tmp_path):
    archive = Archive(automata.lexicon(), automata.mutator(), Metadata("se", [("en", "T")], None, "P", Titled("a.hfst", "general"), Titled("e.hfst")))
    folder = transducers.write_archive(archive, tmp_path / "se.bhfst")
    stored = transducers.open_stored(spark, str(folder))
    assert stored.metadata.acceptor.id == "a.thfst" and sorted(stored.lexicon.arc_rows()) == sorted(transducers.open_archive(folder).lexicon.arc_rows())
    info = transducers.archive_info(stored)
    assert info["acceptor"]["states"] == len(automata.lexicon().states()) and info["metadata"]["info"]["locale"] == "se"
    with pytest.raises(transducers.UnsupportedArchive):
        transducers.open_stored(spark, "x.tar")
    (tmp_path / "bad.bhfst").mkdir()
    with pytest.raises(CorruptArchive):
        transducers.open_archive(tmp_path / "bad.bhfst")


def test_command_line(spark, tmp_path, capsys):
    from wordloom.__main__ import main

    folder = str(transducers.write_archive(Archive(automata.lexicon(), automata.mutator(), Metadata("se")), tmp_path / "se.bhfst"))
    assert main(["suggest", "--archive", folder, "--json", "--statistics", "--n-best", "2", "kat", "cat"]) == 0
    wrong, right = json.loads(capsys.readouterr().out)
    assert not wrong["is_correct"] and wrong["suggestions"][0]["value"] == "cat" and len(wrong["suggestions"]) <= 2 and wrong["statistics"]["taken"] > 0 and right["suggestions"] == []
    assert main(["suggest", "--archive", folder, "kat"]) == 0 and "Input: kat\t\t[INCORRECT]" in capsys.readouterr().out
    assert main(["tokenize", "a-b c"]) == 0 and capsys.readouterr().out == '0\t"a-b"\n3\t" "\n4\t"c"\n'
    assert main(["tokenize", "--words", "a-b  c"]) == 0 and capsys.readouterr().out == '0\t"a-b"\n5\t"c"\n'
    (tmp_path / "t.tsv").write_text("kat\tcat\ncat\n", "utf-8")
    code = main(["accuracy", "--archive", folder, "--json-output", str(tmp_path / "r.json"), "--threshold", "40", str(tmp_path / "t.tsv")])
    report = json.loads((tmp_path / "r.json").read_text("utf-8"))
    assert code == 0 and report["summary"]["total_words"] == 2 and report["config"]["n-best"] == 10 and report["results"][1]["time"]["subsec_nanos"] > 0
    assert main(["accuracy", "--archive", folder, "--threshold", "60", str(tmp_path / "t.tsv")]) == 1
    assert main(["info", folder]) == 0 and main(["info", str(tmp_path / "no.zip")]) == 2
