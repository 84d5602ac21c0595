"""Scalar rules, against literals."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from dialoglake.functions import text as tx
from dialoglake.functions import timecode as tc
from dialoglake.sources import files


def column(spark, values, kind, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_format_time_rounds_half_to_even(spark):
    assert column(spark, [0.0, 1.234, 3661.5, -2.0, 0.0005, 0.0015, 1.001], "double", tc.format_time) == ["00:00:00:000", "00:00:01:234", "01:01:01:500", "00:00:00:000", "00:00:00:000", "00:00:00:002", "00:00:01:001"]


def test_seconds_to_time_str_cuts(spark):
    assert column(spark, [0.0, 1.001, 3661.5, -1.0, float("nan"), float("inf")], "double", tc.seconds_to_time_str) == ["00:00:00,000", f"00:00:01,{int((1.001 * 1000) % 1000):03d}", "01:01:01,500", "00:00:00,000", "00:00:00,000", "00:00:00,000"]


def test_time_str_to_seconds(spark):
    assert column(spark, ["00:00:01,500", "1:2:3", "x", "", "00:00:01.25", "1:2", "01:00:00:999"], "string", tc.time_str_to_seconds) == [1.5, 3723.0, 0.0, 0.0, 1.25, 0.0, 3600.0]


def test_colon_to_comma(spark):
    assert column(spark, ["00:00:01:234", "0:00:01:5", "00:00:01,2", "", "1:02:03.7", "a:b:c:d", "12:30"], "string", tc.colon_ms_to_comma_ms) == ["00:00:01,234", "00:00:01,005", "00:00:01,2", "", "01:02:03,007", "a:b:c,d", "12:30"]


def test_distance_and_ms(spark):
    assert column(spark, [0.5, None], "double", tc.format_distance) == ["0.500000", ""]
    assert column(spark, [1.5, 1.0005], "double", tc.is_integer_ms) == [True, False]


def test_normalize_text(spark):
    assert column(spark, ["（a）b", "x[y]z[w]", "あ、い。", "　 a \t b ", "、。", "[a\nb]"], "string", tx.normalize_text) == ["a b", "x z", "あ い", "a b", "", "[a b]"]


def test_repeats(spark):
    values = ["そうそう", "はいはいはい", "ab" * 3, "abcde" * 3, "aaa", "", "ありがとうありがとうありがとう"]
    assert column(spark, values, "string", tx.is_short_unit_repeated) == [False, True, True, False, True, False, False]
    odd = ["ﾊｲ、ハイ！", "A B-C", None, "①", "が"]
    want = [None if v is None else re.sub(tx.NOISE, "", unicodedata.normalize("NFKC", v)) for v in odd]
    assert column(spark, odd, "string", tx.normalize_for_repeat) == want


def test_meaning_and_names(spark):
    assert column(spark, ["!", "a", "caus caus caus", "はい", "ok then", "。。"], "string", tx.is_meaningful) == [False, False, False, True, True, False]
    assert column(spark, ["Unknown", "unknown_3", "UNKNOWN_12", "", "  ", "Unknown_x", "Ann"], "string", tx.is_unknown) == [True] * 5 + [False] * 2
    assert column(spark, [" Ann ", ".hid", "a/b", "", "a?b", "森"], "string", tx.valid_name) == ["Ann", None, None, None, None, "森"]
    assert column(spark, ["/v/Ann_01.wav", "Bob.mp3", "森_a_b.wav"], "string", tx.voice_base_name) == ["Ann", "Bob", "森"]


@pytest.mark.parametrize(
    "text,rules,want",
    [
        ("（森）やあ", tx.LabelRules(), (["森"], [], "やあ")),
        ("(A)（B) hi", tx.LabelRules(), (["A", "B"], [], "hi")),
        ("word(not) x (lab)", tx.LabelRules(), (["lab"], [], "word(not) x")),
        ("[music] （笑） はい", tx.LabelRules(), ([], ["music", "笑"], "はい")),
        ("（ドアの作動音）", tx.LabelRules(), ([], ["ドアの作動音"], "")),
        ("（笑福亭）話", tx.LabelRules(), (["笑福亭"], [], "話")),
        ("（中嶋／手話・音声通訳）話", tx.LabelRules(strip_suffix=True, speakers=("中嶋／手話・音声通訳",)), (["中嶋"], [], "話")),
        ("（a（b）c）d", tx.LabelRules(), (["a（b）c"], [], "d")),
        ("（open", tx.LabelRules(), ([], [], "（open")),
        ("[Ann] hi\n[Ann] you", tx.LabelRules(square_is_speaker=True), (["Ann"], [], "hi\nyou")),
        ("（[BGM]）x", tx.LabelRules(square_is_speaker=True), ([], ["BGM"], "x")),
        ("[［拍手］] x", tx.LabelRules(square_is_speaker=True), ([], ["拍手"], "x")),
        (None, tx.LabelRules(), ([], [], "")),
    ],
)
def test_labels(text, rules, want):
    got = tx.read_labels(text, rules)
    assert (got["speakers"], got["non_speech_labels"], got["body"]) == want


def test_match_key(spark):
    assert column(spark, ["（笑）やあ、[x]君", "a (b (c)) d", "x (open", "［音］y"], "string", tx.match_key) == ["やあ 君", "a d", "x (open", "y"]


def test_script_from_text(spark):
    raw = "A: hello\n森：こんにちは\n# scene\n（場面）\nno speaker\n\n" + "x" * 31 + ": long\n" + "x" * 32 + ": longer"
    rows = files.script_from_text(spark.createDataFrame([("m", raw), ("n", "B: x")], "media_id string, text string")).where("media_id = 'm'").orderBy("id").collect()
    assert [(r.type, r.speaker, r.contents) for r in rows] == [("dialogue", "A", "hello"), ("dialogue", "森", "こんにちは"), ("scene", "", "scene"), ("scene", "", "場面"), ("dialogue", "", "no speaker"), ("dialogue", "x" * 31, "long"), ("dialogue", "", "x" * 32 + ": longer")]


def test_subtitle_files(spark, tmp_path):
    (tmp_path / "a.srt").write_bytes("﻿2\r\n00:00:05,000 --> 00:00:06,5\r\n（B）two\r\nlines\r\n\r\nno time\r\n\r\n1\r\n0:00:01.250 --> 0:00:02.000\r\n（A）one\r\n".encode())
    rows = files.read_subtitles(spark, str(tmp_path / "a.srt")).orderBy("entry_no").collect()
    assert [(r.media_id, r.entry_no, r["index"], r.start, r.end, r.speakers, r.body) for r in rows] == [("a", 1, 2, 1.25, 2.0, ["A"], "one"), ("a", 2, 1, 5.0, 6.005, ["B"], "two\nlines")]


def test_stt_files(spark):
    text = "1\n00:00:01,000 --> 00:00:02,000\n[Ann] hello\nthere\n\n2\n00:00:03,000 --> 00:00:03,000\nnone\n\n3\n00:00:04,000 --> 00:00:05,000\n!\n\nbad\n\n4\n00:00:06,000 --> 00:00:07,000\nbye now"
    rows = files.parse_stt_srt(spark.createDataFrame([("m", text)], "media_id string, text string")).orderBy("id").collect()
    assert [(r.id, r.text, r.stt_speaker, r.start) for r in rows] == [(0, "hello there", "Ann", 1.0), (1, "bye now", "", 6.0)]


def test_csv_rttm_voices_phrases(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes('﻿a,b\r\n"x ""q""\ny",\r\n'.encode())
    assert [tuple(r) for r in files.read_csv_table(spark, str(tmp_path / "t.csv")).collect()] in ([("t", 'x "q"\ny', "")], [("t", 'x "q"\r\ny', "")])
    (tmp_path / "r.rttm").write_text("SPEAKER u 1 1.5 2.0 <NA> <NA> A <NA> <NA>\nSPEAKER u 1 x 2 <NA> <NA> A\nshort\n")
    assert [(r.cluster_id, r.start, r.end) for r in files.read_rttm(spark, str(tmp_path / "r.rttm")).collect()] == [("A", 1.5, 3.5)]
    (tmp_path / "db1").mkdir()
    for n in ("Ann.wav", "Ann.MP3", "Bob.flac", "note.txt"):
        (tmp_path / "db1" / n).write_bytes(b"x")
    got = {(r.speaker, r.problem) for r in files.scan_voice_files(spark.read.format("binaryFile").load(str(tmp_path / "db1"))).collect()}
    assert got == {("Ann", "duplicate"), ("Bob", None)}
    extra = spark.createDataFrame([("# c",), ("",), (" mine ",)], "value string")
    assert {r.phrase for r in files.load_phrases(spark, extra).collect()} == {*files.STOCK_PHRASES, "mine"}


def test_repair_chunks(spark):
    rows = [("m", 0, None, None, "a"), ("m", 1, 1.0, None, "b"), ("m", 2, None, 3.0, "c"), ("m", 3, None, None, "d"), ("n", 0, 5.0, 6.0, "e")]
    whole = spark.createDataFrame([("m", "x"), ("o", "only text"), ("p", " ")], "media_id string, text string")
    got = files.repair_asr_chunks(spark.createDataFrame(rows, "media_id string, seq int, start double, end double, text string"), whole).orderBy("media_id", "seq").collect()
    assert [(r.media_id, r.start, r.end) for r in got] == [("m", 0.0, 0.0), ("m", 1.0, 1.0), ("m", 1.0, 3.0), ("m", 3.0, 3.0), ("n", 5.0, 6.0), ("o", 0.0, 0.0)]


MESSY = "\ufeff\n \n1\r\n00:00:05,000 --> 00:00:06,000\r\n（森）later\r\n\r\n2\n00:00:01,000 --> 00:00:02,500\nfirst\n \t\n\n\nno time here\n\n3\r00:00:01.000 --> 00:00:02,000\rcarriage\r\r4\n00:00:03,000 --> 00:00:04,000\nlast é漢\n\u3000\n"


@pytest.mark.parametrize("spaces", [True, False])
def test_blocks_are_the_same_at_any_split(tmp_path, spaces):
    import pyarrow.fs as fs

    from dialoglake.sources.blocks import blocks_of

    for n, text in enumerate((MESSY, MESSY.replace("\r\n", "\n").replace("\r", "\n"), "", "\n\n", "x", "\r\n\r\nx\r\n\r\n")):
        path = tmp_path / f"{n}.srt"
        path.write_bytes(text.encode())
        file, size = fs.LocalFileSystem().open_input_file(str(path)), len(text.encode())
        whole = list(blocks_of(file, 0, size, spaces))
        plain = [b for b in re.split(r"\n[ \t\n\x0b\f\r]*\n" if spaces else r"\n\n+", re.sub("\r\n?", "\n", text.removeprefix("\ufeff")).strip("\n")) if b.strip("\n")]
        assert [b.strip() for b in whole if b.strip()] == [b.strip() for b in plain if b.strip()]
        for step in (1, 3, 2**16):
            for cut in range(1, size):  # a split at every byte
                assert list(blocks_of(file, 0, cut, spaces, step)) + list(blocks_of(file, cut, size, spaces, step)) == whole
        for width in (1, 2, 5):
            assert [b for a in range(0, size, width) for b in blocks_of(file, a, min(size, a + width), spaces)] == whole


def test_files_read_in_splits_give_the_same_rows(spark, tmp_path):
    r = random.Random(1)
    for name in ("one", "two"):
        rows = [f"{i}\n00:{r.randrange(60):02}:{r.randrange(60):02},000 --> 01:00:00,000\n[A] word number {i}\n" for i in range(200)]
        (tmp_path / f"{name}.srt").write_text("\n".join(rows))
    (tmp_path / "messy.srt").write_bytes(MESSY.encode())
    plain = lambda df: sorted(map(str, df.collect()))
    texts = files.whole_texts(spark, str(tmp_path))
    want, heard = plain(files.parse_subtitles(texts)), plain(files.parse_stt_srt(texts))
    assert len(want) == 404 and len(heard) > 400
    for size in (97, 1000, 2**25):
        assert plain(files.read_subtitles(spark, str(tmp_path), split_bytes=size)) == want
        assert plain(files.read_stt_srt(spark, str(tmp_path), split_bytes=size)) == heard
    assert {x.media_id for x in files.read_subtitles(spark, str(tmp_path / "t*.srt")).collect()} == {"two"}
