
import hashlib
import math
import random
import time

import cases
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cadenza.functions import audio, fixed, pinyin, segment
from cadenza.functions.sandhi import sandhi_surface


def one(spark, rows, schema, **columns):
    return [r.asDict(True) for r in spark.createDataFrame(rows, schema).select(*[c.alias(k) for k, c in columns.items()]).collect()]


@pytest.mark.parametrize("text, n, want", cases.SEGMENTS)
def test_segment(text, n, want):
    assert segment.segment(text, n, segment.ordered_vocabulary(cases.VOCABULARY)) == (want.split() or None)


def test_segment_rules():
    v = segment.ordered_vocabulary(["xi", "an", "xian", "a", "n", "na"])
    assert segment.segment("xīan", 2, v) == ["xi", "an"]
    assert segment.segment("xī'an", 1, v) is None  # a syllable may not cross a boundary
    assert segment.segment("ana", 2, v) == ["a", "na"]
    assert segment.segment("ünü", 2, segment.ordered_vocabulary(["v", "nv"])) == ["v", "nv"]
    assert segment.segment("abab", 2, segment.ordered_vocabulary(["ab", "a", "bab", "aba", "b"])) is None  # several are as good


def test_segment_keeps_a_bounded_number_of_ways():
    v = segment.ordered_vocabulary(["m", "mm", "mmm"])
    assert segment.segment("m" * 60, 30, v) is None


def test_syllable_tones():
    assert segment.syllable_tones("nǐhǎo", ["ni", "hao"]) == [3, 3]
    assert segment.syllable_tones("bàba", ["ba", "ba"]) == [4, 0]
    assert segment.syllable_tones("nǐhǎo", ["ni"]) is None
    assert segment.syllable_tones("nǐháo", ["nihao"]) is None
    assert segment.syllable_tones(None, None) == []


def test_marked_vowels_cover_both_cases(spark):
    marks = "".join(fixed.MARKED_VOWELS)
    got = one(spark, [(marks,), (marks.upper(),)], "x string", t=pinyin.accent_tones(F.col("x")))
    assert got[0]["t"] == got[1]["t"] == [t for t in (1, 2, 3, 4) for _ in range(6)]


def test_tones_and_patterns(spark):
    got = one(spark, [("行 行 [xing2 x5 q]/x/",), (None,), ("[]",), ("a [b] [c1]",)], "x string", t=pinyin.cedict_tones(F.col("x")))
    assert [r["t"] for r in got] == [[2, 0], [], [], []]
    got = one(spark, [("Běi jīng·de-x1",), ("  ",), (None,)], "x string", t=pinyin.accent_tones(F.col("x")))
    assert [r["t"] for r in got] == [[3, 1, 0], [], []]
    got = one(spark, [([1, 0, 4],), ([],), (None,)], "x array<int>", p=pinyin.pattern(F.col("x")))
    assert [r["p"] for r in got] == ["1-N-4", "", ""]


def test_text_functions(spark):
    got = one(spark, [("Lǜ u:e lu:4 LU:4 nü3 x6 r5", " a|b ")], "x string, y string", r=pinyin.normalize_reading(F.col("x")), k=pinyin.correction_key(F.lit("LÜ"), F.lit(4)), f=pinyin.first_alternative(F.col("y")), w=pinyin.safe_word(F.lit("a/b\\c")), h=pinyin.escape_html(F.lit("<a b=\"c\">&'")), p=pinyin.plain(F.lit("Lǜ-É!")), n=pinyin.normalized_text(F.lit("你好, A1!")))
    assert got == [{"r": ["lv4", "nv3", "r5"], "k": "lv4", "f": "a", "w": "a／b＼c", "h": "&lt;a b=&quot;c&quot;&gt;&amp;&#39;", "p": "lve", "n": "你好a1"}]
    got = one(spark, [(["ni", "hao", "x"], [3, 0])], "s array<string>, t array<int>", e=pinyin.expected_reading(F.col("s"), F.col("t")))
    assert got[0]["e"] == ["ni3", "hao5"]
    got = one(spark, [([" ", "CL:个", "a", "b ", "　c", "d", "e"],)], "d array<string>", c=pinyin.clean_definitions(F.col("d")))
    assert got[0]["c"] == ["a", "b", "c", "d"]


def plain_sandhi(word, tones):
    """The rules one after another, on a list."""
    out, tags = list(tones), set()
    chars = [c for c in word if "㐀" <= c <= "鿿"]
    if 0 in tones:
        tags.add("neutral_tone")
    if len(chars) == len(tones):
        for i, c in enumerate(chars):
            if c in "不一" and 0 < i < len(chars) - 1 and chars[i - 1] == chars[i + 1]:
                out[i] = 0
                tags.add("bu_a_not_a" if c == "不" else "yi_reduplication")
        for i, c in enumerate(chars[:-1]):
            if c == "不" and out[i] and tones[i] == tones[i + 1] == 4:
                out[i] = 2
                tags.add("bu_before_t4")
            if c == "一" and out[i] and tones[i] == 1 and not (i and chars[i - 1] == "第") and tones[i + 1]:
                out[i] = 2 if tones[i + 1] == 4 else 4
                tags.add("yi_before_t4" if tones[i + 1] == 4 else "yi_before_non_t4")
    at = 0
    while at < len(tones):
        end = at
        while end < len(tones) and tones[end] == 3:
            end += 1
        if end - at >= 2:
            tags.add("third_tone_sandhi")
            out[at : end - 1] = [2] * (end - at - 1)
        if end - at >= 3:
            tags.add("third_tone_grouping_ambiguous")
        at = max(end, at + 1)
    return out, sorted(tags), len(chars) == len(tones)


def test_sandhi_against_plain_rules(spark):
    rng = random.Random(8)
    rows = [("".join(rng.choices("不一第好看x", k=rng.randrange(0, 6))), [rng.randrange(5) for _ in range(rng.randrange(0, 6))]) for _ in range(1500)]
    rows += [("".join(rng.choices("不一第好", k=n)), [rng.choice([0, 1, 3, 4]) for _ in range(n)]) for n in range(1, 7) for _ in range(200)]
    got = spark.createDataFrame(rows, "w string, t array<int>").select("w", "t", sandhi_surface(F.col("w"), F.col("t")).alias("s")).collect()
    for r in got:
        assert (r["s"]["surface"], r["s"]["tags"], r["s"]["aligned"]) == plain_sandhi(r["w"], r["t"]), (r["w"], r["t"])


def test_gain(spark):
    rows = [([[0.02, -0.02, 0.02, -0.02]],), ([[0.4, -0.4]],), ([[0.8, -0.8] + [0.011] * 49 + [-0.011] * 49],), ([[0.0, 0.0, 0.0]],), ([[0.08, 0.1, 0.12]],), ([[]],)]
    got = one(spark, rows, "c array<array<double>>", g=audio.gain(F.col("c")), o=audio.offsets(F.col("c")))
    assert [r["g"] for r in got[:4]] == pytest.approx([8, 0.4, 1.125, 1], abs=1e-6)
    assert got[4]["o"] == pytest.approx([0.1]) and got[5] == {"g": 1.0, "o": [0.0]}


def test_payload_hash_and_magic(spark):
    tag = b"ID3\x04\x00\x00\x00\x00\x01\x02" + b"t" * 130
    rows = [(bytearray(x),) for x in (b"\xff\xfbpayload", tag + b"\xff\xfbpayload", b"\xff\xfbother", b"ID3", b"", b"RIFF")]
    got = one(spark, rows, "c binary", h=audio.payload_hash(F.col("c")), v=audio.valid_mp3(F.col("c")))
    assert got[0]["h"] == got[1]["h"] == hashlib.sha256(b"\xff\xfbpayload").hexdigest() != got[2]["h"]
    assert [r["v"] for r in got] == [True, True, True, False, False, False]


def test_edges(spark):
    tone = [int(10_000 * math.sin(2 * math.pi * 440 * i / 16_000)) for i in range(3200)]
    got = one(spark, [([0] * 1600 + tone + [0] * 2400,), ([],), ([0] * 480,)], "s array<int>", e=audio.edge_buffers(F.col("s")))
    assert got[0]["e"]["lead"] == pytest.approx(0.10) and got[0]["e"]["tail"] == pytest.approx(0.15)
    assert got[1]["e"] == {"lead": 0.0, "tail": 0.0, "duration": 0.0} and got[2]["e"]["duration"] == pytest.approx(0.03)


def test_silence(spark):
    got = one(spark, [([0.0, 0.3, 0.9], [0.1, 0.5]), ([0.3], [0.4]), ([], [])], "s array<double>, e array<double>", g=audio.internal_silence(F.col("s"), F.col("e"), F.lit(1.0)))
    assert [None if r["g"] is None else round(r["g"], 6) for r in got] == [0.2, None, None]


def test_contours():
    assert audio.contour([100.0] * 4) is None and audio.contour([None, 80.0] * 9) is None
    up = audio.contour(np.linspace(100, 200, 40))
    assert len(up) == 9 and up == sorted(up) and up[-1] - up[0] == pytest.approx(12, abs=1e-6)


def test_similarity():
    rng = np.random.default_rng(0)
    x = audio.normalized_wave(rng.standard_normal(900), 1000)
    assert audio.similarity(x, -np.roll(x, 7), 10) > 0.99 > audio.similarity(x, rng.standard_normal(1000), 10)
    assert audio.similarity(np.zeros(10), np.zeros(10)) == 0


def test_waves_are_made_a_few_at_a_time(spark):
    """However many rows come at once, no more than WAVES waves are held; nothing of them changes."""
    rng = np.random.default_rng(0)
    tracks = [rng.standard_normal(5).tolist() for _ in range(2 * audio.WAVES + 9)] + [None, [1.0], [], [2.0, 2.0], [1.0, None, 3.0]]
    got = list(audio.normalized_wave_column.func(iter([pd.Series(tracks), pd.Series([], dtype=object), pd.Series(tracks[:1])])))
    assert sum(map(len, got)) == len(tracks) + 1 and max(map(len, got)) <= audio.WAVES
    df = spark.createDataFrame(list(enumerate(tracks)), "i int, t array<double>").repartition(2)
    waves = {r["i"]: r["w"] for r in df.select("i", audio.normalized_wave_column(F.col("t")).alias("w")).collect()}
    assert all(waves[i] == audio.normalized_wave(t).tolist() for i, t in enumerate(tracks) if t is not None and None not in t) and len(waves) == len(tracks)
    assert waves[len(tracks) - 5] is None and set(waves[len(tracks) - 1]) == {None}


def test_assembly(spark):
    clips = [[[0.1, -0.1]], [[0.2, -0.2], [0.0, 0.0]]]
    left, right = one(spark, [(clips,)], "c array<array<array<double>>>", a=audio.assemble(F.col("c"), 100))[0]["a"]
    assert len(left) == len(right) == 12 + 2 + 6 + 2 + 20 and left[12] == right[12] == pytest.approx(0.16) and right[20] == 0 < left[20]
    assert one(spark, [(clips,)], "c array<array<array<double>>>", a=audio.assemble(F.col("c"), 100, F.array(F.lit(1), F.lit(1))))[0]["a"][0] == left
    with pytest.raises(Exception, match="rates do not match"):
        one(spark, [(clips,)], "c array<array<array<double>>>", a=audio.assemble(F.col("c"), 100, F.array(F.lit(1), F.lit(2))))


def test_long_clips(spark):
    """Half a minute at 16 kHz: the kernels take time in proportion to the samples."""
    wave = F.transform(F.sequence(F.lit(1), F.lit(480_000)), lambda i: F.sin(i * 0.05) * 0.3 + 0.1)
    df = spark.range(1).select(F.array(wave).alias("c"))
    began = time.perf_counter()
    got = df.select(audio.gain(F.col("c")).alias("g"), audio.offsets(F.col("c"))[0].alias("o"), F.size(audio.assemble(F.array(F.col("c")), 16_000)[0]).alias("n")).first()
    assert got["o"] == pytest.approx(0.1, abs=1e-3) and got["g"] == pytest.approx(0.16 / math.sqrt(0.3**2 / 2), rel=2e-2) and got["n"] == 480_000 + 1920 + 3200
    assert time.perf_counter() - began < 20


def test_audio_url(spark):
    got = one(spark, [("audio/a.mp3",), ("http://x",), ("",), (None,)], "p string", u=pinyin.audio_url(F.col("p")))
    assert [r["u"] for r in got] == ["../audio/a.mp3", "http://x", "", ""]
