"""Operators, sources, sinks and streams on small tables."""

import io
import json
import random
import time
import zipfile

import cases
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cadenza.functions import pinyin
from cadenza.operators import audits, bundle, history, ingest, selection, vocabulary
from cadenza.plans import pipelines, policy
from cadenza.sources import readers, schemas, sinks
from cadenza.streaming import jobs


def rows(df):
    return [r.asDict(True) for r in df.collect()]


def write(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode(encoding))
    return str(path)


HSK = """ID,Simplified,Traditional,Pinyin,POS,Level,CEDICT
L1-0001,你好|您好,你好,nǐhǎo,intj,1,"你好 你好 [ni3 hao3] /hello ""there""/"
L2-0044,不一会儿,不一會兒,bùyīhuìr,adv,2,
L1-0170,妈妈,媽媽,māma,n,1,媽媽 妈妈 [ma1 ma1] /mum/
L4-0853,眼里,眼裡,x,n,4,"two
lines"
"""


def test_vocabulary_build(spark, tmp_path):
    source = readers.read_vocabulary(spark, write(tmp_path / "hsk.csv", HSK, "utf-8-sig"))
    words = {r["id"]: r for r in rows(vocabulary.build_words(source))}
    assert words["L1-0001"]["word"] == "你好" and words["L1-0001"]["default_surface_pattern"] == "2-3"
    assert words["L2-0044"]["lexical_tones"] == [4, 1, 4, 0] and words["L2-0044"]["default_surface_pattern"] == "4-2-4-N"
    assert words["L1-0170"]["lexical_pattern"] == "1-1" and words["L1-0170"]["default_surface_pattern"] == "1-N" and words["L1-0170"]["sandhi_tags"] == ["neutral_tone"]
    assert words["L4-0853"]["pinyin"] == "yǎnlǐ" and words["L4-0853"]["lexical_tones"] == [3, 3]
    assert not any(r["surface_label_needs_clip_review"] for r in words.values())
    assert rows(vocabulary.counts(vocabulary.build_words(source))) == [{"entries": 4, "tagged": 4, "review": 0}]
    built = pipelines.build_vocabulary(source, readers.dictionary_entries(spark.createDataFrame([("你好 你好 [ni3 hao3] /hello/",)], "value string")), ["ni", "hao", "ma"])
    by = {r["id"]: r for r in rows(built)}
    assert by["L1-0001"]["definition"] == "hello" and by["L1-0001"]["pinyin_syllables"] == ["ni", "hao"] and by["L2-0044"]["definition"] == ""


def test_syllable_vocabulary(spark):
    names = spark.createDataFrame([("cmn-ma1.mp3",), ("cmn-_jv4.mp3",), ("x.mp3",)], "name string")
    assert vocabulary.syllable_vocabulary(names, 3) == ["ju", "ma", "r"]
    with pytest.raises(ValueError):
        vocabulary.syllable_vocabulary(names)


def test_json_sources_and_sinks(spark, tmp_path):
    array = write(tmp_path / "a.json", json.dumps([{"word": "x", "quiz_eligible": False}, {"word": "y"}]))
    assert [r["quiz_eligible"] for r in rows(readers.read_json_array(spark, array, schemas.RECORDINGS))] == [False, None]
    mapped = write(tmp_path / "m.json", json.dumps({"ma2": {"audio_path": "p", "source": "s"}}))
    assert rows(readers.read_json_map(spark, mapped, schemas.PUBLIC)) == [{"key": "ma2", "audio_path": "p", "source": "s", "license": None, "source_url": None}]
    assert rows(readers.read_json_map(spark, write(tmp_path / "d.json", '{"a": "b"}'), "string")) == [{"key": "a", "value": "b"}]
    quality = write(tmp_path / "q.json", json.dumps({"audio_cmn": {"ma2": {"status": "bad", "replacement": None}}}))
    assert rows(readers.read_quality(spark, quality))[0]["status"] == "bad"
    log = write(tmp_path / "log.jsonl", '{"audio_path": "a"}\nbroken\n{"word": "x"}\n')
    assert [r["audio_path"] for r in rows(readers.read_log(spark, log, schemas.NATIVE_AUDIT))] == ["a"]
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST"):
        readers.read_log(spark, log, schemas.NATIVE_AUDIT, strict=True).collect()
    df = spark.createDataFrame([("b", ["x", "y"], True, None), ("a", [], False, "é")], "id string, tags array<string>, ok boolean, n string")
    sinks.write_document(df, str(tmp_path / "doc"), ["id"])
    assert json.loads("".join(p.read_text() for p in (tmp_path / "doc").glob("part-*"))) == [{"id": "a", "tags": [], "ok": False, "n": "é"}, {"id": "b", "tags": ["x", "y"], "ok": True, "n": None}]
    assert rows(sinks.delimited(df))[0] == {"id": "b", "tags": "x;y", "ok": "True", "n": None}
    sinks.write_json(df, str(tmp_path / "out"))
    sinks.append_log(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 4
    sinks.write_json(spark.read.json(str(tmp_path / "out")).where("ok"), str(tmp_path / "out"))  # a table may replace itself
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    with pytest.raises(Exception, match="no luck"):
        sinks.write_json(df.select(F.raise_error(F.lit("no luck")).alias("x")), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2 and [p.name for p in tmp_path.iterdir() if p.name.startswith("out")] == ["out"]
    sinks.write_csv(df, str(tmp_path / "csv"), ("tags", "id"))
    assert next(iter((tmp_path / "csv").glob("part-*"))).read_bytes().startswith(b"\xef\xbb\xbftags,id\n")
    assert {r["tags"] for r in rows(readers.read_csv(spark, str(tmp_path / "csv")))} == {"x;y", None}
    write(tmp_path / "audio/s/a.mp3", "abc")
    plan = sinks.copy_plan(spark.createDataFrame([("audio/s/a.mp3",)], "audio_path string"), spark.createDataFrame([("audio/s/a.mp3", 3)], "path string, length long"), str(tmp_path / "www"))
    assert [r["copied"] for r in rows(sinks.copy_files(plan, str(tmp_path)))] == [3] and (tmp_path / "www/audio/s/a.mp3").read_text() == "abc"
    recordings = spark.createDataFrame([("p", "w", "s", None, True)], "audio_path string, word string, source string, license string, quiz_eligible boolean")
    sinks.write_sidecars(recordings, str(tmp_path / "meta"))
    assert rows(spark.read.parquet(str(tmp_path / "meta"))) == [{"audio_path": "p", "sidecar": '{"source":"s","license":null}'}]
    sinks.gate(df.limit(0), "none")
    with pytest.raises(ValueError):
        sinks.gate(df, "some")


def test_dictionary_gzip(spark, tmp_path):
    import gzip

    path = write(tmp_path / "d.txt.gz", gzip.compress("# c\n新 新 [xin1] /new/newly/\n".encode()))
    assert rows(readers.read_dictionary(spark, path)) == [{"simplified": "新", "traditional": "新", "pinyin": "xin1", "definitions": ["new", "newly"], "reading": ["xin1"]}]


def test_tree_listing_and_archive(spark):
    listing = spark.createDataFrame([([("a/cmn-x.mp3", "blob", 1), ("b/cmn-y.mp3", "blob", 2), ("a/z.txt", "blob", 3)], False)], schemas.TREE)
    assert [r["name"] for r in rows(readers.tree_paths(listing, "a/cmn-", ".mp3"))] == ["x"]
    with pytest.raises(Exception, match="truncated"):
        readers.tree_paths(listing.withColumn("truncated", F.lit(True)), "a/", ".mp3").collect()
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name in ("c/mp3/ma2.mp3", "c/mp3/tian3.mp3", "c/README.md", "c/other/ma1.mp3", "c/mp3/ma5.mp3"):
            z.writestr(name, b"ID3x")
    archive = spark.createDataFrame([("a.zip", bytearray(buffer.getvalue()))], "path string, content binary")
    assert [r["key"] for r in rows(readers.archive_members(archive))] == ["ma2", "tian3"]
    with pytest.raises(Exception, match="members"):
        readers.archive_members(archive, at_least=3).collect()


def test_members_of_archives_are_handed_on_many_at_a_time():
    """Neither a table for each file nor all of an archive at once; every file once, in order."""

    class Plan:
        select = lambda self, *columns: self
        mapInPandas = lambda self, run, schema: run

    def packed(sizes):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            z.writestr("d/", "")
            for i, n in enumerate(sizes):
                z.writestr(f"d/{i}", bytes([i % 251]) * n)
        return buffer.getvalue()

    small, large = packed([3] * 2500), packed([3 << 20, 3 << 20, 9 << 20, 1])
    broken = bytearray(packed([50]))
    broken[broken.index(bytes(50)) + 7] = 1
    archives = pd.DataFrame({"path": ["s", "l", "b", "none"], "content": [small, large, bytes(broken), packed([])]})
    got = list(readers.archive_entries(Plan())(iter([archives.iloc[:1], archives.iloc[1:]])))
    assert len(got) <= 6 and max(map(len, got)) <= readers.MEMBERS
    assert max(sum(map(len, g["content"][:-1])) for g in got) < readers.MEMBER_BYTES
    whole = pd.concat(got)
    assert list(zip(whole["archive"], whole["place"])) == [(a, i + 1) for a, n in (("s", 2500), ("l", 4), ("b", 1)) for i in range(n)]
    assert list(whole["sound"]) == [True] * 2504 + [False] and all(c == bytes([i % 251]) * 3 for i, c in enumerate(whole["content"][:2500]))


def test_import(spark, tmp_path):
    for name, data in {"s/公司/a.MP3": b"1", "s/公司/a.json": b'{"speaker": null, "rate": 3, "notes": null}', "s/公司/b.wav": b"2", "s/公司/b.json": b"broken", "s/公司/c.txt": b""}.items():
        write(tmp_path / name, data)
    tree = readers.audio_tree(readers.read_files(spark, str(tmp_path), recursive=True))
    known = spark.createDataFrame([], schemas.RECORDINGS)
    got = {r["filename"]: r for r in rows(ingest.index_recordings(tree, known))}
    assert set(got) == {"a.MP3", "b.wav"}
    assert got["a.MP3"]["speaker"] is None and got["a.MP3"]["rate"] == "3" and got["a.MP3"]["notes"] is None and got["a.MP3"]["language_code"] == "zh"
    assert got["b.wav"]["speaker"] == "b" and got["b.wav"]["notes"] == "" and got["b.wav"]["audio_path"] == "audio/s/公司/b.wav"
    held = ingest.recordings_of(tree).where("filename = 'b.wav'").withColumn("notes", F.lit("mine"))
    assert {r["filename"]: r["notes"] for r in rows(ingest.index_recordings(tree, held))} == {"a.MP3": None, "b.wav": "mine"}


def test_context(spark):
    sentences = spark.createDataFrame([("c1", "p1", "我在公司工作", None, None, "", "north", "zh"), ("c2", None, "没有", None, None, "x", None, "zh"), ("c3", "p", None, None, None, None, None, None)], schemas.COMMON_VOICE)
    words = spark.createDataFrame([("公司",), ("公",), ("工作",), ("",), ("没",), ("公司",)], "word string")
    got = sorted((r["word"], r["audio_path"], r["accent"]) for r in rows(ingest.context_clips(sentences, words, "clips/")))
    assert got == [("公", "clips/p1", "north"), ("公司", "clips/p1", "north"), ("工作", "clips/p1", "north"), ("没", "clips/", "x")]
    ordered = spark.createDataFrame([("工作", 3), ("公", 1), ("公司", 4), ("", 0), ("没", 0), ("工作", 9)], "word string, n int")
    assert [r["word"] for r in rows(ingest.longest_first(ordered, "n"))] == ["工作", "公司", "没", "公"]


@pytest.mark.parametrize("few", [100_000, 0])
def test_contained_is_all_pairs(spark, monkeypatch, few):
    """By either way, few needles or many: every pair of rows once, texts and needles that are equal apart."""
    monkeypatch.setattr(ingest, "FEW", few)
    chance = random.Random(few)
    some = lambda n: "".join(chance.choice("ab公𠀀 .") for _ in range(n))
    texts = [(i, some(i % 13)) for i in range(150)] + [(150, None), (151, ""), (152, "ab" * 40), (153, "ab" * 40)]
    needles = [(i, some(i % 8)) for i in range(90)] + [(90, None), (91, ""), (92, "ab"), (93, "ab"), (94, "b"), (95, "[a")]
    got = ingest.contained(spark.createDataFrame(texts, "i int, t string"), "t", spark.createDataFrame(needles, "k int, n string"), "n")
    assert sorted(got.columns) == ["i", "k", "n", "t"]
    assert sorted((r["i"], r["k"]) for r in rows(got)) == sorted((i, k) for i, t in texts for k, n in needles if t and n and n in t)


def test_few_needles_go_to_the_texts(spark):
    """Texts stay where they are, and a long one takes time in proportion to its characters."""
    texts = spark.createDataFrame([(1, "公ab." * 60_000 + "end")], "i int, t string").repartition(2)
    texts.count()
    got = ingest.contained(texts, "t", spark.createDataFrame([("end",), ("b",), ("none",)], "n string").repartition(2), "n").select("i", "n")
    began = time.perf_counter()
    assert sorted(r["n"] for r in rows(got)) == ["b", "end"]
    assert time.perf_counter() - began < 30
    assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_contained_passages(spark):
    texts = spark.createDataFrame([(1, "xx one two  three four five six"), (2, "three four"), (3, None), (4, "one two three")], "i int, t string")
    needles = spark.createDataFrame([("a", "ne two  three four f"), ("b", "three"), ("c", ""), ("d", None)], "k string, n string")
    got = sorted((r["i"], r["k"]) for r in rows(ingest.contained_passages(texts, "t", needles, "n")))
    assert got == [(1, "a"), (1, "b"), (2, "b"), (4, "b")]


def test_resolver_cases(spark):
    public = spark.createDataFrame([(k, f"p/{k}.mp3", "public") for k in ("gai1", "ma2", "test3", "ao4")] + [("no1", "", "public")], "key string, audio_path string, source string")
    quality = spark.createDataFrame([("audio_cmn", "ma2", "bad", "pinyin_public", None, None), ("audio_cmn", "test3", "bad", None, None, None), ("audio_cmn", "mou3", "bad", "isolated_word", "w.mp3", None), ("pinyin_public", "ao4", "bad", "audio_cmn", None, None), (None, "old1", "bad", None, None, None)], policy.QUALITY)
    keys = spark.createDataFrame([(k,) for k in "ju4 r2 gai1 ma2 test3 mou3 ao4 no1 old1".split()], "key string")
    human = "audio/audio_cmn/syllabs/cmn-"
    default = {r["key"]: (r["audio_path"], r["enhanced"]) for r in rows(selection.select_recording(keys, quality, public))}
    assert default == {"ju4": (human + "jv4.mp3", False), "r2": (None, None), "gai1": ("p/gai1.mp3", True), "ma2": ("p/ma2.mp3", True), "test3": ("p/test3.mp3", True), "mou3": ("w.mp3", False), "ao4": (human + "ao4.mp3", False), "no1": (human + "no1.mp3", False), "old1": (None, None)}
    own = {r["key"]: r["audio_path"] for r in rows(selection.select_recording(keys, quality, public, "audio_cmn"))}
    assert own == {"ju4": human + "jv4.mp3", "r2": None, "gai1": human + "gai1.mp3", "ma2": "p/ma2.mp3", "test3": None, "mou3": "w.mp3", "ao4": human + "ao4.mp3", "no1": human + "no1.mp3", "old1": None}


def test_what_no_review_lets_through(spark):
    """A key without a usable recording is unavailable in both modes; one whose human recording is bad has no other but what the review names."""
    quality = spark.createDataFrame(policy.quality_rows(), policy.QUALITY)
    keys = spark.createDataFrame([(k,) for k in policy.keys()], "key string")
    public = spark.createDataFrame(policy.public_rows(), "key string, audio_path string, source string")
    gone = {m: {r["key"] for r in rows(selection.select_recording(keys, quality, public, m)) if r["audio_path"] is None} for m in ("audio_cmn", "pinyin_public")}
    assert {"ba3", "ba5", "ba11", "r1", "r3"} <= gone["pinyin_public"] and "ba4" not in gone["pinyin_public"] and "ba4" in gone["audio_cmn"] and "r2" not in gone["audio_cmn"]


def test_known_words(spark):
    tones = spark.createDataFrame([(i, d, m) for i, (d, m, _) in enumerate(cases.TONES)], "i int, d string, m string")
    assert [r["p"] for r in rows(tones.orderBy("i").select(pinyin.pattern(vocabulary.tones_of(F.col("d"), F.col("m"))).alias("p")))] == [t[2] for t in cases.TONES]
    words = spark.createDataFrame([(i, "", w, t) for i, (w, t, *_) in enumerate(cases.SANDHI)], "i int, id string, word string, lexical_tones array<int>")
    got = rows(vocabulary.with_surface(words).orderBy("i").select(pinyin.pattern(F.col("default_surface_tones")).alias("s"), F.array_join("sandhi_tags", ";").alias("t"), "surface_label_needs_clip_review"))
    assert [(r["s"], r["t"], r["surface_label_needs_clip_review"]) for r in got] == [(s, t, not a or "ambiguous" in t) for _, _, s, t, a in cases.SANDHI]
    own = spark.createDataFrame([("L1-0170", "妈妈", [1, 1])], "id string, word string, lexical_tones array<int>")
    assert [(r["default_surface_tones"], r["sandhi_tags"]) for r in rows(vocabulary.with_surface(own))] == [([1, 0], ["neutral_tone"])]
    words = spark.createDataFrame([r[:5] for r in cases.DEFINED], "id string, word string, traditional string, pinyin_syllables array<string>, lexical_tones array<int>")
    got = {r["id"]: r["definition"] for r in rows(vocabulary.add_definitions(words, readers.dictionary_entries(spark.createDataFrame([(e,) for e in cases.ENTRIES], "value string"))))}
    assert got == {r[0]: r[5] for r in cases.DEFINED if r[5]}


def widest(df):
    """Rows, and the most rows that any step of the plan that ran gave."""
    found, most, todo = rows(df), 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        todo += [node.finalPhysicalPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
        if node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
    return found, most


def test_definitions_of_a_common_word(spark):
    """A word with many entries meets none of them but the best; the answer is that of all pairs."""
    forms, readings = ("t", "u", "v"), ("ma1", "Ma1", "ma2")
    lines = [f"{forms[i * 7 % 3]} w [{readings[i * 5 % 9 // 3]}] /{'CL:x' if i % 4 == 0 else f'd{i * 37 % 101}'}/" for i in range(600)]
    lines += ["t x [Ma1] /only/", "t y [ma1] /CL:x/", "t z [ma1] /CL:x/", "t z [ma1] /second/", "t  [ma1] /bad/"]
    words = [(str(i // 2), "wxyzq"[0 if i < 800 else i % 5], ("t", "s", "v", None)[i % 4], [["ma"], ["ma"], []][i % 3], [[1], [2], []][i % 3]) for i in range(900)]
    entries = readers.dictionary_entries(spark.createDataFrame([(x,) for x in lines], "value string"))
    held = [(e["simplified"], e["traditional"], e["pinyin"], e["reading"], "; ".join(d for d in e["definitions"] if d.strip() and not d.startswith("CL:"))) for e in rows(entries)]
    want = {}
    for key, word, form, syllables, tones in words:
        of_word = [e for e in held if e[0] == word]
        reading = [s + str(t) for s, t in zip(syllables, tones)]
        for _, f, p, r, text in of_word:
            if text and (r == reading if reading else len(of_word) == 1):
                want[key] = min(want.get(key, (99, "")), ((0 if f == form else 5) + (3 if p != p.lower() else 0), text))
    got, most = widest(vocabulary.add_definitions(spark.createDataFrame(words, "id string, word string, traditional string, pinyin_syllables array<string>, lexical_tones array<int>"), entries))
    assert {r["id"]: r["definition"] for r in got} == {k: v[1] for k, v in want.items()} and len(got) == len(want) > 300
    assert most <= 2 * len(words)


def test_grading_and_choice(spark):
    attempts = spark.createDataFrame([("1-2", "1-2"), ("1-3", "1-2"), ("1", "1-2")], "selected_pattern string, correct_pattern string")
    got = selection.grade(attempts)
    assert [(r["correct"], r["marks"]) for r in rows(got)] == [(True, [True, True]), (False, [True, False]), (False, [True, False])]
    assert rows(selection.progress(got)) == [{"attempts": 3, "correct": 1, "percent": 33}]
    assert rows(selection.progress(got.limit(0))) == [{"attempts": 0, "correct": 0, "percent": None}]
    assert rows(selection.choose(attempts, 5)) == rows(selection.choose(attempts.repartition(3), 5))


def test_duplicates(spark):
    files = spark.createDataFrame([("s", "a", "h"), ("s", "b", "h"), ("s", "c", "i"), ("t", "a", "h"), ("s", "d", "j"), ("s", "e", "j")], "source string, key string, payload string")
    quality = spark.createDataFrame([("s", "a", "bad"), ("s", "d", "good")], "source string, key string, status string")
    got = {tuple(r["keys"]): r["status"] for r in rows(audits.duplicate_groups(files, quality))}
    assert got == {("a", "b"): "quarantined", ("d", "e"): "unquarantined"}


def test_tone_audit(spark):
    fall, flat = [4.0 - i for i in range(9)], [0.1] * 9
    tracks = [("s", k, m, p) for k, p in {"ma2": fall, "ma4": flat, "ma3": fall, "li4": fall, "x": fall}.items() for m in ("pyin", "praat", "world")]
    tracks += [("s", "ta2", "pyin", fall), ("s", "ta2", "praat", None), ("s", "ta2", "world", fall), ("s", "da2", "pyin", flat), ("s", "da2", "praat", fall), ("s", "da2", "world", flat)]
    required = spark.createDataFrame([("ma2",)], "key string")
    quality = spark.createDataFrame([("s", "ma4", "bad")], "source string, key string, status string")
    got = {r["key"]: (r["reason"], r["required"], r["quarantined"]) for r in rows(audits.tone_flags(spark.createDataFrame(tracks, "source string, key string, method string, points array<double>"), required, quality))}
    assert got == {"ma2": ("falling tone 2", True, False), "ma4": ("flat tone-1-like tone 4", False, True)}


def test_transcripts(spark):
    data = [(["ke2"], "", "壳"), (["ke3"], "", "壳"), (["hai1"], "", "壳"), ([], "", "壳"), (["x"], "壳。", "壳")]
    df = spark.createDataFrame(data, "r array<string>, t string, w string")
    expected = F.array(F.array(F.lit("ke2")))
    assert [r["s"] for r in rows(df.select(audits.native_status(F.col("r"), expected, F.col("t"), F.col("w")).alias("s")))] == ["exact", "base_match", "review", "unrecognized", "text_match"]
    df = spark.createDataFrame([(["zhen"],), (["zheng"],), ([],), (None,)], "r array<string>")
    assert [r["s"] for r in rows(df.select(audits.identity_status(F.lit("zhen"), F.col("r")).alias("s")))] == ["match", "review", "unrecognized", "unrecognized"]


def test_shards_cover_all_rows_in_order(spark):
    df = spark.createDataFrame([(f"k{i % 700:04d}", i) for i in range(1000)] + [(None, -1)], "k string, i int")
    places = sorted((r["_place"], r["k"] or "", r["i"]) for r in rows(audits.numbered(df, ["k", "i"])))
    assert [p[0] for p in places] == list(range(1001)) and [p[1:] for p in places] == sorted(p[1:] for p in places)
    parts = [rows(audits.take_shard(df, i, 3, ["k", "i"])) for i in range(3)]
    assert sum(map(len, parts)) == 1001
    with pytest.raises(ValueError):
        audits.take_shard(df, 3, 3, ["k"])


def test_native_audit(spark):
    words = spark.createDataFrame([("壳", ["ke"], [2]), ("壳", ["qiao"], [4])], "word string, pinyin_syllables array<string>, lexical_tones array<int>")
    recordings = spark.createDataFrame([(p, "壳", "audio_cmn", "isolated_word") for p in ("a", "b", "c")] + [("d", "无", "audio_cmn", "isolated_word"), ("e", "壳", "other", "isolated_word"), ("f", "壳", "audio_cmn", None)], "audio_path string, word string, source string, recording_type string")
    transcripts = spark.createDataFrame([(p, "", ["qiao4"]) for p in "abcde"], "audio_path string, transcript string, recognized_pinyin array<string>")
    done = spark.createDataFrame([("a",)], "audio_path string")
    got = rows(pipelines.native_audit(recordings, words, transcripts, done, "m"))
    assert sorted((r["audio_path"], r["status"]) for r in got) == [("b", "exact"), ("c", "exact")]
    logs = audits.merge_shards(done, done.union(spark.createDataFrame([("z",)], "audio_path string")))
    assert logs.count() == 2


def test_confirm_families_and_inventory(spark):
    reviews = spark.createDataFrame([("a", "zhen", "review"), ("b", "x", "match")], "audio_path string, base string, status string")
    second = spark.createDataFrame([("a", "t", ["zhen"])], "audio_path string, transcript string, bases array<string>")
    assert [(r["audio_path"], r["paraformer_status"]) for r in rows(audits.confirm(reviews, second))] == [("a", "match")]
    files = spark.createDataFrame([("s", "ma1", "p1"), ("s", "ma2", "p2"), ("s", "x", "p")], "source string, key string, path string")
    assert rows(audits.family_paths(files)) == [{"source": "s", "base": "ma", "paths": {"1": "p1", "2": "p2"}}]
    words = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "id string, word string")
    responses = spark.createDataFrame([("a", [("x",)], None), ("b", None, "down")], "word string, items array<struct<id:string>>, error string")
    assert [(r["hsk_id"], r["count"], r["error"]) for r in rows(ingest.inventory(words, responses).orderBy("hsk_id"))] == [("1", 1, None), ("2", 0, "down"), ("3", 0, None)]
    assert [r["id"] for r in rows(ingest.page(words, ["id"], 1, 1))] == ["2"] and ingest.page(words, ["id"], 0, 0).count() == 3
    assert ingest.speech_requests(words, spark.createDataFrame([("v",), ("w",)], "voice string")).count() == 6


def test_bundle(spark):
    paths = spark.createDataFrame([("a/b",), ("a/../../x",), ("/etc",), ("a/../b",)], "audio_path string")
    assert sorted(r["audio_path"] for r in rows(bundle.unsafe_paths(paths))) == ["/etc", "a/../../x"]
    files = spark.createDataFrame([("a/b", 3), ("a/../b", 0)], "audio_path string, length long")
    assert bundle.missing(paths, files).count() == 3
    assert rows(bundle.totals(paths, files)) == [{"files": 2, "bytes": 3}]
    left, right = (spark.createDataFrame([(x,) for x in v], "k int") for v in ([1, 2, 2], [2, 3]))
    assert sorted((r["k"], r["side"]) for r in rows(bundle.differing(left, right))) == [(1, "left"), (3, "right")]
    recordings = spark.createDataFrame([("audio_cmn", "a", "isolated_word"), ("audio_cmn", "b", None)], "source string, audio_path string, recording_type string")
    content = spark.createDataFrame([("a", 4, bytearray(b"ID3x")), ("p", 1, bytearray(b"x"))], "audio_path string, length long, content binary")
    public = spark.createDataFrame([("ma1", "p", "x")], "key string, audio_path string, source string")
    words, quality = spark.createDataFrame([(["r", "ma"],)], "pinyin_syllables array<string>"), spark.createDataFrame([], policy.QUALITY)
    samples = spark.createDataFrame([("a", "wrong")], "audio_path string, sha256 string")
    got = {r["check"]: r["ok"] for r in rows(bundle.setup_checks(recordings, public, content, {"recordings": 1, "syllables": 2, "public": 1}, samples, words, quality, content.select("audio_path"), ("r1", "r2", "r3", "r4")))}
    assert got.pop("pinyin_public: unavailable") and got.pop("audio_cmn: unavailable")
    assert got == {"recordings": True, "recordings exist": False, "recordings are MPEG audio": True, "syllables": True, "syllables are MPEG audio": False, "public": True, "public exist": True, "public are MPEG audio": False, "samples": False, "pinyin_public: selected exist": False, "audio_cmn: selected exist": False}


def test_history(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([None, None, "a", "a", "b"])] + [(2, 0, "a")], "u int, t int, v string")
    got = [(r["u"], r["run_length"], r["run_last"]) for r in rows(history.with_runs(df, ["u"], ["t"], "v").orderBy("u", "t"))]
    assert got == [(1, 2, False), (1, 2, True), (1, 2, False), (1, 2, True), (1, 1, True), (2, 1, True)]
    assert history.latest(df, ["u"], [F.col("t").desc()], 2).count() == 3
    assert [r["v"] for r in rows(history.resident(df.where("v is not null"), "v", ["t", "u"], 1))] == ["b"]


def test_streams(spark, tmp_path):
    write(tmp_path / "in/1.json", '{"audio_path": "a"}\n{"audio_path": "b"}\n{"audio_path": "b"}\n')
    done = spark.createDataFrame([("a",)], "audio_path string")
    log, checkpoint = f"file://{tmp_path}/log", f"file://{tmp_path}/checkpoint"

    def run():
        source = jobs.read_stream(spark, str(tmp_path / "in"), "audio_path string")
        jobs.resumable(source, lambda d: d.withColumn("status", F.lit("exact")), log, checkpoint, done).awaitTermination()
        return sorted(r["audio_path"] for r in rows(readers.read_log(spark, log, "audio_path string")))

    assert run() == ["b"]
    write(tmp_path / "in/2.json", '{"audio_path": "b"}\n{"audio_path": "c"}\n')
    assert run() == ["b", "c"]
    attempts = write(tmp_path / "attempts/1.json", '{"word": "x", "correct": true}\n{"word": "x", "correct": false}\n')
    jobs.running_progress(jobs.attempts_stream(spark, attempts.rsplit("/", 1)[0]), "totals").awaitTermination()
    assert rows(spark.table("totals")) == [{"attempts": 2, "correct": 1}]
    for i in (1, 2):
        write(tmp_path / f"rec/{i}.json", json.dumps({"source": "s", "word": "w", "filename": "f"}) + "\n")
        jobs.new_recordings(jobs.read_stream(spark, str(tmp_path / "rec"), schemas.RECORDINGS), str(tmp_path / "recs"), str(tmp_path / "ck2")).awaitTermination()
    assert spark.read.json(str(tmp_path / "recs")).count() == 1


def test_next_question(spark):
    words = spark.createDataFrame([("w1", "妈", "mā", [1], "1", "1", False, ["ma"], [])], "id string, word string, pinyin string, lexical_tones array<int>, lexical_pattern string, default_surface_pattern string, surface_label_needs_clip_review boolean, pinyin_syllables array<string>, sandhi_tags array<string>")
    recordings = spark.createDataFrame([("a", "妈", "audio_cmn", None, None, None, "zh")], "audio_path string, word string, source string, hsk_id string, surface_pattern string, quiz_eligible boolean, language_code string")
    none = spark.createDataFrame([], policy.QUALITY)
    public = spark.createDataFrame([], "key string, audio_path string, source string")
    assert rows(pipelines.next_question(words, recordings, none, public, 1)) == [{"id": "w1", "word": "妈", "pinyin": "mā", "audio_path": "a", "correct_pattern": "1"}]
    assert pipelines.next_question(words, recordings, none, public, 1, "two").count() == 0
    assert pipelines.next_question(words, recordings, none, public, 1, "one", True).count() == 0
