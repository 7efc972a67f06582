"""The command line on small files."""

import json

from cadenza.__main__ import COMMANDS, main


def put(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows), encoding="utf-8")
    return str(path)


def read(spark, path):
    return [r.asDict(True) for r in spark.read.json(path).collect()]


WORDS = [{"id": "w1", "word": "妈", "traditional": "媽", "pinyin": "mā", "lexical_tones": [1], "lexical_pattern": "1", "default_surface_pattern": "1", "sandhi_tags": [], "surface_label_needs_clip_review": False, "pinyin_syllables": ["ma"]}]


def test_vocabulary_and_definitions(spark, tmp_path):
    hsk, dictionary, sounds = tmp_path / "h.csv", tmp_path / "d.txt", tmp_path / "s"
    hsk.write_text("ID,Simplified,Traditional,Pinyin,POS,Level,CEDICT\nw1,妈,媽,mā,n,1,媽 妈 [ma1] /mum/\n", encoding="utf-8-sig")
    dictionary.write_text("媽 妈 [ma1] /mum/mother/\n", encoding="utf-8")
    sounds.mkdir()
    (sounds / "cmn-ma1.mp3").write_bytes(b"ID3x")
    out = str(tmp_path / "out")
    assert main(["build-vocabulary", "--hsk", str(hsk), "--dictionary", str(dictionary), "--syllables", str(sounds), "--at-least", "2", "--out", out]) == 0
    assert [(r["id"], r["definition"], r["pinyin_syllables"]) for r in read(spark, out)] == [("w1", "mum; mother", ["ma"])]
    assert main(["definitions", "--words", out, "--dictionary", str(dictionary), "--out", out + "2"]) == 0
    assert read(spark, out + "2") == [{"id": "w1", "definition": "mum; mother"}]


def test_selection_and_audits(spark, tmp_path):
    words, out = put(tmp_path / "w.json", WORDS), str(tmp_path / "out")
    quality, public = tmp_path / "q.json", tmp_path / "p.json"
    quality.write_text(json.dumps({"audio_cmn": {"ma2": {"status": "bad", "replacement": "pinyin_public"}}}))
    public.write_text(json.dumps({"ma2": {"audio_path": "p/ma2.mp3", "source": "public"}}))
    assert main(["select-recordings", "--words", words, "--quality", str(quality), "--public", str(public), "--preferred", "audio_cmn", "--out", out]) == 0
    assert {r["key"]: r["audio_path"] for r in read(spark, out)}["ma2"] == "p/ma2.mp3"
    recordings = put(tmp_path / "r.json", [{"word": "妈", "source": "audio_cmn", "audio_path": "a", "recording_type": "isolated_word"}])
    assert main(["practice-pool", "--words", words, "--recordings", recordings, "--quality", str(quality), "--public", str(public), "--out", out]) == 0
    assert [r["id"] for r in read(spark, out)] == ["w1"]
    transcripts = put(tmp_path / "t.json", [{"audio_path": "a", "transcript": "", "recognized_pinyin": ["ma1"], "recognized_bases": ["na"]}])
    assert main(["audit-readings", "--recordings", recordings, "--words", words, "--transcripts", transcripts, "--out", out, "--fail-on", "status=exact"]) == 1
    files = put(tmp_path / "f.json", [{"source": "s", "key": "ma1", "base": "ma", "audio_path": "a"}])
    assert main(["audit-identity", "--files", files, "--transcripts", transcripts, "--out", out]) == 0
    second = put(tmp_path / "2.json", [{"audio_path": "a", "transcript": "妈", "bases": ["ma"]}])
    assert main(["confirm-identity", "--log", out, "--second", second, "--out", out + "2"]) == 0
    assert [r["paraformer_status"] for r in read(spark, out + "2")] == ["match"]
    sounds = tmp_path / "s"
    sounds.mkdir()
    for k in ("ma1", "ma2", "li1"):
        (sounds / f"cmn-{k}.mp3").write_bytes(b"\xff\xfb" + k[:2].encode() * 10)
    assert main(["audit-duplicates", "--input", str(sounds), "--quality", str(quality), "--out", out, "--fail-on", "status=unquarantined"]) == 0
    assert [(r["keys"], r["status"]) for r in read(spark, out)] == [(["ma1", "ma2"], "quarantined")]
    tracks = put(tmp_path / "tr.json", [{"source": "s", "key": "ma2", "method": m, "f0": [400.0 - 5 * i for i in range(40)]} for m in ("pyin", "praat", "world")])
    assert main(["audit-tones", "--tracks", tracks, "--words", words, "--quality", str(quality), "--out", out]) == 0
    assert [(r["key"], r["reason"], r["required"]) for r in read(spark, out)] == [("ma2", "falling tone 2", True)]
    waves = put(tmp_path / "wv.json", [{"source": "s", "base": "ma", "tone": t, "samples": [0.0, 1.0, 0.5, -1.0, 0.2]} for t in (1, 4)])
    assert main(["audit-similarity", "--waves", waves, "--quality", str(quality), "--out", out]) == 0
    assert [(r["left_key"], r["right_key"]) for r in read(spark, out)] == [("ma1", "ma4")]


def test_ingest(spark, tmp_path):
    out = str(tmp_path / "out")
    folder = tmp_path / "imports" / "s" / "妈"
    folder.mkdir(parents=True)
    (folder / "a.mp3").write_bytes(b"x")
    assert main(["import-audio", "--imports", str(tmp_path / "imports"), "--out", out]) == 0
    assert [r["audio_path"] for r in read(spark, out)] == ["audio/s/妈/a.mp3"]
    tsv = tmp_path / "c.tsv"
    tsv.write_text("client_id\tpath\tsentence\tlocale\nc\tp.mp3\t妈妈好\tzh\n", encoding="utf-8")
    assert main(["context", "--tsv", str(tsv), "--words", put(tmp_path / "w.json", WORDS), "--clips", "clips", "--out", out]) == 0
    assert [(r["word"], r["audio_path"]) for r in read(spark, out)] == [("妈", "clips/p.mp3")]
    assert len(COMMANDS) == 12
