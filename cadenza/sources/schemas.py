"""Declared schemas of every entity; readers never infer."""

from __future__ import annotations

HSK_CSV = "ID string, Simplified string, Traditional string, Pinyin string, POS string, Level string, CEDICT string"
WORDS = (
    "id string, word string, traditional string, pinyin string, pos string, level string, lexical_tones array<int>, lexical_pattern string, "
    "default_surface_tones array<int>, default_surface_pattern string, sandhi_tags array<string>, surface_label_needs_clip_review boolean, "
    "forvo_url string, pinyin_syllables array<string>, definition string"
)
RECORDINGS = (
    "word string, source string, filename string, audio_path string, speaker string, sex string, country string, region string, rate string, "
    "surface_pattern string, source_url string, notes string, source_recording_id string, language_code string, language_status string, license string, "
    "recording_type string, hsk_id string, quiz_eligible boolean"
)
PUBLIC = "audio_path string, source string, license string, source_url string"
QUALITY = "status string, reason string, replacement string, replacement_audio_path string, replacement_source string"
COMMON_VOICE = "client_id string, path string, sentence string, age string, gender string, accents string, accent string, locale string"
CONTEXT = "word string, source string, kind string, audio_path string, sentence string, speaker string, age string, gender string, accent string, locale string"
NATIVE_AUDIT = "audio_path string, word string, expected array<array<string>>, transcript string, recognized_pinyin array<string>, status string, model string"
IDENTITY_AUDIT = "source string, key string, base string, audio_path string, transcript string, recognized_bases array<string>, status string, model string"
ATTEMPTS = "timestamp string, word string, pinyin string, selected_pattern string, correct_pattern string, correct boolean, source string, recording string"
TREE = "tree array<struct<path string, type string, size bigint>>, truncated boolean"
INVENTORY = "hsk_id string, word string, language string, count int, pronunciations array<struct<id string, word string, original string, addtime string, hits string, username string, sex string, country string, code string, langname string, rate string, num_votes string, pathmp3 string, pathogg string>>, error string"
