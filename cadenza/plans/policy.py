"""Reviews that show each rule of the choice between recordings. Invented; real ones are read by ``readers.read_quality``."""

from __future__ import annotations

QUALITY = "source string, key string, status string, replacement string, replacement_audio_path string, replacement_source string"

#: What becomes of a key, by the number at the end of its syllable.
RULES = {
    "plain": [],
    "human bad, public instead": [("audio_cmn", "bad", "pinyin_public", None, None)],
    "human bad, nothing instead": [("audio_cmn", "bad", None, None, None)],
    "human bad, a file instead": [("audio_cmn", "bad", "isolated_word", "audio/audio_cmn/words/{key}.mp3", "audio_cmn")],
    "public bad": [("pinyin_public", "bad", "audio_cmn", None, None)],
    "both bad": [("audio_cmn", "bad", "pinyin_public", None, None), ("pinyin_public", "bad", None, None, None)],
    "human good": [("audio_cmn", "good", None, None, None)],
}
SYLLABLES = ("ba", "pu", "mi")


def keys() -> list[str]:
    """Every rule with every syllable, in two public states, and the keys that the human corpus lacks or names otherwise."""
    return sorted([f"{s}{n}" for s in SYLLABLES for n in range(2 * len(RULES))] + ["ju4", "r1", "r2", "r3", "r4"])


def quality_rows() -> list[tuple]:
    """source, key, status, replacement, replacement_audio_path, replacement_source."""
    out = []
    for s in SYLLABLES:
        for n in range(2 * len(RULES)):
            for source, status, replacement, path, of in list(RULES.values())[n // 2]:
                out.append((source, f"{s}{n}", status, replacement, path and path.format(key=f"{s}{n}"), of))
    return out


def public_rows() -> list[tuple]:
    """key, audio_path, source: every second key has a public recording."""
    return [(k, f"audio/pinyin_public/{k}.mp3", "mp3_chinese_pinyin_sound") for k in keys() if k[-1] in "02468"]
