"""Fixed values of the data domain: they decide results and are stated as they are."""

from __future__ import annotations

#: Vowels with each tone mark, first to fourth tone, and the plain vowels below them.
MARKED_VOWELS = ("āēīōūǖ", "áéíóúǘ", "ǎěǐǒǔǚ", "àèìòùǜ")
PLAIN_VOWELS = "aeiouv"

#: Lexical tones of entries whose source is wrong, by id.
TONE_OVERRIDES = {
    "L2-0044": [4, 1, 4, 0],
    "L2-0264": [4, 0],
    "L2-0722": [4, 2, 0],
    "L4-0788": [4, 4],
    "L4-0853": [3, 3],
    "L4-0897": [3, 4, 0],
    "L6-1079": [3, 0],
    "L7-0443": [4, 0],
    "L7-1743": [2, 0],
    "L7-2378": [2],
    "L7-2561": [2, 3, 0],
}
#: Pinyin of entries whose source is wrong, by id.
PINYIN_OVERRIDES = {
    "L3-0798": "xuè",
    "L4-0853": "yǎnlǐ",
    "L7-0552": "chūxuè",
    "L7-4508": "xiànxuè",
    "L7-4885": "yīhuǎng",
}
#: Surface tones of entries whose second syllable is lexically neutral, by id.
SURFACE_OVERRIDES = {
    "L1-0170": [1, 0],
    "L1-0375": [3, 0],
    "L4-0621": [4, 0, 4],
    "L4-0656": [3, 0],
    "L4-0785": [4, 0, 4],
    "L5-0003": [4, 0],
    "L7-0161": [3, 0, 4],
    "L7-1741": [2, 0],
    "L7-4273": [4, 0, 3],
}

#: Syllables that cost extra in a segmentation, and vowels that need a boundary before them.
RARE_SYLLABLES = ("m", "n", "ng", "hm", "hng", "nia")
BARE_VOWELS = "aeo"
BOUNDARY_MARKS = " -'’·"

#: Keys for which the first corpus has no recording, and the one key that it names differently.
UNAVAILABLE_KEYS = ("r1", "r2", "r3", "r4")
RENAMED_KEYS = {"ju4": "jv4"}
#: Keys for which no corpus has a usable recording.
UNAVAILABLE = ("r1", "r2", "r3", "r4", "rang1", "rui1")

#: First bytes of MPEG audio, and file endings of audio.
MP3_MAGIC = ("494433", "FFFB", "FFF3", "FFF2")
AUDIO_ENDINGS = ("mp3", "wav", "ogg", "m4a", "webm", "flac")

#: Loudness and silence parameters.
GAIN_RMS, GAIN_ACTIVE, GAIN_PEAK, GAIN_MOST = 0.16, 0.01, 0.90, 12.0
LEAD_SECONDS, GAP_SECONDS, TAIL_SECONDS = 0.12, 0.06, 0.20
