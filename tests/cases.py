"""Known cases of the rules, and some of our own."""

#: Words, lexical tones, and what follows from the rules: surface pattern, tags, aligned. The first two are known cases, the others ours.
SANDHI = [
    ("不一会儿", [4, 1, 4, 0], "4-2-4-N", "neutral_tone;yi_before_t4", True),
    ("妈妈", [1], "1", "", False),
    ("好不好", [3, 4, 3], "3-N-3", "bu_a_not_a", True),
    ("看一看", [4, 1, 4], "4-N-4", "yi_reduplication", True),
    ("不是", [4, 4], "2-4", "bu_before_t4", True),
    ("一天", [1, 1], "4-1", "yi_before_non_t4", True),
    ("第一次", [4, 1, 4], "4-1-4", "", True),
    ("统一", [3, 1], "3-1", "", True),
    ("你好", [3, 3], "2-3", "third_tone_sandhi", True),
    ("水产品", [3, 3, 3], "2-2-3", "third_tone_grouping_ambiguous;third_tone_sandhi", True),
    ("你好", [3, 3, 3, 1], "2-2-3-1", "third_tone_grouping_ambiguous;third_tone_sandhi", False),
    ("", [], "", "", True),
]
#: Pinyin, number of tones, syllables joined by spaces ('' where undecided). The first four are known cases, the others ours.
SEGMENTS = [
    ("kěnéng", 2, "ke neng"),
    ("fāng'àn", 2, "fang an"),
    ("hǎowánr", 3, "hao wan r"),
    ("yǒu(yī)xiē", 2, "you xie"),
    ("xī'ān", 2, "xi an"),
    ("", 1, ""),
    ("zzz", 1, ""),
    ("hǎo", 0, ""),
]
VOCABULARY = ["neng", "eng", "ken", "ke", "fang", "gan", "an", "fan", "hao", "wan", "r", "you", "yi", "xie", "xi", "xian"]
#: Dictionary text, marked pinyin, pattern. Ours.
TONES = [
    ("行 行 [xing2] /to walk/", "xíng", "2"),
    ("媽媽 妈妈 [ma1 ma5] /mum/", "", "1-N"),
    ("", "kěnéng", "3-2"),
    ("", "de", "N"),
    ("X [A a1]", "", "1"),
    ("", "Bà ba", "4-N"),
    ("", "", ""),
]
#: Dictionary lines and words with what they get. The first two words are known cases, the third is ours.
ENTRIES = ["新 新 [xin1] /new/newly/", "新 新 [Xin1] /abbr. for Xinjiang/surname Xin/", "行 行 [hang2] /row/line/", "# a comment", "", "龍 龙 [long2] / /CL:條|条[tiao2]/dragon/", "bad line"]
DEFINED = [("a", "新", "新", ["xin"], [1], "new; newly"), ("b", "行", "行", ["xing"], [2], None), ("c", "龙", "龙", None, [2], "dragon")]
