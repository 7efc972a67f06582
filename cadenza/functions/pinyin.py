"""Column functions on pinyin, dictionary readings and tone patterns; all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

_MARKS = "".join(fixed.MARKED_VOWELS)
_TONES = "".join(str(t) * len(v) for t, v in enumerate(fixed.MARKED_VOWELS, 1))
_ALL_MARKS = _MARKS + _MARKS.upper()


def strip(x: Column) -> Column:
    """Trim all Unicode white space, not only blanks."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def falls_through(*xs: Column) -> Column:
    """The first value that is neither null nor empty; else null."""
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in xs])


def first_alternative(x: Column) -> Column:
    """What stands before the first bar, trimmed; null as empty."""
    return strip(F.split(F.coalesce(x, F.lit("")), r"\|")[0])


def cedict_tones(x: Column) -> Column:
    """Tones of a dictionary entry's first bracket: each token's last digit, 5 as 0; tokens without one are skipped."""
    inside = F.regexp_extract(F.coalesce(x, F.lit("")), r"\[([^\]]+)\]", 1)
    digits = F.transform(F.split(strip(inside), r"(?U)\s+"), lambda t: F.regexp_extract(t, r"([1-5])$", 1))
    return F.transform(F.filter(digits, lambda d: d != ""), lambda d: F.when(d == "5", 0).otherwise(d.try_cast("int")))


def accent_tones(x: Column) -> Column:
    """Tones of marked pinyin: the marks of every chunk; an unmarked chunk of Latin letters is one neutral tone."""
    chunks = F.filter(F.split(strip(F.coalesce(x, F.lit(""))), r"(?U)[\s·\-]+"), lambda c: c != "")

    def tones(chunk: Column) -> Column:
        marks = F.regexp_extract_all(chunk, F.lit(f"([{_ALL_MARKS}])"), 1)
        found = F.transform(marks, lambda m: F.translate(m, _ALL_MARKS, _TONES * 2).cast("int"))
        plain = F.when(chunk.rlike(r"^[A-Za-züÜvV]+$"), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
        return F.when(F.size(marks) > 0, found).otherwise(plain)

    return F.flatten(F.transform(chunks, tones))


def cjk_chars(x: Column) -> Column:
    """The Han characters from U+3400 to U+9FFF, in order."""
    return F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"([\x{3400}-\x{9fff}])"), 1)


def pattern(tones: Column) -> Column:
    """Tones joined by hyphens, 0 as N; empty or null as ''."""
    return F.coalesce(F.array_join(F.transform(tones, lambda t: F.when(t == 0, "N").otherwise(t.cast("string"))), "-"), F.lit(""))


def plain(x: Column) -> Column:
    """Lower case without tone marks, ü as v, letters only."""
    lower = F.translate(F.replace(F.lower(x), F.lit("ü"), F.lit("v")), _MARKS, fixed.PLAIN_VOWELS * 4)
    return F.regexp_replace(lower, "[^a-zv]", "")


def normalize_reading(x: Column) -> Column:
    """Numbered pinyin as syllables: u: and ü as v, lower case, what isn't letters and a tone left out. 'U:' is not known."""
    clean = F.lower(F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit("u:"), F.lit("v")), F.lit("ü"), F.lit("v")))
    return F.filter(F.split(strip(clean), r"(?U)\s+"), lambda t: t.rlike("^[a-zv]+[1-5]$"))


def expected_reading(syllables: Column, tones: Column) -> Column:
    """Syllables with their tones, 0 as 5, as far as the shorter of the two goes; null arrays as empty."""
    s, t = F.coalesce(syllables, F.array().cast("array<string>")), F.coalesce(tones, F.array().cast("array<int>"))
    n = F.least(F.size(s), F.size(t))
    return F.zip_with(F.slice(s, F.lit(1), n), F.slice(t, F.lit(1), n), lambda a, b: F.concat(F.replace(a, F.lit("ü"), F.lit("v")), F.when(b == 0, "5").otherwise(b.cast("string"))))


def clean_definitions(values: Column) -> Column:
    """The first four definitions that are not blank and name no classifier."""
    return F.slice(F.filter(F.transform(values, strip), lambda v: (v != "") & ~v.startswith("CL:")), 1, 4)


def correction_key(syllable: Column, tone: Column) -> Column:
    return F.concat(F.replace(F.lower(syllable), F.lit("ü"), F.lit("v")), tone.cast("string"))


def safe_word(x: Column) -> Column:
    """Slashes as their full-width forms, for file names."""
    return F.translate(x, "/\\", "／＼")


def source_name(x: Column) -> Column:
    return F.when(x == "audio_cmn", "audio-cmn").when(x == "mp3_chinese_pinyin_sound", "public pinyin").otherwise(x)


def audio_url(path: Column) -> Column:
    """Where a page one folder down finds a recording; '' without a path."""
    known = F.coalesce(path, F.lit(""))
    return F.when(known.startswith("audio/"), F.concat(F.lit("../"), known)).otherwise(known)


def escape_html(x: Column) -> Column:
    out = F.coalesce(x.cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def expected_pattern(surface: Column, lexical: Column) -> Column:
    return falls_through(surface, lexical)


def reading_key(pinyin: Column, syllables: Column, lexical_pattern: Column) -> Column:
    """What tells readings of a word apart."""
    return F.concat_ws("|", F.coalesce(pinyin, F.lit("")), F.coalesce(F.array_join(syllables, "+"), F.lit("")), F.coalesce(lexical_pattern, F.lit("")))


def normalized_syllables(values: Column) -> Column:
    """Recognised syllables, lower case, ü as v, with a tone or without; anything else is left out."""
    clean = F.transform(values, lambda v: F.lower(strip(v)))
    return F.transform(F.filter(clean, lambda v: v.rlike("^[a-züv]+[1-5]?$")), lambda v: F.replace(v, F.lit("ü"), F.lit("v")))


def bases(values: Column) -> Column:
    return F.transform(values, lambda v: F.regexp_replace(v, "[1-5]$", ""))


def normalized_text(x: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(x, F.lit("")), r"[^\x{3400}-\x{9fff}A-Za-z0-9]+", ""))
