"""Documents with every awkward case: nulls, empty and long texts, repeats, and extra columns that clash with inner names."""

TEXTS = [
    "the cat sat on the mat and looked at the dog for a long while.\nA second line that is long enough to be shared by two.",
    "the cat sat on the mat and looked at the dog for a long while.\nA second line that is long enough to be shared by two.",
    "Another text altogether.\nA second line that is long enough to be shared by two.",
    "",
    None,
    "  \t\r\n\x0b ",
    "Ünïcödé 漢字 🎉 don't it's x y \u0085 z",
    "one",
    "two words",
    "long " * 40_000 + "end",
    "nul \x00 byte",
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, key string, code long, ids string, score double, label int, block int, component_id long, rank long, count long"


def documents(spark, texts=TEXTS, repeat=True):
    rows = [(i, t, "en" if i % 2 else None, f"src{i % 3}" if i % 4 else None, i, "k", 1, "x", 0.5, 1, 2, 3, 4, 5) for i, t in enumerate(texts)]
    if repeat:
        rows += [rows[0], rows[3], (None, "no id", *rows[0][2:])]
    return spark.createDataFrame(rows, COLUMNS)


def empty(spark):
    return spark.createDataFrame([], COLUMNS)
