"""Contents behind addresses: each row asks a server, with patience, and what goes wrong is a row too."""

from __future__ import annotations

import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed

#: Longest pauses in seconds where a server answers with an error, and where it doesn't answer.
LONGEST_BUSY, LONGEST_SILENT = 60, 30
#: Fields of a pronunciation that an inventory keeps.
ITEM = "id string, word string, original string, addtime string, hits string, username string, sex string, country string, code string, langname string, rate string, num_votes string, pathmp3 string, pathogg string"


def pause(attempt: int, longest: float, asked: str | None = None) -> float:
    """Seconds before the next attempt: what the server asked for, else twice as long each time with some chance in it."""
    try:
        return float(asked)
    except (TypeError, ValueError):
        return min(longest, 2**attempt + random.random())


def ask(address: str, accept: Callable[[bytes], str | None], retries: int, timeout: float, wait: Callable[[float], None] = time.sleep) -> tuple[str, bytes | None]:
    """The outcome (downloaded, missing, or failed with a reason) and the content. ``accept`` says what is wrong with a content, or nothing."""
    for attempt in range(retries + 1):
        longest, asked = LONGEST_SILENT, None
        try:
            with urllib.request.urlopen(urllib.request.Request(address, headers={"User-Agent": "cadenza/1"}), timeout=timeout) as answer:
                content = answer.read()
            wrong = accept(content)
            if not wrong:
                return "downloaded", content
        except urllib.error.HTTPError as e:
            if e.code == 404:
                return "missing", None
            wrong, longest, asked = str(e), LONGEST_BUSY, e.headers.get("Retry-After")
        except (OSError, ValueError) as e:
            wrong = str(e)
        if attempt < retries:
            wait(pause(attempt, longest, asked))
    return f"failed: {wrong}", None


def fetched(rows: DataFrame, address: str = "url", audio: bool = True, retries: int = 6, timeout: float = 60, connections: int = 4) -> DataFrame:
    """Append outcome, content and length: what each row's address holds; as many tasks as ``connections`` ask at once.

    With ``audio``, a content that doesn't begin like MPEG audio counts as a failure and is asked for again. A null address is missing.
    """
    magic = tuple(bytes.fromhex(m) for m in fixed.MP3_MAGIC)
    accept = (lambda c: None if c.startswith(magic) else "the answer is no MPEG audio") if audio else (lambda c: None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(len(b)):  # a row at a time: contents may be large
                row = b.iloc[i : i + 1]
                found, content = ask(row[address].iloc[0], accept, retries, timeout) if row[address].iloc[0] else ("missing", None)
                yield row.assign(outcome=[found], content=[content], length=[len(content or b"")])

    schema = rows.schema.add("outcome", "string").add("content", "binary").add("length", "long")
    return rows.repartition(connections).mapInPandas(run, schema)


def responses(words: DataFrame, template: str, **options) -> DataFrame:
    """word, items, error: what a service answers for each distinct word. ``template`` is its address with {word} where the word goes, quoted."""
    asked = words.select("word").distinct().withColumn("url", F.replace(F.lit(template), F.lit("{word}"), F.replace(F.url_encode("word"), F.lit("+"), F.lit("%20"))))
    rows = fetched(asked, audio=False, **options)
    document = F.from_json(F.decode("content", "UTF-8"), f"items array<struct<{', '.join(f'{a}: {b}' for a, b in (x.split(' ') for x in ITEM.split(', ')))}>>")
    error = F.when(F.col("outcome") != "downloaded", F.col("outcome")).when(document.isNull() | F.try_parse_json(F.decode("content", "UTF-8")).isNull(), "the answer is no JSON")
    return rows.select("word", F.when(error.isNull(), document["items"]).alias("items"), error.alias("error"))
