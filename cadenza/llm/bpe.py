"""Byte-level BPE with the tokenizers library, piece by piece with a bounded memo.

The split pattern cuts a text into pieces that are merged independently, and most pieces of a text have
been met before. A worker therefore keeps the ids of the pieces that it has seen (at most ``MEMO`` or as many as it is told,
then it starts afresh) and gives only new ones to the library. The ids are those of encoding the whole
text in one call.
"""

from __future__ import annotations

import base64
import itertools
import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a Spark worker has one core

import numpy as np  # noqa: E402
import regex  # noqa: E402
from tokenizers import Tokenizer, models, pre_tokenizers  # noqa: E402

#: Most pieces that a worker remembers (about 200 bytes each).
MEMO = 500_000
#: Longest piece, in characters, that is remembered.
MEMO_PIECE = 64
#: Texts, and characters, whose pieces are looked up together; pieces of a longer text go in runs of so many.
TEXTS, CHARS, RUN = 64, 500_000, 100_000
#: Characters for which the standard library's patterns serve: Latin letters with all their forms.
LATIN = 0x250


def byte_chars() -> list[str]:
    """The printable character that stands for each byte: itself where it is visible Latin-1, else 256 and up, in order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    table = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


def to_chars(token: bytes) -> str:
    table = byte_chars()
    return "".join(table[b] for b in token)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def tokenizer_from_ranks(ranks: dict[bytes, int]) -> Tokenizer:
    """A tokenizers BPE model with the merges that a rank file implies.

    A rank file merges any two neighbours whose union has a rank, lowest rank first, and takes a piece
    that has a rank whole. As merges: every cut of every token into two tokens, by the token's rank.
    """
    table = byte_chars()
    chars = {t: "".join(table[b] for b in t) for t in ranks}
    merges = [
        (chars[token[:i]], chars[token[i:]])
        for token, _ in sorted(ranks.items(), key=lambda kv: kv[1])
        for i in range(1, len(token))
        if token[:i] in ranks and token[i:] in ranks
    ]
    out = Tokenizer(models.BPE(vocab={chars[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    out.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return out


def tokenizer_from_json(path: str) -> Tokenizer:
    """A byte-level tokenizer of a JSON file, for single pieces: strings of special tokens are ordinary text."""
    out = Tokenizer.from_file(path)
    out.encode_special_tokens = True
    out.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return out


def token_table(tokenizer: Tokenizer) -> list[bytes]:
    """The bytes of each id: the byte table reversed. Ids without a token, and special tokens' strings, as they are."""
    back = {c: b for b, c in enumerate(byte_chars())}
    out = [b""] * (max(tokenizer.get_vocab(True).values(), default=-1) + 1)
    special = {i for i, t in tokenizer.get_added_tokens_decoder().items()}
    for token, i in tokenizer.get_vocab(True).items():
        out[i] = token.encode() if i in special else bytes(back[c] for c in token)
    return out


def splitter(pattern: str) -> Callable[[str], re.Pattern]:
    """The compiled pattern for a text. Texts of Latin characters alone go by an equal pattern of the standard library, which is faster.

    That pattern's classes of letters, numbers and white space are read off the general one, character by character. It is
    used for the byte-level patterns that consist of those classes; for any other the general one serves.
    """
    general = regex.compile(pattern)
    chars = [chr(c) for c in range(LATIN)]
    kinds = {"L": r"\p{L}", "N": r"\p{N}", "s": r"\s"}
    of = {k: "".join(map(re.escape, filter(regex.compile(c).fullmatch, chars))) for k, c in kinds.items()}
    if not set(kinds.values()) <= set(re.findall(r"\\p\{.\}|\\s", pattern)):
        return lambda text: general
    # Contractions begin with an apostrophe, which no letter or number does: trying words first finds the same.
    pattern = re.sub(r"^((?:'[a-z]+\|)+)( \?\\p\{L\}\+\| \?\\p\{N\}\+\|)", r"\2\1", pattern)
    inside = lambda m: m[0][:2] + "".join(of[x[-2] if x[1] == "p" else "s"] for x in re.findall(r"\\p\{.\}|\\s", m[0])) + "]"
    latin = re.sub(r"\[\^(?:\\p\{.\}|\\s)+\]", inside, pattern)
    latin = re.sub(r"(?<!\[)\\p\{([LN])\}", lambda m: f"[{of[m[1]]}]", latin)
    latin = latin.replace(r"\s", f"[{of['s']}]").replace(r"\S", f"[^{of['s']}]")
    fast, other = re.compile(latin), re.compile(f"[^{chars[0]}-{chars[-1]}]")
    return lambda text: general if other.search(text) else fast


class PieceEncoder:
    """Texts to ids; ``pattern`` (without groups) cuts pieces, ``tokenizer`` encodes a piece.

    Texts that hold an added token of ``whole``, a tokenizer as its file has it, are given to that whole; without it, added tokens are ordinary text.
    """

    def __init__(self, tokenizer: Tokenizer, pattern: str, whole: Tokenizer | None = None, most: int = MEMO):
        self.tokenizer, self.pattern, self.whole, self.most = tokenizer, splitter(pattern), whole, most
        added = [t.content for t in whole.get_added_tokens_decoder().values()] if whole else []
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.chars = dict(enumerate(byte_chars()))
        self.memo: dict[str, bytes] = {}

    def _learn(self, pieces: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """Each piece's ids: its bytes as characters, merged by the library's model."""
        merge, chars = self.tokenizer.model.tokenize, self.chars
        for p in pieces:
            found = merge(p.encode().decode("latin-1").translate(chars))
            yield p, array("I", [t.id for t in found]).tobytes()

    def _encode(self, runs: list[list[str]]) -> list[bytes]:
        new = set().union(*runs).difference(self.memo)
        if len(self.memo) + len(new) > self.most:
            self.memo, new = {}, set().union(*runs)
        memo = self.memo
        memo.update(self._learn(new))
        out = [b"".join(map(memo.__getitem__, r)) for r in runs]
        for p in new:
            if len(p) > MEMO_PIECE:
                del memo[p]
        return out

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if self.added and (held := [i for i, t in enumerate(texts) if self.added.search(t)]):
            out = self._encode_pieces(["" if self.added.search(t) else t for t in texts])
            for i in held:
                out[i] = array("I", self.whole.encode(texts[i], add_special_tokens=False).ids).tobytes()
            return out
        return self._encode_pieces(texts)

    def _encode_pieces(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        i = 0
        while i < len(texts):
            if len(texts[i]) > CHARS:
                pieces = (m[0] for m in self.pattern(texts[i]).finditer(texts[i]))
                out.append(b"".join(self._encode([list(run)])[0] for run in itertools.batched(pieces, RUN)))
                i += 1
                continue
            j, size = i, 0
            while j < len(texts) and j - i < TEXTS and (size := size + len(texts[j])) <= CHARS:
                j += 1
            out += self._encode([self.pattern(t).findall(t) for t in texts[i:j]])
            i = j
        return out

    def encode_bytes(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), dtype="<u4")

    def encode_offsets(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and for each the place in the UTF-8 bytes where it begins."""
        ids = self.encode(text)
        sizes = np.array([len(t) for t in token_table(self.tokenizer)], dtype=np.int64)
        ends = np.cumsum(sizes[ids]) if len(ids) else np.zeros(0, np.int64)
        return ids, ends - (sizes[ids] if len(ids) else 0)


def decode_bytes(ids: np.ndarray, table: list[bytes]) -> bytes:
    return b"".join(map(table.__getitem__, ids.tolist()))


class StreamDecoder:
    """Text from ids as they come: the bytes of a character that is split over tokens are held back until it is whole."""

    def __init__(self, table: list[bytes]):
        import codecs

        self.table, self.state = table, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        return self.state.decode(b"".join(self.table[i] for i in ids))

    def end(self) -> str:
        return self.state.decode(b"", final=True)
