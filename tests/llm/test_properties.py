"""Round trips and equalities on generated inputs."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from test_ten_operators import PATTERN, RANKS, brute_fingerprint, encoding

from cadenza.llm import bpe, html, op02_mpeg, op05_dac, op07_simhash, op08_bpe, op10_pst
from cadenza.llm.groups import merge

few = settings(max_examples=150, deadline=None)


@few
@given(st.lists(st.integers(0, 2**32 - 1), max_size=700))
def test_codes(values):
    codes = op05_dac.Codes.encode(np.array(values, np.uint32))
    again = op05_dac.Codes.from_bytes(codes.to_bytes(), len(codes.levels))
    assert again.slice(0, len(values)).tolist() == values
    assert [again.access(i) for i in range(0, len(values), 13)] == values[::13]


@few
@given(st.binary(max_size=3000))
def test_media(data):
    payload = op02_mpeg.pad(data)
    media = op02_mpeg.write(payload, len(data))
    stream = op02_mpeg.parse(media)
    assert op02_mpeg.payload_of(media, stream) == payload and int(stream.tags["n_bytes"]) == len(data)


@few
@given(st.integers(0, 1400), st.sampled_from([b"TAG", b"ID3\x04\x00\x00\x00\x00\x01\x00", b"Xing\x00\x00\x00\x0f", b"\xff\xfb\x90\xc4", b"\xff\xfa\xe4\xc4", b"\xff" * 5]), st.binary(max_size=1200))
def test_media_that_looks_like_tags_or_headers(before, mark, after):
    data = b"x" * before + mark * 3 + after
    media = op02_mpeg.write(payload := op02_mpeg.pad(data), len(data))
    stream = op02_mpeg.parse(media)
    assert op02_mpeg.payload_of(media, stream) == payload and int(stream.tags["payload_bytes"]) == len(payload) and not stream.skipped


def test_media_with_a_tag_at_every_offset():
    for n in range(60, 130):
        data = b"x" * n + b"TAG and more"
        media = op02_mpeg.write(payload := op02_mpeg.pad(data), len(data))
        assert op02_mpeg.payload_of(media, op02_mpeg.parse(media)) == payload


@few
@given(st.binary(max_size=600))
def test_media_parser_takes_anything(data):
    stream = op02_mpeg.parse(data)
    assert all(0 <= f.at and f.at + f.size <= len(data) for f in stream.frames)


@few
@given(st.text(max_size=200))
def test_bpe(text):
    own, table = op08_bpe.encoder(RANKS, PATTERN)
    ids = own.encode(text)
    assert ids.tolist() == encode(text) and bpe.decode_bytes(ids, table) == text.encode()


_library = []


def encode(text):
    if not _library:
        _library.append(encoding())
    return _library[0].encode_ordinary(text)


@few
@given(st.text(alphabet="<>/!-ap \"'=&;#x1divscript\n", max_size=120))
def test_html(source):
    page = html.read(source)
    assert all(t == " ".join(t.split()) and t for _, t, _ in page.blocks) and all(-1 <= u < k for k, u in enumerate(page.up))


@few
@given(st.text(alphabet="aB \t\n\x0b\x1c é", max_size=80))
def test_fingerprint(text):
    assert int(op07_simhash.majority([op07_simhash.shingle_hashes(text)])[0]) == brute_fingerprint(text)


@few
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=60))
def test_merge(pairs):
    i, j = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
    label = merge(np.arange(41), i, j)
    want = list(range(41))
    for _ in range(41):
        for a, b in pairs:
            want[a] = want[b] = min(want[a], want[b])
    assert label.tolist() == want


@few
@given(st.lists(st.text(alphabet="ab \x00\n", max_size=30), min_size=1, max_size=5), st.integers(1, 40))
def test_windows_hold_every_place_once(texts, window):
    joined, before = [b" ".join(op10_pst.words_of(t)) for t in texts], op10_pst.WINDOW
    op10_pst.WINDOW = window
    try:
        got = [pair for g, at in op10_pst.Block(joined, np.ones(len(texts), bool)).windows() for pair in zip(g.tolist(), at.tolist(), strict=True)]
    finally:
        op10_pst.WINDOW = before
    size = op10_pst.DEPTH
    whole = [b"\xff" * size + t + b"\n" for t in joined]
    assert got == [(int.from_bytes(t[i - size : i + 1], "big"), k) for k, t in enumerate(whole) for i in range(size, len(t))]


@few
@given(st.lists(st.integers(0, 2**63), max_size=200), st.integers(0, 2**63))
def test_packed_numbers(values, other):
    keys = np.unique(np.array(values, np.uint64))
    assert op10_pst.expand_sorted(op10_pst.squeeze_sorted(keys)).tolist() == keys.tolist()
    if len(keys):
        table = op10_pst.Lookup(keys, np.arange(len(keys), dtype=np.float64), np.ones(len(keys), np.int64))
        assert table(keys[::-1]).tolist() == list(range(len(keys)))[::-1]
