import hashlib
import random
import struct

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lanewise.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def own():
    with open(PATH, encoding="utf-8") as f:
        return bpe.Bpe(f.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@settings(max_examples=400, deadline=None)
@given(text=st.text(max_size=60) | st.lists(st.sampled_from(["the", "ing", "'s", "<|endoftext|>", " ", "Σ", "é", "=", "12", "İ", "\n"]), max_size=20).map("".join))
def test_same_as_library(own, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == want
    assert own.decode(want) == library.decode(want, skip_special_tokens=False)


def test_every_code_point(own, library):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 500):
        text = " ".join(f"a{c}b" for c in points[at : at + 500])
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_streaming_long_runs(own, library):
    r = random.Random(5)
    for alphabet in ("ab", "aehinorst", "=", "-=", "é漢"):
        text = "".join(r.choice(alphabet) for _ in range(9000))
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_every_symbol_passes_the_transducer(own, monkeypatch):
    pushed, peak, push = [], [0], bpe.PieceTransducer.push

    def counted(self, symbols):
        pushed.extend(symbols)
        out = push(self, symbols)
        peak[0] = max(peak[0], len(self.buffer))
        return out

    monkeypatch.setattr(bpe.PieceTransducer, "push", counted)
    monkeypatch.setattr(own, "memo", {})
    monkeypatch.setattr(own, "older", {})
    r = random.Random(8)
    words = ["".join(r.choice("abcdefghé漢") for _ in range(r.randint(1, 12))) + str(k) for k in range(5_000)]
    text = " ".join([*words, "".join(r.choice("ab") for _ in range(30_000))])
    ids = [*own.stream(text)]
    pieces = [p for part in bpe.stretches(text, 0, len(text)) for p in own.pieces.findall(bpe.normalised(part))]
    assert len(pushed) == sum(len(p.encode()) for p in dict.fromkeys(pieces))  # a repeated piece comes from the cache
    assert peak[0] < 5 * own.lookahead and len(ids) > 1  # ids leave before the text has ended


def test_megabytes_in_stretches(own, library):
    r = random.Random(9)
    words = [r.choice(["the", "é", "a\u0301", "12", "it's", "<|endoftext|>", "Σας", "==", "漢字"]) for _ in range(250_000)]
    text = "".join(w + r.choice(" \n\t ") for w in words)
    assert max(map(len, bpe.stretches(text, 0, len(text)))) <= bpe.STRETCH
    assert own.encode(text) == library.encode(text, add_special_tokens=False).ids
    for solid in ("ab" * 500_000, "=" * 1_000_000):
        assert own.encode(solid) == library.encode(solid, add_special_tokens=False).ids


def test_spelled_decoder_takes_bytes_cut_anywhere(own, library):
    ids = library.encode("héllo 漢字 it's 🙂 <|endoftext|>ok " * 20, add_special_tokens=False).ids
    data, r = struct.pack(f"<{len(ids)}I", *ids), random.Random(10)
    for most in (1, 3, 7, 1000):
        state, at, out = bpe.SpelledDecoder(own), 0, ""
        while at < len(data):
            n = r.randint(1, most)
            out += state.push(data[at : at + n])
            assert len(state.rest) < 4
            at += n
        assert out == library.decode(ids, skip_special_tokens=False)


def test_heap_and_scan_merge_alike(own):
    r = random.Random(11)
    for n in (64, 200, 700):
        symbols = [r.choice("eaingthors") for _ in range(n)]
        by_heap, by_scan = own._merged_by_heap(symbols), [*symbols]
        while pairs := [(own.ranks[p], k) for k, p in enumerate(zip(by_scan, by_scan[1:], strict=False)) if p in own.ranks]:
            k = min(pairs)[1]
            by_scan[k : k + 2] = [by_scan[k] + by_scan[k + 1]]
        assert by_heap == by_scan


def test_lookahead_bounds_what_can_change(own):
    r = random.Random(6)
    stream, symbols, out, most = bpe.PieceTransducer(own), [r.choice("eaingthors") for _ in range(12_000)], [], 0
    for s in symbols:
        out += stream.push([s])
        most = max(most, len(stream.buffer))
    assert most <= 4 * own.lookahead
    out += stream.finish()
    whole = own.merged([*symbols[:-1], symbols[-1] + own.suffix])
    assert out == [own.vocab[t] for t in whole]


def test_small_lookahead_by_hand():
    length = len
    assert bpe.sufficient_lookahead([], length) == 1
    assert bpe.sufficient_lookahead([("a", "b")], length) == 2
    # c+d, then b+c can be pre-empted by c+d, then a+b by b+c
    assert bpe.sufficient_lookahead([("c", "d"), ("b", "c"), ("a", "b")], length) == 4


def test_text_decoder_is_incremental(own):
    ids = own.encode("héllo 漢字 🙂 <|endoftext|>ok")
    state = bpe.TextDecoder(own)
    assert "".join(map(state.push, ids)) + state.finish() == "héllo 漢字 🙂 <|endoftext|>ok "


def test_columns(spark, library):
    docs = spark.createDataFrame([(1, "Hello world"), (2, None), (2, None), (3, "")], "doc_id long, text string").selectExpr("*", "1 as Encoded")
    got = bpe.decode_column(bpe.encode_column(docs), ids="encoded.ids").collect()
    assert sorted((r.doc_id, r.encoded.n_tokens, r.decoded) for r in got) == [(1, 2, "hello world "), (2, 0, ""), (2, 0, ""), (3, 0, "")]
    want = library.encode("Hello world", add_special_tokens=False).ids
    r = bpe.digests(docs).where("doc_id = 1").first()
    assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
    assert r.decoded_sha256 == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digests(docs.limit(0)).count() == 0
