"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

Encoding follows a tokenizer file's stages: added tokens are cut out of the raw text, the rest is
normalised (NFC, white space, lower case per code point), split into pieces, each piece's UTF-8
bytes become symbols (the last with the end-of-word mark), and merges apply by rank.

Lookahead. A merge at the right edge of what has been read can be pre-empted only by a merge of lower
rank that takes away its right part (or a right-spine part of it), which in turn can be pre-empted
by a still lower one, and so on. ``sufficient_lookahead`` walks the merge list in rank order and
finds the longest such chain in symbols. A token that ends at least that many symbols before the
end of the buffer is stable: ``PieceTransducer.push`` emits it and forgets its symbols, so memory
is bounded by the lookahead and not by the piece. Since the tokens after an emitted one are
the encoding of the symbols after it, the emitted sequence is that of the whole piece.

A text goes through in stretches of about ``STRETCH`` code points, each cut before a white-space
character, which neither normalisation nor a piece reaches across. Every piece is pushed through the
transducer; a bounded memo of frequent pieces is only a cache of what came out of it. Packed ids leave a
stretch at a time, so beside the given text a task holds one stretch (a longer one where no white space comes).

Decoding is a state machine as well. ``SpelledDecoder.push`` takes packed ids as bytes, cut anywhere, keeps at
most three bytes of an incomplete id, and gives what the library's decode gives for a file without a decoder: token
strings joined by spaces. ``TextDecoder.push`` takes one id, keeps at most an incomplete UTF-8 sequence (3
bytes), and gives plain text as soon as it is complete.

Defined cases: null and empty texts have no ids and decode to the empty string; special strings in
a text are special tokens, as in the library; very long texts, with or without white space, take linear time;
repeated rows are encoded one by one; an existing column named like ``out`` is replaced; others stay.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewise.llm.common import load

#: Pieces that a worker remembers, and the longest piece it remembers.
MEMO, MEMO_PIECE = 400_000, 64
#: Code points that are normalised and split at a time.
STRETCH = 1 << 16
#: From so many symbols on, merging uses a heap.
HEAPED = 64


def byte_symbols() -> list[str]:
    """The printable code point that stands for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


SYMBOLS = byte_symbols()


def sufficient_lookahead(merges: list[tuple[str, str]], length) -> int:
    """Symbols after a token's end that can still decide about it. length: of a token, in symbols."""
    spine: dict[str, tuple[str, ...]] = {}
    reach: dict[str, int] = {}  # by left part: of the merges so far, which have lower ranks
    most = 0
    for left, right in merges:
        parts = spine.get(right, (right,))
        far = length(right) + max(reach.get(p, 0) for p in parts)
        most = max(most, far)
        reach[left] = max(reach.get(left, 0), far)
        spine.setdefault(left + right, (left + right, *parts))
    return most + 1


class PieceTransducer:
    """Symbols in, stable token ids out; keeps a bounded buffer."""

    def __init__(self, bpe: Bpe) -> None:
        self.bpe, self.buffer = bpe, []

    def push(self, symbols: list[str]) -> list[int]:
        self.buffer += symbols
        ahead, out = self.bpe.lookahead, []
        if len(self.buffer) >= 4 * ahead:
            tokens = self.bpe.merged(self.buffer)
            end = 0
            for token in tokens:
                if end + (n := self.bpe.length(token)) > len(self.buffer) - ahead:
                    break
                end += n
                out.append(self.bpe.vocab[token])
            del self.buffer[:end]
        return out

    def finish(self) -> list[int]:
        """The piece has ended: its last symbol gets the end-of-word mark, the rest is stable."""
        if not self.buffer:
            return []
        self.buffer[-1] += self.bpe.suffix
        out = [self.bpe.vocab[t] for t in self.bpe.merged(self.buffer)]
        self.buffer = []
        return out


class Bpe:
    """One worker's tokenizer, from the text of a tokenizer file."""

    def __init__(self, spec: str) -> None:
        spec = json.loads(spec)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.ranks = {pair: k for k, pair in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.lookahead = sufficient_lookahead(merges, self.length)
        self.added = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces, self.latin_pieces = (re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{letters}]+|[{numbers}]|[^{_WHITE}{letters}{numbers}]+") for letters, numbers in ((_category(m, end) for m in "LN") for end in (sys.maxunicode, 0x24F)))
        self.transducer = PieceTransducer(self)
        self.memo: dict[str, bytes] = {}
        self.older = self.memo

    def length(self, token: str) -> int:
        return len(token) - (len(self.suffix) if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix) else 0)

    def merged(self, symbols: list[str]) -> list[str]:
        """Lowest rank first, leftmost first among equals."""
        if len(symbols) >= HEAPED:
            return self._merged_by_heap(symbols)
        word, rank, none = list(symbols), self.ranks.get, sys.maxsize
        ranks = [rank(pair, none) for pair in zip(word, word[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            k = ranks.index(best)
            word[k : k + 2] = [word[k] + word[k + 1]]
            del ranks[k]
            if k:
                ranks[k - 1] = rank((word[k - 1], word[k]), none)
            if k < len(ranks):
                ranks[k] = rank((word[k], word[k + 1]), none)
        return word

    def _merged_by_heap(self, symbols: list[str]) -> list[str]:
        """merged() in n log n: a linked list of tokens and a heap of (rank, place), stale entries skipped."""
        word: list[str | None] = list(symbols)
        n, rank = len(word), self.ranks.get
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(r, k) for k in range(n - 1) if (r := rank((word[k], word[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            j = after[k]
            if word[k] is None or j >= n or rank((word[k], word[j])) != r:
                continue
            word[k], word[j] = word[k] + word[j], None
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
            for left in (before[k], k):
                if left >= 0 and after[left] < n and (r := rank((word[left], word[after[left]]))) is not None:
                    heapq.heappush(heap, (r, left))
        return [t for t in word if t is not None]

    def piece(self, text: str) -> list[int]:
        """The ids of one piece: all its symbols pass the transducer."""
        stream, step, ids = self.transducer, self.lookahead, []
        for at in range(0, len(text), step):
            part = text[at : at + step]
            ids += stream.push([*part] if part.isascii() and part.isprintable() else [SYMBOLS[b] for b in part.encode()])
        return ids + stream.finish()

    def known(self, piece: str) -> bytes:
        """The ids of a piece as little-endian unsigned 32-bit integers."""
        found = self.older.get(piece)
        if found is None:
            found = packed(self.piece(piece))
        if len(piece) <= MEMO_PIECE:
            if len(self.memo) >= MEMO // 2:
                self.older, self.memo = self.memo, {}
            self.memo[piece] = found
        return found

    def stream(self, text: str) -> Iterator[bytes]:
        """The packed ids of a text, a stretch or a special token at a time."""
        at = 0
        for m in self.added.finditer(text) if self.added else ():
            yield from self._plain(text, at, m.start())
            yield packed([self.special[m[0]]])
            at = m.end()
        yield from self._plain(text, at, len(text))

    def _plain(self, text: str, start: int, end: int) -> Iterator[bytes]:
        for part in stretches(text, start, end):
            part = normalised(part)
            split = self.pieces if _BEYOND_LATIN.search(part) else self.latin_pieces
            memo, known = self.memo.get, self.known
            yield b"".join([memo(p) or known(p) for p in split.findall(part)])

    def encode(self, text: str) -> list[int]:
        data = b"".join(self.stream(text))
        return [*struct.unpack(f"<{len(data) // 4}I", data)]

    def decode(self, ids: list[int]) -> str:
        return SpelledDecoder(self).push(packed(ids))


def stretches(text: str, start: int, end: int) -> Iterator[str]:
    """text[start:end] in parts of about STRETCH, each but the first starting with a space or newline."""
    while end - start > STRETCH:
        cut = max(text.rfind(c, start + 1, start + STRETCH) for c in " \n")
        if cut < 0:
            later = [at for c in " \n" if (at := text.find(c, start + STRETCH, end)) >= 0]
            if not later:
                break
            cut = min(later)
        yield text[start:cut]
        start = cut
    if start < end:
        yield text[start:end]


class SpelledDecoder:
    """Packed ids as bytes, cut anywhere, to the library's text: token strings with a space between."""

    def __init__(self, bpe: Bpe) -> None:
        self.names, self.rest, self.gap = bpe.names, b"", ""

    def push(self, data: bytes) -> str:
        data = self.rest + data if self.rest else data
        n = len(data) // 4
        self.rest = data[4 * n :]
        if not n:
            return ""
        text = self.gap + " ".join(map(self.names.__getitem__, struct.unpack_from(f"<{n}I", data)))
        self.gap = " "
        return text


class TextDecoder:
    """Ids to plain text, one at a time; bytes that end no UTF-8 sequence become U+FFFD."""

    def __init__(self, bpe: Bpe) -> None:
        import codecs

        self.bpe, self.bytes = bpe, {s: b for b, s in enumerate(SYMBOLS)}
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, token_id: int) -> str:
        token = self.bpe.names[token_id]
        if token in self.bpe.special:
            return self.state.decode(b"", True) + token
        ends = bool(self.bpe.suffix) and token.endswith(self.bpe.suffix)
        data = bytes(self.bytes[c] for c in (token[: -len(self.bpe.suffix)] if ends else token))
        return self.state.decode(data, ends) + " " * ends

    def finish(self) -> str:
        return self.state.decode(b"", True)


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


#: White space of the file's pattern (the Unicode property White_Space).
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


#: What Unicode 16 has beyond 15.1, so that older interpreters split alike.
_UNICODE_16 = {
    "L": [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)],
    "N": [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)],
}


def _category(major: str, last: int) -> str:
    """A character class's content: all code points up to last of a major category in Unicode 16."""
    newer = {c for a, b in _UNICODE_16[major] for c in range(a, b + 1)}
    out, start = [], None
    for c in range(last + 2):
        inside = c <= last and (unicodedata.category(chr(c))[0] == major or c in newer)
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


#: Capitals younger than the interpreter's Unicode tables (15.1), with their small letters.
_NEW_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B}
_NEW_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
_NEW_UPPER = re.compile("[" + "".join(map(chr, _NEW_LOWER)) + "]")


_BEYOND_LATIN = re.compile("[^\0-\u024f]")


def normalised(text: str) -> str:
    """NFC, then lower case by code point; the pieces' pattern drops all white space itself."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    if _NEW_UPPER.search(text):
        text = text.translate(_NEW_LOWER)
    return text.lower() if "Σ" not in text else "".join(map(str.lower, text))


_WORKER: dict[str, Bpe] = {}


def worker_bpe(held) -> Bpe:
    """The worker's tokenizer for a broadcast file; kept between tasks."""
    key = hashlib.sha256(held.value.encode()).hexdigest()
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Bpe(held.value)
    return _WORKER[key]


_OUT = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
_DIGEST = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def _encoder(held):
    @F.arrow_udf(_OUT)
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = worker_bpe(held)
        for texts in batches:
            rows = []
            for text in texts:
                ids = b"".join(bpe.stream(text.as_py() or ""))
                rows.append({"n_tokens": len(ids) // 4, "ids": ids})
            yield pa.array(rows, type=pa.struct([("n_tokens", pa.int64()), ("ids", pa.binary())]))

    return encode


def _digester(held):
    @F.arrow_udf(_DIGEST)
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = worker_bpe(held)
        for texts in batches:
            counts, ids_out, decoded_out = [], [], []
            for text in texts:
                n, ids, decoded, decoder = 0, hashlib.sha256(), hashlib.sha256(), SpelledDecoder(bpe)
                for data in bpe.stream(text.as_py() or ""):
                    n += len(data) // 4
                    ids.update(data)
                    decoded.update(decoder.push(data).encode())
                counts.append(n)
                ids_out.append(ids.hexdigest())
                decoded_out.append(decoded.hexdigest())
            yield pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(ids_out, pa.string()), pa.array(decoded_out, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return digest


def _decoder(held):
    @F.arrow_udf(T.StringType())
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = worker_bpe(held)
        for rows in batches:
            out = []
            for data in rows:
                state = TextDecoder(bpe)
                ids = data.as_py() or b""
                out.append("".join([state.push(int.from_bytes(ids[k : k + 4], "little")) for k in range(0, len(ids), 4)]) + state.finish())
            yield pa.array(out, type=pa.string())

    return decode


def tokenizer_file(spark: SparkSession, path: str | None = None):
    """The tokenizer file's text, for all tasks (a few MB: a vocabulary, which never grows with data)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_column(df: DataFrame, *, text: str = "text", out: str = "encoded", path: str | None = None) -> DataFrame:
    """df with ``out``: struct(n_tokens, ids: little-endian unsigned 32-bit integers)."""
    return df.withColumn(out, _encoder(tokenizer_file(df.sparkSession, path))(F.col(text).cast("string")))


def decode_column(df: DataFrame, *, ids: str, out: str = "decoded", path: str | None = None) -> DataFrame:
    """df with ``out``: the plain text of packed ids, words followed by a space."""
    return df.withColumn(out, _decoder(tokenizer_file(df.sparkSession, path))(F.col(ids)))


def digests(docs: DataFrame, *, text: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of a table with doc_id and text."""
    made = docs.select(F.col("doc_id"), _digester(tokenizer_file(docs.sparkSession, path))(F.col(text).cast("string")).alias("d"))
    return made.select("doc_id", "d.n_tokens", "d.ids_sha256", "d.decoded_sha256")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(load(spark, sf_dir, "documents").select("doc_id", "text"))
