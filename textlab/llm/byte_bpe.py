"""Byte-level BPE encoding by a compiled transducer, decoding by a UTF-8 state machine.

A text is cut by the vocabulary's split pattern; each match is read byte by
byte by one lazily determinised transducer (:mod:`.bpe_machine`), which emits ids
after a bounded lookahead.  The decoder takes ids one after another and gives out
text as soon as characters are complete; between two ids it holds at most
three bytes.

Edge cases: null and empty texts have no ids and decode to the empty text; a very long
text is read match by match; repeated rows give repeated rows; extra columns
are ignored; an empty table gives no rows.  Ids that no encoder gives (broken UTF-8)
decode to U+FFFD in place of each broken part, as Python's "replace" does.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache
from hashlib import sha256
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_machine import TokenMachine

PATHS = 250_000  # whole matches kept per worker
TOGETHER = 1024  # ids that the decoder takes at once


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=1)
def newer_characters() -> str:
    """A class of the letters and digits that this regex module knows and the vocabulary's own engine does not
    (their Unicode versions differ); for that engine they are neither."""
    import tiktoken

    points = np.r_[0:0xD800, 0xE000:0x110000].astype("<u4")
    characters = points.tobytes().decode("utf-32-le")
    single = {bytes((b,)): b for b in range(256)}
    e = tiktoken.Encoding("characters", pat_str=r"[\p{L}\p{N}]+", mergeable_ranks=single, special_tokens={})
    known = bytes(e.encode_ordinary(characters)).decode()
    here = "".join(regex.findall(r"[\p{L}\p{N}]+", characters))
    if known == here:
        return ""
    known = set(known)
    here = "".join(c for c in here if c not in known)
    return ranges(here)


def ranges(characters: str) -> str:
    """Body of a character class for sorted characters."""
    runs, first = [], 0
    for i in range(1, len(characters) + 1):
        if i == len(characters) or ord(characters[i]) != ord(characters[i - 1]) + 1:
            runs.append(f"\\U{ord(characters[first]):08x}-\\U{ord(characters[i - 1]):08x}")
            first = i
    return "".join(runs)


#: Latin letters and general punctuation: texts of these alone are split by plain character classes, which is faster.
COMMON = "".join(map(chr, [*range(0x250), *range(0x2000, 0x2070)]))


class Splitter:
    """Matches of the vocabulary's pattern, as its own engine finds them."""

    def __init__(self, pattern: str):
        self.plain, self.exact, self.odd = regex.compile(pattern), None, None
        letter, digit, space = (ranges("".join(regex.findall(c, COMMON))) for c in (r"\p{L}", r"\p{N}", r"\s"))
        common = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{digit}]")
        for name, body in ((r"\p{L}", letter), (r"\p{N}", digit), (r"\s", space)):
            common = common.replace(name, f"[{body}]")
        self.common = re.compile(common.replace(r"\S", f"[^{space}]"))
        self.rare = re.compile(f"[^{ranges(COMMON)}]")
        odd = newer_characters()
        if odd:
            self.odd = regex.compile(f"[{odd}]")
            inside = pattern.replace(r"[^\s\p{L}\p{N}]", rf"(?:[{odd}]|[^\s\p{{L}}\p{{N}}])")
            for c in (r"\p{L}", r"\p{N}"):
                inside = inside.replace(f" ?{c}", f" ?(?:(?![{odd}]){c})")
            self.exact = regex.compile(inside)

    def __call__(self, text: str) -> list[str]:
        if text.isascii() or not self.rare.search(text):
            return self.common.findall(text)
        if self.odd and self.odd.search(text):
            return self.exact.findall(text)
        return self.plain.findall(text)


class Utf8Decoder:
    """Incremental decoder: feed bytes, get the text that is complete; at most three bytes are held."""

    #: lead byte -> (bytes that follow, least and greatest first of them); fixed values of UTF-8.
    LEADS = ({b: (1, 0x80, 0xBF) for b in range(0xC2, 0xE0)} | {b: (2, 0x80, 0xBF) for b in range(0xE0, 0xF0)} | {b: (3, 0x80, 0xBF) for b in range(0xF0, 0xF5)}
             | {0xE0: (2, 0xA0, 0xBF), 0xED: (2, 0x80, 0x9F), 0xF0: (3, 0x90, 0xBF), 0xF4: (3, 0x80, 0x8F)})

    def __init__(self) -> None:
        self.held = b""

    @classmethod
    def open_bytes(cls, data: bytes) -> int:
        """How many of the last bytes begin a character that is not complete yet.

        Walks the states of the last lead byte: each following byte must lie in the range that is
        allowed there, and the character must need more.
        """
        for back in range(1, min(3, len(data)) + 1):
            lead = cls.LEADS.get(data[-back])
            if lead:
                follow, low, high = lead
                for b in data[len(data) - back + 1:]:
                    if not low <= b <= high:
                        return 0
                    follow, low, high = follow - 1, 0x80, 0xBF
                return back if follow else 0
            if not 0x80 <= data[-back] <= 0xBF:
                return 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data) - self.open_bytes(data)
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        out, self.held = self.held, b""
        return out.decode("utf-8", "replace")


class Paths(dict):
    """The machine's paths from its start to the end of a match, path-compressed: match -> ids."""

    def __init__(self, machine: TokenMachine):
        super().__init__()
        self.machine = machine

    def __missing__(self, match: str) -> list[int]:
        ids: list[int] = []
        self.machine.encode(match.encode(), ids)
        if len(self) < PATHS and len(match) <= 64:  # the frequent ones come first
            self[match] = ids
        return ids


class ByteBpe:
    def __init__(self, path: str, pattern: str):
        self.ranks, self.pattern = read_ranks(path), pattern
        if any(bytes((b,)) not in self.ranks for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")

    @cached_property
    def paths(self) -> Paths:
        return Paths(TokenMachine(self.ranks, whole=True))

    @cached_property
    def split(self) -> Splitter:
        return Splitter(self.pattern)

    @cached_property
    def tokens(self) -> dict[int, bytes]:
        return {i: t for t, i in self.ranks.items()}

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        get = self.paths.__getitem__
        for match in self.split(text or ""):
            ids += get(match)
        return ids

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """The text in parts, each as soon as its characters are complete."""
        decoder, ids = Utf8Decoder(), iter(ids)
        while part := [*map(self.tokens.__getitem__, islice(ids, TOGETHER))]:
            yield decoder.feed(b"".join(part))
        yield decoder.close()


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


Batches = Iterator[pa.RecordBatch]


def encoded(batches: Batches, codec: ByteBpe) -> Batches:
    """Batches (doc_id, text) -> (doc_id, ids)."""
    for b in batches:
        ids = pa.array([np.asarray(codec.encode(t), np.int32) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["doc_id", "ids"])


def decoded(batches: Batches, codec: ByteBpe) -> Batches:
    """Batches (doc_id, ids) with the text of the ids."""
    for b in batches:
        text = pa.array(["".join(codec.decode(x.values.to_pylist())) for x in b.column(1)], pa.string())
        yield pa.RecordBatch.from_arrays([*b.columns[:2], text], names=["doc_id", "ids", "text"])


def digests(batches: Batches) -> Batches:
    """Batches (doc_id, ids, text) -> number of ids and hex sha256 of the ids (little-endian, unsigned, 32 bits) and of the text."""
    for b in batches:
        ids = [x.values.to_numpy() for x in b.column(1)]
        out = [pa.array([len(x) for x in ids], pa.int64()), pa.array([sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
               pa.array([sha256(t.encode()).hexdigest() for t in b.column(2).to_pylist()], pa.string())]
        yield pa.RecordBatch.from_arrays([b.column(0), *out], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _run(df: DataFrame, steps, columns: str) -> DataFrame:
    return df.mapInArrow(steps, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, {columns}")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids for every row."""
    return _run(_rows(docs, id_col, text_col), lambda batches: encoded(batches, codec(path, pattern)), "ids array<int>")


def decode_documents(ids: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids and text for every row (doc_id, ids)."""
    return _run(ids.select("doc_id", "ids"), lambda batches: decoded(batches, codec(path, pattern)), "ids array<int>, text string")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of encoding and decoding every row: both steps in one task, so that neither ids nor texts travel."""
    def steps(batches: Batches) -> Batches:
        c = codec(path, pattern)
        return digests(decoded(encoded(batches, c), c))

    return _run(_rows(docs, id_col, text_col), steps, "n_tokens long, ids_sha256 string, decoded_sha256 string")
