"""Packing token sequences: first-fit decreasing on a tournament tree of bin
capacities, in randomised groups of documents.

* Tokens.  The tokenizer drops white space, so the ids of a text are the ids
  of its white-space-separated words, one after another; each distinct word is
  encoded once per worker (the table is emptied at ``TABLE_LIMIT`` words, a
  memory bound that changes nothing).  A document's ids end with id 2.
* Groups.  Rows are dealt at random (a hash of the row's place in its file or
  table, so that repeated rows spread too) into groups of about ``GROUP_BYTES`` of
  text and ``ROW_BYTES`` a row; the number of groups follows the corpus, the size of a group does not.
* One group.  Whole multiples of ``capacity`` are cut off long documents and
  fill a sequence each.  The rests, longest first, go to the first
  sequence with room, which a tournament (max) tree of free capacities finds
  in logarithmic time.  The few sequences left with gaps are then topped up: the emptiest one
  is taken apart and its pieces, cut to measure, fill the gaps of the others.
  What remains is one sequence per group; it is cut into powers of two, which need
  no padding.

Edge cases: null and empty texts are the single end id; repeated rows are
packed as often as they occur; very long texts are cut; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back

END_ID = 2
TABLE_LIMIT = 1_500_000  # words kept per worker process,
MARKED_LIMIT = 300_000   # as many of them with marks at the end
TOGETHER = 128           # texts looked up together
OUT_ROWS = 8 * TOGETHER  # texts whose ids leave the worker together
GROUP_BYTES = 8 << 20
ROW_BYTES = 256           # of a group, for a row without text
_ASCII_SPACES = re.compile(r"[\x20\x09\x0a\x0d]+")


class WordIds(dict):
    """Word -> its ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, tokenizer_file: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(tokenizer_file)
        vocab = self.encoder.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a word
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.marked = 0  # kept words with marks
        self.last: dict[str, bool] = {}

    def one(self, word: str) -> bytes:
        return np.array(self.encoder.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def parts(self, word: str) -> tuple[str, str]:
        """Letters and the marks after them, if they are tokens apart; else the whole word.

        They are not where the tokenizer's normaliser turns the last letter into one with a
        combining mark, which would belong to the marks.
        """
        m = _LETTERS_THEN_MARKS.fullmatch(word)
        if not m:
            return word, ""
        c = m[1][-1]
        if c not in self.last:
            self.last[c] = self.encoder.normalizer.normalize_str(c)[-1:].isalpha()
        return m.groups() if self.last[c] else (word, "")

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words not in the table: their letter parts are encoded all at once, which is a third of the cost of one by one."""
        split = {w: self.parts(w) for w in words}
        new = {part for parts in split.values() for part in parts if part and part not in self}
        letters = [w for w in new if w.isalpha()]
        if letters:
            ids = np.array(self.encoder.encode(" ".join(letters), add_special_tokens=False).ids, dtype="<u4")
            ends = (np.flatnonzero(self.closes[ids]) + 1) * 4
            if len(ends) == len(letters) and ends[-1] == 4 * len(ids):
                data, start = ids.tobytes(), 0
                for w, end in zip(letters, ends.tolist()):
                    self[w] = data[start:end]
                    start = end
        for w in new:
            if w not in self:
                self[w] = self.one(w)
        self[""] = b""
        out = {w: self[core] + self[marks] if marks else self[core] for w, (core, marks) in split.items()}
        if self.marked < MARKED_LIMIT:  # the frequent ones come first
            marked = {w: out[w] for w, (_, marks) in split.items() if marks}
            self.update(marked)
            self.marked += len(marked)
        return out


# a word and the marks after it are encoded apart; an apostrophe could start a contraction
_LETTERS_THEN_MARKS = re.compile(r"([^\W\d_]+)([.,!$%&*#|;:?()\[\]-]+)")


@lru_cache(maxsize=2)
def word_ids(tokenizer_file: str) -> WordIds:
    return WordIds(tokenizer_file)


def encode(table: WordIds, texts: list[str], table_words: int | None = None) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit numbers.

    Lower-casing first only merges table entries the tokenizer would treat
    alike; it is left out where Python and the tokenizer could differ (final
    sigma, special-token strings).
    """
    out: list[bytes] = []
    for lo in range(0, len(texts), TOGETHER):
        if len(table) > (TABLE_LIMIT if table_words is None else table_words):
            table.clear()
            table.marked = 0
        lists, different = [], set()
        for text in texts[lo:lo + TOGETHER]:
            if "<|" not in text and "Σ" not in text and "İ" not in text:
                text = text.lower()
            lists.append(_ASCII_SPACES.split(text) if "\r" in text or "\t" in text else text.replace("\n", " ").split(" "))
            different.update(lists[-1])
        # the few different words of these texts stay in the processor's cache, the table does not
        few = dict(zip(different, map(table.get, different)))
        few.update(table.learn([w for w, ids in few.items() if ids is None]))
        out += [b"".join(map(few.__getitem__, words)) for words in lists]
    return out


class TournamentTree:
    """Max tree over bin capacities: the first bin with room, in O(log bins)."""

    def __init__(self, n: int, capacity: int):
        self.base = 1 << max(0, (max(n, 1) - 1).bit_length())
        self.t = [capacity] * (2 * self.base)

    def place(self, size: int) -> int:
        """Put ``size`` into the first bin with room and return the bin."""
        t, i = self.t, 1
        while i < self.base:
            i *= 2
            if t[i] < size:
                i += 1
        bin_ = i - self.base
        t[i] -= size
        while i > 1:
            i //= 2
            t[i] = max(t[2 * i], t[2 * i + 1])
        return bin_


def pack(lengths: list[int], capacity: int = 4096) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of pieces (item, start, length); every token of every item once."""
    bins: list[list[tuple[int, int, int]]] = []
    rests = []
    for i, n in enumerate(lengths):
        for start in range(0, n - capacity + 1, capacity):
            bins.append([(i, start, capacity)])
        if n % capacity:
            rests.append((n % capacity, i, n - n % capacity))
    rests.sort(key=lambda r: (-r[0], r[1]))
    tree, open_ = TournamentTree(len(rests), capacity), []
    for n, i, start in rests:
        b = tree.place(n)
        if b == len(open_):
            open_.append([])
        open_[b].append((i, start, n))
    bins += [b for b in open_ if sum(p[2] for p in b) == capacity]
    gaps = sorted((b for b in open_ if sum(p[2] for p in b) < capacity), key=lambda b: sum(p[2] for p in b))
    lo, hi = 0, len(gaps) - 1
    while lo < hi:  # the emptiest gives its pieces to the fullest
        room = capacity - sum(p[2] for p in gaps[hi])
        while room and gaps[lo]:
            i, start, n = gaps[lo].pop()
            k = min(n, room)
            gaps[hi].append((i, start, k))
            room -= k
            if n > k:
                gaps[lo].append((i, start + k, n - k))
        if room:
            lo += 1
        else:
            bins.append(gaps[hi])
            hi -= 1
    last = gaps[lo] if lo <= hi and lo < len(gaps) else []
    total = sum(p[2] for p in last)
    for size in (1 << k for k in range(capacity.bit_length(), -1, -1)):
        if not total & size:
            continue
        part, room = [], size
        while room:
            i, start, n = last.pop()
            k = min(n, room)
            part.append((i, start, k))
            room -= k
            if n > k:
                last.append((i, start + k, n - k))
        bins.append(part)
    return bins


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text",
                   table_words: int | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``table_words`` replaces ``TABLE_LIMIT`` where later stages need the room: fewer words take less memory and more time,
    and the workers, which are reused, drop them once groups are packed.  The rows are the same.

    ``docs`` should come from files or a written table, whose rows keep their places when a task runs again.
    """
    total = docs.select(F.sum(F.coalesce(F.octet_length(text_col).cast("long"), F.lit(0)) + ROW_BYTES)).first()[0] or 0
    groups = max(1, -(-total // GROUP_BYTES))

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer_file)
        for b in batches:
            for at in range(0, len(b), OUT_ROWS):  # a whole batch of texts, words and ids at once would be the worker's largest need
                part = b.slice(at, OUT_ROWS)
                texts = part["t"].to_pylist()
                ids = [_squeeze(x) for lo in range(0, len(texts), TOGETHER) for x in encode(words, texts[lo:lo + TOGETHER], table_words)]
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["grp"], pa.array(ids, pa.binary())], names=["doc_id", "grp", "ids"])
            give_back()

    group = F.pmod(F.xxhash64(F.lit("group"), F.monotonically_increasing_id()), F.lit(groups))
    kind = docs.schema[id_col].dataType.simpleString()
    x = docs.select(F.col(id_col).alias("doc_id"), group.alias("grp"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    x = x.mapInArrow(ids_of, f"doc_id {kind}, grp long, ids binary")

    def pack_group(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "ids"], kind="stable")
        ids = [np.append(_spread(b), np.uint32(END_ID)) for b in pdf["ids"]]
        doc, rows = pdf["doc_id"].tolist(), []
        for s, pieces in enumerate(pack([len(v) for v in ids], capacity)):
            offset = 0
            for i, start, n in pieces:
                crc = zlib.crc32(ids[i][start:start + n].astype("<u4").tobytes())
                rows.append((doc[i], start, n, crc, len(ids[i]), (int(key[0]) << 32) + s, offset))
                offset += n
        out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
        if table_words is not None:  # all texts are encoded when the first group is packed
            word_ids.cache_clear()
        del ids, doc, rows
        give_back()
        return out

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return x.groupBy("grp").applyInPandas(pack_group, schema)


def _squeeze(ids: bytes) -> bytes:
    """16-bit ids where they fit (tag byte 2), else 32-bit (tag byte 4)."""
    v = np.frombuffer(ids, dtype="<u4")
    return b"\x02" + v.astype("<u2").tobytes() if not len(v) or v.max() < 1 << 16 else b"\x04" + ids


def _spread(b: bytes) -> np.ndarray:
    return np.frombuffer(b, dtype="<u2" if b[0] == 2 else "<u4", offset=1).astype(np.uint32)
