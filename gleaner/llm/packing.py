"""Packing: bounded-space online best-fit.

Each task keeps OPEN windows of LENGTH tokens. A document's ids come in pieces: whole windows of their own while it
is longer than one, then the rest, which goes where it leaves the least room. When no window has room, the fullest
is emitted (and the piece starts a new one); where the fullest still has more room than SLACK, the piece is cut to
fill it first, so padding stays under SLACK / LENGTH. What is open at a task's end is merged: the leftovers of FAN
tasks meet in one task, where they are joined and cut to full windows; the last less-than-a-window of tokens is
written as sequences of powers of two, which need no padding. What the first step gives is written to the shared folder
once, so a lost executor can't change what was packed; of it the leftovers alone are shuffled, and a merging task holds
at most FAN * OPEN windows.

The tokenizer is slow on text and fast on words, so each worker keeps a bounded table of words already met. Only
splits that cannot change ids are used (blanks and line ends; a run of Latin letters before punctuation), and what
isn't surely plain goes to the tokenizer as it is.

Defined results. Null and empty texts: the end id alone. Repeated rows and null ids: each row by itself, in its own
pieces. Of windows with equal room, the one opened first is taken. A text longer than a window fills whole ones of its
own. Extra columns, of any name, are left aside. Empty table: no rows. Sequence ids are unique, not gapless: (task or
merging group, number in it).
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import materialise, public_tokenizer

LENGTH, END, OPEN, SLACK, FAN = 4096, 2, 32, 64, 8
MAX_KNOWN = 400_000
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?&$#%*|()-]*)")
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, grp long"


def byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Words(dict):
    """Ids (32-bit little-endian bytes) of pieces of text between blanks."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.parts = Tokenizer.from_file(path), {}
        self.model, self.by_byte = self.tokenizer.model, byte_letters()

    def ask(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def ask_letters(self, word: str) -> bytes:
        """Of lower-case Latin letters alone: nothing to normalise or split, so the merges are asked at once."""
        ids = [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.by_byte))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def part(self, text: str, letters: bool) -> bytes:
        got = self.parts.get(text)
        if got is None:
            if len(self.parts) >= MAX_KNOWN:
                self.parts.clear()
            got = self.parts[text] = self.ask_letters(text) if letters else self.ask(text)
        return got

    def __missing__(self, word: str) -> bytes:
        m = PLAIN.fullmatch(word) if len(word) <= 64 else None
        ids = (self.part(m[1].lower(), True) + (self.part(m[2], False) if m[2] else b"")) if m else self.ask(word)
        if len(self) >= MAX_KNOWN:
            self.clear()
        if len(word) <= 64:
            self[word] = ids
        return ids


@lru_cache(maxsize=2)
def words(path: str) -> Words:
    return Words(path)


def token_bytes(text: str | None, path: str) -> bytes:
    """All ids of a text and the end id."""
    table = words(path)
    return b"".join(map(table.__getitem__, (text or "").replace("\n", " ").split(" "))) + END.to_bytes(4, "little")


class Packer:
    """Open windows. place() and close() return finished windows: lists of (tag, start, ids)."""

    def __init__(self, length: int = LENGTH, space: int = OPEN, slack: int = SLACK):
        self.length, self.space, self.slack = length, space, slack
        self.open: list[tuple[int, list]] = []  # (room, pieces)

    def place(self, tag, ids: bytes) -> Iterator[list]:
        start, full = 0, 4 * self.length
        while len(ids) - 4 * start >= full:
            yield [(tag, start, ids[4 * start : 4 * start + full])]
            start += self.length
        rest = ids[4 * start :]
        if not rest:
            return
        fits = [(room, k) for k, (room, _) in enumerate(self.open) if 4 * room >= len(rest)]
        if fits:
            room, k = min(fits)
            self.put(k, tag, start, rest)
            if self.open[k][0] == 0:
                yield self.open.pop(k)[1]
            return
        if len(self.open) >= self.space:
            room, k = min((room, k) for k, (room, _) in enumerate(self.open))
            if room > self.slack:
                self.put(k, tag, start, rest[: 4 * room])
                start, rest = start + room, rest[4 * room :]
            yield self.open.pop(k)[1]
        self.open.append((self.length, []))
        self.put(len(self.open) - 1, tag, start, rest)

    def put(self, k: int, tag, start: int, ids: bytes) -> None:
        room, pieces = self.open[k]
        pieces.append((tag, start, ids))
        self.open[k] = (room - len(ids) // 4, pieces)


def merge(windows: Iterable[list], length: int = LENGTH) -> Iterator[list]:
    """Joins the pieces of open windows, cuts them to full windows and the last of them to powers of two."""
    pieces = [p for w in windows for p in w]
    left = sum(len(p[2]) // 4 for p in pieces)
    room = min(length, 1 << (left.bit_length() - 1)) if left else 0
    now: list = []
    for tag, start, ids in pieces:
        while ids:
            take = min(room, len(ids) // 4)
            now.append((tag, start, ids[: 4 * take]))
            start, ids, room, left = start + take, ids[4 * take :], room - take, left - take
            if room == 0:
                yield now
                now, room = [], min(length, 1 << (left.bit_length() - 1)) if left else 0


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = tokenizer or public_tokenizer("word_bpe_49k.json")
    names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = SCHEMA.replace("doc_id long", f"doc_id {kind}")

    def key(doc):
        """An id as pandas gives it: null or, beside nulls, a float."""
        return None if doc is None or doc != doc else int(doc) if isinstance(doc, float) and kind in ("bigint", "int") else doc

    def rows(window: list, sequence: int, keep: bool, grp: int) -> list[tuple]:
        import zlib

        out, at = [], 0
        for (doc, total), start, ids in window:
            n = len(ids) // 4
            out.append((doc, start, n, zlib.crc32(ids), total, sequence, at, ids if keep else None, grp))
            at += n
        return out

    def frame(out: list[tuple]):
        import pandas as pd

        got = pd.DataFrame(out, columns=names)
        return got.astype({c: "int64" for c in names if c not in ("doc_id", "ids")})

    def first(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        base, n, packer = task << 36, 0, Packer(length)
        for batch in batches:
            out: list = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = token_bytes(text if isinstance(text, str) else None, path)
                for w in packer.place((key(doc), len(ids) // 4), ids):
                    out += rows(w, base + n, False, task // FAN)
                    n += 1
            yield frame(out)
        out = []
        for _, w in packer.open:
            out += rows(w, base + n, True, task // FAN)
            n += 1
        yield frame(out)

    def second(batch):
        left = batch.sort_values(["sequence_id", "offset"])
        grp = int(batch["grp"].iloc[0])
        pieces = [((key(r.doc_id), r.doc_tokens), r.start, bytes(r.ids)) for r in left.itertuples()]
        out: list = []
        for n, w in enumerate(merge([pieces], length)):
            out += rows(w, (1 << 62) + (grp << 36) + n, False, grp)
        return frame(out)

    packed = materialise(docs.select("doc_id", "text").mapInPandas(first, schema))
    merged = packed.filter("ids is not null").groupBy("grp").applyInPandas(second, schema)
    return packed.filter("ids is null").unionByName(merged).drop("ids", "grp")
