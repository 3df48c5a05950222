"""Problem 8: encoding of every text with a public byte-level BPE tokenizer.

The encoder takes, at each position, the longest token that matches there (found for all positions at once by an
Aho-Corasick automaton) and keeps it if the pair with the token before it is compatible, that is, if the merges would
have produced just these two neighbours. Otherwise it tries the next shorter token, and where none is left it steps back
one token; a bit per position keeps it from trying a position twice, so the work is linear in the text. The result is
exactly that of the merges. Decoding copies slices of one byte string by an offset table.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Folder of the public vocabularies; a parameter of every function here.
TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"
#: Fixed value: how the public tokenizer splits text before its merges. \s is written as the property it means there.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Entries a worker remembers; the store is emptied when full, which changes no result.
REMEMBERED = 200_000


class ByteBpe:
    """One rank file, ready to encode and decode. Ranks are the ids; strings like special tokens are ordinary text."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import regex

        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.words = {base64.b64decode(a): int(b) for a, b in pairs}
        by_id = sorted((i, w) for w, i in self.words.items())
        self.offsets, blob = [0] * (by_id[-1][0] + 2), bytearray()
        at = 0
        for i, w in by_id:
            while at <= i:
                self.offsets[at] = len(blob)
                at += 1
            blob += w
        self.offsets[at] = len(blob)
        self.blob = bytes(blob)
        self.size = {i: len(w) for i, w in by_id}
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.shorter: dict[int, int] = {}
        self.automaton = ahocorasick.Automaton()
        for i, w in by_id:
            self.automaton.add_word(w.decode("latin-1"), i)
            self._learn(i, w)
        self.automaton.make_automaton()
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}

    def _learn(self, i: int, w: bytes) -> None:
        for cut in range(len(w) - 1, 0, -1):
            if (left := self.words.get(w[:cut])) is not None:
                self.shorter[i] = left
                break
        self.halves[i] = (i, i)
        for cut in range(1, len(w)):
            a, b = self.words.get(w[:cut]), self.words.get(w[cut:])
            if a is not None and b is not None and a < i and b < i and self.compatible(a, b):
                self.halves[i] = (a, b)
                self.joined[a, b] = i
                break

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave a and b side by side: no merge across the border comes before those that built a and b."""
        bound = 1 << 60
        while True:
            across = self.joined.get((a, b))
            if across is not None and across < bound:
                return False
            if a > b:
                bound = a
                a = self.halves[a][1]
                if a == bound:
                    bound = b + 1
                    b = self.halves[b][0]
                    if b + 1 == bound:
                        return True
            else:
                bound = b + 1
                b = self.halves[b][0]
                if b + 1 == bound:
                    bound = a
                    a = self.halves[a][1]
                    if a == bound:
                        return True

    def encode_piece(self, raw: bytes) -> list[int]:
        """The ids of one piece, exactly as its merges give them."""
        whole = self.words.get(raw)
        if whole is not None and len(raw) < 2:
            return [whole]
        n, text = len(raw), raw.decode("latin-1")
        longest = [-1] * n
        for end, i in self.automaton.iter(text):
            start = end + 1 - self.size[i]
            if longest[start] < 0 or self.size[i] > self.size[longest[start]]:
                longest[start] = i
        open_at = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            end = at + self.size[token]
            if open_at[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                if at == n:
                    return out
                token = longest[at]
            elif token in self.shorter:
                token = self.shorter[token]
            else:
                open_at[at] = 0
                token = out.pop()
                at -= self.size[token]
                # the token stepped back to is tried again with its end now closed

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; null and empty give an empty list."""
        if not text:
            return []
        out: list[int] = []
        known = self.known
        for piece in self.split(text):
            ids = known.get(piece)
            if ids is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                ids = self.encode_piece(piece.encode("utf-8"))
                if len(piece) <= 64:
                    known[piece] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; decode(encode(t)) == t for every t."""
        b, o = self.blob, self.offsets
        return b"".join([b[o[i] : o[i + 1]] for i in ids]).decode("utf-8", errors="replace")


_LOADED: dict[str, ByteBpe] = {}


def tokenizer(name: str = BYTE_BPE_50K, folder: str = TOKENIZER_DIR) -> ByteBpe:
    """The tokenizer of a rank file, built once per Python process."""
    path = os.path.join(folder, name)
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def _sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Small slices, so that a batch of very long texts doesn't stand in memory as ids all at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def encode_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", name: str = BYTE_BPE_50K, folder: str = TOKENIZER_DIR) -> DataFrame:
    """``id_column`` and ``ids`` (array of int) of each row, without special tokens; null and empty texts have an empty list.

    One row per input row, repeats included; other columns are not read. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(name, folder)
        for b in _sliced(batches):
            ids = pa.array([t.encode(x) for x in b.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], ["id", "ids"])

    picked = docs.select(docs[id_column].alias("id"), docs[text_column].cast("string").alias("text"))
    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_column)


def count_tokens(docs: DataFrame, text_column: str, name: str = BYTE_BPE_50K, folder: str = TOKENIZER_DIR) -> DataFrame:
    """All columns of ``docs`` but the text, with ``tokens`` (long); null and empty texts have none. No shuffle."""
    keep = [c for c in docs.columns if c != text_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(name, folder)
        for b in _sliced(batches):
            n = pa.array([len(t.encode(x)) for x in b.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], n], [*keep, "tokens"])

    picked = docs.select(*keep, text_column)
    fields = ", ".join(f"`{c}` {picked.schema[c].dataType.simpleString()}" for c in keep)
    return picked.mapInArrow(run, f"{fields}, tokens long")
