"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

The encoder looks up the longest token at each place of a word with one Aho-Corasick pass
(over the reversed word, so that a match's end is its start). It takes the longest token
that is compatible with the token before it and, where none is, steps back. Two tokens are
compatible if the merges, in order of rank, of their joined text would not cross the border
between them; the answers are kept in a table. A sequence whose neighbours are all
compatible is the one that the merges give, and each place is ruled out at most once, so
the time is linear in the word.
"""

from __future__ import annotations

import hashlib
import json
import struct
import sys
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import small_batches, table

#: Words whose ids an executor's Python worker keeps at once.
CACHED_WORDS = 400_000

# White space by Unicode's property of that name, as the tokenizer file's \s means it.
SPACE = "\\t-\\r\\x20\\x85\\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Bpe:
    """Encoder and decoder for a BPE file with word ends, lower case and byte letters."""

    def __init__(self, spec: dict):
        model, self.suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split.replace(r"\s", SPACE)).findall
        letters = byte_letters()
        # Inside, a token is a string of 512 letters: a byte, plus 256 where the word ends.
        back = {c: chr(b) for b, c in enumerate(letters)}
        self.inner = {self._inside(t, back): i for t, i in vocab.items()}
        texts = {i: t for t, i in self.inner.items()}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.parts: list[tuple[int, int]] = [(i, i) for i in range(size)]
        self.merged: dict[tuple[int, int], int] = {}
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            i = vocab[a + b]
            self.parts[i] = (vocab[a], vocab[b])
            self.merged[vocab[a], vocab[b]] = i
        self.length = [len(texts.get(i, "")) for i in range(size)]
        self.shorter = [-1] * size  # the longest token that is a proper prefix
        self.find = ahocorasick.Automaton()
        for i, t in texts.items():
            self.find.add_word(t[::-1], i)
            self.shorter[i] = next((j for n in range(len(t) - 1, 0, -1) if (j := self.inner.get(t[:n])) is not None), -1)
        self.find.make_automaton()
        self.table: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        # Decoding: all tokens' bytes in one row, each followed by a space, and where they start.
        shown = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        row = [(shown.get(i, "") + " ").encode() for i in range(size)]
        self.blob = np.frombuffer(b"".join(row), dtype=np.uint8)
        self.offsets = np.r_[0, np.cumsum([len(x) for x in row])]

    def _inside(self, token: str, back: dict[str, str]) -> str:
        ends = token.endswith(self.suffix) and len(token) > len(self.suffix)
        bare = "".join(back[c] for c in (token.removesuffix(self.suffix) if ends else token))
        return bare[:-1] + chr(256 + ord(bare[-1])) if ends else bare

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the joined text of two tokens gives the two tokens."""
        key = a << 32 | b
        known = self.table.get(key)
        if known is None:
            if len(self.table) > 1_000_000:
                self.table.clear()
            known = self.table[key] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        # Undo the later of the two tokens' last merges, step by step. The border is crossed if
        # the two pieces at it merge before the step that is undone.
        before = len(self.parts) + 1
        while True:
            crossing = self.merged.get((a, b))
            if crossing is not None and crossing < before:
                return False
            left, right = self.parts[a], self.parts[b]
            whole_a, whole_b = left[1] == a, right[0] == b
            if whole_a and whole_b:
                return True
            if not whole_a and (whole_b or a > b):
                before, a = a, left[1]
            else:
                # A tie goes to the left merge, so a crossing of the same rank comes first.
                before, b = b + 1, right[0]

    def encode_word(self, inner: str) -> list[int]:
        n = len(inner)
        longest = [-1] * n
        for end, i in self.find.iter(inner[::-1]):  # of one end, the longest match comes first
            if longest[~end] < 0:
                longest[~end] = i
        out: list[int] = []
        open_ = bytearray(b"\x01") * (n + 1)  # places from which the rest may still be reached
        at, token = 0, longest[0]
        while True:
            placed = False
            while token >= 0:
                end = at + self.length[token]
                if open_[end] and (not out or self.compatible(out[-1], token)):
                    out.append(token)
                    at, placed = end, True
                    break
                token = self.shorter[token]
            if not placed:
                if not out:
                    raise ValueError("the vocabulary lacks a byte")
                open_[at] = 0
                token = out.pop()
                at -= self.length[token]
                token = self.shorter[token]
            elif at == n:
                return out
            else:
                token = longest[at]

    def _piece(self, piece: str) -> bytes:
        found = self.known.get(piece)
        if found is None:
            raw = piece.encode("utf-8", "surrogatepass")
            inner = raw.decode("latin-1")
            ids = self.encode_word(inner[:-1] + chr(256 + raw[-1]))
            found = struct.pack(f"<{len(ids)}I", *ids)
            if len(piece) <= 64:
                if len(self.known) >= CACHED_WORDS:
                    self.known.clear()
                self.known[piece] = found
        return found

    def _word(self, word: str) -> bytes:
        """Ids, four bytes each, of a stretch without ASCII white space."""
        plain = unicodedata.normalize("NFC", word).replace("Σ", "σ").lower()
        found = b"".join(map(self._piece, self.pieces(plain)))
        if len(self.words) >= CACHED_WORDS:
            self.words.clear()
        if len(word) <= 64:
            self.words[word] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        parts = self.cut_special.split(text) if self.cut_special and "<|" in text else [text]
        out: list[bytes] = []
        known, word = self.words.get, self._word
        for part in parts:
            if (i := self.special.get(part)) is not None:
                out.append(np.array([i], dtype="<u4").tobytes())
            else:
                for w in _stretches(part):
                    ids = known(w)
                    out.append(word(w) if ids is None else ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The tokens' text joined by a space, in UTF-8."""
        if not ids:
            return b""
        out = []
        every = np.frombuffer(ids, dtype="<u4")
        for at in range(0, len(every), 65_536):
            own = every[at : at + 65_536]
            start, size = self.offsets[own], self.offsets[own + 1] - self.offsets[own]
            place = np.repeat(start - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            out.append(self.blob[place].tobytes())
        return b"".join(out)[:-1]


_stretches = regex.compile(r"[^\t-\r\x20]+").findall


def cached_bpe(spec: bytes) -> Bpe:
    """One encoder for each Python worker and tokenizer file, whatever the number of tasks."""
    kept = sys.__dict__.setdefault("_folio_bpe", {})
    key = hashlib.sha256(spec).digest()
    if key not in kept:
        kept.clear()
        kept[key] = Bpe(json.loads(spec))
    return kept[key]


SCHEMA = "doc_id long, n_tokens long, ids binary, decoded string"


def encode_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids, decoded)`` of each row's whole text; ids are little-endian uint32.

    ``tokenizer`` is the path of the file on the driver; its content (under 2 MB) is sent to
    the tasks. Null texts count as empty: no ids, empty decoded text. Repeated rows each give
    a row, null doc_ids stay null, an empty table gives no rows, other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(tokenizer or default_tokenizer(), "rb") as f:
        spec = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = cached_bpe(spec.value)
        for batch in batches:
            ids = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array(ids, pa.binary()),
                    pa.array([bpe.decode(i).decode() for i in ids], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids", "decoded"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_documents(table(spark, sf_dir, "documents")))
