"""Byte-pair encoding with forced boundaries, and its decoding.

A pair of bytes that stands next to each other inside no token of the vocabulary can never be merged
over, so it marks a certain cut. Each pre-token is cut there, its fragments are encoded independently
and their ids concatenated. Pre-tokens come first because the pattern looks at its context.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from lodestone.llm.common import Memo, chunks, held, id_and_text

#: The pattern of byte-level pre-tokens.
PRETOKEN = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def latin(kind: str) -> str:
    """The characters below U+0250 of a general category, by its first letter."""
    return "".join(c for c in map(chr, range(0x250)) if unicodedata.category(c)[0] == kind)


#: The same pattern with classes written out, for texts of these characters alone: twice as fast.
LATIN_PRETOKEN = re.compile(PRETOKEN.pattern.replace(r"[^\s\p{L}\p{N}]", f"[^\\s{latin('L')}{latin('N')}]").replace(r"\p{L}", f"[{latin('L')}]").replace(r"\p{N}", f"[{latin('N')}]"))
BEYOND_LATIN = re.compile("[^\t-\r\x20-\x7e\xa0-ɏ]")
#: Characters that all Unicode versions class alike; texts with others are pre-tokenised by the library.
UNUSUAL = re.compile("[^\t-\r\x20-\x7e\xa0-ɏΑ-ΡΣ-ωА-я‐-‧一-龥]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class ForcedBoundaryBPE:
    def __init__(self, path: str, memo: int = 150_000) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        back = {letter: b for b, letter in enumerate(self.letters)}
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = {token.content: i for i, token in added.items()}
        self.added_split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        #: Added tokens that take blanks beside them, or stand for whole words only, are left to the library.
        self.odd_added = any(t.lstrip or t.rstrip or t.single_word for t in added.values())
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes_of: list[bytes] = [b""] * (max([*vocab.values(), *added]) + 1)
        self.inside = np.zeros((256, 256), bool)
        for token, i in vocab.items():
            raw = self.bytes_of[i] = bytes(back[x] for x in token)
            for pair in zip(raw, raw[1:], strict=False):
                self.inside[pair] = True
        for i, token in added.items():
            self.bytes_of[i] = token.content.encode()
        self.fragments = Memo(self.encode_fragment, memo // 4)
        self.pretokens = Memo(self.encode_pretoken, memo)

    def cut(self, raw: bytes) -> list[bytes]:
        """The fragments between forced boundaries."""
        values = np.frombuffer(raw, np.uint8)
        at = [0, *(np.flatnonzero(~self.inside[values[:-1], values[1:]]) + 1).tolist(), len(raw)]
        return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]

    def encode_fragment(self, raw: bytes) -> bytes:
        tokens = self.model.tokenize("".join([self.letters[b] for b in raw]))
        return np.array([t.id for t in tokens], "<i4").tobytes()

    def encode_pretoken(self, pretoken: str) -> bytes:
        raw = pretoken.encode()
        return b"".join([self.fragments[x] for x in self.cut(raw)]) if len(raw) > 24 else self.encode_short(raw)

    def encode_short(self, raw: bytes) -> bytes:
        """cut() without arrays, for the short pre-tokens that most are."""
        inside, at = self.inside, [0]
        at += [i for i in range(1, len(raw)) if not inside[raw[i - 1], raw[i]]]
        if len(at) == 1:
            return self.encode_fragment(raw)
        at.append(len(raw))
        return b"".join([self.fragments[raw[a:b]] for a, b in zip(at, at[1:], strict=False)])

    def split(self, text: str) -> list[str]:
        if BEYOND_LATIN.search(text) is None:
            return LATIN_PRETOKEN.findall(text)
        if UNUSUAL.search(text) is None:
            return PRETOKEN.findall(text)
        parts = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
        return [text[a:b] for _, (a, b) in parts]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian int32."""
        if self.added_split is None or self.added_split.search(text) is None:
            return b"".join(map(self.pretokens.__getitem__, self.split(text)))
        if self.odd_added:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<i4").tobytes()
        out = []
        for part in self.added_split.split(text):
            if part in self.added:
                out.append(self.added[part].to_bytes(4, "little"))
            elif part:
                out.extend(map(self.pretokens.__getitem__, self.split(part)))
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace")


def coder(path: str) -> ForcedBoundaryBPE:
    return held(ForcedBoundaryBPE, path)


def id_lists(found: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, found)]) // 4
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), "<i4")))


def encode_documents(df: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and ids (array of int) of its whole text.

    Null and empty texts have no ids. Strings of added tokens inside a text get their own id, as the
    library does by default. Repeated rows each give a row; other columns are not read; an empty table
    gives an empty result; very long texts are encoded whole.
    """

    def run(batches):
        encode = coder(tokenizer_path).encode
        for batch in batches:
            for part in chunks(batch, "text"):
                found = [encode(x) for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), id_lists(found)], ["doc_id", "ids"])

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """Adds `decoded`, the text that `ids` stand for; null ids decode as empty. Other columns are dropped but doc_id."""

    def run(batches):
        decode = coder(tokenizer_path).decode
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = [decode(x or []) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def round_trip(df: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids and decoded: encode_documents() and decode_documents() in one pass, so with one Python worker a task.

    Nulls, empty and long texts, repeated rows, other columns and empty tables are as for encode_documents().
    """

    def run(batches):
        own = coder(tokenizer_path)
        for batch in batches:
            for part in chunks(batch, "text"):
                found = [own.encode(x) for x in part.column("text").to_pylist()]
                texts = [own.decode(np.frombuffer(x, "<i4").tolist()) for x in found]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), id_lists(found), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded string")
