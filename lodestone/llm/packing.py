"""Packing along a space-filling curve.

Documents are tokenised once into a written table, with a hashed bag-of-tokens vector projected to
three coordinates. The coordinates, standardised over the whole corpus, give a Hilbert key. A histogram
of tokens by key prefix says at which global token position each stretch of the curve starts, so one
shuffle brings the documents into curve order and every task cuts its stretch by itself. A stretch with
more tokens than a partition should hold is split on more bits of the key, and by a hash of the row only
where all keys are equal (a hot group of copies).
"""

from __future__ import annotations

import json
import math
import re
from array import array
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm.bpe import byte_letters, latin
from lodestone.llm.common import Memo, Scratch, chunks, held, id_and_text
from lodestone.llm.words import mix

DIMS, BITS, CELL_BITS, HASHED = 3, 16, 15, 256
#: Bits of the key that a heavy stretch splits on at once, fewer where that would make more than so many new cells.
STEP_BITS, NEW_CELLS = 11, 1 << 20
#: Bytes of ids in a partition; with more than so many partitions they grow instead, so the table of stretches is bounded.
PARTITION_BYTES, MOST_PARTITIONS = 64 << 20, 1 << 17
#: The word pattern of the tokenizer whose words are memoised here.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Beyond these characters lower-casing or classes differ between libraries, so the library does it all.
UNUSUAL = re.compile("[^\t-\r\x20-\x7e\xa0-įı-ɏ]")


class WordEncoder:
    """Ids of whole texts as the tokenizers library gives them, with a memo of words where that is exact."""

    def __init__(self, path: str, memo: int = 150_000) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.width = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.code = "H" if self.width == "<u2" else "I"
        self.size = self.tokenizer.get_vocab_size()
        self.added = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)")
        letters, numbers = latin("L"), latin("N")
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\\s{letters}{numbers}]+")
        self.letters = byte_letters()
        own = json.loads(self.tokenizer.to_str())
        kinds = [x["type"] for x in (own["normalizer"] or {}).get("normalizers", [])]
        patterns = [x.get("pattern", {}).get("Regex") for x in (own["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.exact = kinds == ["NFC", "Replace", "Lowercase"] and patterns == [WORD_PATTERN, None] and own["post_processor"] is None
        self.memo = Memo(self.word, memo)

    def word(self, word: str) -> bytes:
        """The ids of one word. The bytes of its ASCII stand for themselves: words here have no blanks or controls."""
        told = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
        return array(self.code, [t.id for t in self.tokenizer.model.tokenize(told)]).tobytes()

    def encode(self, text: str) -> bytes:
        if self.exact and UNUSUAL.search(text) is None and self.added.search(text) is None:
            return b"".join(map(self.memo.__getitem__, self.words.findall(text.lower())))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.width).tobytes()


def encoder(path: str) -> WordEncoder:
    return held(WordEncoder, path)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert keys of integer points (rows) with `bits` bits a coordinate."""
    axes = [points[:, i].astype(np.int64) for i in range(points.shape[1])]
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for i in range(len(axes)):
            high = (axes[i] & level) != 0
            swap = (axes[0] ^ axes[i]) & low
            axes[0] = np.where(high, axes[0] ^ low, axes[0] ^ swap)
            axes[i] = np.where(high, axes[i], axes[i] ^ swap) if i else axes[0]
        level >>= 1
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    turn, level = np.zeros_like(axes[0]), 1 << (bits - 1)
    while level > 1:
        turn = np.where(axes[-1] & level, turn ^ (level - 1), turn)
        level >>= 1
    key = np.zeros_like(axes[0])
    for bit in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << 1) | (((axis ^ turn) >> bit) & 1)
    return key


def tokenised(df: DataFrame, tokenizer_path: str, end_id: int, seed: int) -> DataFrame:
    """doc_id, row, ids (binary), n_tokens and the coordinates c0.. of each document."""

    def run(batches):
        enc = encoder(tokenizer_path)
        rng = np.random.default_rng(seed)
        slot = rng.integers(0, HASHED, max(enc.size, end_id + 1))
        project = rng.standard_normal((HASHED, DIMS))
        end = np.array([end_id], enc.width).tobytes()
        for batch in batches:
            for part in chunks(batch, "text"):
                ids = [enc.encode(x) + end for x in part.column("text").to_pylist()]
                sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // np.dtype(enc.width).itemsize
                slots = np.repeat(np.arange(len(ids)) * HASHED, sizes) + slot[np.frombuffer(b"".join(ids), enc.width)]
                bags = np.log1p(np.bincount(slots, minlength=len(ids) * HASHED)).reshape(-1, HASHED)
                at = bags @ project / np.sqrt((bags**2).sum(axis=1))[:, None]
                columns = [part.column("doc_id").cast(pa.int64()), part.column("row"), pa.array(ids, pa.binary()), pa.array(sizes), *(pa.array(at[:, k]) for k in range(DIMS))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "ids", "n_tokens", *(f"c{k}" for k in range(DIMS))])

    schema = "doc_id long, row long, ids binary, n_tokens long, " + ", ".join(f"c{k} double" for k in range(DIMS))
    return df.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, schema)


class Curve:
    """Hilbert keys, and the stretch of the curve (cell, part) that a row belongs to."""

    def __init__(self, means: list[float], spreads: list[float]) -> None:
        self.means, self.spreads = np.array(means), np.array(spreads)
        self.bits = np.full(1 << CELL_BITS, DIMS * BITS - CELL_BITS)  # of the key that vary within a cell
        self.begins = np.arange(1 << CELL_BITS) << self.bits  # the least key of each cell
        self.parts = np.ones(1 << CELL_BITS, np.int64)

    def split(self, tokens: dict[tuple[int, int], int], most: int) -> bool:
        """Split cells with more than `most` tokens, on the key while it has bits left, and drop empty ones; whether there were any."""
        held = np.array(sorted((cell, n) for (cell, _), n in tokens.items()), np.int64).reshape(-1, 2)
        begins, bits = self.begins[held[:, 0]], self.bits[held[:, 0]]
        heavy = held[:, 1] > most
        step = min(STEP_BITS, max(1, int(math.log2(NEW_CELLS / max(1, np.count_nonzero(heavy))))))
        fewer = np.where(heavy, np.maximum(bits - step, 0), bits)
        if (fewer == bits).all():
            return False
        children = 1 << (bits - fewer)
        owner = np.repeat(np.arange(len(held)), children)
        child = np.arange(len(owner)) - np.repeat(np.cumsum(children) - children, children)
        self.begins, self.bits = begins[owner] + (child << fewer[owner]), fewer[owner]
        self.parts = np.ones(len(owner), np.int64)
        return True

    def deal(self, tokens: dict[tuple[int, int], int], most: int) -> bool:
        """Deal cells that are still heavy, whose keys are all equal, to parts; whether there were any."""
        heavy = {cell: -(-2 * n // most) for (cell, _), n in tokens.items() if n > most}
        for cell, n in heavy.items():
            self.parts[cell] = n
        return bool(heavy)

    def keys(self, batch: pa.RecordBatch) -> np.ndarray:
        at = np.stack([batch.column(f"c{k}").to_numpy(zero_copy_only=False) for k in range(DIMS)], axis=1)
        level = 1 / (1 + np.exp(np.clip(-1.702 * (at - self.means) / self.spreads, -40, 40)))
        return hilbert(np.minimum((level * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))

    def stretch(self, batch: pa.RecordBatch, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = np.searchsorted(self.begins, keys, "right") - 1
        rows = mix(batch.column("row").to_numpy(zero_copy_only=False).astype(np.uint64))
        return cell, (rows % self.parts[cell].astype(np.uint64)).astype(np.int64)

    def histogram(self, table: DataFrame) -> dict[tuple[int, int], int]:
        """Tokens by stretch; at most one entry a cell or part that has rows."""

        def run(batches):
            for batch in batches:
                keys = self.keys(batch)
                cell, part = self.stretch(batch, keys)
                found, back = np.unique(cell << 32 | part, return_inverse=True)
                tokens = np.zeros(len(found), np.int64)
                np.add.at(tokens, back, batch.column("n_tokens").to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(tokens)], ["stretch", "tokens"])

        sums = table.select("row", "n_tokens", *(f"c{k}" for k in range(DIMS))).mapInArrow(run, "stretch long, tokens long").groupBy("stretch").agg(F.sum("tokens").alias("tokens"))
        return {divmod(r.stretch, 1 << 32): r.tokens for r in sums.collect()}


def pack(df: DataFrame, tokenizer_path: str, *, length: int = 2048, end_id: int = 1, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents in sequences of at most `length` tokens, one row a piece.

    Columns: doc_id, start and length (in the document's ids), ids (binary, little-endian uint32),
    doc_tokens, sequence_id, offset. Each document is its ids followed by `end_id`; null and empty texts
    are that id alone. Every sequence is full but the last ones, which are powers of two and so need no
    padding. Repeated rows are packed each; ties of the key go by row; other columns are not read; an
    empty table gives no piece. What the driver collects and broadcasts is a row for each stretch: at most
    2^15 cells, three a partition, of which there are MOST_PARTITIONS at most, and NEW_CELLS while cells split.
    Ids are numbers; a null id stays null.
    """
    spark = df.sparkSession
    table = Scratch(spark, "pack").write(tokenised(id_and_text(df, id_col, text_col), tokenizer_path, end_id, seed), "tokens")
    stats = table.agg(F.sum("n_tokens").alias("total"), *(f(f"c{k}").alias(f"{n}{k}") for k in range(DIMS) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    total = stats["total"] or 0
    curve = Curve([stats[f"m{k}"] or 0.0 for k in range(DIMS)], [stats[f"s{k}"] or 1.0 for k in range(DIMS)])
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTITIONS, -(-total * 4 // PARTITION_BYTES)))
    most = max(1, total // count)
    tokens = curve.histogram(table)
    while curve.split(tokens, most):
        tokens = curve.histogram(table)
    if curve.deal(tokens, most):
        tokens = curve.histogram(table)
    order = sorted(tokens)
    numbers = np.array([cell << 32 | part for cell, part in order], np.int64)
    starts = np.cumsum([0, *(tokens[x] for x in order)])
    stretches = spark.sparkContext.broadcast((numbers, starts, np.minimum(starts[:-1] // most, count - 1).astype(np.int32)))

    def deal(batches):
        numbers, _, owners = stretches.value
        for batch in batches:
            keys = curve.keys(batch)
            cell, part = curve.stretch(batch, keys)
            group = np.searchsorted(numbers, cell << 32 | part)
            columns = [pa.array(owners[group]), pa.array(group.astype(np.int64)), pa.array(keys), *(batch.column(x) for x in ("row", "doc_id", "ids", "n_tokens"))]
            yield pa.RecordBatch.from_arrays(columns, ["owner", "stretch", "key", "row", "doc_id", "ids", "n_tokens"])

    full = total // length
    rest = [1 << b for b in range(length.bit_length(), -1, -1) if (total - full * length) >> b & 1]
    edges = [full * length, *(full * length + sum(rest[: i + 1]) for i in range(len(rest)))]

    def cut(batches):
        starts = stretches.value[1]
        at, stretch = 0, -1
        for batch in batches:
            out: list[tuple] = []
            waiting = 0
            for doc, group, raw, size in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "stretch")), batch.column("ids"), batch.column("n_tokens").to_pylist(), strict=True):
                if group != stretch:
                    stretch, at = group, int(starts[group])
                buffer, start = raw.as_buffer(), 0
                ids = np.frombuffer(buffer, f"<u{buffer.size // size}").astype("<u4").tobytes()
                while start < size:
                    if at < edges[0]:
                        sequence, offset = divmod(at, length)
                        room = length - offset
                    else:
                        k = bisect_right(edges, at) - 1
                        sequence, offset, room = full + k, at - edges[k], edges[k + 1] - at
                    n = min(room, size - start)
                    out.append((doc, start, n, ids[4 * start : 4 * (start + n)], size, sequence, offset))
                    start, at, waiting = start + n, at + n, waiting + 4 * n
                if waiting > 8 << 20:
                    yield rows(out)
                    out, waiting = [], 0
            if out:
                yield rows(out)

    def rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)], PIECE_NAMES)

    dealt = table.mapInArrow(deal, "owner int, stretch long, key long, row long, doc_id long, ids binary, n_tokens long")
    dealt = dealt.repartitionById(count, F.col("owner")).sortWithinPartitions("stretch", "key", "row")
    return dealt.select("doc_id", "stretch", "ids", "n_tokens").mapInArrow(cut, PIECES)


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
PIECE_NAMES = [x.split()[0] for x in PIECES.split(", ")]
