"""Token counts by byte-pair merging with a heap over a linked list, without emitting identifiers.

A count is the number of initial symbols less the merges made, plus what byte fallback adds for
characters outside the vocabulary. A text is cut before each run of word marks where no piece of the
vocabulary reaches across, so segments merge independently and equal segments are counted once per worker.
"""

from __future__ import annotations

import heapq
import re

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Memo, chunks, held, id_and_text

MARK = "▁"
SEGMENT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
SCHEMA = "doc_id long, n_bytes long, n_tokens long"


def merges(symbols: str, costs: dict[str, float]) -> int:
    """How many merges a segment takes: the cheapest adjacent pair first, the leftmost of equal ones."""
    parts: list[str] = list(symbols)
    size = len(parts)
    before, after = list(range(-1, size - 1)), list(range(1, size + 1))
    heap = [(cost, i, parts[i] + parts[i + 1]) for i in range(size - 1) if (cost := costs.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    made = 0
    while heap:
        _, left, whole = heapq.heappop(heap)
        right = after[left]
        if not parts[left] or right >= size or len(parts[left]) + len(parts[right]) != len(whole):
            continue  # one of the two has been merged meanwhile
        parts[left], parts[right] = whole, ""
        made += 1
        after[left] = following = after[right]
        if following < size:
            before[following] = left
            if (cost := costs.get(pair := whole + parts[following])) is not None:
                heapq.heappush(heap, (cost, left, pair))
        if (previous := before[left]) >= 0 and (cost := costs.get(pair := parts[previous] + whole)) is not None:
            heapq.heappush(heap, (cost, previous, pair))
    return made


#: Texts that tell a model of other normalisation, or without byte fallback.
PROBES = ["", " ", "a", " a  b ", "a\tb\r\n c", "Å ﬁ ① İ", "日本語 \U0001f642", "\u00a0\u200b\u3000x", "▁", "a▁b", "\x00\x1c"]


class PieceCounter:
    """Counts pieces as a sentencepiece BPE model does, given identity normalisation and byte fallback, which is checked."""

    def __init__(self, path: str, memo: int = 200_000) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = range(model.get_piece_size())
        plain = [i for i in size if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.costs = {model.id_to_piece(i): -model.get_score(i) for i in plain}
        self.splits = not any(re.search(f"[^{MARK}]{MARK}", piece) for piece in self.costs)
        self.by_line = self.splits and not any("\n" in piece for piece in self.costs)
        self.bare = Memo(self.segment, memo)
        self.marked = Memo(lambda word: self.segment(MARK + word), memo)
        if wrong := [x for x in PROBES if self.count(x) != len(model.encode(x))]:
            raise ValueError(f"{path} is no model of identity normalisation and byte fallback: it counts {wrong[0]!r} otherwise")

    def segment(self, symbols: str) -> int:
        beyond = sum(len(x.encode()) - 1 for x in symbols if x not in self.costs)
        return len(symbols) - merges(symbols, self.costs) + beyond

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.by_line or MARK in text or "  " in text or text[0] == " ":
            whole = MARK + text.replace(" ", MARK)
            return sum(map(self.segment, SEGMENT.findall(whole))) if self.splits else self.segment(whole)
        total, bare, marked = -1, self.bare, self.marked
        for i, line in enumerate(text.split("\n")):
            first, *rest = line.split(" ")
            total += 1 + (bare[first] if i else marked[first]) + sum(map(marked.__getitem__, rest))
        return total


def counter(path: str) -> PieceCounter:
    return held(PieceCounter, path)


def count_tokens(df: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8) and n_tokens of its whole text.

    Null and empty texts count 0. Repeated rows each give a row; other columns are not read, so their
    names cannot clash; an empty table gives an empty result. A text is never cut short: one without
    spaces is a single segment, merged in O(n log n).
    """

    def run(batches):
        count = counter(model_path).count
        for batch in batches:
            for part in chunks(batch, "text"):
                texts = part.column("text")
                ids = part.column("doc_id").cast(pa.int64())
                sizes = pa.compute.binary_length(texts).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([ids, sizes, pa.array([count(x) for x in texts.to_pylist()], pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return id_and_text(df, id_col, text_col).mapInArrow(run, SCHEMA)


def over_limit(counts: DataFrame, limit: int = 4096) -> DataFrame:
    """Adds over_limit: more than `limit` tokens. A null count is null; rows, ties and repeats stay as they are; an empty table stays empty."""
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
