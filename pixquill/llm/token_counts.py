"""Token counts by heap-and-linked-list byte-pair merging, without ids.

The vocabulary is a SentencePiece BPE model: an ordered list of pieces, where an
earlier piece merges first.  A text becomes the word mark U+2581 plus the text
with blanks turned into marks.  No piece has a mark after another character, so
merges never cross the start of a run of marks, and the text falls into chunks
that are counted alone; chunks seen before come from a bounded cache.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import pick, slices

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+", re.DOTALL)
CACHE_CHUNKS = 400_000
CACHED_LENGTH = 64


class PieceModel:
    """Merge ranks of a SentencePiece BPE model file with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [
            i for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        ]
        pieces = {model.id_to_piece(i): -model.get_score(i) for i in normal}
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece of the model crosses the start of a word")
        self.rank = pieces
        self.falls_back = any(model.is_byte(i) for i in range(model.get_piece_size()))
        self.longest = max(map(len, pieces))
        self.cache: dict[str, int] = {}

    def merges(self, chunk: str) -> int:
        """How often two neighbours merge: the pair of the lowest rank first, the leftmost of equals."""
        rank, n = self.rank, len(chunk)
        end = list(range(1, n + 1))  # a symbol spans [i, end[i]); its end is the next symbol
        before = list(range(-1, n))
        heap = [(rank[p], i, i + 2) for i in range(n - 1) if (p := chunk[i : i + 2]) in rank]
        heapq.heapify(heap)
        alive = bytearray(b"\x01") * n
        done = 0
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or (j := end[i]) >= n or end[j] != stop:
                continue  # one of the two has merged with another since
            done += 1
            alive[j] = 0
            end[i] = stop
            if stop < n:
                before[stop] = i
                if (p := chunk[i : end[stop]]) in rank:
                    heapq.heappush(heap, (rank[p], i, end[stop]))
            left = before[i]
            if left >= 0 and (p := chunk[left:stop]) in rank:
                heapq.heappush(heap, (rank[p], left, stop))
        return done

    def symbols(self, chunk: str) -> int:
        """Symbols before merging: a character, or its UTF-8 bytes if the model lacks it."""
        if not self.falls_back:
            return len(chunk)
        return sum(1 if c in self.rank else len(c.encode()) for c in chunk)

    def chunk_tokens(self, chunk: str) -> int:
        found = self.cache.get(chunk)
        if found is None:
            found = self.symbols(chunk) - self.merges(chunk)
            if len(chunk) <= CACHED_LENGTH:
                if len(self.cache) >= CACHE_CHUNKS:
                    self.cache.clear()
                self.cache[chunk] = found
        return found

    def count(self, text: str | None) -> int:
        """Tokens of a whole text; none of a null or empty one."""
        if not text:
            return 0
        marked = MARK + text.replace(" ", MARK)
        return sum(map(self.chunk_tokens, CHUNK.findall(marked)))


@lru_cache(maxsize=4)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def count_tokens(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` for each row; 0 and 0 for a null or empty text.

    ``model_path`` is a SentencePiece BPE file that all executors have.  No row
    leaves its partition; repeated rows are counted each.
    """
    rows = pick(docs, doc_id=doc_id, text=text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for batch in slices(batches, "text"):
            size = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            tokens = pa.array([model.count(x) for x in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, tokens], ["doc_id", "n_bytes", "n_tokens"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
