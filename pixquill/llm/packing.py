"""Best-fit packing of documents into token sequences of one capacity.

Only lengths matter for the packing, and there are at most ``capacity`` of them,
so the plan is made from the count of each length: a table of at most
``capacity`` rows, whatever the size of the corpus.  The plan says, for the
r-th piece of a length, which sequence and place it takes; rows find theirs by
a join with it and are never gathered.

Plan: pieces longer than a third of the capacity share a sequence with at most
one other such piece, so they are matched greedily, the longest with the
longest that still fits.  Shorter pieces follow by falling length, each into
the smallest gap that takes it, and open new sequences when no gap does.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import pick, rank_in_groups, slices, text_batches, trim

CAPACITY = 1024
END_ID = 2
ROWS_PER_CELL = 1_000
CACHE_CHUNKS = 200_000
#: Longer chunks are encoded each time, so the cache is bounded in bytes too.
CACHE_LENGTH = 64
#: Characters on which all versions of Unicode tables agree; a text with others goes to the library as a whole.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ſ"
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-\xb1\xb4-\xb8\xba\xbb\xbf-ſ\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]*").fullmatch
#: Where the pre-tokenizer cuts such texts.
CUT = re.compile(
    rf"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[0-9]+| ?[^\s0-9{LETTERS}]+|\s+(?!\S)|\s+"
).findall



# --- tokens -------------------------------------------------------------------


class ByteBpe(dict):
    """Token ids as the ``tokenizers`` file gives them; a dictionary from chunks of text to their ids as bytes.

    Text is cut where the byte-level pre-tokenizer cuts it.  A chunk is encoded
    once and then taken from the dictionary, which is emptied when it is full.
    ``ranks_path``, if given, is the same vocabulary as a rank file, with which
    single chunks are encoded faster.
    """

    def __init__(self, path: str, ranks_path: str | None = None):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.single = self.whole
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            # chunks are cut already: each is one piece
            own = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
            self.single = lambda chunk: array("I", own.encode_ordinary(chunk)).tobytes()

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if len(chunk) > CACHE_LENGTH:
            return self.single(chunk)
        if len(self) >= CACHE_CHUNKS:
            self.clear()
        found = self[chunk] = self.single(chunk)
        return found

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            packed = b""
        elif any(t in text for t in self.special) or not PLAIN(text):
            packed = self.whole(text)
        else:
            packed = b"".join(map(self.__getitem__, CUT(text)))
        return np.frombuffer(packed, np.uint32)


@lru_cache(maxsize=2)
def byte_bpe(path: str, ranks_path: str | None = None) -> ByteBpe:
    return ByteBpe(path, ranks_path)


def token_pieces(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    doc_id: str = "doc_id",
    text: str = "text",
    ranks_path: str | None = None,
) -> DataFrame:
    """``doc_id, piece, start, length, ids``: each document's tokens in pieces that fit.

    ``ids`` are little-endian unsigned 32-bit numbers.  A document is its tokens
    and ``end_id``; a null or empty text is ``end_id`` alone.  One longer than
    the capacity is cut into full pieces, but for the first one, which takes
    what is left over.
    """
    text_batches(docs.sparkSession)
    rows = pick(docs, doc_id=doc_id, text=text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = byte_bpe(tokenizer_path, ranks_path)
        for batch in slices(batches, "text"):
            owner, piece, start, size, blob = [], [], [], [], []
            for row, value in enumerate(batch.column("text").to_pylist()):
                ids = np.append(model.ids(value), np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity
                for k, at in enumerate(([0] if first else []) + list(range(first, len(ids), capacity))):
                    part = ids[at : at + capacity if k or not first else first]
                    owner.append(row)
                    piece.append(k)
                    start.append(at)
                    size.append(len(part))
                    blob.append(part.tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(blob, pa.binary()),
                ],
                ["doc_id", "piece", "start", "length", "ids"],
            )
        model.clear()
        trim()

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids binary")


# --- plan ---------------------------------------------------------------------


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, low, high, first, per, offset), for pieces ``low`` to ``high - 1`` of a length.

    Piece r of them goes to sequence ``first + (r - low) // per``, to place
    ``offset + (r - low) % per * length``.  The work depends on the number of
    lengths, not on the counts.
    """
    left = {n: c for n, c in counts.items() if c}
    used = dict.fromkeys(left, 0)
    out: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, number of sequences)
    total = 0

    def put(length: int, first: int, sequences: int, per: int, offset: int) -> None:
        n = sequences * per
        out.append((length, used[length], used[length] + n, first, per, offset))
        used[length] += n
        left[length] -= n

    def leave(gap: int, first: int, sequences: int) -> None:
        if gap and sequences:
            gaps.setdefault(gap, []).append((first, sequences))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        while left[n]:
            # the longest large piece that still fits beside this one
            mate = next((m for m in large if m <= capacity - n and (left[m] if m != n else left[m] > 1)), None)
            if mate is None:
                sequences = left[n]
                put(n, total, sequences, 1, 0)
                leave(capacity - n, total, sequences)
            else:
                sequences = left[n] // 2 if mate == n else min(left[n], left[mate])
                if mate == n:
                    put(n, total, sequences, 2, 0)
                else:
                    put(n, total, sequences, 1, 0)
                    put(mate, total, sequences, 1, n)
                leave(capacity - n - mate, total, sequences)
            total += sequences

    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        open_gaps = [g for g in gaps if g >= n]
        heapq.heapify(open_gaps)
        while left[n]:
            if open_gaps:
                gap = heapq.heappop(open_gaps)
                found = gaps.pop(gap)
            else:
                gap, found = capacity, [(total, -(-left[n] // (capacity // n)))]
                total += found[0][1]
            while found and left[n]:
                first, sequences = found.pop()
                per = min(gap // n, left[n])
                full = min(sequences, left[n] // per)
                put(n, first, full, per, capacity - gap)
                leave(gap - per * n, first, full)
                if full < sequences:
                    found.append((first + full, sequences - full))
            for first, sequences in found:
                leave(gap, first, sequences)
    return out


# --- places -------------------------------------------------------------------


def place(pieces: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` (with ``length`` and ``order`` columns) plus ``sequence_id`` and ``offset``.

    ``pieces`` is read twice and should be a written table.  Rows of a length
    are numbered inside cells of about ``ROWS_PER_CELL`` rows, so a length that
    a third of all rows have spreads over many tasks.  A null, zero or too long
    length is refused.
    """
    spark = pieces.sparkSession
    counts = dict(pieces.groupBy("length").agg(F.count(F.lit(1))).collect())  # one row per length: at most capacity
    if any(n is None or not 0 < n <= capacity for n in counts):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    if not counts:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("bigint"), "offset": F.lit(0).cast("bigint")})
    cells = [(n, -(-c // ROWS_PER_CELL)) for n, c in counts.items()]
    cut = F.broadcast(spark.createDataFrame(cells, "length bigint, _cells int"))
    slots = F.broadcast(
        spark.createDataFrame(plan(counts, capacity), "_n bigint, _low bigint, _high bigint, _first bigint, _per bigint, _offset bigint")
    )
    keyed = pieces.join(cut, "length").select(*pieces.columns, "_cells")
    # a length has one cell per ROWS_PER_CELL of its rows
    cell = F.pmod(F.xxhash64(*order), F.col("_cells")).cast("int")
    rest = [c for c in pieces.columns if c not in order and c != "length"]
    ranked = rank_in_groups(keyed, ["length"], cell, [*order, *rest], "_rank")
    return (
        ranked.join(slots, (F.col("length") == F.col("_n")) & (F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_high")))
        .select(
            *pieces.columns,
            (F.col("_first") + F.expr("(_rank - _low) div _per")).alias("sequence_id"),
            (F.col("_offset") + (F.col("_rank") - F.col("_low")) % F.col("_per") * F.col("length")).alias("offset"),
        )
    )


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    doc_id: str = "doc_id",
    text: str = "text",
    digest: bool = False,
    ranks_path: str | None = None,
) -> DataFrame:
    """``doc_id, piece, start, length, ids, sequence_id, offset``: all documents in packed sequences.

    With ``digest``, ``ids_crc32`` takes the place of ``ids``, for reports that
    need no tokens.  Repeated rows are packed each.
    """
    pieces = token_pieces(docs, tokenizer_path, capacity, end_id, doc_id, text, ranks_path)
    if digest:
        pieces = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return place(materialize(pieces, "pieces"), capacity)
