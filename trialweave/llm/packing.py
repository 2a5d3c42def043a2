"""Best-fit packing planned on the histogram of lengths."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.functions.ship import map_arrow
from trialweave.llm import bpe
from trialweave.llm.common import hex_bucket, ranked, saved, small_batches

CAPACITY = 2048
#: Plans up to this many entries are broadcast; longer ones are joined by a shuffle.
BROADCAST_PLAN = 200_000


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit over counts, longest lengths first.

    Items of one length are alike, and so are open sequences with the same room, so both
    are handled as counts and as ranges of sequence numbers.  Each entry is
    (length, first rank, items, items in each sequence, first sequence, offset): items with
    ranks from the first on fill that many places in each of consecutive sequences.
    """
    entries = []
    rooms: list[int] = []
    open_: dict[int, list[tuple[int, int]]] = {}
    made = 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append((first, n))

    for length in sorted(counts, reverse=True):
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} is not within 1 and {capacity}")
        left, rank = counts[length], 0
        while left:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                first, n = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(i)
            else:
                room, first = capacity, made
                n = -(-left // (capacity // length))
                made += n
            each = room // length
            full = min(n, left // each)
            for bins, k in ((full, each), (int(full < n and full * each < left), left - full * each)):
                if bins:
                    entries.append((length, rank, bins * k, k, first, capacity - room))
                    put(room - k * length, first, bins)
                    first, n, rank, left = first + bins, n - bins, rank + bins * k, left - bins * k
            put(room, first, n)
    return entries


def tokenized_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """``id``, ``piece``, ``start``, ``length``, ``ids_crc32``: each text's ids and ``end_id``, cut only beyond ``capacity``."""
    path = path or bpe.default_path()
    chosen = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        words = bpe.tokenizer(path)
        end, width = end_id.to_bytes(4, "little"), 4 * capacity
        for batch in small_batches(batches, 1):
            at, piece, start, length, crc = [], [], [], [], []
            for row, blocks in enumerate(words.encoded([t or "" for t in batch.column(1).to_pylist()])):
                raw = b"".join([b for block in blocks for b in block] + [end])
                for k, a in enumerate(range(0, len(raw), width)):
                    part = raw[a:a + width]
                    at.append(row)
                    piece.append(k)
                    start.append(a // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["id", "piece", "start", "length", "ids_crc32"])

    return map_arrow(chosen, run, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", digits: int = 2) -> DataFrame:
    """Pack all texts into few sequences of at most ``capacity`` tokens.

    The pieces are written once without their ids.  Their lengths' histogram, at most
    ``capacity`` rows, goes to the driver and is planned by :func:`plan`; a piece then takes
    its place by joining the plan on its rank within its length.  Ranks are dealt by
    (length, bucket of the id), so a length that a third of the pieces have is split.

    Returns ``id_col``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``,
    ``offset``, one row per piece.  A null or empty text is one piece of one token.  Rows
    that repeat an id are packed each on its own.  Other columns are not read.  An empty
    table gives an empty result.
    """
    pieces = saved(tokenized_pieces(docs, path, capacity, id_col, text_col))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    entries = plan(counts, capacity)
    slots = docs.sparkSession.createDataFrame(
        entries, "p_length long, p_rank long, p_items long, p_each long, p_first long, p_offset long")
    if len(entries) <= BROADCAST_PLAN:
        slots = F.broadcast(slots)
    places = ranked(pieces, "length", ["id", "piece", "ids_crc32"], hex_bucket(F.col("id"), digits), "rank")
    i = F.col("rank") - F.col("p_rank")
    met = places.join(slots, (F.col("length") == F.col("p_length")) & (i >= 0) & (i < F.col("p_items")))
    turn = F.floor(i / F.col("p_each")).cast("long")
    return met.select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", (F.col("p_first") + turn).alias("sequence_id"),
        (F.col("p_offset") + (i - turn * F.col("p_each")) * F.col("length")).alias("offset"))
