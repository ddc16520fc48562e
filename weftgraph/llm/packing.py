"""Best-fit decreasing packing of token sequences, exact over the whole corpus.

Lengths are whole numbers up to the capacity, so how best-fit decreasing fills bins depends only on how many pieces
there are of each length. The driver gets that histogram (at most ``capacity`` rows at any corpus size) and packs it:
a segment tree over remaining capacities finds the tightest open bin in O(log capacity), and bins of the same content
are handled together as a class with a count, so the plan too stays small however many bins there are. Spark then
ranks the pieces of each length and places rank by rank with a join on ranges of ranks. Every piece is placed, and
the result is that of best-fit decreasing over all pieces at once.

A null or empty text is one piece of one token, and a null id stays null. Very long texts are cut, never shortened.
Repeated rows are packed each. Pieces of equal length are interchangeable, so ties change no number of bins. An empty
table gives no rows; further columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import batches, worker_encoder
from .common import materialize

SEPARATOR = 0


def token_pieces(df: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32): each document's ids and a final 0, longer ones cut.

    A document of more than ``capacity`` tokens is cut so that only its first piece is shorter. Null is an empty
    text: one piece of one token.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_encoder(tokenizer).bpe.encode

        def rows():
            for b in parts:
                for doc, text in zip(b[0].to_pylist(), b[1], strict=True):
                    ids = encode(text.as_py() or "") + SEPARATOR.to_bytes(4, "little")
                    n = len(ids) // 4
                    start, end, piece = 0, n % capacity or capacity, 0
                    while start < n:
                        yield doc, piece, start, end - start, zlib.crc32(memoryview(ids)[4 * start : 4 * end])
                        start, end, piece = end, end + capacity, piece + 1

        yield from batches(rows(), schema, most_rows=20_000)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


class TightestBin:
    """A segment tree over remaining capacities 0..n: which have open bins, and the least one that is at least r."""

    def __init__(self, n: int):
        self.leaves = 1 << n.bit_length()
        self.any = [False] * (2 * self.leaves)

    def mark(self, r: int, open_: bool) -> None:
        at = self.leaves + r
        self.any[at] = open_
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def least_from(self, r: int) -> int | None:
        at = self.leaves + r
        if self.any[at]:
            return r
        while at > 1:
            if at % 2 == 0 and self.any[at + 1]:  # the right sibling holds the next larger capacities
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Bin classes (number of bins, lengths in order of placing) for ``histogram`` of piece lengths."""
    open_bins: dict[int, list[tuple[int, tuple]]] = {}
    tree = TightestBin(capacity)

    def put(r: int, count: int, content: tuple) -> None:
        open_bins.setdefault(r, []).append((count, content))
        tree.mark(r, True)

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            r = tree.least_from(length)
            if r is None:  # new bins, each filled before the next is opened
                each = capacity // length
                if full := left // each:
                    put(capacity - each * length, full, ((length, each), None))
                if part := left % each:
                    put(capacity - part * length, 1, ((length, part), None))
                break
            count, content = open_bins[r].pop()
            each = min(r // length, left)  # what is left of the tightest bin stays the tightest while it fits
            used = min(count, left // each)
            if used < count:
                open_bins[r].append((count - used, content))
            elif not open_bins[r]:
                tree.mark(r, False)
            put(r - each * length, used, ((length, each), content))
            left -= used * each
    classes = []
    for stack in open_bins.values():
        for count, content in stack:
            lengths = []
            while content:
                (length, each), content = content
                lengths.append([length] * each)
            classes.append((count, [x for part in reversed(lengths) for x in part]))
    return classes


def slot_runs(classes: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, ranks, first bin, offset): rank k of a run goes to its bin first + k."""
    taken: dict[int, int] = {}
    runs, first_bin = [], 0
    for count, lengths in classes:
        offset = 0
        for length in lengths:
            runs.append((length, taken.get(length, 0), count, first_bin, offset))
            taken[length] = taken.get(length, 0) + count
            offset += length
        first_bin += count
    return runs


def pack(pieces: DataFrame, capacity: int = 2048, part_rows: int = 200_000) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece and length (1 to ``capacity``).

    ``pieces`` is read twice: give it materialized. Pieces of one length are ranked in parts of about ``part_rows`` that are
    hashed from the document, as many as the most frequent length needs, so no task ranks a whole frequent length. Which of several pieces
    of the same length goes where is a matter of the ranks. No pieces: no rows.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    parts = 16 + max(histogram.values(), default=0) // part_rows
    rows = pieces.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int"))
    counts = rows.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    firsts = counts.withColumn("_first", F.sum("_n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    runs = slot_runs(best_fit_decreasing(histogram, capacity))
    by_length: dict[int, list] = {}
    for length, first, ranks, bin_, offset in runs:
        by_length.setdefault(length, []).append((first, ranks, bin_, offset))
    starts = {k: [x[0] for x in v] for k, v in by_length.items()}
    ranked = (
        rows.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_part").orderBy("doc_id", "piece")) - 1)
        .join(firsts.select("length", "_part", F.coalesce("_first", F.lit(0)).alias("_first")), ["length", "_part"])
        .withColumn("_rank", F.col("_rank") + F.col("_first"))
    )
    plan = spark.sparkContext.broadcast((starts, by_length))  # bounded by the number of distinct lengths, not by rows
    own = [f for f in pieces.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own) + ", sequence_id long, offset long"

    def place(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, by_length = plan.value
        for b in batches_:
            bins, offsets = [], []
            for length, rank in zip(b["length"].to_pylist(), b["_rank"].to_pylist(), strict=True):
                first, _, bin_, offset = by_length[length][bisect_right(starts[length], rank) - 1]
                bins.append(bin_ + rank - first)
                offsets.append(offset)
            names = [f.name for f in own]
            yield pa.RecordBatch.from_arrays([*(b[n] for n in names), pa.array(bins, pa.int64()), pa.array(offsets, pa.int64())], names=[*names, "sequence_id", "offset"])

    return ranked.select(*[f.name for f in own], "_rank").mapInArrow(place, schema)


def pack_documents(df: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cuts and packs documents: rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    return pack(materialize(token_pieces(df, tokenizer, capacity, id_col, text_col)), capacity)
