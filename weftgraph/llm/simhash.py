"""SimHash fingerprints and their exact near-duplicate graph by covering locality-sensitive hashing.

A covering family for radius r gives each bit position a vector of r + 1 bits; mask v (of 2^(r+1) - 1 non-zero ones)
keeps the positions whose vector has an odd inner product with v. The at most r positions in which two fingerprints
differ span at most r dimensions, so some v is orthogonal to them all and drops them: the two collide there. No link
within the radius is missed.

Equal fingerprints are first merged. Inside a bucket a breadth-first walk emits a spanning forest of the links, never
all pairs. A bucket with more than ``most`` different fingerprints goes an exact other way: two of them are within r
bits just if some third value is within r/2 bits of both, so each is linked with the least of those that share such
a value; that is linear in the bucket, and the bucket is never gathered.

Nulls: a null text has no words; null ids form groups as others do, and a group of them alone has a null component_id.
Very long texts are hashed whole. Ties go to the least doc_id. An empty table gives no rows; further columns are not
read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SHINGLE_WORDS = 4
SEED = 42
#: Shares the rows of a large bucket among tasks.
SALTS = 16


def fingerprint(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of a whole text, unsigned. No words (or null): 0."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > width:
        starts, ends = starts[: 1 - width], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends.tolist())])
    n, ones = len(starts), np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8 << 14):
        ones += np.unpackbits(np.frombuffer(hashes[at : at + (8 << 14)], np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, fp): fp holds the 64 bits as a signed long."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            fps = np.array([fingerprint(t.as_py()) for t in b[1]], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b[0], pa.array(fps)], names=["doc_id", "fp"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """2^(radius+1) - 1 masks; any two values within ``radius`` bits agree under at least one."""
    dims = radius + 1
    vectors = [1 + (i * 11) % ((1 << dims) - 1) for i in range(bits)]  # spread evenly over the non-zero vectors
    return [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() & 1) for v in range(1, 1 << dims)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links between the different values ``fps`` (uint64)."""
    rest, edges, queue = fps, [], []
    while len(rest) or queue:
        if not queue:
            queue, rest = [rest[0]], rest[1:]
        x = queue.pop()
        near = np.bitwise_count(rest ^ x) <= radius
        if near.any():
            found = rest[near]
            edges += [(int(x), int(y)) for y in found]
            queue += list(found)
            rest = rest[~near]
    return edges


def _links(radius: int):
    """For rows (mask, key, fp) sorted by bucket, none of them large: links (a, b)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None

        def out(a, b):
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        def solve(fps):
            edges = np.array(_forest(fps, radius), np.uint64).reshape(-1, 2).view(np.int64)
            return edges[:, 0].tolist(), edges[:, 1].tolist()

        for batch in parts:
            mask, key, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if carried is not None:
                mask, key, fp = (np.concatenate(x) for x in zip(carried, (mask, key, fp), strict=True))
            if not len(fp):
                continue
            new = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
            starts = np.concatenate(([0], new))
            last = starts[-1]  # the last bucket may go on in the next batch; it holds `most` rows at the most
            carried = mask[last:], key[last:], fp[last:]
            sizes = np.diff(starts)
            two = starts[:-1][sizes == 2]
            near = two[np.bitwise_count(fp[two].view(np.uint64) ^ fp[two + 1].view(np.uint64)) <= radius]
            a, b = fp[near].tolist(), fp[near + 1].tolist()
            for s, size in zip(starts[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                more_a, more_b = solve(fp[s : s + size].view(np.uint64))
                a += more_a
                b += more_b
            if a:
                yield out(a, b)
        if carried is not None and len(carried[2]) > 1:
            yield out(*solve(carried[2].view(np.uint64)))

    return run


def _half_radius_neighbours(radius: int, masks: list[int]):
    """For rows (fp, mask): all (mask, hub, fp) with hub within radius/2 bits of fp, changed outside of the mask only."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = {}
        for batch in parts:
            for fp, k in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                if k not in flips:
                    free = [i for i in range(64) if not masks[k] >> i & 1]
                    flips[k] = np.array([sum(1 << i for i in c) for n in range(radius // 2 + 1) for c in combinations(free, n)], np.uint64)
                hubs = (flips[k] ^ np.int64(fp).view(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hubs), k, np.int32)), pa.array(hubs), pa.array(np.full(len(hubs), fp, np.int64))], names=["mask", "hub", "fp"])

    return run


def near_duplicate_links(distinct: DataFrame, radius: int = 4, most: int = 4096) -> DataFrame:
    """Rows (a, b) whose components are those of all links within ``radius`` bits between different values ``fp``."""
    if radius % 2:
        raise ValueError("radius must be even")
    masks = covering_masks(radius)
    keyed = distinct.select(F.col("fp"), F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("mask", "key")).select("mask", "key", "fp")
    # sizes are summed before any row meets another, so no task gathers a large bucket
    sizes = keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n"))
    large = materialize(sizes.where(F.col("n") > most).select("mask", "key"))
    small, through = keyed, None
    if not large.isEmpty():
        marked = keyed.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))
        marked = marked.join(large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("hot", F.lit(True)), ["mask", "key", "salt"], "left")
        small = marked.where("hot IS NULL").select("mask", "key", "fp")
        hubs = marked.where("hot").select("fp", "mask").mapInArrow(_half_radius_neighbours(radius, masks), "mask int, hub long, fp long")
        # a hub has few values within half the radius, as many as there are flips at the most
        least = hubs.groupBy("mask", "hub").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).where("least < most")
        through = hubs.join(least, ["mask", "hub"]).where("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    found = small.repartition("mask", "key").sortWithinPartitions("mask", "key").mapInArrow(_links(radius), "a long, b long")
    return (found if through is None else found.unionByName(through)).distinct()


def near_duplicates(df: DataFrame, radius: int = 4, most: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, fp, component_id) for every row: documents joined by chains of links of at most ``radius`` bits.

    component_id is the least doc_id of the component. Texts without words have fingerprint 0 and are linked by it
    like others; repeated rows are repeated.
    """
    docs = materialize(fingerprints(df, id_col, text_col))
    groups = materialize(docs.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(near_duplicate_links(groups.select("fp"), radius, most))
    merged = materialize(groups.join(roots, groups.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    # written before it is joined, so that adaptive execution may split the rows of a large component, or of a fingerprint
    components = materialize(merged.groupBy("root").agg(F.min("least").alias("component_id")))
    by_fp = materialize(merged.select("fp", "root").join(components, "root").select("fp", "component_id"))
    return docs.join(by_fp, "fp").select("doc_id", "fp", "component_id")
