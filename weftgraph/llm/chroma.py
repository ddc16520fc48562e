"""Chroma audio fingerprints of a media column, and their alignment.

Samples become frames, frames become the energies of the twelve pitch classes. Sixteen filters, rectangles whose sums
an integral image gives in constant time, compare parts of that image around each frame; each is quantized to two
Gray-coded bits, and the 32 bits are one packed integer per frame. Two recordings are aligned by the histogram of
offsets at which their keys are equal, and judged by the share of differing bits over the overlap. A key holds the even
or the odd filters of two integers APART frames from each other, so noise that moves filters of one half leaves the
other half's vote. A vote counts only if the integers at LATER frames differ in at most MOST_BITS bits, which chance
pairs of equal keys hardly ever meet. A run of equal keys votes once, and again at every EVERY-th frame; where both
halves are equal the even one votes. All this is tested inside the join, so its rows are few for strangers, and a
handful for a pair of copies.

Overlaps under LEAST_OVERLAP frames are no alignments: of 210 000 overlaps of unrelated renderings the least error was
0.09 at 8 frames, 0.13 at 16, 0.23 at 32 and 0.24 at 48, so short ones pass an error of 0.2 by chance.

Nulls: a null, too short or unreadable recording has no frames and aligns with none; a null id is a row like others, but a
class of nulls alone is matched with none.
Very long recordings are read whole, in blocks of frames. Exact copies are one class, and repeated rows get the same
matches. Of offsets with equally many votes the one nearest to zero is taken, then the lesser. An empty table gives
no rows; further columns are not read, whatever their names.
"""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

FRAME, HOP = 1024, 256
#: (kind, lowest pitch class, classes, frames) of the filters, from a rule that spreads kinds and sizes.
FILTERS = [(k % 6, (5 * k) % 8, 2 + k % 3 if k % 6 != 4 else 3, (2, 4, 6, 8)[k % 4]) for k in range(16)]
#: Quantizer steps of log ratios; kind 0 is a plain sum and is compared with the mean energy.
STEPS = (-0.25, 0.0, 0.25)
GRAY = (0, 1, 3, 2)
WIDEST = max(f[3] for f in FILTERS)
#: Frames between the two integers of a key: at 4, and as one key of whole integers, noisy copies within most_error were lost.
APART = 3
#: Frames after a key's first whose integers are compared before a vote counts, and the bits of them that may differ.
LATER = (6, 14, 22, 30)
MOST_BITS = 28
EVERY = 16
LEAST_OVERLAP = 48


#: Errors by which a decoder tells that a value cannot be read.
BROKEN = (ValueError, EOFError, wave.Error, struct.error)


def read_wav(data: bytes) -> tuple[np.ndarray, int]:
    """Mono samples in -1..1 and the rate of a 16-bit PCM WAV file."""
    with wave.open(io.BytesIO(data)) as w:
        if w.getsampwidth() != 2:
            raise ValueError("16-bit PCM only")
        samples = np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(np.float32) / 32768
        return samples.reshape(-1, w.getnchannels()).mean(axis=1), w.getframerate()


_CLASSES: dict[int, np.ndarray] = {}


def _classes(rate: int) -> np.ndarray:
    if rate not in _CLASSES:
        freq = np.fft.rfftfreq(FRAME, 1 / rate)
        use = (freq >= 100) & (freq <= min(3500, rate / 2))
        pitch = np.round(12 * np.log2(np.where(use, freq, 440) / 440)).astype(int) % 12
        m = np.zeros((len(freq), 12), np.float32)
        m[np.flatnonzero(use), pitch[use]] = 1
        _CLASSES[rate] = m
    return _CLASSES[rate]


_WINDOW = np.hanning(FRAME).astype(np.float32)


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """Frames x 12 pitch-class energies, smoothed over five frames and scaled to unit length; silence is zero."""
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    out = np.zeros((len(frames), 12))
    for at in range(0, len(frames), 512):  # bounded memory for long recordings
        spectrum = np.abs(np.fft.rfft(frames[at : at + 512] * _WINDOW, axis=1)) ** 2
        out[at : at + 512] = spectrum @ _classes(rate)
    padded = np.pad(out, ((2, 2), (0, 0)), mode="edge")
    out = sum(c * padded[i : i + len(out)] for i, c in enumerate((0.25, 0.75, 1.0, 0.75, 0.25)))
    norm = np.sqrt((out**2).sum(axis=1, keepdims=True))
    return np.where(norm > 1e-4, out / np.maximum(norm, 1e-9), 0.0)


def fingerprint(samples: np.ndarray, rate: int) -> np.ndarray:
    """Packed uint32 per frame; recordings shorter than the widest filter have none."""
    image = chroma(samples, rate)
    n = len(image) - WIDEST + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    integral = np.zeros((len(image) + 1, 13))
    integral[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)
    t = np.arange(n)

    def area(t0, t1, y0, y1):
        return integral[t + t1, y1] - integral[t + t0, y1] - integral[t + t1, y0] + integral[t + t0, y0]

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in FILTERS:
        all_, hw, hh = area(0, w, y, y + h), w // 2, h // 2
        if kind == 0:
            a, b = all_ * 12, area(0, w, 0, 12) * h
        elif kind == 1:
            a, b = area(0, w, y, y + hh), area(0, w, y + h - hh, y + h)
        elif kind == 2:
            a, b = area(0, hw, y, y + h), area(hw, w, y, y + h)
        elif kind == 3:
            a = area(0, hw, y, y + hh) + area(hw, w, y + hh, y + h)
            b = all_ - a
        elif kind == 4:
            a, b = area(0, w, y + 1, y + 2) * (h - 1), all_ - area(0, w, y + 1, y + 2)
        else:
            q = max(1, w // 4)
            a = area(q, w - q, y, y + h)
            b = all_ - a
        level = np.searchsorted(STEPS, np.log((1 + a) / (1 + b)))
        out = out << np.uint32(2) | np.array(GRAY, np.uint32)[level]
    return out


#: Bits of the even filters; those of the odd ones are two places lower.
HALF = 0xCCCCCCCC


def keys(fp: np.ndarray) -> list[np.ndarray]:
    """For the even and the odd filters, their bits in two integers APART frames from each other, as one."""
    v, w = (fp[:-APART], fp[APART:]) if len(fp) > APART else (fp[:0], fp[:0])
    half, two = np.uint32(HALF), np.uint32(2)
    return [v & half | (w & half) >> two, (v << two) & half | w & ~half]


def best_offset(a: np.ndarray, b: np.ndarray) -> tuple[int, int, float] | None:
    """(offset, votes, bit error rate): a[i] lies over b[i + offset]; None without a vote."""
    votes: dict[int, int] = {}
    own, other = ([k[: max(0, len(x) - LATER[-1])] for k in keys(x)] for x in (a, b))
    for half, (ka, kb) in enumerate(zip(own, other, strict=True)):
        order = np.argsort(kb, kind="stable")
        lo, hi = np.searchsorted(kb[order], ka, "left"), np.searchsorted(kb[order], ka, "right")
        for i in np.flatnonzero(hi > lo).tolist():
            if i and ka[i] == ka[i - 1]:
                continue
            for j in order[lo[i] : hi[i]].tolist():
                if j and kb[j] == kb[j - 1] or i % EVERY and j and ka[i - 1] == kb[j - 1] or half and own[0][i] == other[0][j]:
                    continue
                if sum(int(a[i + x] ^ b[j + x]).bit_count() for x in LATER) <= MOST_BITS:
                    votes[j - i] = votes.get(j - i, 0) + 1
    if not votes:
        return None
    offset, count = min(votes.items(), key=lambda v: (-v[1], abs(v[0]), v[0]))
    x, y = a[max(0, -offset) :], b[max(0, offset) :]
    n = min(len(x), len(y))
    return offset, count, float(np.bitwise_count(x[:n] ^ y[:n]).sum()) / (32 * n)


def fingerprint_media(df: DataFrame, media_col: str, id_col: str, decode: Callable[..., tuple[np.ndarray, int]] = read_wav) -> DataFrame:
    """Rows (id, n_frames, digest, fp array<int>, readable) for every row; a null, too short or unreadable recording has no frames.

    ``decode`` turns a value of the media column into samples and a rate; by default WAV bytes are read. It tells an
    unreadable value by an error of the kinds BROKEN; ``readable`` is false then, and null for a null.
    """

    def read(value) -> tuple[np.ndarray, bool | None]:
        if value is None:
            return np.zeros(0, np.uint32), None
        try:
            samples = decode(value)
        except BROKEN:
            return np.zeros(0, np.uint32), False
        return fingerprint(*samples), True

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            fps, readable = zip(*[read(m.as_py()) for m in b[1]], strict=True) if b.num_rows else ((), ())
            digests = [blake2b(f.tobytes(), digest_size=16).hexdigest() for f in fps]
            yield pa.RecordBatch.from_arrays(
                [b[0], pa.array([len(f) for f in fps], pa.int32()), pa.array(digests, pa.string()), pa.array([f.view(np.int32) for f in fps], pa.list_(pa.int32())), pa.array(readable, pa.bool_())],
                names=["id", "n_frames", "digest", "fp", "readable"],
            )

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media")).mapInArrow(run, "id long, n_frames int, digest string, fp array<int>, readable boolean")


def align_recordings(fps: DataFrame, is_query, most_error: float = 0.2, least_equal: int = 1, least_overlap: int = LEAST_OVERLAP) -> DataFrame:
    """Rows (id, class_id, n_frames, is_query, match_id, offset, equal, error) for every row of ``fps``, which should be materialized.

    Equal fingerprints are one class, named by its least id. The classes that hold a query are matched with all other
    classes. The rows of a class's least id carry its matches, one a row, match_id being the other class; all other
    rows, and those of classes without matches, come once with nulls. So copies are not expanded, and no list is gathered.
    """
    rows = fps.withColumn("is_query", is_query)
    classes = materialize(rows.groupBy("digest").agg(F.min("id").alias("class_id"), F.first("fp").alias("fp"), F.max("is_query").alias("asks")))

    def key(half: int, v: Column, i: Column) -> Column:
        """The half's key at a frame, null where no frame is that far on; bit 32 tells the half."""
        v, w = v.cast("long"), F.get(F.col("fp"), i + APART).cast("long")
        own, other = (v.bitwiseAND(F.lit(HALF)), F.shiftright(w.bitwiseAND(F.lit(HALF)), 2)) if half == 0 else (F.shiftleft(v, 2).bitwiseAND(F.lit(HALF)), w.bitwiseAND(F.lit(HALF >> 2)))
        return own.bitwiseOR(other).bitwiseOR(F.lit(half << 32))

    def later(i: Column, at: int) -> Column:
        high, low = (F.get(F.col("fp"), i + LATER[at + x]).cast("long") for x in (0, 1))
        return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(0xFFFFFFFF)))

    def postings_of(half: int) -> Column:
        """(v, i, before, even, p, q) at each start of a run of equal keys: the key, its frame, the key before it, the even half's key if v is the odd one's, and the LATER integers."""

        def starts(k: Column) -> Column:
            at = F.filter(F.transform(k, lambda v, i: F.struct(v.alias("v"), i.alias("i"), F.get(k, i - 1).alias("before"))), lambda x: (x["i"] < F.size("fp") - LATER[-1]) & ~x["v"].eqNullSafe(x["before"]))
            even = (lambda x: key(0, F.get(F.col("fp"), x["i"]), x["i"])) if half else (lambda x: F.lit(None).cast("long"))
            return F.transform(at, lambda x: F.struct(x["v"].alias("v"), x["i"].alias("i"), x["before"].alias("before"), even(x).alias("even"), later(x["i"], 0).alias("p"), later(x["i"], 2).alias("q")))

        return F.transform(F.array(F.transform("fp", lambda v, i: key(half, v, i))), starts)[0]

    postings = classes.select("class_id", "asks", F.explode(F.concat(postings_of(0), postings_of(1))).alias("s")).select("class_id", "asks", "s.*")

    def side(rows: DataFrame, name: str, id_: str) -> DataFrame:
        return rows.select(F.col("class_id").alias(id_), "v", *[F.col(c).alias(f"{name}{c}") for c in ("i", "before", "even", "p", "q")])

    q, r = side(postings.where("asks"), "a", "a"), side(postings, "b", "b")
    bits = F.bit_count(F.col("ap").bitwiseXOR(F.col("bp"))) + F.bit_count(F.col("aq").bitwiseXOR(F.col("bq")))
    begins = (F.col("ai") % EVERY == 0) | F.col("abefore").isNull() | F.col("bbefore").isNull() | (F.col("abefore") != F.col("bbefore"))
    first = F.col("aeven").isNull() | (F.col("aeven") != F.col("beven"))
    votes = q.join(r, (q["v"] == r["v"]) & (F.col("a") != F.col("b")) & begins & first & (bits <= MOST_BITS)).groupBy("a", "b", (F.col("bi") - F.col("ai")).alias("offset")).agg(F.count(F.lit(1)).alias("equal"))
    best = votes.groupBy("a", "b").agg(F.max_by(F.struct("offset", "equal"), F.struct("equal", -F.abs("offset"), -F.col("offset"))).alias("o")).where(F.col("o.equal") >= least_equal)
    left = classes.select(F.col("class_id").alias("a"), F.col("fp").alias("x"))
    right = classes.select(F.col("class_id").alias("b"), F.col("fp").alias("y"))
    over = best.join(left, "a").join(right, "b").withColumn("off", F.col("o.offset"))
    x0, y0 = F.greatest(F.lit(0), -F.col("off")), F.greatest(F.lit(0), F.col("off"))
    n = F.least(F.size("x") - x0, F.size("y") - y0)
    # bit_count widens negative integers to 64 bits, so the upper half is masked off
    wrong = F.aggregate(F.zip_with(F.slice("x", x0 + 1, n), F.slice("y", y0 + 1, n), lambda p, s: F.bit_count(p.bitwiseXOR(s).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), F.lit(0), lambda s, v: s + v)
    judged = over.where(n >= least_overlap).select("a", F.col("b").alias("match_id"), F.col("off").alias("offset"), F.col("o.equal").alias("equal"), (wrong / (32 * n)).alias("error"))
    found = judged.where(F.col("error") <= most_error)
    named = rows.select("id", "digest", "n_frames", "is_query").join(classes.select("digest", "class_id"), "digest")
    return named.join(found, (F.col("id") == F.col("class_id")) & (F.col("class_id") == F.col("a")), "left").select("id", "class_id", "n_frames", "is_query", "match_id", "offset", "equal", "error")


RATE, NOTE = 8000, 512
_TONES = np.sin(2 * np.pi * np.outer(440 * 2 ** ((np.arange(25) - 9) / 12), np.arange(NOTE)) / RATE).astype(np.float32)


def render_vector(values: list[float]) -> tuple[np.ndarray, int]:
    """A recording of a numeric series: one tone of NOTE samples per value, two octaves over the series' range."""
    v = np.nan_to_num(np.array([0.0 if x is None else x for x in values]))
    if not len(v):
        return np.zeros(0, np.float32), RATE
    top = max(float(np.abs(v).max()), 1e-12)
    return _TONES[np.round(12 + 12 * v / top).astype(int)].reshape(-1), RATE
