"""Op 4. Media columns: near-duplicate images by local descriptors.

An image column holds binary netpbm (P5 grey or P6 colour, 8 bits). Each distinct image is described at corners of several
scales, the strongest POINTS of every cell of the image, so their number grows with its area: an orientation from the patch's
intensity centroid and 256 binary tests turned by it. A turned patch is mostly a ramp, on which most random tests always answer
alike, so the tests are chosen from a pool by their answers on seeded noise: as even as can be and little correlated.

TABLES hash tables each key a descriptor by KEY_BITS of its bits. Two descriptors of one bucket that differ in at most FAR of
SORT_BITS other bits meet, however many the bucket holds. A pair of images is checked if VOTES or more different couples of their
descriptors met that agree in scale, turn and place (within twice what the consensus below allows). Checked pairs, matched by Hamming distance, must agree on one
similarity transform (geometric consensus), which survives crops, turns, rescaling and edits of brightness or content. Confirmed
pairs are links; connected components are the groups of copies.

The images are dealt into blocks of about BLOCK points, and each two blocks are a task, which joins their buckets in parts of
COUPLES couples at most, so none is too large to be whole. In a task a pair that its links already join is not checked again, and
an image is matched with all that are proposed for it at once: most of them are dismissed for too few matches.
A description is sent once for each block: the join is quadratic in blocks, as meetings are in the images of a bucket.

Byte-identical images share one description, so a flood of copies costs nothing. Undecodable, null or featureless images
have no keypoints and only meet their exact copies (null media: nothing). Empty tables give empty results, columns besides id and
media pass by (whatever their names), repeated ids keep their rows, and a null id never names a group that has another. A picture
is held whole in a task, as arrays of about 60 bytes a pixel.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .storage import discard, materialise

SCALES, STEP, POINTS, PATCH = 4, 0.75, 96, 9
TABLES, KEY_BITS, SORT_BITS, TURN_BITS, LEVEL_BITS, FAR, VOTES, MATCH, INLIERS = 8, 28, 24, 6, 2, 4, 2, 56, 16
POOL, APART, SEEN = 3000, 0.35, 1_000_000
#: A picture of few points is confirmed by half of them, but by FEWEST at least.
FEWEST = 8
#: Side of the cells that each keep so many points of a level; bytes compared at once; couples of descriptors joined at once.
CELL, AT_ONCE, COUPLES = 96, 1 << 26, 1 << 21
#: Points of a block, and the least number of blocks (so of tasks, LEAST * (LEAST + 1) / 2).
BLOCK, LEAST = 400_000, 6
#: Points of a block that are taken to the buckets of the other at once.
SLICE = 1 << 15
_HEAD = re.compile(rb"\A(P[56])\s+(?:#[^\n]*\n\s*)*([0-9]+)\s+([0-9]+)\s+255\s")


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey levels, or None if this is no whole netpbm image."""
    m = _HEAD.match(data or b"")
    if not m:
        return None
    w, h, deep = int(m[2]), int(m[3]), 3 if m[1] == b"P6" else 1
    if len(data) - m.end() < w * h * deep or not w * h:
        return None
    x = np.frombuffer(data, np.uint8, w * h * deep, m.end()).astype(np.float32)
    return x.reshape(h, w) if deep == 1 else x.reshape(h, w, 3) @ np.array([0.299, 0.587, 0.114], np.float32)


def encode(grey: np.ndarray) -> bytes:
    g = np.clip(np.rint(grey), 0, 255).astype(np.uint8)
    return b"P5 %d %d 255\n" % (g.shape[1], g.shape[0]) + g.tobytes()


def resize(x: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear."""
    r = np.clip((np.arange(h) + 0.5) * x.shape[0] / h - 0.5, 0, x.shape[0] - 1)
    c = np.clip((np.arange(w) + 0.5) * x.shape[1] / w - 0.5, 0, x.shape[1] - 1)
    r0, c0 = np.minimum(r.astype(int), max(x.shape[0] - 2, 0)), np.minimum(c.astype(int), max(x.shape[1] - 2, 0))
    r1, c1 = np.minimum(r0 + 1, x.shape[0] - 1), np.minimum(c0 + 1, x.shape[1] - 1)
    fr, fc = (r - r0)[:, None].astype(np.float32), (c - c0)[None, :].astype(np.float32)
    top = x[r0][:, c0] * (1 - fc) + x[r0][:, c1] * fc
    return top * (1 - fr) + (x[r1][:, c0] * (1 - fc) + x[r1][:, c1] * fc) * fr


def _blur(x: np.ndarray) -> np.ndarray:
    for axis in (0, 1):
        a = np.roll(x, 1, axis) + 2 * x + np.roll(x, -1, axis)
        x = a * 0.25
    return x


_GRID = np.stack(np.meshgrid(np.arange(-PATCH, PATCH + 1), np.arange(-PATCH, PATCH + 1), indexing="ij")).astype(np.float32)
_DISC = (_GRID[0] ** 2 + _GRID[1] ** 2 <= PATCH**2).astype(np.float32)


def _angles(smooth: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Direction of the intensity centroid of the patch around each point."""
    patch = smooth[at[:, 0, None, None] + _GRID[0].astype(int), at[:, 1, None, None] + _GRID[1].astype(int)] * _DISC
    return np.arctan2((patch * _GRID[0]).sum((1, 2)), (patch * _GRID[1]).sum((1, 2)))


def _answers(smooth: np.ndarray, at: np.ndarray, angle: np.ndarray, tests: np.ndarray) -> np.ndarray:
    """Answers (points by tests) of the turned tests (row, column, row, column)."""
    cos, sin = np.cos(angle)[:, None], np.sin(angle)[:, None]
    read = []
    for y, x in ((tests[:, 0], tests[:, 1]), (tests[:, 2], tests[:, 3])):
        ry = np.clip(np.rint(sin * x + cos * y), -PATCH, PATCH).astype(int) + at[:, :1]
        rx = np.clip(np.rint(cos * x - sin * y), -PATCH, PATCH).astype(int) + at[:, 1:]
        read.append(smooth[ry, rx])
    return read[0] < read[1]


@lru_cache(1)
def _tests() -> np.ndarray:
    """256 of POOL random tests: the most even ones on noise of several grains whose answers correlate by at most APART."""
    r = np.random.RandomState(20)
    pool = np.clip(r.normal(0, PATCH / 2.2, (POOL, 4)), -PATCH, PATCH).astype(np.float32)
    said = []
    for grain in (6, 10, 16, 24, 40):
        for _ in range(4):
            noise = _blur(_blur(resize(r.uniform(0, 255, (grain, grain)).astype(np.float32), 80, 80)))
            at = r.randint(PATCH + 1, 80 - PATCH - 1, (50, 2))
            said.append(_answers(noise, at, _angles(noise, at), pool))
    x = np.concatenate(said).astype(np.float32)
    order = np.argsort(np.abs(x.mean(0) - 0.5), kind="stable")
    x = (x - x.mean(0)) / np.maximum(x.std(0), 1e-6)
    chosen: list[int] = []
    closest = np.zeros(POOL, np.float32)  # largest correlation with a chosen test
    most = APART
    while len(chosen) < 256:
        for i in order:
            if len(chosen) < 256 and closest[i] <= most:
                chosen.append(int(i))
                closest = np.maximum(closest, np.abs(x[:, i] @ x) / len(x))
        most += 0.1
    return pool[chosen]


POSE_BITS = LEVEL_BITS + TURN_BITS
#: How near the turns of two couples must be, as the length of their mean.
AGREE = 0.98
_BITS = np.stack([np.random.RandomState(100 + t).permutation(256)[: KEY_BITS + SORT_BITS] for t in range(TABLES)])


def _strongest(at: np.ndarray, shape: tuple[int, int], whole: tuple[int, int], most: int) -> np.ndarray:
    """Which points, strongest first, are among the first `most` of their cell; cells are of CELL pixels of the whole image or less."""
    rows, columns = (-(-n // CELL) for n in whole)
    cell = at[:, 0] * rows // shape[0] * columns + at[:, 1] * columns // shape[1]
    order = np.argsort(cell, kind="stable")
    ranked = cell[order]
    kept = np.zeros(len(at), bool)
    kept[order] = np.arange(len(at)) - np.searchsorted(ranked, ranked) < most
    return kept


def describe(grey: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(points: row, column, scale, angle in the image's own pixels; descriptors: 32 bytes each)."""
    points, bits = [], []
    level, scale = grey, 1.0
    for _ in range(SCALES):
        if level is None or min(level.shape) < 2 * PATCH + 6:
            break
        smooth = _blur(_blur(level))
        gy, gx = np.gradient(smooth)
        a, b, c = _blur(_blur(gx * gx)), _blur(_blur(gy * gy)), _blur(_blur(gx * gy))
        corner = a * b - c * c - 0.05 * (a + b) ** 2
        edge = PATCH + 1
        inner = corner[edge:-edge, edge:-edge]
        peak = np.ones(inner.shape, bool)
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if dy or dx:
                    peak &= inner > corner[edge + dy : corner.shape[0] - edge + dy, edge + dx : corner.shape[1] - edge + dx]
        at = np.argwhere(peak & (inner > 1e-2))
        if len(at):
            at = at[np.argsort(-inner[at[:, 0], at[:, 1]], kind="stable")] + edge
            at = at[_strongest(at, level.shape, grey.shape, int(POINTS * scale * scale) + 8)]
            angle = _angles(smooth, at)
            bits.append(np.packbits(_answers(smooth, at, angle, _tests()), axis=1, bitorder="little"))
            points.append(np.column_stack([at / scale, np.full(len(at), 1 / scale), angle]))
        scale *= STEP
        h, w = round(grey.shape[0] * scale), round(grey.shape[1] * scale)
        level = resize(_blur(grey), h, w) if min(h, w) > 0 else None
    if not bits:
        return np.zeros((0, 4), np.float32), np.zeros((0, 32), np.uint8)
    return np.concatenate(points).astype(np.float32), np.concatenate(bits)


def table_keys(points: np.ndarray, descriptors: np.ndarray) -> np.ndarray:
    """By table, a number for each descriptor: table, key, the bits that a bucket's descriptors are compared by, level, angle."""
    bits = np.unpackbits(np.ascontiguousarray(descriptors.T), axis=0, bitorder="little")

    def number(chosen: np.ndarray) -> np.ndarray:
        return sum(byte.astype(np.int64) << (8 * k) for k, byte in enumerate(np.packbits(bits[chosen], axis=0, bitorder="little")))

    turn = np.floor(points[:, 3].astype(np.float64) / (2 * np.pi) * (1 << TURN_BITS)).astype(np.int64) % (1 << TURN_BITS)
    level = np.rint(np.log(points[:, 2].astype(np.float64)) / -np.log(STEP)).astype(np.int64)
    pose = (level << TURN_BITS) + turn
    keys = [
        ((((t << KEY_BITS) + number(k[:KEY_BITS])) << SORT_BITS) + number(k[KEY_BITS:]) << POSE_BITS) + pose
        for t, k in enumerate(_BITS)
    ]
    return np.concatenate(keys)


def consensus(pa_: np.ndarray, da: np.ndarray, pb: np.ndarray, db: np.ndarray, needed: int = FEWEST) -> int:
    """Most matched points of two images that agree on one similarity transform; 0 if fewer than that many are matched."""
    if not len(da) or not len(db):
        return 0
    best, least = np.zeros(len(da), np.int64), np.zeros(len(da), np.int32)
    back, close = np.zeros(len(db), np.int64), np.full(len(db), 257, np.int32)
    rows = max(1, AT_ONCE // (32 * len(db)))
    wa, wb = (np.ascontiguousarray(d).view(np.uint64) for d in (da, db))
    for i in range(0, len(da), rows):
        apart = np.bitwise_count(wa[i : i + rows, None, :] ^ wb[None, :, :]).sum(2, dtype=np.int32)
        best[i : i + rows], least[i : i + rows] = apart.argmin(1), apart.min(1)
        closer = apart.min(0) < close
        back[closer], close[closer] = i + apart.argmin(0)[closer], apart.min(0)[closer]
    good = np.flatnonzero((least <= MATCH) & (back[best] == np.arange(len(da))))
    if len(good) < needed:
        return 0
    return _agreeing(pa_[good], pb[best[good]])


def _agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """Most of these matched points, as many of either image, that agree on one similarity transform."""
    za, zb = a[:, 1] + 1j * a[:, 0], b[:, 1] + 1j * b[:, 0]
    most = 0
    turn = np.exp(1j * (b[:, 3] - a[:, 3])) * (b[:, 2] / a[:, 2])
    rows = max(1, AT_ONCE // (32 * len(za)))
    for i in range(0, len(za), rows):  # each match proposes the transform of its own scale, angle and place
        away = za[None, :] - za[i : i + rows, None]
        off = np.abs(turn[i : i + rows, None] * away + zb[i : i + rows, None] - zb[None, :])
        most = max(most, int((off <= 3 + 0.08 * np.abs(away)).sum(1).max()))
    return most


def least_agreeing(n: int) -> int:
    """Points that must agree if the poorer picture of a pair has n."""
    return min(INLIERS, max(FEWEST, (n + 1) // 2))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(image, points, bits); contents that the task has lately described are not repeated."""
    seen: set[int] = set()
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            fresh = {}
            for image, media in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                if image not in seen:
                    seen.add(image)
                    fresh[image] = describe(decode(media.as_py()))
            if len(seen) > SEEN:
                seen.clear()
            yield pa.RecordBatch.from_arrays(
                [pa.array(fresh.keys(), pa.int64()), pa.array([p.tobytes() for p, _ in fresh.values()], pa.binary()), pa.array([d.tobytes() for _, d in fresh.values()], pa.binary())],
                ["image", "points", "bits"],
            )


def _arrays(points: bytes, bits: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(points, np.float32).reshape(-1, 4), np.frombuffer(bits, np.uint8).reshape(-1, 32)


class _Block:
    """Images of a block: their numbers, points and descriptors, image i at first[i]:first[i + 1]."""

    def __init__(self, rows: pa.Table):
        order = np.argsort(rows.column("no").to_numpy(), kind="stable")
        rows = rows.take(pa.array(order))
        self.no, self.image = (rows.column(c).to_numpy() for c in ("no", "image"))
        held = [_arrays(p, d) for p, d in zip(rows.column("points").to_pylist(), rows.column("bits").to_pylist(), strict=True)]
        self.first = np.r_[0, np.cumsum([len(d) for _, d in held])].astype(np.int64)
        self.points = np.concatenate([p for p, _ in held]) if held else np.zeros((0, 4), np.float32)
        self.bits = np.concatenate([d for _, d in held]) if held else np.zeros((0, 32), np.uint8)
        self.owner = np.repeat(np.arange(len(held), dtype=np.int32), np.diff(self.first))
        self.words = self.bits.view(np.uint64)
        self.level = np.rint(np.log(self.points[:, 2]) / -np.log(STEP)).astype(np.int64)
        self.place = self.points[:, 1] + 1j * self.points[:, 0]
        self.pose = np.exp(1j * self.points[:, 3]) * self.points[:, 2]


class _Buckets:
    """Descriptors of a block by bucket, and then by point: key holds both; the bits to be compared by; a code of each point."""

    def __init__(self, block: _Block, codes: np.ndarray):
        n = len(block.bits)
        packed = np.empty((TABLES, n), np.int64)
        for i in range(0, n, SLICE):
            packed[:, i : i + SLICE] = table_keys(block.points[i : i + SLICE], block.bits[i : i + SLICE]).reshape(TABLES, -1)
        key = packed >> (SORT_BITS + POSE_BITS)
        key <<= 32
        key += np.arange(n)
        packed >>= POSE_BITS
        packed &= (1 << SORT_BITS) - 1
        compared = packed.astype(np.uint32).ravel()
        del packed
        self.key = key.ravel()
        self.key.sort()
        point = self.key & 0xFFFFFFFF
        self.codes = codes[point]
        point += (self.key >> (32 + KEY_BITS)) * n
        self.compared = compared[point]


def _couples(a: np.ndarray, codes: np.ndarray, b: _Buckets, low: np.ndarray, many: np.ndarray) -> Iterator[np.ndarray]:
    """Sums of the codes of the descriptors that meet: of these of a (their bits to be compared by) with as many of b from low on."""
    ends = np.cumsum(many)
    at = 0
    while at < len(a):
        # a row alone may have more couples than that: as many as its bucket holds, not squared
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + COUPLES, "right")))
        n = many[at:to]
        y = np.repeat(low[at:to] - (np.cumsum(n) - n), n)
        y += np.arange(len(y))
        near = np.flatnonzero(np.bitwise_count(np.repeat(a[at:to], n) ^ b.compared[y]) <= FAR)
        yield np.repeat(codes[at:to], n)[near] + b.codes[y[near]]
        at = to


def _proposed(a: _Block, b: _Block) -> Iterator[np.ndarray]:
    """Codes (image of a, image of b) of the pairs to be checked, for some images of a at a time, in order."""
    if not len(a.bits) or not len(b.bits):
        return
    # A couple is one number: image of a, image of b, difference of levels, point in the one image, point in the other. It is the sum of
    # a part for either descriptor, sorts couples of a pair and a level together, and is the same in whatever table the two meet.
    of_b, of_level, of_p, of_q = (int(x).bit_length() for x in (len(b.no) - 1, 2 * SCALES - 1, np.diff(a.first).max() - 1, np.diff(b.first).max() - 1))
    of_pair, of_code = of_b + of_level + of_p + of_q, of_p + of_q
    own = ((SCALES - a.level) << of_code) + ((np.arange(len(a.bits)) - a.first[a.owner]) << of_q)
    other = _Buckets(b, (((b.owner.astype(np.int64) << of_level) + b.level) << of_code) + (np.arange(len(b.bits)) - b.first[b.owner]))
    i = 0
    while i < len(a.no):
        j = max(i + 1, int(np.searchsorted(a.first, a.first[i] + SLICE, "right")) - 1)
        yield from _proposed_of(a, i, min(j, len(a.no)), b, own, other, of_b, of_level, of_p, of_q)
        i = j


def _proposed_of(a: _Block, i: int, stop: int, b: _Block, own: np.ndarray, other: _Buckets, of_b: int, of_level: int, of_p: int, of_q: int) -> Iterator[np.ndarray]:
    """_proposed() for the images i to stop of a."""
    of_pair, of_code = of_b + of_level + of_p + of_q, of_p + of_q
    points = slice(a.first[i], a.first[stop])
    packed = table_keys(a.points[points], a.bits[points]).reshape(TABLES, -1).T.ravel()  # by point, so by image
    point = np.repeat(np.arange(points.start, points.stop), TABLES)
    compared = (packed >> POSE_BITS & ((1 << SORT_BITS) - 1)).astype(np.uint32)
    bucket = packed >> (SORT_BITS + POSE_BITS) << 32
    order = np.argsort(bucket)
    low, many = np.empty_like(bucket), np.empty_like(bucket)
    # in one block each two of a bucket meet once: those of an image with those of later ones
    low[order] = np.searchsorted(other.key, (bucket + (a.first[a.owner[point] + 1] if a is b else 0))[order])
    many[order] = np.searchsorted(other.key, bucket[order] + 0xFFFFFFFF)
    many -= low
    base, first = i, (a.first[i : stop + 1] - points.start) * TABLES
    ends = np.r_[0, np.cumsum(many)][first]
    while i < stop:
        j = base + max(i + 1 - base, int(np.searchsorted(ends, ends[i - base] + COUPLES, "right")) - 1)
        j = min(j, i + (1 << max(0, 62 - of_pair)))
        part, start, i = slice(first[i - base], first[j - base]), i, j
        codes = own[point[part]] + ((a.owner[point[part]].astype(np.int64) - start) << of_pair)
        couples = np.concatenate([own[:0], *_couples(compared[part], codes, other, low[part], many[part])])
        couples.sort()
        couples = couples[np.r_[True, couples[1:] != couples[:-1]][: len(couples)]]  # in however many tables
        same = (couples[1:] >> of_code) == (couples[:-1] >> of_code)
        couples = couples[(np.r_[False, same] | np.r_[same, False])[: len(couples)]]
        code = couples >> of_code
        pair = code >> of_level
        p = a.first[(pair >> of_b) + start] + ((couples >> of_q) & ((1 << of_p) - 1))
        q = b.first[pair & ((1 << of_b) - 1)] + (couples & ((1 << of_q) - 1))
        za, zb, turn = a.place[p], b.place[q], b.pose[q] / a.pose[p]
        agreed, left, s = [], np.arange(len(code)), 0
        while len(left):  # each couple with the s-th after it of its pair
            s += 1
            left = left[left + s < len(code)]
            left = left[code[left] == code[left + s]]
            x, y = left, left + s
            away = za[y] - za[x]
            ok = np.abs(turn[x] * away + zb[x] - zb[y]) <= 2 * (3 + 0.08 * np.abs(away))
            ok &= (np.abs(turn[x] + turn[y]) >= AGREE * np.abs(turn[x]) * VOTES) & (p[x] != p[y]) & (q[x] != q[y])
            agreed.append(code[x[ok]])
            if ok.any():  # no need to look further
                left = left[~np.isin(code[left], agreed[-1])]
        found = np.unique(np.concatenate([code[:0], *agreed]) >> of_level)
        if len(found):
            yield ((found >> of_b) + start) * len(b.no) + (found & ((1 << of_b) - 1))


def _matched(a: _Block, i: int, b: _Block, js: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(j, points of i, points of j that they match) as consensus() matches them, for each of these images of b that it would not
    dismiss for too few matches. Many images at once: most are dismissed."""
    mine = a.words[a.first[i] : a.first[i + 1]].T
    n, counts = mine.shape[1], b.first[js + 1] - b.first[js]
    # A distance and a place in one number, so the least is the first of the nearest.
    kind, of_place = (np.int32, 22) if max(n, counts.max(initial=0)) < 1 << 22 else (np.int64, 40)
    ends = np.cumsum(counts)
    at = 0
    while at < len(js):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE // (256 * n), "right")))
        some = counts[at:to]
        starts = np.cumsum(some) - some
        local = np.arange(int(some.sum())) - np.repeat(starts, some)
        theirs = np.ascontiguousarray(b.words[local + np.repeat(b.first[js[at:to]], some)].T)
        apart = np.zeros((n, len(local)), kind)
        for x, y in zip(mine, theirs, strict=True):
            apart += np.bitwise_count(x[:, None] ^ y)
        apart <<= of_place
        back = (apart + np.arange(n, dtype=kind)[:, None]).min(0) & ((1 << of_place) - 1)
        apart += local.astype(kind)
        nearest = np.minimum.reduceat(apart, starts, axis=1)
        best = nearest & ((1 << of_place) - 1)
        good = (nearest >> of_place <= MATCH) & (back[best + starts] == np.arange(n)[:, None])
        enough = good.sum(0) >= [least_agreeing(min(n, k)) for k in some.tolist()]
        for k in np.flatnonzero(enough).tolist():
            j, p = int(js[at + k]), np.flatnonzero(good[:, k])
            yield j, a.points[a.first[i] + p], b.points[b.first[j] + best[p, k]]
        at = to


def _meet(check: bool):
    """(src, dst) of the pairs of two blocks (side 0 and 1, or 0 alone): numbers if only proposed, images if confirmed and not
    yet joined by others of the task."""

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        a = _Block(table.filter(pa.array(side == 0)))
        b = _Block(table.filter(pa.array(side == 1))) if (side == 1).any() else a
        offset = 0 if a is b else len(a.no)
        root = list(range(len(a.no) + (0 if a is b else len(b.no))))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        src, dst = [], []
        for pairs in _proposed(a, b):
            left, right = pairs // len(b.no), pairs % len(b.no)
            if not check:
                src.extend(np.maximum(a.no[left], b.no[right]).tolist())
                dst.extend(np.minimum(a.no[left], b.no[right]).tolist())
                continue
            images, begin = np.unique(left, return_index=True)
            for i, js in zip(images.tolist(), np.split(right, begin[1:]), strict=True):
                x = top(i)
                apart = [j for j in js.tolist() if top(offset + j) != x]
                for j, p, q in _matched(a, i, b, np.array(apart, np.int64)):
                    needed = least_agreeing(int(min(a.first[i + 1] - a.first[i], b.first[j + 1] - b.first[j])))
                    if (x := top(i)) != (y := top(offset + j)) and _agreeing(p, q) >= needed:
                        root[x] = y
                        src.append(a.image[i])
                        dst.append(b.image[j])
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    return run


def _tasks(described: DataFrame) -> DataFrame:
    """(task, side, no, image, points, bits): each two blocks of images together, and each block by itself."""
    held = described.where(F.octet_length("bits") >= 32 * FEWEST)
    total = held.agg(F.sum(F.octet_length("bits") / 32)).first()[0] or 0
    n = max(LEAST, int(-(-total // BLOCK)))
    block = F.pmod(F.xxhash64("no"), F.lit(n)).cast("int")
    dealt = held.select(block.alias("block"), "no", "image", "points", "bits").withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return dealt.select((F.least("block", "other") * n + F.greatest("block", "other")).alias("task"), (F.col("block") > F.col("other")).cast("int").alias("side"), "no", "image", "points", "bits")


def proposals(described: DataFrame) -> DataFrame:
    """(src, dst) of images (no, points, bits) to be checked."""
    return _tasks(described.withColumn("image", F.col("no"))).groupBy("task").applyInArrow(_meet(False), "src long, dst long")


def confirmed(described: DataFrame) -> DataFrame:
    """(src, dst) links between images (no, image, points, bits): any two that are proposed and agree are joined by a path."""
    return _tasks(described).groupBy("task").applyInArrow(_meet(True), "src long, dst long")


def copies(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """(id, image, n_keypoints, n_contents, group_id) for each row: image names the exact content, n_contents counts the different
    contents of its group, group_id is the smallest id among its copies."""
    named = media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    named = named.withColumn("image", F.when(F.col("media").isNull(), F.xxhash64(F.lit("null"), "id")).otherwise(F.xxhash64(F.lit("media"), "media")))
    rows = materialise(named.select("id", "image"), "media-rows")
    # Descriptions are shuffled, never pictures. Numbers are shorter than hashes and follow the order of the contents.
    each = named.where("media is not null").select("image", "media").mapInArrow(_describe, "image long, points binary, bits binary")
    unique = each.groupBy("image").agg(F.first("points").alias("points"), F.first("bits").alias("bits"))
    described = materialise(unique.sortWithinPartitions("image").withColumn("no", F.monotonically_increasing_id()), "media-described")
    links = materialise(confirmed(described), "media-links")
    roots = connected_components(links).withColumnRenamed("id", "image")
    discard(links)
    first = rows.groupBy("image").agg(F.min("id").alias("first_id"))
    rooted = first.join(roots, "image", "left").withColumn("root", F.coalesce("root", "image"))
    groups = rooted.groupBy("root").agg(F.min("first_id").alias("group_id"), F.count("*").alias("n_contents"))
    n_points = described.select("image", (F.octet_length("bits") / 32).cast("long").alias("n_keypoints"))
    lookup = rooted.join(groups, "root").join(n_points, "image", "left")
    out = lookup.select("image", F.coalesce("n_keypoints", F.lit(0)).alias("n_keypoints"), "n_contents", "group_id")
    return rows.join(out, "image").select("id", "image", "n_keypoints", "n_contents", "group_id")


def draw(vector: np.ndarray, side: int = 56) -> np.ndarray:
    """A grey image of a vector: its values as a grid of blobs of that brightness and size. The same vector, the same image."""
    n = int(np.ceil(np.sqrt(len(vector)))) or 1
    v = np.zeros(n * n, np.float32)
    v[: len(vector)] = np.nan_to_num(vector)
    low, high = v.min(), v.max()
    grid = ((v - low) / (high - low) if high > low else v * 0).reshape(n, n)
    return 40 + 175 * resize(grid, side, side)


def draw_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, media): the drawing of each vector; null vectors have null media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = [None if v is None else encode(draw(np.array(v, np.float32))) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(drawn, pa.binary())], [id_col, "media"])

    return vectors.select(F.col(id_col).cast("long").alias(id_col), vector_col).mapInArrow(run, f"{id_col} long, media binary")
