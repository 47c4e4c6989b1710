"""Cropped or edited copies of images, by local descriptors.

Images are grey rasters (bytes, width, height). Corners of several scales are
described by binary brightness tests in a patch turned to its own orientation.
Descriptors meet in tables keyed by some of their bits. Every two descriptors of
different images within DISTANCE in a bucket are a vote for their images, and all
image pairs that get VOTES are verified (all pairs of a group, if as many descriptors
meet in its tables as it has image pairs): their descriptors are matched again, and
enough matches must agree on one shift, turn and scale. Images are dealt into parts,
and each two parts are a group with tables of its own, so votes are counted where
they arise, however many images meet in a bucket. Work grows with the pairs that
meet, at worst with the square of the different images.

Cases: null, empty or ill-sized rasters, and images without corners: a class of
their own (null or empty ones all by themselves); exact copies share a class by
their bytes; null keys and repeated rows are returned each; empty table: no rows;
other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionloom.llm.common import bounded_batches, materialize, trim
from motionloom.llm.graph import components, forest

LEVELS, CORNERS, MARGIN, TESTS, TURNS = (1.0, 0.5), 12, 9, 256, 30
TABLES, KEY_BITS, DISTANCE, VOTES, INLIERS, NEAR = 4, 24, 40, 2, 5, 3.0
PART, SPREAD, SLAB, CHUNK = 4096, 10, 1 << 20, 1024
_RNG = np.random.default_rng(7)
POINTS = np.clip(_RNG.normal(0, 3.2, (TESTS, 2, 2)), -6, 6)
TABLE_BITS = np.stack([_RNG.permutation(TESTS)[:KEY_BITS] for _ in range(TABLES)])
_a = 2 * np.pi * np.arange(TURNS) / TURNS
TURNED = np.rint(np.einsum("tij,nkj->tnki", np.stack([np.stack([np.cos(_a), -np.sin(_a)], -1), np.stack([np.sin(_a), np.cos(_a)], -1)], 1), POINTS)).astype(np.int64)
DISC = np.array([(x, y) for y in range(-7, 8) for x in range(-7, 8) if x * x + y * y <= 49])


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Sums over squares of 2r+1 pixels, edges repeated."""
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (r + 1, r)
        c = np.cumsum(np.pad(x, pad, mode="edge"), axis=axis, dtype=np.float64)
        n = x.shape[axis]
        hi = np.take(c, np.arange(2 * r + 1, n + 2 * r + 1), axis=axis)
        x = hi - np.take(c, np.arange(n), axis=axis)
    return x


def _resized(x: np.ndarray, level: float) -> np.ndarray:
    if level == 1:
        return x
    h, w = (max(1, int(n * level)) for n in x.shape[1:])
    x = _box(x, 1) / 9
    ys, xs = ((np.arange(n) + 0.5) / level - 0.5 for n in (h, w))
    y0, x0 = (np.clip(v.astype(int), 0, n - 2 if n > 1 else 0) for v, n in ((ys, x.shape[1]), (xs, x.shape[2])))
    y1, x1 = np.minimum(y0 + 1, x.shape[1] - 1), np.minimum(x0 + 1, x.shape[2] - 1)
    fy, fx = np.clip(ys - y0, 0, 1)[:, None], np.clip(xs - x0, 0, 1)[None]
    return (x[:, y0][:, :, x0] * (1 - fx) + x[:, y0][:, :, x1] * fx) * (1 - fy) + (x[:, y1][:, :, x0] * (1 - fx) + x[:, y1][:, :, x1] * fx) * fy


def describe(images: np.ndarray):
    """Corners of a stack of equal-sized images: image number, x, y, scale, angle, descriptor bytes."""
    out = []
    for level in LEVELS:
        x = _resized(images.astype(np.float64), level)
        n, h, w = x.shape
        if min(h, w) <= 2 * MARGIN:
            continue
        smooth = _box(x, 1) / 9
        gy, gx = np.gradient(smooth, axis=1), np.gradient(smooth, axis=2)
        a, b, c = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        r = a * b - c * c - 0.05 * (a + b) ** 2
        inner = r[:, MARGIN:-MARGIN, MARGIN:-MARGIN].copy()
        for dy in range(-2, 3):
            for dx in range(-2, 3):
                if dy or dx:
                    other = r[:, MARGIN + dy : h - MARGIN + dy, MARGIN + dx : w - MARGIN + dx]
                    inner[(other > inner) | ((other == inner) & ((dy, dx) < (0, 0)))] = 0
        flat = inner.reshape(n, -1)
        k = min(CORNERS, flat.shape[1])
        top = np.argsort(-flat, axis=1, kind="stable")[:, :k]
        value = np.take_along_axis(flat, top, axis=1)
        good = value > np.maximum(0.001 * value[:, :1], 1e-3)
        img, j = np.nonzero(good)
        at = top[img, j]
        cy, cx = at // inner.shape[2] + MARGIN, at % inner.shape[2] + MARGIN
        disc = x[img[:, None], cy[:, None] + DISC[:, 1], cx[:, None] + DISC[:, 0]]
        angle = np.arctan2(disc @ DISC[:, 1], disc @ DISC[:, 0])
        turn = np.rint(angle / (2 * np.pi) * TURNS).astype(int) % TURNS
        p = TURNED[turn]
        one = smooth[img[:, None], cy[:, None] + p[:, :, 0, 1], cx[:, None] + p[:, :, 0, 0]]
        two = smooth[img[:, None], cy[:, None] + p[:, :, 1, 1], cx[:, None] + p[:, :, 1, 0]]
        bits = np.packbits(one > two + 1e-6, axis=1)
        out.append((img, (cx + 0.5) / level - 0.5, (cy + 0.5) / level - 0.5, np.full(len(img), 1 / level), angle, bits))
    if not out:
        return (np.zeros(0, int),) + (np.zeros(0),) * 4 + (np.zeros((0, TESTS // 8), np.uint8),)
    out = [np.concatenate(v) for v in zip(*out, strict=True)]
    order = np.argsort(out[0], kind="stable")
    return tuple(v[order] for v in out)


def features(images: DataFrame) -> DataFrame:
    """(image_id, content, n, points, bits) from (image_id, image, width, height)."""
    bounded_batches(images.sparkSession)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            raw, w, h = (batch.column(i).to_pylist() for i in range(1, 4))
            points, bits, count = [b""] * n, [b""] * n, [0] * n
            sizes: dict[tuple[int, int], list[int]] = {}
            for i in range(n):
                if raw[i] and w[i] and h[i] and w[i] > 0 and len(raw[i]) == w[i] * h[i]:
                    sizes.setdefault((h[i], w[i]), []).append(i)
            for (hh, ww), rows in sizes.items():
                step = max(1, (1 << 20) // (hh * ww))
                for a in range(0, len(rows), step):
                    part = rows[a : a + step]
                    img, x, y, s, t, d = describe(np.stack([np.frombuffer(raw[i], np.uint8).reshape(hh, ww) for i in part]))
                    cut = np.searchsorted(img, np.arange(len(part) + 1))
                    for k, i in enumerate(part):
                        z = slice(cut[k], cut[k + 1])
                        count[i] = int(cut[k + 1] - cut[k])
                        points[i] = np.stack([x[z], y[z], s[z], t[z]], 1).astype("<f4").tobytes()
                        bits[i] = d[z].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), pa.array(count, pa.int64()), pa.array(points, pa.binary()), pa.array(bits, pa.binary())], ["image_id", "content", "n", "points", "bits"])

    raw = F.col("image").cast("binary")
    few = images.select(F.col("image_id").cast("long"), raw.alias("image"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"))
    few = few.withColumn("content", F.when(F.octet_length("image") > 0, F.concat_ws(":", "width", "height", F.sha2("image", 256))))
    return few.mapInArrow(run, "image_id long, content string, n long, points binary, bits binary")


def _keys(d: np.ndarray) -> np.ndarray:
    """Bucket keys (TABLES x descriptors)."""
    on = np.unpackbits(d, axis=1)
    return np.stack([on[:, TABLE_BITS[t]].astype(np.int64) @ (1 << np.arange(KEY_BITS)) + (t << 32) for t in range(TABLES)])


def _votes(d: np.ndarray, cuts: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Votes of each image of `left` for each of `right` (numbers of images, whose descriptors lie between their cuts)."""
    corners = lambda which: np.concatenate([np.zeros(0, np.int64), *(np.arange(cuts[i], cuts[i + 1]) for i in which.tolist())])
    own = lambda which: np.repeat(np.arange(len(which)), np.diff(cuts)[which])
    a, b, of_a, of_b = corners(left), corners(right), own(left), own(right)
    words = d.view(np.uint64).reshape(len(d), -1)
    met = []
    for one, two in zip(_keys(d[a]), _keys(d[b]), strict=True):
        order = np.argsort(two, kind="stable")
        two = two[order]
        met.append((one, order, np.searchsorted(two, one, "left"), np.searchsorted(two, one, "right")))
    if sum(int((hi - lo).sum()) for _, _, lo, hi in met) >= len(left) * len(right):
        # the tables spare nothing here: all pairs are verified, also those that meet in no bucket
        return np.full((len(left), len(right)), VOTES, np.uint16)
    votes = np.zeros(len(left) * len(right), np.uint16)
    for one, order, lo, hi in met:
        at, ends = 0, np.cumsum(hi - lo)
        while at < len(one):
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + SLAB, "right")))
            n = hi[at:to] - lo[at:to]
            i = np.repeat(np.arange(at, to), n)
            j = order[np.arange(len(i)) + np.repeat(lo[at:to] - (ends[at:to] - n - before), n)]
            dist = np.zeros(len(i), np.uint16)
            for w in range(words.shape[1]):
                dist += np.bitwise_count(words[a[i], w] ^ words[b[j], w])
            near = dist <= DISTANCE
            pair, count = np.unique(of_a[i[near]] * len(right) + of_b[j[near]], return_counts=True)
            votes[pair] = np.minimum(votes[pair] + count, VOTES)
            at = to
    return votes.reshape(len(left), len(right))


def _matched(d: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mutual matches of image pairs x, y (corners of x by pairs), and each one's corner of y; d: (words, corners, images).

    Pairs lie along the last axis, so that every step runs over many of them at once. A
    key is a distance and a corner's number: the least has the first of the nearest corners.
    """
    na, nb, bits = int(n[x].max()), int(n[y].max()), int(d.shape[1] - 1).bit_length()
    kind = np.uint16 if (TESTS + 1) << bits <= 1 << 16 else np.uint32
    one, two = (np.take(d[:, :k], which, axis=2) for k, which in ((na, x), (nb, y)))
    number, none = np.arange(nb).astype(kind)[:, None], np.arange(nb)[:, None] >= n[y]
    far = kind(TESTS << bits)
    rows, columns = np.empty((na, len(x)), kind), np.full((nb, len(x)), np.iinfo(kind).max, kind)
    word, count, key, own = (np.empty((nb, len(x)), v) for v in (np.uint64, np.uint8, kind, kind))
    dist, clipped = np.empty((nb, len(x)), np.uint8), np.uint8(63)
    for i in range(na):
        # 255 bits, not 256, in bytes: far all the same
        np.minimum(np.bitwise_count(np.bitwise_xor(two[0], one[0, i], out=word), out=dist), clipped, out=dist)
        for k in range(1, len(d)):
            dist += np.bitwise_count(np.bitwise_xor(two[k], one[k, i], out=word), out=count)
        key[:] = dist
        key <<= kind(bits)
        if none.any():
            key[none] = far
        np.bitwise_or(key, number, out=own).min(axis=0, out=rows[i])
        absent = i >= n[x]
        if absent.any():
            key[:, absent] = far
            rows[i, absent] = far
        key |= kind(i)
        np.minimum(columns, key, out=columns)
    j = rows & kind((1 << bits) - 1)
    there = np.take(columns.reshape(-1), j.astype(np.int64) * len(x) + np.arange(len(x))) & kind((1 << bits) - 1)
    return (there == np.arange(na).astype(kind)[:, None]) & (rows >> kind(bits) <= DISTANCE), j


def _agreed(d: np.ndarray, p: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which image pairs have INLIERS matches that agree; d: (images, corners, words) and p: (images, corners, 4), of which the first n are there."""
    out = np.zeros(len(a), bool)
    d = np.ascontiguousarray(d.transpose(2, 1, 0))
    place, scale, turn = p[..., 0] + 1j * p[..., 1], p[..., 2], p[..., 3]
    size = p.shape[1]
    place, scale, turn = place.reshape(-1), scale.reshape(-1), turn.reshape(-1)
    # images with as many corners together, so that few are padded
    order = np.argsort((n[a] * (n.max(initial=0) + 1) + n[b]).astype(np.uint16 if n.max(initial=0) < 255 else np.int64), kind="stable")
    for s in range(0, len(a), SLAB // 16):
        kept: dict[int, list] = {}
        for at in range(s, min(len(a), s + SLAB // 16), CHUNK):
            q = order[at : min(at + CHUNK, s + SLAB // 16)]
            mutual, j = _matched(d, n, a[q], b[q])
            many = mutual.sum(axis=0)
            for m in range(INLIERS, len(mutual) + 1):
                which = np.flatnonzero(many == m)
                if len(which):
                    i = np.nonzero(mutual[:, which].T)[1].reshape(-1, m)
                    kept.setdefault(m, []).append((q[which], i, np.take_along_axis(j[:, which].T, i, 1).astype(np.int64)))
        for m, found in kept.items():
            q, i, j = (np.concatenate(v) for v in zip(*found, strict=True))
            part = max(1, SLAB // 64 // m)
            for at in range(0, len(q), part):
                k = q[at : at + part]
                one, two = (a[k][:, None] * size + i[at : at + part]).T, (b[k][:, None] * size + j[at : at + part]).T
                may = np.flatnonzero(_may_agree(place[one], place[two], scale[two] / scale[one], turn[two] - turn[one]))
                one, two = one.T[may], two.T[may]
                for c in range(0, len(may), 4096):
                    z = slice(c, c + 4096)
                    out[k[may[z]]] = _agreeing(place[one[z]], place[two[z]], scale[two[z]] / scale[one[z]] * np.exp(1j * (turn[two[z]] - turn[one[z]]))) >= INLIERS
    return out


def _may_agree(z: np.ndarray, w: np.ndarray, scale: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Which pairs (matches x pairs) _agreeing() could find INLIERS matches for: its test in short numbers, with a little more room and all finer turns."""
    m, short = len(z), np.float32
    zr, zi, wr, wi, scale, turn = (v.astype(short) for v in (z.real, z.imag, w.real, w.imag, scale, turn))
    fr, fi = scale * np.cos(turn), scale * np.sin(turn)
    got = np.zeros(z.shape[1], bool)
    u, v = np.empty_like(zr), np.empty_like(zr)
    for base in range(m):
        xr, xi, yr, yi = zr - zr[base], zi - zi[base], wr - wr[base], wi - wi[base]
        size = xr * xr + xi * xi
        far = size > 15.9
        size[~far] = np.nan
        hr, hi = (yr * xr + yi * xi) / size, (yi * xr - yr * xi) / size
        # the base's own place, which gives no turn, has its corner's
        hr[base], hi[base] = fr[base], fi[base]
        size = hr * hr + hi * hi
        size[(size < 0.0399) | (size > 25.1)] = np.nan
        limit = np.maximum(1, size) * short(NEAR**2 + 0.01)
        for h in range(m):
            np.multiply(hr[h], xr, out=u)
            u -= np.multiply(hi[h], xi, out=v)
            u -= yr
            u *= u
            np.multiply(hr[h], xi, out=v)
            v += hi[h] * xr
            v -= yi
            v *= v
            u += v
            got |= (u <= limit[h]).view(np.uint8).sum(axis=0, dtype=np.uint8) >= INLIERS
    return got


def _agreeing(z: np.ndarray, w: np.ndarray, move: np.ndarray) -> np.ndarray:
    """For pairs of as many matches each: the most of them that agree on a shift, turn and scale.

    z and w: places of the matches in both images (pairs x matches); move: the turn and scale of each by its corners.
    """
    dz, dw = z[:, None] - z[:, :, None], w[:, None] - w[:, :, None]
    far = np.abs(dz) > 4
    # a pair of matches gives a finer turn and scale than one corner's angle
    k = np.argsort(~far, axis=2, kind="stable")[:, :, :8]
    with np.errstate(divide="ignore", invalid="ignore"):
        finer = np.where(np.take_along_axis(far, k, 2), np.take_along_axis(dw, k, 2) / np.take_along_axis(dz, k, 2), np.nan)
    f = np.concatenate([move[:, :, None], finer], axis=2)
    size = np.abs(f)
    f[(size < 0.2) | (size > 5)] = np.nan
    limit = (NEAR * np.maximum(1.0, size)) ** 2
    off = f[..., None] * dz[:, :, None] - dw[:, :, None]
    return (off.real**2 + off.imag**2 <= limit[..., None]).sum(axis=3).max(axis=(1, 2))


def _verified(table: pa.Table) -> pa.Table:
    """Verified links of a group, from rows (group, parts, part, image_id, n, points, bits): between its two parts, or in its one.

    A row for each linked image: the least image it is joined to by them, itself included, and their number.
    """
    table = table.sort_by("image_id").combine_chunks()
    ids, n, part = (table.column(c).to_numpy() for c in ("image_id", "n", "part"))
    raw, points = (b"".join(table.column(c).to_pylist()) for c in ("bits", "points"))
    d, p = np.frombuffer(raw, np.uint8).reshape(-1, TESTS // 8), np.frombuffer(points, "<f4").reshape(-1, 4).astype(np.float64)
    cuts = np.concatenate([[0], np.cumsum(n)])
    group, parts = table.column("group")[0].as_py(), table.column("parts")[0].as_py()
    left, right = (np.flatnonzero(part == k) for k in divmod(group, parts))
    size = int(n.max())
    there = np.arange(size)[None] < n[:, None]
    words, places = np.zeros((len(n), size, TESTS // 64), np.uint64), np.ones((len(n), size, 4))
    words[there], places[there] = d.view(np.uint64).reshape(len(d), -1), p
    votes, found, step = _votes(d, cuts, left, right), [], max(1, SLAB // max(1, len(right)))
    for at in range(0, len(left), step):
        i, j = np.nonzero(votes[at : at + step] >= VOTES)
        a, b = np.minimum(left[at + i], right[j]), np.maximum(left[at + i], right[j])
        if group // parts == group % parts:
            keep = left[at + i] < right[j]
            a, b = a[keep], b[keep]
        keep = _agreed(words, places, n, a, b)
        found.append(np.stack([a[keep], b[keep]]))
    a, b = np.concatenate([np.zeros((2, 0), np.int64), *found], axis=1)
    links = np.bincount(np.concatenate([a, b]), minlength=len(ids))
    linked = np.flatnonzero(links)
    found = pa.table({"a": pa.array(ids[linked]), "b": pa.array(ids[forest(a, b, len(ids))[linked]]), "n_links": pa.array(links[linked])})
    del table, raw, points, d, p, words, places, votes
    trim()
    return found


def copies(images: DataFrame) -> DataFrame:
    """image_id, n_corners, n_links (verified links of its bytes' first image) and class_id (least id of its class)."""
    spark = images.sparkSession
    found = materialize(features(images), "media")
    bounded_batches(spark)
    firsts = found.where("content is not null and image_id is not null").groupBy("content").agg(F.min(F.struct("image_id", "n", "points", "bits")).alias("f")).select("content", "f.*")
    firsts = materialize(firsts, "media")

    some = firsts.where("n > 0")
    n = some.count()
    parts = max(1, -(-n // PART), min(SPREAD, n // 64))
    own = F.pmod(F.xxhash64("image_id"), F.lit(parts)).cast("int")
    group = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.least(i, F.col("part")) * parts + F.greatest(i, F.col("part")))
    groups = some.select("image_id", "n", "points", "bits", own.alias("part"), F.lit(parts).alias("parts")).withColumn("group", F.explode(group))
    checked = groups.groupBy("group").applyInArrow(_verified, "a long, b long, n_links long")
    links = materialize(checked, "media")
    count = links.groupBy(F.col("a").alias("image_id")).agg(F.sum("n_links").alias("n_links"))
    classed = firsts.select("content", "image_id").join(components(links.select("a", "b")).select(F.col("node").alias("image_id"), "root"), "image_id", "left").join(count, "image_id", "left").select("content", F.coalesce("root", "image_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return found.select("image_id", F.col("n").alias("n_corners"), "content").join(classed, "content", "left").select("image_id", "n_corners", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("class_id", "image_id").alias("class_id"))


def rendered(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cell: int = 8) -> DataFrame:
    """Grey mosaics of vectors of numbers, one cell for each: a stand-in where no image table is at hand."""
    bounded_batches(vectors.sparkSession)

    def run(batches):
        for batch in batches:
            out, sides = [], []
            for v in batch.column(1).to_pylist():
                v = np.array([np.nan if x is None else x for x in v], np.float64) if v else np.zeros(0)
                v = np.nan_to_num(v[np.isfinite(v)])
                side = int(np.ceil(np.sqrt(len(v))))
                grid = np.zeros(side * side)
                if len(v):
                    grid[: len(v)] = (v - v.min()) / max(float(np.ptp(v)), 1e-12) * 255
                out.append(np.kron(grid.reshape(side, side), np.ones((cell, cell))).astype(np.uint8).tobytes() if side else None)
                sides.append(side * cell)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array(sides, pa.int32()), pa.array(sides, pa.int32())], ["image_id", "image", "width", "height"])

    return vectors.select(F.col(key).cast("long").alias("image_id"), F.col(vector)).mapInArrow(run, "image_id long, image binary, width int, height int")
