"""Fits inside one small group: similarities between point sets, triangulated scales, depth that agrees between views, pose chains with loops."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SIMILARITY = "n int, inliers int, rmse double, s double, r array<double>, t array<double>"


def similarities(pairs: DataFrame, keys: tuple[str, ...], *, thresh: float = 0.12, iters: int = 2000, least: int = 10, scales: tuple[float, float] = (0.3, 3.0), seed: int = 0) -> DataFrame:
    """(keys, n, inliers, rmse, s, r, t): the similarity q = s R p + t of matched points (keys, px, py, pz, qx, qy, qz), robust to wrong matches.

    The matches of one pair of photos (tens to hundreds) are a group. Triples are drawn with the seed, all at once; the
    one with most points within `thresh` and a scale within bounds wins and is fitted twice more on
    its points. Groups with fewer than four points or `least` inliers give no row; points with a null or non-finite coordinate are passed over.
    """
    import numpy as np
    import pandas as pd

    columns = ["px", "py", "pz", "qx", "qy", "qz"]

    def fit(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of stacks (k, m, 3): rotations, scales and translations by singular values."""
        mp, mq = p.mean(1, keepdims=True), q.mean(1, keepdims=True)
        a, b = p - mp, q - mq
        u, d, vt = np.linalg.svd(np.einsum("kmi,kmj->kij", b, a) / p.shape[1])
        sign = np.ones_like(d)
        sign[:, 2] = np.where(np.linalg.det(u) * np.linalg.det(vt) < 0, -1, 1)
        r = np.einsum("kij,kj,kjl->kil", u, sign, vt)
        s = (d * sign).sum(1) / np.maximum((a * a).sum((1, 2)) / p.shape[1], 1e-12)
        return r, s, mq[:, 0] - s[:, None] * np.einsum("kij,kj->ki", r, mp[:, 0])

    def errors(p: np.ndarray, q: np.ndarray, r: np.ndarray, s: np.ndarray, t: np.ndarray) -> np.ndarray:
        return np.linalg.norm(s[:, None, None] * np.einsum("kij,mj->kmi", r, p) + t[:, None] - q, axis=2)

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        both = rows.sort_values(columns)[columns].to_numpy(float)
        both = both[np.isfinite(both).all(1)]
        p, q, n = both[:, :3], both[:, 3:], len(both)
        names = list(keys) + ["n", "inliers", "rmse", "s", "r", "t"]
        if n < 4:
            return pd.DataFrame(columns=names)
        rng = np.random.default_rng(seed)
        inside, best = None, -1
        for lo in range(0, iters, 256):  # blocks, so that memory follows the matches
            draw = np.argsort(rng.random((min(256, iters - lo), n)), axis=1)[:, :3]
            wide = np.linalg.norm(np.cross(p[draw[:, 1]] - p[draw[:, 0]], p[draw[:, 2]] - p[draw[:, 0]]), axis=1) > 1e-6
            r, s, t = fit(p[draw], q[draw])
            near = errors(p, q, r, s, t) < thresh
            score = np.where(wide & (s >= scales[0]) & (s <= scales[1]), near.sum(1), -1)
            if score.max() > best:
                best, inside = int(score.max()), near[score.argmax()]
        if inside is None or best < least:
            return pd.DataFrame(columns=names)
        for _ in range(2):
            r, s, t = fit(p[inside][None], q[inside][None])
            inside = errors(p, q, r, s, t)[0] < thresh
        if inside.sum() < least:
            return pd.DataFrame(columns=names)
        r, s, t = fit(p[inside][None], q[inside][None])
        rmse = float(np.sqrt((errors(p[inside], q[inside], r, s, t) ** 2).mean()))
        return pd.DataFrame([[*(rows[k].iloc[0] for k in keys), n, int(inside.sum()), rmse, float(s[0]), r[0].ravel().tolist(), t[0].tolist()]], columns=names)

    types = dict(pairs.dtypes)
    return pairs.groupBy(*keys).applyInPandas(solve, f"{', '.join(f'{k} {types[k]}' for k in keys)}, {_SIMILARITY}")


def lifted(matches: DataFrame, depth: str, u: str, v: str, out: tuple[str, str, str], near: float = 0.15, far: float = 8.0) -> DataFrame:
    """Adds camera points of matched pixels with their depth (fx, fy, cx, cy); rows without a plausible depth go."""
    ok = matches.where(F.col(depth).isNotNull() & ~F.isnan(depth) & (F.col(depth) > near) & (F.col(depth) <= far))
    return ok.withColumns({out[0]: (F.col(u) - F.col("cx")) / F.col("fx") * F.col(depth), out[1]: (F.col(v) - F.col("cy")) / F.col("fy") * F.col(depth), out[2]: F.col(depth).cast("double")})


def triangulated_ratios(matches: DataFrame, keys: tuple[str, ...], *, least: int = 15, kept: int = 8, pixels: float = 2.0) -> DataFrame:
    """(keys, ratio): depth by triangulation over the depth that was estimated, for each match that holds.

    A match has two rays in the world: origin and direction (ax, ay, az, adx, ady, adz and b...), the
    cameras' axes (afx, afy, afz and bf...), their focal lengths in pixels of equal sides (afocal, bfocal)
    and `mono`. The point is the middle of the shortest link of both rays. It holds if it lies 0.2 to 6 m
    before the first camera and 0.2 m or more before the second, falls less than `pixels` beside the
    matched pixel in both images, and is seen at more than 2 degrees from one camera and the other. On
    the plane at distance 1 before a camera the point and the ray differ by the same length in the world's
    axes as in the camera's, so the distance in pixels needs the camera's axis only. All of it is one
    projection; pairs with fewer than `least` matches or `kept` good ones give no row, and of those only matches with mono > 0.1.
    """
    a, b = ([F.col(f"{s}{c}") for c in "xyz"] for s in "ab")
    da, db = ([F.col(f"{s}d{c}") for c in "xyz"] for s in "ab")
    dot = lambda p, q: p[0] * q[0] + p[1] * q[1] + p[2] * q[2]
    minus = lambda p, q: [x - y for x, y in zip(p, q, strict=True)]
    w = minus(a, b)
    aa, bb, ab, aw, bw = dot(da, da), dot(db, db), dot(da, db), dot(da, w), dot(db, w)
    wide = aa * bb - ab * ab
    rows = matches.withColumn("_all", F.count(F.lit(1)).over(_window(keys))).where(F.col("_all") >= least).where(wide > 1e-12)
    rows = rows.withColumn("_ta", (ab * bw - bb * aw) / wide).withColumn("_tb", (aa * bw - ab * aw) / wide)
    middle = [(p + F.col("_ta") * u + q + F.col("_tb") * v) / 2 for p, u, q, v in zip(a, da, b, db, strict=True)]
    rows = rows.withColumns(dict(zip(("_mx", "_my", "_mz"), middle, strict=True)))
    m = [F.col(f"_m{c}") for c in "xyz"]

    def seen(s: str, origin: list, ray: list) -> tuple:
        """Depth of the point before a camera, and its distance to the matched pixel."""
        axis = [F.col(f"{s}f{c}") for c in "xyz"]
        depth, at = dot(minus(m, origin), axis), F.nullif(dot(ray, axis), F.lit(0.0))
        beside = [p / F.nullif(depth, F.lit(0.0)) - r / at for p, r in zip(minus(m, origin), ray, strict=True)]
        return depth, F.sqrt(dot(beside, beside)) * F.col(f"{s}focal")

    (depth, off_a), (depth_b, off_b) = seen("a", a, da), seen("b", b, db)
    pa, pb = minus(m, a), minus(m, b)
    narrow = dot(pa, pb) / F.greatest(F.sqrt(dot(pa, pa)) * F.sqrt(dot(pb, pb)), F.lit(1e-9))
    good = (depth > 0.2) & (depth < 6.0) & (depth_b > 0.2) & (off_a < pixels) & (off_b < pixels) & (narrow < math.cos(math.radians(2.0)))
    rows = rows.where(good).withColumn("ratio", depth / F.col("mono")).withColumn("_kept", F.count(F.lit(1)).over(_window(keys)))
    return rows.where((F.col("_kept") >= kept) & (F.col("mono") > 0.1)).select(*keys, "ratio")


def _window(keys: tuple[str, ...]):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)


def consistent_pixels(pixels: DataFrame, frames: DataFrame, neighbours: DataFrame, tolerance: float = 0.06) -> DataFrame:
    """Pixels (frame, u, v, z) whose depth a neighbouring frame confirms, or that no neighbour could see.

    `frames` (frame, pose, inverse: row-major 4x4, fx, fy, cx, cy, width, height), `neighbours`
    (frame, other). A pixel is moved into the other view and meets the pixel it falls on there by an equality join.
    """
    from ..functions.measure import affine

    own = frames.select("frame", "pose", "fx", "fy", "cx", "cy")
    other = frames.select(F.col("frame").alias("other"), F.col("inverse").alias("_inv"), *[F.col(c).alias(f"_{c}") for c in ("fx", "fy", "cx", "cy", "width", "height")])
    z = F.col("z").cast("double")
    world = affine(F.col("pose"), (F.col("u") - F.col("cx")) / F.col("fx") * z, (F.col("v") - F.col("cy")) / F.col("fy") * z, z)
    rows = pixels.join(own, "frame").withColumns(dict(zip(("_wx", "_wy", "_wz"), world, strict=True))).join(neighbours, "frame").join(other, "other")
    there = affine(F.col("_inv"), F.col("_wx"), F.col("_wy"), F.col("_wz"))
    rows = rows.withColumns(dict(zip(("_bx", "_by", "_bz"), there, strict=True))).where("_bz > 0.2")
    rows = rows.withColumn("_u", F.col("_fx") * F.col("_bx") / F.col("_bz") + F.col("_cx")).withColumn("_v", F.col("_fy") * F.col("_by") / F.col("_bz") + F.col("_cy"))
    rows = rows.where("_u >= 0 and _u < _width - 1 and _v >= 0 and _v < _height - 1").select("frame", "u", "v", "other", "_bz", F.floor("_u").alias("_iu"), F.floor("_v").alias("_iv"))
    seen = pixels.select(F.col("frame").alias("other"), F.col("u").alias("_iu"), F.col("v").alias("_iv"), F.col("z").alias("_ref"))
    met = rows.join(seen, ["other", "_iu", "_iv"]).groupBy("frame", "u", "v").agg(F.max((F.abs(F.col("_bz") - F.col("_ref")) < F.col("_ref") * tolerance).cast("int")).alias("_good"))
    return pixels.join(met.where("_good = 0").select("frame", "u", "v"), ["frame", "u", "v"], "left_anti")


def pair_ratios(moved: DataFrame, keys: tuple[str, ...], least: int = 200) -> DataFrame:
    """(keys, n, ratio): the median of moved over seen depth (zp, zb) of two overlapping views, of plausible ratios, if there are enough."""
    q = F.col("zp") / F.greatest(F.col("zb"), F.lit(1e-3))
    return moved.where((q > 0.5) & (q < 2.0)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile(q, 0.5).alias("ratio")).where(F.col("n") >= least)


def closed_chains(nodes: DataFrame, edges: DataFrame, key: str, iterations: int = 10, soft: float = 0.1) -> DataFrame:
    """(key, node, x, z, yaw): planar pose chains whose loop edges are balanced against their steps by damped least squares; the first pose stays.

    `nodes` (key, node, x, z, yaw), `edges` (key, a, b, dx, dz, dyaw, loop): b as a sees it. A chain
    without a loop edge comes back as it is; large residuals count by a soft absolute value. A step of
    the least squares is solved by conjugate gradients on the normal equations, which are never
    formed: an edge acts on the six numbers of its two poses, so a chain (one group) takes memory and
    time for a pass in proportion to its edges.
    """
    import numpy as np
    import pandas as pd

    def balance(k: tuple, chain: pd.DataFrame, steps: pd.DataFrame) -> pd.DataFrame:
        chain = chain.sort_values("node").reset_index(drop=True)
        if len(chain) < 2 or not len(steps) or not steps["loop"].any():
            return chain[[key, "node", "x", "z", "yaw"]]
        place = {n: i for i, n in enumerate(chain["node"].tolist())}
        steps = steps[steps["a"].isin(place) & steps["b"].isin(place)]
        a, b = (steps[c].map(place).to_numpy() for c in "ab")
        want = steps[["dx", "dz", "dyaw"]].to_numpy(float)
        at = chain[["x", "z", "yaw"]].to_numpy(float)
        n = len(at)
        for _ in range(iterations):
            c, s = np.cos(at[a, 2]), np.sin(at[a, 2])
            d = at[b, :2] - at[a, :2]
            seen = np.stack([c * d[:, 0] + s * d[:, 1], -s * d[:, 0] + c * d[:, 1], at[b, 2] - at[a, 2]], 1)
            left = seen - want
            left[:, 2] = (left[:, 2] + np.pi) % (2 * np.pi) - np.pi
            weight = 1 / np.sqrt(1 + (left / soft) ** 2)

            def moved(v: np.ndarray) -> np.ndarray:
                """Change of the weighted residuals (edges, 3) with the poses' change v (poses, 3)."""
                dx, dz = (v[b, :2] - v[a, :2]).T
                turn = v[a, 2]
                return weight * np.stack([c * dx + s * dz + seen[:, 1] * turn, -s * dx + c * dz - seen[:, 0] * turn, v[b, 2] - turn], 1)

            def gathered(r: np.ndarray) -> np.ndarray:
                """The transpose of moved(): what residuals ask of each pose; the first pose stays."""
                r = weight * r
                x, z = c * r[:, 0] - s * r[:, 1], s * r[:, 0] + c * r[:, 1]
                out = np.zeros((n, 3))
                np.add.at(out, b, np.stack([x, z, r[:, 2]], 1))
                np.add.at(out, a, np.stack([-x, -z, seen[:, 1] * r[:, 0] - seen[:, 0] * r[:, 1] - r[:, 2]], 1))
                out[0] = 0
                return out

            step, rest = np.zeros((n, 3)), -left * weight
            asked = gathered(rest)
            way, size = asked, float((asked**2).sum())
            enough = size * 1e-24
            for _ in range(6 * n):
                if size <= enough:
                    break
                change = moved(way)
                share = size / max(float((change**2).sum()), 1e-300)
                step, rest = step + share * way, rest - share * change
                asked = gathered(rest)
                before, size = size, float((asked**2).sum())
                way = asked + size / before * way
            at += step
        chain[["x", "z", "yaw"]] = at
        return chain[[key, "node", "x", "z", "yaw"]]

    types = dict(nodes.dtypes)
    return nodes.groupBy(key).cogroup(edges.groupBy(key)).applyInPandas(balance, f"{key} {types[key]}, node {types['node']}, x double, z double, yaw double")
