"""Ray marching and tracing on arrays of rays: all rays of a batch step together, and those that are done drop out."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from millrace.functions.glyphs import HALF, catalog, layout_of
from millrace.functions.rng import uniform_np
from millrace.functions.sdf import AABB, EPSILON, FAR, LETTER, LOWER, PLANK, PLANKS, SPHERES, SUN, SUN_HEIGHT, UPPER, WALL

#: How far a ray goes and how many steps it takes, light, and albedos by material.
MOST_DISTANCE, MOST_STEPS = 100.0, 99
LIGHT = np.array([0.6, 0.6, 1.0]) / np.sqrt(0.6 * 0.6 + 0.6 * 0.6 + 1.0)
SUN_DIRECT, SUN_SEEN, BOX_SEEN = np.array([500.0, 400.0, 100.0]), np.array([50.0, 80.0, 100.0]), np.array([50.0, 0.0, 0.0])
TAU, OFF_SURFACE = 6.283185, 0.1
ALBEDO = np.array(
    [[0, 0, 0], [51, 51, 51], [250, 250, 250], [250, 0, 0], [0, 250, 0], [0, 0, 250], [250, 250, 0], [52, 152, 219], [23, 165, 137], [51, 51, 51], [0, 0, 0], [51, 51, 51]]
) / 255.0
_MIRROR, _DIFFUSE = np.zeros(12, dtype=bool), np.zeros(12, dtype=bool)
_MIRROR[1:7], _DIFFUSE[7:10] = True, True


@dataclass
class _Letter:
    """A placed glyph: its box, and its strokes as arrays."""

    box: tuple[float, float, float, float]
    lines: list[tuple[float, float, float, float]]  # begin and direction
    arcs: list[tuple[str, float, float, float]]

    def distance(self, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
        flat = np.full(len(x), FAR)
        for bx, by, ex, ey in self.lines:
            ox, oy = x - bx, y - by
            t = np.clip((ox * ex + oy * ey) / (ex * ex + ey * ey), 0, 1)
            ox -= ex * t
            oy -= ey * t
            np.minimum(flat, ox * ox + oy * oy, out=flat)
        flat = np.sqrt(flat)
        for kind, cx, cy, r in self.arcs:
            ox, oy = x - cx, y - cy
            d = np.abs(np.sqrt(ox * ox + oy * oy) - r)
            if kind != "o":
                along, across = {"r": (ox, oy), "l": (-ox, oy), "u": (oy, ox), "d": (-oy, ox)}[kind]
                end = across + np.where(across > 0, -r, r)
                d = np.where(along > 0, d, np.sqrt(along * along + end * end))
            np.minimum(flat, d, out=flat)
        flat, z = (v * v for v in (flat, z))
        flat, z = (v * v for v in (flat, z))
        return np.sqrt(np.sqrt(np.sqrt(flat * flat + z * z))) - HALF  # the eighth root of eighth powers


class Scene:
    """Points are given as three arrays, which keeps each pass over memory in line."""

    def __init__(self, word: str) -> None:
        self.letters = []
        for c, shift in layout_of(word):
            g = catalog()[c]
            x0, x1, y0, y1 = g.box
            lines = [(a + shift, b, c - a, d - b) for a, b, c, d in g.lines]
            self.letters.append(_Letter((x0 + shift, x1 + shift, y0, y1), lines, [(k, cx + shift, cy, r) for k, cx, cy, r in g.arcs]))

    def query(self, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distance and material, models in order; see sdf.scene."""
        best, material = np.full(len(x), FAR), np.zeros(len(x), dtype=np.int8)
        depth, rows = np.abs(z) - HALF, {}

        def put(d: np.ndarray, m: int) -> np.ndarray:
            near = d < best + EPSILON
            np.copyto(best, d, where=near)
            material[near] = m
            return near

        for g in self.letters:
            x0, x1, y0, y1 = g.box
            if (y0, y1) not in rows:  # boxes differ in x, mostly
                rows[y0, y1] = np.maximum(np.maximum(y0 - y, y - y1), depth)
            d = np.maximum(np.maximum(x0 - x, x - x1), rows[y0, y1])
            inner = np.flatnonzero(d <= EPSILON)
            if len(inner):
                d[inner] = g.distance(x[inner], y[inner], z[inner])
            near = put(d, AABB)
            if len(inner):
                material[inner[near[inner]]] = LETTER
        ax, az = np.abs(x), np.abs(z)
        (lx, ly, lz), (hx, hy, hz) = LOWER
        hollow = np.minimum(np.minimum(hx - ax, hz - az), np.minimum(y - ly, hy - y))
        (lx, ly, lz), (hx, hy, hz) = UPPER
        np.maximum(hollow, np.minimum(np.minimum(hx - ax, hz - az), np.minimum(y - ly, hy - y)), out=hollow)
        (lx, ly, lz), (hx, hy, hz) = PLANKS
        folded = ax - PLANK * np.floor(ax / PLANK)
        plank = np.maximum(np.maximum(np.maximum(lx - folded, folded - hx), np.maximum(ly - y, y - hy)), np.maximum(lz - z, z - hz))
        put(np.minimum(hollow, plank), WALL)
        for cx, cy, cz, r, m in SPHERES:
            ox, oy, oz = x - cx, y - cy, z - cz
            put(np.sqrt(ox * ox + oy * oy + oz * oz) - r, m)
        sun = SUN_HEIGHT - y
        near = sun < best
        np.copyto(best, sun, where=near)
        material[near] = SUN
        return best, material


def march(origin: np.ndarray, direction: np.ndarray, scene: Scene) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Material, place and normal of what each ray hits: at most MOST_STEPS + 2 samples a ray, the last of which counts as a hit."""
    n = len(origin)
    material, gone, distance = np.zeros(n, dtype=np.int64), np.zeros(n), np.zeros(n)
    live = np.arange(n)
    start, way = [np.ascontiguousarray(origin[:, k]) for k in range(3)], [np.ascontiguousarray(direction[:, k]) for k in range(3)]
    o, v, so_far = start, way, np.zeros(n)
    for step in range(MOST_STEPS + 2):
        d, m = scene.query(*(a + b * so_far for a, b in zip(o, v, strict=True)))
        hit = (d < EPSILON) | (step > MOST_STEPS)
        ended = np.flatnonzero(hit)
        if len(ended):
            i = live[ended]
            material[i], distance[i], gone[i] = m[ended], d[ended], so_far[ended]
        ahead = so_far + d
        on = np.flatnonzero(~hit & (ahead < MOST_DISTANCE))
        if len(on) < len(live):
            lost = np.flatnonzero(~hit & (ahead >= MOST_DISTANCE))
            gone[live[lost]] = so_far[lost]
            live, so_far = live[on], ahead[on]
            o, v = [a[on] for a in o], [a[on] for a in v]
        else:
            so_far = ahead
        if not len(live):
            break
    at = [a + b * gone for a, b in zip(start, way, strict=True)]
    place, normal = np.stack(at, axis=1), np.zeros((n, 3))
    hit = np.flatnonzero(material > 0)
    if len(hit):
        at = [a[hit] for a in at]
        for axis in range(3):
            normal[hit, axis] = scene.query(*(a + EPSILON if k == axis else a for k, a in enumerate(at)))[0] - distance[hit]
        with np.errstate(all="ignore"):
            normal[hit] *= 1 / np.sqrt((normal[hit] ** 2).sum(axis=1))[:, None]
    return material, place, normal


def trace(origin: np.ndarray, direction: np.ndarray, ray: np.ndarray, scene: Scene, bounces: int, stop_at_sun: bool = False) -> np.ndarray:
    """Colours of rays. ray: their indexes, which key the random numbers of each bounce.

    A ray that sees the sun stays where it is and sees it again at each bounce left, unless stop_at_sun is set.
    """
    n = len(direction)
    origin, direction = np.array(np.broadcast_to(origin, (n, 3)), dtype=float), direction.copy()
    colour, weight, live = np.zeros((n, 3)), np.ones((n, 3)), np.arange(n)
    stride = 2 + 2 * bounces
    for bounce in range(bounces):
        if not len(live):
            break
        material, place, normal = march(origin[live], direction[live], scene)
        keep = material > 0
        live, material, place, normal = live[keep], material[keep], place[keep], normal[keep]
        with np.errstate(all="ignore"):
            m = _MIRROR[material]
            i, nm = live[m], normal[m]
            direction[i] += nm * ((nm * direction[i]).sum(axis=1) * -2)[:, None]
            origin[i] = place[m] + direction[i] * OFF_SURFACE
            weight[i] *= ALBEDO[material[m]]

            m = _DIFFUSE[material]
            i, nm = live[m], normal[m]
            if len(i):
                key = ray[i] * stride + 2 + 2 * bounce
                phi, c = TAU * uniform_np(key), uniform_np(key + 1)
                sine, g = np.sqrt(1 - c), np.where(nm[:, 2] < 0, -1.0, 1.0)
                u = -1 / (g + nm[:, 2])
                v = nm[:, 0] * nm[:, 1] * u
                one = np.stack([v, g + nm[:, 1] ** 2 * u, -nm[:, 1]], axis=1) * (np.cos(phi) * sine)[:, None]
                two = np.stack([1 + g * nm[:, 0] ** 2 * u, g * v, -g * nm[:, 0]], axis=1) * (np.sin(phi) * sine)[:, None]
                direction[i] = one + two + nm * np.sqrt(c)[:, None]
                origin[i] = place[m] + direction[i] * OFF_SURFACE
                weight[i] *= ALBEDO[material[m]]
                facing = (nm * LIGHT).sum(axis=1)
                lit = np.flatnonzero((facing > 0) & (material[m] != 7))
                if len(lit):
                    seen, _, _ = march(place[m][lit] + nm[lit] * OFF_SURFACE, np.broadcast_to(LIGHT, (len(lit), 3)), scene)
                    sun = lit[seen == SUN]
                    colour[i[sun]] += weight[i[sun]] * SUN_DIRECT * facing[sun, None]

            m = material == SUN
            colour[live[m]] += weight[live[m]] * SUN_SEEN
            m = material == AABB
            i = live[m]
            origin[i] = place[m] + direction[i] * OFF_SURFACE
            weight[i] *= ALBEDO[AABB]
            colour[i] += weight[i] * BOX_SEEN
        if stop_at_sun:
            live = live[material != SUN]
    return colour
