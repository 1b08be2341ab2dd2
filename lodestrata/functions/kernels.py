"""Image kernels in numpy, over height x width x 3 arrays of BGR bytes.

Definitions are the usual documented ones (BT.601 grey, CIE LAB under D65,
hexcone HSV with hue 0-179); equality with any imaging library to the last bit
is not claimed.
"""

from __future__ import annotations

import numpy as np

from ..operators.stateful import label_components, merge_color, merge_shapes

# --- planes ----------------------------------------------------------------


def decode(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """BGR bytes of an image row as height x width x 3; grey and alpha images are brought to that."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(a, 3, axis=2) if channels == 1 else a[:, :, :3]


def gray(bgr: np.ndarray) -> np.ndarray:
    """In whole thousandths, halves up: the same on every machine."""
    return ((bgr.astype(np.uint32) @ np.array([114, 587, 299], np.uint32) + 500) // 1000).astype(np.uint8)


def hsv(bgr: np.ndarray) -> np.ndarray:
    b, g, r = (bgr[:, :, k].astype(np.float64) for k in range(3))
    v = np.maximum(np.maximum(b, g), r)
    d = v - np.minimum(np.minimum(b, g), r)
    safe = np.where(d == 0, 1, d)
    h = np.where(v == r, (g - b) / safe, np.where(v == g, 2 + (b - r) / safe, 4 + (r - g) / safe)) * 30
    h = np.where(d == 0, 0, np.where(h < 0, h + 180, h))
    return np.stack([np.rint(h) % 180, np.rint(np.where(v == 0, 0, d / np.where(v == 0, 1, v) * 255)), v], axis=2).astype(np.uint8)


def from_hsv(x: np.ndarray) -> np.ndarray:
    h, s, v = x[:, :, 0].astype(np.float64) / 30, x[:, :, 1] / 255.0, x[:, :, 2].astype(np.float64)
    k = lambda n: (n + h) % 6
    f = lambda n: v - v * s * np.clip(np.minimum(k(n), 4 - k(n)), 0, 1)
    return np.rint(np.stack([f(1), f(3), f(5)], axis=2)).clip(0, 255).astype(np.uint8)


_RGB_XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
_WHITE = np.array([0.950456, 1.0, 1.088754])


def lab(bgr: np.ndarray) -> np.ndarray:
    """L scaled to 0-255, a and b centred at 128."""
    c = bgr[:, :, ::-1].astype(np.float64) / 255
    c = np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92) @ _RGB_XYZ.T / _WHITE
    f = np.where(c > 0.008856, np.cbrt(c), 7.787 * c + 16 / 116)
    light = np.where(c[:, :, 1] > 0.008856, 116 * np.cbrt(c[:, :, 1]) - 16, 903.3 * c[:, :, 1])
    return np.stack([light * 255 / 100, 500 * (f[:, :, 0] - f[:, :, 1]) + 128, 200 * (f[:, :, 1] - f[:, :, 2]) + 128], axis=2)


def from_lab(x: np.ndarray) -> np.ndarray:
    light, a, b = x[:, :, 0] * 100 / 255, x[:, :, 1] - 128, x[:, :, 2] - 128
    fy = (light + 16) / 116
    f = np.stack([fy + a / 500, fy, fy - b / 200], axis=2)
    c = np.where(f > 6 / 29, f**3, (f - 16 / 116) / 7.787) * _WHITE @ np.linalg.inv(_RGB_XYZ).T
    c = np.where(c > 0.0031308, 1.055 * np.maximum(c, 0) ** (1 / 2.4) - 0.055, 12.92 * c)
    return np.rint(c[:, :, ::-1] * 255).clip(0, 255).astype(np.uint8)


def convolve(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Same-size correlation with mirrored edges."""
    ry, rx = kernel.shape[0] // 2, kernel.shape[1] // 2
    p = np.pad(x.astype(np.float64), ((ry, ry), (rx, rx)), mode="reflect")
    return sum(kernel[j, i] * p[j : j + x.shape[0], i : i + x.shape[1]] for j in range(kernel.shape[0]) for i in range(kernel.shape[1]) if kernel[j, i])


def blur(x: np.ndarray, size: int) -> np.ndarray:
    """Gaussian of ``size`` taps, one way after the other."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    taps = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma * sigma))
    taps /= taps.sum()
    r = size // 2
    for axis in (0, 1):
        r = min(size // 2, x.shape[axis] - 1)
        own = taps[size // 2 - r : size // 2 + r + 1] / taps[size // 2 - r : size // 2 + r + 1].sum()
        pad = [(0, 0), (0, 0)]
        pad[axis] = (r, r)
        p = np.pad(x.astype(np.float64), pad, mode="reflect")
        x = sum(w * (p[k : k + x.shape[0]] if axis == 0 else p[:, k : k + x.shape[1]]) for k, w in enumerate(own))
    return x


# --- frame measures --------------------------------------------------------


def sharpness(g: np.ndarray) -> float:
    """Variance of the Laplacian."""
    return float(convolve(g, np.array([[0, 1, 0], [1, -4, 1], [0, 1, 0]])).var())


def shift(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """(dx, dy) by which ``b`` is moved against ``a``: the peak of the phase correlation, refined by its 5 x 5 centroid."""
    cross = np.fft.fft2(b.astype(np.float64)) * np.conj(np.fft.fft2(a.astype(np.float64)))
    r = np.fft.fftshift(np.fft.ifft2(cross / np.maximum(np.abs(cross), 1e-12)).real)
    y, x = np.unravel_index(int(r.argmax()), r.shape)
    y0, x0 = max(0, y - 2), max(0, x - 2)
    near = np.maximum(r[y0 : y + 3, x0 : x + 3], 0)
    total = max(near.sum(), 1e-12)
    cy = (near.sum(axis=1) @ np.arange(y0, y0 + near.shape[0])) / total
    cx = (near.sum(axis=0) @ np.arange(x0, x0 + near.shape[1])) / total
    return float(cx - r.shape[1] // 2), float(cy - r.shape[0] // 2)


def shrunk(g: np.ndarray, size: int = 16) -> np.ndarray:
    """Bilinear reduction to ``size`` x ``size``, pixel centres aligned."""
    out = g.astype(np.float64)
    for axis in (0, 1):
        n = out.shape[axis]
        at = np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        part = (at - low).reshape((-1, 1) if axis == 0 else (1, -1))
        high = np.minimum(low + 1, n - 1)
        out = out.take(low, axis) * (1 - part) + out.take(high, axis) * part
    return out


def signature(g: np.ndarray) -> np.ndarray:
    return np.rint(shrunk(g)).astype(np.float32).reshape(-1)


def color_histogram(bgr: np.ndarray) -> np.ndarray:
    """8 x 8 x 8 bins of hue, saturation and value that add up to 1."""
    x = hsv(bgr).astype(np.int64)
    k = (x[:, :, 0] * 8 // 180) * 64 + (x[:, :, 1] // 32) * 8 + x[:, :, 2] // 32
    return np.bincount(k.reshape(-1), minlength=512) / k.size


def measures(bgr: np.ndarray) -> dict:
    g = gray(bgr)
    return {"sharpness": sharpness(g), "mean": float(g.mean()), "std": float(g.std()), "signature": signature(g).tolist(), "histogram": color_histogram(bgr).tolist()}


# --- enhancement -----------------------------------------------------------


def equalised(x: np.ndarray) -> np.ndarray:
    n = np.bincount(x.reshape(-1), minlength=256)
    c = n.cumsum()
    low = c[np.flatnonzero(n)[0]]
    return x if low == x.size else np.rint((c - low) * 255 / (x.size - low)).clip(0, 255).astype(np.uint8)[x]


def clahe(x: np.ndarray, limit: float, tiles: int = 8) -> np.ndarray:
    """Contrast-limited adaptive equalisation: clipped tile histograms, bilinear between tile centres."""
    h, w = x.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    p = np.pad(x, ((0, th * tiles - h), (0, tw * tiles - w)), mode="symmetric")
    maps = np.empty((tiles, tiles, 256))
    most = max(1, int(limit * th * tw / 256))
    for i in range(tiles):
        for j in range(tiles):
            n = np.bincount(p[i * th : (i + 1) * th, j * tw : (j + 1) * tw].reshape(-1), minlength=256)
            over = int(np.maximum(n - most, 0).sum())
            n = np.minimum(n, most) + over // 256
            n[: over % 256] += 1
            maps[i, j] = n.cumsum() * 255 / (th * tw)
    ys, xs = (np.arange(h) + 0.5) / th - 0.5, (np.arange(w) + 0.5) / tw - 0.5
    y0, x0 = np.floor(ys).astype(int), np.floor(xs).astype(int)
    fy, fx = (ys - y0)[:, None], (xs - x0)[None]
    at = lambda dy, dx: maps[np.clip(y0 + dy, 0, tiles - 1)[:, None], np.clip(x0 + dx, 0, tiles - 1)[None], x]
    out = (at(0, 0) * (1 - fx) + at(0, 1) * fx) * (1 - fy) + (at(1, 0) * (1 - fx) + at(1, 1) * fx) * fy
    return np.rint(out).clip(0, 255).astype(np.uint8)


def _saturated(bgr: np.ndarray, factor: float, equal: bool = False) -> np.ndarray:
    x = hsv(bgr)
    x[:, :, 1] = np.clip(x[:, :, 1] * factor, 0, 255).astype(np.uint8)
    if equal:
        x[:, :, 2] = equalised(x[:, :, 2])
    return from_hsv(x)


def _relit(bgr: np.ndarray, change) -> np.ndarray:
    x = lab(bgr)
    x[:, :, 0] = change(np.rint(x[:, :, 0]).clip(0, 255).astype(np.uint8))
    return from_lab(x)


def _lifted(light: np.ndarray) -> np.ndarray:
    mask = blur(np.clip((120 - light.astype(np.float64)) / 120, 0, 1), 31)
    return clahe(np.clip(light + 130 * mask, 0, 255).astype(np.uint8), 2.0)


def _dimmed(light: np.ndarray) -> np.ndarray:
    mask = blur(np.clip((light.astype(np.float64) - 220) / 35, 0, 1), 51)
    lower = np.clip(light - 40 * mask, 0, 255).astype(np.uint8)
    return np.where(mask > 0.3, clahe(lower, 3.0), lower)


def enhanced(bgr: np.ndarray, variant: str = "v3") -> np.ndarray:
    """v1 saturated and equalised, v2 gamma and local contrast, v3 lifted shadows, v4 dimmed highlights; orig as it is."""
    if variant == "orig":
        return bgr
    if variant == "v1":
        return _saturated(bgr, 1.8, equal=True)
    if variant == "v2":
        return _saturated(_relit(bgr, lambda x: clahe((255 * (x / 255.0) ** 0.7).astype(np.uint8), 2.0)), 1.6)
    if variant == "v3":
        return _saturated(_relit(bgr, _lifted), 1.6)
    if variant == "v4":
        return _relit(bgr, _dimmed)
    raise ValueError(f"no variant is called {variant}")


# --- colour anomalies ------------------------------------------------------


def _shifted(mask: np.ndarray, size: int, least: bool) -> np.ndarray:
    r = size // 2
    p = np.pad(mask, r, constant_values=least)
    parts = [p[j : j + mask.shape[0], i : i + mask.shape[1]] for j in range(size) for i in range(size)]
    return np.logical_and.reduce(parts) if least else np.logical_or.reduce(parts)


def opened(mask: np.ndarray, size: int) -> np.ndarray:
    return _shifted(_shifted(mask, size, True), size, False)


def closed(mask: np.ndarray, size: int) -> np.ndarray:
    return _shifted(_shifted(mask, size, False), size, True)


def zone_at(x: float, y: float, width: int, height: int) -> int:
    third = lambda v, n: 0 if v < n // 3 else 1 if v < n * 2 // 3 else 2
    return third(y, height) * 3 + third(x, width) + 1 if 0 <= x < width and 0 <= y < height else 5


def color_word(a: float, b: float) -> str:
    a, b = a - 128, b - 128
    rules = (("blue", a < -5 and b < 15), ("orange", a > 20 and b > 10), ("yellow", a > 5 and b > 25), ("red", a > 20 and b < 10), ("green", a < -10 and b > 10), ("magenta", a > 15 and b < -5))
    return next((name for name, holds in rules if holds), "unknown")


def rare_map(a: np.ndarray, b: np.ndarray, colorful: np.ndarray, bins: int = 32) -> np.ndarray:
    """``-ln(share + 1e-10)`` of each colourful pixel's smoothed chromaticity bin, 0 elsewhere; all 0 below 50 such pixels."""
    out = np.zeros(a.shape)
    if colorful.sum() < 50:
        return out
    k = np.clip((np.stack([a, b]) * bins / 256).astype(int), 0, bins - 1)
    n = np.bincount((k[0] * bins + k[1])[colorful], minlength=bins * bins).reshape(bins, bins).astype(np.float64)
    n = convolve(n, np.outer([1, 2, 1], [1, 2, 1]) / 16)
    share = n / n.sum()
    return np.where(colorful, -np.log(share[k[0], k[1]] + 1e-10), 0.0)


def color_anomalies(bgr: np.ndarray, top: int = 100, bottom: int = 30, left: int = 250) -> list[dict]:
    """Small regions of rare colour, most confident first."""
    h, w = bgr.shape[:2]
    x = lab(bgr)
    a, b = x[:, :, 1], x[:, :, 2]
    strong = np.hypot(a - 128, b - 128)
    colorful = strong > 10
    rare = rare_map(a, b, colorful)
    if not rare.any():
        return []
    mask = (rare > np.percentile(rare[colorful], 97)) & colorful
    mask[:top] = mask[h - bottom :] = False
    mask[:, :left] = False
    label = label_components(closed(opened(mask, 3), 5))
    n = int(label.max())
    if not n:
        return []
    flat = label.reshape(-1)
    area = np.bincount(flat, minlength=n + 1)
    mean = lambda v: np.bincount(flat, v.reshape(-1), n + 1) / np.maximum(area, 1)
    ys, xs = np.indices((h, w))
    means = [mean(v) for v in (a, b, strong, rare, xs, ys)]
    out = []
    for k in range(1, n + 1):
        am, bm, cf, ra, cx, cy = (float(m[k]) for m in means)
        if not 50 <= area[k] <= h * w * 0.01 or ra < 2.5:
            continue
        py, px = np.nonzero(label == k)
        box = {"x": int(px.min()), "y": int(py.min()), "w": int(np.ptp(px)) + 1, "h": int(np.ptp(py)) + 1}
        compact = area[k] / max(box["w"] * box["h"], 1)
        sure = min(1.0, cf / 80 * 0.3 + min(ra / 5, 1.0) * 0.4 + compact * 0.3)
        out.append({"color": color_word(am, bm), "zone": zone_at(cx, cy, w, h), "area": int(area[k]), "bbox": box, "centroid": {"x": int(cx), "y": int(cy)}, "confidence": round(sure, 4), "colorfulness": round(cf, 2), "rarity": round(ra, 2), "avg_lab": {"a": round(am, 1), "b": round(bm, 1)}})
    return sorted(merge_color(out), key=lambda f: -f["confidence"])


# --- shapes ----------------------------------------------------------------


def edges(g: np.ndarray, low: float = 50, high: float = 150) -> np.ndarray:
    """Canny: gradient maxima along the gradient, weak ones kept where they touch strong ones."""
    smooth = blur(g, 5)
    gx = convolve(smooth, np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]]))
    gy = convolve(smooth, np.array([[-1, -2, -1], [0, 0, 0], [1, 2, 1]]))
    mag = np.hypot(gx, gy)
    way = (np.rint(np.degrees(np.arctan2(gy, gx)) / 45).astype(int)) % 4
    p = np.pad(mag, 1)
    h, w = mag.shape
    at = lambda dy, dx: p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    peak = np.zeros((h, w), bool)
    for k, (dy, dx) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1))):
        peak |= (way == k) & (mag >= at(dy, dx)) & (mag > at(-dy, -dx))
    weak, strong = peak & (mag >= low), peak & (mag >= high)
    label = label_components(weak)
    keep = np.zeros(int(label.max()) + 1, bool)
    keep[label[strong]] = True
    keep[0] = False
    return keep[label]


_AROUND = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))


def contour(mask: np.ndarray) -> np.ndarray:
    """Outer border of one component as (x, y) points in order (Moore tracing)."""
    p = np.pad(mask, 1)
    ys, xs = np.nonzero(p)
    start = (int(ys[0]), int(xs[0]))
    out, at, way = [start], start, 6
    for _ in range(4 * len(ys) + 8):
        for k in range(8):
            d = (way + 6 + k) % 8
            nxt = (at[0] + _AROUND[d][0], at[1] + _AROUND[d][1])
            if p[nxt]:
                at, way = nxt, d
                break
        else:
            break
        if at == start:
            break
        out.append(at)
    return np.array(out)[:, ::-1] - 1


def simplified(points: np.ndarray, eps: float) -> np.ndarray:
    """Douglas-Peucker on a closed border, cut at the point farthest from its middle and the one farthest from that."""
    if len(points) < 3:
        return points
    points = np.roll(points, -int(np.hypot(*(points - points.mean(axis=0)).T).argmax()), axis=0)
    far = int(np.hypot(*(points - points[0]).T).argmax())
    ring = np.vstack([points, points[:1]])
    keep = {0, far}
    todo = [(0, far), (far, len(points))]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d = ring[b] - ring[a]
        off = ring[a + 1 : b] - ring[a]
        size = np.hypot(*d)
        dist = np.abs(d[0] * off[:, 1] - d[1] * off[:, 0]) / size if size else np.hypot(*off.T)
        k = int(dist.argmax())
        if dist[k] > eps:
            keep.add(a + 1 + k)
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return points[sorted(keep)]


def polygon_area(p: np.ndarray) -> float:
    x, y = p[:, 0].astype(float), p[:, 1].astype(float)
    return abs(float(x @ np.roll(y, -1) - y @ np.roll(x, -1))) / 2


def perimeter(p: np.ndarray) -> float:
    return float(np.hypot(*(np.roll(p, -1, axis=0) - p).T).sum())


def rectangle_score(p: np.ndarray) -> float:
    """Half how full the smallest turned box is, half how equal its opposite sides are (1, as it is a true box)."""
    best = np.inf
    for d in np.roll(p, -1, axis=0) - p:
        size = np.hypot(*d)
        if size:
            u = d / size
            s, t = p @ u, p @ np.array([-u[1], u[0]])
            best = min(best, float(np.ptp(s) * np.ptp(t)))
    if not 1 <= best < np.inf:
        return 0.0
    own = polygon_area(p)
    return 0.5 * min(own, best) / max(own, best) + 0.5


def _turns(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = p.astype(float)
    v = np.roll(p, -1, axis=0) - p
    u = np.roll(v, 1, axis=0)
    size = np.hypot(*v.T)
    cos = (u * v).sum(axis=1) / (np.hypot(*u.T) * size + 1e-10)
    return size, np.degrees(np.arccos(np.clip(cos, -1, 1)))


def classify(p: np.ndarray, vertices: np.ndarray, area: float, length: float) -> tuple[str | None, float, dict]:
    """(shape, score, extras) by the same ordered rules as the column expression."""
    if area < 80 or length < 1:
        return None, 0.0, {}
    round_ = 4 * np.pi * area / length**2
    n = len(vertices)
    if round_ > 0.88 and n >= 6:
        return "circle", min(1.0, round_), {"circularity": round(round_, 3)}
    if n == 2:
        far = float(np.hypot(*(vertices[1] - vertices[0])))
        return "line", min(1.0, far / 100), {"length": round(far, 1)}
    if n < 3:
        return None, 0.0, {}
    sides, turns = _turns(vertices)
    even = 0.0 if sides.mean() < 1 else min(1.0, 1 / (1 + 2 * sides.std() / sides.mean() + 2 * turns.std() / (turns.mean() + 1e-10)))
    right = int((np.abs(turns - 90) < 12).sum())
    extras = {"regularity": round(float(even), 3), "right_angles": right}
    if n == 3:
        return "triangle", even * 0.7 + right / 3 * 0.3, extras
    if n == 4 and (rect := rectangle_score(p)) > 0.85:
        ratio = float(sides.min() / max(sides.max(), 1e-10))
        return ("square" if ratio > 0.85 else "rectangle"), rect * 0.5 + right / 4 * 0.3 + even * 0.2, extras | {"rect_score": round(rect, 3), "side_ratio": round(ratio, 3)}
    if n >= 5 and even > 0.75:
        return f"polygon-{n}", even, {"regularity": round(float(even), 3)}
    return None, 0.0, {}


def hough_lines(mask: np.ndarray, threshold: int = 50, least: int = 40, gap: int = 8) -> list[tuple[int, int, int, int]]:
    """Segments along the strongest straight lines, longest support first; each edge pixel serves one segment.

    Deterministic: the strongest cell of the accumulator is taken, its pixels
    within one pixel of the line are cut to runs at gaps, and used up.
    """
    ys, xs = (v.astype(float) for v in np.nonzero(mask))
    theta = np.radians(np.arange(180))
    span = int(np.hypot(*mask.shape)) + 1
    out = []
    cell = np.rint(xs[:, None] * np.cos(theta) + ys[:, None] * np.sin(theta)).astype(int) + span if len(xs) else np.empty((0, 180), int)
    key = cell * 180 + np.arange(180)
    votes = np.bincount(key.reshape(-1), minlength=(2 * span + 1) * 180)
    alive = np.ones(len(xs), bool)
    while len(xs) and votes.max() >= threshold:
        best = int(votes.argmax())
        r, t = best // 180 - span, theta[best % 180]
        near = np.flatnonzero(alive & (np.abs(xs * np.cos(t) + ys * np.sin(t) - r) <= 1))
        along = -xs[near] * np.sin(t) + ys[near] * np.cos(t)
        order = near[np.argsort(along, kind="stable")]
        along = np.sort(along)
        found = False
        for run in np.split(np.arange(len(order)), np.flatnonzero(np.diff(along) > gap) + 1):
            if len(run) and along[run[-1]] - along[run[0]] >= least:
                p, q = order[run[0]], order[run[-1]]
                out.append((int(xs[p]), int(ys[p]), int(xs[q]), int(ys[q])))
                used = order[run]
                alive[used] = False
                np.subtract.at(votes, key[used].reshape(-1), 1)
                found = True
        if not found:
            votes[best] = 0
    return out


def hough_circles(mask: np.ndarray, gx: np.ndarray, gy: np.ndarray, low: int = 15, high: int = 80, threshold: int = 80, apart: int = 60) -> list[tuple[int, int, int]]:
    """Centres that edge pixels' gradients point to, with the radius that most pixels have."""
    h, w = mask.shape
    ys, xs = np.nonzero(mask)
    size = np.hypot(gx[ys, xs], gy[ys, xs]) + 1e-10
    ux, uy = gx[ys, xs] / size, gy[ys, xs] / size
    votes = np.zeros((h, w), int)
    for r in range(low, high + 1):
        for sign in (-1, 1):
            cx, cy = np.rint(xs + sign * r * ux).astype(int), np.rint(ys + sign * r * uy).astype(int)
            good = (cx >= 0) & (cx < w) & (cy >= 0) & (cy < h)
            np.add.at(votes, (cy[good], cx[good]), 1)
    total = convolve(votes, np.ones((3, 3)))
    out: list[tuple[int, int, int]] = []
    while total.size and total.max() >= threshold and len(out) < 50:
        cy, cx = np.unravel_index(int(total.argmax()), total.shape)
        dist = np.rint(np.hypot(xs - cx, ys - cy)).astype(int)
        counts = np.bincount(dist[(dist >= low) & (dist <= high)], minlength=high + 1)
        out.append((int(cx), int(cy), int(counts.argmax())))
        total[max(0, cy - apart) : cy + apart + 1, max(0, cx - apart) : cx + apart + 1] = 0
    return out


def verified_circle(mask: np.ndarray, gx: np.ndarray, gy: np.ndarray, cx: int, cy: int, r: int) -> dict | None:
    """Coverage of the circumference by edges, and how radial the gradients are there; null unless it passes."""
    turn = np.radians(np.arange(0, 360, 4))
    x, y = np.rint(cx + r * np.cos(turn)).astype(int), np.rint(cy + r * np.sin(turn)).astype(int)
    h, w = mask.shape
    good = (x >= 0) & (x < w) & (y >= 0) & (y < h)
    x, y, turn = x[good], y[good], turn[good]
    if not len(x):
        return None
    on = _shifted(mask, 3, False)[y, x]
    cover = float(on.mean()) * len(x) / 90
    off = np.degrees(np.arctan2(gy[y, x], gx[y, x]) - turn) % 180
    off = np.minimum(off, 180 - off)[on]
    if cover < 0.5 or not len(off) or off.mean() > 25 or off.std() > 18:
        return None
    return {"edge_coverage": round(cover, 3), "grad_mean_diff": round(float(off.mean()), 2), "grad_std_diff": round(float(off.std()), 2)}


def shapes(bgr: np.ndarray, top: int = 100, bottom: int = 30, left: int = 250) -> list[dict]:
    """Regular shapes of an image, most confident first: contours, lines and circles."""
    h, w = bgr.shape[:2]
    g = gray(bgr)
    mask = closed(edges(g), 3)
    smooth = blur(g, 5)
    gx = convolve(smooth, np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]]))
    gy = convolve(smooth, np.array([[-1, -2, -1], [0, 0, 0], [1, 2, 1]]))
    inside = lambda x, y: x >= left and top <= y < h - bottom
    out = []

    def add(shape: str, box: tuple, centre: tuple, area: float, sure: float, **extras) -> None:
        if sure >= 0.55 and inside(*centre):
            out.append({"shape": shape, "zone": zone_at(*centre, w, h), "area": int(area), "bbox": dict(zip("xywh", map(int, box), strict=True)), "centroid": {"x": int(centre[0]), "y": int(centre[1])}, "confidence": round(float(sure), 4), **extras})

    label = label_components(mask)
    for k in range(1, int(label.max()) + 1):
        p = contour(label == k)
        if len(p) < 3:
            continue
        area, length = polygon_area(p), perimeter(p)
        if not 80 <= area <= h * w * 0.02:
            continue
        v = simplified(p, 0.02 * length)
        shape, score, extras = classify(p, v, area, length)
        if shape and score >= 0.3:
            x, y = p.min(axis=0)
            bw, bh = np.ptp(p, axis=0) + 1
            add(shape, (x, y, bw, bh), (x + bw // 2, y + bh // 2), area, min(1.0, score * 0.7 + min(1.0, area / 500) * 0.3), score=round(float(score), 3), **extras)
    for x1, y1, x2, y2 in hough_lines(mask):
        length = float(np.hypot(x2 - x1, y2 - y1))
        box = (min(x1, x2), min(y1, y2), abs(x2 - x1), abs(y2 - y1))
        add("line", box, ((x1 + x2) // 2, (y1 + y2) // 2), length, min(1.0, length / 100), length=round(length, 1), angle=float(np.degrees(np.arctan2(y2 - y1, x2 - x1)) % 180), endpoints=[x1, y1, x2, y2])
    for cx, cy, r in hough_circles(mask, gx, gy):
        if seen := verified_circle(mask, gx, gy, cx, cy, r):
            radial = max(0.0, 1 - seen["grad_mean_diff"] / 25)
            add("circle", (cx - r, cy - r, 2 * r, 2 * r), (cx, cy), np.pi * r * r, min(1.0, r / 40) * (0.5 + 0.5 * radial), radius=float(r), **seen)
    return sorted(merge_shapes(out), key=lambda f: -f["confidence"])


def png(bgr: np.ndarray) -> bytes:
    """A PNG file of an image, by the standard library."""
    import struct
    import zlib

    h, w = bgr.shape[:2]
    raw = np.concatenate([np.zeros((h, 1), np.uint8), bgr[:, :, ::-1].reshape(h, w * 3)], axis=1).tobytes()
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")
