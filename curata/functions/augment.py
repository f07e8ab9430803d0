"""Random changes of training pictures: what a profile draws for a row, and what each change does to the pixels.

A profile is a list of changes with their ranges. drawn() turns it into changes with fixed parameters, from a generator
seeded by the row's key and the epoch alone; applied() carries those out on an RGB array. So a row's picture is the same
on any partition and after any retry, and a run can record what it did.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np

from .pixels import MEAN, STD, from_hsv, grey, resize, to_bytes, to_hsv

#: The profiles' changes with their ranges, in the order in which they run.
PROFILES: dict[str, tuple[tuple, ...]] = {
    "baseline": (("crop", (0.8, 1.0), (0.9, 1.1)), ("flip", 0.5), ("affine", 10, 0, (1, 1), 0), ("jitter", 0.15, 0.15, 0.10, 0)),
    "robust": (("crop", (0.45, 1.0), (0.75, 1.33)), ("flip", 0.5), ("affine", 20, 0.15, (0.8, 1.25), 10), ("jitter", 0.5, 0.5, 0.4, 0.08), ("grey", 0.30), ("erase", 0.25, (0.02, 0.15))),
    "robust_noflip": (("crop", (0.45, 1.0), (0.75, 1.33)), ("affine", 20, 0.15, (0.8, 1.25), 10), ("jitter", 0.5, 0.5, 0.4, 0.08), ("grey", 0.30), ("erase", 0.25, (0.02, 0.15))),
    "trivialaugment": (("crop", (0.5, 1.0), (0.75, 1.33)), ("flip", 0.5), ("one",), ("erase", 0.25, (0.02, 0.15))),
}
DEFAULT = "baseline"
#: The changes of which "one" takes a single one, each with its strongest setting, of 31 steps; those
#: that have a sign take it by chance. Erased areas are 0.3 to 3.3 times as wide as high.
SIGNED = {"shear_x": 0.99, "shear_y": 0.99, "shift_x": 32, "shift_y": 32, "rotate": 135, "brightness": 0.99, "saturation": 0.99, "contrast": 0.99, "sharpness": 0.99}
UNSIGNED = {"nothing": 0, "posterise": 6, "solarise": 255, "stretch": 0, "equalise": 0}
STEPS, ERASED_RATIO = 31, (0.3, 3.3)


def profile(name: str) -> tuple[tuple, ...]:
    if name not in PROFILES:
        raise ValueError(f"no augmentation profile {name!r}; there are {', '.join(PROFILES)}")
    return PROFILES[name]


def generator(seed: int, epoch: int, key: object) -> np.random.Generator:
    """The row's own generator: seed, epoch and key decide."""
    return np.random.default_rng(int.from_bytes(hashlib.sha256(f"{seed}:{epoch}:{key}".encode()).digest()[:16], "big"))


def _area(draw: np.random.Generator, height: int, width: int, share: tuple, ratio: tuple) -> tuple[int, int, int, int] | None:
    """top, left, height, width of a random area with a share of the picture and a ratio of width to height, which is
    drawn on a logarithmic scale; None if ten of them did not fit."""
    for _ in range(10):
        area, aspect = height * width * draw.uniform(*share), math.exp(draw.uniform(math.log(ratio[0]), math.log(ratio[1])))
        h, w = round(math.sqrt(area / aspect)), round(math.sqrt(area * aspect))
        if 0 < h <= height and 0 < w <= width:
            return int(draw.integers(0, height - h + 1)), int(draw.integers(0, width - w + 1)), h, w
    return None


def _middle(height: int, width: int, ratio: tuple) -> tuple[int, int, int, int]:
    """The largest area in the middle whose ratio lies in the range."""
    aspect = min(max(width / height, ratio[0]), ratio[1])
    h, w = min(height, round(width / aspect)), min(width, round(height * aspect))
    return (height - h) // 2, (width - w) // 2, max(1, h), max(1, w)


def drawn(name: str, draw: np.random.Generator, height: int, width: int, size: int) -> list[tuple]:
    """The profile's changes with fixed parameters, for a picture of height x width that becomes size x size."""
    out: list[tuple] = []
    for kind, *said in profile(name):
        if kind == "crop":
            out.append(("crop", *(_area(draw, height, width, *said) or _middle(height, width, said[1])), size))
        elif kind in ("flip", "grey"):
            if draw.random() < said[0]:
                out.append((kind,))
        elif kind == "affine":
            degrees, shift, scale, shear = said
            out.append(("affine", draw.uniform(-degrees, degrees), *(np.rint(draw.uniform(-shift, shift, 2) * size)), draw.uniform(*scale), draw.uniform(-shear, shear), 0.0))
        elif kind == "jitter":
            changes = [(c, draw.uniform(1 - v, 1 + v)) for c, v in zip(("brightness", "contrast", "saturation"), said, strict=False)] + [("hue", draw.uniform(-said[3], said[3]))]
            out += [changes[k] for k in draw.permutation(4) if changes[k][0] != "hue" or said[3]]
        elif kind == "one":
            which = sorted([*SIGNED, *UNSIGNED])[int(draw.integers(0, len(SIGNED) + len(UNSIGNED)))]
            much = int(draw.integers(0, STEPS)) / (STEPS - 1)
            sign = -1 if draw.random() < 0.5 else 1
            out += _single(which, much * SIGNED[which] * sign if which in SIGNED else much * UNSIGNED[which])
        elif kind == "erase" and draw.random() < said[0]:
            area = _area(draw, size, size, said[1], ERASED_RATIO)
            out += [("erase", *area)] if area else []
    return out


def _single(which: str, value: float) -> list[tuple]:
    """One change of the list for "one" as changes that applied() knows."""
    turns = {"rotate": (value, 0, 0, 1, 0, 0), "shift_x": (0, int(value), 0, 1, 0, 0), "shift_y": (0, 0, int(value), 1, 0, 0), "shear_x": (0, 0, 0, 1, math.degrees(math.atan(value)), 0), "shear_y": (0, 0, 0, 1, 0, math.degrees(math.atan(value)))}
    if which in turns:
        return [("affine", *turns[which])]
    if which == "posterise":
        return [("posterise", 8 - round(value))]
    if which == "solarise":
        return [("solarise", 255 - value)]
    if which in ("stretch", "equalise"):
        return [(which,)]
    return [] if which == "nothing" else [(which, 1 + value)]


def warped(image: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Each pixel of the result takes the place that inverse (2 x 3, from the centre of the picture) sends it to, blended
    from the four pixels around; what lies outside is black."""
    height, width = image.shape[:2]
    cy, cx = (height - 1) / 2, (width - 1) / 2
    y, x = np.mgrid[0:height, 0:width]
    sx = inverse[0, 0] * (x - cx) + inverse[0, 1] * (y - cy) + inverse[0, 2] + cx
    sy = inverse[1, 0] * (x - cx) + inverse[1, 1] * (y - cy) + inverse[1, 2] + cy
    # Rounding in the matrix must not pull in a neighbour or the black outside.
    sx, sy = (np.where(np.abs(s - np.rint(s)) < 1e-9, np.rint(s), s) for s in (sx, sy))
    left, top = np.floor(sx).astype(int), np.floor(sy).astype(int)
    out = np.zeros(image.shape, np.float64)
    for dy in (0, 1):
        for dx in (0, 1):
            row, column = top + dy, left + dx
            weight = (1 - np.abs(sy - row)) * (1 - np.abs(sx - column))
            inside = (row >= 0) & (row < height) & (column >= 0) & (column < width)
            out += np.where(inside, weight, 0)[..., None] * image[np.clip(row, 0, height - 1), np.clip(column, 0, width - 1)]
    return out


def inverse_affine(degrees: float, dx: float, dy: float, scale: float, shear_x: float, shear_y: float) -> np.ndarray:
    """The inverse of: shear, scale and turn about the centre (positive: clockwise on the screen), then shift."""
    a, sx, sy = (math.radians(v) for v in (degrees, shear_x, shear_y))
    turn = np.array([[math.cos(a), -math.sin(a)], [math.sin(a), math.cos(a)]])
    forward = scale * turn @ np.array([[1, math.tan(sx)], [0, 1]]) @ np.array([[1, 0], [math.tan(sy), 1]])
    back = np.linalg.inv(forward)
    return np.column_stack([back, -back @ [dx, dy]])


def _blend(image: np.ndarray, other: np.ndarray | float, factor: float) -> np.ndarray:
    return to_bytes(other + (image.astype(np.float64) - other) * factor)


def _smoothed(image: np.ndarray) -> np.ndarray:
    """Each inner pixel with its neighbours, itself counted 5 times; the rim stays."""
    x, out = image.astype(np.float64), image.astype(np.float64)
    if min(image.shape[:2]) > 2:
        out[1:-1, 1:-1] = (sum(x[1 + dy : x.shape[0] - 1 + dy, 1 + dx : x.shape[1] - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)) + 4 * x[1:-1, 1:-1]) / 13
    return to_bytes(out)


def _stretched(channel: np.ndarray) -> np.ndarray:
    low, high = int(channel.min()), int(channel.max())
    return channel if low == high else ((channel.astype(int) - low) * 255 // (high - low)).astype(np.uint8)


def _equalised(channel: np.ndarray) -> np.ndarray:
    """The channel with values spread so that each is about as frequent as any other."""
    counts = np.bincount(channel.ravel(), minlength=256)
    used = np.flatnonzero(counts)
    step = (counts.sum() - counts[used[-1]]) // 255
    if not step:
        return channel
    ahead = np.concatenate([[0], np.cumsum(counts)[:-1]])
    return np.minimum((ahead + step // 2) // step, 255).astype(np.uint8)[channel]


def applied(image: np.ndarray, changes: list[tuple]) -> np.ndarray:
    """The picture (bytes, RGB) after the changes, but for "erase", which normalised() carries out."""
    x = image
    for kind, *said in changes:
        if kind == "crop":
            top, left, h, w, size = said
            x = to_bytes(resize(x[top : top + h, left : left + w], size, size))
        elif kind == "flip":
            x = x[:, ::-1]
        elif kind == "affine":
            x = to_bytes(warped(x, inverse_affine(*said)))
        elif kind == "brightness":
            x = _blend(x, 0.0, *said)
        elif kind == "contrast":
            x = _blend(x, float(np.rint(grey(x).mean())), *said)
        elif kind == "saturation":
            x = _blend(x, np.rint(grey(x))[..., None], *said)
        elif kind == "sharpness":
            x = _blend(x, _smoothed(x).astype(np.float64), *said)
        elif kind == "hue":
            hsv = to_hsv(x)
            hsv[..., 0] = (hsv[..., 0].astype(int) + int(said[0] * 255)) % 256
            x = from_hsv(hsv)
        elif kind == "grey":
            x = np.repeat(to_bytes(grey(x))[..., None], 3, 2)
        elif kind == "posterise":
            x = x & np.uint8(256 - (1 << (8 - said[0])))
        elif kind == "solarise":
            x = np.where(x >= said[0], 255 - x, x)
        elif kind in ("stretch", "equalise"):
            x = np.stack([(_stretched if kind == "stretch" else _equalised)(x[..., k]) for k in range(3)], -1)
        elif kind != "erase":
            raise ValueError(f"no change named {kind}")
    return x


def normalised(image: np.ndarray, size: int, changes: list[tuple] = ()) -> np.ndarray:
    """Channels x size x size of the changed picture, normalised per channel; erased areas are 0. Without changes, what
    is judged: profiles don't reach it."""
    x = applied(image, changes)
    if x.shape[:2] != (size, size):
        x = to_bytes(resize(x, size, size))
    out = ((x / 255 - MEAN) / STD).transpose(2, 0, 1).astype(np.float32)
    for kind, *said in changes:
        if kind == "erase":
            top, left, h, w = said
            out[:, top : top + h, left : left + w] = 0
    return out
