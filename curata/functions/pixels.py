"""Pixel work on height x width x 3 arrays of bytes, for use in Arrow batches."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from .jpeg import recompressed

#: Mean and deviation per channel of the preprocessing, grey of the letterbox, sizes and strengths.
MEAN, STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
LETTERBOX_GREY, LETTERBOX_SHARE, SMALL = 118, 0.6, 20
NOISE, GAMMA_LOW, GAMMA_HIGH, HUE, CONTRAST, BRIGHTNESS = 0.08, 0.45, 2.0, 38, 0.45, 1.25


def png(image: np.ndarray) -> bytes:
    """An RGB picture as PNG bytes."""
    height, width, _ = image.shape
    raw = b"".join(b"\0" + image[y].astype(np.uint8).tobytes() for y in range(height))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, area-averaged when shrinking: a triangle as wide as the step, like common imaging libraries."""
    def weights(old: int, new: int) -> np.ndarray:
        step = old / new
        reach = max(1.0, step)
        centres = (np.arange(new) + 0.5) * step
        w = np.maximum(0, 1 - np.abs((np.arange(old) + 0.5)[None, :] - centres[:, None]) / reach)
        return w / w.sum(1, keepdims=True)

    rows, columns = weights(image.shape[0], height), weights(image.shape[1], width)
    return np.einsum("ab,bcd,ec->aed", rows, image.astype(np.float64), columns)


def to_bytes(image: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(image), 0, 255).astype(np.uint8)


def grey(image: np.ndarray) -> np.ndarray:
    return image[..., :3] @ np.array([0.299, 0.587, 0.114])


def grey_bytes(image: np.ndarray) -> np.ndarray:
    """Grey in whole numbers, by the usual weights in 16-bit fixed point."""
    return ((image[..., :3].astype(np.int64) @ np.array([19595, 38470, 7471]) + 0x8000) >> 16).astype(np.uint8)


def lanczos_weights(old: int, new: int, lobes: int = 3, bits: int = 22) -> np.ndarray:
    """new x old: what each old place gives to a new one, as whole numbers of bits fractional bits. The window is as wide
    as lobes steps where the picture shrinks."""
    step = old / new
    scale = max(1.0, step)
    centres, out = (np.arange(new) + 0.5) * step, np.zeros((new, old), np.int64)
    for k, c in enumerate(centres):
        low, high = max(0, int(c - lobes * scale + 0.5)), min(old, int(c + lobes * scale + 0.5))
        x = (np.arange(low, high) + 0.5 - c) / scale
        w = np.where(np.abs(x) < lobes, np.sinc(x) * np.sinc(x / lobes), 0.0)
        w = w / w.sum() * (1 << bits)
        out[k, low:high] = np.where(w < 0, w - 0.5, w + 0.5).astype(np.int64)
    return out


def lanczos(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """A grey picture of bytes at another size: rows first, then columns, bytes in between."""
    half, bits = 1 << 21, 22
    across = np.clip((image.astype(np.int64) @ lanczos_weights(image.shape[1], width).T + half) >> bits, 0, 255)
    return np.clip((lanczos_weights(image.shape[0], height) @ across + half) >> bits, 0, 255).astype(np.uint8)


def dhash(image: np.ndarray) -> int:
    """The 64-bit difference hash of a picture's grey 8 x 9 version, with the sign its highest bit gives it."""
    small = lanczos(grey_bytes(image), 8, 9)
    bits = int("".join("1" if b else "0" for b in (small[:, :-1] > small[:, 1:]).ravel()), 2)
    return bits - (1 << 64) if bits >> 63 else bits


def preprocess(image: np.ndarray, size: int) -> np.ndarray:
    """Channels x size x size, scaled to 0..1 and normalised per channel."""
    return ((resize(image, size, size) / 255 - MEAN) / STD).transpose(2, 0, 1).astype(np.float32)


def to_hsv(image: np.ndarray) -> np.ndarray:
    """Hue, saturation and value as bytes, cut off below."""
    x = image.astype(np.float64)
    high, low = x.max(-1), x.min(-1)
    span = np.where(high > low, high - low, 1)
    r, g, b = ((high[..., None] - x) / span[..., None]).transpose(2, 0, 1)
    turn = np.select([x[..., 0] == high, x[..., 1] == high], [b - g, 2 + r - b], 4 + g - r)
    # Shares in single precision, as common imaging libraries have them, so that thirds don't fall short.
    hue = np.where(high > low, np.fmod(turn / 6 + 1, 1), 0).astype(np.float32).astype(np.float64)
    much = ((high - low) / np.maximum(high, 1)).astype(np.float32).astype(np.float64)
    return np.stack([(hue * 255).astype(np.uint8), (much * 255).astype(np.uint8), high.astype(np.uint8)], -1)


def from_hsv(image: np.ndarray) -> np.ndarray:
    """RGB of bytes of hue, saturation and value."""
    h, s, v = image.astype(np.float64).transpose(2, 0, 1)
    sixth, s = h * 6 / 255, s / 255
    whole = np.floor(sixth)
    part = sixth - whole
    p, q, t = (np.floor(v * (1 - s * f) + 0.5) for f in (np.ones_like(part), part, 1 - part))
    sides = [(v, t, p), (q, v, p), (p, v, t), (p, q, v), (t, p, v), (v, p, q)]
    return np.select([(whole % 6 == k)[..., None] for k in range(6)], [np.stack(x, -1) for x in sides]).astype(np.uint8)


def _hue(image: np.ndarray, shift: int) -> np.ndarray:
    hsv = to_hsv(image)
    hsv[..., 0] += np.uint8(shift)  # bytes wrap around
    return from_hsv(hsv)


def corrupt(image: np.ndarray, name: str, seed: int) -> np.ndarray:
    """The picture under a named corruption. What recompression gives is that of the format; decoders' own rounding may
    differ by a few units a pixel."""
    x = image.astype(np.float64)
    if name == "jpeg_q25":
        return recompressed(image, 25)
    if name == "gaussian_noise":
        noise = np.random.default_rng(seed).normal(0, NOISE, x.shape).astype(np.float32)
        return (np.clip(image.astype(np.float32) / 255 + noise, 0, 1) * 255).astype(np.uint8)
    if name in ("gamma_low", "gamma_high"):
        return (np.power(x / 255, GAMMA_LOW if name == "gamma_low" else GAMMA_HIGH) * 255).astype(np.uint8)
    if name == "hue_shift":
        return _hue(image, HUE)
    if name == "contrast_crush":
        middle = np.rint(grey(x).mean())
        return to_bytes(to_bytes(middle + (x - middle) * CONTRAST) * BRIGHTNESS)
    if name == "letterbox":
        h, w = image.shape[:2]
        inner = to_bytes(resize(image, max(1, int(h * LETTERBOX_SHARE)), max(1, int(w * LETTERBOX_SHARE))))
        out = np.full_like(image, LETTERBOX_GREY)
        top, left = (h - inner.shape[0]) // 2, (w - inner.shape[1]) // 2
        out[top : top + inner.shape[0], left : left + inner.shape[1]] = inner
        return out
    if name == "downscale":
        return to_bytes(resize(to_bytes(resize(image, SMALL, SMALL)), *image.shape[:2]))
    raise ValueError(f"no corruption named {name}")


def usable(image: np.ndarray) -> str | None:
    """Why a picture can't be judged, or null: too small, too large, too flat."""
    height, width = image.shape[:2]
    if min(height, width) < 48:
        return "too small"
    if height * width > 40_000_000:
        return "too large"
    g = grey(image)
    return "too flat" if g.max() - g.min() < 12 or g.std() < 5 else None
