"""Audio features: polyphase resampling, overlapped log-mel filterbanks, hysteresis energy segmentation.

A clip is 8-bit unsigned mono PCM in a WAV container.  ``clip_features`` resamples it with a windowed-sinc polyphase
filter, takes log-mel frames of 25 ms every 10 ms, and marks active segments: one begins when the frame energy reaches
the clip's mean plus half a deviation and ends when it falls below the mean.  Each segment becomes one tensor of the
fixed shape (``POOL``, ``MELS``), its frames averaged into ``POOL`` equal parts, with its time span in milliseconds.

Three tables follow each other in the shared folder: media (a clip a row); blocks of clips, each with two Arrow streams, the
clips' digests and the segments' time spans with their tensors as Arrow's fixed-shape tensor type of half floats; and what is
read back from these.  Media are read back before features are computed, tensors before they are returned.

Samples are worked through in blocks, so memory does not grow with a clip beyond its bytes and one float row a frame;
each clip is computed by itself, so equal clips give equal values.  Defined results: an empty or null payload is padded
to 64 zero bytes; a clip is padded with silence to whole frames, at least one, so that its last samples are in a frame; ties
with a threshold count as above the high one and not below the low one; repeated rows and null keys give equal rows; an
empty table gives no rows; columns that are not kept are not read, and where a kept one has the name of a result, the
result's name gets underscores (``free_name``).
"""
from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import blocks, free_name, map_rows, shared_table

RATE, TARGET = 16_000, 8_000
FRAME, HOP, FFT, MELS, POOL = 200, 80, 256, 32, 8
_TAPS = 16  # on each side, at the lower of the two rates
_BLOCK = 1 << 17
#: Bytes of media in one block of the tensor table.
_BLOCK_BYTES = 1 << 20


def write_wav(payload: bytes, rate: int = RATE) -> bytes:
    """8-bit unsigned mono PCM; an odd payload gets the container's pad byte."""
    pad = len(payload) & 1
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload + b"\0" * pad


def read_wav(media: bytes) -> tuple[int, bytes]:
    """(rate, payload) of the container's data chunk; ValueError for other formats."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, None
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM")
        elif name == b"data" and rate:
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def polyphase(up: int, down: int) -> np.ndarray:
    """Filter bank: row p holds the taps of output phase p (Hann-windowed sinc, unit gain)."""
    half = _TAPS * max(up, down)
    n = np.arange(-half, half + 1)
    h = np.sinc(n / max(up, down)) * (0.5 + 0.5 * np.cos(np.pi * n / (half + 1)))
    h *= up / h.sum()
    width = -(-len(h) // up)
    bank = np.zeros((up, width))
    for p in range(up):
        own = h[p::up]
        bank[p, : len(own)] = own
    return bank[:, ::-1].astype(np.float32)


def resample(x: np.ndarray, up: int, down: int, bank: np.ndarray) -> np.ndarray:
    """Output m is the bank's phase (m * down) mod up over the inputs round m * down / up; silence beyond the ends."""
    width, half = bank.shape[1], _TAPS * max(up, down)
    total = -(-len(x) * up // down)
    padded = np.concatenate((np.zeros(width, np.float32), x, np.zeros(width, np.float32)))
    windows = np.lib.stride_tricks.sliding_window_view(padded, width)
    out = np.empty(total, np.float32)
    for lo in range(0, total, _BLOCK):
        m = np.arange(lo, min(total, lo + _BLOCK))
        place = m * down + half
        phase, last = place % up, place // up  # newest input sample that the output sees
        for p in range(up):
            own = phase == p
            first, n = (last[own][0], int(own.sum())) if own.any() else (0, 0)
            if n:
                begin, step = first + 1, (last[own][1] - first if n > 1 else 1)
                out[m[own]] = windows[begin : begin + (n - 1) * step + 1 : step] @ bank[p]
    return out


def mel_bank(rate: int = TARGET) -> np.ndarray:
    """Triangular filters, equally spaced in mels: bins x MELS."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(20.0), mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.arange(FFT // 2 + 1) * rate / FFT
    rise = (f[:, None] - edges[None, :-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[None, 2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


_HANN = (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(FRAME) / FRAME)).astype(np.float32)
_MEL = mel_bank()
_BANKS: dict[tuple[int, int], np.ndarray] = {}


def log_mel(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel frames (frames x MELS) and frame energies in decibels."""
    whole = FRAME + max(0, -(-(len(y) - FRAME) // HOP)) * HOP
    y = np.concatenate((y, np.zeros(whole - len(y), np.float32)))
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    mels, energy = [], []
    for lo in range(0, len(frames), 1024):
        part = frames[lo : lo + 1024]
        energy.append(10 * np.log10((part * part).mean(axis=1) + 1e-10))
        spectrum = np.fft.rfft(part * _HANN, FFT)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        mels.append(np.log10(power @ _MEL + 1e-10))
    return np.concatenate(mels), np.concatenate(energy)


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Half-open frame ranges between reaching the high threshold and falling below the low one."""
    mean = energy.mean()
    high, low = energy >= mean + 0.5 * energy.std(), energy < mean
    state = np.where(high, 1, np.where(low, -1, 0))
    known = np.maximum.accumulate(np.where(state != 0, np.arange(len(state)), -1))
    on = np.where(known >= 0, state[known], -1) > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([False], on, [False]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def clip_features(media: bytes) -> dict:
    """frames, mean (MELS), and segments: start_ms, end_ms, tensor (POOL * MELS values, row by row)."""
    rate, payload = read_wav(media)
    x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    g = np.gcd(TARGET, rate)
    up, down = int(TARGET // g), int(rate // g)
    if (up, down) not in _BANKS:
        _BANKS[up, down] = polyphase(up, down)
    bank = _BANKS[up, down]
    mels, energy = log_mel(resample(x, up, down, bank))
    sums = np.concatenate((np.zeros((1, MELS)), np.cumsum(mels, axis=0, dtype=np.float64)))
    found = segments(energy)
    out = []
    if found:
        a, b = np.array(found).T
        cut = a[:, None] + (b - a)[:, None] * np.arange(POOL)[None, :] // POOL
        end = np.maximum(cut + 1, np.concatenate((cut[:, 1:], b[:, None]), axis=1))
        tensors = ((sums[end] - sums[cut]) / (end - cut)[:, :, None]).round(4).astype(np.float32).reshape(len(a), -1)
        out = [{"start_ms": s * HOP * 1000 / TARGET, "end_ms": ((e - 1) * HOP + FRAME) * 1000 / TARGET, "tensor": t} for (s, e), t in zip(found, tensors)]
    return {"frames": len(mels), "mean": (sums[-1] / len(mels)).round(4), "segments": out}


def tensor_array(values: list) -> pa.FixedShapeTensorArray:
    """Tensors of segments as Arrow's fixed-shape tensor type."""
    flat = np.asarray(values, np.float16).reshape(-1)
    storage = pa.FixedSizeListArray.from_arrays(pa.array(flat, pa.float16()), POOL * MELS)
    return pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.float16(), [POOL, MELS]), storage)


def packed(columns: dict[str, pa.Array]) -> bytes:
    """One record batch as an Arrow stream."""
    batch = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def text_payload(text: str | None) -> tuple[int, bytes]:
    """UTF-8 length, and the bytes padded with zeros to a positive multiple of 64."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))


def summary(frames: int, mean: np.ndarray, spans: np.ndarray, tensors: np.ndarray) -> str:
    """One line: frames, segments, active milliseconds, hex digest of the rounded mean, time spans and tensors."""
    digest = hashlib.sha256(mean.astype("<f4").tobytes())
    for span, tensor in zip(spans, tensors):
        digest.update(span.astype("<f4").tobytes() + tensor.astype("<f2").tobytes())
    return f"frames={frames};segments={len(spans)};active_ms={(spans[:, 1] - spans[:, 0]).sum() if len(spans) else 0.0:.1f};sha256={digest.hexdigest()}"


def clip_summary(media: bytes) -> str:
    """The line of one clip, as the tables give it."""
    f = clip_features(media)
    spans = np.array([(s["start_ms"], s["end_ms"]) for s in f["segments"]]).reshape(-1, 2)
    return summary(f["frames"], f["mean"], spans, np.array([s["tensor"] for s in f["segments"]], np.float32).reshape(-1, POOL * MELS).astype(np.float16))


def store_media(clips: DataFrame, text: str) -> DataFrame:
    """(kept, n_bytes, media) of (kept, the text): the media table, written and to be read back."""

    def run(cols):
        n, media = zip(*((n, write_wav(payload)) for n, payload in map(text_payload, cols[text])))
        return {"kept": cols["kept"], "n_bytes": list(n), "media": list(media)}

    kind = dict(clips.dtypes)["kept"]
    return shared_table(map_rows(clips, run, f"kept {kind}, n_bytes bigint, media binary", slice_rows=128), "audio-media")


def store_tensors(media: DataFrame, with_media: bool) -> DataFrame:
    """(clips, kept, segments): blocks of clips, their digests and segments as Arrow streams; written and to be read back."""
    kind = dict(media.dtypes)["kept"]

    def block(kept: list, sizes: list, stored: list) -> dict:
        own: dict[str, list] = {n: [] for n in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "frames", "segments")}
        means, spans, tensors = [], [], []
        for n, m in zip(sizes, stored):
            _, back = read_wav(m)
            f = clip_features(m)
            row = (n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(m), hashlib.sha256(m).hexdigest(), f["frames"], len(f["segments"]))
            for values, x in zip(own.values(), row):
                values.append(x)
            means.append(f["mean"])
            spans += [(s["start_ms"], s["end_ms"]) for s in f["segments"]]
            tensors += [s["tensor"] for s in f["segments"]]
        mean = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(means).astype(np.float32)), MELS)
        clips = {n: pa.array(v) for n, v in own.items()} | {"mean": pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.float32(), [MELS]), mean)}
        if with_media:
            clips["media"] = pa.array(stored, pa.binary())
        times = np.array(spans).reshape(-1, 2)
        return {"clips": packed(clips), "kept": kept, "segments": packed({"start_ms": pa.array(times[:, 0]), "end_ms": pa.array(times[:, 1]), "tensor": tensor_array(tensors)})}

    def run(cols):
        rows = [block(*(cols[c][lo:hi] for c in ("kept", "n_bytes", "media"))) for lo, hi in blocks(cols["media"], _BLOCK_BYTES)]
        return {c: [r[c] for r in rows] for c in ("clips", "kept", "segments")}

    return shared_table(map_rows(media, run, f"clips binary, kept array<{kind}>, segments binary", slice_rows=128), "audio-tensors")


def features(clips: DataFrame, keep: list[str], text: str = "text", with_media: bool = True) -> DataFrame:
    """Texts as clips: columns ``keep``, the digests of what was stored and read back, the feature line and, if asked for,
    the media and the segments' tensors (or the next free names)."""
    digests = {"n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"}
    more = {"media": "binary", "segments": "array<struct<start_ms:double,end_ms:double,tensor:array<float>>>"} if with_media else {}
    names = {n: free_name(n, keep) for n in digests | more}
    kept = F.struct(*[F.col(f"`{c}`") for c in keep])
    slim = clips.select(kept.alias("kept"), F.col(f"`{text}`").alias("text"))
    kind = slim.schema["kept"].dataType.simpleString()
    stored = store_tensors(store_media(slim, "text"), with_media)

    def run(cols):
        out: dict[str, list] = {c: [] for c in ("kept", *digests, *more)}
        for data, own, parts in zip(cols["clips"], cols["kept"], cols["segments"]):
            clip, part = unpacked(data), unpacked(parts)
            spans = np.stack([part.column(i).to_numpy() for i in (0, 1)], axis=1)
            tensors = part.column(2).storage.flatten().to_numpy(zero_copy_only=False).reshape(-1, POOL * MELS)
            means = clip.column("mean").storage.flatten().to_numpy().reshape(-1, MELS)
            at = 0
            for i, (frames, n) in enumerate(zip(clip.column("frames").to_pylist(), clip.column("segments").to_pylist())):
                own_spans, own_tensors, at = spans[at : at + n], tensors[at : at + n], at + n
                out["feature"].append(summary(frames, means[i], own_spans, own_tensors))
                if with_media:
                    out["segments"].append([{"start_ms": a, "end_ms": b, "tensor": t.astype(np.float32)} for (a, b), t in zip(own_spans.tolist(), own_tensors)])
            out["kept"] += own
            for c in [c for c in out if c in clip.schema.names and c != "segments"]:
                out[c] += clip.column(c).to_pylist()
        return out

    read = map_rows(stored, run, ", ".join([f"kept {kind}", *[f"{n} {t}" for n, t in (digests | more).items()]]), slice_rows=4)
    return read.select(*[F.col(f"kept.`{c}`").alias(c) for c in keep], *[F.col(n).alias(m) for n, m in names.items()])
