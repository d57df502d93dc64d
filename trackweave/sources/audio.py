"""From audio bytes to feature rows, with replaceable decoder and analysers.

Decoders, rhythm and key analysers, fingerprinters and embedding models are plain
functions that run inside one Arrow-batched operator; waveforms never leave it.  What
comes with the engine decodes PCM WAV files and analyses them by simple signal
processing; a production analyser takes the same places.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave import constants as C
from trackweave.operators import features

FEATURES = (
    "file_path string, filename string, content_hash string, status string, error string, bpm double, key string, "
    "beat_times array<double>, rhythmic_intro boolean, fingerprint array<int>, duration_sec double, embedding array<float>"
)


def decode_wav(content: bytes) -> tuple[np.ndarray, int]:
    """Mono samples between -1 and 1, and their rate."""
    with wave.open(io.BytesIO(content)) as w:
        raw, width, channels, rate = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels(), w.getframerate()
    if width == 1:
        raw = (np.frombuffer(raw, np.uint8) ^ 128).tobytes()
    return _pcm(raw, width, "little").reshape(-1, channels).mean(axis=1), rate


def _pcm(raw: bytes, width: int, order: str) -> np.ndarray:
    """Samples of 8, 16, 24 or 32 signed bits between -1 and 1."""
    each = np.frombuffer(raw[: len(raw) // width * width], np.uint8).reshape(-1, width)
    wide = np.zeros((len(each), 4), np.uint8)  # the sample in the highest bytes of 32 bits
    wide[:, 4 - width :] = each if order == "little" else each[:, ::-1]
    return (wide.view("<i4")[:, 0] / 2.0**31).astype(np.float32)


def decode_aiff(content: bytes) -> tuple[np.ndarray, int]:
    """Mono samples and rate of uncompressed AIFF."""
    at, channels, bits, rate, raw = 12, 1, 16, 0, b""
    order = "big"
    while at + 8 <= len(content):
        name, size = content[at : at + 4], int.from_bytes(content[at + 4 : at + 8], "big")
        body = content[at + 8 : at + 8 + size]
        if name == b"COMM":
            channels, bits = int.from_bytes(body[:2], "big"), int.from_bytes(body[6:8], "big")
            power, fraction = int.from_bytes(body[8:10], "big") & 0x7FFF, int.from_bytes(body[10:18], "big")
            rate = round(fraction * 2.0 ** (power - 16383 - 63))
            if body[18:22] not in (b"", b"NONE", b"sowt"):
                raise ValueError("compressed AIFF")
            order = "little" if body[18:22] == b"sowt" else "big"
        elif name == b"SSND":
            raw = body[8 + int.from_bytes(body[:4], "big") :]
        at += 8 + size + size % 2
    return _pcm(raw, -(-bits // 8), order)[: len(raw) // -(-bits // 8) // channels * channels].reshape(-1, channels).mean(axis=1), rate


def decode(content: bytes) -> tuple[np.ndarray, int]:
    """Mono samples and rate of PCM in WAV or AIFF, whatever the file's ending."""
    return decode_aiff(content) if content[:4] == b"FORM" and content[8:12] in (b"AIFF", b"AIFC") else decode_wav(content)


def resample(y: np.ndarray, rate: int, to: int) -> np.ndarray:
    if rate == to or not len(y):
        return y
    n = int(len(y) * to / rate)
    return np.interp(np.arange(n) * rate / to, np.arange(len(y)), y).astype(np.float32)


def onset_beats(y: np.ndarray, rate: int) -> tuple[float, list[float]]:
    """Tempo and beats from the strongest period of the rise in loudness."""
    hop = rate // 100
    frames = len(y) // hop
    if frames < 200:
        return 0.0, []
    loud = np.sqrt(np.square(y[: frames * hop].reshape(frames, hop)).mean(axis=1))
    rise = np.maximum(np.diff(loud, prepend=loud[0]), 0)
    lags = np.arange(33, 101)
    power = np.array([float(rise[k:] @ rise[:-k]) for k in lags])
    if power.max() <= 0:
        return 0.0, []
    period = int(lags[power.argmax()])
    first = int(np.argmax([rise[p::period].sum() for p in range(period)]))
    return 6000.0 / period, [(first + k * period) / 100 for k in range((frames - first) // period + 1)]


def chroma_key(y: np.ndarray, rate: int) -> str:
    """The pitch that holds most energy, major or minor by the louder third."""
    n = min(len(y), rate * 30)
    spectrum = np.abs(np.fft.rfft(y[:n]))
    freq = np.fft.rfftfreq(n, 1 / rate)
    use = (freq > 55) & (freq < 1760)
    if not use.any() or spectrum[use].max() <= 0:
        return ""
    pitch = np.round(12 * np.log2(freq[use] / 440.0)).astype(int) + 9
    chroma = np.bincount(pitch % 12, spectrum[use] ** 2, 12)
    root = int(chroma.argmax())
    name = next(p for p, s in C.SEMITONES.items() if s == root)
    return f"{name} {'minor' if chroma[(root + 3) % 12] > chroma[(root + 4) % 12] else 'major'}"


def spectral_embedding(y: np.ndarray, rate: int, size: int = C.EMBEDDING_SIZE) -> np.ndarray:
    """Log energies of ``size`` bands, a stand-in for a trained model."""
    spectrum = np.abs(np.fft.rfft(y)) ** 2
    return np.log1p([b.sum() for b in np.array_split(spectrum, size)]).astype(np.float32)


def no_fingerprint(y: np.ndarray, rate: int) -> list[int]:
    return []


def band_fingerprint(y: np.ndarray, rate: int) -> list[int]:
    """One 32-bit word an eighth of a second: whether the fall in energy from each of 33 bands
    between 300 and 2,000 Hz to the next grows from frame to frame."""
    y = features.fingerprint_words(y).astype(np.float32)
    frame, hop = int(rate * 0.37), rate // 8
    if len(y) < frame + hop:
        return []
    freq = np.fft.rfftfreq(frame, 1 / rate)
    bounds = np.searchsorted(freq, np.geomspace(300, 2000, 34))
    window = np.hanning(frame)
    energy = np.array([np.add.reduceat(np.abs(np.fft.rfft(y[s : s + frame] * window)) ** 2, bounds)[:33] for s in range(0, len(y) - frame + 1, hop)])
    fall = energy[:, :-1] - energy[:, 1:]
    bits = (np.diff(fall, axis=0) > 0).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<i4")[:, 0].tolist()


@dataclass
class Analysis:
    """What analyses a file; every part can be replaced."""

    decode: Callable = decode
    beats: Callable = onset_beats
    key: Callable = chroma_key
    embed: Callable = spectral_embedding
    fingerprint: Callable = band_fingerprint
    embedding_size: int = C.EMBEDDING_SIZE
    extra: dict = field(default_factory=dict)


def analyse(content: bytes, how: Analysis) -> dict:
    """Features of one file; too short or silent audio raises ValueError."""
    y, rate = how.decode(content)
    seconds = len(y) / rate if rate else 0.0
    if seconds < C.LEAST_SECONDS:
        raise ValueError(f"audio of {seconds:.2f} seconds is too short")
    if float(np.sqrt(np.mean(np.square(y, dtype=np.float64)))) < C.LEAST_RMS:
        raise ValueError("audio is silent")
    full = resample(y, rate, C.ANALYSIS_RATE)
    bpm, beats = how.beats(full, C.ANALYSIS_RATE)
    intro = features.rhythmic_intro(full, C.ANALYSIS_RATE, beats, bpm)
    low = resample(y, rate, C.EMBED_RATE)
    chunks = features.phrase_chunks(len(low), C.EMBED_RATE, beats, intro)
    vectors = np.stack([how.embed(low[s : s + n], C.EMBED_RATE, how.embedding_size) for s, n in chunks])
    mean = np.average(vectors, axis=0, weights=[n for _, n in chunks])
    return {
        "bpm": round(float(bpm), 2), "key": how.key(full, C.ANALYSIS_RATE), "beat_times": [float(b) for b in beats], "rhythmic_intro": intro,
        "fingerprint": [int(x) for x in how.fingerprint(full, C.ANALYSIS_RATE)], "duration_sec": seconds, "embedding": mean.astype(np.float32).tolist(),
    }


def extract(files: DataFrame, how: Analysis | None = None) -> DataFrame:
    """Feature rows of ``files(file_path, content)``, with status ``ok`` or ``error``.

    Files that can't be used come out as rows with their error, never as a failed job.
    """
    how = how or Analysis()
    rows = files.select("file_path", F.element_at(F.split("file_path", "/"), -1).alias("filename"), F.sha2("content", 256).alias("content_hash"), "content")
    empty = {"bpm": 0.0, "key": "", "beat_times": [], "rhythmic_intro": True, "fingerprint": [], "duration_sec": 0.0, "embedding": []}

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                try:
                    found = {"status": "ok", "error": None} | analyse(bytes(r.content), how)
                except Exception as e:  # one bad file must not end the scan; its row says why
                    found = {"status": "error", "error": f"{type(e).__name__}: {e}"} | empty
                out.append({"file_path": r.file_path, "filename": r.filename, "content_hash": r.content_hash} | found)
            yield pd.DataFrame(out, columns=[c.strip().split(" ")[0] for c in FEATURES.split(", ")])

    return rows.mapInPandas(each, FEATURES)
