"""Scorers: what turns samples, or a place and week, into scores.

A scorer is pickled to the executors; models that are slow to load are loaded
there on first use and kept for the life of a Python worker.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol, runtime_checkable

import numpy as np

from wavegrid.schemas import BAND_HIGH, BAND_LOW, CHUNK_S, SAMPLE_RATE


@runtime_checkable
class AudioScorer(Protocol):
    """Scores chunks: float32 (n, samples) to float32 (n, species) of logits."""

    species: list[str]
    sig_fmin: int
    sig_fmax: int
    sample_rate: int
    chunk_size_s: float

    def predict_species(self, batch: np.ndarray) -> np.ndarray: ...


@runtime_checkable
class GeoScorer(Protocol):
    """Scores float32 (n, 3) rows of latitude, longitude and week (-1: none)."""

    species: list[str]

    def predict_species(self, samples: np.ndarray) -> np.ndarray: ...


@dataclass
class AudioScorerBase:
    """Constants of the stock classifiers, to inherit from."""

    species: list[str]
    sig_fmin: int = BAND_LOW
    sig_fmax: int = BAND_HIGH
    sample_rate: int = SAMPLE_RATE
    chunk_size_s: float = CHUNK_S

    def __post_init__(self):
        if len(set(self.species)) != len(self.species):
            raise ValueError("labels must differ, as scores are matched by position")

    def predict_species(self, batch: np.ndarray) -> np.ndarray:
        raise NotImplementedError


@dataclass
class ConstantScorer(AudioScorerBase):
    """The same scores for every chunk."""

    scores: list[float] = field(default_factory=list)

    def predict_species(self, batch: np.ndarray) -> np.ndarray:
        return np.tile(np.asarray(self.scores, np.float32), (len(batch), 1))


def embed(batch: np.ndarray, bands: int = 64) -> np.ndarray:
    """Log energies of equal parts of the spectrum, a row per chunk."""
    power = np.abs(np.fft.rfft(batch.astype(np.float64), axis=1)) ** 2 / max(1, batch.shape[1])
    parts = np.array_split(power, bands, axis=1)
    return np.log1p(np.stack([p.mean(axis=1) for p in parts], axis=1)).astype(np.float32)


@dataclass
class LinearScorer(AudioScorerBase):
    """A linear head over :func:`embed`: a stand-in classifier that needs no
    weights file."""

    weights: np.ndarray | None = None
    bias: np.ndarray | None = None

    def head(self, x: np.ndarray) -> np.ndarray:
        """Scores of embedded chunks."""
        return x @ np.asarray(self.weights) + (0 if self.bias is None else np.asarray(self.bias))

    def predict_species(self, batch: np.ndarray) -> np.ndarray:
        return self.head(embed(batch, np.shape(self.weights)[0])).astype(np.float32)


@dataclass
class InverseSigmoidScorer:
    """Wraps a scorer that returns probabilities, so that it returns logits."""

    inner: AudioScorer

    def __post_init__(self):
        for name in ("species", "sig_fmin", "sig_fmax", "sample_rate", "chunk_size_s"):
            setattr(self, name, getattr(self.inner, name))

    def predict_species(self, batch: np.ndarray) -> np.ndarray:
        p = np.asarray(self.inner.predict_species(batch), np.float32)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.log(p / (np.float32(1) - p))


@dataclass
class LazyScorer(AudioScorerBase):
    """Loads its model by ``load()`` on first use in each worker."""

    load: Callable[[], Callable[[np.ndarray], np.ndarray]] | None = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_model"}

    def predict_species(self, batch: np.ndarray) -> np.ndarray:
        if "_model" not in self.__dict__:
            self._model = self.load()
        return self._model(batch)


@dataclass
class TFLiteScorer(LazyScorer):
    """A model of the light runtime, with the threads that it may use."""

    tflite_num_threads: int | None = 1


@dataclass
class GaussianGeoScorer:
    """A stand-in classifier of places: each species has a centre, a spread in
    degrees and a best week."""

    species: list[str]
    centres: np.ndarray
    spread: float = 20.0

    def predict_species(self, samples: np.ndarray) -> np.ndarray:
        c = np.asarray(self.centres, np.float64)
        s = samples.astype(np.float64)
        east = (s[:, None, 1] - c[None, :, 1] + 180) % 360 - 180
        far = ((s[:, None, 0] - c[None, :, 0]) ** 2 + east**2) / self.spread**2
        turn = np.cos((s[:, None, 2] - c[None, :, 2]) * 2 * np.pi / 48)
        season = np.where(s[:, None, 2] < 0, 1.0, 0.6 + 0.4 * turn)
        return (np.exp(-far) * season).astype(np.float32)
