"""Parameter checks of the entry points, made before a plan is built."""

from __future__ import annotations

import os

# Codes of the label languages.
LANGUAGES = frozenset(["sv", "da", "hu", "th", "pt", "fr", "cs", "af", "en_uk", "uk", "it", "ja", "sl", "pl", "ko", "es", "de", "tr", "ru", "en_us", "no", "sk", "ar", "fi", "ro", "nl", "zh"])


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


def check_confidence(value: float) -> None:
    _need(0 <= value < 1, f"min_confidence is {value}, not in [0, 1)")


def check_overlap(value: float, chunk_s: float = 3.0) -> None:
    _need(0 <= value < chunk_s, f"chunk_overlap_s is {value}, not in [0, {chunk_s})")


def check_audio(*, min_confidence: float, batch_size: int, chunk_overlap_s: float, use_bandpass: bool, bandpass_fmin: int | None, bandpass_fmax: int | None, apply_sigmoid: bool, sigmoid_sensitivity: float | None) -> None:
    """Parameters of a prediction within recordings."""
    _need(batch_size >= 1, f"batch_size is {batch_size}, below 1")
    check_confidence(min_confidence)
    check_overlap(chunk_overlap_s)
    if apply_sigmoid:
        _need(sigmoid_sensitivity is not None and 0.5 <= sigmoid_sensitivity <= 1.5, f"sigmoid_sensitivity is {sigmoid_sensitivity}, not in [0.5, 1.5]")
    if use_bandpass:
        _need(bandpass_fmin is not None and bandpass_fmin >= 0, f"bandpass_fmin is {bandpass_fmin}, below 0 or missing")
        _need(bandpass_fmax is not None and bandpass_fmax > bandpass_fmin, f"bandpass_fmax is {bandpass_fmax}, not above bandpass_fmin")


def check_parallel(*, custom_n_jobs: int | None = None, maxtasksperchild: int | None = None) -> None:
    """Parameters of a run over many recordings."""
    cores = os.cpu_count() or 1
    _need(custom_n_jobs is None or 1 <= custom_n_jobs <= cores, f"custom_n_jobs is {custom_n_jobs}, not in [1, {cores}]")
    _need(maxtasksperchild is None or maxtasksperchild > 0, f"maxtasksperchild is {maxtasksperchild}, not above 0")


def check_location(*, latitude: float, longitude: float, week: int | None, min_confidence: float) -> None:
    """Parameters of a prediction at a place and time."""
    _need(-90 <= latitude <= 90, f"latitude is {latitude}, not in [-90, 90]")
    _need(-180 <= longitude <= 180, f"longitude is {longitude}, not in [-180, 180]")
    check_confidence(min_confidence)
    _need(week is None or 1 <= week <= 48, f"week is {week}, not in [1, 48]")


def check_file(path) -> None:
    _need(os.path.isfile(path), f"there is no file {path}")


def check_threads(threads: int | None) -> None:
    _need(threads is None or threads >= 1, f"the number of threads is {threads}, below 1")


def check_single_thread(scorer) -> None:
    """Models of the light runtime use one thread each where many files are
    processed at once."""
    threads = getattr(scorer, "tflite_num_threads", 1)
    _need(threads in (0, 1), f"the model's tflite_num_threads is {threads}; over many files it must be 1")


def check_language(code: str) -> None:
    _need(code in LANGUAGES, f"language {code!r} is not one of {', '.join(sorted(LANGUAGES))}")


def check_subset(wanted, labels) -> None:
    """All wanted species must be among the labels; none wanted is no filter."""
    unknown = sorted(set(wanted or ()) - set(labels))
    _need(not unknown, f"species not among the labels: {', '.join(unknown)}")
