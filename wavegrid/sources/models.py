"""Classifier folders, the registry of classifiers, and their settings.

Weights are not part of this package and are never fetched by it: a model
folder is staged on every machine (or sent with ``spark.addFile``), and the
loaders below read it there with TensorFlow or its light runtime, where one of
them is installed.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from pathlib import Path

import numpy as np

from wavegrid import params
from wavegrid.scorers import AudioScorer, GaussianGeoScorer, InverseSigmoidScorer, LazyScorer, TFLiteScorer
from wavegrid.sources.labels import get_species_from_file, species_of_code_csv

# Sizes of the stock classifiers' files in TFLite form.
AUDIO_BYTES, GEO_BYTES = 51_726_412, 29_526_096

_registry: dict[str, Callable[..., object]] = {}


def register(name: str):
    """Names a function that makes a scorer."""

    def add(function):
        _registry[name] = function
        return function

    return add


def make(name: str, /, **settings) -> object:
    """The scorer of that name."""
    if name not in _registry:
        raise ValueError(f"no classifier {name!r}; there are {', '.join(sorted(_registry))}")
    return _registry[name](**settings)


def app_data_dir(name: str = "wavegrid") -> Path:
    """Folder for staged classifiers: ``WAVEGRID_HOME``, or the system's place
    for application data."""
    if home := os.environ.get("WAVEGRID_HOME"):
        return Path(home)
    if sys.platform == "win32":
        base = Path(os.environ.get("APPDATA", Path.home() / "AppData" / "Roaming"))
    elif sys.platform == "darwin":
        base = Path.home() / "Library" / "Application Support"
    else:
        base = Path(os.environ.get("XDG_DATA_HOME", Path.home() / ".local" / "share"))
    return base / name


def saved_model_files(folder: Path) -> bool:
    """Whether a folder holds a saved model: graph and both variable files."""
    need = ["saved_model.pb", "variables/variables.index", "variables/variables.data-00000-of-00001"]
    return all((folder / x).is_file() for x in need)


def raven_layout(folder, name: str) -> tuple[Path, Path]:
    """(model folder, label file) of a classifier exported for Raven."""
    model = Path(folder) / name
    labels = model / "labels" / "label_names.csv"
    if not labels.is_file() or not saved_model_files(model):
        raise ValueError(f"{model} is no complete Raven classifier")
    return model, labels


def tflite_layout(folder, name: str) -> tuple[Path, Path]:
    """(model file, label file) of a classifier in TFLite form."""
    model, labels = Path(folder) / f"{name}.tflite", Path(folder) / f"{name}_Labels.txt"
    if not model.is_file() or not labels.is_file():
        raise ValueError(f"{folder} holds no complete TFLite classifier {name}")
    return model, labels


def staged(folder, language: str, sizes: dict[str, int] | None = None) -> Path:
    """The label file of a staged classifier in ``language``, once all its files
    are there (and have the given sizes)."""
    params.check_language(language)
    folder = Path(folder)
    for code in sorted(params.LANGUAGES):
        if not (folder / "labels" / f"{code}.txt").is_file():
            raise ValueError(f"{folder} lacks the labels for {code}")
    for file, size in (sizes or {}).items():
        if not (folder / file).is_file() or (folder / file).stat().st_size != size:
            raise ValueError(f"{folder / file} is missing or has another size")
    return folder / "labels" / f"{language}.txt"


def choose_device(available: list[str], wanted: str | None = None) -> str:
    """A wanted device that exists, else the first GPU, else the first device."""
    if wanted is not None:
        if wanted not in available:
            raise ValueError(f"no device {wanted}; there are {', '.join(available)}")
        return wanted
    gpus = [x for x in available if "GPU" in x]
    return (gpus or available)[0]


def _saved_model(path: str, device: str | None):
    """An audio model, whose scores come from a signature."""

    def load():
        import tensorflow as tf

        name = choose_device([d.name for d in tf.config.list_logical_devices()], device)
        function = tf.saved_model.load(path).signatures["basic"]

        def run(batch: np.ndarray) -> np.ndarray:
            with tf.device(name):
                return function(inputs=batch)["scores"].numpy()

        return run

    return load


def _geo_saved_model(path: str, device: str | None):
    """A model of places, which is called as such and returns one row."""

    def load():
        import tensorflow as tf

        name = choose_device([d.name for d in tf.config.list_logical_devices()], device)
        model = tf.saved_model.load(path)

        def run(sample: np.ndarray) -> np.ndarray:
            with tf.device(name):
                return tf.squeeze(model(sample)).numpy()

        return run

    return load


def _tflite(path: str, threads: int | None):
    def load():
        try:
            from tflite_runtime.interpreter import Interpreter
        except ImportError:
            from tensorflow.lite import Interpreter

        model = Interpreter(path, num_threads=threads)
        model.allocate_tensors()
        source, sink = model.get_input_details()[0]["index"], model.get_output_details()[0]["index"]

        def run(batch: np.ndarray) -> np.ndarray:
            model.resize_tensor_input(source, batch.shape)
            model.allocate_tensors()
            model.set_tensor(source, batch)
            model.invoke()
            return model.get_tensor(sink)

        return run

    return load


@register("raven")
def raven(folder, name: str, *, custom_device: str | None = None) -> AudioScorer:
    """A Raven classifier; it returns probabilities, which become logits."""
    model, labels = raven_layout(folder, name)
    return InverseSigmoidScorer(LazyScorer(species_of_code_csv(labels), load=_saved_model(str(model), custom_device)))


@register("tflite-custom")
def tflite_custom(folder, name: str, *, tflite_num_threads: int | None = 1) -> AudioScorer:
    params.check_threads(tflite_num_threads)
    model, labels = tflite_layout(folder, name)
    return TFLiteScorer(get_species_from_file(labels), load=_tflite(str(model), tflite_num_threads), tflite_num_threads=tflite_num_threads)


@register("saved-model")
def saved_model(folder=None, *, language: str = "en_us", custom_device: str | None = None) -> AudioScorer:
    """The stock classifier in saved-model form, from its staged folder."""
    params.check_language(language)
    folder = Path(folder or app_data_dir() / "audio-saved-model")
    labels = staged(folder, language)
    if not saved_model_files(folder):
        raise ValueError(f"{folder} holds no complete saved model")
    return LazyScorer(get_species_from_file(labels), load=_saved_model(str(folder), custom_device))


@register("tflite")
def tflite(folder=None, *, language: str = "en_us", tflite_num_threads: int | None = 1) -> AudioScorer:
    """The stock classifier in TFLite form, from its staged folder."""
    params.check_threads(tflite_num_threads)
    params.check_language(language)
    folder = Path(folder or app_data_dir() / "audio-tflite")
    labels = staged(folder, language, {"audio-model.tflite": AUDIO_BYTES})
    return TFLiteScorer(get_species_from_file(labels), load=_tflite(str(folder / "audio-model.tflite"), tflite_num_threads), tflite_num_threads=tflite_num_threads)


class _OneByOne:
    """A model of places that takes one sample at a time."""

    def __init__(self, species: list[str], load):
        self.species, self.load = species, load

    def __getstate__(self):
        return {"species": self.species, "load": self.load}

    def predict_species(self, samples: np.ndarray) -> np.ndarray:
        if "model" not in self.__dict__:
            self.model = self.load()
        return np.stack([np.asarray(self.model(s[None])).reshape(-1) for s in samples]).astype(np.float32)


@register("geo-saved-model")
def geo_saved_model(folder=None, *, language: str = "en_us", custom_device: str | None = None):
    params.check_language(language)
    folder = Path(folder or app_data_dir() / "geo-saved-model")
    labels = staged(folder, language)
    if not saved_model_files(folder):
        raise ValueError(f"{folder} holds no complete saved model")
    return _OneByOne(get_species_from_file(labels), _geo_saved_model(str(folder), custom_device))


@register("geo-tflite")
def geo_tflite(folder=None, *, language: str = "en_us", tflite_num_threads: int | None = 1):
    params.check_threads(tflite_num_threads)
    params.check_language(language)
    folder = Path(folder or app_data_dir() / "geo-tflite")
    labels = staged(folder, language, {"meta-model.tflite": GEO_BYTES})
    return _OneByOne(get_species_from_file(labels), _tflite(str(folder / "meta-model.tflite"), tflite_num_threads))


@register("geo-stand-in")
def geo_stand_in(species: list[str], centres, *, spread: float = 20.0):
    return GaussianGeoScorer(species, np.asarray(centres), spread)
