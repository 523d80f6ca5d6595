import contextlib
import sys
import types

import numpy as np
import pytest

from wavegrid import params
from wavegrid.plans import api
from wavegrid.plans.catalog import tone
from wavegrid.scorers import AudioScorer, ConstantScorer, GaussianGeoScorer, GeoScorer, InverseSigmoidScorer
from wavegrid.sources import labels, models
from wavegrid.streaming import arrivals

GEO = GaussianGeoScorer(["x", "y", "z"], np.array([[42.5, -76.45, 4], [42.5, -76.45, 4], [-40, 100, 30]]))


def test_place_and_time(spark):
    found = api.predict_species_at_location_and_time(spark, 42.5, -76.45, scorer=GEO, week=4)
    assert list(found.items()) == [("x", 1.0), ("y", 1.0)]
    assert list(api.predict_species_at_location_and_time(spark, 42.5, -76.45, scorer=GEO, min_confidence=0)) == ["x", "y", "z"]


@pytest.mark.parametrize("place", [(90.1, 0, None), (-90.1, 0, None), (0, 180.1, None), (0, -180.1, None), (0, 0, 0), (0, 0, 49)])
def test_bad_places(spark, place):
    with pytest.raises(ValueError):
        api.predict_species_at_location_and_time(spark, place[0], place[1], scorer=GEO, week=place[2])
    rows = spark.createDataFrame([(1, float(place[0]), float(place[1]), place[2])], "req_id bigint, latitude double, longitude double, week int")
    with pytest.raises(Exception, match="out of range"):
        api.predict_locations(rows, GEO).collect()


@pytest.mark.parametrize("place", [(90, 180, None), (-90, -180, 48), (0, 0, 1)])
def test_bounds_are_included(spark, place):
    api.predict_species_at_location_and_time(spark, place[0], place[1], scorer=GEO, week=place[2])


def test_label_files(spark, tmp_path):
    path = tmp_path / "labels.txt"
    path.write_bytes("b_B\r\na_A\r\n\r\nb_B\r\nc d\r\n".encode())
    assert labels.get_species_from_file(path) == ["b_B", "a_A", "", "c", "d"]
    rows = labels.read_label_files(spark, str(path)).orderBy("label_idx").collect()
    assert [r.species for r in rows] == ["b_B", "a_A", "", "c", "d"]


def test_code_csv(spark, tmp_path):
    path = tmp_path / "names.csv"
    path.write_bytes(b'test1,species1_Species 1\r\n"t,2","sp 2"\r\n')
    assert labels.species_of_code_csv(path) == ["species1_Species 1", "sp 2"]
    assert {tuple(r) for r in labels.read_code_csv(spark, str(path)).collect()} == {("test1", "species1_Species 1"), ("t,2", "sp 2")}
    for wrong in (b"one\r\n", b"a,b\r\n\r\nc,d\r\n"):
        path.write_bytes(wrong)
        with pytest.raises(ValueError):
            labels.species_of_code_csv(path)
        with pytest.raises(Exception, match="two fields"):
            labels.read_code_csv(spark, str(path)).collect()


def test_languages():
    assert len(params.LANGUAGES) == 27
    params.check_language("de")
    with pytest.raises(ValueError):
        params.check_language("xx")


def test_layouts(tmp_path):
    with pytest.raises(ValueError):
        models.raven_layout(tmp_path, "m")
    model = tmp_path / "m"
    for file in ("labels/label_names.csv", "saved_model.pb", "variables/variables.index", "variables/variables.data-00000-of-00001"):
        (model / file).parent.mkdir(parents=True, exist_ok=True)
        (model / file).write_text("c,s_S\n")
    assert models.make("raven", folder=tmp_path, name="m").species == ["s_S"]
    with pytest.raises(ValueError):
        models.make("tflite-custom", folder=tmp_path, name="t")
    (tmp_path / "t.tflite").write_bytes(b"")
    (tmp_path / "t_Labels.txt").write_text("a_A\nb_B\n")
    assert models.make("tflite-custom", folder=tmp_path, name="t").species == ["a_A", "b_B"]
    with pytest.raises(ValueError):
        models.make("tflite", folder=tmp_path, tflite_num_threads=0)
    with pytest.raises(ValueError):
        models.make("saved-model", folder=tmp_path, language="xx")
    with pytest.raises(ValueError):
        models.make("none such")
    for code in params.LANGUAGES:
        (tmp_path / "labels").mkdir(exist_ok=True)
        (tmp_path / "labels" / f"{code}.txt").write_text(f"{code}_1\n")
    assert models.staged(tmp_path, "de").read_text() == "de_1\n"
    with pytest.raises(ValueError):
        models.staged(tmp_path, "de", {"t.tflite": 5})


def test_devices():
    assert models.choose_device(["CPU:0", "GPU:0"]) == "GPU:0"
    assert models.choose_device(["CPU:0"]) == "CPU:0"
    with pytest.raises(ValueError):
        models.choose_device(["CPU:0"], "GPU:3")


def test_inverse_sigmoid():
    inner = ConstantScorer(["a", "b", "c"], scores=[0.0, 0.5, 1.0])
    scorer = InverseSigmoidScorer(inner)
    assert isinstance(scorer, AudioScorer) and isinstance(GEO, GeoScorer)
    assert scorer.predict_species(np.zeros((1, 4))).tolist() == [[-np.inf, 0.0, np.inf]]


def test_arriving_files(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "a.wav").write_bytes(tone(6, 8000))
    scorer = ConstantScorer(["a"], scores=[2.0])

    def run():
        rows = arrivals.predictions(arrivals.arriving(spark, str(source)), scorer)
        arrivals.start(rows, str(target), str(tmp_path / "state")).awaitTermination()
        return spark.read.parquet(str(target)).count()

    assert run() == 2
    (source / "b.wav").write_bytes(tone(3, 8000))
    assert run() == 3


class FakeTensor:
    def __init__(self, x):
        self.x = np.asarray(x, np.float32)

    def numpy(self):
        return self.x


def fake_tensorflow(calls):
    """As much of TensorFlow as the loaders call."""

    class Model:
        signatures = {"basic": lambda inputs: calls.append(("basic", inputs.shape)) or {"scores": FakeTensor(np.ones((len(inputs), 2)))}}

        def __call__(self, sample):
            calls.append(("called", sample.shape))
            return FakeTensor([[0.25, 0.5]])

    return types.SimpleNamespace(
        config=types.SimpleNamespace(list_logical_devices=lambda: [types.SimpleNamespace(name="/device:CPU:0"), types.SimpleNamespace(name="/device:GPU:0")]),
        saved_model=types.SimpleNamespace(load=lambda path: calls.append(("load", path)) or Model()),
        device=lambda name: calls.append(("device", name)) or contextlib.nullcontext(),
        squeeze=lambda t: FakeTensor(t.numpy().squeeze()),
    )


def stage(folder, saved_model=False, **files):
    (folder / "labels").mkdir(parents=True)
    for code in params.LANGUAGES:
        (folder / "labels" / f"{code}.txt").write_text(f"a_{code}\nb_{code}\n")
    if saved_model:
        (folder / "variables").mkdir()
        for name in ("saved_model.pb", "variables/variables.index", "variables/variables.data-00000-of-00001"):
            (folder / name).write_bytes(b"x")
    for name, size in files.items():
        with open(folder / f"{name.replace('_', '-')}.tflite", "wb") as file:
            file.truncate(size)
    return folder


def test_saved_models(tmp_path, monkeypatch):
    """The audio model is asked by its signature, the one of places is called."""
    calls = []
    monkeypatch.setitem(sys.modules, "tensorflow", fake_tensorflow(calls))
    audio_model = models.make("saved-model", folder=stage(tmp_path / "audio", saved_model=True), language="de")
    assert audio_model.species == ["a_de", "b_de"]
    assert audio_model.predict_species(np.zeros((3, 8), np.float32)).shape == (3, 2)
    geo = models.make("geo-saved-model", folder=stage(tmp_path / "geo", saved_model=True), custom_device="/device:CPU:0")
    assert geo.predict_species(np.array([[1, 2, -1], [3, 4, 5]], np.float32)).tolist() == [[0.25, 0.5], [0.25, 0.5]]
    assert calls == [("load", str(tmp_path / "audio")), ("device", "/device:GPU:0"), ("basic", (3, 8)), ("load", str(tmp_path / "geo")), *[("device", "/device:CPU:0"), ("called", (1, 3))] * 2]
    with pytest.raises(ValueError, match="no complete saved model"):
        models.make("saved-model", folder=stage(tmp_path / "empty"))
    with pytest.raises(ValueError, match="no complete saved model"):
        models.make("geo-saved-model", folder=tmp_path / "empty")


def test_light_models(tmp_path, monkeypatch):
    made = []

    class Interpreter:
        def __init__(self, path, num_threads):
            made.append((path, num_threads))

        def allocate_tensors(self):
            pass

        def get_input_details(self):
            return [{"index": 3}]

        def get_output_details(self):
            return [{"index": 7}]

        def resize_tensor_input(self, index, shape):
            self.shape = shape

        def set_tensor(self, index, batch):
            assert index == 3
            self.batch = batch

        def invoke(self):
            self.out = self.batch.sum(axis=1, keepdims=True) + np.arange(2, dtype=np.float32)

        def get_tensor(self, index):
            assert index == 7
            return self.out

    monkeypatch.setitem(sys.modules, "tflite_runtime", types.SimpleNamespace())
    monkeypatch.setitem(sys.modules, "tflite_runtime.interpreter", types.SimpleNamespace(Interpreter=Interpreter))
    scorer = models.make("tflite", folder=stage(tmp_path / "a", audio_model=models.AUDIO_BYTES), tflite_num_threads=2)
    assert scorer.tflite_num_threads == 2
    assert scorer.predict_species(np.ones((2, 4), np.float32)).tolist() == [[4, 5], [4, 5]]
    geo = models.make("geo-tflite", folder=stage(tmp_path / "g", meta_model=models.GEO_BYTES))
    assert geo.predict_species(np.ones((2, 3), np.float32)).tolist() == [[3, 4], [3, 4]]
    assert made == [(str(tmp_path / "a" / "audio-model.tflite"), 2), (str(tmp_path / "g" / "meta-model.tflite"), 1)]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "mine.tflite").write_bytes(b"x")
    (tmp_path / "b" / "mine_Labels.txt").write_text("x_X\ny_Y\n")
    assert models.make("tflite-custom", folder=tmp_path / "b", name="mine").predict_species(np.ones((1, 2), np.float32)).tolist() == [[2, 3]]
    with pytest.raises(ValueError, match="another size"):
        models.make("tflite", folder=stage(tmp_path / "c", audio_model=9))
    with pytest.raises(ValueError, match="another size"):
        models.make("geo-tflite", folder=tmp_path / "c")


def test_raven_models(tmp_path, monkeypatch):
    monkeypatch.setitem(sys.modules, "tensorflow", fake_tensorflow([]))
    model = stage(tmp_path / "mine", saved_model=True)
    (model / "labels" / "label_names.csv").write_text("c1,One\nc2,Two\n")
    scorer = models.make("raven", folder=tmp_path, name="mine")
    assert scorer.species == ["One", "Two"]
    assert np.isposinf(scorer.predict_species(np.zeros((1, 4), np.float32))).all()
