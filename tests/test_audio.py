import io
import struct
import sys
import types
import wave

import numpy as np
import pytest

from wavegrid import params
from wavegrid.operators import post
from wavegrid.plans import api
from wavegrid.plans.catalog import tone
from wavegrid.scorers import ConstantScorer, LinearScorer, TFLiteScorer
from wavegrid.sources import audio

DUMMY = ConstantScorer(["species1", "species2", "species3", "species0"], scores=[0.1, 0.3, 0.2, 0.1])


def wav(values, rate=8000, width=2, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(channels)
        file.setsampwidth(width)
        file.setframerate(rate)
        file.writeframes(values)
    return out.getvalue()


def read(content):
    found = audio.open_audio(content)
    return found.read(content, 0, found.frames)[:, 0]


def test_sample_formats():
    assert read(wav(struct.pack("<3h", -75, -4, 32767))) == pytest.approx([-0.0022888184, -0.00012207031, 32767 / 32768])
    assert read(wav(bytes([0, 128, 255]), width=1)) == pytest.approx([-1, 0, 127 / 128])
    assert read(wav(b"\x00\x00\x80\xff\xff\x7f", width=3)) == pytest.approx([-1, (2**23 - 1) / 2**23])
    assert read(wav(struct.pack("<2i", -(2**31), 2**30), width=4)) == pytest.approx([-1, 0.5])
    floats = b"RIFF\0\0\0\0WAVEfmt " + struct.pack("<IHHIIHH", 16, 3, 1, 8000, 32000, 4, 32) + b"data" + struct.pack("<I2f", 8, 0.25, -0.5)
    assert list(read(floats)) == [0.25, -0.5]


@pytest.mark.parametrize("content", [b"", b"junk", tone(1, 8000, 2), tone(0, 8000), b"RIFF\0\0\0\0WAVE"])
def test_bad_recordings_have_an_error(spark, content):
    rows = spark.createDataFrame([("x", bytearray(content))], "path string, content binary")
    assert audio.probe(rows).first().error
    got = audio.scores(rows, DUMMY).collect()
    assert len(got) == 1 and got[0].error and got[0].logits is None


def test_chunks(spark):
    rows = spark.createDataFrame([("x", bytearray(tone(4, 24_000)))], "path string, content binary")
    got = audio.chunks(rows, overlap_s=1.0).orderBy("chunk_idx").collect()
    assert [(r.start_s, r.end_s, len(r.samples)) for r in got] == [(0, 3, 144_000), (2, 4, 96_000)]


def test_a_late_failure_discards_the_recording(spark):
    class Failing(ConstantScorer):
        def predict_species(self, batch):
            if not hasattr(self, "seen"):
                self.seen = True
                return super().predict_species(batch)
            raise RuntimeError("late")

    rows = spark.createDataFrame([("x", bytearray(tone(9, 8000)))], "path string, content binary")
    got = audio.scores(rows, Failing(["a"], scores=[1.0]), batch_size=1).collect()
    assert [(r.chunk_idx, r.error) for r in got] == [(None, "late")]


def test_wrong_width_is_an_error(spark):
    rows = spark.createDataFrame([("x", bytearray(tone(1, 8000)))], "path string, content binary")
    assert "labels" in audio.scores(rows, ConstantScorer(["a", "b"], scores=[1.0])).first().error
    with pytest.raises(ValueError):
        ConstantScorer(["a", "a"], scores=[1.0, 2.0])


def test_resampling_overrun_is_cut(spark):
    rows = spark.createDataFrame([("x", bytearray(tone(10, 11_025)))], "path string, content binary")
    got = audio.scores(rows, DUMMY, overlap_s=1.5).collect()
    assert len(got) == 6 and all(r.error is None for r in got)


def linear():
    w = np.random.default_rng(3).standard_normal((16, 3))
    return LinearScorer(["a", "b", "c"], weights=w)


def test_prediction_within_a_file(spark, tmp_path):
    path = tmp_path / "x.wav"
    path.write_bytes(tone(10, 44_100))
    want = api.as_ordered(api.predict_species_within_audio_file(spark, path, scorer=linear(), min_confidence=0))
    assert list(want) == [(0.0, 3.0), (3.0, 6.0), (6.0, 9.0), (9.0, 10.0)]
    again = api.as_ordered(api.predict_species_within_audio_file(spark, path, scorer=linear(), min_confidence=0, batch_size=1))
    for interval, found in want.items():
        assert list(found) == list(again[interval])
        assert list(found.values()) == pytest.approx(list(again[interval].values()), abs=1e-6)
    some = api.predict_species_within_audio_file(spark, path, scorer=linear(), min_confidence=0, species_filter={"b"}).first()
    assert [(p.species, p.label_idx) for p in some.predictions] == [("b", 1)]
    band = api.as_ordered(api.predict_species_within_audio_file(spark, path, scorer=linear(), min_confidence=0, bandpass_fmin=5000, bandpass_fmax=10_000))
    assert list(band) == list(want) and band != want


def test_a_bad_file_fails_the_action(spark, tmp_path):
    path = tmp_path / "x.wav"
    path.write_bytes(b"junk")
    with pytest.raises(Exception, match="soundfile|sound"):
        api.predict_species_within_audio_file(spark, path, scorer=DUMMY).collect()


def test_many_files(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.wav").write_bytes(tone(6, 48_000))
    (tmp_path / "c.wav").write_bytes(b"junk")
    paths = [tmp_path / "a.wav", tmp_path / "b.wav", tmp_path / "a.wav", tmp_path / "c.wav", tmp_path / "gone.wav"]
    rows = api.predict_species_within_audio_files(spark, paths, scorer=DUMMY, min_confidence=0, custom_n_jobs=1)
    good = rows.where("error is null")
    assert {(r.path[-5:], r.n) for r in good.groupBy("path").count().withColumnRenamed("count", "n").collect()} == {("a.wav", 4), ("b.wav", 2)}
    assert {r.path[-8:] for r in api.failures(rows).collect()} == {f"{str(tmp_path / 'c.wav')}"[-8:], "gone.wav"}
    assert post.long_form(good).count() == 24


def test_one_thread_over_many_files(spark):
    scorer = TFLiteScorer(["a"], load=None, tflite_num_threads=2)
    with pytest.raises(ValueError, match="tflite_num_threads"):
        api.predict_species_within_audio_files(spark, [], scorer=scorer)
    params.check_single_thread(TFLiteScorer(["a"]))
    params.check_single_thread(DUMMY)


def test_without_a_scorer_the_staged_classifier_is_asked_for(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("WAVEGRID_HOME", str(tmp_path))
    (tmp_path / "x.wav").write_bytes(tone(3, 48_000))
    for call in (lambda: api.predict_species_within_audio_file(spark, tmp_path / "x.wav"), lambda: api.predict_species_within_audio_files(spark, []), lambda: api.predict_species_at_location_and_time(spark, 1, 2)):
        with pytest.raises(ValueError, match="lacks the labels"):
            call()


def test_other_formats_go_through_soundfile(monkeypatch):
    """What is no WAV file is read by the soundfile package, by ranges of frames."""

    class SoundFile:
        channels, samplerate = 1, 8000

        def __init__(self, file):
            assert file.read(4) == b"fLaC"
            self.at = 0

        def __len__(self):
            return 20_000

        def seek(self, at):
            self.at = at

        def read(self, n, dtype, always_2d):
            return np.arange(self.at, self.at + n, dtype=dtype)[:, None]

    monkeypatch.setitem(sys.modules, "soundfile", types.SimpleNamespace(SoundFile=SoundFile))
    got = list(audio.read_chunks(b"fLaC and more", 1.0, 0.0, 8000))
    assert [(a, b) for a, b, _ in got] == [(0, 1), (1, 2), (2, 2.5)]
    assert got[1][2][0] == 8000 and len(got[2][2]) == 4000


BAD = [
    {"min_confidence": -0.1},
    {"min_confidence": 1},
    {"batch_size": 0},
    {"chunk_overlap_s": -1},
    {"chunk_overlap_s": 3},
    {"sigmoid_sensitivity": 0.49},
    {"sigmoid_sensitivity": 1.51},
    {"sigmoid_sensitivity": None},
    {"bandpass_fmin": -1},
    {"bandpass_fmin": None},
    {"bandpass_fmax": 0},
    {"bandpass_fmax": None},
    {"species_filter": {"none such"}},
]


@pytest.mark.parametrize("settings", BAD)
def test_bad_settings(spark, tmp_path, settings):
    path = tmp_path / "x.wav"
    path.write_bytes(tone(1, 8000))
    with pytest.raises(ValueError):
        api.predict_species_within_audio_file(spark, path, scorer=DUMMY, **settings)
    with pytest.raises(ValueError):
        api.predict_species_within_audio_files(spark, [path], scorer=DUMMY, **settings)


def test_bad_run_settings(spark, tmp_path):
    with pytest.raises(ValueError):
        api.predict_species_within_audio_file(spark, tmp_path / "none.wav", scorer=DUMMY)
    for settings in ({"custom_n_jobs": 0}, {"custom_n_jobs": 10**6}, {"maxtasksperchild": 0}):
        with pytest.raises(ValueError):
            api.predict_species_within_audio_files(spark, [], scorer=DUMMY, **settings)


def test_no_files(spark):
    assert api.predict_species_within_audio_files(spark, [], scorer=DUMMY).count() == 0
