"""Scanning, audio, snapshots and streaming ingest."""

import base64
import hashlib
import io
import json
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import library
from trackweave.engine import Library
from trackweave.operators import edges
from trackweave.sources import audio, export, scan, snapshot
from trackweave.streaming import ingest


def tone(path, seconds=3.0, pitch=440.0, rate=22_050, loud=0.5):
    t = np.arange(int(seconds * rate)) / rate
    y = loud * np.sin(2 * np.pi * pitch * t) * ((t * 2) % 1 < 0.2)
    path.parent.mkdir(parents=True, exist_ok=True)
    with wave.open(str(path), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((y * 32767).astype("<i2").tobytes())
    return path


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "music"
    tone(root / "b.WAV")
    tone(root / "genre/artist/deep.wav", pitch=523.25)
    tone(root / "out/skipped.wav", pitch=600)
    (root / "a.mp3").write_bytes((root / "b.WAV").read_bytes())
    (root / "notes.txt").write_text("no audio")
    return root


def names(df):
    return sorted(r["file_path"].rsplit("/", 1)[1] for r in df.collect())


def test_scan(spark, folder):
    assert names(scan.listing(spark, str(folder))) == ["a.mp3", "b.WAV", "deep.wav", "skipped.wav"]
    assert names(scan.unique(spark, str(folder), [str(folder / "out")])) == ["a.mp3", "deep.wav"]
    with pytest.raises(NotADirectoryError):
        scan.listing(spark, str(folder / "nothing"))
    known = spark.createDataFrame([(hashlib.sha256((folder / "b.WAV").read_bytes()).hexdigest(),), ("gone",)], "content_hash string")
    new, removed = scan.changes(spark, str(folder), known, [str(folder / "out")])
    assert names(new) == ["deep.wav"] and [r[0] for r in removed.collect()] == ["gone"]
    assert [r["ord"] for r in scan.numbered(scan.unique(spark, str(folder))).orderBy("file_path").collect()] == [0, 1, 2]


def test_features(spark, folder):
    tone(folder / "short.wav", seconds=0.5)
    tone(folder / "silent.wav", loud=0.0)
    (folder / "broken.wav").write_bytes(b"nothing")
    found = {r["filename"]: r for r in audio.extract(scan.listing(spark, str(folder), content=True)).collect()}
    assert {n for n, r in found.items() if r["status"] == "error"} == {"short.wav", "silent.wav", "broken.wav"}
    good = found["b.WAV"]
    assert good["bpm"] == pytest.approx(120, abs=3) and good["key"].startswith("A ") and len(good["embedding"]) == 768
    assert good["duration_sec"] == pytest.approx(3.0) and good["content_hash"] == found["a.mp3"]["content_hash"]


def test_json_and_snapshots(spark, tmp_path):
    vector = np.arange(4, dtype="<f4")
    doc = {
        "songs": [
            {"file_path": "/m/a.mp3", "filename": "a.mp3", "bpm": 120.0, "key": "C major", "embedding": base64.b64encode(vector.tobytes()).decode()},
            {"file_path": "/m/b.mp3", "bpm": 121.0, "key": "G major", "embedding": "[0.0, 1.0, 2.0, 3.0]", "content_hash": "h"},
        ],
        "edges": [{"source": "/m/a.mp3", "target": "/m/b.mp3", "weight": 0.25}],
        "layout": {"/m/a.mp3": [1.0, 2.0]},
    }
    (tmp_path / "lib.json").write_text(json.dumps(doc))
    root = str(tmp_path / "snapshots")
    assert snapshot.versions(spark, root) == []
    assert snapshot.migrate(spark, str(tmp_path / "lib.json"), root) is True
    assert snapshot.migrate(spark, str(tmp_path / "lib.json"), root) is False
    parts = snapshot.load(spark, root)
    songs = parts["songs"].orderBy("ord").collect()
    assert [s["embedding"] for s in songs] == [vector.tolist()] * 2
    assert songs[0]["content_hash"] == "" and songs[1]["filename"] == "b.mp3" and songs[0]["duration_sec"] == 0.0
    assert [tuple(r) for r in parts["edges"].collect()] == [(0, 1, 0.25, "direct")]
    assert [tuple(r) for r in parts["layout"].collect()] == [("/m/a.mp3", 1.0, 2.0)]
    snapshot.write_json(str(tmp_path / "out"), parts["songs"], parts["edges"], parts["layout"])
    assert spark.read.json(str(tmp_path / "out/songs")).count() == 2


def test_copying_skips_missing(spark, folder, tmp_path):
    plan = spark.createDataFrame([(0, str(folder / "b.WAV"), "set", "01 - b.WAV"), (1, "/nowhere/x.mp3", "set", "02 - x.mp3")], "pos long, file_path string, folder string, target string")
    got = {r["pos"]: r["copied"] for r in export.copy_tracks(plan, str(tmp_path)).collect()}
    assert got == {0: True, 1: False} and (tmp_path / "set/01 - b.WAV").exists()
    with pytest.raises(ValueError, match="empty"):
        export.write_manifest(plan.where(F.lit(False)), str(tmp_path))


def test_streaming_ingest(spark, folder, tmp_path):
    seen = []
    query = ingest.follow(spark, str(folder), lambda rows: seen.extend(r["filename"] for r in rows.select("filename").collect()), str(tmp_path / "check"), once=True)
    query.awaitTermination(120)
    assert sorted(seen) == ["a.mp3", "b.WAV", "deep.wav", "skipped.wav"]


def test_scratch_round_trip(spark):
    from trackweave.scratch import scratch

    store = scratch(spark)
    e = store.write(edges.build(library(spark, ("a", 120, "C major"), ("b", 121, "C major"))), "edges")
    assert e.count() == 1
    store.drop(e)


def test_migrated_library_opens_with_its_weights(spark, tmp_path):
    unit = lambda *v: base64.b64encode(np.array(v, "<f4").tobytes()).decode()
    doc = {
        "songs": [
            {"file_path": "/m/a.mp3", "bpm": 120.0, "key": "C major", "embedding": unit(1, 0), "content_hash": "h1"},
            {"file_path": "/m/b.mp3", "bpm": 60.0, "key": "G major", "embedding": unit(0, 1), "content_hash": "h2"},
        ],
        "edges": [{"source": "/m/b.mp3", "target": "/m/a.mp3", "weight": 0.77, "edge_type": "double"}],
        "layout": {"/m/a.mp3": [1.0, 2.0]},
    }
    (tmp_path / "lib.json").write_text(json.dumps(doc))
    root = str(tmp_path / "snapshots")
    snapshot.migrate(spark, str(tmp_path / "lib.json"), root)
    lib = Library.load(spark, root)
    edge = lib.edges.first()
    assert edge["weight"] == 0.77 and edge["tempo"] == 0.0 and edge["semantic"] == pytest.approx(0.5) and edge["harmonic"] == pytest.approx(1 / 6)
    again = lib.recalculate(harmonic=1.0, tempo=0.0, semantic=0.0, double_penalty=0.5)
    again.save(root)
    found = Library.load(spark, root)
    assert found.settings == again.settings and found.edges.first()["weight"] == pytest.approx(1 / 6 + 0.5)
    for _ in range(3):  # a version can be read and written at once, again and again
        found = found.save(root)
    assert found.edges.count() == Library.load(spark, root).edges.count() == 1
    snapshot.write_json(str(tmp_path / "out"), found.songs, found.edges, found.layout)
    back = snapshot.read_json(spark, str(tmp_path / "out"))
    assert sorted(r["embedding"] for r in back["songs"].collect()) == [[0.0, 1.0], [1.0, 0.0]]
    assert back["edges"].first()["weight"] == pytest.approx(1 / 6 + 0.5) and back["layout"].count() == 1


def test_saving_a_setlist_copies_tracks(spark, folder, tmp_path):
    songs = spark.createDataFrame([(0, str(folder / "b.WAV"), "b.WAV"), (1, "/nowhere/x.mp3", "x.mp3")], "ord long, file_path string, filename string")
    lib = Library.build(songs.selectExpr("*", "120.0 as bpm", "'C major' as key", "array(1f, 0f) as embedding"))
    target = lib.save_setlist([str(folder / "b.WAV"), "/nowhere/x.mp3"], "my set", str(tmp_path))
    assert sorted(p.name for p in (tmp_path / "my set").iterdir()) == ["01 - b.WAV", "manifest"] and target.endswith("my set")


def test_decoders_and_fingerprints():
    t = np.arange(3 * 22_050) / 22_050
    y = (0.5 * np.sin(2 * np.pi * 440 * t) * (1 + np.sin(2 * np.pi * 3 * t)) / 2 + 0.2 * np.sin(2 * np.pi * 1234 * t * t)).astype(np.float32)
    for width in (1, 2, 3, 4):
        buffer = io.BytesIO()
        with wave.open(buffer, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(width)
            w.setframerate(22_050)
            whole = (y * (2 ** (8 * width - 1) - 1)).astype("<i4")
            w.writeframes((whole + 128).astype(np.uint8).tobytes() if width == 1 else whole.view(np.uint8).reshape(-1, 4)[:, :width].tobytes())
        got, rate = audio.decode(buffer.getvalue())
        assert rate == 22_050 and np.abs(got - y).max() < 2.0 ** (2 - 8 * width)
    big = (y * 32767).astype(">i2").tobytes()
    common = (1).to_bytes(2, "big") + len(y).to_bytes(4, "big") + (16).to_bytes(2, "big") + (16383 + 14).to_bytes(2, "big") + (22_050 << 49).to_bytes(8, "big")
    body = b"AIFF" + b"COMM" + len(common).to_bytes(4, "big") + common + b"SSND" + (len(big) + 8).to_bytes(4, "big") + bytes(8) + big
    got, rate = audio.decode(b"FORM" + len(body).to_bytes(4, "big") + body)
    assert rate == 22_050 and np.abs(got - y).max() < 1e-3
    rng = np.random.default_rng(1)
    y = np.clip(rng.normal(size=len(y)) * 0.2, -1, 1).astype(np.float32)
    prints = np.array(audio.band_fingerprint(y, 22_050), np.int32)
    noisy = np.array(audio.band_fingerprint(y + rng.normal(size=len(y)).astype(np.float32) * 0.01, 22_050), np.int32)
    other = np.array(audio.band_fingerprint(rng.normal(size=len(y)).astype(np.float32), 22_050), np.int32)
    alike = lambda a, b: 1 - np.bitwise_count((a ^ b).view(np.uint32)).sum() / (32 * len(a))
    assert len(prints) > 15 and alike(prints, noisy) >= 0.8 > alike(prints, other) and audio.band_fingerprint(y * 0, 22_050) == []


def test_files_are_numbered_by_path(spark):
    rng = np.random.default_rng(4)
    names = [f"/m/{k:05d}.mp3" for k in rng.permutation(2000)]
    got = scan.numbered(spark.createDataFrame([(n,) for n in names], "file_path string").repartition(7), after=9).orderBy("file_path").collect()
    assert [r["ord"] for r in got] == list(range(10, 2010))


def test_scratch_tables_need_a_shared_folder_on_a_cluster():
    from trackweave.scratch import Scratch

    class Cluster:
        class conf:  # noqa: N801
            @staticmethod
            def get(*_):
                return None

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return Cluster.conf

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        Scratch(Cluster)
