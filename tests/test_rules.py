"""No caps, prefixes or size switches, and the inputs that used to give wrong answers."""

import json
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from echolake import session
from echolake.functions import text
from echolake.operators import annotations, catalog, columns, detect, fingerprint
from echolake.sources import wav, zerocross


def test_json_of_any_depth():
    assert text.first_json('say {"a":{"b":{"c":1}},"d":2} end }') == '{"a":{"b":{"c":1}},"d":2}'
    assert text.first_json('x [1,[2,[3,["]"]]]] y') == '[1,[2,[3,["]"]]]]'
    assert text.first_json('{ "open": [1, 2]') == "[1, 2]"
    assert text.first_json("none } here") is None and text.first_json("") is None
    assert text.first_json("[" * 50_000 + "]" * 50_000) == "[" * 50_000 + "]" * 50_000


def test_long_numbers_in_names(spark):
    df = spark.createDataFrame([("site_20240102030405",)], "n string")
    assert df.select(text.sequence_number(F.col("n"))["number"]).first()[0] == 20240102030405


def test_dots_are_not_capped(spark):
    ticks, flags = zerocross.intervals(b"\x01" * 1_200_000)
    assert len(ticks) == len(flags) == 1_200_000


def test_floor_is_exact_at_every_length(spark):
    n = 30_001
    df = spark.range(n).select(F.lit(1).alias("recording_id"), F.col("id").alias("idx"), ((F.col("id") * 7919) % n).cast("double").alias("env"))
    lengths = spark.createDataFrame([(1, n)], "recording_id int, n long")
    assert detect.noise_floor(df, lengths).first().floor == n // 10


def test_sidecars_keep_types(spark):
    bodies = ['{"id":7,"file_size":123,"also":["x","y"],"num":1.5,"in":{"a":null}}', "{}", '{"_app":null,"sha256":"s"}', '{"_app":{"sha256":"s"}}', "not json"]
    df = spark.createDataFrame(list(enumerate(bodies)), "id long, body string")
    got = {r.id: (r.outcome, r.body) for r in catalog.migrate_sidecars(df, "id").collect()}
    assert json.loads(got[0][1]) == {"id": 7, "also": ["x", "y"], "num": 1.5, "in": {"a": None}, "_app": {"file_size": 123}}
    assert got[1] == ("skipped", "{}") and got[3][0] == "skipped" and got[4] == ("error", "not json")
    assert got[2][1].count("_app") == 1 and json.loads(got[2][1]) == {"_app": {"sha256": "s"}}


def test_cycles_are_found_on_ids(spark):
    rows = [(1, 2, 0.0, 1), (2, 1, 0.0, 1), (3, None, 0.0, 1)]
    with pytest.raises(ValueError):
        annotations.tree_paths(spark.createDataFrame(rows, "id long, parent_id long, sort_order double, created_at long"))
    chain = [(i, i - 1 if i else None, 0.0, 1) for i in range(70)]
    depth = annotations.tree_paths(spark.createDataFrame(chain, "id long, parent_id long, sort_order double, created_at long")).agg(F.max("depth")).first()[0]
    assert depth == 69


def test_index_may_replace_itself(spark, tmp_path):
    path = str(tmp_path / "index")
    catalog.write_index(spark.createDataFrame([(1, "a"), (2, "b")], "id long, gen string"), path, "gen")
    catalog.write_index(spark.read.parquet(path).where("id = 2"), path, "gen")
    assert [r.id for r in spark.read.parquet(path).collect()] == [2]


def test_refused_rename_keeps_the_index(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    catalog.write_index(spark.createDataFrame([(1, "a")], "id long, gen string"), path, "gen")
    fs, at = catalog._files_of(spark, path)
    for refused in (1, 2):
        calls = []

        class Refusing:
            def __getattr__(self, name):
                return getattr(fs, name)

            def rename(self, a, b):
                calls.append(a)
                return len(calls) != refused and fs.rename(a, b)

        monkeypatch.setattr(catalog, "_files_of", lambda *_: (Refusing(), at))
        with pytest.raises(OSError):
            catalog.write_index(spark.createDataFrame([(2, "a")], "id long, gen string"), path, "gen")
        assert [r.id for r in spark.read.parquet(path).collect()] == [1]
        assert [p.name for p in tmp_path.iterdir()] == ["index"]


def test_index_versions_conflicts_and_cut_commits(spark, tmp_path):
    path = str(tmp_path / "versions")
    rows = [spark.createDataFrame([(n, "a")], "id long, gen string") for n in range(4)]
    with pytest.raises(FileNotFoundError):
        catalog.read_index(spark, path)
    assert catalog.index_version(spark, path) == 0
    assert catalog.commit_index(rows[0], path, "gen") == 1
    assert catalog.commit_index(rows[1], path, "gen", 1) == 2
    with pytest.raises(catalog.IndexConflict):
        catalog.commit_index(rows[2], path, "gen", 1)  # computed from a version that is no longer the newest
    (tmp_path / "versions" / "_commits" / "0000000003").write_text("data-of-a-killed-wri")
    assert catalog.index_version(spark, path) == 2 and catalog.read_index(spark, path).first().id == 1
    assert catalog.commit_index(rows[3], path, "gen", 2) == 4
    assert [catalog.read_index(spark, path, n).first().id for n in (1, 2, 4)] == [0, 1, 3]
    catalog.drop_versions(spark, path, 1)
    assert catalog.read_index(spark, path).first().id == 3
    with pytest.raises(FileNotFoundError):
        catalog.read_index(spark, path, 2)
    assert len([p for p in (tmp_path / "versions").iterdir() if p.name.startswith("data-")]) == 1


def test_second_writer_of_a_version_is_refused(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "race")
    rows = spark.createDataFrame([(1, "a")], "id long, gen string")
    catalog.commit_index(rows, path, "gen")
    seen = catalog._commits(spark, path)
    catalog.commit_index(rows, path, "gen")
    monkeypatch.setattr(catalog, "_commits", lambda *_: seen)  # looked before the other one committed
    with pytest.raises(catalog.IndexConflict):
        catalog.commit_index(rows, path, "gen")
    monkeypatch.undo()
    assert catalog.index_version(spark, path) == 2
    assert len([p for p in (tmp_path / "race").iterdir() if p.name.startswith("data-")]) == 2


def test_book_labels(spark):
    regions = spark.createDataFrame([("Europe", 0, "Europe"), ("NorthAmerica", 1, "N. America"), ("Global", 9, "Global")], "region string, region_order int, label string")
    countries = spark.createDataFrame([("france", "Europe", False), ("greenland", "NorthAmerica", True)], "country string, region string, approximate boolean")
    entries = spark.createDataFrame([("Europe", 0, 7, "Myotis myotis"), ("NorthAmerica", 0, 8, "Eptesicus fuscus")], "region string, ordinal int, species_id long, scientific_name string")
    rows = spark.createDataFrame([
        (1, "Myotis myotis", "France"), (2, "Myotis myotis oxygnathus", " greenland "), (3, "Eptesicus fuscus", None), (4, "Eptesicus fuscus", "Atlantis"), (5, None, "Greenland"),
        (6, "Unknown", "Atlantis"), (7, "", ""), (8, "Eptesicus fuscus", "")], "row_id long, species string, country string")
    got = {r.row_id: tuple(r)[1:] for r in catalog.resolve_books(rows, entries, regions, countries, "Europe").collect()}
    assert got == {
        1: ("Europe", 7, "Europe (France)", False), 2: ("NorthAmerica", 7, "N. America ( greenland , approx.)", False), 3: ("NorthAmerica", 8, "N. America", False),
        4: ("NorthAmerica", 8, "N. America (Atlantis)", False), 5: ("NorthAmerica", None, "N. America (Greenland, approx.)", False), 6: ("Europe", None, "Europe", True),
        7: ("Europe", None, "Europe", True), 8: ("NorthAmerica", 8, "N. America", False)}
    plain = {r.row_id: (r.region, r.from_favourite) for r in catalog.resolve_books(rows, entries, regions, countries).collect()}
    assert plain[6] == ("Global", False)


def test_fused_grids(spark):
    left = spark.createDataFrame([(1, 0.0, 0, [1.0, 4.0, 9.0, 16.0]), (1, 1.0, 1, [1.0, 1.0, 1.0, 1.0]), (2, 0.0, 0, [1.0])], "recording_id long, t double, col long, mags array<double>")
    right = spark.createDataFrame([(1, 0.4, 0, [4.0, 9.0]), (1, 5.0, 1, [0.0, 0.0]), (1, 0.6, 2, [1.0, 2.0])], "recording_id long, t double, col long, mags array<double>")
    got = {r.col: r.mags for r in columns.fuse(left, right, 0.5, 1.0).collect()}
    assert set(got) == {0, 1}
    np.testing.assert_allclose(got[0], np.sqrt([4.0, 4 * 9, 9 * 9, 16 * 9]))  # bins 0, 0.5, 1, 1.5 of the other grid, halves up, the last one kept
    added = {r.col: r.mags for r in columns.fuse(left, right, 0.5, 1.0, lambda x, y: x + y).collect()}
    assert added[1] == [2.0, 3.0, 3.0, 3.0]


def test_files_with_spaces_and_bad_files(spark, tmp_path):
    good = wav.wav_bytes(np.zeros(100), 1000)
    (tmp_path / "XC1 - Pond Myotis 100%.wav").write_bytes(good)
    (tmp_path / "cut.wav").write_bytes(good[:20])
    eight = bytearray(good)
    eight[34:36] = (12).to_bytes(2, "little")
    (tmp_path / "odd.wav").write_bytes(bytes(eight))
    rows = {r.path.rsplit("/", 1)[1]: r for r in wav.scan_headers(wav.list_files(spark, str(tmp_path))).collect()}
    named = next(r for p, r in rows.items() if p.startswith("XC1"))
    assert named.error is None and named.total_frames == 100
    assert rows["cut.wav"].error and rows["odd.wav"].error
    chunks = wav.read_chunks(wav.scan_headers(wav.list_files(spark, str(tmp_path))).where("error is null"))
    assert sum(len(r.samples) for r in chunks.collect()) == 100


def test_eight_bits_are_decoded():
    assert wav.decode(bytes([0, 128, 255]), 8, False).tolist() == [-1.0, 0.0, 127 / 128]
    with pytest.raises(ValueError):
        wav.decode(b"12345678", 64, True)


def test_gates(spark):
    verdicts = spark.createDataFrame([(i, "match") for i in range(6)], "recording_id int, verdict string")
    recordings = spark.createDataFrame(
        [(0, 48_000, 16, False, False), (1, 48_000, 24, False, False), (2, 48_000, 16, True, False), (3, 500_000, 16, False, False), (4, 48_000, 16, False, True)],
        "recording_id int, sample_rate int, bits_per_sample int, is_float boolean, zero_padded boolean")
    got = {r.recording_id: r.verdict for r in fingerprint.gated(verdicts, recordings, fingerprint.MULTIPLE_RATES).collect()}
    assert got == {0: "match", 5: "match", **dict.fromkeys((1, 2, 3, 4), "not_applicable")}


def test_shared_folder_is_needed_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext = Context

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError):
        session.shared_dir(Session)


def test_entry_without_the_corpus_package():
    code = ("import sys; sys.modules['corpus_pipeline'] = None; sys.modules['echolake.llm'] = None; import __spark_entry__ as e; "
            "assert len(e.queries()) > 180 and not e.CORPUS and set(e.oracle_sql()) <= set(e.queries())")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0


def test_storage_errors_fail_and_bad_chunks_are_rows(spark, tmp_path):
    for name in ("gone", "cut"):
        (tmp_path / f"{name}.wav").write_bytes(wav.wav_bytes(np.zeros(100), 1000))
    files = wav.list_files(spark, str(tmp_path)).localCheckpoint()
    recordings = wav.scan_headers(files).localCheckpoint()
    cut, gone = tmp_path / "cut.wav", tmp_path / "gone.wav"
    cut.write_bytes(cut.read_bytes()[:-60])
    rows = wav.read_chunks(recordings, 50).collect()
    assert sorted((r.chunk, r.channel, len(r.samples or []), r.error) for r in rows if r.error is None) == [(0, 0, 50, None)] * 2 + [(1, 0, 50, None)]
    assert [(r.chunk, r.channel, len(r.samples), r.error) for r in rows if r.error] == [(1, 0, 20, "40 of 100 bytes")]
    cut.write_bytes(cut.read_bytes()[:-50])
    rows = wav.read_chunks(recordings, 50).where("error is not null").orderBy("chunk").collect()
    assert [(r.chunk, len(r.samples or []), r.channel) for r in rows] == [(0, 45, 0), (1, 0, None)]
    gone.unlink()
    for lost in (lambda: wav.read_chunks(recordings, 50).collect(), lambda: wav.scan_headers(files).collect()):
        with pytest.raises(Exception, match="No such file|Errno 2|Failed to open"):
            lost()
