"""Commits of the store, and the state that spares a stream reading it."""

import pytest
from pyspark.sql import functions as F

from passagemill.plans.ingest import ingest
from passagemill.sources import manifest as manifest_module
from passagemill.sources.manifest import Manifest
from passagemill.sources.store import (
    attempt_folder,
    create_store,
    read_rejects,
    read_store,
    reset_store,
    stage_outcomes,
    vacuum,
)
from passagemill.plans.ingest import embed_chunks
from passagemill.streaming import state
from passagemill.streaming.ingest import ingest_batch, only_new
from tests.test_jobs import DIM, EMBED, RAW, chunks_of, down, raw_of


def test_manifest_names_the_last_value_through_snapshots(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(manifest_module, "SNAPSHOT_EVERY", 4)
    manifest = Manifest(spark, str(tmp_path / "m"))
    assert not manifest.exists() and manifest.names() == {}
    want = {}
    for i in range(23):
        change = {f"k{i % 5}": i, f"k{(i + 2) % 5}": None}
        manifest.commit(change)
        want = {k: v for k, v in (want | change).items() if v is not None}
        assert manifest.names() == Manifest(spark, str(tmp_path / "m")).names() == want
    manifest.commit({"only": 1}, replace_all=True)
    assert manifest.names() == {"only": 1}


def test_a_commit_cut_short_does_not_count(spark, tmp_path):
    manifest = Manifest(spark, str(tmp_path / "m"))
    manifest.commit({"a": 1})
    (tmp_path / "m" / "_manifest" / f"{2:020d}.json").write_text('{"all": fal')
    assert manifest.names() == {"a": 1}
    manifest.commit({"b": 2})
    assert manifest.names() == {"a": 1, "b": 2}


def test_a_run_stopped_before_its_commit_leaves_the_former_rows(spark, tmp_path):
    root = str(tmp_path / "store")
    create_store(spark, root)
    ingest(raw_of(spark, RAW), root, EMBED, run_id="r", dim=DIM)
    before = chunks_of(read_store(spark, root))
    other = raw_of(spark, [(9, "Another fish. " * 9, "a")])
    staged = stage_outcomes(embed_chunks(other, EMBED, dim=DIM), root, "r")  # and the job is killed here
    assert chunks_of(read_store(spark, root)) == before
    vacuum(spark, root)
    assert chunks_of(read_store(spark, root)) == before
    assert not (tmp_path / attempt_folder("store", "r", staged)).exists()
    ingest(other, root, EMBED, run_id="r", dim=DIM)
    assert {c[0] for c in chunks_of(read_store(spark, root))} == {9}
    vacuum(spark, root)
    assert len(list((tmp_path / "store" / "run=r").iterdir())) == 1


def test_no_store(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_store(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="named"):
        ingest(raw_of(spark, RAW), str(tmp_path / "s"), EMBED, run_id="a/b", dim=DIM)


def test_a_batch_reads_the_state_of_its_own_buckets_and_never_the_store(spark, tmp_path):
    root = str(tmp_path / "store")
    create_store(spark, root)
    far = 5 << state.BUCKET_BITS
    ingest_batch(raw_of(spark, RAW), root, EMBED, "a-0", dim=DIM)
    ingest_batch(raw_of(spark, [(far, "Far fish. Far!", "a")]), root, EMBED, "a-1", dim=DIM)
    names = Manifest(spark, root).names()
    assert {k for k in names if k.startswith("state/")} == {"state/0", "state/5"}
    batch = raw_of(spark, [(far, "Far fish. Far!", "a"), (far + 1, "New one.", "a")])
    known = state.read_state(spark, root, state.touched(batch))
    fresh = only_new(batch, known)
    assert [r.raw_data_id for r in fresh.collect()] == [far + 1]
    read = known.inputFiles()
    assert read and all("/_state/" in f and "bucket=5" in f for f in read)
    ingest_batch(batch, root, EMBED, "a-2", dim=DIM)
    # The other bucket's folder is the one that the first batch wrote.
    after = Manifest(spark, root).names()
    assert after["state/0"] == names["state/0"] and after["state/5"] != names["state/5"]
    assert {c[0] for c in chunks_of(read_store(spark, root))} == {1, 5, far, far + 1}


def test_runs_of_batch_jobs_enter_the_state_once(spark, tmp_path):
    root = str(tmp_path / "store")
    create_store(spark, root)
    ingest(raw_of(spark, RAW), root, EMBED, dim=DIM)
    before = chunks_of(read_store(spark, root))
    assert state.outside(spark, root)[0]
    ingest_batch(raw_of(spark, RAW), root, EMBED, "s-0", dim=DIM)
    assert chunks_of(read_store(spark, root)) == before and not state.outside(spark, root)[0]
    changed = [(5, "Green fish now", "b")]
    ingest_batch(raw_of(spark, changed), root, EMBED, "s-1", dim=DIM)
    texts = {c[0]: c[2] for c in chunks_of(read_store(spark, root))}
    assert texts[5] == "Green fish now" and set(texts) == {1, 5}


def test_rejects_are_tried_again_and_known_documents_without_chunks_are_not(spark, tmp_path):
    root, calls = str(tmp_path / "store"), spark.sparkContext.accumulator(0)
    create_store(spark, root)
    ingest_batch(raw_of(spark, RAW), root, down, "s-0", dim=DIM)
    assert read_rejects(spark, root).count() > 0
    held = {r.raw_data_id: r.failed for r in state.read_state(spark, root).collect()}
    assert held == {1: True, 2: False, 3: False, 4: False, 5: True}

    def counted(texts):
        calls.add(len(texts))
        return EMBED(texts)

    for run in ("s-1", "s-2"):
        ingest_batch(raw_of(spark, RAW), root, counted, run, dim=DIM)
    assert calls.value == read_store(spark, root).count() > 0 and read_rejects(spark, root).count() == 0
    # A batch whose commit the stream lost runs again under its name.
    before = chunks_of(read_store(spark, root))
    ingest_batch(raw_of(spark, RAW), root, EMBED, "s-1", dim=DIM)
    assert chunks_of(read_store(spark, root)) == before


def test_reset_forgets_the_state(spark, tmp_path):
    root = str(tmp_path / "store")
    create_store(spark, root)
    ingest_batch(raw_of(spark, RAW), root, EMBED, "s-0", dim=DIM)
    reset_store(spark, root)
    assert read_store(spark, root).count() == 0 and state.read_state(spark, root).count() == 0
    ingest_batch(raw_of(spark, RAW), root, EMBED, "s-0", dim=DIM)
    assert read_store(spark, root).count() == 4


def test_empty_batches_and_documents_without_id(spark, tmp_path):
    root = str(tmp_path / "store")
    create_store(spark, root)
    ingest_batch(raw_of(spark, RAW).limit(0), root, EMBED, "s-0", dim=DIM)
    assert read_store(spark, root).count() == 0
    ingest_batch(raw_of(spark, [(None, "No id. None.", "a"), (-3, "Negative id.", "a")]), root, EMBED, "s-1", dim=DIM)
    assert sorted(str(c.raw_data_id) for c in read_store(spark, root).collect()) == ["-3", "None"]
    assert [r.raw_data_id for r in state.read_state(spark, root).collect()] == [-3]
    assert read_store(spark, root).filter(F.col("raw_data_id") == -3).count() == 1
