import gzip
import hashlib
import os

from passagemill.llm import warc
from passagemill.llm.common import Scratch

SCHEMA = "page_id long, url string, html string"


def archive(spark, tmp_path, rows, name="a", parts=3):
    path = str(tmp_path / name)
    warc.write_archive(spark.createDataFrame(rows, SCHEMA).repartition(parts), path)
    return path


def leaves(spark, path, name):
    return Scratch(spark, "t").keep(warc.read_archive(spark, path, payload=False), name)


def copy(spark, path, target, change):
    records = warc.read_archive(spark, path)
    warc.write_records(change(records).select("file", "number", "record"), target)
    return target


ROWS = [(i, f"http://x/{i}", f"<p>{i} é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n</p>" + "y" * (i % 90)) for i in range(2_600)]


def test_round_trip_with_payloads_that_look_like_records(spark, tmp_path):
    rows = ROWS[:50] + [(None, None, None), (7, "a\r\nb", ""), (7, "a\r\nb", "")]
    got = warc.read_archive(spark, archive(spark, tmp_path, rows)).collect()
    body = lambda r: r.record.partition("\r\n\r\n")[2]
    assert sorted((r.page, body(r)) for r in got) == sorted((str(i) if i is not None else "", h or "") for i, _, h in rows)
    assert {r.url for r in got if r.page == ""} == {None}
    for r in got:
        raw = r.record.encode()
        assert r.length == len(raw) and bytes(r.hash) == hashlib.sha256(raw).digest()


def test_offsets_point_at_records(spark, tmp_path):
    path = archive(spark, tmp_path, ROWS[:20], parts=1)
    (folder,) = [d for d in os.listdir(path) if d.startswith("file=")]
    (file,) = [f for f in os.listdir(f"{path}/{folder}") if f.endswith(".gz")]
    content = gzip.open(f"{path}/{folder}/{file}").read()
    for r in warc.read_archive(spark, path).collect():
        assert content[r.offset : r.offset + r.length] == r.record.encode()


def test_equal_replicas_have_equal_roots(spark, tmp_path):
    path = archive(spark, tmp_path, ROWS)
    same = copy(spark, path, str(tmp_path / "b"), lambda df: df)
    assert warc.audit(leaves(spark, path, "a"), leaves(spark, same, "b")).collect() == []


def test_audit_finds_exactly_the_faults(spark, tmp_path):
    path = archive(spark, tmp_path, ROWS)

    def harm(df):
        lost = df.filter("page not in ('17', '1700')")
        added = df.filter("page = '5'").selectExpr("file", "number + 5000 as number", "replace(record, 'page:5>', 'page:x>') as record")
        return lost.selectExpr("file", "number", "if(page in ('3', '2000'), replace(record, '<p>', '<q>'), record) as record").union(added)

    found = warc.audit(leaves(spark, path, "a"), leaves(spark, copy(spark, path, str(tmp_path / "b"), harm), "b")).collect()
    assert sorted((r.page, r.status) for r in found) == [
        ("17", "missing"), ("1700", "missing"), ("2000", "corrupt"), ("3", "corrupt"), ("x", "added"),
    ]


def test_only_differing_files_are_descended(spark, tmp_path):
    path = archive(spark, tmp_path, ROWS, parts=2)
    bad = copy(spark, path, str(tmp_path / "b"), lambda df: df.selectExpr("file", "number", "if(page = '3', 'WARC/1.1 cut', record) as record"))
    a, b = leaves(spark, path, "a"), leaves(spark, bad, "b")
    scratch = Scratch(spark, "t")
    files = warc.differing_files(warc.tree(a, scratch, "x"), warc.tree(b, scratch, "y")).collect()
    assert len(files) == 1 < a.select("file").distinct().count()


def test_damaged_and_truncated_files():
    record = b"WARC/1.1\r\nContent-Length: 2\r\n\r\nab"
    whole = (record + b"\r\n\r\n") * 2
    assert [r for _, r in warc.parse(whole)] == [record] * 2
    assert [r for _, r in warc.parse(whole[:50])] == [record, whole[len(record) + 4 : 50]]
    assert list(warc.parse(b"junk")) == [(0, b"junk")] and list(warc.parse(b"")) == []
    packed = gzip.compress(whole * 500)
    assert whole.startswith(warc._unpacked(packed[: len(packed) // 2])[:10])


def test_empty_replicas(spark, tmp_path):
    none = spark.createDataFrame([], warc.LEAF)
    assert warc.audit(none, none).collect() == []
    some = leaves(spark, archive(spark, tmp_path, ROWS[:3]), "a")
    assert [r.status for r in warc.audit(some, none).collect()] == ["missing"] * 3
    assert [r.status for r in warc.audit(none, some).collect()] == ["added"] * 3
