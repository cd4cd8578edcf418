import json

import pytest
from pyspark.sql import functions as F

from loomrecord.operators import page as P
from loomrecord.operators import records as R
from loomrecord.sources import scan as S


def scan(spark, tmp_path, data: bytes, split: int = 1 << 20):
    (tmp_path / "in.jsonl").write_bytes(data)
    return S.scan_records(spark, str(tmp_path / "in.jsonl"), split)


@pytest.mark.parametrize("split", [1, 3, 8, 1 << 20])
def test_mixed_delimiters_at_any_split(spark, tmp_path, split):
    rows = scan(spark, tmp_path, b'{"a":1}\r\n{"a":2}\n{"a":3}', split).orderBy("ordinal").collect()
    assert [(r.ordinal, r.byte_start, r.byte_end, r.delim_len, r.text) for r in rows] == [
        (0, 0, 7, 2, '{"a":1}'), (1, 9, 16, 1, '{"a":2}'), (2, 17, 24, 0, '{"a":3}')]


def test_parse_states_and_problems(spark, tmp_path):
    data = b'\xef\xbb\xbf{"a":1}\n\n\xff\n{"broken":7\n{"a":1} x\n{"a":1,"a":2}\n\xef\xbb\xbf{"a":1}\nlast'
    rows = scan(spark, tmp_path, data).select("*", F.expr("try_variant_get(value, '$.a', 'int')").alias("a")).drop("value").orderBy("ordinal").collect()
    assert [r.parse_state for r in rows] == ["valid", "blank", "encoding_error", "invalid_json", "invalid_json", "valid", "invalid_json", "invalid_json"]
    assert rows[5].a == 2
    assert [p.code for p in rows[0].problems] == ["BOM"]


@pytest.mark.parametrize("text,ok", [("1", True), ("1,2", False), ('{"a":1}] [2', False), ('{"a":1}} x', False), ("NaN", False), ("01", False), (' "x" ', True), ("null", True), ("", False)])
def test_strict_parse(spark, text, ok):
    row = R.parse_texts(spark.createDataFrame([(text,)], "text string")).select("parse_state").first()
    assert (row.parse_state == "valid") == ok


def test_oversized(spark):
    df = spark.createDataFrame([("s", 0, '{"a":1}'), ("s", 1, "1")], "source_id string, ordinal bigint, text string")
    assert [r.parse_state for r in R.classify(df, max_bytes=3).orderBy("ordinal").collect()] == ["oversized", "valid"]


def test_raw_page_limits(spark):
    df = spark.createDataFrame([(0, 3), (1, 3), (2, 5)], "ordinal bigint, content_len bigint")
    rows = P.raw_page(df, 0, 10, 6).collect()
    assert [(r.ordinal, r.next_ordinal, r.reason) for r in rows] == [(0, 2, "max-bytes"), (1, 2, "max-bytes")]
    assert P.raw_page(df, 0, 10, 2).count() == 0
    assert P.raw_page(df, 0, 2, 100).first().reason == "page-limit"


def test_export_is_byte_equal_and_never_overwrites(spark, tmp_path):
    data = b'{"a":1}\r\n\n\xff\nlast'
    out = tmp_path / "out"
    S.export_raw(scan(spark, tmp_path, data, 4), str(out), partitions=1)
    parts = sorted(out.glob("part-*"))
    assert b"".join(p.read_bytes() for p in parts) == data
    receipt = json.loads((out / "_receipt.json").read_text())
    assert (receipt["records"], receipt["bytes"]) == (4, len(data))
    with pytest.raises(Exception):
        S.export_raw(scan(spark, tmp_path, data), str(out))


def test_follow_waits_for_the_end_of_a_line(spark, tmp_path):
    src, f = tmp_path / "src", None
    src.mkdir()
    f = src / "a.jsonl"
    got = []
    for add, want in ((b"1\n2\n", 2), (b"3", 2), (b"3\n4\n", 4)):
        with f.open("ab") as h:
            h.write(add)
        q = (S.follow_records(spark, str(src)).writeStream.option("checkpointLocation", str(tmp_path / "cp"))
             .foreachBatch(lambda b, _: got.extend(bytes(r.raw) for r in b.collect())).trigger(availableNow=True).start())
        q.awaitTermination()
        assert len(got) == want
    assert sorted(got) == [b"1", b"2", b"33", b"4"]


def test_lines_and_counts_at_random_splits(tmp_path, monkeypatch):
    import random

    from pyarrow import fs as pafs

    from loomrecord.sources import framed

    rnd = random.Random(9)
    monkeypatch.setattr(framed, "CHUNK", 5)
    local = pafs.LocalFileSystem()
    for i in range(300):
        data = bytes(rnd.choices(b"a\r\n", weights=[rnd.choice((1, 20)), 1, 1], k=rnd.randrange(60)))
        path = tmp_path / f"f{i}"
        path.write_bytes(data)
        want, at = [], 0
        for x in data.split(b"\n"):
            end = at + len(x) < len(data)
            cr = end and x.endswith(b"\r")
            if x or end:
                want.append((at, x[:-1] if cr else x, int(end) + int(cr)))
            at += len(x) + 1
        step = rnd.randrange(1, 40)
        parts = [framed.ByteRange(str(path), "g", s, min(s + step, len(data))) for s in range(0, len(data), step)]
        got = [list(framed.lines(local, p)) for p in parts]
        assert [x for g in got for x in g] == want
        assert [framed.count_lines(local, p) for p in parts] == [len(g) for g in got]


def test_one_very_long_line(tmp_path):
    import time

    from pyarrow import fs as pafs

    from loomrecord.sources import framed

    path = tmp_path / "long"
    path.write_bytes(b"x" * (64 << 20) + b"\nend\n")
    began = time.time()
    got = [(at, len(content), delim) for at, content, delim in framed.lines(pafs.LocalFileSystem(), framed.ByteRange(str(path), "g", 0, 64 << 20))]
    assert got == [(0, 64 << 20, 1)] and time.time() - began < 20


def test_replaced_files_stop_the_stream(spark, tmp_path):
    """Same size, or larger, with other bytes; growth alone goes on."""
    for name, second in (("same", b"9\n2\n"), ("larger", b"9\n2\n3\n"), ("shorter", b"1\n"), ("grown", b"1\n2\n3\n")):
        src = tmp_path / name
        src.mkdir()
        failed = []
        for data in (b"1\n2\n", second):
            (src / "a.jsonl").write_bytes(data)
            if name == "same" and data == second:
                (src / "b.jsonl").write_bytes(b"0\n")  # something new, so that there is a batch
            q = S.follow_records(spark, str(src)).writeStream.format("noop").option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
            try:
                q.awaitTermination()
            except Exception as e:
                failed.append("start a new query" in str(e))
        assert failed == ([] if name == "grown" else [True]), name


def test_manifest_of_bytes(spark, tmp_path):
    files = {"kept": b"abc" * 10, "grown": b"x" * 25, "cut": b"y" * 25, "other": b"z" * 25, "gone": b"q", "empty": b""}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    old = spark.createDataFrame(S.manifest(spark, str(tmp_path), split_bytes=10).collect(), "source_id string, size_bytes bigint, mtime bigint, prefix_sha string")
    (tmp_path / "grown").write_bytes(b"x" * 40)
    (tmp_path / "cut").write_bytes(b"y" * 5)
    (tmp_path / "other").write_bytes(b"w" + b"z" * 24)
    (tmp_path / "gone").unlink()
    (tmp_path / "fresh").write_bytes(b"1")
    got = {r.source_id.rsplit("/", 1)[-1]: r.change for r in S.refresh(old, S.manifest(spark, str(tmp_path), old, 10)).collect()}
    assert got == {"kept": "unchanged", "grown": "append", "cut": "truncate", "other": "replace", "gone": "delete", "empty": "unchanged", "fresh": "new"}


def test_progress_of_scans(spark, tmp_path):
    from loomrecord.operators.records import classify
    from loomrecord.streaming import progress as G

    src = tmp_path / "src"
    src.mkdir()
    totals = []
    for n, data in enumerate((b'{"a":1}\n\n', b"{\nxyz\n7\n")):
        (src / f"{n}.jsonl").write_bytes(data)
        stream = G.observed_stream(classify(S.follow_records(spark, str(src)), raw="raw"))
        q = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        totals += [(r.records, r.bytes, r.valid, r.blank, r.total_problem_bytes) for r in G.progress(spark, q).collect()]
    assert totals == [(2, 7, 1, 1, 0), (3, 5, 1, 0, 4)]
    rows, seen = G.observe_scan(S.scan_records(spark, str(src)))
    rows.write.format("noop").mode("overwrite").save()
    assert seen.get == {"records": 5, "bytes": 12, "valid": 2, "blank": 1, "problem_bytes": 4}
