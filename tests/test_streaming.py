"""Keyed state and file intake as streams: restarts, late and equal events, replayed batches, and equality with batch."""

import uuid

import pytest
from pyspark.sql import functions as F

from quotelake.operators.ingest import EXTRACTED, decoded_files
from quotelake.sources.intake import read_files, stream_files
from quotelake.sources.lifecycle import latest_state
from quotelake.streaming import jobs
from quotelake.streaming.manifest import noted, whole_batches, write_once

EVENTS = "project_id long, id long, created_at timestamp, status string, value double"


def _folder(spark, name):
    return jobs.work_folder(spark, name, f"test-{uuid.uuid4().hex}")


def _put(spark, path, rows):
    df = spark.createDataFrame([(p, i, None if t is None else 1_700_000_000 + t, s, v) for p, i, t, s, v in rows],
                               "project_id long, id long, t long, status string, value double")
    df.select("project_id", "id", F.timestamp_seconds("t").alias("created_at"), "status", "value").coalesce(1).write.mode("append").parquet(path)


def _run(spark, path, folder):
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(path)
    return jobs.stream_latest_state(stream, folder)


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def _batch(spark, path):
    events = spark.read.schema(EVENTS).parquet(path)
    return _rows(latest_state(events, ["project_id"], jobs.STATE_ORDER, ["status", "value"]).select("project_id", "id", "created_at", "status", "value"))


def test_state_over_restarts(spark, tmp_path):
    path, folder = str(tmp_path / "in"), _folder(spark, "latest")
    _put(spark, path, [(1, 1, 10, "new", 1.0), (1, 2, 20, "view", 2.0), (2, 3, 5, "new", None), (None, 4, 7, "lost", 1.0)])
    first = _rows(_run(spark, path, folder))
    assert first == _batch(spark, path) and len(first) == 3
    assert _rows(_run(spark, path, folder)) == first  # a start without new input
    assert _rows(_run(spark, path, folder)) == first
    _put(spark, path, [(1, 9, 15, "late", 9.0), (2, 8, 5, "equal time, larger id", 8.0), (3, 7, None, "no time", 7.0), (1, 2, 20, "view", 2.0)])
    second = _rows(_run(spark, path, folder))
    assert second == _batch(spark, path)
    assert {(r[0], r[3]) for r in second} == {(1, "view"), (2, "equal time, larger id"), (3, "no time"), (None, "lost")}
    # only keys with a newer record are written again
    changed = {r["project_id"] for r in spark.read.parquet(f"{folder}/changes/batch={noted(spark, folder, 'changes')[-1]}").collect()}
    assert changed <= {1, 2, 3}


def test_state_of_an_empty_source(spark, tmp_path):
    path, folder = tmp_path / "in", _folder(spark, "latest")
    path.mkdir()
    assert _run(spark, str(path), folder).collect() == []
    assert _run(spark, str(path), folder).collect() == []
    _put(spark, str(path), [(1, 1, 1, "new", 1.0)])
    assert len(_run(spark, str(path), folder).collect()) == 1


def test_compacted_state_goes_on(spark, tmp_path):
    path, folder = str(tmp_path / "in"), _folder(spark, "latest")
    schema = spark.createDataFrame([], EVENTS).schema
    jobs.compact_state(spark, folder, schema)  # nothing to fold yet
    _put(spark, path, [(k, k, k, "new", 1.0) for k in range(50)])
    before = _rows(_run(spark, path, folder))
    jobs.compact_state(spark, folder, schema)
    jobs.compact_state(spark, folder, schema)
    assert _rows(jobs.latest_written(spark, folder, schema, "project_id", jobs.STATE_ORDER)) == before
    _put(spark, path, [(k, k + 100, k + 100, "newer", 2.0) for k in range(0, 50, 2)])
    assert _rows(_run(spark, path, folder)) == _batch(spark, path)


def test_a_replayed_batch_is_written_once(spark):
    folder = _folder(spark, "sink")
    rows = spark.createDataFrame([(1,), (2,)], "x long")
    assert whole_batches(spark, folder, "s", rows.schema).collect() == []
    assert write_once(rows, 0, folder, "s") and not write_once(rows.union(rows), 0, folder, "s")
    rows.write.parquet(f"{folder}/s/batch=1")  # broke off before it was noted
    assert whole_batches(spark, folder, "s", rows.schema).count() == 2
    assert write_once(rows.limit(1), 1, folder, "s")
    assert whole_batches(spark, folder, "s", rows.schema).count() == 3


QUOTE = "견 적 서\n상호명\n대표자\n한빛전자\n견적일자 : 2024-03-05\n공급금액 1,000,000\n세액 100,000\nVAT 포함 총금액 1,100,000\n납기 : 발주 후 3주 이내\nWarranty : 18개월\n"


@pytest.fixture
def files(tmp_path):
    folder = tmp_path / "files"
    (folder / "deep").mkdir(parents=True)
    put = lambda name, data: (folder / name).write_bytes(data)
    put("견적 하나.txt", QUOTE.encode())
    put("deep/두번째+a.PDF", QUOTE.replace("1,000,000", "2,000,000").replace("세액 100,000", "세액 200,000").replace("1,100,000", "2,200,000").encode())
    put("bytes.png", b"\xff\xfe\x00broken")
    put("nothing.xlsx", b"")  # Spark's file source passes over it
    put("blank.txt", " \n\t　".encode())
    put("program.exe", b"MZ")
    put("no_extension", QUOTE.encode() + b"x")
    put("prose.txt", ("아무 금액도 없는 글\n" * 500).encode())
    return str(folder)


EXPECTED = {
    "견적 하나.txt": None, "두번째+a.PDF": None, "bytes.png": "undecodable_text", "blank.txt": "empty_text",
    "program.exe": "unsupported_extension", "no_extension": "unsupported_extension", "prose.txt": None,
}


def _known(tables):
    good, bad = tables
    assert good.columns == [c for c in EXTRACTED.names if c != "failure_reason"]
    rows = good.withColumn("failure_reason", F.lit(None).cast("string")).unionByName(bad)
    return {r["file_name"]: r.asDict() for r in rows.collect()}


def test_every_file_gives_a_quote_or_a_reason(spark, files):
    partners = spark.createDataFrame([("한빛전자 주식회사",)], "name string")
    found = _known(jobs.intake_quotes(read_files(spark, files), partners, _folder(spark, "quotes")))
    assert {n: r["failure_reason"] for n, r in found.items()} == EXPECTED
    one, two = found["견적 하나.txt"], found["두번째+a.PDF"]
    assert (one["total_supply_price"], one["tax_amount"], one["total_with_vat"], one["validation_status"]) == (1_000_000, 100_000, 1_100_000, "normal")
    assert (two["total_supply_price"], two["delivery_weeks"], two["warranty_months"]) == (2_000_000, 3, 18)
    assert one["vendor_name"] == "한빛전자 주식회사" and one["quote_id"].endswith(f"_20240305_000000_{one['file_hash'][:8]}")


def test_stream_equals_batch_and_resumes(spark, files, tmp_path):
    partners = spark.createDataFrame([("한빛전자 주식회사",)], "name string")
    batch = _known(jobs.intake_quotes(read_files(spark, files), partners, _folder(spark, "quotes")))
    folder = _folder(spark, "quotes")

    def run():
        return _known(jobs.stream_quotes(stream_files(spark, files, files_per_batch=3), partners, folder))

    assert run() == batch
    assert len(noted(spark, folder, "quotes")) >= 3
    assert run() == batch  # no new file
    with open(f"{files}/again.txt", "wb") as f:
        f.write(QUOTE.encode())  # a re-upload
    with open(f"{files}/third.txt", "wb") as f:
        f.write(QUOTE.replace("3주", "5주").encode())
    more = run()
    assert set(more) == {*batch, "third.txt"} and more["third.txt"]["delivery_weeks"] == 5


def test_no_files(spark, tmp_path):
    partners = spark.createDataFrame([], "name string")
    none = spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
    good, bad = jobs.intake_quotes(none, partners, _folder(spark, "quotes"))
    assert good.collect() == bad.collect() == []
    odd = spark.createDataFrame([("a.txt", None, None, None), ("b.txt", None, 0, b"")], none.schema)
    assert [r["reject_reason"] for r in decoded_files(odd).orderBy("path").collect()] == ["empty_text", "empty_file"]
