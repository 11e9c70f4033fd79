import json

from test_landing import A, B, DOCS_A, DOCS_B, apps, contents, put, write_app

from pyspark.sql import functions as F

from stagelens.plans import store as st
from stagelens.plans import telemetry as tel
from stagelens.sources import landing as ld
from stagelens.streaming.loads import load_landed, stream_load
from stagelens.streaming.metrics import stream_metrics


def run(query):
    query.awaitTermination()
    assert query.exception() is None


def sample(ms, value, metric="jvm_heap_used", app="a"):
    return {"app_id": app, "executor_id": "1", "metric_name": metric, "ts_ms": ms, "value": value}


def land(folder, name, samples):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(s) for s in samples))


def test_seconds_close_and_late_samples_are_dropped(spark, tmp_path):
    base, out = str(tmp_path), str(tmp_path / "out")
    start = 1704067200000
    land(tmp_path / "in", "1.json", [sample(start + 100, 1024.0), sample(start + 900, 2048.0), sample(start + 500, 9216.0)])
    run(stream_metrics(spark, f"{base}/in", out, f"{base}/ckpt"))
    # 20 s later: closes the first second; the watermark is then at +15 s
    land(tmp_path / "in", "2.json", [sample(start + 20000, 1.0)])
    run(stream_metrics(spark, f"{base}/in", out, f"{base}/ckpt"))
    # one sample too late, one inside the five seconds, and the end of the stream
    land(tmp_path / "in", "3.json", [sample(start + 200, 7.0), sample(start + 16000, 3072.0), sample(start + 90000, 1.0)])
    run(stream_metrics(spark, f"{base}/in", out, f"{base}/ckpt"))
    got = {r.second - start // 1000: (r.last_value, r.peak, r.n_samples) for r in spark.read.parquet(out).collect()}
    assert got == {0: (2.0, 9.0, 3), 16: (3.0, 3.0, 1), 20: (0.0, 0.0, 1)}


def test_stream_load_adds_each_application_once(spark, tmp_path):
    landing, out, ckpt = tmp_path / "landing", str(tmp_path / "store"), str(tmp_path / "ckpt")
    landing.mkdir()
    write_app(landing, A, DOCS_A)
    put(landing, "apps/day=1", apps(A, running=[B]))
    run(stream_load(spark, str(landing), out, ckpt))
    assert {r.app_id for r in st.loads(spark, out).collect()} == {A}
    first = contents(st.read_store(spark, out))
    # nothing landed: nothing changes
    run(stream_load(spark, str(landing), out, ckpt))
    assert contents(st.read_store(spark, out)) == first
    # the other application completes; the first is listed again
    write_app(landing, B, DOCS_B)
    put(landing, "apps/day=2", apps(A, B))
    run(stream_load(spark, str(landing), out, ckpt))
    loads = dict(map(tuple, st.loads(spark, out).collect()))
    assert loads.keys() == {A, B} and loads[A] != loads[B]
    again = tmp_path / "again"
    again.mkdir()
    write_app(again, A, DOCS_A)
    write_app(again, B, DOCS_B)
    put(again, "apps", apps(A, B))
    assert contents(st.read_store(spark, out)) == contents(tel.build_telemetry(spark, str(again)))


def test_a_load_reads_the_folders_of_its_applications_only(spark, tmp_path):
    landing, out = tmp_path / "landing", str(tmp_path / "store")
    landing.mkdir()
    for app, docs in ((A, DOCS_A), (B, DOCS_B)):
        write_app(landing, app, docs)
    put(landing, "apps", apps(A, B))
    documents = ld.read_apps(spark, str(landing))
    tables = tel.build_telemetry(spark, str(landing), app_documents=documents.filter(F.col("id") == B))
    read = {name: df.inputFiles() for name, df in tables.items() if name != "dim_applications"}
    read = {name: [f for f in files if "/apps/" not in f] for name, files in read.items()}
    assert all(f"app_id={B}" in f for files in read.values() for f in files) and any(read.values())
    whole = contents(tel.build_telemetry(spark, str(landing)))
    for name, rows in contents(tables).items():
        assert rows == [r for r in whole[name] if B in r], name
    # a document that cannot be read does no harm to loads of other applications
    assert load_landed(spark, str(landing), out, apps_a_load=1) == 2
    assert contents(st.read_store(spark, out)) == whole
    assert load_landed(spark, str(landing), out) == 0
    (landing / "stages" / f"app_id={A}" / "response.json").write_bytes(b"[{broken")
    third = "app-3"
    write_app(landing, third, DOCS_B)
    put(landing, "apps/day=3", apps(third))
    assert load_landed(spark, str(landing), out) == 1
    kept = contents(st.read_store(spark, out))
    assert all([r for r in kept[name] if third not in r] == rows for name, rows in whole.items())
    assert {r.app_id for r in st.loads(spark, out).collect()} == {A, B, third}


def landed(folder, app, docs):
    folder.mkdir()
    write_app(folder, app, docs)
    put(folder, "apps", apps(app))
    return str(folder)


def test_no_writer_loses_what_another_one_loaded(spark, tmp_path):
    only_a, only_b = landed(tmp_path / "a", A, DOCS_A), landed(tmp_path / "b", B, DOCS_B)
    want = contents(tel.build_telemetry(spark, only_a)), contents(tel.build_telemetry(spark, only_b))
    both = {n: sorted(want[0][n] + want[1][n]) for n in want[0]}
    # a batch load, then a stream whose batches count from 0
    out = str(tmp_path / "one")
    st.load_new(spark, tel.build_telemetry(spark, only_a), out)
    run(stream_load(spark, only_b, out, str(tmp_path / "ckpt1")))
    assert contents(st.read_store(spark, out)) == both
    # the other order
    out = str(tmp_path / "two")
    run(stream_load(spark, only_b, out, str(tmp_path / "ckpt2")))
    st.load_new(spark, tel.build_telemetry(spark, only_a), out)
    assert contents(st.read_store(spark, out)) == both
    # a stream with a fresh checkpoint counts from 0 again
    out = str(tmp_path / "three")
    run(stream_load(spark, only_a, out, str(tmp_path / "ckpt3")))
    run(stream_load(spark, only_b, out, str(tmp_path / "ckpt4")))
    assert contents(st.read_store(spark, out)) == both
