import datetime as dt

from pyspark.sql import functions as F

from gneiss.functions.text import hash_embedding
from gneiss.sources import readers
from gneiss.sources.store import Store, incremental, manifest
from gneiss.streaming import ingest as S


def test_store_generations(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    assert s.read("docs") is None and s.delete("docs", spark.range(1), "id") is None
    s.write("docs", spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string"))
    first = s.generation("docs")
    s.upsert("docs", spark.createDataFrame([(2, "B"), (3, "c")], "id int, t string"), "id")
    assert {(r["id"], r["t"]) for r in s.read("docs").collect()} == {(1, "a"), (2, "B"), (3, "c")}
    s.delete("docs", spark.createDataFrame([(1,)], "id int"), "id")
    assert s.read("docs").count() == 2
    s.swap("docs", first)  # back to an earlier state
    assert {r["t"] for r in s.read("docs").collect()} == {"a", "b"}


def test_incremental_encodes_new_texts_only(spark):
    a = spark.createDataFrame([("x",), ("y",), ("x",), (None,)], "t string")
    known = incremental(a, None, "t", hash_embedding)
    both = incremental(spark.createDataFrame([("x",), ("z",)], "t string"), known, "t", hash_embedding)
    assert known.count() == 2 and both.count() == 2


def test_manifest_ignores_order_and_repeats(spark):
    a = spark.createDataFrame([("d", "1", "x"), ("d", "2", "y")], "doc string, id string, t string")
    b = spark.createDataFrame([("d", "2", "y"), ("d", "1", "x"), ("d", "1", "x")], "doc string, id string, t string")
    c = spark.createDataFrame([("d", "2", "y"), ("d", "1", None)], "doc string, id string, t string")
    one = lambda d: {r["doc"]: r["fingerprint"] for r in manifest(d, "doc", ["id", "t"]).collect()}
    assert one(a) == one(b) and one(a)[None] != one(c)[None]


def test_pdf_checks(spark, tmp_path):
    (tmp_path / "ok.pdf").write_bytes(b"%PDF-1.7 body\n%%EOF\n")
    (tmp_path / "bad.pdf").write_bytes(b"hello")
    (tmp_path / "empty.pdf").write_bytes(b"")
    (tmp_path / "x.txt").write_bytes(b"%PDF-")
    (tmp_path / "enc.pdf").write_bytes(b"%PDF-1.7 /Encrypt\n%%EOF")
    got = {r["path"].rsplit("/", 1)[1]: r["error"] for r in readers.pdf_files(spark, str(tmp_path)).collect()}
    assert got == {"ok.pdf": None, "bad.pdf": "bad_magic_number", "x.txt": "not_a_pdf_name", "enc.pdf": "encrypted"}


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1}\nbroken\n')
    rows = readers.json_lines(spark, str(tmp_path / "a.jsonl"), "k int").collect()
    assert sorted((r["k"] or 0, r["_corrupt"]) for r in rows) == [(0, "broken"), (1, None)]
    html = "<script>x()</script><p>One &amp; two</p><!-- c --><p>three</p>"
    assert spark.createDataFrame([(html,)], "h string").select(readers.visible_text(F.col("h"))).first()[0] == "One & two\nthree"


def test_stream_windows_equal_batch(spark, tmp_path):
    t0 = dt.datetime(2030, 1, 1)
    e = spark.createDataFrame([(i, t0 + dt.timedelta(minutes=7 * i), "a", float(i)) for i in range(40)], "event_id int, ts timestamp, event_type string, value double")
    e.write.parquet(str(tmp_path / "events.parquet"))
    stream = S.run_once(S.windowed(S.table_stream(spark, str(tmp_path), "events"), "ts", ["event_type"], "1 hour", "0 seconds"))
    batch = S.windowed(e, "ts", ["event_type"])
    got = {(r["start"], r["n"], r["total"]) for r in stream.collect()}
    # the last window is still open when the stream ends
    want = sorted((r["start"], r["n"], r["total"]) for r in batch.collect())
    assert got <= set(want) and set(want[:-1]) <= got | {want[-2]}


def test_ingest_resumes(spark, tmp_path):
    seen = []
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    sink = lambda df, n: seen.append((n, df.count()))
    for _ in range(2):
        S.ingest(S.table_stream(spark, str(tmp_path), "t"), sink, str(tmp_path / "state"))
    assert sum(n for _, n in seen) == 3
    spark.range(2).write.mode("append").parquet(str(tmp_path / "t.parquet"))
    S.ingest(S.table_stream(spark, str(tmp_path), "t"), sink, str(tmp_path / "state"))
    assert sum(n for _, n in seen) == 5


def test_job_states(spark, tmp_path):
    rows = [("j1", "reserved", 1), ("j1", "failed", 3), ("j1", "completed", 5), ("j1", "failed", 4), ("j2", "failed", 2), ("j2", None, 1)]
    spark.createDataFrame(rows, "job string, status string, at long").coalesce(1).write.parquet(str(tmp_path / "jobs.parquet"))
    got = {}

    def sink(df, n):
        got.update({r["job"]: r["status"] for r in df.collect()})

    q = S.job_states(S.table_stream(spark, str(tmp_path), "jobs")).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert got == {"j1": "completed", "j2": "failed"}


def test_broken_font_map(spark):
    bad, good = "Ａ" * 100 + "", "ordinary text"
    d = spark.createDataFrame([(bad,), (good,)], "t string").select("t", readers.broken_font_map(F.col("t")).alias("b"))
    assert {r["t"][:3]: r["b"] for r in d.collect()} == {"ＡＡＡ": True, "ord": False}


def test_quota_admissions_against_brute_force(spark, tmp_path):
    import random

    from gneiss.streaming.quota import MINUTE, Quota, admissions

    r = random.Random(9)
    rows = [(s, f"c{i}", i * 7_000_000 + r.randrange(5_000_000), r.choice([10, 40, 90, None, 500])) for s in ("a", "b") for i in range(120)]
    late, at0 = rows[:40] + rows[120:160], str(tmp_path / "calls")
    spark.createDataFrame(rows + [("a", "null", None, 1)], "scope string, call string, at long, tokens long").coalesce(1).write.parquet(at0)
    stream = spark.readStream.schema("scope string, call string, at long, tokens long").parquet(at0)
    got = S.run_once(admissions(stream, rpm=5, tpm=200, rpd=70, tpd=3000, spacing=3_000_000)).collect()
    reasons = {(x["scope"], x["call"]): x["reason"] for x in got}
    assert len(got) == 241 and reasons["a", "null"] == "invalid" and len(late) == 80
    for s in ("a", "b"):
        taken = []
        for _, call, at, tokens in sorted((x for x in rows if x[0] == s), key=lambda x: x[2]):
            n = tokens or 0
            minute = [t for t in taken if t[0] > at - MINUTE]
            ok = n <= 200 and len(taken) < 70 and sum(t[1] for t in taken) + n <= 3000 and len(minute) < 5 and sum(t[1] for t in minute) + n <= 200 and (not taken or at - taken[-1][0] >= 3_000_000)
            assert (reasons[s, call] is None) == ok, (call, reasons[s, call])
            if ok:
                taken.append((at, n))
    q, again = Quota(2, 100, 9, 900, 0, "UTC"), Quota(2, 100, 9, 900, 0, "UTC")
    assert q.decide(0, 5) is None
    again.load(q.dump())
    assert again.decide(1, 5) is None and again.decide(2, 5) == "requests_a_minute" and again.decide(MINUTE + 2, 5) is None


def test_pointers_of_many_writers(spark, tmp_path):
    a, b = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    g = [s.write("t", spark.range(n)) for s, n in ((a, 1), (b, 2), (a, 3))]
    assert a.generation("t") == b.generation("t") == g[-1] and a.read("t").count() == 3 and len(a._pointers("t")) == 3
