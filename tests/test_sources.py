"""Binary workbooks, ranges, layers, tools, jobs, catalogue and streams on inputs made here."""

import io
import math
import struct
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerline.plans.catalog import QUERIES
from ledgerline.sources import api, durable, ranges, shapes, tables
from ledgerline.sources import binary_workbook as B
from ledgerline.sources.serving import served

BIG_TEXT = "длинный текст " * 900


def test_binary_workbook_round_trip(spark, tmp_path):
    sheets = {"Лист": [["имя", 1, 2.5, None], [None, "b", -7, "é" * 300], [BIG_TEXT]], "two": [[f"t{i}", i / 100] for i in range(4000)]}
    data = B.compose(sheets)
    want = [(s, r + 1, B.column_name(c), v if isinstance(v, str) else B._plain(float(v))) for s, rows in sheets.items() for r, row in enumerate(rows) for c, v in enumerate(row) if v is not None]
    assert B.cells(data) == want
    (tmp_path / "a.xls").write_bytes(data)
    assert B.workbook_cells(spark, str(tmp_path / "a.xls")).count() == len(want)
    assert [B.column_name(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    for bad in (b"", b"PK\x03\x04" + b"\0" * 600, data[:700]):
        with pytest.raises((ValueError, struct.error, IndexError)):
            B.cells(bad)


def test_binary_records_that_the_writer_does_not_make():
    record = lambda kind, body: struct.pack("<HH", kind, len(body)) + body
    rk = lambda v, flags: (v << 2 & 0xFFFFFFFC) | flags
    cell = lambda col: struct.pack("<HHH", 0, col, 0)
    body = record(B.BEGIN, struct.pack("<HH", 0x600, 0x10))
    body += record(B.RK, cell(0) + struct.pack("<I", rk(12345, 3))) + record(B.RK, cell(1) + struct.pack("<I", rk(-5, 2)))
    body += record(B.RK, cell(2) + struct.pack("<I", struct.unpack("<Q", struct.pack("<d", 1.5))[0] >> 32))
    body += record(B.MANY_RK, struct.pack("<HH", 0, 3) + struct.pack("<HI", 0, rk(1, 2)) + struct.pack("<HI", 0, rk(2, 2)) + struct.pack("<H", 4))
    body += record(B.TEXT, cell(5) + struct.pack("<HB", 3, 0) + b"abc") + record(B.TRUTH, cell(6) + b"\x01\x00") + record(B.TRUTH, cell(7) + b"\x2a\x01")
    body += record(B.FORMULA, cell(8) + struct.pack("<d", 2.25) + b"\0" * 8) + record(B.FORMULA, cell(9) + b"\0" * 6 + b"\xff\xff" + b"\0" * 8) + record(B.FORMULA_TEXT, struct.pack("<HB", 2, 1) + "ж1".encode("utf-16-le"))
    body += record(B.BLANK, cell(10)) + record(B.END_OF_PART, b"")
    # a shared string whose characters go on in the next record, in another width, after formatting runs
    shared = record(B.SHARED_STRINGS, struct.pack("<II", 1, 1) + struct.pack("<HBH", 6, 8, 1) + b"abc") + record(B.CONTINUE, b"\x01" + "где".encode("utf-16-le") + b"\0" * 4)
    body = body[: -4] + record(B.SHARED_TEXT, cell(11) + struct.pack("<I", 0)) + record(B.END_OF_PART, b"")
    name = "s".encode("utf-16-le")
    head = lambda at: record(B.BEGIN, struct.pack("<HH", 0x600, 5)) + record(B.BOUND_SHEET, struct.pack("<IBBBB", at, 0, 0, 1, 1) + name) + shared + record(B.END_OF_PART, b"")
    book = head(len(head(0))) + body
    whole = B.compose({"x": [["y"]]})
    at = whole.index(struct.pack("<HH", B.BEGIN, 16))
    data = whole[:at] + book.ljust(len(whole) - at, b"\0")
    assert [(c, t) for _, _, c, t in B.cells(data)] == [("A", "123.45"), ("B", "-5"), ("C", "1.5"), ("D", "1"), ("E", "2"), ("F", "abc"), ("G", "TRUE"), ("I", "2.25"), ("J", "ж1"), ("L", "abcгде")]


def test_small_streams_come_from_the_small_table():
    """A stream below the cutoff lies in the root's sectors of 64 bytes."""
    book = bytes(range(200))
    entry = lambda name, kind, start, size: (name + "\0").encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBBIII", 2 * len(name) + 2, kind, 1, B.FREE, B.FREE, B.FREE) + b"\0" * 36 + struct.pack("<III", start, size, 0)
    links = [B.FAT_SECTOR, B.END, B.END, B.END]  # table, directory, small table, the root's body
    small = [2, B.END, 1, 3]  # the stream is 0, 2, 1 and one more sector
    small = [2, 3, 1, B.END]
    body = b"".join(book[i * 64 : (i + 1) * 64].ljust(64, b"\0") for i in (0, 2, 1, 3))
    head = B.MAGIC + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<9I", 0, 1, 1, 0, 4096, 2, 1, B.END, 0) + struct.pack("<109I", 0, *[B.FREE] * 108)
    data = head + struct.pack("<128I", *links, *[B.FREE] * 124) + (entry("Root Entry", 5, 3, 256) + entry("Workbook", 2, 0, 200)).ljust(512, b"\0") + struct.pack("<128I", *small, *[B.FREE] * 124) + body.ljust(512, b"\0")
    assert B.stream(data) == book


def test_amounts_of_a_form(spark):
    scopes = ["Consolidated", "Local", "Fund"]
    head = [None] * 6 + scopes + [None] + scopes
    rows = [["Form"], head, ["Total", None, None, "x", None, None, 1.5, 2, 3, None, 1, 2, 3.25], ["Roads", None, None, "0400", "0000000000", "000", 1, 1, 1, None, 0.1, 0, 1], ["deeper", None, None, "0409", "0000000000", "000", 9, 9, 9, None, 9, 9, 9], ["Kind", None, None, "0400", "0000000000", "244", 8, 8, 8, None, 8, 8, 8], ["Schools", None, None, "0700", "0000000000", "000", 5, 6, 7, None, 4, 5, 6]]
    wrong = [list(r) for r in rows]
    wrong[1][10] = "Other"
    files = spark.createDataFrame([("a", bytearray(B.compose({"f": rows}))), ("b", bytearray(B.compose({"f": wrong})))], "path string, content binary")
    got = B.form_amounts(B.cells_of(files), 2, 3, ["G", "H", "I"], ["K", "L", "M"], "A", "D", {"E": "0000000000", "F": "000"}).collect()
    assert len(got) == 18 and {r.path for r in got} == {"a"}
    table = {(r.name, r.scope, r.kind): (r.function, r.amount) for r in got}
    assert table["Total", "Consolidated", "approved"] == (None, 150) and table["Total", "Fund", "executed"] == (None, 325)
    assert table["Roads", "Consolidated", "executed"] == ("0400", 10) and table["Schools", "Local", "approved"] == ("0700", 600)


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def test_ranges_fetch_only_what_is_read(spark):
    rng = np.random.default_rng(1)
    data = {f"m{i}.bin": rng.bytes(2_000_000) for i in range(5)}
    whole = zipped(data)
    with served(whole) as url:
        file = ranges.RangeFile(url)
        with zipfile.ZipFile(file) as z:
            assert z.read("m3.bin") == data["m3.bin"]
        assert file.fetched < 0.6 * len(whole) and file.requests < 12
        assert file.seek(-3, 2) == len(whole) - 3 and file.read(10) == whole[-3:] and file.read(1) == b""
        with pytest.raises(ValueError):
            file.seek(-1)
        rows = ranges.members(spark.createDataFrame([(url,)], "url string"), "m[02].bin").collect()
        assert {r.member: bytes(r.content) for r in rows} == {n: data[n] for n in ("m0.bin", "m2.bin")}
        file.tag = '"another"'
        file._held = b""
        file.seek(0)
        with pytest.raises(ValueError, match="changed"):
            file.read(10)
        file.tag, file.size = None, len(whole) + 5
        file.seek(0)
        with pytest.raises(ValueError, match="range"):
            file.read(10)


def test_layers_are_read_projected_simplified_and_drawn(spark):
    hole = [(2.0, 2.0), (2.0, 4.0), (4.0, 4.0), (4.0, 2.0), (2.0, 2.0)]
    square = [(0.0, 0.0), (5.0, 0.001), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]
    far = [(20.0, 0.0), (30.0, 0.0), (30.0, 5.0), (20.0, 0.0)]
    data = shapes.compose([({"name": "Орёл", "pop": "12"}, [square, hole]), ({"name": "b", "pop": ""}, [far])])
    files = spark.createDataFrame([("l", bytearray(data))], "path string, content binary")
    got = shapes.features_of(files, tolerance=0.1).orderBy("feature").collect()
    assert [r.attributes for r in got] == [{"name": "Орёл", "pop": "12"}, {"name": "b", "pop": ""}]
    assert got[0].rings[0] == [0, 0, 10, 0, 10, 10, 0, 10, 0, 0] and len(got[0].rings[1]) == 10
    assert (got[1].low_x, got[1].low_y, got[1].high_x, got[1].high_y) == (20, 0, 30, 5)
    drawn = shapes.drawn(shapes.features_of(files, tolerance=0.1), width=320, height=220, padding=10).orderBy("feature").collect()
    assert drawn[1].outline == "M210.0,160.0L310.0,160.0L310.0,110.0Z" and drawn[0].outline.count("M") == 2 and drawn[0].box == [10.0, 60.0, 100.0, 100.0]
    with pytest.raises(Exception, match="one layer"):
        shapes.features_of(spark.createDataFrame([("x", bytearray(zipped({"a.txt": b""})))], "path string, content binary")).collect()


def test_albers_keeps_areas_and_the_middle():
    p = shapes.albers(52, 64, 56, 100)
    assert np.allclose(p(np.array([[100.0, 56.0]])), 0, atol=1e-6)

    def area(lon, lat, d=0.01):
        a, b, c = p(np.array([[lon, lat], [lon + d, lat], [lon, lat + d]]))
        u, v = b - a, c - a
        return abs(u[0] * v[1] - u[1] * v[0]) / math.cos(math.radians(lat + d / 2))

    assert area(40, 48) == pytest.approx(area(100, 56), rel=1e-3) == pytest.approx(area(170, 70), rel=1e-3)


def test_simplified_rings_keep_what_stands_out():
    t = np.linspace(0, 2 * np.pi, 200)
    ring = np.column_stack([np.cos(t), np.sin(t)])
    few = shapes.simplified(ring, 0.02)
    assert 8 < len(few) < 40 and (few[0] == ring[0]).all() and (few[-1] == ring[-1]).all()
    assert len(shapes.simplified(ring, 0)) == 200


def test_tools(spark, root):
    assert len(api.TOOLS) == 9
    c = pd.read_parquet(f"{root}/customer.parquet")
    run = lambda tool, **a: api.call(spark, root, tool, **a).toPandas()
    by = dict(dataset="customer", value="c_custkey", group_by=["c_mktsegment"])
    groups = {k: g["c_custkey"].to_numpy(float) for k, g in c.groupby("c_mktsegment")}
    for metric, want in {
        "theil": lambda x: sum(v / x.mean() * math.log(v / x.mean()) for v in x if v) / len(x),
        "outlier_share": lambda x: np.mean(np.abs(0.67448975 * (x - np.median(x)) / np.median(np.abs(x - np.median(x)))) > 3.5),
        "median": np.median,
        "hhi": lambda x: (x**2).sum() / x.sum() ** 2,
    }.items():
        got = run("metric", metric=metric, **by).set_index("c_mktsegment")["metric"]
        assert all(got[k] == pytest.approx(want(x)) for k, x in groups.items()), metric
    seasonal = run("metric", metric="seasonal_mae", time="c_custkey", lag=2, **by).set_index("c_mktsegment")["metric"]
    trend = run("metric", metric="trend", time="c_custkey", **by).set_index("c_mktsegment")["metric"]
    for k, x in groups.items():
        x = np.sort(x)
        assert seasonal[k] == pytest.approx(np.abs(x[2:] - x[:-2]).mean()) and trend[k] == pytest.approx(np.polyfit(np.arange(len(x)), x, 1)[0])
    few = run("metric", metric="count", limit=2, **by)
    assert len(few) == 2 and set(few["matched"]) == {5} and few["truncated"].all()
    z = run("normalise", dataset="nation", value="n_nationkey", method="z_score")
    assert z["normalised"].std(ddof=0) == pytest.approx(1) and len(z) == 25
    index = run("normalise", dataset="nation", value="n_nationkey", method="mean_index", group_by=["n_regionkey"])
    assert index.groupby("n_regionkey")["normalised"].mean().round(9).eq(100).all()
    m = run("moran", dataset="embeddings", key="vec_id", value="label", vector="embedding", neighbours=5, permutations=19)
    assert abs(m["moran"][0]) < 0.2 and 0 < m["p"][0] <= 1
    k = run("cluster", dataset="embeddings", key="vec_id", vector="embedding", k=3)
    assert k["n"].sum() == 500 and len(k) == 3 and k["silhouette"].between(-1, 1).all() and (k["within"] > 0).all()
    assert len(run("describe")) == 14 and run("crosswalk").shape[0] == 1
    for wrong in (dict(tool="metric", metric="magic", **by), dict(tool="metric", metric="trend", **by), dict(tool="normalise", dataset="nation", value="n_nationkey", method="x"), dict(tool="rows", dataset="nation", columns=["n_name"], limit=0), dict(tool="forecast", horizon=9), dict(tool="channel", record={"sql": "x"}), dict(tool="metric", metric="count", budget=3, **by)):
        with pytest.raises(ValueError):
            api.call(spark, root, **wrong)


def test_channel_records(spark, root):
    good = dict(label="  Город  N ", platform="telegram", public_url="t.me/Gorod_N/?x=1", channel_kind="channel", officiality="confirmed", oktmo="12345678", latitude=55.5, longitude=37.5, geocode_precision="settlement", checked_at="2026-01-02T03:04:05Z")
    call = lambda **change: api.call(spark, root, "channel", record=good | change).first()
    r = call()
    assert (r.problem, r.label, r.public_url, r.relation) == (None, "Город N", "https://t.me/Gorod_N", "SERVES_TERRITORY:12345678000") and len(r.channel_id) == 64
    assert call(public_url="https://t.me/gorod_n").channel_id == r.channel_id
    for field, value, problem in (("label", " ", "no label"), ("platform", "x", "platform"), ("public_url", "https://evil.com/t.me", "address"), ("public_url", "https://t.me/", "address"), ("public_url", "http://t.me/a", "address"), ("channel_kind", None, "kind"), ("officiality", "maybe", "officiality"), ("oktmo", "12", "territory code"), ("latitude", 91, "coordinates"), ("geocode_precision", "exact", "precision"), ("checked_at", "yesterday", "time of check")):
        r = call(**{field: value})
        assert (r.problem, r.channel_id, r.relation) == (problem, None, None), field


def test_jobs(spark):
    rows = [(t, c, f"2020-{m:02d}" if m <= 12 else f"2021-{m - 12:02d}", float(10 * t + m)) for t in range(6) for c in "ab" for m in range(1, 25)]
    df = spark.createDataFrame(rows, "territory_id long, category string, date string, value double")
    job = api.Job(spark, "forecast", df)
    assert job.state == "queued" and job.run().states == ["queued", "running", "done"] and {r.n for r in job.result.collect()} == {6}
    assert {r.mae_last for r in job.result.collect()} == {3.0} and {r.mae_seasonal for r in job.result.collect()} == {12.0}
    ward = api.Job(spark, "clusters", df, k=2, method="ward").run()
    assert ward.state == "done" and ward.result.select("label").distinct().count() == 2
    small = api.Job(spark, "forecast", df, budget=10).run()
    assert small.state == "failed" and "10 rows" in small.reason and small.result is None
    assert api.Job(spark, "clusters", df, k=99).run().state == "failed"
    with pytest.raises(ValueError):
        api.Job(spark, "shell", df)


def test_catalogue(spark, root, tmp_path):
    rows = {r.dataset: r for r in tables.catalog(spark, root).collect()}
    import os

    assert rows["orders"].bytes == os.path.getsize(f"{root}/orders.parquet") and rows["orders"].files == 1 and rows["orders"].rows == 1500
    contents = {r.dataset: r.content for r in QUERIES["src_05_contents"](spark, root).collect()}
    nation = spark.read.parquet(f"{root}/nation.parquet")
    for name, df in (("same", nation.repartition(3)), ("less", nation.filter("n_nationkey > 0"))):
        df.write.parquet(str(tmp_path / name / "nation.parquet"))
        (other,) = tables.catalog(spark, str(tmp_path / name), ("nation",)).collect()
        assert (other.content == contents["nation"]) == (name == "same")
    known = len(tables._known)
    tables.catalog(spark, root)
    assert len(tables._known) == known


def test_a_cluster_needs_a_shared_folder(spark):
    class Session:
        class conf:
            get = staticmethod(lambda key, default: None)

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        durable.shared_path(Session)


def test_intermediate_folders_can_be_removed(spark):
    import os

    kept = durable._made.pop(spark.sparkContext.applicationId, [])  # of other tests: they may still be read
    rows = durable.written(spark.range(5))
    (folder,) = durable._made[spark.sparkContext.applicationId]
    assert rows.count() == 5 and os.path.isdir(folder)
    assert durable.clear(spark) == 1 and not os.path.exists(folder) and durable.clear(spark) == 0
    durable._made[spark.sparkContext.applicationId] = kept


def test_stream_alarms_are_a_fold(spark, root):
    got = sorted((r.event_type, r.event_id, round(r.score, 6)) for r in QUERIES["stream_alarms"](spark, root.replace("0.001", "0.01")).collect())
    events = pd.read_parquet(f"{root.replace('0.001', '0.01')}/events.parquet").sort_values(["ts", "event_id"])
    want = []
    for kind, rows in events.groupby("event_type"):
        n, mean, up, down, last = 0, 0.0, 0.0, 0.0, None
        for r in rows.itertuples():
            x = math.log1p(r.value)
            n += 1
            mean += (x - mean) / n
            up, down = max(0.0, up + x - mean - 0.05), max(0.0, down - x + mean - 0.05)
            if max(up, down) > 5:
                second = int(r.ts.timestamp())
                if last is None or second - last >= 6 * 3600:
                    want.append((kind, r.event_id, round(max(up, down), 6)))
                    last = second
                n, mean, up, down = 0, 0.0, 0.0, 0.0
    assert got == sorted(want) and len(got) > 50


def test_online_top_query_is_greedy(spark, root):
    from ledgerline.operators import panel as P

    rows = P.panel(spark, root).toPandas()
    last, want = {}, set()
    for m, month in rows.groupby("m"):
        free = [r for r in month.sort_values(["value", "tid", "cat"], ascending=[False, True, True]).itertuples() if m - last.get((r.tid, r.cat), -99) > 3][:3]
        for r in free:
            last[(r.tid, r.cat)] = m
            want.add((m, r.tid, r.cat))
    assert {(r.m, r.tid, r.cat) for r in QUERIES["srt_04_online_top_k"](spark, root).collect()} == want


def test_online_changepoint_query(spark, root):
    from ledgerline.operators import panel as P
    from tests.test_panels import run_lengths

    rows = P.totals(spark, root).toPandas()
    got = {(r.tid, r.m): r.p_recent for r in QUERIES["det_05_online_changepoint"](spark, root).collect()}
    for tid in (0, 7):
        own = rows[rows["tid"] == tid].sort_values("m")
        want = run_lengths(np.log(own["value"].to_numpy()), 1 / 50, 24, 0.5)
        assert [got[tid, m] for m in own["m"]] == pytest.approx([p for p, _ in want])


def test_every_query_without_sql_has_a_test_of_its_values():
    import pathlib

    import __spark_entry__ as entry

    said = "".join(p.read_text() for p in pathlib.Path(__file__).parent.rglob("test_*.py"))
    assert [n for n in QUERIES if n not in entry.oracle_sql() and f'"{n}"' not in said] == []
