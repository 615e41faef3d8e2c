"""Sources and sinks: formats written to the shared folder and read again; streams run to their end."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ledgerline.plans.registry import PANEL, query
from ledgerline.sources import files, tables
from ledgerline.sources.durable import new_folder


def place(spark) -> str:
    return new_folder(spark)


@query("src_07_csv_codes", "SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS code, c_name AS name, c_mktsegment AS kind FROM customer")
def _(spark, root):
    path = place(spark)
    rows = tables.scan(spark, root, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("code"), "c_name", "c_mktsegment")
    rows.write.option("sep", ";").option("encoding", "iso-8859-1").csv(path)
    return files.csv(spark, path, ["code", "name", "kind"])


@query("src_07_csv_cyrillic", "SELECT lpad(CAST(n_nationkey AS VARCHAR), 4, '0') AS code, 'Край ' || n_name AS name FROM nation")
def _(spark, root):
    path = place(spark)
    upper = bytes(range(128, 256))
    rows = tables.scan(spark, root, "nation").select(F.lpad(F.col("n_nationkey").cast("string"), 4, "0").alias("code"), F.concat(F.lit("Край "), "n_name").alias("name"))
    # byte for byte a file in the Cyrillic code page
    rows.select("code", F.translate("name", upper.decode("cp1251", "replace"), upper.decode("latin-1")).alias("name")).write.option("sep", ";").option("encoding", "iso-8859-1").csv(path)
    return files.csv(spark, path, ["code", "name"], encoding="windows-1251")


@query("src_07_csv_marked", "SELECT CAST(n_nationkey AS VARCHAR) AS code, 'Край ' || n_name AS name FROM nation")
def _(spark, root):
    path = place(spark)
    rows = tables.scan(spark, root, "nation").select(F.concat_ws(";", F.col("n_nationkey").cast("string"), F.concat(F.lit("Край "), "n_name")).alias("line"))
    # each file begins with a byte order mark and a header
    first = F.concat(F.lit("\ufeff" + "код;имя\n"), F.array_join(F.array_sort(F.collect_list("line")), "\n"))
    rows.groupBy(F.pmod(F.xxhash64("line"), F.lit(3))).agg(first.alias("value")).select("value").repartition(3).write.text(path)  # nations
    return files.csv(spark, path, ["code", "name"], encoding="utf-8").filter("code <> 'код'")


@query("src_08_nested_json", "SELECT 'trade' AS dataset, CAST(n_nationkey AS INTEGER) AS series_id, n_name AS series_name, r_name AS unit, CAST(r_regionkey AS VARCHAR) AS period_label, n_nationkey / 2 AS value FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(spark, root):
    path = place(spark)
    n, r = tables.scan(spark, root, "nation"), tables.scan(spark, root, "region")
    j = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))  # regions
    entry = lambda i, name: F.struct(F.col(i).cast("int").alias("id"), F.col(name).alias("name"))
    raw = F.struct(F.col("n_nationkey").cast("int").alias("series"), F.col("r_regionkey").cast("int").alias("unit"), F.col("r_regionkey").cast("string").alias("period"), (F.col("n_nationkey") / 2).alias("value"))
    doc = j.groupBy(F.col("r_regionkey").alias("_part")).agg(F.lit("trade").alias("dataset"), F.collect_set(entry("n_nationkey", "n_name")).alias("headers"), F.collect_set(entry("r_regionkey", "r_name")).alias("units"), F.collect_list(raw).alias("RawData"))
    doc.drop("_part").repartition(5).write.json(path)
    return files.series_json(spark, path)


@query(
    "src_09_day_characters",
    "SELECT k.event_type AS key, CAST(k.d AS DATE) AS day, CASE WHEN n IS NULL THEN '0' WHEN n > 60 THEN 'H' ELSE 'L' END AS status, true AS valid FROM (SELECT event_type, d FROM (SELECT DISTINCT event_type FROM events) CROSS JOIN (SELECT unnest(range(DATE '2024-01-01', DATE '2025-01-01', INTERVAL 1 DAY)) AS d)) k LEFT JOIN (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2) e ON e.event_type = k.event_type AND e.day = CAST(k.d AS DATE)",
)
def _(spark, root):
    path = place(spark)
    per = tables.scan(spark, root, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    days = F.explode(F.sequence(F.make_date(F.lit(2024), F.lit(1), F.lit(1)), F.make_date(F.lit(2024), F.lit(12), F.lit(31))))
    grid = per.select("event_type").distinct().withColumn("day", days).join(per, ["event_type", "day"], "left")
    mark = F.when(F.col("n").isNull(), "0").when(F.col("n") > 60, "H").otherwise("L")
    line = grid.groupBy("event_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("day", mark.alias("c")))), lambda x: x["c"]), "").alias("s"))  # days of a year
    line.select(F.concat_ws(" ", "event_type", F.lit("2024"), "s").alias("value")).write.text(path)
    return files.day_statuses(spark, path)


@query("src_19_parquet_sink", "SELECT p_partkey, p_brand, p_size FROM part")
def _(spark, root):
    path = place(spark)
    tables.write_new(tables.scan(spark, root, "part").select("p_partkey", "p_brand", "p_size"), path, partition_by=["p_brand"])
    return spark.read.schema("p_partkey long, p_size int, p_brand string").parquet(path)


@query("src_20_csv_json_sinks", "SELECT s_suppkey, s_name, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS s_acctbal, 'csv' AS format FROM supplier UNION ALL SELECT s_suppkey, s_name, CASE WHEN s_acctbal > 0 THEN s_acctbal END, 'json' FROM supplier")
def _(spark, root):
    s = tables.scan(spark, root, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("s_acctbal"))
    a, b = place(spark), place(spark)
    tables.write_new(s, a, "csv")
    tables.write_new(s, b, "json")
    schema = "s_suppkey long, s_name string, s_acctbal double"
    read = spark.read.schema(schema)
    return read.option("header", "true").option("nullValue", "NA").csv(a).withColumn("format", F.lit("csv")).unionByName(spark.read.schema(schema).json(b).withColumn("format", F.lit("json")))


@query("src_21_checkpointed_tasks", "SELECT n_nationkey, count(*) AS customers FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def _(spark, root):
    c = tables.scan(spark, root, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("customers"))
    path = place(spark)
    c.filter("n_nationkey < 10").write.parquet(path)  # what an interrupted run had finished
    done = spark.read.schema(c.schema).parquet(path)
    return done.unionByName(c.join(done.select("n_nationkey"), "n_nationkey", "left_anti"))


@query("src_22_immutable_output", "SELECT 'refused' AS second_write")
def _(spark, root):
    from pyspark.errors import AnalysisException

    path = place(spark)
    rows = tables.scan(spark, root, "region")
    tables.write_new(rows, path)
    try:
        tables.write_new(rows, path)
        outcome = "overwritten"
    except AnalysisException:
        outcome = "refused"
    return spark.createDataFrame([(outcome,)], "second_write string")


def ended(stream, spark):
    """Run a stream over what there is and read what it wrote."""
    path = place(spark)
    q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def latest(stream, spark, keys: list[str], after=None):
    """Run a stream of updates; each batch is written beside the others, and of a key's rows the last batch's counts."""
    path = place(spark)

    def write(batch, number):
        (after(batch) if after else batch).withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/out/part={number}")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/state").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.parquet(f"{path}/out").drop("part")
    others = [c for c in rows.columns if c not in (*keys, "_batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "_batch").alias("x")).select(*keys, "x.*")


def event_stream(spark, root, files_per_trigger=1):
    from ledgerline.streaming.events import from_files

    events = tables.scan(spark, root, "events")
    path = place(spark)
    # a stream takes files in the order of their times, so the four stretches are written one after the other
    second = F.unix_timestamp(F.col("ts").cast("timestamp"))
    low, high = events.agg(F.min(second), F.max(second)).first()
    part = F.floor((second - F.lit(low)) * 4 / F.lit((high or 0) - (low or 0) + 1))
    for i in range(4):
        events.filter(part == i).coalesce(1).sortWithinPartitions("ts").write.mode("append").parquet(path)
    return from_files(spark, path, events.schema, files_per_trigger)


DAILY = "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY 1, 2"


@query("stream_windowed_totals", DAILY)
def _(spark, root):
    from ledgerline.streaming.events import windowed

    out = latest(windowed(event_stream(spark, root), late="40 days"), spark, ["start", "event_type"])
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_top_per_window", f"SELECT start, event_type, n, total, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY total DESC, event_type) AS r FROM ({DAILY})) WHERE r <= 3 AND start < (SELECT date_trunc('day', max(ts)) FROM events)")
def _(spark, root):
    from ledgerline.streaming.events import top_per_window, windowed

    # one batch, so that no row is late; after it the windows before the last row's are final
    out = ended(windowed(event_stream(spark, root, 1000), late="0 seconds"), spark)
    return top_per_window(out).withColumn("start", F.col("start").cast("timestamp_ntz")).filter(F.col("start") < tables.scan(spark, root, "events").agg(F.date_trunc("day", F.max("ts"))).first()[0])


@query(
    "stream_sessions",
    "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS begins FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(begins) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT * FROM (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS stop, count(*) AS n FROM s GROUP BY user_id, k) WHERE stop <= (SELECT max(ts) FROM events)",
)
def _(spark, root):
    from ledgerline.streaming.events import sessions

    # one batch, so that no row is late; sessions that end after the last row are still open
    rows = ended(sessions(event_stream(spark, root, 1000), gap="6 hours", late="0 seconds"), spark)
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "stop")})


@query("stream_alarms")
def _(spark, root):
    from ledgerline.streaming.events import alarms

    return ended(alarms(event_stream(spark, root), "40 days"), spark)


@query("stream_first_seen", "SELECT user_id, count(DISTINCT props) AS n FROM events GROUP BY 1")
def _(spark, root):
    from ledgerline.streaming.events import first_seen

    out = ended(first_seen(event_stream(spark, root).select("ts", "user_id", "props"), ["user_id", "props"], "40 days"), spark)
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


ANSWER = "count(*) OVER () AS matched, count(*) OVER () AS returned, false AS truncated"


@query("udf_01_tool_call", f"SELECT *, {ANSWER} FROM (SELECT c_mktsegment, round(stddev_pop(c_acctbal) / abs(avg(c_acctbal)), 9) AS metric, count(*) AS n FROM customer GROUP BY 1)")
def _(spark, root):
    from ledgerline.sources.api import call

    # the registered query works on the whole table, however large
    return call(spark, root, "metric", dataset="customer", metric="variation", value="c_acctbal", group_by=["c_mktsegment"], budget=1 << 62).withColumn("metric", F.round("metric", 9))


@query("udf_01_tool_metrics", f"""WITH g AS (SELECT c_nationkey, c_acctbal, avg(c_acctbal) OVER w AS mu, median(c_acctbal) OVER w AS med FROM customer WHERE c_acctbal > 0 WINDOW w AS (PARTITION BY c_nationkey)), m AS (SELECT *, median(abs(c_acctbal - med)) OVER (PARTITION BY c_nationkey) AS mad FROM g)
SELECT c_nationkey, round(avg(CASE WHEN mad > 0 AND abs(0.67448975 * (c_acctbal - med) / mad) > 1 THEN 1.0 ELSE 0.0 END), 9) AS metric, count(*) AS n, {ANSWER} FROM m GROUP BY 1""".replace(" FROM m GROUP BY 1", " FROM m GROUP BY 1"))
def _(spark, root):
    from ledgerline.functions import stats

    c = tables.scan(spark, root, "customer").filter("c_acctbal > 0").select("c_nationkey", "c_acctbal")
    z = stats.robust_z(c, "c_acctbal", ["c_nationkey"]).withColumn("far", (F.abs("z") > 1).cast("int"))
    out = z.groupBy("c_nationkey").agg(F.round(F.avg("far"), 9).alias("metric"), F.count(F.lit(1)).alias("n"))
    return tables.report(out, ["c_nationkey"], 200)


@query("udf_01_tool_normalise", f"SELECT r_regionkey, round(r_regionkey, 9) AS z, {ANSWER} FROM (SELECT r_regionkey, CASE WHEN stddev_pop(r_regionkey) OVER () = 0 THEN 0 ELSE (r_regionkey - avg(r_regionkey) OVER ()) / stddev_pop(r_regionkey) OVER () END AS z FROM region)".replace("round(r_regionkey, 9) AS z", "round(z, 9) AS normalised"))
def _(spark, root):
    from ledgerline.sources.api import call

    return call(spark, root, "normalise", dataset="region", value="r_regionkey", method="z_score", budget=1 << 62).withColumn("normalised", F.round("normalised", 9))


@query("udf_01_tool_crosswalk", "SELECT count(*) FILTER (WHERE n_nationkey IS NOT NULL) AS covered, count(*) AS total FROM (SELECT DISTINCT c_nationkey FROM customer) LEFT JOIN nation ON n_nationkey = c_nationkey")
def _(spark, root):
    from ledgerline.sources.api import call

    out = call(spark, root, "crosswalk")
    return out.select(F.col(out.columns[0]).alias("covered"), F.col(out.columns[1]).alias("total"))


@query(
    "udf_01_tool_forecast",
    PANEL + ", r AS (SELECT p.tid, p.cat, p.value, a.value AS last, b.value AS seasonal, (SELECT avg(q.value) FROM panel q WHERE q.tid = p.tid AND q.cat = p.cat AND q.m <= p.m - 2) AS mean FROM panel p JOIN panel a ON a.tid = p.tid AND a.cat = p.cat AND a.m = p.m - 2 JOIN panel b ON b.tid = p.tid AND b.cat = p.cat AND b.m = p.m - 12), l AS (UNPIVOT r ON last, seasonal, mean INTO NAME model VALUE predicted), s AS (SELECT model, tid, cat, sum(abs(value - predicted)) AS s, count(*) AS n FROM l GROUP BY 1, 2, 3) SELECT model, CAST(sum(n) AS BIGINT) AS n, round(sum(s) / sum(n), 4) AS mae, round(avg(s / n), 4) AS mae_macro FROM s GROUP BY 1",
)
def _(spark, root):
    from ledgerline.sources.api import call

    return call(spark, root, "forecast", horizon=2, budget=1 << 62).withColumns({c: F.round(c, 4) for c in ("mae", "mae_macro")})


@query("udf_02_grouped_callable", "SELECT event_type, round(sqrt(avg(value * value)), 9) AS rms FROM events GROUP BY 1")
def _(spark, root):
    @F.pandas_udf("double")
    def rms(v: pd.Series) -> float:
        return float((v * v).mean() ** 0.5)

    return tables.scan(spark, root, "events").groupBy("event_type").agg(F.round(rms("value"), 9).alias("rms"))


@query("udf_03_per_group_table", "SELECT event_type, min(value) AS low, max(value) AS high FROM events GROUP BY 1")
def _(spark, root):
    def ends(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"event_type": [rows["event_type"].iloc[0]], "low": [rows["value"].min()], "high": [rows["value"].max()]})

    # two ends of each batch are ends of the whole: a partial step in Arrow batches, then built-in ones
    def partial(frames):
        for frame in frames:
            yield pd.concat([ends(g) for _, g in frame.groupby("event_type")])

    part = tables.scan(spark, root, "events").select("event_type", "value").mapInPandas(partial, "event_type string, low double, high double")
    return part.groupBy("event_type").agg(F.min("low").alias("low"), F.max("high").alias("high"))


@query("udf_04_scalar_function", "SELECT p_partkey, upper(p_type) AS kind FROM part")
def _(spark, root):
    return tables.scan(spark, root, "part").select("p_partkey", F.upper("p_type").alias("kind"))


def packed(rows, build):
    """(path, content) of one small archive per row, built on the executors."""

    def run(frames):
        for frame in frames:
            yield pd.DataFrame([(name, build(texts)) for name, texts in zip(frame["path"], frame["texts"], strict=True)], columns=["path", "content"])

    return rows.mapInPandas(run, "path string, content binary")


def nations_of_regions(spark, root):
    n, r = tables.scan(spark, root, "nation"), tables.scan(spark, root, "region")
    j = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))  # regions
    return j.groupBy(F.col("r_name").alias("path")).agg(F.array_sort(F.collect_list("n_name")).alias("texts"))


def archive(members: dict) -> bytes:
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


ORDERED = "SELECT r_name, n_name, row_number() OVER (PARTITION BY r_name ORDER BY n_name) AS i FROM nation JOIN region ON n_regionkey = r_regionkey"


@query("src_11_workbook_cells", f"SELECT r_name AS path, 'sheet1' AS sheet, CAST(i AS INTEGER) AS row, 'A' AS col, n_name AS text FROM ({ORDERED})")
def _(spark, root):
    def build(texts):
        shared = "".join(f"<si><t>{t}</t></si>" for t in texts)
        cells = "".join(f'<row r="{i + 1}"><c r="A{i + 1}" t="s"><v>{i}</v></c></row>' for i in range(len(texts)))
        return archive({"xl/sharedStrings.xml": f"<sst>{shared}</sst>", "xl/worksheets/sheet1.xml": f"<worksheet><sheetData>{cells}</sheetData></worksheet>"})

    return files.cells_of(packed(nations_of_regions(spark, root), build))


@query("src_12_document_parts", f"SELECT r_name AS path, 'cell' AS kind, 0 AS \"table\", CAST(i - 1 AS INTEGER) AS row, 0 AS col, n_name AS text FROM ({ORDERED})")
def _(spark, root):
    def build(texts):
        rows = "".join(f"<tr><tc><p><r><t>{t}</t></r></p></tc></tr>" for t in texts)
        return archive({"word/document.xml": f"<document><body><tbl>{rows}</tbl></body></document>"})

    return files.parts_of(packed(nations_of_regions(spark, root), build))


@query("src_13_archive_members", f"SELECT r_name AS path, CASE WHEN i = 1 THEN '../' || n_name ELSE n_name END AS member, CAST(length(n_name) AS BIGINT) AS bytes, CASE WHEN i = 1 THEN 'quarantined' ELSE 'ok' END AS status, CASE WHEN i = 1 THEN 'unsafe path' END AS reason FROM ({ORDERED})")
def _(spark, root):
    return files.members_of(packed(nations_of_regions(spark, root), lambda texts: archive({("../" if i == 0 else "") + t: t for i, t in enumerate(texts)})))


@query("src_10_binary_workbook", f"SELECT r_name AS path, CASE WHEN c = 'A' THEN n_name ELSE CAST(i AS VARCHAR) END AS text, 'names' AS sheet, CAST(i AS INTEGER) AS row, c AS col FROM ({ORDERED}) CROSS JOIN (SELECT unnest(['A', 'B']) AS c)")
def _(spark, root):
    from ledgerline.sources import binary_workbook as B

    return B.cells_of(packed(nations_of_regions(spark, root), lambda texts: B.compose({"names": [[t, i + 1] for i, t in enumerate(texts)]})))


@query("src_14_range_reader", f"SELECT r_name AS path, n_name || '.txt' AS member, CAST(length(n_name) * 1000 AS BIGINT) AS bytes, repeat(n_name, 1000) AS text FROM ({ORDERED}) WHERE i % 2 = 1")
def _(spark, root):
    """Each task serves its archives on its own loopback address and reads every second member back by ranges."""

    def run(frames):
        from ledgerline.sources.ranges import open_archive
        from ledgerline.sources.serving import served

        for frame in frames:
            for name, texts in zip(frame["path"], frame["texts"], strict=True):
                with served(archive({f"{t}.txt": t * 1000 for t in texts})) as url, open_archive(url) as z:
                    yield pd.DataFrame([(name, f"{t}.txt", z.getinfo(f"{t}.txt").file_size, z.read(f"{t}.txt").decode()) for t in list(texts)[::2]], columns=["path", "member", "bytes", "text"])

    return nations_of_regions(spark, root).mapInPandas(run, "path string, member string, bytes long, text string")


@query("src_16_drawn_layer", f"SELECT r_name AS path, CAST(i - 1 AS INTEGER) AS feature, n_name AS name, [CAST(210 + 116.0 * (i - 1) AS DOUBLE), 242.0, 116.0, 116.0] AS box, format('M{{:.1f}},358.0L{{:.1f}},358.0L{{:.1f}},242.0L{{:.1f}},242.0Z', 210 + 116.0 * (i - 1), 210 + 116.0 * i, 210 + 116.0 * i, 210 + 116.0 * (i - 1)) AS outline FROM ({ORDERED})")
def _(spark, root):
    from ledgerline.sources import shapes

    def build(texts):
        square = lambda i: [(i, 0.0), (i + 1, 0.0), (i + 1, 1.0), (i, 1.0), (i, 0.0)]
        return shapes.compose([({"name": t}, [square(float(i))]) for i, t in enumerate(texts)])

    drawn = shapes.drawn(shapes.features_of(packed(nations_of_regions(spark, root), build)), width=1000.0, height=600.0, padding=210.0)
    return drawn.select("path", "feature", F.col("attributes")["name"].alias("name"), "box", "outline")


@query("src_15_paged_source", "SELECT i AS id, i * i AS square, 'row ' || i AS name FROM (SELECT unnest(range(2500)) AS i)")
def _(spark, root):
    from ledgerline.sources.pages import Pages

    spark.dataSource.register(Pages)
    return spark.read.format("ledgerline_pages").option("fetch", "ledgerline.sources.pages:numbered").option("page", "400").option("columns", "id long, square long, name string").load()


@query("chk_11_numeric_compare", "SELECT o_orderkey, o_totalprice AS old, CASE WHEN o_orderstatus = 'P' THEN o_totalprice + 1 ELSE o_totalprice END AS new, 'changed' AS problem FROM orders WHERE o_orderstatus = 'P'")
def _(spark, root):
    from ledgerline.operators.checks import differing

    o = tables.scan(spark, root, "orders")
    new = o.withColumn("o_totalprice", F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice") + 1e-9))
    return differing(o, new, ["o_orderkey"], "o_totalprice").withColumn("new", F.round("new", 6))


@query("chk_12_frozen_input", "SELECT r_regionkey, r_name FROM region")
def _(spark, root):
    from ledgerline.operators.checks import fingerprint, frozen

    r = tables.scan(spark, root, "region")
    return frozen(r, fingerprint(r.orderBy(F.desc("r_name"))))


@query("fn_11_charset_repair", "SELECT n_nationkey, 'Код ' || n_name AS name FROM nation")
def _(spark, root):
    from ledgerline.functions.text import reread

    wrong = "Код ".encode("cp866").decode("cp437")
    return tables.scan(spark, root, "nation").select("n_nationkey", reread(F.concat(F.lit(wrong), "n_name")).alias("name"))


@query(
    "udf_06_user_forecast",
    "WITH u AS (SELECT c_nationkey AS territory_id, c_mktsegment AS category, strftime(o_orderdate, '%Y-%m') AS date, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER w AS n, lag(value, 3) OVER w AS a, lag(value, 12) OVER w AS b, row_number() OVER (PARTITION BY territory_id, category ORDER BY date DESC) AS e FROM u WINDOW w AS (PARTITION BY territory_id, category ORDER BY date)) SELECT territory_id, category, count(*) AS n, round(avg(abs(value - a)), 4) AS mae_last, round(avg(abs(value - b)), 4) AS mae_seasonal FROM r WHERE n > 15 AND e <= 6 GROUP BY 1, 2",
)
def _(spark, root):
    from ledgerline.operators.panel import month_text, panel
    from ledgerline.sources.api import forecast_user

    rows = panel(spark, root).select(F.col("tid").alias("territory_id"), F.col("cat").alias("category"), month_text("m").alias("date"), "value")
    return forecast_user(rows).withColumns({c: F.round(c, 4) for c in ("mae_last", "mae_seasonal")})


@query("udf_06_user_clusters")
def _(spark, root):
    from ledgerline.operators.panel import panel
    from ledgerline.sources.api import cluster_user

    return cluster_user(panel(spark, root).withColumnsRenamed({"tid": "territory_id", "cat": "category"}), 4)
