"""Landed payloads, scans and sinks over JSON / XML text assembled from the given tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.numeric import to_double
from ..functions.udfs import register_table_functions, score_rows
from ..operators import tables as tb
from ..operators.cube import merge_prefer_new, norm_stats, to_long
from ..plans.frames import staging_path
from ..sources import landed, tables as st
from ..functions.numeric import round_half_up
from .base import cte, day, dense_daily, query, r6, table, view


def _event_json(spark, d, *fields):
    """events with one JSON item per row; ``fields`` are SQL expressions for struct members."""
    return table(spark, d, "events").selectExpr("event_id", "user_id", f"to_json(struct({', '.join(fields)})) AS item")


_ITEMS = """SELECT event_id, CAST(0 AS INT) AS item_no, user_id AS sta, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events
    UNION ALL SELECT event_id, CAST(1 AS INT), user_id, CAST(json_extract(props, '$.k') AS BIGINT) + 1 FROM events WHERE event_id % 5 IN (0, 1, 3)"""


def _payloads(spark, d):
    """Five envelope shapes; the shapes with a list carry two items, the others a single object."""
    one = "concat('{\"sta\":', user_id, ',\"k\":', get_json_object(props, '$.k'), '}')"
    two = "concat('{\"sta\":', user_id, ',\"k\":', CAST(get_json_object(props, '$.k') AS BIGINT) + 1, '}')"
    payload = f"""CASE event_id % 5
      WHEN 0 THEN concat('{{"body":{{"item":[', {one}, ',', {two}, ']}}}}')
      WHEN 1 THEN concat('{{"Item":[', {one}, ',', {two}, ']}}')
      WHEN 2 THEN concat('{{"response":{{"body":{{"items":{{"item":', {one}, '}}}}}}}}')
      WHEN 3 THEN concat('{{"getOceansNemo":{{"totalCount":2,"item":[', {one}, ',', {two}, ']}}}}')
      ELSE concat('{{"Body":{{"item":', {one}, '}}}}') END AS payload"""
    return table(spark, d, "events").selectExpr("event_id", payload)


def _item_fields(items):
    get = lambda k: F.get_json_object("item", f"$.{k}").cast("bigint").alias(k)
    return items.select("event_id", F.col("item_no").cast("int").alias("item_no"), get("sta"), get("k"))


@query("envelope_items", _ITEMS)
def envelope_items(spark, d):
    return _item_fields(landed.envelope_items(_payloads(spark, d), "payload", ["event_id"]))


def _dealt(rows, key):
    """Rows over as many tasks as the session's shuffles have; a table function takes them one by one, so nothing need be sorted or kept together."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), key)


@query("sql_envelope_items", _ITEMS)
def sql_envelope_items(spark, d):
    """The same items from the table function, called in SQL over rows dealt to all tasks."""
    register_table_functions(spark)
    return _item_fields(spark.sql("SELECT * FROM tw_envelope_items(TABLE({rows}), 'payload')", rows=_dealt(_payloads(spark, d), "event_id")))


@query(
    "sql_paragraphs",
    """WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), E'\\n\\n'), lambda x: trim(x, E' \\n\\t\\r')), lambda x: x <> '') AS ps FROM documents)
    SELECT doc_id, CAST(unnest(range(len(ps))) AS INT) AS paragraph_no, unnest(ps) AS paragraph FROM p""",
)
def sql_paragraphs(spark, d):
    """Paragraphs of every document from the table function."""
    register_table_functions(spark)
    rows = _dealt(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return spark.sql("SELECT doc_id, paragraph_no, paragraph FROM tw_paragraphs(TABLE({rows}), 'text')", rows=rows)


@query("text_files", "SELECT md5(text) AS text_md5, CAST(length(text) AS INT) AS n_chars FROM documents WHERE text <> ''")
def text_files(spark, d):
    """Every text as a file of its own, read back whole."""
    folders = st.write_text_files(table(spark, d, "documents").filter("text <> ''"), "text", staging_path(spark, "texts"))
    if not folders:
        return spark.createDataFrame([], "text_md5 STRING, n_chars INT")
    texts = st.read_text_files(spark, folders).selectExpr("left(text, length(text) - 1) AS text")  # without the closing character
    return texts.select(F.md5("text").alias("text_md5"), F.length("text").alias("n_chars"))


@query("xml_items", "SELECT r_regionkey, r_name AS name, n_nationkey AS code FROM region JOIN nation ON n_regionkey = r_regionkey")
def xml_items(spark, d):
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    payload = nations.selectExpr(
        "r_regionkey", "concat('<body><item><name>', r_name, '</name><code>', n_nationkey, '</code></item></body>') AS payload"
    )
    return landed.xml_items(payload, "payload", ["r_regionkey"], "name: STRING, code: INT")


@query(
    "femo_readings",
    """SELECT event_id, replace('NIFS-FEMO-farm area ' || CAST(user_id AS VARCHAR) || '-' || event_type, ' ', '_') AS sensor_id,
    CAST(make_date(2023, CAST(event_id % 12 + 1 AS BIGINT), CAST(event_id % 30 + 1 AS BIGINT)) AS VARCHAR) AS obs_date, CAST(event_id % 24 AS INT) AS hour, value AS water_temp, CAST(NULL AS DOUBLE) AS salinity FROM events
    WHERE event_id % 7 <> 0 AND NOT (event_id % 12 + 1 = 2 AND event_id % 30 + 1 > 28)""",
)
def femo_readings(spark, d):
    """Date parts from the event id; month 0 and 30 February are invalid and drop out."""
    items = _event_json(
        spark, d, "'2023' AS DATE_Y", "CASE WHEN event_id % 7 = 0 THEN '0' ELSE CAST(event_id % 12 + 1 AS STRING) END AS DATE_M",
        "CAST(event_id % 30 + 1 AS STRING) AS DATE_D", "CAST(event_id % 24 AS STRING) AS TIME_H",
        "concat('farm area ', user_id) AS FISHERY", "event_type AS LOCATION_POINT", "CAST(value AS STRING) AS TEMP_S", "'n/a' AS SAL_S",
    )
    r = landed.femo_readings(items, ["event_id"])
    return r.select(
        "event_id", "sensor_id", F.col("observed_at").cast("date").cast("string").alias("obs_date"),
        F.hour("observed_at").alias("hour"), "water_temp", "salinity",
    )


@query(
    "realtime_readings",
    """SELECT event_id, 'NIFS-RISA-' || CAST(user_id AS VARCHAR) AS sensor_id, strftime(ts, '%Y-%m-%d %H:%M') AS observed_at, value AS water_temp FROM events WHERE event_type IN ('view', 'click')""",
)
def realtime_readings(spark, d):
    items = _event_json(
        spark, d, "CASE WHEN event_type IN ('view', 'click') THEN '1' ELSE '2' END AS repair_gbn", "CAST(user_id AS STRING) AS sta_cde",
        "date_format(ts, 'yyyy-MM-dd') AS obs_dat", "date_format(ts, 'HH:mm:ss') AS obs_tim", "CAST(value AS STRING) AS wtr_tmp",
    )
    r = landed.realtime_readings(items, ["event_id"])
    return r.withColumn("observed_at", F.date_format("observed_at", "yyyy-MM-dd HH:mm"))


@query(
    "line_survey_points",
    """SELECT event_id, 'NIFS-SOO-' || CAST(user_id AS VARCHAR) || '-' || CAST(event_id % 50 AS VARCHAR) || 'm' AS sensor_id, value AS water_temp,
    CASE WHEN event_id % 4 <> 0 AND user_id <> 0 THEN 34.0 + CAST(event_id % 4 AS DOUBLE) END AS lat, CASE WHEN event_id % 4 <> 0 AND user_id <> 0 THEN CAST(user_id AS DOUBLE) END AS lon FROM events""",
)
def line_survey_points(spark, d):
    items = _event_json(
        spark, d, "CAST(user_id AS STRING) AS sta_cde", "CAST(event_id % 50 AS STRING) AS wtr_dep", "date_format(ts, 'yyyy-MM-dd HH:mm:ss') AS obs_dtm",
        "CAST(value AS STRING) AS wtr_tmp", "CASE WHEN event_id % 4 = 0 THEN '0' ELSE CAST(34 + event_id % 4 AS STRING) END AS lat", "CAST(user_id AS STRING) AS lon",
    )
    return landed.line_survey_points(items, ["event_id"]).select("event_id", "sensor_id", "water_temp", "lat", "lon")


def _stations(spark, d):
    s = view(spark, d, "v_stations")
    return landed.station_dimension(
        s, F.concat(F.lit(" "), F.col("station_id").cast("string")), F.col("station_name"),
        F.when(F.col("region_id") == 7, F.lit(0.0)).otherwise(F.col("lat")), F.col("lon"),
    )


@query("station_dim", cte("v_stations") + "SELECT CAST(station_id AS VARCHAR) AS station_code, station_name, round(lat, 6) AS lat, round(lon, 6) AS lon FROM v_stations WHERE region_id <> 7")
def station_dim(spark, d):
    return _stations(spark, d).select("station_code", "station_name", r6("lat"), r6("lon"))


@query(
    "network_observations",
    cte("v_stations") + """SELECT CAST(make_date(year(l_shipdate), month(l_shipdate), 15) AS VARCHAR) AS date, CAST(l_suppkey AS VARCHAR) AS station_code, round(s.lat, 6) AS lat, round(s.lon, 6) AS lon,
    l_orderkey, l_linenumber, l_partkey, l_quantity * 0.6 AS water_temp FROM lineitem JOIN v_stations s ON s.station_id = l_suppkey
    WHERE s.region_id <> 7 AND l_returnflag IN ('A', 'N') AND make_date(year(l_shipdate), month(l_shipdate), 15) BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'""",
)
def network_observations(spark, d):
    items = table(spark, d, "lineitem").selectExpr(
        "CASE l_returnflag WHEN 'A' THEN 'west' WHEN 'N' THEN 'south' ELSE 'east' END AS ocean_nm",
        "CAST(year(l_shipdate) AS STRING) AS obsr_year", "CAST(month(l_shipdate) AS STRING) AS obsr_mt",
        "concat(CAST(l_suppkey AS STRING), ' ') AS station_code", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity * 0.6D AS water_temp",
    )
    r = landed.network_observations(
        items, _stations(spark, d), ["west", "south"], F.lit("1996-01-01").cast("date"), F.lit("2000-12-31").cast("date"),
        ["l_orderkey", "l_linenumber", "l_partkey", "water_temp"],
    )
    return r.select(day("date"), "station_code", r6("lat"), r6("lon"), "l_orderkey", "l_linenumber", "l_partkey", "water_temp")


_WIND = ["NNE", "북", "135", "??", "wsw"]
_WIND_CASE = "CASE event_id % 5 WHEN 0 THEN 22.5 WHEN 1 THEN 0.0 WHEN 2 THEN 135.0 WHEN 3 THEN NULL ELSE 247.5 END"


def _weather(spark, d):
    winds = ", ".join(f"'{w}'" for w in _WIND)
    return table(spark, d, "events").selectExpr(
        "event_id", "user_id AS station_id", "ts", "CASE WHEN event_type = 'error' THEN NULL ELSE CAST(value AS STRING) END AS rn",
        f"element_at(array({winds}), CAST(event_id % 5 + 1 AS INT)) AS wd", "CAST(value / 10 AS STRING) AS ta",
    )


@query(
    "daily_weather",
    f"""SELECT event_id, station_id, date, CASE WHEN event_type = 'error' THEN 0.0 ELSE value END AS precipitation_mm, CAST({_WIND_CASE} AS DOUBLE) AS wind_dir_deg, round(value / 10, 6) AS avg_temp
    FROM (SELECT *, user_id AS station_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS date FROM events)""",
)
def daily_weather(spark, d):
    w = _weather(spark, d).withColumn("date", F.col("ts").cast("date").cast("string"))
    return landed.weather_rows(w, ["event_id", "station_id", "date"], "rn", "wd", {"ta": "avg_temp"}).withColumn("avg_temp", r6("avg_temp"))


@query(
    "hourly_weather",
    f"""SELECT event_id, user_id AS station_id, strftime(ts, '%Y-%m-%d %H') AS hour, CASE WHEN event_type = 'error' THEN 0.0 ELSE value END AS precipitation_mm, CAST({_WIND_CASE} AS DOUBLE) AS wind_dir_deg FROM events""",
)
def hourly_weather(spark, d):
    w = _weather(spark, d).withColumn("hour", F.date_format("ts", "yyyy-MM-dd HH"))
    return landed.weather_rows(w, ["event_id", "station_id", "hour"], "rn", "wd", {})


@query(
    "dam_flows",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H') || ':00' ELSE '2024' || strftime(ts, '-%m-%d %H') || CASE event_id % 3 WHEN 1 THEN ':00' ELSE strftime(ts, ':%M') END END AS observed_at,
    value AS discharge_m3s FROM events WHERE event_type <> 'signup'""",
)
def dam_flows(spark, d):
    rows = table(spark, d, "events").selectExpr(
        "event_id", "CASE event_id % 3 WHEN 0 THEN date_format(ts, \"yyyy-MM-dd HH'시'\") WHEN 1 THEN date_format(ts, \"MM-dd HH'시'\") ELSE date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") END AS obsrdt",
        "CASE WHEN event_type = 'signup' THEN '-' ELSE CAST(value AS STRING) END AS tototf",
    )
    r = landed.dam_flows(rows, ["event_id"], "obsrdt", "tototf", F.lit(2024))
    return r.withColumn("observed_at", F.date_format("observed_at", "yyyy-MM-dd HH:mm"))


@query(
    "climatology_points",
    cte("v_daily") + """, m AS (SELECT row_idx, col_idx, month(date) AS month, avg(sst) AS value FROM v_daily GROUP BY 1, 2, 3)
    SELECT CAST(month AS INT) AS month, round(34.0 + row_idx * 0.5, 6) AS lat, round(125.5 + col_idx * 0.5, 6) AS lon, round(value, 6) AS value FROM m WHERE 34.0 + row_idx * 0.5 BETWEEN 34.5 AND 36.0 AND 125.5 + col_idx * 0.5 BETWEEN 125.5 AND 127.0""",
)
def climatology_points(spark, d):
    """Monthly means put into one array per month and grid line, then read back as points."""
    monthly = view(spark, d, "v_daily").groupBy(F.month("date").alias("month"), "row_idx", "col_idx").agg(F.avg("sst").alias("v"))
    lines = landed.climatology_lines(monthly, ["month"], "row_idx", "col_idx", "v")
    p = landed.line_points(lines, ["month"], "row_idx", "line", (34.5, 36.0, 125.5, 127.0), (34.0, 125.5), 0.5)
    return p.select(F.col("month").cast("int").alias("month"), r6("lat"), r6("lon"), r6("value"))


_GRID_UNION = """, a AS (SELECT 0 AS rk, obs_date AS date, station_id, max(salinity) AS u, max(dissolved_oxygen) AS v, CAST(NULL AS DOUBLE) AS mld FROM v_station_obs WHERE l_linenumber % 2 = 0 GROUP BY 2, 3),
 b AS (SELECT 1 AS rk, obs_date AS date, station_id, min(salinity) AS u, min(dissolved_oxygen) AS v, max(din_ugl) AS mld FROM v_station_obs WHERE l_linenumber % 2 = 1 GROUP BY 2, 3),
 w AS (SELECT *, row_number() OVER (PARTITION BY date, station_id ORDER BY rk) AS rn FROM (SELECT * FROM a UNION ALL SELECT * FROM b))"""


@query(
    "grid_points_union",
    cte("v_station_obs") + _GRID_UNION + " SELECT CAST(date AS VARCHAR) AS date, station_id, round(u, 6) AS current_u, round(v, 6) AS current_v, round(mld, 6) AS mld FROM w WHERE rn = 1",
)
def grid_points_union(spark, d):
    """Two products: the first wins a shared (date, station); only the second has a mixed-layer depth."""
    obs = view(spark, d, "v_station_obs")
    first = obs.filter("l_linenumber % 2 = 0").groupBy(F.col("obs_date").alias("date"), "station_id").agg(
        F.max("salinity").alias("current_u"), F.max("dissolved_oxygen").alias("current_v")
    )
    second = obs.filter("l_linenumber % 2 = 1").groupBy(F.col("obs_date").alias("date"), "station_id").agg(
        F.min("salinity").alias("current_u"), F.min("dissolved_oxygen").alias("current_v"), F.max("din_ugl").alias("mld")
    )
    merged = tb.union_prefer_first([first, second], ["date", "station_id"]).filter(
        F.col("current_u").isNotNull() & F.col("current_v").isNotNull()
    )
    return merged.orderBy("date", "station_id").select(day("date"), "station_id", r6("current_u"), r6("current_v"), r6("mld"))


@query(
    "csv_windows",
    "SELECT CAST(o_orderkey AS VARCHAR) AS window_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS target_date, o_orderpriority AS region, "
    "CAST(o_orderkey % 2 AS INTEGER) AS y_true, round(o_totalprice, 2) AS v19_score FROM orders",
)
def csv_windows(spark, d):
    """Labelled windows written as CSV and read back with their schema."""
    path = staging_path(spark, "windows")
    orders = table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("window_id"), F.to_date("o_orderdate").alias("target_date"), F.col("o_orderpriority").alias("region"),
        F.lit(35.0).alias("lat"), F.lit(126.0).alias("lon"), (F.col("o_orderkey") % 2).cast("int").alias("y_true"), F.col("o_totalprice").alias("v19_score"),
    )
    orders.write.option("header", True).csv(path)
    back = st.read_labelled_windows(spark, path)
    return back.select("window_id", day("target_date"), "region", "y_true", round_half_up(F.col("v19_score"), 2).alias("v19_score"))


@query("present_columns", cte("v_station_obs") + "SELECT station_id, l_linenumber, salinity, water_temp FROM v_station_obs")
def present_columns(spark, d):
    """The requested channels that the readings have; the others are left out."""
    return tb.keep_present(view(spark, d, "v_station_obs"), ["station_id", "l_linenumber"], ["salinity", "absent_channel", "water_temp"])


@query("scored_rows", "SELECT l_orderkey, l_linenumber, round(CAST(l_quantity AS DOUBLE) * 2 - coalesce(CAST(l_tax AS DOUBLE), 0), 6) AS score FROM lineitem")
def scored_rows(spark, d):
    """A vectorised scorer evaluated once per batch."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    scored = score_rows(lines, ["l_quantity", "l_tax"], lambda m: m[:, 0] * 2 - np.nan_to_num(m[:, 1]))
    return scored.select("l_orderkey", "l_linenumber", r6("score"))


@query("sink_roundtrip", cte("v_station_obs") + "SELECT station_id, count(*) AS n, round(sum(din_ugl), 4) AS din_sum FROM v_station_obs GROUP BY 1")
def sink_roundtrip(spark, d):
    """Write the observations partitioned by day twice (the second write replaces), read them back and summarise."""
    path = staging_path(spark, "observations")
    obs = view(spark, d, "v_station_obs").withColumn("date", F.trunc("obs_date", "month"))
    st.write_by_day(obs, path)
    st.write_by_day(obs.filter(F.col("date") >= F.lit("2000-01-01")), path)
    back = st.read_table(spark, path)
    return back.groupBy("station_id").agg(F.count("*").alias("n"), round_half_up(F.sum("din_ugl"), 4).alias("din_sum"))


@query(
    "resume_todo_days",
    cte("v_daily", "v_station_obs") + "SELECT DISTINCT CAST(obs_date AS VARCHAR) AS date FROM v_station_obs WHERE obs_date NOT IN (SELECT date FROM v_daily)",
)
def resume_todo_days(spark, d):
    wanted = view(spark, d, "v_station_obs").select(F.col("obs_date").alias("date"))
    return st.days_to_do(wanted, view(spark, d, "v_daily")).select(day("date"))


@query(
    "collection_summary",
    cte("v_station_obs") + "SELECT CAST(min(obs_date) AS VARCHAR) AS first_date, CAST(max(obs_date) AS VARCHAR) AS last_date, count(*) AS n, count(DISTINCT obs_date) AS n_dates FROM v_station_obs",
)
def collection_summary(spark, d):
    return view(spark, d, "v_station_obs").agg(
        F.min("obs_date").cast("string").alias("first_date"), F.max("obs_date").cast("string").alias("last_date"),
        F.count("*").alias("n"), F.count_distinct("obs_date").alias("n_dates"),
    )


@query(
    "geojson_features",
    cte("v_farms") + "SELECT farm_id AS gid, 'region ' || CAST(region_id AS VARCHAR) AS region, 4 AS n_vertices, round(lat, 6) AS lat, round(lon, 6) AS lon FROM v_farms",
)
def geojson_features(spark, d):
    """A square polygon around every farm as GeoJSON text; its vertex mean is the farm position."""
    doc = """concat('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"gid":', farm_id, ',"sgg_nm":"region ', region_id,
      '"},"geometry":{"type":"Polygon","coordinates":[[[', lon - 0.5D, ',', lat - 0.5D, '],[', lon + 0.5D, ',', lat - 0.5D, '],[', lon + 0.5D, ',', lat + 0.5D, '],[', lon - 0.5D, ',', lat + 0.5D, ']]]}}]}') AS document"""
    f = landed.geojson_features(view(spark, d, "v_farms").selectExpr(doc), "document", [])
    return f.select("gid", "region", "n_vertices", r6("lat"), r6("lon"))


@query(
    "geojson_assemble",
    cte("v_farms") + "SELECT count(*) AS n_features, CAST(sum(CASE WHEN lat > 35 THEN 1 ELSE 0 END) AS BIGINT) AS n_north FROM v_farms",
)
def geojson_assemble(spark, d):
    """Feature collections are written and read back; the totals must survive."""
    path = staging_path(spark, "features")
    st.feature_documents(view(spark, d, "v_farms"), "lon", "lat", ["farm_id", "farm_name"]).write.json(path)
    schema = "shard INT, n_features INT, document STRING"
    docs = spark.read.schema(schema).json(path)
    coords = F.from_json("document", "features ARRAY<STRUCT<geometry: STRUCT<coordinates: ARRAY<DOUBLE>>>>")["features"]
    return docs.select(F.explode(coords).alias("f")).agg(
        F.count("*").alias("n_features"), F.sum((F.col("f.geometry.coordinates")[1] > 35).cast("bigint")).alias("n_north")
    )


@query(
    "source_freshness",
    """SELECT 'events' AS source, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS newest, count(*) AS n FROM events
    UNION ALL SELECT 'orders', strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S'), count(*) FROM orders
    UNION ALL SELECT 'lineitem', strftime(max(l_shipdate), '%Y-%m-%d %H:%M:%S'), count(*) FROM lineitem""",
)
def source_freshness(spark, d):
    f = st.freshness(
        {
            "events": (table(spark, d, "events"), F.col("ts")),
            "orders": (table(spark, d, "orders"), F.col("o_orderdate")),
            "lineitem": (table(spark, d, "lineitem"), F.col("l_shipdate")),
        }
    )
    return f.select("source", F.substring("newest", 1, 19).alias("newest"), "n")


@query(
    "cube_roundtrip",
    cte("v_dense") + """SELECT channel, n, round(mean, 6) AS mean, n_labels FROM (
    SELECT 'din' AS channel, count(din) AS n, avg(din) AS mean, count(*) AS n_labels FROM v_dense UNION ALL SELECT 'sst', count(sst), avg(sst), count(*) FROM v_dense)""",
)
def cube_roundtrip(spark, d):
    path = staging_path(spark, "cube")
    cube = dense_daily(spark, d)
    labels = cube.select("date", "row_idx", "col_idx", F.when(F.col("din") <= 70, 1).otherwise(0).cast("tinyint").alias("label"))
    st.write_cube(cube, labels, norm_stats(to_long(cube, ["date", "cell_id"], ["din", "sst"])), path)
    read_cube, read_labels, read_stats = st.read_cube(spark, path)
    again = norm_stats(to_long(read_cube, ["date", "cell_id"], ["din", "sst"])).join(read_stats.select("channel"), "channel")
    return again.withColumn("n_labels", read_labels.select(F.count("*")).scalar()).select("channel", "n", r6("mean"), "n_labels")


@query(
    "merge_prefer_new",
    cte("v_daily") + """, o AS (SELECT date, cell_id, din FROM v_daily WHERE date < DATE '1999-01-01'), n AS (SELECT date, cell_id, din * 2 AS din FROM v_daily WHERE date >= DATE '1998-01-01' AND cell_id < 20)
    SELECT CAST(date AS VARCHAR) AS date, cell_id, round(din, 6) AS din FROM (SELECT * FROM n UNION ALL SELECT * FROM o WHERE date NOT IN (SELECT date FROM n))""",
)
def merge_cubes(spark, d):
    daily = view(spark, d, "v_daily").select("date", "cell_id", "din")
    old = daily.filter(F.col("date") < F.lit("1999-01-01").cast("date"))
    new = daily.filter((F.col("date") >= F.lit("1998-01-01").cast("date")) & (F.col("cell_id") < 20)).withColumn("din", F.col("din") * 2)
    return merge_prefer_new(old, new).select(day("date"), "cell_id", r6("din"))


@query(
    "label_summary",
    "SELECT label, n FROM (SELECT CAST(quality AS INT) AS label, count(*) AS n FROM labels GROUP BY 1)",
)
def label_summary(spark, d):
    path = staging_path(spark, "labels")
    rows = table(spark, d, "labels").withColumnRenamed("quality", "label")
    st.write_per_label(rows, path)
    by_label = st.read_table(spark, f"{path}/by_label")
    return by_label.groupBy(F.col("label").cast("int").alias("label")).agg(F.count("*").alias("n"))


@query(
    "json_paths",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 'none' AS missing, CAST(coalesce(json_extract(props, '$.z'), json_extract(props, '$.k')) AS DOUBLE) AS z_or_k FROM events""",
)
def json_paths(spark, d):
    get = lambda p: F.get_json_object("props", p)
    return table(spark, d, "events").select(
        "event_id", get("$.k").cast("bigint").alias("k"), F.coalesce(get("$.missing"), F.lit("none")).alias("missing"),
        F.coalesce(to_double(get("$.z")), to_double(get("$.k"))).alias("z_or_k"),
    )
