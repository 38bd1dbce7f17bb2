"""Landed API payloads to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fx
from ..functions.numeric import first_timestamp, to_double, wind_degrees, yearless_timestamp
from ..functions.text import composite_id

def envelope_items(df: DataFrame, payload: str, ids: list[str], paths: tuple[str, ...] = fx.ITEM_PATHS) -> DataFrame:
    """One row per item JSON; a single object counts as a one-item list, an unknown envelope gives no rows."""
    found = F.coalesce(*[F.get_json_object(payload, p) for p in paths])
    as_list = F.when(found.startswith("{"), F.concat(F.lit("["), found, F.lit("]"))).otherwise(found)
    variants = F.from_json(as_list, "array<variant>")
    return df.select(*ids, F.posexplode(variants).alias("item_no", "_v")).select(
        *ids, "item_no", F.to_json("_v").alias("item")
    )


def xml_items(df: DataFrame, payload: str, ids: list[str], schema: str) -> DataFrame:
    """``<item>`` children of an XML payload as rows."""
    parsed = F.from_xml(F.col(payload), f"item ARRAY<STRUCT<{schema}>>")
    return df.select(*ids, F.explode(parsed["item"]).alias("_i")).select(*ids, "_i.*")


def _get(item: str, name: str) -> Column:
    return F.get_json_object(item, f"$.{name}")


def femo_readings(items: DataFrame, ids: list[str], item: str = "item") -> DataFrame:
    """Survey items: date parts to a timestamp, composite sensor id, measures; invalid dates are dropped."""
    part = lambda n, default=0: F.coalesce(_get(item, n).try_cast("int"), F.lit(default))
    observed = F.try_make_timestamp_ntz(
        part("DATE_Y"), part("DATE_M"), part("DATE_D"), part("TIME_H"), part("TIME_I"), F.lit(0).cast("decimal(8,6)")
    )
    fields = {
        "TEMP_S": "water_temp", "SAL_S": "salinity", "DO_S": "dissolved_oxygen",
        "NO3_N_S": "no3_nitrogen", "NH4_N_S": "nh4_nitrogen", "PH_S": "ph",
    }
    usable = (part("DATE_Y") != 0) & (part("DATE_M") != 0) & (part("DATE_D") != 0)
    return items.select(
        *ids,
        composite_id(
            F.lit("NIFS-FEMO"), F.coalesce(_get(item, "FISHERY"), F.lit("")), F.coalesce(_get(item, "LOCATION_POINT"), F.lit(""))
        ).alias("sensor_id"),
        F.when(usable, observed).alias("observed_at"),
        *[to_double(_get(item, src)).alias(dst) for src, dst in fields.items()],
    ).filter(F.col("observed_at").isNotNull())


def realtime_readings(items: DataFrame, ids: list[str], item: str = "item") -> DataFrame:
    """Normal-status station items with joined date and time."""
    time = F.substring(F.coalesce(_get(item, "obs_tim"), F.lit("00:00:00")), 1, 5)
    stamp = F.concat_ws(" ", _get(item, "obs_dat"), time)
    return items.filter(_get(item, "repair_gbn") == "1").select(
        *ids,
        F.concat(F.lit("NIFS-RISA-"), F.coalesce(_get(item, "sta_cde"), F.lit("UNKNOWN"))).alias("sensor_id"),
        first_timestamp(stamp, ["yyyy-MM-dd HH:mm", "yyyyMMdd HH:mm"]).cast("timestamp_ntz").alias("observed_at"),
        to_double(_get(item, "wtr_tmp")).alias("water_temp"),
    )


def line_survey_points(items: DataFrame, ids: list[str], item: str = "item") -> DataFrame:
    """Line-survey items; the position is kept only when both coordinates are non-zero."""
    lat, lon = to_double(_get(item, "lat")), to_double(_get(item, "lon"))
    located = (lat != 0) & (lon != 0)
    fields = {"wtr_tmp": "water_temp", "sal": "salinity", "dox": "dissolved_oxygen"}
    return items.select(
        *ids,
        composite_id(
            F.lit("NIFS-SOO"),
            F.coalesce(_get(item, "sta_cde"), F.lit("UNKNOWN")),
            F.concat(F.coalesce(_get(item, "wtr_dep"), F.lit("")), F.lit("m")),
        ).alias("sensor_id"),
        first_timestamp(_get(item, "obs_dtm"), ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm"])
        .cast("timestamp_ntz").alias("observed_at"),
        *[to_double(_get(item, src)).alias(dst) for src, dst in fields.items()],
        F.when(located, lat).alias("lat"),
        F.when(located, lon).alias("lon"),
    ).filter(F.col("observed_at").isNotNull())


def station_dimension(items: DataFrame, code: Column, name: Column, lat: Column, lon: Column) -> DataFrame:
    """Code -> position for stations whose code and both coordinates are present and non-zero."""
    return items.select(
        F.trim(code).alias("station_code"), name.alias("station_name"), lat.alias("lat"), lon.alias("lon")
    ).filter((F.col("station_code") != "") & (F.col("lat") != 0) & (F.col("lon") != 0))


def network_observations(
    items: DataFrame, stations: DataFrame, areas: list[str], start: Column, end: Column, measures: list[str]
) -> DataFrame:
    """Monitoring-network rows of the wanted sea areas, dated the 15th of their month, with station positions."""
    obs = F.try_to_date(F.concat_ws("-", "obsr_year", "obsr_mt", F.lit("15")), "yyyy-M-d")
    dated = items.filter(F.col("ocean_nm").isin(*areas)).withColumn("date", obs)
    return dated.filter(F.col("date").between(start, end)).withColumn(
        "station_code", F.trim(F.col("station_code"))
    ).join(stations.select("station_code", "lat", "lon"), "station_code").select(
        "date", "lat", "lon", "station_code", *measures
    )


def weather_rows(df: DataFrame, ids: list[str], rain: str, wind_text: str, others: dict[str, str]) -> DataFrame:
    """Weather fields: missing rain counts as none, wind text becomes degrees."""
    return df.select(
        *ids,
        F.coalesce(to_double(F.col(rain)), F.lit(0.0)).alias("precipitation_mm"),
        wind_degrees(F.col(wind_text)).alias("wind_dir_deg"),
        *[to_double(F.col(src)).alias(dst) for src, dst in others.items()],
    )


def dam_flows(df: DataFrame, ids: list[str], stamp: str, discharge: str, year: Column) -> DataFrame:
    """Dam rows with a parsed time; rows without discharge are dropped."""
    return df.select(
        *ids,
        yearless_timestamp(F.col(stamp), year).cast("timestamp_ntz").alias("observed_at"),
        to_double(F.col(discharge)).alias("discharge_m3s"),
    ).filter(F.col("discharge_m3s").isNotNull())


def climatology_lines(cells: DataFrame, ids: list[str], row: str, col: str, value: str) -> DataFrame:
    """(ids, row, line): one array per grid line from its first column 0 to the last column of the grid, NULL where a cell is missing."""
    last = cells.agg(F.max(col)).first()[0] or 0
    held = cells.groupBy(*ids, row).agg(F.map_from_entries(F.collect_list(F.struct(F.col(col).cast("int"), F.col(value)))).alias("_m"))
    return held.select(*ids, row, F.transform(F.sequence(F.lit(0), F.lit(int(last))), lambda c: F.try_element_at("_m", c)).alias("line"))


def line_points(
    lines: DataFrame, ids: list[str], row: str, line: str, box: tuple[float, float, float, float], origin: tuple[float, float], step: float
) -> DataFrame:
    """Points of grid lines inside a box, missing values dropped."""
    lat_min, lat_max, lon_min, lon_max = box
    return (
        lines.select(*ids, F.col(row).alias("_i"), F.posexplode(line).alias("_j", "value"))
        .select(
            *ids,
            (F.lit(origin[0]) + F.col("_i") * F.lit(step)).alias("lat"),
            (F.lit(origin[1]) + F.col("_j") * F.lit(step)).alias("lon"),
            "value",
        )
        .filter(F.col("value").isNotNull() & ~F.isnan("value"))
        .filter(F.col("lat").between(lat_min, lat_max) & F.col("lon").between(lon_min, lon_max))
    )


def climatology_points(df: DataFrame, ids: list[str], grid: str, box: tuple[float, float, float, float], origin: tuple[float, float], step: float) -> DataFrame:
    """Nested month x lat x lon arrays to point rows inside a box, missing values dropped."""
    months = df.select(*ids, F.posexplode(grid).alias("_m", "_rows"))
    lines = months.select(*ids, (F.col("_m") + 1).alias("month"), F.posexplode("_rows").alias("_i", "_cols"))
    return line_points(lines, [*ids, "month"], "_i", "_cols", box, origin, step)


def pack_rows(df: DataFrame, document: str, ids: list[str]) -> DataFrame:
    """Prediction-pack JSON to (date, gid, stage, warn, severe, adi7); bare-integer and struct entries both work."""
    nested = F.from_json(F.col(document), "map<string,map<string,string>>")
    days = df.select(*ids, F.explode(nested).alias("_date", "_farms"))
    farms = days.select(*ids, "_date", F.explode("_farms").alias("gid", "_e"))
    entry = F.from_json("_e", "stage INT, warn DOUBLE, severe DOUBLE, adi7 ARRAY<DOUBLE>")
    bare = F.col("_e").try_cast("int")
    return farms.withColumn("_p", F.when(bare.isNull(), entry)).select(
        *ids, F.col("_date").cast("date").alias("date"), "gid",
        F.coalesce(bare, F.col("_p.stage")).alias("stage"),
        F.col("_p.warn").alias("warn"), F.col("_p.severe").alias("severe"), F.col("_p.adi7").alias("adi7"),
    )


def geojson_features(df: DataFrame, document: str, ids: list[str]) -> DataFrame:
    """Polygon features with properties and the mean of their vertices."""
    schema = (
        "features ARRAY<STRUCT<properties: STRUCT<gid: BIGINT, sgg_nm: STRING>, "
        "geometry: STRUCT<type: STRING, coordinates: ARRAY<ARRAY<ARRAY<DOUBLE>>>>>>"
    )
    parsed = F.from_json(F.col(document), schema)
    rows = df.select(*ids, F.explode(parsed["features"]).alias("_f"))
    vertices = F.flatten(F.col("_f.geometry.coordinates"))
    mean = lambda k: F.aggregate(vertices, F.lit(0.0), lambda a, v: a + v[k]) / F.size(vertices)
    return rows.select(
        *ids, F.col("_f.properties.gid").alias("gid"), F.col("_f.properties.sgg_nm").alias("region"),
        F.size(vertices).alias("n_vertices"), mean(0).alias("lon"), mean(1).alias("lat"),
    )
