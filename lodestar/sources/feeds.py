"""Parsers of live and historical feeds: DataFrames of text or files in, typed rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import text
from lodestar.sources.tables import SchemaError, require_columns


def alerts_csv(spark: SparkSession, path: str, regions: DataFrame) -> DataFrame:
    """Alert intervals by region: region, started_at, finished_at, naive. regions: region, iso. Unknown spellings raise."""
    raw = require_columns(spark.read.option("header", True).csv(path), "region", "started_at", "finished_at", "naive")
    x = raw.join(regions, "region", "left").withColumn("iso", F.coalesce("iso", F.raise_error(F.concat(F.lit("unknown region: "), F.col("region"))).cast("string")))
    x = x.select("iso", F.to_timestamp("started_at").alias("start"), F.to_timestamp("finished_at").alias("end"), (F.lower("naive") == "true").alias("naive")).where("end > start")
    return x.withColumn("minutes", (F.unix_micros("end") - F.unix_micros("start")) / 6e7)


def conflict_csv(spark: SparkSession, path: str, flags: list[str], regions: DataFrame) -> DataFrame:
    """Conflict events with nullable flags. A strike is an air strike or air defence, null flags counting as no."""
    need = ("event_id_1pd", "date", "ADM1_NAME", "asciiname", "longitude", "latitude", "GEO_PRECISION", "n_reports", *flags)
    raw = require_columns(spark.read.option("header", True).csv(path), *need)
    flag = lambda c: F.col(c).try_cast("double").cast("boolean")
    x = raw.join(regions.withColumnRenamed("region", "ADM1_NAME"), "ADM1_NAME", "left")
    x = x.select(F.col("event_id_1pd").alias("event_id"), F.to_date("date", "yyyyMMdd").alias("date"), "iso", F.col("asciiname").alias("place"), F.col("longitude").try_cast("double").alias("lon"), F.col("latitude").try_cast("double").alias("lat"), F.col("GEO_PRECISION").alias("precision"), F.col("n_reports").try_cast("int").alias("reports"), *(flag(c).alias(c) for c in flags))
    air = F.lit(False)
    for c in flags:
        if "airstrike" in c or "air_defense" in c or "airdef" in c or "airad" in c:
            air = air | F.coalesce(F.col(c), F.lit(False))
    return x.withColumn("air_attack", air)


DAILY = ("cloud_cover_mean", "precipitation_sum", "wind_speed_10m_max")


def weather(pages: DataFrame, isos: list[str]) -> DataFrame:
    """Daily rows of a page's locations, told apart by their place in it. pages: value, a JSON array."""
    kind = "array<struct<latitude:double,longitude:double,daily:struct<time:array<string>," + ",".join(f"{c}:array<double>" for c in DAILY) + ">>>"
    x = pages.select(F.from_json("value", kind).alias("j"))
    checked = F.when(F.size("j") == len(isos), F.col("j")).otherwise(F.raise_error(F.concat(F.lit("locations: "), F.size("j").cast("string"))).cast(kind))
    x = x.select(F.posexplode(checked).alias("i", "l"))
    iso = F.element_at(F.array(*map(F.lit, isos)), F.col("i") + 1)
    x = x.select(iso.alias("iso"), F.explode(F.arrays_zip(F.col("l.daily.time").alias("time"), *(F.col(f"l.daily.{c}").alias(c) for c in DAILY))).alias("d"))
    return x.select("iso", F.to_date("d.time").alias("date"), *(F.col(f"d.{c}").alias(c) for c in DAILY))


AIRCRAFT = "struct<hex:string,flight:string,r:string,t:string,dbFlags:int,alt_baro:string,alt_geom:double,gs:double,track:double,baro_rate:double,squawk:string,emergency:string,category:string,lat:double,lon:double,nic:int,nac_p:int,version:int,seen_pos:double,mlat:array<string>,tisb:array<string>,type:string>"


def aircraft(polls: DataFrame, oldest: float = 60.0) -> DataFrame:
    """Aircraft of polls, listed under either name; positions too old go. polls: value (JSON), received_ms."""
    x = polls.select("received_ms", F.from_json("value", f"struct<ac:array<{AIRCRAFT}>,aircraft:array<{AIRCRAFT}>>").alias("j"))
    x = x.select("received_ms", F.explode(F.coalesce("j.ac", "j.aircraft")).alias("a")).select("received_ms", "a.*").where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & (F.coalesce("seen_pos", F.lit(0.0)) <= oldest))
    ground = F.col("alt_baro") == "ground"
    feet = F.when(F.coalesce(ground, F.lit(False)), F.lit(0.0)).otherwise(F.coalesce("alt_geom", F.col("alt_baro").try_cast("double")))
    label = F.coalesce(F.nullif(F.trim("flight"), F.lit("")), F.nullif(F.col("r"), F.lit("")), F.upper("hex"))
    return x.select(F.col("hex").alias("id"), F.lit("aircraft").alias("kind"), label.alias("label"), "lon", "lat", (feet * 0.3048).alias("alt"), F.col("track").alias("hdg"), F.col("gs").alias("spd"), F.coalesce(ground, F.lit(False)).alias("ground"),
                    (F.col("received_ms") - F.coalesce("seen_pos", F.lit(0.0)) * 1000).cast("long").alias("ts"), (F.coalesce("dbFlags", F.lit(0)).bitwiseAND(1) == 1).alias("military"), "nic", "nac_p", "version", "type", "mlat", "tisb", "squawk")


def gnss_samples(air: DataFrame, cell: float = 0.5, worst: int = 8) -> DataFrame:
    """Samples fit to tell interference: airborne, own position, a version that reports accuracy; bad where it is poor."""
    own = (F.size(F.coalesce("mlat", F.array().cast("array<string>"))) == 0) & (F.size(F.coalesce("tisb", F.array().cast("array<string>"))) == 0)
    fit = air.where(own & ~F.col("ground") & (F.coalesce("version", F.lit(0)) >= 1) & F.col("nac_p").isNotNull())
    return fit.select(F.col("id").alias("hex"), "ts", F.floor(F.col("lat") / cell).alias("row"), F.floor(F.col("lon") / cell).alias("col"), (F.col("nac_p") < worst).alias("bad"))


def gnss_cells(samples: DataFrame, least: int = 3) -> DataFrame:
    """Share of aircraft whose latest sample in a cell is bad, and its level."""
    last = samples.groupBy("row", "col", "hex").agg(F.max_by("bad", "ts").alias("bad"), F.max("ts").alias("ts"))
    g = last.groupBy("row", "col").agg(F.count("*").alias("n"), F.count_if("bad").alias("bad"), F.avg(F.col("bad").cast("int")).alias("share"), F.max("ts").alias("ts")).where(F.col("n") >= least)
    return g.withColumn("level", F.when(F.col("share") > 0.10, "high").when(F.col("share") > 0.02, "medium").otherwise("low"))


def gnss_entities(cells: DataFrame, cell: float = 0.5) -> DataFrame:
    """Cells as things on a map: id, kind, label, the middle, ts, share to three digits, level and the closed outline."""
    west, south = F.col("col") * cell, F.col("row") * cell
    corner = lambda i, j: F.array(west + i * cell, south + j * cell)
    label = F.format_string("GNSS %s (%d/%d aircraft degraded)", "level", "bad", "n")
    return cells.select(
        F.concat_ws(":", F.lit("gnss"), F.col("col").cast("string"), F.col("row").cast("string")).alias("id"), F.lit("gnss").alias("kind"), label.alias("label"), (west + cell / 2).alias("lon"), (south + cell / 2).alias("lat"), "ts",
        F.col("n").alias("aircraft"), F.col("bad").alias("degraded"), F.round("share", 3).alias("share"), "level", F.array(*(corner(i, j) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0)))).alias("polygon"))


def alert_states(polls: DataFrame, regions: DataFrame, zone: str = "Europe/Kyiv") -> DataFrame:
    """State of each region in a poll; names without a region raise. polls: value (JSON)."""
    x = polls.select(F.from_json("value", "struct<cachedat:string,states:map<string,struct<alertnow:boolean,changed:string>>>").alias("j")).select("j.cachedat", F.explode("j.states").alias("region", "s"))
    x = x.join(regions, "region", "left").withColumn("iso", F.coalesce("iso", F.raise_error(F.concat(F.lit("unknown region: "), F.col("region"))).cast("string")))
    return x.select("iso", F.col("s.alertnow").alias("active"), F.to_utc_timestamp(F.to_timestamp("s.changed"), zone).alias("changed"), F.to_utc_timestamp(F.to_timestamp("cachedat"), zone).alias("at"))


#: Columns of the news export that are read, by place.
NEWS = {0: "id", 6: "actor1", 16: "actor2", 26: "code", 28: "root", 30: "goldstein", 31: "mentions", 34: "tone", 51: "geo_type", 52: "place", 53: "country", 56: "lat", 57: "lon", 59: "added", 60: "url"}


def news(spark: SparkSession, path: str, roots: list[str], box: tuple[float, float, float, float], columns: int = 61) -> DataFrame:
    """News of some event roots inside a box (lon, lat, lon, lat), one row for each article and place."""
    raw = spark.read.schema(", ".join(f"{NEWS.get(i, f'_{i}')} string" for i in range(columns))).option("sep", "\t").option("quote", "").option("mode", "FAILFAST").csv(path)
    num = lambda c: F.col(c).try_cast("double")
    x = raw.where(F.col("root").isin(*roots) & (F.col("geo_type") != "1") & num("lon").between(box[0], box[2]) & num("lat").between(box[1], box[3]))
    x = x.withColumn("ts", F.to_timestamp("added", "yyyyMMddHHmmss")).withColumn("o", F.col("id").try_cast("long"))
    key = [F.col("url"), F.format_string("%.3f", num("lat")).alias("lat3"), F.format_string("%.3f", num("lon")).alias("lon3")]
    names = lambda c: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.struct("o", F.col(c).alias("v"))))), lambda s: s["v"]))
    g = x.groupBy(*key).agg(F.min_by("place", "o").alias("label"), F.min_by("ts", "o").alias("ts"), F.min_by(num("tone"), "o").alias("tone"), F.min(num("goldstein")).alias("goldstein"), F.max(F.col("mentions").try_cast("int")).alias("mentions"), F.array_distinct(F.concat(names("actor1"), names("actor2"))).alias("actors"), names("code").alias("codes"))
    return g.select(text.hash_id(F.col("url"), F.col("lat3"), F.col("lon3")).alias("id"), "label", F.col("lon3").cast("double").alias("lon"), F.col("lat3").cast("double").alias("lat"), "ts", "tone", "goldstein", "mentions", "actors", "codes", "url")


def thermal(spark: SparkSession, path: str, product: str) -> DataFrame:
    """Thermal anomalies of one product: id, lon, lat, ts, frp_mw, confidence, satellite, daynight. A file without the columns raises."""
    raw = require_columns(spark.read.option("header", True).csv(path), "latitude", "longitude", "acq_date", "acq_time", "frp", "confidence", "satellite", "daynight")
    ts = F.to_timestamp(F.concat("acq_date", F.lit(" "), F.lpad(F.trim("acq_time"), 4, "0")), "yyyy-MM-dd HHmm")
    x = raw.select(F.col("longitude").cast("double").alias("lon"), F.col("latitude").cast("double").alias("lat"), ts.alias("ts"), F.nullif(F.col("frp"), F.lit("")).try_cast("double").alias("frp_mw"), "confidence", "satellite", "daynight")
    key = text.hash_id(F.lit(product), F.col("lat").cast("string"), F.col("lon").cast("string"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))
    return x.select(F.concat(F.lit("fire:"), key).alias("id"), *x.columns, F.lit(product).alias("product"))


def rss(pages: DataFrame, source: str) -> DataFrame:
    """Items of feeds. pages: value (XML)."""
    tag = lambda n: text.strip_html(F.regexp_replace(F.regexp_extract("item", rf"(?s)<{n}\b[^>]*>(.*?)</{n}>", 1), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"))
    x = pages.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<item\b.*?</item>"), F.lit(0))).alias("item"))
    return x.select(F.substring(F.sha1(tag("link")), 1, 12).alias("id"), F.lit(source).alias("source"), tag("title").alias("title"), tag("link").alias("url"), tag("description").alias("summary"), F.try_to_timestamp(F.regexp_replace(tag("pubDate"), r"^[A-Za-z]{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z")).alias("ts"))


def channel_posts(pages: DataFrame) -> DataFrame:
    """Posts of a channel's page. pages: value (HTML)."""
    x = pages.select(F.explode(F.split("value", r"(?=data-post=\")")).alias("b")).where(F.col("b").startswith('data-post="'))
    body = F.regexp_extract("b", r"(?s)<div[^>]*message_text[^>]*>(.*?)</div>", 1)
    return x.select(F.regexp_extract("b", r'^data-post="([^"]+)"', 1).alias("id"), F.try_to_timestamp(F.regexp_extract("b", r'<time[^>]*datetime="([^"]+)"', 1)).alias("ts"), text.strip_html(body).alias("text")).where("text <> ''")


def gazetteer(spark: SparkSession, path: str, populous: dict[str, int]) -> DataFrame:
    """Places and air bases of enough people, one row for each name, in order of size."""
    cols = ["id", "name", "ascii", "alternates", "lat", "lon", "class", "code", "country", "cc2", "admin1", "a2", "a3", "a4", "population", "elevation", "dem", "zone", "modified"]
    raw = spark.read.schema(", ".join(f"{c} string" for c in cols)).option("sep", "\t").option("quote", "").csv(path)
    least = F.coalesce(F.create_map(*(x for k, v in populous.items() for x in (F.lit(k), F.lit(v))))[F.col("country")], F.lit(0))
    people = F.coalesce(F.col("population").try_cast("long"), F.lit(0))
    kept = raw.where(((F.col("class") == "P") & (people >= least)) | (F.col("code") == "AIRB"))
    names = F.array_distinct(F.transform(F.concat(F.array("name", "ascii"), F.coalesce(F.split("alternates", ","), F.array().cast("array<string>"))), lambda n: text.norm(n)))
    return kept.select("id", "name", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), "country", "admin1", people.alias("population"), F.explode(F.filter(names, lambda n: n.isNotNull() & (n != ""))).alias("key"))


def geocode(queries: DataFrame, places: DataFrame, column: str = "query") -> DataFrame:
    """Best place for a name in any inflection: the first form with a hit, then the most people."""
    q = queries.select(column, F.posexplode(text.variants(text.norm(F.col(column)))).alias("form", "key"))
    hit = q.join(places, "key").groupBy(column).agg(F.min(F.struct("form", (-F.col("population")).alias("p"), "id", "name", "lat", "lon")).alias("b"))
    return hit.select(column, "b.id", "b.name", "b.lat", "b.lon")


def airports(spark: SparkSession, path: str, kinds: list[str], box: tuple[float, float, float, float]) -> DataFrame:
    raw = require_columns(spark.read.option("header", True).option("escape", '"').csv(path), "ident", "type", "name", "latitude_deg", "longitude_deg", "elevation_ft", "iso_country", "icao_code", "keywords")
    military = F.concat_ws(" ", "name", "keywords").rlike(r"(?iu)\b(air ?base|air force|military|naval air|army airfield|afb|авиабаза|військов)")
    x = raw.where(F.col("type").isin(*kinds)).select("ident", F.coalesce(F.nullif("icao_code", F.lit("")), "ident").alias("icao"), "name", F.col("longitude_deg").cast("double").alias("lon"), F.col("latitude_deg").cast("double").alias("lat"), (F.col("elevation_ft").try_cast("double") * 0.3048).alias("elevation_m"), F.col("iso_country").alias("country"), "type", F.coalesce(military, F.lit(False)).alias("military"))
    return x.where(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3]))


def register(spark: SparkSession, path: str) -> DataFrame:
    """Military airframes of a register of JSON lines; gzip is read as it is."""
    x = spark.read.schema("icao string, reg string, icaotype string, model string, ownop string, short_type string, mil boolean").json(path)
    return x.where("mil").select(F.lower("icao").alias("hex"), "reg", F.col("icaotype").alias("type"), "model", F.col("ownop").alias("operator"))


def address_blocks(script: str, spark: SparkSession, least: int = 1) -> DataFrame:
    """Blocks of aircraft addresses out of a script's rows."""
    row = r'start:\s*0x([0-9A-Fa-f]+),\s*end:\s*0x([0-9A-Fa-f]+),\s*country:\s*"([^"]*)"(?:,\s*country_code:\s*(?:"([^"]*)"|null))?'
    s = spark.createDataFrame([(script,)], "s string").select(F.explode(F.regexp_extract_all("s", F.lit(row), F.lit(0))).alias("r"))
    part = lambda i: F.regexp_extract("r", row, i)
    x = s.select(F.conv(part(1), 16, 10).cast("long").alias("start"), F.conv(part(2), 16, 10).cast("long").alias("end"), part(3).alias("country"), F.nullif(part(4), F.lit("")).alias("code"))
    if x.count() < least:
        raise SchemaError("too few address blocks")
    return x


def mid_table(value: DataFrame) -> DataFrame:
    """Maritime digits to country. value: one JSON map of arrays."""
    return value.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("mid", "v")).select("mid", F.element_at("v", 1).alias("code"), F.element_at("v", -1).alias("country"))


def orbits(value: DataFrame, names: str) -> DataFrame:
    """Orbital elements of satellites whose name matches."""
    kind = "array<struct<OBJECT_NAME:string,EPOCH:string,MEAN_MOTION:double,ECCENTRICITY:double,INCLINATION:double,RA_OF_ASC_NODE:double,ARG_OF_PERICENTER:double,MEAN_ANOMALY:double,NORAD_CAT_ID:long,BSTAR:double>>"
    return value.select(F.explode(F.from_json("value", kind)).alias("o")).select("o.*").where(F.col("OBJECT_NAME").rlike(names)).withColumn("EPOCH", F.to_timestamp("EPOCH"))


LEVELS = (925, 850, 700, 500, 300, 250)


def winds(value: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """Hourly wind at pressure levels: time, level, speed_kn, direction. Another unit than knots raises."""
    fields = ",".join(f"wind_speed_{p}hPa:array<double>,wind_direction_{p}hPa:array<double>" for p in levels)
    units = ",".join(f"wind_speed_{p}hPa:string" for p in levels)
    x = value.select(F.from_json("value", f"struct<hourly:struct<time:array<string>,{fields}>,hourly_units:struct<{units}>>").alias("j"))
    good = F.lit(True)
    for p in levels:
        good = good & F.coalesce(F.col(f"j.hourly_units.wind_speed_{p}hPa").isin("kn", "kt"), F.lit(False))
    x = x.withColumn("ok", F.when(good, True).otherwise(F.raise_error(F.lit("winds are not in knots")).cast("boolean"))).where("ok")
    zipped = F.arrays_zip(F.col("j.hourly.time").alias("t"), *(F.col(f"j.hourly.wind_{k}_{p}hPa").alias(f"{k}_{p}") for p in levels for k in ("speed", "direction")))
    x = x.select(F.explode(zipped).alias("z"))
    each = F.array(*(F.struct(F.lit(p).alias("level"), F.col(f"z.speed_{p}").alias("speed_kn"), F.col(f"z.direction_{p}").alias("direction")) for p in levels))
    return x.select(F.to_timestamp("z.t").alias("time"), F.explode(each).alias("w")).select("time", "w.*")


def front_features(value: DataFrame) -> DataFrame:
    """Features of a map with their key, English name and plane coordinates. value: one GeoJSON map."""
    kind = "struct<map:struct<features:array<struct<properties:struct<name:string>,geometry:struct<type:string,coordinates:string>>>>>"
    x = value.select(F.explode(F.from_json("value", kind)["map"]["features"]).alias("f"))
    parts = F.transform(F.split("f.properties.name", "///"), lambda p: F.trim(p))
    ring = F.transform(F.from_json("f.geometry.coordinates", "array<array<array<double>>>")[0], lambda c: F.slice(c, 1, 2))
    return x.select(F.element_at(parts, -1).alias("key"), F.try_element_at(parts, F.lit(2)).alias("english"), F.col("f.geometry.type").alias("geometry"), F.when(F.col("f.geometry.type") == "Polygon", ring).alias("ring"))


def trace_points(traces: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Points of military traces that enter the box, their callsign carried forward. traces: icao, r, t, dbFlags, timestamp, trace."""
    from pyspark.sql import Window

    x = traces.where(F.coalesce("dbFlags", F.lit(0)).bitwiseAND(1) == 1).select(F.col("icao").alias("hex"), F.col("r").alias("reg"), F.col("t").alias("type"), "timestamp", F.posexplode("trace").alias("i", "p"))
    own = F.nullif(F.trim("p.callsign"), F.lit(""))
    x = x.select("hex", "reg", "type", "i", F.timestamp_millis(((F.col("timestamp") + F.col("p.offset")) * 1000).cast("long")).alias("ts"), F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"), F.when(F.col("p.alt") == "ground", 0.0).otherwise(F.col("p.alt").try_cast("double") * 0.3048).alias("alt_m"), (F.col("p.alt") == "ground").alias("ground"), own.alias("callsign"))
    inside = F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3])
    w = Window.partitionBy("hex").orderBy("ts", "i")
    x = x.withColumn("callsign", F.last("callsign", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_in", F.bool_or(inside).over(Window.partitionBy("hex")))
    return x.where("_in").drop("_in", "i")


def ship_updates(messages: DataFrame) -> DataFrame:
    """Position and static messages of ships merged into one row for each number. messages: value (JSON), received_ms.

    A static message alone makes no position; a heading of 511 means none and the course stands in.
    """
    kind = "struct<MessageType:string,MetaData:struct<MMSI:long,ShipName:string,latitude:double,longitude:double>,Message:struct<PositionReport:struct<Sog:double,Cog:double,TrueHeading:int>,ShipStaticData:struct<ImoNumber:long,CallSign:string,Type:int,Destination:string>>>"
    x = messages.select("received_ms", F.from_json("value", kind).alias("j")).where("j.MetaData.MMSI IS NOT NULL")
    x = x.select(F.col("j.MetaData.MMSI").alias("mmsi"), "received_ms", F.nullif(F.trim("j.MetaData.ShipName"), F.lit("")).alias("name"), F.col("j.MetaData.longitude").alias("lon"), F.col("j.MetaData.latitude").alias("lat"), F.col("j.Message.PositionReport").alias("p"), F.col("j.Message.ShipStaticData").alias("s"))
    last = lambda c, when: F.max_by(c, F.when(when, F.col("received_ms")))
    here, named = F.col("p").isNotNull(), F.col("s").isNotNull()
    hdg = F.when(F.col("p.TrueHeading").between(0, 359), F.col("p.TrueHeading").cast("double")).otherwise(F.col("p.Cog"))
    g = x.groupBy("mmsi").agg(last("name", F.col("name").isNotNull()).alias("label"), last("lon", here).alias("lon"), last("lat", here).alias("lat"), last(F.col("p.Sog"), here).alias("spd"), last(hdg, here).alias("hdg"), F.max(F.when(here, F.col("received_ms"))).alias("ts"), last(F.nullif(F.col("s.ImoNumber"), F.lit(0)), named).alias("imo"), last(F.col("s.Type"), named).alias("type"))
    return g.withColumn("positioned", F.col("ts").isNotNull())


def first_facilities(value: DataFrame) -> DataFrame:
    """Facilities of a query's bindings: the first binding of each item counts, one without a label goes. value: JSON array."""
    x = value.select(F.posexplode(F.from_json("value", "array<struct<qid:string,name:string,type:string,lon:double,lat:double,country:string>>")).alias("i", "f"))
    first = x.groupBy(F.col("f.qid").alias("qid")).agg(F.min_by("f", "i").alias("f")).select("f.*")
    return first.where(F.col("name").isNotNull() & (F.col("name") != F.col("qid")))


def facility_label(country: Column) -> Column:
    return F.concat_ws(", ", "name", country)
