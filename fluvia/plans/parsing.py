"""Queries on text contracts, codes and catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fluvia.functions import text
from fluvia.plans.registry import query
from fluvia.sources.tables import table, view


@query(
    "",
    """SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS iso, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') END AS checked,
    trim(regexp_replace(o_orderpriority || ' / ' || o_orderstatus || '!', '[^A-Za-z0-9_-]+', '_', 'g'), '_') AS name FROM orders""",
)
def names_and_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compact dates to ISO (bad ones to null), and export names."""
    rows = table(spark, sf_dir, "orders")
    compact = F.date_format("o_orderdate", "yyyyMMdd")
    broken = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.substring(compact, 1, 4), F.lit("9999"))).otherwise(compact)
    return rows.select("o_orderkey", text.iso_date(compact).alias("iso"), text.iso_date(broken).alias("checked"), text.sanitized(F.concat("o_orderpriority", F.lit(" / "), "o_orderstatus", F.lit("!"))).alias("name"))


@query("", "SELECT p_partkey, CAST(month(DATE '2020-01-01' + CAST(p_partkey % 366 AS INT)) AS INT) AS month, CASE WHEN p_partkey % 2 = 0 THEN 'terra' ELSE 'aqua' END AS platform, printf('h%02dv%02d', p_partkey % 36, p_partkey % 18) AS tile FROM part")
def granule_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months, platforms and tiles from granule names."""
    k = F.col("p_partkey")
    name = F.format_string("%s13Q1.A2020%03d.h%02dv%02d.061.hdf", F.when(k % 2 == 0, "MOD").otherwise("MYD"), k % 366 + 1, k % 36, k % 18)
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("g")).select("p_partkey", text.granule_month(F.col("g")).alias("month"), text.granule_part(F.col("g"), "platform").alias("platform"), text.granule_part(F.col("g"), "tile").alias("tile"))


@query(
    "",
    """w AS (SELECT p_partkey, p_partkey % 10 AS k, CASE WHEN p_size > 40 THEN 'spring' WHEN p_size > 20 THEN 'open_water' ELSE 'wetland' END AS cls, CASE WHEN p_size % 5 = 0 THEN 'NHDArea_460' ELSE p_type END AS label FROM part)
    SELECT p_partkey, k IN (0, 3, 5) AS persistent, CASE WHEN label LIKE 'NHDArea%' THEN 2.0 WHEN cls = 'spring' THEN 0.5 WHEN cls = 'open_water' THEN 1.5 ELSE 2.5 END + CASE WHEN regexp_matches(label, '(?i)steel|brass') THEN 1.5 ELSE 0.0 END AS sigma FROM w""",
)
def anchor_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wetland codes, and how uncertain an anchor's head is."""
    k = F.col("p_partkey")
    codes = F.array(*[F.lit(c) for c in ("L1UBH", "PUBHh/EM1A", "PABJ", "R2UBH", "PUBA ", "PEM1C", "R4SBC", "PFO1Cd", "U", "LUBK")])
    cls = F.when(F.col("p_size") > 40, "spring").when(F.col("p_size") > 20, "open_water").otherwise("wetland")
    label = F.when(F.col("p_size") % 5 == 0, "NHDArea_460").otherwise(F.regexp_replace("p_type", "(?i)steel|brass", "reservoir"))
    sigma = text.head_uncertainty(cls, label)
    return table(spark, sf_dir, "part").select("p_partkey", text.persistent_wetland(F.get(codes, (k % 10).cast("int"))).alias("persistent"), sigma.cast("double").alias("sigma"))


@query("", "SELECT l_orderkey, l_linenumber, 'L' || CAST(l_orderkey AS VARCHAR) AS item_id, CAST(l_shipdate AS DATE) AS d FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 4 <> 0)")
def catalogue_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the items whose key is not in the catalogue yet, as extensions and resumed runs add them."""
    known = table(spark, sf_dir, "orders").where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("l_orderkey"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("d"))
    return rows.join(known, "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber", F.concat(F.lit("L"), F.col("l_orderkey").cast("string")).alias("item_id"), "d")


@query(
    "fx_wells fx_points",
    """u AS (SELECT 'wells' AS source, well_id AS id, obs_dtw AS v, CASE confinement_class WHEN 'unknown' THEN NULL ELSE confinement_class END AS cls FROM fx_wells UNION ALL SELECT 'points', point_id, rem_at_sample, NULL FROM fx_points)
    SELECT source, count(*) AS n, count(cls) AS n_class, round(min(v), 6) AS lowest, round(max(v), 6) AS highest, count(*) FILTER (WHERE cls = 'confined') AS n_confined FROM u GROUP BY source""",
)
def union_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of different columns under one schema, absent columns as nulls."""
    wells = view(spark, sf_dir, "fx_wells").select(F.lit("wells").alias("source"), F.col("well_id").alias("id"), F.col("obs_dtw").alias("v"), F.when(F.col("confinement_class") != "unknown", F.col("confinement_class")).alias("cls"))
    points = view(spark, sf_dir, "fx_points").select(F.lit("points").alias("source"), F.col("point_id").alias("id"), F.col("rem_at_sample").alias("v"))
    both = wells.unionByName(points, allowMissingColumns=True)
    return both.groupBy("source").agg(F.count("*").alias("n"), F.count("cls").alias("n_class"), F.round(F.min("v"), 6).alias("lowest"), F.round(F.max("v"), 6).alias("highest"), F.count_if(F.col("cls") == "confined").alias("n_confined"))


@query(
    "fx_reaches",
    """SELECT stream_id, lpad(CAST(stream_id AS VARCHAR), 14, '0') AS code, substring(lpad(CAST(stream_id AS VARCHAR), 14, '0'), 11, 2) AS unit, round(ln(1 + greatest(length_m, 0)), 6) AS log_length, CASE WHEN relief_m IN (0, 4.9) THEN NULL ELSE relief_m END AS relief,
    CASE WHEN stream_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0 END AS is_a, CASE WHEN stream_id % 3 = 1 THEN 1.0::DOUBLE ELSE 0.0 END AS is_b FROM fx_reaches""",
)
def reach_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived reach features: padded codes and their units, logarithms, sentinels as nulls, one-hot classes."""
    code = F.lpad(F.col("stream_id").cast("string"), 14, "0")
    return view(spark, sf_dir, "fx_reaches").select(
        "stream_id", code.alias("code"), F.substring(code, 11, 2).alias("unit"), F.round(F.log1p(F.greatest("length_m", F.lit(0.0))), 6).alias("log_length"), F.when(~F.col("relief_m").isin(0.0, 4.9), F.col("relief_m")).alias("relief"),
        *[(F.col("stream_id") % 3 == i).cast("double").alias(f"is_{c}") for i, c in enumerate("ab")],
    )


@query("fx_stations", "SELECT station, count(*) AS n, count(*) FILTER (WHERE dtw IS NULL OR isnan(dtw) OR isinf(dtw)) AS bad, round(avg(dtw), 10) AS dtw_mean, count(DISTINCT CAST(ts AS DATE)) AS n_days FROM fx_stations GROUP BY station")
def export_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing and infinite values counted before an export; any would be an error."""
    bad = F.coalesce(F.col("dtw").isNull() | F.isnan("dtw") | (F.abs("dtw") == float("inf")), F.lit(True))
    checked = view(spark, sf_dir, "fx_stations").groupBy("station").agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"), F.round(F.avg("dtw"), 10).alias("dtw_mean"), F.count_distinct(F.to_date("ts")).alias("n_days"))
    return checked.withColumn("bad", F.when(F.col("bad") > 0, F.raise_error(F.lit("values that cannot be exported"))).otherwise(F.col("bad")))


@query("", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<li>')) AS n_links FROM pages")
def metadata_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of marked-up metadata, and the number of listed entries."""
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit("(<li>)"))).cast("long").alias("n_links"))


@query(
    "",
    """SELECT o_orderkey, 'Order ' || CAST(o_orderkey AS VARCHAR) AS title, -110.5::DOUBLE - o_custkey % 10 AS westbc, CASE WHEN o_orderkey % 4 <> 0 THEN 41.25::DOUBLE + o_custkey % 5 END AS southbc, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS begins, CASE WHEN o_orderkey % 3 <> 0 THEN strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') END AS ends,
    CASE WHEN o_orderkey % 2 = 0 THEN 'https://a.example/' || CAST(o_orderkey AS VARCHAR) || ';https://b.example/x' ELSE '' END AS links FROM orders""",
)
def metadata_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata documents, one for each order, parsed into fields."""
    key, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyyMMdd")
    links = F.when(key % 2 == 0, F.concat(F.lit("<onlink>https://a.example/"), key.cast("string"), F.lit("</onlink><onlink>https://b.example/x</onlink>"))).otherwise("")
    south = F.when(key % 4 != 0, F.concat(F.lit("<southbc>"), (41.25 + F.col("o_custkey") % 5).cast("string"), F.lit("</southbc>"))).otherwise("<southbc>unknown</southbc>")
    xml = F.concat(
        F.lit("<metadata><idinfo><citation><citeinfo><title> Order "), key.cast("string"), F.lit("</title>"), links, F.lit("</citeinfo></citation><timeperd><timeinfo><rngdates><begdate>"), day, F.lit("</begdate><enddate>"), F.when(key % 3 != 0, day).otherwise("present"),
        F.lit("</enddate></rngdates></timeinfo></timeperd><spdom><bounding><westbc>"), (-110.5 - F.col("o_custkey") % 10).cast("string"), F.lit("</westbc>"), south, F.lit("</bounding></spdom></idinfo></metadata>"),
    )
    # documents cost far more than their rows hold, so small files must not decide how many tasks parse them
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate").repartition(4 * spark.sparkContext.defaultParallelism, "o_orderkey")
    parsed = rows.select("o_orderkey", text.metadata_record(xml).alias("m"))
    return parsed.select("o_orderkey", "m.title", "m.westbc", "m.southbc", "m.begins", "m.ends", F.array_join("m.links", ";").alias("links"))


@query("", "SELECT o_custkey, list_aggregate(list_sort(list(CAST(o_orderkey AS VARCHAR))), 'string_agg', ';') AS keys, 'y' || CAST(o_custkey % 7 AS VARCHAR) AS prefix, 'root/y' || CAST(o_custkey % 7 AS VARCHAR) || '/' || CAST(o_custkey AS VARCHAR) AS path FROM orders GROUP BY o_custkey")
def object_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of object listings, one for each customer, parsed into keys and prefixes; and paths built from parts."""
    keys = F.array_join(F.transform(F.sort_array(F.collect_list(F.col("o_orderkey").cast("string"))), lambda k: F.concat(F.lit("<Contents><Key>"), k, F.lit("</Key></Contents>"))), "")
    prefix = F.concat(F.lit("y"), (F.col("o_custkey") % 7).cast("string"), F.lit("/"))
    page = F.concat(F.lit('<ListBucketResult xmlns="urn:listing">'), F.col("keys"), F.lit("<CommonPrefixes><Prefix>"), prefix, F.lit("</Prefix></CommonPrefixes></ListBucketResult>"))
    pages = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(keys.alias("keys")).withColumn("page", page)
    return pages.select("o_custkey", F.array_join(text.listed_keys(F.col("page")), ";").alias("keys"), text.listed_prefixes(F.col("page"))[0].alias("prefix"), text.bucket_path(F.lit("root/"), prefix, F.lit(None).cast("string"), F.lit(""), F.col("o_custkey")).alias("path"))
