"""Scans and sinks: what was written is read back whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from clientele.plans.oracle import CAMPAIGN, LINES, with_
from clientele.plans.registry import query
from clientele.sources.database import list_databases, list_tables
from clientele.session import shared_folder
from clientele.sources.files import load_lines, write_csv
from clientele.sources.tables import campaign, order_lines, table
from clientele.sources.workbook import read_workbooks, write_workbooks


@query("csv_roundtrip", with_(LINES) + """
select customer_id, order_id, order_ts, quantity, value::double as value, market_segment as city from lines""")
def csv_roundtrip(spark, sf):
    lines = order_lines(spark, sf, city=True).select(
        F.col("customer_id").alias("CustomerRef"), F.col("order_id").alias("OrderId"),
        F.col("order_ts").alias("OrderDate"), F.col("quantity").alias("Quantity"),
        F.col("value").cast("double").alias("Price"), F.col("market_segment").alias("Place"))
    path = write_csv(lines, shared_folder(spark, "lines-csv"))
    return load_lines(
        spark, path, "CustomerRef long, OrderId long, OrderDate timestamp_ntz, Quantity double, "
        "Price double, Place string",
        {"CustomerRef": "customer_id", "OrderId": "order_id", "OrderDate": "order_ts",
         "Quantity": "quantity", "Price": "value", "Place": "city"})


@query("xlsx_scan", with_(CAMPAIGN) + """
select day::timestamp as day, type, impression, click, purchase, earning from campaign""")
def xlsx_scan(spark, sf):
    """Campaign rows as two workbook folders with a sheet per group, read back as one table."""
    rows = campaign(spark, sf).withColumn("day", F.col("day").cast("timestamp_ntz"))
    parts = []
    for kind, sheet in (("control", "Control Group"), ("test", "Test Group")):
        path = write_workbooks(rows.where(F.col("type") == kind).drop("type"),
                               shared_folder(spark, "campaign-xlsx"), sheet)
        parts.append(read_workbooks(
            spark, path, "day timestamp_ntz, impression double, click double, purchase double, "
            "earning double", sheet).withColumn("type", F.lit(kind)))
    return parts[0].unionByName(parts[1])


@query("xlsx_orders", """
select o_orderkey as order_id, o_orderdate as order_ts, o_orderstatus as status, o_totalprice as total
from orders""")
def xlsx_orders(spark, sf):
    """All orders through a folder of workbooks, one per task."""
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").alias("order_ts"),
        F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"))
    path = write_workbooks(o, shared_folder(spark, "orders-xlsx"))
    return read_workbooks(spark, path,
                          "order_id long, order_ts timestamp_ntz, status string, total double")


CATALOG = ("orders", "lineitem", "customer", "nation", "part", "supplier", "region", "events")


@query("catalog_databases", "select 'default' as namespace, count(*) as n_tables from information_schema.tables "
       "where table_name = 'region'")
def catalog_databases(spark, sf):
    """The databases of the session; the given tables become one view of the current one."""
    table(spark, sf, "region").createOrReplaceTempView("region")
    found = list_databases(spark).where("namespace = 'default'")
    names = list_tables(spark).where("isTemporary and tableName = 'region'").agg(F.count("*").alias("n_tables")).scalar()
    out = found.select("namespace", names.alias("n_tables")).toPandas()
    spark.catalog.dropTempView("region")
    return spark.createDataFrame(out, "namespace string, n_tables long")


@query("catalog_tables", "\nunion all ".join(
    f"""select '{n}' as "tableName", true as "isTemporary", count(*) as "rows" from {n}""" for n in CATALOG))
def catalog_tables(spark, sf):
    """The tables of the session, with the rows each one holds."""
    counts = None
    for n in CATALOG:
        view = table(spark, sf, n)
        view.createOrReplaceTempView(n)
        one = view.agg(F.count("*").alias("rows")).select(F.lit(n).alias("tableName"), "rows")
        counts = one if counts is None else counts.unionByName(one)
    found = list_tables(spark).where("isTemporary").select("tableName", "isTemporary")  # listed now
    for n in CATALOG:
        spark.catalog.dropTempView(n)
    return found.join(counts, "tableName")

