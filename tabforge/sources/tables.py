"""The driver's tables and the ``flights`` view the operators work on.

The star schema (lineitem, orders, customer, supplier, part, nation) is
mapped onto the flight-booking layout every operator in this package was
designed for:

    travel_code   = l_orderkey        user_code  = o_custkey
    from_location = supplier nation   to_location = customer nation
    flight_type   = l_returnflag      agency      = o_orderstatus
    price         = l_extendedprice   time        = l_quantity
    distance      = p_retailprice     date        = o_orderdate (DATE)

plus ``line_number, part_key, supp_key``; together with ``travel_code`` they
form a unique row key used as the deterministic tie-break.

Joins: plain equi-joins without hints.  Spark broadcasts a side that is
below its threshold (by the scan's size, or by real size at run time) and
shuffles the others, so nothing here decides by a size estimate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_NAMES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations"]

FLIGHT_KEY = ["travel_code", "line_number", "part_key", "supp_key"]
FLIGHT_COLUMNS = ["travel_code", "user_code", "from_location", "to_location", "flight_type",
                  "price", "time", "distance", "agency", "date"]

# Raw (bronze) column names of the booking file, fixed by the source format.
RAW_COLUMNS = ["travelCode", "userCode", "from", "to", "flightType", "price", "time",
               "distance", "agency", "date"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Booking rows derived from the star schema (one row per line item).

    Supplier and part are joined straight to the fact side, so Spark sees
    those tables' own scan sizes when it picks the join.  Customers are joined
    to the orders, which are fewer and narrower than the line items, and the
    orders come last: the fact rows are shuffled once less, and while they
    are narrow."""
    t = lambda n: read_table(spark, sf_dir, n)
    from_n = t("nation").select(F.col("n_nationkey").alias("from_nk"),
                                F.col("n_name").alias("from_location"))
    to_n = t("nation").select(F.col("n_nationkey").alias("to_nk"),
                              F.col("n_name").alias("to_location"))
    supp = t("supplier").select("s_suppkey", "s_nationkey")
    cust = t("customer").select("c_custkey", "c_nationkey")
    part = t("part").select("p_partkey", "p_retailprice")
    orders = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    li = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                              "l_quantity", "l_extendedprice", "l_returnflag")
    booked = (orders.join(cust, F.col("o_custkey") == F.col("c_custkey"))
              .join(to_n, F.col("c_nationkey") == F.col("to_nk")))
    j = (li.join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
         .join(from_n, F.col("s_nationkey") == F.col("from_nk"))
         .join(part, F.col("l_partkey") == F.col("p_partkey"))
         .join(booked, F.col("l_orderkey") == F.col("o_orderkey")))
    return j.select(
        F.col("l_orderkey").alias("travel_code"),
        F.col("o_custkey").alias("user_code"),
        "from_location", "to_location",
        F.col("l_returnflag").alias("flight_type"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("time"),
        F.col("p_retailprice").alias("distance"),
        F.col("o_orderstatus").alias("agency"),
        F.to_date("o_orderdate").alias("date"),
        F.col("l_linenumber").alias("line_number"),
        F.col("l_partkey").alias("part_key"),
        F.col("l_suppkey").alias("supp_key"),
    )


def null_mask(c: str = "price") -> F.Column:
    """Deterministic NULL injection used by imputation tests (the driver
    tables hold no nulls): every row with ``(travel_code*7+line_number) % 11 = 0``."""
    return F.when((F.col("travel_code") * 7 + F.col("line_number")) % 11 == 0,
                  F.lit(None)).otherwise(F.col(c))


def flights_with_nulls(spark: SparkSession, sf_dir: str,
                       columns=("price", "distance", "agency")) -> DataFrame:
    df = flights(spark, sf_dir)
    return df.withColumns({c: null_mask(c) for c in columns})


def raw_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bronze/raw shape: source column names, date as ``yyyy-MM-dd`` text."""
    f = flights(spark, sf_dir)
    return f.select(
        F.col("travel_code").alias("travelCode"), F.col("user_code").alias("userCode"),
        F.col("from_location").alias("from"), F.col("to_location").alias("to"),
        F.col("flight_type").alias("flightType"), "price", "time", "distance", "agency",
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        "line_number", "part_key", "supp_key")
