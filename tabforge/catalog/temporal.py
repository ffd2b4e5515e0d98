"""Catalogue: time-ordered splits (T1-T3) and ordering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordering, splits
from ..plans import config as C
from ..sources.tables import flights
from .base import TIE, register, with_flights

_POS = f"row_number() OVER (ORDER BY date, {TIE}) - 1"


@register("split_fraction", "T1", with_flights(f"""
SELECT {TIE}, CASE WHEN pos < c1 THEN 'train' WHEN pos < c2 THEN 'validation' ELSE 'test' END AS split
FROM (SELECT {TIE}, {_POS} AS pos FROM flights WHERE date IS NOT NULL) x,
     (SELECT CAST(floor(n * CAST(0.7 AS DOUBLE)) AS BIGINT) AS c1,
             CAST(floor(n * CAST(0.7 AS DOUBLE)) AS BIGINT)
               + CAST(floor(n * CAST(0.15 AS DOUBLE)) AS BIGINT) AS c2
      FROM (SELECT count(*) AS n FROM flights WHERE date IS NOT NULL)) b"""))
def q_split_fraction(spark, sf):
    s = splits.split_by_fraction(flights(spark, sf), "date", C.TIE_KEY, 0.70, 0.15)
    return s.select(*C.TIE_KEY, "split")


@register("split_bounds", "T2", with_flights(f"""
SELECT {TIE}, CASE WHEN date <= DATE '1999-06-30' THEN 'train'
                   WHEN date <= DATE '2000-03-31' THEN 'validation'
                   WHEN date <= DATE '2000-12-31' THEN 'test' ELSE 'holdout' END AS split
FROM flights WHERE date IS NOT NULL"""))
def q_split_bounds(spark, sf):
    s = splits.split_by_dates(flights(spark, sf), "date", "1999-06-30", "2000-03-31", "2000-12-31")
    return s.select(*C.TIE_KEY, "split")


@register("ts_folds", "T3", with_flights(f"""
SELECT CAST(f.fold AS INTEGER) AS fold,
       CASE WHEN p.pos >= f.test_start THEN 'test' ELSE 'train' END AS role,
       count(*) AS n_rows, min(p.pos) AS min_ordinal, max(p.pos) AS max_ordinal,
       min(p.date) AS min_date, max(p.date) AS max_date
FROM (SELECT date, {_POS} AS pos FROM flights) p,
     (SELECT i AS fold, 0 AS train_start, n - (5 - i) * (n // 6) AS train_end,
             n - (5 - i) * (n // 6) AS test_start, n - (5 - i) * (n // 6) + (n // 6) AS test_end
      FROM (SELECT count(*) AS n FROM flights), range(5) t(i)) f
WHERE p.pos >= f.train_start AND p.pos < f.test_end
GROUP BY 1, 2"""))
def q_ts_folds(spark, sf):
    f = flights(spark, sf).select("date", *C.TIE_KEY)
    ordered, n = splits.with_ordinal(f, "date", C.TIE_KEY, return_count=True)
    folds = splits.time_series_folds(n, C.N_SPLITS)
    a = splits.assign_folds(ordered, folds)
    return a.groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("ordinal").alias("min_ordinal"),
        F.max("ordinal").alias("max_ordinal"), F.min("date").alias("min_date"),
        F.max("date").alias("max_date"))


@register("top_k_price", "O2", with_flights(
    f"SELECT {TIE}, price FROM flights ORDER BY price DESC, {TIE} LIMIT 15"))
def q_top_k(spark, sf):
    return ordering.top_k(flights(spark, sf).select(*C.TIE_KEY, "price"), "price", 15, C.TIE_KEY)


_SAMPLE_SQL = f"SELECT {TIE}, price FROM flights ORDER BY md5(concat_ws('|', {TIE}, 42)), {TIE} LIMIT "


@register("seeded_sample", "O3", with_flights(_SAMPLE_SQL + "2000"))
def q_sample(spark, sf):
    return ordering.seeded_sample(flights(spark, sf).select(*C.TIE_KEY, "price"), 2000, 42,
                                  C.TIE_KEY)


@register("sample_export", "S10 O3", with_flights(_SAMPLE_SQL + "50"))
def q_sample_export(spark, sf):
    """The sample written as one CSV file with a header, and read back."""
    import uuid
    from ..session import ensure_checkpoint_dir
    from ..sources.sinks import export_sample_csv
    f = flights(spark, sf).select(*C.TIE_KEY, "price")
    path = f"{ensure_checkpoint_dir(spark)}/sample_{uuid.uuid4().hex}"
    export_sample_csv(f, path, 50, 42, C.TIE_KEY)
    return spark.read.schema(f.schema).option("header", True).csv(path)


@register("sorted_by_date", "O1", with_flights(
    f"SELECT {TIE}, date FROM flights"))
def q_sorted(spark, sf):
    return ordering.sort_by_date(flights(spark, sf).select(*C.TIE_KEY, "date"), "date", C.TIE_KEY)
