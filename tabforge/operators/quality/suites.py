"""Suite builders for the three layers (Q15).

Rule lists are built from arguments; the defaults are the booking
layout's contract.
"""

from __future__ import annotations

from . import rules as R

# Fixed values of the booking layout's contract.
RAW_COLUMNS = ["travelCode", "userCode", "from", "to", "flightType", "price", "time",
               "distance", "agency", "date"]
RAW_REQUIRED = ["travelCode", "date"]
RAW_NUMERIC = ["price", "time", "distance", "userCode", "travelCode"]
RAW_NON_NEGATIVE = ["price", "distance", "time"]
RAW_STRING = ["from", "to", "flightType", "agency"]
NUMERIC_TYPES = ["int", "int64", "float", "float64"]
STRING_TYPES = ["object", "str"]
FLIGHT_TYPES = ["economic", "firstClass", "premium"]
FLIGHT_TYPE_MOSTLY = 0.98

SILVER_ORDER = ["travel_code", "user_code", "from_location", "to_location", "flight_type",
                "price", "time", "distance", "agency", "date", "year", "month", "day",
                "day_of_week", "day_of_year", "week_of_year"]
SILVER_REQUIRED = ["from_location", "to_location", "flight_type", "price", "time",
                   "distance", "agency", "date"]
SILVER_KEY = ["user_code", "from_location", "to_location", "date", "time", "agency"]
PRICE_MEAN_RANGE = (100, 5000)


def bronze_suite(columns=RAW_COLUMNS, flight_types=FLIGHT_TYPES, required=RAW_REQUIRED,
                 numeric=RAW_NUMERIC, non_negative=RAW_NON_NEGATIVE, strings=RAW_STRING,
                 type_col="flightType", date_col="date") -> list[R.Rule]:
    rules = [R.columns_match_set(columns), R.row_count_between(1, None)]
    rules += [R.not_null(c) for c in required]
    for c in numeric:
        rules.append(R.type_in(c, NUMERIC_TYPES))
        if c in non_negative:
            rules.append(R.between(c, 0, None))
    rules += [R.type_in(c, STRING_TYPES) for c in strings]
    rules.append(R.matches_date_format(date_col, "%Y-%m-%d"))
    rules.append(R.in_set(type_col, flight_types, mostly=FLIGHT_TYPE_MOSTLY))
    return rules


def silver_suite(order=SILVER_ORDER, types: dict | None = None, required=SILVER_REQUIRED,
                 key=SILVER_KEY, price_range=PRICE_MEAN_RANGE,
                 price_col="price") -> list[R.Rule]:
    rules = [R.columns_match_ordered(order), R.compound_unique(key), R.row_count_between(1, None),
             R.mean_between(price_col, *price_range)]
    for c, t in (types or {}).items():
        rules.append(R.type_in(c, ["category", "CategoricalDtypeType"]) if t == "category"
                     else R.type_is(c, t))
    rules += [R.not_null(c) for c in required]
    return rules


def gold_suite(order, target: str, scaler_strategy: str = "", is_tree_model: bool = True,
               scaled_cols=None, min_rows: int = 10) -> list[R.Rule]:
    rules = [R.columns_match_ordered(order)]
    scaled_cols = list(scaled_cols or [])
    if target not in scaled_cols:
        rules.append(R.between(target, 0, None))
    rules.append(R.row_count_between(min_rows, None))
    rules += [R.type_in(c, NUMERIC_TYPES) for c in order]
    rules += [R.not_null(c) for c in order]
    if not is_tree_model and scaled_cols:
        for c in scaled_cols:
            if scaler_strategy == "standard":
                rules += [R.mean_between(c, -0.2, 0.2), R.stdev_between(c, 0.8, 1.2)]
            elif scaler_strategy == "minmax":
                rules.append(R.between(c, 0, 1.01))
            elif scaler_strategy == "robust":
                rules.append(R.median_between(c, -0.2, 0.2))
    return rules
