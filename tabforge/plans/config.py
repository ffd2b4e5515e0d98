"""Layer configuration.

The first block holds fixed values of the booking layout (names, maps,
periods, strategy choices) that results depend on.  The second block maps
that layout onto the driver's TPC-H-style tables.
"""

# --- fixed values of the booking layout -------------------------------------
COLUMN_RENAME_MAPPING = {"from": "from_location", "to": "to_location"}
TARGET = "price"
GOLD_DROP_COLS = ["travel_code", "user_code", "date", "day_of_year", "week_of_year"]
CYCLICAL_FEATURES_MAP = {"month": 12, "day_of_week": 7, "day": 31}
ENCODING_ORDINAL_COLS = ["from_location", "to_location", "agency", "flight_type"]
GOLD_IMPUTATION = {
    "median": ["price", "time", "distance"],
    "mode": ["agency", "flight_type"],
    "constant": {"from_location": "Unknown", "to_location": "Unknown"},
}
OUTLIER_COLUMNS = ["price", "time", "distance"]
OUTLIER_DETECTION, OUTLIER_HANDLING = "iqr", "trim"
MULTICOLLINEAR_DROP = ["time"]
N_SPLITS = 5

# --- our mapping onto the driver tables --------------------------------------
# flight_type = l_returnflag; its business order economic < premium <
# firstClass maps onto A < N < R.
FLIGHT_TYPE_ORDER = ["A", "N", "R"]
AGENCIES = ["F", "O", "P"]
ENCODING_MAPPING = {"flight_type": FLIGHT_TYPE_ORDER}
TIE_KEY = ["travel_code", "line_number", "part_key", "supp_key"]
RAW_TIE_KEY = ["travelCode", "line_number", "part_key", "supp_key"]
# silver column types our data narrows to (pandas names, as the suite uses)
SILVER_TYPES = {
    "travel_code": "int", "user_code": "int", "from_location": "category",
    "to_location": "category", "flight_type": "category", "agency": "category",
    "price": "float64", "time": "float32", "distance": "float32",
    "date": "datetime64[ns]", "year": "int16", "month": "int8", "day": "int8",
    "day_of_week": "int8", "day_of_year": "int16", "week_of_year": "int32",
}
