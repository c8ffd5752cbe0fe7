"""Small dimension tables. Fixed values that results depend on are stated here as plain text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- fixed values -------------------------------------------------------------------------------------------------

WEATHER = ("temperature", "humidity", "precipitation", "cloud_cover", "wind_speed_10m", "direct_radiation")

# Load share in percent of each distribution circle.
CIRCLE_SHARE_PCT = {
    "GURUGRAM": 16.68, "FARIDABAD": 10.24, "HISAR": 7.04, "SONIPAT": 6.32, "BHIWANI": 5.53, "KARNAL": 5.19,
    "ROHTAK": 4.96, "REWARI": 3.95, "JHAJJAR": 3.71, "PANIPAT": 3.64, "JIND": 3.45, "PALWAL": 3.04,
    "KURUSHETRA": 2.99, "YAMUNANAGAR": 2.91, "SIRSA": 2.76, "NUH": 2.50, "PANCHKULA": 2.27, "KAITHAL": 2.22,
    "AMBALA": 2.00, "NARNAUL": 1.87, "FATEHABAD": 0.09,
}

# District names whose circle carries another name.
CIRCLE_OF_DISTRICT = {"KURUKSHETRA": "KURUSHETRA", "MAHENDRAGARH": "NARNAUL"}

# Spellings seen in feeds -> canonical district.
DISTRICT_ALIASES = {
    "GURGAON": "GURUGRAM", "KURUSHETRA": "KURUKSHETRA", "NARNAUL": "MAHENDRAGARH", "MEWAT": "NUH",
    "SONEPAT": "SONIPAT", "YAMUNA NAGAR": "YAMUNANAGAR", "HISSAR": "HISAR",
}

# Month and day of the fixed national holidays.
NATIONAL_DAYS = ((1, 26), (8, 15), (10, 2))
# Years for which national days are laid out: a rule, so a wide range costs a few hundred rows.
YEARS = (1900, 2200)

# --- dimension frames ---------------------------------------------------------------------------------------------


def holidays(spark: SparkSession, extra: tuple[str, ...] = (), years: tuple[int, int] = YEARS) -> DataFrame:
    """Holiday dates, one row each: the national days of all years, and those the caller adds (of a state or a year)."""
    days = ", ".join(f"make_date(y, {m}, {d})" for m, d in NATIONAL_DAYS)
    national = f"SELECT explode(array({days})) AS holiday FROM (SELECT explode(sequence({years[0]}, {years[1] - 1})) AS y)"
    more = "".join(f" UNION SELECT DATE'{d}'" for d in extra)
    return spark.sql(national + more)


def canonical_weights(spark: SparkSession) -> DataFrame:
    """District -> circle -> load share (21 rows)."""
    back = {c: d for d, c in CIRCLE_OF_DISTRICT.items()}
    rows = ", ".join(f"('{back.get(c, c)}', '{c}', CAST({w} AS DOUBLE))" for c, w in CIRCLE_SHARE_PCT.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS w(district, circle, share_pct)")


def values_frame(spark: SparkSession, columns: str, rows: str) -> DataFrame:
    """Literal dimension from SQL VALUES text."""
    return spark.sql(f"SELECT * FROM VALUES {rows} AS v({columns})")
