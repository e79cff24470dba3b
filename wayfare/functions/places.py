"""Airports and airlines: what codes stand for, as broadcast joins against small tables.

The tables here hold the busiest ones; a complete one is given as a DataFrame of the same columns. Unknown codes
stay as they are, with nulls beside them: a wrong city is worse than none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scalars import offset_minutes

# -- fixed values: public codes ----------------------------------------------------------------------------------
AIRPORTS = """
AMS Amsterdam Europe/Amsterdam|ARN Stockholm Europe/Stockholm|ATH Athens Europe/Athens|ATL Atlanta America/New_York|AUH Abu_Dhabi Asia/Dubai|BCN Barcelona Europe/Madrid|BKK Bangkok Asia/Bangkok
BLR Bengaluru Asia/Kolkata|BOM Mumbai Asia/Kolkata|BOS Boston America/New_York|BRU Brussels Europe/Brussels|CAI Cairo Africa/Cairo|CAN Guangzhou Asia/Shanghai|CCU Kolkata Asia/Kolkata
CDG Paris Europe/Paris|CGK Jakarta Asia/Jakarta|CLT Charlotte America/New_York|CMB Colombo Asia/Colombo|COK Kochi Asia/Kolkata|CPH Copenhagen Europe/Copenhagen|CPT Cape_Town Africa/Johannesburg
DEL Delhi Asia/Kolkata|DEN Denver America/Denver|DFW Dallas America/Chicago|DOH Doha Asia/Qatar|DPS Denpasar Asia/Makassar|DUB Dublin Europe/Dublin|DXB Dubai Asia/Dubai
EWR Newark America/New_York|EZE Buenos_Aires America/Argentina/Buenos_Aires|FCO Rome Europe/Rome|FRA Frankfurt Europe/Berlin|GIG Rio_de_Janeiro America/Sao_Paulo|GOI Goa Asia/Kolkata|GRU Sao_Paulo America/Sao_Paulo
GVA Geneva Europe/Zurich|HAN Hanoi Asia/Ho_Chi_Minh|HEL Helsinki Europe/Helsinki|HKG Hong_Kong Asia/Hong_Kong|HND Tokyo Asia/Tokyo|HNL Honolulu Pacific/Honolulu|HYD Hyderabad Asia/Kolkata
IAD Washington America/New_York|IAH Houston America/Chicago|ICN Seoul Asia/Seoul|IST Istanbul Europe/Istanbul|IXE Mangaluru Asia/Kolkata|JED Jeddah Asia/Riyadh|JFK New_York America/New_York
JNB Johannesburg Africa/Johannesburg|KUL Kuala_Lumpur Asia/Kuala_Lumpur|LAS Las_Vegas America/Los_Angeles|LAX Los_Angeles America/Los_Angeles|LGW London Europe/London|LHR London Europe/London|LIS Lisbon Europe/Lisbon
LOS Lagos Africa/Lagos|MAA Chennai Asia/Kolkata|MAD Madrid Europe/Madrid|MAN Manchester Europe/London|MEL Melbourne Australia/Melbourne|MEX Mexico_City America/Mexico_City|MIA Miami America/New_York
MNL Manila Asia/Manila|MUC Munich Europe/Berlin|MXP Milan Europe/Rome|NBO Nairobi Africa/Nairobi|NRT Tokyo Asia/Tokyo|ORD Chicago America/Chicago|OSL Oslo Europe/Oslo
PEK Beijing Asia/Shanghai|PER Perth Australia/Perth|PHX Phoenix America/Phoenix|PNQ Pune Asia/Kolkata|PVG Shanghai Asia/Shanghai|RUH Riyadh Asia/Riyadh|SEA Seattle America/Los_Angeles
SFO San_Francisco America/Los_Angeles|SGN Ho_Chi_Minh_City Asia/Ho_Chi_Minh|SIN Singapore Asia/Singapore|SYD Sydney Australia/Sydney|TPE Taipei Asia/Taipei|VIE Vienna Europe/Vienna|WAW Warsaw Europe/Warsaw
YUL Montreal America/Toronto|YVR Vancouver America/Vancouver|YYZ Toronto America/Toronto|ZRH Zurich Europe/Zurich
"""
AIRLINES = """
6E IndiGo|AA American_Airlines|AC Air_Canada|AF Air_France|AI Air_India|AK AirAsia|AY Finnair|AZ ITA_Airways|BA British_Airways|CA Air_China|CX Cathay_Pacific|DL Delta_Air_Lines|EK Emirates|ET Ethiopian_Airlines|EY Etihad_Airways
FR Ryanair|IB Iberia|IX Air_India_Express|JL Japan_Airlines|KE Korean_Air|KL KLM|LH Lufthansa|LX Swiss|MH Malaysia_Airlines|NH All_Nippon_Airways|OS Austrian_Airlines|QF Qantas|QP Akasa_Air|QR Qatar_Airways
SG SpiceJet|SK SAS|SQ Singapore_Airlines|SV Saudia|TG Thai_Airways|TK Turkish_Airlines|TP TAP_Air_Portugal|U2 easyJet|UA United_Airlines|UK Vistara|UL SriLankan_Airlines|VN Vietnam_Airlines|WN Southwest_Airlines
"""
# ----------------------------------------------------------------------------------------------------------------


def _entries(text: str, columns: int) -> list[tuple[str, ...]]:
    rows = [x.strip().split(" ") for line in text.strip().split("\n") for x in line.split("|")]
    return [tuple(x.replace("_", " ") if k == 1 else x for k, x in enumerate(r)) for r in rows if len(r) == columns]


def airport_entries() -> list[tuple[str, ...]]:
    return _entries(AIRPORTS, 3)


def airline_entries() -> list[tuple[str, ...]]:
    return _entries(AIRLINES, 2)


def airports(spark: SparkSession) -> DataFrame:
    """(code, city, zone) of the busiest airports."""
    return spark.createDataFrame(airport_entries(), "code string, city string, zone string")


def airlines(spark: SparkSession) -> DataFrame:
    """(code, airline) of the largest airlines."""
    return spark.createDataFrame(airline_entries(), "code string, airline string")


#: Rows of a reference table up to which it is broadcast.
BROADCAST_ROWS = 100_000


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def with_airport(rows: DataFrame, code: str, prefix: str = "", table: DataFrame | None = None) -> DataFrame:
    """rows, all kept, with ``<prefix>city`` and ``<prefix>zone`` of an airport code; nulls where it is unknown."""
    known = (airports(rows.sparkSession) if table is None else table).dropDuplicates(["code"]).select(F.col("code").alias("_code"), F.col("city").alias(prefix + "city"), F.col("zone").alias(prefix + "zone"))
    return rows.join(_small(known), F.upper(F.trim(F.col(code))) == F.col("_code"), "left").drop("_code")


def with_airline(rows: DataFrame, carrier: str, table: DataFrame | None = None) -> DataFrame:
    """rows, all kept, with the ``airline`` of a carrier code; the code itself where it is unknown."""
    known = (airlines(rows.sparkSession) if table is None else table).dropDuplicates(["code"]).select(F.col("code").alias("_code"), F.col("airline").alias("_airline"))
    joined = rows.join(_small(known), F.upper(F.trim(F.col(carrier))) == F.col("_code"), "left")
    return joined.withColumn("airline", F.coalesce("_airline", F.col(carrier))).drop("_code", "_airline")


def known_airports(rows: DataFrame, code: str, table: DataFrame | None = None) -> DataFrame:
    """The rows whose code is one of an airport."""
    known = (airports(rows.sparkSession) if table is None else table).select(F.col("code").alias("_code"))
    return rows.join(_small(known), F.upper(F.trim(F.col(code))) == F.col("_code"), "left_semi")


def airport_cities(rows: DataFrame, name: str, table: DataFrame | None = None) -> DataFrame:
    """The rows whose text is the name of an airport's city, whatever its case: such a one is no person."""
    known = (airports(rows.sparkSession) if table is None else table).select(F.lower("city").alias("_city")).distinct()
    return rows.join(_small(known), (F.lower(F.trim(F.col(name))) == F.col("_city")) & (F.length(F.trim(F.col(name))) >= 3), "left_semi")


def zone_offset(date: Column, time: Column, zone: Column) -> Column:
    """Minutes ahead of UTC of a zone at a local date and time; null where one of date and zone is unknown."""
    local = F.try_to_timestamp(F.concat(date.cast("string"), F.lit(" "), F.coalesce(time, F.lit("12:00"))), F.lit("yyyy-MM-dd HH:mm"))
    return F.when(zone.isNotNull(), offset_minutes(F.to_utc_timestamp(local, zone), zone))
