"""Timestamps in mixed formats and zones to one instant each, through a dictionary.

Raw strings are deduplicated with their source and the zone that counts for them
into a dictionary of distinct values, which is parsed once, kept as Parquet and
only ever extended by values it has not seen; instants are joined back to the
rows.

Readings. Text without a zone is wall clock in the zone given beside it, UTC if
none. A wall clock that occurs twice is its first occurrence, a skipped one is
read with the offset valid before the change. Slashed dates have the day first.
Two-digit years from 80 are 19xx, others 20xx. Plain numbers of 8-10, 12-13 and
15-16 digits count seconds, milliseconds and microseconds since 1970, 14 digits
are a written-out date and time, & and ten hexadecimal digits hundredths of a
second since 1900. Text that names no possible instant, or an unknown zone,
gives null.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CANONICAL = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\+00:00$"

# Minutes east of Greenwich that an abbreviation stands for.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "UT": 0, "GMT": 0, "WET": 0, "BST": 60, "WEST": 60, "CET": 60, "MET": 60, "CEST": 120, "MEST": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "JST": 540, "KST": 540, "AWST": 480, "ACST": 570, "ACDT": 630,
    "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240,
    "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_MON = r"(?i:(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)(?:uary|ruary|ch|il|e|y|ust|t|tember|ober|ember)?\.?)"
_DOW = r"(?i:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*)"
_TIME = r"([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:[.,]([0-9]+))?)?(?: ?([AaPp])\.?[Mm]\.?)?"
_ZONE = r"(?: ?(Z|[A-Za-z]{2,5}|(?:UTC|GMT)?[+-][0-9]{2}(?::?[0-9]{2})?))?(?: ?\[([A-Za-z0-9_+/-]+)\])?(?: ?\([A-Za-z ]*\))?"
#: Each form and where its groups stand in year|month|day|hour|minute|second|fraction|half of day|zone|region.
FORMS = (
    (rf"^([0-9]{{4}})[-./]([0-9]{{1,2}})[-./]([0-9]{{1,2}})(?:[Tt ] *{_TIME})?{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7|$8|$9|$10"),
    (rf"^([0-9]{{1,2}})-{_MON}-([0-9]{{4}}|[0-9]{{2}})(?:,? {_TIME})?{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8|$9|$10"),
    (rf"^([0-9]{{1,2}})/([0-9]{{1,2}})/([0-9]{{4}}|[0-9]{{2}})(?:,? {_TIME})?{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8|$9|$10"),
    (rf"^{_TIME}{_ZONE},? ([0-9]{{1,2}})[- ]{_MON}[- ]([0-9]{{4}}|[0-9]{{2}})$", "$10|$9|$8|$1|$2|$3|$4|$5|$6|$7"),
    (rf"^(?:{_DOW},? )?{_MON} +([0-9]{{1,2}}),? +([0-9]{{4}})(?:,? +{_TIME})?{_ZONE}$", "$3|$1|$2|$4|$5|$6|$7|$8|$9|$10"),
    (rf"^(?:{_DOW},? +)?([0-9]{{1,2}}) +{_MON},? +([0-9]{{4}}|[0-9]{{2}})(?:,? +{_TIME})?{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8|$9|$10"),
    (rf"^{_DOW},? {_MON} +([0-9]{{1,2}}) {_TIME}{_ZONE} ([0-9]{{4}})$", "$10|$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    (r"^([0-9]{4})([0-9]{2})([0-9]{2})T([0-9]{2})([0-9]{2})(?:([0-9]{2})(?:[.,]([0-9]+))?)?" + _ZONE + "$", "$1|$2|$3|$4|$5|$6|$7||$8|$9"),
    (r"^([0-9]{4})([0-9]{2})([0-9]{2})([0-9]{2})([0-9]{2})([0-9]{2})$", "$1|$2|$3|$4|$5|$6||||"),
)
_NUMBER = r"^([0-9]+)(?:\.([0-9]+))?$"
_ACORN = "^&([0-9A-Fa-f]{10})$"


def zones(spark: SparkSession) -> list[str]:
    """The zone names that the JVM knows."""
    return sorted(spark.sparkContext._jvm.java.util.ArrayList(spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds()))


def _lookup(table: dict[str, int], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def _days(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970-01-01 in the Gregorian calendar, by counting from March."""
    y = year - F.when(month <= 2, 1).otherwise(0)
    era = F.floor(y / 400)
    of_era = y - era * 400
    of_year = F.floor((F.lit(153) * (month + F.when(month > 2, -3).otherwise(9)) + 2) / 5) + day - 1
    return era * 146097 + of_era * 365 + F.floor(of_era / 4) - F.floor(of_era / 100) + of_year - 719468


def _wall(wall: Column, zone: Column) -> Column:
    """The instant of a wall clock in microseconds; overlaps and gaps as java.time resolves them."""
    return F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(wall), zone))


def _parts(text: Column) -> Column:
    """text in the one form that its first characters allow: a form costs a search, so few are tried."""
    first, second, third = (F.substring(text, i, 1) for i in (1, 2, 3))

    def early(c: str) -> Column:
        return (second == c) | (third == c)

    def form(*numbers: int) -> Column:
        return reduce(lambda c, n: F.regexp_replace(c, *FORMS[n]), numbers, text)

    return (
        F.when(F.upper(first).between("A", "Z"), form(4, 5, 6))
        .when(early("-"), form(1))
        .when(early("/"), form(2))
        .when(early(":"), form(3))
        .when(early(" "), form(5))
        .when(F.substring(text, 5, 1).isin("-", ".", "/"), form(0))
        .when(F.substring(text, 9, 1) == "T", form(7))
        .otherwise(form(8))
    )


def parse_instants(values: DataFrame, known: list[str]) -> DataFrame:
    """Add utc_us, microseconds since 1970 UTC that raw names, to a table of raw and zone.

    zone is the zone of wall clocks without any; known are the zone names that
    exist. Each stage is a projection of its own, so that the forms are matched
    once per value and not once per part of the date.
    """
    text = F.trim("raw")
    split = values.withColumn("__text", text).withColumn("__parts", F.split(_parts(text), r"\|", -1))

    def part(i: int) -> Column:
        return F.get("__parts", F.lit(i))

    def number(i: int) -> Column:
        return part(i).try_cast("int")

    year = number(0)
    hours = F.coalesce(number(3), F.lit(0))
    half, sign = F.upper(part(7)), F.upper(part(8))
    digits = F.regexp_replace(sign, "[^0-9]", "")
    beside = F.coalesce(F.nullif(F.trim("zone"), F.lit("")), F.lit("UTC"))
    staged = split.select(
        *values.columns,
        "__text",
        (F.size("__parts") == 10).alias("__matched"),
        F.when(F.length(part(0)) == 2, year + F.when(year >= 80, 1900).otherwise(2000)).otherwise(year).alias("__y"),
        F.coalesce(number(1), _lookup({m: i + 1 for i, m in enumerate(MONTHS)}, F.lower(part(1)))).alias("__mo"),
        number(2).alias("__d"),
        F.when(half == "", hours).when(hours.between(1, 12), hours % 12 + F.when(half == "P", 12).otherwise(0)).alias("__h"),
        F.coalesce(number(4), F.lit(0)).alias("__mi"),
        F.coalesce(number(5), F.lit(0)).alias("__s"),
        F.rpad(F.substring(part(6), 1, 6), 6, "0").try_cast("long").alias("__us"),
        sign.alias("__sign"),
        (digits != "").alias("__numeric"),
        F.substring(digits, 1, 2).try_cast("int").alias("__zh"),
        F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0)).alias("__zm"),
        F.when(part(9) != "", part(9)).otherwise(beside).alias("__place"),
        F.regexp_extract("__text", _NUMBER, 1).alias("__whole"),
        F.rpad(F.regexp_extract("__text", _NUMBER, 2), 6, "0").alias("__rest"),
    )
    y, mo, d = F.col("__y"), F.col("__mo"), F.col("__d")
    last = F.when(mo.isin(4, 6, 9, 11), 30).when(mo == 2, F.when((y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0)), 29).otherwise(28)).otherwise(31)
    possible = F.col("__matched") & y.between(1, 9999) & mo.between(1, 12) & (d >= 1) & (d <= last) & F.col("__h").between(0, 23) & (F.col("__mi") <= 59) & (F.col("__s") <= 59)
    clock = (_days(y, mo, d).cast("long") * 86400 + F.col("__h") * 3600 + F.col("__mi") * 60 + F.col("__s")) * 1_000_000 + F.col("__us")
    minutes = F.col("__zh") * 60 + F.col("__zm")
    offset = F.when(F.col("__numeric"), F.when((minutes <= 18 * 60) & (F.col("__zm") < 60), F.when(F.col("__sign").contains("-"), -minutes).otherwise(minutes))).otherwise(_lookup(ABBREVIATIONS, F.col("__sign")))
    place = F.when(F.col("__place").isin(known) | F.col("__place").rlike(r"^[+-][0-9]{2}:[0-9]{2}$"), F.col("__place"))
    clocked = staged.withColumns({"__clock": F.when(possible, clock), "__offset": offset, "__place": place})

    named = F.when(F.col("__sign") != "", F.col("__clock") - F.col("__offset").cast("long") * 60_000_000).otherwise(F.when(F.col("__place").isNotNull(), _wall(F.col("__clock"), F.coalesce("__place", F.lit("UTC")))))
    width, count = F.length("__whole"), F.col("__whole").try_cast("long")
    counted = (
        F.when(width.between(8, 10), count * 1_000_000 + F.substring("__rest", 1, 6).try_cast("long"))
        .when(width.between(12, 13), count * 1000 + F.substring("__rest", 1, 3).try_cast("long"))
        .when(width.between(15, 16), count)
    )
    acorn = F.conv(F.regexp_extract("__text", _ACORN, 1), 16, 10).try_cast("long") * 10_000 - 2_208_988_800_000_000
    us = F.when(F.col("__text").startswith("&"), F.when(F.col("__text").rlike(_ACORN), acorn)).when((width > 0) & (width != 14), counted).otherwise(named)
    return clocked.select(*values.columns, us.alias("utc_us"))


def needs_zone(raw: Column) -> Column:
    """Whether the zone beside the text may count: not for numbers, & stamps and text with a zone of its own."""
    text = F.trim(raw)
    return ~(text.startswith("&") | (text.rlike(r"^[0-9]+(\.[0-9]+)?$") & (F.length(text) != 14)) | text.rlike(r"([0-9]Z|:[0-9.,]+ ?[+-][0-9:]+(\[.*\])?|\])$"))


KEYS = ["raw", "source", "zone"]


class InstantDictionary:
    """Distinct (raw, source, zone) values and their instants in a folder, extended as new values come.

    Each extension is a folder of its own that gets its name only when it is
    whole, so a reader never sees half of one and writers don't disturb each
    other. Values that two writers added at once come out once.
    """

    SCHEMA = "raw string, source string, zone string, utc_us long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._files = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def extensions(self) -> list[str]:
        """Folders of the extensions."""
        return sorted(str(status.getPath()) for status in self._files.globStatus(self._path("part-*")) or [])

    def read(self) -> DataFrame:
        parts = self.extensions()
        if not parts:
            return self.spark.createDataFrame([], self.SCHEMA)
        found = self.spark.read.schema(self.SCHEMA).parquet(*parts)
        return found.dropDuplicates(KEYS) if len(parts) > 1 else found

    def extend(self, values: DataFrame) -> DataFrame:
        """Parse the (raw, source, zone) of values that are not in the dictionary yet, add them, and give it whole."""
        fresh = values.select(*KEYS).dropDuplicates(KEYS)
        if self.extensions():
            fresh = fresh.join(self.read(), KEYS, "left_anti")
        name = uuid.uuid4().hex
        parse_instants(fresh, zones(self.spark)).write.parquet(f"{self.path}/new-{name}")
        if self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/new-{name}").isEmpty():
            self._files.delete(self._path(f"new-{name}"), True)
        else:
            self._files.rename(self._path(f"new-{name}"), self._path(f"part-{name}"))
        return self.read()


def normalise(rows: DataFrame, raw: str, zone: str, dictionary: InstantDictionary, source: str | None = None) -> DataFrame:
    """rows with the column utc_us, through the dictionary; null text gives null.

    raw and zone name text columns; a null zone is UTC. source names the column
    that tells where a text comes from, if any. A utc_us that rows already have
    is replaced. A hot text is one row of the dictionary, so adaptive execution
    can split its rows over many tasks.
    """
    where = F.coalesce(F.col(source).cast("string"), F.lit("")) if source else F.lit("")
    keyed = rows.drop("utc_us").withColumns({"__raw": F.col(raw), "__source": where, "__zone": F.when(needs_zone(F.col(raw)), F.coalesce(F.col(zone), F.lit(""))).otherwise("")})
    wanted = keyed.where("__raw IS NOT NULL").select(F.col("__raw").alias("raw"), F.col("__source").alias("source"), F.col("__zone").alias("zone"))
    known = dictionary.extend(wanted).select(*(F.col(k).alias(f"__{k}") for k in KEYS), "utc_us")
    return keyed.join(known, [f"__{k}" for k in KEYS], "left").drop(*(f"__{k}" for k in KEYS))
