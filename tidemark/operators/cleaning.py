"""Cleaning, deduplication, calendars and date mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.stats import ticker_name


def existing(df: DataFrame, columns: list[str]) -> DataFrame:
    """Those of the columns that df has."""
    return df.select([c for c in columns if c in df.columns])


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a stated order."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def standard_prices(raw: DataFrame, order: list) -> DataFrame:
    """Tolerant casts of raw price rows; rows without date or close go, the first of each ticker and date stays."""
    number = lambda c: F.nanvl(F.expr(f"try_cast(`{c}` as double)"), F.lit(None).cast("double"))
    lower = raw.toDF(*[c.lower() for c in raw.columns])
    numeric = [c for c in ("open", "high", "low", "close", "volume") if c in lower.columns]
    out = lower.withColumns({c: number(c) for c in numeric} | {"date": F.try_to_timestamp(F.col("date").cast("string")).cast("date"), "ticker": ticker_name("ticker")})
    return first_of(out.where("date is not null and close is not null"), ["ticker", "date"], order)


def in_both(left: DataFrame, right: DataFrame, key: str, without: str) -> DataFrame:
    """Distinct keys of both sides but for one value."""
    return left.select(key).distinct().join(right.select(key), key, "left_semi").where(F.col(key) != without)


def filings_of(submissions: DataFrame, most: int, forms: list[str]) -> DataFrame:
    """One row for each filing: the first `most` of the shortest list, then those of the wanted forms."""
    r = "filings.recent"
    lists = [F.coalesce(F.col(f"{r}.{c}"), F.array().cast("array<string>")) for c in ("form", "accessionNumber", "acceptanceDateTime")]
    n = F.least(*(F.size(x) for x in lists), F.lit(most))
    zipped = F.slice(F.arrays_zip(*(x.alias(c) for x, c in zip(lists, ("form", "accession", "accepted")))), F.lit(1), n)
    return submissions.select("cik", F.explode(zipped).alias("f")).select("cik", "f.*").where(F.col("form").isin(forms))


def first_rows(rows: DataFrame, key: str, order: str, most: int, parts: int = 32) -> DataFrame:
    """The first `most` rows of each key by order; parts of a key are cut first, so no task ranks a whole large key."""
    part = F.pmod(F.xxhash64(order), F.lit(parts))
    cut = rows.withColumn("_i", F.row_number().over(W.partitionBy(key, part).orderBy(order))).where(F.col("_i") <= most)
    return cut.withColumn("_i", F.row_number().over(W.partitionBy(key).orderBy(order))).where(F.col("_i") <= most).drop("_i")


def sessions(dates: DataFrame, column: str = "date") -> DataFrame:
    """(date, pos) of distinct dates in order; as many rows as there are days."""
    return dates.select(F.col(column).alias("date")).where("date is not null").distinct().withColumn("pos", F.row_number().over(W.orderBy("date")) - 1)


def next_session(dates: DataFrame, calendar: DataFrame) -> DataFrame:
    """(d, pos) of each distinct date d: the first session on or after it, null past the end.

    Days and sessions are sorted together, so that no range join is needed.
    """
    both = dates.select(F.col(dates.columns[0]).alias("d")).where("d is not null").distinct().withColumn("pos", F.lit(None).cast("int")).withColumn("own", F.lit(1))
    both = both.unionByName(calendar.select(F.col("date").alias("d"), "pos", F.lit(0).alias("own")))
    ahead = W.orderBy("d", F.desc("own")).rowsBetween(0, W.unboundedFollowing)
    return both.withColumn("pos", F.first("pos", ignorenulls=True).over(ahead)).where("own = 1").drop("own")


def easter(year: int) -> tuple[int, int]:
    """Month and day of Easter Sunday, by the anonymous Gregorian rule."""
    a, (b, c) = year % 19, divmod(year, 100)
    h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    k = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
    m = (a + 11 * h + 22 * k) // 451
    return divmod(h + k - 7 * m + 114, 31)[0], (h + k - 7 * m + 114) % 31 + 1


def exchange_holidays(year: int) -> set:
    """Holidays of the New York exchange by its public rules."""
    from datetime import date, timedelta

    def nth(month: int, weekday: int, n: int) -> date:
        first = date(year, month, 1)
        return first + timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))

    def observed(day: date) -> date:
        return day - timedelta(1) if day.weekday() == 5 else day + timedelta(1) if day.weekday() == 6 else day

    month, day = easter(year)
    last_may = date(year, 5, 31)
    out = {nth(2, 0, 3), date(year, month, day) - timedelta(2), last_may - timedelta(last_may.weekday()), observed(date(year, 7, 4)), nth(9, 0, 1), nth(11, 3, 4), observed(date(year, 12, 25))}
    if date(year, 1, 1).weekday() != 5:
        out.add(observed(date(year, 1, 1)))
    if year >= 1998:
        out.add(nth(1, 0, 3))
    if year >= 2022:
        out.add(observed(date(year, 6, 19)))
    # Closures outside the rules.
    once = ["1994-04-27", "2001-09-11", "2001-09-12", "2001-09-13", "2001-09-14", "2004-06-11", "2007-01-02", "2012-10-29", "2012-10-30", "2018-12-05", "2025-01-09"]
    return out | {d for d in map(date.fromisoformat, once) if d.year == year}


def exchange_calendar(spark: SparkSession, first: int, last: int) -> DataFrame:
    """(date, pos) of all sessions of the years first to last."""
    closed = spark.createDataFrame([(d,) for y in range(first, last + 1) for d in sorted(exchange_holidays(y))], "date date")
    days = spark.range(1).select(F.explode(F.sequence(F.make_date(F.lit(first), F.lit(1), F.lit(1)), F.make_date(F.lit(last), F.lit(12), F.lit(31)))).alias("date"))
    return sessions(days.where(F.weekday("date") < 5).join(closed, "date", "left_anti"))


def effective_dates(events: DataFrame, calendar: DataFrame, et: str, bucket: str, within: int = 14) -> DataFrame:
    """events with effective_date: the session on or after the day before the open, the one after that session otherwise.

    Null where the calendar has no session within so many days, and where the time is null.
    """
    day = F.to_date(et)
    base = next_session(events.select(day.alias("d")), calendar)
    near = calendar.select("pos", F.col("date").alias("_near"))
    base = base.join(near, "pos").where(F.datediff("_near", "d") <= within).select("d", "pos")
    shift = (F.lower(F.trim(F.coalesce(bucket, F.lit("")))) != "premarket").cast("int")
    out = events.withColumn("_d", day).join(base.withColumnRenamed("d", "_d"), "_d", "left").withColumn("_pos", F.col("pos") + shift).drop("pos")
    at = calendar.select(F.col("pos").alias("_pos"), F.col("date").alias("effective_date"))
    return out.join(at, "_pos", "left").drop("_pos", "_d")
