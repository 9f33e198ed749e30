"""Money, grades, numbers as text, fingerprints, times and exchange rates as Column builders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import NO_DATA, let
from .vocabulary import KEPT_ATTRIBUTES, PRICE_BANDS


def parse_money(x: Column) -> Column:
    """Number in a price text; null where there is none."""
    digits = F.regexp_replace(F.trim(x), "[^0-9.-]+", "")
    return F.when(F.trim(x).isin(*NO_DATA) | (digits == ""), None).otherwise(digits.try_cast("double"))


def grade_value(x: Column, clean: bool = True) -> Column:
    """Last number of a grade text; AUTH and N0 have none. clean leaves a count in parentheses out (F8)."""
    up = F.upper(F.regexp_replace(x, r"\(\d+\)", "") if clean else x)
    last = F.replace(F.regexp_extract(up, r"(\d+(?:[._]\d+)?)(?:\D*)$", 1), F.lit("_"), F.lit("."))
    return F.when(up.rlike("AUTH|N0"), None).otherwise(F.nullif(last, F.lit("")).try_cast("double"))


def census_count(x: Column) -> Column:
    return F.regexp_extract(x, r"\((\d+)\)", 1).try_cast("long")


def number_text(x: Column) -> Column:
    """A number without a needless fraction: 199, 257.14; null is empty."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.coalesce(F.when(whole, x.cast("decimal(38,0)").cast("string")).otherwise(x.cast("string")), F.lit(""))


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of parts joined by bars; null parts are empty."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def http_class(status: Column) -> Column:
    """success, permanent (other 4xx) or retryable."""
    return F.when(status.between(200, 299), "success").when((status == 429) | ~status.between(400, 499), "retryable").otherwise("permanent")


def rate_age_days(rate_date: Column, now: Column) -> Column:
    """Whole days between a rate's date and now."""
    return F.datediff(now.cast("date"), rate_date)


def compared(guide: Column, bid: Column, currency: Column, rate: Column, usable: Column) -> tuple[Column, Column, Column]:
    """(guide in the bid's currency, discount in per cent, guide in euros): dollars directly, euros through a usable rate (F32)."""
    euros = F.when(bid.isNotNull() & usable & (rate > 0), guide / rate)
    value = F.when(currency == "USD", guide).when(currency == "EUR", euros)
    return value, F.when(value > 0, (value - bid) / value * 100), euros


def gem_rate(tens: Column, total: Column) -> Column:
    """Share of grade ten in per cent; null without a population."""
    return F.when(total > 0, 100.0 * tens / total)


def backoff_seconds(attempts: Column, base: float = 30, most: float = 3600) -> Column:
    """Doubling wait, capped."""
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), F.greatest(attempts - 1, F.lit(0))))


def quota_day(at: Column, hour: int = 7) -> Column:
    """The day whose quota a time counts against; it begins at an hour of the day."""
    return (at - F.make_interval(hours=F.lit(hour))).cast("date")


def strike_end(strikes: Column, at: Column) -> Column:
    """End of the wait after the first strike, the second, and then the next day."""
    return F.when(strikes <= 1, at + F.make_dt_interval(mins=F.lit(30))).when(strikes == 2, at + F.make_dt_interval(mins=F.lit(60))).otherwise(F.date_add(at.cast("date"), 1).cast("timestamp_ntz"))


def next_reset(at: Column, hour: int = 7) -> Column:
    """The next time at which the quota begins anew."""
    return F.date_add(quota_day(at, hour), 1).cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(hour))


def price_band(x: Column, bounds: Sequence[float] = PRICE_BANDS) -> Column:
    """Number of the band, from 0; a band holds its upper end and begins a cent above the one before."""
    out = F.when(x <= bounds[0], 0)
    for i, b in enumerate(bounds[1:], 1):
        out = out.when(x <= b, i)
    return out.when(x.isNotNull(), len(bounds)).cast("int")


def split_range(low: float = 0, high: float | None = None) -> list[tuple[float, float | None]]:
    """The fixed bands of the whole range; two parts of another one, the second a cent above the first."""
    if high is None and low == 0:
        starts = [0, *(b + 0.01 for b in PRICE_BANDS)]
        return list(zip(starts, [*PRICE_BANDS, None], strict=True))
    middle = max(low * 2, low + 5000) if high is None else round((low + high) / 2, 2)
    if high is not None and middle <= low:
        raise ValueError(f"prices from {low} to {high} cannot be parted further")
    return [(low, middle), (middle + 0.01, high)]


def duration_minutes(x: Column) -> Column:
    """Minutes of 20m, 2h, 1d or a bare number of minutes, at least one; null for anything else."""
    pattern = r"(?i)^(\d+(?:\.\d+)?)\s*(m|min|h|hr|d|day)?s?$"
    n, unit = F.regexp_extract(F.trim(x), pattern, 1).try_cast("double"), F.lower(F.regexp_extract(F.trim(x), pattern, 2))
    factor = F.when(unit.startswith("d"), 1440).when(unit.startswith("h"), 60).otherwise(1)
    return F.when(n.isNotNull(), F.greatest(F.lit(1).cast("long"), F.floor(n * factor + 0.5)))


def ending_hours(x: Column) -> Column:
    """Whole hours of a duration, at least one; null for none, off and 0."""
    minutes = duration_minutes(x)
    return F.when(~F.trim(x).rlike("(?i)^(none|off|0)$") & minutes.isNotNull(), F.greatest(F.lit(1).cast("long"), F.floor(minutes / 60 + 0.5)))


def is_fresh(fetched: Column, now: Column, most_minutes: int | None) -> Column:
    """Younger than an age; everything is fresh without one, and what has no date is not."""
    return F.lit(True) if most_minutes is None else F.coalesce(now - F.make_dt_interval(mins=F.lit(most_minutes)) < fetched, F.lit(False))


def safe_text(x: Column) -> Column:
    return x.cast("string")


def safe_number(x: Column) -> Column:
    """A number out of a text; empty and unreadable are null."""
    return F.nullif(F.trim(x.cast("string")), F.lit("")).try_cast("double")


def safe_integer(x: Column) -> Column:
    """A whole number, zero where there is none."""
    return F.coalesce(F.trim(x.cast("string")).try_cast("double").try_cast("long"), F.lit(0).cast("long"))


def safe_object(x: Column) -> Column:
    """A JSON object as a map of texts; anything else is the empty map."""
    return F.coalesce(F.when(F.ltrim(x).startswith("{"), F.from_json(x, "map<string,string>")), F.expr("map_from_arrays(cast(array() as array<string>), cast(array() as array<string>))"))


def safe_strings(x: Column) -> Column:
    """A JSON array as texts; anything else is the empty array."""
    return F.coalesce(F.when(F.ltrim(x).startswith("["), F.from_json(x, "array<string>")), F.expr("cast(array() as array<string>)"))


def kept_attributes(x: Column, keys: Sequence[str] = KEPT_ATTRIBUTES) -> Column:
    """The entries of a map that are kept."""
    return F.map_filter(x, lambda k, v: k.isin(*keys) & v.isNotNull())


def or_unknown(x: Column) -> Column:
    """A missing attribute is unknown (P10)."""
    return F.coalesce(x, F.lit("unknown"))


def guide_rows(summary: Column) -> Column:
    """Grade metrics as rows of texts; a grade without metrics has none, and the average stands for the guide price.

    summary: array of (grade, metrics (latestPrice, averagePrice)).
    """
    text = lambda x: F.coalesce(number_text(x), F.lit(""))
    graded = F.filter(summary, lambda g: g.isNotNull() & g["metrics"].isNotNull())
    return F.transform(graded, lambda g: F.struct(g["grade"].cast("string").alias("gradeText"), text(g["metrics"]["latestPrice"]).alias("mostRecentText"), text(g["metrics"]["averagePrice"]).alias("averageText"), text(g["metrics"]["averagePrice"]).alias("psaPriceText")))


def json_set(x: Column, path: str, value: Column) -> Column:
    """x, a text of JSON, with the member at a path of names ($.a.b) set to value (F29). Objects that the path lacks are made; members stand by name, as VARIANT keeps them.

    Null for null or broken texts; a text that is no object, and a path through something that is none, stays as it is.
    """
    names = path.removeprefix("$").strip(".").split(".")
    empty = F.create_map().cast("map<string,variant>")

    # whatever is used more than once is bound, as it would be computed as often otherwise
    def put(members: Column, rest: list[str]) -> Column:
        name = F.lit(rest[0])

        def told(m: Column) -> Column:
            if len(rest) == 1:
                return value.cast("variant")
            held = F.try_element_at(m, name)
            below = lambda x: put(F.coalesce(x["inside"], empty), rest[1:])
            return let(F.struct(held.alias("held"), held.try_cast("map<string,variant>").alias("inside")), lambda x: F.when(x["held"].isNotNull() & x["inside"].isNull(), x["held"]).otherwise(F.to_variant_object(below(x))))

        def set_(x: Column) -> Column:
            changed = F.transform_values(x["m"], lambda k, v: F.when(k == name, x["told"]).otherwise(v))
            return F.when(F.map_contains_key(x["m"], name), changed).otherwise(F.map_concat(x["m"], F.create_map(name, x["told"])))

        return let(members, lambda m: let(F.struct(m.alias("m"), told(m).alias("told")), set_))

    def rewritten(x: Column, parsed: Column) -> Column:
        return let(parsed.try_cast("map<string,variant>"), lambda whole: F.when(whole.isNotNull(), F.to_json(put(whole, names))).when(parsed.isNotNull(), x))

    return let(x, lambda text: let(F.try_parse_json(text), lambda parsed: rewritten(text, parsed)))


def json_each(df: DataFrame, column: str, keep: Sequence[str], path: str = "$") -> DataFrame:
    """One row for each member of the array or object at a path of a column's JSON: the kept columns, at, key (null in arrays), value as JSON (F29). No schema is needed; texts without such give no rows."""
    inside = F.try_variant_get(F.try_parse_json(F.col(column)), path, "variant")
    rows = df.select(*keep, inside.alias("inside")).where("inside is not null")
    return rows.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("inside").outer())).select(*keep, F.col("pos").alias("at"), "key", F.to_json("value").alias("value"))
