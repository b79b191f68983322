"""Calendar, season, weather and event rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from headroom import fixed_values as fixed
from headroom.functions.lookup import by_band, by_index, record_by_name


def hour(ds: Column) -> Column:
    return F.hour(ds)


def day_of_week(ds: Column) -> Column:
    """Monday is 0."""
    return F.weekday(ds)


def month(ds: Column) -> Column:
    return F.month(ds)


def category_activity(ds: Column, category: str, activity=fixed.CATEGORY_ACTIVITY) -> Column:
    return by_index(F.month(ds), activity[category], first=1)


def season_index(ds: Column, activity=fixed.CATEGORY_ACTIVITY, shares=fixed.CATEGORY_SHARE) -> Column:
    """Activity of the month, weighted by the share of each category."""
    monthly = [sum(activity[name][m] * share for name, share in shares.items()) for m in range(12)]
    return by_index(F.month(ds), monthly, first=1)


def weekday_weight(ds: Column) -> Column:
    return by_index(F.weekday(ds), fixed.WEEKDAY_WEIGHT)


def hour_weight(ds: Column) -> Column:
    return by_band(F.hour(ds), fixed.HOUR_BANDS, fixed.HOUR_DEFAULT)


def service_hour_weight(service: Column, at: Column) -> Column:
    """Weight of the hour for the service; an unknown service is an error."""
    chain = F
    for name, (bands, default) in fixed.SERVICE_HOUR_BANDS.items():
        chain = chain.when(service == name, by_band(F.hour(at), bands, default))
    unknown = F.raise_error(F.concat(F.lit("unknown service: "), F.coalesce(service, F.lit("null"))))
    return chain.otherwise(unknown.cast("double"))


def yearly_moment(year: Column, month_day: tuple[int, int], at_hour: int) -> Column:
    parts = [F.lit(part) for part in (*month_day, at_hour, 0)]
    return F.make_timestamp_ntz(year, *parts, F.lit(0))


def monsoon_flag(ds: Column) -> Column:
    """1 inside the yearly season, whose last moment is 23:00 of its last day."""
    first = yearly_moment(F.year(ds), fixed.MONSOON_FIRST, 0)
    last = yearly_moment(F.year(ds), fixed.MONSOON_LAST, 23)
    return F.when(ds.between(first, last), 1).otherwise(0)


def storm_effect(index: Column) -> Column:
    return F.when(index >= 0.8, 0.4).when(index >= 0.3, 1.3).otherwise(1.0)


def repayment_boost(ds: Column) -> Column:
    day = F.dayofmonth(ds)
    return F.when(day >= 25, 1.35).when(day <= 3, 1.15).otherwise(1.0)


def month_end_boost(ds: Column) -> Column:
    month_end = F.dayofmonth(ds) >= 26
    return (
        F.when(month_end & F.month(ds).isin(fixed.QUARTER_END_MONTHS), 1.60).when(month_end, 1.30).otherwise(1.0)
    )


def purchase_season_boost(ds: Column) -> Column:
    return F.when(F.month(ds).isin(fixed.PURCHASE_MONTHS), 1.25).otherwise(1.0)


def signup_season_boost(ds: Column) -> Column:
    return F.when(F.month(ds).isin(fixed.SIGNUP_MONTHS), 1.12).otherwise(1.0)


def service_boost(service: Column, ds: Column) -> Column:
    """The one seasonal boost that applies to the service."""
    return (
        F.when(service == "payment", repayment_boost(ds))
        .when(service == "batch", month_end_boost(ds))
        .when(service == "limit_scoring", purchase_season_boost(ds))
        .when(service == "auth", signup_season_boost(ds))
        .otherwise(1.0)
    )


def business_events(ds: Column) -> dict[str, Column]:
    """Label of the strongest business event at that time, per service."""
    day, at_hour, at_month = F.dayofmonth(ds), F.hour(ds), F.month(ds)
    spring = (at_month == 3) & day.between(10, 20)
    recovery = (at_month == 9) & day.between(2, 4)
    season = at_month.isin(fixed.PURCHASE_MONTHS)
    labels = {
        "auth": F.when(spring | season, "signup_or_login_peak"),
        "payment": F.when(spring, "spring_purchase_payment_spike")
        .when(recovery, "post_typhoon_payment_recovery")
        .when(day >= 25, "repayment_day"),
        "batch": F.when((at_hour >= 1) & (at_hour < 5), "nightly_batch").when(day >= 26, "month_end_batch"),
        "admin": F.when((at_hour >= 9) & (at_hour < 18), "business_hours"),
        "limit_scoring": F.when(spring, "spring_credit_limit_spike").when(season, "credit_limit_application_peak"),
    }
    return {name: label.otherwise("normal") for name, label in labels.items()}


def business_event(service: Column, ds: Column) -> Column:
    """Label of the strongest business event of the service at that time."""
    chain = F
    for name, label in business_events(ds).items():
        chain = chain.when(service == name, label)
    return chain.otherwise(F.raise_error(F.concat(F.lit("unknown service: "), F.coalesce(service, F.lit("null")))))


def service_values(service: Column, **tables: dict[str, float]) -> Column:
    """The constants of a service as one struct."""
    return record_by_name(service, tables, "service")
