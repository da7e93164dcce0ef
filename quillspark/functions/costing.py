"""Cost arithmetic: rent per call, staircase of whole machines, break-even in closed form, per-million rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOURS_PER_MONTH = 730.5


def usd_per_call(usd_per_hour: Column, requests_per_second: Column, utilisation: Column) -> Column:
    """Rent over the calls served in its hour; null unless 0 < utilisation <= 1 and both rates are positive."""
    valid = (utilisation > 0) & (utilisation <= 1) & (usd_per_hour > 0) & (requests_per_second > 0)
    return F.when(valid, F.try_divide(usd_per_hour, requests_per_second * 3600 * utilisation))


def capacity(requests_per_second: Column, utilisation: Column, hours: float = HOURS_PER_MONTH) -> Column:
    """Calls that one machine serves in a month."""
    return requests_per_second * 3600 * hours * utilisation


def staircase(volume: Column, usd_per_hour: Column, per_month: Column, fixed: Column, hours: float = HOURS_PER_MONTH) -> Column:
    """Whole machines for the volume, rented all month, plus the fixed cost."""
    return F.greatest(F.lit(1), F.ceil(volume / per_month)) * usd_per_hour * hours + fixed


def break_even(usd_per_hour: Column, requests_per_second: Column, api_usd: Column, fixed: Column, utilisation: Column, hours: float = HOURS_PER_MONTH) -> Column:
    """struct(gpus, volume, monthly): the least volume at which renting costs no more than the API, null fields for never.

    k machines break even inside their band if (k g + f) / a <= k c; the least such k is 1, or ceil(f / (c a - g)).
    """
    g, c = usd_per_hour * hours, capacity(requests_per_second, utilisation, hours)
    gain = c * api_usd - g
    k = F.when(g + fixed <= c * api_usd, F.lit(1)).when(gain > 0, F.greatest(F.lit(1), F.ceil(F.try_divide(fixed, gain)))).cast("long")
    volume = F.greatest((k * g + fixed) / api_usd, (k - 1) * c)
    monthly = F.greatest(F.lit(1), F.ceil(volume / c)) * g + fixed
    return F.struct(k.alias("gpus"), volume.alias("volume"), monthly.alias("monthly"))


def prefill_share(ttft_p50: Column, e2e_p50: Column) -> Column:
    return F.least(F.lit(1.0), F.try_divide(ttft_p50, e2e_p50))


def per_million_rates(per_call: Column, share: Column, mean_input: Column, mean_output: Column) -> Column:
    """struct(input, output): rates such that a mean call costs its rent."""
    return F.struct((per_call * share / mean_input * 1e6).alias("input"), (per_call * (1 - share) / mean_output * 1e6).alias("output"))


def call_cost(rates: Column, input_tokens: Column, output_tokens: Column) -> Column:
    return (rates["input"] * input_tokens + rates["output"] * output_tokens) / 1e6


def requests_per_level(concurrency: Column) -> Column:
    return F.greatest(F.lit(200), 10 * concurrency)
