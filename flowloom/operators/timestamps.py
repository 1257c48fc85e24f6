"""Mixed timestamp notations and time zones, normalised to UTC microseconds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.functions import instants as I
from flowloom.session import cut

#: A share of the posterior that an interpretation needs, else the value stays unresolved.
CONFIDENT = 0.9
#: The fitted mixtures are broadcast up to this many (source, mask) rows, joined by shuffle beyond.
MODEL_ROWS = 20_000
#: Years that are to be expected, a thousand times more likely than others before any value is seen.
YEARS = (1980, 2100)
#: Likelihoods of a value that is none of the formats, and of a date order that the reference contradicts.
NOISE, DISTRUST = 1e-18, 1e-27
#: Microseconds of a mean year.
_YEAR_US = 31_556_952_000_000


def site_clocks(sites: DataFrame) -> DataFrame:
    """One row per site: zone and date order. A site listed twice keeps its smallest (zone, order) row."""
    one = sites.filter(F.col("site").isNotNull()).groupBy("site").agg(F.min(F.struct("tz_name", "day_first")).alias("c"))
    return one.select(F.col("site").alias("__site"), F.col("c.tz_name").alias("__tz"), F.col("c.day_first").alias("__day_first"))


def _with_sites(df: DataFrame, sites: DataFrame, text: str, site: str) -> DataFrame:
    return I.with_readings(df.join(site_clocks(sites), F.col(site) == F.col("__site"), "left"), text)


def with_instant(df: DataFrame, sites: DataFrame, text: str = "timestamp", site: str = "site", out: str = "instant_us") -> DataFrame:
    """Adds ``out``: the UTC microseconds of ``text`` under the reference rules of the row's site, or null.

    Use this where each site's date order is known; ``normalise`` also estimates unknown orders. Null texts, impossible
    dates and zone-less texts of unknown sites give null. Rows are neither lost nor repeated; columns whose names start
    with two underscores are reserved. The sites table is small by nature and is broadcast by size, not by hint.
    """
    j = _with_sites(df, sites, text, site).withColumn("__l", I.once(I.by_reference(F.col("__day_first"))))
    return j.withColumn(out, I.once(I.utc_us(F.col("__l"), F.col("__tz")))).select(*df.columns, out)


def em_posteriors(counts: pd.DataFrame, rounds: int = 200, tolerance: float = 1e-9) -> pd.DataFrame:
    """Expectation-maximisation over one source's mixture of formats.

    ``counts`` has mask (the formats under which a value is a possible date) and n (how many such values); it may have
    order (1 day first, 0 month first, -1 unknown: what the reference says of the site) and year_a, year_b (the year
    under the first and the second reading). A value's likelihood under a format is the format's weight times the
    source's share of that year; weights and years are estimated together, the years with a weak prior on YEARS. The
    reference's order is a strong prior: the other order has the likelihood DISTRUST, below that of an unusable value,
    NOISE. Returns per row the best format (null: unusable), its posterior and whether it stays ambiguous.
    """
    c = counts.assign(**{k: counts[k] if k in counts else d for k, d in (("order", -1), ("year_a", 2000), ("year_b", 2000))})
    masks, n = c["mask"].to_numpy(np.int64), c["n"].to_numpy(float)
    k = len(I.FORMATS)
    member = ((masks[:, None] >> np.arange(k)) & 1).astype(float)
    second = np.array([f in ("slash_mdy", "epoch_ms") for f in I.FORMATS])
    years, at = np.unique(np.where(second, c["year_b"].to_numpy(np.int64)[:, None], c["year_a"].to_numpy(np.int64)[:, None]), return_inverse=True)
    at = at.reshape(len(c), k)
    order = c["order"].to_numpy()
    member[order == 1, I.FORMATS.index("slash_mdy")] *= DISTRUST
    member[order == 0, I.FORMATS.index("slash_dmy")] *= DISTRUST
    base = np.where((years >= YEARS[0]) & (years <= YEARS[1]), 1.0, 1e-3)
    base /= max(base.sum(), 1e-300)
    weight, noise, year = np.full(k, 1 / k), 0.01, base
    for _ in range(rounds):
        posterior = member * weight * year[at]
        total = posterior.sum(axis=1) + noise * NOISE
        share = posterior / total[:, None] * n[:, None]
        fresh, lost = share.sum(axis=0), float((noise * NOISE / total * n).sum())
        every = max(fresh.sum() + lost, 1e-300)
        year = (np.bincount(at.ravel(), share.ravel(), len(years)) + base) / (fresh.sum() + 1)
        moved = abs(fresh / every - weight).max() if len(c) else 0.0
        weight, noise = (fresh / every).clip(min=1e-12), max(lost / every, 1e-6)
        if moved < tolerance:
            break
    posterior = member * weight * year[at]
    posterior /= (posterior.sum(axis=1) + noise * NOISE)[:, None]
    best, top = posterior.argmax(axis=1), posterior.max(axis=1)
    usable = top > 1 - posterior.sum(axis=1)
    names = np.array(I.FORMATS, dtype=object)[best]
    return pd.DataFrame({"mask": masks, "format": pd.Series(np.where(usable, names, None), dtype=object), "posterior": np.where(usable, top, 1 - posterior.sum(axis=1)), "ambiguous": usable & (top < CONFIDENT)})


def normalise(df: DataFrame, sites: DataFrame, source: list[str], text: str = "timestamp", site: str = "site") -> DataFrame:
    """Adds ``format``, ``posterior``, ``ambiguous``, ``clock`` and ``utc_us`` to every row.

    Rows are parsed once and written with their possible readings. Counts per source of (formats, years, site's order)
    are aggregated from them, so that the mixture of each source is fitted on rows whose number the formats and years
    bound, whatever the table's size; every reading is then chosen by its posterior. Values without a confident reading
    are marked ambiguous and have no utc_us, as have unusable texts (format null). ``clock`` marks texts without a zone:
    'repeated' (the local time occurs twice, the earlier instant is given), 'skipped' (it never occurs) or 'no zone'
    (the site is unknown); the last two have no utc_us. An empty table gives an empty table. Source columns may be
    null: nulls form a source of their own. All columns of ``df`` are written along: select what is needed before.
    """
    keys = [f"__s{i}" for i in range(len(source))]
    sign = ["__mask", "__order", "__ya", "__yb"]
    named = df.withColumns({k: F.coalesce(F.col(c).cast("string"), F.lit("")) for k, c in zip(keys, source)})
    rows = _with_sites(named, sites, text, site)
    year = lambda c: F.coalesce(F.floor(F.col(c) / _YEAR_US).cast("int") + 1970, F.lit(-1))
    order = F.when(F.col("__day_first"), 1).when(~F.col("__day_first"), 0).otherwise(-1)
    rows = cut(rows.withColumns({"__order": order, "__ya": year("__a"), "__yb": year("__b")}).drop("__site", "__day_first"))
    counts = rows.filter("__mask > 0").groupBy(*keys, *sign).agg(F.count(F.lit(1)).alias("n"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        out = em_posteriors(pdf.rename(columns={"__mask": "mask", "__order": "order", "__ya": "year_a", "__yb": "year_b"}).reset_index(drop=True))
        return pd.concat([pdf[[*keys, *sign]].reset_index(drop=True), out[["format", "posterior", "ambiguous"]]], axis=1)

    schema = ", ".join([*(f"{k} string" for k in keys), *(f"{k} int" for k in sign), "format string, posterior double, ambiguous boolean"])
    # a source's rows number at most the formats times the years that occur, never its values
    model = cut(counts.groupBy(*keys).applyInPandas(fit, schema).withColumnsRenamed({"format": "__f", "posterior": "__q", "ambiguous": "__u"}))
    if model.count() <= MODEL_ROWS:
        model = F.broadcast(model)
    j = rows.join(model, [*keys, *sign], "left")
    local = F.when(F.col("__f").isin("slash_mdy", "epoch_ms"), F.col("__b")).otherwise(F.col("__a"))
    j = j.withColumn("__l", I.once(F.when(F.col("__f").isNotNull() & ~F.col("__u"), local)))
    added = {
        "format": F.col("__f"),
        "posterior": F.col("__q"),
        "ambiguous": F.coalesce("__u", F.lit(False)),
        "clock": I.clock_note(F.col("__l"), F.col("__tz")),
        "utc_us": I.once(I.utc_us(F.col("__l"), F.col("__tz"))),
    }
    return j.select(*[c for c in df.columns if c not in added], *[c.alias(k) for k, c in added.items()])
