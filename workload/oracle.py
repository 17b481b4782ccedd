"""The same queries as SQL over the generated tables, written without the library.

``_CTES`` holds named subqueries on the daily table ``sd``; a statement lists the ones it uses,
in order.
"""

from __future__ import annotations

from workload import tables as t
from workload.queries import DENSE

_SUPPLIER_DAYS = """
SELECT 'ST' || lpad(CAST(s_suppkey AS VARCHAR), CAST(greatest(length(CAST(s_suppkey AS VARCHAR)), 12) AS INTEGER), '0') AS STATION,
       s_name || ', ' || n_name || ', ' || r_name AS NAME,
       {measures}
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY s_suppkey, s_name, n_name, r_name, CAST(l_shipdate AS DATE)
"""
_REGION_DAYS = """
SELECT 'ST' || lpad(CAST(n_regionkey AS VARCHAR), CAST(greatest(length(CAST(n_regionkey AS VARCHAR)), 3) AS INTEGER), '0') AS STATION,
       r_name AS NAME,
       {measures}
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY n_regionkey, r_name, CAST(l_shipdate AS DATE)
"""
_MEASURES = """
       CAST(l_shipdate AS DATE) AS DATE,
       CAST(sum(l_linenumber) AS DOUBLE) AS PRCP,
       CAST(NULL AS DOUBLE) AS SNWD,
       CAST(NULL AS DOUBLE) AS TAVG,
       max(l_quantity) - 25 AS TMAX,
       min(CASE WHEN l_linestatus = 'F' THEN l_quantity END) - 25 AS TMIN,
       CAST(sum(CASE WHEN l_returnflag = 'R' AND month(l_shipdate) IN (11, 12, 1, 2, 3)
                     THEN l_linenumber END) AS DOUBLE) AS SNOW
"""
_SD = {
    "supplier": _SUPPLIER_DAYS.format(measures=_MEASURES),
    "region": _REGION_DAYS.format(measures=_MEASURES),
}

DAILY_STATS = (
    "tmean_doy_mean",
    "tmean_doy_std",
    "tmean_doy_max",
    "tmean_doy_min",
    "tmax_doy_max",
    "tmax_doy_std",
    "tmin_doy_min",
    "tmin_doy_std",
    "snow_doy_mean",
)
MONTH_STATS = (*(c for c in DAILY_STATS if c not in ("tmean_doy_max", "tmean_doy_min")), "prcp_sum")
ROW = ("STATION", "NAME", "DATE", "PRCP", "SNWD", "TAVG", "TMAX", "TMIN", "SNOW")

_SPREAD = """avg(TMEAN) AS tmean_doy_mean, stddev_samp(TMEAN) AS tmean_doy_std,
  max(TMAX) AS tmax_doy_max, stddev_samp(TMAX) AS tmax_doy_std,
  min(TMIN) AS tmin_doy_min, stddev_samp(TMIN) AS tmin_doy_std, avg(SNOW) AS snow_doy_mean"""

_BASELINE = f"DATE BETWEEN DATE '{t.BASELINE[0]}' AND DATE '{t.BASELINE[1]}'"


def r(expression: str, name: str | None = None) -> str:
    return f"round({expression}, 9) + 0.0 AS {name or expression}"


def rs(names, prefix: str = "") -> str:
    return ", ".join(r(prefix + n, n) for n in names)


def _days(start: str, end: str) -> str:
    return (
        f"(SELECT CAST(unnest(generate_series(DATE '{start}', DATE '{end}', INTERVAL 1 DAY)) "
        "AS DATE) AS DATE)"
    )


def _circular(window: int) -> str:
    frame = f"(PARTITION BY STATION ORDER BY pos ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)"
    means = ", ".join(
        f"CASE WHEN count({c}) OVER {frame} = {window} THEN avg({c}) OVER {frame} END AS {c}"
        for c in DAILY_STATS
    )
    return f"""
SELECT * FROM (
  SELECT STATION, DATE_MD, pos, {means} FROM (
    SELECT * FROM numbered
    UNION ALL BY NAME
    SELECT * REPLACE (pos - n AS pos) FROM numbered WHERE pos > n - {window - 1}
  )
) WHERE pos >= 1"""


_CTES = {
    "prep": """
SELECT *, strftime(DATE, '%m-%d') AS DATE_MD, strftime(DATE, '%Y-%m') AS DATE_YM,
       strftime(DATE, '%m') AS DATE_M, coalesce((TMIN + TMAX) / 2, TMIN, TMAX) AS TMEAN
FROM sd""",
    "base": f"SELECT * FROM prep WHERE {_BASELINE} AND DATE_MD <> '02-29'",
    "raw": f"""
SELECT STATION, DATE_MD, {_SPREAD}, max(TMEAN) AS tmean_doy_max, min(TMEAN) AS tmean_doy_min
FROM base GROUP BY STATION, DATE_MD""",
    "leap": "SELECT * FROM raw UNION ALL BY NAME SELECT STATION, '02-29' AS DATE_MD, "
    + ", ".join(
        f"avg(CASE WHEN DATE_MD IN ('02-28', '03-01') THEN {c} END) AS {c}" for c in DAILY_STATS
    )
    + " FROM raw GROUP BY STATION",
    "numbered": """
SELECT *, row_number() OVER (PARTITION BY STATION ORDER BY DATE_MD) AS pos,
       count(*) OVER (PARTITION BY STATION) AS n FROM leap""",
    "clim": _circular(t.WINDOW),
    "bounds": "SELECT STATION, min(DATE) AS first_date, max(DATE) AS last_date FROM sd GROUP BY STATION",
    "rec": """
SELECT STATION, DATE_MD, max(TMEAN) AS record_max, min(TMEAN) AS record_min
FROM prep GROUP BY STATION, DATE_MD""",
    "mclim": f"""
SELECT STATION, CAST(month(DATE) AS INTEGER) AS Month, {_SPREAD}, avg(PRCP) * 30 AS prcp_sum
FROM base GROUP BY STATION, month(DATE)""",
    "arch": "SELECT * FROM sd WHERE NOT (day(DATE) BETWEEN 10 AND 14 OR day(DATE) = 20)",
    "fetched": f"""
SELECT * REPLACE (CASE WHEN day(DATE) <= 3 THEN PRCP + 1 ELSE PRCP END AS PRCP) FROM sd
WHERE year(DATE) = {t.YEAR[0][:4]}
  AND (day(DATE) <= 3 OR day(DATE) BETWEEN 10 AND 14 OR day(DATE) = 20)""",
    "who": "SELECT DISTINCT STATION, NAME FROM sd",
}
_CLIM = ("prep", "base", "raw", "leap", "numbered", "clim")


def _monthly_ctes(end: str | None = None) -> dict[str, str]:
    upto = f" AND DATE <= DATE '{end}'" if end else ""
    return {
        "mon": f"""
SELECT STATION, DATE_YM, {_SPREAD}, sum(PRCP) AS prcp_sum
FROM prep WHERE DATE_MD <> '02-29'{upto} GROUP BY STATION, DATE_YM""",
        "monc": """
SELECT m.*, CAST(m.DATE_YM || '-01' AS DATE) AS DATE,
       CAST(substr(m.DATE_YM, 6, 2) AS INTEGER) AS Month,
       CAST(substr(m.DATE_YM, 1, 4) AS INTEGER) AS Year, """
        + ", ".join(f"c.{c} AS {c}_clim" for c in MONTH_STATS)
        + """, m.tmean_doy_mean - c.tmean_doy_mean AS tmean_diff,
       m.prcp_sum - c.prcp_sum AS prcp_diff
FROM mon m LEFT JOIN mclim c
  ON m.STATION = c.STATION AND CAST(substr(m.DATE_YM, 6, 2) AS INTEGER) = c.Month""",
    }


def _with(ctes, select: str, extra: dict[str, str] | None = None, sd: str | None = None) -> str:
    """The statement, ``@SD@`` standing for the daily table of the level. With ``sd`` the
    statement runs on that subquery of it (called ``daily`` there)."""
    bodies = {name: _CTES[name] for name in ctes} | (extra or {})
    parts = ["sd AS (@SD@)" if sd is None else f"daily AS (@SD@), sd AS ({sd})"]
    parts += [f"{name} AS ({body})" for name, body in bodies.items()]
    return "WITH " + ",\n".join(parts) + "\n" + select


def _bands(source: str) -> tuple[str, str]:
    return (
        f"coalesce({source}.tmean_doy_mean, 0) + coalesce({source}.tmean_doy_std, 0)",
        f"{source}.tmean_doy_mean - {source}.tmean_doy_std",
    )


def _envelopes(hi: str, lo: str) -> str:
    def guarded(function: str, other: str) -> str:
        return (
            f"CASE WHEN TMEAN IS NOT NULL AND ({other}) IS NOT NULL "
            f"THEN {function}(TMEAN, {other}) END"
        )

    return ", ".join(
        (
            r(guarded("greatest", "tmean_doy_mean"), "t_above"),
            r(guarded("greatest", hi), "t_above_std"),
            r(guarded("least", "tmean_doy_mean"), "t_below"),
            r(guarded("least", lo), "t_below_std"),
        )
    )


_SNOW = """
SELECT *, CASE WHEN SNOW IS NOT NULL THEN
         sum(SNOW) OVER (PARTITION BY STATION ORDER BY DATE ROWS UNBOUNDED PRECEDING) END AS snow_acc,
       max(CASE WHEN SNOW > 0 THEN DATE END) OVER (PARTITION BY STATION) AS last_snow_date
FROM {rows}"""
_SNOW_COLUMNS = (
    r("snow_acc")
    + ", "
    + r("snow_acc / 10", "snow_acc_cm")
    + """, last_snow_date,
  coalesce(DATE <= last_snow_date, false) AS until_last_snow,
  coalesce(DATE >= last_snow_date, false) AS from_last_snow"""
)


def _series(span: tuple[str, str]) -> str:
    hi, lo = _bands("s")
    extra = {
        "bounds": _CTES["bounds"],
        "rec": _CTES["rec"],
        "spine": f"""
SELECT STATION, d.DATE, d.DATE <= last_date AS in_data_range, strftime(d.DATE, '%m-%d') AS DATE_MD
FROM bounds, {_days(*span)} d""",
        "obs": """
SELECT spine.*, p.PRCP, p.TMAX, p.TMIN, p.TMEAN, p.SNOW
FROM spine LEFT JOIN prep p ON p.STATION = spine.STATION AND p.DATE = spine.DATE""",
        "snowed": _SNOW.format(rows="obs"),
        "s": """
SELECT o.*, """
        + ", ".join(f"c.{c}" for c in DAILY_STATS)
        + """,
       coalesce(o.TMEAN = r.record_max, false) AS is_record_high,
       coalesce(o.TMEAN = r.record_min, false) AS is_record_low
FROM snowed o
LEFT JOIN clim c ON c.STATION = o.STATION AND c.DATE_MD = o.DATE_MD
LEFT JOIN rec r ON r.STATION = o.STATION AND r.DATE_MD = o.DATE_MD""",
    }
    return _with(
        _CLIM,
        f"""SELECT STATION, DATE, DATE_MD, in_data_range, {rs(('PRCP', 'TMAX', 'TMIN', 'TMEAN', 'SNOW'))},
  {_SNOW_COLUMNS}, {rs(DAILY_STATS)}, is_record_high, is_record_low,
  {r(hi, 'std_hi')}, {r(lo, 'std_lo')}, {_envelopes(hi, lo)},
  in_data_range AND TMEAN IS NULL AS no_data_temperature,
  in_data_range AND PRCP IS NULL AS no_data_precipitation
FROM s""",
        extra,
    )


def _monthly(value: str, above: str, below: str) -> str:
    frame = f"(PARTITION BY STATION ORDER BY DATE_YM ROWS BETWEEN {t.TRAILING - 1} PRECEDING AND CURRENT ROW)"
    gate = ""
    if value == "prcp_diff":
        gate = "WHERE STATION NOT IN (SELECT STATION FROM mclim WHERE prcp_sum IS NULL)"
    trailing = (
        f"CASE WHEN count({value}) OVER {frame} = {t.TRAILING} THEN avg({value}) OVER {frame} END"
    )
    return _with(
        ("prep", "base", "mclim"),
        f"""SELECT STATION, DATE_YM, DATE, Month, Year, {rs(MONTH_STATS)},
  {rs([f'{c}_clim' for c in MONTH_STATS])}, {rs(('tmean_diff', 'prcp_diff'))},
  {r('mean_of_last', 'trailing_values')}, {r(value, 'value')},
  CASE WHEN {value} < 0 THEN '{below}' WHEN {value} >= 0 THEN '{above}' END AS value_class
FROM (SELECT *, {trailing} AS mean_of_last FROM monc {gate})
WHERE DATE >= DATE '{t.YEAR[0]}'""",
        _monthly_ctes("2001-08-31"),
    )


def _gaps(start: str, end: str) -> dict[str, str]:
    return {
        "arch": _CTES["arch"],
        "miss": f"""
SELECT w.STATION, d.DATE FROM (SELECT DISTINCT STATION FROM sd) w, {_days(start, end)} d
WHERE NOT EXISTS (SELECT 1 FROM arch a WHERE a.STATION = w.STATION AND a.DATE = d.DATE)""",
        "ranges": """
SELECT STATION, min(DATE) AS range_start, max(DATE) AS range_end,
       CAST(count(*) AS INTEGER) AS n_days
FROM (SELECT *, DATE - CAST(row_number() OVER (PARTITION BY STATION ORDER BY DATE) AS INTEGER) AS run
      FROM miss)
GROUP BY STATION, run""",
    }


def _completeness() -> dict[str, str]:
    """Every day of every station, and whether the archive has it."""
    ctes = {
        "days": f"""
SELECT w.STATION, d.DATE, strftime(d.DATE, '%Y-%m') AS DATE_YM, p.DATE IS NOT NULL AS has
FROM (SELECT DISTINCT STATION FROM sd) w CROSS JOIN {_days(*t.REPORT)} d
LEFT JOIN (SELECT DISTINCT STATION, DATE FROM arch
           WHERE coalesce(PRCP, SNWD, TAVG, TMAX, TMIN, SNOW) IS NOT NULL) p
  ON p.STATION = w.STATION AND p.DATE = d.DATE""",
        "gaps": """
SELECT STATION, min(DATE) AS low, max(DATE) AS high, count(*) AS n FROM (
  SELECT *, DATE - CAST(row_number() OVER (PARTITION BY STATION ORDER BY DATE) AS INTEGER) AS run
  FROM days WHERE NOT has) GROUP BY STATION, run""",
        "cut": """
SELECT STATION, DATE_YM, max(n) AS n FROM (
  SELECT STATION, DATE_YM, count(*) AS n FROM (
    SELECT *, DATE - CAST(row_number() OVER (PARTITION BY STATION, DATE_YM ORDER BY DATE) AS INTEGER)
             AS run FROM days WHERE NOT has) GROUP BY STATION, DATE_YM, run)
GROUP BY STATION, DATE_YM""",
        "poor": """
SELECT STATION, min(s) AS s FROM (
  SELECT STATION, avg(CAST(has AS INTEGER)) AS s FROM days GROUP BY STATION, month(DATE))
GROUP BY STATION""",
    }
    share = "count(*) FILTER (has) / CAST(count(*) AS DOUBLE)"
    return {
        "completeness_months": _with(
            ("arch",),
            f"""SELECT d.STATION, d.DATE_YM, CAST(count(*) AS INTEGER) AS n_days,
  CAST(count(*) FILTER (has) AS INTEGER) AS n_present,
  CAST(count(*) FILTER (NOT has) AS INTEGER) AS n_missing, {r(share, 'share')},
  CAST(coalesce(any_value(cut.n), 0) AS INTEGER) AS longest_gap
FROM days d LEFT JOIN cut ON cut.STATION = d.STATION AND cut.DATE_YM = d.DATE_YM
GROUP BY d.STATION, d.DATE_YM""",
            ctes,
        ),
        "completeness_days": _with(
            ("arch",),
            f"""SELECT STATION, strftime(DATE, '%m-%d') AS DATE_MD, count(*) AS n_years,
  count(*) FILTER (has) AS n_present, {r(share, 'share')}
FROM days GROUP BY STATION, strftime(DATE, '%m-%d')""",
            ctes,
        ),
        "completeness_stations": _with(
            ("arch",),
            f"""SELECT d.STATION, count(*) AS n_days, count(*) FILTER (has) AS n_present,
  {r(share, 'share')}, min(DATE) FILTER (has) AS first_date, max(DATE) FILTER (has) AS last_date,
  CAST(coalesce(any_value(g.n), 0) AS INTEGER) AS longest_gap, {r('any_value(poor.s)', 'poorest_month')},
  CASE WHEN count(*) FILTER (has) = count(*) THEN 'complete'
       WHEN count(*) FILTER (has) = 0 THEN 'no data'
       WHEN {share} >= {t.LEAST_SHARE} AND any_value(poor.s) >= {t.LEAST_SHARE} THEN 'usable'
       ELSE 'incomplete' END AS verdict
FROM days d LEFT JOIN (SELECT STATION, max(n) AS n FROM gaps GROUP BY STATION) g ON g.STATION = d.STATION
LEFT JOIN poor ON poor.STATION = d.STATION GROUP BY d.STATION""",
            ctes,
        ),
    }


_EMPTIED = """
SELECT * REPLACE ({}) FROM fetched""".format(
    ", ".join(f"CASE WHEN day(DATE) <> 2 THEN {c} END AS {c}" for c in ROW[3:])
)
_HAS_DATA = "coalesce(PRCP, SNWD, TAVG, TMAX, TMIN, SNOW) IS NOT NULL"
# Archive rows that no fetched row replaces, and the fetched ones.
_MERGED = """
SELECT * FROM arch a WHERE NOT EXISTS (
  SELECT 1 FROM {0} f WHERE f.STATION = a.STATION AND f.DATE = a.DATE)
UNION ALL BY NAME SELECT * FROM {0}"""
_BITS = """SELECT STATION, CAST(date_trunc('month', DATE) AS DATE) AS month,
  CAST(bit_or(CAST(1 AS BIGINT) << (day(DATE) - 1)) AS BIGINT) AS bits
FROM merged WHERE {} GROUP BY 1, 2""".format(_HAS_DATA)


def _state(span: tuple[str, str], merged: str | None = None, source: str = "") -> str:
    base = (
        f"SELECT * FROM prep WHERE DATE BETWEEN DATE '{span[0]}' AND DATE '{span[1]}' "
        "AND DATE_MD <> '02-29'"
    )
    select = f"SELECT STATION, DATE_MD, {rs(DAILY_STATS)} FROM clim"
    if merged is None:
        return _with(_CLIM, select, {"base": base})
    prep = _CTES["prep"].replace("FROM sd", f"FROM ({source})")
    rest = {name: _CTES[name] for name in _CLIM}
    return _with(
        ("arch", "fetched", "who"), select, {"merged": merged, **rest, "prep": prep, "base": base}
    )


def _upkeep(row: str, monthly: str) -> dict[str, str]:
    in_year = f"{_days(*t.YEAR)}"
    empty = {"emptied": _EMPTIED, "merged": _MERGED.format("emptied")}
    full = {"merged": _MERGED.format("fetched")}
    chunk = 1000 // len(t.DATATYPES)
    gaps = {
        **empty,
        **{k: v for k, v in _gaps("1990-01-01", "2001-12-31").items() if k != "arch"},
    }
    gaps["miss"] = gaps["miss"].replace("FROM arch a WHERE", f"FROM merged a WHERE {_HAS_DATA} AND")
    padded = f"""SELECT w.STATION, w.NAME, d.DATE FROM who w CROSS JOIN {in_year} d
WHERE NOT EXISTS (SELECT 1 FROM merged a WHERE a.STATION = w.STATION AND a.DATE = d.DATE)"""
    differ = " OR ".join(f"a.{c} IS DISTINCT FROM f.{c}" for c in ROW[3:])
    return {
        "presence_after_upsert": _with(("arch", "fetched"), _BITS, empty),
        "index_published": _with(("arch", "fetched"), _BITS, full),
        "backfill_from_index": _with(
            ("arch", "fetched"),
            f"""SELECT STATION, range_start, range_end, range_start + CAST(i AS INTEGER) AS chunk_start,
  least(range_start + CAST(i AS INTEGER) + {chunk - 1}, range_end) AS chunk_end
FROM (SELECT *, unnest(generate_series(0, n_days - 1, {chunk})) AS i FROM ranges)""",
            gaps,
        ),
        "upsert_changes": _with(
            ("arch", "fetched", "who"),
            f"""SELECT f.STATION, f.DATE, CASE WHEN a.DATE IS NULL THEN 'added' ELSE 'corrected' END AS change
FROM emptied f LEFT JOIN arch a ON a.STATION = f.STATION AND a.DATE = f.DATE
WHERE a.DATE IS NULL OR {differ}
UNION ALL SELECT STATION, DATE, 'padded' AS change FROM ({padded})""",
            empty,
        ),
        "months_rebuilt": _with(
            ("arch", "fetched", "who"),
            f"SELECT STATION, DATE_YM, {rs(MONTH_STATS)} FROM mon",
            {
                **empty,
                "prep": _CTES["prep"].replace("FROM sd", f"FROM (SELECT * FROM merged UNION ALL BY NAME {padded})"),
                "mon": monthly,
            },
        ),
        "archive_published": _with(
            ("arch", "fetched", "who"),
            f"{row} FROM (SELECT * FROM merged UNION ALL BY NAME {padded})",
            full,
        ),
        "registry_after_upsert": _with(
            ("arch", "fetched", "who"),
            f"""SELECT a.STATION, 'zz ' || max(w.NAME) AS NAME, min(a.DATE) AS first_date,
  max(a.DATE) AS last_date, count(*) AS n_days
FROM (SELECT STATION, DATE FROM merged UNION ALL SELECT STATION, DATE FROM ({padded})) a
JOIN who w ON w.STATION = a.STATION GROUP BY a.STATION""",
            empty,
        ),
        "climatology_published": _state(
            t.LONG_BASELINE, full["merged"], f"SELECT * FROM merged UNION ALL BY NAME {padded}"
        ),
        "climatology_from_state": _state(t.BASELINE),
        "climatology_from_state_cut": _state(t.CUT_BASELINE),
        "climatology_from_state_long": _state(t.LONG_BASELINE),
    }


def _on_daily() -> dict[str, str]:
    prepared = f"""SELECT STATION, NAME, DATE, {rs(ROW[3:])}, DATE_MD, DATE_YM, DATE_M, {r('TMEAN')}
FROM prep"""
    row = f"SELECT STATION, NAME, DATE, {rs(ROW[3:])}"
    clim_row = f"SELECT STATION, DATE_MD, {rs(DAILY_STATS)}"
    hi, lo = _bands("clim")
    monthly = _monthly_ctes()
    chunk = 1000 // len(t.DATATYPES)
    year = f"DATE BETWEEN DATE '{t.YEAR[0]}' AND DATE '{t.YEAR[1]}'"
    mon_row = f"SELECT STATION, DATE_YM, {rs(MONTH_STATS)} FROM mon"
    no_prcp = "CASE WHEN {} THEN PRCP END"
    gate_sd = "SELECT * REPLACE ({} AS PRCP) FROM daily".format(
        no_prcp.format("NOT (month(DATE) = 1 AND regexp_matches(NAME, 'NATION_1|ASIA'))")
    )
    zero_sd = f"SELECT * REPLACE ({no_prcp.format('SNOW IS NULL')} AS PRCP) FROM daily"
    gated = _monthly("prcp_diff", "", "")
    return {
        "prepare_daily": _with(("prep",), prepared),
        "remove_feb29": _with(
            ("prep",),
            f"SELECT STATION, DATE, DATE_MD, {r('TMEAN')} FROM prep WHERE DATE_MD <> '02-29'",
        ),
        "location_filter": _with(
            ("prep",),
            f"""SELECT STATION, NAME, DATE, {r('TMEAN')} FROM prep
WHERE regexp_matches(lower(NAME), 'nation_1.*asia')""",
        ),
        "station_names": _with(
            (), "SELECT DISTINCT NAME, lower(NAME) LIKE '%asia%' AS matches FROM sd"
        ),
        "numeric_cast": _with((), f"{row} FROM sd"),
        "date_bounds": _with(
            ("bounds",),
            f"""SELECT *, last_date >= DATE '{t.STATUS_END}' AND first_date <= DATE '{t.STATUS_END}'
  AS baseline_valid FROM bounds""",
        ),
        "baseline_rows": _with(
            ("prep", "base"), f"SELECT STATION, DATE, {rs(('PRCP', 'TMEAN'))} FROM base"
        ),
        "daily_climatology_raw": _with(_CLIM[:3], f"{clim_row} FROM raw"),
        "daily_climatology_feb29": _with(_CLIM[:4], f"{clim_row} FROM leap"),
        "daily_climatology_smooth": _with(_CLIM, f"{clim_row} FROM clim"),
        "daily_climatology_checked": _with(_CLIM, f"{clim_row} FROM clim"),
        "daily_climatology_even_window": _with(_CLIM[:4], f"{clim_row} FROM leap"),
        "daily_climatology_pooled": _with(
            _CLIM, f"{clim_row} FROM clim", sd="SELECT * REPLACE ('' AS STATION) FROM daily"
        ),
        "observed_vs_climate": _with(
            (*_CLIM, "bounds"),
            f"""SELECT w.STATION, d.DATE, strftime(d.DATE, '%m-%d') AS DATE_MD,
  d.DATE <= w.last_date AS in_data_range, {r('p.PRCP', 'PRCP')}, {r('p.TMEAN', 'TMEAN')},
  {r('c.tmean_doy_mean', 'tmean_doy_mean')}, {r('c.tmean_doy_std', 'tmean_doy_std')},
  d.DATE <= w.last_date AND p.TMEAN IS NULL AS no_data_temperature,
  d.DATE <= w.last_date AND p.PRCP IS NULL AS no_data_precipitation
FROM bounds w CROSS JOIN {_days(*t.YEAR)} d
LEFT JOIN prep p ON p.STATION = w.STATION AND p.DATE = d.DATE
LEFT JOIN clim c ON c.STATION = w.STATION AND c.DATE_MD = strftime(d.DATE, '%m-%d')""",
        ),
        "std_bands": _with(
            _CLIM,
            f"""SELECT STATION, DATE_MD, {rs(('tmean_doy_mean', 'tmean_doy_std'))},
  {r(hi, 'std_hi')}, {r(lo, 'std_lo')} FROM clim""",
        ),
        "envelopes": _with(
            _CLIM,
            f"""SELECT p.STATION, p.DATE, {r('TMEAN')},
  {_envelopes('std_hi', 'std_lo')}
FROM prep p LEFT JOIN (SELECT *, {hi} AS std_hi, {lo} AS std_lo FROM clim) c
  ON c.STATION = p.STATION AND c.DATE_MD = p.DATE_MD""",
        ),
        "record_extremes": _with(
            ("prep", "rec"),
            f"SELECT STATION, DATE_MD, {rs(('record_max', 'record_min'))} FROM rec",
        ),
        "record_days": _with(
            ("prep", "rec"),
            f"""SELECT p.STATION, p.DATE, p.DATE_MD, {r('p.TMEAN', 'TMEAN')},
  p.TMEAN = record_max AS is_record_high, p.TMEAN = record_min AS is_record_low
FROM prep p JOIN rec ON rec.STATION = p.STATION AND rec.DATE_MD = p.DATE_MD
WHERE {year} AND (p.TMEAN = record_max OR p.TMEAN = record_min)""",
        ),
        "snow_accumulation": _with(
            (),
            f"SELECT STATION, DATE, {r('SNOW')}, {_SNOW_COLUMNS} FROM snowed",
            {
                "winter": f"SELECT STATION, DATE, SNOW FROM sd WHERE DATE BETWEEN "
                f"DATE '{t.WINTER[0]}' AND DATE '{t.WINTER[1]}'",
                "snowed": _SNOW.format(rows="winter"),
            },
        ),
        "daily_series": _series(t.YEAR),
        "daily_series_winter": _series(t.WINTER),
        "daily_series_past_end": _series(t.PAST_END),
        "monthly_stats": _with(("prep",), mon_row, {"mon": _monthly_ctes("2001-08-31")["mon"]}),
        "monthly_stats_zero_sum": _with(
            ("prep",),
            mon_row,
            {
                "mon": f"""SELECT STATION, DATE_YM, {_SPREAD}, coalesce(sum(PRCP), 0) AS prcp_sum
FROM prep GROUP BY STATION, DATE_YM"""
            },
            sd=zero_sd,
        ),
        "monthly_climate": _with(
            ("prep", "base", "mclim"), f"SELECT STATION, Month, {rs(MONTH_STATS)} FROM mclim"
        ),
        "monthly_climate_years": _with(
            ("prep",),
            f"""SELECT STATION, CAST(month(DATE) AS INTEGER) AS Month,
  {r('avg(TMEAN)', 'tmean_mean')}, {r('stddev_samp(TMEAN)', 'tmean_std')},
  {r('max(TMAX)', 'tmax_max')}, {r('stddev_samp(TMAX)', 'tmax_std')},
  {r('min(TMIN)', 'tmin_min')}, {r('stddev_samp(TMIN)', 'tmin_std')},
  {r('avg(SNOW)', 'snow_mean')}, {r('avg(PRCP) * any_value(n_years)', 'prcp_mean')}
FROM prep JOIN (SELECT STATION, count(DISTINCT year(DATE)) AS n_years FROM sd GROUP BY STATION)
  USING (STATION)
GROUP BY STATION, month(DATE)""",
        ),
        "monthly_anomaly": _with(
            ("prep", "base", "mclim"),
            f"SELECT STATION, DATE_YM, DATE, Month, Year, {rs(('tmean_diff', 'prcp_diff'))} FROM monc",
            monthly,
        ),
        "precipitation_gate": f"SELECT STATION, DATE_YM, value FROM ({gated})".replace(
            "sd AS (@SD@)", f"daily AS (@SD@), sd AS ({gate_sd})"
        ),
        "monthly_trailing": _with(
            ("prep",),
            f"""SELECT STATION, DATE_YM, {r('tmean_doy_mean')},
  {r('CASE WHEN count(tmean_doy_mean) OVER w = 12 THEN avg(tmean_doy_mean) OVER w END', 'trailing_values')}
FROM mon WINDOW w AS (PARTITION BY STATION ORDER BY DATE_YM ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""",
            {"mon": monthly["mon"]},
        ),
        "monthly_temperature": _monthly("tmean_doy_mean", "Above freezing", "Below freezing"),
        "monthly_temperature_anomaly": _monthly("tmean_diff", "Above average", "Below average"),
        "monthly_precipitation": _monthly("prcp_sum", "Monthly Precipitation", ""),
        "monthly_precipitation_anomaly": _monthly("prcp_diff", "Above average", "Below average"),
        "missing_days": _with((), "SELECT * FROM miss", _gaps(*t.YEAR)),
        "missing_ranges": _with((), "SELECT * FROM ranges", _gaps(*t.YEAR)),
        "contiguous_ranges": _with(
            (),
            """SELECT STATION, min(DATE) AS range_start, max(DATE) AS range_end,
  CAST(count(*) AS INTEGER) AS n_days
FROM (SELECT STATION, DATE,
        DATE - CAST(row_number() OVER (PARTITION BY STATION ORDER BY DATE) AS INTEGER) AS run FROM sd)
GROUP BY STATION, run""",
        ),
        "backfill_chunks": _with(
            (),
            f"""SELECT STATION, range_start, range_end, range_start + CAST(i AS INTEGER) AS chunk_start,
  least(range_start + CAST(i AS INTEGER) + {chunk - 1}, range_end) AS chunk_end
FROM (SELECT *, unnest(generate_series(0, n_days - 1, {chunk})) AS i FROM ranges)""",
            _gaps("1990-01-01", "2001-12-31"),
        ),
        "pad_calendar": _with(
            ("arch", "who"),
            f"""{row} FROM arch UNION ALL BY NAME
SELECT w.STATION, w.NAME, d.DATE FROM who w CROSS JOIN {_days(*t.YEAR)} d
WHERE NOT EXISTS (SELECT 1 FROM arch a WHERE a.STATION = w.STATION AND a.DATE = d.DATE)""",
        ),
        "upsert_keep_last": _with(
            ("arch", "fetched"),
            f"""{row} FROM (
  SELECT *, row_number() OVER (PARTITION BY STATION, DATE ORDER BY rank DESC) AS n FROM (
    SELECT *, 1 AS rank FROM arch UNION ALL BY NAME
    SELECT * REPLACE (NULL AS NAME), 2 AS rank FROM fetched)
) WHERE n = 1""",
        ),
        "upsert_padded": _with(
            ("arch", "fetched", "who"),
            f"""{row} FROM (
  SELECT *, row_number() OVER (PARTITION BY STATION, DATE ORDER BY rank DESC) AS n FROM (
    SELECT *, 1 AS rank FROM arch UNION ALL BY NAME SELECT *, 2 AS rank FROM fetched
    UNION ALL BY NAME SELECT w.STATION, w.NAME, d.DATE, 0 AS rank
    FROM who w CROSS JOIN {_days(*t.YEAR)} d)
) WHERE n = 1""",
        ),
        "service_records": _with(
            (),
            f"""SELECT STATION, CAST(NULL AS VARCHAR) AS NAME, DATE,
  {rs(ROW[3:])} FROM sd""",
        ),
        "long_pivot_scaled": _with(
            (), f"SELECT STATION, CAST(NULL AS VARCHAR) AS NAME, DATE, {rs(ROW[3:])} FROM sd"
        ),
        "long_pivot_padded": _with(
            ("who",),
            f"""SELECT STATION, 'label' AS NAME, DATE, {rs(ROW[3:])} FROM sd UNION ALL BY NAME
SELECT w.STATION, 'label' AS NAME, d.DATE FROM who w CROSS JOIN {_days(*t.YEAR)} d
WHERE NOT EXISTS (SELECT 1 FROM sd a WHERE a.STATION = w.STATION AND a.DATE = d.DATE)""",
        ),
        "csv_roundtrip": _with((), f"{row} FROM sd"),
        "parquet_roundtrip": _with((), f"{row} FROM sd WHERE {_BASELINE}"),
        "mixed_parquet": _with((), f"{row} FROM ({_MIXED})"),
        "mixed_csv": _with((), f"{row} FROM ({_MIXED})"),
        "text_dates_in_range": _with((), f"{row} FROM sd WHERE {_BASELINE}"),
        "upsert_newest": _with(
            ("arch", "fetched"),
            f"""{row} FROM (
  SELECT *, row_number() OVER (PARTITION BY STATION, DATE ORDER BY rank DESC) AS n FROM (
    SELECT *, 1 AS rank FROM arch UNION ALL BY NAME
    SELECT * REPLACE (NULL AS NAME, PRCP - 1 AS PRCP), 2 AS rank FROM fetched)
) WHERE n = 1""",
        ),
        "upsert_relabelled": _with(
            ("arch", "fetched", "who"),
            f"""{row} FROM (
  SELECT *, row_number() OVER (PARTITION BY STATION, DATE ORDER BY rank DESC) AS n FROM (
    SELECT *, 1 AS rank FROM arch UNION ALL BY NAME
    SELECT * REPLACE ('zz ' || NAME AS NAME), 2 AS rank FROM fetched
    UNION ALL BY NAME SELECT w.STATION, 'zz ' || w.NAME AS NAME, d.DATE, 0 AS rank
    FROM who w CROSS JOIN {_days(*t.YEAR)} d)
) WHERE n = 1""",
        ),
        "landed_records": _with(
            (), f"SELECT STATION, CAST(NULL AS VARCHAR) AS NAME, DATE, {rs(ROW[3:])} FROM sd"
        ),
        "landed_rejects": _with((), _REJECTS),
        "responses_in_range": _with(
            (),
            f"""SELECT STATION, CAST(NULL AS VARCHAR) AS NAME, DATE,
  {rs(ROW[3:])} FROM sd WHERE year(DATE) = {t.YEAR[0][:4]}""",
        ),
        "responses_rejected": _with(
            (),
            """SELECT DISTINCT STATION, make_date(year(DATE), 1, 1) AS chunk_start,
  make_date(year(DATE), 12, 31) AS chunk_end,
  CAST(CASE WHEN year(DATE) = 1997 THEN 0 ELSE 13 END AS BIGINT) AS size
FROM sd WHERE year(DATE) IN (1997, 1998)""",
        ),
        "requests_open": _with(
            (),
            """SELECT DISTINCT STATION, make_date(year(DATE), 1, 1) AS chunk_start,
  make_date(year(DATE), 12, 31) AS chunk_end
FROM sd WHERE year(DATE) IN (1997, 1998)
UNION ALL SELECT DISTINCT STATION, DATE '2002-01-01', DATE '2002-12-31' FROM sd""",
        ),
        "registry_of_stations": _with(
            (),
            """SELECT STATION, max(NAME) AS NAME, min(DATE) AS first_date, max(DATE) AS last_date,
  count(*) AS n_days FROM sd GROUP BY STATION""",
        ),
        "location_by_registry": _with(
            ("prep",),
            f"""SELECT STATION, NAME, DATE, {r('TMEAN')} FROM prep
WHERE regexp_matches(lower(NAME), 'nation_1.*asia')""",
        ),
        "climatology_in_order": _with(
            _CLIM,
            f"""SELECT STATION, DATE_MD, {r('tmean_doy_mean')},
  row_number() OVER (ORDER BY STATION, DATE_MD) AS place FROM clim""",
        ),
        **_completeness(),
        **_upkeep(row, monthly["mon"]),
    }


# Odd months come without snow.
_MIXED = "SELECT * REPLACE (CASE WHEN month(DATE) % 2 = 0 THEN SNOW END AS SNOW) FROM sd"
_REJECTS = """SELECT unnest(['<html>' || r || '</html>', '{"errorCode":400,"station":"' || r || '"}',
  '["' || r || '"]', '[{"other":"' || r || '"}]', '[{"STATION":"' || r]) AS body
FROM (SELECT STATION AS r FROM sd GROUP BY 1)
UNION ALL SELECT '<html>' || NAME || '</html>' AS body FROM (SELECT DISTINCT NAME FROM sd)"""


def _gridded(station: str) -> str:
    kelvin = ", ".join(
        r(f"avg(CASE WHEN event_type = '{e}' THEN value END) - 273.15", c)
        for e, c in (("click", "TAVG"), ("error", "TMIN"), ("purchase", "TMAX"))
    )
    return f"""SELECT {station} AS STATION, '' AS NAME, CAST(ts AS DATE) AS DATE, {kelvin},
  {r("avg(CASE WHEN event_type = 'view' THEN value END) * 1e3", 'PRCP')},
  CAST(NULL AS DOUBLE) AS SNWD
FROM events WHERE value IS NOT NULL GROUP BY ALL"""


# Every station against every cell.
_NEAREST = f"""
SELECT STATION, arg_min(cell, (km, cell)) AS cell, min(km) AS km FROM (
  SELECT STATION, cell, 2 * 6371.0088 * asin(sqrt(least(1.0,
           pow(sin(radians(p.lat - c.lat) / 2), 2)
           + cos(radians(p.lat)) * cos(radians(c.lat)) * pow(sin(radians(p.lon - c.lon) / 2), 2)))) AS km
  FROM (SELECT 'ST' || lpad(CAST(s_suppkey AS VARCHAR), CAST(greatest(length(CAST(s_suppkey AS VARCHAR)), 12) AS INTEGER), '0') AS STATION,
               (s_suppkey * 37) % 1781 / 10.0 - 89.0 AS lat, (s_suppkey * 1013) % 3600 / 10.0 - 180.0 AS lon
        FROM supplier) p
  CROSS JOIN (SELECT DISTINCT user_id AS cell, CAST((user_id * 53) % 179 - 89 AS DOUBLE) AS lat,
                     (user_id * 97) % 360 + 0.5 AS lon FROM events) c)
WHERE km <= {t.REACH_KM} GROUP BY STATION"""


def _on_tables() -> dict[str, str]:
    point = "'ST' || lpad(CAST(user_id AS VARCHAR), CAST(greatest(length(CAST(user_id AS VARCHAR)), 9) AS INTEGER), '0')"
    quantity = "CAST(l_quantity AS VARCHAR)"
    columns = {
        "order": "CAST(l_orderkey AS VARCHAR)",
        "quantity": quantity,
        "mixed": f"CASE WHEN l_linenumber = 7 THEN 'n/a' ELSE {quantity} END",
        "partly_missing": f"CASE WHEN l_linestatus = 'F' THEN {quantity} END",
        "flag": "l_returnflag",
        "with_empty": f"CASE WHEN l_linenumber = 7 THEN '' ELSE {quantity} END",
        "infinite": f"CASE WHEN l_linenumber = 7 THEN '-Infinity' ELSE {quantity} END",
        "not_a_number": f"CASE WHEN l_linenumber = 7 THEN 'nan' ELSE {quantity} END",
    }
    value = "nullif({}, '')"
    number = "CASE WHEN {} <> 'nan' THEN TRY_CAST({} AS DOUBLE) END"
    profile = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({value.format(e)}) AS n_values,
  count({number.format(e, e)}) AS n_numbers,
  count({value.format(e)}) = count({number.format(e, e)}) AS is_numeric FROM lineitem"""
        for c, e in columns.items()
    )
    return {
        "landing_json": """SELECT event_type, count(k) AS n_values, CAST(sum(k) AS BIGINT) AS total
FROM (SELECT event_type, TRY_CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT) AS k
      FROM events) GROUP BY event_type""",
        "numeric_inference": profile,
        "gridded_era5": _gridded(point),
        "landed_pairs": f"""SELECT {point} AS STATION, key, {r('value')} FROM (
  SELECT user_id, strftime(ts, '%Y%m%d') || '_' || event_type AS key, value
  FROM events WHERE value IS NOT NULL)""",
        "gridded_era5_one_point": _gridded("''"),
        "gridded_from_maps": _gridded(point),
        "nearest_cells": f"SELECT STATION, cell, round(km, 6) AS distance_km FROM ({_NEAREST})",
        "point_extract": _gridded("n.STATION").replace(
            "FROM events", f"FROM events JOIN ({_NEAREST}) n ON n.cell = user_id"
        ),
        "gridded_sst": f"""SELECT STATION, '' AS NAME, DATE, {r('t', 'TAVG')}, {r('t', 'TMAX')}, {r('t', 'TMIN')},
  CAST(NULL AS DOUBLE) AS PRCP, CAST(NULL AS DOUBLE) AS SNWD
FROM (SELECT {point} AS STATION, CAST(ts AS DATE) AS DATE, avg(value) * 0.01 AS t
      FROM events WHERE event_type = 'view' AND value IS NOT NULL GROUP BY ALL)""",
    }


def oracle_sql() -> dict[str, str]:
    statements = _on_daily()
    out = {name: sql.replace("@SD@", _SD["supplier"]) for name, sql in statements.items()}
    out |= {f"{name}_dense": statements[name].replace("@SD@", _SD["region"]) for name in DENSE}
    return out | _on_tables()
