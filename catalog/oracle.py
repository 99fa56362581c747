"""The registered queries in SQL, written independently of the Spark operators.

Interpolation compares all pairs, regression coefficients come from repeated
one-variable regressions on residuals, and tail probabilities from numerical
integration, so none of the shortcuts of the Spark side is shared.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

WEATHER_MEASURES = (
    "tm_avg", "tm_min", "tm_max", "pr_day", "hm_avg", "ss_dura_sum", "rad_sum", "ws_avg",
)
ROLLUP_MEASURES = ("tm_avg", "tm_min", "tm_max", "pr_sum", "hm_avg", "ss_dura", "rad_avg")
IDW_MEASURES = ROLLUP_MEASURES[:-1]
PERIODS = ("P1", "P2", "P3", "P4", "P5")
GRAIN_PART = {"month": (), "tenday": ("ten_day",), "half": ("half",)}


def rnd(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)


def commas(names: Iterable[str]) -> str:
    return ", ".join(names)


# ---------------------------------------------------------------- input tables


def weather(sparse: bool = False) -> str:
    measured = "l_returnflag = 'R'" if sparse else "l_returnflag <> 'N'"
    return f"""weather AS (
  SELECT CAST(l_suppkey AS INTEGER) AS station, strftime(l_shipdate, '%Y-%m-%d') AS "date",
         l_quantity AS tm_avg,
         l_quantity - round(CAST(100 AS DOUBLE) * l_discount) AS tm_min,
         l_quantity + round(CAST(100 AS DOUBLE) * l_tax) AS tm_max,
         CASE WHEN l_linestatus = 'O' THEN NULL ELSE round(CAST(100 AS DOUBLE) * l_discount) END AS pr_day,
         CASE WHEN l_linenumber >= 5 THEN NULL
              ELSE CAST(40 AS DOUBLE) + CAST(5 AS DOUBLE) * l_linenumber END AS hm_avg,
         round(CAST(100 AS DOUBLE) * l_tax) AS ss_dura_sum,
         CASE WHEN {measured} THEN l_extendedprice / CAST(997.3 AS DOUBLE) END AS rad_sum,
         l_linenumber + round(CAST(100 AS DOUBLE) * l_discount) AS ws_avg
  FROM lineitem)"""


DAMAGED = """damaged AS (
  SELECT CASE CAST(tm_avg AS BIGINT) % 7 WHEN 0 THEN 'junk'
              WHEN 1 THEN CAST(station AS VARCHAR) || '.7' WHEN 2 THEN NULL
              WHEN 4 THEN CAST(station AS VARCHAR) || 'd'
              ELSE CAST(station AS VARCHAR) END AS station,
         CASE WHEN CAST(tm_avg AS BIGINT) % 7 = 3 THEN substring("date", 1, 7)
              ELSE "date" END AS "date",
         tm_avg, tm_min, tm_max, pr_day, hm_avg, ss_dura_sum, rad_sum, ws_avg FROM weather)"""

STATIONS = """stations AS (
  SELECT CAST(s_suppkey AS INTEGER) AS station,
         33 + ((s_suppkey * 37 + 11) % 101) / CAST(20.2 AS DOUBLE) AS latitude,
         126 + ((s_suppkey * 53 + 7) % 103) / CAST(25.7 AS DOUBLE) AS longitude,
         r_name AS wide, s_name AS station_name, n_name AS region
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""

HISTORY = (
    STATIONS
    + """, history AS (
  SELECT *, '1973-01-01' AS date_start FROM stations
  UNION ALL
  SELECT *, CAST(1980 + station % 20 AS VARCHAR) || '-05-01' AS date_start FROM stations)"""
)

MOVES = (
    STATIONS
    + """, moves AS (
  SELECT *, '1973-01-01' AS valid_from,
         CASE WHEN station % 3 > 0 THEN moved ELSE '9999' END AS valid_to
  FROM (SELECT *, CAST(1992 + station % 6 AS VARCHAR) || '-0' || CAST(1 + station % 9 AS VARCHAR)
                  || '-1' || CAST(station % 10 AS VARCHAR) AS moved FROM stations)
  UNION ALL
  SELECT station, 33 + ((station * 41 + 5) % 101) / CAST(20.2 AS DOUBLE),
         126 + ((station * 59 + 13) % 103) / CAST(25.7 AS DOUBLE), wide, station_name || '_B', region,
         NULL, CAST(1992 + station % 6 AS VARCHAR) || '-0' || CAST(1 + station % 9 AS VARCHAR)
               || '-1' || CAST(station % 10 AS VARCHAR), '9999'
  FROM stations WHERE station % 3 > 0)"""
)

GEO = """geo AS (
  SELECT r_name AS wide, n_name AS region,
         CAST(33.013 AS DOUBLE) + ((n_nationkey * 7 + 3) % 25) / CAST(5 AS DOUBLE) AS lat,
         CAST(126.017 AS DOUBLE) + ((n_nationkey * 11 + 5) % 25) / CAST(6.25 AS DOUBLE) AS lng
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""

YIELDS = """yields AS (
  SELECT r_name AS wide, n_name AS region, CAST(year(o_orderdate) AS INTEGER) AS "year",
         CAST(count(*) AS DOUBLE) AS area_ha, avg(o_totalprice) / CAST(997.3 AS DOUBLE) AS prod_10a_kg,
         sum(o_totalprice) / CAST(997.3 AS DOUBLE) AS prod_ton
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3)"""
YIELD_DOUBLES = ("area_ha", "prod_10a_kg", "prod_ton")

KOREAN = (
    YIELDS
    + """, named AS (
  SELECT CASE number % 8 WHEN 0 THEN '충청남도' WHEN 1 THEN '경기도' WHEN 2 THEN '강원도'
              WHEN 3 THEN '제주도' WHEN 4 THEN '서울특별시' WHEN 5 THEN '부산광역시'
              WHEN 6 THEN '전라북도' END AS wide,
         CASE WHEN number % 9 = 0 THEN '소계' ELSE region END AS region,
         "year", area_ha, prod_10a_kg, prod_ton
  FROM (SELECT *, CAST(replace(region, 'NATION_', '') AS INTEGER) AS number FROM yields))"""
)
ABBREVIATED = """CASE WHEN wide IN ('경기도', '강원도', '제주도') THEN substring(wide, 1, 2)
         ELSE substring(wide, 1, 1) || substring(wide, 3, 1) END"""


YEARS = """years AS (
  SELECT unnest(range(first, last + 1)) AS y
  FROM (SELECT min("year") AS first, max("year") AS last FROM daily))"""

ALL_REGIONS = """listed AS (
  SELECT DISTINCT wide, region FROM stations UNION ALL
  SELECT DISTINCT wide, region || '_NEW' FROM stations)"""


def calendar(source: str = "weather", name: str = "daily") -> str:
    return f"""{name} AS (
  SELECT *, CASE WHEN "day" >= 15 THEN 1 WHEN "day" IS NOT NULL THEN 2 END AS half,
         CASE WHEN "day" <= 10 THEN 1 WHEN "day" >= 21 THEN 3
              WHEN "day" IS NOT NULL THEN 2 END AS ten_day
  FROM (SELECT *, TRY_CAST(substring("date", 1, 4) AS INTEGER) AS "year",
               TRY_CAST(substring("date", 6, 2) AS INTEGER) AS "month",
               TRY_CAST(substring("date", 9, 2) AS INTEGER) AS "day" FROM {source}))"""


def keys(grain: str) -> list[str]:
    return ["station", '"year"', '"month"', *GRAIN_PART[grain]]


def labelled(grain: str) -> str:
    """The grain's name, and null for the time keys of other grains."""
    others = [p for g, parts in GRAIN_PART.items() if g != grain for p in parts]
    return commas([f"'{grain}' AS grain", *[f"CAST(NULL AS INTEGER) AS {p}" for p in others]])


def rollup(grain: str, complete: bool = False, name: str = "rolled") -> str:
    having = (
        "HAVING count(rad_sum) > 0 AND count(hm_avg) > 0 AND count(ss_dura_sum) > 0"
        if complete
        else ""
    )
    return f"""{name} AS (
  SELECT {commas(keys(grain))}, avg(tm_avg) AS tm_avg, avg(tm_min) AS tm_min,
         avg(tm_max) AS tm_max, coalesce(sum(pr_day), CAST(0 AS DOUBLE)) AS pr_sum,
         avg(hm_avg) AS hm_avg, avg(ss_dura_sum) AS ss_dura, avg(rad_sum) AS rad_avg
  FROM daily GROUP BY {commas(keys(grain))} {having})"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


# ------------------------------------------------------------------ stage A


def stage_a() -> dict[str, str]:
    w = weather()
    out = {
        "calendar_parts": with_(w, DAMAGED, calendar("damaged"))
        + 'SELECT station, "date", "year", "month", "day", half, ten_day FROM daily',
        "tenday_key": with_(w, DAMAGED, calendar("damaged"))
        + """SELECT station, "date", "month", ten_day,
             CAST("month" AS VARCHAR) || '_' || CAST(ten_day AS VARCHAR) AS mon_third,
             ("month" - 1) * 3 + ten_day AS tenday_no FROM daily""",
        "projection": with_(w, calendar())
        + f"""SELECT station, "date", "year", "month", "day", half, ten_day,
             {rnd('tm_avg', 'tm_min', 'tm_max', 'pr_day', 'hm_avg', 'ss_dura_sum', 'rad_sum')}
             FROM daily""",
        "projection_at": with_(w, calendar())
        + f"""SELECT station, "date", "year", "month", "day", half, ten_day,
             {rnd(*WEATHER_MEASURES)} FROM daily""",
        "csv_mixed_headers": with_(STATIONS)
        + """SELECT station, round(round(latitude, 4), 6) + 0.0 AS latitude, wide, station_name, region
             FROM stations WHERE station % 7 <> 3""",
        "csv_damaged_rows": with_(STATIONS)
        + """SELECT station, CAST(5 AS INTEGER) AS fields, CASE WHEN station % 2 = 0
             THEN CAST(station AS VARCHAR) || ',unknown,' || wide || ',' || station_name || ',' || region
             ELSE region || ',' || station_name || ',' || wide || ',unknown,' || CAST(station AS VARCHAR)
             END AS line FROM stations WHERE station % 7 = 3""",
        "drop_column": with_(HISTORY)
        + f"""SELECT station, {rnd('latitude', 'longitude')}, wide, region, date_start
             FROM history""",
        "rename_columns": with_(YIELDS)
        + f'SELECT wide, region, "year", {rnd(*YIELD_DOUBLES)} FROM yields',
        "placeholder_columns": with_(STATIONS)
        + f"""SELECT station, {rnd('latitude', 'longitude')}, wide, station_name, region,
             CAST(NULL AS DOUBLE) AS tm_avg, CAST(NULL AS DOUBLE) AS pr_sum FROM stations""",
        "station_year_start": with_(HISTORY)
        + """SELECT station, date_start, CAST(substring(date_start, 1, 4) AS INTEGER) AS year_start
             FROM history""",
        "station_tally": with_(w) + "SELECT station, count(*) AS n FROM weather GROUP BY station",
        "wind_profile": with_(w)
        + """SELECT round(avg(ws_max), 6) + 0.0 AS ws_max_mean, round(max(ws_max), 6) + 0.0 AS ws_max_max,
             round(avg(ws), 6) + 0.0 AS ws_avg_mean, round(max(ws), 6) + 0.0 AS ws_avg_max,
             count(CASE WHEN ws > 9 THEN 1 END) AS n_gt,
             count(CASE WHEN ws > 9 OR ws IS NULL THEN 1 END) AS n_gt_or_null
             FROM (SELECT ws_avg + ss_dura_sum AS ws_max,
                          CASE WHEN hm_avg IS NOT NULL THEN ws_avg END AS ws FROM weather)""",
        "region_geo_join": with_(STATIONS, GEO, ALL_REGIONS)
        + """SELECT a.wide, a.region, round(b.lat, 6) + 0.0 AS lat, round(b.lng, 6) + 0.0 AS lng
             FROM listed a LEFT JOIN geo b
             ON a.wide = b.wide AND a.region = b.region""",
        "region_grid": with_(STATIONS, weather(), calendar(), YEARS)
        + """SELECT wide, region, CAST(y AS INTEGER) AS "year", CAST(m AS INTEGER) AS "month"
             FROM (SELECT DISTINCT wide, region FROM stations), years, range(1, 13) ms(m)""",
    }
    for grain in GRAIN_PART:
        k, suffix = commas(keys(grain)), "" if grain == "month" else f"_{grain}"
        shown = f"{k}, {rnd(*ROLLUP_MEASURES)}"
        out[f"rollup_{grain}"] = (
            with_(w, calendar(), rollup(grain)) + f"SELECT {shown} FROM rolled"
        )
        out[f"complete_groups{suffix}"] = (
            with_(w, calendar(), rollup(grain, True)) + f"SELECT {shown} FROM rolled"
        )
        out[f"trim_edge_groups{suffix}"] = (
            with_(w, calendar(), rollup(grain))
            + f"""SELECT {shown} FROM (SELECT *, row_number() OVER (ORDER BY {k}) AS i,
                 count(*) OVER () AS total FROM rolled) WHERE i > 5 AND i < total"""
        )
    for name, grain, n in (("drop_row_at", "month", 700), ("drop_row_at_far", "tenday", 12345)):
        out[name] = (
            with_(w, calendar(), rollup(grain))
            + f"""SELECT {commas(keys(grain))}, {rnd(*ROLLUP_MEASURES)} FROM (SELECT *,
                 row_number() OVER (ORDER BY {commas(keys(grain))}) AS i FROM rolled) WHERE i <> {n}"""
        )
    out["rollup_all_grains"] = "\nUNION ALL BY NAME\n".join(
        f"SELECT {labelled(grain)}, * FROM ({out[f'rollup_{grain}']})" for grain in GRAIN_PART
    )
    k = commas(keys("tenday"))
    out["drop_rows_at"] = (
        with_(w, calendar(), rollup("tenday"))
        + f"""SELECT {k}, {rnd(*ROLLUP_MEASURES)} FROM (SELECT *, row_number() OVER (ORDER BY {k}) AS i,
             count(*) OVER () AS total FROM rolled) WHERE i > 5 AND i < total AND i <> 12345"""
    )
    out["valid_keys"] = (
        with_(w, DAMAGED, calendar("damaged"), rollup("tenday", True))
        + f"""SELECT {commas(keys('tenday'))}, {rnd(*ROLLUP_MEASURES)} FROM rolled
             WHERE station IS NOT NULL AND "year" IS NOT NULL AND "month" IS NOT NULL
             AND ten_day IS NOT NULL"""
    )
    month = with_(w, calendar(), rollup("month", True))
    out["coverage_long"] = (
        month + """SELECT "year", "month", station, count(*) AS n FROM rolled GROUP BY ALL"""
    )
    slots = commas(
        f"CASE WHEN count(*) FILTER (station % 100 = {j}) > 0 THEN "
        f"count(*) FILTER (station % 100 = {j}) END AS s{j}"
        for j in range(100)
    )
    for suffix, grain in (("", "month"), ("_tenday", "tenday"), ("_half", "half")):
        time = commas(keys(grain)[1:])
        out[f"coverage_matrix{suffix}"] = (
            with_(w, calendar(), rollup(grain, True))
            + f"""SELECT {time}, CAST(station // 100 AS INTEGER) AS tile, {slots}
                 FROM rolled GROUP BY {time}, CAST(station // 100 AS INTEGER)"""
        )
    for name, grain in (
        ("station_count", "month"), ("coverage_tenday", "tenday"), ("coverage_half", "half"),
    ):
        t = commas(keys(grain)[1:])
        out[name] = (
            with_(w, calendar(), rollup(grain, True))
            + f"SELECT {t}, count(DISTINCT station) AS station_num FROM rolled GROUP BY {t}"
        )
    return out


NEIGHBOURS = """neighbours AS (
  SELECT wide, region, CAST(i AS INTEGER) AS rank, station, dist FROM (
    SELECT *, row_number() OVER (PARTITION BY wide, region ORDER BY dist, station) AS i FROM (
      SELECT g.wide, g.region, s.station,
             sqrt((s.latitude - g.lat) * (s.latitude - g.lat)
                  + (s.longitude - g.lng) * (s.longitude - g.lng)) AS dist
      FROM geo g, stations s)) WHERE i <= 10)"""


def chosen(grain: str) -> str:
    time = commas(f"r.{k}" for k in keys(grain)[1:])
    return f"""chosen AS (
  SELECT * FROM (
    SELECT n.wide, n.region, {time}, n.station, n.dist, {commas('r.' + m for m in IDW_MEASURES)},
           row_number() OVER (PARTITION BY n.wide, n.region, {time} ORDER BY n.dist, n.station) AS place
    FROM neighbours n JOIN rolled r ON n.station = r.station) WHERE place <= 3)"""


def idw(grain: str, station_order: bool = False, regions: str = "geo") -> str:
    time = keys(grain)[1:]
    by = commas(["wide", "region", *time])
    parts = [weather(True), calendar(), YEARS, rollup(grain, True), STATIONS, GEO, ALL_REGIONS,
             NEIGHBOURS, chosen(grain)]
    if station_order:
        parts.append(
            f"""by_dist AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY dist) AS p FROM chosen),
by_station AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY station) AS p FROM chosen),
paired AS (SELECT {commas('v.' + c for c in ['wide', 'region', *time])}, d.dist,
                  {commas('v.' + m for m in IDW_MEASURES)}
           FROM by_dist d JOIN by_station v
           USING ({by}, p))"""
        )
    source = "paired" if station_order else "chosen"
    means = commas(
        f"CASE WHEN count({m}) = count(*) THEN sum({m} / dist) / sum(1 / dist) END AS {m}"
        for m in IDW_MEASURES
    )
    parts.append(f"filled AS (SELECT {by}, {means} FROM {source} GROUP BY {by})")
    extra = {"month": "", "tenday": ", range(1, 4) ps(p)", "half": ", range(1, 3) ps(p)"}[grain]
    extra_col = "".join(f", CAST(p AS INTEGER) AS {c}" for c in GRAIN_PART[grain])
    parts.append(
        f"""grid AS (SELECT wide, region, CAST(y AS INTEGER) AS "year", CAST(m AS INTEGER) AS "month"{extra_col}
           FROM {regions}, years, range(1, 13) ms(m){extra})"""
    )
    return with_(*parts) + f"SELECT {by}, {rnd(*IDW_MEASURES)} FROM grid LEFT JOIN filled USING ({by})"


def idw_all_grains() -> str:
    return "\nUNION ALL BY NAME\n".join(
        f"SELECT {labelled(grain)}, * FROM ({idw(grain)})" for grain in GRAIN_PART
    )


def spatial() -> dict[str, str]:
    base = with_(STATIONS, GEO, NEIGHBOURS)
    wide = commas(
        [f"max(station) FILTER (rank = {r}) AS st{r}" for r in range(1, 11)]
        + [f"round(max(dist) FILTER (rank = {r}), 6) + 0.0 AS dist{r}" for r in range(1, 11)]
    )
    return {
        "knn_long": base + f"SELECT wide, region, rank, station, {rnd('dist')} FROM neighbours",
        "knn_many_regions": with_(
            STATIONS,
            """geo AS (SELECT c_mktsegment AS wide, c_name AS region,
           CAST(33.013 AS DOUBLE) + ((c_custkey * 29 + 3) % 499) / CAST(99.8 AS DOUBLE) AS lat,
           CAST(126.017 AS DOUBLE) + ((c_custkey * 31 + 5) % 397) / CAST(99.25 AS DOUBLE) AS lng
           FROM customer)""",
            NEIGHBOURS,
        )
        + f"SELECT wide, region, rank, station, {rnd('dist')} FROM neighbours",
        "knn_wide": base + f"SELECT wide, region, {wide} FROM neighbours GROUP BY wide, region",
        "nearest_reporting": with_(
            weather(True), calendar(), rollup("month", True), STATIONS, GEO, NEIGHBOURS,
            chosen("month"),
        )
        + f"""SELECT wide, region, "year", "month", CAST(place AS INTEGER) AS place, station,
             {rnd('dist', 'tm_avg')} FROM chosen""",
        "idw_month": idw("month"),
        "idw_tenday": idw("tenday"),
        "idw_half": idw("half"),
        "idw_station_order": idw("month", station_order=True),
        "csv_roundtrip": idw("month"),
        "idw_month_history": idw("month"),
        "idw_all_grains": idw_all_grains(),
        "idw_late_reports": idw_all_grains(),
        "idw_unlocated_region": idw("month", regions="listed"),
        "station_join_as_of": with_(weather(), MOVES)
        + """SELECT w.station, w."date", round(w.tm_avg, 6) + 0.0 AS tm_avg, m.wide, m.station_name, m.region
             FROM weather w LEFT JOIN moves m ON w.station = m.station
             AND w."date" >= m.valid_from AND w."date" < m.valid_to""",
        "idw_month_moved_station": with_(
            weather(True), calendar(), YEARS, rollup("month", True), MOVES, GEO,
            """grid AS (SELECT wide, region, lat, lng, CAST(y AS INTEGER) AS "year", CAST(m AS INTEGER) AS "month",
           CAST(y AS VARCHAR) || '-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-01' AS start
           FROM geo, years, range(1, 13) ms(m))""",
            """neighbours AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY wide, region, start ORDER BY dist, station) AS rank FROM (
    SELECT g.wide, g.region, g."year", g."month", g.start, s.station,
           sqrt((s.latitude - g.lat) * (s.latitude - g.lat)
                + (s.longitude - g.lng) * (s.longitude - g.lng)) AS dist
    FROM grid g JOIN moves s ON s.valid_from <= g.start AND g.start < s.valid_to)) WHERE rank <= 10)""",
            f"""chosen AS (SELECT * FROM (
  SELECT n.wide, n.region, n."year", n."month", n.station, n.dist, {commas('r.' + m for m in IDW_MEASURES)},
         row_number() OVER (PARTITION BY n.wide, n.region, n.start ORDER BY n.dist, n.station) AS place
  FROM neighbours n JOIN rolled r ON n.station = r.station AND n."year" = r."year" AND n."month" = r."month")
  WHERE place <= 3)""",
            'filled AS (SELECT wide, region, "year", "month", '
            + commas(
                f"CASE WHEN count({m}) = count(*) THEN sum({m} / dist) / sum(1 / dist) END AS {m}"
                for m in IDW_MEASURES
            )
            + ' FROM chosen GROUP BY wide, region, "year", "month")',
        )
        + f"""SELECT wide, region, "year", "month", {rnd(*IDW_MEASURES)}
             FROM grid LEFT JOIN filled USING (wide, region, "year", "month")""",
    }


# ------------------------------------------------------------------ stage B


def cleaning() -> dict[str, str]:
    w = weather()
    safe = """safe AS (SELECT CAST(trunc(TRY_CAST(station AS DOUBLE)) AS INTEGER) AS station,
           "date", tm_avg FROM damaged WHERE TRY_CAST(station AS DOUBLE) IS NOT NULL)"""
    joined = """SELECT w.station, w."date", round(w.tm_avg, 6) + 0.0 AS tm_avg, s.wide,
             s.station_name, s.region FROM {} w LEFT JOIN {} s ON w.station = s.station"""
    latest = """latest AS (SELECT station, latitude, longitude, wide, station_name, region,
           date_start FROM (SELECT *, row_number() OVER (PARTITION BY station
           ORDER BY date_start DESC) AS i FROM history) WHERE i = 1)"""
    return {
        "fill_precip": with_(w)
        + """SELECT station, "date", round(coalesce(pr_day, 0), 6) + 0.0 AS pr_day FROM weather""",
        "safe_station": with_(w, DAMAGED, safe)
        + f'SELECT station, "date", {rnd("tm_avg")} FROM safe',
        "station_join": with_(w, DAMAGED, safe, STATIONS) + joined.format("safe", "stations"),
        "station_history_join": with_(w, HISTORY) + joined.format("weather", "history"),
        "station_latest_join": with_(w, HISTORY, latest) + joined.format("weather", "latest"),
        "latest_station": with_(HISTORY, latest)
        + f"""SELECT station, {rnd('latitude', 'longitude')}, wide, station_name, region,
             date_start FROM latest""",
        "date_length_filter": with_(w, DAMAGED)
        + f'SELECT station, "date", {rnd("tm_avg")} FROM damaged WHERE length("date") >= 10',
        "province_in": with_(w, STATIONS)
        + f"""SELECT station, "date", wide, {rnd('tm_avg')} FROM weather JOIN stations USING (station)
             WHERE wide IN ('AMERICA', 'ASIA', 'EUROPE')""",
        "equal_filter": with_(w, calendar(), STATIONS)
        + f"""SELECT station, "date", wide, {rnd('tm_avg')} FROM daily JOIN stations USING (station)
             WHERE wide = 'ASIA' AND "month" = 5""",
        "since_year": with_(w, calendar())
        + f'SELECT station, "date", "year", {rnd("tm_avg")} FROM daily WHERE "year" >= 1998',
        "parquet_stage": with_(w, calendar(), STATIONS)
        + f"""SELECT station, "date", "year", "month", "day", half, ten_day, wide, station_name, region,
             round(coalesce(pr_day, 0), 6) + 0.0 AS pr_day,
             {rnd('tm_avg', 'tm_min', 'tm_max', 'hm_avg', 'ss_dura_sum', 'ws_avg')}
             FROM daily LEFT JOIN stations USING (station)""",
        "region_day_mean": with_(w, STATIONS)
        + """SELECT "date", region, wide, """
        + commas(
            f"round(avg({m}), 6) + 0.0 AS {m}"
            for m in ("tm_avg", "tm_min", "tm_max", "pr_day", "hm_avg", "ss_dura_sum", "rad_sum")
        )
        + """, round(max(ws_avg), 6) + 0.0 AS ws_max
             FROM weather LEFT JOIN stations USING (station) GROUP BY "date", region, wide""",
        "since_year_damaged": with_(w, DAMAGED, calendar("damaged"))
        + f"""SELECT station, CASE WHEN CAST(tm_avg AS BIGINT) % 5 <> 0 THEN "date" END AS "date", "year",
             {rnd('tm_avg')} FROM daily WHERE "year" >= 1998""",
        "tenday_tally": with_(w, calendar())
        + """SELECT ("month" - 1) * 3 + ten_day AS tenday_no, "month", ten_day, count(*) AS n
             FROM daily GROUP BY 1, 2, 3""",
    }


def yield_tables() -> dict[str, str]:
    shown = f'wide, region, "year", {rnd(*YIELD_DOUBLES)}'
    detrended = rnd("prod_trend", "prod_norm")
    trend = """(SELECT regr_intercept(prod_10a_kg, "year") AS a, regr_slope(prod_10a_kg, "year") AS b
             FROM {}) t"""
    return {
        "regex_exclude": with_(KOREAN)
        + f"""SELECT {shown} FROM named
             WHERE coalesce(wide NOT LIKE '%광역%' AND wide NOT LIKE '%특별%', true)
             AND coalesce(region <> '소계', true)""",
        "province_abbrev": with_(KOREAN) + f"SELECT {shown}, {ABBREVIATED} AS short FROM named",
        "yield_union": with_(YIELDS) + f"SELECT {shown} FROM yields",
        "yield_trend": with_(YIELDS)
        + """SELECT round(regr_intercept(prod_10a_kg, "year"), 6) + 0.0 AS intercept,
             round(regr_slope(prod_10a_kg, "year"), 6) + 0.0 AS slope,
             round(regr_r2(prod_10a_kg, "year"), 6) + 0.0 AS r2,
             CAST(regr_count(prod_10a_kg, "year") AS BIGINT) AS n FROM yields""",
        "yield_detrend": with_(YIELDS)
        + f"""SELECT {shown}, {detrended} FROM (SELECT y.*, a + b * "year" AS prod_trend,
             prod_10a_kg - (a + b * "year") AS prod_norm FROM yields y, {trend.format('yields')})""",
        "normalized_yields": with_(KOREAN)
        + f"""SELECT {ABBREVIATED} AS wide, region, "year", {rnd(*YIELD_DOUBLES)}, {detrended}
             FROM (SELECT y.*, a + b * "year" AS prod_trend,
             prod_10a_kg - (a + b * "year") AS prod_norm FROM named y, {trend.format('named')})
             WHERE coalesce(wide NOT LIKE '%광역%' AND wide NOT LIKE '%특별%', true)""",
    }


# Period offsets per transplant month.
RULES = {
    "m5": (("P1", 0, 0), ("P2", 1, 5), ("P3", 6, 6), ("P4", 7, 8), ("P5", 9, 10)),
    "m5_literal": (("P1", 0, 0), ("P2", 1, 5), ("P3", 6, 99)),
    "m6": (("P1", 0, 0), ("P2", 1, 5), ("P3", 6, 6), ("P4", 7, 8), ("P5", 9, 10)),
    "m7": (("P1", 0, 2), ("P2", 3, 4), ("P3", 5, 7), ("P4", 8, 10)),
}


def period_case(rule: str, start: int) -> str:
    number = '(("month" - 1) * 3 + ten_day)'
    whens = " ".join(
        f"WHEN {number} - {start} BETWEEN {lo} AND {hi} THEN '{p}'" for p, lo, hi in RULES[rule]
    )
    return f"CASE {whens} END"


# Variable and statistic of each feature.
FEATURES = (
    ("tm_avg", "avg(tm_avg)"),
    ("tm_min", "avg(tm_min)"),
    ("tm_max", "avg(tm_max)"),
    ("hm_avg", "avg(hm_avg)"),
    ("pr_day", "coalesce(sum(coalesce(pr_day, 0)), 0)"),
    ("ss_dura_sum", "avg(ss_dura_sum)"),
    ("ws_avg", "max(ws_avg)"),
    ("gdd10c", "greatest(coalesce(sum(tm_avg - 10), 0), 0)"),
)
FEATURE_COLUMNS = tuple(f"{f}_{p}" for f, _ in FEATURES for p in PERIODS)


def classified(rule: str = "m5", start: int = 15) -> list[str]:
    return [
        weather(),
        calendar(),
        STATIONS,
        f"""classified AS (SELECT * FROM (SELECT *, {period_case(rule, start)} AS period
           FROM daily JOIN stations USING (station) WHERE "year" >= 1996) WHERE period IS NOT NULL)""",
    ]


def pivoted(features: Sequence[tuple[str, str]], by: Sequence[str]) -> str:
    cells = commas(
        f"max(CASE WHEN period = '{p}' THEN {f} END) AS {f}_{p}"
        for f, _ in features
        for p in PERIODS
    )
    stats = commas(f"{sql} AS {f}" for f, sql in features)
    return f"""features AS (SELECT {commas(by)}, {cells} FROM (
    SELECT {commas(by)}, period, {stats} FROM classified GROUP BY {commas(by)}, period)
    GROUP BY {commas(by)})"""


REGION_YEAR = ("wide", "region", '"year"')

# Period offsets, transplant ten-days and (sample) provinces of the six calendars.
RULES |= {
    "early": (("P1", 0, 0), ("P2", 1, 6), ("P3", 7, 9), ("P4", 10, 12), ("P5", 13, 14)),
    "late": (("P1", 0, 0), ("P2", 1, 5), ("P3", 6, 8), ("P4", 9, 10), ("P5", 11, 13)),
}
CALENDARS = (
    ("south_may", "'AMERICA', 'ASIA'", "m5", 15),
    ("south_june", "'AMERICA', 'ASIA'", "m6", 16),
    ("middle_may", "'EUROPE', 'AFRICA'", "m5", 15),
    ("middle_june", "'EUROPE', 'AFRICA'", "m6", 16),
    ("mountain_early", "'MIDDLE EAST'", "early", 13),
    ("mountain_late", "'MIDDLE EAST'", "late", 14),
)


def classified_calendars(where: str = "") -> list[str]:
    each = "\nUNION ALL\n".join(
        f"SELECT *, '{name}' AS calendar, {period_case(rule, start)} AS period FROM daily "
        f"JOIN stations USING (station) WHERE wide IN ({provinces})"
        for name, provinces, rule, start in CALENDARS
    )
    return [weather(), calendar(), STATIONS,
            f"classified AS (SELECT * FROM ({each}) WHERE period IS NOT NULL {where})"]


def phenology() -> dict[str, str]:
    out = {}
    for rule, month in (("m5", 5), ("m5_literal", 5), ("m6", 6), ("m7", 7)):
        start = (month - 1) * 3 + 3
        out[f"classify_{rule}"] = (
            with_(weather(), calendar())
            + f"""SELECT station, "date", ("month" - 1) * 3 + ten_day AS tenday_no,
                 {period_case(rule, start)} AS period FROM daily
                 WHERE {period_case(rule, start)} IS NOT NULL"""
        )
    offset = """("month" - 1) * 3 + ten_day - (CASE WHEN wide IN ('ASIA', 'EUROPE') THEN 14 ELSE 16 END)"""
    out["classify_by_group"] = (
        with_(weather(), calendar(), STATIONS)
        + f"""SELECT * FROM (SELECT station, "date", wide, ("month" - 1) * 3 + ten_day AS tenday_no,
             CASE WHEN {offset} = 0 THEN 'P1' WHEN {offset} BETWEEN 1 AND 5 THEN 'P2'
                  WHEN {offset} BETWEEN 6 AND 8 THEN 'P3' WHEN {offset} BETWEEN 9 AND 10 THEN 'P4'
                  WHEN {offset} >= 11 THEN 'P5' END AS period
             FROM daily JOIN stations USING (station)) WHERE period IS NOT NULL"""
    )
    for name, var, sql in (
        ("period_mean", "hm_avg", "avg(hm_avg)"),
        ("period_sum", "pr_day", FEATURES[4][1]),
        ("period_max", "ws_avg", "max(ws_avg)"),
        ("period_min", "tm_min", "min(tm_min)"),
        ("period_gdd10c", "gdd10c", FEATURES[7][1]),
    ):
        out[name] = (
            with_(*classified(), pivoted([(var, sql)], REGION_YEAR))
            + f"""SELECT wide, region, "year", {rnd(*[f'{var}_{p}' for p in PERIODS])}
                 FROM features"""
        )
    shown = rnd(*FEATURE_COLUMNS)
    for name, rule, start in (
        ("feature_table", "m5", 15), ("feature_table_history", "m5", 15), ("feature_table_m5_literal", "m5_literal", 15),
        ("feature_table_m7", "m7", 19),
    ):
        out[name] = (
            with_(*classified(rule, start), pivoted(FEATURES, REGION_YEAR))
            + f'SELECT wide, region, "year", {shown} FROM features'
        )
    by_calendar = ("calendar", *REGION_YEAR)
    out["classify_calendars"] = (
        with_(*classified_calendars())
        + """SELECT station, "date", wide, ("month" - 1) * 3 + ten_day AS tenday_no, calendar, period
             FROM classified"""
    )
    each = [*classified_calendars('AND "year" >= 1996'), pivoted(FEATURES, by_calendar)]
    out["feature_table_calendars"] = (
        with_(*each) + f'SELECT calendar, wide, region, "year", {shown} FROM features'
    )
    out["feature_yield_calendars"] = (
        with_(*each, YIELDS)
        + f"""SELECT calendar, wide, region, "year", {rnd('prod_10a_kg')}, {shown}
             FROM features LEFT JOIN yields USING (wide, region, "year") WHERE "year" <> 2001"""
    )
    out["feature_yield"] = (
        with_(*classified(), pivoted(FEATURES, REGION_YEAR), YIELDS)
        + f"""SELECT wide, region, "year", {rnd('prod_10a_kg')}, {shown}
             FROM features LEFT JOIN yields USING (wide, region, "year") WHERE "year" <> 2001"""
    )
    out["feature_yield_wide"] = (
        with_(*classified(), pivoted(FEATURES, ("wide", '"year"')), YIELDS)
        + f"""SELECT wide, region, "year", {rnd('prod_10a_kg')}, {shown}
             FROM features LEFT JOIN yields USING (wide, "year") WHERE "year" <> 2001"""
    )
    return out


# ------------------------------------------------------------------ stage C

# Predictor variable and squared periods of each model.
MODELS = {
    "tm_avg": ("tm_avg", ("P4",)),
    "tm_min": ("tm_min", ("P3",)),
    "tm_max": ("tm_max", ("P3", "P5")),
    "hm_avg": ("hm_avg", ("P4",)),
    "pr_day": ("pr_day", ("P1", "P2", "P4")),
    "ss_dura_sum": ("ss_dura_sum", ("P2",)),
    "ws_max": ("ws_avg", ("P2",)),
    "gdd10c": ("gdd10c", ("P3",)),
}
ALL_VARS = ("y", "x1", "x2", "x3", "x4", "x5")

OBSERVATIONS = [
    *classified(),
    pivoted(FEATURES, REGION_YEAR),
    YIELDS,
    """observed AS (SELECT * FROM features LEFT JOIN yields USING (wide, region, "year")
           WHERE "year" <> 2021)""",
]


def term_names(model: str, squared: bool) -> list[str]:
    var, squares = MODELS[model]
    return [f"{var}_{p}^2" if squared and p in squares else f"{var}_{p}" for p in PERIODS]


def cases(models: Iterable[tuple[str, bool]], group: str = "") -> str:
    """Complete cases of several models on top of each other, keyed by ``m``."""
    lead = f"{group}, " if group else ""
    parts = []
    for model, squared in models:
        var, squares = MODELS[model]
        xs = [
            f"{var}_{p} * {var}_{p}" if squared and p in squares else f"{var}_{p}"
            for p in PERIODS
        ]
        present = " AND ".join(f"{var}_{p} IS NOT NULL" for p in PERIODS)
        name = model + ("_sq" if squared else "")
        parts.append(
            f"SELECT {lead}'{name}' AS m, prod_10a_kg AS y, "
            + commas(f"{x} AS x{i}" for i, x in enumerate(xs, 1))
            + f" FROM observed WHERE prod_10a_kg IS NOT NULL AND {present}"
        )
    return "cases AS (" + "\nUNION ALL\n".join(parts) + ")"


def residualized(prefix: str, by: str, on: Sequence[str], vars_: Sequence[str]) -> list[str]:
    """Take each variable in ``on`` out of the others, one simple regression at a time."""
    out, source, left = [], "cases", list(vars_)
    for step, z in enumerate(on):
        left = [v for v in left if v != z]
        cols = commas(
            f"{v} - regr_intercept({v}, {z}) OVER g - regr_slope({v}, {z}) OVER g * {z} AS {v}"
            for v in left
        )
        name = f"{prefix}{step}"
        out.append(
            f"{name} AS (SELECT {by}, {cols} FROM {source} WINDOW g AS (PARTITION BY {by}))"
        )
        source = name
    return out


def regression_parts(by: str) -> list[str]:
    """CTEs: raw moments, residual sum of squares, and slope with partial spread per term."""
    parts = [
        f"""sizes AS (SELECT {by}, count(*) AS n, avg(y) AS my, var_pop(y) * count(*) AS tss,
           {commas(f'avg(x{i}) AS mx{i}, var_pop(x{i}) AS v{i}' for i in range(1, 6))}
           FROM cases GROUP BY {by})""",
        *residualized("full", by, ["x1", "x2", "x3", "x4", "x5"], ALL_VARS),
        f"errors AS (SELECT {by}, sum(y * y) AS rss FROM full4 GROUP BY {by})",
    ]
    slopes = []
    for j in range(1, 6):
        others = [f"x{i}" for i in range(1, 6) if i != j]
        parts += residualized(f"drop{j}_", by, others, ALL_VARS)
        slopes.append(
            f"SELECT {by}, {j} AS j, regr_slope(y, x{j}) AS b, var_pop(x{j}) AS own "
            f"FROM drop{j}_3 GROUP BY {by}"
        )
    parts.append("slopes AS (" + "\nUNION ALL\n".join(slopes) + ")")
    return parts


# Two-sided tail of Student's t as an integral of a power of the cosine (Simpson).
T_TAIL = """CASE WHEN t IS NULL THEN NULL ELSE
  2 * exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) / sqrt(pi())
  * (pi() / 2 - atan(abs(t) / sqrt(df))) / 3000 * list_sum([(CASE WHEN i = 0 OR i = 1000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
      * pow(greatest(cos(atan(abs(t) / sqrt(df)) + (pi() / 2 - atan(abs(t) / sqrt(df))) * i / 1000.0), 0.0),
            df - 1) FOR i IN range(0, 1001)]) END"""
# Upper tail of F(5, df), likewise, as an incomplete beta integral.
F_TAIL = """2 * exp(lgamma((df + 5) / 2.0) - lgamma(df / 2.0) - lgamma(2.5))
  * (pi() / 2 - atan(sqrt(5 * f_value / df))) / 3000 * list_sum([(CASE WHEN i = 0 OR i = 1000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
      * pow(greatest(cos(atan(sqrt(5 * f_value / df)) + (pi() / 2 - atan(sqrt(5 * f_value / df))) * i / 1000.0), 0.0),
            df - 1)
      * pow(sin(atan(sqrt(5 * f_value / df)) + (pi() / 2 - atan(sqrt(5 * f_value / df))) * i / 1000.0), 4) FOR i IN range(0, 1001)])"""


def trend_fit(source: Sequence[str] = (YIELDS,), table: str = "yields") -> dict[str, str]:
    """The one-variable regression of yield on year, from its sums of squares."""
    fit = f"""fit AS (SELECT regr_slope(prod_10a_kg, "year") AS b, regr_intercept(prod_10a_kg, "year") AS a,
           regr_sxx(prod_10a_kg, "year") AS sxx, regr_syy(prod_10a_kg, "year") AS syy,
           avg("year") AS mx, count(*) AS n FROM {table})"""
    rest = f"residuals AS (SELECT prod_10a_kg - a - b * \"year\" AS e FROM {table}, fit)"
    error = "errors AS (SELECT sum(e * e) AS rss FROM residuals)"
    terms = """terms AS (
  SELECT '(Intercept)' AS term, a AS estimate, n, sqrt(rss / (n - 2) * (1.0 / n + mx * mx / sxx)) AS std_error
  FROM fit, errors
  UNION ALL SELECT 'year', b, n, sqrt(rss / (n - 2) / sxx) FROM fit, errors),
tested AS (SELECT *, estimate / std_error AS t, CAST(n - 2 AS DOUBLE) AS df FROM terms)"""
    slope = "tested_slope AS (SELECT t, df FROM tested WHERE term = 'year')"
    return {
        "yield_trend_ols": with_(*source, fit, rest, error, terms)
        + f"""SELECT 'trend' AS model, term, {rnd('estimate', 'std_error')},
             round(t, 6) + 0.0 AS t_value, round({T_TAIL}, 6) + 0.0 AS p_value FROM tested""",
        "yield_trend_summary": with_(*source, fit, rest, error, terms, slope)
        + f"""SELECT 'trend' AS model, n, n - 2 AS df, round(1 - rss / syy, 6) + 0.0 AS r2,
             round(1 - rss / syy * (n - 1) / (n - 2), 6) + 0.0 AS adj_r2,
             round(sqrt(rss / (n - 2)), 6) + 0.0 AS sigma, round(t * t, 6) + 0.0 AS f_value,
             CAST(1 AS BIGINT) AS f_df, round({T_TAIL}, 6) + 0.0 AS f_p_value,
             (SELECT round(min(e), 6) + 0.0 FROM residuals) AS resid_min,
             (SELECT round(quantile_cont(e, 0.25), 6) + 0.0 FROM residuals) AS resid_q1,
             (SELECT round(quantile_cont(e, 0.5), 6) + 0.0 FROM residuals) AS resid_median,
             (SELECT round(quantile_cont(e, 0.75), 6) + 0.0 FROM residuals) AS resid_q3,
             (SELECT round(max(e), 6) + 0.0 FROM residuals) AS resid_max
             FROM fit, errors, tested_slope""",
    }


def term_case(models: Sequence[tuple[str, bool]]) -> str:
    whens = " ".join(
        f"WHEN m = '{model + ('_sq' if sq else '')}' AND j = {j} THEN '{term}'"
        for model, sq in models
        for j, term in enumerate(term_names(model, sq), 1)
    )
    return f"CASE WHEN j = 0 THEN '(Intercept)' {whens} END"


def ols(models: Sequence[tuple[str, bool]], group: str = "") -> str:
    by = f"{group}, m" if group else "m"
    lead = f"{group}, " if group else ""
    partial = " + ".join(f"max(CASE WHEN j = {i} THEN b END) * any_value(mx{i})" for i in range(1, 6))
    # The intercept's spread: the part of the constant that the predictors do not
    # explain, by regressing each predictor in turn through the origin.
    origin = [f"origin0 AS (SELECT {by}, CAST(1 AS DOUBLE) AS c, x1, x2, x3, x4, x5 FROM cases)"]
    left = ["c", "x1", "x2", "x3", "x4", "x5"]
    for step in range(1, 6):
        z = f"x{step}"
        left = [v for v in left if v != z]
        cols = commas(
            f"{v} - {z} * sum({v} * {z}) OVER g / sum({z} * {z}) OVER g AS {v}" for v in left
        )
        origin.append(
            f"origin{step} AS (SELECT {by}, {cols} FROM origin{step - 1} WINDOW g AS (PARTITION BY {by}))"
        )
    parts = [
        *OBSERVATIONS,
        cases(models, group),
        *regression_parts(by),
        *origin,
        f"constant AS (SELECT {by}, sum(c * c) AS own FROM origin5 GROUP BY {by})",
        f"""terms AS (
  SELECT {by}, j, b AS estimate, own * n AS ss, rss, n FROM slopes JOIN sizes USING ({by})
         JOIN errors USING ({by})
  UNION ALL
  SELECT {by}, 0, any_value(my) - ({partial}), any_value(constant.own), any_value(rss), any_value(n)
  FROM slopes JOIN sizes USING ({by}) JOIN errors USING ({by}) JOIN constant USING ({by})
  GROUP BY {by})""",
        """tested AS (SELECT *, estimate / std_error AS t FROM (
  SELECT *, CAST(n - 6 AS DOUBLE) AS df, sqrt(rss / (n - 6) / ss) AS std_error FROM terms))""",
    ]
    return (
        with_(*parts)
        + f"""SELECT {lead}m AS model, {term_case(models)} AS term,
             round(estimate, 6) + 0.0 AS estimate, round(std_error, 6) + 0.0 AS std_error,
             round(t, 6) + 0.0 AS t_value, round({T_TAIL}, 6) + 0.0 AS p_value FROM tested"""
    )


def vif(models: Sequence[tuple[str, bool]], group: str = "") -> str:
    by, lead = (f"{group}, m", f"{group}, ") if group else ("m", "")
    total = "CASE j " + " ".join(f"WHEN {i} THEN v{i}" for i in range(1, 6)) + " END"
    return (
        with_(*OBSERVATIONS, cases(models, group), *regression_parts(by))
        + f"""SELECT {lead}m AS model, {term_case(models)} AS term, round({total} / own, 6) + 0.0 AS vif
             FROM slopes JOIN sizes USING ({by})"""
    )


def summary(models: Sequence[tuple[str, bool]], group: str = "") -> str:
    by, lead = (f"{group}, m", f"{group}, ") if group else ("m", "")
    parts = [
        *OBSERVATIONS,
        cases(models, group),
        *regression_parts(by),
        f"""spread AS (SELECT {by}, min(y) AS resid_min, quantile_cont(y, 0.25) AS resid_q1,
           quantile_cont(y, 0.5) AS resid_median, quantile_cont(y, 0.75) AS resid_q3,
           max(y) AS resid_max FROM full4 GROUP BY {by})""",
        f"""fitted AS (SELECT *, (r2 / 5) / ((1 - r2) / df) AS f_value FROM (
  SELECT *, 1 - rss / tss AS r2, n - 6 AS df FROM sizes JOIN errors USING ({by}) JOIN spread USING ({by})))""",
    ]
    quantiles = rnd("resid_min", "resid_q1", "resid_median", "resid_q3", "resid_max")
    return (
        with_(*parts)
        + f"""SELECT {lead}m AS model, n, CAST(df AS BIGINT) AS df, {rnd('r2')},
             round(1 - (1 - r2) * (n - 1) / df, 6) + 0.0 AS adj_r2,
             round(sqrt(rss / df), 6) + 0.0 AS sigma, {rnd('f_value')},
             CAST(5 AS BIGINT) AS f_df, round({F_TAIL}, 6) + 0.0 AS f_p_value, {quantiles}
             FROM fitted"""
    )


def regression() -> dict[str, str]:
    everything = [(m, False) for m in MODELS] + [(m, True) for m in MODELS]
    out = {
        "ols_all": ols(everything),
        "ols_summary": summary(everything),
        "ols_by_province": ols([("tm_avg", False)], "wide"),
        "ols_summary_by_province": summary(everything, "wide"),
        "vif_by_province": vif(everything, "wide"),
        "ols_merged_states": ols(everything),
        "ols_mixed_widths": "SELECT * FROM (" + ols([("tm_avg", False)]) + ")\nUNION ALL BY NAME\nSELECT * FROM ("
        + trend_fit([*OBSERVATIONS, "paired AS (SELECT * FROM observed WHERE prod_10a_kg IS NOT NULL)"], "paired")[
            "yield_trend_ols"
        ]
        + ")",
        "trend_points": with_(*OBSERVATIONS)
        + """SELECT region, "year", round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y,
             round(fitted, 6) + 0.0 AS fitted, round(y - fitted, 6) + 0.0 AS residual FROM (
             SELECT *, regr_intercept(y, x) OVER g + regr_slope(y, x) OVER g * x AS fitted
             FROM (SELECT region, "year", tm_avg_P1 AS x, prod_10a_kg AS y FROM observed
                   WHERE tm_avg_P1 IS NOT NULL AND prod_10a_kg IS NOT NULL)
             WINDOW g AS (PARTITION BY region))""",
    }
    for m in MODELS:
        out[f"ols_{m}"] = ols([(m, False)])
        out[f"ols_sq_{m}"] = ols([(m, True)])
        out[f"vif_{m}"] = vif([(m, False)])
        out[f"vif_sq_{m}"] = vif([(m, True)])
    return out


def registered() -> dict[str, str]:
    return {
        **stage_a(), **spatial(), **cleaning(), **yield_tables(), **phenology(), **trend_fit(),
        **regression(),
    }
