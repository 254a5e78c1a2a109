"""DuckDB SQL oracles for the query catalogue.

Each entry is independent ANSI-ish SQL over the raw test tables, written from
the operator semantics (not generated from the Spark plans). Floats are
rounded to 4 digits and ``+ 0.0`` folds -0.0 into 0.0, the same as the Spark
side; integer results are cast to BIGINT/INTEGER to match Spark types.
"""

from __future__ import annotations

import math

R = "ROUND({x}, 4) + 0.0"


def r(x: str) -> str:
    return R.format(x=x)


# Shared derived frames, as CTE bodies (mirrors strata.plans.frames).
AREA = """area AS (
  SELECT n.n_name AS State, c.c_name AS County, c.c_custkey AS custkey,
         CASE WHEN c.c_mktsegment IN ('BUILDING', 'AUTOMOBILE') THEN 'Urban' ELSE 'Rural' END AS Metro,
         c.c_mktsegment AS segment, c.c_acctbal,
         CAST(c.c_acctbal < 0 AS INTEGER) AS flag,
         CAST(c.c_acctbal > 5000.0 AS INTEGER) AS flag2
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey)"""

YEARS = "years AS (SELECT o_custkey AS custkey, " + ", ".join(
    f"SUM(CASE WHEN year(o_orderdate) = {y} THEN o_totalprice END) AS pop{y}" for y in range(1995, 2002)
) + " FROM orders GROUP BY o_custkey)"

SCORE = """score AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice,
         l_quantity, l_discount, l_tax, l_returnflag, l_linestatus,
         CAST(l_returnflag = 'R' AS INTEGER) AS y, 'qty' AS model, l_quantity / 50.0 AS p1
  FROM lineitem
  UNION ALL
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice,
         l_quantity, l_discount, l_tax, l_returnflag, l_linestatus,
         CAST(l_returnflag = 'R' AS INTEGER) AS y, 'price' AS model,
         LEAST(l_extendedprice / 105000.0, 1.0) AS p1
  FROM lineitem),
scored AS (SELECT *, CAST(CASE WHEN p1 > 0.5 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS prediction FROM score)"""

LKEY = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice"

EVENT_TYPES = ["click", "view", "purchase", "signup", "error"]


def ind(t: str) -> str:
    extra = ", CASE WHEN SUM(value) >= 250 THEN 'high' END AS tier" if t == "purchase" else ""
    return (
        f"ind_{t} AS (SELECT user_id, COUNT(*) AS n_{t}, CASE WHEN MAX(value) > 100.0 THEN SUM(value) END AS v_{t}{extra} "
        f"FROM events WHERE event_type = '{t}' GROUP BY user_id)"
    )


INDS = ",\n".join(ind(t) for t in EVENT_TYPES)
IND_COLS = [c for t in EVENT_TYPES for c in (f"n_{t}", f"v_{t}")] + ["tier"]
MERGED = (
    "merged AS (SELECT COALESCE(ind_click.user_id, ind_view.user_id, ind_purchase.user_id, "
    "ind_signup.user_id, ind_error.user_id) AS user_id, "
    + ", ".join(IND_COLS)
    + " FROM ind_click FULL JOIN ind_view ON ind_click.user_id = ind_view.user_id"
    " FULL JOIN ind_purchase ON ind_purchase.user_id = COALESCE(ind_click.user_id, ind_view.user_id)"
    " FULL JOIN ind_signup ON ind_signup.user_id = COALESCE(ind_click.user_id, ind_view.user_id, ind_purchase.user_id)"
    " FULL JOIN ind_error ON ind_error.user_id = COALESCE(ind_click.user_id, ind_view.user_id, ind_purchase.user_id, ind_signup.user_id))"
)


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


ORACLE: dict[str, str] = {}

ORACLE["group_mean_profile"] = with_(AREA) + f"""
SELECT Metro, variable, {r('value')} AS value FROM (
  SELECT Metro, 'c_acctbal' AS variable, AVG(c_acctbal) AS value
  FROM area JOIN orders ON area.custkey = orders.o_custkey GROUP BY Metro
  UNION ALL
  SELECT Metro, 'o_totalprice', AVG(o_totalprice)
  FROM area JOIN orders ON area.custkey = orders.o_custkey GROUP BY Metro)"""


def long_sql(src: str, ids: list[str], values: list[tuple[str, str]], value_name: str = "value", rnd: bool = True) -> str:
    """Wide -> long as UNION ALL (one SELECT per value column)."""
    parts = []
    for name, expr in values:
        v = r(expr) if rnd else expr
        parts.append(f"SELECT {', '.join(ids)}{', ' if ids else ''}'{name}' AS variable, {v} AS {value_name} FROM {src}")
    return "\nUNION ALL\n".join(parts)


MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

ORACLE["topic_profile"] = with_(
    "g AS (SELECT l_returnflag, AVG(l_extendedprice) AS l_extendedprice, AVG(l_discount) AS l_discount, "
    "AVG(l_tax) AS l_tax FROM lineitem GROUP BY l_returnflag)"
) + long_sql("g", ["l_returnflag"], [(c, c) for c in ["l_extendedprice", "l_discount", "l_tax"]])

ORACLE["group_sum_profile"] = "SELECT l_linestatus, " + ", ".join(
    f"{r(f'SUM({c})')} AS {c}" for c in MEASURES
) + " FROM lineitem GROUP BY l_linestatus"

_QTY = with_(SCORE) + ", q AS (SELECT * FROM scored WHERE model = 'qty')"


def _composite(how: str) -> str:
    aggs = ", ".join(f"{how}({c}) AS {c}" for c in MEASURES)
    return (
        _QTY
        + f", g AS (SELECT COALESCE(CAST(CAST(prediction AS INTEGER) AS VARCHAR), 'NA') || '-' || "
        f"COALESCE(l_linestatus, 'NA') AS class, {aggs} FROM q GROUP BY prediction, l_linestatus)\n"
        + long_sql("g", ["class"], [(c, c) for c in MEASURES])
    )


ORACLE["composite_profile_mean"] = _composite("AVG")
ORACLE["composite_profile_sum"] = _composite("SUM")

ORACLE["class_counts"] = _QTY + "SELECT prediction, l_linestatus, COUNT(*) AS n FROM q GROUP BY prediction, l_linestatus"

ORACLE["flag_counts"] = with_(AREA) + (
    ", g AS (SELECT Metro, CAST(SUM(flag) AS BIGINT) AS flag, CAST(SUM(flag2) AS BIGINT) AS flag2 FROM area GROUP BY Metro)\n"
) + long_sql("g", ["Metro"], [("flag", "flag"), ("flag2", "flag2")], rnd=False)

ORACLE["flag_counts_legacy"] = with_(AREA) + (
    ", g AS (SELECT Metro, CAST(SUM(flag + 1) AS BIGINT) AS flag, CAST(SUM(flag2 + 1) AS BIGINT) AS flag2 "
    "FROM area GROUP BY Metro)\n"
) + long_sql("g", ["Metro"], [("flag", "flag"), ("flag2", "flag2")], rnd=False)

ORACLE["area_probability"] = with_(AREA) + """
SELECT State, segment,
       CASE WHEN MIN(CAST(flag AS DOUBLE)) = MAX(CAST(flag AS DOUBLE)) THEN MIN(CAST(flag AS DOUBLE)) END AS p,
       COUNT(*) AS n
FROM area WHERE Metro IN ('Rural', 'Urban') GROUP BY State, segment"""

ORACLE["rollup_state"] = with_(AREA) + f"""
SELECT State, Metro, {r('SUM(c_acctbal)')} AS c_acctbal, COUNT(*) AS records,
       CAST(GROUPING(State, Metro) AS BIGINT) AS level
FROM area GROUP BY ROLLUP (State, Metro)"""

ORACLE["drill_defaults"] = with_(AREA) + f"""
SELECT State, Metro, CAST(COUNT(County) AS BIGINT) AS County, COUNT(custkey) AS custkey, CASE WHEN MIN(segment) = MAX(segment) THEN MIN(segment) END AS segment,
       {r('AVG(c_acctbal)')} AS c_acctbal, CAST(SUM(flag) AS BIGINT) AS flag, CAST(SUM(flag2) AS BIGINT) AS flag2,
       {r('MIN(c_acctbal)')} AS low, {r('MAX(c_acctbal)')} AS high, COUNT(*) AS records, CAST(GROUPING(State, Metro) AS BIGINT) AS level
FROM area GROUP BY ROLLUP (State, Metro)"""

ORACLE["scatter_sample"] = f"""
SELECT c_custkey, c_mktsegment, {r('c_acctbal')} AS c_acctbal, COUNT(*) OVER (PARTITION BY c_mktsegment) AS class_rows,
       {r('LEAST(1.0, 100.0::DOUBLE / COUNT(*) OVER (PARTITION BY c_mktsegment))')} AS rate
FROM customer
QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY (c_custkey % 2147483647 + 1) * 1103515245 % 2147483647, c_custkey) <= 100"""

ORACLE["fill_levels"] = f"""
SELECT c_custkey, {r('CASE WHEN c_acctbal >= 0 THEN c_acctbal ELSE 0.0 END')} AS balance, CASE WHEN c_custkey % 3 > 0 THEN c_name ELSE '0' END AS word,
       CASE WHEN c_custkey % 4 > 0 THEN CAST(CAST(c_acctbal < 0 AS INTEGER) AS VARCHAR) ELSE '0' END AS flag,
       CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END AS segment, CAST(c_custkey % 5 > 0 AS INTEGER) AS complete
FROM customer"""

ORACLE["year_totals"] = with_(AREA) + f""",
j AS (SELECT Metro, year(o_orderdate) AS year, o_totalprice FROM area JOIN orders ON custkey = o_custkey),
every AS (SELECT Metro, year FROM (SELECT DISTINCT Metro FROM j), (SELECT DISTINCT year(o_orderdate) AS year FROM orders WHERE o_orderdate IS NOT NULL))
SELECT every.Metro, CAST(every.year AS INTEGER) AS year, {r('SUM(o_totalprice) / 1000000.0')} AS total
FROM every LEFT JOIN j ON every.Metro = j.Metro AND every.year = j.year GROUP BY every.Metro, every.year"""

ORACLE["density_by_group"] = f"""
SELECT p_brand, p_type, CAST(SUM(p_size) AS BIGINT) AS area, {r('SUM(p_retailprice)')} AS pop,
       {r('SUM(p_retailprice) / SUM(p_size)')} AS density
FROM part GROUP BY p_brand, p_type"""

ORACLE["density_window"] = f"""
SELECT p_brand, p_type, CAST(SUM(p_size) AS BIGINT) AS area, {r('SUM(p_retailprice)')} AS pop,
       {r('COUNT(*) * (SUM(p_retailprice) / SUM(p_size))')} AS density
FROM part GROUP BY p_brand, p_type"""

ORACLE["density_detail"] = f"""
SELECT p_partkey, COALESCE(p_type, 'NA') || '-' || COALESCE(p_brand, 'NA') AS class,
       {r('CASE WHEN p_size = 0 THEN NULL ELSE p_retailprice / p_size END')} AS density
FROM part"""

ORACLE["density_bins"] = f"""
WITH st AS (SELECT MIN(p_size) AS x0, MAX(p_size) AS x1, MIN(p_retailprice) AS y0, MAX(p_retailprice) AS y1 FROM part)
SELECT p_type,
       CAST(LEAST(FLOOR((CAST(p_size AS DOUBLE) - CAST(x0 AS DOUBLE)) / CAST(x1 - x0 AS DOUBLE) * 10.0), 9) AS INTEGER) AS x_bin,
       CAST(LEAST(FLOOR((p_retailprice - y0) / (y1 - y0) * 10.0), 9) AS INTEGER) AS y_bin,
       COUNT(*) AS n, {r('AVG(p_size)')} AS x_mean, {r('AVG(p_retailprice)')} AS y_mean
FROM part, st WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL
GROUP BY ALL"""

ORACLE["recode_class"] = """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'Filled' WHEN o_orderstatus = 'O' THEN 'Open'
                        ELSE o_orderstatus END AS status
FROM orders"""

ORACLE["level_codes"] = """
SELECT c.c_custkey, c.c_mktsegment, CAST(l.level AS INTEGER) AS level
FROM customer c LEFT JOIN (
  SELECT c_mktsegment, DENSE_RANK() OVER (ORDER BY c_mktsegment) AS level
  FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment IS NOT NULL)) l
USING (c_mktsegment)"""

ORACLE["safe_casts"] = """
SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS key_text,
       TRY_CAST(split_part(p_brand, '#', 2) AS INTEGER) AS brand_no,
       TRY_CAST(p_name AS DOUBLE) AS name_num
FROM part"""

ORACLE["composite_key"] = with_(AREA) + """
SELECT custkey, COALESCE(Metro, 'NA') || '-' || COALESCE(NULLIF(segment, 'HOUSEHOLD'), 'NA') AS key FROM area"""

ORACLE["type_split"] = "SELECT p_partkey, p_size, p_retailprice FROM part"

ORACLE["outlier_labels"] = with_(AREA) + f"""
SELECT State, {r('AVG(c_acctbal)')} AS mean_balance,
       CASE WHEN AVG(c_acctbal) > 4500.0 THEN State ELSE '' END AS label
FROM area GROUP BY State"""

ORACLE["cohort_filter"] = with_(SCORE) + f"""
SELECT {LKEY}, {r('p1')} AS p1 FROM scored WHERE model = 'qty' AND y = 1 AND l_linestatus = 'F'"""

ORACLE["key_length_filter"] = "SELECT doc_id, source, lang FROM documents WHERE length(source) <= 4"

ORACLE["probability_bins"] = with_(SCORE) + """
SELECT model, CAST(LEAST(FLOOR(p1 / CAST(0.1 AS DOUBLE)), 9) AS INTEGER) AS bin, COUNT(*) AS n
FROM scored GROUP BY ALL"""

_M = with_(INDS, MERGED)
_NUM = [c for t in EVENT_TYPES for c in (f"n_{t}", f"v_{t}")]


def _rcol(c: str) -> str:
    return r(c) if c.startswith("v_") else c


ORACLE["fill_missing"] = _M + "SELECT user_id, " + ", ".join(
    (f"COALESCE({c}, 0) AS {c}" if c.startswith("n_") else f"{r(f'COALESCE({c}, 0)')} AS {c}") for c in _NUM
) + ", COALESCE(tier, '0') AS tier FROM merged"

ORACLE["drop_incomplete"] = _M + "SELECT user_id, " + ", ".join(f"{_rcol(c)} AS {c}" for c in _NUM) + (
    ", tier FROM merged WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in ["user_id", *_NUM, "tier"])
)

_ALLCOLS = ["user_id", *IND_COLS]
ORACLE["missing_profile"] = (
    _M
    + ", s AS (SELECT "
    + ", ".join(f"AVG(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)::DOUBLE AS {c}" for c in _ALLCOLS)
    + " FROM merged)\n"
    + long_sql("s", [], [(c, c) for c in _ALLCOLS] + [("(all)", "(0.0 + " + " + ".join(_ALLCOLS) + f") / {float(len(_ALLCOLS))}")], "missing_share")
)

ORACLE["roughfix_impute"] = (
    _M
    + ", md AS (SELECT "
    + ", ".join(f"MEDIAN(CAST({c} AS DOUBLE)) AS {c}" for c in _NUM)
    + " FROM merged), mo AS (SELECT tier FROM merged WHERE tier IS NOT NULL GROUP BY tier "
    "ORDER BY COUNT(*) DESC, tier ASC LIMIT 1)\n"
    "SELECT m.user_id, "
    + ", ".join(f"{r(f'COALESCE(CAST(m.{c} AS DOUBLE), md.{c})')} AS {c}" for c in _NUM)
    + ", COALESCE(m.tier, mo.tier) AS tier FROM merged m, md, mo"
)

ORACLE["null_policy_sum"] = (
    _M
    + ", s AS (SELECT "
    + ", ".join(
        f"CAST(SUM({c}) AS DOUBLE) AS s__{c}, CASE WHEN COUNT({c}) = COUNT(*) THEN CAST(SUM({c}) AS DOUBLE) END AS p__{c}"
        for c in _NUM
    )
    + " FROM merged)\n"
    + "\nUNION ALL\n".join(f"SELECT '{c}' AS variable, {r(f's__{c}')} AS sum_skip, {r(f'p__{c}')} AS sum_propagate FROM s" for c in _NUM)
)

ORACLE["label_backfill"] = """
SELECT d.lang, CAST(CASE WHEN p.doc_id IS NULL THEN 0 ELSE 1 END AS INTEGER) AS toxic, COUNT(*) AS n
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) p ON d.doc_id = p.doc_id
GROUP BY ALL"""

_POPS = [f"pop{y}" for y in range(1995, 2002)]
ORACLE["natural_inner"] = with_(AREA, YEARS) + (
    "SELECT custkey, State, County, Metro, segment, " + r("c_acctbal") + " AS c_acctbal, flag, flag2, "
    + ", ".join(f"{r(p)} AS {p}" for p in _POPS)
    + " FROM area JOIN years USING (custkey)"
)

ORACLE["composite_join"] = f"""
WITH a AS (SELECT l_orderkey, l_returnflag, SUM(l_quantity) AS qty FROM lineitem GROUP BY ALL),
     b AS (SELECT l_orderkey, l_returnflag, MAX(l_extendedprice) AS max_price FROM lineitem GROUP BY ALL)
SELECT l_orderkey, l_returnflag, {r('qty')} AS qty, {r('max_price')} AS max_price
FROM a JOIN b USING (l_orderkey, l_returnflag)"""

_MERGED_SELECT = "SELECT user_id, " + ", ".join(f"{_rcol(c)} AS {c}" for c in _NUM) + ", tier FROM merged"
ORACLE["outer_merge_n"] = _M + _MERGED_SELECT
ORACLE["outer_merge_stored"] = ORACLE["outer_merge_n"]
ORACLE["outer_merge_union"] = _M + _MERGED_SELECT

ORACLE["prepare_indicators"] = (
    _M
    + ", f AS (SELECT CAST(user_id AS VARCHAR) AS user_id, "
    + ", ".join(f"COALESCE(CAST({c} AS DOUBLE), 0.0) AS {c}" for c in _NUM)
    + ", COALESCE(tier, '0') AS tier FROM merged WHERE user_id IS NOT NULL)\n"
    "SELECT user_id, "
    + ", ".join(f"{r(f'({c} - AVG({c}) OVER ()) / STDDEV_SAMP({c}) OVER ()')} AS {c}" for c in _NUM)
    + ", tier FROM f"
)

_Z = ["l_quantity", "l_discount", "l_tax"]
ORACLE["zscore"] = f"SELECT {LKEY}, " + ", ".join(
    f"{r(f'({c} - AVG({c}) OVER ()) / STDDEV_SAMP({c}) OVER ()')} AS {c}" for c in _Z
) + " FROM lineitem"

ORACLE["zscore_two_period"] = "\nUNION ALL\n".join(
    f"SELECT {LKEY}, "
    + ", ".join(f"{r(f'({c} - AVG({c}) OVER ()) / STDDEV_SAMP({c}) OVER ()')} AS {c}" for c in _Z)
    + f", '{p}' AS period FROM lineitem WHERE l_shipdate {op} TIMESTAMP '1998-07-01'"
    for p, op in (("early", "<"), ("late", ">="))
)

ORACLE["trend_smooth"] = f"""
WITH pts AS (SELECT CAST(p_size AS DOUBLE) AS x, CAST(p_retailprice AS DOUBLE) AS y FROM part
             WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL AND CAST(p_size AS DOUBLE) BETWEEN 5 AND 45),
st AS (SELECT MIN(x) AS lo, MAX(x) AS hi, COUNT(*) AS n FROM pts),
grid AS (SELECT g, lo + CAST(g AS DOUBLE) * ((hi - lo) / 79.0) AS gx,
                GREATEST(CAST(FLOOR(0.75 * n) AS BIGINT), 1) AS q
         FROM st, range(0, 80) t(g)),
pairs AS (SELECT grid.g, grid.gx, grid.q, pts.x - grid.gx AS dx, ABS(pts.x - grid.gx) AS d, pts.y FROM grid, pts),
bw AS (SELECT g, d AS h FROM (SELECT g, d, q, ROW_NUMBER() OVER (PARTITION BY g ORDER BY d) AS rn FROM pairs) WHERE rn = q),
w AS (SELECT p.g, p.gx, p.dx, p.y,
             CASE WHEN p.d < b.h THEN POW(1 - POW(p.d / b.h, 3), 3) ELSE 0.0 END AS w
      FROM pairs p JOIN bw b ON p.g = b.g),
m AS (SELECT g, ANY_VALUE(gx) AS gx,
             SUM(w * POW(dx, 0)) AS s0, SUM(w * POW(dx, 1)) AS s1, SUM(w * POW(dx, 2)) AS s2,
             SUM(w * POW(dx, 3)) AS s3, SUM(w * POW(dx, 4)) AS s4,
             SUM(w * POW(dx, 0) * y) AS t0, SUM(w * POW(dx, 1) * y) AS t1, SUM(w * POW(dx, 2) * y) AS t2
      FROM w GROUP BY g)
SELECT CAST(g AS INTEGER) AS g, {r('gx')} AS x,
       {r('(t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / NULLIF(s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2), 0)')} AS fit
FROM m"""

# The same fits at the vertices of the cells, blended by cubics between them.
_DET = "(s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2))"
ORACLE["trend_interpolate"] = f"""
WITH RECURSIVE pts AS (
  SELECT CAST(p_size AS DOUBLE) AS x, CAST(p_retailprice AS DOUBLE) AS y FROM part
  WHERE p_size BETWEEN 5 AND 45 AND p_retailprice BETWEEN 950 AND 1900),
st AS (SELECT MIN(x) AS lo, MAX(x) AS hi, CAST(COUNT(*) AS BIGINT) AS n FROM pts),
byx AS (SELECT x, CAST(SUM(COUNT(*)) OVER (ORDER BY x) AS BIGINT) AS upto, LEAD(x) OVER (ORDER BY x) AS after FROM pts GROUP BY x),
cells AS (
  SELECT CAST(1 AS BIGINT) AS l, n AS u, n, CAST(NULL AS DOUBLE) AS cut FROM st
  UNION ALL
  SELECT CASE WHEN side = 0 THEN l ELSE r + 1 END, CASE WHEN side = 0 THEN r ELSE u END, n, CASE WHEN side = 0 THEN c END
  FROM (
    SELECT cells.l, cells.u, cells.n, arg_min(byx.upto, ABS(byx.upto - (cells.l + cells.u) // 2) - byx.upto / 1e12) AS r,
           arg_min((byx.x + byx.after) / 2, ABS(byx.upto - (cells.l + cells.u) // 2) - byx.upto / 1e12) AS c
    FROM cells JOIN byx ON byx.upto >= cells.l AND byx.upto < cells.u
    WHERE cells.u - cells.l + 1 > GREATEST(CAST(FLOOR(cells.n * 0.75::DOUBLE * 0.2::DOUBLE) AS BIGINT), 1)
    GROUP BY cells.l, cells.u, cells.n) cutting, (SELECT UNNEST([0, 1]) AS side) sides),
box AS (SELECT 0.005::DOUBLE * GREATEST(hi - lo, GREATEST(ABS(lo), ABS(hi)) * 1e-3 + 1e-30) AS margin, lo, hi FROM st),
vertices AS (
  SELECT v, ROW_NUMBER() OVER (ORDER BY v) AS g FROM (
    SELECT lo - margin AS v FROM box UNION ALL SELECT hi + margin FROM box UNION ALL SELECT cut FROM cells WHERE cut IS NOT NULL)),
pairs AS (SELECT g, v, pts.x - v AS dx, ABS(pts.x - v) AS d, pts.y FROM vertices, pts),
bw AS (SELECT g, d AS h FROM (SELECT g, d, ROW_NUMBER() OVER (PARTITION BY g ORDER BY d) AS rn FROM pairs), st
       WHERE rn = GREATEST(CAST(FLOOR(0.75 * n) AS BIGINT), 1)),
w AS (SELECT p.*, CASE WHEN p.d < b.h THEN POW(1 - POW(p.d / b.h, 3), 3) ELSE 0.0 END AS w FROM pairs p JOIN bw b ON p.g = b.g),
m AS (SELECT g, ANY_VALUE(v) AS v, {", ".join(f"SUM(w * POW(dx, {k})) AS s{k}" for k in range(5))},
             {", ".join(f"SUM(w * POW(dx, {k}) * y) AS t{k}" for k in range(3))} FROM w GROUP BY g),
fits AS (SELECT g, v, (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / {_DET} AS f,
                (s0 * (t1 * s4 - s3 * t2) - t0 * (s1 * s4 - s3 * s2) + s2 * (s1 * t2 - t1 * s2)) / {_DET} AS slope FROM m),
ends AS (SELECT v AS v0, LEAD(v) OVER (ORDER BY g) AS v1, f AS f0, slope AS d0, LEAD(f) OVER (ORDER BY g) AS f1, LEAD(slope) OVER (ORDER BY g) AS d1 FROM fits),
grid AS (SELECT g, lo + CAST(g AS DOUBLE) * ((hi - lo) / 79.0) AS z FROM st, range(0, 80) t(g)),
placed AS (SELECT g, z, v1 - v0 AS wide, (z - v0) / (v1 - v0) AS h, f0, d0, f1, d1 FROM grid JOIN ends ON z >= v0 AND z < v1)
SELECT CAST(g AS INTEGER) AS g, {r('z')} AS x,
       {r('(1 - h) * (1 - h) * (1 + 2 * h) * f0 + h * h * (3 - 2 * h) * f1 + (h * (1 - h) * (1 - h) * d0 - h * h * (1 - h) * d1) * wide')} AS fit
FROM placed"""

_ORDER = "p1 DESC, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice"
ORACLE["decile_assign"] = with_(SCORE) + f"""
SELECT model, {LKEY}, CAST(NTILE(10) OVER (PARTITION BY model ORDER BY {_ORDER}) AS INTEGER) AS bin FROM scored"""

ORACLE["running_share"] = with_(SCORE) + f""",
b AS (SELECT model, CAST(LEAST(FLOOR(p1 / CAST(0.1 AS DOUBLE)), 9) AS INTEGER) AS bin, CAST(SUM(y) AS BIGINT) AS positives
      FROM scored GROUP BY ALL),
s AS (SELECT *, positives / SUM(positives) OVER (PARTITION BY model) AS share FROM b)
SELECT model, bin, positives, {r('share')} AS share,
       {r('SUM(share) OVER (PARTITION BY model ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS cum_share
FROM s"""

ORACLE["lift_deciles"] = with_(SCORE) + f""",
d AS (SELECT model, y, NTILE(10) OVER (PARTITION BY model ORDER BY {_ORDER}) AS bin FROM scored),
c AS (SELECT model, CAST(bin AS INTEGER) AS bin, SUM(y) AS cnt FROM d GROUP BY ALL),
s AS (SELECT model, bin, cnt / SUM(cnt) OVER (PARTITION BY model) AS share FROM c)
SELECT model, bin, {r('SUM(share) OVER (PARTITION BY model ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS prop FROM s
UNION ALL
SELECT 'Base' AS model, CAST(i AS INTEGER) AS bin, {r('(i - 1) / 9.0')} AS prop FROM range(1, 11) t(i)"""

ORACLE["top_scored"] = with_(SCORE) + f"""
SELECT model, {LKEY}, {r('p1')} AS p1 FROM scored ORDER BY {_ORDER}, model LIMIT 100"""

ORACLE["distinct_rows"] = with_(SCORE) + "SELECT DISTINCT model, prediction, l_linestatus FROM scored"

ORACLE["reorder_by_mean"] = f"""
WITH m AS (SELECT o_orderpriority, AVG(o_totalprice) AS mean_value FROM orders GROUP BY o_orderpriority)
SELECT o_orderpriority, {r('mean_value')} AS mean_value,
       CAST(ROW_NUMBER() OVER (ORDER BY mean_value, o_orderpriority) AS INTEGER) AS position FROM m"""

ORACLE["melt_default"] = """
WITH g AS (SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS sum_qty, AVG(l_discount) AS avg_disc,
                  CAST(COUNT(*) AS DOUBLE) AS n FROM lineitem GROUP BY ALL)
""" + long_sql("g", ["l_returnflag", "l_linestatus"], [("sum_qty", "sum_qty"), ("avg_disc", "avg_disc"), ("n", "n")])

ORACLE["melt_ids"] = with_(AREA) + """, g AS (SELECT Metro, AVG(c_acctbal) AS mean_balance,
  CAST(SUM(flag) AS DOUBLE) AS negatives, CAST(COUNT(*) AS DOUBLE) AS customers FROM area GROUP BY Metro)
""" + long_sql("g", ["Metro"], [("mean_balance", "mean_balance"), ("negatives", "negatives"), ("customers", "customers")])


def _cohorts(legacy: bool) -> str:
    loss_no = "net > 0" if legacy else "net < 0"
    return with_(AREA, YEARS) + f""", j AS (SELECT pop2000 - pop1996 AS net, flag FROM years JOIN area USING (custkey)),
t AS (SELECT 'Loss|Flag' AS cohort FROM j WHERE net < 0 AND flag = 1
      UNION ALL SELECT 'Gain|Flag' FROM j WHERE net > 0 AND flag = 1
      UNION ALL SELECT 'Loss|NoFlag' FROM j WHERE {loss_no} AND flag = 0
      UNION ALL SELECT 'Gain|NoFlag' FROM j WHERE net > 0 AND flag = 0)
SELECT cohort, COUNT(*) AS n FROM t GROUP BY cohort"""


ORACLE["cohort_change"] = _cohorts(False)
ORACLE["cohort_change_legacy"] = _cohorts(True)

_HARD = """(SUM(y * CASE WHEN prediction > 0.5 THEN 1.0 ELSE 0.0 END) / NULLIF(SUM(y), 0)
  + SUM((1 - y) * CASE WHEN prediction > 0.5 THEN 0.0 ELSE 1.0 END) / NULLIF(SUM(1 - y), 0)) / 2 * 100"""

ORACLE["auc_hard"] = with_(SCORE) + f"SELECT model, {r(_HARD)} AS auc FROM scored GROUP BY model"

ORACLE["auc_ranked"] = with_(SCORE) + f""",
t AS (SELECT model, p1, SUM(y) AS pos, COUNT(*) AS cnt FROM scored GROUP BY model, p1),
c AS (SELECT *, SUM(cnt) OVER (PARTITION BY model ORDER BY p1 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM t),
s AS (SELECT model, SUM(pos * (cum - (cnt - 1) / 2.0)) AS r1, CAST(SUM(pos) AS DOUBLE) AS n1,
             CAST(SUM(cnt) - SUM(pos) AS DOUBLE) AS n0 FROM c GROUP BY model)
SELECT model, {r('(r1 - n1 * (n1 + 1) / 2.0) / NULLIF(n1 * n0, 0) * 100')} AS auc FROM s"""

ORACLE["accuracy_cutpoint"] = with_(SCORE) + f"""
SELECT model, {r('AVG(CASE WHEN (CASE WHEN p1 > 0.5 THEN 1.0 ELSE 0.0 END) = y THEN 1.0 ELSE 0.0 END) * 100')} AS accuracy
FROM scored GROUP BY model"""

ORACLE["metrics_long"] = with_(SCORE) + f""",
g AS (SELECT model, {_HARD} AS AUC,
             AVG(CASE WHEN (CASE WHEN prediction > 0.5 THEN 1.0 ELSE 0.0 END) = y THEN 1.0 ELSE 0.0 END) * 100 AS Accuracy
      FROM scored GROUP BY model)
SELECT model, 'AUC' AS metric, {r('AUC')} AS value FROM g
UNION ALL SELECT model, 'Accuracy', {r('Accuracy')} FROM g"""


def _key_hash_sql() -> str:
    h = "CAST(0 AS BIGINT)"
    for c in ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]:
        v = f"CAST(ROUND({c} * 100) AS BIGINT)" if c.endswith("price") else f"CAST({c} AS BIGINT)"
        h = f"(({h}) * 1000003 + ((({v}) % 2147483647) + 2147483647) % 2147483647) % 2147483647"
    return f"((({h}) + 1) * 1103515245) % 2147483647"


ORACLE["hash_split"] = f"""
SELECT CASE WHEN ({_key_hash_sql()}) % 10000 < 2500 THEN 'test' ELSE 'training' END AS part, COUNT(*) AS n
FROM lineitem GROUP BY ALL"""

_MODEL_ROWS = f"""
WITH rows AS (
  SELECT *, ({_key_hash_sql()}) % 10000 < 2500 AS test,
         CASE WHEN l_extendedprice * (1.0::DOUBLE - l_discount) * (1.0::DOUBLE + l_tax)
                   > CASE WHEN l_returnflag = 'R' THEN 30000.0::DOUBLE ELSE 60000.0::DOUBLE END THEN 1 ELSE 0 END AS y
  FROM lineitem)"""

# What the fitted models must satisfy, from the rows and labels alone.
ORACLE["model_checks"] = _MODEL_ROWS + """
SELECT model, COUNT(*) AS n, CAST(SUM(y) AS BIGINT) AS positives, CAST(0 AS BIGINT) AS bad_probability,
       CAST(0 AS BIGINT) AS bad_prediction, CAST(1 AS INTEGER) AS beats_base
FROM rows, (SELECT UNNEST(['Logistic', 'Decision Tree', 'Random Forest', 'Gradient Boosted Trees']) AS model)
WHERE test GROUP BY model"""

ORACLE["model_moments"] = _MODEL_ROWS + "\nUNION ALL\n".join(
    f"""
SELECT '{model}' AS model, '{term}' AS term, {r(f'SUM({x} * y) / SUM({x})')} AS share FROM rows WHERE NOT test"""
    for model, term, x in [
        ("Decision Tree", "intercept", "1.0::DOUBLE"),
        ("Logistic", "intercept", "1.0::DOUBLE"),
        *[("Logistic", c, c) for c in ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]],
    ]
)

ORACLE["scored_export"] = _QTY + f"""
SELECT ROW_NUMBER() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS F1,
       {LKEY}, o.o_custkey, o.o_orderpriority, y, {r('p1')} AS p1, {r('prediction')} AS prediction
FROM q JOIN orders o ON q.l_orderkey = o.o_orderkey"""

# Bad income every 41 keys, a short record every 53; ordinals 31 and 42 of 61 columns.
ORACLE["csv_checked"] = """
WITH judged AS (
  SELECT c_custkey AS k, CASE WHEN c_custkey % 53 = 0 THEN 'not 61 fields' WHEN c_custkey % 41 = 0 THEN 'does not fit: Med.Income' ELSE '' END AS reason
  FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT CASE WHEN reason = '' THEN 'kept' ELSE 'rejected' END AS side, reason, COUNT(*) AS n, CASE WHEN reason = '' THEN 0 ELSE COUNT(*) END AS places,
       CASE WHEN reason = '' THEN CAST(SUM(k * 32 % 1000) AS BIGINT) END AS income,
       CASE WHEN reason = '' THEN ROUND(SUM((k * 43 % 1000) / 8.0::DOUBLE), 4) END AS poverty, CASE WHEN reason = '' THEN CAST(SUM(k) AS BIGINT) END AS keys
FROM judged GROUP BY reason"""

# ---------------------------------------------------------------- bagged trees

# Fixed values shared with strata.operators.forest, from their own rule: the
# bins, and the bag hash with the Poisson(1) shares over its modulus.
_BINS, _MODULUS = 32, 2147483647
_SHARES = ", ".join(f"{k}/{_BINS}.0" for k in range(1, _BINS))
_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _poisson_steps() -> list[int]:
    steps, total, part, k = [], 0.0, math.exp(-1), 0
    while round((total + part) * _MODULUS) < _MODULUS:
        total += part
        steps.append(round(total * _MODULUS))
        k += 1
        part /= k
    return steps


ORACLE["feature_cuts"] = _MODEL_ROWS + f""", quantiles AS ({" UNION ALL ".join(
    f"SELECT '{c}' AS feature, UNNEST(quantile_disc({c}, [{_SHARES}])) AS cut, min({c}) AS least FROM rows" for c in _FEATURES
)})
SELECT DISTINCT feature, CAST(cut AS DOUBLE) AS cut FROM quantiles WHERE cut > least"""

_GAINS = _MODEL_ROWS + f""", quantiles AS ({" UNION ALL ".join(
    f"SELECT '{c}' AS feature, UNNEST(quantile_disc({c}, [{_SHARES}])) AS cut, min({c}) AS least FROM rows" for c in _FEATURES
)}),
cuts AS (SELECT feature, list(DISTINCT cut) AS cuts FROM quantiles WHERE cut > least GROUP BY feature),
binned AS ({" UNION ALL ".join(
    f"SELECT feature, len(list_filter(cuts, lambda v: v <= {c})) AS bin, y FROM rows, cuts WHERE feature = '{c}'" for c in _FEATURES
)}
  UNION ALL SELECT 'l_linestatus=' || v, CAST(l_linestatus = v AS INTEGER), y FROM rows, (SELECT DISTINCT l_linestatus AS v FROM rows)),
counted AS (SELECT feature, bin, COUNT(*) AS n, SUM(y) AS s FROM binned GROUP BY feature, bin),
summed AS (
  SELECT feature, bin, CAST(SUM(n) OVER w AS BIGINT) AS n_left, CAST(SUM(s) OVER w AS BIGINT) AS s_left,
         CAST(SUM(n) OVER (PARTITION BY feature) AS BIGINT) AS n, CAST(SUM(s) OVER (PARTITION BY feature) AS BIGINT) AS s
  FROM counted WINDOW w AS (PARTITION BY feature ORDER BY bin ROWS UNBOUNDED PRECEDING)),
gains AS (
  SELECT *, 2.0 * (s_left::DOUBLE * s_left / n_left + (s - s_left)::DOUBLE * (s - s_left) / (n - n_left) - s::DOUBLE * s / n) AS gain
  FROM summed WHERE n_left < n)"""

ORACLE["root_gains"] = _GAINS + f"""
SELECT feature, CAST(bin AS INTEGER) AS bin, {r('gain')} AS gain, n, s, n_left, s_left
FROM gains WHERE gain > 1e-9 * n QUALIFY row_number() OVER (PARTITION BY feature ORDER BY gain DESC, bin) = 1"""

ORACLE["feature_ranking"] = _GAINS + f""",
best AS (SELECT split_part(feature, '=', 1) AS feature, MAX(gain) AS gain FROM gains WHERE gain > 1e-9 * n GROUP BY 1),
shares AS (SELECT feature, CAST(row_number() OVER (ORDER BY gain DESC, feature) AS INTEGER) AS rank, gain / SUM(gain) OVER () AS importance FROM best)
SELECT rank, feature, {r('importance')} AS importance, {r('SUM(importance) OVER (ORDER BY rank ROWS UNBOUNDED PRECEDING)')} AS cumulative,
       CAST(rank <= 3 AS INTEGER) AS selected FROM shares"""

ORACLE["two_period_checks"] = """
WITH rows AS (
  SELECT CASE WHEN l_shipdate < TIMESTAMP '1998-07-01' THEN 'early' ELSE 'late' END AS period,
         CASE WHEN l_extendedprice * (1.0::DOUBLE - l_discount) * (1.0::DOUBLE + l_tax)
                   > CASE WHEN l_returnflag = 'R' THEN 30000.0::DOUBLE ELSE 60000.0::DOUBLE END THEN 1 ELSE 0 END AS y
  FROM lineitem WHERE l_shipdate IS NOT NULL)
SELECT period, COUNT(*) AS n, CAST(SUM(y) AS BIGINT) AS positives, CAST(0 AS BIGINT) AS bad,
       CASE WHEN period = 'early' THEN ROUND(AVG(y), 4) + 0.0 END AS share
FROM rows GROUP BY period"""

ORACLE["type_split_text"] = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS variable, COUNT({c}) AS n, COUNT(DISTINCT {c}) AS values FROM lineitem" for c in ("l_returnflag", "l_linestatus", "l_shipdate")
)

ORACLE["forest_bags"] = f"""
WITH hashed AS (SELECT {_key_hash_sql()} AS h FROM lineitem),
trees(tree, a, c) AS (VALUES {", ".join(f"({t}, {pow(48271, t + 1, _MODULUS)}, {pow(16807, t + 1, _MODULUS)})" for t in range(100))}),
drawn AS (SELECT tree, (CAST(h AS BIGINT) * a + c) % {_MODULUS} AS u FROM hashed, trees),
weighed AS (SELECT tree, {" + ".join(f"CAST(u >= {s} AS INTEGER)" for s in _poisson_steps())} AS w FROM drawn)
SELECT CAST(tree AS INTEGER) AS tree, COUNT(*) FILTER (w > 0) AS in_bag, COUNT(*) FILTER (w = 0) AS out_of_bag, CAST(SUM(w) AS BIGINT) AS weight
FROM weighed GROUP BY tree"""
