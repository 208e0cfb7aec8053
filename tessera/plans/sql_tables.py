"""Common tables of the oracle SQL: the flow view and the cohorts built from it."""

THRESHOLD = 50000
MAIN, HISTORY = ((1997, 1998), (1999, 2000)), ((1995, 1996), (1997, 1998))


def _window(view: str, years: tuple[int, int], keys: str) -> str:
    return f"SELECT {keys}, CAST(sum(v) AS DOUBLE) / 2 AS v FROM {view} WHERE year IN ({years[0]}, {years[1]}) GROUP BY ALL"


def _lanes(early: str, late: str, pool: str) -> str:
    return f"""SELECT p.i_iso, m.j_iso, p.stage, CASE WHEN l.v IS NULL THEN 0 ELSE 1 END AS y, coalesce(l.v, 0.0) AS lateval
      FROM {pool} p JOIN (SELECT DISTINCT stage, j_iso FROM {early}) m ON p.stage = m.stage AND p.i_iso <> m.j_iso
      LEFT JOIN {late} l ON l.i_iso = p.i_iso AND l.j_iso = m.j_iso AND l.stage = p.stage
      WHERE NOT EXISTS (SELECT 1 FROM {early} e WHERE e.i_iso = p.i_iso AND e.j_iso = m.j_iso AND e.stage = p.stage)"""


def _sized(lanes: str, early: str, capacity: str) -> str:
    return f"""SELECT x.*, ln(1 + coalesce(c.v, 0)) AS log_exporter_capacity, ln(1 + coalesce(d.v, 0)) AS log_importer_demand,
      ln(1 + coalesce(c.v, 0)) + ln(1 + coalesce(d.v, 0)) AS size
      FROM {lanes} x LEFT JOIN {capacity} c ON c.i_iso = x.i_iso AND c.stage = x.stage
      LEFT JOIN (SELECT j_iso, stage, sum(v) AS v FROM {early} GROUP BY ALL) d ON d.j_iso = x.j_iso AND d.stage = x.stage"""


def _entries(lanes: str) -> str:
    return f"""SELECT i_iso, stage, i_iso || '|' || stage AS entry_id, max(y) AS z, sum(lateval) AS entry_lateval,
      min(log_exporter_capacity) AS size, min(log_exporter_capacity) AS log_upstream_capacity,
      count(*) AS n_candidate_destinations, CAST(sum(y) AS BIGINT) AS n_materialized_destinations FROM {lanes} GROUP BY i_iso, stage"""


def _fold(prefix: str, fold) -> dict[str, str]:
    early, late = fold
    p = prefix
    return {
        f"{p}early": f"SELECT * FROM ({_window('flows', early, 'i_iso, j_iso, stage')}) WHERE v > {THRESHOLD}",
        f"{p}late": f"SELECT * FROM ({_window('flows', late, 'i_iso, j_iso, stage')}) WHERE v > {THRESHOLD}",
        f"{p}qualified": f"SELECT DISTINCT e.i_iso, u.stage FROM upstream u JOIN {p}early e ON e.stage = u.source",
        f"{p}incumbents": f"SELECT q.* FROM {p}qualified q SEMI JOIN {p}early e ON e.i_iso = q.i_iso AND e.stage = q.stage",
        f"{p}entrants": f"SELECT q.* FROM {p}qualified q ANTI JOIN {p}early e ON e.i_iso = q.i_iso AND e.stage = q.stage",
        f"{p}own_output": f"SELECT i_iso, stage, sum(v) AS v FROM {p}early GROUP BY ALL",
        f"{p}upstream_output": f"SELECT e.i_iso, u.stage, sum(e.v) AS v FROM upstream u JOIN {p}early e ON e.stage = u.source GROUP BY ALL",
        f"{p}a_raw": _lanes(f"{p}early", f"{p}late", f"{p}incumbents"),
        f"{p}b_raw": _lanes(f"{p}early", f"{p}late", f"{p}entrants"),
        f"{p}a_lanes": _sized(f"{p}a_raw", f"{p}early", f"{p}own_output"),
        f"{p}b_lanes": _sized(f"{p}b_raw", f"{p}early", f"{p}upstream_output"),
        f"{p}entries": _entries(f"{p}b_lanes"),
        f"{p}b2_lanes": f"SELECT b.* FROM {p}b_lanes b SEMI JOIN (SELECT * FROM {p}entries WHERE z = 1) e ON e.i_iso = b.i_iso AND e.stage = b.stage",
    }


_FLOW = """SELECT {i} AS i_iso, 'N' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS j_iso, p_brand AS stage,
  lpad(split_part(p_brand, '#', 2), 2, '0') || lpad(CAST(p_size AS VARCHAR), 2, '0') ||
  CASE split_part(p_type, ' ', 1) WHEN 'ECONOMY' THEN '01' WHEN 'STANDARD' THEN '02' WHEN 'SMALL' THEN '03' WHEN 'MEDIUM' THEN '04' WHEN 'LARGE' THEN '05' ELSE '06' END AS k,
  CAST(year(o_orderdate) AS INTEGER) AS year, CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS v
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey"""

TABLES: dict[str, str] = {
    "flows": _FLOW.format(i="'S' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0')"),
    "nflows": _FLOW.format(i="'N' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0')"),
    "stages": """SELECT 'Brand#' || b AS stage, 'c' || CAST((b - 1) // 5 AS VARCHAR) AS chain, (b - 1) % 5 AS position,
      [0, 0, 1, 2, 3][(b - 1) % 5 + 1] AS tier FROM range(1, 26) t(b)""",
    "upstream": """SELECT t.stage, s.stage AS source, t.chain FROM stages t JOIN (VALUES (2, 0), (2, 1), (3, 0), (3, 2), (4, 1), (4, 3)) m(a, b)
      ON t.position = m.a JOIN stages s ON s.chain = t.chain AND s.position = m.b""",
    **_fold("", MAIN),
    **_fold("h_", HISTORY),
    "covariates": """SELECT 'S' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS i_iso, 'N' || lpad(CAST(n.n_nationkey AS VARCHAR), 2, '0') AS j_iso,
      abs(s_nationkey - n.n_nationkey) + 1 AS dist, CASE WHEN sn.n_regionkey = n.n_regionkey THEN 1 ELSE 0 END AS contig,
      CASE WHEN s_nationkey % 2 = n.n_nationkey % 2 THEN 1 ELSE 0 END AS comlang FROM supplier JOIN nation sn ON s_nationkey = sn.n_nationkey CROSS JOIN nation n""",
    "n_early": "SELECT i_iso, j_iso, stage, v FROM (SELECT *, avg(v) OVER () AS a FROM (" + _window("nflows", (1997, 1998), "i_iso, j_iso, stage") + ")) WHERE v > a",
}
