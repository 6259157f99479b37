"""The nearest-neighbour estimators as SQL over per-window self-joins, for small jobs and for verification.

The same text runs on Spark and on other engines. `rows` is a query with entity, window_idx, idx, x1 .. xn and y;
a window's rows are paired within the window, so the join is bounded by windows times the square of their length.
"""

from __future__ import annotations

from collections.abc import Sequence

LN2 = "0.6931471805599453e0"
GAMMA = "0.5772156649015329e0"


def _largest(terms: Sequence[str]) -> str:
    return terms[0] if len(terms) == 1 else f"greatest({', '.join(terms)})"


def _gap(columns: Sequence[str]) -> str:
    return _largest([f"abs(a.{c} - b.{c})" for c in columns])


def _digamma(counts: str) -> str:
    """A table psi (m, v) of digamma for all counts up to the largest n in the table named."""
    return f"""
ints AS (SELECT DISTINCT rn AS m FROM {counts}),
psi AS (SELECT m, -{GAMMA} + coalesce(sum(1e0 / m) OVER (ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS v FROM ints)"""


def te_sql(rows: str, taus: Sequence[int], history: int = 1, k: int = 3, least_rows: int = 10, least_out: int = 5) -> str:
    """entity, window_idx, te_raw (0 in short windows) of the lagged sources x1 .. xn, taus in their order."""
    n = len(taus)
    xs = [f"x{i + 1}" for i in range(n)]
    past = [f"p{j}" for j in range(1, history + 1)]
    offset = max(max(taus), history) if max(taus) > 0 else max(history, 1)
    lagged = ", ".join([f"lag({x}, {t}) OVER w AS {x}" for x, t in zip(xs, taus)] + [f"lag(y, {j}) OVER w AS p{j}" for j in range(1, history + 1)])
    there = " AND ".join(f"{c} IS NOT NULL" for c in [*xs, "y"])
    dz = _gap(past) if history else "0e0"
    joint = "greatest(dx, dy, dz)" if history else "greatest(dx, dy)"
    n_z = "avg(z.v)"
    value = f"(pk.v + {n_z} - avg(xz.v) - avg(yz.v)) / {LN2}" if history else f"(pk.v + max(pn.v) - avg(xz.v) - avg(yz.v)) / {LN2}"
    return f"""
WITH raw_rows AS ({rows}),
full_rows AS (SELECT entity, window_idx, y, {', '.join(xs)}, row_number() OVER (PARTITION BY entity, window_idx ORDER BY idx) AS rn,
              count(*) OVER (PARTITION BY entity, window_idx) AS n FROM raw_rows WHERE {there}),
lagged AS (SELECT entity, window_idx, rn, n, y, {lagged} FROM full_rows WINDOW w AS (PARTITION BY entity, window_idx ORDER BY rn)),
used AS (SELECT * FROM lagged WHERE rn > {offset} AND n >= {least_rows} AND n - {offset} >= {least_out}),
pairs AS (SELECT a.entity, a.window_idx, a.rn, a.n - {offset} AS n_out, {_gap(xs)} AS dx, abs(a.y - b.y) AS dy, {dz} AS dz
          FROM used a JOIN used b ON a.entity = b.entity AND a.window_idx = b.window_idx),
ranked AS (SELECT *, row_number() OVER (PARTITION BY entity, window_idx, rn ORDER BY {joint}) AS pos FROM pairs),
eps AS (SELECT entity, window_idx, rn, {joint} AS e FROM ranked WHERE pos = {k + 1}),
counts AS (SELECT p.entity, p.window_idx, p.rn, max(p.n_out) AS n_out,
             sum(CASE WHEN greatest(dx, dz) <= e - 1e-15 THEN 1 ELSE 0 END) AS nxz,
             sum(CASE WHEN greatest(dy, dz) <= e - 1e-15 THEN 1 ELSE 0 END) AS nyz,
             sum(CASE WHEN dz <= e - 1e-15 THEN 1 ELSE 0 END) AS nz
           FROM pairs p JOIN eps USING (entity, window_idx, rn) GROUP BY p.entity, p.window_idx, p.rn),{_digamma('full_rows')},
found AS (SELECT c.entity, c.window_idx, {value} AS te_raw
          FROM counts c JOIN psi xz ON xz.m = c.nxz JOIN psi yz ON yz.m = c.nyz JOIN psi z ON z.m = c.nz JOIN psi pn ON pn.m = c.n_out JOIN psi pk ON pk.m = {k}
          GROUP BY c.entity, c.window_idx, pk.v)
SELECT w.entity, w.window_idx, coalesce(f.te_raw, 0e0) AS te_raw
FROM (SELECT DISTINCT entity, window_idx FROM raw_rows) w LEFT JOIN found f ON w.entity = f.entity AND w.window_idx = f.window_idx
"""


def entropy_sql(rows: str, dims: int = 1, k: int = 3, least_rows: int = 10) -> str:
    """entity, window_idx, h_raw of x1 .. xd; 0 in windows of under least_rows complete rows."""
    xs = [f"x{i + 1}" for i in range(dims)]
    there = " AND ".join(f"{x} IS NOT NULL" for x in xs)
    return f"""
WITH raw_rows AS ({rows}),
full_rows AS (SELECT entity, window_idx, {', '.join(xs)}, row_number() OVER (PARTITION BY entity, window_idx ORDER BY idx) AS rn,
              count(*) OVER (PARTITION BY entity, window_idx) AS n FROM raw_rows WHERE {there}),
used AS (SELECT * FROM full_rows WHERE n >= {least_rows}),
pairs AS (SELECT a.entity, a.window_idx, a.rn, a.n, {_gap(xs)} AS d FROM used a JOIN used b ON a.entity = b.entity AND a.window_idx = b.window_idx),
ranked AS (SELECT *, row_number() OVER (PARTITION BY entity, window_idx, rn ORDER BY d) AS pos FROM pairs),{_digamma('full_rows')},
found AS (SELECT r.entity, r.window_idx, (pn.v - pk.v + {dims} * {LN2} + {dims} * avg(ln(r.d))) / {LN2} AS h_raw
          FROM ranked r JOIN psi pn ON pn.m = r.n JOIN psi pk ON pk.m = {k} WHERE r.pos = {k + 1} GROUP BY r.entity, r.window_idx, pn.v, pk.v)
SELECT w.entity, w.window_idx, coalesce(f.h_raw, 0e0) AS h_raw
FROM (SELECT DISTINCT entity, window_idx FROM raw_rows) w LEFT JOIN found f ON w.entity = f.entity AND w.window_idx = f.window_idx
"""


def information_sql(rows: str, dims: int = 1, k: int = 3) -> str:
    """entity, mi: the information in bits between x1 .. xd and y over an entity's complete rows."""
    xs = [f"x{i + 1}" for i in range(dims)]
    there = " AND ".join(f"{c} IS NOT NULL" for c in [*xs, "y"])
    return f"""
WITH full_rows AS (SELECT entity, y, {', '.join(xs)}, row_number() OVER (PARTITION BY entity ORDER BY idx) AS rn, count(*) OVER (PARTITION BY entity) AS n FROM ({rows}) WHERE {there}),
pairs AS (SELECT a.entity, a.rn, a.n, {_gap(xs)} AS dx, abs(a.y - b.y) AS dy FROM full_rows a JOIN full_rows b ON a.entity = b.entity),
ranked AS (SELECT *, row_number() OVER (PARTITION BY entity, rn ORDER BY greatest(dx, dy)) AS pos FROM pairs),
eps AS (SELECT entity, rn, greatest(dx, dy) AS e FROM ranked WHERE pos = {k + 1}),
counts AS (SELECT p.entity, p.rn, max(p.n) AS n, sum(CASE WHEN dx <= e - 1e-15 THEN 1 ELSE 0 END) AS nx, sum(CASE WHEN dy <= e - 1e-15 THEN 1 ELSE 0 END) AS ny
           FROM pairs p JOIN eps USING (entity, rn) GROUP BY p.entity, p.rn),{_digamma('full_rows')}
SELECT c.entity, (pk.v + max(pn.v) - avg(px.v) - avg(py.v)) / {LN2} AS mi
FROM counts c JOIN psi px ON px.m = c.nx JOIN psi py ON py.m = c.ny JOIN psi pn ON pn.m = c.n JOIN psi pk ON pk.m = {k} GROUP BY c.entity, pk.v
"""
