"""2.O similarity and clustering."""

from quarterhour.catalog.core import query
from quarterhour.operators import similar_targets as targets
from quarterhour.operators import similarity as sim
from quarterhour.operators.clusters import load_shape_clusters

T = "2024-01-24"
_W = {"euclidean": (1.0, 1.0, 1.0), "weighted": (1.0, 0.5, 0.3)}


def _sql(method):
    d = "DATE '2024-01-24'"
    vs = ("temperature", "humidity", "precipitation")
    st = ", ".join(f"avg({x}) AS m_{x}, CASE WHEN stddev_pop({x}) > 1e-9 THEN stddev_pop({x}) ELSE 1 END AS s_{x}" for x in vs)
    base = f"""s AS (SELECT state, {st} FROM v_wmean WHERE date < {d} GROUP BY state), z AS (SELECT w.state, w.date, w.block, {', '.join(f'({x} - m_{x}) / s_{x} AS {x}' for x in vs)} FROM v_wmean w JOIN s USING (state) WHERE date <= {d}),
      j AS (SELECT c.state, c.date, {', '.join(f'c.{x} AS c_{x}, t.{x} AS t_{x}' for x in vs)} FROM z c JOIN z t ON t.state = c.state AND t.block = c.block AND t.date = {d} WHERE c.date < {d})"""
    n = " + ".join(f"CASE WHEN c_{x} IS NOT NULL AND t_{x} IS NOT NULL THEN 1 ELSE 0 END" for x in vs)
    if method == "cosine":
        num = " + ".join(f"coalesce(c_{x} * t_{x}, 0)" for x in vs)
        a = " + ".join(f"CASE WHEN t_{x} IS NOT NULL THEN coalesce(c_{x} * c_{x}, 0) ELSE 0 END" for x in vs)
        b = " + ".join(f"CASE WHEN c_{x} IS NOT NULL THEN coalesce(t_{x} * t_{x}, 0) ELSE 0 END" for x in vs)
        dist = f"1 - coalesce(sum({num}) / nullif(sqrt(sum({a}) * sum({b})), 0), 0)"
    else:
        w = dict(zip(vs, _W[method]))
        sq = " + ".join(f"coalesce({w[x]}::DOUBLE * pow(c_{x} - t_{x}, 2), 0)" for x in vs)
        ws = " + ".join(f"CASE WHEN c_{x} IS NOT NULL AND t_{x} IS NOT NULL THEN {w[x]}::DOUBLE ELSE 0 END" for x in vs)
        dist = f"sqrt(sum({sq}) / nullif(sum({ws}), 0))"
    return f"""{base}, g AS (SELECT state, date, {dist} AS distance, sum({n}) / 288.0::DOUBLE AS coverage FROM j GROUP BY state, date HAVING sum({n}) / 288.0::DOUBLE >= 0.4),
      sd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY round(distance, 9), date) AS rank FROM g WHERE distance IS NOT NULL) WHERE rank <= 5)"""


for _m in ("euclidean", "weighted", "cosine"):
    @query(f"o1_similar_days_{_m}", "state date distance:f coverage:f rank:i day_of_week", f"WITH {_sql(_m)} SELECT *, dayname(date) AS day_of_week FROM sd")
    def _(v, m=_m):
        return sim.similar_days(v.wmean, T, m, 5, 0.4)


def _all_sql(method):
    """Every target with every earlier day, block by block; standardised over the days before the target."""
    vs = ("temperature", "humidity", "precipitation")
    st = ", ".join(f"avg(c.{x}) AS m_{x}, CASE WHEN stddev_pop(c.{x}) > 1e-9 THEN stddev_pop(c.{x}) ELSE 1 END AS s_{x}" for x in vs)
    ok = {x: f"c.{x} IS NOT NULL AND t.{x} IS NOT NULL" for x in vs}
    n = " + ".join(f"CASE WHEN {ok[x]} THEN 1 ELSE 0 END" for x in vs)
    z = lambda a, x: f"(({a}.{x} - m_{x}) / s_{x})"
    if method == "cosine":
        num = " + ".join(f"coalesce({z('c', x)} * {z('t', x)}, 0)" for x in vs)
        own = lambda a: " + ".join(f"CASE WHEN {ok[x]} THEN {z(a, x)} * {z(a, x)} ELSE 0 END" for x in vs)
        dist = f"1 - coalesce(sum({num}) / nullif(sqrt(sum({own('c')}) * sum({own('t')})), 0), 0)"
    else:
        w = dict(zip(vs, _W[method]))
        sq = " + ".join(f"coalesce({w[x]}::DOUBLE * pow({z('c', x)} - {z('t', x)}, 2), 0)" for x in vs)
        ws = " + ".join(f"CASE WHEN {ok[x]} THEN {w[x]}::DOUBLE ELSE 0 END" for x in vs)
        dist = f"sqrt(sum({sq}) / nullif(sum({ws}), 0))"
    return f"""ds AS (SELECT DISTINCT state, date FROM v_wmean), s AS (SELECT ds.state, ds.date AS target, {st} FROM ds JOIN v_wmean c ON c.state = ds.state AND c.date < ds.date GROUP BY ALL),
      g AS (SELECT c.state, t.date AS target, c.date, {dist} AS distance, sum({n}) / 288.0::DOUBLE AS coverage FROM v_wmean t JOIN s ON s.state = t.state AND s.target = t.date JOIN v_wmean c ON c.state = t.state AND c.block = t.block AND c.date < t.date
        GROUP BY c.state, t.date, c.date HAVING sum({n}) / 288.0::DOUBLE >= 0.4),
      sd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY state, target ORDER BY round(distance, 9), date) AS rank FROM g WHERE distance IS NOT NULL) WHERE rank <= 5)"""


for _m in ("euclidean", "weighted", "cosine"):
    @query(f"o1_all_targets_{_m}", "state target date distance:f coverage:f rank:i day_of_week", f"WITH {_all_sql(_m)} SELECT *, dayname(date) AS day_of_week FROM sd")
    def _(v, m=_m):
        return targets.similar_profiles(v.wmean, method=m, k=5, min_coverage=0.4)


@query("o4_all_targets_load_change", "state target date rank:i avg_load:f change_pct:f", f"""
    WITH {_all_sql('weighted')}, m AS (SELECT state, date, avg(load) AS a FROM v_load GROUP BY ALL)
    SELECT sd.state, target, sd.date, rank, m.a AS avg_load, (m.a - t.a) / t.a * 100 AS change_pct FROM sd LEFT JOIN m USING (state, date) LEFT JOIN m t ON t.state = sd.state AND t.date = target""")
def _(v):
    return targets.load_changes(targets.similar_profiles(v.wmean, method="weighted", k=5, min_coverage=0.4), v.load)


@query("o2_standardised", "state date scaled:f", """
    WITH d AS (SELECT state, date, sum(load) AS s FROM v_load GROUP BY ALL), x AS (SELECT *, avg(s) OVER w AS m, stddev_pop(s) OVER w AS sd, min(s) OVER w AS lo, max(s) OVER w AS hi FROM d WINDOW w AS (PARTITION BY state))
    SELECT state, date, CASE WHEN sd > 1e-9 THEN (s - m) / sd WHEN hi - lo > 1e-9 THEN (s - lo) / (hi - lo) ELSE 0 END AS scaled FROM x""")
def _(v):
    from pyspark.sql import functions as F
    return sim.standardised(v.load.groupBy("state", "date").agg(F.sum("load").alias("s")), "s")


@query("o3_load_shape_clusters", "state date cluster:i")
def _(v):
    return load_shape_clusters(v.load)[0]


@query("o3_cluster_profiles", "cluster:i block:i mean_load:f days:i")
def _(v):
    return load_shape_clusters(v.load)[1]


@query("o4_load_change_of_similar_days", "state date rank:i avg_load:f change_pct:f", f"""
    WITH {_sql('euclidean')}, m AS (SELECT state, date, avg(load) AS a FROM v_load GROUP BY ALL)
    SELECT sd.state, sd.date, rank, m.a AS avg_load, (m.a - t.a) / t.a * 100 AS change_pct FROM sd LEFT JOIN m USING (state, date) LEFT JOIN m t ON t.state = sd.state AND t.date = DATE '2024-01-24' """)
def _(v):
    return sim.load_change_of(sim.similar_days(v.wmean, T, "euclidean", 5, 0.4), v.load, T)
