"""Point-cloud views of the driver's tables, in SQL that both engines read alike.

{div} stands for truncating integer division.  Positions are centres of base cells, so that both engines agree on
every index; heights are whole millimetres.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_POINTS = """SELECT CAST(event_id {div} 50 + 1 AS INT) AS frame_ts, event_id AS seq, event_id AS idx,
  ((event_id * 7919) % {m} - {h}) * 5e-2 + 25e-3 AS x, ((event_id * 104729) % {m} - {h}) * 5e-2 + 25e-3 AS y,
  ((event_id * 31 + user_id * 17) % 3000 - 1000) / 1e3 AS z, CAST(user_id % 8 AS INT) AS label, ((user_id * 13) % 100) / 1e2 AS intensity
  FROM events"""

_DENSE = _POINTS.replace("(event_id * 104729)", "(event_id * 104729 + user_id * 57 + event_id {div} 41)").replace("{m}", "41").replace("{h}", "20")

VIEWS = {
    "points": (["events"], _POINTS.replace("{m}", "4001").replace("{h}", "2000")),
    "dense": (["events"], _DENSE),
    # several passes over the same cells, with long gaps between
    "passes": (["events"], _DENSE.replace("CAST(event_id {div} 50 + 1 AS INT)", "CAST((event_id {div} 500) * 30 + 1 AS INT)")),
    "poses": (["events"], "SELECT DISTINCT CAST(event_id {div} 50 + 1 AS INT) AS frame_ts, CAST(((event_id {div} 50 + 1) % 40) * 5e-2 AS DOUBLE) AS robot_x, 0e0 AS robot_y, -2e-1 AS ground_z FROM events"),
    "still": (["events"], "SELECT DISTINCT CAST((event_id {div} 500) * 30 + 1 AS INT) AS frame_ts, 0e0 AS robot_x, 0e0 AS robot_y, -2e-1 AS ground_z FROM events"),
    "probes": (["events"], "SELECT event_id AS probe_id, ((event_id * 7919) % 41 - 20) * 5e-2 + 25e-3 AS x, ((event_id * 31) % 41 - 20) * 5e-2 + 25e-3 AS y FROM events"),
    "extents": (["part"], "SELECT p_partkey AS id, p_size * 25e-2 AS length, (p_partkey % 17) * 2e-1 AS width, (p_partkey % 23) * 22e-2 AS height FROM part"),
    "pairs": (["labels"], "SELECT doc_id AS id, quality AS gt, toxic AS pred, (doc_id * 37) % 100 + 0e0 AS rng FROM labels"),
    "raws": (["events"], "SELECT event_id AS id, CAST((event_id * 7 + user_id) % 40 AS INT) AS raw FROM events"),
    "detections": (["events"], "SELECT CAST(event_id % 3 AS BIGINT) AS sensor_id, CAST(event_id {div} 30 + 1 AS INT) AS frame_ts, event_id AS det_id, ((event_id * 7919) % 401 - 200) / 1e1 AS x, ((event_id * 104729) % 401 - 200) / 1e1 AS y, 5e-1 + (user_id % 5) * 2e-1 AS dx, 5e-1 + (user_id % 3) * 3e-1 AS dy FROM events"),
    "truth": (["events"], "SELECT CAST(event_id {div} 30 + 1 AS INT) AS frame_ts, event_id AS truth_id, ((event_id * 6101) % 401 - 200) / 1e1 AS x, ((event_id * 3571) % 401 - 200) / 1e1 AS y FROM events"),
    # three things a sensor on drives of a hundred frames: two that move and one that stands, each missed now and then
    "scene": (["events"], """SELECT s.sensor_id, CAST(f.frame_ts {div} 100 AS BIGINT) AS drive, f.frame_ts, CAST(k.i AS BIGINT) AS det_id, k.x0 + k.v * (f.frame_ts % 100) + s.sensor_id * 2e0 AS cx, k.i * 8e0 AS cy, k.w AS dx, k.w AS dy
  FROM (SELECT DISTINCT CAST(event_id {div} 30 + 1 AS INT) AS frame_ts FROM events) f, (SELECT DISTINCT CAST(event_id % 2 AS BIGINT) AS sensor_id FROM events) s, (VALUES (0, -9e0, 2e-1, 5e-1), (1, 8e0, -15e-2, 8e-1), (2, -9e0, 0e0, 4e0)) AS k(i, x0, v, w)
  WHERE (f.frame_ts * 7 + k.i * 3) % 19 <> 0"""),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables, text = VIEWS[name]
    return spark.sql(text.replace("{div}", "div").replace("FROM events", "FROM {events}").replace("FROM part", "FROM {part}").replace("FROM labels", "FROM {labels}"), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def duck(*names: str) -> str:
    """The views as common table expressions for DuckDB."""
    return ", ".join(f"{n} AS ({VIEWS[n][1].replace('{div}', '//')})" for n in names)
