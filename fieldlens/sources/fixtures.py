"""Views over the star-schema tables that have the shapes of images, boxes, detections, tracks, cameras and rasters.

One SQL text serves Spark and DuckDB; {name} is a table or another view.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from fieldlens.sources.shared import cut

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

VIEWS = {
    "fx_images": """SELECT o_orderkey AS image_id, o_custkey % 20 AS video_id, 640 AS width, 480 AS height,
       concat('survey_', CAST(o_custkey % 20 AS VARCHAR(8)), '_flight_', CAST(o_custkey % 4 AS VARCHAR(8)), '_', CAST(o_orderkey AS VARCHAR(12)), '.JPG') AS file_name,
       o_orderdate AS date_captured FROM {orders}""",
    "fx_categories": """SELECT * FROM (VALUES (1,'salmon'),(2,'bear'),(3,'gull'),(4,'adult male zebra'),(5,'kelp'),(6,'boat'),(7,'unused')) AS t(category_id, name)""",
    "fx_annotations": """SELECT id, image_id, category_id, x, y, w, h, CAST(w*h AS DOUBLE) AS area, iscrowd FROM (
  SELECT l_orderkey*100 + CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,l_partkey,l_suppkey,l_extendedprice,l_shipdate,l_quantity,l_discount,l_tax) AS BIGINT) AS id,
         l_orderkey AS image_id, 1 + (l_partkey + l_linenumber) % 6 AS category_id,
         (l_partkey*37 + l_linenumber*101) % 400 AS x, (l_suppkey*53 + l_linenumber*71) % 300 AS y,
         20 + CAST(l_quantity AS BIGINT)*3 AS w, 20 + l_partkey % 150 AS h, CASE WHEN l_discount >= 0.095 THEN 1 ELSE 0 END AS iscrowd
  FROM {lineitem}) a""",
    "fx_detections": """SELECT id*10 AS det_id, image_id, category_id, x + id % 9 - 4 AS x, y + id % 7 - 3 AS y, w + id % 5 AS w, h + id % 11 AS h,
       CAST((id*7919) % 1009 AS DOUBLE)/1009.0 AS score FROM {fx_annotations} WHERE id % 6 <> 0
UNION ALL SELECT id*10+1, image_id, 1 + id % 6, (x+211) % 500, (y+97) % 400, w, h, CAST((id*10473) % 1009 AS DOUBLE)/1009.0 FROM {fx_annotations} WHERE id % 5 = 0""",
    "fx_tracks": """SELECT user_id AS track_id, user_id % 5 AS observation_id, event_id AS obs_ind, ts,
       CAST((event_id*13 + user_id*29) % 480 AS DOUBLE) AS row_px, CAST((event_id*7 + user_id*31) % 640 AS DOUBLE) AS col_px, value FROM {events}""",
    "fx_anchors": """SELECT CAST(floor(event_id / 37.0E0) AS BIGINT) AS anchor_ind, event_id + CAST(floor(event_id / 37.0E0) AS BIGINT) % 3 AS obs_ind,
       concat('frame_', CAST(CAST(floor(event_id / 37.0E0) AS BIGINT) AS VARCHAR(12)), '.jpg') AS image_name FROM {events} WHERE event_id % 37 = 0""",
    "fx_elevation": """SELECT p_partkey % 20 AS xr, CAST(floor(p_partkey / 20) AS BIGINT) AS yr,
       CASE WHEN p_partkey % 37 = 0 THEN -10000.0E0 ELSE 10.0E0 + (p_partkey*17 % 100)/50.0E0 END AS elev FROM {part}""",
    "fx_metric_log": """SELECT event_type AS meter, user_id % 4 AS rank, event_id AS step, value FROM {events}""",
    "fx_inliers": """SELECT user_id % 5 AS video_id, event_id AS frame, CAST((event_id*37 + user_id*11) % 400 AS BIGINT) AS n_inliers FROM {events}""",
    "fx_cameras": """SELECT anchor_ind, image_name,
       1000.0E0 AS p00, 0.0E0 AS p01, -320.0E0 AS p02, -1000.0E0*(anchor_ind % 20) + 32000.0E0 AS p03,
       0.0E0 AS p10, 1000.0E0 AS p11, -240.0E0 AS p12, -1000.0E0*5 + 24000.0E0 AS p13,
       0.0E0 AS p20, 0.0E0 AS p21, -1.0E0 AS p22, 100.0E0 AS p23 FROM {fx_anchors}""",
    "fx_warps": """SELECT segment, step, 1.0E0 AS m00, 0.001E0 * (step % 5) AS m01, CAST(step AS DOUBLE)*0.25E0 AS m02,
       -0.001E0 * (step % 3) AS m10, 1.0E0 AS m11, CAST(step % 7 AS DOUBLE)*0.5E0 AS m12, 60 + (segment*13 + step*5) % 200 AS n_inliers
FROM (SELECT segment, event_id - segment*37 - segment % 3 AS step FROM (
  SELECT event_id, CASE WHEN event_id % 37 < a % 3 THEN a - 1 ELSE a END AS segment FROM (SELECT event_id, CAST(floor(event_id / 37.0E0) AS BIGINT) AS a FROM {events}) e) f) s
WHERE segment >= 0 AND segment < (SELECT max(anchor_ind) FROM {fx_anchors})""",
}


class Tables:
    """The tables and views of one folder, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir, self.known = spark, sf_dir, {}

    def table(self, name: str) -> DataFrame:
        if name not in self.known:
            if name in VIEWS:
                needs = {n: self.table(n) for n in re.findall(r"\{(\w+)\}", VIEWS[name])}
                self.known[name] = self.spark.sql(VIEWS[name], **needs)
            else:
                self.known[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.known[name]

    def write_once(self, view: str) -> Tables:
        """Writes a view, so that whatever is made of it from here on reads it and doesn't make it again."""
        self.known[view] = cut(self.table(view), view)
        return self

    def __getattr__(self, name: str) -> DataFrame:
        if f"fx_{name}" in VIEWS:
            return self.table(f"fx_{name}")
        if name in BASE:
            return self.table(name)
        raise AttributeError(name)

    @cached_property
    def camera_of_segment(self) -> DataFrame:
        return self.cameras.join(self.anchors.select("anchor_ind", "obs_ind"), "anchor_ind")


def duckdb_sql(sql: str, recursive: bool = False) -> str:
    """sql with the views that it names as common table expressions before it."""
    order: list[str] = []

    def need(text: str) -> None:
        for n in re.findall(r"fx_\w+", text):
            if n in VIEWS and n not in order:
                need(VIEWS[n])
                if n not in order:
                    order.append(n)

    need(sql)
    ctes = [f"{n} AS ({re.sub(r'[{}]', '', VIEWS[n])})" for n in order]
    body = sql.strip()
    if (m := re.match(r"(?i)with (recursive )?", body)) is not None:
        recursive |= bool(m[1])
        ctes.append("")
        body = body[m.end() :]
        return f"WITH {'RECURSIVE ' * recursive}{', '.join(ctes)}{body}" if order else f"WITH {'RECURSIVE ' * recursive}{body}"
    return (f"WITH {', '.join(ctes)} " if order else "") + body
