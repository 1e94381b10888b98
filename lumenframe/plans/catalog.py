"""Query registry and the SQL fragments its checks are built from.

A registered query is a callable (spark, sf_dir) -> DataFrame. ``sql`` is an
independent statement of the same result for another engine; queries that SQL
cannot express have none.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenframe.session import ship

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        @functools.wraps(fn)
        def run(spark, sf_dir):
            ship(spark)
            return fn(spark, sf_dir)
        QUERIES[fn.__name__] = run
        if sql:
            ORACLES[fn.__name__] = sql
        return fn
    return register


def r6(expr) -> Column:
    """Six-decimal rounding that both engines compute alike; NaN stays (``floor`` would make it 0)."""
    expr = F.col(expr) if isinstance(expr, str) else expr
    return F.when(F.isnan(expr.cast("double")), F.lit(float("nan"))).otherwise(F.floor(expr * 1e6 + 0.5) / 1e6)


def q6(expr: str) -> str:
    return f"floor(({expr}) * 1e6 + 0.5) / 1e6"


# Common table expressions. Each may use the ones listed before it.
CTE = {
    "img": """
        SELECT CAST(vec_id % 5 + 1 AS INT) c, CAST((vec_id // 5) // 4 AS INT) z,
               CAST(((vec_id // 5) % 4) // 2 * 8 + i // 8 AS INT) y,
               CAST((vec_id // 5) % 2 * 8 + i % 8 AS INT) x,
               CAST(floor((CAST(e AS DOUBLE) + 1) * 32767.5) AS INT) v,
               CAST(((vec_id // 5) % 4) // 2 AS INT) ty, CAST((vec_id // 5) % 2 AS INT) tx,
               CAST(i // 8 AS INT) ly, CAST(i % 8 AS INT) lx
        FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 i, unnest(embedding) e
              FROM embeddings)""",
    "info": "SELECT max(z) + 1 depth, 16 height, 16 width FROM img",
    "pun": """
        SELECT event_id punctum_id, CAST(user_id % 16 AS INT) x, CAST(event_id % 16 AS INT) y,
               CAST((event_id // 16) % 30 AS INT) z, value mass FROM events""",
    "pvox": """
        SELECT punctum_id, p.z, p.y + dy y, p.x + dx x FROM pun p
        CROSS JOIN (VALUES (-1), (0), (1)) a(dy) CROSS JOIN (VALUES (-1), (0), (1)) b(dx)
        WHERE p.y + dy BETWEEN 0 AND 15 AND p.x + dx BETWEEN 0 AND 15""",
    "box": """
        SELECT punctum_id, p.x, p.y, p.z, count(*) n_voxels, min(v.x) x_min, max(v.x) x_max,
               min(v.y) y_min, max(v.y) y_max
        FROM pun p JOIN pvox v USING (punctum_id) GROUP BY ALL""",
    "roi": """
        SELECT box.*, greatest(0, x_min - 5) x1, least(width, x_max + 5) x2,
               greatest(0, y_min - 5) y1, least(height, y_max + 5) y2,
               least(greatest(z, 0), depth - 1) z_sample, depth, height, width
        FROM box, info""",
    "thr": "SELECT c, quantile_cont(v, 0.95) thr FROM img GROUP BY c",
    "mask": "SELECT i.c, i.z, i.y, i.x, i.v FROM img i JOIN thr USING (c) WHERE v > thr",
    "cover": """
        SELECT z_sample z, yy y, xx x, count(*) w
        FROM (SELECT z_sample, unnest(range(y1, y2)) yy, x1, x2 FROM roi),
             LATERAL (SELECT unnest(range(x1, x2)) xx) GROUP BY ALL""",
    # ROI pixel bag as (value, repeats)
    "bag": """SELECT c, v, sum(w) n FROM img JOIN cover USING (z, y, x) GROUP BY c, v""",
    # percentile of a weighted bag: the values at the two ranks around (N-1)p
    "bagthr": """
        SELECT c, min(v) FILTER (WHERE cum > floor(h)) * (1 - (min(h) - floor(min(h))))
                + min(v) FILTER (WHERE cum > ceil(h)) * (min(h) - floor(min(h))) thr
        FROM (SELECT c, v, sum(n) OVER (PARTITION BY c ORDER BY v) cum,
                     (sum(n) OVER (PARTITION BY c) - 1) * 0.95 h FROM bag) GROUP BY c""",
    "cmask": "SELECT i.c, i.z, i.y, i.x, i.v FROM img i JOIN bagthr USING (c) WHERE v > thr",
}


def with_ctes(names: str, body: str, extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    """WITH clause of the named fragments (space separated) plus ``extra`` ones."""
    parts = [f"{n} AS MATERIALIZED ({CTE[n]})" for n in names.split()]
    parts += [f"{n} AS ({q})" for n, q in (extra or {}).items()]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + body


# reusable groups
ROI_BASE = "img info pun pvox box roi"
BAG_BASE = ROI_BASE + " cover bag bagthr"


def reach(mask: str, key: str, eight: bool = True, prefix: str = "") -> dict[str, str]:
    """Component labels by recursive reachability: fragment ``{prefix}lab``(key, y, x, label)."""
    near = "abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1" if eight else "abs(a.y - b.y) + abs(a.x - b.x) <= 1"
    keys = key.split(", ")
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys)
    a_keys = ", ".join(f"a.{k}" for k in keys)
    r, lab = f"{prefix}reach", f"{prefix}lab"
    return {
        r: f"""
            SELECT {key}, y, x, CAST(y AS BIGINT) * 4294967296 + x code FROM {mask}
            UNION
            SELECT {', '.join(f'b.{k}' for k in keys)}, b.y, b.x, a.code FROM {r} a JOIN {mask} b
            ON {on} AND {near}""",
        lab: f"SELECT {key}, y, x, min(code) AS label FROM {r} GROUP BY {key}, y, x",
    }
