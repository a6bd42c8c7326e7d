"""Queries that run a stream to its end; each equals its batch query."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillframe.plans import tracks
from quillframe.plans.sequences import FRAMES
from quillframe.streaming import tracks as st

PACE = 86400


def stream_dedup(spark, d):
    """Every event arrives twice and is let through once."""
    twice = st.event_stream(spark, d).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    return st.drain(st.deduplicated(twice).select("event_id", "user_id", F.round("value", 6).alias("value")), spark)


def stream_audit(spark, d):
    return st.drain(st.audited(st.event_stream(spark, d)), spark)


def stream_contact(spark, d):
    return st.drain(st.contacts(st.event_stream(spark, d)), spark)


def stream_sessions(spark, d):
    return st.drain(st.sessions(st.event_stream(spark, d)), spark)


def stream_gated(spark, d):
    return st.drain(st.gated_means(st.event_stream(spark, d)), spark)


def stream_paced(spark, d):
    return st.drain(st.paced(st.event_stream(spark, d), PACE), spark)


SQL = {
    "stream_dedup": "SELECT event_id, user_id, round(value, 6) AS value FROM events",
    "stream_audit": tracks.SQL["health_machine"],
    "stream_contact": f"""WITH {FRAMES}, r AS (SELECT slug, cls, event_id, count(*) OVER w AS support, avg(CAST(signal > 30 AS DOUBLE)) OVER w AS contact FROM frames
      WINDOW w AS (PARTITION BY slug, cls ORDER BY frame ROWS BETWEEN 89 PRECEDING AND CURRENT ROW)) SELECT slug, cls, event_id, support, round(contact, 6) AS contact FROM r WHERE support >= 15""",
    "stream_sessions": """WITH s AS (SELECT *, CAST(count(*) FILTER (WHERE event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM events)
      SELECT user_id AS slug, event_id, session, row_number() OVER (PARTITION BY user_id, session ORDER BY ts, event_id) AS held FROM s""",
    "stream_gated": """WITH g AS (SELECT *, event_type NOT IN ('error', 'signup') AND value >= 20 AS ok FROM events)
      SELECT user_id AS slug, event_id, count(*) FILTER (WHERE ok) OVER w AS n, round(avg(value) FILTER (WHERE ok) OVER w, 6) AS mean FROM g WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
    "stream_paced": f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events),
      f AS (SELECT a.user_id, a.nth, a.event_id, min(b.nth) AS next FROM e a LEFT JOIN e b ON a.user_id = b.user_id AND b.us >= a.us + {PACE * 1000000} AND b.nth > a.nth GROUP BY ALL),
      k AS (SELECT * FROM f WHERE nth = 1 UNION ALL SELECT f.* FROM k JOIN f ON k.user_id = f.user_id AND f.nth = k.next) SELECT user_id AS slug, event_id FROM k""",
}
QUERIES = {name: globals()[name] for name in SQL}
