"""Queries over grouped reports, table maintenance and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillframe.functions import scalars as sc
from quillframe.operators import evaluation as ev
from quillframe.plans.tracks import SIGNALS, verdicts
from quillframe.session import stacked, table


def scan_prune(spark, d):
    """Column pruning and pushed filters reach the Parquet scan."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey").filter("l_quantity >= 49")
    return li.orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def chunk_union_offset(spark, d):
    """Sources behind one another, with offset ids and their provenance."""
    s = table(spark, d, "supplier").select((F.lit(0) + F.col("s_suppkey")).alias("shot"), F.lit("supplier").alias("root"))
    return stacked(s, table(spark, d, "customer").select((F.lit(1000) * 1000 + F.col("c_custkey")).alias("shot"), F.lit("customer").alias("root")))


def upsert_registry(spark, d):
    """Fresh rows replace those of their key; others stay."""
    old = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.lit("old").alias("version"))
    new = table(spark, d, "lineitem").filter("l_quantity > 45").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linestatus").alias("status")).withColumn("version", F.lit("new"))
    return stacked(old.join(new, "o_orderkey", "left_anti"), new)


def anti_resume(spark, d):
    done = table(spark, d, "lineitem").filter("l_linenumber >= 3").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey").join(done, "o_orderkey", "left_anti")


def semi_wanted(spark, d):
    wanted = table(spark, d, "lineitem").filter("l_discount > 0.09").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus").join(wanted, "o_orderkey", "left_semi")


def probe_first_reader(spark, d):
    """The first of several readers that hold a key answers."""
    a = table(spark, d, "lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("k"), F.lit(0).alias("reader"), F.col("l_partkey").alias("hit"))
    b = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.lit(1).alias("reader"), F.col("o_custkey").alias("hit"))
    first = F.row_number().over(Window.partitionBy("k").orderBy("reader", "hit"))
    return stacked(a, b).withColumn("nth", first).filter("nth = 1").drop("nth")


def four_way(spark, d):
    li, o, c, n = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation"))
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def right_padded(spark, d):
    """Flags joined by position, false where there is none."""
    flagged = table(spark, d, "labels").filter("toxic = 1").select("doc_id", F.lit(True).alias("flag"))
    return table(spark, d, "documents").select("doc_id").join(flagged, "doc_id", "left").select("doc_id", F.coalesce("flag", F.lit(False)).alias("dropped"))


def gold_keep(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").filter("quality = 1").select("doc_id", "lang")


def union_distinct(spark, d):
    l = table(spark, d, "labels")  # noqa: E741
    return stacked(l.filter("quality = 1").select("doc_id"), l.filter("toxic = 1").select("doc_id")).distinct()


def except_pool(spark, d):
    return table(spark, d, "documents").select("doc_id").exceptAll(table(spark, d, "labels").filter("quality = 1").select("doc_id"))


def intersect_ids(spark, d):
    l = table(spark, d, "labels")  # noqa: E741
    return l.filter("quality = 0").select("doc_id").intersect(l.filter("toxic = 1").select("doc_id"))


def group_rollup(spark, d):
    li = table(spark, d, "lineitem").rollup("l_returnflag").agg(F.round(F.avg("l_quantity"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))
    return li.withColumn("l_returnflag", F.coalesce("l_returnflag", F.lit("ALL")))


def bins_having(spark, d):
    b = table(spark, d, "lineitem").withColumn("bin", ev.binned(F.col("l_tax") * 10, [0, 0.2, 0.4, 0.6, 0.8, 1.01]))
    return b.filter("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean")).filter("n >= 10")


def bin_rates(spark, d):
    b = table(spark, d, "orders").withColumn("bin", ev.binned(F.col("o_totalprice"), [0, 50000, 150000, 300000, 1e12]))
    urgent, done = F.col("o_orderpriority").startswith("1"), F.col("o_orderstatus") == "F"
    rate = lambda c: F.round(F.avg(c.cast("double")), 6)
    return b.filter("bin is not null").groupBy("bin").agg(rate(urgent).alias("t"), rate(done).alias("s"), rate(urgent | done).alias("either"))


def rank_sum(spark, d):
    return ev.rank_sums(table(spark, d, "orders"), "o_totalprice", F.col("o_orderstatus") == "F").withColumn("ties", F.round("ties", 3))


def mannwhitney_u(spark, d):
    return ev.one_sided_p(ev.rank_sums(table(spark, d, "orders"), "o_totalprice", F.col("o_orderstatus") == "F"))


def win_loss(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(*ev.wins(F.col("l_discount") - F.col("l_tax"), 0.0451))


def tail_vs_control(spark, d):
    """The worst n orders against n hash-ordered ones."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    tail = o.orderBy("o_totalprice", "o_orderkey").limit(100).withColumn("label", F.lit("tail"))
    control = o.orderBy(F.md5(F.col("o_orderkey").cast("string")), "o_orderkey").limit(100).withColumn("label", F.lit("control"))
    return stacked(tail, control).groupBy("label").agg(F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.avg((F.col("o_totalprice") < 20000).cast("double")), 6).alias("low"))


def run_summary(spark, d):
    e = table(spark, d, "events")
    return e.agg(
        F.round(F.avg("value"), 6).alias("mean"), F.round(F.percentile("value", F.lit(0.1)), 6).alias("p10"), F.count_if(F.col("value") < 0.6).alias("low"),
        F.count_if(F.col("event_type") == "error").alias("errors"), F.round(F.count_if(F.col("value") > 50) / F.greatest(F.count(F.lit(1)), F.lit(1)), 6).alias("attributed"),
    )


def percentiles(spark, d):
    q = F.percentile("l_extendedprice", F.array(*map(F.lit, (0.05, 0.1, 0.2, 0.6, 0.8))))
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(q.alias("q")).select("l_returnflag", *(F.round(F.col("q")[i], 4).alias(n) for i, n in enumerate(("p05", "p10", "p20", "p60", "p80"))))


def verdict_lists(spark, d):
    per = verdicts(spark, d).groupBy("verdict").agg(F.count(F.lit(1)).alias("n_shots"), F.array_join(F.array_sort(F.collect_list("slug")), ",").alias("slugs"))
    return per


def flag_counts(spark, d):
    return verdicts(spark, d).select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


def cost_rollup(spark, d):
    c = table(spark, d, "conversations").withColumn("n", F.length("text"))
    used = c.groupBy("conv_id").agg(F.sum(F.when(F.col("role") == "user", F.col("n")).otherwise(0)).alias("i"), F.sum(F.when(F.col("role") != "user", F.col("n")).otherwise(0)).alias("o"))
    return used.select("conv_id", F.round(ev.usage_cost(F.col("i"), F.floor(F.col("i") / 2), F.col("o")), 8).alias("cost"))


def rate_window(spark, d):
    """Calls in the trailing hour, and whether they stay within the limit."""
    e = table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    n = F.count(F.lit(1)).over(Window.partitionBy("event_type").orderBy("t").rangeBetween(-3_600_000_000, 0))
    return e.select("event_id", n.alias("n"), (n <= 12).alias("within"))


def chunk_audit(spark, d):
    li = table(spark, d, "lineitem").withColumn("chunk", F.floor(F.col("l_orderkey") / 1000))
    return li.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min("l_orderkey").alias("first"), F.max("l_orderkey").alias("last"), F.round(F.sum("l_quantity") / F.count(F.lit(1)), 6).alias("per_row"))


def disagreement(spark, d):
    o = table(spark, d, "lineitem").withColumn("strong", F.abs(F.col("l_discount") - F.col("l_tax")) > 0.0651)
    return o.groupBy("l_suppkey").agg(F.count_if("strong").alias("strong"), F.count_if(F.col("strong") & (F.col("l_discount") > F.col("l_tax"))).alias("student"), F.round(F.avg(F.col("strong").cast("double")) * 100, 6).alias("dropped"))


def longest_shot(spark, d):
    o = table(spark, d, "orders")
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return o.withColumn("nth", nth).filter("nth = 1").select("o_custkey", "o_orderkey", F.round("o_totalprice", 2).alias("price"))


def bottom_and_first(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.round("o_totalprice", 2).alias("price"))
    low = o.orderBy("price", "o_orderkey").limit(6).withColumn("kind", F.lit("bottom"))
    return stacked(low, o.orderBy("o_orderkey").limit(400).withColumn("kind", F.lit("first")))


def slugify(spark, d):
    return table(spark, d, "part").select("p_partkey", sc.slugify(F.concat_ws(" _-", "p_name", "p_brand", "p_type")).alias("slug"))


def rational_parse(spark, d):
    p = table(spark, d, "part").withColumn("text", F.concat_ws("/", (F.col("p_partkey") * 1000).cast("string"), (F.col("p_size") % 7).cast("string")))
    return p.select("p_partkey", sc.rational(F.col("text")).alias("fps"))


def hms(spark, d):
    return table(spark, d, "part").select("p_partkey", sc.minutes_seconds(F.col("p_retailprice")).alias("shown"), sc.frame_key(F.lit("part"), F.col("p_partkey")).alias("key"))


def range_parse(spark, d):
    text = F.when(F.col("p_size") % 5 == 0, F.lit("x:9")).otherwise(F.concat_ws(":", F.col("p_size").cast("string"), F.col("p_partkey").cast("string")))
    return table(spark, d, "part").select("p_partkey", sc.span_bounds(text).alias("b")).select("p_partkey", "b.start", "b.end")


def wrap_text(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.posexplode(sc.wrap(F.col("text"), 40)).alias("nth", "line"))


def hex_colour(spark, d):
    text = F.concat(F.lit("#"), F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 6))
    return table(spark, d, "part").select("p_partkey", sc.hex_colour(text).alias("c")).select("p_partkey", "c.red", "c.green", "c.blue")


def chunk_name(spark, d):
    name = F.concat_ws("_", F.lit("chunk"), (F.col("p_partkey") * 10).cast("string"), (F.col("p_partkey") * 10 + 10).cast("string"))
    part = lambda i: F.regexp_extract(name, r"chunk_(\d+)_(\d+)", i).cast("long")
    return table(spark, d, "part").select("p_partkey", part(1).alias("first"), part(2).alias("last"))


def json_parse(spark, d):
    """A verdict that abstains never swaps: whatever else it says."""
    j = F.from_json("props", "k long")["k"]
    unclear = j % 2 == 0
    return table(spark, d, "events").select("event_id", j.alias("k"), F.when(unclear, F.lit(False)).otherwise(j % 3 == 0).alias("swap"))


SQL = {
    "scan_prune": "SELECT l_orderkey, l_linenumber, l_quantity, l_partkey, l_suppkey FROM lineitem WHERE l_quantity >= 49",
    "chunk_union_offset": "SELECT s_suppkey AS shot, 'supplier' AS root FROM supplier UNION ALL SELECT 1000000 + c_custkey, 'customer' FROM customer",
    "upsert_registry": """WITH n AS (SELECT l_orderkey AS o_orderkey, max(l_linestatus) AS status, 'new' AS version FROM lineitem WHERE l_quantity > 45 GROUP BY l_orderkey)
      SELECT o_orderkey, o_orderstatus AS status, 'old' AS version FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM n) UNION ALL SELECT * FROM n""",
    "anti_resume": "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber >= 3)",
    "semi_wanted": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.09)",
    "probe_first_reader": """WITH u AS (SELECT l_orderkey AS k, 0 AS reader, l_partkey AS hit FROM lineitem WHERE l_linenumber = 1 UNION ALL SELECT o_orderkey, 1, o_custkey FROM orders)
      SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY k ORDER BY reader, hit) = 1""",
    "four_way": "SELECT n_name, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "right_padded": "SELECT d.doc_id, l.doc_id IS NOT NULL AS dropped FROM documents d LEFT JOIN (SELECT doc_id FROM labels WHERE toxic = 1) l ON d.doc_id = l.doc_id",
    "gold_keep": "SELECT l.doc_id, lang FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE quality = 1",
    "union_distinct": "SELECT doc_id FROM labels WHERE quality = 1 UNION SELECT doc_id FROM labels WHERE toxic = 1",
    "except_pool": "SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels WHERE quality = 1",
    "intersect_ids": "SELECT doc_id FROM labels WHERE quality = 0 INTERSECT SELECT doc_id FROM labels WHERE toxic = 1",
    "group_rollup": "SELECT coalesce(l_returnflag, 'ALL') AS l_returnflag, round(avg(l_quantity), 6) AS mean, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag)",
    "bins_having": """WITH b AS (SELECT *, CASE WHEN l_tax * 10 < 0 THEN NULL WHEN l_tax * 10 < 0.2 THEN 0 WHEN l_tax * 10 < 0.4 THEN 1 WHEN l_tax * 10 < 0.6 THEN 2 WHEN l_tax * 10 < 0.8 THEN 3 WHEN l_tax * 10 < 1.01 THEN 4 END AS bin FROM lineitem)
      SELECT bin, count(*) AS n, round(avg(l_quantity), 6) AS mean FROM b WHERE bin IS NOT NULL GROUP BY bin HAVING count(*) >= 10""",
    "bin_rates": """WITH b AS (SELECT CASE WHEN o_totalprice < 50000 THEN 0 WHEN o_totalprice < 150000 THEN 1 WHEN o_totalprice < 300000 THEN 2 ELSE 3 END AS bin, starts_with(o_orderpriority, '1') AS u, o_orderstatus = 'F' AS f FROM orders WHERE o_totalprice >= 0)
      SELECT bin, round(avg(CAST(u AS DOUBLE)), 6) AS t, round(avg(CAST(f AS DOUBLE)), 6) AS s, round(avg(CAST(u OR f AS DOUBLE)), 6) AS either FROM b GROUP BY bin""",
    "rank_sum": """WITH c AS (SELECT o_totalprice AS v, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS n1 FROM orders GROUP BY 1),
      r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2 AS k FROM c)
      SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(n1) AS BIGINT) AS n1, sum(k * n1) - sum(n1) * (sum(n1) + 1) / 2 AS u, round(sum(CAST(n AS DOUBLE) * (n * n - 1)), 3) AS ties FROM r""",
    "win_loss": """SELECT l_returnflag, count(*) FILTER (WHERE l_discount - l_tax > 0.0451) AS wins, count(*) FILTER (WHERE l_discount - l_tax < -0.0451) AS losses, count(*) FILTER (WHERE abs(l_discount - l_tax) <= 0.0451) AS draws FROM lineitem GROUP BY l_returnflag""",
    "tail_vs_control": """WITH t AS (SELECT 'tail' AS label, o_totalprice FROM (SELECT * FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 100)), c AS (SELECT 'control' AS label, o_totalprice FROM (SELECT * FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 100))
      SELECT label, round(avg(o_totalprice), 4) AS mean, round(avg(CAST(o_totalprice < 20000 AS DOUBLE)), 6) AS low FROM (SELECT * FROM t UNION ALL SELECT * FROM c) GROUP BY label""",
    "run_summary": """SELECT round(avg(value), 6) AS mean, round(quantile_cont(value, 0.1), 6) AS p10, count(*) FILTER (WHERE value < 0.6) AS low, count(*) FILTER (WHERE event_type = 'error') AS errors,
      round(count(*) FILTER (WHERE value > 50) / greatest(count(*), 1), 6) AS attributed FROM events""",
    "percentiles": "SELECT l_returnflag, " + ", ".join(f"round(quantile_cont(l_extendedprice, {q}), 4) AS {n}" for n, q in (("p05", 0.05), ("p10", 0.1), ("p20", 0.2), ("p60", 0.6), ("p80", 0.8))) + " FROM lineitem GROUP BY l_returnflag",
    "verdict_lists": f"WITH {SIGNALS} SELECT verdict, count(*) AS n_shots, string_agg(CAST(slug AS VARCHAR), ',' ORDER BY slug) AS slugs FROM judged GROUP BY verdict",
    "flag_counts": f"WITH {SIGNALS}, f AS (SELECT unnest(flags) AS flag FROM judged) SELECT flag, count(*) AS n FROM f GROUP BY flag",
    "cost_rollup": """WITH u AS (SELECT conv_id, sum(CASE WHEN role = 'user' THEN length(text) ELSE 0 END) AS i, sum(CASE WHEN role <> 'user' THEN length(text) ELSE 0 END) AS o FROM conversations GROUP BY conv_id)
      SELECT conv_id, round(CAST((i - i // 2) * 5 + (i // 2) * 0.5 + o * 25 AS DOUBLE) / 1e6, 8) AS cost FROM u""",
    "rate_window": """WITH n AS (SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n FROM events) SELECT event_id, n, n <= 12 AS within FROM n""",
    "chunk_audit": 'SELECT l_orderkey // 1000 AS chunk, count(*) AS n, min(l_orderkey) AS "first", max(l_orderkey) AS "last", round(sum(l_quantity) / count(*), 6) AS per_row FROM lineitem GROUP BY 1',
    "disagreement": """WITH s AS (SELECT *, abs(l_discount - l_tax) > 0.0651 AS strong FROM lineitem) SELECT l_suppkey, count(*) FILTER (WHERE strong) AS strong, count(*) FILTER (WHERE strong AND l_discount > l_tax) AS student,
      round(avg(CAST(strong AS DOUBLE)) * 100, 6) AS dropped FROM s GROUP BY l_suppkey""",
    "longest_shot": "SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS price FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1",
    "bottom_and_first": """SELECT * FROM (SELECT o_orderkey, round(o_totalprice, 2) AS price, 'bottom' AS kind FROM orders ORDER BY price, o_orderkey LIMIT 6) UNION ALL
      SELECT * FROM (SELECT o_orderkey, round(o_totalprice, 2) AS price, 'first' AS kind FROM orders ORDER BY o_orderkey LIMIT 400)""",
    "slugify": r"""WITH t AS (SELECT p_partkey, lower(trim(regexp_replace(p_name || ' _-' || p_brand || ' _-' || p_type, '[^\w\s-]', '', 'g'))) AS t FROM part)
      SELECT p_partkey, coalesce(nullif(trim(substr(regexp_replace(t, '[\s_-]+', '-', 'g'), 1, 60), '-'), ''), 'match') AS slug FROM t""",
    "rational_parse": "SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN round(CAST(p_partkey * 1000 AS DOUBLE) / (p_size % 7), 4) END AS fps FROM part",
    "hms": "SELECT p_partkey, CAST(CAST(floor(p_retailprice) AS BIGINT) // 60 AS VARCHAR) || ':' || lpad(CAST(CAST(floor(p_retailprice) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS shown, 'part_' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS key FROM part",
    "range_parse": 'SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN CAST(p_size AS BIGINT) END AS start, CASE WHEN p_size % 5 <> 0 THEN p_partkey ELSE 9 END AS "end" FROM part',
    "wrap_text": """WITH RECURSIVE w AS (SELECT item_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS ws FROM benchmark),
      f AS (SELECT item_id, ws, 1 AS i, 0 AS nth, ws[1] AS line, false AS out FROM w WHERE len(ws) > 0 UNION ALL
        SELECT item_id, ws, i + 1, CASE WHEN length(line) + 1 + length(ws[i + 1]) <= 40 THEN nth ELSE nth + 1 END, CASE WHEN length(line) + 1 + length(ws[i + 1]) <= 40 THEN line || ' ' || ws[i + 1] ELSE ws[i + 1] END, false FROM f WHERE i < len(ws))
      SELECT item_id, nth, arg_max(line, i) AS line FROM f GROUP BY item_id, nth""",
    "hex_colour": "SELECT p_partkey, " + ", ".join(f"CAST(('0x' || substr(md5(CAST(p_partkey AS VARCHAR)), {a}, 2)) AS INT) AS {n}" for n, a in (("red", 1), ("green", 3), ("blue", 5))) + " FROM part",
    "chunk_name": 'SELECT p_partkey, p_partkey * 10 AS "first", p_partkey * 10 + 10 AS "last" FROM part',
    "json_parse": """WITH j AS (SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k FROM events) SELECT event_id, k, CASE WHEN k % 2 = 0 THEN false ELSE k % 3 = 0 END AS swap FROM j""",
}
QUERIES = {name: globals()[name] for name in (*SQL, "mannwhitney_u")}
