"""Queries over events, orders, documents and taxonomies, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregates as G
from ..operators import intervals, windows
from ..session import table
from . import bindings as B

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# Words that stand for a kind of source, in the order in which a label is searched for them.
ALIASES = (("ring", "bell_like"), ("small", "light_source"), ("widget", "machine_like"), ("red", "warm_source"), ("blue", "cold_source"), ("large", "heavy_source"))
ALIAS_SQL = ", ".join(f"({i}, '{a}', '{f}')" for i, (a, f) in enumerate(ALIASES))


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order, customer, start and end in days since 1990: from order date to the last shipping date."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("ship"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    day = lambda c: F.datediff(F.col(c).cast("date"), F.lit("1990-01-01").cast("date")).cast("double")
    both = orders.join(items, orders["o_orderkey"] == items["l_orderkey"])
    return both.select(F.col("o_orderkey").alias("ord"), F.col("o_custkey").alias("cust"), F.least(day("o_orderdate"), day("ship")).alias("a"), F.greatest(day("o_orderdate"), day("ship")).alias("b"))


IV = """iv AS (SELECT o_orderkey AS ord, o_custkey AS cust, least(d0, d1) AS a, greatest(d0, d1) AS b FROM (SELECT o_orderkey, o_custkey,
    CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS d0, CAST(date_diff('day', DATE '1990-01-01', CAST(ship AS DATE)) AS DOUBLE) AS d1
    FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS ship FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey))"""


@query(f"WITH {IV} SELECT x.ord AS left_ord, y.ord AS right_ord, least(x.b, y.b) - greatest(x.a, y.a) AS overlap FROM iv x JOIN iv y ON x.cust = y.cust AND x.ord < y.ord AND x.a < y.b AND y.a < x.b")
def j17_overlapping_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-07, J-17: pairs of a customer's orders whose intervals overlap, by buckets of 90 days."""
    iv = _intervals(spark, sf_dir)
    l = iv.select("cust", F.col("ord").alias("left_ord"), F.col("a").alias("a0"), F.col("b").alias("b0"))
    r = iv.select("cust", F.col("ord").alias("right_ord"), F.col("a").alias("a1"), F.col("b").alias("b1"))
    pairs = intervals.overlap_join(l, r, ["cust"], ("a0", "b0"), ("a1", "b1"), 90.0).where("left_ord < right_ord")
    return pairs.select("left_ord", "right_ord", (F.least("b0", "b1") - F.greatest("a0", "a1")).alias("overlap"))


@query(f"WITH {IV} SELECT ord, best, overlap FROM (SELECT x.ord, y.ord AS best, least(x.b, y.b) - greatest(x.a, y.a) AS overlap, row_number() OVER (PARTITION BY x.ord ORDER BY least(x.b, y.b) - greatest(x.a, y.a) DESC, y.ord) AS rn FROM iv x JOIN iv y ON x.cust = y.cust AND x.ord <> y.ord AND x.a < y.b AND y.a < x.b) WHERE rn = 1")
def j05_best_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-05: for each order the other order of its customer that overlaps it most, the smaller key on ties."""
    iv = _intervals(spark, sf_dir)
    l = iv.select("cust", "ord", F.col("a").alias("a0"), F.col("b").alias("b0"))
    r = iv.select("cust", F.col("ord").alias("other"), F.col("a").alias("a1"), F.col("b").alias("b1"))
    pairs = intervals.overlap_join(l, r, ["cust"], ("a0", "b0"), ("a1", "b1"), 90.0).where("ord <> other").withColumn("overlap", F.least("b0", "b1") - F.greatest("a0", "a1"))
    best = pairs.groupBy("ord").agg(F.max_by(F.struct("other", "overlap"), F.struct("overlap", -F.col("other"))).alias("x"))
    return best.select("ord", F.col("x.other").alias("best"), F.col("x.overlap").alias("overlap"))


@query(f"""WITH {IV}, g AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY cust ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 7 THEN 0 ELSE 1 END AS apart FROM iv),
    p AS (SELECT *, sum(apart) OVER (PARTITION BY cust ORDER BY a, b) AS part FROM g) SELECT cust, CAST(part AS BIGINT) AS part, min(a) AS a, max(b) AS b, count(*) AS n FROM p GROUP BY ALL""")
def w15_merged_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-15: a customer's orders merged where they lie within seven days."""
    return windows.merged_intervals(_intervals(spark, sf_dir), "cust", "a", "b", 7.0)


@query(f"WITH {IV}, m AS (SELECT DISTINCT cust, a AS mark FROM iv) SELECT ord, nearest FROM (SELECT ord, mark AS nearest, row_number() OVER (PARTITION BY ord ORDER BY abs(mark - b), mark) AS rn FROM iv JOIN m USING (cust)) WHERE rn = 1")
def j21_nearest_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-21, J-22: the start of any order of the customer that lies nearest to an order's end; one sort, no join."""
    iv = _intervals(spark, sf_dir)
    marks = iv.select("cust", F.col("a").alias("mark")).distinct()
    return intervals.nearest_before_and_after(iv.select("cust", "ord", "b"), marks, ["cust"], "b", "mark").select("ord", "nearest")


@query("""WITH q AS (SELECT user_id, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '2024-01-01') AS a FROM events GROUP BY ALL)
    SELECT e.event_id, e.user_id, epoch_us(q.a) AS start_us FROM events e JOIN q ON e.user_id = q.user_id AND e.ts >= q.a AND e.ts < q.a + INTERVAL 7 DAY""")
def j01_range_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-01 to J-03: events with the week of their user that holds them."""
    week, origin = 7 * 86400.0, 1704067200.0
    e = table(spark, sf_dir, "events").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    weeks = e.select("user_id", (F.floor((F.col("t") - origin) / week) * week + origin).alias("a")).distinct().withColumn("b", F.col("a") + week)
    out = intervals.range_lookup(e, weeks, ["user_id"], "t", "a", "b", week)
    return out.select("event_id", "user_id", (F.col("a") * 1e6).cast("long").alias("start_us"))


@query("""WITH w AS (SELECT user_id, event_type, value, unnest(generate_series(time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '2024-01-01') - INTERVAL 2 DAY, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '2024-01-01'), INTERVAL 1 DAY)) AS start FROM events)
    SELECT user_id, epoch_us(start) AS start_us, count(*) AS n, round(avg(value), 6) AS mean, round(max(value), 6) AS highest, count(DISTINCT event_type) AS kinds FROM w GROUP BY user_id, start""")
def w09_rolling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-09: three-day windows every day for each user."""
    df = windows.rolling(table(spark, sf_dir, "events"), "ts", "3 days", "1 day")
    out = df.groupBy("user_id", F.unix_micros("start").alias("start_us")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("highest"), F.countDistinct("event_type").alias("kinds"))
    return B.rounded(out)


LANES = ["click", "error", "purchase", "signup", "view"]
_DAY = """d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, {} FROM events GROUP BY ALL)""".format(", ".join(f"count(*) FILTER (event_type = '{x}') / count(*)::DOUBLE AS s_{x}" for x in LANES))


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    share = [F.avg((F.col("event_type") == x).cast("double")).alias(f"s_{x}") for x in LANES]
    return e.groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"), *share)


@query(f"""WITH {_DAY}, l AS (SELECT *, {", ".join(f"s_{x} - lag(s_{x}) OVER o AS d_{x}" for x in LANES)}, lag({" || ".join(f"CASE WHEN s_{x} >= 0.5 THEN '1' ELSE '0' END" for x in LANES)}) OVER o = ({" || ".join(f"CASE WHEN s_{x} >= 0.5 THEN '1' ELSE '0' END" for x in LANES)}) AS same FROM d WINDOW o AS (PARTITION BY user_id ORDER BY day))
    SELECT user_id, CAST(day AS VARCHAR) AS day, round(coalesce(({" + ".join(f"abs(d_{x})" for x in LANES)}) / 5, 0), 6) AS novelty, round(greatest(0, {", ".join(f"coalesce(d_{x}, 0)" for x in LANES)}), 6) AS entry, round(greatest(0, {", ".join(f"coalesce(-d_{x}, 0)" for x in LANES)}), 6) AS leave, coalesce(same, false) AS recurs FROM l""")
def w10_relative_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-10: how a user's daily mix of events differs from the day before, and whether its signature recurs."""
    w = Window.partitionBy("user_id").orderBy("day")
    df = _daily(spark, sf_dir).withColumn("sign", F.concat(*[F.when(F.col(f"s_{x}") >= 0.5, "1").otherwise("0") for x in LANES]))
    df = df.withColumns({f"d_{x}": F.col(f"s_{x}") - F.lag(f"s_{x}").over(w) for x in LANES}).withColumn("before", F.lag("sign").over(w))
    zero = F.lit(0.0)
    novelty = F.coalesce(sum((F.abs(f"d_{x}") for x in LANES), zero) / len(LANES), zero)
    entry = F.greatest(zero, *[F.coalesce(f"d_{x}", zero) for x in LANES])
    leave = F.greatest(zero, *[F.coalesce(-F.col(f"d_{x}"), zero) for x in LANES])
    return B.rounded(df.select("user_id", F.col("day").cast("string").alias("day"), novelty.alias("novelty"), entry.alias("entry"), leave.alias("leave"), F.coalesce(F.col("before") == F.col("sign"), F.lit(False)).alias("recurs")))


@query(f"""WITH {_DAY}, k AS (SELECT user_id, day, row_number() OVER (PARTITION BY user_id ORDER BY day) AS idx, {" || ".join(f"CASE WHEN s_{x} >= 0.5 THEN '1' ELSE '0' END" for x in LANES)} AS sign FROM d)
    SELECT user_id, CAST(day AS VARCHAR) AS day, sign, CAST(idx - b AS INTEGER) AS gap FROM (SELECT *, lag(idx) OVER (PARTITION BY user_id, sign ORDER BY idx) AS b FROM k) WHERE idx - b > 1""")
def w13_recurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-12, W-13: days whose signature was last seen more than one day before."""
    df = _daily(spark, sf_dir).withColumn("sign", F.concat(*[F.when(F.col(f"s_{x}") >= 0.5, "1").otherwise("0") for x in LANES]))
    df = df.withColumn("idx", F.row_number().over(Window.partitionBy("user_id").orderBy("day")))
    df = df.withColumn("gap", F.col("idx") - F.lag("idx").over(Window.partitionBy("user_id", "sign").orderBy("idx")))
    return df.where("gap > 1").select("user_id", F.col("day").cast("string").alias("day"), "sign", "gap")


@query("SELECT user_id, event_type AS mode, n FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(event_id)) AS rn FROM events GROUP BY user_id, event_type) WHERE rn = 1")
def g10_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-10: a user's most frequent kind of event, the one seen first on ties."""
    return G.first_mode(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id").select("user_id", F.col("event_type").alias("mode"), "n")


@query("""SELECT l_suppkey, round(sum(l_quantity * greatest(0.05, l_discount)) / sum(greatest(0.05, l_discount)), 6) AS weighted, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS deviation FROM lineitem GROUP BY l_suppkey""")
def g09_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-09, G-25: means weighted by support, with a floor on the weight, and population deviation."""
    df = table(spark, sf_dir, "lineitem")
    return B.rounded(df.groupBy("l_suppkey").agg(G.weighted_mean("l_quantity", "l_discount").alias("weighted"), F.avg("l_quantity").alias("mean"), F.stddev_pop("l_quantity").alias("deviation")))


# Terms that comments are searched for.
TERMS = ("the", "and", "der", "die", "und", "les", "des", "que", "los", "una", "idiot", "token", "license", "version")
_TERM_SQL = ", ".join(f"('{t}')" for t in TERMS)


@query(f"""WITH c AS (SELECT d.doc_id, lower(regexp_replace(coalesce(text, ''), '\\s+', '', 'g')) AS body, greatest(1, coalesce(l.quality, 0)) AS weight, source FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)),
    h AS (SELECT term, doc_id, weight, source FROM c, (VALUES {_TERM_SQL}) t(term) WHERE contains(body, term))
    SELECT term, count(*) AS n, CAST(sum(weight) AS BIGINT) AS weighted, count(DISTINCT source) AS sections, array_to_string(list_sort(list(doc_id))[1:3], ',') AS examples FROM h GROUP BY term ORDER BY n DESC, term LIMIT 30""")
def g07_term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-07: comments that hold each term, with weights, sections and the first examples; terms are folded into each row, and only counts are shuffled."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    c = table(spark, sf_dir, "documents").select("doc_id", F.lower(S.without_blanks(F.coalesce("text", F.lit("")))).alias("body"), "source")
    hits = c.select("doc_id", "source", F.explode(F.array_compact(F.array(*[F.when(F.contains("body", F.lit(t)), t) for t in TERMS]))).alias("term"))
    hits = hits.join(labels, "doc_id", "left").withColumn("weight", F.greatest(F.lit(1), F.coalesce("quality", F.lit(0))))
    return G.term_summary(hits, "term", "doc_id", "weight", "source", 3).orderBy(F.desc("n"), "term").limit(30)


@query(f"""SELECT p_partkey, coalesce((SELECT family FROM (VALUES {ALIAS_SQL}) a(i, word, family) WHERE contains(lower(trim(replace(replace(p_name, '_', ' '), '-', ' '))), word) ORDER BY i LIMIT 1), 'unknown') AS family FROM part""")
def j23_alias_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-23, F-17, F-18: the first alias in dictionary order that a part's label holds."""
    name = S.label(F.col("p_name"))
    family = F.coalesce(*[F.when(name.contains(a), f) for a, f in ALIASES], F.lit("unknown"))
    return table(spark, sf_dir, "part").select("p_partkey", family.alias("family"))


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9900)")
def j20_missing_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-20, J-26, U-07: members of a taxonomy without any strong candidate."""
    strong = table(spark, sf_dir, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("n_nationkey"))
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(strong, "n_nationkey", "left_anti").join(region, nation["n_regionkey"] == region["r_regionkey"]).select("n_nationkey", "n_name", "r_name")


@query("""WITH c AS (SELECT c_nationkey, c_custkey, c_acctbal, max(c_acctbal) OVER (PARTITION BY c_nationkey) AS best, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer)
    SELECT c_nationkey, c_custkey, c_acctbal, CAST(rank AS INTEGER) AS rank FROM c WHERE (c_acctbal >= 9000 OR (best < 9000 AND rank = 1)) AND rank <= 8""")
def p05_active_or_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-05, P-08, T-12: active candidates, or the best one where none is active; eight of each group."""
    w = Window.partitionBy("c_nationkey")
    df = table(spark, sf_dir, "customer").withColumns({"best": F.max("c_acctbal").over(w), "rank": F.row_number().over(w.orderBy(F.desc("c_acctbal"), "c_custkey"))})
    return df.where("(c_acctbal >= 9000 or (best < 9000 and rank = 1)) and rank <= 8").select("c_nationkey", "c_custkey", "c_acctbal", "rank")


@query("""WITH c AS (SELECT s_nationkey, s_suppkey, s_acctbal FROM supplier) SELECT a.s_suppkey, count(b.s_suppkey) AS rivals, coalesce(array_to_string(list(b.s_suppkey ORDER BY b.s_acctbal DESC, b.s_suppkey)[1:4], ','), '') AS strongest
    FROM c a LEFT JOIN c b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey AND b.s_acctbal >= greatest(2800, a.s_acctbal - 1600) GROUP BY a.s_suppkey""")
def j16_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-16: how many others of the same group come close to a member, and the four strongest of them.

    No pairs are made: a running count over the members from the strongest down tells how many come close,
    and the four are among the group's five strongest, which every member is shown.
    """
    s = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", F.col("s_acctbal").cast("double").alias("own"))
    group = Window.partitionBy("s_nationkey")
    down = group.orderBy(F.desc("own"))
    close = F.count("*").over(down.rangeBetween(Window.unboundedPreceding, 1600))
    s = s.withColumns({"close": close, "able": F.count_if(F.col("own") >= 2800).over(group), "place": F.row_number().over(group.orderBy(F.desc("own"), "s_suppkey"))})
    least = F.greatest(F.lit(2800.0), F.col("own") - 1600)
    rivals = F.when(F.col("own") - 1600 >= 2800, F.col("close")).otherwise(F.col("able")) - (F.col("own") >= least).cast("int")
    top = s.where("place <= 5").groupBy("s_nationkey").agg(F.sort_array(F.collect_list(F.struct("place", F.col("s_suppkey").alias("other"), F.col("own").alias("theirs")))).alias("top"))
    near = F.filter("top", lambda x: (x["other"] != F.col("s_suppkey")) & (x["theirs"] >= least))
    return s.join(top, "s_nationkey").select("s_suppkey", rivals.alias("rivals"), F.array_join(F.transform(F.slice(near, 1, 4), lambda x: x["other"]), ",").alias("strongest"))


@query("""SELECT o_orderkey, CASE WHEN x >= 0.78 THEN 'dominant' WHEN x >= 0.58 THEN 'pronounced' WHEN x >= 0.38 THEN 'moderate' WHEN x >= 0.18 THEN 'restrained' ELSE 'reduced' END AS support, CASE WHEN x >= 0.75 THEN 'very_high' WHEN x >= 0.5 THEN 'high' WHEN x >= 0.25 THEN 'moderate' ELSE 'low' END AS state,
    round(20 * log10(o_totalprice), 6) AS db, round(x / (1 + x), 6) AS soft, round(440 * power(2.0, (o_orderkey % 128 - 69) / 12.0), 6) AS hertz, CASE WHEN length(o_orderpriority) > 8 THEN substr(o_orderpriority, 1, 5) || '...' ELSE o_orderpriority END AS short,
    lower(trim(replace(replace(o_orderpriority, '_', ' '), '-', ' '))) AS label, lpad(CAST(floor(t / 6000) AS BIGINT)::VARCHAR, 2, '0') || ':' || lpad((CAST(floor(t / 100) AS BIGINT) % 60)::VARCHAR, 2, '0') || '.' || lpad((CAST(t AS BIGINT) % 100)::VARCHAR, 2, '0') AS clock
    FROM (SELECT *, least(1.0, greatest(0.0, o_totalprice / 500000)) AS x, floor(round((o_orderkey % 5000) / 7.0 * 100)) AS t FROM orders)""")
def f01_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-01 to F-03, F-09, F-12, F-14, F-17, F-20, F-23: clamps, bands, scales and labels."""
    x = S.clamp(F.col("o_totalprice") / 500000)
    seconds = (F.col("o_orderkey") % 5000) / F.lit(7.0)
    return B.rounded(
        table(spark, sf_dir, "orders").select(
            "o_orderkey", S.band(x, S.SUPPORT_BANDS).alias("support"), S.band(x, S.QUARTER_STATES).alias("state"), S.decibel(F.col("o_totalprice")).alias("db"), S.soft_ratio(x).alias("soft"),
            S.midi_hertz((F.col("o_orderkey") % 128).cast("double")).alias("hertz"), S.shortened(F.col("o_orderpriority"), 8).alias("short"), S.label(F.col("o_orderpriority")).alias("label"), S.minute_label(seconds).alias("clock"),
        )
    )


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 >= 0.85 THEN 'very_high' WHEN CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 >= 0.75 THEN 'high' WHEN CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 >= 0.55 THEN 'medium' WHEN CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 >= 0.35 THEN 'low' ELSE 'very_low' END AS confidence FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL""")
def s07_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-07, F-04, F-13: scalar fields of semi-structured packets and their confidence bands."""
    packet = F.try_parse_json("props")
    k = F.try_variant_get(packet, "$.k", "long")
    df = table(spark, sf_dir, "events").select("event_id", k.alias("k")).where("k is not null")
    return df.withColumn("confidence", S.band(F.col("k") / 100.0, S.EXTERNAL_CONFIDENCE))


@query("""WITH r AS (SELECT user_id, event_type, count(*) AS n, avg(value) AS mean, max(value) AS best FROM events GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY best DESC, event_type) AS rank FROM r)
    SELECT user_id, round(least(680, greatest(max(best) FILTER (rank = 1) + 6, avg(best) FILTER (rank <= 3) + 8)), 6) AS score, string_agg(event_type, ',' ORDER BY rank) FILTER (rank <= 3) AS top FROM k GROUP BY user_id""")
def g15_broad_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-12, G-15, T-02: a capped score of the best three families of a track."""
    r = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("best"))
    r = r.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("best"), "event_type")))
    top = F.col("rank") <= 3
    names = F.array_sort(F.collect_list(F.when(top, F.struct("rank", "event_type"))))
    score = F.least(F.lit(680.0), F.greatest(F.max(F.when(F.col("rank") == 1, F.col("best"))) + 6, F.avg(F.when(top, F.col("best"))) + 8))
    return B.rounded(r.groupBy("user_id").agg(score.alias("score"), names.alias("x")).select("user_id", "score", F.array_join(F.transform("x", lambda v: v["event_type"]), ",").alias("top")))


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS c FROM conversations)
    SELECT conv_id, CAST(turn AS INTEGER) AS turn, role FROM n WHERE i = 1 OR i = c OR i = c // 2 + 1""")
def t11_representative_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-11, T-10: first, middle and last row of each track."""
    w = Window.partitionBy("conv_id")
    df = table(spark, sf_dir, "conversations").withColumns({"i": F.row_number().over(w.orderBy("turn")), "c": F.count("*").over(w)})
    return df.where("i = 1 or i = c or i = c div 2 + 1").select("conv_id", F.col("turn").cast("int").alias("turn"), "role")


_CHUNK = " + ".join(f"CASE WHEN {i} < g AND {{0}}({i}.0 * c / g{{1}}) <= i THEN 1 ELSE 0 END" for i in range(1, 5))


@query(f"""WITH s AS (SELECT conv_id, role, length(coalesce(text, '')) AS n, row_number() OVER o - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS c FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
    b AS (SELECT *, CAST({_CHUNK.format("round_even", ", 0")} AS INTEGER) AS chunk FROM (SELECT *, least(5, greatest(1, round(sqrt(c)))) AS g FROM s))
    SELECT conv_id, chunk, count(*) AS turns, round(avg(n), 6) AS mean_chars, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM b GROUP BY conv_id, chunk""")
def g33_macro_arc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-33, G-04, U-01: as many stretches of a track as the root of its length says, five at most, cut at rounded places (halves to even), with their means and the union of their labels."""
    w = Window.partitionBy("conv_id")
    df = table(spark, sf_dir, "conversations").withColumns({"i": F.row_number().over(w.orderBy("turn")) - 1, "c": F.count("*").over(w), "n": F.length(F.coalesce("text", F.lit("")))})
    df = df.withColumn("g", F.least(F.lit(5.0), F.greatest(F.lit(1.0), F.round(F.sqrt("c"))))).withColumn("chunk", F.expr(_CHUNK.format("bround", "")))
    return B.rounded(df.groupBy("conv_id", "chunk").agg(F.count("*").alias("turns"), F.avg("n").alias("mean_chars"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles")))


# Weights of the evidence for an identity.
IDENTITY = (("title", 0.35), ("artist", 0.35), ("album", 0.10), ("year", 0.05), ("match", 0.15))


@query("""SELECT o_orderkey, round(least(1, 0.35 * (o_orderstatus <> '')::INT + 0.35 * (o_totalprice > 100000)::INT + 0.10 * (o_orderpriority LIKE '1%')::INT + 0.05 * (year(o_orderdate) > 1995)::INT + 0.15 * least(1, o_totalprice / 500000)), 9) AS confidence,
    CASE WHEN least(1, 0.35 * (o_orderstatus <> '')::INT + 0.35 * (o_totalprice > 100000)::INT + 0.10 * (o_orderpriority LIKE '1%')::INT + 0.05 * (year(o_orderdate) > 1995)::INT + 0.15 * least(1, o_totalprice / 500000)) >= 0.70 THEN 'identified' ELSE 'candidate' END AS status FROM orders""")
def x33_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-33, X-34, G-40: additive confidence of an identity and its status."""
    parts = {"title": F.col("o_orderstatus") != "", "artist": F.col("o_totalprice") > 100000, "album": F.col("o_orderpriority").startswith("1"), "year": F.year("o_orderdate") > 1995}
    score = sum((w * (F.least(F.lit(1.0), F.col("o_totalprice") / 500000) if n == "match" else parts[n].cast("int")) for n, w in IDENTITY), F.lit(0.0))
    score = F.least(F.lit(1.0), score)
    return B.rounded(table(spark, sf_dir, "orders").select("o_orderkey", score.alias("confidence"), F.when(score >= 0.70, "identified").otherwise("candidate").alias("status")), 9)


@query("""WITH n AS (SELECT l_suppkey AS family, l_partkey % 128 AS pitch, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS i, count(*) OVER (PARTITION BY l_suppkey) AS c, l_shipdate, l_discount FROM lineitem),
    t AS (SELECT family, count(*) AS notes, CAST(min(l_shipdate) AS VARCHAR) AS first_day, avg(pitch) FILTER (i <= greatest(1, c // 4)) AS head, avg(pitch) FILTER (i > c - greatest(1, c // 4)) AS tail, avg(pitch) FILTER (c < 6 OR (i > c // 3 AND i <= greatest(c // 3 + 1, 2 * c // 3))) AS middle, count(*) / greatest(1.0, date_diff('day', min(l_shipdate), max(l_shipdate))::DOUBLE) AS rate, avg(l_discount) AS confidence FROM n GROUP BY family)
    SELECT family, notes, round(confidence, 6) AS confidence, CASE WHEN notes < 3 THEN 'adapter_specific' WHEN tail - head > 2 THEN 'rising' WHEN tail - head < -2 THEN 'falling' WHEN middle > head + 2 AND middle > tail + 2 THEN 'arch' ELSE 'level_or_wavering' END AS contour, CASE WHEN rate >= 4 THEN 'dense' WHEN rate >= 1 THEN 'medium' ELSE 'sparse' END AS density FROM t""")
def g35_note_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-35, W-18, F-22: tracks built from notes, with the contour of their first and last quarter and middle third, and density."""
    w = Window.partitionBy("family")
    df = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("family"), (F.col("l_partkey") % 128).alias("pitch"), "l_shipdate", "l_orderkey", "l_linenumber", "l_discount")
    df = df.withColumns({"i": F.row_number().over(w.orderBy("l_shipdate", "l_orderkey", "l_linenumber")), "c": F.count("*").over(w)})
    edge = F.greatest(F.lit(1), F.expr("c div 4"))
    t = df.groupBy("family").agg(
        F.count("*").alias("notes"), F.avg("l_discount").alias("confidence"), F.avg(F.when(F.col("i") <= edge, F.col("pitch"))).alias("head"), F.avg(F.when(F.col("i") > F.col("c") - edge, F.col("pitch"))).alias("tail"),
        F.avg(F.when(F.expr("c < 6 OR (i > c div 3 AND i <= greatest(c div 3 + 1, 2 * c div 3))"), F.col("pitch"))).alias("middle"),
        (F.count("*") / F.greatest(F.lit(1.0), F.datediff(F.max("l_shipdate"), F.min("l_shipdate")).cast("double"))).alias("rate"),
    )
    step, above = F.col("tail") - F.col("head"), (F.col("middle") > F.col("head") + 2) & (F.col("middle") > F.col("tail") + 2)
    contour = F.when(F.col("notes") < 3, "adapter_specific").when(step > 2, "rising").when(step < -2, "falling").when(above, "arch").otherwise("level_or_wavering")
    return B.rounded(t.select("family", "notes", "confidence", contour.alias("contour"), S.band(F.col("rate"), S.NOTE_DENSITY).alias("density")))


@query("""WITH f AS (SELECT c_nationkey, c_mktsegment, count(*) AS n, avg(c_acctbal) AS m FROM customer GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY c_nationkey) AS total FROM f)
    SELECT c_nationkey, c_mktsegment, n, round(n / total::DOUBLE, 6) AS share, CASE WHEN n / total::DOUBLE >= 0.85 THEN 'background' WHEN n / total::DOUBLE >= 0.2 THEN 'tracked' ELSE 'not_tracked' END AS status FROM s""")
def g23_lane_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-23, G-30: coverage of each lane in its track and its status."""
    f = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("c_nationkey"))
    f = f.withColumn("share", share)
    return B.rounded(f.withColumn("status", F.when(F.col("share") >= 0.85, "background").when(F.col("share") >= 0.2, "tracked").otherwise("not_tracked")))


@query("""WITH s AS (SELECT p_brand, p_type, p_size, p_retailprice FROM part) SELECT p_brand, array_to_string(list_sort(list_distinct(list(p_type))), ',') AS types, round(max(p_size) / 50.0, 6) AS top, CAST(count(DISTINCT p_type) AS BIGINT) AS n_types,
    round((max(p_size) - min(p_size)) / 50.0, 6) AS variation, CASE WHEN (max(p_size) - min(p_size)) / 50.0 >= 0.9 THEN 'varied' WHEN (max(p_size) - min(p_size)) / 50.0 >= 0.5 THEN 'shifting' ELSE 'stable' END AS state FROM s GROUP BY p_brand""")
def g18_variation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-18, G-28, U-01: range of a feature against its scale, in three states, and the sorted union of labels."""
    spread = (F.max("p_size") - F.min("p_size")) / 50.0
    out = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("types"), (F.max("p_size") / 50.0).alias("top"), F.countDistinct("p_type").alias("n_types"), spread.alias("variation"))
    return B.rounded(out.withColumn("state", F.when(F.col("variation") >= 0.9, "varied").when(F.col("variation") >= 0.5, "shifting").otherwise("stable")))
