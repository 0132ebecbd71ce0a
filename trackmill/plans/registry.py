"""Queries by name, and the DuckDB SQL that gives the same rows.

Each takes an operator to the driver's tables; the operators take column names, so they run as well on tracking tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackmill.functions import court, geometry, values
from trackmill.operators import aggregates, matching, review, sequences, spatial

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with whole seconds and microseconds since 1970."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return _read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props", micros.alias("us"), F.floor(micros / 1_000_000).cast("long").alias("s"))


_E = "SELECT event_id, user_id, event_type, value, props, epoch_us(ts) AS us, epoch_us(ts) // 1000000 AS s FROM events"
_R = lambda c, n=4: F.round(c, n)


@query("""SELECT CASE WHEN grouping(l_returnflag) = 1 THEN '*' ELSE l_returnflag END AS team, CASE WHEN grouping(l_linestatus) = 1 THEN '*' ELSE l_linestatus END AS zone,
count(*) AS attempts, CAST(count(*) FILTER (l_discount > 0.05) AS BIGINT) AS made, round(count(*) FILTER (l_discount > 0.05) / count(*), 3) AS pct, CAST(sum(l_linenumber) AS BIGINT) AS points
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), (l_linestatus), ())""")
def g1_grouping_sets(spark, sf_dir):
    return aggregates.zone_statistics(_read(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", F.col("l_discount") > 0.05, F.col("l_linenumber"))


@query("""SELECT c_mktsegment AS team, o_orderstatus AS player, count(*) AS attempts, CAST(count(*) FILTER (o_totalprice > 100000) AS BIGINT) AS made,
round(count(*) FILTER (o_totalprice > 100000) / count(*), 3) AS fg_pct, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS points FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""")
def g2_players_table(spark, sf_dir):
    both = _read(spark, sf_dir, "orders").join(_read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = both.select(F.col("c_mktsegment").alias("team"), F.col("o_orderstatus").alias("player"), (F.col("o_totalprice") > 100000).alias("made"), F.floor("o_totalprice").cast("long").alias("points"))
    return aggregates.player_table(rows)


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY ALL), b AS (SELECT user_id, sum(n) AS known, max((n, event_type)) AS m FROM c GROUP BY user_id)
SELECT u.user_id, CAST(coalesce(known, 0) AS BIGINT) AS known, CASE WHEN m[1] >= 0.3 * known THEN m[2] ELSE 'error' END AS vote FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN b ON u.user_id = b.user_id""")
def g3_majority_vote(spark, sf_dir):
    return aggregates.majority(_read(spark, sf_dir, "events"), ["user_id"], "event_type", 0.3, "error")


def _probabilities(spark, sf_dir):
    """Ten positive shares of each vector: its first ten numbers, squared and scaled."""
    squares = F.transform(F.slice("embedding", 1, 10), lambda v: v.cast("double") * v.cast("double"))
    return _read(spark, sf_dir, "embeddings").select("vec_id", "label", F.pmod("vec_id", F.lit(5)).cast("string").alias("team"), values.renormalised(squares).alias("probs"))


_P = """SELECT vec_id, label, CAST(vec_id % 5 AS VARCHAR) AS team, [x / greatest(list_sum(q), 1e-9) FOR x IN q] AS probs
FROM (SELECT vec_id, label, [CAST(v AS DOUBLE) * CAST(v AS DOUBLE) FOR v IN embedding[1:10]] AS q FROM embeddings)"""


@query(f"""WITH p AS ({_P}), k AS (SELECT label, unnest(probs) AS v, unnest(range(0, 10)) AS k FROM p WHERE list_max(probs) >= 0.3), s AS (SELECT label, k, sum(v) AS s, count(*) AS n FROM k GROUP BY ALL)
SELECT l.label, CAST(arg_max(k, (s, -k)) AS INTEGER) AS class, round(coalesce(max(s) / sum(s), 0), 4) AS share, CAST(coalesce(max(n), 0) AS BIGINT) AS rows FROM (SELECT DISTINCT label FROM embeddings) l LEFT JOIN s ON l.label = s.label GROUP BY l.label""")
def g4_weighted_vote(spark, sf_dir):
    return aggregates.weighted_vote(_probabilities(spark, sf_dir), ["label"], "probs", None, 0.3).withColumn("share", _R("share")).withColumn("class", F.col("class").cast("int"))


@query(f"""WITH p AS ({_P}), k AS (SELECT team, unnest(probs) AS v, unnest(range(0, 10)) AS class FROM p WHERE list_max(probs) >= 0.3), m AS (SELECT team, class, sum(v) AS mass FROM k GROUP BY ALL)
SELECT team, CAST(class AS INTEGER) AS class, round(mass, 4) AS mass, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY mass DESC, class) AS rank FROM m WHERE mass > 0) WHERE rank <= 3""")
def g5_roster_topk(spark, sf_dir):
    return aggregates.rosters(_probabilities(spark, sf_dir), "team", "probs", 3, 0.3).withColumn("mass", _R("mass"))


@query(f"SELECT event_id, event_type, CAST(sum(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY event_type, user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS score FROM ({_E})")
def g6_running_score(spark, sf_dir):
    return aggregates.running_total(_events(spark, sf_dir), ["event_type", "user_id"], ["us", "event_id"], F.floor("value").cast("long"), "score").select("event_id", "event_type", "score")


@query("""WITH d AS (SELECT user_id, CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS t, CASE WHEN value > 50 THEN 'A' ELSE 'B' END AS g FROM events)
SELECT user_id, count(*) AS n, count(*) FILTER (t = g) >= count(*) FILTER (t <> g) AS identity, round(greatest(count(*) FILTER (t = g), count(*) FILTER (t <> g)) / count(*), 4) AS accuracy FROM d GROUP BY user_id""")
def g9_agreement(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").select("user_id", F.when(F.col("event_id") % 2 == 0, "A").otherwise("B").alias("truth"), F.when(F.col("value") > 50, "A").otherwise("B").alias("guess"))
    return matching.agreement(rows, ["user_id"], "truth", "guess").withColumn("accuracy", _R("accuracy"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def g11_confusion(spark, sf_dir):
    return aggregates.confusion(_read(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


@query("""WITH g AS (SELECT o_custkey, count(*) AS ga, count(*) FILTER (o_totalprice > 100000) AS gm FROM orders GROUP BY 1), p AS (SELECT o_custkey, count(*) AS pa, count(*) FILTER (o_totalprice > 100000) AS pm FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT count(*) AS keys, round(avg(abs(ga - coalesce(pa, 0))), 4) AS attempt_error, round(avg(abs(gm - coalesce(pm, 0))), 4) AS make_error FROM g LEFT JOIN p USING (o_custkey)""")
def g12_count_errors(spark, sf_dir):
    orders = _read(spark, sf_dir, "orders").withColumn("made", F.col("o_totalprice") > 100000)
    return aggregates.count_errors(orders, orders.where("o_orderstatus = 'F'"), ["o_custkey"], "made").select("keys", _R("attempt_error").alias("attempt_error"), _R("make_error").alias("make_error"))


@query(f"""WITH p AS ({_P}), r AS (SELECT vec_id // 20 AS w, label, list_max(probs) AS c, list_position(probs, list_max(probs)) - 1 AS k FROM p)
SELECT level, round(avg(CAST(c >= level AS INTEGER)), 4) AS coverage, round(count(*) FILTER (c >= level AND k = label) / nullif(count(*) FILTER (c >= level), 0), 4) AS accuracy FROM r, (SELECT unnest([0.2, 0.3, 0.5]) AS level) GROUP BY level""")
def g15_accuracy_at(spark, sf_dir):
    rows = _probabilities(spark, sf_dir).select("label", F.array_max("probs").alias("c"), (F.array_position("probs", F.array_max("probs")) - 1).alias("k"))
    return aggregates.accuracy_at(rows, "label", "k", "c", (0.2, 0.3, 0.5)).select("level", _R("coverage").alias("coverage"), _R("accuracy").alias("accuracy"))


@query(f"""WITH p AS ({_P}), k AS (SELECT team, vec_id // 20 AS w, label, unnest(probs) AS v, unnest(range(0, 10)) AS k FROM p WHERE list_max(probs) >= 0.3), m AS (SELECT team, w, label, k, sum(v) AS v FROM k GROUP BY ALL),
o AS (SELECT team, w, label, arg_max(k, (v, -k)) AS class, max(v) / sum(v) AS share FROM m GROUP BY ALL)
SELECT d.team, d.w AS "window", d.label, CAST(class AS INTEGER) AS class, round(coalesce(share, 0), 4) AS share, coalesce(class = d.label, false) AS "right" FROM (SELECT DISTINCT team, vec_id // 20 AS w, label FROM p) d LEFT JOIN o ON o.team = d.team AND o.w = d.w AND o.label = d.label""")
def g15_tumbling(spark, sf_dir):
    votes = aggregates.tumbling_votes(_probabilities(spark, sf_dir), ["team"], "vec_id", 20, "label", "probs", 0.3)
    return votes.withColumns({"share": _R("share"), "class": F.col("class").cast("int")})


@query("""SELECT CASE WHEN grouping(o_orderstatus) = 1 THEN 'total' ELSE o_orderstatus END AS o_orderstatus, count(*) AS n, CAST(count(*) FILTER (o_totalprice > 100000) AS BIGINT) AS big, round(count(*) FILTER (o_totalprice > 100000) / count(*), 4) AS share FROM orders GROUP BY ROLLUP (o_orderstatus)""")
def g17_totals(spark, sf_dir):
    out = aggregates.with_totals(_read(spark, sf_dir, "orders"), "o_orderstatus", {"n": F.count("*"), "big": F.count_if(F.col("o_totalprice") > 100000)}, {"share": ("big", "n")})
    return out.withColumn("share", _R("share"))


@query("SELECT l_returnflag, round(median(l_extendedprice), 2) AS mid, round(quantile_cont(l_extendedprice, 0.975), 2) AS high, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1")
def g18_median_percentile(spark, sf_dir):
    return _read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(_R(F.median("l_extendedprice"), 2).alias("mid"), _R(F.percentile("l_extendedprice", 0.975), 2).alias("high"), F.countDistinct("l_suppkey").alias("suppliers"))


@query("""WITH c AS (SELECT user_id, event_id, us FROM (%s) WHERE event_type = 'click'), p AS (SELECT user_id, event_id AS other_id, us AS other_us FROM (%s) WHERE event_type = 'purchase'),
m AS (SELECT c.user_id, event_id, other_id, abs(other_us - us) AS d FROM c JOIN p ON c.user_id = p.user_id AND abs(other_us - us) <= 7200000000), r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY d, other_id) AS k FROM m)
SELECT c.user_id, c.event_id, coalesce(r.other_id, -1) AS other_id FROM c LEFT JOIN r ON c.event_id = r.event_id AND k = 1""" % (_E, _E))
def j5_nearest_asof(spark, sf_dir):
    events = _events(spark, sf_dir)
    left = events.where("event_type = 'click'").select("user_id", "event_id", "us")
    right = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("other_id"), F.col("us").alias("other_us"))
    return matching.nearest(left, right, ["user_id"], ["event_id"], "us", "other_us", 7_200_000_000, "other_id").select("user_id", "event_id", F.coalesce("other_id", F.lit(-1)).alias("other_id"))


_MATCH = f"""WITH RECURSIVE e AS ({_E}), c AS (SELECT g.user_id, g.event_id AS i, p.event_id AS j, abs(p.us - g.us) AS d FROM e g JOIN e p ON g.user_id = p.user_id AND g.event_type = 'click' AND p.event_type = 'purchase' AND abs(p.us - g.us) <= 3600000000),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY d, i, j) AS k FROM c),
w AS (SELECT user_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS gi, CAST([] AS BIGINT[]) AS pj, CAST(NULL AS BIGINT) AS i, CAST(NULL AS BIGINT) AS j, CAST(NULL AS BIGINT) AS d FROM (SELECT DISTINCT user_id FROM r)
UNION ALL SELECT w.user_id, r.k, CASE WHEN ok THEN list_append(gi, r.i) ELSE gi END, CASE WHEN ok THEN list_append(pj, r.j) ELSE pj END, CASE WHEN ok THEN r.i END, CASE WHEN ok THEN r.j END, r.d
FROM w JOIN (SELECT * FROM r) r ON r.user_id = w.user_id AND r.k = w.k + 1, LATERAL (SELECT NOT list_contains(gi, r.i) AND NOT list_contains(pj, r.j) AS ok))
SELECT user_id, i AS gt_id, j AS pred_id, d AS delta FROM w WHERE i IS NOT NULL"""


@query(_MATCH)
def j1_match_one_to_one(spark, sf_dir):
    events = _events(spark, sf_dir)
    gt = events.where("event_type = 'click'").select("user_id", F.col("event_id").alias("gt_id"), F.col("us").alias("gt_us"))
    pred = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("pred_id"), F.col("us").alias("pred_us"))
    return matching.one_to_one(gt, pred, ["user_id"], "gt_id", "pred_id", "gt_us", "pred_us", 3_600_000_000)


_PAIRS = f"""e AS ({_E}), t AS (SELECT *, us / 1e6 AS at FROM e), c AS (SELECT g.user_id, g.event_id AS i, p.event_id AS j, abs(p.at - g.at) AS d FROM t g JOIN t p ON g.user_id = p.user_id AND g.event_type = 'click' AND p.event_type = 'purchase' AND p.at - g.at BETWEEN -3600 AND 3600),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY d, i, j) AS k FROM c),
w AS (SELECT user_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS gi, CAST([] AS BIGINT[]) AS pj, NULL::BIGINT AS i, NULL::BIGINT AS j FROM (SELECT DISTINCT user_id FROM r)
UNION ALL SELECT w.user_id, r.k, CASE WHEN ok THEN list_append(gi, r.i) ELSE gi END, CASE WHEN ok THEN list_append(pj, r.j) ELSE pj END, CASE WHEN ok THEN r.i END, CASE WHEN ok THEN r.j END
FROM w JOIN r ON r.user_id = w.user_id AND r.k = w.k + 1, LATERAL (SELECT NOT list_contains(gi, r.i) AND NOT list_contains(pj, r.j) AS ok)),
m AS (SELECT user_id, i, j FROM w WHERE i IS NOT NULL)"""


@query(f"""WITH RECURSIVE {_PAIRS},
x AS (SELECT user_id, event_id, event_type, CASE WHEN event_id % 7 = 0 THEN '?' WHEN value > 50 THEN 'A' ELSE 'B' END AS team, ['ft', 'inside_arc', 'beyond_arc'][event_id % 3 + 1] AS zone, value > 30 AS made, CASE WHEN value > 30 THEN [1, 2, 3][event_id % 3 + 1] ELSE 0 END AS pt FROM e),
n AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS g, count(*) FILTER (event_type = 'purchase') AS p, sum(pt) FILTER (event_type = 'click' AND team = 'A') AS ga, sum(pt) FILTER (event_type = 'click' AND team = 'B') AS gb, coalesce(sum(pt) FILTER (event_type = 'purchase' AND team = 'A'), 0) AS pa, coalesce(sum(pt) FILTER (event_type = 'purchase' AND team = 'B'), 0) AS pb, coalesce(sum(pt) FILTER (event_type = 'click'), 0) AS gs, coalesce(sum(pt) FILTER (event_type = 'purchase'), 0) AS ps FROM x WHERE event_type IN ('click', 'purchase') GROUP BY 1),
o AS (SELECT m.user_id, count(*) AS matched, count(*) FILTER (a.made = b.made) AS made_ok, count(*) FILTER (a.zone = b.zone) AS zone_ok, count(*) FILTER (a.team <> '?') AS known, count(*) FILTER (a.team <> '?' AND a.team = b.team) AS same, count(*) FILTER (a.team <> '?' AND b.team <> '?' AND a.team <> b.team) AS other FROM m JOIN x a ON a.event_id = i JOIN x b ON b.event_id = j GROUP BY 1)
SELECT user_id, coalesce(matched, 0) AS matched, coalesce(matched, 0) / nullif(g, 0) AS recall, coalesce(matched, 0) / nullif(p, 0) AS "precision", made_ok / matched AS made_accuracy, zone_ok / matched AS zone_accuracy, greatest(same, other) / nullif(known, 0) AS team_accuracy, coalesce(other > same, false) AS swapped,
CAST(abs(CASE WHEN coalesce(other > same, false) THEN pb ELSE pa END - ga) AS BIGINT) AS points_error_a, CAST(abs(CASE WHEN coalesce(other > same, false) THEN pa ELSE pb END - gb) AS BIGINT) AS points_error_b, CAST(abs(ps - gs) AS BIGINT) AS points_error FROM n LEFT JOIN o USING (user_id)""")
def g7_alignment_eval(spark, sf_dir):
    rows = _events(spark, sf_dir).select("user_id", "event_id", "event_type", (F.col("us") / 1e6).alias("timestamp_s"), F.when(F.col("event_id") % 7 == 0, "?").when(F.col("value") > 50, "A").otherwise("B").alias("team"), F.element_at(F.array(F.lit("ft"), F.lit("inside_arc"), F.lit("beyond_arc")), (F.col("event_id") % 3 + 1).cast("int")).alias("zone"), (F.col("value") > 30).alias("made"))
    return matching.evaluate(rows.where("event_type = 'click'"), rows.where("event_type = 'purchase'"), ["user_id"], 3600.0, "5v5")


@query("SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) BETWEEN -30 AND 60 GROUP BY 1 HAVING count(l_orderkey) > 0")
def j3_window_range(spark, sf_dir):
    orders = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.unix_date(F.to_date("o_orderdate")).alias("day"))
    lines = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.unix_date(F.to_date("l_shipdate")).alias("ship"))
    return matching.in_window(orders, lines, ["key"], "day", "ship", 30, 60).groupBy(F.col("key").alias("o_orderkey")).agg(F.count("*").alias("n"))


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l ON d.doc_id = l.doc_id")
def j2_labels_left(spark, sf_dir):
    return matching.with_labels(_read(spark, sf_dir, "documents").select("doc_id"), _read(spark, sf_dir, "labels"), ["doc_id"], "quality", F.lit(-1))


def _boxes(spark, sf_dir):
    """A box for each part: frames of 50, placed by its numbers."""
    p = F.col("p_partkey")
    return _read(spark, sf_dir, "part").select(F.floor(p / 50).cast("long").alias("frame"), p.alias("id"), geometry.box((p * 37) % 200, (p * 53) % 150, F.col("p_size") + 20, (p % 30) + 40).alias("box"))


_B = "SELECT p_partkey // 50 AS frame, p_partkey AS id, CAST((p_partkey * 37) % 200 AS DOUBLE) AS x, CAST((p_partkey * 53) % 150 AS DOUBLE) AS y, CAST(p_size + 20 AS DOUBLE) AS w, CAST(p_partkey % 30 + 40 AS DOUBLE) AS h FROM part"
_PAIR = f"WITH b AS ({_B}), p AS (SELECT a.frame, a.id, o.id AS other, greatest(0, least(a.x + a.w, o.x + o.w) - greatest(a.x, o.x)) * greatest(0, least(a.y + a.h, o.y + o.h) - greatest(a.y, o.y)) AS s, a.w * a.h AS aa, o.w * o.h AS oa FROM b a JOIN b o ON a.frame = o.frame AND a.id <> o.id)"


@query(f"{_PAIR}, q AS (SELECT frame, id, other, s / (aa + oa - s) AS iou FROM p WHERE id % 2 = 0 AND other % 2 = 1 AND s / (aa + oa - s) >= 0.3) SELECT b.frame, b.id, coalesce(arg_max(other, (iou, other)), -1) AS gid, round(max(iou), 6) AS iou FROM (SELECT frame, id FROM b WHERE id % 2 = 0) b LEFT JOIN q ON q.frame = b.frame AND q.id = b.id GROUP BY b.frame, b.id")
def j7_iou_argmax(spark, sf_dir):
    boxes = _boxes(spark, sf_dir)
    left, right = boxes.where("id % 2 = 0"), boxes.where("id % 2 = 1").select("frame", F.col("id").alias("gid"), F.col("box").alias("gbox"))
    return spatial.best_overlap(left, right, ["frame"], "id", "box", "gid", "gbox", 0.3).withColumns({"iou": _R("iou", 6), "gid": F.coalesce("gid", F.lit(-1))})


@query(f"{_PAIR} SELECT b.frame, b.id, round(coalesce(max(s / greatest(aa, 1)), 0), 6) AS overlap FROM b LEFT JOIN p ON p.id = b.id GROUP BY b.frame, b.id")
def j10_overlap(spark, sf_dir):
    return spatial.overlap_of_others(_boxes(spark, sf_dir), ["frame"], "id", "box").withColumn("overlap", _R("overlap", 6))


@query(f"{_PAIR}, c AS (SELECT b.*, unnest(range(0, 256)) AS k FROM b) SELECT c.frame, c.id, count(*) FILTER (EXISTS (SELECT 1 FROM b o WHERE o.frame = c.frame AND o.id <> c.id AND c.x + (k % 16 + 0.5) / 16 * c.w BETWEEN o.x AND o.x + o.w AND c.y + (k // 16 + 0.5) / 16 * c.h BETWEEN o.y AND o.y + o.h)) / 256.0 AS occlusion FROM c GROUP BY ALL")
def j11_occlusion(spark, sf_dir):
    return spatial.occlusion(_boxes(spark, sf_dir), ["frame"], "id", "box")


def _greedy(key: str, start: str, kept: str, out: str, ok: str) -> str:
    """SQL's form of a fold: r's rows of a key in order of k; each that is `ok` against w.kept joins it."""
    return f"""w AS (SELECT {key}, CAST(0 AS BIGINT) AS k, {start} AS kept, NULL::{out} AS got FROM (SELECT DISTINCT {key} FROM r)
UNION ALL SELECT w.{key}, r.k, CASE WHEN {ok} THEN list_append(w.kept, {kept}) ELSE w.kept END, CASE WHEN {ok} THEN r.id END FROM w JOIN r ON r.{key} = w.{key} AND r.k = w.k + 1)"""


def _share(a: str, b: str) -> str:
    """SQL's form of the overlap of two boxes."""
    s = f"(greatest(0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x)) * greatest(0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y)))"
    return f"({s} / ({a}.w * {a}.h + {b}.w * {b}.h - {s}))"


@query(f"""WITH RECURSIVE b AS ({_B}), r AS (SELECT a.frame, {{'t': a.id, 'f': o.id}} AS id, row_number() OVER (PARTITION BY a.frame ORDER BY a.id, {_share("a", "o")} DESC, o.id) AS k FROM b a JOIN b o ON a.frame = o.frame AND a.id % 2 = 0 AND o.id % 2 = 1 AND {_share("a", "o")} >= 0.3),
{_greedy("frame", "CAST([] AS STRUCT(t BIGINT, f BIGINT)[])", "r.id", "STRUCT(t BIGINT, f BIGINT)", "len(list_filter(w.kept, lambda m: m.t = r.id.t OR m.f = r.id.f)) = 0")} SELECT frame, got.t AS id, got.f AS gid FROM w WHERE got IS NOT NULL""")
def j8_greedy_boxes(spark, sf_dir):
    boxes = _boxes(spark, sf_dir)
    return spatial.greedy_boxes(boxes.where("id % 2 = 0"), boxes.where("id % 2 = 1").select("frame", F.col("id").alias("gid"), F.col("box").alias("gbox")), ["frame"], "id", "box", "gid", "gbox", 0.3)


@query(f"{_PAIR} SELECT b.frame, b.id, round(min(sqrt((b.x - o.x) * (b.x - o.x) + (b.y - o.y) * (b.y - o.y))), 6) AS nearest FROM b LEFT JOIN b o ON b.frame = o.frame AND b.id <> o.id GROUP BY b.frame, b.id")
def j13_nearest_other(spark, sf_dir):
    boxes = _boxes(spark, sf_dir).select("frame", "id", "box.x", "box.y")
    return spatial.nearest_other(boxes, ["frame"], "id", "x", "y").withColumn("nearest", _R("nearest", 6))


_RUNS = f"""WITH e AS ({_E}), o AS (SELECT user_id, event_id, value, CASE WHEN lag(value) OVER w - value < -0.5 THEN 0 ELSE 1 END AS new, row_number() OVER w AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY n) AS run FROM o),
runs AS (SELECT user_id, min(n) AS a, max(n) AS z, count(*) AS n, min(value) AS lo, max(value) AS hi FROM g GROUP BY user_id, run HAVING count(*) > 1)"""


def _runs(spark, sf_dir):
    rows = sequences.renumbered(_events(spark, sf_dir), ["user_id"], ["us", "event_id"], "n").withColumn("n", F.col("n") + 1)
    return sequences.rising_segments(rows, ["user_id"], "n", "value", 0, 0.5, down=False)


@query(f"{_RUNS} SELECT user_id, CAST(a AS INTEGER) AS start_n, CAST(z AS INTEGER) AS end_n, n, lo AS y_start, hi AS y_end FROM runs")
def w1_rising_segments(spark, sf_dir):
    return _runs(spark, sf_dir).select("user_id", F.col("start").alias("start_n"), F.col("end").alias("end_n"), "n", "y_start", "y_end")


@query(f"{_RUNS}, e2 AS (SELECT user_id, n, value FROM g), b AS (SELECT r.user_id, r.z, min((e2.n, e2.value)) AS f, max((e2.n, e2.value)) AS l FROM runs r JOIN e2 ON r.user_id = e2.user_id AND e2.n BETWEEN r.z - 3 AND r.z + 2 GROUP BY r.user_id, r.z) SELECT user_id, CAST(z AS INTEGER) AS end_n, round((l[2] - f[2]) / nullif(l[1] - f[1], 0), 4) AS speed FROM b")
def w2_speed(spark, sf_dir):
    rows = sequences.renumbered(_events(spark, sf_dir), ["user_id"], ["us", "event_id"], "n").select("user_id", (F.col("n") + 1).alias("n"), "value")
    ends = _runs(spark, sf_dir).select("user_id", F.col("end").alias("end_n"))
    return sequences.speed(rows, ends, ["user_id"], "end_n", "n", "value", 3, 2).withColumn("speed", _R("speed"))


@query(f"SELECT user_id, us, round((50 - v0) / (value - v0), 4) AS share FROM (SELECT user_id, us, value, lag(value) OVER (PARTITION BY user_id ORDER BY us) AS v0 FROM ({_E})) WHERE v0 < 50 AND value >= 50")
def w4_crossing(spark, sf_dir):
    return sequences.crossings(_events(spark, sf_dir), ["user_id"], "us", "value", F.lit(50.0)).withColumn("share", _R("share"))


@query("""WITH RECURSIVE o AS (SELECT o_custkey AS k, CAST(epoch(o_orderdate) // 86400 AS BIGINT) AS a, CAST(epoch(o_orderdate) // 86400 + 90 AS BIGINT) AS z, row_number() OVER (PARTITION BY o_custkey ORDER BY epoch(o_orderdate) // 86400) AS n FROM orders),
f AS (SELECT k, n, a, z, true AS keep, z AS last FROM o WHERE n = 1 UNION ALL SELECT o.k, o.n, o.a, o.z, o.a > f.last, CASE WHEN o.a > f.last THEN o.z ELSE f.last END FROM f JOIN o ON o.k = f.k AND o.n = f.n + 1) SELECT k, a, z FROM f WHERE keep""")
def w6_overlap_suppress(spark, sf_dir):
    day = F.unix_date(F.to_date("o_orderdate")).cast("long")
    rows = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), day.alias("a"), (day + 90).alias("z"))
    return sequences.suppress_overlaps(rows, ["k"], "a", "z")


@query(f"""WITH v AS (SELECT user_id, s // 3600 AS hour, avg(value) AS value FROM ({_E}) GROUP BY ALL),
n AS (SELECT *, lead(hour) OVER (PARTITION BY user_id ORDER BY hour) AS nx, list({{'t': hour, 'v': value}}) OVER (PARTITION BY user_id ORDER BY hour ROWS BETWEEN 3 PRECEDING AND 4 FOLLOWING) AS near FROM v),
u AS (SELECT user_id, hour, nx, unnest(near) AS p FROM n WHERE nx - hour BETWEEN 2 AND 12),
c AS (SELECT user_id, hour, nx, count(*) AS rows, avg(p.t) AS mt, avg(p.v) AS mv FROM u GROUP BY ALL),
d AS (SELECT u.user_id, u.hour, sum((p.t - mt) ** 2) AS s2, sum((p.t - mt) ** 3) AS s3, sum((p.t - mt) * p.v) AS sv FROM u JOIN c ON c.user_id = u.user_id AND c.hour = u.hour GROUP BY ALL),
f AS (SELECT c.*, s2, s3, sv, s3 / s2 AS bend, s2 / rows AS mean2 FROM c JOIN d ON d.user_id = c.user_id AND d.hour = c.hour),
q AS (SELECT u.user_id, u.hour, sum(((p.t - mt) ** 2 - bend * (p.t - mt) - mean2) * p.v) / sum(((p.t - mt) ** 2 - bend * (p.t - mt) - mean2) ** 2) AS curve FROM u JOIN f ON f.user_id = u.user_id AND f.hour = u.hour WHERE rows >= 4 GROUP BY ALL),
o AS (SELECT f.*, coalesce(curve, 0) AS curve, unnest(range(f.hour + 1, nx)) AS spot FROM f LEFT JOIN q ON q.user_id = f.user_id AND q.hour = f.hour)
SELECT user_id, spot AS hour, round(mv + sv / s2 * (spot - mt) + curve * ((spot - mt) ** 2 - bend * (spot - mt) - mean2), 4) AS value FROM o""")
def w7_gap_fill(spark, sf_dir):
    rows = _events(spark, sf_dir).groupBy("user_id", F.floor(F.col("s") / 3600).cast("long").alias("hour")).agg(F.avg("value").alias("value"))
    return sequences.fill_gaps(rows, ["user_id"], "hour", ["value"]).withColumn("value", _R("value"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS k FROM lineitem) WHERE k = 1")
def w8_best_per_frame(spark, sf_dir):
    return sequences.best_per_frame(_read(spark, sf_dir, "lineitem"), ["l_orderkey"], [F.desc("l_extendedprice"), F.col("l_linenumber"), F.col("l_partkey")]).select("l_orderkey", "l_linenumber", "l_partkey")


@query(f"SELECT event_id, CAST(sum(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY us ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS BIGINT) AS around FROM ({_E})")
def w10_moving_sum(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("v", F.floor("value").cast("long"))
    return sequences.moving_sum(rows, ["user_id"], "us", "v", 2, "around").select("event_id", "around")


@query(f"WITH e AS ({_E}), r AS (SELECT user_id, min(s) AS a, max(s) AS z FROM e GROUP BY 1) SELECT event_id, CASE WHEN s > z - 0.2 * (z - a) THEN 'val' ELSE 'train' END AS split FROM e JOIN r USING (user_id)")
def w12_time_split(spark, sf_dir):
    return sequences.latest_share(_events(spark, sf_dir), ["user_id"], "s", 0.2).select("event_id", "split")


@query(f"WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 + user_id AS f FROM ({_E})) SELECT user_id, event_id FROM e WHERE (f - user_id) % 3 = 0")
def c14_every_nth(spark, sf_dir):
    rows = sequences.renumbered(_events(spark, sf_dir), ["user_id"], ["us", "event_id"], "f").withColumn("f", F.col("f") + F.col("user_id"))
    return sequences.every_nth(rows, ["user_id"], "f", 3).select("user_id", "event_id")


@query("""WITH RECURSIVE d AS (SELECT DISTINCT o_custkey AS k, CAST(epoch(o_orderdate) // 86400 AS BIGINT) AS a FROM orders), o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY a) AS n FROM d),
f AS (SELECT k, n, a, true AS keep, a AS last FROM o WHERE n = 1 UNION ALL SELECT o.k, o.n, o.a, o.a - f.last >= 60, CASE WHEN o.a - f.last >= 60 THEN o.a ELSE f.last END FROM f JOIN o ON o.k = f.k AND o.n = f.n + 1) SELECT k, a FROM f WHERE keep""")
def d3_thin_out(spark, sf_dir):
    rows = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.unix_date(F.to_date("o_orderdate")).cast("long").alias("a")).distinct()
    return sequences.thin_out(rows, ["k"], "a", 60)


_KEPT = "STRUCT(id BIGINT, x DOUBLE, y DOUBLE, d DOUBLE, conf DOUBLE)"


@query(f"""WITH RECURSIVE b AS ({_B}), r AS (SELECT frame, CAST({{'id': id, 'x': x + w / 2, 'y': y + h / 2, 'd': (w + h) / 2, 'conf': ((id * 7) % 100) / 100}} AS {_KEPT}) AS c, row_number() OVER (PARTITION BY frame ORDER BY id) AS k FROM b),
w AS (SELECT frame, CAST(0 AS BIGINT) AS k, CAST([] AS {_KEPT}[]) AS kept FROM (SELECT DISTINCT frame FROM r)
UNION ALL SELECT frame, k, CASE WHEN hit = 0 THEN list_append(kept, c) WHEN c.conf > kept[hit].conf THEN list_concat(list_append(kept[1:hit - 1], c), kept[hit + 1:]) ELSE kept END
FROM (SELECT w.frame, r.k, w.kept, r.c, coalesce(list_position(list_transform(w.kept, lambda m: sqrt((m.x - r.c.x) * (m.x - r.c.x) + (m.y - r.c.y) * (m.y - r.c.y)) < 0.7 * greatest(m.d, r.c.d)), true), 0) AS hit FROM w JOIN r ON r.frame = w.frame AND r.k = w.k + 1))
SELECT frame, m.id, m.x, m.y, m.d, m.conf FROM (SELECT frame, unnest(kept) AS m FROM (SELECT frame, arg_max(kept, k) AS kept FROM w GROUP BY frame))""")
def d1_greedy_merge(spark, sf_dir):
    rows = _boxes(spark, sf_dir).select("frame", "id", (F.col("box.x") + F.col("box.w") / 2).alias("x"), (F.col("box.y") + F.col("box.h") / 2).alias("y"), ((F.col("box.w") + F.col("box.h")) / 2).alias("d"), (F.pmod(F.col("id") * 7, F.lit(100)) / 100).alias("conf"))
    return sequences.merge_candidates(rows, ["frame"], "id", "x", "y", "d", "conf")


@query(f"""WITH RECURSIVE b AS ({_B}), r AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY (id * 7) % 100 DESC, id) AS k FROM b),
{_greedy("frame", "CAST([] AS STRUCT(x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE)[])", "{'x': r.x, 'y': r.y, 'w': r.w, 'h': r.h}", "BIGINT", f"len(w.kept) < 3 AND len(list_filter(w.kept, lambda m: {_share('m', 'r')} > 0.3)) = 0")} SELECT frame, got AS id FROM w WHERE got IS NOT NULL""")
def d2_best_boxes(spark, sf_dir):
    return sequences.best_boxes(_boxes(spark, sf_dir).withColumn("conf", F.pmod(F.col("id") * 7, F.lit(100)) / 100), ["frame"], "id", "conf", "box").select("frame", "id")


@query(f"""WITH RECURSIVE e AS ({_E}), r AS (SELECT user_id, {{'minute': s // 60, 'value': value}} AS id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, s // 60) AS k FROM e WHERE value >= 60),
{_greedy("user_id", "CAST([] AS BIGINT[])", "r.id.minute", "STRUCT(minute BIGINT, value DOUBLE)", "len(list_filter(w.kept, lambda m: abs(m - r.id.minute) <= 180)) = 0")} SELECT user_id, got.minute AS minute, got.value AS value FROM w WHERE got IS NOT NULL""")
def d4_peaks(spark, sf_dir):
    rows = _events(spark, sf_dir).select("user_id", F.floor(F.col("s") / 60).alias("minute"), "value")
    return sequences.peaks(rows, ["user_id"], "minute", "value", 60.0, 180)


def _xy(spark, sf_dir):
    """Places on a court from part and supplier keys."""
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", ((F.col("l_partkey") % 1500) / 100.0 - 7.5).alias("x"), ((F.col("l_suppkey") * 13 % 1200) / 100.0).alias("y"))


_XY = "SELECT l_orderkey, l_linenumber, l_discount, (l_partkey % 1500) / 100.0 - 7.5 AS x, (l_suppkey * 13 % 1200) / 100.0 AS y FROM lineitem"
_BREAK = "(1.575 + sqrt(6.75 * 6.75 - 6.60 * 6.60))"
_BEYOND = f"NOT ((y <= {_BREAK} AND abs(x) <= 6.60) OR (y > {_BREAK} AND sqrt(x * x + (y - 1.575) * (y - 1.575)) <= 6.75))"


@query(f"SELECT CASE WHEN abs(x) <= 1.47 AND y BETWEEN 5.6 AND 6.4 THEN 'ft' WHEN {_BEYOND} THEN 'beyond_arc' ELSE 'inside_arc' END AS zone, count(*) AS n FROM ({_XY}) GROUP BY 1")
def c5_zone_case(spark, sf_dir):
    return _xy(spark, sf_dir).select(court.zone_of(court.court("fiba_3x3"), F.col("x"), F.col("y"), F.lit(True)).alias("zone")).groupBy("zone").agg(F.count("*").alias("n"))


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0.05 THEN CASE WHEN {_BEYOND} THEN 2 ELSE 1 END ELSE 0 END AS points FROM ({_XY})")
def c6_rule_lookup(spark, sf_dir):
    zone = court.zone_of(court.court("fiba_3x3"), F.col("x"), F.col("y"), F.lit(False))
    return _xy(spark, sf_dir).select("l_orderkey", "l_linenumber", court.points_for(F.lit("3x3"), zone, F.col("l_discount") > 0.05).alias("points"))


@query(f"SELECT l_orderkey, l_linenumber, round(CASE WHEN y <= {_BREAK} THEN abs(x) - 6.60 ELSE sqrt(x * x + (y - 1.575) * (y - 1.575)) - 6.75 END, 4) AS d, abs(x) <= 7.8 AND y BETWEEN -0.3 AND 11.3 AS inside FROM ({_XY})")
def h11_arc_distance(spark, sf_dir):
    c = court.court("fiba_3x3")
    return _xy(spark, sf_dir).select("l_orderkey", "l_linenumber", _R(court.arc_distance(c, F.col("x"), F.col("y"))).alias("d"), court.on_court(c, F.col("x"), F.col("y"), 0.3).alias("inside"))


_H = [[2.0, 0.1, 5.0], [0.05, 1.5, -3.0], [0.001, 0.002, 1.0]]


@query(f"SELECT l_orderkey, l_linenumber, round((2.0 * x + 0.1 * y + 5.0) / (0.001 * x + 0.002 * y + 1), 6) AS u, round((0.05 * x + 1.5 * y - 3.0) / (0.001 * x + 0.002 * y + 1), 6) AS v FROM ({_XY})")
def h2_project(spark, sf_dir):
    p = geometry.project(_H, F.col("x"), F.col("y"))
    return _xy(spark, sf_dir).select("l_orderkey", "l_linenumber", _R(p["x"], 6).alias("u"), _R(p["y"], 6).alias("v"))


@query("SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(0.2 + (l_quantity - 25) / 14 * 0.7 + (l_discount - 0.05) / 0.03 * -0.4))), 6) AS p FROM lineitem")
def h21_logistic_score(spark, sf_dir):
    p = values.logistic([F.col("l_quantity"), F.col("l_discount")], [25, 0.05], [14, 0.03], [0.7, -0.4], 0.2)
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", _R(p, 6).alias("p"))


@query("""WITH s AS (SELECT vec_id, list_sum([(CAST(v AS DOUBLE) - 0.2) * (CAST(v AS DOUBLE) - 0.2) FOR v IN embedding[1:8]]) AS a, list_sum([(CAST(v AS DOUBLE) + 0.1) * (CAST(v AS DOUBLE) + 0.1) FOR v IN embedding[1:8]]) AS b FROM embeddings)
SELECT vec_id, CASE WHEN sqrt(least(a, b)) > 2.5 THEN '?' WHEN a <= b THEN 'A' ELSE 'B' END AS team FROM s""")
def h19_nearest_centre(spark, sf_dir):
    team = values.nearest_centre(F.slice("embedding", 1, 8), [[0.2] * 8, [-0.1] * 8], ["A", "B"], 2.5)
    return _read(spark, sf_dir, "embeddings").select("vec_id", team.alias("team"))


@query(r"SELECT event_id, CAST(regexp_extract(props, '(\d+)', 1) AS INTEGER) AS k, CAST(len(regexp_extract_all(props, '\d+')) AS INTEGER) AS n FROM events")
def a5_integers(spark, sf_dir):
    found = values.integers_in(F.col("props"))
    return _read(spark, sf_dir, "events").select("event_id", F.get(found, F.lit(0)).alias("k"), F.size(found).alias("n"))


@query("SELECT n_name, json_object('key', n_nationkey, 'region', r_name) AS body FROM nation JOIN region ON n_regionkey = r_regionkey")
def h25_json(spark, sf_dir):
    both = _read(spark, sf_dir, "nation").join(_read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select("n_name", F.to_json(F.struct(F.col("n_nationkey").alias("key"), F.col("r_name").alias("region"))).alias("body"))


@query("SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(floor(o_totalprice * 30000 / 1001 / 100 + 0.5) AS INTEGER) AS frame, 'b' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') AS cls FROM orders")
def h27_frames(spark, sf_dir):
    return _read(spark, sf_dir, "orders").select("o_orderkey", values.half_up(F.col("o_totalprice") * 30000 / 1001 / 100).cast("int").alias("frame"), values.class_name(F.col("o_orderkey") % 100).alias("cls"))


@query("SELECT c_nationkey AS k, 'c' AS side FROM customer UNION ALL SELECT s_nationkey, 's' FROM supplier")
def u1_union_all(spark, sf_dir):
    return _read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.lit("c").alias("side")).unionByName(_read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("s").alias("side")))


def _keys(spark, sf_dir):
    return _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), _read(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 3).alias("k"))


@query("SELECT c_custkey AS k FROM customer UNION SELECT s_suppkey * 3 FROM supplier")
def u2_union(spark, sf_dir):
    a, b = _keys(spark, sf_dir)
    return a.union(b).distinct()


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT s_suppkey * 3 FROM supplier")
def u3_difference(spark, sf_dir):
    a, b = _keys(spark, sf_dir)
    return matching.unmatched(a, b, ["k"])


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT s_suppkey * 3 FROM supplier")
def u4_intersection(spark, sf_dir):
    a, b = _keys(spark, sf_dir)
    return a.intersect(b)


@query("SELECT doc_id FROM documents WHERE text IN (SELECT text FROM documents GROUP BY 1 HAVING count(*) = 1)")
def a12_only_once(spark, sf_dir):
    keyed = _read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    return sequences.only_once(keyed, ["key"]).select("doc_id")


@query("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS INTEGER) AS n FROM orders")
def b6_renumber(spark, sf_dir):
    return sequences.renumbered(_read(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "n").select("o_custkey", "o_orderkey", "n")


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN 'new' ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 5 <> 0 OR c_custkey % 7 = 0")
def b8_upsert(spark, sf_dir):
    table = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    changes = table.where("k % 7 = 0 OR k % 5 = 0").select("k", F.when(F.col("k") % 7 == 0, "new").alias("v"))
    return sequences.upsert(table, changes, "k", "v")


@query("SELECT l_orderkey, l_partkey, l_linenumber FROM (SELECT *, abs(l_discount - 0.05) < 0.015 AS clean FROM lineitem WHERE l_linenumber BETWEEN 1 AND 5) a WHERE clean OR NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_linenumber BETWEEN 1 AND 5 AND abs(b.l_discount - 0.05) < 0.015)")
def c9_clean_views(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.lit(3).alias("release"), F.when(F.abs(F.col("l_discount") - 0.05) < 0.015, 0.0).otherwise(1.0).alias("overlap"))
    return sequences.clean_views(rows, ["l_orderkey"], "l_linenumber", "release", "overlap", 2, 2, 0.3).select("l_orderkey", "l_partkey", "l_linenumber")


@query("""SELECT l_returnflag AS split, count(*) FILTER (t) AS frames, round(count(*) FILTER (t AND f AND e <= greatest(20.0, 0.75 * z)) / greatest(count(*) FILTER (t), 1), 4) AS recall, round(median(e) FILTER (t AND f), 4) AS median_error,
count(*) FILTER (NOT t) AS none_frames, round(count(*) FILTER (NOT t AND f) / greatest(count(*) FILTER (NOT t), 1), 4) AS false_alarms
FROM (SELECT l_returnflag, l_linenumber % 3 > 0 AS t, l_discount > 0.02 AS f, l_quantity AS e, l_tax * 500 AS z FROM lineitem) GROUP BY 1""")
def g13_tracking_quality(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("split"), (F.col("l_linenumber") % 3 > 0).alias("truth"), (F.col("l_discount") > 0.02).alias("found"), F.col("l_quantity").alias("error"), (F.col("l_tax") * 500).alias("size"))
    out = aggregates.tracking_quality(rows, ["split"], "truth", "found", "error", "size")
    return out.withColumns({c: _R(c) for c in ("recall", "median_error", "false_alarms")})


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderpriority AS p, CAST(epoch(o_orderdate) // 86400 AS BIGINT) AS a FROM orders), n AS (SELECT l_orderkey AS k, CAST(epoch(l_shipdate) // 86400 AS BIGINT) AS d, min(l_quantity) AS r FROM lineitem GROUP BY ALL),
z AS (SELECT l_orderkey AS k, CAST(max(epoch(l_shipdate) // 86400) AS BIGINT) AS z FROM lineitem GROUP BY 1),
c AS (SELECT o.k, p, count(n.d) / nullif(least(45, greatest(0, z - a)), 0) AS covered, min(r) AS nearest FROM o JOIN z ON z.k = o.k LEFT JOIN n ON n.k = o.k AND n.d BETWEEN a AND least(a + 44, z - 1) GROUP BY o.k, p, a, z)
SELECT p AS priority, count(*) AS shots, round(median(covered), 4) AS median_covered, count(*) FILTER (covered >= 0.03) AS well_covered, count(*) FILTER (nearest <= 20) AS reached FROM c GROUP BY 1""")
def g14_coverage(spark, sf_dir):
    day = lambda c: F.unix_date(F.to_date(c)).cast("long")
    o = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("priority"), day("o_orderdate").alias("start"))
    lines = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), day("l_shipdate").alias("day"), "l_quantity")
    points = lines.groupBy("key", "day").agg(F.min("l_quantity").alias("q"))
    ends = lines.groupBy("key").agg(F.max("day").alias("frames"))
    found = aggregates.coverage(o, points, ["key"], "start", 45, "day", F.col("q"), ends)
    out = aggregates.coverage_summary(found.join(o.select("key", "priority"), "key"), ["priority"], F.lit(20), 0.03)
    return out.withColumn("median_covered", _R("median_covered"))


@query(r"""SELECT user_id, array_to_string(arg_min(n, event_id) FILTER (len(n) > 0), ',') AS jersey FROM (SELECT user_id, event_id, CASE WHEN event_id % 4 > 0 THEN [] ELSE regexp_extract_all(props, '\d') END AS n FROM events) GROUP BY 1""")
def g20_first_known(spark, sf_dir):
    found = F.when(F.col("event_id") % 4 > 0, F.array().cast("array<string>")).otherwise(F.regexp_extract_all("props", F.lit(r"\d"), F.lit(0)))
    rows = _read(spark, sf_dir, "events").select("user_id", "event_id", found.alias("n"))
    return aggregates.first_known(rows, ["user_id"], "n", "event_id").select("user_id", F.array_join("n", ",").alias("jersey"))


@query("SELECT o_orderkey, CAST(floor(a + k * (z - a) / 4.0) AS INTEGER) AS frame FROM (SELECT o_orderkey, o_custkey % 50 AS a, o_custkey % 50 + o_orderkey % 400 AS z FROM orders), unnest(range(0, 5)) AS u(k)")
def w14_evenly_spaced(spark, sf_dir):
    rows = _read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("a"), (F.col("o_custkey") % 50 + F.col("o_orderkey") % 400).alias("z"))
    return sequences.evenly_spaced(rows, "a", "z", 5, "frame").select("o_orderkey", "frame")


@query("""SELECT o_custkey AS video, count(*) AS items, count(*) FILTER (k % 3 > 0) AS decided, count(*) FILTER (k % 3 = 1) AS ok, count(*) FILTER (k % 3 = 2) AS skip, count(*) FILTER (k % 3 = 0) AS to_go, count(*) FILTER (k % 3 = 1 AND k % 4 <> k % 5) AS changed,
coalesce(min(k) FILTER (k % 3 = 0), min(k)) AS next, count(*) FILTER (o_orderstatus IN ('O', 'F') AND k % 7 > 0) AS complete FROM (SELECT *, o_orderkey AS k FROM orders) GROUP BY 1""")
def c12_review_progress(spark, sf_dir):
    k = F.col("k")
    status = F.when(k % 3 == 1, "ok").when(k % 3 == 2, "skip")
    items = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("video"), F.col("o_orderkey").alias("k"), "o_orderstatus").withColumn("status", status)
    counts = review.progress(items, ["video"], "status", ["ok", "skip"], k % 4, k % 5)
    team = F.when(F.col("o_orderstatus") == "O", "A").when(F.col("o_orderstatus") == "F", "B").otherwise("?")
    done = items.groupBy("video").agg(F.count_if(review.is_complete(team, F.lit("1"), F.when(k % 7 == 0, "auto"))).alias("complete"))
    return counts.join(review.first_undecided(items, ["video"], "k", "status").withColumnRenamed("k", "next"), "video").join(done, "video")


@query("SELECT o_custkey AS video, o_orderkey % 5000 AS release, format('{:.3f}', round((o_orderkey % 5000) / 25.0 + 0.4, 3)) AS timestamp_s, CAST(o_orderkey % 5000 + 10 AS VARCHAR) AS frame, CASE WHEN o_totalprice > 100000 THEN '1' ELSE '0' END AS made, 'auto' AS note FROM orders")
def c13_proposals(spark, sf_dir):
    shots = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("video"), (F.col("o_orderkey") % 5000).alias("release"), (F.col("o_totalprice") > 100000).alias("made"))
    return review.proposals(shots, 25.0).select("video", (F.col("frame").cast("long") - 10).alias("release"), "timestamp_s", "frame", "made", "note")
