"""Queries over the given tables, each with the SQL that DuckDB runs for the same rows.

The tables stand for the engine's domain: conversations for threads, documents for reports, orders and lineitem for
fixes and their backports, customers' and suppliers' nations and regions for layers and domains.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.functions import rules, stats, text
from faultline.sources.tables import spread, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


#: Ordered classes of documents by what they hold.
DOCUMENT_RULES = [("license", ["license", "copyright"]), ("contact", [r"[a-z0-9._]+@[a-z0-9.]+"]), ("secret", ["secret", "password", "api[_-]?key"]), ("number", [r"[0-9]{3}-[0-9]{4}", r"[0-9]{5}"]), ("table", [r" \| "])]
_CASE = "CASE " + " ".join("WHEN " + " OR ".join(f"regexp_matches(coalesce(text, ''), '{p}', 'i')" for p in patterns) + f" THEN '{name}'" for name, patterns in DOCUMENT_RULES) + " ELSE 'unknown' END"
_FLAGS = ", ".join("CASE WHEN " + " OR ".join(f"regexp_matches(coalesce(text, ''), '{p}', 'i')" for p in patterns) + f" THEN '{name}' END" for name, patterns in DOCUMENT_RULES)
_LABELLED = f"SELECT doc_id, list_filter([{_FLAGS}], lambda x: x IS NOT NULL) AS labels FROM documents"


@register(f"""WITH c AS (SELECT {_CASE} AS class, n_chars FROM documents)
SELECT class, count(*) AS n, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM c) AS pct, list_sort(list(n_chars))[count(*) // 2 + 1] AS median_chars FROM c GROUP BY class""")
def first_match_distribution(spark, sf):
    """Ordered rules, first match; share and upper median size of each class."""
    docs = spread(table(spark, sf, "documents").select("text", "n_chars")).select(rules.first_match(F.coalesce("text", F.lit("")), DOCUMENT_RULES, "unknown").alias("class"), "n_chars")
    counts = docs.groupBy("class").agg(F.count(F.lit(1)).alias("n"), stats.upper_median("n_chars").alias("median_chars"))
    return counts.withColumn("pct", stats.percent(F.col("n"), F.sum("n").over(Window.partitionBy())))  # over the few classes


def _labelled(spark, sf) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").select("doc_id", rules.multi_label(F.coalesce("text", F.lit("")), DOCUMENT_RULES).alias("labels"))


@register(f"WITH l AS ({_LABELLED}) SELECT label, count(*) AS n, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM documents) AS pct FROM (SELECT unnest(labels) AS label FROM l) GROUP BY label")
def multilabel_distribution(spark, sf):
    labelled = _labelled(spark, sf)
    counts = labelled.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(labelled.agg(F.count(F.lit(1)).alias("t")))).select("label", "n", stats.percent(F.col("n"), F.col("t")).alias("pct"))


@register(f"""WITH l AS ({_LABELLED}), e AS (SELECT doc_id, unnest(labels) AS label FROM l)
SELECT a.label AS first, b.label AS second, count(*) AS n FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.label < b.label GROUP BY 1, 2""")
def label_cooccurrence(spark, sf):
    return stats.cooccurrence(_labelled(spark, sf), "doc_id", "labels")


@register(f"""WITH l AS ({_LABELLED}), c AS (SELECT label, count(*) AS n FROM (SELECT unnest(labels) AS label FROM l) GROUP BY label)
SELECT label, n, sum(n) OVER o::BIGINT AS cumulative, (sum(n) OVER o) * 100.0::DOUBLE / (SELECT count(*) FROM documents) AS cumulative_pct FROM c WINDOW o AS (ORDER BY n DESC, label ROWS UNBOUNDED PRECEDING)""")
def cumulative_coverage(spark, sf):
    labelled = _labelled(spark, sf)
    counts = labelled.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    whole = counts.crossJoin(F.broadcast(labelled.agg(F.count(F.lit(1)).alias("t"))))
    return stats.cumulative(whole, "label", "n", F.col("t")).drop("t")


@register("""SELECT event_type, count(*) AS n, median(value) AS true_median, list_sort(list(value))[count(*) // 2 + 1] AS upper_median, count(DISTINCT user_id) AS users FROM events GROUP BY event_type""")
def true_vs_upper_median(spark, sf):
    events = table(spark, sf, "events")
    medians = [F.count(F.lit(1)).alias("n"), F.median("value").alias("true_median"), stats.upper_median("value").alias("upper_median")]
    return events.groupBy("event_type").agg(*medians, F.countDistinct("user_id").alias("users"))


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NEVER"]


@register(f"""WITH s AS (SELECT unnest({PRIORITIES}) AS o_orderpriority, unnest(range({len(PRIORITIES)}))::INT AS place)
SELECT place, s.o_orderpriority, count(o_orderkey) AS n FROM s LEFT JOIN orders USING (o_orderpriority) GROUP BY 1, 2""")
def zero_filled_distribution(spark, sf):
    return stats.zero_filled(table(spark, sf, "orders").select("o_orderpriority"), "o_orderpriority", PRIORITIES)


@register("SELECT c_nationkey, c_custkey, c_name, place FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey)::INT AS place FROM customer) WHERE place <= 3")
def first_k_examples_per_group(spark, sf):
    return stats.first_k(table(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_name"), ["c_nationkey"], ["c_custkey"], 3)


_SCORED = """WITH f AS (SELECT o_orderkey, count(l_linenumber) AS n, count(DISTINCT l_suppkey) AS files, coalesce(sum(l_quantity), 0) AS size, o_orderpriority FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderpriority),
s AS (SELECT o_orderkey, CASE WHEN size <= 50 THEN 0 WHEN size <= 150 THEN 1 ELSE 2 END AS size_score, CASE WHEN files <= 1 THEN 0 WHEN files <= 3 THEN 1 ELSE 2 END AS file_score, CASE WHEN n <= 1 THEN 0 WHEN n <= 3 THEN 1 ELSE 2 END AS round_score, CASE WHEN o_orderpriority LIKE '1%' THEN 0 ELSE 1 END AS urgent_score FROM f),
t AS (SELECT *, size_score + file_score + round_score + urgent_score AS score FROM s)"""


def _scored(spark, sf) -> DataFrame:
    given = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("l_linenumber").alias("n"), F.countDistinct("l_suppkey").alias("files"), F.sum("l_quantity").alias("size"))
    score = lambda c, low, mid: F.when(F.coalesce(F.col(c), F.lit(0)) <= low, 0).when(F.col(c) <= mid, 1).otherwise(2)
    scored = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority").join(given, "o_orderkey", "left")
    scored = scored.select("o_orderkey", score("size", 50, 150).alias("size_score"), score("files", 1, 3).alias("file_score"), score("n", 1, 3).alias("round_score"), F.when(F.col("o_orderpriority").startswith("1"), 0).otherwise(1).alias("urgent_score"))
    return scored.withColumn("score", F.col("size_score") + F.col("file_score") + F.col("round_score") + F.col("urgent_score"))


@register(_SCORED + " SELECT CASE WHEN score <= 3 THEN 'easy' WHEN score <= 5 THEN 'medium' ELSE 'hard' END AS tier, count(*) AS n, avg(score) AS mean_score, min(o_orderkey) AS first_order FROM t GROUP BY 1")
def composite_score_tiers(spark, sf):
    tier = F.when(F.col("score") <= 3, "easy").when(F.col("score") <= 5, "medium").otherwise("hard")
    return _scored(spark, sf).groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.min("o_orderkey").alias("first_order"))


@register(_SCORED + " SELECT score, count(*) AS n FROM t GROUP BY score")
def score_histogram(spark, sf):
    return _scored(spark, sf).groupBy("score").agg(F.count(F.lit(1)).alias("n"))


@register(_SCORED + " SELECT feature, avg(v) AS mean, max(v) AS most FROM (UNPIVOT (SELECT size_score, file_score, round_score, urgent_score FROM t) ON COLUMNS(*) INTO NAME feature VALUE v) GROUP BY feature")
def feature_contributions(spark, sf):
    features = ["size_score", "file_score", "round_score", "urgent_score"]
    return _scored(spark, sf).select(*features).unpivot([], features, "feature", "v").groupBy("feature").agg(F.avg("v").alias("mean"), F.max("v").alias("most"))


@register("""WITH s AS (SELECT p_partkey, p_size, p_retailprice, CASE WHEN p_size <= 10 THEN 0 WHEN p_size <= 25 THEN 1 WHEN p_size <= 40 THEN 2 ELSE 3 END + CASE WHEN p_retailprice < 1000 THEN 0 WHEN p_retailprice < 1400 THEN 1 ELSE 2 END AS composite FROM part)
SELECT p_partkey, composite, row_number() OVER (ORDER BY composite DESC, p_size DESC, p_partkey)::INT AS rank, list_filter([CASE WHEN p_size > 40 THEN 'large' END, CASE WHEN p_retailprice >= 1400 THEN 'dear' END], lambda x: x IS NOT NULL)::VARCHAR AS hooks FROM s QUALIFY rank <= 50""")
def rank_candidates(spark, sf):
    size, price = F.col("p_size"), F.col("p_retailprice")
    composite = F.when(size <= 10, 0).when(size <= 25, 1).when(size <= 40, 2).otherwise(3) + F.when(price < 1000, 0).when(price < 1400, 1).otherwise(2)
    hooks = rules.labels([("large", size > 40), ("dear", price >= 1400)])
    top = table(spark, sf, "part").withColumn("composite", composite).orderBy(F.desc("composite"), F.desc("p_size"), "p_partkey").limit(50)
    order = Window.orderBy(F.desc("composite"), F.desc("p_size"), "p_partkey")
    return top.select("p_partkey", "composite", F.row_number().over(order).alias("rank"), F.concat(F.lit("["), F.array_join(hooks, ", "), F.lit("]")).alias("hooks"))


@register("""WITH u AS (SELECT p_partkey, 'size' AS dimension, p_size::DOUBLE AS v FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part)
SELECT dimension, p_partkey, v, row_number() OVER (PARTITION BY dimension ORDER BY v DESC, p_partkey)::INT AS place FROM u QUALIFY place <= 5""")
def top_by_dimension(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return stats.first_k(parts.unpivot(["p_partkey"], ["size", "price"], "dimension", "v"), ["dimension"], [F.desc("v"), "p_partkey"], 5)


_CLUSTERS = [("rich", "c_acctbal > 5000"), ("debtor", "c_acctbal < 0"), ("builder", "c_mktsegment = 'BUILDING'"), ("buyer", "n_orders >= 10"), ("idle", "n_orders = 0")]
_MEMBERS = "WITH f AS (SELECT c_custkey, c_acctbal, c_mktsegment, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2, 3), m AS (" + " UNION ALL ".join(f"SELECT c_custkey, {i} AS ord, '{n}' AS cluster, c_acctbal FROM f WHERE {c}" for i, (n, c) in enumerate(_CLUSTERS)) + ")"


def _clusters(spark, sf) -> DataFrame:
    orders = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("_n"))
    features = table(spark, sf, "customer").join(orders, "c_custkey", "left").withColumn("n_orders", F.coalesce("_n", F.lit(0)))
    return features.withColumn("clusters", rules.labels([(n, F.expr(c)) for n, c in _CLUSTERS]))


@register(_MEMBERS + " SELECT cluster, count(*) AS n, list_sort(list(c_acctbal))[count(*) // 2 + 1] AS median_balance FROM m GROUP BY cluster")
def cluster_membership(spark, sf):
    members = _clusters(spark, sf).select("c_acctbal", F.explode("clusters").alias("cluster"))
    return members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), stats.upper_median("c_acctbal").alias("median_balance"))


@register(_MEMBERS + " SELECT a.cluster AS first, b.cluster AS second, count(*) AS n FROM m a JOIN m b ON a.c_custkey = b.c_custkey AND a.ord < b.ord GROUP BY 1, 2")
def cluster_overlap(spark, sf):
    place = F.create_map(*(F.lit(x) for i, (n, _) in enumerate(_CLUSTERS) for x in (n, i)))
    pairs = F.flatten(F.transform("clusters", lambda a: F.transform(F.filter("clusters", lambda b: place[b] > place[a]), lambda b: F.struct(a.alias("first"), b.alias("second")))))
    return _clusters(spark, sf).select(F.explode(pairs).alias("p")).groupBy("p.first", "p.second").agg(F.count(F.lit(1)).alias("n"))


@register(_MEMBERS + " SELECT memberships, count(*) AS n FROM (SELECT f.c_custkey, count(m.cluster)::INT AS memberships FROM f LEFT JOIN m USING (c_custkey) GROUP BY 1) GROUP BY 1")
def membership_histogram(spark, sf):
    return _clusters(spark, sf).groupBy(F.size("clusters").alias("memberships")).agg(F.count(F.lit(1)).alias("n"))


_LAG = "SELECT o_orderkey, l_suppkey, date_diff('day', o_orderdate, l_shipdate) AS lag FROM orders JOIN lineitem ON o_orderkey = l_orderkey"


def _lags(spark, sf) -> DataFrame:
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate").join(orders, "l_orderkey").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey", F.datediff("l_shipdate", "o_orderdate").cast("long").alias("lag"))


LAG_BOUNDS, LAG_NAMES = [3, 7, 14, 30, 60], ["0-3", "4-7", "8-14", "15-30", "31-60", "61+"]


@register(f"WITH l AS ({_LAG}) SELECT CASE WHEN lag <= 3 THEN '0-3' WHEN lag <= 7 THEN '4-7' WHEN lag <= 14 THEN '8-14' WHEN lag <= 30 THEN '15-30' WHEN lag <= 60 THEN '31-60' ELSE '61+' END AS bucket, count(*) AS n FROM l WHERE lag BETWEEN 0 AND 365 GROUP BY 1")
def backport_lag_buckets(spark, sf):
    return _lags(spark, sf).where(F.col("lag").between(0, 365)).groupBy(stats.buckets(F.col("lag"), LAG_BOUNDS, LAG_NAMES).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@register(f"WITH l AS ({_LAG}) SELECT s_nationkey AS branch, count(*) AS n, median(lag)::DOUBLE AS median_lag, avg(lag) AS mean_lag FROM l JOIN supplier ON l_suppkey = s_suppkey WHERE lag BETWEEN 0 AND 365 GROUP BY 1 HAVING count(*) >= 5")
def lag_by_branch(spark, sf):
    branch = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("branch"))
    found = _lags(spark, sf).where(F.col("lag").between(0, 365)).join(branch, "l_suppkey").groupBy("branch")
    return found.agg(F.count(F.lit(1)).alias("n"), F.median("lag").alias("median_lag"), F.avg("lag").alias("mean_lag")).where("n >= 5")


@register("""WITH c AS (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
SELECT CASE WHEN n = 0 THEN '0' WHEN n = 1 THEN '1' WHEN n <= 3 THEN '2-3' WHEN n <= 5 THEN '4-5' ELSE '6+' END AS tier, count(*) AS n_orders FROM c GROUP BY 1""")
def coverage_tiers(spark, sf):
    n = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    counts = table(spark, sf, "orders").select("o_orderkey").join(n, "o_orderkey", "left")
    return counts.groupBy(stats.buckets(F.coalesce("n", F.lit(0)), [0, 1, 3, 5], ["0", "1", "2-3", "4-5", "6+"]).alias("tier")).agg(F.count(F.lit(1)).alias("n_orders"))


@register("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def missing_backports(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@register("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY 1")
def found_in_stable(spark, sf):
    return table(spark, sf, "orders").join(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@register("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2")
def intent_matrix(spark, sf):
    return table(spark, sf, "labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


@register("""WITH t AS (SELECT conv_id, turn, role, length(text) AS n, lead(turn) OVER w AS next_turn, lead(role) OVER w AS next_role, lead(length(text)) OVER w AS next_n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT role, next_role, count(*) AS n, avg(next_n - n) AS mean_delta FROM t WHERE next_turn IS NOT NULL GROUP BY 1, 2""")
def version_transitions(spark, sf):
    w, size = Window.partitionBy("conv_id").orderBy("turn"), F.char_length("text")
    t = table(spark, sf, "conversations").select("role", size.alias("_n"), F.lead("turn").over(w).alias("next_turn"), F.lead("role").over(w).alias("next_role"), F.lead(size).over(w).alias("next_n"))
    return t.where(F.col("next_turn").isNotNull()).groupBy("role", "next_role").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("next_n") - F.col("_n")).alias("mean_delta"))


@register("""WITH e AS (SELECT user_id, ts, row_number() OVER w AS v, lead(ts) OVER w AS next_ts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT month(ts) AS m, CASE WHEN v >= 5 THEN 'Iter5+' ELSE 'Iter' || v || '->Iter' || (v + 1) END AS gap, date_diff('second', ts, next_ts) AS secs FROM e WHERE next_ts IS NOT NULL)
SELECT m AS month, gap, count(*) AS n, sum(secs)::BIGINT AS seconds FROM g GROUP BY 1, 2""")
def iteration_gaps_by_month(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    whole = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    e = table(spark, sf, "events").select("ts", F.row_number().over(w).alias("v"), F.lead("ts").over(w).alias("next_ts")).where(F.col("next_ts").isNotNull())
    gap = F.when(F.col("v") >= 5, "Iter5+").otherwise(F.concat(F.lit("Iter"), F.col("v"), F.lit("->Iter"), F.col("v") + 1))
    return e.groupBy(F.month("ts").cast("long").alias("month"), gap.alias("gap")).agg(F.count(F.lit(1)).alias("n"), F.sum(whole("next_ts") - whole("ts")).alias("seconds"))


@register("""WITH t AS (SELECT text, length(text) AS n, lead(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS next_n FROM conversations),
l AS (SELECT unnest(list_filter([CASE WHEN contains(text, 'the') THEN 'the' END, CASE WHEN contains(text, 'ing') THEN 'ing' END, CASE WHEN contains(text, '?') THEN 'question' END], lambda x: x IS NOT NULL)) AS label, next_n - n AS delta FROM t WHERE next_n IS NOT NULL)
SELECT label, count(*) AS n, avg(abs(delta)) AS mean_abs_delta FROM l GROUP BY 1""")
def feedback_impact(spark, sf):
    body, size = F.col("text"), F.char_length("text")
    t = table(spark, sf, "conversations").select("text", (F.lead(size).over(Window.partitionBy("conv_id").orderBy("turn")) - size).alias("delta")).where(F.col("delta").isNotNull())
    marks = rules.labels([("the", body.contains("the")), ("ing", body.contains("ing")), ("question", body.contains("?"))])
    return t.select(F.explode(marks).alias("label"), "delta").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs("delta")).alias("mean_abs_delta"))


_REL = """WITH c AS (SELECT o_orderkey, n_regionkey AS c_domain, c_nationkey AS c_layer FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
f AS (SELECT l_orderkey AS o_orderkey, n_regionkey AS f_domain, s_nationkey AS f_layer, sum(l_quantity) AS w FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3),
p AS (SELECT * FROM (SELECT o_orderkey, f_domain, f_layer, w, row_number() OVER (PARTITION BY o_orderkey, f_domain ORDER BY w DESC, f_layer) AS r FROM f) WHERE r = 1),
x AS (SELECT c.o_orderkey, c_domain, c_layer, p.f_layer, p.w, CASE WHEN p.f_layer IS NULL THEN 'cross_domain' WHEN p.f_layer = c_layer THEN 'same_layer' ELSE 'cross_layer' END AS relation FROM c JOIN (SELECT DISTINCT o_orderkey FROM f) USING (o_orderkey) LEFT JOIN p ON c.o_orderkey = p.o_orderkey AND c_domain = p.f_domain)"""


#: Items of a task.
ITEMS = 500_000


def _relations(spark, sf) -> DataFrame:
    nation = F.broadcast(table(spark, sf, "nation").select("n_nationkey", "n_regionkey"))  # 25 nations at any scale
    customers = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("n_regionkey").alias("c_domain"), F.col("c_nationkey").alias("c_layer"))
    left = table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(customers, "o_custkey")
    suppliers = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_regionkey").alias("f_domain"), F.col("s_nationkey").alias("f_layer"))
    fixes = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey", "l_quantity").join(suppliers, "l_suppkey").select("o_orderkey", "f_domain", "f_layer", "l_quantity")
    # Dealt once by order: all three aggregates and the join are local to it, and parts go by the number of items, as tasks keep them in hash maps.
    parts = max(spark.sparkContext.defaultParallelism, -(-table(spark, sf, "lineitem").count() // ITEMS))
    fixes = fixes.repartition(parts, "o_orderkey").groupBy("o_orderkey", "f_domain", "f_layer").agg(F.sum("l_quantity").alias("w"))
    # The heaviest layer of each domain is an aggregate, not a window: max by (weight, then smaller layer).
    primary = fixes.groupBy("o_orderkey", "f_domain").agg(F.max(F.struct("w", (-F.col("f_layer")).alias("neg"))).alias("top"))
    per_order = primary.groupBy("o_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("f_domain", "top"))).alias("tops"))
    found = left.join(per_order, "o_orderkey").withColumn("top", F.try_element_at("tops", F.col("c_domain")))
    layer = -F.col("top.neg")
    relation = F.when(F.col("top").isNull(), "cross_domain").when(layer == F.col("c_layer"), "same_layer").otherwise("cross_layer")
    return found.select("o_orderkey", "c_domain", "c_layer", layer.alias("f_layer"), F.col("top.w").alias("w"), relation.alias("relation"))


@register(_REL + " SELECT relation, count(*) AS n FROM x GROUP BY 1")
def relation_class(spark, sf):
    return _relations(spark, sf).groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


@register(_REL + " SELECT c_domain AS domain, CASE WHEN f_layer < c_layer THEN 'fix_in_upper_layer' ELSE 'fix_in_lower_layer' END AS direction, count(*) AS n, sum(w) AS weight FROM x WHERE relation = 'cross_layer' GROUP BY 1, 2")
def relation_direction(spark, sf):
    direction = F.when(F.col("f_layer") < F.col("c_layer"), "fix_in_upper_layer").otherwise("fix_in_lower_layer")
    return _relations(spark, sf).where("relation = 'cross_layer'").groupBy(F.col("c_domain").alias("domain"), direction.alias("direction")).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("weight"))


@register(_REL + """ SELECT strict, k, n FROM (SELECT 'layer' AS strict, k, count(*) FILTER (relation <> 'same_layer' AND (relation = 'cross_domain' OR abs(f_layer - c_layer) > k)) AS n FROM x, (SELECT unnest([1, 2, 3])::INT AS k) GROUP BY k
UNION ALL SELECT 'stack', k, count(*) FILTER (relation = 'cross_domain') FROM x, (SELECT unnest([1, 2, 3])::INT AS k) GROUP BY k)""")
def mode_grid(spark, sf):
    away = F.abs(F.col("f_layer") - F.col("c_layer"))
    cells = [(strict, k) for strict in ("layer", "stack") for k in (1, 2, 3)]
    test = lambda strict, k: (F.col("relation") == "cross_domain") | (F.lit(strict == "layer") & (F.col("relation") == "cross_layer") & F.coalesce(away > k, F.lit(False)))
    once = _relations(spark, sf).agg(*(F.count_if(test(s, k)).alias(f"{s}_{k}") for s, k in cells))
    return once.select(F.explode(F.array(*(F.struct(F.lit(s).alias("strict"), F.lit(k).alias("k"), F.col(f"{s}_{k}").alias("n")) for s, k in cells))).alias("x")).select("x.*")


@register(_REL + " SELECT o_orderkey, c_domain, f_layer, w FROM x WHERE f_layer IS NOT NULL")
def weighted_primary(spark, sf):
    return _relations(spark, sf).where(F.col("f_layer").isNotNull()).select("o_orderkey", "c_domain", "f_layer", "w")


@register("""WITH d AS (SELECT d.doc_id, list_distinct(regexp_extract_all(d.text, '[a-zA-Z_][a-zA-Z0-9_]+')) AS a, list_distinct(regexp_extract_all(b.text, '[a-zA-Z_][a-zA-Z0-9_]+')) AS b FROM documents d JOIN benchmark b ON d.doc_id = b.item_id)
SELECT doc_id, len(a)::INT AS n_a, len(b)::INT AS n_b, len(list_intersect(a, b))::INT AS shared, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) END AS jaccard FROM d""")
def token_jaccard(spark, sf):
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("_other"))
    both = table(spark, sf, "documents").select("doc_id", "text").join(items, "doc_id").select("doc_id", text.tokens(F.col("text")).alias("a"), text.tokens(F.col("_other")).alias("b"))
    return both.select("doc_id", F.size("a").alias("n_a"), F.size("b").alias("n_b"), F.size(F.array_intersect("a", "b")).alias("shared"), text.jaccard(F.col("a"), F.col("b")).alias("jaccard"))


@register("""WITH d AS (SELECT list_distinct(regexp_extract_all(d.text, '[a-zA-Z_][a-zA-Z0-9_]+')) AS a, list_distinct(regexp_extract_all(b.text, '[a-zA-Z_][a-zA-Z0-9_]+')) AS b FROM documents d JOIN benchmark b ON d.doc_id = b.item_id),
j AS (SELECT CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) END AS j FROM d)
SELECT (floor(floor(j * 100) / 5) * 5)::INT AS bin, count(*) AS n FROM j GROUP BY 1""")
def token_overlap_hist(spark, sf):
    return token_jaccard(spark, sf).groupBy(stats.bin_of(F.col("jaccard")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@register("""SELECT doc_id, len(string_split(text, chr(10)))::INT AS n_lines, least(len(string_split(text, chr(10))), 10)::INT AS first_10, length(array_to_string(list_slice(string_split(text, chr(10)), 1, 10), chr(10)))::INT AS chars_10 FROM documents WHERE text IS NOT NULL""")
def line_truncation_retention(spark, sf):
    parts = text.lines(F.col("text"))
    return table(spark, sf, "documents").where(F.col("text").isNotNull()).select("doc_id", F.size(parts).alias("n_lines"), F.least(F.size(parts), F.lit(10)).alias("first_10"), F.char_length(F.array_join(F.slice(parts, 1, 10), "\n")).alias("chars_10"))


@register("""WITH l AS (SELECT conv_id, turn, role, list_filter(string_split(text, chr(10)), lambda x: NOT starts_with(x, '>')) AS ls FROM conversations)
SELECT conv_id, turn, length(array_to_string(ls, chr(10)))::INT AS own_chars, len(list_filter(ls, lambda x: trim(x) <> ''))::INT AS filled FROM l WHERE role = 'user' AND len(list_filter(ls, lambda x: trim(x) <> '')) >= 1""")
def human_review_filter(spark, sf):
    own = F.filter(text.lines(F.col("text")), lambda x: ~x.startswith(">"))
    filled = F.size(F.filter(own, lambda x: F.trim(x) != ""))
    return table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", F.char_length(F.array_join(own, "\n")).alias("own_chars"), filled.alias("filled")).where("filled >= 1")


@register("""SELECT page_id, unnest(regexp_extract_all(html, '<a[^>]+href="([^"]+)"', 1)) AS href FROM pages""")
def html_links(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a[^>]+href="([^"]+)"'), F.lit(1))).alias("href"))


@register("""SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]+)', 1) AS top, regexp_extract(url, '[?&]page=([0-9]+)', 1) AS page FROM pages""")
def url_parts(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select("page_id", F.regexp_extract(url, "^([a-z]+)://", 1).alias("scheme"), F.regexp_extract(url, "^[a-z]+://([^/?#]+)", 1).alias("host"), F.regexp_extract(url, "^[a-z]+://[^/]+/([^/?#]+)", 1).alias("top"), F.regexp_extract(url, "[?&]page=([0-9]+)", 1).alias("page"))


PATH_LAYERS = [rules.Layer("english", "core", 0, ("en/1", "en/2")), rules.Layer("english", "other", 2, (), (r"^en/",)), rules.Layer("romance", "french", 1, ("fr/",)), rules.Layer("romance", "spanish", 1, ("es/",))]


@register("""WITH p AS (SELECT regexp_extract(url, '^[a-z]+://[^/]+/(.*)$', 1) AS path FROM pages)
SELECT CASE WHEN starts_with(path, 'en/1') OR starts_with(path, 'en/2') OR starts_with(path, 'en/') THEN 'english' WHEN starts_with(path, 'fr/') OR starts_with(path, 'es/') THEN 'romance' END AS domain,
CASE WHEN starts_with(path, 'en/1') OR starts_with(path, 'en/2') THEN 'core (core)' WHEN starts_with(path, 'en/') THEN 'other (specific)' WHEN starts_with(path, 'fr/') THEN 'french (framework)' WHEN starts_with(path, 'es/') THEN 'spanish (framework)' END AS label, count(*) AS n FROM p GROUP BY 1, 2""")
def path_taxonomy(spark, sf):
    found = table(spark, sf, "pages").select(rules.taxonomy(F.regexp_extract("url", "^[a-z]+://[^/]+/(.*)$", 1), PATH_LAYERS).alias("x"))
    return found.groupBy(F.col("x.domain").alias("domain"), rules.layer_label(F.col("x.layer"), F.col("x.level")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


STEPS = ["signup", "view", "click", "purchase", "error"]


@register(f"""WITH s AS (SELECT user_id, max(list_position({STEPS}, event_type)) AS step FROM events WHERE event_type <> 'error' GROUP BY 1)
SELECT {STEPS}[step] AS step, count(*) AS n FROM s GROUP BY 1""")
def pipeline_progress(spark, sf):
    steps = F.array(*map(F.lit, STEPS))
    reached = table(spark, sf, "events").where("event_type <> 'error'").groupBy("user_id").agg(F.max(F.array_position(steps, F.col("event_type"))).alias("at"))
    return reached.groupBy(F.element_at(steps, F.col("at").cast("int")).alias("step")).agg(F.count(F.lit(1)).alias("n"))


@register("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def insert_or_ignore(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@register("SELECT CASE WHEN l.doc_id IS NULL THEN 'unlabelled' WHEN quality = 0 THEN 'poor' WHEN toxic = 1 THEN 'toxic' ELSE 'ok' END AS class, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def missing_classes(spark, sf):
    both = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").withColumn("known", F.lit(True)), "doc_id", "left")
    return both.groupBy(F.when(F.col("known").isNull(), "unlabelled").when(F.col("quality") == 0, "poor").when(F.col("toxic") == 1, "toxic").otherwise("ok").alias("class")).agg(F.count(F.lit(1)).alias("n"))


@register("SELECT event_type, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS total, count(*) AS n FROM events GROUP BY 1")
def json_props(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.sum(F.from_json("props", "k bigint")["k"]).alias("total"), F.count(F.lit(1)).alias("n"))


@register("SELECT count(*) AS n, count(*) FILTER (lang = 'en') AS n_en, count(DISTINCT source) AS n_sources, max(n_chars) AS most_chars, count(*) FILTER (contains(text, 'license')) AS n_license FROM documents")
def corpus_stats(spark, sf):
    return table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lang") == "en").alias("n_en"), F.countDistinct("source").alias("n_sources"), F.max("n_chars").alias("most_chars"), F.count_if(F.col("text").contains("license")).alias("n_license"))


@register("SELECT doc_id, lang, n_chars, left(text, 300) AS summary, n_chars > 300 AS is_cut FROM documents")
def index_projection(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang", "n_chars", F.left("text", F.lit(300)).alias("summary"), (F.col("n_chars") > 300).alias("is_cut"))


@register("SELECT doc_id, source FROM documents WHERE contains(lower(text), 'thing') ORDER BY doc_id LIMIT 30")
def keyword_search(spark, sf):
    return table(spark, sf, "documents").where(F.lower("text").contains("thing")).select("doc_id", "source").orderBy("doc_id").limit(30)


@register("SELECT source, count(*) AS n, count(quality) AS n_labelled, count(*) FILTER (quality IS NULL) AS n_missing FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def completeness_report(spark, sf):
    both = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("quality").alias("n_labelled"), F.count_if(F.col("quality").isNull()).alias("n_missing"))


@register("SELECT coalesce(lang, 'all') AS lang, coalesce(source, 'all') AS source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), (lang, source))")
def grouping_sets(spark, sf):
    docs = table(spark, sf, "documents").select("lang", "source")
    return docs.groupingSets([["lang"], ["source"], ["lang", "source"]], "lang", "source").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("lang", F.lit("all")).alias("lang"), F.coalesce("source", F.lit("all")).alias("source"), "n")


@register("SELECT time_bucket(INTERVAL 1 DAY, ts)::TIMESTAMP AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_counts(spark, sf):
    return table(spark, sf, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("day"), "event_type", "n")


@register("SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) <= 15")
def stratified_sample(spark, sf):
    """15 documents of each language, by a hash."""
    return stats.stratified(table(spark, sf, "documents").select("doc_id", "lang", "source"), "lang", "doc_id", 15)


@register("""WITH a AS (SELECT o_orderkey, o_custkey, o_orderdate, list(DISTINCT l_partkey) AS parts FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2, 3),
b AS (SELECT o_orderkey, parts, lag(parts) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM a)
SELECT o_orderkey, len(list_intersect(parts, before))::INT AS shared, CASE WHEN len(list_intersect(parts, before)) > 0 THEN 'fix_on_stack' ELSE 'fix_off_stack' END AS overlap FROM b WHERE before IS NOT NULL""")
def fix_on_off_stack(spark, sf):
    parts = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_partkey").alias("parts"))
    a = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate").join(parts, "o_orderkey")
    b = a.withColumn("before", F.lag("parts").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))).where(F.col("before").isNotNull())
    shared = F.size(F.array_intersect("parts", "before"))
    return b.select("o_orderkey", shared.alias("shared"), F.when(shared > 0, "fix_on_stack").otherwise("fix_off_stack").alias("overlap"))
