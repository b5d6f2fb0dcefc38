"""Cleansing and standardisation."""

from pyspark.sql import DataFrame, functions as F

from assay.checks.registry import Tables, query
from assay.checks.rules import dated
from assay.functions import columns as fx, patterns
from assay.operators import clean, deid, matching, profile, rules as R


def day(c: str):
    return F.date_format(c, "yyyy-MM-dd")


@query("e1_impute_group_mean", """
SELECT o_orderkey, o_totalprice IS NULL AS o_totalprice_imputed,
       coalesce(o_totalprice, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER g AS DOUBLE) / count(o_totalprice) OVER g) AS o_totalprice
FROM {orders_dirty} WINDOW g AS (PARTITION BY o_orderpriority)
""")
def impute_group(t: Tables) -> DataFrame:
    return clean.impute(t.orders_dirty, {"o_totalprice": ("group_mean", "o_orderpriority")}, scale=2).select(
        "o_orderkey", "o_totalprice_imputed", "o_totalprice")


@query("e1_impute_mode_median", """
WITH c AS (SELECT * FROM {customer_dirty}),
     m AS (SELECT c_nationkey FROM c WHERE c_nationkey IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
     o AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) AS rn, count(*) OVER () AS n FROM {orders_dirty} WHERE o_totalprice IS NOT NULL)
SELECT 'c_nationkey' AS col, count(*) FILTER (c_nationkey IS NULL) AS imputed, CAST((SELECT c_nationkey FROM m) AS DOUBLE) AS value FROM c
UNION ALL SELECT 'o_totalprice', (SELECT count(*) FROM {orders_dirty} WHERE o_totalprice IS NULL), (SELECT v FROM o WHERE rn = ceil(CAST(0.5 AS DOUBLE) * n))
""")
def impute_global(t: Tables) -> DataFrame:
    a = clean.impute(t.customer_dirty, {"c_nationkey": ("mode",)}).where("c_nationkey_imputed").agg(
        F.lit("c_nationkey").alias("col"), F.count(F.lit(1)).alias("imputed"), F.max("c_nationkey").cast("double").alias("value"))
    b = clean.impute(t.orders_dirty, {"o_totalprice": ("median",)}).where("o_totalprice_imputed").agg(
        F.lit("o_totalprice").alias("col"), F.count(F.lit(1)).alias("imputed"), F.max("o_totalprice").alias("value"))
    return a.unionByName(b)


LATEST = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@query("e2_dedupe_latest", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(c + ' DESC' for c in LATEST)}) AS rn FROM lineitem) WHERE rn = 1
""")
def dedupe(t: Tables) -> DataFrame:
    kept = clean.dedupe(t.lineitem, ["l_orderkey", "l_linenumber"], [F.col(c).desc() for c in LATEST])
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", day("l_shipdate").alias("l_shipdate"))


@query("e3_dedupe_normalised_text", """
SELECT min(doc_id) AS doc_id FROM documents GROUP BY trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))
""")
def dedupe_text(t: Tables) -> DataFrame:
    return clean.dedupe_on(t.documents, {"h": F.sha2(fx.match_text("text"), 256)}, ["doc_id"]).select("doc_id")


@query("e3_composite_key", """
SELECT c_custkey, c_name FROM (SELECT *, row_number() OVER (PARTITION BY lower(c_name), c_acctbal ORDER BY c_custkey) AS rn FROM {customer_dirty}) WHERE rn = 1
""")
def dedupe_composite(t: Tables) -> DataFrame:
    return clean.dedupe_on(t.customer_dirty, {"name": F.lower("c_name"), "balance": F.col("c_acctbal")}, ["c_custkey"]).select("c_custkey", "c_name")


@query("e4_entity_matching", """
WITH RECURSIVE p AS (SELECT p_partkey AS id, p_name, p_brand, p_type FROM part),
e AS (SELECT a.id AS src, b.id AS dst FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND levenshtein(a.p_name, b.p_name) <= 1),
cc(id, entity) USING KEY (id) AS (
  SELECT id, id FROM p
  UNION
  SELECT e.dst, min(cc.entity) FROM cc JOIN e ON cc.id = e.src JOIN recurring.cc AS r ON r.id = e.dst WHERE cc.entity < r.entity GROUP BY e.dst)
SELECT id AS p_partkey, entity FROM cc
""")
def entities(t: Tables) -> DataFrame:
    return matching.match_entities(t.part.select("p_partkey", "p_name", "p_brand", "p_type"), "p_partkey",
                                   {"p_name": 4, "p_brand": 3, "p_type": 3}, 10, fuzzy="p_name", d=1)


# Records of which some are a second entry of the same part: other key, one field changed or lost.
ENTERED = """
SELECT p_partkey AS id, p_name, p_brand, p_type, p_size, p_retailprice FROM part
UNION ALL SELECT p_partkey + 1000000, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_name END, CASE WHEN p_partkey % 9 = 3 THEN 'Brand#99' ELSE p_brand END, p_type,
       CASE WHEN p_partkey % 9 = 6 THEN p_size + 1 ELSE p_size END, p_retailprice FROM part WHERE p_partkey % 3 = 0
"""
AGREE = ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


@query("e4_agreement_patterns", f"""
WITH r AS ({ENTERED}) SELECT {' + '.join(f"CASE WHEN a.{f} = b.{f} THEN {1 << i} ELSE 0 END" for i, f in enumerate(AGREE))} AS pattern, count(*) AS pairs
FROM r a JOIN r b ON a.id < b.id GROUP BY 1
""")
def agreement_patterns(t: Tables) -> DataFrame:
    return matching.agreement_patterns(t.sql(ENTERED, part=t.part), AGREE)


@query("e4_learnt_matching", "SELECT count(*) AS records, true AS precise, true AS complete FROM (" + ENTERED + ") x")
def learnt_matching(t: Tables) -> DataFrame:
    """Entities by learnt weights, judged by the planted second entries: of 20 joined pairs at least 19 are true, of 20 true ones at least 19 are joined."""
    records = t.sql(ENTERED, part=t.part)
    found, _ = matching.match_learnt(records, "id", AGREE)
    truth = F.col("id") % 1_000_000
    named = found.withColumn("truth", truth)
    # pairs from counts: joined and true, joined, true
    pairs = lambda by, out: named.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).select(F.lit(out).alias("what"), (F.col("n") * (F.col("n") - 1) / 2).alias("pairs"), F.lit(0).alias("records"))
    lines = pairs(["entity", "truth"], "both").unionByName(pairs(["entity"], "joined")).unionByName(pairs(["truth"], "true")).unionByName(
        records.groupBy().agg(F.count(F.lit(1)).cast("int").alias("records")).select(F.lit("all").alias("what"), F.lit(0.0).alias("pairs"), "records"))
    of = lambda what: F.sum(F.when(F.col("what") == what, F.col("pairs")).otherwise(0))
    return lines.agg(F.sum("records").alias("records"), (of("both") >= 0.95 * of("joined")).alias("precise"), (of("both") >= 0.95 * of("true")).alias("complete"))


@query("e5_scd2_history", """
WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus, lag(o_orderstatus) OVER w AS before FROM orders
           WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
     c AS (SELECT * FROM o WHERE before IS NULL OR before <> o_orderstatus)
SELECT o_custkey, o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS valid_from,
       coalesce(strftime(lead(o_orderdate) OVER w, '%Y-%m-%d'), 'open') AS valid_to, lead(o_orderdate) OVER w IS NULL AS is_current
FROM c WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
""")
def scd2(t: Tables) -> DataFrame:
    h = clean.scd2_history(t.orders, "o_custkey", "o_orderdate", ["o_orderstatus"], ["o_orderkey"])
    return h.select("o_custkey", "o_orderkey", "o_orderstatus", day("valid_from").alias("valid_from"),
                    F.coalesce(day("valid_to"), F.lit("open")).alias("valid_to"), "is_current")


@query("e5_scd2_merge", """
SELECT c_custkey, c_nationkey, '2020-01-01' AS valid_from,
       CASE WHEN c_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN '2024-01-01' ELSE 'open' END AS valid_to,
       c_acctbal >= 0 AS is_current FROM customer
UNION ALL SELECT c_custkey, c_nationkey + 100, '2024-01-01', 'open', true FROM customer WHERE c_acctbal < 0
""")
def scd2_merge(t: Tables) -> DataFrame:
    dim = t.customer.select("c_custkey", "c_nationkey", F.lit("2020-01-01").cast("date").alias("valid_from"),
                            F.lit(None).cast("date").alias("valid_to"), F.lit(True).alias("is_current"))
    batch = t.customer.select("c_custkey", F.when(F.col("c_acctbal") < 0, F.col("c_nationkey") + 100).otherwise(F.col("c_nationkey")).alias("c_nationkey"),
                              F.lit("2024-01-01").cast("date").alias("ts"))
    once = clean.scd2_merge(dim, batch, "c_custkey", ["c_nationkey"], "ts")
    twice = clean.scd2_merge(once, batch, "c_custkey", ["c_nationkey"], "ts")  # repeating the batch changes nothing
    return twice.select("c_custkey", "c_nationkey", F.col("valid_from").cast("string").alias("valid_from"),
                        F.coalesce(F.col("valid_to").cast("string"), F.lit("open")).alias("valid_to"), "is_current")


@query("e6_typed_from_text", """
SELECT event_id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k, value, strftime(ts, '%Y-%m-%d') AS day FROM events
""")
def typed(t: Tables) -> DataFrame:
    from pyspark.sql.types import StructType
    from assay.sources.layers import split_dead_letter
    raw = t.events.select(F.col("event_id").cast("string").alias("event_id"), F.get_json_object("props", "$.k").alias("k"),
                          F.col("value").cast("string").alias("value"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))
    good, _ = split_dead_letter(raw, StructType.fromDDL("event_id bigint, k bigint, value double, ts timestamp"),
                                {"ts": "yyyy-MM-dd HH:mm:ss"})
    return good.select("event_id", "k", "value", day("ts").alias("day"))


@query("e7_clean_email", f"""
SELECT doc_id, lower(trim(value)) AS email, regexp_matches(lower(trim(value)), '{patterns.EMAIL_WHOLE}') AS valid, count(*) AS n
FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{patterns.EMAIL}', 0)) AS value FROM documents) GROUP BY ALL
""")
def emails(t: Tables) -> DataFrame:
    found = profile.extract_sensitive(t.documents, "doc_id", "text", {"email": patterns.EMAIL})
    return found.withColumn("email", fx.clean_email("value")).groupBy("doc_id", "email", fx.valid_email("email").alias("valid")).agg(F.sum("n").alias("n"))


@query("e8_phone_e164", """
SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN '+44' || lpad(CAST(c_custkey AS VARCHAR), 10, '2')
                       WHEN c_nationkey < 20 THEN '+1' || lpad(CAST(c_custkey AS VARCHAR), 10, '2') ELSE 'none' END AS phone FROM customer
""")
def phones(t: Tables) -> DataFrame:
    ten = F.lpad(F.col("c_custkey").cast("string"), 10, "2")
    raw = (F.when(F.col("c_nationkey") < 5, F.concat(F.lit(" +44 "), ten))
           .when(F.col("c_nationkey") < 10, F.format_string("(%s) %s-%s", F.substring(ten, 1, 3), F.substring(ten, 4, 3), F.substring(ten, 7, 4)))
           .when(F.col("c_nationkey") < 20, F.concat(F.lit("1-"), ten)).otherwise(F.substring(ten, 1, 7)))
    return t.customer.select("c_custkey", F.coalesce(fx.e164(raw), F.lit("none")).alias("phone"))


@query("e9_standard_names", """
SELECT p_partkey, list_aggregate(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') AS name,
       upper(replace(p_brand, ' ', '')) AS code FROM part
""")
def names(t: Tables) -> DataFrame:
    messy = F.concat(F.lit("  "), F.upper(F.regexp_replace("p_name", " ", "   ")))
    return t.part.select("p_partkey", fx.std_name(messy).alias("name"), fx.std_code(F.lower("p_brand")).alias("code"))


@query("e10_standard_dates", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS order_day, o_orderdate::DATE > DATE '2001-01-01' AS future FROM orders
""")
def std_dates(t: Tables) -> DataFrame:
    text = (F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "dd/MM/yyyy"))
            .when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")))
    std = t.orders.select("o_orderkey", fx.std_date(text, ["yyyy-MM-dd", "dd/MM/yyyy", "yyyyMMdd"]).alias("d"))
    return std.select("o_orderkey", F.col("d").cast("string").alias("order_day"), fx.is_future("d", "2001-01-01").alias("future"))


@query("e11_fill_from_reference", """
SELECT d.c_custkey, coalesce(d.c_nationkey, c.c_nationkey) AS c_nationkey FROM {customer_dirty} d LEFT JOIN customer c USING (c_custkey)
""")
def fill(t: Tables) -> DataFrame:
    return clean.fill_from(t.customer_dirty, t.customer, ["c_custkey"], ["c_nationkey"]).select("c_custkey", "c_nationkey")


@query("e12_dormancy", """
SELECT c_custkey, coalesce(date_diff('day', last, DATE '2001-08-02'), -1) AS idle_days,
       coalesce(date_diff('day', last, DATE '2001-08-02') > 365, false) AS dormant,
       coalesce(date_diff('day', last, DATE '2001-08-02') > 365, false) AND c_acctbal >= 0 AS unflagged
FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate)::DATE AS last FROM orders GROUP BY 1) ON o_custkey = c_custkey
""")
def dormant(t: Tables) -> DataFrame:
    last = t.orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    joined = t.customer.join(last, F.col("o_custkey") == F.col("c_custkey"), "left").withColumn("flag", F.col("c_acctbal") < 0)
    return clean.dormancy(joined, "last", "flag", "2001-08-02").select(
        "c_custkey", F.coalesce("idle_days", F.lit(-1)).alias("idle_days"), "dormant", "unflagged")


RECONCILE = """
SELECT coalesce(o_orderkey, k) AS account, CAST(coalesce(o_totalprice, 0) - coalesce(s, 0) AS DOUBLE) AS difference,
       CASE WHEN o_orderkey IS NULL THEN 'no_account' WHEN s IS NULL THEN 'no_ledger'
            WHEN abs(coalesce(o_totalprice, 0) - s) > 0.005 THEN 'mismatch' ELSE 'ok' END AS outcome
FROM (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS o_totalprice FROM orders)
FULL JOIN (SELECT l_orderkey AS k, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS s FROM lineitem GROUP BY 1) ON o_orderkey = k
"""


def reconciled(t: Tables) -> DataFrame:
    return clean.reconcile(t.orders, "o_orderkey", "o_totalprice", t.lineitem, "l_orderkey", F.col("l_extendedprice").cast("decimal(18,2)"))


@query("e13_reconcile_balances", RECONCILE)
def reconcile(t: Tables) -> DataFrame:
    return reconciled(t).select("account", F.col("difference").cast("double").alias("difference"), "outcome")


@query("f17_balance_integrity", f"SELECT 'orders' AS table_name, count(*) AS rows, count(*) FILTER (outcome <> 'ok') AS failed FROM ({RECONCILE})")
def balance_rule(t: Tables) -> DataFrame:
    return R.run_rules(reconciled(t), "orders", [R.Row("balance_integrity", F.col("outcome") == "ok")]).select("table_name", "rows", "failed")


@query("e14_orphans", "SELECT doc_id, doc_id NOT IN (SELECT doc_id FROM labels) AS orphan FROM documents")
def orphans(t: Tables) -> DataFrame:
    linked, alone = clean.split_orphans(t.documents, t.labels, "doc_id", "doc_id")
    return linked.select("doc_id", F.lit(False).alias("orphan")).unionByName(alone.select("doc_id", F.lit(True).alias("orphan")))


@query("e15_map_codes", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '0210' WHEN 'O' THEN '0200' WHEN 'P' THEN '0220' ELSE '0000' END AS iso,
       coalesce(CAST(rank AS VARCHAR), 'none') AS priority_rank
FROM {orders_dirty} LEFT JOIN (SELECT o_orderpriority AS p, row_number() OVER (ORDER BY o_orderpriority) AS rank FROM (SELECT DISTINCT o_orderpriority FROM orders)) ON p = o_orderpriority
""")
def codes(t: Tables) -> DataFrame:
    mapped = clean.map_codes(t.orders_dirty, "o_orderstatus", {"F": "0210", "O": "0200", "P": "0220"}, "iso", "0000")
    table = t.orders.select(F.col("o_orderpriority").alias("code")).distinct().withColumn("target", F.substring("code", 1, 1))
    return clean.map_codes(mapped, "o_orderpriority", table, "priority_rank", "none").select("o_orderkey", "iso", "priority_rank")


@query("e16_expired_cards", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND last_day(o_orderdate::DATE) < DATE '1999-06-15' THEN 'EXPIRED'
                        WHEN o_orderstatus = 'O' THEN 'ACTIVE' ELSE 'CLOSED' END AS status FROM orders
""")
def expired(t: Tables) -> DataFrame:
    cards = t.orders.select("o_orderkey", F.date_format("o_orderdate", "MM/yyyy").alias("expiry_date"),
                            F.when(F.col("o_orderstatus") == "O", "ACTIVE").otherwise("CLOSED").alias("status"))
    return clean.expire_cards(cards, "1999-06-15").select("o_orderkey", "status")


@query("e17_code_correction", """
WITH raw AS (SELECT p_partkey, p_brand, CASE WHEN p_size < 10 THEN lower(p_brand) WHEN p_size < 20 THEN replace(p_brand, 'Brand', 'Brnd')
                    WHEN p_size < 25 THEN 'UNKNOWN-X' ELSE upper(p_brand) END AS code FROM part),
     valid AS (SELECT DISTINCT upper(p_brand) AS v FROM part),
     best AS (SELECT code, min((levenshtein(upper(code), v), v)) AS b FROM (SELECT DISTINCT code FROM raw) JOIN valid ON levenshtein(upper(code), v) <= 1 GROUP BY 1)
SELECT p_partkey, coalesce(b[2], 'none') AS code_corrected,
       CASE WHEN b IS NULL THEN 'unknown' WHEN b[2] = code THEN 'valid' ELSE 'repaired' END AS code_outcome
FROM raw LEFT JOIN best USING (code)
""")
def correct(t: Tables) -> DataFrame:
    raw = t.part.select("p_partkey", F.when(F.col("p_size") < 10, F.lower("p_brand")).when(F.col("p_size") < 20, F.regexp_replace("p_brand", "Brand", "Brnd"))
                        .when(F.col("p_size") < 25, "UNKNOWN-X").otherwise(F.upper("p_brand")).alias("code"))
    valid = t.part.select(F.upper("p_brand").alias("v")).distinct()
    return matching.correct_codes(raw, "code", valid, "v").select(
        "p_partkey", F.coalesce("code_corrected", F.lit("none")).alias("code_corrected"), "code_outcome")


@query("e18_tokenise", "SELECT c_custkey, sha256('sample-key' || c_name) AS c_name_token, right(c_name, 4) AS c_name_last4 FROM {customer_dirty}")
def tokenised(t: Tables) -> DataFrame:
    return deid.tokenise(t.customer_dirty, "c_name", "sample-key")[0].select("c_custkey", "c_name_token", "c_name_last4")


@query("d4_token_vault", "SELECT DISTINCT sha256('sample-key' || c_name) AS token, sha256(c_name) AS value_hash FROM {customer_dirty}")
def vault(t: Tables) -> DataFrame:
    return deid.tokenise(t.customer_dirty, "c_name", "sample-key")[1]


@query("e19_loan_to_value", """
WITH a AS (SELECT l_partkey, max((l_shipdate, l_extendedprice))[2] AS v FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-01-01' GROUP BY 1)
SELECT p_partkey AS loan_id, round(p_retailprice / coalesce(v, 2000.0) * 100, 2) AS ltv FROM part LEFT JOIN a ON l_partkey = p_partkey
""")
def ltv(t: Tables) -> DataFrame:
    loans = t.part.select(F.col("p_partkey").alias("loan_id"), F.col("p_retailprice").alias("outstanding_balance"), F.lit(2000.0).alias("collateral_value"))
    seen = t.lineitem.select(F.col("l_partkey").alias("loan_id"), F.col("l_shipdate").alias("appraised_on"), F.col("l_extendedprice").alias("value"))
    return clean.ltv(loans, seen, "2000-01-01").select("loan_id", F.col("ltv_current").alias("ltv"))


@query("e20_delinquency", """
WITH d AS (SELECT greatest(date_diff('day', o_orderdate::DATE, l_shipdate::DATE), 0) AS days FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT CASE WHEN days = 0 THEN 'CURRENT' WHEN days < 30 THEN '1-29' WHEN days < 60 THEN '30-59' WHEN days < 90 THEN '60-89' ELSE '90+' END AS bucket,
       count(*) AS n, CAST(sum(days) AS BIGINT) AS days FROM d GROUP BY 1
""")
def delinquent(t: Tables) -> DataFrame:
    return clean.delinquency(dated(t), "o_orderdate", "l_shipdate").groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.sum("days_past_due").alias("days"))


@query("e21_outliers", """
WITH g AS (SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS m,
             CAST(sum(CAST(l_extendedprice AS DECIMAL(16,2)) * CAST(l_extendedprice AS DECIMAL(16,2))) AS DOUBLE) / count(*) AS q FROM lineitem GROUP BY 1)
SELECT l_returnflag, count(*) AS rows, count(*) FILTER (abs(l_extendedprice - m) > 1.6::DOUBLE * sqrt(greatest(q - m * m, 0))) AS outliers
FROM lineitem JOIN g USING (l_returnflag) GROUP BY 1
""")
def outliers(t: Tables) -> DataFrame:
    return clean.outliers(t.lineitem, "l_extendedprice", ["l_returnflag"], 1.6, scale=2).groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("outlier").alias("outliers"))


@query("e22_sla_breach", """
SELECT o_orderpriority, count(*) AS rows, count(*) FILTER (date_diff('day', o_orderdate::DATE, l_shipdate::DATE) > 30) AS breaches
FROM lineitem JOIN (SELECT o_orderkey, o_orderdate, o_orderpriority FROM orders) ON o_orderkey = l_orderkey GROUP BY 1
""")
def sla(t: Tables) -> DataFrame:
    joined = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    return clean.sla_breach(joined, "o_orderdate", "l_shipdate", 30).groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("breach").alias("breaches"))


@query("e23_rule_score", """
SELECT event_id, least(CASE WHEN event_type = 'error' THEN 40 ELSE 0 END + CASE WHEN value > 50 THEN 30 ELSE 0 END
  + CASE WHEN hour(ts) < 6 THEN 45 ELSE 0 END, 100) AS rule_score,
  concat_ws(',', CASE WHEN event_type = 'error' THEN 'error=40' END, CASE WHEN value > 50 THEN 'large=30' END, CASE WHEN hour(ts) < 6 THEN 'night=45' END) AS parts
FROM events
""")
def rule_score(t: Tables) -> DataFrame:
    scored = clean.impute_score(t.events, [("error", F.col("event_type") == "error", 40), ("large", F.col("value") > 50, 30),
                                           ("night", F.hour(F.col("ts")) < 6, 45)])
    return scored.select("event_id", "rule_score", F.array_join("score_parts", ",").alias("parts"))


@query("e24_narrative_words", """
WITH w AS (SELECT doc_id, CASE WHEN s = '' THEN 0 ELSE len(string_split(s, ' ')) END AS words
           FROM (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')) AS s FROM documents))
SELECT doc_id, words, words < 50 AS too_short FROM w
""")
def narrative(t: Tables) -> DataFrame:
    return clean.narrative_check(t.documents, "text", 50).select("doc_id", "words", "too_short")


@query("e25_closed_with_activity", """
SELECT c_custkey, count(*) AS activity FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment IN ('MACHINERY', 'FURNITURE') GROUP BY 1
""")
def closed(t: Tables) -> DataFrame:
    return clean.activity_on_closed(t.customer, "c_custkey", "c_mktsegment", t.orders, "o_custkey", ["MACHINERY", "FURNITURE"]).select("c_custkey", "activity")


@query("e26_expiring", """
SELECT alert, count(*) AS n FROM (SELECT date_diff('day', DATE '2000-01-01', o_orderdate::DATE) AS d,
  CASE WHEN d < 0 THEN 'EXPIRED' WHEN d <= 90 THEN 'EXPIRING' ELSE 'VALID' END AS alert FROM orders) GROUP BY 1
""")
def expiring(t: Tables) -> DataFrame:
    return clean.expiring(t.orders, "o_orderdate", "2000-01-01", 90).groupBy("alert").agg(F.count(F.lit(1)).alias("n"))


@query("e27_address_mismatch", """
SELECT s_suppkey, levenshtein('12 N ' || upper(replace(s_name, '#', ' ')) || ' ST', CASE WHEN s_acctbal < 1000 THEN '12 S ' ELSE '12 N ' END || upper(replace(s_name, '#', ' ')) || ' ST') AS distance,
       s_acctbal < 1000 AS mismatch FROM supplier
""")
def addresses(t: Tables) -> DataFrame:
    ours = t.supplier.select("s_suppkey", F.concat(F.lit("12 North "), "s_name", F.lit(" Street")).alias("address"))
    filed = t.supplier.select("s_suppkey", F.concat(F.when(F.col("s_acctbal") < 1000, "12  south ").otherwise("12, N. "), "s_name", F.lit(" st.")).alias("filed"))
    return clean.address_diff(ours, "s_suppkey", "address", filed, "filed").select("s_suppkey", "distance", "mismatch")


def scrub_sql(col: str) -> str:
    for p, label, _ in deid.FREE_TEXT:
        col = f"regexp_replace({col}, '{p}', '{label}', 'g')"
    return col


@query("e28_safe_harbor_documents", f"SELECT doc_id, md5({scrub_sql('text')}) AS digest, length({scrub_sql('text')}) AS n FROM documents")
def scrubbed(t: Tables) -> DataFrame:
    masked = deid.safe_harbor(t.documents, {"text": "text"})
    return masked.select("doc_id", F.md5("text").alias("digest"), F.length("text").alias("n"))


@query("e28_safe_harbor_customer", """
SELECT regexp_replace(regexp_replace(regexp_replace(c_name, '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'), '[0-9]', 'n', 'g') AS c_name,
       sha256('sample-key' || CAST(c_custkey AS VARCHAR)) AS c_custkey, c_mktsegment FROM customer
""")
def masked_customer(t: Tables) -> DataFrame:
    return deid.safe_harbor(t.customer, {"c_name": "mask", "c_custkey": "hash", "c_nationkey": "drop", "c_acctbal": "drop"}, key="sample-key")


@query("e29_shift_dates", """
SELECT o_orderkey, strftime(o_orderdate::DATE + CAST(('0x' || substr(md5('secret|' || o_custkey), 1, 8))::BIGINT % 365 + 1 AS INTEGER), '%Y-%m-%d') AS o_orderdate FROM orders
""")
def shifted(t: Tables) -> DataFrame:
    return deid.shift_dates(t.orders, ["o_orderdate"], fx.key_days("o_custkey", "secret")).select("o_orderkey", F.col("o_orderdate").cast("string").alias("o_orderdate"))


@query("e29_rare_to_year", """
SELECT event_id, CASE WHEN n < 70 THEN strftime(ts, '%Y-01-01') ELSE strftime(ts, '%Y-%m-%d') END AS ts
FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM events)
""")
def rare(t: Tables) -> DataFrame:
    return deid.rare_to_year(t.events, "user_id", ["ts"], 70).select("event_id", F.col("ts").cast("string").alias("ts"))


@query("e30_zip3", """
SELECT zip, count(*) AS n FROM (SELECT CASE WHEN substr(lpad(CAST(o_orderkey AS VARCHAR), 5, '0'), 1, 3) IN ('003', '017', '102') THEN '000'
  ELSE substr(lpad(CAST(o_orderkey AS VARCHAR), 5, '0'), 1, 3) END AS zip FROM orders) GROUP BY 1
""")
def zips(t: Tables) -> DataFrame:
    zips = t.orders.select(fx.zip3(F.lpad(F.col("o_orderkey").cast("string"), 5, "0"), ["003", "017", "102"]).alias("zip"))
    return zips.groupBy("zip").agg(F.count(F.lit(1)).alias("n"))


@query("e31_age_bands", """
WITH a AS (SELECT date_sub('month', o_orderdate::DATE, DATE '2088-03-15') // 12 AS age FROM orders)
SELECT CASE WHEN age >= 90 THEN '90+' ELSE (age // 10 * 10) || '-' || (age // 10 * 10 + 9) END AS band, count(*) AS n FROM a GROUP BY 1
""")
def ages(t: Tables) -> DataFrame:
    return t.orders.groupBy(fx.age_band("o_orderdate", "2088-03-15").alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("e32_fix_date_pairs", """
SELECT l_returnflag, count(*) AS rows, count(*) FILTER (l_shipdate < o_orderdate) AS inverted,
       count(*) FILTER (l_shipdate >= o_orderdate) AS ends_kept, CAST(sum(abs(date_diff('day', o_orderdate::DATE, l_shipdate::DATE))) AS BIGINT) AS days_when_swapped
FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1
""")
def date_pairs(t: Tables) -> DataFrame:
    nulled = clean.fix_date_pair(dated(t), "o_orderdate", "l_shipdate").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("inverted").alias("inverted"), F.count("l_shipdate").alias("ends_kept"))
    swapped = clean.fix_date_pair(dated(t), "o_orderdate", "l_shipdate", "swap").groupBy("l_returnflag").agg(
        F.sum(F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date"))).alias("days_when_swapped"))
    return nulled.join(swapped, "l_returnflag")


@query("e33_compare_to_parent", """
SELECT p_brand, count(*) AS rows, count(*) FILTER (l_extendedprice > l_quantity * p_retailprice) AS breaches
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1
""")
def overage(t: Tables) -> DataFrame:
    side = t.part.select("p_partkey", "p_brand", "p_retailprice")
    return clean.compare_to_parent(t.lineitem, "l_partkey", side, "p_partkey", F.col("l_extendedprice") > F.col("l_quantity") * F.col("p_retailprice")).groupBy(
        "p_brand").agg(F.count(F.lit(1)).alias("rows"), F.count_if("breach").alias("breaches"))


@query("e34_repair_counts", "SELECT count(*) AS p_brand, count(*) FILTER (p_type <> upper(p_type)) AS p_type, count(*) AS p_name FROM part")
def repairs(t: Tables) -> DataFrame:
    fixed = clean.repaired(t.part, {"p_brand": fx.std_code("p_brand"), "p_type": fx.std_code("p_type"), "p_name": fx.std_name("p_name")})
    return clean.repair_counts(fixed, ["p_brand", "p_type", "p_name"])


@query("e35_promotion", """
WITH s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS rn FROM lineitem) WHERE rn = 1),
     n AS (SELECT (SELECT count(*) FROM lineitem) AS rows_in, count(*) FILTER (l_quantity <= 45) AS rows_out, count(*) FILTER (l_quantity > 45) AS quarantined FROM s)
SELECT rows_in, rows_out, rows_in - rows_out - quarantined AS removed, quarantined, true AS balanced FROM n
""")
def promotion(t: Tables) -> DataFrame:
    return clean.promote(t.lineitem, ["l_orderkey", "l_linenumber"],
                         [F.col("l_shipdate").desc(), "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"],
                         [R.range_rule("l_quantity", hi=45)])[2]


@query("e36_derived_consistency", "SELECT doc_id, n_chars <> length(text) AS n_chars_inconsistent FROM documents")
def derived(t: Tables) -> DataFrame:
    return clean.check_derived(t.documents, "n_chars", F.length("text")).select("doc_id", "n_chars_inconsistent")
