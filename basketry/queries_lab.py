"""Registered queries that complete those of ``queries``: join and rank variants, rules under review, runs, layouts, models, samples, late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import columns as C
from .operators import audits, profile, rank, rules, sample, skew
from .plans import features, model
from .queries import MODEL_FEATURES, _AP, _DRAWN, _ERRORS, _LATE, _ORDER, _SKEWED, _SPLIT, _event_stream, _run_log, conformed, drawn, flags, md5_number, query, skewed, sum_of
from .sources import ingest, tables
from .streaming import flows, live

# ---------------------------------------------------------------- joins and aggregates under skew
_ON_WEEK = "JOIN flags f ON d.product_id = f.product_id AND d.supplier_id = f.store_id AND d.week_no = f.week_no"
_BY_STORE = f"SELECT d.supplier_id, count(*) AS lines, count(*) FILTER (on_display) AS displayed, {sum_of('sales_amt', 2)} AS revenue FROM deliveries d {_ON_WEEK} GROUP BY d.supplier_id"


def _promoted(spark: SparkSession, root: str, hint: str | None = None) -> DataFrame:
    promo = flags(spark, root).withColumnRenamed("store_id", "supplier_id")
    joined = tables.deliveries(spark, root).join(promo.hint(hint) if hint else promo, ["product_id", "supplier_id", "week_no"])
    return joined.groupBy("supplier_id").agg(F.count("*").alias("lines"), F.count(F.when(F.col("on_display"), 1)).alias("displayed"), C.money_sum("sales_amt", 2).alias("revenue"))


@query("promo", _BY_STORE)
def composite_join(spark, root):
    """Inner join on product, store and week, then totals of a store: the baseline of the join variants."""
    return _promoted(spark, root)


@query("promo", _BY_STORE)
def composite_merge_join(spark, root):
    return _promoted(spark, root, "merge")


@query("promo", f"SELECT s.supplier_id, lines, revenue, promo_weeks FROM (SELECT supplier_id, count(*) AS lines, {sum_of('sales_amt', 2)} AS revenue FROM deliveries GROUP BY 1) s JOIN (SELECT store_id, count(DISTINCT week_no) AS promo_weeks FROM flags GROUP BY 1) p ON s.supplier_id = p.store_id")
def summary_merge_join(spark, root):
    """Two summaries of a store, joined by a forced sort-merge."""
    own = tables.deliveries(spark, root).groupBy("supplier_id").agg(F.count("*").alias("lines"), C.money_sum("sales_amt", 2).alias("revenue"))
    weeks = flags(spark, root).groupBy(F.col("store_id").alias("supplier_id")).agg(F.countDistinct("week_no").alias("promo_weeks"))
    return skew.merge_join(own, weeks, ["supplier_id"])


@query(None, f"SELECT hot, count(*) AS rows, {sum_of('l_extendedprice', 2)} AS amount, count(DISTINCT l_partkey) AS distinct_values FROM {_SKEWED} GROUP BY hot")
def plain_distinct(spark, root):
    return skew.plain_agg(skewed(spark, root), "hot", "l_partkey", "l_extendedprice")


_KEYED = f"(SELECT *, l_orderkey % (SELECT count(DISTINCT hot) FROM {_SKEWED}) AS even FROM {_SKEWED})"


@query(None, "\nUNION ALL ".join(f"SELECT '{kind}' AS key_kind, count(*) AS groups, sum(r)::BIGINT AS rows, max(r) AS max_rows, CAST(sum(a) AS DOUBLE) AS amount FROM (SELECT count(*) AS r, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS a FROM {_KEYED} GROUP BY {key})" for kind, key in (("even", "even"), ("skewed", "hot"))))
def volume_matched(spark, root):
    return skew.volume_matched(skewed(spark, root), "l_orderkey", "hot", "l_extendedprice")


# ---------------------------------------------------------------- ranks
def _rank_at_width(width: int):
    def ranked(spark, root):
        lines = tables.table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").withColumn("wide", rank.padded_key("l_orderkey", width))
        return rank.distributed_row_number(lines, ["wide", "l_linenumber", "l_partkey", "l_suppkey"]).drop("wide")

    ranked.__name__ = f"rank_wide_{width}"
    return query(None, "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_number FROM lineitem")(ranked)


rank_wide_128, rank_wide_256 = _rank_at_width(128), _rank_at_width(256)


@query(None, f"SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY {', '.join(_ORDER)}) AS row_number FROM lineitem")
def rank_repartitioned(spark, root):
    """Ranks of a store's lines after they are dealt by the key into as many partitions as are named; the window takes the dealing over."""
    lines = tables.table(spark, root, "lineitem").repartition(32, "l_suppkey")
    return lines.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*_ORDER)).alias("row_number"))


_WIDE = "product_id, store_id, event_id, p_name, p_type, sales_amt, quantity_raw, row_number() OVER (PARTITION BY product_id, store_id ORDER BY transaction_ts DESC, event_id, sales_amt, quantity_raw) AS row_number"


@query("deliveries", f"SELECT {_WIDE} FROM deliveries JOIN part ON product_id = p_partkey")
def rank_joined(spark, root):
    """Ranks within product and store over a row that a join has made wide."""
    own = Window.partitionBy("product_id", "store_id").orderBy(F.desc("transaction_ts"), "event_id", "sales_amt", "quantity_raw")
    wide = tables.deliveries(spark, root).join(tables.table(spark, root, "part"), F.col("product_id") == F.col("p_partkey"))
    return wide.select("product_id", "store_id", "event_id", "p_name", "p_type", "sales_amt", "quantity_raw", F.row_number().over(own).alias("row_number"))


@query(None, "SELECT count(*) AS rows, 32::BIGINT AS most_partitions, 0::BIGINT AS split_keys FROM lineitem")
def repartition_by_key(spark, root):
    """Rows dealt by named columns into 32 partitions: no key may stand in two of them."""
    dealt = tables.table(spark, root, "lineitem").repartition(32, "l_partkey", "l_suppkey").select("l_partkey", "l_suppkey", F.spark_partition_id().alias("p"))
    per = dealt.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"), F.min("p").alias("a"), F.max("p").alias("b"))
    return per.agg(F.sum("n").alias("rows"), F.when(F.max("b") < 32, F.lit(32)).cast("bigint").alias("most_partitions"), F.count(F.when(F.col("a") != F.col("b"), 1)).alias("split_keys"))


# ---------------------------------------------------------------- conforming by specification
def line_spec() -> list[tuple]:
    """(name, type, expression) of a conformed line."""
    return [
        ("event_id", "string", "event_id"),
        ("basket_id", "bigint", "basket_id"),
        ("line_no", "int", "line_no"),
        ("quantity", "int", C.leading_number("quantity_raw")),
        ("quantity_format", "string", C.number_format("quantity_raw")),
        ("sales_amt", "double", C.money("sales_amt", 2)),
        ("discount_rate", "double", C.ratio(F.abs("retail_disc_amt"), "sales_amt")),
        ("sold_at", "timestamp", C.hhmm_timestamp(F.to_date("transaction_ts"), F.coalesce("trans_time", "transaction_time"))),
        ("day", "string", F.to_date("transaction_ts")),
    ]


@query("deliveries", """SELECT event_id, basket_id, line_no, quantity_parsed::INTEGER AS quantity, quantity_format, sales_amt::DECIMAL(18,2)::DOUBLE AS sales_amt, abs(retail_disc_amt) / nullif(sales_amt, 0) AS discount_rate,
  CASE WHEN transaction_time_hhmm BETWEEN 0 AND 2359 AND transaction_time_hhmm % 100 < 60 THEN CAST(transaction_ts AS DATE) + to_hours(transaction_time_hhmm // 100) + to_minutes(transaction_time_hhmm % 100) END AS sold_at, CAST(CAST(transaction_ts AS DATE) AS VARCHAR) AS day FROM conformed""")
def conform_by_spec(spark, root):
    return tables.conform(conformed(spark, root), line_spec())


@query(None, "SELECT CASE WHEN p_size % 7 = 0 OR p_size % 11 = 0 THEN 'UNKNOWN' ELSE p_brand END AS brand, count(*) AS parts FROM part GROUP BY 1")
def explicit_members(spark, root):
    """Parts by brand, blanks and nulls as a member of their own; some brands are blanked by rule."""
    brand = F.when(F.col("p_size") % 7 == 0, F.lit("  ")).when(F.col("p_size") % 11 == 0, F.lit(None).cast("string")).otherwise(F.col("p_brand"))
    return tables.table(spark, root, "part").groupBy(C.or_member(brand, "UNKNOWN").alias("brand")).agg(F.count("*").alias("parts"))


# ---------------------------------------------------------------- rules under review, runs, audits
_CANDIDATES = {"quantity_raw": "text", "store_id": "whole", "sales_amt": "real", "trans_time": "whole", "transaction_ts": "time"}
_VALUE = {"time": "epoch({c})", "whole": "{c}::DOUBLE", "real": "{c}"}


def _candidate_sql(c: str, kind: str) -> str:
    parts = [f"SELECT '{c}' AS column_name, 'not_null' AS kind, NULL::DOUBLE AS low, NULL::DOUBLE AS high FROM conformed HAVING count(*) = count({c})"]
    if kind == "text":
        return parts[0] + f" UNION ALL SELECT '{c}', 'not_blank', NULL, NULL FROM conformed HAVING count(*) FILTER (trim({c}) = '') = 0"
    x = _VALUE[kind].format(c=c)
    down, up = ("", "") if kind == "real" else ("floor", "ceil")
    return parts[0] + f" UNION ALL SELECT '{c}', 'range', round({down}(greatest(min({x}), avg({x}) - 3 * stddev_samp({x}))), 4), round({up}(least(max({x}), avg({x}) + 3 * stddev_samp({x}))), 4) FROM conformed"


@query("gate", "\nUNION ALL ".join(_candidate_sql(c, kind) for c, kind in _CANDIDATES.items()))
def proposed_rules(spark, root):
    out = rules.proposed_rules(conformed(spark, root), list(_CANDIDATES))
    return out.select("column_name", "kind", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


_REJECTED = "quantity_non_negative"
_ENFORCED = [n for n in _ERRORS if n not in (_REJECTED, "revenue_requires_quantity")]


@query("gate", f", kept AS (SELECT event_id, [x FOR x IN failed IF list_contains({_ENFORCED}, x)] AS failed FROM judged) SELECT failed[1] AS rule_name, count(*) AS rows FROM kept GROUP BY 1")
def reviewed_gate(spark, root):
    """The gate with what the published table says: a rejected rule and candidates without a decision are not enforced.

    ``rule_name`` null counts the valid rows.
    """
    decided = [rules.Rule(**{**vars(r), "review": "reject"}) if r.name in (_REJECTED, "revenue_requires_quantity") else r for r in rules.FACT_RULES]
    proposed = [rules.Rule("sales_amt_in_range", "fact", "sales_amt < 10", origin="profile", review="pending")]
    table = rules.publish_rules(spark, decided + proposed, f"{rank.stage_dir(spark)}/rules")
    valid, rejected = rules.gate(rank.staged(conformed(spark, root)), rules.load_rules(table, "fact", "error"))
    return valid.select(F.lit(None).cast("string").alias("rule_name")).unionByName(rejected.select("rule_name")).groupBy("rule_name").agg(F.count("*").alias("rows"))


@query("gate", f"SELECT 'fact' AS dataset, {len(_ERRORS)} AS rules, count(*) AS rejected, FALSE AS refused FROM rejected UNION ALL SELECT 'unheard_of', 0, NULL, TRUE")
def missing_rules_refused(spark, root):
    """The gate of each dataset by the published rules: one without a rule set is refused, never passed without a check."""
    table, lines, out = rules.publish_rules(spark, rules.FACT_RULES, f"{rank.stage_dir(spark)}/rules"), rank.staged(conformed(spark, root)), None
    for dataset in ("fact", "unheard_of"):
        try:
            found = rules.load_rules(table, dataset, "error")
            counts = rules.gate(lines, found)[1].agg(F.count("*").alias("rejected"))
        except ValueError:
            found, counts = [], spark.range(1).select(F.lit(None).cast("long").alias("rejected"))
        one = counts.select(F.lit(dataset).alias("dataset"), F.lit(len(found)).alias("rules"), "rejected", F.lit(not found).alias("refused"))
        out = one if out is None else out.unionByName(one)
    return out


_RUNS = "(SELECT event_type AS dataset, user_id % 3 AS update_id, user_id % 50 AS batch_id, event_id % 1000 AS passed, event_id % 7 AS failed FROM events)"
_RATED = f"SELECT dataset, update_id, sum(p)::BIGINT AS passed, sum(f)::BIGINT AS failed, sum(p) / (sum(p) + sum(f)) AS pass_rate FROM (SELECT dataset, update_id, batch_id, max(passed) AS p, max(failed) AS f FROM {_RUNS} GROUP BY ALL) GROUP BY dataset, update_id"


@query(None, f"SELECT *, 'r' || update_id AS rule_name, failed AS rule_failed FROM ({_RATED}) WHERE failed > 0")
def run_quality(spark, root):
    """Metrics of a run beside the failures of its rules."""
    joined = audits.run_quality(rank.staged(_run_log(spark, root)))
    return joined.select("dataset", "update_id", "passed", "failed", "pass_rate", F.explode("failures").alias("rule_name", "rule_failed"))


@query(None, _RATED)
def quality_series(spark, root):
    """Metrics appended run by run; the second run is reported again and replaces itself."""
    path, found = f"{rank.stage_dir(spark)}/series", rank.staged(audits.dq_metrics(_run_log(spark, root)))
    for update in (0, 1, 2, 1):
        audits.append_run(found, update, path)
    return spark.read.option("basePath", path).parquet(path).withColumn("update_id", F.col("update_id").cast("bigint"))


@query(None, "SELECT unnest(['sales_not_negative', 'discounted', 'supplied']) AS expectation, count(*) AS rows, unnest([count(*) FILTER (l_extendedprice < 0), count(*) FILTER (l_discount <= 0.05), count(*) FILTER (l_suppkey % 10 = 0)]) AS failed FROM lineitem")
def expectations(spark, root):
    """Expectations that warn, counted while the rows are written for something else; one that stops is asked of the same rows."""
    wanted = {"sales_not_negative": "l_extendedprice >= 0", "discounted": "l_discount > 0.05", "supplied": "l_suppkey % 10 <> 0"}
    observed, seen = audits.expect(tables.table(spark, root, "lineitem"), "lines", wanted)
    audits.fail_on(observed, "l_orderkey IS NOT NULL", "a line without an order").write.parquet(f"{rank.stage_dir(spark)}/out")
    counts = seen.get
    return spark.createDataFrame([(k, counts["rows"], counts[k]) for k in wanted], "expectation string, rows bigint, failed bigint")


@query("fact", "SELECT count(*) AS rows, count(*) AS rows_again, TRUE AS same FROM flags")
def rerun_is_stable(spark, root):
    """A table that is worked out in full and replaced gives the same rows when its job runs again."""
    path, outputs = rank.stage_dir(spark), []
    for n, parts in enumerate((3, 7)):
        flags(spark, root).repartition(parts).write.mode("overwrite").parquet(f"{path}/view")
        outputs.append(rank.staged(spark.read.parquet(f"{path}/view")))
    return audits.same_after_rerun(*outputs)


_TIMED = "(SELECT event_type AS variant, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS run_no, value AS ms, value * (1 + event_id % 4) AS task_ms, event_id % 5 AS cached_bytes, 10 + event_id % 3 AS read_bytes FROM events)"


@query(None, f"SELECT variant, quantile_cont(task_ms, 0.5) / quantile_cont(ms, 0.5) AS busy_ratio, sum(cached_bytes) / (sum(cached_bytes) + sum(read_bytes)) AS cache_ratio FROM {_TIMED} WHERE run_no > 1 GROUP BY variant")
def run_ratios(spark, root):
    e = F.col("event_id")
    runs = tables.table(spark, root, "events").select(
        F.col("event_type").alias("variant"), F.row_number().over(Window.partitionBy("event_type").orderBy("event_id")).alias("run_no"), F.col("value").alias("ms"),
        (F.col("value") * (1 + e % 4)).alias("task_ms"), (e % 5).alias("cached_bytes"), (10 + e % 3).alias("read_bytes"),
    )
    return profile.run_ratios(runs)


# ---------------------------------------------------------------- layouts
@query(None, f"SELECT count(*) AS rows, {sum_of('l_extendedprice', 2)} AS amount FROM lineitem")
def baseline_copy(spark, root):
    copy = ingest.baseline_copy(spark, tables.place(spark, root, "lineitem"), f"{rank.stage_dir(spark)}/copy")
    return copy.agg(F.count("*").alias("rows"), C.money_sum("l_extendedprice", 2).alias("amount"))


@query(None, "SELECT count(*) AS rows, 0::BIGINT AS overlapping_files FROM lineitem")
def clustered_layout(spark, root):
    """Lines in ranges of a key: but for a key that two files share, no file's range reaches into another's."""
    path = f"{rank.stage_dir(spark)}/clustered"
    ingest.write_clustered(tables.table(spark, root, "lineitem"), path, ["l_shipdate", "l_orderkey"], 8)
    reach = F.max("high").over(Window.orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1))  # a row for each file
    files = ingest.file_ranges(spark, path, "l_shipdate").withColumn("reach", reach)
    return spark.read.parquet(path).agg(F.count("*").alias("rows")).crossJoin(files.agg(F.count(F.when(F.col("low") < F.col("reach"), 1)).alias("overlapping_files")))


@query(None, "SELECT count(*) AS customers, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance, count(DISTINCT c_mktsegment) AS segments FROM customer")
def csv_round_trip(spark, root):
    """Customers as CSV with a header, typed again into Parquet."""
    path, rows = rank.stage_dir(spark), tables.table(spark, root, "customer")
    rows.write.option("header", True).csv(f"{path}/csv")
    ingest.csv_to_parquet(spark, f"{path}/csv", f"{path}/typed", rows.schema)
    return spark.read.parquet(f"{path}/typed").agg(F.count("*").alias("customers"), C.money_sum("c_acctbal", 2).alias("balance"), F.countDistinct("c_mktsegment").alias("segments"))


# ---------------------------------------------------------------- models and samples
_HELD = "(SELECT lapsed, recency_days FROM drawn WHERE NOT is_train)"


@query("gate", _SPLIT + "SELECT * FROM " + _AP.format(l="lapsed", s="recency_days", t=_HELD))
def recency_baseline(spark, root):
    """Average precision of days since the last basket alone, on the households that no model sees."""
    return model.average_precision(drawn(spark, root).where("not is_train"), "lapsed", "recency_days")


@query()
def model_lift(spark, root):
    """Boosted trees against recency alone, both on the held-out households."""
    names = MODEL_FEATURES
    rows = rank.staged(drawn(spark, root))
    fitted = model.fit_gbt(rows.where("is_train"), names, "lapsed")
    scored = rank.staged(model.scored(fitted, rows.where("not is_train"), names, "lapsed"))
    return model.lift_gate(model.average_precision(scored, "lapsed", "score"), model.average_precision(scored, "lapsed", "recency_days"), "average_precision")


_DATED = "(SELECT quality AS label, n_chars AS score, doc_id % 4 AS period FROM labels JOIN documents USING (doc_id))"
_AP_BY = f"SELECT period, round(sum(pos / P * tp / n_all), 6) AS ap FROM (SELECT period, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS n_all, sum(pos) OVER (PARTITION BY period) AS P FROM (SELECT period, score AS s, count(*) AS n, sum(label) AS pos FROM {_DATED} GROUP BY 1, 2) WINDOW w AS (PARTITION BY period ORDER BY s DESC)) GROUP BY period"


@query(None, f"SELECT period, ap AS average_precision, round(ap - (SELECT ap FROM ({_AP_BY}) WHERE period = 0), 6) AS decay FROM ({_AP_BY})")
def score_decay(spark, root):
    """A score's average precision by period, and what it lost since the first: apart from the drift of what it is fed with."""
    documents = tables.table(spark, root, "documents").select("doc_id", "n_chars")
    rows = tables.table(spark, root, "labels").join(documents, "doc_id").select((F.col("doc_id") % 4).alias("period"), F.col("quality").alias("label"), F.col("n_chars").alias("score"))
    return model.score_decay(rows, "label", "score", "period")


@query(None, "SELECT count(*) AS rows, count(*) FILTER (user_id % 10 <> 3) AS real_rows, count(*) FILTER (user_id % 10 = 3) AS excluded FROM events")
def real_rows(spark, root):
    """Rows flagged as synthetic (here by rule: every tenth user) are left out of an evaluation, and counted."""
    rows = tables.table(spark, root, "events").withColumn("is_synthetic", F.col("user_id") % 10 == 3)
    real = features.only_real(rows, "is_synthetic").agg(F.count("*").alias("real_rows"))
    return rows.agg(F.count("*").alias("rows")).crossJoin(real).select("rows", "real_rows", (F.col("rows") - F.col("real_rows")).alias("excluded"))


def _lines(spark: SparkSession, root: str) -> DataFrame:
    return tables.table(spark, root, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", "l_quantity", "l_suppkey")


_WEIGHT = "greatest(1, round(power(max(l_quantity), 0.5)))::BIGINT"


@query(None, _DRAWN.format(size=_WEIGHT, h=md5_number("range", 13)))
def bootstrap_weighted(spark, root):
    """Baskets drawn with replacement, larger ones more often."""
    return sample.bootstrap_groups(_lines(spark, root), "l_orderkey", 2000, 13, "l_quantity", 0.5).select("draw_id", "l_orderkey", "l_partkey", "l_extendedprice")


@query(None, "SELECT 2000::BIGINT AS draws, 0::BIGINT AS broken WHERE (SELECT count(*) FROM lineitem) > 0")
def drawn_baskets_are_whole(spark, root):
    lines = _lines(spark, root)
    drawn = rank.staged(sample.bootstrap_groups(lines, "l_orderkey", 2000, 11))
    broken = sample.broken_groups(drawn, lines, "l_orderkey", "draw_id", "l_partkey", "l_extendedprice")
    return drawn.agg(F.countDistinct("draw_id").alias("draws")).crossJoin(broken.agg(F.count("*").alias("broken")))


_SHARE = "(SELECT l_suppkey AS k, count(*) / (SELECT count(*) FROM {t}) AS s FROM {t} GROUP BY 1)"
_FAR = "(SELECT CAST(sum(CAST(abs(coalesce(a.s, 0) - coalesce(b.s, 0)) AS DECIMAL(20,12))) / 2 AS DOUBLE) FROM {a} a FULL JOIN {b} b ON a.k = b.k)"
_TENTH = "(SELECT sum(n) FILTER (i <= greatest(1, round_even(0.1 * keys, 0)))::BIGINT / sum(n) FROM (SELECT n, row_number() OVER (ORDER BY n DESC) AS i, count(*) OVER () AS keys FROM (SELECT count(*) AS n FROM {t} GROUP BY l_suppkey)))"
_FIDELITY = f"""{_DRAWN.format(size="1", h=md5_number("range", 11)).replace("SELECT draw_id, l.*", ", drawn AS (SELECT l.l_suppkey", 1).replace("l_partkey, l_extendedprice FROM lineitem", "l_suppkey FROM lineitem")}),
odd AS (SELECT * FROM lineitem WHERE l_orderkey % 2 = 1), even AS (SELECT * FROM lineitem WHERE l_orderkey % 2 = 0),
m AS (SELECT {_FAR.format(a=_SHARE.format(t="drawn"), b=_SHARE.format(t="lineitem"))} AS distance, {_FAR.format(a=_SHARE.format(t="odd"), b=_SHARE.format(t="even"))} AS noise_floor, {_TENTH.format(t="drawn")} AS sample_top_decile_share, {_TENTH.format(t="lineitem")} AS source_top_decile_share)
SELECT *, distance <= 1.5 * noise_floor AS within_noise, abs(sample_top_decile_share - source_top_decile_share) <= 0.03 AS decile_kept FROM m"""


@query(None, _FIDELITY)
def sample_fidelity(spark, root):
    """A bootstrap's shares of suppliers against the source's, beside the noise floor and the share of the largest tenth."""
    lines = _lines(spark, root)
    drawn = rank.staged(sample.bootstrap_groups(lines, "l_orderkey", 2000, 11))
    return sample.fidelity(drawn, lines, F.col("l_orderkey") % 2 == 1, "l_suppkey")


# ---------------------------------------------------------------- streams
@query("gate", "SELECT 'valid' AS side, count(*) AS rows, count(DISTINCT event_id) AS keys FROM valid UNION ALL SELECT 'rejected', count(*), count(DISTINCT event_id) FROM rejected")
def stream_gate(spark, root):
    """Both halves of the gate from one stream of conformed lines."""
    path = rank.stage_dir(spark)
    conformed(spark, root).write.parquet(f"{path}/lines")
    stream = spark.readStream.schema(spark.read.parquet(f"{path}/lines").schema).parquet(f"{path}/lines")
    flows.split_stream(stream, rules.FACT_RULES, f"{path}/valid", f"{path}/rejected", f"{path}/checkpoint")
    side = lambda n: spark.read.parquet(f"{path}/{n}").agg(F.count("*").alias("rows"), F.countDistinct("event_id").alias("keys")).select(F.lit(n).alias("side"), "*")
    return side("valid").unionByName(side("rejected"))


_DAYS = f"SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end, event_type, count(*) AS n, {sum_of('value')} AS total FROM events GROUP BY ALL"
_MARK = "(SELECT max(ts) - INTERVAL 6 HOUR FROM events)"


@query(None, f"SELECT *, window_end > {_MARK} AS is_provisional FROM ({_DAYS})")
def stream_provisional(spark, root):
    """Windows so far, those that late rows may still change marked."""
    path, events = rank.stage_dir(spark), _event_stream(spark, root)
    flows.upsert_windows(flows.windowed(events, "ts", "1 day", ["event_type"], "value"), f"{path}/out", ["event_type"], f"{path}/checkpoint")
    return flows.provisional(flows.read_table(spark, f"{path}/out"), tables.table(spark, root, "events").agg(F.max("ts").alias("max_ts")))


@query(None, f"SELECT * FROM ({_DAYS}) WHERE window_end <= {_MARK}")
def stream_closed_windows(spark, root):
    """Windows that the watermark has closed, each appended once; their state is gone by then."""
    path = rank.stage_dir(spark)
    flows.drain(flows.windowed(_event_stream(spark, root), "ts", "1 day", ["event_type"], "value"), f"{path}/out", f"{path}/checkpoint")
    return spark.read.schema("window_start timestamp, window_end timestamp, event_type string, n bigint, total double").parquet(f"{path}/out")


_ARRIVED = f"SELECT ts, CAST(ts + {_LATE} AS DATE) AS day FROM events"
_PARTS = f"WITH a AS ({_ARRIVED}), p AS (SELECT ts, date_diff('day', (SELECT min(day) FROM a), day) * 4 // (date_diff('day', (SELECT min(day) FROM a), (SELECT max(day) FROM a)) + 1) AS batch FROM a)"


@query(None, f"{_PARTS}, m AS (SELECT batch, max(ts) AS m FROM p GROUP BY batch), s AS (SELECT batch, max(m) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM m) SELECT p.batch, count(*) AS rows, count(*) FILTER (ts < seen - INTERVAL 2 HOUR) AS late FROM p JOIN s ON p.batch = s.batch GROUP BY p.batch")
def stream_late(spark, root):
    """Events that land in four parts by time of arrival, a batch each: rows behind the batches before are kept apart and counted."""
    path, rows = rank.stage_dir(spark), tables.table(spark, root, "events")
    delay = F.when(F.col("event_id") % 37 == 0, F.expr("INTERVAL 5 HOURS")).when(F.col("event_id") % 101 == 0, F.expr("INTERVAL 7 HOURS")).otherwise(F.expr("INTERVAL 0 HOURS"))
    rows = rows.withColumn("day", F.to_date(F.col("ts") + delay))
    span = rows.agg(F.min("day").alias("low"), F.max("day").alias("high"))
    part = F.floor(F.datediff("day", "low") * 4 / (F.datediff("high", "low") + 1))
    landed = rows.crossJoin(F.broadcast(span)).withColumn("part", part.cast("int")).drop("day", "low", "high")

    def run(streams: dict[str, DataFrame], _: int) -> None:
        flows.split_late(streams["events"], "ts", "2 HOURS", f"{path}/kept", f"{path}/late", f"{path}/peaks", f"{path}/checkpoint")

    live.replay({"events": landed}, 4, path, run)
    side = lambda n, late: spark.read.schema("ts timestamp, batch bigint").option("basePath", f"{path}/{n}").parquet(f"{path}/{n}").select("batch", F.lit(late).alias("late"))
    return side("kept", 0).unionByName(side("late", 1)).groupBy("batch").agg(F.count("*").alias("rows"), F.sum("late").alias("late"))


@query(None, "SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS streamed, count(*) AS batched, 0::BIGINT AS variance FROM events GROUP BY ALL")
def rt_batch_variance_daily(spark, root):
    """Counts of a day from the stream against those from the table."""
    path = rank.stage_dir(spark)
    flows.upsert_windows(flows.windowed(_event_stream(spark, root), "ts", "1 day", ["event_type"], "value"), f"{path}/out", ["event_type"], f"{path}/checkpoint")
    batched = tables.table(spark, root, "events").groupBy(F.date_trunc("day", "ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    return flows.stream_batch_variance(flows.read_table(spark, f"{path}/out").withColumnRenamed("window_start", "day"), batched, ["day", "event_type"], "n")
