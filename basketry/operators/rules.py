"""Rules as rows: predicates in SQL text, a gate with a quarantine, candidates from a profile, reviews."""

from __future__ import annotations

from collections import Counter
from dataclasses import astuple, dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


@dataclass(frozen=True)
class Rule:
    name: str
    dataset: str
    expression: str
    severity: str = "error"
    tag: str = "validity"
    origin: str = "authored"
    review: str = "accept"
    rationale: str = ""
    version: str = "1"


# The predicates of the fact rules.
FACT_RULES = [
    Rule("event_id_present", "fact", "event_id IS NOT NULL"),
    Rule("transaction_time_reconciled", "fact", "transaction_time_hhmm IS NOT NULL"),
    Rule("transaction_time_is_valid_hhmm", "fact", "transaction_time_hhmm BETWEEN 0 AND 2359 AND transaction_time_hhmm % 100 < 60"),
    Rule("quantity_parsed", "fact", "quantity_units IS NOT NULL"),
    Rule("quantity_non_negative", "fact", "quantity_units >= 0"),
    Rule("revenue_requires_quantity", "fact", "quantity_units > 0 OR sales_amt = 0"),
    Rule("sales_amt_present", "fact", "sales_amt IS NOT NULL"),
    Rule("sales_amt_non_negative", "fact", "sales_amt >= 0"),
    Rule("discount_amounts_present", "fact", "retail_disc_amt IS NOT NULL AND coupon_disc_amt IS NOT NULL AND coupon_match_disc_amt IS NOT NULL"),
    Rule("retail_discount_is_not_a_surcharge", "fact", "retail_disc_amt <= 0"),
    Rule("coupon_discounts_are_not_surcharges", "fact", "coupon_disc_amt <= 0 AND coupon_match_disc_amt <= 0"),
    Rule("zero_sales_has_offsetting_discount", "fact", "sales_amt > 0 OR retail_disc_amt < 0 OR coupon_disc_amt < 0 OR coupon_match_disc_amt < 0 OR quantity_units = 0", "warn"),
    Rule("store_id_present", "fact", "store_id IS NOT NULL"),
    Rule("product_id_present", "fact", "product_id IS NOT NULL"),
    Rule("household_key_present", "fact", "household_key IS NOT NULL"),
    Rule("transaction_ts_present", "fact", "transaction_ts IS NOT NULL"),
    Rule("transaction_ts_not_in_future", "fact", "transaction_ts <= current_timestamp()"),
    Rule("week_no_within_seed_window", "fact", "week_no BETWEEN 1 AND 102", "warn"),
]

# The invariants of the dimensions.
DIMENSION_RULES = [
    Rule("product_id_present", "dim_product", "product_id IS NOT NULL"),
    Rule("department_never_null", "dim_product", "department IS NOT NULL"),
    Rule("brand_tier_is_binary", "dim_product", "brand_tier IN ('National', 'Private')"),
    Rule("household_key_present", "dim_household", "household_key IS NOT NULL"),
    Rule("demographics_flag_matches_payload", "dim_household", "has_demographics = (age_band IS NOT NULL)"),
    Rule("store_id_present", "dim_store", "store_id IS NOT NULL"),
    Rule("store_activity_is_positive", "dim_store", "transaction_lines > 0"),
]


def rules_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """The rules as rows of a schema without nulls."""
    return spark.createDataFrame([astuple(r) for r in rules], StructType([StructField(f.name, StringType(), False) for f in fields(Rule)]))


def publish_rules(spark: SparkSession, rules: list[Rule], path: str) -> DataFrame:
    """Replaces the rule table at ``path`` by these rules, and returns it as it reads. A name given twice in a dataset is an error."""
    twice = [k for k, n in Counter((r.dataset, r.name) for r in rules).items() if n > 1]
    if twice:
        raise ValueError(f"rules given twice: {sorted(twice)}")
    table = rules_table(spark, rules)
    table.write.mode("overwrite").parquet(path)
    return spark.read.schema(table.schema).parquet(path)


def load_rules(table: DataFrame, dataset: str, severity: str | None = None) -> list[Rule]:
    """The reviewed rules of a dataset by name; a missing rule set is an error, never "no checks"."""
    rows = table.where((F.col("dataset") == dataset) & F.col("review").isin("accept", "amend"))
    if severity:
        rows = rows.where(F.col("severity") == severity)
    found = sorted((Rule(**r.asDict()) for r in rows.collect()), key=lambda r: r.name)
    if not found:
        raise ValueError(f"no reviewed rules for {dataset}")
    return found


def broken(rule: Rule) -> Column:
    """Whether a row breaks a rule; a null outcome breaks none."""
    return F.expr(f"({rule.expression}) IS FALSE")


def violations(rules: list[Rule]) -> Column:
    """array<struct<rule_name, rule_expression>> of the rules that a row breaks, in order of name."""
    each = (F.when(broken(r), F.struct(F.lit(r.name).alias("rule_name"), F.lit(r.expression).alias("rule_expression"))) for r in sorted(rules, key=lambda r: r.name))
    return F.array_compact(F.array(*each))


def gate(df: DataFrame, rules: list[Rule], version: str = "1", now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with rule_name, rule_expression, failed_rules, failed_at and ruleset_version).

    Valid rows are told by plain conditions, which Spark compiles; the list of broken rules is made for the rejected alone.
    """
    errors = [r for r in rules if r.severity == "error"]
    judged = df.withColumn("_broken", violations(errors))
    first = F.col("_broken")[0]
    rejected = judged.where(F.size("_broken") > 0).withColumns(
        {"rule_name": first["rule_name"], "rule_expression": first["rule_expression"], "failed_rules": F.col("_broken.rule_name"), "failed_at": F.current_timestamp() if now is None else now, "ruleset_version": F.lit(version)}
    )
    return df.where(reduce(lambda a, r: a & ~broken(r), errors, F.lit(True))), rejected.drop("_broken")


def rule_counts(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """(dataset, rule_name, passed, failed) of each rule over all rows, in one pass; rules that nothing breaks too."""
    each = (F.struct(F.lit(r.dataset).alias("dataset"), F.lit(r.name).alias("rule_name"), F.count(F.when(~broken(r), 1)).alias("passed"), F.count(F.when(broken(r), 1)).alias("failed")) for r in rules)
    return df.agg(F.array(*each).alias("r")).select(F.inline("r"))


def rule_impact(df: DataFrame, rules: list[Rule], amount: str, key: str) -> DataFrame:
    """(rule_name, severity, rows_hit, amount_hit, keys_hit) of each rule over all rows, in one pass."""
    named = [F.when(broken(r), F.struct(F.lit(r.name).alias("n"), F.lit(r.severity).alias("s"))) for r in rules]
    hits = df.select(F.col(amount).cast("decimal(18,2)").alias("_a"), F.col(key).alias("_k"), F.explode(F.array_compact(F.array(*named))).alias("r"))
    return hits.groupBy(F.col("r.n").alias("rule_name"), F.col("r.s").alias("severity")).agg(
        F.count("*").alias("rows_hit"), F.sum("_a").cast("double").alias("amount_hit"), F.countDistinct("_k").alias("keys_hit")
    )


def headline_counts(rejected: DataFrame) -> DataFrame:
    """(rule_name, headline_rows, violation_rows): rows filed under a rule, and rows that break it at all."""
    head = rejected.groupBy("rule_name").agg(F.count("*").alias("headline_rows"))
    each = rejected.select(F.explode("failed_rules").alias("rule_name")).groupBy("rule_name").agg(F.count("*").alias("violation_rows"))
    return each.join(head, "rule_name", "left").select("rule_name", F.coalesce("headline_rows", F.lit(0)).alias("headline_rows"), "violation_rows")


def candidate_rules(df: DataFrame, columns: list[str], sigmas: float = 3.0) -> DataFrame:
    """(column_name, low, high): proposed ranges of numeric columns, mean plus or minus sigmas within the seen range; whole numbers for integers.

    All columns are profiled in one aggregate. Nothing proposed is enforced without a review.
    """
    kinds = dict(df.dtypes)
    sums = []
    for c in columns:
        x = F.col(c).cast("double")
        sums.append(F.struct(F.lit(c).alias("column_name"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.avg(x).alias("mu"), F.stddev_samp(x).alias("sd"), F.lit(kinds[c] in ("int", "bigint", "smallint", "tinyint")).alias("whole")))
    rows = df.agg(F.array(*sums).alias("s")).select(F.inline("s"))
    low, high = F.greatest(F.col("lo"), F.col("mu") - sigmas * F.col("sd")), F.least(F.col("hi"), F.col("mu") + sigmas * F.col("sd"))
    return rows.select("column_name", F.when(F.col("whole"), F.floor(low).cast("double")).otherwise(low).alias("low"), F.when(F.col("whole"), F.ceil(high).cast("double")).otherwise(high).alias("high"))


def proposed_rules(df: DataFrame, columns: list[str], sigmas: float = 3.0) -> DataFrame:
    """(column_name, kind, low, high): not_null and, for text, not_blank where no row speaks against it; a range for numbers and times.

    Ranges are mean plus or minus ``sigmas`` deviations within what was seen, in whole numbers for integers, in seconds of the epoch for
    times. All columns are profiled in one aggregate. Nothing proposed is enforced without a review.
    """
    seen = []
    for c, kind in ((c, dict(df.dtypes)[c]) for c in columns):
        timed, text = kind.startswith("timestamp"), kind == "string"
        x = (F.unix_micros(F.col(c).cast("timestamp")) / 1_000_000 if timed else F.lit(None) if text else F.col(c)).cast("double")
        blank = F.count(F.when(F.trim(c) == "", 1)) if text else F.lit(0).cast("bigint")
        facts = {"column_name": F.lit(c), "nulls": F.count(F.when(F.col(c).isNull(), 1)), "blanks": blank, "lo": F.min(x), "hi": F.max(x), "mu": F.avg(x), "sd": F.stddev_samp(x)}
        whole = F.lit(timed or kind in ("int", "bigint", "smallint", "tinyint"))
        seen.append(F.struct(*(v.alias(k) for k, v in facts.items()), F.lit(text).alias("text"), whole.alias("whole")))
    rows = df.agg(F.array(*seen).alias("s")).select(F.inline("s"))
    low, high = F.greatest(F.col("lo"), F.col("mu") - sigmas * F.col("sd")), F.least(F.col("hi"), F.col("mu") + sigmas * F.col("sd"))
    none = F.lit(None).cast("double")
    rule = lambda when, kind, a=none, b=none: F.when(when, F.struct(F.lit(kind).alias("kind"), a.alias("low"), b.alias("high")))
    bounds = [F.when(F.col("whole"), edge(x).cast("double")).otherwise(x) for edge, x in ((F.floor, low), (F.ceil, high))]
    each = F.array_compact(F.array(rule(F.col("nulls") == 0, "not_null"), rule(F.col("text") & (F.col("blanks") == 0), "not_blank"), rule(F.col("lo").isNotNull(), "range", *bounds)))
    return rows.select("column_name", F.inline(each))


def unreviewed(candidates: DataFrame, reviews: DataFrame) -> DataFrame:
    """Names that one side has and the other lacks: candidates without a decision, decisions on nothing."""
    a = candidates.join(reviews, "name", "left_anti").select("name", F.lit("undecided").alias("problem"))
    return a.unionByName(reviews.join(candidates, "name", "left_anti").select("name", F.lit("unknown").alias("problem")))


def pass_rate_regression(now: DataFrame, baseline: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(dataset, pass_rate, baseline_rate, regressed) of frames (dataset, passed, failed)."""
    rate = lambda f, name: f.select("dataset", F.try_divide(F.col("passed").cast("double"), (F.col("passed") + F.col("failed")).cast("double")).alias(name))
    both = rate(now, "pass_rate").join(rate(baseline, "baseline_rate"), "dataset")
    return both.withColumn("regressed", F.col("pass_rate") < F.col("baseline_rate") - tolerance)
