"""Rules, profiles and monitors of tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType

from ..functions.rounding import rounded


@dataclass(frozen=True)
class Rule:
    """A condition in SQL on columns that it names, the first of which is the one that is sampled; a NULL condition is a violation."""

    name: str
    columns: tuple[str, ...]
    condition: str
    severity: str = "error"


CONTRACT_RULES = [
    Rule("positive_value", ("amount",), "amount > 0"), Rule("valid_cnpj", ("cnpj",), r"cnpj rlike '^[0-9]{14}$'"), Rule("signature_date_present", ("signature_date",), "signature_date is not null"),
    Rule("coherent_validity", ("validity_end", "validity_start"), "validity_end >= validity_start"), Rule("amount_not_extreme", ("amount",), "amount < 90000", "warning"), Rule("subject_not_empty", ("subject",), "length(subject) > 10"),
]
GAZETTE_RULES = [
    Rule("valid_territory", ("territory_id",), r"territory_id rlike '^[0-9]{7}$'"), Rule("date_present", ("date",), "date is not null"), Rule("file_url_present", ("url",), "length(url) > 0"), Rule("text_url_present", ("txt_url",), "length(txt_url) > 0", "warning"),
]


def check_rules(df: DataFrame, rules: list[Rule], sample: int = 5) -> DataFrame:
    """A row a rule: rule, severity, records, violations, share, and the ``sample`` smallest of the values that violate it (NULLs last, as
    'NULL'), in one pass over df. Rules on columns that df does not have are left out; without rules there are no rows.

    Samples are gathered by tasks and merged, each with ``sample`` values at most.
    """
    known = [r for r in rules if set(r.columns) <= set(df.columns)]
    if not known:
        return df.sparkSession.createDataFrame([], "rule string, severity string, records long, violations long, share double, sample array<string>")
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (~F.coalesce(F.expr(r.condition), F.lit(False))).alias("bad"), F.col(r.columns[0]).cast("string").alias("value")) for i, r in enumerate(known)]))
    long = df.select(each.alias("r")).select("r.*")
    row = long.groupBy("i").agg(F.count(F.lit(1)).alias("records"), F.count_if("bad").alias("violations"))
    values = long.where("bad").groupBy("i", "value").agg(F.lit(1).alias("_one"))
    order = Window.partitionBy("i").orderBy(F.col("value").asc_nulls_last())
    few = values.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= sample).groupBy("i").agg(F.array_sort(F.collect_list(F.struct("_n", F.coalesce("value", F.lit("NULL")).alias("value")))).alias("_s"))
    names = df.sparkSession.createDataFrame([(i, r.name, r.severity) for i, r in enumerate(known)], "i int, rule string, severity string")
    out = F.broadcast(names).join(row, "i", "left").join(few, "i", "left")
    zero = F.lit(0).cast("long")
    return out.select("rule", "severity", F.coalesce("records", zero).alias("records"), F.coalesce("violations", zero).alias("violations"), rounded(F.coalesce(F.col("violations") / F.nullif(F.col("records"), F.lit(0)), F.lit(0.0))).alias("share"), F.transform(F.coalesce("_s", F.array().cast("array<struct<_n:int,value:string>>")), lambda x: x["value"]).alias("sample"))


def flattened(df: DataFrame) -> DataFrame:
    """df with the fields of its structs as columns, named struct_field, to any depth, and its amount as a number."""
    def columns(kind: StructType, path: str, name: str) -> list[Column]:
        out = []
        for f in kind.fields:
            p, n = (f"{path}.`{f.name}`" if path else f"`{f.name}`"), (f"{name}_{f.name}" if name else f.name)
            out += columns(f.dataType, p, n) if isinstance(f.dataType, StructType) else [F.col(p).alias(n)]
        return out

    out = df.select(*columns(df.schema, "", ""))
    return out.withColumn("amount", F.col("amount").try_cast("double")) if "amount" in out.columns else out


def apply_rules(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """check_rules on the flattened table."""
    return check_rules(flattened(df), rules)


def quantiles(df: DataFrame, column: str, parts: list[float], group: list[str] | None = None) -> DataFrame:
    """Exact quantiles of a column, interpolated between neighbours, by group: one column q0, q1, ... for each part, and n.

    Values are counted first; only different values meet, and they are ranked in ranges: a task sums the counts of one range of values, and
    the ranges' totals, some hundreds, meet in a window. No task holds all values, as an exact percentile in one aggregate would.
    """
    group = group or []
    counted = df.where(F.col(column).isNotNull()).select(*group, F.col(column).cast("double").alias("_v")).groupBy(*group, "_v").agg(F.count(F.lit(1)).alias("_c"))
    edges = counted.groupBy(*group).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_c").alias("n"))
    same = reduce(lambda a, b: a & b, [F.col(f"_e.{g}").eqNullSafe(F.col(f"_x.{g}")) for g in group], F.lit(True))
    x = counted.alias("_x").join(F.broadcast(edges.alias("_e")) if not group else edges.alias("_e"), same).select(*[F.col(f"_x.{g}").alias(g) for g in group], "_v", "_c", "_lo", "_hi", "n")
    x = x.withColumn("_range", F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 512)).otherwise(F.lit(0).cast("long")))
    within = Window.partitionBy(*group, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    local = x.withColumn("_upto", F.sum("_c").over(within))
    totals = x.groupBy(*group, "_range").agg(F.sum("_c").alias("_all"))
    line = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    totals = totals.withColumn("_before", F.sum("_all").over(line) - F.col("_all"))
    keys = reduce(lambda a, b: a & b, [F.col(f"_l.{g}").eqNullSafe(F.col(f"_t.{g}")) for g in group], F.col("_l._range") == F.col("_t._range"))
    placed = local.alias("_l").join(totals.alias("_t"), keys).select(*[F.col(f"_l.{g}").alias(g) for g in group], "_v", "n", (F.col("_t._before") + F.col("_l._upto") - F.col("_l._c")).alias("_first"), (F.col("_t._before") + F.col("_l._upto") - 1).alias("_last"))
    out = []
    for i, part in enumerate(parts):
        at = F.lit(float(part)) * (F.col("n") - 1)
        hit = lambda k: F.max(F.when((F.col("_first") <= k) & (k <= F.col("_last")), F.col("_v")))
        low, high = hit(F.floor(at)), hit(F.ceil(at))
        out.append((low + (high - low) * F.max(at - F.floor(at))).alias(f"q{i}"))
    return placed.groupBy(*group).agg(F.max("n").alias("n"), *out)


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row a column: n, nulls, distinct values and their shares; of numbers lowest, highest, mean, median, deviation of a sample,
    quartiles and outliers beyond 1.5 ranges; of others the most frequent value (the smallest of several) and how often it stands."""
    def one(c: str) -> DataFrame:
        number = isinstance(df.schema[c].dataType, NumericType)
        x = F.col(c).cast("double") if number else F.col(c).cast("string")
        counted = df.select(x.alias("_x")).groupBy("_x").agg(F.count(F.lit(1)).alias("_c"))
        s = counted.agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("_x").isNull(), F.col("_c"))), F.lit(0)).alias("nulls"), F.count("_x").alias("distinct_values"),
                        F.max_by(F.when(F.col("_x").isNotNull(), F.col("_x").cast("string")), F.when(F.col("_x").isNotNull(), F.struct("_c", F.lit(0)))).alias("_any"))
        none = F.lit(None).cast("double")
        if number:
            exact = F.col(c).cast("decimal(38,10)")
            wide = df.agg(F.min(x).alias("lowest"), F.max(x).alias("highest"), rounded(F.avg(exact)).alias("mean"), rounded(F.stddev_samp(x)).alias("deviation"))
            q = quantiles(df, c, [0.25, 0.5, 0.75]).select(F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"))
            reach = 1.5 * (F.col("q3") - F.col("q1"))
            out = counted.join(F.broadcast(q)).agg(F.coalesce(F.sum(F.when((F.col("_x") < F.col("q1") - reach) | (F.col("_x") > F.col("q3") + reach), F.col("_c"))), F.lit(0)).alias("outliers"))
            s = s.crossJoin(wide).crossJoin(q).crossJoin(out).withColumns({"mode": F.lit(None).cast("string"), "mode_count": F.lit(None).cast("long")})
        else:
            top = counted.where("_x is not null").orderBy(F.desc("_c"), "_x").limit(1).select(F.col("_x").alias("mode"), F.col("_c").alias("mode_count"))
            s = s.join(top, F.lit(True), "left").withColumns({x: none for x in ("lowest", "highest", "mean", "deviation", "q1", "median", "q3")} | {"outliers": F.lit(0).cast("long")})
        part = lambda y: rounded(F.coalesce(F.col(y) / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0)))
        return s.select(F.lit(c).alias("column_name"), "n", "nulls", part("nulls").alias("nulls_share"), "distinct_values", part("distinct_values").alias("distinct_share"), "lowest", "highest", "mean", "median", "deviation", "q1", "q3", "outliers", "mode", "mode_count")

    return reduce(DataFrame.unionByName, [one(c) for c in columns])


def quality_score(profiles: DataFrame) -> DataFrame:
    """One row: columns, and their mean score: 0 for more than half NULLs, .5 for more than a tenth, else 1."""
    score = F.when(F.col("nulls_share") > 0.5, 0.0).when(F.col("nulls_share") > 0.1, 0.5).otherwise(1.0)
    return profiles.agg(F.count(F.lit(1)).alias("columns"), rounded(F.coalesce(F.avg(score), F.lit(1.0))).alias("quality_score"))


def profile_alerts(profiles: DataFrame) -> DataFrame:
    """Alerts of a profile: many NULLs, all values different, many outliers: column_name, alert."""
    found = F.array_compact(F.array(F.when(F.col("nulls_share") > 0.1, F.lit("nulls")), F.when((F.col("distinct_share") == 1.0) & (F.col("n") > 100), F.lit("all values differ")), F.when(F.col("outliers") > 0.1 * F.col("n"), F.lit("outliers"))))
    return profiles.select("column_name", F.explode(found).alias("alert"))


def monitor(profiles: DataFrame, dataset: str, most_nulls: float = 0.1, least_score: float = 0.8) -> DataFrame:
    """Alerts against thresholds: dataset, metric, current_value, expected_value, severity; the score as an error, columns as warnings."""
    columns = profiles.where(F.col("nulls_share") > most_nulls).select(F.concat("column_name", F.lit(":nulls_pct")).alias("metric"), F.col("nulls_share").alias("current_value"), F.lit(most_nulls).alias("expected_value"), F.lit("warning").alias("severity"))
    low = quality_score(profiles).where(F.col("quality_score") < least_score).select(F.lit("quality_score").alias("metric"), F.col("quality_score").alias("current_value"), F.lit(least_score).alias("expected_value"), F.lit("error").alias("severity"))
    return low.unionByName(columns).select(F.lit(dataset).alias("dataset"), "*")


def retained(history: DataFrame, group: str, order: str, most: int = 90) -> DataFrame:
    """The ``most`` latest rows of each group."""
    return history.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(order)))).where(F.col("_n") <= most).drop("_n")


def period_summary(batches: DataFrame, since: Column) -> DataFrame:
    """batches (dataset, at, total, duplicates, errors, failures: a map from severity to rules) since a time, by dataset; failures as JSON."""
    recent = batches.where(F.col("at") >= since)
    sums = recent.groupBy("dataset").agg(F.count(F.lit(1)).alias("batches"), F.sum("total").alias("total_records"), F.sum("duplicates").alias("duplicates"), F.sum("errors").alias("normalization_errors"))
    failures = recent.select("dataset", F.explode("failures").alias("severity", "rules")).groupBy("dataset", "severity").agg(F.sum("rules").alias("rules"))
    failures = failures.groupBy("dataset").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "severity", F.col("rules").cast("string")))), ",").alias("failures"))
    return sums.join(failures, "dataset", "left").withColumn("failures", F.coalesce("failures", F.lit("")))


def window_of(name: str, today: Column) -> tuple[Column, Column]:
    """[start, end) of previous_day, current_month, previous_month or all."""
    month = F.trunc(today, "month")
    spans = {"previous_day": (F.date_sub(today, 1), today), "current_month": (month, F.add_months(month, 1)), "previous_month": (F.add_months(month, -1), month), "all": (F.lit("0001-01-01").cast("date"), F.lit("9999-12-31").cast("date"))}
    return spans[name]


def measured(df: DataFrame, step: str) -> tuple[DataFrame, Observation]:
    """df, and what is known of the rows once it has been written: rows, and rows that are NULL in every column. No extra pass is made."""
    seen = Observation(step)
    empty = reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNull() for c in df.columns], F.lit(True))
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(empty).alias("empty_rows")), seen


def lineage(spark: SparkSession, steps: list[tuple[str, list[str], str]]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of steps (name, inputs, output): tables and steps as nodes, what reads and writes what as edges."""
    nodes = {(x, "table") for _, inputs, output in steps for x in [*inputs, output]} | {(name, "step") for name, _, _ in steps}
    edges = [(x, name, "reads") for name, inputs, _ in steps for x in inputs] + [(name, output, "writes") for name, _, output in steps]
    return spark.createDataFrame(sorted(nodes), "node string, kind string"), spark.createDataFrame(sorted(edges), "source string, target string, kind string")
