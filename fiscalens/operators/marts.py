"""The marts: volumes, agency and supplier statistics, red flags, amendments, political links, platform costs, data quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import rounded

MONEY = "decimal(38,4)"


def total(column: str = "amount") -> Column:
    """Sums are decimal and become doubles last, so that their order does not matter."""
    return F.sum(column).cast("double")


def contracts_daily(c: DataFrame) -> DataFrame:
    return c.groupBy("dt").agg(F.count(F.lit(1)).alias("contracts"), total().alias("total_amount"), F.countDistinct("siafi").alias("agencies"), F.countDistinct("doc").alias("suppliers"))


def contracts_by_agency(c: DataFrame) -> DataFrame:
    """Statistics by agency code; its label is that of most contracts, ties to the larger name."""
    variants = c.groupBy("siafi", "agency", "level", "uf").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"), F.min("signature_date").alias("first_date"), F.max("signature_date").alias("last_date"))
    top = lambda x: F.max_by(x, F.struct("n", x))
    return variants.groupBy("siafi").agg(top("agency").alias("agency"), top("level").alias("level"), top("uf").alias("uf"), F.sum("n").alias("contracts"), total().alias("total_amount"), F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"))


def supplier_stats(c: DataFrame) -> DataFrame:
    return c.where("doc is not null").groupBy("doc").agg(F.min("legal_name").alias("legal_name"), F.count(F.lit(1)).alias("contracts"), total().alias("total_amount"), F.countDistinct("siafi").alias("agencies"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"))


def data_quality_daily(c: DataFrame) -> DataFrame:
    out = c.groupBy("dt").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("id").alias("ids"), F.count_if(F.coalesce(F.col("amount"), F.lit(0)) == 0).alias("zero_amounts"), F.count_if(F.col("doc").isNull()).alias("no_supplier"))
    return out.withColumn("duplicates", F.col("rows") - F.col("ids"))


def municipality_daily(c: DataFrame) -> DataFrame:
    return c.where("city is not null").groupBy("dt", "city", "uf").agg(F.count(F.lit(1)).alias("contracts"), total().alias("total_amount"), F.countDistinct("doc").alias("suppliers"))


RED_FLAG_ITEM = "array<struct<numeroControlePNCP:string,dataAberturaProposta:string,dataEncerramentoProposta:string,valorInicialCompra:string,valorTotalHomologado:string>>"
AMENDMENT_ITEM = "array<struct<numeroControlePNCP:string,valorInicial:string,valorAcumulado:string,dataVigenciaFim:string,numeroRetificacao:string>>"


def parsed(raw: DataFrame, item: str, c: DataFrame) -> DataFrame:
    """A row an item of the payload arrays whose control number is a contract's id, with _seen: when it was crawled. Only the fields
    named in ``item`` are parsed; what no contract needs goes before any grouping."""
    rows = raw.select(F.struct("dt", "ingested_at").alias("_seen"), F.inline(F.from_json("payload_json", item)))
    return rows.withColumnRenamed("numeroControlePNCP", "id").join(c.select("id"), "id", "left_semi")


def non_competitive(modality: Column) -> Column:
    m = F.lower(F.trim(modality))
    return F.when(m.isNull() | m.isin("", "not_informed"), None).otherwise((m.contains("dispensa") | m.contains("inexigibilidade")).cast("int"))


def red_flags(c: DataFrame, raw: DataFrame, short_window_days: int = 7) -> DataFrame:
    """A row a contract: three flags of 0, 1 or NULL (not enough data), and their mean, NULL if all are.

    raw has dt, ingested_at and payload_json. Of an id's payloads the latest counts, by day and then by time of its crawl.
    """
    fields = ["dataAberturaProposta", "dataEncerramentoProposta", "valorInicialCompra", "valorTotalHomologado"]
    latest = parsed(raw, RED_FLAG_ITEM, c).groupBy("id").agg(F.max_by(F.struct(*fields), F.struct("_seen", *fields)).alias("p")).select("id", "p.*", F.lit(True).alias("_matched"))
    day = lambda x: F.substring(x, 1, 10).try_cast("date")
    days = F.datediff(day("dataEncerramentoProposta"), day("dataAberturaProposta"))
    estimated, homologated = F.col("valorInicialCompra").try_cast(MONEY), F.col("valorTotalHomologado").try_cast(MONEY)
    out = c.select("id", "dt", "siafi", "doc", "modality").join(latest, "id", "left").select(
        "id", "dt", "siafi", "doc", "modality", F.coalesce("_matched", F.lit(False)).alias("bronze_matched"), non_competitive(F.col("modality")).alias("f_non_competitive"), (days < short_window_days).cast("int").alias("f_short_window"),
        F.when((estimated > 0) & (homologated > 0), (homologated > estimated).cast("int")).alias("f_price_ratio"))
    some = sum((F.col(f).isNotNull().cast("int") for f in FLAGS), F.lit(0))
    return out.withColumn("cri", rounded(sum((F.coalesce(f, F.lit(0)) for f in FLAGS), F.lit(0)).cast("double") / F.nullif(some, F.lit(0))))


#: Flags of a contract.
FLAGS = ["f_non_competitive", "f_short_window", "f_price_ratio"]


def red_flags_by(flags: DataFrame, key: str) -> DataFrame:
    mean = lambda x: rounded(F.avg(F.col(x).cast("double")))
    return flags.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("contracts"), F.count("cri").alias("scored"), mean("cri").alias("mean_cri"), *[mean(f).alias(f"share_{f[2:]}") for f in FLAGS])


def amendments(c: DataFrame, *raw: DataFrame) -> DataFrame:
    """A row a contract, from all observations of all bronze tables in order of their crawls: first positive initial against last positive
    accumulated value, first against last end of validity, most rectifications. Equality never fires, and the last observation rules."""
    rows = reduce(DataFrame.unionByName, [r.select("dt", "ingested_at", "payload_json") for r in raw])
    p = parsed(rows, AMENDMENT_ITEM, c).select("id", "_seen", F.col("valorInicial").try_cast(MONEY).alias("initial"), F.col("valorAcumulado").try_cast(MONEY).alias("final"), F.substring("dataVigenciaFim", 1, 10).try_cast("date").alias("ends"), F.col("numeroRetificacao").try_cast("int").alias("rectifications"))
    seen = lambda f, x, ok: f(F.when(ok, F.col(x)), F.when(ok, F.struct("_seen", x)))
    found = p.groupBy("id").agg(
        seen(F.min_by, "initial", F.col("initial") > 0).alias("initial"), seen(F.max_by, "final", F.col("final") > 0).alias("final"), seen(F.min_by, "ends", F.col("ends").isNotNull()).alias("first_end"),
        seen(F.max_by, "ends", F.col("ends").isNotNull()).alias("last_end"), F.max("rectifications").alias("rectifications"), F.count(F.lit(1)).alias("observations"))
    out = c.select("id", "dt", "siafi", "doc").join(found, "id", "left")
    return out.select("id", "dt", "siafi", "doc", F.col("observations").isNotNull().alias("matched"), F.coalesce("observations", F.lit(0).cast("long")).alias("observations"), (F.col("final") > F.col("initial")).cast("int").alias("f_value"), (F.col("last_end") > F.col("first_end")).cast("int").alias("f_term"), "rectifications",
                      (F.col("final").cast("double") / F.col("initial").cast("double")).alias("ratio"))


def amendments_by(a: DataFrame, key: str) -> DataFrame:
    some = a.where(F.col(key).isNotNull() & (F.col(key) != ""))
    mean = lambda x: rounded(F.avg(F.col(x).cast("double")))
    return some.groupBy(key).agg(F.count(F.lit(1)).alias("contracts"), F.count_if("matched").alias("matched"), mean("f_value").alias("share_value"), mean("f_term").alias("share_term"), rounded(F.avg(F.col("ratio").cast("decimal(38,12)"))).alias("mean_ratio"), F.max("rectifications").alias("most_rectifications"))


TERM = "array<struct<tipoTermoContratoNome:string,qualificacaoAcrescimoSupressao:boolean,qualificacaoVigencia:boolean,valorAcrescido:string,prazoAditadoDias:string>>"


def term_flags(registered: DataFrame, terms: str = "terms") -> DataFrame:
    """registered (id, terms: a JSON array as the source has it) with the flags of its amendments.

    NULL terms (the query failed) give NULLs, an empty array gives 0. A flag fires on a term of the amendment type that says so itself and
    raises the value, or the days, above 0; index adjustments and reductions never fire. Sums and kinds are those of all terms.
    """
    t, amendment = F.from_json(terms, TERM), "Termo Aditivo"
    value, days = (lambda x: x["valorAcrescido"].try_cast(MONEY)), (lambda x: x["prazoAditadoDias"].try_cast("int"))
    fires = lambda flag, amount: F.exists(t, lambda x: F.coalesce((x["tipoTermoContratoNome"] == amendment) & x[flag] & (amount(x) > 0), F.lit(False))).cast("int")
    kinds = F.array_sort(F.array_distinct(F.filter(F.transform(t, lambda x: x["tipoTermoContratoNome"]), lambda x: F.coalesce(x != "", F.lit(False)))))
    return registered.select(
        "id", fires("qualificacaoAcrescimoSupressao", value).alias("f_value_terms"), fires("qualificacaoVigencia", days).alias("f_term_terms"), F.when(t.isNotNull(), F.size(t)).alias("terms_count"),
        F.aggregate(t, F.lit(0).cast(MONEY), lambda a, x: (a + F.coalesce(value(x), F.lit(0).cast(MONEY))).cast(MONEY)).cast("double").alias("value_increase"),
        F.aggregate(t, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(days(x), F.lit(0))).alias("days_extended"), F.array_join(kinds, ",").alias("term_types"))


POD_SAMPLE = "array<struct<pod:string,cpu_millicores:double,memory_bytes:double>>"


def pod_usage_hourly(raw: DataFrame) -> DataFrame:
    """Snapshots (ingested_at, payload_json: an array of samples of containers) by hour and pod; samples without a pod are left out."""
    rows = raw.select(F.date_trunc("hour", "ingested_at").alias("hour"), F.inline(F.from_json("payload_json", POD_SAMPLE))).where("pod is not null")
    mean = lambda x: rounded(F.avg(F.col(x).cast("decimal(38,10)")), 6)
    return rows.groupBy("hour", "pod").agg(mean("cpu_millicores").alias("avg_cpu"), F.max("cpu_millicores").alias("max_cpu"), mean("memory_bytes").alias("avg_memory"), F.max("memory_bytes").alias("max_memory"), F.count(F.lit(1)).alias("samples"))


def platform_cost_daily(hourly: DataFrame, requests: DataFrame, broadcast_rows: int = 10_000) -> DataFrame:
    """Days of hourly means beside what the components request whose pattern the pod's name is like: a row for each such pattern, one
    with NULLs if there is none. requests is a seed of a few rows; one of more than ``broadcast_rows`` raises."""
    if requests.count() > broadcast_rows:
        raise ValueError(f"more than {broadcast_rows} patterns are no seed")
    mean = lambda x: rounded(F.avg(F.col(x).cast("decimal(38,10)")))
    daily = hourly.groupBy(F.to_date("hour").alias("dt"), "pod").agg(mean("avg_cpu").alias("avg_cpu"), F.max("max_cpu").alias("max_cpu"), mean("avg_memory").alias("avg_memory"), F.max("max_memory").alias("max_memory"))
    joined = daily.join(F.broadcast(requests), F.expr("pod like pod_pattern"), "left")
    idle = lambda used, asked: rounded(1 - F.col(used) / F.nullif(F.col(asked), F.lit(0.0)))
    return joined.select("dt", "pod", "component", "avg_cpu", "request_cpu", "max_cpu", "avg_memory", "request_memory", "max_memory", idle("avg_cpu", "request_cpu").alias("cpu_idle"), idle("avg_memory", "request_memory").alias("memory_idle"))


def political_connections(signals: DataFrame, candidacies: DataFrame, crosswalk: DataFrame, donations: DataFrame) -> DataFrame:
    """The signals of political links as published: the latest by donor, candidate and year, with what the latest dumps of candidacies and
    donations and the crosswalk of electoral units add. Persons' documents leave masked, and the key is a hash."""
    at = lambda path, kind="string": F.get_json_object("details", f"$.{path}").cast(kind)
    p = signals.where("signal_type = 'political_connection'").select(
        F.col("dt").alias("signal_dt"), F.col("entity_id").alias("donor"), "score", at("election_year", "int").alias("election_year"), at("candidate.sequential").alias("candidate_sequential"), at("candidate.candidate_name").alias("candidate_name"), at("candidate.party").alias("party"),
        *[at(x, "double").alias(x) for x in ("donation_total_brl", "contracts_total_brl", "buyer_total_brl", "share")], at("contracts", "int").alias("contracts"),
        *[at(f"buyer.{x}").alias(f"buyer_{x}") for x in ("name", "city", "siafi_code")], *[at(x, "date").alias(x) for x in ("mandate_start", "mandate_end")])
    order = Window.partitionBy("donor", "candidate_sequential", "election_year").orderBy(F.desc("signal_dt"), "buyer_city")
    p = p.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    latest = lambda df: df.join(F.broadcast(df.agg(F.max("dt").alias("dt"))), "dt").drop("dt")
    c = latest(candidacies).select("election_year", "candidate_sequential", "office", "ue_code", "ue_name", "uf")
    d = latest(donations).groupBy("election_year", "candidate_sequential", F.coalesce("donor_origin_document", "donor_document").alias("donor")).agg(F.count(F.lit(1)).alias("donations"), F.min("donation_date").alias("first_donation"), F.max("donation_date").alias("last_donation"))
    out = p.join(c, ["election_year", "candidate_sequential"], "left").join(crosswalk, "ue_code", "left").join(d, ["election_year", "candidate_sequential", "donor"], "left")
    person, text = F.length("donor") == 11, lambda x: F.coalesce(F.col(x).cast("string"), F.lit(""))
    masked = F.when(person, F.concat(F.lit("***"), F.substring("donor", 4, 6), F.lit("**"))).otherwise(F.col("donor"))
    return out.select(
        F.upper(F.sha2(F.concat(text("election_year"), F.lit("|"), text("candidate_sequential"), F.lit("|"), text("donor")), 256)).alias("signal_id"), "signal_dt", "election_year", masked.alias("donor_document_masked"), F.when(person, "PF").otherwise("PJ").alias("donor_document_type"),
        "candidate_name", "party", "office", "ue_code", F.coalesce("ue_name", "buyer_city").alias("municipality"), "uf", F.coalesce("siafi_code", "buyer_siafi_code").alias("siafi_code"), "ibge_code", "buyer_name", "contracts", "donations", "first_donation", "last_donation",
        "donation_total_brl", "contracts_total_brl", "buyer_total_brl", "share", "score", "mandate_start", "mandate_end")


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Key values that occur more than once; no rows if the key is unique."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def out_of_domain(mart: DataFrame, flags: list[str], bad: str) -> DataFrame:
    """Rows whose flags are not 0, 1 or NULL, or for which the condition ``bad`` holds."""
    found = F.coalesce(F.expr(bad), F.lit(False))
    for f in flags:
        found |= F.coalesce(~F.col(f).isin(0, 1), F.lit(False))
    return mart.where(found)


def cardinality(mart: DataFrame, silver: DataFrame) -> DataFrame:
    """The two row counts if they differ."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return n(mart, "mart_rows").crossJoin(n(silver, "silver_rows")).where("mart_rows <> silver_rows")


def unmatched(mart: DataFrame, most: float = 0.01) -> DataFrame:
    """Contracts without a payload, if they are ``most`` of all or more; a mart of no rows passes."""
    row = mart.agg(F.count_if(~F.col("bronze_matched")).alias("unmatched"), F.count(F.lit(1)).alias("contracts"))
    return row.withColumn("share", rounded(F.col("unmatched") / F.nullif(F.col("contracts"), F.lit(0)))).where(F.col("share") >= most)


def not_viable(amended: DataFrame, least: float = 0.5) -> DataFrame:
    """Matched contracts and those whose value flag can be computed, if these are less than ``least``."""
    row = amended.agg(F.count_if("matched").alias("matched"), F.count_if(F.col("matched") & F.col("f_value").isNotNull()).alias("computable"))
    return row.withColumn("share", rounded(F.col("computable") / F.nullif(F.col("matched"), F.lit(0)))).where(F.col("share") < least)


def gates_broken(links: DataFrame, least_donation: float = 1000.0, least_share: float = 0.05) -> DataFrame:
    """Published political links that do not keep to the detector's gates."""
    return links.where((F.col("donation_total_brl") < least_donation) | (F.col("share") < least_share) | (F.col("score") < 0) | (F.col("score") > 1))


def unmasked(links: DataFrame) -> DataFrame:
    """Published persons' documents without a mask."""
    return links.where((F.col("donor_document_type") == "PF") & ~F.contains("donor_document_masked", F.lit("*")))


def viability(flags: DataFrame) -> DataFrame:
    """For each flag the share of contracts with enough data."""
    row = flags.agg(*[rounded(F.avg(F.col(f).isNotNull().cast("double"))).alias(f) for f in FLAGS])
    return row.select(F.stack(F.lit(len(FLAGS)), *[x for f in FLAGS for x in (F.lit(f), F.col(f))]).alias("flag", "share"))


def step_durations(metrics: DataFrame, days: int = 7) -> DataFrame:
    """Dashboard: duration of the steps of the last ``days`` days of the metrics (step, pipeline, started_at, seconds, rows, errors)."""
    recent = metrics.join(F.broadcast(metrics.agg(F.max("started_at").alias("_last"))), F.col("started_at") > F.col("_last") - F.make_interval(days=F.lit(days)))
    return recent.groupBy("step").agg(F.count(F.lit(1)).alias("runs"), rounded(F.avg(F.col("seconds").cast("decimal(38,10)"))).alias("mean_seconds"), F.max("seconds").alias("most_seconds"))


def rows_by_pipeline(metrics: DataFrame) -> DataFrame:
    """Dashboard: rows that crawling, collecting and normalising steps took in, by pipeline."""
    return metrics.where("step like 'crawl\\_%' or step like 'collect\\_%' or step = 'normalize'").groupBy("pipeline").agg(F.sum("rows").alias("rows"))


def failing_steps(metrics: DataFrame) -> DataFrame:
    """Dashboard: steps with errors."""
    return metrics.groupBy("pipeline", "step").agg(F.sum("errors").alias("errors")).where("errors > 0")


def cost_listing(cost: DataFrame) -> DataFrame:
    """Dashboard: the latest day's pods, memory in MiB, the idlest first."""
    last = cost.join(F.broadcast(cost.agg(F.max("dt").alias("dt"))), "dt")
    mib = lambda x: rounded(F.col(x) / 1048576, 2)
    return last.select("pod", "component", "avg_cpu", "request_cpu", mib("avg_memory").alias("avg_memory_mib"), mib("request_memory").alias("request_memory_mib"), "cpu_idle").orderBy(F.desc_nulls_last("cpu_idle"), "pod", "component")


def usage_listing(hourly: DataFrame, hours: int = 24) -> DataFrame:
    """Dashboard: pods of the last ``hours`` hours with their highest use."""
    recent = hourly.join(F.broadcast(hourly.agg(F.max("hour").alias("_last"))), F.col("hour") > F.col("_last") - F.make_interval(hours=F.lit(hours)))
    return recent.groupBy("pod").agg(F.max("max_cpu").alias("max_cpu"), rounded(F.max("max_memory") / 1048576, 2).alias("max_memory_mib"), F.sum("samples").alias("samples"))


def idle_by_component(cost: DataFrame) -> DataFrame:
    """Dashboard: mean idle share of the components over all days."""
    return cost.where("component is not null").groupBy("component").agg(rounded(F.avg(F.col("cpu_idle").cast("decimal(38,10)"))).alias("cpu_idle"), rounded(F.avg(F.col("memory_idle").cast("decimal(38,10)"))).alias("memory_idle"))


def portal_kpis(c: DataFrame, flags: DataFrame, quality: DataFrame, cost: DataFrame, days: int = 30) -> DataFrame:
    """One row: contracts and amount of the last ``days`` days, all contracts and those of a high index, duplicates of the latest day of
    the quality mart, and the mean idle share of the latest day."""
    recent = c.crossJoin(F.broadcast(c.agg(F.max("signature_date").alias("_last")))).where(F.col("signature_date") > F.date_sub("_last", days)).agg(F.count(F.lit(1)).alias("recent_contracts"), total().alias("recent_amount"))
    high = flags.agg(F.count(F.lit(1)).alias("contracts"), F.count_if(F.col("cri") >= 0.5).alias("high_cri"))
    twice = quality.agg(F.max_by("duplicates", "dt").alias("duplicate_ids"))
    idle = cost.join(F.broadcast(cost.agg(F.max("dt").alias("dt"))), "dt").agg(rounded(F.avg(F.col("cpu_idle").cast("decimal(38,10)"))).alias("mean_idle"))
    return recent.crossJoin(high).crossJoin(twice).crossJoin(idle)
