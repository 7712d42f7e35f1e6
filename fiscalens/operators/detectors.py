"""Risk detectors: pure functions from contracts (flat columns) and reference tables to scores by entity."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import plain_text
from ..functions.rounding import rounded
from ..functions.storage import written
from .marts import non_competitive, total
from .quality import quantiles

SIGNAL = ["entity_type", "entity_id", "signal_type", "score"]


def signals(df: DataFrame, entity_type: str, signal_type: str, entity: str, score: str = "score") -> DataFrame:
    return df.select(F.lit(entity_type).alias("entity_type"), F.col(entity).alias("entity_id"), F.lit(signal_type).alias("signal_type"), F.col(score).cast("double").alias("score"))


def leading_digit(x: Column) -> Column:
    return F.floor(x / F.pow(F.lit(10.0), F.floor(F.log10(x)))).cast("int")


def benford(c: DataFrame, key: str = "doc", minimum: int = 10) -> DataFrame:
    """By key: chi-square of the leading digits of positive amounts against Benford's law, its p-value (8 degrees of freedom, in closed
    form) and 1 - p as deviation, for keys with ``minimum`` amounts."""
    d = c.where(F.col(key).isNotNull() & (F.col("amount") > 0)).select(key, leading_digit(F.col("amount").cast("double")).alias("_d"))
    counts = d.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("_d") == i).alias(f"_{i}") for i in range(1, 10)])
    chi = F.lit(0.0)
    for i in range(1, 10):
        expected = F.col("n") * F.lit(math.log10(1 + 1 / i))
        chi += (F.col(f"_{i}") - expected) * (F.col(f"_{i}") - expected) / expected
    h = F.col("_chi") / 2
    p = F.exp(-h) * (1 + h + h * h / 2 + h * h * h / 6)
    out = counts.withColumn("_chi", chi).select(key, "n", rounded(F.col("_chi"), 6).alias("chi_square"), rounded(p).alias("p_value"))
    return out.where(F.col("n") >= minimum).withColumn("deviation", rounded(1 - F.col("p_value")))


def non_competitive_rate(c: DataFrame, key: str = "doc") -> DataFrame:
    flag = (F.lower("modality").contains("dispensa") | F.lower("modality").contains("inexigibilidade")).cast("int")
    return c.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("contracts"), rounded(F.sum(F.coalesce(flag, F.lit(0))) / F.count(F.lit(1))).alias("rate"))


def hhi(c: DataFrame, key: str = "siafi") -> DataFrame:
    """By buyer: sum of squared supplier shares of the amount; rows without supplier count in neither sum nor total. 0 without rows."""
    by = c.where("doc is not null").groupBy(key, "doc").agg(F.sum("amount").cast("double").alias("s"))
    share = F.col("s") / F.sum("s").over(Window.partitionBy(key))
    found = by.withColumn("_q", share * share).groupBy(key).agg(rounded(F.sum("_q")).alias("hhi"), F.count(F.lit(1)).alias("suppliers"))
    return c.groupBy(key).agg(F.count(F.lit(1)).alias("contracts")).join(found, key, "left").select(key, "contracts", F.coalesce("hhi", F.lit(0.0)).alias("hhi"), F.coalesce("suppliers", F.lit(0).cast("long")).alias("suppliers"))


def with_duration(c: DataFrame) -> DataFrame:
    return c.withColumn("duration", F.datediff("validity_end", "validity_start"))


def duration_outliers(c: DataFrame, method: str = "iqr") -> DataFrame:
    """Contracts with outlier: duration beyond the pooled quartiles by 1.5 ranges, or beyond 3 population deviations. NULL is no outlier."""
    d = with_duration(c)
    if method == "iqr":
        fence = quantiles(d, "duration", [0.25, 0.75]).select(F.col("q0").alias("_q1"), F.col("q1").alias("_q3"))
        range_ = F.col("_q3") - F.col("_q1")
        outlier = (F.col("duration") < F.col("_q1") - 1.5 * range_) | (F.col("duration") > F.col("_q3") + 1.5 * range_)
    elif method == "zscore":
        fence = d.agg(F.avg("duration").alias("_mean"), F.stddev_pop("duration").alias("_sd"))
        outlier = F.abs(F.col("duration") - F.col("_mean")) > 3 * F.col("_sd")
    else:
        raise ValueError(f"no such method: {method}")
    return d.crossJoin(F.broadcast(fence)).select("id", "doc", "duration", F.coalesce(outlier, F.lit(False)).alias("outlier"))


def duration_share(c: DataFrame, minimum: int = 4) -> DataFrame:
    """By supplier: share of durations that are outliers within the supplier's own quartiles."""
    d = with_duration(c).where("doc is not null and duration is not null")
    own = quantiles(d, "duration", [0.25, 0.75], ["doc"]).select("doc", F.col("q0").alias("_q1"), F.col("q1").alias("_q3"), "n").where(F.col("n") >= minimum)
    range_ = F.col("_q3") - F.col("_q1")
    hit = (F.col("duration") < F.col("_q1") - 1.5 * range_) | (F.col("duration") > F.col("_q3") + 1.5 * range_)
    return d.join(own, "doc").groupBy("doc").agg(F.first("n").alias("n"), rounded(F.avg(hit.cast("double"))).alias("share"))


def details(**inputs: Column | str | int | float) -> Column:
    """What a score comes of, and the thresholds that it passed, as JSON with sorted names; fractions at four decimals."""
    def plain(x: Column | str | int | float) -> Column:
        return x if isinstance(x, Column) else F.lit(x)

    return F.to_json(F.struct(*[plain(x).alias(name) for name, x in sorted(inputs.items())]))


def fraction(x: str) -> Column:
    return F.col(x).cast("decimal(18,4)")


def with_details(df: DataFrame, entity_type: str, signal_type: str, entity: str, score: str, found: Column) -> DataFrame:
    return df.select(F.lit(entity_type).alias("entity_type"), F.col(entity).cast("string").alias("entity_id"), F.lit(signal_type).alias("signal_type"), F.col(score).cast("double").alias("score"), found.alias("details"))


def statistical_signals(c: DataFrame, minimum: int = 3) -> DataFrame:
    """The four statistical signals with their details: anomalous_price, single_bid (rate above 0), concentration, anomalous_duration; the
    last three from ``minimum`` contracts."""
    least = {"min_contracts": minimum}
    price = with_details(benford(c).where("deviation is not null"), "supplier", "anomalous_price", "doc", "deviation", details(benford_deviation=fraction("deviation"), contracts=F.col("n"), p_value=fraction("p_value"), min_contracts=10))
    bids = with_details(non_competitive_rate(c).where((F.col("rate") > 0) & (F.col("contracts") >= minimum)), "supplier", "single_bid", "doc", "rate", details(contracts=F.col("contracts"), rate=fraction("rate"), **least))
    focus = with_details(hhi(c).where((F.col("contracts") >= minimum) & F.col("siafi").isNotNull()), "buyer", "concentration", "siafi", "hhi", details(contracts=F.col("contracts"), hhi=fraction("hhi"), suppliers=F.col("suppliers"), **least))
    spans = duration_outliers(c).where("doc is not null and duration is not null").groupBy("doc").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg(F.col("outlier").cast("double"))).alias("score"))
    spans = with_details(spans.where((F.col("n") >= minimum) & (F.col("score") > 0)), "supplier", "anomalous_duration", "doc", "score", details(contracts=F.col("n"), method="iqr", outlier_share=fraction("score"), **least))
    return price.unionByName(bids).unionByName(focus).unionByName(spans)


def fraud_signals(c: DataFrame) -> DataFrame:
    """The four statistical signals without details."""
    return statistical_signals(c).drop("details")


def by_document(sanctions: DataFrame) -> DataFrame:
    docs = F.explode(F.array_distinct(F.array_compact(F.array(F.nullif("cnpj", F.lit("")), F.nullif("cpf", F.lit(""))))))
    return sanctions.select(F.col("id").alias("sanction"), "list_name", "sanctioned_name", "start_date", "end_date", docs.alias("doc"))


def sanctioned_suppliers(c: DataFrame, sanctions: DataFrame) -> DataFrame:
    """Suppliers with a contract signed while a sanction on their document was in force; an open end is in force for ever, no start never."""
    s = by_document(sanctions)
    hit = c.select("id", "doc", "signature_date").join(s, "doc").where(F.col("signature_date").between(F.col("start_date"), F.coalesce("end_date", F.lit("9999-12-31").cast("date"))))
    return hit.groupBy("doc").agg(F.array_join(F.array_sort(F.collect_set("sanction")), ",").alias("sanctions"), F.array_join(F.array_sort(F.collect_set("list_name")), ",").alias("lists"), F.countDistinct("id").alias("contracts")).withColumn("score", F.lit(1.0))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(a))


def supplier_company(c: DataFrame, companies: DataFrame) -> DataFrame:
    """Company suppliers linked to the registry's company of their number's first eight digits: cnpj, cnpj_basico, score 1."""
    s = c.where("length(cnpj) = 14").select("cnpj").distinct().withColumn("cnpj_basico", F.substring("cnpj", 1, 8))
    return s.join(companies.select("cnpj_basico").distinct(), "cnpj_basico").select("cnpj", "cnpj_basico", F.lit(1.0).alias("score"))


def seats(establishments: DataFrame, codes: DataFrame, places: DataFrame) -> DataFrame:
    """The places of establishments by way of the registry's own town codes: cnpj, ibge_code, latitude, longitude. An establishment whose
    code, name or state leads nowhere is not there, and a head office that resolves comes before branches."""
    named = establishments.where("length(cnpj) = 14").join(codes.select(F.col("tom_code").alias("municipio"), F.col("name").alias("city")), "municipio")
    return supplier_places(named, places)


def supplier_places(establishments: DataFrame, places: DataFrame) -> DataFrame:
    """A place by supplier among those that resolve: the head office, else the branch of the smallest code."""
    p = places.select(plain_text(F.col("name")).alias("_name"), F.upper("uf").alias("_uf"), "ibge_code", "latitude", "longitude")
    p = p.groupBy("_name", "_uf").agg(F.min(F.struct("ibge_code", "latitude", "longitude")).alias("_p")).select("_name", "_uf", "_p.*")
    found = establishments.join(p, (plain_text(F.col("city")) == F.col("_name")) & (F.upper(F.trim("uf")) == F.col("_uf")))
    return found.groupBy("cnpj").agg(F.min_by(F.struct("ibge_code", "latitude", "longitude"), F.struct(~F.col("is_matriz"), F.col("ibge_code"))).alias("p")).select("cnpj", "p.*")


def anomalous_geography(c: DataFrame, establishments: DataFrame, places: DataFrame, least_km: float = 100.0) -> DataFrame:
    """By company and buyer's place: contracts, amount and distance where it is beyond ``least_km``; score is thousands of km, 1 at most."""
    home = supplier_places(establishments, places).select("cnpj", F.col("latitude").alias("_la"), F.col("longitude").alias("_lo"))
    buyer = places.select(plain_text(F.col("name")).alias("_name"), F.col("uf").alias("_uf"), "ibge_code", "latitude", "longitude")
    sums = c.where("length(cnpj) = 14").groupBy("cnpj", "city", "uf").agg(F.count(F.lit(1)).alias("contracts"), total().alias("total_amount"))
    out = sums.join(buyer, (plain_text(F.col("city")) == F.col("_name")) & (F.col("uf") == F.col("_uf"))).join(home, "cnpj")
    out = out.withColumn("km", haversine_km(F.col("_la"), F.col("_lo"), F.col("latitude"), F.col("longitude"))).where(F.col("km") > least_km)
    return out.select("cnpj", "ibge_code", "contracts", "total_amount", rounded(F.col("km"), 6).alias("distance_km"), rounded(F.least(F.lit(1.0), F.col("km") / 1000)).alias("score"))


def political_links(c: DataFrame, donations: DataFrame, candidacies: DataFrame, least_donation: float = 1000.0, least_share: float = 0.05, full_share: float = 0.25, first: str = "2025-01-01", last: str = "2028-12-31", office: str = "prefeito") -> DataFrame:
    """Suppliers who gave ``least_donation`` to an elected mayor and then hold a share of the town's contracts signed in the mandate: a
    row by town, supplier and candidate, with details as JSON.

    The donor is the origin of the money where it is named. The town's total counts contracts without a supplier too; a supplier's
    donations are those to all elected candidates of the town. The buyer named is that of the town's smallest contract id.
    """
    town = lambda x: plain_text(F.col(x))
    won = F.lower(F.trim("totalization_status")).startswith("eleito") & (F.lower(F.trim("office")) == office)
    elected = candidacies.where(won & F.col("candidate_sequential").isNotNull()).select("candidate_sequential", "election_year", "candidate_name", "party", "ue_name", town("ue_name").alias("_city"), F.coalesce("uf", F.lit("")).alias("_uf"))
    donor = F.nullif(F.regexp_replace(F.coalesce(F.nullif("donor_origin_document", F.lit("")), "donor_document"), r"\D", ""), F.lit(""))
    given = donations.groupBy("election_year", "candidate_sequential", donor.alias("doc")).agg(F.sum(F.col("amount").cast("decimal(38,4)")).alias("_given")).where((F.col("_given") >= least_donation) & F.col("doc").isNotNull())
    given = given.join(elected, ["election_year", "candidate_sequential"])
    all_given = given.groupBy("_city", "_uf", "doc").agg(F.sum("_given").cast("double").alias("donated"))
    signed = c.where(F.col("signature_date").between(F.lit(first).cast("date"), F.lit(last).cast("date"))).withColumns({"_city": town("city"), "_uf": F.coalesce("uf", F.lit(""))}).where("_city <> '' and _uf <> ''")
    buyer = F.struct("city", F.col("agency").alias("name"), F.col("siafi").alias("siafi_code"), "uf")
    towns = signed.groupBy("_city", "_uf").agg(F.sum("amount").cast("double").alias("town_total"), F.min_by(buyer, "id").alias("buyer"))
    own = signed.where("doc is not null").groupBy("_city", "_uf", "doc").agg(F.sum("amount").cast("double").alias("supplier_total"), F.countDistinct("id").alias("contracts"))
    out = own.join(towns, ["_city", "_uf"]).where("town_total > 0").withColumn("share", F.col("supplier_total") / F.col("town_total")).where(F.col("share") >= least_share)
    out = out.join(all_given, ["_city", "_uf", "doc"]).join(given.drop("_given"), ["_city", "_uf", "doc"])
    money = lambda x: rounded(F.col(x), 2)
    candidate = F.struct("candidate_name", "election_year", "party", F.col("candidate_sequential").alias("sequential"), "ue_name", F.col("_uf").alias("uf"))
    details = F.to_json(F.struct("buyer", money("town_total").alias("buyer_total_brl"), candidate.alias("candidate"), "contracts", money("supplier_total").alias("contracts_total_brl"), money("donated").alias("donation_total_brl"), F.col("doc").alias("donor_document"), "election_year",
                                 F.lit(last).alias("mandate_end"), F.lit(first).alias("mandate_start"), F.lit("document").alias("match"), rounded(F.col("share")).alias("share")))
    return out.select(F.col("_city").alias("city"), F.col("_uf").alias("uf"), "doc", "candidate_sequential", "election_year", money("donated").alias("donated"), "contracts", rounded(F.col("share")).alias("share"), rounded(F.least(F.lit(1.0), F.col("share") / full_share)).alias("score"), details.alias("details"))


def eligibility(c: DataFrame, min_wins: int = 3) -> DataFrame:
    """Pairs of buyer and company with ``min_wins`` contracts."""
    return c.where("siafi is not null and cnpj is not null").groupBy(F.col("siafi").alias("buyer"), F.col("cnpj").alias("supplier")).agg(F.count(F.lit(1)).alias("wins")).where(F.col("wins") >= min_wins)


def blocked(eligible: DataFrame, min_buyers: int = 2) -> DataFrame:
    """Without suppliers that too few buyers have: no pair is lost by it."""
    some = eligible.groupBy("supplier").agg(F.countDistinct("buyer").alias("_n")).where(F.col("_n") >= min_buyers)
    return eligible.join(some.select("supplier"), "supplier", "left_semi")


def projected_pairs(eligible: DataFrame, min_buyers: int = 2) -> DataFrame:
    """How many pairs a derivation would make, without and with blocking; for a guard before it."""
    count = lambda df: df.groupBy("buyer").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).cast("long").alias("pairs"))
    return count(eligible).select(F.lit("unblocked").alias("kind"), "pairs").unionByName(count(blocked(eligible, min_buyers)).select(F.lit("blocked").alias("kind"), "pairs"))


#: Suppliers of a buyer that meet in one cell.
CELL = 512


def collusion_pairs(eligible: DataFrame, min_buyers: int = 2, most_pairs: int | None = 1_000_000) -> DataFrame:
    """Pairs of companies that win together at ``min_buyers`` buyers: buyers, their number and the wins of both there.

    The projection is counted first, and one of more than ``most_pairs`` raises instead of exploding; None lets any pass. A buyer of more
    than CELL suppliers falls into parts, and each pair of parts is joined by itself.
    """
    eligible = written(eligible, "eligible")
    b = written(blocked(eligible, min_buyers), "blocked")
    if most_pairs is not None and (n := projected_pairs(eligible, min_buyers).where("kind = 'blocked'").first()["pairs"]) > most_pairs:
        raise ValueError(f"{n} projected pairs are more than {most_pairs}")
    size = b.groupBy("buyer").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("long").alias("_parts"))
    dealt = b.join(size, "buyer").withColumn("_part", F.pmod(F.xxhash64("supplier"), F.col("_parts"))).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    dealt = dealt.withColumns({"_u": F.least("_part", "_other"), "_v": F.greatest("_part", "_other")})
    x, y = (dealt.select("buyer", "_u", "_v", F.col("_part").alias(f"_p{i}"), F.col("supplier").alias(f"s{i}"), F.col("wins").alias(f"_w{i}")) for i in (1, 2))
    met = x.join(y, ["buyer", "_u", "_v"]).where("s1 < s2 and (_u = _v or _p1 <> _p2)")
    pairs = met.groupBy("s1", "s2").agg(F.count(F.lit(1)).alias("buyer_count"), F.sum(F.col("_w1") + F.col("_w2")).alias("wins_sum"), F.array_join(F.array_sort(F.collect_set("buyer")), ",").alias("buyers"))
    return pairs.where(F.col("buyer_count") >= min_buyers)


def ranked(pairs: DataFrame, top_k: int = 500) -> DataFrame:
    """The first ``top_k`` pairs with the share of all pairs that they are (1 if there are none)."""
    pairs = written(pairs, "pairs")
    top = pairs.orderBy(F.desc("buyer_count"), F.desc("wins_sum"), "s1", "s2").limit(top_k)
    share = pairs.agg(F.count(F.lit(1)).alias("_n")).select(rounded(F.least(F.lit(1.0), F.lit(top_k) / F.greatest(F.col("_n"), F.lit(1)))).alias("coverage"))
    return top.crossJoin(F.broadcast(share))


def collusion_signals(top: DataFrame) -> DataFrame:
    """Ranked pairs as signals: the pair as entity, score 1."""
    return top.select(F.lit("supplier_pair").alias("entity_type"), F.concat_ws("+", "s1", "s2").alias("entity_id"), F.lit("collusion").alias("signal_type"), F.lit(1.0).alias("score"), "buyers", "wins_sum")


def wins_histogram(c: DataFrame, top: int = 10) -> DataFrame:
    """Pairs of buyer and company by number of contracts, those of ``top`` or more together."""
    won = eligibility(c, 1)
    return won.groupBy(F.least("wins", F.lit(top).cast("long")).alias("wins")).agg(F.count(F.lit(1)).alias("pairs"))


def daily_increment(c: DataFrame, days: int = 30, min_wins: int = 2, min_buyers: int = 2) -> DataFrame:
    """Projected pairs that a day adds, as a mean of the last ``days`` days: all pairs, those without that window, and their difference a day."""
    last = c.agg(F.max("signature_date").alias("_last"))
    before = c.join(F.broadcast(last)).where(F.col("signature_date") <= F.date_sub("_last", days)).drop("_last")
    count = lambda df, name: projected_pairs(eligibility(df, min_wins), min_buyers).where("kind = 'blocked'").select(F.col("pairs").alias(name))
    return count(c, "all_pairs").crossJoin(count(before, "older_pairs")).withColumn("a_day", rounded((F.col("all_pairs") - F.col("older_pairs")) / days))


def first_candidate(grid: DataFrame, most_pairs: int = 1_000_000) -> DataFrame:
    """The loosest thresholds of a calibration grid whose projection keeps to the budget; no row if none does."""
    return grid.where(F.col("pairs") <= most_pairs).orderBy("min_wins", "min_buyers").limit(1)


def single_bid_rate(bids: DataFrame, key: str) -> DataFrame:
    """By key the share of biddings with a single participant."""
    return bids.groupBy(key).agg(F.count(F.lit(1)).alias("biddings"), rounded(F.coalesce(F.avg((F.col("participants") == 1).cast("double")), F.lit(0.0))).alias("rate"))


def calibration(c: DataFrame, wins: tuple[int, ...] = (2, 3, 4), buyers: tuple[int, ...] = (2, 3)) -> DataFrame:
    """Projected pairs, with blocking, for a grid of thresholds."""
    out = None
    for w in wins:
        e = eligibility(c, w)
        for b in buyers:
            row = projected_pairs(e, b).where("kind = 'blocked'").select(F.lit(w).alias("min_wins"), F.lit(b).alias("min_buyers"), "pairs")
            out = row if out is None else out.unionByName(row)
    return out


def risk_index(c: DataFrame, forest: DataFrame | None = None) -> DataFrame:
    """Weighted mean by supplier (none is 'unknown') of the signals that pass their gates: non-competitive share .35, buyer concentration
    .35, price .15 (the larger of Benford's deviation and the share of ``forest``: doc, forest_rate), own durations .15; alert from .7."""
    s = c.select("siafi", "modality", "amount", "validity_start", "validity_end", F.coalesce("doc", F.lit("unknown")).alias("doc"))
    by_buyer = s.groupBy("siafi", "doc").agg(F.sum("amount").cast("double").alias("s"))
    share = F.col("s") / F.sum("s").over(Window.partitionBy("siafi"))
    focus = by_buyer.withColumn("_q", share * share).withColumn("hhi", F.sum("_q").over(Window.partitionBy("siafi"))).groupBy("doc").agg(rounded(F.max("hhi")).alias("hhi"))
    out = non_competitive_rate(s).join(focus, "doc", "left").join(benford(s).select("doc", "p_value", "deviation"), "doc", "left").join(duration_share(s).select("doc", "share"), "doc", "left")
    out = out.join(forest.select("doc", "forest_rate"), "doc", "left") if forest is not None else out.withColumn("forest_rate", F.lit(None).cast("double"))
    price = F.greatest(F.when(F.col("p_value") < 0.05, F.col("deviation")), F.when(F.col("forest_rate") >= 0.2, F.col("forest_rate")))
    parts = [(F.col("rate") >= 0.5, F.col("rate"), 0.35), (F.col("hhi") >= 0.25, F.col("hhi"), 0.35), (price.isNotNull(), F.coalesce(price, F.lit(0.0)), 0.15), (F.col("share") >= 0.2, F.col("share"), 0.15)]
    weight = sum((F.when(gate, F.lit(w)).otherwise(0.0) for gate, _, w in parts), F.lit(0.0))
    value = sum((F.when(gate, x * w).otherwise(0.0) for gate, x, w in parts), F.lit(0.0))
    index = rounded(F.coalesce(value / F.nullif(weight, F.lit(0.0)), F.lit(0.0)))
    return out.select("doc", "contracts", index.alias("risk")).withColumn("alert", F.col("risk") >= 0.7)


def municipal_ranking(c: DataFrame, top_k: int = 50, uf: str | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    """Towns by half their concentration plus half their non-competitive share, of a state and a period of signatures if these are given;
    persons without company number are one group."""
    for some, given in ((F.col("uf") == uf, uf), (F.col("signature_date") >= F.lit(first).cast("date"), first), (F.col("signature_date") <= F.lit(last).cast("date"), last)):
        c = c if given is None else c.where(some)
    by = c.groupBy("city", "uf", "cnpj").agg(F.sum("amount").cast("double").alias("s"), F.count(F.lit(1)).alias("n"), F.count_if(non_competitive(F.col("modality")) == 1).alias("k"))
    share = F.col("s") / F.sum("s").over(Window.partitionBy("city", "uf"))
    town = by.withColumn("_q", share * share).groupBy("city", "uf").agg(F.sum("n").alias("contracts"), rounded(F.sum("_q")).alias("hhi"), rounded(F.sum("k") / F.sum("n")).alias("rate"))
    return town.withColumn("risk", rounded(F.least(F.col("hhi") * 0.5 + F.col("rate") * 0.5, F.lit(1.0)))).orderBy(F.desc("risk"), "city", "uf").limit(top_k)
