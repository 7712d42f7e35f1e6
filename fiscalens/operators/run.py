"""All detectors over one set of tables: the signals of a run, and what became of each detector."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import written
from . import detectors as D
from . import text as T

SIGNAL = [*D.SIGNAL, "details"]


class Detection(NamedTuple):
    """signals: entity_type, entity_id, signal_type, score, details (JSON: inputs and thresholds). status: a row a detector: detector, state
    (ran, no input, or skipped), signals, projected_pairs (of collusion)."""

    signals: DataFrame
    status: DataFrame


def run_detection(
    c: DataFrame, sanctions: DataFrame | None = None, establishments: DataFrame | None = None, places: DataFrame | None = None, donations: DataFrame | None = None, candidacies: DataFrame | None = None, listed_names: DataFrame | None = None,
    notices: DataFrame | None = None, forest: DataFrame | None = None, min_wins: int = 3, min_buyers: int = 2, top_k: int = 500, most_pairs: int | None = None, least_km: float = 100.0, clone_threshold: float = 0.85, **political,
) -> Detection:
    """Signals of every detector whose tables are given; those of contracts alone always.

    Detectors are independent of each other. Collusion is derived in cells whatever the size of its projection, and its first ``top_k``
    pairs are signals; with ``most_pairs`` a larger projection is not derived, and the status says so. ``listed_names`` are sanctions for the
    screening by names and masked documents; ``forest`` (doc, forest_rate) joins Benford's deviation in the price signal.
    """
    parts, state, projected = [D.statistical_signals(c)], {}, None
    names = {"anomalous_price": True, "single_bid": True, "concentration": True, "anomalous_duration": True}
    if forest is not None:
        rates = D.with_details(forest.where("forest_rate is not null"), "supplier", "anomalous_price", "doc", "forest_rate", D.details(isolation_forest_rate=D.fraction("forest_rate")))
        price = parts[0].where("signal_type = 'anomalous_price'").unionByName(rates)
        best = price.groupBy("entity_type", "entity_id", "signal_type").agg(F.max("score").alias("score"), F.max_by("details", F.struct("score", "details")).alias("details"))
        parts[0] = parts[0].where("signal_type <> 'anomalous_price'").unionByName(best)
    names["sanctioned_supplier"] = sanctions is not None
    if sanctions is not None:
        parts.append(D.with_details(D.sanctioned_suppliers(c, sanctions), "supplier", "sanctioned_supplier", "doc", "score", D.details(contracts=F.col("contracts"), lists=F.split("lists", ","), sanctions=F.split("sanctions", ","))))
    names["sanctioned_name_match"] = listed_names is not None
    if listed_names is not None:
        parts.append(D.with_details(T.fuzzy_screening(c, listed_names), "supplier", "sanctioned_name_match", "entity", "score", D.details(contracts=F.col("contracts"), list=F.col("list_name"), sanctions=F.col("sanctions"))))
    names["anomalous_geography"] = establishments is not None and places is not None
    if names["anomalous_geography"]:
        far = D.details(contracts=F.col("contracts"), contracts_total_brl=F.col("total_amount").cast("decimal(38,2)"), distance_km=F.col("distance_km").cast("decimal(18,6)"), ibge_code=F.col("ibge_code"), max_distance_km=F.lit(least_km).cast("decimal(18,4)"))
        parts.append(D.with_details(D.anomalous_geography(c, establishments, places, least_km), "supplier", "anomalous_geography", "cnpj", "score", far))
    names["political_connection"] = donations is not None and candidacies is not None
    if names["political_connection"]:
        parts.append(D.with_details(D.political_links(c, donations, candidacies, **political), "supplier", "political_connection", "doc", "score", F.col("details")))
    names["notice_clone"] = notices is not None
    if notices is not None:
        pair = T.sparse_clones(notices, clone_threshold).withColumn("entity", T.pair_key(F.col("doc_id").cast("string"), F.col("old_id").cast("string"))).withColumn("score", D.rounded(F.col("similarity")))
        parts.append(D.with_details(pair, "notice_pair", "notice_clone", "entity", "score", D.details(notice=F.col("doc_id"), older_notice=F.col("old_id"), similarity=F.col("similarity").cast("decimal(18,6)"), threshold=F.lit(clone_threshold).cast("decimal(18,4)"))))
    eligible = written(D.eligibility(c, min_wins), "run-eligible")
    projected = D.projected_pairs(eligible, min_buyers).where("kind = 'blocked'").first()["pairs"]
    names["collusion"] = True
    if most_pairs is not None and projected > most_pairs:
        state["collusion"] = f"skipped: {projected} projected pairs are more than {most_pairs}"
    else:
        top = D.ranked(D.collusion_pairs(eligible, min_buyers, None), top_k)
        found = D.details(buyers=F.split("buyers", ","), min_buyers=min_buyers, min_wins=min_wins, suppliers=F.split("entity_id", r"\+"), wins_sum=F.col("wins_sum"))
        parts.append(D.collusion_signals(top).withColumn("details", found))
    signals = written(reduce(DataFrame.unionByName, [p.select(*SIGNAL) for p in parts]), "signals")
    states = [(name, state.get(name, "ran" if given else "no input"), projected if name == "collusion" else None) for name, given in names.items()]
    known = c.sparkSession.createDataFrame(states, "detector string, state string, projected_pairs long")
    counts = signals.groupBy(F.col("signal_type").alias("detector")).agg(F.count(F.lit(1)).alias("signals"))
    status = known.join(counts, "detector", "left").select("detector", "state", F.coalesce("signals", F.lit(0).cast("long")).alias("signals"), "projected_pairs")
    return Detection(signals, status)
