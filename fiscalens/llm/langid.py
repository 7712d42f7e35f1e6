"""Language identification by Bayesian evidence fusion: text likelihoods, declared language, address suffix and host priors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import shielded, written
from .textkernel import flat, pieces

GRAMS = 1 << 13
_FOLD = np.arange(256, dtype=np.int32)
_FOLD[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC3:] = True
#: Bytes of runs that count for a language's band: parts of letters, and the white space between words.
_WORDY = _LETTER.copy()
_WORDY[[0x0A, 0x20]] = _WORDY[0x80:] = True
#: Length classes of a band (by powers of two), rows that a class must have, and the least and most width of a band below its median.
CLASSES, CLASS_ROWS, LEAST_WIDTH, MOST_WIDTH = 32, 20, 1.5, 3.0
SCORES = "struct<ll:array<double>,mean:array<float>,n:int>"


def _within(n: int, at: np.ndarray) -> np.ndarray:
    """Which of ``n`` three-byte runs do not reach into the next text."""
    keep = np.ones(n, bool)
    for back in (1, 2):
        ends = at[1:-1] - back
        keep[ends[(ends >= 0) & (ends < n)]] = False
    return keep


def grams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all three-byte runs within texts, ASCII in lower case, and for each text where its first one stands."""
    if len(data) < 3:
        return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
    b = _FOLD[data]
    h = (b[:-2] * 7919 + b[1:-1] * 263 + b[2:]) & (GRAMS - 1)
    keep = _within(len(h), at)
    return h[keep], np.concatenate([[0], np.cumsum(keep)])[np.minimum(at, len(h))]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        labels = batch.column(0).to_pylist()
        for lo, hi in pieces(batch.column(1), 1 << 20):
            h, first = grams(*flat(batch.column(1).slice(lo, hi - lo)))
            for i in range(hi - lo):
                total.setdefault(labels[lo + i], np.zeros(GRAMS, np.int64))
                total[labels[lo + i]] += np.bincount(h[first[i] : first[i + 1]], minlength=GRAMS)
    if total:
        yield pa.record_batch([pa.array(list(total), pa.string()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["label", "counts"])


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    """The counts of one label, a row a task, as one row."""
    total = np.sum([np.frombuffer(x, np.int64) for x in pdf["counts"]], axis=0)
    return pd.DataFrame({"label": pdf["label"].iloc[:1], "counts": [total.tobytes()]})


def label_report(labelled: DataFrame, label: str = "lang", most_languages: int = 1000) -> DataFrame:
    """A row for each language tag among the labels: tag (folded), name (its most frequent spelling, the first by bytes of equals), rows, place (from 0,
    by rows, then tag; null beyond ``most_languages``). Only the first ``most_languages`` rows are sorted; the rest are counted alone."""
    spelled = F.trim(F.col(label).cast("string"))
    counts = labelled.where(_tag(spelled).isNotNull()).groupBy(_tag(spelled).alias("tag"), spelled.alias("name")).agg(F.count(F.lit(1)).alias("n"))
    tags = counts.groupBy("tag").agg(F.sum("n").alias("rows"), F.min(F.struct((-F.col("n")).alias("_n"), "name"))["name"].alias("name"))
    tags = written(tags, "language-labels")
    first = [r.tag for r in tags.orderBy(F.desc("rows"), "tag").limit(most_languages).collect()]
    places = tags.sparkSession.createDataFrame(list(zip(first, range(len(first)), strict=True)), "tag string, place int")
    return tags.join(F.broadcast(places), "tag", "left")


def fit_text_model(labelled: DataFrame, label: str = "lang", text: str = "text", key: str = "doc_id", sample_rows: int = 20_000, tasks: int = 8, least_rows: int = 1000, most_languages: int = 1000) -> tuple[list[str], np.ndarray]:
    """Languages in order of name, and log probabilities of their three-byte runs (languages by runs).

    Labels that differ in case, outer spaces, or hyphen and underscore are one language, named as it is spelled most. The
    ``most_languages`` labels of most rows are languages, which bounds the model to as many times 64 KB; what else a dirty column holds is no
    language, and label_report tells how many rows that is. The model is fitted on a sample of about ``sample_rows`` labelled rows, dealt evenly over
    the languages but ``least_rows`` for each at least, chosen by a hash of key and text; a label of fewer rows has all of them, and texts
    are taken whole. The tasks' counts are summed by label; one row of counts a language, the model itself, reaches the driver. Without
    labelled rows there are no languages.
    """
    some = labelled.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(_tag(F.col(label)).alias("_tag"), F.trim(F.col(label).cast("string")).alias("_spelled"), F.col(text).alias("_text"), F.col(key).alias("_key"))
    known = label_report(some, "_spelled", most_languages).where("place is not null").select("tag", "name", "rows").collect()
    if not known:
        return [], np.zeros((0, GRAMS), np.float32)
    most, whole = max(least_rows, sample_rows // len(known)), 1 << 40
    shares = labelled.sparkSession.createDataFrame([(r.tag, r.name, whole if r.rows <= most else max(1, whole * most // r.rows)) for r in known], "_tag string, _label string, _below long")
    chosen = some.join(F.broadcast(shares), "_tag").where(F.pmod(F.xxhash64("_key", "_text"), F.lit(whole)) < F.col("_below")).select("_label", "_text")  # most_languages rows at most
    counts: dict[str, np.ndarray] = {}
    summed = chosen.repartition(tasks).mapInArrow(_counted, "label string, counts binary").groupBy("label").applyInPandas(_added, "label string, counts binary")
    for r in summed.collect():
        counts[r.label] = np.frombuffer(r.counts, np.int64)
    names = sorted(counts)
    table = np.array([np.log((counts[x] + 0.5) / (counts[x].sum() + 0.5 * GRAMS)) for x in names]).reshape(len(names), GRAMS)
    return names, table.astype(np.float32)


def text_scores(names: list[str], table: np.ndarray, most_evidence: float = 200.0):
    """A function of texts that gives for each language the log likelihood (ll) and its mean over the runs of letters and white space
    (mean), and the number of these runs (n); ll is null for a text without letters.

    Runs of a text are not independent, so n of them count as n / (1 + n / most_evidence).
    """
    @F.arrow_udf(SCORES)
    def scores(column: pa.Array) -> pa.Array:
        out, means, counts = [], [], []
        for lo, hi in pieces(column, 1 << 20):
            data, at = flat(column.slice(lo, hi - lo))
            h, first = grams(data, at)
            n = np.diff(first)
            letters = np.diff(np.concatenate([[0], np.cumsum(_LETTER[data])])[at])
            sums, mean = np.zeros((hi - lo, len(names))), np.zeros((hi - lo, len(names)))
            wordy = np.zeros(hi - lo, np.int64)
            full = np.flatnonzero(n)
            if len(full):
                w = _WORDY[data]
                w = (w[:-2] & w[1:-1] & w[2:])[_within(len(data) - 2, at)]
                begin = first[:-1][full]
                wordy[full] = np.add.reduceat(w, begin, dtype=np.int64)
                for k in range(len(names)):
                    x = table[k][h]
                    sums[full, k] = np.add.reduceat(x, begin, dtype=np.float64)
                    mean[full, k] = np.add.reduceat(x * w, begin, dtype=np.float64)
            mean /= np.maximum(1, wordy)[:, None]
            sums *= (1 / (1 + n / most_evidence))[:, None]
            means.append(mean.astype(np.float32).ravel())
            counts.append(wordy.astype(np.int32))
            out += [row if some else None for row, some in zip(sums.tolist(), letters.tolist(), strict=True)]
        flat_means = pa.array(np.concatenate(means) if means else np.zeros(0, np.float32), pa.float32())
        mean_lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * len(names), pa.int32()), flat_means)
        return pa.StructArray.from_arrays([pa.array(out, pa.list_(pa.float64())), mean_lists, pa.array(np.concatenate(counts) if counts else [], pa.int32())], ["ll", "mean", "n"])

    return scores


def _length_class() -> Column:
    return F.least(F.floor(F.log2(F.col("_s.n").cast("double"))), F.lit(CLASSES - 1)).cast("int")


def _bands(scored: DataFrame, names: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least mean log likelihood of a run, by language and length class, and the languages' variances of a run.

    scored: _s (scores), _best and _told (numbers of languages). A band reaches below the median of the texts whose declared language is
    the text's, over all rows, by three times the distance to the twentieth part, but by LEAST_WIDTH to MOST_WIDTH; a text of n runs may
    lie three standard deviations of a mean of n runs lower. A class of fewer than CLASS_ROWS rows has the language's median over all its
    texts, and a language of so few rows the expectation of its own model.
    """
    own = scored.where("_told = _best and _s.n > 0").select("_best", _length_class().alias("_class"), F.col("_s.mean")[F.col("_best")].alias("_mean"))
    p = np.exp(table.astype(float))
    p /= p.sum(1, keepdims=True)
    expected = (p * table).sum(1)
    least = np.repeat((expected - MOST_WIDTH)[:, None], CLASSES, 1)
    parts = own.rollup("_best", "_class").agg(F.count(F.lit(1)).alias("rows"), F.percentile_approx("_mean", [0.05, 0.5]).alias("q")).where(F.col("_best").isNotNull() & (F.col("rows") >= CLASS_ROWS))
    for r in sorted(parts.collect(), key=lambda r: r["_class"] is not None):
        low, mid = r.q
        least[r["_best"], slice(None) if r["_class"] is None else r["_class"]] = mid - min(max(3 * (mid - low), LEAST_WIDTH), MOST_WIDTH)
    return least, (p * table**2).sum(1) - expected**2


def text_bands(labelled: DataFrame, names: list[str], table: np.ndarray, label: str = "lang", text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The languages' bands over all labelled rows."""
    scored = labelled.select(_told(names, F.col(label)).alias("_told"), text_scores(names, table)(F.col(text)).alias("_s"))
    scored = scored.select("_s", "_told", (F.array_position("_s.ll", F.array_max("_s.ll")).cast("int") - 1).alias("_best"))
    return _bands(scored, names, table)


def _tag(of: Column) -> Column:
    """A language tag in comparable form: lower case, with hyphens."""
    return F.nullif(F.lower(F.replace(F.trim(of.cast("string")), F.lit("_"), F.lit("-"))), F.lit(""))


def _told(names: list[str], declared: Column) -> Column:
    """The number of the declared language: of the whole tag, or else of its primary subtag; null for any other."""
    place = {x.strip().replace("_", "-").lower(): i for i, x in reversed(list(enumerate(names)))}

    @F.arrow_udf("int")
    def number(tags: pa.Array) -> pa.Array:
        seen = tags.dictionary_encode()
        known = [place.get(t, place.get(t.partition("-")[0])) if t else None for t in seen.dictionary.to_pylist()]
        return pa.array(known, pa.int32()).take(seen.indices)

    return number(_tag(declared))


def _shares(decided: DataFrame, key: str, base: list[float], strength: float, parent: DataFrame | None = None) -> DataFrame:
    """For each value of key the logs of the languages' shares of its texts, drawn towards its suffix's shares (``parent``) or else
    ``base`` as by ``strength`` texts."""
    counts = decided.where(F.col(key).isNotNull()).groupBy(key, "_best").agg(F.count(F.lit(1)).alias("n"), F.min("_suffix").alias("_of"))
    found = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_best", "n"))).alias("_m"), F.sum("n").alias("_all"), F.min("_of").alias("_of"))
    above = F.lit(None).cast("array<double>")
    if parent is not None:
        found, above = found.join(parent, F.col("_of") == F.col("_k_suffix"), "left"), F.col("_log_suffix")
    towards = lambda b, i: F.coalesce(F.exp(F.get(above, i)), b)
    logs = F.transform(F.lit(base), lambda b, i: F.log((F.coalesce(F.try_element_at("_m", i), F.lit(0)) + F.lit(strength) * towards(b, i)) / (F.col("_all") + F.lit(strength))))
    return found.select(F.col(key).alias(f"_k{key}"), logs.alias(f"_log{key}"))


def identify(
    docs: DataFrame, names: list[str], table: np.ndarray, text: Column, declared: Column, host: Column, suffix: Column,
    least_confidence: float = 0.6, host_strength: float = 20.0, suffix_strength: float = 100.0, broadcast_counts: int = 200_000, score_again: bool = False,
    bands: tuple[np.ndarray, np.ndarray] | None = None,
) -> DataFrame:
    """docs with lang, confidence (its posterior probability) and kept.

    Evidence: the text's likelihood; the declared language (a whole tag, or its primary subtag, that is the name of a language), trusted as often as it agrees with the texts over the whole table; the
    suffix of the address (how each language's texts spread over suffixes); the host's prior, drawn towards its suffix's or else the
    table's shares. Shares come from grouped aggregation over all rows. What is null is no evidence. kept: the text has letters, it is
    no less likely in its language than that language's texts are (``bands``, by default those of docs' own rows), and the posterior
    reaches ``least_confidence``; of languages with equal posteriors the first by name is taken. A text without letters (null and empty ones too), or less likely, has lang null, confidence 0. Tables of
    shares are broadcast up to ``broadcast_counts`` counts and joined by a shuffle beyond. Languages are places in arrays: the plan does not
    grow with them. The scores are written once with the columns of
    docs, or, with ``score_again``, without them and made again for the result, where the columns hold long texts. Existing columns of the result's names are replaced.
    """
    if not names:
        return docs.withColumns({"lang": F.lit(None).cast("string"), "confidence": F.lit(0.0), "kept": F.lit(False)})
    columns = [c for c in docs.columns if c not in ("lang", "confidence", "kept", "_text", "_told", "_from", "_end")]
    score = text_scores(names, table)
    evidence = [_told(names, declared).alias("_declared"), F.lower(host).alias("_host"), F.lower(suffix).alias("_suffix"), score(text).alias("_s")]
    seen = docs.select(*([] if score_again else columns), *evidence)
    seen = written(seen.withColumn("_best", F.array_position("_s.ll", F.array_max("_s.ll")).cast("int") - 1), "language-scores")
    scored = docs.select(*columns, *evidence) if score_again else seen
    decided = seen.where("_s.ll is not null").select("_declared", "_host", "_suffix", "_best")
    decided = written(decided, "language-decided")
    totals = np.ones(len(names))
    for r in decided.groupBy("_best").count().collect():  # a row a language
        totals[r["_best"]] += r["count"]
    base = totals / totals.sum()
    told, agreed = decided.agg(F.count("_declared"), F.count_if(F.col("_declared") == F.col("_best"))).first()
    least, variance = bands or _bands(seen.select("_s", "_best", F.col("_declared").alias("_told")), names, table)
    trust = min(0.99, (agreed + 1) / (told + 2))

    by_suffix = written(_shares(decided, "_suffix", base.tolist(), suffix_strength), "language-suffix")
    by_host = written(_shares(decided, "_host", base.tolist(), host_strength, by_suffix), "language-host")
    out = scored
    for key, shares in (("_host", by_host), ("_suffix", by_suffix)):
        few = shares.count() * len(names) <= broadcast_counts
        out = out.join(F.broadcast(shares) if few else shares, F.col(key) == F.col(f"_k{key}"), "left").drop(f"_k{key}")
    right, wrong = float(np.log(trust)), float(np.log(max((1 - trust) / max(1, len(names) - 1), 1e-6)))
    told_ = lambda i: F.when(F.col("_declared").isNull(), F.lit(0.0)).when(F.col("_declared") == i, F.lit(right)).otherwise(F.lit(wrong))
    prior = F.coalesce("_log_host", "_log_suffix", F.lit(np.log(base).tolist()))
    out = out.withColumn("_prior", prior).withColumn("_post", F.transform("_s.ll", lambda x, i: x + told_(i) + F.get("_prior", i))).withColumn("_top", F.array_max("_post"))
    confidence = F.lit(1.0) / F.aggregate("_post", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_top")))
    out = out.withColumn("_at", (F.array_position("_post", F.col("_top")) - 1).cast("int")).withColumn("_class", F.coalesce(_length_class(), F.lit(0)))
    # a row for each language and length class: the language's name and what the class's texts reach at least
    edges = pd.DataFrame({"_at": np.repeat(np.arange(len(names)), CLASSES), "_class": np.tile(np.arange(CLASSES), len(names)), "_name": np.repeat(np.array(names, object), CLASSES), "_least": least.ravel(), "_variance": np.repeat(variance, CLASSES)})
    edges = docs.sparkSession.createDataFrame(edges, "_at int, _class int, _name string, _least double, _variance double")
    out = out.join(F.broadcast(edges), ["_at", "_class"], "left")  # most_languages times CLASSES rows at most
    inside = (F.col("_s.n") <= 0) | (F.get("_s.mean", F.col("_at")) >= F.col("_least") - 3 * F.sqrt(F.col("_variance") / F.col("_s.n")))
    some = F.coalesce(inside, F.lit(False)) & F.col("_at").isNotNull()
    return out.select(*columns, F.when(some, F.col("_name")).alias("lang"), F.when(some, confidence).otherwise(F.lit(0.0)).alias("confidence"), (some & (confidence >= least_confidence)).alias("kept"))


def documents_by_language(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of docs with lang, confidence and kept. A document's declared language is its column lang, its host its
    source; it has no address. The text model is fitted on documents with a declared language."""
    names, table = fit_text_model(docs)
    slim = docs.select(*keep, F.col("text").alias("_text"), F.col("lang").cast("string").alias("_told"), F.col("source").cast("string").alias("_from"))
    return identify(slim, names, table, F.col("_text"), F.col("_told"), F.col("_from"), F.lit(None).cast("string"))


def op8(docs: DataFrame) -> DataFrame:
    """All documents' languages: doc_id, lang, confidence, kept."""
    return documents_by_language(docs, ["doc_id"]).select("doc_id", "lang", "confidence", "kept")


def in_known_language(docs: DataFrame) -> DataFrame:
    """docs without the rows whose language is not known with confidence; columns and values as they are, whatever their names."""
    def work(docs: DataFrame) -> DataFrame:
        named = docs.withColumn("_lang", F.col("lang"))
        names, table = fit_text_model(named)
        found = identify(named, names, table, F.col("text"), F.col("_lang").cast("string"), F.col("source").cast("string"), F.lit(None).cast("string"), score_again=True)
        return found.where("kept").withColumn("lang", F.col("_lang")).select(*docs.columns)

    return shielded(docs, work)


def page_languages(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """All pages' languages: page_id, lang, confidence, kept; with the language that the markup declares, the address's host and suffix.
    The text model is fitted on labelled documents; markup is no text."""
    names, table = fit_text_model(labelled)
    text = F.trim(F.regexp_replace(F.regexp_replace(F.col("html"), r"(?is)<(script|style)\b.*?</\1>|<[^>]*>", " "), r"\s+", " "))
    declared = F.nullif(F.regexp_extract("html", r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-z0-9_-]+)", 1), F.lit(""))
    host = F.nullif(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1), F.lit(""))
    suffix = F.nullif(F.regexp_extract(host, r"\.([a-zA-Z]+)$", 1), F.lit(""))
    slim = pages.select("page_id", text.alias("_text"), declared.alias("_told"), host.alias("_from"), suffix.alias("_end"))
    return identify(slim, names, table, F.col("_text"), F.col("_told"), F.col("_from"), F.col("_end"), bands=text_bands(labelled, names, table) if names else None).select("page_id", "lang", "confidence", "kept")
