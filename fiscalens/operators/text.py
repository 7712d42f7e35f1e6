"""Names, notices, vectors and text search."""

from __future__ import annotations

import difflib
import hashlib
import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.normalize import bare_upper, first_letters, sorted_words
from ..functions.rounding import rounded
from ..functions.storage import written
from .cosine_join import candidates, dense_pairs, members, scored
from .encoder import Words, document_frequencies, packed, unpacked, weighted
from .name_join import near_names


def normalized(name: str) -> Column:
    """A name as it is compared: plain words, sorted."""
    return sorted_words(F.col(name))


@F.pandas_udf(DoubleType())
def name_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two normalized names; 0 if either is empty."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)], dtype=float)


def documents_match(a: Column, b: Column) -> Column:
    """Whether the digits of the shorter lie within the longer; empty never matches."""
    x, y = F.regexp_replace(F.coalesce(a, F.lit("")), r"\D", ""), F.regexp_replace(F.coalesce(b, F.lit("")), r"\D", "")
    return (x != "") & (y != "") & F.when(F.length(x) <= F.length(y), F.contains(y, x)).otherwise(F.contains(x, y))


#: Rows of a name block that meet in one cell.
CELL = 256


def resolve_people(people: DataFrame, threshold: float = 0.85) -> DataFrame:
    """people (id, name, document, age_range) as scored pairs that merge: .6 name + .3 document + .1 equal age range.

    Pairs share a block: the digits of the document, or the first sorted token of the name. A block of more than CELL rows falls into
    parts, of which each pair is compared by itself. Equal names are compared once: a pair of names must be as similar as its score
    needs at least, which their lengths rule out before they are aligned.
    """
    p = people.withColumn("_name", normalized("name")).withColumn("_digits", F.regexp_replace(F.coalesce("document", F.lit("")), r"\D", ""))
    keys = F.array_compact(F.array(F.when(F.col("_digits") != "", F.concat(F.lit("doc:"), "_digits")), F.when(F.col("_name") != "", F.concat(F.lit("tok:"), F.substring_index("_name", " ", 1)))))
    b = p.select("id", "_name", "document", "age_range", F.explode(keys).alias("_key"))
    size = b.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_key", F.ceil(F.col("_n") / CELL).cast("long").alias("_parts"))
    b = b.join(size, "_key").withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_parts")))
    b = b.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    b = b.withColumns({"_u": F.least("_part", "_other"), "_v": F.greatest("_part", "_other")}).drop("_other", "_parts")
    left = b.select(*[F.col(c).alias(f"a_{c}") for c in ("id", "_name", "document", "age_range")], F.col("_part").alias("_ap"), "_key", "_u", "_v")
    pairs = left.join(b, ["_key", "_u", "_v"]).where("a_id < id and (_u = _v or _ap <> _part)")
    rest = 0.3 * documents_match(F.col("a_document"), F.col("document")).cast("double") + 0.1 * F.coalesce((F.col("a_age_range") == F.col("age_range")).cast("double"), F.lit(0.0))
    long, short = F.greatest(F.length("a__name"), F.length("_name")), F.least(F.length("a__name"), F.length("_name"))
    needed = (threshold - F.col("_rest")) / 0.6
    pairs = pairs.withColumn("_rest", rest).where(2 * short / F.greatest(long + short, F.lit(1)) >= needed - 1e-9).dropDuplicates(["a_id", "id"])
    names = pairs.select("a__name", "_name").distinct()
    names = names.withColumn("_s", name_similarity("a__name", "_name"))
    score = rounded(0.6 * F.col("_s") + F.col("_rest"), 6)
    return pairs.join(names, ["a__name", "_name"]).withColumn("score", score).where(F.col("score") >= threshold).select(F.col("a_id").alias("id_a"), F.col("id").alias("id_b"), "score")


def fuzzy_screening(c: DataFrame, sanctions: DataFrame, assisted: float = 0.85, name_only: float = 0.95) -> DataFrame:
    """Suppliers whose name, and masked document if there is one, is a sanctioned one's while a contract was signed: by entity and list
    the best score, sanctions and contracts.

    sanctions has id, list_name, sanctioned_name, document, start_date and end_date. The digits of a masked document must
    lie within the supplier's, and then .6 name + .4 counts from ``assisted``; where one side has no document, the name alone counts from
    ``name_only``. Two full documents are the exact screening's matter. Suppliers without a document are entities by their name.
    """
    digits = F.regexp_replace(F.coalesce("document", F.lit("")), r"\D", "")
    s = sanctions.select(F.col("id").alias("sanction"), "list_name", "start_date", "end_date", normalized("sanctioned_name").alias("a"), F.nullif(digits, F.lit("")).alias("_digits"), F.contains(F.coalesce("document", F.lit("")), F.lit("*")).alias("_masked"))
    s = written(s, "sanctioned")
    variants = written(c.select("doc", "legal_name").distinct(), "supplier-names")
    names = written(variants.select("legal_name").where("legal_name is not null").distinct().withColumn("b", normalized("legal_name")), "names")  # each name once
    t = variants.join(names, "legal_name", "left").select(F.coalesce("doc", F.nullif("b", F.lit(""))).alias("entity"), "doc", F.coalesce("b", F.lit("")).alias("b")).where("entity is not null").distinct()
    t = written(t, "suppliers")
    # full names of the list meet suppliers without a document, those without a document meet all
    bare = near_names(s.where("_digits is null").select("a"), t.select("b"), name_only)
    other = near_names(s.where("_digits is not null").select("a"), t.where("doc is null").select("b"), name_only)
    near = written(bare.unionByName(other).distinct(), "near-names")
    by_name = s.join(near, "a").join(t, "b").where("_digits is null or doc is null").select("sanction", "entity", F.col("similarity").alias("_score"))
    least = (assisted - 0.4) / 0.6  # a name less similar cannot reach ``assisted``
    hidden = s.where("_masked and _digits is not null")
    known = t.where("doc <> ''").withColumn("_n", F.length("doc"))
    lengths = hidden.select(F.length("_digits").alias("_k")).distinct()  # a few rows, as documents have 14 digits at most
    known = known.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n")))).join(F.broadcast(lengths), "_k")
    pieces = known.select("entity", "doc", "b", F.explode(F.transform(F.sequence(F.lit(1), F.col("_n") - F.col("_k") + 1), lambda i: F.substr("doc", i, F.col("_k")))).alias("_digits")).distinct()
    met = hidden.join(pieces, "_digits").where(2 * F.least(F.length("a"), F.length("b")) >= least * (F.length("a") + F.length("b")) - 1e-9)
    met = written(met.select("sanction", "entity", "a", "b"), "masked-documents")
    scores = met.select("a", "b").distinct().withColumn("_ratio", name_similarity("a", "b"))
    by_document = met.join(scores, ["a", "b"]).select("sanction", "entity", (0.6 * F.col("_ratio") + 0.4).alias("_score")).where(F.col("_score") >= assisted)
    found = by_name.unionByName(by_document).groupBy("sanction", "entity").agg(F.max("_score").alias("_score")).join(s.select("sanction", "list_name", "start_date", "end_date"), "sanction")
    found = written(found, "screened")
    signed = c.select("id", "doc", "signature_date", "legal_name")
    hit = signed.where("doc is not null").withColumn("entity", F.col("doc")).unionByName(signed.where("doc is null").join(names, "legal_name").withColumn("entity", F.col("b")).drop("b"))
    hit = hit.select("id", "entity", "signature_date").join(found, "entity").where(F.col("signature_date").between(F.col("start_date"), F.coalesce("end_date", F.lit("9999-12-31").cast("date"))))
    return hit.groupBy("entity", "list_name").agg(rounded(F.max("_score")).alias("score"), F.countDistinct("sanction").alias("sanctions"), F.countDistinct("id").alias("contracts"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norms: Column | None = None) -> Column:
    """Within [-1, 1]; 0 if either vector is zero, NULL if either is, or if their lengths differ. norms: the product of the vectors' norms, if it is
    known."""
    norms = norm(a) * norm(b) if norms is None else norms
    ratio = dot(a, b) / norms
    return F.when(norms == 0, F.lit(0.0)).when(ratio.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio)))  # greatest and least pass over nulls


def vector_search(vectors: DataFrame, query: list[float], top_k: int = 10, collection: str | None = None) -> DataFrame:
    """The ``top_k`` vectors, of a collection if one is named, with the largest positive cosine to the query."""
    if collection is not None:
        vectors = vectors.where(F.col("collection") == collection)
    q = F.array(*[F.lit(float(x)) for x in query])
    found = vectors.select("vec_id", cosine(F.col("embedding").cast("array<double>"), q).alias("_s")).where("_s > 0")
    return found.withColumn("similarity", rounded(F.col("_s"), 6)).drop("_s").orderBy(F.desc("similarity"), "vec_id").limit(top_k)


def notice_id(territory: Column, date: Column, edition: Column, index: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", territory, date.cast("string"), edition.cast("string"), index.cast("string")), 256), 1, 16)


def pair_key(a: Column, b: Column) -> Column:
    """The key by which a pair of notices is reviewed, whichever comes first."""
    return F.sha2(F.concat_ws("+", F.least(a, b), F.greatest(a, b)), 256)


def hashed_words(text: Column, dims: int = 64) -> Column:
    """A text as counts of its words by a hash: an encoder that needs no fitting, for tests and comparisons. NULL for NULL."""
    @F.pandas_udf("array<double>")
    def counts(texts: pd.Series) -> pd.Series:
        bins: dict[str, int] = {}

        def one(t: str | None) -> np.ndarray | None:
            if t is None:
                return None
            for w in (words := t.lower().split(" ")):
                if w not in bins:
                    bins[w] = int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % dims  # noqa: S324
            return np.bincount([bins[w] for w in words], minlength=dims).astype(float)

        return texts.map(one)

    return counts(text)


def semantic_gap(pairs: DataFrame, a: str, b: str, encode: Callable[[Column], Column] = hashed_words) -> DataFrame:
    """pairs with similarity: the cosine of two texts as the encoder has them; NULL if either is."""
    return pairs.withColumn("similarity", rounded(cosine(encode(F.col(a)), encode(F.col(b)))))


def process_number(text: Column) -> Column:
    """The digits of the first process number in a text: NNNNN.NNNNNNNN/NNNN-NN or near to it, else what follows "Processo no"; 6 to 19
    digits, or null."""
    def first(pattern: str, group: int) -> Column:
        found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x: F.regexp_replace(x, r"(?U)\D", ""))
        return F.get(F.filter(found, lambda x: F.length(x).between(6, 19)), F.lit(0))

    return F.coalesce(first(r"(?U)\d{4,6}\s*\.\s*\d{6,8}\s*/\s*\d{4}\s*-\s*\d{2}", 0), first(r"(?iU)processo\s*n[º°oa.]*\s*[:\-]?\s*(\d[\d./\-]{3,}\d)", 1))


def _valid_notices(notices: DataFrame, least_chars: int) -> DataFrame:
    return notices.where((F.col("territory_id") != "") & F.col("date").isNotNull() & (F.length(F.trim("text")) >= least_chars))


def notice_clones(notices: DataFrame, threshold: float = 0.85, days: int = 365, least_chars: int = 200, reference_date: Column | None = None, encode: Callable[[Column], Column] | None = None) -> DataFrame:
    """Pairs of notices (doc_id, territory_id, date, text, and vector unless ``encode`` makes it of the text) of one territory, the other
    strictly older by ``days`` at most, with a similarity above the threshold; with ``reference_date`` the newer one is of that day.

    Notices of the same process number are editions of one notice, and no pair. Notices meet by territory and part of the window: a newer
    one is dealt to the parts that it looks back on, and parts of any size fall into cells, so that no task compares a territory as a whole.
    """
    part = max(1, days // 8)
    vector = F.col("vector") if encode is None else encode(F.col("text"))
    n = _valid_notices(notices, least_chars).select(F.col("doc_id").alias("id"), "territory_id", F.unix_date("date").alias("_day"), vector.cast("array<double>").alias("vector"), process_number(F.col("text")).alias("_number"), F.floor(F.unix_date("date") / part).alias("_part"))
    n = written(n, "notices")
    new = n if reference_date is None else n.where(F.col("_day") == F.unix_date(reference_date))
    new = new.withColumn("_part", F.explode(F.sequence(F.floor((F.col("_day") - days) / part), F.col("_part"))))

    def allowed(a: pa.Table, b: pa.Table, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        of = lambda t, c, k: t.column(c).combine_chunks().take(pa.array(k))
        gap = of(a, "_day", i).to_numpy().astype(np.int64) - of(b, "_day", j).to_numpy().astype(np.int64)
        same = np.array([x is not None and x == y for x, y in zip(of(a, "_number", i).to_pylist(), of(b, "_number", j).to_pylist(), strict=True)], bool)
        return (gap > 0) & (gap <= days) & ~same

    pairs = dense_pairs(new, n, ["territory_id", "_part"], dict(n.dtypes)["id"], allowed, threshold)
    return pairs.join(n.select(F.col("id").alias("a"), "territory_id"), "a").select(F.col("a").alias("doc_id"), F.col("b").alias("old_id"), "territory_id", rounded(F.col("similarity"), 6).alias("similarity"))


def _older(days: int, reference_date: Column | None) -> Column:
    gap = F.col("a__day") - F.col("_day")
    now = F.lit(True) if reference_date is None else F.col("a__day") == F.unix_date(reference_date)
    return (gap > 0) & (gap <= days) & F.coalesce(F.col("a__number") != F.col("_number"), F.lit(True)) & now


def _noted(notices: DataFrame, least_chars: int) -> DataFrame:
    """Valid notices as id, territory_id, _day, _number, text."""
    return _valid_notices(notices, least_chars).select(F.col("doc_id").alias("id"), "territory_id", F.unix_date("date").alias("_day"), process_number(F.col("text")).alias("_number"), "text")


def clone_candidates(notices: DataFrame, threshold: float = 0.85, days: int = 365, least_chars: int = 200, reference_date: Column | None = None) -> tuple[DataFrame, Words]:
    """Pairs (a, b) of valid notices that sparse_clones compares, and the words by which it does. doc_ids must be of their own."""
    some = _noted(notices, least_chars)
    words = document_frequencies(some, "text")
    return written(candidates(weighted(some, "id", "text", words), threshold, ["territory_id"], _older(days, reference_date)), "candidates"), words


def sparse_clones(notices: DataFrame, threshold: float = 0.85, days: int = 365, least_chars: int = 200, reference_date: Column | None = None, compared: tuple[DataFrame, Words] | None = None) -> DataFrame:
    """notice_clones by the words that notices share, weighted by tf-idf, through an inverted index of their rarest words: no pair is lost,
    and a notice is compared with those alone that may reach the threshold. compared: what clone_candidates() gave for the same
    notices, if it is known.

    Vectors are not stored: they are made of the texts for the index, and once more for those that are compared.
    """
    pairs, words = compared or clone_candidates(notices, threshold, days, least_chars, reference_date)
    some = _noted(notices, least_chars)
    few = some.join(members(pairs), "id", "left_semi").select("id", "text")
    found = scored(pairs, weighted(few, "id", "text", words), threshold) if words.sent is None else scored(pairs, packed(few, "id", "text", words), threshold, unpack=unpacked(words))
    return found.join(some.select(F.col("id").alias("a"), "territory_id"), "a").select(F.col("a").alias("doc_id"), F.col("b").alias("old_id"), "territory_id", rounded(F.col("similarity"), 6).alias("similarity"))


def window_pairs(notices: DataFrame, days: int = 365, least_chars: int = 200) -> DataFrame:
    """By territory: notices, and pairs of them within the window, counted from the notices of each day."""
    daily = _valid_notices(notices, least_chars).groupBy("territory_id", F.unix_date("date").alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    back = Window.partitionBy("territory_id").orderBy("_day").rangeBetween(-days, -1)
    return daily.withColumn("_old", F.coalesce(F.sum("_n").over(back), F.lit(0))).groupBy("territory_id").agg(F.sum("_n").alias("notices"), F.sum(F.col("_n") * F.col("_old")).alias("pairs"))


def clone_rates(found: DataFrame, planted: DataFrame, windows: DataFrame) -> DataFrame:
    """Of clones found (doc_id, old_id) and planted (a, b): how many were planted, their recall (1 without any), and the share of the other
    pairs of the windows (as of window_pairs) that were found (0 without any)."""
    own = found.select(F.col("doc_id").alias("a"), F.col("old_id").alias("b"), F.lit(1).alias("_hit"))
    known = planted.distinct().join(own, ["a", "b"], "left").agg(F.count(F.lit(1)).alias("planted"), F.count("_hit").alias("_hits"))
    both = known.join(own.agg(F.count(F.lit(1)).alias("_found"))).join(windows.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("window_pairs")))  # rows of one
    rate = lambda x, n, none: rounded(F.coalesce(x / F.nullif(n, F.lit(0)), F.lit(none)), 6)
    return both.select("planted", "window_pairs", rate(F.col("_hits"), F.col("planted"), 1.0).alias("recall"), rate(F.col("_found") - F.col("_hits"), F.col("window_pairs") - F.col("planted"), 0.0).alias("false_rate"))


def gazette_notices(gazettes: DataFrame) -> DataFrame:
    """Gazettes (territory_id, date, digest, text) as notices: doc_id, territory_id, date, text; files whose names say no date are left out."""
    units = segments(gazettes.where("date is not null"), ["territory_id", "date", "digest"], "text")
    return units.select(notice_id(F.col("territory_id"), F.col("date"), F.col("digest"), F.col("unit")).alias("doc_id"), "territory_id", "date", F.col("segment").alias("text"))


def gazette_clones(gazettes: DataFrame, encode: Callable[[Column], Column] = hashed_words, **how) -> DataFrame:
    """Signals of notices that clone older ones, of the latest day in the gazettes: entity_id (the pair's key), score, both notices."""
    n = gazette_notices(gazettes)
    last = n.agg(F.max("date")).first()[0]
    if last is None:
        return n.limit(0).select(F.lit("").alias("entity_id"), F.lit(0.0).alias("score"), "doc_id", F.col("doc_id").alias("old_id"))
    found = notice_clones(n, reference_date=F.lit(last), encode=encode, **how)
    return found.select(pair_key(F.col("doc_id"), F.col("old_id")).alias("entity_id"), rounded(F.col("similarity")).alias("score"), "doc_id", "old_id")


def planted_rates(planted: DataFrame, scored: DataFrame, threshold: float) -> DataFrame:
    """planted (a, b) and scored (a, b, similarity) as recall of the planted pairs above the threshold (1 without any) and the share of the
    other scored pairs above it (0 without any)."""
    found = scored.where(F.col("similarity") > threshold).select("a", "b", F.lit(True).alias("_hit"))
    recall = planted.distinct().join(found, ["a", "b"], "left").agg(rounded(F.coalesce(F.avg(F.coalesce("_hit", F.lit(False)).cast("double")), F.lit(1.0))).alias("recall"))
    others = scored.join(planted, ["a", "b"], "left_anti").agg(rounded(F.coalesce(F.avg((F.col("similarity") > threshold).cast("double")), F.lit(0.0))).alias("false_rate"))
    return recall.crossJoin(others)


def stratified(df: DataFrame, label: str, key: str, each: int, seed: int = 0) -> DataFrame:
    """``each`` rows of every label (all if it has fewer), chosen by a hash of the key; the same for the same seed."""
    order = Window.partitionBy(label).orderBy(F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))), 256), key)
    return df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= each).drop("_n")


def text_search(docs: DataFrame, query: list[str], top_k: int = 20) -> DataFrame:
    """Documents with any of the tokens in title (if docs have one) or text, by the sum of tf * ln(N / df), ties by id."""
    whole = F.concat_ws(" ", "title", "text") if "title" in docs.columns else F.col("text")
    words = F.filter(F.split(F.lower(whole), r"[^\p{L}\p{N}]+"), lambda w: w.isin(*[q.lower() for q in query]))
    hits = docs.select("doc_id", F.explode(words).alias("word")).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("tf"))
    df = hits.groupBy("word").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(docs.agg(F.count(F.lit(1)).alias("_n")))).select("word", F.log(F.col("_n") / F.col("df")).alias("_idf"))
    return hits.join(F.broadcast(df), "word").groupBy("doc_id").agg(rounded(F.sum(F.col("tf") * F.col("_idf")), 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(top_k)


# How the header of a notice begins.
HEADERS = ["EDITAL", "AVISO DE LICITACAO", "EXTRATO", "PROCESSO"]
#: What ends a line.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def segments(texts: DataFrame, keys: str | list[str], text: str, headers: list[str] | None = None, longest: int = 120) -> DataFrame:
    """A text's units: each begins at a header, a line of ``longest`` characters at most that begins like one, whatever its case and marks;
    what stands before the first is dropped, as are line ends' spaces. Within a row, without a shuffle: keys, unit (from 0), segment."""
    keys = [keys] if isinstance(keys, str) else keys
    starts = [" ".join("".join(c for c in unicodedata.normalize("NFKD", h) if not unicodedata.combining(c)).upper().split()) for h in headers or HEADERS]

    def is_header(line: Column) -> Column:
        found = F.lit(False)
        for h in starts:
            found |= line.startswith(h)
        return (F.length(line) <= longest) & found

    split = texts.select(*keys, F.transform(F.split(F.col(text), LINE_END), lambda x: F.regexp_replace(x, r"\s+$", "")).alias("_lines"))
    begins = first_letters({h[0] for h in starts})  # what other lines begin with is cheaper to see than their bare form
    bare = F.transform("_lines", lambda x: F.when(x.rlike(begins), bare_upper(x)))
    heads = F.filter(F.transform(bare, lambda x, i: F.when(is_header(x), i + 1)), lambda x: x.isNotNull())
    upto = lambda i: F.coalesce(F.get("_heads", i + 1), F.size("_lines") + 1)
    cut = split.withColumn("_heads", heads).select(*keys, F.transform("_heads", lambda h, i: F.regexp_replace(F.array_join(F.slice("_lines", h, upto(i) - h), "\n"), r"^\s+|\s+$", "")).alias("_units"))
    return cut.select(*keys, F.posexplode("_units").alias("unit", "segment"))


def upsert_vectors(old: DataFrame, new: DataFrame) -> DataFrame:
    """Vectors (collection, external_id, embedding) with the new ones in place of those of the same key."""
    return old.join(new.select("collection", "external_id"), ["collection", "external_id"], "left_anti").unionByName(new)


def delete_vectors(old: DataFrame, keys: DataFrame) -> DataFrame:
    return old.join(keys.select("collection", "external_id"), ["collection", "external_id"], "left_anti")
