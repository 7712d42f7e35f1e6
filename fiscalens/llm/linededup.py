"""Line dedup by log templates: a tree of fixed depth (token count, then leading tokens) whose leaves generalise variable fields.

After Drain (He et al., 2017). Tokens with digits are variable fields from the start. Within a leaf, lines of which most tokens agree
place by place share a template, whose other places are variable. Templates that recur across documents are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import shielded, written
from .textkernel import by_group, flat, mixed, pieces, word_hashes, words

LEADING = 3
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_FIELD = np.uint64(0x5851F42D4C957F2D)
U = np.uint64


def line_table(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """The lines with a token of texts: doc (the text's number), begin and end in data, n (tokens), first (its first token's number),
    hash (of its masked tokens), leaf; and all masked tokens as tokens."""
    start, end, _ = words(data, at)
    token = word_hashes(data, start, end)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    token[digits[end] > digits[start]] = _FIELD
    breaks = np.flatnonzero(data == 10) + 1
    heads = np.sort(np.concatenate([at[:-1], breaks]))
    line = np.searchsorted(heads, start, "right") - 1
    first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(line)))
    own = line[first] if len(first) else first
    begin = heads[own]
    doc = np.searchsorted(at, begin, "right") - 1
    stop = np.minimum(np.append(heads, len(data))[own + 1], at[doc + 1])
    place = (np.arange(len(token)) - np.repeat(first, n)).astype(U)
    value = mixed(token + place * U(0x9E3779B97F4A7C15))
    h = mixed(np.add.reduceat(value, first) + n.astype(U)) if len(first) else np.zeros(0, U)
    leaf = n.astype(U) * U(0xD1342543DE82EF95)
    for k in range(LEADING):
        leaf = mixed(leaf ^ token[np.minimum(first + k, first + n - 1)] if len(first) else leaf)
    return {"doc": doc, "begin": begin, "end": stop, "n": n, "first": first, "hash": h, "leaf": leaf, "tokens": token}


LINES = "doc_id long, fp long, line long, leaf long, n int"


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's different lines, without their tokens."""
    for batch in batches:
        for lo, hi in pieces(batch.column(2), 1 << 20):
            part = batch.slice(lo, hi - lo)
            t = line_table(*flat(part.column(2)))
            order = np.lexsort((t["hash"], t["doc"]))
            d, h = t["doc"][order], t["hash"][order]
            one = order[np.concatenate([[True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])])] if len(order) else order
            rows = pa.array(t["doc"][one])
            yield pa.record_batch([part.column(0).take(rows), part.column(1).take(rows), pa.array(t["hash"][one].view(np.int64)), pa.array(t["leaf"][one].view(np.int64)), pa.array(t["n"][one].astype(np.int32))],
                                  names=[x.split()[0] for x in LINES.split(", ")])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different lines of a few texts that may vary, with their masked tokens: line, tokens (32 bits of each token's hash)."""
    for batch in batches:
        for lo, hi in pieces(batch.column(0), 1 << 20):
            t = line_table(*flat(batch.column(0).slice(lo, hi - lo)))
            wide = np.flatnonzero(t["n"] > LEADING)
            one = wide[np.unique(t["hash"][wide], return_index=True)[1]]
            tokens = (t["tokens"] >> U(32)).astype("<u4")
            own = [tokens[f : f + n].tobytes() for f, n in zip(t["first"][one].tolist(), t["n"][one].tolist(), strict=True)]
            yield pa.record_batch([pa.array(t["hash"][one].view(np.int64)), pa.array(own, pa.binary())], names=["line", "tokens"])


def segment_keys(matrix: np.ndarray, likeness: float) -> np.ndarray:
    """Keys of rows of tokens (lines of one leaf) by segments of their places: rows by segments, one segment more than places may differ.

    The leading tokens of a leaf's lines are equal. Lines of which ``likeness`` of the tokens agree thus have a key in common; where so
    many places may differ that no segment need agree, all lines have one key.
    """
    m, n = matrix.shape
    differ = n - int(np.ceil(likeness * n - 1e-9))
    if differ >= n - LEADING:
        return np.zeros((m, 1), U)
    cuts = LEADING + (n - LEADING) * np.arange(differ + 1) // (differ + 1)
    place = (np.arange(n) + 1).astype(U) * U(0x9E3779B97F4A7C15)
    out = np.zeros((m, differ + 1), U)
    step = max(1, (1 << 20) // n)
    for lo in range(0, m, step):
        out[lo : lo + step] = mixed(np.add.reduceat(mixed(matrix[lo : lo + step].astype(U) + place), cuts, axis=1) + cuts.astype(U))
    return out


def templates_of(matrix: np.ndarray, likeness: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of tokens (a row a line, in order) as templates: each row's template number, the templates' tokens, and which of these are fixed.

    A row is compared with the templates whose first row has a key in common with it; no other can be like it.
    """
    m, n = matrix.shape
    first, fixed, of = np.zeros(m, np.int64), np.zeros((m, n), bool), np.zeros(m, np.int64)
    count, least = 0, likeness * n - 1e-9
    known: dict[int, list[int]] = {}
    for i, keys in enumerate(map(set, segment_keys(matrix, likeness).tolist())):
        near = np.unique(np.array([t for k in keys for t in known.get(k, ())], np.int64))
        if len(near):
            agree = np.zeros(len(near), np.int64)
            for lo in range(0, len(near), step := max(1, (1 << 22) // n)):
                some = near[lo : lo + step]
                agree[lo : lo + step] = ((matrix[first[some]] == matrix[i]) & fixed[some]).sum(1)
            best = int(agree.argmax())
            if agree[best] >= least:
                k = of[i] = near[best]
                fixed[k] &= matrix[first[k]] == matrix[i]
                continue
        first[count], fixed[count], of[i] = i, True, count
        for k in keys:
            known.setdefault(k, []).append(count)
        count += 1
    return of, matrix[first[:count]], fixed[:count]


def _keyed(likeness: float):
    """Lines' keys: line, key, of line, leaf, n and tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy()
            line, leaf = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for size in np.unique(n).tolist():
                rows = np.flatnonzero(n == size)
                raw = batch.column(3).take(pa.array(rows)).to_pylist()
                keys = segment_keys(np.frombuffer(b"".join(raw), "<u4").reshape(len(rows), -1), likeness)
                keys = mixed(keys ^ mixed(leaf[rows].view(U) + U(size))[:, None])
                yield pa.record_batch([pa.array(np.repeat(line[rows], keys.shape[1])), pa.array(keys.ravel().view(np.int64))], names=["line", "key"])

    return run


def _clumps(lines: DataFrame, likeness: float) -> DataFrame:
    """Of lines (line, leaf, n, tokens) those that share a key with another one of their leaf, with the clump that shared keys connect: line, clump."""
    keys = written(lines.mapInArrow(_keyed(likeness), "line long, key long"), "line-keys")
    least = keys.groupBy("key").agg(F.min("line").alias("b"), F.max("line").alias("_top")).where("b < _top").select("key", "b")
    return components(keys.join(least, "key").select(F.col("line").alias("a"), "b")).select(F.col("node").alias("line"), F.col("label").alias("clump"))


def _cluster(likeness: float):
    def work(table: pa.Table) -> pa.RecordBatch | None:
        docs, line = table.column("docs").to_numpy(), table.column("line").to_numpy()
        order = np.lexsort((line, -docs))
        raw = table.column("tokens").to_pylist()
        matrix = np.frombuffer(b"".join(raw[i] for i in order), "<u4").reshape(len(order), -1)
        of, token, fixed = templates_of(matrix, likeness)
        size = np.bincount(of)
        place = (np.arange(matrix.shape[1]) + 1).astype(U) * U(0x9E3779B97F4A7C15)
        name = mixed(mixed(np.where(fixed, token.astype(U) + U(1), U(0)) + place).sum(1, dtype=U))
        some = size[of] > 1
        if not some.any():
            return None
        return pa.record_batch([pa.array(line[order][some]), pa.array(name[of[some]].view(np.int64))], names=["line", "template"])

    return work


def recurring_lines(docs: DataFrame, min_docs: int = 5, long_tokens: int = 20, long_docs: int = 2, likeness: float = 0.85, leaf_lines: int = 2048, leaf_tokens: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """(lines of documents, recurring lines). docs: doc_id, fp, text. The first: doc_id, fp, line, n; the second: line, template, docs
    (documents with a line of the template), home_id and home_fp (the first of these documents).

    A template recurs if ``min_docs`` documents have a line of it, or ``long_docs`` for lines of ``long_tokens`` tokens. Lines of
    three tokens or fewer vary in tokens with digits only. A leaf of more than ``leaf_lines`` different lines,
    or ``leaf_tokens`` tokens, is dealt by clumps of lines that keys of their tokens connect; lines of different clumps are never alike,
    so that the templates are those of the leaf as a whole. A clump of any size is clustered by one task.
    """
    seen = written(docs.mapInArrow(_lines, LINES), "lines")
    first = F.min(F.struct("doc_id", "fp")).alias("home")
    lines = written(seen.groupBy("line").agg(F.count(F.lit(1)).alias("docs"), first, F.first("leaf").alias("leaf"), F.first("n").alias("n")), "lines-once")
    needed = F.when(F.col("n") >= long_tokens, F.lit(long_docs)).otherwise(F.lit(min_docs))
    leaves = lines.where(F.col("n") > LEADING).groupBy("leaf", "n").agg(F.count(F.lit(1)).alias("_lines"), F.sum("docs").alias("_docs")).where((F.col("_lines") > 1) & (F.col("_docs") >= needed))
    inside = written(lines.select("line", "docs", "leaf", "n").where(F.col("n") > LEADING).join(leaves.drop("_docs"), ["leaf", "n"]), "lines-inside")
    # the texts are read a second time for the tokens, so that none are written for lines that stand alone in their leaf
    tokens = docs.select("text").mapInArrow(_tokens, "line long, tokens binary").join(inside.select("line").hint("merge"), "line", "left_semi").groupBy("line").agg(F.first("tokens").alias("tokens"))
    inside = written(inside.join(tokens, "line"), "lines-tokens")
    large = (F.col("_lines") > leaf_lines) | (F.col("_lines") * F.col("n") > leaf_tokens)
    cells = inside.where(~large).select("line", "docs", "tokens", F.xxhash64("leaf", "n").alias("_cell"))
    if not leaves.where(large).isEmpty():
        clumps = _clumps(inside.where(large).select("line", "leaf", "n", "tokens"), likeness)
        cells = cells.unionByName(inside.where(large).join(clumps, "line").select("line", "docs", "tokens", F.xxhash64("leaf", "n", "clump").alias("_cell")))
    found = written(cells.repartition("_cell").sortWithinPartitions("_cell").mapInArrow(by_group("_cell", _cluster(likeness)), "line long, template long"), "line-templates")
    grouped = seen.select("doc_id", "fp", "line", "n").join(found, "line").groupBy("template", "n", "doc_id", "fp").agg(F.lit(1).alias("_one"))
    grouped = grouped.groupBy("template", "n").agg(F.count(F.lit(1)).alias("docs"), first)
    shared = lines.select("line", "n").join(found, "line").join(grouped, ["template", "n"]).where(F.col("docs") >= needed)
    alone = lines.where(F.col("docs") >= needed).join(shared.select("line"), "line", "left_anti").withColumn("template", F.col("line"))
    known = shared.select("line", "template", "docs", "home").unionByName(alone.select("line", "template", "docs", "home"))
    return seen.select("doc_id", "fp", "line", "n"), known.select("line", "template", "docs", F.col("home.doc_id").alias("home_id"), F.col("home.fp").alias("home_fp"))


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the lines of their lists: _text, _n_lines, _n_dropped in place of text and list, which stand last."""
    for batch in batches:
        width = batch.num_columns
        for lo, hi in pieces(batch.column(width - 2)):
            part = batch.slice(lo, hi - lo)
            texts, lists = part.column(width - 2), part.column(width - 1)
            data, at = flat(texts)
            t = line_table(data, at)
            total = np.bincount(t["doc"], minlength=hi - lo)
            gone = np.zeros(len(t["doc"]), bool)
            some = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
            bounds = np.searchsorted(t["doc"], np.arange(hi - lo + 1))
            out = {}
            raw = data.tobytes()
            for i in some.tolist():
                a, b = bounds[i], bounds[i + 1]
                drop = np.array(lists[i].as_py(), np.int64)
                hit = np.isin(t["hash"][a:b].view(np.int64), drop)
                gone[a:b] = hit
                kept, upto = [], int(at[i])
                for x, y in zip(t["begin"][a:b][hit].tolist(), t["end"][a:b][hit].tolist(), strict=True):
                    kept.append(raw[upto:x])
                    upto = y
                kept.append(raw[upto : int(at[i + 1])])
                out[i] = b"".join(kept).decode()
            dropped = np.bincount(t["doc"][gone], minlength=hi - lo)
            if out:
                values = texts.to_pylist()
                for i, x in out.items():
                    values[i] = x
                texts = pa.array(values, pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns[: width - 2], texts.cast(pa.string()), pa.array(total, pa.int64()), pa.array(dropped, pa.int64())], names=[*part.schema.names[: width - 2], "_text", "_n_lines", "_n_dropped"])


def drop_recurring_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs with recurring lines dropped from text, everywhere but in the first document (smallest doc_id, null first) that has the
    template, and the columns n_lines (lines with a token) and n_dropped.

    A line's end goes with it. Blank lines, null and empty texts stay. Rows equal in doc_id and text are one document and are treated
    alike. Columns of docs named as results are replaced.
    """
    fp = F.xxhash64(text)
    seen, known = recurring_lines(docs.select(F.col(doc_id).cast("long").alias("doc_id"), fp.alias("fp"), F.col(text).alias("text")), **how)
    away = ~(F.col("doc_id").eqNullSafe(F.col("home_id")) & (F.col("fp") == F.col("home_fp")))
    lists = seen.join(known.select("line", "home_id", "home_fp"), "line").where(away).groupBy(F.col("doc_id").alias("_d"), F.col("fp").alias("_f")).agg(F.collect_set("line").alias("_drop"))
    lists = written(lists, "line-lists").hint("merge")  # as many rows as documents may lose lines
    own = [c for c in docs.columns if c not in (text, "n_lines", "n_dropped")]
    cut = docs.withColumn("_fp", fp).join(lists, F.col(doc_id).cast("long").eqNullSafe(F.col("_d")) & (F.col("_fp") == F.col("_f")), "left").select(*own, text, "_drop")
    schema = ", ".join([*(f"`{c}` {k}" for c, k in docs.select(*own).dtypes), "_text string, _n_lines long, _n_dropped long"])
    out = cut.mapInArrow(_without, schema).withColumnsRenamed({"_text": text, "_n_lines": "n_lines", "_n_dropped": "n_dropped"})
    return out.select(*[c for c in docs.columns if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")


def op10(docs: DataFrame) -> DataFrame:
    """All documents without recurring lines: doc_id, text, n_lines, n_dropped."""
    return drop_recurring_lines(docs.select("doc_id", "text"))


def without_recurring_lines(docs: DataFrame, **how) -> DataFrame:
    """docs without recurring lines, with the same columns; documents of which no line is left are gone, others keep their rows."""
    def work(docs: DataFrame) -> DataFrame:
        out = drop_recurring_lines(docs, **how).where("n_dropped = 0 or n_dropped < n_lines")
        return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)

    return shielded(docs, work)
