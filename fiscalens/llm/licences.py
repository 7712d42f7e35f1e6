"""Licence scans: an Aho-Corasick automaton finds notices and identifier tags in a text's words; the expression behind a tag is parsed by
the shunting-yard method and evaluated."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import pieces

#: Lower-cases A-Z, keeps letters, digits and all bytes beyond ASCII, makes the rest spaces.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: Notices that the base asks for.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: The method's own notices, in a text's words.
NOTICES = {
    "mit": ["mit license", "mit licence", "permission is hereby granted free of charge to any person obtaining a copy"],
    "apache-2.0": ["apache license version 2 0", "apache license 2 0", "licensed under the apache license"],
    "bsd": ["bsd license", "redistribution and use in source and binary forms"],
    "bsd-2-clause": ["bsd 2 clause", "2 clause bsd license", "simplified bsd license"],
    "bsd-3-clause": ["bsd 3 clause", "3 clause bsd license", "neither the name of the copyright holder nor the names of its contributors"],
    "isc": ["isc license", "permission to use copy modify and or distribute this software for any purpose"],
    "zlib": ["zlib license"],
    "bsl-1.0": ["boost software license"],
    "gpl-2.0": ["general public license version 2", "general public license v2", "gplv2"],
    "gpl-3.0": ["general public license version 3", "general public license v3", "gplv3"],
    "lgpl": ["lesser general public license", "library general public license"],
    "lgpl-2.1": ["lesser general public license version 2 1", "lesser general public license v2 1"],
    "lgpl-3.0": ["lesser general public license version 3", "lesser general public license v3"],
    "agpl": ["affero general public license"],
    "agpl-3.0": ["affero general public license version 3", "affero general public license v3"],
    "mpl-2.0": ["mozilla public license"],
    "epl": ["eclipse public license"],
    "cddl": ["common development and distribution license"],
    "artistic": ["artistic license"],
    "cc0-1.0": ["cc0", "creative commons zero"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "public-domain": ["released into the public domain", "dedicated to the public domain"],
    "cc-by": ["creative commons attribution", "creative commons attribution license"],
    "cc-by-sa": ["cc by sa", "creative commons attribution sharealike", "creative commons attribution share alike"],
    "cc-by-nc": ["cc by nc", "creative commons attribution noncommercial", "creative commons attribution non commercial"],
    "cc-by-nd": ["cc by nd", "creative commons attribution noderivatives", "creative commons attribution no derivatives"],
    "cc-by-nc-sa": ["cc by nc sa", "creative commons attribution noncommercial sharealike"],
    "cc-by-nc-nd": ["cc by nc nd", "creative commons attribution noncommercial noderivatives"],
    "proprietary": ["proprietary and confidential", "confidential and proprietary"],
}

#: Tags in front of an expression; after a loose one it must hold a known licence to count.
TAGS = {"spdx license identifier": True, "license expression": True, "license": False, "licence": False}

#: How much a licence of a kind restricts use, and identifiers of the kind without version and suffix.
KINDS = {
    0.0: "0bsd cc0 unlicense pddl wtfpl public-domain",
    0.2: "mit mit-0 apache bsd bsd-2-clause bsd-3-clause isc zlib bsl x11 ncsa postgresql python psf unicode-dfs curl libpng",
    0.3: "cc-by odc-by ofl artistic",
    0.5: "lgpl mpl epl cddl cpl ms-pl",
    0.6: "cc-by-sa odbl gfdl",
    0.8: "gpl eupl osl",
    0.9: "agpl sspl cc-by-nc cc-by-nd cc-by-nc-sa cc-by-nc-nd busl",
    1.0: "proprietary reserved",
}
RESTRICTS = {name: value for value, names in KINDS.items() for name in names.split()}
LINKING = 0.5  #: of a copyleft licence with an exception
UNKNOWN = 1.0  #: of an identifier that a firm tag gives and no table has

_VERSION = re.compile(r"-\d+(\.\d+)*(-only|-or-later)?$|-or-later$|-only$")
_GLUE = re.compile(rb"[\"']?[ \t]*[:=][ \t]*[\"']?[ \t]*")
_TOKEN = re.compile(rb"[ \t]*([()]|[A-Za-z0-9](?:[A-Za-z0-9.+:_-]*[A-Za-z0-9+])?)")
_RANK = {"or": 1, "and": 2, "with": 3}


def restriction(licence: str) -> float | None:
    """How much a lower-case identifier restricts, 0 to 1; None for one that no table has. A version and a suffix do not matter."""
    licence = licence.rstrip("+")
    return RESTRICTS.get(licence, RESTRICTS.get(_VERSION.sub("", licence)))


def tokens(raw: bytes, at: int) -> Iterator[str]:
    """Parentheses, identifiers and operators from a byte on, in lower case, up to the line's end or what is none of them."""
    while (m := _TOKEN.match(raw, at)) is not None:
        yield m[1].decode().lower()
        at = m.end()


def postfix(found: Iterable[str]) -> list[str]:
    """The longest valid beginning of an expression in postfix order, by the shunting-yard method: with binds closer than and, and than or.

    It ends before what does not fit, such as a second identifier in a row or an unknown one; an operator left over goes, open
    parentheses are closed there.
    """
    taken: list[str] = []
    complete, depth, operand, exception = 0, 0, True, False
    for t in found:
        if operand:
            known = t not in _RANK and t not in "()" and (t.endswith("exception") or "-exception-" in t if exception else restriction(t) is not None or t.startswith("licenseref-"))
            if t == "(" and not exception:
                depth += 1
            elif known:
                operand = exception = False
            else:
                break
        elif t == ")" and depth:
            depth -= 1
        elif t in _RANK and not (t == "with" and (taken[-1] == ")" or taken[-2:-1] == ["with"])):
            operand, exception = True, t == "with"
        else:
            break
        taken.append(t)
        if not operand:
            complete = len(taken)
    out: list[str] = []
    held: list[str] = []
    for t in taken[:complete]:
        if t == "(":
            held.append(t)
        elif t == ")":
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        elif t in _RANK:
            while held and held[-1] != "(" and _RANK[held[-1]] >= _RANK[t]:
                out.append(held.pop())
            held.append(t)
        else:
            out.append(t)
    return out + [t for t in reversed(held) if t != "("]


def evaluated(expression: list[str]) -> float | None:
    """How much a postfix expression restricts: or leaves the freer choice, and the stricter, with an exception frees linking."""
    stack: list[float | None] = []
    for t in expression:
        if t not in _RANK:
            value = restriction(t)
            stack.append(UNKNOWN if value is None else value)
            continue
        b, a = stack.pop(), stack.pop()
        stack.append(min(a, b) if t == "or" else max(a, b) if t == "and" else min(a, LINKING))
    return stack[0] if stack else None


def licences_of(expression: list[str]) -> list[str]:
    """The identifiers of a postfix expression, without operators and exceptions."""
    return [t for i, t in enumerate(expression) if t not in _RANK and expression[i + 1 : i + 2] != ["with"]]


_built: list[ahocorasick.Automaton] = []


def automaton() -> ahocorasick.Automaton:
    """All phrases between spaces, one character a byte; made once a worker."""
    if not _built:
        own: dict[str, list[tuple]] = {}
        for phrase, label in BASE.items():
            own.setdefault(phrase, []).append((label, "base"))
        for label, phrases in NOTICES.items():
            for phrase in phrases:
                own.setdefault(phrase, []).append((label, "notice"))
        for phrase, firm in TAGS.items():
            own.setdefault(phrase, []).append(("", "firm" if firm else "loose"))
        found = ahocorasick.Automaton()
        for phrase, uses in own.items():
            found.add_word(f" {phrase} ", (len(phrase.split()), uses))
        found.make_automaton()
        _built.append(found)
    return _built[0]


def outermost(spans: list[tuple[int, int, str, str]]) -> Iterator[tuple[tuple[int, int, str, str], bool]]:
    """The spans by start, longer ones first, and whether each lies in none of the others."""
    upto = -1
    for span in sorted(spans, key=lambda s: (s[0], -s[1])):
        yield span, span[0] + span[1] > upto
        upto = max(upto, span[0] + span[1])


def scanned(text: bytes) -> tuple[int, list[tuple[int, int, str, str]], list[tuple[int, str, float, list[str]]]]:
    """(number of words, spans, expressions) of a text. A span is (first word, words, label, base or notice), an expression (first word of its
    tag, postfix form, restriction, licences). A notice within a longer one is no span, unless the base asks for it."""
    folded = text.translate(FOLD)
    words = folded.split()
    joined = b" " + b" ".join(words) + b" "
    spans, tags, counted, number = [], [], 0, 0
    for end, (n, uses) in automaton().iter(joined.decode("latin-1")):
        # matches come by their end; the last word's number from the spaces since the match before
        number += joined.count(b" ", counted, end)
        counted = end
        start = number - n
        for label, use in uses:
            if use in ("base", "notice"):
                spans.append((start, n, label, use))
            else:
                tags.append((start, n, use == "firm"))
    expressions = []
    if tags:
        letter = np.frombuffer(folded + b" ", np.uint8) != 32
        ends = np.flatnonzero(letter[:-1] & ~letter[1:]) + 1
        last = max(s + n - 1 for s, n, firm in tags)
        firmly = {s + n - 1 for s, n, firm in tags if firm}
        for start, n, firm in tags:
            if not firm and start + n - 1 in firmly or start + n - 1 > last:
                continue
            glue = _GLUE.match(text, int(ends[start + n - 1]))
            if not glue:
                continue
            post = postfix(tokens(text, glue.end()))
            if post:
                expressions.append((start, " ".join(post), evaluated(post), licences_of(post)))
            elif firm and _TOKEN.match(text, glue.end()):
                expressions.append((start, "", UNKNOWN, ["unknown"]))
    return len(words), [s for s, outer in outermost(spans) if outer or s[3] == "base"], expressions


def score(spans: list[tuple[int, int, str, str]], expressions: list[tuple[int, str, float, list[str]]]) -> float:
    """How much the strictest of a text's licences restricts, 0 (none stated, or free) to 1 (reserved).

    A base notice within a longer one does not count (the lesser licence's name holds the general one's), and reserved rights only where
    no licence is granted, as many granting notices open with them.
    """
    counts = [s[2] for s, outer in outermost(spans) if outer]
    granted = [restriction(x) for x in counts if x != "reserved"] + [v for _, _, v, _ in expressions]
    return float(max(granted)) if granted else 1.0 if "reserved" in counts else 0.0


SPAN = pa.struct([("start", pa.int64()), ("words", pa.int32()), ("label", pa.string()), ("base", pa.bool_())])
EXPRESSION = pa.struct([("start", pa.int64()), ("postfix", pa.string()), ("restricts", pa.float64()), ("licences", pa.list_(pa.string()))])
SCAN = "doc_id long, n_words long, spans array<struct<start: long, words: int, label: string, base: boolean>>, expressions array<struct<start: long, postfix: string, restricts: double, licences: array<string>>>, score double"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in pieces(batch.column(1)):
            found = [scanned(text or b"") for text in batch.column(1).slice(lo, hi - lo).cast(pa.binary()).to_pylist()]
            spans = pa.array([[{"start": s, "words": n, "label": x, "base": use == "base"} for s, n, x, use in own] for _, own, _ in found], pa.list_(SPAN))
            expressions = pa.array([[{"start": s, "postfix": p, "restricts": v, "licences": x} for s, p, v, x in own] for _, _, own in found], pa.list_(EXPRESSION))
            yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array([n for n, _, _ in found], pa.int64()), spans, expressions, pa.array([score(a, b) for _, a, b in found], pa.float64())], names=["doc_id", "n_words", "spans", "expressions", "score"])


def licence_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of docs: n_words, spans (every place of a notice: first word, words, label, whether the base asks for it), expressions
    (behind identifier tags: first word of the tag, postfix form, how much it restricts, its licences), score.

    Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. Null and empty texts have none of all; texts are taken
    whole. Rows are looked at alone, so repeated rows and ids give the same again; other columns are not read. Places may overlap; each counts.
    """
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_scan, SCAN)


def op13(docs: DataFrame) -> DataFrame:
    """All documents: base places, where the first and last begin, base labels, all labels and the score; nulls and empty strings where
    there is none. An empty table gives no rows."""
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["start"])
    names = lambda spans: F.transform(spans, lambda s: s["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    own = F.flatten(F.transform("expressions", lambda e: e["licences"]))
    return licence_scan(docs).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(names(base)).alias("base_labels"), joined(F.concat(names(F.col("spans")), own)).alias("labels"), "score", F.transform("expressions", lambda e: e["postfix"]).alias("expressions"))
