"""Functions of SQL that give tables: a row in, its parts as rows out."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from ..functions.normalize import SPACES, bare
from .text import HEADERS, LINE_END

_SCHEMA = StructType().add("unit", IntegerType(), False).add("segment", StringType(), False)


class NoticeSegments:
    """``notice_segments(text [, headers => array(...)] [, longest => 120])``: a text's units as rows (unit from 0, segment), as
    ``operators.text.segments`` has them: each begins at a line of at most ``longest`` characters that begins like a header, whatever its
    case and marks; what stands before the first is dropped. A NULL text, or one without a header, gives no rows.

    Headers and ``longest`` must be constants: they are looked at once, when the query is analysed, not row by row.
    """

    @staticmethod
    def analyze(text: AnalyzeArgument, headers: AnalyzeArgument | None = None, longest: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(text.dataType, StringType) and text.dataType.typeName() != "void":
            raise ValueError("notice_segments takes a text")
        if headers is not None and not (headers.isConstantExpression and isinstance(headers.dataType, ArrayType) and headers.value and all(headers.value)):
            raise ValueError("headers must be a constant array of texts that are not empty")
        if longest is not None and not (longest.isConstantExpression and isinstance(longest.value, int)):
            raise ValueError("longest must be a constant number")
        return AnalyzeResult(_SCHEMA)

    def __init__(self) -> None:
        self._given: list[str] | None = None
        self._begin: tuple[str, ...] = ()

    def eval(self, text: str | None, headers: list[str] | None = None, longest: int = 120):
        if text is None:
            return
        given = list(headers) if headers is not None else HEADERS
        if given != self._given:
            self._given, self._begin = given, tuple(bare(h) for h in given)
        unit, lines = -1, []
        for line in re.split(LINE_END, text):
            if len(head := bare(line)) <= longest and head.startswith(self._begin):
                if lines:
                    yield unit, "\n".join(lines).strip(SPACES)
                unit, lines = unit + 1, []
            if unit >= 0:
                lines.append(line.rstrip(SPACES))
        if lines:
            yield unit, "\n".join(lines).strip(SPACES)


def register(spark: SparkSession) -> None:
    """Make the functions callable from SQL in a session: ``SELECT t.id, s.* FROM t, LATERAL notice_segments(t.text) s``."""
    spark.udtf.register("notice_segments", udtf(NoticeSegments))
