"""The table function of units against the column functions that give the same."""

import pytest
from pyspark.errors import AnalysisException

from fiscalens.operators import text as T
from fiscalens.operators import text_tables


def test_units_from_sql_are_those_of_columns(spark):
    text_tables.register(spark)
    texts = ["preamble\r\nAviso de  Licitação nº 1\nline  \n  édital 2\n\n" + "EDITAL " + "x" * 130 + "\nprocesso 3\x85tail\n ", "no header", "", None, "EDITAL", "edital 1  EXTRATO x\t\nEDITAL 2\n\n\nEDITAL", "EDITAL a\n" + "long line of a notice\n" * 50_000, "EDITAL", "ﬁ\nProcésso ß 1\n\x1cx"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for headers in (None, ["Fim", "no  HEADER", "Prô"]):
        how = "" if headers is None else ", headers => array('Fim', 'no  HEADER', 'Prô')"
        got = spark.sql(f"SELECT t.id, s.* FROM {{t}} t, LATERAL notice_segments(t.text{how}) s ORDER BY 1, 2", t=df).collect()
        want = T.segments(df, "id", "text", headers).orderBy("id", "unit").collect()
        assert got == want and got
    # the longest header line, and a table without rows
    assert spark.sql("SELECT s.segment FROM {t} t, LATERAL notice_segments(text, longest => 6) s WHERE id = 4", t=df).collect() == [("EDITAL",)]
    assert spark.sql("SELECT s.segment FROM {t} t, LATERAL notice_segments(text, longest => 5) s WHERE id = 4", t=df).collect() == []
    assert spark.sql("SELECT s.* FROM {t} t, LATERAL notice_segments(text) s", t=df.limit(0)).collect() == []


@pytest.mark.parametrize("call", ["1", "text, array(text)", "text, array('')", "text, longest => id"])
def test_wrong_calls_fail_when_they_are_analysed(spark, call):
    text_tables.register(spark)
    df = spark.createDataFrame([(1, "a")], "id int, text string")
    with pytest.raises(AnalysisException):
        spark.sql(f"SELECT s.* FROM {{t}} t, LATERAL notice_segments({call}) s", t=df)
