"""Index-code matching: strict word-boundary test vs tokenised codes (fixed micro-table)."""

from pyspark.sql import functions as F

from retrospark.config import CohortConfig, RawSchema
from retrospark.functions.codes import code_match, normalized_codes
from retrospark.operators.cohort import index_flags

CODES = ["I64", "i63.9", "I639", "XI64", "I69", "E11;I60", None, "กI64"]
STRICT = [True, True, False, False, False, True, False, False]
TOKENS = ["I64", "I63.9", "I63", "I64", "I69", "E11;I60", None, "I64"]


def test_strict_and_tokenised(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(CODES)], "i int, code string")
    rows = df.select("i", code_match("code").alias("hit"), normalized_codes("code").alias("tok")).orderBy("i").collect()
    assert [r.hit for r in rows] == STRICT
    assert [r.tok for r in rows] == TOKENS


def test_source_tag_and_missing_column(spark):
    df = spark.createDataFrame([(1, "I64", "I60"), (2, "I64", None), (3, "A00", "I61"), (4, "A00", "B00")],
                               "hn long, PrincipleDiagnosis string, ComorbidityDiagnosis string")
    out = {r.hn: (r.is_index_event, r.index_event_source) for r in index_flags(df).collect()}
    assert out == {1: (True, "principal_and_comorbidity"), 2: (True, "principal"), 3: (True, "comorbidity"), 4: (False, "")}
    only_p = df.drop("ComorbidityDiagnosis")
    assert index_flags(only_p).where("is_index_event").count() == 2


def test_tokenised_mode_labels_more(spark):
    df = spark.createDataFrame([(1, "2020-01-01", "I639", None)], "hn long, vstdate string, PrincipleDiagnosis string, ComorbidityDiagnosis string")
    strict = index_flags(df, CohortConfig()).first().is_index_event
    tok = index_flags(df, CohortConfig(code_match="tokenised")).first().is_index_event
    assert (strict, tok) == (False, True)
