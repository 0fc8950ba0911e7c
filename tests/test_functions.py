import math
import re
import uuid
from statistics import NormalDist

import pandas as pd
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from parcela.functions import (
    absolute_link, cosine, dot, flat_vector, half_even, half_up, norm, normalize_text, or_default, repair_text, to_number, uuid5_dns,
)
from parcela.functions.numbers import with_normal_cdf, with_normal_ppf


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_uuid_equals_the_standard_library(spark):
    texts = ["", "1", "190012345", "ñandú", "a" * 300, "日本"]
    assert column(spark, texts, "string", uuid5_dns("v")) == [str(uuid.uuid5(uuid.NAMESPACE_DNS, t)) for t in texts]


def python_rule(text):
    text = re.sub("[\u00a0\u1680\u2000-\u200b\u202f\u205f\u3000]", " ", text.replace("\n", " "))
    return re.sub(r"\s+", " ", text).strip()


def test_every_blank_is_folded(spark):
    texts = [f"a{chr(c)}b" for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    texts += ["  a \n\t b\u200b  ", "\u200b", "", "uno\u001cdos\u0085tres"]
    assert column(spark, texts, "string", normalize_text("v")) == [python_rule(t) for t in texts]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=40), min_size=1, max_size=60))
def test_any_text(spark, texts):
    assert column(spark, texts, "string", normalize_text("v")) == [python_rule(t) for t in texts]


def test_to_number_follows_pandas(spark):
    texts = ["12", " 12 ", "1e3", "12d", "12f", "1,2", "", None, "abc", "-.5", "+7.", ".", "1e", "inf", "-inf", "0x10", "1 2", "--1", "1E-3"]
    expected = pd.to_numeric(pd.Series(texts), errors="coerce")
    found = column(spark, texts, "string", to_number("v"))
    assert [None if pd.isna(v) else v for v in expected] == found


def test_rounding(spark):
    assert column(spark, [0.5, 1.5, 2.5, -0.5], "double", half_even(F.col("v"))) == [0.0, 2.0, 2.0, 0.0]
    assert column(spark, [0.5, 1.5, 2.5, -0.5, -1.2], "double", half_up(F.col("v"))) == [1, 2, 3, 0, -1]


def test_links_and_defaults(spark):
    assert column(spark, ["http://a", "www.a", None], "string", absolute_link("v")) == ["http://a", "https://www.a", None]
    assert column(spark, ["", None, "x"], "string", or_default("v", "d")) == ["d", "d", "x"]
    assert column(spark, ["https://ficnaraiz/x", "ok", None], "string", repair_text("v", "ficnaraiz", "fincaraiz")) == [
        "https://fincaraiz/x", "ok", None]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, -1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    rows = df.select(dot("a", "b"), norm("a"), cosine("a", "b")).collect()
    assert rows[0][0] == 1.0 and math.isclose(rows[0][1], 5 ** 0.5) and math.isclose(rows[0][2], 1 / 50 ** 0.5)
    assert rows[1][2] is None
    assert df.select(flat_vector(F.array("a"))).first()[0] == [1.0, 2.0]


def test_normal_distribution(spark):
    nd = NormalDist()
    probs = [1e-12, 1e-7, 0.001, 0.02, 0.075, 0.3, 0.5, 0.7, 0.925, 0.999, 1 - 1e-7]
    df = spark.createDataFrame([(p,) for p in probs], "p double")
    both = with_normal_cdf(with_normal_ppf(df, "p", "z"), "z", "back")
    for r in both.collect():
        assert math.isclose(r["z"], nd.inv_cdf(r["p"]), rel_tol=1e-12, abs_tol=1e-13)
        assert math.isclose(r["back"], 0.5 * math.erfc(-r["z"] / 2 ** 0.5), rel_tol=1e-8)
    outside = spark.createDataFrame([(0.0,), (1.0,), (None,)], "p double")
    assert [r["z"] for r in with_normal_ppf(outside, "p", "z").collect()] == [None, None, None]
