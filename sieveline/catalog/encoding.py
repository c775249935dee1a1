"""Queries: encoders (TRF1-TRF5, SCA4, SCA6) over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.catalog import query, r6, rounded, table
from sieveline.catalog.fixtures import CUST, LINE, LINE_NUM, d6, fx_cust, fx_line, fx_doc, DOC
from sieveline.functions.scalars import zero_if_missing
from sieveline.operators import encode
from sieveline.operators.split import split, take_split
from sieveline.catalog.splits import _duck_split
from sieveline.plans import datasets as ds


def _z(c: str, rel: str = "fx") -> str:
    return d6(f"({c} - (SELECT avg({c}) FROM {rel})) / (SELECT stddev_pop({c}) FROM {rel})") + f" AS {c}"


@query("trf1_standardized", _duck_split(LINE, "label") + f""",
tr AS (SELECT * FROM sp WHERE split = 'train') SELECT row_id, split, {', '.join(_z(c, 'tr') for c in LINE_NUM)} FROM sp""")
def trf1(spark, sf):
    df = split(fx_line(spark, sf).select("row_id", "label", *LINE_NUM), "row_id", "label")
    model = encode.MixedEncoder(LINE_NUM, []).fit(take_split(df, "train"))
    return rounded(model.transform(df).select("row_id", "split", *LINE_NUM), *LINE_NUM)


_STATUS = {"l_linestatus": ["F", "O"], "l_returnflag": ["A", "N", "R"]}
_HOT = ", ".join(
    f"(coalesce({c} = '{v}', false))::INT::DOUBLE AS \"{c}_{v}\"" for c, vs in _STATUS.items() for v in vs
)


@query("trf2_one_hot", f"WITH fx AS ({LINE}) SELECT row_id, {_HOT} FROM fx")
def trf2(spark, sf):
    df = fx_line(spark, sf).select("row_id", *_STATUS)
    return encode.MixedEncoder([], list(_STATUS)).fit(df).transform(df)


@query("trf2_unknown_category_is_all_zero", """
SELECT doc_id, (lang = 'en')::INT::DOUBLE AS lang_en, (lang = 'de')::INT::DOUBLE AS lang_de FROM documents
""")
def trf2_unknown(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "lang")
    model = encode.MixedEncoder([], ["lang"]).fit(df.filter(F.col("lang").isin("en", "de")))
    return model.transform(df)


@query("trf3_numeric_then_one_hot", f"""
WITH fx AS ({CUST}) SELECT row_id, label, {_z('c_acctbal')}, {_z('avg_total')}, {', '.join(
    f"(r_name = '{r}')::INT::DOUBLE AS \"r_name_{r}\"" for r in ['AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST'])} FROM fx""")
def trf3(spark, sf):
    df = fx_cust(spark, sf).select("row_id", "label", "c_acctbal", "avg_total", "r_name")
    out = encode.MixedEncoder(["c_acctbal", "avg_total"], ["r_name"]).fit(df).transform(df)
    return rounded(out, "c_acctbal", "avg_total")


@query("trf4_one_hot_then_passthrough", f"""
WITH fx AS ({LINE}) SELECT row_id, {_HOT}, l_quantity, {_z('l_extendedprice')} FROM fx""")
def trf4(spark, sf):
    df = fx_line(spark, sf).select("row_id", *_STATUS, "l_quantity", "l_extendedprice")
    enc = encode.MixedEncoder(["l_quantity", "l_extendedprice"], list(_STATUS), one_hot_first=True, scale=["l_extendedprice"])
    return rounded(enc.fit(df).transform(df), "l_extendedprice")


_SPEECH = sorted(ds.SERIES_VOCABULARY["speech"])
_CODED = "CASE p_type " + " ".join(
    f"WHEN '{t}' THEN '{v}'" for t, v in zip(["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL"], _SPEECH, strict=False)
) + " END"


@query("trf5_fixed_vocabulary", f"""
WITH fx AS (SELECT p_partkey, {_CODED} AS speech FROM part)
SELECT p_partkey, {', '.join(f"coalesce(speech = '{v}', false)::INT::DOUBLE AS \"speech_{v}\"" for v in _SPEECH)},
 CASE speech {' '.join(f"WHEN '{v}' THEN {i}.0::DOUBLE" for i, v in enumerate(_SPEECH))} END AS ordinal FROM fx""")
def trf5(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", F.expr(_CODED).alias("speech"))
    hot = encode.vocabulary_one_hot(df, "speech", ds.SERIES_VOCABULARY["speech"])
    return hot.withColumn("ordinal", encode.vocabulary_ordinal("speech", ds.SERIES_VOCABULARY["speech"])).drop("speech")


@query("sca4_missing_to_zero", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 0.0::DOUBLE WHEN o_orderkey % 7 = 0 THEN 0.0 ELSE o_totalprice END AS price FROM orders""")
def sca4(spark, sf):
    price = F.when(F.col("o_orderkey") % 5 == 0, F.lit(float("nan"))).when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice"))
    return table(spark, sf, "orders").select("o_orderkey", zero_if_missing(price).alias("price"))


@query("sca6_fitted_zscore", f"WITH fx AS ({DOC}) SELECT row_id, {_z('n_chars')} FROM fx")
def sca6(spark, sf):
    df = fx_doc(spark, sf)
    scaler = encode.fit_scaler(df, ["n_chars"])
    from sieveline.functions.scalars import zscore

    return df.select("row_id", r6(zscore("n_chars", *scaler["n_chars"])).alias("n_chars"))
