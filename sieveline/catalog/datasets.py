"""Queries: dataset specs (DS1-DS13), projections and filters (PRJ*, FIL*), joins JON1-JON6.

The raw source of each spec is derived from a whole given table by renaming and
recoding its columns, so the spec runs over real rows of every scale factor.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.catalog import query, rounded, rounded9, table
from sieveline.catalog.fixtures import (
    BINS, CUST, DOC, LINE, LINE_NUM, SCORES, d6, d9, fx_bins, fx_cust, fx_line, fx_scores, run,
)
from sieveline.operators import bins as bn
from sieveline.operators.encode import apply_mask
from sieveline.operators.ordering import quantiles
from sieveline.operators.split import balance
from sieveline.operators.stats import to_long
from sieveline.plans import datasets as ds
from sieveline.plans import specs

_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_partkey", "l_suppkey"]
_ROW_ID = (
    "concat_ws('-', CAST(l_orderkey AS {s}), CAST(l_linenumber AS {s}), CAST(l_partkey AS {s}), "
    "CAST(l_suppkey AS {s}), CAST(CAST(l_shipdate AS DATE) AS {s}))"
)


def _raw(spec, extra: dict[str, str], spark_side: bool) -> str:
    """SELECT over lineitem giving the spec's source columns, in either dialect."""
    q = "`" if spark_side else '"'
    cols = {c: f"CAST({_NUMBERS[i % 7]} AS DOUBLE)" for i, c in enumerate(spec.concepts) if c not in spec.derive}
    cols |= extra
    s = "STRING" if spark_side else "VARCHAR"
    body = ", ".join(f"{e} AS {q}{c}{q}" for c, e in cols.items())
    return f"SELECT {_ROW_ID.format(s=s)} AS row_id, {body} FROM " + ("{lineitem}" if spark_side else "lineitem")


def _dq(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _expected(spec, extra, label: str, where: str = "true", derive: dict[str, str] | None = None, head: str = "") -> str:
    derive = derive or {}
    cols = ", ".join(f'{derive.get(c, _dq(c))} AS {_dq(name)}' for c, name in spec.concepts.items())
    return (
        f"WITH raw AS ({_raw(spec, extra, False)}) "
        f"SELECT row_id, CAST({label} AS DOUBLE) AS label, {head}{cols} FROM raw WHERE {where}"
    )


def _register(key, spec, extra, label, **expected):
    @query(key, _expected(spec, extra, label, **expected))
    def build(spark, sf):
        raw = run(spark, sf, _raw(spec, extra, True), "lineitem")
        return specs.build_dataset(raw, spec, "row_id")

    return build


_CARS = {
    "Selling_Price": "l_extendedprice", "Year": "2000 + l_linenumber", "Car_Name": "l_returnflag",
    "Fuel_Type": "l_returnflag", "Selling_type": "l_linestatus", "Transmission": "l_linestatus",
}
_register("ds1_cars", ds.CARS, _CARS, "Selling_Price", derive={"Age": "2023 - Year"})

_FLAG = {"Outcome": "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END"}
_register("ds2_pima", ds.PIMA, _FLAG, "Outcome")

_CREDIT = {
    "SeriousDlqin2yrs": "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END",
    "NumberOfDependents": "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END",
    "MonthlyIncome": "CASE WHEN l_quantity = 13 THEN NULL ELSE l_extendedprice END",
}
_register("ds3_give_me_credit", ds.GIVE_ME_CREDIT, _CREDIT, "SeriousDlqin2yrs",
          where='"NumberOfDependents" IS NOT NULL AND "MonthlyIncome" IS NOT NULL')

_DAYS = "CAST('2013-01-01 00:00:00' AS TIMESTAMP)"
_COMPAS = {
    "days_b_screening_arrest": "CASE WHEN l_quantity = 50 THEN NULL ELSE l_quantity * 2 - 50 END",
    "is_recid": "CASE WHEN l_linenumber = 7 THEN -1 ELSE 1 END",
    "c_charge_degree": "CASE WHEN l_tax = 0.08 THEN 'O' WHEN l_tax < 0.04 THEN 'F' ELSE 'M' END",
    "score_text": "CASE WHEN l_discount = 0.1 THEN 'N/A' WHEN l_discount < 0.05 THEN 'Low' WHEN l_discount < 0.08 THEN 'Medium' ELSE 'High' END",
    "c_jail_in": "l_shipdate", "c_jail_out": "l_shipdate + INTERVAL '37' HOUR", "dob": "CAST(l_shipdate AS DATE)",
    "sex": "l_returnflag", "age_cat": "l_linestatus", "race": "l_returnflag",
}
_COMPAS_DERIVED = {
    "c_jail_los": "CAST(floor((epoch(c_jail_out) - epoch(c_jail_in)) / 86400.0) AS BIGINT)",
    "c_jail_in_year": "CAST(year(c_jail_in) AS INT)", "c_jail_out_year": "CAST(year(c_jail_out) AS INT)",
    "dob_year": "CAST(year(dob) AS INT)",
}
_register("ds4_compas", ds.COMPAS, _COMPAS, "score_text <> 'Low'", derive=_COMPAS_DERIVED,
          where="days_b_screening_arrest BETWEEN -30 AND 30 AND is_recid <> -1 AND c_charge_degree <> 'O' AND score_text <> 'N/A'")


@query("ds5_miami_housing", _expected(ds.MIAMI_HOUSING, {"SALE_PRC": "l_extendedprice", "PARCELNO": "l_orderkey"}, "round(ln(SALE_PRC), 6)"))
def ds5(spark, sf):
    raw = run(spark, sf, _raw(ds.MIAMI_HOUSING, {"SALE_PRC": "l_extendedprice", "PARCELNO": "l_orderkey"}, True), "lineitem")
    return rounded(specs.build_dataset(raw, ds.MIAMI_HOUSING, "row_id"), "label")


_register("ds6_breast_cancer", ds.BREAST_CANCER, {"target": "CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END"}, "target")


@query("ds7_wine", _expected(ds.WINE, {"quality": "l_linenumber"}, "quality"))
def ds7(spark, sf):
    raw = run(spark, sf, _raw(ds.WINE, {"quality": "l_linenumber"}, True), "lineitem")
    red, white = raw.filter("quality < 4"), raw.filter("quality >= 4")  # two stacked sources
    return specs.build_dataset(red.unionByName(white), ds.WINE, "row_id")


_CREDIT_G = {
    "class": "CASE WHEN l_returnflag = 'R' THEN 'bad' ELSE 'good' END", "checking_status": "l_returnflag",
    "credit_history": "l_linestatus", "purpose": "l_returnflag", "job": "l_linestatus", "housing": "l_linestatus",
}
_register("ds8_credit_g", ds.CREDIT_G, _CREDIT_G, '"class" = \'good\'')
_register("ds9_diabetes", ds.DIABETES, {"target": "l_extendedprice"}, "target")
_register("ds10_calhousing", ds.CALHOUSING, {"target": "l_extendedprice"}, "target")
_register("ds11_bank", ds.BANK, {"Class": "CASE WHEN l_returnflag = 'R' THEN '2' ELSE '1' END", "V2": "l_returnflag"}, '"Class" = \'2\'')

# survey microdata: a handful of person columns, some excluded per task
_SURVEY_COLS = {
    "SERIALNO": "l_orderkey", "RT": "'P'", "AGEP": "CAST(l_quantity * 2 AS DOUBLE)",
    "PINCP": "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_extendedprice END",
    "WKHP": "l_discount * 400", "PWGTP": "l_linenumber", "ESR": "CAST(l_linenumber AS DOUBLE)",
    "PUBCOV": "CASE WHEN l_linestatus = 'O' THEN 1.0E0 ELSE 2.0E0 END", "MIG": "CASE WHEN l_returnflag = 'A' THEN 1.0E0 ELSE 3.0E0 END",
    "RAC1P": "l_linenumber", "SCHL": "CASE WHEN l_tax = 0.0 THEN NULL ELSE l_tax * 100 END",
    "HINS1": "l_discount", "OCCP": "l_partkey", "MIGSP": "l_suppkey",
}
_SURVEY_EXPECT = {
    "income": ("PINCP > 50000", "AGEP > 16 AND PINCP > 100 AND WKHP > 0 AND PWGTP >= 1",
               ["AGEP", "WKHP", "PWGTP", "ESR", "MIG", "RAC1P", "SCHL", "OCCP", "MIGSP"]),
    "employment": ("ESR = 1", "AGEP > 16 AND AGEP < 90 AND PWGTP >= 1",
                   ["AGEP", "WKHP", "PWGTP", "PUBCOV", "MIG", "RAC1P", "SCHL", "HINS1", "MIGSP"]),
    "public_coverage": ("PUBCOV = 1", "AGEP < 65 AND PINCP <= 30000",
                        ["AGEP", "PINCP", "WKHP", "PWGTP", "ESR", "MIG", "RAC1P", "SCHL", "OCCP", "MIGSP"]),
    "mobility": ("MIG = 1", "AGEP > 18 AND AGEP < 35",
                 ["AGEP", "PINCP", "WKHP", "PWGTP", "ESR", "PUBCOV", "RAC1P", "SCHL", "HINS1", "OCCP"]),
}


def _survey_raw(spark_side: bool) -> str:
    s = "STRING" if spark_side else "VARCHAR"
    body = ", ".join(f"{e} AS {c}" for c, e in _SURVEY_COLS.items())
    return f"SELECT {_ROW_ID.format(s=s)} AS row_id, {body} FROM " + ("{lineitem}" if spark_side else "lineitem")


def _register_survey(task):
    label, where, kept = _SURVEY_EXPECT[task]
    if task == "employment":
        kept = [c for c in kept if c != "WKHP"]
    cols = ", ".join(f"{'coalesce(' + c + ', 0)' if c in ('PINCP', 'SCHL') else c} AS {c}" for c in kept)
    sql = (f"WITH raw AS ({_survey_raw(False)}) SELECT row_id, CAST(coalesce({label}, false) AS DOUBLE) AS label, "
           f"CAST(RAC1P AS DOUBLE) AS group_id, {cols} FROM raw WHERE {where}")

    @query(f"ds12_survey_{task}", sql)
    def build(spark, sf):
        raw = run(spark, sf, _survey_raw(True), "lineitem")
        spec = ds.survey_spec(task, [c for c in raw.columns if c != "row_id"])
        return specs.build_dataset(raw, spec, "row_id")


for _task in _SURVEY_EXPECT:
    _register_survey(_task)


@query("prj3_excluded_columns_with_parity", f"""
WITH raw AS ({_survey_raw(False)}) SELECT row_id, coalesce((MIG = 1), false)::DOUBLE AS label, RAC1P::DOUBLE AS group_id,
  AGEP, coalesce(PINCP, 0) AS PINCP, WKHP, PWGTP, ESR, PUBCOV, coalesce(SCHL, 0) AS SCHL, HINS1, OCCP FROM raw WHERE AGEP > 18 AND AGEP < 35""")
def prj3(spark, sf):
    raw = run(spark, sf, _survey_raw(True), "lineitem")
    spec = ds.survey_spec("mobility", [c for c in raw.columns if c != "row_id"], eval_parity=True)
    return specs.build_dataset(raw, spec, "row_id")


_CLINICAL = f"""
WITH fx AS ({BINS.replace('14400.0', '432000.0')}),
ents AS (SELECT DISTINCT entity FROM fx WHERE bin BETWEEN 0 AND 5),
cons AS (SELECT DISTINCT event_type AS concept FROM events),
grid AS (SELECT entity, concept, b AS bin FROM ents, cons, range(0, 6) t(b)),
dense AS (
  SELECT g.entity, g.concept, g.bin::INT AS bin, fx.value, (fx.value IS NOT NULL)::INT::DOUBLE AS mask,
    ((g.bin - coalesce(max(CASE WHEN fx.value IS NOT NULL THEN g.bin END) OVER (
        PARTITION BY g.entity, g.concept ORDER BY g.bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * 120)::DOUBLE AS delta
  FROM grid g LEFT JOIN fx ON fx.entity = g.entity AND fx.concept = g.concept AND fx.bin = g.bin)
"""
_BIN_H, _N_BINS = 120, 6  # six bins over the whole month of events


def _concepts(spark, sf) -> list[str]:
    return sorted(r[0] for r in table(spark, sf, "events").select("event_type").distinct().collect())  # a concept list


def dense_events(spark, sf):
    last = bn.last_per_bin(
        table(spark, sf, "events"), "user_id", "event_type", "value", "ts", "event_id", "2024-01-01", _BIN_H
    )
    return bn.dense_bins(last, _concepts(spark, sf), _N_BINS, _BIN_H)


@query("trf10_event_bins", _CLINICAL + f"SELECT entity, concept, bin, {d6('value')} AS value, mask, delta FROM dense")
def trf10(spark, sf):
    return rounded(dense_events(spark, sf), "value")


_EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def _flat_sql(measures=("value", "mask", "delta"), rel="dense") -> str:
    cols = []
    for m in measures:
        for c in _EVENT_TYPES:
            for b in range(_N_BINS):
                name = f"{c}{'' if m == 'value' else '_' + m}_{b * _BIN_H}hr"
                cols.append(f"max(CASE WHEN concept = '{c}' AND bin = {b} THEN coalesce({m}, 0) END) AS \"{name}\"")
    return f"SELECT entity, {', '.join(cols)} FROM {rel} GROUP BY entity"


@query("trf7_flattened_bins", _CLINICAL + _flat_sql())
def trf7(spark, sf):
    return bn.flatten_bins(dense_events(spark, sf), _concepts(spark, sf), _N_BINS, _BIN_H)


_SCALED = _CLINICAL + f""",
st AS (SELECT concept, avg(value) AS m, stddev_pop(value) AS s FROM dense GROUP BY concept),
sd AS (SELECT avg(delta) AS m, stddev_pop(delta) AS s, concept FROM dense GROUP BY concept),
scaled AS (SELECT entity, concept, bin, {d6('coalesce((value - st.m) / st.s, 0)')} AS value, mask,
             {d6('(delta - sd.m) / sd.s')} AS delta
           FROM dense JOIN st USING (concept) JOIN sd USING (concept))
"""


def scaled_events(spark, sf):
    from sieveline.operators.encode import pooled_scale

    dense = dense_events(spark, sf)
    out = pooled_scale(dense, "concept", "value", "value")
    return pooled_scale(out, "concept", "delta", "delta")


@query("trf9_pooled_standardized_bins", _SCALED + "SELECT * FROM scaled")
def trf9(spark, sf):
    return rounded(scaled_events(spark, sf).select("entity", "concept", "bin", "value", "mask", "delta"), "value", "delta")


@query("ds13_clinical_flat", _SCALED + f""",
flat AS ({_flat_sql(rel='scaled')})
SELECT coalesce(entity, c_custkey) AS entity, flat.* EXCLUDE (entity), c_acctbal AS balance, CAST(c_mktsegment = 'BUILDING' AS INT)::DOUBLE AS label
FROM flat FULL JOIN customer ON c_custkey = entity""")
def ds13(spark, sf):
    scaled = rounded(scaled_events(spark, sf), "value", "delta")
    flat = bn.flatten_bins(scaled, _concepts(spark, sf), _N_BINS, _BIN_H)
    static = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("entity"), F.col("c_acctbal").alias("balance"),
        (F.col("c_mktsegment") == "BUILDING").cast("double").alias("label"),
    )
    return bn.join_static(flat, static, "full")


@query("trf6_selected_concept_measures", _CLINICAL + "SELECT concept, count(*) AS n, sum(mask) AS seen FROM dense WHERE concept IN ('click', 'view') GROUP BY concept")
def trf6(spark, sf):
    kept = bn.select_concepts_long(dense_events(spark, sf), ["click", "view"])
    return kept.groupBy("concept").agg(F.count(F.lit(1)).alias("n"), F.sum("mask").alias("seen"))


@query("jon3_static_repeated_over_bins", _CLINICAL + """
SELECT entity, concept, bin::DOUBLE AS bin, mask, c_acctbal AS balance FROM dense FULL JOIN (SELECT c_custkey AS entity, c_acctbal FROM customer) c USING (entity)""")
def jon3(spark, sf):
    static = table(spark, sf, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_acctbal").alias("balance"))
    return bn.join_static(dense_events(spark, sf), static, "full").select(
        "entity", "concept", F.col("bin").cast("double").alias("bin"), "mask", "balance"
    )


@query("trf8_sequences", _CLINICAL + """
SELECT entity, concept, count(*) AS steps, string_agg(mask::INT::VARCHAR, '' ORDER BY bin) AS masks FROM dense GROUP BY ALL""")
def trf8(spark, sf):
    seq = bn.sequences(dense_events(spark, sf))
    masks = F.array_join(F.transform("steps", lambda s: s["mask"].cast("int").cast("string")), "")
    return seq.select("entity", "concept", F.size("steps").cast("bigint").alias("steps"), masks.alias("masks"))


@query("arr1_long_to_wide", f"""
WITH fx AS ({BINS.replace('14400.0', '432000.0')}) {_flat_sql(('value',), 'fx')}""".replace("coalesce(value, 0)", "round(value, 6) + 0.0"))
def arr1(spark, sf):
    last = bn.last_per_bin(table(spark, sf, "events"), "user_id", "event_type", "value", "ts", "event_id", "2024-01-01", _BIN_H)
    wide = bn.flatten_bins(last, _concepts(spark, sf), _N_BINS, _BIN_H, measures=("value",))
    return rounded(wide, *[c for c in wide.columns if c != "entity"])


# --- projections and filters -------------------------------------------------------------


@query("prj1_rename", "SELECT l_quantity AS \"Quantity\", l_discount AS \"Discount (share)\" FROM lineitem")
def prj1(spark, sf):
    df = table(spark, sf, "lineitem").select("l_quantity", "l_discount")
    return df.withColumnsRenamed({"l_quantity": "Quantity", "l_discount": "Discount (share)"})


@query("prj2_drop_columns", "SELECT * EXCLUDE (p_name, p_type) FROM part")
def prj2(spark, sf):
    return table(spark, sf, "part").drop("p_name", "p_type")


@query("prj4_selected_in_selection_order", f"""
WITH raw AS ({_raw(ds.PIMA, _FLAG, False)}) SELECT row_id, Outcome::DOUBLE AS label,
 "BMI" AS "Body mass index (weight in kg/(height in m)^2)", "Age" AS "Age" FROM raw""")
def prj4(spark, sf):
    raw = run(spark, sf, _raw(ds.PIMA, _FLAG, True), "lineitem")
    return specs.build_dataset(raw, ds.PIMA, "row_id", ["Body mass index (weight in kg/(height in m)^2)", "Age"])


@query("prj5_selected_in_source_order", f"WITH fx AS ({LINE}) SELECT row_id, l_discount, l_extendedprice FROM fx")
def prj5(spark, sf):
    df = fx_line(spark, sf)
    return df.select("row_id", *specs.select_in_source_order(df.columns, ["l_extendedprice", "l_discount"]))


@query("prj6_apply_mask", f"WITH fx AS ({LINE}) SELECT row_id, l_quantity, l_tax FROM fx")
def prj6(spark, sf):
    return apply_mask(fx_line(spark, sf), LINE_NUM, [True, False, True, False], ["row_id"])


@query("prj7_train_selection_on_test", f"""
WITH fx AS ({LINE}) SELECT row_id, l_extendedprice, l_quantity FROM fx""")
def prj7(spark, sf):
    from sieveline.operators.select import mrmr

    df = fx_line(spark, sf)
    names = [f for f, _ in mrmr(df, ["l_quantity", "l_extendedprice"], "label", "classification")]
    return apply_mask(df, LINE_NUM, names, ["row_id"])


@query("fil1_conjunctive_filter", """
SELECT o_orderkey, o_totalprice FROM orders
WHERE o_totalprice <= 300000 AND o_totalprice >= 1000 AND o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW'""")
def fil1(spark, sf):
    return table(spark, sf, "orders").filter(
        "o_totalprice <= 300000 AND o_totalprice >= 1000 AND o_orderstatus != 'P' AND o_orderpriority != '5-LOW'"
    ).select("o_orderkey", "o_totalprice")


_WITH_NULLS = "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS price, o_orderstatus FROM {orders}"


@query("fil2_drop_missing", f"SELECT * FROM ({_WITH_NULLS.format(orders='orders')}) WHERE price IS NOT NULL")
def fil2(spark, sf):
    return run(spark, sf, _WITH_NULLS, "orders").na.drop("any")


def trim_above(df, limits: dict[str, float]):
    """Keep rows at or below every column's exact quantile, all taken on the untrimmed rows."""
    long = to_long(df, list(limits), [])
    probs = sorted(set(limits.values()))
    cuts = {r["feature"]: r for r in quantiles(long, ["feature"], "value", probs, series=len(limits)).collect()}  # one row per column
    cond = F.lit(True)
    for c, p in limits.items():
        cond = cond & (F.col(f"`{c}`") <= F.lit(cuts[c][f"q{probs.index(p)}"]))
    return df.filter(cond)


@query("fil3_quantile_trim", f"""
WITH fx AS ({LINE}) SELECT row_id, l_extendedprice, l_quantity FROM fx
WHERE l_extendedprice <= (SELECT quantile_cont(l_extendedprice, 0.95) FROM fx)
  AND l_quantity <= (SELECT quantile_cont(l_quantity, 0.998) FROM fx) AND l_tax <= (SELECT quantile_cont(l_tax, 0.95) FROM fx)""")
def fil3(spark, sf):
    df = trim_above(fx_line(spark, sf), {"l_extendedprice": 0.95, "l_quantity": 0.998, "l_tax": 0.95})
    return df.select("row_id", "l_extendedprice", "l_quantity")


@query("ds3_trimmed_and_balanced", f"""
WITH raw AS ({_raw(ds.GIVE_ME_CREDIT, _CREDIT, False)}), ok AS (
  SELECT * FROM raw WHERE "NumberOfDependents" IS NOT NULL AND "MonthlyIncome" IS NOT NULL),
q AS (SELECT {', '.join(f'quantile_cont("{c}", {p}) AS q{i}' for i, (c, p) in enumerate(ds.GIVE_ME_CREDIT_TRIM.items()))} FROM ok),
trimmed AS (SELECT ok.* FROM ok, q WHERE {' AND '.join(f'"{c}" <= q{i}' for i, c in enumerate(ds.GIVE_ME_CREDIT_TRIM))}),
n AS (SELECT count(*) FILTER (SeriousDlqin2yrs = 1) AS pos, count(*) FILTER (SeriousDlqin2yrs = 0) AS neg FROM trimmed)
SELECT SeriousDlqin2yrs::DOUBLE AS label, CASE WHEN SeriousDlqin2yrs = 1 THEN any_value(pos) ELSE least(any_value(pos), any_value(neg)) END AS n
FROM trimmed, n GROUP BY SeriousDlqin2yrs""")
def ds3_options(spark, sf):
    raw = run(spark, sf, _raw(ds.GIVE_ME_CREDIT, _CREDIT, True), "lineitem").na.drop("any")
    trimmed = trim_above(raw, ds.GIVE_ME_CREDIT_TRIM)
    built = specs.build_dataset(trimmed, ds.GIVE_ME_CREDIT, "row_id")
    return balance(built, "row_id", "label").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("fil4_task_filters", f"WITH raw AS ({_survey_raw(False)}) " + " UNION ALL ".join(
    f"SELECT '{t}' AS task, count(*) AS n FROM raw WHERE {w}" for t, (_, w, _c) in _SURVEY_EXPECT.items()))
def fil4(spark, sf):
    raw = run(spark, sf, _survey_raw(True), "lineitem")
    counts = raw.agg(*[F.count(F.when(F.expr(w), 1)).alias(t) for t, w in ds.SURVEY_FILTER.items()])
    entries = F.array(*[F.struct(F.lit(t).alias("task"), F.col(t).alias("n")) for t in ds.SURVEY_FILTER])
    return counts.select(F.explode(entries).alias("e")).select("e.*")


@query("fil5_label_predicates", f"""
WITH raw AS ({_survey_raw(False)}) SELECT coalesce(PINCP > 50000, false)::DOUBLE AS income, (ESR = 1)::DOUBLE AS employment,
 (PUBCOV = 1)::DOUBLE AS public_coverage, (MIG = 1)::DOUBLE AS mobility, count(*) AS n FROM raw GROUP BY ALL""")
def fil5(spark, sf):
    raw = run(spark, sf, _survey_raw(True), "lineitem")
    labels = raw.select(*[F.expr(f"coalesce({e}, false)").cast("double").alias(t) for t, e in ds.SURVEY_LABEL.items()])
    return labels.groupBy(*ds.SURVEY_LABEL).agg(F.count(F.lit(1)).alias("n"))


@query("fil6_listed_methods", f"""
WITH fx AS ({SCORES}) SELECT llm_model, concept, {d9('score')} AS score FROM fx WHERE llm_model IN ('Brand#1', 'Brand#5')""")
def fil6(spark, sf):
    return rounded9(fx_scores(spark, sf).filter(F.col("llm_model").isin("Brand#1", "Brand#5")), "score")


# --- joins ----------------------------------------------------------------------------------


@query("jon1_code_definitions", """
WITH d AS (SELECT p_brand AS code, min_by(p_type, p_partkey) AS t, min_by(p_name, p_partkey) AS n FROM part GROUP BY p_brand),
c AS (SELECT code, (row_number() OVER (ORDER BY code) - 1)::INT AS pos FROM d)
SELECT pos, code, n || ' (' || code || ')' AS concept, CASE WHEN t = 'C' THEN 'categorical' ELSE 'numeric' END AS kind
FROM d JOIN c USING (code)""")
def jon1(spark, sf):
    part = table(spark, sf, "part")
    definitions = part.select(
        F.col("p_partkey").alias("line"), F.col("p_brand").alias("code"), F.col("p_type").alias("type_code"),
        F.col("p_name").alias("description"),
    )
    codes = sorted(r[0] for r in part.select("p_brand").distinct().collect())  # the column codes
    return specs.label_codes(part, definitions, codes)


@query("jon2_concept_dtype", """
WITH d AS (SELECT p_name AS feature, min_by(p_type, p_partkey) AS dtype FROM part GROUP BY p_name)
SELECT p_partkey, p_name, dtype FROM part LEFT JOIN d ON p_name = feature""")
def jon2(spark, sf):
    from sieveline.runtime import broadcast_if_small
    from sieveline.sources.readers import first_by_key

    part = table(spark, sf, "part")
    first = first_by_key(part, "p_name", "p_partkey", "p_type").withColumnRenamed("p_type", "dtype")
    return part.select("p_partkey", "p_name").join(broadcast_if_small(first), "p_name", "left")


@query("jon4_features_with_labels", f"WITH fx AS ({DOC}) SELECT row_id, n_chars, lang, source, label, group_id FROM fx")
def jon4(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "n_chars", "lang", "source")
    labels = table(spark, sf, "labels").select(
        F.col("doc_id").alias("row_id"), F.col("quality").alias("label"), F.col("toxic").alias("group_id")
    )
    return docs.join(labels, "row_id")


@query("jon5_members_of_list", f"""
WITH fx AS ({BINS}) SELECT entity, concept, bin, {d6('value')} AS value FROM fx
WHERE concept IN (SELECT event_type FROM events GROUP BY event_type HAVING avg(value) > (SELECT avg(value) FROM events))""")
def jon5(spark, sf):
    events = table(spark, sf, "events")
    mean = events.agg(F.avg("value")).first()[0]
    wanted = events.groupBy(F.col("event_type").alias("concept")).agg(F.avg("value").alias("m")).filter(F.col("m") > mean)
    return rounded(bn.select_concepts_long(fx_bins(spark, sf), wanted), "value").select("entity", "concept", "bin", "value")


@query("jon6_remaining_candidates", f"""
WITH fx AS ({SCORES}), top AS (SELECT llm_model, concept FROM fx QUALIFY row_number() OVER (PARTITION BY llm_model ORDER BY score DESC, concept) <= 5)
SELECT llm_model, concept FROM fx EXCEPT SELECT * FROM top""")
def jon6(spark, sf):
    from pyspark.sql import Window

    scores = fx_scores(spark, sf)
    w = Window.partitionBy("llm_model").orderBy(F.desc("score"), "concept")
    chosen = scores.withColumn("_r", F.row_number().over(w)).filter("_r <= 5").select("llm_model", "concept")
    return scores.select("llm_model", "concept").join(chosen, ["llm_model", "concept"], "left_anti")


@query("set1_union_all_parts", f"WITH fx AS ({CUST}) SELECT label, count(*) AS n FROM fx GROUP BY label")
def set1(spark, sf):
    from sieveline.operators.split import split, take_split

    parts = split(fx_cust(spark, sf).select("row_id", "label"), "row_id", "label")
    whole = take_split(parts, "train").unionByName(take_split(parts, "val")).unionByName(take_split(parts, "test"))
    return whole.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("set3_difference", "SELECT DISTINCT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set3(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti").distinct()


