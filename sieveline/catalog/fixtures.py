"""Relations derived from the given tables, in Spark and as DuckDB text.

``fx_*`` functions return the Spark relation; the constants of the same name in
upper case are the equivalent SELECT for an oracle's WITH clause.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sieveline.catalog import table

_LINE = """
SELECT concat_ws('-', CAST(l_orderkey AS {string}), CAST(l_linenumber AS {string}),
                 CAST(l_partkey AS {string}), CAST(l_suppkey AS {string}),
                 CAST(CAST(l_shipdate AS DATE) AS {string})) AS row_id,
       l_quantity, l_discount, l_tax, l_extendedprice, l_returnflag, l_linestatus,
       CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label
FROM {lineitem}"""

_CUST = """
SELECT c.c_custkey AS row_id, c.c_acctbal, n.n_name, r.r_name,
       CAST(count(o.o_orderkey) AS BIGINT) AS n_orders,
       coalesce(avg(o.o_totalprice), 0) AS avg_total,
       CAST(sum(CASE WHEN o.o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS BIGINT) AS n_urgent,
       CASE WHEN c.c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS label
FROM {customer} c
JOIN {nation} n ON c.c_nationkey = n.n_nationkey
JOIN {region} r ON n.n_regionkey = r.r_regionkey
LEFT JOIN {orders} o ON o.o_custkey = c.c_custkey
GROUP BY c.c_custkey, c.c_acctbal, n.n_name, r.r_name, c.c_mktsegment"""

_DOC = """
SELECT d.doc_id AS row_id, d.n_chars, d.lang, d.source,
       l.quality AS label, l.toxic AS group_id
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id"""

_BINS_SPARK = """
SELECT user_id AS entity, event_type AS concept,
       CAST(floor((unix_timestamp(ts) - unix_timestamp(CAST('2024-01-01' AS TIMESTAMP))) / 14400D) AS BIGINT) AS bin,
       max_by(value, event_id) AS value
FROM {events} GROUP BY 1, 2, 3"""

BINS = """
SELECT user_id AS entity, event_type AS concept,
       CAST(floor((floor(epoch(ts)) - epoch(TIMESTAMP '2024-01-01')) / 14400.0) AS BIGINT) AS bin,
       max_by(value, event_id) AS value
FROM events GROUP BY 1, 2, 3"""

_SCORES = """
SELECT p_brand AS llm_model, p_name AS concept, avg(p_retailprice) / 2000 AS score
FROM {part} GROUP BY p_brand, p_name"""

_COMPLETIONS = """
SELECT p_name AS concept, p_partkey AS sample_id, CASE p_partkey % 4
  WHEN 0 THEN concat('{{"reasoning": "r', CAST(p_size AS {string}), '", "score": ', CAST(p_size AS {string}), '.5}}')
  WHEN 1 THEN concat('Sure, here it is:', chr(10), '{{"reasoning": "x", "score": ', CAST(p_size AS {string}), '}}', chr(10), 'Done.')
  WHEN 2 THEN concat('{{"score": "', CAST(p_size AS {string}), '.25", "reasoning": "q"}}')
  ELSE concat('no json for ', p_name) END AS text
FROM {part}"""

_PATHS = """
SELECT p_brand AS fs_method, CAST(p_size AS DOUBLE) / 50 AS frac, avg(p_retailprice) / 2000 AS metric
FROM {part} GROUP BY p_brand, p_size"""

_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings labels".split()
)


def duck(text: str) -> str:
    return text.format(string="VARCHAR", **{t: t for t in _TABLES})


LINE, CUST, DOC = duck(_LINE), duck(_CUST), duck(_DOC)
SCORES, COMPLETIONS, PATHS = duck(_SCORES), duck(_COMPLETIONS), duck(_PATHS)


def run(spark: SparkSession, sf: str, text: str, *names: str) -> DataFrame:
    return spark.sql(
        text.replace("{string}", "STRING"), **{n: table(spark, sf, n) for n in names}
    )


def fx_line(spark, sf):
    return run(spark, sf, _LINE, "lineitem")


def fx_cust(spark, sf):
    return run(spark, sf, _CUST, "customer", "nation", "region", "orders")


def fx_doc(spark, sf):
    return run(spark, sf, _DOC, "documents", "labels")


def fx_bins(spark, sf):
    return run(spark, sf, _BINS_SPARK, "events")


def fx_scores(spark, sf):
    return run(spark, sf, _SCORES, "part")


def fx_completions(spark, sf):
    return run(spark, sf, _COMPLETIONS, "part")


def fx_paths(spark, sf):
    return run(spark, sf, _PATHS, "part")


LINE_NUM = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]
CUST_NUM = ["c_acctbal", "n_orders", "avg_total", "n_urgent"]


def duck_hash(seed, *cols: str) -> str:
    """The DuckDB form of ``stable_hash``."""
    parts = ", ".join(f"CAST({c} AS VARCHAR)" for c in cols)
    return f"('0x' || substr(md5(concat_ws('|', '{seed}', {parts})), 1, 15))::BIGINT"


def duck_long(cols: list[str], keep: str, relation: str, cast: str = "DOUBLE") -> str:
    """UNION ALL unpivot of ``cols``."""
    return " UNION ALL ".join(
        f"SELECT {keep}{', ' if keep else ''}'{c}' AS feature, CAST({c} AS {cast}) AS value FROM {relation}" for c in cols
    )


def d6(expr: str) -> str:
    return f"round({expr}, 6) + 0.0"


def d9(expr: str) -> str:
    return f"round({expr}, 9) + 0.0"
