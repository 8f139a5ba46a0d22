"""For each registered query that SQL can express, the same result in DuckDB's SQL."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

# The events with injected nulls, as in the queries.
NULLS = """(SELECT event_id, user_id,
    CASE WHEN event_id % 7 <> 0 THEN value END AS value,
    CASE WHEN event_id % 11 <> 0 THEN event_type END AS event_type FROM events)"""

LINEITEM = {
    "l_orderkey": "Int64", "l_partkey": "Int64", "l_suppkey": "Int64", "l_linenumber": "Int32",
    "l_quantity": "Float64", "l_extendedprice": "Float64", "l_discount": "Float64", "l_tax": "Float64",
    "l_returnflag": "String", "l_linestatus": "String", "l_shipdate": "Datetime(time_unit='us', time_zone=None)",
}
EVENTS = {"event_id": "Int64", "user_id": "Int64", "value": "Float64", "event_type": "String"}
DOCUMENTS = {"doc_id": "Int64", "text": "String", "lang": "String", "source": "String", "n_chars": "Int64"}


def r(value: str, digits: int = 4) -> str:
    return f"(round({value}, {digits}) + 0.0::DOUBLE)"


def numeric(dtype: str) -> bool:
    return dtype.startswith(("Int", "Float"))


# --- profile ------------------------------------------------------------------------------------


def _profile(source: str, columns: dict[str, str]) -> str:
    parts = []
    for c, dtype in columns.items():
        stats = (
            f"{r(f'min({c})::DOUBLE')} AS min, {r(f'max({c})::DOUBLE')} AS max, {r(f'avg({c})')} AS mean, "
            f"{r(f'coalesce(stddev_samp({c}), 0.0)')} AS std"
            if numeric(dtype)
            else "NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS mean, NULL::DOUBLE AS std"
        )
        name = dtype.replace("'", "''")
        parts.append(
            f"SELECT '{c}' AS column_name, '{name}' AS dtype, count(*) AS row_count, "
            f"count(*) FILTER (WHERE {c} IS NULL) AS null_count, "
            f"count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS unique_count, {stats} FROM {source}"
        )
    return " UNION ALL ".join(parts)


ORACLE["profile_lineitem"] = _profile("lineitem", LINEITEM)
ORACLE["profile_nulls"] = _profile(NULLS, EVENTS)
ORACLE["row_count"] = "SELECT count(*) AS row_count FROM lineitem"
ORACLE["profile_column"] = f"SELECT column_name, row_count, null_count, unique_count, mean, std FROM ({_profile(NULLS, {'value': 'Float64'})})"
ORACLE["profile_documents"] = _profile("documents", DOCUMENTS)
ORACLE["profile_by_group"] = " UNION ALL ".join(
    f"SELECT l_returnflag, '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count, "
    f"count(DISTINCT {c}) AS unique_count, {r(f'avg({c})') if numeric(LINEITEM[c]) else 'NULL::DOUBLE'} AS mean "
    "FROM lineitem GROUP BY l_returnflag"
    for c in ("l_quantity", "l_partkey", "l_linestatus")
)
ORACLE["dataset_profile"] = " UNION ALL ".join(
    f"SELECT count(*) AS row_count, 6::INTEGER AS column_count, {i}::INTEGER AS position, '{c}' AS name, "
    f"count(DISTINCT {c}) AS unique_count FROM orders"
    for i, c in enumerate(["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"])
)
ORACLE["columns_with_nulls"] = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name FROM {NULLS} HAVING count(*) > count({c})" for c in EVENTS
)
ORACLE["column_kinds"] = " UNION ALL ".join(
    [f"SELECT '{c}' AS column_name, 'numeric' AS kind" for c in ("o_orderkey", "o_custkey", "o_totalprice")]
    + [
        f"SELECT '{c}', 'categorical' FROM orders HAVING count(DISTINCT {c}) <= 50"
        for c in ("o_orderstatus", "o_orderdate", "o_orderpriority")
    ]
)
ORACLE["sample_values"] = " UNION ALL ".join(
    f"""SELECT * FROM (SELECT '{c}' AS column_name, {c}::VARCHAR AS value, count(*) AS count,
        (row_number() OVER (ORDER BY count(*) DESC, {c}))::INTEGER AS rank FROM orders GROUP BY {c}) WHERE rank <= 5"""
    for c in ("o_custkey", "o_orderstatus", "o_orderpriority")
)
ORACLE["value_counts"] = f"SELECT event_type, count(*) AS count FROM {NULLS} GROUP BY event_type"
ORACLE["quartiles"] = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {r(f'quantile_cont({c}::DOUBLE, 0.25)', 6)} AS q1, "
    f"{r(f'quantile_cont({c}::DOUBLE, 0.75)', 6)} AS q3 FROM lineitem"
    for c, dtype in LINEITEM.items()
    if numeric(dtype)
)
ORACLE["medians"] = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {r(f'median({c}::DOUBLE)', 6)} AS median FROM orders"
    for c in ("o_orderkey", "o_custkey", "o_totalprice")
)


def _fences(source: str, column: str) -> str:
    return (
        f"SELECT q1, q3, q1 - 1.5::DOUBLE * (q3 - q1) AS lower, q3 + 1.5::DOUBLE * (q3 - q1) AS upper FROM "
        f"(SELECT quantile_cont({column}::DOUBLE, 0.25) AS q1, quantile_cont({column}::DOUBLE, 0.75) AS q3 FROM {source})"
    )


ORACLE["outlier_report"] = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, {r('any_value(q1)', 6)} AS q1, {r('any_value(q3)', 6)} AS q3,
        {r('any_value(lower)', 6)} AS lower, {r('any_value(upper)', 6)} AS upper,
        count(*) FILTER (WHERE {c} < lower OR {c} > upper) AS outliers
        FROM {NULLS} AS n, ({_fences(NULLS, c)}) AS f"""
    for c in ("event_id", "user_id", "value")
)


# --- charts -------------------------------------------------------------------------------------

ORACLE["bar_top_k"] = "SELECT p_brand, count(*) AS count FROM part GROUP BY p_brand ORDER BY count DESC, p_brand NULLS LAST LIMIT 20"
ORACLE["bar_with_null"] = (
    f"SELECT event_type, count(*) AS count FROM {NULLS} GROUP BY event_type "
    "ORDER BY count DESC, event_type NULLS LAST LIMIT 3"
)


def _histogram(source: str, column: str, bins: int) -> str:
    """Equal-width bins; a guessed bin number is corrected by comparing with the edges."""
    return f"""
    SELECT {r('e.edge', 6)} AS bin, count(g.i) AS count FROM
      (SELECT i, i * ((hi - lo) / {bins}) + lo AS edge FROM range({bins}) AS t(i),
        (SELECT min({column})::DOUBLE AS lo, max({column})::DOUBLE AS hi FROM {source}) AS s) AS e
      LEFT JOIN
      (SELECT CASE WHEN x < k * step + lo THEN k - 1
                   WHEN k < {bins - 1} AND x >= (k + 1) * step + lo THEN k + 1 ELSE k END AS i
       FROM (SELECT x, lo, (hi - lo) / {bins} AS step, least(floor((x - lo) / (hi - lo) * {bins}), {bins - 1})::BIGINT AS k
             FROM (SELECT {column}::DOUBLE AS x FROM {source} WHERE {column} IS NOT NULL) AS v,
                  (SELECT min({column})::DOUBLE AS lo, max({column})::DOUBLE AS hi FROM {source}) AS s)) AS g
      ON e.i = g.i GROUP BY e.edge"""


ORACLE["histogram_price"] = _histogram("lineitem", "l_extendedprice", 30)
ORACLE["histogram_discount"] = _histogram("lineitem", "l_discount", 20)
ORACLE["histogram_quantity"] = _histogram("lineitem", "l_quantity", 30)
ORACLE["drilldown"] = _histogram("(SELECT l_tax FROM lineitem WHERE l_returnflag = 'R')", "l_tax", 10)
ORACLE["auto_charts"] = " UNION ALL ".join(
    [
        f"SELECT 'histogram' AS type, '{c}' AS column_name, bin, NULL::VARCHAR AS category, count FROM ({_histogram('orders', c, 30)})"
        for c in ("o_orderkey", "o_custkey", "o_totalprice")
    ]
    + [
        f"SELECT 'bar', '{c}', NULL::DOUBLE, {c}, count(*) FROM orders GROUP BY {c}"
        for c in ("o_orderstatus", "o_orderpriority")
    ]
)
ORACLE["correlation_wide"] = f"""
    WITH i AS (SELECT unnest(range(64)) AS i),
    v AS (SELECT vec_id, i, embedding[i + 1]::DOUBLE AS c FROM embeddings, i WHERE (vec_id + i) % 7 <> 0)
    SELECT 'c' || a.i AS x, 'c' || b.i AS y, {r('CASE WHEN a.i = b.i THEN 1.0::DOUBLE ELSE corr(a.c, b.c) END', 6)} AS correlation
    FROM v AS a JOIN v AS b USING (vec_id) GROUP BY a.i, b.i"""
_HEAT = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey"]
ORACLE["correlation_heatmap"] = " UNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, {r('1.0::DOUBLE' if a == b else f'corr({a}::DOUBLE, {b}::DOUBLE)', 6)} AS value FROM lineitem"
    + (" HAVING count(*) > 0" if a == b else "")
    for a in _HEAT
    for b in _HEAT
)
ORACLE["scatter_sample"] = """SELECT l_quantity, l_extendedprice FROM lineitem
    ORDER BY md5(concat_ws('|', l_orderkey, l_linenumber)), l_quantity, l_extendedprice LIMIT 1000"""
ORACLE["line_daily"] = f"SELECT date_trunc('day', ts)::DATE AS ts, {r('avg(value)')} AS value FROM events GROUP BY 1"
ORACLE["line_thinned"] = """
    WITH p AS (SELECT ts, max(value) AS value FROM events WHERE ts IS NOT NULL GROUP BY ts),
    e AS (SELECT min(epoch_us(ts)) AS origin, (max(epoch_us(ts)) - min(epoch_us(ts))) // 100 + 1 AS width, count(*) AS n FROM p),
    b AS (SELECT ts, value, n, (epoch_us(ts) - origin) // width AS span FROM p, e),
    k AS (SELECT *, row_number() OVER (PARTITION BY span ORDER BY ts) AS first, row_number() OVER (PARTITION BY span ORDER BY ts DESC) AS last,
        row_number() OVER (PARTITION BY span ORDER BY value NULLS LAST, ts) AS low,
        row_number() OVER (PARTITION BY span ORDER BY value DESC NULLS LAST, ts) AS high FROM b)
    SELECT ts, value FROM k WHERE n <= 400 OR first = 1 OR last = 1 OR (value IS NOT NULL AND (low = 1 OR high = 1))"""
ORACLE["pie_share"] = f"""
    WITH c AS (SELECT event_type AS category, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, event_type NULLS LAST) AS k
               FROM {NULLS} GROUP BY event_type), t AS (SELECT sum(n)::BIGINT AS total FROM c)
    SELECT CASE WHEN k <= 3 THEN category ELSE 'Other' END AS category, sum(n)::BIGINT AS count,
        {r('sum(n)::DOUBLE / any_value(total)', 6)} AS share
    FROM c, t GROUP BY CASE WHEN k <= 3 THEN k ELSE 4 END, CASE WHEN k <= 3 THEN category ELSE 'Other' END"""
ORACLE["chart_rows_finite"] = "SELECT event_id, CASE WHEN event_id % 5 > 1 THEN value END AS value FROM events"
ORACLE["plot_chart"] = (
    "SELECT c_mktsegment, count(*) AS count FROM customer GROUP BY c_mktsegment ORDER BY count DESC, c_mktsegment LIMIT 20"
)
ORACLE["query_dataset"] = """SELECT l_returnflag, l_linestatus, count(*) AS row_count, round(avg(l_quantity), 4) AS mean_quantity
    FROM lineitem WHERE l_tax >= 0.02 GROUP BY l_returnflag, l_linestatus"""
ORACLE["similar_vectors"] = f"""
    WITH q AS (SELECT arg_min(embedding, vec_id)::DOUBLE[] AS v FROM embeddings)
    SELECT vec_id, label, {r('list_cosine_similarity(embedding::DOUBLE[], v)', 6)} AS similarity FROM embeddings, q
    ORDER BY list_cosine_similarity(embedding::DOUBLE[], v) DESC, vec_id LIMIT 10"""


# --- projections --------------------------------------------------------------------------------

ORACLE["project_and_replace"] = "SELECT o_orderkey, lower(o_orderstatus) AS o_orderstatus, o_totalprice FROM orders"
ORACLE["select_column"] = "SELECT o_totalprice FROM orders"
ORACLE["drop_nulls"] = f"SELECT * FROM {NULLS} WHERE event_type IS NOT NULL"
ORACLE["scalar_functions"] = r"""
    SELECT page_id, lower(regexp_extract(name, '[^/]+\.([^./]+)$', 1)) AS file_format, page_id::DOUBLE AS as_float,
        coalesce(nullif(page_id, 3)::DOUBLE, 0.5::DOUBLE) AS filled, coalesce(nullif(page_id::DOUBLE, 4.0), 0.0::DOUBLE) AS zeroed
    FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') || CASE WHEN page_id % 2 = 0 THEN '.CSV' ELSE '/b.Tar.GZ' END AS name
          FROM pages)"""
ORACLE["features_target"] = """
    SELECT d.doc_id, n_chars::DOUBLE AS n_chars, s.slot AS lang_slot, quality::DOUBLE AS label
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id
    JOIN (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS slot FROM
          (SELECT DISTINCT lang FROM documents d2 JOIN labels l2 ON d2.doc_id = l2.doc_id)) s ON d.lang = s.lang"""


# --- cleaning -----------------------------------------------------------------------------------

ORACLE["fill_mean"] = f"""SELECT event_id, user_id, {r('coalesce(value, (SELECT avg(value) FROM ' + NULLS + '))')} AS value,
    coalesce(event_type, 'Unknown') AS event_type FROM {NULLS}"""
ORACLE["fill_median"] = f"""SELECT event_id, user_id, {r('coalesce(value, (SELECT median(value) FROM ' + NULLS + '))', 6)} AS value,
    coalesce(event_type, 'Unknown') AS event_type FROM {NULLS}"""
ORACLE["fill_whole_numbers"] = f"""
    SELECT event_id, {r('CASE WHEN event_id % 7 <> 0 THEN user_id::DOUBLE ELSE m END')} AS user_id
    FROM events, (SELECT avg(user_id) AS m FROM events WHERE event_id % 7 <> 0)"""
ORACLE["fill_constant"] = f"""SELECT event_id, user_id, coalesce(value, -1.5::DOUBLE) AS value,
    coalesce(event_type, 'none') AS event_type FROM {NULLS}"""
ORACLE["drop_missing"] = f"SELECT * FROM {NULLS} WHERE value IS NOT NULL AND event_type IS NOT NULL"


def _within(source: str, columns: list[str]) -> str:
    tests = " AND ".join(f"({c} IS NULL OR {c} BETWEEN f{i}.lower AND f{i}.upper)" for i, c in enumerate(columns))
    joins = ", ".join(f"({_fences(source, c)}) AS f{i}" for i, c in enumerate(columns))
    return f"FROM {source} AS n, {joins} WHERE {tests}"


ORACLE["remove_outliers_iqr"] = f"SELECT event_id, user_id, value, event_type {_within(NULLS, ['value', 'user_id'])}"
# The categories of the generated tables.
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
KINDS = ["click", "error", "purchase", "signup", "view"]
ORACLE["one_hot"] = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, " + ", ".join(
    f"(c_mktsegment = '{v}')::INTEGER AS c_mktsegment_{v}" for v in SEGMENTS
) + " FROM customer"
ORACLE["one_hot_with_null"] = "SELECT event_id, user_id, " + ", ".join(
    f"coalesce(event_type = '{v}', false)::INTEGER AS event_type_{v}" for v in KINDS
) + f", (event_type IS NULL)::INTEGER AS event_type_null FROM {NULLS}"
ORACLE["label_encode"] = """SELECT c_custkey, dense_rank() OVER (ORDER BY c_name) - 1 AS c_name, c_nationkey, c_acctbal,
    dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS c_mktsegment FROM customer"""
ORACLE["normalize_z"] = f"""SELECT c_custkey, c_name, {r('(c_nationkey - m1) / s1')} AS c_nationkey,
    {r('(c_acctbal - m2) / s2')} AS c_acctbal, c_mktsegment FROM customer,
    (SELECT avg(c_nationkey) AS m1, stddev_samp(c_nationkey) AS s1, avg(c_acctbal) AS m2, stddev_samp(c_acctbal) AS s2
     FROM customer)"""
FILLED = f"""(SELECT event_id, user_id, coalesce(value, (SELECT avg(value) FROM {NULLS})) AS value,
    coalesce(event_type, 'Unknown') AS event_type FROM {NULLS})"""
ORACLE["cleaning_chain"] = f"SELECT event_id, user_id, {r('value')} AS value, " + ", ".join(
    f"(event_type = '{v}')::INTEGER AS event_type_{v}" for v in ["Unknown", *KINDS]
) + f" {_within(FILLED, ['value'])}"
ORACLE["cleaning_log"] = f"""
    SELECT 0::INTEGER AS step_order, 'handle_missing' AS step_name, {r('avg(value)')} AS fill, NULL::DOUBLE AS upper,
        NULL::BIGINT AS removed_rows FROM {NULLS}
    UNION ALL SELECT 1, 'remove_outliers', NULL, {r('any_value(upper)')}, count(*) FILTER (WHERE value < lower OR value > upper)
        FROM {FILLED} AS n, ({_fences(FILLED, 'value')}) AS f
    UNION ALL SELECT 2, 'encode_categorical', NULL, NULL, NULL"""
ORACLE["snapshot_round_trip"] = ORACLE["fill_median"]


# --- sources ------------------------------------------------------------------------------------

ORACLE["infer_types_csv"] = "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer"
ORACLE["read_excel"] = ORACLE["infer_types_csv"]
ORACLE["read_tsv"] = "SELECT p_partkey, p_name, p_brand, p_type, p_size::BIGINT AS p_size, p_retailprice FROM part"
ORACLE["read_csv_text"] = "SELECT * FROM documents"
ORACLE["read_csv_ranges"] = "SELECT * FROM pages"
ORACLE["read_json_arrays"] = "SELECT * FROM documents"
ORACLE["read_json"] = """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority FROM orders"""
ORACLE["read_parquet"] = "SELECT * FROM supplier"
ORACLE["guard_files"] = "SELECT DISTINCT substr(o_orderpriority, 1, 1) AS priority, 'csv' AS file_format, true AS accepted FROM orders"
ORACLE["ingest_catalog"] = """SELECT substr(o_orderpriority, 1, 1) AS priority, 'ready' AS status, 'csv' AS file_format,
    count(*) AS row_count, 6::BIGINT AS column_count FROM orders GROUP BY 1"""
_ORDER_FILE = {
    "o_orderkey": "Int64", "o_custkey": "Int64", "o_orderstatus": "String", "o_totalprice": "Float64",
    "o_orderdate": "String", "o_orderpriority": "String",
}
ORACLE["dataset_detail"] = " UNION ALL ".join(
    f"SELECT substr(o_orderpriority, 1, 1) AS priority, '{c}' AS name, '{dtype}' AS dtype, "
    f"(count(*) - count({c}))::BIGINT AS null_count, "
    + (f"{r(f'min({c})::DOUBLE')} AS min, {r(f'max({c})::DOUBLE')} AS max" if numeric(dtype) else "NULL::DOUBLE AS min, NULL::DOUBLE AS max")
    + " FROM orders GROUP BY 1"
    for c, dtype in _ORDER_FILE.items()
)
ORACLE["watch_landing"] = "SELECT 'ready' AS status, 'csv' AS file_format, count(*) AS row_count FROM orders"
ORACLE["list_datasets"] = """SELECT o_orderkey AS id, o_orderpriority AS workspace_id, o_totalprice AS size FROM orders
    WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey"""
ORACLE["get_by_id"] = """SELECT o_orderkey AS id, o_orderpriority AS workspace_id, o_totalprice FROM orders
    WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)"""
ORACLE["primary_workspace"] = """SELECT owner_id, id, name FROM (SELECT user_id AS owner_id, event_id AS id, event_type AS name,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k = 1"""
ORACLE["session_messages"] = """SELECT conv_id AS session_id, turn AS created_at, role, text AS content FROM conversations
    ORDER BY conv_id, turn"""


# --- training -----------------------------------------------------------------------------------

ORACLE["split_counts"] = """SELECT CASE WHEN md5(concat_ws('|', '42', l_orderkey, l_linenumber)) < '33333333' THEN 'test' ELSE 'train' END AS side,
    count(*) AS row_count FROM lineitem GROUP BY 1"""
ORACLE["split_exact"] = """
    WITH n AS (SELECT l_orderkey, l_linenumber, count(*) OVER () AS total,
                   row_number() OVER (ORDER BY md5(concat_ws('|', '42', l_orderkey, l_linenumber))) AS place FROM lineitem)
    SELECT CASE WHEN place <= ceil(0.2::DOUBLE * total) THEN 'test' ELSE 'train' END AS side, count(*) AS row_count,
        CAST(sum(l_orderkey * 10 + l_linenumber) AS BIGINT) AS key_sum FROM n GROUP BY 1"""
ORACLE["macro_f1"] = f"""
    WITH p AS (SELECT o_orderstatus AS label, CASE WHEN o_custkey % 3 = 0 THEN 'F' WHEN o_custkey % 7 = 0 THEN 'X'
                   ELSE o_orderstatus END AS guess FROM orders),
    c AS (SELECT label AS class FROM p UNION SELECT guess FROM p),
    f AS (SELECT class, 2.0::DOUBLE * count(*) FILTER (WHERE label = class AND guess = class)
              / (count(*) FILTER (WHERE label = class) + count(*) FILTER (WHERE guess = class)) AS f1 FROM c, p GROUP BY class)
    SELECT (SELECT {r('avg(CASE WHEN label = guess THEN 1.0::DOUBLE ELSE 0.0 END)', 6)} FROM p) AS accuracy,
        (SELECT {r('avg(f1)', 6)} FROM f) AS f1_macro"""
ORACLE["r2"] = f"""
    WITH p AS (SELECT o_totalprice AS y, o_totalprice - (o_totalprice * 0.9::DOUBLE + o_custkey) AS e FROM orders)
    SELECT {r('1 - sum(e * e) / (var_pop(y) * count(*))', 6)} AS r2, {r('sqrt(avg(e * e))')} AS rmse, {r('avg(abs(e))')} AS mae FROM p"""
ORACLE["leaderboard_rank"] = """
    SELECT dataset_id, model_type, score, row_number() OVER (PARTITION BY dataset_id ORDER BY score DESC, k, model_type) AS rank FROM
    (SELECT o_custkey AS dataset_id, o_orderpriority AS model_type, max(o_totalprice) AS score, min(o_orderkey) AS k
     FROM orders GROUP BY 1, 2)"""
ORACLE["saved_model_agrees"] = """SELECT count(*) AS row_count, 0::BIGINT AS changed
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""

ORACLE["query_dataset_all"] = "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem"
ORACLE["read_json_mixed"] = """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority FROM orders"""
ORACLE["read_csv_reordered"] = """SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment
  FROM customer"""

# --- training on targets that follow from a feature ---------------------------------------------

_KINDS = "SELECT DISTINCT CASE WHEN l_returnflag = 'R' THEN 'returned' ELSE 'kept' END AS outcome FROM lineitem"
ORACLE["exact_leaderboard"] = f"""
    SELECT 'lineitem' AS original_name, model_type, CAST(rank AS BIGINT) AS rank, CAST(max_depth AS INT) AS max_depth,
        right_share AS accuracy, right_share AS f1_macro
    FROM (VALUES ('gbt_classifier', 1, 5), ('logistic_regression', 2, NULL), ('random_forest_classifier', 3, 5)) AS m(model_type, rank, max_depth),
        (SELECT count(*) / 2.0::DOUBLE AS right_share FROM ({_KINDS}))"""
ORACLE["exact_best"] = f"SELECT 'gbt_classifier' AS name, count(*) / 2.0::DOUBLE AS accuracy FROM ({_KINDS})"
ORACLE["exact_predictions"] = """SELECT l_orderkey, l_linenumber,
    CASE WHEN l_returnflag = 'R' THEN 'returned' ELSE 'kept' END AS predicted FROM lineitem"""
ORACLE["exact_importance"] = """
    SELECT feature, CASE WHEN feature = 'l_returnflag' THEN 1.0::DOUBLE ELSE 0.0 END AS importance
    FROM (VALUES ('l_returnflag'), ('l_linestatus'), ('l_quantity')) AS f(feature)"""
ORACLE["exact_regression"] = f"""
    SELECT name, count(*) / 2.0::DOUBLE AS r2 FROM (VALUES ('gbt_regressor'), ('random_forest_regressor')) AS m(name), ({_KINDS}) GROUP BY name"""


# --- by dataset id ------------------------------------------------------------------------------

ORACLE["clean_dataset"] = ORACLE["cleaning_chain"]
ORACLE["train_dataset"] = f"SELECT *, rank = 1 AS saved FROM ({ORACLE['exact_leaderboard']})"
ORACLE["query_by_id"] = "SELECT l_returnflag, l_linestatus, count(*) AS row_count FROM lineitem GROUP BY l_returnflag, l_linestatus"
ORACLE["chart_by_id"] = """SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY o_orderpriority
    ORDER BY count DESC, o_orderpriority NULLS LAST LIMIT 20"""
ORACLE["other_tenant_missing"] = "SELECT 'ws' AS workspace_id, count(*) AS row_count FROM customer UNION ALL SELECT 'other', NULL"
