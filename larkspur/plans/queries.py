"""One runnable query per operator, over the whole driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import scalars as X
from larkspur.operators import charts, columns, features, metrics, profile, quantiles, similar, split, steps
from larkspur.plans import automl, datasets, tools
from larkspur.plans.cleaning import Cleaning
from larkspur.session import shared_path
from larkspur.sources import catalog as K
from larkspur.sources import excel, ingest, readers
from larkspur.sources.workbook_writer import as_workbooks
from larkspur.streaming import landing

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(value: Column | str, digits: int = 4) -> Column:
    """Rounded, with negative zero made zero."""
    return F.round(F.col(value) if isinstance(value, str) else value, digits) + F.lit(0.0)


def with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with every 7th value and every 11th type missing (the tables hold no null)."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"),
        F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("event_type"),
    )


# --- profile ------------------------------------------------------------------------------------


def flat_profile(df: DataFrame) -> DataFrame:
    return profile.profile(df).select(
        "column_name",
        "dtype",
        "row_count",
        "null_count",
        "unique_count",
        *[rounded(f"stats.{k}").alias(k) for k in ("min", "max", "mean", "std")],
    )


@query
def profile_lineitem(spark, sf_dir):
    return flat_profile(table(spark, sf_dir, "lineitem"))


@query
def profile_nulls(spark, sf_dir):
    return flat_profile(with_nulls(spark, sf_dir))


@query
def row_count(spark, sf_dir):
    return profile.row_count(table(spark, sf_dir, "lineitem"))


@query
def profile_column(spark, sf_dir):
    found = profile.profile_column(with_nulls(spark, sf_dir), "value")
    return found.select(
        "column_name", "row_count", "null_count", "unique_count", rounded("stats.mean").alias("mean"), rounded("stats.std").alias("std")
    )


@query
def profile_documents(spark, sf_dir):
    return flat_profile(table(spark, sf_dir, "documents"))


@query
def profile_by_group(spark, sf_dir):
    """The profile per source file or, here, per return flag, in the same jobs."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_partkey", "l_linestatus")
    return profile.profile(lines, by=["l_returnflag"]).select(
        "l_returnflag", "column_name", "row_count", "null_count", "unique_count", rounded("stats.mean").alias("mean")
    )


@query
def dataset_profile(spark, sf_dir):
    nested = profile.dataset_profile(table(spark, sf_dir, "orders"))
    listed = nested.select("row_count", "column_count", F.posexplode("columns").alias("position", "c"))
    return listed.select(
        "row_count", "column_count", "position", F.col("c.name").alias("name"), F.col("c.unique_count").alias("unique_count")
    )


@query
def columns_with_nulls(spark, sf_dir):
    found = profile.columns_with_nulls(with_nulls(spark, sf_dir))
    return spark.createDataFrame([(c,) for c in found], "column_name string")


@query
def column_kinds(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    rows = [(c, "numeric") for c in profile.numeric_columns(orders)]
    rows += [(c, "categorical") for c in profile.categorical_columns(orders, 50)]
    return spark.createDataFrame(rows, "column_name string, kind string")


@query
def sample_values(spark, sf_dir):
    wanted = ["o_custkey", "o_orderstatus", "o_orderpriority"]
    return profile.sample_values(table(spark, sf_dir, "orders"), wanted, 5)


@query
def value_counts(spark, sf_dir):
    return profile.value_counts(with_nulls(spark, sf_dir), "event_type")


@query
def quartiles(spark, sf_dir):
    found = quantiles.quartiles(table(spark, sf_dir, "lineitem"))
    return found.select("column_name", rounded("q1", 6).alias("q1"), rounded("q3", 6).alias("q3"))


@query
def medians(spark, sf_dir):
    found = quantiles.medians(table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_totalprice"])
    rows = spark.createDataFrame(list(found.items()), "column_name string, median double")
    return rows.select("column_name", rounded("median", 6).alias("median"))


@query
def outlier_report(spark, sf_dir):
    found = profile.outlier_report(with_nulls(spark, sf_dir))
    bounds = [rounded(k, 6).alias(k) for k in ("q1", "q3", "lower", "upper")]
    return found.select("column_name", *bounds, "outliers")


# --- charts -------------------------------------------------------------------------------------


@query
def bar_top_k(spark, sf_dir):
    return charts.bar(table(spark, sf_dir, "part"), "p_brand", 20).data


@query
def bar_with_null(spark, sf_dir):
    return charts.bar(with_nulls(spark, sf_dir), "event_type", 3).data


def _histogram(spark, sf_dir, column, bins):
    return charts.histogram(table(spark, sf_dir, "lineitem"), column, bins).data.select(
        rounded("bin", 6).alias("bin"), "count"
    )


@query
def histogram_price(spark, sf_dir):
    return _histogram(spark, sf_dir, "l_extendedprice", 30)


@query
def histogram_discount(spark, sf_dir):
    return _histogram(spark, sf_dir, "l_discount", 20)


@query
def histogram_quantity(spark, sf_dir):
    return _histogram(spark, sf_dir, "l_quantity", 30)


@query
def correlation_heatmap(spark, sf_dir):
    wanted = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey"]
    return charts.heatmap(table(spark, sf_dir, "lineitem"), wanted).data.select("x", "y", rounded("value", 6).alias("value"))


@query
def correlation_wide(spark, sf_dir):
    """All pairs of 64 components, each missing in every 7th row."""
    vectors = table(spark, sf_dir, "embeddings")
    parts = [F.when((F.col("vec_id") + i) % 7 != 0, F.col("embedding")[i].cast("double")).alias(f"c{i}") for i in range(64)]
    return profile.correlation_matrix(vectors.select(*parts)).withColumn("correlation", rounded("correlation", 6))


@query
def scatter_sample(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return charts.scatter(lines, "l_quantity", "l_extendedprice", 1000, ["l_orderkey", "l_linenumber"]).data


@query
def line_daily(spark, sf_dir):
    data = charts.line(table(spark, sf_dir, "events"), "ts", "value", "day", "mean").data
    return data.select(F.col("ts").cast("date").alias("ts"), rounded("value").alias("value"))


@query
def line_thinned(spark, sf_dir):
    data = charts.line(table(spark, sf_dir, "events"), "ts", "value", "microsecond", "max", max_points=400).data
    return data.select(F.col("ts").cast("timestamp_ntz").alias("ts"), "value")


@query
def pie_share(spark, sf_dir):
    return charts.pie(with_nulls(spark, sf_dir), "event_type", 3).data.select("category", "count", rounded("share", 6).alias("share"))


@query
def auto_charts(spark, sf_dir):
    found = charts.auto_chart_rows(table(spark, sf_dir, "orders"))
    return found.withColumn("bin", rounded("bin", 6))


@query
def chart_rows_finite(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    odd = F.when(F.col("event_id") % 5 == 0, float("nan")).when(F.col("event_id") % 5 == 1, float("inf"))
    return charts.finite_rows(events.select("event_id", odd.otherwise(F.col("value")).alias("value")))


@query
def drilldown(spark, sf_dir):
    chart = charts.drilldown(table(spark, sf_dir, "lineitem"), "l_returnflag", "R", of="l_tax", bins=10)
    return chart.data.select(rounded("bin", 6).alias("bin"), "count")


@query
def plot_chart(spark, sf_dir):
    return tools.plot_chart(table(spark, sf_dir, "customer"), "bar", column="c_mktsegment").data


@query
def query_dataset_all(spark, sf_dir):
    """Every row comes back when no limit is given."""
    return tools.query_dataset(table(spark, sf_dir, "lineitem"), "SELECT l_orderkey, l_linenumber, l_quantity FROM dataset")


def as_arrays(df, path):
    """Write rows as JSON arrays, one file for about 20,000 rows, so that no group grows with the table.

    Several arrays may come to one task, so each is written to a file of its own.
    """
    files = 1 + df.count() // 20_000
    dealt = df.groupBy(F.pmod(F.xxhash64(*df.columns), F.lit(files)).alias("file"))
    rows = dealt.agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias("value"))
    rows.repartition(files, "file").select("value").write.mode("append").option("maxRecordsPerFile", 1).text(path)


@query
def read_json_mixed(spark, sf_dir):
    """A folder with array files and line files."""
    path = shared_path(spark, "mixed")
    orders = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("string"))
    first = F.col("o_orderkey") % 2 == 0
    orders.where(~first).write.json(path)
    as_arrays(orders.where(first), path)
    return readers.read_json(spark, path).select(*orders.columns)


@query
def read_json_arrays(spark, sf_dir):
    """Arrays whose strings hold brackets, quotes and escaped line breaks, read by ranges."""
    path = shared_path(spark, "arrays") + ".json"
    as_arrays(table(spark, sf_dir, "documents"), path)
    return readers.read_any(spark, path)


@query
def read_csv_reordered(spark, sf_dir):
    """Two files with their columns in different orders."""
    path = shared_path(spark, "reordered")
    customers = table(spark, sf_dir, "customer")
    even = F.col("c_custkey") % 2 == 0
    customers.where(even).write.option("header", True).csv(path)
    turned = customers.select(*reversed(customers.columns))
    turned.where(~even).write.mode("append").option("header", True).csv(path)
    return readers.read_csv(spark, path).select(*customers.columns)


@query
def query_dataset(spark, sf_dir):
    text = """
        SELECT l_returnflag, l_linestatus, count(*) AS row_count, round(avg(l_quantity), 4) AS mean_quantity
        FROM dataset WHERE l_tax >= :least GROUP BY l_returnflag, l_linestatus
    """
    return tools.query_dataset(table(spark, sf_dir, "lineitem"), text, args={"least": 0.02})


@query
def similar_vectors(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    first = vectors.agg(F.min_by("embedding", "vec_id")).first()[0]
    found = similar.similar(vectors, first, 10, "embedding", tie="vec_id")
    return found.select("vec_id", "label", rounded("similarity", 6).alias("similarity"))


# --- projections --------------------------------------------------------------------------------


@query
def project_and_replace(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    kept = columns.replace_column(orders, "o_orderstatus", F.lower("o_orderstatus"))
    return kept.select("o_orderkey", "o_orderstatus", "o_totalprice")


@query
def select_column(spark, sf_dir):
    return columns.select_column(table(spark, sf_dir, "orders"), "o_totalprice")


@query
def drop_nulls(spark, sf_dir):
    return columns.drop_nulls(with_nulls(spark, sf_dir), "event_type")


@query
def scalar_functions(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    path = F.regexp_replace("url", r"[?#].*$", "")
    name = F.concat(path, F.when(F.col("page_id") % 2 == 0, ".CSV").otherwise("/b.Tar.GZ"))
    return pages.select(
        "page_id",
        X.file_format(name).alias("file_format"),
        X.to_float(F.col("page_id")).alias("as_float"),
        X.fill_null(F.nullif("page_id", F.lit(3)), 0.5).alias("filled"),
        X.zero_if_null(F.nullif(F.col("page_id").cast("double"), F.lit(4.0))).alias("zeroed"),
    )


@query
def features_target(spark, sf_dir):
    """Vectors of a number and of indicators, with the class index."""
    data = labelled(spark, sf_dir).select("doc_id", "n_chars", "lang", "quality")
    prepared = features.fit_features(data, "quality", "classification", ["n_chars", "lang"])
    ready = prepared.model.transform(data).select("doc_id", vector_to_array("features").alias("f"), "quality")
    flags = F.slice("f", 2, len(prepared.slots) - 1)
    return ready.select(
        "doc_id",
        F.get("f", F.lit(0)).alias("n_chars"),
        (F.array_position(flags, F.lit(1.0)) - 1).cast("long").alias("lang_slot"),
        F.col("quality").cast("double").alias("label"),
    )


# --- cleaning -----------------------------------------------------------------------------------


def _clean(df: DataFrame, step: str, **params) -> DataFrame:
    return Cleaning([{"step": step, "params": params}]).run(df)[0]


@query
def fill_mean(spark, sf_dir):
    return _clean(with_nulls(spark, sf_dir), "handle_missing").withColumn("value", rounded("value"))


@query
def fill_median(spark, sf_dir):
    found = _clean(with_nulls(spark, sf_dir), "handle_missing", strategy="median")
    return found.withColumn("value", rounded("value", 6))


@query
def fill_whole_numbers(spark, sf_dir):
    """A whole-number column becomes decimal when it is filled with its mean."""
    sparse = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_id") % 7 != 0, F.col("user_id")).alias("user_id")
    )
    return _clean(sparse, "handle_missing").withColumn("user_id", rounded("user_id"))


@query
def fill_constant(spark, sf_dir):
    return _clean(with_nulls(spark, sf_dir), "handle_missing", strategy="fill", value={"value": -1.5, "event_type": "none"})


@query
def drop_missing(spark, sf_dir):
    return _clean(with_nulls(spark, sf_dir), "handle_missing", strategy="drop")


@query
def remove_outliers_iqr(spark, sf_dir):
    return _clean(with_nulls(spark, sf_dir), "remove_outliers", columns=["value", "user_id"])


@query
def one_hot(spark, sf_dir):
    return _clean(table(spark, sf_dir, "customer"), "encode_categorical", columns=["c_mktsegment"])


@query
def one_hot_with_null(spark, sf_dir):
    return _clean(with_nulls(spark, sf_dir).drop("value"), "encode_categorical")


@query
def label_encode(spark, sf_dir):
    return _clean(table(spark, sf_dir, "customer"), "encode_categorical", method="label", columns=["c_mktsegment", "c_name"])


@query
def normalize_z(spark, sf_dir):
    found = _clean(table(spark, sf_dir, "customer"), "normalize", columns=["c_acctbal", "c_nationkey"])
    return found.withColumns({c: rounded(c) for c in ("c_acctbal", "c_nationkey")})


CHAIN = [
    {"step": "handle_missing", "params": {"strategy": "mean"}},
    {"step": "remove_outliers", "params": {"columns": ["value"]}},
    {"step": "encode_categorical", "params": {"method": "onehot"}},
]


@query
def cleaning_chain(spark, sf_dir):
    return Cleaning(CHAIN).run(with_nulls(spark, sf_dir))[0].withColumn("value", rounded("value"))


@query
def cleaning_log(spark, sf_dir):
    _, logs = Cleaning(CHAIN).run(with_nulls(spark, sf_dir))
    store = K.Catalog(spark, shared_path(spark, "log"))
    store.write_pipeline_log("events", logs)
    changes = F.col("applied_changes")
    return store.pipeline_logs("events").select(
        "step_order",
        "step_name",
        rounded(F.get_json_object(changes, "$.affected[0].fill").cast("double")).alias("fill"),
        rounded(F.get_json_object(changes, "$.affected[0].upper").cast("double"), 4).alias("upper"),
        F.get_json_object(changes, "$.affected[0].removed_rows").cast("long").alias("removed_rows"),
    )


@query
def snapshot_round_trip(spark, sf_dir):
    cleaned = _clean(with_nulls(spark, sf_dir), "handle_missing", strategy="median")
    store = K.Catalog(spark, shared_path(spark, "snapshot"))
    return spark.read.parquet(store.write_snapshot(cleaned, "events")).withColumn("value", rounded("value", 6))


# --- sources ------------------------------------------------------------------------------------


@query
def infer_types_csv(spark, sf_dir):
    path = shared_path(spark, "csv") + ".csv"
    table(spark, sf_dir, "customer").write.option("header", True).option("escape", '"').csv(path)
    return readers.read_any(spark, path)


@query
def read_tsv(spark, sf_dir):
    path = shared_path(spark, "tsv") + ".tsv"
    table(spark, sf_dir, "part").write.option("header", True).option("sep", "\t").csv(path)
    return readers.read_any(spark, path)


@query
def read_csv_text(spark, sf_dir):
    """Texts with quotes, commas and line breaks survive."""
    path = shared_path(spark, "texts") + ".csv"
    texts = table(spark, sf_dir, "documents")
    texts.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return readers.read_csv(spark, path, multi_line=True)


@query
def read_csv_ranges(spark, sf_dir):
    """Files cut into small ranges, many of which begin inside a quoted field."""
    path = shared_path(spark, "ranges") + ".csv"
    table(spark, sf_dir, "pages").write.option("header", True).option("escape", '"').csv(path)
    return readers.read_any(spark, path)


@query
def read_json(spark, sf_dir):
    path = shared_path(spark, "json") + ".json"
    orders = table(spark, sf_dir, "orders")
    orders.withColumn("o_orderdate", F.col("o_orderdate").cast("string")).write.json(path)
    return readers.read_any(spark, path)


@query
def read_parquet(spark, sf_dir):
    return readers.read_any(spark, f"{sf_dir}/supplier.parquet")


@query
def read_excel(spark, sf_dir):
    return excel.read_workbooks(as_workbooks(table(spark, sf_dir, "customer")))


def _land_orders(spark: SparkSession, sf_dir: str) -> str:
    """The orders as CSV files, one folder per priority; files stay below the upload limit."""
    path = shared_path(spark, "orders")
    orders = table(spark, sf_dir, "orders").withColumn("priority", F.substring("o_orderpriority", 1, 1))
    orders.write.partitionBy("priority").option("maxRecordsPerFile", 200_000).option("header", True).csv(path)
    return path


def _priority(path: str) -> Column:
    return F.regexp_extract(path, "priority=([^/]+)/", 1)


def _ingested(spark: SparkSession, sf_dir: str) -> tuple[K.Catalog, DataFrame]:
    """A catalogue of the order files and, by dataset id, their priority."""
    landed = _land_orders(spark, sf_dir)
    store = K.Catalog(spark, shared_path(spark, "catalog"))
    ingest.ingest(spark, landed, store, "ws")
    ids = readers.guard_files(spark, landed).select(
        X.stable_id(F.col("path"), F.unix_micros("modified"), F.col("file_size")).alias("id"),
        _priority("path").alias("priority"),
    )
    return store, ids


@query
def guard_files(spark, sf_dir):
    checked = readers.guard_files(spark, _land_orders(spark, sf_dir))
    return checked.groupBy(_priority("path").alias("priority"), "file_format").agg(
        F.bool_and(F.col("error").isNull()).alias("accepted")
    )


@query
def ingest_catalog(spark, sf_dir):
    store, ids = _ingested(spark, sf_dir)
    found = store.list_datasets("ws").join(ids, "id")
    return found.groupBy("priority", "status", "file_format").agg(
        F.sum("row_count").alias("row_count"), F.max("column_count").cast("long").alias("column_count")
    )


@query
def dataset_detail(spark, sf_dir):
    store, ids = _ingested(spark, sf_dir)
    listed = store.dataset_detail(workspace_id="ws").join(ids, "id").select("priority", F.inline("columns"))
    return listed.groupBy("priority", "name").agg(
        F.first("dtype").alias("dtype"),
        F.sum("null_count").alias("null_count"),
        rounded(F.min("stats.min")).alias("min"),
        rounded(F.max("stats.max")).alias("max"),
    )


@query
def watch_landing(spark, sf_dir):
    store = K.Catalog(spark, shared_path(spark, "catalog"))
    stream = landing.watch_landing(
        spark, _land_orders(spark, sf_dir), store, "ws", shared_path(spark, "stream"), files_per_batch=10_000
    )
    stream.awaitTermination()
    return store.list_datasets("ws").groupBy("status", "file_format").agg(F.sum("row_count").alias("row_count"))


@query
def list_datasets(spark, sf_dir):
    """Tenant filter and newest-first order, over orders as catalogue entries."""
    entries = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("workspace_id"),
        F.col("o_totalprice").alias("size"),
        F.col("o_orderdate").alias("created_at"),
    )
    return K.newest_first(K.scope(entries, "1-URGENT")).select("id", "workspace_id", "size")


@query
def get_by_id(spark, sf_dir):
    entries = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("workspace_id"), "o_totalprice"
    )
    owner = entries.agg(F.min_by("workspace_id", "id")).first()[0]
    return K.get_by_id(entries, entries.agg(F.min("id")).first()[0], owner)


@query
def primary_workspace(spark, sf_dir):
    """The first event of every user, as the oldest workspace of every owner."""
    owned = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("owner_id"), F.col("event_id").alias("id"), F.col("ts").alias("created_at"),
        F.col("event_type").alias("name"),
    )
    return K.primary_workspace(owned).select("owner_id", "id", "name")


@query
def session_messages(spark, sf_dir):
    messages = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("created_at"), "role", F.col("text").alias("content")
    )
    return K.session_messages(messages)


# --- training -----------------------------------------------------------------------------------


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(
        "doc_id",
        "lang",
        "source",
        "n_chars",
        F.regexp_count("text", F.lit(r"\s+")).alias("n_spaces"),
        F.regexp_count("text", F.lit(r"\n")).alias("n_lines"),
    )
    return documents.join(table(spark, sf_dir, "labels"), "doc_id")


TEXT_FEATURES = ["n_chars", "n_spaces", "n_lines", "lang", "source"]
LINE_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_returnflag"]


def _trained(spark: SparkSession, sf_dir: str) -> automl.AutoTrain:
    return automl.auto_train(labelled(spark, sf_dir), "quality", "classification", key=["doc_id"], features=TEXT_FEATURES)


def returned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose outcome and refund follow from a feature, so that a right model knows every one."""
    gone = F.col("l_returnflag") == "R"
    return table(spark, sf_dir, "lineitem").withColumns(
        {"outcome": F.when(gone, "returned").otherwise("kept"), "refund": F.when(gone, 100.0).otherwise(0.0)}
    )


RETURN_FEATURES = ["l_returnflag", "l_linestatus", "l_quantity"]
LINE_KEY = ["l_orderkey", "l_linenumber"]


def _exact(spark: SparkSession, sf_dir: str) -> automl.AutoTrain:
    return automl.auto_train(returned(spark, sf_dir), "outcome", key=LINE_KEY, features=RETURN_FEATURES)


@query
def exact_leaderboard(spark, sf_dir):
    """Three classifiers on a learnable target, written as experiments and ranked."""
    trained = _exact(spark, sf_dir)
    store = K.Catalog(spark, shared_path(spark, "experiments"))
    store.append("datasets", spark.createDataFrame([("lines", "lineitem")], "id string, original_name string"))
    store.write_experiments("lines", trained)
    board = store.leaderboard_for("lines")
    depth = F.get_json_object("hyperparams", "$.maxDepth").cast("int").alias("max_depth")
    scores = [rounded(F.col("metrics")[k], 6).alias(k) for k in ("accuracy", "f1_macro")]
    return board.select("original_name", "model_type", "rank", depth, *scores)


@query
def exact_best(spark, sf_dir):
    trained = _exact(spark, sf_dir)
    best = automl.best_model(trained.leaderboard, "classification")
    return best.select("name", rounded(F.col("metrics")["accuracy"], 6).alias("accuracy"))


@query
def exact_predictions(spark, sf_dir):
    """The best model, saved, loaded and applied to every line."""
    best = _exact(spark, sf_dir).best
    path = automl.save_model(best.model, shared_path(spark, "model"))
    lines = table(spark, sf_dir, "lineitem")
    return automl.score(automl.load_model(path), lines).select(*LINE_KEY, "predicted")


@query
def exact_importance(spark, sf_dir):
    """Importances of boosted trees, to two places: one feature tells everything."""
    trained = _exact(spark, sf_dir)
    trees = next(r for r in trained.results if r.name == "gbt_classifier")
    data = charts.importance_chart(spark, trees.name, trees.feature_importance).data
    return data.select("feature", rounded("importance", 2).alias("importance"))


@query
def exact_regression(spark, sf_dir):
    """Both regressors on a learnable target."""
    found = automl.auto_train(
        returned(spark, sf_dir), "refund", "regression", key=LINE_KEY, features=["l_returnflag"],
        hyperparams={"random_forest_regressor": {"featureSubsetStrategy": "all"}},
    )
    return found.leaderboard.select("name", rounded(F.col("metrics")["r2"], 6).alias("r2"))


@query
def split_counts(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    train, test = split.train_test_split(lines, 0.2, 42, ["l_orderkey", "l_linenumber"])
    sides = train.select(F.lit("train").alias("side")).unionByName(test.select(F.lit("test").alias("side")))
    return sides.groupBy("side").agg(F.count("*").alias("row_count"))


@query
def split_exact(spark, sf_dir):
    """An exact fifth of all rows; the sums tell which rows they are."""
    train, test = split.exact_split(table(spark, sf_dir, "lineitem"), 0.2, 42, ["l_orderkey", "l_linenumber"])
    sides = train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))
    return sides.groupBy("side").agg(
        F.count("*").alias("row_count"),
        F.sum(F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("key_sum"),
    )


@query
def macro_f1(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    guess = F.when(F.col("o_custkey") % 3 == 0, "F").when(F.col("o_custkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus"))
    found = metrics.classification_metrics(orders.select(F.col("o_orderstatus").alias("label"), guess.alias("prediction")))
    return found.select(rounded("accuracy", 6).alias("accuracy"), rounded("f1_macro", 6).alias("f1_macro"))


@query
def r2(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    guess = F.col("o_totalprice") * 0.9 + F.col("o_custkey")
    found = metrics.regression_metrics(orders.select(F.col("o_totalprice").alias("label"), guess.alias("prediction")))
    return found.select(rounded("r2", 6).alias("r2"), rounded("rmse").alias("rmse"), rounded("mae").alias("mae"))


@query
def leaderboard_rank(spark, sf_dir):
    """Ranking within datasets, over customers as datasets and priorities as models."""
    scores = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(
        F.max("o_totalprice").alias("score"), F.min("o_orderkey").alias("created_at")
    )
    experiments = scores.select(
        F.col("o_custkey").alias("dataset_id"),
        F.lit("regression").alias("task_type"),
        F.col("o_orderpriority").alias("model_type"),
        F.create_map(F.lit("r2"), F.col("score")).alias("metrics"),
        "created_at",
    )
    ranked = automl.leaderboard_rank(experiments)
    return ranked.select("dataset_id", "model_type", F.col("metrics")["r2"].alias("score"), "rank")


@query
def auto_train_clf(spark, sf_dir):
    return _trained(spark, sf_dir).leaderboard


@query
def auto_train_reg(spark, sf_dir):
    return automl.auto_train(
        table(spark, sf_dir, "lineitem"), "l_extendedprice", "regression",
        key=["l_orderkey", "l_linenumber"], features=LINE_FEATURES,
    ).leaderboard


@query
def leaderboard_for(spark, sf_dir):
    trained = _trained(spark, sf_dir)
    store = K.Catalog(spark, shared_path(spark, "experiments"))
    entry = spark.createDataFrame([("documents", "ws", "documents", "ready")], "id string, workspace_id string, original_name string, status string")
    store.append("datasets", entry)
    store.write_experiments("documents", trained, artifacts={trained.best.name: store.save_best("documents", trained.best)})
    return store.leaderboard_for("documents").drop("id", "created_at")


@query
def best_model(spark, sf_dir):
    return automl.best_model(_trained(spark, sf_dir).leaderboard, "classification")


@query
def score_saved_model(spark, sf_dir):
    best = _trained(spark, sf_dir).best
    path = automl.save_model(best.model, shared_path(spark, "model"))
    return automl.score(automl.load_model(path), labelled(spark, sf_dir)).select("doc_id", "prediction", "predicted")


@query
def saved_model_agrees(spark, sf_dir):
    """Rows scored, and rows on which the reloaded model differs from the one that was saved."""
    best, rows = _trained(spark, sf_dir).best, labelled(spark, sf_dir)
    again = automl.load_model(automl.save_model(best.model, shared_path(spark, "model")))
    first = automl.score(best.model, rows).select("doc_id", F.col("prediction").alias("before"))
    second = automl.score(again, rows).select("doc_id", F.col("prediction").alias("after"))
    return first.join(second, "doc_id").agg(
        F.count("*").alias("row_count"), F.count_if(F.col("before") != F.col("after")).alias("changed")
    )


@query
def auto_train_classes(spark, sf_dir):
    """Ten classes from vectors: boosted trees are trained one class against the rest."""
    vectors = table(spark, sf_dir, "embeddings").withColumn("embedding", array_to_vector("embedding"))
    return automl.auto_train(vectors, "label", key=["vec_id"], features=["embedding"]).leaderboard


@query
def feature_importance(spark, sf_dir):
    trained = _trained(spark, sf_dir)
    forest = next(r for r in trained.results if r.name == "random_forest_classifier")
    return charts.importance_chart(spark, forest.name, forest.feature_importance).data


# --- by dataset id ------------------------------------------------------------------------------


def _added(spark: SparkSession, df: DataFrame, name: str) -> tuple[K.Catalog, str]:
    """A catalogue with one dataset, and its id."""
    store = K.Catalog(spark, shared_path(spark, "catalog"))
    return store, datasets.add_dataset(store, df, "ws", name)


@query
def clean_dataset(spark, sf_dir):
    store, key = _added(spark, with_nulls(spark, sf_dir), "events")
    made = datasets.clean_dataset(store, key, "ws", CHAIN)
    return datasets.open_dataset(store, made, "ws").withColumn("value", rounded("value"))


@query
def train_dataset(spark, sf_dir):
    """Experiments of one call, ranked; the best has its model saved."""
    store, key = _added(spark, returned(spark, sf_dir), "lineitem")
    datasets.train_dataset(store, key, "ws", "outcome", key=LINE_KEY, features=RETURN_FEATURES)
    depth = F.get_json_object("hyperparams", "$.maxDepth").cast("int").alias("max_depth")
    scores = [rounded(F.col("metrics")[k], 6).alias(k) for k in ("accuracy", "f1_macro")]
    saved = F.col("artifact_path").isNotNull().alias("saved")
    return store.leaderboard_for(key).select("original_name", "model_type", "rank", depth, *scores, saved)


@query
def query_by_id(spark, sf_dir):
    store, key = _added(spark, table(spark, sf_dir, "lineitem"), "lineitem")
    text = "SELECT l_returnflag, l_linestatus, count(*) AS row_count FROM dataset GROUP BY l_returnflag, l_linestatus"
    return datasets.query_by_id(store, key, "ws", text)


@query
def chart_by_id(spark, sf_dir):
    store, key = _added(spark, table(spark, sf_dir, "orders"), "orders")
    return datasets.chart_by_id(store, key, "ws", "bar", column="o_orderpriority").data


@query
def other_tenant_missing(spark, sf_dir):
    """Rows that each of two workspaces finds under one dataset's id."""
    store, key = _added(spark, table(spark, sf_dir, "customer"), "customer")
    rows = []
    for workspace in ("ws", "other"):
        try:
            rows.append((workspace, datasets.open_dataset(store, key, workspace).count()))
        except LookupError:
            rows.append((workspace, None))
    return spark.createDataFrame(rows, "workspace_id string, row_count bigint")
