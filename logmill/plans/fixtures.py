"""Log-shaped tables derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import WILDCARD
from ..operators.scale import spread_if_small

#: Tables whose rows become log lines, with much text work per row.
TEXT_TABLES = ("events", "orders", "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread_if_small(df) if name in TEXT_TABLES else df


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn(
        "k", F.regexp_extract("props", r"(\d+)", 1)
    )


def _content():
    cents = F.round(F.col("value") * 100).cast("bigint")
    return F.concat(
        F.lit("user "), F.col("user_id"), F.lit(" did "), F.col("event_type"),
        F.lit(" amount="), cents, F.lit(" key "), F.col("k"),
    )


def _level():
    return F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured log with a known template per event type."""
    return _events(spark, sf_dir).select(
        (F.col("event_id") + 1).alias("LineId"),
        _level().alias("Level"),
        F.concat(F.lit("svc"), F.col("user_id") % 5).alias("Component"),
        _content().alias("Content"),
        F.concat(F.lit("E_"), F.col("event_type")).alias("EventId"),
        F.concat(
            F.lit("user <*> did "), F.col("event_type"), F.lit(" amount=<*> key <*>")
        ).alias("EventTemplate"),
    )


def event_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flawed parse of the same lines: two templates merged, one split by user."""
    kind = F.col("event_type")
    template = (
        F.when(kind.isin("click", "view"), "user <*> did <*> amount=<*> key <*>")
        .when((kind == "error") & (F.col("user_id") % 2 == 1), "user <*> did error <*> key <*>")
        .otherwise(F.concat(F.lit("user <*> did "), kind, F.lit(" amount=<*> key <*>")))
    )
    return _events(spark, sf_dir).select(
        (F.col("event_id") + 1).alias("LineId"),
        _content().alias("Content"),
        template.alias("EventTemplate"),
    )


def event_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw lines ``[time] [level] content``; every 50th one is malformed."""
    good = F.concat(
        F.lit("["), F.substring(F.col("ts").cast("string"), 1, 19), F.lit("] ["), _level(),
        F.lit("] "), _content(),
    )
    bad = F.concat(F.lit("broken line "), F.col("event_id"))
    return _events(spark, sf_dir).select(
        "event_id", F.when(F.col("event_id") % 50 == 0, bad).otherwise(good).alias("line")
    )


def seen_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        event_log(spark, sf_dir)
        .where(F.col("EventId").isin("E_signup", "E_purchase"))
        .select(F.col("EventTemplate").alias("template"))
        .distinct()
    )


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with digits, words with variables and a path."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).select(
        (F.col("o_orderkey") + 1).alias("LineId"),
        F.concat(
            F.lit("order "), F.col("o_orderkey"), F.lit(" status "), F.col("o_orderstatus"),
            F.lit(" by "), F.col("c_name"), F.lit(" at /shop/"), F.col("c_nationkey"), F.lit("/"),
            F.col("o_custkey"),
        ).alias("Content"),
        F.lit("order <*> status <*> by <*> at <*>").alias("EventTemplate"),
    )


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All non-blank lines of all documents."""
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "Content"))
        .where(F.trim("Content") != "")
    )


def doc_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document lines where every third word became a wildcard; short and long templates alike."""
    words = F.split("Content", " ")
    return doc_lines(spark, sf_dir).select(
        "doc_id",
        "pos",
        "Content",
        F.array_join(
            F.transform(words, lambda w, i: F.when(i % 3 == 2, F.lit(WILDCARD)).otherwise(w)), " "
        ).alias("EventTemplate"),
    )


def doc_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document lines whose words take the shapes that the correction rules look for."""
    shapes = [
        lambda w: w,
        lambda w: F.lit(WILDCARD),
        lambda w: F.lit("#<*>#"),
        lambda w: F.lit('"<*>"'),
        lambda w: F.concat(w, F.lit("=<*>:<*>")),
        lambda w: F.concat(F.lit("/"), w, F.lit("/x")),
        lambda w: F.when(F.length(w) % 2 == 0, "True").otherwise("null"),
        lambda w: F.concat(F.length(w).cast("string"), F.lit(".<*>,<*>")),
        lambda w: F.concat(F.lit("ab<*>"), w),
        lambda w: F.lit("#<*>"),
        lambda w: F.lit("<*>"),
    ]

    def shaped(w, i):
        word = F.when(F.lit(False), w)
        for n, shape in enumerate(shapes):
            word = word.when((i + F.length(w)) % len(shapes) == n, shape(w))
        return word

    return doc_lines(spark, sf_dir).select(
        "doc_id",
        "pos",
        F.array_join(F.transform(F.split("Content", " "), shaped), " ").alias("Content"),
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line and template of the fixtures as src, id, s."""
    log, orders = event_log(spark, sf_dir), order_log(spark, sf_dir)
    doc_id = F.concat_ws(":", "doc_id", "pos")
    parts = [
        log.select(F.lit("event"), F.col("LineId").cast("string"), "Content"),
        log.select(F.lit("event_template"), F.col("LineId").cast("string"), "EventTemplate"),
        orders.select(F.lit("order"), F.col("LineId").cast("string"), "Content"),
        doc_lines(spark, sf_dir).select(F.lit("doc"), doc_id, "Content"),
        doc_mixed(spark, sf_dir).select(F.lit("mixed"), doc_id, "Content"),
    ]
    result = parts[0].toDF("src", "id", "s")
    for part in parts[1:]:
        result = result.unionByName(part.toDF("src", "id", "s"))
    return result


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a line and a template: LineId, src, log, template."""
    log, orders = event_log(spark, sf_dir), order_log(spark, sf_dir)
    columns = ["LineId", F.col("Content").alias("log"), F.col("EventTemplate").alias("template")]
    return log.select(F.lit("event").alias("src"), *columns).unionByName(
        orders.select(F.lit("order").alias("src"), *columns)
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth and prediction per line."""
    truth = event_log(spark, sf_dir).select(
        "LineId", "Component", F.col("EventTemplate").alias("gt")
    )
    pred = event_pred(spark, sf_dir).select("LineId", F.col("EventTemplate").alias("pred"))
    return truth.join(pred, "LineId")


def doc_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document lines with the source of their document as label."""
    return (
        table(spark, sf_dir, "documents")
        .select(F.col("source").alias("label"), F.explode(F.split("text", "\n")).alias("log"))
        .where(F.trim("log") != "")
    )
