"""Views of the test tables as the entities of the engine: chat rows, pages, vectors, sessions.

All of them are row-wise projections, so their size follows the tables.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions.text import FRIEND_NOTICE
from lorekeep.operators.personas import parsed

ROWS_PER_BLOCK = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files: of one file, or of those in a folder of that name."""
    schema = table(spark, sf_dir, name).schema
    # A stream takes a single file by a pattern only. This one matches just the table, whether it is a file or a folder.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _materialised(columns: list[Column], source: DataFrame) -> DataFrame:
    """Columns computed once per row, as if read from a file.

    Plain projections are inlined into every later use; a generator is not.
    """
    return source.select(F.explode(F.array(F.struct(*columns))).alias("r")).select("r.*")


def chat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_rows_of(table(spark, sf_dir, "events"))


def chat_rows_of(events: DataFrame) -> DataFrame:
    """Events as rows of exported chat files, all text: one file per day, times by the hour."""
    number = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    used = [F.col("event_id"), F.col("ts"), F.col("user_id"), F.col("event_type"), number.alias("k")]
    e = _materialised(used, events)
    k = F.col("k")
    kind = F.col("event_type")
    kt = k.cast("string")
    plain = F.concat(kind, F.lit(" number "), kt)
    msg = (
        F.when((kind == "view") & (k < 30), F.concat(F.lit("["), kind, F.lit("] "), kt))
        .when((kind == "signup") & (k < 30), F.concat(F.lit("表情"), kt))
        .when((kind == "signup") & (k >= 90), F.lit(FRIEND_NOTICE))
        .when((kind == "click") & (k < 20), F.concat(F.lit("　"), kt, F.lit("\t")))
        .when((kind == "error") & (k < 40), F.concat(F.lit("<msg>"), kt, F.lit("</msg>")))
        .when((kind == "error") & (k >= 95), F.lit(" 　"))
        .otherwise(F.concat(F.lit("  "), plain, F.lit("\n")))
    )
    columns = [
        F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit(".csv")).alias("source"),
        F.col("event_id").alias("position"),
        F.floor(F.col("event_id") / ROWS_PER_BLOCK).alias("block"),
        F.col("event_id").cast("string").alias("id"),
        F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("MsgSvrID"),
        F.when((k >= 40) & (k < 45), F.lit("动画表情"))
        .when((k >= 45) & (k < 50), F.lit(""))
        .when((k >= 50) & (k < 55), F.lit(None).cast("string"))
        .otherwise(F.lit("text"))
        .alias("type_name"),
        F.when(kind == "purchase", F.lit("1"))
        .when(kind == "click", F.lit(" 0 "))
        .when(kind == "error", F.lit("x"))
        .when(kind == "view", F.lit("1.0"))
        .alias("is_sender"),
        F.when(k == 99, F.lit("\t")).otherwise(
            F.concat(F.lit(" u"), F.col("user_id").cast("string"))
        ).alias("talker"),
        msg.alias("msg"),
        F.when(k < 90, F.date_format("ts", "yyyy-MM-dd HH:00:00"))
        .when(k < 95, F.lit(""))
        .otherwise(F.lit("not a time"))
        .alias("CreateTime"),
        F.when(k < 60, F.lit("export")).alias("src"),
        F.when(k >= 70, F.concat(F.lit("room"), kt)).otherwise(F.lit("")).alias("room_name"),
        F.when(k < 10, F.lit("1")).when(k < 20, F.lit("yes")).alias("is_forward"),
    ]
    return _materialised(columns, e)


def memory_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as stored chat records; the record with vector n is event n."""
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
    # A generated column is computed once per row; filters on the id still reach the scan.
    e = table(spark, sf_dir, "events").withColumn("chat_time", F.explode(F.array(seconds)))
    msg = F.concat(F.col("event_type"), F.lit(" "), F.col("props"))
    return e.select(
        F.col("event_id").alias("id"),
        F.col("event_id").alias("seq"),
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(": "), msg).alias("content"),
        F.col("event_type").alias("collection"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("talker"),
        "chat_time",
        F.when(F.col("event_type") == "view", F.lit(""))
        .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .alias("chat_time_str"),
        F.when(F.col("event_type") == "purchase", F.lit(1)).otherwise(F.lit(0)).alias("is_sender"),
        msg.alias("msg_content"),
        "ts",
    )


def seconds_of_ts(low: int, high: int) -> Column:
    """A range of seconds as a condition on the stored time of `memory_records`, which the scan can use."""
    first, last = (F.lit(datetime(1970, 1, 1) + timedelta(seconds=s)).cast("timestamp_ntz") for s in (low, high + 1))
    return (F.col("ts") >= first) & (F.col("ts") < last)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), "embedding", F.col("label").alias("label")
    )


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The query of the search examples: the first vector of the table."""
    return vectors(spark, sf_dir).orderBy("id").select("embedding").head().embedding


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of queries: every vector of label 0."""
    return vectors(spark, sf_dir).where("label = 0").select(F.col("id").alias("query_id"), "embedding")


def book_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw textbook pages: one file per source, headings by language, repeated page lines."""
    d = table(spark, sf_dir, "documents")
    page = F.col("doc_id") + 1
    no = page.cast("string")
    lang = F.col("lang")
    heading = (
        F.when(lang == "en", F.concat(F.lit("Chapter "), no, F.lit(" of "), F.col("source")))
        .when(lang == "fr", F.concat(F.lit("第"), no, F.lit("节 part "), F.col("source")))
        .when(lang == "de", F.concat(F.lit("1."), no, F.lit(" part "), F.col("source")))
        .otherwise(F.concat(F.lit("chapter "), no))
    )
    body = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    text = F.concat(
        F.lit("NOTES\nPage "), no, F.lit("\n\n\n  "), heading, F.lit(" \n\n"), body,
        F.lit("\n\n\n\n\nCopyright © "), F.col("source"), F.lit("\n"),
    )
    return d.select(
        F.concat(F.col("source"), F.lit(".pdf")).alias("source"),
        page.alias("page"),
        text.alias("text"),
        (F.col("n_chars") < 50).alias("ocr"),
    )


def session_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_messages_of(table(spark, sf_dir, "conversations"))


def session_messages_of(conversations: DataFrame) -> DataFrame:
    return conversations.select(
        F.col("conv_id").cast("string").alias("session_id"),
        F.col("turn").alias("seq"),
        "role",
        F.col("text").alias("content"),
    )


def personas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as personas, with the format header row among them."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey").cast("string")
    has_params = F.col("c_acctbal") > 0
    rag = F.struct(
        F.when(F.col("c_nationkey") > 10, F.col("c_nationkey")).alias("k"),
        (F.col("c_nationkey") > 5).alias("include_nearby"),
        F.lit(None).cast("int").alias("time_window_minutes"),
        F.when(F.col("c_nationkey") < 20, F.lit(4)).alias("nearby_per_result"),
        F.lit(None).cast("int").alias("max_total_results"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit(0.8)).alias("lambda_mult"),
    )
    model = F.struct((F.col("c_nationkey") + 100).alias("max_tokens"))
    return c.select(
        F.col("c_custkey").alias("seq"),
        F.when(F.col("c_custkey") == 0, F.lit("schema")).alias("_type"),
        F.concat(F.lit("p"), key).alias("id"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("persona_"), F.lower("c_mktsegment")).alias("collection"),
        F.when(has_params, rag).alias("rag_params"),
        F.when(F.col("c_nationkey") > 12, model).alias("model_params"),
    )


def persona_changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Personas with open parameters, a change of them for each order, and the ids that are deleted.

    A change names the priority always, the price of dear orders, and a limit where the order is urgent.
    Customers of the segment MACHINERY are deleted.
    """
    c = table(spark, sf_dir, "customer")
    pid = lambda key: F.concat(F.lit("p"), F.col(key).cast("string"))
    own = F.to_json(F.struct((F.col("c_nationkey") + 100).alias("max_tokens"), F.col("c_mktsegment").alias("tone")))
    created = c.select(
        F.col("c_custkey").alias("seq"), pid("c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.when(F.col("c_acctbal") > 0, parsed(own)).alias("params"),
    )
    urgent, dear = F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") > 200_000
    change = F.to_json(F.struct(
        F.col("o_orderpriority").alias("priority"),
        F.when(dear, F.col("o_totalprice")).alias("price"),
        F.when(urgent, F.col("o_orderkey") % 1000).alias("max_tokens"),
    ))
    changes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), pid("o_custkey").alias("id"), parsed(change).alias("params"))
    return created, changes, c.where(F.col("c_mktsegment") == "MACHINERY").select(pid("c_custkey").alias("id"))


def model_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw model answers: text with labels in the shapes models write them."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")
    both = d.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    lang = F.col("lang")
    digit = F.right(F.col("n_chars").cast("string"), F.lit(1))
    word = F.when(F.col("n_chars") > 500, F.lit("相关")).otherwise(F.lit("不相关"))
    judged = (
        F.when(lang == "en", F.concat(F.lit("[IsRel] "), digit, F.lit(" "), word, F.lit("\n[IsRel]1 相关\n[IsRel] 1 不相关\n")))
        .when(lang == "fr", F.concat(digit, F.lit(". "), word, F.lit("\n 2: 不相关\n77) 相关\n")))
        .when(lang == "de", F.concat(F.lit("段落"), digit, F.lit("："), word, F.lit("\n段落 88: 相关\n")))
        .otherwise(F.lit("No labels.\n"))
    )
    sup = (
        F.when(F.col("quality") == 1, F.lit("\n[IsSup] 完全支持"))
        .when(F.col("quality") == 0, F.lit("\n[IsSup]无支持"))
        .otherwise(F.lit(""))
    )
    use = (
        F.when(lang == "en", F.lit("\n[IsUse] 5 points"))
        .when(lang == "fr", F.lit("\n[IsUse] 1-5"))
        .when(lang == "de", F.lit("\n[IsUse] 9"))
        .otherwise(F.lit(""))
    )
    routing = (
        F.when(lang == "en", F.lit("[Retrieve] 否，是"))
        .when(lang == "fr", F.lit("[Retrieve]是"))
        .when(lang == "de", F.lit("不是"))
        .when(F.col("quality") == 1, F.lit("无"))
    )
    return both.select(
        "doc_id",
        routing.alias("routing"),
        F.concat(judged, F.col("text"), sup, use, F.lit("\nnote [Retrieve] x\n<s>end</s> [a\nb] <paragraph>p\nq</paragraph>")).alias("output"),
    )


def timed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times written in the formats found in exports."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    text = (
        F.when(kind == "click", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"))
        .when(kind == "view", F.date_format("ts", "yyyyMMdd'T'HHmmss"))
        .when(kind == "purchase", F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("+0800")))
        .when(kind == "signup", F.date_format("ts", "yyyy-M-d H:m:s"))
        .when(F.col("value") < 10, F.date_format("ts", "yyyy-MM-dd"))
        .otherwise(F.date_format("ts", "yyyy/MM/dd HH:mm"))
    )
    return e.select("event_id", text.alias("create_time"))
