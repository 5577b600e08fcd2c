"""Readers and writers.  Paths go to Spark's readers only, so any store Spark reads will do."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.checks import KEY, ValidationError, base_labels, leaking_days, require_empty
from ..operators.features import WITH_TEXT, as_array, build_event_feature_frame

PRICE_NUMBERS = ["open", "high", "low", "close", "volume"]
COLLECTIONS = {"daily_features": "daily_features", "labels": "labels", "text_embeddings": "text_embeddings"}
POOL = "endpoint string, source string, start_dt timestamp_ntz, end_dt timestamp_ntz, row_limit long, row_count long, records array<struct<datetime:string,pub_time:string,title:string,content:string,src:string,source:string>>, records_sha256 string, retrieved_at string"


def read_frame(spark: SparkSession, path: str) -> DataFrame:
    """A folder of Parquet (searched in depth), a ``.parquet``, or a ``.csv``/``.txt`` whose keys stay strings."""
    if path.endswith((".csv", ".txt")):
        inferred = spark.read.csv(path, header=True, inferSchema=True)
        fields = [T.StructField(f.name, T.StringType() if f.name in KEY else f.dataType) for f in inferred.schema]
        return spark.read.csv(path, header=True, schema=T.StructType(fields))
    try:
        return spark.read.option("recursiveFileLookup", "true").parquet(path)
    except AnalysisException as e:
        raise ValidationError(f"nothing to read at {path}") from e


def resolve(spark: SparkSession, root: str) -> dict[str, str]:
    """Paths of the three tables: three files, ``ready_to_run/``, or ``data/<collection>/``."""
    for layout in ("{root}/{name}.parquet", "{root}/ready_to_run/{name}.parquet", "{root}/data/{name}"):
        paths = {k: layout.format(root=root, name=n) for k, n in COLLECTIONS.items()}
        if all(_exists(spark, paths[k]) for k in ("daily_features", "labels")):
            return paths
    raise ValidationError(f"no daily features and labels below {root}")


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.option("recursiveFileLookup", "true").parquet(path)
    except AnalysisException:
        return False
    return True


def load_event_feature_frame(spark: SparkSession, root: str, feature_set: str = "S6") -> tuple[DataFrame, DataFrame]:
    """Features and usable labels of a release folder; embeddings are read only by sets that use them."""
    paths = resolve(spark, root)
    daily, labels = read_frame(spark, paths["daily_features"]), read_frame(spark, paths["labels"])
    require_empty(leaking_days(daily), "daily features")
    embeddings = as_array(read_frame(spark, paths["text_embeddings"])) if feature_set.upper() in WITH_TEXT else None
    usable, _ = base_labels(labels)
    return build_event_feature_frame(daily, labels, feature_set, embeddings), usable


def pool_envelopes(texts: DataFrame) -> DataFrame:
    """Landed texts (``value``, a JSON document each) as envelopes.

    ``attempt`` names the file and the text; ``unreadable`` says that the text is no envelope: then there is no endpoint or
    window, or it is no JSON at all.
    """
    kind = F.from_json("value", POOL + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    rows = texts.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("landed"), F.sha2(F.concat("_metadata.file_path", F.lit("\n"), "value"), 256).alias("attempt"), kind.alias("e"))
    broken = F.col("e._corrupt").isNotNull() | F.col("e.endpoint").isNull() | F.col("e.start_dt").isNull() | F.col("e.end_dt").isNull()
    return rows.select("file", "landed", "attempt", broken.alias("unreadable"), "e.*").drop("_corrupt")


def landed_texts(reader, path: str, lines: bool = True) -> DataFrame:
    """The JSON documents below ``path``: one in each line that is not empty, or with ``lines`` off one in each file.  ``reader`` is ``spark.read`` or ``spark.readStream``."""
    made = reader.format("text").option("wholetext", str(not lines).lower()).load(path)
    return made.where(F.trim("value") != "").select("value", "_metadata")


def read_pools(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """Landed news envelopes (JSON, gzip allowed): a row per record, its time by endpoint, ``src`` before ``source``."""
    return pool_records(pool_envelopes(landed_texts(spark.read, path, lines)))


def record_time(endpoint: Column, record: Column) -> Column:
    return F.when(endpoint == "major_news", record["pub_time"]).otherwise(record["datetime"])


def pool_records(envelopes: DataFrame) -> DataFrame:
    """A row per record; ``pool`` names the task (endpoint, source, window), ``place`` counts from 0."""
    rows = envelopes.withColumns({"pool": task_name(), "n_records": F.size(F.coalesce("records", F.array().cast(envelopes.schema["records"].dataType)))})
    rows = rows.select("*", F.posexplode("records").alias("place", "r"))
    source = F.coalesce(F.nullif("r.src", F.lit("")), F.nullif("r.source", F.lit("")), F.col("source"))
    more = [c for c in ("attempt",) if c in envelopes.columns]
    return rows.select("pool", *more, "place", "endpoint", record_time(F.col("endpoint"), F.col("r")).alias("ts"), F.col("r.title").alias("title"), F.col("r.content").alias("content"), source.alias("source"), F.col("start_dt").alias("window_start"), F.col("end_dt").alias("window_end"), "row_count", "n_records")


def task_name() -> Column:
    return F.concat_ws("|", "endpoint", "source", F.col("start_dt").cast("string"), F.col("end_dt").cast("string"))


def read_companies(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True)


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """Explicit aliases: unusable ones dropped; a confidence that is no number is that of the type."""
    from ..functions import scoring as S
    from ..functions.text import compact_alias

    rows = spark.read.csv(path, header=True).withColumn("compact", compact_alias(F.col("alias"))).where(S.usable_alias(F.col("compact")))
    return rows.withColumn("confidence", F.coalesce(F.col("confidence").try_cast("double"), S.alias_confidence(F.col("compact"), F.col("alias_type"))))


def write_table(df: DataFrame, path: str, form: str = "parquet", by: list[str] | None = None) -> None:
    """Parquet or CSV, price numbers as doubles; ``by`` partitions the folders.

    Rows of a folder are brought together first, so the number of files grows with the folders, not tasks times folders.
    """
    typed = df.withColumns({c: F.col(c).cast("double") for c in PRICE_NUMBERS if c in df.columns})
    if form not in ("parquet", "csv"):
        raise ValidationError(f"unknown format {form}")
    writer = (typed.repartition(*by) if by else typed).write.mode("overwrite")
    writer = writer.partitionBy(*by) if by else writer
    writer.parquet(path) if form == "parquet" else writer.option("header", "true").csv(path)


def write_slices(df: DataFrame, path: str) -> None:
    """Folders by event and market."""
    write_table(df, path, by=["event_id", "market"])


def write_run(run: dict[str, DataFrame], path: str) -> None:
    """Predictions, metrics and folds of a training run."""
    for name, df in run.items():
        write_table(df, f"{path}/{name}")


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """A split definition (JSON) as a membership table: ``fold_id``, ``part``, ``event_id``, ``market``, ``ticker``.

    A definition of one fold is named ``<split_type>__test``; a missing part is empty; a part without tickers has a null
    ticker, which stands for all firms of the market.
    """
    part = "struct<events:array<string>,markets:array<string>,tickers_by_market:map<string,array<string>>>"
    parts = ", ".join(f"{p} {part}" for p in ("train", "validation", "test"))
    inner = ", ".join(f"{p}: {part}" for p in ("train", "validation", "test"))
    raw = spark.read.schema(f"split_type string, name string, {parts}, folds array<struct<fold_id: string, {inner}>>").option("multiLine", "true").json(path)
    single = F.array(F.struct(F.concat(F.coalesce("name", "split_type"), F.lit("__test")).alias("fold_id"), *[F.col(p) for p in ("train", "validation", "test")]))
    folds = raw.select(F.explode(F.when(F.size(F.coalesce("folds", F.array().cast(raw.schema["folds"].dataType))) > 0, F.col("folds")).otherwise(single.cast(raw.schema["folds"].dataType))).alias("f"))
    named = F.array(*[F.struct(F.lit(p).alias("part"), F.col(f"f.{p}").alias("d")) for p in ("train", "validation", "test")])
    rows = folds.select("f.fold_id", F.explode(named).alias("p")).select("fold_id", "p.part", "p.d")
    rows = rows.select("fold_id", "part", F.explode("d.events").alias("event_id"), "d").select("fold_id", "part", "event_id", F.explode("d.markets").alias("market"), F.col("d.tickers_by_market").alias("t"))
    listed = F.when(F.col("t").isNotNull(), F.coalesce(F.try_element_at("t", F.col("market")), F.array().cast("array<string>"))).otherwise(F.array(F.lit(None).cast("string")))
    return rows.select("fold_id", "part", "event_id", "market", F.explode(listed).alias("ticker"))


def file_counts(spark: SparkSession, path: str) -> DataFrame:
    """Rows and sha256 of every Parquet file below a path."""
    deep = spark.read.option("recursiveFileLookup", "true")
    rows = deep.parquet(path).groupBy(F.input_file_name().alias("path")).agg(F.count("*").alias("rows"))
    sums = deep.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select(F.col("path"), F.sha2("content", 256).alias("sha256"))
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    return sums.select(name("path").alias("path"), "sha256").join(rows.select(name("path").alias("path"), "rows"), "path", "left")
