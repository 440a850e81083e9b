"""File sources and sinks: directories of texts, golden sets, run results, transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = (".md", ".txt", ".rst")
GOLDEN = (
    "name string, description string, chunker struct<max_tokens:int,overlap_tokens:int,respect_headings:boolean>, "
    "documents array<struct<doc_id:string,text:string>>, "
    "queries array<struct<id:string,query:string,relevant_chunk_ids:array<string>,note:string>>"
)
METRICS = ("clean.utility_results", "injected.utility_results", "injected.security_results")


class SourceError(ValueError):
    """An input that does not have the shape it must have."""


def load_directory(spark: SparkSession, root: str, suffixes: tuple[str, ...] = SUFFIXES, prefix: str = "file://corpus/") -> DataFrame:
    """Every text file under ``root``: text, source_uri, doc_id, metadata; sorted by path.

    Bytes that are not UTF-8 become replacement characters.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/") + "/"
    tail = F.regexp_replace("path", "^[a-z]+:/*", "/")
    rel = F.substring(tail, F.length(F.lit("/" + base.split(":", 1)[-1].lstrip("/"))) + 1, 1 << 20)
    keep = F.lit(False)
    for s in suffixes:
        keep = keep | F.lower("path").endswith(s.lower())
    rows = files.where(keep).select(F.make_valid_utf8(F.col("content").cast("string")).alias("text"), rel.alias("doc_id"))
    return rows.select("text", F.concat(F.lit(prefix), "doc_id").alias("source_uri"), "doc_id", F.create_map(F.lit("path"), "doc_id").alias("metadata")).orderBy("doc_id")


def _require(bad: DataFrame, message: str) -> None:
    some = [str(r[0]) for r in bad.limit(3).collect()]
    if some:
        raise SourceError(f"{message}: {', '.join(some)}")


def load_golden(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """(documents, queries, chunker settings) of a golden set, checked noisily."""
    raw = spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(GOLDEN).json(path)
    head = raw.select("chunker", F.size("documents").alias("d"), F.size("queries").alias("q")).first()
    if head is None or head["d"] < 1 or head["q"] < 1:
        raise SourceError("a golden set needs documents and queries")
    docs = raw.select(F.inline("documents"))
    queries = raw.select(F.inline("queries")).withColumnRenamed("id", "query_id")
    for df, key in ((docs, "doc_id"), (queries, "query_id")):
        _require(df.groupBy(key).count().where(f"count > 1 or {key} is null or {key} = ''").select(key), f"repeated or empty {key}")
    odd = (F.size("relevant_chunk_ids") < 1) | (F.size(F.array_distinct("relevant_chunk_ids")) < F.size("relevant_chunk_ids"))
    _require(queries.where(odd).select("query_id"), "queries without relevant chunks, or with repeated ones")
    settings = head["chunker"].asDict() if head["chunker"] else {}
    return docs, queries, {k: v for k, v in settings.items() if v is not None}


def load_run(spark: SparkSession, path: str) -> DataFrame:
    """(run, metric, key, passed) of a result file's per-couple maps."""
    results = "map<string,boolean>"
    schema = f"raw struct<clean:struct<utility_results:{results},security_results:{results}>,injected:struct<utility_results:{results},security_results:{results}>>"
    raw = spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(schema).json(path).withColumn("run", F.input_file_name())
    parts = None
    for metric in METRICS:
        one = raw.select("run", F.lit(metric).alias("metric"), F.explode(F.col(f"raw.{metric}")).alias("key", "passed"))
        parts = one if parts is None else parts.unionByName(one)
    _require(parts.where("passed is null").select("key"), "results that are not booleans")
    return parts


def load_run_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """``load_run``, or None where there is no such file or it does not read: a page shows an absent section."""
    try:
        rows = load_run(spark, path)
        rows.limit(1).collect()
        return rows
    except Exception:
        return None


def headline_check(results: DataFrame, told: dict[str, float | None], tolerance: float = 1e-9) -> None:
    """Raises where a metric's mean is not what the file's headline says."""
    for r in results.groupBy("metric").agg(F.avg(F.col("passed").cast("double")).alias("rate")).collect():
        said = told.get(r["metric"])
        if said is not None and abs(said - r["rate"]) > tolerance:
            raise SourceError(f"{r['metric']} is {r['rate']}, the headline says {said}")


def tool_outputs(spark: SparkSession, path: str) -> DataFrame:
    """Distinct tool outputs of transcripts: messages of the role ``tool``, text blocks joined."""
    schema = "messages array<struct<role:string,content:array<struct<type:string,content:string,text:string>>>>"
    raw = spark.read.option("multiLine", True).option("recursiveFileLookup", True).schema(schema).json(path)
    tools = raw.select(F.explode("messages").alias("m")).where("m.role = 'tool'")
    blocks = F.transform(F.filter("m.content", lambda b: b["type"] == "text"), lambda b: F.coalesce(b["content"], b["text"]))
    return tools.select(F.array_join(blocks, "\n").alias("text")).where("text <> ''").distinct()


def write_report(rows: DataFrame, path: str) -> None:
    """A result table as JSON lines in one folder."""
    rows.write.mode("overwrite").json(path)
