"""Sources and sinks: tables written in a format and read back, beside the SQL of the tables themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.plans.registry import query
from tallyforge.session import Scratch, read
from tallyforge.sources import io

_DOCS = "SELECT doc_id, md5(text) AS digest, lang, source FROM documents"


def _at(spark: SparkSession, name: str) -> str:
    return Scratch(spark, name).at


def _digest(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.md5("text").alias("digest"), "lang", "source")


@query(_DOCS)
def io_lines(spark: SparkSession, d: str) -> DataFrame:
    """All documents as JSON lines, in two appended parts."""
    docs, at = read(spark, d, "documents").select("doc_id", "text", "lang", "source"), _at(spark, "io-lines")
    io.write_lines(docs.where("source = 'call_note'"), at)
    io.write_lines(docs.where("source IS DISTINCT FROM 'call_note'"), at, append=True)
    return _digest(io.read_lines(spark, at, "doc_id long, text string, lang string, source string"))


@query(_DOCS)
def io_replaced(spark: SparkSession, d: str) -> DataFrame:
    """A file that is replaced as a whole: readers see the old or the new one."""
    docs, at = read(spark, d, "documents").select("doc_id", "text", "lang", "source"), _at(spark, "io-replaced")
    io.replace_lines(docs.where("lang = 'en'"), at)
    io.replace_lines(docs, at)
    return _digest(io.read_any(spark, at, "doc_id long, text string, lang string, source string"))


@query("SELECT DISTINCT name_id, name_part, name_text FROM known_names")
def io_any(spark: SparkSession, d: str) -> DataFrame:
    """One table as an array over several lines, told apart from JSON lines by what its lines hold."""
    names, at = read(spark, d, "known_names").select("name_id", "name_part", "name_text").distinct(), _at(spark, "io-any")
    rows = names.agg(F.to_json(F.collect_list(F.struct("*"))).alias("value"))  # a fixed table
    rows.select(F.regexp_replace("value", r"\},\{", "},\n{").alias("value")).coalesce(1).write.text(at)
    return io.read_any(spark, at, "name_id long, name_part string, name_text string")


@query("SELECT DISTINCT split_name, target_pct FROM split_targets")
def io_embedded(spark: SparkSession, d: str) -> DataFrame:
    """The array under a field of one document."""
    at = _at(spark, "io-embedded")
    read(spark, d, "split_targets").distinct().agg(F.to_json(F.struct(F.lit(1).alias("version"), F.collect_list(F.struct("split_name", "target_pct")).alias("targets"))).alias("value")).coalesce(1).write.text(at)
    return io.read_embedded(spark, at, "targets", "split_name string, target_pct int")


@query("SELECT DISTINCT mix_id, source, target_weight, max_repeats, wrapped FROM mix_targets, (SELECT unnest([true, false]) AS wrapped)")
def io_wrapped(spark: SparkSession, d: str) -> DataFrame:
    """A list, and the same list under a field of an object, are read alike."""
    rows = read(spark, d, "mix_targets").select("mix_id", "source", "target_weight", "max_repeats").distinct().agg(F.collect_list(F.struct("*")).alias("mixes"))
    out = None
    for wrapped, value in ((True, F.to_json(F.struct("mixes"))), (False, F.to_json("mixes"))):
        at = _at(spark, "io-wrapped")
        rows.select(value.alias("value")).coalesce(1).write.text(at)
        got = io.read_wrapped(spark, at, "mixes", "mix_id int, source string, target_weight double, max_repeats int").withColumn("wrapped", F.lit(wrapped))
        out = got if out is None else out.unionByName(got)
    return out


@query("SELECT name_id, name_text AS name, name_part AS part, CAST(NULL AS VARCHAR) AS note FROM (SELECT DISTINCT * FROM known_names)")
def io_csv(spark: SparkSession, d: str) -> DataFrame:
    """A CSV whose columns go by other names, one of them missing."""
    at = _at(spark, "io-csv")
    read(spark, d, "known_names").distinct().select(F.col("name_id").alias("ID"), F.col("name_text").alias("Full Name"), F.col("name_part").alias("kind")).write.option("header", True).csv(at)
    got = io.read_csv(spark, at, {"name_id": ["id", "number"], "name": ["name", "full name"], "part": ["part", "kind"], "note": ["remark"]})
    return got.withColumn("name_id", F.col("name_id").cast("long"))


@query("SELECT CASE WHEN split_name = 'train' THEN 1 WHEN split_name = 'dev' THEN 2 ELSE 3 END AS part_order, split_name AS part, task_id, difficulty FROM (SELECT DISTINCT task_id, split_name, difficulty FROM tasks) WHERE split_name IN ('train', 'dev', 'held_out')")
def io_parts(spark: SparkSession, d: str) -> DataFrame:
    """Tasks written part by part and read in the order of the parts; one part is missing."""
    tasks, at = read(spark, d, "tasks").select("task_id", "split_name", "difficulty").distinct(), _at(spark, "io-parts")
    names = ("train", "dev", "held_out")
    for name in names:
        io.write_lines(tasks.where(F.col("split_name") == name).drop("split_name"), f"{at}/{name}")
    return io.read_parts(spark, {n: f"{at}/{n}" for n in (*names, "absent")}, "task_id string, difficulty string").select("part_order", "part", "task_id", "difficulty")


@query("SELECT coalesce(source, 'none') AS source, count(*) AS rows, sum(length(text)) AS letters FROM documents GROUP BY 1")
def io_by_key(spark: SparkSession, d: str) -> DataFrame:
    """A folder for each source, read back as a partitioned table."""
    at = _at(spark, "io-by-key")
    io.write_by_key(read(spark, d, "documents").select("text", F.coalesce("source", F.lit("none")).alias("source")), at, "source")
    return spark.read.schema("text string, source string").json(at).groupBy("source").agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("letters"))


@query("SELECT count(*) AS tasks, count(DISTINCT task_id) AS distinct_tasks, max(loaded_at) IS NOT NULL AS loaded FROM tasks")
def io_report(spark: SparkSession, d: str) -> DataFrame:
    """A report of one row, written as one indented object and read as one document."""
    at = _at(spark, "io-report")
    io.write_report(read(spark, d, "tasks").agg(F.count("*").alias("tasks"), F.count_distinct("task_id").alias("distinct_tasks"), F.max("loaded_at").isNotNull().alias("loaded")), at)
    return io.read_document(spark, f"{at}/*.txt", "tasks long, distinct_tasks long, loaded boolean")


@query("SELECT name_part AS heading, string_agg(name_text, chr(10) ORDER BY name_id) AS text FROM (SELECT DISTINCT * FROM known_names WHERE length(name_text) > 0) GROUP BY name_part")
def io_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections of a markdown file by heading."""
    at, names = _at(spark, "io-sections"), read(spark, d, "known_names").where("length(name_text) > 0").distinct()
    of = names.groupBy("name_part").agg(F.array_sort(F.collect_list(F.struct("name_id", "name_text"))).alias("l"))
    part = F.concat(F.lit("## "), "name_part", F.lit("\n\n"), F.array_join(F.transform("l", lambda x: x["name_text"]), "\n"), F.lit("\n"))
    of.agg(F.array_join(F.array_sort(F.collect_list(part)), "\n").alias("value")).coalesce(1).write.text(at)
    return io.read_sections(spark, f"{at}/*.txt").select("heading", "text")


@query("SELECT split_name AS part, count(*) AS files FROM split_targets GROUP BY split_name")
def io_folder(spark: SparkSession, d: str) -> DataFrame:
    """Documents of a folder, told by their file's name."""
    at = _at(spark, "io-folder")
    for r in read(spark, d, "split_targets").distinct().collect():  # three rows, fixed
        spark.createDataFrame([(f'{{\n  "split_name": "{r.split_name}",\n  "target_pct": {r.target_pct}\n}}',)], "value string").coalesce(1).write.text(f"{at}/{r.split_name}")
    got = io.read_folder(spark, f"{at}/*/*.txt", "split_name string, target_pct int")
    return got.where("file_name LIKE 'part-%'").groupBy(F.col("split_name").alias("part")).agg(F.count_distinct("file_name").alias("files"))


@query("SELECT DISTINCT source AS name FROM documents WHERE source IS NOT NULL AND source NOT IN (SELECT source FROM mix_targets WHERE mix_id = 1 AND source IS NOT NULL)")
def io_pending(spark: SparkSession, d: str) -> DataFrame:
    """Names not yet applied: sources of documents that the first mix lacks; then they are applied and none is left."""
    files = read(spark, d, "documents").where("source IS NOT NULL").select(F.col("source").alias("name"))
    applied = read(spark, d, "mix_targets").where("mix_id = 1 AND source IS NOT NULL").select(F.col("source").alias("name"))
    at = _at(spark, "io-applied")
    ran = io.apply_pending(files, applied, lambda name: None, at)
    if not io.pending(files, applied.unionByName(spark.read.schema("name string").json(at))).isEmpty():
        raise RuntimeError("names are left after they were applied")
    return spark.createDataFrame([(n,) for n in ran], "name string")


@query(
    r"""WITH h AS (SELECT DISTINCT nullif(regexp_extract(lower(text), '@([a-z0-9.-]+\.[a-z]{2,})', 1), '') AS host FROM documents)
    SELECT host, CASE WHEN ends_with(host, '.example.org') THEN 'org' WHEN ends_with(host, '.test') THEN 'test' ELSE 'generic' END AS route FROM h WHERE host IS NOT NULL"""
)
def io_hosts(spark: SparkSession, d: str) -> DataFrame:
    """The route of a page by the host of its address."""
    host = F.nullif(F.regexp_extract(F.lower("text"), r"@([a-z0-9.-]+\.[a-z]{2,})", 1), F.lit(""))
    h = read(spark, d, "documents").select(host.alias("host")).distinct().where("host IS NOT NULL")
    return h.select("host", io.host_router(F.concat(F.lit("https://"), "host", F.lit("/jobs?page=1")), {".example.org": "org", ".test": "test"}).alias("route"))
