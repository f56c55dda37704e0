"""Readers and writers of the record formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_lines(spark: SparkSession, path: str, schema: str | T.StructType, strict: bool = True) -> DataFrame:
    """JSON lines; blank lines are skipped, a malformed one fails the read or, if not strict, is dropped."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_any(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A JSON array, one object over several lines, or JSON lines, told apart by all lines: JSON lines are those whose every line that
    isn't blank is an object by itself."""
    line = F.trim("value")
    other = spark.read.text(path).where((line != "") & (F.startswith(line, F.lit("[")) | F.get_json_object(line, "$").isNull()))
    return spark.read.schema(schema).option("multiLine", not other.isEmpty()).json(path)


def read_embedded(spark: SparkSession, path: str, field: str, schema: str) -> DataFrame:
    """The array under a field of one document, as rows."""
    return spark.read.schema(f"`{field}` array<struct<{schema}>>").option("multiLine", True).json(path).select(F.explode(field).alias("r")).select("r.*")


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document; a malformed one gives a row of nulls instead of an error."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.from_json("value", schema).alias("r")).select("r.*")


def read_wrapped(spark: SparkSession, path: str, field: str, schema: str) -> DataFrame:
    """A list of records, or an object that holds the list under a field."""
    whole = spark.read.text(path, wholetext=True)
    kind = f"array<struct<{schema}>>"
    rows = F.coalesce(F.when(F.ltrim("value").startswith("["), F.from_json("value", kind)), F.from_json("value", f"`{field}` {kind}")[field])
    return whole.select(F.explode(rows).alias("r")).select("r.*")


def read_csv(spark: SparkSession, path: str, aliases: dict[str, list[str]]) -> DataFrame:
    """A CSV with a header: each column is the first of its aliases that is there, null without any; a byte-order mark is ignored."""
    raw = spark.read.option("header", True).csv(path)
    held = {c.lstrip("﻿").strip().lower(): c for c in raw.columns}
    pick = lambda names: next((F.col(f"`{held[n.lower()]}`") for n in names if n.lower() in held), F.lit(None).cast("string"))
    return raw.select(*[pick(names).alias(k) for k, names in aliases.items()])


def read_folder(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """Documents of a folder with the name of their file."""
    return spark.read.schema(schema).option("multiLine", True).json(glob).withColumn("file_name", F.col("_metadata.file_name"))


def read_parts(spark: SparkSession, paths: dict[str, str], schema: str) -> DataFrame:
    """Parts with their label and, from 1 on, their place in the order given; parts that are missing give no rows."""
    jvm = spark._jvm
    out = spark.createDataFrame([], T._parse_datatype_string(schema)).withColumns({"part": F.lit(None).cast("string"), "part_order": F.lit(None).cast("int")})
    for i, (name, path) in enumerate(paths.items(), 1):
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            out = out.unionByName(read_lines(spark, path, schema).withColumns({"part": F.lit(name), "part_order": F.lit(i)}))
    return out


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """Sections of markdown files: (file, heading, text). What stands before the first heading goes under the file's stem."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    head = F.regexp_extract("line", r"^#{1,6} +(.*?)\s*$", 1)
    numbered = lines.withColumn("head", head).withColumn("sec", F.expr("sum(CASE WHEN head != '' THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY pos)"))
    out = numbered.groupBy("file", "sec").agg(F.max("head").alias("h"), F.sort_array(F.collect_list(F.when(F.col("head") == "", F.struct("pos", "line")))).alias("l"))
    text = F.regexp_replace(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), r"^\s+|\s+$", "")
    return out.select("file", F.when(F.col("h") != "", F.col("h")).otherwise(F.regexp_replace("file", r"\.[^.]*$", "")).alias("heading"), text.alias("text")).where((F.col("text") != "") | (F.col("heading") != ""))


def write_lines(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines; Spark's committer moves finished files in at the end, so readers never see half of an overwrite."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", False).json(path)


def replace_lines(df: DataFrame, path: str) -> None:
    """JSON lines in place of what stands at path. The new folder is written beside it and moved there when it is whole, so a failed
    write leaves the old one; readers may find none for the moment between the two moves."""
    spark = df.sparkSession
    new, at = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}.new", path))
    df.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}.new")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(at, True)
    if not fs.rename(new, at):
        raise OSError(f"{path} wasn't replaced")


def write_report(df: DataFrame, path: str) -> None:
    """One JSON object in one file: a report row. More than one row, or none, is refused."""
    rows = df.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value")).limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a report has one row")
    df.sparkSession.createDataFrame(rows, "value string").coalesce(1).write.mode("overwrite").text(path)


def write_by_key(df: DataFrame, path: str, key: str) -> None:
    """A folder for each key."""
    df.write.mode("overwrite").partitionBy(key).json(path)


def read_table(spark: SparkSession, url: str, table: str, split: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A JDBC table; the driver's jar must be on the class path. split: (numeric column, low, high, tasks), by which so many tasks
    read their ranges side by side; what lies outside of the bounds goes to the first and the last."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if split:
        column, low, high, tasks = split
        reader = reader.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=tasks)
    return reader.load()


def write_table(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    df.write.format("jdbc").mode(mode).options(url=url, dbtable=table, **options).save()


def pending(files: DataFrame, applied: DataFrame) -> DataFrame:
    """Names not yet applied, in order."""
    return files.select("name").distinct().join(applied.select("name"), "name", "left_anti").orderBy("name")


def apply_pending(files: DataFrame, applied: DataFrame, run, path: str) -> list[str]:
    """Runs what is pending in order of name and notes each under path as it is done; a failure stops there and leaves the rest
    pending. The names of files are a list that the driver holds."""
    done = []
    files.sparkSession.createDataFrame([], "name string").write.mode("append").json(path)
    for r in pending(files, applied).collect():
        run(r.name)
        files.sparkSession.createDataFrame([(r.name,)], "name string").coalesce(1).write.mode("append").json(path)
        done.append(r.name)
    return done


def host_router(url: Column, routes: dict[str, str]) -> Column:
    """A label by the host of a URL."""
    host = F.lower(F.parse_url(url, F.lit("HOST")))
    out = F.when(F.lit(False), "")
    for part, name in routes.items():
        out = out.when(host.endswith(part), name)
    return out.otherwise("generic")
