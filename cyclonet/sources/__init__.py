"""Text snapshots, tables and file listings as DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of a pair-force file's sixteen columns, in order.
CONTACT_COLUMNS = ("id1", "id2", "periodic_flag", "fx", "fy", "fz", "fnx", "fny", "fnz", "ftx", "fty", "ftz", "cx", "cy", "cz", "delta")


def read_table(spark: SparkSession, path: str, schema: T.StructType | str, required: list[str] = ()) -> DataFrame:
    """Typed CSV with a header; fails if a required column is missing."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text: one row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def state_keys(path: Column, pattern: str = r"([^/]+)/(?:contacts_)?cycle_(\d+)_(cold|hot)\.\w+$") -> list[Column]:
    """run, cycle, phase from a file name."""
    return [F.regexp_extract(path, pattern, 1).alias("run"), F.regexp_extract(path, pattern, 2).cast("int").alias("cycle"), F.regexp_extract(path, pattern, 3).alias("phase")]


def discover_states(files: DataFrame, contacts: str = r"\.local$", particles: str = r"\.dump$") -> DataFrame:
    """run, cycle, phase with both paths, for states that have both files; files is (path, length), empty files do not count."""
    named = files.filter("length > 0").select("path", *state_keys(F.col("path"))).filter("run <> ''")
    keys = ["run", "cycle", "phase"]
    a = named.filter(F.col("path").rlike(contacts)).withColumnRenamed("path", "contacts_path")
    b = named.filter(F.col("path").rlike(particles)).withColumnRenamed("path", "particles_path")
    return a.join(b, keys)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, place, line and the folders' partition columns: one row a line, so no file has to fit in a task.

    Spark reads a large file in splits. place orders the lines of a file: where the split begins, then the line's place
    in it. A line belongs to the split it begins in.
    """
    text = spark.read.text(path)
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    folders = [c for c in text.columns if c != "value"]
    return text.select(F.col("_metadata.file_path").alias("path"), place.alias("place"), F.col("value").alias("line"), *folders)


def _lines(files: DataFrame) -> DataFrame:
    """Lines as they are; whole texts (column text) are cut into them."""
    if "text" not in files.columns:
        return files
    return files.select(*(c for c in files.columns if c != "text"), F.posexplode(F.split("text", r"\r?\n")).alias("place", "line"))


def _entries(files: DataFrame, mark: str, keep: list[str]) -> DataFrame:
    """keep, header (array of names), row (array of words), place: the lines of each file's last frame of that mark.

    Only lines that begin an item are shuffled to find where that frame begins and ends, one row a file; the lines
    themselves meet that row by path (or keep, where there is no path), and Spark broadcasts it while it is small.
    """
    lines = _lines(files)
    file = ["path"] if "path" in lines.columns else keep
    heads = lines.filter(F.col("line").startswith("ITEM:")).withColumn("_end", F.lead("place").over(Window.partitionBy(*file).orderBy("place")))
    marked = heads.filter(F.col("line").rlike(rf"^ITEM: {mark}([ \t]|$)"))
    last = marked.groupBy(*file).agg(F.max(F.struct("place", "line", "_end")).alias("_m")).select(*file, F.col("_m.place").alias("_start"), "_m._end", F.col("_m.line").alias("_head"))
    header = F.split(F.trim(F.regexp_replace("_head", rf"^ITEM: {mark}", "")), r"\s+")
    inside = (F.col("place") > F.col("_start")) & (F.col("_end").isNull() | (F.col("place") < F.col("_end")))
    body = lines.join(last, file).filter(inside & (F.trim("line") != ""))
    return body.select(*keep, header.alias("header"), "place", F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ").alias("row"))


def parse_particles(files: DataFrame, keep: list[str], columns: tuple[str, ...] = ("x", "y", "z", "radius")) -> DataFrame:
    """keep, id and the columns, by the header of each file's last frame; a repeated id keeps its last row.

    files: lines of `read_lines`, or whole texts of `read_files`. A file without such a frame gives no rows; nor does a
    line shorter than the header. Words that are no number are null.
    """
    e = _entries(files, "ATOMS", keep)
    value = lambda c: F.get("row", (F.array_position("header", F.lit(c)) - 1).cast("int")).try_cast("double")
    out = e.filter(F.size("row") >= F.size("header")).select(*keep, "place", value("id").cast("long").alias("id"), *(value(c).alias(c) for c in columns))
    last = out.groupBy(*keep, "id").agg(F.max_by(F.struct(*columns), "place").alias("_r"))
    return last.select(*keep, "id", *(F.col(f"_r.{c}").alias(c) for c in columns))


def parse_contacts(files: DataFrame, keep: list[str], names: tuple[str, ...] = CONTACT_COLUMNS) -> DataFrame:
    """keep, the named columns and force, the norm of (fx, fy, fz); lines of another length than the names are dropped.

    files as in `parse_particles`. Nothing but the beginnings of items is shuffled.
    """
    e = _entries(files, "ENTRIES", keep).filter(F.size("row") == len(names))
    whole = ("id1", "id2", "periodic_flag")
    out = e.select(*keep, *(F.get("row", F.lit(i)).try_cast("double").cast("long" if c in whole else "double").alias(c) for i, c in enumerate(names)))
    return out.withColumn("force", F.sqrt(F.col("fx") ** 2 + F.col("fy") ** 2 + F.col("fz") ** 2))


def json_stats(spark: SparkSession, path: str) -> DataFrame:
    """case, name, value: an object of objects of numbers, flattened."""
    raw = spark.read.text(path, wholetext=True)
    outer = raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("case", "_v"))
    inner = outer.select("case", F.explode(F.from_json("_v", "map<string,string>")).alias("name", "_t"))
    return inner.select("case", "name", F.expr("try_cast(_t AS double)").alias("value"))


def write_table(df: DataFrame, path: str, partition_by: list[str] = (), mode: str = "errorifexists", form: str = "parquet") -> None:
    """Parquet, or csv with a header, in folders of the partition columns."""
    df.write.mode(mode).partitionBy(*partition_by).options(**({"header": True} if form == "csv" else {})).format(form).save(path)


def inventory(files: DataFrame, rules: list[tuple[str, str]], required: list[str], default: str = "other") -> DataFrame:
    """path, group (of the first name pattern that fits), tier (required or optional, by folder), bytes, mb.

    files is (path, length).
    """
    group = reduce(lambda acc, r: acc.when(F.col("path").rlike(r[0]), r[1]), rules[1:], F.when(F.col("path").rlike(rules[0][0]), rules[0][1])).otherwise(default)
    tier = F.when(reduce(lambda a, b: a | b, [F.col("path").contains(r) for r in required], F.lit(False)), "required").otherwise("optional")
    return files.select("path", group.alias("group"), tier.alias("tier"), F.col("length").alias("bytes"), (F.col("length") / 1e6).alias("mb"))


def tier_stats(files: DataFrame) -> DataFrame:
    return files.groupBy("tier", "group").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def checksums(contents: DataFrame, expected: DataFrame) -> DataFrame:
    """path, sha256 and status (present or missing) for each expected path; contents is (path, content)."""
    have = contents.select("path", F.sha2("content", 256).alias("sha256"))
    return expected.select("path").join(have, "path", "left").withColumn("status", F.when(F.col("sha256").isNull(), "missing").otherwise("present"))


def package_plan(files: DataFrame, package: Column) -> DataFrame:
    """files, bytes and distinct groups of each package."""
    return files.withColumn("package", package).groupBy("package").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.countDistinct("group").alias("groups"))


def presence(expected: DataFrame, files: DataFrame) -> DataFrame:
    """path, present, non_empty for each expected artifact."""
    out = expected.select("path").join(files.select("path", "length"), "path", "left")
    return out.select("path", F.col("length").isNotNull().alias("present"), (F.coalesce("length", F.lit(0)) > 0).alias("non_empty"))


def audit_claims(claims: DataFrame, values: DataFrame) -> DataFrame:
    """Each claim (claim_id, selector, claimed, tolerance) against values (selector, value): pass, mismatch or error.

    A selector has to hit exactly one row.
    """
    hits = values.groupBy("selector").agg(F.count("*").alias("_n"), F.max("value").alias("source_value"))
    out = claims.join(hits, "selector", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    error = F.abs(F.col("claimed") - F.col("source_value"))
    status = F.when(F.col("_n") != 1, "error").when(error <= F.col("tolerance"), "pass").otherwise("mismatch")
    reason = F.when(F.col("_n") == 0, "no row").when(F.col("_n") > 1, "several rows").when(error > F.col("tolerance"), "beyond tolerance")
    return out.select("claim_id", "claimed", F.when(F.col("_n") == 1, F.col("source_value")).alias("source_value"), status.alias("status"), reason.alias("reason"))
