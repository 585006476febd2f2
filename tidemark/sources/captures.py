"""Capture manifests, API pages, binaries, and result files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.library import validate

MANIFEST = (
    "schema_version int, capture_id string, captured_at timestamp, course struct<remote_id:string,code:string,title:string,availability:string>,"
    " content array<struct<remote_id:string,parent_remote_id:string,handler_kind:string,title:string,position:int,is_container:boolean>>,"
    " announcements array<struct<remote_id:string,title:string,body:string,created_at:timestamp,modified_at:timestamp>>,"
    " assessments array<struct<content_remote_id:string,title:string,kind_text:string,due_at:timestamp>>, _corrupt string"
)


def read_captures(spark: SparkSession, path: str, stream: bool = False) -> dict[str, DataFrame]:
    """One frame for each kind of row of the manifests, and ``rejects``: documents that can't be read or say too little."""
    reader = spark.readStream if stream else spark.read
    raw = reader.schema(MANIFEST).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    raw = raw if stream else raw.persist()  # Spark can't query the corrupt column alone from the files
    rules = {"unreadable": F.col("_corrupt").isNull(), "no_capture_id": F.trim("capture_id") != "", "no_course": F.trim("course.remote_id") != "", "no_time": F.col("captured_at").isNotNull()}
    good, rejects = validate(raw, rules)
    frames = {"course": good.select("capture_id", "captured_at", "course.*"), "rejects": rejects.select("capture_id", "_corrupt", "reasons")}
    for kind in ("content", "announcements", "assessments"):
        frames[kind] = good.select("capture_id", "captured_at", F.col("course.remote_id").alias("course_remote_id"), F.explode(kind).alias("x")).select("capture_id", "captured_at", "course_remote_id", "x.*")
    return frames


def explode_api_pages(pages: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """Rows of ``body`` ({"results": [...], "paging": {...}}): each column is the first of its field names that isn't blank."""
    rows = pages.select("scope", "page", F.posexplode(F.from_json(F.get_json_object("body", "$.results"), "array<map<string,string>>")).alias("position", "x"))
    first = lambda fields: F.coalesce(*(F.nullif(F.trim(F.col("x")[f]), F.lit("")) for f in fields))
    return rows.select("scope", "page", "position", *(first(fields).alias(column) for column, fields in names.items()))


def scan_binaries(spark: SparkSession, glob: str) -> DataFrame:
    """path, n_bytes, sha256, content of every file."""
    return spark.read.format("binaryFile").load(glob).select("path", F.length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("sha256"), "content")


def detect_format(content: Column) -> Column:
    """pdf, zip, image or text by the first and last bytes, never by name; markup and cut off files are ``rejected:...``."""
    head = F.hex(F.substring(content, 1, 8))
    text = F.lower(F.trim(F.decode(F.substring(content, 1, 64), "ISO-8859-1")))
    tail = F.decode(F.substring(content, F.greatest(F.length(content) - 1023, F.lit(1)), F.lit(1024)), "ISO-8859-1")
    return (
        F.when(F.length(content) == 0, "rejected:empty")
        .when(head.startswith("255044462D"), F.when(tail.contains("%%EOF"), "pdf").otherwise("rejected:truncated_pdf"))
        .when(head.startswith("504B0304"), F.when(tail.contains("PK\x05\x06"), "zip").otherwise("rejected:truncated_zip"))
        .when(head.startswith("89504E470D0A1A0A") | head.startswith("FFD8FF") | head.startswith("474946383"), "image")
        .when(text.startswith("<!doctype html") | text.startswith("<html") | text.startswith("<?xml") | text.startswith("{") | text.startswith("["), "rejected:markup")
        .otherwise("text")
    )


def import_representations(results: DataFrame, prepared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Text made elsewhere for prepared pages (representation, page, sha256): accepted once each, and rejects."""
    keys = ["representation", "page", "sha256"]
    known = results.join(prepared.select(*keys).distinct(), keys, "left_semi")
    unknown = results.join(prepared.select(*keys).distinct(), keys, "left_anti").withColumn("reason", F.lit("not_prepared"))
    once = known.groupBy(*keys).agg(F.count("*").alias("n"), F.first("text").alias("text"))
    repeated = once.where("n > 1").select(*keys, "text", F.lit("repeated").alias("reason"))
    return once.where("n = 1").select(*keys, "text"), unknown.select(*keys, "text", "reason").unionByName(repeated)


def write_results(df: DataFrame, path: str, private: tuple[str, ...] = ()) -> None:
    """JSON rows without private columns."""
    from tidemark.operators.library import redact_private

    redact_private(df, private).write.mode("overwrite").json(path)
