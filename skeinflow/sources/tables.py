"""Reading and writing the library's tables, texts, images and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinflow.functions.text import data_uri, trimmed

SCHEMAS = {
    "contacts": "id long, canonical_name string, aliases array<string>, company string, title string, phone string, wechat_id string, tags array<string>, notes string, created_at string, updated_at string",
    "screenshots": "id long, image_path string, user_note string, raw_extraction string, uploaded_at string",
    "action_cards": "id long, screenshot_id long, type string, payload string, confidence string, source_quote string, disambiguation string, status string, resolved_contact_id long, created_at string, resolved_at string",
    "observations": "id long, contact_id long, screenshot_id long, kind string, content string, source_quote string, observed_at string",
    "meetings": "id long, kind string, title string, time_iso string, time_text string, location string, participants array<struct<contact_id:long,name:string>>, agenda string, source_screenshot_id long, status string, created_at string",
    "insights": "id long, contact_id long, kind string, content string, based_on array<long>, generated_at string",
}
#: Columns that older snapshots lack, with what they mean there.
ADDED = {"meetings": {"kind": "meeting"}}
VERSION = 1

TRACE = "id string, screenshot_id long, started_at string, finished_at string, stages array<struct<name:string,status:string,ms:long>>, error string"
TRACES_KEPT = 50


def read_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The six tables of a snapshot, brought up to the present version; one from a newer version fails."""
    version = spark.read.json(f"{path}/version.json").first()["version"]
    if version > VERSION:
        raise ValueError(f"snapshot version {version} is newer than {VERSION}")
    return {name: migrated(name, spark.read.parquet(f"{path}/{name}")) for name in SCHEMAS}


def migrated(name: str, df: DataFrame) -> DataFrame:
    for column, default in ADDED.get(name, {}).items():
        if column not in df.columns:
            df = df.withColumn(column, F.lit(default))
    return df.select(*[c.split()[0] for c in _fields(SCHEMAS[name])])


def _fields(schema: str) -> list[str]:
    out, depth = [""], 0
    for c in schema:
        depth += {"<": 1, ">": -1}.get(c, 0)
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def write_snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """A new snapshot; the version file comes last, so a folder without it is unfinished."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")
    spark.range(1).select(F.lit(VERSION).alias("version")).coalesce(1).write.json(f"{path}/version.json")


def seeded(spark: SparkSession, rows: dict[str, list[dict]]) -> dict[str, DataFrame]:
    """The six tables, of literal rows by column; what a row lacks is null, a table without rows empty."""
    return {name: spark.createDataFrame([[r.get(c.split()[0]) for c in _fields(schema)] for r in rows.get(name, [])], schema) for name, schema in SCHEMAS.items()}


def without_uploads(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Tables without the screenshots (id) of failed uploads and their cards; all else stays."""
    ids = gone.select(F.col("id").alias("_gone")).distinct()
    left = {"screenshots": "id", "action_cards": "screenshot_id"}
    return {name: df.join(ids, F.col(left[name]) == F.col("_gone"), "left_anti") if name in left else df for name, df in tables.items()}


def pasted_lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, text of the non-blank lines of pasted texts, with a synthetic address of the whole."""
    lines = F.filter(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n"), lambda x: trimmed(x) != "")
    return texts.select(key, data_uri(F.col(text)).alias("uri"), F.posexplode(lines).alias("pos", "text"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 and extension of the image files in a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), kind.alias("extension")).where(F.col("extension").isin("png", "jpg", "jpeg", "webp", "heic"))


def traces(spark: SparkSession, path: str) -> DataFrame:
    """Traces in a folder of JSON files; damaged ones are left out."""
    found = spark.read.schema(TRACE).option("mode", "DROPMALFORMED").option("multiLine", "true").json(path)
    return found.where("id is not null").orderBy("screenshot_id", "finished_at", "started_at")


def kept_traces(found: DataFrame, archive: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(current, archived): of each id the latest version; the versions before it, each content once, and
    none that only repeats the current content; the newest traces stay, the rest go to the archive."""
    every = found if archive is None else found.unionByName(archive)
    content = F.xxhash64(F.to_json(F.struct(*[c for c in every.columns if c not in ("started_at", "finished_at")])))
    whole = F.struct(*every.columns)
    distinct = every.groupBy("id", content.alias("_content")).agg(F.max_by(whole, F.struct("finished_at", "started_at")).alias("_row")).select("_row.*")
    w = Window.partitionBy("id").orderBy(F.desc("finished_at"), F.desc("started_at"))
    ranked = distinct.withColumn("_v", F.row_number().over(w))
    latest = ranked.where("_v = 1").drop("_v")
    newest = latest.orderBy(F.desc_nulls_last("finished_at"), F.desc("id")).limit(TRACES_KEPT)
    return newest, distinct.join(newest.select("id", "started_at", "finished_at"), ["id", "started_at", "finished_at"], "left_anti")


def export_json(df: DataFrame, path: str, required: list[str]) -> int:
    """Writes rows as JSON, refusing those without a required value, and checks what was written."""
    bad = df.where(" or ".join(f"{c} is null" for c in required)).count()
    if bad:
        raise ValueError(f"{bad} rows lack one of {required}")
    df.write.json(path)
    written = df.sparkSession.read.schema(df.schema).json(path).count()
    if written != df.count():
        raise ValueError(f"{path} holds {written} rows")
    return written


def export_bundle(parts: dict[str, DataFrame], path: str) -> dict[str, str]:
    """Each part in its own folder; what can't be written is noted, the rest goes on."""
    notes = {}
    for name, df in parts.items():
        try:
            df.write.json(f"{path}/{name}")
            notes[name] = "ok"
        except Exception as error:
            notes[name] = f"failed: {type(error).__name__}"
    return notes
