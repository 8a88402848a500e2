"""Sources: manifests, prediction tables, label tracks, split manifests, audio folders, checkpoints."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class MissingColumns(ValueError):
    """A source lacks required columns."""


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise MissingColumns(f"missing columns {missing}; found {df.columns}")
    return df


def manifest(spark: SparkSession, path: str, partition: str, root: str, extended: bool = False) -> DataFrame:
    """CSV manifest: wav, gender, age (null where unknown), fileid, abs_path; extended adds speaker_id and duration."""
    raw = require(spark.read.csv(path, header=True), ["wav", "gender", "age"])
    out = raw.select(
        "wav",
        F.trim("gender").alias("gender"),
        numeric(F.col("age")).alias("age"),
        fileid_suffix(F.col("wav")).alias("fileid"),
        F.concat_ws("/", F.lit(root), F.lit(partition), F.col("wav")).alias("abs_path"),
        *([numeric(F.col("speaker_id")).cast("long").alias("speaker_id"), numeric(F.col("duration")).alias("duration")] if extended else []),
    )
    return out


def numeric(c: Column) -> Column:
    """A number, or null for '?', blanks, NaN and anything else that isn't one."""
    value = F.trim(c.cast("string")).try_cast("double")
    return F.when(~F.isnan(value), value)


def fileid_first_dot(wav: Column) -> Column:
    """Text before the first dot."""
    return F.trim(F.substring_index(wav, ".", 1))


def fileid_suffix(wav: Column) -> Column:
    """The name without its .wav ending."""
    return F.regexp_replace(F.trim(wav), r"\.wav$", "")


def predictions(spark: SparkSession, paths: dict[str, str], value: str = "Age") -> DataFrame:
    """CSV prediction files as long rows: src, fileid, hyp."""
    out = None
    for name, path in paths.items():
        df = require(spark.read.csv(path, header=True), ["fileId", value])
        df = df.select(F.lit(name).alias("src"), F.trim("fileId").alias("fileid"), numeric(F.col(value)).alias("hyp"))
        out = df if out is None else out.unionByName(df)
    return out


def label_track(spark: SparkSession, path: str, utt: str, tier: str) -> DataFrame:
    """Tab-separated start, end, label."""
    df = spark.read.csv(path, sep="\t", schema="start double, end double, label string")
    return df.where("start is not null").select(F.lit(utt).alias("utt"), F.lit(tier).alias("tier"), "start", "end", F.trim("label").alias("label"))


def split_manifest(spark: SparkSession, path: str) -> DataFrame:
    """JSON split manifest as rows: split, uuid, speaker."""
    df = spark.read.json(path, multiLine=True, schema="train_inner_uuids array<string>, dev_inner_uuids array<string>, uuid_to_speaker map<string,string>, partition string, trainset string")
    parts = [df.select(F.lit(s).alias("split"), F.explode(c).alias("uuid"), "uuid_to_speaker") for s, c in (("train", "train_inner_uuids"), ("dev", "dev_inner_uuids"))]
    rows = parts[0].unionByName(parts[1])
    return rows.select("split", "uuid", F.try_element_at("uuid_to_speaker", F.col("uuid")).alias("speaker"))


def reference_texts(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(slug, text) pairs from the list `name` in a notebook's source: rows in order."""
    raw = spark.read.text(path, wholetext=True).withColumn("block", F.regexp_extract("value", rf"(?s){name}\s*=\s*\[(.*?)\n?\]", 1))
    pair = r"\(\s*\\?[\"']([^\"'\\]+)\\?[\"']\s*,\s*\\?[\"']([^\"\\]+?)\\?[\"']\s*\)"
    both = F.arrays_zip(F.regexp_extract_all("block", F.lit(pair), F.lit(1)).alias("slug"), F.regexp_extract_all("block", F.lit(pair), F.lit(2)).alias("text"))
    rows = raw.select(F.posexplode(both).alias("pos", "p"))
    return rows.select("pos", F.col("p")["0"].alias("slug"), F.col("p")["1"].alias("text")) if "0" in rows.schema["p"].dataType.names else rows.select("pos", "p.slug", "p.text")


def audio_files(spark: SparkSession, folder: str, pattern: str = "*.wav") -> DataFrame:
    """path, name, length and md5 of the files below a folder; of equal names the shallowest path stays."""
    from pyspark.sql import Window

    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    df = df.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.md5("content").alias("md5"))
    w = Window.partitionBy("name").orderBy(F.size(F.split("path", "/")), "path")
    return df.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Result JSON (model to metrics and a map slug to text) as rows: model, slug, text."""
    raw = spark.read.text(path, wholetext=True)
    models = F.from_json("value", "map<string,struct<transcripts:map<string,string>>>")
    rows = raw.select(F.explode(models).alias("model", "r"))
    return rows.select("model", F.explode("r.transcripts").alias("slug", "text"))


def checkpoint(paths: DataFrame) -> DataFrame:
    """The checkpoint of each run: the run folder itself, else final, else the first final*, else the highest checkpoint-N.

    paths: run, folder (name relative to the run, '' for itself), with a config file each.
    """
    from pyspark.sql import Window

    number = F.regexp_extract("folder", r"^checkpoint-(\d+)$", 1).try_cast("long")
    order = F.when(F.col("folder") == "", 0).when(F.col("folder") == "final", 1).when(F.col("folder").startswith("final"), 2).when(number.isNotNull(), 3)
    rows = paths.withColumn("o", order).where("o is not null").withColumn("n", number)
    w = Window.partitionBy("run").orderBy("o", F.desc_nulls_last("n"), "folder")
    return rows.withColumn("r", F.row_number().over(w)).where("r = 1").select("run", "folder")


def partition(registry: DataFrame, name: str) -> DataFrame:
    """The registry row of a partition; an unknown name raises when the row is read."""
    found = registry.where(F.col("partition") == name)
    n = F.count("*").alias("n")
    check = found.agg(n).select(F.assert_true(F.col("n") == 1, F.lit(f"unknown partition {name}")).alias("ok"))
    return found.crossJoin(F.broadcast(check)).drop("ok")


def fetch(spark: SparkSession, urls: list[str], ids: list[str] | DataFrame, inline: int = 200) -> DataFrame:
    """ID, wav of the wanted ids: few ids become an IN filter that Parquet evaluates, many a semi join.

    Corrupt files are skipped; what is lost shows in missing().
    """
    df = spark.read.option("ignoreCorruptFiles", True).parquet(*urls).select("ID", "wav")
    if isinstance(ids, list) and len(ids) <= inline:
        return df.where(F.col("ID").isin(ids))
    wanted = spark.createDataFrame([(i,) for i in ids], "ID string") if isinstance(ids, list) else ids.select("ID")
    return df.join(wanted.distinct(), "ID", "left_semi")


def missing(wanted: DataFrame, found: DataFrame, key: str = "ID") -> DataFrame:
    return wanted.select(key).join(found.select(key), key, "left_anti").distinct()


def verified(files: DataFrame, prefix: str) -> DataFrame:
    """Binary files (path, content) whose SHA-256 begins with `prefix`; another digest raises when its row is read."""
    digest = F.sha2("content", 256)
    wrong = F.concat(F.lit("wrong checksum of "), F.col("path"))
    return files.where(F.assert_true(digest.startswith(prefix.lower()), wrong).isNull())


def load_model(path: str):
    """A model that sinks.save_model() wrote, of the class named in its metadata."""
    from pyspark.ml.util import DefaultParamsReader

    return DefaultParamsReader.loadParamsInstance(path, _context())


def _context():
    return SparkSession.getActiveSession()


def resumed(todo: DataFrame, path: str, key: list[str]) -> DataFrame:
    """Rows of todo whose key has no finished row in the result table at `path`; all, where there is no table."""
    try:
        done = todo.sparkSession.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return todo
    if "status" in done.columns:
        done = done.where("status = 'ok'")
    return todo.join(done.select(*key).distinct(), key, "left_anti")


def with_features(rows: DataFrame, features: DataFrame, path: str = "abs_path") -> DataFrame:
    """Manifest rows joined to features (fileid, vec, ...) by the base name of their path without its .wav ending."""
    name = fileid_suffix(F.element_at(F.split(path, "/"), -1))
    return rows.withColumn("fileid", name).join(features, "fileid")


def partitions(manifest: DataFrame, features: DataFrame, unlabelled: tuple[str, ...] = ("evl",), key: str = "fileid") -> DataFrame:
    """Features of all partitions in one table: partition, fileid, the features' columns, age as a float, null on unlabelled partitions whatever stands there.

    manifest: partition, fileid, age (text or number). A labelled partition's age that is no number raises when its row is read.
    """
    known = ~F.col("partition").isin(*unlabelled) if unlabelled else F.lit(True)
    age = F.when(known, F.col("age").cast("string").try_cast("float"))
    wrong = F.concat(F.lit("no age: "), F.col(key).cast("string"))
    rows = manifest.select("partition", key, age.alias("age"), F.assert_true(~known | age.isNotNull(), wrong).alias("_ok"))
    return rows.where("_ok is null").drop("_ok").join(features, key)
