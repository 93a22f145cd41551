"""Project folders: a pointer file, model folders of declarations, report folders of JSON files.

Files are listed, a folder a row, and read whole, a file a row, by tasks with Arrow's file systems, as they are written; the driver holds no list of them. Only
folders that Arrow cannot open are listed by Spark's reader, whose driver holds every file's name. Which folders belong to a project follows from its pointer file, the folders
beside it and what its reports refer to. Objects whose parts lie in several files are joined by their place in the folder.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.lineage import Rounds
from weftgraph.sources.folders import TOP

#: Endings of folders, folded, and keys and types of a pointer file by what they name. Fixed values.
MODEL_ENDS, REPORT_ENDS = ["semanticmodel", "dataset"], ["report"]
MODEL_KEYS, MODEL_TYPES = ["semanticModel", "semantic_model", "model"], ["model", "semanticmodel", "semantic_model", "dataset"]
SCRIPTS = "tmdlscripts"
_NAMED = "struct<path:string>"
POINTER = f"artifacts array<struct<type:string,path:string,report:{_NAMED},{','.join(f'{k}:{_NAMED}' for k in MODEL_KEYS)}>>"
REFERENCE = f"datasetReference struct<byPath:{_NAMED}>"


#: Characters of text that a task hands over at once, about, and rows.
_BATCH, _BATCH_ROWS = 1 << 22, 4096


def _store(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of ``root`` and the path there."""
    local = re.fullmatch(r"(?:file:(?://)?)?(/.*)", root)
    return (fs.LocalFileSystem(), local[1].rstrip("/")) if local else fs.FileSystem.from_uri(root.rstrip("/"))


def write_files(rows: DataFrame, root: str) -> None:
    """Writes each row of (file, text) as a file under ``root``, from the tasks; a task run again writes the same."""

    def write(some: Iterable[Row]) -> None:
        files, at = _store(root)
        for row in some:
            files.create_dir(f"{at}/{row['file']}".rpartition("/")[0], recursive=True)
            with files.open_output_stream(f"{at}/{row['file']}") as out:
                out.write(row["text"].encode())

    rows.select("file", "text").foreachPartition(write)


def clean_path(path: Column) -> Column:
    """A path without empty, ``.`` and ``..`` parts; one that leads above its start is null."""
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(False).alias("out"))

    def step(s: Column, part: Column) -> Column:
        up = part == ".."
        parts = F.when(up, F.slice(s["parts"], 1, F.greatest(F.size(s["parts"]) - 1, F.lit(0)))).when(part.isin("", "."), s["parts"]).otherwise(F.array_append(s["parts"], part))
        return F.struct(parts.alias("parts"), (s["out"] | (up & (F.size(s["parts"]) == 0))).alias("out"))

    return F.aggregate(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), start, step, lambda s: F.when(~s["out"], F.array_join(s["parts"], "/")))


def _glob(pattern: str) -> str:
    """A pattern of file names, with ``*``, ``?`` and ``{a,b}``, as a regular expression."""
    told = {"*": ".*", "?": ".", "{": "(?:", ",": "|", "}": ")"}
    return "".join(told[c] if c in "*?" or (c in "{,}" and "{" in pattern) else re.escape(c) for c in pattern)


def _listed(spark: SparkSession, root: str) -> DataFrame:
    """(path, folder) of all under ``root``, hidden names aside: a round for each level, in which a row is one folder that a task lists."""

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, at = _store(root)
        some: list[tuple[str, bool]] = []
        for path in (p for batch in batches for p in batch["path"]):
            inside = files.get_file_info(fs.FileSelector(f"{at}/{path}".rstrip("/")))
            some += [(f"{path}/{f.base_name}".lstrip("/"), f.type == fs.FileType.Directory) for f in inside if f.base_name[0] not in "._"]
            if len(some) >= _BATCH_ROWS:
                yield pd.DataFrame(some, columns=["path", "folder"])
                some = []
        yield pd.DataFrame(some, columns=["path", "folder"])

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = Rounds(spark.createDataFrame([("", True)], "path string, folder boolean"))
    frontier = found.all()
    while found.added:
        frontier = found.add(frontier.where("folder").select("path").repartition(tasks, "path").mapInPandas(entries, "path string, folder boolean"))
    return found.all()


def _read(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(file, text) of the files under ``root`` whose names fit ``pattern``."""

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, at = _store(root)
        some, size = [], 0
        for path in (p for batch in batches for p in batch["path"]):
            with files.open_input_stream(f"{at}/{path}") as read:
                some.append((path, read.read().decode("utf-8", "replace")))
            size += len(some[-1][1])
            if size > _BATCH or len(some) == _BATCH_ROWS:
                yield pd.DataFrame(some, columns=["file", "text"])
                some, size = [], 0
        yield pd.DataFrame(some, columns=["file", "text"])

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fits = F.substring_index("path", "/", -1).rlike(f"^{_glob(pattern)}$")
    return _listed(spark, root).where(~F.col("folder") & fits).select("path").repartition(tasks, "path").mapInPandas(texts, "file string, text string")


def project_files(spark: SparkSession, root: str, pattern: str = "*.{pbip,pbir,json,tmdl}") -> DataFrame:
    """(file, folder, text) of all files under ``root``; ``folder`` is the outermost model or report folder that a file lies in."""
    try:
        _store(root)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):  # no such store, or its library is missing here
        whole = F.regexp_replace(F.col("_metadata.file_path"), r"^[A-Za-z0-9+.-]+:/*", "/")
        base = re.sub(r"^[A-Za-z0-9+.-]+:/*", "/", root.rstrip("/")) + "/"
        file = F.substring_index(F.url_decode(F.replace(whole, F.lit("+"), F.lit("%2B"))), base, -1)
        read = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern).select(file.alias("file"), F.col("value").alias("text"))
    else:
        read = _read(spark, root, pattern)
    ends = "|".join([*MODEL_ENDS, *REPORT_ENDS])
    folder = F.regexp_extract("file", rf"(?i)^((?:[^/]+/)*?[^/]*\.(?:{ends}))/", 1)
    return read.withColumn("folder", F.when(folder != "", folder))


def artifacts(files: DataFrame) -> DataFrame:
    """(project, kind, folder, model): the model and report folders of every pointer file at the top, and the model that a report refers to.

    A pointer's folders are those it names that exist; if it names no model, or no report, all that lie beside it. Models that a report refers to
    by path belong to the project as well. A reference that leads nowhere leaves ``model`` null.
    """
    there = files.where("folder IS NOT NULL").select("folder").distinct()
    kind = F.when(F.lower(F.regexp_extract("folder", r"\.([^./]+)$", 1)).isin(REPORT_ENDS), "report").otherwise("model")
    beside = there.where("folder NOT LIKE '%/%'").select("folder", kind.alias("kind"))
    pointers = files.where("folder IS NULL AND file LIKE '%.pbip' AND file NOT LIKE '%/%'").select(F.col("file").alias("project"), F.from_json("text", POINTER)["artifacts"].alias("a"))
    each = pointers.select("project", F.explode_outer("a").alias("a"))
    type_ = F.lower("a.type")
    one = lambda k, path: F.struct(F.lit(k).alias("kind"), path.alias("path"))
    told = F.array(one("report", F.col("a.report.path")), *[one("model", F.col(f"a.{k}.path")) for k in MODEL_KEYS], F.struct(F.when(type_ == "report", "report").when(type_.isin(MODEL_TYPES), "model").alias("kind"), F.col("a.path").alias("path")))
    named = each.select("project", F.explode(told).alias("t")).select("project", "t.kind", clean_path(F.col("t.path")).alias("folder")).where("kind IS NOT NULL AND folder IS NOT NULL").join(there, "folder", "left_semi").distinct()
    lacking = pointers.select("project", F.explode(F.array(F.lit("model"), F.lit("report"))).alias("kind")).join(named.select("project", "kind").distinct(), ["project", "kind"], "left_anti")
    own = named.select("project", "kind", "folder").union(lacking.join(beside, "kind").select("project", "kind", "folder"))
    reference = files.where("lower(file) = lower(concat(folder, '/definition.pbir'))").select("folder", F.from_json("text", REFERENCE)["datasetReference"]["byPath"]["path"].alias("path"))
    led = reference.select("folder", clean_path(F.concat_ws("/", "folder", "path")).alias("model")).join(there.withColumnRenamed("folder", "model"), "model", "left_semi")
    reports = own.where("kind = 'report'").join(led, "folder", "left").select("project", "kind", "folder", "model")
    further = reports.where("model IS NOT NULL").select("project", F.lit("model").alias("kind"), F.col("model").alias("folder"))
    models = own.where("kind = 'model'").union(further).distinct().select("project", "kind", "folder", F.lit(None).cast("string").alias("model"))
    return reports.unionByName(models)


def report_objects(files: DataFrame) -> DataFrame:
    """(folder, kind, id, parent, name, json, parts) of the pages and visuals of report folders; ``parts`` are the names of an object's other files.

    A page is ``definition/pages/<id>/page.json``, a visual ``.../visuals/<id>/visual.json``; other files beside them are parts of the same object. A part
    without its object is none. The name is the JSON's ``displayName``, else ``name``, else the folder's.
    """
    inside = F.regexp_extract_all(F.concat(F.substring("file", F.length("folder") + 2, 1 << 20)), F.lit(r"^definition/pages/([^/]+)/(?:visuals/([^/]+)/)?([^/]+\.json)$"), F.lit(0))
    at = files.where("folder IS NOT NULL").withColumn("inside", F.get(inside, F.lit(0))).where("inside IS NOT NULL")
    part = lambda n: F.regexp_extract("inside", r"^definition/pages/([^/]+)/(?:visuals/([^/]+)/)?([^/]+)\.json$", n)
    named = at.select("folder", part(1).alias("page"), part(2).alias("visual"), part(3).alias("part"), "text")
    kind = F.when(F.col("visual") == "", "page").otherwise("visual")
    own = named.withColumn("kind", kind).groupBy("folder", "kind", "page", "visual").agg(
        F.max(F.when(F.col("part") == F.col("kind"), F.col("text"))).alias("json"), F.array_sort(F.collect_set(F.when(F.col("part") != F.col("kind"), F.col("part")))).alias("parts")
    )
    page = F.col("kind") == "page"
    id_ = F.when(page, F.col("page")).otherwise(F.col("visual"))
    name = F.coalesce(F.get_json_object("json", "$.displayName"), F.get_json_object("json", "$.name"), id_)
    return own.where("json IS NOT NULL").select("folder", "kind", id_.alias("id"), F.when(~page, F.col("page")).alias("parent"), name.alias("name"), "json", "parts")


def repeated_declarations(files: DataFrame) -> DataFrame:
    """(folder, kind, name, files, places) of what the declaration files of one model folder declare more than once at their top, letter case aside.

    Scripts and lines that are indented or comments do not count; the name is the first by file and place.
    """
    inside = F.substring("file", F.length("folder") + 2, 1 << 20)
    texts = files.where("folder IS NOT NULL AND file LIKE '%.tmdl'").withColumn("inside", inside).where(f"inside LIKE 'definition/%' AND NOT exists(split(lower(inside), '/'), x -> x = '{SCRIPTS}')")
    lines = texts.select("folder", "inside", F.posexplode(F.split("text", r"\r?\n")).alias("line", "raw"))
    words = "|".join(sorted({*TOP, "function", "perspective", "cultureInfo", "culture"} - {"model", "database"}, key=len, reverse=True))
    declared = rf"^({words})\s+('(?:''|[^'])*'|[^\s=]+)"
    kind, token = F.regexp_extract("raw", declared, 1), F.regexp_extract("raw", declared, 2)
    name = F.when(token.startswith("'"), F.replace(F.substring(token, F.lit(2), F.length(token) - 2), F.lit("''"), F.lit("'"))).otherwise(token)
    told = lines.select("folder", "inside", "line", F.when(kind == "cultureInfo", "culture").otherwise(kind).alias("kind"), name.alias("name")).where("kind <> '' AND name <> ''")
    return told.groupBy("folder", "kind", F.lower("name").alias("folded")).agg(F.min(F.struct("inside", "line", "name"))["name"].alias("name"), F.array_sort(F.collect_set("inside")).alias("files"), F.count("*").alias("places")).where("places > 1").drop("folded")
