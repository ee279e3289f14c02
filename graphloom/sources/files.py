"""Source trees, archives and compilation databases as tables of files."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.languages import CPP_DIRECTORY, DETECTED, EXTENSIONS, chosen_languages, dominant_language, extension, language_of
from graphloom.functions.names import strip_comments
from graphloom.plans.ship import ship
from graphloom.schemas import COMPILE_COMMANDS, FILES, conform


def walk(spark: SparkSession, root: str, extensions: list[str] | None = None, max_depth: int | None = None) -> DataFrame:
    """(path, full_path, raw) of the files below root, path relative to it; extensions in any case, none given means all.

    The bytes are read only if a later step selects them. max_depth counts path segments. Spark's reader leaves out files
    without bytes, so these are taken from the list of files that it keeps anyway.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    plain = F.regexp_replace("path", r"\Afile:/+", "file:/").alias("path")
    listed = spark.createDataFrame([(unquote(f),) for f in found.inputFiles()], "path string").select(plain)
    empty = listed.join(found.select(plain), "path", "left_anti").select("path", F.lit(b"").alias("content"))
    files = found.select(plain, "content").union(empty)
    base = root.rstrip("/")
    relative = F.substring_index(F.col("path"), f"{base}/", -1) if "://" in base else F.regexp_replace("path", f"^.*?{_quoted(base)}/", "")
    rows = files.select(relative.alias("path"), F.col("path").alias("full_path"), F.col("content").alias("raw"))
    return chosen_paths(rows, extensions, max_depth)


def chosen_paths(rows: DataFrame, extensions: list[str] | None = None, max_depth: int | None = None) -> DataFrame:
    """Rows (path, ...) with one of the extensions, in any case, and at most max_depth path segments."""
    if extensions:
        rows = rows.where(F.lower(extension(F.col("path"))).isin([e.lower() for e in extensions]))
    return rows if max_depth is None else rows.where(F.size(F.split("path", "/")) <= max_depth)


def _quoted(text: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() and c not in "/_" else c for c in text)


def decoded(raw: Column) -> Column:
    """Text of UTF-8 bytes; null for others."""
    return F.try_validate_utf8(raw.cast("string"))


def read_sources(spark: SparkSession, root: str, languages: list[str] | None = None, strict: bool = True, strip: bool = False, max_depth: int | None = None) -> DataFrame:
    """FILES of a tree. languages: names as users give them; none or auto means the dominant language of the tree.

    Files that are not UTF-8 are left out. strict goes by the detection table, else by all known extensions.
    """
    rows = walk(spark, root, max_depth=max_depth)
    rows = rows.withColumn("language", language_of(F.col("path"), strict))
    wanted = chosen_languages(languages or [])
    if wanted is None:
        top = dominant_language(rows)
        rows = rows.join(F.broadcast(top.select("language").where("language <> 'Unknown'")), "language", "left_semi")
    else:
        rows = rows.where(F.col("language").isin(wanted))
    return as_files(rows, strip)


def as_files(rows: DataFrame, strip: bool = False) -> DataFrame:
    """FILES of rows (path, language, raw)."""
    text = decoded(F.col("raw"))
    rows = rows.withColumn("content", strip_comments(text) if strip else text).where("content IS NOT NULL")
    return conform(rows.withColumn("sha256", F.sha2("raw", 256)), FILES)


def read_cpp_directory(spark: SparkSession, root: str, max_depth: int | None = None) -> DataFrame:
    """FILES of the C and C++ sources of a tree."""
    return as_files(walk(spark, root, CPP_DIRECTORY, max_depth).withColumn("language", F.lit("Cpp")))


def command_files(rows: DataFrame, directory: str) -> DataFrame:
    """(file, arguments) of entries (file, command, arguments); relative files are below directory.

    arguments are those given, else the command split at white space.
    """
    arguments = F.coalesce("arguments", F.filter(F.split("command", r"\s+"), lambda a: a != ""))
    absolute = F.startswith("file", F.lit("/")) | F.rlike("file", F.lit(r"\A\w+://"))
    placed = F.when(absolute, F.col("file")).otherwise(F.concat(F.lit(directory.rstrip("/") + "/"), "file"))
    return rows.where("file IS NOT NULL").select(placed.alias("file"), arguments.alias("arguments"))


def compile_commands(spark: SparkSession, path: str, directory: str) -> DataFrame:
    """command_files of a compilation database; its own `directory` entries are not used."""
    return command_files(spark.read.schema(COMPILE_COMMANDS).json(path, multiLine=True), directory)


def files_of_commands(files: DataFrame, commands: DataFrame) -> DataFrame:
    """Files (full_path, ...) that a compilation database names, each once."""
    local = F.regexp_replace(F.col("full_path"), r"\Afile:/+", "/")
    return files.join(commands.select(F.regexp_replace("file", r"\Afile:/+", "/").alias("f")).distinct(), local == F.col("f"), "left_semi")


def unzip(archives: DataFrame, raw: str = "raw", path: str = "path") -> DataFrame:
    """(path, raw, error) of the entries of ZIP archives. Entries that would leave the archive's folder are refused.

    An archive that cannot be read is one row with its own path and an error.
    """
    ship(archives.sparkSession)
    names = ["path", "raw", "error"]

    def rows(name: str, data: bytes | None) -> Iterator[tuple]:
        try:
            with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
                for info in z.infolist():
                    parts = info.filename.replace("\\", "/").split("/")
                    if not info.is_dir() and ".." not in parts and parts[0] and ":" not in parts[0]:
                        yield info.filename, z.read(info), None
        except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError) as e:
            yield name, None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(*(c.to_pylist() for c in batch.columns)):
                for row in rows(name, data):
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, (pa.string(), pa.binary(), pa.string()))], names=names)

    own = F.col(path) if path in archives.columns else F.lit(None).cast("string").alias(path)
    return archives.select(own, raw).mapInArrow(run, "path string, raw binary, error string")


def without_system(facts: DataFrame, prefixes: list[str] = ("/usr/include", "/usr/lib", "/usr/local/include")) -> DataFrame:
    """Facts that are not from system headers."""
    system = F.lit(False)
    for p in prefixes:
        system = system | F.startswith(F.coalesce("source_file", F.lit("")), F.lit(p))
    return facts.where(~system)


def extensions_for(language: str, strict: bool = False) -> list[str]:
    return (DETECTED if strict else EXTENSIONS).get(language, [])
