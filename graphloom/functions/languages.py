"""Languages, file extensions and their detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.schemas import UnsupportedLanguage

# Extensions of each language.
EXTENSIONS = {
    "Python": ["py"],
    "Cpp": ["c", "cpp", "cc", "cxx", "h", "hpp", "hxx", "hh", "inl", "inc"],
    "Rust": ["rs"],
    "JavaScript": ["js", "jsx", "ts", "tsx"],
    "Go": ["go"],
    "Java": ["java"],
    "Ruby": ["rb"],
    "Php": ["php"],
    "Swift": ["swift"],
    "Kotlin": ["kt", "kts"],
    "Scala": ["scala"],
    "CSharp": ["cs"],
    "Lua": ["lua"],
    "R": ["r"],
    "Bash": ["sh", "bash"],
    "Perl": ["pl", "pm"],
    "Tcl": ["tcl"],
    "Dart": ["dart"],
}
# The stricter, case-sensitive extensions that detection goes by.
DETECTED = {
    "CppTreeSitter": ["cpp", "cc", "cxx", "h", "hpp"],
    "Python": ["py"],
    "Rust": ["rs"],
    "Go": ["go"],
    "Ruby": ["rb"],
    "JavaScript": ["js", "ts", "tsx", "jsx"],
}
# Names that a user may give a language, by frontend.
CLI_NAMES = {"python": "Python", "rust": "Rust", "javascript": "JavaScript", "cpp": "Cpp", "c++": "Cpp"}
SERVER_NAMES = {"cpp": "CppTreeSitter", "c++": "CppTreeSitter", "python": "Python", "go": "Go", "ruby": "Ruby", "rust": "Rust", "javascript": "JavaScript"}
CPP_DIRECTORY = ["c", "cpp", "cc", "cxx", "h", "hpp"]


def extension(path: Column) -> Column:
    """The text after the last dot of the file name; null without one or for names such as `.profile`."""
    found = F.regexp_extract(path, r"[^/\\]\.([^./\\]*)\z", 1)
    return F.when(found == "", None).otherwise(found)


def _lookup(table: dict[str, list[str]]) -> Column:
    return F.create_map(*[F.lit(x) for language, found in table.items() for ext in found for x in (ext, language)])


def language_of(path: Column, strict: bool = False) -> Column:
    """Language of a path, Unknown if there is none; strict uses the detection table and minds the case."""
    ext = extension(path)
    found = F.try_element_at(_lookup(DETECTED), ext) if strict else F.try_element_at(_lookup(EXTENSIONS), F.lower(ext))
    return F.coalesce(found, F.lit("Unknown"))


def parse_language(name: str, frontend: str = "server") -> str:
    """The language of a name that a user gave."""
    names = CLI_NAMES if frontend == "cli" else SERVER_NAMES
    if name not in names:
        raise UnsupportedLanguage(name)
    return names[name]


def language_column(name: Column, frontend: str = "server") -> Column:
    """parse_language for a column; null for unknown names."""
    names = CLI_NAMES if frontend == "cli" else SERVER_NAMES
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), name)


def extension_table(spark: SparkSession, strict: bool = False) -> DataFrame:
    """(language, extension), to be broadcast in joins."""
    return spark.createDataFrame([(k, e) for k, v in (DETECTED if strict else EXTENSIONS).items() for e in v], "language string, extension string")


def dominant_language(files: DataFrame) -> DataFrame:
    """One row (language, files): the most frequent detected language, files without a known one included; ties by name."""
    counted = files.where(extension(F.col("path")).isNotNull()).groupBy(language_of(F.col("path"), strict=True).alias("language")).agg(F.count("*").alias("files"))
    return counted.orderBy(F.desc("files"), "language").limit(1)


def chosen_languages(names: list[str]) -> list[str] | None:
    """Languages of a multi-language request; None for automatic detection; unknown names are ignored."""
    if not names or "auto" in names:
        return None
    return sorted({SERVER_NAMES[n] for n in names if n in SERVER_NAMES})
