"""Trees of source files: scanning, languages, dependency manifests."""

from __future__ import annotations

import fnmatch
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import language_of

#: Manifests by ecosystem (fixed values).
MANIFESTS = {
    "python": ("requirements.txt", "setup.py", "Pipfile", "pyproject.toml"), "javascript": ("package.json", "yarn.lock", "package-lock.json"),
    "java": ("pom.xml", "build.gradle", "build.gradle.kts"), "csharp": ("*.csproj", "*.sln", "packages.config"),
    "ruby": ("Gemfile", "Gemfile.lock"), "php": ("composer.json", "composer.lock"), "go": ("go.mod", "go.sum"),
}


def glob_pattern(globs: Sequence[str]) -> str:
    """One regular expression, case ignored, that matches whole names as any of the globs does."""
    return "(?i)" + "|".join(f"(?:{fnmatch.translate(g).removesuffix(chr(92) + 'Z').removesuffix(chr(92) + 'z')}$)" for g in globs) if globs else r"(?!)"


def kept_path(relative: Column, ignored_directories: Sequence[str]) -> Column:
    """False if a directory on the way begins with a dot or fits an ignored glob."""
    folders = F.slice(F.split(relative, "/"), 1, F.size(F.split(relative, "/")) - 1)
    return ~F.exists(folders, lambda d: d.startswith(".") | F.regexp_like(d, F.lit(glob_pattern(ignored_directories))))


def extension(name: Column) -> Column:
    """The last suffix with its dot, in lower case; empty without one or for names that only begin with a dot."""
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]*)$", 1))


def scan(spark: SparkSession, root: str, ignored_directories: Sequence[str] = (), ignored_extensions: Sequence[str] = (), max_size: int = 1_000_000) -> DataFrame:
    """Text files under root: path, relative_path, name, extension, language, size, content, modified_time.

    Size and extension are tested on the file listing, before contents are read.  Files of unknown extension with a zero byte
    are binary and left out; bytes that aren't UTF-8 become replacement characters.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1].removeprefix("file:").rstrip("/") + "/"
    relative = F.element_at(F.split(F.col("path"), F.lit(base.replace("\\", "\\\\").replace(".", "\\.")), 2), -1)
    f = files.filter(F.col("length") <= max_size).withColumn("relative_path", relative).withColumn("name", F.element_at(F.split("relative_path", "/"), -1)).withColumn("extension", extension(F.col("name")))
    f = f.filter(kept_path(F.col("relative_path"), ignored_directories)).filter(~F.col("extension").isin(*[e.lower() for e in ignored_extensions]) if ignored_extensions else F.lit(True))
    f = f.withColumn("language", language_of(F.col("extension")))
    zero = F.contains(F.hex("content"), F.lit("00")) & F.regexp_like(F.hex("content"), F.lit("^(?:..)*?00"))
    f = f.filter((F.col("language") != "other") | ~zero)
    return f.select("path", "relative_path", "name", "extension", "language", F.col("length").alias("size"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"), F.col("modificationTime").alias("modified_time"))


def project_hash(files: DataFrame, *project: str) -> DataFrame:
    """One row, or one for each project: md5 of sorted "path:time" lines; a project's lines are one string."""
    line = F.concat_ws(":", "relative_path", F.unix_millis("modified_time").cast("string"))
    return files.groupBy(*project).agg(F.md5(F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("hash"))


def manifests(files: DataFrame) -> DataFrame:
    """Files that are dependency manifests, with their ecosystem."""
    kinds = F.array_compact(F.array(*[F.when(F.regexp_like("name", F.lit(glob_pattern(globs))), F.lit(k)) for k, globs in MANIFESTS.items()]))
    return files.withColumn("ecosystem", F.explode(kinds))


def dependencies(files: DataFrame) -> DataFrame:
    """relative_path, ecosystem, name, version, scope of what requirements.txt, package.json and pom.xml list."""
    return python_dependencies(files).unionByName(javascript_dependencies(files)).unionByName(java_dependencies(files))


def python_dependencies(files: DataFrame) -> DataFrame:
    lines = files.filter(F.col("name") == "requirements.txt").select("relative_path", F.explode(F.transform(F.split("content", "\n"), lambda x: F.trim(x))).alias("line"))
    lines = lines.filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    exact, least = F.split("line", "=="), F.split("line", ">=")
    name = F.when(F.size(exact) == 2, exact[0]).when(F.size(least) >= 2, least[0]).otherwise(F.col("line"))
    version = F.when(F.size(exact) == 2, F.trim(F.get(exact, 1))).when(F.size(least) >= 2, F.concat(F.lit(">="), F.trim(F.get(least, 1)))).otherwise(F.lit("latest"))
    return lines.select("relative_path", F.lit("python").alias("ecosystem"), F.trim(name).alias("name"), version.alias("version"), F.lit("prod").alias("scope"))


def javascript_dependencies(files: DataFrame) -> DataFrame:
    parsed = F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>")
    p = files.filter(F.col("name") == "package.json").select("relative_path", parsed.alias("p"))
    parts = [p.select("relative_path", F.explode(f"p.{field}").alias("name", "version")).withColumn("scope", F.lit(scope)) for field, scope in (("dependencies", "prod"), ("devDependencies", "dev"))]
    return parts[0].unionByName(parts[1]).select("relative_path", F.lit("javascript").alias("ecosystem"), "name", "version", "scope")


def java_dependencies(files: DataFrame) -> DataFrame:
    """Dependencies of pom.xml; a missing version is "unspecified"."""
    blocks = F.regexp_extract_all("content", F.lit(r"(?s)<dependency>(.*?)</dependency>"), F.lit(1))
    d = files.filter(F.col("name") == "pom.xml").select("relative_path", F.explode(blocks).alias("d"))
    tag = lambda t: F.nullif(F.trim(F.regexp_extract("d", rf"(?s)<{t}>(.*?)</{t}>", 1)), F.lit(""))
    named = d.select("relative_path", F.lit("java").alias("ecosystem"), F.concat(tag("groupId"), F.lit(":"), tag("artifactId")).alias("name"), F.coalesce(tag("version"), F.lit("unspecified")).alias("version"), F.lit("prod").alias("scope"))
    return named.filter("name is not null")
