"""Files as units, and configuration."""

from __future__ import annotations

import re
import subprocess
import tomllib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineament.operators.tables import ignored, patterns_of

GLOB = "*.{rs,py,js,ts,jsx,tsx,go}"
EXTENSIONS = ("rs", "py", "js", "ts", "jsx", "tsx", "go")
#: Sources of histories and trees at commits.
HISTORY_EXTENSIONS = ("rs", "py", "js", "ts", "go")
#: A file's path as it is: Spark has it with percent signs, and a plus that is one.
FILE_PATH = "url_decode(replace(_metadata.file_path, '+', '%2B'))"
UNITS = "unit_id long, path string, source string"


def supported(path: Column, extensions: tuple[str, ...] = EXTENSIONS) -> Column:
    """Whether a path's extension is a source's; case matters."""
    return F.regexp_extract(path, r"\.([^./]+)$", 1).isin(*extensions)


def below(path: Column, folder: str) -> Column:
    """The part of a file's url below a folder, whatever its scheme and characters."""
    root = re.sub(r"^[a-z]+:/*", "/", folder).rstrip("/")
    return F.regexp_replace(path, "^(?:[a-z]+:(?://[^/]*)?)?" + re.escape(root) + "/", "")


def literal(folder: str) -> str:
    """A path that means itself where Spark would read a glob."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", folder)


def directory(spark: SparkSession, folder: str, patterns: list[str] | None = None) -> DataFrame:
    """unit_id, path (below the folder) and source of every source file that no pattern ignores.

    The condition is on the files' own metadata, so Spark drops ignored files and
    folders from its list before it reads any. Files that are no text give a null source."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", GLOB).load(literal(folder))
    path = below(F.expr(FILE_PATH), folder)
    kept = files.where(~ignored(path, patterns or []))
    # A file that is no UTF-8 has no source.
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    return kept.select(F.xxhash64(path).alias("unit_id"), path.alias("path"), text.alias("source"))


def single_file(spark: SparkSession, file: str) -> DataFrame:
    """One file as a unit, whatever its extension and the patterns say."""
    rows = spark.read.format("binaryFile").load(literal(file))
    name = F.element_at(F.split("path", "/"), -1)
    return rows.select(F.xxhash64(name).alias("unit_id"), name.alias("path"), F.col("content").cast("string").alias("source"))


def collected(spark: SparkSession, place: str, patterns: list[str] | None = None) -> DataFrame:
    """A single file unfiltered, a folder walked and filtered; in the order of paths where a sink sorts by them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
    return single_file(spark, place) if status.isFile() else directory(spark, place, patterns)


def all_files(spark: SparkSession, folder: str, patterns: list[str] | None = None) -> DataFrame:
    """path and hash of every file that is not ignored, sources or not: what a Merkle tree is made of."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(literal(folder))
    path = below(F.expr(FILE_PATH), folder)
    return files.where(~ignored(path, [".git/", *(patterns or [])])).select(path.alias("path"), F.sha2("content", 256).alias("hash"))


def git(repository: str, *arguments: str) -> bytes:
    return subprocess.run(["git", "-C", repository, *arguments], check=True, capture_output=True).stdout


def history(spark: SparkSession, repository: str, path: str, limit: int = 20) -> DataFrame:
    """commit, ts (seconds), summary, place (0 the newest) and source of a file in the newest ``limit`` commits that hold it.

    Read by git on the driver: ``limit`` bounds the texts."""
    rows = []
    for line in git(repository, "log", "--date-order", "--format=%H%x00%ct%x00%s").decode(errors="replace").splitlines():
        commit, ts, summary = line.split("\0", 2)
        try:
            text = git(repository, "cat-file", "blob", f"{commit}:{path}").decode()
        except (subprocess.CalledProcessError, UnicodeDecodeError):
            continue
        rows.append((commit, int(ts), summary, len(rows), text))
        if len(rows) == limit:
            break
    return spark.createDataFrame(rows, "commit string, ts long, summary string, place int, source string")


def tree_at(spark: SparkSession, repository: str, commit: str, folder: str = "") -> DataFrame:
    """commit, path and source of the sources in a commit's tree, by git on the driver: one repository's worth."""
    rows = []
    for name in git(repository, "ls-tree", "-r", "-z", "--name-only", commit, *([folder] if folder else [])).decode().split("\0"):
        if name.rsplit(".", 1)[-1] in HISTORY_EXTENSIONS:
            try:
                rows.append((commit, name, git(repository, "cat-file", "blob", f"{commit}:{name}").decode()))
            except UnicodeDecodeError:
                continue
    return spark.createDataFrame(rows, "commit string, path string, source string")


# Configuration. -------------------------------------------------------------------------


def configuration(start: str, name: str = ".lineament.toml") -> dict:
    """The nearest configuration file at or above a folder, up to a repository's root; empty if none."""
    here = Path(start).resolve()
    for folder in (here, *here.parents):
        file = folder / name
        if file.is_file():
            return tomllib.loads(file.read_text())
        if (folder / ".git").exists():
            break
    return {}


def ignore_patterns(folder: str, config: dict) -> list[str]:
    """Patterns in the order in which they count: the user's, the folder's .gitignore, the configuration's."""
    given = config.get("ignore", {})
    out: list[str] = []
    if given.get("use_global_gitignore", False):
        for file in (Path.home() / ".config/git/ignore", Path.home() / ".gitignore_global"):
            out += patterns_of(file.read_text()) if file.is_file() else []
    file = Path(folder) / ".gitignore"
    if given.get("use_gitignore", True) and file.is_file():
        out += patterns_of(file.read_text())
    return out + list(given.get("patterns", []))


def cache_folder(config: dict, default: str | None = None) -> str | None:
    return config.get("cache", {}).get("dir", default)


def overrides(spark: SparkSession, config: dict) -> DataFrame:
    return spark.createDataFrame([(k, float(v)) for k, v in config.get("heuristics", {}).items()], "id string, weight double")
