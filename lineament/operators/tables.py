"""Operators around verdicts: hashes and caches, trees, rollups, histories, ignore rules, tools."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import astuple
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineament.functions.written import Written
from lineament.plans.catalogue import DISPLAY, FAMILIES, METRIC_RULES, SIGNALS

#: Changes with the catalogue, so that reports of an older one are never found.
EPOCH = hashlib.sha256(repr(([astuple(s) for s in SIGNALS], METRIC_RULES)).encode()).hexdigest()[:16]

# Files and folders by which tools are known.
TOOL_FILES = (("claude", "CLAUDE.md"), ("claude", "AGENTS.md"), ("cursor", ".cursorrules"), ("copilot", ".github/copilot-instructions.md"), ("gemini", "GEMINI.md"), ("windsurf", ".windsurfrules"))
TOOL_FOLDERS = (("cursor", ".cursor/rules"),)
TOOL_STARTS = (("aider", ".aider"),)


def overrides_digest(weights: dict[str, float] | None) -> str:
    """A digest of overrides, empty for none."""
    return hashlib.sha256(json.dumps(sorted(weights.items())).encode()).hexdigest() if weights else ""


def content_key(source: Column, language: Column | None = None, weights: dict[str, float] | None = None, epoch: str = EPOCH) -> Column:
    """Key of a report: the catalogue's epoch, the overrides, the language and the content."""
    known = F.lit("") if language is None else F.coalesce(language, F.lit(""))
    return F.sha2(F.concat_ws("\n", F.lit(epoch), F.lit(overrides_digest(weights)), known, F.coalesce(source, F.lit(""))), 256)


def cache_hits(units: DataFrame, cache: DataFrame) -> DataFrame:
    return units.join(cache, "hash")


def cache_misses(units: DataFrame, cache: DataFrame) -> DataFrame:
    return units.join(cache.select("hash"), "hash", "left_anti")


def first_by_hash(entries: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Insert-or-ignore on hash: of a batch the least unit_id, and none that exists. Minima are
    taken before the shuffle, so many copies of one text make no large group."""
    new = entries if existing is None else entries.join(existing.select("hash"), "hash", "left_anti")
    return new.groupBy("hash").agg(F.min("unit_id").alias("unit_id"), F.count(F.lit(1)).alias("copies"))


def prefixes(path: Column) -> Column:
    """Every directory above a path, the root as an empty string."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def merkle(files: DataFrame, key: str = "hash") -> DataFrame:
    """dir, hash and children of every directory: the hash of its children's raw hashes in order
    of their paths, from the deepest level up.

    One small job finds the depth. Each level is one aggregation of the entries of its depth, written to
    the shared folder before the next one reads it, so no level is computed twice and none is left out. A
    folder's hash is one SHA-256 over all its children in order, which can only be computed in one place: a
    task holds 32 bytes and a name for each child of its folders, and no texts."""
    entries = Written(files.select("path", F.unhex(key).alias("h"), (F.size(F.split("path", "/")) - 1).alias("depth")), "merkle-files")
    depth = entries.df.agg(F.max("depth")).first()[0]
    spark, below, done = files.sparkSession, None, []
    for d in range(-1 if depth is None else depth, -1, -1):
        here = entries.df.where(F.col("depth") == d).select("path", "h")
        here = here if below is None else here.unionByName(below.df.where("dir <> ''").select(F.col("dir").alias("path"), F.unhex("hash").alias("h")))
        parent = F.array_join(F.slice(F.split("path", "/"), 1, F.lit(d)), "/") if d else F.lit("")
        kids = here.groupBy(parent.alias("dir")).agg(F.array_sort(F.collect_list(F.struct("path", "h"))).alias("kids"))
        hashed = kids.select("dir", F.sha2(F.unhex(F.array_join(F.transform("kids", lambda k: F.hex(k["h"])), "")), 256).alias("hash"), F.size("kids").alias("children"))
        below = Written(hashed, "merkle-level")
        done.append(below.path)
    entries.drop()
    if not done:
        return files.select(F.lit("").alias("dir"), F.lit("").alias("hash"), F.lit(0).alias("children")).where("false")
    # One scan of all levels' files: a plan does not grow with the depth.
    return spark.read.schema("dir string, hash string, children int").parquet(*done)


def changed_dirs(now: DataFrame, before: DataFrame) -> DataFrame:
    """dir and change (new, changed, gone) of directories whose hash is not that of the earlier tree."""
    old = before.select("dir", F.col("hash").alias("was"))
    both = now.select("dir", "hash").join(old, "dir", "full_outer").where(~F.col("hash").eqNullSafe(F.col("was")))
    return both.select("dir", F.when(F.col("was").isNull(), "new").when(F.col("hash").isNull(), "gone").otherwise("changed").alias("change"))


def root_unchanged(now: DataFrame, before: DataFrame) -> bool:
    """Whether a whole tree is as it was: one hash from each side."""
    root = lambda t: t.where("dir = ''").select("hash").first()
    return root(now) is not None and root(now) == root(before)


class ReportCache:
    """Reports by content key, as Parquet under a folder: a table of puts, newest first by their number.

    ``hot`` keeps what was looked up last in memory (at most ``most`` rows, by Spark's own cache)."""

    SCHEMA = "key string, value string, put bigint, gone boolean"

    def __init__(self, spark, folder: str, namespace: str = "r", most: int = 1024):
        self.spark, self.path, self.most, self.hot = spark, f"{folder.rstrip('/')}/{namespace}", most, None

    def rows(self) -> DataFrame:
        """key and value of what is there: the last put of each key, unless it was deleted."""
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(fs_path):
            return self.spark.createDataFrame([], self.SCHEMA).select("key", "value")
        every = self.spark.read.schema(self.SCHEMA).parquet(self.path)
        last = every.groupBy("key").agg(F.max(F.struct("put", "gone", "value")).alias("last"))
        return last.where("NOT last.gone").select("key", "last.value")

    def _append(self, rows: DataFrame, gone: bool) -> None:
        made = rows.select("key", (F.lit(None).cast("string") if gone else F.col("value")).alias("value"), F.unix_micros(F.current_timestamp()).alias("put"), F.lit(gone).alias("gone"))
        made.write.mode("append").parquet(self.path)
        if self.hot is not None:
            self.hot.unpersist()
            self.hot = None

    def put(self, rows: DataFrame) -> None:
        """Add (key, value); a key that is there gets the new value."""
        self._append(rows, False)

    def delete(self, keys: DataFrame) -> None:
        self._append(keys, True)

    def get(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys`` (key and more) that have a value, with it; from memory where all of them are there."""
        return keys.join(self.rows(), "key")

    def get_hot(self, keys: list[str]) -> dict[str, str]:
        """Values of a few keys: from those kept in memory, else from the table, which then stay."""
        if self.hot is not None:
            found = {r.key: r.value for r in self.hot.where(F.col("key").isin(keys)).collect()}
            if len(found) == len(set(keys)):
                return found
        rows = self.rows().where(F.col("key").isin(keys)).limit(self.most).persist()
        self.hot = rows
        return {r.key: r.value for r in rows.collect()}

    def missing(self, keys: DataFrame) -> DataFrame:
        return keys.join(self.rows().select("key"), "key", "left_anti")

    def contains(self, key: str) -> bool:
        return not self.rows().where(F.col("key") == key).isEmpty()


def reports_through(units: DataFrame, cache: ReportCache | None, compute, language: Column | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """unit_id and report (JSON): what the cache has, and what ``compute`` makes of the other units, which is put there.

    ``compute`` takes units and gives unit_id and report; equal contents are computed once."""
    if cache is None:
        return compute(units)
    keyed = units.withColumn("key", content_key(F.col("source"), language, weights))
    todo = cache.missing(keyed.groupBy("key").agg(F.min(F.struct("unit_id", "path", "source")).alias("u")))
    todo = Written(todo.select("key", "u.*"), "cache-misses")
    made = compute(todo.df.drop("key")).join(todo.df.select("unit_id", "key"), "unit_id")
    cache.put(made.select("key", F.col("report").alias("value")))
    todo.drop()
    return cache.get(keyed.select("unit_id", "key")).select("unit_id", F.col("value").alias("report"))


def corpus_insert(new: DataFrame, folder: str) -> None:
    """Append what the corpus does not have, one row a hash: the first write stays."""
    spark = new.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    existing = spark.read.parquet(folder) if there else None
    first_by_hash(new, existing).withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(folder)


def trend_insert(rows: DataFrame, folder: str) -> None:
    """Append always, with the time."""
    rows.withColumn("recorded_at", F.current_timestamp()).write.mode("append").parquet(folder)


def rolled_up(verdicts: DataFrame) -> DataFrame:
    """dir, primary and confidence: confidence-weighted lines of each family over all lines beneath."""
    loc = F.greatest(F.col("n"), F.lit(1))
    rows = verdicts.select(F.explode(prefixes(F.col("path"))).alias("dir"), "primary", loc.alias("loc"), (F.round(F.col("confidence") * 1000000).cast("long") * loc).alias("w"))
    each = rows.groupBy("dir").agg(F.sum("loc").alias("loc"), F.count(F.lit(1)).alias("files"), *[F.sum(F.when(F.col("primary") == f, F.col("w")).otherwise(F.lit(0))).alias(f"w_{f}") for f in FAMILIES])
    best = F.greatest(*[F.col(f"w_{f}") for f in FAMILIES])
    primary = F.lit("human")
    for f in sorted(FAMILIES, key=lambda f: DISPLAY[f]):
        primary = F.when(F.col(f"w_{f}") == best, F.lit(f)).otherwise(primary)
    return each.select("dir", "files", primary.alias("primary"), F.round(best / F.col("loc") / 1000000, 4).alias("confidence"))


def family_share(verdicts: DataFrame) -> DataFrame:
    """Percent of lines by family over units with lines and a verdict."""
    # Units without lines weigh nothing.
    sums = verdicts.agg(F.sum("n").alias("n"), *[F.sum(F.round(F.col(f"share_{f}") * 1000000).cast("long") * F.col("n")).alias(f"s_{f}") for f in FAMILIES])
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("family"), F.coalesce(F.floor(F.col(f"s_{f}") / F.col("n") / 10000 + 0.5), F.lit(0)).cast("long").alias("percent")) for f in FAMILIES]))
    return sums.select(rows.alias("r")).select("r.*")


def history(verdicts: DataFrame, most: int = 20) -> DataFrame:
    """path, turn, primary, confidence and change against the newer row above; the newest ``most`` of each path.

    Input: path, turn (order of commits), primary, confidence."""
    w = Window.partitionBy("path").orderBy(F.desc("turn"))
    newer_p, newer_c = F.lag("primary").over(w), F.lag("confidence").over(w)
    delta = F.round(F.col("confidence") - newer_c, 6)
    change = (
        F.when(newer_p.isNull(), F.lit(""))
        .when(newer_p != F.col("primary"), F.concat(newer_p, F.lit(" to "), F.col("primary")))
        .when(F.abs(delta) < 0.005, F.lit("same"))
        .when(delta > 0, F.lit("up"))
        .otherwise(F.lit("down"))
    )
    return verdicts.select("path", "turn", "primary", "confidence", change.alias("change"), F.row_number().over(w).alias("k")).where(F.col("k") <= most).drop("k")


def _class(p: str, i: int) -> tuple[str, int]:
    """A bracket class at i as a regular expression, and what follows it; a bracket that is never closed is itself."""
    j = i + 1
    if j < len(p) and p[j] in "!^":
        j += 1
    if j < len(p) and p[j] == "]":
        j += 1
    while j < len(p) and p[j] != "]":
        j += 2 if p[j] == "\\" else 1
    if j >= len(p):
        return r"\[", i + 1
    body = p[i + 1 : j]
    negated = body[0] in "!^"
    body = re.sub(r"([\\\[&~^])", r"\\\1", re.sub(r"\\(.)", r"\1", body[negated:]))
    return f"(?!/)[{'^' if negated else ''}{body}]", j + 1


def glob_regex(pattern: str) -> tuple[str, bool]:
    """A gitignore pattern as an anchored regular expression for a path or one of its parents, and whether it ignores."""
    keep = pattern.startswith("!")
    p = pattern[1:] if keep else pattern
    p = p.rstrip("/")
    rooted = "/" in p
    p = p.lstrip("/")
    out, i = "", 0
    while i < len(p):
        if p[i : i + 3] == "**/" and (i == 0 or p[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif p[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        elif p[i] == "\\" and i + 1 < len(p):
            out, i = out + re.escape(p[i + 1]), i + 2
        elif p[i] == "[":
            more, i = _class(p, i)
            out += more
        else:
            out += "[^/]*" if p[i] == "*" else "[^/]" if p[i] == "?" else re.escape(p[i])
            i += 1
    return ("^" if rooted else "^(?:.*/)?") + out + "(?:/.*)?$", not keep


def patterns_of(text: str) -> list[str]:
    """The patterns of an ignore file: no comments, no blank lines, blanks at an end only where they are escaped."""
    out = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if line and not line.startswith("#"):
            out.append(line)
    return out


def ignored(path: Column, patterns: list[str]) -> Column:
    """Last matching pattern wins; a match of a parent is a match."""
    out = F.lit(False)
    for pattern in patterns_of("\n".join(patterns)):
        regex, verdict = glob_regex(pattern)
        out = F.when(path.rlike(regex), F.lit(verdict)).otherwise(out)
    return out


def contains_any(path: Column, parts: list[str]) -> Column:
    """The substring form of ignore rules."""
    return reduce(lambda a, b: a | b, [F.contains(path, F.lit(p)) for p in parts], F.lit(False))


def project_tools(paths: DataFrame) -> DataFrame:
    """dir, tool and config_path by known files, folders and the first file with a known start."""
    cases = [(t, "^(|.*/)(" + re.escape(f) + ")$") for t, f in TOOL_FILES]
    cases += [(t, "^(|.*/)(" + re.escape(f) + ")/.+$") for t, f in TOOL_FOLDERS]
    cases += [(t, "^(|.*/)(" + re.escape(f) + "[^/]*)$") for t, f in TOOL_STARTS]
    found = F.array_compact(
        F.array(*[F.when(F.col("path").rlike(p), F.struct(F.regexp_extract("path", p, 1).alias("dir"), F.lit(t).alias("tool"), F.concat(F.regexp_extract("path", p, 1), F.regexp_extract("path", p, 2)).alias("config_path"))) for t, p in cases])
    )
    rows = paths.select(F.explode(found).alias("r")).select("r.*").distinct()
    starts = [t for t, _ in TOOL_STARTS]
    several = rows.where(~F.col("tool").isin(starts))
    first = rows.where(F.col("tool").isin(starts)).groupBy("dir", "tool").agg(F.min("config_path").alias("config_path"))
    return several.unionByName(first)


# Trees as lists. ------------------------------------------------------------------------


def flat_tree(verdicts: DataFrame) -> DataFrame:
    """path, name, depth, is_dir, primary, confidence and ``order``: every file and folder below the root.

    Ordering by ``order`` walks the tree: a folder before what it holds, folders before files, each by name."""
    parts = F.split("path", "/")
    files = verdicts.select("path", F.element_at(parts, -1).alias("name"), (F.size(parts) - 1).alias("depth"), F.lit(False).alias("is_dir"), "primary", "confidence")
    dirs = rolled_up(verdicts).where("dir <> ''").select(
        F.col("dir").alias("path"), F.element_at(F.split("dir", "/"), -1).alias("name"), (F.size(F.split("dir", "/")) - 1).alias("depth"), F.lit(True).alias("is_dir"), "primary", "confidence"
    )
    both = dirs.unionByName(files)
    pieces = F.split("path", "/")
    steps = F.transform(pieces, lambda x, i: F.struct(((i == F.size(pieces) - 1) & ~F.col("is_dir")).cast("int").alias("file"), x.alias("name")))
    return both.withColumn("order", steps)


def walked(verdicts: DataFrame) -> DataFrame:
    """The flat tree in the order of its walk, by one range sort.

    Verdicts are written first: files, folders and the sort's look at its range each read them again."""
    return flat_tree(Written(verdicts.select("path", "n", "primary", "confidence"), "tree-verdicts").df).orderBy("order").drop("order")


def at_commits(verdicts: DataFrame) -> DataFrame:
    """commit, files, primary and confidence: each commit's tree, weighted by lines; without files human, 0.5.

    Input: commit, path, n, primary, confidence; a null path stands for a commit without sources."""
    loc = F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))
    there = F.col("path").isNotNull()
    w = F.round(F.col("confidence") * 1000000).cast("long") * loc
    sums = verdicts.groupBy("commit").agg(
        F.sum(F.when(there, loc)).alias("loc"), F.count(F.when(there, 1)).alias("files"),
        *[F.coalesce(F.sum(F.when(there & (F.col("primary") == f), w)), F.lit(0)).alias(f"w_{f}") for f in FAMILIES],
    )
    best = F.greatest(*[F.col(f"w_{f}") for f in FAMILIES])
    primary = F.lit("human")
    for f in sorted(FAMILIES, key=lambda f: DISPLAY[f]):
        primary = F.when(F.col(f"w_{f}") == best, F.lit(f)).otherwise(primary)
    return sums.select("commit", "files", F.when(F.col("loc").isNull(), "human").otherwise(primary).alias("primary"), F.when(F.col("loc").isNull(), 0.5).otherwise(F.round(best / F.col("loc") / 1000000, 4)).alias("confidence"))
