"""Analysis of units from end to end, and the places where a caller can put something else.

``Pipeline.with_defaults()`` has the catalogue's rules and weights. Everything that a
protocol below describes can be given instead: more analyzers, a parser's metrics or
none, weights, ignore rules, a cache, a scorer, a colour theme.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from typing import NamedTuple, Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineament.operators import attribution as at
from lineament.operators import detect, reports, syntax, tables
from lineament.plans.catalogue import ANALYZERS, DISPLAY, FAMILIES
from lineament.sources import files


class Rule(NamedTuple):
    """A signal that holds where ``when`` is true: SQL over ``x`` (an array of lines with l, t, lo, pt, nt), n, path and language."""

    id: str
    family: str
    tenths: int
    when: str


class Analyzer(Protocol):
    name: str

    def rules(self) -> Sequence[Rule]: ...


class CstAnalyzer(Protocol):
    """A parser of one language: a module with ``parse`` and ``metrics``, as those of lineament.syntax."""

    def parse(self, source: str): ...

    def metrics(self, tree) -> dict[str, float]: ...


class HeuristicsProvider(Protocol):
    def weights(self) -> dict[str, float]: ...


class IgnoreRules(Protocol):
    def ignored(self, path: Column) -> Column: ...


class CacheBackend(Protocol):
    def get(self, keys: DataFrame) -> DataFrame: ...

    def put(self, rows: DataFrame) -> None: ...

    def delete(self, keys: DataFrame) -> None: ...

    def contains(self, key: str) -> bool: ...

    def missing(self, keys: DataFrame) -> DataFrame: ...


class PostScorer(Protocol):
    def rescore(self, signals: DataFrame) -> DataFrame:
        """unit_id and share_<family> from unit_id, path, language, n, hits and perhaps metrics."""
        ...


class Classifier(Protocol):
    def votes(self, rows: DataFrame, key: str = "unit_id") -> DataFrame: ...


class ColorTheme(Protocol):
    def terminal(self, family: str) -> str: ...


class DefaultWeights:
    def weights(self) -> dict[str, float]:
        return {}


@dataclass
class ConfiguredWeights:
    """Weights of a configuration: they win over the catalogue's, and 0 disables a signal."""

    given: dict[str, float]

    def weights(self) -> dict[str, float]:
        return dict(self.given)


class AllowAll:
    def ignored(self, path: Column) -> Column:
        return F.lit(False)


@dataclass
class PatternIgnore:
    """Paths that hold one of some texts."""

    parts: list[str]

    def ignored(self, path: Column) -> Column:
        return tables.contains_any(path, self.parts)


@dataclass
class GlobIgnore:
    """gitignore patterns; the last that matches wins."""

    patterns: list[str]

    def ignored(self, path: Column) -> Column:
        return tables.ignored(path, self.patterns)


class DefaultTheme:
    def terminal(self, family: str) -> str:
        return reports.COLOURS[family][0]


@dataclass
class ModelScorer:
    """What a fitted classifier says, as shares of the known families."""

    classifier: Classifier

    def rescore(self, signals: DataFrame) -> DataFrame:
        from lineament.operators import learning

        return learning.rescored(self.classifier.votes(learning.extracted(signals)))


def parsed_families(names: Sequence[str]) -> list[str]:
    """Families by name whatever the case; an unknown one is an error."""
    known = [n.strip().lower() for n in names]
    if bad := [n for n in known if n not in FAMILIES]:
        raise ValueError(f"unknown family {bad[0]!r}; known: {', '.join(DISPLAY.values())}")
    return known


FORMATS = ("pretty", "text", "json")


def parsed_format(name: str) -> str:
    if name.strip().lower() not in FORMATS:
        raise ValueError(f"unknown format {name!r}; known: {', '.join(FORMATS)}")
    return name.strip().lower()


@dataclass
class Pipeline:
    analyzers: tuple[str, ...] = ANALYZERS
    more: list[Analyzer] = field(default_factory=list)
    with_syntax: bool = True
    heuristics: HeuristicsProvider = field(default_factory=DefaultWeights)
    ignore: IgnoreRules = field(default_factory=AllowAll)
    cache: CacheBackend | None = None
    scorer: PostScorer | None = None
    blend: float = 0.0
    theme: ColorTheme = field(default_factory=DefaultTheme)

    @staticmethod
    def with_defaults() -> Pipeline:
        return Pipeline()

    def with_heuristics(self, heuristics: HeuristicsProvider) -> Pipeline:
        return replace(self, heuristics=heuristics)

    def with_model(self, scorer: PostScorer, blend: float) -> Pipeline:
        return replace(self, scorer=scorer, blend=min(1.0, max(0.0, blend)))

    def signals(self, units: DataFrame) -> DataFrame:
        """unit_id, path, language, n, signals, hits (and metrics): weights replaced, disabled signals gone."""
        kept = units.where(~self.ignore.ignored(F.coalesce("path", F.lit(""))))
        rules = [r for a in self.more for r in a.rules()]
        cases = ", ".join(f"IF({r.when}, named_struct('id', '{r.id}', 'family', '{r.family}', 'tenths', {r.tenths}), NULL)" for r in rules)
        extra = f"array_compact(array({cases}))" if rules else None
        if self.with_syntax:
            found = syntax.signals(kept, analyzers=self.analyzers, more=extra)
        else:
            found = detect.hits(kept, self.analyzers, more=extra)
        weights = self.heuristics.weights()
        columns = ["unit_id", "path", "language", "n", *(["metrics"] if self.with_syntax else [])]
        if weights:
            pairs = ", ".join(f"'{k}', {round(w * 10)}" for k, w in weights.items())
            changed = f"transform(hits, h -> named_struct('id', h.id, 'family', h.family, 'tenths', coalesce(element_at(map({pairs}), h.id), h.tenths)))"
            found = detect.once(found, columns, hits=f"filter({changed}, h -> h.tenths <> 0)")
        return found.select(*columns, F.expr("transform(hits, h -> h.id)").alias("signals"), "hits")

    def verdicts(self, units: DataFrame) -> DataFrame:
        """unit_id, path, n, signal_count, share_<family>, primary, confidence."""
        return self._judged(self.signals(units), ("unit_id", "path", "n"))

    def _judged(self, signals: DataFrame, keep: tuple[str, ...]) -> DataFrame:
        v = at.attributed(signals, keep)
        if self.scorer is None or self.blend == 0:
            return v
        both = at.blended(v.select("unit_id", *[f"share_{f}" for f in FAMILIES]), self.scorer.rescore(signals), self.blend)
        return v.select(*keep, "signal_count").join(both, "unit_id")

    def reports(self, units: DataFrame) -> DataFrame:
        """unit_id and report, a struct."""
        return reports.reported(self.signals(units), self._judged)

    def reports_json(self, units: DataFrame) -> DataFrame:
        """unit_id and report as JSON, through the cache if there is one (and no scorer, whose model the key does not know)."""
        cache = None if self.scorer is not None else self.cache
        language = detect.language_of(F.col("path"))
        return tables.reports_through(units, cache, lambda u: reports.as_json(self.reports(u)), language, self.heuristics.weights())

    def symbol_reports(self, units: DataFrame) -> DataFrame:
        """unit_id, name, kind, start_line, end_line, path and the verdict of every symbol; weights are the defaults, as in a file's symbols."""
        own = replace(self, heuristics=DefaultWeights(), scorer=None, cache=None)
        v = own.verdicts(syntax.symbol_units(units))
        return v.select("unit_id.*", "path", "n", "signal_count", *[f"share_{f}" for f in FAMILIES], "primary", "confidence")

    def written(self, units: DataFrame, form: str) -> DataFrame:
        """unit_id and report in one of FORMATS."""
        form = parsed_format(form)
        if form == "json":
            return self.reports_json(units)
        made = self.reports(units)
        return reports.as_text(made) if form == "text" else reports.as_pretty(made, {f: self.theme.terminal(f) for f in FAMILIES})

    def history(self, commits: DataFrame, most: int = 20, by_language: bool = False) -> DataFrame:
        """commit, date, primary, confidence and change of the versions of one or more paths (commit, path, ts, place, source), the newest first.

        As in a list of commits, sources follow the Rust rules whatever their language, unless ``by_language``; an empty source is human, 0.5."""
        key = F.struct("path", "place", "commit", "ts").alias("unit_id")
        units = commits.select(key, (F.col("path") if by_language else F.lit(None).cast("string")).alias("path"), "source")
        v = replace(self, with_syntax=by_language).verdicts(units)
        empty = F.col("n") == 0
        rows = v.select(
            F.col("unit_id.path").alias("path"), (-F.col("unit_id.place")).alias("turn"), "unit_id.commit", "unit_id.ts",
            F.when(empty, "human").otherwise(F.col("primary")).alias("primary"), F.when(empty, 0.5).otherwise(F.col("confidence")).alias("confidence"),
        )
        changes = tables.history(rows.select("path", "turn", "primary", "confidence"), most)
        return changes.join(rows.select("path", "turn", "commit", "ts"), ["path", "turn"]).select("path", "commit", reports.date_of(F.col("ts")).alias("date"), "primary", "confidence", "change", (-F.col("turn")).alias("place"))

    def directory(self, spark: SparkSession, folder: str, patterns: list[str] | None = None, state: str | None = None) -> DataFrame:
        """path and report (JSON) of every source below a folder that is not ignored.

        With ``state``, a shared folder, reports are kept there, and the Merkle tree of the folder beside
        them: while its root is what it was, reports are only looked up, and no source is analysed. A sink
        that wants them in order sorts by path."""
        units = files.directory(spark, folder, patterns)
        if state is None:
            made = replace(self, cache=None).reports_json(units)
            return units.select("unit_id", "path").join(made, "unit_id").select("path", "report")
        cache = tables.ReportCache(spark, state)
        trees = tables.ReportCache(spark, state, "d")
        tree = tables.merkle(files.all_files(spark, folder, patterns))
        root = tree.where("dir = ''").select("hash").first()
        known = trees.get_hot([folder]).get(folder)
        language = detect.language_of(F.col("path"))
        if root is not None and known == root.hash:
            keyed = units.select("path", tables.content_key(F.col("source"), language, self.heuristics.weights()).alias("key"))
            there = cache.get(keyed).select("path", F.col("value").alias("report"))
            if cache.missing(keyed).isEmpty():
                return there
        made = replace(self, cache=cache).reports_json(units)
        if root is not None:
            trees.put(spark.createDataFrame([(folder, root.hash)], "key string, value string"))
        return units.select("unit_id", "path").join(made, "unit_id").select("path", "report")

    def failed_gate(self, units: DataFrame, allowed: Sequence[str]) -> DataFrame:
        """unit_id and primary of units that have signals and whose family is not among those allowed."""
        return at.gate(self.verdicts(units), parsed_families(allowed))
