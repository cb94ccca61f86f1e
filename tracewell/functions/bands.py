"""Bands: raw measurements as a few named, half-open intervals that cover all integers."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.functions.fixed import MAX_BANDS
from tracewell.functions.redaction import guard_reason

I64_MIN = -(2**63)
_SNAKE = re.compile(r"[a-z0-9]([a-z0-9_]*[a-z0-9])?")


class BandError(ValueError):
    """A table or registration that is refused."""


@dataclass(frozen=True)
class Band:
    """[lower, upper); upper None means unbounded."""

    name: str
    lower: int
    upper: int | None


@dataclass(frozen=True)
class BandTable:
    """Bands of one facet, in order, together covering every integer once."""

    namespace: str
    name: str
    version: str
    bands: tuple[Band, ...]

    def __post_init__(self) -> None:
        if not all(x.strip() for x in (self.namespace, self.name, self.version)):
            raise BandError("namespace, name and version must not be blank")
        if not 1 <= len(self.bands) <= MAX_BANDS:
            raise BandError(f"a table has 1 to {MAX_BANDS} bands")
        names = [b.name for b in self.bands]
        if len(set(names)) < len(names) or not all(_SNAKE.fullmatch(n) for n in names):
            raise BandError("band names are snake_case and unique")
        if self.bands[0].lower != I64_MIN:
            raise BandError("the first band begins at the smallest integer")
        if self.bands[-1].upper is not None:
            raise BandError("the last band is unbounded")
        for below, above in zip(self.bands, self.bands[1:]):
            if below.upper is None or below.upper > above.lower:
                raise BandError("bands overlap")
            if below.upper < above.lower:
                raise BandError("gap between bands")
            if below.upper <= below.lower:
                raise BandError("a band is empty")

    @staticmethod
    def of(namespace: str, name: str, version: str, first: str, *rest: tuple[int, str]) -> BandTable:
        """A table from its lowest band and the (lower bound, band) pairs above."""
        lowers, names = [I64_MIN, *[x for x, _ in rest]], [first, *[n for _, n in rest]]
        return BandTable(namespace, name, version, tuple(Band(n, a, b) for n, a, b in zip(names, lowers, [*lowers[1:], None])))

    def band(self, raw: Column) -> Column:
        """The band's name; null for null. A bound belongs to the band above it."""
        out = F.when(raw.isNull(), F.lit(None).cast("string"))
        for b in self.bands[:-1]:
            out = out.when(raw < b.upper, b.name)
        return out.otherwise(self.bands[-1].name)

    def predicate(self, raw: Column, name: str) -> Column:
        """``raw`` lies in the band ``name``, as a range that reaches the Parquet scan."""
        b = next((b for b in self.bands if b.name == name), None)
        if b is None:
            raise BandError(f"no band {name}")
        low = raw >= b.lower if b.lower != I64_MIN else raw.isNotNull()
        return low if b.upper is None else low & (raw < b.upper)

    def rows(self) -> list[tuple[str, str, str, str, int, int | None]]:
        return [(self.namespace, self.name, self.version, b.name, b.lower, b.upper) for b in self.bands]


@dataclass
class Registry:
    """What an engine version may emit: band tables and category facets; a facet of free content can't be registered."""

    tables: dict[tuple[str, str], BandTable] = field(default_factory=dict)
    categories: dict[tuple[str, str], frozenset[str]] = field(default_factory=dict)

    def register(self, table: BandTable, kind: str = "banded") -> None:
        if kind not in ("banded", "category"):
            raise BandError(f"{kind} can't be registered")
        key = table.namespace, table.name
        if key in self.tables or key in self.categories:
            raise BandError("registered already")
        if kind == "banded":
            self.tables[key] = table
        else:
            self.categories[key] = frozenset(b.name for b in table.bands)

    def register_category(self, namespace: str, name: str, declared: Iterable[str] = ()) -> None:
        if (namespace, name) in self.tables or (namespace, name) in self.categories:
            raise BandError("registered already")
        self.categories[namespace, name] = frozenset(declared)

    def lookup(self, namespace: str, name: str) -> BandTable:
        if (namespace, name) not in self.tables:
            raise BandError("not registered")
        return self.tables[namespace, name]

    def project_banded(self, namespace: str, name: str, raw: Column, excerpts: Column) -> Column:
        """struct<namespace,name,value,breach>: the band as a text facet, and why it is refused, if it is."""
        value = self.lookup(namespace, name).band(raw)
        return F.struct(F.lit(namespace).alias("namespace"), F.lit(name).alias("name"), value.alias("value"), guard_reason(value, excerpts).alias("breach"))

    def project_category(self, namespace: str, name: str, value: Column, excerpts: Column, strict: bool = False) -> Column:
        """The same for a category given as text; ``strict`` asks for one of the declared names."""
        if (namespace, name) not in self.categories:
            raise BandError("not registered")
        blank = ~F.coalesce(value, F.lit("")).rlike(r"(?U)\S")
        breach = F.when(blank, "blank")
        if strict:
            breach = breach.when(~value.isin(*sorted(self.categories[namespace, name])), "undeclared")
        return F.struct(F.lit(namespace).alias("namespace"), F.lit(name).alias("name"), value.alias("value"), F.coalesce(breach, guard_reason(value, excerpts)).alias("breach"))

    def as_table(self, spark: SparkSession) -> DataFrame:
        """(namespace, name, version, band, lower, upper): a few rows per registered facet."""
        rows = [r for t in self.tables.values() for r in t.rows()]
        return spark.createDataFrame(rows, "namespace string, name string, version string, band string, lower long, upper long")

    def registered(self, spark: SparkSession) -> DataFrame:
        """(namespace, name) of everything registered."""
        return spark.createDataFrame([*self.tables, *self.categories], "namespace string, name string")


def unregistered(facets: DataFrame, registered: DataFrame) -> DataFrame:
    """Facets that no registration covers."""
    return facets.join(registered, ["namespace", "name"], "left_anti")


def discontinuities(bands: DataFrame) -> DataFrame:
    """(namespace, name, band, fault) of band tables held as data: ``gap``, ``overlap``, ``empty``, ``bounded-above`` or ``floating-low``.

    A facet has at most MAX_BANDS rows, so its window is small.
    """
    of = Window.partitionBy("namespace", "name").orderBy("lower")
    following, previous = F.lead("lower").over(of), F.lag("lower").over(of)
    fault = (
        F.when(F.col("upper") <= F.col("lower"), "empty")
        .when(previous.isNull() & (F.col("lower") != I64_MIN), "floating-low")
        .when(following.isNull() & F.col("upper").isNotNull(), "bounded-above")
        .when(following > F.col("upper"), "gap")
        .when((following < F.col("upper")) | (following.isNotNull() & F.col("upper").isNull()), "overlap")
    )
    return bands.withColumn("fault", fault).where("fault is not null").select("namespace", "name", "band", "fault")


def band_by_join(values: DataFrame, raw: str, bands: DataFrame) -> DataFrame:
    """Bands of one facet by a range join, for tables that live in data; more than MAX_BANDS rows are refused, so the broadcast is small."""
    if bands.limit(MAX_BANDS + 1).count() > MAX_BANDS:
        raise BandError(f"a table has 1 to {MAX_BANDS} bands")
    b = F.broadcast(bands.select(F.col("band"), F.col("lower"), F.col("upper")))
    return values.join(b, (F.col(raw) >= F.col("lower")) & (F.col("upper").isNull() | (F.col(raw) < F.col("upper"))))


def default_registry(version: str = "v1") -> Registry:
    """The twelve planned facets of sessions, outcomes, friction and cost, and the tables that queries and tests use.

    Bounds of durations, tool errors and tokens are the plan's; where it only says "banded" they are chosen here.
    """
    registry = Registry()
    minute, hour, kilo = 60, 3600, 1000
    spans = ("xs", (5 * minute, "s"), (15 * minute, "m"), (hour, "l"), (4 * hour, "xl"))
    tables: Mapping[tuple[str, str], tuple] = {
        ("subject", "path.depth"): ("root", (2, "shallow"), (4, "middle"), (7, "deep")),
        ("session", "duration.bucket"): spans,
        ("session", "turns.bucket"): ("none", (1, "one"), (2, "few"), (6, "some"), (21, "many")),
        ("session", "tool.errors.bucket"): ("none", (1, "one_two"), (3, "three_five"), (6, "six_ten"), (11, "more")),
        ("session", "delegation.depth"): ("none", (1, "one"), (2, "two"), (3, "deeper")),
        ("friction", "interruptions.bucket"): ("none", (1, "one"), (2, "few"), (6, "many")),
        ("cost", "input.tokens.bucket"): ("0", (kilo, "1k_10k"), (10 * kilo, "10k_50k"), (50 * kilo, "50k_200k"), (200 * kilo, "200k_up")),
        ("cost", "wall.bucket"): spans,
        ("event", "value"): ("tiny", (10, "small"), (50, "medium"), (120, "large")),
        ("latency", "duration"): ("instant", (100, "quick"), (1000, "slow"), (10000, "stalled")),
    }
    for (namespace, name), bands in tables.items():
        registry.register(BandTable.of(namespace, name, version, *bands))
    registry.register_category("subject", "crate")
    registry.register_category("outcome", "class", ("verified-pass", "verified-fail", "unverified", "blocked", "abandoned"))
    registry.register_category("outcome", "verification.gate")
    registry.register_category("friction", "category")
    registry.register_category("effort", "outcome", ("held", "reverted", "open"))
    return registry
