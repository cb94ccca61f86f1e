"""Append-only tables on Parquet, several of which one batch changes together or not at all.

A batch writes its rows of each table to ``<table>/batch=<id>/`` and then creates one manifest file that
names them. Readers take only what manifests name, so a batch whose writer died is invisible, and running
it again writes over its own, unnamed folders. Manifests are created exclusively (see ``sources.files``);
the file system is reached through Hadoop.

A store has a version, and each version its tables, whose columns a schema file beside each table names.
Opening verifies what is held before it is used; whoever has verified it already opens it without.
"""

from __future__ import annotations

import json
import os
import stat
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.derived import in_vocabulary, slot_ok
from tracewell.functions.fixed import HARNESS_KIND
from tracewell.operators import audit, ledger
from tracewell.operators.derived import dangling, project_facets, refusals
from tracewell.operators.graph import closes_cycle
from tracewell.session import cut
from tracewell.sources.files import FileThere, Folder

VERSION = 3
#: Tables with their columns and key.
TABLES = {
    "observations": ("id string, observed_at string, document string", ("id",)),
    "receipts": ("harness string, session_id string, source_event_id string, event_digest string, observation_id string", ("harness", "session_id", "source_event_id")),
    "derivations": ("id string, kind string, recorded_at string, supersedes string, document string", ("id",)),
    "derivation_facets": (
        "derivation_id string, namespace string, name string, slot string, text_value string, integer_value long, boolean_value int, confidence string, freshness string, recorded_at string",
        ("derivation_id", "namespace", "name"),
    ),
    "derivation_evidence": ("derivation_id string, target_key string, role string, recorded_at string", ("derivation_id", "target_key")),
    "relationships": ("id string, from_key string, to_key string, relation string, confidence string, recorded_at string, document string", ("id",)),
    "quarantine": ("raw_id long, file_name string, body string, reason string", ("raw_id",)),
}


#: The version that brought each table in.
SINCE = {"observations": 1, "quarantine": 2, "receipts": 2, "derivations": 3, "derivation_facets": 3, "derivation_evidence": 3, "relationships": 3}


class StoreError(ValueError):
    """An append or a store that is refused."""


@dataclass(frozen=True)
class Store:
    """A ledger under ``root``."""

    spark: SparkSession
    root: str

    # Files.

    @cached_property
    def _folder(self) -> Folder:
        return Folder(self.spark, self.root)

    def _put(self, name: str, text: str) -> None:
        try:
            self._folder.put(name, text)
        except FileThere as e:
            raise StoreError(str(e)) from e

    def batches(self) -> list[str]:
        """Ids of the batches that are committed, in order."""
        return [n[: -len(".json")] for n in self._folder.names("manifests") if n.endswith(".json")]

    # Catalogue.

    def initialize(self, version: int = VERSION) -> Store:
        """Make the store, or migrate an older one; a store of this version stays as it is."""
        held = self.version()
        if held is not None and held > version:
            raise StoreError(f"the store is of version {held}")
        if held is None:
            self._add_tables(0, version)
            self._put(f"version-{version}", str(version))
        elif held < version:
            self.migrate(version)
        return self

    def _add_tables(self, after: int, version: int) -> None:
        for name, since in SINCE.items():
            if after < since <= version and self._folder.get(f"schemas/{name}.ddl") is None:
                self._put(f"schemas/{name}.ddl", TABLES[name][0])

    def migrate(self, version: int = VERSION) -> None:
        """Add the tables of newer versions, then the version's mark. No document is rewritten, which is verified before the mark is set.

        A migration that died is done again from its start.
        """
        held = self.version()
        if held is None or held >= version:
            raise StoreError("nothing to migrate")
        before = ledger.snapshot_digest(self.read("observations")).collect()
        self._add_tables(held, version)
        if ledger.snapshot_digest(self.read("observations")).collect() != before:
            raise StoreError("documents changed during the migration")
        self._put(f"version-{version}", str(version))

    def version(self) -> int | None:
        found = [n.split("-")[1] for n in self._folder.names() if n.startswith("version-")]
        return max((int(n) for n in found if n.isdigit()), default=None)

    def open(self, verify: bool = True) -> Store:
        """The store, if it is of this version and nothing in it breaks a rule; ``verify=False`` skips the reading of its rows."""
        held = self.version()
        if held is None:
            raise StoreError("no store here")
        if held < VERSION:
            raise StoreError("migration required")
        if held > VERSION:
            raise StoreError(f"the store is of version {held}")
        faults = self.unsafe_files() + self.schema_faults()
        if faults:
            raise StoreError(f"unsafe or unknown: {faults[0]}")
        if verify:
            found = self.violations().limit(1).collect()
            if found:
                raise StoreError(f"{found[0].check}: {found[0].key}: {found[0].detail}")
        return self

    def unsafe_files(self) -> list[str]:
        """Of a store on a local file system, its own files and folders that are links, another user's, or writable by others."""
        root, out = self._folder.local(), []
        if root is None:
            return out
        for folder in (root, root / "manifests", root / "schemas"):
            for path in [folder, *(p for p in (folder.iterdir() if folder.is_dir() else ()) if not p.name.startswith(".") and (p.is_symlink() or p.is_file()))]:
                if not os.path.lexists(path):
                    continue
                s = path.lstat()
                if stat.S_ISLNK(s.st_mode) or s.st_uid != os.getuid() or s.st_mode & stat.S_IWOTH:
                    out.append(str(path))
        return out

    def schema_faults(self) -> list[str]:
        """Tables without schema file, schema files without table, columns (or their order) other than this version's, and data other than its schema."""
        named = [n.removesuffix(".ddl") for n in self._folder.names("schemas") if n.endswith(".ddl")]
        out = [f"missing {n}" for n in TABLES if n not in named] + [f"extra {n}" for n in named if n not in TABLES]
        for name in named:
            if name in TABLES:
                if self._folder.get(f"schemas/{name}.ddl") != TABLES[name][0]:
                    out.append(f"columns of {name}")
                paths = self.batch_folders(name)
                out += [f"{name}: {fault}" for fault in (audit.schema_drift(self.spark.read.parquet(*paths), TABLES[name][0]) if paths else [])]
        return out

    def violations(self) -> DataFrame:
        """All audits of the rows (check, key, detail)."""
        names = ("observations", "receipts", "derivations", "derivation_facets", "relationships")
        return audit.full(*[self.read(n) for n in names]).unionByName(audit.orphans(self.read("derivation_evidence"), "derivation_id", self.read("derivations"), "id", "evidence"))

    def probes(self) -> list[str]:
        """The guards that let pass what they must refuse: each is tried on rows that nothing is written of."""

        def rows(table: str, values: Mapping[str, object]) -> DataFrame:
            names = [c.strip().split(" ")[0] for c in TABLES[table][0].split(",")]
            return self.spark.createDataFrame([tuple(values.get(n) for n in names)], TABLES[table][0])

        def twice(name: str) -> Callable[[], None]:
            row = rows(name, dict.fromkeys(TABLES[name][1], "probe"))
            return lambda: self._new_keys(name, row.unionByName(row))

        edge = {"id": "probe", "from_key": "derivation:a", "to_key": "derivation:b", "relation": "supports", "confidence": "weak"}
        facet = {"derivation_id": "probe", "namespace": "n", "name": "x", "slot": "text", "text_value": "v"}
        tried: dict[str, Callable[[], None]] = {f"repeated {n}": twice(n) for n in TABLES if n != "quarantine"}
        tried |= {f"{n} there already": lambda n=n: self._new_keys(n, self.read(n).limit(1)) for n in TABLES if n != "quarantine" and self.batch_folders(n)}
        tried |= {
            "slot": lambda: self._check_facets(rows("derivation_facets", facet | {"text_value": None, "integer_value": 1})),
            "unknown slot": lambda: self._check_facets(rows("derivation_facets", facet | {"slot": "blob"})),
            "self edge": lambda: self._check_edges(rows("relationships", edge | {"to_key": "derivation:a"})),
            "unknown relation": lambda: self._check_edges(rows("relationships", edge | {"relation": "likes"})),
            "receipt without observation": lambda: self._check_harness(self._harness_rows()),
        }
        passed = []
        for name, attempt in tried.items():
            try:
                attempt()
            except StoreError:
                continue
            passed.append(name)
        return passed

    def _harness_rows(self) -> DataFrame:
        return self.spark.createDataFrame([("probe", "2024-01-01T00:00:00+00:00", "{}", "h", "s", "e", "0" * 64)], "id string, observed_at string, document string, harness_name string, session_id string, source_event_id string, event_digest string")

    # Reading.

    def read(self, name: str) -> DataFrame:
        """All committed rows of a table."""
        ddl, _ = TABLES[name]
        paths = self.batch_folders(name)
        if not paths:
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(ddl).parquet(*paths)

    def batch_folders(self, name: str) -> list[str]:
        """Folders of the committed batches of a table: two listings, no file is opened."""
        there = set(self._folder.names(name))
        return [f"{self.root}/{name}/batch={b}" for b in self.batches() if f"batch={b}" in there]

    # Appending.

    def committed(self, batch: str) -> bool:
        return self._folder.get(f"manifests/{batch}.json") is not None

    def commit(self, batch: str, tables: Mapping[str, DataFrame]) -> bool:
        """Write the tables of a batch and then its manifest; False, and nothing done, if the batch is committed already."""
        if self.committed(batch):
            return False
        held = self.version() or 0
        if any(SINCE[name] > held for name in tables):
            raise StoreError("migration required")
        for name in TABLES.keys() - tables.keys():  # what a run that died under this id may have left
            self._folder.delete(f"{name}/batch={batch}")
        for name, df in tables.items():
            ddl, _ = TABLES[name]
            columns = [c.strip().split(" ") for c in ddl.split(",")]
            df.select(*[F.col(c).cast(t).alias(c) for c, t in columns]).write.mode("overwrite").parquet(f"{self.root}/{name}/batch={batch}")
        self._put(f"manifests/{batch}.json", json.dumps(sorted(tables)))
        return True

    def _refuse(self, rows: DataFrame, why: str) -> None:
        first = rows.limit(1).collect()
        if first:
            raise StoreError(f"{why}: {first[0][0]}")

    def _new_keys(self, name: str, rows: DataFrame) -> None:
        keys = list(TABLES[name][1])
        self._refuse(rows.groupBy(*keys).count().where("count > 1"), f"{name}: a key comes twice in the batch")
        self._refuse(rows.join(self.read(name).select(*keys), keys, "left_semi"), f"{name}: the key is there already")

    def _intact(self, rows: DataFrame) -> DataFrame:
        """What ``rows`` (id, observed_at, document) say (see ``audit.checked_documents``); one that can't be trusted is refused."""
        checked = cut(audit.checked_documents(rows))
        self._refuse(audit.observation_rows(checked).select("detail"), "integrity")
        return checked

    def append_observations(self, batch: str, rows: DataFrame) -> bool:
        """Append observations (id, observed_at, document) other than harness events, which come with receipts.

        Refused are documents that aren't strict JSON, whose digest isn't that of their envelope, or whose id or
        instant differs from the column.
        """
        if self.committed(batch):
            return False
        checked = self._intact(rows)
        self._refuse(checked.where(F.col("kind") == HARNESS_KIND), "a harness event needs a receipt")
        self._new_keys("observations", rows)
        return self.commit(batch, {"observations": rows})

    def _check_harness(self, rows: DataFrame) -> DataFrame:
        """The receipts of ``rows``, if every document is intact and says what its receipt does."""
        receipts = rows.select(F.col("harness_name").alias("harness"), "session_id", "source_event_id", "event_digest", F.col("id").alias("observation_id"))
        self._refuse(audit.receipt_rows(receipts, self._intact(rows)).select("detail"), "receipt")
        return receipts

    def append_harness(self, batch: str, rows: DataFrame, quarantined: DataFrame | None = None) -> bool:
        """Append harness observations with their receipts (see ``ledger.harness_observations``), and what was quarantined beside them.

        Refused is what ``append_observations`` refuses, and a receipt whose identity or digest isn't its document's.
        """
        if self.committed(batch):
            return False
        receipts = self._check_harness(rows)
        self._new_keys("receipts", receipts)
        self._new_keys("observations", rows)
        tables = {"observations": rows, "receipts": receipts}
        if quarantined is not None:
            tables["quarantine"] = quarantined
        return self.commit(batch, tables)

    def record_harness(self, batch: str, rows: DataFrame) -> DataFrame:
        """Append those of ``rows`` whose identity is new, in one commit; (id, outcome) of all: ``recorded``, ``duplicate`` or ``identity-conflict``.

        A batch that is committed already has nothing but duplicates and conflicts left.
        """
        known = rows.select("id", F.col("harness_name").alias("harness"), "session_id", "source_event_id", "event_digest")
        fated = cut(ledger.outcomes(known, self.read("receipts"), order=("id",)).select("id", "outcome"))
        self.append_harness(batch, rows.join(fated.where("outcome = 'recorded'").select("id"), "id", "left_semi"))
        return fated

    def _check_facets(self, facets: DataFrame) -> None:
        self._refuse(facets.where(~F.coalesce(slot_ok(F.col("slot"), F.col("text_value"), F.col("integer_value"), F.col("boolean_value")), F.lit(False))), "a facet's value has no slot")

    def _check_edges(self, rows: DataFrame) -> None:
        self._refuse(rows.where(~in_vocabulary("relation") | ~in_vocabulary("confidence")), "unknown relation or confidence")
        self._refuse(rows.where("from_key = to_key"), "an edge of a key to itself")

    def append_derivations(self, batch: str, rows: DataFrame, registered: DataFrame | None = None, evidence: DataFrame | None = None) -> bool:
        """Append derivations with the facet rows that their documents call for, and evidence links.

        Refused are records that break a rule of construction, that would close a cycle of supersession, or
        that carry a facet whose (namespace, name) isn't in ``registered``.
        """
        if self.committed(batch):
            return False
        self._refuse(refusals(rows), "a rule is broken")
        self._new_keys("derivations", rows)
        self._refuse(closes_cycle(self.read("derivations"), rows), "a cycle of supersession")
        facets = project_facets(rows)
        self._check_facets(facets)
        if registered is not None:
            self._refuse(facets.join(registered, ["namespace", "name"], "left_anti"), "a facet isn't registered")
        tables = {"derivations": rows, "derivation_facets": facets}
        if evidence is not None:
            self._refuse(evidence.where(~in_vocabulary("role")), "unknown role")
            self._new_keys("derivation_evidence", evidence)
            tables["derivation_evidence"] = evidence
        return self.commit(batch, tables)

    def append_relationships(self, batch: str, rows: DataFrame) -> bool:
        """Append edges; refused are unknown relations, edges of a key to itself, and ends that name nothing."""
        if self.committed(batch):
            return False
        self._check_edges(rows)
        self._new_keys("relationships", rows)
        self._refuse(dangling(rows, self.read("derivations"), self.read("observations")), "an end names nothing")
        return self.commit(batch, {"relationships": rows})
