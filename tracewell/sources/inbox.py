"""A file inbox: producers rename files in, one consumer claims, loads or quarantines them.

Three folders of plain files under one state folder: ``inbox`` (ready), ``processing`` (claimed) and
``quarantine`` (refused, each with a ``.reason`` beside it). Names have a grammar, files a mode; a second
consumer is refused by a lock. Files are listed by the driver, at most as many as one run may take, and
their contents are read and judged by Spark.
"""

from __future__ import annotations

import fcntl
import os
import re
import secrets
import stat
import time
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.fixed import MAX_INBOX_ENTRIES, REASONS
from tracewell.functions.ids import ALPHABET

_ULID = "[0-7][0-9A-HJKMNP-TV-Z]{25}"
READY = r"^[A-Za-z0-9][A-Za-z0-9._-]*\.json$"
TEMPORARY = r"^[A-Za-z0-9._-]+\.tmp$"
CLAIMED = rf"^{_ULID}\.json$"
REASON = rf"^{_ULID}\.reason$"
STAGED = rf"^{_ULID}\.reason\.(tmp|stage\.{_ULID})$"
MAX_NAME_BYTES, MAX_REASON_BYTES, CLAIM_RETRIES = 128, 64, 16


class InboxError(RuntimeError):
    """A state that is refused."""


def is_ready_name(name: Column) -> Column:
    return name.rlike(READY) & F.octet_length(name).between(6, MAX_NAME_BYTES)


def is_temporary_name(name: Column) -> Column:
    return name.rlike(TEMPORARY) & F.octet_length(name).between(5, MAX_NAME_BYTES)


def is_claimed_name(name: Column) -> Column:
    return name.rlike(CLAIMED)


def is_reason_name(name: Column) -> Column:
    return name.rlike(REASON)


def _mint() -> str:
    value, out = (int(time.time() * 1000) << 80) | secrets.randbits(80), ""
    for _ in range(26):
        value, digit = divmod(value, 32)
        out = ALPHABET[digit] + out
    return out


class FileInbox:
    """An inbox that this process holds; use as a context manager."""

    def __init__(self, state: str | Path):
        self.state = Path(state)
        self.inbox, self.processing, self.quarantine = (self.state / d for d in ("inbox", "processing", "quarantine"))
        for folder in (self.state, self.inbox, self.processing, self.quarantine):
            folder.mkdir(mode=0o700, parents=True, exist_ok=True)
            os.chmod(folder, 0o700)
        self._lock = open(self.state / "lock", "w")
        try:
            fcntl.flock(self._lock, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError as e:
            self._lock.close()
            raise InboxError("already running") from e
        self.repair()

    def __enter__(self) -> FileInbox:
        return self

    def __exit__(self, *_: object) -> None:
        self._lock.close()

    def inventory(self) -> list[dict]:
        """Every entry with its metadata; an unsafe one, or more than allowed, is an error."""
        out = []
        for folder in (self.inbox, self.processing, self.quarantine):
            for entry in os.scandir(folder):
                s = entry.stat(follow_symlinks=False)
                out.append({"dir": folder.name, "name": entry.name, "mode": stat.S_IMODE(s.st_mode), "uid": s.st_uid, "nlink": s.st_nlink, "regular": stat.S_ISREG(s.st_mode)})
        if len(out) > MAX_INBOX_ENTRIES:
            raise InboxError("too many entries")
        for e in out:
            fits = {"inbox": (READY, TEMPORARY), "processing": (CLAIMED,), "quarantine": (CLAIMED, REASON, STAGED)}[e["dir"]]
            named = any(re.fullmatch(p.strip("^$"), e["name"]) for p in fits) and len(e["name"]) <= MAX_NAME_BYTES
            if not (named and e["regular"] and e["nlink"] == 1 and e["uid"] == os.getuid() and e["mode"] == 0o600):
                raise InboxError(f"unsafe entry in {e['dir']}")
        return out

    def repair(self) -> None:
        """Finish what a dead run left: drop staged reasons, give claims in quarantine without a reason one, refuse what fits nothing."""
        entries = {e["name"] for e in self.inventory() if e["dir"] == "quarantine"}
        for name in {n for n in entries if re.fullmatch(STAGED.strip("^$"), n)}:
            os.unlink(self.quarantine / name)
            entries.discard(name)
        for name in {n for n in entries if n.endswith(".reason")}:
            text = (self.quarantine / name).read_text()
            if len(text.encode()) > MAX_REASON_BYTES or text not in REASONS:
                raise InboxError("unknown reason")
            if name.replace(".reason", ".json") not in entries:
                if not (self.processing / name.replace(".reason", ".json")).exists():
                    raise InboxError("a reason without a file")
                os.rename(self.processing / name.replace(".reason", ".json"), self.quarantine / name.replace(".reason", ".json"))
                entries.add(name.replace(".reason", ".json"))
        for name in {n for n in entries if n.endswith(".json") and n.replace(".json", ".reason") not in entries}:
            self._write_reason(name[: -len(".json")], "incomplete-quarantine")

    def claims(self) -> Iterator[Path]:
        """Claim what is here now, once: recovered files first, then ready ones, each by name."""
        recovered = sorted(p for p in self.processing.iterdir())
        ready = sorted(p.name for p in self.inbox.iterdir() if re.fullmatch(READY.strip("^$"), p.name))
        yield from recovered
        for name in ready:
            for _ in range(CLAIM_RETRIES):
                target = self.processing / f"{_mint()}.json"
                try:
                    os.link(self.inbox / name, target)  # fails where the name is taken
                except FileExistsError:
                    continue
                os.unlink(self.inbox / name)
                yield target
                break
            else:
                raise InboxError("no free name for a claim")

    def complete(self, claim: Path) -> None:
        os.unlink(claim)

    def _write_reason(self, ident: str, reason: str) -> None:
        stage = self.quarantine / f"{ident}.reason.tmp"
        fd = os.open(stage, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600)
        with os.fdopen(fd, "w") as out:
            out.write(reason)
        os.link(stage, self.quarantine / f"{ident}.reason")
        os.unlink(stage)

    def refuse(self, claim: Path, reason: str) -> None:
        """Move a claim to quarantine, bytes unchanged, its reason written first."""
        if reason not in REASONS:
            raise InboxError("unknown reason")
        self._write_reason(claim.stem, reason)
        os.rename(claim, self.quarantine / claim.name)


def read_files(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Ready files under ``path`` as (raw_id, file_name, body): whole, as UTF-8; a file that isn't UTF-8 has a body that no JSON reader takes.

    ``raw_id`` is a hash of the name, so the same file has the same id in every run. Spark's reader passes empty files
    over, so they don't come out; ``streaming.ingest.ingest_inbox`` takes them from its list of claims.
    """
    columns = "path string, modificationTime timestamp, length long, content binary"
    reader = (spark.readStream if stream else spark.read).schema(columns).format("binaryFile").option("pathGlobFilter", "*.json")
    files = reader.load(path)
    name = F.element_at(F.split("path", "/"), -1)
    body = F.when(F.expr("is_valid_utf8(content)"), F.col("content").cast("string")).otherwise(F.lit("�"))
    return files.where(is_ready_name(name)).select(F.xxhash64(name).alias("raw_id"), name.alias("file_name"), body.alias("body"))
