"""The commands: init, note, observation list, ingest. The ledger and the inbox lie in ``.tracewell`` of the repository around the current folder."""

from __future__ import annotations

import argparse
import sys
from datetime import datetime, timezone
from pathlib import Path
from typing import TextIO

from pyspark.sql import SparkSession

from tracewell.functions.fixed import DEFAULT_LIST_LIMIT, MAX_LIST_LIMIT
from tracewell.session import local_session
from tracewell.sources import render
from tracewell.sources.inbox import FileInbox, InboxError
from tracewell.sources.store import Store, StoreError
from tracewell.streaming.ingest import ingest_inbox

HOME = ".tracewell"


def _limit(text: str) -> int:
    value = int(text)
    if not 0 < value <= MAX_LIST_LIMIT:
        raise argparse.ArgumentTypeError(f"from 1 to {MAX_LIST_LIMIT}")
    return value


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tracewell", description="An evidence ledger.")
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("init", help="make the ledger of this repository")
    note = commands.add_parser("note", help="record a manual intervention")
    note.add_argument("--summary", required=True)
    listing = commands.add_parser("observation", help="inspect observations").add_subparsers(dest="what", required=True).add_parser("list", help="newest first")
    listing.add_argument("--limit", type=_limit, default=DEFAULT_LIST_LIMIT)
    listing.add_argument("--json", action="store_true")
    commands.add_parser("ingest", help="load the files of the inbox").add_argument("--json", action="store_true")
    return top


def run(argv: list[str], spark: SparkSession, here: str | Path = ".", out: TextIO = sys.stdout) -> None:
    """One command; what is refused is raised as ValueError or InboxError."""
    told = parser().parse_args(argv)
    root = render.repository_root(here)
    if root is None:
        raise StoreError("not inside a repository")
    store = Store(spark, str(root / HOME / "store"))
    now = datetime.now(timezone.utc).isoformat()
    if told.command == "init":
        store.initialize()
        out.write(f"Initialized {root / HOME}\n")
        return
    store.open()
    if told.command == "note":
        row = render.note(spark, told.summary, str(root), now)
        (ident,) = row.select("id").collect()
        store.append_observations(f"note-{ident.id}", row)
        out.write(f"Recorded {ident.id}\n")
    elif told.command == "observation":
        rows = store.read("observations")
        out.write(render.listing_json(rows, told.limit) if told.json else render.listing(rows, told.limit))
    else:
        with FileInbox(root / HOME / "state") as inbox:
            summary = ingest_inbox(store, inbox, now)
        out.write(render.summary_json(summary) if told.json else render.summary_text(summary))


def main() -> int:
    try:
        run(sys.argv[1:], local_session())
    except (ValueError, InboxError) as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
