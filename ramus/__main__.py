"""Command line of a store: python -m ramus ROOT COMMAND ...; rows are printed as JSON lines."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ramus.operators.store import POLICIES, BranchStore
from ramus.plans.catalog import BranchError
from ramus.plans.sqlfront import UnsupportedSQLError

WRITES = ("insert", "update", "delete", "create", "drop", "alter")


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="ramus", description=__doc__)
    top.add_argument("root", help="folder of the store, created if it is not there")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *positional: str):
        one = commands.add_parser(name)
        for p in positional:
            one.add_argument(p)
        return one

    adopt = command("adopt", "table", "path")
    adopt.add_argument("--key", action="append", required=True, help="a column of the primary key; may be given again")
    adopt.add_argument("--copy", action="store_true", help="copy the rows instead of reading the files where they lie")
    command("tables").add_argument("--branch", default="main")
    command("branches")
    command("checkpoints")
    fork = command("fork", "name")
    origin = fork.add_mutually_exclusive_group()
    origin.add_argument("--branch", default="main")
    origin.add_argument("--checkpoint")
    command("checkpoint", "name").add_argument("--branch", default="main")
    command("delete", "name")
    sql = command("sql", "statement")
    at = sql.add_mutually_exclusive_group()
    at.add_argument("--branch", default="main")
    at.add_argument("--checkpoint")
    diff = command("diff", "left", "right")
    diff.add_argument("--table", help="one table instead of all")
    for name in ("preview", "merge"):
        merge = command(name, "source", "target")
        merge.add_argument("--table", action="append", help="one table instead of all; may be given again")
    merge.add_argument("--policy", choices=[p for p in POLICIES if p not in ("manual_review", "custom")], default="abort_on_conflict")
    command("compact", "table")
    command("vacuum")
    return top


def run(spark: SparkSession, a: argparse.Namespace) -> DataFrame | dict:
    """Rows, or a small answer, of one command."""
    store = BranchStore(spark, a.root)
    if a.command == "adopt":
        if a.copy:
            store.register_table(a.table, spark.read.parquet(a.path), a.key)
        else:
            store.adopt(a.table, a.path, a.key)
        return {"table": a.table}
    if a.command == "tables":
        return {"tables": sorted(store.catalog.visible_tables(store.catalog.head(a.branch).point))}
    if a.command == "branches":
        return store.list_branches()
    if a.command == "checkpoints":
        return store.list_checkpoints()
    if a.command == "fork":
        b = store.create_branch_from_checkpoint(a.name, a.checkpoint) if a.checkpoint else store.create_branch(a.name, a.branch)
        return {"branch": b.id, "parent": b.parent}
    if a.command == "checkpoint":
        c = store.create_checkpoint(a.name, a.branch)
        return {"checkpoint": c.id, "branch": c.branch}
    if a.command == "delete":
        return {"deleted": store.delete_branch(a.name)}
    if a.command == "sql":
        session = store.checkout_checkpoint(a.checkpoint) if a.checkpoint else store.checkout(a.branch)
        if a.statement.split(None, 1)[0].lower() in WRITES:
            return {"rows": session.execute(a.statement)}
        return session.query(a.statement)
    if a.command == "diff":
        return store.diff(a.left, a.right, a.table) if a.table else store.diff_all(a.left, a.right)
    if a.command == "preview":
        p = store.merge_preview(a.source, a.target, a.table)
        names = ["table", "key", "change", "before", "after", "change_id"]
        return p.changes().selectExpr("'clean' AS outcome", *names).unionByName(p.conflicts().selectExpr("'conflict' AS outcome", *names))
    if a.command == "merge":
        return {"applied": store.merge(a.source, a.target, a.policy, a.table)}
    if a.command == "compact":
        store.compact(a.table)
        return {"compacted": a.table}
    return {"deleted": store.vacuum()}


def main(argv: list[str] | None = None, out=None) -> int:
    a, out = arguments().parse_args(argv), out or sys.stdout
    try:
        got = run(SparkSession.builder.appName("ramus").getOrCreate(), a)
        # rows come one partition at a time; the driver never holds them all
        lines = [json.dumps(got)] if isinstance(got, dict) else (r.value for r in got.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).toLocalIterator())
        for line in lines:
            print(line, file=out)
    except (BranchError, UnsupportedSQLError, KeyError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
