"""python -m tessel info|verify|compact|vacuum PATH: look after a versioned database."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .operators import dml
from .sources.database import Database


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    parser = argparse.ArgumentParser(prog="tessel", description=__doc__)
    parser.add_argument("action", choices=("info", "verify", "compact", "vacuum"))
    parser.add_argument("path")
    parser.add_argument("--retain", type=int, default=1, help="versions that vacuum keeps")
    parser.add_argument("--min-age", type=float, default=3600.0, help="seconds that vacuum spares young folders for")
    asked = parser.parse_args(args)
    spark = spark or SparkSession.builder.getOrCreate()
    db = Database(spark, asked.path, "read_only" if asked.action in ("info", "verify") else "open_existing")
    out: dict = {"version": db.version}
    if asked.action == "info":
        out |= {"tables": {n: db.stats(n)["rows"] for n in db.tables()}, "views": sorted(db.manifest["views"]), "versions": db.versions}
    elif asked.action == "verify":
        faults = {}
        for name in db.tables():
            meta = db.manifest["tables"][name]
            try:
                dml.check_constraints(db.table(name), [*meta["not_null"], *meta["primary_key"]], [x for x in (meta["primary_key"], *meta["unique"]) if x])
            except dml.ConstraintError as error:
                faults[name] = str(error)
        out["faults"] = faults
    elif asked.action == "compact":
        for name in db.tables():
            db.compact(name)
        out["version"] = db.version
    else:
        out["deleted"] = db.vacuum(asked.retain, asked.min_age)
    return out


if __name__ == "__main__":
    print(json.dumps(main()))
