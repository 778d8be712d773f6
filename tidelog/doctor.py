"""Health of a store: python -m tidelog.doctor PATH [--schema]."""

from __future__ import annotations

import json
import sys

from .functions.schemas import KEYS, TABLES


def schema() -> dict:
    """Key and columns of each table."""
    return {t: {"key": KEYS[t], "columns": {f.name: f.dataType.simpleString() for f in s}} for t, s in TABLES.items()}


def main(args: list[str]) -> int:
    if "--schema" in args:
        print(json.dumps(schema(), indent=1))
        return 0
    if not args:
        print(__doc__)
        return 2
    from pyspark.sql import SparkSession

    from .sources.store import Store

    try:
        print(json.dumps(Store(SparkSession.builder.appName("tidelog").getOrCreate(), args[0]).status(), indent=1))
    except Exception as e:  # noqa: BLE001
        print(json.dumps({"error": str(e)}))
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
