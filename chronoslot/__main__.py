"""Command line over trace files: ``python -m chronoslot TOOL PATH [NAME=VALUE ...] [--json]``."""

from __future__ import annotations

import json
import os
import sys
from pathlib import Path

ROWS = 200


def show(rows: list[dict]) -> str:
    """Aligned text; about ROWS rows of a longer table and its last."""
    if not rows:
        return "no rows"
    step = max(1, len(rows) // ROWS)
    shown = [r for i, r in enumerate(rows) if i % step == 0 or i == len(rows) - 1]
    names = list(dict.fromkeys(k for r in shown for k in r))
    cells = [names, *[["" if r.get(n) is None else str(r[n]) for n in names] for r in shown]]
    widths = [max(len(c[i]) for c in cells) for i in range(len(names))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(c, widths, strict=True)).rstrip() for c in cells)


def main(argv: list[str]) -> int:
    from .plans.service import TOOLS, Service

    as_json, args = "--json" in argv, [a for a in argv if a != "--json"]
    if args[:1] != ["serve"] and (len(args) < 2 or args[0] not in TOOLS):
        print(__doc__, *(f"  {n}: {d} {', '.join(p)}" for n, (d, p, _) in TOOLS.items()), "  serve: JSON-RPC over standard input and output", sep="\n", file=sys.stderr)
        return 2
    os.environ["PYTHONPATH"] = os.pathsep.join([str(Path(__file__).resolve().parent.parent), os.environ.get("PYTHONPATH", "")])
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    service = Service(spark)
    if args[0] == "serve":
        service.serve()
        return 0
    try:
        rows = service.call(args[0], {"path": args[1]} | dict(a.split("=", 1) for a in args[2:]))
    except (LookupError, ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    print(json.dumps(rows) if as_json else show(rows))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
