"""Command line: python -m lemmaweave FOLDER COMMAND [ARGUMENT...]; rows come as JSON lines."""

from __future__ import annotations

import argparse
import inspect

from pyspark.sql import DataFrame

from .api import Workspace
from .session import build_session

COMMANDS = sorted(n for n, f in inspect.getmembers(Workspace, inspect.isfunction) if not n.startswith("_") and n not in ("add_projects", "add_files", "add_package"))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lemmaweave", description=__doc__)
    parser.add_argument("folder")
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("arguments", nargs="*", help="in the order of the command's parameters; name=value for later ones")
    given = parser.parse_args(argv)
    named = dict(a.split("=", 1) for a in given.arguments if "=" in a)
    spark = build_session("lemmaweave", None, **{"spark.ui.showConsoleProgress": "false"})
    call = getattr(Workspace(spark, given.folder), given.command)
    kinds = inspect.signature(call).parameters
    as_type = lambda name, v: int(v) if "int" in str(kinds[name].annotation) else v == "true" if "bool" in str(kinds[name].annotation) else v
    plain = [as_type(n, v) for n, v in zip(kinds, (a for a in given.arguments if "=" not in a), strict=False)]
    out = call(*plain, **{k: as_type(k, v) for k, v in named.items()})
    if isinstance(out, DataFrame):
        for line in out.toJSON().toLocalIterator():
            print(line)
    elif out is not None:
        print(out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
