"""python -m rowloom: the model of a declaration file as text, printed, written or compared."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from rowloom.plans.errors import SchemaError
from rowloom.plans.files import load
from rowloom.plans.registry import DECLARATIONS, schema


def main(arguments: list[str] | None = None) -> int:
    """0; 1 if --check finds another text, 2 if the declaration is wrong or a file is missing."""
    p = argparse.ArgumentParser(prog="rowloom", description=main.__doc__)
    what = p.add_mutually_exclusive_group()
    what.add_argument("--inspect", action="store_true", help="print the model (as without any of these)")
    what.add_argument("--write", action="store_true", help="write it to --out, if that has another text")
    what.add_argument("--check", action="store_true", help="compare it with --out")
    p.add_argument("--schema", required=True, help=f"a declaration file, or one of {', '.join(DECLARATIONS)}")
    p.add_argument("--proto-root", help="folder that paths count from")
    p.add_argument("--dictionary-source", action="append", default=[], help="a file with dictionaries; may be repeated")
    p.add_argument("--root", help="the payload's root message")
    p.add_argument("--module", help="the schema's module, if it is not the file's name")
    p.add_argument("--out", help="the file to write or to compare with")
    a = p.parse_args(arguments)
    if (a.write or a.check) and not a.out:
        p.error("--write and --check need --out")
    try:
        found = schema(a.schema) if a.schema in DECLARATIONS else load(a.schema, a.module, a.root, a.dictionary_source, a.proto_root)
    except (SchemaError, OSError) as e:
        print(e, file=sys.stderr)
        return 2
    text = found.describe()
    if not (a.write or a.check):
        print(text, end="")
        return 0
    out = Path(a.out)
    same = out.exists() and out.read_text(encoding="utf-8") == text
    if a.check and not same:
        print(f"{out} differs", file=sys.stderr)
        return 1
    if a.write and not same:
        out.write_text(text, encoding="utf-8")
    return 0


if __name__ == "__main__":
    sys.exit(main())
