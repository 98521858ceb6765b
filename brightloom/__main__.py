"""python -m brightloom pack TREE ROOT OUT: pack a module and all it refers to."""

from __future__ import annotations

import argparse
import json

from brightloom.operators.pack import pack
from brightloom.session import local


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="brightloom", description=__doc__)
    command = parser.add_subparsers(dest="command", required=True).add_parser("pack", help="pack a module tree recursively into one archive")
    command.add_argument("tree", help="folder of the module tree")
    command.add_argument("root", help="the module to pack, as a path in the tree ('.' for its top)")
    command.add_argument("out", help="archive to write")
    given = parser.parse_args(args)
    found = pack(local(), given.tree, given.root, given.out)
    print(json.dumps(found))
    return 1 if found["missing"] else 0


if __name__ == "__main__":
    raise SystemExit(main())
