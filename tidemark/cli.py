"""python -m tidemark.cli scan|profile|draft|validate|search|plan ...: thin commands over the library."""

from __future__ import annotations

import argparse
import json
import sys

from .operators import draft, packs, planner, profile
from .service import search, validate_pack
from .session import local_session
from .sources import files


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidemark")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("scan", "profile", "draft"):
        commands.add_parser(name).add_argument("folder")
    commands.add_parser("validate").add_argument("pack")
    for name in ("search", "plan"):
        c = commands.add_parser(name)
        c.add_argument("pack")
        c.add_argument("question")
    args = parser.parse_args(argv)
    if args.command == "plan":
        print(json.dumps(planner.plan([packs.load(args.pack)], args.question).to_dict(), ensure_ascii=False, indent=1))
        return 0
    spark = local_session()
    if args.command in ("validate", "search"):
        pack = packs.load(args.pack)
        out = validate_pack(spark, pack) if args.command == "validate" else search(spark, [pack], args.question)
        print(json.dumps(out, ensure_ascii=False, indent=1))
        return int(args.command == "validate" and any(f["severity"] == "error" for f in out))
    found, skipped = files.scan(spark, args.folder)
    if args.command == "scan":
        print(json.dumps({"tables": [{"table": d.table, "kind": d.kind, "columns": d.frame.columns} for d in found], "skipped": skipped}, indent=1))
        return 0
    profiles = profile.profile_tables({d.table: d.frame for d in found})
    if args.command == "profile":
        for row in profiles.toJSON().toLocalIterator():
            print(row)
    else:
        print(json.dumps(draft.draft_pack(profiles, "pack.draft").to_dict(), ensure_ascii=False, indent=1))
    return 0


if __name__ == "__main__":
    sys.exit(main())
