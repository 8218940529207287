"""python tools/verify.py FOLDER: the evidence made again from the tables alone.

Chains, sums, claims and the thirteen checks are recomputed and shown; the
table that is printed is read back and compared with what was found. Exits 1
if that differs, or a check that the tables should pass is named behind the
folder and doesn't pass.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

from millrace.plans import catalog  # noqa: E402
from millrace.session import local_session  # noqa: E402


def markdown(rows: list[dict]) -> str:
    """The rows as a table, columns by name."""
    names = sorted(rows[0]) if rows else []
    lines = ["| " + " | ".join(names) + " |", "|" + "-|" * len(names)] if rows else []
    return "\n".join([*lines, *("| " + " | ".join(str(r[n]).replace("|", "\\|") for n in names) + " |" for r in rows)])


def agrees(table: str, rows: list[dict]) -> bool:
    """Whether a table says what the rows say, row by row."""
    return table.splitlines()[2:] == markdown(rows).splitlines()[2:]


def main(folder: str, wanted: list[str]) -> int:
    spark = local_session(os.cpu_count() or 1)
    failed = []
    for name in ("chain_verify", "evidence_verify", "replay_derivations", "evidence"):
        rows = [r.asDict() for r in catalog.QUERIES[name](spark, folder).collect()]
        table = markdown(rows)
        print(f"## {name}\n\n{table}\n")
        if not agrees(table, rows):
            failed.append(name)
        if name == "evidence":
            passed = {r["check"] for r in rows if r["passed"]}
            failed += [w for w in wanted if w not in passed]
    print("failed:", ", ".join(failed) or "nothing")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
