"""A line shell: statements end at a semicolon outside quotes; lines with a leading dot are commands."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable

from orrery.database import Database
from orrery.status import Result

FIRST, MORE = "orrery> ", "   ...> "
HELP = """.help            this text
.tables          the tables
.schema TABLE    a table's columns (also .d TABLE)
.clear           clear the screen
.quit            leave
Anything else is SQL and runs at its semicolon."""


def complete(text: str) -> bool:
    """Whether text ends a statement: a semicolon outside quotes is there."""
    quote, k = "", 0
    while k < len(text):
        c = text[k]
        if quote:
            if c == "\\":
                k += 1
            elif c == quote:
                quote = ""
        elif c in "'\"":
            quote = c
        elif c == ";":
            return True
        k += 1
    return False


def table(result: Result) -> str:
    cells = [["NULL" if v is None else str(v) for v in row] for row in result.rows]
    widths = [max(map(len, [name, *(row[k] for row in cells)])) for k, name in enumerate(result.columns)]
    rule = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    line = lambda row: "|" + "|".join(f" {v:<{w}} " for v, w in zip(row, widths, strict=True)) + "|"
    return "\n".join([rule, line(result.columns), rule, *map(line, cells), rule, f"{len(cells)} row{'s' * (len(cells) != 1)}"])


def shown(result: Result) -> str:
    if not result.ok:
        return f"Error: {result.code.value}: {result.message}"
    return table(result) if result.columns else f"OK, {result.affected} row{'s' * (result.affected != 1)} affected"


def run(db: Database, lines: Iterable[str], out: Callable[[str], object] = print, prompt: Callable[[str], object] = lambda text: None) -> None:
    """Run statements and commands. Before each line prompt is called: with FIRST, or with MORE while a statement is open."""
    held, source = "", iter(lines)
    while True:
        prompt(MORE if held else FIRST)
        line = next(source, None)
        if line is None:
            return
        word, _, rest = line.strip().partition(" ")
        if not held and word.startswith("."):
            if word == ".quit":
                return
            if word == ".tables":
                out("\n".join(db.table_names()) or "no tables")
            elif word in (".schema", ".d"):
                columns = db.columns(rest.strip().rstrip(";"))
                out("\n".join(f"{c.name} {c.sql_type}{f'({c.length})' if c.length else ''}" for c in columns) or f"no table {rest.strip()}")
            elif word == ".clear":
                out("\033[2J\033[H")
            else:
                out(HELP if word == ".help" else f"unknown command {word}")
            continue
        held += line if line.endswith("\n") else line + "\n"
        if complete(held):
            out(shown(db.execute(held)))
            held = ""


def main() -> None:
    with Database(sys.argv[1] if len(sys.argv) > 1 else "database") as db:
        run(db, sys.stdin, prompt=lambda text: print(text, end="", flush=True) if sys.stdin.isatty() else None)


if __name__ == "__main__":
    main()
