"""A small shell: python -m lodestone.cli ROOT [GRAPH]. Statements end with a semicolon; commands start with a colon."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from lodestone.errors import GraphError
from lodestone.sources.catalog import GraphCatalog
from lodestone.sources.sinks import text_table


class Shell:
    def __init__(self, catalog: GraphCatalog, name: str = "default"):
        self.catalog, self.name, self.session = catalog, name, catalog.open(name)

    def command(self, line: str) -> str | None:
        """What a line starting with a colon says; None ends the shell."""
        word, *args = line.split()
        if word == ":quit":
            self.session.close()
            return None
        if word == ":graphs":
            return "\n".join(self.catalog.list())
        if word == ":create" and args:
            self.catalog.create(args[0])
            return f"created {args[0]}"
        if word == ":use" and args:
            self.session.close()
            self.name, self.session = args[0], self.catalog.open(args[0])
            return f"using {args[0]}"
        if word == ":drop" and args:
            if args[0] == self.name:
                raise GraphError("the graph is in use")
            self.catalog.drop(args[0])
            return f"dropped {args[0]}"
        if word == ":checkpoint":
            self.session.publish()
            return "saved"
        if word == ":locations":
            return "\n".join(self.catalog.list_locations())
        if word == ":add-location" and args:
            self.catalog.add_location(args[0])
            return "added"
        if word == ":remove-location" and args:
            self.catalog.remove_location(args[0])
            return "removed"
        raise GraphError(f"unknown command {word}")

    def run(self, text: str) -> str | None:
        return self.command(text.strip()) if text.strip().startswith(":") else text_table(self.session.query(text))


def main() -> None:
    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    shell, held = Shell(GraphCatalog(spark, sys.argv[1]), *sys.argv[2:3]), ""
    for line in sys.stdin:
        held += line
        if not held.strip() or not (held.strip().startswith(":") or held.rstrip().endswith(";")):
            continue
        try:
            said = shell.run(held)
            if said is None:
                return
            print(said)
        except GraphError as e:
            print(f"error: {e}")
        held = ""


if __name__ == "__main__":
    main()
