"""Command line: options over a JSON configuration over defaults."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

DEFAULTS = {"path": ".", "ontology": "ontology/ontology.v1.yaml", "output": "artifacts", "allow_partial_success": False, "max_merge_entries_per_file": None}


def load_config(path: str | None) -> dict:
    """The configuration file's known keys; a missing file is an empty configuration."""
    if not path or not Path(path).exists():
        return {}
    return {k: v for k, v in json.loads(Path(path).read_text()).items() if k in DEFAULTS}


def options(argv: list[str]) -> dict:
    parser = argparse.ArgumentParser(prog="graphspark")
    verbs = parser.add_subparsers(dest="verb", required=True)
    ingest = verbs.add_parser("ingest")
    ingest.add_argument("-p", "--path")
    ingest.add_argument("-c", "--config")
    ingest.add_argument("-o", "--ontology")
    ingest.add_argument("-r", "--output")
    ingest.add_argument("-a", "--allow-partial-success", action="store_true", default=None)
    ingest.add_argument("-m", "--max-merge-entries-per-file", type=int)
    given = vars(parser.parse_args(argv))
    own = {k: v for k, v in given.items() if k in DEFAULTS and v is not None}
    return DEFAULTS | load_config(given["config"]) | own


def main(argv: list[str]) -> int:
    """Runs the verb in a Spark session and returns its exit code."""
    from pyspark.sql import SparkSession

    from .ingest import ingest

    return ingest(SparkSession.builder.appName("graphspark").getOrCreate(), options(argv)).exit_code


if __name__ == "__main__":
    import sys

    sys.exit(main(sys.argv[1:]))
