"""External parsers: one process for each document, with a time limit; its output is parsed as JSON by a schema."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_command(files: DataFrame, argv: list[str], timeout_s: float = 600.0) -> DataFrame:
    """path, output, error of every file: its bytes are the process's input. Neither a failure nor a timeout stops the others.

    error holds the exit code and the last of stderr, or says that time ran out; output is null then. Processes run on executors,
    one at a time in each task, so a batch is never more than its documents.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    done = subprocess.run(argv, input=content, capture_output=True, timeout=timeout_s, check=False)
                    failed = done.returncode != 0
                    rows.append((path, None if failed else done.stdout.decode("utf-8", "replace"), f"exit {done.returncode}: {done.stderr.decode('utf-8', 'replace')[-2000:]}" if failed else None))
                except subprocess.TimeoutExpired:
                    rows.append((path, None, f"timeout after {timeout_s:g} s"))
                except OSError as e:
                    rows.append((path, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "output", "error"])

    return files.select("path", "content").mapInPandas(work, "path string, output string, error string")


def parsed(outputs: DataFrame, schema: str) -> DataFrame:
    """The output as a struct of the schema, with an error where it is no such JSON."""
    value = F.from_json("output", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    bad = F.col("output").isNotNull() & F.try_parse_json("output").isNull()
    return outputs.select("path", F.when(~bad, value).alias("value"), F.coalesce("error", F.when(bad, F.lit("output is no JSON"))).alias("error"))
