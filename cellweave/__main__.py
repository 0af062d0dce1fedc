"""Command line: the workbook at a path as JSON, with what its format stores beside cells."""

from __future__ import annotations

import sys
from pathlib import Path


def main(args: list[str]) -> int:
    if len(args) != 1:
        print("Usage: python -m cellweave <path-to-file>")
        return 1
    if not Path(args[0]).is_file():
        print(f"Error: File not found: {args[0]}", file=sys.stderr)
        return 1
    from pyspark.sql import SparkSession

    from cellweave.operators.workbooks import file_lines, printed
    from cellweave.sources.reader import BINARY, TEXT, extension, file_errors

    ext = extension(args[0])
    if ext not in TEXT and ext not in BINARY:
        print(f"Error: Unsupported file type: {ext}", file=sys.stderr)
        return 1
    spark = SparkSession.builder.getOrCreate()
    files = spark.read.format("binaryFile").load(args[0])
    for wrong in file_errors(files).select("message").collect():  # of one file
        print(f"Error: {wrong['message']}", file=sys.stderr)
        return 1
    for piece in printed(file_lines(files, ext, **({"encoding": None} if ext in TEXT else {}))):
        sys.stdout.write(piece)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
