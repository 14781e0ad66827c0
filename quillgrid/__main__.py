"""``python -m quillgrid SCHEMA INPUT [OUTPUT]``: one document, or a folder of them.

``-`` is standard input, or output.  A file or standard input is judged at hand, in
chunks of ``BUFFER_SIZE`` bytes with ``--fast-fail``.  A folder is judged by Spark: the
captures of valid documents go to OUTPUT as JSON lines, the errors to OUTPUT-errors.
Exit code 0: all valid; 1: some error; 2: wrong use.
"""

from __future__ import annotations

import argparse
import codecs
import json
import os
import sys
from typing import BinaryIO

from quillgrid.streaming.session import Session


def judge(schema: str, source: BinaryIO, size: int, fast_fail: bool) -> Session:
    """Read to the end, or to the first certain error."""
    session, decode, text = Session(schema), codecs.getincrementaldecoder("utf-8")(), ""
    while chunk := source.read(size):
        text += decode.decode(chunk)
        if fast_fail and not session.read(text).validate().is_valid:
            return session
    return session.read(text + decode.decode(b"", True), end=True).validate()


def of_folder(schema: str, folder: str, output: str | None, quiet: bool) -> bool:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from quillgrid.operators import api
    from quillgrid.sources import files

    found = api.validate(files.read_documents(SparkSession.builder.appName("quillgrid").getOrCreate(), folder), schema)
    if output:
        files.write_matches(found, output, quiet)
        files.write_errors(found, f"{output}-errors", "path")
    bad = found.agg(F.count_if(~F.col("is_valid")).alias("n")).first()["n"]
    if not output and not quiet:
        print(f"{bad} documents with errors")
    return not bad


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillgrid", description=__doc__.split("\n")[0])
    parser.add_argument("schema")
    parser.add_argument("input", help="a file, a folder, or - for standard input")
    parser.add_argument("output", nargs="?", help="where captures go (default: standard output)")
    parser.add_argument("--fast-fail", action="store_true", help="stop at the first certain error")
    parser.add_argument("--quiet", action="store_true", help="print no captures")
    parser.add_argument("--raw-errors", action="store_true", help="errors as JSON, not in words")
    given = parser.parse_args(args)
    with open(given.schema, encoding="utf-8") as f:
        schema = f.read()
    if given.input != "-" and os.path.isdir(given.input):
        return int(not of_folder(schema, given.input, given.output, given.quiet))
    size = int(os.environ.get("BUFFER_SIZE", 2048))
    if given.input == "-":
        session = judge(schema, sys.stdin.buffer, size, given.fast_fail)
    else:
        with open(given.input, "rb") as f:
            session = judge(schema, f, size, given.fast_fail)
    if not session.is_valid:
        print("\n".join(json.dumps(e, ensure_ascii=False) for e in session.errors) if given.raw_errors else session.report(), file=sys.stderr)
        return 1
    if not given.quiet:
        if given.output in (None, "-"):
            print(session.json)
        else:
            with open(given.output, "w", encoding="utf-8") as f:
                f.write(session.json + "\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
