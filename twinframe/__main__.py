"""``python -m twinframe scan -d a,b,c -o out.csv [--log log.txt]``"""

from __future__ import annotations

import argparse
import logging
import sys
import time
from typing import TextIO

from pyspark.sql import SparkSession

from twinframe.operators.session import STEPS, Session, part

#: Signs of a bar, and the least seconds between two paintings.
BAR, SPINNER, EVERY = 20, "|/-\\", 0.125


def bar(done: float, turn: int) -> str:
    """``[#####---------------]  25% /``"""
    full = int(part(done) * BAR)
    return f"[{'#' * full}{'-' * (BAR - full)}] {int(part(done) * 100):3d}% {SPINNER[turn % len(SPINNER)]}"


class Meter:
    """Paints the progress of scans on one line."""

    def __init__(self, out: TextIO):
        self.out, self.turn, self.painted = out, 0, 0.0

    def __call__(self, step: str, done: float) -> None:
        logging.info("%s %.0f %%", step, 100 * part(done))
        now = time.monotonic()
        if now - self.painted >= EVERY or done >= 1:
            self.painted, self.turn = now, self.turn + 1
            whole = (STEPS.index(step) + part(done)) / len(STEPS)
            self.out.write("\r" + bar(whole, self.turn))
            self.out.flush()


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="twinframe")
    scan = parser.add_subparsers(dest="command", required=True).add_parser("scan", help="list directories and their duplicates")
    scan.add_argument("-d", "--directories", required=True, help="comma-separated; scanned one after another")
    scan.add_argument("-o", "--out", required=True, help="the listing to write")
    scan.add_argument("--log", default="log.txt", help="the log file")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, filename=args.log, format="%(asctime)s %(levelname)s %(message)s", force=True)
    session, meter = Session(SparkSession.builder.appName("twinframe").getOrCreate()), Meter(sys.stderr)
    for d in args.directories.split(","):
        session.scan(d, progress=meter)
    sys.stderr.write("\n")
    try:
        session.export_csv(args.out)
    except OSError as e:
        print(f"could not write {args.out}: {e}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
