"""python -m dovetail --csv FILE --resumes FOLDER [-o FILE] [--config FILE] [--stdout] [-v]"""

from __future__ import annotations

import argparse
import logging
import os
import sys

from dovetail.plans import pipeline

log = logging.getLogger("dovetail")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="dovetail", description="Integrate a recruiter table and resumes into profiles.")
    p.add_argument("--csv", required=True)
    p.add_argument("--resumes", required=True)
    p.add_argument("-o", "--output")
    p.add_argument("--output-dir", help="one JSON document a line, written by the executors")
    p.add_argument("--config")
    p.add_argument("--stdout", action="store_true")
    p.add_argument("-v", "--verbose", action="store_true")
    a = p.parse_args(argv)
    logging.basicConfig(stream=sys.stderr, level=logging.DEBUG if a.verbose else logging.INFO, format="%(levelname)s %(message)s")
    for path in (a.csv, a.resumes, *([a.config] if a.config else [])):
        if "://" not in path and not os.path.exists(path):
            log.error("not found: %s", path)
            return 1
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("dovetail").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        config = open(a.config, encoding="utf-8").read() if a.config else None
        found = pipeline.run(spark, a.csv, a.resumes, config)
        for r in found["warnings"].toLocalIterator():
            log.warning("%s: %s", r["source_id"], r["warning"])
        if a.output_dir:
            found["output"].select("output").write.text(a.output_dir)
            return 0
        whole = pipeline.write_json(found["output"], a.output)
        if a.stdout or not a.output:
            print(whole)
        if whole == "[]":
            log.warning("no profiles in the output")
    except Exception:
        log.exception("the pipeline failed")
        return 1
    return 0
