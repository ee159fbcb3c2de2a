"""Command line: ``python -m assaykit {profile,quality,score,store,etl} --source DATA --output PLACE``."""

from __future__ import annotations

import argparse
import sys

from assaykit.config import Settings
from assaykit.plans import jobs
from assaykit.session import get_spark
from assaykit.sources.store import HistoryStore


def main(argv: list[str] | None = None) -> int:
    settings = Settings.from_env()
    parser = argparse.ArgumentParser(prog="assaykit")
    parser.add_argument("job", choices=["profile", "quality", "score", "store", "etl"])
    parser.add_argument("--source", default=settings.raw_data_path, help="CSV file, folder or pattern")
    parser.add_argument("--output", help="report path, or store root for store and etl")
    parser.add_argument("--row-key", choices=["exact", "row", "digest"], help="how repeated rows are found; each job has its own default")
    args = parser.parse_args(argv)
    spark = get_spark(f"assaykit-{args.job}")
    how = {"row_key": args.row_key} if args.row_key else {}
    root = args.output or f"{settings.reports_path}/store"
    try:
        if args.job == "etl":
            outcome = jobs.run_etl(spark, args.source, root, settings=settings, **how)
            print(outcome)
            return 0 if outcome.status == "SUCCESS" else 1
        if args.job == "store":
            saved = jobs.store_job(spark, args.source, HistoryStore(spark, root), settings=settings, **how)
            saved.show(truncate=False)
            return 0
        run = {"profile": jobs.profile_job, "quality": jobs.validate_job, "score": jobs.score_job}[args.job]
        print(run(spark, args.source, args.output, settings=settings, **how))
        return 0
    except (FileNotFoundError, ValueError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    raise SystemExit(main())
