"""spark-submit entry points (ML8, ML6, RA4) - thin argument parsing
around the jobs in ``riskframe.plans.presets``.

    spark-submit -m riskframe.cli train --mode advanced --raw clinical.csv --out models/advanced
    spark-submit -m riskframe.cli infer --mode advanced --raw new.csv --model models/advanced --out p.parquet
    spark-submit -m riskframe.cli infer --mode basic --features f.parquet --model models/basic --out p.parquet
    spark-submit -m riskframe.cli index --corpus kb/ --out index.parquet
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="riskframe")
    sub = ap.add_subparsers(dest="cmd", required=True)
    t = sub.add_parser("train")
    t.add_argument("--mode", required=True, choices=["basic", "advanced"])
    t.add_argument("--raw", required=True, help="raw table (csv with header, or parquet)")
    t.add_argument("--out", required=True)
    t.add_argument("--env", default="local", choices=["local", "prod"])
    i = sub.add_parser("infer")
    i.add_argument("--mode", required=True, choices=["basic", "advanced"])
    given = i.add_mutually_exclusive_group(required=True)
    given.add_argument("--features", help="stored feature table")
    given.add_argument("--raw", help="raw table (csv with header, or parquet)")
    i.add_argument("--model", required=True)
    i.add_argument("--out", required=True)
    x = sub.add_parser("index")
    x.add_argument("--corpus", required=True)
    x.add_argument("--out", required=True)
    args = ap.parse_args(argv)

    from .plans import presets as P
    from .sources import io as IO

    spark = SparkSession.builder.appName(f"riskframe-{args.cmd}").getOrCreate()
    if args.cmd == "train":
        raw, _ = IO.read_raw(spark, args.raw, args.mode, P.preset(args.mode).key)
        metrics = P.train_job(spark, args.mode, raw, args.out, args.env).first().asDict()
        print(json.dumps(metrics))
    elif args.cmd == "infer" and args.raw:
        raw, _ = IO.read_raw(spark, args.raw, args.mode, P.preset(args.mode).key)
        P.raw_inference_job(spark, args.mode, raw, args.model, args.out)
    elif args.cmd == "infer":
        P.inference_job(spark, args.mode, args.features, args.model, args.out)
    else:
        print(json.dumps({"chunks": P.index_job(spark, args.corpus, args.out)}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
