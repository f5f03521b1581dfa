"""``python -m tickweave diagnose ...``"""

import sys

from pyspark.sql import SparkSession

from tickweave.plans.diagnose import main

if sys.argv[1:2] != ["diagnose"]:
    sys.exit("usage: python -m tickweave diagnose --root R --date YYYYMMDD --product P")
session = SparkSession.builder.appName("tickweave").config("spark.sql.session.timeZone", "UTC").getOrCreate()
sys.exit(main(session, sys.argv[2:]))
