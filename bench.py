"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

"""

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from spanloom import queries as engine

#: Untimed first, so that the JVM has compiled the common code.
WARM = "token_spans"
HEADLINE = ["token_counts_by_type_lang", "predicates", "seq_two", "opt_middle", "repeat_title", "repeat_bounded_2_3", "find_first", "match_whole", "gaz_exact_spans", "findall_chart", "fact_contact", "fact_nested_struct", "lex_normalized", "rel_number_pairs"]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "4")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name: engine.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    run(WARM)
    took = {}
    for name in HEADLINE:
        began = time.time()
        run(name)
        took[name] = round(time.time() - began, 3)
    docs, size = spark.read.parquet(f"{sf}/documents.parquet").agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    mib = size / 2**20
    rates = {"documents": docs, "mib": round(mib, 2), "tokenise_mib_s_core": round(mib / took["token_counts_by_type_lang"] / int(cpus), 3), "seq_two_docs_s_core": round(docs / took["seq_two"] / int(cpus), 1), "fact_contact_docs_s_core": round(docs / took["fact_contact"] / int(cpus), 1)}
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/")), "cpus": int(cpus), **rates}))


if __name__ == "__main__":
    main()
