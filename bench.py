"""Times the headline queries and prints one JSON line.

Each query starts from the tables: stage tables of earlier queries are forgotten, plan building is
counted, and the whole result is produced.  One small query warms the session up first.
"""

from __future__ import annotations

import json
import os
import time

from clausetrail import build_session
from clausetrail.plans import all_queries
from clausetrail.plans.inputs import forget

HEADLINES = (
    "txt_2_sentences",
    "txt_4_clauses",
    "pol_7_policy_status",
    "pol_10_broad_data_sharing",
    "pol_23_risk_level",
    "pol_27_sections",
    "url_8_vendors",
    "src_7_minimised_requests",
    "str_10_cookie_state",
    "str_2_visits",
    "str_5_rate_sampling",
    "str_11_cookie_attribution",
    "con_10_request_buckets",
    "net_12_network_result",
    "ver_5_change_verdicts",
    "rep_1_site_reports",
)


def ceilings(spark) -> dict[str, float]:
    import pandas as pd
    from pyspark.sql import functions as F

    from clausetrail.operators import cookies as K
    from clausetrail.operators import policy as P
    from clausetrail.sources.html import extract_text

    # Long runs of what the patterns look for, each cut to the analysed length of the ceiling.
    heads = ["Privacy Policy. We may sell and ", "Terms of Service. You agree that ", "개인정보 처리방침. 회사는 이메일을 "]
    texts = pd.DataFrame({"doc_id": range(3), "body": [head * (220_000 // len(head)) for head in heads]})
    markup = pd.DataFrame({"fetch_id": [0], "body": [("<div><p title='" + "<" * 40 + "&#x41;") * 20_000][:1]})
    markup["body"] = markup["body"].str.slice(0, 1 << 20)
    pushes = spark.range(100_000).select(
        F.col("id").alias("change_id"),
        F.concat(F.lit("d"), F.col("id") % 700, F.lit(".example")).alias("domain"),
        F.timestamp_micros(F.col("id")).alias("ts"),
        F.lit(0).alias("batch_start"),
    )
    jobs = {
        "ceiling_three_long_policies": lambda: P.analyze(spark.createDataFrame(texts), max_chars=120_000),
        "ceiling_malformed_markup": lambda: extract_text(spark.createDataFrame(markup)),
        "ceiling_queue_pushes": lambda: K.fair_queue(pushes),
    }
    out = {}
    for name, build in jobs.items():
        start = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        out[name] = round(time.perf_counter() - start, 3)
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        shuffle_partitions=2 * int(cpus),
        extra={"spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()

    def run(name: str) -> float:
        forget()
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run("src_1_policy_documents")
    times = {name: run(name) for name in HEADLINES}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "ceilings": ceilings(spark),
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
