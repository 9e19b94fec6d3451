"""Headline timings on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import functions as F

from palimpsest.catalog import all_queries
from palimpsest.functions import tokens as K
from palimpsest.operators.index import build_index, read_index
from palimpsest.operators.search import search
from palimpsest.operators.tiers import segmented
from palimpsest.session import local_session, spread
from palimpsest.sources.tables import document_records, questions, table

NAMED = ["conversation_turns", "raw_blocks", "fp_dedupe", "ingest_anti_join", "session_rollup", "token_spread"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    work = os.environ.get("BENCH_WORK") or tempfile.mkdtemp(prefix="palimpsest-bench-")
    seconds: dict[str, float] = {}

    def timed(name: str, run) -> None:
        start = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - start, 3)

    def drain(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").cache()
    chars = docs.agg(F.sum(F.length("text"))).first()[0]
    token_rows = docs.select(F.size(K.tokens(F.col("text"))))
    timed("tokenize_cold", lambda: drain(token_rows))
    timed("tokenize", lambda: drain(token_rows))
    docs.unpersist()

    timed("records", lambda: document_records(spark, sf_dir).write.mode("overwrite").parquet(f"{work}/records"))
    stored = spark.read.parquet(f"{work}/records")
    timed("index_build", lambda: build_index(stored).write(f"{work}/index"))
    index = read_index(spark, f"{work}/index")
    ask = questions(spark, sf_dir)
    one = ask.orderBy("query_id").limit(1).withColumn("session", F.lit("src0"))
    timed("single_question_cold", lambda: drain(search(index, one)))
    timed("single_question", lambda: drain(search(index, one)))
    timed("all_questions", lambda: drain(search(index, ask)))
    timed("all_questions_segmented", lambda: drain(segmented(index, ask)))
    for name in NAMED:
        timed(name, lambda name=name: drain(all_queries()[name](spark, sf_dir)))

    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir).removeprefix("sf"), "cpus": int(cpus),
        "spark": spark.version, "tokenizer_chars": chars,
        "tokenizer_chars_per_ms": round(chars / (seconds["tokenize"] * 1000), 1),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
