"""Dependencies and their advisories, dealt by package."""

from pyspark.sql import functions as F

from corpus_guard.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_few_packages_meet_in_a_task(spark):
    """in the order of the dependencies the result took six times the disk."""
    found = QUERIES["d16_vulnerabilities"](spark, SF).groupBy(F.spark_partition_id().alias("part")).agg(F.collect_set("name").alias("names"), F.count("*").alias("n")).collect()
    every = {x for r in found for x in r.names}
    assert len(found) >= 16 and sum(len(r.names) for r in found) <= 2 * len(every) + len(found)
    assert max(r.n for r in found) < 4 * sum(r.n for r in found) / len(found)
