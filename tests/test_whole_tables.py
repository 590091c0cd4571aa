"""Registered queries without SQL read whole tables."""

from collections import Counter

from lexquarry.plans import registry

DATA = "/root/testdata/sf0.01"


def test_strict_xml_sections_of_every_order(spark):
    def expected(key, priority):
        if key % 11 == 0 or key % 13 == 0:
            return key, "contract", None
        return (key, "ok", priority) if key % 5 == 3 else (key, "not-found", None)

    orders = spark.read.parquet(f"{DATA}/orders.parquet").select("o_orderkey", "o_orderpriority").collect()
    got = registry.strict_xml_sections(spark, DATA).collect()
    assert len(got) == len(orders) > 2000
    assert Counter(map(tuple, got)) == Counter(expected(*r) for r in orders)
