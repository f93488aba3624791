"""Object keys."""

from pyspark.sql import functions as F

from edgelog.operators.layout import object_key


def test_object_key_strips_exactly_the_root(spark):
    cases = [("file:///data/2023-01-01-01/my%20lake/new/E1.2024-01-02-03.a%2Bb.gz", "/data/2023-01-01-01/my lake", "new/E1.2024-01-02-03.a+b.gz"),
             ("s3://bucket/lake/new/x+y.gz", "s3://bucket/lake", "new/x+y.gz"), ("viewfs://store/lake/new/a", "viewfs://store/lake/", "new/a")]
    for path, root, key in cases:
        assert spark.range(1).select(object_key(F.lit(path), root).alias("k")).first().k == key
