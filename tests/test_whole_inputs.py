from pyspark.sql import functions as F
from strandline.plans import space


def test_gmm_weights_reads_all_dimensions_of_all_rows(spark, sf, monkeypatch):
    seen, mixture = [], space.learning.mixture
    monkeypatch.setattr(space.learning, "mixture", lambda f, x, k: seen.append(f) or mixture(f, x, k))
    got = space.gmm_weights(spark, sf).collect()
    whole = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert {r[0] for r in seen[0].select(F.size("x")).distinct().collect()} == {r[0] for r in whole.select(F.size("embedding")).distinct().collect()}
    assert sum(r.n for r in got) == whole.count()
