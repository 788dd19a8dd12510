"""Every training document takes part in the training of the language model."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from authsift.llm import language_model


@pytest.mark.parametrize("ids", ["pmod(xxhash64(id), 8) >= 2", "null"])
def test_documents_of_every_part_are_learnt_from(spark, ids):
    rows = spark.range(4000).where("crc32(cast(cast(id as string) as binary)) % 10 <> 1").withColumn("text", F.expr("repeat('one two three four ', 40 + int(id % 7))"))
    rows = rows.withColumn("id", F.lit(None).cast("bigint")) if ids == "null" else rows.where(ids)
    got = language_model.scores(rows.limit(1500).repartition(4), id_col="id", held=1).agg(F.sum("score"), F.sum("base_score"), F.max("held_out")).first()
    assert not got[2] and got[0] > 0.5 * got[1]  # the order of the words is learnt, the base knows their shares only


def test_the_last_tokens_are_learnt_from():
    v = language_model.vocabulary(np.arange(1, 3000, dtype=np.uint64), np.arange(3000, 1, -1), 5_000_000, 4000)
    tokens = np.arange(257, dtype=np.int32)
    other = tokens.copy()
    other[-1] = 1000
    fresh = np.arange(257) == 0
    a, b = (language_model.train(language_model.initial(v), t, fresh) for t in (tokens, other))
    assert any((a[k] != b[k]).any() for k in a)
