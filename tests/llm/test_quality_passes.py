"""The quality rules' language model reads the texts once."""
from authsift.llm import quality_rules


def test_texts_are_counted_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = [(k, f"some words {k} and others {k % 7} here", ("en", "de", None)[k % 3]) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3).mapInArrow(
        seen, "doc_id bigint, text string, lang string")
    model = quality_rules._Model(docs, "text", "lang", 1 << 18)
    assert model.whole and model.levels.count() == 3
    assert read.value == len(rows)
