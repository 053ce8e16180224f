import pytest
from conftest import rows

from tidemark.operators import screening as S
from tidemark.plans.runner import fold_steps, step
from tidemark.streaming.steps import transform_stream

STEPS = [
    step("replace_substring", column="price", old_substring="$", new_substring=""),
    step("convert_column_to_float", column="price"),
    step("fill_col_na", column="price", fill_value=0.0),
    step("rename_column", column="note", new_column="text"),
]


def test_stream_equals_table(spark, tmp_path):
    data = [(1, "$1.5", "fine"), (2, None, "ignore this"), (3, "x", None)]
    df = spark.createDataFrame(data, "k int, price string, note string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = S.screen_table(transform_stream(stream, STEPS), "text")
    query = (
        out.writeStream.format("memory").queryName("out")
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    try:
        assert query.awaitTermination(60)
    finally:
        query.stop()
    assert rows(spark.table("out")) == rows(S.screen_table(fold_steps(df, STEPS), "text"))
    assert rows(spark.table("out"))[1] == (2, 0.0, "ignore this", True, True)


def test_questions_have_no_answer_on_a_stream(spark):
    stream = spark.readStream.format("rate").load()
    with pytest.raises(ValueError, match="no answer"):
        transform_stream(stream, [step("has_nulls", column="value")])
    with pytest.raises(ValueError, match="Step 1"):
        transform_stream(stream, [step("drop_column", column="nope")])
