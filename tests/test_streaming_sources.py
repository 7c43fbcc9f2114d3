from itertools import combinations

import pytest
from pyspark.sql import functions as F

from cloakframe.sources import readers, writers
from cloakframe.streaming.restore import ChunkRestorer, held_back, replace_labels, restore_batch, restore_stream

MAPPING = [("<Email_1>", "alice@example.com"), ("<人名_1>", "山田太郎"), ("<Name_1_First_Name>", "John"), ("<Name_1_Last_Name>", "Smith")]


def run(chunks):
    r = ChunkRestorer(MAPPING)
    return [*(r.push(c) for c in chunks), r.flush()]


def test_chunks():
    assert run(["Hello <Ema", "il_1> world"]) == ["Hello ", "alice@example.com world", ""]
    assert run(["x <Em", "ail", "_1> y"]) == ["x ", "", "alice@example.com y", ""]
    assert run(["<" + "x" * 80]) == ["<" + "x" * 80, ""]
    assert run(["unknown <Name_99> here"]) == ["unknown <Name_99> here", ""]
    assert run(["tail <Em"]) == ["tail ", "<Em"]
    assert run(["Dear <Name_1", "_First_Name> hi"]) == ["Dear ", "John hi", ""]
    assert held_back("a") == 1


def test_every_split():
    text = "Mail <Email_1> from <人名_1> please"
    for cuts in [*combinations(range(len(text) + 1), 1), *combinations(range(len(text) + 1), 2)]:
        at = [0, *cuts, len(text)]
        assert "".join(run([text[a:b] for a, b in zip(at, at[1:])])) == replace_labels(text, MAPPING)
    text = "Dear <Name_1_First_Name> <Name_1_Last_Name>, from <人名_1>"
    for k in range(len(text)):
        assert "".join(run([text[:k], text[k:]])) == replace_labels(text, MAPPING)


def test_stream_equals_batch(spark, tmp_path):
    text = "Dear <Name_1_First_Name> <Name_1_Last_Name>, mail <Email_1> or <Em"
    rows = [(s, i, text[i * 7 : i * 7 + 7], i * 7 + 7 >= len(text)) for s in ("a", "b") for i in range(-(-len(text) // 7))]
    schema = "stream_id string, seq long, chunk string, done boolean"
    mapping = F.array(*[F.struct(F.lit(k).alias("label"), F.lit(v).alias("value")) for k, v in MAPPING])
    shuffled = [rows[i] for i in range(len(rows)) if i % 2] + [rows[i] for i in range(len(rows)) if not i % 2]
    for n, part in enumerate((shuffled[:7], shuffled[7:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withColumn("mapping", mapping)
    query = restore_stream(stream, idle_ms=None).writeStream.format("memory").queryName("restored").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = spark.table("restored").groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("x")).collect()
    batch = {r.stream_id: r.text for r in restore_batch(spark.createDataFrame(rows, schema).withColumn("mapping", mapping)).collect()}
    assert {r.stream_id: "".join(t.text for t in r.x) for r in got} == batch == dict.fromkeys("ab", replace_labels(text, MAPPING))


def test_files(spark, tmp_path):
    (tmp_path / "ok.txt").write_text("mail a@b.com")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe")
    got = {r.name.split("/")[-1]: (r.text, r.valid) for r in readers.text_files(spark, [str(tmp_path)]).collect()}
    assert got == {"ok.txt": ("mail a@b.com", True), "bad.txt": (None, False)}
    with pytest.raises(ValueError):
        readers.one_input(spark, None, None)
    assert readers.one_input(spark, "x").first().text == "x"


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("k", [("<A_1>", "v")], "text")], "k string, mapping array<struct<label:string,value:string>>, t string")
    writers.write_mapping(rows, str(tmp_path / "m"), ["k"])
    assert spark.read.json(str(tmp_path / "m")).first().k == "k"
    assert writers.write_texts(rows, str(tmp_path / "t"), "t") == 4
    frames = readers.sse_frames(spark.createDataFrame([("s", "data: a\n\ndata: b\n\n")], "s string, body string"), "s", "body")
    assert writers.sse_body(frames, "s").first().body == "data: a\n\ndata: b\n\n"


def test_choices_repeats_and_idle_streams(spark, tmp_path):
    """Choices don't mix, late repeats of an ended stream say nothing, and a
    stream with a gap is flushed when it is idle for too long."""
    import time

    schema = "stream_id string, choice int, seq long, chunk string, done boolean"
    mapping = F.array(*[F.struct(F.lit(k).alias("label"), F.lit(v).alias("value")) for k, v in MAPPING])
    first = [("a", 0, 0, "hi <Ema", False), ("a", 1, 0, "yo <人名", False), ("a", 0, 1, "il_1>", True), ("b", 0, 0, "start <Em", False), ("b", 0, 2, " end", False)]
    then = [("a", 1, 1, "_1>!", True), ("a", 0, 0, "hi <Ema", False), ("a", 0, 1, "il_1>", True)]
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")) if spark.createDataFrame(first, schema).write.parquet(str(tmp_path / "in")) is None else None
    query = restore_stream(stream.withColumn("mapping", mapping), idle_ms=4000).writeStream.format("memory").queryName("choices").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()

    def until(done):
        deadline = time.time() + 60
        while time.time() < deadline and not any(done(r) for r in spark.table("choices").collect()):
            time.sleep(0.3)

    until(lambda r: (r.stream_id, r.choice) == ("a", 0) and r.last)
    spark.createDataFrame(then, schema).write.mode("append").parquet(str(tmp_path / "in"))
    until(lambda r: (r.stream_id, r.choice) == ("a", 1) and r.last)
    until(lambda r: r.stream_id == "b" and r.last)
    query.stop()
    out = {}
    for r in sorted(spark.table("choices").collect(), key=lambda r: (r.stream_id, r.choice, r.seq)):
        out[r.stream_id, r.choice] = out.get((r.stream_id, r.choice), "") + r.text
    assert out == {("a", 0): "hi alice@example.com", ("a", 1): "yo 山田太郎!", ("b", 0): "start <Em end"}


def test_completion_frames(spark):
    body = 'data: {"choices":[{"index":0,"delta":{"content":"a <Em"}},{"index":1,"delta":{"content":"b"}}]}\n\ndata: {"choices":[{"index":0,"delta":{"content":"ail_1>"}}]}\n\ndata: [DONE]\n\n'
    frames = readers.sse_frames(spark.createDataFrame([("s", body)], "stream_id string, body string"), "stream_id", "body")
    got = sorted(tuple(r) for r in readers.deltas(frames, "stream_id").collect())
    assert got == [("s", 0, 0, "a <Em", False), ("s", 0, 1, "ail_1>", True), ("s", 1, 0, "b", True)]
    rows = spark.createDataFrame([("s", 0, 0, "a ", False), ("s", 0, 1, "x", True)], "stream_id string, choice int, seq long, text string, last boolean")
    written = writers.sse_body(writers.delta_frames(rows), "stream_id").first().body
    assert written == 'data: {"choices":[{"index":0,"delta":{"content":"a "}}]}\n\ndata: {"choices":[{"index":0,"delta":{"content":"x"}}]}\n\ndata: [DONE]\n\n'
