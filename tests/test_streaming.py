from folioforge.sources.packages import BLOCKS
from folioforge.streaming import arrivals


def test_arriving_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("One.\n\nTwo.")
    (tmp_path / "in" / "b.pdf").write_text("x")
    files = arrivals.arriving_files(spark, str(tmp_path / "in"))
    query = arrivals.arriving_blocks(files).writeStream.format("memory").queryName("arrived").start()
    query.processAllAvailable()
    query.stop()
    rows = spark.sql("select * from arrived").collect()
    assert sorted((r.text or "", r.error or "") for r in rows) == [("", "unsupported format"), ("One.", ""), ("Two.", "")]
    assert len(rows[0]) == len(BLOCKS.split(", "))


def test_usage_windows(spark, data, tmp_path):
    schema = spark.read.parquet(f"{data}/usage_records.parquet").schema
    source = spark.readStream.schema(schema).parquet(f"{data}/usage_records.parquet*")
    totals = arrivals.usage_by_window(source, late="2000 days")
    query = totals.writeStream.format("memory").queryName("usage").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    got = spark.sql("select sum(record_count) n from usage").first().n
    assert got == spark.read.parquet(f"{data}/usage_records.parquet").select("usage_id").distinct().count()
