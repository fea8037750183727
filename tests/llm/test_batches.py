"""Arrow batches stay short, whatever way the session says how long they are."""

from ledgerlark.llm import common


def test_settings_are_read_in_all_forms(spark):
    rows, size = (f"spark.sql.execution.arrow.{n}" for n in ("maxRecordsPerBatch", "maxBytesPerBatch"))
    before = spark.conf.get(rows), spark.conf.get(size)
    try:
        for given, want in ((("10000", "64m"), ("512", 4 << 20)), (("0", "67108864b"), ("512", 4 << 20)), (("100", "1mb"), ("100", 1 << 20)), (("-1", "512k"), ("512", 512 << 10))):
            spark.conf.set(rows, given[0])
            spark.conf.set(size, given[1])
            common.short_batches(spark)
            assert spark.conf.get(rows) == want[0]
            left = spark.conf.get(size)
            assert left in (str(want[1]), f"{want[1]}b", given[1])
    finally:
        spark.conf.set(rows, before[0])
        spark.conf.set(size, before[1])
