from quillmill.llm import secrets


def test_a_blob_without_any_path_is_scanned(spark, tmp_path):
    ledger = secrets.Ledger(spark, f"file://{tmp_path}/ledger")
    versions = spark.createDataFrame([(None, "token=abcdefgh"), (None, "f" * 24), ("a", "f" * 24)], "path string, text string")
    assert ledger.update(versions, secrets.base_rules()) == 2 * 3
    assert sorted((r.kind, r.start, r.stop) for r in ledger.findings().collect()) == [("assign", 0, 14), ("hex", 0, 24)]
    assert ledger.update(versions, secrets.base_rules()) == 0
