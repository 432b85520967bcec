from casewright.plans import catalog

SF = "/root/testdata/sf0.001"


def test_stream_gets_its_rows_in_slices_of_time(spark, monkeypatch):
    rows = sorted(catalog.QUERIES["event_batches_stream"](spark, SF).collect())
    runs, one = [], catalog._stream_result
    monkeypatch.setattr(catalog, "_stream_result", lambda *args: runs.append(1) or one(*args))
    monkeypatch.setattr(catalog, "SLICE_ROWS", 400)
    assert sorted(catalog.QUERIES["event_batches_stream"](spark, SF).collect()) == rows
    assert len(runs) >= 3
