from millrace.operators import tools


def test_passages_stop_at_the_budget(spark):
    rows = [("q", 1, "T", "u1", "a" * 60, "s"), ("q", 2, " ", "u2", None, "b" * 30), ("q", 3, None, "u3", "c" * 30, None), ("q", 4, "X", "u4", "d", None), ("r", 1, "T", "u", None, None)]
    df = spark.createDataFrame(rows, "q string, rank int, title string, uri string, content string, snippet string")
    got = [tuple(r) for r in tools.passages(df, "q", budget=100).orderBy("q", "citation").collect()]
    assert got == [("q", 1, "T", "u1", "a" * 60, False, 1), ("q", 2, "u2", "u2", "b" * 30, False, 1), ("q", 3, "u3", "u3", "c" * 10, True, 1), ("r", 1, "T", "u", "", False, 0)]
    assert tools.passages(df, "q", limit=0).where("q = 'q'").count() == 1


def test_windows_of_documents(spark):
    docs = spark.createDataFrame([("d", "T", "0123456789"), ("e", None, None)], "document_id string, title string, body string")
    asked = spark.createDataFrame([(1, "d", 2, 3), (2, "d", -5, None), (3, "d", 99, 4), (4, "e", None, None), (5, "x", 0, 1), (6, "d", 4, 0)], "request int, document_id string, offset int, most int")
    got = {r.request: (r.found, r.body, r.offset, r.remaining) for r in tools.document_windows(asked, docs).collect()}
    assert got == {1: (True, "234", 2, 5), 2: (True, "0123456789", 0, 0), 3: (True, "", 10, 0), 4: (True, "", 0, 0), 5: (False, None, None, None), 6: (True, "4", 4, 5)}


def test_lists(spark):
    docs = spark.createDataFrame([("c", f"d{i}", f"Title {i}", f"http://h/{i % 3}", i, i != 4) for i in range(9)] + [("o", "x", "Title", "u", 1, True)], "crate_id string, document_id string, title string, uri string, created_at int, current boolean")
    chunks = spark.createDataFrame([("d8",), ("d8",), ("d7",)], "document_id string")
    page = tools.document_list(docs, chunks, "c", limit=3).collect()
    assert [(r.document_id, r.chunks, r.total) for r in page] == [("d8", 2, 8), ("d7", 1, 8), ("d6", 0, 8)]
    assert [r.document_id for r in tools.document_list(docs, chunks, "c", limit=3, offset=5).collect()] == ["d5", "d3", "d2"]
    assert [(r.document_id, r.total) for r in tools.document_list(docs, chunks, "c", "H/1").collect()] == [("d7", 2), ("d1", 2)]
    sources = spark.createDataFrame([("c", "s", "B", "GIT", None, '{"git": {"repositoryUrl": "https://me:secret@h/r?token=1", "token": "t"}}', True), ("c", "t", "A", "HTTPS", "d", '{"website": {"url": "https://w/"}}', False), ("c", "u", "C", "HTTPS", "d", "{}", True)], "crate_id string, source_id string, name string, connector string, description string, configuration string, enabled boolean")
    jobs = spark.createDataFrame([("s",), ("s",)], "source_id string")
    assert [(r.name, r.endpoint, r.jobs) for r in tools.source_list(sources, jobs, "c").collect()] == [("A", "https://w/", 0), ("B", "https://h/r", 2), ("C", None, 0)]
    crates = spark.createDataFrame([("2", "b", None, "ACTIVE"), ("1", "a", None, "ACTIVE")], "id string, name string, description string, status string")
    assert [r.id for r in tools.crate_list(crates).collect()] == ["1", "2"] and tools.crate_list(crates, []).count() == 0 and tools.crate_list(crates, ["2"]).count() == 1
