import hashlib
import json
import zipfile

import pytest

from millrace.sources import bundles

V1 = {
    "jobs": [{"id": "j", "name": "site", "configurationJson": "{}", "enabled": True}],
    "runs": [{"id": "r", "jobId": "j", "status": "COMPLETED", "configurationJson": "{1}"}],
    "frontier": [{"id": "i", "runId": "r", "url": "http://a", "canonicalUrl": "http://a/", "depth": 2, "status": "DONE"}],
    "fetches": [{"id": "f", "runId": "r", "frontierEntryId": "i", "requestedUrl": "http://a"}],
    "documents": [{"id": f"d{k}", "runId": "r", "fetchId": "f", "canonicalUrl": "http://a/", "title": " ", "body": "b", "contentHash": "h", "metadataJson": "{}"} for k in range(3)],
    "chunks": [{"id": "c", "documentId": "d1", "ordinal": 0, "content": "x", "contentHash": "h"}],
    "rules": [{"id": "u", "name": "ip", "type": "IP", "enabled": True}],
    "results": [{"id": "t", "ruleId": "u", "runId": "r", "documentId": "d1", "chunkId": "c", "chunkOrdinal": 0, "matchedValue": "1.1.1.1", "matchStart": 0, "matchEnd": 7}],
}
V4 = {
    "sources": [{"id": "s", "name": "git", "connectorType": "GIT", "configurationJson": "{}", "enabled": True}],
    "ingestionJobs": [{"id": "j", "sourceId": "s", "name": "n", "mode": "SCHEDULED", "cronExpression": "* * * * *"}, {"id": "k", "sourceId": "s", "name": "m", "cronExpression": "0 * * * *"}],
    "ingestionRuns": [{"id": "r", "ingestionJobId": "j", "sourceId": "s"}],
    "sourceItems": [],
    "acquisitions": [{"id": "a", "runId": "r"}],
    "documents": [{"id": "d", "runId": "r", "acquisitionId": "a", "sourceUri": "x", "identityUri": "y", "versionNumber": 9, "currentVersion": False}],
}


def zipped(path, name, data, version, sums=None, extra=()):
    body = json.dumps(data)
    sums = sums or {"data.json": hashlib.sha256(body.encode()).hexdigest()}
    with zipfile.ZipFile(path / name, "w") as z:
        z.writestr("manifest.json", json.dumps({"schemaVersion": version, "createdAt": "2024-01-01T00:00:00Z", "checksums": sums}))
        z.writestr("data.json", body)
        for n in extra:
            z.writestr(n, b"x")


def crates(spark, *names):
    return spark.createDataFrame([(n, f"crate of {n}") for n in names], "bundle string, crate_id string")


def test_two_versions_become_one(spark, tmp_path):
    zipped(tmp_path, "old.zip", V1, 1, extra=["artifacts/f"])
    zipped(tmp_path, "new.zip", V4, 4)
    entries = bundles.unzipped(spark, str(tmp_path))
    assert entries.count() == 5
    out = {k: [r.asDict() for r in v.collect()] for k, v in bundles.import_bundles(entries, crates(spark, "old.zip", "new.zip")).items()}
    assert {k: len(v) for k, v in out.items()} == {"sources": 2, "ingestionJobs": 3, "ingestionRuns": 2, "sourceItems": 1, "acquisitions": 2, "documents": 4, "chunks": 1, "rules": 1, "results": 1, "work": 4}
    ids = {name: {r["id"]: r for r in rows} for name, rows in out.items() if name != "work"}
    for name, targets in bundles.REFERENCES.items():
        for row in out[name]:
            for column, target in targets.items():
                assert row[column] is None or ids[target][row[column]]["crate_id"] == row["crate_id"]
    old = sorted((r["versionNumber"], r["identityUri"], r["title"]) for r in out["documents"] if r["crate_id"] == "crate of old.zip")
    assert old == [(1, "http://a/", None), (2, "http://a/", None), (3, "http://a/", None)]
    new = next(r for r in out["documents"] if r["crate_id"] == "crate of new.zip")
    assert (new["versionNumber"], new["identityUri"], new["currentVersion"]) == (9, "y", False)
    assert sorted((r["mode"], r["cronExpression"]) for r in out["ingestionJobs"] if r["crate_id"] == "crate of new.zip") == [("MANUAL", None), ("SCHEDULED", "* * * * *")]
    source = next(r for r in out["sources"] if r["crate_id"] == "crate of old.zip")
    assert source["connectorType"] == "HTTPS" and source["name"] == "site"
    run = next(r for r in out["ingestionRuns"] if r["crate_id"] == "crate of old.zip")
    assert run["sourceConfigurationJson"] == run["jobConfigurationJson"] == "{1}" and run["sourceId"] == source["id"]
    assert {w["document_id"] for w in out["work"]} == set(ids["documents"]) and len({w["idempotency_key"] for w in out["work"]}) == 4


@pytest.mark.parametrize(
    "data, version, sums, extra, fault",
    [
        (V4, 7, None, (), "unsupported schema version"),
        (V4, 4, {"data.json": "0"}, (), "checksum mismatch data.json"),
        (V4, 4, {"artifacts/z": "0"}, (), "missing artifacts/z"),
        (V4, 4, None, ("../x",), "unsafe entry ../x"),
        ({**V4, "ingestionRuns": []}, 4, None, (), "names r, which is not there"),
    ],
)
def test_faults(spark, tmp_path, data, version, sums, extra, fault):
    zipped(tmp_path, "b.zip", data, version, sums, extra)
    with pytest.raises(ValueError, match=fault):
        bundles.import_bundles(bundles.unzipped(spark, str(tmp_path)), crates(spark, "b.zip"))
