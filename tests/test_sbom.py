"""Bill-of-materials documents written in segments and read back whole."""

import json
from pathlib import Path

from pyspark.sql import functions as F

from chainscope.operators import sbom as B
from chainscope.session import shared_dir
from chainscope.sources import stores

COMPS = ("project_id string, name string, version string, purl string, license string, license_id string, scope string, description string, "
         "author string, integrity string, resolved string")
TIME = "2024-06-01T00:00:00.000Z"


def _inputs(spark):
    rows = [("a", f"pkg-{k:04}", f"1.{k}", f"pkg:npm/pkg-{k:04}@1.{k}", "MIT" if k % 2 else None, "MIT" if k % 2 else None, "required",
             'say "hi"\n\u00e9' if k % 3 else "", "me" if k % 5 else "", f"sha512-h{k}" if k % 4 else "", "https://r/x" if k % 7 else "") for k in range(400)]
    rows += [("b", "only", "2", "pkg:npm/only@2", "", "", "dev", "", "", "plainhash", "")]
    edges = [("a", f"pkg-{k:04}", f"pkg-{(k * 7 + j) % 500:04}") for k in range(5, 400) for j in range(k % 4)] + [("a", "pkg-0007", "pkg-0049")]
    return spark.createDataFrame(rows, COMPS), spark.createDataFrame(edges, "project_id string, name string, dep string"), rows, set(edges)


def _texts(spark, path):
    out = {}
    for folder in sorted(Path(path.removeprefix("file:")).glob("project_id=*")):
        out[folder.name.split("=")[1]] = "".join(f.read_text() for f in sorted(folder.glob("part-*"))), len(list(folder.glob("part-*")))
    return out


def test_cyclonedx_round_trip(spark):
    comps, edges, rows, pairs = _inputs(spark)
    path = shared_dir(spark, "sbom")
    stores.write_documents(B.cyclonedx_document(comps, edges, TIME), path)
    texts = _texts(spark, path)
    assert texts["a"][1] > 1  # several files, in order of their names
    doc = json.loads(texts["a"][0])
    assert doc["bomFormat"] == "CycloneDX" and doc["metadata"]["component"]["name"] == "a" and doc["metadata"]["timestamp"] == TIME
    assert [c["name"] for c in doc["components"]] == sorted(r[1] for r in rows if r[0] == "a")
    one = doc["components"][1]
    assert one["licenses"] == [{"license": {"id": "MIT"}}] and one["hashes"] == [{"alg": "SHA-512", "content": "h1"}] and one["description"].startswith('say "hi"')
    assert "licenses" not in doc["components"][0] and doc["components"][0]["externalReferences"] == []
    versions = {r[1]: r[2] for r in rows if r[0] == "a"}
    want = {f"pkg:npm/{n}@{v}": sorted({f"pkg:npm/{d}@{versions.get(d, '0.0.0')}" for p, m, d in pairs if m == n}) for n, v in versions.items()}
    assert {d["ref"]: d["dependsOn"] for d in doc["dependencies"]} == want and any("@0.0.0" in x for v in want.values() for x in v)
    assert json.loads(texts["b"][0])["dependencies"] == [{"ref": "pkg:npm/only@2", "dependsOn": []}]
    whole = stores.read_documents(spark, path).groupBy("project_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file", "place", "text"))), lambda x: x["text"]), "").alias("t"))
    typed = whole.select("project_id", F.from_json("t", "bomFormat string, components array<struct<name:string,scope:string>>").alias("d"))
    assert {(r.project_id, r.n) for r in typed.select("project_id", F.size("d.components").alias("n")).collect()} == {("a", 400), ("b", 1)}


def test_spdx_round_trip(spark):
    comps, edges, rows, pairs = _inputs(spark)
    path = shared_dir(spark, "sbom")
    stores.write_documents(B.spdx_document(comps, edges, TIME), path)
    texts = _texts(spark, path)
    doc = json.loads(texts["a"][0])
    assert doc["spdxVersion"] == "SPDX-2.3" and len(doc["packages"]) == 400
    ids = {p["SPDXID"]: p["name"] for p in doc["packages"]}
    assert {(ids[r["spdxElementId"]], r["relatedSpdxElement"].split("/")[1].split("@")[0]) for r in doc["relationships"]} == {(n, d) for _, n, d in pairs}
    assert doc["packages"][0]["licenseConcluded"] == "NOASSERTION" and doc["packages"][1]["checksums"] == [{"algorithm": "SHA512", "checksumValue": "h1"}]
    other = json.loads(texts["b"][0])
    assert other["relationships"] == [] and other["packages"][0]["checksums"] == [{"algorithm": "SHA256", "checksumValue": "plainhash"}]


def test_documents_of_nothing(spark):
    comps, edges, _, _ = _inputs(spark)
    assert B.cyclonedx_document(comps.where("false"), edges, TIME).collect() == []
    assert B.spdx_document(comps.where("false"), edges.where("false"), TIME).collect() == []


def test_report_sink(spark):
    path = shared_dir(spark, "report")
    df = spark.createDataFrame([("p", 1, None), ("q", 2, "x")], "project_id string, n int, note string")
    stores.write_report(df, path, ["project_id"])
    back = spark.read.schema("n int, note string, project_id string").json(path)
    assert sorted((r.project_id, r.n, r.note) for r in back.collect()) == [("p", 1, None), ("q", 2, "x")]
    stores.write_report(df.limit(1), path)
    assert spark.read.json(path).count() == 1


def test_bill_of_materials_reads_edges_of_its_snapshot(spark, tmp_path):
    from datetime import datetime

    from chainscope.plans.sbom_queries import comps
    from chainscope.sources.fixtures import Workspace
    day = {"old": datetime(1997, 5, 1), "new": datetime(1998, 5, 1)}
    spark.createDataFrame([(i,) for i in range(400)], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(i, i % 90, day["old" if i % 3 == 0 else "new"], "1-URGENT" if i % 2 else None) for i in range(300)],
                          "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    lines = [(i % 300, i % 70 if i % 11 else None, day["old" if i % 5 == 0 else "new"]) for i in range(2000)]
    spark.createDataFrame(lines + lines[:500], "l_orderkey long, l_partkey long, l_shipdate timestamp_ntz").write.parquet(str(tmp_path / "lineitem.parquet"))
    ws = Workspace(spark, str(tmp_path))

    def rows(docs):
        found = B.parse_lockfile(docs).withColumn("dependencies", F.array_sort("dependencies"))
        return sorted(map(str, found.collect()))
    both = {s: rows(ws.lockfiles(s)) for s in ("old", "new")}
    assert all(both.values()) and sorted(both["old"] + both["new"]) == rows(ws.table("lockfile_json"))
    plan = comps(ws)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert any("Filter" in x and "l_shipdate" in x for x in plan)
