"""Knowledge files and versioned tables on small cases worked out by hand."""

import pytest

from tidewright.sources.knowledge import knowledge
from tidewright.sources.versioned import Conflict, VersionedTable

IPC = """
act: I.P.C.
source: "a book"
records:
  - {section: 379, title: Theft, max_imprisonment: {years: 3}, bailable: false}
  - {section: "302", max_imprisonment: death, min_imprisonment: {years: 10, months: 6}, default_bail_period_days: 90, verified: true}
  - {section: 290, fine_only: true}
mappings:
  - {ipc: "379", bns: ["303(2)", "304"], relation: split}
rules:
  section_479: {ref: "BNSS 479", verified: false, fraction: {num: 1, den: 2}}
"""
MORE = """
act: ipc
records:
  - {section: "379", title: Theft again, max_imprisonment: {years: 7}, aggravated_max_imprisonment: life}
ingredients:
  - {sections: ["IPC:380", "BNS:305"], ingredient: house, any_of: [room, house], lesser: {"IPC:380": "IPC 379"}}
"""


def test_knowledge_files(spark, tmp_path):
    (tmp_path / "a.yaml").write_text(IPC)
    (tmp_path / "b.yaml").write_text(MORE)
    (tmp_path / "c.yaml").write_text("")
    overlay = spark.createDataFrame([("IPC:379", True, "r1"), ("rule:section_479", True, "r2"), ("IPC:1", True, "x")], "key string, verified boolean, verified_by string")
    k = knowledge(spark, f"file://{tmp_path}/*.yaml", overlay)
    r = {x.section: x for x in k.records.collect()}
    assert set(r) == {"379", "302", "290"} and {x.act for x in r.values()} == {"IPC"}
    assert (r["379"].title, r["379"].max_kind, r["379"].max_months, r["379"].aggravated_kind, r["379"].verified, r["379"].verified_by) == ("Theft again", "term", 84, "life", True, "r1")
    assert (r["302"].max_kind, r["302"].max_months, r["302"].min_months, r["302"].period_days, r["302"].verified, r["302"].source) == ("death", None, 126, 90, True, "a book")
    assert (r["290"].max_kind, r["290"].max_months, r["290"].verified) == ("none", None, False)
    assert sorted((x.old, x.new, x.relation) for x in k.mappings.collect()) == [("379", "303(2)", "split"), ("379", "304", "split")]
    assert [(x.name, x.ref, x.verified, x.verified_by) for x in k.rules.collect()] == [("section_479", "BNSS 479", True, "r2")]
    assert sorted((x.section_key, x.any_of) for x in k.ingredients.collect()) == [("BNS:305", ["room", "house"]), ("IPC:380", ["room", "house"])]
    same = knowledge(spark, f"file://{tmp_path}/*.yaml", overlay).version
    assert same == k.version != knowledge(spark, f"file://{tmp_path}/*.yaml").version and len(same) == 12
    (tmp_path / "c.yaml").write_text("records: []")
    assert knowledge(spark, f"file://{tmp_path}/*.yaml", overlay).version != same


def test_versions_conflicts_and_dead_jobs(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    frame = lambda rows: spark.createDataFrame(rows, "k int, v string")
    rows = lambda df: sorted((str(r.k), r.v) for r in df.collect())
    with pytest.raises(ValueError):
        t.read()
    assert t.upsert(frame([(1, "a"), (2, "b"), (None, "n")]), ["k"]) == 1
    assert t.upsert(frame([(2, "c"), (2, "d"), (3, None), (None, "m")]), ["k"], frame([(1, "gone")])) == 2
    assert rows(t.read()) == [("2", "d"), ("3", None), ("None", "m")] and rows(t.read(1)) == [("1", "a"), ("2", "b"), ("None", "n")]
    with pytest.raises(Conflict):  # another writer made version 2 meanwhile
        t.write(frame([(9, "late")]), after=1)
    frame([(7, "dead")]).write.parquet(f"{t.path}/data-dead")  # a job that died before its entry
    (tmp_path / "t" / "log" / "3").touch()  # and one that died in the middle of it
    assert rows(t.read()) == [("2", "d"), ("3", None), ("None", "m")]
    assert t.upsert(frame([(4, "e")]), ["k"]) == 4 and list(t.versions()) == [1, 2, 4]
    assert "data-dead" in t.vacuum(keep=1) and list(t.versions()) == [4] and rows(t.read()) == [("2", "d"), ("3", None), ("4", "e"), ("None", "m")]
