import io
import tarfile

import pytest

from riskloom.session import work_path
from riskloom.sources import archives, files

NODES = "nodeid,isFraud,init_balance,fraudStep\n1,1,10.5,3\n2,0,x,\n"
TRANSACTIONS = "time,sourceNodeId,targetNodeId,value\n5,1,2,7.25\n6,2,1,\n"
METADATA = "nodes: 2 (1 fraud nodes)\ntransactions: 2\npatterns: fan in\n"


def packed(folder, name, members):
    folder.mkdir(exist_ok=True)
    path = folder / f"{name}.tar.gz"
    with tarfile.open(path, "w:gz") as archive:
        for member, text in members.items():
            info = tarfile.TarInfo(f"{name}/{member}")
            info.size = len(text.encode())
            archive.addfile(info, io.BytesIO(text.encode()))
    return str(path)


@pytest.fixture
def archive(tmp_path):
    return packed(tmp_path, "small", {"metadata.txt": METADATA, "transactions.csv": TRANSACTIONS, "nodes.csv": NODES, "notes.txt": "?"})


def test_members_are_read_without_unpacking(spark, archive):
    """Columns by their header names, whatever their order; a cell that is no number is NULL."""
    found = archives.read_packed_archives(spark, [archive])
    rows = {n: [tuple(r)[1:] for r in found[n].collect()] for n in ("nodes", "transactions")}
    names = found["transactions"].columns[1:]
    assert [str(v) for v in rows["nodes"][0]][:2] == ["1", "1"] and len(rows["nodes"]) == 2
    first = dict(zip(names, rows["transactions"][0]))
    assert (str(first["sourceNodeId"]), str(first["targetNodeId"]), float(first["value"]), int(first["time"])) == ("1", "2", 7.25, 5)
    assert rows["transactions"][1][names.index("value")] is None
    summary = found["metadata"].first()
    assert (summary["reported_node_count"], summary["reported_fraud_node_count"], summary["patterns"]) == (2, 1, "fan in")
    assert files.reconcile_metadata(found["metadata"], found["nodes"], found["transactions"]).where("NOT matches").count() == 0


def test_each_archive_is_a_partition(spark, tmp_path):
    members = {"metadata.txt": METADATA, "nodes.csv": NODES, "transactions.csv": TRANSACTIONS}
    paths = [packed(tmp_path, f"s{i}", members) for i in range(3)]
    rows = archives.read_packed_archives(spark, paths)["nodes"]
    assert rows.rdd.getNumPartitions() == 3 and rows.count() == 6
    assert {r["archive"] for r in rows.collect()} == set(paths)


def test_empty_member(spark, tmp_path):
    path = packed(tmp_path, "none", {"metadata.txt": METADATA, "nodes.csv": "", "transactions.csv": TRANSACTIONS.split("\n")[0] + "\n"})
    found = archives.read_packed_archives(spark, [path])
    assert found["nodes"].count() == found["transactions"].count() == 0


def test_missing_members_are_named(spark, archive, tmp_path):
    broken = packed(tmp_path, "broken", {"nodes.csv": NODES, "metadata.txt": METADATA})
    with pytest.raises(FileNotFoundError, match="broken.tar.gz: broken/transactions.csv$"):
        archives.read_packed_archives(spark, [archive, broken])


def test_round_trip(spark):
    nodes = spark.createDataFrame([(str(i), str(int(i % 7 == 0)), str(i * 1.5), "3") for i in range(60)], "nodeid string, isFraud string, init_balance string, fraudStep string")
    rows = spark.createDataFrame([(str(i % 60), str((i * 7) % 60), str(float(i)), str(i)) for i in range(300)], "sourceNodeId string, targetNodeId string, value string, time string")
    manifest = archives.write_packed_archives(nodes, rows, work_path(spark, "packed"), parts=4)
    found = archives.read_packed_archives(spark, [r["path"] for r in manifest.collect()])
    assert manifest.agg({"nodes": "sum", "transactions": "sum"}).first().asDict() == {"sum(nodes)": 60, "sum(transactions)": 300}
    for name, written in (("nodes", nodes), ("transactions", rows)):
        back = found[name].select(*[found[name][c].cast("string").alias(c) for c in written.columns])
        if name == "nodes":
            assert sorted(r["nodeid"] for r in back.collect()) == sorted(r["nodeid"] for r in written.collect())
        else:
            ends = ["sourceNodeId", "targetNodeId"]
            assert sorted(map(tuple, back.select(ends).collect())) == sorted(map(tuple, written.select(ends).collect()))
    assert files.reconcile_metadata(found["metadata"].limit(1), found["nodes"].limit(0), found["transactions"]).count() == 3
