import json

import pytest

from brindle import session
from brindle.sources import edgelist, snapshots
from brindle.streaming import upserts


@pytest.fixture(scope="module")
def db(spark, tmp_path_factory):
    return session.Engine(spark, f"file://{tmp_path_factory.mktemp('dbs')}", cache=1).create("one", stride=2)


def test_values_and_names(db):
    key = db.execute("INSERT hello")["key"]
    assert db.execute(f"READ {key}").first()["payload"] == "hello"
    db.execute(f"PAIR_SET greeting {key}")
    assert db.execute("PAIR_GET greeting").first()["key"] == key and db.execute("PAIR_GET greet").count() == 0
    done = db.execute("PAIR_PUT_BATCH items='" + json.dumps([{"k": "p:1", "v": "x"}, {"k": "", "v": "y"}, {"k": "p:3", "v": "z"}]) + "'")
    assert (done["applied"], done["failed"]) == (1, 2)
    assert [r["name"] for r in db.execute("PAIR_SCAN p:").collect()] == ["p:1"]
    db.execute("PAIR_PURGE prefix=p: payloads=1")
    assert db.execute("PAIR_SCAN p:").count() == 0 and not db.execute(f"READ {done['keys'][0]}").first()["found"]
    db.execute(f"DELETE {key}")
    with pytest.raises(ValueError, match="already_deleted"):
        db.execute(f"DELETE {key}")


def test_records_change_their_schema(db):
    db.execute("RECORD define table=ngram fields=cnt:uint:4,prob:float:4,label:string:8,flag:bool")
    db.execute("RECORD set table=ngram key=berlin cnt=42 prob=0.25 label=city flag=1")
    db.execute("RECORD set table=ngram key=berlin cnt=43")
    r = db.execute("RECORD get table=ngram key=berlin").first()
    assert (r.cnt, r.prob, r.label, r.flag) == (43, 0.25, "city", True)
    with pytest.raises(ValueError, match="value_out_of_range:cnt"):
        db.execute("RECORD set table=ngram key=berlin cnt=4294967296")
    with pytest.raises(KeyError, match="unknown_field"):
        db.execute("RECORD set table=ngram key=berlin nope=1")
    assert db.execute("RECORD alter table=ngram add=novelty:float drop=label")["dead"] == 8
    assert db.execute("RECORD get table=ngram key=berlin").first().novelty is None
    db.execute("RECORD set table=ngram key=berlin cnt=44")
    assert db.execute("RECORD get table=ngram key=berlin").first().novelty == 0.0
    assert db.execute("RECORD compact table=ngram")["generation"] == 2
    assert db.execute("RECORD select table=ngram field=cnt op=gt value=43").count() == 1


def test_graph_and_jobs(db):
    db.execute("BATCH GRAPH_EDGE_SET type=link items='" + json.dumps([{"from": "a", "to": "b"}, {"from": "b", "to": "c"}]) + "'")
    assert db.execute("GRAPH_QUERY query=\"MATCH (id='a')-[:link]->(*) HOPS 1..2\"").count() == 2
    assert db.execute("GRAPH_DEGREE id=b direction=both").first()["degree"] == 2
    job = db.execute("GRAPH_RECALL_ASYNC seeds=a hops=2 precision=0.1")["job"]
    db.jobs[job].future.result()
    assert db.execute(f"JOB status job={job}")["state"] == "done"
    assert [r["node"] for r in db.execute(f"GRAPH_RECALL_FETCH job={job}")["rows"]] == ["b", "c"]
    with pytest.raises(ValueError, match="job_not_found"):
        db.execute(f"JOB fetch job={job}")


def test_prediction(db):
    for value, p in (("cat", 0.6), ("kitten", 0.25), ("dog", 0.15)):
        db.execute(f"PREDICT_SET key=ctx:the value={value} prob={p}")
    ask = lambda: {r["value"]: round(r["probability"], 4) for r in db.execute("PREDICT_QUERY key=ctx:the").collect()}
    assert ask() == {"cat": 0.4269, "kitten": 0.3009, "dog": 0.2722}
    db.execute("PREDICT_TRAIN key=ctx:the target=cat lr=0.05 negatives=dog")
    assert ask() == {"cat": 0.4344, "kitten": 0.3007, "dog": 0.2649}
    db.execute("PREDICT_INHERIT key=ctx:the target=feline sources=cat,kitten merge=avg")
    assert sorted(ask().values(), reverse=True) == [0.3191, 0.2655, 0.2209, 0.1946]


def test_databases(db):
    assert db.engine.list()[0]["stride"] == 2 and db.execute("DB_CONFIG one cache=5")["cache"] == "5"
    with pytest.raises(ValueError):
        db.execute("DATABASE ../x")
    with pytest.raises(ValueError, match="unknown_command"):
        db.execute("NOPE")


def test_edge_list(spark, tmp_path):
    rows = ["Relation\tAction\tEntity\tValue\tProbability\tSource\tIteration of Promotion", "Likes It\t+\tA b\tC\t0.5\ts\t1", "likes_it\t\tA B\tc\t0.95\ts\t2", "r\t-\tx\ty\t1\ts\t1", "r\t+\tx\ty\tnope\ts\t1", "r\t+\tx\tz\t7\ts\t1"]
    (tmp_path / "e.tsv").write_text("\n".join(rows))
    got = sorted(tuple(r) for r in edgelist.read(spark, str(tmp_path / "e.tsv")).collect())
    assert got == [("likes_it", "a_b~", "c~", 0.95), ("r", "x~", "z~", 1.0)]


def test_stream_folds_batches_once(spark, small, tmp_path):
    spark.read.parquet(f"{small}/events.parquet").repartition(3).write.parquet(str(tmp_path / "events"))
    folder = snapshots.Folder(spark, f"file://{tmp_path}/db")
    stream = upserts.read_events(spark, str(tmp_path / "events"))
    upserts.follow_edges(upserts.edge_writes(stream), folder, str(tmp_path / "c")).awaitTermination()
    whole = spark.read.parquet(f"{small}/events.parquet").select("user_id", "event_type").distinct().count()
    assert folder.table("edges").count() == whole


def test_only_the_buckets_of_a_batch_are_written(spark, tmp_path):
    folder = snapshots.Folder(spark, f"file://{tmp_path}/db")
    edge = "seq long, src string, dst string, type string, directed boolean, weight double, confidence double, modality string, ambiguity string, props string"
    rows = [(i, f"a{i}", "b", "t", True, 0.5, None, None, None, None) for i in range(300)]
    first = upserts.upsert_edges(spark.createDataFrame(rows, edge))
    folder.replace("edges", first)
    batch = spark.createDataFrame([(400, "a7", "b", "t", True, 0.9, None, None, None, None), (401, "new", "b", "t", True, 0.1, None, None, None, None)], edge)
    everything = list(range(upserts.BUCKETS))
    folder.replace_buckets("edges", upserts.bucketed(folder.table("edges")), "__bucket", everything)
    before = json.loads(folder.load("edges.current"))
    numbers = sorted(r[0] for r in upserts.bucketed(batch).select("__bucket").distinct().collect())
    folder.replace_buckets("edges", upserts.bucketed(upserts.fold(folder.buckets("edges", numbers), batch)), "__bucket", numbers)
    after = json.loads(folder.load("edges.current"))
    assert {int(n) for n in after if after[n] != before.get(n)} == set(numbers)
    held = {r.src: r.weight for r in folder.table("edges").collect()}
    assert len(held) == 301 and held["a7"] == 0.9 and held["new"] == 0.1 and held["a8"] == 0.5
    folder.replace("edges", folder.table("edges").where("src = 'new'"))
    assert folder.table("edges").count() == 1 and folder.buckets("edges", [1]) is None
