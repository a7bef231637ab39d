import gzip
import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from millrace.sources import readers, writers
from millrace.streaming import ingest

RECORDS = "text string, source string, id string, domain string, split string, pos bigint"


def test_strict_and_lenient_lines(spark, tmp_path):
    (tmp_path / "a").mkdir()
    good = [json.dumps({"text": f"t{i} é", "source": "a", "id": f"a/{i}"}, ensure_ascii=False) for i in range(3)]
    (tmp_path / "a" / "train_000.jsonl").write_text("\n".join(good) + "\n\n  \n", newline="\n")
    got = readers.read_corpus(spark, str(tmp_path), "a", "train").collect()
    assert sorted((r.text, r.source, r.id) for r in got) == [(f"t{i} é", "a", f"a/{i}") for i in range(3)]
    for bad in ("not json", '{"source": "a"}', '{"text": ""}', '{"text": 5}'):
        (tmp_path / "a" / "train_001.jsonl").write_text(bad + "\n")
        with pytest.raises(Exception, match="train_001.jsonl"):
            readers.read_corpus(spark, str(tmp_path), "a", "train").collect()
        assert len(readers.lenient(readers.read_lines(spark, str(tmp_path / "a"))).collect()) >= 3
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "train_000.jsonl.zst").write_bytes(b"")
    for domain, message in (("b", "compressed"), ("c", "no folder"), ("a", "no val")):
        with pytest.raises(FileNotFoundError, match=message):
            readers.corpus_files(spark, str(tmp_path), domain, "val" if domain == "a" else "train")


def test_compressed_lines(spark, tmp_path):
    import zstandard

    data = "".join(json.dumps({"text": f"line {i}"}) + "\n" for i in range(500)).encode()
    (tmp_path / "x.jsonl.zst").write_bytes(zstandard.compress(data))
    (tmp_path / "x.jsonl.gz").write_bytes(gzip.compress(data))
    want = {f"line {i}" for i in range(500)}
    assert {r.raw for r in readers.open_source(spark, "jsonl.zst", str(tmp_path / "x.jsonl.zst")).collect()} == want
    assert {r.raw for r in readers.open_source(spark, "jsonl", str(tmp_path / "x.jsonl.gz")).collect()} == want


def test_sources_are_probed_and_fall_back(spark, tmp_path):
    spark.createDataFrame([("x", 1)], "text string, n int").write.parquet(str(tmp_path / "p"))
    assert [r.raw for r in readers.open_source(spark, "parquet", str(tmp_path / "p")).collect()] == ["x"]
    for column in ("body", "n"):
        with pytest.raises(readers.SourceUnavailable):
            readers.open_source(spark, "parquet", str(tmp_path / "p"), column)
    df, failures = readers.first_available(spark, [("parquet", str(tmp_path / "p"), "n"), ("parquet", str(tmp_path / "no"), "text"), ("parquet", str(tmp_path / "p"), "text")])
    assert df.count() == 1 and len(failures) == 2
    assert readers.first_available(spark, [("parquet", str(tmp_path / "no"), "text")])[0] is None
    with pytest.raises(TypeError):
        readers.open_source(spark, "ftp", "x")
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "e" / "b.md").write_bytes(b"N\x08NA\x08AME")
    (tmp_path / "d" / "a.md").write_bytes(b"\xff")
    assert [bytes(r.raw) for r in readers.read_docs(spark, str(tmp_path / "d")).collect()] == [b"\xff", b"NAME"]


def test_trajectories(spark, tmp_path):
    def archive(name, members):
        with tarfile.open(tmp_path / name, "w:gz") as tar:
            for path, text in members.items():
                info = tarfile.TarInfo(path)
                info.size = len(text)
                tar.addfile(info, io.BytesIO(text))

    talk = json.dumps([{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]).encode()
    archive("1.tar.gz", {"t1/agent/x_session.json": talk, "t1/verifier/reward.txt": b" 1\n", "t2/agent/x_session.json": talk, "t2/verifier/reward.txt": b"0"})
    archive("2.tar.gz", {"t1/agent/x_session.json": talk, "t3/agent/x_session.json": b"{broken", "t3/verifier/reward.txt": b"1", "other": b"?"})
    got = readers.successful(readers.read_archives(spark, str(tmp_path / "*.tar.gz"))).collect()
    assert sorted((r.archive[-8:], r.trial, r.verdict) for r in got) == [("1.tar.gz", "t1", "kept"), ("1.tar.gz", "t2", "failed"), ("2.tar.gz", "t1", "failed"), ("2.tar.gz", "t3", "failed")]


def test_corpus_and_conversations_are_written_and_read(spark, tmp_path):
    rows = [(f"text {i} é\n\x01", "a", f"a/{i:09d}", "a", "train", i) for i in range(40)]
    writers.write_corpus(spark.createDataFrame(rows, RECORDS), str(tmp_path / "c"), limit=300)
    files = sorted((tmp_path / "c" / "domain=a" / "split=train").glob("file_no=*/*.txt"))
    assert len(files) > 5 and all(f.stat().st_size < 300 + 100 for f in files)
    back = [json.loads(x) for f in sorted(files, key=lambda f: int(f.parent.name.split("=")[1])) for x in f.read_text().splitlines()]
    assert [b["id"] for b in back] == [r[2] for r in rows] and [b["text"] for b in back] == [r[0] for r in rows]
    talk = spark.createDataFrame([([{"role": "user", "content": "q"}],)], f"messages {readers.MESSAGES}")
    writers.write_conversations(talk, str(tmp_path / "s"))
    assert readers.read_conversations(spark, str(tmp_path / "s")).first().messages[0].content == "q"
    (tmp_path / "bad.jsonl").write_text('{"messages": []}\n')
    with pytest.raises(Exception, match="no messages"):
        readers.read_conversations(spark, str(tmp_path / "bad.jsonl")).collect()
    assert writers.folder_bytes(spark, str(tmp_path / "c")) >= sum(f.stat().st_size for f in files)


def test_small_json_and_staleness(tmp_path):
    path = tmp_path / "m" / "meta.json"
    assert writers.read_json(path) is None
    writers.write_json(path, {"a": 1, "b": "é"})
    assert writers.is_current({"a": 1}, writers.read_json(path)) and not writers.is_current({"a": 2}, writers.read_json(path)) and not writers.is_current({"c": None}, writers.read_json(path))
    assert writers.check_run({"a": 1, "b": 2}, a=1)["b"] == 2
    for meta in (None, {"a": 2}, {}):
        with pytest.raises(ValueError):
            writers.check_run(meta, a=1)
    path.write_text("{")
    assert writers.read_json(path) is None and not writers.is_current({}, None)
    assert "a" in writers.mix_report([{"domain": "a", "target_share": 0.5, "actual_share": 0.25, "tokens": 5, "documents": 1}])


def test_ingest_in_batches_keeps_what_one_batch_keeps(spark, tmp_path):
    config = spark.createDataFrame([("a", 1.0, 4.0, 3)], "domain string, share double, bytes_per_token double, min_doc_bytes int")
    src, out = tmp_path / "in", str(tmp_path / "out")
    texts = [["abcd", "efgh", "abcd", "x"], ["efgh", "ijkl"], ["abcd", "mnop", "\xff"]]
    pos = 0
    seen: set = set()
    for i, batch in enumerate(texts):
        rows = []
        for t in batch:
            rows.append((t.encode("latin-1"), "a", 0, pos))
            pos += 1
        spark.createDataFrame(rows, ingest.RAW).coalesce(1).write.mode("append").parquet(str(src))
        ingest.ingest(spark, str(src), out, config, files_per_batch=1).awaitTermination()
        seen |= {t for t in batch if len(t) > 2}
        assert sorted(r.text for r in spark.read.parquet(f"{out}/kept").collect()) == sorted(seen)
    # a batch that is repeated, as after a crash between its write and its checkpoint, changes nothing
    ingest.ingest_batch(spark.createDataFrame([(b"ijkl", "a", 0, 5), (b"efgh", "a", 0, 4)], ingest.RAW), 1, out, config)
    assert sorted(r.text for r in spark.read.parquet(f"{out}/kept").collect()) == sorted(seen)
    assert spark.read.parquet(f"{out}/dropped").agg(F.sum("n")).first()[0] == 2
    spark.read.parquet(str(src)).coalesce(1).write.parquet(str(tmp_path / "one"))
    file = next((tmp_path / "one").glob("*.parquet"))
    ingest.ingest(spark, str(file), str(tmp_path / "out2"), config).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out2") + "/kept").count() == len(seen)


def test_errors_name_the_line(spark, tmp_path):
    good = '{"text": "some text", "source": "a", "id": "a/1"}\n'
    folder = tmp_path / "a"
    folder.mkdir()
    (folder / "train_000.jsonl").write_text(good * 700)
    for k, bad in enumerate(("not json", '{"id": "no text"}', '{"text": 5}')):
        (folder / "train_001.jsonl").write_text(good * 300 + "\n" + good * 20 + bad + "\n" + good * 500)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # many splits
        try:
            lines = readers.numbered_lines(spark, readers.corpus_files(spark, str(tmp_path), "a", "train"))
            per = lines.groupBy("file").agg(F.count("*"), F.countDistinct("line"), F.max("line")).collect()
            assert sorted(tuple(r)[1:] for r in per) == [(700, 700, 700), (822, 822, 822)]
            with pytest.raises(Exception, match=r"train_001.jsonl:322: "):
                readers.read_corpus(spark, str(tmp_path), "a", "train").collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "s.jsonl").write_text('{"messages": [{"role": "user", "content": "q"}]}\n\n{"messages": []}\n')
    with pytest.raises(Exception, match=r"s.jsonl:3: no messages"):
        readers.read_conversations(spark, str(tmp_path / "s.jsonl")).collect()


def test_ingest_compacts_what_it_has_seen(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "COMPACT", 2)
    config = spark.createDataFrame([("a", 1.0, 4.0, 3)], "domain string, share double, bytes_per_token double, min_doc_bytes int")
    out, want = str(tmp_path / "out"), {}
    for i in range(7):
        texts = [f"text {k}" for k in range(i * 3, i * 3 + 8)]
        batch = spark.createDataFrame([(t.encode(), "a", 0, i * 100 + k) for k, t in enumerate(texts)], ingest.RAW)
        for _ in range(1 + i % 2):  # every second batch is repeated
            ingest.ingest_batch(batch, i, out, config)
        for k, t in enumerate(texts):
            want.setdefault(t, i * 100 + k)
        assert {r.text: r.pos for r in spark.read.parquet(f"{out}/kept").collect()} == want
        assert ingest.seen_texts(spark, out).count() == len(want)
    assert sorted(p.name for p in (tmp_path / "out" / "seen").iterdir() if p.is_dir()) == ["run=4", "run=5", "run=6", "upto=3", "upto=5"]
    files = spark.read.parquet(f"{out}/kept").select("text").distinct().count()
    assert files == len(want) and len(ingest._runs(spark, out)) == 2


def test_ingest_by_bytes(spark, tmp_path):
    config = spark.createDataFrame([("a", 1.0, 4.0, 3)], "domain string, share double, bytes_per_token double, min_doc_bytes int")
    for i in range(4):
        spark.createDataFrame([(f"text {i} {k}".encode(), "a", 0, i * 100 + k) for k in range(20)], ingest.RAW).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), config, bytes_per_batch=1000).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out" / "kept")).count() == 80 and len(list((tmp_path / "out" / "kept").glob("batch=*"))) > 1
