from strataloom.functions import scalars
from strataloom.sources import tables as S
from strataloom.sources.trees import source_tree
from strataloom.streaming import metrics
from pyspark.sql import functions as F


def test_repository_leaves_out_build_files(spark, tmp_path):
    for path, text in {"src/main.py": "x", "dist/bundle.min.js": "y", ".scanner_cache/a": "z", "lib.so": "w", "z.txt": "1", ".gitignore": "g", "requirements.txt": "# c\n\nrequests>=2\nflask\n", "package.json": '{"dependencies": {"a": "^1.0"}, "devDependencies": {"b": "2"}}', "pom.xml": "<dependency><groupId>g</groupId>\n<artifactId>a</artifactId></dependency>"}.items():
        f = tmp_path / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    files = S.repository(spark, str(tmp_path))
    assert [r.rel_path for r in files.collect()] == [".gitignore", "package.json", "pom.xml", "requirements.txt", "src/main.py", "z.txt"]
    assert {(r.name, r.version_spec) for r in S.requirements(files).collect()} == {("requests", "requests>=2"), ("flask", "flask")}
    assert {(r.dep_type, r.name) for r in S.package_json(files).collect()} == {("runtime", "a"), ("dev", "b")}
    assert [(r.name, r.version_spec) for r in S.pom_xml(files).collect()] == [("g:a", "unknown")]


def test_folders_are_listed_in_tasks(spark, tmp_path):
    names = {f"d{i}/e{k}/f{n}.txt" for i in range(3) for k in range(3) for n in range(2)} | {"top.txt"}
    for path in [*names, "d0/dist/no.txt", "d1/e1/x.pyc"]:
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(path)
    source_tree(spark, str(tmp_path))  # registers the source
    for folders in (1, 3, 5, 512):
        rows = spark.read.format("source_tree").option("folders", folders).load(str(tmp_path)).collect()
        assert sorted(r.rel_path for r in rows) == sorted(names) and all(r.content == r.rel_path for r in rows)


def test_percentiles_and_bounds(spark):
    v = F.array(*(F.lit(float(i)) for i in range(1, 11)))
    low, high = scalars.wilson(F.lit(1), F.lit(1))
    r = spark.range(1).select(scalars.p95_nearest(v), scalars.p95_exclusive(v), low, high).first()
    assert r[0] == 10 and abs(r[1] - 10.45) < 1e-9 and abs(r[2] - 0.084526) < 1e-6 and r[3] == 1.0


def test_stream_counts_as_batch(spark, tmp_path):
    src = tmp_path / "in"
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.orderBy("ts").coalesce(1).write.parquet(str(src))
    metrics.run_once(metrics.hourly(metrics.events(spark, str(src))), str(tmp_path / "out"), str(tmp_path / "cp"))
    batch = {(r.hour, r.event_type): r.n for r in events.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n")).collect()}
    stream = {(r.hour, r.event_type): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    last = max(h for h, _ in batch)
    assert all(stream.get(k) == n for k, n in batch.items() if k[0] < last) and len(stream) >= len(batch) - 5
