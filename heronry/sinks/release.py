"""Immutable releases: content-addressed objects, verification, promotion of what is new, and the pointer that readers follow.

A release is a folder of Parquet tables that is never changed; a pointer file names the current one. Objects are rows (key, sha256,
body), so equal bodies are stored once.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def digest(c) -> Column:
    return F.sha2(F.coalesce(c, F.lit("")).cast("binary"), 256)


def write_release(rows: DataFrame, key: str, body: Column, path: str) -> None:
    """index (key, sha256) and objects (sha256, bytes, body): each distinct body once."""
    coded = rows.select(F.col(key).alias("key"), body.alias("body")).withColumn("sha256", digest(F.col("body")))
    coded.select("key", "sha256").write.parquet(f"{path}/index")
    objects = coded.groupBy("sha256").agg(F.any_value("body").alias("body"))
    objects.select("sha256", F.octet_length("body").cast("long").alias("bytes"), "body").write.parquet(f"{path}/objects")


def read_release(spark: SparkSession, path: str) -> DataFrame:
    """key, sha256, bytes, body of every row of the index."""
    return spark.read.parquet(f"{path}/index").join(spark.read.parquet(f"{path}/objects"), "sha256").select("key", "sha256", "bytes", "body")


def put_states(expected: DataFrame, present: DataFrame) -> DataFrame:
    """key, state of conditional puts of (key, sha256): written where the key is new, reused where content is equal, else conflict."""
    there = present.select("key", F.col("sha256").alias("there"))
    state = F.when(F.col("there").isNull(), "written").when(F.col("there") == F.col("sha256"), "reused").otherwise("conflict")
    return expected.join(there, "key", "left").select("key", state.alias("state"))


def promotion(source: DataFrame, target: DataFrame) -> DataFrame:
    """One row: how many objects (key, sha256) are copied and how many stand in the target already."""
    there = target.select("key", "sha256").distinct().withColumn("reused", F.lit(True))
    both = source.select("key", "sha256").distinct().join(there, ["key", "sha256"], "left")
    return both.agg(F.count_if(F.col("reused").isNull()).alias("copied"), F.count_if("reused").alias("reused"))


def verification(declared: DataFrame, listed: DataFrame) -> DataFrame:
    """Declared objects (key, sha256, bytes) that are missing or differ: key, problem."""
    found = listed.select("key", F.col("sha256").alias("found"), F.col("bytes").alias("found_bytes"))
    problem = F.when(F.col("found").isNull(), "missing").when(F.col("bytes") != F.col("found_bytes"), "length").when(F.col("sha256") != F.col("found"), "digest")
    return declared.join(found, "key", "left").select("key", problem.alias("problem")).filter("problem IS NOT NULL")


def manifest_issues(named: DataFrame, stored: DataFrame) -> DataFrame:
    """Keys that a manifest names but no object has, and objects that no manifest names: key, issue."""
    absent = named.select("key").distinct().join(stored.select("key"), "key", "left_anti").withColumn("issue", F.lit("absent"))
    orphans = stored.select("key").distinct().join(named.select("key"), "key", "left_anti").withColumn("issue", F.lit("orphan"))
    return absent.unionByName(orphans)


def _file(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _pointer_files(spark: SparkSession, path: str) -> list[tuple[int, object]]:
    """(number, file) of every complete state of a pointer, the newest first."""
    files, pattern = _file(spark, f"{path}.v*")
    found = [f.getPath() for f in files.globStatus(pattern) or []]
    return sorted(((int(p.getName().rpartition(".v")[2]), p) for p in found if p.getName().rpartition(".v")[2].isdigit()), key=lambda x: -x[0])


def read_pointer(spark: SparkSession, path: str) -> dict | None:
    """The newest state of a pointer; None before the first."""
    states = _pointer_files(spark, path)
    return json.loads(spark.read.text(states[0][1].toString(), wholetext=True).first()[0]) if states else None


def switch_pointer(spark: SparkSession, path: str, value: dict, kept: int = 2) -> bool:
    """Write the pointer if its content changes. Whether it was written.

    Every state is a file of its own with a number, written beside and renamed when it is whole, and readers take the greatest number:
    a crash at any step leaves the state before or the new one. A number that another writer took meanwhile is an error. Older states
    than the newest `kept` go at the end.
    """
    if read_pointer(spark, path) == value:
        return False
    states = _pointer_files(spark, path)
    number = states[0][0] + 1 if states else 1
    files, fresh = _file(spark, f"{path}.new-{uuid.uuid4().hex}")
    _, place = _file(spark, f"{path}.v{number}")
    out = files.create(fresh, True)
    out.write(json.dumps(value, sort_keys=True).encode())
    out.close()
    if files.exists(place) or not files.rename(fresh, place):
        files.delete(fresh, False)
        raise OSError(f"another writer switched the pointer {path}")
    for _, old in states[kept - 1 :]:
        files.delete(old, False)
    return True


def publish(spark: SparkSession, path: str, release: str, problems: DataFrame, **more: str) -> bool:
    """Switch the pointer to a verified release, with what else its readers need; a release with problems is an error and leaves the pointer alone."""
    if not problems.isEmpty():
        raise ValueError(f"release {release} has problems: {[tuple(r) for r in problems.limit(5).collect()]}")
    return switch_pointer(spark, path, {"release": release, **more})


def state_delta(old: DataFrame, new: DataFrame, key: str, mark: str) -> DataFrame:
    """key, action to turn one state (key, mark) into another: put what is new or changed, delete what is gone."""
    a, b = old.select(key, F.col(mark).alias("before")), new.select(key, F.col(mark).alias("after"))
    both = a.join(b, key, "full_outer").filter(~F.col("before").eqNullSafe(F.col("after")))
    return both.select(key, F.when(F.col("after").isNull(), "delete").otherwise("put").alias("action"))


def encoded(rows: DataFrame, group: str, order: list[str], columns: list[str]) -> DataFrame:
    """group, lines, sha256: the rows of each group as sorted JSON lines, so equal content is equal bytes however it was stored.

    A group (a month of a project) is one object and has to fit in memory.
    """
    line = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    lines = F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))), lambda x: x["line"])
    return rows.groupBy(group).agg(F.array_join(lines, "\n").alias("lines")).select(group, "lines", digest(F.col("lines")).alias("sha256"))


def upsert_months(spark: SparkSession, rows: DataFrame, path: str, key: list[str], order: list[str]) -> DataFrame:
    """Merge rows (with a column month) into a table in folders by month: the newest of each key by `order` stays.

    Only months whose content changes are written again, each as a new version; a table of versions is written last, so readers see
    a month whole, old or new. What a run that died before that left behind is written over by the next. The result: month, written.
    """
    old = read_months(spark, path)
    months = rows.select("month").distinct()
    known = rows if old is None else rows.unionByName(old.join(months, "month", "left_semi").select(*rows.columns))
    best = known.groupBy("month", *key).agg(F.max_by(F.struct(*known.columns), F.struct(*order)).alias("r")).select("r.*")
    mark = lambda df, name: df.groupBy("month").agg(F.sum(F.xxhash64(F.to_json(F.struct(*sorted(rows.columns)))).cast("decimal(38,0)")).alias(name), F.count("*").alias(f"{name}_n"))
    version = 0 if old is None else spark.read.parquet(f"{path}/versions").agg(F.max("version")).first()[0] + 1
    changed = mark(best, "new")
    if old is not None:
        changed = changed.join(mark(old, "old"), "month", "left").filter("old IS NULL OR new <> old OR new_n <> old_n")
    changed = changed.select("month")
    report = [r.month for r in changed.collect()]  # a row for each month
    if report:
        best.join(F.broadcast(changed), "month").write.mode("overwrite").partitionBy("month").parquet(f"{path}/data/version={version}")
        spark.createDataFrame([(m, version) for m in report], "month string, version int").coalesce(1).write.mode("append").parquet(f"{path}/versions")
    return months.join(changed.withColumn("written", F.lit(True)), "month", "left").select("month", F.coalesce("written", F.lit(False)).alias("written"))


def read_months(spark: SparkSession, path: str) -> DataFrame | None:
    """The current version of every month; None where nothing has been written."""
    files, place = _file(spark, f"{path}/versions")
    if not files.exists(place):
        return None
    current = spark.read.parquet(f"{path}/versions").groupBy("month").agg(F.max("version").alias("version"))
    data = spark.read.parquet(f"{path}/data").withColumn("month", F.col("month").cast("string"))
    return data.join(F.broadcast(current), ["month", "version"]).drop("version")


def merged_verdicts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Reviews (review_id, state, verdict, at): the newer state; a dismissed review keeps the verdict that it had."""
    both = old.unionByName(new)
    newest = both.groupBy("review_id").agg(F.max_by(F.struct("state", "verdict", "at"), "at").alias("n"), F.max_by(F.when(F.col("state") != "DISMISSED", F.col("state")), F.when(F.col("state") != "DISMISSED", F.col("at"))).alias("had"))
    dismissed = F.col("n.state") == "DISMISSED"
    return newest.select("review_id", F.col("n.state").alias("state"), F.when(dismissed, F.coalesce("n.verdict", "had")).otherwise(F.col("n.state")).alias("verdict"), F.col("n.at").alias("at"))


def metric_point(spark: SparkSession, path: str, runs: DataFrame) -> None:
    """Append one row for each job run: job, run_id, at, status, values as a map."""
    runs.select("job", "run_id", "at", "status", "values").write.mode("append").parquet(path)
