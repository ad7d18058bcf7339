"""Actions, cohorts and projections in their edge cases."""

import glob
import os
import shutil
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from emberlog.operators import actions, cohorts
from emberlog.operators.runs import DedupePolicy
from emberlog.sources import projection

PAIR = "ability_a long, ability_b long, matched_a long, matched_b long, rate_a double, rate_b double, cast_ratio double"


def mapped(spark, abilities, pairs, manual=None):
    a = spark.createDataFrame([(x, "extra") for x in abilities], "ability long, label string")
    m = None if manual is None else spark.createDataFrame(manual, "ability long, action_id long")
    return {r.ability: (r.action_id, r.confidence, r.members, r.claims, r.least_rate, r.matched) for r in actions.mapping(a, spark.createDataFrame(pairs, PAIR), m).collect()}


def test_actions_are_claimed_not_assumed(spark):
    one = lambda a, b, rate=1.0, ratio=1.0: (a, b, 9, 8, 1.0, rate, ratio)
    pairs = [one(1, 2), one(1, 3), one(2, 3, 0.96), one(5, 6), one(6, 7), one(10, 11, ratio=4.0), one(12, 13, 0.94), (14, 15, 1, 1, None, None, None)]
    got = mapped(spark, [*range(1, 16), 1, 1, None], pairs)
    assert got[1] == got[2] == got[3] == (1, "measured", 3, 3, 0.96, 8)
    assert got[5] == got[7] == (5, "inferred", 3, 2, 1.0, 8)  # 5 and 7 hang together by 6 only
    assert all(got[x] == (x, "separate", 1, 0, None, None) for x in (4, 8, 9, 10, 11, 12, 13, 14, 15)) and len(got) == 15
    by_hand = mapped(spark, range(1, 8), pairs, [(6, 60), (4, 60)])
    assert by_hand[6][:2] == by_hand[4][:2] == (60, "manual") and by_hand[5][:2] == (5, "separate") and by_hand[1][1] == "measured"
    assert mapped(spark, [], []) == {}
    said = [r.v for r in spark.createDataFrame(pairs, PAIR).select("ability_a", actions.verdict().alias("v")).orderBy("ability_a").collect()]
    assert said[-3:] == ["not one for one", "separate", "separate"]


def test_roles_of_abilities(spark):
    rows = [(1, "cast"), (1, "begincast"), (1, "damage"), (2, "damage"), (2, "applybuff"), (3, "odd"), (3, None), (None, "cast"), (4, "odd"), (4, "odd"), (4, "summon")]
    got = actions.roles(spark.createDataFrame(rows, "ability long, type string"))
    assert {r.ability: r.role for r in got.collect()} == {1: "cast", 2: "impact", 3: None, 4: "summon"}


@pytest.fixture
def corpus(spark):
    runs = spark.createDataFrame([(1, 1, "x"), (2, 1, "x"), (3, 0, "x"), (4, None, "x"), (5, 1, "y"), (6, 1, "x")], "run_id long, is_canonical int, dungeon_key string")
    coverage = spark.createDataFrame([(r, "cast", None, "ok" if r != 6 else "partial") for r in range(1, 7)], "run_id long, data_type string, hostility string, status string")
    roster = spark.createDataFrame([(1, 11), (1, 12), (1, 12), (5, 13)], "run_id long, player_id long")
    digests = spark.createDataFrame([(r, "page", f"{r:064d}") for r in range(1, 7)], "run_id long, grade string, digest string")
    return runs, coverage, roster, digests


def test_an_evaluation_is_what_it_saw(spark, corpus, tmp_path):
    runs, coverage, roster, digests = corpus
    strict = cohorts.Definition("c", ("cast",), DedupePolicy.STRICT, {"dungeon_key": "x"})
    found = cohorts.evaluate(strict, *corpus)
    assert {tuple(r) for r in found.members.collect()} == {(1, 11), (1, 12), (2, None)}
    assert {(r.run_id, r.reason) for r in found.exclusions.collect()} == {(3, "duplicate"), (4, "unclassified"), (6, "missing-coverage")}
    root = str(tmp_path)
    name = cohorts.record(spark, root, found)
    before = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{root}/**", recursive=True)}
    assert cohorts.record(spark, root, cohorts.evaluate(strict, *corpus)) == name
    assert {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{root}/**", recursive=True)} == before
    # the same members over other evidence, or by another definition, are another evaluation
    other = cohorts.record(spark, root, cohorts.evaluate(strict, runs, coverage, roster, digests.withColumn("digest", F.reverse("digest"))))
    wide = cohorts.Definition("c", ("cast",), DedupePolicy.PERMISSIVE, {"dungeon_key": "x"}, version=2)
    third = cohorts.record(spark, root, cohorts.evaluate(wide, *corpus))
    kept = cohorts.recorded(spark, root)
    heads = {r.evaluation_id: (r.runs, r.members, r.excluded, r.provisional) for r in kept.head.collect()}
    assert heads == {name: (2, 3, 3, False), other: (2, 3, 3, False), third: (3, 4, 2, True)}
    side = lambda i: kept.members.where(F.col("evaluation_id") == i)
    assert [tuple(r) for r in cohorts.changes(side(name), side(third)).collect()] == [(4, None, "joined")]
    assert [tuple(r) for r in cohorts.changes(side(third), side(name)).collect()] == [(4, None, "left")]
    # without its head an evaluation isn't there, and is written anew
    shutil.rmtree(f"{root}/heads/evaluation_id={third}")
    assert cohorts.recorded(spark, root).members.where(F.col("evaluation_id") == third).count() == 0
    assert cohorts.record(spark, root, cohorts.evaluate(wide, *corpus)) == third
    assert cohorts.recorded(spark, root).members.where(F.col("evaluation_id") == third).count() == 4


def test_an_empty_cohort(spark, corpus):
    nobody = cohorts.evaluate(cohorts.Definition("c", (), DedupePolicy.STRICT, {"dungeon_key": "z"}), *corpus)
    assert [(r.runs, r.members, r.excluded, r.provisional) for r in nobody.head.collect()] == [(0, 0, 0, False)]
    nothing = cohorts.evaluate(cohorts.Definition("c", ("cast",), DedupePolicy.STRICT), *[df.limit(0) for df in corpus])
    assert [(r.runs, r.members, r.corpus_fingerprint) for r in nothing.head.collect()] == [(0, 0, None)]


DDL = "k string, n long, d double, t timestamp, z timestamp_ntz, day date, m decimal(9,2), b binary, f boolean, a array<string>, s struct<x:int,y:array<double>>, p map<string,int>"


def table(spark):
    full = ("u", 1, 0.5, datetime(2024, 1, 2), datetime(2024, 1, 2), date(2024, 1, 2), Decimal("1.50"), b"\x00a", True, ["a", None], (1, [0.0]), {"x": 1, "y": 2})
    rows = [full, full, (None, *full[1:]), ("v", *[None] * 11), ("", *full[1:]), ("u", 2, float("nan"), *full[3:9], [], (None, None), {})]
    return spark.createDataFrame(rows, DDL)


def prints(df, by=("k",)):
    return {r[0]: (r["rows"], r.fingerprint) for r in projection.logical_fingerprints(df, list(by)).collect()}


def test_fingerprints_see_rows_and_no_files(spark, tmp_path):
    df = table(spark)
    want = prints(df)
    assert {k: n for k, (n, _) in want.items()} == {"u": 3, None: 1, "v": 1, "": 1} and len({h for _, h in want.values()}) == 4
    df.repartition(3).write.option("compression", "gzip").parquet(f"{tmp_path}/a")
    assert prints(spark.read.parquet(f"{tmp_path}/a")) == want
    assert prints(df.select(*reversed(df.columns))) == want
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    assert prints(spark.read.parquet(f"{tmp_path}/a")) == want
    spark.conf.set("spark.sql.session.timeZone", zone)
    for column, value in {"n": "n + 1", "d": "d * 2", "day": "date_add(day, 1)", "b": "cast('b' as binary)", "a": "array('a', 'N;')", "p": "map('x', 2, 'y', 2)", "s": "named_struct('x', 1, 'y', array(1.0D))"}.items():
        assert prints(df.withColumn(column, F.expr(value).cast(df.schema[column].dataType)))["u"] != want["u"]
    assert prints(df.withColumn("n", F.col("n").cast("int")))["u"] != want["u"]  # a type counts
    assert prints(df.withColumn("d", F.lit(-0.0))) == prints(df.withColumn("d", F.lit(0.0)))
    assert prints(df.limit(0)) == {}


def test_a_build_is_published_whole_and_once(spark, tmp_path):
    root, df = str(tmp_path / "p"), table(spark)
    assert projection.manifest(spark, root) is None
    with pytest.raises(FileNotFoundError):
        projection.read(spark, root)
    made = projection.build(df, root, ["k"], ["n"], "source-1")
    assert projection.build(df.repartition(5), root, ["k"], ["n"], "source-1") == made
    assert len(glob.glob(f"{root}/build-*")) == len(glob.glob(f"{root}/manifests/*.json")) == 1
    back = projection.read(spark, root)
    assert back.schema.simpleString() == df.schema.simpleString() and prints(back) == prints(df)
    assert projection.read(spark, root, k="u").count() == 3 and projection.read(spark, root, k=None).count() == 1 and projection.read(spark, root, k="").count() == 1
    assert "PartitionFilters: [isnotnull(partition_k" in projection.read(spark, root, k="u")._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        projection.read(spark, root, n=1)
    assert projection.drifted(spark, root).count() == 0
    # another build takes the place of the first, whose files stay for those who read them
    assert projection.build(df.where("k = 'u'"), root, ["k"], ["n"], "source-2") != made
    assert projection.read(spark, root).count() == 3 and back.count() == 6
    # a file that is lost shows
    held = projection.manifest(spark, root)["folder"]
    shutil.rmtree(f"{root}/{held}/rows/partition_k=u")
    assert [tuple(r) for r in projection.drifted(spark, root).collect()] == [("u", "missing")]
    with pytest.raises(ValueError):
        projection.build(df.withColumn("partition_k", F.lit(1)), root, ["k"], ["n"])


def test_a_hot_partition_lies_in_many_files(spark, tmp_path):
    df = spark.range(40_000).select(F.when(F.col("id") % 3 < 2, "hot").otherwise("cold").alias("k"), F.col("id").alias("n"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    projection.build(df, str(tmp_path), ["k"], ["n"])
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(glob.glob(f"{tmp_path}/build-*/rows/partition_k=hot/*.parquet")) > 1
    assert projection.read(spark, str(tmp_path)).count() == 40_000 and projection.drifted(spark, str(tmp_path)).count() == 0


def test_an_empty_projection(spark, tmp_path):
    projection.build(table(spark).limit(0), str(tmp_path), ["k"], ["n"])
    assert projection.read(spark, str(tmp_path)).count() == 0 and projection.drifted(spark, str(tmp_path)).count() == 0


def test_mapping_makes_its_pairs_once(spark):
    """The pairs come out of a large join, which every use of the claims ran again."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(rate):
        made.add(1)
        return rate

    pairs = spark.createDataFrame([(1, 2, 9, 8, 1.0, 1.0, 1.0), (2, 3, 9, 8, 1.0, 1.0, 1.0)], PAIR).withColumn("rate_a", counted.asNondeterministic()("rate_a"))
    assert actions.mapping(spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "ability long"), pairs).count() == 4
    assert made.value == 2
