"""Golden examples, invariants and plans."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluice.functions import detection as DT
from sluice.functions import images as I
from sluice.functions import metrics as M
from sluice.functions import text as X
from sluice.operators import boxes as B
from sluice.operators import packing as P
from sluice.operators import rows as R
from sluice.plans import perfmodel
from sluice.plans.machine import CPU_HOUR, GB_HOUR, SSD_HOUR_100MB, Machine
from sluice.plans.spec import PipelineSpec, Stage, same_result
from sluice.plans.trace import Monitor, benchmark, find_best_pipeline, optimize_pipeline, trace, trace_pipeline
from sluice.sources import readers, writers
from sluice.storage import new_path

SF = "/root/testdata/sf0.001"


def test_packing_example(spark):
    """Two examples become one row of ten; a 0 inside is stripped as padding."""
    df = spark.createDataFrame([(0, [8, 7, 1, 0], [4, 1, 0]), (1, [2, 3, 4, 1, 0], [5, 6, 1])], "i int, inputs array<int>, targets array<int>")
    (r,) = P.pack(df, "i", ["inputs", "targets"], 10, 2).collect()
    assert r.inputs == [8, 7, 1, 2, 3, 4, 1, 0, 0, 0] and r.inputs_segmentation == [1, 1, 1, 2, 2, 2, 2, 0, 0, 0]
    assert r.inputs_position == [0, 1, 2, 0, 1, 2, 3, 0, 0, 0] and r.targets == [4, 1, 5, 6, 1, 0, 0, 0, 0, 0]
    assert r.targets_segmentation == [1, 1, 2, 2, 2, 0, 0, 0, 0, 0]


def test_subtoken_discounting():
    counts = {"translate": 10, "t": 40, "tr": 16, "tra": 12}
    taken = dict(X.SubwordTokenizer.discount(counts, 5))
    assert taken == {"translate": 10, "tr": 6}  # tra falls to 2
    coder = X.SubwordTokenizer.learn({"lower_": 5, "lowest_": 4, "new_": 6}, 3)
    for w in ("lower_", "newest_", "slow_"[1:]):
        assert coder.decode(coder.encode_token(w)) == w
    with pytest.raises(ValueError):
        coder.encode_token("ß")


def test_fixture_of_the_model(spark):
    s = perfmodel.fixture(spark)
    rows = {r.name: r for r in perfmodel.max_min(s, 8).withColumn("n", perfmodel.rounded(F.col("theta"))).collect()}
    assert round(rows["batch"].x, 6) == 21.524664
    assert {k: round(r.theta, 6) for k, r in rows.items()} == {"interleave": 0.538117, "map_decode": 4.304933, "filter": 0.107623, "map_augment": 2.690583, "batch": 0.358744}
    assert [rows[k].n for k in ("interleave", "map_decode", "filter", "map_augment", "batch")] == [1, 5, 1, 3, 1]
    got = {r.cache: round(r.dollars, 6) for r in perfmodel.cost(s, 10.0, 20.0, CPU_HOUR, SSD_HOUR_100MB, GB_HOUR).collect()}
    assert got == {"none": 0.127131, "interleave": 0.114669, "map_decode": 0.059074, "filter": 0.057070}
    assert [perfmodel.cache_choice(s, m).first().name for m in (4e9, 3e9)] == ["filter", "interleave"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.floats(0.5, 100), st.booleans()), min_size=1, max_size=6), st.integers(1, 16), st.randoms())
def test_allocation_beats_any_other(spark_session, stages, cores, r):
    rows = [(f"s{i}", i, "map", rate, 1, par, False, 1, 1.0, 0.1, 1.0, 1, 1.0, 1.0, None) for i, (rate, par) in enumerate(stages)]
    got = perfmodel.max_min(spark_session.createDataFrame(rows, perfmodel.SCHEMA), cores).collect()
    x = got[0].x
    assert sum(g.theta for g in got) <= cores + 1e-6 and all(p or g.theta <= 1 + 1e-9 for g, (_, p) in zip(sorted(got, key=lambda g: g.topo), stages))
    for _ in range(30):
        cut = sorted(r.random() for _ in range(len(stages) - 1))
        theta = [(b - a) * cores for a, b in zip([0, *cut], [*cut, 1])]
        assert min(rate * min(t, cores if p else 1) for (rate, p), t in zip(stages, theta)) <= x + 1e-6


@pytest.fixture(scope="module")
def spark_session(spark):
    return spark


def test_usage_bounds(spark):
    for util in (0.1, 0.5, 0.9):
        rows = perfmodel.max_min_with_usage(perfmodel.fixture(spark), 8, util).collect()
        used = 8 * util - sum(min(r.cores_used, 1 if not r.is_parallel else 9) for r in rows)
        assert sum(r.theta for r in rows) <= 8 - max(used, 0) + 1e-6


def test_global_index_is_dense(spark):
    df = spark.range(5000).withColumn("h", F.xxhash64("id")).repartition(7)
    got = R.global_index(df, "h").orderBy("h").collect()
    assert [r.rn for r in got] == list(range(5000))


def test_shards_cover_and_are_disjoint(spark):
    df = spark.range(100)
    parts = [{r.id for r in R.shard(df, 7, k, "id").collect()} for k in range(7)]
    assert set.union(*parts) == set(range(100)) and sum(map(len, parts)) == 100


def test_unbatch_inverts_batch(spark):
    df = spark.range(103).withColumn("v", F.col("id") * 2)
    b = R.batch(df, 10, "id", ["id", "v"])
    assert b.count() == 11 and R.batch(df, 10, "id", ["id"], drop_remainder=True).count() == 10
    back = R.unbatch(b.drop("n"), ["id", "v"])
    assert same_result(back.select("id", "v"), df)
    assert same_result(R.unbatch(R.rebatch(b, 7, ["id", "v"]).drop("n"), ["id", "v"]).select("id", "v"), df)


def test_padding_refuses_longer_rows(spark):
    df = spark.createDataFrame([([1, 2, 3],)], "a array<int>")
    assert df.select(R.pad("a", 5, -1).alias("p")).first().p == [1, 2, 3, -1, -1]
    with pytest.raises(Exception, match="longer"):
        df.select(R.pad("a", 2, -1)).collect()


def test_shuffle_buffer_rule(spark):
    df = spark.range(500).coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = [r.id for r in R.shuffle_buffer(df, "id", 16, seed=3).orderBy("pos").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert sorted(got) == list(range(500)) and got != list(range(500))
    assert all(v <= k + 16 for k, v in enumerate(got))  # at most buffer - 1 places early


def test_empty_inputs(spark):
    none = spark.range(0).withColumn("v", F.array(F.lit(1)))
    for out in (R.shard(none, 3, 1, "id"), R.skip(none, 1, "id"), R.repeat(none, 2), R.repeat_take(none, 5, "id"), R.batch(none, 4, "id", ["id"]), R.padded_batch(none, 4, "id", ["v"], {"v": 0}), R.group_by_window(none, "id", 4, "id"), P.pack(none, "id", ["v"], 4, 4), R.shuffle_buffer(none, "id", 4)):
        assert out.count() == 0


def test_hot_key_windows_are_not_numbered_in_one_task(spark):
    df = spark.range(4000).withColumn("k", F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")))
    w = R.group_by_window(df, "k", 64, "id")
    plan = w._jdf.queryExecution().executedPlan().toString()
    assert "Window [row_number" not in plan
    hot = w.where("k = 'hot'").groupBy("window").count().collect()
    assert sorted(r["count"] for r in hot)[1:] == [64] * (len(hot) - 1)


def test_records_round_trip(spark):
    path = new_path(spark, "t")
    df = spark.createDataFrame([(bytes(range(n)),) for n in range(20)], "record binary")
    writers.write_records(df, path)
    assert sorted(bytes(r.record) for r in readers.read_records(spark, path, verify=True).collect()) == sorted(bytes(range(n)) for n in range(20))
    assert writers.masked_crc(b"123456789") == (((0xE3069283 >> 15) | (0xE3069283 << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def test_vocabulary_gets_special_tokens(spark, tmp_path):
    (tmp_path / "v").write_text("b\na\n")
    got = [r.token for r in readers.load_vocabulary(spark, f"file://{tmp_path}/v").orderBy("id").collect()]
    assert got == ["<unk>", "<s>", "</s>", "b", "a"]


def test_series_of_large_groups(spark, monkeypatch):
    """Groups cut into blocks give what one window gives."""
    from sluice.operators import series as S

    r = random.Random(11)
    rows = [(r.choice(["a", "a", "a", "b", None]), i, r.choice([1, 1, 1, 2]), float(r.choice([1, 2])), r.choice([True, False])) for i in range(240)]
    df = spark.createDataFrame(rows, "g string, i int, n int, s double, f boolean").repartition(4)
    runs = {
        "diff": lambda: S.diff(df, "n", "i", ["g"]), "rates": lambda: S.rates(df, "n", "s", "i", ["g"]), "plateau": lambda: S.plateau(df, "s", "i", ["g"]), "cycle": lambda: S.cycle(df, "n", "i", ["g"], 3),
        "converged": lambda: S.converged(df, "n", "s", "i", ["g"], 2, 0.2, 3.0), "segments": lambda: S.segments(df, "f", "n", "i", ["g"]), "position": lambda: S.position(df, "i", ["g"]),
    }
    flat = lambda d: sorted((repr({k: round(v, 9) if isinstance(v, float) else v for k, v in sorted(x.asDict().items())}) for x in d.collect()))
    whole = {k: flat(f()) for k, f in runs.items()}
    monkeypatch.setattr(S, "BLOCK", 8)
    assert all(len(v) for v in whole.values())
    for k, f in runs.items():
        assert flat(f()) == whole[k], k
    ties = spark.createDataFrame([("a", i // 3, i) for i in range(60)], "g string, i int, n int").withColumn("s", F.lit(1.0))
    got = {x.n: x.cumulative for x in S.rates(ties, "n", "s", "i", ["g"]).collect()}
    assert got == {i: sum(range(i // 3 * 3 + 3)) / (i // 3 * 3 + 3) for i in range(60)}


def test_example_records(spark):
    from sluice.sources import examples as E

    golden = bytes.fromhex("0a0d0a0b0a016112061a040a02ac02")
    assert E.encode({"a": [300]}) == golden and E.decode(golden) == {"a": [300]}
    assert E.decode(bytes.fromhex("0a0e0a0c0a016112071a05080108ac02")) == {"a": [1, 300]}  # numbers that are not packed
    r = random.Random(3)
    for _ in range(200):
        own = {"i": [r.randint(-(2**63), 2**63 - 1) for _ in range(r.randint(0, 4))], "f": [float(r.randint(-9, 9)) / 4 for _ in range(r.randint(1, 3))], "é": [bytes(r.randrange(256) for _ in range(r.randint(0, 300))) for _ in range(r.randint(1, 3))]}
        assert E.decode(E.encode(own)) == own
    with pytest.raises(ValueError):
        E.decode(golden[:-1])
    df = spark.createDataFrame([(E.encode({"k": [7], "s": ["x"], "v": [1, 2]}),), (E.encode({}),), (None,)], "r binary")
    got = df.select(E.parse_examples("r", "k long, s string, v array<long>", {"k": -1}).alias("e")).collect()
    assert [tuple(x.e) if x.e else None for x in got] == [(7, "x", [1, 2]), (-1, None, []), None]


def test_parallelism_is_in_the_plan(spark):
    from sluice.queries.analysis import demo

    plan = lambda spec: spec.build(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    plain, wide = demo(), demo().set_parallelism({"decode": 5, "sums": 2}).raise_parallelism("decode")
    assert "Repartition" not in plan(plain) and "Repartition 6" in plan(wide) and "Repartition 2" in plan(wide)
    assert wide.prefix("decode").build(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 6
    assert "Repartition" not in plan(wide.reset_parallelism())


@pytest.mark.parametrize("few", [10**6, 2])
def test_positions_of_many_keys(spark, monkeypatch, few):
    """By a broadcast, and by a shuffle beside the broadcast of hot keys; a null is a key."""
    from sluice.operators import joins

    monkeypatch.setattr(joins, "BROADCAST_ROWS", few)
    monkeypatch.setattr(R, "HOT_ROWS", 20)
    monkeypatch.setattr(R, "HOT_KEYS", 10**9)
    r = random.Random(8)
    rows = [(r.choice([1, 1, 1, 2, None, *range(3, 40)]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, i int").repartition(5)
    got = {x.i: x.rn for x in R.key_index(df, "k", "i").collect()}
    seen, want = {}, {}
    for k, i in rows:
        want[i] = seen[k] = seen.get(k, -1) + 1
    assert got == want
    full = {x.i: (x.window, x.at) for x in R.group_by_window(df, "k", 3, "i", drop_remainder=True).collect()}
    assert full == {i: (n // 3, n % 3) for (k, i), n in ((row, want[row[1]]) for row in rows) if (n // 3 + 1) * 3 <= seen[k] + 1}


def test_subwords_are_learned_from_all_words(spark, monkeypatch):
    """The frequent pieces, and the vocabulary, equal those of plain loops over whole words; beginnings are counted in steps."""
    monkeypatch.setattr(X, "FIRST_CHARS", 3)
    r = random.Random(6)
    parts = ["un", "happi", "ness", "ly", "re", "do", "ing", "é", "a"]
    counts = {}
    for _ in range(120):
        w = "".join(r.choice(parts) for _ in range(r.randint(1, 6))) + "_"
        counts[w] = counts.get(w, 0) + r.randint(1, 5)
    words = spark.createDataFrame(list(counts.items()), "w string, n long").repartition(4)
    for vocabulary in (None, sorted({c for w in counts for c in w} | {"un", "happi", "ing_"}, key=lambda p: (-len(p), p))):
        want = X.SubwordTokenizer.count_pieces(counts, set(vocabulary) if vocabulary else None, 10**6)
        for least in (1, 7, 30):
            assert X.piece_counts(words, vocabulary, least) == {p: n for p, n in want.items() if n >= least}
    plain = X.SubwordTokenizer.learn(counts, 20, 2, 10**6).vocabulary
    assert X.learn_subwords(words, len(plain), 1, 2, (20, 20)) == plain
    target = len(plain) + 10
    got = X.learn_subwords(words, target, 4, 2, (1, 60))
    assert abs(len(got) - target) <= abs(len(plain) - target) and set("unhapi_") <= set(got)
    assert set(X.learn_subwords(words.limit(0), 10, 2)) == set("\\_u;0123456789")


def test_nms_is_greedy(spark):
    rows = [(1, 0, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 1, 0.0, 0.0, 10.0, 9.0, 0.8), (1, 2, 20.0, 20.0, 30.0, 30.0, 0.7), (2, 0, 0.0, 0.0, 1.0, 1.0, 0.1)]
    df = spark.createDataFrame(rows, "img int, k int, ymin double, xmin double, ymax double, xmax double, score double")
    assert {(r.img, r.k) for r in B.nms(df, ["img"], "score", "k", 0.5, 10).collect()} == {(1, 0), (1, 2), (2, 0)}


def test_perfect_detections_have_full_precision(spark):
    t = spark.createDataFrame([(i, c, k, 10.0 * k, 0.0, 10.0 * k + 5, 5.0) for i in range(3) for c in (1, 2) for k in range(4)], "img long, class long, k long, ymin double, xmin double, ymax double, xmax double")
    got = DT.coco(t, t.withColumn("score", F.lit(1.0) / (1 + F.col("k")))).collect()
    assert len(got) == 20 and all(r.ap == 1 and r.recall == 1 for r in got)


def test_auc_of_one_class_is_null(spark):
    df = spark.createDataFrame([(0.1, 1), (0.2, 1), (0.3, -1)], "s double, y int")
    assert M.roc_auc(df, "s", "y").first().auc is None
    df = spark.createDataFrame([(0.9, 1), (0.5, 1), (0.5, 0), (0.1, 0)], "s double, y int")
    assert M.roc_auc(df, "s", "y").first().auc == 0.875


def test_bleu_of_equal_texts(spark):
    df = spark.createDataFrame([(1, "a b c d e".split(), "a b c d e".split())], "i int, h array<string>, r array<string>")
    s = M.corpus_stats(df, "h", "r", ["i"])
    assert M.bleu_simple(s).first().bleu == pytest.approx(1) and M.bleu_exponential(s).first().bleu == pytest.approx(100) and M.bleu_smoothed(s).first().bleu == pytest.approx(100)


MOSES = [
    ("he said „ hello “ and left", 'he said „hello“ and left'),
    ("the dogs ' bowl", "the dogs' bowl"),
    ("it cost £ 5 , or € 6 .", "it cost £5, or €6."),
    ("do n't , it 's Bob ’s", "do n't, it's Bob’s"),
    ("a ( b ) [ c ] { d }", "a (b) [c] {d}"),
    ("' a ' and ' b '", "'a' and 'b'"),
    ("50 % of C : \\ ; x", "50% of C:\\; x"),
    ('" x " y', '"x" y'),
    ("", ""),
]


@pytest.mark.parametrize("text, want", MOSES)
def test_moses_marks(text, want):
    assert X.moses_join(text.split()) == want


def test_moses(spark):
    df = spark.createDataFrame([('He said , " go ( now ) ! "',)], "t string")
    assert df.select(X.moses_detokenize("t").alias("d")).first().d == 'He said, "go (now)!"'


def test_moving_images(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5, 6],)], "p array<int>")
    one = lambda op, v: df.select(I.geometric("p", op, 2, 3, v).alias("x")).first().x
    assert one("translate_x", 1.0) == [2, 3, 0, 5, 6, 0] and one("rotate", 180.0) == [6, 5, 4, 3, 2, 1] and one("cutout", 5.0) == [0] * 6


def test_specs_and_traces(spark):
    spec = PipelineSpec([Stage("scan", "source", lambda s, d: s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey")), Stage("keep", "filter", lambda df: df.where("o_custkey > 50")), Stage("sum", "map", lambda df: df.withColumn("s", F.col("o_orderkey") + 1))])
    stats = trace(spec, spark, SF)
    assert stats.count() == 3 and stats.where("per_core_rate <= 0").count() == 0
    run = optimize_pipeline(cores=4)(lambda: spec)
    assert same_result(run(spark, SF), spec.build(spark, SF))
    path = new_path(spark, "trace")
    assert trace_pipeline(lambda s: path)(lambda: spec)(spark, SF).count() == spec.build(spark, SF).count() and spark.read.parquet(path).count() == 3
    assert find_best_pipeline({"n": [1, 2]}, 1.0)(lambda n: spec.set_parallelism({"sum": n}))(spark, SF).count() > 0
    assert spec.insert_cache("keep").remove_caches().stages == spec.stages
    with pytest.raises(ValueError):
        PipelineSpec([spec.stages[0], spec.stages[0]])
    with pytest.raises(ValueError):
        PipelineSpec(spec.stages[1:]).source_only()
    with Monitor(0.02) as m:
        b = benchmark(spec.build(spark, SF), 5, batch=100)
    assert b["elements"] > 0 and m.frame(spark).count() >= 1


def test_machine_needs_its_fields():
    with pytest.raises(ValueError):
        Machine.from_dict({"HOSTNAME": "h"})


def test_filters_and_columns_reach_the_scan(spark):
    from sluice import catalog

    plan = catalog.queries()["filter_query"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "EqualTo(o_orderstatus,F)" in plan and "LessThan(o_custkey,700)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string>" in plan
    plan = catalog.queries()["topk_per_class"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # rows are limited before the shuffle


def test_streams(spark, tmp_path):
    from sluice.streaming import windows

    rows = [(i, "ab"[random.Random(i).random() < 0.3]) for i in range(200)]
    spark.createDataFrame(rows, "v long, k string").repartition(4).write.parquet(f"{tmp_path}/s.parquet")
    got = windows.run_count_window(spark, f"{tmp_path}/s.parquet", "k", "v", 20).groupBy("k").agg(F.count("*").alias("w"), F.sum("n").alias("n")).collect()
    for r in got:
        size = sum(k == r.k for _, k in rows)
        assert r.w == size // 20 and r.n == 20 * r.w


def test_subwords_are_learned_in_chunks(spark, monkeypatch):
    """The same vocabulary for any size of chunks, with few jobs; encoding equals the plain encoder, for nulls and odd white space too."""
    r = random.Random(9)
    parts = ["un", "happi", "ness", "ly", "re", "do", "ing", "é", "😀a", "\\u"]
    counts = {}
    for _ in range(400):
        w = "".join(r.choice(parts) for _ in range(r.randint(1, 6))) + "_"
        counts[w] = counts.get(w, 0) + r.randint(1, 5)
    words = spark.createDataFrame(list(counts.items()), "w string, n long").repartition(3)
    every = X.SubwordTokenizer.count_pieces(counts, None, 10**6)
    plain = X.SubwordTokenizer.learn(counts, 30, 4, 10**6).vocabulary
    for size, least in ((7, 10**6), (50, 0), (10**6, 0)):
        monkeypatch.setattr(X, "CHUNK_WORDS", size)
        monkeypatch.setattr(X, "CHUNK_LEAST", least)
        assert {p for p, n in every.items() if n >= 30} <= set(X.frequent_pieces(words, 30))
        assert X._Segments(words, 30).counts == {p: n for p, n in every.items() if n >= 30}
        assert X.learn_subwords(words, len(plain), 1, 4, (30, 30)) == plain
    monkeypatch.setattr(X, "ENCODE_CHARS", 40)
    texts = [None, "", " ", *(" \t\n"[i % 3].join(r.choices([w[:-1].replace("\\u", "_") for w in counts], k=i % 9)) for i in range(60))]
    coder = X.SubwordTokenizer(plain)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(4)
    got = {x.i: x.ids for x in df.select("i", X.subword_encode("text", plain).alias("ids")).collect()}
    escaped = lambda w: w.replace("\\", "\\\\").replace("_", "\\u") + "_"
    assert got == {i: [k for w in (t or "").split() for k in coder.encode_token(escaped(w))] for i, t in enumerate(texts)}
