"""Sources and sinks (survey 2.1, 2.2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import rows as R
from ..sources import readers, writers
from ..storage import new_path
from .common import t


@query("src_list_files")
def src_list_files(spark, sf):
    return readers.list_files(spark, f"{sf}/*.parquet").select(F.element_at(F.split("path", "/"), -1).alias("name"))


@query("src_slices", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, 'c')) v(k, s)")
def src_slices(spark, sf):
    return readers.from_slices(spark, [(1, "a"), (2, "b"), (3, "c")], "k int, s string")


@query("src_tensors", "SELECT 7 AS k, 'x' AS s")
def src_tensors(spark, sf):
    return readers.from_slices(spark, [(7, "x")], "k int, s string")


@query("src_range", "SELECT range AS id FROM range(1000)")
def src_range(spark, sf):
    return spark.range(1000)


@query("src_tfrecord", "SELECT o_orderkey, o_orderstatus FROM orders")
def src_tfrecord(spark, sf):
    """Written and read back with length-prefixed record framing."""
    path = new_path(spark, "records")
    writers.write_records(t(spark, sf, "orders").select(F.to_json(F.struct("o_orderkey", "o_orderstatus")).cast("binary").alias("record")), path)
    return readers.read_records(spark, path).select(F.from_json(F.col("record").cast("string"), "o_orderkey long, o_orderstatus string").alias("r")).select("r.*")


@query("src_examples", "SELECT o_orderkey, o_orderstatus, CAST(o_totalprice AS FLOAT) AS price, CAST(count(l_linenumber) AS BIGINT) AS n, CAST(coalesce(sum(l_partkey), 0) AS BIGINT) AS parts FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def src_examples(spark, sf):
    """Orders with the parts of their lines as Example records, written and parsed."""
    from ..sources import examples as X

    lines = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("parts"))
    o = t(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("price"), "parts")
    path = new_path(spark, "examples")
    writers.write_records(o.select(X.encode_examples(o, o.columns).alias("record")), path)
    e = readers.read_records(spark, path).select(X.parse_examples("record", "o_orderkey long, o_orderstatus string, price float, parts array<long>").alias("e")).select("e.*")
    return e.select("o_orderkey", "o_orderstatus", "price", F.size("parts").cast("long").alias("n"), F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + x).alias("parts"))


@query("src_textline", "SELECT doc_id, CAST(i - 1 AS BIGINT) AS line, l AS value FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)")
def src_textline(spark, sf):
    return readers.lines_of(t(spark, sf, "documents"), "text", ["doc_id"]).select("doc_id", F.col("line").cast("long"), "value")


@query("src_fixedlen", "SELECT o_orderkey AS a, o_custkey AS b FROM orders")
def src_fixedlen(spark, sf):
    """Two big-endian longs per 16-byte record, written and read back."""
    path = new_path(spark, "fixed")
    writers.write_fixed(t(spark, sf, "orders").select(F.concat(F.lpad(F.hex("o_orderkey"), 16, "0"), F.lpad(F.hex("o_custkey"), 16, "0")).alias("h")).select(F.unhex("h").alias("record")), path)
    number = lambda a: F.conv(F.hex(F.substring("record", a, 8)), 16, 10).cast("long")
    return readers.read_fixed(spark, path, 16).select(number(1).alias("a"), number(9).alias("b"))


@query("src_tfds_slice", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn FROM orders) WHERE rn >= 100 AND rn < 600")
def src_tfds_slice(spark, sf):
    return readers.split_slice(t(spark, sf, "orders"), 100, 600, "o_orderkey").select("o_orderkey")


@query("src_bigtable", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority LIKE '1%'")
def src_bigtable(spark, sf):
    return readers.prefix_scan(t(spark, sf, "orders"), "o_orderpriority", "1").select("o_orderkey", "o_orderpriority")


@query("src_synthetic", "SELECT CAST(0 AS BIGINT) AS c_custkey, '' AS c_name, 0 AS c_nationkey, CAST(0 AS DOUBLE) AS c_acctbal, '' AS c_mktsegment FROM range(64)")
def src_synthetic(spark, sf):
    return readers.synthetic(spark, t(spark, sf, "customer").schema, 64)


@query("src_source_only", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def src_source_only(spark, sf):
    from ..plans.spec import PipelineSpec, Stage

    spec = PipelineSpec([Stage("scan", "source", lambda s, d: t(s, d, "nation")), Stage("only_a", "filter", lambda df: df.where("n_name like 'A%'"))])
    return spec.source_only().build(spark, sf)


_TOP = "SELECT w, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS w FROM documents) WHERE w <> '' GROUP BY w ORDER BY n DESC, w LIMIT 500"
SQL_VOCAB = f"SELECT '<unk>' AS token, CAST(0 AS BIGINT) AS id UNION ALL SELECT '<s>', 1 UNION ALL SELECT '</s>', 2 UNION ALL SELECT w, 2 + row_number() OVER (ORDER BY n DESC, w) FROM ({_TOP})"


def vocabulary(spark, sf, size=500):
    from ..functions import text as X

    words = t(spark, sf, "documents").select(F.explode(X.words("text")).alias("w")).groupBy("w").count()
    return readers.vocabulary(words.orderBy(F.desc("count"), "w").limit(size), "w", [F.desc("count"), F.col("w")])


@query("src_vocab", SQL_VOCAB)
def src_vocab(spark, sf):
    """A vocabulary file with the special tokens in front, written, read back and verified."""
    path = new_path(spark, "vocab")
    writers.write_lines(vocabulary(spark, sf), path, "token", "id")
    return readers.load_vocabulary(spark, path)


@query("src_embed_txt", "SELECT CAST(vec_id AS VARCHAR) AS token, CAST(len(embedding) AS BIGINT) AS dim, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 3) + 0 AS total FROM embeddings")
def src_embed_txt(spark, sf):
    """Vectors as text with a header line and a line of the wrong width; both are recognised."""
    path = new_path(spark, "embed")
    e = t(spark, sf, "embeddings").select(F.concat_ws(" ", F.col("vec_id").cast("string"), F.transform("embedding", lambda x: x.cast("string"))).alias("value"))
    e.unionByName(spark.createDataFrame([("500 64",), ("bad 1 2",)], "value string")).write.text(path)
    out = readers.load_embeddings(spark, path)
    return out.select("token", F.size("vector").cast("long").alias("dim"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


@query("src_stats_file", "SELECT * FROM (VALUES ('interleave', 0, 40.0), ('map_decode', 1, 5.0), ('filter', 2, 200.0), ('map_augment', 3, 8.0), ('batch', 4, 60.0)) v(name, topo, per_core_rate)")
def src_stats_file(spark, sf):
    from ..plans import perfmodel as P

    path = new_path(spark, "stats")
    P.fixture(spark).write.parquet(path)
    return P.load(spark, path).select("name", "topo", F.col("per_core_rate").cast("decimal(4,1)"))


@query("src_csv", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def src_csv(spark, sf):
    path, n = new_path(spark, "csv"), t(spark, sf, "nation")
    writers.write_csv(n, path)
    return readers.read_csv(spark, path, n.schema)


@query("src_machine_cfg")
def src_machine_cfg(spark, sf):
    from ..plans.machine import Machine

    m = Machine.from_dict({"HOSTNAME": "h", "NUM_CORES": 8, "MEMORY": 4e9, "FILES": [{"PATH": "/x", "BANDWIDTH": 1e8, "AVAILABLE_SPACE": 10}]})
    return spark.createDataFrame([(m.hostname, m.num_cores, m.memory, len(m.files))], "hostname string, cores int, memory double, files int")


@query("src_fio")
def src_fio(spark, sf):
    return readers.scan_bandwidth(spark, f"{sf}/nation.parquet")


@query("src_filesizes")
def src_filesizes(spark, sf):
    return readers.file_sizes(spark, f"{sf}/*.parquet").select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")


@query("sink_records", "SELECT o_orderkey, o_totalprice FROM orders")
def sink_records(spark, sf):
    """At most 1000 records in a file."""
    path = new_path(spark, "sink")
    writers.write_table(t(spark, sf, "orders").select("o_orderkey", "o_totalprice"), path, 1000)
    return spark.read.parquet(path)


@query("sink_csv", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def sink_csv(spark, sf):
    path, s = new_path(spark, "csv"), t(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    writers.write_csv(s, path)
    return readers.read_csv(spark, path, s.schema)


@query("sink_trace", "SELECT 'orders' AS name, count(*) AS elements FROM orders")
def sink_trace(spark, sf):
    """Counts observed while the rows are written, kept as a trace table."""
    path = new_path(spark, "trace")
    writers.write_traced(t(spark, sf, "orders"), "orders", path)
    return spark.read.parquet(path)


@query("sink_params", "SELECT 'a' AS key, '1' AS value UNION ALL SELECT 'b', '2'")
def sink_params(spark, sf):
    path = new_path(spark, "params")
    writers.write_params(spark, {"a": 1, "b": 2}, path)
    return readers.read_params(spark, path)


@query("sink_dot", "SELECT * FROM (VALUES ('scan', 'filter'), ('filter', 'map'), ('map', 'batch')) v(src, dst)")
def sink_dot(spark, sf):
    from ..plans.spec import PipelineSpec, Stage

    return PipelineSpec([Stage(n, n, None) for n in ("scan", "filter", "map", "batch")]).edges(spark)


@query("sink_vocab", "SELECT '''' || token || '''' AS line FROM (" + SQL_VOCAB + ")")
def sink_vocab(spark, sf):
    path = new_path(spark, "vocab")
    writers.write_lines(vocabulary(spark, sf).withColumn("token", F.concat(F.lit("'"), "token", F.lit("'"))), path, "token", "id")
    return spark.read.text(path).withColumnRenamed("value", "line")
