"""Projections, predicates and scalar functions (survey 2.3, 2.10, 2.11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import images as I
from ..functions import text as X
from ..operators import boxes as B
from ..operators import rows as R
from .common import sql_hash, sql_hash01, t

W = r"list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> '')"
DW = W.format("text")


def docs(spark, sf):
    return t(spark, sf, "documents")


@query("map_project", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
def map_project(spark, sf):
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"))


@query("map_rename", "SELECT doc_id, text AS inputs, lang AS targets FROM documents")
def map_rename(spark, sf):
    return docs(spark, sf).select("doc_id", "text", "lang").withColumnsRenamed({"text": "inputs", "lang": "targets"})


@query("map_cast", "SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey FROM orders")
def map_cast(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return o.select(*[F.col(c).cast("int") for c in o.columns])


@query("map_todict", "SELECT n_nationkey, n_name, 'nation' AS kind FROM nation")
def map_todict(spark, sf):
    return t(spark, sf, "nation").select(F.struct(F.struct("n_nationkey", "n_name").alias("features"), F.struct(F.lit("nation").alias("kind")).alias("labels")).alias("e")).select("e.features.*", "e.labels.*")


@query("map_const_flag", "SELECT s_suppkey, true AS is_padded FROM supplier")
def map_const_flag(spark, sf):
    return t(spark, sf, "supplier").select("s_suppkey", F.lit(True).alias("is_padded"))


@query("map_onehot", "SELECT p_partkey, array_to_string(list_transform(range(1, 51), lambda i: CASE WHEN i = p_size THEN 1 ELSE 0 END), '') AS onehot FROM part")
def map_onehot(spark, sf):
    return t(spark, sf, "part").select("p_partkey", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(50)), lambda i: (i == F.col("p_size")).cast("int").cast("string")), "").alias("onehot"))


_REMAP = {"ASIA": 0, "EUROPE": 1, "AFRICA": 2}


@query("map_class_remap", "SELECT r_regionkey, CAST(CASE r_name WHEN 'ASIA' THEN 0 WHEN 'EUROPE' THEN 1 WHEN 'AFRICA' THEN 2 ELSE -1 END AS INTEGER) AS class FROM region")
def map_class_remap(spark, sf):
    table = F.create_map(*[F.lit(x) for p in _REMAP.items() for x in p])
    return t(spark, sf, "region").select("r_regionkey", F.coalesce(F.try_element_at(table, "r_name"), F.lit(-1)).alias("class"))


@query("map_default", "SELECT conv_id, turn, coalesce(TRY_CAST(CASE WHEN text = '' THEN '-1' ELSE text END AS BIGINT), -1) AS v FROM conversations")
def map_default(spark, sf):
    c = t(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.coalesce(F.when(F.col("text") == "", "-1").otherwise(F.trim("text")).try_cast("long"), F.lit(-1)).alias("v"))


@query("map_cond", "SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN '' ELSE o_orderstatus END AS v FROM orders")
def map_cond(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_totalprice") < 50000, F.lit("")).otherwise(F.col("o_orderstatus")).alias("v"))


@query("filter_pred", "SELECT o_orderkey FROM orders WHERE o_custkey < 500")
def filter_pred(spark, sf):
    return t(spark, sf, "orders").where("o_custkey < 500").select("o_orderkey")


# source tokens from the text, target tokens from the first turn with the same number
PAIRS_SQL = f"(SELECT d.doc_id, {W.format('d.text')} AS src, {W.format('c.text')} AS tgt FROM documents d JOIN conversations c ON d.doc_id = c.conv_id AND c.turn = (SELECT min(turn) FROM conversations))"


def pairs(spark, sf):
    c = t(spark, sf, "conversations")
    first = c.agg(F.min("turn").alias("m"))
    c = c.join(F.broadcast(first), F.col("turn") == F.col("m")).select(F.col("conv_id").alias("doc_id"), X.words("text").alias("tgt"))
    return docs(spark, sf).select("doc_id", X.words("text").alias("src")).join(c, "doc_id")


@query("filter_nonempty", f"SELECT doc_id, CAST(len(src) AS INTEGER) AS s, CAST(len(tgt) AS INTEGER) AS t FROM {PAIRS_SQL} WHERE len(src) > 0 AND len(tgt) > 0")
def filter_nonempty(spark, sf):
    return pairs(spark, sf).where("size(src) > 0 and size(tgt) > 0").select("doc_id", F.size("src").alias("s"), F.size("tgt").alias("t"))


@query("filter_oversize", f"SELECT doc_id, len(src) <= 148 AND len(tgt) <= 149 AS single, len(src) < 150 AND len(tgt) < 150 AS multi FROM {PAIRS_SQL}")
def filter_oversize(spark, sf):
    """Both bounds: the single-host one leaves room for the end markers."""
    return pairs(spark, sf).select("doc_id", F.expr("size(src) <= 148 and size(tgt) <= 149").alias("single"), F.expr("size(src) < 150 and size(tgt) < 150").alias("multi"))


@query("filter_maxlen", f"SELECT doc_id FROM {PAIRS_SQL} WHERE greatest(len(src), len(tgt)) <= 64")
def filter_maxlen(spark, sf):
    return pairs(spark, sf).where(F.greatest(F.size("src"), F.size("tgt")) <= 64).select("doc_id")


@query("filter_hasboxes", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def filter_hasboxes(spark, sf):
    return t(spark, sf, "orders").join(t(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("filter_notcrowd", "SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) AS kept FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_orderkey")
def filter_notcrowd(spark, sf):
    """Drop flagged elements inside each row's array; rows left without any go."""
    a = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("e"))
    a = a.withColumn("e", F.filter("e", lambda x: x.l_returnflag != "R")).where(F.size("e") > 0)
    return a.select("l_orderkey", F.array_join(F.transform("e", lambda x: x.l_linenumber.cast("string")), ",").alias("kept"))


@query("filter_orientation", "SELECT l_orderkey, l_linenumber, l_quantity > l_discount * 500 AS landscape FROM lineitem WHERE l_quantity > l_discount * 500 UNION ALL SELECT l_orderkey, l_linenumber, l_quantity > l_discount * 500 FROM lineitem WHERE NOT l_quantity > l_discount * 500")
def filter_orientation(spark, sf):
    rows = t(spark, sf, "lineitem").withColumn("landscape", F.col("l_quantity") > F.col("l_discount") * 500).select("l_orderkey", "l_linenumber", "landscape")
    return rows.where("landscape").unionByName(rows.where("not landscape"))


BOX_SQL = "(SELECT l_orderkey AS img, l_linenumber AS k, CAST((l_partkey * 7) % 100 AS DOUBLE) AS ymin, CAST((l_suppkey * 13) % 90 AS DOUBLE) AS xmin, CAST((l_partkey * 7) % 100 + 1 + l_quantity AS DOUBLE) AS ymax, CAST((l_suppkey * 13) % 90 + 1 + (l_orderkey + l_linenumber * 11) % 40 AS DOUBLE) AS xmax, l_extendedprice AS score, CAST(l_partkey % 5 AS BIGINT) AS class FROM lineitem)"


def boxes(spark, sf):
    """Boxes of an image from the numbers of an order's lines."""
    y, x = (F.col("l_partkey") * 7) % 100, (F.col("l_suppkey") * 13) % 90
    return t(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("img"), F.col("l_linenumber").alias("k"), y.cast("double").alias("ymin"), x.cast("double").alias("xmin"), (y + 1 + F.col("l_quantity")).cast("double").alias("ymax"),
        (x + 1 + (F.col("l_orderkey") + F.col("l_linenumber") * 11) % 40).cast("double").alias("xmax"), F.col("l_extendedprice").alias("score"), (F.col("l_partkey") % 5).alias("class"),
    )


def rounded(cols, names, digits=4):
    return [F.round(c, digits).alias(n) for c, n in zip(cols, names)]


_KEEP = "(ymax - ymin >= greatest(4, 1) * 1.5 AND xmax - xmin >= greatest(4, 1) * 1.5 AND (ymin + ymax) / 2 < 100 AND (xmin + xmax) / 2 < 100)"


@query("filter_proposals", "SELECT img, k, " + ", ".join(f"CASE WHEN {_KEEP} THEN {c} ELSE 0 END AS {c}" for c in B.SIDES) + f" FROM {BOX_SQL}")
def filter_proposals(spark, sf):
    b = boxes(spark, sf)
    return b.select("img", "k", *[c.alias(n) for c, n in zip(B.proposal_mask(B.box(), 4.0, F.lit(1.5), F.lit(100.0), F.lit(100.0)), B.SIDES)])


@query("filter_map_fused", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity * l_extendedprice > 500000")
def filter_map_fused(spark, sf):
    return t(spark, sf, "lineitem").withColumn("ok", F.col("l_quantity") * F.col("l_extendedprice") > 500000).where("ok").select("l_orderkey", "l_linenumber")


@query("filter_query", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey < 700")
def filter_query(spark, sf):
    return t(spark, sf, "orders").where("o_orderstatus = 'F' and o_custkey < 700").select("o_orderkey")


# ------------------------------------------------------------------ scalar functions


@query("fn_split", f"SELECT doc_id, CAST(len({DW}) AS BIGINT) AS n, coalesce({DW}[1], '') AS first FROM documents")
def fn_split(spark, sf):
    w = X.words("text")
    return docs(spark, sf).select("doc_id", F.size(w).cast("long").alias("n"), F.coalesce(F.try_element_at(w, F.lit(1)), F.lit("")).alias("first"))


_RUNS = r"list_filter(regexp_extract_all(text, '([\p{L}\p{N}]+|[^\p{L}\p{N}]+)'), lambda r, i: r <> ' ' OR i = 1)"


@query("fn_alnum_runs", f"SELECT doc_id, CAST(len({_RUNS}) AS BIGINT) AS n, md5(array_to_string({_RUNS}, '|')) AS h FROM documents")
def fn_alnum_runs(spark, sf):
    a = X.alnum_runs("text")
    return docs(spark, sf).select("doc_id", F.size(a).cast("long").alias("n"), F.md5(F.array_join(a, "|").cast("binary")).alias("h"))


@query("fn_join_runs", "SELECT doc_id, true AS same FROM documents")
def fn_join_runs(spark, sf):
    """Splitting into runs and joining them gives the text back, apart from lone spaces between marks."""
    d = docs(spark, sf).withColumn("a", X.alnum_runs("text")).withColumn("b", X.join_runs("a"))
    squash = lambda c: F.regexp_replace(c, " ", "")
    return d.select("doc_id", (squash(F.col("b")) == squash(F.col("text"))).alias("same"))


@query("fn_escape", r"SELECT doc_id, md5(replace(replace(replace(text, '\', '\\'), '_', '\u'), chr(10), '\10;') || '_') AS h, true AS inverse FROM documents")
def fn_escape(spark, sf):
    d = docs(spark, sf).withColumn("e", X.escape_token("text"))
    return d.select("doc_id", F.md5(F.col("e").cast("binary")).alias("h"), (X.unescape_token("e") == F.col("text")).alias("inverse"))


def _pieces(spark, sf):
    """A vocabulary of about 500 pieces, learned from the counts of all words."""
    w = docs(spark, sf).select(F.explode(X.words("text")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return X.learn_subwords(w.select(X.escape_token("w").alias("w"), "n"), 500, 50)


@query("fn_subword_encode")
def fn_subword_encode(spark, sf):
    return docs(spark, sf).select("doc_id", F.size(X.subword_encode("text", _pieces(spark, sf))).cast("long").alias("n"))


@query("fn_subword_learn")
def fn_subword_learn(spark, sf):
    return spark.createDataFrame([(i, p) for i, p in enumerate(_pieces(spark, sf))], "id int, piece string")


@query("fn_sentencepiece")
def fn_sentencepiece(spark, sf):
    """Ids by a public sentencepiece model, with the end id; training is left out."""
    import public_tokenizers

    return docs(spark, sf).select("doc_id", F.size(X.sentencepiece_encode("text", public_tokenizers.path("piece_bpe_32k.model"))).cast("long").alias("n"))


@query("fn_joins", f"SELECT doc_id, md5(replace(array_to_string({DW}, ' '), '@@ ', '')) AS bpe, md5(ltrim(replace(array_to_string({DW}, ''), '▁', ' '), ' ')) AS spm, md5(array_to_string(CASE WHEN list_position({DW}, 'the') > 0 THEN {DW}[1 : list_position({DW}, 'the') - 1] ELSE {DW} END, ' ')) AS cut FROM documents")
def fn_joins(spark, sf):
    d = docs(spark, sf).withColumn("w", X.words("text"))
    h = lambda c: F.md5(c.cast("binary"))
    return d.select("doc_id", h(X.join_bpe("w")).alias("bpe"), h(X.join_spm("w")).alias("spm"), h(F.array_join(X.cut_at("w", "the"), " ")).alias("cut"))


@query("fn_moses")
def fn_moses(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(X.moses_detokenize("text").cast("binary")).alias("h"))


def _sql_replace(text, pairs):
    for a, b in pairs:
        text = "replace({}, '{}', '{}')".format(text, a.replace("'", "''"), b.replace("'", "''"))
    return text


@query("fn_deescape", f"SELECT page_id, md5({_sql_replace('html', X.HTML)}) AS h FROM pages")
def fn_deescape(spark, sf):
    return t(spark, sf, "pages").select("page_id", F.md5(X.deescape_html("html").cast("binary")).alias("h"))


_13A = "' ' || " + "replace(replace(replace(replace(replace(replace(replace(text, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' '), '&quot;', '\"'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>')" + " || ' '"
_13A = rf"regexp_replace({_13A}, '([\{{-\~\[-\` -\&\(-\+\:-\@\/])', ' \1 ', 'g')"
_13A = rf"regexp_replace({_13A}, '([^0-9])([\.,])', '\1 \2 ', 'g')"
_13A = rf"regexp_replace({_13A}, '([\.,])([^0-9])', ' \1 \2', 'g')"
_13A = rf"regexp_replace({_13A}, '([0-9])(-)', '\1 \2 ', 'g')"
_13A = rf"trim(regexp_replace({_13A}, '\s+', ' ', 'g'))"


@query("fn_tokenize_13a", f"SELECT doc_id, md5({_13A}) AS h FROM documents")
def fn_tokenize_13a(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(X.tokenize_13a("text").cast("binary")).alias("h"))


_INTL = r"regexp_replace(text, '(\P{N})(\p{P})', '\1 \2 ', 'g')"
_INTL = rf"regexp_replace({_INTL}, '(\p{{P}})(\P{{N}})', ' \1 \2', 'g')"
_INTL = rf"regexp_replace({_INTL}, '(\p{{S}})', ' \1 ', 'g')"
_INTL = rf"trim(regexp_replace({_INTL}, '\s+', ' ', 'g'))"


@query("fn_tokenize_intl", f"SELECT conv_id, turn, md5({_INTL}) AS h FROM conversations")
def fn_tokenize_intl(spark, sf):
    return t(spark, sf, "conversations").select("conv_id", "turn", F.md5(X.tokenize_international("text").cast("binary")).alias("h"))


@query("fn_case_space", r"SELECT doc_id, md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS h FROM documents")
def fn_case_space(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(X.squeeze(F.lower("text")).cast("binary")).alias("h"))


_B = "list_transform(range(1, 15), lambda i: CASE WHEN i <= least(length(p_brand), 14) THEN ascii(substr(p_brand, i, 1)) + 1 WHEN i = least(length(p_brand), 14) + 1 THEN 258 ELSE 259 END)"


@query("fn_byte_ids", f"SELECT p_partkey, array_to_string([257] || {_B} || [CASE WHEN least(length(p_brand), 14) = 14 THEN 258 ELSE 259 END], ',') AS ids FROM part")
def fn_byte_ids(spark, sf):
    return t(spark, sf, "part").select("p_partkey", F.array_join(F.transform(X.byte_ids("p_brand", 16), lambda x: x.cast("string")), ",").alias("ids"))


@query("fn_names", "SELECT page_id, split_part(url, '/', 3) AS host, regexp_replace(url, '[^ -~]', '', 'g') AS printable FROM pages")
def fn_names(spark, sf):
    return t(spark, sf, "pages").select("page_id", F.split_part("url", F.lit("/"), F.lit(3)).alias("host"), F.regexp_replace("url", "[^ -~]", "").alias("printable"))


@query("fn_log_scrape", "SELECT event_id, CAST(regexp_extract('mean minibatch rate: ' || CAST(event_id AS VARCHAR) || '.5', 'mean minibatch rate: ([0-9.]+)', 1) AS DOUBLE) AS rate FROM events")
def fn_log_scrape(spark, sf):
    line = F.concat(F.lit("mean minibatch rate: "), F.col("event_id").cast("string"), F.lit(".5"))
    return t(spark, sf, "events").select("event_id", F.regexp_extract(line, r"mean minibatch rate: ([0-9.]+)", 1).cast("double").alias("rate"))


@query("fn_hash_bucket", f"SELECT c_custkey, CAST(('0x' || substr({sql_hash('c_custkey')}, 1, 8)) AS BIGINT) % 97 AS bucket FROM customer")
def fn_hash_bucket(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", (F.conv(F.substring(R.hash_key("c_custkey"), 1, 8), 16, 10).cast("long") % 97).alias("bucket"))


@query("fn_math", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) // 7 AS q, round(ln(l_extendedprice), 6) AS l, round(exp(-l_discount), 6) AS e, least(greatest(l_quantity, 10), 40) AS c, ceil(l_quantity / 3) AS up FROM lineitem")
def fn_math(spark, sf):
    q = F.col("l_quantity")
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.expr("cast(l_quantity as bigint) div 7").alias("q"), F.round(F.log("l_extendedprice"), 6).alias("l"), F.round(F.exp(-F.col("l_discount")), 6).alias("e"), F.least(F.greatest(q, F.lit(10.0)), F.lit(40.0)).alias("c"), F.ceil(q / 3).cast("double").alias("up"))


@query("fn_box_geometry", f"SELECT img, k, (ymax - ymin) * (xmax - xmin) AS area, (ymin + ymax) / 2 AS yc, (xmin + xmax) / 2 AS xc, round(1 - xmax / 200, 6) AS flip, least(greatest(ymin, 0), 50) AS clip, round(ymin * 0.5, 6) AS scaled, ymin * 480 AS denorm FROM {BOX_SQL}")
def fn_box_geometry(spark, sf):
    b = boxes(spark, sf)
    y, x, h, w = B.centre_size(B.box())
    return b.select("img", "k", B.area(B.box()).alias("area"), (F.col("ymin") + h / 2).alias("yc"), (F.col("xmin") + w / 2).alias("xc"), F.round(B.flip([c / 200 for c in B.box()])[1], 6).alias("flip"), B.clip(B.box(), 50.0, 50.0)[0].alias("clip"), F.round(B.scale(B.box(), 0.5, 0.5)[0], 6).alias("scaled"), B.denormalize(B.box(), F.lit(480.0), F.lit(640.0))[0].alias("denorm"))


_ANCHOR = [10.0, 20.0, 60.0, 50.0]
_ENC = "round(10 * ((ymin + ymax) / 2 - 35) / 50, 4) AS ty, round(10 * ((xmin + xmax) / 2 - 35) / 30, 4) AS tx, round(5 * ln((ymax - ymin) / 50), 4) AS th, round(5 * ln((xmax - xmin) / 30), 4) AS tw"


@query("fn_box_codec", f"SELECT img, k, {_ENC}, true AS inverse FROM {BOX_SQL}")
def fn_box_codec(spark, sf):
    anchor, scales = [F.lit(x) for x in _ANCHOR], (10, 10, 5, 5)
    code = B.encode(B.box(), anchor, scales)
    back = B.decode(code, anchor, scales)
    same = F.greatest(*[F.abs(a - c) for a, c in zip(back, B.box())]) < 1e-4
    return boxes(spark, sf).select("img", "k", *rounded(code, ("ty", "tx", "th", "tw")), same.alias("inverse"))


@query("fn_box_codec_pixels", f"SELECT img, k, round((ymin + (ymax - ymin + 1) / 2 - 35.5) / 51, 4) AS ty, round(ln((ymax - ymin + 1) / 51), 4) AS th, true AS inverse FROM {BOX_SQL}")
def fn_box_codec_pixels(spark, sf):
    anchor = [F.lit(x) for x in _ANCHOR]
    code = B.encode_pixels(B.box(), anchor)
    same = F.greatest(*[F.abs(a - c) for a, c in zip(B.decode_pixels(code, anchor), B.box())]) < 1e-6
    return boxes(spark, sf).select("img", "k", F.round(code[0], 4).alias("ty"), F.round(code[2], 4).alias("th"), same.alias("inverse"))


@query("fn_box_expand", f"SELECT img, k, (ymin + ymax) / 2 - (ymax - ymin) * 0.75 AS ymin, (xmin + xmax) / 2 + (xmax - xmin) * 0.75 AS xmax FROM {BOX_SQL}")
def fn_box_expand(spark, sf):
    b = B.expand(B.box(), 1.5)
    return boxes(spark, sf).select("img", "k", b[0].alias("ymin"), b[3].alias("xmax"))


@query("fn_lr_schedule", "SELECT range AS step, round(CASE WHEN range < 100 THEN 0.02 * (0.1 + 0.9 * range / 100) WHEN range < 600 THEN 0.02 WHEN range < 800 THEN 0.002 ELSE 0.0002 END, 8) AS lr FROM range(1000)")
def fn_lr_schedule(spark, sf):
    s = F.col("step")
    return spark.range(1000).withColumnRenamed("id", "step").select("step", F.round(I.learning_rate(s, 0.02, 100, 0.1, [(600, 0.1), (800, 0.01)]), 8).alias("lr"))


@query("fn_resize_scale", "SELECT l_orderkey, l_linenumber, CAST(trunc((100 + l_partkey % 700) * least(800.0 / least(100 + l_partkey % 700, 100 + l_suppkey % 900), 1333.0 / greatest(100 + l_partkey % 700, 100 + l_suppkey % 900))) AS BIGINT) AS h FROM lineitem")
def fn_resize_scale(spark, sf):
    h, w = 100 + F.col("l_partkey") % 700, 100 + F.col("l_suppkey") % 900
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", I.resized(h, w, 800.0, 1333.0)[0].alias("h"))


_ASPECT = [(1.0, 1.0), (1.4, 0.7), (0.7, 1.4)]
_ANCHORS = """SELECT CAST(l AS INTEGER) AS level, CAST(o AS INTEGER) AS octave, CAST(a AS INTEGER) AS aspect, CAST(y AS INTEGER) AS gy, CAST(x AS INTEGER) AS gx,
 round(s / 2 + y * s - 4.0 * s * ay / 2 * power(2.0, o / 3.0), 4) AS ymin, round(s / 2 + x * s + 4.0 * s * ax / 2 * power(2.0, o / 3.0), 4) AS xmax
 FROM (SELECT l, power(2, l) AS s FROM (SELECT unnest(range(5, 8)) AS l)) JOIN (SELECT unnest(range(3)) AS o) ON true
 JOIN (VALUES (0, 1.0, 1.0), (1, 1.4, 0.7), (2, 0.7, 1.4)) v(a, ax, ay) ON true JOIN (SELECT unnest(range(64)) AS y) ON y * s + s / 2 < 256 JOIN (SELECT unnest(range(64)) AS x) ON x * s + s / 2 < 320"""


@query("fn_anchors", _ANCHORS)
def fn_anchors(spark, sf):
    a = B.anchors(spark, 256, 320, 5, 7, 3, _ASPECT, 4.0)
    return a.select("level", "octave", "aspect", "gy", "gx", F.round("ymin", 4).alias("ymin"), F.round("xmax", 4).alias("xmax"))


@query("fn_default_boxes", "SELECT CAST(8732 AS BIGINT) AS n, true AS inside")
def fn_default_boxes(spark, sf):
    d = B.default_boxes(spark, [8, 16, 32, 64, 100, 300], [38, 19, 10, 5, 3, 1], [21, 45, 99, 153, 207, 261, 315], [[2], [2, 3], [2, 3], [2, 3], [2], [2]])
    return d.agg(F.count("*").alias("n"), F.min((F.col("ymin") >= 0) & (F.col("xmax") <= 1) & (F.col("ymin") < F.col("ymax"))).alias("inside"))


_MIX = f"""WITH e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, row_number() OVER (ORDER BY vec_id) AS a, row_number() OVER (ORDER BY vec_id DESC) AS b, {sql_hash01('vec_id')} AS u FROM embeddings)
SELECT p.vec_id, round(greatest(p.u, 1 - p.u) * p.x + (1 - greatest(p.u, 1 - p.u)) * q.x, 5) AS mixed FROM e p JOIN e q ON p.a = q.b"""


@query("fn_mixup", _MIX)
def fn_mixup(spark, sf):
    """Each element with its mirror image in the batch; the weight is a hash instead of a Beta variate."""
    e = t(spark, sf, "embeddings").select("vec_id", F.element_at("embedding", 1).cast("double").alias("x"))
    return I.mixup(e, "vec_id", "x").select("vec_id", F.round("mixed", 5).alias("mixed"))


@query("fn_normalise", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: (CAST(x AS DOUBLE) - 0.485) / 0.229)), 4) AS total FROM embeddings")
def fn_normalise(spark, sf):
    return t(spark, sf, "embeddings").select("vec_id", F.round(F.aggregate(I.normalise("embedding", 0.485, 0.229), F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


PIX_SQL = "(SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(abs(CAST(x AS DOUBLE)) * 1000) AS BIGINT) % 256) AS p FROM embeddings)"


def pixels(spark, sf):
    return t(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 1000) % 256).alias("p"))


_PIX = {
    "invert": ("255 - x", lambda p: I.invert(p)),
    "solarize": ("CASE WHEN x < 128 THEN x ELSE 255 - x END", lambda p: I.solarize(p, 128)),
    "solarize_add": ("CASE WHEN x < 128 THEN least(greatest(x + 30, 0), 255) ELSE x END", lambda p: I.solarize_add(p, 30, 128)),
    "posterize": ("(x // 16) * 16", lambda p: I.posterize(p, 4)),
    "brightness": ("CAST(floor(least(greatest(x * CAST(1.4 AS DOUBLE), 0), 255)) AS BIGINT)", lambda p: I.brightness(p, 1.4)),
    "blend": ("CAST(floor(least(greatest(100 + CAST(0.3 AS DOUBLE) * (x - 100), 0), 255)) AS BIGINT)", lambda p: I.blend(100, p, 0.3)),
}


@query("fn_pixel_ops", "SELECT vec_id, " + ", ".join(f"CAST(list_sum(list_transform(p, lambda x: {s})) AS BIGINT) AS {n}" for n, (s, _) in _PIX.items()) + f" FROM {PIX_SQL}")
def fn_pixel_ops(spark, sf):
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))
    return pixels(spark, sf).select("vec_id", *[total(f("p")).alias(n) for n, (_, f) in _PIX.items()])


@query("fn_geometric_ops")
def fn_geometric_ops(spark, sf):
    """The pixels as a 7 x 9 image, moved in seven ways."""
    ops = {"rotate": 30.0, "shear_x": 0.3, "shear_y": 0.3, "translate_x": 2.0, "translate_y": 2.0, "cutout": 1.0, "sharpness": 1.4}
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))
    return pixels(spark, sf).select("vec_id", *[total(I.geometric("p", op, 7, 9, v)).alias(op) for op, v in ops.items()])


@query("fn_randaugment", f"SELECT vec_id, CAST(floor({sql_hash01('vec_id', 1)} * 16) AS BIGINT) AS op, round(CASE WHEN {sql_hash01('vec_id', 2)} < 0.5 THEN 30 ELSE -30 END * 0.9, 4) AS rotate, CAST(floor(4 * 0.9) AS BIGINT) AS posterize, CAST(floor(256 * 0.9) AS BIGINT) AS solarize FROM embeddings")
def fn_randaugment(spark, sf):
    """The operation and the sign by hashes; arguments from level 9 of 10."""
    e, level = t(spark, sf, "embeddings"), I.augment_levels(9, 10)
    return e.select("vec_id", F.floor(R.hash01("vec_id", 1) * 16).alias("op"), F.round(F.when(R.hash01("vec_id", 2) < 0.5, 1).otherwise(-1) * level["rotate"], 4).alias("rotate"), F.lit(level["posterize"]).cast("long").alias("posterize"), F.lit(level["solarize"]).cast("long").alias("solarize"))


@query("fn_detection_rows", f"SELECT img, xmin / 100 * 640 AS x, ymin / 100 * 480 AS y, (xmax - xmin) / 100 * 640 AS w, (ymax - ymin) / 100 * 480 AS h, CASE class WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 5 ELSE 7 END AS class FROM {BOX_SQL}".replace("SELECT img, ", "SELECT img, k, ").replace("xmin / 100 * 640 AS x", "round(xmin / 100 * 640, 4) AS x").replace("ymin / 100 * 480 AS y", "round(ymin / 100 * 480, 4) AS y").replace("(xmax - xmin) / 100 * 640 AS w", "round((xmax - xmin) / 100 * 640, 4) AS w").replace("(ymax - ymin) / 100 * 480 AS h", "round((ymax - ymin) / 100 * 480, 4) AS h"))
def fn_detection_rows(spark, sf):
    back = F.element_at(F.array(*[F.lit(c) for c in (1, 2, 3, 5, 7)]), F.col("class").cast("int") + 1)
    b = [c / 100 for c in B.box()]
    y0, x0, y1, x1 = B.denormalize(b, F.lit(480.0), F.lit(640.0))
    return boxes(spark, sf).select("img", "k", *rounded((x0, y0, x1 - x0, y1 - y0), "xywh"), back.alias("class"))


@query("fn_time", "SELECT event_id, make_timestamp((1700000000 + event_id) * 1000000) AS at, round(event_id * 1500000 / 1e9, 6) AS s FROM events")
def fn_time(spark, sf):
    e = t(spark, sf, "events")
    return e.select("event_id", F.timestamp_seconds(F.lit(1700000000) + F.col("event_id")).cast("timestamp_ntz").alias("at"), F.round(F.col("event_id") * 1500000 / 1e9, 6).alias("s"))


@query("fn_slice", f"SELECT doc_id, array_to_string({DW}[1:5], ' ') AS head FROM documents")
def fn_slice(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(F.slice(X.words("text"), 1, 5), " ").alias("head"))


@query("fn_sos_eos", f"SELECT doc_id, CAST(len(src) + 2 AS INTEGER) AS s, CAST(len(tgt) + 1 AS INTEGER) AS t, array_to_string(['1'] || tgt, ' ') AS tgt_in, array_to_string(tgt || ['2'], ' ') AS tgt_out, CAST(len(src) AS INTEGER) AS bare FROM {PAIRS_SQL}")
def fn_sos_eos(spark, sf):
    p = pairs(spark, sf)
    ids = lambda c: F.transform(c, lambda w: w)
    one = F.concat(F.array(F.lit("1")), ids("src"), F.array(F.lit("2")))
    bare = X.with_ends(F.transform("src", lambda w: F.length(w)), F.transform("tgt", lambda w: F.length(w)), 1, 2, multi_host=True)[0]
    return p.select("doc_id", F.size(one).alias("s"), (F.size("tgt") + 1).alias("t"), F.array_join(F.concat(F.array(F.lit("1")), "tgt"), " ").alias("tgt_in"), F.array_join(F.concat("tgt", F.array(F.lit("2"))), " ").alias("tgt_out"), F.size(bare).alias("bare"))


_LENS = f"list_transform({DW}, lambda w: CAST(length(w) AS INTEGER))"


@query("fn_pad", f"SELECT doc_id, array_to_string({_LENS}[1:8] || list_transform(range(greatest(8 - len({_LENS}), 0)), lambda i: CAST(-1 AS INTEGER)), ',') AS padded FROM documents")
def fn_pad(spark, sf):
    lens = F.transform(X.words("text"), lambda w: F.length(w))
    return docs(spark, sf).select("doc_id", F.array_join(F.transform(R.trim_and_pad(lens, 8, -1), lambda x: x.cast("string")), ",").alias("padded"))


@query("fn_array_ops", "SELECT vec_id, round(CAST(list_reverse(embedding)[1] AS DOUBLE), 5) AS rev, round(list_sum(list_transform(list_filter(embedding, lambda x: x > 0), lambda x: CAST(x AS DOUBLE))), 3) AS pos, round(CAST(embedding[3] AS DOUBLE), 5) AS g FROM embeddings")
def fn_array_ops(spark, sf):
    e = F.col("embedding")
    pos = F.aggregate(F.filter(e, lambda x: x > 0), F.lit(0.0), lambda a, x: a + x.cast("double"))
    return t(spark, sf, "embeddings").select("vec_id", F.round(F.element_at(F.reverse(e), 1).cast("double"), 5).alias("rev"), F.round(pos, 3).alias("pos"), F.round(F.element_at(e, 3).cast("double"), 5).alias("g"))


@query("fn_space_to_depth", "SELECT vec_id, array_to_string(list_transform(range(16), lambda i: p[((i // 4) // 2) * 8 + ((i // 4) % 2) * 2 + ((i % 4) // 2) * 4 + i % 2 + 1]), ',') AS blocks FROM " + PIX_SQL)
def fn_space_to_depth(spark, sf):
    """The first 16 pixels as a 4 x 4 image, in blocks of 2 x 2."""
    return pixels(spark, sf).select("vec_id", F.array_join(F.transform(I.space_to_depth("p", 4, 4, 2), lambda x: x.cast("string")), ",").alias("blocks"))


@query("fn_raw_record", "SELECT vec_id, true AS same, CAST(27 AS BIGINT) AS ints FROM embeddings")
def fn_raw_record(spark, sf):
    """Three arrays of 8 and three numbers in one array of 3 L + 3, and back."""
    p = pixels(spark, sf).withColumn("raw", I.pack_record([F.slice("p", 1 + 8 * k, 8) for k in range(3)], [F.lit(k).cast("long") for k in (8, 7, 1)]))
    parts, numbers = I.unpack_record("raw", 8)
    return p.select("vec_id", ((F.concat(*parts) == F.slice("p", 1, 24)) & (numbers[2] == 1)).alias("same"), F.size("raw").cast("long").alias("ints"))


@query("fn_struct_map", "SELECT n_nationkey + 1 AS a, n_regionkey + 1 AS b FROM nation")
def fn_struct_map(spark, sf):
    n = t(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    return n.select(*[(F.col(c) + 1).alias(a) for c, a in zip(n.columns, "ab")])


@query("fn_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.missing'), '-1') AS d FROM events")
def fn_json(spark, sf):
    """Fields of a record with a default where they are missing."""
    p = F.from_json("props", "k long, missing string")
    return t(spark, sf, "events").select("event_id", p.k.alias("k"), F.coalesce(p.missing, F.lit("-1")).alias("d"))


@query("fn_mllog", "SELECT event_id, CAST(event_id AS BIGINT) AS v, event_type AS key FROM events")
def fn_mllog(spark, sf):
    """Lines ``:::MLLOG {json}`` parsed."""
    line = F.concat(F.lit(":::MLLOG "), F.to_json(F.struct(F.col("event_type").alias("key"), F.col("event_id").alias("value"))))
    j = F.from_json(F.regexp_extract("line", r":::MLLOG (\{.*\})", 1), "key string, value long")
    return t(spark, sf, "events").withColumn("line", line).select("event_id", j.value.alias("v"), j.key.alias("key"))


@query("fn_prices", "SELECT round(96 * 0.031611 + 300 * 0.004237, 6) AS dollars")
def fn_prices(spark, sf):
    from ..plans.machine import CPU_HOUR, GB_HOUR

    return spark.range(1).select(F.round(F.lit(96 * CPU_HOUR + 300 * GB_HOUR), 6).alias("dollars"))


@query("udtf_explode", f"SELECT doc_id, w FROM (SELECT doc_id, unnest({DW}) AS w FROM documents)")
def udtf_explode(spark, sf):
    return docs(spark, sf).select("doc_id", F.explode(X.words("text")).alias("w"))


@query("udf_random", "SELECT false AS plain, true AS random")
def udf_random(spark, sf):
    """Whether a stage is random, by Catalyst's flag."""
    from ..plans.spec import is_random

    n = t(spark, sf, "nation")
    return spark.createDataFrame([(is_random(n.where("n_nationkey > 3")), is_random(n.withColumn("r", F.rand())))], "plain boolean, random boolean")
