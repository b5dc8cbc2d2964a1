"""The queries of the retrieval engine over the driver's tables, each with its SQL where SQL can say it.

documents serve as chunks (a chunk for each text), embeddings as vectors,
benchmark items as queries, whose vector is that of the same number.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hayrake.functions import paths, text, vectors
from hayrake.operators import chunks as C
from hayrake.operators import dense, evaluation, fusion, labels, lexical, lookup, metrics, search, store
from hayrake.session import materialise, table, work_path
from hayrake.streaming import incremental

BOOSTS = {"symbol": 4.0, "signature": 3.0, "body": 1.0, "file": 0.5}


# Tables as the engine's entities

def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    body = F.coalesce("text", F.lit(""))
    return d.select(
        F.col("doc_id").alias("row_id"), F.concat_ws("/", "source", "doc_id").alias("file"), F.col("lang").alias("language"), F.concat(F.lit("doc_"), "doc_id").alias("symbol"),
        text.signature_line(body).alias("signature"), F.lit(None).cast("string").alias("doc_first_line"), F.lit(1).alias("line_start"), text.line_count(body).alias("line_end"), body.alias("body"),
    )


def hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, file (a source), content_hash, live: a text's first copy is live."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("file"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
    first = d.groupBy("content_hash").agg(F.min("doc_id").alias("first"))
    return d.join(first, "content_hash").select(F.col("doc_id").alias("row_id"), "file", "content_hash", (F.col("doc_id") == F.col("first")).alias("live"))


def vector_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vector"), "label")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    own = vector_table(spark, sf_dir).select(F.col("row_id").alias("query_id"), F.col("vector").alias("query_vector"))
    return items.join(own, "query_id", "left")


def every_50th(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set of vector searches."""
    return vector_table(spark, sf_dir).filter("row_id % 50 = 0").select(F.col("row_id").alias("query_id"), F.col("vector").alias("query_vector"))


def _ranked(df: DataFrame, decimals: int) -> DataFrame:
    return df.select("query_id", "row_id", F.col("rank").cast("bigint").alias("rank"), F.round("score", decimals).alias("score"))


# Text

def tokenize_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = lexical.records(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text"), ["text"])
    return counted.select(F.col("row_id").alias("doc_id"), F.inline("fields")).select("doc_id", F.col("dl").alias("tokens"), F.size("terms").cast("bigint").alias("terms"))


def split_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of parts of every different word of documents and conversations."""
    words = table(spark, sf_dir, "documents").select("text").union(table(spark, sf_dir, "conversations").select("text"))
    words = words.select(F.explode(text.blank_words(F.col("text"))).alias("word")).distinct()
    return words.select("word", F.array_join(F.array_sort(text.split_identifier(F.col("word"))), ",").alias("parts"))


def normalize_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.lit("html").alias("language"), F.concat(F.lit("page_"), "page_id").alias("symbol"), F.col("html").alias("text"))
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("language"), F.concat(F.lit("doc_"), "doc_id").alias("symbol"), "text")
    return docs.union(pages).select("symbol", text.content_hash(F.col("language"), F.col("symbol"), F.col("text")).alias("content_hash"))


def preview_320(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.preview(F.col("text")).alias("preview"))


def signature_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("row_id", "signature", F.col("line_end").cast("bigint").alias("line_end"))


def skip_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each of several paths made of a page's address would not be indexed."""
    path = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", "")
    kinds = [".rs", "_pb2.py", ".generated.ts", "/node_modules/a.js", "/vendor", ".env", "/.env", "/credentials.json", ".pem", ".h", ".RS", "/target/x.go", "/id_rsa.pub", ".md"]
    p = table(spark, sf_dir, "pages").select("page_id", path.alias("p")).select("page_id", F.posexplode(F.array(*(F.concat("p", F.lit(k)) for k in kinds))).alias("kind", "path"))
    return p.select("page_id", F.col("kind").cast("bigint").alias("kind"), paths.skip_reason(F.col("path")).alias("reason"), paths.language(F.col("path")).alias("language"))


# Retrieval

def postings_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index_stats(lexical.build(chunks(spark, sf_dir), BOOSTS))


def _index_stats(index: lexical.Index) -> DataFrame:
    counted = index.documents.groupBy("field").agg(F.count("*").alias("terms"), F.sum("df").alias("postings"), F.max("df").alias("most"))
    return counted.join(index.lengths, "field").select("field", "terms", "postings", "most", F.round("avgdl", 6).alias("avgdl"))


def lexical_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """postings_stats of the documents' index once licence lines are reworded and repeated texts have left it."""
    c = chunks(spark, sf_dir)
    changed = c.filter(F.contains("body", F.lit("Licensed under"))).withColumn("body", F.replace("body", F.lit("Licensed under"), F.lit("Under")))
    changed = changed.withColumn("signature", text.signature_line(F.col("body"))).join(hashed(spark, sf_dir).select("row_id", "live"), "row_id")
    gone = hashed(spark, sf_dir).filter("not live").select("row_id")
    return _index_stats(lexical.upsert(lexical.build(c, BOOSTS), changed, gone, BOOSTS))


def lexical_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings, tokens and the rarest term's documents of each row after compaction."""
    return lexical.row_stats(lexical.renumber(lexical.build(chunks(spark, sf_dir), BOOSTS), store.compaction_map(hashed(spark, sf_dir))))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query: all words of the benchmark's first item; plain limit instead of ranks by query."""
    index = lexical.build(chunks(spark, sf_dir), BOOSTS)
    one = table(spark, sf_dir, "benchmark").orderBy("item_id").limit(1).select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return lexical.scores(index, one, BOOSTS).orderBy(F.desc("score"), "row_id").limit(50).select("row_id", F.round("score", 6).alias("score"))


def bm25_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.build(chunks(spark, sf_dir), BOOSTS)
    return _ranked(lexical.search(index, asked(spark, sf_dir).select("query_id", "query"), 50, BOOSTS), 6)


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = vector_table(spark, sf_dir).orderBy("row_id").limit(1).select(F.col("row_id").alias("query_id"), F.col("vector").alias("query_vector"))
    return dense.scores_sql(vector_table(spark, sf_dir), one).orderBy(F.desc("score"), "row_id").limit(50).select("row_id", F.round("score", 6).alias("score"))


def dense_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(dense.search(vector_table(spark, sf_dir), every_50th(spark, sf_dir), 50), 6)


def dense_live_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As dense_batch, but vectors whose number is no live chunk's are dead."""
    live = hashed(spark, sf_dir).filter("live").select("row_id")
    return _ranked(dense.search(vector_table(spark, sf_dir).join(live, "row_id", "left_semi"), every_50th(spark, sf_dir), 50), 6)


def _lists(spark: SparkSession, sf_dir: str, config: fusion.Fusion = fusion.Fusion()) -> tuple[DataFrame, DataFrame]:
    index = lexical.build(chunks(spark, sf_dir), BOOSTS)
    by_terms, by_vector, _ = search.candidates(index, vector_table(spark, sf_dir), asked(spark, sf_dir), config)
    return by_terms, by_vector


def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = fusion.fuse(*_lists(spark, sf_dir)).filter("rank <= 10")
    return fused.select("query_id", F.col("rank").cast("bigint").alias("rank"), "row_id", F.col("lexical_rank").cast("bigint").alias("lexical_rank"), F.col("dense_rank").cast("bigint").alias("dense_rank"), F.round("fused_score", 9).alias("fused_score"))


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fusion.assemble(fusion.fuse(*_lists(spark, sf_dir)), chunks(spark, sf_dir), 10)
    return found.select("query_id", F.col("rank").cast("bigint").alias("rank"), "file", "symbol", "signature", "preview", F.round("lexical_score", 6).alias("lexical_score"), F.round("dense_score", 6).alias("dense_score"), F.round("fused_score", 9).alias("fused_score"))


def similar_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = search.similar(chunks(spark, sf_dir), vector_table(spark, sf_dir), every_50th(spark, sf_dir), 10)
    return found.select("query_id", F.col("rank").cast("bigint").alias("rank"), "file", F.round("dense_score", 6).alias("dense_score"), F.round("fused_score", 9).alias("fused_score"))


def _first_hits(spark: SparkSession, sf_dir: str, by_terms: DataFrame, by_vector: DataFrame) -> DataFrame:
    """config, query_id and first_rank of the three configurations, from one pair of candidate lists.

    Expected are the vectors that have the label of the query's own. Labels
    are looked up for the best rows alone: items are not paired with vectors.
    """
    labels = vector_table(spark, sf_dir).select("row_id", "label").filter("label is not null")
    items = lexical.bounded(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id")).distinct())
    own = materialise(labels.select(F.col("row_id").alias("query_id"), F.col("label").alias("own")).join(items, "query_id"), "own")
    out = None
    for name, config in fusion.ABLATIONS.items():
        best = fusion.fuse(by_terms, by_vector, config).filter("rank <= 10").select("query_id", "row_id", "rank", F.lit(name).alias("config"))
        out = best if out is None else out.union(best)
    best = materialise(out.join(own, "query_id"), "best")
    hits = labels.join(lexical.bounded(best), "row_id").filter("label = own").groupBy("config", "query_id").agg(F.min("rank").alias("first_rank"))
    every = own.select("query_id").distinct().withColumn("config", F.explode(F.array(*map(F.lit, fusion.ABLATIONS))))
    return every.join(hits, ["config", "query_id"], "left")


def ablation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.summary(_first_hits(spark, sf_dir, *_lists(spark, sf_dir)), ["config"])
    return found.select("config", "labels_scored", *(F.round(c, 9).alias(c) for c in ("top_1", "top_3", "top_10", "mrr")))


def mrr_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of vector search alone over the stated query set; a vector's own row does not count."""
    v = vector_table(spark, sf_dir)
    found = dense.search(v, every_50th(spark, sf_dir), 11).filter("query_id <> row_id")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "row_id"))).filter("rank <= 10")
    own = v.select(F.col("row_id").alias("query_id"), F.col("label").alias("own"))
    hits = found.join(v.select("row_id", "label"), "row_id").join(own, "query_id").filter("label = own").groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    every = every_50th(spark, sf_dir).select("query_id").join(hits, "query_id", "left")
    return metrics.summary(every).select("labels_scored", *(F.round(c, 9).alias(c) for c in ("top_1", "top_3", "top_10", "mrr")))


def breakdown_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _first_hits(spark, sf_dir, *_lists(spark, sf_dir)).filter("config = 'fused'")
    return metrics.by_length(hits, asked(spark, sf_dir)).select("bucket", "labels_scored", *(F.round(c, 9).alias(c) for c in ("top_1", "top_3", "top_10", "mrr")))


def bytes_before_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of JSON until the first result that has the label, by query."""
    by_terms, by_vector = _lists(spark, sf_dir)
    hits = _first_hits(spark, sf_dir, by_terms, by_vector).filter("config = 'fused'").select("query_id", "first_rank")
    found = fusion.assemble(fusion.fuse(by_terms, by_vector), chunks(spark, sf_dir), 20)
    told = found.select("query_id", "rank", F.to_json(F.struct("file", "symbol", "signature", "preview"), {"ignoreNullFields": "false"}).alias("json"))
    return metrics.bytes_before_hit(told, hits).select("query_id", F.col("bytes").cast("bigint").alias("bytes"))


def baseline_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    queries = asked(spark, sf_dir).select("query_id", "query")
    expected = c.select(F.col("row_id").alias("query_id"), "file").join(queries.select("query_id"), "query_id")
    return metrics.baseline_bytes(queries, c.select("file", "body"), expected)


def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts of the report; an item's source is that of the document of its number."""
    own = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), "source")
    asked_for = asked(spark, sf_dir).select("query_id", "query").join(own, "query_id", "left")
    found = evaluation.evaluate(_first_hits(spark, sf_dir, *_lists(spark, sf_dir)), asked_for)
    return found.select("part", "name", "labels_scored", "labels_discarded", *(F.round(c, 9).alias(c) for c in evaluation.METRICS))


def median_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.medians(bytes_before_hit(spark, sf_dir), baseline_bytes(spark, sf_dir))


def percentile_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), *(metrics.nearest_rank(p, "value").alias(name) for name, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))))


# Lookups

def get_many_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records asked for in falling order of the label table's ids; toxic ones ask for ids that do not exist."""
    own = table(spark, sf_dir, "labels").select("doc_id", (F.col("doc_id") + F.col("toxic") * 10**9).alias("row_id"))
    request = own.select((-F.col("doc_id")).alias("ord"), "row_id")
    live = hashed(spark, sf_dir).join(chunks(spark, sf_dir).select("row_id", "symbol"), "row_id")
    return lookup.get_many(live, request).select("ord", "row_id", "symbol")


def symbol_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by (source, first word), asked for by every document's and every item's first word."""
    first = F.try_element_at(text.blank_words(F.col("text")), F.lit(1))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), F.col("source").alias("file"), first.alias("symbol"), F.concat(F.lit("s"), "doc_id").alias("signature")).filter("symbol is not null")
    items = table(spark, sf_dir, "benchmark").select(F.lit("src0").alias("file"), first.alias("symbol")).filter("symbol is not null")
    found = lookup.symbol_lookup(d, d.select("file", "symbol").union(items))
    return found.select("file", "symbol", "outcome", "row_id", F.array_join("candidates", ",").alias("candidates"))


def containment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of lines of an order, one in transit within the other's time in transit."""
    days = lambda c: F.datediff(F.col(c).cast("date"), F.lit("1970-01-01")).cast("bigint")
    spans = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("id"), days("l_shipdate").alias("start"), (days("l_shipdate") + F.col("l_quantity").cast("bigint")).alias("end"))
    return lookup.contained(spans, ["l_orderkey"])


def line_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of five lines that hold a line with a mark of junk or licence."""
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("file"), F.col("doc_id").cast("string").alias("commit_id"), F.split("text", "\n").alias("parts"))
    lines = d.select("commit_id", "file", F.posexplode("parts").alias("pos", "part")).filter(F.col("part").rlike("[|@!]|icense")).select("commit_id", "file", (F.col("pos") + 1).alias("line"))
    spans = d.select("file", F.explode(F.sequence(F.lit(0), F.floor((F.size("parts") - 1) / 5).cast("int"))).alias("k")).select("file", F.concat(F.lit("b"), "k").alias("symbol"), (F.col("k") * 5 + 1).alias("line_start"), (F.col("k") * 5 + 5).alias("line_end"))
    return lookup.touched(lines, spans)


def label_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations whose turns' numbers are all those of labelled documents."""
    c = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("label_id")).agg(F.collect_list(F.struct(F.lit("f").alias("file"), (F.col("conv_id") + F.col("turn")).cast("string").alias("symbol"))).alias("expected"))
    known = table(spark, sf_dir, "labels").select(F.lit("f").alias("file"), F.col("doc_id").cast("string").alias("symbol"))
    return lookup.all_indexed(c, known).select("label_id", "scored")


# Maintenance

def dedup_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations' texts inserted into the live documents: reused, inserted, or repeated in the batch."""
    live = hashed(spark, sf_dir).filter("live").select("row_id", "content_hash")
    base = live.agg(F.max("row_id")).first()[0]
    batch = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
    return store.dedup_insert(live, batch, (-1 if base is None else base) + 1).select("ord", "row_id", "outcome")


def _edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next state: licence lines reworded, repeated texts gone, pages new."""
    d = table(spark, sf_dir, "documents").join(hashed(spark, sf_dir).filter("live").select(F.col("row_id").alias("doc_id")), "doc_id", "left_semi")
    d = d.select(F.col("source").alias("file"), F.replace(F.coalesce("text", F.lit("")), F.lit("Licensed under"), F.lit("Under")).alias("text"))
    p = table(spark, sf_dir, "pages").select(F.concat(F.lit("page_"), "page_id").alias("file"), F.coalesce("html", F.lit("")).alias("text"))
    return d.union(p).select("file", F.sha2("text", 256).alias("content_hash"))


def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.snapshot_diff(hashed(spark, sf_dir), _edited(spark, sf_dir))


def compaction_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.compaction_map(hashed(spark, sf_dir))


def verify_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against vectors of the same numbers, all documents taken as live."""
    return store.verify(hashed(spark, sf_dir).withColumn("live", F.lit(True)), vector_table(spark, sf_dir))


def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.stats(hashed(spark, sf_dir)).select("live", "dead", F.round("dead_fraction", 9).alias("dead_fraction"))


def incremental_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states of snapshot_diff as a stream of changes: the final file and hash pairs."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d"), "doc_id").alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    none = F.lit(None).cast("string")
    feed = lambda df, op, seq: df.select(F.lit(seq).cast("bigint").alias("seq"), F.lit(op).alias("op"), "path", none.alias("from_path"), none.alias("language"), "text")
    folder = work_path(spark, "feed")
    dead = hashed(spark, sf_dir).filter("not live").select(F.col("row_id").alias("doc_id"))
    steps = [
        feed(d, "A", 1),
        feed(d.filter(F.contains("text", F.lit("Licensed under"))).withColumn("text", F.replace("text", F.lit("Licensed under"), F.lit("Under"))), "M", 2),
        feed(d.join(dead, "doc_id", "left_semi").withColumn("text", none), "D", 3),
        feed(table(spark, sf_dir, "pages").select(F.concat(F.lit("page_"), "page_id").alias("path"), F.coalesce("html", F.lit("")).alias("text")), "A", 4),
    ]
    state = spark.createDataFrame([], "file string, language string, text string")
    held = {"state": state}
    for step in steps:
        step.write.mode("append").json(folder)

    def apply(batch: DataFrame, _: int) -> None:
        held["state"] = materialise(incremental.merge_state(held["state"], batch), "state")

    # Files of one step arrive together; maxFilesPerTrigger could part them, so order is by seq within a trigger.
    stream = spark.readStream.schema(incremental.FEED).json(folder)
    stream.writeStream.foreachBatch(apply).option("checkpointLocation", work_path(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return held["state"].select("file", F.sha2("text", 256).alias("content_hash"))


def mining_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as commits: their text is the message, and they touch the documents of the numbers in reach."""
    c = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("commit_id"), F.when(F.col("role") == "system", 2).otherwise(1).alias("parents"), F.coalesce("text", F.lit("")).alias("message"), "conv_id", "turn")
    touched = c.select("commit_id", F.explode(F.sequence(F.col("conv_id"), F.col("conv_id") + F.col("turn") - 1 + F.when(F.col("turn") == 0, 1).otherwise(0))).alias("n")).select("commit_id", F.lit("f").alias("file"), F.col("n").cast("string").alias("symbol"))
    known = table(spark, sf_dir, "labels").select(F.lit("f").alias("file"), F.col("doc_id").cast("string").alias("symbol"))
    mined = labels.mine_commits(c.select("commit_id", "parents", "message"), touched.filter("symbol <> '0'"), known)
    return mined.select("commit_id", F.coalesce("reason", F.lit("accepted")).alias("reason"), F.coalesce(F.size("expected"), F.lit(0)).cast("bigint").alias("n"))


def held_out_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of the bodies once doc comments are gone: every document is given one before and one within."""
    c = chunks(spark, sf_dir).withColumn("body", F.concat(F.lit("/// about\n"), "body", F.lit("\n  //! inner\n// stays")))
    d = labels.held_out(c).select("row_id", F.explode(text.code_tokens(F.col("body"))).alias("term"))
    return d.groupBy("row_id").agg(F.count("*").alias("tokens"), F.count_if(F.col("term").isin("about", "inner", "stays")).alias("marks"))


# Vectors and chunks

def l2_normalize_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of each label's vectors, pooled and brought to unit length."""
    v = vector_table(spark, sf_dir).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("row_id", "vector"))).alias("all"))
    hidden = F.transform("all", lambda x: x["vector"])
    mask = F.transform("all", lambda x: (x["row_id"] % 3 != 0).cast("int"))
    pooled = v.select("label", *(vectors.l2_normalise(vectors.pool(hidden, mask, how)).alias(how) for how in ("mean", "last_token", "cls")))
    return pooled.select("label", *(F.round(F.element_at(how, 1), 6).alias(how) for how in ("mean", "last_token", "cls")), F.round(vectors.norm(F.col("mean")), 6).alias("length"))


def mock_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", vectors.mock_embedding(16)(F.col("text")).alias("vector"))


def chunk_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Rust file for each document, cut into its symbols."""
    d = table(spark, sf_dir, "documents")
    source = F.concat(F.lit("/// In "), "lang", F.lit("\npub struct Doc"), "doc_id", F.lit(";\n\nimpl Doc"), "doc_id", F.lit(" {\n    fn size(&self) -> u64 {\n        "), "n_chars", F.lit("\n    }\n}\n"))
    files = d.select(F.concat(F.lit("src/d"), "doc_id", F.lit(".rs")).alias("file"), F.lit("rust").alias("language"), source.alias("text"))
    found = C.chunk_files(files)
    return found.select("file", "symbol", "symbol_type", "doc_first_line", F.col("line_start").cast("bigint").alias("line_start"), F.col("line_end").cast("bigint").alias("line_end"), "content_hash")


def oversize_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.hard_splits(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


QUERIES = {
    f.__name__: f
    for f in (
        hybrid_search, tokenize_terms, split_identifiers, normalize_hash, preview_320, signature_line, skip_reason, postings_stats, lexical_upsert, lexical_renumber, bm25_topk, bm25_batch, dense_topk, dense_batch, dense_live_mask, rrf_fuse,
        similar_search, ablation_metrics, mrr_topk, breakdown_by_length, bytes_before_hit, baseline_bytes, evaluation_report, median_bytes, percentile_nearest_rank, get_many_ordered, symbol_lookup, containment_join, line_interval_join,
        label_partition, dedup_insert, snapshot_diff, compaction_map, verify_integrity, store_stats, incremental_stream, mining_cascade, held_out_index, l2_normalize_pool, mock_embed, chunk_source, oversize_split,
    )
}
