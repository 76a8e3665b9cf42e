"""The registered queries of the core library, each over its whole tables, and SQL that gives the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovework.functions import scores, text
from trovework.operators import changes, chunks, entities, graph, metrics, rag, search
from trovework.plans import sql
from trovework.session import new_folder, table, written
from trovework.sources import repositories

#: The day that parts the chunks into an old and a new snapshot.
DAY = "2025-06-14"
#: Indexes that this process has built, by session, table and the table's time.
_BUILT: dict[tuple, search.Index] = {}


def _chunks(s: SparkSession, d: str) -> DataFrame:
    return chunks.clean(table(s, d, "code_chunks_vectors"))


def _raw(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "code_chunks_vectors")


def _queries(s: SparkSession, d: str) -> DataFrame:
    """Every document whose id is divisible by 20 is a query, its whole text the words."""
    return table(s, d, "documents").where("doc_id % 20 = 0 and text is not null").select(F.col("doc_id").alias("query_id"), "text")


def _with_summaries(s: SparkSession, d: str) -> DataFrame:
    """The chunks with the summary that search results have of them, the first in order."""
    place = ["source_file", "entity_name", "start_line", "end_line"]
    said = table(s, d, "search_results").where("trim(doc_summary) != ''").groupBy(*place).agg(F.min("doc_summary").alias("doc_summary"))
    c = chunks.clean(_raw(s, d).withColumn("own", F.col("id")))
    # places are joined without contents, which stay where they are by id; a filter on own can't be pushed below the rows' shuffle, so it is one for both
    return c.drop("own").join(c.select(F.col("own").alias("id"), *place).join(said, place).select("id", "doc_summary"), "id", "left")


FIELDS = ("content", "entity_name", "doc_summary")


def _changed(s: SparkSession, d: str, *names: str) -> tuple:
    """The latest times of tables' files, so that an index of older ones isn't used."""
    path = s._jvm.org.apache.hadoop.fs.Path
    out = []
    for n in names:
        at = path(f"{d}/{n}.parquet")
        fs = at.getFileSystem(s._jsc.hadoopConfiguration())
        out.append((at.toString(), max([f.getModificationTime() for f in fs.listStatus(at)], default=0)))
    return tuple(out)


def _index(s: SparkSession, d: str) -> search.Index:
    """The index of the chunks' contents, names and summaries, built once a session and kept in the shared folder."""
    key = (s.sparkContext.applicationId, *_changed(s, d, "code_chunks_vectors", "search_results"))
    if key not in _BUILT:
        _BUILT[key] = search.build_index(_with_summaries(s, d), {c: F.col(c) for c in FIELDS}, new_folder(s, "index"))
    return _BUILT[key]


def _documents_index(s: SparkSession, d: str) -> search.Index:
    key = (s.sparkContext.applicationId, *_changed(s, d, "documents"))
    if key not in _BUILT:
        _BUILT[key] = search.build_index(table(s, d, "documents").where("text is not null"), {"content": F.col("text")}, new_folder(s, "index"), "doc_id", stored=True)
    return _BUILT[key]


def _postings(s: SparkSession, d: str) -> DataFrame:
    return _index(s, d).post


def file_kinds(s: SparkSession, d: str) -> DataFrame:
    p = F.col("source_file")
    return _raw(s, d).select(p).distinct().select(p, chunks.extension(p).alias("extension"), chunks.is_source_file(p).alias("is_source"), chunks.is_text_file(p).alias("is_text"), chunks.parser_of(p).alias("parser"))


def repository_urls(s: SparkSession, d: str) -> DataFrame:
    u = F.col("clone_url")
    return table(s, d, "repositories").select("repo_name", repositories.client(u).alias("client"), repositories.owner(u).alias("owner"), repositories.name(u).alias("name"), repositories.clone_url(u).alias("url"), text.file_name_of(u).alias("state_file"))


def repository_of_file(s: SparkSession, d: str) -> DataFrame:
    return _raw(s, d).select("source_file").distinct().select("source_file", text.repository_of(F.col("source_file")).alias("repository"))


def chunk_violations(s: SparkSession, d: str) -> DataFrame:
    return chunks.violations(_raw(s, d)).distinct()


def clean_chunks(s: SparkSession, d: str) -> DataFrame:
    return _chunks(s, d).select("id", "document_id", "language", "entity_type", F.length("content").alias("n_chars"))


def index_stats(s: SparkSession, d: str) -> DataFrame:
    return chunks.stats(_chunks(s, d))


def parse_progress(s: SparkSession, d: str) -> DataFrame:
    return chunks.parse_progress(_chunks(s, d))


def appended(s: SparkSession, d: str) -> DataFrame:
    t = _chunks(s, d).select("id", "source_file", "created_at")
    return chunks.append(t.where(F.col("created_at") < DAY), t.where(F.col("created_at") >= DAY)).groupBy("source_file").agg(F.count("*").alias("n"))


def deleted_files(s: SparkSession, d: str) -> DataFrame:
    gone = changes.clean(table(s, d, "file_changes")).where("change_type = 'DELETED'").select("file_path")
    return chunks.delete_by(_chunks(s, d), gone, "source_file").select("id")


def replaced_files(s: SparkSession, d: str) -> DataFrame:
    t = _chunks(s, d).select("id", "source_file", "created_at")
    new = t.where(F.col("created_at") >= DAY)
    return chunks.replace_files(t, new).select("id")


def upserted(s: SparkSession, d: str) -> DataFrame:
    """The rows that win, with the time and content of the version."""
    t = _raw(s, d).select("id", "content", "created_at", "updated_at")
    old = chunks.latest(t.where(F.col("created_at") < DAY), "id", F.greatest("created_at", "updated_at"), F.col("created_at"))
    return chunks.upsert(old, t.where(F.col("created_at") >= DAY)).select("id", F.unix_micros(F.greatest("created_at", "updated_at")).alias("at"), F.md5("content").alias("md5"))


def upserted_vectors(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "embeddings")
    rows = v.where("label % 2 = 0").withColumn("label", F.col("label") + 100)
    return chunks.upsert_vectors(v, rows, 64).groupBy("label").agg(F.count("*").alias("n"))


def snapshot_changes(s: SparkSession, d: str) -> DataFrame:
    """Files before and after DAY; a file's hash is that of its chunks' lines and contents, whatever their order."""
    t = _chunks(s, d)
    snap = lambda x: x.groupBy(F.col("source_file").alias("path")).agg(F.concat_ws(":", F.bit_xor(F.xxhash64("start_line", "content")), F.count("*")).alias("hash"))
    return changes.detect(snap(t.where(F.col("created_at") < DAY)), snap(t))


def similar_files(s: SparkSession, d: str) -> DataFrame:
    """Files that began on odd days as the gone ones, those of even days as the added ones: what of one side is the other's in a new place."""
    t = _chunks(s, d).select(F.col("source_file").alias("path"), "content", "created_at")
    first = t.groupBy("path").agg((F.dayofmonth(F.min("created_at")) % 2).alias("odd"))
    side = lambda odd: t.join(first.where(F.col("odd") == odd), "path").select("path", "content")
    return changes.similar(side(1), side(0)).select("old_path", "file_path", F.round("similarity", 6).alias("similarity"))


def file_states(s: SparkSession, d: str) -> DataFrame:
    return changes.last_state(table(s, d, "file_changes")).select("path", "alive")


def applied_changes(s: SparkSession, d: str) -> DataFrame:
    return changes.apply(_chunks(s, d), table(s, d, "file_changes")).groupBy("language").agg(F.count("*").alias("n"))


def index_states(s: SparkSession, d: str) -> DataFrame:
    return changes.index_state(table(s, d, "file_changes")).select("repository", "commit_sha", "changes")


def declarations(s: SparkSession, d: str) -> DataFrame:
    return entities.declarations(_chunks(s, d)).select("id", "line_no", "kind", "name")


def declaration_extents(s: SparkSession, d: str) -> DataFrame:
    return entities.extents(_chunks(s, d))


def term_statistics(s: SparkSession, d: str) -> DataFrame:
    p = search.postings(_chunks(s, d), {"content": F.col("content")})
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def index_build(s: SparkSession, d: str) -> DataFrame:
    """Builds the index anew: the postings, terms and occurrences of each field."""
    built = search.build_index(_with_summaries(s, d), {c: F.col(c) for c in FIELDS}, new_folder(s, "index"))
    return built.words.groupBy("field").agg(F.sum("df").alias("postings"), F.count("*").alias("terms"), F.sum("cf").alias("occurrences"), F.max("df").alias("most_df"))


def field_statistics(s: SparkSession, d: str) -> DataFrame:
    return _index(s, d).stats.select("field", "n", F.round("avgdl", 6).alias("avgdl"))


def keyword_search(s: SparkSession, d: str) -> DataFrame:
    return search.keyword_search(_index(s, d), _queries(s, d), 10).select("query_id", "doc", "score")


def keyword_search_filtered(s: SparkSession, d: str) -> DataFrame:
    docs = _chunks(s, d).where(search.metadata_filter(language=["java", "python"], entity_type=["method", "function"])).select(F.col("id").alias("doc"))
    return search.keyword_search(_index(s, d), _queries(s, d), 10, docs).select("query_id", "doc", "score")


def field_search(s: SparkSession, d: str) -> DataFrame:
    return search.keyword_search(_index(s, d), _queries(s, d), 10, boosts={"entity_name": 1.0}).select("query_id", "doc", "score")


def keyword_normalised(s: SparkSession, d: str) -> DataFrame:
    return scores.min_max(search.keyword_search(_index(s, d), _queries(s, d), 10), ["query_id"]).select("query_id", "doc", F.round("score", 5).alias("score"))


def field_match(s: SparkSession, d: str) -> DataFrame:
    """The fields that each hit is found in."""
    index, q = _index(s, d), _queries(s, d)
    return search.field_match(index, q, search.keyword_search(index, q, 10)).select("query_id", "doc", "matched_fields")


def boolean_search(s: SparkSession, d: str) -> DataFrame:
    return search.boolean(_postings(s, d), must=["token", "ledger"], should=["nightly", "caller"], must_not=["unknown"])


def wildcard_search(s: SparkSession, d: str) -> DataFrame:
    return search.wildcard(_postings(s, d), "snap*sh?t*")


def fuzzy_search(s: SparkSession, d: str) -> DataFrame:
    return search.fuzzy(_postings(s, d), "ledgr", 1)


def phrase_search(s: SparkSession, d: str) -> DataFrame:
    return search.phrase(_with_summaries(s, d), {c: F.col(c) for c in FIELDS}, "nightly job")


def all_documents(s: SparkSession, d: str) -> DataFrame:
    return search.match_all(_chunks(s, d))


def path_filter(s: SparkSession, d: str) -> DataFrame:
    return _chunks(s, d).where(search.metadata_filter(file_path=["copperway/", "oakline/facet"])).select("id")


def name_lookup(s: SparkSession, d: str) -> DataFrame:
    names = table(s, d, "search_results").where("is_transitive").select("entity_name")
    return search.by_name(_chunks(s, d), names, 3).select("entity_name", "doc")


def facets(s: SparkSession, d: str) -> DataFrame:
    return search.facets(_chunks(s, d), ["language", "repository", "entity_type"], 10).select("dimension", "value", "count")


def facets_of_query(s: SparkSession, d: str) -> DataFrame:
    hits = search.boolean(_postings(s, d), should=["token"]).withColumnRenamed("doc", "id")
    return search.facets(_chunks(s, d).join(hits, "id", "left_semi"), ["language", "entity_type"], 5).select("dimension", "value", "count")


def _vector_queries(v: DataFrame) -> DataFrame:
    return v.where("vec_id % 20 = 0")


def nearest_vectors(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "embeddings")
    return search.nearest(v, _vector_queries(v), 10).select("query_id", "doc", F.round("score", 5).alias("score"))


def nearest_by_cells_recall(s: SparkSession, d: str) -> DataFrame:
    """The number of exact neighbours, and whether the cells find nine tenths of them."""
    v = table(s, d, "embeddings")
    found = search.nearest_by_cells(v, _vector_queries(v), search.fit_cells(v), 10)
    return search.recall(search.nearest(v, _vector_queries(v), 10, threshold=-1.0), found).select("pairs", (F.col("recall") >= 0.9).alias("enough"))


def _word_leg(s: SparkSession, d: str) -> DataFrame:
    """Documents by words: each document whose id is divisible by 20 is a query."""
    return search.keyword_search(_documents_index(s, d), _queries(s, d), 10)


def _vector_leg(s: SparkSession, d: str) -> DataFrame:
    """Documents by vector: each document's vector whose id is divisible by 20 is a query."""
    v = table(s, d, "embeddings").join(table(s, d, "documents").where("text is not null").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    return search.nearest(v, _vector_queries(v), 10)


def _hybrid(legs: tuple[DataFrame, DataFrame], mode: str) -> DataFrame:
    return search.hybrid(*legs, mode).select("query_id", "doc", F.round("score", 4).alias("score"), "both")


def hybrid_search(s: SparkSession, d: str) -> DataFrame:
    return _hybrid((_word_leg(s, d), _vector_leg(s, d)), "hybrid")


def hybrid_keyword_mode(s: SparkSession, d: str) -> DataFrame:
    """The leg that the mode leaves out isn't searched; the same holds for the vector mode, which needs no index."""
    leg = _word_leg(s, d)
    return _hybrid((leg, leg.limit(0)), "keyword")


def hybrid_vector_mode(s: SparkSession, d: str) -> DataFrame:
    leg = _vector_leg(s, d)
    return _hybrid((leg.limit(0), leg), "vector")


def _quality(s: SparkSession, d: str) -> DataFrame:
    """The share at 10 of each query and mode, where the documents whose vectors have the query's label are relevant."""
    v = table(s, d, "embeddings").select("vec_id", "label")
    relevant = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label").join(v, "label").select("query_id", F.col("vec_id").alias("doc"))
    # each leg is searched once for all modes
    legs = tuple(written(x.select("query_id", "doc", "score"), "leg") for x in (_word_leg(s, d), _vector_leg(s, d)))
    out = None
    for mode in ("keyword", "vector", "hybrid"):
        q = metrics.ranked_quality(search.top(_hybrid(legs, mode), 10), relevant, (10,)).select("query_id", F.lit(mode).alias("mode"), F.round("p_at_10", 6).alias("p_at_10"))
        out = q if out is None else out.unionByName(q)
    return out


def mode_comparison(s: SparkSession, d: str) -> DataFrame:
    c = metrics.compared(_quality(s, d))
    return c.select("query_id", "keyword", "vector", "hybrid", "best", F.round("improvement", 3).alias("improvement"))


def weight_recommendation(s: SparkSession, d: str) -> DataFrame:
    w = metrics.weights(_quality(s, d))
    return w.select(*[F.round(c, 5).alias(c) for c in ("keyword", "vector", "hybrid")], "keyword_wins", "vector_wins", "hybrid_wins", "keyword_weight", "vector_weight")


def vector_statistics(s: SparkSession, d: str) -> DataFrame:
    return metrics.vector_stats(table(s, d, "embeddings"))


def transitive_search(s: SparkSession, d: str) -> DataFrame:
    """Searches for the names that nothing is above in the relationship paths: hits by words, and the chunks of all that derives from them with its path."""
    e = graph.edges_of_paths(table(s, d, "search_results"))
    roots = e.select(F.col("src").alias("query_id")).distinct().join(e.select(F.col("dst").alias("query_id")), "query_id", "left_anti")
    r = search.orchestrate(_index(s, d), _chunks(s, d), roots.withColumn("text", F.col("query_id")), e, roots.select("query_id", F.col("query_id").alias("name")), k=10, depth=5)
    return r.select("query_id", "doc", F.round("score", 5).alias("score"), "is_transitive", "path")


def search_page(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "search_results").groupBy(F.col("result_id").alias("doc")).agg(F.max(F.struct("query_id", F.col("score").cast("double").alias("score"))).alias("r")).select("r.query_id", "doc", "r.score")
    return search.page(r, 10, 5).select("query_id", "doc", "total", "page")


def result_quality(s: SparkSession, d: str) -> DataFrame:
    """Shares of direct (not transitive) results among each query's ranks."""
    r = table(s, d, "search_results").dropDuplicates(["result_id"]).select("query_id", F.col("result_id").alias("doc"), "score", "is_transitive")
    q = metrics.ranked_quality(search.top(r, 20), r.where("not is_transitive"))
    return q.select("query_id", F.round("p_at_5", 6).alias("p_at_5"), F.round("p_at_10", 6).alias("p_at_10"), F.round("recall", 6).alias("recall"))


def inheritance_closure(s: SparkSession, d: str) -> DataFrame:
    e = graph.edges_of_paths(table(s, d, "search_results"))
    roots = e.select("src").distinct().join(e.select(F.col("dst").alias("src")), "src", "left_anti")
    return graph.closure(e, roots, 5).select("start", "name", "depth", "path")


def graph_degrees(s: SparkSession, d: str) -> DataFrame:
    return graph.degrees(graph.edges_of_paths(table(s, d, "search_results")))


def usage(s: SparkSession, d: str) -> DataFrame:
    return metrics.usage(table(s, d, "llm_usage"))


def usage_estimate(s: SparkSession, d: str) -> DataFrame:
    u = table(s, d, "llm_usage").dropDuplicates(["usage_id"])
    return u.select("usage_id", F.round(1e7 * scores.cost(F.col("provider"), F.col("model"), F.col("input_tokens"), F.col("output_tokens"))).cast("bigint").alias("cost_e7"), text.context_window(F.coalesce("model", F.lit(""))).alias("context_window"))


def usage_by_day(s: SparkSession, d: str) -> DataFrame:
    return metrics.usage_by_window(table(s, d, "llm_usage")).where("window_start is not null").select(F.to_date("window_start").alias("day"), "calls", "input_tokens")


def running_cost(s: SparkSession, d: str) -> DataFrame:
    return metrics.running_cost(table(s, d, "llm_usage")).select("provider", "day", F.round("running_cost", 4).alias("running_cost"))


def recent_usage(s: SparkSession, d: str) -> DataFrame:
    return metrics.recent(table(s, d, "llm_usage")).select("usage_id")


def token_estimates(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"), scores.token_cost_estimate(F.col("text")).alias("cost_tokens"))


def embedding_texts(s: SparkSession, d: str) -> DataFrame:
    return _chunks(s, d).select("id", F.length(text.embedding_text(F.col("content"), F.col("language"))).alias("n"), F.md5(text.embedding_text(F.col("content"), F.col("language"))).alias("md5"))


def context_blocks(s: SparkSession, d: str) -> DataFrame:
    c = _chunks(s, d)
    return c.select("id", F.md5(text.context_block(*[F.col(x) for x in ("source_file", "entity_name", "entity_type", "start_line", "end_line", "language", "content")])).alias("md5"))


def snippets(s: SparkSession, d: str) -> DataFrame:
    return _chunks(s, d).select("id", F.md5(text.snippet(F.col("content"))).alias("md5"))


def prompt_selection(s: SparkSession, d: str) -> DataFrame:
    """Chunks of the served results that fit a prompt of 8,192 tokens."""
    r = table(s, d, "search_results").groupBy("query_id", "source_file", "entity_name", "start_line", "end_line").agg(F.max("score").alias("score"))
    c = _chunks(s, d).select("source_file", "entity_name", "start_line", "end_line", F.col("id").alias("doc"), text.token_estimate(F.col("content")).alias("n_tokens"))
    scored = r.join(c, ["source_file", "entity_name", "start_line", "end_line"]).select("query_id", "doc", "source_file", F.col("score").cast("double").alias("score"), "n_tokens")
    return rag.choose(scored, rag.budget(8192, 500, 200)).select("query_id", "doc", "position")


def citations(s: SparkSession, d: str) -> DataFrame:
    return rag.cited(table(s, d, "documents").where("text is not null"), "doc_id").select("doc_id", "n", "file", "start_line", "end_line")


def query_kinds(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "search_results").select("doc_summary").distinct()
    return q.groupBy(text.query_kind(F.col("doc_summary")).alias("kind")).agg(F.count("*").alias("n"))


def progress_stages(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").groupBy(text.stage_of(F.col("text")).alias("stage")).agg(F.count("*").alias("n"))


def event_counts(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    return e.groupBy("event_type", F.date_trunc("day", "ts").cast("date").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("k"))


def hierarchy(s: SparkSession, d: str) -> DataFrame:
    """Customers and suppliers below their nation and region: sums at each level."""
    n = table(s, d, "nation").join(F.broadcast(table(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    c = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    return n.join(c, "n_nationkey").rollup("r_name", "n_name").agg(F.sum("customers").alias("customers"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = [k for k, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_") and k not in ("queries", "oracle_sql")]
    return {k: globals()[k] for k in names}


def oracle_sql() -> dict[str, str]:
    return sql.queries()
