"""Queries of lookups, text functions, search and vectors, with their SQL."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import search, vector
from graphloom.operators.graph import degrees
from graphloom.plans.graph_queries import NODE, SYM, edge, sym
from graphloom.session import checkpointed, spread
from graphloom.tables import live_nodes, read, read_wide


#: A team's own words with what its code calls them; this one holds a few Turkish and German stems of the test texts.
VOCABULARY = {"bul": "find", "liste": "list", "eşleştir": "match", "döndür": "return", "kaydı": "record", "sperre": "lock", "warte": "wait", "vorher": "before"}


def issues(spark: SparkSession, d: str) -> DataFrame:
    """Task texts: the issues among the documents, as (task_id, text, repo_id)."""
    docs = read_wide(spark, d, "documents").where(F.col("text").isNotNull() & (F.lower(F.trim("source")) == "issue"))
    return docs.select(F.col("doc_id").alias("task_id"), "text", "repo_id")


def resolve_symbol(spark: SparkSession, d: str) -> DataFrame:
    """Symbols by exact name: every name that several symbols share, with them."""
    s = sym(spark, d).select("name", "symbol_id", "repo_id")
    shared = s.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return s.join(shared, "name")


def resolve_symbols_bulk(spark: SparkSession, d: str) -> DataFrame:
    """Names of the unresolved references, resolved to symbols anywhere."""
    names = read(spark, d, "unresolved_ref").where(F.col("name").isNotNull()).select("name").distinct()
    return names.join(sym(spark, d).select("name", "symbol_id", "kind", "file_id", "line"), "name")


def symbols_in_files(spark: SparkSession, d: str) -> DataFrame:
    from graphloom.tables import row_rank

    s = sym(spark, d)
    return s.select("file_id", "symbol_id", "line", row_rank(["file_id"], [F.col("line").asc_nulls_first(), F.col("symbol_id")], "position"))


def symbols_at_lines(spark: SparkSession, d: str) -> DataFrame:
    """The symbols around each unresolved reference's line, innermost first."""
    refs = read(spark, d, "unresolved_ref").where(F.col("line").isNotNull()).select(F.col("ref_id").alias("place_id"), "file_id", "line").distinct()
    return search.symbols_at(sym(spark, d), refs)


def is_test_symbol(spark: SparkSession, d: str) -> DataFrame:
    return sym(spark, d).select("symbol_id", T.is_test_symbol(F.col("symbol_id"), F.col("name"), F.col("file_id")).alias("test"))


def conventional_tests(spark: SparkSession, d: str) -> DataFrame:
    files = live_nodes(read(spark, d, "graph_node"), "File").select("node_id")
    return files.select(F.col("node_id").alias("file_id"), F.explode(T.test_basenames(F.regexp_replace("node_id", r"^[^:]*:", ""))).alias("basename"))


def tokens_urls_stripped(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("token"))


def split_identifier(spark: SparkSession, d: str) -> DataFrame:
    return sym(spark, d).select("name").distinct().select("name", F.posexplode(T.split_identifier(F.col("name"))).alias("position", "part"))


def content_tokens(spark: SparkSession, d: str) -> DataFrame:
    return issues(spark, d).select("task_id", F.explode(T.content_tokens(F.col("text"))).alias("term"))


def phrase_pairs(spark: SparkSession, d: str) -> DataFrame:
    return issues(spark, d).select("task_id", F.explode(T.phrase_terms(F.col("text"))).alias("phrase"))


def identifier_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("token"))
    return t.where(T.looks_like_identifier(F.col("token"))).groupBy("token").agg(F.count_distinct("doc_id").alias("n_docs"))


def qualified_references(spark: SparkSession, d: str) -> DataFrame:
    return issues(spark, d).select("task_id", F.explode(T.qualified_references(F.col("text"))).alias("reference"))


def file_mentions(spark: SparkSession, d: str) -> DataFrame:
    return issues(spark, d).select("task_id", F.explode(T.file_mentions(F.col("text"))).alias("path"))


def body_literals(spark: SparkSession, d: str) -> DataFrame:
    return sym(spark, d).select("symbol_id", F.explode(T.body_literals(F.col("body"))).alias("literal"))


def _index(spark: SparkSession, d: str) -> DataFrame:
    """The postings, written once to the shared folder: building them costs more than any query that reads them."""
    return checkpointed(search.postings(spread(checkpointed(sym(spark, d)))))


def fts_build_postings(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).groupBy("token", "part").agg(F.count(F.lit(1)).alias("n_symbols"), F.sum("tf").alias("tf"))


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return content_tokens(spark, d).select("term").distinct()


def fts_prefix_search(spark: SparkSession, d: str) -> DataFrame:
    """How many symbols each task term reaches, and over how many words."""
    index = _index(spark, d)
    found = search.prefix_matches(index, _terms(spark, d)).join(index, "token")
    return found.groupBy("term").agg(F.count_distinct("symbol_id").alias("n_symbols"), F.count_distinct("token").alias("n_tokens"))


def fts_search_many_topn(spark: SparkSession, d: str) -> DataFrame:
    return search.term_hits(_index(spark, d), _terms(spark, d))


def anchors_lexical(spark: SparkSession, d: str) -> DataFrame:
    index = _index(spark, d)
    terms = checkpointed(content_tokens(spark, d))
    return search.lexical_anchors(search.term_hits(index, terms.select("term")), terms, search.phrase_hits(index, phrase_pairs(spark, d)))


def body_mentions_ident(spark: SparkSession, d: str) -> DataFrame:
    return search.mentions_of_words(sym(spark, d), identifier_tokens(spark, d).select(F.col("token").alias("word")))


def body_mentions_literal(spark: SparkSession, d: str) -> DataFrame:
    s = sym(spark, d)
    return search.mentions_of_literals(s, s.select(F.explode(T.body_literals(F.col("body"))).alias("literal")))


def _files(spark: SparkSession, d: str) -> DataFrame:
    return live_nodes(read(spark, d, "graph_node"), "File").select(F.col("node_id").alias("file_id"))


def named_paths(spark: SparkSession, d: str) -> DataFrame:
    """(task_id, path): files that issue texts name, and those of unresolved references by folder and name, as a report would write them."""
    refs = read(spark, d, "unresolved_ref").select(F.col("ref_id").alias("task_id"), F.regexp_extract("file_id", r"([^/]+/[^/]+)$", 1).alias("path"))
    return file_mentions(spark, d).unionByName(refs.where(F.length("path") > 0)).distinct()


def _mentioned(spark: SparkSession, d: str) -> DataFrame:
    return named_paths(spark, d).select(F.col("path").alias("suffix")).distinct()


def path_suffix_lookup(spark: SparkSession, d: str) -> DataFrame:
    return search.files_by_suffix(_files(spark, d), _mentioned(spark, d))


def missing_paths(spark: SparkSession, d: str) -> DataFrame:
    return search.missing_paths(_files(spark, d), _mentioned(spark, d))


def directory_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Scanned files that share a folder."""
    return search.directory_neighbours(read(spark, d, "source_file").select("file_id").distinct())


def basename_wildcard(spark: SparkSession, d: str) -> DataFrame:
    """Files of the same name family: first word of the name, then anything, same extension."""
    f = _files(spark, d)
    name = F.element_at(F.split("file_id", "/"), -1)
    word = F.regexp_extract(name, r"^([a-z]+|[A-Z][a-z]+)", 1)
    patterns = f.select(F.concat(F.lower(word), F.lit("*"), F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("pattern"), F.length(word).alias("n")).where("n > 0").select("pattern").distinct()
    return search.basename_matches(f, patterns)


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as two chunks of half as many references."""
    e = read(spark, d, "embeddings")
    n = e.agg((F.count(F.lit(1)) / 2).cast("bigint").alias("h")).first()["h"] or 1
    return e.select("vec_id", F.pmod("vec_id", F.lit(n)).alias("ref_id"), F.floor(F.col("vec_id") / n).cast("bigint").alias("chunk"), "embedding", "label")


def knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Nearest ten of every vector whose id is divisible by 100, against all."""
    e = read(spark, d, "embeddings")
    rows = e.select(F.col("vec_id").alias("ref_id"), F.lit(0).cast("bigint").alias("chunk"), "embedding")
    return vector.nearest(rows, e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")).drop("chunk")


def knn_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The same among vectors of the query's label."""
    e = read(spark, d, "embeddings")
    rows = e.select(F.col("vec_id").alias("ref_id"), F.lit(0).cast("bigint").alias("chunk"), "embedding", "label")
    return vector.nearest(rows, e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label"), same=["label"]).drop("chunk")


def knn_index(spark: SparkSession, d: str) -> DataFrame:
    """Nearest ten of the same queries by the index."""
    e = read(spark, d, "embeddings")
    rows = e.select(F.col("vec_id").alias("ref_id"), F.lit(0).cast("bigint").alias("chunk"), "embedding")
    return vector.nearest_by_index(rows, e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")).drop("chunk")


def knn_index_recall(spark: SparkSession, d: str) -> DataFrame:
    """The index held against the exact search."""
    return vector.recall_of(knn_index(spark, d), knn_cosine(spark, d))


def semantic_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The 40 symbols outside tests that are nearest to each issue by hashed words, from four times as many neighbours."""
    return semantic_ranks(issues(spark, d), sym(spark, d))


def semantic_ranks(tasks: DataFrame, symbols: DataFrame, limit: int = 40, encoder=None) -> DataFrame:
    """(task_id, symbol_id, semantic_rank): ``encoder`` turns texts into vectors; the hashing one needs no model."""
    encode = encoder or vector.hashing_encoder(64)
    s = symbols.select(F.xxhash64("symbol_id").alias("ref_id"), "symbol_id", "is_test", encode(F.concat_ws(" ", "name", "signature", "docstring")).alias("embedding"))
    s = checkpointed(s)
    hits = vector.nearest(s.select("ref_id", F.lit(0).cast("bigint").alias("chunk"), "embedding"), tasks.select(F.col("task_id").alias("query_id"), encode("text").alias("embedding")), k=4 * limit)
    return vector.semantic_candidates(hits, s, limit).withColumnRenamed("query_id", "task_id")


def similar_code(spark: SparkSession, d: str) -> DataFrame:
    """Symbols whose code is nearest to that of every symbol whose id's hash is divisible by 100."""
    encode = vector.hashing_encoder(64)
    s = checkpointed(sym(spark, d).where(F.length("body") > 0).select(F.xxhash64("symbol_id").alias("ref_id"), F.lit(0).cast("bigint").alias("chunk"), encode("body").alias("embedding")))
    return vector.nearest(s, s.where("ref_id % 100 = 0").select(F.col("ref_id").alias("query_id"), "embedding"), k=5).drop("chunk")


def chunk_collapse(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return vector.collapsed(vector.nearest(v.select("ref_id", "chunk", "embedding"), v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), k=20))


def hashing_embed(spark: SparkSession, d: str) -> DataFrame:
    encode = vector.hashing_encoder(64)
    return sym(spark, d).select("symbol_id", encode(F.concat_ws(" ", "name", "signature", "docstring")).alias("embedding"))


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Names of the shared library looked up in both channels: prefix search of their parts and hashed vectors."""
    encode = vector.hashing_encoder(64)
    lib = read(spark, d, "library_symbol").select(F.xxhash64("symbol_id").alias("query_id"), "name")
    s = sym(spark, d).withColumn("ref_id", F.xxhash64("symbol_id"))
    parts = lib.select("query_id", "name", F.explode(T.split_identifier(F.col("name"))).alias("term"), F.size(T.split_identifier(F.col("name"))).alias("n"))
    hits = search.term_hits(_index(spark, d), parts.select("term"), limit=None)
    lexical = parts.join(hits, "term").groupBy("query_id", "name", "symbol_id").agg((F.count_distinct("term") / F.max("n")).alias("lexical"))
    lexical = lexical.join(s.select("symbol_id", F.col("name").alias("own")), "symbol_id").select("query_id", "symbol_id", "lexical", (F.col("own") == F.col("name")).alias("exact"))
    rows = s.select("ref_id", F.lit(0).cast("bigint").alias("chunk"), encode(F.concat_ws(" ", "name", "docstring")).alias("embedding"))
    found = vector.nearest(rows, lib.select("query_id", encode("name").alias("embedding")), k=30)
    semantic = found.join(s.select("ref_id", "symbol_id"), "ref_id").select("query_id", "symbol_id", (1 - F.col("distance")).alias("semantic"))
    return search.hybrid(lexical, semantic, degrees(edge(spark, d)))


def query_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms of the issues with the code words of Turkish ones."""
    return terms_of(content_tokens(spark, d))


def terms_of(tokens: DataFrame) -> DataFrame:
    """The terms of tasks (task_id, term) with those of the vocabulary."""
    words = tokens.sparkSession.createDataFrame(pa.table({"stem": sorted(VOCABULARY), "word": [VOCABULARY[k] for k in sorted(VOCABULARY)]}))
    return search.with_equivalents(tokens, words)


QUERIES = {
    f.__name__: f
    for f in (
        resolve_symbol, resolve_symbols_bulk, symbols_in_files, symbols_at_lines, is_test_symbol, conventional_tests, tokens_urls_stripped, split_identifier, content_tokens, query_terms, phrase_pairs, identifier_tokens, qualified_references,
        file_mentions, body_literals, fts_build_postings, fts_prefix_search, fts_search_many_topn, anchors_lexical, body_mentions_ident, body_mentions_literal, path_suffix_lookup, missing_paths, directory_neighbours,
        basename_wildcard, knn_cosine, knn_filtered, knn_index, knn_index_recall, semantic_candidates, similar_code, chunk_collapse, hashing_embed, hybrid_search,
    )
}

_W = "([\\p{L}_][\\p{L}\\p{N}_]*)"
_NOURL = "regexp_replace({}, '(?i)\\b[a-z][a-z0-9+.-]*://\\S+', ' ', 'g')"
_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_ISSUE = "issue AS (SELECT doc_id AS task_id, text FROM documents WHERE text IS NOT NULL AND lower(trim(source)) = 'issue')"


def _low(x: str) -> str:
    return f"lower(replace({x}, 'İ', 'i'))"


def _split(x: str) -> str:
    humps = f"regexp_replace(regexp_replace(regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')"
    return f"list_filter(string_split({_low(f'''regexp_replace({humps}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')''')}, ' '), lambda p: p <> '')"


_TOKENS = f"tok AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all({_NOURL.format('text')}, '{_W}', 1))) AS token FROM documents)"
_CONTENT = f"""{_ISSUE}, itok AS (SELECT task_id, unnest(regexp_extract_all({_NOURL.format('text')}, '{_W}', 1)) AS token FROM issue),
  part AS (SELECT DISTINCT task_id, unnest(list_concat([{_low('token')}], {_split('token')})) AS term FROM itok), content AS (SELECT DISTINCT task_id, term FROM part WHERE length(term) >= 3 AND term NOT IN ({_STOP}))"""
_PHRASES = f"""pt AS (SELECT task_id, regexp_extract_all({_NOURL.format('text')}, '{_W}', 1) AS w FROM issue), pf AS (SELECT task_id, unnest(w) AS token, unnest(range(len(w))) AS i FROM pt), pu AS (SELECT task_id, token, min(i) AS i FROM pf GROUP BY task_id, token),
  pk AS (SELECT task_id, {_low('token')} AS term, i FROM pu WHERE length(token) >= 3 AND {_low('token')} NOT IN ({_STOP})), pp AS (SELECT task_id, term, lead(term) OVER (PARTITION BY task_id ORDER BY i) AS nxt FROM pk), phrases AS (SELECT DISTINCT task_id, term || ' ' || nxt AS phrase FROM pp WHERE nxt IS NOT NULL AND term <> nxt)"""
_POST = f"""word AS (SELECT symbol_id, 'a' AS part, {_low('name')} AS token FROM sym UNION ALL SELECT symbol_id, 'b', unnest({_split('name')}) FROM sym
  UNION ALL SELECT symbol_id, 'c', unnest(list_concat({_split("coalesce(namespace, '')")}, {_split("coalesce(regexp_replace(regexp_replace(file_id, '^[^:]*:', ''), '\\.[^./]*$', ''), '')")})) FROM sym
  UNION ALL SELECT symbol_id, 'd', unnest(list_concat(list_concat(regexp_extract_all({_low("coalesce(signature, '')")}, '([\\p{{L}}\\p{{N}}_]+)', 1), regexp_extract_all({_low("coalesce(docstring, '')")}, '([\\p{{L}}\\p{{N}}_]+)', 1)), regexp_extract_all({_low("coalesce(body, '')")}, '([\\p{{L}}\\p{{N}}_]+)', 1))) FROM sym),
  len AS (SELECT symbol_id, count(*) AS doc_len FROM word GROUP BY symbol_id), post AS (SELECT token, part, symbol_id, doc_len, count(*) AS tf FROM word JOIN len USING (symbol_id) WHERE length(token) >= 3 GROUP BY ALL)"""
_HITS = """term AS (SELECT DISTINCT term FROM content), dict AS (SELECT DISTINCT token FROM post), pm AS (SELECT term, token FROM term JOIN dict ON substr(term, 1, 3) = substr(token, 1, 3) AND starts_with(token, term)),
  hit AS (SELECT term, symbol_id, round(sum(CASE part WHEN 'a' THEN 1.0 WHEN 'b' THEN 0.4 WHEN 'c' THEN 0.2 ELSE 0.1 END::DOUBLE) / (1 + ln(max(doc_len))), 6) AS score, min(part) AS tier FROM pm JOIN post USING (token) GROUP BY term, symbol_id),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY score DESC, symbol_id) AS rank FROM hit) WHERE rank <= 25)"""
_TESTPATH = "(regexp_matches({0}, '(?i)(^|/)(test|tests|__tests__|spec|specs|testing|e2e|fixtures)/') OR regexp_matches({0}, '(^|/)(test_[^/]*|[^/]*_test(\\.[a-z]+)?|[^/]*\\.(test|spec)\\.[a-z]+|[^/]*(Test|Tests|Spec|Specs)\\.(java|cs|kt|scala|php|rb)|conftest\\.py)$'))"
_FILE = "file AS (SELECT node_id AS file_id, regexp_replace(node_id, '^[^:]*:', '') AS path FROM node WHERE label = 'File')"
_MENTION = f"""mention AS (SELECT DISTINCT task_id, regexp_replace(path, '^[./]+', '') AS path FROM (SELECT task_id, unnest(regexp_extract_all(replace({_NOURL.format('text')}, '\\', '/'), '(?:^|[^\\p{{L}}\\p{{N}}_/.-])((?:\\.{{0,2}}/)?(?:[\\w.-]+/)*[\\w-]+\\.(?:pyi|py|tsx|ts|jsx|js|mjs|cjs|go|java|kt|cs|rb|rs|php|swift|cpp|cc|hpp|c|h|scala|sql))(?:[^\\w/]|$)', 1)) AS path FROM issue))"""
_NAMED = "named AS (SELECT task_id, path FROM mention UNION SELECT ref_id, regexp_extract(file_id, '([^/]+/[^/]+)$', 1) FROM unresolved_ref WHERE regexp_extract(file_id, '([^/]+/[^/]+)$', 1) <> '')"
_VEC = "v AS (SELECT vec_id, vec_id % (count(*) OVER () // 2) AS ref_id, vec_id // (count(*) OVER () // 2) AS chunk, embedding::DOUBLE[] AS e, label FROM embeddings)"

ORACLE = {
    "resolve_symbol": f"WITH {SYM} SELECT name, symbol_id, repo_id, n FROM (SELECT *, count(*) OVER (PARTITION BY name) AS n FROM sym) WHERE n > 1",
    "resolve_symbols_bulk": f"WITH {SYM} SELECT r.name, s.symbol_id, s.kind, s.file_id, s.line FROM (SELECT DISTINCT name FROM unresolved_ref WHERE name IS NOT NULL) r JOIN sym s ON s.name = r.name",
    "symbols_in_files": f"WITH {SYM} SELECT file_id, symbol_id, line, row_number() OVER (PARTITION BY file_id ORDER BY line NULLS FIRST, symbol_id) AS position FROM sym",
    "symbols_at_lines": f"WITH {SYM} SELECT r.ref_id AS place_id, s.symbol_id, row_number() OVER (PARTITION BY r.ref_id ORDER BY s.end_line - s.line, s.line, s.symbol_id) AS depth FROM (SELECT DISTINCT ref_id, file_id, line FROM unresolved_ref WHERE line IS NOT NULL) r JOIN sym s ON s.file_id = r.file_id AND r.line BETWEEN s.line AND s.end_line",
    "is_test_symbol": f"""WITH {SYM} SELECT symbol_id, {_TESTPATH.format("regexp_replace(coalesce(file_id, ''), '^[^:]*:', '')")} OR {_TESTPATH.format("replace(coalesce(string_split(symbol_id, '::')[2], ''), '.', '/')")} OR regexp_matches(coalesce(name, ''), '^(test_|it_|should_|spec_)') AS test FROM sym""",
    "tokens_urls_stripped": f"WITH {_TOKENS} SELECT doc_id, token FROM tok",
    "split_identifier": f"WITH {SYM}, n AS (SELECT DISTINCT name FROM sym), p AS (SELECT name, {_split('name')} AS parts FROM n) SELECT name, unnest(range(len(parts))) AS position, unnest(parts) AS part FROM p",
    "content_tokens": f"WITH {_CONTENT} SELECT task_id, term FROM content",
    "query_terms": f"""WITH {_CONTENT}, voc(stem, word) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in sorted(VOCABULARY.items()))}), m AS (SELECT DISTINCT c.term, v.stem, v.word FROM (SELECT DISTINCT term FROM content) c JOIN voc v ON c.term = v.stem OR (length(v.stem) >= 4 AND starts_with(c.term, v.stem) AND regexp_matches(substr(c.term, length(v.stem) + 1), '{search.SUFFIX_CHAIN}'))),
        b AS (SELECT term, word FROM (SELECT *, rank() OVER (PARTITION BY term ORDER BY length(stem) DESC) AS k FROM m) WHERE k = 1) SELECT task_id, term FROM content UNION SELECT task_id, word FROM content JOIN b USING (term)""",
    "identifier_tokens": f"WITH {_TOKENS} SELECT token, count(DISTINCT doc_id) AS n_docs FROM tok WHERE length(token) >= 3 AND {_low('token')} NOT IN ({_STOP}) AND (regexp_matches(token, '[^_]_[^_]') OR regexp_matches(token, '[0-9]') OR regexp_matches(token, '[a-z][A-Z]') OR (regexp_matches(token, '^[A-Z0-9_]*[A-Z][A-Z0-9_]*$') AND length(token) >= 4)) GROUP BY token",
    "phrase_pairs": f"WITH {_ISSUE}, {_PHRASES} SELECT task_id, phrase FROM phrases",
    "qualified_references": f"WITH {_ISSUE} SELECT DISTINCT task_id, unnest(regexp_extract_all({_NOURL.format('text')}, '([A-Za-z_][A-Za-z0-9_]*(?:[.:]{{1,2}}[A-Za-z_][A-Za-z0-9_]*)+)', 1)) AS reference FROM issue",
    "body_literals": f"""WITH {SYM}, b AS (SELECT symbol_id, list_filter(list_concat(regexp_extract_all(body, '"([A-Za-z_/][\\w.:/-]{{3,63}})"', 1), regexp_extract_all(body, '''([A-Za-z_/][\\w.:/-]{{3,63}})''', 1)), lambda x: regexp_matches(x, '[-_./:0-9]|[a-z][A-Z]')) AS l FROM sym),
        f AS (SELECT symbol_id, unnest(l) AS literal, unnest(range(len(l))) AS i FROM b), u AS (SELECT symbol_id, literal, min(i) AS i FROM f GROUP BY ALL) SELECT symbol_id, literal FROM (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY i) AS r FROM u) WHERE r <= 12""",
    "fts_build_postings": f"WITH {SYM}, {_POST} SELECT token, part, count(*) AS n_symbols, sum(tf) AS tf FROM post GROUP BY token, part",
    "fts_prefix_search": f"WITH {SYM}, {_POST}, {_CONTENT}, {_HITS} SELECT term, count(DISTINCT symbol_id) AS n_symbols, count(DISTINCT token) AS n_tokens FROM pm JOIN post USING (token) GROUP BY term",
    "fts_search_many_topn": f"WITH {SYM}, {_POST}, {_CONTENT}, {_HITS} SELECT * FROM best",
    "anchors_lexical": f"""WITH {SYM}, {_POST}, {_CONTENT}, {_HITS}, {_PHRASES}, pool AS (SELECT term, count(*) AS n FROM best GROUP BY term), w AS (SELECT task_id, term, n, CASE WHEN coalesce(n, 0) >= 25 THEN 0.35 ELSE 1.0 END::DOUBLE AS w FROM content LEFT JOIN pool USING (term)),
        total AS (SELECT task_id, sum(w) AS total, count(*) AS n_terms FROM w GROUP BY task_id), holds AS (SELECT DISTINCT term, symbol_id FROM pm JOIN post USING (token)), ph AS (SELECT DISTINCT phrase FROM phrases),
        pair AS (SELECT phrase, a.symbol_id FROM ph JOIN holds a ON a.term = string_split(phrase, ' ')[1] JOIN holds b ON b.term = string_split(phrase, ' ')[2] AND a.symbol_id = b.symbol_id), rare AS (SELECT phrase FROM pair GROUP BY phrase HAVING count(*) < 25),
        got AS (SELECT task_id, symbol_id, sum(got) AS got FROM (SELECT task_id, symbol_id, w * CASE tier WHEN 'a' THEN 1.0 WHEN 'b' THEN 0.9 WHEN 'c' THEN 0.6 ELSE 0.35 END::DOUBLE AS got FROM w JOIN best USING (term) UNION ALL SELECT task_id, symbol_id, 1.0 FROM phrases JOIN pair USING (phrase) JOIN rare USING (phrase)) GROUP BY task_id, symbol_id),
        s AS (SELECT task_id, symbol_id, round(least(got / total * CASE WHEN n_terms <= 3 THEN 1.0 ELSE 3.0 END, 0.8), 6) AS strength FROM got JOIN total USING (task_id))
        SELECT task_id, symbol_id, strength FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY strength DESC, symbol_id) AS r FROM s WHERE strength >= 0.15) WHERE r <= 15""",
    "body_mentions_ident": f"""WITH {SYM}, {_TOKENS}, ident AS (SELECT DISTINCT token AS word FROM tok WHERE length(token) >= 3 AND {_low('token')} NOT IN ({_STOP}) AND (regexp_matches(token, '[^_]_[^_]') OR regexp_matches(token, '[0-9]') OR regexp_matches(token, '[a-z][A-Z]') OR (regexp_matches(token, '^[A-Z0-9_]*[A-Z][A-Z0-9_]*$') AND length(token) >= 4))),
        b AS (SELECT symbol_id, unnest(list_distinct(regexp_extract_all(coalesce(search_text, ''), '([A-Za-z_][A-Za-z0-9_]*)', 1))) AS word FROM sym WHERE NOT is_test), f AS (SELECT word, symbol_id, count(*) OVER (PARTITION BY word) AS n FROM b SEMI JOIN ident USING (word)) SELECT word, symbol_id, n FROM f WHERE n < 60""",
    "conventional_tests": f"""WITH {NODE}, {_FILE}, n AS (SELECT file_id, path, string_split(path, '/')[-1] AS name FROM file), p AS (SELECT file_id, path, regexp_extract(name, '^(.*)\\.[^.]*$', 1) AS s, lower(regexp_extract(name, '\\.([^.]*)$', 1)) AS e FROM n)
        SELECT file_id, unnest(CASE WHEN e IN ('py', 'pyi') THEN ['test_' || s || '.py', s || '_test.py'] WHEN e IN ('ts', 'tsx') THEN [s || '.test.ts', s || '.test.tsx', s || '.spec.ts', s || '.spec.tsx']
          WHEN e IN ('js', 'jsx', 'mjs', 'cjs') THEN [s || '.test.js', s || '.test.jsx', s || '.test.mjs', s || '.test.cjs', s || '.spec.js', s || '.spec.jsx', s || '.spec.mjs', s || '.spec.cjs'] WHEN e = 'go' THEN [s || '_test.go']
          WHEN e IN ('java', 'kt', 'scala', 'php') THEN [s || 'Test.' || e, s || 'Tests.' || e, 'Test' || s || '.' || e] WHEN e = 'cs' THEN [s || 'Tests.cs', s || 'Test.cs'] WHEN e = 'rb' THEN [s || '_spec.rb', s || '_test.rb'] ELSE [] END) AS basename
        FROM p WHERE NOT {_TESTPATH.format('path')} AND s <> '' AND NOT starts_with(s, '__')""",
    "body_mentions_literal": f"""WITH {SYM}, b AS (SELECT symbol_id, list_filter(list_concat(regexp_extract_all(body, '"([A-Za-z_/][\\w.:/-]{{3,63}})"', 1), regexp_extract_all(body, '\'\'([A-Za-z_/][\\w.:/-]{{3,63}})\'\'', 1)), lambda x: regexp_matches(x, '[-_./:0-9]|[a-z][A-Z]')) AS l FROM sym),
        f AS (SELECT symbol_id, unnest(l) AS literal, unnest(range(len(l))) AS i FROM b), u AS (SELECT symbol_id, literal, min(i) AS i FROM f GROUP BY ALL), want AS (SELECT DISTINCT literal FROM (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY i) AS r FROM u) WHERE r <= 12),
        q AS (SELECT symbol_id, unnest(list_distinct(list_concat(regexp_extract_all(coalesce(search_text, ''), '"([^"\\n]{{3,80}})"', 1), regexp_extract_all(coalesce(search_text, ''), '\'\'([^\'\'\\n]{{3,80}})\'\'', 1)))) AS literal FROM sym WHERE NOT is_test),
        h AS (SELECT literal, symbol_id, count(*) OVER (PARTITION BY literal) AS n FROM q SEMI JOIN want USING (literal)) SELECT literal, symbol_id, n FROM h WHERE n < 60""",
    "file_mentions": f"WITH {_ISSUE}, {_MENTION} SELECT task_id, path FROM mention",
    "basename_wildcard": f"""WITH {NODE}, {_FILE}, n AS (SELECT file_id, string_split(path, '/')[-1] AS name FROM file), p AS (SELECT DISTINCT lower(w) AS word, lower(e) AS ext, lower(w) || '*' || e AS pattern FROM (SELECT regexp_extract(name, '^([a-z]+|[A-Z][a-z]+)', 1) AS w, regexp_extract(name, '(\\.[^.]*)$', 1) AS e FROM n) WHERE w <> ''),
        h AS (SELECT DISTINCT p.pattern, n.file_id FROM p JOIN n ON starts_with(lower(n.name), p.word) AND ends_with(lower(n.name), p.ext) AND length(n.name) >= length(p.word) + length(p.ext)) SELECT pattern, file_id FROM (SELECT *, count(*) OVER (PARTITION BY pattern) AS k FROM h) WHERE k <= 8""",
    "path_suffix_lookup": f"""WITH {NODE}, {_FILE}, {_ISSUE}, {_MENTION}, {_NAMED}, s AS (SELECT DISTINCT lower(path) AS suffix FROM named), f AS (SELECT s.suffix, f.file_id FROM file f JOIN s ON lower(f.path) = s.suffix OR ends_with(lower(f.path), '/' || s.suffix)) SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY suffix) AS n FROM f) WHERE n <= 8""",
    "missing_paths": f"WITH {NODE}, {_FILE}, {_ISSUE}, {_MENTION}, {_NAMED}, s AS (SELECT DISTINCT lower(path) AS suffix FROM named) SELECT suffix FROM s WHERE NOT EXISTS (SELECT 1 FROM file f WHERE lower(f.path) = s.suffix OR ends_with(lower(f.path), '/' || s.suffix))",
    "directory_neighbours": f"WITH f AS (SELECT DISTINCT file_id, regexp_replace(file_id, '/[^/]*$', '') AS folder FROM source_file), k AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY folder) AS n FROM f) WHERE n <= 60) SELECT a.file_id, b.file_id AS neighbour_id FROM k a JOIN k b ON a.folder = b.folder AND a.file_id <> b.file_id",
    "knn_cosine": """WITH d AS (SELECT q.vec_id AS query_id, r.vec_id AS ref_id, round(1 - list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 6) AS distance FROM embeddings q, embeddings r WHERE q.vec_id % 100 = 0)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, ref_id) AS rank FROM d) WHERE rank <= 10""",
    "knn_filtered": """WITH d AS (SELECT q.vec_id AS query_id, r.vec_id AS ref_id, round(1 - list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 6) AS distance FROM embeddings q JOIN embeddings r ON q.label = r.label WHERE q.vec_id % 100 = 0)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, ref_id) AS rank FROM d) WHERE rank <= 10""",
    "chunk_collapse": f"""WITH {_VEC}, d AS (SELECT q.vec_id AS query_id, r.ref_id, r.chunk, round(1 - list_cosine_similarity(q.e, r.e), 6) AS distance FROM v q, v r WHERE q.vec_id % 100 = 0),
        t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, ref_id, chunk) AS k FROM d) WHERE k <= 20), m AS (SELECT query_id, ref_id, min(distance) AS distance FROM t GROUP BY query_id, ref_id) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, ref_id) AS rank FROM m""",
}
