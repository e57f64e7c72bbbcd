"""Lookups by name, place, path and scope; bounded views of a repository's graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.tables import row_rank


def resolve(queries: DataFrame, symbols: DataFrame, most: int = 50) -> DataFrame:
    """(query_id, symbol_id, way, place): what each query text means, the best ``most``.

    ``path:10`` and ``path:10-20`` are the symbols around those lines, innermost first; ``Owner.member`` is the member of that
    owner, or of any where no owner has it; anything else is a name. Symbols outside tests come first, then by id. Null and
    empty texts mean nothing.
    """
    q = queries.where(F.length("text") > 0).select("query_id", F.trim("text").alias("text"))
    place = q.where(F.col("text").rlike(r":\d+(-\d+)?$")).select("query_id", F.lower(F.regexp_replace(F.regexp_extract("text", r"^(.*):\d", 1), r"^[./]+", "")).alias("suffix"), F.regexp_extract("text", r":(\d+)", 1).cast("int").alias("a"), F.coalesce(F.expr("try_cast(nullif(regexp_extract(text, '-([0-9]+)$', 1), '') AS INT)"), F.regexp_extract("text", r":(\d+)", 1).cast("int")).alias("b"))
    tails = symbols.where(F.col("end_line").isNotNull() & F.col("file_id").isNotNull()).select("symbol_id", "is_test", "line", "end_line", F.explode(T.path_tails(F.regexp_replace("file_id", r"^[^:]*:", ""))).alias("suffix"))
    at = place.join(tails, "suffix").where((F.col("line") <= F.col("b")) & (F.col("end_line") >= F.col("a"))).select("query_id", "symbol_id", F.lit("place").alias("way"), (F.col("end_line") - F.col("line")).alias("o"), "is_test")
    names = q.where(~F.col("text").rlike(r":\d+(-\d+)?$")).withColumn("p", F.split(F.regexp_replace("text", r"[.:]+", "."), r"\."))
    names = names.select("query_id", F.element_at("p", -1).alias("name"), F.try_element_at("p", F.lit(-2)).alias("owner"))
    s = symbols.select("symbol_id", "name", "is_test", F.try_element_at(F.split(F.split("symbol_id", "#")[0], "::"), F.lit(-2)).alias("inside"))
    m = names.join(s, "name").withColumn("own", F.coalesce(F.col("inside") == F.col("owner"), F.lit(False)))
    owned = m.groupBy("query_id").agg(F.max("own").alias("any"))
    named = m.join(owned, "query_id").where(~F.col("any") | F.col("own")).select("query_id", "symbol_id", F.when(F.col("own"), "member").otherwise("name").alias("way"), F.lit(0).alias("o"), "is_test")
    found = at.unionByName(named)
    return found.select("query_id", "symbol_id", "way", row_rank(["query_id"], [F.col("is_test").cast("int"), F.col("o"), F.col("symbol_id")], "place")).where(F.col("place") <= most)


def routes(nodes: DataFrame, edges: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """(route_id, method, path, handler_id): route nodes whose path contains one of ``parts`` (column part), with handlers where known.

    ``parts`` are the paths of a request; more than a thousand of them are refused, because each is tried on every route.
    """
    r = nodes.where(F.col("label") == "Route").select(F.col("node_id").alias("route_id"), F.get_json_object("properties", "$.http_method").alias("method"), F.get_json_object("properties", "$.path_pattern").alias("path"))
    if parts is not None:
        if parts.limit(1001).count() > 1000:
            raise ValueError("more than 1000 path parts")
        r = r.join(F.broadcast(parts.select("part")), F.col("path").contains(F.col("part")), "left_semi")  # at most 1000 rows
    return r.join(edges.where(F.col("label") == "ROUTES_TO").select(F.col("src_id").alias("route_id"), F.col("dst_id").alias("handler_id")), "route_id", "left")


def _key(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(name, r"(?i)\.git/?$", "")), r"^.*/", ""), r"[-_. ]+", "")


def resolve_repositories(ids: DataFrame, repos: DataFrame) -> DataFrame:
    """(given, repo_id, way): a repository for each spelling: exact, then without case, then without separators, else as given.

    Among several of one spelling the least id counts.
    """
    r = repos.select("repo_id").distinct()
    low = r.groupBy(F.lower("repo_id").alias("k")).agg(F.min("repo_id").alias("by_case"))
    key = r.groupBy(_key(F.col("repo_id")).alias("k")).agg(F.min("repo_id").alias("by_key"))
    x = ids.select("given").distinct().join(r.select(F.col("repo_id").alias("given"), F.col("repo_id").alias("exact")), "given", "left")
    x = x.join(low, F.lower("given") == F.col("k"), "left").drop("k").join(key, _key(F.col("given")) == F.col("k"), "left").drop("k")
    way = F.when(F.col("exact").isNotNull(), "exact").when(F.col("by_case").isNotNull(), "case").when(F.col("by_key").isNotNull(), "key").otherwise("given")
    return x.select("given", F.coalesce("exact", "by_case", "by_key", "given").alias("repo_id"), way.alias("way"))


def normalised_file_id(repo_id: Column, path: Column) -> Column:
    """``repo:path`` with forward slashes and without leading dots and slashes; an id that has its repository keeps it."""
    clean = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^[./]+", "")
    return F.when(path.rlike(r"^[\w.-]+:[^/\\]"), F.concat(F.regexp_extract(path, r"^([^:]*):", 1), F.lit(":"), F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"^[^:]*:", ""), r"\\", "/"), r"^[./]+", ""))).otherwise(F.concat(repo_id, F.lit(":"), clean))


def visible(rows: DataFrame, scopes: DataFrame, user_id: str | None) -> DataFrame:
    """Rows of the repositories that a user may see; without a user all rows, for an unknown user none. Null repositories are denied."""
    if user_id is None:
        return rows
    return rows.join(scopes.where(F.col("user_id") == user_id).select("repo_id").distinct(), "repo_id", "left_semi")


def bounded_graph(nodes: DataFrame, edges: DataFrame, per_label: int = 5000, most_edges: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of each repository for display: the first ``per_label`` nodes of a label by id, the first edges among them."""
    kept = nodes.select("repo_id", "label", "node_id", row_rank(["repo_id", "label"], [F.col("node_id")])).where(F.col("rank") <= per_label).drop("rank")
    ids = kept.select("repo_id", "node_id").distinct()
    e = edges.join(ids.select("repo_id", F.col("node_id").alias("src_id")), "src_id").join(ids.select("repo_id", F.col("node_id").alias("dst_id")), ["repo_id", "dst_id"], "left_semi")
    shown = e.select("repo_id", "label", "src_id", "dst_id", row_rank(["repo_id"], [F.col("label"), F.col("src_id"), F.col("dst_id")])).where(F.col("rank") <= most_edges).drop("rank")
    return kept, shown


def node_neighbours(ids: DataFrame, edges: DataFrame, most: int = 200) -> DataFrame:
    """(node_id, direction, label, other_id): edges out of and into each node, the first ``most`` of a direction."""
    both = edges.select(F.col("src_id").alias("node_id"), F.lit("out").alias("direction"), "label", F.col("dst_id").alias("other_id")).unionByName(edges.select(F.col("dst_id").alias("node_id"), F.lit("in").alias("direction"), "label", F.col("src_id").alias("other_id")))
    mine = both.join(ids.select("node_id").distinct(), "node_id", "left_semi")
    return mine.select("*", row_rank(["node_id", "direction"], [F.col("label"), F.col("other_id")])).where(F.col("rank") <= most).drop("rank")


def search_names_and_paths(terms: DataFrame, symbols: DataFrame, most: int = 50) -> DataFrame:
    """(term, kind, id, place): symbols with the term as a part of their name, then files with it as a part of their path.

    Parts are whole words of names and paths, joined by equality.
    """
    t = terms.select(F.lower("term").alias("term")).distinct()
    s = symbols.select("symbol_id", F.explode(F.array_distinct(F.concat(F.array(F.lower("name")), T.split_identifier(F.col("name"))))).alias("term")).join(t, "term").select("term", F.lit("symbol").alias("kind"), F.col("symbol_id").alias("id"))
    f = symbols.where(F.col("file_id").isNotNull()).select("file_id").distinct()
    f = f.select("file_id", F.explode(F.array_distinct(T.split_identifier(F.regexp_replace("file_id", r"^[^:]*:", "")))).alias("term")).join(t, "term").select("term", F.lit("file").alias("kind"), F.col("file_id").alias("id"))
    return s.unionByName(f).distinct().select("*", row_rank(["term"], [F.col("kind").desc(), F.col("id")], "place")).where(F.col("place") <= most)


def file_imports(records: DataFrame) -> DataFrame:
    """(file_id, module): modules that each file imports, from parsed fragments."""
    return records.where(F.col("record") == "import").select("file_id", F.col("target").alias("module")).where(F.length("module") > 0).distinct()


def file_importers(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """(file_id, importer_id): files that import a module which the file defines (module, file_id)."""
    return modules.select("module", "file_id").join(imports.select("module", F.col("file_id").alias("importer_id")), "module").where(F.col("file_id") != F.col("importer_id")).select("file_id", "importer_id").distinct()


def select_repositories(anchors: DataFrame, symbols: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """(task_id, repo_id): repositories of a task's anchors, and those whose name contains a component (task_id, component) of it."""
    parts = [anchors.join(symbols.select("symbol_id", "repo_id"), "symbol_id").select("task_id", "repo_id")]
    if components is not None:
        words = symbols.select("repo_id").distinct().select("repo_id", F.explode(T.split_identifier(F.col("repo_id"))).alias("component"))
        parts.append(components.select("task_id", F.lower("component").alias("component")).join(words, "component").select("task_id", "repo_id"))
    return reduce(DataFrame.unionByName, parts).where(F.col("repo_id").isNotNull()).distinct()


def model_of(embeddings: DataFrame) -> DataFrame:
    """(kind, model, dim, n): the model and size of stored vectors by kind; more than one row of a kind means mixed models."""
    return embeddings.groupBy("kind", "model", F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
