"""Full-text, body, path and hybrid search over symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom import schema as S
from graphloom.functions import text as T
from graphloom.operators.heavy_keys import salted_join
from graphloom.session import checkpointed
from graphloom.tables import row_rank

#: Weight of a posting by the part of the symbol it stands in.
PART_WEIGHT = {"a": 1.0, "b": 0.4, "c": 0.2, "d": 0.1}


def postings(symbols: DataFrame) -> DataFrame:
    """(token, part, symbol_id, tf, doc_len): the words of each symbol by part.

    a: the name; b: its parts; c: container and path; d: signature, documentation and body. Null parts have no words.
    """
    words = lambda c: F.regexp_extract_all(T.lower(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    stem = F.regexp_replace(F.regexp_replace(F.col("file_id"), r"^[^:]*:", ""), r"\.[^./]*$", "")
    by = {
        "a": F.array(T.lower(F.col("name"))), "b": T.split_identifier(F.col("name")), "c": F.concat(T.split_identifier(F.coalesce("namespace", F.lit(""))), T.split_identifier(F.coalesce(stem, F.lit("")))),
        "d": F.flatten(F.array(*[F.concat(words(F.col(c))) for c in ("signature", "docstring", "body")])),
    }

    def marked(part: str, column):
        return F.transform(column, lambda t: F.struct(F.lit(part).alias("part"), t.alias("token")))

    all_words = F.concat(*[marked(p, w) for p, w in by.items()])
    rows = symbols.select("symbol_id", all_words.alias("words")).select("symbol_id", F.size("words").alias("doc_len"), F.explode("words").alias("w")).where(F.length("w.token") >= T.LEAST_TOKEN)
    return rows.groupBy(F.col("w.token").alias("token"), F.col("w.part").alias("part"), "symbol_id", "doc_len").agg(F.count(F.lit(1)).alias("tf"))


#: Lengths of the prefixes that join terms with words: a term uses the longest that it has.
PREFIXES = (3, 6, 10)


def prefix_matches(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, token): dictionary words that begin with each term, by equi-join on the longest prefix of fixed length."""
    keys = F.array(*[F.when(F.length("token") >= n, F.substring("token", 1, n)) for n in PREFIXES])
    dictionary = index.select("token").distinct().select("token", F.explode(F.array_compact(keys)).alias("prefix"))
    longest = F.coalesce(*[F.when(F.length("term") >= n, F.substring("term", 1, n)) for n in reversed(PREFIXES)])
    wanted = terms.where(F.length("term") >= T.LEAST_TOKEN).select("term").distinct().withColumn("prefix", longest)
    return wanted.join(dictionary, "prefix").where(F.col("token").startswith(F.col("term"))).select("term", "token")


def term_hits(index: DataFrame, terms: DataFrame, limit: int | None = S.LEXICAL_POOL) -> DataFrame:
    """(term, symbol_id, score, tier, rank): symbols with a word that begins with the term, the best ``limit`` of each term.

    Score: the sum of part weights of matching words over 1 + ln(length); tier: the best part that matched. Order:
    score downwards, symbol_id.
    """
    weight = F.create_map(*[F.lit(x) for kv in PART_WEIGHT.items() for x in kv])
    found = salted_join(index, prefix_matches(index, terms), "token", ["symbol_id"])
    per = found.groupBy("term", "symbol_id").agg(F.round(F.sum(weight[F.col("part")]) / (1 + F.log(F.max("doc_len"))), 6).alias("score"), F.min("part").alias("tier"))
    ranked = per.select("*", row_rank(["term"], [F.col("score").desc(), F.col("symbol_id")]))
    return ranked.where(F.col("rank") <= limit) if limit else ranked


# What may follow a Turkish stem for the word to be a form of it.
SUFFIX_CHAIN = r"^(?:l[ae]r|[ıiuü]|s[ıiuü]|n[ıiuü]|[dt][ae]n?|[ae]|[ıiuü]n|m[ıiuü]z|n[ıiuü]z|l[ıiuü]k|c[ıiuü]|l[ıiuü]|s[ıiuü]z|m[ae]k?|m[ıiuü]|[ıiuü]?yor|[dt][ıiuü]|m[ıiuü]ş|[ae]c[ae]k|[ıiuü]l|[ıiuü]nc[ae]|ken|[ny])+$"


def with_equivalents(task_terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(task_id, term): the terms of tasks and what words of another language among them are called in code.

    ``vocabulary``: (stem, word). A term is a form of the longest stem of four letters or more that it begins with, if the rest is
    a chain of suffixes; shorter stems match whole words only. Found by joining a term's beginnings, not by trying every stem.
    """
    begins = F.explode(F.array_distinct(F.concat(F.array("term"), F.transform(F.sequence(F.lit(4), F.greatest(F.length("term"), F.lit(4))), lambda n: F.substring("term", 1, n)))))
    terms = task_terms.select("term").distinct()
    hit = terms.select("term", begins.alias("stem")).join(vocabulary, "stem")
    rest = F.expr("substring(term, length(stem) + 1)")
    fits = hit.where((F.col("term") == F.col("stem")) | rest.rlike(SUFFIX_CHAIN))
    best = fits.groupBy("term").agg(F.max(F.length("stem")).alias("n"))
    known = fits.join(best, "term").where(F.length("stem") == F.col("n")).where(F.length("word") >= T.LEAST_TOKEN).select("term", "word").distinct()
    return task_terms.select("task_id", "term").unionByName(task_terms.join(known, "term").select("task_id", F.col("word").alias("term"))).distinct()


def phrase_hits(index: DataFrame, task_phrases: DataFrame, limit: int = S.LEXICAL_POOL) -> DataFrame:
    """(task_id, symbol_id, n): how many of a task's phrases (task_id, phrase: "left right") have both words in a symbol.

    A symbol holds a word if one of its words begins with it. A phrase of ``limit`` symbols or more names none. The word
    with fewer symbols is looked up first, so a common word costs one row a symbol and is never expanded by phrase.
    """
    words = F.split("phrase", " ")
    task_phrases = checkpointed(task_phrases.select("task_id", "phrase").distinct())  # read three times
    pairs = task_phrases.select("phrase").distinct().select(F.xxhash64("phrase").alias("p"), words[0].alias("a"), words[1].alias("b"))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("term")).distinct()
    holds = salted_join(index, prefix_matches(index, wanted), "token", ["symbol_id"]).select("term", "symbol_id").distinct()
    holds = checkpointed(holds.select(F.xxhash64("term").alias("t"), F.xxhash64("symbol_id").alias("s"), "symbol_id"))  # numbers travel in place of words
    size = holds.groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    pairs = pairs.select("p", F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"))
    sized = pairs.join(size.select(F.col("t").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("t").alias("b"), F.col("n").alias("nb")), "b")
    first = F.col("na") <= F.col("nb")
    driven = sized.select("p", F.when(first, F.col("a")).otherwise(F.col("b")).alias("t"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("o"))
    numbers = holds.select("t", "s")
    both = salted_join(driven, numbers, "t", ["p"]).select("p", F.col("o").alias("t"), "s").join(numbers.hint("shuffle_hash"), ["t", "s"], "left_semi").select("p", "s")  # the many rows are not sorted
    both = checkpointed(both)
    rare = both.groupBy("p").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < limit).select("p")
    hits = task_phrases.select("task_id", F.xxhash64("phrase").alias("p")).distinct().join(both.join(rare, "p"), "p").groupBy("task_id", "s").agg(F.count(F.lit(1)).alias("n"))
    return hits.join(holds.select("s", "symbol_id").distinct(), "s").select("task_id", "symbol_id", "n")


def lexical_anchors(hits: DataFrame, task_terms: DataFrame, phrases: DataFrame | None = None) -> DataFrame:
    """(task_id, symbol_id, strength): how much of a task's terms a symbol's words cover, best 15 of each task.

    ``task_terms``: (task_id, term); ``phrases``: the hits of ``phrase_hits``, each of which counts 1 beside the terms. A term whose pool is full counts 0.35; tasks of more than three terms gain threefold;
    at most the source's cap, at least 0.15.
    """
    full = hits.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    weighted = task_terms.distinct().join(full, "term", "left").withColumn("w", F.when(F.coalesce("n", F.lit(0)) >= S.LEXICAL_POOL, S.SATURATED_WEIGHT).otherwise(1.0))
    total = weighted.groupBy("task_id").agg(F.sum("w").alias("total"), F.count(F.lit(1)).alias("n_terms"))
    tier = F.create_map(*[F.lit(x) for kv in S.TIER.items() for x in kv])
    got = weighted.where("n > 0").select("task_id", "term", "w").join(hits.select("term", "symbol_id", "tier"), "term").groupBy("task_id", "symbol_id").agg(F.sum(F.col("w") * tier[F.col("tier")]).alias("got"))
    if phrases is not None:
        bonus = phrases.select("task_id", "symbol_id", (S.PHRASE_WEIGHT * F.col("n")).alias("got"))
        got = got.unionByName(bonus).groupBy("task_id", "symbol_id").agg(F.sum("got").alias("got"))
    gain = F.when(F.col("n_terms") <= 3, 1.0).otherwise(3.0)
    strength = F.round(F.least(F.col("got") / F.col("total") * gain, F.lit(S.SOURCE_CAP["lexical"])), 6)
    kept = got.join(total, "task_id").select("task_id", "symbol_id", strength.alias("strength")).where(F.col("strength") >= S.LEXICAL_LEAST)
    return kept.select("*", row_rank(["task_id"], [F.col("strength").desc(), F.col("symbol_id")])).where(F.col("rank") <= S.LEXICAL_LIMIT).drop("rank")


def body_words(symbols: DataFrame) -> DataFrame:
    """(symbol_id, word): whole words of each symbol's text."""
    words = F.array_distinct(F.regexp_extract_all(F.coalesce("search_text", F.lit("")), F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)))
    return symbols.select("symbol_id", F.explode(words).alias("word"))


def mentions_of_words(symbols: DataFrame, words: DataFrame, limit: int = 60) -> DataFrame:
    """(word, symbol_id, n): symbols outside tests whose text has the word as a whole; words in ``limit`` symbols or more say nothing.

    An inverted index in place of a pattern scan per word; counting comes before the join, so a common word costs one row.
    """
    found = checkpointed(body_words(symbols.where(~F.col("is_test"))).join(words.select("word").distinct(), "word", "left_semi"))  # read twice
    rare = found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < limit)
    return found.join(rare, "word").select("word", "symbol_id", "n")


def mentions_of_literals(symbols: DataFrame, literals: DataFrame, limit: int = 60) -> DataFrame:
    """(literal, symbol_id, n): symbols outside tests that quote the literal; frequent ones say nothing."""
    quoted = F.array_distinct(F.concat(F.regexp_extract_all(F.coalesce("search_text", F.lit("")), F.lit(r'"([^"\n]{3,80})"'), F.lit(1)), F.regexp_extract_all(F.coalesce("search_text", F.lit("")), F.lit(r"'([^'\n]{3,80})'"), F.lit(1))))
    found = checkpointed(symbols.where(~F.col("is_test")).select("symbol_id", F.explode(quoted).alias("literal")).join(literals.select("literal").distinct(), "literal", "left_semi"))  # read twice
    rare = found.groupBy("literal").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < limit)
    return found.join(rare, "literal").select("literal", "symbol_id", "n")


def files_by_suffix(files: DataFrame, suffixes: DataFrame, limit: int = 8) -> DataFrame:
    """(suffix, file_id, n): files whose path ends in whole parts with the suffix; a suffix of more than ``limit`` files names none."""
    path = F.regexp_replace(F.col("file_id"), r"^[^:]*:", "")
    tails = files.select("file_id", F.explode(T.path_tails(path)).alias("suffix"))
    hit = tails.join(suffixes.select(F.lower("suffix").alias("suffix")).distinct(), "suffix")
    few = hit.groupBy("suffix").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= limit)
    return hit.join(few, "suffix").select("suffix", "file_id", "n")


def missing_paths(files: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Suffixes that no file ends with."""
    path = F.regexp_replace(F.col("file_id"), r"^[^:]*:", "")
    tails = files.select(F.explode(T.path_tails(path)).alias("suffix")).distinct()
    return suffixes.select(F.lower("suffix").alias("suffix")).distinct().join(tails, "suffix", "left_anti")


def directory_neighbours(files: DataFrame, limit: int = 60) -> DataFrame:
    """(file_id, neighbour_id): the other files of the same folder, for folders of at most ``limit`` files."""
    x = files.select("file_id", T.directory(F.col("file_id")).alias("folder")).distinct()
    few = x.groupBy("folder").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= limit)
    kept = x.join(few, "folder").drop("n")
    return kept.join(kept.select("folder", F.col("file_id").alias("neighbour_id")), "folder").where(F.col("file_id") != F.col("neighbour_id")).select("file_id", "neighbour_id")


def basename_matches(files: DataFrame, patterns: DataFrame, limit: int = 8) -> DataFrame:
    """(pattern, file_id): files whose name matches a ``*`` pattern; a pattern of more than ``limit`` files names none.

    A pattern is looked up by the two or three letters that it begins with, else by up to four that it ends with, else by
    its only first letter; a lone star matches every file.
    """
    name = F.lower(F.element_at(F.split(F.col("file_id"), "[:/]"), -1))
    begins, ends = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda n: F.concat(F.lit("<"), F.substring(name, 1, n))), F.transform(F.sequence(F.lit(1), F.lit(4)), lambda n: F.concat(F.lit(">"), F.right(name, n)))
    keys = F.array_distinct(F.concat(begins, ends))
    f = files.select("file_id", name.alias("name"), F.explode(keys).alias("key"))
    p = F.lower("pattern")
    head = F.regexp_extract(p, r"^([^*]*)", 1)
    tail = F.regexp_extract(p, r"([^*]*)$", 1)
    key = F.when((F.length(head) >= 2) | (F.length(tail) == 0), F.concat(F.lit("<"), F.substring(head, 1, 3))).otherwise(F.concat(F.lit(">"), F.right(tail, F.least(F.length(tail), F.lit(4)))))
    rx = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(p, r"([.+?^$(){}|\[\]])", r"\\$1"), r"\*", ".*"), F.lit("$"))
    hit = f.join(patterns.select("pattern", key.alias("key"), rx.alias("rx")).distinct(), "key").where(F.rlike(F.col("name"), F.col("rx"))).select("pattern", "file_id").distinct()
    few = hit.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= limit)
    return hit.join(few, "pattern").select("pattern", "file_id")


def symbols_at(symbols: DataFrame, places: DataFrame) -> DataFrame:
    """(place_id, symbol_id, depth): symbols whose lines hold each place (place_id, file_id, line), innermost first."""
    span = F.col("end_line") - F.col("line")
    found = places.join(symbols.where(F.col("end_line").isNotNull()).select("file_id", "symbol_id", F.col("line").alias("s"), F.col("end_line").alias("e"), span.alias("span")), "file_id").where(F.col("line").between(F.col("s"), F.col("e")))
    return found.select("place_id", "symbol_id", row_rank(["place_id"], [F.col("span"), F.col("s"), F.col("symbol_id")], "depth"))


def hybrid(lexical: DataFrame, semantic: DataFrame, degree: DataFrame, limit: int = 10) -> DataFrame:
    """(query_id, symbol_id, score): lexical and semantic scores in one list, the best ``limit`` of each query.

    Inputs: (query_id, symbol_id, lexical, exact) and (query_id, symbol_id, semantic). Weights 0.55 and 0.45, the other one
    alone where a channel found nothing; 0.15 for the exact name and up to 0.001 for degree.
    """
    both = lexical.join(semantic, ["query_id", "symbol_id"], "full_outer").join(degree.select("symbol_id", "degree"), "symbol_id", "left")
    has = both.groupBy("query_id").agg(F.max(F.col("lexical").isNotNull()).alias("l"), F.max(F.col("semantic").isNotNull()).alias("s"))
    x = both.join(has, "query_id")
    wl = F.when(~F.col("s"), 1.0).otherwise(0.55) * F.col("l").cast("double")
    ws = F.when(~F.col("l"), 1.0).otherwise(0.45) * F.col("s").cast("double")
    score = wl * F.coalesce("lexical", F.lit(0.0)) + ws * F.greatest(F.coalesce("semantic", F.lit(0.0)), F.lit(0.0)) + F.when(F.col("exact"), 0.15).otherwise(0.0) + 0.001 * F.least(F.coalesce("degree", F.lit(0)) / 20, F.lit(1.0))
    out = x.select("query_id", "symbol_id", F.round(score, 6).alias("score"))
    return out.select("*", row_rank(["query_id"], [F.col("score").desc(), F.col("symbol_id")])).where(F.col("rank") <= limit)


