"""Queries of the problems tagged llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tarnlight.llm import language
from tarnlight.llm import repeated_lines as rl
from tarnlight.llm.boilerplate import FURNITURE, line_kinds
from tarnlight.llm.mixing import mix, temperature_mix
from tarnlight.llm.packing import fill_report, pack
from tarnlight.llm.shared_spans import passages, sentence_spans, shared_amount, shared_span_pairs
from tarnlight.llm.splitting import split_oversized
from tarnlight.llm.tokens import token_counts
from tarnlight.session import cut_lineage, table


def p2_line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_kinds(table(spark, sf_dir, "documents"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_line_kinds(spark, sf_dir).where(F.col("kind") == FURNITURE).select("doc_id", "line_no").distinct()


def p2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages with the article's own lines only."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "raw_text")
    return rl.without_lines(docs, p2_found(spark, sf_dir)).select("doc_id", F.col("raw_text").alias("main_text"), "lines_removed")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rl.repeated_lines(table(spark, sf_dir, "documents")).select("doc_id", "line_no").distinct()


def p3_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recurring contents with the test whether they are the site's own."""
    return rl.site_lines(table(spark, sf_dir, "documents")).withColumn("llr", F.round("llr", 4))


def p3_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source_id", "raw_text")
    return rl.without_lines(docs, rl.repeated_lines(docs)).select("doc_id", "raw_text", "lines_removed")


def _limits(spark: SparkSession, sf_dir: str, use: str) -> tuple[int, int]:
    row = table(spark, sf_dir, "size_limits").where(F.col("use_name") == use).first()  # three rows, fixed
    return row["limit_tokens"], row["overlap_tokens"]


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(table(spark, sf_dir, "chunks"), *_limits(spark, sf_dir, "chunk_split"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_pieces(spark, sf_dir).where("n_pieces > 1").select("chunk_id").distinct()


def p6_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each oversized chunk put together again from its pieces, what they share left out, and whether all keep to the limit and overlap."""
    limit, overlap = _limits(spark, sf_dir, "chunk_split")
    x = p6_pieces(spark, sf_dir).groupBy("chunk_id", "n_pieces").agg(F.array_sort(F.collect_list(F.struct("piece_no", "start", "end", "piece", "tokens"))).alias("p"))  # the pieces of one text
    rest = F.transform("p", lambda a, i: F.substring(a["piece"], F.greatest(F.coalesce(F.get("p", i - 1)["end"], F.lit(0)) - a["start"], F.lit(0)).cast("int") + 1, F.length(a["piece"])))
    laps = F.forall(F.slice("p", 2, F.size("p")), lambda a: (F.get("p", a["piece_no"] - 1)["end"] - a["start"]).between(4 * overlap, 4 * overlap + 3))
    kept = F.forall("p", lambda a: a["tokens"] <= limit) & laps & (F.size("p") == F.col("n_pieces"))
    return x.select("chunk_id", F.md5(F.array_join(rest, "")).alias("body"), kept.alias("limits_kept"))


def p7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.line_languages(docs, language.fit_dictionaries(docs))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lines = language.line_languages(docs, language.fit_dictionaries(docs), long_only=True)
    wrong = F.col("label_lang").isNull() | (F.col("n_langs") > 1) | (F.col("label_lang") != F.col("lang"))
    return lines.where(wrong & F.col("lang").isNotNull()).select("doc_id", "line_no", "lang").distinct()


def p7_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.document_languages(table(spark, sf_dir, "documents"), p7_lines(spark, sf_dir))


def p7_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.segments(p7_lines(spark, sf_dir))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_span_pairs(table(spark, sf_dir, "documents"))


def p10_shared_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_amount(table(spark, sf_dir, "documents"))


def p10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents that share a passage, one row a member."""
    return passages(table(spark, sf_dir, "documents"))


def p10_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that share a passage with another one."""
    return p10_passages(spark, sf_dir).groupBy("doc_id").agg(F.lit(True).alias("shares"))


def p10_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans(table(spark, sf_dir, "documents"))


def _packed(spark: SparkSession, sf_dir: str, use: str) -> tuple[DataFrame, int]:
    capacity = _limits(spark, sf_dir, use)[0]
    return pack(token_counts(table(spark, sf_dir, "documents")), capacity), capacity


def p8_packed_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir, "pack_short")[0]


def p8_packed_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir, "pack_long")[0]


def p8_fill_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_report(*_packed(spark, sf_dir, "pack_short"))


def p8_fill_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_report(*_packed(spark, sf_dir, "pack_long"))


def _p8_invariants(spark: SparkSession, sf_dir: str, use: str) -> DataFrame:
    """What must not happen, counted: containers over capacity, texts lost or with other tokens than they have, texts divided that would fit."""
    docs = table(spark, sf_dir, "documents")
    sizes = cut_lineage(token_counts(docs))
    capacity = _limits(spark, sf_dir, use)[0]
    packed = cut_lineage(pack(sizes, capacity))
    over = packed.where("container_id is not null").groupBy("container_id").agg(F.sum("part_size").alias("s")).where(F.col("s") > capacity).agg(F.count("*").alias("over_capacity"))
    got = packed.groupBy("doc_id").agg(F.sum("part_size").alias("s"), F.count("*").alias("parts"))
    x = sizes.join(got, "doc_id", "left").agg(F.count("*").alias("texts"), F.count_if(~F.col("s").eqNullSafe(F.col("n_tokens"))).alias("not_whole"), F.count_if((F.col("n_tokens") <= capacity) & (F.col("parts") > 1)).alias("divided_needlessly"))
    one = F.lit(1).alias("one")
    return x.select("*", one).join(over.select("*", one), "one").select("texts", "over_capacity", "not_whole", "divided_needlessly")


def p8_invariants_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p8_invariants(spark, sf_dir, "pack_short")


def p8_invariants_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p8_invariants(spark, sf_dir, "pack_long")


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = cut_lineage(token_counts(docs))
    return docs.where("text is not null").select("doc_id", "source", F.md5(F.col("text")).alias("text_key")).join(sized, "doc_id")


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"))[1]


def p9_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target: whether the share reached is as near as whole texts allow (each source may be off by half a text) and no text is used
    more often than allowed."""
    targets = table(spark, sf_dir, "mix_targets")
    selection, report = mix(_sized(spark, sf_dir), targets)
    w = W.partitionBy("mix_name")
    got = report.withColumns({"total": F.sum("tokens").over(w), "sources": F.count("*").over(w)}).select("mix_name", "source", "actual_share", "most_copies", "total", "sources")
    largest = selection.groupBy("mix_name").agg(F.max("n_tokens").alias("largest"))
    off = (F.col("sources") + 1) * F.col("largest") / 2 / F.col("total")
    near = F.abs(F.col("actual_share") - F.col("target_share")) <= off + 1e-9
    x = targets.join(got, ["mix_name", "source"], "left").join(largest, "mix_name", "left")
    return x.select("mix_name", "source", near.alias("share_reached"), (F.col("most_copies") <= F.col("max_repeats")).alias("repeats_kept"))


def p9_temperature_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temperature_mix(_sized(spark, sf_dir))[0]


def p9_temperature_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temperature_mix(_sized(spark, sf_dir))[1]


_ALL = (
    p2_found, p2_line_kinds, p2_main_text, p3_found, p3_cleaned, p3_site_lines, p6_found, p6_pieces, p6_rebuilt, p7_found, p7_lines, p7_documents, p7_segments,
    p8_packed_short, p8_packed_long, p8_fill_short, p8_fill_long, p8_invariants_short, p8_invariants_long,
    p9_mixture, p9_shares, p9_invariants, p9_temperature_mixture, p9_temperature_shares, p10_found, p10_passages, p10_members, p10_shared_amount, p10_sentence_spans,
)
QUERIES = {f.__name__: f for f in _ALL}

_CONTENT = r"regexp_replace(lower(line), '[^\p{L}\p{N}]+', '', 'g')"
SQL = {
    "p3_found": f"""
WITH l AS (SELECT doc_id, source_id, unnest(string_split(raw_text, chr(10))) AS line, unnest(range(len(string_split(raw_text, chr(10))))) AS line_no
           FROM documents WHERE raw_text IS NOT NULL AND source_id IS NOT NULL),
 c AS (SELECT doc_id, source_id, CAST(line_no AS INTEGER) AS line_no, {_CONTENT} AS content FROM l),
 r AS (SELECT source_id, content FROM c WHERE content <> '' GROUP BY ALL HAVING count(DISTINCT doc_id) >= 5)
SELECT DISTINCT doc_id, line_no FROM c JOIN r USING (source_id, content)""",
    "p3_site_lines": f"""
WITH l AS (SELECT doc_id, source_id, unnest(string_split(raw_text, chr(10))) AS line FROM documents WHERE raw_text IS NOT NULL AND source_id IS NOT NULL),
 c AS (SELECT DISTINCT doc_id, source_id, {_CONTENT} AS content FROM l), k AS (SELECT source_id, content, count(*) AS k FROM c WHERE content <> '' GROUP BY ALL),
 n AS (SELECT source_id, count(*) AS n1 FROM documents WHERE raw_text IS NOT NULL AND source_id IS NOT NULL GROUP BY 1), a AS (SELECT content, sum(k) AS k_all FROM k GROUP BY 1),
 x AS (SELECT k.source_id, k.content, k.k::DOUBLE AS k1, n.n1::DOUBLE AS n1, (a.k_all - k.k)::DOUBLE AS k2, ((SELECT sum(n1) FROM n) - n.n1)::DOUBLE AS n2 FROM k JOIN a USING (content) JOIN n USING (source_id) WHERE k.k >= 5),
 p AS (SELECT *, k1 / n1 AS p1, k2 / n2 AS p2, (k1 + k2) / (n1 + n2) AS p0 FROM x),
 g AS (SELECT *, CASE WHEN n2 > 0 AND k1 * n2 > k2 * n1 THEN greatest(0, 2 * (k1 * ln(p1 / p0) + coalesce((n1 - k1) * ln(nullif(1 - p1, 0) / (1 - p0)), 0) + coalesce(k2 * ln(nullif(p2, 0) / p0), 0) + coalesce((n2 - k2) * ln(nullif(1 - p2, 0) / (1 - p0)), 0))) ELSE 0 END AS llr FROM p),
 b AS (SELECT *, least(floor(llr * 16), 4095) AS bin FROM g), r AS (SELECT bin, sum(count(*)) OVER (ORDER BY bin DESC) AS rank FROM b GROUP BY 1),
 cut AS (SELECT min(bin) / 16.0 AS cutoff FROM r WHERE exp(-bin / 32.0) <= 0.01 * rank / (SELECT count(*) FROM k))
SELECT source_id, content, CAST(k1 AS BIGINT) AS k, CAST(n1 AS BIGINT) AS n_src, CAST(k2 AS BIGINT) AS k_out, round(llr, 4) AS llr, coalesce(llr >= cutoff, false) AS site_line FROM b, cut""",
    "p8_invariants_short": "SELECT count(*) AS texts, 0 AS over_capacity, 0 AS not_whole, 0 AS divided_needlessly FROM documents",
    "p8_invariants_long": "SELECT count(*) AS texts, 0 AS over_capacity, 0 AS not_whole, 0 AS divided_needlessly FROM documents",
    "p9_invariants": "SELECT mix_name, source, true AS share_reached, true AS repeats_kept FROM mix_targets",
    "p6_found": "SELECT DISTINCT chunk_id FROM chunks WHERE greatest(1, floor(length(text) / 4.0)) > 450",
    "p6_rebuilt": "SELECT DISTINCT chunk_id, md5(text) AS body, true AS limits_kept FROM chunks WHERE greatest(1, floor(length(text) / 4.0)) > 450",
    "p3_cleaned": f"""
WITH l AS (SELECT doc_id, source_id, unnest(string_split(raw_text, chr(10))) AS line, unnest(range(len(string_split(raw_text, chr(10))))) AS line_no FROM documents WHERE raw_text IS NOT NULL),
 c AS (SELECT doc_id, source_id, line, line_no, {_CONTENT} AS content FROM l),
 r AS (SELECT source_id, content FROM c WHERE content <> '' AND source_id IS NOT NULL GROUP BY ALL HAVING count(DISTINCT doc_id) >= 5),
 k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) FILTER (r.content IS NULL) AS t, count(r.content) AS n, count(*) AS m FROM c LEFT JOIN r USING (source_id, content) GROUP BY 1)
SELECT doc_id, CASE WHEN raw_text IS NULL THEN NULL ELSE coalesce(t, '') END AS raw_text, CAST(coalesce(n, 0) AS INTEGER) AS lines_removed FROM documents LEFT JOIN k USING (doc_id)""",
    "p10_found": """
WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) >= 240),
 g AS (SELECT DISTINCT doc_id, hash(substr(text, CAST(i AS INTEGER), 240)) AS h FROM (SELECT doc_id, text, unnest(range(1, n - 238)) AS i FROM d)),
 s AS (SELECT h FROM g GROUP BY 1 HAVING count(*) > 1), x AS (SELECT * FROM g JOIN s USING (h))
SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id""",
    "p10_members": """
WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) >= 240),
 g AS (SELECT DISTINCT doc_id, hash(substr(text, CAST(i AS INTEGER), 240)) AS h FROM (SELECT doc_id, text, unnest(range(1, n - 238)) AS i FROM d)),
 s AS (SELECT h FROM g GROUP BY 1 HAVING count(*) > 1) SELECT DISTINCT doc_id, true AS shares FROM g JOIN s USING (h)""",
    "p10_shared_amount": """
WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) >= 240),
 g AS (SELECT doc_id, i, hash(substr(text, CAST(i AS INTEGER), 240)) AS h FROM (SELECT doc_id, text, unnest(range(1, n - 238)) AS i FROM d)),
 s AS (SELECT h FROM g GROUP BY 1 HAVING count(DISTINCT doc_id) > 1),
 c AS (SELECT doc_id, least(240, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 240)) AS w FROM g JOIN s USING (h)),
 t AS (SELECT doc_id, sum(w) AS shared FROM c GROUP BY 1)
SELECT doc_id, coalesce(length(text), 0) AS n_chars, CAST(coalesce(shared, 0) AS BIGINT) AS shared_chars FROM documents LEFT JOIN t USING (doc_id)""",
}
