"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import (collocations, decontaminate, hardnegatives, linededup, mixing, pieces, quality, simhash,
                            substringdedup, tokencounts, toxicity, urlrules, vectorgraph)
from ledgerlens.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 40 or more code points in 5 or more documents stay in the largest doc_id only."""
    out = linededup.drop_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLES["op5_line_dedup"] = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n
  FROM documents
), k AS (
  SELECT doc_id, n, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), r AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), j AS (
  SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.keeper AS dropped FROM k LEFT JOIN r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN dropped THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""


@query
def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 150 % of their words, at most twice each, along the weight schedules."""
    out = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "position")


ORACLES["op8_source_mix"] = r"""
WITH d AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS n FROM d GROUP BY source
), w AS (
  SELECT source, source_size, CASE n WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
         CASE n WHEN 0 THEN -0.5 WHEN 1 THEN 0.0 ELSE 0.5 END::DOUBLE AS slope, 2 * source_size AS cap FROM s
), f AS (
  SELECT *, sum(source_size) OVER () * 150
            - 100 * coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
                                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST
                           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS over_,
         row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS nth FROM w
), lv AS (
  SELECT rest, over_ FROM f WHERE CAST(rest AS DOUBLE) * weight <= cap * 100.0::DOUBLE * over_ ORDER BY nth LIMIT 1
), t AS (
  SELECT f.source, f.source_size, f.slope,
         least(CAST(lv.rest AS DOUBLE) * f.weight / (100.0::DOUBLE * CAST(lv.over_ AS DOUBLE)), CAST(f.cap AS DOUBLE)) AS target
  FROM f, lv
), c AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.slope, CAST(round(t.target) AS BIGINT) AS wanted,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN wanted // source_size ELSE 0 END AS rounds FROM c
), q AS (
  SELECT *, rounds * size + greatest(0, least(size, wanted - rounds * source_size - start)) AS taken,
         CASE WHEN target > 0 THEN least(1.0::DOUBLE, CAST(start AS DOUBLE) / target) ELSE 0.0::DOUBLE END AS u FROM p
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(taken AS BIGINT) AS taken,
       CASE WHEN taken > 0 THEN round(CASE WHEN slope = 0 THEN u ELSE
         (sqrt((1.0::DOUBLE - slope) * (1.0::DOUBLE - slope) + 4.0::DOUBLE * slope * u) - (1.0::DOUBLE - slope))
         / (2.0::DOUBLE * slope) + 0.0::DOUBLE END, 9) END AS position
FROM q
"""


@query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in windows of 50 that also start in a smaller doc_id are removed."""
    out = substringdedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLES["op4_substring_dedup"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), w AS (
  SELECT doc_id, s, md5(array_to_string(words[s:s + 49], ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS s FROM d WHERE len(words) >= 50)
), f AS (
  SELECT h, min(doc_id) AS first FROM w GROUP BY h
), g AS (
  SELECT DISTINCT w.doc_id, unnest(range(w.s, w.s + 50)) AS n FROM w JOIN f ON w.h = f.h WHERE f.first < w.doc_id
), p AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS n FROM d
), k AS (
  SELECT p.doc_id, count(*) AS n_words, count(g.n) AS n_removed,
         string_agg(p.word, ' ' ORDER BY p.n) FILTER (WHERE g.n IS NULL) AS kept
  FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.n = g.n GROUP BY p.doc_id
)
SELECT d.doc_id, CAST(coalesce(k.n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""


@query
def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles linked at three or fewer differing bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, bits=3)


@query
def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold 0.8 or more of a benchmark item's five-word shingles, with the item."""
    return decontaminate.contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op6_benchmark_decontamination"] = r"""
WITH i AS (
  SELECT DISTINCT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x20\x09-\x0D]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents WHERE text IS NOT NULL
), x AS (
  SELECT item_id, w, least(5, len(w)) AS k, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS s FROM i WHERE len(w) > 0
), a AS (
  SELECT DISTINCT item_id, w AS item, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM x
), y AS (
  SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM a) WHERE len(w) >= k
), b AS (
  SELECT DISTINCT doc_id, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM y
), n AS (
  SELECT item_id, item, count(*) AS n_shingles FROM a GROUP BY item_id, item
), m AS (
  SELECT b.doc_id, a.item_id, a.item, count(*) AS n_shared FROM a JOIN b ON a.k = b.k AND a.g = b.g
  GROUP BY b.doc_id, a.item_id, a.item
)
SELECT m.doc_id, m.item_id, CAST(n.n_shingles AS INTEGER) AS n_shingles, CAST(m.n_shared AS INTEGER) AS n_shared,
       CAST(m.n_shared AS DOUBLE) / n.n_shingles AS containment
FROM m JOIN n ON m.item_id = n.item_id AND m.item = n.item
WHERE m.n_shared >= 0.8 * n.n_shingles
"""


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document from a random field fitted on the labelled rows not held out."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_on(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))


@query
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url under the fixed rules, else under rules mined from the labels.

    The label of a url is that of the document with the page's id: block for
    quality 0 or toxic 1, else allow."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    labels = (table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("page_id"))
              .agg(F.max(F.when(bad, "block").otherwise("allow")).alias("label")))
    rules = urlrules.mine_rules(pages.join(labels, "page_id").select("url", "label"))
    return urlrules.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


@query
def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings linked at a cosine of 0.9 or more, with their components."""
    return vectorgraph.near_duplicates(table(spark, sf_dir, "embeddings"))


RANK_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def revision(text):
    """A deterministic revision of a text: a replacement at a third, an insertion at two
    thirds, and the first forty characters deleted."""
    n = F.char_length(text)
    third = F.floor(n / 3).cast("int")
    edit = lambda start, length, insert: F.struct(start.alias("start"), F.lit(length).alias("length"),
                                                  insert.alias("insert"))
    return F.array(edit(third, 24, F.concat(F.lit(" revised"), F.substring(text, 1, 12))),
                   edit(F.floor(n * 2 / 3).cast("int"), 0, F.lit(" and it's added, in 2 places;\n")),
                   edit(F.lit(0), 40, F.lit("")))


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document before and after three edits, and the characters encoded for the edits."""
    docs = table(spark, sf_dir, "documents")
    trees = tokencounts.build_trees(docs, RANK_FILE).withColumn("edits", revision(F.col("text")))
    out = tokencounts.apply_edits(trees, RANK_FILE)
    return out.select("doc_id", "n_tokens_before", "n_tokens", F.char_length("text").cast("long").alias("n_chars"),
                      "n_encoded")


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by a scorer trained on the posterior labels of heuristic labellers."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.score(docs, quality.fit(docs))
    return out.select("doc_id", F.concat_ws(",", F.col("votes").cast("array<string>")).alias("votes"), "posterior", "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


PIECE_MODEL = "piece_bpe_32k.model"


@query
def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with an end id and decoded again; ``end_byte`` is the source byte where its last piece ends."""
    import public_tokenizers
    path = public_tokenizers.path(PIECE_MODEL)
    encoded = pieces.encode(table(spark, sf_dir, "documents"), path)
    digests = encoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"),
                             F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                             F.element_at("ends", -1).cast("long").alias("end_byte"))
    return pieces.decode(digests, path).select("doc_id", "n_tokens", "ids_sha256",
                                               F.sha2("decoded", 256).alias("decoded_sha256"), "end_byte")


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each anchor (an id divisible by 50) and each of its 5 best rows of its label, 3 rows of other labels at 50 to 95 % of its score."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding")
    return hardnegatives.mine(vectors, F.col("id") % 50 == 0)


ORACLES["op13_hard_negatives"] = r"""
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id AS id,
         CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM r AS a JOIN r ON len(a.v) = len(r.v) AND a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
       s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
 AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 phrases of 2 to 4 words that hold together best, by language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


ORACLES["op12_collocations"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), p AS (
  SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p
), g AS (
  SELECT lang, k, list_slice(words, s, s + k - 1) AS g
  FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS s FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(words) >= k)
), f AS (
  SELECT lang, k, array_to_string(g, ' ') AS phrase, count(*) AS f FROM g GROUP BY lang, k, phrase
), n AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS words FROM f WHERE k > 1 AND f >= 30
), x AS (
  SELECT c.*, cut, array_to_string(words[1:cut], ' ') AS head, array_to_string(words[cut + 1:], ' ') AS rest
  FROM c, (SELECT unnest([1, 2, 3]) AS cut) WHERE cut < k
), y AS (
  SELECT x.lang, x.k, x.phrase, x.a, h.f AS l, r.f AS r, cut,
         CAST((CAST(2000000 AS HUGEINT) * x.a) // (CAST(h.f AS HUGEINT) + r.f) AS BIGINT) AS score
  FROM x JOIN f AS h ON h.lang = x.lang AND h.k = x.cut AND h.phrase = x.head
         JOIN f AS r ON r.lang = x.lang AND r.k = x.k - x.cut AND r.phrase = x.rest
), z AS (
  SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), i AS (
  SELECT c.lang, array_to_string(c.words[s:s + m - 1], ' ') AS phrase, max(c.a) AS longer
  FROM c, (SELECT unnest([2, 3]) AS m), (SELECT unnest([1, 2, 3]) AS s) WHERE m < c.k AND s + m - 1 <= c.k GROUP BY ALL
)
SELECT z.lang, CAST(row_number() OVER (PARTITION BY z.lang ORDER BY score DESC, a DESC, z.phrase) AS INTEGER) AS rank,
       z.phrase, a, l, r, n.n, score
FROM z JOIN n ON n.lang = z.lang LEFT JOIN i ON i.lang = z.lang AND i.phrase = z.phrase
WHERE i.longer IS NULL OR 100 * CAST(i.longer AS HUGEINT) < 80 * CAST(z.a AS HUGEINT)
QUALIFY rank <= 2000
"""
