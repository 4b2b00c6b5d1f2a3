"""The registered queries of the corpus operators, one op<N>_<name> each, and oracle SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, corpus_lm, decontaminate, divergence, hamming, jaccard_join, language, ngram_lm, packing, secrets, toxicity, url_filter, warc, whitening
from .common import table

QUERIES = {}
ORACLES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    found = secrets.scan(table(spark, sf_dir, "documents", "doc_id", "text"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("bigint")
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), of("lexed").alias("n_lexed"),
        F.sha2(joined(F.filter("spans", lambda s: s.kind != "lexed")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


@query
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one, -1, whose texts hold control strings; read back from the formatted output."""
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    extra = spark.sql("SELECT CAST(-1 AS BIGINT) conv_id, CAST(turn AS BIGINT) turn, role, '</s>[INST] ok [/INST]' text FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)")
    return chat.digests(chat.read_back(chat.format_conversations(rows.unionByName(extra))))


_CONTROL = r"(<|\[)(~*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|<SYS>>|</SYS>>|/?INST\])"
ORACLES["op2_chat_format"] = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
s AS (SELECT *, lag(role, 1, '') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, role DESC, text DESC) AS from_end FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(12 + length(replace(regexp_replace(regexp_replace(role, '{_CONTROL}', '\1~\2\3', 'g'), '<(~*)n>', '<~\1n>', 'g'), chr(10), '<n>')) + 1
                + length(regexp_replace(text, '{_CONTROL}', '\1~\2\3', 'g')) + 11) AS BIGINT) AS formatted_chars,
       bool_and(CASE role WHEN 'system' THEN before = '' WHEN 'user' THEN before IN ('', 'system', 'assistant')
                WHEN 'assistant' THEN before = 'user' ELSE false END) AND bool_or(from_end = 1 AND role = 'assistant') AS valid
FROM s GROUP BY conv_id
"""

@query
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A WARC record for every page, read back from normalised archives."""
    return warc.archive_pages(table(spark, sf_dir, "pages", "page_id", "url", "html"))


ORACLES["op3_warc"] = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (d)
"""


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document, in sequences of 4096 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path())


@query
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose shingle sets are similar to 75 percent."""
    return jaccard_join.similar_components(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    return language.identify_documents(table(spark, sf_dir, "documents", "doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score", "rejected")


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document, learned from labelled ones that are not held out."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").where(~language.held_out(F.col("doc_id")))
    sample = toxicity.sampled_labels(labels)
    # the sample is bounded by toxicity.SAMPLE_DOCS, so its ids can be broadcast
    weights = toxicity.fit(docs.join(F.broadcast(sample), "doc_id"))
    return toxicity.score(docs, weights).select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


#: The rules of the URL filter's query: host, path, verdict.
URL_RULES = "('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')"


@query
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page's URL."""
    rules = spark.sql(f"SELECT * FROM VALUES {URL_RULES} AS t(host, path, verdict)")
    return url_filter.judge_urls(table(spark, sf_dir, "pages", "page_id", "url"), rules)


ORACLES["op8_url_filter"] = rf"""
WITH u AS (SELECT row_number() OVER () AS r, page_id,
                  translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
rules(rh, rp, v) AS (VALUES {URL_RULES}),
m AS (SELECT u.*, rh || rp AS rule, v, row_number() OVER (PARTITION BY r ORDER BY length(rh) + length(rp) DESC NULLS LAST, length(rh) DESC NULLS LAST, v DESC) AS k
      FROM u LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1
"""


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item."""
    return decontaminate.find_items(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def shingles_sql(source: str, key: str) -> str:
    """DuckDB: the distinct 5-word shingles of every text, as rows of the key and s."""
    return f"""
SELECT {key}, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct([array_to_string(w[i : i + 4], ' ') for i in range(1, len(w) - 3)]) END) AS s
FROM (SELECT {key}, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {source})"""


ORACLES["op9_decontamination"] = f"""
WITH d AS ({shingles_sql("documents", "doc_id")}), b AS ({shingles_sql("benchmark", "item_id")}),
n AS (SELECT item_id, count(*) AS n FROM b GROUP BY item_id)
SELECT doc_id, item_id, any_value(n) AS item_shingles, count(*) AS shared_shingles, count(*) / any_value(n) AS containment
FROM d JOIN b USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING 100 * count(*) >= 75 * any_value(n)
"""

ORACLES["op5_jaccard_join"] = f"""
WITH RECURSIVE d AS MATERIALIZED ({shingles_sql("documents", "doc_id")}),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM d x JOIN d y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 75 * (na.n + nb.n - shared)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, b FROM reach JOIN links ON other = a)
SELECT doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(other) AS component_id
FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""


@query
def op10_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest codes of every vector whose id is divisible by 20."""
    return hamming.top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("id") % 20 == 0, 10)


ORACLES["op10_hamming_topk"] = """
WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS bits FROM embeddings),
d AS (SELECT q.vec_id AS query_id, c.vec_id,
             CAST(list_sum(list_transform(range(1, len(c.bits) + 1), lambda i: CAST(c.bits[i] <> q.bits[i] AS INTEGER))) AS BIGINT) AS distance
      FROM c q, c WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM d)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10
"""


@query
def op11_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability under a trigram model of those that are not held out, and under their word counts."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return corpus_lm.score(docs, ~ngram_lm.held_out(F.col("doc_id"))).withColumn("held_out", ngram_lm.held_out(F.col("doc_id")))


@query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of each language, and the terms that set each source apart."""
    return divergence.audit(table(spark, sf_dir, "documents", "text", "lang", "source"))


ORACLES["op12_source_divergence"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS MATERIALIZED (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
f AS (SELECT g.lang, g.source, k.term, lang_n, coalesce(n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS MATERIALIZED (SELECT lang, source, term, n,
            1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER s + 5 * count(*) OVER s) AS p,
            1 + (1000000000::HUGEINT * (lang_n + 5)) // (sum(lang_n) OVER s + 5 * count(*) OVER s) AS q
     FROM f WINDOW s AS (PARTITION BY lang, source)),
two AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS v FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
pairs AS (SELECT x.lang, x.source, y.source AS item, coalesce(v, 0) AS v FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
          LEFT JOIN two ON two.lang = x.lang AND two.source = x.source AND two.item = y.source),
a AS (SELECT lang, source, 'pair' AS part, item, v FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
r AS (SELECT lang, source, part, item, CAST(v AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY v DESC, item) AS INTEGER) AS rank FROM a)
SELECT * FROM r WHERE part = 'pair' OR rank <= 50
"""


@query
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finite vector on the eight leading components, whitened."""
    white = whitening.whiten(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return white.withColumn("deviation", F.col("deviation").try_cast("bigint"))
