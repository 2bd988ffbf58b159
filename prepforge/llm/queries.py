"""The registered queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prepforge.llm import mixing
from prepforge.llm.alignment import align_tokens
from prepforge.llm.byte_cnn import fit_quality, score_quality
from prepforge.llm.chat import format_chats, read_back
from prepforge.llm.chunk_dedup import exact_duplicates
from prepforge.llm.collocations import collocations
from prepforge.llm.katz import katz_scores
from prepforge.llm.language_id import fit_languages, predict_language
from prepforge.llm.near_dedup import near_duplicates
from prepforge.llm.packing import pack, token_pieces
from prepforge.llm.quality_rules import apply_rules, learn_rules, text_statistics
from prepforge.llm.tables import Scratch, fold
from prepforge.llm.toxicity import fit_toxicity, score_toxicity
from prepforge.llm.url_filter import filter_urls, html_edges

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
             ("org", "/fr/", "allow")]
OP1 = r"""
WITH RECURSIVE rules(rule_host, rule_path, verdict) AS (VALUES
  ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
raw AS (
  SELECT page_id, url, html,
    CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (
  SELECT page_id, url, html,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*(\?[^#]*)?', 1) AS query
  FROM raw),
goals AS (
  SELECT url, host, host || path || query AS a,
    unnest([regexp_extract(list_filter(regexp_extract_all(html, '(?is)<link\b[^>]*>'),
              lambda t: regexp_matches(t, '(?is)\brel\s*=\s*["'']?\s*canonical\b'))[1],
              '(?is)\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1),
            regexp_extract(list_filter(regexp_extract_all(html, '(?is)<meta\b[^>]*>'),
              lambda t: regexp_matches(t, '(?is)\bhttp-equiv\s*=\s*["'']?\s*refresh\b'))[1],
              '(?is)\burl\s*=\s*["'']?\s*([^"''\s>;]+)', 1)]) AS goal
  FROM parsed WHERE contains(url, '://')),
absolute AS (
  SELECT a, CASE WHEN contains(goal, '://') THEN substr(goal, strpos(goal, '://') + 3)
    WHEN goal LIKE '//%' THEN substr(goal, 3) WHEN goal LIKE '/%' THEN host || goal END AS rest
  FROM goals WHERE goal <> ''),
links AS (
  SELECT a, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') || regexp_extract(rest, '^[^/?#]*([^?#]*)', 1)
    || regexp_extract(rest, '^[^?#]*(\?[^#]*)?', 1) AS b FROM absolute WHERE rest IS NOT NULL),
edges AS (SELECT a, b FROM links WHERE a <> b UNION SELECT b, a FROM links WHERE a <> b),
reach(node, other) AS (SELECT a, a FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON r.other = e.a),
nodes AS (
  SELECT DISTINCT other AS node, regexp_extract(other, '^([^/?#]*)', 1) AS host,
    regexp_extract(other, '^[^/?#]*([^?#]*)', 1) AS path FROM reach),
node_rules AS (
  SELECT node, arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM nodes JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY node),
inherited AS (
  SELECT r.node, count(*) AS aliases, CASE WHEN bool_or(coalesce(n.verdict, '') = 'allow') THEN 'allow'
    WHEN bool_or(coalesce(n.verdict, '') = 'block') THEN 'block' END AS inherited
  FROM reach r LEFT JOIN node_rules n ON r.other = n.node GROUP BY r.node),
judged AS (
  SELECT page_id, any_value(host) AS host, any_value(path) AS path, any_value(host || path || query) AS node,
    arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
    arg_max(verdict, length(rule_host || rule_path)) AS own
  FROM parsed LEFT JOIN rules ON contains(coalesce(url, ''), '://')
    AND (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
  coalesce(own, inherited, 'allow') AS verdict, coalesce(aliases, 1) AS aliases
FROM judged LEFT JOIN inherited USING (node)
"""


@query("op1_url_filter", OP1)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages, html_edges(pages), URL_RULES)


OP2 = r"""
WITH plain AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
firsts AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM plain GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM plain JOIN firsts USING (t)
"""


@query("op2_chunk_recipes", OP2)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


@query("op3_toxic_segments")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), F.col("toxicity.score").alias("score"),
        (F.col("toxicity.score") >= 0.7).cast("int").alias("predicted"),
        F.size("toxicity.passages").cast("long").alias("n_passages"))


@query("op4_decision_list")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    statistics = Scratch(spark, "statistics").write(text_statistics(table(spark, sf_dir, "documents")))
    rules = learn_rules(statistics, table(spark, sf_dir, "labels"))
    return apply_rules(statistics, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op5_bin_completion")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(token_pieces(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json"))))


@query("op6_byte_cnn")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model, into="score").select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


# the tree of the mixture: crawled sources against chosen ones, then language, then source
CHOSEN = r"^src1[0-9]$"
LEVELS = {"domain": f"CASE WHEN source RLIKE '{CHOSEN}' THEN 'chosen' ELSE 'crawled' END",
          "language": "lang", "origin": "source"}
WEIGHTS = {"domain": {"crawled": 6, "chosen": 4}, "language": {"en": 5, "de": 2, "fr": 2, "es": 1}, "origin": {}}


def _mixture_sql() -> str:
    weight = {level: "CAST(CASE " + level + "".join(f" WHEN '{k}' THEN {v}" for k, v in own.items())
              + " ELSE 1 END AS BIGINT)" if own else "CAST(1 AS BIGINT)" for level, own in WEIGHTS.items()}
    steps, path = [], []
    for level in LEVELS:
        above, path = list(path), [*path, level]
        cols, up = ", ".join(path), ", ".join(above)
        by = f"PARTITION BY {up} " if above else ""
        run = f"({by}ORDER BY need, {level} ROWS UNBOUNDED PRECEDING)"
        join = f"JOIN plan_{above[-1]} USING ({up})" if above else "CROSS JOIN root"
        steps.append(f"""
n_{level} AS (
  SELECT {cols}, CAST(sum(cap) AS BIGINT) AS cap, {weight[level]} AS weight FROM leaves GROUP BY {cols}),
o_{level} AS (SELECT *, CAST(cap AS DOUBLE) / weight AS need FROM n_{level} {join}),
c_{level} AS (
  SELECT *, CAST(sum(cap) OVER {run} - cap AS BIGINT) AS bef,
    CAST(sum(weight) OVER ({by}) - sum(weight) OVER {run} + weight AS BIGINT) AS opened FROM o_{level}),
f_{level} AS (
  SELECT *, min(CASE WHEN need <= CAST(budget - bef AS DOUBLE) / opened THEN 1 ELSE 0 END) OVER {run} AS ful
  FROM c_{level}),
plan_{level} AS (
  SELECT {cols}, CASE WHEN ful = 1 THEN cap ELSE CAST(floor(weight * (
    CAST(budget - coalesce(sum(CASE WHEN ful = 1 THEN cap END) OVER ({by}), 0) AS DOUBLE)
    / CAST(sum(CASE WHEN ful = 0 THEN weight END) OVER ({by}) AS DOUBLE))) AS BIGINT) END AS budget
  FROM f_{level})""")
    return rf"""
WITH rows AS (
  SELECT doc_id, CASE WHEN regexp_matches(source, '{CHOSEN}') THEN 'chosen' ELSE 'crawled' END AS domain,
    coalesce(lang, '') AS language, coalesce(source, '') AS origin,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS BIGINT) AS tokens FROM documents),
leaves AS (
  SELECT domain, language, origin, CAST(sum(tokens) AS BIGINT) AS supply,
    CAST(sum(tokens) * {mixing.EPOCHS} AS BIGINT) AS cap FROM rows GROUP BY ALL),
root AS (
  SELECT least(CAST(floor(CAST(sum(supply) AS DOUBLE) * CAST({mixing.SHARE} AS DOUBLE)) AS BIGINT),
               CAST(sum(cap) AS BIGINT)) AS budget FROM leaves),{",".join(steps)},
planned AS (
  SELECT *, CAST(CASE WHEN supply > 0 THEN budget // supply ELSE 0 END AS INTEGER) AS whole
  FROM leaves JOIN plan_origin USING (domain, language, origin)),
placed AS (
  SELECT doc_id, domain, language, origin, tokens, whole, budget - whole * supply AS rest,
    md5(concat('{mixing.SEED}|', whole, '|', doc_id)) AS place
  FROM rows JOIN planned USING (domain, language, origin)),
run AS (
  SELECT *, sum(tokens) OVER (PARTITION BY domain, language, origin ORDER BY place) AS upto FROM placed)
SELECT doc_id, domain, language, origin, tokens, whole AS epoch FROM run WHERE rest > 0 AND upto <= rest
UNION ALL
SELECT doc_id, domain, language, origin, tokens, CAST(unnest(range(whole)) AS INTEGER) AS epoch
FROM placed WHERE whole > 0
"""


@query("op7_mixture", _mixture_sql())
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"), LEVELS, WEIGHTS)


OP8 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
escaped AS (
  SELECT *, regexp_replace(replace(text, chr(92), chr(92) || chr(92)),
    '(<|\[)(sys>|/sys>|INST\]|/INST\]|s>|/s>|role>|text>|/text>)', '\1' || chr(92) || chr(92) || '\2', 'g') AS e FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(e) + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
    ELSE 19 + length(role) END) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""


@query("op8_chat_template", OP8)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"))
    return read_back(format_chats(turns.unionByName(tricky))).drop("valid")


@query("op9_superminhash")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op10_katz")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = katz_scores(table(spark, sf_dir, "documents"))
    return scores.select("doc_id", (fold("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known",
                         "train_tokens", "base_score", "score")


def alignment_digest(documents: DataFrame) -> DataFrame:
    """The numbers of ``align_tokens``, and a digest of the written groups."""
    return documents.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.when(
        F.col("n_groups") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("").alias("groups_sha256"))


@query("op11_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment_digest(align_tokens(
        table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")),
        str(public_tokenizers.path("piece_bpe_32k.model"))).documents)


@query("op12_compression")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = F.col("language")
    return predict_language(docs.select("doc_id", "text"), fit_languages(docs)).select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), found["lang"].alias("lang_pred"),
        found["score"].alias("score"), found["margin"].alias("margin"), found["accepted"].alias("accepted"))


OP13 = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece_no, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
words AS (SELECT lang, piece_no, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM pieces),
windows AS (
  SELECT lang, w1, lead(w1, 1) OVER run AS w2, lead(w1, 2) OVER run AS w3
  FROM words WINDOW run AS (PARTITION BY piece_no ORDER BY i)),
counts AS MATERIALIZED (
  SELECT lang, 1 AS size, w1 AS phrase, count(*) AS f FROM windows GROUP BY ALL
  UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM windows WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM windows WHERE w3 IS NOT NULL GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE size = 1 GROUP BY lang),
candidates AS (
  SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE size > 1 AND f >= 10),
parts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates)),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k, l.f AS l, r.f AS r,
    CAST((CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM parts c JOIN counts l ON l.lang = c.lang AND l.phrase = head JOIN counts r ON r.lang = c.lang AND r.phrase = tail),
worst AS (
  SELECT lang, phrase, a, l, r, score FROM cuts
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase, a FROM candidates WHERE size = 3),
inside AS (SELECT lang, phrase, max(a) AS most FROM longer GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM worst JOIN totals USING (lang) LEFT JOIN inside USING (lang, phrase)
WHERE coalesce(most, 0) * 100 < a * 50
QUALIFY rank <= 2000
"""


@query("op13_phrase_tries", OP13)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
