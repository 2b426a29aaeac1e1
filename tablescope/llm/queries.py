"""The registered queries of this package, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.llm import (
    bpe, embed_dedup, filter_audit, html_content, language_id, mixing, ngram_join, pii, prefix_trie, quality, secrets, toxicity,
    unigram,
)
from tablescope.llm.common import span_columns
from tablescope.plans.registry import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``build(tables) -> DataFrame`` under ``name``."""

    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if oracle:
            ORACLES[name] = oracle
        return build

    return register


def vocabulary(name: str) -> str:
    """Where the public vocabulary files are; imported here as no other module needs their package."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op3_bpe_encoding")
def _bpe(t: Tables) -> DataFrame:
    return bpe.token_digests(bpe.encode(t.documents, vocabulary("byte_bpe_50k.json")))


@query("op4_source_mixing")
def _mixing(t: Tables) -> DataFrame:
    return mixing.mixed_sizes(t.documents)


@query("op10_secret_scan")
def _secrets(t: Tables) -> DataFrame:
    return span_columns(secrets.scan(t.documents), secrets.BASE_KINDS)


@query("op7_ngram_jaccard")
def _ngram(t: Tables) -> DataFrame:
    return ngram_join.near_duplicates(t.documents)


@query("op8_toxicity")
def _toxicity(t: Tables) -> DataFrame:
    return toxicity.toxicity(t.documents, t.labels)


@query("op2_risk_controlled_quality")
def _quality(t: Tables) -> DataFrame:
    return quality.judge(t.documents, t.labels)


@query("op1_weakly_supervised_pii")
def _pii(t: Tables) -> DataFrame:
    return span_columns(pii.personal_data(t.documents), pii.BASE_KINDS)


@query("op5_html_main_text")
def _html(t: Tables) -> DataFrame:
    return html_content.extract(t.pages).withColumn("n_chars", F.length("text").cast("long"))


@query("op9_unigram_token_counts")
def _counts(t: Tables) -> DataFrame:
    return unigram.token_counts(t.documents, vocabulary("piece_bpe_32k.model"))


@query("op6_embedding_near_dedup")
def _embeddings(t: Tables) -> DataFrame:
    return embed_dedup.near_duplicates(t.embeddings)


#: Turns in order, conversations rebuilt with the first turns of their family's, every prefix with its members. CRC-32 is computed
#: bit by bit, as DuckDB has no such function.
TRIE_SQL = """WITH RECURSIVE bits AS (SELECT i, i AS v, 0 AS k FROM range(256) r(i)
    UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
  crc_table AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
  ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
  heads AS (SELECT conv_id, conv_id - conv_id % 5 AS lead, xor(list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
      lambda crc, b: xor(crc >> 8, t[(xor(crc, b) & 255) + 1])), 4294967295) % 9 AS h FROM ids, crc_table),
  turns AS (SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST,
      md5(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS ts
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
  built AS (SELECT h.conv_id, list_concat(coalesce(l.ts, [])[:h], o.ts[h + 1:]) AS path
    FROM heads h JOIN turns o ON o.conv_id = h.conv_id LEFT JOIN turns l ON l.conv_id = h.lead),
  steps AS (SELECT conv_id, len(path) AS n, d, path[:d] AS p FROM built, unnest(range(len(path) + 1)) u(d)),
  nodes AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs,
      sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256 FROM steps GROUP BY 1, 2),
  kids AS (SELECT p[:d - 1] AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
  worth AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * strlen(p[d].t) ELSE 0 END AS saved
    FROM nodes LEFT JOIN kids USING (p)),
  below AS (SELECT p[:a] AS p, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
    FROM worth, unnest(range(d + 1)) u(a) GROUP BY 1)
  SELECT w.conv_id, w.d AS depth, up.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves,
    saved_tokens::BIGINT AS saved_tokens, w.ends_sha256
  FROM worth w JOIN below USING (p) LEFT JOIN nodes up ON w.d > 0 AND up.p = w.p[:w.d - 1]"""


@query("op11_conversation_prefix_trie", TRIE_SQL)
def _trie(t: Tables) -> DataFrame:
    return prefix_trie.prefix_trie(t.conversations)


#: Masks of failures by window functions, every order by recursion, every step by its prefix of the order.
AUDIT_SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
  w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda s: s <> '') AS ws,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e FROM d),
  flags AS (SELECT doc_id, part, {'A': len(ws) < 50, 'B': 100 * len(list_distinct(ws)) < 65 * len(ws),
    'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text),
    'D': regexp_matches(text, '[#$%&*|]'), 'E': e} AS f FROM w),
  marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
  masks AS (SELECT part, f, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
    FROM flags LEFT JOIN marks USING (doc_id) GROUP BY 1, 2),
  letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
  orders AS (SELECT '' AS o UNION ALL SELECT o || c FROM orders, letters WHERE NOT contains(o, c)),
  steps AS (SELECT o, s, o[s] AS c, o[:s - 1] AS before FROM orders, range(1, 6) r(s) WHERE length(o) = 5),
  bits AS (SELECT part, n, good, toxic, list_filter([CASE WHEN f.A THEN 'A' END, CASE WHEN f.B THEN 'B' END,
    CASE WHEN f.C THEN 'C' END, CASE WHEN f.D THEN 'D' END, CASE WHEN f.E THEN 'E' END], lambda x: x IS NOT NULL) AS failed FROM masks),
  judged AS (SELECT part, o, s, c, n, good, toxic, list_contains(failed, c) AS fails, len(failed) AS k,
    len(list_intersect(failed, string_split(before, ''))) > 0 AS gone FROM bits, steps),
  rows_of AS (SELECT part, o AS filter_order, s::INTEGER AS step, c,
    sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN fails AND gone THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN fails AND k = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
    FROM judged GROUP BY 1, 2, 3, 4)
  SELECT * EXCLUDE (c), (sum(removed) OVER (PARTITION BY part, c))::BIGINT AS shapley FROM rows_of"""


@query("op12_filter_interaction_audit", AUDIT_SQL)
def _audit(t: Tables) -> DataFrame:
    return filter_audit.audit(t.spark, t.path("documents"), t.labels)


@query("op13_language_id")
def _language(t: Tables) -> DataFrame:
    return language_id.identify(t.documents)
