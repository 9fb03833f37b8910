"""The queries over these operators and, where SQL can express them, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe as _bpe
from . import exact_dedup as _exact
from . import langid as _langid
from . import lm_score as _lm
from . import mixing as _mixing
from . import ogg as _ogg
from . import secrets as _secrets
from . import simhash as _simhash
from . import spans_dedup as _spans
from . import token_store as _store


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = _lm.quality_targets(_table(spark, sf_dir, "labels"))
    out = _lm.score(_table(spark, sf_dir, "documents"), targets)
    return out.select("doc_id", "n_tokens", *(F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans.dedup_spans(_table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact.exact_dedup(_table(spark, sf_dir, "documents"))


#: Target weights of the mixture; names that are not here weigh 1.
WEIGHTS = {
    "domain": {"domain0": 4, "domain1": 3, "domain2": 2},
    "lang": {"en": 4, "de": 2, "fr": 2},
    "source": {},
}


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixing.mix(_table(spark, sf_dir, "documents"), fraction=(3, 4), weights=WEIGHTS, max_epochs=4, seed=7)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _secrets.span_digests(_secrets.secret_spans(_table(spark, sf_dir, "documents")))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bpe.round_trip(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op7_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return _ogg.media_features(_ogg.with_media(docs))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _simhash.simhash_groups(_table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = _langid.with_language(docs.select("doc_id", "text"), _langid.train(docs))
    return out.select("doc_id", _langid.held_out("doc_id").alias("held_out"), "lang_pred", "score", "mixture")


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store.store_and_read(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


# What SQL can say of operators that it cannot express as a whole: the columns it can work out.


def llm_secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def llm_media_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_ogg_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def llm_language_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_language_id(spark, sf_dir).select("doc_id", "held_out", (F.col("lang_pred") == _langid.UNKNOWN).alias("unknown"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith(("op", "llm_")) and callable(f)}


SQL: dict[str, str] = {}

SQL["op1_lm_score"] = f"""
WITH good AS (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL GROUP BY doc_id),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS w, unnest(list_prepend('', ws[1:len(ws) - 1])) AS v, doc_id IN (SELECT doc_id FROM good) AS good FROM w WHERE len(ws) > 0),
one AS (SELECT w, count(*) AS cb, count(*) FILTER (good) AS ct FROM t GROUP BY w),
ctx AS (SELECT w, cb, ct FROM one UNION ALL SELECT '', count(*), count(*) FILTER (good) FROM t WHERE v = ''),
two AS (SELECT v, w, count(*) AS cb, count(*) FILTER (good) AS ct FROM t GROUP BY v, w),
n AS (SELECT count(*) AS vocabulary, sum(cb) AS tb, sum(ct) AS tt FROM one),
p AS (
  SELECT two.v, two.w,
    -ln((two.cb + {_lm.ALPHA} * ((one.cb + {_lm.BETA}) / (tb + {_lm.BETA} * vocabulary))) / (ctx.cb + {_lm.ALPHA})) AS lb,
    -ln((two.ct + {_lm.ALPHA} * ((one.ct + {_lm.BETA}) / (tt + {_lm.BETA} * vocabulary))) / (ctx.ct + {_lm.ALPHA})) AS lt
  FROM two JOIN one ON two.w = one.w JOIN ctx ON two.v = ctx.w CROSS JOIN n)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_tokens, round(x.lt, 6) AS target_loss, round(x.lb, 6) AS background_loss, round(x.lt - x.lb, 6) AS score
FROM w LEFT JOIN (SELECT doc_id, avg(lt) AS lt, avg(lb) AS lb FROM t JOIN p USING (v, w) GROUP BY doc_id) x USING (doc_id)
"""

SQL["op3_exact_dedup"] = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""


def _share_sql(nodes: str, parent: str, child: str, weights: dict[str, int]) -> str:
    case = "CASE " + "".join(f"WHEN {child} = '{k}' THEN {w} " for k, w in weights.items()) + "ELSE 1 END" if weights else "1"
    up = f"PARTITION BY {parent}"
    return f"""
  SELECT *, CAST(part + CASE WHEN NOT is_full AND row_number() OVER ({up} ORDER BY is_full, {child}) <= least(up, sum(cap) OVER ({up})) - sum(part) OVER ({up}) THEN 1 ELSE 0 END AS BIGINT) AS budget
  FROM (SELECT *, CASE WHEN is_full THEN cap ELSE (up - coalesce(sum(CASE WHEN is_full THEN cap END) OVER ({up}), 0)) * w // nullif(sum(CASE WHEN NOT is_full THEN w END) OVER ({up}), 0) END AS part
    FROM (SELECT *, cap * sum(w) OVER ({up} ORDER BY cap / w, {child} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
            <= (up - coalesce(sum(cap) OVER ({up} ORDER BY cap / w, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS is_full
      FROM (SELECT *, CAST({case} AS BIGINT) AS w FROM {nodes})))"""


SQL["op4_source_mixing"] = f"""
WITH d AS (
  SELECT doc_id, coalesce('domain' || (TRY_CAST(regexp_extract(source, '[0-9]+') AS INTEGER) % 4), 'other') AS domain,
    coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS BIGINT) AS n_tokens
  FROM documents
), docs AS (SELECT * FROM d WHERE n_tokens > 0),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS supply, CAST(sum(n_tokens) * 4 AS BIGINT) AS cap FROM docs GROUP BY ALL),
root AS (SELECT CAST(least(sum(supply) * 3 // 4, sum(cap)) AS BIGINT) AS up FROM leaves),
n1 AS (SELECT domain, CAST(sum(cap) AS BIGINT) AS cap, any_value(up) AS up FROM leaves, root GROUP BY domain),
b1 AS ({_share_sql("n1", "up", "domain", WEIGHTS["domain"])}),
n2 AS (SELECT l.domain, l.lang, CAST(sum(l.cap) AS BIGINT) AS cap, any_value(b1.budget) AS up FROM leaves l JOIN b1 USING (domain) GROUP BY l.domain, l.lang),
b2 AS ({_share_sql("n2", "domain", "lang", WEIGHTS["lang"])}),
n3 AS (SELECT l.*, b2.budget AS up FROM leaves l JOIN b2 USING (domain, lang)),
b3 AS ({_share_sql("n3", "domain, lang", "source", WEIGHTS["source"])}),
plan AS (SELECT domain, lang, source, budget // supply AS epochs, budget % supply AS rest FROM b3),
j AS (SELECT docs.*, epochs, rest, md5('7:' || epochs || ':' || doc_id) AS h FROM docs JOIN plan USING (domain, lang, source)),
tail AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY substr(h, 1, 8), doc_id, n_tokens ROWS UNBOUNDED PRECEDING) - n_tokens AS ahead FROM j WHERE rest > 0)
SELECT doc_id, domain, lang, source, n_tokens, CAST(unnest(range(epochs)) AS BIGINT) AS epoch, n_tokens AS taken FROM j
UNION ALL
SELECT doc_id, domain, lang, source, n_tokens, CAST(epochs AS BIGINT) AS epoch, CAST(least(n_tokens, rest - ahead) AS BIGINT) AS taken FROM tail WHERE ahead < rest
"""


def _secret_spans_sql(kind: str, place: int, pattern: str, least: str) -> str:
    """SQL: doc_id, kind, place, s, e of a pattern's matches, by marking, cutting and adding up."""
    return f"""SELECT doc_id, '{kind}' AS kind, {place} AS place, e - length(v) AS s, e FROM (
      SELECT doc_id, v, ix, sum(length(v)) OVER (PARTITION BY doc_id ORDER BY ix) AS e FROM (
        SELECT doc_id, unnest(parts) AS v, generate_subscripts(parts, 1) AS ix FROM (
          SELECT doc_id, string_split(regexp_replace(t, '{pattern}', chr(1) || '\\0' || chr(1), 'g'), chr(1)) AS parts FROM d))) WHERE ix % 2 = 0 AND {least}"""


_ASSIGN = """(?i)(?:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?[A-Za-z0-9+/_.=-]+"""
_VALUE = _ASSIGN.replace("[A-Za-z0-9+/_.=-]+", "([A-Za-z0-9+/_.=-]+)")

SQL["llm_secret_base_spans"] = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), chr(1), ' ') AS t FROM documents),
s AS ({_secret_spans_sql('assign', 0, _ASSIGN, f"length(regexp_extract(v, '{_VALUE}', 1)) >= 12")}
  UNION ALL {_secret_spans_sql('access', 1, 'AKIA[A-Z0-9]+', 'length(v) >= 18')}
  UNION ALL {_secret_spans_sql('hex', 2, '[0-9a-f]+', 'length(v) >= 16')}),
g AS (SELECT doc_id, count(*) FILTER (place = 0) AS a, count(*) FILTER (place = 1) AS b, count(*) FILTER (place = 2) AS c,
  string_agg(kind || ':' || CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(e AS BIGINT) AS VARCHAR), ',' ORDER BY s, place) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN g USING (doc_id)
"""

SQL["llm_media_payload"] = f"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
p AS (SELECT doc_id, b, CAST(octet_length(b) AS BIGINT) AS n FROM d),
q AS (SELECT *, CASE WHEN n = 0 THEN {_ogg.UNIT} ELSE ({_ogg.UNIT} - n % {_ogg.UNIT}) % {_ogg.UNIT} END AS pad FROM p)
SELECT doc_id, n AS n_bytes, CAST(n + pad AS BIGINT) AS payload_bytes, sha256(b || repeat('\\xFF'::BLOB, pad)) AS payload_sha256 FROM q
"""

#: CRC-32 of the id's digits: each byte is taken in, then eight steps of one bit.
SQL["llm_language_folds"] = """
WITH d AS (SELECT doc_id, text, list_transform(range(1, 1 + length(CAST(doc_id AS VARCHAR))), lambda i: CAST(ord(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT)) AS bytes FROM documents),
s AS (SELECT doc_id, text, list_prepend(4294967295::BIGINT, flatten(list_transform(bytes, lambda b: [1000 + b, 0, 0, 0, 0, 0, 0, 0, 0]))) AS steps FROM d),
c AS (SELECT doc_id, text, xor(list_reduce(steps, lambda c, x: CASE WHEN x >= 1000 THEN xor(c, x - 1000) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295::BIGINT) AS crc FROM s)
SELECT doc_id, crc % 5 = 0 AS held_out, text IS NULL OR NOT regexp_matches(text, '\\p{L}') AS unknown FROM c
"""


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
