"""The thin registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from adtide.llm.automaton import drop_repeated_passages
from adtide.llm.decontaminate import contaminated
from adtide.llm.fixity import audit
from adtide.llm.jaccard import jaccard_classes
from adtide.llm.kdtree import top_k
from adtide.llm.language import fit_prototypes, identify
from adtide.llm.manifest import tampered_proofs
from adtide.llm.mixing import mix_sources
from adtide.llm.redaction import KINDS, personal_spans, span_digest
from adtide.llm.sharding import minimax_shards
from adtide.llm.suffixes import drop_repeated_bytes
from adtide.llm.tokenalign import aligned_counts
from adtide.llm.urlrules import default_patterns, judged, rules_of

QUERIES = {}
ORACLE: dict[str, str] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, sources = mix_sources(table(spark, sf_dir, "documents"))
    key = sources.select(F.to_json(F.array("source")).alias("pattern"), F.col("size").alias("source_size"), "target")
    return docs.join(F.broadcast(key), "pattern").select("doc_id", "size", "source_size", "target", "taken")


@register
def op8_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = personal_spans(table(spark, sf_dir, "documents"))
    count = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long) AS n_{k}") for k in KINDS]
    return spans.select("doc_id", *count, F.sha2(span_digest(F.col("base")), 256).alias("base_sha256"),
                        span_digest(F.concat("base", "added")).alias("spans"))


@register
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minimax_shards(table(spark, sf_dir, "documents"))


@register
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    prototypes = fit_prototypes(docs.where(~held))
    return identify(docs.select("doc_id", held.alias("held_out"), "text"), prototypes).select(
        "doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


@register
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


@register
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_passages(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@register
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_bytes(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@register
def op2_kd_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE["op2_kd_search"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


@register
def op5_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of a replica of ``pages`` in which some records were altered, lost or added."""
    pages = table(spark, sf_dir, "pages")
    turn = F.col("page_id") % 97
    replica = pages.where(turn != 13).withColumn("html", F.when(turn == 11, F.concat("html", F.lit(" "))).otherwise(F.col("html")))
    added = pages.where(turn == 17).withColumn("page_id", -1 - F.col("page_id"))
    return audit(pages, replica.unionByName(added))


_RECORD = (
    "'WARC/1.1' || e || 'WARC-Type: response' || e || 'WARC-Record-ID: <urn:record:' || {id} || '>' || e || 'WARC-Target-URI: ' || coalesce(url, '') || e || "
    "'Content-Length: ' || strlen({html}) || e || e || {html} || e || e")
ORACLE["op5_merkle_audit"] = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, chr(13) || chr(10) AS e FROM pages),
r AS (SELECT page_id, {_RECORD.format(id='page_id', html='html')} AS record, {_RECORD.format(id='page_id', html="(html || ' ')")} AS changed,
  {_RECORD.format(id='(-1 - page_id)', html='html')} AS moved FROM p),
o AS (SELECT *, CAST(coalesce(sum(strlen(record)) OVER (ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos FROM r)
SELECT page_id, CASE page_id % 97 WHEN 13 THEN 'missing' ELSE 'altered' END AS status, pos AS start_byte, CAST(strlen(record) AS BIGINT) AS bytes,
  sha256(record) AS expected, CASE page_id % 97 WHEN 11 THEN sha256(changed) END AS found
FROM o WHERE page_id % 97 IN (11, 13)
UNION ALL SELECT -1 - page_id, 'extra', 0, 0, NULL, sha256(moved) FROM o WHERE page_id % 97 = 17"""


# The rules of the contract, as (host and path, action).
SITE_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


@register
def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = rules_of(spark, [("site", r, a) for r, a in SITE_RULES]).unionByName(default_patterns(spark))
    return judged(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict", "pattern")


_SEP = "(^|[^A-Za-z0-9]|$)"
_WORDS = "ads|adserver|adult|banners|bets|betting|casino|pills|poker|porn|replica|viagra|xxx"
ORACLE["op11_url_filters"] = rf"""
WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^/?#]*(.*)$', 1, 's') AS tail FROM p),
r AS (SELECT *, host || tail AS t, CASE
  WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM h),
m AS (SELECT page_id, host, path, rule, list_filter([
  {', '.join(f"CASE WHEN regexp_matches(t, '{_SEP}{w}{_SEP}') THEN '^{w}^' END" for w in _WORDS.split('|'))},
  CASE WHEN regexp_matches(t, '^([^/?#]*\.)?.*/cgi-bin/', 's') THEN '||*/cgi-bin/' END, CASE WHEN regexp_matches(t, '^([^/?#]*\.)?.*/wp-admin/', 's') THEN '||*/wp-admin/' END,
  CASE WHEN regexp_matches(t, '/login{_SEP}') THEN '/login^' END, CASE WHEN regexp_matches(t, '/cart{_SEP}') THEN '/cart^' END,
  CASE WHEN contains(t, '?sessionid=') THEN '?sessionid=' END, CASE WHEN contains(t, '&sessionid=') THEN '&sessionid=' END,
  {', '.join(f"CASE WHEN ends_with(t, '.{e}') THEN '.{e}|' END" for e in ('exe', 'zip', 'jpg', 'png'))}], lambda x: x IS NOT NULL) AS fits FROM r)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NULL AND len(fits) > 0 THEN 'block' ELSE 'allow' END AS verdict,
  CASE WHEN rule IS NULL THEN list_reverse_sort(list_transform(fits, lambda x: struct_pack(n := length(x), x := x)))[1].x END AS pattern FROM m"""


@register
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tampered_proofs(table(spark, sf_dir, "documents"))


def _leaf_sql(**changed: str) -> str:
    fields = {c: changed.get(c, c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    return "sha256(" + " || ".join(f"coalesce(strlen(CAST({e} AS VARCHAR)) || ':' || CAST({e} AS VARCHAR), '-')" for e in fields.values()) + ")"


_CRC_SQL = """list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), lambda c, b:
  list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda s, z: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384::BIGINT) ELSE s >> 1 END))"""
_LEVELS_SQL = """SELECT {g}, 0 AS lvl, pos, hash, n FROM {of} UNION ALL
  SELECT {g}, lvl + 1, pos // 2, sha256(string_agg(hash, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM {name} WHERE n > 1 GROUP BY {g}, lvl, pos // 2"""
# Nodes level by level; the path of a document runs through its tree (up to lvl 100) and on through the tree of roots.
ORACLE["op12_merkle_manifest"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {_leaf_sql()} AS hash,
  CASE WHEN xor({_CRC_SQL}, 4294967295::BIGINT) % 7 = 0 AND n_chars IS NOT NULL THEN {_leaf_sql(n_chars='(n_chars + 1)')} END AS bad FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, hash) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM d),
nodes AS ({_LEVELS_SQL.format(g='g', of='leaves', name='nodes')}),
subs AS (SELECT g, hash, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS ({_LEVELS_SQL.format(g="''", of='subs', name='tops').replace("'', 0 AS", "'' AS g, 0 AS").replace("GROUP BY '', ", "GROUP BY ")}),
steps AS (SELECT DISTINCT g, lvl FROM nodes WHERE n > 1),
ways AS (
  SELECT l.doc_id, l.pos AS leaf_pos, l.g, e.lvl, (l.pos >> e.lvl) % 2 = 1 AS is_left, s.hash FROM leaves l JOIN steps e ON e.g = l.g
    LEFT JOIN nodes s ON s.g = l.g AND s.lvl = e.lvl AND s.pos = xor(l.pos >> e.lvl, 1)
  UNION ALL SELECT l.doc_id, l.pos, l.g, 100 + t.lvl, (b.pos >> t.lvl) % 2 = 1, s.hash FROM leaves l JOIN subs b ON b.g = l.g JOIN (SELECT DISTINCT lvl FROM tops WHERE n > 1) t ON true
    LEFT JOIN tops s ON s.lvl = t.lvl AND s.pos = xor(b.pos >> t.lvl, 1)),
path AS (SELECT g, leaf_pos, coalesce(string_agg(hash, '' ORDER BY lvl), '') AS sibs,
  list(struct_pack(l := is_left, h := coalesce(hash, '')) ORDER BY lvl) AS way FROM ways GROUP BY g, leaf_pos),
folded AS (SELECT l.*, coalesce(p.sibs, '') AS sibs, list_reduce(list_concat([struct_pack(l := false, h := coalesce(l.bad, l.hash))], coalesce(p.way, [])),
  lambda a, b: struct_pack(l := false, h := CASE WHEN b.l THEN sha256(b.h || a.h) ELSE sha256(a.h || b.h) END)).h AS folded_root FROM leaves l LEFT JOIN path p ON p.g = l.g AND p.leaf_pos = l.pos)
SELECT doc_id, f.hash AS leaf, s.hash AS subroot, t.hash AS root, sha256(sibs) AS proof_sha256, folded_root, folded_root = t.hash AS verified
FROM folded f JOIN subs s ON s.g = f.g JOIN (SELECT hash FROM tops WHERE n = 1) t ON true"""


@register
def op13_token_alignment(spark: SparkSession, sf_dir: str, tokenizers: str = "/opt/tokenizers") -> DataFrame:
    a, b = (Path(tokenizers, name).read_bytes() for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return aligned_counts(table(spark, sf_dir, "documents"), a, b)
