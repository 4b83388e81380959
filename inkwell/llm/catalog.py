"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import (
    bpe,
    collocations,
    decontaminate,
    fingerprint,
    html_text,
    jaccard,
    language_model,
    line_dedup,
    merkle,
    secret_scan,
    toxicity,
    url_rules,
    warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


URL_RULES = [
    url_rules.Rule("com", "/", "allow"),
    url_rules.Rule("example.com", "/en/", "block"),
    url_rules.Rule("www.example.com", "/en/", "allow"),
    url_rules.Rule("net", "/es/", "block"),
    url_rules.Rule("net", "/fr/", "block"),
]

_URL_SQL = """
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r
  FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
judged AS (
  SELECT page_id, host, path, CASE
    WHEN ('.' || host) LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block'
  ELSE 'allow' END AS verdict FROM judged
"""


@query("op1_url_rules", _URL_SQL)
def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's URL."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query("op3_warc")
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC archives and read back record by record."""
    records = warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return records.select(
        F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op5_bpe")
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = bpe.round_trip(docs, byte_bpe_path())
    return both.select(
        "doc_id",
        F.size("tokens.ids").cast("bigint").alias("n_tokens"),
        bpe.ids_digest(F.col("tokens.ids")).alias("ids_sha256"),
        F.sha2(F.col("tokens.decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op2_html_text")
def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract_text(pages).select("page_id", "url", "text", "n_chars")


@query("op9_fingerprint")
def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edit, and how like they are."""
    return fingerprint.fingerprint_next(table(spark, sf_dir, "documents"))


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


@query("op7_jaccard_join")
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every document's shingle set and its group of near-copies."""
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


@query("op10_language_model")
def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document, by unigram counts and by the trained model."""
    return language_model.score_documents(table(spark, sf_dir, "documents"))


@query("op4_line_dedup")
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that stand, nearly equal, earlier."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "text", "dropped_lines")


@query("op6_decontamination")
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document, and whether it has any."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "contaminated", F.col("leaks.item_id").alias("items"), F.size("leaks").cast("bigint").alias("n_leaks")
    )


_MERKLE_SQL = """
WITH RECURSIVE rows AS (
  SELECT doc_id, source, text, n_chars, lang,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') ||
    coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') ||
    coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS head,
    list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
        lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))) AS crc
  FROM documents),
leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN doc_id IS NOT NULL AND xor(crc, 4294967295) % 2 = 0
      THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-'))
      ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS found
  FROM rows),
placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY source) AS n, row_number() OVER () AS id FROM leaves),
up(tree, lvl, pos, n, digest) AS (
  SELECT source, 0, pos, n, leaf FROM placed
  UNION ALL
  SELECT tree, lvl + 1, pos // 3, (max(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos))
  FROM up WHERE n > 1 GROUP BY tree, lvl, pos // 3),
tops AS (
  SELECT tree, digest, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
  FROM up WHERE n = 1),
over(lvl, pos, n, digest) AS (
  SELECT 0, pos, n, digest FROM tops
  UNION ALL
  SELECT lvl + 1, pos // 3, (max(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos))
  FROM over WHERE n > 1 GROUP BY lvl, pos // 3),
nodes AS (
  SELECT coalesce(':' || tree, '-') AS tree, lvl, pos, n, digest FROM up
  UNION ALL SELECT 'root', lvl, pos, n, digest FROM over),
beside AS (
  SELECT a.tree, a.lvl, a.pos, a.n, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS lft,
    coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS rgt
  FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.lvl = b.lvl AND a.pos // 3 = b.pos // 3
  GROUP BY a.tree, a.lvl, a.pos, a.n),
walk(id, tree, lvl, pos, digest, proof) AS (
  SELECT id, coalesce(':' || source, '-'), 0, pos, found, '' FROM placed
  UNION ALL
  SELECT w.id, w.tree, w.lvl + 1, w.pos // 3, sha256(b.lft || w.digest || b.rgt), w.proof || b.lft || b.rgt
  FROM walk w JOIN beside b ON w.tree = b.tree AND w.lvl = b.lvl AND w.pos = b.pos WHERE b.n > 1),
inner_ends AS (SELECT DISTINCT ON (id) id, tree, digest, proof FROM walk ORDER BY id, lvl DESC),
climb(id, lvl, pos, digest, proof) AS (
  SELECT e.id, 0, t.pos, e.digest, e.proof FROM inner_ends e JOIN tops t ON e.tree = coalesce(':' || t.tree, '-')
  UNION ALL
  SELECT c.id, c.lvl + 1, c.pos // 3, sha256(b.lft || c.digest || b.rgt), c.proof || b.lft || b.rgt
  FROM climb c JOIN beside b ON b.tree = 'root' AND c.lvl = b.lvl AND c.pos = b.pos WHERE b.n > 1),
ends AS (SELECT DISTINCT ON (id) id, digest, proof FROM climb ORDER BY id, lvl DESC)
SELECT k.doc_id, k.leaf, t.digest AS subroot, o.digest AS root, sha256(e.proof) AS proof_sha256,
  e.digest AS folded_root, e.digest = o.digest AS verified
FROM placed k JOIN ends e USING (id) JOIN tops t ON k.source IS NOT DISTINCT FROM t.tree
  CROSS JOIN (SELECT digest FROM over WHERE n = 1) o
"""


@query("op12_merkle", _MERKLE_SQL)
def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and what its proof says of the tampered one."""
    return merkle.prove(table(spark, sf_dir, "documents"))


_COLLOCATION_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS words FROM documents),
places AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM pieces),
spans AS (SELECT lang, words, i, unnest(range(1, 6)) AS k FROM places),
counts AS (
  SELECT lang, words[i:i + k - 1] AS phrase, count(*) AS f FROM spans WHERE i + k - 1 <= len(words) GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE len(phrase) = 1 GROUP BY lang),
candidates AS (SELECT * FROM counts WHERE f >= 100 AND len(phrase) > 1),
cuts AS (SELECT *, unnest(range(1, len(phrase))) AS k FROM candidates),
scored AS (
  SELECT c.lang, c.phrase, c.k, c.f AS a, x.f AS l, y.f AS r, t.n,
    ((1000::HUGEINT * c.f * t.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN totals t ON c.lang = t.lang
    JOIN counts x ON x.lang = c.lang AND x.phrase = c.phrase[1:c.k]
    JOIN counts y ON y.lang = c.lang AND y.phrase = c.phrase[c.k + 1:]),
weakest AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM scored),
inner_ends AS (SELECT lang, phrase, f, unnest(range(1, len(phrase))) AS i FROM candidates WHERE len(phrase) > 2),
inner_parts AS (SELECT lang, phrase, f, i, unnest(range(2, len(phrase))) AS k FROM inner_ends),
inside AS (
  SELECT lang, phrase[i:i + k - 1] AS part, max(f) AS most FROM inner_parts
  WHERE i + k - 1 <= len(phrase) GROUP BY ALL),
ranked AS (
  SELECT w.lang, array_to_string(w.phrase, ' ') AS phrase, a, l, r, n, score
  FROM weakest w LEFT JOIN inside m ON m.lang = w.lang AND m.part = w.phrase
  WHERE place = 1 AND (m.most IS NULL OR 100 * m.most < 100 * a))
SELECT * FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
    phrase, a, l, r, n, score FROM ranked)
WHERE rank <= 2000
"""


@query("op11_collocations", _COLLOCATION_SQL)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 phrases of every language whose words belong together most."""
    return collocations.mine(table(spark, sf_dir, "documents").select("lang", "text"))


@query("op13_secret_scan")
def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, by the rules and by the network learned from their findings."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scanned = secret_scan.scan(docs, secret_scan.train(docs))

    def joined(kinds: tuple[str, ...]):
        rules = F.filter("secrets", lambda s: s["kind"].isin(*kinds))
        return F.array_join(F.transform(rules, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def counted(kind: str):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    kinds = secret_scan.KINDS
    return scanned.select(
        "doc_id",
        *[counted(kind) for kind in kinds],
        F.sha2(joined(kinds), 256).alias("base_sha256"),
        joined((*kinds, secret_scan.NETWORK)).alias("spans"),
    )
