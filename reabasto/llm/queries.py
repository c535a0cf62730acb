"""The registered queries: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reabasto.llm import archives, collocations, line_runs, main_text, minhash, mixing, multi_index, packing, sorted_passes
from reabasto.llm import suffix_dedup, toxicity, url_rules, whitening
from reabasto.llm.common import ship

#: Rules of op7: host, path, verdict.
URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary file lies on this machine; the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_arc_to_warc(spark: SparkSession, folder: str) -> DataFrame:
    return archives.round_trip(_table(spark, folder, "pages"))


def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"), tokenizer_path())


def op3_multi_index(spark: SparkSession, folder: str) -> DataFrame:
    return multi_index.nearest(_table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return main_text.extract(_table(spark, folder, "pages"))


def op5_sorted_passes(spark: SparkSession, folder: str) -> DataFrame:
    return sorted_passes.link(_table(spark, folder, "embeddings"))


def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.measure(_table(spark, folder, "documents"))


def op7_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    shapes = sorted({(len(h.split(".")), len(p)) for h, p, _ in URL_RULES})
    return url_rules.judge(_table(spark, folder, "pages"), url_rules.rules_frame(spark, URL_RULES), shapes=shapes)


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    machine = toxicity.machine_for(docs, _table(spark, folder, "labels"))
    return toxicity.classify(docs, machine)


def op9_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_table(spark, folder, "documents"))


def op10_probminhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.groups(_table(spark, folder, "documents"))


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(_table(spark, folder, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def op12_line_runs(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_runs.deduplicate(_table(spark, folder, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(_table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_arc_to_warc": op1_arc_to_warc,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_multi_index": op3_multi_index,
    "op4_main_text": op4_main_text,
    "op5_sorted_passes": op5_sorted_passes,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_url_rules": op7_url_rules,
    "op8_toxicity": op8_toxicity,
    "op9_source_mix": op9_source_mix,
    "op10_probminhash": op10_probminhash,
    "op11_whitening": op11_whitening,
    "op12_line_runs": op12_line_runs,
    "op13_collocations": op13_collocations,
}


def _op7_sql() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    return f"""
    WITH rules(r_host, r_path, r_verdict) AS (VALUES {rules}),
    rests AS (
        SELECT page_id, url, row_number() OVER () AS row_id,
               CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
        FROM pages
    ),
    parts AS (
        SELECT page_id, row_id,
               translate(regexp_extract(rest, '^([^/?#]*)', 1), '{url_rules.UPPER}', '{url_rules.LOWER}') AS host,
               regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
        FROM rests
    ),
    fitting AS (
        SELECT row_id, r_host || r_path AS rule, r_verdict,
               row_number() OVER (PARTITION BY row_id ORDER BY length(r_host || r_path) DESC, length(r_host) DESC, r_verdict DESC) AS place
        FROM parts JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
        WHERE host <> ''
    )
    SELECT page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict
    FROM parts LEFT JOIN fitting ON parts.row_id = fitting.row_id AND place = 1
    """


OP1_SQL = """
    WITH payloads AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
    digests AS (SELECT page_id, url, strlen(html) AS n, sha256(html) AS digest FROM payloads),
    firsts AS (SELECT digest, min(page_id) AS one FROM digests WHERE n >= 100 GROUP BY digest)
    SELECT page_id, n AS payload_bytes, d.digest AS payload_digest, CASE WHEN page_id <> one THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN page_id <> one THEN one END AS refers_to, coalesce(nullif(url, ''), 'unknown:') AS target_uri, true AS whole
    FROM digests d LEFT JOIN firsts f ON f.digest = d.digest
    """

OP5_SQL = """
    WITH RECURSIVE vectors AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    links AS (
        SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id <> b.vec_id
        WHERE list_cosine_similarity(a.v, b.v) >= 0.93
    ),
    reach(node, root) AS (
        SELECT vec_id, vec_id FROM vectors UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.node
    ),
    roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
    counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT vec_id, coalesce(n, 0) AS n_links, root AS component_id, vec_id = root AS kept
    FROM vectors JOIN roots ON node = vec_id LEFT JOIN counts ON a = vec_id
    """

OP6_SQL = """
    WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
    strings AS (SELECT doc_id, p, md5(substr(x, 2 * p + 1, 800)) AS s FROM (SELECT doc_id, x, unnest(range(0, n - 399)) AS p FROM texts)),
    again AS (SELECT doc_id, p FROM strings WHERE s IN (SELECT s FROM strings GROUP BY s HAVING count(*) > 1)),
    marked AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 400 AS joined FROM again),
    numbered AS (SELECT doc_id, p, count(*) FILTER (WHERE joined IS NOT TRUE) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM marked),
    runs AS (SELECT doc_id, run, min(p) AS a, max(p) + 400 AS b FROM numbered GROUP BY doc_id, run),
    pieces AS (
        SELECT t.doc_id, run, substr(x, 2 * coalesce(lag(b) OVER w, 0) + 1, 2 * (a - coalesce(lag(b) OVER w, 0))) AS piece, b - a AS gone,
               CASE WHEN lead(a) OVER w IS NULL THEN substr(x, 2 * b + 1) ELSE '' END AS rest
        FROM runs r JOIN texts t ON t.doc_id = r.doc_id WINDOW w AS (PARTITION BY t.doc_id ORDER BY run)
    ),
    cut AS (SELECT doc_id, sum(gone) AS gone, count(*) AS spans, string_agg(piece || rest, '' ORDER BY run) AS left_hex FROM pieces GROUP BY doc_id)
    SELECT t.doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(left_hex, x))) AS kept_sha256
    FROM texts t LEFT JOIN cut c ON c.doc_id = t.doc_id
    """


OP12_SQL = f"""
    WITH lines AS (
        SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place, unnest(string_split(coalesce(text, ''), chr(10))) AS line
        FROM documents
    ),
    keyed AS (
        SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{line_runs.UPPER}', '{line_runs.LOWER}') AS k FROM lines
    ),
    repeated AS (SELECT k, max(doc_id) AS top FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
    marked AS (SELECT doc_id, place, line, coalesce(top <> doc_id, false) AS gone FROM keyed LEFT JOIN repeated USING (k))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY doc_id
    """

OP13_SQL = f"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), '{line_runs.UPPER}', '{line_runs.LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
        FROM documents
    ),
    words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
    grams AS (
        SELECT lang, k, unnest([array_to_string(w[i : i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS g FROM words, range(1, 6) AS ks(k)
    ),
    f AS (SELECT lang, k, g, count(*) AS n FROM grams GROUP BY ALL),
    totals AS (SELECT lang, sum(n) AS n FROM f WHERE k = 1 GROUP BY lang),
    often AS (SELECT * FROM f WHERE n >= 100),
    longer AS (
        SELECT DISTINCT lang, unnest(flatten([[array_to_string(string_split(g, ' ')[i : i + m - 1], ' ') FOR i IN range(1, k - m + 2)] FOR m IN range(2, k)])) AS g, n
        FROM often WHERE k > 2
    ),
    found AS (
        SELECT * FROM often o WHERE k > 1 AND NOT EXISTS (SELECT 1 FROM longer b WHERE b.lang = o.lang AND b.g = o.g AND 100 * b.n >= 100 * o.n)
    ),
    cuts AS (
        SELECT lang, g, n AS a, c, array_to_string(string_split(g, ' ')[1 : c], ' ') AS one, array_to_string(string_split(g, ' ')[c + 1 :], ' ') AS two
        FROM found, range(1, 5) AS cs(c) WHERE c < k
    ),
    scored AS (
        SELECT cuts.lang, cuts.g, a, c, x.n AS l, y.n AS r, t.n AS n, 1000::HUGEINT * a * t.n // (x.n::HUGEINT * y.n) AS score
        FROM cuts JOIN often x ON x.lang = cuts.lang AND x.g = one JOIN often y ON y.lang = cuts.lang AND y.g = two JOIN totals t ON t.lang = cuts.lang
    ),
    best AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, c) AS nth FROM scored),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g COLLATE "C") AS place FROM best WHERE nth = 1)
    SELECT lang, place AS rank, g AS phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE place <= 2000
    """


def oracles() -> dict[str, str]:
    return {
        "op1_arc_to_warc": OP1_SQL,
        "op5_sorted_passes": OP5_SQL,
        "op6_suffix_dedup": OP6_SQL,
        "op7_url_rules": _op7_sql(),
        "op12_line_runs": OP12_SQL,
        "op13_collocations": OP13_SQL,
    }
