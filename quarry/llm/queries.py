"""The package's queries over the driver tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import (
    decontaminate,
    entropy_mix,
    near_dedup,
    passages,
    periodic_runs,
    piece_codec,
    quality_gam,
    quality_rules,
    surrogates,
    token_align,
    token_orc,
    url_rules,
    warc,
)
from quarry.llm.common import materialise, prepare, table, words_column

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Files of the package of public tokenizers; each executor finds its own copy.
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


# --- 1: quality rules ------------------------------------------------------------------------
@register("op1_quality_rules", r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS w FROM documents),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS l FROM w),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM r, (VALUES (0), (1), (2)) v(j) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(array_to_string(w.w, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(l.l) - len(list_distinct(l.l)) AS BIGINT) AS n_dup_lines, CAST(len(l.l) AS BIGINT) AS n_lines,
        CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
        CAST(length(regexp_replace(t, '\P{Lu}', '', 'g')) AS BIGINT) AS n_upper
      FROM w JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)),
b AS (SELECT *, CAST((CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
        + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN 100 * n_dup_lines > 60 * n_lines THEN 8 ELSE 0 END)
        + (CASE WHEN 100 * n_upper > 40 * word_chars THEN 16 ELSE 0 END) + (CASE WHEN word_chars < 2 * n_words THEN 32 ELSE 0 END)
        + (CASE WHEN word_chars > 20 * n_words THEN 64 ELSE 0 END) AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
       fail_bits = 0 AS kept, fail_bits FROM b
""")
def _quality_rules(s: SparkSession, d: str) -> DataFrame:
    led = quality_rules.ledger(table(s, d, "documents"))
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality_rules.passes(quality_rules.BASE)).alias("base_failed"),
        quality_rules.passes(quality_rules.DEFAULT).alias("kept"), "fail_bits")


# --- 2: benchmark decontamination ------------------------------------------------------------
_SQL_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@register("op2_decontaminate", rf"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_SQL_AZ}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS g FROM (
    SELECT item, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, regexp_extract_all({_SQL_AZ}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dg AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS g FROM (
    SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM win))),
h AS (SELECT doc_id, item, i, size FROM dg JOIN win USING (size, g)),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t.s, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
""")
def _decontaminate(s: SparkSession, d: str) -> DataFrame:
    return decontaminate.report(table(s, d, "documents"), table(s, d, "benchmark"))


# --- 3: token ids in ORC ---------------------------------------------------------------------
@register("op3_token_orc")
def _token_orc(s: SparkSession, d: str) -> DataFrame:
    return token_orc.write_and_index(table(s, d, "documents"), BYTE_BPE, 2)


# --- 4: near duplicates ----------------------------------------------------------------------
@register("op4_near_dedup", r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+') AS w
           FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(3, len(w)) - 1], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * common >= 85 * (x.n + y.n - common)),
s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT s.b, r.c FROM r JOIN s ON r.d = s.a),
m AS (SELECT d AS doc_id, min(c) AS component_id FROM r GROUP BY d)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
""")
def _near_dedup(s: SparkSession, d: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(s, d, "documents"), 3, 85)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


# --- 5: quality classifier --------------------------------------------------------------------
@register("op5_quality_gam")
def _quality_gam(s: SparkSession, d: str) -> DataFrame:
    docs, fold = table(s, d, "documents").select("doc_id", "text"), F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    model = quality_gam.train(docs, table(s, d, "labels").where(fold != 0))
    return quality_gam.score(docs, model).select(
        "doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


# --- 6: URL rules ----------------------------------------------------------------------------
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@register("op6_url_rules", """
WITH r(rh, rp, verdict) AS (VALUES """ + ", ".join(str(x) for x in URL_RULES) + """),
p AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS t FROM pages),
q AS (SELECT page_id, translate(regexp_extract(t, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(t, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
m AS (SELECT page_id, arg_max(rh || rp, length(rh || rp) * 10000 + length(rh)) AS rule, arg_max(verdict, length(rh || rp) * 10000 + length(rh)) AS verdict
      FROM q JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT q.page_id, host, path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM q LEFT JOIN m USING (page_id)
""")
def _url_rules(s: SparkSession, d: str) -> DataFrame:
    rules = s.sql("SELECT * FROM VALUES " + ", ".join(str(x) for x in URL_RULES) + " AS t(host, path, verdict)")
    return url_rules.judge(table(s, d, "pages").select("page_id", "url"), rules).drop("url")


# --- 7: SentencePiece -------------------------------------------------------------------------
@register("op7_sentencepiece")
def _sentencepiece(s: SparkSession, d: str) -> DataFrame:
    found = piece_codec.encode(table(s, d, "documents").select("doc_id", "text"), PIECE_BPE)
    return found.select("doc_id", "n_tokens", "ids_crc32", "round_trip")


# --- 8: repeated passages ---------------------------------------------------------------------
@register("op8_passages")
def _passages(s: SparkSession, d: str) -> DataFrame:
    return passages.repeated_passages(table(s, d, "documents"))


# --- 9: personal data -------------------------------------------------------------------------
#: The queries' key; a user passes a secret of their own.
SURROGATE_KEY = b"key of the registered queries"


@register("op9_surrogates")
def _surrogates(s: SparkSession, d: str) -> DataFrame:
    return surrogates.replace_entities(table(s, d, "documents").select("doc_id", "text"), SURROGATE_KEY, counts=True)


# --- 10: WARC --------------------------------------------------------------------------------
@register("op10_warc", """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS payload_digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to FROM m
""")
def _warc(s: SparkSession, d: str) -> DataFrame:
    return warc.archive(table(s, d, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# --- 11: cross-tokenizer alignment ------------------------------------------------------------
@register("op11_token_align")
def _token_align(s: SparkSession, d: str) -> DataFrame:
    found = token_align.add_alignment(table(s, d, "documents"), BYTE_BPE, PIECE_BPE, keep=["doc_id"])
    sha = F.when(F.col("groups") != "", F.sha2("groups", 256)).otherwise("")
    rows = materialise(found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", "n_groups", "n_links",
                                    sha.alias("groups_sha256"), "links"), "aligned")
    scores = token_align.score(rows, materialise(token_align.link_counts(rows), "link-counts"), "row")
    none = F.lit(0).cast("long")
    return rows.drop("links").join(scores, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"),
        F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256")


# --- 12: periodic runs -----------------------------------------------------------------------
@register("op12_periodic_runs", r"""
WITH step AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_concat([CAST(i AS BIGINT)], range(8)),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
o AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS w,
        xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
            lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)])), 4294967295) AS h FROM documents, step),
a AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM o),
d AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS w
      FROM (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a)),
u AS (SELECT doc_id, n, unnest(w) AS x, unnest(range(n)) AS i FROM d),
e AS (SELECT doc_id, s.i, t.i - s.i AS q FROM u s JOIN u t USING (doc_id, x) WHERE t.i > s.i AND 4 * (t.i - s.i) <= s.n),
l AS (SELECT doc_id, q, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k, i FROM e),
r AS (SELECT doc_id, start, length, min(q) AS period
      FROM (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM l GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(6, 4 * q))
      GROUP BY doc_id, start, length),
x AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs,
        list({'s': start, 'l': length, 'p': period} ORDER BY CAST(length * 1000000000000000 // period AS HUGEINT) DESC, start, period)[1] AS best FROM r GROUP BY doc_id),
g AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
c AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM u ANTI JOIN g USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.s AS BIGINT) AS start, CAST(best.l AS BIGINT) AS length,
       CAST(best.p AS BIGINT) AS period, CAST(1000 * best.l // best.p AS BIGINT) AS exponent_milli,
       sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN x USING (doc_id) LEFT JOIN c USING (doc_id)
""")
def _periodic_runs(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select("doc_id", "text")
    # every tenth document is made periodic from a word of its own on
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = docs.withColumn("text", F.when(h % 10 == 0, _planted(words_column(F.col("text")), F.floor(h / 10))).otherwise(F.col("text")))
    found = periodic_runs.add_runs(docs)
    line = F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n")))
    best = F.col("strongest")
    return found.select(
        "doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), best.start.alias("start"), best.length.alias("length"),
        best.period.alias("period"), F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def _planted(words, g):
    """The words joined by spaces, from word ``a = g % n`` on repeating the first of them with period 1 + (n - a) // (3 + g % 8)."""
    n = F.nullif(F.size(words), F.lit(0)).cast("long")
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
    one = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    again = F.slice(F.flatten(F.array_repeat(one, F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
    return F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), again), " ")


# --- 13: mixing sources -----------------------------------------------------------------------
@register("op13_entropy_mix")
def _entropy_mix(s: SparkSession, d: str) -> DataFrame:
    found = entropy_mix.plan(table(s, d, "documents"), (5, 2, 1), 3)
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "copies", "rate")


def queries() -> dict[str, Query]:
    def prepared(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)
        return run
    return {k: prepared(f) for k, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
