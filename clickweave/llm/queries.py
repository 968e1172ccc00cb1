"""One query per operator, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clickweave.config import new_shared_path
from clickweave.llm.collocations import collocations
from clickweave.llm.common import read_table
from clickweave.llm.compression_classifier import quality_scores
from clickweave.llm.hyperminhash import near_duplicates
from clickweave.llm.interpolation_lm import lm_scores
from clickweave.llm.license_scan import BASE, LICENSE_WORD, NOTICES, license_scan
from clickweave.llm.periodic_runs import periodic_runs, planted, run_report
from clickweave.llm.quality_rules import quality_rules
from clickweave.llm.rlz_substring import substring_dedup
from clickweave.llm.sentencepiece_scan import encode
from clickweave.llm.source_mixing import mix_report, mix_sources
from clickweave.llm.token_counts import token_counts
from clickweave.llm.trie_dedup import trie_owners
from clickweave.llm.warc import page_report, read_archives, write_archives


def piece_model(name: str = "piece_bpe_32k.model") -> bytes:
    """A tokenizer file's bytes (half a megabyte), which travel with the tasks."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read_table(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir)).drop("rid")


def op3_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir), read_table(spark, sf_dir, "labels"))


def op4_sentencepiece_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read_table(spark, sf_dir), piece_model(), digests=True)


def op5_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir)).drop("rid")


def op6_rlz_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read_table(spark, sf_dir))[0]


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir), piece_model())


def op8_interpolation_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(read_table(spark, sf_dir))


def op9_trie_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_owners(read_table(spark, sf_dir))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(mix_sources(read_table(spark, sf_dir)))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archives hold a torn copy of about every hundredth record, so that the reader has to salvage."""
    path = new_shared_path(spark, "warc")
    write_archives(read_table(spark, sf_dir, "pages"), path, torn_every=97)
    return page_report(read_archives(spark, path, payloads=False))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_report(periodic_runs(read_table(spark, sf_dir), prepare=planted))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_quality_rules, op3_compression_classifier,
                                  op4_sentencepiece_scan, op5_hyperminhash, op6_rlz_substring,
                                  op7_token_counts, op8_interpolation_lm, op9_trie_dedup,
                                  op10_source_mixing, op11_warc, op12_periodic_runs, op13_collocations)}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _license_sql() -> str:
    """Operator 1 in SQL: the same templates, each k-gram a list of words."""
    rows = ",\n".join(f"({i}, '{t.label}', {str(t.base).lower()}, {t.drift}, {t.need}, '{t.text}')" for i, t in enumerate(BASE + NOTICES))
    return f"""
WITH t(template, label, base, drift, need, phrase) AS (VALUES
{rows}),
tw AS (SELECT *, string_split(phrase, ' ') AS tw, least(3, len(string_split(phrase, ' '))) AS k FROM t),
tg AS (SELECT template, o, tw[o + 1:o + k] AS gram FROM (SELECT *, unnest(range(0, len(tw) - k + 1)) AS o FROM tw)),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '{LICENSE_WORD}') AS w FROM documents),
g AS (SELECT rid, p, w[p + 1:p + 2] AS gram FROM (SELECT *, unnest(range(0, len(w) - 1)) AS p FROM d)
      UNION ALL SELECT rid, p, w[p + 1:p + 3] FROM (SELECT *, unnest(range(0, len(w) - 2)) AS p FROM d)),
v AS (SELECT rid, template, p - o AS diagonal, list(o) AS positions, min(p) AS first FROM g JOIN tg USING (gram) GROUP BY ALL),
m AS (SELECT v.*, label, base, need, len(tw) AS length,
             sum(CASE WHEN gap <= drift THEN 0 ELSE 1 END) OVER (PARTITION BY rid, v.template ORDER BY diagonal) AS span
      FROM (SELECT *, diagonal - lag(diagonal) OVER (PARTITION BY rid, template ORDER BY diagonal) AS gap FROM v) v
      JOIN tw ON tw.template = v.template),
c AS (SELECT *, min(diagonal) OVER chain AS lo, max(diagonal) OVER chain AS hi FROM m WINDOW chain AS (PARTITION BY rid, template, span)),
x AS (SELECT *, unnest(CASE WHEN hi - lo > length THEN [(diagonal - lo) // length, (diagonal - lo) // length - 1] ELSE [0] END) AS part FROM c),
s AS (SELECT rid, label, base, need, len(list_distinct(flatten(list(positions))))::DOUBLE / greatest(1, any_value(length) - 2) AS coverage, min(first) AS first
      FROM x GROUP BY rid, template, label, base, need, span, part HAVING coverage >= need)
SELECT doc_id, len(w)::BIGINT AS n_words, count(s.rid) FILTER (base) AS n_base, min(first) FILTER (base)::BIGINT AS first_word,
       max(first) FILTER (base)::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (label IS NOT NULL)), ','), '') AS labels,
       coalesce(max(coverage), 0.0) AS score
FROM d LEFT JOIN s USING (rid) GROUP BY rid, doc_id, w"""


ORACLE: dict[str, str] = {
    "op1_license_scan": _license_sql(),
    "op5_hyperminhash": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[p:p + 3], ' ') END AS s
       FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY ALL),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * m >= 80 * (na.n + nb.n - m)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(id, c) AS (SELECT a, a FROM edge UNION SELECT edge.b, c FROM reach JOIN edge ON edge.a = id AND c < edge.b),
comp AS (SELECT id, min(c) AS c FROM reach GROUP BY ALL)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(c, d.doc_id)) AS component_id,
       d.doc_id <= coalesce(c, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN comp ON comp.id = d.doc_id""",
    "op6_rlz_substring": """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p:p + 49], ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)),
dup AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS least FROM win) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS q FROM dup),
per AS (SELECT doc_id, list(q) AS qs FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(qs), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN qs IS NULL THEN w ELSE
              [z[1] FOR z IN list_zip(w, range(1, len(w) + 1)) IF NOT list_contains(qs, z[2])] END, ' ')) AS kept_sha256
FROM d LEFT JOIN per USING (doc_id)""",
    "op9_trie_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
WINDOW same AS (PARTITION BY t)""",
    "op11_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
o AS (SELECT page_id, t, max(page_id) OVER (PARTITION BY t) AS owner,
             array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 5 * (c // 4) + 1, 5))::BIGINT >> (15 - 5 * (c % 4))) & 31), 1)
                              FOR c IN range(32)], '') AS payload_digest FROM p)
SELECT page_id, strlen(t) AS payload_bytes, payload_digest, CASE WHEN owner IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN owner IS DISTINCT FROM page_id THEN owner END AS refers_to
FROM o""",
    "op13_collocations": f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
f AS (SELECT lang, k AS words, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
      FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 5) t(k) WHERE len(w) >= k) GROUP BY ALL),
c AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE words > 1 AND f >= 30),
longer AS (SELECT lang, array_to_string(ws[i:i + k - 1], ' ') AS phrase, max(a) AS most
           FROM (SELECT *, unnest(range(1, words - k + 2)) AS i FROM c, range(2, 4) t(k) WHERE k < words) GROUP BY ALL),
cut AS (SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, ((2000000::HUGEINT * a) // (x.f + y.f))::BIGINT AS score
        FROM (SELECT c.* FROM c LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR 100 * most < 80 * a) c
        JOIN range(1, 4) t(k) ON k < c.words
        JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:k], ' ')
        JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(ws[k + 1:], ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score
FROM ranked JOIN (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE words = 1 GROUP BY lang) USING (lang) WHERE rank <= 2000""",
}
