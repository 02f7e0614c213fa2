"""The registered queries of the corpus operators, one for each, with their production parameters."""

from __future__ import annotations

import public_tokenizers

from precinct.llm.brown import score_texts
from precinct.llm.common import docs_text, table
from precinct.llm.decontaminate import contamination
from precinct.llm.encode import read_id_files, write_id_files
from precinct.llm.extract import extract
from precinct.llm.lines import dedup_lines
from precinct.llm.media import documents_as_media
from precinct.llm.ngrams import jaccard_components
from precinct.llm.packing import pack
from precinct.llm.periods import periodic_runs, with_digests, with_planted_runs
from precinct.llm.substrings import dedup_substrings
from precinct.llm.toxicity import score_toxicity
from precinct.llm.trie import numbered_turns, prefix_trie, with_shared_starts
from precinct.llm.urls import judge_urls


def op1_toxicity(spark, sf_dir):
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_media_columns(spark, sf_dir):
    return documents_as_media(table(spark, sf_dir, "documents")).drop("digest")


def op3_ngram_join(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark, sf_dir):
    return dedup_substrings(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark, sf_dir):
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "removed")


def op6_url_filter(spark, sf_dir):
    return judge_urls(table(spark, sf_dir, "pages"))


#: The vocabulary file, and the id that ends a document.
VOCABULARY, END_ID = "word_bpe_49k.json", 2


def op7_token_ids(spark, sf_dir):
    files, ranks = write_id_files(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), END_ID)
    return read_id_files(files, ranks).drop("ids")


def op8_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark, sf_dir):
    return score_texts(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans", "matches")


def op11_periodic_runs(spark, sf_dir):
    return with_digests(periodic_runs(with_planted_runs(docs_text(table(spark, sf_dir, "documents")))))


def op12_html_extraction(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))


def op13_prefix_trie(spark, sf_dir):
    return prefix_trie(*with_shared_starts(numbered_turns(table(spark, sf_dir, "conversations"))))


QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_media_columns, op3_ngram_join, op4_substring_dedup, op5_line_dedup,
    op6_url_filter, op7_token_ids, op8_packing, op9_lm_scoring, op10_decontaminate,
    op11_periodic_runs, op12_html_extraction, op13_prefix_trie,
)}

#: DuckDB has no suffix arrays; this says which words a window covers by joining windows as text.
_DECONTAMINATE = r"""
WITH words AS (
  SELECT 'd' AS kind, CAST(doc_id AS VARCHAR) AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', CAST(item_id AS VARCHAR), NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), item AS (
  SELECT id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS win
  FROM (SELECT id, w, least(len(w), 10) AS n FROM words WHERE kind = 'b' AND len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM item
), windows AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS win
  FROM words, sizes WHERE kind = 'd' AND len(w) >= n
), hits AS (SELECT DISTINCT x.doc_id, x.n, x.i, item.id FROM windows x JOIN item ON x.win = item.win AND x.n = item.n
), n_hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, id FROM hits) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN n_hit ON w.doc_id = n_hit.doc_id LEFT JOIN items ON w.doc_id = items.doc_id WHERE kind = 'd'
"""

#: All pairs that share a shingle, as text; components by reaching from every document.
_NGRAMS = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS sh FROM (SELECT doc_id, w, least(len(w), 5) AS n FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), c AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.node WHERE c.root < e.b)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(c.root) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.node = d.doc_id GROUP BY d.doc_id
"""

#: crc32 of x's decimal digits, from a table made by rule.
_CRC = """(SELECT xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST({x} AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
  lambda c, ch: xor(c // 256, t[1 + CAST(xor(c, ch) & 255 AS INTEGER)])), 4294967295)
  FROM (SELECT list_transform(range(256), lambda k: list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c // 2, 3988292384 * (c % 2)))) AS t))"""

#: Stretches of words that equal the word q places on, from all pairs of equal words of a text up to a quarter of it apart.
_PERIODS = r"""
WITH d AS (SELECT doc_id, h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM (SELECT doc_id, text, CRC AS h FROM documents)
), a AS (SELECT *, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d
), p AS (SELECT *, 1 + (len(w) - a) // (3 + (h // 10) % 8) AS p FROM a
), t AS (SELECT row_number() OVER () AS r, doc_id, CASE WHEN a IS NULL THEN w ELSE list_transform(range(len(w)), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) END AS w FROM p
), x AS (SELECT r, len(w) AS n, unnest(range(len(w))) AS i, unnest(w) AS word FROM t
), y AS (SELECT r, n, i, list(i) OVER (PARTITION BY r, word ORDER BY i RANGE BETWEEN 1 FOLLOWING AND n // 4 FOLLOWING) AS later FROM x
), m AS (SELECT r, i, unnest(later) - i AS q FROM y
), g AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM m
), s AS (SELECT r, q, min(i) AS s, count(*) + q AS l FROM g GROUP BY r, q, island HAVING count(*) + q >= greatest(6, 4 * q)
), u AS (SELECT r, s, l, min(q) AS q FROM s GROUP BY ALL
), b AS (SELECT r, count(*) AS n_runs, arg_min(struct_pack(s := s, l := l, q := q), (-l, s, q)) AS best, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM u GROUP BY r
), gone AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM u
), kept AS (SELECT x.r, string_agg(word, ' ' ORDER BY x.i) AS text FROM x ANTI JOIN gone ON x.r = gone.r AND x.i = gone.i GROUP BY x.r)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, best.s AS start, best.l AS length, best.q AS period, CAST(1000 * best.l // best.q AS BIGINT) AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM t LEFT JOIN b ON t.r = b.r LEFT JOIN kept ON t.r = kept.r
""".replace("CRC", _CRC.format(x="doc_id"))

#: The given pages have one article each, of headings and paragraphs, and few named references.
_EXTRACT = r"""
WITH a AS (SELECT page_id, url, replace(regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's'), '<br>', ' ') AS x FROM pages
), b AS (SELECT page_id, url, list_transform(regexp_split_to_array(x, '</?(p|h1)>'), lambda s: trim(regexp_replace(
    replace(replace(replace(replace(regexp_replace(s, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))) AS p FROM a
), t AS (SELECT page_id, url, array_to_string(list_filter(p, lambda s: s <> ''), chr(10) || chr(10)) AS text FROM b)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t
"""

#: Every sequence of first turns, and every node's contribution to all nodes above it.
_TRIE = r"""
WITH o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, unhex(sha256(length(role) || ':' || role || text))) - 1 AS pos, role, text
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), l AS (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY pos) AS turns FROM o GROUP BY conv_id
), c AS (SELECT l.conv_id, list_concat(list_slice(b.turns, 1, CRC % 4), list_slice(l.turns, CRC % 4 + 1, len(l.turns))) AS s FROM l LEFT JOIN l b ON b.conv_id = l.conv_id - l.conv_id % 20
), m AS (SELECT conv_id, len(s) = d AS ends, d, list_slice(s, 1, d) AS path FROM (SELECT conv_id, coalesce(s, []) AS s, unnest(range(len(coalesce(s, [])) + 1)) AS d FROM c)
), n AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends FROM m GROUP BY path, d
), k AS (SELECT list_slice(path, 1, d - 1) AS path, d - 1 AS d, count(*) AS k FROM n WHERE d > 0 GROUP BY ALL
), v AS (SELECT n.*, coalesce(k, 0) AS k, CASE WHEN n.d = 0 THEN 0 ELSE (n - 1) * len(regexp_extract_all(n.path[n.d].text, '[^\x20\x09-\x0D]+')) END AS saved FROM n LEFT JOIN k ON n.d = k.d AND n.path = k.path
), z AS (SELECT list_slice(path, 1, e) AS path, e AS d, sum(saved) AS saved, sum(CAST(k = 0 AS BIGINT)) AS leaves FROM (SELECT *, unnest(range(d + 1)) AS e FROM v) GROUP BY ALL)
SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(v.n AS BIGINT) AS n_convs, CAST(v.k AS BIGINT) AS n_children, CAST(z.leaves AS BIGINT) AS n_leaves,
  CAST(z.saved AS BIGINT) AS saved_tokens, v.ends AS ends_sha256
FROM v JOIN z ON v.d = z.d AND v.path = z.path LEFT JOIN n p ON p.d = v.d - 1 AND p.path = list_slice(v.path, 1, v.d - 1)
""".replace("CRC", _CRC.format(x="l.conv_id"))

ORACLE = {
    "op3_ngram_join": _NGRAMS, "op10_decontaminate": _DECONTAMINATE,
    "op11_periodic_runs": _PERIODS, "op12_html_extraction": _EXTRACT, "op13_prefix_trie": _TRIE,
}
