"""One whole-table query per operator, with a DuckDB twin where SQL can express the result.

Each callable takes (spark, sf_dir) and returns the digest columns of its contract; the operators themselves
(texts, spans, shards, sequences) are in the modules named after them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from capindex.llm.chat import chat_report
from capindex.llm.collocations import LEAST, TOP, phrase_report
from capindex.llm.common import UPPER, table
from capindex.llm.decontaminate import contamination_report
from capindex.llm.htmlextract import extraction_report
from capindex.llm.jaccard import jaccard_report
from capindex.llm.langid import language_report
from capindex.llm.linededup import line_report
from capindex.llm.packing import packing_report
from capindex.llm.periodic import run_report
from capindex.llm.pii import pii_report
from capindex.llm.quality import quality_report
from capindex.llm.sharding import SHARD_BYTES, shard
from capindex.llm.urlfilter import DAMPING, HIDDEN, LINK, RULES, SCALE, SMALLEST, THRESHOLD, url_report

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, if there is one, its SQL twin."""

    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


@query("op1_pii")
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(table(spark, sf_dir, "documents"))


@query("op2_quality")
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))


@query("op4_decontamination", f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'),
                                             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'),
                                         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, w[p:p + least(10, len(w)) - 1] AS win
        FROM i, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS t(p) WHERE len(w) > 0),
spot AS (SELECT doc_id, p, k, w[p:p + k - 1] AS win
       FROM d, (SELECT DISTINCT k FROM win) AS lens, unnest(range(1, len(w) - k + 2)) AS t(p)),
hit AS (SELECT DISTINCT spot.doc_id, spot.p, spot.k, win.item_id FROM spot JOIN win ON spot.win = win.win),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""")
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_chat", r"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(text) + len(regexp_extract_all(text, '[<\[]\\*(/?s>|/?INST|/?ANS|\|)')) AS escaped FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(3 + sum(escaped + CASE WHEN role = 'assistant' THEN 21 ELSE 16 + length(role) END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""")
def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_report(table(spark, sf_dir, "conversations"))


@query("op3_sharding", f"""
WITH r AS (SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes,
                  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
n AS (SELECT d, h >> (60 - d) AS p, sum(n_bytes) AS b FROM r, range(0, 41) AS t(d) GROUP BY d, h >> (60 - d)),
s AS (SELECT doc_id, n_bytes, min({{'d': CAST(d AS INTEGER), 'p': p, 'b': b}}) AS s
      FROM r JOIN n ON n.p = r.h >> (60 - n.d) WHERE b <= {SHARD_BYTES} GROUP BY doc_id, n_bytes)
SELECT doc_id, n_bytes, CASE WHEN s.d = 0 THEN '' ELSE to_base(s.p, 2, s.d) END AS shard, s.d AS depth,
       CAST(s.b AS BIGINT) AS shard_bytes FROM s
""")
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


@query("op6_jaccard", f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'),
                                                       '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, w[p:p + least(5, len(w)) - 1] AS g FROM w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS t(p)
      WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM g AS a JOIN g AS b ON a.g = b.g AND a.doc_id <> b.doc_id
          JOIN n AS na ON na.doc_id = a.doc_id JOIN n AS nb ON nb.doc_id = b.doc_id
          GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) USING (doc_id)
""")
def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_report(table(spark, sf_dir, "documents"))


@query("op9_packing")
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_report(table(spark, sf_dir, "documents"))


@query("op8_linededup")
def op8_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


@query("op5_langid")
def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(table(spark, sf_dir, "documents"))


@query("op10_html")
def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction_report(table(spark, sf_dir, "pages"))


@query("op11_collocations", f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'),
                                                   '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
f AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k, count(*) AS a
      FROM w, (SELECT unnest(range(1, 5)) AS k) AS lens, unnest(range(1, len(w) - k + 2)) AS t(i) GROUP BY ALL HAVING count(*) >= {LEAST}),
cut AS (SELECT f.lang, f.phrase, f.k AS len, f.a, j, array_to_string(string_split(phrase, ' ')[1:j], ' ') AS first,
               array_to_string(string_split(phrase, ' ')[j + 1:], ' ') AS rest FROM f, unnest(range(1, f.k)) AS t(j)),
s AS (SELECT cut.lang, cut.phrase, cut.len, cut.a, min({{'score': CAST((2000000::HUGEINT * cut.a) // (x.a + y.a) AS BIGINT), 'j': j, 'l': x.a, 'r': y.a}}) AS s
      FROM cut JOIN f AS x ON x.lang = cut.lang AND x.phrase = cut.first JOIN f AS y ON y.lang = cut.lang AND y.phrase = cut.rest GROUP BY ALL),
inside AS (SELECT lang, array_to_string(string_split(phrase, ' ')[i:i + m - 1], ' ') AS phrase, max(a) AS longest
           FROM f, (SELECT unnest([2, 3]) AS m) AS lens, unnest(range(1, f.k - m + 2)) AS t(i) WHERE f.k > m GROUP BY ALL),
top AS (SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY s.s.score DESC, s.a DESC, encode(s.phrase)) AS rank, s.phrase, s.a, s.s.l AS l, s.s.r AS r, n.n, s.s.score AS score
        FROM s JOIN n USING (lang) LEFT JOIN inside USING (lang, phrase) WHERE longest IS NULL OR 100::HUGEINT * longest < 80::HUGEINT * s.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM top WHERE rank <= {TOP}
""")
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_report(table(spark, sf_dir, "documents"))


@query("op12_periodic", f"""
WITH c AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS v,
                  xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                      lambda s, b: list_reduce(list_concat([xor(s, b)], range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) AS h FROM documents),
g AS (SELECT *, len(v) AS n, h // 10 AS g FROM c),
p AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a, 1 + (n - g % n) // (3 + g % 8) AS p FROM g),
d AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN v ELSE list_transform(range(0, n), lambda i: v[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS w FROM p),
m AS (SELECT doc_id, q, list_concat([0], list_filter(range(1, n - q + 1), lambda i: w[i] <> w[i + q]), [n - q + 1]) AS m FROM d, unnest(range(1, n // 4 + 1)) AS t(q)),
s AS (SELECT doc_id, q, m[i] AS start, m[i + 1] - m[i] - 1 + q AS length
      FROM (SELECT doc_id, q, m, unnest(list_filter(range(1, len(m)), lambda i: m[i + 1] - m[i] - 1 + q >= greatest(6, 4 * q))) AS i FROM m)),
r AS (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY ALL),
best AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs,
                first({{'start': start, 'length': length, 'period': period}} ORDER BY length / period DESC, start, period) AS b FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS collapsed
         FROM (SELECT doc_id, unnest(w) AS word, unnest(range(0, n)) AS i FROM d) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, b.start AS start, b.length AS length, b.period AS period, (1000 * b.length) // b.period AS exponent_milli,
       sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
""")
def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_report(table(spark, sf_dir, "documents"))


@query("op13_urlfilter", f"""
WITH RECURSIVE rules AS (SELECT * FROM (VALUES {', '.join(map(str, RULES))}) AS t(verdict, site, start)),
u AS (SELECT page_id, html, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest FROM pages),
p AS (SELECT page_id, html, translate(regexp_extract(rest, '(?s)^[^/?#]*', 0), '{UPPER}', '{UPPER.lower()}') AS host,
             regexp_extract(rest, '(?s)^[^/?#]*(/[^?#]*)', 1) AS path FROM u),
r AS (SELECT page_id, html, host, path,
             (SELECT first({{'rule': site || start, 'verdict': verdict}} ORDER BY length(site || start) DESC) FROM rules
              WHERE (host = site OR ends_with(host, '.' || site)) AND starts_with(path, start)) AS r FROM p),
hosts AS (SELECT host, (count(*) FILTER (r.verdict = 'allow') * {SCALE}) // count(*) AS good,
                 (count(*) FILTER (r.verdict = 'block') * {SCALE}) // count(*) AS bad FROM r WHERE host <> '' GROUP BY host),
links AS (SELECT DISTINCT host AS src, translate(regexp_replace(x, '^([A-Za-z]*:)?//', ''), '{UPPER}', '{UPPER.lower()}') AS dst
          FROM (SELECT host, unnest(regexp_extract_all(regexp_replace(coalesce(html, ''), '{HIDDEN}', ' ', 'g'), '{LINK}', 1)) AS x
                FROM r WHERE host <> '')),
e AS (SELECT 'trust' AS kind, src, dst FROM links WHERE src <> dst UNION ALL SELECT 'distrust', dst, src FROM links WHERE src <> dst),
w AS (SELECT *, count(*) OVER (PARTITION BY kind, src) AS degree FROM e),
steps AS (SELECT 0 AS step, kind, host, CAST(score AS BIGINT) AS score
          FROM (SELECT 'trust' AS kind, host, good AS score FROM hosts UNION ALL SELECT 'distrust', host, bad FROM hosts) WHERE score > 0
          UNION ALL
          SELECT step + 1, steps.kind, w.dst, CAST(sum(((score // degree) * {DAMPING}) // 100) AS BIGINT)
          FROM steps JOIN w ON w.kind = steps.kind AND w.src = steps.host GROUP BY step, steps.kind, w.dst
          HAVING sum(((score // degree) * {DAMPING}) // 100) >= {SMALLEST}),
s AS (SELECT host, coalesce(sum(score) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(score) FILTER (kind = 'distrust'), 0) AS distrust
      FROM steps GROUP BY host)
SELECT page_id, r.host, path, r.r.rule AS rule,
       coalesce(r.r.verdict, CASE WHEN distrust > trust AND distrust > {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict
FROM r LEFT JOIN s USING (host)
""")
def op13_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_report(table(spark, sf_dir, "pages"))
