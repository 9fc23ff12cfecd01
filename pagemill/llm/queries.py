"""The operators of this subpackage bound to the given tables, with check SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagemill.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from pagemill.llm.token_counts import token_counts

    return token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op2_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    from pagemill.llm.personal import personal_data

    return personal_data(table(spark, folder, "documents"))


@query
def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    from pagemill.llm.quality import score_quality

    return score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op5_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    from pagemill.llm.mixing import mix_sources

    return mix_sources(table(spark, folder, "documents"), tell_shards=True)


@query
def op6_curve_shards(spark: SparkSession, folder: str) -> DataFrame:
    from pagemill.llm.curve_shards import curve_shards

    return curve_shards(table(spark, folder, "documents"))


@query
def op10_phrase_index(spark: SparkSession, folder: str) -> DataFrame:
    from pagemill.llm.phrase_index import contamination

    return contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


ORACLES["op10_phrase_index"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS t
  FROM documents),
i AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS t
  FROM benchmark),
w AS (
  SELECT DISTINCT item, least(len(t), 13) AS n, array_to_string(t[s : s + 12], ' ') AS win
  FROM (SELECT item, t, unnest(generate_series(1, greatest(len(t) - 12, 1))) AS s FROM i WHERE len(t) > 0)),
p AS (
  SELECT r, s, n, array_to_string(t[s : s + n - 1], ' ') AS win
  FROM (SELECT r, t, unnest(generate_series(1, len(t))) AS s FROM d), (SELECT DISTINCT n FROM w) WHERE s + n - 1 <= len(t)),
m AS (SELECT r, item, s, p.n FROM p JOIN w USING (n, win)),
sg AS (
  SELECT DISTINCT item, list_sort(list_distinct(t[s : s + 12])) AS seg
  FROM (SELECT item, t, unnest(list_distinct(generate_series(1, greatest(len(t) - 12, 1), 13) || [greatest(len(t) - 12, 1)])) AS s FROM i WHERE len(t) > 0)),
st AS (SELECT row_number() OVER () AS sid, item, seg, CAST(ceil(round(0.8 * len(seg), 9)) AS INT) AS need FROM sg),
su AS (SELECT sid, need, unnest(seg) AS term FROM st),
dw AS (SELECT r, unnest(generate_series(1, len(t))) AS pos, unnest(t) AS term FROM d),
q AS (SELECT r, sid FROM (SELECT DISTINCT r, term FROM dw) JOIN su USING (term) GROUP BY r, sid, need HAVING count(*) >= need),
v AS (
  SELECT r, sid, need, count(DISTINCT term) OVER (PARTITION BY r, sid ORDER BY pos RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS n_in
  FROM q JOIN su USING (sid) JOIN dw USING (r, term)),
z AS (SELECT r, count(DISTINCT item) AS n_near FROM v JOIN st USING (sid) WHERE n_in >= v.need GROUP BY r),
h AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(generate_series(s, s + n - 1)) AS pos FROM m) GROUP BY r),
g AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY r)
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(t) AS contaminated,
  CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN h USING (r) LEFT JOIN g USING (r) LEFT JOIN z USING (r)"""


@query
def op9_near_copies(spark: SparkSession, folder: str) -> DataFrame:
    from pagemill.llm.near_copies import near_copies

    return near_copies(table(spark, folder, "documents"), width=4, similarity=(80, 100))


ORACLES["op9_near_copies"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS t
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(t) >= 4 THEN list_distinct(list_transform(generate_series(1, len(t) - 3), lambda i: array_to_string(t[i : i + 3], ' ')))
    WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END AS g
  FROM d),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
p AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p),
r AS (SELECT doc_id AS node, doc_id AS root FROM d UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.node WHERE r.root < e.v)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM s JOIN (SELECT node, min(root) AS component_id FROM r GROUP BY node) ON node = doc_id"""


@query
def op3_repeated_words(spark: SparkSession, folder: str) -> DataFrame:
    from pagemill.llm.automata import repeated_words

    return repeated_words(table(spark, folder, "documents"), window=13)


@query
def op8_repeated_bytes(spark: SparkSession, folder: str) -> DataFrame:
    from pagemill.llm.suffix_arrays import repeated_bytes

    return repeated_bytes(table(spark, folder, "documents"), window=50)


ORACLES["op3_repeated_words"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS t FROM documents),
p AS (SELECT r, doc_id, s, array_to_string(t[s : s + 12], ' ') AS win FROM (SELECT r, doc_id, t, unnest(generate_series(1, len(t) - 12)) AS s FROM d WHERE len(t) > 12)),
f AS (SELECT win, min(doc_id) AS first FROM p GROUP BY win),
x AS (SELECT DISTINCT r, unnest(generate_series(s, s + 12)) AS pos FROM p JOIN f USING (win) WHERE first < doc_id),
g AS (SELECT r, list(pos) AS gone FROM x GROUP BY r),
w AS (SELECT r, pos, t[pos] AS word FROM (SELECT r, t, unnest(generate_series(1, len(t))) AS pos FROM d)),
k AS (SELECT r, string_agg(word, ' ' ORDER BY pos) AS kept FROM w ANTI JOIN x USING (r, pos) GROUP BY r)
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (r) LEFT JOIN k USING (r)"""


@query
def op4_curve_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    from pagemill.llm.curve_neighbours import nearest

    return nearest(table(spark, folder, "embeddings"))


@query
def op11_spelling_groups(spark: SparkSession, folder: str) -> DataFrame:
    from pagemill.llm.spellings import spelling_groups

    return spelling_groups(table(spark, folder, "documents"))


# crc32 byte by byte over a table that the polynomial gives; pairs through the words with one letter left out
ORACLES["op11_spelling_groups"] = r"""
WITH RECURSIVE poly AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, generate_series(1, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY doc_id, run),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
      list_transform(generate_series(1, CAST(length(x) AS BIGINT), 2), lambda p: CAST(instr('0123456789ABCDEF', x[p]) * 16 + instr('0123456789ABCDEF', x[p + 1]) - 17 AS BIGINT))),
    lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) AS INTEGER) + 1])), 4294967295) AS h
  FROM (SELECT run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs), poly),
cut AS (SELECT CASE WHEN h % 31 = 0 THEN substring(run, 1, CAST(h % length(run) AS INTEGER)) || substring(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, n FROM hashed),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
e AS (SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest FROM (SELECT word, n, CAST(unnest(generate_series(1, length(word))) AS INTEGER) AS i FROM v)),
p AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM e a JOIN e b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT e.word, e.n, v.word, v.n FROM e JOIN v ON e.rest = v.word
  UNION SELECT v.word, v.n, e.word, e.n FROM e JOIN v ON e.rest = v.word),
g AS (SELECT word, n, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM p GROUP BY word, n),
f AS (SELECT word, near AS form, near_n AS form_n FROM g WHERE near_n >= 10 * n),
r AS (SELECT word, form AS root, 1 AS step FROM f UNION ALL SELECT r.word, f.form, step + 1 FROM r JOIN f ON f.word = r.root),
z AS (SELECT word, last(root ORDER BY step) AS root FROM r GROUP BY word)
SELECT v.word, form, coalesce(root, v.word) AS root, v.n, coalesce(n_near, 0) AS n_near, form_n
FROM v LEFT JOIN g USING (word) LEFT JOIN f USING (word) LEFT JOIN z USING (word)"""


@query
def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    from pagemill.llm.collocations import collocations

    return collocations(table(spark, folder, "documents"))


ORACLES["op12_collocations"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang,
    string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS s FROM documents),
p AS (SELECT r, lang, unnest(s) AS piece FROM d),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS t FROM p),
g AS (
  SELECT lang, k, array_to_string(t[i : i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, t, unnest(generate_series(1, len(t))) AS i FROM w), (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(t) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS t FROM g WHERE k > 1 AND f >= 10),
x AS (SELECT lang, phrase, a, k, array_to_string(t[1 : cut], ' ') AS head, array_to_string(t[cut + 1 : k], ' ') AS rest, cut FROM c, (SELECT unnest([1, 2]) AS cut) WHERE cut < k),
y AS (
  SELECT x.lang, x.phrase, a, h.f AS l, q.f AS r, CAST(1000000 * CAST(a AS HUGEINT) * a // (CAST(h.f AS HUGEINT) * q.f) AS BIGINT) AS score, cut
  FROM x JOIN g h ON h.lang = x.lang AND h.phrase = head JOIN g q ON q.lang = x.lang AND q.phrase = rest),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS best FROM y),
o AS (
  SELECT c.lang, u.phrase, max(c.a) AS longer FROM c, LATERAL (SELECT unnest([array_to_string(t[1:2], ' '), array_to_string(t[2:3], ' ')]) AS phrase) u WHERE k = 3 GROUP BY c.lang, u.phrase),
s AS (
  SELECT z.lang, z.phrase, a, l, r, score FROM z LEFT JOIN o ON o.lang = z.lang AND o.phrase = z.phrase
  WHERE best = 1 AND (longer IS NULL OR 100 * longer < 50 * a)),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM s)
SELECT lang, CAST(rank AS INTEGER) AS rank, phrase, a, l, r, n, score FROM k JOIN n USING (lang) WHERE rank <= 2000"""


@query
def op13_norm_search(spark: SparkSession, folder: str) -> DataFrame:
    from pagemill.llm.norm_search import top_products

    return top_products(table(spark, folder, "embeddings"))


ORACLES["op13_norm_search"] = r"""
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.id AS query_id, b.id AS vec_id, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score FROM v a JOIN v b ON a.id % 20 = 0 AND a.id <> b.id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""
