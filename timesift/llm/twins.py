"""SQL twins of the corpus queries that SQL can express."""

_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '{_WORDS}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '{_WORDS}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
hits AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS listed
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS t FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP6 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         (CAST('0x' || substr(md5('17|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 13) AS BIGINT)
           + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE) AS u,
         greatest(CAST(0.05 AS DOUBLE), least(CAST(1 AS DOUBLE), coalesce(
           CAST(length(translate(text, '#$%&*|!', '')) AS DOUBLE) / nullif(length(text), 0), CAST(0.05 AS DOUBLE)))) AS weight
  FROM documents),
s AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS position FROM d GROUP BY source),
w AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, CAST(3 * source_size AS DOUBLE) AS most,
             CAST(CASE position % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight FROM s),
-- Sources in the order in which they reach their cap: the level is right where the next one does not.
o AS (SELECT *, most / weight AS reach, sum(most) OVER r - most AS held, sum(weight) OVER () - (sum(weight) OVER r - weight) AS free,
             row_number() OVER r AS n
      FROM w WINDOW r AS (ORDER BY most / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
level AS (SELECT arg_min(((SELECT sum(source_size) FROM w) - held) / free, n) AS level FROM o
          WHERE ((SELECT sum(source_size) FROM w) - held) / free <= reach),
t AS (SELECT source, source_size, least(most, coalesce(level, most) * weight) AS target FROM w, level),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
k AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY -ln(u) / weight, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
c AS (SELECT *, epochs + CASE WHEN size > 0 AND 2.0::DOUBLE * before + size < 2.0::DOUBLE * (target - epochs * source_size) THEN 1 ELSE 0 END AS copies FROM k)
SELECT doc_id, size, source_size, target, CAST(copies AS BIGINT) AS copies, CAST(copies * size AS BIGINT) AS taken FROM c
"""

OP7 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(len(w), 3) - 1), ' ') AS t
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 90 * (na.n + nb.n - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.b) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id GROUP BY d.doc_id, n.n
"""



def _lloyd(rounds: int) -> str:
    """The integer codebook rounds; every step is materialised because two later ones read it."""
    steps = ["""
WITH x AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(4096 * CAST(c AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, j, list_slice(v, j * (len(v) // 8) + 1, (j + 1) * (len(v) // 8)) AS s FROM x, range(8) AS r(j)),
c0 AS MATERIALIZED (SELECT j, e, s AS c FROM (SELECT j, s, row_number() OVER (PARTITION BY j ORDER BY vec_id) - 1 AS e FROM p) WHERE e < 16)"""]
    nearest = """
a{0} AS MATERIALIZED (
  SELECT vec_id, any_value(label) AS label, p.j, any_value(s) AS s,
         min((list_inner_product(s, s) - 2 * list_inner_product(s, c) + list_inner_product(c, c)) * 16 + e) AS best
  FROM p JOIN c{0} AS b ON p.j = b.j GROUP BY vec_id, p.j)"""
    for i in range(rounds):
        steps.append(nearest.format(i))
        steps.append(f"""
u{i} AS (SELECT j, best % 16 AS e, i, floor(sum(list_extract(s, i)) / count(*)) AS m
         FROM a{i}, LATERAL unnest(range(1, len(s) + 1)) AS t(i) GROUP BY j, best % 16, i),
c{i + 1} AS MATERIALIZED (SELECT b.j, b.e, coalesce(n.c, b.c) AS c FROM c{i} AS b
  LEFT JOIN (SELECT j, e, list(m ORDER BY i) AS c FROM u{i} GROUP BY j, e) AS n ON n.j = b.j AND n.e = b.e)""")
    steps.append(nearest.format(rounds))
    return ",".join(steps) + f"""
, rows AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', CAST(best % 16 AS INTEGER)), '' ORDER BY j) AS code,
                  CAST(sum(floor(best / 16)) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
book AS (SELECT string_agg(array_to_string(list_transform(c, lambda v: CAST(CAST(v AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY j, e) AS t FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(t) FROM book) AS codebooks_sha256
FROM rows
"""


OP12 = _lloyd(6)

TWINS = {"op4_decontaminate": OP4, "op6_mix": OP6, "op7_jaccard": OP7, "op12_codes": OP12}
