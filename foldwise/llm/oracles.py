"""DuckDB SQL for the queries that SQL can express, over the same tables."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRING_DEDUP = rf"""
WITH docs AS (SELECT doc_id, {WORDS} AS ws FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS i FROM docs WHERE len(ws) >= 20),
wins AS (SELECT s.doc_id, i, list_slice(ws, i, i + 19) AS k FROM starts s JOIN docs USING (doc_id)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM wins)
          WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM later),
places AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS j, unnest(ws) AS word FROM docs),
kept AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY j) AS t, count(*) AS n
         FROM places p ANTI JOIN gone g USING (doc_id, j) GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

NGRAM_JACCARD = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
lists AS (
  SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3),
                                                           lambda i: list_slice(ws, i, i + 4)))
                      WHEN len(ws) > 0 THEN [ws] ELSE [] END AS sh FROM docs),
sets AS (SELECT doc_id, len(sh) AS n FROM lists),
sh AS (SELECT doc_id, hash(unnest(sh)) AS s FROM lists),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id
          GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN sets p ON p.doc_id = x JOIN sets q ON q.doc_id = y
          WHERE 100 * c >= 80 * (p.n + q.n - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(node, met) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.node, e.y FROM reach r JOIN edges e ON r.met = e.x)
SELECT s.doc_id, CAST(n AS BIGINT) AS n_shingles, min(met) AS component_id
FROM sets s JOIN reach r ON r.node = s.doc_id GROUP BY s.doc_id, n
"""

SOURCE_MIX = rf"""
WITH d AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE
                WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM s),
o AS (SELECT 2 * source_size / weight AS stop,
             sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST) - 2 * source_size AS full_before,
             sum(weight) OVER (ORDER BY 2 * source_size / weight DESC, source DESC NULLS FIRST) AS open_weight FROM w),
l AS (SELECT arg_min((t - full_before) / open_weight, stop) AS level FROM o, (SELECT 1.5::DOUBLE * sum(size) AS t FROM d)
      WHERE (t - full_before) / open_weight < stop),
g AS (SELECT source, source_size, least(weight * coalesce(level, 0), CAST(2 * source_size AS DOUBLE)) AS target
      FROM w, l),
p AS (SELECT doc_id, size, g.*, least(CAST(floor(target + 0.5) AS BIGINT), 2 * source_size) AS words,
             CAST(sum(size) OVER (PARTITION BY g.source ORDER BY md5('12:' || coalesce(CAST(doc_id AS VARCHAR), '')),
                                  doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS off
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CASE WHEN size = 0 THEN 0 ELSE
       words // source_size * size + greatest(0, least(off + size, words % source_size) - off) END AS taken FROM p
"""

FILTER_AUDIT = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {WORDS} AS ws FROM documents),
lab AS (SELECT doc_id, coalesce(max(CASE WHEN quality = 1 THEN 1 END), 0) AS good,
               coalesce(max(CASE WHEN toxic = 1 THEN 1 END), 0) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, doc_id, CASE WHEN len(ws) < 50 THEN 1 ELSE 0 END
             + CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 2 ELSE 0 END
             + CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) THEN 4 ELSE 0 END
             + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
             + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM d),
c AS (SELECT part, mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n
      FROM m LEFT JOIN lab USING (doc_id) GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, 1 << (ascii(filter_order[step]) - 65) AS own,
             coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))), 0) AS bef
      FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, filter_order, step, own,
             sum(CASE WHEN mask & CAST(bef + own AS BIGINT) = 0 THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN mask & CAST(bef AS BIGINT) = 0 AND mask & own > 0 THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN mask & CAST(bef AS BIGINT) > 0 AND mask & own > 0 THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN mask & CAST(bef AS BIGINT) = 0 AND mask & own > 0 THEN n * good ELSE 0 END) AS good_lost,
             sum(CASE WHEN mask & CAST(bef AS BIGINT) = 0 AND mask & own > 0 THEN n * toxic ELSE 0 END) AS toxic_lost
      FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
"""
