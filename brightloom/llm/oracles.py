"""The same results in DuckDB's SQL, where it can say them."""

from __future__ import annotations

#: All pairs of documents with a common shingle, then reachability.
NGRAM_JACCARD_JOIN = r"""WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(words[i:i + 4], ' ')) AS shingle FROM w, unnest(range(1, greatest(len(words) - 4, least(len(words), 1)) + 1)) AS t(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reached r JOIN both_ways e ON e.a = r.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(coalesce(least(d.doc_id, m.b), d.doc_id) AS BIGINT) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS b FROM reached GROUP BY a) m ON m.a = d.doc_id"""

#: Windows of 50 words by their smallest document id.
SUBSTRING_DEDUP = r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS k FROM w, unnest(range(1, len(words) - 48)) AS t(i)),
first AS (SELECT k, min(doc_id) AS least FROM starts GROUP BY k),
gone AS (SELECT doc_id, i FROM starts JOIN first USING (k) WHERE least < doc_id),
each AS (SELECT doc_id, i, words[i] AS word FROM w, unnest(range(1, len(words) + 1)) AS t(i)),
marked AS (SELECT e.doc_id, e.i, e.word, max(CASE WHEN g.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY e.doc_id ORDER BY e.i ROWS 49 PRECEDING) AS gone FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.i = e.i),
kept AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n_words, CAST(sum(gone) AS BIGINT) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0), '') AS text FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM documents d LEFT JOIN kept ON kept.doc_id = d.doc_id"""

#: Strings of 400 bytes, in hexadecimal digits, that start twice; and of 200.
SUFFIX_ARRAY_DEDUP = r"""WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS t, strlen(coalesce(text, '')) AS n FROM documents),
starts AS (SELECT span, doc_id, i, md5(substr(t, 2 * i + 1, 2 * span)) AS k FROM h, unnest([200, 400]) AS s(span), unnest(range(0, n - span + 1)) AS u(i)),
twice AS (SELECT span, k FROM starts GROUP BY span, k HAVING count(*) > 1),
gone AS (SELECT span, doc_id, i FROM starts JOIN twice USING (span, k)),
touched AS (SELECT doc_id, t, n FROM h WHERE doc_id IN (SELECT doc_id FROM gone)),
marked AS (SELECT b.doc_id, b.i, b.byte, max(CASE WHEN g.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY b.doc_id ORDER BY b.i ROWS 399 PRECEDING) AS gone,
    max(CASE WHEN s.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY b.doc_id ORDER BY b.i ROWS 199 PRECEDING) AS shorter
  FROM (SELECT doc_id, i, substr(t, 2 * i + 1, 2) AS byte FROM touched, unnest(range(0, n)) AS u(i)) b
  LEFT JOIN gone g ON g.span = 400 AND g.doc_id = b.doc_id AND g.i = b.i LEFT JOIN gone s ON s.span = 200 AND s.doc_id = b.doc_id AND s.i = b.i),
runs AS (SELECT *, CASE WHEN gone = 1 AND lag(gone, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) = 0 THEN 1 ELSE 0 END AS opens FROM marked),
kept AS (SELECT doc_id, CAST(sum(gone) AS BIGINT) AS n_removed, CAST(sum(opens) AS BIGINT) AS n_spans, CAST(sum(shorter) AS BIGINT) AS n_shorter, coalesce(string_agg(byte, '' ORDER BY i) FILTER (WHERE gone = 0), '') AS t FROM runs GROUP BY doc_id)
SELECT h.doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.t, h.t))) AS kept_sha256, coalesce(n_shorter, 0) AS n_repeated_200
FROM h LEFT JOIN kept ON kept.doc_id = h.doc_id"""

#: The table of CRC-32, and of a text's bytes in hexadecimal digits the CRC.
_CRC_TABLE = "crc AS MATERIALIZED (SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) AS c FROM range(256) AS r(n)))"
_CRC = "xor(list_reduce(list_transform(range(length({0}) // 2), lambda i: CAST('0x' || substr({0}, 2 * i + 1, 2) AS BIGINT)), lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"

#: Out-of-place distances to the profiles of all labelled documents (no language of the tested table has more than the
#: operator's sample). An n-gram is its length and three code points, 0 for a border.
LANGUAGE_ID = rf"""WITH {_CRC_TABLE},
d AS (SELECT doc_id, lang, text, {_CRC.format("hex(encode(CAST(doc_id AS VARCHAR)))")} % 5 = 0 AS held_out FROM documents, crc),
chars AS (SELECT doc_id, [0] || list_transform(regexp_extract_all(lower(coalesce(text, '')), '(?s).'), lambda c: CASE WHEN regexp_matches(c, '\pL') THEN unicode(c) ELSE 0 END) || [0] AS x FROM d),
spots AS (SELECT doc_id, x[i] AS a, x[i + 1] AS b, x[i + 2] AS c FROM chars, unnest(range(1, length(x) - 1)) AS t(i)),
grams AS (SELECT doc_id, 1 AS k, 0 AS a, 0 AS b, b AS c FROM spots WHERE b > 0 UNION ALL SELECT doc_id, 2, 0, a, b FROM spots WHERE b > 0 OR a > 0 UNION ALL SELECT doc_id, 3, a, b, c FROM spots WHERE b > 0),
counted AS MATERIALIZED (SELECT doc_id, k, a, b, c, count(*) AS n FROM grams GROUP BY ALL),
profiles AS MATERIALIZED (SELECT lang, k, a, b, c, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, k, a, b, c) - 1 AS place FROM counted JOIN d USING (doc_id) WHERE lang IS NOT NULL AND text IS NOT NULL AND NOT held_out GROUP BY lang, k, a, b, c QUALIFY place < 300),
tops AS (SELECT doc_id, k, a, b, c, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, k, a, b, c) - 1 AS place FROM counted QUALIFY place < 300),
each AS (SELECT doc_id, l.lang, sum(least(300, coalesce(abs(p.place - t.place), 300))) AS far, count(*) AS n FROM tops t CROSS JOIN (SELECT DISTINCT lang FROM profiles) l LEFT JOIN profiles p ON p.lang = l.lang AND p.k = t.k AND p.a = t.a AND p.b = t.b AND p.c = t.c GROUP BY doc_id, l.lang),
best AS (SELECT doc_id, lang, 1.0::DOUBLE - CAST(far AS DOUBLE) / CAST(300 * n AS DOUBLE) AS score FROM each QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY far, lang) = 1)
SELECT d.doc_id, d.held_out, coalesce(best.lang, 'und') AS lang_pred, coalesce(score, CAST(0 AS DOUBLE)) AS score FROM d LEFT JOIN best USING (doc_id)"""

#: The heap as a recursion over all groups, largest first; shards of equal load by number.
LPT_SHARDING = f"""WITH RECURSIVE {_CRC_TABLE},
rows_ AS MATERIALIZED (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, coalesce(text, '') AS t, sha256(coalesce(text, '')) AS key FROM documents),
groups_ AS MATERIALIZED (SELECT key, sum(size) AS size, CAST('0x' || substr(sha256(unhex(key)), 1, 8) AS BIGINT) % 256 AS cell FROM rows_ GROUP BY key),
ordered AS MATERIALIZED (SELECT size, row_number() OVER (ORDER BY size DESC) AS i FROM groups_),
heap AS (SELECT CAST(0 AS BIGINT) AS i, [CAST(0 AS BIGINT) FOR s IN range(8)] AS loads, CAST(-1 AS BIGINT) AS shard, CAST(0 AS BIGINT) AS size
    UNION ALL SELECT o.i, [CASE WHEN s = list_position(h.loads, list_min(h.loads)) THEN h.loads[s] + CAST(o.size AS BIGINT) ELSE h.loads[s] END FOR s IN range(1, 9)], list_position(h.loads, list_min(h.loads)) - 1, CAST(o.size AS BIGINT) FROM heap h JOIN ordered o ON o.i = h.i + 1),
given AS (SELECT size, shard, row_number() OVER (PARTITION BY size ORDER BY shard) AS r FROM heap WHERE i > 0),
ranked AS (SELECT key, size, row_number() OVER (PARTITION BY size ORDER BY cell, key) AS r FROM groups_),
placed AS (SELECT x.*, g.shard, CAST('0x' || substr(sha256(CAST(x.doc_id AS VARCHAR) || ':' || upper(x.key)), 1, 8) AS BIGINT) % 16 AS cell FROM rows_ x JOIN ranked r USING (key) JOIN given g ON g.size = r.size AND g.r = r.r)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST({_CRC.format("hex(encode(placed.t))")} AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(shard AS INT) AS shard,
    CAST(row_number() OVER (PARTITION BY shard ORDER BY cell, doc_id, key) - 1 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard FROM placed, crc"""

#: Units by one pattern, parts by slices of their list.
FILL_IN_MIDDLE = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
x AS (SELECT *, [CAST('0x' || substr(h, 8 * k + 1, 8) AS BIGINT) FOR k IN range(4)] AS r FROM d),
y AS (SELECT *, least(r[1] % (len(u) + 1), r[2] % (len(u) + 1)) AS low, greatest(r[1] % (len(u) + 1), r[2] % (len(u) + 1)) AS high,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 50 THEN 'plain' WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM x),
z AS (SELECT *, coalesce(array_to_string(u[1:low], ''), '') AS p, coalesce(array_to_string(u[low + 1:high], ''), '') AS m, coalesce(array_to_string(u[high + 1:], ''), '') AS s FROM y)
SELECT doc_id, CAST(len(u) AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256 FROM z"""

#: All parts against all entries, three times.
_ASSIGN = "SELECT x.vec_id, x.p, x.v, arg_min(e.i, ({0}, e.i)) AS i, min({0}) AS far FROM parts x JOIN {1} e ON e.p = x.p GROUP BY x.vec_id, x.p, x.v"
_FAR = "list_sum(list_transform(range(1, len(x.v) + 1), lambda k: (x.v[k] - e.c[k]) * (x.v[k] - e.c[k])))"
_MEANS = """{1} AS MATERIALIZED (SELECT o.p, o.i, coalesce(m.c, o.c) AS c FROM {0} o LEFT JOIN (SELECT p, i, list(c ORDER BY k) AS c FROM
    (SELECT p, i, k, CAST(floor(CAST(sum(v[k]) AS DOUBLE) / count(*)) AS BIGINT) AS c FROM a_{0}, unnest(range(1, len(v) + 1)) AS u(k) GROUP BY p, i, k) GROUP BY p, i) m USING (p, i))"""
VECTOR_CODES = f"""WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, label, p, v[p * (len(v) // 16) + 1:(p + 1) * (len(v) // 16)] AS v FROM kept, unnest(range(16)) AS t(p)),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS i, v AS c FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)),
a_b0 AS MATERIALIZED ({_ASSIGN.format(_FAR, "b0")}), {_MEANS.format("b0", "b1")},
a_b1 AS MATERIALIZED ({_ASSIGN.format(_FAR, "b1")}), {_MEANS.format("b1", "b2")},
a_b2 AS MATERIALIZED ({_ASSIGN.format(_FAR, "b2")}),
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, i)) AS s FROM b2),
each AS (SELECT vec_id, string_agg(printf('%02x', i), '' ORDER BY p) AS code, CAST(sum(far) AS BIGINT) AS error FROM a_b2 GROUP BY vec_id),
labels_ AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM each JOIN kept USING (vec_id) GROUP BY label)
SELECT each.vec_id, code, error, label_error, s AS codebooks_sha256 FROM each JOIN kept USING (vec_id) JOIN labels_ ON kept.label IS NOT DISTINCT FROM labels_.label, books"""
