"""The queries of this subpackage and their SQL twins."""

import corpus_pipeline
from shelfspark.llm.conversation_repair import op12_conversation_repair
from shelfspark.llm.decontamination import op7_decontamination
from shelfspark.llm.embedding_dedup import op13_embedding_dedup
from shelfspark.llm.fill_in_middle import op11_fill_in_middle
from shelfspark.llm.html_extraction import op6_html_extraction
from shelfspark.llm.language_id import op1_language_id
from shelfspark.llm.mixing import op10_mix_sources
from shelfspark.llm.ngram_join import op2_ngram_jaccard_join
from shelfspark.llm.quality import op9_quality_rules
from shelfspark.llm.secret_scan import op3_secret_scan
from shelfspark.llm.sharding import op4_balanced_shards
from shelfspark.llm.token_counts import op8_token_counts
from shelfspark.llm.toxicity import op5_toxicity

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_secret_scan": op3_secret_scan,
    "op4_balanced_shards": op4_balanced_shards,
    "op5_toxicity": op5_toxicity,
    "op6_html_extraction": op6_html_extraction,
    "op7_decontamination": op7_decontamination,
    "op8_token_counts": op8_token_counts,
    "op9_quality_rules": op9_quality_rules,
    "op10_mix_sources": op10_mix_sources,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_embedding_dedup": op13_embedding_dedup,
    "pipeline": corpus_pipeline.run,
}
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: SQL for those whose whole result it can express; tests hold the others against brute force.
ORACLES: dict[str, str] = {
    "op2_ngram_jaccard_join": rf"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 2], ' ') END AS shingle FROM (SELECT r, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
both_ AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.r < b.r GROUP BY 1, 2),
l AS (SELECT a, b FROM both_ JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT r, r AS t FROM d UNION SELECT reach.r, e.b FROM reach JOIN e ON e.a = reach.t)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM d LEFT JOIN n ON n.r = d.r
JOIN (SELECT reach.r, min(o.doc_id) AS component_id FROM reach JOIN d o ON o.r = reach.t GROUP BY 1) c ON c.r = d.r""",
    "op7_decontamination": rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT DISTINCT item, k, array_to_string(w[p : p + k - 1], ' ') AS body FROM (SELECT item, w, least(10, len(w)) AS k, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS p FROM b WHERE len(w) > 0)),
x AS (SELECT r, p, k, array_to_string(w[p : p + k - 1], ' ') AS body FROM (SELECT r, w, k, unnest(generate_series(1, len(w) - k + 1)) AS p FROM d, (SELECT DISTINCT k FROM i) WHERE len(w) >= k)),
h AS (SELECT r, p, x.k, item FROM x JOIN i ON i.k = x.k AND i.body = x.body),
c AS (SELECT r, count(DISTINCT spot) AS n_hit FROM (SELECT r, unnest(generate_series(p, p + k - 1)) AS spot FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.r = d.r LEFT JOIN t ON t.r = d.r""",
    "op11_fill_in_middle": r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS w, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
n AS (SELECT *, len(w)::BIGINT AS n, ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2, ('0x' || h[25:32])::UBIGINT AS h4, t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') AS plain FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS lo, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS hi FROM n),
p AS (SELECT *, coalesce(array_to_string(w[1:lo], ''), '') AS pre, coalesce(array_to_string(w[lo + 1:hi], ''), '') AS mid, coalesce(array_to_string(w[hi + 1:], ''), '') AS suf, CASE WHEN plain THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END AS output FROM p),
s AS (SELECT *, string_split(output, '<M>') AS halves FROM o),
b AS (SELECT *, CASE WHEN form <> 'plain' THEN string_split(substr(halves[1], 4), CASE form WHEN 'spm' THEN '<P>' ELSE '<S>' END) END AS ends FROM s)
SELECT doc_id, n, form, CASE WHEN NOT plain THEN length(pre)::BIGINT END AS prefix_chars, CASE WHEN NOT plain THEN length(mid)::BIGINT END AS middle_chars, sha256(output) AS output_sha256,
sha256(CASE form WHEN 'plain' THEN output WHEN 'spm' THEN ends[2] || halves[2] || ends[1] ELSE ends[1] || halves[2] || ends[2] END) AS restored_sha256 FROM b""",
    "op13_embedding_dedup": r"""WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
f AS (SELECT r, vec_id, e FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.r AS a, b.r AS b FROM f a JOIN f b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT r, r AS t FROM v UNION SELECT reach.r, l.b FROM reach JOIN l ON l.a = reach.t),
c AS (SELECT reach.r, min(o.vec_id) AS component_id FROM reach JOIN v o ON o.r = reach.t GROUP BY 1),
n AS (SELECT a AS r, count(*) AS n FROM l GROUP BY 1)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, c.component_id IS NOT DISTINCT FROM v.vec_id AS kept FROM v JOIN c ON c.r = v.r LEFT JOIN n ON n.r = v.r""",
}
